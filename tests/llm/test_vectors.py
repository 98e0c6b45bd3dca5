"""Whitening and hard negatives against brute force, and their defined cases."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import negatives, whitening
from inkfold.llm.queries import ORACLES, QUERIES
from inkfold.llm.tables import read

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def test_symmetric_qr_solves_all_kinds_of_matrices():
    rng = np.random.default_rng(3)
    wide = rng.normal(size=(40, 40))
    cases = [np.zeros((3, 3)), np.eye(5), np.diag([3.0, 1.0, 2.0]), np.ones((6, 6)), wide @ wide.T, wide + wide.T, np.array([[2.0]]), np.diag([1e12, 1e-3, 0.0]) + 1e-6, np.kron(np.eye(3), [[2.0, 1.0], [1.0, 2.0]])]
    for a in cases:
        values, vectors = whitening.symmetric_qr(a)
        scale = max(1.0, np.abs(a).max())
        assert np.allclose(values, np.linalg.eigvalsh(a)[::-1], rtol=1e-12, atol=1e-12 * scale)
        assert np.abs(vectors @ vectors.T - np.eye(len(a))).max() < 1e-12
        assert np.abs(vectors.T * values @ vectors - a).max() < 1e-12 * scale


def test_welford_in_any_split_equals_two_passes():
    rng = np.random.default_rng(4)
    x = rng.integers(-300, 300, (3000, 7)) + 10**6  # far from zero, where sums of squares would cancel
    want = np.cov(x.T, bias=True)
    for cuts in ([], [1], [1, 2, 3, 2999], [500, 1000]):
        total = whitening.Moments.none(7)
        for part in np.split(x, cuts):
            own = whitening.Moments.none(7)
            for k in range(0, len(part), 100):
                own.add(part[k : k + 100])
            total.merge(own)
        assert total.n == 3000 and total.sums == x.sum(0).tolist()
        assert np.allclose(total.products / total.n, want, rtol=1e-10)
    one = whitening.Moments.none(2)
    for row in x[:50, :2]:  # row by row, as the formula is written
        one.add(row[None])
    assert np.allclose(one.products / 50, np.cov(x[:50, :2].T, bias=True), rtol=1e-10)


def whitened_by_hand(rows):
    """{(vec_id, component): ...} of distinct ids, by numpy's eigenvalues over the distinct vectors."""
    x = {i: tuple(math.floor(256 * float(c)) for c in v) for i, v in rows}
    fit = np.array(sorted(set(x.values())))
    n, total = len(fit), fit.sum(0)
    values, vectors = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for i, v in x.items():
        apart = [n * int(a) - int(s) for a, s in zip(v, total)]
        for k in range(min(4, len(values))):
            out[i, k + 1] = (n, sum(a * a for a in apart), float(np.array(apart) / n @ vectors[:, k] / math.sqrt(values[k])), values[k] / values.sum())
    return out


def test_whitening_query_equals_brute_force(spark):
    got = QUERIES["op11_whitening"](spark, SF).collect()
    table = [(r.vec_id, r.embedding) for r in read(spark, SF, "embeddings").collect()]
    want = whitened_by_hand(table)
    assert len(got) == len(want)
    sign = {}
    for r in got:
        n, deviation, value, share = want[r.vec_id, r.component]
        assert (r.n, r.deviation, int(r.deviation_exact)) == (n, deviation, deviation)
        assert abs(r.explained / share - 1) < 1e-9 and r.identity_error < 1e-9
        if abs(value) > 1e-6:
            assert sign.setdefault(r.component, math.copysign(1, value * r.whitened)) == math.copysign(1, value * r.whitened)
        assert abs(abs(r.whitened) - abs(value)) < 1e-8


def test_whitening_defined_cases(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)  # several rounds of merging
    rng = np.random.default_rng(8)
    good = [(i, rng.normal(size=5).astype(np.float32).tolist()) for i in range(60)]
    rows = [(i, v, "a") for i, v in good] + [(900, good[3][1], "copy"), (901, good[3][1], "copy"), (None, good[4][1], "no id"), (7, good[7][1], "again")]
    rows += [(1000, None, "-"), (1001, [1.0, None, 0.0, 0.0, 0.0], "-"), (1002, [NAN] * 5, "-"), (1003, [INF, 0.0, 0.0, 0.0, 0.0], "-"), (1004, [0.5, -0.25], "short")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, n string").repartition(7)
    got = whitening.whiten(table).collect()
    want = whitened_by_hand([*good, (900, good[3][1]), (901, good[3][1]), (1004, [0.5, -0.25, 0.0, 0.0, 0.0])])
    assert len(got) == (60 + 2 + 1 + 1 + 1) * 4
    assert {r.vec_id for r in got} == {i for i, _ in want} | {None}
    for r in got:
        if r.vec_id is not None:
            n, deviation, value, share = want[r.vec_id, r.component]
            assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(value)) < 1e-8 and abs(r.explained - share) < 1e-9
    flat = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0])], "vec_id long, embedding array<float>")
    got = {(r.vec_id, r.component): r for r in whitening.whiten(flat).collect()}
    assert len(got) == 4 and abs(abs(got[1, 1].whitened) - 1) < 1e-12 and got[1, 2].whitened is None and got[1, 1].explained == 1.0
    assert whitening.whiten(table.limit(0)).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [])], "vec_id long, embedding array<float>")).count() == 0
    assert whitening.whiten(spark.createDataFrame([(1, [2.0])], "vec_id long, embedding array<float>")).first().whitened is None


def test_deviations_beyond_64_bits():
    big = np.array([[2**50 + 3, -(2**50) + 7], [1, -1], [2**40, 5]])
    want = [sum(int(v) ** 2 for v in row) for row in big]
    assert whitening.Whitener.deviations(big) == want
    assert whitening.Whitener.deviations(big.astype(object) * 10**9) == [w * 10**18 for w in want]


def mined_by_hand(rows, k=5):
    """By plain loops; rows: (id, label, whole vector)."""
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    anchors = {}
    for r in rows:
        if r[0] % 100 == 0:
            anchors[r[0]] = min(anchors.get(r[0], r), r)
    for a in anchors.values():
        scored = sorted((-dot(a[2], v), i, label == a[1], label) for i, label, v in rows)
        for ps, p, same, _ in [s for s in scored if s[2] and s[1] != a[0]][:k]:
            below = [s for s in scored if not s[2] and 80 * -ps <= 100 * -s[0] <= 100 * -ps][:k]
            out += [(a[0], p, rank, n, -ps, -ns) for rank, (ns, n, _, _) in enumerate(below, 1)]
    return sorted(out)


COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def mined(table, **more):
    return sorted(map(tuple, negatives.hard_negatives(table, F.col("vec_id") % 100 == 0, **more).select(COLUMNS).collect()))


def test_negatives_query_equals_its_sql(spark):
    db = duckdb.connect()
    db.sql(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = sorted(db.sql(f"select {', '.join(COLUMNS)} from ({ORACLES['op13_hard_negatives']})").fetchall())
    assert want and sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, SF).select(COLUMNS).collect())) == want


@pytest.mark.parametrize("block,run,held", [(8192, 4096, 512), (2, 7, 2), (1, 1, 1)])
def test_negatives_equal_brute_force_with_ties_and_repeats(spark, monkeypatch, block, run, held):
    monkeypatch.setattr(negatives, "RUN", run)
    monkeypatch.setattr(negatives, "HELD", held)
    rng = np.random.default_rng(block)
    # few values, so that many scores tie; a third of the rows are one vector, one label is frequent
    rows = [(int(i), int(rng.choice([1, 1, 1, 2, 3])), rng.integers(-1, 3, 3).tolist()) for i in range(0, 1000, 4)]
    rows += [(int(i), int(rng.integers(1, 4)), [1, 2, 1]) for i in range(1, 500, 4)]
    rows += [rows[5], rows[0], (100, 3, [2, 2, 2]), (200, 9, [1, 1, 1])]
    table = spark.createDataFrame([(i, label, [c / 256 for c in v], "x") for i, label, v in rows], "vec_id long, label int, embedding array<double>, score string").repartition(5)
    assert mined(table, block=block) == mined_by_hand(rows)


def test_negatives_defined_cases(spark):
    one = [1 / 256, 2 / 256]
    rows = [(0, 1, one), (1, 1, one), (2, 2, [1 / 256]), (3, 2, [1 / 256, 2 / 256, 9.0]), (4, None, one), (None, 2, one), (5, 2, None), (6, 2, [None, 1.0]), (7, 2, [NAN, 1.0]), (8, 2, [INF, 1.0]), (100, 5, one)]
    table = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    # scores of anchor 0: the positive 1 has 5, negatives 3 and 100 have 5, 2 has 1
    assert mined(table) == [(0, 1, 1, 3, 5, 5), (0, 1, 2, 100, 5, 5)]
    assert mined(table.limit(0)) == []
    assert mined(table.where("vec_id % 100 <> 0")) == []
    huge = spark.createDataFrame([(0, 1, [1e15]), (1, 1, [1e15])], "vec_id long, label int, embedding array<double>")
    with pytest.raises(Exception, match="doesn't fit 64 bits"):
        mined(huge)


def test_scores_are_exact_in_each_type():
    rng = np.random.default_rng(1)
    for size in (100, 10**6, 10**8):
        a, b = rng.integers(-size, size, (3, 8)), rng.integers(-size, size, (4, 8))
        assert negatives.scores(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
