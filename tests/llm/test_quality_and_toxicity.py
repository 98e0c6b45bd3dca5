import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest

from inkfold.llm import boosting, quality, toxicity
from inkfold.llm.words import chunks


def corpus(spark, n=400):
    rng = np.random.RandomState(4)
    docs, labels = [], []
    for i in range(n):
        words = [f"w{x}" for x in rng.randint(0, 300, rng.randint(30, 120))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if toxic:
            for k in rng.randint(0, len(words), 4):
                words[k] = "Scum!" if k % 2 else "scum"
        text = "### ".join(words) if bad else " ".join(words)
        docs.append((i, text, "en"))
        labels.append((i, int(not bad), int(toxic)))
    odd = [(n, None, "en"), (n + 1, "", "en"), (None, "w1 w2", "en"), (0, docs[0][1], "en")]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, quality_score string")
    return d, spark.createDataFrame([*labels, (5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), {r[0]: r for r in labels}


@pytest.mark.parametrize("module, target, mod, rem", [(quality, 1, 4, 2), (toxicity, 2, 5, 0)])
def test_held_out_accuracy(spark, module, target, mod, rem):
    docs, labels, truth = corpus(spark)
    rows = module.classify(docs, labels).collect()
    assert len(rows) == 404
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % mod == rem) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= (0.7 if module is quality else 0.5)) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id][target] for r in held]) > 0.95
    assert module.classify(docs.limit(0), labels).collect() == []
    assert len({r.score for r in module.classify(docs, labels.limit(0)).collect()}) == 1


def test_rejected_documents_go_and_columns_stay(spark):
    docs, labels, truth = corpus(spark)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert np.mean([truth[i][1] for i in ids if i in truth]) > 0.97 and len(ids) > 240


def test_trees_walk_like_their_splits():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(500, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = boosting.fit(x, y, trees=30, depth=3)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
    for row in range(20):
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf):
            at = 0
            while at < len(f):
                at = 2 * at + 1 + int(x[row, f[at]] > c[at])
            total += leaf[at - len(f)]
        assert abs(total - trees.margin(x[row : row + 1])[0]) < 1e-9


def test_features_match_brute_force():
    (c,) = chunks(pa.array(["A b! a,b c", "", "a b"]))
    doc, bucket = toxicity.chunk_features(c)
    per = {d: set(bucket[doc == d].tolist()) for d in range(3)}
    assert len(per[0]) == 3 + 4 + 3 - 1 and per[1] == set()  # words, pairs (a b twice), gapped pairs
    assert per[2] <= per[0]


def test_l1_leaves_few_weights():
    rng = np.random.RandomState(1)
    model = toxicity.Ftrl(1000)
    for _ in range(2000):
        features = np.append(0, rng.choice(np.arange(1, 1000), 20, False))
        model.learn(features, float(7 in features))
    w = model.weights()
    assert w.argmax() == 7 and (w != 0).sum() < 200


def test_ftrl_steps_match_the_definition():
    rng = np.random.RandomState(2)
    model = toxicity.Ftrl(50, alpha=0.7, beta=1.5, l1=0.3, l2=0.2)
    z, n = collections.defaultdict(float), collections.defaultdict(float)

    def weight(i):
        if abs(z[i]) <= 0.3:
            return 0.0
        return -(z[i] - math.copysign(0.3, z[i])) / ((1.5 + math.sqrt(n[i])) / 0.7 + 0.2)

    for _ in range(300):
        features, label = np.unique(np.append(0, rng.randint(1, 50, 6))), float(rng.rand() < 0.3)
        w = {i: weight(i) for i in features.tolist()}
        g = 1 / (1 + math.exp(-sum(w.values()))) - label
        for i in w:
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.7 * w[i]
            n[i] += g * g
        model.learn(features, label)
    assert np.allclose(model.weights(), [weight(i) for i in range(50)], atol=1e-9)


def test_long_texts_are_learnt_whole(spark):
    long = " ".join(f"w{i}" for i in range(40_000))
    docs = spark.createDataFrame([(i, f"{long} foul{i}" if i % 2 else f"fine {i}") for i in range(1, 41)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 41)], "doc_id long, toxic int")
    got = [toxicity.train(docs.repartition(parts), labels, l1=0.5).sort_values("bucket", ignore_index=True) for parts in (1, 4)]
    assert got[0].equals(got[1]) and len(got[0]) > 10_000


def test_first_split_and_leaves_match_brute_force():
    rng = np.random.RandomState(3)
    x = np.round(rng.normal(size=(120, 3)), 1)
    y = (x[:, 1] + rng.normal(size=120) > 0.2).astype(float)
    trees = boosting.fit(x, y, trees=1, depth=1, rate=0.5, bins=16, ridge=1.0)
    share = (y.sum() + 1) / (len(y) + 2)
    g, h = share - y, np.full(len(y), share * (1 - share))
    score = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + 1.0)
    best = max(
        (score(x[:, f] <= c) + score(x[:, f] > c) - score(np.ones(len(y), bool)), -f, -c)
        for f in range(3)
        for c in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 17)[1:-1]))
        if h[x[:, f] <= c].sum() >= 1 and h[x[:, f] > c].sum() >= 1
    )
    f, c = trees.feature[0, 0], trees.cut[0, 0]
    assert abs(score(x[:, f] <= c) + score(x[:, f] > c) - score(np.ones(len(y), bool)) - best[0]) < 1e-9
    for leaf, rows in enumerate((x[:, f] <= c, x[:, f] > c)):
        assert abs(trees.leaf[0, leaf] + 0.5 * g[rows].sum() / (h[rows].sum() + 1.0)) < 1e-9


def test_every_labelled_row_is_learnt(spark, monkeypatch):
    """Trees grown from sums of tasks are those of all rows at hand, and no row is left out."""
    docs, labels, _ = corpus(spark)
    near = quality.train(docs, labels, trees=12)
    seen = []
    whole = quality.grown
    monkeypatch.setattr(quality, "REFRESH", 5)
    monkeypatch.setattr(quality, "grown", lambda sums, *a, **k: whole(lambda *x: seen.append(sums(*x)) or seen[-1], *a, **k))
    far = quality.train(docs.repartition(5), labels, local=10, trees=12)
    assert np.array_equal(near.feature, far.feature) and np.array_equal(near.cut, far.cut) and np.allclose(near.leaf, far.leaf)
    n = sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(400)) + (zlib.crc32(b"0") % 4 != 2)  # document 0 is there twice
    share = 1 / (1 + math.exp(-far.base))
    assert abs(seen[0][1][0, 0].sum() / boosting.FIXED - n * share * (1 - share)) < 1e-6  # curvature of the first tree's root


def test_every_labelled_document_has_a_learner(spark):
    """Weights are the mean of learners that share all labelled documents between them."""
    docs = spark.createDataFrame([(i, f"{'foul' if i % 2 else 'fine'} only{i}") for i in range(1, 201)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 201)], "doc_id long, toxic int")
    got = [toxicity.train(docs.repartition(parts), labels, learner=40, l1=0.0, epochs=1).sort_values("bucket", ignore_index=True) for parts in (1, 5)]
    assert got[0].equals(got[1])
    (c,) = chunks(pa.array([f"only{i}" for i in range(1, 201) if zlib.crc32(str(i).encode()) % 5]))
    assert set(toxicity.chunk_features(c)[1].tolist()) <= set(got[0]["bucket"])  # without L1 every document leaves its own word's weight


def test_a_level_reads_few_records_however_the_rows_are_dealt(spark, monkeypatch):
    """What a level costs besides its rows: a record for a batch of rows, and tasks by the number of rows."""
    docs, labels, _ = corpus(spark)
    tables = []
    whole = quality.materialize
    monkeypatch.setattr(quality, "PART", 128)
    monkeypatch.setattr(quality, "materialize", lambda df, name: tables.append((name, whole(df, name))) or tables[-1][1])
    quality.train(docs.repartition(40), labels, local=10, trees=1)
    stats, codes = (dict(tables)[name] for name in ("stats", "codes"))
    assert codes.count() == -(-stats.count() // 128) == 3
    assert sum(len(r.label) for r in codes.collect()) == stats.count()
