import collections
import re

import numpy as np
from hypothesis import given, settings, strategies as st

from inkfold.llm import decision_list as dl

GAP = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = GAP.findall(text)
    five = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(five)
    covered = {k for i, f in enumerate(five) if n[f] > 1 for k in range(i, i + 5)}
    lines = [x for x in text.split("\n") if GAP.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab \n\t#é|\x0b", max_size=80), min_size=20, max_size=60))
def test_statistics(spark, texts):
    rows = [*enumerate(texts), (1000, None), (1001, "a b c d e " * 400), (1002, "x"), (1003, "a b c d e"), (1004, "a a a a a a")]
    got = dl.text_stats(spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_words int")).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == {i: brute(t) for i, t in rows}


def test_list_learns_conjunctions_and_is_one_case(spark):
    rng = np.random.RandomState(0)
    x, y = rng.rand(3000), rng.rand(3000)
    bad = (x > 0.7) & (y <= 0.4) | (x < 0.1)
    rows = [(int(not b), i % 3, float(a), float(c)) for i, (b, a, c) in enumerate(zip(bad, x, y))]
    df = spark.createDataFrame(rows, "label int, fold int, x double, y double")
    rules = dl.learn(df, ["x", "y"])
    wrong = df.where(rules.rejects() != (df.label == 0)).count()
    assert wrong < 90 and any(len(r) == 2 for r in rules.rules)
    assert dl.learn(df.where("label = 1"), ["x", "y"]).rules == []


def test_verdicts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(i, good + f" {i}" if i % 2 else good.replace(" ", "# ")) for i in range(300)] + [(900, None), (901, "a b c d e f " * 20), (None, good + " 7"), (0, good.replace(" ", "# "))]
    docs = spark.createDataFrame([(i, t, True) for i, t in rows], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(5, None), (None, 0), (7777, 0)], "doc_id long, quality int")
    out, rules = dl.verdicts(docs, labels)
    got = {(r.doc_id, r.base_failed, r.kept) for r in out.collect()}
    assert {(i, False, bool(i % 2)) for i in range(300)} | {(900, True, False), (901, True, False), (None, False, True)} == got
    assert out.count() == 304 and rules.rules
    assert dl.verdicts(docs.limit(0), labels)[0].collect() == []


def test_first_rule_matches_brute_force(spark):
    rng = np.random.RandomState(4)
    x, y = np.round(rng.rand(600), 2), np.round(rng.rand(600), 2)
    label = ((x <= 0.6) | (rng.rand(600) < 0.03)).astype(int)
    df = spark.createDataFrame([(int(v), i % 3, float(a), float(b)) for i, (v, a, b) in enumerate(zip(label, x, y))], "label int, fold int, x double, y double")
    (rule, *_) = dl.learn(df, ["x", "y"], bins=20, max_tests=1).rules
    grow = np.arange(600) % 3 < 2
    p0, n0 = (label[grow] == 0).sum(), (label[grow] == 1).sum()

    def gain(covered):
        p, n = (label[covered & grow] == 0).sum(), (label[covered & grow] == 1).sum()
        return p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0))) if p >= 20 else 0.0

    every = [side for v in (x, y) for c in np.unique(np.quantile(v, np.arange(1, 20) / 20, method="inverted_cdf")) for side in (v <= c, v > c)]
    (test,) = rule
    v = {"x": x, "y": y}[test.feature]
    assert abs(gain(v > test.cut if test.above else v <= test.cut) - max(map(gain, every))) < 1e-9
