import numpy as np
import pytest
from pyspark.sql import functions as F

from inkfold.llm import mixing, topics


def corpus(spark):
    rng = np.random.RandomState(0)
    rows = [(i, " ".join(["w"] * int(rng.randint(1, 900))), ["big", "b", "c"][min(2, int(rng.randint(0, 6)) // 2 if i % 3 else 0)], ["en", None, "de"][int(rng.randint(0, 3))], 1.0) for i in range(900)]
    return spark.createDataFrame([*rows, (900, None, "big", "en", 0.0), (None, "w w", "b", "de", 0.0)], "doc_id long, text string, source string, lang string, expected double")


def test_margins_meet_their_targets(spark):
    got = mixing.plan(corpus(spark), mixing.Targets(0.5)).toPandas()
    assert len(got) == 902 and got.expected.max() <= 1
    for d in mixing.DIMS:
        seen = got.groupby(d, dropna=False).n_tokens.sum() ** 0.5
        fitted = (got.n_tokens * got.expected).groupby(got[d], dropna=False).sum()
        seen, fitted = seen[seen > 0], fitted[seen > 0]
        assert np.allclose(fitted / fitted.sum(), seen / seen.sum(), atol=1e-4)
    assert abs(got.copies.sum() - got.expected.sum()) < 4 * np.sqrt(len(got)) / 2


def test_given_shares_and_budget(spark):
    shares = (("source", {"big": 0.2, "b": 0.5, "none": 0.3}),)
    got = mixing.plan(corpus(spark), mixing.Targets(1.0, shares), budget=500_000).toPandas()
    tokens = (got.n_tokens * got.expected).groupby(got.source).sum()
    c = got[got.source == "c"].n_tokens.sum() / got.n_tokens.sum()
    assert np.allclose(tokens["big"] / tokens["b"], 0.4, atol=1e-3) and abs(tokens.sum() - 500_000) < 5 and abs(tokens["c"] / tokens.sum() - c) < 1e-3


@pytest.mark.parametrize("shares", [(), (("source", {"big": 0.2, "b": 0.5, "none": 0.3}),)])
def test_many_cells_give_the_same(spark, shares):
    few, many = (mixing.plan(corpus(spark), mixing.Targets(0.7, shares), small=s).toPandas().sort_values("doc_id").expected.to_numpy() for s in (200_000, 2))
    assert np.allclose(few, many, atol=1e-5)


def test_sample_keeps_columns_and_repeats_copies(spark):
    docs = corpus(spark)
    plan = {r.doc_id: r.copies for r in mixing.plan(docs, budget=2_000_000).collect()}
    got = mixing.sampled(docs, budget=2_000_000)
    assert got.columns == docs.columns
    seen = [r.doc_id for r in got.collect()]
    assert {i: seen.count(i) for i in plan} == plan
    assert max(plan.values()) > 1
    assert mixing.sampled(docs.limit(0)).collect() == [] and mixing.plan(docs.limit(0)).collect() == []


def test_content_topics_and_given_languages_match_brute_force_raking(spark):
    rng = np.random.RandomState(3)
    subjects = [[f"{s}{i}" for i in range(60)] for s in ("sea", "law", "zoo")]
    rows = []
    for i in range(240):
        t = int(rng.randint(3))
        words = rng.choice(subjects[t], rng.randint(30, 90)).tolist() + ["the"] * 9
        rows.append((i, " ".join(words), f"s{rng.randint(4)}", ["en", "de", "fr"][int(rng.randint(0, 3))], t))
    rows += [(240, None, "s0", "en", -1), (241, " ", "s1", None, -1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, subject int")
    targets = mixing.Targets(0.0, (("lang", {"en": 0.2, "de": 0.5, "fr": 0.3}),))
    topic = topics.fit(docs, k=3).of(F.col("text"))
    again = topics.fit(docs.repartition(5), k=3)
    got = mixing.plan(docs, targets, topic=topic).join(docs.select("doc_id", "subject", again.of(F.col("text")).alias("again")), "doc_id").toPandas()
    assert (got.topic == got.again).all()
    assert got[got.subject >= 0].groupby("subject").topic.nunique().max() == 1 and got[got.subject >= 0].topic.nunique() == 3
    assert set(got[got.subject < 0].topic) == {topics.NONE}
    # raking by the definition, document by document
    own = got[got.n_tokens > 0]
    w = own.n_tokens / own.n_tokens.sum()
    goals = {"lang": {"en": 0.2, "de": 0.5, "fr": 0.3}, "source": {f"s{i}": 0.25 for i in range(4)}, "topic": {t: 1 / 3 for t in own.topic.unique()}}
    for _ in range(200):
        for d, goal in goals.items():
            w = w * own[d].map(goal) / w.groupby(own[d]).transform("sum")
    per_token = w / own.n_tokens
    assert np.allclose(own.expected, per_token / per_token.max(), atol=1e-5)
    assert got.residual.max() < 1e-5


def test_joint_targets_agree_where_dimensions_go_together(spark):
    rng = np.random.RandomState(5)
    rows = []
    for i in range(2000):
        lang = ["en", "de"][int(i % 5 == 0)]
        # a topic is of one language but for a few documents
        topic = lang if rng.rand() > 0.004 else "other"
        rows.append((i, " ".join(["w"] * int(rng.randint(20, 60))), f"s{min(3, int(rng.randint(12)))}", lang, topic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = mixing.Targets(0.9, (("lang", {"en": 0.6, "de": 0.4}),), joint=True)
    few, many = (mixing.plan(docs, targets, topic=F.col("topic"), small=s).toPandas().sort_values("doc_id", ignore_index=True) for s in (200_000, 2))
    assert np.allclose(few.expected, many.expected, atol=1e-4) and few.residual.max() < 1e-5
    fitted = (few.n_tokens * few.expected).groupby(few.lang).sum()
    assert np.allclose(fitted / fitted.sum(), [0.4, 0.6], atol=1e-4)
    assert few.expected.mean() > 0.25
    with pytest.raises(ValueError):
        mixing.Targets(0.9, (("lang", {}), ("source", {})), joint=True)


def test_small_topics_are_told_by_all_documents(spark):
    """A topic that the starting sample misjudges stays or goes by its share of all documents."""
    texts = lambda name, ids: [(i, " ".join(f"{name}{(i * 7 + k) % 30}" for k in range(40))) for i in ids]
    rows = texts("a", range(100)) + texts("b", range(100, 200)) + [(i, texts("c", [i])[0][1]) for i in range(200, 203)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    # the few of c are all of the start but a few, and under a fiftieth of all
    picked = lambda rows, key, bound: rows.where("doc_id >= 200 or doc_id in (1, 101)")
    whole, topics.hash_sample = topics.hash_sample, picked
    try:
        assert len(topics.fit(docs, k=3).centres) == 2
    finally:
        topics.hash_sample = whole
