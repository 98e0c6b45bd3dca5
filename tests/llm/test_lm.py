import collections
import math
import zlib

import numpy as np
import pyarrow as pa

from inkfold.llm import gru, lm


def test_gradients_match_differences():
    rng = np.random.RandomState(0)
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.randint(1, 50, 8).astype(float), 20.0, hidden=5, block=4).items()}
    i, t, m, h = rng.randint(0, 10, (6, 3)), rng.randint(0, 9, (6, 3)), rng.rand(6, 3) > 0.2, rng.normal(size=(3, 5))
    g = gru.gradients(p, i, t, m, h)[0]
    for k in p:
        at = tuple(rng.randint(0, s) for s in p[k].shape)
        held = p[k][at]
        p[k][at] = held + 1e-3
        up = gru.gradients(p, i, t, m, h)[1]
        p[k][at] = held - 1e-3
        down = gru.gradients(p, i, t, m, h)[1]
        p[k][at] = held
        assert abs((up - down) / 2e-3 - g[k][at]) < 1e-2


def test_probabilities_sum_to_one():
    p = gru.initial(np.arange(64.0)[::-1], 30.0, hidden=4, block=8)
    state = np.random.RandomState(0).normal(size=(1, 4)).astype(np.float32)
    assert abs(np.exp(gru.log_probs(p, np.repeat(state, 65, 0), np.arange(65))).sum() - 1) < 1e-5


def test_packed_scores_equal_single_ones():
    rng = np.random.RandomState(1)
    p = gru.initial(np.arange(64.0)[::-1], 30.0, hidden=6, block=8)
    lengths = [0, 1, 5, 0, 300, 70, 64, 2]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    tokens = rng.randint(0, 65, offsets[-1])
    got = gru.score(p, tokens, offsets, slots=3, window=16)
    for d in range(len(lengths)):
        h, before, total = np.zeros((1, 6), np.float32), 65, 0.0
        for x in tokens[offsets[d] : offsets[d + 1]]:
            h = gru._step(p, (p["input"] + p["bias"])[[before]], h)[0]
            total += gru.log_probs(p, h, np.array([x]))[0]
            before = x
        assert abs(total - got[d]) < 1e-2


def test_base_is_exact_and_the_model_learns(spark, monkeypatch):
    rng = np.random.RandomState(2)
    texts = [" ".join(f"{'ab'[i % 2]}{x}" for x in rng.zipf(1.5, rng.randint(20, 400)) if x < 3000) for i in range(400)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(400, None), (401, " "), (None, texts[0].upper()), (3, texts[3])]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, row int")
    monkeypatch.setattr(lm, "COMMON", 300)  # so that the joined counts take part
    got = lm.score(docs, head=256).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), 0]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = collections.Counter(w for i, t in rows if not held(i) for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)), 4)) for i, t in rows)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert lm.score(docs.limit(0)).collect() == []


def test_every_segment_is_learnt_in_each_round(spark):
    docs = spark.createDataFrame([(i, " ".join("ab"[i % 2] for _ in range(n))) for i, n in enumerate((0, 63, 64, 5000))], "doc_id long, text string").coalesce(1)
    counts = lm.word_counts(docs).toPandas()
    words = lm.Words(counts["h"].to_numpy(np.int64).view(np.uint64), counts["c"].to_numpy(np.int64), 32)
    start = gru.initial(words.head_counts, 0.0)
    opening, want = len(start["input"]) - 1, start
    ranks = []
    for _, tokens, offsets in lm.tokens_of(pa.array([r.text for r in docs.collect()])):
        rank = words.look_up(tokens)[1]
        ranks += [rank[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
    whole = [np.append(np.append(opening, r)[k : k + 1], r[k : k + 64]) for r in ranks for k in range(0, len(r), 64)]
    for _ in range(2):
        want, seen = gru.train(want, whole)
        assert seen == sum(map(len, ranks)) == 1 + 64 + 65 + 5001
    got = lm.train(docs, words, start)
    assert np.allclose(gru.flatten(got), gru.flatten(want), atol=1e-4)


def test_head_grows_with_the_vocabulary():
    assert lm.head_shape(0) == lm.head_shape(1 << 18) == (2048, 32)
    heads = [lm.head_shape(10**k)[0] for k in range(6, 10)]
    assert all(3 * a < b < 4 * a for a, b in zip(heads, heads[1:])) and heads[-1] < lm.COMMON


def test_words_tied_at_the_top_and_very_long_texts(spark, monkeypatch):
    words = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(words[k::7]) + " " + " ".join(words[k::7])) for i, k in enumerate(range(7))] + [(50, "w1 " * 40_000)]
    docs = spark.createDataFrame(rows[:7], "doc_id long, text string")
    monkeypatch.setattr(lm, "COMMON", 200)
    top = lm.commonest(lm.word_counts(docs).where("c = 2"), 200).count()
    assert 100 < top <= 200
    for some in (docs, spark.createDataFrame(rows, "doc_id long, text string")):
        got = lm.score(some, head=64, held_out=(10**9, 10**9 - 1), rounds=1).collect()
        c = collections.Counter(w for _, t in rows[: len(got)] for w in [*t.encode().lower().split(), 0])
        n, v = sum(c.values()), len(c)
        for r in got:
            text = [*dict(rows)[r.doc_id].encode().lower().split(), 0]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(text), len(text), n) and math.isfinite(r.score)
            assert abs(r.base_score - sum(math.log10((c[w] + 1) / (n + v + 1)) for w in text)) < 1e-6 * len(text)


def test_only_tokens_that_count_are_worked_on(monkeypatch):
    rng, rows, real = np.random.RandomState(3), [], gru._output
    p = {k: v.astype(np.float64) for k, v in gru.initial(rng.randint(1, 50, 8).astype(float), 20.0, hidden=5, block=4).items()}
    # input 8 is RARE, 9 the start of a text
    i, t, m, h = rng.randint(0, 10, (6, 7)), rng.randint(0, 9, (6, 7)), rng.rand(6, 7) > 0.3, rng.normal(size=(7, 5))
    monkeypatch.setattr(gru, "PART", 4)
    monkeypatch.setattr(gru, "_output", lambda w, x, *more: rows.append(len(x)) or real(w, x, *more))
    g = gru.gradients(p, i, t, m, h)[0]
    assert sum(rows) == m.sum() + (m & (t < 8)).sum() and max(rows) <= 4
    for at in np.ndindex(p["input"].shape):
        held, loss = p["input"][at], []
        for step in (1e-4, -1e-4):
            p["input"][at] = held + step
            loss.append(gru.gradients(p, i, t, m, h)[1])
        p["input"][at] = held
        assert abs((loss[0] - loss[1]) / 2e-4 - g["input"][at]) < 1e-5
    assert np.allclose(g["bias"], g["input"].sum(0))
    i[i == 8] = 0
    assert not gru.gradients(p, i, t, m, h)[0]["input"][8].any()  # exactly: Adam makes a step of the least rest


def test_gates_may_shut():
    p = gru.initial(np.arange(64.0)[::-1], 30.0, hidden=4, block=8)
    new = gru._step(p, np.repeat(np.array([[-200.0, -200.0, 0.5]], np.float32), 4, 1), np.zeros((1, 4), np.float32))[0]
    assert np.allclose(new, np.tanh(0.5))
