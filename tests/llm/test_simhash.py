import corpus_pipeline
import numpy as np
import pytest
import xxhash

from inkfold.llm import simhash


def brute(texts):
    prints = []
    for text in texts:
        words = (text or "").encode().lower().split()
        shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints.append(sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64)))
    return prints


def components(ids, prints):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, p in zip(ids, prints):
        for j, q in zip(ids, prints):
            if bin(p ^ q).count("1") <= 4:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_near_groups_match_brute_force(spark):
    rng = np.random.RandomState(3)
    base = [" ".join(f"w{x}" for x in rng.randint(0, 500, n)) for n in (0, 2, 3, 4, 5, 300, 400, 2000)]
    texts = [None, "", " \t ", *base, *base[:3], "A B c", "a b C"]
    for t in base[5:]:
        for k in range(6):
            w = t.split()
            w[k * 3] = "x"
            texts.append(" ".join(w[: len(w) - k]))
    rows = [(i, t, "en", k) for k, (i, t) in enumerate(enumerate(texts, 10))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id int")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_groups(docs).collect()}
    prints = brute(texts)
    want = components([r[0] for r in rows], prints)
    assert got == {r[0]: (f"{p:016x}", want[r[0]]) for r, p in zip(rows, prints)}


@pytest.mark.parametrize("cell", [8, 64, 4096])
def test_index_finds_all_links(spark, cell):
    rng = np.random.RandomState(5)
    fps = [int(x) for x in rng.randint(0, 2**62, 300)]
    for f in fps[:40]:
        for _ in range(3):
            fps.append(f ^ sum(1 << int(b) for b in rng.choice(64, rng.randint(1, 6), False)))
    ball = [fps[0] ^ (1 << i) ^ (1 << j) for i in range(20) for j in range(i)]
    fps = list(dict.fromkeys(fps + ball))
    rows = [(i, f - 2**64 if f >= 2**63 else f) for i, f in enumerate(fps)]
    entries = spark.createDataFrame(rows, "rep long, fp long")
    links = [(r.a, r.b) for r in simhash.fingerprint_links(entries, 4, cell).collect()]
    assert all(bin(fps[a] ^ fps[b]).count("1") <= 4 for a, b in links)
    roots = {r.id: r.root for r in simhash.connected_components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    want = components(range(len(fps)), fps)
    assert {i: roots.get(i, i) for i in range(len(fps))} == want


def test_gray_rank_orders_code_words(spark):
    code = [i ^ (i >> 1) for i in range(64)]
    df = spark.createDataFrame([(c,) for c in code], "fp long")
    ranks = [r[0] + 2**63 for r in df.select(simhash.gray_rank(df.fp)).collect()]
    assert ranks == list(range(64))


def test_empty_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).collect() == []
    docs = spark.createDataFrame([(None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e")], "doc_id long, text string")
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in simhash.near_groups(docs).collect()) == [(-1, -1), (4, 4), (4, 4)]
    assert [r.doc_id for r in simhash.one_of_each(docs.where("doc_id is not null").distinct()).collect()] == [4]


def test_one_row_of_each_group_with_null_and_repeated_ids(spark):
    rng = np.random.RandomState(8)
    a, b, c, d = (" ".join(f"w{x}" for x in rng.randint(0, 500, 300)) for _ in range(4))
    rows = [
        (None, a, 1), (None, a, 1), (None, a.replace(" ", "  "), 2),  # a group without ids
        (4, b, 1), (4, b, 1), (4, c, 3), (9, c, 4), (None, c, 5),  # two texts under one id, and exact repeats
        (7, d, 1), (3, d, 2), (3, d.replace(" ", "\t"), 2),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    groups = {a: "a", b: "b", c: "c", d: "d"}
    for parts in (1, 4):
        for some in (docs, docs.where("doc_id is null")):
            got = corpus_pipeline.one_of_each(spark, some.repartition(parts), "").collect()
            of = sorted((groups[" ".join(r.text.split())], r.doc_id or 0) for r in got)
            assert of == ([("a", 0), ("b", 4), ("c", 4), ("d", 3)] if some is docs else [("a", 0), ("c", 0)])
