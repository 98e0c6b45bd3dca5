import numpy as np
import pyarrow as pa
import pytest

from inkfold.llm import alignment, passages
from inkfold.llm.words import chunks


def words(rng, n):
    return [f"w{x}" for x in rng.randint(0, 5000, n)]


def test_windows_are_the_wide_nodes_of_the_cartesian_tree():
    rng = np.random.RandomState(1)
    texts = [" ".join(words(rng, n)) for n in (3, 60, 400, 55, 0, 900)] + ["a b " * 60]
    (chunk,) = chunks(pa.array(texts))
    row, key, c, l, r, blocks = passages.windows(chunk, 46, 2)
    from inkfold.llm.words import mix, runs_of

    got = {(int(a), int(k) & 3, int(x), int(y), int(z)) for a, k, x, y, z in zip(row, key, c, l, r)}
    want = set()
    h = chunk.hashes()
    for i in range(chunk.rows):
        s = runs_of(h[chunk.docs[i] : chunk.docs[i + 1]], 5)
        for f in range(2):
            x = mix(s + np.uint64((f + 1) * 0x9E3779B97F4A7C15 % 2**64)) | np.uint64(1)
            for p in range(len(x)):
                a = p
                while a > 0 and x[a - 1] > x[p]:
                    a -= 1
                b = p
                while b + 1 < len(x) and x[b + 1] >= x[p]:
                    b += 1
                if b - a + 1 >= 46:
                    want.add((i, f, p, a, b))
    assert got == want


def test_shared_passages_are_found_and_others_left_alone(spark):
    rng = np.random.RandomState(2)
    rows, want, n = [], {}, 0
    shared = [words(rng, k) for k in (51, 52, 60, 90, 200)]
    for s in shared:
        first = n
        for _ in range(4):
            rows.append((n, " ".join(words(rng, rng.randint(0, 120)) + s + words(rng, rng.randint(0, 120)))))
            want[n], n = first, n + 1
    edited = words(rng, 160)
    first = n
    for k in range(4):
        text = list(edited)
        if k:
            text[40 * k] = "edit"
        rows.append((n, " ".join(words(rng, 30) + text + words(rng, 30))))
        want[n], n = first, n + 1
    line = words(rng, 20)
    for _ in range(60):
        rows.append((n, " ".join(words(rng, 70) + line + words(rng, 70))))
        want[n], n = n, n + 1
    for text in (None, "", "a b c", " ".join(line)):
        rows.append((n, text))
        want[n], n = n, n + 1
    rows.append((None, rows[0][1]))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, key int, c int").repartition(3)
    got = passages.passage_classes(docs).collect()
    assert {r.doc_id: r.class_id for r in got} == want | {None: None}
    assert all((r.n_links > 0) == (r.doc_id is not None and sum(v == want[r.doc_id] for v in want.values()) > 1) for r in got)


def test_large_groups_of_copies(spark):
    rng = np.random.RandomState(3)
    text = " ".join(words(rng, 300))
    docs = spark.createDataFrame([(i, text if i % 2 else " ".join(words(rng, 80))) for i in range(600)], "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.passage_classes(docs).collect()}
    assert all(got[i][0] == (1 if i % 2 else i) for i in got)


def test_empty(spark):
    assert passages.passage_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_windows_that_nothing_shares_are_all_leaders():
    fields = ("key", "doc", "c", "l", "r", "b0", "b1", "b2")
    for n in (0, 3):
        links, leads = passages._resolve({k: np.arange(n) for k in fields})
        assert len(links) == 0 and len(leads) == n


def similarity(a, b):
    x, y = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_agree_is_a_shingle_similarity_of_four_fifths():
    rng = np.random.RandomState(4)

    def around(text, c):
        (chunk,) = chunks(pa.array([" ".join(text)]))
        shingles, _, first, last = passages._shingles(chunk)
        return passages.codes(shingles, np.array([c]), first, last)

    for n, edits, kind in ((50, 1, "change"), (50, 2, "change"), (50, 1, "insert"), (52, 1, "change"), (49, 1, "delete"), (80, 1, "insert"), (60, 3, "insert"), (53, 1, "delete"), (90, 2, "insert")):
        text = words(rng, n)
        other, at = list(text), [n * (k + 1) // (edits + 1) for k in range(edits)]
        for k in reversed(at):
            other[k : k + (kind != "insert")] = [] if kind == "delete" else ["edit"]
        wide = similarity(text, other) >= 0.8 and min(len(text), len(other)) - 4 >= 46
        for c in range(0, at[0] - 4, 3):
            got = passages.agree(around(text, c), around(other, c))[0]
            assert got == wide or (got and n >= 80), (n, edits, kind, c)


def test_edited_passages_are_linked_whatever_the_partitions(spark):
    rng = np.random.RandomState(6)
    rows, groups = [], 0
    for n, step, kind in ((60, 30, "change"), (80, 40, "insert"), (80, 40, "delete"), (300, 42, "insert"), (2000, 42, "insert")) * 3:
        text = words(rng, n)
        other = []
        for k, w in enumerate(text):
            other += [w] if k == 0 or k % step else ["x", w] if kind == "insert" else ["x"] if kind == "change" else []
        for t in (text, other):
            rows.append((len(rows), " ".join(t)))
        assert similarity(text, other) >= 0.8
        groups += 1
    # a chain: neighbours overlap, the ends don't
    whole = words(rng, 400)
    chain = len(rows)
    for k in range(6):
        rows.append((len(rows), " ".join(whole[k * 50 : k * 50 + 150])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    classes = []
    for parts in (1, 7):
        got = {r.doc_id: r.class_id for r in passages.passage_classes(docs.repartition(parts)).collect()}
        assert sum(got[2 * g] == got[2 * g + 1] for g in range(groups)) >= groups - 1
        assert {got[i] for i in range(chain, len(rows))} == {chain}
        classes.append(got)
    assert classes[0] == classes[1]


def test_hot_hashes_dealt_by_anchor_give_the_same_classes(spark):
    rng = np.random.RandomState(7)
    shared, line = words(rng, 60), words(rng, 30)
    rows = []
    for k in range(40):
        text = list(shared)
        text[10 + k % 40] = "edit"
        rows.append((k, " ".join(words(rng, 40) + (text if k < 20 else line) + words(rng, 40))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    groups = []
    for hot in (2, passages.HOT):
        links = passages.window_links(docs, hot=hot)
        assert links.where("(key & 3) > 3 or (key & 3) < 0").isEmpty()
        roots = {r.id: r.root for r in passages.connected_components(passages.supported(links), "doc", "rep").collect()}
        groups.append(roots)
    assert groups[0] == groups[1] and {groups[0].get(k) for k in range(20)} == {0} and not any(k in groups[0] for k in range(20, 40))


def test_ends_of_repeats_suffice(spark):
    rng = np.random.RandomState(9)
    page = words(rng, 30)
    texts = [words(rng, 20) + page * 5 + words(rng, 20), words(rng, 33) + page * 4 + words(rng, 7), ["la"] * 90 + words(rng, 40), words(rng, 9) + ["la"] * 70, words(rng, 50) + ["la"] * 30 + words(rng, 50)]
    (chunk,) = chunks(pa.array([" ".join(t) for t in texts]))
    every, ends = passages.windows(chunk), passages.windows(chunk, ends=True)
    assert 0 < len(ends[0]) < len(every[0]) / 2
    assert {tuple(x) for x in zip(*ends)} <= {tuple(x) for x in zip(*every)}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in passages.passage_classes(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}


def test_every_shared_passage_of_a_table_is_found(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: (r.class_id, r.n_links) for r in passages.passage_classes(docs).collect()}
    first, shared = {}, 0
    for r in docs.collect():
        w = (r.text or "").encode().lower().split()
        for passage in {tuple(w[i : i + 50]) for i in range(len(w) - 49)}:
            other = first.setdefault(passage, r.doc_id)
            if other != r.doc_id:
                shared += 1
                assert got[other][0] == got[r.doc_id][0] and got[other][1] and got[r.doc_id][1]
    assert shared


def test_quick_answers_of_agree_are_those_of_the_alignment():
    rng = np.random.RandomState(11)
    from inkfold.llm import alignment

    base = rng.randint(1, 60, (400, 96)).astype(np.uint16)
    other = base.copy()
    for row in other:
        for _ in range(rng.randint(0, 9)):
            at = rng.randint(96)
            row[at : at + rng.randint(3, 9)] = 7
        if rng.rand() < 0.5:
            at = rng.randint(48, 96)
            row[at:] = np.roll(row[at:], rng.randint(-3, 4))
        row[96 - rng.randint(0, 30) :] = 0
    assert (alignment.agree(base, other) == alignment._aligned(base, other, 46)).all()
    assert 50 < alignment.agree(base, other).sum() < 350


def some_codes(rng, kind, n):
    """Rows of codes around one shingle that share a line of `kind` shingles, some of them more: passages, edited copies, a second line."""
    rows = rng.randint(1, 1 << 16, (n, 96)).astype(np.uint16)
    line, passage, second = (rng.randint(1, 1 << 16, k).astype(np.uint16) for k in (96, 96, 12))
    left = int(rng.randint(max(5, kind - 48), 20))
    for i in range(n):
        rows[i, 48 - left : 48 - left + kind] = line[:kind]
        what = rng.randint(0, 6)
        if what == 0:  # the line stands in a passage, which is there whole or in part, with an edit or two
            a, b = int(rng.randint(0, 30)), int(rng.randint(60, 97))
            rows[i, a:b] = passage[a:b]
            rows[i, 48 - left : 48 - left + kind] = line[:kind]
            for _ in range(rng.randint(0, 3)):
                k = int(rng.randint(0, 92))
                rows[i, k : k + 5] = rng.randint(1, 1 << 16, 5)
        elif what == 1:
            rows[i, 84:96] = second
        elif what == 2 and i:  # a copy of an earlier row, cut off or shifted by an insertion
            rows[i] = rows[int(rng.randint(0, i))]
            k = int(rng.randint(60, 90))
            if rng.rand() < 0.5:
                rows[i, k:] = 0
            else:
                rows[i, k + 1 :] = rows[i, k:-1].copy()
    return rows


def joined(n, links):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in zip(*(x.tolist() for x in links)):
        label[max(top(a), top(b))] = min(top(a), top(b))
    return [top(i) for i in range(n)]


@pytest.mark.parametrize("kind", [20, 30, 36, 60])
def test_cutting_entries_loses_no_link(kind, monkeypatch):
    rng = np.random.RandomState(kind)
    for n in (60, 200):
        code = some_codes(rng, kind, n)
        key = np.full(n, 5, np.int64)
        a, b = np.triu_indices(n, 1)
        yes = alignment.agree(code[a], code[b])
        want = joined(n, (b[yes], a[yes]))
        monkeypatch.setattr(alignment, "FEW", 10**9)
        whole = joined(n, alignment.match(key, code))
        for few in (1, 4, 16):
            monkeypatch.setattr(alignment, "FEW", few)
            got = joined(n, alignment.match(key, code))
            assert got == whole and len(set(want)) <= len(set(got)) <= len(set(want)) + 1


def test_a_line_in_very_many_texts_makes_few_comparisons(monkeypatch):
    rng = np.random.RandomState(8)
    compared = []
    agree = alignment.agree
    monkeypatch.setattr(alignment, "agree", lambda a, b, least: compared.append(len(a)) or agree(a, b, least))
    for n in (500, 2000):
        code = rng.randint(1, 1 << 16, (n, 96)).astype(np.uint16)
        code[:, 30:60] = np.arange(1, 31)
        code[n // 2 : n // 2 + 100, 20:85] = np.arange(1000, 1065)  # a hundred hold a longer passage
        code[n // 2 : n // 2 + 100, 30:60] = np.arange(1, 31)
        compared.clear()
        links = alignment.match(np.zeros(n, np.int64), code)
        assert sum(compared) < (alignment.FEW + 9) * n
        label = joined(n, links)
        assert [label[i] == n // 2 for i in range(n)] == [n // 2 <= i < n // 2 + 100 for i in range(n)]
