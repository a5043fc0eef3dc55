"""op1: classes against all pairs, and awkward rows."""

import random
import re

import numpy as np
import pytest

from granary.llm import common as C
from granary.llm.minhash import near_duplicates

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs, percent=85):
    sets = {i: shingle_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed=5, n=60):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    docs = []
    for i in range(n):
        base = [r.choice(words) for _ in range(r.choice((1, 3, 5, 12, 60, 200)))]
        docs.append(" ".join(base))
        for _ in range(r.choice((0, 0, 1, 4))):  # chains of small edits
            base = list(base)
            for _ in range(max(1, len(base) // 80)):
                base[r.randrange(len(base))] = r.choice(words).upper()
            docs.append("\n".join(" ".join(base[k : k + 9]) for k in range(0, len(base), 9)))
    return list(enumerate(docs + ["", "   ", docs[0], docs[5]]))


def test_against_all_pairs(spark):
    docs = corpus()
    got = {r.doc_id: r for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, (n, root) in brute(docs).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, root, i == root)


def test_common_passage_and_copies(spark):
    passage = " ".join(f"p{i}" for i in range(120))
    docs = [(i, passage + " " + " ".join(f"d{i}x{k}" for k in range(90 + i % 7))) for i in range(80)]
    docs += [(100 + i, docs[3][1]) for i in range(50)] + [(200 + i, docs[7][1] + f" end{i}") for i in range(40)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: root for i, (_, root) in brute(docs).items()}


def test_awkward_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b c d e f", "y"), (3, "a b c d e f", None), (3, "a b c d e f", None), (4, "A b c D e f", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, rep string")  # a clashing extra column
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (None, 2, None, True), (3, 2, 3, True), (3, 2, 3, True), (4, 2, 3, False)], key=str)
    assert near_duplicates(df.limit(0)).count() == 0


def test_components_of_a_path(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(50, 49), (50, 50), (49, 50)]
    got = {(r.node, r.root) for r in C.components(spark.createDataFrame(edges, "a long, b long"), C.Scratch(spark, "test")).collect()}
    assert got == {(i, 1) for i in range(2, 41)} | {(50, 49)}


def test_hashing_is_by_content():
    texts = ["one two", "  one\ttwo ", "x one two"]
    data = np.frombuffer("".join(texts).encode(), dtype=np.uint8)
    off = np.cumsum([0, *map(len, texts)])
    starts, ends, first = C.words(data, off)
    h = C.span_hash(*C.prefix_sums(data, True), starts, ends)
    assert h[0] == h[2] == h[5] and h[1] == h[3] == h[6] and first.tolist() == [0, 2, 4, 7]


@pytest.mark.parametrize("hot_rows", [C.HOT_ROWS, 4])
def test_star_of_distant_copies(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(C, "HOT_ROWS", hot_rows)
    r = random.Random(9)
    base = [f"b{i}" for i in range(150)]
    docs = [(0, " ".join(base))]
    for i in range(1, 90):  # most are near the original, some are not, all are far from each other
        w = list(base)
        for j in range(r.choice((1, 3, 4, 5))):
            w[r.randrange(150)] = f"x{i}y{j}"
        docs.append((i, " ".join(w)))
    docs += [(200 + i, docs[i][1] + " tail") for i in range(1, 90, 9)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: root for i, (_, root) in brute(docs).items()}


def test_an_id_with_several_texts(spark):
    texts = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "ABC"}
    rows = [(1, texts["A"]), (1, texts["B"]), (2, texts["A"] + " t2"), (3, texts["B"] + " t3"), (3, texts["C"]), (4, texts["C"]), (None, texts["C"]), (None, texts["A"])]
    got = sorted((str(r.doc_id), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = [("1", 56, 1, True), ("1", 56, 1, True), ("2", 57, 1, False), ("3", 57, 1, False), ("3", 56, 3, True), ("4", 56, 3, False), ("None", 56, None, True), ("None", 56, None, True)]
    assert got == sorted(want)


def test_hot_centre_is_salted(spark, monkeypatch):
    from granary.llm import minhash

    monkeypatch.setattr(minhash, "FAN", 7)
    base = [f"b{i}" for i in range(150)]
    docs = [(0, " ".join(base))] + [(i, " ".join([*base, f"end{i}"])) for i in range(1, 60)]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == dict.fromkeys(range(60), 0)


def test_long_texts_are_hashed_in_portions():
    import tracemalloc

    r = random.Random(4)
    text = " ".join(r.choice(("alpha", "Beta", "gamma")) + str(r.randrange(10**6)) for _ in range(260_000)) + "x" * 2_500_000 + " end of it all"
    data, off = np.frombuffer(text.encode(), dtype=np.uint8), np.array([0, len(text)])
    starts, ends, _ = C.words(data, off)
    want = C.word_hashes(data, starts, ends)
    for limit in (C.SLICE_BYTES, 1000):
        assert (C._long_word_hashes(data, limit) == want).all()
    long = np.frombuffer((text * 6).encode(), dtype=np.uint8)
    tracemalloc.start()
    assert len(next(C.shingles(long, np.array([0, len(long)])))) > 200_000
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


def test_sketches_never_rule_out_a_link():
    from granary.llm.minhash import BITS, sketch

    r = np.random.default_rng(3)
    for n in (1, 5, 80, 900, 20_000):
        x = r.integers(0, 2**63, n, dtype=np.uint64)
        for edits in (0, 1, n // 10, n // 3):
            y = np.concatenate((x[edits:], r.integers(0, 2**63, edits, dtype=np.uint64)))
            ones = sum(int(a ^ b).bit_count() for a, b in zip(sketch(x).view(np.uint64).tolist(), sketch(y).view(np.uint64).tolist(), strict=True))
            true = len(np.setxor1d(x, y))
            assert ones <= true and (true > BITS // 40 or ones >= 0.9 * true - 2)


def twin_words(n):
    """Two unlike words of n characters with equal sums of powers modulo 2**64."""
    bits = [int(i).bit_count() & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 512, 1024, 2048, 4096, 16384])
def test_crafted_words_differ(n):
    sets = []
    for w in twin_words(n):
        data = np.frombuffer(f"one two three four {w}".encode(), dtype=np.uint8)
        sets.append(next(C.shingles(data, np.array([0, len(data)]))).tolist())
    assert sets[0] != sets[1]
    assert len(set(twin_words(n)[0])) == 2 and len(twin_words(n)[0]) == n


def test_crafted_words_do_not_link(spark):
    a, b = twin_words(2048)
    rows = [(1, f"one two three four {a}"), (2, f"one two three four {b}"), (3, f"One two three four {a.upper()}")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_hot_buckets_are_dealt_over_salts(spark, monkeypatch):
    """A hot bucket's members meet all centres that it takes, once each."""
    from granary.llm import minhash

    monkeypatch.setattr(C, "HOT_ROWS", 20)
    rows = [(key, i, 100, i, 90, [i], [key]) for key, n in ((1, 300), (2, 15), (3, 21)) for i in range(n)]
    scratch = C.Scratch(spark, "test")
    members = scratch.store(spark.createDataFrame(rows, "key long, node long, n long, comp long, a long, sketch array<long>, bands array<long>"), "members")
    for k in (1, 3):
        centres, both = minhash._choose(members, scratch, k)
        of = {}
        for c in centres.collect():
            of.setdefault(c["key"], set()).add(c["centre"])
        want = 2 * 4 ** (k - 1)
        assert len(of[2]) == min(want, 15) and 1 <= len(of[3]) <= 21 and 1 <= len(of[1]) <= 3 * want + 10
        assert all(0 in of[key] for key in of)
        pairs = [(r["key"], r["centre"], r["node"]) for r in both.collect()]
        assert sorted(pairs) == sorted((key, c, i) for key, n in ((1, 300), (2, 15), (3, 21)) for c in of[key] for i in range(n))
