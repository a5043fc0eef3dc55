"""op9: removal against a set of all windows; the sorter against sorted()."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from granary.llm.anchors import LENGTH, anchors
from granary.llm import common as C
from granary.llm import substring_dedup as D
from granary.llm.deep_shallow import sort_strings
from granary.llm.substring_dedup import remove_repeats


def brute(docs):
    seen, out = {}, {}
    for i, text in sorted(docs):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - 99):
            w = raw[p : p + 100]
            if w in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.setdefault(w, (i, p))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and not (p and gone[p - 1]))
        out[i] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df).collect()}


def corpus(seed=3):
    r = random.Random(seed)
    words = ["der", "wörter", "the", "of", "a", "éléphant", "zz"] + [f"w{i}" for i in range(60)]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    passages = [prose(k) for k in (15, 30, 60, 200)]
    docs = []
    for i in range(120):
        parts = [prose(r.randrange(1, 60)) for _ in range(r.randrange(1, 4))]
        for _ in range(r.choice((0, 1, 1, 2))):
            parts.insert(r.randrange(len(parts) + 1), r.choice(passages))
        docs.append((i * 7 % 131, r.choice((" ", "\n", "")).join(parts)))
    docs += [(500 + i, docs[3][1]) for i in range(30)]
    docs += [(600, "ab" * 400), (601, "ab" * 90 + "c" + "ab" * 90), (602, "x" * 99), (603, "x" * 100), (604, "x" * 101), (605, ""), (606, None), (-5, docs[9][1])]
    return docs


def test_against_all_windows(spark):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert rows(df) == brute(docs)


def test_awkward_rows(spark):
    text = " ".join(f"word{i}" for i in range(60))
    df = spark.createDataFrame([(1, text, 0), (1, text, 1), (2, text, 2), (None, None, 3)], "doc_id long, text string, runs int")
    got = sorted(((r.doc_id, r.n_removed) for r in remove_repeats(df).collect()), key=str)
    assert got == sorted([(1, 0), (1, 0), (2, len(text)), (None, 0)], key=str)
    assert remove_repeats(df.limit(0)).count() == 0


def test_equal_windows_have_equal_anchors():
    r = np.random.default_rng(1)
    shared = r.integers(97, 101, 400, dtype=np.uint8)
    data = np.concatenate((r.integers(97, 101, 333, dtype=np.uint8), shared, r.integers(97, 101, 77, dtype=np.uint8), shared))
    doc, lo, hi, at, key = anchors(data, np.array([0, 733, len(data)]))
    of = {}
    for d, a, b, c, k in zip(doc, lo, hi, at, key, strict=True):
        for p in range(a, b + 1):
            of[d, p] = (k, c - p)
    assert len(of) == (733 - LENGTH + 1) + (477 - LENGTH + 1)
    assert all(of[0, 333 + p] == of[1, 77 + p] for p in range(400 - LENGTH + 1))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32), st.integers(0, 300), st.sampled_from([7, 32, 40, 100]), st.integers(1, 4))
def test_sorter(seed, n, length, letters):
    r = np.random.default_rng(seed)
    base = r.integers(97, 97 + letters, (max(1, n // 5), length), dtype=np.uint8)
    m = base[r.integers(0, len(base), n)]
    if n:
        m[r.integers(0, n, n // 4), r.integers(0, length, n // 4)] = 96
    order, lcp = sort_strings(m)
    got = [bytes(m[i]) for i in order]
    assert got == sorted(map(bytes, m)) and sorted(order) == list(range(n))
    for i in range(1, n):
        assert lcp[i] == next((k for k in range(length) if got[i][k] != got[i - 1][k]), length)


@pytest.mark.parametrize("crowd", [1, 4])
def test_crowded_cores_go_through_pieces_and_single_windows(spark, monkeypatch, crowd):
    monkeypatch.setattr(D, "CROWD", crowd)
    docs = corpus(4)
    assert rows(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)) == brute(docs)


def test_no_hash_settles_a_repeat(spark, monkeypatch):
    """With the filter off (every anchor kept, by one key for all) the result is the same."""
    from granary.llm import anchors as A

    real = A.anchors
    monkeypatch.setattr(D, "anchors", lambda *a: (*real(*a)[:4], np.zeros(len(real(*a)[0]), np.uint64)))
    text = D._anchors(iter([pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([5, 6]), pa.array([t for _, t in corpus()[:2]])], names=["doc_id", "th", "text"])]))
    kinds = [k for b in text for k in b.column(0).to_pylist()]
    assert kinds.count(D.OPEN) == len(kinds) - 1  # all are kept
    docs = corpus(5)[:60]
    contexts = D._Collapse()
    for i, t in sorted(docs):
        raw = (t or "").encode()
        for _, lo, hi, at, _ in zip(*real(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), strict=True):
            contexts.add(i, 0, int(lo), int(hi - lo + 1), int(at - lo), raw[lo : hi + LENGTH])
    batches = [b for b in contexts.out(True)]
    ask = [b.select(["doc_id", "th", "first", "n", "at", "bytes"]) for b in batches if b.column(0)[0].as_py() == D.ASK]
    order = pa.Table.from_batches(ask).to_pylist()
    order.sort(key=lambda r: r["bytes"][r["at"] : r["at"] + 32])
    gone = {(r["doc_id"], r["first"] + k) for b in batches if b.column(0)[0].as_py() == D.COVERED for r in b.to_pylist() for k in range(r["n"])}
    for b in D._ranges(68, 32)(iter(pa.Table.from_pylist(order, schema=ask[0].schema).to_batches(max_chunksize=50))):
        gone |= {(r["doc_id"], r["first"] + k) for r in b.to_pylist() for k in range(r["n"])}
    seen, want = set(), set()
    for i, t in sorted(docs):
        raw = (t or "").encode()
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                want.add((i, p))
            seen.add(raw[p : p + 100])
    assert gone == want


def test_an_id_with_several_texts(spark):
    p = " ".join(f"passage{i}" for i in range(30))
    docs = [(0, p), (None, "short " + p + " tail"), (None, "second " + p + " tail two"), (7, p + " seven"), (7, "other text of seven, " + p), (7, "short")]
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), with_row=True).collect()
    assert len(got) == len(docs)
    null = [r for r in got if r.doc_id is None]
    assert sorted(r.n_removed > 0 for r in null) == [False, True]  # null ids sort first, one of them keeps the passage
    assert all(r.n_removed >= len(p) for r in got if r.doc_id is not None and r.row.text != "short")
    for r in got:
        assert r.n_bytes == len(r.row.text) and r.n_removed == r.n_bytes - len(r.kept_text)
        assert r.kept_text in (r.row.text, r.row.text.replace(p, ""), r.row.text.replace(p + " ", ""), r.row.text.replace(" " + p, ""), r.row.text.replace(" " + p + " ", ""), r.row.text.replace(" " + p + " tail", "")), r


def test_very_long_texts(spark, monkeypatch):
    """A text longer than a portion is searched as a whole, in bounded memory."""
    monkeypatch.setattr(C, "SLICE_BYTES", 1 << 20)
    r = np.random.default_rng(8)
    long = r.integers(97, 123, 3_300_000, dtype=np.uint8).tobytes().decode()
    cut = (1 << 20) - 37
    docs = [(1, long), (2, "x" * 30 + long[cut : cut + 500] + "y" * 40), (3, long[-150:] + long[:120])]
    got = {x.doc_id: x.n_removed for x in remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 500, 3: 270}


def test_memory_of_a_long_text():
    import tracemalloc

    text = np.random.default_rng(8).integers(97, 123, 32 << 20, dtype=np.uint8).tobytes().decode()
    b = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], names=["doc_id", "th", "text"])
    tracemalloc.start()
    for _ in D._anchors(iter([b])):
        pass
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
