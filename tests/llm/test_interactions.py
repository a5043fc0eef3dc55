"""op11 against plain definitions, and awkward rows."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from granary.llm import filter_audit as A

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_failures(rows):
    """(id, language, failed letters) of (id, language, text) rows, each rule as it is worded."""
    out = []
    for i, lang, text in rows:
        text = text or ""
        words = WORD.findall(text)
        fails = ""
        if len(words) < 100:
            fails += "A"
        if 100 * len(set(words)) < 80 * len(words):
            fails += "B"
        if 100 * len(re.findall("[A-Z]", text)) > 10 * len(text):
            fails += "C"
        if re.search("[#$%&*|]", text):
            fails += "D"
        if i is not None and any(j is not None and j < i and (t or "") == text for j, _, t in rows):
            fails += "E"
        out.append((i, lang or "", fails))
    return out


def plain_interactions(rows, good, toxic):
    marked, out, shapley = plain_failures(rows), {}, Counter()
    for part in {p for _, p, _ in marked}:
        own = [x for x in marked if x[1] == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[2]]
                left = [x for x in left if f not in x[2]]
                redundant = [x for x in own if f in x[2] and x not in gone]
                count = lambda xs, ids: sum(x[0] in ids for x in xs)
                out[part, order, step] = [len(left), len(gone), sum(f in x[2] for x in own) - len(gone), sum(x[2] == f for x in own), count(gone, good), count(gone, toxic)]
                shapley[part, f] += len(gone)
                assert redundant is not None
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def rows_of(seed=3, n=80):
    rng = random.Random(seed)
    some = [" ".join(rng.choice(["alpha", "Beta", "GAMMA", "d#", "é", f"w{rng.random()}"]) for _ in range(k)) for k in (0, 3, 99, 100, 101, 150, 400)]
    unlike = [" ".join(f"w{i}x{k}" for i in range(120)) for k in range(4)]
    rows = [(i, rng.choice(["en", "de", None, ""]), rng.choice([*some, *unlike, None, " ", "A" * 30])) for i in range(n)]
    return [*rows, (None, "en", unlike[0]), (None, None, None), (5, rows[5][1], rows[5][2]), (5, "fr", rows[5][2]), (7, "en", "another text of id 7")]


@pytest.mark.parametrize("held", [A.HELD_BYTES, 0])
def test_interactions(spark, held, monkeypatch):
    rows = rows_of()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(0, 60)] + [(4, 0, 1), (None, 1, 1), (7, None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, lang string, text string, part string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in A.interactions(docs, marks).collect()}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    assert got == plain_interactions(rows, good, toxic)
    assert A.interactions(docs.limit(0), marks).count() == 0
    repeated = Counter({r.doc_id: r.n for r in A.repeated_ids(docs).collect()})
    assert repeated == Counter(i for i, _, f in plain_failures(rows) if "E" in f)


def test_chains_tell_texts_of_one_hash_apart_and_hold_little():
    chains, settled = A.Chains(), []
    for i in (5, 3, 9, 3):
        settled += chains.add(1, b"same", i, {"en": 1}, 0)
    settled += chains.add(1, b"other", 1, {"en": 1}, 0)
    assert sorted(x[0] for x in settled) == [5, 9]
    assert sorted((x[1], x[2], x[3]["en"]) for x in chains.links()) == [(b"other", 1, 1), (b"same", 3, 2)]
    assert chains.held == 0 and not chains.by_hash


def test_copies_settled_in_map_tasks_leave_one_text(spark):
    rows = [(i, "en", "one text of all") for i in range(500)]
    sent = list(A._first_pass(iter(rows)))
    assert sum(x[1][0] == "open" for x in sent) == 1 and len(sent) == 500


def test_small_held_text_changes_nothing(spark, monkeypatch):
    rows = rows_of(9, 60)
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1)
    found = list(A._first_pass(iter(rows)))
    monkeypatch.setattr(A, "HELD_BYTES", 0)
    parts = list(A._first_pass(iter(rows)))
    assert len(parts) >= len(found)
    settle = lambda xs: Counter(x[:3] for y in A._settle(iter(xs)) for x in [y] * y[3])
    assert settle(found) == settle(parts) == Counter((i, lang, sum(1 << "ABCDE".index(f) for f in fails)) for i, lang, fails in plain_failures(rows))
    assert docs.count() == len(rows)


def test_long_text_goes_in_portions():
    text = "word " * 2_000_000 + "LAST#"
    data = text.encode()
    assert sum(map(len, A._words(data))) == 2_000_001
    assert max(map(len, A._words(data))) < 300_000
    assert A.failures(text, data) == 0b1010
    gapless = ("x" * 5_000_000).encode()
    assert [len(w) for w in A._words(gapless)] == [1]
