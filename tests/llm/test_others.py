"""op2 to op8 and op10 against plain definitions, and awkward rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from granary.llm import packing, rules, sharding, url_filter, warc
from granary.llm.decontaminate import drop_contaminated, find_items
from granary.llm.language_id import identify
from granary.llm.quality import score_quality
from granary.llm.registry import URL_RULES

BPE, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "/root/testdata/sf0.001"
TEXTS = ["", None, "a", "Hello  world\n\nfoo\n", " lead", "tab\tand\u00a0nbsp", "<|endoftext|> x", "don't we'll 123abc ###", "éa ñ ß", "one\ntwo three", "中文 text", "x\n y", "end "]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{DOCS}/documents.parquet")


def odd(spark):
    rows = [(i, t, "extra") for i, t in enumerate(TEXTS)] + [(None, "null id row with some words in it", "x"), (3, TEXTS[3], "again")]
    return spark.createDataFrame(rows, "doc_id long, text string, shard string")


@pytest.mark.parametrize("ranks", [RANKS, None])
def test_encoder_is_the_tokenizers(ranks):
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(BPE), packing.Encoder(BPE, ranks)
    for t in TEXTS:
        assert enc(t or "").tolist() == tk.encode(t or "", add_special_tokens=False).ids, t


def check_packed(rows, texts):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(BPE)
    windows, pieces = {}, {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append(r)
        pieces.setdefault(r.doc_id, []).append(r)
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in w])
        assert [r.offset for r in w] == [0, *ends[:-1]] and ends[-1] <= 2048 and (ends[-1] & (ends[-1] - 1)) == 0
    for i, t in texts.items():
        ids, at = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4"), 0
        for r in sorted(pieces.pop(i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert not pieces


def test_packing(spark, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    check_packed(packing.pack_documents(documents.repartition(3), BPE, RANKS).collect(), texts)
    few = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    check_packed(packing.pack_documents(few, BPE, RANKS).collect(), dict(enumerate(TEXTS)))
    assert packing.pack_documents(few.limit(0), BPE).count() == 0
    assert packing.pack_documents(odd(spark), BPE).where("doc_id is null").count() >= 1


def test_packer_open_windows_are_bounded():
    p, r, total, out = packing.Packer(64, 4), np.random.default_rng(2), 0, 0
    for i in range(500):
        n = int(r.integers(1, 150))
        total += n
        out += sum(x[2] for s in p.add(i, n) for x in s)
        assert len(p.open) <= 4
    assert out + sum(x[2] for s in p.close() for x in s) == total


def test_sharding(spark, documents):
    hot = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, "same " * 100) for i in range(150)], "doc_id long, text string"))
    got = sharding.shard_by_bytes(hot.repartition(5), 40).collect()
    size, slots = [0] * 40, {}
    for r in got:
        raw = r.text.encode()
        assert r["size"] == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and r.grown_shard is None
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(s - sum(size) / 40) for s in size) <= max(len(r.text.encode()) for r in got) + 16
    same = {r.shard for r in got if r.text == "same " * 100}
    assert same == set(range(min(same), max(same) + 1))  # a group lies together


def test_sharding_awkward(spark):
    got = sharding.shard_by_bytes(odd(spark), 3)
    assert got.count() == len(TEXTS) + 2 and "shard" in got.columns and dict(got.dtypes)["shard"] == "int"
    assert got.where("doc_id = 1").first()["size"] == 16
    assert sharding.shard_by_bytes(odd(spark).limit(0), 3).count() == 0
    assert {r.shard for r in sharding.shard_by_bytes(spark.createDataFrame([(1, "a")], "doc_id long, text string"), 40).collect()} <= set(range(40))


def test_sharding_splits_rows_that_are_alike(spark):
    rows = [(None, "equal text")] * 2000 + [(5, "another")] * 300 + [(i, f"text {i}") for i in range(100)]
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(6), 40).collect()
    size, slots = [0] * 40, {}
    for r in got:
        size[r.shard] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == len(rows) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(abs(s - sum(size) / 40) for s in size) <= 60
    sizes = sorted((str(r.doc_id), r.text) for r in got)
    assert sizes == sorted((str(i), t) for i, t in rows)


def test_warc(spark, tmp_path):
    big, other = "x\r\n\r\n" * 400 + "é", "y" * 999
    rows = [(1, "http://a/", big), (2, None, big), (9, "http://c/\r\nd", big), (3, "u", other), (4, "u", other), (5, "u", None), (6, "", "WARC/1.0\r\n\r\n")]
    df = spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, digest string")
    warc.write_archives(warc.plan_revisits(df, archive_bytes=2000), f"file://{tmp_path}/w")
    got = {r.page_id: r for r in warc.read_archives(spark, f"file://{tmp_path}/w").collect()}
    for i, _, html in rows:
        raw = (html or "").encode()
        again = raw == big.encode() and i != 9
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 9) if again else ("response", None))
    warc.write_archives(warc.plan_revisits(df.limit(0)), f"file://{tmp_path}/e")
    assert warc.read_archives(spark, f"file://{tmp_path}/e").count() == 0


def test_warc_hot_payload_and_awkward_ids(spark, tmp_path, monkeypatch):
    from granary.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)
    hot, pair = "h" * 1500, "p" * 1200
    rows = [(i, "u", hot) for i in range(40)] + [(100, "u", pair), (101, "u", pair), (None, "v", hot), (None, "w", hot), (200, "x", hot), (200, "x", hot)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(warc.plan_revisits(df), f"file://{tmp_path}/h")
    got = sorted(str((r.page_id, r.record_type, r.refers_to, r.payload_bytes)) for r in warc.read_archives(spark, f"file://{tmp_path}/h").collect())
    want = [(i, "revisit", 200, 1500) for i in range(40)] + [(100, "revisit", 101, 1200), (101, "response", None, 1200)] + [(x, "response", None, 1500) for x in (None, None, 200, 200)]
    assert got == sorted(map(str, want))


def test_decontamination(spark):
    items = [(1, " ".join(f"q{i}" for i in range(30))), (2, "short item"), (3, None), (4, ""), (5, " ".join(f"z{i}" for i in range(100)))]
    long = " ".join(f"n{i}" for i in range(3000))
    docs = [(1, long + " " + items[0][1].upper() + " " + long), (2, "short item"), (3, "a short item"), (4, long), (5, None), (6, " ".join(items[4][1].split()[:84])), (7, " ".join(items[4][1].split()[:70]))]
    d, i = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in find_items(d, i).collect()} == {(1, 1), (2, 2), (6, 5)}
    assert {r.doc_id for r in drop_contaminated(d, i).collect()} == {3, 4, 5, 7}
    assert find_items(d.limit(0), i).count() == 0 == find_items(d, i.limit(0)).count()


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_against_all_items(spark, documents, monkeypatch, broadcast):
    from granary.llm import decontaminate
    from tests.llm.test_minhash import shingle_set

    if not broadcast:
        monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 0)
    items = spark.read.parquet(f"{DOCS}/benchmark.parquet")
    sets = {r.item_id: shingle_set(r.text) for r in items.collect()}
    want = {(r.doc_id, i, len(s & x), len(s)) for r in documents.collect() for x in [shingle_set(r.text)] for i, s in sets.items() if s and 100 * len(s & x) >= 80 * len(s)}
    got = find_items(documents, items).collect()
    assert {(r.doc_id, r.item_id, r.n_common, r.n_item) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_tells_rows_apart_by_text(spark, monkeypatch, broadcast):
    from granary.llm import decontaminate

    if not broadcast:
        monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 0)
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, "before " + item), (1, "clean text of the same id"), (None, item + " after"), (None, "clean, no id"), (2, None), (2, "before " + item), (2, "before " + item)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(None, item), (9, item), (9, item)], "item_id long, text string")
    assert sorted(str((r.doc_id, r.item_id)) for r in find_items(d, i).collect()) == sorted(str((a, b)) for a in (1, 2, None) for b in (9, None))
    assert sorted(str(r.text) for r in drop_contaminated(d, i).collect()) == ["None", "clean text of the same id", "clean, no id"]


def test_decontamination_tells_crafted_words_apart(spark):
    from tests.llm.test_minhash import twin_words

    a, b = twin_words(2048)
    docs = spark.createDataFrame([(1, f"one two three four {a}"), (2, f"one two three four {b}")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"one two three four {a}")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in find_items(docs, items).collect()] == [(1, 7)]


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination_gives_two_texts_of_one_item_once(spark, monkeypatch, broadcast):
    from granary.llm import decontaminate

    if not broadcast:
        monkeypatch.setattr(decontaminate, "INDEX_SHINGLES", 0)
    one, two, longer = "a b c d e f", "u v w x y z", "k l m n o p q"
    docs = spark.createDataFrame([(1, f"{one} {two} {longer}"), (2, one)], "doc_id long, text string")
    items = spark.createDataFrame([(5, one), (5, two), (5, longer), (6, two)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.n_common, r.n_item) for r in find_items(docs, items).collect())
    assert got == [(1, 5, 2, 2), (1, 5, 3, 3), (1, 6, 2, 2), (2, 5, 2, 2)]


def base_stats(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(j for i in at for j in range(i, i + 5))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_rules(spark, documents):
    texts = TEXTS + ["same words go here now " * 30, "One two.\nOne two.\n\nOne two.", "Read the cookie policy.\nThis line is fine and it stays, because it says something at length."]
    df = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    want = {r.doc_id: base_stats(r.text) for r in df.collect()}
    for r in rules.line_first(df).collect():
        n, *_, repeats = want[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want[r.doc_id]
        assert r.base_failed == (n < 10 or 100 * repeats > 20 * n) and not (r.base_failed and r.kept)
    last = rules.line_first(df).where(f"doc_id = {10_000 + len(texts) - 1}").first()
    assert last.clean_text == texts[-1].split("\n")[1] and last.kept
    assert rules.line_first(odd(spark)).count() == len(TEXTS) + 2 and rules.line_first(odd(spark).limit(0)).count() == 0


def test_rules_repeats_are_settled_by_words(spark, documents):
    """With a hash that makes all windows alike the statistics are the same."""
    few = documents.where("length(text) < 3000").limit(60).select("doc_id", "text")
    odd_ones = spark.createDataFrame([(10_000, "a b c d e f g " * 9), (10_001, "a b c d e a b c d e a b c"), (10_002, "ab c d e f a bc d e f")], "doc_id long, text string")
    df = few.unionByName(odd_ones)
    alike = {r.doc_id: r.n_repeat_words for r in rules.line_first(df, hash_of="7 + 0 * length(concat({}))").collect()}
    assert alike == {r.doc_id: base_stats(r.text)[4] for r in df.collect()}


def test_rules_run_no_python(documents):
    plan = rules.line_first(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held)
    few = spark.createDataFrame([(1, None, "en"), (2, "12 --", "en"), (3, "plain words here", None), (None, "más palabras", "es")], "doc_id long, text string, lang string")
    assert {(r.doc_id, r.lang_pred) for r in identify(few).where("doc_id < 3").collect()} == {(1, "und"), (2, "und")}
    assert identify(few.limit(0)).count() == 0


def test_quality(spark):
    at = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    got = score_quality(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)
    few = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "words", 0), (3, "a b", 0)], "doc_id long, text string, vector int")
    assert score_quality(few, labels.limit(0)).count() == 4 and score_quality(few.limit(0), labels).count() == 0


def test_urls(spark):
    urls = ["http://a.example.com/en/725?x", "https://EXAMPLE.com/en/8", "http://b.net/de/1", "http://example.net/de/85#t", "http://x.org/es/", "http://x.org/es", "no scheme", None, "", "http://evilcom/en/", "http://h?p=/en/", "x://y://z/p"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule) for r in url_filter.filter_urls(df, URL_RULES).collect()}
    assert got[0] == ("a.example.com", "/en/725", "example.com/en/7") and got[1] == ("example.com", "/en/8", "com/en/")
    assert got[2] == ("b.net", "/de/1", "net/de/") and got[3] == ("example.net", "/de/85", "example.net/de/8")
    assert got[4][2] == "org/es/" and got[5] == ("x.org", "/es", None) and got[6] == got[7] == got[8] == ("", "", None)
    assert got[9] == ("evilcom", "/en/", None) and got[10] == ("h", "", None) and got[11] == ("y:", "//z/p", None)
    assert url_filter.filter_urls(df.limit(0), URL_RULES).count() == 0


def test_url_models_count_each_context_exactly(spark):
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    urls = [f"http://{host}/{lang}/" + "".join(r.choice(letters) for _ in range(30)) for _ in range(1500) for host, lang in (("a.com", "en"), ("b.net", "de"), ("c.edu", "fr"))] + [None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    learnt = df.where("url is not null and pmod(xxhash64(url), 5) <> 0").collect()
    counts = ({}, {})
    for u in (x.url for x in learnt if ".com/en/" in x.url or ".net/de/" in x.url):
        n, s = counts["com/en/" in u], [-1] * 5 + list(u.encode()) + [256]
        for i in range(5, len(s)):
            for k in range(6):
                for key in ((k, *s[i - k : i]), (k, *s[i - k : i], s[i])):
                    n[len(key) > k + 1, key] = n.get((len(key) > k + 1, key), 0) + 1
    assert len([1 for full, key in {*counts[0], *counts[1]} if full and key[0] == 5]) > 65536

    def score(u):
        s, out = [-1] * 5 + list((u or "").encode()) + [256], 0.0
        for i in range(5, len(s)):
            p = [1 / 257, 1 / 257]
            for k in range(6):
                for c in (0, 1):
                    p[c] = (counts[c].get((True, (k, *s[i - k : i], s[i])), 0) + 4 * p[c]) / (counts[c].get((False, (k, *s[i - k : i])), 0) + 4)
            out += math.log(p[1]) - math.log(p[0])
        return out / (len(s) - 5)

    got = {x.page_id: x.score for x in url_filter.filter_urls(df, URL_RULES).collect()}
    assert len(got) == len(urls)
    assert all(abs(got[i] - score(u)) < 1e-9 for i, u in enumerate(urls) if i % 7 == 0 or u is None)


def slot(gram):
    """The table slot of an n-gram, in plain integers."""
    h, m = 0, (1 << 64) - 1
    for c, seed in zip(gram, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), strict=False):
        h = (h + ord(c) * seed) & m
    h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
    h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
    return (h ^ h >> 31) >> 48


def brute_profiles(rows, top=400):
    """Plain out-of-place language identification."""
    from collections import Counter

    def order(counts):
        return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))][:top]

    def grams(text):
        words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
        s = " " + " ".join(words) + " " + " " * (bool(text) and not text[-1].isalpha())
        out = Counter(slot(c) for c in s if c != " ")
        out.update(slot(s[i : i + 2]) for i in range(len(s) - 1))
        out.update(slot(s[i : i + 3]) for i in range(len(s) - 2))
        return out if words else Counter()

    total = {}
    for _, text, lang, held in rows:
        if not held and lang and text:
            total.setdefault(lang, []).append(text)
    profiles = {lang: {g: i for i, g in enumerate(order(grams("\n".join(t))))} for lang, t in sorted(total.items())}
    out = {}
    for i, text, _, _ in rows:
        own = order(grams(text or ""))
        far = {lang: sum(min(abs(p[g] - k), top) if g in p else top for k, g in enumerate(own)) for lang, p in profiles.items()}
        out[i] = (min(far, key=far.get), 1 - min(far.values()) / (top * len(own))) if own and far else ("und", 0.0)
    return out


def test_language_against_plain_profiles(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text, r.lang, zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in docs.collect()]
    want, got = brute_profiles(rows), {r.doc_id: r for r in identify(docs).collect()}
    assert set(got) == set(want) and all(got[i].held_out == held for i, _, _, held in rows)
    assert all(got[i].lang_pred == lang and abs(got[i].score - score) < 0.003 for i, (lang, score) in want.items())


def test_language_portions_count_the_whole_text():
    from granary.llm import language_id as L

    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdé") for _ in range(r.randrange(1, 9))) + r.choice(("", ".", ", 12")) for _ in range(5000)) + "x" * 3000
    whole = np.concatenate(list(L.grams(text, 1 << 30)))
    for portion in (1, 7, 100, 4096):
        parts = np.concatenate(list(L.grams(text, portion)))
        assert (np.bincount(whole, minlength=1 << L.BITS) == np.bincount(parts, minlength=1 << L.BITS)).all()
    assert not list(L.grams("12 -- 34", 2)) and L.ranked("12").size == 0


def test_quality_against_plain_pooling(spark, documents):
    """Features of the operator's workers against sums over token lists."""
    from types import SimpleNamespace

    import pyarrow as pa

    from granary.llm import quality as Q

    texts = [r.text for r in documents.orderBy("doc_id").limit(40).collect()] + [None, "", "ONE two, three!"]
    column = pa.array(texts, pa.string())
    sums = np.zeros((1 << Q.BITS, Q.DIM))
    slots = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), dtype=np.uint8)
        word, shape, _ = Q.tokens(raw, np.array([0, len(raw)]))
        slots.append((word, shape))
        for i in range(len(word)):
            for j in range(max(0, i - Q.REACH), min(len(word), i + Q.REACH + 1)):
                if i != j:
                    for near in (word[j], shape[j]):
                        for k in range(Q.NONZERO):
                            for token in (word[i], shape[i]):
                                sums[token, Q._DIMS[near, k]] += Q._SIGNS[near, k]
    got = np.zeros_like(sums)
    for b in Q._contexts(iter([pa.RecordBatch.from_arrays([column], names=["text"])])):
        got[b.column(0).to_numpy()] += np.stack([b.column(1 + j).to_numpy() for j in range(Q.DIM)], axis=1)
    assert np.abs(got - sums).max() < 1e-9
    table = (sums / (np.linalg.norm(sums, axis=1, keepdims=True) + 1e-9)).astype(np.float32)
    n = len(texts)
    batch = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([False] * n), column, pa.array([0] * n)], names=["doc_id", "held_out", "text", "text_hash"])
    x = Q._matrix(next(Q._pool(SimpleNamespace(value=table))(iter([batch]))).column(2).to_pylist())
    for row, (word, shape) in zip(x, slots, strict=True):
        want = np.zeros(2 * Q.DIM)
        if len(word):
            want = np.concatenate((table[word].mean(axis=0), table[shape].mean(axis=0)))
        assert np.abs(row[: 2 * Q.DIM] - want).max() < 1e-4 and abs(row[-1] - np.log1p(len(word))) < 1e-5


def test_quality_network_against_plain_gradients():
    from granary.llm import quality as Q

    r = np.random.default_rng(5)
    x = r.normal(size=(600, Q.FEATURES))
    y = (x[:, 0] + 0.3 * r.normal(size=600) > 0).astype(float)
    net = Q.Network(x, y)
    assert ((net.score(x) > 0.5) == y).mean() > 0.9 and net.temperature > 0
    z = (x - net.mean) / net.scale
    h = np.maximum(z @ net.w[0] + net.w[1], 0)
    assert np.allclose(net.score(x), 1 / (1 + np.exp(-np.clip((h @ net.w[2] + net.w[3]) / net.temperature, -60, 60))))


def test_url_verdicts_against_the_calibrated_threshold(spark):
    """Verdicts without a rule follow from the scores and a threshold counted by hand."""
    pages = spark.read.parquet(f"{DOCS}/pages.parquet")
    rows = url_filter.filter_urls(pages, URL_RULES).collect()
    urls = {r.page_id: r.url for r in pages.collect()}
    hashed = {r.page_id: r.h for r in pages.selectExpr("page_id", "pmod(xxhash64(url), 5) h").collect()}
    bins = {}
    for r in rows:
        if r.rule and r.verdict == "allow" and hashed[r.page_id] == 0:
            bins[math.floor(r.score * url_filter.BINS)] = bins.get(math.floor(r.score * url_filter.BINS), 0) + 1
    limit, above = 0.0, 0
    for b in sorted(bins, reverse=True):
        above += bins[b]
        if above > url_filter.FALSE_BLOCKS * sum(bins.values()):
            limit = max(0.0, (b + 1) / url_filter.BINS)
            break
    order = {rule: verdict for rule, verdict in URL_RULES}
    assert len(rows) == len(urls)
    for r in rows:
        assert r.verdict == (order[r.rule] if r.rule else "block" if r.score > limit else "allow")


def test_long_texts_stay_within_bounds():
    """Workers hold little more than a text of 32 MB itself."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from granary.llm import decontaminate, language_id, minhash, quality

    r = random.Random(2)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(r.randrange(2, 10))) for _ in range(200_000))
    text = (text + ". ") * (32 * 2**20 // len(text))
    row = lambda *head: pa.RecordBatch.from_arrays([*(pa.array([h]) for h in head), pa.array([text])], names=[f"c{i}" for i in range(len(head) + 1)])
    index = decontaminate.Index([(1, np.arange(50, dtype=np.uint64))], 80)
    profiles = language_id.Profiles([("en", 5, 1)])
    table = np.zeros((1 << quality.BITS, quality.DIM), dtype=np.float32)
    scored = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([False]), pa.array([text]), pa.array([1])], names=["doc_id", "held_out", "text", "text_hash"])
    jobs = {
        "op1": (minhash._sign(5, 8), row(1, 2), 700),
        "op3 contexts": (quality._contexts, row(), 500),
        "op3": (quality._pool(SimpleNamespace(value=table)), scored, 500),
        "op6": (decontaminate._search(SimpleNamespace(value=index), 5), row(1, 2), 700),
        "op8": (language_id._predict(SimpleNamespace(value=profiles)), row(1, False), 300),
        "op8 profiles": (language_id._count, row("en"), 300),
    }
    for name, (job, batch, bound) in jobs.items():
        tracemalloc.start()
        assert sum(b.num_rows for b in job(iter([batch]))) >= 0
        peak = tracemalloc.get_traced_memory()[1] >> 20
        tracemalloc.stop()
        assert peak < bound, (name, peak)


def test_encoder_cuts_long_texts_where_the_tokenizer_does(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "PORTION", 200)
    r, tk, enc = random.Random(6), Tokenizer.from_file(BPE), packing.Encoder(BPE, RANKS)
    bits = ["word", "  ", " ", "\n", "\n\n", "don't", " 12", "é", "中文", "\t", "x.", " a b c ", "###", "<|endoftext|>"]
    for _ in range(30):
        t = "".join(r.choice(bits) for _ in range(900))
        assert enc(t).tolist() == tk.encode(t, add_special_tokens=False).ids
