"""The pipeline's stages on the smallest documents, against plain definitions of what each must do."""

import zlib
from collections import Counter

import corpus_pipeline
from tests.llm.test_minhash import brute, shingle_set
from tests.llm.test_others import check_packed
from tests.llm.test_substrings import brute as cut

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"file://{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"file://{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == columns and docs.dtypes == before.dtypes
        seen[name] = ({r.doc_id: r for r in before.collect()}, docs)
    assert list(seen) == ["quality", "near_dedup", "passages", "decontamination", "packing"]

    before, after = seen["near_dedup"]
    roots = brute([(i, r.text) for i, r in before.items()], 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, root) in roots.items() if i == root}

    before, after = seen["passages"]
    left = cut([(i, r.text) for i, r in before.items()])
    for r in after.collect():
        if not left[r.doc_id][1]:
            assert r.text == before[r.doc_id].text
        assert r.n_chars == len(r.text) and abs(len(r.text.encode()) - (left[r.doc_id][0] - left[r.doc_id][1])) <= 6 * left[r.doc_id][2]

    before, after = seen["decontamination"]
    items = [shingle_set(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, r in before.items() for x in [shingle_set(r.text)] if not any(100 * len(s & x) >= 80 * len(s) for s in items)}
    assert {r.doc_id for r in after.collect()} == clean

    before, after = seen["packing"]
    check_packed(after.collect(), {i: r.text for i, r in before.items()})


def test_near_dedup_stage_takes_pairs_from_80_percent(spark):
    texts = []
    for group in range(40):
        base = [f"g{group}w{i}" for i in range(100)]
        cut = 4 + group % 12  # similarities from 0.73 to 0.92
        texts += [" ".join(base), " ".join(base[: 100 - cut] + [f"g{group}n{i}" for i in range(cut)])]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    want = {i for i, (_, root) in brute(list(enumerate(texts)), 80).items() if i == root}
    assert len(want) < len({i for i, (_, root) in brute(list(enumerate(texts))).items() if i == root}) < len(texts)
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == want


def test_quality_stage_keeps_marked_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [i for i in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(i in kept for i in held if labels[i] == 1)
    assert len([i for i in held if labels[i] == 0 and i in kept]) <= 0.3 * len([i for i in held if labels[i] == 0])


def test_awkward_rows_pass_all_stages(spark):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "a text without an id, long enough to be tokenized", "en", None, 40), (3, "x", "en", "s", 1), (3, "x", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        n = stage(spark, docs, SF).count()
        assert n == 5 or name == "quality" or name == "packing" and n >= 5, name  # leftovers may be cut
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_stages_tell_rows_apart_by_text(spark):
    """Rows that repeat an id, or have none: no stage loses a text that it does not reject."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    prose = lambda k, n=80: " ".join(f"{k}{i}" for i in range(n))
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    texts = lambda df: sorted(r.text for r in df.collect())

    docs = [(1, prose("a")), (5, prose("a")), (5, prose("unlike")), (None, prose("a")), (None, prose("b"))]
    assert texts(corpus_pipeline.near_dedup(spark, frame(docs), SF)) == sorted([prose("a"), prose("unlike"), prose("a"), prose("b")])

    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 200").first().text
    docs = [(1, "before " + item + " after"), (1, prose("c")), (None, item), (None, prose("d"))]
    assert texts(corpus_pipeline.decontamination(spark, frame(docs), SF)) == [prose("c"), prose("d")]

    passage = prose("passage", 40)
    docs = [(1, passage), (4, "x " + passage), (4, prose("own")), (None, prose("e")), (None, prose("f")), (4, "x " + passage)]
    assert texts(corpus_pipeline.passages(spark, frame(docs), SF)) == sorted([passage, "x ", "x ", prose("own"), prose("e"), prose("f")])

    # judged by their texts alone: copies under an id that repeats and under none fare like the plain rows
    plain = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows = plain + [(i % 2 or None, t) for i, (_, t) in enumerate(plain)]
    kept = corpus_pipeline.quality(spark, frame([(i, t or "") for i, t in rows]), SF)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    given, left = Counter(t or "" for _, t in rows), Counter(r.text for r in kept.collect())
    assert 0 < len(left) < len(given) and all(n == given[t] for t, n in left.items())


def test_run_leaves_only_its_result(spark, tmp_path):
    from granary.llm import common as C

    mark = len(C.Scratch.live)
    out = corpus_pipeline.run(spark, SF)
    assert out.count() >= 100 and len(C.Scratch.live) == mark + 1
    C.Scratch.release(mark)
