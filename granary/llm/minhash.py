"""MinHash near-duplicate classes of documents.

One-permutation hashing with optimal densification gives each distinct shingle set a
signature of BINS values; keys of `rows` values each put it into buckets. Within a
bucket every member is a candidate of one centre only (a star), so candidates are linear in
the bucket. Candidates are confirmed on full shingle sets. Where a bucket's members are still
in different components, further rounds take 2, 8, 32 ... centres each, over the members
that were no centre yet, until nothing is left to compare: no pair that shares a bucket is
lost, and there is no cap. In these rounds two exact bounds spare the reading of the texts:

* shingles that no other document left over has can't be shared, which settles texts that only
  have a common passage without a comparison for each pair;
* a parity sketch of BITS bits, each the parity of the number of shingles that hash to it. The
  exclusive or of two sketches is that of the sets' symmetric difference, so its ones can't be
  more than the difference, and a pair with more ones than a link allows is none. This settles
  copies of one original that differ too much, in the join of a bucket's members with its
  centres itself, which hands on no pair that it rules out.

The nodes of the graph are distinct shingle sets, not ids: a row's set is its node, whatever
other rows have its id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BINS, ROWS, BITS = 288, 8, 4096
#: Members that are confirmed against one copy of a centre's text.
FAN = 1000
_WALK = np.argsort(np.random.default_rng(7).random((BINS, BINS)), axis=1).astype(np.uint16)
_BAND = np.random.default_rng(8).integers(1, 2**63, BINS, dtype=np.uint64)
_SIGNED = "doc_id long, th long, n_shingles long, h1 long, h2 long, bands array<long>"


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of a sorted shingle set; an empty bin takes the first filled one on its own random walk."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    out, full = np.zeros(BINS, dtype=np.uint64), np.zeros(BINS, dtype=bool)
    out[bins[first]], full[bins[first]] = s[first], True
    if not full.all():
        empty = np.flatnonzero(~full)
        walk = _WALK[empty]
        out[empty] = out[walk[np.arange(len(empty)), full[walk].argmax(axis=1)]]
    return out


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(documents, BINS // rows) keys of (documents, BINS) signatures."""
    bands = BINS // rows
    x = sig[:, : bands * rows].reshape(-1, bands, rows)
    out = np.broadcast_to(_BAND[:bands], x.shape[:2]).copy()
    for r in range(rows):
        out = C.mix(out ^ (x[:, :, r] * C._STEP[r]))
    return out


def _sign(width: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, off in C.slices(b.column(2)):
                sets = list(C.shingles(data, off, width))
                n = np.array([len(s) for s in sets], dtype=np.int64)
                h = np.array([[C.mix(s + np.uint64(k)).sum(dtype=np.uint64) for k in (1, 2)] for s in sets], dtype=np.uint64)
                some = np.flatnonzero(n)
                sigs = np.stack([signature(sets[i]) for i in some]) if len(some) else np.zeros((0, BINS), np.uint64)
                keys = band_keys(sigs, rows)
                ends = np.concatenate(([0], np.cumsum(np.where(n > 0, BINS // rows, 0))))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(sets)), b.column(1).slice(at, len(sets)), pa.array(n), C.long_array(h[:, 0]), C.long_array(h[:, 1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), C.long_array(keys.ravel()))],
                    names=["doc_id", "th", "n_shingles", "h1", "h2", "bands"],
                )

    return run


def _rows(width: int):
    """(node, shingle) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            for at, data, off in C.slices(b.column(1)):
                sets = list(C.shingles(data, off, width))
                n = [len(s) for s in sets]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + len(sets)], n)), C.long_array(np.concatenate(sets))], names=["node", "shingle"])

    return run


def _confirm(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for b in batches:
            keep = np.zeros(b.num_rows, dtype=bool)
            sets: list[np.ndarray] = []
            for _, data, off in C.slices(b.column(3)):
                sets += C.shingles(data, off, width)
            centre, text = b.column(0).to_pylist(), b.column(2)
            for i, s in enumerate(sets):
                if centre[i] != held or of is None:
                    held = centre[i]
                    of = next(x for _, data, off in C.slices(text.slice(i, 1)) for x in C.shingles(data, off, width))
                both = len(np.intersect1d(of, s, assume_unique=True))
                keep[i] = both > 0 and 100 * both >= percent * (len(of) + len(s) - both)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in (b.column(0), b.column(1))], names=["a", "b"])

    return run


def sketch(s: np.ndarray) -> np.ndarray:
    """BITS parities of a shingle set, as 64-bit words."""
    return np.packbits(np.bincount((s & np.uint64(BITS - 1)).astype(np.int64), minlength=BITS).astype(np.uint8) & 1).view(np.int64)


def _sketches(width: int):
    """(node, sketch) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(s) for _, data, off in C.slices(b.column(1)) for s in C.shingles(data, off, width)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.list_(pa.int64()))], names=["node", "sketch"])

    return run


def _may_link(percent: int) -> str:
    """SQL that is false where sketches (sketch, csketch) of sets of n and cn shingles rule a link out."""
    differ = " + ".join(f"bit_count(sketch[{i}] ^ csketch[{i}])" for i in range(BITS // 64))
    return f"{100 + percent} * ({differ}) <= {100 - percent} * (n + cn)"


def _links(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b) of the pairs (centre, node) that link; a centre of many members is copied, so that no task gets all of them."""
    texts = texts.hint("merge")  # one plan at every size
    fan = pairs.groupBy("centre").agg(F.ceil(F.count("*") / FAN).cast("int").alias("salts"))
    both = pairs.join(fan, "centre").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int"))
    both = both.join(texts.withColumnRenamed("text", "of_node"), "node")
    centres = texts.select(F.col("node").alias("centre"), F.col("text").alias("of_centre")).join(fan, "centre")
    centres = centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    both = both.join(centres, ["centre", "salt"])
    return both.select("centre", "node", "of_centre", "of_node").mapInArrow(_confirm(width, percent), "a long, b long")


def _rank_share() -> list[Column]:
    """The order of centres: first those that have least of their own, the likeliest to link with many."""
    return [(F.col("n") - F.col("a")) / F.col("n"), F.col("node")]


def _as_centres(members: DataFrame, *more: str) -> DataFrame:
    names = {"node": "centre", "n": "cn", "a": "ca", "comp": "ccomp", "sketch": "csketch", "bands": "cbands"}
    return members.select("key", *more, *[F.col(a).alias(b) for a, b in names.items()])


def _choose(members: DataFrame, scratch: C.Scratch, k: int) -> tuple[DataFrame, DataFrame]:
    """Centres of round k, and (members, centres) as one join of each bucket's members with its centres.

    A bucket takes its first 2 * 4 ** (k - 1) members. Of a hot one (C.hot_keys), no task gets
    all members: it takes its first member and about as many more by a hash, and its members are
    dealt over salts, to each of which its centres are copied.
    """
    want = 2 * 4 ** (k - 1)
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min_by("node", F.struct(*_rank_share())).alias("first"))
    sizes = scratch.store(sizes, f"sizes{k}", narrow=True)
    hot = C.hot_keys(sizes, members.count())
    cold = members
    if hot is not None:
        hot = hot.select("key", "first", F.col("n").alias("size"), F.ceil(F.col("n") / C.HOT_ROWS).cast("int").alias("salts"))
        cold = members.join(F.broadcast(hot.select("key")), "key", "left_anti")
        inside = members.join(F.broadcast(hot), "key")
        taken = inside.where((F.col("node") == F.col("first")) | (F.pmod(F.xxhash64("node", "key"), F.col("size")) < want))
        hot_centres = scratch.store(_as_centres(taken, "salts"), f"hot{k}", narrow=True)
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*_rank_share()))
    centres = scratch.store(_as_centres(cold.withColumn("rank", rank).where(F.col("rank") <= want)), f"centres{k}", narrow=True)
    both = cold.join(centres, "key")
    if hot is not None:
        dealt = inside.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).drop("first", "size", "salts")
        copies = hot_centres.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
        both = both.unionByName(dealt.join(copies, ["key", "salt"]).drop("salt"))
        centres = centres.unionByName(hot_centres.drop("salts"))
    return centres, both


def _open(members: DataFrame, scratch: C.Scratch, name: str) -> DataFrame:
    """Members of buckets that still hold several components."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    mixed = scratch.store(mixed.select("key", "n"), f"open-{name}", narrow=True)
    return C.join_hot(members, mixed, "key", members.count())


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, rows: int = ROWS) -> DataFrame:
    """Classes of documents whose shingle sets have 100 * intersection >= percent * union.

    rows: signature values a band key takes; fewer find pairs of a lower `percent`. A pair at
    the threshold p is missed with probability (1 - p ** rows) ** (BINS // rows).

    Returns doc_id, n_shingles, component_id (the smallest doc_id reachable over links), kept
    (doc_id = component_id) and text_hash (C.identity's), a row per row of `docs`.

    Null or empty text, or text without words: n_shingles 0, a component of its own. A null
    id: component_id null, kept true, linked with nothing. Rows that repeat an id are judged
    each by its own text: those with like texts fall into one component, those with unlike
    texts into several. Texts of any length are hashed a megabyte at a time. An empty table
    gives an empty table; other columns are not read and may have any names. Ties: centres are
    taken by id, and no choice of them changes the components.
    """
    spark: SparkSession = docs.sparkSession
    C.tune(spark)
    scratch = C.Scratch(spark, "minhash")
    _, th = C.identity(id_col, text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), th.alias("th"), F.col(text_col).cast("string").alias("text"))
    signed = scratch.store(docs.mapInArrow(_sign(width, rows), _SIGNED), "signed")
    some = signed.where("n_shingles > 0 and doc_id is not null")
    # exact copies of a set: one representative each
    sets = some.groupBy("h1", "h2", "n_shingles").agg(F.min(F.struct("doc_id", "th", "bands")).alias("r"))
    sets = scratch.store(sets.select("h1", "h2", F.col("n_shingles").alias("n"), "r.*"), "sets")
    # a set's node is the least id that has it, or a hash where that id has other sets too
    torn = scratch.store(sets.groupBy("doc_id").count().where("count > 1").select("doc_id"), "torn", narrow=True)
    is_torn = not torn.isEmpty()
    if is_torn:
        sets = sets.join(torn.withColumn("torn", F.lit(True)), "doc_id", "left")
        sets = sets.withColumn("node", F.when(F.col("torn"), F.xxhash64("doc_id", "h1", "h2")).otherwise(F.col("doc_id"))).drop("torn")
    else:
        sets = sets.withColumn("node", F.col("doc_id"))
    members = sets.select("node", "n", F.explode("bands").alias("key"))
    first = members.groupBy("key").agg(F.min("node").alias("centre"), F.min_by("n", "node").alias("cn"), F.count("*").alias("size"))
    centres = scratch.store(first.where("size > 1").withColumnRenamed("size", "n"), "centres0", narrow=True)
    members = scratch.store(C.join_hot(members, centres, "key", centres.agg(F.sum("n")).first()[0] or 0).withColumns({"comp": F.col("node"), "ccomp": F.col("centre")}), "live", narrow=True)
    # texts of all that shares a bucket; nothing else is read again
    wanted = sets.select("doc_id", "th", "node").join(members.select("node").distinct(), "node", "left_semi")
    wanted = scratch.store(wanted, "wanted", narrow=True).hint("merge")
    texts = docs.where("doc_id is not null and text is not null").join(wanted, ["doc_id", "th"]).select("node", "text")
    texts = scratch.store(texts.dropDuplicates(["node"]), "texts")
    confirmed = tested = roots = None
    k = 0
    while True:
        near = f"100 * least(a, ca) >= {percent} * (n + cn - least(a, ca))" if k else f"100 * least(n, cn) >= {percent} * greatest(n, cn)"
        # a pair comes from the least bucket that it shares, where it is tested or was ruled out
        once = f" and {_may_link(percent)} and key = array_min(array_intersect(bands, cbands))" if k else ""
        pairs = (both if k else members).where(f"comp <> ccomp and {near}{once}")
        ends = [F.least("centre", "node").alias("centre"), F.greatest("centre", "node").alias("node")]
        pairs = pairs.select(*ends).distinct()
        if k:
            pairs = pairs.join(tested, ["centre", "node"], "left_anti")
        pairs = scratch.store(pairs, f"pairs{k}", narrow=True)
        tested = pairs if tested is None else tested.union(pairs)
        linked = False
        if not pairs.isEmpty():
            links = scratch.store(_links(pairs, texts, width, percent), f"links{k}", narrow=True)
            linked = not links.isEmpty()
            if linked:
                confirmed = links if confirmed is None else confirmed.union(links)
                roots = C.components(confirmed, scratch, f"round{k}")
        # what is left: members that were no centre yet, in buckets that still hold several components
        if k:
            members = members.join(centres.select("key", F.col("centre").alias("node")), ["key", "node"], "left_anti")
        else:
            members = members.where("node <> centre").drop("centre", "cn", "ccomp")
        if linked:
            members = members.drop("comp").join(roots, "node", "left").withColumn("comp", F.coalesce("root", "node")).drop("root")
        k += 1
        members = scratch.store(members, f"mixed{k}", narrow=True)
        members = scratch.store(_open(members, scratch, f"{k}"), f"members{k}", narrow=True)
        if members.isEmpty():
            break
        if k == 1:
            left = texts.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(_rows(width), "node long, shingle long")
            owners = left.groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other")).where("node = other")
            own = owners.groupBy("node").agg(F.count("*").alias("own"))
            # a: shingles that another document left over may share
            members = members.join(own, "node", "left").withColumn("a", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
            members = scratch.store(members.where(f"100 * a >= {percent} * n"), "shared", narrow=True)
            open_ = members.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("n").alias("least"), F.count("*").alias("n")).where("lo < hi").select("key", "least", "n")
            members = C.join_hot(members, scratch.store(open_, "open-shared", narrow=True), "key", members.count()).where(f"100 * a >= {percent} * (n + greatest(least, a) - a)").drop("least").join(sets.select("node", "bands"), "node")
            sketched = texts.join(members.select("node").distinct(), "node", "left_semi").mapInArrow(_sketches(width), "node long, sketch array<long>")
            members = members.join(scratch.store(sketched, "sketches", narrow=True), "node")
            members = scratch.store(members, "members", narrow=True)
            if members.isEmpty():
                break
        centres, both = _choose(members, scratch, k)
    names = sets.select("h1", "h2", F.col("n").alias("n_shingles"), "node", F.col("doc_id").alias("rep"))
    if roots is not None:
        if is_torn:  # a component's name is its least id, not its least node
            roots = roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
            least = roots.join(names, "node").groupBy("root").agg(F.min("rep").alias("least"))
            roots = roots.join(least, "root").select("node", F.col("least").alias("root"))
        names = names.join(roots, "node", "left").withColumn("rep", F.coalesce("root", "rep"))
    out = signed.select("doc_id", "th", "n_shingles", "h1", "h2").join(names.select("h1", "h2", "n_shingles", "rep"), ["h1", "h2", "n_shingles"], "left")
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"), F.col("th").alias("text_hash"))
