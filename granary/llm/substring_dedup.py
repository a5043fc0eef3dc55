"""Removal of byte strings that occurred before, by sorting suffixes at content-defined anchors.

Every window of LENGTH bytes belongs to one anchor (anchors.py), and equal windows to equal
anchors at equal distances. The suffixes that start at anchors are the sample that is sorted:

1. Anchors whose gram occurs nowhere else are dropped; this filter, by a hash of the gram,
   may keep too many but none too few, and decides nothing else.
2. Each anchor left gets its context: the bytes of all windows that belong to it. Each task
   first collapses contexts that are equal byte for byte, so that what a common passage sends
   on is bounded by the tasks, not by its copies.
3. Contexts are range-partitioned by the suffix's first bytes (the gram), so that what may
   share a window lies in one range. Each range is sorted by deep-shallow sorting
   (deep_shallow.py), once by the suffixes and once by the reversed prefixes before the
   anchors. A window that starts `a` bytes before its anchor is repeated where neighbours in
   the first order share LENGTH - a bytes and in the second order `a`: the classes between
   which the common prefixes of neighbours drop below that are exactly the equal windows.
4. Contexts of a gram that is too common for one task are cut into pieces of BLOCK windows,
   whose suffixes start earlier and share far more bytes (LENGTH - BLOCK + 1), and go through
   step 3 by these; pieces that are still too many through single windows, where a range only
   compares neighbours and holds no group.

The earliest of equal windows stays, all others are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C
from .anchors import GRAM, LENGTH, anchors
from .deep_shallow import sort_strings

BLOCK = 17
#: Rows with one core that a task may sort together; more go on as pieces, then as single windows.
CROWD = 40_000
#: Contexts sorted at once, at least; bytes of contexts collapsed at once; anchors settled at once.
CHUNK, COLLAPSE_BYTES, ANCHORS = 40_000, 24 << 20, 200_000
#: Bytes of text in which anchors are sought at once (about 100 bytes of memory for each).
PORTION = 1 << 18
#: Bytes of contexts aimed at in a range, and ranges at most (a larger range is streamed through its task).
RANGE_BYTES, RANGES = 24 << 20, 20_000
ASK, COVERED, MANY, OPEN = 0, 1, 2, 3

# a run of n windows from `first` on; `at`: the anchor's distance from `first`
_RUN = ["doc_id", "th", "first", "n", "at"]
_ANCHORS = "kind int, key long, doc_id long, th long, first long, n long, at long"
_CONTEXTS = "kind int, doc_id long, th long, first long, n long, at long, bytes binary"


def _runs(kind: int, columns: list[np.ndarray], key: np.ndarray | None = None, text: list[bytes] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of _ANCHORS, or of _CONTEXTS without a key."""
    size = len(columns[0])
    for s in range(0, size, 20_000):
        t = slice(s, min(s + 20_000, size))
        cols = [pa.array(np.full(t.stop - s, kind, dtype=np.int32))]
        cols += [] if key is None else [pa.array(np.ascontiguousarray(key[t]).view(np.int64))]
        cols += [pa.array(np.ascontiguousarray(x[t])) for x in columns]
        if key is None:
            cols.append(pa.nulls(t.stop - s, pa.binary()) if text is None else pa.array(text[t], pa.binary()))
        yield pa.RecordBatch.from_arrays(cols, names=["kind", *(["key"] if key is not None else []), *_RUN, *(["bytes"] if key is None else [])])


# --- anchors whose gram is repeated --------------------------------------------------------


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts' runs; a gram that a task has seen twice is OPEN at once and sends a mark only."""
    parts: list[tuple] = []

    def settle() -> Iterator[pa.RecordBatch]:
        key, *columns = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        order = np.argsort(key, kind="stable")
        key, columns = key[order], [x[order] for x in columns]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        alone = new & np.concatenate((new[1:], [True]))
        yield from _runs(ASK, [x[alone] for x in columns], key[alone])
        yield from _runs(OPEN, [x[~alone] for x in columns], C.mix(columns[0][~alone].view(np.uint64) + key[~alone]))
        yield from _runs(MANY, [x[new & ~alone] for x in columns], key[new & ~alone])

    size = 0
    for b in batches:
        ids, th = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for at, start, data, off in C.portions(b.column(2), LENGTH - 1, PORTION):
            doc, lo, hi, anchor, key = anchors(data, off)
            parts.append((key, ids[at + doc], th[at + doc], lo + start, hi - lo + 1, anchor - lo))
            size += len(key)
            if size >= ANCHORS:
                yield from settle()
                size = 0
    if parts:
        yield from settle()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key, the runs whose key another row has too."""
    held, same = None, False  # the last row, and whether the row before it has its key
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        kind, key = t.column(0).to_numpy(), t.column(1).to_numpy()
        equal = key[1:] == key[:-1]
        before = np.concatenate(([same], equal))
        keep = (kind[:-1] == OPEN) | (kind[:-1] == ASK) & (before[:-1] | equal)
        yield from t.slice(0, t.num_rows - 1).filter(pa.array(keep)).select(_RUN).to_batches()
        held, same = t.slice(t.num_rows - 1).combine_chunks(), before[-1]
    if held is not None and (held.column(0)[0].as_py() == OPEN or held.column(0)[0].as_py() == ASK and same):
        yield from held.select(_RUN).to_batches()


# --- contexts ------------------------------------------------------------------------------


class _Collapse:
    """Sends each distinct context once for each bounded number of bytes; rows come in the order of documents."""

    def __init__(self):
        self.seen: dict[tuple[bytes, int], None] = {}
        self.bytes = 0
        self.ask: list[tuple] = []
        self.again: list[tuple] = []

    def add(self, doc: int, th: int, first: int, n: int, at: int, text: bytes) -> None:
        if (text, at) in self.seen:
            self.again.append((doc, th, first, n, at))
            return
        self.seen[text, at] = None
        self.bytes += len(text) + 100
        self.ask.append((doc, th, first, n, at, text))

    def out(self, end: bool = False) -> Iterator[pa.RecordBatch]:
        for kind, rows in ((ASK, self.ask), (COVERED, self.again)):
            if rows and (end or len(rows) >= 10_000):
                cols = list(zip(*rows, strict=True))
                yield from _runs(kind, [np.array(c, dtype=np.int64) for c in cols[:5]], text=list(cols[5]) if kind == ASK else None)
                rows.clear()
        if self.bytes >= COLLAPSE_BYTES:
            self.seen.clear()
            self.bytes = 0


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, th, first, n, at, text, sorted; a document's text comes before its runs (null first)."""
    rows, key, raw, last = _Collapse(), None, b"", None
    for b in batches:
        text = b.column(5)
        columns = [b.column(i).to_pylist() for i in range(5)]
        for i, (doc, th, first, n, at) in enumerate(zip(*columns, strict=True)):
            if first is None:
                if (doc, th) != key:  # rows that repeat a document are one
                    key, raw, last = (doc, th), text[i].as_buffer().to_pybytes(), None
                continue
            if first != last:
                rows.add(doc, th, first, n, at, raw[first : first + n - 1 + LENGTH])
                last = first
        yield from rows.out()
    yield from rows.out(True)


def _refine(block: int):
    """Contexts cut into pieces by their windows' distances from the anchor, so that equal windows lie in like pieces.

    A piece's `at` points to the suffix that all its windows share, LENGTH - block + 1 bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Collapse()
        for b in batches:
            for doc, th, first, n, at, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                for g in reversed(range((at - n + 1) // block, at // block + 1)):  # by rising position
                    far, near = min(at, block * (g + 1) - 1), max(at - n + 1, block * g)
                    lo, size = at - far, far - near + 1
                    rows.add(doc, th, first + lo, size, far - block * g, text[lo : lo + size - 1 + LENGTH])
            yield from rows.out()
        yield from rows.out(True)

    return run


# --- sorted ranges -------------------------------------------------------------------------


def _repeats(t: pa.Table, left: int) -> Iterator[pa.RecordBatch]:
    """The runs of windows that occurred before, of contexts that hold all rows of their cores."""
    doc, th, first, n, at = (t.column(i).to_numpy() for i in range(5))
    m = len(doc)
    if m < 2:
        return
    order = np.lexsort((first + at, th, doc))  # from here on a row's number is its rank
    doc, th, first, n, at = doc[order], th[order], first[order], n[order], at[order]
    raw = t.column(5).combine_chunks()
    ends = np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + m + 1].astype(np.int64)
    data = np.concatenate((np.zeros(left, np.uint8), np.frombuffer(raw.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]], np.zeros(LENGTH, np.uint8)))
    core = (ends[:-1] - ends[0])[order] + left + at
    near = at - n + 1  # the least distance of a window; the last ends LENGTH - near after the anchor
    after = np.lib.stride_tricks.sliding_window_view(data, LENGTH)[core]
    after[np.arange(LENGTH) >= (LENGTH - near)[:, None]] = 0
    before = np.lib.stride_tricks.sliding_window_view(data, left)[core - left][:, ::-1].copy() if left else np.zeros((m, 1), np.uint8)
    before[:, :left][np.arange(left) >= at[:, None]] = 0

    def places(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Common prefixes of neighbours, each row's place, and the most that it shares with a neighbour."""
        order, lcp = sort_strings(rows)
        place, most = np.empty(m, np.int64), np.empty(m, np.int64)
        place[order] = np.arange(m)
        most[order] = np.maximum(lcp, np.append(lcp[1:], 0))
        return lcp, place, most

    lcp_after, place_after, most_after = places(after)
    del after
    lcp_before, place_before, most_before = places(before)
    del before
    again = np.zeros((m, left + 2), dtype=bool)
    for a in range(left + 1):
        some = np.flatnonzero((near <= a) & (a <= at) & (most_after >= LENGTH - a) & (most_before >= a))
        if len(some) < 2:
            continue
        classes = np.cumsum(lcp_after < LENGTH - a)[place_after[some]] * (m + 1) + np.cumsum(lcp_before < a)[place_before[some]]
        sort = np.argsort(classes, kind="stable")
        classes = classes[sort]
        again[some[sort[1:][classes[1:] == classes[:-1]]], a] = True
    # runs of distances become runs of windows, from the farthest on
    edge = np.diff(again.astype(np.int8), axis=1, prepend=0)
    row, start = np.nonzero(edge == 1)
    _, stop = np.nonzero(edge == -1)
    yield from _runs(COVERED, [doc[row], th[row], first[row] + at[row] - stop + 1, stop - start, np.zeros(len(row), np.int64)])


def _ranges(left: int, size: int):
    """Of contexts sorted by their cores (`size` bytes): what is repeated among those of a core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            held.append(b)
            count += b.num_rows
            if count < CHUNK:
                continue
            t = pa.Table.from_batches(held).combine_chunks()
            at, text = t.column(4).to_numpy(), t.column(5)
            core = lambda i: text[i].as_py()[at[i] : at[i] + size]  # noqa: B023, E731
            end, last = count - 1, core(count - 1)
            while end and core(end - 1) == last:
                end -= 1
            if end:
                yield from _repeats(t.slice(0, end), left)
                held, count = t.slice(end).combine_chunks().to_batches(), count - end
        if count:
            yield from _repeats(pa.Table.from_batches(held).combine_chunks(), left)

    return run


def _equal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of single windows sorted by their bytes and then by document: all but the first of equal ones."""
    last = None
    for b in batches:
        text = b.column(5).to_pylist()
        again = np.array([x == y for x, y in zip(text, [last, *text[:-1]], strict=True)], dtype=bool)
        last = text[-1] if text else last
        yield from _runs(COVERED, [b.column(i).to_numpy()[again] for i in range(5)])


# --- documents -----------------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns doc_id, th, first, n, text, row; sorted so that a document's runs come before its rows (null first)."""
    key, spans = None, []  # removed [from, to) of the document so far
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"]
    for b in batches:
        out, rows = [], []
        columns = [b.column(i).to_pylist() for i in range(4)]
        for i, (doc, th, first, n) in enumerate(zip(*columns, strict=True)):
            if (doc, th) != key:
                key, spans = (doc, th), []
            if first is not None:
                if spans and first <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], first + n - 1 + LENGTH)
                else:
                    spans.append([first, first + n - 1 + LENGTH])
                continue
            text = b.column(4)[i]
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            left, at = [], 0
            for lo, hi in spans:
                left.append(raw[at:lo])
                at = hi
            kept = b"".join([*left, raw[at:]]) if spans else raw
            # a character that lost some of its bytes goes from the text
            out.append((None if doc == C.NO_ID else doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text.is_valid else None))
            rows.append(i)
        cols = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)]
        extra = [b.column(5).take(pa.array(rows, pa.int64()))] if b.num_columns > 5 else []
        yield pa.RecordBatch.from_arrays(cols + extra, names=names + ["row"] * len(extra))


_CUT = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("doc_id", "n_bytes", "n_removed", "n_spans")] + [T.StructField("kept_sha256", T.StringType()), T.StructField("kept_text", T.StringType())]
)


def _by_range(rows: DataFrame, size: int, work, order: tuple[str, ...] = ()) -> DataFrame:
    """`work` over ranges of the cores' bytes, sorted by them; as many ranges as the rows' bytes ask for."""
    total = rows.agg(F.coalesce(F.sum(F.col("n") + LENGTH + 60), F.lit(0))).first()[0]
    ranges = min(RANGES, max(rows.sparkSession.sparkContext.defaultParallelism, -(-total // RANGE_BYTES)))
    rows = rows.withColumn("core", F.expr(f"substring(bytes, cast(at as int) + 1, {size})"))
    return rows.repartitionByRange(ranges, "core").sortWithinPartitions("core", *order).drop("core").mapInArrow(work, _CONTEXTS)


def _covered(docs: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(doc_id, th, first, n): the runs of windows that occurred before, of documents (doc_id, th, text)."""
    long = docs.where(F.octet_length("text") >= LENGTH)
    found = long.mapInArrow(_anchors, _ANCHORS)
    found = found.repartition("key").sortWithinPartitions("key").mapInArrow(_repeated, "doc_id long, th long, first long, n long, at long")
    found = scratch.store(found, "anchors")
    none = [F.lit(None).cast("long").alias(c) for c in ("first", "n", "at")]
    both = long.select("doc_id", "th", *none, "text").union(found.withColumn("text", F.lit(None).cast("string")))
    both = both.repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", F.asc_nulls_first("first"))
    rows = scratch.store(both.mapInArrow(_contexts, _CONTEXTS), "contexts")
    scratch.drop("anchors")
    covered = rows.where(f"kind = {COVERED}")
    size, left = GRAM, LENGTH - GRAM
    for step, block in enumerate((BLOCK, 1, None)):
        ask = rows.where(f"kind = {ASK}").drop("kind")
        if block is None:  # single windows
            settled = _by_range(ask, LENGTH, _equal, ("doc_id", "th", "first"))
            covered = covered.union(scratch.store(settled, f"settled{step}"))
            break
        keyed = ask.withColumn("crowd", F.expr(f"xxhash64(substring(bytes, cast(at as int) + 1, {size}))"))
        crowds = scratch.store(keyed.groupBy("crowd").count().where(F.col("count") > CROWD).select("crowd"), f"crowds{step}", narrow=True)
        crowded = not crowds.isEmpty()
        calm = keyed.join(crowds, "crowd", "left_anti") if crowded else ask
        covered = covered.union(scratch.store(_by_range(calm.select(*_RUN, "bytes"), size, _ranges(left, size)), f"settled{step}"))
        if not crowded:
            break
        crowd = keyed.join(crowds, "crowd", "left_semi").select(*_RUN, "bytes").sortWithinPartitions("doc_id", "th", "first")
        rows = scratch.store(crowd.mapInArrow(_refine(block), _CONTEXTS), f"pieces{step}")
        covered = covered.union(rows.where(f"kind = {COVERED}"))
        size, left = LENGTH - block + 1, block - 1
    return covered.select("doc_id", "th", "first", "n")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_row: bool = False) -> DataFrame:
    """Each document without the bytes of LENGTH-byte strings that also start earlier.

    Columns: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the
    bytes left) and kept_text (these as text; characters cut apart are left out; null for a
    null text); with_row adds `row`, a struct of the row's own columns. Earlier is a smaller
    doc_id, or a smaller start in the same document; matches lie in one document each, and
    all strings are judged on the input.

    A null text has no bytes. Null ids sort first. Rows alike in id and text are one document
    and get the same result; rows that repeat an id with another text (null ids too) are
    documents of their own, in the order of a hash of their texts, so what they share stays in
    one of them. Texts of any length are searched in overlapping portions of PORTION bytes; only
    their own bytes are held whole. An empty table gives an empty table; other columns are not
    read unless with_row, and may have any names.
    """
    C.tune(docs.sparkSession)
    scratch = C.Scratch(docs.sparkSession, "repeats")
    doc, th = C.identity(id_col, text_col)
    text = F.col(text_col).cast("string")
    covered = _covered(docs.select(doc.alias("doc_id"), th.alias("th"), text.alias("text")), scratch)
    none = [F.lit(None).cast("long").alias(c) for c in ("first", "n")]
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if with_row else []
    rows = docs.select(doc.alias("doc_id"), th.alias("th"), *none, text.alias("text"), *row)
    runs = covered.withColumn("text", F.lit(None).cast("string"))
    schema = _CUT
    if with_row:
        of = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
        runs = runs.withColumn("row", F.lit(None).cast(of))
        schema = T.StructType([*_CUT, T.StructField("row", of)])
    both = runs.union(rows).repartition("doc_id", "th").sortWithinPartitions("doc_id", "th", F.asc_nulls_last("first"))
    return both.mapInArrow(_cut, schema)
