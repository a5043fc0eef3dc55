"""Benchmark decontamination by size-partitioned MinHash containment search.

A document holds an item if it has at least `percent` of the item's distinct shingles. Items
are partitioned by size: those of a class have between 2**k and 2**(k+1) - 1 shingles.

An item's signature is its shingles of the least hashes, as many as its class needs: of n
shingles a holder misses at most n * (100 - percent) / 100, so of one more than that at least
one is in every holder, and the search misses none. A document's signature for a class is all
its shingles whose hashes are up to the largest in the class's signatures: a bottom sketch
that grows with the document, so that a short item is found in a long one. Documents are
looked up in the classes, so a document's cost does not depend on the number of items.
Candidates are verified by exact containment.

Up to INDEX_SHINGLES shingles, the items' classes are broadcast; beyond that the same
signatures are joined as tables.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Shingles of items that are broadcast, at most (about 40 bytes each in a worker).
INDEX_SHINGLES = 2_000_000
_HIT = "doc_id long, text_hash long, item_id long, n_common long, n_item long"


def _sets(width: int):
    """(id, hash of the text, shingles in order, their number) of the rows with a shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, data, off in C.slices(b.column(2)):
                for i, s in enumerate(C.shingles(data, off, width)):
                    if len(s):
                        row = b.slice(at + i, 1)
                        yield pa.RecordBatch.from_arrays([row.column(0), row.column(1), pa.ListArray.from_arrays(pa.array([0, len(s)], pa.int32()), C.long_array(s)), pa.array([len(s)])], names=["id", "th", "shingles", "n"])

    return run


def _rows(width: int):
    """(id, hash of the text, shingle)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sets(width)(batches):
            s = b.column(2).values
            yield pa.RecordBatch.from_arrays([pa.array([b.column(k)[0].as_py()] * len(s), pa.int64()) for k in (0, 1)] + [s], names=["id", "th", "shingle"])

    return run


def signature_length(n: int, percent: int) -> int:
    """Shingles that an item of n shingles needs in its signature, by the largest size of its class."""
    return min(n, ((1 << int(n).bit_length()) - 1) * (100 - percent) // 100 + 1)


class Index:
    """The items' shingle sets, and for each size class its signatures in the order of their hashes."""

    def __init__(self, items: list[tuple[int, np.ndarray]], percent: int):
        self.percent, self.ids, self.sets = percent, [i for i, _ in items], [s for _, s in items]
        by_class: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for k, s in enumerate(self.sets):
            sketch = s[: signature_length(len(s), percent)]
            by_class.setdefault(len(s).bit_length(), []).append((sketch, np.full(len(sketch), k)))
        self.classes = []  # distinct hashes, first owner of each, owners
        for parts in by_class.values():
            h, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(h, kind="stable")
            each, first = np.unique(h[order], return_index=True)
            self.classes.append((each, np.append(first, len(h)), owner[order]))

    def search(self, sets: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
        """(number of the set, item id, common shingles, item's shingles) of the items that the sets hold."""
        if not sets:
            return
        shingles, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        for each, first, owner in self.classes:
            sign = shingles <= each[-1]
            own, of = shingles[sign], doc[sign]
            at = np.searchsorted(each, own)
            hit = each[at] == own
            at, of = at[hit], of[hit]
            n = first[at + 1] - first[at]
            item = owner[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[at], n)]
            for pair in np.unique(np.repeat(of, n) * len(self.sets) + item):
                d, k = divmod(int(pair), len(self.sets))
                common = len(np.intersect1d(self.sets[k], sets[d], assume_unique=True))
                if 100 * common >= self.percent * len(self.sets[k]):
                    yield d, self.ids[k], common, len(self.sets[k])


def _search(index, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Index = index.value
        for b in batches:
            rows: list[tuple] = []
            for at, data, off in C.slices(b.column(2)):
                sets = list(C.shingles(data, off, width))
                rows += [(b.column(0)[at + d].as_py(), b.column(1)[at + d].as_py(), *found) for d, *found in items.search(sets)]
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "text_hash", "item_id", "n_common", "n_item"])

    return run


def _joined(docs: DataFrame, items: DataFrame, width: int, percent: int, scratch: C.Scratch) -> DataFrame:
    """The same search as joins of tables: signatures first, then all shingles of the candidates."""
    signed = scratch.store(docs.mapInArrow(_rows(width), "id long, th long, shingle long").distinct(), "shingles")
    signed = signed.select(F.col("id").alias("doc_id"), F.col("th").alias("text_hash"), "shingle")
    need = F.expr(f"least(n, ((shiftleft(1L, length(bin(n))) - 1) * {100 - percent}) div 100 + 1)")
    sketch = items.select("id", "th", F.explode(F.slice("shingles", F.lit(1), need.cast("int"))).alias("shingle"))
    pairs = scratch.store(signed.join(sketch, "shingle").select("doc_id", "text_hash", "id", "th").distinct(), "pairs")
    whole = items.select("id", "th", "n", F.explode("shingles").alias("shingle"))
    common = pairs.join(whole, ["id", "th"]).join(signed, ["doc_id", "text_hash", "shingle"], "left_semi")
    out = common.groupBy("doc_id", "text_hash", "id", "th").agg(F.count("*").alias("n_common"), F.first("n").alias("n_item"))
    out = out.where(f"100 * n_common >= {percent} * n_item").select("doc_id", "text_hash", F.col("id").alias("item_id"), "n_common", "n_item")
    return out.distinct()  # an item id with two texts, both held alike, is one result


def find_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", width: int = 5, percent: int = 80
) -> DataFrame:
    """doc_id, text_hash (C.identity's), item_id, n_common and n_item of each document and item that it holds.

    Words are [^\\x20\\x09-\\x0D]+, A-Z lower-cased; an item of fewer than `width` words is one
    shingle, which a longer document cannot hold. Null or empty texts hold nothing and are
    held by nothing. Ids may be null or repeat: rows of either side are told apart by id and
    text, and equal results are given once. Texts of any length are hashed a megabyte at a
    time. Empty tables give an empty table; other columns are not read and may have any names.
    """
    spark = docs.sparkSession
    C.tune(spark)
    scratch = C.Scratch(spark, "benchmark")

    def keyed(rows: DataFrame, id_: str, text: str) -> DataFrame:
        doc, th = C.identity(id_, text)
        return rows.select(doc.alias("id"), th.alias("th"), F.col(text).cast("string").alias("text")).where("text is not null")

    docs = keyed(docs, id_col, text_col)
    sets = keyed(items, item_id_col, item_text_col).distinct().mapInArrow(_sets(width), "id long, th long, shingles array<long>, n long")
    sets = scratch.store(sets, "items")
    if sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] <= INDEX_SHINGLES:
        few = sets.orderBy("id", "th").toArrow()
        ends = few.column("shingles").combine_chunks().offsets.to_numpy() if len(few) else [0]
        flat = few.column("shingles").combine_chunks().values.to_numpy().view(np.uint64) if len(few) else None
        index = Index([(i, flat[a:b].copy()) for i, a, b in zip(few.column("id").to_pylist(), ends[:-1], ends[1:], strict=True)], percent)
        out = docs.mapInArrow(_search(spark.sparkContext.broadcast(index), width), _HIT).distinct()
    else:
        out = _joined(docs, sets, width, percent, scratch)
    known = {c: F.when(F.col(c) != C.NO_ID, F.col(c)) for c in ("doc_id", "item_id")}
    return out.withColumns(known)


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that hold no item, with all their columns."""
    held = find_items(docs, items, id_col=id_col, text_col=text_col, **options)
    held = held.select(F.coalesce("doc_id", F.lit(C.NO_ID)).alias("__doc"), F.col("text_hash").alias("__th")).distinct()
    doc, th = C.identity(id_col, text_col)
    return docs.join(held, (doc == held["__doc"]) & (th == held["__th"]), "left_anti")
