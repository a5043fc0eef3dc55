"""Shards of nearly equal bytes by histogram sort, in DataFrame operations only.

The sort key is (hash of the text, id), so equal texts lie together and a group larger than a
shard is cut by id. Only where rows alike in both have to be cut, a third part of the key
tells them apart: a hash of their numbers in a stored copy of the rows. Splitters are found without sorting: each round counts the exact bytes
of PROBES equal parts of every interval that still holds an unplaced splitter, keeps the part
in which the target lies, and ends when that part is within tolerance or is a single key.
Then rows are exchanged once, to cells of a shard, which get their slots from exact counts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Parts of an interval in a round; a round sends at most (shards - 1) * PROBES counts to the driver.
PROBES = 1024
#: Bytes that each row counts besides its text.
ROW_BYTES = 16
#: Rows of a cell, in which slots are numbered by one task.
CELL_ROWS = 20_000
LOWEST = -(1 << 63)


KEY = ("h", "k", "t")
Key = tuple[int, int, int]


@dataclass
class Interval:
    """Values from lo to hi of the key's next part, behind the parts in `fixed`; `below`: bytes before them."""

    lo: int
    hi: int
    below: int
    fixed: tuple[int, ...]
    targets: list[int]


def _count(keys: DataFrame, todo: list[Interval]) -> list:
    part = F.lit(None)
    for i, x in reversed(list(enumerate(todo))):
        name, step = KEY[len(x.fixed)], max(1, -(-(x.hi - x.lo + 1) // PROBES))
        inside = F.col(name).between(x.lo, x.hi)
        for c, v in zip(KEY, x.fixed, strict=False):
            inside = inside & (F.col(c) == v)
        wide = x.hi - x.lo >= 1 << 62
        bin_ = F.floor((F.col(name).cast("decimal(20,0)") - F.lit(x.lo)) / F.lit(step)) if wide else F.expr(f"({name} - ({x.lo})) div {step}")
        part = F.when(inside, F.struct(F.lit(i).alias("i"), bin_.cast("long").alias("bin"))).otherwise(part)
    counts = keys.select(part.alias("part"), *KEY, "size").where("part is not null").groupBy("part")
    ends = [f(c).alias(f"{c}{i}") for c in KEY for i, f in enumerate((F.min, F.max))]
    return counts.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), *ends).collect()


def splitters(keys: DataFrame, n_shards: int, tolerance: float = 0.0005) -> tuple[list[Key], bool]:
    """(h, k, t) of each boundary: a row lies above it if its key is that or larger; and whether a boundary falls among rows of one key.

    keys: h, k and t (long, not null) and size. tolerance: of a shard's bytes.
    """
    whole = keys.agg(F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1")).first()
    if not whole.bytes:
        return [], False
    target = {j: whole.bytes * j // n_shards for j in range(1, n_shards)}
    allowed = max(1, int(whole.bytes / n_shards * tolerance))
    found: dict[int, Key] = {}
    torn = False
    todo = [Interval(whole.h0, whole.h1, 0, (), list(target))]
    while todo:
        bins: dict[int, list] = {}
        for r in _count(keys, todo):
            bins.setdefault(r.part.i, []).append(r)
        later: list[Interval] = []
        for i, x in enumerate(todo):
            below, left = x.below, list(x.targets)
            for r in sorted(bins.get(i, []), key=lambda r: r.part.bin):
                here = [j for j in left if target[j] < below + r.bytes]
                left = [j for j in left if j not in here]
                low, high = tuple(r[f"{c}0"] for c in KEY), tuple(r[f"{c}1"] for c in KEY)
                if here and (r.bytes <= allowed or low == high):
                    torn = torn or r.bytes > allowed and r.rows > 1
                    for j in here:
                        # from the part's first key on, or from just after its last
                        found[j] = low if 2 * (target[j] - below) <= r.bytes else (*high[:2], high[2] + 1)
                elif here:
                    same = 0
                    while low[same] == high[same]:
                        same += 1
                    later.append(Interval(low[same], high[same], below, low[:same], here))
                below += r.bytes
            for j in left:
                found[j] = (whole.h1 + 1, LOWEST, LOWEST)
        todo = later
    return [found[j] for j in sorted(found)], torn


def _keyed(docs: DataFrame, id_col: str, text_col: str, names: dict[str, str]) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.withColumns(
        {
            names["h"]: F.shiftrightunsigned(F.xxhash64(text), 2),
            names["k"]: F.coalesce(F.col(id_col).cast("long"), F.lit(LOWEST)),
            names["size"]: (F.octet_length(text) + ROW_BYTES).cast("long"),
            names["crc"]: F.crc32(text.cast("binary")),
        }
    )


def shard_by_bytes(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text", tolerance: float = 0.0005) -> DataFrame:
    """`docs` with size, text_crc32 (of the UTF-8 text), law, shard (0 to n_shards - 1), slot and grown_shard.

    law is 'bytes': shards hold nearly equal bytes, counting ROW_BYTES for each row; equal
    texts lie together, in neighbouring shards where they exceed one. slot is gapless from 0
    in a shard. grown_shard is null under this law.

    A null text counts as empty, a null id sorts first. Repeated rows keep a slot each; rows
    alike in id and text are cut, too, where they exceed a shard, and lie in no set order. An
    empty table gives an empty table. Input columns of the names above are replaced; texts are
    only hashed and measured, whatever their length.
    """
    spark = docs.sparkSession
    C.tune(spark)
    names = {"h": "__h", "k": "__k", "size": "size", "crc": "text_crc32"}
    scratch = C.Scratch(spark, "sharding")
    docs = docs.drop("size", "text_crc32", "law", "shard", "slot", "grown_shard").withColumn("__t", F.lit(0).cast("long"))

    def measure(docs: DataFrame, name: str) -> DataFrame:
        plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col("__t").alias("t"))
        return scratch.store(_keyed(plain, "id", "text", {"h": "h", "k": "k", "size": "size", "crc": "crc"}).select(*KEY, "size"), name)

    keys = measure(docs, "keys")
    cuts, torn = splitters(keys, n_shards, tolerance)
    if torn:  # rows of one key lie on both sides of a boundary: number them, once and for all
        number = F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 2)
        docs = scratch.store(docs.withColumn("__t", number), "rows")
        keys = measure(docs, "numbered")
        cuts, _ = splitters(keys, n_shards, tolerance)
    rows = keys.count()

    def shard(h: str, k: str, t: str) -> Column:
        h, k, t = F.col(h), F.col(k), F.col(t)
        out = F.lit(0)
        for a, b, c in cuts:
            out = out + ((h > a) | ((h == a) & ((k > b) | ((k == b) & (t >= c))))).cast("int")
        return out

    cells = max(8, -(-rows // (n_shards * CELL_ROWS)))
    cell = lambda h, k, t: F.pmod(F.xxhash64(F.col(k), F.col(h), F.col(t)), F.lit(cells))
    counts = keys.select(shard(*KEY).alias("__s"), cell(*KEY).alias("__cell")).groupBy("__s", "__cell").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__s").orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__s", "__cell", F.coalesce(before, F.lit(0)).alias("__start"))
    out = _keyed(docs, id_col, text_col, names)
    out = out.withColumns({"__s": shard("__h", "__k", "__t"), "__cell": cell("__h", "__k", "__t")}).join(starts, ["__s", "__cell"])
    number = F.row_number().over(Window.partitionBy("__s", "__cell").orderBy("__h", "__k", "__t"))
    out = out.withColumns({"law": F.lit("bytes"), "shard": F.col("__s").cast("int"), "slot": (F.col("__start") + number - 1).cast("long"), "grown_shard": F.lit(None).cast("int")})
    return out.drop("__s", "__cell", "__start", "__h", "__k", "__t")
