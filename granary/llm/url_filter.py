"""URL filter: host and path rules, and character language models for all other URLs.

Two variable-order Markov models over URL characters are learnt from the URLs that the rules
decide: one from allowed, one from blocked URLs. Each order's estimate is smoothed towards
that of the next shorter context. An URL's score is the difference of the models'
log-likelihoods a character; it is blocked where the score is over a threshold calibrated on
rule-decided URLs that the models have not seen.

Counts are exact and form a table of (context, character) that grows with the URLs. To score,
the URLs are dealt into chunks; each chunk's distinct contexts are joined to the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Longest context, smoothing weight of the shorter context, bits of the URLs that are scored together.
ORDER, WEIGHT, CHUNK_BITS = 5, 4.0, 13
#: Share of held-out allowed URLs that the threshold may block, and scores' bins a unit.
FALSE_BLOCKS, BINS = 0.02, 200
#: A key is the order (3 bits), the context's characters and the character, 9 bits each; ANY stands for all characters.
_ANY = np.uint64(511)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an URL; both empty without '://'."""
    u = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substr(u, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest of `rules` ('host/path start', verdict) that fits, as struct(rule, verdict)."""
    out = F.lit(None)
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        of, _, start = rule.partition("/")
        fits = ((host == of) | host.endswith(f".{of}")) & path.startswith(f"/{start}")
        out = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _keys(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Of runs of URLs: first index, index of the URL of each character, and per order its keys of context and of context with character."""
    for at, data, off in C.slices(column):
        lens = np.diff(off)
        # an end mark closes each URL, ORDER start marks precede it
        n = len(lens)
        width = lens + ORDER + 1
        begin = np.concatenate(([0], np.cumsum(width)))
        x = np.zeros(begin[-1], dtype=np.uint64)
        x[np.arange(len(data)) + np.repeat(begin[:-1] + ORDER - off[:-1], lens)] = data.astype(np.uint64) + np.uint64(2)
        x[begin[1:] - 1] = 1
        where = np.ones(len(x), dtype=bool)
        where[(begin[:-1, None] + np.arange(ORDER)).ravel()] = False
        pos = np.flatnonzero(where)
        owner = np.repeat(np.arange(n), lens + 1)
        ctx = np.zeros(len(pos), dtype=np.uint64)
        keys = np.empty((ORDER + 1, 2, len(pos)), dtype=np.int64)
        for k in range(ORDER + 1):
            if k:
                ctx = ctx | x[pos - k] << np.uint64(9 * k)
            of = ctx | np.uint64(k << 9 * (ORDER + 1))
            keys[k, 0] = of | _ANY
            keys[k, 1] = of | x[pos]
        yield at, owner, keys, lens + 1


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the batches' URLs by key and class."""
    for b in batches:
        blocked = np.array(b.column(1).to_pylist(), dtype=bool)
        for at, owner, keys, _ in _keys(b.column(0)):
            each, which = np.unique(keys, return_inverse=True)
            cls = np.broadcast_to(blocked[at:][owner], keys.shape).ravel()
            n = [np.bincount(which.ravel()[cls == c], minlength=len(each)) for c in (False, True)]
            yield pa.RecordBatch.from_arrays([pa.array(each), pa.array(n[0]), pa.array(n[1])], names=["key", "allowed", "blocked"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct keys of each chunk's URLs in a batch."""
    for b in batches:
        chunk = b.column(0).to_numpy()
        for c in np.unique(chunk):
            for _, _, keys, _ in _keys(b.column(1).filter(pa.array(chunk == c))):
                each = np.unique(keys)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(each), c)), pa.array(each)], names=["chunk", "key"])


def _scores(urls: pa.Table, found: pa.Table) -> pa.Table:
    """The scores of a chunk's URLs, from the counts of those of its keys that the models hold."""
    held = found.column("key").to_numpy()
    order = np.argsort(held)
    # a last row for keys that the models do not hold
    held = np.append(held[order], np.iinfo(np.int64).max)
    total = np.array([np.append(found.column(c).to_numpy()[order], 0) for c in ("allowed", "blocked")])
    score = np.zeros(len(urls))
    for at, owner, keys, lens in _keys(urls.column("url")):
        row = np.searchsorted(held, keys)
        row[held[row] != keys] = len(held) - 1
        log = np.zeros((2, len(owner)))
        for c in (0, 1):
            p = np.full(len(owner), 1 / 257)
            for k in range(ORDER + 1):
                p = (total[c][row[k, 1]] + WEIGHT * p) / (total[c][row[k, 0]] + WEIGHT)
            log[c] = np.log(np.minimum(p, 1.0))
        score[at : at + len(lens)] = np.bincount(owner, log[1] - log[0], minlength=len(lens)) / lens
    return pa.Table.from_arrays([urls.column("page_id"), urls.column("url"), pa.array(score)], names=["page_id", "url", "score"])


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, score and verdict of each row.

    rules: ('host/path start', 'allow' or 'block'). The verdict is the longest fitting rule's;
    without one, 'block' where the score is over the threshold, else 'allow'. score is the
    log-likelihood ratio a character, positive where blocked URLs are likelier.

    The models are exact counts of all rule-decided URLs but every fifth (by hash), which
    calibrate: the threshold is the least
    at which at most FALSE_BLOCKS of their allowed URLs are blocked, and 0 at least. If one
    class has no URL, nothing is blocked without a rule.

    A null URL, or one without '://', has an empty host and path and no rule, and is scored
    as an empty text. Ids may be null or repeat: each row is judged alone. An empty table
    gives an empty table; other columns are not read.
    """
    spark = pages.sparkSession
    C.tune(spark)
    scratch = C.Scratch(spark, "urls")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"))
    # runs of a task's rows, so that neither an URL that repeats nor a common key makes a large group
    rows = scratch.store(rows.select(F.shiftright(F.monotonically_increasing_id(), CHUNK_BITS).alias("chunk"), "page_id", "url"), "rows")
    of = rule_of(*parts(F.col("url")), rules)
    held = F.pmod(F.xxhash64("url"), F.lit(5)) == 0
    ruled = rows.select("url", of.alias("of")).where(F.col("of").isNotNull() & ~held).select("url", (F.col("of.verdict") == "block").alias("blocked"))
    counts = ruled.mapInArrow(_counts, "key long, allowed long, blocked long").groupBy("key").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked"))
    counts = scratch.store(counts, "counts")
    wanted = rows.select("chunk", "url").mapInArrow(_wanted, "chunk long, key long").distinct()
    found = wanted.join(counts, "key").select("chunk", "key", "allowed", "blocked")
    out = rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(_scores, "page_id long, url string, score double")
    out = scratch.store(out, "scores")
    seen = counts.where(F.col("key") == int(_ANY)).select("allowed", "blocked").first()
    limit = float("inf")
    if seen and min(seen) > 0:
        calibrate = out.where(held & (of["verdict"] == "allow"))
        bins = calibrate.groupBy(F.floor(F.col("score") * BINS).alias("bin")).count().collect()
        limit, above, n = 0.0, 0, sum(r["count"] for r in bins)
        for r in sorted(bins, key=lambda r: -r.bin):
            above += r["count"]
            if above > FALSE_BLOCKS * n:
                limit = max(0.0, (r.bin + 1) / BINS)
                break
    host, path = parts(F.col("url"))
    out = out.select("page_id", host.alias("host"), path.alias("path"), of.alias("of"), "score")
    learnt = F.when(F.col("score") > limit, "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("of.rule").alias("rule"), "score", F.coalesce("of.verdict", learnt).alias("verdict"))
