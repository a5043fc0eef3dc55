"""Language identification by rank-order n-gram profiles.

A profile is a language's most frequent n-grams of 1 to 3 characters in order of frequency. A
document's own order is held against each profile; the out-of-place distance adds up how far
each of its n-grams is from its place there, and the nearest language wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: n-grams of a profile and of a document; table size (bits) in which n-grams are counted.
TOP, BITS = 400, 16
#: Characters of a text that are counted at once (about 100 bytes of memory for each).
PORTION = 1 << 18
UNKNOWN = "und"
_SEED = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def grams(text: str, portion: int = PORTION) -> Iterator[np.ndarray]:
    """Table slots of the text's n-grams, lower-cased, a portion at a time; what is between words counts as one blank.

    Nothing for a text without a letter. n-grams reach over the borders of portions, which lie at blanks where there are any.
    """
    held, after, some = np.array([32], dtype=np.uint64), False, False  # the last two symbols; whether a letter came last
    at = 0
    while at < len(text):
        to = text.find(" ", at + portion, at + 2 * portion) if len(text) > at + portion else len(text)
        to = min(at + portion, len(text)) if to < 0 else to
        c = np.frombuffer(text[at:to].lower().encode("utf-32-le", "replace"), dtype=np.uint32)
        at = to
        letter = _letters()[c]
        some = some or bool(letter.any())
        keep = letter.copy()
        keep[0] |= after
        keep[1:] |= letter[:-1]
        after = bool(letter[-1])
        c = np.where(letter, c, 32)[keep].astype(np.uint64)
        if at == len(text):
            if not some:
                return
            c = np.append(c, np.uint64(32))
        old, c = len(held), np.concatenate((held, c))
        one = c * _SEED[0]
        two = one[:-1] + c[1:] * _SEED[1]
        three = two[:-1] + c[2:] * _SEED[2]
        own = c[old:]
        h = np.concatenate((one[old:][own != 32], two[old - 1 :], three[max(0, old - 2) :]))
        held = c[-2:]
        if len(h):
            yield (C.mix(h) >> np.uint64(64 - BITS)).astype(np.int64)


def ranked(text: str) -> np.ndarray:
    """The text's most frequent n-grams, in order; ties by table slot."""
    counts = None
    for g in grams(text):
        if counts is None and len(text) <= PORTION and len(g) < 4 * TOP:
            found, n = np.unique(g, return_counts=True)
            return found[np.argsort(-n, kind="stable")[:TOP]]
        counts = np.zeros(1 << BITS, dtype=np.int64) if counts is None else counts
        counts += np.bincount(g, minlength=1 << BITS)
    if counts is None:
        return np.zeros(0, dtype=np.int64)
    found = np.flatnonzero(counts)
    return found[np.argsort(-counts[found], kind="stable")[:TOP]]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for b in batches:
        texts: dict[str, list[str]] = {}
        for name, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            texts.setdefault(name, []).append(text)
        for name, some in texts.items():
            n = total.setdefault(name, np.zeros(1 << BITS, dtype=np.int64))
            held, size = [], 0
            for k, text in enumerate(some):  # short texts are counted together
                held.append(text.as_py())
                size += len(held[-1])
                if size >= PORTION or k == len(some) - 1:
                    for g in grams("\n".join(held)):
                        n += np.bincount(g, minlength=1 << BITS)
                    held, size = [], 0
    for name, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["lang", "slot", "n"])


class Profiles:
    """Places of n-grams in the languages' orders, by n-gram: TOP entries for each language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.names = sorted({lang for lang, _, _ in rows})
        number = {n: i for i, n in enumerate(self.names)}
        rows = sorted((slot, number[lang], place - 1) for lang, slot, place in rows)
        slot, self.lang, self.place = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
        self.first = np.searchsorted(slot, np.arange((1 << BITS) + 1))

    def distances(self, own: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's order from each language's; an n-gram that a language lacks counts TOP."""
        n = self.first[own + 1] - self.first[own]
        rank = np.repeat(np.arange(len(own)), n)
        entry = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.first[own], n)
        nearer = TOP - np.minimum(np.abs(self.place[entry] - rank), TOP)
        return TOP * len(own) - np.bincount(self.lang[entry], nearer, minlength=len(self.names)).astype(np.int64)


def _predict(profiles):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Profiles = profiles.value
        for b in batches:
            lang, score = [], []
            for cell in b.column(2):
                text = cell.as_py()
                own = ranked(text) if text else ()
                if not len(own) or not known.names:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                off = known.distances(own)
                best = int(off.argmin())
                lang.append(known.names[best])
                score.append(1.0 - float(off[best]) / (TOP * len(own)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text divides by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of `docs`.

    Profiles are learnt from all rows that are not held out and have a language; counts are
    summed in a table of fixed size for each language. lang_pred is a learnt language, or
    'und' with score 0 where the text is null or has no letter, or where nothing was learnt.
    score is 1 less the mean distance in TOPs. Equal distances go to the first language by name.

    Ids may be null or repeat: each row is judged alone. Texts of any length are counted whole,
    PORTION characters at a time. Equal frequencies are ordered by table slot. An empty table
    gives an empty table; other columns are not read and may have any names.
    """
    spark = docs.sparkSession
    C.tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    learn = rows.where("not held_out and lang is not null and text is not null").select("lang", "text")
    counts = learn.mapInArrow(_count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "slot"))
    # TOP rows for each language, which are few: what a language sends and holds is 400 entries
    top = counts.withColumn("place", place).where(F.col("place") <= TOP).select("lang", "slot", "place").collect()
    profiles = spark.sparkContext.broadcast(Profiles([tuple(r) for r in top]))
    return rows.select("doc_id", "held_out", "text").mapInArrow(_predict(profiles), "doc_id long, held_out boolean, lang_pred string, score double")
