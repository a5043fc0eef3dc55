"""How document filters interact: what each removes, and what it would have removed, in every order.

Texts are routed by their xxhash to the partition that settles which of them repeat an earlier
one. A partition keeps, for each hash, a chain of the different full texts with their smallest
id, so equal hashes of unlike texts do no harm. Map tasks keep such chains as well, up to
HELD_BYTES of text: what repeats a text there is settled at once, so a text goes over the
network once for each time a task's chains are handed on, however many copies it has.
Settled documents are counted by language, in vectors with a place for each set of failed
filters; all orders of the filters follow from those.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

FILTERS = "ABCDE"
REPEATED = FILTERS.index("E")
#: Text that a map task's chains hold, at most.
HELD_BYTES = 16 << 20
#: Text of a partition that settles repeats, about.
PART_BYTES = 32 << 20
#: Fixed values of the filters.
LEAST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(65, 91))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
SCHEMA = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _words(data: bytes, limit: int = C.SLICE_BYTES) -> Iterator[list[bytes]]:
    """The words [^\\x20\\x09-\\x0D]+, those of about `limit` bytes at a time; bytes.split knows the same white space."""
    start = 0
    while start < len(data):
        gap = SPACE.search(data, start + limit)
        end = gap.end() if gap else len(data)
        yield data[start:end].split()
        start = end


def failures(text: str, data: bytes) -> int:
    """A bit for each filter that the text itself fails: A has bit 0, and so on; repeats are not known here.

    data: the text in UTF-8.
    """
    n, seen = 0, set()
    for w in _words(data):
        n += len(w)
        seen.update(w)
    fails = (
        n < LEAST_WORDS,
        100 * len(seen) < DISTINCT_SHARE * n,
        100 * (len(data) - len(data.translate(None, CAPITALS))) > CAPITAL_SHARE * len(text),
        len(data.translate(None, SYMBOLS)) < len(data),
    )
    return sum(f << i for i, f in enumerate(fails))


class Chains:
    """For each hash the different texts, each with its smallest id, that id's rows by language, and its failures."""

    def __init__(self):
        self.by_hash: dict[int, list[list]] = {}
        self.held = 0

    def add(self, h: int, data: bytes, least: int, rows: dict, fails: int) -> Iterator[tuple]:
        """Take a text in; gives the documents (id, language, failures, number) that now are known to repeat another."""
        chain = self.by_hash.setdefault(h, [])
        for link in chain:
            if link[0] == data:
                break
        else:
            chain.append([data, least, dict(rows), fails])
            self.held += len(data) + 200
            return
        if least == link[1]:  # the id is repeated: none of its rows is smaller
            for lang, n in rows.items():
                link[2][lang] = link[2].get(lang, 0) + n
            return
        if least < link[1]:
            link[1], least, link[2], rows = least, link[1], dict(rows), link[2]
        for lang, n in rows.items():
            yield least, lang, fails | 1 << REPEATED, n

    def links(self) -> Iterator[tuple]:
        for h, chain in self.by_hash.items():
            for link in chain:
                yield h, *link
        self.__init__()


def _first_pass(rows: Iterable) -> Iterator[tuple]:
    """(hash, open chain link) for texts, and (any number, settled document) for those that repeat one of this task."""
    chains = Chains()
    for i, lang, text in rows:
        text, lang = text or "", lang or ""
        data = text.encode()
        fails = failures(text, data)
        if i is None:  # no id is smaller, and it is smaller than none
            yield hash(data), (None, lang, fails, 1)
            continue
        for settled in chains.add(xxhash.xxh64_intdigest(data), data, i, {lang: 1}, fails):
            yield settled[0], settled
        if chains.held > HELD_BYTES:
            for h, *link in chains.links():
                yield h, ("open", *link)
    for h, *link in chains.links():
        yield h, ("open", *link)


def _settle(routed: Iterable) -> Iterator[tuple]:
    chains = Chains()
    for h, x in routed:
        if x[0] == "open":
            yield from chains.add(h, *x[1:])
        else:
            yield x
    for _, _, least, rows, fails in chains.links():
        for lang, n in rows.items():
            yield least, lang, fails, n


def failed_filters(docs: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> RDD:
    """(id, language, bits of the failed filters, number of rows) of all documents."""
    C.tune(docs.sparkSession)
    x = docs.select(F.col(id_col).cast("long"), F.col(lang_col).cast("string"), F.col(text_col).cast("string").alias("text"))
    size = x.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    return x.rdd.mapPartitions(_first_pass).partitionBy(parts).mapPartitions(_settle)


def repeated_ids(docs: DataFrame, **columns: str) -> DataFrame:
    """(doc_id, n): the documents whose text a smaller id has too, once each with the number of such rows."""
    marked = failed_filters(docs, **columns).filter(lambda x: x[2] >> REPEATED & 1).map(lambda x: (x[0], x[3]))
    return docs.sparkSession.createDataFrame(marked, "doc_id long, n long", verifySchema=False).groupBy("doc_id").agg(F.sum("n").alias("n"))


# --- counts --------------------------------------------------------------------------------


def _start(x: tuple) -> list:
    marks, label = x
    return [dict(marks), label]


def _more(a: list, x: tuple) -> list:
    for mark, n in x[0].items():
        a[0][mark] = a[0].get(mark, 0) + n
    a[1] |= x[1]
    return a


def _vectors(x: tuple) -> Iterator[tuple]:
    """By language, how many documents, good ones and toxic ones fail each set of filters."""
    marks, label = x[1]
    for (lang, fails), n in marks.items():
        counts = np.zeros((3, 1 << len(FILTERS)), dtype=np.int64)
        counts[:, fails] = n, n * (label & 1), n * (label >> 1)
        yield lang, counts


def every_order(counts: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) from one part's counts."""
    sets = np.arange(1 << len(FILTERS))
    orders, removed = ["".join(p) for p in permutations(FILTERS)], {}
    for order in orders:
        before = 0
        for f in order:
            bit = 1 << FILTERS.index(f)
            removed[order, f] = counts[:, (sets & bit > 0) & (sets & before == 0)].sum(axis=1)
            before |= bit
    shapley = {f: sum(int(removed[o, f][0]) for o in orders) for f in FILTERS}
    for order in orders:
        kept = int(counts[0].sum())
        for i, f in enumerate(order):
            gone, bit = removed[order, f], 1 << FILTERS.index(f)
            kept -= int(gone[0])
            fails = int(counts[0, sets & bit > 0].sum())
            yield order, i + 1, kept, int(gone[0]), fails - int(gone[0]), int(counts[0, bit]), int(gone[1]), int(gone[2]), shapley[f]


def interactions(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """A row for each language, order of the five filters and step; see SCHEMA for the counts.

    labels: doc_id, quality and toxic; an id that repeats there is good, or toxic, if one of its
    rows says so. A null text counts as empty, a null language as the empty string. A null id
    is smaller than no other, so it never repeats one, and has no label. Rows alike in id and
    text don't repeat each other, as neither id is smaller. Very long texts are split in
    portions. An empty table gives an empty table. Other columns are not read.
    """
    spark = docs.sparkSession
    marks = failed_filters(docs, id_col, lang_col, text_col).map(lambda x: (x[0], ({(x[1], x[2]): x[3]}, 0)))
    is_one = lambda c: F.coalesce((F.col(c) == 1).cast("int"), F.lit(0))
    known = labels.where("doc_id is not null").select(F.col("doc_id").cast("long"), (is_one("quality") + 2 * is_one("toxic")).cast("int"))
    both = marks.union(known.rdd.map(lambda x: (x[0], ({}, x[1]))))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_id = both.combineByKey(_start, _more, lambda a, b: _more(a, (b[0], b[1])), parts)
    by_part = by_id.flatMap(_vectors).combineByKey(np.copy, np.add, np.add, parts)
    rows = by_part.flatMap(lambda x: ((x[0], *row) for row in every_order(x[1])))
    return spark.createDataFrame(rows, SCHEMA, verifySchema=False)
