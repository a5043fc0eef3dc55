"""Mixing sources to target weights, in DataFrame operations only.

A source's documents, in a hashed order, are one line of words, cut into blocks of equal
length (the last may be short). A mix takes a run of a permuted order of the blocks: once
around for as many words as the source has, then on in a second permutation. How many of its
blocks each output shard gets is drawn by a splitting tree: the shards are halved again and
again, and the blocks that fall to the left half are a multivariate hypergeometric draw from
those of the node, so quotas are whole numbers whose sums are exact. A shard's draws are the
next ones of the permuted order, so no two shards share a draw; a hash orders them in the shard.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

#: Blocks that a shard gets: more mix it finer, and make more pieces of documents.
BLOCKS_A_SHARD = 1024
#: Steps of the permutations.
STEPS = 24
#: Documents of a source that one task lays end to end, about.
CELL_ROWS = 5_000
PRIME = (1 << 31) - 1
WORD, SPACE = r"[^\\x20\\x09-\\x0D]+", r"[\\x20\\x09-\\x0D]+"


def steps(seed: int, turn: int) -> list[tuple[int, int, int]]:
    """(k, a, c) below PRIME of each step of the turn's permutation."""
    words = [hashlib.sha256(f"{seed}/{turn}/{i}".encode()).digest() for i in range(STEPS)]
    return [tuple(int.from_bytes(w[8 * j : 8 * j + 8], "big") % (PRIME - 1) + 1 for j in range(3)) for w in words]


def _position(block: str, full: str, seed: int, turn: int) -> str:
    """SQL of a block's place in the turn's permutation of `full` blocks; a short last block stays last.

    In each step a number and its mirror image (about the step's k) change places or not, as a
    hash of the larger one says; that is a permutation of any number of blocks.
    """
    args = ", ".join(f"named_struct('k', {k}L, 'a', {a}L, 'c', {c}L)" for k, a, c in steps(seed, turn))
    image = f"pmod(s.k - x, {full})"
    moved = f"((greatest(x, {image}) + s.c) % {PRIME} * s.a % {PRIME}) div 32768 % 2 = 1"
    return f"case when {block} < {full} then aggregate(array({args}), {block}, (x, s) -> case when {moved} then {image} else x end) else {block} end"


def _log_factorial(n: str) -> str:
    n = f"({n})"
    return f"case when {n} <= 20 then ln(factorial(cast({n} as int))) else ({n} + 0.5D) * ln({n}) - {n} + 0.9189385332046727D + 1 / (12D * {n}) - 1 / (360D * {n} * {n} * {n}) end"


def _hypergeometric(v: str) -> str:
    """SQL of a draw: of v.m blocks v.n are taken, v.good are of one kind; how many of those, at the quantile v.u.

    Weights are summed over ten deviations about the mean, each from the one before.
    """
    choose = lambda n, k: f"{_log_factorial(n)} - ({_log_factorial(k)}) - ({_log_factorial(f'{n} - ({k})')})"
    low, high = f"greatest(0L, {v}.n - ({v}.m - {v}.good))", f"least({v}.good, {v}.n)"
    mean = f"({v}.n * ({v}.good / {v}.m))"
    spread = f"(10 * sqrt({mean} * (1 - {v}.good / {v}.m)) + 10)"
    first, last = f"greatest({low}, cast({mean} - {spread} as bigint))", f"least({high}, cast({mean} + {spread} as bigint))"
    weight = f"exp({choose(f'{v}.good', 'r.a')} + {choose(f'({v}.m - {v}.good)', f'{v}.n - r.a')} - ({choose(f'{v}.m', f'{v}.n')}))"
    following = f"s.p * (({v}.good - k) * cast({v}.n - k as double)) / ((k + 1) * cast({v}.m - {v}.good - {v}.n + k + 1 as double))"
    walk = (
        f"aggregate(sequence(r.a, r.b), named_struct('x', cast(null as bigint), 'p', {weight}, 'sum', 0D),"
        f" (s, k) -> named_struct('x', coalesce(s.x, case when s.sum + s.p >= {v}.u then k end), 'p', case when k = r.b then 0D else {following} end, 'sum', s.sum + s.p), s -> coalesce(s.x, r.b))"
    )
    return f"case when {v}.good = 0 or {v}.n = 0 then 0L when {v}.good = {v}.m then {v}.n else transform(array(named_struct('a', {first}, 'b', {last})), r -> {walk})[0] end"


def split_quotas(quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """(key, starts): of the key's quota of draws, where each shard's begin.

    quotas: (key string, quota long), a row for each source. All of a node's quotas are one
    array, so what grows here is the number of sources.
    """
    node = quotas.agg(F.sort_array(F.collect_list(F.struct("key", F.col("quota").alias("n")))).alias("q"))
    node = node.select(F.lit(0).alias("first"), F.lit(n_shards).alias("shards"), "q")
    uniform = f"shiftrightunsigned(xxhash64({seed}L, first, shards, e.key), 11) / {float(1 << 53)}D"
    draw = f"transform(array(named_struct('m', s.m, 'good', e.n, 'n', s.n, 'u', {uniform})), v -> {_hypergeometric('v')})[0]"
    grown = f"transform(array({draw}), x -> named_struct('m', s.m - e.n, 'n', s.n - x, 'left', concat(s.left, array(x))))[0]"
    total = "aggregate(q, 0L, (a, e) -> a + e.n)"
    # blocks of a node are dealt to its shards as evenly as whole numbers allow
    start = f"named_struct('m', {total}, 'n', {total} * (shards div 2) div shards, 'left', cast(array() as array<bigint>))"
    while n_shards > 1:
        node = node.withColumn("left", F.expr(f"case when shards > 1 then aggregate(q, {start}, (s, e) -> {grown}, s -> s.left) end"))
        left = F.expr("named_struct('first', first, 'shards', shards div 2, 'q', transform(q, (e, i) -> named_struct('key', e.key, 'n', left[i])))")
        right = F.expr("named_struct('first', first + shards div 2, 'shards', shards - shards div 2, 'q', transform(q, (e, i) -> named_struct('key', e.key, 'n', e.n - left[i])))")
        halves = F.when(F.col("shards") > 1, F.array(left, right)).otherwise(F.array(F.struct("first", "shards", "q")))
        node = node.select(F.explode(halves).alias("h")).select("h.*")
        n_shards = -(-n_shards // 2)
    each = node.select("first", F.explode("q").alias("e")).select("first", "e.*")
    lists = each.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("l"))
    return lists.select("key", F.expr("aggregate(slice(l, 1, size(l) - 1), array(0L), (s, x) -> concat(s, array(element_at(s, -1) + x.n)))").alias("starts"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """`sources` (key, source_size) with `target`: `share` of all words by weight, at most `most` times a source's own.

    Weights go round in the order of the keys. What a source can't give is shared again by
    weight: targets are least(most * size, rate * weight) at the one rate that spends all words.
    """
    everything = Window.partitionBy()
    x = sources.withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)).cast("long"))
    x = x.withColumns({"cap": F.col("source_size") * most, "total": F.sum("source_size").over(everything).cast("double") * share})
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    full = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double")
    rate = (F.col("total") - full) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    x = x.withColumn("rate", rate).withColumn("rate", F.max(F.when(F.col("rate") * F.col("w") < F.col("cap"), F.col("rate"))).over(everything))
    return x.select("key", "source_size", F.least(F.col("cap").cast("double"), F.col("rate") * F.col("w")).alias("target"))


def _begins(cells: DataFrame, digits: int) -> DataFrame:
    """(key, cell, begin): a source's words before each cell; a task sums the cells of one shorter prefix."""
    before = lambda *by: F.coalesce(F.sum("words").over(Window.partitionBy(*by).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    if digits <= 2:
        return cells.select("key", "cell", before("key").alias("begin"))
    cells = cells.withColumn("over", F.substring("cell", 1, digits - 2))
    above = _begins(cells.groupBy("key", F.col("over").alias("cell")).agg(F.sum("words").alias("words")), digits - 2)
    above = above.select("key", F.col("cell").alias("over"), F.col("begin").alias("above"))
    return cells.withColumn("inner", before("key", "over")).join(above, ["key", "over"]).select("key", "cell", (F.col("above") + F.col("inner")).alias("begin"))


def _words(text: Column) -> Column:
    return F.char_length(F.expr(f"translate(regexp_replace({text}, '{WORD}', 'w'), ' \\t\\n\\u000b\\f\\r', '')")).cast("long")


def _order() -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.col("text"))))


def mix_sources(
    docs: DataFrame, n_shards: int = 40, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 13,
    id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", blocks_a_shard: int = BLOCKS_A_SHARD,
) -> DataFrame:
    """A row for each document: doc_id, source, size (words), source_size, target (words of its source) and draws.

    draws: an array of (shard, turn, start, length, place): the words of the document that the
    mix takes, as runs that lie in one block; `place` orders a shard's runs at random. A turn
    takes no word twice, and there are `most` turns at most. Each source's lengths add up to its
    target, rounded to a word. See `targets` for those; sources are ordered by code point, null last.

    A null text has no words and no draws, nor has an empty one; a null source is a source, a
    null id an id. Repeated rows are documents of their own (which of two alike lies first can't
    be told from the result). An empty table gives an empty table. Other columns are not read
    and may have any names. A text is held whole in its task with a shrunk copy. The order, the
    permutations and the quotas follow from ids, texts and `seed`, so reruns agree.
    """
    spark = docs.sparkSession
    scratch = C.Scratch(spark, "mixing")
    x = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = x.select("doc_id", "source", F.coalesce(F.concat(F.lit("a"), "source"), F.lit("z")).alias("key"), _words("text").alias("size"), _order().alias("o"))
    x = scratch.store(x, "sizes")
    rows, digits = x.count(), 2
    while 16**digits * CELL_ROWS < rows:
        digits += 1
    x = x.withColumn("cell", F.substring("o", 1, digits))
    cells = scratch.store(x.groupBy("key", "cell").agg(F.sum("size").alias("words")), "cells", narrow=True)

    facts = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")), weights, share, most)
    facts = facts.withColumn("goal", F.round("target").cast("long"))
    length = F.greatest(F.lit(1), F.ceil(F.sum("goal").over(Window.partitionBy()) / F.lit(float(n_shards * blocks_a_shard))))
    facts = facts.withColumn("block", length.cast("long"))
    turns = [F.least("source_size", F.greatest(F.col("goal") - F.col("source_size") * t, F.lit(0))) for t in range(most)]
    facts = facts.withColumn("turns", F.array(*turns))  # words that each turn takes
    facts = scratch.store(facts.withColumn("quota", F.expr("aggregate(turns, 0L, (a, w) -> a + cast(ceil(w / block) as bigint))")), "facts", narrow=True)
    facts = facts.join(scratch.store(split_quotas(facts.select("key", "quota"), n_shards, seed), "quotas", narrow=True), "key")

    begins = scratch.store(_begins(cells, digits).join(facts, "key"), "begins", narrow=True)
    x = x.join(begins, ["key", "cell"])
    inner = F.coalesce(F.sum("size").over(Window.partitionBy("key", "cell").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("at", F.col("begin") + inner)
    x = x.withColumn("blocks", F.expr("case when size > 0 then sequence(at div block, (at + size - 1) div block) else cast(array() as array<bigint>) end"))
    return x.select("doc_id", "source", "size", "source_size", "target", _draws(most, seed).alias("draws"))


def _draws(most: int, seed: int) -> Column:
    """The runs of a document's words that each turn takes, and the shard whose draw its block is."""
    per_turn, drawn = [], "0L"
    for t in range(most):
        # the last draw of a turn takes what is left to its goal
        width = f"case when p < turns[{t}] div block then block when p = turns[{t}] div block then turns[{t}] % block else 0L end"
        run = f"named_struct('p', p + {drawn}, 'start', greatest(i * block - at, 0L), 'end', least(i * block + {width} - at, size))"
        per_turn.append(
            f"transform(filter(transform(blocks, i -> transform(array({_position('i', '(source_size div block)', seed, t)}), p -> {run})[0]), d -> d.end > d.start),"
            f" d -> named_struct('shard', size(filter(starts, s -> s <= d.p)) - 1, 'turn', {t}, 'start', d.start, 'length', d.end - d.start, 'place', xxhash64({seed}L, {t}, o, d.start)))"
        )
        drawn = f"({drawn} + cast(ceil(turns[{t}] / block) as bigint))"
    return F.expr(f"concat({', '.join(per_turn)})")


def taken(draws: str = "draws") -> Column:
    """Words that the mix takes of a document, repeats counted."""
    return F.expr(f"aggregate({draws}, 0L, (a, d) -> a + d.length)")


def write_shards(docs: DataFrame, mixed: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Parquet by shard of the taken runs' words, joined by spaces: doc_id, turn, start, length, text, in a random order.

    mixed: of `mix_sources`; ids must be unique and not null. A shard is dealt over several
    tasks by its runs' places and sorted by them there, so each of its files is a sample of it.
    """
    runs = mixed.select("doc_id", F.explode("draws").alias("d")).select("doc_id", "d.*")
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    words = F.expr(f"array_join(slice(array_remove(split(t, '{SPACE}'), ''), cast(start + 1 as int), cast(length as int)), ' ')")
    out = runs.join(text, "doc_id").select("shard", "place", "doc_id", "turn", "start", "length", words.alias("text"))
    spread = out.withColumn("part", F.pmod("place", F.lit(4)))
    spread.repartition("shard", "part").sortWithinPartitions("shard", "place").drop("part").write.mode("overwrite").partitionBy("shard").parquet(path)


def oracle(n_shards: int = 40, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 13) -> str:
    """DuckDB SQL of each document's size, source_size, target and taken words."""
    args = ", ".join(f"({t}, {i}, {k}, {a}, {c})" for t in range(most) for i, (k, a, c) in enumerate(steps(seed, t)))
    image = "((g.k - x) % n + n) % n"
    goals = reduce(lambda a, t: f"{a} UNION ALL SELECT key, {t} turn, least(source_size, greatest(goal - source_size * {t}, 0)) w FROM f", range(1, most), "SELECT key, 0 turn, least(source_size, goal) w FROM f")
    return rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce('a' || source, 'z') AS key, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) size,
  md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))) o FROM documents),
s AS (SELECT key, CAST(SUM(size) AS BIGINT) source_size FROM d GROUP BY 1),
c AS (SELECT key, source_size, {list(weights)}[(row_number() OVER (ORDER BY key) - 1) % {len(weights)} + 1] w, source_size * {most} cap, CAST(SUM(source_size) OVER () AS DOUBLE) * {share} total FROM s),
r AS (SELECT *, (total - CAST(coalesce(SUM(cap) OVER (ORDER BY cap / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
  / CAST(SUM(w) OVER (ORDER BY cap / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) rate FROM c),
t AS (SELECT key, source_size, least(CAST(cap AS DOUBLE), MAX(CASE WHEN rate * w < cap THEN rate END) OVER () * w) target FROM r),
f AS (SELECT *, CAST(round(target) AS BIGINT) goal, CAST(greatest(1, ceil(SUM(round(target)) OVER () / {float(n_shards * BLOCKS_A_SHARD)})) AS BIGINT) block FROM t),
goals AS ({goals}),
step(turn, i, k, a, c) AS (VALUES {args}),
pos AS (SELECT key, g.turn, b, b x, source_size // block n, 0 i FROM (SELECT key, source_size, block, UNNEST(range(0, (source_size + block - 1) // block)) b FROM f) JOIN goals g USING (key)
  UNION ALL SELECT key, p.turn, b, CASE WHEN b < n AND ((greatest(x, {image}) + g.c) % {PRIME} * g.a % {PRIME}) // 32768 % 2 = 1 THEN {image} ELSE x END, n, p.i + 1 FROM pos p JOIN step g ON g.turn = p.turn AND g.i = p.i),
lined AS (SELECT *, coalesce(SUM(size) OVER (PARTITION BY key ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
runs AS (SELECT doc_id, o, key, size, CAST(start AS BIGINT) start, block, UNNEST(CASE WHEN size > 0 THEN range(CAST(start AS BIGINT) // block, (CAST(start AS BIGINT) + size - 1) // block + 1) ELSE [] END) b FROM lined JOIN f USING (key)),
took AS (SELECT doc_id, o, SUM(greatest(0, least(r.b * block + CASE WHEN x < w // block THEN block WHEN x = w // block THEN w % block ELSE 0 END, start + size) - greatest(r.b * block, start))) taken
  FROM runs r JOIN pos p ON p.key = r.key AND p.b = r.b AND p.i = {STEPS} JOIN goals g ON g.key = p.key AND g.turn = p.turn GROUP BY ALL)
SELECT d.doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM d JOIN f USING (key) LEFT JOIN took ON took.o = d.o AND took.doc_id IS NOT DISTINCT FROM d.doc_id"""
