"""op13 against plain definitions: targets, permutations, quotas, whole mixes, written shards."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from granary.llm import mixing as M

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """The wording: shares by weight, those above the limit stop there, the excess is shared again."""
    total, names = share * sum(sizes.values()), sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, open_ = dict.fromkeys(names, 0.0), set(names)
    while open_:
        rest = total - sum(out[s] for s in names if s not in open_)
        over = {s for s in open_ if rest * w[s] / sum(w[x] for x in open_) > most * sizes[s]}
        for s in open_:
            out[s] = float(most * sizes[s]) if s in over else rest * w[s] / sum(w[x] for x in open_)
        if not over:
            break
        open_ -= over
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, source string, text string, size int, target string")


def odd_rows():
    rows = [(i, ["b", "a", "é", None, "Z", ""][i % 6 if i % 4 else 0], " ".join(f"w{i}_{j}" for j in range(i * 7 % 90))) for i in range(150)]
    return [*rows, (None, "b", "an id that is null"), (3, "b", "an id twice"), (3, "b", "an id twice"), (500, "c", None), (501, "d", " \t\n"), (502, "a", "word " * 30_000)]


def test_mix(spark):
    rows = odd_rows()
    mixed = M.mix_sources(frame(spark, rows).repartition(3), n_shards=7)
    found = mixed.withColumn("taken", M.taken()).collect()
    sizes = defaultdict(int)
    for _, s, t in rows:
        sizes[s] += len(WORD.findall(t or ""))
    goal = plain_targets(sizes)
    took = Counter()
    assert len(found) == len(rows)
    for r in found:
        took[r.source] += r.taken
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source] and r.target == pytest.approx(goal[r.source])
        for turn in (0, 1):  # a turn takes no word twice
            runs = sorted((d.start, d.length) for d in r.draws if d.turn == turn)
            assert all(a + n <= b for (a, n), (b, _) in zip(runs, runs[1:], strict=False)) and all(0 <= a and a + n <= r.size for a, n in runs)
    assert {s: took[s] for s in sizes} == {s: round(goal[s]) for s in sizes}
    again = M.mix_sources(frame(spark, rows).repartition(5), n_shards=7)
    key = lambda r: str(sorted(tuple(d) for d in r.draws)) + str(r.doc_id)
    assert sorted(map(key, again.collect())) == sorted(map(key, found))


def test_shards_get_whole_quotas_of_even_size(spark):
    rows = [(i, f"s{i % 5}", " ".join(f"w{j}" for j in range(40 + i % 9))) for i in range(400)]
    found = M.mix_sources(frame(spark, rows), n_shards=6, blocks_a_shard=50).select(F.explode("draws").alias("d")).select("d.*")
    words = {r.shard: r.n for r in found.groupBy("shard").agg(F.sum("length").alias("n")).collect()}
    assert set(words) == set(range(6)) and max(words.values()) - min(words.values()) <= 0.05 * max(words.values())


def test_edge_tables(spark):
    empty = frame(spark, [])
    assert M.mix_sources(empty).count() == 0
    no_words = M.mix_sources(frame(spark, [(1, "a", None), (2, None, "")])).collect()
    assert [(r.size, r.target, r.draws) for r in no_words] == [(0, 0.0, [])] * 2
    one = M.mix_sources(frame(spark, [(1, "a", "three short words")]), n_shards=3).withColumn("taken", M.taken()).first()
    assert (one.target, one.taken) == (4.5, 5)


def test_positions_are_permutations(spark):
    for full in (1, 2, 7, 64, 1000):
        for turn in (0, 1):
            got = [r.p for r in spark.range(full + 1).select(F.expr(M._position("id", f"{full}L", 13, turn)).alias("p"), "id").orderBy("id").collect()]
            assert sorted(got) == list(range(full + 1)) and got[-1] == full
            assert full < 64 or got[:-1] != list(range(full))


def test_quotas_follow_the_hypergeometric_law(spark):
    quotas = spark.createDataFrame([("a", 700), ("b", 200), ("c", 0), ("d", 103)], "key string, quota long")
    shares = []
    for seed in range(40):
        starts = {r.key: r.starts for r in M.split_quotas(quotas, 5, seed).collect()}
        ends = {r.key: r.quota for r in quotas.collect()}
        per_shard = {k: [b - a for a, b in zip(s, [*s[1:], ends[k]], strict=True)] for k, s in starts.items()}
        assert all(len(v) == 5 and min(v) >= 0 and sum(v) == ends[k] for k, v in per_shard.items())
        totals = [sum(v[i] for v in per_shard.values()) for i in range(5)]
        assert max(totals) - min(totals) <= 1
        shares += per_shard["b"]
    mean = sum(shares) / len(shares)
    variance = sum((x - mean) ** 2 for x in shares) / len(shares)
    law = 200.6 * (200 / 1003) * (803 / 1003) * (1 - 200.6 / 1003) * 1003 / 1002
    assert mean == pytest.approx(40) and 0.7 * law < variance < 1.4 * law


def test_long_counts_stay_exact(spark):
    starts = {r.key: r.starts for r in M.split_quotas(spark.createDataFrame([("a", 10**7), ("b", 3 * 10**6)], "key string, quota long"), 4, 1).collect()}
    sizes = [b - a for a, b in zip(starts["a"], [*starts["a"][1:], 10**7], strict=True)]
    assert sum(sizes) == 10**7 and all(abs(n - 2_500_000) < 5_000 for n in sizes) and len(set(sizes)) > 1


def test_written_shards_hold_the_runs(spark, tmp_path):
    rows = [(i, f"s{i % 3}", " ".join(f"w{i}_{j}" for j in range(25))) for i in range(60)]
    docs = frame(spark, rows)
    mixed = M.mix_sources(docs, n_shards=4)
    M.write_shards(docs, mixed, str(tmp_path / "mix"))
    words = Counter()
    texts = {i: WORD.findall(t) for i, _, t in rows}
    for r in spark.read.parquet(str(tmp_path / "mix")).collect():
        assert r.text.split() == texts[r.doc_id][r.start : r.start + r.length]
        words[r.doc_id] += r.length
    assert words == Counter({r.doc_id: r.taken for r in mixed.withColumn("taken", M.taken()).collect() if r.taken})


def test_no_python_runs(spark):
    plan = M.mix_sources(frame(spark, odd_rows()), n_shards=3)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
