"""Canonical items and branches: code maps, names, categories, matching to outlets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed values of the item rules.
CATEGORY_SYNONYMS = {"Minuman": "Minuman - FG", "Snack": "Snack (FG)"}
CATEGORY_OVERRIDES = {"FGS-00014": "Minuman - FG"}
GRAM_FACTORS = {"FGS-00070": 40.0, "FGS-00071": 30.0}


def conditional_map(rows: DataFrame, transform: Callable[[Column], Column], code: str = "item", name: str = "item_name") -> DataFrame:
    """(code, mapped): codes that meet after `transform` are mapped only if all their names compare equal."""
    codes = rows.select(F.col(code).alias("code"), T.comparable_name(F.col(name)).alias("name")).where("code is not null").distinct()
    codes = codes.withColumn("to", transform(F.col("code")))
    groups = codes.groupBy("to").agg(F.count_distinct("name").alias("names"))
    return codes.select("code", "to").distinct().join(groups, "to").select("code", F.when(F.col("names") == 1, F.col("to")).otherwise(F.col("code")).alias("mapped"))


def code_map(rows: DataFrame, code: str = "item", name: str = "item_name") -> DataFrame:
    """Prefix pass, then separator pass on its codes, composed."""
    first = conditional_map(rows, T.strip_prefix, code, name)
    moved = rows.select(F.col(code).alias("code"), F.col(name).alias("name")).distinct().join(first, "code").select(F.col("mapped").alias("code"), "name")
    second = conditional_map(moved, T.unify_separator, "code", "name").select(F.col("code").alias("mapped"), F.col("mapped").alias("final"))
    return first.join(second, "mapped").select("code", F.col("final").alias("mapped"))


def apply_codes(rows: DataFrame, codes: DataFrame) -> DataFrame:
    m = codes.select(F.col("code").alias("item"), "mapped")
    return rows.join(m, "item", "left").withColumn("item", F.coalesce("mapped", "item")).drop("mapped").select(rows.columns)


def canonical_names(rows: DataFrame, order: str | None = None) -> DataFrame:
    """The first name of each code (by `order`, else the least) that has no prefix; codes without one keep theirs."""
    clean = F.when(~F.lower("item_name").startswith("xxx."), F.col("item_name"))
    pick = F.min_by(clean, F.when(clean.isNotNull(), F.col(order))) if order else F.min(clean)
    names = rows.groupBy("item").agg(pick.alias("__name"))
    return rows.join(names, "item", "left").withColumn("item_name", F.coalesce("__name", "item_name")).select(rows.columns)


def canonical_categories(rows: DataFrame, synonyms: dict[str, str] = CATEGORY_SYNONYMS, overrides: dict[str, str] = CATEGORY_OVERRIDES) -> DataFrame:
    """One category for codes whose synonyms agree; others stay as recorded; overrides last."""
    plain = F.col("category")
    for a, b in synonyms.items():
        plain = F.when(F.col("category") == a, b).otherwise(plain)
    agreed = rows.select("item", plain.alias("c")).groupBy("item").agg(F.count_distinct("c").alias("n"), F.min("c").alias("__one"))
    agreed = agreed.where("n = 1").select("item", "__one")
    out = F.coalesce(F.col("__one"), F.col("category"))
    for item, category in overrides.items():
        out = F.when(F.col("item") == item, category).otherwise(out)
    return rows.join(agreed, "item", "left").withColumn("category", out).select(rows.columns)


def exclude(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Rows whose value is none of `values`; null stays."""
    return rows.where(F.coalesce(~F.col(column).isin(values), F.lit(True)))


def rename_items(rows: DataFrame, renames: DataFrame) -> DataFrame:
    """renames: (code, new_code, new_name), one row for each code."""
    r = renames.select(F.col("code").alias("item"), "new_code", "new_name")
    out = rows.join(r, "item", "left").withColumns({"item_name": F.coalesce("new_name", "item_name"), "item": F.coalesce("new_code", "item")})
    return out.select(rows.columns)


def grams_to_portions(rows: DataFrame, factors: dict[str, float] = GRAM_FACTORS, unit: str = "Gr", portion: str = "Porsi") -> DataFrame:
    factor = F.lit(None).cast("double")
    for item, f in factors.items():
        factor = F.when((F.col("item") == item) & (F.col("unit") == unit), f).otherwise(factor)
    out = rows.withColumn("__f", factor)
    return out.withColumns({"qty": F.col("qty") / F.coalesce("__f", F.lit(1.0)), "unit": F.when(F.col("__f").isNotNull(), portion).otherwise(F.col("unit"))}).select(rows.columns)


#: Letters of the pieces by which names are indexed.
PIECE = 3


def _pieces(text: str, sizes: Column) -> Column:
    """All pieces of the text of these sizes, each once."""
    of = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(text) - n + 1)), lambda i: F.substring(F.col(text), i, n))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Each row of `needles` (with `needle`) with each row of `texts` (with `text`) that contains it.

    The texts' pieces of up to PIECE letters are an inverted index. A needle with a piece that
    no text has is in none; else the texts that have its rarest piece are searched.
    """
    index = texts.withColumn("piece", F.explode(_pieces("text", F.array(*map(F.lit, range(PIECE + 1))))))
    often = index.groupBy("piece").agg(F.count("*").alias("n"))
    size = F.array(F.least(F.lit(PIECE), F.char_length("needle")))
    wanted = needles.select("needle").distinct().withColumn("piece", F.explode(_pieces("needle", size)))
    found = wanted.join(often, "piece", "left").groupBy("needle").agg(F.bool_and(F.col("n").isNotNull()).alias("known"), F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    candidates = found.where("known").select("needle", "piece").join(index, "piece").where(F.col("text").contains(F.col("needle"))).drop("piece")
    return needles.join(candidates, "needle").drop("text")


def match_branches(branches: DataFrame, outlets: DataFrame, overrides: DataFrame) -> DataFrame:
    """(branch, outlet, city_override) of each distinct branch that has exactly one outlet.

    An override decides alone, even if its outlet is missing (then there is no match). Else
    the branch's needle must lie in exactly one outlet's name, upper and lower case alike.
    outlets has one row for each outlet. A needle is looked up by the rarest of its short pieces
    in an index of the outlets' names, so it meets only outlets that have that piece.
    """
    names = branches.select("branch").where("branch is not null").distinct()
    o = overrides.groupBy("branch").agg(F.min(F.struct("outlet", "city_override")).alias("o")).select("branch", F.col("o.outlet").alias("to"), "o.city_override")
    decided = names.join(o, "branch").join(outlets.select(F.col("outlet").alias("to")).distinct(), "to").select("branch", F.col("to").alias("outlet"), "city_override")
    free = names.join(o, "branch", "left_anti").withColumn("needle", F.lower(T.branch_needle(F.col("branch"))))
    hits = containing(free, outlets.select("outlet", F.lower("outlet").alias("text")))
    single = hits.groupBy("branch").agg(F.count("*").alias("n"), F.min("outlet").alias("outlet")).where("n = 1")
    return decided.unionByName(single.select("branch", "outlet", F.lit(None).cast("string").alias("city_override")))


def keep_matched(rows: DataFrame, matches: DataFrame) -> DataFrame:
    return rows.join(matches.select("branch"), "branch", "left_semi")


def canonical_branches(rows: DataFrame, matches: DataFrame) -> DataFrame:
    """Branches by their outlet's name; unmatched ones keep theirs."""
    return rows.join(matches.select("branch", "outlet"), "branch", "left").withColumn("branch", F.coalesce("outlet", "branch")).select(rows.columns)


def outlet_features(matches: DataFrame, outlets: DataFrame) -> DataFrame:
    """City and channels of each matched branch; can_order_online is null if any channel is."""
    out = matches.join(outlets, "outlet")
    flags = {c: T.yes(F.col(c)) for c in ("has_shopee", "has_gofood", "has_grabfood")}
    out = out.select("branch", "outlet", T.city(F.col("city_override"), F.col("city")).alias("city"), *[v.alias(k) for k, v in flags.items()])
    known = F.col("has_shopee").isNotNull() & F.col("has_gofood").isNotNull() & F.col("has_grabfood").isNotNull()
    return out.withColumn("can_order_online", F.when(known, F.col("has_shopee") | F.col("has_gofood") | F.col("has_grabfood")))


def add_outlet_features(rows: DataFrame, features: DataFrame) -> DataFrame:
    """Left join on branch: city 'Unknown' and null flags where unmatched."""
    return rows.join(features.drop("outlet"), "branch", "left").withColumn("city", F.coalesce("city", F.lit("Unknown")))
