"""Line-first quality rules, in DataFrame operations only.

Each line with a word is judged alone: its closing punctuation, shouting, symbols, navigation
separators and boilerplate phrases. Failing lines go; a document is rejected if too large a
share of its text goes with them. Base statistics come from the whole text: windows of five
words that may be repeated are found by sorting, in the row, the windows' hashes with their
positions packed into the low bits, and settled by sorting their words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[\\x20\\x09-\\x0D]+"
WORD = r"[^\\x20\\x09-\\x0D]"
#: Fixed values of the line rules.
SYMBOLS = "[#*$%&|<>]"
CLOSED = ".!?:;\"'”’»)…"
BOILERPLATE = [
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie", "javascript",
    "lorem ipsum", "click here", "sign up", "log in", "subscribe", "licensed under", "released under the",
]
CAPITALS = 10
SYMBOL_SHARE = 4
SEPARATORS = 3
LOST_SHARE = 50


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _fails(line: str) -> str:
    """SQL that is true where the line fails a rule: not closed, all capitals, symbols, navigation, boilerplate.

    Cheap tests guard the costly ones; boiler says whether the text has any phrase at all.
    """
    last = f"substring(rtrim(' \\t\\n\\u000b\\f\\r', {line}), -1)"
    phrases = " or ".join(f"contains(lower({line}), {_sql(p)})" for p in BOILERPLATE)
    return (
        f"({last} not in ({', '.join(_sql(c) for c in CLOSED)})"
        f" or (not {line} rlike '[a-z]' and {line} rlike '^(?:[^A-Z]*[A-Z]){{{CAPITALS}}}')"
        f" or (marked and 100 * regexp_count({line}, '{SYMBOLS}') > {SYMBOL_SHARE} * char_length({line}))"
        f" or ((contains({line}, '|') or contains({line}, '»')) and regexp_count({line}, ' [|»] ') >= {SEPARATORS})"
        f" or (boiler and ({phrases})))"
    )


def line_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: str = "xxhash64({})") -> DataFrame:
    """Statistics, the cleaned text and the verdict of each document.

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines,
    n_failed_lines, n_failed_chars, clean_text (the lines that pass), base_failed, kept.

    A null text has no words, so it fails the base rules (fewer than ten words); its
    clean_text is empty. Lines without a word are neither judged nor duplicates and stay in
    clean_text. Ids may be null or repeat: each row is judged alone. A text is held whole in
    its task, with its words and eight bytes a word. An empty table gives an empty table; other
    columns are not read and may have any names. hash_of: the SQL hash, of five words, that
    proposes repeated windows; the result does not depend on it.
    """
    e = F.expr
    x = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    x = x.withColumn("lower", F.lower("text"))
    x = x.select(
        "doc_id",
        "text",
        e(f"array_remove(split(text, '{SPACE}'), '')").alias("words"),
        e("split(text, '\\n')").alias("all_lines"),
        e(f"cast(regexp_count(text, '{SYMBOLS}') as bigint)").alias("n_symbols"),
        e(" or ".join(f"contains(lower, {_sql(p)})" for p in BOILERPLATE)).alias("boiler"),
    )
    x = x.withColumns({"n": F.size("words"), "lines": e(f"filter(all_lines, l -> l rlike '{WORD}')"), "marked": e("n_symbols > 0")})
    window = ", ".join(f"get(words, i + {j})" for j in range(5))
    x = x.withColumn("hashes", e(f"case when n >= 5 then transform(sequence(0, n - 5), i -> cast({hash_of.format(window)} as bigint)) end"))
    x = x.withColumns({"bits": F.length(F.bin("n")), "failed": e(f"filter(lines, l -> {_fails('l')})")})
    # only texts with a repeated window sort theirs
    x = x.withColumn("packed", e("case when size(array_distinct(hashes)) < size(hashes) then sort_array(transform(hashes, (h, i) -> shiftleft(h, bits) | cast(i as bigint))) end"))
    same = "shiftright(p, bits) = shiftright(get(packed, k {} 1), bits)"
    x = x.withColumn("twice", e(f"filter(packed, (p, k) -> {same.format('-')} or {same.format('+')})"))
    # the hash only proposes; what is repeated is decided by the words
    one = ", ".join(f"get(words, cast(p & (shiftleft(1L, bits) - 1) as int) + {j})" for j in range(5))
    x = x.withColumn("said", e(f"case when size(twice) > 0 then sort_array(transform(twice, p -> struct(concat_ws(' ', {one}) as s, p & (shiftleft(1L, bits) - 1) as i))) end"))
    x = x.withColumn("at", e("sort_array(transform(filter(said, (p, k) -> p.s = get(said, k - 1).s or p.s = get(said, k + 1).s), p -> p.i))"))
    covered = "aggregate(at, struct(-5L as last, 0L as n), (a, i) -> struct(i as last, a.n + least(5L, i - a.last) as n)).n"
    x = x.select(
        "doc_id",
        F.col("n").cast("long").alias("n_words"),
        e("cast(char_length(array_join(words, '')) as bigint)").alias("word_chars"),
        "n_symbols",
        e("cast(size(lines) - size(array_distinct(lines)) as bigint)").alias("n_dup_lines"),
        e(f"coalesce(case when size(at) > 0 then {covered} end, 0L)").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size("failed").cast("long").alias("n_failed_lines"),
        e(f"cast(char_length(regexp_replace(array_join(failed, ' '), '{SPACE}', '')) as bigint)").alias("n_failed_chars"),
        e(f"array_join(filter(all_lines, l -> not (l rlike '{WORD}' and {_fails('l')})), '\\n')").alias("clean_text"),
    )
    x = x.withColumn("base_failed", e("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    return x.withColumn("kept", e(f"not base_failed and 100 * n_failed_chars <= {LOST_SHARE} * word_chars"))
