"""DuckDB SQL for the operators' queries that SQL can express."""

from __future__ import annotations

from . import mixing, rolling_median
from .rules import BOILERPLATE, CAPITALS, CLOSED, LOST_SHARE, SEPARATORS, SYMBOL_SHARE, SYMBOLS

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array({{}}, '{SPACE}'), lambda x: x <> '')"


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _shingles(name: str, table: str, key: str) -> str:
    """CTEs of a table's distinct five-word shingles; fewer words are one shingle."""
    return f"""{name}_w AS (SELECT {key}, {WORDS.format(LOWER.format('text'))} w FROM {table}),
{name} AS (SELECT DISTINCT {key}, UNNEST(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) s FROM {name}_w)"""


OP1 = f"""WITH RECURSIVE {_shingles('sh', 'documents', 'doc_id')},
n AS (SELECT doc_id, COUNT(*) n FROM sh GROUP BY 1),
pairs AS (SELECT a.doc_id a, b.doc_id b, COUNT(*) c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
two AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT a, b FROM two UNION SELECT r.a, e.b FROM reach r JOIN two e ON e.a = r.b),
least AS (SELECT a doc_id, MIN(b) m FROM reach GROUP BY 1)
SELECT d.doc_id, COALESCE(n.n, 0) AS n_shingles, COALESCE(LEAST(m, d.doc_id), d.doc_id) AS component_id, d.doc_id = COALESCE(LEAST(m, d.doc_id), d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least ON least.doc_id = d.doc_id"""

OP5 = """WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) n, sha1(encode(coalesce(html, ''))) d FROM pages),
m AS (SELECT d, MAX(page_id) o FROM h WHERE n >= 1000 GROUP BY 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 1000 AND page_id <> o THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN n >= 1000 AND page_id <> o THEN o END AS refers_to FROM h LEFT JOIN m USING (d)"""

OP6 = f"""WITH {_shingles('sd', 'documents', 'doc_id')}, {_shingles('si', 'benchmark', 'item_id')},
n AS (SELECT item_id, COUNT(*) n FROM si GROUP BY 1), c AS (SELECT doc_id, item_id, COUNT(*) c FROM sd JOIN si USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, c AS n_common, n AS n_item FROM c JOIN n USING (item_id) WHERE 100 * c >= 80 * n"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_FAILS = f"""(right(rtrim(l, {_BLANKS}), 1) NOT IN ({', '.join(map(_quote, CLOSED))})
  OR (NOT regexp_matches(l, '[a-z]') AND regexp_matches(l, '^(?:[^A-Z]*[A-Z]){{{CAPITALS}}}'))
  OR 100 * len(regexp_extract_all(l, '{SYMBOLS}')) > {SYMBOL_SHARE} * length(l)
  OR len(regexp_extract_all(l, ' [|»] ')) >= {SEPARATORS}
  OR {' OR '.join(f'contains(lower(l), {_quote(p)})' for p in BOILERPLATE)})"""
OP7 = f"""WITH t AS (SELECT doc_id, coalesce(text, '') text, {WORDS.format("coalesce(text, '')")} w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') s FROM (SELECT doc_id, w, UNNEST(range(1, len(w) - 3)) i FROM t)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, COUNT(*) OVER (PARTITION BY doc_id, s) c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, COUNT(DISTINCT i + k) n FROM again, range(5) r(k) GROUP BY 1),
lines AS (SELECT doc_id, l FROM (SELECT doc_id, UNNEST(string_split(text, chr(10))) l FROM t) WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
ls AS (SELECT doc_id, COUNT(*) - COUNT(DISTINCT l) dup, COALESCE(SUM(length(regexp_replace(l, '{SPACE}', '', 'g'))) FILTER (WHERE {_FAILS}), 0) lost FROM lines GROUP BY 1),
b AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length(array_to_string(w, '')) AS BIGINT) word_chars, CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) n_symbols,
  CAST(COALESCE(dup, 0) AS BIGINT) n_dup_lines, CAST(COALESCE(cov.n, 0) AS BIGINT) n_repeat_words, COALESCE(lost, 0) lost FROM t LEFT JOIN cov ON cov.doc_id = t.doc_id LEFT JOIN ls ON ls.doc_id = t.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 100 * lost <= {LOST_SHARE} * word_chars AS kept FROM b"""

OP11 = f"""WITH t AS (SELECT doc_id, coalesce(lang, '') part, coalesce(text, '') text, {WORDS.format("coalesce(text, '')")} w FROM documents),
m AS (SELECT doc_id, part, CAST(len(w) < 100 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 80 * len(w) AS INT) + 4 * CAST(100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS INT)
  + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INT) + 16 * CAST(coalesce(MIN(doc_id) OVER (PARTITION BY text) < doc_id, FALSE) AS INT) fails FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) good, bool_or(toxic = 1) toxic FROM labels GROUP BY 1),
c AS (SELECT part, fails, COUNT(*) n, COUNT(*) FILTER (WHERE good) g, COUNT(*) FILTER (WHERE toxic) x FROM m LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
f(f, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT a.f || b.f || c.f || d.f || e.f filter_order FROM f a, f b, f c, f d, f e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, f, bit, (SELECT coalesce(SUM(y.bit), 0) FROM f y WHERE contains(left(filter_order, step - 1), y.f)) before FROM o, range(1, 6) r(step), f WHERE f = substr(filter_order, step, 1)),
r AS (SELECT part, filter_order, CAST(step AS INT) step, f, SUM(CASE WHEN fails & CAST(before + bit AS INT) = 0 THEN n ELSE 0 END) kept, SUM(CASE WHEN fails & bit > 0 AND fails & CAST(before AS INT) = 0 THEN n ELSE 0 END) removed,
  SUM(CASE WHEN fails & bit > 0 AND fails & CAST(before AS INT) > 0 THEN n ELSE 0 END) redundant, SUM(CASE WHEN fails = bit THEN n ELSE 0 END) unique_fails,
  SUM(CASE WHEN fails & bit > 0 AND fails & CAST(before AS INT) = 0 THEN g ELSE 0 END) good_lost, SUM(CASE WHEN fails & bit > 0 AND fails & CAST(before AS INT) = 0 THEN x ELSE 0 END) toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails,
CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(SUM(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley FROM r"""

SQL = {"op1_minhash_near_dedup": OP1, "op5_warc_revisits": OP5, "op6_benchmark_decontamination": OP6, "op7_line_rules": OP7, "op11_filter_interactions": OP11, "op12_rolling_median": rolling_median.oracle(), "op13_source_mixing": mixing.oracle()}
