"""SQL for the checks: the same catalog and functions as DuckDB expressions."""

from __future__ import annotations

NORM = r"trim(regexp_replace(replace(lower({0}), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"

CATALOG = f"""
book AS (
  SELECT p_partkey AS id, p_name AS title, CASE WHEN p_size % 4 = 0 THEN 'de' ELSE 'en' END AS lang, p_size % 10 <> 0 AS approved,
    p_partkey % 17 = 0 AS duplicate_hidden, p_brand AS series, p_type AS genre, {NORM.format("p_name")} AS norm_title FROM part),
author AS (SELECT s_suppkey AS id, s_name AS full_name, {NORM.format("s_name")} AS norm_name FROM supplier),
book_author AS (SELECT l_partkey AS book_id, l_suppkey AS author_id FROM lineitem),
favorite AS (SELECT o_custkey AS user_id, l_partkey AS book_id, min(l_orderkey * 10 + l_linenumber) AS id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
collection_book AS (SELECT l_suppkey % 20 AS book_collection_id, l_partkey AS book_id, min(l_orderkey * 10 + l_linenumber) AS position FROM lineitem WHERE l_quantity > 45 GROUP BY 1, 2)
"""


def ordered(x: str) -> str:
    """Trigrams of words between single blanks, in order."""
    return f"flatten([[substring('  ' || w || ' ', i, 3) for i in range(1, length(w) + 2)] for w in string_split({x}, ' ') if w <> ''])"


def tri(x: str) -> str:
    return f"list_distinct({ordered(x)})"


def overlap(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"


def extent(a: str, t: str) -> str:
    """The best overlap of set a with a run of list t."""
    e = f"list_distinct({t}[i:j])"
    c = f"len(list_intersect({e}, {a}))"
    return f"coalesce(list_max(flatten([[{c} / (len({a}) + len({e}) - {c}) for j in range(i, len({t}) + 1)] for i in range(1, len({t}) + 1)])), 0.0)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def word_list(needle: str) -> str:
    return "[" + ", ".join(map(quoted, needle.split(" "))) + "]"


def signals_sql(needle: str, source: str = "visible") -> str:
    """CTEs titles and signals over source (id, norm_title): scores are worked out once per title."""
    q, fuzzy = quoted(needle), len(needle) >= 3
    spread = fuzzy and " " in needle and max(map(len, needle.split(" "))) >= 3
    have, want = "string_split(norm_title, ' ')", word_list(needle)
    all_words = f"len([w for w in {want} if len([t for t in {have} if starts_with(t, w)]) = 0]) = 0" if spread else "false"
    reverse = f"len([t for t in {have} if len([w for w in {want} if starts_with(t, w)]) = 0]) = 0" if spread else "false"
    return f"""
needle AS (SELECT {tri(q)} AS a),
titles AS (SELECT norm_title, {ordered("norm_title")} AS t, {tri("norm_title")} AS s FROM (SELECT DISTINCT norm_title FROM {source})),
scored AS (
  SELECT norm_title, norm_title = {q} AS exact, starts_with(norm_title, {q}) AS prefix, contains(norm_title, {q}) AS substring, {all_words} AS all_words,
    {all_words} AND {reverse} AS word_set, nullif(strpos(norm_title, {q}), 0) AS position, abs(length(norm_title) - {len(needle)}) AS length_delta,
    ({extent("a", "t") if fuzzy else "0.0"})::FLOAT AS word_score, ({overlap("a", "s") if fuzzy else "0.0"})::FLOAT AS trigram_score
  FROM titles, needle),
signals AS (SELECT v.id, c.* FROM {source} v JOIN scored c USING (norm_title))"""


ORDER = "exact DESC, prefix DESC, word_set DESC, substring DESC, all_words DESC, word_score DESC, trigram_score DESC, position ASC NULLS LAST, length_delta, favorite_count DESC, id"


def search_sql(needle: str, where: str = "approved AND NOT duplicate_hidden", limit: int = 100, offset: int = 0) -> str:
    return f"""
WITH {CATALOG}, visible AS (SELECT id, norm_title FROM book b WHERE {where}), {signals_sql(needle)},
admitted AS (
  SELECT s.*, coalesce(f.n, 0) AS favorite_count FROM signals s LEFT JOIN (SELECT book_id, count(*) AS n FROM favorite GROUP BY 1) f ON f.book_id = s.id
  WHERE (prefix OR substring OR all_words OR word_score >= 0.6 OR trigram_score >= 0.5) AND (exact OR prefix OR word_set OR substring OR all_words OR word_score >= 0.6 OR trigram_score >= 0.3)),
page AS (SELECT id, row_number() OVER (ORDER BY {ORDER}) AS pos FROM admitted)
SELECT p.id, p.pos::BIGINT AS pos, m.total::BIGINT AS total, md5({quoted(needle)}) AS query_hash
FROM (SELECT count(*) AS total FROM admitted) m LEFT JOIN (SELECT * FROM page WHERE pos > {offset} AND pos <= {offset + limit}) p ON true"""


def books_per_author_sql(where: str = "approved AND NOT duplicate_hidden") -> str:
    return f"SELECT ba.author_id, count(*) AS books FROM book_author ba JOIN book b ON b.id = ba.book_id WHERE {where} GROUP BY 1"
