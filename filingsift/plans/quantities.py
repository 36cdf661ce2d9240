"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingsift.operators.quantities import hidden_units, quantities
from filingsift.sources.tables import table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return quantities(table(spark, folder, "questions"), table(spark, folder, "blocks")).where("status = 'stated'").select("record_id", "measure", "amount")


def p2_converted(spark: SparkSession, folder: str) -> DataFrame:
    return quantities(table(spark, folder, "questions"), table(spark, folder, "blocks"))


def p2_hidden(spark: SparkSession, folder: str) -> DataFrame:
    """How well hidden units are predicted, by unit."""
    return hidden_units(table(spark, folder, "questions"), table(spark, folder, "blocks"))


QUERIES = {f.__name__: f for f in (p2_found, p2_converted, p2_hidden)}

# Spellings stand between non-letters: RE2 has no look-around, so texts are padded and neighbours are matched instead.
_N = r"(\d[\d,]*(?:\.\d+)?|\.\d+)"


def _unit(x: str) -> str:
    near = lambda words: f"regexp_matches(' ' || lower({x}) || ' ', '[^a-z](?:{words})[^a-z]')"
    return f"""CASE WHEN contains({x}, '%') THEN 'percent' WHEN {near('bps?|basis[ _]?points?')} THEN 'bps' WHEN {near('percent|pct')} THEN 'percent' WHEN {near('fractions?')} THEN 'fraction'
WHEN {near('billions?|bn|b')} THEN 'usd_billions' WHEN {near('millions?|mm|mn|m')} THEN 'usd_millions' WHEN {near('thousands?|k')} OR regexp_matches(' ' || lower({x}), '[^0-9]000s') THEN 'usd_thousands'
WHEN {near('dollars?|usd|whole')} OR contains({x}, '$') THEN 'usd' END"""


def _negative(x: str) -> str:
    return f"regexp_matches({x}, '(?i)\\([^)]*\\d|(?:^|[^\\w.])[-−–]\\s*\\$?\\s*\\d|(?:^|[^a-z])loss')"


def _brackets(x: str) -> str:
    return f"nullif(array_to_string(regexp_extract_all({x}, '\\(([^()]*)\\)', 1), ' ; '), '')"


SQL: dict[str, str] = {
    "p2_found": f"""WITH q AS (SELECT DISTINCT id, nullif(trim(expected.answer), '') AS a, expected.value AS v, expected.unit AS u, regexp_extract(question, '(?i)\\(state[^()]* in ([^()]*)\\)\\s*$', 1) AS s FROM questions WHERE lower(trim(type)) = 'numeric'),
qa AS (SELECT id AS record_id, coalesce(abs(v)::VARCHAR, replace(regexp_extract(a, '{_N}', 1), ',', '')) AS raw, CASE WHEN v IS NOT NULL THEN v < 0 ELSE coalesce({_negative('a')}, false) END AS neg,
  CASE WHEN v IS NOT NULL THEN coalesce({_unit('u')}, {_unit('a')}, {_unit('s')}) ELSE coalesce({_unit('a')}, {_unit('u')}, {_unit('s')}) END AS unit FROM q),
b AS (SELECT DISTINCT doc_id || ':p' || page_index || ':b' || block_no AS record_id, title, units, string_split(text, chr(10)) AS l FROM blocks WHERE lower(trim(kind)) = 'table' AND text IS NOT NULL),
t AS (SELECT *, list_filter(l, lambda x: regexp_matches(x, '(?i)^\\s*\\|\\s*total'))[1] AS tot, list_filter(l, lambda x: regexp_matches(x, '^\\s*\\|'))[1] AS head, array_to_string(list_filter(l, lambda x: NOT regexp_matches(x, '^\\s*\\|')), ' ; ') AS note FROM b),
c AS (SELECT *, list_filter(string_split(regexp_replace(regexp_replace(tot, '^\\s*\\|', ''), '\\|\\s*$', ''), '|')[2:], lambda x: regexp_matches(x, '\\d'))[1] AS cell FROM t WHERE tot IS NOT NULL),
ba AS (SELECT record_id, replace(regexp_extract(trim(cell), '{_N}', 1), ',', '') AS raw, {_negative('trim(cell)')} AS neg,
  coalesce({_unit("replace(cell, '$', '')")}, {_unit('units')}, {_unit(_brackets('title'))}, {_unit(_brackets('head'))}, {_unit("(regexp_extract(note, '(?i)(?:^|[^a-z])in ([^.;()]*)', 1) || ' ; ' || coalesce(" + _brackets('note') + ", ''))")}, {_unit('cell')}) AS unit FROM c WHERE cell IS NOT NULL),
r AS (SELECT record_id, TRY_CAST(raw AS DECIMAL(24, 9)) AS raw, neg, unit FROM (SELECT * FROM qa UNION ALL SELECT * FROM ba) WHERE unit IS NOT NULL),
f AS (SELECT * FROM (VALUES ('bps', 1), ('percent', 100), ('fraction', 10000), ('usd', 1), ('usd_thousands', 1000), ('usd_millions', 1000000), ('usd_billions', 1000000000)) v(unit, factor))
SELECT record_id, CASE WHEN unit LIKE 'usd%' THEN 'usd' ELSE 'bps' END AS measure, round(raw * factor::DECIMAL(12, 0))::BIGINT * CASE WHEN neg THEN -1 ELSE 1 END AS amount FROM r JOIN f USING (unit) WHERE raw IS NOT NULL AND record_id IS NOT NULL""",
}
