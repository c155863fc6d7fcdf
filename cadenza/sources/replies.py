"""Stand-in ``llm_attempts(request_id, kind, attempt, raw_text)`` built from
``orders`` (SURVEY §7.1).

Per order: 1..4 criteria attempts (all but the last one broken), one
search-query reply and one title reply.  The reply texts are templates
whose placeholders are order columns; the same templates are rendered as
Spark ``concat`` expressions and as SQL ``||`` expressions, so that the
input text is byte-identical on both sides of the oracle check.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.sources.tables import read_table

FENCE = "```"

# Valid criteria replies, chosen by key % 7.
GOOD_CRITERIA = [
    '{"seed_genres": ["{g1}", "{g2}"], "seed_artists": ["{a1}"], "year_min": {ymin}, '
    '"year_max": {ymax}, "target_energy": 0.{e2}, "market": "{mk}", "limit": {lim}}',
    FENCE + 'json\n{"seed_genres": ["{g1}", "{g2}"], "seed_artists": ["{a1}"], "year_min": {ymin}, '
    '"year_max": {ymax}, "target_energy": 0.{e2}, "market": "{mk}", "limit": {lim}}\n' + FENCE,
    FENCE + '\n{"seed_genres": ["{g1}"], "year_min": "{ymin}", "target_tempo": {tempo}, "limit": {lim}}\n' + FENCE,
    '  {"seed_genres": ["a", "b", "c", "d", "e", "f", "{g1}"], "seed_artists": ["{a1}", "x"], '
    '"year_min": {y}.0, "notes": "with `live` cuts", "target_valence": null}  ',
    '{}',
    '{"year_min": "{y}.0", "year_max": 3000000000, "limit": {lim}}',
    '{"year_min": true, "year_max": "3000000000", "limit": "{lim}"}',
]
# Invalid criteria replies, chosen by (key + attempt) % 11.
BAD_CRITERIA = [
    'Sorry, no playlist for {prio}',
    '{"limit": 0}',
    '{"target_energy": 1.2}',
    '["{g1}"]',
    '{"year_min": {y}.5}',
    '{"limit": null}',
    '{"seed_genres": ["{g1}", 1]}',
    '{"limit": 3000000000}',
    '{"year_min": "99999999999999999999"}',
    '{"year_max": 99999999999999999999}',
    '{"year_min": "{y}.5"}',
]
# Search-query replies, chosen by key % 8.
QUERY_REPLIES = [
    '["genre:{t} year:{ymin}-{ymax}", "artist:Brand#{b} genre:{w}", "genre:{w} {n}", "{w} {n}", '
    '"genre:{t}", "artist:Brand#{b}", "genre:{t} year:1990-2010", "{n}"]',
    FENCE + 'json\n["genre:{t} {n}", "artist:Brand#{b}", "{w}"]\n' + FENCE,
    '["genre:{t}", 42]',
    '{"queries": ["genre:{t}"]}',
    '[]',
    'Here are some queries: genre:{t}',
    '["artist:\\"Guest {lim}0\\"", "artist:\\"guest {lim}5\\" year:0000-9999", "genre:\\"{t}\\" genre:{w} {n}", '
    '"year:{ymin}", "year:0000-9999", "genre:{t} genre:{w} {n} year:1980-2020"]',
    '["genre:' + "x" * 1200 + '", "year:2020-1990", "artist:\\"no such\\" {n}"]',
]
# Title replies, chosen by key % 7.
TITLE_REPLIES = [
    '{"title": "Mix {k}", "description": "Songs picked for request {k}"}',
    '{"title": "Only a title {k}"}',
    'Title: Mix {k}',
    FENCE + 'json\n{"description": "Evening set {k}"}\n' + FENCE,
    '["Mix {k}", "a list"]',
    '{"title": null, "description": "Null title {k}"}',
    '{"title": {k}, "description": ["x"]}',
]

# Catalogue vocabulary the query replies draw on.
TYPES = ["economy", "large", "medium", "promo", "small", "standard"]
WORDS = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]

_PH = re.compile(r"\{([a-z0-9]+)\}")


def _pieces(template: str):
    pos = 0
    for m in _PH.finditer(template):
        if m.start() > pos:
            yield ("lit", template[pos:m.start()])
        yield ("col", m.group(1))
        pos = m.end()
    if pos < len(template):
        yield ("lit", template[pos:])


def render_spark(template: str, cols: dict[str, Column]) -> Column:
    return F.concat(*[F.lit(v) if kind == "lit" else cols[v].cast("string")
                      for kind, v in _pieces(template)])


def render_sql(template: str, exprs: dict[str, str]) -> str:
    def lit(s):
        return "'" + s.replace("'", "''") + "'"
    parts = [lit(v) if kind == "lit" else f"CAST(({exprs[v]}) AS VARCHAR)" for kind, v in _pieces(template)]
    return "(" + " || ".join(parts) + ")"


def _pick_spark(templates, selector: Column, cols) -> Column:
    out = None
    for i, t in enumerate(templates):
        out = (F.when(selector == i, render_spark(t, cols)) if out is None
               else out.when(selector == i, render_spark(t, cols)))
    return out


def pick_sql(templates, selector: str, exprs) -> str:
    arms = " ".join(f"WHEN {i} THEN {render_sql(t, exprs)}" for i, t in enumerate(templates))
    return f"CASE {selector} {arms} END"


def _spark_columns() -> dict[str, Column]:
    k = F.col("o_orderkey")
    y = F.year("o_orderdate")
    vocab = lambda words, sel: F.element_at(F.array(*[F.lit(w) for w in words]), (sel + 1).cast("int"))
    return {
        "k": k, "y": y, "ymin": y - 1, "ymax": y + 1,
        "g1": F.concat(F.lit("prio-"), F.substring("o_orderpriority", 1, 1)),
        "g2": F.concat(F.lit("status-"), F.lower("o_orderstatus")),
        "a1": F.concat(F.lit("artist:"), F.col("o_custkey").cast("string")),
        "e2": F.lpad((k % 100).cast("string"), 2, "0"),
        "mk": F.when(k % 2 == 0, F.lit("FR")).otherwise(F.lit("US")),
        "lim": k % 6 + 1, "tempo": k % 100 + 60,
        "prio": F.col("o_orderpriority"),
        "t": vocab(TYPES, k % 6), "w": vocab(WORDS, k % 8), "n": vocab(NOUNS, (k / 8).cast("bigint") % 8),
        "b": k % 25 + 1,
    }


def sql_columns() -> dict[str, str]:
    def vocab(words, sel):
        return "[" + ", ".join(f"'{w}'" for w in words) + f"][({sel}) + 1]"
    return {
        "k": "o_orderkey", "y": "year(o_orderdate)", "ymin": "year(o_orderdate) - 1",
        "ymax": "year(o_orderdate) + 1",
        "g1": "'prio-' || substr(o_orderpriority, 1, 1)",
        "g2": "'status-' || lower(o_orderstatus)",
        "a1": "'artist:' || o_custkey",
        "e2": "lpad(CAST(o_orderkey % 100 AS VARCHAR), 2, '0')",
        "mk": "CASE WHEN o_orderkey % 2 = 0 THEN 'FR' ELSE 'US' END",
        "lim": "o_orderkey % 6 + 1", "tempo": "o_orderkey % 100 + 60",
        "prio": "o_orderpriority",
        "t": vocab(TYPES, "o_orderkey % 6"), "w": vocab(WORDS, "o_orderkey % 8"),
        "n": vocab(NOUNS, "(o_orderkey // 8) % 8"),
        "b": "o_orderkey % 25 + 1",
    }


def llm_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read_table(spark, sf_dir, "orders",
                   ["o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus"])
    cols = _spark_columns()
    k = F.col("o_orderkey")
    n_attempts = (k % 4 + 1).cast("int")
    crit = o.select("*", F.explode(F.sequence(F.lit(1), n_attempts)).alias("attempt"))
    crit_text = F.when(F.col("attempt") < n_attempts,
                       _pick_spark(BAD_CRITERIA, (k + F.col("attempt")) % len(BAD_CRITERIA), cols)) \
        .otherwise(_pick_spark(GOOD_CRITERIA, k % len(GOOD_CRITERIA), cols))
    crit = crit.select(k.alias("request_id"), F.lit("criteria").alias("kind"), "attempt",
                       crit_text.alias("raw_text"))
    queries = o.select(k.alias("request_id"), F.lit("queries").alias("kind"), F.lit(1).alias("attempt"),
                       _pick_spark(QUERY_REPLIES, k % len(QUERY_REPLIES), cols).alias("raw_text"))
    titles = o.select(k.alias("request_id"), F.lit("title").alias("kind"), F.lit(1).alias("attempt"),
                      _pick_spark(TITLE_REPLIES, k % len(TITLE_REPLIES), cols).alias("raw_text"))
    return crit.unionByName(queries).unionByName(titles)


def llm_attempts_sql() -> str:
    """The same table as a DuckDB CTE named ``attempts``."""
    e = sql_columns()
    bad = pick_sql(BAD_CRITERIA, f"(o_orderkey + attempt) % {len(BAD_CRITERIA)}", e)
    good = pick_sql(GOOD_CRITERIA, f"o_orderkey % {len(GOOD_CRITERIA)}", e)
    return f"""
attempts AS (
  SELECT o_orderkey AS request_id, 'criteria' AS kind, CAST(attempt AS INTEGER) AS attempt,
         CASE WHEN attempt < o_orderkey % 4 + 1 THEN {bad} ELSE {good} END AS raw_text
  FROM (SELECT *, unnest(range(1, CAST(o_orderkey % 4 + 2 AS BIGINT))) AS attempt FROM orders)
  UNION ALL
  SELECT o_orderkey, 'queries', 1, {pick_sql(QUERY_REPLIES, f"o_orderkey % {len(QUERY_REPLIES)}", e)} FROM orders
  UNION ALL
  SELECT o_orderkey, 'title', 1, {pick_sql(TITLE_REPLIES, f"o_orderkey % {len(TITLE_REPLIES)}", e)} FROM orders)"""
