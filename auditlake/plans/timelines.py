"""Queries over times and spans: prices in force, overlapping spans, call chains to entries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from auditlake.operators import frames as W, graph as G, intervals as I, search as Q, sketches as K, symbols as S
from auditlake.plans.corpus import _CALLS, _EDGES, _SPANS, _entries, quote
from auditlake.plans.evaluation import JUDGED, judged
from auditlake.plans.registry import query
from auditlake.session import scratch_path

_CHANGES = """ch AS (SELECT model_name, created_at AS valid_from, max(tokens_out) AS price FROM llm_log
      WHERE phase = 'scan' AND log_id % 3 = 0 GROUP BY ALL)"""


def _changes(t):
    return t.llm_log.where("phase = 'scan' AND log_id % 3 = 0").selectExpr("model_name", "created_at AS valid_from", "tokens_out AS price")


@query(
    "j17_price_as_of_call",
    f"""WITH {_CHANGES} SELECT log_id, l.model_name, created_at, tokens_in, valid_from, price FROM llm_log l ASOF LEFT JOIN ch
      ON l.model_name = ch.model_name AND l.created_at >= ch.valid_from""",
)
def j17_as_of(t):
    calls = t.llm_log.select("log_id", "model_name", "created_at", "tokens_in")
    return I.as_of_join(calls, _changes(t), ["model_name"], "created_at", "valid_from", ["valid_from", "price"], ["price"])


@query(
    "a13_cost_as_of_call",
    f"""WITH {_CHANGES} SELECT l.model_name, count(*) AS calls, count(price) AS priced, CAST(sum(tokens_in * price) AS BIGINT) AS cost
      FROM llm_log l ASOF LEFT JOIN ch ON l.model_name = ch.model_name AND l.created_at >= ch.valid_from GROUP BY ALL""",
)
def a13_as_of(t):
    calls = t.llm_log.select("model_name", "created_at", "tokens_in")
    priced = I.as_of_join(calls, _changes(t), ["model_name"], "created_at", "valid_from", ["price"])
    return priced.groupBy("model_name").agg(
        F.count(F.lit(1)).alias("calls"), F.count("price").alias("priced"), F.sum(F.expr("tokens_in * price")).alias("cost")
    )


@query(
    "j1_span_overlap",
    """SELECT finding_id, f.file_id, line_number, line_number + finding_id % 90 AS last_line, chunk_id, start_line, end_line
      FROM findings f JOIN chunks c ON f.file_id = c.file_id AND line_number <= end_line AND start_line <= line_number + finding_id % 90""",
)
def j1_overlap(t):
    found = t.findings.selectExpr("finding_id", "file_id", "line_number", "line_number + finding_id % 90 AS last_line")
    return I.overlap_join(
        found, t.chunks.select("file_id", "chunk_id", "start_line", "end_line"), ["file_id"], ("line_number", "last_line"), ("start_line", "end_line")
    )


@query(
    "j1_function_chunks",
    f"""WITH {_SPANS} SELECT s.file_id, s.name, CAST(s.start_line AS INT) AS first, CAST(s.end_line AS INT) AS last, c.chunk_id
      FROM symbols s JOIN chunks c ON s.file_id = c.file_id AND s.start_line <= c.end_line AND c.start_line <= s.end_line""",
)
def j1_functions(t):
    functions = S.symbol_table(t.code_files).selectExpr("file_id", "name", "start_line AS first", "end_line AS last")
    chunks = t.chunks.select("file_id", "chunk_id", "start_line", "end_line")
    return I.overlap_join(functions, chunks, ["file_id"], ("first", "last"), ("start_line", "end_line")).drop("start_line", "end_line")


_REACH = """WITH RECURSIVE {defs} r AS (SELECT DISTINCT f AS function, f AS node, 0 AS depth FROM (SELECT callee AS f FROM {e} UNION SELECT caller FROM {e})
      UNION SELECT r.function, x.caller, r.depth + 1 FROM r JOIN {e} x ON x.callee = r.node WHERE r.depth < {most} AND NOT {is_entry}),
    m AS (SELECT function, node AS entry, min(depth) AS depth FROM r WHERE {is_entry} GROUP BY ALL)"""


@query(
    "c9_nearest_entry",
    _REACH.format(defs="e AS (SELECT DISTINCT caller, callee FROM edges),", e="e", most=100, is_entry="r.node % 17 = 0")
    + """, n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY function ORDER BY depth, entry) = 1)
    SELECT n.function, n.entry, n.depth, min(b.function) AS via FROM n LEFT JOIN e ON e.callee = n.function AND n.depth > 0
      LEFT JOIN n b ON b.function = e.caller AND b.entry = n.entry AND b.depth = n.depth - 1 GROUP BY ALL""",
)
def c9_nearest(t):
    return G.nearest_entry(t.edges, _entries(t))


_ENTRY_LINES = " OR ".join(f"regexp_matches(line, {quote(p)})" for p, *_ in Q.ENTRY_PATTERNS)
_ENTRY_NAMES = rf"""en AS (SELECT DISTINCT coalesce(nullif(g[1], ''), nullif(g[2], '')) AS name FROM (
      SELECT [regexp_extract(line, 'def\s+(\w+)|(\w+)\s*\(', 1), regexp_extract(line, 'def\s+(\w+)|(\w+)\s*\(', 2)] AS g FROM cl WHERE {_ENTRY_LINES}))"""


@query(
    "c9_code_chains",
    _REACH.format(defs=f"{_CALLS}, {_EDGES}, {_ENTRY_NAMES},", e="ed", most=40, is_entry="r.node IN (SELECT name FROM en)")
    + " SELECT function, entry, depth FROM m",
)
def c9_code(t):
    edges = Q.call_graph(S.call_table(t.code_files)).where("direction = 'calls'").selectExpr("function AS caller", "other AS callee")
    return G.entry_reach(edges, Q.entry_functions(t.code_files))


@query(
    "x3_trailing_hours",
    """SELECT log_id, model_name, created_at, count(*) OVER w AS calls, CAST(sum(tokens_in) OVER w AS BIGINT) AS tokens, max(duration_ms) OVER w AS slowest
      FROM llm_log WINDOW w AS (PARTITION BY model_name ORDER BY created_at RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW)""",
)
def x3_trailing(t):
    calls = t.llm_log.select("log_id", "model_name", "created_at", "tokens_in", "duration_ms")
    aggs = {"calls": ("count", F.lit(1)), "tokens": ("sum", "tokens_in"), "slowest": ("max", "duration_ms")}
    return W.range_frame(calls, ["model_name"], "created_at", timedelta(hours=6), 0, aggs).drop("tokens_in", "duration_ms")


@query(
    "a34_confidence_tiles",
    f"""WITH {JUDGED}, n AS (SELECT *, ntile(10) OVER (PARTITION BY model_name ORDER BY confidence, result_id) AS tile FROM judged WHERE confidence IS NOT NULL)
      SELECT model_name, tile, count(*) AS results, count(*) FILTER (correct) AS correct, min(confidence) AS lowest, max(confidence) AS highest FROM n GROUP BY ALL""",
)
def a34_tiles(t):
    found = judged(t).where("confidence IS NOT NULL").select("model_name", "confidence", "result_id", "correct")
    tiled = W.tiles(found, ["model_name"], ["confidence", "result_id"], 10)
    return tiled.groupBy("model_name", "tile").agg(
        F.count(F.lit(1)).alias("results"), F.count_if("correct").alias("correct"),
        F.min("confidence").alias("lowest"), F.max("confidence").alias("highest"),
    )


@query(
    "a32_case_difficulty_ranks",
    f"""WITH {JUDGED}, m AS (SELECT case_id, verdict, count(*) FILTER (NOT correct) AS misses FROM judged GROUP BY ALL)
      SELECT case_id, verdict, misses, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, percent_rank() OVER w AS percent_rank, cume_dist() OVER w AS cume_dist
      FROM m WINDOW w AS (PARTITION BY verdict ORDER BY misses DESC)""",
)
def a32_ranks(t):
    misses = judged(t).groupBy("case_id", "verdict").agg(F.count_if(~F.col("correct")).alias("misses"))
    return W.value_ranks(misses, ["verdict"], "misses", descending=True)


def _stored_sketch(t, sketch, label):
    """The sketch as the table that an hourly job keeps, read back."""
    path = scratch_path(t.spark, label)
    sketch.write.parquet(path)
    return t.spark.read.parquet(path)


_GROWTH = K._growth(K.ACCURACY)


@query(
    "a25_latency_quantiles",
    f"""WITH b AS (SELECT model_name, phase, CASE WHEN duration_ms > 0 THEN CAST(ceil(ln(duration_ms) / ln({_GROWTH!r})) AS INT) END AS bucket, count(*) AS n
        FROM llm_log WHERE duration_ms IS NOT NULL GROUP BY ALL),
      u AS (SELECT *, sum(n) OVER (PARTITION BY model_name, phase ORDER BY bucket NULLS FIRST ROWS UNBOUNDED PRECEDING) AS upto, sum(n) OVER (PARTITION BY model_name, phase) AS total,
        CASE WHEN bucket IS NULL THEN 0 ELSE 2 * pow({_GROWTH!r}, bucket) / ({_GROWTH!r} + 1) END AS middle FROM b)
      SELECT model_name, phase, CAST(sum(n) AS BIGINT) AS calls, round(min(middle) FILTER (upto >= ceil(0.5 * total)), 3) AS p50,
        round(min(middle) FILTER (upto >= ceil(0.95 * total)), 3) AS p95 FROM u GROUP BY ALL""",
)
def a25_quantiles(t):
    sketch = _stored_sketch(t, K.quantile_sketch(t.llm_log, ["model_name", "phase"], "created_at", "duration_ms"), "latency")
    found = K.quantiles(sketch, ["model_name", "phase"], {"p50": 0.5, "p95": 0.95})
    return found.select("model_name", "phase", F.col("n").alias("calls"), F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95"))


_TEXT_SLOT = "CAST(concat('0x', substr(md5(concat(r, ':', error_message)), 1, 8)) AS BIGINT) % 64"


@query(
    "a23_error_frequencies",
    f"""WITH e AS (SELECT model_name, error_message, count(*) AS n FROM errors GROUP BY ALL),
      p AS (SELECT *, {_TEXT_SLOT} AS slot FROM (SELECT e.*, unnest(range(0, 4)) AS r FROM e)),
      s AS (SELECT model_name, r, slot, sum(n) AS n FROM p GROUP BY ALL)
      SELECT p.model_name, error_message, CAST(min(s.n) AS BIGINT) AS estimate FROM p JOIN s USING (model_name, r, slot) GROUP BY ALL""",
)
def a23_frequencies(t):
    sketch = _stored_sketch(t, K.frequency_sketch(t.errors, ["model_name"], "created_at", "error_message", 4, 64), "errors")
    return K.frequencies(sketch, t.errors, ["model_name"], "error_message", 4, 64)


@query(
    "a28_distinct_sizes",
    """SELECT model_name, count(DISTINCT tokens_in) AS sizes, true AS close FROM llm_log GROUP BY model_name""",
)
def a28_distinct(t):
    """Prompt sizes a model met: the united sketches lie within a twentieth of the exact count."""
    sketch = _stored_sketch(t, K.distinct_sketch(t.llm_log, ["model_name"], "created_at", "tokens_in"), "sizes")
    exact = t.llm_log.groupBy("model_name").agg(F.count_distinct("tokens_in").alias("sizes"))
    both = exact.join(K.distinct_counts(sketch, ["model_name"], "about"), "model_name")
    return both.select("model_name", "sizes", (F.abs(F.col("about") - F.col("sizes")) <= F.greatest(F.lit(1.0), F.col("sizes") / 20)).alias("close"))
