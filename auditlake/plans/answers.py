"""Queries that turn model answers into rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditlake.functions import table_functions
from auditlake.operators import extraction as E
from auditlake.plans.filters import DECISION_SQL, quote
from auditlake.plans.registry import query

STRIP = r"'^\s+|\s+$', '', 'g'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP})"


def parser_clean(x: str) -> str:
    """Thinking tags and an outer fence off."""
    for tag in ("thinking", "think"):
        x = f"regexp_replace(regexp_replace({x}, '(?is)<{tag}>.*?</{tag}>', '', 'g'), '(?i)</?{tag}>', '', 'g')"
    return strip(x)


def grab(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {quote(pattern)}, {group}), '')"


def _draft_field(section: str, name: str) -> str:
    tries = []
    for alias in E.DRAFT_FIELDS[name]:
        for pattern in E.draft_field_patterns(alias):
            raw = strip(f"regexp_extract({section}, {quote(pattern)}, 1)")
            tries.append(f"nullif({strip(f'regexp_replace({raw}, {quote(E.END_MARKER)}, {quote(str())})')}, '')")
    return f"coalesce({', '.join(tries)})"


def _json_get(name: str) -> str:
    aliases, default = E.DRAFT_JSON_FIELDS[name]
    gets = ", ".join(f"json_extract_string(j, '$.{a}')" for a in aliases)
    return f"coalesce({gets}, {quote(default)})"


_NONE = " OR ".join(f"contains(lower(c), {quote(p)})" for p in E.NO_FINDINGS)
_TITLE = strip(
    r"regexp_replace(regexp_replace(" + strip(f"string_split_regex({strip('sec')}, {quote(E.FIELD_START)})[1]")
    + r", '^[*#\-]+\s*', ''), '\s*[*#\-]+$', '')"
)
_REPAIR = lambda x: strip(f"regexp_replace({x}, ',\\s*([}}\\]])', '\\1', 'g')")

_RAW = "raw AS (SELECT response_id, text FROM responses UNION ALL SELECT response_id, text FROM talk)"
DRAFTS_SQL = f"""{_RAW},
cleaned AS (SELECT response_id, {parser_clean('text')} AS c FROM raw),
flagged AS (SELECT *, {_NONE} AS none_phrase FROM cleaned),
secs AS (SELECT response_id, unnest(string_split_regex(c, {quote(E.DRAFT_HEADER)})[2:]) AS sec,
  generate_subscripts(string_split_regex(c, {quote(E.DRAFT_HEADER)})[2:], 1) AS n FROM flagged WHERE NOT none_phrase),
titled AS (SELECT *, {_TITLE} AS title FROM secs),
marked AS (SELECT response_id, n, title, {_draft_field('sec', 'type')} AS type, {_draft_field('sec', 'severity')} AS severity,
  try_cast(regexp_extract({_draft_field('sec', 'line')}, '(\\d+)', 1) AS INT) AS line, {_draft_field('sec', 'snippet')} AS snippet,
  {_draft_field('sec', 'reason')} AS reason FROM titled WHERE length(title) > 2),
rest AS (SELECT * FROM flagged WHERE NOT none_phrase AND response_id NOT IN (SELECT response_id FROM marked)),
arrays AS (SELECT response_id, c, CASE WHEN starts_with(c, '[') AND json_valid(c) THEN c
  ELSE {_REPAIR(grab('c', E.JSON_ARRAY))} END AS arr FROM rest),
jrows AS (SELECT response_id, unnest(from_json(arr, '["JSON"]')) AS j, generate_subscripts(from_json(arr, '["JSON"]'), 1) AS n FROM arrays WHERE json_valid(arr)),
jdrafts AS (SELECT response_id, n, {_json_get('title')} AS title, {_json_get('type')} AS type, {_json_get('severity')} AS severity,
  try_cast({_json_get('line')} AS INT) AS line, {_json_get('snippet')} AS snippet, {_json_get('reason')} AS reason FROM jrows WHERE {_json_get('title')} NOT IN ('', 'Unknown')),
loose_rest AS (SELECT * FROM rest WHERE response_id NOT IN (SELECT response_id FROM arrays WHERE json_valid(arr))),
lrows AS (SELECT response_id, unnest(regexp_extract_all(c, {quote(E.LOOSE_FINDING)}, 1)) AS a, unnest(regexp_extract_all(c, {quote(E.LOOSE_FINDING)}, 2)) AS b,
  generate_subscripts(regexp_extract_all(c, {quote(E.LOOSE_FINDING)}, 1), 1) AS n FROM loose_rest),
ldrafts AS (SELECT response_id, n, {strip('a')} AS title, 'Unknown' AS type, 'Medium' AS severity, try_cast(b AS INT) AS line, '' AS snippet,
  'Extracted from unstructured response' AS reason FROM lrows WHERE {strip('a')} <> '' AND try_cast(b AS INT) > 0),
found AS (SELECT * FROM marked UNION ALL SELECT * FROM jdrafts UNION ALL SELECT * FROM ldrafts),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY response_id ORDER BY n) - 1 AS INT) AS draft_no FROM found)"""


def _answers(t):
    return t.responses.select("response_id", "text").unionByName(t.talk)


_T1_SQL = f"""WITH {DRAFTS_SQL}
    SELECT f.response_id, none_phrase, CASE WHEN none_phrase THEN 'none' WHEN draft_no IS NOT NULL THEN 'parsed' ELSE 'failed' END AS parse_status,
      draft_no, title, type, severity, line, snippet, reason FROM flagged f LEFT JOIN numbered d USING (response_id)"""


@query("t1_draft_extraction", _T1_SQL)
def t1(t):
    return E.extract_drafts(_answers(t))


@query("t1_sql_table_function", _T1_SQL)
def t1_sql(t):
    table_functions.register(t.spark)
    return t.spark.sql("SELECT * FROM extract_drafts(TABLE({answers}))", answers=_answers(t))


@query(
    "f21_json_repair",
    f"""WITH r AS (SELECT response_id, CASE WHEN starts_with(text, '[') THEN text ELSE {_REPAIR(grab('text', E.JSON_ARRAY))} END AS arr FROM responses),
    j AS (SELECT response_id, unnest(from_json(arr, '["JSON"]')) AS j FROM r WHERE json_valid(arr))
    SELECT response_id, {_json_get('title')} AS title, {_json_get('type')} AS type, {_json_get('severity')} AS severity, try_cast({_json_get('line')} AS INT) AS line FROM j""",
)
def f21(t):
    found = t.responses.select("response_id", F.explode(E.json_findings("text")).alias("d"))
    return found.select("response_id", "d.title", "d.type", "d.severity", "d.line")


_UNTIL = r"\s*:\s*(.+?)(?:\n\s*\*?[A-Z_]+\s*:|\*END|\z)"


@query(
    "t2_verification_extraction",
    f"""WITH c AS (SELECT vote_id, {parser_clean('text')} AS t FROM vote_texts),
    k AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)REJECTED\\s*:') THEN 'rejection' WHEN regexp_matches(t, '(?i)VERIFIED\\s*:') THEN 'verification'
      WHEN regexp_matches(t, '(?i)VOTE\\s*:') THEN 'vote' ELSE 'none' END AS kind, upper({grab('t', '(?i)VOTE' + chr(92) + 's*:' + chr(92) + 's*(' + chr(92) + 'w+)')}) AS decision FROM c)
    SELECT vote_id, kind, CASE kind WHEN 'verification' THEN true WHEN 'vote' THEN coalesce(decision IN ('REAL', 'WEAKNESS'), false) ELSE false END AS verified,
      kind = 'vote' AND coalesce(decision = 'WEAKNESS', false) AS is_weakness,
      CASE kind WHEN 'rejection' THEN {strip(grab('t', r'(?is)REJECTED\s*:\s*(.+?)(?:\n|\*REASON|\z)'))} WHEN 'verification' THEN {strip(grab('t', '(?is)VERIFIED' + _UNTIL))} END AS title,
      CASE kind WHEN 'rejection' THEN coalesce({strip(grab('t', r'(?is)REASON\s*:\s*(.+?)(?:\*END|\z)'))}, 'Rejected (no reason provided)')
        WHEN 'vote' THEN {strip(grab('t', r'(?is)REASONING\s*:\s*(.+?)(?:\*END|\*[A-Z_]+:|\z)'))} WHEN 'none' THEN 'Unable to parse response' END AS reason,
      CASE WHEN kind IN ('verification', 'vote') THEN try_cast({grab('t', r'(?i)CONFIDENCE\s*:\s*(\d+)')} AS INT) END AS confidence,
      CASE kind WHEN 'verification' THEN {strip(grab('t', '(?is)ATTACK_VECTOR' + _UNTIL))} END AS attack_vector,
      CASE kind WHEN 'verification' THEN {strip(grab('t', '(?is)DATA_FLOW' + _UNTIL))} END AS data_flow,
      CASE kind WHEN 'verification' THEN {grab('t', r'(?i)ADJUSTED_SEVERITY\s*:\s*(\w+)')} END AS adjusted_severity FROM k""",
)
def t2(t):
    return E.extract_verifications(t.vote_texts.select("vote_id", "text"))


def _enriched_sql(name: str) -> str:
    names = ", ".join(quote(a) for a in E.ENRICHED_FIELDS[name])
    value = f"(list_filter(list_zip(n, v), lambda p: p[1] IN ({names})))[1][2]"
    lines = f"list_transform(string_split({strip(value)}, chr(10)), lambda x: regexp_replace(x, '^[*# \\t]+', ''))"
    return f"nullif({strip(f'array_to_string({lines}, chr(10))')}, '') AS \"{name}\""


@query(
    "t3_enrichment_extraction",
    f"""WITH c AS (SELECT draft_id, {parser_clean('text')} AS t FROM enriched_texts),
    s AS (SELECT draft_id, list_transform(regexp_extract_all(t, {quote(E.ENRICHED_MARKER)}, 1), lambda x: lower(x)) AS n, string_split_regex(t, {quote(E.ENRICHED_MARKER)})[2:] AS v FROM c)
    SELECT draft_id, {', '.join(_enriched_sql(n) for n in E.ENRICHED_FIELDS)} FROM s""",
)
def t3(t):
    return E.extract_enriched(t.enriched_texts)


def _universal(x: str) -> str:
    for tag in ("thinking", "think", "reasoning", "reflection"):
        x = f"regexp_replace({x}, '(?is)<{tag}>.*?</{tag}>', '', 'g')"
    for tag in ("thinking", "think"):
        x = f"regexp_replace({x}, '(?is)<{tag}>.*$', '', 'g')"
    x = f"regexp_replace({x}, '(?i)</?(?:thinking|think|reasoning|reflection)>', '', 'g')"
    return strip(x)


def _clean_marker(x: str) -> str:
    x = strip(f"regexp_replace(regexp_replace({strip(x)}, '(?is)\\*?END[_A-Z]*.*$', '', 'g'), '[*#]+\\s*$', '', 'g')")
    return f"regexp_replace({x}, '^\"(.*)\"$', '\\1', 'g')"


def _marker(name: str) -> str:
    tries = [
        f"nullif({_clean_marker(f'regexp_extract(c, {quote(p(a))}, 1)')}, '')"
        for a in E.VOTE_FIELDS[name]
        for p in (E.marker_pattern, E.inline_pattern)
    ]
    return f"coalesce({', '.join(tries)})"


def _from_obj(name: str) -> str:
    return "coalesce(" + ", ".join(f"json_extract_string(obj, '$.{a}')" for a in E.VOTE_FIELDS[name]) + ")"


PARSED_SQL = f"""c0 AS (SELECT vote_id, {_universal('text')} AS c FROM vote_texts),
objs AS (SELECT *, CASE WHEN starts_with(c, '{{') AND json_valid(c) THEN c WHEN json_valid({grab('c', E.JSON_OBJECT)}) THEN {grab('c', E.JSON_OBJECT)} END AS obj FROM c0),
fields AS (SELECT *, {', '.join(f"CASE WHEN obj IS NOT NULL THEN {_from_obj(n)} ELSE {_marker(n)} END AS {n}" for n in E.VOTE_FIELDS)} FROM objs),
parsed AS (SELECT *, CASE WHEN obj IS NOT NULL THEN 'json' WHEN coalesce(vote, confidence, reasoning, attack_scenario) IS NOT NULL THEN 'marker' ELSE 'unknown' END AS format_detected FROM fields)"""


@query(
    "t4_generic_parse",
    f"""WITH {PARSED_SQL} SELECT vote_id, format_detected, vote, confidence, reasoning, attack_scenario,
      CASE WHEN vote IS NULL THEN ['vote'] ELSE []::VARCHAR[] END AS missing, vote IS NOT NULL AS parse_success, vote IS NULL AS needs_cleanup FROM parsed""",
)
def t4(t):
    return E.parse_generic(t.vote_texts.select("vote_id", "text"), E.VOTE_FIELDS, ["vote"])


_T5_SQL = (
    rf"""WITH {PARSED_SQL} SELECT vote_id, {DECISION_SQL.replace('upper(v)', "upper(coalesce(vote, ''))")} AS decision,
      CAST(least(100, coalesce(try_cast(nullif(regexp_extract(confidence, '(\d+)', 1), '') AS BIGINT), 50)) AS INT) AS confidence,
      CASE WHEN format_detected = 'unknown' THEN 'Failed to parse response' ELSE coalesce(reasoning, '') END AS reasoning,
      coalesce(attack_scenario, '') AS attack_scenario, vote IS NOT NULL AS parse_success, format_detected, vote IS NULL AS needs_cleanup FROM parsed"""
)


@query("t5_vote_extraction", _T5_SQL)
def t5(t):
    return E.extract_votes(t.vote_texts.select("vote_id", "text"))


@query("t5_sql_table_function", _T5_SQL)
def t5_sql(t):
    table_functions.register(t.spark)
    return t.spark.sql("SELECT * FROM extract_votes(TABLE({answers}))", answers=t.vote_texts.select("vote_id", "text"))


_CAT = """CASE WHEN contains(l, 'vote:') OR contains(l, 'verdict:') THEN CASE WHEN contains(l, 'false_positive') OR contains(l, 'false positive') THEN 'FALSE_POSITIVE'
  WHEN contains(l, 'real') THEN 'REAL' WHEN contains(l, 'needs_verified') OR contains(l, 'needs verified') THEN 'NEEDS_VERIFIED' WHEN contains(l, 'weakness') THEN 'WEAKNESS' END END"""


@query(
    "t9_loose_votes",
    rf"""WITH c AS (SELECT vote_id, {strip("regexp_replace(regexp_replace(text, '(?s)<thinking>.*?</thinking>', '', 'g'), '(?s)<think>.*?</think>', '', 'g')")} AS t FROM vote_texts),
    l AS (SELECT vote_id, lower(unnest(string_split(t, chr(10)))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS n FROM c),
    m AS (SELECT vote_id, n, {_CAT} AS cat, CASE WHEN contains(l, 'confidence') THEN try_cast(nullif(regexp_extract(l, '(\d+)', 1), '') AS BIGINT) END AS conf FROM l),
    w AS (SELECT vote_id, arg_max(cat, n) FILTER (cat IS NOT NULL) AS cat, arg_max(conf, n) FILTER (conf IS NOT NULL) AS conf FROM m GROUP BY vote_id)
    SELECT c.vote_id, coalesce(cat, CASE WHEN contains(lower(t), 'false positive') OR contains(lower(t), 'false_positive') THEN 'FALSE_POSITIVE'
        WHEN regexp_matches(lower(t), '\breal\b') THEN 'REAL' WHEN contains(lower(t), 'needs_verified') OR contains(lower(t), 'needs verified') THEN 'NEEDS_VERIFIED'
        WHEN contains(lower(t), 'weakness') THEN 'WEAKNESS' END) AS vote, CAST(CASE WHEN conf > 100 THEN 100 ELSE conf END AS INT) AS confidence,
      {strip("coalesce(nullif(regexp_extract(t, '(?is)reasoning:" + chr(92) + "s*(.*)', 1), ''), t)")} AS reasoning
    FROM c JOIN w USING (vote_id)""",
)
def t9(t):
    return E.extract_loose_votes(t.vote_texts.select("vote_id", "text"))


_STEP = (
    "CASE o_custkey % 5 "
    "WHEN 0 THEN concat('I look at order ', o_orderkey, chr(10), '*TOOL_CALL*', chr(10), 'name: read_file', chr(10), 'params: {\"path\": \"f', o_custkey, '.c\"}', chr(10), '*END_TOOL_CALL*', chr(10), '*FINAL_ANSWER*REAL*END_FINAL_ANSWER*') "
    "WHEN 1 THEN concat('Done. *FINAL_ANSWER* verdict for ', o_orderkey, ': REAL *END_FINAL_ANSWER*') "
    "WHEN 2 THEN concat('{\"thinking\": \"t', o_orderkey, '\", \"action\": {\"type\": \"tool_call\", \"tool_name\": \"grep\", \"tool_params\": {\"path\": \"x', o_custkey, '\"}}}') "
    "WHEN 3 THEN concat('{\"thinking\": \"u\", \"action\": {\"type\": \"final_answer\", \"answer\": \"no ', o_orderkey, '\"}}') "
    "ELSE concat('still thinking about ', o_orderkey) END"
)


@query(
    "t7_agent_steps",
    rf"""WITH r AS (SELECT o_orderkey AS id, {_STEP} AS t FROM orders),
    s AS (SELECT *, {grab('t', E.TOOL_CALL, 2)} AS block, {grab('t', E.FINAL_ANSWER, 2)} AS final FROM r)
    SELECT id, CASE WHEN block IS NOT NULL THEN {strip(f'regexp_extract(t, {quote(E.TOOL_CALL)}, 1)')}
        WHEN final IS NOT NULL THEN {strip(f'regexp_extract(t, {quote(E.FINAL_ANSWER)}, 1)')} ELSE {strip('t')} END AS thought,
      CASE WHEN block IS NOT NULL THEN regexp_extract(block, 'name:\s*(\w+)', 1) END AS tool_name,
      CASE WHEN block IS NOT NULL THEN json_extract_string(regexp_extract(block, '(?s)params:\s*(\{{.+?\}})', 1), '$.path') END AS path,
      block IS NULL AND final IS NOT NULL AS is_final, CASE WHEN block IS NULL THEN {strip('final')} END AS final_answer FROM s""",
)
def t7(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_STEP} AS text")
    return E.agent_steps(raw).select(
        "id", "thought", "tool_name", F.col("tool_params")["path"].alias("path"), "is_final", "final_answer"
    )


@query(
    "t7_agent_steps_json",
    rf"""WITH r AS (SELECT o_orderkey AS id, {_STEP} AS t FROM orders),
    s AS (SELECT id, {grab('t', r'(?s)(' + chr(92) + '{.*' + chr(92) + '})')} AS j, {grab('t', E.FINAL_ANSWER, 2)} AS final, t FROM r)
    SELECT id, CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.thinking'), '') WHEN final IS NOT NULL
        THEN {strip(f'regexp_extract(t, {quote(E.FINAL_ANSWER)}, 1)')} ELSE {strip('t')} END AS thought,
      json_extract_string(j, '$.action.tool_name') AS tool_name, json_extract_string(j, '$.action.tool_params.path') AS path,
      CASE WHEN j IS NOT NULL THEN coalesce(json_extract_string(j, '$.action.type') = 'final_answer', false) ELSE final IS NOT NULL END AS is_final,
      CASE WHEN j IS NOT NULL THEN json_extract_string(j, '$.action.answer') ELSE {strip('final')} END AS final_answer FROM s""",
)
def t7_json(t):
    raw = t.orders.selectExpr("o_orderkey AS id", f"{_STEP} AS text")
    return E.agent_steps(raw, json_format=True).select(
        "id", "thought", "tool_name", F.col("tool_params")["path"].alias("path"), "is_final", "final_answer"
    )


@query(
    "t7_trace_rows",
    """WITH s AS (SELECT conv_id, turn, role, text FROM conversations),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS pos FROM s)
    SELECT conv_id, pos, CAST(turn AS INT) AS step, text AS thought, role AS tool_name,
      text AS tool_result FROM r""",
)
def t7_trace(t):
    # The table is flat: build the session arrays first, a conversation being one session.
    sessions = t.conversations.groupBy("conv_id").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("turn").cast("int").alias("step"), F.col("text").alias("thought"),
                    F.col("role").alias("tool_name"), F.col("text").alias("tool_result"),
                )
            )
        ).alias("trace")
    )
    return E.trace_rows(sessions)
