"""Model answers to rows: drafts, verdicts, enriched records, votes, agent steps.

Everything runs as JVM-side expressions on whole texts, one pass per answer and no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.functions import text as X
from auditlake.functions.scalars import contains_any, let
from auditlake.functions.text import LINE_ENDS, SPACES, capture, captures, strip_spaces

# Phrases of an answer without findings; they count anywhere in the text.
NO_FINDINGS = [
    "draft:none", "*draft:none", "no findings", "no vulnerabilities", "no issues",
    "no security issues", "nothing suspicious", "no potential vulnerabilities",
    "code appears safe", "[]",
]

# Names a draft field goes by, in matching order.
DRAFT_FIELDS = {
    "type": ["type", "vuln_type", "vulnerability_type", "cwe", "category"],
    "severity": ["severity", "sev", "risk", "risk_level"],
    "line": ["line", "line_number", "line_num", "lineno"],
    "snippet": ["snippet", "code", "code_snippet", "vulnerable_code"],
    "reason": ["reason", "description", "explanation", "details", "why"],
}
DRAFT_JSON_FIELDS = {
    "title": (["title", "name", "finding"], "Unknown"),
    "type": (["vulnerability_type", "type", "cwe", "category"], "Unknown"),
    "severity": (["severity", "risk"], "Medium"),
    "line": (["line_number", "line", "lineno"], "0"),
    "snippet": (["snippet", "code", "code_snippet"], ""),
    "reason": (["reason", "description", "explanation"], ""),
}

# Names an enriched field goes by.
ENRICHED_FIELDS = {
    "finding": ["finding", "title", "vulnerability", "name"],
    "category": ["category", "type", "cwe", "vuln_type"],
    "severity": ["severity", "risk", "risk_level"],
    "cvss": ["cvss", "cvss_score", "score"],
    "impacted_code": ["impacted_code", "vulnerable_code", "code", "affected_code"],
    "vulnerability_details": ["vulnerability_details", "details", "description", "explanation"],
    "proof_of_concept": ["proof_of_concept", "poc", "exploit", "attack"],
    "corrected_code": ["corrected_code", "fixed_code", "fix", "remediated_code"],
    "remediation_steps": ["remediation_steps", "remediation", "fix_steps", "mitigation"],
    "references": ["references", "refs", "links", "resources"],
}

# Names a vote field goes by.
VOTE_FIELDS = {
    "vote": ["vote", "decision", "verdict", "result", "judgment", "judgement"],
    "confidence": ["confidence", "conf", "certainty", "score", "probability"],
    "reasoning": [
        "reasoning", "reason", "explanation", "rationale", "analysis", "model_reasoning",
        "justification", "why",
    ],
    "attack_scenario": [
        "attack_scenario", "attack", "exploit", "attack_vector", "poc", "proof_of_concept",
        "exploitation",
    ],
}

# The marker grammar of answers.
DRAFT_HEADER = r"(?i)(?:^|\n)\s*(?:\*+|#{1,2}\s*\**)?\s*DRAFT\s*:"
FIELD_START = r"\n\s*\*?[A-Z_]+\s*:"
END_MARKER = r"(?is)\*END_(?:DRAFT|VERIFIED|REJECTED).*$"
LOOSE_FINDING = (
    r"(?i)([A-Z][A-Za-z\s\-]+(?:Overflow|Injection|XSS|SSRF|Traversal|Vulnerability|Issue|Bug))"
    r"[^\d]*(?:line|at|on)?\s*[:\s]*(\d+)"
)
LOOSE_WORDS = ["overflow", "injection", "xss", "ssrf", "traversal", "vulnerability", "issue", "bug"]
JSON_BLOCK = r"```(?:json)?\s*(\[[\s\S]*?\])\s*```"
JSON_ARRAY = r"(\[\s*\{[\s\S]*?\}\s*,?\s*\])"
JSON_FINDINGS = r"\{[^{}]*\"findings\"\s*:\s*(\[[\s\S]*?\])"
JSON_OBJECT = r"(?s)(\{[^{}]*(?:\{[^{}]*\}[^{}]*)*\})"
FIELD_PREFIX = r"[\s\*#\-•→►▸>\[\]\(\)\|]*"
FIELD_SEPARATOR = r"[\s\*]*[:=\-–—→>]+[\s\*]*"


def draft_field_patterns(alias: str) -> list[str]:
    """The three spellings of a field marker; the end marker is consumed instead of looked at."""
    return [
        rf"(?is)\*{alias}\s*:\s*(.+?)(?:\n\s*\*[A-Z_]+\s*:|(?:\n\s*)?\*END|\z)",
        rf"(?is)(?:^|\n)\s*{alias}\s*:\s*(.+?)(?:\n\s*[A-Z_]+\s*:|\n\s*\*|\z)",
        rf"(?is)\*\*{alias}\s*:\*?\*?\s*(.+?)(?:\n\s*\*|\z)",
    ]


def _field(section: Column, aliases: list[str]) -> Column:
    tries = []
    low = F.lower(section)
    for alias in aliases:
        for pattern in draft_field_patterns(alias):
            value = F.regexp_replace(strip_spaces(F.regexp_extract(section, pattern, 1)), END_MARKER, "")
            tries.append(F.when(low.contains(alias), F.nullif(strip_spaces(value), F.lit(""))))
    return F.coalesce(*tries)


def _draft(title: Column, kind: Column, severity: Column, line: Column, snippet: Column, reason: Column) -> Column:
    named = {"title": title, "type": kind, "severity": severity, "line": line, "snippet": snippet, "reason": reason}
    return F.struct(*[c.alias(n) for n, c in named.items()])


def _titled(section: Column) -> Column:
    head = strip_spaces(F.split(strip_spaces(section), FIELD_START)[0])
    head = F.regexp_replace(F.regexp_replace(head, r"^[*#\-]+\s*", ""), r"\s*[*#\-]+$", "")
    return F.struct(section.alias("section"), strip_spaces(head).alias("title"))


def _section_draft(titled: Column) -> Column:
    section, title = titled["section"], titled["title"]
    fields = {name: _field(section, aliases) for name, aliases in DRAFT_FIELDS.items()}
    line = F.regexp_extract(fields["line"], r"(\d+)", 1).try_cast("int")
    return _draft(title, fields["type"], fields["severity"], line, fields["snippet"], fields["reason"])


def clean_json(text: Column | str) -> Column:
    """Drop trailing commas."""
    return strip_spaces(F.regexp_replace(S.col(text), r",\s*([}\]])", "$1"))


def json_findings(text: Column | str) -> Column:
    """Array of drafts from the JSON array in a text; null when there is none."""
    t = S.col(text)
    kind = "array<map<string,string>>"
    parsed = F.coalesce(
        F.when(t.startswith("["), F.from_json(t, kind)),
        F.from_json(clean_json(capture(t, JSON_BLOCK)), kind),
        F.from_json(clean_json(capture(t, JSON_ARRAY)), kind),
        F.from_json(clean_json(capture(t, JSON_FINDINGS)), kind),
    )

    def normal(item: Column) -> Column:
        get = {
            name: F.coalesce(*[item[a] for a in aliases], F.lit(default))
            for name, (aliases, default) in DRAFT_JSON_FIELDS.items()
        }
        return _draft(
            get["title"], get["type"], get["severity"], get["line"].try_cast("int"), get["snippet"], get["reason"]
        )

    drafts = F.transform(F.filter(parsed, lambda m: m.isNotNull()), normal)
    return F.filter(drafts, lambda d: ~d["title"].isin("", "Unknown"))


def extract_drafts(responses: DataFrame) -> DataFrame:
    """One row per draft of an answer, plus one row for answers without any.

    ``parse_status`` is parsed, none or failed; ``none_phrase`` tells that a no-finding phrase
    decided it.
    """
    cleaned = responses.withColumn("_t", X.strip_outer_fence(X.strip_thinking("text")))
    t = F.col("_t")
    low = F.lower(t)
    sections = F.split(t, DRAFT_HEADER)
    titled = F.filter(
        F.transform(F.slice(sections, 2, F.size(sections)), _titled), lambda d: F.length(d["title"]) > 2
    )
    marked = F.transform(titled, _section_draft)
    loose = F.when(S.contains_any(low, LOOSE_WORDS), F.filter(
        F.transform(
            F.arrays_zip(captures(t, LOOSE_FINDING, 1).alias("a"), captures(t, LOOSE_FINDING, 2).alias("b")),
            lambda p: _draft(
                strip_spaces(p["a"]), F.lit("Unknown"), F.lit("Medium"), p["b"].try_cast("int"), F.lit(""),
                F.lit("Extracted from unstructured response"),
            ),
        ),
        lambda d: (d["title"] != "") & (d["line"] > 0),
    ))
    none_phrase = S.contains_any(low, NO_FINDINGS)
    staged = (
        cleaned.withColumn("none_phrase", (F.coalesce("text", F.lit("")) == "") | none_phrase)
        .withColumn("_marked", F.when(~F.col("none_phrase"), marked))
        .withColumn("_json", F.when(~F.col("none_phrase") & (F.size("_marked") == 0), json_findings(t)))
        .withColumn(
            "_loose",
            F.when(~F.col("none_phrase") & (F.size("_marked") == 0) & F.col("_json").isNull(), loose),
        )
    )
    drafts = (
        F.when(F.size("_marked") > 0, F.col("_marked"))
        .when(F.col("_json").isNotNull(), F.col("_json"))
        .otherwise(F.col("_loose"))
    )
    status = (
        F.when(F.col("none_phrase"), "none")
        .when(F.size("_marked") > 0, "parsed")
        .when(F.col("_json").isNotNull(), F.when(F.size("_json") > 0, "parsed").otherwise("none"))
        .when(F.size("_loose") > 0, "parsed")
        .otherwise("failed")
    )
    keep = [c for c in responses.columns if c != "text"]
    return (
        staged.select(*keep, "none_phrase", status.alias("parse_status"), F.posexplode_outer(drafts).alias("draft_no", "d"))
        .select(*keep, "none_phrase", "parse_status", "draft_no", "d.*")
    )


def extract_verifications(responses: DataFrame) -> DataFrame:
    """REJECTED first, then VERIFIED, then VOTE; anything else is not verified."""
    cleaned = responses.withColumn("_t", X.strip_outer_fence(X.strip_thinking("text")))
    t = F.col("_t")
    kind = (
        F.when(t.rlike(r"(?i)REJECTED\s*:"), "rejection")
        .when(t.rlike(r"(?i)VERIFIED\s*:"), "verification")
        .when(t.rlike(r"(?i)VOTE\s*:"), "vote")
        .otherwise("none")
    )
    value = lambda p: strip_spaces(capture(t, p))
    until = r"\s*:\s*(.+?)(?:\n\s*\*?[A-Z_]+\s*:|\*END|\z)"
    decision = F.upper(capture(t, r"(?i)VOTE\s*:\s*(\w+)"))
    is_kind = lambda k: F.col("kind") == k
    keep = [c for c in responses.columns if c != "text"]
    return cleaned.withColumn("kind", kind).select(
        *keep,
        "kind",
        F.when(is_kind("verification"), True)
        .when(is_kind("vote"), F.coalesce(decision.isin("REAL", "WEAKNESS"), F.lit(False)))
        .otherwise(False)
        .alias("verified"),
        (is_kind("vote") & F.coalesce(decision == "WEAKNESS", F.lit(False))).alias("is_weakness"),
        F.when(is_kind("rejection"), value(r"(?is)REJECTED\s*:\s*(.+?)(?:\n|\*REASON|\z)"))
        .when(is_kind("verification"), value(r"(?is)VERIFIED" + until))
        .alias("title"),
        F.when(
            is_kind("rejection"),
            F.coalesce(value(r"(?is)REASON\s*:\s*(.+?)(?:\*END|\z)"), F.lit("Rejected (no reason provided)")),
        )
        .when(is_kind("vote"), value(r"(?is)REASONING\s*:\s*(.+?)(?:\*END|\*[A-Z_]+:|\z)"))
        .when(is_kind("none"), F.lit("Unable to parse response"))
        .alias("reason"),
        F.when(
            is_kind("verification") | is_kind("vote"),
            capture(t, r"(?i)CONFIDENCE\s*:\s*(\d+)").try_cast("int"),
        ).alias("confidence"),
        F.when(is_kind("verification"), value(r"(?is)ATTACK_VECTOR" + until)).alias("attack_vector"),
        F.when(is_kind("verification"), value(r"(?is)DATA_FLOW" + until)).alias("data_flow"),
        F.when(is_kind("verification"), capture(t, r"(?i)ADJUSTED_SEVERITY\s*:\s*(\w+)")).alias("adjusted_severity"),
    )


ENRICHED_NAMES = sorted({a for names in ENRICHED_FIELDS.values() for a in names} | {"end_finding"}, key=lambda a: (-len(a), a))
ENRICHED_MARKER = (
    r"(?i)(?:^|\n)(?:\*{0,2}|## (?:\*\*)?|\[\])(" + "|".join(ENRICHED_NAMES) + r")(?::\*\*|\*\*|:)"
)


def extract_enriched(responses: DataFrame) -> DataFrame:
    """Ten fields per answer; a value ends where the next marker starts, the first of its names wins."""
    t = X.strip_outer_fence(X.strip_thinking("text"))
    cleaned = responses.withColumn("_t", t)
    names = F.transform(captures("_t", ENRICHED_MARKER, 1), F.lower)
    values = F.split("_t", ENRICHED_MARKER)
    staged = cleaned.withColumn("_n", names).withColumn("_v", F.slice(values, 2, F.size(values)))

    def first(aliases: list[str]) -> Column:
        pairs = F.filter(F.arrays_zip(F.col("_n").alias("n"), F.col("_v").alias("v")), lambda p: p["n"].isin(aliases))
        value = F.get(pairs, F.lit(0))["v"]
        lines = F.transform(F.split(strip_spaces(value), "\n"), lambda x: F.regexp_replace(x, r"^[*# \t]+", ""))
        return F.nullif(strip_spaces(F.array_join(lines, "\n")), F.lit(""))

    keep = [c for c in responses.columns if c != "text"]
    return staged.select(*keep, *[first(a).alias(n) for n, a in ENRICHED_FIELDS.items()])


def marker_pattern(name: str) -> str:
    """A keyword in any markup up to the next upper-case field, an END marker or the end."""
    return (
        rf"(?s)(?:^|\n){FIELD_PREFIX}\*{{0,3}}\s*(?i:{name})\s*\*{{0,3}}{FIELD_SEPARATOR}"
        rf"(.+?)(?:\n{FIELD_PREFIX}[A-Za-z][A-Za-z_]*\s*[:\-=]|\n\s*\*?(?i:END)|\z)"
    )


def inline_pattern(name: str) -> str:
    return rf"(?i){name}\s*[:\-=]\s*([^,\n]+)"


def _unquoted(value: Column) -> Column:
    return F.regexp_replace(value, r"^\"(.*)\"$", "$1")


def _clean_marker(value: Column) -> Column:
    out = F.regexp_replace(value, r"(?is)\*?END[_A-Z]*.*$", "")
    return _unquoted(strip_spaces(F.regexp_replace(out, r"[*#]+\s*$", "")))


def _marked_value(text: Column, pattern: str) -> Column:
    """The cleaned value of a marker, null if empty; each regex runs once, and only on values that it may change."""

    def clean(value: Column) -> Column:
        odd = F.lower(value).contains("end") | contains_any(value, ["*", "#", *LINE_ENDS])
        short = F.btrim(value, F.lit(SPACES))
        plain = F.when(short.startswith('"'), _unquoted(short)).otherwise(short)
        return F.when(value != "", F.when(odd, _clean_marker(strip_spaces(value))).otherwise(plain))

    return let(let(F.regexp_extract(text, pattern, 1), clean), lambda v: F.when(v != "", v))


def _from_marker(text: Column, low: Column, aliases: list[str]) -> Column:
    """First alias with a value; a cheap substring test spares the regexes of absent aliases."""
    tries = [
        F.when(low.contains(alias), _marked_value(text, pattern(alias)))
        for alias in aliases
        for pattern in (marker_pattern, inline_pattern)
    ]
    return F.coalesce(*tries)


def _by_key(obj: Column, key: str) -> Column:
    """Value of the first key that equals ``key`` in any case."""
    hits = F.filter(F.map_entries(obj), lambda e: F.lower(e["key"]) == key)
    return F.get(hits, F.lit(0))["value"]


def parse_generic(responses: DataFrame, fields: dict[str, list[str]], required: list[str]) -> DataFrame:
    """Fields of an answer with the format found, the required ones missing, and needs_cleanup."""
    keep = [c for c in responses.columns if c != "text"]
    t, obj = F.col("_t"), F.col("_obj")
    parsed_object = F.coalesce(
        F.when(t.startswith("{"), F.from_json(t, "map<string,string>")),
        F.when(t.contains("{"), F.from_json(capture(t, JSON_OBJECT), "map<string,string>")),
    )
    staged = (
        responses.withColumn("_t", X.preprocess("text"))
        .withColumn("_low", F.lower("_t"))
        .withColumn("_obj", parsed_object)
    )
    values = {
        name: F.when(obj.isNotNull(), F.coalesce(*[_by_key(obj, a) for a in aliases])).otherwise(
            _from_marker(t, F.col("_low"), aliases)
        )
        for name, aliases in fields.items()
    }
    parsed = staged.select(
        *keep, (t == "").alias("_empty"), obj.isNotNull().alias("_json"), *[c.alias(n) for n, c in values.items()]
    )
    missing = F.array_compact(F.array(*[F.when(F.col(r).isNull(), F.lit(r)) for r in required]))
    kind = (
        F.when(F.col("_json"), "json")
        .when(F.coalesce(*[F.col(n) for n in fields]).isNotNull(), "marker")
        .otherwise("unknown")
    )
    return (
        parsed.withColumn("format_detected", kind)
        .withColumn("missing", missing)
        .withColumn("parse_success", (F.col("format_detected") != "unknown") & (F.size("missing") == 0))
        .withColumn("needs_cleanup", ~F.col("parse_success") & ~F.col("_empty"))
        .drop("_empty", "_json")
    )


def extract_votes(responses: DataFrame) -> DataFrame:
    """Answers to rows of the votes table, with the parse flags."""
    parsed = parse_generic(responses, VOTE_FIELDS, ["vote"])
    keep = [c for c in responses.columns if c != "text"]
    found = F.coalesce("vote", "confidence", "reasoning", "attack_scenario").isNotNull()
    return parsed.select(
        *keep,
        F.coalesce(X.vote_decision("vote"), F.lit("ABSTAIN")).alias("decision"),
        X.clamp_confidence("confidence").alias("confidence"),
        F.when(~found, F.lit("Failed to parse response"))
        .otherwise(F.coalesce("reasoning", F.lit("")))
        .alias("reasoning"),
        F.coalesce("attack_scenario", F.lit("")).alias("attack_scenario"),
        "parse_success",
        "format_detected",
        "needs_cleanup",
    )


def extract_loose_votes(responses: DataFrame) -> DataFrame:
    """Line-wise votes: the last vote and confidence lines win, keywords anywhere as fallback."""
    t = F.regexp_replace(F.regexp_replace("text", r"(?s)<thinking>.*?</thinking>", ""), r"(?s)<think>.*?</think>", "")
    staged = responses.withColumn("_t", strip_spaces(t)).withColumn("_lines", F.split("_t", "\n"))

    def category(line: Column) -> Column:
        low = F.lower(line)
        hit = F.when(low.contains("false_positive") | low.contains("false positive"), "FALSE_POSITIVE")
        hit = hit.when(low.contains("real"), "REAL")
        hit = hit.when(low.contains("needs_verified") | low.contains("needs verified"), "NEEDS_VERIFIED")
        hit = hit.when(low.contains("weakness"), "WEAKNESS")
        return F.when(low.contains("vote:") | low.contains("verdict:"), hit)

    number = lambda line: F.when(
        F.lower(line).contains("confidence"), capture(line, r"(\d+)").try_cast("bigint")
    )
    last = lambda a: F.try_element_at(F.array_compact(a), F.lit(-1))
    low = F.lower("_t")
    fallback = (
        F.when(low.contains("false positive") | low.contains("false_positive"), "FALSE_POSITIVE")
        .when(low.rlike(r"\breal\b"), "REAL")
        .when(low.contains("needs_verified") | low.contains("needs verified"), "NEEDS_VERIFIED")
        .when(low.contains("weakness"), "WEAKNESS")
    )
    reasoning = F.coalesce(capture(F.col("_t"), r"(?is)reasoning:\s*(.*)"), F.col("_t"))
    keep = [c for c in responses.columns if c != "text"]
    return staged.select(
        *keep,
        F.coalesce(last(F.transform("_lines", category)), fallback).alias("vote"),
        F.when(last(F.transform("_lines", number)) > 100, F.lit(100))
        .otherwise(last(F.transform("_lines", number)))
        .cast("int")
        .alias("confidence"),
        strip_spaces(reasoning).alias("reasoning"),
    )


def pipe_findings(records: DataFrame) -> DataFrame:
    """``CWE|file|line|sink|code`` lines to findings; the code keeps its pipes, line -1 drops out."""
    parts = F.split(F.trim("line"), r"\|", 5)
    split = (
        records.where(F.trim("line").startswith("CWE-"))
        .withColumn("_p", parts)
        .where(F.size("_p") >= 5)
    )
    line = F.col("_p")[2].try_cast("int")
    fields = split.where(line > 0).select(
        *[c for c in records.columns if c != "line"],
        F.col("_p")[0].alias("cwe"),
        F.regexp_replace(F.col("_p")[1], "^/app/", "").alias("file_path"),
        line.alias("line_number"),
        F.col("_p")[3].alias("sink"),
        F.col("_p")[4].alias("code"),
    )
    return fields.select(
        "*",
        F.concat(X.cwe_name("cwe"), F.lit(" via "), F.col("sink"), F.lit("()")).alias("title"),
        X.cwe_severity("cwe").alias("severity"),
        F.col("code").alias("snippet"),
        X.cwe_reason("cwe", "sink").alias("reason"),
    )


TOOL_CALL = r"(?is)^(.*?)\*TOOL_CALL\*(.+?)\*END_TOOL_CALL\*"
FINAL_ANSWER = r"(?is)^(.*?)\*FINAL_ANSWER\*(.+?)\*END_FINAL_ANSWER\*"
STEP_JSON = (
    "struct<thinking:string,action:struct<type:string,tool_name:string,"
    "tool_params:map<string,string>,answer:string>>"
)


def agent_steps(responses: DataFrame, json_format: bool = False) -> DataFrame:
    """Agent answers to steps: a tool call wins over a final answer in the same text."""
    t = F.col("text")
    block = capture(t, TOOL_CALL, 2)
    has_tool = block.isNotNull()
    final = capture(t, FINAL_ANSWER, 2)
    params = F.coalesce(
        F.from_json(capture(block, r"(?s)params:\s*(\{.+?\})"), "map<string,string>"),
        F.from_json(F.replace(capture(block, r"(?s)params:\s*(\{.+?\})"), F.lit("'"), F.lit('"')), "map<string,string>"),
    )
    marked = {
        "thought": F.when(has_tool, strip_spaces(F.regexp_extract(t, TOOL_CALL, 1)))
        .when(final.isNotNull(), strip_spaces(F.regexp_extract(t, FINAL_ANSWER, 1)))
        .otherwise(strip_spaces(t)),
        "tool_name": F.when(has_tool, capture(block, r"name:\s*(\w+)")),
        "tool_params": F.when(has_tool, params),
        "is_final": ~has_tool & final.isNotNull(),
        "final_answer": F.when(~has_tool, strip_spaces(final)),
    }
    keep = [c for c in responses.columns if c != "text"]
    if not json_format:
        return responses.select(*keep, *[c.alias(n) for n, c in marked.items()])
    step = F.from_json(capture(t, r"(?s)(\{.*\})"), STEP_JSON)
    action = step["action"]
    in_json = {
        "thought": F.coalesce(step["thinking"], F.lit("")),
        "tool_name": F.when(action["type"] == "tool_call", action["tool_name"]),
        "tool_params": F.when(action["type"] == "tool_call", action["tool_params"]),
        "is_final": F.coalesce(action["type"] == "final_answer", F.lit(False)),
        "final_answer": F.when(action["type"] == "final_answer", action["answer"]),
    }
    return responses.select(
        *keep, *[F.when(step.isNotNull(), in_json[n]).otherwise(c).alias(n) for n, c in marked.items()]
    )


def trace_rows(sessions: DataFrame) -> DataFrame:
    """Flatten ``trace`` arrays to one row a step."""
    keep = [c for c in sessions.columns if c != "trace"]
    return sessions.select(*keep, F.posexplode("trace").alias("pos", "s")).select(
        *keep,
        "pos",
        F.col("s.step").alias("step"),
        F.col("s.thought").alias("thought"),
        F.col("s.tool_name").alias("tool_name"),
        F.col("s.tool_result").alias("tool_result"),
    )
