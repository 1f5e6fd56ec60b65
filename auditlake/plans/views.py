"""Findings-shaped views over the driver tables, in Spark and in SQL.

Each view is plain integer and string arithmetic, so both engines agree on it and
its size follows the table it reads.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@dataclass(frozen=True)
class View:
    """``columns`` maps a name to one expression both engines read, or to a (Spark, SQL) pair."""

    base: str
    columns: dict[str, str | tuple[str, str]]
    where: str | None = None
    lateral: tuple[str, str] | None = None  # (Spark generator, SQL FROM item)

    def spark(self, source: DataFrame) -> DataFrame:
        if self.where:
            source = source.where(self.where)
        if self.lateral:
            source = source.selectExpr("*", self.lateral[0])
        return source.selectExpr(*[f"{_pick(e, 0)} AS {n}" for n, e in self.columns.items()])

    def sql(self) -> str:
        cols = ", ".join(f"{_pick(e, 1)} AS {n}" for n, e in self.columns.items())
        extra = f", {self.lateral[1]}" if self.lateral else ""
        cond = f" WHERE {self.where}" if self.where else ""
        return f"SELECT {cols} FROM {self.base}{extra}{cond}"


def _pick(expr: str | tuple[str, str], side: int) -> str:
    return expr if isinstance(expr, str) else expr[side]


def _both(spark: str, sql: str) -> tuple[str, str]:
    return (spark, sql)


_DRAFT_TYPE = (
    "CASE o_custkey % 6 WHEN 0 THEN 'Buffer Overflow' WHEN 1 THEN 'SQL Injection' "
    "WHEN 2 THEN 'Command Injection' WHEN 3 THEN 'Cross-Site Scripting' "
    "WHEN 4 THEN 'Memory Leak' ELSE 'Hardcoded Credentials' END"
)
_SEVERITY = (
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'Critical' WHEN '2' THEN 'High' "
    "WHEN '3' THEN 'Medium' ELSE 'Low' END"
)
_DECISION = (
    "CASE (l_partkey + 7 * l_suppkey) % 5 WHEN 0 THEN 'REAL' WHEN 1 THEN 'FALSE_POSITIVE' "
    "WHEN 2 THEN 'WEAKNESS' WHEN 3 THEN 'NEEDS_VERIFIED' ELSE 'ABSTAIN' END"
)
_TRIPLE = "CASE o_custkey % 3 WHEN 0 THEN 'REAL' WHEN 1 THEN 'FALSE_POSITIVE' ELSE 'WEAKNESS' END"
_EXT = (
    "CASE doc_id % 8 WHEN 0 THEN 'py' WHEN 1 THEN 'c' WHEN 2 THEN 'cpp' WHEN 3 THEN 'h' "
    "WHEN 4 THEN 'js' WHEN 5 THEN 'py' WHEN 6 THEN 'md' ELSE 'HPP' END"
)
_DIR = (
    "CASE doc_id % 7 WHEN 0 THEN 'tests' WHEN 1 THEN 'auth' WHEN 2 THEN 'core' "
    "WHEN 3 THEN 'vendor' WHEN 4 THEN 'src/parse' WHEN 5 THEN '.cache' ELSE 'lib' END"
)
_FILE_PATH = f"concat(source, '/', {_DIR}, '/f', doc_id, '.', {_EXT})"
_PHASE = (
    "CASE event_type WHEN 'signup' THEN 'draft' WHEN 'click' THEN 'verify' "
    "WHEN 'view' THEN 'enrich' ELSE 'scan' END"
)
_LOG_STATUS = (
    "CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'pending' "
    "WHEN 'view' THEN 'running' ELSE 'completed' END"
)
_ERROR_TEXT = (
    "CASE event_id % 6 WHEN 0 THEN 'Request timed out' WHEN 1 THEN 'HTTP 429 slow down' "
    "WHEN 2 THEN 'Model crashed' WHEN 3 THEN 'bad JSON' WHEN 4 THEN 'network down' ELSE 'odd' END"
)

# A code-like text per document: every line of the text yields one line of code that carries the
# line as its comment, with names taken from the hash of the line.
_PY_LINE = (
    "CASE {i} % 6 "
    "WHEN 0 THEN concat('import mod_', {h}, '  # ', {x}) "
    "WHEN 1 THEN concat('def fn_', {h}, '(user_input, size):  # ', {x}) "
    "WHEN 2 THEN concat('    key_', {h}, ' = request.args.get(name)  # ', {x}) "
    "WHEN 3 THEN concat('    fn_', {g}, '(key_', {h}, ')  # ', {x}) "
    "WHEN 4 THEN concat('    eval(request.args)  # ', {x}) "
    "ELSE concat('    return key_', {h}, '  # ', {x}) END"
)
_C_LINE = (
    "CASE {i} % 6 "
    "WHEN 0 THEN concat('#include \"mod_', {h}, '.h\" // ', {x}) "
    "WHEN 1 THEN concat('// ', {x}, chr(10), 'int fn_', {h}, '(char *input, int len) {{') "
    "WHEN 2 THEN concat('    char *buf = malloc(len); // ', {x}) "
    "WHEN 3 THEN concat('    fn_', {g}, '(buf); strcpy(buf, argv[1]); // ', {x}) "
    "WHEN 4 THEN concat('    free(buf); buf->next = 0; // ', {x}) "
    "ELSE concat('}} // ', {x}) END"
)


def _code_content(lines: str, transform: str, index: str, is_py: str) -> str:
    fields = {
        "i": index,
        "x": "x",
        "h": "substr(md5(x), 1, 2)",
        "g": "substr(md5(x), 3, 2)",
    }
    body = (
        f"CASE WHEN {is_py} THEN {_PY_LINE.format(**fields)} ELSE {_C_LINE.format(**fields)} END"
    )
    return transform.format(lines=lines, body=body)


_CODE = _both(
    _code_content(
        "split(text, '\\n')",
        "array_join(transform({lines}, (x, i) -> {body}), '\\n')",
        "i",
        "doc_id % 8 IN (0, 5)",
    ),
    _code_content(
        "string_split(text, chr(10))",
        "array_to_string(list_transform({lines}, lambda x, i: {body}), chr(10))",
        "(i - 1)",
        "doc_id % 8 IN (0, 5)",
    ),
)

# Model answers with drafts in every shape the extraction job meets.
_RESPONSE = (
    "CASE o_orderkey % 9 "
    "WHEN 0 THEN concat('*DRAFT: ', {t}, ' in parser', {n}, '*TYPE: CWE-', o_custkey % 12, {n}, '*SEVERITY: High', {n}, "
    "'*LINE: ', {l}, {n}, '*SNIPPET: copy(buf)', {n}, '*REASON: unchecked', {n}, '*END_DRAFT', {n}, "
    "'*DRAFT: Second issue', {n}, '*TYPE: CWE-79', {n}, '*LINE: line 7 of 9', {n}, '*END_DRAFT') "
    "WHEN 1 THEN concat('DRAFT: ', {t}, ' without stars', {n}, 'TYPE: CWE-', o_custkey % 12, {n}, 'SEVERITY: low', {n}, 'LINE: ', {l}) "
    "WHEN 2 THEN concat('**DRAFT: ', {t}, {n}, '*TYPE: CWE-20', {n}, '**SEVERITY:** Low', {n}, '**LINE:** ', {l}) "
    "WHEN 3 THEN concat('[{{\"title\": \"', {t}, '\", \"type\": \"CWE-1\", \"severity\": \"Low\", \"line\": ', {l}, '}}]') "
    "WHEN 4 THEN concat('Here it is: [{{\"name\": \"', {t}, '\", \"cwe\": \"CWE-2\", \"risk\": \"High\", \"lineno\": ', {l}, ',}},]') "
    "WHEN 5 THEN concat('<think>hm', {n}, 'DRAFT: no</think>', {n}, '## DRAFT: ', {t}, {n}, '*CWE: CWE-5', {n}, '*LINE_NUMBER: ', {l}, {n}, '*END_DRAFT') "
    "WHEN 6 THEN '*DRAFT:NONE' "
    "WHEN 7 THEN concat('I found a ', {t}, ' issue near line ', {l}, '. Also an Injection at ', {l} + 1, '.') "
    "ELSE concat('The order ', o_orderkey, ' looks odd') END"
).format(t=_DRAFT_TYPE, n="chr(10)", l="(o_orderkey % 12 + 1)")

_VOTE_TEXT = (
    "CASE l_linenumber "
    "WHEN 1 THEN concat('*VOTE: ', {d}, {n}, '*CONFIDENCE: ', {c}, {n}, '*REASONING: seen in line ', l_partkey, {n}, '*END_VERIFIED') "
    "WHEN 2 THEN concat('**VERDICT**: ', lower({d}), {n}, '**CONFIDENCE**: ', {c}, '%', {n}, 'REASON: because', {n}, 'ATTACK: none') "
    "WHEN 3 THEN concat('{{\"vote\": \"', {d}, '\", \"confidence\": ', {c}, ', \"reasoning\": \"json says so\"}}') "
    "WHEN 4 THEN concat('<think>REAL?</think>Vote: ', replace({d}, '_', ' '), {n}, 'Confidence is ', {c} + 50) "
    "WHEN 5 THEN concat('REJECTED: part ', l_partkey, {n}, '*REASON: not reachable', {n}, '*END_REJECTED') "
    "WHEN 6 THEN concat('*VERIFIED: part ', l_partkey, {n}, '*CONFIDENCE: ', {c}, {n}, '*ATTACK_VECTOR: network', {n}, '*ADJUSTED_SEVERITY: High', {n}, '*END') "
    "ELSE concat('I think this is a real problem of supplier ', l_suppkey) END"
).format(d=_DECISION, n="chr(10)", c="((l_partkey * 13 + l_suppkey * 17) % 101)")

_ENRICHED_TEXT = (
    "CASE o_orderkey % 3 "
    "WHEN 0 THEN concat('*FINDING: ', {t}, {n}, '*CATEGORY: CWE-', o_custkey % 12, {n}, '*SEVERITY: High', {n}, '*CVSS: 7.', o_custkey % 10, {n}, "
    "'*DETAILS: first', {n}, 'second line', {n}, '*POC: run it', {n}, '*REMEDIATION: fix it', {n}, '*REFERENCES: none', {n}, '*END_FINDING') "
    "WHEN 1 THEN concat('## TITLE: ', {t}, {n}, '**TYPE:** CWE-', o_custkey % 12, {n}, '**RISK:** Low', {n}, 'DESCRIPTION: plain', {n}, '**EXPLOIT:** none') "
    "ELSE concat('Vulnerability: ', {t}, {n}, 'Score: ', o_custkey % 10, {n}, 'Code: x = 1', {n}, 'Fix: x = 2', {n}, 'Links: a, b') END"
).format(t=_DRAFT_TYPE, n="chr(10)")

VIEWS: dict[str, View] = {
    "files": View(
        "documents",
        {
            "file_id": "doc_id",
            "scan_id": "doc_id % 10",
            "file_path": _FILE_PATH,
            "content": "text",
            "lang": "lang",
            "source": "source",
        },
    ),
    "code_files": View(
        "documents",
        {
            "file_id": "doc_id",
            "scan_id": "doc_id % 10",
            "file_path": _FILE_PATH,
            "content": _CODE,
        },
    ),
    "chunks": View(
        "documents",
        {
            "chunk_id": "doc_id * 100000 + k",
            "file_id": "doc_id",
            "scan_id": "doc_id % 10",
            "chunk_index": _both("CAST(k AS INT)", "CAST(k AS INT)"),
            "start_line": "CAST(k * 4 + 1 AS INT)",
            "end_line": _both(
                "CAST(least(k * 4 + 4, size(split(text, '\\n'))) AS INT)",
                "CAST(least(k * 4 + 4, len(string_split(text, chr(10)))) AS INT)",
            ),
            "status": (
                "CASE (doc_id + k) % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'scanning' "
                "WHEN 2 THEN 'scanned' ELSE 'failed' END"
            ),
            "retry_count": "CAST((doc_id + k) % 5 AS INT)",
            "content": _both(
                "array_join(slice(split(text, '\\n'), CAST(k * 4 + 1 AS INT), 4), '\\n')",
                "array_to_string(list_slice(string_split(text, chr(10)), k * 4 + 1, k * 4 + 4), chr(10))",
            ),
        },
        lateral=(
            "explode(sequence(0, (size(split(text, '\\n')) - 1) div 4)) AS k",
            "LATERAL (SELECT unnest(range(0, (len(string_split(text, chr(10))) - 1) // 4 + 1)) AS k) AS gen",
        ),
    ),
    "drafts": View(
        "orders",
        {
            "draft_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "file_id": "o_custkey",
            "line_number": "CAST(o_orderkey % 12 + 1 AS INT)",
            "title": f"concat({_DRAFT_TYPE}, ' in handler ', o_custkey % 20)",
            "vulnerability_type": f"concat('CWE-', o_custkey % 12)",
            "type_name": _DRAFT_TYPE,
            "severity": _SEVERITY,
            "status": "CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'rejected' ELSE 'weakness' END",
            "analyzer_name": "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE concat('m', o_custkey % 7) END",
            "initial_votes": "CASE o_orderkey % 4 WHEN 0 THEN NULL ELSE CAST(o_orderkey % 4 AS INT) END",
            "created_at": "o_orderdate",
        },
    ),
    "raw_drafts": View(
        "lineitem",
        {
            "raw_id": (
                "concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), "
                "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'))"
            ),
            "scan_id": "l_orderkey % 50",
            "file_id": "l_suppkey",
            "line_number": "CAST(l_partkey % 40 + 1 AS INT)",
            "vulnerability_type": "concat('CWE-', l_linenumber)",
            "severity": (
                "CASE l_partkey % 4 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' "
                "WHEN 2 THEN 'Medium' ELSE 'Low' END"
            ),
            "model": "concat('m', l_suppkey % 7)",
            "status": "CASE l_returnflag WHEN 'A' THEN 'verified' WHEN 'R' THEN 'rejected' ELSE 'pending' END",
            "votes": "CASE l_partkey % 5 WHEN 0 THEN NULL ELSE CAST(l_partkey % 5 AS INT) END",
        },
    ),
    "votes": View(
        "lineitem",
        {
            "vote_id": (
                "concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), "
                "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'))"
            ),
            "draft_id": "l_orderkey",
            "scan_id": "l_orderkey % 50",
            "model_name": "concat('m', l_suppkey % 7)",
            "decision": _DECISION,
            "confidence": "CAST((l_partkey * 13 + l_suppkey * 17) % 101 AS INT)",
            "weight": "CAST(1 + l_suppkey % 2 AS DOUBLE)",
        },
    ),
    "verified": View(
        "orders",
        {
            "verified_id": "o_orderkey + 1000000",
            "draft_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "confidence": "CAST(o_custkey % 101 AS INT)",
        },
        where="o_orderstatus = 'F' AND o_orderkey % 3 <> 0",
    ),
    "findings": View(
        "orders",
        {
            "finding_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "file_id": "o_custkey",
            "line_number": "CAST(o_orderkey % 12 + 1 AS INT)",
            "title": f"concat({_DRAFT_TYPE}, ' in handler ', o_custkey % 20)",
            "description": f"concat('Line ', o_orderkey % 12 + 1, ' allows ', {_DRAFT_TYPE})",
            "severity": _SEVERITY,
            "category": "concat('CWE-', o_custkey % 12)",
            "source_model": "concat('m', o_custkey % 7)",
            "confidence": "CAST(o_custkey % 101 AS INT)",
        },
        where="o_orderstatus = 'F'",
    ),
    "scans": View(
        "customer",
        {
            "scan_id": "c_custkey",
            "source_scan_id": (
                "CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 97 = 1 THEN c_custkey + 1 "
                "ELSE c_custkey - 1 END"
            ),
            "target": "c_name",
            "status": "CASE c_nationkey % 3 WHEN 0 THEN 'completed' WHEN 1 THEN 'running' ELSE 'failed' END",
        },
    ),
    "llm_log": View(
        "events",
        {
            "log_id": "event_id",
            "scan_id": "user_id % 20",
            "model_name": "concat('m', user_id % 7)",
            "phase": _PHASE,
            "status": _LOG_STATUS,
            "parse_success": "event_type <> 'error'",
            "tokens_in": "user_id * 10 + event_id % 100",
            "tokens_out": "event_id % 500",
            "duration_ms": "CAST(round(value * 100) AS BIGINT)",
            "created_at": "ts",
        },
    ),
    "errors": View(
        "events",
        {
            "error_id": "event_id",
            "scan_id": "user_id % 20",
            "model_name": "concat('m', user_id % 7)",
            "error_message": _ERROR_TEXT,
            "retry_count": "CAST(event_id % 5 AS INT)",
            "created_at": "ts",
        },
        where="event_type = 'error'",
    ),
    "tuning_cases": View(
        "orders",
        {
            "case_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "verdict": _TRIPLE,
            "cwe_type": "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE concat('CWE-', o_custkey % 12) END",
            "is_synthetic": "o_orderkey % 4 = 0",
        },
    ),
    "tuning_results": View(
        "lineitem",
        {
            "result_id": (
                "concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), "
                "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'))"
            ),
            "model_name": "concat('m', l_suppkey % 7)",
            "prompt_id": "concat('p', l_partkey % 20)",
            "case_id": "l_orderkey",
            "predicted_vote": "CASE WHEN l_linenumber = 7 THEN NULL ELSE " + _DECISION + " END",
            "confidence": (
                "CASE WHEN l_linenumber = 7 THEN NULL "
                "ELSE CAST((l_partkey * 13 + l_suppkey * 17) % 101 AS INT) END"
            ),
            "parse_success": "l_linenumber <> 7",
            "duration_ms": "CAST(l_quantity AS BIGINT) * 10",
            "tokens_in": "l_partkey",
            "tokens_out": "l_suppkey",
        },
    ),
    "prices": View(
        "nation",
        {
            "model_name": "concat('m', n_nationkey)",
            "price_in": "CAST(n_regionkey + 1 AS DOUBLE) / 100",
            "price_out": "CAST(n_regionkey + 2 AS DOUBLE) / 100",
        },
        where="n_nationkey < 5",
    ),
    "responses": View(
        "orders",
        {
            "response_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "model": "concat('m', o_custkey % 7)",
            "text": _RESPONSE,
        },
    ),
    "talk": View(
        "conversations",
        {"response_id": "-1 - (conv_id * 1000 + turn)", "text": "text"},
        where="role = 'assistant'",
    ),
    "vote_texts": View(
        "lineitem",
        {
            "vote_id": (
                "concat_ws('-', lpad(CAST(l_orderkey AS STRING), 12, '0'), CAST(l_linenumber AS STRING), "
                "lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'))"
            ),
            "draft_id": "l_orderkey",
            "model_name": "concat('m', l_suppkey % 7)",
            "text": _VOTE_TEXT,
        },
    ),
    "enriched_texts": View("orders", {"draft_id": "o_orderkey", "text": _ENRICHED_TEXT}),
    "enriched": View(
        "orders",
        {
            "draft_id": "o_orderkey",
            "finding": _DRAFT_TYPE,
            "category": "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE concat('CWE-', o_custkey % 12) END",
            "severity": f"CASE WHEN o_orderkey % 4 = 0 THEN '  ' ELSE {_SEVERITY} END",
            "vulnerability_details": "CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'details' END",
            "proof_of_concept": "CASE WHEN o_custkey % 2 = 0 THEN '' ELSE 'poc' END",
            "remediation_steps": "CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE 'fix' END",
        },
    ),
    "changes": View(
        "orders",
        {
            "change_id": "o_orderkey",
            "watcher_id": "o_custkey % 20",
            "iid": "o_orderkey % 500",
            "target_branch": (
                "CASE o_custkey % 5 WHEN 0 THEN 'main' WHEN 1 THEN 'release/1.2' "
                "WHEN 2 THEN 'feature/x' WHEN 3 THEN 'mainline' ELSE 'hotfix' END"
            ),
            "labels": _both(
                "CASE o_orderkey % 3 WHEN 0 THEN array('Security', 'bug') WHEN 1 THEN array('docs') "
                "ELSE cast(array() AS array<string>) END",
                "CASE o_orderkey % 3 WHEN 0 THEN ['Security', 'bug'] WHEN 1 THEN ['docs'] ELSE [] END",
            ),
            "status": "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END",
            "reviewed_at": "CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate END",
            "created_at": "o_orderdate",
        },
    ),
    "diffs": View(
        "documents",
        {
            "change_id": "doc_id",
            "diff": _both(
                "array_join(transform(split(text, '\\n'), (x, i) -> CASE i % 7 "
                "WHEN 0 THEN concat('@@ -', i + 1, ',6 +', i * 2 + 1, CASE WHEN i % 2 = 0 THEN ',6' ELSE '' END, ' @@ part ', i) "
                "WHEN 1 THEN concat(' ', x) WHEN 2 THEN concat('-', x) WHEN 3 THEN concat('+', x) "
                "WHEN 4 THEN concat('+', x) WHEN 5 THEN concat('---', x) ELSE concat('+++', x) END), '\\n')",
                "array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: CASE (i - 1) % 7 "
                "WHEN 0 THEN concat('@@ -', i, ',6 +', (i - 1) * 2 + 1, CASE WHEN (i - 1) % 2 = 0 THEN ',6' ELSE '' END, ' @@ part ', i - 1) "
                "WHEN 1 THEN concat(' ', x) WHEN 2 THEN concat('-', x) WHEN 3 THEN concat('+', x) "
                "WHEN 4 THEN concat('+', x) WHEN 5 THEN concat('---', x) ELSE concat('+++', x) END), chr(10))",
            ),
        },
    ),
    "pipe_records": View(
        "orders",
        {
            "record_id": "o_orderkey",
            "line": (
                "concat(CASE o_custkey % 15 WHEN 0 THEN 'CWE-22' WHEN 1 THEN 'CWE-78' WHEN 2 THEN 'CWE-89' WHEN 3 THEN 'CWE-120' "
                "WHEN 4 THEN 'CWE-134' WHEN 5 THEN 'CWE-190' WHEN 6 THEN 'CWE-269' WHEN 7 THEN 'CWE-327' WHEN 8 THEN 'CWE-415' "
                "WHEN 9 THEN 'CWE-416' WHEN 10 THEN 'CWE-749' WHEN 11 THEN 'CWE-789' WHEN 12 THEN 'CWE-798' WHEN 13 THEN 'CWE-824' "
                "ELSE 'CWE-999' END, '|/app/src/f', o_custkey, '.c|', o_orderkey % 40 - 1, '|sink', o_custkey % 9, '|a | b | c', o_orderkey)"
            ),
        },
    ),
    "alert_findings": View(
        "orders",
        {
            "finding_id": "o_orderkey",
            "scan_id": "o_orderkey % 50",
            "title": _DRAFT_TYPE,
            "severity": f"upper({_SEVERITY})",
            "snippet": (
                "CASE o_custkey % 11 WHEN 0 THEN 'spawn reverse shell' WHEN 1 THEN 'add crontab entry' "
                "WHEN 2 THEN 'read /etc/shadow' WHEN 3 THEN 'sudo ALL NOPASSWD' WHEN 4 THEN 'join monero pool, send it to the server' "
                "WHEN 5 THEN 'eval(base64 text)' WHEN 6 THEN 'chmod u+s x' ELSE 'plain text' END"
            ),
        },
    ),
    "subscriptions": View(
        "nation",
        {
            "webhook_id": "n_nationkey",
            "webhook_name": "n_name",
            "events": _both(
                "CASE n_nationkey % 3 WHEN 0 THEN array('finding', 'scan_complete') WHEN 1 THEN array('finding') ELSE array('scan_complete') END",
                "CASE n_nationkey % 3 WHEN 0 THEN ['finding', 'scan_complete'] WHEN 1 THEN ['finding'] ELSE ['scan_complete'] END",
            ),
            "min_severity": "CASE n_regionkey WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'LOW' ELSE NULL END",
            "enabled": "n_nationkey <> 4",
        },
    ),
    "edges": View(
        "lineitem",
        {
            "caller": "l_suppkey % 100",
            "callee": "l_partkey % 100",
            "from_file": "l_orderkey % 40",
        },
    ),
    "truth": View(
        "labels",
        {
            "file_id": "doc_id",
            "label": "CASE WHEN toxic = 1 THEN 'TP' WHEN quality = 0 THEN 'DEBATABLE' ELSE 'FP' END",
            "verdict": (
                "CASE WHEN toxic = 1 THEN 'REAL' WHEN quality = 0 THEN 'WEAKNESS' ELSE 'FALSE_POSITIVE' END"
            ),
        },
    ),
}


# Views whose rows cost far more than reading them. A caller who knows that the tables have fewer
# splits than cores sets this session property to a number of partitions; by default nothing moves.
SCAN_PARTITIONS = "auditlake.scan.partitions"
COSTLY_VIEWS = (
    "files code_files chunks diffs responses vote_texts enriched_texts alert_findings documents "
    "talk conversations"
).split()


class Views:
    """The driver tables and the derived views of one scale-factor directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS and name not in TABLES:
            raise AttributeError(name)
        source = self.table(VIEWS[name].base if name in VIEWS else name)
        wanted = self.spark.conf.get(SCAN_PARTITIONS, None)
        if wanted and name in COSTLY_VIEWS:
            source = source.repartition(int(wanted))
        return VIEWS[name].spark(source) if name in VIEWS else source


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the derived views it names."""
    used = [name for name in VIEWS if re.search(rf"\b{name}\b", sql)]
    body = sql.strip()
    if not used:
        return body
    defs = ",\n".join(f"{name} AS ({VIEWS[name].sql()})" for name in used)
    head = re.match(r"WITH\s+(RECURSIVE\s+)?", body)
    if head:
        return f"WITH {head.group(1) or ''}{defs},\n{body[head.end():]}"
    return f"WITH {defs}\n{body}"
