"""Queries over code texts: rules, symbols, chunks, searches, call graphs."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from auditlake.operators import assembly as A, chunking as C, context as X, graph as G, postings as O, rules as R, search as Q, symbols as S
from auditlake.plans.filters import LANG, quote
from auditlake.plans.registry import query
from auditlake.session import scratch_path

SAFE_RULES = [r for r in R.DEFAULT_RULES if r.rule_id not in R.BACKREFERENCE_RULES]
BACK_RULES = [r for r in R.DEFAULT_RULES if r.rule_id in R.BACKREFERENCE_RULES]


def _values(rules) -> str:
    rows = ", ".join(
        f"({r.rule_id}, {quote(r.name)}, {quote('(?im)' + r.pattern)}, [{', '.join(map(quote, r.languages))}], {quote(r.cwe_id)}, {quote(r.severity)})"
        for r in rules
    )
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS v(rule_id, name, pattern, languages, cwe_id, severity))"


def _matches_sql(view: str, rules) -> str:
    arms = " UNION ALL ".join(
        f"SELECT file_id, {r.rule_id} AS rule_id, unnest(regexp_extract_all(content, {quote('(?im)' + r.pattern)})) AS m, "
        f"unnest(string_split_regex(content, {quote('(?im)' + r.pattern)})[:-2]) AS g, "
        f"generate_subscripts(regexp_extract_all(content, {quote('(?im)' + r.pattern)}), 1) AS k FROM {view} "
        f"WHERE {LANG} IN ({', '.join(map(quote, r.languages))})"
        for r in rules
    )
    return f"""found AS ({arms}),
    placed AS (SELECT *, CAST(1 + sum(len(g) - len(replace(g, chr(10), '')) + len(m) - len(replace(m, chr(10), ''))) OVER (PARTITION BY file_id, rule_id ORDER BY k)
      - (len(m) - len(replace(m, chr(10), ''))) AS INT) AS line_number FROM found)"""


_SCAN = _matches_sql("files", SAFE_RULES)
_CODE_SCAN = _matches_sql("code_files", SAFE_RULES)


@query(
    "c6_rule_scan",
    f"""WITH {_SCAN} SELECT p.file_id, f.scan_id, f.file_path, {LANG.replace('file_path', 'f.file_path')} AS language, rule_id, line_number, m AS match_text,
      array_to_string(list_slice(string_split(content, chr(10)), greatest(line_number - 1, 1), line_number + 1), chr(10)) AS snippet
    FROM placed p JOIN files f USING (file_id)""",
)
def c6(t):
    return R.scan_rules(t.files, SAFE_RULES)


@query(
    "c6_rule_scan_code",
    f"WITH {_CODE_SCAN} SELECT file_id, rule_id, line_number, m AS match_text FROM placed",
)
def c6_code(t):
    return R.scan_rules(t.code_files, SAFE_RULES).select("file_id", "rule_id", "line_number", "match_text")


# RE2 has no backreferences. The only pointer the code texts free is buf, so its name stands in.
_BUF_RULES = [replace(r, pattern=r.pattern.replace(r"(\w+)", "buf").replace(r"\1", "buf")) for r in BACK_RULES]


@query(
    "c6_backreference_rules",
    f"WITH {_matches_sql('code_files', _BUF_RULES)} SELECT file_id, rule_id, line_number, m AS match_text FROM placed",
)
def c6_back(t):
    return R.scan_rules(t.code_files, BACK_RULES).select("file_id", "rule_id", "line_number", "match_text")


@query(
    "w8_snippet",
    """SELECT file_id, line_number, array_to_string(list_slice(string_split(content, chr(10)), greatest(line_number - 1, 1), line_number + 1), chr(10)) AS snippet
    FROM (SELECT DISTINCT file_id, line_number FROM drafts) d JOIN files USING (file_id)""",
)
def w8(t):
    lines = t.drafts.select("file_id", "line_number").distinct()
    return lines.join(t.files.select("file_id", "content"), "file_id").select(
        "file_id", "line_number", X.snippet("content", F.col("line_number")).alias("snippet")
    )


@query(
    "a44_rule_hits",
    f"""WITH {_values(R.DEFAULT_RULES)}, {_SCAN}, c AS (SELECT rule_id, count(*) AS hits, count(DISTINCT file_id) AS files FROM placed GROUP BY rule_id)
    SELECT r.rule_id, name, severity, coalesce(hits, 0) AS hits, coalesce(c.files, 0) AS files FROM rules r LEFT JOIN c USING (rule_id)""",
)
def a44(t):
    return R.rule_hits(R.count_rules(t.files), R.rule_table(t.spark))


@query(
    "j10_rule_candidates",
    f"""WITH {_values(SAFE_RULES)}, l AS (SELECT file_id, content, {LANG} AS language FROM code_files),
    i AS (SELECT rule_id, pattern, unnest(languages) AS language FROM rules)
    SELECT file_id, language, rule_id FROM l JOIN i USING (language) WHERE regexp_matches(content, pattern)""",
)
def j10(t):
    return R.rule_candidates(t.code_files, R.rule_table(t.spark, SAFE_RULES))


@query(
    "e1_rule_test",
    r"""WITH m AS (SELECT doc_id AS sample_id, text, unnest(regexp_extract_all(text, '(?im)(token|secret)\s*=\s*["''][^"'']+["'']')) AS match,
        unnest(string_split_regex(text, '(?im)(token|secret)\s*=\s*["''][^"'']+["'']')[:-2]) AS g,
        generate_subscripts(regexp_extract_all(text, '(?im)(token|secret)\s*=\s*["''][^"'']+["'']'), 1) AS k FROM documents),
    p AS (SELECT *, sum(length(g) + length(match)) OVER (PARTITION BY sample_id ORDER BY k) AS e FROM m)
    SELECT sample_id, 1 AS rule_id, match, CAST(e - length(match) AS INT) AS start, CAST(e AS INT) AS "end",
      CAST(len(string_split(substr(text, 1, CAST(e - length(match) AS INT)), chr(10))) AS INT) AS line FROM p""",
)
def e1(t):
    base = R.DEFAULT_RULES[0]
    rules = [
        R.Rule(1, "assigned secret", r"(token|secret)\s*=\s*[\"'][^\"']+[\"']", base.languages, "CWE-798", "x", "High", ""),
        R.Rule(2, "broken", r"(unclosed", base.languages, "CWE-1", "x", "Low", ""),
        R.Rule(3, "empty", r"x*", base.languages, "CWE-1", "x", "Low", ""),
    ]
    hits, _ = R.test_rules(t.documents.selectExpr("doc_id AS sample_id", "text"), rules)
    return hits


_SPANS = r"""cl AS (SELECT file_id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code_files),
    df AS (SELECT *, coalesce(nullif(regexp_extract(line, '^(?:static\s+)?(?:inline\s+)?(?:[\w\*]+\s+)+(\w+)\s*\([^)]*\)\s*\{?\s*$', 1), ''),
      nullif(regexp_extract(line, '^def\s+(\w+)\s*\([^)]*\)\s*:', 1), ''), nullif(regexp_extract(line, '^(?:VOID|EFI_STATUS|BOOLEAN|UINTN|UINT\d+)\s*\n?(\w+)\s*\(', 1), '')) AS name FROM cl),
    ff AS (SELECT *, max(CASE WHEN name IS NOT NULL THEN n END) OVER (PARTITION BY file_id ORDER BY n) AS start_line FROM df),
    fn AS (SELECT *, first_value(name) OVER (PARTITION BY file_id, start_line ORDER BY n) AS function,
      sum(len(line) - len(replace(line, '{', '')) - len(line) + len(replace(line, '}', ''))) OVER (PARTITION BY file_id, start_line ORDER BY n) AS depth,
      sum(len(line) - len(replace(line, '{', ''))) OVER (PARTITION BY file_id, start_line ORDER BY n) AS opens FROM ff WHERE start_line IS NOT NULL),
    cb AS (SELECT *, coalesce(max(CASE WHEN opens > 0 AND depth <= 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, start_line ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM fn),
    spans AS (SELECT file_id, file_path, n AS line_number, line, function, start_line FROM cb WHERE closed = 0),
    symbols AS (SELECT file_id, file_path, function AS name, start_line, max(line_number) AS end_line FROM spans GROUP BY ALL)"""
_CALLS = _SPANS + r""",
    raw_calls AS (SELECT cl.file_id, s.function, s.start_line, cl.n AS line_number, unnest(regexp_extract_all(cl.line, '\b([a-zA-Z_][a-zA-Z0-9_]*)\s*\(', 1)) AS callee
      FROM cl LEFT JOIN spans s ON s.file_id = cl.file_id AND s.line_number = cl.n),
    calls AS (SELECT * FROM raw_calls WHERE callee IS DISTINCT FROM function)"""


@query("w10_enclosing_function", f"WITH {_SPANS} SELECT file_id, CAST(line_number AS INT) AS line_number, function, CAST(start_line AS INT) AS start_line FROM spans")
def w10(t):
    return S.enclosing_functions(t.code_files).select("file_id", "line_number", "function", "start_line")


@query("c8_symbols", f"WITH {_SPANS} SELECT file_id, name, CAST(start_line AS INT) AS start_line, CAST(end_line AS INT) AS end_line FROM symbols")
def c8(t):
    return S.symbol_table(t.code_files).select("file_id", "name", "start_line", "end_line")


@query(
    "c8_imports",
    r"""SELECT file_id, CAST(n AS INT) AS line_number, module FROM (SELECT *, coalesce(nullif(regexp_extract(line, '^\s*(?:import|from)\s+([\w.]+)', 1), ''),
      nullif(regexp_extract(line, '^\s*#include\s*[<"]([^>"]+)[>"]', 1), '')) AS module FROM (SELECT file_id, unnest(string_split(content, chr(10))) AS line,
      generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code_files)) WHERE module IS NOT NULL""",
)
def c8_imports(t):
    return S.import_table(t.code_files).select("file_id", "line_number", "module")


@query("c8_calls", f"WITH {_CALLS} SELECT file_id, function, CAST(line_number AS INT) AS line_number, callee FROM calls")
def c8_calls(t):
    return S.call_table(t.code_files).select("file_id", "function", "line_number", "callee")


def _sinks(query_set: str) -> str:
    """The sink query of one set; double-free needs two calls of free in a function."""
    tags = ", ".join(f"CASE WHEN regexp_matches(callee, '^({names})$') THEN '{cwe}' END" for cwe, names in R.SINK_SETS[query_set])
    return f"""WITH {_CALLS}, tagged AS (SELECT *, unnest(list_distinct(list_filter([{tags}], lambda x: x IS NOT NULL))) AS cwe FROM calls),
    rep AS (SELECT file_id, function FROM calls WHERE callee = 'free' AND function IS NOT NULL GROUP BY ALL HAVING count(*) > 1)
    SELECT file_id, function, CAST(line_number AS INT) AS line_number, callee, cwe FROM tagged WHERE cwe <> 'CWE-415'
      OR (file_id, function) IN (SELECT (file_id, function) FROM rep)"""


def _register_sinks(query_set: str) -> None:
    @query(f"c7_sinks_{query_set}", _sinks(query_set))
    def sinks(t):
        return R.sink_calls(S.call_table(t.code_files), query_set).select("file_id", "function", "line_number", "callee", "cwe")


for _set in R.SINK_SETS:
    _register_sinks(_set)


@query("j13_callers", f"""WITH {_CALLS}, tg AS (SELECT DISTINCT name AS callee, file_id AS target_file FROM symbols)
    SELECT callee, target_file, file_id, function, CAST(line_number AS INT) AS line_number FROM calls JOIN tg USING (callee)""")
def j13(t):
    return Q.callers(S.call_table(t.code_files), S.symbol_table(t.code_files))


_EDGES = """ed AS (SELECT DISTINCT function AS caller, callee FROM calls WHERE function IS NOT NULL
      AND callee NOT IN ('if', 'for', 'while', 'switch', 'return', 'sizeof', 'printf', 'fprintf'))"""


@query(
    "c14_call_graph",
    f"""WITH {_CALLS}, {_EDGES}
    SELECT caller AS function, 'calls' AS direction, callee AS other FROM ed UNION ALL SELECT callee, 'called_by', caller FROM ed""",
)
def c14(t):
    return Q.call_graph(S.call_table(t.code_files))


@query(
    "c14_bounded_call_graph",
    f"""WITH {_CALLS}, {_EDGES}, dn AS (SELECT caller, callee FROM ed QUALIFY row_number() OVER (PARTITION BY caller ORDER BY callee) <= 2)
    SELECT caller AS function, 'calls' AS direction, callee AS other FROM dn UNION ALL SELECT callee, 'called_by', caller FROM ed""",
)
def c14_bounded(t):
    return Q.call_graph(S.call_table(t.code_files), callees=2)


def _chains(callers: str, last: str) -> str:
    """Reachable pairs by depth; no shortest chain is longer than there are functions (100 here)."""
    return f"""WITH RECURSIVE e AS (SELECT DISTINCT callee AS node, caller AS nxt FROM edges),
    up AS (SELECT node, nxt FROM e {callers}),
    r AS (SELECT DISTINCT f AS function, f AS node, 0 AS depth FROM (SELECT callee AS f FROM edges UNION SELECT caller FROM edges)
      UNION SELECT r.function, up.nxt, r.depth + 1 FROM r JOIN up ON up.node = r.node WHERE r.depth < 100 AND r.node % 17 <> 0),
    m AS (SELECT function, node AS entry, min(depth) AS depth FROM r WHERE node % 17 = 0 GROUP BY ALL)
    SELECT function, entry, depth FROM m {last}"""


def _entries(t):
    return t.edges.where("caller % 17 = 0").selectExpr("caller AS function").union(
        t.edges.where("callee % 17 = 0").selectExpr("callee")
    )


@query("c9_call_chains", _chains("", ""))
def c9(t):
    return G.entry_reach(t.edges, _entries(t))


@query(
    "c9_bounded_chains",
    _chains(
        "QUALIFY row_number() OVER (PARTITION BY node ORDER BY nxt) <= 3",
        "QUALIFY row_number() OVER (PARTITION BY function ORDER BY depth, entry) <= 5",
    ),
)
def c9_bounded(t):
    return Q.chains_to_entry(t.edges, _entries(t), callers_per_node=3, chains=5).select("function", "entry", "depth")


_CODE_LINES = "cl AS (SELECT file_id, scan_id, file_path, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM code_files)"


@query(
    "c10_entry_points",
    f"""WITH {_CODE_LINES} {' UNION ALL '.join(f"SELECT file_id, CAST(n AS INT) AS line_number, trim(line) AS name, {quote(k)} AS type, {quote(r)} AS risk FROM cl WHERE regexp_matches(line, {quote(p)})" for p, k, r in Q.ENTRY_PATTERNS)}""",
)
def c10(t):
    return Q.entry_points(t.code_files)


@query(
    "o6_entry_calls",
    f"""WITH {_CODE_LINES}, h AS ({' UNION ALL '.join(f"SELECT {i} AS pattern_no, {quote(d)} AS kind, file_id, CAST(n AS INT) AS line_number FROM cl WHERE regexp_matches(line, {quote(p)})" for i, (p, d) in enumerate(Q.ENTRY_CALLS))})
    SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY pattern_no ORDER BY file_id, line_number) <= 5""",
)
def o6(t):
    return Q.entry_calls(t.code_files)


@query("c12_code_search", f"WITH {_CODE_LINES} SELECT file_id, CAST(n AS INT) AS line_number, line FROM cl WHERE regexp_matches(line, 'fn_[0-9]a\\s*\\(')")
def c12(t):
    return Q.search_code(t.code_files, r"fn_[0-9]a\s*\(", limit=None)


def _index(t):
    return O.build_index(t.code_files.select("file_id", "content"), scratch_path(t.spark, "postings"))


@query("c12_indexed_search", f"WITH {_CODE_LINES} SELECT file_id, CAST(n AS INT) AS line_number, line FROM cl WHERE regexp_matches(line, 'fn_[0-9]a\\s*\\(')")
def c12_indexed(t):
    return O.search_index(t.spark, _index(t), r"fn_[0-9]a\s*\(")


@query("c12_indexed_references", f"WITH {_CODE_LINES} SELECT file_id, CAST(n AS INT) AS line_number, line FROM cl WHERE regexp_matches(line, '\\bfn_aa\\b')")
def c12_indexed_refs(t):
    return O.search_index(t.spark, _index(t), r"\bfn_aa\b")


@query("c12_bounded_search", f"WITH {_CODE_LINES} SELECT file_id, CAST(n AS INT) AS line_number, line FROM cl WHERE regexp_matches(line, 'malloc') ORDER BY file_id, n LIMIT 50")
def c12_bounded(t):
    return Q.search_code(t.code_files, "malloc")


@query("c12_references", f"WITH {_CODE_LINES} SELECT file_id, CAST(n AS INT) AS line_number, line FROM cl WHERE regexp_matches(line, '\\bfn_aa\\b')")
def c12_refs(t):
    return Q.references(t.code_files, "fn_aa")


@query(
    "c13_definitions",
    f"""WITH {_SPANS}, w AS (SELECT DISTINCT concat('fn_', substr(md5(n_name), 1, 2)) AS name FROM nation)
    SELECT name, 0 AS tier, file_id, CAST(start_line AS INT) AS line_number FROM symbols SEMI JOIN w USING (name)
    QUALIFY row_number() OVER (PARTITION BY name ORDER BY file_id, start_line) = 1""",
)
def c13(t):
    wanted = t.nation.selectExpr("concat('fn_', substr(md5(n_name), 1, 2)) AS name").distinct()
    return Q.definitions(S.symbol_table(t.code_files), t.code_files, wanted)


@query(
    "c13_function_bodies",
    f"""WITH {_SPANS} SELECT s.file_id, name, CAST(start_line AS INT) AS start_line, md5(array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))) AS body
    FROM symbols s JOIN code_files c ON c.file_id = s.file_id""",
)
def c13_bodies(t):
    return Q.function_bodies(S.symbol_table(t.code_files), t.code_files).withColumn("body", F.md5("body"))


def _app_sql() -> str:
    re = lambda c, ws: f"bool_or(regexp_matches({c}, {quote('|'.join(w.replace('.', chr(92) + '.') for w in ws))}))"
    models = " ".join(f"WHEN {quote(k)} THEN {quote(v)}" for k, v in Q.THREAT_MODELS.items())
    return f"""WITH {_CODE_LINES}, im AS (SELECT scan_id, coalesce(nullif(regexp_extract(line, '^\\s*(?:import|from)\\s+([\\w.]+)', 1), ''),
        nullif(regexp_extract(line, '^\\s*#include\\s*[<"]([^>"]+)[>"]', 1), '')) AS module FROM cl),
    i AS (SELECT scan_id, {re('lower(module)', Q.WEB_WORDS)} AS wi, {re('lower(module)', Q.NETWORK_WORDS)} AS ni FROM im WHERE module IS NOT NULL GROUP BY scan_id),
    p AS (SELECT scan_id, {re('lower(file_path)', Q.WEB_WORDS)} AS wp, {re('lower(file_path)', Q.NETWORK_WORDS)} AS np, {re('lower(file_path)', Q.CLI_WORDS)} AS cl, {re('lower(file_path)', Q.LIBRARY_WORDS)} AS lb FROM code_files GROUP BY scan_id),
    k AS (SELECT scan_id, CASE WHEN wp OR coalesce(wi, false) THEN 'Web Application' WHEN np OR coalesce(ni, false) THEN 'Network Service' WHEN cl THEN 'CLI Tool' WHEN lb THEN 'Library' ELSE 'Unknown' END AS app_type FROM p LEFT JOIN i USING (scan_id))
    SELECT scan_id, app_type, CASE app_type {models} END AS threat_model FROM k"""


@query("c11_application_type", _app_sql())
def c11(t):
    imports = S.import_table(t.code_files).join(t.code_files.select("file_id", "scan_id"), "file_id")
    return Q.application_types(t.code_files, imports)


@query(
    "c17_bounded_mentions",
    f"""WITH {_CODE_LINES}, w AS (SELECT file_id, n, unnest(list_distinct(regexp_extract_all(line, '(\\w+)\\s*\\(', 1))) AS name FROM cl),
    tg AS (SELECT doc_id AS home, concat('fn_', substr(md5(text), 1, 2)) AS name FROM documents JOIN labels USING (doc_id))
    SELECT name, home, file_id, CAST(n AS INT) AS line_number, CAST(row_number() OVER (PARTITION BY name, home ORDER BY file_id, n) AS INT) AS rn
    FROM w JOIN tg USING (name) WHERE file_id <> home QUALIFY rn <= 10""",
)
def c17_bounded(t):
    names = t.documents.join(t.labels, "doc_id").selectExpr("doc_id AS file_id", "concat('fn_', substr(md5(text), 1, 2)) AS name")
    return Q.mentions(t.code_files, names, 10)


@query(
    "c17_mentions",
    f"""WITH {_CODE_LINES}, w AS (SELECT file_id, n, unnest(list_distinct(regexp_extract_all(line, '(\\w+)\\s*\\(', 1))) AS name FROM cl),
    tg AS (SELECT doc_id AS home, concat('fn_', substr(md5(text), 1, 2)) AS name FROM documents JOIN labels USING (doc_id))
    SELECT name, home, file_id, CAST(n AS INT) AS line_number FROM w JOIN tg USING (name) WHERE file_id <> home""",
)
def c17(t):
    names = t.documents.join(t.labels, "doc_id").selectExpr("doc_id AS file_id", "concat('fn_', substr(md5(text), 1, 2)) AS name")
    return Q.mentions(t.code_files, names)


@query(
    "w9_variable_trace",
    f"""WITH {_CODE_LINES}, tg AS (SELECT doc_id AS file_id, 4 AS target, 'buf' AS variable FROM labels),
    nr AS (SELECT cl.file_id, target, variable, CAST(n AS INT) AS line_number, line FROM tg JOIN cl USING (file_id) WHERE n BETWEEN target - 99 AND target + 50),
    pl AS (SELECT file_id, target, variable, line_number, CASE WHEN line_number > target AND regexp_matches(line, '\\bbuf\\b') THEN 'use'
      WHEN line_number BETWEEN target - 48 AND target AND regexp_matches(line, '\\bbuf\\s*:?=\\s*.+') THEN 'assignment' END AS kind FROM nr),
    pm AS (SELECT file_id, target, variable, min(line_number) AS line_number, 'parameter' AS kind FROM nr WHERE line_number <= target
      AND regexp_matches(line, '(?:def|void|int|char)\\s+\\w+\\s*\\([^)]*\\bbuf\\b') GROUP BY ALL)
    SELECT * FROM pl WHERE kind IS NOT NULL UNION ALL SELECT * FROM pm""",
)
def w9(t):
    targets = t.labels.selectExpr("doc_id AS file_id", "4 AS line_number", "'buf' AS variable")
    return Q.variable_trace(t.code_files, targets)


@query(
    "w7_chunk_context",
    """WITH c AS (SELECT chunk_id, start_line, end_line, string_split(f.content, chr(10)) AS l FROM chunks c JOIN files f USING (file_id)),
    s AS (SELECT *, greatest(start_line - 10, 1) AS lo FROM c)
    SELECT chunk_id, array_to_string(list_transform(list_slice(l, lo, end_line + 10), lambda x, i: concat(CASE WHEN i + lo - 1 BETWEEN start_line AND end_line THEN '>>> ' ELSE '    ' END, i + lo - 1, ': ', rtrim(x))), chr(10)) AS context FROM s""",
)
def w7(t):
    return X.chunk_context(t.chunks, t.files, around=10)


def _spans_sql(limit: int, overlap: int) -> str:
    """Greedy spans: ``reach`` is how far a chunk that starts at a line can go."""
    return f"""ln AS (SELECT file_id, length(unnest(string_split(content, chr(10)))) AS k, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM files),
    pre AS (SELECT file_id, n, k, sum(k) OVER (PARTITION BY file_id ORDER BY n) AS p, count(*) OVER (PARTITION BY file_id) AS total FROM ln),
    reach AS (SELECT a.file_id, a.n AS s, any_value(a.total) AS total, max(b.n) AS e FROM pre a LEFT JOIN pre b
      ON a.file_id = b.file_id AND b.n >= a.n AND b.p - a.p + a.k <= {limit} GROUP BY a.file_id, a.n),
    r AS (SELECT file_id, 0 AS part, s, CAST(greatest(coalesce(e, 1), 1) AS BIGINT) AS e, total FROM reach WHERE s = 1
      UNION ALL SELECT r.file_id, r.part + 1, x.s, CAST(greatest(coalesce(x.e, r.e + 1), r.e + 1) AS BIGINT), r.total
      FROM r JOIN reach x ON x.file_id = r.file_id AND x.s = greatest(r.s, r.e + 1 - {overlap}) WHERE r.e < r.total)"""


_LINE_CHUNKS = f"""WITH RECURSIVE {_spans_sql(600, 10)},
    ch AS (SELECT r.file_id, CAST(part AS INT) AS chunk_index, 'block' AS chunk_type, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line, content FROM r JOIN files f USING (file_id) WHERE length(content) // 3 > 200
      UNION ALL SELECT file_id, 0, 'full_file', 1, len(string_split(content, chr(10))), content FROM files WHERE length(content) // 3 <= 200)"""


@query(
    "c1_line_chunks",
    _LINE_CHUNKS
    + """ SELECT file_id, chunk_index, chunk_type, start_line, end_line,
      md5(array_to_string(list_slice(string_split(content, chr(10)), start_line, end_line), chr(10))) AS content_hash FROM ch""",
)
def c1(t):
    return C.line_chunks(t.files, max_tokens=200)


@query("c2_function_chunks")
def c2(t):
    return C.function_chunks(t.code_files, S.symbol_table(t.code_files), max_tokens=60)


@query("c3_smart_chunks")
def c3(t):
    return C.smart_chunks(t.code_files, S.symbol_table(t.code_files), max_tokens=200)


_KEPT = (
    r"regexp_matches(trim(line), '^(import |from |#include|#define|#pragma|typedef |struct |enum |const |static )') "
    r"OR (contains(line, '=') AND length(trim(line)) < 100 AND NOT starts_with(trim(line), '#') AND NOT starts_with(trim(line), '//'))"
)


@query(
    "c4_preamble",
    f"""WITH {_SPANS}, fs AS (SELECT file_id, min(start_line) AS first FROM symbols GROUP BY file_id),
    kept AS (SELECT cl.file_id, string_agg(line, chr(10) ORDER BY n) AS p FROM cl JOIN fs ON fs.file_id = cl.file_id AND n < first WHERE {_KEPT} GROUP BY cl.file_id)
    SELECT fs.file_id, coalesce(p, '') AS preamble FROM fs LEFT JOIN kept USING (file_id)""",
)
def c4(t):
    return C.preambles(t.code_files, S.symbol_table(t.code_files))


@query(
    "c5_split",
    f"WITH RECURSIVE {_spans_sql(600, 0)} SELECT file_id, CAST(part AS INT) AS part, CAST(s AS INT) AS start_line, CAST(e AS INT) AS end_line FROM r",
)
def c5(t):
    return C.split_without_overlap(t.files, max_tokens=200)


@query(
    "w12_chunk_overlap",
    _LINE_CHUNKS
    + """ SELECT file_id, chunk_index, start_line, CAST(greatest(coalesce(lag(end_line) OVER (PARTITION BY file_id ORDER BY chunk_index) - start_line + 1, 0), 0) AS INT) AS overlap FROM ch""",
)
def w12(t):
    return C.overlap_lines(C.line_chunks(t.files, max_tokens=200)).select("file_id", "chunk_index", "start_line", "overlap")


@query(
    "c15_directory_groups",
    """WITH RECURSIVE d AS (SELECT scan_id, string_split(file_path, '/')[1] AS dir, count(*) AS n FROM files GROUP BY ALL),
    o AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY dir) AS k FROM d),
    g AS (SELECT scan_id, k, 0 AS group_no, dir AS dirs, n AS files FROM o WHERE k = 1
      UNION ALL SELECT g.scan_id, o.k, CASE WHEN g.files + o.n > 7 THEN g.group_no + 1 ELSE g.group_no END,
        CASE WHEN g.files + o.n > 7 THEN o.dir ELSE concat(g.dirs, ',', o.dir) END, CASE WHEN g.files + o.n > 7 THEN o.n ELSE g.files + o.n END
      FROM g JOIN o ON o.scan_id = g.scan_id AND o.k = g.k + 1)
    SELECT scan_id, CAST(group_no AS INT) AS group_no, arg_max(dirs, k) AS dirs, max(files) AS files FROM g GROUP BY scan_id, group_no""",
)
def c15(t):
    return C.directory_groups(t.files, max_files=7).select("scan_id", "group_no", F.array_join("dirs", ",").alias("dirs"), "files")


@query(
    "c15_file_groups",
    "SELECT scan_id, file_id, file_path, CAST((row_number() OVER (PARTITION BY scan_id ORDER BY file_path, file_id) - 1) // 7 AS BIGINT) AS group_no FROM files",
)
def c15_files(t):
    return C.file_groups(t.files, max_files=7)


@query("c16_context_assembly")
def c16(t):
    """Sections per draft: enclosing chunk context, entry points of the file, imports, capped."""
    return A.draft_contexts(t.drafts, t.code_files, max_tokens=1000)
