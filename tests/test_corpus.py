"""Rules, chunks and spans against plain restatements."""

from __future__ import annotations

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from auditlake.operators import chunking as C, joins as J, rules as R, scale, search as Q, symbols as S
from auditlake.functions.scalars import totals_before
from auditlake.operators import extraction as E


def files_frame(spark, texts):
    return spark.createDataFrame(
        [(i, 1, p, t) for i, (p, t) in enumerate(texts)], "file_id bigint, scan_id bigint, file_path string, content string"
    )


CODE = """#include "x.h"
int limit = 3;
int run(char *a) {
  strcpy(buf,
         argv[1]);
  free(p); p->next = 0;
  free(q);
  free(q);
}
def other(x):
  system(cmd)
"""


def test_rule_scan_matches_finditer(spark):
    text = CODE + 'token = "abcdefghijkl" password = \'hunter22\'\ngets(\n a)\n'
    got = sorted((r.rule_id, r.line_number, r.match_text) for r in R.scan_rules(files_frame(spark, [("a/x.h", text)])).collect())
    want = []
    for rule in R.DEFAULT_RULES:
        if "c" in rule.languages:
            for m in re.finditer(rule.pattern, text, re.IGNORECASE | re.MULTILINE):
                want.append((rule.rule_id, text[: m.start()].count("\n") + 1, m.group(0)))
    assert got == sorted(want)
    assert {10, 11} <= {g[0] for g in got}


def test_required_words_are_required():
    assert R.required_words(r"colou?r") == [] and R.required_words(r"foo|bar") == []
    assert R.required_words(r"(secret|token)\s*=") == ["secret", "token"]


def test_bad_rules_are_rejected(spark):
    samples = spark.createDataFrame([(1, "ab\nab")], "sample_id bigint, text string")
    base = R.DEFAULT_RULES[0]
    rules = [R.Rule(i, "r", p, base.languages, "", "", "", "") for i, p in enumerate(["b", "(", "x*"])]
    hits, rejected = R.test_rules(samples, rules)
    assert [i for i, _ in rejected] == [1, 2]
    assert [(r.line, r.start, r.end) for r in hits.orderBy("start").collect()] == [(1, 1, 2), (2, 4, 5)]


def simple_chunks(text, limit, overlap):
    lines, out, cur, size, start = text.split("\n"), [], [], 0, 1
    for i, line in enumerate(lines, 1):
        if size + len(line) > limit and cur:
            out.append((start, i - 1))
            cur = cur[max(0, len(cur) - overlap):] if overlap else []
            size, start = sum(map(len, cur)), i - len(cur)
        cur.append(line)
        size += len(line)
    out.append((start, len(lines)))
    return out


def test_line_chunks_match_restatement(spark):
    rng = random.Random(5)
    texts = [("a.c", "\n".join("x" * rng.randint(0, 90) for _ in range(rng.randint(1, 80)))) for _ in range(40)]
    for overlap in (0, 3, 10):
        got = {}
        spans = C.greedy_spans(F.split("content", "\n"), 150, overlap)
        for r in files_frame(spark, texts).select("file_id", spans.alias("s")).collect():
            got[r.file_id] = [(s.start_line, s.end_line) for s in r.s]
        assert got == {i: simple_chunks(t, 150, overlap) for i, (_, t) in enumerate(texts)}


def smart_batches(functions, preamble, max_tokens):
    hard, base, out, batch, size = int(max_tokens * 1.5), preamble // 3, [], None, preamble // 3 + 50
    for name, chars in functions:
        n = chars // 3
        if n + base > hard * 2:
            if batch:
                out.append(batch)
            batch, size = None, base + 50
            out.append([name])
            continue
        if size > max_tokens and batch and size + n > hard:
            out.append(batch)
            batch, size = None, base + 50
        batch = (batch or []) + [name]
        size += n
    return out + ([batch] if batch else [])


def test_smart_chunks_match_restatement(spark):
    rng = random.Random(9)
    functions, lines = [], []
    for i in range(30):
        body = "y" * rng.choice([30, 100, 200, 1500])
        functions.append((f"f{i}", len(f"def f{i}(a):") + 1 + len(body)))
        lines += [f"def f{i}(a):", body]
    files = files_frame(spark, [("a.py", "\n".join(lines))])
    chunks = C.smart_chunks(files, S.symbol_table(files), 100).collect()
    got = []
    for r in sorted(chunks, key=lambda r: r.start_line):
        names = [re.sub(r"_part\d+$", "", n) for n in r.symbol_name.split(",")]
        if r.chunk_type == "function_batch" or r.symbol_name.endswith("_part0"):
            got.append(names)
    assert got == smart_batches(functions, 0, 100)


def test_function_chunks_cover_every_function(spark):
    files = files_frame(spark, [("a.c", CODE), ("b.md", "no code")])
    chunks = C.function_chunks(files, S.symbol_table(files), 1000)
    got = {(r.chunk_type, r.symbol_name, r.start_line, r.end_line) for r in chunks.collect()}
    assert got == {("function", "run", 3, 9), ("function", "other", 10, 12), ("full_file", None, 1, 1)}
    assert C.preambles(files, S.symbol_table(files)).first().preamble == '#include "x.h"\nint limit = 3;'


def test_double_free_needs_two_calls(spark):
    files = files_frame(spark, [("a.c", CODE)])
    found = R.sink_calls(S.call_table(files), "memory").where("cwe = 'CWE-415'")
    assert found.count() == 3


def test_chains_stop_at_entries(spark):
    edges = spark.createDataFrame([("main", "a"), ("a", "b"), ("b", "a"), ("c", "b")], "caller string, callee string")
    entries = spark.createDataFrame([("main",)], "function string")
    got = {r.function: r.path for r in Q.chains_to_entry(edges, entries).collect()}
    assert got == {"main": ["main"], "a": ["main", "a"], "b": ["main", "a", "b"]}


def test_draft_extraction_cases(spark):
    texts = {
        1: "*DRAFT: Overflow in x\n*TYPE: CWE-120\n*SEVERITY: High\n*LINE: 6\n*END_DRAFT\n*DRAFT: Second one\n*LINE: 9",
        2: "<think>DRAFT: no</think>DRAFT:NONE",
        3: '[{"title": "A", "line": 4,},]',
        4: "I saw a Buffer Overflow near line 42",
        5: "nothing here",
        6: "",
    }
    df = spark.createDataFrame(list(texts.items()), "response_id bigint, text string")
    rows = E.extract_drafts(df).orderBy("response_id", "draft_no").collect()
    got = [(r.response_id, r.parse_status, r.title, r.type, r.line) for r in rows]
    assert got == [
        (1, "parsed", "Overflow in x", "CWE-120", 6),
        (1, "parsed", "Second one", None, 9),
        (2, "none", None, None, None),
        (3, "parsed", "A", "Unknown", 4),
        (4, "parsed", "I saw a Buffer Overflow", "Unknown", 42),
        (5, "failed", None, None, None),
        (6, "none", None, None, None),
    ]


def test_mentions_match_brute_force(spark):
    rng = random.Random(2)
    texts = [
        ("a.c", "\n".join(rng.choice(["hot(x)", "rare(y)", "none"]) if rng.random() < 0.9 else "odd()" for _ in range(12)))
        for _ in range(9)
    ]
    homes = [(h, name) for h in range(9) for name in ("hot", "rare", "odd")]
    names = spark.createDataFrame(homes, "file_id bigint, name string")
    got = {}
    for r in Q.mentions(files_frame(spark, texts), names, n=3).collect():
        got.setdefault((r.home, r.name), set()).add((r.file_id, r.line_number))
    want = {}
    for home, name in homes:
        hits = [
            (i, k) for i, (_, t) in enumerate(texts) if i != home
            for k, line in enumerate(t.split("\n"), 1) if f"{name}(" in line
        ]
        if hits:
            want[(home, name)] = set(hits[:3])
    assert got == want


def test_all_mentions_of_a_hot_name_are_made_by_many_tasks(spark, monkeypatch):
    """A name stands in each file and has each as a home; a home named twice counts twice; lines without a parenthesis call nothing."""
    monkeypatch.setattr(scale, "BLOCK", 16, raising=False)
    texts = [("a.c", "hot (x); hot(y)\nhot\nhot\n(z)\nrare(hot(1))" if i % 2 else "hot(x)\n\nodd()") for i in range(120)]
    homes = [(h, "hot") for h in range(120)] + [(3, "rare"), (3, "rare"), (5, "nowhere"), (6, None)]
    names = spark.createDataFrame(homes, "file_id bigint, name string")
    rows = Q.mentions(files_frame(spark, texts), names)
    want = Counter()
    for home, name in homes:
        for i, (_, text) in enumerate(texts):
            for k, line in enumerate(text.split("\n"), 1):
                want[name, i, k, home] += i != home and name is not None and re.search(rf"\b{name}\s*\(", line) is not None
    assert rows.columns == ["name", "file_id", "line_number", "home"]
    assert Counter(map(tuple, rows.collect())) == +want and sum(want.values()) > 20_000
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) < sum(want.values()) / 8


def test_enclosing_chunk_matches_brute_force(spark):
    rng = random.Random(4)
    chunks = [(f, f * 100 + i, i, s, s + rng.randint(0, 300)) for f in range(3) for i, s in enumerate(range(1, 500, 37))]
    found = [(i, rng.randrange(3), rng.randint(1, 700)) for i in range(200)]
    frame = J.enclosing_chunk(
        spark.createDataFrame(found, "finding_id bigint, file_id bigint, line_number int"),
        spark.createDataFrame(chunks, "file_id bigint, chunk_id bigint, chunk_index int, start_line int, end_line int"),
    )
    want = {}
    for i, f, line in found:
        inside = [c for c in chunks if c[0] == f and c[3] <= line <= c[4]]
        if inside:
            want[i] = min(inside, key=lambda c: c[2])[1]
    assert {r.finding_id: r.chunk_id for r in frame.collect()} == want


def test_spans_need_no_shuffle_and_no_stack(spark):
    long_line = "word " * 20_000
    text = f"{long_line}\nint f(int a)\n{{\n printf(s); fprintf(o, s); f(a); g();\n}}\nsystem(cmd);\n{long_line}(x) y\ndef h(x):\n return k(x)\n"
    files = files_frame(spark, [("a.c", text), ("b.c", ""), ("c.c", None)])
    symbols, calls = S.symbol_table(files), S.call_table(files)
    assert {(r.name, r.start_line, r.end_line) for r in symbols.collect()} == {("f", 2, 5), ("h", 8, 10)}
    assert {(r.function, r.line_number, r.callee) for r in calls.where("line_number < 7").collect()} == {
        ("f", 4, "printf"), ("f", 4, "fprintf"), ("f", 4, "g"), (None, 6, "system")
    }
    for df in (symbols, calls, S.enclosing_functions(files)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    found = {(r.callee, r.cwe) for r in R.sink_calls(calls, "injection").collect()}
    assert found == {("printf", "CWE-134"), ("fprintf", "CWE-134"), ("system", "CWE-78")}
    assert {r.other for r in Q.call_graph(calls).where("direction = 'calls'").collect()} == {"g", "k"}


def test_call_chains_have_no_depth_limit(spark):
    edges = [(f"f{i}", f"f{i + 1}") for i in range(8)] + [("f3", "f1"), ("x", "y"), ("y", "x")]
    frame = spark.createDataFrame(edges, "caller string, callee string")
    entries = spark.createDataFrame([("f0",)], "function string")
    got = {(r.function, r.entry, r.depth) for r in Q.chains_to_entry(frame, entries).select("function", "entry", "depth").collect()}
    assert got == {(f"f{i}", "f0", i) for i in range(9)}


def test_source_chains_reach_their_root_and_circles_are_told(spark):
    rows = [(i, i - 1 if i else None) for i in range(41)] + [(100, 102), (101, 100), (102, 101), (103, 102), (200, 999)]
    got = {r.scan_id: (r.root_scan_id, r.hops, r.circular) for r in J.resolve_sources(spark.createDataFrame(rows, "scan_id bigint, source_scan_id bigint")).collect()}
    assert all(got[i] == (0, i, False) for i in range(41))
    assert all(got[i] == (None, None, True) for i in (100, 101, 102, 103)) and got[200] == (200, 0, False)


def test_votes_with_keys_in_any_case(spark):
    answers = [('{"Vote": "REAL", "CONFIDENCE": 90, "Reasoning": "' + "r" * 3000 + '"}',), ('{"vote": "FALSE_POSITIVE", "Vote": "REAL"}',)]
    got = E.extract_votes(spark.createDataFrame(answers, "text string")).collect()
    assert (got[0].decision, got[0].confidence, got[0].format_detected, len(got[0].reasoning)) == ("REAL", 90, "json", 3000)
    assert got[1].decision == "FALSE_POSITIVE"


def test_name_suffixes_take_the_next_free_number(spark):
    from auditlake.operators.sampling import unique_names

    new = [(i, n) for i, n in enumerate(["a", "a", "b", "a", "c", "c_1", "c", "d"])]
    stored = ["a", "a", "a_1", "a_3", "d_1"]
    got = {r.draft_id: r.unique_name for r in unique_names(
        spark.createDataFrame(new, "draft_id bigint, name string"), spark.createDataFrame([(s,) for s in stored], "name string")
    ).collect()}
    assert [got[i] for i in range(8)] == ["a_2", "a_4", "b", "a_5", "c", "c_1", "c_2", "d"]


def test_spans_of_a_file_are_computed_once(spark):
    functions = [f"int f{i}(int a)\n{{\n  g(a);\n  h(a);\n}}" for i in range(2000)]
    files = spark.createDataFrame([(1, 1, "a.c", "\n".join(functions))], "file_id long, scan_id long, file_path string, content string")
    calls = S.call_table(files)
    plan = calls._jdf.queryExecution().optimizedPlan().toString()
    assert all(plan.count(p) <= 2 for p in S.DEFINITIONS) and plan.count("split(content") <= 2
    assert [(r.function, r.line_number) for r in calls.where("callee = 'h'").orderBy("line_number").collect()] == [
        (f"f{i}", 5 * i + 4) for i in range(2000)
    ]


def test_hits_of_a_file_are_computed_once(spark):
    text = "\n".join("gets(x);\nfoo" for _ in range(8000))
    files = spark.createDataFrame([(1, 1, "a.c", text)], "file_id long, scan_id long, file_path string, content string")
    hits = R.scan_rules(files)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= len(R.DEFAULT_RULES) and plan.count("split(content, \n") <= 2
    got = hits.orderBy("line_number").collect()
    assert [r.line_number for r in got] == list(range(1, 16000, 2)) and got[1].snippet == "foo\ngets(x);\nfoo"


def test_totals_before(spark):
    row = spark.range(1).select(
        totals_before(F.sequence(F.lit(1), F.lit(1000))).alias("long"), totals_before(F.array().cast("array<int>")).alias("none")
    ).first()
    assert row.long == [i * (i + 1) // 2 for i in range(1000)] and row.none == []
