"""Regex rules over whole texts: every non-overlapping match with its line and snippet."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scalars import computed, contains_any, let, totals_before
from auditlake.operators.context import line_slice, lines_of
from auditlake.operators.predicates import scan_language

C_LANGS = ("c", "cpp")
ALL_LANGS = ("c", "cpp", "py", "js", "java")


@dataclass(frozen=True)
class Rule:
    rule_id: int
    name: str
    pattern: str
    languages: tuple[str, ...]
    cwe_id: str
    vulnerability_type: str
    severity: str
    description: str
    enabled: bool = True


# The default rules.
DEFAULT_RULES = [
    Rule(1, "gets() Buffer Overflow", r"gets\s*\(", C_LANGS, "CWE-120", "Buffer Overflow", "Critical",
         "gets() has no bounds checking - always vulnerable"),
    Rule(2, "Direct argv to system()", r"system\s*\(\s*argv", C_LANGS, "CWE-78", "Command Injection", "Critical",
         "Command line argument passed directly to system()"),
    Rule(3, "strcpy from argv", r"strcpy\s*\([^,]+,\s*argv", C_LANGS, "CWE-120", "Buffer Overflow", "High",
         "Unbounded copy from command line argument"),
    Rule(4, "strcat from argv", r"strcat\s*\([^,]+,\s*argv", C_LANGS, "CWE-120", "Buffer Overflow", "High",
         "Unbounded concatenation from command line argument"),
    Rule(5, "scanf %s without width", r'scanf\s*\(\s*"%s"', C_LANGS, "CWE-120", "Buffer Overflow", "High",
         "scanf %s without width limit allows buffer overflow"),
    Rule(6, "sprintf building system command", r"sprintf\s*\([^;]+\);\s*\n?\s*system\s*\(", C_LANGS, "CWE-78",
         "Command Injection", "Critical", "sprintf builds string passed to system() - command injection"),
    Rule(7, "snprintf building system command", r"snprintf\s*\([^;]+\);\s*\n?\s*system\s*\(", C_LANGS, "CWE-78",
         "Command Injection", "Critical", "snprintf builds string passed to system() - command injection"),
    Rule(8, "printf with variable format", r"printf\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)", C_LANGS, "CWE-134",
         "Format String", "High", "printf with variable as format string"),
    Rule(9, "fprintf with variable format", r"fprintf\s*\([^,]+,\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)", C_LANGS, "CWE-134",
         "Format String", "High", "fprintf with variable as format string"),
    Rule(10, "free then use pattern", r"free\s*\(\s*(\w+)\s*\)[^}]*\1\s*->", C_LANGS, "CWE-416", "Use-After-Free",
         "Critical", "Pointer used after being freed"),
    Rule(11, "Double free pattern", r"free\s*\(\s*(\w+)\s*\)[^}]*free\s*\(\s*\1\s*\)", C_LANGS, "CWE-415",
         "Double-Free", "Critical", "Same pointer freed twice"),
    Rule(12, "access then fopen TOCTOU", r"access\s*\([^)]+\)[^;]*;[^}]*fopen\s*\(", C_LANGS, "CWE-367",
         "TOCTOU Race Condition", "Medium", "Time-of-check to time-of-use race condition"),
    Rule(13, "eval on request data", r"eval\s*\(\s*request\.", ("py",), "CWE-94", "Code Injection", "Critical",
         "eval() called on user request data"),
    Rule(14, "exec on request data", r"exec\s*\(\s*request\.", ("py",), "CWE-94", "Code Injection", "Critical",
         "exec() called on user request data"),
    Rule(15, "pickle on request data", r"pickle\.loads?\s*\(\s*request\.", ("py",), "CWE-502",
         "Insecure Deserialization", "Critical", "Pickle deserialization of untrusted data"),
    Rule(16, "os.system with request", r"os\.system\s*\(\s*request\.", ("py",), "CWE-78", "Command Injection",
         "Critical", "os.system() with user request data"),
    Rule(17, "subprocess shell=True with user input",
         r"subprocess\.(run|call|Popen)\s*\([^)]*shell\s*=\s*True[^)]*request\.", ("py",), "CWE-78",
         "Command Injection", "Critical", "subprocess with shell=True and user input"),
    Rule(18, "yaml.load unsafe", r"yaml\.load\s*\([^)]*\)", ("py",), "CWE-502", "Insecure Deserialization", "High",
         "yaml.load without SafeLoader allows code execution"),
    Rule(19, "__import__ with user input", r"__import__\s*\(\s*request\.", ("py",), "CWE-94", "Code Injection",
         "Critical", "Dynamic import with user-controlled module name"),
    Rule(20, "Hardcoded password", r"(password|passwd|pwd)\s*=\s*[\"'][^\"']{4,}[\"']", ALL_LANGS, "CWE-798",
         "Hardcoded Credentials", "High", "Hardcoded password in source code"),
    Rule(21, "Hardcoded API key", r"(api_key|apikey|api_secret)\s*=\s*[\"'][^\"']{8,}[\"']", ALL_LANGS, "CWE-798",
         "Hardcoded Credentials", "High", "Hardcoded API key in source code"),
    Rule(22, "Hardcoded secret/token", r"(secret|token|auth_token)\s*=\s*[\"'][^\"']{8,}[\"']", ALL_LANGS, "CWE-798",
         "Hardcoded Credentials", "High", "Hardcoded secret or token in source code"),
    Rule(23, "SQL string concatenation", r"(SELECT|INSERT|UPDATE|DELETE)[^\"']*\+\s*\w+", ("py", "js", "java"),
         "CWE-89", "SQL Injection", "High", "SQL query built with string concatenation"),
    Rule(24, "SQL f-string interpolation", r"f[\"'].*?(SELECT|INSERT|UPDATE|DELETE).*?\{", ("py",), "CWE-89",
         "SQL Injection", "High", "SQL query built with f-string interpolation"),
]
BACKREFERENCE_RULES = (10, 11)

# Calls that count as sinks, by query set; a name is a regex over the whole call name.
SINK_SETS = {
    "default": [
        ("CWE-120", "strcpy|strcat|sprintf|gets|vsprintf"),
        ("CWE-78", "system|popen|execl|execle|execlp|execv|execve|execvp"),
        ("CWE-134", "printf|syslog|vsprintf|vprintf"),
        ("CWE-416", "free"),
    ],
    "memory": [
        ("CWE-120", "strcpy|strcat|sprintf|gets|vsprintf|memcpy|memmove"),
        ("CWE-416", "free"),
        ("CWE-415", "free"),
    ],
    "injection": [
        ("CWE-78", "system|popen|execl|execle|execlp|execv|execve|execvp"),
        ("CWE-134", "printf|fprintf|sprintf|snprintf|syslog|vsprintf|vprintf|vfprintf"),
        ("CWE-22", "fopen|open|freopen|creat"),
    ],
    "all": [
        ("CWE-120", "strcpy|strcat|sprintf|gets|vsprintf|memcpy|memmove|strncpy|strncat"),
        ("CWE-416", "free"),
        ("CWE-78", "system|popen|execl|execle|execlp|execv|execve|execvp"),
        ("CWE-134", "printf|fprintf|sprintf|syslog|vsprintf|vprintf"),
        ("CWE-22", "fopen|open|freopen|creat"),
        ("CWE-327", ".*MD5.*|.*SHA1.*|.*DES.*|.*RC4.*"),
    ],
    "uefi": [
        ("CWE-120", "CopyMem|SetMem|ZeroMem"),
        ("CWE-416", "FreePool|SafeFreePool"),
        ("CWE-120", "StrCpy|StrnCpy|StrCat|StrnCat|AsciiStrCpy|AsciiStrnCpy|AsciiStrCat"),
        ("CWE-789", "AllocatePool|AllocateZeroPool|AllocatePages|ReallocatePool"),
        ("CWE-749", ".*SmmHandler.*|.*SmiHandler.*"),
        ("CWE-269", "GetVariable|SetVariable|QueryVariableInfo"),
    ],
}


def _flags(pattern: str) -> str:
    return f"(?im){pattern}"


def required_words(pattern: str) -> list[str]:
    """Words one of which every match must hold, read off the start of the pattern; empty if unsure."""
    depth, escaped = 0, False
    for c in pattern:
        if not escaped and c == "|" and depth == 0:
            return []
        depth += 0 if escaped else (c == "(") - (c == ")")
        escaped = c == "\\" and not escaped
    group = re.match(r"\(((?:\w{3,}\|)*\w{3,})\)(?![?*{])", pattern)
    if group:
        return group.group(1).lower().split("|")
    word = re.match(r"[A-Za-z_]{3,}(?![?*{\w])", pattern)
    return [word.group(0).lower()] if word else []


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def match_lines(content: Column, pattern: Column) -> Column:
    """Array of (match, line): line breaks add up over the gaps and matches before each match."""

    def numbered(hits: Column, breaks: Column) -> Column:
        before = totals_before(F.transform(breaks, lambda b: b["gap"] + b["hit"]))
        lines = F.zip_with(before, breaks, lambda at, b: (at + b["gap"] + 1).cast("int"))
        return F.zip_with(hits, lines, lambda m, n: F.struct(m.alias("match"), n.alias("line")))

    def placed(hits: Column) -> Column:
        gaps = F.slice(F.split(content, pattern, -1), F.lit(1), F.size(hits))
        breaks = F.zip_with(hits, gaps, lambda m, g: F.struct(newlines(g).alias("gap"), newlines(m).alias("hit")))
        return F.when(F.size(hits) > 0, let(breaks, lambda b: numbered(hits, b)))

    return let(F.regexp_extract_all(content, pattern, F.lit(0)), placed)


def _gated(rules: list[Rule]) -> list[tuple[Rule, Column]]:
    """Enabled rules with what a file must meet before their pattern is worth matching.

    Language, then a plain word search, then the regex: most texts stop at the first two. Expects
    the columns ``_lang``, ``_low`` and ``content``.
    """
    out = []
    for rule in rules:
        if rule.enabled:
            gate = F.col("_lang").isin(list(rule.languages))
            words = required_words(rule.pattern)
            if words:
                gate = gate & contains_any(F.col("_low"), words)
            out.append((rule, gate))
    return out


def _staged(files: DataFrame) -> DataFrame:
    return files.withColumn("_lang", scan_language("file_path")).withColumn("_low", F.lower("content"))


def scan_rules(files: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """All matches of the enabled rules of each file's language, in one pass without a join.

    The rule list is configuration on the driver: it becomes literal patterns, compiled once, and
    each text is read where it lies. Matches of a text are found once, snippets come from one split
    of a text that has matches; hit rows carry no text. Nothing is shuffled.
    """
    content = F.col("content")
    hits = []
    for rule, gate in _gated(rules):
        pattern, number = F.lit(_flags(rule.pattern)), F.lit(rule.rule_id)
        found = F.transform(
            match_lines(content, pattern),
            lambda h: F.struct(
                number.alias("rule_id"), h["line"].alias("line_number"), h["match"].alias("match_text")  # noqa: B023
            ),
        )
        hits.append(F.when(gate & content.rlike(_flags(rule.pattern)), found))
    keep = ["file_id", "scan_id", "file_path", F.col("_lang").alias("language")]
    found = computed(
        _staged(files).select(*keep, "content", "_lang", "_low"), F.flatten(F.array_compact(F.array(*hits))).alias("_hits")
    )
    lined = computed(found.where(F.size("_hits") > 0).drop("_lang", "_low"), lines_of("content").alias("_lines"))
    with_snippets = F.transform(
        "_hits",
        lambda h: F.struct(
            h["rule_id"].alias("rule_id"), h["line_number"].alias("line_number"), h["match_text"].alias("match_text"),
            F.array_join(line_slice(F.col("_lines"), h["line_number"] - 1, h["line_number"] + 1), "\n").alias("snippet"),
        ),
    )
    keep[3] = "language"
    return lined.select(*keep, with_snippets.alias("_h")).select(*keep, F.inline("_h"))


def count_rules(files: DataFrame, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    """rule_id, hits and files of the rules that match anywhere; matches are counted and not kept."""
    content = F.col("content")
    counts = [
        F.when(gate, F.struct(F.lit(rule.rule_id).alias("rule_id"), F.regexp_count(content, F.lit(_flags(rule.pattern))).alias("n")))
        for rule, gate in _gated(rules)
    ]
    each = _staged(files).select("file_id", F.inline(F.array_compact(F.array(*counts)))).where("n > 0")
    return each.groupBy("rule_id").agg(F.sum("n").alias("hits"), F.count_distinct("file_id").alias("files"))


def rule_table(spark: SparkSession, rules: list[Rule] = DEFAULT_RULES) -> DataFrame:
    rows = [
        (r.rule_id, r.name, r.pattern, list(r.languages), r.cwe_id, r.vulnerability_type, r.severity, r.description)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id int, name string, pattern string, languages array<string>, cwe_id string, "
        "vulnerability_type string, severity string, description string",
    )


def rule_candidates(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(file, rule) pairs with a match, for rules that come as a table.

    Equal languages join first, the regex is a residual filter. Spark broadcasts the rules when
    they are small and shuffles by language with skew splitting when they are not.
    """
    indexed = rules.select("rule_id", "pattern", F.explode("languages").alias("language"))
    texts = files.select("file_id", "content", scan_language("file_path").alias("language"))
    hit = F.expr("content rlike concat('(?im)', pattern)")
    return texts.join(indexed, "language").where(hit).select("file_id", "language", "rule_id")


def to_drafts(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Matches as draft findings of the static scanner."""
    meta = rules.select("rule_id", "name", "cwe_id", "severity", "description")
    return hits.join(meta, "rule_id").select(
        "scan_id", "file_id", "file_path", F.col("name").alias("title"), F.col("cwe_id").alias("vulnerability_type"),
        "severity", "line_number", "snippet", F.col("description").alias("reason"), F.lit(True).alias("auto_detected"),
        F.lit(1).alias("initial_votes"), F.lit("static").alias("model"),
    )


def rule_hits(counts: DataFrame, rules: DataFrame) -> DataFrame:
    """``count_rules`` with the rules' names, also for rules without a match, most hits first."""
    return (
        rules.select("rule_id", "name", "severity")
        .join(counts, "rule_id", "left")
        .na.fill(0, ["hits", "files"])
        .orderBy(F.desc("hits"), "rule_id")
    )


def test_rules(samples: DataFrame, rules: list[Rule]) -> tuple[DataFrame, list[tuple[int, str]]]:
    """Matches of each valid rule with line, start and end, and the rejected rules with their error.

    A rule is tried on an empty text first; patterns that match the empty text are refused, since
    gaps and matches would not line up.
    """
    spark = samples.sparkSession
    good, rejected = [], []
    for rule in rules:
        try:
            probe = spark.range(1).select(F.lit("").rlike(_flags(rule.pattern)).alias("empty")).first()
            if probe["empty"]:
                rejected.append((rule.rule_id, "pattern matches the empty text"))
            else:
                good.append(rule)
        except PySparkException as error:
            rejected.append((rule.rule_id, str(error).splitlines()[0][:200]))
        except Exception as error:  # the JVM's own regex error
            rejected.append((rule.rule_id, str(error).splitlines()[0][:200]))
    hits = None
    for rule in good:
        pattern = F.lit(_flags(rule.pattern))
        pairs = F.arrays_zip(
            F.regexp_extract_all("text", pattern, F.lit(0)).alias("m"),
            F.slice(F.split("text", pattern, -1), 1, F.size(F.regexp_extract_all("text", pattern, F.lit(0)))).alias("g"),
        )
        zero = F.struct(F.lit(0).alias("p"), F.array().cast("array<struct<match:string,start:int,end:int>>").alias("o"))

        def step(acc: Column, x: Column) -> Column:
            begin = (acc["p"] + F.length(x["g"])).cast("int")
            stop = (begin + F.length(x["m"])).cast("int")
            one = F.struct(x["m"].alias("match"), begin.alias("start"), stop.alias("end"))
            return F.struct(stop.alias("p"), F.concat(acc["o"], F.array(one)).alias("o"))

        part = samples.select(
            "sample_id", "text", F.lit(rule.rule_id).alias("rule_id"), F.explode(F.aggregate(pairs, zero, step)["o"]).alias("h")
        ).select(
            "sample_id", "rule_id", "h.*",
            (newlines(F.substr("text", F.lit(1), F.col("h.start"))) + 1).cast("int").alias("line"),
        )
        hits = part if hits is None else hits.unionByName(part)
    return hits, rejected


def sink_calls(calls: DataFrame, query_set: str = "default") -> DataFrame:
    """Calls (file_id, function, line_number, callee) that are sinks of the query set.

    The double-free query takes functions with more than one call of free.
    """
    sets = SINK_SETS[query_set]
    cwes = F.array_compact(
        F.array(*[F.when(F.col("callee").rlike(f"^(?:{names})$"), F.lit(cwe)) for cwe, names in sets])
    )
    found = calls.select("*", F.explode(F.array_distinct(cwes)).alias("cwe"))
    if not any(cwe == "CWE-415" for cwe, _ in sets):
        return found
    repeated = (
        calls.where("callee = 'free' and function is not null")
        .groupBy("file_id", "function")
        .count()
        .where("count > 1")
        .select("file_id", "function")
    )
    double = found.where("cwe = 'CWE-415'").join(repeated, ["file_id", "function"], "left_semi")
    return found.where("cwe <> 'CWE-415'").unionByName(double)
