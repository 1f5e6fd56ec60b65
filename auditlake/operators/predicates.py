"""Filters and gates over files, findings, changes and logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.functions import scalars as S
from auditlake.functions import text as X

# Language names by extension, one map per naming style.
LANGUAGES = {
    "display": {
        "py": "Python", "c": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "h": "C/C++ Header",
        "hpp": "C++ Header", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "go": "Go",
        "rs": "Rust", "rb": "Ruby", "php": "PHP",
    },
    "lower": {
        "c": "c", "h": "c", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "py": "python",
        "js": "javascript", "ts": "typescript", "java": "java", "go": "go", "rs": "rust",
    },
    "fix": {
        "py": "Python", "c": "C", "cpp": "C++", "cc": "C++", "h": "C/C++ Header",
        "hpp": "C++ Header", "js": "JavaScript", "ts": "TypeScript", "java": "Java", "go": "Go",
        "rs": "Rust", "rb": "Ruby", "php": "PHP",
    },
}
LANGUAGE_DEFAULT = {"display": "Unknown", "lower": "c", "fix": "Unknown"}
SCANNABLE = list(LANGUAGES["display"])

# Path parts of low and of high risk; low wins.
LOW_RISK = ["test", "spec", "mock", "doc", "example", "sample", "vendor", "third_party", "external"]
HIGH_RISK = [
    "auth", "login", "password", "crypt", "token", "session", "admin", "root", "sudo", "exec",
    "eval", "system", "sql", "query", "database", "upload", "parse",
]

# Words that make a chunk worth a model call, by language.
DANGEROUS_WORDS = {
    "c": [
        "system", "exec", "popen", "strcpy", "strcat", "sprintf", "scanf", "gets", "malloc", "free",
        "memcpy", "recv", "send", "fopen", "fread", "fwrite", "access", "strlen", "password",
        "secret", "token", "credential", "auth",
    ],
    "cpp": [
        "system", "exec", "popen", "strcpy", "strcat", "sprintf", "scanf", "gets", "new", "delete",
        "memcpy", "recv", "send", "access", "strlen", "password", "secret", "token", "credential",
        "auth", "nullptr", "NULL",
    ],
    "py": [
        "eval", "exec", "system", "popen", "subprocess", "pickle", "marshal", "yaml.load", "execute",
        "shell", "open", "input", "os.", "importlib", "__import__", "compile", "globals", "locals",
        "setattr", "getattr", "password", "secret", "token", "credential", "auth",
    ],
}
SCAN_LANGUAGE = {"h": "c", "hpp": "cpp"}
CONTROL_WORDS = r"\b(if|for|while|def|class|function|return|switch|case)\b"
LONG_STRING = r"[\"'][^\"']{20,}[\"']"

# Directories that hold no code of the project.
SKIPPED_DIRS = r"(^|/)(\.[^/]*|node_modules|__pycache__|venv|build|dist)/"

# Fields an enriched record must have.
REQUIRED_FIELDS = [
    "finding", "category", "severity", "vulnerability_details", "proof_of_concept", "remediation_steps",
]

# Placeholders a template must hold, each in one of its spellings.
TEMPLATE_CHECKS = [
    ("{file_path}", ["{file_path}", "{file}"]),
    ("{language}", ["{language}"]),
    ("{code_snippet}", ["{code_snippet}", "{snippet}", "{code}"]),
    ("{code_context}", ["{code_context}", "{context}"]),
    ("{finding_title}", ["{finding_title}", "{title}", "{issue}"]),
    ("{finding_type}", ["{finding_type}", "{vuln_type}", "{vulnerability_type}"]),
    ("{finding_severity}", ["{finding_severity}", "{severity}"]),
    ("{finding_line}", ["{finding_line}", "{line}", "{line_number}"]),
    ("{finding_reason}", ["{finding_reason}", "{reason}", "{details}", "{claim}"]),
    ("{output_format}", ["{output_format}"]),
]

GRADE_ORDER = ["A", "B", "C", "D", "F"]


def extension(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(S.col(path), r"\.([^./]+)$", 1))


def file_name(path: Column | str) -> Column:
    return F.regexp_extract(S.col(path), r"([^/]*)$", 1)


def language(path: Column | str, style: str = "display") -> Column:
    return S.lookup(LANGUAGES[style], extension(path), LANGUAGE_DEFAULT[style])


def scan_language(path: Column | str) -> Column:
    """Extension as the rule index names it: headers count as their language."""
    ext = extension(path)
    return F.coalesce(S.lookup(SCAN_LANGUAGE, ext), ext)


def is_scannable(path: Column | str) -> Column:
    return extension(path).isin(SCANNABLE)


def filter_paths(files: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    if include:
        files = files.where(F.col("file_path").rlike(include))
    if exclude:
        files = files.where(~F.col("file_path").rlike(exclude))
    return files


def glob_regex(pattern: str) -> str:
    """A shell glob as an anchored regex both engines read; ``*`` also crosses directories."""
    out = []
    i = 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
            while pattern[i + 1 : i + 2] == "*":
                i += 1
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i + 1 :]:
            end = pattern.index("]", i + 1)
            body = pattern[i + 1 : end]
            out.append("[" + ("^" + body[1:] if body.startswith("!") else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def path_tail_regex(pattern: str) -> str:
    """The recursive path match: parts compare from the right and ``*`` stays inside one part."""
    parts = [glob_regex(p)[1:-1].replace(".*", "[^/]*") for p in pattern.split("/")]
    return "(^|/)" + "/".join(parts) + "$"


def glob_filter(files: DataFrame, file_filter: str | None) -> DataFrame:
    """Keep files whose name or path matches a comma list of globs, ignoring case."""
    patterns = [p.strip() for p in (file_filter or "").split(",") if p.strip()]
    if not patterns:
        return files
    name, path = F.lower(file_name("file_path")), F.lower("file_path")
    hit = F.lit(False)
    for p in patterns:
        regex = glob_regex(p.lower())
        hit = hit | name.rlike(regex) | path.rlike(regex) | F.col("file_path").rlike(path_tail_regex(p))
    return files.where(hit)


def branch_matches(branch: Column | str, pattern: str | None) -> Column:
    """Regex anchored at the start; a pattern that is no regex counts as a glob."""
    if not pattern:
        return F.lit(True)
    try:
        re.compile(pattern)
        return S.col(branch).rlike(f"^(?:{pattern})")
    except re.error:
        return S.col(branch).rlike("^" + pattern.replace("*", ".*").replace("?", ".") + "$")


def has_label(labels: Column | str, required: str | None) -> Column:
    if not required:
        return F.lit(True)
    wanted = [x.strip().lower() for x in required.split(",")]
    return F.arrays_overlap(F.transform(S.col(labels), F.lower), F.array(*[F.lit(w) for w in wanted]))


def created_within(created: Column | str, as_of: Column, days: int | None) -> Column:
    """Created in the last ``days`` days; none or zero days count as seven."""
    return S.col(created) >= as_of - F.make_dt_interval(F.lit(days or 7))


def risk_class(path: Column | str) -> Column:
    low = F.lower(S.col(path))
    return (
        F.when(low.rlike("|".join(LOW_RISK)), "low").when(low.rlike("|".join(HIGH_RISK)), "high").otherwise("normal")
    )


def valid_findings(findings: DataFrame, chunks: DataFrame, margin: int = 5) -> DataFrame:
    """Findings with a title and a line inside their chunk, give or take ``margin`` lines."""
    line = F.col("line").try_cast("int")
    bounds = chunks.select("chunk_id", "start_line", "end_line")
    return findings.join(bounds, "chunk_id").where(
        (F.coalesce("title", F.lit("")) != "")
        & (line > 0)
        & line.between(F.col("start_line") - margin, F.col("end_line") + margin)
    )


def meets_threshold(severity: Column | str, minimum: Column | str) -> Column:
    return S.severity_rank(severity) >= S.severity_rank(minimum)


def min_vote_gate(drafts: DataFrame, minimum: int) -> DataFrame:
    few = (F.col("status") == "pending") & (F.coalesce("initial_votes", F.lit(1)) < minimum)
    return drafts.withColumn("status", F.when(few, "skipped").otherwise(F.col("status")))


def mostly_data(content: Column | str) -> Column:
    """Many long strings and hardly any control words."""
    return (F.regexp_count(S.col(content), F.lit(LONG_STRING)) > 5) & (
        F.regexp_count(S.col(content), F.lit(CONTROL_WORDS)) < 2
    )


def needs_model(path: Column | str, content: Column | str) -> Column:
    """A dangerous word of the language in a text that is not mostly data; high risk always."""
    low = F.lower(S.col(content))
    lang = scan_language(path)
    hit = F.when(F.lit(False), F.lit(False))
    for name, words in DANGEROUS_WORDS.items():
        hit = hit.when(lang == name, low.rlike("|".join(re.escape(w) for w in words)))
    wanted = hit.otherwise(F.lit(False)) & ~mostly_data(content)
    return (risk_class(path) == "high") | wanted


def retry_ready(chunks: DataFrame, as_of: Column, max_retries: int = 3) -> DataFrame:
    due = F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= as_of)
    return chunks.where(due & (F.col("retry_count") <= max_retries))


def search_logs(log: DataFrame, **wanted: object) -> DataFrame:
    """Equality filters on the columns that are given a value."""
    for column, value in wanted.items():
        if value is not None:
            log = log.where(F.col(column) == value)
    return log


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def list_reports(reports: DataFrame, min_grade: str | None = None, n: int = 50) -> DataFrame:
    """Newest reports, of a minimum grade when one is given."""
    if min_grade:
        allowed = GRADE_ORDER[: GRADE_ORDER.index(min_grade) + 1]
        reports = reports.where(F.col("grade").isin(allowed))
    return reports.orderBy(F.desc("generated_at"), "scan_id").limit(n)


def recent(df: DataFrame, as_of: Column, minutes: int = 5) -> DataFrame:
    done = F.col("status").isin("completed", "failed")
    return df.where(done & (F.col("created_at") >= as_of - F.expr(f"interval {minutes} minutes")))


def missing_fields(fields: list[str] = REQUIRED_FIELDS) -> Column:
    """Names of the fields that are null or blank."""
    return F.array_compact(
        F.array(*[F.when(F.coalesce(X.strip_spaces(F.col(f)), F.lit("")) == "", F.lit(f)) for f in fields])
    )


def outside_skipped_dirs(path: Column | str) -> Column:
    return ~S.col(path).rlike(SKIPPED_DIRS)


def missing_placeholders(template: Column | str) -> Column:
    t = S.col(template)
    return F.array_compact(
        F.array(*[F.when(~S.contains_any(t, names), F.lit(primary)) for primary, names in TEMPLATE_CHECKS])
    )


def oversize_gate(changes: DataFrame, change_files: DataFrame, maximum: int = 100) -> DataFrame:
    """Mark a change as skipped when it touches more scannable files than ``maximum``.

    Deleted files count here; only the review itself leaves them out.
    """
    counts = change_files.groupBy("change_id").agg(
        F.count_if(is_scannable("file_path")).alias("scannable"),
        F.count_if(is_scannable("file_path") & ~F.col("deleted")).alias("reviewed"),
    )
    return (
        changes.join(counts, "change_id", "left")
        .na.fill(0, ["scannable", "reviewed"])
        .withColumn("status", F.when(F.col("scannable") > maximum, "skipped").otherwise(F.col("status")))
    )
