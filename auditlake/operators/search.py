"""Searches over code lines: patterns, entry points, call graphs, application types."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditlake.functions.scalars import contains_any, lookup
from auditlake.operators.scale import first_n, joined_in_blocks
from auditlake.operators.symbols import NO_CALLEES, code_lines
from auditlake.session import cut

# Where input enters, with the kind and the risk.
ENTRY_PATTERNS = [
    (r"@app\.route|@router\.|def\s+\w+\(request", "HTTP endpoint", "high"),
    (r"@api_view|@action", "REST API endpoint", "high"),
    (r"socket\.accept|recv\(|recvfrom\(", "Network input", "high"),
    (r"int\s+main\s*\(|def\s+main\s*\(", "Main entry", "medium"),
    (r"argv|sys\.argv|argparse", "Command line args", "medium"),
    (r"open\s*\(|fopen\s*\(|ifstream", "File input", "medium"),
    (r"getenv|os\.environ", "Environment variable", "medium"),
]
# Words of which a line holds one wherever the pattern at the same place matches.
ENTRY_WORDS = [
    ["@app.route", "@router.", "(request"], ["@api_view", "@action"], ["socket.accept", "recv(", "recvfrom("],
    ["main"], ["argv", "argparse"], ["open", "ifstream"], ["getenv", "os.environ"],
]
ENTRY_CALLS = [
    (r"recv\s*\(", "Network input (recv)"),
    (r"recvfrom\s*\(", "Network input (recvfrom)"),
    (r"socket\s*\(", "Socket creation"),
    (r"accept\s*\(", "Socket accept"),
    (r"fopen\s*\(", "File open"),
    (r"open\s*\(", "File open"),
    (r"fread\s*\(", "File read"),
    (r"fgets\s*\(", "File/stdin read"),
    (r"int\s+main\s*\([^)]*argc", "CLI entry (main with args)"),
    (r"getopt\s*\(", "CLI option parsing"),
    (r"argv\[", "CLI argument access"),
    (r"getenv\s*\(", "Environment variable"),
    (r"@app\.route", "Flask HTTP endpoint"),
    (r"@router\.", "FastAPI endpoint"),
    (r"request\.", "HTTP request access"),
]

# Evidence of an application type, first type with evidence wins.
WEB_WORDS = ["flask", "django", "fastapi"]
NETWORK_WORDS = ["socket", "network", "server"]
CLI_WORDS = ["main.c", "main.cpp", "argparse", "cli", "argv", "getopt"]
LIBRARY_WORDS = ["lib/", "include/", "setup.py", "package.json", ".h"]
THREAT_MODELS = {
    "Web Application": "Remote attackers can send malicious input via HTTP requests. Input validation is critical.",
    "Network Service": "Remote attackers can send malicious data over the network. All network input is untrusted.",
    "CLI Tool": "User already has local access. Vulnerabilities mainly matter if processing untrusted files.",
    "Library": "Depends on how library is used. If exposed to untrusted input, vulnerabilities are exploitable.",
    "Standalone Application": "Check how the application receives input.",
    "Unknown": "Unknown threat model",
}


def entry_points(files: DataFrame) -> DataFrame:
    """Lines where input enters, one row per pattern that matches; the patterns are literals."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    contains_any(F.col("line"), words) & F.col("line").rlike(p),
                    F.struct(F.lit(kind).alias("type"), F.lit(risk).alias("risk")),
                )
                for (p, kind, risk), words in zip(ENTRY_PATTERNS, ENTRY_WORDS)
            ]
        )
    )
    return code_lines(files).select(
        "file_id", "line_number", F.trim("line").alias("name"), F.explode(hits).alias("h")
    ).select("file_id", "line_number", "name", "h.*")


def entry_functions(files: DataFrame) -> DataFrame:
    """Names of functions that entry lines define or call first."""
    name = lambda group: F.nullif(F.regexp_extract("name", r"def\s+(\w+)|(\w+)\s*\(", group), F.lit(""))
    return entry_points(files).select(F.coalesce(name(1), name(2)).alias("function")).where("function is not null").distinct()


def entry_calls(files: DataFrame, per_pattern: int = 5) -> DataFrame:
    """The first hits of every pattern of the second set; Spark cuts each group before the shuffle."""
    hits = F.array_compact(
        F.array(
            *[
                F.when(F.col("line").rlike(p), F.struct(F.lit(i).alias("pattern_no"), F.lit(d).alias("kind")))
                for i, (p, d) in enumerate(ENTRY_CALLS)
            ]
        )
    )
    found = code_lines(files).select("file_id", "line_number", F.explode(hits).alias("h")).select(
        "file_id", "line_number", "h.*"
    )
    return first_n(found, ["pattern_no"], [F.col("file_id"), F.col("line_number")], per_pattern).drop("rn")


def search_code(files: DataFrame, pattern: str, limit: int | None = 50) -> DataFrame:
    """Lines that match, in file and line order."""
    hits = code_lines(files).where(F.col("line").rlike(pattern)).select("file_id", "line_number", "line")
    return hits if limit is None else hits.orderBy("file_id", "line_number").limit(limit)


def references(files: DataFrame, symbol: str) -> DataFrame:
    return search_code(files, rf"\b{symbol}\b", None)


def definitions(symbols: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where each wanted name is defined: the symbol table first, else macro, class and struct lines."""
    table = symbols.select(
        "name", "file_id", F.col("start_line").alias("line_number"), F.lit(0).alias("tier")
    )
    others = [(r"^\s*class\s+(\w+)\s*[:\(]", 2), (r"#define\s+(\w+)\b", 4), (r"struct\s+(\w+)\s*\{", 5)]
    lines = code_lines(files)
    found = table
    for pattern, tier in others:
        found = found.unionByName(
            lines.select(F.regexp_extract("line", pattern, 1).alias("name"), "file_id", "line_number")
            .where("name <> ''")
            .withColumn("tier", F.lit(tier))
        )
    first = found.groupBy("name").agg(
        F.min(F.struct("tier", "file_id", "line_number")).alias("d")
    )
    return wanted.join(first, "name").select("name", "d.*")


def function_bodies(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Body text of every function, cut from the file's line array."""
    joined = symbols.select("file_id", "name", "start_line", "end_line").join(
        files.select("file_id", "content"), "file_id"
    )
    body = F.array_join(
        F.slice(F.split("content", "\n"), F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n"
    )
    return joined.select("file_id", "name", "start_line", body.alias("body"))


def call_graph(calls: DataFrame, callees: int | None = None) -> DataFrame:
    """Callers and callees (the first ``callees`` if given) of every function, one row an edge.

    Edges stay rows: a popular function has more callers than one array should hold.
    """
    known = calls.where(F.col("function").isNotNull() & ~F.col("callee").isin(NO_CALLEES))
    edges = known.select(F.col("function").alias("caller"), "callee").distinct()
    few = edges if callees is None else first_n(edges, ["caller"], [F.col("callee")], callees)
    down = few.select(F.col("caller").alias("function"), F.lit("calls").alias("direction"), F.col("callee").alias("other"))
    up = edges.select(F.col("callee").alias("function"), F.lit("called_by").alias("direction"), F.col("caller").alias("other"))
    return down.unionByName(up)


def callers(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Call sites of known functions with the symbol of the caller: every call beside every file that defines its name.

    These rows grow with the square of the files that share a name, so they are dealt to tasks by number.
    """
    target = symbols.select(F.col("name").alias("callee"), F.col("file_id").alias("target_file")).distinct()
    sites = calls.select("callee", "file_id", "function", "line_number")
    return joined_in_blocks(sites, target, "callee").select("callee", "target_file", "file_id", "function", "line_number")


def chains_to_entry(
    edges: DataFrame, entries: DataFrame, callers_per_node: int | None = None, chains: int | None = None
) -> DataFrame:
    """Shortest call chains from every function up to entry functions.

    Breadth first for all functions at once, until a level is empty: a level joins the frontier with
    the callers of each node (the first ``callers_per_node`` if given), keeps the first path per
    (function, node) and drops what was seen before. An entry ends its chain; ``chains`` bounds the
    chains of a function. Every level is checkpointed, so the plan stays one join deep.
    """
    calls = edges.select(F.col("callee").alias("node"), F.col("caller").alias("next")).distinct()
    if callers_per_node is not None:
        calls = first_n(calls, ["node"], [F.col("next")], callers_per_node).drop("rn")
    up = cut(calls)
    is_entry = entries.select(F.col("function").alias("node"), F.lit(True).alias("entry")).distinct()

    def flagged(df: DataFrame) -> DataFrame:
        return df.join(is_entry, "node", "left").withColumn("entry", F.coalesce("entry", F.lit(False)))

    names = edges.select(F.col("callee").alias("function")).union(edges.select("caller")).distinct()
    level = cut(flagged(names.select("function", F.col("function").alias("node"), F.array("function").alias("path"))))
    seen = level
    while not level.isEmpty():
        step = (
            level.where("not entry")
            .join(up, "node")
            .select("function", F.col("next").alias("node"), F.concat(F.array("next"), F.col("path")).alias("path"))
            .groupBy("function", "node")
            .agg(F.min("path").alias("path"))
        )
        level = cut(flagged(step.join(seen.select("function", "node"), ["function", "node"], "left_anti")))
        seen = seen.unionByName(level)
    reached = seen.where("entry").select("function", F.col("node").alias("entry"), "path", (F.size("path") - 1).alias("depth"))
    return reached if chains is None else first_n(reached, ["function"], [F.col("depth"), F.col("entry")], chains).drop("rn")


def application_types(files: DataFrame, imports: DataFrame) -> DataFrame:
    """Type and threat model per scan from words in paths, imports and main functions."""
    path, content = F.lower("file_path"), F.col("content")
    any_of = lambda c, words: F.bool_or(c.rlike("|".join(w.replace(".", r"\.") for w in words)))
    has_main = content.contains("int main(") | content.contains("def main(")
    with_args = content.contains("argc") | content.contains("argv")
    by_path = files.groupBy("scan_id").agg(
        any_of(path, WEB_WORDS).alias("web_path"),
        any_of(path, NETWORK_WORDS).alias("net_path"),
        any_of(path, CLI_WORDS).alias("cli"),
        any_of(path, LIBRARY_WORDS).alias("lib"),
        F.min_by(F.when(has_main, with_args), F.when(has_main, F.col("file_path"))).alias("main_args"),
    )
    module = F.lower("module")
    by_import = (
        imports.groupBy("scan_id")
        .agg(any_of(module, WEB_WORDS).alias("web_import"), any_of(module, NETWORK_WORDS).alias("net_import"))
    )
    yes = lambda *cs: F.coalesce(*[F.when(F.col(c), F.lit(True)) for c in cs], F.lit(False))
    kind = (
        F.when(yes("web_path", "web_import"), "Web Application")
        .when(yes("net_path", "net_import"), "Network Service")
        .when(yes("cli"), "CLI Tool")
        .when(yes("lib"), "Library")
        .when(F.col("main_args"), "CLI Tool")
        .when(~F.col("main_args"), "Standalone Application")
        .otherwise("Unknown")
    )
    return (
        by_path.join(by_import, "scan_id", "left")
        .select("scan_id", kind.alias("app_type"))
        .withColumn("threat_model", lookup(THREAT_MODELS, F.col("app_type")))
    )


def mentions(files: DataFrame, names: DataFrame, n: int | None = None) -> DataFrame:
    """Lines of other files that call each wanted name: all of them, or the first ``n``.

    Lines give up their words before the join, so names join words by equality; words that nobody
    wants leave first. With ``n``, a name keeps ``n`` lines of each of its first ``n + 1`` files:
    whichever file is the home, the first ``n`` other lines are among them, and a name called
    everywhere does not meet all its homes. Without, the rows grow with the square of the files that share
    a name, so they are dealt to tasks by number.
    """
    words = code_lines(files).where(F.col("line").contains("(")).select(
        "file_id", "line_number",
        F.explode(F.array_distinct(F.regexp_extract_all("line", F.lit(r"(\w+)\s*\("), F.lit(1)))).alias("name"),
    )
    homes = names.select("name", F.col("file_id").alias("home"))
    if n is None:
        homes = cut(homes)
    kept = words.join(homes.select("name").distinct(), "name", "left_semi")
    if n is None:
        return joined_in_blocks(kept, homes, "name").where("file_id <> home").select("name", "file_id", "line_number", "home")
    per_file = first_n(kept, ["name", "file_id"], [F.col("line_number")], n).drop("rn")
    by_file = Window.partitionBy("name").orderBy("file_id")
    kept = per_file.withColumn("_file_no", F.dense_rank().over(by_file)).where(F.col("_file_no") <= n + 1).drop("_file_no")
    hits = kept.join(homes, "name").where("file_id <> home")
    return first_n(hits, ["name", "home"], [F.col("file_id"), F.col("line_number")], n)


def variable_trace(files: DataFrame, targets: DataFrame) -> DataFrame:
    """Backward assignments (50 lines), nearest parameter (100 lines) and forward uses (50 lines).

    ``targets`` is (file_id, line_number, variable). They offer the buckets of 150 lines that their
    band touches, so lines meet targets by file and bucket.
    """
    lines = code_lines(files.select("file_id", "content")).withColumn("_bucket", F.expr("line_number div 150"))
    bands = targets.select(
        "file_id", F.col("line_number").alias("target"), "variable",
        F.explode(F.expr("sequence(greatest(line_number - 99, 0) div 150, (line_number + 50) div 150)")).alias("_bucket"),
    )
    near = bands.join(lines, ["file_id", "_bucket"]).where(
        F.col("line_number").between(F.col("target") - 99, F.col("target") + 50)
    ).drop("_bucket")
    assigned = F.expr(r"line rlike concat('\\b', variable, '\\s*:?=\\s*.+')")
    used = F.expr(r"line rlike concat('\\b', variable, '\\b')")
    param = F.expr(r"line rlike concat('(?:def|void|int|char)\\s+\\w+\\s*\\([^)]*\\b', variable, '\\b')")
    kind = (
        F.when((F.col("line_number") > F.col("target")) & used, "use")
        .when(F.col("line_number").between(F.col("target") - 48, F.col("target")) & assigned, "assignment")
    )
    flagged = near.withColumn("kind", kind).withColumn(
        "is_param", param & (F.col("line_number") <= F.col("target"))
    )
    plain = flagged.where("kind is not null").select("file_id", "target", "variable", "line_number", "kind")
    first = (
        flagged.where("is_param")
        .groupBy("file_id", "target", "variable")
        .agg(F.min("line_number").alias("line_number"))
        .withColumn("kind", F.lit("parameter"))
    )
    return plain.unionByName(first)
