"""Joins of findings with chunks, files, categories, subscriptions and each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from auditlake.functions import scalars as S
from auditlake.functions import text as X
from auditlake.operators import predicates as P
from auditlake.operators.scale import paired_with_each
from auditlake.operators.symbols import module_name

# Words that say nothing about a category.
GENERIC_WORDS = ["cwe", "buffer", "code", "copy", "size", "check", "related", "also"]
EXTENSION_TRIES = [".h", ".hpp", ".c", ".cpp"]


def enclosing_chunk(findings: DataFrame, chunks: DataFrame, bucket: int = 64) -> DataFrame:
    """The first chunk of the finding's file whose lines hold the finding.

    Chunks offer the line buckets they cover, findings the bucket they lie in: both meet by file
    and bucket, so a file with very many findings neither pairs them with all of its chunks nor
    ends up in one task. The first chunk is an aggregate with map-side combine.
    """
    spans = chunks.select(
        "file_id", "chunk_id", "chunk_index", "start_line", "end_line",
        F.explode(F.expr(f"sequence(start_line div {bucket}, end_line div {bucket})")).alias("_bucket"),
    )
    placed = findings.select("finding_id", "file_id", "line_number", F.expr(f"line_number div {bucket}").alias("_bucket"))
    inside = F.col("line_number").between(F.col("start_line"), F.col("end_line"))
    best = F.min_by("chunk_id", F.struct("chunk_index", "chunk_id")).alias("chunk_id")
    return (
        placed.join(spans, ["file_id", "_bucket"])
        .where(inside)
        .groupBy("finding_id", "file_id", "line_number")
        .agg(best)
    )


def draft_chain(drafts: DataFrame, chunks: DataFrame, files: DataFrame, scans: DataFrame) -> DataFrame:
    """Drafts with chunk and file where there are any, and always their scan.

    Chunks meet their files first: drafts without a chunk have no file to look up, and as one null key
    they would all meet in one task.
    """
    placed = chunks.select("chunk_id", "start_line", "end_line", F.col("file_id").alias("chunk_file")).join(
        files.select(F.col("file_id").alias("chunk_file"), F.col("file_path").alias("full_path")), "chunk_file", "left"
    )
    return (
        drafts.join(placed, "chunk_id", "left")
        .join(scans.select("scan_id", "target"), "scan_id")
        .withColumn("path", F.coalesce("draft_path", "full_path", F.lit("unknown")))
    )


def new_cases(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Candidates whose key is not there yet, one per key."""
    return candidates.join(existing.select(key).distinct(), key, "left_anti").dropDuplicates([key])


def draft_verdict(drafts: DataFrame, verified: DataFrame) -> DataFrame:
    """REAL when a verified row exists, else the verdict of the status."""
    flag = verified.select("draft_id").distinct().withColumn("_real", F.lit(True))
    by_status = S.lookup(S.STATUS_VERDICT, F.col("status"), "UNKNOWN")
    return (
        drafts.join(flag, "draft_id", "left")
        .withColumn("verdict", F.when(F.col("_real"), "REAL").otherwise(by_status))
        .drop("_real")
    )


def verified_drafts(drafts: DataFrame, verified: DataFrame) -> DataFrame:
    return drafts.join(verified.select("draft_id"), "draft_id", "left_semi")


def applicable_analyzers(files: DataFrame, analyzers: DataFrame) -> DataFrame:
    """Analyzers (globs as ``glob_regexes``, ``languages``) that apply to each file; null means all.

    Files offer their language and a wildcard, analyzers the languages they take: the pair meets by
    equality and the globs are a residual filter on the file name.
    """
    takes = analyzers.withColumn(
        "language",
        F.explode(F.when(F.size("languages") > 0, F.transform("languages", F.lower)).otherwise(F.array(F.lit("*")))),
    )
    offers = files.select("file_id", "file_path", P.file_name("file_path").alias("name")).withColumn(
        "language", F.explode(F.array(F.lit("*"), F.lower(P.language("file_path", "lower"))))
    )
    globbed = F.expr("glob_regexes is null or exists(glob_regexes, g -> name rlike g)")
    return offers.join(takes, "language").where(globbed).select("file_id", "analyzer").distinct()


def match_categories(findings: DataFrame, categories: DataFrame, limit: int = 4096) -> DataFrame:
    """Category by exact CWE, else by at least two telling keywords, else a new one.

    Exact matches take an equality join. The distinct texts that are left keep the keywords they
    hold (a keyword may be part of a word), and those meet their categories by equality, so no
    text meets every category.
    """
    findings = findings.withColumn("raw_category", F.coalesce("raw_category", F.lit("")))
    cwe = S.cwe_id("raw_category")
    exact = categories.where("cwe_id is not null").groupBy("cwe_id").agg(F.min_by("name", "category_id").alias("exact"))
    texts = findings.select("raw_category").distinct().withColumn("cwe_id", cwe)
    first = texts.join(exact, "cwe_id", "left")
    open_texts = first.where("exact is null").select("raw_category", F.lower("raw_category").alias("low"))
    words = categories.select("category_id", F.col("name").alias("category"), F.explode(F.array_distinct("keywords")).alias("word")).where(
        ~F.col("word").isin(GENERIC_WORDS)
    )
    vocabulary = words.select("word").distinct()
    hit = lambda v: F.col("low").contains(v["word"])
    seen = paired_with_each(open_texts, vocabulary, "v", limit, hit).select("raw_category", "v.word")
    scored = (
        seen.join(words, "word")
        .groupBy("raw_category", "category_id", "category")
        .agg(F.count(F.lit(1)).alias("score"))
        .where("score >= 2")
        .groupBy("raw_category")
        .agg(F.min_by("category", F.struct(-F.col("score"), F.col("category_id"))).alias("fuzzy"))
    )
    matched = first.join(scored, "raw_category", "left").select(
        "raw_category",
        F.when(F.col("raw_category") == "", F.lit("Unknown"))
        .otherwise(F.coalesce("exact", "fuzzy", F.trim("raw_category")))
        .alias("category"),
        (F.coalesce("exact", "fuzzy").isNull() & (F.col("raw_category") != "")).alias("is_new"),
    )
    return findings.join(matched, "raw_category")


def new_categories(matched: DataFrame) -> DataFrame:
    """Rows for the categories that matching had to create."""
    return (
        matched.where("is_new")
        .groupBy("category")
        .agg(F.count(F.lit(1)).alias("usage_count"))
        .select(
            "category", S.cwe_id("category").alias("cwe_id"), X.short_name("category").alias("short_name"),
            X.keywords("category").alias("keywords"), "usage_count",
        )
    )


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Import to file: exact module, longest parent, then a header or source name.

    Each import offers its candidate keys with a rank; keys join by equality.
    """
    full = files.select(module_name("file_path").alias("key"), "file_path")
    short = files.where(P.extension("file_path") == "py").select(
        F.regexp_replace(P.file_name("file_path"), r"\.py$", "").alias("key"), "file_path"
    )
    targets = full.unionByName(short).groupBy("key").agg(F.min("file_path").alias("resolved_file"))
    parts = F.split("module", r"\.")
    parents = F.transform(
        F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), ".")
    )
    named = F.array(*[F.concat(F.col("module"), F.lit(e)) for e in EXTENSION_TRIES])
    keys = imports.select("module").distinct().select(
        "module", F.posexplode(F.concat(F.array("module"), parents, named)).alias("rank", "key")
    )
    best = keys.join(targets, "key").groupBy("module").agg(F.min_by("resolved_file", "rank").alias("resolved_file"))
    return imports.join(best, "module", "left")


def case_matches(cases: DataFrame, findings: DataFrame) -> DataFrame:
    """Verdict per labelled case from the first finding of its file."""
    first = findings.groupBy("case_id").agg(
        F.min_by(F.struct("title", "description", "line_number"), "finding_id").alias("f")
    )
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    kind = F.lower("expected_type")
    hit = low(F.col("f.title")).contains(kind) | low(F.col("f.description")).contains(kind)
    near = F.coalesce(
        (F.col("expected_line") == 0)
        | (F.col("f.line_number") == 0)
        | (F.abs(F.col("expected_line") - F.col("f.line_number")) <= 5),
        F.lit(True),
    )
    verdict = (
        F.when(F.col("f").isNull(), F.when(F.col("is_vulnerable"), "FN").otherwise("TN"))
        .when(~F.col("is_vulnerable"), "FP")
        .when(hit & near, "TP")
        .when(hit, "TP (Line Miss)")
        .otherwise("TP (Type Miss)")
    )
    return cases.join(first, "case_id", "left").withColumn("verdict", verdict).drop("f")


def resolve_sources(scans: DataFrame) -> DataFrame:
    """Root of every source chain, the hops to it, and ``circular``: the chain runs into a circle.

    Pointer doubling: a round doubles the distance covered, so one round for every doubling of the
    number of scans reaches every root; what has none by then is on a circle or leads to one. Rounds
    end as soon as all scans are at a root.
    """
    from auditlake.session import cut

    known = scans.select(F.col("scan_id").alias("k"))
    jump = (
        scans.select("scan_id", "source_scan_id")
        .join(known, F.col("source_scan_id") == F.col("k"), "left")
        .select(
            "scan_id",
            F.coalesce("k", "scan_id").alias("at"),
            F.when(F.col("k").isNotNull(), 1).otherwise(0).cast("bigint").alias("hops"),
        )
    )
    jump = cut(jump)
    roots = jump.where("hops = 0").select(F.col("scan_id").alias("root_scan_id"))
    on_root = F.col("at") == F.col("root_scan_id")
    for _ in range(max(1, jump.count()).bit_length()):
        if jump.join(roots, on_root, "left_anti").isEmpty():
            break
        after = jump.select(F.col("scan_id").alias("at"), F.col("at").alias("to"), F.col("hops").alias("more"))
        jump = cut(jump.join(after, "at").select("scan_id", F.col("to").alias("at"), (F.col("hops") + F.col("more")).alias("hops")))
    return jump.join(roots, on_root, "left").select(
        "scan_id", "root_scan_id", F.when(F.col("root_scan_id").isNotNull(), F.col("hops")).alias("hops"),
        F.col("root_scan_id").isNull().alias("circular"),
    )


def matching_subscriptions(alerts: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Enabled subscriptions to each alert's event; findings must reach the minimum severity.

    A subscription to findings is unfolded to the ranks that it takes, so alerts meet subscriptions by
    event and rank, and no pair is made that is not returned. There are few such keys: alerts carry a salt, and each
    subscription goes to every salt (its rows are those of the table times at most five ranks and the
    salts). Null or unknown events match nothing; repeated alerts and subscriptions are kept.
    """
    salts = int(alerts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    top = max(S.SEVERITY_RANK.values())
    finding = F.col("event") == "finding"
    ranks = F.when(finding, F.sequence(S.severity_rank("min_severity"), F.lit(top))).otherwise(F.array(F.lit(-1)))
    wants = (
        subscriptions.where("enabled")
        .select("webhook_id", "min_severity", F.explode(F.array_distinct("events")).alias("event"))
        .withColumn("_rank", F.explode(ranks))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    )
    plain = [f.name for f in alerts.schema.fields if not isinstance(f.dataType, MapType)]
    keyed = alerts.withColumn("_rank", F.when(finding, S.severity_rank("severity")).otherwise(-1)).withColumn(
        "_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int")
    )
    return keyed.join(wants, ["event", "_rank", "_salt"]).drop("_rank", "_salt")


def _trigrams(text: Column) -> Column:
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3)))
    )


def fuzzy_paths(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """Best file per wanted name: same name, same name in any case, then name contained.

    All three are equality joins. A contained name is looked up by its rarest three letters, which
    every file name that holds it must have; the containment itself is a residual filter. Names of
    one or two letters are compared with the distinct file names.
    """
    names = files.groupBy(P.file_name("file_path").alias("name")).agg(F.min("file_path").alias("file_path"))
    base = wanted.select("query", P.file_name("query").alias("base")).distinct()
    exact = base.join(names.withColumnRenamed("name", "base"), "base").select("query", F.lit(0).alias("tier"), "file_path")
    lower = names.groupBy(F.lower("name").alias("file_low")).agg(F.min("file_path").alias("file_path"))
    any_case = base.withColumn("file_low", F.lower("base")).join(lower, "file_low").select(
        "query", F.lit(1).alias("tier"), "file_path"
    )
    found = exact.unionByName(any_case)
    rest = base.join(found.select("query"), "query", "left_anti").select("query", F.lower("base").alias("low"))
    grams = lower.where(F.length("file_low") > 2).select("file_low", "file_path", F.explode(_trigrams(F.col("file_low"))).alias("gram"))
    rarity = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    rarest = (
        rest.where(F.length("low") > 2)
        .select("query", "low", F.explode(_trigrams(F.col("low"))).alias("gram"))
        .join(rarity, "gram", "left")
        .groupBy("query", "low")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram"))["gram"].alias("gram"))
    )
    partial = rarest.join(grams, "gram").where(F.col("file_low").contains(F.col("low"))).select(
        "query", F.lit(2).alias("tier"), "file_path"
    )
    short = paired_with_each(
        lower, rest.where(F.length("low") <= 2), "w", where=lambda w: F.col("file_low").contains(w["low"])
    ).select(F.col("w.query").alias("query"), F.lit(2).alias("tier"), "file_path")
    every = found.unionByName(partial).unionByName(short)
    return every.groupBy("query").agg(F.min(F.struct("tier", "file_path")).alias("m")).select(
        "query", "m.tier", "m.file_path"
    )


def cached_results(requests: DataFrame, compute) -> DataFrame:
    """Compute once per distinct (content hash, analyzer) and join the result back to every request.

    A content may be copied any number of times: the distinct step combines copies before the
    shuffle, and the join back splits hot hashes through adaptive skew handling.
    """
    keyed = requests.withColumn("content_hash", F.md5("content"))
    once = keyed.groupBy("content_hash", "analyzer").agg(F.first("content").alias("content"))
    done = compute(once).drop("content").withColumnsRenamed({"content_hash": "_hash", "analyzer": "_analyzer"})
    same = F.col("content_hash").eqNullSafe(F.col("_hash")) & F.col("analyzer").eqNullSafe(F.col("_analyzer"))
    return keyed.drop("content").join(done, same).drop("_hash", "_analyzer")


def result_details(results: DataFrame, prompts: DataFrame, cases: DataFrame, drafts: DataFrame) -> DataFrame:
    """Result rows with prompt, case and draft; draft fields win where the case is linked to one."""
    linked = drafts.select(F.col("draft_id").alias("linked_draft"), F.col("title").alias("draft_title"), F.col("severity").alias("draft_severity"))
    return (
        results.join(prompts, "prompt_id", "left")
        .join(cases, "case_id", "left")
        .join(linked, "linked_draft", "left")
        .withColumn("title", F.coalesce("draft_title", "case_title"))
        .withColumn("severity", F.coalesce("draft_severity", "case_severity"))
        .drop("draft_title", "draft_severity", "case_title", "case_severity")
    )


def missing_grid(profiles: DataFrame, verifiers: DataFrame, existing: DataFrame) -> DataFrame:
    """All (profile, verifier) pairs that are not stored yet, with the profile's enricher filled in."""
    grid = paired_with_each(profiles, verifiers, "v").select(*profiles.columns, "v.*")
    return grid.join(existing.select("profile_id", "model_name"), ["profile_id", "model_name"], "left_anti")


def newest_suffix_match(cases: DataFrame, files: DataFrame) -> DataFrame:
    """``path`` or ``path:line`` of a case to the newest scan's file that ends with it.

    File names join by equality, the suffix is a residual filter.
    """
    split = cases.select(
        "case_id",
        F.regexp_replace("raw_path", r":\d+$", "").alias("tail"),
        F.coalesce(F.regexp_extract("raw_path", r":(\d+)$", 1).try_cast("int"), F.col("line_number")).alias("line_number"),
    ).withColumn("name", P.file_name("tail"))
    named = files.select("file_id", "scan_id", "file_path", P.file_name("file_path").alias("name"))
    return (
        split.where("line_number is not null")
        .join(named, "name")
        .where(F.col("file_path").endswith(F.col("tail")))
        .groupBy("case_id", "line_number")
        .agg(F.max_by(F.struct("scan_id", "file_id", "file_path"), F.struct(F.col("scan_id"), -F.col("file_id"))).alias("f"))
        .select("case_id", "line_number", "f.*")
    )


def recent_deliveries(deliveries: DataFrame, subscriptions: DataFrame, n: int, webhook_id=None, scan_id=None) -> DataFrame:
    """Newest deliveries with the subscription's name."""
    if webhook_id is not None:
        deliveries = deliveries.where(F.col("webhook_id") == webhook_id)
    if scan_id is not None:
        deliveries = deliveries.where(F.col("scan_id") == scan_id)
    newest = deliveries.orderBy(F.desc("created_at"), F.desc("delivery_id")).limit(n)
    return newest.join(subscriptions.select("webhook_id", "webhook_name"), "webhook_id", "left")
