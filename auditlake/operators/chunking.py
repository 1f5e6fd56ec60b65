"""Chunks of files as line spans. Greedy cuts are folds over one file's line lengths, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.operators.scale import exact_row_number

# Characters per token, separator of preamble and body, batch allowances.
CHARS_PER_TOKEN = 3
SEPARATOR = "\n\n// ... (other code) ...\n\n"
BATCH_RESERVE = 50
SPAN = "array<struct<start_line:int,end_line:int>>"

# What a preamble keeps.
PREAMBLE_STARTS = [
    "import ", "from ", "#include", "#define", "#pragma", "typedef ", "struct ", "enum ", "const ", "static ",
]


def tokens(chars: Column) -> Column:
    return F.floor(chars / CHARS_PER_TOKEN)


def greedy_spans(lines: Column, limit: Column | int, overlap: int) -> Column:
    """Spans of at most ``limit`` characters, each starting up to ``overlap`` lines back."""
    limit = F.lit(limit) if isinstance(limit, int) else limit
    lens = F.transform(lines, F.length)
    indexed = F.transform(lens, lambda n, i: F.struct(n.alias("n"), (i + 1).alias("i")))
    zero = F.struct(F.lit(1).alias("start"), F.lit(0).cast("bigint").alias("size"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        cut = (acc["size"] + x["n"] > limit) & (x["i"] > acc["start"])
        back = F.greatest(acc["start"], x["i"] - overlap)
        kept = F.aggregate(F.slice(lens, back, x["i"] - back), F.lit(0).cast("bigint"), lambda a, n: a + n)
        span = F.struct(acc["start"].alias("start_line"), (x["i"] - 1).alias("end_line"))
        return F.struct(
            F.when(cut, back).otherwise(acc["start"]).alias("start"),
            (F.when(cut, kept).otherwise(acc["size"]) + x["n"]).alias("size"),
            F.when(cut, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"),
        )

    last = lambda acc: F.concat(
        acc["out"], F.array(F.struct(acc["start"].alias("start_line"), F.size(lines).alias("end_line")))
    )
    return F.aggregate(indexed, zero, step, last)


def _text(lines: Column, first: Column, last: Column) -> Column:
    return F.array_join(F.slice(lines, first, last - first + 1), "\n")


def line_chunks(files: DataFrame, max_tokens: int, overlap: int = 10) -> DataFrame:
    """Small files whole, others as blocks with overlap; the hash is over the block's text."""
    lines = F.split("content", "\n")
    small = tokens(F.length("content")) <= max_tokens
    whole = F.array(F.struct(F.lit(1).alias("start_line"), F.size(lines).alias("end_line"))).cast(SPAN)
    spans = F.when(small, whole).otherwise(greedy_spans(lines, max_tokens * CHARS_PER_TOKEN, overlap))
    return files.select(
        "file_id", "content", small.alias("_small"), F.posexplode(spans).alias("chunk_index", "s")
    ).select(
        "file_id",
        "chunk_index",
        F.when(F.col("_small"), "full_file").otherwise("block").alias("chunk_type"),
        "s.start_line",
        "s.end_line",
        F.md5(_text(lines, F.col("s.start_line"), F.col("s.end_line"))).alias("content_hash"),
    )


def preamble_lines(lines: Column, first_function: Column) -> Column:
    """Imports, declarations and short assignments above the first function."""

    def keep(line: Column) -> Column:
        s = F.trim(line)
        declared = F.lit(False)
        for start in PREAMBLE_STARTS:
            declared = declared | s.startswith(start)
        assigned = s.contains("=") & (F.length(s) < 100) & ~s.startswith("#") & ~s.startswith("//")
        return declared | assigned

    return F.filter(F.slice(lines, 1, F.greatest(first_function - 1, F.lit(0))), keep)


def with_functions(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files with their ordered function spans and preamble; a file's functions are one small array."""
    spans = symbols.groupBy("file_id").agg(
        F.array_sort(F.collect_list(F.struct("start_line", "end_line", "name"))).alias("functions")
    )
    joined = files.select("file_id", "content").join(spans, "file_id", "left")
    lines = F.split("content", "\n")
    first = F.col("functions")[0]["start_line"]
    return joined.withColumn(
        "preamble", F.coalesce(F.array_join(preamble_lines(lines, first), "\n"), F.lit(""))
    )


def preambles(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return with_functions(files, symbols).where("functions is not null").select("file_id", "preamble")


def function_chunks(files: DataFrame, symbols: DataFrame, max_tokens: int) -> DataFrame:
    """One chunk per function, large ones in parts; files without functions fall back to lines."""
    staged = with_functions(files, symbols)
    lines = F.split("content", "\n")
    each = staged.where("functions is not null").select(
        "file_id", "content", "preamble", F.explode("functions").alias("f")
    )
    body = F.slice(lines, F.col("f.start_line"), F.col("f.end_line") - F.col("f.start_line") + 1)
    size = F.length("preamble") + len(SEPARATOR) + F.length(F.array_join(body, "\n"))
    fits = tokens(size) <= max_tokens
    room = F.lit(max_tokens * CHARS_PER_TOKEN) - F.length("preamble")
    parts = F.when(
        fits, F.array(F.struct(F.lit(1).alias("start_line"), F.size(body).alias("end_line"))).cast(SPAN)
    ).otherwise(greedy_spans(body, room, 0))
    split = each.select("file_id", "f", fits.alias("fits"), F.posexplode(parts).alias("part", "s")).select(
        "file_id",
        F.when(F.col("fits"), "function").otherwise("function_part").alias("chunk_type"),
        F.when(F.col("fits"), F.col("f.name"))
        .otherwise(F.concat(F.col("f.name"), F.lit("_part"), F.col("part")))
        .alias("symbol_name"),
        (F.col("f.start_line") + F.col("s.start_line") - 1).alias("start_line"),
        (F.col("f.start_line") + F.col("s.end_line") - 1).alias("end_line"),
    )
    rest = staged.where("functions is null").select("file_id", "content")
    plain = line_chunks(rest, max_tokens).select(
        "file_id", "chunk_type", F.lit(None).cast("string").alias("symbol_name"), "start_line", "end_line"
    )
    return split.unionByName(plain)


def smart_chunks(files: DataFrame, symbols: DataFrame, max_tokens: int) -> DataFrame:
    """Functions batched around the limit: up to half over it rather than cut one.

    Only functions over twice the hard limit are split, each part a span of its own.
    """
    hard = int(max_tokens * 1.5)
    staged = with_functions(files, symbols)
    lines = F.split("content", "\n")
    base = tokens(F.length("preamble"))
    item = "struct<kind:string,names:array<string>,start_line:int,end_line:int>"
    zero = F.struct(
        (base + BATCH_RESERVE).cast("bigint").alias("size"),
        F.lit(None).cast(item).alias("batch"),
        F.array().cast(f"array<{item}>").alias("out"),
    )

    def named(kind: str, names: Column, start: Column, end: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), names.alias("names"), start.cast("int").alias("start_line"), end.cast("int").alias("end_line")
        ).cast(item)

    def step(acc: Column, f: Column) -> Column:
        size = tokens(F.length(_text(lines, f["start_line"], f["end_line"]))).cast("bigint")
        huge = size + base > hard * 2
        full = (acc["size"] > max_tokens) & acc["batch"].isNotNull() & (acc["size"] + size > hard)
        fresh = huge | full
        flushed = F.when(
            fresh & acc["batch"].isNotNull(), F.concat(acc["out"], F.array(acc["batch"]))
        ).otherwise(acc["out"])
        alone = named("function_part", F.array(f["name"]), f["start_line"], f["end_line"])
        start_new = fresh | acc["batch"].isNull()
        batch = named(
            "function_batch",
            F.when(start_new, F.array(f["name"])).otherwise(F.concat(acc["batch"]["names"], F.array(f["name"]))),
            F.when(start_new, f["start_line"]).otherwise(acc["batch"]["start_line"]),
            f["end_line"],
        )
        reset = (base + BATCH_RESERVE).cast("bigint")
        return F.struct(
            F.when(huge, reset).otherwise(F.when(full, reset).otherwise(acc["size"]) + size).alias("size"),
            F.when(huge, F.lit(None).cast(item)).otherwise(batch).alias("batch"),
            F.when(huge, F.concat(flushed, F.array(alone))).otherwise(flushed).alias("out"),
        )

    done = lambda acc: F.when(
        acc["batch"].isNotNull(), F.concat(acc["out"], F.array(acc["batch"]))
    ).otherwise(acc["out"])
    batches = staged.where("functions is not null").select(
        "file_id", "content", "preamble", F.explode(F.aggregate("functions", zero, step, done)).alias("b")
    )
    room = F.lit(max_tokens * CHARS_PER_TOKEN) - F.length("preamble")
    body = F.slice(lines, F.col("b.start_line"), F.col("b.end_line") - F.col("b.start_line") + 1)
    parts = F.when(
        F.col("b.kind") == "function_part", greedy_spans(body, room, 0)
    ).otherwise(F.array(F.struct(F.lit(1).alias("start_line"), F.size(body).alias("end_line"))).cast(SPAN))
    split = batches.select("file_id", "b", F.posexplode(parts).alias("part", "s")).select(
        "file_id",
        F.col("b.kind").alias("chunk_type"),
        F.when(F.col("b.kind") == "function_part", F.concat(F.col("b.names")[0], F.lit("_part"), F.col("part")))
        .otherwise(F.array_join("b.names", ","))
        .alias("symbol_name"),
        (F.col("b.start_line") + F.col("s.start_line") - 1).alias("start_line"),
        (F.col("b.start_line") + F.col("s.end_line") - 1).alias("end_line"),
    )
    rest = staged.where("functions is null").select("file_id", "content")
    plain = line_chunks(rest, max_tokens).select(
        "file_id", "chunk_type", F.lit(None).cast("string").alias("symbol_name"), "start_line", "end_line"
    )
    return split.unionByName(plain)


def split_without_overlap(files: DataFrame, max_tokens: int) -> DataFrame:
    """Oversize texts in parts that share no line."""
    spans = greedy_spans(F.split("content", "\n"), max_tokens * CHARS_PER_TOKEN, 0)
    return files.select("file_id", F.posexplode(spans).alias("part", "s")).select("file_id", "part", "s.*")


def overlap_lines(chunks: DataFrame) -> DataFrame:
    """Lines each chunk shares with the one before it, by an equality join on the index."""
    before = chunks.select("file_id", (F.col("chunk_index") + 1).alias("chunk_index"), F.col("end_line").alias("_end"))
    return chunks.join(before, ["file_id", "chunk_index"], "left").withColumn(
        "overlap", F.greatest(F.coalesce(F.col("_end") - F.col("start_line") + 1, F.lit(0)), F.lit(0))
    ).drop("_end")


def directory_groups(files: DataFrame, max_files: int) -> DataFrame:
    """Top directories of a scan filled greedily, in name order, into groups of about ``max_files``.

    Files are counted per directory first; the fold sees one entry per directory.
    """
    top = F.when(F.col("file_path").contains("/"), F.split("file_path", "/")[0]).otherwise(F.lit("."))
    counts = files.groupBy("scan_id", top.alias("dir")).agg(F.count(F.lit(1)).alias("n"))
    item = "struct<dirs:array<string>,files:bigint>"
    zero = F.struct(
        F.array().cast("array<string>").alias("dirs"), F.lit(0).cast("bigint").alias("files"),
        F.array().cast(f"array<{item}>").alias("out"),
    )

    def step(acc: Column, d: Column) -> Column:
        full = (acc["files"] + d["n"] > max_files) & (F.size(acc["dirs"]) > 0)
        group = F.struct(acc["dirs"].alias("dirs"), acc["files"].alias("files"))
        return F.struct(
            F.when(full, F.array(d["dir"])).otherwise(F.concat(acc["dirs"], F.array(d["dir"]))).alias("dirs"),
            F.when(full, d["n"]).otherwise(acc["files"] + d["n"]).alias("files"),
            F.when(full, F.concat(acc["out"], F.array(group))).otherwise(acc["out"]).alias("out"),
        )

    done = lambda acc: F.concat(acc["out"], F.array(F.struct(acc["dirs"].alias("dirs"), acc["files"].alias("files"))))
    groups = counts.groupBy("scan_id").agg(
        F.aggregate(F.array_sort(F.collect_list(F.struct("dir", "n"))), zero, step, done).alias("groups")
    )
    return groups.select("scan_id", F.posexplode("groups").alias("group_no", "g")).select("scan_id", "group_no", "g.*")


def file_groups(files: DataFrame, max_files: int) -> DataFrame:
    """Files of a scan in path order, ``max_files`` to a group."""
    ranked = exact_row_number(files.select("scan_id", "file_id", "file_path"), ["scan_id"], ["file_path", "file_id"])
    return ranked.withColumn("group_no", F.expr(f"(rn - 1) div {max_files}")).drop("rn")
