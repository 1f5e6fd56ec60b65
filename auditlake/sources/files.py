"""Files as rows: source trees, archives, result files, markdown sections."""

from __future__ import annotations

import io
import re
import tarfile
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditlake.functions.scalars import col

FIX_NAME = r"([^/]+)\.fix\.(\d+)\.(.*)\.diff$"


def parse_fix_name(path: Column | str) -> Column:
    """Struct (fixed_file, finding_id, model) of a ``{file}.fix.{id}.{model}.diff`` path."""
    part = lambda g: F.regexp_extract(col(path), FIX_NAME, g)
    return F.struct(
        part(1).alias("fixed_file"), part(2).try_cast("bigint").alias("finding_id"), part(3).alias("model")
    )


# Extensions a source tree is scanned for.
SOURCE_EXTENSIONS = ("py", "c", "cpp", "h", "hpp")
ARCHIVE_SCHEMA = "path string, member string, content string"


def read_source_tree(
    spark: SparkSession, root: str, extensions: tuple[str, ...] = SOURCE_EXTENSIONS
) -> DataFrame:
    """Files below ``root`` with a known extension, one row each, as UTF-8 text without bad bytes.

    The extension filter is a glob of the file listing, so other files are never opened.
    """
    glob = "*.{" + ",".join("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions) + "}"
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(root)
    )
    return raw.select("path", F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("content"))


def _members(path: str, data: bytes):
    """Yield (name, text) of the regular files in a .zip, .tar.gz or .tgz."""
    if path.lower().endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            for info in archive.infolist():
                if not info.is_dir():
                    yield info.filename, archive.read(info).decode("utf-8", "ignore")
    else:
        with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as archive:
            for info in archive:
                if info.isfile():
                    yield info.name, archive.extractfile(info).read().decode("utf-8", "ignore")


def extract_archives(archives: DataFrame) -> DataFrame:
    """Archives (path, content) to one row per member. Archive formats have no JVM reader in Spark."""

    def rows(batches):
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"]):
                # One frame per archive: a batch never holds more than one unpacked archive.
                found = [(path, name, text) for name, text in _members(path, bytes(data))]
                yield pd.DataFrame(found, columns=["path", "member", "content"])

    return archives.select("path", "content").mapInPandas(rows, ARCHIVE_SCHEMA)


def read_archives(spark: SparkSession, root: str) -> DataFrame:
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return extract_archives(raw.where(F.lower("path").rlike(r"\.(zip|tar\.gz|tgz)$")))


def _array_files(lines: DataFrame) -> list[str]:
    """Paths of the files whose first mark is a bracket; the driver lists the files of a folder anyway."""
    placed = lines.withColumn("no", F.monotonically_increasing_id()).where("line <> ''")  # lines of a block are read in order
    first = placed.groupBy("path").agg(F.min_by(F.col("line").startswith("["), F.struct("start", "no")).alias("array"))
    return [r.path for r in first.where("array").select("path").collect()]


def read_results(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Result files, a JSON array (on any number of lines) or JSON lines per model.

    The model is the folder or file name. Elements that are no valid objects have null fields and
    are left out; a folder that is missing or empty gives no rows. Files of JSON lines are read by
    blocks, a line a row; a file that is an array is one row while it is parsed.
    """
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    row = f"struct<{','.join(part.strip().replace(' ', ':', 1) for part in schema.split(','))}>"
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], f"{schema}, model_name string")
    ending = F.substring_index("path", "/", -2)  # all that the pattern can match
    name = F.regexp_extract(ending, r"(?:model_name=([^/]+)/[^/]*|([^/]+?)(?:_results)?\.json)$", 0)
    model = F.regexp_replace(F.regexp_replace(name, r"^model_name=([^/]+)/.*$", "$1"), r"(_results)?\.json$", "")
    blank = F.lit(" \t\r\n")
    reader = lambda kind: spark.read.format(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json")
    path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))  # as a file listing has it
    lines = reader("text").option("lineSep", "\n").load(root).select(
        path.alias("path"), F.trim("value", blank).alias("line"), F.col("_metadata.file_block_start").alias("start")
    )
    arrays = _array_files(lines)
    if arrays:
        lines = lines.where(~F.col("path").isin(arrays))
    # A generator, so that a line is parsed once and not for every field that is read.
    found = lines.where("line <> ''").select(model.alias("model_name"), F.explode(F.array(F.from_json("line", row))).alias("r"))
    if arrays:
        text = F.trim(F.col("content").cast("string"), blank)
        files = reader("binaryFile").load([re.sub(r"([\\{}\[\]*?])", r"\\\1", p) for p in arrays])
        found = found.unionByName(files.select(model.alias("model_name"), F.explode(F.from_json(text, f"array<{row}>")).alias("r")))
    any_field = F.coalesce(*[F.col(f"r.{f}").cast("string") for f in spark.createDataFrame([], schema).columns])
    return found.where(any_field.isNotNull()).select("r.*", "model_name")


def markdown_templates(docs: DataFrame) -> DataFrame:
    """Sections ``## N. name`` of markdown texts with the template fenced before the rationale."""
    body = r"(?s)\*\*Template\*\*:\s*\n```\n(.*?)\n```\s*\n\s*\*\*Rationale\*\*:"
    sections = F.split("markdown", r"(?m)^## \d+\. ")
    keep = [c for c in docs.columns if c != "markdown"]
    each = docs.select(*keep, F.posexplode(F.slice(sections, 2, F.size(sections))).alias("section_no", "section"))
    return each.select(
        *keep,
        "section_no",
        F.trim(F.regexp_extract("section", r"^([^\n]+)", 1)).alias("name"),
        F.regexp_extract("section", body, 1).alias("template"),
    ).where("template <> ''")


def header_metadata(content: Column | str) -> Column:
    """Map of the ``@benchmark_key: value`` lines among the first twenty; the last one of a key wins."""
    pattern = r"@benchmark_(\w+):\s*(.+)"
    head = F.filter(F.slice(F.split(col(content), "\n"), 1, 20), lambda x: x.rlike(pattern))
    pairs = F.transform(
        head,
        lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("key"), F.trim(F.regexp_extract(x, pattern, 2)).alias("value")),
    )
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    return F.map_from_entries(
        F.transform(
            keys,
            lambda k: F.struct(k, F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"]),
        )
    )


def labelled_cases(files: DataFrame) -> DataFrame:
    """Labelled cases from the header, else from telling file names."""
    meta = header_metadata("content")
    low = F.lower(F.regexp_extract("file_path", r"([^/]*)$", 1))
    guess = (
        F.when(low.contains("overflow"), "Buffer Overflow")
        .when(low.contains("injection"), "Injection")
        .when(low.contains("xss"), "XSS")
        .when(low.contains("leak"), "Memory Leak")
        .otherwise("Unknown")
    )
    named = F.col("_m")["finding"].isNotNull()
    return (
        files.where(F.col("file_path").rlike(r"\.(c|cpp|py|js|ts)$"))
        .withColumn("_m", meta)
        .select(
            "file_id",
            "file_path",
            F.coalesce(F.col("_m")["finding"], guess).alias("expected_type"),
            F.when(named, F.coalesce(F.col("_m")["severity"], F.lit("High"))).otherwise("Medium").alias("expected_severity"),
            F.when(named, F.col("_m")["line"].try_cast("int")).alias("expected_line"),
        )
    )
