"""Language identification in two steps: the family, then one-versus-one linear SVMs inside it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes
from auditlake.llm.registry import query, table

#: Families of closely related languages; a language not named here is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Hashed n-gram features, the lengths in bytes, and how many labelled rows a language is learnt from.
FEATURES, GRAMS, ROWS_PER_LANG = 4096, (1, 2, 3, 4), 400
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of one text hashed at a time.
PIECE = 1 << 20


def features(text: str) -> np.ndarray:
    """Unit vector of square-rooted counts of hashed byte n-grams of the lower-cased whole text."""
    data = np.frombuffer((" " + text.lower() + " ").encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(FEATURES)
    longest = max(GRAMS)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + longest - 1].astype(np.uint32)
        new = min(PIECE, len(data) - at)
        value = np.zeros(len(part), np.uint32)
        for n in range(1, longest + 1):
            value = value[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :]
            if n in GRAMS and len(value):
                mixed = (value[:new] + np.uint32(n)) * np.uint32(2654435761)
                counts += np.bincount(mixed >> np.uint32(32 - FEATURES.bit_length() + 1), minlength=FEATURES)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, rounds: int = 40) -> np.ndarray:
    """Weights of a linear SVM with hinge loss by dual coordinate descent; y is +1 or -1.

    The constant last column of ``x`` acts as the bias. Classes are weighted to count alike. Rows are widened
    to doubles one at a time, so that ``x`` may be of 32-bit floats.
    """
    weights, alpha = np.zeros(x.shape[1]), np.zeros(len(y))
    norm = np.array([np.square(row, dtype=float).sum() for row in x])
    top = np.where(y > 0, 1 / max(1, (y > 0).sum()), 1 / max(1, (y < 0).sum())) * len(y) / 2 * cost
    order = np.random.RandomState(11)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)):
            row = x[i].astype(float)
            new = min(max(alpha[i] - (y[i] * (row @ weights) - 1) / norm[i], 0.0), top[i])
            if new != alpha[i]:
                weights += (new - alpha[i]) * y[i] * row
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return weights


@dataclass(frozen=True)
class Model:
    """Pairs of families, and pairs of languages inside each, with their weights."""

    families: tuple[str, ...]
    languages: dict[str, tuple[str, ...]]
    family_pairs: dict[tuple[int, int], np.ndarray]
    language_pairs: dict[str, dict[tuple[int, int], np.ndarray]]

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        family, sure = vote(x, len(self.families), self.family_pairs)
        name = self.families[family]
        language, surer = vote(x, len(self.languages[name]), self.language_pairs[name])
        return self.languages[name][language], sure * surer


def pairs_of(x: np.ndarray, y: np.ndarray, classes: int) -> dict[tuple[int, int], np.ndarray]:
    """One SVM for each pair of classes; rows of no class have -1."""
    out = {}
    for a in range(classes):
        for b in range(a + 1, classes):
            rows = (y == a) | (y == b)
            out[a, b] = linear_svm(x[rows], np.where(y[rows] == a, 1.0, -1.0))
    return out


def vote(x: np.ndarray, classes: int, pairs: dict[tuple[int, int], np.ndarray]) -> tuple[int, float]:
    """Class with most votes (ties: larger summed margin, then the first) and its weakest sigmoid."""
    if classes == 1:
        return 0, 1.0
    votes, margins, weakest = np.zeros(classes), np.zeros(classes), np.full(classes, np.inf)
    for (a, b), weights in pairs.items():
        margin = float(x @ weights)
        votes[a if margin >= 0 else b] += 1
        for k, m in ((a, margin), (b, -margin)):
            margins[k] += m
            weakest[k] = min(weakest[k], m)
    best = max(range(classes), key=lambda k: (votes[k], margins[k], -k))
    return best, 1 / (1 + np.exp(-2 * np.clip(weakest[best], -30, 30)))


def with_bias(x: np.ndarray) -> np.ndarray:
    return np.append(x, np.ones((*x.shape[:-1], 1)), axis=-1)


def learn(rows: list) -> Model:
    """A model of rows (lang, x), x the bytes of a feature vector, in any order.

    The vectors are held once, in 32 bits as they come; a pair of classes copies no more than its own.
    """
    rows = sorted(rows, key=lambda r: (r[0], bytes(r[1])))
    x = np.ones((len(rows), FEATURES + 1), np.float32)
    for i, (_, vector) in enumerate(rows):
        x[i, :-1] = np.frombuffer(vector, np.float32)
    langs = np.array([lang for lang, _ in rows])
    family = np.array([FAMILY_OF.get(lang, lang) for lang in langs])
    families = tuple(sorted(set(family)))
    languages = {f: tuple(sorted(set(langs[family == f]))) for f in families}
    index = np.array([families.index(f) for f in family])
    inside = {}
    for f in families:
        own = np.array([languages[f].index(v) if g == f else -1 for v, g in zip(langs, family)])
        inside[f] = pairs_of(x, own, len(languages[f]))
    return Model(families, languages, pairs_of(x, index, len(families)), inside)


def fit(labelled: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """Learn from rows (doc_id, text, lang); None if no row has a language and a letter.

    At most ``rows_per_lang`` rows of each language are used, the first by a hash of id and text:
    a bounded, documented sample. Their feature vectors are made in tasks; only those, of fixed
    length, reach the driver.
    """
    usable = labelled.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(
        "lang", "text", F.xxhash64("doc_id", "text").alias("h")
    )
    nth = Window.partitionBy("lang").orderBy("h")
    kept = usable.select("lang", "h").distinct().withColumn("n", F.row_number().over(nth)).where(F.col("n") <= rows_per_lang)
    # One row a language that is learnt; the texts are then picked where they lie.
    last = {r.lang: r.h for r in kept.groupBy("lang").agg(F.max("h").alias("h")).collect()}
    if not last:
        return None
    chosen = F.lit(False)
    for lang, h in sorted(last.items()):
        chosen = chosen | ((F.col("lang") == lang) & (F.col("h") <= h))
    texts = usable.where(chosen).dropDuplicates(["lang", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", 4 << 20):
            vectors = [features(t).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(vectors, pa.binary())], names=["lang", "x"])

    return learn(texts.select("lang", "text").mapInArrow(run, "lang string, x binary").collect())


def held_out(doc_id: Column) -> Column:
    """Rows that are never learnt from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """All columns of ``docs`` plus lang_pred and score (0 to 1); map-only, the text alone decides.

    ``und`` with score 0 where the text is null or has no letter, or where nothing was learnt.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "_doc_text", 4 << 20):
            found = []
            for text in batch.column("_doc_text").to_pylist():
                known = model is not None and text is not None and LETTER.search(text)
                found.append(model.predict(with_bias(features(text).astype(float))) if known else ("und", 0.0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found]), pa.array([float(f[1]) for f in found])],
                names=[*batch.schema.names[:-1], "lang_pred", "score"],
            )

    from pyspark.sql.types import StringType, StructField, StructType, DoubleType

    rest = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score")]
    schema = StructType([*rest, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    given = docs.select(*(F.col(f"`{f.name}`") for f in rest), F.col("text").cast("string").alias("_doc_text"))
    return given.mapInArrow(run, schema)


def learnt_from(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Model | None:
    """A model of the rows of ``docs`` that are not held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), rows_per_lang)


def language_id(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang, ...).

    Learns from rows with a language that are not held out (a null id counts as not held out);
    lang, source and doc_id are no features. Repeated rows are each returned and each learnt from;
    with one language learnt, every text with a letter gets it with score 1; empty input gives none.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, learnt_from(docs, rows_per_lang)).drop("text")


@query("op5_language_id")
def op5_language_id(spark, sf_dir):
    return language_id(table(spark, sf_dir, "documents"))
