"""Secret scans: fixed patterns, and random strings told from identifiers by character Markov models.

DataFrame functions only.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.registry import query, table

#: Keywords match in either case, ASCII only.
KEYWORDS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
ASSIGN = rf"""({KEYWORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}", r"[0-9a-f]{32,}"
KINDS = ("assign", "access", "hex", "markov")
#: Strings that the models look at, and the codes of their characters: 43 ("+") to 122 ("z").
CANDIDATE, WORD = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{6,}"
LOWEST, WIDTH = 43, 80
#: Documents that labelled samples are drawn from, about; the log-likelihood ratio that tells a secret,
#: in all and a transition.
SAMPLE_DOCS, LEAST_RATIO, LEAST_MEAN = 20_000, 12.0, 0.4
BLOCK = 256


def let(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def prefix_sums(values: Column) -> Column:
    """Sums of the earlier elements, for each element; in blocks, so that long arrays stay near linear."""

    def running(array: Column) -> Column:
        start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(
            array, start, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
        )["out"]

    def summed(array: Column) -> Column:
        return F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + x)

    blocks = F.transform(
        F.sequence(F.lit(0), ((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, F.lit(BLOCK))
    )
    joined = let(
        blocks,
        lambda bs: F.flatten(
            F.zip_with(F.transform(bs, running), running(F.transform(bs, summed)), lambda inner, o: F.transform(inner, lambda v: v + o))
        ),
    )
    return F.when(F.size(values) > 0, joined).otherwise(F.array().cast("array<bigint>"))


def located(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<s, e, m>>: code points, end exclusive."""

    def place(found: Column) -> Column:
        lengths = F.zip_with(found["gaps"], found["hits"], lambda g, m: (F.char_length(g) + F.coalesce(F.char_length(m), F.lit(0))).cast("bigint"))
        starts = F.zip_with(prefix_sums(lengths), found["gaps"], lambda at, g: at + F.char_length(g))
        return F.zip_with(
            found["hits"], F.slice(starts, F.lit(1), F.size(found["hits"])),
            lambda m, s: F.struct(s.alias("s"), (s + F.char_length(m)).alias("e"), m.alias("m")),
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    found = let(F.struct(hits.alias("hits"), F.split(text, pattern, -1).alias("gaps")), place)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast("array<struct<s:bigint,e:bigint,m:string>>"))


@dataclass(frozen=True)
class Markov:
    """Log-likelihood ratio, random over ordinary, of each transition between two characters."""

    ratios: tuple[float, ...]

    def score(self, text: Column) -> Column:
        """Struct (total, n): summed ratio and number of transitions of an ASCII string."""
        table_ = F.split(F.lit(",".join(map(repr, self.ratios))), ",").cast("array<double>")
        codes = F.transform(F.split(text, ""), lambda c: F.ascii(c) - LOWEST)
        start = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("total"), F.lit(0).alias("n"))

        def step(s: Column, c: Column) -> Column:
            known = (s["last"] >= 0) & (c >= 0)
            return F.struct(
                c.alias("last"),
                F.when(known, s["total"] + F.element_at(table_, s["last"] * WIDTH + c + 1)).otherwise(s["total"]).alias("total"),
                F.when(known, s["n"] + 1).otherwise(s["n"]).alias("n"),
            )

        return F.aggregate(codes, start, step)


def fit(samples: DataFrame) -> Markov:
    """Learn from labelled samples (token, secret boolean).

    Only counts of transitions, at most 80 by 80 a label, reach the driver. Every transition is
    smoothed by one; without samples of a label its model is uniform.
    """
    codes = F.transform(F.split("token", ""), lambda c: F.ascii(c) - LOWEST)
    listed = samples.where("token is not null and secret is not null").select("secret", codes.alias("c"))
    steps = listed.select("secret", F.explode(F.arrays_zip(F.slice("c", F.lit(1), F.greatest(F.size("c") - 1, F.lit(0))).alias("a"), F.slice("c", F.lit(2), F.size("c")).alias("b"))).alias("t"))
    valid = F.col("t.a").between(0, WIDTH - 1) & F.col("t.b").between(0, WIDTH - 1)
    rows = steps.where(valid).groupBy("secret", F.col("t.a").alias("a"), F.col("t.b").alias("b")).count().collect()
    counts, sums = defaultdict(float), defaultdict(float)
    for r in rows:
        counts[r.secret, r.a, r.b] += r["count"]
        sums[r.secret, r.a] += r["count"]
    alphabet = 66  # of the 80 codes

    def log_p(label: bool, a: int, b: int) -> float:
        return math.log((counts[label, a, b] + 1) / (sums[label, a] + alphabet))

    return Markov(tuple(round(log_p(True, a, b) - log_p(False, a, b), 6) for a in range(WIDTH) for b in range(WIDTH)))


def labelled_samples(docs: DataFrame, about: int = SAMPLE_DOCS) -> DataFrame:
    """Labelled strings of about ``about`` documents, drawn by a hash of the text: a bounded sample.

    What the fixed patterns find is secret; other strings of the same characters, in texts without
    a finding, are ordinary.
    """
    rows = max(1, docs.count())
    share = min(1.0, about / rows)
    drawn = docs.select(F.col("text").cast("string").alias("text")).where(
        F.col("text").isNotNull() & (F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))
    )
    values = F.concat(
        F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= 8),
        F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.regexp_extract_all("text", F.lit(HEX), F.lit(0)),
    )
    found = drawn.select("text", values.alias("v"))
    tokens = F.when(F.size("v") > 0, F.col("v")).otherwise(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    return found.select((F.size("v") > 0).alias("secret"), F.explode(tokens).alias("token"))


def find_secrets(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """All columns of ``docs`` plus ``secret_spans``: array<struct<s, kind, e>> by start, then kind.

    ``kind`` indexes ``KINDS``. Base findings stay as they are; the Markov kind adds strings of 20
    and more characters whose ratio favours a random string; kinds may overlap. Null and empty
    texts have none. Without ``model`` one is learnt from the documents. Map-only apart from that.
    """
    model = model or fit(labelled_samples(docs))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def spans(kind: int, found: Column) -> Column:
        return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("kind"), x["e"].alias("e")))

    value = lambda m: F.char_length(F.regexp_extract(m, "^" + ASSIGN, 2))
    assigned = F.filter(located(text, ASSIGN), lambda x: value(x["m"]) >= 8)

    def random_looking(x: Column) -> Column:
        return let(model.score(x["m"]), lambda s: (s["total"] >= LEAST_RATIO) & (s["total"] >= LEAST_MEAN * s["n"]))

    all_spans = F.concat(
        spans(0, assigned), spans(1, located(text, ACCESS)), spans(2, located(text, HEX)),
        spans(3, F.filter(located(text, CANDIDATE), random_looking)),
    )
    return docs.withColumn("secret_spans", F.sort_array(all_spans))


def digest(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["s"], x["e"])), ",")


def redact(docs: DataFrame, model: Markov | None = None, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span, overlapping ones as one, replaced by ``mark`` in the text."""
    found = find_secrets(docs, model)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring("text", (acc["at"] + 1).cast("int"), (x["s"] - acc["at"]).cast("int"))
        fresh = (x["s"] > acc["at"]) | (F.size(acc["out"]) == 0)
        return F.struct(
            F.greatest(acc["at"], x["e"]).alias("at"),
            F.when(fresh, F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"),
        )

    def close(acc: Column) -> Column:
        rest = F.substring("text", (acc["at"] + 1).cast("int"), F.char_length("text"))
        return F.concat(F.array_join(acc["out"], ""), rest)

    clean = F.when(F.size("secret_spans") > 0, F.aggregate("secret_spans", start, step, close)).otherwise(F.col("text"))
    return found.withColumn("text", clean).drop("secret_spans")


def secret_counts(docs: DataFrame, model: Markov | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans of every row of ``docs``.

    Null and empty texts have no spans (the digest of nothing). A null id stays null, repeated rows
    are each returned, empty input gives no rows, other columns are not read.
    """
    found = find_secrets(docs.select("doc_id", "text"), model).select("doc_id", "secret_spans")
    count = lambda k: F.size(F.filter("secret_spans", lambda x: x["kind"] == k)).cast("bigint")
    base = F.filter("secret_spans", lambda x: x["kind"] < 3)
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)),
        F.sha2(digest(base), 256).alias("base_sha256"), digest(F.col("secret_spans")).alias("spans"),
    )


@query("op9_secret_scan")
def op9_secret_scan(spark, sf_dir):
    return secret_counts(table(spark, sf_dir, "documents"))
