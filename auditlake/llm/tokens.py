"""Token counts with a SentencePiece model, in Arrow batches that return lengths only."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import by_bytes
from auditlake.llm.registry import query, table

UNIT = re.compile(r" *[^ ]+(?: +\Z)?")
#: Text bytes of one encoding batch; entries and length of the units whose count a worker remembers.
BATCH_BYTES, REMEMBERED, LONGEST = 2 << 20, 400_000, 64


def units(text: str) -> list[str]:
    """Cut a text at safe boundaries: before the spaces that follow a word.

    Every unit but the first loses one leading space, which the encoder's own prefix replaces. The
    encoder's mark for a space is one in a text too.
    Safe where no piece has a space mark behind another character and the normaliser is the
    identity with a dummy prefix; ``check_model`` proves both for the model in use.
    """
    text = text.replace("▁", " ")
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ") if text else []
    found = UNIT.findall(text)
    if not found:
        return [text]
    return [found[0], *(u[1:] for u in found[1:])]


def check_model(processor) -> None:
    """Raise unless the cuts of ``units`` are safe with this model."""
    for i in range(processor.get_piece_size()):
        if "▁" in processor.id_to_piece(i).lstrip("▁"):
            raise ValueError("a piece spans a word boundary")
    probe = "a  éÅﬁ b"
    if processor.decode(processor.encode(probe)) != probe or processor.encode("a", out_type=str)[0][0] != "▁":
        raise ValueError("the model normalises texts or adds no prefix")
    if processor.encode("a▁▁b ▁") != processor.encode("a  b  "):
        raise ValueError("the model tells its mark from a space")


@lru_cache(maxsize=2)
def processor_of(path: str):
    import sentencepiece

    processor = sentencepiece.SentencePieceProcessor(model_file=path)
    check_model(processor)
    return processor


def count_batch(processor, texts: list[str], known: dict[str, int]) -> list[int]:
    """Tokens of each text; units not yet in ``known`` are encoded together, only lengths are kept."""
    cuts = [units(t) for t in texts]
    fresh = list(set().union(*cuts).difference(known)) if cuts else []
    if len(known) + len(fresh) > REMEMBERED:
        known.clear()
        fresh = list(set().union(*cuts))
    known.update(zip(fresh, map(len, processor.encode(fresh, num_threads=1))))
    counts = [sum(map(known.__getitem__, c)) for c in cuts]
    for unit in fresh:
        if len(unit) > LONGEST:
            del known[unit]
    return counts


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more tokens than ``limit``) of every row.

    A null text counts as empty: no bytes, no tokens. A null doc_id stays null; repeated rows are
    each returned; other columns are not read. Map-only: nothing is shuffled, and a lost task is
    counted again from its input. ``model_path`` must be readable on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, known = processor_of(model_path), {}
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            texts = batch.column("text")
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).cast(pa.int64())
            counts = count_batch(processor, [t or "" for t in texts.to_pylist()], known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), n_bytes, pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean"
    )


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
