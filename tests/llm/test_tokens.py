from __future__ import annotations

import random

import public_tokenizers
import sentencepiece

from auditlake.llm.tokens import count_batch, count_tokens, units

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def test_counts_equal_the_library_on_odd_texts():
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    alphabet = ["a", "the", " ", "  ", "   ", "\n", "\t", "é", "ß", "<s>", "</s>", "<unk>", "<0x41>", "▁", "ﬁ", "日本", "🙂", ".", "#", " ", "\x00", "ing"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 30))) for _ in range(3000)]
    texts += ["", " ", "  ", "a ", " a", "a  ", "x" * 3000, "word " * 5000, "▁▁ ▁", "▁ a"]
    assert count_batch(library, texts, {}) == [len(x) for x in library.encode(texts)]


def test_units_keep_every_character():
    for text in ["a b", " a  b ", "   ", "", "a", "a  b   c  "]:
        cut = units(text)
        assert cut[:1] + [" " + u for u in cut[1:]] == [text] or "".join(cut[:1] + [" " + u for u in cut[1:]]) == text


def test_rows(spark, make_docs):
    rows = [(1, "hello world", "en", "a"), (1, "hello world", "en", "a"), (None, None, None, None), (2, "", "en", None), (3, "é" * 9000, "fr", "a")]
    got = sorted(map(tuple, count_tokens(make_docs(rows), MODEL).collect()), key=repr)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 4096) for i, t, *_ in rows]
    assert got == sorted(want, key=repr)
    assert count_tokens(make_docs(rows).limit(0), MODEL).collect() == []
