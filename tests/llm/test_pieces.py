from __future__ import annotations

import random
import string

import public_tokenizers
import sentencepiece

from auditlake.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PAIRS = pieces.joined(MODEL)
ODD = [", ", "x.", "y,", "1,", "\",", "\n\n", "a", "the", " ", "  ", "   ", "\n", "\t", "é", "ß", "<s>", "<unk>", "日本", "🙂", ".", "#", "ing", "tion", "ther", "\x00", "house", "Über"]


def texts_of(rng, n):
    texts = ["".join(rng.choices(ODD, k=rng.randint(0, 25))) for _ in range(n)]
    return texts + ["", " ", "   ", "a ", " a", "a  ", "word " * 4000, "x" * 200]


def test_merges_equal_the_library(spark, make_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = texts_of(random.Random(3), 120)
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)] + [(None, texts[2], None, None), (3, texts[3], "en", "s"), (9000, None, "en", "s")]
    found = pieces.encode_documents(make_docs(rows), MODEL, "merges", block_bytes=4000).collect()
    got = sorted(((r.doc_id, r.n_pieces, list(r.ids), r.decoded) for r in found), key=repr)
    want = [(i, len(ids), ids, t or "") for i, t, *_ in rows for ids in [library.encode(t or "")]]
    assert got == sorted(want, key=repr)
    assert pieces.encode_documents(make_docs(rows).limit(0), MODEL, "merges").collect() == []


def test_literal_marks_and_long_units_equal_the_library(spark, make_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(5)
    base64 = string.ascii_letters + string.digits + "+/"
    texts = ["▁ a▁b ▁▁", "▁", "▁▁x", "y" * 1500 + " é" + "▁" * 30, "a" * 1023, "a" * 1024, "x" * 5000, "ab" * 3000]
    texts += ["".join(rng.choices(base64, k=k)) for k in (1025, 8000, 30_000)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(6000)), "日本語の文章です。" * 400, "🙂" * 2000]
    texts += ["<p>" + "".join(rng.choices("</>abc=;{}é", k=4000)) + "</p>", "id " + "".join(rng.choices(base64, k=3000)) + "  end.\n" + "z" * 2000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in pieces.encode_documents(make_docs(rows), MODEL, "merges").collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text)
        assert list(found[i].ids) == ids and found[i].n_pieces == len(ids), text[:40]
        assert found[i].decoded == library.decode(ids) == text.replace("▁", " ")


def test_long_folds_equal_the_lattice(spark):
    rng = random.Random(9)
    found = ["".join(rng.choices(ODD[:-8] + list("abcdefgh"), k=rng.randint(1, 30))) for _ in range(60)]
    listed = sorted({u for t in found for u in pieces.units(t, PAIRS)} | {"x" * 70, "ab" * 40})
    for fold in pieces.FOLDS:
        rows = pieces.encode_units(spark.createDataFrame([(u,) for u in listed], "unit string"), MODEL, fold).collect()
        assert {r.unit: list(r.ids) for r in rows} == {u: pieces.long_ids(u, MODEL, fold) for u in listed}


def best_path(text, scores, byte_ids, penalty):
    """Dynamic programming over one text; ties to the shorter last piece."""
    best = [(0.0, -1, [])]
    for e in range(1, len(text) + 1):
        options = []
        for s in range(max(0, e - 16), e):
            piece = text[s:e]
            if piece in scores:
                score, i = scores[piece]
                options.append((best[s][0] + score, s, [i]))
            elif e - s == 1:
                options.append((best[s][0] + penalty, s, [byte_ids[b] for b in piece.encode()]))
        best.append(max(options))
    out, at = [], len(text)
    while at > 0:
        out = best[at][2] + out
        at = best[at][1]
    return out


def test_viterbi_finds_the_best_path(spark):
    ordinary, byte_ids = pieces.vocabulary(MODEL)
    scores = {p: (s, i) for p, i, s in ordinary}
    worst = min(s for _, _, s in ordinary) - pieces.PENALTY
    rng = random.Random(4)
    units = sorted({u for t in texts_of(rng, 60) if t for u in pieces.units(t, PAIRS)})
    rows = pieces.encode_units(spark.createDataFrame([(u,) for u in units], "unit string"), MODEL, "viterbi").collect()
    assert {r.unit: list(r.ids) for r in rows} == {u: best_path(u, scores, byte_ids, worst) for u in units}


def test_units_join_to_the_text():
    rng = random.Random(8)
    for text in texts_of(rng, 2000) + ["\n", "\n\na", "a\n", ".", ",", "a.\nb,", " \n "]:
        assert "".join(pieces.units(text, PAIRS)) == " " + text
