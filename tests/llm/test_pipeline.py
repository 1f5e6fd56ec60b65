"""The pipeline against a plain restatement of its stages on a small table."""

from __future__ import annotations

import hashlib
import random
import sys
from collections import Counter
from pathlib import Path

import public_tokenizers
import sentencepiece

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from auditlake.llm.mixing import mix
from test_langid import TEXTS
from test_secrets import plain_base
from test_similar import plain_kept


def rows_of(rng):
    words = {lang: [w + e for w in text.split() for e in ("", "en", "t", "os")] for lang, text in TEXTS.items()}
    rows = []
    for i in range(240):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randint(15, 80))), lang, rng.choice(["a", "a", "b", None])))
    rows += [(500 + i, rows[i][1], rows[i][2], "c") for i in range(20)]  # exact copies
    rows += [(600 + i, rows[i][1] + " password=abcdef1234567890xyz", rows[i][2], "c") for i in range(20, 40)]
    rows += [(700, None, "en", "a"), (701, "", "en", "a"), (702, "12 34 !!", None, "a"), (703, (rows[5][1] + "\n") * 300, None, "b")]
    return rows


def test_pipeline(spark, make_docs, tmp_path):
    rows = rows_of(random.Random(12))
    docs = make_docs(rows)
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    outs = []
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept, str(tmp_path))
        path = str(tmp_path / f"stage-{number}")
        out.write.parquet(path)
        kept = spark.read.parquet(path)
        outs.append(kept)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert kept.columns == docs.columns
    told, single, clean, mixed, encoded = (o.collect() for o in outs)

    assert {r.doc_id for r in told} == {i for i, *_ in rows} - {700, 701, 702}
    assert all(r.lang == lang for r in told for i, _, lang, _ in rows if i == r.doc_id and lang and i < 240)

    assert sorted(r.doc_id for r in single) == sorted(plain_kept([(r.doc_id, r.text) for r in told]))

    before = {r.doc_id: r.text for r in single}
    for r in clean:
        assert not plain_base(r.text)
        if not plain_base(before[r.doc_id]) and "=" not in before[r.doc_id]:
            assert r.text == before[r.doc_id]
    assert {r.doc_id for r in clean} == set(before)

    copies = Counter(r.doc_id for r in mixed)
    for r in mix(outs[2]).collect():
        assert 0 <= copies[r.doc_id] - r.taken // max(r.size, 1) <= (1 if r.taken % max(r.size, 1) else 0)
    taken, words = Counter(), Counter()
    for r in mix(outs[2]).collect():
        taken[r.source] += r.taken
        words[r.source] = max(words[r.source], r.size)
    for r in mixed:
        taken[r.source] -= len(r.text.split())
    assert all(abs(n) <= words[source] for source, n in taken.items())

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in mixed:
        want.append((r.doc_id, library.encode(r.text), digest(r.text)))
    hashed = spark.createDataFrame([(i, len(x), x, d) for i, x, d in want], "doc_id bigint, n bigint, ids array<int>, d string")
    want = sorted(map(tuple, hashed.selectExpr("doc_id", "n", "xxhash64(ids)", "d").collect()))
    assert sorted(map(tuple, encoded)) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_stages_with_odd_ids_and_columns(spark):
    """Null ids, one id for several texts, repeated rows, and columns called like the stages' own."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    rows = [(1, text(1)), (1, text(2)), (1, text(1)), (None, text(1)), (None, text(3)), (None, text(3) + " end"), (None, text(4)), (7, text(4))]
    frame = spark.createDataFrame(
        [(i, t, "en", "s", 1, 2, 3, "x", "y") for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, _times int, _turn int, component_id string, row string",
    )
    single = corpus_pipeline.near_dedup(spark, frame, "")
    assert single.columns == frame.columns
    kept = [(r.doc_id, r.text) for r in single.collect()]
    assert sorted(kept, key=str)[:3] == [(1, text(1)), (1, text(2)), (7, text(4))] and len(kept) == 4
    assert [t in (text(3), text(3) + " end") for i, t in kept if i is None] == [True]
    mixed = corpus_pipeline.source_mix(spark, single, "")
    assert mixed.columns == frame.columns and {r.doc_id for r in mixed.collect()} <= {None, 1, 7}
    none = frame.limit(0)
    assert corpus_pipeline.near_dedup(spark, none, "").collect() == [] == corpus_pipeline.source_mix(spark, none, "").collect()
