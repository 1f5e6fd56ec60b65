from __future__ import annotations

import tracemalloc
import zlib

import numpy as np

from auditlake.llm import langid

TEXTS = {
    "en": "the house and the garden of this man with that thing for them",
    "de": "der mann und das haus mit dem garten ist nicht für die ungeheuer",
    "fr": "la maison et le jardin des hommes est pour une élève avec être",
    "es": "la casa y el jardín de los hombres para una niña con el corazón",
}


def shifted(text, k):
    words = text.split()
    return " ".join(words[(i * 7 + k) % len(words)] for i in range(12))


def test_small_set(spark, make_docs):
    rows = [(i, shifted(TEXTS[lang], i), lang, "s") for i, lang in enumerate(list(TEXTS) * 40)]
    rows += [(9001, None, "en", None), (9002, "", "en", "s"), (9003, "12 ... !", "fr", "s"), (None, shifted(TEXTS["de"], 3), None, "s")]
    rows += [(9004, (TEXTS["es"] + " ") * 20_000, None, "s"), rows[1], rows[1]]
    docs = make_docs(rows)
    got = langid.language_id(docs, rows_per_lang=30).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for i, _, lang, _ in rows[:160]:
        assert by_id[i].lang_pred == lang and 0.5 <= by_id[i].score <= 1
        assert by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [by_id[k].lang_pred for k in (9001, 9002, 9003, None, 9004)] == ["und", "und", "und", "de", "es"]
    assert by_id[None].held_out is False
    again = langid.language_id(docs.repartition(5), rows_per_lang=30).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert langid.language_id(docs.limit(0)).collect() == []
    unlabelled = langid.language_id(docs.where("lang is null")).collect()
    assert {r.lang_pred for r in unlabelled} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert len(got) > 150 and right >= 0.98 * len(got)


def test_learning_holds_the_vectors_once():
    # The driver's Python held them five times, in 64 bits.
    noise = np.random.default_rng(5)
    rows = []
    for k, lang in enumerate(("de", "en", "fr", "ja")):
        vectors = noise.random((100, langid.FEATURES), np.float32) + (np.arange(langid.FEATURES) % 4 == k)
        rows += [(lang, (v / np.linalg.norm(v)).astype(np.float32).tobytes()) for v in vectors]
    tracemalloc.start()
    model = langid.learn(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2.5 * sum(len(v) for _, v in rows)
    for lang, vector in rows[::37]:
        assert model.predict(langid.with_bias(np.frombuffer(vector, np.float32).astype(float)))[0] == lang
