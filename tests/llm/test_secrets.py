from __future__ import annotations

import hashlib
import random
import re

from auditlake.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def plain_base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def plain_markov(text, ratios):
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text or ""):
        steps = [ratios[(ord(a) - 43) * 80 + ord(b) - 43] for a, b in zip(m[0], m[0][1:])]
        if sum(steps) >= secrets.LEAST_RATIO and sum(steps) >= secrets.LEAST_MEAN * len(steps):
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans):
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)


def texts_of(rng):
    parts = ["password", "PassWd", "secret", "token", "api_key", "ApiKey", "=", ":", " ", "  ", '"', "'", "abcdefgh", "short", "AKIA", "ABCDEFGH1234", "XY", "0123456789abcdef", "deadbeef" * 5, "é", "🙂", "\n", ".", "-", "K", "ſ"]
    return ["".join(rng.choices(parts, k=rng.randint(0, 14))) for _ in range(1500)]


def test_rows(spark, make_docs):
    rng = random.Random(8)
    texts = texts_of(rng)
    noise = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789", k=40))
    texts += [None, "", f"see {noise} there", ("word " * 2000 + "token=abcdefgh12 " + "é" * 50) * 30, "internationalisation_of_the_application_framework"]
    words = "the quick brown fox jumped over several lazy dogs because reasonable people always prefer international communication".split()
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    rows += [(10_000 + i, " ".join(rng.choices(words, k=60)), "en", "s") for i in range(300)]
    rows += [(20_000 + i, "key " + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789", k=30)) + " token=" + "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnpqrstuvwxyz0123456789", k=30)), "en", "s") for i in range(300)]
    rows += [(None, texts[5], None, None), rows[7], rows[7]]
    docs = make_docs(rows).repartition(4)
    model = secrets.fit(secrets.labelled_samples(docs))
    got = secrets.secret_counts(docs, model).collect()
    want = []
    for i, t, *_ in rows:
        base = plain_base(t)
        extra = plain_markov(t, model.ratios)
        counts = [sum(k == x[1] for x in base + extra) for k in range(4)]
        want.append((i, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + extra))))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    found = {r.doc_id: r.n_markov for r in got}
    assert found[len(texts) - 3] == 1 and found[len(texts) - 1] == 0
    assert secrets.secret_counts(docs.limit(0)).collect() == []


def test_model_matches_counts(spark):
    samples = spark.createDataFrame([("abab", True), ("aab", False), (None, True), ("x", False)], "token string, secret boolean")
    ratios = secrets.fit(samples).ratios
    import math

    a, b = ord("a") - 43, ord("b") - 43
    assert abs(ratios[a * 80 + b] - (math.log(3 / 68) - math.log(2 / 68))) < 1e-5
    assert abs(ratios[b * 80 + a] - (math.log(2 / 67) - math.log(1 / 66))) < 1e-5


def test_redaction(spark, make_docs):
    text = "é token=abcdefgh12345678 then " + "deadbeef" * 5 + " end 🙂"
    rows = [(1, text, "en", "s"), (2, None, "en", "s"), (3, "clean", "en", "s"), (4, "deadbeef" * 5, "en", "s")]
    got = {r.doc_id: r for r in secrets.redact(make_docs(rows)).collect()}
    assert got[1].text == "é [SECRET] then [SECRET] end 🙂"
    assert got[2].text is None and got[3].text == "clean" and got[4].text == "[SECRET]"
    assert got[1].size == "x" and secrets.redact(make_docs(rows)).columns == make_docs(rows).columns
