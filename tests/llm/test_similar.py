"""Near copies of the pipeline: planted copies, and brute force over shingle sets."""

from __future__ import annotations

import random
import re

import corpus_pipeline
import numpy as np
from auditlake.llm import similar
from auditlake.llm.minmax import shingle_set


def plain_shingles(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_kept(rows):
    """Smallest id of each component of pairs with a similarity of 0.8 or more."""
    sets = {i: plain_shingles(text) for i, text in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if 9 * both >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def test_planted_copies_go(spark, make_docs):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    passage = " ".join(rng.choices(words, k=40))
    rows, copies = [], set()
    for i in range(120):
        text = rng.choices(words, k=rng.randint(100, 200))
        rows.append((i, " ".join(text) + (" " + passage if i % 2 else "")))
        for k, changed in enumerate((1, 2)):
            copy = rows[-1][1].split()
            for at in rng.sample(range(len(copy)), changed):
                copy[at] = "changed"
            if 9 * len(plain_shingles(rows[i * 3][1]) & plain_shingles(" ".join(copy))) >= 4 * (
                len(plain_shingles(rows[i * 3][1])) + len(plain_shingles(" ".join(copy)))
            ):
                copies.add(1000 + 2 * i + k)
            rows.append((1000 + 2 * i + k, " ".join(copy)))
    # A hot group whose members are copies of a base, not all of each other; short texts.
    base = rng.choices(words, k=120)
    for i in range(150):
        copy = list(base)
        for at in rng.sample(range(120), 2):
            copy[at] = f"x{i}"
        rows.append((5000 + i, " ".join(copy)))
    rows += [(6000 + i, t) for i, t in enumerate(("a b", "A  b", "a b c", "a b c d e f g h i j", "a b c d e f g h i k", "a b c d e f g h i j l"))]
    docs = make_docs([(i, t, "en", "s") for i, t in rows])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert len(copies) > 200 and not kept & copies
    assert kept == plain_kept(rows)


def test_whole_rows_are_shuffled_once(spark, make_docs, capsys):
    """Copies and repeated rows meet in one exchange of whole rows, which rows alone in their group do not pass."""
    text = lambda n: " ".join(f"w{n}x{i}" for i in range(40))
    docs = make_docs([(i, text(i), "en", "s") for i in range(30)] + [(90, text(3), "en", "s"), (91, text(4) + " end", "en", "s"), (5, text(5), "en", "s")])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.near_dedup(spark, docs, "")
        assert sorted(r.doc_id for r in out.collect()) == list(range(30))
        capsys.readouterr()
        corpus_pipeline.near_dedup(spark, docs, "").explain("formatted")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan  # tells rows alone in their group, before the exchange
    inputs = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert sum("row#" in columns for columns in inputs) == 1


def test_simhashes_on_the_ring_propose_pairs(spark, make_docs, monkeypatch):
    """Pairs within two bits come from the pigeonring; those further apart, from shared shingles; both are checked."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(4000)]
    rows = []
    for i in range(40):
        text = rng.choices(words, k=900)
        rows += [(i, " ".join(text)), (100 + i, " ".join(text) + " end"), (200 + i, " ".join([*text[:850], *rng.choices(words, k=30)]))]
    proposed = []
    linked = similar.linked
    monkeypatch.setattr(similar, "linked", lambda nodes, *rest: (proposed.append((nodes.collect(), rest[-1].collect())), linked(nodes, *rest))[1])
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs([(i, t, "en", "s") for i, t in rows]), "").collect()}
    assert kept == plain_kept(rows) == set(range(40))
    nodes, pairs = proposed[0]
    heads = {}
    for r in sorted(nodes, key=lambda r: r.node):
        heads.setdefault(r.sketch[0], r.node)
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    want = {frozenset((heads[a], heads[b])) for a in heads for b in heads if a < b and apart(a, b) <= 2}
    want |= {frozenset((r.node, heads[r.sketch[0]])) for r in nodes if r.node != heads[r.sketch[0]]}
    assert len(want) > 10 and want == {frozenset(p) for p in map(tuple, pairs)}


def pulled_apart(words):
    """Two texts whose common start leaves every bit of a SimHash undecided, and whose few last words decide it in two ways."""

    def ones(text):
        hashes = shingle_set(" ".join(text), 5)
        return 2 * np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0).astype(int) - len(hashes)

    def grown(text, count, cost):
        for _ in range(count):
            total = ones(text)
            text = [*text, min(words, key=lambda w: cost(total + ones([*text[-4:], w])))]
        return text

    start = grown(words[:8], 76, lambda n: (n**2).sum())
    return " ".join(grown(start, 9, lambda n: -np.minimum(n, 2).sum())), " ".join(grown(start, 9, lambda n: np.maximum(n, -1).sum()))


def test_near_copies_whose_simhashes_are_far_apart(spark, make_docs):
    one, two = pulled_apart([f"w{i}" for i in range(300)])
    prints = [similar.simhash(shingle_set(text, 5)) for text in (one, two)]
    assert ((prints[0] ^ prints[1]) & (1 << 64) - 1).bit_count() > 40
    rows = [(1, one), (2, two), (3, "another text of a few words"), (4, one[: len(one) // 2])]
    assert plain_kept(rows) == {1, 3, 4}
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, make_docs([(i, t, "en", "s") for i, t in rows]), "").collect()} == {1, 3, 4}
