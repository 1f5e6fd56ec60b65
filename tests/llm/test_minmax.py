"""Min-max hashing against all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest

from auditlake.llm import minmax
from auditlake.llm.common import components
from auditlake.llm.minmax import min_max, near_copies, parity_sketch, shingle_set, wide_apart, wide_parity

BLANKS = " \t\n\x0b\x0c\r"


def plain_set(text):
    words, word = [], ""
    for c in (text or "") + " ":
        if c in BLANKS:
            words += [word] if word else []
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return {tuple(words)} if len(words) == 1 else set(zip(words, words[1:]))


def plain(rows):
    """doc_id -> (n_shingles, component) by all pairs; ids are unique or null."""
    sets = [plain_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[top(i)] = top(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(top(i), []).append(doc_id)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [g for g in groups[top(i)] if g is not None]
        low = min(ids) if ids else None
        out.append((doc_id, len(sets[i]), low, doc_id == low))
    return out


def edited(rng, words, n):
    words = list(words)
    for at in rng.sample(range(len(words)), n):
        words[at] = f"new{rng.random()}"
    return " ".join(words)


def check(spark_docs, rows):
    got = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_copies(spark_docs).collect()]
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(plain(rows), key=key)


@pytest.mark.parametrize("seed", [0, 4])
def test_links_equal_all_pairs(make_docs, monkeypatch, seed):
    monkeypatch.setattr(minmax, "SHARE", 3)
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):  # groups with similarities around the bound, some linked in chains only
        words = rng.choices(vocab, k=rng.randint(20, 120))
        texts += [" ".join(words)] * rng.randint(0, 2)
        texts += [edited(rng, words, rng.randint(0, max(1, len(words) // 12))) for _ in range(8)]
    texts += ["", None, " \n", "one", "ONE", "One ", "two words", "Two  Words", "é É", "É é", "a b c", "A b\tc", "x " * 5000, "x " * 4000 + "y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows += [(None, texts[0]), (None, "only here"), (None, None)]
    check(make_docs([(i, t, "en", "s") for i, t in rows]), rows)


def test_many_copies_that_are_not_alike_among_themselves(make_docs, spark, monkeypatch):
    """Copies of one text with 5 of 60 words replaced: 0.8 alike with it and 0.7 among themselves."""
    rng = random.Random(2)
    words = [f"w{i}" for i in range(60)]
    rows = [(0, " ".join(words))] + [(i, edited(rng, words, 3 + i % 2)) for i in range(1, 600)]
    paired = []
    near = minmax.confirmed
    monkeypatch.setattr(minmax, "confirmed", lambda pairs, *rest: (paired.append(pairs.count()), near(pairs, *rest))[1])
    check(make_docs([(i, t, "en", "s") for i, t in rows]), rows)
    assert sum(paired) < 20 * len(rows)


def test_repeated_ids_and_empty_table(make_docs):
    docs = make_docs([(5, "same text here", "en", "s")] * 3 + [(2, "same text here", None, None)])
    assert sorted(map(tuple, near_copies(docs).collect())) == [(2, 2, 2, True)] + [(5, 2, 2, False)] * 3
    assert near_copies(make_docs([])).collect() == []


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, 150).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a))], rng.integers(0, 400, 30).astype(np.uint64)]))
        differ = int(np.bitwise_count((parity_sketch(a) ^ parity_sketch(b)).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(a, b))


def test_values_estimate_similarity():
    a = shingle_set(" ".join(f"w{i}" for i in range(1001)))
    b = shingle_set(" ".join(f"w{i}" for i in range(200, 1201)))
    alike = np.mean([np.mean(min_max(a ^ np.uint64(s)) == min_max(b ^ np.uint64(s))) for s in range(40)])
    assert len(a) == 1000 and abs(alike - 800 / 1200) < 0.04


def test_wide_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (600, 1000, 1030, 5000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: rng.integers(n // 2, n)], rng.integers(0, 1 << 63, n // 10).astype(np.uint64)])
        assert 64 * len(wide_parity(a)) >= n
        assert wide_apart(wide_parity(a), wide_parity(b)) <= len(np.setxor1d(a, b))
        assert wide_apart(wide_parity(a), wide_parity(a[: n // 2])) > n // 9 or n <= 1030
    assert not len(wide_parity(a[:512])) and wide_apart(wide_parity(a), wide_parity(a[:512])) == 0


def test_long_texts_that_share_half_are_told_apart_without_their_sets(make_docs, monkeypatch):
    """Sets of thousands of shingles fill fixed sketches, which then tell nothing; such pairs used to fetch whole sets."""
    rng = random.Random(9)
    shared = [f"w{i}" for i in range(3000)]
    rows = [(i, " ".join(shared + [f"v{i}_{k}" for k in range(2000 + rng.randint(0, 200))])) for i in range(8)]
    rows.append((90, rows[3][1] + " end"))
    paired = []
    near = minmax.confirmed
    monkeypatch.setattr(minmax, "confirmed", lambda pairs, *rest: (paired.append(pairs.count()), near(pairs, *rest))[1])
    check(make_docs([(i, t, "en", "s") for i, t in rows]), rows)
    assert 1 <= sum(paired) <= 2


def test_components_equal_union_find(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)] + [(i, 300) for i in range(270, 300)]
    links += [(rng.randint(400, 500), rng.randint(400, 500)) for _ in range(60)] + [(7, 7), (8, None)]
    root = {i: i for pair in links for i in pair if i is not None}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        if b is not None:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    linked = {i for a, b in links if b is not None and a != b for i in (a, b)}
    rng.shuffle(links)
    got = [tuple(r) for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()]
    assert sorted(got) == sorted((i, top(i)) for i in linked)


def test_crowds_meet_on_whole_sketches(make_docs, monkeypatch):
    # With one word of the sketch, pairs that only look alike there were made for all of a crowd: 1879998 on check_h.
    rng, plans, kept = random.Random(4), [], minmax.cut

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return kept(df)

    monkeypatch.setattr(minmax, "cut", seen)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, words, rng.randrange(2, 9))) for i in range(40)]
    got = near_copies(make_docs([(*r, None, None) for r in rows])).collect()
    assert sorted(tuple(r) for r in got) == sorted(plain(rows))
    meets = [line for plan in plans for line in plan.splitlines() if "Join Inner" in line and "own#" in line]
    assert meets and all(line.count("bit_count") == minmax.WORDS for line in meets)


def test_a_bit_set_takes_few_jobs(spark, monkeypatch):
    # It took a job for each shuffle partition, most of the time of op11 on check_h.
    changed = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in changed}
    contents = spark.range(3000).selectExpr("xxhash64(id) AS content")
    try:
        for k, v in changed.items():
            spark.conf.set(k, v)
        spark.sparkContext.setJobGroup("bit set", "bit set")
        bits = minmax._bit_set(contents, 1 << 22)
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("bit set")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    there = np.frombuffer(bits, np.uint8)
    own = contents.toPandas()["content"].to_numpy() & ((1 << 22) - 1)
    assert ((there[own >> 3] >> (own & 7)) & 1).all() and np.unpackbits(there).sum() == len(np.unique(own))
    assert 0 < len(jobs) < 20
