from __future__ import annotations

import math
import random
import re
from collections import defaultdict

from auditlake.llm.mixing import mix, sainte_lague, targets


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        share = {s: 3.0 * sizes[s] if s in full else weight[s] * rest / free for s in order}
        above = {s for s in order if s not in full and share[s] > 3 * sizes[s]}
        if not above:
            return share
        full |= above


def plain_seats(weights, total):
    seats = dict.fromkeys(weights, 0)
    for _ in range(total):
        best = max(weights, key=lambda k: (weights[k] / (2 * seats[k] + 1), -k))
        seats[best] += 1
    return seats


def test_targets_and_seats(spark):
    rng = random.Random(2)
    for sizes in [{"a": 10, "b": 1000, "c": 5, None: 40}, {f"s{i}": rng.randint(1, 10**6) for i in range(40)}, {"a": 7}, {"a": 0, "b": 9}]:
        frame = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size bigint")
        got = {r.source: r.target for r in targets(frame).collect()}
        want = plain_targets(sizes)
        assert all(abs(got[s] - want[s]) <= 1e-9 * max(1, want[s]) for s in sizes)
    for weights, total in [({i: rng.random() for i in range(30)}, 200), ({1: 1.0, 2: 1.0, 3: 1.0}, 4), ({1: 5.0, 2: 1.0}, 3), ({1: 0.0, 2: 2.0}, 7)]:
        frame = spark.createDataFrame(list(weights.items()), "id bigint, w double")
        got = {r.id: r.quota for r in sainte_lague(frame, "w", total, ["id"]).collect()}
        assert got == plain_seats(weights, total)


def test_mix(spark, make_docs):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 400)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(900)]
    rows += [(None, None, None, None), (5000, "w " * 60_000, "en", "d"), rows[3], rows[3]]
    for shard in (1_000_000, 5_000):
        got = mix(make_docs(rows), shard=shard).collect()
        assert len(got) == len(rows)
        sizes, taken, target = defaultdict(int), defaultdict(int), {}
        for r in got:
            assert 0 <= r.taken <= 3 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
        want = defaultdict(int)
        for _, t, _, s in rows:
            want[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        assert sizes == want and all(r.source_size == want[r.source] for r in got)
        for s, share in plain_targets(want).items():
            assert abs(target[s] - share) < 1e-6 * share
            assert abs(taken[s] - share) <= 64 * (2 + 2 * math.sqrt(sum(want.values()) / shard))
        again = mix(make_docs(rows[::-1]).repartition(7), shard=shard).collect()
        assert sorted(map(repr, got)) == sorted(map(repr, again))
    assert mix(make_docs(rows).limit(0)).collect() == []
    assert [r.taken for r in mix(make_docs([(1, None, None, None), (2, "", "en", "a")])).collect()] == [0, 0]


def test_rows_without_an_id_and_equal_rows_are_spread(spark, make_docs, monkeypatch):
    rng = random.Random(8)
    rows = [(None, " ".join(["w"] * rng.randint(1, 80)) + f" {i}", "en", "a") for i in range(400)]
    rows += [(7, f"one id {i}", "en", "b") for i in range(200)] + [(i, "x y z", "en", "c") for i in range(200)] + [(None, "again and again", "en", "d")] * 300
    docs = make_docs(rows)
    monkeypatch.setattr("auditlake.llm.mixing.COPIES", 64)
    got = mix(docs, shard=2_000).collect()
    assert sorted((r.doc_id or -1, r.source, r.size) for r in got) == sorted((i or -1, s, len(t.split())) for i, t, _, s in rows)
    assert len({r.draw for r in got if r.source in "ab"}) == 600
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    shards = -(-sum(r.size for r in got) // 2_000)
    assert all(abs(taken[s] - t) <= 64 * (2 + shards) for s, t in target.items())
    again = mix(make_docs(rows[::-1]).repartition(7), shard=2_000).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))
