"""Call chains to entries against breadth-first search, and on deep graphs."""

from __future__ import annotations

import random
from collections import deque

import pytest

from auditlake.operators.graph import entry_reach, nearest_entry


def plain(edges, entries):
    """(function, entry) -> depth, by a search from every entry that stops at others."""
    down = {}
    for u, v in edges:
        if u != v and v not in entries:
            down.setdefault(u, set()).add(v)
    out = {}
    for e in entries & {x for edge in edges for x in edge}:
        depth, todo = {e: 0}, deque([e])
        while todo:
            u = todo.popleft()
            for v in down.get(u, ()):
                if v not in depth:
                    depth[v] = depth[u] + 1
                    todo.append(v)
        out |= {(f, e): d for f, d in depth.items()}
    return out


def check(spark, edges, entries):
    frame = spark.createDataFrame(edges, "caller string, callee string")
    starts = spark.createDataFrame([(e,) for e in entries], "function string")
    want = plain([(u, v) for u, v in edges if u and v], set(entries))
    got = {(r.function, r.entry): r.depth for r in entry_reach(frame, starts).collect()}
    assert got == want
    rows = nearest_entry(frame, starts).collect()
    nearest = {}
    for (f, e), d in want.items():
        nearest[f] = min(nearest.get(f, (d, e)), (d, e))
    assert {r.function: (r.depth, r.entry) for r in rows} == nearest and len(rows) == len(nearest)
    for r in rows:
        callers = [u for u, v in edges if u and v == r.function and u != v and nearest.get(u) == (r.depth - 1, r.entry)]
        assert r.via == (min(callers) if r.depth else None)


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"f{i}" for i in range(40)]
    edges = [(rng.choice(names), rng.choice(names)) for _ in range(rng.choice([25, 45, 90]))]
    edges += [(f"c{i}", f"c{i + 1}") for i in range(9)] + [("c9", "c0"), ("c9", "f1"), (None, "f1"), ("f2", None)]
    check(spark, edges, rng.sample(names, 4) + ["nowhere"] + (["c4"] if seed % 2 else []))


def test_no_entries_and_no_edges(spark):
    check(spark, [("a", "b"), ("b", "a")], [])
    check(spark, [], ["a"])


def test_a_deep_cycle_and_a_hub(spark):
    """A circle of 10,000 functions that all call one hub, entered at one of them."""
    n = 10_000
    edges = [(i, (i + 1) % n) for i in range(n)] + [(i, n) for i in range(n)] + [(n + 1, 17), (n, n + 2)]
    frame = spark.createDataFrame(edges, "caller bigint, callee bigint")
    rows = entry_reach(frame, spark.createDataFrame([(n + 1,)], "function bigint")).collect()
    assert len(rows) == n + 3
    want = {(17 + k) % n: k + 1 for k in range(n)} | {n: 2, n + 1: 0, n + 2: 3}
    assert {r.function: r.depth for r in rows} == want


def test_edges_are_made_once(spark):
    """The edges may cost a pass over all texts."""
    made = spark.sparkContext.accumulator(0)

    def make(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e")], "caller string, callee string")
    starts = spark.createDataFrame([("a",)], "function string")
    rows = entry_reach(edges.mapInArrow(make, edges.schema), starts).collect()
    assert {(r.function, r.depth) for r in rows} == {("a", 0), ("b", 1), ("c", 1)} and made.value == 4
