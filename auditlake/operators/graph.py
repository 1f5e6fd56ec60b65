"""Reachability in call graphs of any depth: chains are contracted, then entries search what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.session import cut


def _jumped(steps: DataFrame) -> DataFrame:
    """node, core, w of each step (node, parent, w): the first node above it that has no step itself.

    Pointers double in every turn, so a chain takes as many turns as its length has digits in base two.
    Nodes that only lead into a circle of steps have no such node and drop out.
    """
    nodes = steps.select(F.col("node").alias("parent"), F.lit(False).alias("end"))
    state = cut(steps.join(nodes, "parent", "left").select("node", "parent", "w", F.coalesce("end", F.lit(True)).alias("end")))
    for _ in range(state.count().bit_length() + 1):
        open_ = state.where("not end")
        if open_.isEmpty():
            break
        up = state.select(F.col("node").alias("parent"), F.col("parent").alias("above"), F.col("w").alias("more"), F.col("end").alias("ends"))
        moved = open_.join(up, "parent").select("node", F.col("above").alias("parent"), (F.col("w") + F.col("more")).alias("w"), F.col("ends").alias("end"))
        state = cut(state.where("end").unionByName(moved))
    return state.where("end").select("node", F.col("parent").alias("core"), "w")


def contracted(edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fold every function with a single caller into that caller, until there is none.

    ``edges`` (u, v) run from caller to callee, ``entries`` (node) are never folded and have no edges into
    them. Returns the edges between what is left as (u, v, w) with the length of the shortest chain each stands
    for, and (node, core, w) of the folded nodes: they are reached through ``core`` only, ``w`` calls later.
    """
    core = cut(edges.select("u", "v", F.lit(1).cast("bigint").alias("w")))
    folded = None
    while True:
        single = core.groupBy("v").agg(F.count(F.lit(1)).alias("callers"), F.min("u").alias("u"), F.min("w").alias("w")).where("callers = 1")
        steps = cut(single.select(F.col("v").alias("node"), F.col("u").alias("parent"), "w"))
        if steps.isEmpty():
            return core, folded if folded is not None else steps.withColumnRenamed("parent", "core")
        homes = _jumped(steps)
        # Callers that were folded call from their core; what leads from a circle that nothing enters goes.
        there = homes.select(F.col("node").alias("u"), "core", F.col("w").alias("more"), F.lit(True).alias("home"))
        gone = steps.select(F.col("node").alias("u"), F.lit(True).alias("step"))
        kept = core.join(steps.select(F.col("node").alias("v")), "v", "left_anti")
        moved = kept.join(there, "u", "left").join(gone, "u", "left").where("home or step is null")
        moved = moved.select(F.coalesce("core", "u").alias("u"), "v", (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")).where("u != v")
        core = cut(moved.groupBy("u", "v").agg(F.min("w").alias("w")))
        if folded is not None:
            later = homes.select(F.col("node").alias("core"), F.col("core").alias("next"), F.col("w").alias("more"))
            lost = steps.select(F.col("node").alias("core")).join(homes.select(F.col("node").alias("core")), "core", "left_anti")
            earlier = folded.join(lost, "core", "left_anti").join(later, "core", "left").select(
                "node", F.coalesce("next", "core").alias("core"), (F.col("w") + F.coalesce("more", F.lit(0))).alias("w")
            )
            homes = homes.unionByName(earlier)
        folded = cut(homes)


def _graph(edges: DataFrame, entries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls (u, v) that chains can take, entries (node) among the functions, and the entries' own rows."""
    # The edges may be a whole pass over texts: they are made once, and small after that.
    edges = cut(edges.select("caller", "callee").distinct())
    calls = edges.where("caller is not null and callee is not null and caller != callee").select(
        F.col("caller").alias("u"), F.col("callee").alias("v")
    )
    names = edges.select(F.col("caller").alias("node")).union(edges.select("callee")).where("node is not null").distinct()
    starts = cut(names.join(entries.select(F.col("function").alias("node")), "node", "left_semi"))
    # An entry ends its chain: nothing is followed into it.
    down = calls.join(starts.withColumnRenamed("node", "v"), "v", "left_anti")
    return cut(down), starts, calls


def _spread(core: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Least (depth, entry) of each ``keys`` by relaxing edges from the entries until nothing gets less."""
    best = cut(starts.select("node", F.col("node").alias("entry"), F.lit(0).cast("bigint").alias("depth")))
    front = best
    while True:
        step = front.join(core, front["node"] == core["u"]).select(
            F.col("v").alias("node"), "entry", (F.col("depth") + F.col("w")).alias("depth")
        )
        label = F.min(F.struct("depth", "entry")).alias("new")
        new = step.groupBy(*keys).agg(label).select(*keys, "new")
        old = best.select(*keys, F.struct("depth", "entry").alias("old"))
        less = new.join(old, keys, "left").where("old is null or new < old")
        front = cut(less.select("node" if "entry" in keys else keys[0], "new.entry", "new.depth"))
        if front.isEmpty():
            return best
        best = cut(best.join(front, keys, "left_anti").unionByName(front))


def entry_reach(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """function, entry, depth: every entry that reaches a function, with the length of the shortest call chain.

    ``edges`` are (caller, callee), ``entries`` (function). An entry ends its chains, so no chain passes through
    another one; it reaches itself at depth 0. Rows are one a (function, entry) pair, never a pair of
    functions: functions with one caller are folded into it, whatever the length of their chains, the
    others are searched from all entries at once. Circles are no matter; nulls and calls of a
    function by itself are ignored.
    """
    down, starts, _ = _graph(edges, entries)
    core, folded = contracted(down, starts)
    best = _spread(core, starts, ["node", "entry"])
    below = folded.join(best.withColumnRenamed("node", "core"), "core").select("node", "entry", (F.col("depth") + F.col("w")).alias("depth"))
    return best.unionByName(below).withColumnRenamed("node", "function")


def nearest_entry(edges: DataFrame, entries: DataFrame) -> DataFrame:
    """function, entry, depth, via of every function that an entry reaches, a row each.

    The nearest entry, of equally near ones the least; ``via`` is the least caller that is one step nearer to it
    (null for the entry itself), so following ``via`` gives the chain.
    """
    down, starts, _ = _graph(edges, entries)
    core, folded = contracted(down, starts)
    best = _spread(core, starts, ["node"])
    below = folded.join(best.withColumnRenamed("node", "core"), "core").select("node", "entry", (F.col("depth") + F.col("w")).alias("depth"))
    nearest = cut(best.unionByName(below))
    above = nearest.select(F.col("node").alias("u"), "entry", (F.col("depth") + 1).alias("depth"))
    via = down.join(above, "u").select(F.col("v").alias("node"), "entry", "depth", "u").groupBy("node", "entry", "depth").agg(F.min("u").alias("via"))
    return nearest.join(via, ["node", "entry", "depth"], "left").select(F.col("node").alias("function"), "entry", "depth", "via")
