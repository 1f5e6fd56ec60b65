"""Hot groups, ranges, products and plan shapes."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditlake.operators import joins as J, ordering as O, rules as R, sampling as SA, scale, search as Q, tuning
from auditlake.operators.scale import exact_row_number, first_n, paired_with_each


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def hot_rows(n=600, seed=3):
    rng = random.Random(seed)
    return [("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 9)}", i, rng.random() < 0.7) for i in range(n)]


def test_exact_row_number_over_a_hot_key(spark):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "k string, id bigint, failed boolean").repartition(7)
    got = {(r.k, r.id): r.rn for r in exact_row_number(df, ["k"], ["id"]).collect()}
    want, seen = {}, {}
    for k, i, _ in rows:
        seen[k] = seen.get(k, 0) + 1
        want[(k, i)] = seen[k]
    assert got == want


@pytest.mark.parametrize("success", [0.0, 0.02, 0.3, 1.0])
def test_streaks_span_ranges(spark, success):
    rng = random.Random(11)
    rows = [("hot" if rng.random() < 0.7 else f"k{i % 5}", i, rng.random() >= success) for i in range(500)]
    before = spark.createDataFrame([("hot", 3)], "k string, tail bigint")
    df = spark.createDataFrame(rows, "k string, id bigint, failed boolean").repartition(5)
    got = {r.id: r.streak for r in O.error_streaks(df, ["k"], ["id"], F.col("failed"), before).collect()}
    want, current = {}, {"hot": 3}
    for k, i, failed in rows:
        current[k] = current.get(k, 0) + 1 if failed else 0
        want[i] = current[k]
    assert got == want


def test_product_in_blocks_equals_product(spark):
    large, small = spark.range(13).toDF("a"), spark.range(9).toDF("b")
    want = {(a, b) for a in range(13) for b in range(9)}
    for limit in (4, 100):
        got = [(r.a, r.s.b) for r in paired_with_each(large, small, "s", limit).collect()]
        assert len(got) == len(want) and set(got) == want


def test_unique_names(spark):
    new = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, "a")], "draft_id bigint, name string")
    old = spark.createDataFrame([("b",)], "name string")
    got = {r.draft_id: r.unique_name for r in SA.unique_names(new, old).collect()}
    assert got == {1: "a", 2: "a_1", 3: "b_1", 4: "a_2"}


def test_top_n_is_cut_before_the_shuffle(spark):
    df = spark.createDataFrame(hot_rows(), "k string, id bigint, failed boolean")
    text = plan(first_n(df, ["k"], [F.col("id")], 3))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_no_cartesian_product(spark):
    chunks = spark.createDataFrame([(1, 1, 0, 1, 9)], "file_id bigint, chunk_id bigint, chunk_index int, start_line int, end_line int")
    found = spark.createDataFrame([(7, 1, 4)], "finding_id bigint, file_id bigint, line_number int")
    text = plan(J.enclosing_chunk(found, chunks))
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    files = spark.createDataFrame([(1, "a/x.c", "gets(x)")], "file_id bigint, file_path string, content string")
    text = plan(R.rule_candidates(files, R.rule_table(spark)))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_source_chains_and_circles(spark):
    rows = [(0, None), (1, 0), (2, 1), (3, 2), (4, 5), (5, 4), (6, 99)]
    got = {r.scan_id: (r.root_scan_id, r.hops) for r in J.resolve_sources(spark.createDataFrame(rows, "scan_id bigint, source_scan_id bigint")).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 2: (0, 2), 3: (0, 3), 4: (None, None), 5: (None, None), 6: (6, 0)}


def test_categories_keep_every_finding(spark):
    categories = spark.createDataFrame(
        [(1, "Overflow", "CWE-120", ["stack", "heap"]), (2, "Leak", None, ["memory", "leak", "code"])],
        "category_id int, name string, cwe_id string, keywords array<string>",
    )
    raw = [(1, "CWE-120 x"), (2, "a memory leakage"), (3, "code leak"), (4, None), (5, "Odd XSS")]
    found = spark.createDataFrame(raw, "finding_id int, raw_category string")
    got = {r.finding_id: (r.category, r.is_new) for r in J.match_categories(found, categories).collect()}
    assert got == {
        1: ("Overflow", False), 2: ("Leak", False), 3: ("code leak", True), 4: ("Unknown", False), 5: ("Odd XSS", True)
    }


def test_cached_results_keep_missing_values(spark):
    rows = [(1, "a", "x"), (2, "a", "x"), (3, None, "x"), (4, None, None)]
    requests = spark.createDataFrame(rows, "id int, analyzer string, content string")
    got = J.cached_results(requests, lambda once: once.withColumn("n", F.length("content")))
    assert sorted((r.id, r.n) for r in got.collect()) == [(1, 1), (2, 1), (3, 1), (4, None)]


def test_groups_of_a_case_have_tasks_by_rows(spark, monkeypatch):
    monkeypatch.setattr(scale, "ROWS_A_TASK", 100)
    results = spark.range(1000).selectExpr("id % 50 AS case_id", "concat('p', id % 3) AS prompt_id", "'REAL' AS predicted_vote", "true AS parse_success")
    cases = spark.range(50).selectExpr("id AS case_id", "if(id % 2 = 0, 'REAL', 'WEAKNESS') AS verdict")
    found = tuning.accuracy_by(tuning.judged_by_case(results, cases), "case_id", "prompt_id")
    plain = tuning.accuracy_by(tuning.judged(results, cases), "case_id", "prompt_id")
    assert found.rdd.getNumPartitions() == 10
    assert sorted(found.collect()) == sorted(plain.collect()) and found.count() == 150


def test_join_in_blocks_equals_the_join(spark, monkeypatch):
    """Hot, rare, null and one-sided keys, equal rows on both sides, empty sides."""
    monkeypatch.setattr(scale, "BLOCK", 16, raising=False)
    rng = random.Random(4)
    keys = ["hot"] * 6 + ["warm"] * 2 + [None, *(f"k{i}" for i in range(12))]
    left = spark.createDataFrame([(rng.choice(keys), rng.randint(0, 90)) for _ in range(500)] + [("left", 1)], "k string, a int").repartition(3)
    right = spark.createDataFrame([(rng.choice(keys), rng.randint(0, 90)) for _ in range(300)] + [("right", 1)], "k string, b int").repartition(2)
    for x, y in ((left, right), (right.withColumnRenamed("b", "c"), left), (left.limit(0), right), (left, right.limit(0))):
        found = scale.joined_in_blocks(x, y, "k")
        assert found.columns == x.join(y, "k").columns
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, x.join(y, "k").collect()))


def most_in_a_task(rows):
    return max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect())


def test_callers_of_a_hot_name_are_made_by_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(scale, "BLOCK", 32, raising=False)
    calls = spark.range(600).selectExpr("'hot' AS callee", "id AS file_id", "'f' AS function", "1 AS start_line", "CAST(id AS int) AS line_number")
    symbols = spark.range(800).selectExpr("'hot' AS name", "id % 400 AS file_id")
    rows = Q.callers(calls, symbols)
    assert rows.columns == ["callee", "target_file", "file_id", "function", "line_number"]
    assert rows.count() == 240_000 == rows.distinct().count()
    assert most_in_a_task(rows) < 24_000
