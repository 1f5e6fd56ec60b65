"""Alerts meet subscriptions by event and rank; a repeated run sends the ids it sent before."""

from __future__ import annotations

import json
import random

from pyspark.sql import functions as F

from auditlake.functions.scalars import SEVERITY_RANK
from auditlake.operators.joins import matching_subscriptions
from auditlake.sources import sinks as K

HOOKS = [
    (1, ["finding", "finding", "scan_complete"], "high", True), (2, ["finding"], None, True), (3, ["finding"], "odd", True),
    (4, ["scan_complete"], "CRITICAL", True), (5, ["finding"], "INFO", False), (6, None, "LOW", True), (7, [], "LOW", True), (8, ["finding", None], "CRITICAL", True),
]


def rank(severity):
    return SEVERITY_RANK.get((severity or "LOW").upper(), 0)


def test_matches_equal_a_plain_pass(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["finding"] * 8 + ["scan_complete", "other", None]), rng.choice(["critical", "High", "low", "strange", None])) for i in range(400)]
    rows += rows[:20]
    alerts = spark.createDataFrame(rows, "id int, event string, severity string").withColumn("tags", F.create_map(F.lit("a"), F.lit(1)))
    hooks = spark.createDataFrame(HOOKS, "webhook_id int, events array<string>, min_severity string, enabled boolean")
    got = matching_subscriptions(alerts, hooks)
    want = sorted(
        (i, event, hook) for i, event, severity in rows for hook, events, least, on in HOOKS
        if on and events and event is not None and event in events and (event != "finding" or rank(severity) >= rank(least))
    )
    assert sorted((r.id, r.event, r.webhook_id) for r in got.collect()) == want and "tags" in got.columns
    assert matching_subscriptions(alerts.limit(0), hooks).count() == 0 == matching_subscriptions(alerts, hooks.limit(0)).count()


def test_ids_repeat_with_their_run(spark, tmp_path):
    findings = spark.createDataFrame([(1, 7, "t", "s", "HIGH"), (2, 7, "u", None, "LOW"), (2, None, "u", None, "LOW")], "finding_id bigint, scan_id bigint, title string, snippet string, severity string")
    hooks = spark.createDataFrame(HOOKS[:3], "webhook_id int, events array<string>, min_severity string, enabled boolean")
    ids = lambda run: sorted((r.delivery_id, json.loads(r.payload)["delivery_id"]) for r in K.alert_payloads(findings, hooks, "k", run).collect())
    first = ids("1")
    assert first == ids("1") and all(a == b for a, b in first) and len(set(first)) == len(first) == 7
    assert not {a for a, _ in first} & {a for a, _ in ids("2")}
    K.deliver(K.alert_payloads(findings, hooks, "k", "1"), lambda payload, signature: 200, str(tmp_path / "out"))
    assert sorted(r.delivery_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [a for a, _ in first]
