"""Generic parsing of answers: values as the plain regex chain gives them, each regex in the plan once."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from auditlake.functions import text as X
from auditlake.operators import extraction as E

ENDS = ["", " ", "\n", "\r\n", "\u0085", " \u2028", " \u2029 ", "*", "# ", " *END_VOTE*", "\u212a", "```", "\x1f"]
STARTS = ["", " ", "\"", "<think>x</think>", "</THINK>", "<b>", "```\n", "\u201c", "\u00a0"]


def plain_preprocess(t):
    for tag in ("thinking", "think", "reasoning", "reflection"):
        t = F.regexp_replace(t, rf"(?is)<{tag}>.*?</{tag}>", "")
    for tag in ("thinking", "think"):
        t = F.regexp_replace(t, rf"(?is)<{tag}>.*$", "")
    t = F.regexp_replace(t, r"(?i)</?(?:thinking|think|reasoning|reflection)>", "")
    return X.strip_spaces(F.regexp_replace(X.strip_first_last_fence(X.normalize_unicode(t)), r"\r\n?", "\n"))


def plain_value(text, pattern):
    found = F.regexp_replace(X.strip_spaces(F.regexp_extract(text, pattern, 1)), r"(?is)\*?END[_A-Z]*.*$", "")
    found = X.strip_spaces(F.regexp_replace(found, r"[*#]+\s*$", ""))
    return F.nullif(F.regexp_replace(found, r"^\"(.*)\"$", "$1"), F.lit(""))


def test_values_are_those_of_the_plain_chain(spark):
    inner = ["Vote: {}REAL{}", "**VOTE**: {}x{}\n*CONFIDENCE: 5", "vote = {}\"a\"{}", "{}{}", "vote: {} {}"]
    texts = [form.format(a, b) for form, a, b in itertools.product(inner, STARTS, ENDS)]
    texts += [a + t + b for t in texts[::7] for a, b in itertools.product(STARTS, ENDS)]
    frame = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").repartition(4)
    pairs = [(X.preprocess("text"), plain_preprocess(F.col("text")))]
    pairs += [(E._marked_value(F.col("text"), p("vote")), plain_value(F.col("text"), p("vote"))) for p in (E.marker_pattern, E.inline_pattern)]
    for got, want in pairs:
        wrong = frame.select("text", got.alias("got"), want.alias("want")).where("not got <=> want")
        assert wrong.collect() == []


def test_each_regex_is_in_the_plan_once(spark):
    frame = spark.createDataFrame([(1, "Vote: REAL")], "id int, text string")
    plan = E.parse_generic(frame, E.VOTE_FIELDS, ["vote"])._jdf.queryExecution().optimizedPlan().toString()
    tries = 2 * sum(map(len, E.VOTE_FIELDS.values()))
    json = 2  # the JSON object: in a branch, where nullif reads it twice
    assert plan.lower().count("regexp_extract(") == tries + json
