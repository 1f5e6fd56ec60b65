"""The SQL table functions give the rows of the extraction operators."""

from __future__ import annotations

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from auditlake.functions import table_functions as TF
from auditlake.operators import extraction as E

DRAFTS = [
    None, "", "   ", "no findings", "nothing here", "*DRAFT: A bug\n*TYPE: CWE-79\n*LINE: 12 of 3\n*REASON: x\ny\n*END_DRAFT*\n*DRAFT: ab",
    "## DRAFT: **Title** --\nSEVERITY: High\nline_number: 99999999999\n", "DRAFT: Überlauf é\n**CODE:** a\r\nb\n*END",
    "<think>DRAFT: hidden</think>DRAFT: shown one\nwhy: seen", "```json\n[{\"title\": \"T\", \"line\": 7, \"cwe\": \"x\",}]\n```",
    '[{"title": "n", "line": "8 ", "severity": null, "code": {"a": [1.50, "b"], "c": true}}, {"name": "Unknown"}]', "[{}]", "[1, 2]",
    'so {"findings": [{"finding": "f", "lineno": 3}]} end', "A Stack Overflow at line 12 and a Path Traversal on: 0", "issue Bug 3",
    "```\nDRAFT: fenced one\nTYPE: t\n```", "DRAFT:\nDRAFT: x\nDRAFT: long title\nRISK_LEVEL - none\nRISK: low", "draft:none", "[", "DRAFT: aaa" * 300,
    "DRAFT: pads \u00a0 \nREASON: \u2028 odd \u2029 ends \x85\n", "DRAFT: tab\t\n\tTYPE\t:\tv\n",
]
VOTES = [
    None, "", "  ", "VOTE: REAL\nCONFIDENCE: 85%\nREASONING: because\nof it", "**Verdict**: false positive\n**Certainty** - 7", "*VOTE*: weakness *END",
    '{"vote": "REAL", "Confidence": 0.90, "why": {"a": 1.50}}', 'x {"DECISION": "NEEDS VERIFIED", "decision": "REAL"} y', "{broken", "{}",
    "<reasoning>VOTE: REAL</reasoning> result = FALSE_POSITIVE", "<think>open VOTE: REAL", "```\nVOTE: REAL\n```\nend", "• vote → REAL\r\n• confidence → 120",
    "CONFIDENCE: 99999999999999999999\nvote: maybe", "why: \"quoted\"\n", "VOTE： REAL", "analysis:\n  spans\n\nlines\nVOTE: real ###", "score 5, vote=real, poc: a,b",
]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize(
    "texts, call, operator", [(DRAFTS, "extract_drafts", E.extract_drafts), (VOTES, "extract_votes", E.extract_votes)], ids=["drafts", "votes"]
)
def test_same_rows_as_the_operators(spark, texts, call, operator):
    TF.register(spark)
    answers = spark.createDataFrame(list(enumerate(texts)) * 2, "id int, text string").withColumn("tags", F.array(F.struct("id")))
    answers = answers.withColumn("at", F.timestamp_seconds("id"))
    got = spark.sql(f"SELECT * FROM {call}(TABLE({{a}}))", a=answers)
    want = operator(answers)
    assert got.columns == want.columns
    assert rows(got) == rows(want)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    if call == "extract_votes":
        assert rows(spark.sql(f"SELECT * FROM {call}(TABLE({{a}}) PARTITION BY id)", a=answers).select(got.columns)) == rows(want)


def test_bounds_of_a_call(spark):
    TF.register(spark)
    empty = spark.createDataFrame([], "id int, text string")
    assert spark.sql("SELECT * FROM extract_drafts(TABLE({a}))", a=empty).count() == 0
    for bad in (empty.drop("text"), empty.withColumn("Severity", F.lit(1))):
        with pytest.raises(AnalysisException):
            spark.sql("SELECT * FROM extract_drafts(TABLE({a}))", a=bad)
    joined = spark.sql(
        "SELECT parse_status, count(*) AS n FROM extract_drafts(TABLE({a})) WHERE id < 3 GROUP BY parse_status",
        a=spark.createDataFrame([(1, "no issues"), (2, None), (3, "x")], "id int, text string"),
    )
    assert rows(joined) == [("none", 2)]


def test_rows_pass_in_batches_of_rows(spark):
    """A function that analyzes its input and takes Arrow builds a frame for every row: four times the time of a parse."""
    TF.register(spark)
    answers = spark.createDataFrame([(1, "VOTE: REAL")], "id int, text string")
    for call in ("extract_drafts", "extract_votes"):
        plan = spark.sql(f"SELECT * FROM {call}(TABLE({{a}}))", a=answers)._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPythonUDTF" in plan and "ArrowEvalPythonUDTF" not in plan


@pytest.mark.parametrize("names, unclosed", [(("thinking", "think"), False), (("thinking", "think", "reasoning", "reflection"), True)])
def test_texts_without_a_tag_are_left_alone(names, unclosed):
    assert TF._without_tags("a > b think>", names, unclosed) == "a > b think>"
    assert TF._without_tags("a <THINK>b</THINK> c <think>d", names, unclosed).strip() == ("a  c" if unclosed else "a  c d")
