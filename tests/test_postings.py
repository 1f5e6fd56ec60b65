"""Searches through the gram index give the lines of the full scan."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditlake.operators import postings as O
from auditlake.operators.search import search_code

PATTERNS = [
    r"malloc", r"\bfn_aa\b", r"(?i)MALLOC\s*\(", r"fre*e", r"fre+e", r"a|malloc", r"x(free|malloc)y", r"ab", r"[a-z]{3}", r"é\.ß", r"fr[\]e]ee",
    r"\x66ree", r"nothing_like_this", r"fre{1,2}e", r"^free\(.*\)$", r"(?:free)?mall", r"\Qfree(\E", r"(?x) free", r"\p{Lu}ree", "o\tl",
]


@pytest.fixture(scope="module")
def files(spark):
    rng = random.Random(5)
    words = ["malloc", "Malloc(", "free", "free(p)", "fn_aa", "fn_aab", "xfreey", "é.ß", "fre", "freee", "ab", "o\tl", "\n", "\n", "  ", "😀malloc"]
    rows = [(i, "".join(rng.choice(words) + rng.choice(["", " "]) for _ in range(rng.randint(0, 12)))) for i in range(150)]
    long = "pad " * 30000 + "malloc" + " pad" * 100
    rows += [(None, "free"), (None, "x\nfn_aa"), (3, "malloc twice"), (900, ""), (901, None), (902, long), (903, "y" * (O.BLOCK - 3) + "malloc")]
    return spark.createDataFrame(rows, "file_id bigint, content string")


@pytest.fixture(scope="module")
def index(files, tmp_path_factory):
    return O.build_index(files, str(tmp_path_factory.mktemp("index") / "i"), parts=4, buckets=4)


def told(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.mark.parametrize("pattern", PATTERNS)
def test_same_lines_as_the_scan(spark, files, index, pattern):
    assert told(O.search_index(spark, index, pattern)) == told(search_code(files, pattern, None))


def test_what_is_read(spark, files, index):
    assert O.required_grams(r"\bfn_aa\b") == ["_aa", "fn_", "n_a"]
    assert O.required_grams("fre*e") == [] and O.required_grams("a+bcd") == ["bcd"] and O.required_grams("(?i)ABC") == ["abc"]
    few = O.candidates(spark, index, O.required_grams("fn_aab"))
    met, held = ({r.file_id for r in df.collect()} for df in (few, search_code(files, "fn_aab", None)))
    assert held <= met and len(met) < len(held) + 20 < files.count()
    assert O.candidates(spark, index, ["zzz", "fre"]).count() == 0
    plan = O.search_index(spark, index, "fn_aab")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan and "In(gram" in plan


def test_empty_table(spark, files, tmp_path):
    path = O.build_index(files.limit(0), str(tmp_path / "none"))
    assert O.search_index(spark, path, "free").count() == 0


@given(st.lists(st.sampled_from(["abc", "d", "(e|f)", "[gh]", r"\(", "+", "*", "?", "{2}", ".", r"\w", "ij", "(?:kl)"]), max_size=8).map("".join))
@settings(max_examples=300, deadline=None)
def test_grams_are_in_every_match(pattern):
    import re

    try:
        compiled = re.compile(pattern)
    except re.error:
        return
    rng = random.Random(pattern)
    grams = O.required_grams(pattern)
    for _ in range(60):
        text = "".join(rng.choice(["abc", "d", "e", "f", "g", "(", "ij", "kl", "ab", "c", "j"]) for _ in range(12))
        found = compiled.search(text)
        if found:
            assert all(g in found.group().lower() for g in grams)


def test_single_short_texts_need_no_aggregate(spark, monkeypatch):
    """Postings of repeated ids and long texts are made distinct across rows; those of others are so in their row."""
    monkeypatch.setattr(O, "BLOCK", 8)
    rows = [(1, "abcabc"), (2, "abcd"), (2, "bcde"), (None, "xyz"), (None, "xyzw"), (3, "abcabcabcabc\nabcabc"), (4, None), (5, ""), (6, "ABCD")]
    files = spark.createDataFrame(rows, "file_id int, content string")
    grams = O._grams(files)
    got = [tuple(r) for r in grams.collect()]
    low = [(i, t.lower()) for i, t in rows if t]
    want = {(i, line[k : k + 3]) for i, t in low for line in t.split("\n") for k in range(len(line) - 2)}
    assert len(got) == len(set(got)) and set(got) == want
    plan = grams._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Union")  # the distinct step is over one of the two sides
