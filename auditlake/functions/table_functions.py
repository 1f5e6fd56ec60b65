"""Extraction jobs as SQL table functions: drafts and votes out of a table of answers.

``SELECT * FROM extract_drafts(TABLE(answers))`` and ``extract_votes(TABLE(answers))`` give the rows of
``operators.extraction`` for any table with a string column ``text``; its other columns come first. The
input keeps its partitions, so a call adds no exchange; PARTITION BY is allowed and changes no row. Rows
go through Python in pickled batches (Arrow functions that analyze their input build a frame per row); DataFrame
code is better off with the operators, which stay on the JVM.

A null text is an empty one, but for ``needs_cleanup``, which is null. JSON must be strict here (the operators also take single quotes), and nested
values come out as compact JSON. A column named like one of the result is a plain error of analysis.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DataType, IntegerType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from auditlake.functions import text as X
from auditlake.operators import extraction as E

DRAFT_COLUMNS = {
    "none_phrase": BooleanType(), "parse_status": StringType(), "draft_no": IntegerType(), "title": StringType(),
    "type": StringType(), "severity": StringType(), "line": IntegerType(), "snippet": StringType(), "reason": StringType(),
}
VOTE_COLUMNS = {
    "decision": StringType(), "confidence": IntegerType(), "reasoning": StringType(), "attack_scenario": StringType(),
    "parse_success": BooleanType(), "format_detected": StringType(), "needs_cleanup": BooleanType(),
}
# What a dot and a dollar sign leave to line ends differs between the two regex dialects.
_LINE = r"[^\n\r\x85\u2028\u2029]"
_DECISIONS = (
    ("FALSE_POSITIVE", ("FALSE_POSITIVE", "FALSE POSITIVE")), ("REAL", ("REAL",)),
    ("NEEDS_VERIFIED", ("NEEDS_VERIFIED", "NEEDS VERIFIED")), ("WEAKNESS", ("WEAKNESS",)),
)
_LOOK_ALIKES = str.maketrans(X.UNICODE_FROM, X.UNICODE_TO)
_ASCII_SPACE = " \t\n\v\f\r"


@lru_cache(maxsize=None)
def _pattern(pattern: str) -> re.Pattern:
    """A pattern of the JVM dialect, which knows ASCII classes and ends a text with a small z."""
    return re.compile(pattern.replace(r"\z", r"\Z"), re.ASCII)


def _sub(pattern: str, new: str, text: str) -> str:
    return _pattern(pattern).sub(new, text)


def _group(pattern: str, text: str) -> str:
    found = _pattern(pattern).search(text)
    return (found.group(1) or "") if found else ""


def _strip(text: str) -> str:
    """White space off both ends; the JVM's dollar sign also stands before one odd line end."""
    text = text.strip(_ASCII_SPACE)
    return text[:-1].rstrip(_ASCII_SPACE) + text[-1] if text[-1:] in ("\x85", "\u2028", "\u2029") else text


def _without_tags(text: str, names: tuple[str, ...], unclosed: bool) -> str:
    if "<" not in text:
        return text
    for name in names:
        text = _sub(rf"(?is)<{name}>.*?</{name}>", "", text)
        if not unclosed:
            text = _sub(rf"(?i)</?{name}>", "", text)
    if unclosed:
        for name in names[:2]:
            text = _sub(rf"(?is)<{name}>.*\z", "", text)
        text = _sub(rf"(?i)</?(?:{'|'.join(names)})>", "", text)
    return text


class _Number(str):
    """A number as it is written; inside nested values it is spelt anew."""


def _json(text: str):
    try:
        return json.loads(text, parse_int=_Number, parse_float=_Number, parse_constant=_Number)
    except ValueError:
        return None


def _compact(value) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{_compact(k)}:{_compact(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(_compact, value)) + "]"
    return json.dumps(json.loads(value) if isinstance(value, _Number) else value, ensure_ascii=False)


def _as_text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return _compact(value)


def _whole(text: str | None) -> int | None:
    """A 32-bit whole number, as a cast reads it."""
    if text is None or not re.fullmatch(r"[+-]?[0-9]+", _strip(text)):
        return None
    number = int(text)
    return number if -(2**31) <= number < 2**31 else None


def _first(values) -> str | None:
    return next((v for v in values if v), None)


# The patterns of an alias are written once: spelling them for every row costs more than matching them.
_draft_patterns = lru_cache(maxsize=None)(E.draft_field_patterns)
_END_MARKER = E.END_MARKER.replace("$", r"\z")


@lru_cache(maxsize=None)
def _marker_patterns(alias: str) -> tuple[str, str]:
    return E.marker_pattern(alias), E.inline_pattern(alias)


def _draft_field(section: str, low: str, aliases: list[str]) -> str | None:
    def clean(value: str) -> str:
        value = _strip(value)
        return _strip(_sub(_END_MARKER, "", value)) if "*" in value else value

    return _first(clean(_group(p, section)) for a in aliases if a in low for p in _draft_patterns(a))


def _marked_drafts(text: str) -> list[tuple]:
    found = []
    for section in _pattern(E.DRAFT_HEADER).split(text)[1:]:
        title = _strip(_pattern(E.FIELD_START).split(_strip(section))[0])
        title = _strip(_sub(r"\s*[*#\-]+\z", "", _sub(r"^[*#\-]+\s*", "", title)))
        if len(title) > 2:
            low = section.lower()
            own = {name: _draft_field(section, low, aliases) for name, aliases in E.DRAFT_FIELDS.items()}
            line = _whole(_group(r"(\d+)", own["line"] or ""))
            found.append((title, own["type"], own["severity"], line, own["snippet"], own["reason"]))
    return found


def _json_drafts(text: str) -> list[tuple] | None:
    tries = [text] if text.startswith("[") else []
    tries += [_sub(r",\s*([}\]])", r"\1", _group(p, text)) for p in (E.JSON_BLOCK, E.JSON_ARRAY, E.JSON_FINDINGS)]
    items = next((a for a in map(_json, tries) if isinstance(a, list) and all(m is None or isinstance(m, dict) for m in a)), None)
    if items is None:
        return None
    found = []
    for item in items:
        if item is not None:
            get = {
                name: next((v for v in (_as_text(item.get(a)) for a in aliases) if v is not None), default)
                for name, (aliases, default) in E.DRAFT_JSON_FIELDS.items()
            }
            if get["title"] not in ("", "Unknown"):
                found.append((get["title"], get["type"], get["severity"], _whole(get["line"]), get["snippet"], get["reason"]))
    return found


def _loose_drafts(text: str) -> list[tuple]:
    if not any(word in text.lower() for word in E.LOOSE_WORDS):
        return []
    pairs = ((_strip(a), _whole(b)) for a, b in _pattern(E.LOOSE_FINDING).findall(text))
    return [(a, "Unknown", "Medium", b, "", "Extracted from unstructured response") for a, b in pairs if a and b and b > 0]


def _outer_fence_off(text: str) -> str:
    if text.startswith("```") and text.count("```") == 2:
        lines = text.split("\n")
        if _strip(lines[-1]) == "```":
            return "\n".join(lines[1:-1])
    return text


def drafts_of(text: str | None) -> list[tuple]:
    """Rows of one answer; one row with nulls when it holds no draft."""
    clean = _outer_fence_off(_strip(_without_tags(text or "", ("thinking", "think"), False)))
    low = clean.lower()
    if not text or any(phrase in low for phrase in E.NO_FINDINGS):
        return [(True, "none", *[None] * 7)]
    found = _marked_drafts(clean)
    status = "parsed"
    if not found:
        read = _json_drafts(clean)
        found = _loose_drafts(clean) if read is None else read
        status = "parsed" if found else "failed" if read is None else "none"
    return [(False, status, i, *draft) for i, draft in enumerate(found)] or [(False, status, *[None] * 7)]


def _inner_fence(text: str) -> str:
    """What lies between a fence at the start and the last closing one."""
    if not text.startswith("```"):
        return text
    lines = text.split("\n")
    close = max((i for i, line in enumerate(lines) if _strip(line) == "```"), default=0)
    return _strip("\n".join(lines[1:close])) if close > 0 else text


def _marker(text: str, low: str, aliases: list[str]) -> str | None:
    def clean(value: str) -> str:
        value = _strip(value)
        if "end" in value.lower():
            value = _sub(r"(?is)\*?END[_A-Z]*.*\z", "", value)
        if "*" in value or "#" in value:
            value = _sub(r"[*#]+\s*\z", "", value)
        value = _strip(value)
        return _sub(rf'^"({_LINE}*)"\Z', r"\1", value) if value.startswith('"') else value

    return _first(clean(_group(p, text)) for a in aliases if a in low for p in _marker_patterns(a))


def vote_of(text: str | None) -> tuple:
    """The one row of a vote answer."""
    t = _without_tags(text or "", ("thinking", "think", "reasoning", "reflection"), True)
    t = _inner_fence(_strip(t if t.isascii() else t.translate(_LOOK_ALIKES)))
    t = _strip(_sub(r"\r\n?", "\n", t) if "\r" in t else t)
    tries = [t] if t.startswith("{") else []
    tries += [_group(E.JSON_OBJECT, t)] if "{" in t else []
    obj = next((o for o in map(_json, tries) if isinstance(o, dict)), None)
    if obj is not None:
        by_key: dict = {}
        for key, value in obj.items():
            by_key.setdefault(key.lower(), _as_text(value))
        own = {name: next((by_key[a] for a in aliases if by_key.get(a) is not None), None) for name, aliases in E.VOTE_FIELDS.items()}
    else:
        low = t.lower()
        own = {name: _marker(t, low, aliases) for name, aliases in E.VOTE_FIELDS.items()}
    found = any(v is not None for v in own.values())
    up = (own["vote"] or "").upper()
    number = _group(r"(\d+)", own["confidence"] or "")
    confidence = min(100, int(number)) if number and int(number) < 2**63 else 50
    success = own["vote"] is not None
    return (
        next((name for name, words in _DECISIONS if any(w in up for w in words)), "ABSTAIN"), confidence,
        (own["reasoning"] or "") if found else "Failed to parse response", own["attack_scenario"] or "", success,
        "json" if obj is not None else "marker" if found else "unknown", None if text is None else not success and t != "",
    )


def _schema(table: AnalyzeArgument, columns: dict[str, DataType]) -> AnalyzeResult:
    if not table.isTable or "text" not in table.dataType.names:
        raise ValueError("give a TABLE(...) argument with a string column named text")
    own = StructType([f for f in table.dataType.fields if f.name != "text"])
    added = StructType([StructField(name, kind) for name, kind in columns.items()])
    clash = {f.name.lower() for f in own.fields} & {f.name.lower() for f in added.fields}
    if clash:
        raise ValueError(f"rename the columns {sorted(clash)}: the result has columns of these names")
    return AnalyzeResult(schema=StructType(own.fields + added.fields))


class ExtractDrafts:
    """Rows of ``extract_drafts(TABLE(answers))``."""

    @staticmethod
    def analyze(answers: AnalyzeArgument) -> AnalyzeResult:
        return _schema(answers, DRAFT_COLUMNS)

    def eval(self, answers: Row) -> Iterator[tuple]:
        kept = _kept(answers)
        for row in drafts_of(answers["text"]):
            yield kept + row


class ExtractVotes:
    """Rows of ``extract_votes(TABLE(answers))``."""

    @staticmethod
    def analyze(answers: AnalyzeArgument) -> AnalyzeResult:
        return _schema(answers, VOTE_COLUMNS)

    def eval(self, answers: Row) -> Iterator[tuple]:
        yield _kept(answers) + vote_of(answers["text"])


def _kept(row: Row) -> tuple:
    return tuple(value for name, value in zip(row.__fields__, row) if name != "text")


def register(spark: SparkSession) -> list[str]:
    """Name the table functions in the session."""
    functions = {"extract_drafts": ExtractDrafts, "extract_votes": ExtractVotes}
    for name, function in functions.items():
        spark.udtf.register(name, udtf(function, useArrow=False))
    return list(functions)
