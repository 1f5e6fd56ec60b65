"""SQL-visible functions: scalar rules as SQL expressions (``table_functions`` has the extraction jobs)."""

from __future__ import annotations

from pyspark.sql import SparkSession

from auditlake.functions import scalars as S
from auditlake.functions import text as X
from auditlake.operators import tuning as T


def _expressions() -> dict[str, tuple[list[str], str, str]]:
    return {
        "normalize_severity": (["value STRING"], "STRING", _case_severity()),
        "parse_cvss": (
            ["value STRING"],
            "DOUBLE",
            "CASE WHEN try_cast(trim(value) AS DOUBLE) BETWEEN 0 AND 10 THEN try_cast(trim(value) AS DOUBLE) "
            r"WHEN try_cast(regexp_extract(value, r'(\d+\.?\d*)', 1) AS DOUBLE) BETWEEN 0 AND 10 "
            r"THEN try_cast(regexp_extract(value, r'(\d+\.?\d*)', 1) AS DOUBLE) END",
        ),
        "classify_error": (
            ["message STRING"],
            "STRING",
            "CASE "
            + " ".join(
                "WHEN " + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + f" THEN '{name}'"
                for name, words in S.ERROR_CLASSES
            )
            + " ELSE 'unknown' END",
        ),
        "vote_decision": (
            ["value STRING"],
            "STRING",
            "CASE WHEN upper(value) rlike 'FALSE[_ ]POSITIVE' THEN 'FALSE_POSITIVE' WHEN contains(upper(value), 'REAL') THEN 'REAL' "
            "WHEN upper(value) rlike 'NEEDS[_ ]VERIFIED' THEN 'NEEDS_VERIFIED' WHEN contains(upper(value), 'WEAKNESS') THEN 'WEAKNESS' "
            "ELSE 'ABSTAIN' END",
        ),
        "vote_correct": (
            ["predicted STRING", "truth STRING"],
            "BOOLEAN",
            "coalesce(upper(trim(predicted)) = upper(trim(truth)) OR (upper(trim(predicted)) IN ({n}) AND upper(trim(truth)) IN ({n})), false)".format(
                n=", ".join(f"'{v}'" for v in T.NOT_EXPLOITABLE)
            ),
        ),
        "is_malicious": (
            ["value STRING"],
            "BOOLEAN",
            "value rlike r\"(?i)"
            + "|".join(f"(?:{p})" for ps in X.MALICIOUS_PATTERNS.values() for p in ps).replace('"', r"\x22")
            + '"',
        ),
    }


def _case_severity() -> str:
    clean = r"lower(trim(regexp_replace(regexp_replace(trim(value), r'[*#\-_]+', ''), r'\s*\(.*\)$', '')))"
    exact = " ".join(f"WHEN {clean} = '{w}' THEN '{n}'" for w, n in S.SEVERITY_WORDS.items())
    partial = " ".join(f"WHEN contains({clean}, '{w}') THEN '{n}'" for w, n in S.SEVERITY_WORDS.items())
    return f"CASE WHEN value IS NULL OR value = '' THEN 'Medium' {exact} {partial} ELSE 'Medium' END"


def register(spark: SparkSession) -> list[str]:
    """Create the functions in the session; they inline into plans and stay on the JVM."""
    names = []
    for name, (args, result, body) in _expressions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(args)}) RETURNS {result} RETURN {body}")
        names.append(name)
    return names
