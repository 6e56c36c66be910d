"""The text algebra as SQL functions, so queries in SQL stay visible to the optimizer.

Each is a temporary SQL function with an expression body, not a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from textlake.functions import text as T


def _quoted(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bodies() -> dict[str, tuple[str, str, str]]:
    """name -> (parameter, return type, body)."""
    drop = _quoted(f"[{T.POINTS}{T.GERESH}{T.GERSHAYIM}'\"]")
    norm = f"lower(translate(regexp_replace(x, {drop}, ''), '{T.FINALS}', '{T.REGULAR}'))"
    prefix = f"regexp_replace(x, {_quoted(f'^[{T.PREFIXES}]{{1,2}}(?=[{T.LETTERS}]{{3,}}$)')}, '')"
    suffix = f"regexp_replace({prefix}, {_quoted('^(.{2,}?)(?:' + '|'.join(T.SUFFIXES) + ')$')}, '$1')"
    return {
        "strip_niqqud": ("x STRING", "STRING", f"regexp_replace(x, '[{T.POINTS}]', '')"),
        "normalize_token": ("x STRING", "STRING", norm),
        "light_stem": ("x STRING", "STRING", f"CASE WHEN x RLIKE '^[{T.LETTERS}]+$' THEN {suffix} ELSE x END"),
        "fold_form": ("x STRING", "STRING", "coalesce(nullif(translate(x, 'ויעא', ''), ''), x)"),
        "hebrew_tokens": ("x STRING", "ARRAY<STRING>", f"regexp_extract_all(x, {_quoted(T.TOKEN)}, 0)"),
    }


def register_sql_functions(spark: SparkSession, prefix: str = "tl_") -> list[str]:
    """Creates the functions in the session and returns their names."""
    out = []
    for name, (parameter, kind, body) in bodies().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameter}) RETURNS {kind} RETURN {body}")
        out.append(prefix + name)
    return out
