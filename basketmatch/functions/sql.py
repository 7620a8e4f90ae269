"""The scalar functions by name, for users who write SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession

from basketmatch.functions import match, text


def _quoted(value: str) -> str:
    escapes = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\t": "\\t", "\r": "\\r"}
    plain = "".join(escapes.get(c, c) for c in value)
    return "'" + plain.replace("\0", "\\u0000").replace("\x0b", "\\u000B") + "'"


def register_functions(spark: SparkSession) -> list[str]:
    """Create ``norm``, ``parse_item_text``, ``match_percentage`` and ``match_band``."""
    blanks = _quoted(text.BLANKS)
    bodies = {
        "norm(s STRING) RETURNS STRING": (
            f"translate(lower(btrim(s, {blanks})), "
            f"{_quoted(text.NORM_FROM)}, {_quoted(text.NORM_TO)})"
        ),
        "parse_item_text(s STRING) RETURNS ARRAY<STRING>": (
            "array_distinct(filter(transform("
            f"split(norm(s), {_quoted(text.SEPARATORS)}), p -> btrim(p, {blanks})), "
            "p -> p <> ''))"
        ),
        "match_percentage(have BIGINT, need BIGINT) RETURNS INT": (
            "CASE WHEN need > 0 THEN greatest(0, least(100, "
            "cast((200 * have + need) div (2 * need) AS INT))) ELSE 0 END"
        ),
        "match_band(percent INT) RETURNS STRING": (
            f"CASE WHEN percent >= {match.HIGH_FROM} THEN 'high' "
            f"WHEN percent >= {match.MEDIUM_FROM} THEN 'medium' ELSE 'low' END"
        ),
    }
    for signature, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURN {body}")
    return [signature.split("(")[0] for signature in bodies]
