"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_number(payload: str, key: str) -> Column:
    """A number inside a JSON string: blanks, 'None' and text give NULL, a decimal comma counts as a point."""
    text = F.trim(F.get_json_object(payload, f"$['{key}']"))
    number = F.regexp_replace(F.when(~text.isin("", "None"), text), ",", ".")
    return F.when(number.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), number.cast("double"))


def safe_ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else NULL."""
    return F.when(d > 0, n / d)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def event_key(station: str, window: str, minute: str) -> Column:
    """Text key station|window|time."""
    return F.concat_ws("|", F.col(station), F.col(window).cast("string"), F.date_format(F.timestamp_seconds(F.col(minute) * 60), "yyyy-MM-dd'T'HH:mm:ss"))


def repaired_text(c: str) -> Column:
    """Undo UTF-8 read as Latin-1 where that is what happened; NULL becomes 'Unknown'."""
    latin = ~F.col(c).rlike("[^\\u0000-\\u00ff]")
    again = F.decode(F.encode(F.when(latin & F.col(c).rlike("[\\u00c2-\\u00f4][\\u0080-\\u00bf]"), F.col(c)), "ISO-8859-1"), "UTF-8")
    return F.coalesce(F.when(~F.contains(again, F.lit("�")), again), F.col(c), F.lit("Unknown"))


def scale_label(window: str) -> Column:
    """'30 min', '6 h'."""
    w = F.col(window)
    return F.when(w < 60, F.concat(w.cast("string"), F.lit(" min"))).otherwise(F.concat((w / 60).cast("int").cast("string"), F.lit(" h")))
