"""Text stamps to instants: one regex alternation, range checks, integer day arithmetic.

Every notation is an alternative of ONE compiled expression with named groups.  ``regexp_replace`` evaluates it once
per value and writes the named components into a fixed order (groups of alternatives that did not match contribute
nothing), ``split`` takes them apart once, and everything after that is integer arithmetic on columns.
"""

from __future__ import annotations

from functools import cache
from zoneinfo import available_timezones

from pyspark.sql import Column
from pyspark.sql import functions as F

SEP = "\u0001"
DAY_MS = 86_400_000

#: Components in the order in which the replacement writes them, with the expression of each.
PARTS = {
    "Y": r"\d{4}", "y": r"\d{2}", "M": r"\d{1,2}", "B": r"\p{L}{3,10}", "J": r"\d{3}", "D": r"\d{1,2}",
    "a": r"\d{1,2}", "b": r"\d{1,2}", "H": r"\d{1,2}", "I": r"\d{2}", "S": r"\d{2}", "F": r"\d{1,9}",
    "P": r"[AaPp]\.?[Mm]\.?", "Z": r"[+\-]\d{2}(?::?\d{2})?|\p{L}{1,5}", "E": r"\d{9,10}|\d{12,13}|\d{15,16}",
}

#: The notations.  <X> is a component; the rest is a regular expression.
NOTATIONS = [
    r"<Y>[\-/]<M>[\-/]<D>[Tt ]\s*<H>:<I>(?::<S>(?:[.,]<F>)?)?\s*<Z>?",
    r"<Y>-<J>[Tt ]<H>:<I>(?::<S>(?:[.,]<F>)?)?\s*<Z>?",
    r"(?<Y>\d{4})(?<M>\d{2})(?<D>\d{2})[Tt ]?(?<H>\d{2})(?<I>\d{2})(?:(?<S>\d{2})(?:[.,](?<F>\d{1,9}))?)?\s*<Z>?",
    r"(?:\p{L}{2,10}\.?,?\s+)?<D>[ \-]<B>\.?[ \-]<Y>,?\s+<H>[:.]<I>(?:[:.]<S>(?:[.,]<F>)?)?(?:\s*<P>)?\s*<Z>?",
    r"<a>[/\-.]<b>[/\-.](?:<Y>|<y>),?\s+<H>:<I>(?::<S>(?:[.,]<F>)?)?(?:\s*<P>)?\s*<Z>?",
    r"<E>",
]

# Month names (English, Spanish) and zone abbreviations in minutes east of UTC.
MONTHS = {
    "january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8,
    "september": 9, "october": 10, "november": 11, "december": 12,
    "jan": 1, "feb": 2, "mar": 3, "apr": 4, "jun": 6, "jul": 7, "aug": 8, "sep": 9, "sept": 9, "oct": 10,
    "nov": 11, "dec": 12,
    "enero": 1, "febrero": 2, "marzo": 3, "abril": 4, "mayo": 5, "junio": 6, "julio": 7, "agosto": 8,
    "septiembre": 9, "setiembre": 9, "octubre": 10, "noviembre": 11, "diciembre": 12,
    "ene": 1, "abr": 4, "ago": 8, "set": 9, "dic": 12,
}
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "cest": 120, "eet": 120, "eest": 180,
    "msk": 180, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420,
}


@cache
def alternation() -> tuple[str, str]:
    """The compiled alternation and the replacement that writes the components in the order of PARTS."""
    seen: dict[str, list[str]] = {k: [] for k in PARTS}
    alternatives = []
    for n, text in enumerate(NOTATIONS):
        for k, expression in PARTS.items():
            name = f"{'l' if k.islower() else 'u'}{k}{n}"
            if f"<{k}>" in text:
                text = text.replace(f"(?<{k}>", f"(?<{name}>").replace(f"<{k}>?", f"(?<{name}>{expression})?")
                text = text.replace(f"<{k}>", f"(?<{name}>{expression})")
                seen[k].append(name)
        alternatives.append(text)
    replacement = SEP + SEP.join("".join(f"${{{name}}}" for name in seen[k]) for k in PARTS)
    return r"(?s)\A\s*(?:" + "|".join(alternatives) + r")\s*\z", replacement


def components(stamp: Column) -> Column:
    """Array of the components of PARTS after a leading empty string; of another length where no notation fits."""
    expression, replacement = alternation()
    clean = F.translate(stamp.cast("string"), SEP, "")
    return F.split(F.regexp_replace(clean, F.lit(expression), F.lit(replacement)), SEP)


def _lookup(table: dict[str, int], key: Column) -> Column:
    entries = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.try_element_at(entries, key)


def leap(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def local_stages(tag: str, parts: str, date_order: str) -> list[dict[str, Column]]:
    """Columns to add one stage after another, from the components in column ``parts``.

    The last ones are ``<tag>local`` (clock time in ms as if UTC, NULL if there is no such date or time), ``<tag>zoned``
    and ``<tag>offset`` (minutes east of UTC).  Stages keep every expression small: each uses columns of the one before.
    """
    keys = list(PARTS)
    col = lambda k: F.col(tag + k)
    name = {k: f"{'l' if k.islower() else 'u'}{k}" for k in keys}
    raw = lambda k: col(name[k])
    order = F.col(date_order)
    fits = F.size(parts) == len(keys) + 1
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    text = {tag + name[k]: F.when(fits, F.nullif(F.get(parts, F.lit(i + 1)), F.lit(""))) for i, k in enumerate(keys)}
    numbers = {tag + name[k]: raw(k).cast("bigint") for k in "YyMJDabHISE"}
    digits = F.rpad(F.regexp_replace(raw("Z"), r"\D", ""), 4, "0")
    stages = [
        text,
        numbers | {
            tag + "long": F.length(raw("E")), tag + "month": _lookup(MONTHS, F.lower(raw("B"))).cast("bigint"),
            tag + "half": F.lower(F.substring(raw("P"), 1, 1)), tag + "sign": F.substring(raw("Z"), 1, 1),
            tag + "east": F.substring(digits, 1, 2).cast("bigint"), tag + "past": F.substring(digits, 3, 2).cast("bigint"),
            tag + "named": _lookup(ABBREVIATIONS, F.lower(raw("Z"))).cast("bigint"),
            tag + "milli": F.coalesce(F.substring(F.rpad(raw("F"), 3, "0"), 1, 3).cast("bigint"), zero),
        },
        {
            tag + "year": F.coalesce(raw("Y"), raw("y") + F.when(raw("y") < 70, 2000).otherwise(1900)),
            tag + "month": F.coalesce(raw("M"), col("month"), F.when(order == "dmy", raw("b")).when(order == "mdy", raw("a"))),
            tag + "day": F.coalesce(raw("D"), F.when(order == "dmy", raw("a")).when(order == "mdy", raw("b"))),
            tag + "hour": F.when(col("half").isNull(), raw("H")).when(raw("H").between(1, 12), raw("H") % 12 + F.when(col("half") == "p", 12).otherwise(0)),
            tag + "second": F.coalesce(raw("S"), zero),
            tag + "epoch": F.when(col("long") <= 10, raw("E") * 1000).when(col("long") <= 13, raw("E")).otherwise(F.floor(raw("E") / 1000)),
            tag + "offset": F.when(raw("E").isNotNull(), zero)
            .when(col("sign").isin("+", "-"), F.when((col("east") <= 18) & (col("past") <= 59), (col("east") * 60 + col("past")) * F.when(col("sign") == "-", -1).otherwise(1)))
            .otherwise(col("named")),
            tag + "zoned": raw("E").isNotNull() | raw("Z").isNotNull(),
        },
        {tag + "leap": leap(col("year"))},
        {
            tag + "ok": F.when(raw("J").isNotNull(), raw("J").between(1, F.when(col("leap"), 366).otherwise(365))).otherwise(
                col("month").between(1, 12) & col("day").between(1, F.when(col("month") == 2, F.when(col("leap"), 29).otherwise(28)).when(col("month").isin(4, 6, 9, 11), 30).otherwise(31))
            ),
            tag + "month": F.when(raw("J").isNotNull(), one).otherwise(col("month")),
            tag + "day": F.when(raw("J").isNotNull(), raw("J")).otherwise(col("day")),
            tag + "clock": F.when(col("hour").between(0, 23) & raw("I").between(0, 59) & col("second").between(0, 59), (col("hour") * 60 + raw("I")) * 60_000 + col("second") * 1000 + col("milli")),
        },
        # days since 1970-01-01 of the proleptic Gregorian calendar: years from March, eras of 400 years
        {tag + "year": col("year") - (col("month") <= 2).cast("int"), tag + "of_year": F.expr(f"(153 * ({tag}month + if({tag}month > 2, -3, 9)) + 2) div 5 + {tag}day - 1")},
        {tag + "era": F.expr(f"{tag}year div 400"), tag + "of_era": col("year") % 400},
        {tag + "days": F.expr(f"{tag}era * 146097 + {tag}of_era * 365 + {tag}of_era div 4 - {tag}of_era div 100 + {tag}of_year - 719468")},
        {tag + "local": F.coalesce(col("epoch"), F.when(col("ok"), col("days") * DAY_MS + col("clock")))},
    ]
    return stages


def _offset(ms: Column, zone: Column) -> Column:
    """Milliseconds by which the zone's clock is ahead of UTC at an instant."""
    return F.unix_millis(F.from_utc_timestamp(F.timestamp_millis(ms), zone)) - ms


def known_zone(zone: Column) -> Column:
    """The zone's name, or NULL where it names none."""
    return F.when(F.trim(zone).isin(*sorted(available_timezones())), F.trim(zone))


def instant_stages(tag: str, zone: str) -> list[dict[str, Column]]:
    """From ``<tag>local``, ``<tag>zoned`` and ``<tag>offset`` to ``<tag>lo`` and ``<tag>hi``, the instants a stamp can mean.

    Both NULL: unreadable, or a clock time that a change of the clocks skips; ``hi`` NULL: one instant; else a repeated
    hour.  The offsets a day before and after a change are the two that a stamp near it can have; each is kept if the
    zone really has it at the instant it leads to.
    """
    col = lambda k: F.col(tag + k)
    zone_col = F.col(zone)
    bare = col("local").isNotNull() & ~col("zoned") & zone_col.isNotNull()
    return [
        {tag + "before": F.when(bare, _offset(col("local") - DAY_MS, zone_col)), tag + "after": F.when(bare, _offset(col("local") + DAY_MS, zone_col))},
        {
            tag + "first": F.when(col("before") == col("after"), col("local") - col("before")).when(_offset(col("local") - col("before"), zone_col) == col("before"), col("local") - col("before")),
            tag + "second": F.when(col("before") != col("after"), F.when(_offset(col("local") - col("after"), zone_col) == col("after"), col("local") - col("after"))),
        },
        {
            tag + "lo": F.when(col("zoned"), col("local") - col("offset") * 60_000).otherwise(F.least(col("first"), col("second"))),
            tag + "hi": F.when(~col("zoned") & col("first").isNotNull() & col("second").isNotNull(), F.greatest(col("first"), col("second"))),
        },
    ]
