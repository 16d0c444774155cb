"""Problem 1: mixed timestamp notations and zones, normalised to UTC instants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pluvion.functions import timestamps as ts
from pluvion.session import private_prefix

EXACT = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z\z"


def normalise_stamps(df: DataFrame, clocks: DataFrame, taken: str = "timestamp_utc", arrived: str = "inserted_ts", station: str = "station_id", taken_ms: str = "t_ms", arrived_ms: str = "n_ms", arrived_too: bool = True) -> DataFrame:
    """Add ``taken_ms`` and ``arrived_ms``: UTC milliseconds of two text stamps, NULL where unreadable.

    One regex alternation extracts the components of every notation once; calendar ranges are checked and instants
    put together by integer day arithmetic (``pluvion.functions.timestamps``).  Stamps without zone follow the
    station's ``clock_zone`` (``taken``) or ``relay_zone`` (``arrived``), all-numeric dates its ``date_order``.

    Defined results: NULL, empty and unreadable text, dates or times that do not exist, clock times skipped by a
    daylight-saving change, unknown zones, and stamps that need a station missing from ``clocks`` give NULL.  Of two
    possible instants (repeated hour) the pair with the smallest non-negative delay counts; failing that, the pair
    nearest to it; without the other stamp, the earlier instant.  Repeated rows stay; a station listed twice in
    ``clocks`` counts once (its smallest values).  Columns named like the results are replaced, others kept.
    Without ``arrived_too`` only ``taken_ms`` is added, the same as with it: the other stamp is read where it decides.
    """
    own = private_prefix(df)
    st, cz, rz, do, best = (own + k for k in ("st", "cz", "rz", "do", "best"))
    dim = (
        clocks.select(F.col(station).alias(st), "clock_zone", "relay_zone", "date_order").filter(F.col(st).isNotNull())
        .groupBy(st).agg(F.min(ts.known_zone(F.col("clock_zone"))).alias(cz), F.min(ts.known_zone(F.col("relay_zone"))).alias(rz), F.min(F.lower(F.trim("date_order"))).alias(do))
    )
    results = {taken_ms.lower(), arrived_ms.lower()} if arrived_too else {taken_ms.lower()}
    out = df.drop(*[c for c in df.columns if c.lower() in results]).join(dim, F.col(station) == F.col(st), "left")
    both = [(0, F.col(taken), cz), (1, F.col(arrived), rz)]
    for stamps in [both] if arrived_too else [both[:1], [(1, F.when(F.col(f"{own}0_hi").isNotNull(), F.col(arrived)), rz)]]:
        out = out.withColumns({f"{own}p{i}": ts.components(c) for i, c, _ in stamps})
        kept = out.columns
        for stage in zip(*(ts.local_stages(f"{own}{i}_", f"{own}p{i}", do) for i, _, _ in stamps)):
            out = out.withColumns({k: c for part in stage for k, c in part.items()})
        out = out.select(*kept, *[f"{own}{i}_{k}" for i, _, _ in stamps for k in ("local", "zoned", "offset")])
        for stage in zip(*(ts.instant_stages(f"{own}{i}_", zone) for i, _, zone in stamps)):
            out = out.withColumns({k: c for part in stage for k, c in part.items()})
        if len(stamps) == 1:  # a generated column: the next stage starts from values, not from this one's expressions
            ends = [f"{own}{stamps[0][0]}_{k}" for k in ("lo", "hi")]
            out = out.select(*[c for c in kept if not c.startswith(f"{own}p")], F.inline(F.array(F.struct(*ends))))
    pair = lambda t, n: F.struct((F.col(n) < F.col(t)).alias("early"), F.abs(F.col(n) - F.col(t)).alias("delay"), F.col(t).alias("t"), F.col(n).alias("n"))
    pairs = F.filter(F.array(*[pair(f"{own}0_{i}", f"{own}1_{j}") for i in ("lo", "hi") for j in ("lo", "hi")]), lambda p: p["delay"].isNotNull())
    twice = F.col(f"{own}0_hi").isNotNull() | F.col(f"{own}1_hi").isNotNull()
    out = out.withColumn(best, F.when(twice, F.array_min(pairs)))
    # Generated columns: filters on the instants stay above, instead of being unfolded into all the stages.
    found = [F.coalesce(f"{best}.t", f"{own}0_lo").alias(taken_ms), F.coalesce(f"{best}.n", f"{own}1_lo").alias(arrived_ms)]
    return out.select(*[c for c in out.columns if not c.startswith(own)], F.inline(F.array(F.struct(*found[: 1 + arrived_too]))))


def found_stamps(df: DataFrame, clocks: DataFrame) -> DataFrame:
    """Each readable value that is not already exact UTC text: (ingest_order, field, utc_ms)."""
    fields = ("timestamp_utc", "inserted_ts")
    norm = normalise_stamps(df.select("ingest_order", "station_id", *fields), clocks)
    item = lambda f, ms: F.struct(F.lit(f).alias("field"), F.col(ms).alias("utc_ms"), F.col(f).rlike(EXACT).alias("exact"))
    rows = norm.select("ingest_order", F.inline(F.array(item(fields[0], "t_ms"), item(fields[1], "n_ms"))))
    return rows.filter("utc_ms IS NOT NULL AND NOT exact").select("ingest_order", "field", "utc_ms")
