"""Quality control of interval rainfall: latest version per reading, sequencing, flags, classes, cleaned values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pluvion.operators.halo import with_halo

CORE = (5, 10)
SUPPORTED = (4, 5, 6, 10, 15, 20, 30)
OBS = ["station_id", "timestamp_utc", "inserted_ts", "precip_raw_mm", "precip_sum_raw_mm"]


def dedup_latest(df: DataFrame, keys: tuple[str, ...] = ("station_id", "timestamp_utc")) -> DataFrame:
    """The version inserted last of each reading; equal versions are told apart by their values, highest first, NULL last."""
    latest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in ("inserted_ts", "precip_raw_mm", "precip_sum_raw_mm")])
    return df.withColumn("__k", F.row_number().over(latest)).filter("__k = 1").drop("__k")


def sequenced(df: DataFrame) -> DataFrame:
    """Add the minute index and the readings before and after; series are cut into months with one reading of halo."""
    rows = df.withColumns({"end_min": F.expr("floor(unix_micros(cast(timestamp_utc AS timestamp)) / 60000000)").cast("bigint"), "month": F.expr("cast(year(timestamp_utc) * 12 + month(timestamp_utc) AS int)")})
    line = Window.partitionBy("station_id", "month").orderBy("timestamp_utc")
    near = {
        "prev_min": F.lag("end_min").over(line), "next_min": F.lead("end_min").over(line), "prev_p": F.lag("precip_raw_mm").over(line),
        "next_p": F.lead("precip_raw_mm").over(line), "prev_s": F.lag("precip_sum_raw_mm").over(line),
    }
    return with_halo(rows, ["station_id"], "timestamp_utc", "month", 1).withColumns(near).filter("NOT __halo").drop("__halo", "month")


def qc(df: DataFrame, gap_min: int = 60, suspect: float = 200.0, hard: float = 1000.0, sum_tolerance: float = 0.2) -> DataFrame:
    """Flags, classes, scores and cleaned values of the latest version of every reading (columns OBS of ``df``).

    Rows without station or time take no part.  Flags are never NULL: a comparison with NULL is false.
    """
    rows = sequenced(dedup_latest(df.select(*OBS).filter("station_id IS NOT NULL AND timestamp_utc IS NOT NULL")))
    rows = rows.withColumns({"delta_prev_min": F.col("end_min") - F.col("prev_min"), "delta_next_min": F.col("next_min") - F.col("end_min"), "d_precsum_mm": F.col("precip_sum_raw_mm") - F.col("prev_s")})
    rows = rows.withColumn("precip_rate_mmh_raw", F.expr("CASE WHEN delta_prev_min > 0 THEN precip_raw_mm * 60.0D / delta_prev_min END"))
    sure = lambda text: F.coalesce(F.expr(text), F.lit(False))
    core, supported = ", ".join(map(str, CORE)), ", ".join(map(str, SUPPORTED))
    rows = rows.withColumns({
        "is_core_cadence": sure(f"delta_prev_min IN ({core})"), "is_supported_cadence": sure(f"delta_prev_min IN ({supported})"),
        "flag_delta_nonpositive": sure("delta_prev_min <= 0"), "flag_gap_large": sure(f"delta_prev_min >= {gap_min}"),
        "flag_precip_negative": sure("precip_raw_mm < 0"), "flag_precip_suspect_rate": sure(f"precip_rate_mmh_raw >= {suspect}D"),
        "flag_precip_hard_rate": sure(f"precip_rate_mmh_raw >= {hard}D"),
        "flag_precip_isolated_spike": sure(f"precip_rate_mmh_raw >= {suspect}D AND coalesce(prev_p, 0D) <= 0.1D AND coalesce(next_p, 0D) <= 0.1D"),
        "flag_precsum_negative": sure("precip_sum_raw_mm < 0"), "flag_precsum_absurd": sure("precip_sum_raw_mm >= 100000"),
        "flag_precsum_decrease": sure("d_precsum_mm < -0.001D"), "flag_precsum_mismatch": sure(f"abs(d_precsum_mm - precip_raw_mm) > {sum_tolerance}D"),
    })
    rows = rows.withColumns({
        "precip_failed": F.expr("flag_precip_negative OR flag_precip_hard_rate"), "precsum_failed": F.expr("flag_precsum_negative OR flag_precsum_absurd"),
        "precsum_odd": F.expr("flag_precsum_decrease OR flag_precsum_mismatch"),
    })
    return rows.withColumns({
        "precip_mm_qc": F.expr("CASE WHEN NOT precip_failed THEN precip_raw_mm END"),
        "precip_rate_mmh_qc": F.expr("CASE WHEN NOT precip_failed AND delta_prev_min > 0 THEN precip_raw_mm * 60.0D / delta_prev_min END"),
        "precip_sum_mm_qc": F.expr("CASE WHEN NOT precsum_failed THEN precip_sum_raw_mm END"),
        "qc_precip": F.expr("CASE WHEN precip_failed THEN 'FAIL' WHEN flag_precip_suspect_rate THEN 'SUSPECT' ELSE 'PASS' END"),
        "qc_precsum": F.expr("CASE WHEN precsum_failed THEN 'FAIL' WHEN precsum_odd THEN 'SUSPECT' ELSE 'PASS' END"),
        "q_precip": F.expr("CASE WHEN precip_failed THEN 0.0D WHEN flag_precip_suspect_rate THEN 0.5D ELSE 1.0D END"),
        "q_precsum": F.expr("CASE WHEN precsum_failed THEN 0.0D WHEN precsum_odd THEN 0.5D ELSE 1.0D END"),
        "usable_interval_extremes": F.expr("is_supported_cadence AND delta_prev_min > 0 AND coalesce(precip_raw_mm >= 0, false) AND NOT flag_precip_hard_rate"),
    }).drop("precip_failed", "precsum_failed", "precsum_odd")
