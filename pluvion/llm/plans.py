"""Queries of the problems for training data (p7 to p10), with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pluvion.llm import leaks, packing, percentiles, splitting
from pluvion.session import cut, table

QS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
MEASURES = ("threshold_mm", "median_coverage_ratio", "p95_coverage_ratio", "p99_accum_mm_strict", "max_accum_mm_strict")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text")


def _readings(spark: SparkSession, sf: str) -> DataFrame:
    both = [table(spark, sf, t).select(F.lit(t).alias("source_table"), "station_id", "precip_raw_mm") for t in ("raw_window", "avamet_cv_qc")]
    return both[0].unionByName(both[1])


def p7_rain_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of precip_raw_mm per station, of either table."""
    p = percentiles.exact_percentiles(_readings(spark, sf), ["source_table", "station_id"], "precip_raw_mm", QS)
    return p.select("source_table", "station_id", "q", "n", F.round("value", 9).alias("value"))


def p7_summary_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact percentiles of the summary's measures per window."""
    t = table(spark, sf, "avamet_cv_events_station_scale_summary")
    rows = t.select(F.col("window_min"), F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("v")) for m in MEASURES])))
    p = percentiles.exact_percentiles(rows, ["window_min", "measure"], "v", QS)
    return p.select("window_min", "measure", "q", "n", F.round("value", 9).alias("value"))


def p7_combined_days(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of the stations' percentiles from histograms of separate days, added up (32 of 64 bits kept)."""
    t = table(spark, sf, "avamet_cv_qc").select("station_id", F.to_date("timestamp_utc").alias("day"), "precip_raw_mm")
    days = percentiles.digit_histogram(percentiles.keyed(t, ["station_id", "day"], "precip_raw_mm"), ["station_id", "day"])
    total = percentiles.merge_counts(days.drop("day"), group=["station_id"])
    return percentiles.percentiles(cut(total), ["station_id"], QS, digits=2)


def p8_packed(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's parts with their bin of 4096 tokens."""
    return packing.pack(packing.token_counts(documents(spark, sf)), 4096).drop("fill")


def p8_bins(spark: SparkSession, sf: str) -> DataFrame:
    """One row per bin: items and tokens."""
    return p8_packed(spark, sf).groupBy("bin_id").agg(F.count("*").alias("items"), F.sum("n_tokens").alias("n_tokens"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_leaks(spark, sf).filter("kind = 'copy'").select("doc_id", "item_id")


def p9_leaks(spark: SparkSession, sf: str) -> DataFrame:
    """Each commit and item it leaks, with the longest passage."""
    return leaks.leaks(documents(spark, sf), table(spark, sf, "eval_items"))


def p10_pieces(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of at most 1024 tokens of the documents above that, with an overlap of 64."""
    return splitting.split_oversized(documents(spark, sf), 1024, 64)


def p7_combined_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The exact percentiles of the stations, and whether each lies within the bounds of the combined days."""
    exact = percentiles.exact_percentiles(table(spark, sf, "avamet_cv_qc"), ["station_id"], "precip_raw_mm", QS)
    both = exact.join(p7_combined_days(spark, sf).select("station_id", "q", "low", "high"), ["station_id", "q"], "left")
    return both.select("station_id", "q", "n", F.round("value", 9).alias("value"), F.coalesce((F.col("low") <= F.col("value")) & (F.col("value") <= F.col("high")), F.lit(False)).alias("within"))


def p8_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One row on all bins: documents, whether every token of each is there once, no bin is over, and few more than needed."""
    sizes = cut(packing.token_counts(documents(spark, sf)))
    packed = cut(packing.pack(sizes, 4096))
    bins = packed.groupBy("bin_id").agg(F.sum("n_tokens").alias("fill")).agg(F.count("*").alias("bins"), F.sum("fill").alias("total"), F.sum((F.col("fill") > 4096).cast("bigint")).alias("bins_over_capacity"))
    whole = packed.groupBy("doc_id").agg(F.sum("n_tokens").alias("s"), F.max(F.col("token_start") + F.col("n_tokens")).alias("end")).join(sizes, "doc_id", "full_outer")
    whole = whole.agg(F.count("*").alias("documents"), F.sum((~(F.col("s").eqNullSafe(F.col("n_tokens")) & F.col("end").eqNullSafe(F.col("n_tokens")))).cast("bigint")).alias("documents_incomplete"))
    return spark.sql("SELECT documents, documents_incomplete, bins_over_capacity, bins <= ceil(total / 4096) * 1.01 + 1 AS few_bins FROM {w}, {b}", w=whole, b=bins)


def p10_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One row on all pieces: documents, and how many pieces or texts break a rule."""
    docs = documents(spark, sf)
    pieces = cut(p10_pieces(spark, sf))
    beside = Window.partitionBy("doc_id").orderBy("piece")
    rows = pieces.withColumns({"before_end": F.lag("end_char").over(beside), "following": F.lead("start_char").over(beside)})
    rows = rows.join(docs, "doc_id").select(
        (F.col("n_tokens") > 1024).alias("over"), (F.col("overlap_tokens") > 64).alias("long"), (F.coalesce(F.col("before_end"), F.lit(0)) < F.col("start_char")).alias("gap"),
        (F.col("following").isNull() & (F.col("end_char") != F.length("text"))).alias("short"), (F.substring("text", F.col("start_char") + 1, F.col("end_char") - F.col("start_char")) != F.col("piece_text")).alias("wrong"),
    )
    broken = rows.agg(*[F.coalesce(F.sum(F.col(c).cast("bigint")), F.lit(0)).alias(name) for c, name in (("over", "over_limit"), ("long", "overlap_too_long"), ("gap", "gaps"), ("short", "ends_missing"), ("wrong", "other_text"))])
    missed = packing.token_counts(docs).filter("n_tokens > 1024").join(pieces.select("doc_id").distinct(), "doc_id", "left_anti").agg(F.count("*").alias("texts_missed"))
    return spark.sql("SELECT (SELECT count(*) FROM {d}) AS documents, texts_missed, over_limit, overlap_too_long, gaps, ends_missing, other_text FROM {m}, {b}", d=docs, m=missed, b=broken)


QUERIES = {f.__name__: f for f in (p7_rain_percentiles, p7_summary_percentiles, p7_combined_days, p7_combined_bounds, p8_packed, p8_bins, p8_totals, p9_found, p9_leaks, p10_pieces, p10_totals)}

_Q = ", ".join(map(str, QS))
ORACLES = {
    "p7_rain_percentiles": f"""
WITH v AS (SELECT 'raw_window' AS source_table, station_id, precip_raw_mm AS v FROM raw_window
           UNION ALL SELECT 'avamet_cv_qc', station_id, precip_raw_mm FROM avamet_cv_qc),
g AS (SELECT source_table, station_id, count(*) AS n, quantile_cont(v, [{_Q}]) AS p FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT source_table, station_id, unnest([{_Q}])::DOUBLE AS q, n, round(unnest(p), 9) AS value FROM g""",
    "p7_summary_percentiles": f"""
WITH v AS ({' UNION ALL '.join(f"SELECT window_min, '{m}' AS measure, {m} AS v FROM avamet_cv_events_station_scale_summary" for m in MEASURES)}),
g AS (SELECT window_min, measure, count(*) AS n, quantile_cont(v, [{_Q}]) AS p FROM v WHERE v IS NOT NULL GROUP BY ALL)
SELECT window_min, measure, unnest([{_Q}])::DOUBLE AS q, n, round(unnest(p), 9) AS value FROM g""",
    "p7_combined_bounds": f"""
WITH g AS (SELECT station_id, count(*) AS n, quantile_cont(precip_raw_mm, [{_Q}]) AS p FROM avamet_cv_qc WHERE precip_raw_mm IS NOT NULL GROUP BY station_id)
SELECT station_id, unnest([{_Q}])::DOUBLE AS q, n, round(unnest(p), 9) AS value, true AS within FROM g""",
    "p8_totals": "SELECT count(*) AS documents, 0 AS documents_incomplete, 0 AS bins_over_capacity, true AS few_bins FROM documents WHERE text IS NOT NULL",
    "p10_totals": "SELECT count(*) AS documents, 0 AS texts_missed, 0 AS over_limit, 0 AS overlap_too_long, 0 AS gaps, 0 AS ends_missing, 0 AS other_text FROM documents",
}
