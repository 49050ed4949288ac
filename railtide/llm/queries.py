"""Registered queries pN_ of the training-data operators, and DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railtide.functions import sqltext as q
from railtide.functions.ids import clean
from railtide.llm import leakage, packing, percentiles, reading_level
from railtide.sources.tables import table

QS = {"p05": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95, "p99": 0.99}


def p2_downstream_impact(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.grouped_percentiles(table(spark, folder, "history"), ["from_route", "to_route", "station", "hour"], "downstream_impact", QS)


def p2_observed(spark: SparkSession, folder: str) -> DataFrame:
    return percentiles.grouped_percentiles(table(spark, folder, "stop_history"), ["route", "station", "hour"], "observed", QS)


def p2_predicted(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "pending_predictions").select(clean("agency_id").alias("agency_id"), clean("route_id").alias("route_id"), "predicted_secs")
    return percentiles.grouped_percentiles(rows, ["agency_id", "route_id"], "predicted_secs", QS)


def p2_bounds(spark: SparkSession, folder: str) -> DataFrame:
    """(hour, name, n, held): whether the percentile of each hour, from summaries that had to be compressed, has a rank
    within rank_error of the one asked for, and rank_error is within eps n."""
    rows, eps = table(spark, folder, "stop_history").where("observed is not null").select("hour", F.col("observed").cast("double").alias("v")), 0.02
    got = percentiles.grouped_percentiles(rows, ["hour"], "v", QS, eps)
    names = [F.struct(F.lit(name).alias("name"), F.lit(x).alias("q"), F.col(name).alias("value")) for name, x in QS.items()]
    got = got.select(F.col("hour").alias("h"), "n", "rank_error", F.inline(F.array(*names)))  # a few rows per hour of the day
    at = rows.join(F.broadcast(got), F.col("hour").eqNullSafe(F.col("h"))).groupBy("h", "name", "n", "rank_error", "q").agg(
        F.count_if(F.col("v") < F.col("value")).alias("below"), F.count_if(F.col("v") <= F.col("value")).alias("upto"))
    rank = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n") - 1e-9))
    off = F.greatest(F.col("below") + 1 - rank, rank - F.col("upto"), F.lit(0))
    return at.select(F.col("h").alias("hour"), "name", "n", ((off <= F.col("rank_error")) & (F.col("rank_error") <= eps * F.col("n"))).alias("held"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    return packing.containers(packing.pack_documents(table(spark, folder, "documents")))


def p8_checked(spark: SparkSession, folder: str) -> DataFrame:
    return packing.checked(packing.pack_documents(table(spark, folder, "documents")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.find_leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10_profile(spark, folder).select("doc_id", "reading_level")


def p10_profile(spark: SparkSession, folder: str) -> DataFrame:
    return reading_level.reading_levels(table(spark, folder, "documents"), table(spark, folder, "reading_labels"))


QUERIES = {f.__name__: f for f in (
    p2_downstream_impact, p2_observed, p2_predicted, p2_bounds, p8_packed, p8_containers, p8_checked, p9_found, p10_found, p10_profile)}


def _ranked(keys: str, value: str, source: str) -> str:
    """Nearest-rank percentiles; equal to the summaries wherever those are complete (groups of up to 1/eps values)."""
    rank = lambda x: f"max(v) FILTER (rk = greatest(1, ceil({x} * n - 1e-9)))"
    return f"""SELECT {keys}, max(n) AS n, 0::BIGINT AS rank_error, {', '.join(f'{rank(x)} AS {name}' for name, x in QS.items())}
FROM (SELECT {keys}, v, row_number() OVER (PARTITION BY {keys} ORDER BY v) AS rk, count(*) OVER (PARTITION BY {keys}) AS n
  FROM (SELECT *, {value}::DOUBLE AS v FROM ({source})) WHERE v IS NOT NULL) GROUP BY {keys}"""


ORACLE = {
    "p2_downstream_impact": _ranked("from_route, to_route, station, hour", "downstream_impact", "SELECT * FROM history"),
    "p2_observed": _ranked("route, station, hour", "observed", "SELECT * FROM stop_history"),
    "p8_checked": "SELECT doc_id, TRUE AS contiguous, TRUE AS unsplit, TRUE AS fits FROM documents",
    "p2_bounds": f"""SELECT hour, name, count(observed) AS n, TRUE AS held FROM stop_history, (VALUES {', '.join(f"('{x}')" for x in QS)}) AS q(name)
WHERE observed IS NOT NULL GROUP BY hour, name""",
    "p2_predicted": _ranked("agency_id, route_id", "predicted_secs",
                            f"SELECT {q.clean('agency_id')} AS agency_id, {q.clean('route_id')} AS route_id, predicted_secs FROM pending_predictions"),
}
