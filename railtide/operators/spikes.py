"""Implausible readings per source: Haar wavelet details, zero-detail runs and hard bounds.

A reading is judged against the source it comes from. The series of a source is cut into time chunks, so a source
holding a third of all rows is still spread over many tasks, and each chunk is decomposed with a stationary Haar
wavelet, whose level j averages the last 2^j readings: ``x = d1 + d2 + ... + dJ + aJ`` with d_j = a_(j-1) - a_j. With the source's median m and interquartile range as robust scale, the components
``d1 .. dJ, aJ - m`` have white-noise standard deviations in the ratio 2^(-j/2); dividing each by its share gives one
robust threshold for all levels. Those thresholds add up to ``fence`` interquartile ranges, so a reading with no
component beyond its threshold lies within that distance of the median and can't be outside the fence: the wavelet
stage loses no case. The exact fence then decides about the few readings that are left.

Frozen values are runs whose first-level undecimated details are zero; runs are found per chunk and stitched over
chunk borders from the first and last run of each chunk. Impossible readings are outside hard bounds or no number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from railtide.functions.ids import clean, is_measurement, route
from railtide.session import broadcast_if_small

LEVELS = 3
CHUNK_SECONDS = 6 * 3600
BUCKET = 4096


def source_key(*cols: str | Column) -> Column:
    """One string for a composite source; null parts count as a source of their own."""
    return F.concat_ws("\x01", *(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("\x00")) for c in cols))


def exact_quantiles(df: DataFrame, src: str, value: str, qs: dict[str, float]) -> DataFrame:
    """(src, n, one double per name) with linearly interpolated exact quantiles of a whole-number column.

    Radix selection in two passes: counts by bucket of 4096 values find the bucket of each wanted rank, then only
    those buckets are counted by value. No task holds more than the buckets of a source (at most 2^20 for 32-bit
    values) or 4096 values, whatever the number of rows.
    """
    v = df.select(F.col(src).alias("src"), F.col(value).cast("long").alias("v")).where("v is not null")
    v = v.withColumn("b", F.floor(F.col("v") / BUCKET))
    by_src = Window.partitionBy("src").orderBy("b")
    hist = (
        v.groupBy("src", "b").agg(F.count("*").alias("c"))
        .withColumn("upto", F.sum("c").over(by_src))
        .withColumn("n", F.sum("c").over(Window.partitionBy("src")))
    )
    wanted = []
    for name, q in qs.items():
        h = (F.col("n") - 1) * F.lit(q)
        wanted += [F.struct(F.lit(name).alias("name"), F.lit(side).alias("side"), r.cast("long").alias("r"), (h - F.floor(h)).alias("frac"))
                   for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h)))]
    picked = (
        hist.select("src", "b", "n", (F.col("upto") - F.col("c")).alias("base"), "upto", F.explode(F.array(*wanted)).alias("w"))
        .where("w.r >= base and w.r < upto")
        .select("src", "b", "n", "w.name", "w.side", "w.frac", (F.col("w.r") - F.col("base")).alias("r"))
    )
    buckets = broadcast_if_small(picked.groupBy("src", "b").agg(F.collect_list(F.struct("name", "side", "frac", "r", "n")).alias("w")))
    fine = (
        v.join(buckets.select("src", "b"), ["src", "b"], "left_semi")
        .groupBy("src", "b", "v").agg(F.count("*").alias("c"))
        .withColumn("upto", F.sum("c").over(Window.partitionBy("src", "b").orderBy("v")))
    )
    at_rank = (
        fine.join(buckets, ["src", "b"]).select("src", "v", "c", "upto", F.explode("w").alias("w"))
        .where("w.r >= upto - c and w.r < upto")
    )
    agg = [F.max("w.n").alias("n")]
    for name in qs:
        lo = F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == "lo"), F.col("v")))
        hi = F.max(F.when((F.col("w.name") == name) & (F.col("w.side") == "hi"), F.col("v")))
        frac = F.max(F.when(F.col("w.name") == name, F.col("w.frac")))
        agg.append((lo + (hi - lo) * frac).cast("double").alias(name))
    return at_rank.groupBy("src").agg(*agg)


def wavelet_spikes(
    df: DataFrame, row_id: str, src: str, at: str, value: str, fence: float = 6.0,
    levels: int = LEVELS, chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """(row_id, src, value, score): readings more than ``fence`` interquartile ranges outside their source's quartiles.

    Nulls are no readings. Rows with a null time form a chunk of their own. Repeated rows each count. A source with
    one reading or without spread has range 0, so there every value off the quartiles is a spike. Empty input gives
    no rows; other columns of df are ignored. score is the largest robust z of the reading's wavelet components.
    """
    base = df.select(
        F.col(row_id).alias("row_id"), F.col(src).alias("src"), F.col(at).cast("long").alias("at"),
        F.col(value).cast("long").alias("x"),
    ).where("x is not null")
    quart = broadcast_if_small(exact_quantiles(base, "src", "x", {"q1": 0.25, "med": 0.5, "q3": 0.75}))
    iqr = F.col("q3") - F.col("q1")
    w = F.greatest(F.least(F.col("x"), F.col("q3") + (fence + 1) * iqr + 1), F.col("q1") - (fence + 1) * iqr - 1)
    # four narrow columns are shuffled; the quartiles join behind the shuffle and keep its partitioning
    s = base.withColumn("chunk", F.floor(F.col("at") / chunk_seconds)).repartition("src", "chunk")
    s = s.join(quart.select("src", "q1", "med", "q3"), "src").withColumn("a0", w)
    order = Window.partitionBy("src", "chunk").orderBy("at", "row_id")
    s = s.select("*", *(F.avg("a0").over(order.rowsBetween(1 - 2**j, 0)).alias(f"a{j}") for j in range(1, levels + 1)))
    share = [2 ** (-j / 2) for j in range(1, levels + 1)] + [2 ** (-levels / 2)]
    sigma = iqr / 1.349
    parts = [F.abs(F.col(f"a{j - 1}") - F.col(f"a{j}")) for j in range(1, levels + 1)] + [F.abs(F.col(f"a{levels}") - F.col("med"))]
    z = F.greatest(*(F.when(p == 0, 0.0).when(sigma == 0, float("inf")).otherwise(p / F.nullif(sigma * c, F.lit(0.0))) for p, c in zip(parts, share)))
    limit = fence * 1.349 / sum(share)
    candidates = s.withColumn("score", z).where(F.col("score") >= limit * (1 - 1e-9))
    fenced = (F.col("x") > F.col("q3") + fence * iqr) | (F.col("x") < F.col("q1") - fence * iqr)
    return candidates.where(fenced).select("row_id", "src", F.col("x").alias("value"), "score")


def frozen_runs(
    df: DataFrame, src: str, at: str, value: str, tie: str, min_run: int = 8, chunk_seconds: int = CHUNK_SECONDS,
) -> DataFrame:
    """(src, chunk, from_at, to_at, value): stretches of at least ``min_run`` consecutive equal non-zero values.

    One row per chunk that a stretch touches. The series of a source is ordered by (at, tie); null values and null
    times must be filtered before. A stretch over several chunks is put together from the chunks' border runs, so no
    task sorts more than a chunk of a source, or two rows per chunk when stitching.
    """
    key = Window.partitionBy("src", "chunk").orderBy("at", "tie")
    s = df.select(F.col(src).alias("src"), F.col(at).cast("long").alias("at"), F.col(value).alias("x"), F.col(tie).alias("tie"))
    s = s.withColumn("chunk", F.floor(F.col("at") / chunk_seconds))
    detail = (F.col("x").cast("long") - F.lag("x").over(key)) / 2
    runs = (
        s.withColumn("start", F.when(detail == 0, 0).otherwise(1))
        .withColumn("run", F.sum("start").over(key))
        .groupBy("src", "chunk", "run")
        .agg(F.count("*").alias("n"), F.first("x").alias("x"), F.min("at").alias("from_at"), F.max("at").alias("to_at"))
        .withColumn("runs", F.max("run").over(Window.partitionBy("src", "chunk")))
    )
    # long inner runs stand for themselves; border runs may go on in the next chunk
    kept = runs.where((F.col("run") == 1) | (F.col("run") == F.col("runs")) | (F.col("n") >= min_run))
    order = Window.partitionBy("src").orderBy("chunk", "run")
    opens = (F.col("run") > 1) | F.lag("x").over(order).isNull() | (F.lag("x").over(order) != F.col("x"))
    return (
        kept.withColumn("opens", opens.cast("int"))
        .withColumn("island", F.sum("opens").over(order))
        .withColumn("total", F.sum("n").over(Window.partitionBy("src", "island")))
        .where((F.col("total") >= min_run) & (F.col("x") != 0))
        .select("src", "chunk", "from_at", "to_at", F.col("x").alias("value"))
    )


def stuck_deliveries(
    events: DataFrame, min_run: int = 8, chunk_seconds: int = CHUNK_SECONDS
) -> DataFrame:
    """delivery_id of every delivery of a message inside a frozen stretch of its trip; see frozen_runs."""
    m = events.where(is_measurement()).select(
        "delivery_id", "received_at", clean("trip_id").alias("trip"), clean("stop_id").alias("stop"), "observed_at", "delay_seconds"
    )
    messages = m.where("observed_at is not null").groupBy("trip", "stop", "observed_at").agg(
        F.min_by("delay_seconds", F.struct("received_at", "delivery_id")).alias("delay_seconds")
    )
    runs = frozen_runs(messages, "trip", "observed_at", "delay_seconds", "stop", min_run, chunk_seconds)
    m = m.withColumn("chunk", F.floor(F.col("observed_at") / chunk_seconds))
    r = runs.withColumnRenamed("chunk", "rchunk")
    hit = (
        (m.trip.eqNullSafe(r.src)) & (m.chunk == r.rchunk)
        & (m.observed_at >= r.from_at) & (m.observed_at <= r.to_at) & (m.delay_seconds == r.value)
    )
    return m.join(r, hit, "left_semi").select("delivery_id")


def implausible_readings(events: DataFrame, states: DataFrame, bound: int = 43_200, fence: float = 6.0, min_run: int = 8,
                         conf_low: float = 0.5, conf_high: float = 1.0) -> DataFrame:
    """(table_name, row_id, field): every implausible delay or confidence, each once however many rules it breaks."""
    measured = events.where(is_measurement()).select(
        F.col("delivery_id").alias("row_id"), source_key(clean("agency_id"), route()).alias("src"),
        F.col("observed_at").alias("at"), F.col("delay_seconds").alias("x"))
    state = states.where("delay_seconds is not null").select(
        F.col("state_id").alias("row_id"), source_key(clean("agency_id"), route()).alias("src"),
        F.col("observed_at").alias("at"), F.col("delay_seconds").alias("x"))

    def tagged(rows: DataFrame, table: str, field: str) -> DataFrame:
        return rows.select(F.lit(table).alias("table_name"), F.col("row_id").cast("long").alias("row_id"), F.lit(field).alias("field"))

    conf = F.col("confidence")
    bad_conf = F.isnan(conf) | (conf < conf_low) | (conf > conf_high)
    parts = [tagged(states.where(conf.isNotNull() & bad_conf).withColumnRenamed("state_id", "row_id"), "delay_state", "confidence")]
    for rows, name in ((measured, "delay_events"), (state, "delay_state")):
        parts.append(tagged(rows.where(F.abs(F.col("x").cast("long")) >= bound), name, "delay_seconds"))
        parts.append(tagged(wavelet_spikes(rows, "row_id", "src", "at", "x", fence), name, "delay_seconds"))
    parts.append(tagged(stuck_deliveries(events, min_run).withColumnRenamed("delivery_id", "row_id"), "delay_events", "delay_seconds"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
