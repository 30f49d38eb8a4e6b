"""Counts, reports and percentiles."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def buffered_total(embeddings: DataFrame) -> DataFrame:
    """One row: embeddings not yet consolidated; of code blocks only current ones."""
    return embeddings.agg(F.count_if(~F.col("consolidated") & F.coalesce("is_current", F.lit(True))).alias("buffered"))


def buffered_by_combination(embeddings: DataFrame) -> DataFrame:
    return embeddings.where(~F.col("consolidated")).groupBy("plugin_type", "model_id").agg(F.count("*").alias("backlog"))


def pending_backlog(versions: DataFrame) -> DataFrame:
    return versions.where(F.col("status") == "pending").agg(F.count("*").alias("backlog"))


def oldest_pending_age(versions: DataFrame, now: datetime) -> DataFrame:
    """Seconds since the oldest pending version, null without any."""
    oldest = F.min(F.when(F.col("status") == "pending", F.col("created_at")))
    return versions.agg(((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(oldest.cast("timestamp"))) / 1e6).alias("age_secs"))


def concepts_report(thresholds: DataFrame, embeddings: DataFrame, limit: int = 20) -> DataFrame:
    """Thresholds and backlog of each calibrated combination, the longest backlog first."""
    joined = thresholds.join(buffered_by_combination(embeddings), ["plugin_type", "model_id"], "left").withColumn("backlog", F.coalesce("backlog", F.lit(0)))
    return joined.orderBy(F.desc("backlog"), "plugin_type", "model_id").limit(limit)


def system_status(inodes: DataFrame, versions: DataFrame, blobs: DataFrame, embeddings: DataFrame, centroids: DataFrame, now: datetime) -> DataFrame:
    """One row of figures of the whole; each side is a single row before they are put side by side."""
    parts = [
        inodes.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories")),
        versions.agg(F.count("*").alias("versions"), F.count_if(F.col("status") == "pending").alias("pending")),
        oldest_pending_age(versions, now),
        blobs.agg(F.count("*").alias("blobs"), F.coalesce(F.sum("size"), F.lit(0)).alias("blob_bytes")),
        buffered_total(embeddings),
        centroids.agg(F.count_if("is_active").alias("active_centroids")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(F.broadcast(part))
    return out


def storage_totals(files: DataFrame) -> DataFrame:
    """Files, directories and bytes of an import."""
    return files.agg(F.count_if(~F.col("is_dir")).alias("files"), F.count_if("is_dir").alias("directories"), F.coalesce(F.sum(F.when(~F.col("is_dir"), F.col("size"))), F.lit(0)).alias("bytes"))


def index_percentile(value: Column | str, p: float) -> Column:
    """The value at index min(n - 1, int(n * p)) of the sorted values; no interpolation."""
    ordered = F.sort_array(F.collect_list(value))
    n = F.size(ordered)
    return F.element_at(ordered, (F.least(n - 1, F.floor(n * F.lit(p))) + 1).cast("int"))


def latency_report(samples: DataFrame, value: str, by: list[str]) -> DataFrame:
    """p50, p95, p99 and mean. Values are ranked in place, so no group is gathered in one array."""
    from pyspark.sql import Window

    order = Window.partitionBy(*by).orderBy(value)
    ranked = samples.where(F.col(value).isNotNull()).select(*by, value, (F.row_number().over(order) - 1).alias("_i"))
    sized = ranked.join(ranked.groupBy(*by).agg(F.count("*").alias("_n")), by)
    at = lambda p: F.max(F.when(F.col("_i") == F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(p))), F.col(value)))
    return sized.groupBy(*by).agg(at(0.50).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.avg(value).alias("mean"))


def phase_medians(samples: DataFrame, phase: str, value: str) -> DataFrame:
    return samples.groupBy(phase).agg(F.median(value).alias("median"))


def compare_baseline(current: DataFrame, baseline: DataFrame, flat_percent: float = 10.0) -> DataFrame:
    """(metric, now, before, delta_percent, verdict); metrics that are better when higher say so in ``higher_is_better``."""
    both = current.select("metric", F.col("value").alias("now")).join(baseline.select("metric", F.col("value").alias("before"), "higher_is_better"), "metric")
    delta = F.when(F.col("before") != 0, (F.col("now") - F.col("before")) / F.col("before") * 100)
    better = F.when(F.col("higher_is_better"), delta > 0).otherwise(delta < 0)
    verdict = F.when(F.abs(delta) < flat_percent, "flat").when(better, "better").otherwise("worse")
    return both.select("metric", "now", "before", delta.alias("delta_percent"), verdict.alias("verdict"))


def merge_statistics(parts: DataFrame, by: list[str], vector: str = "mean", m2: str = "m2", count: str = "n") -> DataFrame:
    """(by.., n, mean, m2) of groups whose parts have count, mean and sum of squared gaps; any order, any number of parts.

    Sums by position are combined before the exchange; a part's spread around the
    common mean adds to its own.
    """
    used = parts.where(F.col(count) > 0)
    flat = used.select(*by, F.col(count).alias("_n"), F.posexplode(F.col(vector).cast("array<double>")).alias("pos", "x"))
    sums = flat.groupBy(*by, "pos").agg(F.sum("_n").alias("n"), F.sum(F.col("_n") * F.col("x")).alias("s"), F.sum(F.col("_n") * F.col("x") * F.col("x")).alias("q"))
    means = sums.groupBy(*by).agg(
        F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("pos", (F.col("s") / F.col("n")).alias("m")))), lambda p: p["m"]).alias("mean"), F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("_between")
    )
    own = used.groupBy(*by).agg(F.sum(m2).alias("_within"))
    return means.join(own, by).select(*by, "n", "mean", (F.col("_within") + F.greatest(F.col("_between"), F.lit(0.0))).alias("m2"))
