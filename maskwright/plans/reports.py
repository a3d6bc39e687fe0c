"""Counters, percentiles, quality and load reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def entity_counts(entities: DataFrame) -> DataFrame:
    return entities.groupBy(F.col("type").alias("pd_type"), "source").agg(F.count("*").alias("entities"))


def leak_counts(leaks: DataFrame) -> DataFrame:
    """How often each type was still seen after masking, of masking.leaks() of one table or of several."""
    return leaks.groupBy("pd_type").agg(F.sum("leaks").alias("leaks"))


def degraded_counts(requests: DataFrame) -> DataFrame:
    """Requests (degraded, reason) that were answered with less than was asked, by reason."""
    return requests.where("degraded").groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("requests"))


def request_counters(requests: DataFrame) -> DataFrame:
    """Requests by system, route, operation and status, with tokens and the exact 50th, 95th and 99th percentile of latency."""
    p = lambda q: F.percentile("latency_ms", F.lit(q))
    return requests.groupBy("system_id", "route_id", "operation", "status").agg(F.count("*").alias("requests"), F.sum("tokens").alias("tokens"), p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"))


def to_prometheus(counters: DataFrame, name: str, labels: list[str], value: str) -> DataFrame:
    """One line of exposition text for each row."""
    pairs = F.concat_ws(",", *[F.concat(F.lit(f'{c}="'), F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"')) for c in labels])
    return counters.select(F.concat(F.lit(name + "{"), pairs, F.lit("} "), F.col(value).cast("string")).alias("line"))


def quality(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Precision, recall and F1 by type and overall ('all'), matches by exact document, type and span, one to one."""
    key = ["doc_id", "pd_type", "start", "end"]
    ranked = lambda d: d.select(*key).withColumn("nth", F.row_number().over(W.partitionBy(*key).orderBy("doc_id")))
    both = ranked(found).withColumn("f", F.lit(1)).join(ranked(expected).withColumn("e", F.lit(1)), [*key, "nth"], "full_outer")
    counts = both.rollup("pd_type").agg(F.count_if(F.col("f").isNotNull() & F.col("e").isNotNull()).alias("tp"), F.count_if(F.col("e").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6)).otherwise(F.lit(0.0))
    return counts.select(F.coalesce("pd_type", F.lit("all")).alias("pd_type"), "tp", "fp", "fn", share(tp, tp + fp).alias("precision"), share(tp, tp + fn).alias("recall"), share(2 * tp, 2 * tp + fp + fn).alias("f1"))


def category_rates(results: DataFrame) -> DataFrame:
    """Of successful answers by category: the share that was changed, and that came back exactly."""
    ok = F.col("ok")
    return results.groupBy("category").agg(F.count_if(ok).alias("ok"), F.avg(F.when(ok, (F.col("masked") != F.col("text")).cast("int"))).alias("masked_rate"), F.avg(F.when(ok, (F.col("demasked") == F.col("text")).cast("int"))).alias("restored_rate"))


def step_report(results: DataFrame, by: str) -> DataFrame:
    q = lambda x: F.percentile("latency_ms", F.lit(x))
    return results.groupBy(by).agg(F.count("*").alias("sent"), F.avg(F.col("ok").cast("int")).alias("ok_rate"), q(0.5).alias("p50"), q(0.9).alias("p90"), q(0.99).alias("p99"), q(0.999).alias("p999"), F.max("latency_ms").alias("max"), F.avg("latency_ms").alias("mean"))


def verdict(report: DataFrame, ok_rate: float = 0.99, p99_ms: float = 1000.0) -> DataFrame:
    return report.withColumn("passed", (F.col("ok_rate") >= ok_rate) & (F.col("p99") <= p99_ms))


def runs(rows: DataFrame, invalid: Column, neutral: Column, by: str, order: list[str]) -> DataFrame:
    """The longest run of invalid answers of each group; neutral ones neither count nor break a run."""
    w = W.partitionBy(by).orderBy(*order)
    seen = rows.where(~neutral).withColumn("_i", invalid.cast("int")).withColumn("_g", F.sum(1 - F.col("_i")).over(w))
    each = seen.groupBy(by, "_g").agg(F.sum("_i").alias("n"))
    return each.groupBy(by).agg(F.max("n").alias("longest_run"))
