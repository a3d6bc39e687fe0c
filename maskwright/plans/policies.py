"""Requests meet their policies, routes and systems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Policy
from ..sources.config import policies, policy_for


def policy_table(spark: SparkSession, cfg: dict) -> DataFrame:
    """A row for each enabled system without a route and on each: what the configuration declares bounds it."""
    rows = [(s, r, sorted(p.types), dict(p.masks), p.demask) for (s, r), p in policies(cfg).items()]
    return spark.createDataFrame(rows, "system_id string, route_id string, types array<string>, masks map<string,string>, demask boolean")


def resolve_policies(requests: DataFrame, cfg: dict) -> DataFrame:
    """requests (system_id, route_id) with types, demask and error (unknown_system, system_disabled, unknown_route)."""
    spark = requests.sparkSession
    table = F.broadcast(policy_table(spark, cfg).select(F.col("system_id").alias("_s"), F.col("route_id").alias("_r"), "types", "demask"))
    errors = {s: policy_for(cfg, s) for s in cfg["systems"]}
    known = F.broadcast(spark.createDataFrame([(s, None if isinstance(p, Policy) else p) for s, p in errors.items()], "_k string, _e string"))
    out = requests.join(table, (F.col("system_id") == F.col("_s")) & F.col("route_id").eqNullSafe(F.col("_r")), "left").join(known, F.col("system_id") == F.col("_k"), "left")
    error = F.when(F.col("_k").isNull(), "unknown_system").when(F.col("_e").isNotNull(), F.col("_e")).when(F.col("_s").isNull(), "unknown_route")
    return out.withColumn("error", error).drop("_s", "_r", "_k", "_e")


def match_routes(requests: DataFrame, cfg: dict) -> DataFrame:
    """requests (method, path) with route_id and action of the first route that fits, by whole path or prefix.

    The routes of a configuration are few: they become one expression, and no request moves.
    """
    found = F.lit(None).cast("struct<route:string,action:string>")
    for r in reversed(cfg["routes"]):
        m = r["match"]
        fits = F.lit(False)
        if m.get("path") is not None:
            fits = fits | (F.col("path") == m["path"])
        if m.get("path_prefix") is not None:
            fits = fits | F.col("path").startswith(m["path_prefix"])
        found = F.when((F.col("method") == m["method"]) & fits, F.struct(F.lit(r["id"]).alias("route"), F.lit(r.get("action", "mask")).alias("action"))).otherwise(found)
    kept = [c for c in requests.columns if c not in ("route_id", "action")]
    return requests.withColumn("_r", found).select(*kept, F.col("_r.route").alias("route_id"), F.col("_r.action").alias("action"))


def apply_actions(requests: DataFrame) -> DataFrame:
    """requests (text, action) with step (mask, pass), outgoing text and error: a blocked request, and one
    without a route, go no further; a bypassed one goes out as it is; the text of the rest is yet to be masked."""
    error = F.when(F.col("action").isNull(), "no_route").when(F.col("action") == "block", "blocked")
    step = F.when(F.col("action") == "bypass", "pass").when(F.col("action") == "mask", "mask")
    return requests.withColumns({"step": step, "outgoing": F.when(F.col("action") == "bypass", F.col("text")), "error": error})


def swapped(requests: DataFrame, versions: list[tuple[int, dict]]) -> list[DataFrame]:
    """requests (ts long) dealt out by the configuration in force: (valid from, configuration), ascending.

    Each part is resolved by its own configuration, so a change takes effect between requests
    and never within one; requests before the first version have no policy.
    """
    out = []
    for i, (since, cfg) in enumerate(versions):
        until = versions[i + 1][0] if i + 1 < len(versions) else None
        mine = F.col("ts") >= since
        out.append(resolve_policies(requests.where(mine if until is None else mine & (F.col("ts") < until)), cfg))
    return out


def authenticate(requests: DataFrame, systems: DataFrame, default: str | None = None) -> DataFrame:
    """requests (api_key) with system_id by the key's SHA-256; without a key the default system."""
    keyed = requests.withColumn("_h", F.sha2("api_key", 256))
    found = keyed.join(F.broadcast(systems.select(F.col("key_sha256").alias("_k"), "system_id")), F.col("_h") == F.col("_k"), "left")
    return found.withColumn("system_id", F.when(F.col("api_key").isNull(), F.lit(default)).otherwise(F.col("system_id"))).drop("_h", "_k")
