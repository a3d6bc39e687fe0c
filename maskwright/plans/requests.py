"""Explicit requests of many systems in one table: each row by its own policy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_tokens_col
from ..operators import masking
from ..operators.detectors import Lists
from ..sources.config import policies
from .masking import ENTITIES, ENTRIES, _with
from .policies import resolve_policies


def process(requests: DataFrame, cfg: dict, secret: bytes, vault: DataFrame | None = None, max_bytes: int = 2_000_000, lists: Lists | None = None) -> DataFrame:
    """requests (request_id, system_id, route_id, operation, text, session_id, dry_run) with result,
    entities, entries, restored, unresolved, tokens and error.

    Masking goes by the row's policy; a dry run leaves the text as it is. Demasking takes the
    session's mapping from vault (system_id, session_id, entries); a policy that forbids it, a
    session that isn't there, a text over max_bytes and an unknown operation are errors, and
    an error has no result.
    """
    lists, known = lists or Lists(), policies(cfg)
    spark = requests.sparkSession
    vault = vault if vault is not None else spark.createDataFrame([], f"system_id string, session_id string, entries {ENTRIES}")
    kept = vault.select(F.col("system_id").alias("_s"), F.col("session_id").alias("_i"), F.col("entries").alias("_kept"))
    d = resolve_policies(requests, cfg)
    d = d.join(kept, (F.col("operation") == "demask") & (F.col("system_id") == F.col("_s")) & (F.col("session_id") == F.col("_i")), "left")
    bad = F.when(F.col("error").isNotNull(), F.col("error")).when(F.octet_length("text") > max_bytes, "too_large").when(~F.col("operation").isin("mask", "demask") | F.col("operation").isNull(), "bad_operation")
    bad = bad.when((F.col("operation") == "demask") & ~F.col("demask"), "demask_forbidden").when((F.col("operation") == "demask") & F.col("_kept").isNull(), "session_not_found")
    d = d.withColumn("error", bad)

    def one(row: tuple) -> tuple:
        system, route, operation, text, dry, error, mapping = row
        if error is not None or text is None:
            return None, [], [], 0, 0
        if operation == "demask":
            out, restored, unresolved = masking.demask_text(text, mapping)
            return out, [], [], restored, unresolved
        m = masking.mask_text(text, known[system, route], lists, secret, dry_run=bool(dry))
        return m.text, m.entities, m.entries, 0, 0

    out = _with(d, {"result": "string", "entities": ENTITIES, "entries": ENTRIES, "restored": "long", "unresolved": "long"}, one, ["system_id", "route_id", "operation", "text", "dry_run", "error", "_kept"])
    return out.withColumn("tokens", count_tokens_col(F.col("text"))).drop("_s", "_i", "_kept", "types", "demask")


def responses(done: DataFrame) -> DataFrame:
    """request_id and body: the JSON answer, or the uniform error."""
    good = F.to_json(F.struct("request_id", "session_id", F.col("result").alias("text"), "entities", F.struct("tokens").alias("stats")))
    bad = F.to_json(F.struct(F.struct(F.col("error").alias("code"), F.col("request_id").cast("string").alias("request_id")).alias("error")))
    return done.select("request_id", F.when(F.col("error").isNull(), good).otherwise(bad).alias("body"))
