"""Sessions in batch: the correlated form, the vault table, stateless contexts, limits and breakers."""

from __future__ import annotations

import hashlib
import hmac

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.masking import demask_text
from ..operators.rules import Policy
from .masking import ENTRIES, mask_documents


def correlated_steps(steps: DataFrame, policy: Policy, secret: bytes) -> DataFrame:
    """steps (system_id, payload_id, ts, payload) with result and outcome.

    The first payload of an id is masked. Later ones: the original again gives the mask again,
    the mask gives the original, anything else is demasked. One numbering holds for an id.
    """
    key = ["system_id", "payload_id"]
    order = W.partitionBy(*key).orderBy("ts")
    numbered = steps.withColumn("_n", F.row_number().over(order))
    first = mask_documents(numbered.where("_n = 1").select(*key, F.col("payload").alias("text")), policy, secret)
    joined = numbered.join(first.select(*key, F.col("text").alias("_o"), F.col("masked").alias("_m"), F.col("entries").alias("_e")), key)

    @F.pandas_udf("string")
    def demask(texts: pd.Series, entries: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else demask_text(t, list(e))[0] for t, e in zip(texts, entries, strict=True)])

    outcome = F.when((F.col("_n") == 1) | ~F.lit(policy.demask), "masked").when(F.col("payload") == F.col("_o"), "repeated").otherwise("restored")
    result = F.when(F.col("outcome").isin("masked", "repeated"), F.col("_m")).when(F.col("payload") == F.col("_m"), F.col("_o")).otherwise(demask("payload", "_e"))
    return joined.withColumn("outcome", outcome).withColumn("result", result).drop("_n", "_o", "_m", "_e")


def session_key(master: bytes, session: str, system: str) -> bytes:
    """HKDF-SHA256 (RFC 5869): salt the session, info the system, 32 bytes."""
    prk = hmac.new(session.encode(), master, hashlib.sha256).digest()
    return hmac.new(prk, system.encode() + b"\x01", hashlib.sha256).digest()


def _keys(master: bytes):
    @F.pandas_udf("binary")
    def keys(session: pd.Series, system: pd.Series) -> pd.Series:
        return pd.Series([session_key(master, a, b) for a, b in zip(session, system, strict=True)])

    return keys


def mapping_json(entries: Column, original: Column, masked: Column) -> Column:
    return F.to_json(F.struct(entries.alias("entries"), original.alias("original"), masked.alias("masked")))


def seal(df: DataFrame, master: bytes, entries: str = "entries", original: str = "text", masked: str = "masked") -> DataFrame:
    """df (session_id, system_id and a mapping's parts) with mask_context: the mapping under AES-256-GCM, base64.

    The nonce is random and leads the bytes; the system is authenticated with them.
    """
    keyed = df.withColumn("_key", _keys(master)("session_id", "system_id"))
    sealed = F.expr("base64(aes_encrypt(cast(_json as binary), _key, 'GCM', 'DEFAULT', cast('' as binary), cast(system_id as binary)))")
    return keyed.withColumn("_json", mapping_json(F.col(entries), F.col(original), F.col(masked))).withColumn("mask_context", sealed).drop("_key", "_json")


def unseal(df: DataFrame, master: bytes) -> DataFrame:
    """df (session_id, system_id, mask_context) with mapping (entries, original, masked); null if it isn't theirs."""
    keyed = df.withColumn("_key", _keys(master)("session_id", "system_id"))
    plain = F.expr("cast(try_aes_decrypt(unbase64(mask_context), _key, 'GCM', 'DEFAULT', cast(system_id as binary)) as string)")
    return keyed.withColumn("mapping", F.from_json(plain, f"entries {ENTRIES}, original string, masked string")).drop("_key")


def vault_latest(puts: DataFrame, now: Column, ttl_seconds: int = 900, capacity: int | None = None) -> DataFrame:
    """The vault as a table: of each (system_id, session_id) the last mapping put, unless it is too old or deleted.

    With a capacity, only so many sessions stay, those put last (ties by system and session).
    """
    last = puts.groupBy("system_id", "session_id").agg(F.max_by(F.struct("mapping", "ts"), "ts").alias("v"))
    live = last.where(F.col("v.mapping").isNotNull() & (F.col("v.ts") + F.make_interval(secs=F.lit(ttl_seconds)) > now))
    if capacity is not None:
        live = live.orderBy(F.desc("v.ts"), "system_id", "session_id").limit(capacity)
    return live.select("system_id", "session_id", "v.mapping")


def deletions(answers: DataFrame) -> DataFrame:
    """Puts (system_id, session_id, ts, null mapping) that delete the sessions whose demasking has succeeded."""
    done = answers.where((F.col("operation") == "demask") & F.col("error").isNull())
    return done.groupBy("system_id", "session_id").agg(F.max("ts").alias("ts")).withColumn("mapping", F.lit(None).cast("string"))


def rate_limit(requests: DataFrame, rps: int) -> DataFrame:
    """requests (system_id, ts) with allowed and wait_s, by a token bucket for each system.

    A bucket holds rps tokens, full at first, and gains rps a second. 0: no limit. Equal times
    stand in the order of request_id. The fold needs a system's requests in order: rows reach
    it sorted, as an iterator of batches, so a large system takes time, but no memory. A system is
    one task, as each answer depends on the one before; a limit by client splits it: give the
    system and the client, as one text, for system_id.
    """
    if rps == 0:
        return requests.withColumns({"allowed": F.lit(True), "wait_s": F.lit(0.0)})

    def fold(parts):
        state: dict[str, tuple[float, float]] = {}
        for p in parts:
            allowed, wait = [], []
            for s, t in zip(p["system_id"], p["_t"], strict=True):
                tokens, last = state.get(s, (float(rps), t))
                tokens = min(float(rps), tokens + (t - last) * rps)
                ok = tokens >= 1
                state = {s: (tokens - ok, t)}  # rows of a system follow one another
                allowed.append(bool(ok))
                wait.append(0.0 if ok else (1 - tokens) / rps)
            yield p.drop(columns="_t").assign(allowed=allowed, wait_s=wait)

    schema = requests.withColumns({"allowed": F.lit(True), "wait_s": F.lit(0.0)}).schema
    timed = requests.withColumn("_t", F.unix_micros("ts") / 1e6)
    return timed.repartition("system_id").sortWithinPartitions("system_id", "ts", "request_id").mapInPandas(fold, schema)


def breaker(calls: DataFrame, window: int = 20, ratio: float = 0.5, open_seconds: int = 10) -> DataFrame:
    """calls (service, ts, success) with state before the call (closed, open, half_open) and allowed.

    Each window calls that went through are judged together; if the share that failed reaches
    ratio, the breaker opens. After open_seconds it is half open and lets all pass; it never
    closes again, and opens anew by the same rule. A service is one task, as each state depends
    on the one before; its rows pass as a sorted stream.
    """

    def fold(parts):
        key, state, total, failed, opened = None, "closed", 0, 0, 0.0
        for p in parts:
            states, allowed = [], []
            for k, t, ok in zip(p["service"], p["_t"], p["success"], strict=True):
                if k != key:
                    key, state, total, failed, opened = k, "closed", 0, 0, 0.0
                if state == "open" and t - opened >= open_seconds:
                    state = "half_open"
                states.append(state)
                allowed.append(state != "open")
                if state != "open":
                    total, failed = total + 1, failed + (not ok)
                    if total >= window:
                        if failed / total >= ratio:
                            state, opened = "open", t
                        total = failed = 0
            yield p.drop(columns="_t").assign(state=states, allowed=allowed)

    schema = calls.withColumns({"state": F.lit(""), "allowed": F.lit(True)}).schema
    timed = calls.withColumn("_t", F.unix_micros("ts") / 1e6)
    return timed.repartition("service").sortWithinPartitions("service", "ts", "call_id").mapInPandas(fold, schema)
