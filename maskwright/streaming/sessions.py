"""The correlated form as a stream: a mapping for each (system, payload_id), kept for its time to live."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.detectors import Lists
from ..operators.masking import demask_text, mask_text
from ..operators.rules import Policy

SCHEMA = "system_id string, payload_id string, request_id long, outcome string, result string"


class SessionVault(StatefulProcessor):
    """Masks an id's first payload and keeps what restores it; answers later ones from that."""

    def __init__(self, policy: Policy, secret: bytes, lists: Lists, ttl_seconds: int):
        self.policy, self.secret, self.lists, self.ttl = policy, secret, lists, ttl_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        schema = StructType([StructField("mapping", StringType())])
        self.vault = handle.getValueState("vault", schema, self.ttl * 1000 if self.ttl else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        todo = pd.concat(list(rows)).sort_values(["ts", "request_id"])
        # The state is a process away: it is read once for all rows, and written when it changes.
        kept = json.loads(self.vault.get()[0]) if self.policy.demask and self.vault.exists() else None
        out, changed = [], False
        for payload in todo["payload"].tolist():
            if kept is None or not self.policy.demask:
                m = mask_text(payload, self.policy, self.lists, self.secret)
                kept, changed = {"original": payload, "masked": m.text, "entries": m.entries}, True
                out.append(("masked", m.text))
            elif payload == kept["original"]:
                out.append(("repeated", kept["masked"]))
            elif payload == kept["masked"]:
                out.append(("restored", kept["original"]))
            else:
                out.append(("restored", demask_text(payload, kept["entries"])[0]))
        if changed:
            self.vault.update((json.dumps(kept),))
        yield pd.DataFrame({"system_id": key[0], "payload_id": key[1], "request_id": todo["request_id"].to_numpy(), "outcome": [o for o, _ in out], "result": [t for _, t in out]})

    def close(self) -> None:
        pass


def correlate(stream: DataFrame, policy: Policy, secret: bytes, ttl_seconds: int = 900, lists: Lists | None = None) -> DataFrame:
    """stream (system_id, payload_id, request_id, ts, payload) to outcome and result of each request.

    Needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass). With a time to
    live, use the once or processing-time trigger: availableNow doesn't end.
    """
    return stream.groupBy("system_id", "payload_id").transformWithStateInPandas(
        statefulProcessor=SessionVault(policy, secret, lists or Lists(), ttl_seconds), outputStructType=SCHEMA, outputMode="Append", timeMode="ProcessingTime" if ttl_seconds else "None"
    )
