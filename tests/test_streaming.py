"""The session vault as a stream, with a time to live."""

import datetime as dt
import uuid

from maskwright.queries import POLICY, SECRET
from maskwright.streaming.sessions import correlate


def test_steps_of_two_ids(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = dt.datetime(2024, 1, 1)
    steps = [("a", 1, "почта a@b.ru"), ("a", 2, "почта a@b.ru"), ("a", 3, "почта [EMAIL_1]"), ("a", 4, "вот EMAIL_1!"), ("b", 5, "чисто")]
    rows = [("crm-assistant", i, n, at + dt.timedelta(seconds=n), p) for i, n, p in steps]
    schema = "system_id string, payload_id string, request_id long, ts timestamp, payload string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    name = "s" + uuid.uuid4().hex[:8]
    q = correlate(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), POLICY, SECRET, 900).writeStream.format("memory").queryName(name).outputMode("append").trigger(once=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = {r["request_id"]: (r["outcome"], r["result"]) for r in spark.table(name).collect()}
    assert got == {1: ("masked", "почта [EMAIL_1]"), 2: ("repeated", "почта [EMAIL_1]"), 3: ("restored", "почта a@b.ru"), 4: ("restored", "вот a@b.ru!"), 5: ("masked", "чисто")}


def test_answers_go_to_files(spark):
    """As many answers as events: none stay in the driver, and the vault is read once for all rows of an id."""
    import pandas as pd

    from maskwright.operators.detectors import Lists
    from maskwright.queries import stream_vault
    from maskwright.streaming.sessions import SessionVault

    assert {r["outcome"] for r in stream_vault(spark, "/root/testdata/sf0.001").collect()} == {"masked", "repeated"}
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("stream_")]

    class Vault:
        value, calls = None, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

    p = SessionVault(POLICY, SECRET, Lists(), 0)
    p.vault = Vault()
    rows = pd.DataFrame({"ts": range(100), "request_id": range(100), "payload": ["почта a@b.ru", "[EMAIL_1]"] * 50})
    for calls in (2, 4):
        out = pd.concat(p.handleInputRows(("s", "i"), iter([rows[:60], rows[60:]]), None))
        assert p.vault.calls == calls and set(out["outcome"][2:]) == {"repeated", "restored"}


def test_sealed_contexts(spark):
    from pyspark.sql import functions as F

    from maskwright.plans.masking import mask_documents
    from maskwright.plans.sessions import seal, unseal

    df = spark.createDataFrame([("s1", "crm", "почта a@b.ru"), ("s2", "crm", "чисто")], "session_id string, system_id string, text string")
    sealed = seal(mask_documents(df, POLICY, SECRET), b"m" * 32).select("session_id", "system_id", "text", "mask_context")
    assert all(r["mapping"]["original"] == r["text"] for r in unseal(sealed, b"m" * 32).collect())
    for other in (sealed.withColumn("system_id", F.lit("x")), sealed.withColumn("session_id", F.lit("x")), sealed.withColumn("mask_context", F.lit("AAAA"))):
        assert all(r["mapping"] is None for r in unseal(other, b"m" * 32).collect())
