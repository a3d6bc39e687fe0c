"""Every query of the engine against its SQL, on the small tables."""

import duckdb
import pytest

from maskwright.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def rows(values, columns):
    clean = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(clean(r[c]) for c in sorted(columns)) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, DIR)
    mine = rows(got.collect(), got.columns)
    if name in ORACLES:
        want = db.sql(ORACLES[name])
        assert sorted(got.columns) == sorted(want.columns)
        assert mine == rows([dict(zip(want.columns, r, strict=True)) for r in want.fetchall()], want.columns)


def test_limiter_refuses_the_fourth(spark):
    import datetime as dt

    from maskwright.plans.sessions import breaker, rate_limit

    at = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(i, s, at) for s in "ab" for i in range(4)], "request_id long, system_id string, ts timestamp")
    got = rate_limit(df, 3).orderBy("system_id", "request_id").collect()
    assert [r["allowed"] for r in got] == [True, True, True, False] * 2
    assert rate_limit(df, 0).where("allowed").count() == 8
    calls = spark.createDataFrame([(i, "s", at + dt.timedelta(seconds=s), False) for i, s in enumerate((0, 1, 2, 13))], "call_id long, service string, ts timestamp, success boolean")
    assert [r["state"] for r in breaker(calls, 2, 0.5, 10).orderBy("call_id").collect()] == ["closed", "closed", "open", "half_open"]


def test_bad_json_goes_nowhere(spark):
    from maskwright.plans.masking import mask_json
    from maskwright.queries import POLICY, SECRET

    r = mask_json(spark.createDataFrame([(None,), ("{",)], "body string"), ["$.a"], POLICY, SECRET).collect()
    assert all(x["masked"] is None and x["error"] for x in r)


def test_empty_and_null_texts(spark):
    from maskwright.plans.masking import demask_documents, mask_documents
    from maskwright.queries import POLICY, SECRET

    df = spark.createDataFrame([(1, None, "x"), (2, "", "y")], "doc_id long, text string, masked string")
    got = demask_documents(mask_documents(df, POLICY, SECRET)).orderBy("doc_id").collect()
    assert [r["demasked"] for r in got] == [None, ""]
    assert mask_documents(df.limit(0), POLICY, SECRET).count() == 0
