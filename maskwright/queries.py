"""The engine's queries by name, and DuckDB SQL with the same results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .functions import validators as V
from .operators import masking
from .operators import patterns as P
from .operators.detectors import DETECTORS, Candidate, Lists, config_regex
from .operators.rules import Policy, Rule, combine, resolve
from .plans import masking as M
from .plans import policies as PL
from .plans import reports as R
from .plans import sessions as S
from .sources.config import DEFAULT, policy_for
from .sources.shared import Scratch

SECRET = b"a test key of no worth at all...."
POLICY = policy_for(DEFAULT, "crm-assistant")
ANY = Policy(types=frozenset(t for group in DETECTORS.values() for kinds, _ in group for t in kinds), thresholds={}, filters=("none",))

#: Texts with what is to be found in them as [[TYPE|value]], by the detector that finds it.
MARKED = (
    ("card_number", "Оплата картой [[CARD_NUMBER|4276 5500 1234 5677]] или [[CARD_NUMBER|4532015112830366]], номер 4532015112830367 неверен"),
    ("cvv", "cvv2: [[CVV|123]], код безопасности [[CVV|4321]]"),
    ("pin", "пин-код [[PIN|4321]] и pin [[PIN|987654]]"),
    ("card_holder", "Имя держателя карты [[CARD_HOLDER|ANNA PETROVA]]"),
    ("inn", "инн [[INN|500100732259]], а также [[ORG_INN|7707083893]] для сверки"),
    ("passport", "паспорт [[PASSPORT|4509 123456]] проверен"),
    ("division_code", "код подразделения [[DIVISION_CODE|770-053]] верен"),
    ("phone", "Телефон [[PHONE|8 912 345-67-89]], офис [[PHONE|8 (495) 987-65-43]], за границей [[PHONE|+44 20 7946 0958]]"),
    ("email", "Пишите на [[EMAIL|Anna.K@Example.com]] или [[EMAIL|b_1@mail.ru]] сегодня"),
    ("snils", "снилс [[SNILS|112-233-445 95]] принят"),
    ("date", "Дата рождения [[BIRTH_DATE|31.12.1990]] в анкете, договор подписан в офисе номер шесть позднее, затем [[DATE|2024-02-29]]"),
    ("date", "Клиент родился [[BIRTH_DATE|05 марта 1985 года]]"),
    ("numeral_date", "[[DATE|пятого мая]]"),
    ("address", "[[ADDRESS|[[ADDR_CITY|г. Москва]], [[ADDR_STREET|ул. Ленина]], [[ADDR_HOUSE|д. 5]], [[ADDR_FLAT|кв. 10]]]]"),
    ("citizenship", "гражданство: [[CITIZENSHIP|Казахстан]], резидент"),
    ("fio", "Звонил [[FIO|Иванов Иван Иванович]] и [[FIO|Петрова А.С.]]"),
    ("driver_license", "водительское удостоверение [[DRIVER_LICENSE|77 АА 123456]] действует"),
    ("birth_place", "Место рождения [[BIRTH_PLACE|г. Казань]], запись"),
    ("passport_issuer", "выдан 15.03.2015 [[PASSPORT_ISSUER|ОУФМС России по гор. Москве]], лично"),
    ("structured_field", '{"email": "[[EMAIL|a@b.ru]]", "name": "[[FIO|Анна]]"}'),
)


def unmark(marked: str) -> tuple[str, list[tuple[str, int, int]]]:
    """The text, and the marked spans in bytes."""
    out, spans, open_ = b"", [], []
    for part in re.split(r"(\[\[[A-Z_]+\||\]\])", marked):
        if part.startswith("[["):
            open_.append((part[2:-1], len(out)))
        elif part == "]]":
            kind, at = open_.pop()
            spans.append((kind, at, len(out)))
        else:
            out += part.encode()
    return out.decode(), spans


def _q(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple], names: list[str], kinds: list[str]) -> str:
    """SQL of a table of literals; kinds: s text, i bigint, d double, b boolean, n int."""
    cast = {"s": "VARCHAR", "i": "BIGINT", "d": "DOUBLE", "b": "BOOLEAN", "n": "INTEGER"}
    body = ", ".join("(" + ", ".join(_q(v) if isinstance(v, str) or v is None else str(v) for v in r) + ")" for r in rows)
    return f"SELECT {', '.join(f'CAST({n} AS {cast[k]}) AS {n}' for n, k in zip(names, kinds, strict=True))} FROM (VALUES {body}) AS t({', '.join(names)})"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")


def _fixture(spark: SparkSession, name: str) -> DataFrame:
    rows = [(i, unmark(m)[0]) for i, (n, m) in enumerate(MARKED) if n == name]
    return spark.createDataFrame(rows, "text_id long, text string")


def _detect_fixture(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        def one(row: tuple) -> tuple:
            doc = T.Document(row[0])
            found = [c for kinds, run in DETECTORS[name] for c in run(doc, Lists())]
            return ([{"pd_type": c.pd_type, "start": c.start, "end": c.end} for c in found],)

        found = M._with(_fixture(spark, name), {"found": "array<struct<pd_type:string,start:long,end:long>>"}, one, ["text"])
        return found.select("text_id", F.explode("found").alias("f")).select("text_id", "f.pd_type", "f.start", "f.end")

    return query


def _spans_query(spans):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return _docs(spark, d).select("doc_id", F.explode(spans(F.col("text"))).alias("m")).select("doc_id", "m.start", "m.end", "m.value")

    return query


def _spans_sql(regex: str, gate: str, keep: str = "TRUE") -> str:
    """All matches with places: text between them and matches before them, summed."""
    p = _q(regex)
    return f"""
    WITH t AS (SELECT doc_id, lower(text) AS n FROM documents WHERE regexp_matches(lower(text), {_q(gate)})),
    m AS (SELECT doc_id, n, regexp_extract_all(n, {p}) AS v, regexp_split_to_array(n, {p}) AS g FROM t),
    e AS (SELECT doc_id, n, v, g, unnest(range(1, len(v) + 1)) AS i FROM m),
    s AS (SELECT doc_id, n, v[i] AS value, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS pos FROM e),
    b AS (SELECT doc_id, value, n, CAST(pos AS BIGINT) AS pos, substr(n, CAST(pos AS BIGINT), 1) AS before, substr(n, CAST(pos AS BIGINT) + length(value) + 1, 1) AS after FROM s)
    SELECT doc_id, CAST(strlen(substr(n, 1, pos)) AS BIGINT) AS start, CAST(strlen(substr(n, 1, pos)) + strlen(value) AS BIGINT) AS "end", value
    FROM b WHERE NOT (pos > 0 AND regexp_matches(before, '[0-9A-Za-z]')) AND NOT regexp_matches(after, '[0-9A-Za-z]|[^\\x00-\\x7F]') AND {keep}"""


_LUHN = """(length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(regexp_replace(value, '[^0-9]', '', 'g')) + 1),
    lambda k: CASE WHEN k % 2 = 1 THEN CAST(substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), k, 1) AS INT)
    ELSE (2 * CAST(substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), k, 1) AS INT)) // 10 + (2 * CAST(substr(reverse(regexp_replace(value, '[^0-9]', '', 'g')), k, 1) AS INT)) % 10 END)) % 10 = 0)"""

def gate_docs(spark, d):
    return _docs(spark, d).select("doc_id", F.coalesce(T.has_signal_col(F.col("text")), F.lit(False)).alias("scan"))


def token_count_docs(spark, d):
    return _docs(spark, d).select("doc_id", T.count_tokens_col(F.col("text")).alias("tokens"))


NORMAL = (("серия — 45–09 «тест»", 'серия - 45-09 "тест"'), ("Ёлка ЁЖ", "елка еж"), ("A B\tC", "a b c"), ("Ⅳ ﬁ", "iv fi"), ("plain", "plain"))


def normalize_texts(spark, d):
    rows = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NORMAL)], "id long, text string")
    return M._with(rows, {"norm": "string"}, lambda r: (T.Document(r[0]).norm,), ["text"]).select("id", "norm")


def offsets_texts(spark, d):
    rows = spark.createDataFrame([(0, "a—b"), (1, "№1"), (2, "İx")], "id long, text string")
    return M._with(rows, {"offsets": "string"}, lambda r: (",".join(map(str, T.Document(r[0]).offset_map())),), ["text"]).select("id", "offsets")


NUMBERS = ("4532015112830366", "4532015112830367", "4276550012345677", "7707083893", "7707083894", "500100732259", "11223344595", "11223344596", "123")


def _numbers(spark):
    return spark.createDataFrame([(x,) for x in NUMBERS], "value string")


def validate_numbers(spark, d):
    v = F.col("value")
    return _numbers(spark).select("value", F.coalesce(V.luhn_col(v), F.lit(False)).alias("luhn"), F.coalesce(V.inn_col(v), F.lit(False)).alias("inn"), F.coalesce(V.snils_col(v), F.lit(False)).alias("snils"))


def _weights(w):
    return " + ".join(f"{k} * CAST(substr(value, {i + 1}, 1) AS INT)" for i, k in enumerate(w))


_NUMBERS_SQL = f"""SELECT value, {_LUHN} AS luhn,
  CASE length(value) WHEN 10 THEN ({_weights(V.INN10)}) % 11 % 10 = CAST(substr(value, 10, 1) AS INT)
    WHEN 12 THEN ({_weights(V.INN12A)}) % 11 % 10 = CAST(substr(value, 11, 1) AS INT) AND ({_weights(V.INN12B)}) % 11 % 10 = CAST(substr(value, 12, 1) AS INT) ELSE FALSE END AS inn,
  CASE WHEN length(value) = 11 THEN ({_weights(V.SNILS)}) % 101 % 100 = CAST(substr(value, 10, 2) AS INT) ELSE FALSE END AS snils
  FROM (VALUES {", ".join(f"('{x}')" for x in NUMBERS)}) AS t(value)"""


def validate_order_dates(spark, d):
    """Dates of orders as text, with their months put out of range for some."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    odd = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("31."), F.date_format("o_orderdate", "MM.yyyy")))
    return o.groupBy(V.date_col(odd).alias("valid")).agg(F.count("*").alias("n"))


SERIES = (("4509", True), ("0012", False), ("4597", True), ("4560", False), ("451", False))


def validate_series(spark, d):
    rows = spark.createDataFrame([(s,) for s, _ in SERIES], "series string")
    return rows.select("series", V.passport_series_col(F.col("series")).alias("valid"))


NUMERALS = (("пятого", 5), ("тысяча девятьсот восемьдесят пятого", 1985), ("две тысячи третьего", 2003), ("тридцать первого", 31), ("не число", None))


def parse_numerals(spark, d):
    rows = spark.createDataFrame([(t,) for t, _ in NUMERALS], "words string")
    return M._with(rows, {"value": "long"}, lambda r: (V.parse_numerals(r[0].split(), P.NUMERALS),), ["words"])


FILTERED = (
    ("Памятник Александру Сергеевичу Пушкину", "public_persons", 0),
    ("Клиент Пушкин Иван Сергеевич, паспорт 4509 123456", "public_persons", 1),
    ("Отделение банка, телефон горячей линии 8 800 200-00-00", "bank_allowlist", 0),
    ("Позвоните мне: телефон 8 912 345-67-89", "bank_allowlist", 1),
    ("ооо Иванов Иван Иванович", "org_context", 0),
    ("Иванов Иван Иванович сам", "org_context", 1),
    ("договор 8 912 345-67-89", "negative_number_context", 0),
    ("звонок 8 912 345-67-89", "negative_number_context", 1),
)


def relevance_filters(spark, d):
    from .operators.detectors import detect
    from .operators.rules import relevant

    kinds = {"public_persons": {"FIO"}, "org_context": {"FIO"}}

    def one(row):
        doc = T.Document(row[0])
        policy = Policy(types=ANY.types, filters=(row[1],))
        kept = relevant(doc, detect(doc, ANY.types, Lists()), policy, Lists())
        return (int(any(c.pd_type in kinds.get(row[1], {"PHONE"}) for c in kept)),)

    rows = spark.createDataFrame([(i, t, f) for i, (t, f, _) in enumerate(FILTERED)], "id long, text string, filter string")
    return M._with(rows, {"kept": "long"}, one, ["text", "filter"]).select("id", "filter", "kept")


OVERLAPS = ((0, "PHONE", 0, 12, 0.9, False), (0, "CARD_NUMBER", 5, 24, 0.95, True), (0, "DATE", 30, 40, 0.95, False), (1, "INN", 0, 12, 0.85, True), (1, "PHONE", 2, 12, 0.9, False), (2, "FIO", 0, 10, 0.8, False), (2, "FIO", 4, 20, 0.8, False), (2, "EMAIL", 19, 30, 0.5, False))


def resolve_overlaps(spark, d):
    def fold(parts):
        import pandas as pd

        for p in parts:
            out = []
            for k, g in p.groupby("doc_id"):
                kept = resolve([Candidate(r.pd_type, r.start, r.end, r.score, "regex", "x", checksum_ok=r.ok) for r in g.itertuples(index=False)], POLICY)
                out += [(k, c.pd_type, c.start, c.end) for c in kept]
            yield pd.DataFrame(out, columns=["doc_id", "pd_type", "start", "end"])

    rows = spark.createDataFrame([(*r[:6],) for r in OVERLAPS], "doc_id long, pd_type string, start long, end long, score double, ok boolean").coalesce(1)
    return rows.mapInPandas(fold, "doc_id long, pd_type string, start long, end long")


COMBINED = ((0, "PIN", 10), (1, "PIN", 10), (1, "CARD_NUMBER", 30), (2, "CVV", 10), (2, "CARD_NUMBER", 500), (3, "CVV", 10), (3, "CARD_NUMBER", 60))


def combination_rules(spark, d):
    """Relational form: an entity's rule is a band join with the others of its document."""
    e = spark.createDataFrame(COMBINED, "doc_id long, pd_type string, start long")
    rules = F.broadcast(spark.createDataFrame([("PIN", "CARD_NUMBER", 1 << 40), ("CVV", "CARD_NUMBER", 200)], "pd_type string, needs string, window long"))
    other = e.select("doc_id", F.col("pd_type").alias("other"), F.col("start").alias("at"))
    ruled = e.join(rules, "pd_type", "left").join(other, "doc_id")
    fits = (F.col("other") == F.col("needs")) & (F.abs(F.col("at") - F.col("start")) <= F.col("window"))
    return ruled.groupBy("doc_id", "pd_type", "start").agg(F.bool_or(F.col("needs").isNull() | fits).alias("ok")).where("ok").drop("ok")


def _folded(spark, rows, policy: Policy):
    """rows (doc_id, pd_type, start) that the engine's rules leave, document by document."""
    of = spark.createDataFrame(rows, "doc_id long, pd_type string, start long").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "pd_type"))).alias("found"))
    one = lambda r: ([{"pd_type": c.pd_type, "start": c.start} for c in combine([Candidate(x["pd_type"], x["start"], x["start"] + 3, 0.9, "regex", "x") for x in r[0]], policy)],)
    return M._with(of, {"kept": "array<struct<pd_type:string,start:long>>"}, one, ["found"]).select("doc_id", F.explode("kept").alias("k")).select("doc_id", "k.pd_type", "k.start")


def combination_fold(spark, d):
    """The same rules as the engine applies them, document by document."""
    return _folded(spark, COMBINED, Policy(types=ANY.types, rules={"PIN": Rule(("CARD_NUMBER",)), "CVV": Rule(("CARD_NUMBER",), scope="window", window=200)}))


FEW = ((0, "EMAIL", 0), (1, "EMAIL", 0), (1, "PHONE", 40), (2, "CARD_NUMBER", 5), (2, "CARD_NUMBER", 50), (3, "EMAIL", 0), (3, "EMAIL", 30))


def distinct_types_fold(spark, d):
    """Fewer than two types in a document: only those always masked stay."""
    return _folded(spark, FEW, Policy(types=ANY.types, min_distinct_types=2, always_mask=("CARD_NUMBER",)))


VALUES = (("EMAIL", "Anna.K@Example.com"), ("CARD_NUMBER", "4532 0151 1283 0366"), ("PHONE", "+7 912 345-67-89"), ("FIO", "Иванов  Иван"))


def _hmac_sql(data: str) -> str:
    key = SECRET.ljust(64, b"\0")
    inner, outer = bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({data}))))[1:8]"


_CANON = "CASE WHEN pd_type IN ('CARD_NUMBER', 'PHONE') THEN regexp_replace(value, '[^0-9]', '', 'g') WHEN pd_type = 'FIO' THEN regexp_replace(lower(value), ' +', ' ', 'g') ELSE lower(value) END"


def mask_kinds(spark, d):
    rows = spark.createDataFrame(VALUES, "pd_type string, value string")

    def one(row):
        e = Candidate(row[0], 0, len(row[1].encode()), 1.0, "regex", "x")
        return tuple(masking.mask_value(e, row[1], Policy(types=ANY.types, masks={row[0]: k}), masking.State(), SECRET)[0] for k in ("redact", "partial", "token", "hash"))

    return M._with(rows, dict.fromkeys(("redact", "partial", "token", "hash"), "string"), one, ["pd_type", "value"])


_MASKS_SQL = f"""SELECT pd_type, value, repeat('*', length(value)) AS redact,
  regexp_replace(substr(value, 1, length(value) - 4), '[0-9]', '*', 'g') || substr(value, length(value) - 3) AS "partial",
  'tok_' || pd_type || '_' || {_hmac_sql(f"pd_type || '|' || {_CANON}")} AS token, 'sha256:' || sha256({_CANON}) AS hash
  FROM (VALUES {", ".join(f"({_q(a)}, {_q(b)})" for a, b in VALUES)}) AS t(pd_type, value)"""


def mask_synthetic(spark, d):
    rows = spark.createDataFrame([(t, masking.synthetic(SECRET, t, v)) for t, v in (("CARD_NUMBER", "1"), ("INN", "2"), ("PHONE", "3"), ("FIO", "4"), ("EMAIL", "5"))], "pd_type string, made string")
    made = F.col("made")
    fine = F.when(F.col("pd_type") == "CARD_NUMBER", V.luhn_col(made)).when(F.col("pd_type") == "INN", V.inn_col(made)).when(F.col("pd_type") == "PHONE", made.rlike(r"^\+7 \(\d{3}\) \d{3}-\d{2}-\d{2}$")).when(F.col("pd_type") == "FIO", made.rlike("^[А-Я][а-я]+ [а-я]+$")).otherwise(made.rlike("^synth_[0-9a-f]{8}$"))
    return rows.select("pd_type", fine.alias("well_formed"))


def mask_full_docs(spark, d):
    """Flagship: all documents masked by the strict policy."""
    m = M.mask_documents(_docs(spark, d), POLICY, SECRET)
    return m.select("doc_id", "masked", F.to_json("entities").alias("entities"), F.size("entities").cast("long").alias("n"))


def mask_emails_cards(spark, d):
    """By document: how many emails and cards the engine masks."""
    m = M.explode_entities(M.mask_documents(_docs(spark, d), POLICY, SECRET), "doc_id")
    return m.where(F.col("type").isin("EMAIL", "CARD_NUMBER")).groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def demask_roundtrip(spark, d):
    m = M.demask_documents(M.mask_documents(_docs(spark, d), Policy(types=POLICY.types, labels=POLICY.labels, thresholds=POLICY.thresholds, priorities=POLICY.priorities), SECRET))
    return m.select("doc_id", F.sha2("demasked", 256).alias("sha"))


TOLERANT = (("Клиент [ФИО_1] живёт", "Клиент Иванов живёт", 1, 0), ("Клиент ФИО_1", "Клиент Иванов", 1, 0), ("<ФИО 1> и [ФИО_9]", "Иванов и [ФИО_9]", 1, 1), ("карта ****0366", "карта 45320366", 1, 0))


def demask_tolerant(spark, d):
    entries = [("ФИО_1", "FIO", "Иванов", None), ("CARD_NUMBER_p1", "CARD_NUMBER", "45320366", "****0366")]
    rows = spark.createDataFrame([(i, t, entries) for i, (t, *_) in enumerate(TOLERANT)], f"id long, masked string, entries {M.ENTRIES}")
    return M.demask_documents(rows).select("id", "demasked", "restored", "unresolved")


def selfcheck_leaks(spark, d):
    return M.leaks(M.mask_documents(_docs(spark, d), POLICY, SECRET), POLICY)


CHAT = '{"messages":[{"role":"user","content":"почта a@b.ru"},{"role":"user","content":[{"type":"text","text":"карта 4532015112830366"}]}],"model":"m"}'


def json_extract_chat(spark, d):
    rows = spark.createDataFrame([(0, CHAT)], "id long, body string")
    return M.extract_json(rows, "$.messages[*].content").select("id", F.explode("strings").alias("value"))


def json_mask_chat(spark, d):
    rows = spark.createDataFrame([(0, CHAT), (1, "not json")], "id long, body string")
    return M.mask_json(rows, DEFAULT["routes"][0]["request"], POLICY, SECRET).select("id", "masked")


def json_roundtrip_chat(spark, d):
    rows = spark.createDataFrame([(0, CHAT)], "id long, body string")
    paths = DEFAULT["routes"][0]["request"]
    m = M.mask_json(rows, paths, POLICY, SECRET).select("id", "entries", F.col("masked").alias("body"))
    return M.demask_json(m, paths).select("id", "demasked")


def mask_batch(spark, d):
    rows = spark.createDataFrame([(7, ["почта a@b.ru", "чисто", "почта c@d.ru"])], "request_id long, texts array<string>")
    out = M.mask_batch(rows, POLICY, SECRET)
    return out.select("request_id", F.explode("results").alias("r")).select("request_id", F.col("r.index").cast("long").alias("index"), "r.masked")


BATCHES = ((1, "crm-assistant", ("почта a@b.ru",)), (2, "crm-assistant", ()), (3, "crm-assistant", None), (4, None, ("почта a@b.ru",)), (5, "crm-assistant", (None, "чисто", "")))


def batch_edges(spark, d):
    """Batches that are empty, null, anonymous, or hold a null text: none is lost."""
    rows = spark.createDataFrame([(i, s, None if t is None else list(t)) for i, s, t in BATCHES], "request_id long, system_id string, texts array<string>")
    out = M.mask_batch(rows, POLICY, SECRET)
    items = F.array_join(F.transform("results", lambda r: F.coalesce(r["error"], r["masked"])), "|")
    return out.select("request_id", items.alias("items"), "error")


#: Texts with characters that change places or bytes when normalised, and the emails in them by bytes.
FOLDING = (("— почта a@b.ru", 15, 21), ("«x» a@b.ru", 6, 12), ("İ a@b.ru", 3, 9), ("ｅ a@b.ru", 4, 10), ("ёж a@b.ru", 5, 11), ("ﬁ\ta@b.ru", 4, 10), ("ÀÉ a@b.ru", 5, 11))


def detect_email_folding(spark, d):
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(FOLDING)], "text_id long, text string")
    return rows.select("text_id", F.explode(M.email_spans(F.col("text"))).alias("m")).select("text_id", "m.start", "m.end", "m.value")


def mask_redacted_docs(spark, d):
    """All documents with their emails starred out: what splicing makes of the whole text."""
    policy = Policy(types=frozenset(("EMAIL",)), masks={"EMAIL": "redact"}, thresholds={}, filters=("none",))
    return M.mask_documents(_docs(spark, d), policy, SECRET).select("doc_id", F.sha2("masked", 256).alias("sha"), F.size("entities").cast("long").alias("n"))


def entity_counts(spark, d):
    e = M.explode_entities(M.mask_documents(_docs(spark, d), POLICY, SECRET), "doc_id")
    return R.entity_counts(e.where(F.col("type").isin("EMAIL", "CARD_NUMBER")))


def leaks_fixture(spark, d):
    """What the self-check says of texts that weren't masked well."""
    rows = [spark.createDataFrame([(t,) for t in texts], "masked string") for texts in (("почта a@b.ru и c@d.ru", "чисто", None), ("карта 4532015112830366", "пишите a@b.ru"))]
    found = [M.leaks(r, POLICY) for r in rows]
    return R.leak_counts(found[0].unionByName(found[1]))


def degraded_requests(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select((F.col("event_id") % 4 == 0).alias("degraded"), F.when(F.col("event_id") % 8 == 0, "recogniser").alias("reason"))
    return R.degraded_counts(e)


def request_summary(spark, d):
    """How many entities of each type, and where, of some requests."""
    rows = spark.createDataFrame([(1, "почта a@b.ru, c@d.ru, карта 4532015112830366"), (2, "чисто")], "request_id long, text string")
    out = M.summarise(M.mask_documents(rows, POLICY, SECRET))
    types = F.array_join(F.transform(F.map_entries("types"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["type"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("request_id", types.alias("types"), spans.alias("spans"))


def address_absorbed(spark, d):
    """An address and its parts: whole it takes them in, by components they stand for themselves."""
    text, _ = unmark("".join(m for n, m in MARKED if n == "address"))
    rows = spark.createDataFrame([(m, text) for m in ("whole", "components")], "mode string, text string")
    by = {m: Policy(types=ANY.types, thresholds={}, filters=("none",), address_mode=m) for m in ("whole", "components")}
    one = lambda r: ([c.pd_type for c in masking.find_entities(r[1], by[r[0]], Lists())[1]],)
    return M._with(rows, {"types": "array<string>"}, one, ["mode", "text"]).select("mode", F.array_join("types", ",").alias("types"))


REQUESTS = (("crm-assistant", None, None), ("crm-assistant", "chat", None), ("payments-bot", "embeddings", None), ("analytics", None, "system_disabled"), ("nobody", None, "unknown_system"), ("crm-assistant", "nowhere", "unknown_route"))


def policy_resolve(spark, d):
    r = spark.createDataFrame([x[:2] for x in REQUESTS], "system_id string, route_id string")
    return PL.resolve_policies(r, DEFAULT).select("system_id", "route_id", F.coalesce("error", F.lit("ok")).alias("error"))


PATHS = (("POST", "/v1/chat/completions", "chat", "mask"), ("GET", "/v1/models", "models", "bypass"), ("POST", "/v1/files/7", "files", "block"), ("GET", "/v1/other", None, None))


def route_match(spark, d):
    r = spark.createDataFrame([x[:2] for x in PATHS], "method string, path string")
    return PL.match_routes(r, DEFAULT)


def route_actions(spark, d):
    r = spark.createDataFrame([(*x[:2], "почта a@b.ru") for x in PATHS], "method string, path string, text string")
    return PL.apply_actions(PL.match_routes(r, DEFAULT)).select("path", "step", "outgoing", "error")


def policy_swap(spark, d):
    """One system before and after the configuration that switches it off."""
    off = DEFAULT | {"systems": DEFAULT["systems"] | {"payments-bot": DEFAULT["systems"]["payments-bot"] | {"enabled": False}}}
    asked = spark.createDataFrame([(t, s, None) for t in (5, 15, 25) for s in ("payments-bot", "crm-assistant")], "ts long, system_id string, route_id string")
    parts = PL.swapped(asked, [(10, DEFAULT), (20, off)])
    return parts[0].unionByName(parts[1]).select("ts", "system_id", F.coalesce("error", F.lit("ok")).alias("error"))


STEPS = (("a", 1, "почта a@b.ru", "masked", "почта [EMAIL_1]"), ("a", 2, "почта a@b.ru", "repeated", "почта [EMAIL_1]"), ("a", 3, "почта [EMAIL_1]", "restored", "почта a@b.ru"), ("a", 4, "ответ: EMAIL_1!", "restored", "ответ: a@b.ru!"), ("b", 1, "чисто", "masked", "чисто"))


def correlated_steps(spark, d):
    s = spark.createDataFrame([("crm-assistant", i, t, p) for i, t, p, *_ in STEPS], "system_id string, payload_id string, ts long, payload string")
    return S.correlated_steps(s, POLICY, SECRET).select("payload_id", "ts", "outcome", "result")


def vault_stateless(spark, d):
    docs = _docs(spark, d).withColumns({"session_id": F.col("doc_id").cast("string"), "system_id": F.lit("crm-assistant")})
    sealed = S.seal(M.mask_documents(docs, POLICY, SECRET), SECRET).select("doc_id", "text", "session_id", "system_id", "mask_context")
    opened = S.unseal(sealed, SECRET)
    foreign = S.unseal(sealed.withColumn("system_id", F.lit("other")), SECRET).select("doc_id", F.col("mapping").isNull().alias("foreign_null"))
    return opened.select("doc_id", (F.col("mapping.original") == F.col("text")).alias("same")).join(foreign, "doc_id")


def vault_latest(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("s").alias("system_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("mapping"))
    return S.vault_latest(e, F.lit("2030-01-01").cast("timestamp"), 10**9).select("session_id", "mapping")


def vault_capacity(spark, d):
    """Of the sessions put in the last six hours of the events the 25 newest."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.lit("s").alias("system_id"), F.col("user_id").cast("string").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).alias("mapping"))
    now = e.agg(F.max("ts").alias("now"))
    return S.vault_latest(e, F.lit(now.first()["now"]), 6 * 3600, 25).select("session_id", "mapping")


def _calls(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("request_id"), F.col("event_id").alias("call_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("system_id"), F.col("event_type").alias("service"), (F.col("event_id") % 3 != 0).alias("success"))


def rate_limit(spark, d):
    limited = S.rate_limit(_calls(spark, d), 1)
    return limited.groupBy("system_id").agg(F.count("*").alias("requests"), F.count_if("allowed").alias("allowed"))


def circuit_breaker(spark, d):
    return S.breaker(_calls(spark, d), 20, 0.3, 3600).groupBy("service", "state").agg(F.count("*").alias("calls"))


def invalid_runs(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    return R.runs(e, F.col("event_id") % 3 != 0, F.col("event_id") % 7 == 0, "event_type", ["ts", "event_id"])


def latency_percentiles(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_totalprice").alias("latency_ms"), F.col("o_orderpriority").alias("step"), (F.col("o_orderkey") % 50 != 0).alias("ok"))
    r = R.verdict(R.step_report(o, "step"))
    return r.select("step", "sent", F.round("ok_rate", 6).alias("ok_rate"), F.round("p50", 4).alias("p50"), F.round("p99", 4).alias("p99"), F.round("p999", 4).alias("p999"), F.round("max", 4).alias("max"), "passed")


def request_counters(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("system_id"), F.lit("chat").alias("route_id"), F.lit("mask").alias("operation"), F.when(F.col("event_id") % 10 == 0, "429").otherwise("200").alias("status"), (F.col("event_id") % 100).alias("tokens"), F.col("value").alias("latency_ms"))
    c = R.request_counters(e)
    return c.select("system_id", "status", "requests", "tokens", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"))


def category_rates(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    m = M.demask_documents(M.mask_documents(docs.select("doc_id", "text", F.col("lang").alias("category")), POLICY, SECRET)).withColumn("ok", F.lit(True))
    return R.category_rates(m).select("category", "ok", F.round("restored_rate", 6).alias("restored_rate"))


FOUND = ((0, "FIO", 0, 10), (0, "EMAIL", 20, 30), (1, "EMAIL", 0, 9), (1, "EMAIL", 0, 9), (2, "PHONE", 4, 15))
WANTED = ((0, "FIO", 0, 10), (0, "EMAIL", 20, 30), (1, "EMAIL", 0, 9), (2, "PHONE", 4, 16), (3, "INN", 1, 13))


def quality_report(spark, d):
    schema = "doc_id long, pd_type string, start long, end long"
    return R.quality(spark.createDataFrame(FOUND, schema), spark.createDataFrame(WANTED, schema))


def quality_fixtures(spark, d):
    """The detectors against the marked texts: nothing missed, nothing made up."""
    found = [_detect_fixture(n)(spark, d) for n in DETECTORS]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    want = spark.createDataFrame([(i, t, a, b) for i, (_, m) in enumerate(MARKED) for t, a, b in unmark(m)[1]], "doc_id long, pd_type string, start long, end long")
    return R.quality(every.withColumnRenamed("text_id", "doc_id"), want).where("pd_type = 'all'").select("tp", "fp", "fn")


def detect_config_regex(spark, d):
    extra = config_regex("UNCLASSIFIED_ID", r"заявка\s+(?P<value>\d{16})", validator="luhn", context_pos=("номер",), context_neg=("тест",))
    rows = spark.createDataFrame([(0, "номер: заявка 4532015112830366"), (1, "тест заявка 1234567890123456 ок")], "id long, text string")

    def one(row):
        doc = T.Document(row[0])
        return ([{"start": c.start, "end": c.end, "score": round(c.score, 4), "ok": c.checksum_ok} for c in extra[1](doc, Lists())],)

    found = M._with(rows, {"f": "array<struct<start:long,end:long,score:double,ok:boolean>>"}, one, ["text"])
    return found.select("id", F.explode("f").alias("f")).select("id", "f.start", "f.end", "f.score", "f.ok")


def ner_windows(spark, d):
    rows = spark.createDataFrame([(0, "Сегодня пришла Анна. тихо. клиент доволен!")], "id long, text string")
    found = M._with(rows, {"w": "array<string>"}, lambda r: ([T.Document(r[0]).norm[a:b] for a, b in T.sentence_windows(T.Document(r[0]), P.NER_TRIGGERS, 64)],), ["text"])
    return found.select("id", F.explode("w").alias("sentence"))


def recognise_external(spark, d):
    rows = spark.createDataFrame([(0, "Анна в Туле")], "id long, text string")
    engine = lambda texts: [[{"label": "PER", "start": 0, "end": 8, "score": 1.0}, {"label": "LOC", "start": 12, "end": 20, "score": 0.8}] for _ in texts]
    out = M.recognise(rows, engine)
    return out.select("id", F.explode("candidates").alias("c")).select("id", "c.pd_type", "c.start", "c.end", F.round("c.score", 4).alias("score"))


def stream_vault(spark, d):
    """Events as a stream of correlated requests: the first of a user is masked, its repetitions answered the same."""
    from .streaming.sessions import correlate

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    path = f"{d}/events.parquet"
    scratch = Scratch(spark, "stream")
    source = spark.readStream.schema(spark.read.parquet(path).schema).option("pathGlobFilter", "events*.parquet").parquet(d if path.endswith("events.parquet") else path)
    steps = source.select(F.lit("crm-assistant").alias("system_id"), F.col("user_id").cast("string").alias("payload_id"), F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("mail u"), F.col("user_id").cast("string"), F.lit("@x.org ")).alias("payload"))
    done = correlate(steps, POLICY, SECRET, ttl_seconds=0)
    # Answers go to files, as they are as many as the events; the trigger ends when all have been read.
    q = done.writeStream.format("parquet").option("path", scratch.path("out")).option("checkpointLocation", scratch.path("state")).outputMode("append").trigger(availableNow=True).start()
    try:
        q.awaitTermination()
    finally:
        q.stop()
    return spark.read.schema(done.schema).parquet(scratch.path("out")).groupBy("outcome").agg(F.count("*").alias("n"), F.countDistinct("payload_id").alias("users"))


ASKED = (
    (1, "crm-assistant", None, "mask", "почта a@b.ru", None, False, "почта [EMAIL_1]", None),
    (2, "crm-assistant", None, "mask", "почта a@b.ru", None, True, "почта a@b.ru", None),
    (3, "payments-bot", "chat", "mask", "почта a@b.ru, тел 8 912 345-67-89", None, False, "почта a@b.ru, тел * *** ***-*7-89", None),
    (4, "crm-assistant", None, "demask", "ответ [EMAIL_1]", "s1", False, "ответ a@b.ru", None),
    (5, "crm-assistant", None, "demask", "ответ [EMAIL_1]", "s2", False, None, "session_not_found"),
    (6, "analytics", None, "mask", "почта a@b.ru", None, False, None, "system_disabled"),
    (7, "crm-assistant", "embeddings", "demask", "[EMAIL_1]", "s1", False, None, "demask_forbidden"),
    (8, "crm-assistant", None, "drop", "x", None, False, None, "bad_operation"),
)


def process_requests(spark, d):
    from .plans.requests import process

    rows = spark.createDataFrame([r[:7] for r in ASKED], "request_id long, system_id string, route_id string, operation string, text string, session_id string, dry_run boolean")
    vault = spark.createDataFrame([("crm-assistant", "s1", [("EMAIL_1", "EMAIL", "a@b.ru", "[EMAIL_1]")])], f"system_id string, session_id string, entries {M.ENTRIES}")
    return process(rows, DEFAULT, SECRET, vault).select("request_id", "result", "error")


BODIES = (('{"operation":"mask","text":"x"}', "explicit"), ('{"payload":"x","payload_id":"1"}', "correlated"), ('{"operation":"mask","texts":["a"]}', "batch"), ('{"operation":"fly"}', "bad_request"))


def request_forms(spark, d):
    from .sources.records import REQUEST, classify_request, json_lines

    rows = spark.createDataFrame([(b,) for b, _ in BODIES] + [("# a comment",), ("",)], "value string")
    return classify_request(json_lines(rows, REQUEST)).groupBy("form").agg(F.count("*").alias("n"))


def load_texts(spark, d):
    from .sources.records import load_texts as load

    rows = spark.createDataFrame([('{"id":"a","category":"c","text":"one two"}',), ("# x",), ('{"text":"three"}',)], "value string")
    return load(rows, 6).select("category", "text")


def sql_detect(spark, d):
    """The table function, joined laterally to all documents."""
    from .operators.sql import register

    register(spark, POLICY, SECRET)
    spark.read.parquet(f"{d}/documents.parquet").createOrReplaceTempView("maskwright_docs")
    return spark.sql("SELECT doc_id, p.start, p.end FROM maskwright_docs, LATERAL pd_detect(text) p WHERE p.pd_type = 'EMAIL'")


KEYS = (("crm-assistant", "k1"), ("payments-bot", "k2"))


def authenticate(spark, d):
    from .sources.config import key_hash

    systems = spark.createDataFrame([(s, key_hash(k)) for s, k in KEYS], "system_id string, key_sha256 string")
    asked = spark.createDataFrame([("k1",), ("k2",), ("k3",), (None,)], "api_key string")
    return PL.authenticate(asked, systems, "crm-assistant")


def prometheus_text(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.count("*").alias("n"))
    return R.to_prometheus(e, "requests_total", ["event_type"], "n")


_DOCS_QUERIES = (gate_docs, token_count_docs, mask_full_docs, mask_emails_cards, demask_roundtrip, selfcheck_leaks, vault_stateless, category_rates, mask_redacted_docs, entity_counts)
_OTHER = (
    normalize_texts, offsets_texts, validate_numbers, validate_order_dates, validate_series, parse_numerals, relevance_filters, resolve_overlaps, combination_rules,
    combination_fold, mask_kinds, mask_synthetic, demask_tolerant, json_extract_chat, json_mask_chat, json_roundtrip_chat, mask_batch, policy_resolve, route_match,
    correlated_steps, vault_latest, rate_limit, circuit_breaker, invalid_runs, latency_percentiles, request_counters, quality_report, quality_fixtures,
    batch_edges, detect_email_folding, leaks_fixture, degraded_requests, request_summary, address_absorbed, route_actions, policy_swap, vault_capacity, distinct_types_fold,
    detect_config_regex, ner_windows, recognise_external, stream_vault, process_requests, request_forms, load_texts, sql_detect, authenticate, prometheus_text,
)
QUERIES = {f.__name__: f for f in (*_DOCS_QUERIES, *_OTHER)} | {
    "detect_email": _spans_query(M.email_spans), "detect_card": _spans_query(M.card_spans), "detect_phone_intl": _spans_query(M.phone_spans), "detect_date_numeric": _spans_query(M.date_spans),
} | {f"detect_{n}_texts": _detect_fixture(n) for n in DETECTORS}

_TOK = r"len(regexp_extract_all(text, '\p{L}+')) + len(regexp_extract_all(text, '[^\p{L}\s\x0b\x85\x{a0}]'))"
_COMBINED_SQL = f"""WITH e AS ({_values([(*r,) for r in COMBINED], ["doc_id", "pd_type", "start_"], "isi")}) SELECT doc_id, pd_type, start_ AS start FROM e a WHERE
  (pd_type = 'PIN' AND EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.pd_type = 'CARD_NUMBER')) OR
  (pd_type = 'CVV' AND EXISTS (SELECT 1 FROM e b WHERE b.doc_id = a.doc_id AND b.pd_type = 'CARD_NUMBER' AND abs(b.start_ - a.start_) <= 200)) OR pd_type = 'CARD_NUMBER'"""
_DATE_KEEP = """list_contains(list_transform([regexp_extract_all(value, '[0-9]+')], lambda p: len(p) = 3 AND (CASE WHEN CAST(p[1] AS BIGINT) > 31
  THEN CAST(p[1] AS BIGINT) BETWEEN 1900 AND 2100 AND (try_cast(p[1] || '-' || p[2] || '-' || p[3] AS DATE) IS NOT NULL OR try_cast(p[1] || '-' || p[3] || '-' || p[2] AS DATE) IS NOT NULL)
  ELSE (CASE WHEN CAST(p[3] AS BIGINT) > 100 THEN CAST(p[3] AS BIGINT) ELSE 2000 + CAST(p[3] AS BIGINT) END) BETWEEN 1900 AND 2100 AND
  (try_cast((CASE WHEN CAST(p[3] AS BIGINT) > 100 THEN CAST(p[3] AS BIGINT) ELSE 2000 + CAST(p[3] AS BIGINT) END) || '-' || p[2] || '-' || p[1] AS DATE) IS NOT NULL
  OR try_cast((CASE WHEN CAST(p[3] AS BIGINT) > 100 THEN CAST(p[3] AS BIGINT) ELSE 2000 + CAST(p[3] AS BIGINT) END) || '-' || p[1] || '-' || p[2] AS DATE) IS NOT NULL) END)), TRUE)"""
#: Every match of the pattern that stands free, starred out: by document what lies before each, then the rest.
_REDACTED_SQL = f"""WITH t AS (SELECT doc_id, text, lower(text) AS n FROM documents),
  m AS (SELECT doc_id, n, regexp_extract_all(n, {_q(P.EMAIL)}) AS v, regexp_split_to_array(n, {_q(P.EMAIL)}) AS g FROM t WHERE contains(n, '@')),
  e AS (SELECT doc_id, n, v, g, unnest(range(1, len(v) + 1)) AS i FROM m),
  s AS (SELECT doc_id, n, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS pos FROM e),
  f AS (SELECT doc_id, pos, CAST(length(value) AS BIGINT) AS len FROM s WHERE NOT (pos > 0 AND regexp_matches(substr(n, pos, 1), '[0-9A-Za-z]')) AND NOT regexp_matches(substr(n, pos + length(value) + 1, 1), '[0-9A-Za-z]|[^\\x00-\\x7F]')),
  p AS (SELECT doc_id, pos, len, coalesce(lag(pos + len) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS before FROM f),
  o AS (SELECT doc_id, count(*) AS n, max(pos + len) AS last, string_agg(substr(text, before + 1, pos - before) || repeat('*', len), '' ORDER BY pos) AS head FROM p JOIN t USING (doc_id) GROUP BY doc_id)
  SELECT doc_id, sha256(coalesce(head, '') || substr(text, coalesce(last, 0) + 1)) AS sha, CAST(coalesce(o.n, 0) AS BIGINT) AS n FROM t LEFT JOIN o USING (doc_id)"""
_NUMBERED_CALLS = "n AS (SELECT event_type AS s, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, epoch_us(CAST(ts AS TIMESTAMP)) / 1e6 AS t, event_id % 3 <> 0 AS good FROM events)"
_LIMIT_SQL = f"""WITH RECURSIVE {_NUMBERED_CALLS},
  f(s, k, t, tokens, ok) AS (SELECT s, k, t, 0.0::DOUBLE, TRUE FROM n WHERE k = 1
    UNION ALL SELECT n.s, n.k, n.t, least(1.0, f.tokens + (n.t - f.t)) - CASE WHEN least(1.0, f.tokens + (n.t - f.t)) >= 1 THEN 1 ELSE 0 END, least(1.0, f.tokens + (n.t - f.t)) >= 1 FROM f JOIN n ON n.s = f.s AND n.k = f.k + 1)
  SELECT s AS system_id, count(*) AS requests, count_if(ok) AS allowed FROM f GROUP BY s"""
_BREAKER_SQL = f"""WITH RECURSIVE {_NUMBERED_CALLS},
  f(s, k, seen, state, total, failed, opened) AS (SELECT DISTINCT s, 0::BIGINT, 'closed', 'closed', 0, 0, 0.0::DOUBLE FROM n
    UNION ALL SELECT s, k, now_, CASE WHEN judged AND bad / 20 >= 0.3 THEN 'open' ELSE now_ END, CASE WHEN judged OR now_ = 'open' THEN CASE WHEN judged THEN 0 ELSE total END ELSE total + 1 END,
      CASE WHEN judged THEN 0 ELSE bad END, CASE WHEN judged AND bad / 20 >= 0.3 THEN t ELSE opened END
      FROM (SELECT *, now_ <> 'open' AND total + 1 >= 20 AS judged, failed + CASE WHEN now_ <> 'open' AND NOT good THEN 1 ELSE 0 END AS bad
        FROM (SELECT n.s, n.k, n.t, n.good, f.total, f.failed, f.opened, CASE WHEN f.state = 'open' AND n.t - f.opened >= 3600 THEN 'half_open' ELSE f.state END AS now_ FROM f JOIN n ON n.s = f.s AND n.k = f.k + 1)))
  SELECT s AS service, seen AS state, count(*) AS calls FROM f WHERE k > 0 GROUP BY s, seen"""
_EMAIL_SQL, _CARD_SQL = _spans_sql(P.EMAIL, "@"), _spans_sql(P.CARD, "[0-9]", _LUHN)
ORACLES = {
    "gate_docs": r"SELECT doc_id, coalesce(regexp_matches(text, '[0-9@\p{Lu}]'), FALSE) AS scan FROM documents",
    "token_count_docs": f"SELECT doc_id, CAST({_TOK} AS BIGINT) AS tokens FROM documents",
    "detect_email": _EMAIL_SQL,
    "detect_card": _CARD_SQL,
    "detect_phone_intl": _spans_sql(P.PHONE_INTL, r"\+[0-9]", "length(regexp_replace(value, '[^0-9]', '', 'g')) BETWEEN 8 AND 15"),
    "detect_date_numeric": _spans_sql(P.DATE_NUMERIC, "[0-9]", _DATE_KEEP),
    "normalize_texts": _values([(i, n) for i, (_, n) in enumerate(NORMAL)], ["id", "norm"], "is"),
    "offsets_texts": _values([(0, "0,1,4,5"), (1, "0,0,3,4"), (2, "0,0,0,2,3")], ["id", "offsets"], "is"),
    "validate_numbers": _NUMBERS_SQL,
    "validate_order_dates": """SELECT valid, count(*) AS n FROM (SELECT CASE WHEN o_orderkey % 3 < 2 THEN TRUE ELSE try_cast(strftime(o_orderdate, '%Y-%m-') || '31' AS DATE) IS NOT NULL END AS valid FROM orders) GROUP BY valid""",
    "validate_series": _values(list(SERIES), ["series", "valid"], "sb"),
    "parse_numerals": _values(list(NUMERALS), ["words", "value"], "si"),
    "relevance_filters": _values([(i, f, k) for i, (_, f, k) in enumerate(FILTERED)], ["id", '"filter"', "kept"], "isi").replace('AS "filter"', 'AS "filter"'),
    "resolve_overlaps": _values([(0, "CARD_NUMBER", 5, 24), (0, "DATE", 30, 40), (1, "INN", 0, 12), (2, "FIO", 4, 20)], ["doc_id", "pd_type", '"start"', '"end"'], "isii"),
    "combination_rules": _COMBINED_SQL,
    "combination_fold": _COMBINED_SQL,
    "mask_kinds": _MASKS_SQL,
    "mask_synthetic": _values([(t, True) for t in ("CARD_NUMBER", "INN", "PHONE", "FIO", "EMAIL")], ["pd_type", "well_formed"], "sb"),
    "demask_roundtrip": "SELECT doc_id, sha256(text) AS sha FROM documents",
    "demask_tolerant": _values([(i, *r[1:]) for i, r in enumerate(TOLERANT)], ["id", "demasked", "restored", "unresolved"], "isii"),
    "mask_emails_cards": f"SELECT type, count(*) AS n, count(DISTINCT doc_id) AS docs FROM (SELECT 'EMAIL' AS type, doc_id FROM ({_EMAIL_SQL}) UNION ALL SELECT 'CARD_NUMBER', doc_id FROM ({_CARD_SQL})) GROUP BY type",
    "json_extract_chat": _values([(0, "почта a@b.ru")], ["id", "value"], "is"),
    "json_mask_chat": _values([(0, '{"messages":[{"content":"почта [EMAIL_1]","role":"user"},{"content":[{"text":"карта ************0366","type":"text"}],"role":"user"}],"model":"m"}'), (1, None)], ["id", "masked"], "is"),
    "json_roundtrip_chat": _values([(0, '{"messages":[{"content":"почта a@b.ru","role":"user"},{"content":[{"text":"карта 4532015112830366","type":"text"}],"role":"user"}],"model":"m"}')], ["id", "demasked"], "is"),
    "mask_batch": _values([(7, 0, "почта [EMAIL_1]"), (7, 1, "чисто"), (7, 2, "почта [EMAIL_1]")], ["request_id", '"index"', "masked"], "iis"),
    "policy_resolve": _values([(a, b, c or "ok") for a, b, c in REQUESTS], ["system_id", "route_id", "error"], "sss"),
    "route_match": _values(list(PATHS), ["method", "path", "route_id", "action"], "ssss"),
    "correlated_steps": _values([(i, t, o, r) for i, t, _, o, r in STEPS], ["payload_id", "ts", "outcome", "result"], "siss"),
    "vault_stateless": "SELECT doc_id, TRUE AS same, TRUE AS foreign_null FROM documents",
    "batch_edges": _values([(1, "почта [EMAIL_1]", None), (2, "", None), (3, None, "bad_request"), (4, None, "unauthorized"), (5, "bad_request|чисто|", None)], ["request_id", "items", "error"], "iss"),
    "detect_email_folding": _values([(i, a, b, "a@b.ru") for i, (_, a, b) in enumerate(FOLDING)], ["text_id", '"start"', '"end"', "value"], "iiis"),
    "mask_redacted_docs": _REDACTED_SQL,
    "entity_counts": f"SELECT pd_type, 'regex' AS source, count(*) AS entities FROM (SELECT 'EMAIL' AS pd_type FROM ({_EMAIL_SQL}) UNION ALL SELECT 'CARD_NUMBER' FROM ({_CARD_SQL})) GROUP BY pd_type",
    "leaks_fixture": _values([("EMAIL", 3), ("CARD_NUMBER", 1)], ["pd_type", "leaks"], "si"),
    "degraded_requests": "SELECT CASE WHEN event_id % 8 = 0 THEN 'recogniser' ELSE 'unknown' END AS reason, count(*) AS requests FROM events WHERE event_id % 4 = 0 GROUP BY 1",
    "request_summary": _values([(1, "CARD_NUMBER=1,EMAIL=2", "EMAIL:11:17,EMAIL:19:25,CARD_NUMBER:38:54"), (2, "", "")], ["request_id", "types", "spans"], "iss"),
    "address_absorbed": _values([("whole", "ADDRESS"), ("components", "ADDR_CITY,ADDR_STREET,ADDR_HOUSE,ADDR_FLAT")], ["mode", "types"], "ss"),
    "route_actions": _values([(p, {"mask": "mask", "bypass": "pass"}.get(a), "почта a@b.ru" if a == "bypass" else None, "blocked" if a == "block" else None if a else "no_route") for _, p, _, a in PATHS], ["path", "step", "outgoing", "error"], "ssss"),
    "policy_swap": _values([(15, "payments-bot", "ok"), (15, "crm-assistant", "ok"), (25, "payments-bot", "system_disabled"), (25, "crm-assistant", "ok")], ["ts", "system_id", "error"], "iss"),
    "vault_capacity": """SELECT session_id, mapping FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(event_id, ts) AS e, max(ts) AS t FROM events GROUP BY user_id), LATERAL (SELECT CAST(e AS VARCHAR) AS mapping)
      WHERE e % 5 <> 0 AND t + INTERVAL 6 HOUR > (SELECT max(ts) FROM events) ORDER BY t DESC, session_id LIMIT 25""",
    "distinct_types_fold": _values([(1, "EMAIL", 0), (1, "PHONE", 40), (2, "CARD_NUMBER", 5), (2, "CARD_NUMBER", 50)], ["doc_id", "pd_type", '"start"'], "isi"),
    "rate_limit": _LIMIT_SQL,
    "circuit_breaker": _BREAKER_SQL,
    "vault_latest": "SELECT session_id, mapping FROM (SELECT CAST(user_id AS VARCHAR) AS session_id, arg_max(event_id, ts) AS e FROM events GROUP BY user_id), LATERAL (SELECT CAST(e AS VARCHAR) AS mapping) WHERE e % 5 <> 0",
    "invalid_runs": """SELECT event_type, CAST(max(n) AS BIGINT) AS longest_run FROM (SELECT event_type, g, sum(i) AS n FROM (SELECT event_type, i, sum(1 - i) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS g
      FROM (SELECT event_type, ts, event_id, CASE WHEN event_id % 3 <> 0 THEN 1 ELSE 0 END AS i FROM events WHERE event_id % 7 <> 0)) GROUP BY event_type, g) GROUP BY event_type""",
    "latency_percentiles": """SELECT o_orderpriority AS step, count(*) AS sent, round(avg(CASE WHEN o_orderkey % 50 <> 0 THEN 1 ELSE 0 END), 6) AS ok_rate, round(quantile_cont(o_totalprice, 0.5), 4) AS p50,
      round(quantile_cont(o_totalprice, 0.99), 4) AS p99, round(quantile_cont(o_totalprice, 0.999), 4) AS p999, round(max(o_totalprice), 4) AS max,
      avg(CASE WHEN o_orderkey % 50 <> 0 THEN 1 ELSE 0 END) >= 0.99 AND quantile_cont(o_totalprice, 0.99) <= 1000 AS passed FROM orders GROUP BY o_orderpriority""",
    "request_counters": """SELECT event_type AS system_id, CASE WHEN event_id % 10 = 0 THEN '429' ELSE '200' END AS status, count(*) AS requests, CAST(sum(event_id % 100) AS BIGINT) AS tokens,
      round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95 FROM events GROUP BY 1, 2""",
    "category_rates": "SELECT lang AS category, count(*) AS ok, 1.0::DOUBLE AS restored_rate FROM documents GROUP BY lang",
    "quality_report": _values([("FIO", 1, 0, 0, 1.0, 1.0, 1.0), ("EMAIL", 2, 1, 0, 0.666667, 1.0, 0.8), ("PHONE", 0, 1, 1, 0.0, 0.0, 0.0), ("INN", 0, 0, 1, 0.0, 0.0, 0.0), ("all", 3, 2, 2, 0.6, 0.6, 0.6)], ["pd_type", "tp", "fp", "fn", '"precision"', "recall", "f1"], "siiiddd"),
    "quality_fixtures": _values([(sum(len(unmark(m)[1]) for _, m in MARKED), 0, 0)], ["tp", "fp", "fn"], "iii"),
    "detect_config_regex": _values([(0, 25, 41, 1.0, True), (1, 22, 38, 0.3, False)], ["id", '"start"', '"end"', "score", "ok"], "iiidb"),
    "process_requests": _values([(r[0], *r[7:]) for r in ASKED], ["request_id", "result", "error"], "iss"),
    "request_forms": _values([(f, 1) for _, f in BODIES], ["form", "n"], "si"),
    "load_texts": _values([("c", "one two one two one two"), ("default", "three three three three three three")], ["category", "text"], "ss"),
    "sql_detect": f'SELECT doc_id, start, "end" FROM ({_EMAIL_SQL})',
    "authenticate": _values([("k1", "crm-assistant"), ("k2", "payments-bot"), ("k3", None), (None, "crm-assistant")], ["api_key", "system_id"], "ss"),
    "prometheus_text": """SELECT 'requests_total{event_type="' || event_type || '"} ' || count(*) AS line FROM events GROUP BY event_type""",
    "ner_windows": _values([(0, "сегодня пришла анна."), (0, " клиент доволен!")], ["id", "sentence"], "is"),
    "recognise_external": _values([(0, "FIO", 0, 8, 0.9), (0, "ADDR_CITY", 12, 20, 0.72)], ["id", "pd_type", '"start"', '"end"', "score"], "isiid"),
    "stream_vault": "SELECT 'masked' AS outcome, count(DISTINCT user_id) AS n, count(DISTINCT user_id) AS users FROM events UNION ALL SELECT 'repeated', count(*) - count(DISTINCT user_id), count(DISTINCT CASE WHEN k > 1 THEN user_id END) FROM (SELECT user_id, count(*) OVER (PARTITION BY user_id) AS k FROM events)",
    **{f"detect_{n}_texts": _values([(i, t, a, b) for i, (k, m) in enumerate(MARKED) if k == n for t, a, b in unmark(m)[1]], ["text_id", "pd_type", '"start"', '"end"'], "isii") for n in DETECTORS},
}
