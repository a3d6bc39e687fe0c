"""Functions and operators, without Spark."""

import hashlib
import hmac
import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from maskwright.functions import text as T
from maskwright.functions import validators as V
from maskwright.operators import json_paths as J
from maskwright.operators import masking as K
from maskwright.operators import patterns as P
from maskwright.operators.detectors import DETECTORS, Candidate, Lists, detect
from maskwright.operators.rules import Policy, Rule, combine, resolve
from maskwright.queries import ANY, FILTERED, MARKED, POLICY, unmark
from maskwright.sources import config as C
from maskwright.sources.dictionaries import parse_forms, parse_lines

LISTS = Lists()


def found(text, policy=POLICY):
    return [(e["type"], e["start"], e["end"]) for e in K.mask_text(text, policy, LISTS, b"k").entities]


@pytest.mark.parametrize("text,norm", [("серия — 45–09 «тест»", 'серия - 45-09 "тест"'), ("Ёж", "еж"), ("Ⅳ", "iv"), ("", "")])
def test_normalised(text, norm):
    assert T.Document(text).norm == norm


def test_offsets_lead_back():
    d = T.Document("İ")
    assert d.original(0, len(d.norm)) == "İ" and d.span(0, len(d.norm)) == (0, 2)
    d = T.Document("😀 a—б")
    assert d.span(2, 3) == (5, 6) and d.slice(6, 9) == "—"


def test_boundaries_look_at_bytes():
    d = T.Document("я123 123я x123 123")
    at = [d.norm.index("123", i) for i in (0, 5, 11, 15)]
    assert [d.at_boundary(i, i + 3) for i in at] == [True, False, False, True]


def test_tokens():
    assert T.count_tokens("Клиент Иванов Иван Иванович, паспорт 4509 123456") == 21
    assert T.count_tokens("") == 0


def test_checksums():
    assert V.luhn("4532015112830366") and not V.luhn("4532015112830367")
    assert V.inn("7707083893") and not V.inn("7707083894") and V.inn("500100732259") and V.inn("1") is None
    assert V.snils("11223344595") and not V.snils("11223344596")
    assert V.parse_date("05.03.1985") == (1985, 3, 5) and V.parse_date("1985-03-05") == (1985, 3, 5)
    assert V.parse_date("12.31.1990") == (1990, 12, 31) and V.parse_date("31.02.2020") is None
    assert V.parse_numerals("тысяча девятьсот восемьдесят пятого".split(), P.NUMERALS) == 1985


@pytest.mark.parametrize("name,marked", MARKED)
def test_each_detector_finds_what_is_marked(name, marked):
    text, spans = unmark(marked)
    doc = T.Document(text)
    got = [(c.pd_type, c.start, c.end) for _, run in DETECTORS[name] for c in run(doc, LISTS)]
    assert sorted(got) == sorted(spans)


@pytest.mark.parametrize("text", ["", "чисто", "Подскажите ставку по счёту", "№ 1"])
def test_nothing_in_clean_text(text):
    assert found(text) == []


def test_pin_needs_a_card_and_cvv_one_nearby():
    assert found("пин-код 4321") == []
    assert [t for t, *_ in found("пин-код 4321 карта 4532015112830366")] == ["PIN", "CARD_NUMBER"]
    far = "карта 4532015112830366 " + "a " * 200 + "cvv 123"
    assert [t for t, *_ in found(far)] == ["CARD_NUMBER"]


def test_numbers_are_given_by_value():
    m = K.mask_text("Иванов Иван Иванович и Петрова Анна Сергеевна, снова Иванов Иван Иванович", POLICY, LISTS, b"k")
    assert m.text == "[ФИО_1] и [ФИО_2], снова [ФИО_1]"


def test_overlaps():
    c = lambda t, a, b, s, ok=False: Candidate(t, a, b, s, "regex", "x", checksum_ok=ok)
    assert [x.pd_type for x in resolve([c("PHONE", 0, 12, 0.9), c("CARD_NUMBER", 5, 24, 0.95, True)], POLICY)] == ["CARD_NUMBER"]
    tie = resolve([c("DATE", 0, 5, 0.9), c("DATE", 0, 5, 0.9)], POLICY)
    assert len(tie) == 1
    assert resolve([c("FIO", 0, 5, 0.69)], POLICY) == []


def test_rules_see_what_was_there_before():
    e = [Candidate("PIN", 0, 4, 0.9, "regex", "x"), Candidate("CVV", 9, 12, 0.9, "regex", "x")]
    p = Policy(types=ANY.types, rules={"PIN": Rule(("CVV",)), "CVV": Rule(("PIN",))})
    assert len(combine(e, p)) == 2
    assert combine(e, Policy(types=ANY.types, min_distinct_types=3, always_mask=("PIN",)))[0].pd_type == "PIN"


@pytest.mark.parametrize("text,name,kept", FILTERED)
def test_filters(text, name, kept):
    from maskwright.operators.rules import relevant

    doc = T.Document(text)
    kind = "FIO" if name in ("public_persons", "org_context") else "PHONE"
    got = relevant(doc, detect(doc, ANY.types, LISTS), Policy(types=ANY.types, filters=(name,)), LISTS)
    assert any(c.pd_type == kind for c in got) == bool(kept)


def test_maskers():
    secret = b"s"
    e = Candidate("EMAIL", 0, 9, 1.0, "regex", "x")
    one = lambda kind: K.mask_value(e, "A@b.ru", Policy(types=ANY.types, masks={"EMAIL": kind}), K.State(), secret)
    assert one("redact") == ("******", None)
    assert one("hash") == ("sha256:" + hashlib.sha256(b"a@b.ru").hexdigest(), None)
    assert one("token")[0] == "tok_EMAIL_" + hmac.new(secret, b"EMAIL|a@b.ru", hashlib.sha256).hexdigest()[:8]
    assert one("placeholder") == ("[EMAIL_1]", "EMAIL_1") and one("partial") == ("A@b.ru", "EMAIL_p1")
    assert V.luhn(K.synthetic(secret, "CARD_NUMBER", "1")) and V.inn(K.synthetic(secret, "INN", "1"))


def test_demasking():
    entries = [{"key": "ФИО_1", "original": "Иванов", "masked": None}]
    assert K.demask_text("Клиент [ФИО_1] живёт", entries) == ("Клиент Иванов живёт", 1, 0)
    assert K.demask_text("Клиент ФИО_1", entries) == ("Клиент Иванов", 1, 0)
    assert K.demask_text("[ФИО_2]", entries) == ("[ФИО_2]", 0, 1)


@pytest.mark.parametrize("text", ["почта A@b.ru и a@B.ru, снова A@b.ru", "тел +7 912 345-67-89 или +7 (912) 345 67 89", "в шаблоне EMAIL_1 и [EMAIL 2], почта a@b.ru, c@d.ru", "<EMAIL_1> a@b.ru, A@B.ru"])
def test_spellings_and_placeholders_of_the_text_come_back(text):
    m = K.mask_text(text, POLICY, LISTS, b"k")
    assert m.entries and K.demask_text(m.text, m.entries)[0] == text


def test_spellings_come_back_from_json(spark):
    from maskwright.plans.masking import demask_json, mask_json

    body = '{"a":"почта A@b.ru","b":"почта a@b.ru, EMAIL_1"}'
    df = mask_json(spark.createDataFrame([(body,)], "body string"), ["$.a", "$.b"], POLICY, b"k")
    assert demask_json(df.select(df.masked.alias("body"), "entries"), ["$.a", "$.b"]).first()["demasked"] == body


@settings(max_examples=60, deadline=None)
@given(st.sampled_from(["Иванов Иван Иванович", "Петрова Анна"]), st.from_regex(r"\+7 9[0-9]{2} [0-9]{3}-[0-9]{2}-[0-9]{2}", fullmatch=True), st.from_regex(r"[a-z]{1,8}@[a-z]{2,8}\.ru", fullmatch=True))
def test_masking_comes_back(name, phone, email):
    text = f"Клиент {name}, телефон {phone}, email {email}"
    m = K.mask_text(text, POLICY, LISTS, b"k")
    assert K.demask_text(m.text, m.entries)[0] == text
    assert email not in m.text and phone not in m.text


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_any_text_goes_through(text):
    m = K.mask_text(text, ANY, LISTS, b"k")
    for e in m.entities:
        assert m.text.encode()[e["masked_start"] : e["masked_end"]].decode() == e["replacement"]


def test_json_paths():
    body = json.dumps({"b": [{"c": "x"}, {"c": 1}], "a.b": "y"})
    assert J.extract_strings(body, "$.b[*].c") == ["x"] and J.extract_strings(body, '$["a.b"]') == ["y"] and J.extract_strings(body, "$.b[0].c") == ["x"]
    assert J.parse_path("b") is None and J.parse_path('$["x') is None
    assert J.replace_strings(body, ["$.b[*].c"], str.upper) == '{"a.b":"y","b":[{"c":"X"},{"c":1}]}'


def test_configuration():
    cfg = C.check(json.loads(json.dumps(C.DEFAULT)))
    p = C.policy_for(cfg, "payments-bot")
    assert p.types == {"CARD_NUMBER", "CVV", "CARD_HOLDER", "PHONE"} and p.masks["PHONE"] == "partial" and "PIN" not in p.rules and p.demask
    assert C.policy_for(cfg, "analytics") == "system_disabled" and C.policy_for(cfg, "x") == "unknown_system"
    assert not C.policy_for(cfg, "crm-assistant", "embeddings").demask
    assert C.secret("plain") == "plain"
    cfg["profiles"]["strict"]["types"]["NOPE"] = {}
    with pytest.raises(ValueError):
        C.check(cfg)


def test_dictionary_files():
    assert parse_lines("# x\n a \n\nb") == ["a", "b"] and parse_forms("a|b\n") == [["a", "b"]]
