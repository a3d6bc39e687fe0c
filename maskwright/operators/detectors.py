"""Detectors: a document to candidates. Most are a row of a table: a pattern, what it needs, and a judge.

A judge sees a match and returns (type, score, checksum_ok), or nothing. Candidates carry the
order in which their detectors stand, which breaks ties later on.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from ..functions import validators as V
from ..functions.text import Document, has_prefix, has_word, words
from ..sources import dictionaries as D
from . import patterns as P


@dataclass(slots=True)
class Candidate:
    pd_type: str
    start: int  # original bytes
    end: int
    score: float
    source: str
    detector: str
    n_start: int = 0  # normalised characters
    n_end: int = 0
    checksum_ok: bool = False
    components: list[Candidate] = field(default_factory=list)


@dataclass(frozen=True)
class Lists:
    """The dictionaries that detectors and filters look into."""

    first_names: frozenset[str] = frozenset(D.FIRST_NAMES)
    cities: tuple[str, ...] = D.CITIES
    countries: tuple[str, ...] = D.COUNTRIES
    authorities: tuple[str, ...] = D.AUTHORITIES
    public_persons: tuple[tuple[str, ...], ...] = tuple(tuple(line.split("|")) for line in D.PUBLIC_PERSONS)
    bank_offices: tuple[str, ...] = D.BANK_OFFICES
    bank_phones: tuple[str, ...] = D.BANK_PHONES


@dataclass(frozen=True)
class Pattern:
    """A detector of one regular expression.

    group: what becomes the span; bounded: whether the whole match must stand free; gate: a
    cheap test of the text; left, right: bytes around the match that the judge sees.
    """

    name: str
    types: tuple[str, ...]
    regex: str
    judge: Callable[[re.Match, str, Lists], tuple[str, float, bool] | None]
    group: int = 0
    bounded: bool = True
    source: str = "regex"
    gate: str | None = None
    left: int = 60
    right: int = 20

    def __call__(self, doc: Document, lists: Lists) -> Iterator[Candidate]:
        if self.gate and not re.search(self.gate, doc.norm):
            return
        for m in re.finditer(self.regex, doc.norm):
            if self.bounded and not doc.at_boundary(m.start(), m.end()):
                continue
            if got := self.judge(m, doc.window(m.start(), m.end(), self.left, self.right), lists):
                a, b = m.span(self.group)
                yield Candidate(got[0], *doc.span(a, b), got[1], self.source, self.name, a, b, got[2])


def _always(pd_type: str, score: float):
    return lambda m, w, lists: (pd_type, score, False)


def _card(m, w, lists):
    d = V.digits(m[0])
    return ("CARD_NUMBER", 0.95 if d.startswith(P.CARD_PREFIXES) else 0.7, True) if V.luhn(d) else None


def _inn(m, w, lists):
    org = len(m[0]) == 10 or has_word(w, frozenset(P.INN_ORG_WORDS)) or any(p in w for p in P.INN_ORG_PHRASES)
    named, valid = "инн" in words(w), bool(V.inn(m[0]))
    return ("ORG_INN" if org else "INN", (0.98 if named else 0.85) if valid else 0.6, valid) if valid or named else None


def _passport(m, w, lists):
    named, valid = has_prefix(w, P.PASSPORT_STEMS), V.passport_series(m[1] + m[2])
    return ("PASSPORT", (0.95 if named else 0.5) if valid else 0.6, valid) if valid or named else None


def _division(m, w, lists):
    if m[0][:2] == "00" or m[0][2] > "3" or len(V.digits(m[0])) != 6:
        return None
    return "DIVISION_CODE", 0.95 if has_prefix(w, P.DIVISION_STEMS) and "код" in words(w) else 0.3, False


def _phone_rf(m, w, lists):
    d = V.digits(m[0])
    if len(d) == 11 and d[0] in "78" and d[1] in "3489":
        score = 0.9
    elif len(d) == 10 and d[0] in "3489":
        score = 0.6 if d[0] == "9" else 0.8
    else:
        return None
    return "PHONE", min(1.0, score + 0.35) if has_word(w, frozenset(P.PHONE_WORDS)) else score, False


def _phone_intl(m, w, lists):
    return ("PHONE", 0.9, False) if 8 <= len(V.digits(m[0])) <= 15 else None


def _snils(m, w, lists):
    named, valid = "снилс" in words(w), bool(V.snils(m[0]))
    return ("SNILS", (0.95 if named else 0.85) if valid else 0.6, valid) if valid or named else None


def _date_type(w: str) -> str:
    return "BIRTH_DATE" if has_prefix(w, P.BIRTH_STEMS) else "PASSPORT_ISSUE_DATE" if has_prefix(w, P.ISSUE_STEMS) else "DATE"


def _date_numeric(m, w, lists):
    return (_date_type(w), 0.95, False) if V.parse_date(m[0]) else None


def _date_text(m, w, lists):
    fits = m[2] in P.MONTHS and 1 <= int(m[1]) <= 31 and 1900 <= int(m[3]) <= 2100
    return (_date_type(w), 0.95, False) if fits else None


def _date_numeral(m, w, lists):
    said = m[0].split()
    month = next((i for i, x in enumerate(said) if x in P.MONTHS), None)
    return (_date_type(w), 0.9, False) if month is not None and V.parse_numerals(said[:month], P.NUMERALS) is not None else None


def _citizenship(m, w, lists):
    value = m[1].strip()
    more = "российской" in value if m.re.pattern == P.CITIZENSHIP_PHRASE else False
    return ("CITIZENSHIP", 0.9, False) if value and (more or any(c in value for c in lists.countries)) else None


def _license(m, w, lists):
    return ("DRIVER_LICENSE", 0.9, False) if has_prefix(w, P.LICENSE_STEMS) or any(p in w for p in P.LICENSE_PHRASES) else None


def _structured(m, w, lists):
    kind, value = P.FIELDS.get(m[1].strip()), m[2].strip()
    return (kind, 0.85, False) if kind and value and len(value.encode()) <= 200 else None


DATES = ("DATE", "BIRTH_DATE", "PASSPORT_ISSUE_DATE")


def _capture(doc: Document, at: int, most: int, dots: bool) -> tuple[int, int]:
    """A value from at on: past blanks, up to a comma, semicolon or line end (with dots: a full stop too,
    unless a word of one to three letters is before it), most bytes at most, without blanks at its end."""
    norm = doc.norm
    start = next((i for i in range(at, len(norm)) if not norm[i].isspace()), at if at == len(norm) else len(norm))
    first = (doc.norm_bytes or range(len(norm) + 1))[start]
    end = start
    for end in range(start, len(norm) + 1):
        if end == len(norm) or norm[end] in ";\n," or (doc.norm_bytes[end] if doc.norm_bytes else end) - first >= most:
            break
        if dots and norm[end] == ".":
            letters = next((k for k in range(4) if end - k - 1 < start or not norm[end - k - 1].isalpha()), 4)
            if not 1 <= letters <= 3:
                break
    while end > start and norm[end - 1].isspace():
        end -= 1
    return start, end


def _birth_place(doc: Document, lists: Lists) -> Iterator[Candidate]:
    for m in re.finditer(P.BIRTH_PLACE, doc.norm):
        a, b = _capture(doc, m.end(), 100, False)
        value = doc.norm[a:b]
        if value and any(k in value for k in (*P.TOPONYMS, *lists.cities, *lists.countries)):
            yield Candidate("BIRTH_PLACE", *doc.span(a, b), 0.9, "regex", "birth_place", a, b)


def _issuer(doc: Document, lists: Lists) -> Iterator[Candidate]:
    for m in re.finditer(P.ISSUER, doc.norm):
        at = m.end()
        date = re.compile(r"[0-9./-]+").match(doc.norm, at)
        if date and V.parse_date(date[0]):
            at = re.compile(r"\s*").match(doc.norm, date.end()).end()
        a, b = _capture(doc, at, 150, True)
        if b > a and doc.norm[a:b].startswith((*lists.authorities, *P.ISSUER_STARTS)):
            yield Candidate("PASSPORT_ISSUER", *doc.span(a, b), 0.9, "regex", "passport_issuer", a, b)


def _street_end(norm: str, start: int, end: int) -> int:
    """A street runs on to the next comma or semicolon, else to a house."""
    stops = [i for c in ",;" if (i := norm.find(c, end)) >= 0]
    to = min(stops) if stops else next((i for c in (" д.", " дом") if (i := norm.find(c, end)) >= 0), end)
    return start + len(norm[start:to].rstrip(" "))


#: Components in the order in which equal starts stand.
_ADDRESS = tuple((kind, re.compile(regex), score) for kind, regex, score in (("ADDR_INDEX", P.INDEX, 0.8), ("ADDR_REGION", P.REGION, 0.7), ("ADDR_CITY", P.CITY, 0.7), ("ADDR_STREET", P.STREET, 0.7), ("ADDR_HOUSE", P.HOUSE, 0.7), ("ADDR_FLAT", P.FLAT, 0.7)))
_MAYBE_ADDRESS = re.compile(r"[а-я]")


def _address(doc: Document, lists: Lists) -> Iterator[Candidate]:
    if not _MAYBE_ADDRESS.search(doc.norm):
        return
    parts: list[Candidate] = []
    for kind, regex, score in _ADDRESS:
        for m in regex.finditer(doc.norm):
            a, b = m.span()
            if not doc.at_boundary(a, b):
                continue
            if kind == "ADDR_INDEX" and not ("1" <= m[0][0] <= "6" and "индекс" in words(doc.window(a, b, 60, 20))):
                continue
            if kind == "ADDR_STREET":
                b = _street_end(doc.norm, a, b)
            if b > a:
                parts.append(Candidate(kind, *doc.span(a, b), score, "regex", "address", a, b))
    parts.sort(key=lambda c: c.start)
    chains: list[list[Candidate]] = []
    for c in parts:
        last = chains[-1][-1] if chains else None
        if last and 0 <= c.start - last.end <= 3 and all(x in ",;" or x.isspace() for x in doc.slice(last.end, c.start)):
            chains[-1].append(c)
        else:
            chains.append([c])
    yield from parts
    for chain in chains:
        kinds = {c.pd_type for c in chain}
        if len(chain) >= 3 and {"ADDR_STREET", "ADDR_HOUSE"} <= kinds:
            score = 0.95
        elif len(chain) == 2 and "ADDR_STREET" in kinds and kinds & {"ADDR_CITY", "ADDR_HOUSE"}:
            score = 0.8
        else:
            continue
        a, b = chain[0].start, chain[-1].end
        if has_word(doc.text_window(a, b, 120, 40).lower(), frozenset(P.ADDRESS_WORDS)):
            score = min(1.0, score + 0.2)
        yield Candidate("ADDRESS", a, b, score, "regex", "address", chain[0].n_start, chain[-1].n_end, components=[replace(c) for c in chain])


#: Of neighbouring name words: which flags in a row make a name, and its score. S surname, N first name, P patronymic, I initials.
_NAMES = (("SNP", 0.95), ("NPS", 0.95), ("NP", 0.95), ("SI", 0.9), ("IS", 0.9), ("NS", 0.8), ("SN", 0.8))


def _fio(doc: Document, lists: Lists) -> Iterator[Candidate]:
    if not _MAYBE_ADDRESS.search(doc.norm):
        return
    tokens = []
    for m in re.finditer(r"[^ \t\n\x0c\r,]+", doc.norm):
        w = m[0]
        flags = {"I"} if len(w) == 4 and w[1] == w[3] == "." else set()
        flags |= {f for f, yes in (("N", w in lists.first_names), ("P", w.endswith(P.PATRONYMIC_ENDS)), ("S", w.endswith(P.SURNAME_ENDS))) if yes}
        capital = doc.original(*m.span())[:1].isupper()
        if flags or capital:
            tokens.append((m.start(), m.end(), flags, capital))
    joined = [not doc.norm[a[1] : b[0]].strip(" ,") for a, b in zip(tokens, tokens[1:], strict=False)]
    i = 0
    while i < len(tokens):
        for shape, score in _NAMES:
            n = len(shape)
            if i + n <= len(tokens) and all(joined[i : i + n - 1]) and all(f in t[2] for f, t in zip(shape, tokens[i:], strict=False)):
                if set(shape) == set("NS") and tokens[i][3] and tokens[i + 1][3]:
                    score += 0.1
                break
        else:
            n, score = 1, 0.75 if "S" in tokens[i][2] and has_word(doc.window(*tokens[i][:2], 60, 20), frozenset(P.SURNAME_WORDS)) else 0.0
        if score:
            a, b = tokens[i][0], tokens[i + n - 1][1]
            yield Candidate("FIO", *doc.span(a, b), score, "dictionary", "fio", a, b)
        i += n


DIGIT = "[0-9]"
_MONTH_GATE = "|".join(P.GENITIVE_MONTHS)
#: name -> (types, detector), in the order that breaks ties.
DETECTORS: dict[str, list[tuple[tuple[str, ...], Callable[[Document, Lists], Iterator[Candidate]]]]] = {}


def _register(name: str, types: tuple[str, ...], *detectors) -> None:
    DETECTORS[name] = [(types, d) for d in detectors]


def _pattern(name, types, regex, judge, **more):
    return Pattern(name, types, regex, judge, **more)


def _register_patterns(name: str, types: tuple[str, ...], *rows: dict) -> None:
    _register(name, types, *(Pattern(name, types, **r) for r in rows))


_register_patterns("card_number", ("CARD_NUMBER",), {"regex": P.CARD, "judge": _card, "gate": DIGIT})
_register_patterns("cvv", ("CVV",), {"regex": P.CVV, "judge": _always("CVV", 0.9), "group": 1, "bounded": False, "gate": DIGIT})
_register_patterns("pin", ("PIN",), {"regex": P.PIN, "judge": _always("PIN", 0.9), "group": 1, "bounded": False, "gate": DIGIT})
_register_patterns("card_holder", ("CARD_HOLDER",), {"regex": P.CARD_HOLDER, "judge": _always("CARD_HOLDER", 0.9), "group": 1, "bounded": False, "gate": "держател|имя|card"})
_register_patterns("inn", ("INN", "ORG_INN"), {"regex": P.INN, "judge": _inn, "source": "checksum", "gate": DIGIT})
_register_patterns("passport", ("PASSPORT",), {"regex": P.PASSPORT, "judge": _passport, "gate": DIGIT})
_register_patterns("division_code", ("DIVISION_CODE",), {"regex": P.DIVISION, "judge": _division, "gate": DIGIT})
_register_patterns("phone", ("PHONE",), {"regex": P.PHONE_RF, "judge": _phone_rf, "gate": DIGIT}, {"regex": P.PHONE_INTL, "judge": _phone_intl, "gate": r"\+[0-9]"})
_register_patterns("email", ("EMAIL",), {"regex": P.EMAIL, "judge": _always("EMAIL", 0.95), "gate": "@"})
_register_patterns("snils", ("SNILS",), {"regex": P.SNILS, "judge": _snils, "source": "checksum", "gate": DIGIT})
_register_patterns("date", DATES, {"regex": P.DATE_NUMERIC, "judge": _date_numeric, "gate": DIGIT}, {"regex": P.DATE_TEXT, "judge": _date_text, "gate": DIGIT})
_register_patterns("numeral_date", DATES, {"regex": P.DATE_NUMERAL, "judge": _date_numeral, "bounded": False, "gate": _MONTH_GATE})
_register("address", ("ADDRESS", "ADDR_INDEX", "ADDR_REGION", "ADDR_CITY", "ADDR_STREET", "ADDR_HOUSE", "ADDR_FLAT"), _address)
_register_patterns("citizenship", ("CITIZENSHIP",), {"regex": P.CITIZENSHIP_VALUE, "judge": _citizenship, "group": 1, "bounded": False, "gate": "граждан"}, {"regex": P.CITIZENSHIP_PHRASE, "judge": _citizenship, "bounded": False, "gate": "граждан"})
_register("fio", ("FIO",), _fio)
_register_patterns("driver_license", ("DRIVER_LICENSE",), {"regex": P.LICENSE, "judge": _license, "gate": DIGIT})
_register("birth_place", ("BIRTH_PLACE",), _birth_place)
_register("passport_issuer", ("PASSPORT_ISSUER",), _issuer)
_register_patterns("structured_field", tuple(dict.fromkeys(P.FIELDS.values())), {"regex": P.STRUCTURED, "judge": _structured, "group": 2, "bounded": False, "gate": "[:=]"})


def config_regex(pd_type: str, pattern: str, value_group: str = "value", validator: str | None = None, base_score: float = 0.8, context_pos: tuple[str, ...] = (), context_neg: tuple[str, ...] = (), window: tuple[int, int] = (60, 20)):
    """A detector from configuration; a validator marks, but never rejects."""
    regex = re.compile(pattern)

    def detect(doc: Document, lists: Lists) -> Iterator[Candidate]:
        for m in regex.finditer(doc.norm):
            if not doc.at_boundary(*m.span()):
                continue
            named = value_group in regex.groupindex and m.start(value_group) >= 0
            a, b = m.span(value_group) if named else m.span()
            ok = validator in ("luhn", "inn", "snils", "date") and V.VALIDATORS[validator](doc.norm[a:b])
            around, score = doc.window(*m.span(), *window), base_score
            score = min(1.0, score + 0.35) if has_word(around, frozenset(context_pos)) else score
            score = max(0.0, score - 0.5) if has_word(around, frozenset(context_neg)) else score
            yield Candidate(pd_type, *doc.span(a, b), score, "custom", "config_regex", a, b, bool(ok))

    return (pd_type,), detect


def detect(doc: Document, types: frozenset[str], lists: Lists, extra: tuple = ()) -> list[Candidate]:
    """Candidates of all detectors that a policy's types ask for; the one for organisations always runs."""
    out: list[Candidate] = []
    for kinds, run in [d for group in DETECTORS.values() for d in group] + list(extra):
        if "ORG_INN" in kinds or not types.isdisjoint(kinds):
            out += run(doc, lists)
    return out
