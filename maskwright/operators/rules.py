"""From candidates to entities: relevance filters, overlap resolution, co-occurrence rules."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from ..functions.text import Document
from . import patterns as P
from .detectors import Candidate, Lists

ADDRESS_TYPES = frozenset(("ADDRESS", "ADDR_CITY", "ADDR_STREET", "ADDR_HOUSE", "ADDR_FLAT", "ADDR_REGION", "ADDR_INDEX"))


@dataclass(frozen=True)
class Rule:
    requires_any: tuple[str, ...] = ()
    requires_all: tuple[str, ...] = ()
    scope: str = "document"
    window: int = 200


@dataclass(frozen=True)
class Policy:
    """What one system on one route has masked, and how."""

    types: frozenset[str]
    masks: dict[str, str] = field(default_factory=dict)
    keep_last: dict[str, int] = field(default_factory=dict)
    labels: dict[str, str] = field(default_factory=dict)
    thresholds: dict[str, float] = field(default_factory=dict)
    priorities: dict[str, int] = field(default_factory=dict)
    filters: tuple[str, ...] = ()
    rules: dict[str, Rule] = field(default_factory=dict)
    min_distinct_types: int = 0
    always_mask: tuple[str, ...] = ()
    address_mode: str = "whole"
    demask: bool = True
    placeholder: str = "[{label}_{n}]"
    strict_org_words: bool = False


def _plain(text: str) -> str:
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def keep_public_person(doc: Document, c: Candidate, every: list[Candidate], lists: Lists, policy: Policy) -> bool:
    if c.pd_type != "FIO":
        return True
    name = doc.slice(c.start, c.end).lower()
    if not any(f.lower() in name for forms in lists.public_persons for f in forms):
        return True
    around = doc.window(c.n_start, c.n_end, 80, 80)
    if any(w in around for w in P.PERSON_MARKERS) or any((o.start, o.end) != (c.start, c.end) and o.score >= 0.8 and o.pd_type != "FIO" for o in every):
        return True
    return not any(w in around for w in P.PERSON_NEGATIVE)


def keep_unless_bank(doc: Document, c: Candidate, every: list[Candidate], lists: Lists, policy: Policy) -> bool:
    around = _plain(doc.text_window(c.start, c.end, 60, 60))
    if any(f" {o} " in f" {around} " for o in map(_plain, lists.bank_offices) if o):
        return False
    if (c.pd_type in ADDRESS_TYPES or c.pd_type == "PHONE") and any(p in around for p in P.OFFICE_PHRASES):
        return False
    digits = re.sub("[^0-9]", "", doc.slice(c.start, c.end))
    return not (c.pd_type == "PHONE" and any(p and p in digits for p in lists.bank_phones))


def keep_unless_number(doc: Document, c: Candidate, every: list[Candidate], lists: Lists, policy: Policy) -> bool:
    if c.pd_type not in ("PASSPORT", "PHONE", "INN", "ORG_INN") or c.checksum_ok:
        return True
    before = doc.window(c.n_start, c.n_start, 60, 0)
    return not any(w in before for w in P.NUMBER_NEGATIVE)


def keep_unless_org(doc: Document, c: Candidate, every: list[Candidate], lists: Lists, policy: Policy) -> bool:
    """Looks for the short forms anywhere near, inside words too, unless the policy wants whole words."""
    if c.pd_type != "FIO":
        return True
    around = doc.window(c.n_start, c.n_end, 40, 40)
    near = set(re.findall(r"[^\W_]+", around)) if policy.strict_org_words else around
    return not any(w in near for w in P.ORG_WORDS)


FILTERS = {"public_persons": keep_public_person, "bank_allowlist": keep_unless_bank, "org_context": keep_unless_org, "negative_number_context": keep_unless_number}


def relevant(doc: Document, every: list[Candidate], policy: Policy, lists: Lists) -> list[Candidate]:
    """What all of the policy's filters keep (none named: all filters); each sees all candidates."""
    chosen = [f for k, f in FILTERS.items() if not policy.filters or k in policy.filters]
    return [c for c in every if all(f(doc, c, every, lists, policy) for f in chosen)]


def _rank(c: Candidate, policy: Policy) -> tuple:
    return c.checksum_ok, policy.priorities.get(c.pd_type, 50)


def _wins(new: Candidate, old: Candidate, policy: Policy) -> bool:
    if _rank(new, policy) != _rank(old, policy):
        return _rank(new, policy) > _rank(old, policy)
    if abs(new.score - old.score) > 1.2e-7:
        return new.score > old.score
    return new.end - new.start > old.end - old.start


def resolve(every: list[Candidate], policy: Policy) -> list[Candidate]:
    """One pass by start: a candidate that overlaps the last chosen one takes its place or is dropped."""
    out: list[Candidate] = []
    for c in sorted((c for c in every if c.score >= policy.thresholds.get(c.pd_type, 0.6) - 1e-9), key=lambda c: c.start):
        last = out[-1] if out else None
        if not last or c.start >= last.end or last.start >= c.end:
            out.append(c)
        elif last.pd_type == "ADDRESS" and any(p.start < last.end and last.start < p.end for p in c.components):
            continue
        elif _wins(c, last, policy):
            out[-1] = c
    return out


def combine(entities: list[Candidate], policy: Policy) -> list[Candidate]:
    """Too few types: only those always masked. Else each entity's rule, on what there was before."""
    kinds = {e.pd_type for e in entities}
    if len(kinds) < policy.min_distinct_types:
        return [e for e in entities if e.pd_type in policy.always_mask]

    def fits(e: Candidate) -> bool:
        if (rule := policy.rules.get(e.pd_type)) is None:
            return True
        near = kinds if rule.scope == "document" else {o.pd_type for o in entities if abs(o.start - e.start) <= rule.window}
        return (not rule.requires_any or not near.isdisjoint(rule.requires_any)) and near.issuperset(rule.requires_all)

    return [e for e in entities if fits(e)]


def expand(entities: list[Candidate], policy: Policy) -> list[Candidate]:
    """Addresses by components, if so asked; then only the policy's types."""
    if policy.address_mode == "components":
        entities = [p for e in entities for p in (e.components if e.pd_type == "ADDRESS" and e.components else [e])]
    return [e for e in entities if e.pd_type in policy.types]


def canonical(text: str, pd_type: str) -> str:
    if pd_type in ("CARD_NUMBER", "INN", "ORG_INN", "SNILS", "PHONE"):
        return re.sub("[^0-9]", "", text)
    return " ".join(text.lower().split()) if pd_type in ("FIO", "CARD_HOLDER") else text.lower()
