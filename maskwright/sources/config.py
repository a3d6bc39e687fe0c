"""Configuration: types, profiles, systems and routes, checked and compiled to policies."""

from __future__ import annotations

import hashlib
import json
import os
from pathlib import Path

from ..operators.rules import Policy, Rule

# Label, priority and threshold of each type.
PD_TYPES = {
    "FIO": ("ФИО", 50, 0.7), "BIRTH_DATE": ("ДАТА_РОЖД", 70, 0.6), "BIRTH_PLACE": ("МЕСТО_РОЖД", 55, 0.6), "PASSPORT": ("ПАСПОРТ", 90, 0.6),
    "CITIZENSHIP": ("ГРАЖДАНСТВО", 45, 0.6), "PASSPORT_ISSUER": ("ОРГАН", 55, 0.6), "DIVISION_CODE": ("КОД_ПОДР", 75, 0.6),
    "PASSPORT_ISSUE_DATE": ("ДАТА_ВЫД", 70, 0.6), "DRIVER_LICENSE": ("ВУ", 85, 0.6), "ADDRESS": ("АДРЕС", 60, 0.6), "ADDR_COUNTRY": ("СТРАНА", 45, 0.6),
    "ADDR_INDEX": ("ИНДЕКС", 45, 0.6), "ADDR_REGION": ("РЕГИОН", 45, 0.6), "ADDR_CITY": ("ГОРОД", 45, 0.6), "ADDR_STREET": ("УЛИЦА", 45, 0.6),
    "ADDR_HOUSE": ("ДОМ", 45, 0.6), "ADDR_FLAT": ("КВ", 45, 0.6), "EMAIL": ("EMAIL", 80, 0.6), "PHONE": ("ТЕЛЕФОН", 80, 0.6), "INN": ("ИНН", 95, 0.6),
    "CARD_NUMBER": ("КАРТА", 100, 0.7), "CVV": ("CVV", 40, 0.6), "PIN": ("ПИН", 40, 0.6), "CARD_HOLDER": ("ДЕРЖАТЕЛЬ", 52, 0.6), "SNILS": ("СНИЛС", 90, 0.6),
    "FOREIGN_PASSPORT": ("ЗАГРАН", 85, 0.6), "OMS_POLICY": ("ПОЛИС", 85, 0.6), "BIRTH_CERT": ("СВИД_РОЖД", 85, 0.6), "MILITARY_ID": ("ВОЕН_БИЛЕТ", 85, 0.6),
    "DATE": ("ДАТА", 10, 0.6), "ORG_INN": ("ИНН_ОРГ", 95, 0.6), "UNCLASSIFIED_ID": ("ID", 5, 0.6),
}
ADDRESS_PARTS = ("ADDR_COUNTRY", "ADDR_INDEX", "ADDR_REGION", "ADDR_CITY", "ADDR_STREET", "ADDR_HOUSE", "ADDR_FLAT")
#: The configuration that queries and tests use.
DEFAULT = {
    "pd_types": {k: {"label": a, "priority": b, "threshold": c} for k, (a, b, c) in PD_TYPES.items()},
    "profiles": {
        "strict": {
            "types": {
                **{t: {"mask": "placeholder"} for t in ("FIO", "BIRTH_DATE", "BIRTH_PLACE", "PASSPORT", "PASSPORT_ISSUER", "DIVISION_CODE", "PASSPORT_ISSUE_DATE", "CITIZENSHIP", "DRIVER_LICENSE", "EMAIL", "PHONE", "INN", "CARD_HOLDER", "SNILS")},
                "ADDRESS": {"mask": "placeholder", "mode": "components"},
                "CARD_NUMBER": {"mask": "partial", "keep_last": 4},
                "CVV": {"mask": "redact"},
                "PIN": {"mask": "redact"},
            },
            "filters": ["public_persons", "bank_allowlist", "org_context", "negative_number_context"],
            "combination": {
                "rules": {"PIN": {"requires_any": ["CARD_NUMBER"], "scope": "document"}, "CVV": {"requires_any": ["CARD_NUMBER"], "scope": "window", "window_chars": 200}},
                "min_distinct_types": 1,
                "always_mask": ["CARD_NUMBER", "PASSPORT", "INN"],
            },
            "demask": True,
        },
        "cards_only": {
            "types": {"CARD_NUMBER": {"mask": "token"}, "CVV": {"mask": "redact"}, "PIN": {"mask": "redact"}, "CARD_HOLDER": {"mask": "synthetic"}},
            "filters": ["bank_allowlist"],
            "demask": True,
        },
    },
    "defaults": {"profile": "strict", "placeholder": {"format": "[{label}_{n}]"}},
    "systems": {
        "crm-assistant": {"enabled": True, "profile": "strict", "demask": True, "rate_limit_rps": 500},
        "payments-bot": {"enabled": True, "profile": "cards_only", "demask": True, "overrides": {"types": {"PHONE": {"mask": "partial"}, "PIN": {"disabled": True}}, "combination": {"rules": {"PIN": None}}}},
        "analytics": {"enabled": False, "profile": "strict"},
    },
    "upstreams": {"llm-main": {}},
    "routes": [
        {"id": "chat", "match": {"method": "POST", "path": "/v1/chat/completions"}, "upstream": "llm-main", "request": ["$.messages[*].content", "$.messages[*].content[*].text"], "response": ["$.choices[*].message.content"], "demask": True},
        {"id": "embeddings", "match": {"method": "POST", "path": "/v1/embeddings"}, "upstream": "llm-main", "request": ["$.input", "$.input[*]"], "response": [], "demask": False},
        {"id": "models", "match": {"method": "GET", "path": "/v1/models"}, "upstream": "llm-main", "action": "bypass"},
        {"id": "files", "match": {"method": "POST", "path_prefix": "/v1/files"}, "action": "block"},
    ],
}


def load(path: str) -> dict:
    """A configuration from JSON, or from YAML where a YAML library is installed; checked."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        cfg = json.loads(text)
    else:
        try:
            import yaml
        except ImportError as e:
            raise ValueError("no YAML library is installed; write the configuration as JSON") from e
        cfg = yaml.safe_load(text)
    return check(cfg)


def secret(ref: str) -> str:
    """``env:NAME``, ``file:PATH`` or the value itself."""
    kind, _, rest = ref.partition(":")
    if kind == "env":
        return os.environ[rest]
    return Path(rest).read_text(encoding="utf-8").strip() if kind == "file" else ref


def check(cfg: dict) -> dict:
    """Raises for types, profiles and upstreams that aren't declared, and for routes with one match."""
    declared, profiles = set(cfg["pd_types"]), set(cfg["profiles"])
    for name, p in cfg["profiles"].items():
        if unknown := set(p["types"]) - declared:
            raise ValueError(f"profile {name}: types {sorted(unknown)} aren't declared")
    for name, s in cfg["systems"].items():
        if s.get("profile", cfg["defaults"]["profile"]) not in profiles:
            raise ValueError(f"system {name}: no such profile")
    seen = set()
    for r in cfg.get("routes", []):
        if r.get("profile") and r["profile"] not in profiles:
            raise ValueError(f"route {r['id']}: no such profile")
        if r.get("upstream") and r["upstream"] not in cfg.get("upstreams", {}):
            raise ValueError(f"route {r['id']}: no such upstream")
        key = json.dumps(r["match"], sort_keys=True)
        if key in seen:
            raise ValueError(f"route {r['id']}: another has its match")
        seen.add(key)
    return cfg


def _merged(profile: dict, over: dict) -> dict:
    types = dict(profile["types"])
    for t, v in over.get("types", {}).items():
        if v.get("disabled"):
            types.pop(t, None)
        else:
            types[t] = v
    old, new = profile.get("combination", {}), over.get("combination", {})
    rules = {k: v for k, v in {**old.get("rules", {}), **new.get("rules", {})}.items() if v is not None}
    both = {**old, **{k: v for k, v in new.items() if v}, "rules": rules}
    return {**profile, "types": types, "filters": over.get("filters") or profile.get("filters", []), "combination": both}


def policy_for(cfg: dict, system: str, route: str | None = None) -> Policy | str:
    """The policy of a system on a route, or why there is none."""
    s = cfg["systems"].get(system)
    if s is None:
        return "unknown_system"
    if not s.get("enabled", True):
        return "system_disabled"
    r = next((x for x in cfg.get("routes", []) if x["id"] == route), None) if route else None
    if route and r is None:
        return "unknown_route"
    if route and s.get("routes") and route not in s["routes"]:
        return "route_forbidden"
    name = (r or {}).get("profile") or s.get("profile") or cfg["defaults"]["profile"]
    p = _merged(cfg["profiles"][name], s.get("overrides", {}))
    if r:
        p = _merged(p, {"types": r.get("types", {})})
        p = _merged(p, s.get("route_overrides", {}).get(route, {}))
    types, masks = set(p["types"]), {t: v.get("mask", "placeholder") for t, v in p["types"].items()}
    mode = p["types"].get("ADDRESS", {}).get("mode", "whole")
    if "ADDRESS" in types and mode == "components":
        types.update(ADDRESS_PARTS)
        masks = {**dict.fromkeys(ADDRESS_PARTS, masks["ADDRESS"]), **masks}
    c = p.get("combination", {})
    return Policy(
        types=frozenset(types),
        masks=masks,
        keep_last={t: v["keep_last"] for t, v in p["types"].items() if "keep_last" in v},
        labels={t: v["label"] for t, v in cfg["pd_types"].items()},
        thresholds={t: v["threshold"] for t, v in cfg["pd_types"].items()},
        priorities={t: v["priority"] for t, v in cfg["pd_types"].items()},
        filters=tuple(p.get("filters", ())),
        rules={t: Rule(tuple(v.get("requires_any", ())), tuple(v.get("requires_all", ())), v.get("scope", "document"), v.get("window_chars", 200)) for t, v in c.get("rules", {}).items()},
        min_distinct_types=c.get("min_distinct_types", 0),
        always_mask=tuple(c.get("always_mask", ())),
        address_mode=mode,
        demask=(r or {}).get("demask", True) and s.get("demask", False) and p.get("demask", True),
        placeholder=cfg["defaults"]["placeholder"]["format"],
    )


def policies(cfg: dict) -> dict[tuple[str, str | None], Policy]:
    """Of every enabled system, without a route and on each."""
    pairs = [(s, r) for s, v in cfg["systems"].items() if v.get("enabled", True) for r in (None, *(x["id"] for x in cfg.get("routes", [])))]
    return {k: p for k in pairs if isinstance(p := policy_for(cfg, *k), Policy)}


def key_hash(key: str) -> str:
    return hashlib.sha256(key.encode()).hexdigest()
