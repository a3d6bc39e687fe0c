"""JSON paths: $, .key, ["key"], [*] and [n], over string leaves."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_STEP = re.compile(r'\.([^.\[]+)|\["([^"]*)"\]?|\[(\*)\]?|\[(\d+)\]?|\["[^"]*$|.', re.S)
ALL = object()


def parse_path(path: str) -> list | None:
    """Keys, numbers and ALL; None for what isn't a path. Characters that mean nothing are passed over."""
    path = path.strip()
    if not path.startswith("$"):
        return None
    steps: list = []
    for m in _STEP.finditer(path, 1):
        if m[0].startswith('["') and m.lastindex is None:
            return None
        if m.lastindex:
            steps.append((m[1], m[2], ALL, int(m[4] or 0))[m.lastindex - 1])
    return steps


def _walk(value, steps: list, f: Callable[[str], str]):
    if not steps:
        return f(value) if isinstance(value, str) else value
    step, rest = steps[0], steps[1:]
    if isinstance(value, dict) and isinstance(step, str) and step in value:
        return value | {step: _walk(value[step], rest, f)}
    if isinstance(value, list):
        return [_walk(v, rest, f) if step is ALL or step == i and not isinstance(step, str) else v for i, v in enumerate(value)]
    return value


def replace_strings(body: str, paths: list[str], f: Callable[[str], str]) -> str:
    """The JSON text with f over the strings at the paths, path after path; keys come out sorted."""
    value = json.loads(body)
    for p in paths:
        if (steps := parse_path(p)) is not None:
            value = _walk(value, steps, f)
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def extract_strings(body: str, path: str) -> list[str]:
    found: list[str] = []
    steps = parse_path(path)
    if steps is not None:
        _walk(json.loads(body), steps, lambda s: found.append(s) or s)
    return found
