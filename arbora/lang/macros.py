"""Textual macros: ``$name$`` is replaced before parsing, again and again."""

from __future__ import annotations

import re

MACRO = re.compile(r"\$([A-Za-z_]\w*)\$")


def expand(text: str, macros: dict[str, str], depth: int = 50) -> str:
    """Unknown names stay; more than ``depth`` rounds are a loop."""
    for _ in range(depth):
        if not any(m in macros for m in MACRO.findall(text)):
            return text
        text = MACRO.sub(lambda m: macros.get(m[1], m[0]), text)
    raise ValueError("macros refer to each other without end")


def library(entries: dict[str, dict[str, str]], name: str) -> dict[str, str]:
    """Entries of a library with those it includes (``includes``: names by comma); its own win."""
    seen: set[str] = set()

    def load(n: str) -> dict[str, str]:
        if n in seen:
            return {}
        seen.add(n)
        own, out = dict(entries.get(n, {})), {}
        for i in filter(None, (x.strip() for x in own.pop("includes", "").split(","))):
            out |= load(i)
        return out | own

    return load(name)


PLACE = re.compile(r"\$\(([A-Za-z_]\w*)(?:,([^()]*))?\)")


def fill(text: str, parameters: dict) -> str:
    """Places ``$(name)`` or ``$(name,default)`` of a stored query; one without value or default raises."""

    def value(m: re.Match) -> str:
        found = parameters.get(m[1], m[2])
        if found is None:
            raise ValueError(f"the query needs {m[1]}")
        return str(found)

    return PLACE.sub(value, text)
