"""Markup as a stream of events that add up to the text they came from."""

from __future__ import annotations

import re
from html import unescape
from typing import NamedTuple
from xml.sax.saxutils import quoteattr

_EVENT = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<\?.*?\?>|<![^>\[]*(?:\[[^\]]*\])?[^>]*>|<(/?)([A-Za-z_][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(/?)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=]+)\s*=\s*(\"[^\"]*\"|'[^']*')")


class Event(NamedTuple):
    kind: str  # start, empty, end, text, other
    raw: str
    name: str = ""

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    def attributes(self) -> dict[str, str]:
        inside = self.raw[1 + len(self.name) :].rstrip(">").rstrip("/")
        return {k: unescape(v[1:-1]) for k, v in _ATTRIBUTE.findall(inside)}


def events(text: str):
    at = 0
    for m in _EVENT.finditer(text):
        if m.start() > at:
            yield Event("text", text[at : m.start()])
        if m[2] is None:
            yield Event("other", m[0])
        else:
            yield Event("end" if m[1] else "empty" if m[4] else "start", m[0], m[2])
        at = m.end()
    if at < len(text):
        yield Event("text", text[at:])


def tag(event: Event, overrides: dict[str, str] | None = None, missing: dict[str, str] | None = None) -> str:
    """The start tag with attributes replaced or added, in their order."""
    have = event.attributes()
    merged = {k: (overrides or {}).get(k, v) for k, v in have.items()}
    merged |= {k: v for k, v in (overrides or {}).items() if k not in have} | {k: v for k, v in (missing or {}).items() if k not in have}
    inner = "".join(f" {k}={quoteattr(v, {chr(34): '&quot;'})}" for k, v in merged.items())
    return f"<{event.name}{inner}{'/' if event.kind == 'empty' else ''}>"
