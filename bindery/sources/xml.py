"""A tolerant XML tokenizer: unbound prefixes, unknown entities and stray markup do not stop it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<\?.*?\?>|<![^>\[]*(?:\[.*?\]\s*)?>"
    r"|</(?P<end>[^\s>]+)\s*>|<(?P<start>[^\s/>!?]+)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>|(?P<text>[^<]+)|(?P<stray><)",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')", re.S)
_REFERENCE = re.compile(r"&(#x[0-9A-Fa-f]+|#[0-9]+|[A-Za-z][\w.-]*);")
_NAMED = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_SPACE = " \t\r\n\x0b\x0c\x85\xa0                　"


@dataclass
class Element:
    """A start tag, or an end tag with ``closing``; text and CDATA have no name."""

    name: str = ""
    attributes: list[tuple[str, str]] = field(default_factory=list)
    empty: bool = False
    closing: bool = False
    text: str = ""
    cdata: bool = False

    @property
    def local(self) -> str:
        return self.name.rpartition(":")[2]

    @property
    def prefix(self) -> str:
        return self.name.partition(":")[0] if ":" in self.name else ""

    def get(self, name: str) -> str | None:
        return next((v for k, v in self.attributes if k == name), None)


def _reference(m: re.Match) -> str:
    name = m[1]
    if name[0] != "#":
        return _NAMED.get(name, m[0])
    try:
        return chr(int(name[2:], 16) if name[1] in "xX" else int(name[1:]))
    except (ValueError, OverflowError):
        return m[0]


def unescape(text: str) -> str:
    """Numeric and predefined references; any other stays as it is."""
    return _REFERENCE.sub(_reference, text)


def events(source: str) -> Iterator[Element]:
    for m in _TOKEN.finditer(source):
        if m["start"] is not None:
            found = [(k, unescape(a or b or "")) for k, a, b in _ATTRIBUTE.findall(m["rest"])]
            yield Element(m["start"], found, bool(m["empty"]))
            if m["empty"]:
                yield Element(m["start"], closing=True)
        elif m["end"] is not None:
            yield Element(m["end"], closing=True)
        elif m["cdata"] is not None:
            yield Element(text=m["cdata"], cdata=True)
        elif m["text"] is not None:
            yield Element(text=m["text"])


def add_text(value: str, raw: str) -> str:
    """``value`` with a run of text: lines become one paragraph, and space at either end one space."""
    body = raw.strip(_SPACE)
    if (not body or raw[:1] in _SPACE) and value and not value.endswith(" "):
        value += " "
    if not body:
        return value
    value += " ".join(line.strip(_SPACE) for line in body.splitlines() if line.strip(_SPACE))
    return value + " " * (raw[-1:] in _SPACE)


def element_text(stream: Iterator[Element], name: str) -> str:
    """Text up to the end tag of this name. References neither trim nor pad; CDATA is trimmed and appended as it is."""
    value = ""
    for e in stream:
        if e.closing and e.name == name:
            break
        if e.cdata:
            value += e.text.strip(_SPACE)
        elif not e.name:
            at = 0
            for m in _REFERENCE.finditer(e.text):
                if m.start() > at:
                    value = add_text(value, e.text[at : m.start()])
                value += _reference(m)
                at = m.end()
            if at < len(e.text):
                value = add_text(value, e.text[at:])
    return value.strip(_SPACE)


def decode(data: bytes) -> str:
    """UTF-16 with a byte order mark, else UTF-8."""
    if data[:2] in (b"\xff\xfe", b"\xfe\xff"):
        if len(data) % 2:
            raise ValueError("odd number of bytes in UTF-16")
        return data.decode("utf-16")
    return data.decode("utf-8-sig", errors="replace")
