"""Secrets: probabilistic automata learnt from labelled credentials score every token-like string.

For each format a prefix tree of labelled credentials is built over character classes, and states are merged where Hoeffding's
bound cannot tell their next-symbol and ending frequencies apart (recursively, so that the automaton stays deterministic). A
candidate's score is its mean log-likelihood under the best automaton less that under an automaton of ordinary strings. Base
formats are always spans; other candidates are spans where the score exceeds the threshold, calibrated on held-out strings.

Candidates are runs of token characters, and of each run with "=" or "/" inside, the parts between these too: the run goes as one
if it passes, else each of its parts that does. All of ``CANDIDATE`` characters or more with two kinds of small letters, capitals and
digits are scored.

Credentials and ordinary strings are labelled by the seeded generator that makes them, ``EXAMPLES`` of each format.

Defined results: a null text counts as empty and has no spans; null ids stay null; repeated rows get equal results; an empty table
gives an empty result; other columns are ignored. Candidates overlapping a base span are no further spans.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import slices

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
KEYWORD = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: Token-like strings that are scored: this many characters of [A-Za-z0-9+/_=.-] or more, of two kinds of letters and digits.
CANDIDATE = 12
_KINDS = re.compile(r"[a-z].*[0-9A-Z]|[0-9].*[A-Za-z]|[A-Z].*[a-z0-9]", re.DOTALL)
_PART = re.compile(r"[^=/]+")
EXAMPLES = 300
ALPHA = 0.05
#: Share of held-out ordinary strings that may pass.
FALSE_RATE = 0.002

_HEX = np.zeros(256, bool)
_HEX[[*b"0123456789abcdef"]] = True
_TOKEN = np.zeros(256, bool)
_TOKEN[[*(string.ascii_letters + string.digits + "+/_=.-").encode()]] = True


def classes(text: str) -> str:
    """Digits as 0, hexadecimal small letters as f, other small ones as a, capitals as A, signs as they are."""
    return "".join("0" if c.isdigit() else "f" if c in "abcdef" else "a" if c.islower() else "A" if c.isupper() else c for c in text)


@dataclass
class State:
    ends: int = 0
    next: dict[str, tuple[int, int]] = field(default_factory=dict)  # symbol -> (state, count)

    @property
    def total(self) -> int:
        return self.ends + sum(n for _, n in self.next.values())


class Automaton:
    """A deterministic probabilistic automaton learnt by state merging."""

    def __init__(self, words: list[str], alpha: float = ALPHA) -> None:
        self.states: dict[int, State] = {0: State()}
        for w in words:
            at = 0
            for c in w:
                to, n = self.states[at].next.get(c, (len(self.states), 0))
                self.states.setdefault(to, State())
                self.states[at].next[c] = to, n + 1
                at = to
            self.states[at].ends += 1
        self.scale = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()
        self.symbols = 1 + len({c for w in words for c in w})

    def _differ(self, a: int, n: int, b: int, m: int) -> bool:
        return n > 0 and m > 0 and abs(a / n - b / m) > self.scale * (1 / math.sqrt(n) + 1 / math.sqrt(m))

    def _compatible(self, p: int, q: int) -> bool:
        a, b = self.states[p], self.states[q]
        n, m = a.total, b.total
        if self._differ(a.ends, n, b.ends, m):
            return False
        for c in {*a.next, *b.next}:
            (x, i), (y, j) = a.next.get(c, (-1, 0)), b.next.get(c, (-1, 0))
            if self._differ(i, n, j, m):
                return False
            if x >= 0 and y >= 0 and x != y and not self._compatible(x, y):
                return False
        return True

    def _fold(self, p: int, q: int) -> None:
        """Adds the tree below q to p."""
        a, b = self.states[p], self.states.pop(q)
        a.ends += b.ends
        for c, (y, j) in b.next.items():
            x, i = a.next.get(c, (y, 0))
            a.next[c] = x, i + j
            if x != y:
                self._fold(x, y)

    def _merge_all(self) -> None:
        red, blue = [0], sorted({to for to, _ in self.states[0].next.values()})
        while blue:
            q = blue.pop(0)
            if q not in self.states:
                continue
            for p in red:
                if self._compatible(p, q):
                    for state in self.states.values():
                        for c, (to, n) in state.next.items():
                            if to == q:
                                state.next[c] = p, n
                    self._fold(p, q)
                    break
            else:
                red.append(q)
            known = {*red}
            blue = sorted({to for s in red for to, _ in self.states[s].next.values() if to not in known})

    def score(self, word: str) -> float:
        """Mean log-probability of a symbol; what the automaton has never seen gets one half of a count."""
        at, total = 0, 0.0
        for c in [*word, ""]:
            state = self.states.get(at)
            n = state.total if state else 0
            to, k = (-1, state.ends if state else 0) if c == "" else state.next.get(c, (-1, 0)) if state else (-1, 0)
            total += math.log((k + 0.5 / self.symbols) / (n + 0.5 * 2))
            at = to
        return total / (len(word) + 1)


def examples(seed: int) -> dict[str, list[str]]:
    """Credentials by format, and ordinary strings, true to their labels by construction."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    letters, mixed = string.ascii_letters, string.ascii_letters + string.digits
    word = lambda: pick("aeinorstldcu", r.randint(3, 9))
    make = {
        "access": lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        "hex": lambda: pick("0123456789abcdef", r.choice([32, 40, 64])),
        "key": lambda: pick(mixed, r.choice([24, 32, 40])),
        "base64": lambda: pick(mixed + "+/", r.choice([40, 44])) + r.choice(["", "=", "=="]),
        "prefixed": lambda: r.choice(["ghp_", "sk_live_", "xoxb-"]) + pick(mixed, 36),
        "signed": lambda: "eyJ" + pick(mixed, 20) + ".eyJ" + pick(mixed, 40) + "." + pick(mixed + "-_", 43),
        "ordinary": lambda: r.choice(
            [
                lambda: "-".join(word() for _ in range(r.randint(3, 5))) + str(r.randint(1, 2030)),
                lambda: "/".join(word() for _ in range(4)) + f"/{r.randint(1, 99)}.html",
                lambda: f"{word()}.{word()}.{word()}.v{r.randint(1, 20)}.{r.randint(0, 9)}",
                lambda: "_".join(word() for _ in range(4)) + f"_{r.randint(0, 999)}",
                lambda: word().capitalize() + word().capitalize() + word().capitalize() + str(r.randint(0, 99)),
                lambda: f"{r.randint(1990, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}.{r.randint(10, 59)}",
                lambda: "=" * r.randint(8, 20) + pick(letters, 1) + pick(string.digits, 1) + "-" * r.randint(8, 20),
                lambda: pick(letters.lower(), 1) * r.randint(14, 30) + str(r.randint(0, 9)),
                lambda: (word() + word() + word() + word())[: r.randint(12, 24)].capitalize(),
                lambda: "".join(word().capitalize() for _ in range(r.randint(3, 5))),
                lambda: word() + word().capitalize() + word().capitalize(),
                lambda: "_".join(word().upper() for _ in range(r.randint(2, 4))) + r.choice(["", "_" + str(r.randint(0, 99))]),
                lambda: word() + pick(string.digits, r.randint(2, 4)) + "." + r.choice(["jpg", "png", "txt", "html", "csv"]),
                lambda: word().capitalize() + "-" + word() + "-" + word().capitalize(),
            ]
        )(),
    }
    return {k: [f() for _ in range(EXAMPLES)] for k, f in make.items()}


@dataclass(frozen=True)
class Model:
    formats: dict[str, Automaton]
    ordinary: Automaton
    threshold: float

    def score(self, text: str) -> tuple[float, str]:
        seen = classes(text)
        best, kind = max((a.score(seen), k) for k, a in self.formats.items())
        return best - self.ordinary.score(seen), kind


@cache
def model() -> Model:
    made, held = examples(1), examples(2)
    formats = {k: Automaton([classes(w) for w in v]) for k, v in made.items() if k != "ordinary"}
    first = Model(formats, Automaton([classes(w) for w in made["ordinary"]]), 0.0)
    scores = sorted((first.score(w)[0] for w in held["ordinary"]), reverse=True)
    return Model(formats, first.ordinary, max(0.05, scores[int(FALSE_RATE * len(scores))]))


def _runs(inside: np.ndarray, least: int) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - start >= least
    return list(zip(start[keep].tolist(), end[keep].tolist(), strict=True))


def base_spans(data: bytes, text: str | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = []
    lower = data.lower()
    if any(k in lower for k in KEYWORD):
        text = data.decode() if text is None else text
        out += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if b"AKIA" in data:
        text = data.decode() if text is None else text
        out += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    runs = _runs(_HEX[np.frombuffer(data, np.uint8)], LEAST["hex"])
    out += [(a, b, "hex") for a, b in _points(data, runs)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _points(data: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Byte offsets of ASCII runs as offsets in code points."""
    if not runs:
        return []
    if data.isascii():
        return runs
    before = np.concatenate(([0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)))
    return [(int(before[a]), int(before[b])) for a, b in runs]


def candidates(data: bytes) -> list[tuple[int, int, str]]:
    """(start, end, string) of every token-like string, in code points."""
    buf = np.frombuffer(data, np.uint8)
    runs = _runs(_TOKEN[buf], CANDIDATE)
    if not runs:
        return []
    strings = [data[a:b].decode() for a, b in runs]
    return [(a, b, s) for (a, b), s in zip(_points(data, runs), strings, strict=True) if _KINDS.search(s)]


def parts(start: int, text: str) -> list[tuple[int, int, str]]:
    """What a candidate has between "=" and "/"."""
    found = [(start + m.start(), start + m.end(), m[0]) for m in _PART.finditer(text)]
    return [x for x in found if len(x[2]) >= CANDIDATE and len(x[2]) < len(text) and _KINDS.search(x[2])]


def likely(data: bytes, spans: list[tuple[int, int, str]], m: Model) -> list[tuple[int, int, float]]:
    """(start, end, score) of candidates that pass and overlap no base span; spans are sorted by start."""
    out, taken, k = [], [], 0
    for a, b, _ in spans:  # merged, so that one pass over both lists will do
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    for a, b, s in candidates(data):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if k < len(taken) and taken[k][0] < b:
            # a run that meets a base span may still have a part beside it
            inside, j = [], k
            while j < len(taken) and taken[j][0] < b:
                inside.append(taken[j])
                j += 1
            options, at = [], 0
            for x, y, part in parts(a, s):
                while at < len(inside) and inside[at][1] <= x:
                    at += 1
                if at == len(inside) or inside[at][0] >= y:
                    options.append((x, y, part))
        else:
            score, _ = m.score(s)
            if score > m.threshold:
                out.append((a, b, score))
                continue
            options = parts(a, s)
        for x, y, part in options:
            score, _ = m.score(part)
            if score > m.threshold:
                out.append((x, y, score))
    return out


def _finder(m: Model):
    return lambda batches: _find(batches, m)


def _find(batches: Iterator[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    for batch in batches:
        for first, texts in slices(batch.column(1)):
            base, more = [], []
            for data in texts:
                spans = base_spans(data)
                found = [{"kind": "likely", "start": a, "end": b, "score": score} for a, b, score in likely(data, spans, m)]
                text = data.decode() if spans else ""
                base.append([{"kind": k, "start": a, "end": b, "score": m.score(text[a:b])[0]} for a, b, k in spans])
                more.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(base, kind), pa.array(more, kind)], names=["doc_id", "base", "added"])


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end, score) by start, then kind as listed."""
    span = "array<struct<kind string, start long, end long, score double>>"
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_finder(model()), f"doc_id long, base {span}, added {span}")
