"""Personal data: candidate spans, boosted trees over format and context, calibrated thresholds. DataFrame functions only.

Base formats (e-mail, IPv4, card and phone numbers) are always spans. High-recall generators propose more: numbers in looser
formats, each as a card and as a phone number, addresses with spelt-out signs, IPv4 addresses with spelt-out or bracketed dots and
IPv6 addresses; spans may overlap. Boosted trees score each
proposal from its format (digits, groups, separators, Luhn's test) and the words before it; a span is added where its score
exceeds the kind's threshold, calibrated on held-out examples, and no base span of its kind overlaps it. The trees are trained
on the driver when a process first needs them, on labelled examples from a seeded generator of ``EXAMPLES`` rows for each kind, so that
every process has the same ones, and run as SQL expressions.

Positions come from splitting the text at the pattern: lengths of what is between and of what is found add up, in blocks of the square
root of their number, as an array that grows by one element at a time would be copied each time. Overlaps are looked up in a string
with a mark for each code point of a base span. Patterns are possessive and begin where a run begins, so that they take linear time
and no deep recursion on very long texts.

Defined results: a null text counts as empty and has no spans; null ids stay null; repeated rows get equal results; an empty table
gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import once
from .trees import Boosted

KINDS = ("email", "ip", "card", "phone")
#: Same matches as the contract's patterns: a match begins at a run's first character or at the end of the match before it.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Generators of proposals.
LOOSE_NUMBER = r"(?<![0-9A-Za-z.+(])[(+]?[0-9](?:[\x20()./-]{0,2}[0-9]){6,}+(?![0-9A-Za-z])"
LOOSE_ADDRESS = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)++"
_SPELT_DOT = r"(?:\[\.\]|\(\.\)|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20|\x20\.\x20)"
LOOSE_IP = rf"(?<![0-9A-Za-z.:\]])(?:[0-9]{{1,3}}(?:{_SPELT_DOT}[0-9]{{1,3}}){{3}}+(?![0-9A-Za-z])|[0-9A-Fa-f]{{1,4}}+(?::[0-9A-Fa-f]{{1,4}}+){{2,7}}+(?:::[0-9A-Fa-f]{{1,4}}+(?::[0-9A-Fa-f]{{1,4}}+){{0,4}}+)?+(?![0-9A-Za-z:]))"
#: Words before a span that speak for a kind.
CONTEXT = {
    "phone_word": r"(?i)\b(?:tel|phone|call|fax|mobile|cell|whatsapp|t\x{e9}l|telefon|handy|tel\x{e9}fono|appelez|ruf|llame)\b",
    "card_word": r"(?i)\b(?:card|visa|mastercard|credit|debit|amex|karte|carte|tarjeta|payment)\b",
    "mail_word": r"(?i)\b(?:mail|email|e-mail|contact|write|correo|kontakt)\b",
    "host_word": r"(?i)\b(?:ip|ipv4|ipv6|host|server|from|address|client|addr|peer|login|adresse)\b",
    "number_word": r"(?i)\b(?:order|invoice|isbn|version|serial|no|ref|id|item|page|section|rfc|date|year)\b",
}
#: Characters before a span that are searched for such words.
BEFORE = 24
EXAMPLES = 1200
PRECISION = 0.995
_FORMAT = {
    "digits": "[0-9]",
    "spaces": r"\x20",
    "dots": r"\.",
    "dashes": "-",
    "slashes": "/",
    "brackets": r"[()\[\]]",
    "plus": r"\+",
    "signs": "@",
    "spelt": r"\[at\]|\(at\)|\[dot\]|\(dot\)|\[\.\]|\(\.\)|\x20dot\x20",
    "colons": ":",
    "hex_letters": "[A-Fa-f]",
    "octets": r"(?<![0-9])(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?![0-9])",
    "pairs": r"(?<![0-9A-Za-z])[0-9]{2}(?![0-9A-Za-z])",
    "long_groups": "[0-9]{4,}",
    "fours": r"(?<![0-9])[0-9]{4}(?![0-9])",
    "threes": r"(?<![0-9])[0-9]{3}(?![0-9])",
    "ones": r"(?<![0-9])[0-9](?![0-9])",
}


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return bool(digits) and total % 10 == 0


def features(found: str, before: str) -> dict[str, float]:
    """What ``_features_sql`` computes, for training."""
    out = {k: float(len(re.findall(v, found))) for k, v in _FORMAT.items()}
    out["luhn"] = float(_luhn(re.sub("[^0-9]", "", found)))
    out["label_size"] = float(len(re.split(r"\.|\]|\)", found)[-1].strip()))
    return out | {k: float(bool(re.search(v.replace(r"\x{e9}", "é"), before))) for k, v in CONTEXT.items()}


def _features_sql() -> str:
    quoted = lambda x: "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    parts = [f"'{k}', cast(regexp_count(m, {quoted(v)}) as double)" for k, v in _FORMAT.items()]
    parts.append("'luhn', cast(coalesce(luhn_check(regexp_replace(m, '[^0-9]', '')), false) as double)")
    parts.append(r"'label_size', cast(length(trim(element_at(split(m, '\\.|\\]|\\)'), -1))) as double)")
    parts += [f"'{k}', cast(before rlike {quoted(v)} as double)" for k, v in CONTEXT.items()]
    return f"named_struct({', '.join(parts)})"


def _examples(kind: str, seed: int) -> tuple[list[dict[str, float]], list[int]]:
    """Labelled spans with the words before them, from a generator whose labels are true by construction."""
    r = random.Random(f"{kind}{seed}")
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda: "".join(r.choice("abcdefghilmnoprstu") for _ in range(r.randint(2, 8)))

    def luhn(size: int, good: bool) -> str:
        while _luhn(x := r.choice("3456") + n(size - 1)) != good:
            pass
        return x

    def fours(x: str, sep: str) -> str:
        return sep.join(x[i : i + 4] for i in range(0, len(x), 4))

    about = {"phone": ("tel", "phone:", "call", "fax", "mobile"), "card": ("card", "visa", "credit card", "payment"), "email": ("mail", "contact", "write to", "email:"), "ip": ("ip", "host", "server", "from", "address")}[kind]
    other = ("order", "invoice", "isbn", "version", "no", "ref", "id", "page", "date")
    octet, group = (lambda: str(r.randint(0, 255))), (lambda: f"{r.randint(0, 65535):x}")
    spelt = lambda: r.choice(["[.]", "(.)", " [dot] ", "[dot]", "(dot)", " dot "])
    dotted = lambda x, dot: x() + "".join(dot + x() for _ in range(3))
    good = {
        "ip": lambda: r.choice([dotted(octet, spelt()), dotted(octet, spelt()), ":".join(group() for _ in range(8)), ":".join(group() for _ in range(3)) + "::" + group()]),
        "phone": lambda: r.choice([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"00{n(2)} {n(3)} {n(7)}", f"0{n(2)} {n(2)} {n(2)} {n(2)} {n(2)}"]),
        "card": lambda: fours(luhn(16, True), r.choice([".", " - ", "/", ". "])),
        "email": lambda: f"{word()}{r.choice(['.', '_', ''])}{word()}{r.choice([' [at] ', '(at)', ' @ ', '[at]'])}{word()}{r.choice([' [dot] ', '(dot)', '[dot]', '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr', 'example'])}",
    }[kind]
    bad = {
        "ip": lambda: r.choice([dotted(lambda: n(r.randint(1, 3)), " . "), dotted(lambda: str(r.randint(256, 999)), spelt()), f"{n(2)}:{n(2)}:{n(2)}", f"{r.randint(1, 23)}:{n(2)}:{n(2)}:{n(2)}", ":".join(str(r.randint(1, 9)) for _ in range(r.randint(3, 5))), ":".join(r.choice("abcdef") + r.choice("abcdef") for _ in range(r.randint(3, 6)))]),
        "phone": lambda: r.choice([f"{r.randint(1900, 2030)}-{n(2)}-{n(2)}", f"{r.randint(1, 9)}.{n(8)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}", n(r.randint(7, 16)), f"{n(3)} {n(1)} {n(2)} {n(1)} {n(3)} {n(2)}", f"{n(4)}/{n(4)}", fours(n(16), ".")]),
        "card": lambda: r.choice([fours(luhn(16, False), r.choice([".", "/", " - "])), n(16), f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}.{n(3)}.{n(4)}", f"{r.randint(1900, 2030)}-{n(2)}-{n(2)}", n(r.randint(7, 12)), f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}"]),
        "email": lambda: r.choice([f"{word()} @ {word()}. {word()}", f"{word()} @ {n(1)}.{n(2)}", f"{word()} @{word()}. {word()}{word()}"]),
    }[kind]
    rows, labels = [], []
    for _ in range(EXAMPLES):
        y = int(r.random() < 0.5)
        # a right format without a telling word is personal data only where the format alone tells
        told = r.random() < 0.6
        before = f"{word()} {r.choice(about) if y and (told or kind not in ('email', 'ip')) or not y and r.random() < 0.1 else r.choice(other) if not y and r.random() < 0.4 else word()} "
        rows.append(features((good if y else bad)(), before[-BEFORE:]))
        labels.append(y)
    return rows, labels


@cache
def models() -> dict[str, tuple[Boosted, float]]:
    out = {}
    for kind in KINDS:
        model = Boosted.fit(*_examples(kind, 1))
        out[kind] = model, model.threshold(*_examples(kind, 2), PRECISION)
    return out


_SPAN = "struct<kind string, start int, end int, m string>"


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m"))


def _located(text: Column, pattern: str, kinds: tuple[str, ...]) -> Column:
    """array<struct<kind, start, end, m>> of the matches, once for each kind."""
    none = F.array().cast(f"array<{_SPAN}>")

    def spans(found: Column) -> Column:
        sizes = F.transform(F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m")), lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["m"]), F.lit(0)))  # the last gap has no match
        every = F.transform(F.arrays_zip(found.alias("m"), _running(sizes).alias("end")), lambda x: F.struct((x["end"] - F.char_length(x["m"])).alias("start"), x["end"].alias("end"), x["m"].alias("m")))
        return _let(F.filter(every, lambda x: x["m"].isNotNull()), lambda x: F.concat(*[F.transform(x, _named(k)) for k in kinds]))

    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: F.when(F.size(found) > 0, spans(found)).otherwise(none))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(numbers: Column, start: int = 0, join: str = "+") -> Column:
    """Running sums (or, with "greatest", maxima) of an array of ints: within blocks, then of the blocks' last ones."""
    step = (lambda a, x: a + x) if join == "+" else F.greatest
    none = F.array(F.lit(start))
    fold = lambda xs: F.aggregate(xs, none, lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))

    def cut(values: Column) -> Column:
        side = F.greatest(F.ceil(F.sqrt(F.size(values).cast("double"))).cast("int"), F.lit(1))
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size(values) - 1, F.lit(0)), side), lambda at: fold(F.slice(values, at + 1, side)))

    def joined(blocks: Column) -> Column:
        before = fold(F.transform(blocks, lambda b: F.element_at(b, -1)))  # one more than blocks
        return _let(before, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(b, 2, F.size(b)), lambda x: step(F.get(base, i), x)))))

    return _let(_let(numbers, cut), joined)


def _gated(gate: Column, spans: Column) -> Column:
    return F.when(gate, spans).otherwise(F.array().cast(f"array<{_SPAN}>"))


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _marks(kind: str) -> Column:
    """A byte for each code point up to the last base span of a kind: 1 in a span, 0 outside."""
    of = f"filter(base, s -> s.kind = '{kind}')"
    marks = f"transform(array({of}), a -> array_join(transform(a, (s, i) -> repeat('0', s.start - coalesce(get(a, i - 1).end, 0)) || repeat('1', s.end - s.start)), ''))[0]"
    return F.expr(f"cast({marks} as binary)")


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, base and added: arrays of (kind, start, end, m) in the order of kinds, then of start."""
    docs = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    text = F.col("text")
    digit, at = F.col("text").rlike("[0-9]"), F.contains("text", F.lit("@"))
    docs = docs.withColumns({"_digit": digit, "_at": at})
    digit, at = F.col("_digit"), F.col("_at")
    good = {
        "email": lambda s: F.lit(True),
        "ip": lambda s: s["m"].rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"),
        "card": lambda s: F.char_length(_digits(s["m"])).between(16, 19) & F.call_function("luhn_check", _digits(s["m"])),
        "phone": lambda s: F.char_length(_digits(s["m"])).between(8, 15),
    }
    gate = {"email": at, "ip": digit, "card": digit, "phone": digit & F.contains("text", F.lit("+"))}
    base = [F.filter(_gated(gate[k], _located(text, BASE[k], (k,))), good[k]) for k in KINDS]
    numbers, addresses = _gated(digit, _located(text, LOOSE_NUMBER, ("card", "phone"))), _gated(at | F.contains("text", F.lit("at]")) | F.contains("text", F.lit("at)")), _located(text, LOOSE_ADDRESS, ("email",)))
    hosts = _gated(digit & (F.contains("text", F.lit(":")) | F.contains("text", F.lit("."))) | F.contains("text", F.lit("dot")), _located(text, LOOSE_IP, ("ip",)))
    docs = once(once(docs, "base", F.concat(*base)), "_more", F.concat(numbers, addresses, hosts))
    docs = once(docs, "_marks", F.when((F.size("_more") > 0) & (F.size("base") > 0), F.create_map(*[x for k in KINDS for x in (F.lit(k), _marks(k))])))
    free = F.filter("_more", lambda c: ~F.coalesce(F.contains(F.substring(F.col("_marks")[c["kind"]], c["start"] + 1, c["end"] - c["start"]), F.lit(b"1")), F.lit(False)))
    docs = once(docs, "_more", F.when(F.size("_more") > 0, free).otherwise(F.col("_more"))).drop("_marks")
    # code points of four bytes each, so that what is before a span is found at once
    docs = once(docs, "_wide", F.when(F.size("_more") > 0, F.encode("text", "UTF-32")))
    described = F.expr(
        f"transform(transform(_more, c -> struct(c, c.m as m, decode(substring(_wide, 4 * greatest(c.start - {BEFORE}, 0) + 1, 4 * least(c.start, {BEFORE})), 'UTF-32') as before)),"
        f" x -> struct(x.c as span, transform(array(x), y -> {_features_sql().replace('(m,', '(y.m,').replace('before rlike', 'y.before rlike')})[0] as f))"
    )
    score = " ".join(f"WHEN x.span.kind = '{k}' THEN ({m.sql('x.f.')}) > {t!r}D" for k, (m, t) in models().items())
    docs = once(docs, "_more", F.when(F.size("_more") > 0, described))
    added = F.expr(f"transform(filter(_more, x -> CASE {score} ELSE false END), x -> x.span)")
    return docs.withColumn("added", F.when(F.size("_more") > 0, added).otherwise(F.array().cast(f"array<{_SPAN}>"))).select("doc_id", "text", "base", "added")


def ordered(spans: Column) -> Column:
    """By kind as listed, then start, then end."""
    keyed = F.transform(spans, lambda s: F.struct(F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))
    return F.transform(F.array_sort(keyed), lambda s: F.struct(F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["k"].cast("int")).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["m"].alias("m")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(df: DataFrame) -> DataFrame:
    """Adds ``redacted`` to ``find``'s rows: every span, overlapping ones merged, becomes [kind of the first]."""
    spans = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    out = once(once(df, "__spans", spans), "__wide", F.when(F.size("__spans") > 0, F.encode("text", "UTF-32")))
    out = once(out, "__upto", _running(F.transform("__spans", lambda s: s["end"]), join="greatest"))  # the end of what is hidden, span by span
    cut = lambda a, b: f"decode(substring(__wide, 4 * ({a}) + 1, 4 * ({b} - ({a}))), 'UTF-32')"
    before = "coalesce(get(__upto, i - 1), 0)"
    pieces = F.expr(f"transform(__spans, (s, i) -> CASE WHEN i = 0 OR s.start >= {before} THEN {cut(before, 's.start')} || '[' || s.kind || ']' ELSE '' END)")
    tail = F.expr(cut("get(__upto, size(__upto) - 1)", "length(text)"))
    done = F.when(F.size("__spans") > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(F.col("text"))
    return out.withColumn("redacted", done).drop("__spans", "__wide", "__upto")
