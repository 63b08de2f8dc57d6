"""Line deduplication by a log-template tree. DataFrame functions only.

Every line goes down a tree of fixed depth: its number of tokens (what white space separates), then its leading tokens. Tokens with a digit are variable fields
and count as one wildcard everywhere; a line of fewer than ``general`` tokens is only compared as it is. At a leaf where different lines meet, each line's tokens are ranked by the number of the leaf's
different lines that have them at the same position. The least rank that ``constant`` of the positions reach tells constants from
variable fields; lines with equal constants share a template, so that a leaf has as many templates as it needs, and lines of others do
not matter. One constant at least must lie beyond the leading tokens; any other line is its own template, wildcards included. A template that recurs in
``documents`` documents or more is dropped from all but its first place (the smallest id, then the smallest position), so that
nothing vanishes from the corpus altogether.

With ``copies`` every document counts, copies too: a template recurs if ``documents`` different rows (by id and text) have it, an exact
count without sketches.

Without ``copies``, as near copies of one document would make all its lines recur, a template recurs if ``documents`` of its documents, each pair of
them, are no near copies of one another, however many copies each of them has. Documents whose sizes lie two powers of two apart or
more are none, which settles most templates. For the others, documents are compared by sketches, the least hashes of their pairs of
neighbouring words: they are near copies if, by the sketches, less than ``distinct`` of their pairs differ. One document of the template
is chosen, then one that is no near copy of it, and so on; what is chosen ``documents`` times recurs. A line that is more than half of
its document would make documents alike by itself: for such a line the document counts by what else is in it.

Lines are parsed once and written, with the documents' sketches; what follows reads hashes, and texts of lines only for leaves that
already recur. Counts are exact and pre-aggregated; a template's documents are dealt over several tasks.

Defined results: a null text stays null, an empty one empty, with no line dropped; empty lines are never
dropped; rows with equal id and text count once and keep the same lines, rows with one id and different texts are different documents;
a null id comes last; an empty table gives an empty result; all of the input's columns are
kept, whatever their names, except that an equally named output column replaces an input column.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .once import once
from .scratch import Scratch
from .skew import salted_join, salted_semi, weighted_join

WILDCARD = "<*>"
#: White space but the line feed; more than one of a kind, or any other than the space, becomes one space.
WIDE = r"[\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
BLANKS = rf"[\x20\t\x0B-\r{WIDE[1:-1]}]{{2,}}|[\t\x0B-\r{WIDE[1:-1]}]"
#: Texts with no such character but the space, and no digit. Characters below 256 are listed one by one: Java then looks them up in a table.
_BELOW = "".join(rf"\x{c:02X}" for c in range(256) if not (0x09 <= c <= 0x0D or 0x30 <= c <= 0x39 or c in (0x85, 0xA0)) or c == 0x0A)
PLAIN = rf"\A(?:[{_BELOW}]++|[\u0100-\u167F\u1681-\u1FFF\u200B-\u2027\u202A-\u202E\u2030-\u205E\u2060-\u2FFF\u3001-\x{{10FFFF}}]++)*+\z"
#: Values of a sketch.
SKETCH = 24
#: Pairs after a punctuation mark come first in a sketch: where they fill it, no other pair is hashed.
ANCHOR = r"[.,;:!?][\x20\n][^\x20\n]++[\x20\n][^\x20\n]++"


@dataclass(frozen=True)
class Templates:
    """depth: leading tokens of the tree; least: tokens of a line that may be dropped;
    general: tokens of a line with variable fields; documents: different documents in which a
    template recurs; distinct: share of word pairs in which near copies differ at most; constant: share of constant positions in a template;
    copies: near copies are documents of their own."""

    depth: int = 3
    least: int = 1
    general: int = 4
    documents: int = 3
    distinct: float = 0.4
    constant: float = 0.7
    copies: bool = False


def n_tokens(line: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "))) + 1


def spaced(df: DataFrame) -> DataFrame:
    """_text with single spaces for all white space but line feeds, and whether it may have _digits."""
    df = once(df, "_digits", F.contains("_text", F.lit("  ")) | ~F.col("_text").rlike(PLAIN))
    return once(df, "_text", F.when(F.col("_digits"), F.regexp_replace("_text", BLANKS, " ")).otherwise(F.col("_text")))


def _most(line: Column) -> Column:
    """Whether a line is more than half of its document; at most one is."""
    return 2 * F.octet_length(line) > F.octet_length("_text")


def _sketched(df: DataFrame, text: str, name: str) -> DataFrame:
    """With the sketch of a text, null for a null text."""
    sign, most = F.lit(-(2**63)), F.lit(2**63 - 1)  # negative hashes come first
    df = once(df, "_found", F.regexp_extract_all(text, F.lit(ANCHOR), F.lit(0)))
    df = once(df, "_bound", (8.0 * SKETCH / F.greatest(F.size("_found"), F.lit(1)) - 1) * 2.0**63)
    low = F.filter(F.transform("_found", lambda x: F.xxhash64(x).bitwiseOR(sign)), lambda h: h.cast("double") <= F.col("_bound"))  # only spares sorting: far more than a sketch holds
    df = once(df, "_low", F.sort_array(F.array_distinct(low)))
    df = once(df, "_words", F.when(F.size("_low") < SKETCH, F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")))
    pairs = F.transform("_words", lambda x, i: F.xxhash64(x, F.get("_words", i + 1)).bitwiseAND(most))
    every = F.when(F.col("_words").isNull(), F.col("_low")).otherwise(F.concat("_low", F.sort_array(F.array_distinct(pairs))))
    df = once(df, "_low", F.slice(every, 1, SKETCH))
    sketch = F.when(F.size("_low") > 0, F.col("_low")).when(F.col(text).isNotNull(), F.array(F.xxhash64(text)))
    return once(df, name, sketch).drop("_found", "_bound", "_low", "_words")


def parsed(df: DataFrame, p: Templates) -> DataFrame:
    """_id, _key, _at, _most, _size (of the document but for a line that is most of it, as a power of two), _leaf, _masked (a hash)
    and, of lines that may have variable fields, _line (masked) for every line that may be dropped (_open). A leaf is only what leads
    here; tokens are counted where it matters. Each document's first line also has its _sketch and, if a line is most of it, the _rest's;
    where copies are documents there are no sketches and no sizes."""
    docs = df.filter("_text is not null")
    if p.copies:
        return _leaves(docs.select("_id", "_key", "_digits", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw")).withColumn("_raw", F.trim("_raw")).filter(_may_go(p)), p)
    docs = docs.withColumn("_line", F.get(F.filter(F.transform(F.split("_text", "\n"), lambda x: F.trim(x)), _most), F.lit(0)))
    docs = docs.withColumn("_other", F.when(F.col("_line").isNotNull(), F.trim(F.replace("_text", F.col("_line"), F.lit(""))))).drop("_line")
    docs = _sketched(_sketched(docs, "_other", "_rest").drop("_other"), "_text", "_sketch")
    rows = docs.select("_id", "_key", "_text", "_digits", "_sketch", "_rest", F.posexplode(F.split("_text", "\n")).alias("_at", "_raw"))
    rows = rows.withColumn("_raw", F.trim("_raw")).withColumn("_most", _most(F.col("_raw")))
    rest = F.octet_length("_text") - F.when(F.col("_most"), F.octet_length("_raw")).otherwise(0)
    rows = rows.withColumn("_size", F.floor(F.log2(F.greatest(rest, F.lit(1)).cast("double"))).cast("int")).drop("_text")
    own = [F.when(F.col("_at") == 0, F.col(c)).alias(c) for c in ("_sketch", "_rest")]
    return _leaves(rows.withColumn("_open", _may_go(p)).filter("_open or _at = 0"), p, "_most", "_size", "_open", *own)


def _may_go(p: Templates) -> Column:
    return (F.col("_raw") != "") & (n_tokens("_raw") >= p.least if p.least > 1 else F.lit(True))


def _leaves(rows: DataFrame, p: Templates, *more: str | Column) -> DataFrame:
    rows = rows.withColumn("_many", F.substring_index("_raw", " ", p.general - 1) != F.col("_raw"))
    varies = F.col("_digits") & F.col("_many") & F.col("_raw").rlike("[0-9]")
    rows = once(rows, "_line", F.when(varies, F.regexp_replace("_raw", r"[^\x200-9]*+[0-9][^\x20]*+", WILDCARD)).otherwise(F.col("_raw")))
    leaf, line = F.xxhash64(F.substring_index("_line", " ", p.depth)), F.when(F.col("_many"), F.col("_line"))
    return rows.select("_id", "_key", "_at", *more, leaf.alias("_leaf"), F.xxhash64("_line").alias("_masked"), line.alias("_line"))


def _place() -> Column:
    return F.struct(F.col("_id").isNull().alias("_null"), "_id", "_at", "_key")


def _counted(rows: DataFrame, p: Templates) -> DataFrame:
    """_template, its _first place and _n documents, of templates that recur where copies are documents. A document's lines of one template
    are summed first; then the documents of a template, partial sums in each task."""
    met = rows.groupBy("_template", "_key").agg(F.min(_place()).alias("_first"))
    return met.groupBy("_template").agg(F.count("*").alias("_n"), F.min("_first").alias("_first")).filter(F.col("_n") >= p.documents)


def _recurring(rows: DataFrame, docs: DataFrame, p: Templates, scratch: Scratch) -> DataFrame:
    """_template, its _first place and _n documents, of templates that recur; rows has _template, _id, _key, _at, _most, _size, and docs the sketches."""
    met = rows.groupBy("_template", "_key").agg(F.min(_place()).alias("_first"), F.max("_most").alias("_most"), F.min("_size").alias("_size"))
    met = scratch.save(met)
    # sizes as bits; from the least one on, each that is two or more above the last one taken
    sums = met.groupBy("_template").agg(F.count("*").alias("_n"), F.min("_first").alias("_first"), F.bit_or(F.expr("shiftleft(1L, _size)")).alias("_sizes"))
    taken = F.expr("aggregate(sequence(0, 62), struct(0 AS n, -2 AS last), (acc, i) -> CASE WHEN i - acc.last >= 2 AND (shiftright(_sizes, i) & 1L) = 1L THEN struct(acc.n + 1 AS n, i AS last) ELSE acc END, acc -> acc.n)")
    sums = scratch.save(sums.filter(F.col("_n") >= p.documents).withColumn("_settled", taken >= p.documents))
    open_ = salted_semi(met, sums.filter("not _settled"), ["_template"], "_key").select("_template", "_key", "_most", "_size")
    open_ = open_.join(docs, "_key").withColumn("_sketch", F.when(F.col("_most"), F.col("_rest")).otherwise(F.col("_sketch"))).withColumn("_node", F.xxhash64("_sketch"))
    open_ = scratch.save(open_.groupBy("_template", "_node", "_size").agg(F.first("_sketch").alias("_sketch")))  # exact copies are one
    for _ in range(p.documents - 1):
        least = open_.groupBy("_template").agg(F.min("_node").alias("_node"))
        chosen = open_.join(least, ["_template", "_node"], "left_semi").groupBy("_template").agg(F.min_by("_sketch", "_size").alias("_there"), F.min("_size").alias("_there_size"))
        both = salted_join(open_, chosen, ["_template"], "_node", "inner")  # a template's different documents
        shared = F.size(F.array_intersect("_sketch", "_there"))
        alike = shared >= (1 - p.distinct) * (F.size("_sketch") + F.size("_there") - shared)
        near = (F.abs(F.col("_size") - F.col("_there_size")) < 2) & alike
        open_ = scratch.save(both.filter(~near).select("_template", "_node", "_size", "_sketch"))
    found = sums.filter("_settled").select("_template").unionByName(open_.select("_template").distinct())
    return sums.join(found, "_template", "left_semi").select("_template", "_first", "_n")


def templates(kinds: DataFrame, rows: DataFrame, p: Templates, scratch: Scratch) -> DataFrame:
    """_leaf, _masked and _general (a hash) of the lines that share a template with another line; kinds has _leaf, _masked and _n."""
    often = lambda of: of.groupBy("_leaf").agg(F.sum("_n").alias("_n"), F.count("*").alias("_kinds")).filter((F.col("_kinds") > 1) & (F.col("_n") >= p.documents))
    leading = scratch.save(often(kinds.filter("_general_too")))
    met = weighted_join(rows.filter("_line is not null").select("_leaf", "_masked", "_line"), leading.select("_leaf", "_n"), ["_leaf"], "_masked", "_n", rows.count())
    met = met.groupBy("_leaf", "_masked", "_line").agg(F.count("*").alias("_n")).withColumn("_n_tokens", n_tokens("_line"))
    lines = scratch.save(met.withColumn("_lead", F.col("_leaf")).withColumn("_leaf", F.xxhash64("_n_tokens", "_lead")))
    leaves = scratch.save(often(lines))
    met = weighted_join(lines.drop("_n"), leaves.select("_leaf", "_kinds"), ["_leaf"], "_masked", "_kinds", lines.count())
    tokens = met.select("_leaf", "_masked", F.posexplode(F.split("_line", " ")).alias("_place", "_token"))
    tokens = scratch.save(tokens.select("_leaf", "_masked", "_place", F.xxhash64("_token").alias("_word"), (F.col("_token") == WILDCARD).alias("_wild")))
    words = scratch.save(tokens.groupBy("_leaf", "_place", "_word").agg(F.count("*").alias("_lines")).filter("_lines > 1"))
    met = weighted_join(tokens, words, ["_leaf", "_place", "_word"], "_masked", "_lines", tokens.count())
    held = met.groupBy("_leaf", "_masked").agg(F.collect_list(F.struct("_lines", "_place", "_word", "_wild")).alias("_held"))  # within one line
    held = held.join(lines.select("_leaf", "_masked", "_lead", "_n_tokens"), ["_leaf", "_masked"])
    needed = F.greatest(F.ceil(p.constant * F.col("_n_tokens")), F.lit(p.depth + 1)).cast("int")
    held = once(held.filter(F.size("_held") >= needed), "_least", F.get(F.sort_array("_held", False), needed - 1)["_lines"])
    fixed = F.sort_array(F.transform(F.filter("_held", lambda t: t["_lines"] >= F.col("_least")), lambda t: F.struct(t["_place"], t["_word"], t["_wild"])))
    held = held.select("_leaf", "_lead", "_masked", fixed.alias("_fixed")).filter(F.exists("_fixed", lambda t: (t["_place"] >= p.depth) & ~t["_wild"]))
    out = scratch.save(held.select(F.col("_lead").alias("_leaf"), "_masked", F.xxhash64("_leaf", "_fixed", F.lit("general")).alias("_general")))
    scratch.drop(leading, lines, leaves, tokens, words)
    return out


def dropped_lines(df: DataFrame, p: Templates, scratch: Scratch) -> DataFrame:
    """_key and _at of the lines that go; df has _id, _key and _text."""
    every = scratch.save(parsed(spaced(df), p))
    rows = every if p.copies else every.filter("_open").drop("_open", "_sketch", "_rest")
    kinds = rows.groupBy("_leaf", "_masked").agg(F.count("*").alias("_n"), F.count("_line").alias("_lines"))
    kinds = scratch.save(kinds.withColumn("_general_too", F.col("_lines") > 0).drop("_lines"))
    general = templates(kinds, rows, p, scratch)
    named = kinds.join(general, ["_leaf", "_masked"], "left").withColumn("_template", F.coalesce("_general", "_masked")).select("_leaf", "_masked", "_n", "_template")
    often = named.groupBy("_template").agg(F.sum("_n").alias("_all")).filter(F.col("_all") >= p.documents).select("_template")
    named = scratch.save(named.join(often, "_template"))
    docs = None if p.copies else scratch.save(every.filter("_at = 0").select("_key", "_sketch", "_rest"))
    rows = weighted_join(rows.drop("_line"), named, ["_leaf", "_masked"], "_key", "_n", rows.count())
    rows = scratch.save(rows.drop("_leaf", "_masked", "_n"))
    scratch.drop(every, kinds, general, named)
    found = scratch.save(_counted(rows, p) if docs is None else _recurring(rows, docs, p, scratch))
    met = weighted_join(rows, found, ["_template"], "_key", "_n", rows.count())
    return met.filter((F.col("_key") != F.col("_first._key")) | (F.col("_at") != F.col("_first._at"))).select("_key", "_at")


def _document(id_: Column, text: Column) -> Column:
    """Two hashes of id and text."""
    return F.struct(F.xxhash64(id_.isNull(), id_, text).alias("a"), F.xxhash64(F.lit("b"), text, id_).alias("b"))


def line_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Templates = Templates()) -> DataFrame:
    """``df`` with its text without dropped lines, and n_lines and n_dropped for each row."""
    scratch = Scratch(df.sparkSession, "lines")
    key = _document(F.col(id_col), F.col(text_col))
    narrow = df.select(F.col(id_col).alias("_id"), key.alias("_key"), F.col(text_col).alias("_text"))
    gone = dropped_lines(narrow, params, scratch).groupBy(F.col("_key").alias("__line_key")).agg(F.sort_array(F.collect_set("_at")).alias("__line_at"))  # within one document
    # one byte for each line up to the last one that goes: 1 for those, 0 for others
    flags = F.array_join(F.expr("transform(__line_at, (x, i) -> repeat('0', x - coalesce(get(__line_at, i - 1), -1) - 1) || '1')"), "").cast("binary")
    gone = scratch.save(gone.select("__line_key", F.size("__line_at").alias("__line_n"), flags.alias("__line_gone")))
    met = df.withColumn("__line_key", key).join(gone.hint("merge"), "__line_key", "left")  # the list grows with the input: no broadcast
    kept = F.expr(f"array_join(filter(split(`{text_col}`, '\\n'), (x, i) -> substring(__line_gone, i + 1, 1) <> X'31'), '\\n')")
    text = F.when(F.col("__line_gone").isNull(), F.col(text_col)).otherwise(kept)
    n_lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.size(F.split(text_col, "\n")))
    out = met.withColumns({"n_lines": n_lines.cast("long"), "n_dropped": F.coalesce("__line_n", F.lit(0)).cast("long"), text_col: text})
    names = [c for c in df.columns if c not in ("n_lines", "n_dropped")]
    return out.select(*[F.col(f"`{c}`") for c in names], "n_lines", "n_dropped")
