"""References within a book: parts, percent-encoding, normalisation and resolution, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def path(x: Column) -> Column:
    """Before the first ? or #."""
    return F.regexp_extract(x, "^[^#?]*", 0)


def name(x: Column) -> Column:
    """The last segment of the path."""
    return F.element_at(F.split(path(x), "/"), -1)


def extension(x: Column) -> Column:
    """After the last dot of the name; null without a dot."""
    return F.when(F.contains(name(x), F.lit(".")), F.substring_index(name(x), ".", -1))


def parent_text(x: Column) -> Column:
    """Up to the last slash, wherever it stands: "" without one, "/" where it is the first character."""
    return F.when(~F.contains(x, F.lit("/")), F.lit("")).otherwise(F.coalesce(F.nullif(F.regexp_extract(x, "(?s)^(.*)/[^/]*$", 1), F.lit("")), F.lit("/")))


def parent(x: Column) -> Column:
    """``parent_text``, null where there is none."""
    up = parent_text(x)
    return F.when((up != "") & (up != x), up)


def fragment(x: Column) -> Column:
    """After the first #; null without one."""
    return F.when(F.contains(x, F.lit("#")), F.regexp_extract(x, "(?s)^[^#]*#(.*)$", 1))


def query(x: Column) -> Column:
    """After the first ?, up to a # after it; null without one."""
    return F.when(F.contains(x, F.lit("?")), F.regexp_extract(x, r"(?s)^[^?]*\?([^#]*)", 1))


def has_scheme(x: Column) -> Column:
    return x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:")


def decode(x: Column) -> Column:
    """Percent-decoding; a plus stays a plus, and what is no escape stays as it is."""
    return F.url_decode(F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B")))


def encode(x: Column) -> Column:
    """Percent-encoding of all but letters, digits and what separates or already escapes; never escapes twice."""
    out = F.url_encode(x)  # it leaves letters, digits and -_.* and makes a space a plus
    for made, kept in (("+", "%20"), ("*", "%2A"), ("%2F", "/"), ("%3A", ":"), ("%23", "#"), ("%3F", "?"), ("%7E", "~"), ("%3D", "="), ("%26", "&"), ("%25", "%")):
        out = F.replace(out, F.lit(made), F.lit(kept))
    return F.when(x.rlike(r"^[A-Za-z0-9%./:#?_~=&-]*\z"), x).otherwise(out)


def segments(x: Column) -> Column:
    """Segments with empty ones and dots dropped and parents taken back, never above the root."""
    empty = F.array().cast("array<string>")

    def step(acc: Column, c: Column) -> Column:
        shorter = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        return F.when(c.isin("", "."), acc).when(c == "..", shorter).otherwise(F.concat(acc, F.array(c)))

    return F.aggregate(F.split(x, "/"), empty, step)


def normalize(x: Column) -> Column:
    """A path without segments that are empty or dots stays as it is."""
    walked = F.concat(F.when(F.startswith(x, F.lit("/")), "/").otherwise(""), F.array_join(segments(x), "/"))
    return F.when(x.rlike(r"//|(^|/)\.{1,2}(/|$)|/$|^$"), walked).otherwise(x)


def resolve(base: Column, x: Column) -> Column:
    """Against the directory ``base``; absolute paths and references with a scheme stay. The ? or # part is normalised too."""
    return F.when(F.startswith(x, F.lit("/")) | has_scheme(x), x).otherwise(normalize(F.concat(base, F.lit("/"), x)))


def relativize(base: Column, x: Column) -> Column:
    """From the absolute directory ``base`` to the absolute path ``x``."""
    plain = lambda c: F.filter(F.split(c, "/"), lambda s: ~s.isin("", "."))
    a, b = plain(base), plain(x)
    shared = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), F.lit(0), lambda acc, i: F.when((acc == i - 1) & (F.get(a, i - 1) == F.get(b, i - 1)), i).otherwise(acc))
    climbs = F.array_repeat(F.lit(".."), F.size(a) - shared)
    walked = F.array_join(F.concat(climbs, F.slice(b, shared + 1, F.size(b) - shared + F.lit(0))), "/")
    below = F.startswith(x, F.concat(base, F.lit("/")))
    return F.when(x == base, ".").when(below, F.substr(x, F.char_length(base) + 2)).otherwise(walked)


def join(a: Column, b: Column) -> Column:
    """Exactly one slash between."""
    return F.concat(F.regexp_replace(a, "/+$", ""), F.lit("/"), F.regexp_replace(b, "^/+", ""))


def absolute(x: Column) -> Column:
    return F.when(F.startswith(x, F.lit("/")), x).otherwise(F.concat(F.lit("/"), x))


def lookup_key(directory: Column, x: Column) -> Column:
    """The key under which a container holds a resource: without ? and #, decoded, normalised or resolved."""
    plain = decode(path(x))
    return F.when(F.startswith(plain, F.lit("/")), normalize(plain)).otherwise(resolve(directory, plain))


def prefix(qualified: Column) -> Column:
    return F.when(F.contains(qualified, F.lit(":")), F.regexp_extract(qualified, "(?s)^([^:]*):", 1))


def local(qualified: Column) -> Column:
    return F.regexp_replace(qualified, "(?s)^[^:]*:", "")
