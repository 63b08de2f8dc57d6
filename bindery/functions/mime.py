"""Media types: their parts, families, equality and inference from file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

XHTML, HTML, CSS, NCX, PACKAGE = "application/xhtml+xml", "text/html", "text/css", "application/x-dtbncx+xml", "application/oebps-package+xml"
SCRIPTS = ("application/javascript", "application/ecmascript", "text/javascript")
DEFAULT = "application/octet-stream"
# Media type by file extension.
BY_EXTENSION = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "svg": "image/svg+xml",
    "gif": "image/gif",
    "webp": "image/webp",
    "xhtml": "application/xhtml+xml",
    "html": "text/html",
    "htm": "text/html",
    "css": "text/css",
    "js": "text/javascript",
    "smil": "application/smil+xml",
    "ncx": "application/x-dtbncx+xml",
    "xml": "application/xml",
    "ttf": "font/ttf",
    "otf": "font/otf",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "mp3": "audio/mpeg",
    "m4a": "audio/mp4",
    "aac": "audio/aac",
    "mp4": "video/mp4",
    "m4v": "video/mp4",
    "webm": "video/webm",
}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(x: Column) -> Column:
    """A-Z lower-cased and nothing else."""
    return F.translate(x, _UPPER, _LOWER)


def main_type(x: Column) -> Column:
    return F.regexp_extract(x, "(?s)^[^/]*", 0)


def subtype(x: Column) -> Column:
    """The second piece between / + and ;"""
    return F.coalesce(F.get(F.split(x, "[/+;]"), F.lit(1)), F.lit(""))


def suffix(x: Column) -> Column:
    base = F.regexp_extract(x, "(?s)^[^;]*", 0)
    return F.when(F.contains(base, F.lit("+")), F.trim(F.substring_index(base, "+", -1)))


def parameters(x: Column) -> Column:
    return F.when(F.contains(x, F.lit(";")), F.trim(F.regexp_extract(x, "(?s)^[^;]*;(.*)$", 1)))


def parameter_list(x: Column) -> Column:
    """array<struct<name, value>>; pieces without = are dropped."""
    pieces = F.filter(F.split(F.coalesce(parameters(x), F.lit("")), ";"), lambda p: F.contains(p, F.lit("=")))
    return F.transform(pieces, lambda p: F.struct(F.trim(F.regexp_extract(p, "(?s)^[^=]*", 0)).alias("name"), F.trim(F.regexp_extract(p, "(?s)^[^=]*=(.*)$", 1)).alias("value")))


def parameter(x: Column, key: str) -> Column:
    return F.get(F.filter(parameter_list(x), lambda p: p["name"] == key), F.lit(0))["value"]


def is_unspecified(x: Column) -> Column:
    return (main_type(x) == "") | (subtype(x) == "")


def is_family(x: Column, family: str) -> Column:
    return folded(main_type(x)) == family


def is_font(x: Column) -> Column:
    sub = folded(subtype(x))
    return is_family(x, "font") | F.startswith(sub, F.lit("font-")) | F.startswith(sub, F.lit("x-font")) | sub.isin("vnd.ms-fontobject", "vnd.ms-opentype")


def canonical(x: Column) -> Column:
    """Equal for equal media types: type and parameter names without case, parameters as a set."""
    base = folded(F.trim(F.regexp_extract(x, "(?s)^[^;]*", 0)))
    listed = F.array_sort(F.transform(parameter_list(x), lambda p: F.concat(folded(p["name"]), F.lit("="), p["value"])))
    return F.when(F.contains(x, F.lit(";")), F.concat(base, F.lit(";"), F.array_join(listed, ";"))).otherwise(base)


def matches(x: Column, target: str) -> Column:
    """A target without a subtype matches the main type; any other has to be equal, parameters included."""
    return folded(x) == target.lower() if "/" in target and target.split("/", 1)[1] else folded(main_type(x)) == target.split("/")[0].lower()


def infer(extension: Column) -> Column:
    table = F.create_map(*[F.lit(v) for pair in BY_EXTENSION.items() for v in pair])
    return F.coalesce(F.try_element_at(table, extension), F.lit(DEFAULT))
