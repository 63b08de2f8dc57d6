"""Queries of the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import civil, href, mime, text
from . import adapters
from .registry import query


def _on_hrefs(name: str, f: Callable[[Column], Column], sql: str) -> None:
    query(f"SELECT page_id, {sql} AS value FROM (SELECT page_id, url AS x FROM pages)", name)(lambda s, d: adapters.hrefs(s, d).select("page_id", f(F.col("href")).alias("value")))


_PATH = "regexp_extract(x, '^[^#?]*')"
_NAME = f"regexp_extract({_PATH}, '[^/]*$')"
_PARENT = "CASE WHEN instr(x, '/') = 0 THEN '' WHEN regexp_extract(x, '(?s)^(.*)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(x, '(?s)^(.*)/[^/]*$', 1) END"
_on_hrefs("href_path", href.path, _PATH)
_on_hrefs("href_name", href.name, _NAME)
_on_hrefs("href_extension", href.extension, f"CASE WHEN instr({_NAME}, '.') > 0 THEN regexp_extract({_NAME}, '[^.]*$') END")
_on_hrefs("href_parent", href.parent_text, _PARENT)
_on_hrefs("href_fragment", href.fragment, "CASE WHEN instr(x, '#') > 0 THEN substr(x, instr(x, '#') + 1) END")
_on_hrefs("href_query", href.query, "CASE WHEN instr(x, '?') > 0 THEN split_part(substr(x, instr(x, '?') + 1), '#', 1) END")
_on_hrefs("href_has_scheme", lambda x: href.has_scheme(x).cast("int"), "CAST(regexp_matches(x, '^[A-Za-z][A-Za-z0-9+.-]*:') AS INTEGER)")
_on_hrefs("href_decode", lambda x: href.decode(F.concat(x, F.lit("%20a%C3%A9+b"))), "url_decode(x || '%20a%C3%A9+b')")
_on_hrefs("href_encode", lambda x: href.encode(F.concat(x, F.lit(" (é)%20"))), "x || '%20%28%C3%A9%29%20'")
_on_hrefs("href_absolute", href.absolute, "CASE WHEN starts_with(x, '/') THEN x ELSE '/' || x END")
_on_hrefs("href_join", lambda x: href.join(F.concat(x, F.lit("//")), F.lit("/a.css")), "regexp_replace(x, '/+$', '') || '/a.css'")
_on_hrefs("href_normalize", lambda x: href.normalize(F.concat(href.path(x), F.lit("/./u/../v//w"))), f"array_to_string(list_filter(string_split({_PATH}, '/'), lambda s: s NOT IN ('', '.')), '/') || '/v/w'")
_on_hrefs("href_resolve", lambda x: href.resolve(F.lit("/base/dir"), F.concat(F.lit("../"), href.name(x))), f"rtrim('/base/' || {_NAME}, '/')")
_on_hrefs("href_relativize", lambda x: href.relativize(F.lit("/books/a/b"), F.concat(F.lit("/books/c/"), href.name(x))), f"rtrim('../../c/' || {_NAME}, '/')")
_on_hrefs("href_lookup_key", lambda x: href.lookup_key(F.lit("/OPS"), F.concat(F.lit("t/../"), href.name(x), F.lit("?q#f"))), f"rtrim('/OPS/' || {_NAME}, '/')")
_on_hrefs("name_prefix_local", lambda x: F.concat(F.coalesce(href.prefix(x), F.lit("-")), F.lit("|"), href.local(x)), "CASE WHEN instr(x, ':') > 0 THEN split_part(x, ':', 1) || '|' || substr(x, instr(x, ':') + 1) ELSE '-|' || x END")
_on_hrefs("slugify", text.slug, "trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-')")
_on_hrefs("entry_id", text.entry_id, "'' || (SELECT CASE WHEN v = '' THEN 'entry' WHEN v[1] BETWEEN '0' AND '9' THEN '_' || v ELSE v END FROM (SELECT regexp_replace(substr(trim(regexp_replace(translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', '-', 'g'), '-'), 1, 50), '-$', '') AS v))")
_on_hrefs("xml_escape", lambda x: text.xml_escape(F.concat(x, F.lit("<&\"'>\t"))), "replace(replace(x, '&', '&amp;') || '&lt;&amp;&quot;&apos;&gt;&#9;', chr(160), '&#160;')")
_on_hrefs("mime_infer", lambda x: mime.infer(F.coalesce(href.extension(x), F.lit(""))), f"CASE regexp_extract({_NAME}, '[.]([^.]*)$', 1) WHEN 'html' THEN 'text/html' WHEN 'htm' THEN 'text/html' WHEN 'xml' THEN 'application/xml' WHEN 'js' THEN 'text/javascript' WHEN 'css' THEN 'text/css' WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' ELSE 'application/octet-stream' END")

_KINDS = ("copyright", "text", "title-page", "", "cover")


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'copyright-page' WHEN 1 THEN 'bodymatter' WHEN 2 THEN 'titlepage' WHEN 3 THEN 'unknown' ELSE 'cover' END AS kind FROM part")
def toc_kind_canon(s, d):
    given = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % 5 + 1).cast("int"))
    return adapters.read(s, d, "part").select("p_partkey", text.toc_kind(given).alias("kind"))


@query("""SELECT p_partkey, lower(p_type) AS main_type, lower(p_brand) AS subtype, 'xml' AS suffix, 'Charset=' || p_size AS parameters, CAST(p_size AS VARCHAR) AS charset FROM part""")
def mime_parts(s, d):
    kind = F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand"), F.lit("+xml; Charset="), F.col("p_size").cast("string"))
    return adapters.read(s, d, "part").select("p_partkey", kind.alias("k")).select("p_partkey", mime.main_type(F.col("k")).alias("main_type"), mime.subtype(F.col("k")).alias("subtype"), mime.suffix(F.col("k")).alias("suffix"), mime.parameters(F.col("k")).alias("parameters"), mime.parameter(F.col("k"), "Charset").alias("charset"))


@query("SELECT p_partkey, CAST(1 AS INTEGER) AS same, CAST(0 AS INTEGER) AS other FROM part")
def mime_equal(s, d):
    a = F.concat(F.col("p_type"), F.lit("/X; a=1; B="), F.col("p_brand"))
    b = F.concat(F.lower("p_type"), F.lit("/x;b="), F.col("p_brand"), F.lit(";A=1"))
    c = F.concat(F.lower("p_type"), F.lit("/x"))
    return adapters.read(s, d, "part").select("p_partkey", (mime.canonical(a) == mime.canonical(b)).cast("int").alias("same"), (mime.canonical(a) == mime.canonical(c)).cast("int").alias("other"))


@query("SELECT p_partkey, CAST(p_partkey % 4 <> 3 AS INTEGER) AS font FROM part")
def mime_is_font(s, d):
    k = F.element_at(F.array(*map(F.lit, ("FONT/woff", "application/x-font-ttf", "application/vnd.ms-opentype", "application/fonts"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    return adapters.read(s, d, "part").select("p_partkey", mime.is_font(k).cast("int").alias("font"))


_DATE = "strftime(ts, '%Y-%m-%d')"


@query(f"SELECT event_id, CASE event_id % 5 WHEN 2 THEN strftime(ts, '%Y') || '-01-01' ELSE {_DATE} END AS day FROM events")
def date_parse(s, d):
    return adapters.stamps(s, d).select("event_id", civil.show_date(civil.date(F.col("stamp"))).alias("day"))


@query(
    f"""SELECT event_id, CASE event_id % 5 WHEN 0 THEN {_DATE} || 'T' || strftime(ts, '%H:%M:%S') || 'Z' WHEN 1 THEN {_DATE} || 'T00:00:00' WHEN 2 THEN strftime(ts, '%Y') || '-01-01T00:00:00'
        WHEN 3 THEN {_DATE} || 'T' || strftime(ts, '%H:%M') || ':00+05:30' ELSE {_DATE} || 'T' || strftime(ts, '%H:%M:%S') || '-08:00' END AS shown FROM events"""
)
def date_time_parse(s, d):
    return adapters.stamps(s, d).select("event_id", civil.date_time(F.col("stamp")).alias("dt")).select("event_id", civil.show(F.col("dt")).alias("shown"))


@query(f"SELECT event_id, CASE WHEN event_id % 5 IN (0, 4) THEN CAST(extract(hour FROM ts) AS INTEGER) END AS hour FROM events")
def time_parse(s, d):
    t = civil.time(F.when(F.col("event_id") % 5 == 0, F.date_format("ts", "HH:mm:ss'Z'")).when(F.col("event_id") % 5 == 4, F.date_format("ts", "H.m.s")).otherwise(F.lit("Z9")))
    return adapters.stamps(s, d).select("event_id", t["hour"].alias("hour"))


@query(f"SELECT event_id, {_DATE} || 'T' || strftime(ts, '%H:%M:%S') || 'Z' AS shown FROM events")
def unix_to_civil(s, d):
    return adapters.stamps(s, d).select("event_id", civil.from_unix(F.unix_timestamp("ts")).alias("dt")).select("event_id", civil.show(F.col("dt")).alias("shown"))


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_orderkey % 7 END AS INTEGER) AS major, CAST(CASE o_orderkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 0 END AS INTEGER) AS minor FROM orders")
def version_parse(s, d):
    raw = F.concat((F.col("o_orderkey") % 7).cast("string"), F.element_at(F.array(F.lit(".1.9"), F.lit(" "), F.lit(".x")), (F.col("o_orderkey") % 3 + 1).cast("int")))
    v = civil.version(raw)
    return adapters.read(s, d, "orders").select("o_orderkey", v["major"].alias("major"), v["minor"].alias("minor"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(0 AS INTEGER) AS has_z FROM events")
def attributes_get(s, d):
    attributes = F.array(F.struct(F.lit("k").alias("name"), F.get_json_object("props", "$.k").alias("value")), F.struct(F.lit("k").alias("name"), F.lit("later").alias("value")))
    return adapters.read(s, d, "events").select("event_id", text.attribute(attributes, "k").alias("k"), F.exists(attributes, lambda a: a["name"] == "z").cast("int").alias("has_z"))


@query("SELECT p_partkey, len(string_split(lower(p_name), ' ')) AS n, lower(p_name) || ' nav' AS added, array_to_string(list_filter(string_split(lower(p_name), ' '), lambda t: t <> 'widget'), ' ') AS rest FROM part")
def properties_tokens(s, d):
    p = F.lower("p_name")
    return adapters.read(s, d, "part").select("p_partkey", F.size(text.properties(p)).cast("long").alias("n"), text.insert_property(p, "nav").alias("added"), text.remove_property(p, "widget").alias("rest"))
