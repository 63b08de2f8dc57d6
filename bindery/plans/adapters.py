"""The driver's tables in the shape of a corpus of ebooks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hrefs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", F.col("url").alias("href"))


def links(spark: SparkSession, d: str) -> DataFrame:
    """References in pages: page_id, url, ord, href."""
    pages = read(spark, d, "pages")
    return pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("ord", "href"))


def manifest(spark: SparkSession, d: str) -> DataFrame:
    """Ten parts are a book; its fallbacks run in cycles within the book, and a part without a partner dangles."""
    key = F.col("p_partkey")
    book = F.floor(key / 10).cast("long")
    other = lambda factor: (book * 10 + (key % 10) * factor % 10).cast("string")
    return read(spark, d, "part").select(
        book.alias("book_id"), (key % 10).cast("long").alias("ord"), key.cast("string").alias("id"), F.concat(F.lit("/"), F.lower(F.split("p_name", " ")[0]), F.lit("/"), key.cast("string"), F.lit(".xhtml")).alias("href"),
        F.concat(F.lower("p_type"), F.lit("/"), F.lower("p_brand")).alias("media_type"), other(3).alias("fallback"), other(7).alias("media_overlay"), F.lower("p_name").alias("properties"),
    ).withColumn("href_raw", F.substring("href", 2, 1000))


def spine(spark: SparkSession, d: str) -> DataFrame:
    """Orders are books and their lines entries; only lines' values tell equal line numbers apart."""
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("book_id"), "l_linenumber", F.col("l_partkey").alias("idref"), "l_suppkey", "l_extendedprice", (F.col("l_linestatus") == "O").alias("linear"), "l_shipdate"
    )


SPINE_ORDER = ("l_linenumber", "idref", "l_suppkey", "l_extendedprice", "l_shipdate")


def talks(spark: SparkSession, d: str) -> DataFrame:
    """Conversations are books, turns their spine, and what the system says is not linear."""
    return read(spark, d, "conversations").select(F.col("conv_id").alias("book_id"), F.col("turn").alias("ord"), F.concat_ws("-", "role", F.col("turn").cast("string")).alias("idref"), (F.col("role") != "system").alias("linear"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """Languages are books, sources properties, documents entries; the quality label is the display sequence."""
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").select("doc_id", "quality", "toxic")
    rows = docs.join(labels, "doc_id", "left")
    return rows.select(F.col("lang").alias("book_id"), F.col("source").alias("property"), F.col("doc_id").alias("natural_order"), F.col("doc_id").alias("node_id"), F.col("quality").cast("long").alias("display_seq"), F.col("toxic"), F.col("n_chars"), F.lit(None).cast("long").alias("parent_node_id"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one navigation tree: path by the places among siblings."""
    r, n, c = (read(spark, d, t) for t in ("region", "nation", "customer"))
    one = F.lit(0).cast("long")
    top = r.select(F.array(F.col("r_regionkey").cast("long")).alias("path"), F.col("r_name").alias("label"))
    mid = n.select(F.array(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long")).alias("path"), F.col("n_name").alias("label"))
    low = c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.array(F.col("n_regionkey").cast("long"), F.col("n_nationkey").cast("long"), F.col("c_custkey").cast("long")).alias("path"), F.col("c_name").alias("label"))
    return top.unionByName(mid).unionByName(low).select(one.alias("book_id"), one.alias("root_ord"), "path", "label")


def stamps(spark: SparkSession, d: str) -> DataFrame:
    """Times of events in five untidy forms."""
    ts, k = F.col("ts"), F.col("event_id") % 5
    shown = lambda f: F.date_format(ts, f)
    text = F.when(k == 0, shown("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, shown("yyyy/M/d")).when(k == 2, F.concat(F.lit("c"), shown("yyyy"))).when(k == 3, shown("yyyy-MM-dd HH:mm'+05:30'")).otherwise(shown("yyyy-M-d'T'H:m:s'-0800'"))
    return read(spark, d, "events").select("event_id", text.alias("stamp"), "ts")


def creators(spark: SparkSession, d: str) -> DataFrame:
    """Nations are books, customers their metadata, and orders what refines a customer's entry."""
    c, o = read(spark, d, "customer"), read(spark, d, "orders")
    k, n = F.col("c_custkey"), F.col("o_orderkey")
    name = lambda *names: F.array(*map(F.lit, names))
    pair = lambda key, value, when: F.when(when, F.struct(F.lit(key).alias("name"), value.alias("value")))
    pairs = F.array_compact(F.array(
        pair("opf:event", F.when(k % 3 == 0, "publication").otherwise("modification"), k % 3 < 2), pair("opf:file-as", F.concat(F.lit("FA-"), k.cast("string")), k % 2 == 0), pair("opf:role", F.concat(F.lit("r"), (k % 4).cast("string")), k % 5 < 3),
        pair("opf:authority", F.lit("A"), k % 4 == 2), pair("opf:term", k.cast("string"), k % 8 == 2), pair("opf:scheme", F.lit("S"), k % 7 == 1), pair("scheme", F.lit("T"), k % 7 < 3),
    ))
    roots = c.select(
        F.col("c_nationkey").alias("book_id"), k.alias("node_id"), F.lit(None).cast("long").alias("parent_node_id"), F.lit("metadata").alias("owner"), F.concat(F.lit("id-"), k.cast("string")).alias("id"),
        F.get(name("dc:title", "dc:date", "dc:subject", "dc:identifier", "dc:creator", "dcterms:modified", "dc:date"), (k % 7).cast("int")).alias("property"), F.col("c_name").alias("value"),
        F.when(k % 2 == 0, F.lower("c_mktsegment")).alias("language"), F.when(k % 5 == 0, "rtl").otherwise("auto").alias("text_direction"), pairs.alias("attributes"), F.when(k % 9 == 0, "link").otherwise("dc").alias("kind"), k.alias("natural_order"),
    )
    below = o.join(c.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    refining = below.select(
        F.col("c_nationkey").alias("book_id"), (n + 1000000000).alias("node_id"), F.col("o_custkey").alias("parent_node_id"), F.lit("metadata").alias("owner"), F.concat(F.lit("id-"), (n % 90).cast("string")).alias("id"),
        F.get(name("role", "file-as", "title-type", "authority", "term"), (n % 5).cast("int")).alias("property"), F.when(n % 5 == 2, F.when(n % 6 == 0, "main").when(n % 2 == 0, "Short").otherwise("subtitle")).otherwise(F.col("o_orderpriority")).alias("value"),
        F.lit(None).cast("string").alias("language"), F.lit("auto").alias("text_direction"), F.array().cast("array<struct<name string, value string>>").alias("attributes"), F.lit("meta3").alias("kind"), (n + 1000000000).alias("natural_order"),
    )
    return roots.unionByName(refining).withColumn("display_seq", F.lit(None).cast("long"))
