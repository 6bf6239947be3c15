"""Queries over the store's tables, sources, chunks and messages, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ventus import catalog_text as ct
from ventus.functions import web
from ventus.operators import conversation as cv
from ventus.operators import reply
from ventus.sources import knowledge, records, store
from ventus.sources.tables import read
from ventus.streaming import messages as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def keep(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return keep


# rules of columns and rows


@query("status_valid", "SELECT o_orderkey, o_orderstatus IN ('F', 'P') AS ok FROM orders")
def status_valid(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "P", "processing").when(F.col("o_orderkey") % 2 == 0, "gone")
    return read(spark, sf_dir, "orders").withColumn("status", status).select("o_orderkey", store.valid("status", store.STATUSES).alias("ok"))


@query("column_names", r"SELECT p_partkey, regexp_replace(replace(lower(p_type), '2.5', '25'), '[^a-z0-9]', '', 'g') || 'um325' || CAST(p_size AS VARCHAR) AS name FROM part")
def column_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", records.normalized_column(F.concat("p_type", F.lit(" (\u00b5/M3) 2.5-"), "p_size")).alias("name"))


@query("row_levels", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'gadm2' WHEN c_custkey % 2 = 0 THEN 'gadm1' ELSE 'gadm0' END AS level FROM customer")
def row_levels(spark, sf_dir):
    k = F.col("c_custkey")
    rows = read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 3 == 0, F.col("c_mktsegment")).alias("district"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("state"), F.lit("x").alias("country"))
    return rows.select("c_custkey", records.row_level().alias("level"))


@query("metadata_merge", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type ELSE CAST(user_id AS VARCHAR) END AS a, event_type AS b, CASE WHEN event_id % 3 = 0 THEN 'new' END AS c FROM events")
def metadata_merge(spark, sf_dir):
    base = F.create_map(F.lit("a"), F.col("user_id").cast("string"), F.lit("b"), F.col("event_type"))
    later = F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("a"), F.col("event_type"), F.lit("c"), F.lit("new")))
    return read(spark, sf_dir, "events").select("event_id", store.merged_metadata(base, later).alias("m")).select("event_id", "m.a", "m.b", "m.c")


@query("status_changed", "SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey = 3 THEN 'inactive' ELSE 'active' END AS status, o_orderkey = 3 AS changed FROM orders")
def status_changed(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lit("active").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    return store.with_status(rows, "3", "inactive").select("id", "status", F.col("updated_at").isNotNull().alias("changed"))


@query("names_filled", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'given' WHEN o_custkey % 2 = 0 THEN c_name END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def names_filled(spark, sf_dir):
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("phone"), F.when(F.col("o_orderkey") % 4 == 0, "given").alias("name"))
    contacts = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("phone"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).alias("name"))
    return store.with_names(orders, contacts).select("o_orderkey", "name")


@query("unread_cleared", "SELECT CAST(c_custkey AS VARCHAR) AS id, CASE WHEN c_custkey = 7 THEN 0 ELSE CAST(c_nationkey AS INTEGER) END AS unread_count FROM customer")
def unread_cleared(spark, sf_dir):
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_nationkey").cast("int").alias("unread_count"))
    return store.read_by_person(rows, "7")


@query("reprocess_status", "SELECT o_orderkey AS source_id, CASE WHEN n > 0 AND n = ok THEN 'active' ELSE 'error' END AS status FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_linestatus = 'O' OR l_quantity > 10 THEN 1 END) AS ok FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey")
def reprocess_status(spark, sf_dir):
    chunks = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), (F.col("l_linestatus") == "O").alias("structured"), F.when(F.col("l_quantity") > 10, F.array("l_tax")).alias("embedding"))
    return store.reprocessed(chunks, read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id")))


# sources and chunks

_documents = "SELECT doc_id, source, text, lang FROM documents"


@query("active_chunks", "SELECT id, title, source_type, source_url FROM (SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN source LIKE '%a%' THEN upper(source) ELSE lang END AS title, 'web' AS source_type, source AS source_url, CAST(doc_id % 97 AS BIGINT) AS created_at FROM documents WHERE substr(source, 1, 1) <> 'z')")
def active_chunks(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    chunks = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("source_id"), F.col("lang").alias("title"), F.lit("txt").alias("source_type"), F.lit("u").alias("source_url"), (F.col("doc_id") % 97).alias("created_at"))
    sources = docs.select(F.col("source").alias("id")).distinct().select("id", F.when(F.col("id").contains("a"), F.upper("id")).alias("title"), F.lit("web").alias("source_type"), F.col("id").alias("source_url"), F.when(F.left("id", F.lit(1)) != "z", "active").otherwise("inactive").alias("status"))
    return knowledge.active_chunks(chunks, sources).select("id", "title", "source_type", "source_url")


@query("without_deleted", "SELECT conv_id, turn FROM conversations WHERE conv_id % 7 <> 0")
def without_deleted(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn")
    return knowledge.without_deleted(rows, rows.where("conv_id % 7 = 0"), "conv_id")


@query("duplicate_sources", "SELECT DISTINCT p_partkey AS id FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 2 = 0 AND (p_partkey % 4 = 0 OR p_partkey % 5 = 0)")
def duplicate_sources(spark, sf_dir):
    k = F.col("p_partkey")
    part = read(spark, sf_dir, "part").select(k.alias("id"), F.col("p_name"), F.concat("p_name", F.lit("|"), k.cast("string")).alias("title"), F.lit("web").alias("source_type"))
    new = part.withColumn("source_url", F.when(F.col("id") % 4 != 0, F.concat(F.lit("http://"), F.col("id").cast("string")))).withColumn("file_path", F.when(F.col("id") % 3 == 0, "x.CSV").otherwise("x.txt"))
    there = part.withColumn("source_url", F.concat(F.lit("http://"), F.when(F.col("id") % 5 == 0, F.col("id").cast("string")).otherwise("else"))).withColumn("status", F.when(F.col("id") % 2 == 0, F.when(F.col("id") % 6 == 0, "processing").otherwise("active")).otherwise("error"))
    return knowledge.duplicate_sources(new, there.drop("id", "p_name")).select("id")


@query("sources_listed", "SELECT o_orderkey, o_orderdate FROM orders")
def sources_listed(spark, sf_dir):
    return knowledge.listed(read(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate")


@query("private_addresses", "SELECT k AS event_id, a = 0 OR a = 10 OR a = 127 OR (a = 100 AND b BETWEEN 64 AND 127) OR (a = 169 AND b = 254) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 198 AND b IN (18, 19)) OR a >= 224 OR k % 50 = 0 AS private FROM (SELECT event_id AS k, event_id % 256 AS a, (event_id // 256 * 7 + event_id) % 256 AS b FROM events)")
def private_addresses(spark, sf_dir):
    k = F.col("event_id")
    a, b = k % 256, (F.floor(k / 256) * 7 + k) % 256
    address = F.when(k % 50 == 0, "none").otherwise(F.concat(F.when(k % 3 == 0, "::ffff:").otherwise(""), F.concat_ws(".", a.cast("string"), b.cast("string"), F.lit("1"), F.lit("9"))))
    return read(spark, sf_dir, "events").select("event_id", web.private_address(address).alias("private"))


@query("facts_of_sources", "SELECT CASE WHEN c_nationkey % 4 = 1 THEN 'gadm0' ELSE 'gadm1' END AS csv_level, 'C' || CAST(c_nationkey AS VARCHAR) AS country, CASE WHEN c_nationkey % 4 = 2 THEN c_mktsegment END AS state, CAST(2000 + c_custkey % 20 AS INTEGER) AS year, c_custkey / 2 AS pm25 FROM customer WHERE c_nationkey % 4 IN (1, 2)")
def facts_of_sources(spark, sf_dir):
    """Customers as records of four sources, each record twice: an old and a new one of countries, one of states, one that is off."""
    titles = [("0", "old gadm0", "a.csv", "active", 1), ("1", "new GADM_0", "b.csv", "active", 9), ("2", "states", "gadm1.csv", "active", 3), ("3", "off", "c.csv", "inactive", 4)]
    sources = spark.createDataFrame([(*x, k) for k, x in enumerate(titles)], "id string, title string, file_path string, status string, at long, seq long")
    sources = sources.select("id", "title", "file_path", "status", F.timestamp_seconds("at").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), "seq")
    source = F.col("c_nationkey") % 4
    fields = [F.lit("Country"), F.concat(F.lit("C"), F.col("c_nationkey").cast("string")), F.when(source == 0, "Year").otherwise("data year"), (2000 + F.col("c_custkey") % 20).cast("string"), F.when(source == 1, "PM2.5").otherwise("pm25"), (F.col("c_custkey") / 2).cast("string")]
    record = F.when(source == 2, F.create_map(*fields, F.lit("State"), F.col("c_mktsegment"))).otherwise(F.create_map(*fields))
    chunks = read(spark, sf_dir, "customer").select(source.cast("string").alias("source_id"), F.col("c_custkey").alias("chunk_index"), F.array(record, record).alias("records"))
    return records.load_facts(sources, chunks).select("csv_level", "country", "state", "year", "pm25")


_addresses = f"SELECT min(page_id) AS page_id FROM ({ct.ORACLE_SQL['url_canonical']}) GROUP BY url"


@query("pages_once", f"SELECT min(page_id) AS page_id FROM pages JOIN ({_addresses}) USING (page_id) GROUP BY sha256(lower(trim(regexp_replace(html, '\\s+', ' ', 'g'))))")
def pages_once(spark, sf_dir):
    return knowledge.distinct_pages(read(spark, sf_dir, "pages").select("page_id", "url", F.col("html").alias("text"))).select("page_id")


# messages


@query("stream_history", f"SELECT CAST(conv_id AS VARCHAR) AS conversation, count(*) AS n, arg_max(text, turn) AS last FROM ({ct.ORACLE_SQL['history_since_reset']}) GROUP BY conv_id")
def stream_history(spark, sf_dir):
    schema = read(spark, sf_dir, "conversations").schema
    files = "conversations.parquet" if sf_dir.startswith("/") and not _is_folder(spark, f"{sf_dir}/conversations.parquet") else None
    source = spark.readStream.schema(schema)
    rows = source.option("pathGlobFilter", files).parquet(sf_dir) if files else source.parquet(f"{sf_dir}/conversations.parquet")
    rows = rows.select(F.col("conv_id").cast("string").alias("conversation"), "role", F.col("text").alias("content"), F.timestamp_seconds("turn").alias("ts"))
    last = stream.run_once(stream.history_state(rows), "history", "update").where(F.size("texts") > 0)
    return last.select("conversation", F.size("texts").cast("long").alias("n"), F.element_at("texts", -1).alias("last"))


def _is_folder(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()


@query("webhook_messages", "SELECT 'm' || CAST(event_id AS VARCHAR) AS msg_id, CAST(user_id AS VARCHAR) AS phone, CASE WHEN event_id % 2 = 0 THEN 'N' || CAST(user_id AS VARCHAR) END AS name, event_type AS content FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 <> 0")
def webhook_messages(spark, sf_dir):
    k, user = F.col("event_id"), F.col("user_id").cast("string")
    message = F.struct(user.alias("from"), F.concat(F.lit("m"), k.cast("string")).alias("id"), F.lit("1700000000").alias("timestamp"), F.when(k % 7 == 0, "image").otherwise("text").alias("type"), F.struct(F.when(k % 11 == 0, " ").otherwise(F.concat(F.lit(" "), "event_type")).alias("body")).alias("text"))
    contact = F.struct(F.struct(F.concat(F.lit("N"), user).alias("name")).alias("profile"), F.when(k % 2 == 0, user).otherwise("none").alias("wa_id"))
    change = F.struct(F.lit("messages").alias("field"), F.struct(F.array(contact).alias("contacts"), F.array(message).alias("messages")).alias("value"))
    payload = F.struct(F.when(k % 5 == 0, "page").otherwise("account").alias("object"), F.array(F.struct(F.array(change).alias("changes"))).alias("entry"))
    return cv.webhook_messages(read(spark, sf_dir, "events").select(F.to_json(payload).alias("body")), "body", "account").select("msg_id", "phone", "name", "content")


@query("conversations_of_phones", "SELECT CAST(user_id AS VARCHAR) AS phone, min(CASE WHEN event_id = first THEN 'N' || CAST(event_id AS VARCHAR) END) AS name, count(*) AS unread FROM events JOIN (SELECT user_id AS u, min(CASE WHEN event_id % 3 = 0 THEN event_id END) AS first FROM events GROUP BY user_id) ON u = user_id GROUP BY user_id")
def conversations_of_phones(spark, sf_dir):
    k = F.col("event_id")
    rows = read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("phone"), F.when(k % 3 == 0, F.concat(F.lit("N"), k.cast("string"))).alias("name"), F.col("event_type").alias("content"), k.alias("sent"))
    return cv.conversations_of(rows).select("phone", "name", "unread")


@query("outage_errors", "SELECT o_orderkey, o_orderkey % 4 = 1 OR o_orderkey % 4 = 2 OR (o_orderkey % 4 = 3 AND o_orderkey % 3 = 0) AS out FROM orders")
def outage_errors(spark, sf_dir):
    k = F.col("o_orderkey")
    message = F.when(k % 4 == 1, "TypeError: Fetch failed").when(k % 4 == 2, "connect ECONNREFUSED 1.2.3.4").when(k % 4 == 3, "not found")
    return read(spark, sf_dir, "orders").select("o_orderkey", cv.is_unreachable(message, F.when(k % 4 == 3, F.when(k % 3 == 0, 503).otherwise(404))).alias("out"))


@query("human_gate", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING conv_id % 3 <> 0 AND count(CASE WHEN role = 'user' THEN 1 END) > 2")
def human_gate(spark, sf_dir):
    states = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("users")).select("conv_id", F.when(F.col("conv_id") % 3 == 0, "human").otherwise("agent").alias("mode"), F.greatest(F.col("users") - 2, F.lit(0)).alias("unread"))
    return stream.to_answer(states).select("conv_id")


# replies

_cleaned = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '(?i)\\bfigure\\s+\\d+[.:]?\\s*', '', 'g'), 'https?://\\S+', '', 'g'), '\\[\\d+\\]', '', 'g'), '\\s+', ' ', 'g'))"


@query("cleaned_answers", f"SELECT item_id, k, c, length(c) BETWEEN 35 AND 620 AND regexp_matches(c, '[.!?]$') AND NOT contains(lower(c), 'table of contents') AS usable FROM (SELECT item_id, k, {_cleaned} AS c FROM (SELECT item_id, k, CASE k WHEN 0 THEN text WHEN 1 THEN 'Figure 12: ' || text || ' [3] http://a.b/c  more.' WHEN 2 THEN 'Short [1].' ELSE 'Table of  contents ' || left(text, 100) || '.' END AS x FROM benchmark, (SELECT unnest(range(0, 4)) AS k)))")
def cleaned_answers(spark, sf_dir):
    t = F.col("text")
    said = F.array(t, F.concat(F.lit("Figure 12: "), t, F.lit(" [3] http://a.b/c  more.")), F.lit("Short [1]."), F.concat(F.lit("Table of  contents "), F.left(t, F.lit(100)), F.lit(".")))
    rows = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(said).alias("k", "x")).select("item_id", F.col("k").cast("long").alias("k"), reply.cleaned(F.col("x")).alias("c"))
    return rows.withColumn("usable", reply.is_usable_answer(F.col("c")))
