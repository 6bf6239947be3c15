"""Text, retrieval, page and conversation queries over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ventus.functions import search_text as st
from ventus.functions import vectors, web
from ventus.operators import conversation as cv
from ventus.operators import search
from ventus.sources import knowledge
from ventus.sources.tables import read, shared_folder, spread
from ventus.streaming import messages as stream

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None):
    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


#: What normalising does, written out in SQL apart from the library's own table of rewrites.
_NORMALIZED = r"""lower({})
 | wild\s+fires? =>  wildfire
 | \b(?:usa|united\s+states|u\s*\.?\s*s\s*\.?\b) =>  united states unitedstates
 | pm2?\s*2\s*\.?\s*5 =>  pm25 pollution
 | south\s+asia =>  south asia southasia
 | \b(?:highlight|highlights|summary|summaries|overview|story|stories)\b =>  summary glance
 | (?:fine\s+)?particulate\s+(?:matter|pollution|concentrations|concentration|levels|level) =>  pm25 pollution
 | (?:more|greater|higher)\s+than|up\s+from =>  change increase
 | \b(?:increas(?:e|ed|ing|es)|ris(?:e|es|ing)|rose|grew|growth)\b =>  change increase
 | \b(?:decreas(?:e|ed|ing|es)|declin(?:e|ed|ing)|fell|falling|lower)\b =>  change decrease
 | \b(?:trends|trend|chang(?:e|ed|es|ing))\b =>  change
 | [^a-z0-9%\s] => """


def _sql_normalized(column: str) -> str:
    out, *steps = _NORMALIZED.format(column).split("\n | ")
    for step in steps:
        pattern, _, to = step.partition(" => ")
        out = f"regexp_replace({out}, '{pattern}', ' {to.strip()} ', 'g')" if to.strip() else f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


@query("normalize_text", f"SELECT doc_id, {_sql_normalized('text')} AS text FROM documents")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", st.normalize_search_text("text").alias("text"))


@query("number_tokens", r"SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '(\b\d{4}\b|\b\d+(?:[.,]\d+)?%?)', 1), lambda x: replace(x, ',', ''))).list_sort() AS numbers FROM documents")
def number_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.sort_array(st.number_tokens("text")).alias("numbers"))


@query("low_quality_filter", r"""SELECT doc_id FROM documents WHERE length(trim(text)) >= 40 AND NOT (contains(lower(text), 'table of contents') OR len(regexp_extract_all(lower(text), '\bsection\s+\d+')) >= 4
 OR (contains(lower(text), 'references') AND len(regexp_extract_all(lower(text), 'https?://')) >= 5) OR len(regexp_extract_all(lower(text), 'https?://')) >= 12 OR len(string_split_regex(lower(text), '\s+')) < 12)""")
def low_quality_filter(spark, sf_dir):
    return read(spark, sf_dir, "documents").where(st.is_usable_chunk("text")).select("doc_id")


_plain = f"SELECT doc_id, unnest(string_split({_sql_normalized('text')}, ' ')) AS token FROM documents"


def _plain_tokens(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(st.normalize_search_text("text"), " ")).alias("token"))


@query("document_frequency", f"SELECT token, count(DISTINCT doc_id) AS df FROM ({_plain}) GROUP BY token")
def document_frequency(spark, sf_dir):
    return _plain_tokens(spark, sf_dir).distinct().groupBy("token").agg(F.count("*").alias("df"))


@query("term_frequency", f"SELECT doc_id, token, count(*) AS tf FROM ({_plain}) GROUP BY doc_id, token")
def term_frequency(spark, sf_dir):
    """Texts go where their rows are counted, so no row a word is exchanged."""
    texts = read(spark, sf_dir, "documents").select("doc_id", st.normalize_search_text("text").alias("t")).repartition("doc_id")
    return texts.select("doc_id", F.explode(F.split("t", " ")).alias("token")).groupBy("doc_id", "token").agg(F.count("*").alias("tf"))


@query("token_overlap", f"WITH n AS (SELECT doc_id, string_split({_sql_normalized('text')}, ' ') AS t FROM documents WHERE text IS NOT NULL) SELECT x.doc_id, round(len(list_intersect(list_distinct(x.t), y.t)) / len(list_distinct(x.t)), 6) AS overlap FROM n x JOIN n y ON y.doc_id = x.doc_id - 1")
def token_overlap(spark, sf_dir):
    """Of each document with the one before it; each is normalised once, and exchanged as a text."""
    folder = shared_folder(spark)
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", st.normalize_search_text("text").alias("t"))
    docs.write.parquet(f"{folder}/normalized")
    docs = spark.read.schema(docs.schema).parquet(f"{folder}/normalized")
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("t").alias("before"))
    return docs.join(before, "doc_id").select("doc_id", F.round(st.token_overlap(F.split("t", " "), F.split("before", " ")), 6).alias("overlap"))


@query("chunk_exact_dedup", r"SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))))")
def chunk_exact_dedup(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("text").alias("content"))
    return knowledge.distinct_chunks(docs, ["doc_id"]).select("doc_id")


@query("record_dedup", "SELECT DISTINCT event_type, props FROM events")
def record_dedup(spark, sf_dir):
    from ventus.sources.records import distinct_records

    events = read(spark, sf_dir, "events").select("event_type", "props", F.from_json("props", "map<string,string>").alias("fields"))
    return distinct_records(events, "event_type").select("event_type", "props")


@query("chunk_text", None)
def chunk_text(spark, sf_dir):
    return knowledge.chunked(read(spark, sf_dir, "documents"))


@query("chunk_counts", "SELECT source AS source_id, count(*) AS chunk_count FROM documents GROUP BY source")
def chunk_counts(spark, sf_dir):
    return knowledge.chunk_counts(read(spark, sf_dir, "documents").select(F.col("source").alias("source_id"), F.col("text").alias("content")))


@query("search_tokens", None)
def search_tokens(spark, sf_dir):
    return spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", st.search_tokens("text").alias("tokens"))


def _chunks(spark, sf_dir):
    null = F.lit(None).cast("string")
    return read(spark, sf_dir, "documents").where("text is not null").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("content"), F.col("source").alias("title"), null.alias("page_title"), F.lit("txt").alias("source_type"))


@query("rank_chunks", None)
def rank_chunks(spark, sf_dir):
    return search.rank_chunks(_chunks(spark, sf_dir), "therean onwhst thinghe")


_fnv = "list_reduce(list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda h, c: (xor(h, c) * 16777619) % 4294967296, 2166136261)"


@query(
    "hash_embedding",
    rf"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9\s.-]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: length(x) > 2)) AS token FROM documents),
 w AS (SELECT doc_id, {_fnv.format("token")} % 384 AS bucket, 1.0 AS w FROM t UNION ALL SELECT doc_id, {_fnv.format("left(token, 5)")} % 384, 0.35 FROM t WHERE length(token) > 5),
 s AS (SELECT doc_id, bucket, sum(w) AS w FROM w GROUP BY ALL)
 SELECT doc_id, CAST(bucket AS BIGINT) AS bucket, round(CAST(CAST(CAST(w AS DOUBLE) / sqrt(sum(CAST(w AS DOUBLE) * CAST(w AS DOUBLE)) OVER (PARTITION BY doc_id)) AS REAL) AS DOUBLE), 4) AS weight FROM s""",
)
def hash_embedding(spark, sf_dir):
    rows = vectors.hash_weights(read(spark, sf_dir, "documents"), "doc_id", "text")
    return rows.select("doc_id", "bucket", F.round(F.col("weight").cast("double"), 4).alias("weight"))


@query("vector_top_k", "SELECT vec_id, round(s, 5) AS similarity FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings) WHERE s >= 0.1 ORDER BY s DESC, vec_id LIMIT 5")
def vector_top_k(spark, sf_dir):
    table = read(spark, sf_dir, "embeddings")
    asked = table.where("vec_id = 0").first()["embedding"]
    return search.top_k_vectors(table, asked, 5, 0.1).select("vec_id", F.round("similarity", 5).alias("similarity"))


@query("page_text", None)
def page_text(spark, sf_dir):
    return knowledge.pages(read(spark, sf_dir, "pages")).select("page_id", "title", "text")


@query("page_links", None)
def page_links(spark, sf_dir):
    return knowledge.pages(read(spark, sf_dir, "pages")).select("page_id", F.posexplode("links").alias("position", "link"))


@query("url_canonical", r"SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || CASE WHEN path = '' THEN '/' WHEN length(path) > 1 THEN regexp_replace(path, '/$', '') ELSE path END AS url FROM (SELECT page_id, url, regexp_replace(regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(/.*)?$', 1), '/{2,}', '/', 'g') AS path FROM pages)")
def url_canonical(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", web.canonical_url("url").alias("url"))


@query("url_skipped", r"SELECT page_id FROM (SELECT page_id, regexp_replace(url, '[?#].*$', '') || CASE page_id % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '/login' WHEN 2 THEN '/logins' ELSE '' END AS path FROM pages) WHERE regexp_matches(path, '(?i)(\.pdf|/login)$')")
def url_skipped(spark, sf_dir):
    tail = F.when(F.col("page_id") % 4 == 0, ".PDF").when(F.col("page_id") % 4 == 1, "/login").when(F.col("page_id") % 4 == 2, "/logins").otherwise("")
    return read(spark, sf_dir, "pages").where(web.is_skipped_path(F.concat(web.url_path(F.col("url")), tail))).select("page_id")


# conversations


_history = f"""SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations QUALIFY n <= {cv.HISTORY}"""
_is_reset = r"(regexp_matches(trim(text), '(?i)^reset[.!?]*$') OR regexp_matches(trim(text), '(?i)\b(?:reset|clear|restart|start over|new)\s+(?:this\s+)?(?:conversation|chat|context)\b'))"


@query("history_since_reset", f"SELECT conv_id, turn, role, text FROM (SELECT *, max(CASE WHEN role = 'user' AND {_is_reset} THEN turn END) OVER (PARTITION BY conv_id) AS cut FROM ({_history})) WHERE cut IS NULL OR turn > cut")
def history_since_reset(spark, sf_dir):
    return cv.recent_history(read(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", "text")


@query("conversation_rollup", "SELECT conv_id, arg_max(text, turn) AS last_message, max(turn) AS last_turn, count(*) AS n_messages, CAST(count(CASE WHEN role = 'user' AND turn > coalesce(a, -1) THEN 1 END) AS BIGINT) AS unread FROM (SELECT *, max(CASE WHEN role <> 'user' THEN turn END) OVER (PARTITION BY conv_id) AS a FROM conversations) GROUP BY conv_id")
def conversation_rollup(spark, sf_dir):
    return cv.rollup(read(spark, sf_dir, "conversations"))


@query("consecutive_dedup", "SELECT conv_id, turn FROM (SELECT *, lag(role) OVER w AS r, lag(text) OVER w AS t FROM (SELECT conv_id, turn, role, text FROM conversations) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE r IS NULL OR r IS DISTINCT FROM role OR t IS DISTINCT FROM text")
def consecutive_dedup(spark, sf_dir):
    return cv.without_repeats(read(spark, sf_dir, "conversations")).select("conv_id", "turn")


@query("search_ilike", "SELECT c_custkey FROM customer WHERE c_name ILIKE '%r#00000001%' OR c_mktsegment ILIKE '%r#00000001%'")
def search_ilike(spark, sf_dir):
    return cv.found_by(read(spark, sf_dir, "customer"), "R#00000001%", ["c_name", "c_mktsegment"]).select("c_custkey")


_twice = "SELECT event_id, user_id, value FROM events UNION ALL SELECT event_id, user_id, value FROM events WHERE event_id % 3 = 0"


@query("event_dedup", f"SELECT event_id, user_id FROM ({_twice}) GROUP BY ALL HAVING event_id % 5 <> 0")
def event_dedup(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("event_id", "user_id")
    return cv.new_messages(events.unionByName(events.where("event_id % 3 = 0")), events.where("event_id % 5 = 0"), "event_id")


@query("events_json_props", "SELECT event_type, count(*) AS n, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS total FROM events GROUP BY event_type")
def events_json_props(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("p.k").alias("total"))


def _event_stream(spark, sf_dir):
    schema = read(spark, sf_dir, "events").schema
    return stream.timed(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


@query("stream_event_dedup", "SELECT event_id, user_id FROM events")
def stream_event_dedup(spark, sf_dir):
    events = _event_stream(spark, sf_dir).select("event_id", "user_id", "ts")
    twice = events.withColumn("_n", F.explode(F.array(F.lit(1), F.lit(2)))).drop("_n")
    return stream.run_once(stream.each_once(twice, "event_id"), "events").select("event_id", "user_id")


@query("stream_conversation_state", "SELECT CAST(user_id AS VARCHAR) AS conversation, count(*) AS n_messages FROM events GROUP BY user_id")
def stream_conversation_state(spark, sf_dir):
    rows = _event_stream(spark, sf_dir).select(F.col("user_id").cast("string").alias("conversation"), F.when(F.col("event_type") == "click", "assistant").otherwise("user").alias("role"), F.col("event_type").alias("content"), "ts")
    return stream.run_once(stream.conversation_state(rows), "state", "update").groupBy("conversation").agg(F.max("n_messages").alias("n_messages"))
