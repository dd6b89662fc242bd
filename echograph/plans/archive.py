"""Queries over an archive of messages: extraction, membership, registries, similar pairs and tests.

The messages are made of the event table, the texts of the documents, and the vectors of the embeddings,
by rules that Spark and DuckDB share; what is queried is the library's own operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.functions import stats
from echograph.functions import text as T
from echograph.operators import collect, extract, graph, layers, match, topics
from echograph.operators.graph import Graph
from echograph.plans import views as V
from echograph.plans.catalog import longs, query
from echograph.session import materialise, read_table


def handle(number) -> F.Column:
    return F.concat(F.lit("chan_"), number.cast("string"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Events as messages of forty channels: texts that name channels, entities, forward headers, albums."""
    e, k = read_table(spark, sf, "events"), F.col("event_id")
    text = F.concat(F.lit("\U0001f600 read @Chan_"), (k % 61).cast("string"), F.lit(", t.me/chan_"), (k % 53).cast("string"), F.lit("/7 and @chan_"), (k % 61).cast("string"), F.lit(" https://t.me/joinchat now"))
    nothing = F.lit(None).cast("string")
    entity = lambda kind, at, size, url: F.struct(F.lit(kind).alias("type"), (F.lit(at) if isinstance(at, int) else at).cast("int").alias("offset"), size.cast("int").alias("length"), url.alias("url"))
    held = F.array(
        entity("MessageEntityTextUrl", 0, F.lit(2), F.concat(F.lit("https://T.me/chan_"), (k % 47).cast("string"), F.lit("/1 t.me/chan_1"))),
        entity("MessageEntityMention", 8, 6 + F.length((k % 61).cast("string")), nothing),
        entity("MessageEntityUrl", 16 + F.length((k % 61).cast("string")), 10 + F.length((k % 53).cast("string")), nothing),
    )
    forward = F.struct((k % 70).alias("source_channel_id"), (F.col("ts").cast("timestamp") - F.expr("make_interval(0, 0, 0, 0, 0, event_id % 500, 0)")).alias("source_date"))
    return e.select(
        handle(F.col("user_id") % 40).alias("channel"), k.alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"), F.when(k % 4 != 0, text).alias("text"),
        F.when(k % 5 == 0, held).alias("entities"), F.when(k % 3 == 0, forward).alias("fwd_from"), (k % 3 == 0).alias("is_fwd"), (F.col("event_type") == "view").alias("has_media"),
        F.floor(F.col("value") * 100).cast("long").alias("views"), (k % 7).alias("reactions"), F.when(k % 6 == 0, F.floor(k / 12)).alias("grouped_id"), (k % 11 == 0).alias("post"),
    )


MSGS = """msgs AS (SELECT 'chan_' || user_id % 40 AS channel, event_id AS msg_id, ts, CASE WHEN event_id % 4 <> 0 THEN '\U0001f600 read @Chan_' || event_id % 61 || ', t.me/chan_' || event_id % 53 || '/7 and @chan_' || event_id % 61 || ' https://t.me/joinchat now' END AS text,
event_id % 61 AS named, event_id % 47 AS hidden, event_id % 53 AS linked, event_id % 5 = 0 AS has_entities, event_id % 3 = 0 AS is_fwd, event_id % 70 AS sid, ts - to_minutes(event_id % 500) AS src, event_type = 'view' AS has_media, floor(value * 100)::BIGINT AS views, event_id % 7 AS reactions, CASE WHEN event_id % 6 = 0 THEN event_id // 12 END AS grouped_id, event_id % 11 = 0 AS post FROM events)"""
_HANDLE = "([A-Za-z][A-Za-z0-9_]{4,31})"
FOUND = f"""{MSGS}, found AS (
SELECT channel, msg_id, lower(unnest(regexp_extract_all(text, '@{_HANDLE}([^A-Za-z0-9_]|$)', 1))) AS handle, 'mention' AS method FROM msgs
UNION SELECT channel, msg_id, lower(unnest(regexp_extract_all(text, '(?i)(?:https?://)?(?:t\\.me|telegram\\.me)/{_HANDLE}', 1))), 'link' FROM msgs
UNION SELECT channel, msg_id, 'chan_' || hidden, 'text_url' FROM msgs WHERE has_entities
UNION SELECT channel, msg_id, lower(ltrim(substr(text, 8, 6 + length(named::VARCHAR)), '@')), 'entity' FROM msgs WHERE has_entities AND text IS NOT NULL)"""
ALIASES = "aliases AS (SELECT 'chan_' || k AS alias, 'chan_' || (k - 40) AS canonical FROM range(40, 61, 2) t(k))"


def aliases(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    return spark.range(40, 61, 2).select(handle(k).alias("alias"), handle(k - 40).alias("canonical"))


@query("raw_mentions", f"WITH {FOUND} SELECT channel, msg_id, handle, method FROM found")
def raw_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return extract.raw_mentions(messages(spark, sf))


@query("raw_mentions_with_urls", f"WITH {FOUND} SELECT method, count(*) AS n, count(DISTINCT handle) AS n_handles FROM (FROM found UNION SELECT channel, msg_id, 'chan_' || linked, 'url' FROM msgs WHERE has_entities AND text IS NOT NULL) GROUP BY method")
def raw_mentions_with_urls(spark: SparkSession, sf: str) -> DataFrame:
    return extract.raw_mentions(messages(spark, sf), visible_urls=True).groupBy("method").agg(F.count("*").alias("n"), F.count_distinct("handle").alias("n_handles"))


@query("mention_edges", f"WITH {FOUND}, {ALIASES}, n AS (SELECT channel, msg_id, coalesce(canonical, handle) AS target, handle, method FROM found LEFT JOIN aliases ON handle = alias) SELECT channel AS source, target, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods, count(DISTINCT (msg_id, handle)) AS n_msgs FROM n WHERE channel <> target GROUP BY ALL")
def mention_edges(spark: SparkSession, sf: str) -> DataFrame:
    return extract.mention_edges(extract.raw_mentions(messages(spark, sf)), aliases(spark)).withColumn("methods", F.array_join("methods", ","))


@query("message_mentions", f"WITH {FOUND}, {ALIASES}, n AS (SELECT channel, msg_id, coalesce(canonical, handle) AS target FROM found LEFT JOIN aliases ON handle = alias) SELECT channel, msg_id, array_to_string(list_sort(list(DISTINCT target)), ',') AS targets FROM n WHERE channel <> target AND target IN (SELECT channel FROM msgs) GROUP BY ALL")
def message_mentions(spark: SparkSession, sf: str) -> DataFrame:
    m = messages(spark, sf)
    return extract.message_mentions(extract.raw_mentions(m), m.select(F.col("channel").alias("handle")).distinct(), aliases(spark)).withColumn("targets", F.array_join("targets", ","))


def _id_map(spark: SparkSession) -> DataFrame:
    return spark.range(0, 50).select(F.col("id").alias("channel_id"), handle(F.col("id")).alias("handle"))


FORWARDS = f"{MSGS}, fwd AS (SELECT CASE WHEN sid < 50 THEN 'chan_' || sid ELSE 'id:' || sid END AS origin, channel AS target, count(*) AS count, bool_or(sid < 50) AS origin_resolved, min(src) AS first_src_date, max(src) AS last_src_date, max(msg_id) AS target_msg_id FROM msgs WHERE is_fwd GROUP BY ALL)"


@query("forward_edges", f"WITH {FORWARDS} SELECT origin, target, count, origin_resolved, first_src_date, last_src_date FROM fwd")
def forward_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(extract.forward_edges(messages(spark, sf), _id_map(spark))).drop("target_msg_id")


def _dated(df: DataFrame) -> DataFrame:
    """Dates without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c, kind in df.dtypes if kind == "timestamp"})


@query("forward_rep", f"WITH {FORWARDS} SELECT origin, target, target_msg_id, 'https://t.me/' || target || '/' || target_msg_id AS post_url FROM fwd WHERE origin_resolved")
def forward_rep(spark: SparkSession, sf: str) -> DataFrame:
    e = extract.forward_edges(messages(spark, sf), _id_map(spark)).filter(extract.resolve(F.col("origin")))
    return extract.with_permalink(e).select("origin", "target", "target_msg_id", "post_url")


@query(
    "channel_stats",
    f"""WITH {MSGS} SELECT channel, count(*) AS n_msgs, count(*) FILTER (WHERE regexp_matches(text, '\\S')) AS n_text_msgs, count(*) FILTER (WHERE has_media) AS n_media_msgs, count(*) FILTER (WHERE is_fwd) AS n_forward_msgs,
    count(DISTINCT sid) FILTER (WHERE is_fwd) AS n_fwd_sources, min(ts) AS first_date, max(ts) AS last_date, trunc(median(views))::BIGINT AS median_views, sum(reactions)::BIGINT AS reactions, count(*) FILTER (WHERE grouped_id IS NULL) + count(DISTINCT grouped_id) AS n_posts FROM msgs GROUP BY channel""",
)
def channel_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _dated(extract.channel_stats(messages(spark, sf)))


@query("channel_type", f"WITH {MSGS}, h AS (SELECT channel, bool_or(post) AS post FROM (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts DESC, msg_id DESC) AS r FROM msgs) WHERE r <= 20 GROUP BY channel), c AS (SELECT 'chan_' || k AS channel FROM range(45) t(k)) SELECT channel, CASE WHEN post IS NULL THEN 'empty' WHEN post THEN 'channel' ELSE 'group' END AS type FROM c LEFT JOIN h USING (channel)")
def channel_type(spark: SparkSession, sf: str) -> DataFrame:
    return extract.channel_type(messages(spark, sf), spark.range(45).select(handle(F.col("id")).alias("channel")))


DETECTED = "det AS (SELECT source AS channel, CASE WHEN doc_id % 9 = 0 THEN 'en' ELSE lang END AS lang, (n_chars % 100) / 100.0::DOUBLE AS prob FROM documents), voted AS (SELECT channel, arg_min(lang, (-c, lang)) AS language, round(sum(p) / sum(c), 3) AS lang_confidence, sum(c)::BIGINT AS sample_size FROM (SELECT channel, lang, count(*) AS c, sum(prob) AS p FROM det GROUP BY ALL) GROUP BY channel)"


def _voted(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    said = F.when(F.col("doc_id") % 9 == 0, "en").otherwise(F.col("lang"))
    return extract.dominant_language(d.select(F.col("source").alias("channel"), said.alias("lang"), ((F.col("n_chars") % 100) / F.lit(100.0)).alias("prob")))


@query("dominant_language", f"WITH {DETECTED} SELECT * FROM voted")
def dominant_language(spark: SparkSession, sf: str) -> DataFrame:
    return _voted(spark, sf)


RELABEL = f"{DETECTED}, cur AS (SELECT source AS channel, min(lang) AS language FROM documents GROUP BY source), heavy AS (SELECT source AS channel FROM documents GROUP BY source HAVING count(*) FILTER (WHERE doc_id % 2 = 0) >= 0.5 * count(*)), re AS (SELECT c.channel, c.language AS old, CASE WHEN h.channel IS NOT NULL AND least(v.language, 'es') <> least(c.language, 'es') THEN v.language ELSE c.language END AS new, h.channel IS NOT NULL AND least(v.language, 'es') <> least(c.language, 'es') AS flipped FROM cur c LEFT JOIN heavy h USING (channel) LEFT JOIN voted v USING (channel))"


def _relabelled(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents").withColumn("channel", F.col("source"))
    totals = d.groupBy("channel").agg(F.count("*").alias("n_msgs"), F.count_if(F.col("doc_id") % 2 == 0).alias("n_forward_msgs"))
    return extract.relabel(d.groupBy("channel").agg(F.min("lang").alias("language")), _voted(spark, sf), totals, lambda c: F.least(c, F.lit("es")), 0.5)


@query("relabel", f"WITH {RELABEL} SELECT * FROM re")
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    return _relabelled(spark, sf)


@query("flip_matrix", f"WITH {RELABEL} SELECT old, new, count(*) AS n FROM re WHERE flipped GROUP BY ALL")
def flip_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return extract.flip_matrix(_relabelled(spark, sf))


@query("language_map", f"WITH {ALIASES}, r AS (SELECT 'chan_' || k AS handle, ['en', 'de', 'fr'][k % 3 + 1] AS lang FROM range(1, 60, 3) t(k) UNION ALL SELECT 'chan_' || k, 'xx' FROM range(40, 61) t(k) WHERE k % 3 <> 1), n AS (SELECT coalesce(canonical, handle) AS h, handle, lang FROM r LEFT JOIN aliases ON handle = alias) SELECT h AS handle, arg_min(lang, (handle <> h, handle, lang)) AS lang FROM n GROUP BY h")
def language_map(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    named = spark.range(1, 60, 3).select(F.upper(handle(k)).alias("handle"), F.get(F.array(*map(F.lit, ("en", "de", "fr"))), (k % 3).cast("int")).alias("lang"))
    return extract.language_map(named.unionByName(spark.range(40, 61).filter("id % 3 <> 1").select(handle(k).alias("handle"), F.lit("xx").alias("lang"))), aliases(spark))


@query("alias_attribute", f"WITH {ALIASES}, a AS (SELECT 'chan_' || k AS handle, k * 10 AS subscribers FROM range(30, 60) t(k)), c AS (SELECT 'chan_' || k AS handle FROM range(45) t(k)) SELECT c.handle, coalesce(a.subscribers, b.subscribers) AS subscribers FROM c LEFT JOIN a USING (handle) LEFT JOIN aliases ON canonical = c.handle LEFT JOIN a b ON b.handle = alias")
def alias_attribute(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("id")
    known = spark.range(30, 60).select(handle(k).alias("handle"), (k * 10).alias("subscribers"))
    return extract.alias_attribute(spark.range(45).select(handle(k).alias("handle")), "handle", known, aliases(spark), "subscribers")


BFS = f"""{FOUND}, me AS (SELECT DISTINCT channel AS source, handle AS target FROM found WHERE channel <> handle AND handle <> 'joinchat' AND msg_id < 400), data AS (SELECT 'chan_' || k AS handle FROM range(0, 40, 2) t(k)),
d1 AS (SELECT target, list_sort(list(source))[1:8] AS o FROM me WHERE source = 'chan_0' AND target <> 'chan_0' GROUP BY target),
d2 AS (SELECT target, list_sort(list(source))[1:8] AS o FROM me WHERE source IN (SELECT target FROM d1) AND source IN (FROM data) AND target <> 'chan_0' AND target NOT IN (SELECT target FROM d1) GROUP BY target),
b AS (SELECT 'chan_0' AS handle, 0 AS depth, []::VARCHAR[] AS o UNION ALL SELECT target, 1, o FROM d1 UNION ALL SELECT target, 2, o FROM d2)"""


def _members(spark: SparkSession, sf: str) -> DataFrame:
    edges = extract.mention_edges(extract.raw_mentions(messages(spark, sf).filter("msg_id < 400"))).select("source", "target")
    return extract.bfs_members(spark.createDataFrame([("chan_0",)], "handle string"), edges, spark.range(0, 40, 2).select(handle(F.col("id")).alias("handle")))


@query("bfs_members", f"WITH {BFS} SELECT handle, depth::INT AS depth, array_to_string(o, ',') AS origins, handle IN (FROM data) AS has_data FROM b")
def bfs_members(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).withColumn("origins", F.array_join("origins", ","))


@query("gap_report", f"WITH {BFS} SELECT handle, depth::INT AS depth, array_to_string(o, ',') AS origins, CASE WHEN substr(handle, 6)::INT % 3 = 0 THEN 'failed' ELSE 'unattempted' END AS status FROM b WHERE handle NOT IN (FROM data)")
def gap_report(spark: SparkSession, sf: str) -> DataFrame:
    errors = spark.range(0, 70, 3).select(handle(F.col("id")).alias("handle"))
    return extract.gap_report(_members(spark, sf), errors).withColumn("origins", F.array_join("origins", ","))


@query("encode_missing", "WITH k AS (SELECT DISTINCT source AS key, length(source) AS n FROM documents) SELECT key, CASE WHEN key IN ('src1', 'src2') THEN -1.0 ELSE n::DOUBLE END AS first FROM k")
def encode_missing(spark: SparkSession, sf: str) -> DataFrame:
    texts = read_table(spark, sf, "documents").select(F.col("source").alias("key"), F.col("source").alias("text")).distinct()
    cache = spark.createDataFrame([("src1", [-1.0]), ("src2", [-1.0]), ("src1", [-1.0]), ("gone", [0.0])], "key string, vec array<float>")
    return extract.encode_missing(texts, cache, lambda batch: [[float(len(t))] for t in batch]).select("key", F.get("vec", 0).cast("double").alias("first"))


_STOPPED = "w AS (SELECT source AS channel, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{3,}')) AS term FROM documents), c AS (SELECT channel, term, count(*) AS n FROM w GROUP BY ALL)"
_LISTED = ", ".join(f"('{w}')" for w in sorted({*T.STOP_WORDS, *T.JUNK_WORDS, *T.CALL_WORDS, "que", "der"}))


@query("channel_terms_stopped", f"WITH {_STOPPED}, stop(term) AS (VALUES {_LISTED}), t AS (SELECT channel, sum(n)::BIGINT AS n_tokens FROM c GROUP BY channel), r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, term) AS rank FROM c WHERE term NOT IN (FROM stop)) SELECT channel, term, n, rank, n_tokens FROM r JOIN t USING (channel) WHERE rank <= 50")
def channel_terms_stopped(spark: SparkSession, sf: str) -> DataFrame:
    extra = spark.createDataFrame([("que",), ("der",)], "term string")
    terms, totals = extract.channel_terms(V.docs(spark, sf), topics.stop_words(spark, extra), 50)
    return longs(terms.join(totals, "channel"), "rank")


@query("text_expressions", "SELECT count(*) FILTER (WHERE regexp_matches(text || ' ' || source, '(?i)LICENSE|src1$')) AS n_found, sum(length(substr(text, 100, 50)))::BIGINT AS n_cut, printf('%02d:%02d:%02d', sum(n_chars)::BIGINT // 3600, sum(n_chars)::BIGINT // 60 % 60, sum(n_chars)::BIGINT % 60) AS duration FROM documents")
def text_expressions(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    around = T.snippet(F.col("text"), F.lit(110), F.lit(30), 10)
    shown = F.length(around) - F.when(F.startswith(around, F.lit("…")), 1).otherwise(0) - F.when(F.endswith(around, F.lit("…")), 1).otherwise(0)
    return d.agg(F.count_if(T.any_matches("license|SRC1$", F.col("text"), F.col("source"))).alias("n_found"), F.sum(F.greatest(shown, F.lit(0))).alias("n_cut"), T.duration(F.sum("n_chars")).alias("duration"))


# Registries and the queue.


@query("in_window", "SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE ts >= (SELECT min(ts) FROM events) AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-20'")
def in_window(spark: SparkSession, sf: str) -> DataFrame:
    return collect.in_window(read_table(spark, sf, "events"), "2024-01-03", "2024-01-20", "ts").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query("status_summary", "SELECT o_orderstatus AS status, count(*) AS n, list_sort(list(o_totalprice))[(count(*) // 2 + 1)::BIGINT] AS median_duration FROM orders GROUP BY 1")
def status_summary(spark: SparkSession, sf: str) -> DataFrame:
    return collect.status_summary(read_table(spark, sf, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("duration_s")))


QUEUE = "q AS (SELECT c_custkey AS handle, c_custkey % 5 = 0 AS is_seed, ['pending', 'done', 'skipped'][c_custkey % 3 + 1] AS status FROM customer WHERE c_custkey % 2 = 0), n AS (SELECT c_custkey AS handle, c_custkey % 7 = 0 AS s FROM customer WHERE c_custkey % 4 <> 1), merged AS (SELECT handle, coalesce(is_seed, false) OR coalesce(s, false) AS is_seed, CASE WHEN status IS NULL THEN 'pending' WHEN (coalesce(is_seed, false) OR coalesce(s, false)) AND status = 'skipped' THEN 'pending' ELSE status END AS status FROM q FULL JOIN n USING (handle))"


def _queue(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    c = read_table(spark, sf, "customer").select(k)
    q = c.filter(k % 2 == 0).select(k.alias("handle"), (k % 5 == 0).alias("is_seed"), F.get(F.array(*map(F.lit, ("pending", "done", "skipped"))), (k % 3).cast("int")).alias("status"))
    return collect.merge_queue(q, c.filter(k % 4 != 1).select(k.alias("handle"), (k % 7 == 0).alias("is_seed")))


@query("merge_queue", f"WITH {QUEUE} SELECT * FROM merged")
def merge_queue(spark: SparkSession, sf: str) -> DataFrame:
    return _queue(spark, sf)


@query("prefilter_queue", f"WITH {QUEUE} SELECT handle, is_seed, CASE WHEN status = 'pending' AND NOT is_seed AND (handle % 10 = 2 OR handle % 6 = 0) THEN 'skipped' ELSE status END AS status, CASE WHEN handle % 6 = 0 THEN handle % 4 + (status = 'pending' AND NOT is_seed AND handle % 10 <> 2)::INT END AS attempt_count FROM merged")
def prefilter_queue(spark: SparkSession, sf: str) -> DataFrame:
    q = _queue(spark, sf)
    known = q.filter("handle % 10 = 2").select("handle")
    errors = q.filter("handle % 6 = 0").select("handle", (F.col("handle") % 4).cast("int").alias("attempt_count"))
    out, bumped = collect.prefilter(q, known, errors)
    return out.join(bumped, "handle", "left")


SEEN = "s AS (SELECT user_id AS handle, event_id AS step, event_type AS tag, ts AS tm, CASE WHEN event_id % 3 <> 0 THEN 'E' || event_id % 10 END AS error FROM events), old AS (SELECT DISTINCT user_id AS handle FROM events WHERE user_id % 2 = 0)"


@query("upsert_errors", f"WITH {SEEN} SELECT handle, CASE WHEN handle % 2 = 0 THEN 0 ELSE min(step) FILTER (WHERE r = 1) END AS first_seen_step, CASE WHEN handle % 2 = 0 THEN 'old' ELSE min(tag) FILTER (WHERE r = 1) END AS first_seen_tag, array_to_string(list_sort(list_distinct(list(tag) || CASE WHEN handle % 2 = 0 THEN ['old'] ELSE [] END)), ',') AS seen_in_tags, count(*) + CASE WHEN handle % 2 = 0 THEN 3 ELSE 0 END AS attempt_count, max(tm) AS last_attempt_at, coalesce(arg_max(error, (tm, step)) FILTER (WHERE error IS NOT NULL), CASE WHEN handle % 2 = 0 THEN 'before' END) AS last_error FROM (SELECT *, row_number() OVER (PARTITION BY handle ORDER BY tm, step) AS r FROM s) GROUP BY handle")
def upsert_errors(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "events")
    k = F.col("event_id")
    new = e.select(F.col("user_id").alias("handle"), F.col("event_type").alias("tag"), k.alias("step"), F.col("ts").alias("at"), F.when(k % 3 != 0, F.concat(F.lit("E"), (k % 10).cast("string"))).alias("error"))
    old = e.filter("user_id % 2 = 0").select(F.col("user_id").alias("handle")).distinct()
    old = old.select("handle", F.lit(0).cast("long").alias("first_seen_step"), F.lit("old").alias("first_seen_tag"), F.array(F.lit("old")).alias("seen_in_tags"), F.lit(3).alias("attempt_count"), F.lit(None).cast("timestamp_ntz").alias("last_attempt_at"), F.lit("before").alias("last_error"))
    return collect.upsert_errors(old, new).withColumn("seen_in_tags", F.array_join("seen_in_tags", ","))


REG = "seen AS (SELECT user_id AS channel_id, 'h' || event_id % 3 AS handle, CASE WHEN event_id % 4 = 0 THEN 't' || event_id END AS title, event_type AS tag, event_id AS step, ts AS tm FROM events), r AS (SELECT channel_id, list(handle ORDER BY tm, step) AS hs, arg_max(title, (tm, step)) FILTER (WHERE title IS NOT NULL) AS title, list_sort(list(DISTINCT tag || ':' || step % 2)) AS ds, arg_max(tag, (tm, step)) AS last_scraped_tag, arg_max(step, (tm, step)) AS last_scraped_step, max(tm) AS last_scraped_at FROM seen GROUP BY channel_id)"


def _registry(spark: SparkSession, sf: str) -> DataFrame:
    e, k = read_table(spark, sf, "events"), F.col("event_id")
    rows = e.select(
        F.col("user_id").alias("channel_id"), F.array(F.concat(F.lit("h"), (k % 3).cast("string"))).alias("handles"), F.when(k % 4 == 0, F.concat(F.lit("t"), k.cast("string"))).alias("title"),
        F.array(F.struct(F.col("event_type").alias("tag"), (k % 2).cast("int").alias("step"))).alias("discoveries"), k.alias("last_scraped_step"), F.col("event_type").alias("last_scraped_tag"), F.col("ts").alias("last_scraped_at"),
    )
    return collect.upsert_registry(rows.limit(0), rows)


def _joined(discoveries) -> F.Column:
    return F.array_join(F.array_sort(F.transform(discoveries, lambda d: F.concat(d["tag"], F.lit(":"), d["step"].cast("string")))), ",")


@query("upsert_registry", f"WITH {REG} SELECT channel_id, len(list_distinct(hs)) AS n_handles, hs[1] AS first_handle, title, array_to_string(ds, ',') AS discoveries, last_scraped_step, last_scraped_tag, last_scraped_at FROM r")
def upsert_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _registry(spark, sf).select("channel_id", F.size("handles").cast("long").alias("n_handles"), F.get("handles", 0).alias("first_handle"), "title", _joined("discoveries").alias("discoveries"), "last_scraped_step", "last_scraped_tag", "last_scraped_at")


@query("credit_discoveries", f"WITH {REG} SELECT channel_id, array_to_string(list_sort(CASE WHEN list_contains(hs, 'h1') THEN ds || ['more:9'] ELSE ds END), ',') AS discoveries FROM r")
def credit_discoveries(spark: SparkSession, sf: str) -> DataFrame:
    handles = spark.createDataFrame([("h1",), ("unknown",)], "handle string")
    return collect.credit_discoveries(_registry(spark, sf), handles, "more", 9).select("channel_id", _joined("discoveries").alias("discoveries"))


# Texts that are nearly alike: the whole way from vectors to edges.

_DOT = "list_dot_product(a.vec, b.vec)"
SIM = f"""vecs AS (SELECT vec_id AS key, embedding::DOUBLE[] AS vec FROM embeddings), sims AS (SELECT a.key AS i, b.key AS j, {_DOT} AS sim FROM vecs a JOIN vecs b ON a.key < b.key WHERE {_DOT} >= 0.3),
occ AS (SELECT event_id % 500 AS key, 'chan_' || user_id % 40 AS channel, event_id AS msg_id, ts FROM events WHERE event_id < 2000), rep AS (SELECT key, arg_min(channel, (ts, channel, msg_id)) AS channel, arg_min(msg_id, (ts, channel, msg_id)) AS msg_id, min(ts) AS ts, count(DISTINCT channel) AS n FROM occ GROUP BY key),
nodes AS (SELECT 'chan_' || k AS handle, ['en', 'de', 'unknown'][k % 3 + 1] AS cls FROM range(36) t(k)), said AS (SELECT 'chan_' || user_id % 40 AS channel, event_id AS msg_id, 'chan_' || event_id % 40 AS target FROM events WHERE event_id < 2000),
pairs AS (SELECT a.channel AS a, a.msg_id AS a_msg_id, a.ts AS a_ts, b.channel AS b, b.msg_id AS b_msg_id, b.ts AS b_ts, sim, a.n AS a_n, b.n AS b_n FROM sims JOIN rep a ON a.key = i JOIN rep b ON b.key = j)"""
VALID = f"""{SIM}, ok AS (SELECT pairs.*, na.cls AS ca, nb.cls AS cb FROM pairs JOIN nodes na ON na.handle = a JOIN nodes nb ON nb.handle = b WHERE a <> b AND sim >= CASE WHEN na.cls = 'unknown' OR nb.cls = 'unknown' THEN 0.45 WHEN na.cls = nb.cls THEN 0.4 ELSE 0.35 END),
kept AS (SELECT * FROM ok WHERE NOT EXISTS (FROM said WHERE said.channel = a AND said.msg_id = a_msg_id AND target = b) AND NOT EXISTS (FROM said WHERE said.channel = b AND said.msg_id = b_msg_id AND target = a)),
turned AS (SELECT least(a, b) AS u, greatest(a, b) AS v, ca, cb, sim, CASE WHEN a < b THEN a_ts ELSE b_ts END AS u_ts, CASE WHEN a < b THEN b_ts ELSE a_ts END AS v_ts, 'semantic' AS layer FROM kept),
copies AS (SELECT least(f.channel, o.channel) AS u, greatest(f.channel, o.channel) AS v, CASE WHEN f.channel < o.channel THEN f.ts ELSE o.ts END AS u_ts, CASE WHEN f.channel < o.channel THEN o.ts ELSE f.ts END AS v_ts FROM (SELECT key, channel, min(ts) AS ts FROM occ GROUP BY ALL) f JOIN rep o USING (key) WHERE f.channel <> o.channel),
both_layers AS (SELECT u, v, sim, u_ts, v_ts, layer, CASE WHEN ca <> 'unknown' AND cb <> 'unknown' THEN ca <> cb END AS is_cross FROM turned UNION ALL SELECT u, v, 1.0, u_ts, v_ts, 'copy', CASE WHEN a.cls <> 'unknown' AND b.cls <> 'unknown' THEN a.cls <> b.cls END FROM copies JOIN nodes a ON a.handle = u JOIN nodes b ON b.handle = v)"""


def _occurrences(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return read_table(spark, sf, "events").filter(k < 2000).select((k % 500).alias("key"), handle(F.col("user_id") % 40).alias("channel"), k.alias("msg_id"), F.col("ts").cast("timestamp").alias("ts"))


def _semantic_pairs(spark: SparkSession, sf: str) -> DataFrame:
    vectors = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return match.expand_pairs(match.cosine_pairs(vectors, 0.3), match.representatives(_occurrences(spark, sf)))


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.range(36).select(handle(F.col("id")).alias("handle"), F.get(F.array(*map(F.lit, ("en", "de", "unknown"))), (F.col("id") % 3).cast("int")).alias("cls"))


def _said(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("event_id")
    return read_table(spark, sf, "events").filter(k < 2000).select(handle(F.col("user_id") % 40).alias("channel"), k.alias("msg_id"), handle(k % 40).alias("target"))


@query("representative_pairs", f"WITH {SIM} SELECT a, a_msg_id, b, b_msg_id, round(sim, 4) AS sim, a_n AS a_n_channels, b_n AS b_n_channels FROM pairs")
def representative_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = _semantic_pairs(spark, sf)
    return p.select("a", "a_msg_id", "b", "b_msg_id", F.round("sim", 4).alias("sim"), "a_n_channels", "b_n_channels")


def _validated(spark: SparkSession, sf: str) -> DataFrame:
    bars = {"same": 0.4, "cross": 0.35, "unknown": 0.45}
    nodes = _nodes(spark)
    sem = match.validate(_semantic_pairs(spark, sf), nodes, nodes, _said(spark, sf), **bars).withColumn("layer", F.lit("semantic"))
    star = match.star_pairs(_occurrences(spark, sf))
    cop = match.validate(star, nodes, nodes, None, **bars).withColumn("layer", F.lit("copy"))
    columns = ["u", "v", "u_ts", "v_ts", "sim", "is_cross", "vote", "latency_s", "layer"]
    return sem.select(columns).unionByName(cop.select(columns))


@query(
    "semantic_edges",
    f"""WITH {VALID}, x AS (SELECT *, abs(epoch_us(v_ts) - epoch_us(u_ts)) / 1e6 AS lat, CASE WHEN u_ts < v_ts THEN 'u' WHEN u_ts > v_ts THEN 'v' ELSE 'tie' END AS vote FROM both_layers)
    SELECT u, v, count(*) FILTER (WHERE layer = 'semantic') AS n_semantic, count(*) FILTER (WHERE layer = 'copy') AS n_copy, count(*) FILTER (WHERE layer = 'semantic' AND vote = 'u') AS n_u_first, count(*) FILTER (WHERE layer = 'semantic' AND vote = 'v') AS n_v_first, count(*) FILTER (WHERE layer = 'semantic' AND vote = 'tie') AS n_tie,
    round(avg(sim) FILTER (WHERE layer = 'semantic'), 4) AS mean_sim, round(max(sim) FILTER (WHERE layer = 'semantic'), 4) AS max_sim, round(avg(lat) FILTER (WHERE layer = 'semantic'), 1) AS mean_latency_s, bool_or(is_cross) AS is_cross,
    count(*) FILTER (WHERE layer = 'copy' AND vote = 'u') AS n_u_first_copy, count(*) FILTER (WHERE layer = 'copy' AND vote = 'v') AS n_v_first_copy, count(*) FILTER (WHERE layer = 'copy' AND vote = 'tie') AS n_tie_copy, round(avg(lat) FILTER (WHERE layer = 'copy'), 1) AS mean_latency_copy, any_value(a.cls) AS u_cls, any_value(b.cls) AS v_cls
    FROM x JOIN nodes a ON a.handle = u JOIN nodes b ON b.handle = v GROUP BY u, v""",
)
def semantic_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors to similar texts, to representatives, members, thresholds and declared pairs, to edges of
    both layers with the classes of their ends."""
    return match.freeze(match.edge_table(_validated(spark, sf)), _nodes(spark))


@query("declared_drops", f"WITH {VALID} SELECT (SELECT count(*) FROM ok) AS n_before, (SELECT count(*) FROM kept) AS n_kept, (SELECT count(*) FROM ok) - (SELECT count(*) FROM kept) AS n_dropped")
def declared_drops(spark: SparkSession, sf: str) -> DataFrame:
    bars = {"same": 0.4, "cross": 0.35, "unknown": 0.45}
    nodes = _nodes(spark)
    ok = match.validate(_semantic_pairs(spark, sf), nodes, nodes, None, **bars).withColumnsRenamed({f"{x}{s}": f"{y}{s}" for x, y in (("u", "a"), ("v", "b")) for s in ("", "_msg_id", "_ts")})
    return match.declared_drops(ok, _said(spark, sf))


@query("sample_accuracy", "WITH s AS (SELECT l_shipmode_ AS sample, l_linenumber AS threshold, CASE WHEN l_quantity > 25 THEN 'yes' ELSE 'no' END AS verdict FROM (SELECT l_returnflag AS l_shipmode_, l_linenumber, l_quantity FROM lineitem)) SELECT sample, threshold, count(*) AS n, count(*) FILTER (WHERE verdict = 'yes') AS n_yes, round(count(*) FILTER (WHERE verdict = 'yes') / count(*), 6) AS accuracy FROM s GROUP BY ALL")
def sample_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sample"), F.col("l_linenumber").alias("threshold"), F.when(F.col("l_quantity") > 25, "yes").otherwise("no").alias("verdict"))
    return match.sample_accuracy(rows).withColumn("accuracy", F.round("accuracy", 6))


# Graph and layer operators.


@query("isolates", f"WITH {V.GRAPH} SELECT DISTINCT user_id AS id FROM events WHERE user_id NOT IN (SELECT id FROM gv)")
def isolates(spark: SparkSession, sf: str) -> DataFrame:
    every = read_table(spark, sf, "events").select(F.col("user_id").alias("id")).distinct()
    return Graph.from_edges(V.forward_graph(spark, sf).edges, every).isolates()


@query("without_vertices", f"WITH {V.GRAPH}, k AS (SELECT * FROM ge WHERE src % 5 <> 0 AND dst % 5 <> 0) SELECT (SELECT count(*) FROM gv WHERE id % 5 <> 0) AS n, count(*) AS m FROM k")
def without_vertices(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    return g.without(g.vertices.filter("id % 5 = 0")).density().select("n", "m")


@query("shared_neighbours", f"WITH {V.LAG}, two AS (SELECT origin AS a, target AS b FROM lagged WHERE origin <> target UNION SELECT target, origin FROM lagged WHERE origin <> target) SELECT x.b AS dst FROM two x JOIN two y ON x.b = y.b WHERE x.a = 1 AND y.a = 2")
def shared_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    e = V.lag_edges(spark, sf).select(F.col("origin").alias("src"), F.col("target").alias("dst"))
    return graph.shared_neighbours(e, 1, 2)


@query("cut_test", f"WITH RECURSIVE {V.GRAPH}, {V.CLASSES}, mine AS (SELECT id FROM cls WHERE cls = 'view'), inner_ AS (SELECT src, dst FROM both_ways WHERE src IN (FROM mine) AND dst IN (FROM mine)), walk(s, t) AS (SELECT id, id FROM mine UNION SELECT walk.s, i.dst FROM walk JOIN inner_ i ON walk.t = i.src), c AS (SELECT s, min(t) AS component FROM walk GROUP BY s), z AS (SELECT component, count(*) AS size FROM c GROUP BY component) SELECT size, count(*) AS n FROM z GROUP BY size")
def cut_test(spark: SparkSession, sf: str) -> DataFrame:
    return graph.cut_test(V.forward_graph(spark, sf).edges, V.classes(spark, sf), "view")


_DECLARED = "dec AS (SELECT DISTINCT least(origin, target) AS u, greatest(origin, target) AS v FROM lagged2)"
_LAG2 = f"{V.EDGES}, lagged2 AS (SELECT origin, target FROM (SELECT lag(channel) OVER (PARTITION BY key ORDER BY ts, msg_id) AS origin, channel AS target FROM posts) WHERE origin IS NOT NULL GROUP BY ALL HAVING count(*) >= 2), {_DECLARED}"


def _declared(spark: SparkSession, sf: str) -> DataFrame:
    return V.lag_edges(spark, sf).filter("count >= 2").select(F.col("origin").alias("src"), F.col("target").alias("dst"))


@query("either_direction", f"WITH {_LAG2} SELECT u, v, dec.u IS NOT NULL AS linked FROM edges LEFT JOIN dec USING (u, v)".replace("dec.u IS NOT NULL", "(u, v) IN (SELECT (u, v) FROM dec)").replace("LEFT JOIN dec USING (u, v)", ""))
def either_direction(spark: SparkSession, sf: str) -> DataFrame:
    return layers.either_direction(_declared(spark, sf), V.copy_edges(spark, sf).select("u", "v"))


@query("cross_not_declared", f"WITH {_LAG2}, x AS (SELECT (u, v) IN (SELECT (u, v) FROM dec) AS d FROM edges WHERE is_cross) SELECT count(*) AS n_pairs, count(*) FILTER (WHERE d) AS n_declared, round(count(*) FILTER (WHERE d) / count(*), 6) AS share, round(1 - round(count(*) FILTER (WHERE d) / count(*), 6), 6) AS not_declared FROM x")
def cross_not_declared(spark: SparkSession, sf: str) -> DataFrame:
    return layers.cross_not_declared(V.copy_edges(spark, sf), _declared(spark, sf))


@query(
    "pivot_shares",
    f"""WITH {V.PAIRS}, e AS (SELECT u, v, f AS floor_s, count(*) FILTER (WHERE vote = 'u') AS nu, count(*) FILTER (WHERE vote = 'v') AS nv FROM pairs, (SELECT unnest([0, 300, 3600, 21600, 86400]) AS f) WHERE vote <> 'tie' AND lat >= f GROUP BY ALL), p AS (SELECT k, floor_s, count(*) AS n_edges, count(*) FILTER (WHERE nu = 0 OR nv = 0) AS n_unanimous FROM e, (SELECT unnest([1, 2, 3, 4, 5, 7, 10]) AS k) WHERE nu + nv >= k GROUP BY ALL) SELECT *, round(1 - n_unanimous / n_edges, 6) AS both_share FROM p""",
)
def pivot_shares(spark: SparkSession, sf: str) -> DataFrame:
    return layers.pivot_shares(match.direction_pivot(V.copy_pairs(spark, sf)))


@query("provenance", "SELECT count(*) AS n_rows, count(*) FILTER (WHERE c_acctbal > 5000) AS n_shown FROM customer")
def provenance(spark: SparkSession, sf: str) -> DataFrame:
    return layers.provenance(read_table(spark, sf, "customer"), F.col("c_acctbal") > 5000)


_BARS = [1, 2, 3]


@query(
    "bar_structure",
    f"""WITH RECURSIVE {V.EDGES}, x AS (SELECT bar, u, v FROM edges, (SELECT unnest([1, 2, 3]) AS bar) WHERE n_copy >= bar), w AS (SELECT bar, u AS s, v AS t FROM x UNION SELECT bar, v, u FROM x),
    walk(bar, s, t) AS (SELECT bar, s, t FROM w UNION SELECT walk.bar, walk.s, w.t FROM walk JOIN w ON w.bar = walk.bar AND walk.t = w.s), c AS (SELECT bar, s, least(s, min(t)) AS component FROM walk GROUP BY bar, s), g AS (SELECT bar, max(n) AS giant FROM (SELECT bar, component, count(*) AS n FROM c GROUP BY ALL) GROUP BY bar),
    d AS (SELECT bar, s AS id, count(*) AS d FROM w GROUP BY ALL), k AS (SELECT bar, count(*) AS n, sum(d * (d - 1) // 2) AS wedges FROM d GROUP BY bar), m AS (SELECT bar, count(*) AS m FROM x GROUP BY bar), t AS (SELECT a.bar, count(*) AS t FROM x a JOIN x b ON a.bar = b.bar AND a.v = b.u JOIN x e ON e.bar = a.bar AND e.u = a.u AND e.v = b.v GROUP BY a.bar),
    r AS (SELECT w.bar, round(corr(a.d, b.d), 6) AS assortativity FROM w JOIN d a ON a.bar = w.bar AND a.id = w.s JOIN d b ON b.bar = w.bar AND b.id = w.t GROUP BY w.bar)
    SELECT bar, n, m, round(2 * m / (n * (n - 1)), 8) AS density, giant, round(coalesce(3 * coalesce(t, 0) / wedges, 0), 6) AS transitivity, assortativity FROM k JOIN m USING (bar) JOIN g USING (bar) LEFT JOIN t USING (bar) JOIN r USING (bar)""",
)
def bar_structure(spark: SparkSession, sf: str) -> DataFrame:
    return layers.bar_structure(V.copy_edges(spark, sf), _BARS, "n_copy")


@query("hub_overlap", f"WITH {V.GRAPH}, t AS (SELECT id, unnest(['n_in', 'n_out', 'degree']) AS k, unnest([row_number() OVER (ORDER BY n_in DESC, id), row_number() OVER (ORDER BY n_out DESC, id), row_number() OVER (ORDER BY degree DESC, id)]) AS r FROM roles), h AS (SELECT id, k FROM t WHERE r <= 10), n AS (SELECT k, count(*) AS n FROM h GROUP BY k), o AS (SELECT p.k AS a, q.k AS b, count(*) AS n_both FROM h p JOIN h q USING (id) WHERE p.k < q.k GROUP BY ALL) SELECT x.k AS a, y.k AS b, coalesce(n_both, 0) AS n_both, round(coalesce(n_both, 0) / (x.n + y.n - coalesce(n_both, 0)), 6) AS jaccard FROM n x JOIN n y ON x.k < y.k LEFT JOIN o ON o.a = x.k AND o.b = y.k")
def hub_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return graph.hub_overlap(V.forward_graph(spark, sf).degrees())


@query("boundary_by_class", f"WITH {V.MEMBERS}, b AS (SELECT CASE WHEN b.community = 1 THEN 'import' ELSE 'export' END AS direction, CASE WHEN b.community = 1 THEN src ELSE dst END AS id FROM ge JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE (a.community = 1) <> (b.community = 1)) SELECT direction, coalesce(cls, 'unknown') AS cls, count(*) AS n FROM b LEFT JOIN cls USING (id) GROUP BY ALL")
def boundary_by_class(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    return graph.boundary_by_class(g.edges, g.vertices.withColumn("community", F.col("id") % 7), 1, V.classes(spark, sf))


@query("schedule_offset_p", f"WITH {V.GRAPH}, h AS (SELECT channel, hour(ts) AS h, count(*) AS c FROM posts GROUP BY ALL), m AS (SELECT channel, arg_min(h, (-c, h)) AS h FROM h GROUP BY channel), d AS (SELECT (b.h - a.h + 12 + 24) % 24 - 12 AS d FROM ge JOIN m a ON a.channel = src JOIN m b ON b.channel = dst), o AS (SELECT count(*) FILTER (WHERE d > 0) AS n_earlier, count(*) FILTER (WHERE d < 0) AS n_later, count(*) FILTER (WHERE d = 0) AS n_tie FROM d), i AS (SELECT i, lgamma(n_earlier + n_later + 1) - lgamma(i + 1) - lgamma(n_earlier + n_later - i + 1) + (n_earlier + n_later) * ln(0.5) AS l FROM o, range(0, 10001) t(i) WHERE i <= n_earlier + n_later) SELECT n_earlier, n_later, n_tie, (SELECT round(sum(exp(l)), 5) FROM i WHERE l <= (SELECT l FROM i WHERE i = n_earlier) + 1e-7) AS p FROM o")
def schedule_offset_p(spark: SparkSession, sf: str) -> DataFrame:
    counts = layers.schedule_offset(V.forward_graph(spark, sf).edges, extract.hour_histogram(V.posts(spark, sf)))
    return layers.schedule_offset_p(counts).withColumn("p", F.round("p", 5))


@query("outside_share", f"WITH {BFS}, f AS (SELECT CASE WHEN sid < 50 THEN 'chan_' || sid ELSE 'id:' || sid END AS origin, channel AS target FROM msgs WHERE is_fwd GROUP BY ALL) SELECT depth::INT AS depth, count(*) AS n_edges, count(*) FILTER (WHERE origin NOT IN (SELECT handle FROM b)) AS n_outside, round(count(*) FILTER (WHERE origin NOT IN (SELECT handle FROM b)) / count(*), 6) AS share FROM f JOIN b ON b.handle = target GROUP BY depth")
def outside_share(spark: SparkSession, sf: str) -> DataFrame:
    e = extract.forward_edges(messages(spark, sf), _id_map(spark)).select(F.col("origin").alias("src"), F.col("target").alias("dst"))
    return layers.outside_share(e, _members(spark, sf).select(F.col("handle").alias("id"), "depth"))


@query("availability_chi2", f"WITH {V.MEMBERS}, i AS (SELECT cls, count(*) AS o FROM ge JOIN cls ON cls.id = src WHERE dst % 7 = 1 AND src % 7 <> 1 GROUP BY cls), n AS (SELECT cls, count(*) AS n FROM gv JOIN cls USING (id) GROUP BY cls), x AS (SELECT n.cls, coalesce(o, 0) AS o, n / (SELECT sum(n) FROM n) * (SELECT sum(o) FROM i) AS e FROM n LEFT JOIN i USING (cls)) SELECT round(sum((o - e) ** 2 / e), 6) AS chi2, count(*) - 1 AS df FROM x")
def availability_chi2(spark: SparkSession, sf: str) -> DataFrame:
    g, cls = V.forward_graph(spark, sf), V.classes(spark, sf)
    imports = g.edges.filter("dst % 7 = 1 and src % 7 <> 1").select(F.col("src").alias("id")).join(cls, "id")
    ratio = layers.availability(imports, g.vertices.join(cls, "id"))
    total = ratio.agg(F.sum("n_imports").alias("i"), F.sum("n_nodes").alias("t"))
    expected = F.col("n_nodes") / F.col("t") * F.nullif("i", F.lit(0))  # without imports there is nothing to expect
    got = stats.chi2_gof(ratio.join(F.broadcast(total), F.lit(True)).withColumn("e", expected), "n_imports", "e")
    return spark.createDataFrame([(None if got["chi2"] is None else round(got["chi2"], 6), got["df"])], "chi2 double, df long")


# Communities and null models: what must hold of them, as their labels and draws are this library's own.


@query("communities", f"WITH {V.GRAPH} SELECT (SELECT count(*) FROM gv) AS n_vertices, (SELECT count(*) FROM gv) AS n_members, true AS connected, true AS beats_classes")
def communities(spark: SparkSession, sf: str) -> DataFrame:
    """Every vertex in one community, each community connected, modularity no lower than that of the classes,
    which may be the best there is. A graph without edges has no modularity and nothing to beat."""
    g = V.forward_graph(spark, sf)
    g = Graph(materialise(g.vertices, "communities"), materialise(g.edges, "communities"))
    m = graph.leiden(g.edges)
    inside = g.edges.join(m.toDF("src", "cs"), "src").join(m.toDF("dst", "cd"), "dst").filter("cs = cd").select("src", "dst")
    parts = Graph.from_edges(inside, g.vertices).wcc()
    n_parts, n = parts.select("component").distinct().count(), m.select("community").distinct().count()
    cls = V.classes(spark, sf).join(g.vertices, "id", "left_semi")
    own, given = (graph.modularity(g.edges, x).first()[0] for x in (m, cls.select("id", F.col("cls").alias("community"))))
    return spark.createDataFrame([(g.vertices.count(), m.select("id").distinct().count(), n_parts == n, own is None or own >= given)], "n_vertices long, n_members long, connected boolean, beats_classes boolean")


@query("community_profile", f"WITH {V.GRAPH} SELECT (SELECT count(*) FROM gv) AS size, (SELECT count(*) FROM und) AS edges, 2 * (SELECT count(*) FROM und) AS volume, true AS whole")
def community_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Conductance table, meta graph and landing census of the communities add up to the graph, an empty one
    included."""
    g = V.forward_graph(spark, sf)
    g = Graph(materialise(g.vertices, "profile"), materialise(g.edges, "profile"))
    m = graph.leiden(g.edges)
    meta = graph.meta_graph(g.edges, m).agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    landed = graph.landing_census(m, V.classes(spark, sf)).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    summed = {"size": "size", "internal": "i", "boundary": "b", "volume": "volume"}
    total = graph.community_profile(g.edges, m).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in summed.items()])
    return total.select("size", (F.col("i") + F.col("b") / 2).cast("long").alias("edges"), "volume", ((F.col("b") == 2 * meta) & (F.col("size") == landed)).alias("whole"))


@query("configuration_null", f"WITH {V.GRAPH} SELECT rep, src AS id, count(*) AS degree FROM both_ways, range(3) t(rep) GROUP BY ALL")
def configuration_null(spark: SparkSession, sf: str) -> DataFrame:
    """Degrees of three rewirings."""
    e = graph.configuration_nulls(V.forward_graph(spark, sf).edges, 3)
    return e.select("rep", F.col("u").alias("id")).unionByName(e.select("rep", F.col("v").alias("id"))).groupBy(F.col("rep").cast("long").alias("rep"), "id").agg(F.count("*").alias("degree"))


@query("subsample_null", f"WITH {V.GRAPH} SELECT least(50, (SELECT count(*) FROM und)) AS n_edges, least(50, (SELECT count(*) FROM und)) AS n_known")
def subsample_null(spark: SparkSession, sf: str) -> DataFrame:
    """The sparsity null: as many edges as asked for, all of the graph's."""
    edges = V.forward_graph(spark, sf).edges
    e = graph.subsample_edges(edges, 50, 7)
    known = e.join(graph.collapse(edges), ["u", "v"], "left_semi").distinct().agg(F.count("*").alias("n_known"))
    return e.agg(F.count("*").alias("n_edges")).join(F.broadcast(known), F.lit(True))


@query("null_same_class", f"WITH {V.GRAPH} SELECT 20 AS reps, true AS near_expected, true AS has_spread")
def null_same_class(spark: SparkSession, sf: str) -> DataFrame:
    """Edges within a class over rewirings lie around the closed form's mean, by its variance. They differ
    from one another, unless that variance is so small that all draws may well be the same."""
    edges, cls = materialise(V.forward_graph(spark, sf).edges, "null-edges"), V.classes(spark, sf)
    null = graph.null_same_class(edges, cls, 20)
    expected, variance = graph.same_class_moments(edges, cls)
    got = stats.z_against_null(expected, null, "value")
    near = abs(got["mean"] - expected) <= 4 * (variance / got["reps"]) ** 0.5 + 1e-9
    return spark.createDataFrame([(got["reps"], near, got["sd"] > 0 or variance * got["reps"] < 10)], "reps long, near_expected boolean, has_spread boolean")


@query("null_transitivity", f"WITH {V.GRAPH} SELECT 5 AS reps, true AS in_range")
def null_transitivity(spark: SparkSession, sf: str) -> DataFrame:
    got = graph.null_transitivity(V.forward_graph(spark, sf).edges, 5)
    return got.agg(F.count("*").alias("reps"), F.min(F.col("value").between(0, 1)).alias("in_range"))


@query("partition_agreement", "SELECT true AS itself, true AS apart")
def partition_agreement(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    m = graph.leiden(g.edges)
    same, other = graph.partition_agreement(m, m), graph.partition_agreement(m, g.vertices.withColumn("community", F.col("id") % 7))
    return spark.createDataFrame([(abs(same["ari"] - 1) < 1e-9 and abs(same["ami"] - 1) < 1e-9, other["ari"] < 0.5)], "itself boolean, apart boolean")


# Tests and p-values.

_P = "p AS (SELECT n_name AS test, (n_nationkey * 7 % 25 + 1) / 100.0::DOUBLE AS p FROM nation)"


@query("holm", f"WITH {_P}, s AS (SELECT test, p, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1)) AS x, row_number() OVER (ORDER BY p, test) AS r FROM p) SELECT test, round(max(x) OVER (ORDER BY r), 6) AS p_holm FROM s")
def holm(spark: SparkSession, sf: str) -> DataFrame:
    t = read_table(spark, sf, "nation").select(F.col("n_name").alias("test"), ((F.col("n_nationkey") * 7 % 25 + 1) / F.lit(100.0)).alias("p"))
    return stats.holm(t).select("test", F.round("p_holm", 6).alias("p_holm"))


@query("chi2_gof", "WITH g AS (SELECT c_mktsegment, count(*) AS o, (SELECT count(*) FROM customer) / 5 AS e FROM customer GROUP BY 1) SELECT round(sum((o - e) ** 2 / e), 6) AS chi2, count(*) - 1 AS df, round(exp(-sum((o - e) ** 2 / e) / 2) * (1 + sum((o - e) ** 2 / e) / 2), 6) AS p FROM g")
def chi2_gof(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    e = c.groupBy("c_mktsegment").agg(F.count("*").alias("o")).join(F.broadcast(c.agg((F.count("*") / 5).alias("e"))), F.lit(True))
    got = stats.chi2_gof(e, "o", "e")
    return spark.createDataFrame([(round(got["chi2"], 6), got["df"], round(got["p"], 6))], "chi2 double, df long, p double")


@query("binomial_test", "WITH c AS (SELECT count(*) FILTER (WHERE r_regionkey IN (0, 1)) AS k, count(*) AS n FROM (SELECT n_regionkey AS r_regionkey FROM nation)), i AS (SELECT k, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + n * ln(0.5) AS l FROM c, range(0, 26) t(i) WHERE i <= n) SELECT k, n, round(sum(exp(l)) FILTER (WHERE l <= cut + 1e-7), 6) AS p FROM i, (SELECT l AS cut FROM i WHERE i = k) GROUP BY k, n")
def binomial_test(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "nation").agg(F.count_if(F.col("n_regionkey").isin(0, 1)).alias("k"), F.count("*").alias("n")).first()
    return spark.createDataFrame([(r.k, r.n, round(stats.binom_test(r.k, r.n), 6))], "k long, n long, p double")


@query("mcnemar", "WITH c AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 0) AS b, count(*) FILTER (WHERE quality = 0 AND toxic = 1) AS c FROM labels) SELECT b, c, round(greatest(0, abs(b - c) - 1) ** 2 / (b + c), 6) AS chi2 FROM c")
def mcnemar(spark: SparkSession, sf: str) -> DataFrame:
    r = read_table(spark, sf, "labels").agg(F.count_if(F.expr("quality = 1 and toxic = 0")).alias("b"), F.count_if(F.expr("quality = 0 and toxic = 1")).alias("c")).first()
    return spark.createDataFrame([(r.b, r.c, round(stats.mcnemar(r.b, r.c)["chi2"], 6))], "b long, c long, chi2 double")


@query("z_against_null", "SELECT round(avg(c_acctbal), 4) AS mean, round(stddev_pop(c_acctbal), 4) AS sd, round((9000 - avg(c_acctbal)) / stddev_pop(c_acctbal), 6) AS z, count(*) AS reps FROM customer")
def z_against_null(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.z_against_null(9000.0, read_table(spark, sf, "customer"), "c_acctbal")
    return spark.createDataFrame([(round(got["mean"], 4), round(got["sd"], 4), round(got["z"], 6), got["reps"])], "mean double, sd double, z double, reps long")
