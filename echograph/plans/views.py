"""Archive views over the star-schema tables, in Spark and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.operators import extract, match
from echograph.operators.graph import Graph
from echograph.session import read_table

#: An edge of the forward graph needs this many hand-overs.
MIN_COUNT = 3


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """Events as posts: the user is the channel, type and payload are the text key."""
    e = read_table(spark, sf, "events")
    return e.select(F.col("user_id").alias("channel"), F.col("event_id").alias("msg_id"), "ts", F.concat("event_type", F.lit(":"), F.get_json_object("props", "$.k")).alias("key"))


def classes(spark: SparkSession, sf: str) -> DataFrame:
    """(id, cls): a user's modal event type, ties alphabetical."""
    n = read_table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy(F.col("user_id").alias("id")).agg(F.min_by("event_type", F.struct(-F.col("n"), "event_type")).alias("cls"))


def lag_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(origin, target, count): who posted a key just before whom."""
    w = Window.partitionBy("key").orderBy("ts", "msg_id")
    e = posts(spark, sf).select(F.lag("channel").over(w).alias("origin"), F.col("channel").alias("target"))
    return e.filter("origin is not null").groupBy("origin", "target").agg(F.count("*").alias("count"))


def forward_graph(spark: SparkSession, sf: str) -> Graph:
    e = lag_edges(spark, sf).filter(F.col("count") >= MIN_COUNT)
    return Graph.from_edges(e.select(F.col("origin").alias("src"), F.col("target").alias("dst")))


def copy_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Oriented star pairs with their class: same, cross."""
    c = classes(spark, sf)
    p = match.orient(match.star_pairs(posts(spark, sf)))
    p = p.join(c.toDF("u", "cu"), "u").join(c.toDF("v", "cv"), "v")
    return p.withColumn("is_cross", F.col("cu") != F.col("cv")).withColumn("cls", F.when(F.col("is_cross"), "cross").otherwise("same")).withColumn("layer", F.lit("copy"))


def copy_edges(spark: SparkSession, sf: str) -> DataFrame:
    return match.edge_table(copy_pairs(spark, sf))


def docs(spark: SparkSession, sf: str) -> DataFrame:
    d = read_table(spark, sf, "documents")
    return d.select(F.col("source").alias("channel"), F.col("doc_id").alias("msg_id"), "text", F.col("lang").alias("cls"))


def doc_terms(spark: SparkSession, sf: str) -> DataFrame:
    """(id, community, term, n): top terms of each source and language; the language is the community."""
    d = docs(spark, sf).withColumn("channel", F.concat("channel", F.lit("/"), "cls"))
    terms, _ = extract.channel_terms(d, top=120)
    return terms.select(F.col("channel").alias("id"), F.element_at(F.split("channel", "/"), -1).alias("community"), "term", "n")


def nation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """(src, dst, n): supplier nation to customer nation over order lines."""
    li, o = read_table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey"), read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("dst"))
    s = read_table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("src"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return j.groupBy("src", "dst").agg(F.count("*").alias("n"))


# DuckDB common table expressions of the same views.
POSTS = "posts AS (SELECT user_id AS channel, event_id AS msg_id, ts, event_type || ':' || json_extract_string(props, '$.k') AS key FROM events)"
CLASSES = "cls AS (SELECT user_id AS id, arg_min(event_type, (-n, event_type)) AS cls FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) GROUP BY user_id)"
STAR = f"""{POSTS},
firsts AS (SELECT key, channel, ts, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY key, channel ORDER BY ts, msg_id) AS r FROM posts) WHERE r = 1),
origins AS (SELECT key, channel, ts, msg_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, channel, msg_id) AS r FROM firsts) WHERE r = 1),
star AS (SELECT f.key, o.channel AS a, o.msg_id AS a_msg_id, o.ts AS a_ts, f.channel AS b, f.msg_id AS b_msg_id, f.ts AS b_ts FROM firsts f JOIN origins o USING (key) WHERE f.channel <> o.channel)"""
PAIRS = f"""{STAR}, {CLASSES},
pairs AS (SELECT u, v, u_ts, v_ts, abs(epoch_us(v_ts) - epoch_us(u_ts)) / 1e6 AS lat, CASE WHEN u_ts < v_ts THEN 'u' WHEN u_ts > v_ts THEN 'v' ELSE 'tie' END AS vote, cu.cls <> cv.cls AS is_cross, CASE WHEN cu.cls <> cv.cls THEN 'cross' ELSE 'same' END AS cls
  FROM (SELECT least(a, b) AS u, greatest(a, b) AS v, CASE WHEN a < b THEN a_ts ELSE b_ts END AS u_ts, CASE WHEN a < b THEN b_ts ELSE a_ts END AS v_ts FROM star) x JOIN cls cu ON cu.id = u JOIN cls cv ON cv.id = v)"""
EDGES = f"""{PAIRS},
edges AS (SELECT u, v, count(*) AS n_copy, count(*) FILTER (WHERE vote = 'u') AS nu, count(*) FILTER (WHERE vote = 'v') AS nv, count(*) FILTER (WHERE vote = 'tie') AS nt, avg(lat) AS lat, bool_or(is_cross) AS is_cross FROM pairs GROUP BY u, v)"""
LAG = f"""{POSTS},
lagged AS (SELECT origin, target, count(*) AS count FROM (SELECT lag(channel) OVER (PARTITION BY key ORDER BY ts, msg_id) AS origin, channel AS target FROM posts) WHERE origin IS NOT NULL GROUP BY ALL)"""
GRAPH = f"""{LAG},
ge AS (SELECT DISTINCT origin AS src, target AS dst FROM lagged WHERE count >= {MIN_COUNT} AND origin <> target),
gv AS (SELECT src AS id FROM ge UNION SELECT dst FROM ge),
deg AS (SELECT id, (SELECT count(*) FROM ge WHERE dst = id) AS n_in, (SELECT count(*) FROM ge WHERE src = id) AS n_out FROM gv),
roles AS (SELECT *, n_in + n_out AS degree, CASE WHEN n_in = 0 THEN 'source' WHEN n_out = 0 THEN 'spreader' ELSE 'dual' END AS role FROM deg),
und AS (SELECT DISTINCT least(src, dst) AS u, greatest(src, dst) AS v FROM ge),
both_ways AS (SELECT u AS src, v AS dst FROM und UNION ALL SELECT v, u FROM und)"""
REACH = f"""{GRAPH},
reach(s, t) AS (SELECT src, dst FROM ge UNION SELECT reach.s, ge.dst FROM reach JOIN ge ON reach.t = ge.src),
scc AS (SELECT id, least(id, coalesce((SELECT min(a.t) FROM reach a JOIN reach b ON a.s = b.t AND a.t = b.s WHERE a.s = id), id)) AS scc FROM gv),
top AS (SELECT scc FROM scc GROUP BY scc HAVING count(*) > 1 ORDER BY count(*) DESC, scc LIMIT 1),
core AS (SELECT id, scc IN (SELECT scc FROM top) AS in_core FROM scc)"""
PATHS = f"""{GRAPH},
paths(s, t, d) AS (SELECT src, dst, 1 FROM ge UNION SELECT paths.s, ge.dst, d + 1 FROM paths JOIN ge ON paths.t = ge.src WHERE d < 40 AND paths.s <> ge.dst),
dist AS (SELECT s, t, min(d) AS d FROM paths WHERE s <> t GROUP BY s, t)"""
WCC = f"""{GRAPH},
walk(s, t) AS (SELECT src, dst FROM both_ways UNION SELECT walk.s, b.dst FROM walk JOIN both_ways b ON walk.t = b.src),
wcc AS (SELECT s AS id, least(s, min(t)) AS component FROM walk GROUP BY s)"""
MEMBERS = f"{GRAPH}, mem AS (SELECT id, id % 7 AS community FROM gv), {CLASSES}"
DOCS = "docs AS (SELECT source AS channel, doc_id AS msg_id, text, lang AS cls, lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'))) AS norm FROM documents)"
