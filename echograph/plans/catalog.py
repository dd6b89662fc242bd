"""Registry of the engine's own queries and their DuckDB equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.functions import stats
from echograph.functions import text as T
from echograph.operators import extract, graph, layers, match, topics
from echograph.plans import views as V
from echograph.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def longs(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in cols})


# Exact reuse over the event archive.


@query("copy_star_pairs", f"WITH {V.STAR} SELECT key, a, a_msg_id, b, b_msg_id FROM star")
def copy_star_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return match.star_pairs(V.posts(spark, sf)).select("key", "a", "a_msg_id", "b", "b_msg_id")


@query("copy_edges", f"WITH {V.EDGES} SELECT u, v, n_copy, nu AS n_u_first, nv AS n_v_first, nt AS n_tie, round(lat, 1) AS mean_latency_s, is_cross, nu > 0 AND nv > 0 AS reciprocal FROM edges")
def copy_edges(spark: SparkSession, sf: str) -> DataFrame:
    e = V.copy_edges(spark, sf)
    return e.select("u", "v", "n_copy", F.col("n_u_first_copy").alias("n_u_first"), F.col("n_v_first_copy").alias("n_v_first"), F.col("n_tie_copy").alias("n_tie"), F.col("mean_latency_copy").alias("mean_latency_s"), "is_cross", ((F.col("n_u_first_copy") > 0) & (F.col("n_v_first_copy") > 0)).alias("reciprocal"))


@query("directed_copy_edges", f"WITH {V.STAR} SELECT a AS src, b AS dst, count(*) AS n_texts FROM star GROUP BY ALL")
def directed_copy_edges(spark: SparkSession, sf: str) -> DataFrame:
    return match.directed_copy_edges(V.posts(spark, sf)).select("src", "dst", "n_texts")


@query("copy_directed_latency", f"WITH {V.STAR} SELECT a AS src, b AS dst, count(*) AS n_texts, round(median(abs(epoch_us(b_ts) - epoch_us(a_ts)) / 1e6), 3) AS median_latency_s FROM star GROUP BY ALL")
def copy_directed_latency(spark: SparkSession, sf: str) -> DataFrame:
    return match.directed_edges(match.star_pairs(V.posts(spark, sf))).select("src", "dst", "n_texts", F.round("median_latency_s", 3).alias("median_latency_s"))


@query("build_summary", f"WITH {V.EDGES} SELECT count(*) AS n_edges, sum(n_copy)::BIGINT AS n_copy, count(*) FILTER (WHERE nu > 0 AND nv > 0) AS n_reciprocal, count(*) FILTER (WHERE is_cross) AS n_cross FROM edges")
def build_summary(spark: SparkSession, sf: str) -> DataFrame:
    e = V.copy_edges(spark, sf).withColumn("reciprocal", (F.col("n_u_first_copy") > 0) & (F.col("n_v_first_copy") > 0))
    return match.build_summary(e).select("n_edges", "n_copy", "n_reciprocal", "n_cross")


_SPLIT = "count(*) AS n_edges, count(*) FILTER (WHERE nu = 0 OR nv = 0) AS n_one_way, count(*) FILTER (WHERE nu > 0 AND nv > 0) AS n_both, round(count(*) FILTER (WHERE nu > 0 AND nv > 0) / count(*), 6) AS both_share"


@query("copy_direction_by_k", f"WITH {V.EDGES} SELECT k::INT AS k, {_SPLIT} FROM edges, range(1, 11) t(k) WHERE nu + nv >= k GROUP BY k")
def copy_direction_by_k(spark: SparkSession, sf: str) -> DataFrame:
    return layers.direction_by_k(V.copy_edges(spark, sf), 10, "_copy")


@query(
    "copy_direction_pivot",
    f"""WITH {V.PAIRS}, e AS (SELECT cls, u, v, f AS floor_s, count(*) FILTER (WHERE vote = 'u') AS nu, count(*) FILTER (WHERE vote = 'v') AS nv FROM pairs, (SELECT unnest([0, 300, 3600, 21600, 86400]) AS f) WHERE vote <> 'tie' AND lat >= f GROUP BY ALL)
    SELECT cls, k, floor_s, count(*) AS n_edges, count(*) FILTER (WHERE nu = 0 OR nv = 0) AS n_unanimous FROM e, (SELECT unnest([1, 2, 3, 4, 5, 7, 10]) AS k) WHERE nu + nv >= k GROUP BY ALL""",
)
def copy_direction_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return match.direction_pivot(V.copy_pairs(spark, sf), by=["cls"])


@query(
    "copy_fair_coin",
    f"""WITH {V.EDGES}, x AS (SELECT k, nu, nv, pow(0.5, nu + nv - 1) AS p FROM edges, (SELECT unnest([1, 2, 3, 5]) AS k) WHERE nu + nv >= k),
    y AS (SELECT k, count(*) AS base, count(*) FILTER (WHERE nu = 0 OR nv = 0) AS observed, sum(p) AS ex, sum(p * (1 - p)) AS va FROM x GROUP BY k)
    SELECT k, base, observed, round(ex, 6) AS expected, round(observed - ex, 6) AS excess, round(CASE WHEN observed <> 0 THEN ex / observed END, 6) AS contamination, round(CASE WHEN va <> 0 THEN (observed - ex) / sqrt(va) END, 6) AS z FROM y""",
)
def copy_fair_coin(spark: SparkSession, sf: str) -> DataFrame:
    return layers.fair_coin(V.copy_edges(spark, sf), [1, 2, 3, 5], "_copy")


@query(
    "latency_hist",
    f"""WITH {V.PAIRS} SELECT cls, count(*) FILTER (WHERE lat < 300) AS lt_5min, count(*) FILTER (WHERE lat >= 300 AND lat < 3600) AS lt_1h, count(*) FILTER (WHERE lat >= 3600 AND lat < 86400) AS lt_1d, count(*) FILTER (WHERE lat >= 86400 AND lat < 604800) AS lt_7d, count(*) FILTER (WHERE lat >= 604800) AS ge_7d, count(*) AS n_pairs,
    round(list_sort(list(lat))[(count(*) // 2 + 1)::BIGINT], 1) AS median_s FROM pairs GROUP BY cls""",
)
def latency_hist(spark: SparkSession, sf: str) -> DataFrame:
    return match.latency_histogram(V.copy_pairs(spark, sf)).toDF("cls", "lt_5min", "lt_1h", "lt_1d", "lt_7d", "ge_7d", "n_pairs", "median_s")


@query("latency_umed", f"WITH {V.PAIRS} SELECT cls, list_sort(list(lat))[(count(*) // 2 + 1)::BIGINT] AS upper_median FROM pairs GROUP BY cls")
def latency_umed(spark: SparkSession, sf: str) -> DataFrame:
    return stats.upper_median_by_rank(V.copy_pairs(spark, sf), ["cls"], "latency_s")


@query(
    "latency_by_bar",
    f"""WITH {V.PAIRS}, n AS (SELECT u, v, count(*) AS n FROM pairs GROUP BY ALL) SELECT cls, bar, count(*) AS n_pairs, count(*) FILTER (WHERE lat < 300) AS lt5min, round(list_sort(list(lat))[(count(*) // 2 + 1)::BIGINT], 1) AS median_s
    FROM pairs JOIN n USING (u, v), (SELECT unnest([1, 2, 3, 5, 10]) AS bar) WHERE n >= bar GROUP BY ALL""",
)
def latency_by_bar(spark: SparkSession, sf: str) -> DataFrame:
    return match.latency_by_bar(V.copy_pairs(spark, sf), [1, 2, 3, 5, 10])


@query("confident_directed", f"WITH {V.EDGES} SELECT CASE WHEN nv = 0 THEN u ELSE v END AS src, CASE WHEN nv = 0 THEN v ELSE u END AS dst FROM edges WHERE nu + nv >= 3 AND (nu = 0 OR nv = 0)")
def confident_directed(spark: SparkSession, sf: str) -> DataFrame:
    return layers.directed_layer(V.copy_edges(spark, sf), 3, "_copy")


@query("orientation_coverage", f"WITH {V.EDGES} SELECT count(*) AS n_edges, count(*) FILTER (WHERE nu + nv >= 2) AS n_eligible, count(*) FILTER (WHERE nu + nv >= 2 AND (nu = 0 OR nv = 0)) AS n_oriented, round(sum(CASE WHEN nu + nv >= 2 THEN 2 * pow(0.5, nu + nv) ELSE 0 END), 6) AS by_chance FROM edges")
def orientation_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return layers.orientation_coverage(_as_semantic(V.copy_edges(spark, sf)), 2)


def _as_semantic(edges: DataFrame) -> DataFrame:
    """The copy layer's votes where operators read the semantic ones."""
    return edges.drop("n_u_first", "n_v_first", "n_tie").withColumnsRenamed({"n_u_first_copy": "n_u_first", "n_v_first_copy": "n_v_first", "n_tie_copy": "n_tie"})


_SRC = "CASE WHEN nu + nv >= 2 AND nv = 0 THEN u WHEN nu + nv >= 2 AND nu = 0 THEN v END AS src"


@query(
    "connectors",
    f"""WITH {V.EDGES}, o AS (SELECT u, v, {_SRC} FROM edges), e AS (SELECT u AS id, src FROM o UNION ALL SELECT v, src FROM o),
    g AS (SELECT id, count(*) AS links, count(*) FILTER (WHERE src = id) AS n_out, count(*) FILTER (WHERE src <> id) AS n_in FROM e GROUP BY id)
    SELECT id, links, n_out, n_in, n_out - n_in AS net, row_number() OVER (ORDER BY links DESC, id) AS rank FROM g""",
)
def connectors(spark: SparkSession, sf: str) -> DataFrame:
    return longs(layers.connectors(_as_semantic(V.copy_edges(spark, sf)), 2), "rank")


@query(
    "brokers",
    f"""WITH {V.EDGES}, o AS (SELECT u, v, a.cls AS cu, b.cls AS cv, {_SRC} FROM edges JOIN cls a ON a.id = u JOIN cls b ON b.id = v WHERE a.cls <> b.cls),
    e AS (SELECT u AS id, cu AS cls, src FROM o UNION ALL SELECT v, cv, src FROM o), g AS (SELECT cls, id, count(*) AS links, count(*) FILTER (WHERE src = id) AS n_out, count(*) FILTER (WHERE src <> id) AS n_in FROM e GROUP BY ALL)
    SELECT *, round(links / sum(links) OVER (PARTITION BY cls), 6) AS share FROM g""",
)
def brokers(spark: SparkSession, sf: str) -> DataFrame:
    return layers.brokers(_as_semantic(V.copy_edges(spark, sf)), V.classes(spark, sf), 2)


@query(
    "direction_index",
    f"""WITH {V.EDGES}, o AS (SELECT least(a.cls, b.cls) AS a, greatest(a.cls, b.cls) AS b, CASE src WHEN u THEN a.cls WHEN v THEN b.cls END AS f FROM (SELECT u, v, {_SRC} FROM edges) JOIN cls a ON a.id = u JOIN cls b ON b.id = v WHERE a.cls <> b.cls)
    SELECT a, b, count(*) AS n_edges, round(count(f) / count(*), 6) AS orientable, round(CASE WHEN count(f) > 0 THEN (2 * count(*) FILTER (WHERE f = a) - count(f)) / count(f) END, 6) AS direction_index FROM o GROUP BY a, b""",
)
def direction_index(spark: SparkSession, sf: str) -> DataFrame:
    return layers.direction_index(_as_semantic(V.copy_edges(spark, sf)), V.classes(spark, sf), 2)


@query("bar_sweep", f"WITH {V.EDGES}, x AS (SELECT bar, u, v, is_cross FROM edges, (SELECT unnest([1, 2, 3, 5, 10]) AS bar) WHERE n_copy >= bar) SELECT bar, count(*) AS n_edges, count(*) FILTER (WHERE is_cross) AS n_cross, (SELECT count(*) FROM (SELECT u FROM x y WHERE y.bar = x.bar UNION SELECT v FROM x y WHERE y.bar = x.bar)) AS n_vertices FROM x GROUP BY bar")
def bar_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return layers.bar_sweep(V.copy_edges(spark, sf), [1, 2, 3, 5, 10], "n_copy")


_PARTNERS = "p AS (SELECT u AS id, v AS p FROM edges WHERE n_copy >= 2 UNION SELECT v, u FROM edges WHERE n_copy >= 2)"


@query("partner_overlap_jaccard", f"WITH {V.EDGES}, {_PARTNERS}, n AS (SELECT id, count(*) AS n FROM p GROUP BY id), b AS (SELECT x.id AS a, y.id AS b, count(*) AS n_both FROM p x JOIN p y ON x.p = y.p AND x.id < y.id GROUP BY ALL) SELECT a, b, n_both, na.n AS n_a, nb.n AS n_b, round(n_both / least(na.n, nb.n), 6) AS of_smaller, round(n_both / (na.n + nb.n - n_both), 6) AS jaccard FROM b JOIN n na ON na.id = a JOIN n nb ON nb.id = b")
def partner_overlap_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return layers.partner_overlap(V.copy_edges(spark, sf).filter("n_copy >= 2"))


_EVERY_PARTNER = "p AS (SELECT u AS id, v AS p FROM edges UNION SELECT v, u FROM edges)"


@query("partner_mix", f"WITH {V.EDGES}, {_EVERY_PARTNER}, n AS (SELECT p.id, cls.cls, count(*) AS n FROM p JOIN cls ON cls.id = p.p GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, cls) AS r FROM n) SELECT id, sum(n)::BIGINT AS n_partners, string_agg(cls || ' ' || n, ', ' ORDER BY r) FILTER (WHERE r <= 3) AS mix FROM r GROUP BY id")
def partner_mix(spark: SparkSession, sf: str) -> DataFrame:
    return layers.partner_mix(V.copy_edges(spark, sf), V.classes(spark, sf))


@query("layer_disjointness", f"WITH {V.EDGES}, l AS (SELECT lag(channel) OVER (PARTITION BY key ORDER BY ts, msg_id) AS o, channel AS t FROM posts), d AS (SELECT DISTINCT least(o, t) AS u, greatest(o, t) AS v FROM (SELECT o, t FROM l WHERE o IS NOT NULL GROUP BY o, t HAVING count(*) >= 2)) SELECT count(*) AS n_pairs, count(d.u) AS n_declared, round(count(d.u) / count(*), 6) AS share FROM edges LEFT JOIN d USING (u, v)")
def layer_disjointness(spark: SparkSession, sf: str) -> DataFrame:
    declared = V.lag_edges(spark, sf).filter("count >= 2").select(F.col("origin").alias("src"), F.col("target").alias("dst"))
    return layers.disjointness(V.copy_edges(spark, sf), declared)


# Channel statistics.


@query("modal_hour", f"WITH {V.POSTS}, h AS (SELECT channel, hour(ts) AS h, count(*) AS c FROM posts GROUP BY ALL) SELECT channel, arg_min(h, (-c, h))::INT AS modal_hour, sum(c)::BIGINT AS n FROM h GROUP BY channel")
def modal_hour(spark: SparkSession, sf: str) -> DataFrame:
    return extract.hour_histogram(V.posts(spark, sf)).select("channel", "modal_hour", "n")


@query("schedule_offset", f"WITH {V.GRAPH}, h AS (SELECT channel, hour(ts) AS h, count(*) AS c FROM posts GROUP BY ALL), m AS (SELECT channel, arg_min(h, (-c, h)) AS h FROM h GROUP BY channel), d AS (SELECT (b.h - a.h + 12 + 24) % 24 - 12 AS d FROM ge JOIN m a ON a.channel = src JOIN m b ON b.channel = dst) SELECT count(*) FILTER (WHERE d > 0) AS n_earlier, count(*) FILTER (WHERE d < 0) AS n_later, count(*) FILTER (WHERE d = 0) AS n_tie FROM d")
def schedule_offset(spark: SparkSession, sf: str) -> DataFrame:
    return layers.schedule_offset(V.forward_graph(spark, sf).edges, extract.hour_histogram(V.posts(spark, sf)))


@query("dominant_class", f"WITH {V.CLASSES} SELECT id, cls FROM cls")
def dominant_class(spark: SparkSession, sf: str) -> DataFrame:
    return V.classes(spark, sf)


# Texts of the documents.


@query("dupe_clusters", f"WITH {V.DOCS}, h AS (SELECT md5(norm) AS hash, channel, msg_id FROM docs WHERE length(norm) >= 80), n AS (SELECT hash, count(DISTINCT channel) AS n_channels, count(*) AS n_msgs FROM h GROUP BY hash HAVING count(DISTINCT channel) >= 2) SELECT hash, n_channels, n_msgs, channel, msg_id FROM h JOIN n USING (hash)")
def dupe_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return extract.duplicate_clusters(V.docs(spark, sf))


@query("corpus_dedup_counts", "WITH k AS (SELECT md5(lower(trim(regexp_replace(substr(text, 1, 400), '[\\s\\p{Z}]+', ' ', 'g')))) AS key FROM documents WHERE length(text) >= 100) SELECT count(*) AS n_texts, count(DISTINCT key) AS n_unique FROM k")
def corpus_dedup_counts(spark: SparkSession, sf: str) -> DataFrame:
    k = V.docs(spark, sf).select(T.content_key(F.col("text")).alias("key")).filter("key is not null")
    return k.agg(F.count("*").alias("n_texts"), F.count_distinct("key").alias("n_unique"))


@query("unique_texts", "WITH k AS (SELECT md5(lower(trim(regexp_replace(substr(text, 1, 400), '[\\s\\p{Z}]+', ' ', 'g')))) AS key, source, doc_id FROM documents WHERE length(text) >= 100) SELECT key, arg_min(doc_id, (source, -doc_id)) AS msg_id, count(*) AS n_occurrences, count(DISTINCT source) AS n_channels FROM k GROUP BY key")
def unique_texts(spark: SparkSession, sf: str) -> DataFrame:
    texts, _ = extract.unique_texts(V.docs(spark, sf).withColumn("ts", F.lit("2020-01-01").cast("timestamp")))
    return texts.select("key", "msg_id", "n_occurrences", "n_channels")


_TOKENS = "w AS (SELECT source AS channel, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{3,}')) AS term FROM documents), c AS (SELECT channel, term, count(*) AS n FROM w GROUP BY ALL)"


@query("channel_terms_topk", f"WITH {_TOKENS}, r AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, term) AS rank FROM c) SELECT channel, term, n, rank FROM r WHERE rank <= 120")
def channel_terms_topk(spark: SparkSession, sf: str) -> DataFrame:
    return longs(extract.channel_terms(V.docs(spark, sf))[0], "rank")


@query("channel_token_totals", f"WITH {_TOKENS} SELECT channel, sum(n)::BIGINT AS n_tokens FROM c GROUP BY channel")
def channel_token_totals(spark: SparkSession, sf: str) -> DataFrame:
    return extract.channel_terms(V.docs(spark, sf))[1]


@query(
    "ctfidf_by_language",
    """WITH w AS (SELECT source || '/' || lang AS id, lang AS community, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{3,}')) AS term FROM documents), c AS (SELECT id, community, term, count(*) AS n FROM w GROUP BY ALL),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, term) AS r FROM c) WHERE r <= 120), big AS (SELECT community FROM (SELECT DISTINCT id, community FROM t) GROUP BY community HAVING count(*) >= 5),
    b AS (SELECT community, term, sum(n) AS n FROM t WHERE community IN (SELECT community FROM big) AND NOT regexp_matches(term, '^[0-9]+$') GROUP BY ALL), s AS (SELECT community, sum(n) AS total FROM b GROUP BY community), d AS (SELECT term, count(*) AS df FROM b GROUP BY term),
    x AS (SELECT community, term, n / total * (ln((1 + (SELECT count(*) FROM big)) / (1 + df)) + 1) AS score FROM b JOIN s USING (community) JOIN d USING (term)), y AS (SELECT community, term, round(score, 8) AS score, row_number() OVER (PARTITION BY community ORDER BY round(score, 12) DESC, term) AS rank FROM x) SELECT community, term, score, rank FROM y WHERE rank <= 20""",
)
def ctfidf_by_language(spark: SparkSession, sf: str) -> DataFrame:
    t = V.doc_terms(spark, sf)
    return longs(topics.ctfidf(t.select("id", "term", "n"), t.select("id", "community").distinct(), min_size=5), "rank")


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, 'href=\"https?://([^/\"]+)', 1)) AS host FROM pages")
def page_links(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "pages")
    return p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="https?://([^/"]+)'), F.lit(1))).alias("host"))


@query("conversation_roles", "SELECT role, count(*) AS n_turns, count(DISTINCT conv_id) AS n_conversations, sum(length(text))::BIGINT AS n_chars, count(*) FILTER (WHERE regexp_matches(text, '[^\\s\\p{Z}]')) AS n_text FROM conversations GROUP BY role")
def conversation_roles(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "conversations")
    return c.groupBy("role").agg(F.count("*").alias("n_turns"), F.count_distinct("conv_id").alias("n_conversations"), F.sum(F.length("text")).alias("n_chars"), F.count_if(T.has_text(F.col("text"))).alias("n_text"))


# The forward graph.


@query("id_prefix_censor", f"WITH {V.LAG}, n AS (SELECT CASE WHEN origin % 10 = 0 THEN 'id:' || origin ELSE 'c' || origin END AS origin, target, count FROM lagged) SELECT origin, target, count FROM n WHERE NOT starts_with(origin, 'id:') AND count >= 2")
def id_prefix_censor(spark: SparkSession, sf: str) -> DataFrame:
    named = V.lag_edges(spark, sf).withColumn("origin", F.concat(F.when(F.col("origin") % 10 == 0, "id:").otherwise("c"), F.col("origin").cast("string")))
    return named.filter(~T.unresolved(F.col("origin")) & (F.col("count") >= 2))


@query("roles", f"WITH {V.GRAPH} SELECT id, n_in, n_out, degree, role FROM roles")
def roles(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).roles()


@query("role_edge_mix", f"WITH {V.GRAPH} SELECT a.role AS src_role, b.role AS dst_role, count(*) AS n FROM ge JOIN roles a ON a.id = src JOIN roles b ON b.id = dst GROUP BY ALL")
def role_edge_mix(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).role_mix()


@query("degree_hist", f"WITH {V.GRAPH} SELECT degree, count(*) AS n FROM roles GROUP BY degree")
def degree_hist(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree_histogram(V.forward_graph(spark, sf).degrees())


@query("degree_buckets", f"WITH {V.GRAPH} SELECT CASE WHEN degree <= 1 THEN degree::VARCHAR WHEN degree <= 3 THEN '2-3' WHEN degree <= 7 THEN '4-7' WHEN degree <= 15 THEN '8-15' ELSE '16+' END AS bucket, count(*) AS n FROM roles GROUP BY 1")
def degree_buckets(spark: SparkSession, sf: str) -> DataFrame:
    d = V.forward_graph(spark, sf).degrees()
    return d.groupBy(graph.degree_bucket(F.col("degree")).alias("bucket")).agg(F.count("*").alias("n"))


@query(
    "degree_tiers",
    f"""WITH {V.GRAPH}, r AS (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS r, count(*) OVER () AS n FROM roles), s AS (SELECT unnest([0.01, 0.05, 0.1, 0.25])::DOUBLE AS share), t AS (SELECT share, id FROM r, s WHERE r <= greatest(1, floor(n * share))),
    e AS (SELECT share, src IN (SELECT id FROM t WHERE t.share = s.share) AS a, dst IN (SELECT id FROM t WHERE t.share = s.share) AS b FROM ge, s)
    SELECT share, (SELECT count(*) FROM t WHERE t.share = e.share) AS size, count(*) AS n_edges, count(*) FILTER (WHERE a OR b) AS touching, count(*) FILTER (WHERE a AND b) AS internal, count(*) FILTER (WHERE a) AS originating, count(*) FILTER (WHERE b) AS terminating, round((count(*) FILTER (WHERE a) + count(*) FILTER (WHERE b)) / (2 * count(*)), 6) AS endpoint_share FROM e GROUP BY share""",
)
def degree_tiers(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tier_shares(V.forward_graph(spark, sf), [0.01, 0.05, 0.1, 0.25])


@query("hub_topk_cross_rank", f"WITH {V.GRAPH}, r AS (SELECT id, n_in, n_out, degree, row_number() OVER (ORDER BY n_in DESC, id) AS rank_n_in, row_number() OVER (ORDER BY n_out DESC, id) AS rank_n_out, row_number() OVER (ORDER BY degree DESC, id) AS rank_degree FROM roles) SELECT * FROM r WHERE least(rank_n_in, rank_n_out, rank_degree) <= 10")
def hub_topk_cross_rank(spark: SparkSession, sf: str) -> DataFrame:
    return longs(graph.hub_ranks(V.forward_graph(spark, sf).degrees()), "rank_n_in", "rank_n_out", "rank_degree")


@query("density", f"WITH {V.GRAPH}, c AS (SELECT (SELECT count(*) FROM gv) AS n, (SELECT count(*) FROM ge) AS m, (SELECT count(*) FROM und) AS k) SELECT n, m, round(m / (n * (n - 1)), 8) AS directed_density, round(2 * k / (n * (n - 1)), 8) AS undirected_density FROM c")
def density(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).density()


@query("reciprocity", f"WITH {V.GRAPH} SELECT count(*) AS n_edges, count(b.src) AS n_reciprocal, round(count(b.src) / count(*), 6) AS reciprocity FROM ge a LEFT JOIN ge b ON a.src = b.dst AND a.dst = b.src")
def reciprocity(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).reciprocity()


@query("triangles_transitivity", f"WITH {V.GRAPH}, t AS (SELECT count(*) AS t FROM und a JOIN und b ON a.v = b.u JOIN und c ON c.u = a.u AND c.v = b.v), w AS (SELECT sum(d * (d - 1) // 2)::BIGINT AS w FROM (SELECT src, count(*) AS d FROM both_ways GROUP BY src)) SELECT t AS triangles, w AS wedges, round(3 * t / w, 6) AS transitivity FROM t, w")
def triangles_transitivity(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).triangles()


@query("wcc", f"WITH RECURSIVE {V.WCC} SELECT id, component FROM wcc")
def wcc(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).wcc()


@query("component_census", f"WITH RECURSIVE {V.WCC}, s AS (SELECT component, count(*) AS size FROM wcc GROUP BY component) SELECT size, count(*) AS n FROM s GROUP BY size")
def component_census(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).component_census()


@query("bfs_depth", f"WITH RECURSIVE {V.LAG}, e AS (SELECT origin AS src, target AS dst FROM lagged WHERE count >= 2), b(id, d) AS (SELECT min(channel), 0 FROM posts UNION SELECT e.dst, d + 1 FROM b JOIN e ON e.src = b.id WHERE d < 2) SELECT id::VARCHAR AS handle, min(d)::INT AS depth FROM b GROUP BY id")
def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    p = V.posts(spark, sf)
    e = V.lag_edges(spark, sf).filter("count >= 2").select(F.col("origin").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    seed = p.agg(F.min("channel").cast("string").alias("handle"))
    return extract.bfs_members(seed, e, p.select(F.col("channel").cast("string").alias("handle"))).select("handle", "depth")


@query("bfs_origins", f"WITH RECURSIVE {V.LAG}, e AS (SELECT origin AS src, target AS dst FROM lagged WHERE count >= 2), b(id, d) AS (SELECT min(channel), 0 FROM posts UNION SELECT e.dst, d + 1 FROM b JOIN e ON e.src = b.id WHERE d < 2), m AS (SELECT id, min(d) AS d FROM b GROUP BY id) SELECT y.id::VARCHAR AS handle, array_to_string(list_sort(list(DISTINCT x.id::VARCHAR))[1:8], ',') AS origins FROM m y JOIN e ON e.dst = y.id JOIN m x ON x.id = e.src AND x.d = y.d - 1 GROUP BY y.id")
def bfs_origins(spark: SparkSession, sf: str) -> DataFrame:
    p = V.posts(spark, sf)
    e = V.lag_edges(spark, sf).filter("count >= 2").select(F.col("origin").cast("string").alias("source"), F.col("target").cast("string").alias("target"))
    seed = p.agg(F.min("channel").cast("string").alias("handle"))
    return extract.bfs_members(seed, e, p.select(F.col("channel").cast("string").alias("handle"))).filter("depth > 0").select("handle", F.array_join("origins", ",").alias("origins"))


@query("reachability", f"WITH RECURSIVE {V.REACH}, c AS (SELECT a.role AS src_role, b.role AS dst_role, count(*) FILTER (WHERE a.id <> b.id) AS n_pairs FROM roles a, roles b GROUP BY ALL), r AS (SELECT a.role AS src_role, b.role AS dst_role, count(*) AS n FROM reach JOIN roles a ON a.id = s JOIN roles b ON b.id = t WHERE s <> t GROUP BY ALL) SELECT src_role, dst_role, n_pairs, coalesce(n, 0) AS n_reachable FROM c LEFT JOIN r USING (src_role, dst_role)")
def reachability(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).reachability()


@query("scc", f"WITH RECURSIVE {V.REACH} SELECT id, scc FROM scc")
def scc(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).scc()


@query("scc_core_buckets", f"WITH RECURSIVE {V.REACH} SELECT CASE WHEN a.in_core AND b.in_core THEN 'internal' WHEN b.in_core THEN 'inflow' WHEN a.in_core THEN 'outflow' ELSE 'bypass' END AS bucket, count(*) AS n FROM ge JOIN core a ON a.id = src JOIN core b ON b.id = dst GROUP BY 1")
def scc_core_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).core_buckets()


@query("circulation", f"WITH RECURSIVE {V.REACH} SELECT CASE WHEN in_core THEN 'core' WHEN role = 'dual' THEN 'pass_through' ELSE 'cannot_loop' END AS circulation, role, count(*) AS n FROM roles JOIN core USING (id) GROUP BY ALL")
def circulation(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).circulation().groupBy("circulation", "role").agg(F.count("*").alias("n"))


@query("avg_path_diameter", f"WITH RECURSIVE {V.PATHS} SELECT round(avg(d), 6) AS avg_path_length, max(d)::BIGINT AS diameter, count(*) AS n_pairs FROM dist")
def avg_path_diameter(spark: SparkSession, sf: str) -> DataFrame:
    return V.forward_graph(spark, sf).path_summary(True)


_MIX = f"{V.GRAPH}, {V.CLASSES}, m AS (SELECT a.cls AS src_cls, b.cls AS dst_cls, count(*) AS n FROM ge JOIN cls a ON a.id = src JOIN cls b ON b.id = dst GROUP BY ALL), e AS (SELECT *, n / sum(n) OVER () AS share FROM m)"


@query("mixing_matrix", f"WITH {_MIX} SELECT src_cls, dst_cls, n, round(share, 6) AS share FROM e")
def mixing_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return graph.mixing_matrix(V.forward_graph(spark, sf).edges, V.classes(spark, sf)).withColumn("share", F.round("share", 6))


_TERMS = f"{_MIX}, a AS (SELECT src_cls AS cls, sum(share) AS a FROM e GROUP BY 1), b AS (SELECT dst_cls AS cls, sum(share) AS b FROM e GROUP BY 1), t AS (SELECT coalesce(a.cls, b.cls) AS cls, coalesce(a, 0) AS a, coalesce(b, 0) AS b, coalesce((SELECT share FROM e WHERE src_cls = coalesce(a.cls, b.cls) AND dst_cls = src_cls), 0) AS e FROM a FULL JOIN b ON a.cls = b.cls)"


@query("assortativity_decomp", f"WITH {_TERMS} SELECT cls, round(e, 6) AS observed, round(a * b, 6) AS chance, round((e - a * b) / (1 - sum(a * b) OVER ()), 6) AS contribution FROM t")
def assortativity_decomp(spark: SparkSession, sf: str) -> DataFrame:
    t = graph.assortativity_terms(graph.mixing_matrix(V.forward_graph(spark, sf).edges, V.classes(spark, sf)))
    return t.select("cls", F.round("e", 6).alias("observed"), F.round("chance", 6).alias("chance"), F.round("contribution", 6).alias("contribution"))


@query("nominal_assortativity", f"WITH {_TERMS} SELECT round((sum(e) - sum(a * b)) / (1 - sum(a * b)), 6) AS r FROM t")
def nominal_assortativity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.assortativity(graph.mixing_matrix(V.forward_graph(spark, sf).edges, V.classes(spark, sf)))


@query("degree_assortativity", f"WITH {V.GRAPH}, d AS (SELECT src AS id, count(*)::DOUBLE AS d FROM both_ways GROUP BY src) SELECT round(corr(a.d, b.d), 6) AS assortativity FROM both_ways JOIN d a ON a.id = src JOIN d b ON b.id = dst")
def degree_assortativity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degree_assortativity(V.forward_graph(spark, sf).edges)


def _membership(spark: SparkSession, sf: str) -> DataFrame:
    """A given partition: the remainder of the id by seven."""
    return V.forward_graph(spark, sf).vertices.select("id", (F.col("id") % 7).alias("community"))


_PROFILE = f"{V.MEMBERS}, x AS (SELECT a.community AS ca, b.community AS cb FROM und JOIN mem a ON a.id = u JOIN mem b ON b.id = v), y AS (SELECT ca AS c, ca = cb AS s FROM x UNION ALL SELECT cb, ca = cb FROM x), p AS (SELECT c AS community, count(*) FILTER (WHERE s) // 2 AS internal, count(*) FILTER (WHERE NOT s) AS boundary, count(*) AS volume, (SELECT count(*) FROM und) AS m FROM y GROUP BY c)"


@query("conductance", f"WITH {_PROFILE} SELECT community, (SELECT count(*) FROM mem WHERE mem.community = p.community) AS size, internal::BIGINT AS internal, boundary, volume, round(boundary / least(volume, 2 * m - volume), 6) AS conductance FROM p")
def conductance(spark: SparkSession, sf: str) -> DataFrame:
    return graph.community_profile(V.forward_graph(spark, sf).edges, _membership(spark, sf)).select("community", "size", "internal", "boundary", "volume", F.round("conductance", 6).alias("conductance"))


@query("modularity", f"WITH {_PROFILE} SELECT round(sum(internal / m - pow(volume / (2 * m), 2)), 6) AS modularity FROM p")
def modularity(spark: SparkSession, sf: str) -> DataFrame:
    return graph.modularity(V.forward_graph(spark, sf).edges, _membership(spark, sf))


@query("class_entropy", f"WITH {V.MEMBERS}, n AS (SELECT community, cls, count(*) AS n FROM mem JOIN cls USING (id) GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY community) AS p, row_number() OVER (PARTITION BY community ORDER BY n DESC, cls) AS r FROM n) SELECT community, sum(n)::BIGINT AS size, string_agg(cls, ',' ORDER BY r) FILTER (WHERE r <= 3) AS mix, round(max(p), 6) AS top_share, round(abs(sum(p * log2(p))), 6) AS entropy_bits FROM p GROUP BY community")
def class_entropy(spark: SparkSession, sf: str) -> DataFrame:
    e = graph.class_entropy(_membership(spark, sf), V.classes(spark, sf))
    return e.withColumn("top_share", F.round("top_share", 6)).withColumn("entropy_bits", F.round("entropy_bits", 6))


@query("meta_graph", f"WITH {V.MEMBERS} SELECT least(a.community, b.community) AS a, greatest(a.community, b.community) AS b, count(*) AS weight FROM und JOIN mem a ON a.id = u JOIN mem b ON b.id = v WHERE a.community <> b.community GROUP BY 1, 2")
def meta_graph(spark: SparkSession, sf: str) -> DataFrame:
    return graph.meta_graph(V.forward_graph(spark, sf).edges, _membership(spark, sf))


@query("boundary_import_export", f"WITH {V.MEMBERS} SELECT CASE WHEN b.community = 1 THEN 'import' ELSE 'export' END AS direction, CASE WHEN b.community = 1 THEN a.community ELSE b.community END AS other, count(*) AS n FROM ge JOIN mem a ON a.id = src JOIN mem b ON b.id = dst WHERE (a.community = 1) <> (b.community = 1) GROUP BY 1, 2")
def boundary_import_export(spark: SparkSession, sf: str) -> DataFrame:
    return graph.boundary(V.forward_graph(spark, sf).edges, _membership(spark, sf), 1).groupBy("direction", "other").agg(F.count("*").alias("n"))


_FLOWS = f"{V.MEMBERS}, x AS (SELECT src, dst, a.community = b.community AS s FROM ge JOIN mem a ON a.id = src JOIN mem b ON b.id = dst), f AS (SELECT id, community, (SELECT count(*) FROM x WHERE src = id AND s) AS reach, (SELECT count(*) FROM x WHERE dst = id AND s) AS intake, (SELECT count(*) FROM x WHERE src = id AND NOT s) AS exports, (SELECT count(*) FROM x WHERE dst = id AND NOT s) AS imports FROM mem)"


@query("internal_reach", f"WITH {_FLOWS} SELECT id, community, reach, intake, exports, imports, CASE WHEN reach >= 2 AND imports >= 3 THEN 'bridge' WHEN reach >= 2 THEN 'amplifier' WHEN imports >= 3 THEN 'importer' ELSE 'periphery' END AS quadrant, round(sqrt(reach * imports), 6) AS balance FROM f")
def internal_reach(spark: SparkSession, sf: str) -> DataFrame:
    return graph.quadrants(graph.member_flows(V.forward_graph(spark, sf).edges, _membership(spark, sf)), 2, 3)


@query("division_of_labour", f"WITH {_FLOWS} SELECT CASE WHEN exports > 0 AND imports > 0 THEN 'both' WHEN exports > 0 THEN 'supplier' WHEN imports > 0 THEN 'importer' ELSE 'neither' END AS role, count(*) AS n, median(exports)::DOUBLE AS median_supply, round(avg(exports), 6) AS mean_supply, count(*) FILTER (WHERE imports = 0) AS zero_take FROM f GROUP BY 1")
def division_of_labour(spark: SparkSession, sf: str) -> DataFrame:
    return layers.division_of_labour(graph.member_flows(V.forward_graph(spark, sf).edges, _membership(spark, sf)))


@query("landing_census", f"WITH {V.MEMBERS}, n AS (SELECT cls, community, count(*) AS n FROM mem JOIN cls USING (id) GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY cls), 6) AS share FROM n")
def landing_census(spark: SparkSession, sf: str) -> DataFrame:
    return graph.landing_census(_membership(spark, sf), V.classes(spark, sf))


@query("class_tallies", f"WITH {V.MEMBERS} SELECT least(a.cls, b.cls) AS a, greatest(a.cls, b.cls) AS b, count(*) AS n, least(a.cls, b.cls) = greatest(a.cls, b.cls) AS within FROM und JOIN cls a ON a.id = u JOIN cls b ON b.id = v GROUP BY 1, 2")
def class_tallies(spark: SparkSession, sf: str) -> DataFrame:
    return graph.tallies_by_class(V.forward_graph(spark, sf).edges, V.classes(spark, sf))


@query("expected_same_class", f"WITH {V.MEMBERS}, d AS (SELECT src AS id, count(*) AS d FROM both_ways GROUP BY src), v AS (SELECT cls, sum(d) AS v FROM d JOIN cls USING (id) GROUP BY cls), m AS (SELECT sum(d) AS m FROM d) SELECT cls, round(v * (v - 1) / (2 * (m - 1)), 6) AS expected FROM v, m")
def expected_same_class(spark: SparkSession, sf: str) -> DataFrame:
    return graph.expected_same_class(V.forward_graph(spark, sf).edges, V.classes(spark, sf)).withColumn("expected", F.round("expected", 6))


@query("out_profile", f"WITH {V.GRAPH}, p AS (SELECT id, n_in, n_out, round(n_out / (n_in + n_out), 6) AS out_share FROM roles) SELECT *, row_number() OVER (ORDER BY out_share DESC NULLS LAST, id) AS rank_desc, row_number() OVER (ORDER BY out_share NULLS LAST, id) AS rank_asc FROM p")
def out_profile(spark: SparkSession, sf: str) -> DataFrame:
    return longs(layers.out_profile(V.forward_graph(spark, sf).degrees().drop("degree")), "rank_desc", "rank_asc")


# Vectors and trade.

_COS = "x AS (SELECT vec_id AS id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL), c AS (SELECT a.id AS i, b.id AS j, list_dot_product(a.v, b.v) AS sim, a.label AS la, b.label AS lb FROM x a JOIN x b ON a.id < b.id)"


@query("cosine_pairs", f"WITH {_COS} SELECT i, j, round(sim, 6) AS sim FROM c WHERE sim >= 0.3")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return match.cosine_pairs(e, 0.3).withColumn("sim", F.round("sim", 6))


@query("cosine_class_threshold", f"WITH {_COS} SELECT i, j, round(sim, 6) AS sim, la <> lb AS is_cross FROM c WHERE sim >= 0.3 AND sim >= CASE WHEN la = lb THEN 0.35 ELSE 0.3 END")
def cosine_class_threshold(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    p = match.cosine_pairs(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.3)
    c = e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("cls"))
    p = p.join(c.toDF("i", "la"), "i").join(c.toDF("j", "lb"), "j")
    keep = F.col("sim") >= match.keep_threshold(F.col("la"), F.col("lb"), 0.35, 0.3, 0.35)
    return p.filter(keep).select("i", "j", F.round("sim", 6).alias("sim"), match.is_cross(F.col("la"), F.col("lb")).alias("is_cross"))


@query("fanout_capped", f"WITH {_COS}, o AS (SELECT vec_id % 50 AS channel, vec_id AS m, label AS key FROM embeddings), n AS (SELECT key, count(*) AS n, min(channel * 1000000 + m) AS f FROM o GROUP BY key), k AS (SELECT DISTINCT la AS i, lb AS j FROM c WHERE sim >= 0.3 AND la < lb) SELECT k.i, k.j, count(*) FILTER (WHERE a.n * b.n <= 2400 OR (x.channel * 1000000 + x.m = a.f AND y.channel * 1000000 + y.m = b.f)) AS n_pairs FROM k JOIN n a ON a.key = i JOIN n b ON b.key = j JOIN o x ON x.key = i JOIN o y ON y.key = j GROUP BY ALL")
def fanout_capped(spark: SparkSession, sf: str) -> DataFrame:
    e = read_table(spark, sf, "embeddings")
    p = match.cosine_pairs(e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")), 0.3)
    c = e.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("cls"))
    k = p.join(c.toDF("i", "la"), "i").join(c.toDF("j", "lb"), "j").filter("la < lb").select(F.col("la").alias("i"), F.col("lb").alias("j")).distinct().withColumn("sim", F.lit(1.0))
    occ = e.select(F.col("label").cast("long").alias("key"), (F.col("vec_id") % 50).alias("channel"), F.col("vec_id").alias("msg_id"), F.lit("2020-01-01").cast("timestamp").alias("ts"))
    out = match.expand_pairs(k, occ, "all", 2400)
    label = occ.select(F.col("msg_id"), F.col("key"))
    return out.join(label.toDF("a_msg_id", "i"), "a_msg_id").join(label.toDF("b_msg_id", "j"), "b_msg_id").groupBy("i", "j").agg(F.count("*").alias("n_pairs"))


_TRADE = "t AS (SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


@query("trade_meta_graph", f"WITH {_TRADE} SELECT src, dst, n FROM t")
def trade_meta_graph(spark: SparkSession, sf: str) -> DataFrame:
    return V.nation_edges(spark, sf)


@query("availability_ratio", f"WITH {_TRADE}, i AS (SELECT r_name AS cls, sum(n) AS n FROM t JOIN nation ON n_nationkey = src JOIN region ON r_regionkey = n_regionkey WHERE dst = 1 GROUP BY 1), k AS (SELECT r_name AS cls, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY 1) SELECT cls, coalesce(i.n, 0)::BIGINT AS n_imports, k.n AS n_nodes, round(coalesce(i.n, 0) / (SELECT sum(n) FROM i) / (k.n / (SELECT sum(n) FROM k)), 6) AS ratio FROM k LEFT JOIN i USING (cls)")
def availability_ratio(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation").join(read_table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("id"), F.col("r_name").alias("cls"))
    e = V.nation_edges(spark, sf).filter("dst = 1").join(n.toDF("src", "cls"), "src").select("cls", F.explode(F.array_repeat(F.lit(1), F.col("n").cast("int"))))
    return layers.availability(e, n)


@query("pareto_concentration", f"WITH {_TRADE}, s AS (SELECT src, sum(n) AS n FROM t GROUP BY src) SELECT src, n::BIGINT AS n, row_number() OVER (ORDER BY n DESC, src) AS rank, round(sum(n) OVER (ORDER BY n DESC, src ROWS UNBOUNDED PRECEDING) / sum(n) OVER (), 6) AS cum_share FROM s")
def pareto_concentration(spark: SparkSession, sf: str) -> DataFrame:
    s = V.nation_edges(spark, sf).groupBy("src").agg(F.sum("n").alias("n"))
    return longs(layers.pareto(s, "src", "n"), "rank")


@query("concentration_top", f"WITH {_TRADE}, s AS (SELECT src, sum(n) AS n FROM t GROUP BY src), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, src) AS r FROM s) SELECT count(*) AS n_keys, sum(n)::BIGINT AS total, round(sum(n) FILTER (WHERE r <= 1) / sum(n), 6) AS top1, round(sum(n) FILTER (WHERE r <= 4) / sum(n), 6) AS top4, round(sum(n) FILTER (WHERE r <= 10) / sum(n), 6) AS top10 FROM r")
def concentration_top(spark: SparkSession, sf: str) -> DataFrame:
    return layers.concentration(V.nation_edges(spark, sf).groupBy("src").agg(F.sum("n").alias("n")), "src", "n", [1, 4, 10])


_XY = "d AS (SELECT c_custkey AS id, c_acctbal AS x, count(o_orderkey)::DOUBLE AS y FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL)"


def _accounts(spark: SparkSession, sf: str) -> DataFrame:
    c, o = read_table(spark, sf, "customer"), read_table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))
    return c.join(o, c.c_custkey == o.o_custkey, "left").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("x"), F.coalesce("n", F.lit(0)).cast("double").alias("y"), "c_mktsegment")


@query("spearman_true", f"WITH {_XY}, r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM d) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r")
def spearman_true(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(_accounts(spark, sf), "x", "y").select(F.round("rho", 6).alias("rho"), "n")


@query("spearman_ordinal", f"WITH {_XY}, r AS (SELECT row_number() OVER (ORDER BY x, id) AS rx, row_number() OVER (ORDER BY y, id) AS ry FROM d) SELECT round(corr(rx, ry), 6) AS rho, count(*) AS n FROM r")
def spearman_ordinal(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(_accounts(spark, sf), "x", "y", "ordinal", ["id"]).select(F.round("rho", 6).alias("rho"), "n")


@query("summary_stats", f"WITH {_XY} SELECT round(corr(x, y), 6) AS pearson, round(median(y), 6) AS median_y, round(quantile_cont(x, 0.25), 6) AS q25, round(quantile_cont(x, 0.75), 6) AS q75, round(stddev_pop(y), 6) AS sd FROM d")
def summary_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _accounts(spark, sf).agg(F.round(F.corr("x", "y"), 6).alias("pearson"), F.round(F.median("y"), 6).alias("median_y"), F.round(F.percentile("x", 0.25), 6).alias("q25"), F.round(F.percentile("x", 0.75), 6).alias("q75"), F.round(F.stddev_pop("y"), 6).alias("sd"))


@query("reconciliation", "WITH a AS (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT o_orderstatus AS k, count(*) AS m FROM orders GROUP BY 1) SELECT coalesce(a.k, b.k) AS k, coalesce(n, 0) AS n, coalesce(m, 0) AS m, coalesce(n, 0) - coalesce(m, 0) AS gap FROM a FULL JOIN b ON a.k = b.k")
def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    a = read_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n"))
    b = read_table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("m"))
    return a.join(b, "k", "full_outer").na.fill(0, ["n", "m"]).withColumn("gap", F.col("n") - F.col("m"))


@query("tier_base_rate", f"WITH {_XY}, t AS (SELECT ntile(10) OVER (ORDER BY y DESC, id) AS tier, (x < 0)::INT AS f FROM d), g AS (SELECT tier, count(*) AS n, round(avg(f), 6) AS share FROM t GROUP BY tier) SELECT tier, n, share, round(sum(share * n) OVER () / sum(n) OVER (), 4) AS base FROM g")
def tier_base_rate(spark: SparkSession, sf: str) -> DataFrame:
    return longs(layers.tier_base_rate(_accounts(spark, sf).withColumn("f", F.col("x") < 0), "y", "f"), "tier")


@query("top_composition", "SELECT s AS c_mktsegment, count(*) FILTER (WHERE r <= 100) AS n_top, count(*) AS n_all FROM (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS r FROM customer) GROUP BY s")
def top_composition(spark: SparkSession, sf: str) -> DataFrame:
    return layers.top_composition(_accounts(spark, sf), "x", "c_mktsegment")


# Further layer and boundary tables.


@query("rank_of_links", f"WITH {V.GRAPH} SELECT id, degree, rank() OVER (ORDER BY degree DESC) AS rank FROM roles")
def rank_of_links(spark: SparkSession, sf: str) -> DataFrame:
    return longs(layers.rank_of(V.forward_graph(spark, sf).degrees().select("id", "degree"), "degree"), "rank")


@query("split_by_bars", f"WITH {V.EDGES}, x AS (SELECT u % 7 AS community, bar, nu, nv FROM edges, (SELECT unnest([1, 2, 3]) AS bar) WHERE u % 7 = v % 7 AND nu + nv >= bar) SELECT community, bar, count(*) AS n_edges, count(*) FILTER (WHERE nu = 0 OR nv = 0) AS n_one_way FROM x GROUP BY ALL")
def split_by_bars(spark: SparkSession, sf: str) -> DataFrame:
    e = _as_semantic(V.copy_edges(spark, sf))
    m = layers.partners(e).select("id").distinct().withColumn("community", F.col("id") % 7)
    return layers.split_by_bars(e, m, [1, 2, 3])


@query("orientation_share", f"WITH {V.EDGES}, o AS (SELECT u, v, {_SRC} FROM edges), e AS (SELECT u AS id, src FROM o UNION ALL SELECT v, src FROM o) SELECT id, count(*) AS n_edges, count(src) AS n_oriented, round(count(src) / count(*), 6) AS share FROM e GROUP BY id")
def orientation_share(spark: SparkSession, sf: str) -> DataFrame:
    e = layers.votes(_as_semantic(V.copy_edges(spark, sf)))
    return graph.orientation_share(e.withColumn("src", layers.source_of(F.col("nu"), F.col("nv"), F.col("u"), F.col("v"), 2)))


_VERDICT = "SELECT id, CASE WHEN max(o) = 1 AND max(i) = 1 THEN 'both' WHEN max(o) = 1 THEN 'out' ELSE 'in' END AS verdict FROM (SELECT src AS id, 1 AS o, 0 AS i FROM {e} UNION ALL SELECT dst, 0, 1 FROM {e}) GROUP BY id"


@query(
    "cross_layer_channels",
    f"""WITH {V.EDGES}, l AS (SELECT lag(channel) OVER (PARTITION BY key ORDER BY ts, msg_id) AS o, channel AS t FROM posts), d AS (SELECT o AS src, t AS dst FROM l WHERE o IS NOT NULL GROUP BY ALL HAVING count(*) >= {V.MIN_COUNT} AND o <> t),
    c AS (SELECT CASE WHEN nv = 0 THEN u ELSE v END AS src, CASE WHEN nv = 0 THEN v ELSE u END AS dst FROM edges WHERE nu + nv >= 3 AND (nu = 0 OR nv = 0)), a AS (SELECT id, count(DISTINCT p) AS links FROM (SELECT u AS id, v AS p FROM edges UNION ALL SELECT v, u FROM edges) GROUP BY id),
    x AS ({_VERDICT.format(e="c")}), y AS ({_VERDICT.format(e="d")}) SELECT id, coalesce(links, 0) AS links, coalesce(x.verdict, 'none') AS directed, coalesce(y.verdict, 'none') AS declared FROM a FULL JOIN x USING (id) FULL JOIN y USING (id)""",
)
def cross_layer_channels(spark: SparkSession, sf: str) -> DataFrame:
    e = V.copy_edges(spark, sf)
    return layers.cross_layer_channels(e, layers.directed_layer(e, 3, "_copy"), V.forward_graph(spark, sf).edges)


@query("layer_partner_overlap", f"WITH {V.EDGES}, l AS (SELECT lag(channel) OVER (PARTITION BY key ORDER BY ts, msg_id) AS o, channel AS t FROM posts), d AS (SELECT o AS u, t AS v FROM l WHERE o IS NOT NULL AND o <> t GROUP BY ALL HAVING count(*) >= {V.MIN_COUNT}), pa AS (SELECT u AS id, v AS p FROM edges UNION SELECT v, u FROM edges), pb AS (SELECT u AS id, v AS p FROM d UNION SELECT v, u FROM d) SELECT id, count(x) AS n_a, count(y) AS n_b, count(x + y) AS n_both FROM (SELECT *, 1 AS x FROM pa) FULL JOIN (SELECT *, 1 AS y FROM pb) USING (id, p) GROUP BY id")
def layer_partner_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return layers.layer_partner_overlap(V.copy_edges(spark, sf), V.forward_graph(spark, sf).edges.toDF("u", "v"))


@query("tier_direction", f"WITH {V.GRAPH}, t AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY degree DESC, id) AS r, count(*) OVER () AS n FROM roles) WHERE r <= greatest(1, floor(n * 0.1))) SELECT src IN (SELECT id FROM t) AS src_top, dst IN (SELECT id FROM t) AS dst_top, count(*) AS n FROM ge GROUP BY 1, 2")
def tier_direction(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    return layers.tier_direction(g.edges, graph.tier(g.degrees(), 0.1))


@query("selection_effect", f"WITH {V.GRAPH}, n AS (SELECT channel AS id, count(*) AS n FROM posts GROUP BY 1) SELECT id IN (SELECT id FROM gv) AS inside, count(*) AS n, median(n)::DOUBLE AS median_n FROM (SELECT id, n FROM n) GROUP BY 1")
def selection_effect(spark: SparkSession, sf: str) -> DataFrame:
    n = V.posts(spark, sf).groupBy(F.col("channel").alias("id")).agg(F.count("*").alias("n"))
    return layers.selection_effect(n, V.forward_graph(spark, sf).vertices, ["n"])


@query("roles_by_depth", f"WITH RECURSIVE {V.GRAPH}, b(id, d) AS (SELECT min(id), 0 FROM gv UNION SELECT ge.dst, d + 1 FROM b JOIN ge ON ge.src = b.id WHERE d < 2), m AS (SELECT id, min(d) AS depth FROM b GROUP BY id) SELECT depth::INT AS depth, role, count(*) AS n FROM roles JOIN m USING (id) GROUP BY ALL")
def roles_by_depth(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    text = lambda df: df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    depth = extract.bfs_members(text(g.vertices.agg(F.min("id").alias("handle"))), text(g.edges.toDF("source", "target")), text(g.vertices.toDF("handle")))
    return layers.roles_by_depth(g.roles().withColumn("id", F.col("id").cast("string")), depth.select(F.col("handle").alias("id"), "depth"))


@query("inside_outside", f"WITH {V.GRAPH}, s AS (SELECT id FROM gv WHERE id % 7 = 1), n AS (SELECT DISTINCT dst FROM both_ways WHERE src IN (SELECT id FROM s)) SELECT CASE WHEN dst IN (SELECT id FROM s) THEN 'inside' ELSE 'outside' END AS \"where\", count(*) AS n FROM n GROUP BY 1")
def inside_outside(spark: SparkSession, sf: str) -> DataFrame:
    g = V.forward_graph(spark, sf)
    return graph.inside_outside(g.edges, g.vertices.filter("id % 7 = 1"))


@query("minority_integration", f"WITH {V.MEMBERS}, e AS (SELECT src, dst FROM both_ways JOIN cls a ON a.id = src JOIN cls b ON b.id = dst WHERE a.cls = 'click' AND b.cls = 'view'), p AS (SELECT src, count(*) AS n FROM e GROUP BY src), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, src) AS r FROM p), h AS (SELECT arg_min(community, (-c, community)) AS home FROM (SELECT community, count(*) AS c FROM mem JOIN cls USING (id) WHERE cls = 'click' GROUP BY 1)) SELECT sum(n)::BIGINT AS n_edges, count(*) AS n_members, median(n)::DOUBLE AS median_contacts, round(sum(n) FILTER (WHERE r <= 5) / sum(n), 6) AS top5_share, (SELECT count(DISTINCT dst) FROM e) AS n_contacts, (SELECT home FROM h) AS home FROM r")
def minority_integration(spark: SparkSession, sf: str) -> DataFrame:
    return graph.integration(V.forward_graph(spark, sf).edges, _membership(spark, sf), V.classes(spark, sf), "click", "view")


@query(
    "term_overlap",
    """WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nl}\\p{No}]{3,}')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL), t AS (SELECT lang, term FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS r FROM c) WHERE r <= 120),
    a AS (SELECT term FROM t WHERE lang = 'en'), b AS (SELECT term FROM t WHERE lang = 'fr') SELECT (SELECT count(*) FROM a WHERE term IN (FROM b)) AS shared, (SELECT count(*) FROM a WHERE term NOT IN (FROM b)) AS only_a, (SELECT count(*) FROM b WHERE term NOT IN (FROM a)) AS only_b, round((SELECT count(*) FROM a WHERE term IN (FROM b)) / (SELECT count(*) FROM (FROM a UNION FROM b)), 6) AS jaccard""",
)
def term_overlap(spark: SparkSession, sf: str) -> DataFrame:
    terms, _ = extract.channel_terms(V.docs(spark, sf).withColumn("channel", F.col("cls")))
    o = layers.term_overlap(terms.select(F.col("channel").alias("community"), "term"), "en", "fr")
    return o.select(F.size("shared").cast("long").alias("shared"), F.size("only_a").cast("long").alias("only_a"), F.size("only_b").cast("long").alias("only_b"), "jaccard")


@query("expected_mann_whitney", "WITH s AS (SELECT c_custkey, c_acctbal AS v, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 END AS g FROM customer), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS r FROM s WHERE g IS NOT NULL) SELECT round(sum(r) FILTER (WHERE g = 1) - count(*) FILTER (WHERE g = 1) * (count(*) FILTER (WHERE g = 1) + 1) / 2, 1)::DOUBLE AS u, count(*) FILTER (WHERE g = 1) AS n1, count(*) FILTER (WHERE g = 2) AS n2 FROM r")
def expected_mann_whitney(spark: SparkSession, sf: str) -> DataFrame:
    got = stats.mann_whitney(_accounts(spark, sf), "c_mktsegment", "x", "BUILDING", "MACHINERY")
    return spark.createDataFrame([(None if got["u"] is None else round(float(got["u"]), 1), got["n1"], got["n2"])], "u double, n1 long, n2 long")
