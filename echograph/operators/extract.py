"""From posts to declared edges, channel statistics, duplicates and membership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import text as T
from echograph.session import materialise


def canonicalise(df: DataFrame, col: str, aliases: DataFrame) -> DataFrame:
    """col replaced by its canonical handle where (alias, canonical) knows it; lower case either way."""
    named = aliases.select(F.lower("alias").alias("_alias"), F.lower("canonical").alias("_canonical")).dropDuplicates(["_alias"])
    return df.withColumn(col, F.lower(col)).join(named, F.col(col) == F.col("_alias"), "left").withColumn(col, F.coalesce("_canonical", col)).drop("_alias", "_canonical")


def alias_attribute(df: DataFrame, key: str, attributes: DataFrame, aliases: DataFrame, value: str) -> DataFrame:
    """value by exact handle, else by any alias of it, the least alias first."""
    direct = attributes.select(F.col("handle").alias(key), F.col(value).alias("_exact"))
    via = aliases.join(attributes.withColumnRenamed("handle", "alias"), "alias").groupBy(F.col("canonical").alias(key)).agg(F.min_by(value, "alias").alias("_alias"))
    return df.join(direct, key, "left").join(via, key, "left").withColumn(value, F.coalesce("_exact", "_alias")).drop("_exact", "_alias")


def raw_mentions(posts: DataFrame, visible_urls: bool = False) -> DataFrame:
    """(channel, msg_id, handle, method), a row per message, handle and method. Hidden links count by their
    first match; visible ones only if asked for."""
    e = F.col("entities")
    hidden = F.filter(F.transform(F.filter(e, lambda x: x["type"] == "MessageEntityTextUrl"), lambda x: F.lower(F.regexp_extract(F.coalesce(x["url"], F.lit("")), T.LINK, 1))), lambda h: h != "")
    named = F.transform(F.filter(e, lambda x: x["type"] == "MessageEntityMention"), lambda x: F.lower(F.regexp_replace(T.utf16_slice(F.col("text"), x["offset"], x["length"]), "^@+", "")))
    named = F.filter(named, lambda h: h != "")
    found = [("mention", T.mentions(F.col("text"))), ("link", T.links(F.col("text"))), ("text_url", hidden), ("entity", named)]
    if visible_urls:
        found.append(("url", F.flatten(F.transform(F.filter(e, lambda x: x["type"] == "MessageEntityUrl"), lambda x: T.links(T.utf16_slice(F.col("text"), x["offset"], x["length"]))))))
    none = F.array().cast("array<string>")

    def tagged(handles: Column, method: str) -> Column:
        return F.transform(F.coalesce(handles, none), lambda h: F.struct(h.alias("handle"), F.lit(method).alias("method")))

    entries = F.flatten(F.array(*[tagged(handles, method) for method, handles in found]))
    return posts.select("channel", "msg_id", F.inline(F.array_distinct(entries)))


def mention_edges(mentions: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(source, target, methods, n_msgs). Handles are made distinct per message before aliases fold, so two
    aliases of one channel in a message count twice; a channel's own handles don't count."""
    per = mentions.groupBy("channel", "msg_id", "handle").agg(F.collect_set("method").alias("m"))
    per = per.withColumnRenamed("handle", "target")
    if aliases is not None:
        per = canonicalise(per, "target", aliases)
    return per.filter("channel <> target").groupBy(F.col("channel").alias("source"), "target").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("m")))).alias("methods"), F.count("*").alias("n_msgs"))


def message_mentions(mentions: DataFrame, members: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """(channel, msg_id, targets): the distinct member channels a message names, not itself."""
    named = mentions.select("channel", "msg_id", F.col("handle").alias("target"))
    if aliases is not None:
        named = canonicalise(named, "target", aliases)
    named = named.filter("channel <> target").join(members.select(F.col("handle").alias("target")), "target", "left_semi")
    return named.groupBy("channel", "msg_id").agg(F.array_sort(F.collect_set("target")).alias("targets"))


def forward_edges(posts: DataFrame, id_map: DataFrame) -> DataFrame:
    """(origin, target, count, origin_resolved, first_src_date, last_src_date, target_msg_id). Sources that
    are no channels make no edge; unknown ids stay as id:NNN."""
    src = posts.filter("fwd_from.source_channel_id is not null").select(F.col("fwd_from.source_channel_id").alias("sid"), F.col("channel").alias("target"), "msg_id", F.col("fwd_from.source_date").alias("src_ts"))
    named = src.join(id_map.select(F.col("channel_id").alias("sid"), F.col("handle").alias("h")).dropDuplicates(["sid"]), "sid", "left")
    origin = F.coalesce("h", F.concat(F.lit("id:"), F.col("sid").cast("string")))
    return named.groupBy(origin.alias("origin"), "target").agg(
        F.count("*").alias("count"), F.bool_or(F.col("h").isNotNull()).alias("origin_resolved"), F.min("src_ts").alias("first_src_date"), F.max("src_ts").alias("last_src_date"), F.max("msg_id").alias("target_msg_id")
    )


def with_permalink(edges: DataFrame) -> DataFrame:
    return edges.withColumn("post_url", T.permalink(F.col("target"), F.col("target_msg_id")))


def channel_stats(posts: DataFrame) -> DataFrame:
    """Per channel: message counts by kind, distinct forward sources, dates, median views cut to a whole
    number, reactions, and posts with an album counted once."""
    return posts.groupBy("channel").agg(
        F.count("*").alias("n_msgs"), F.count_if(T.has_text(F.col("text"))).alias("n_text_msgs"), F.count_if(F.coalesce("has_media", F.lit(False))).alias("n_media_msgs"), F.count_if("is_fwd").alias("n_forward_msgs"),
        F.count_distinct("fwd_from.source_channel_id").alias("n_fwd_sources"), F.min("ts").alias("first_date"), F.max("ts").alias("last_date"),
        F.median("views").cast("long").alias("median_views"), F.sum("reactions").alias("reactions"), (F.count_if(F.col("grouped_id").isNull()) + F.count_distinct("grouped_id")).alias("n_posts"),
    )


def hour_histogram(posts: DataFrame) -> DataFrame:
    """(channel, modal_hour, n, hist): 24 counts; the lowest hour wins ties; undated posts don't count."""
    per = posts.filter("ts is not null").groupBy("channel", F.hour("ts").alias("h")).agg(F.count("*").alias("c"))
    counts = F.map_from_entries(F.collect_list(F.struct("h", "c")))
    return per.groupBy("channel").agg(F.max_by("h", F.struct("c", -F.col("h"))).alias("modal_hour"), F.sum("c").alias("n"), counts.alias("m")).select(
        "channel", "modal_hour", "n", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.coalesce(F.element_at("m", h), F.lit(0))).alias("hist")
    )


def channel_type(posts: DataFrame, channels: DataFrame, look: int = 20) -> DataFrame:
    """empty, channel (a post among the newest few messages) or group."""
    newest = Window.partitionBy("channel").orderBy(F.desc("ts"), F.desc("msg_id"))
    head = posts.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= look).groupBy("channel").agg(F.bool_or(F.coalesce("post", F.lit(False))).alias("_post"))
    return channels.join(head, "channel", "left").withColumn("type", F.when(F.col("_post").isNull(), "empty").when(F.col("_post"), "channel").otherwise("group")).drop("_post")


def sample_texts(posts: DataFrame, per_channel: int = 50, min_chars: int = 20, seed: int = 42, authored: bool = True) -> DataFrame:
    """A repeatable sample: the texts first in the order of a seeded hash."""
    rows = posts.filter(F.length(F.trim("text")) >= min_chars)
    rows = rows.filter("not is_fwd") if authored else rows
    order = Window.partitionBy("channel").orderBy(F.xxhash64(F.lit(seed), "channel", "msg_id"), "msg_id")
    return rows.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= per_channel).drop("_n")


def dominant_language(detected: DataFrame) -> DataFrame:
    """(channel, lang, prob) rows of a detector to (channel, language, lang_confidence, sample_size): majority,
    ties alphabetical; confidence is the mean of the top probabilities."""
    per = detected.groupBy("channel", "lang").agg(F.count("*").alias("c"), F.sum("prob").alias("p"))
    per = per.groupBy("channel").agg(F.min_by("lang", F.struct(-F.col("c"), "lang")).alias("language"), F.sum("p").alias("p"), F.sum("c").alias("sample_size"))
    return per.select("channel", "language", F.round(F.col("p") / F.col("sample_size"), 3).alias("lang_confidence"), "sample_size")


def detect(texts: DataFrame, detector) -> DataFrame:
    """Run a detector, batch of strings to (language, probability) pairs, over Arrow batches."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            got = detector(pdf["text"].tolist())
            yield pd.DataFrame({"channel": pdf["channel"], "lang": [g[0] for g in got], "prob": [g[1] for g in got]})

    return texts.select("channel", "text").mapInPandas(run, "channel string, lang string, prob double")


def relabel(current: DataFrame, voted: DataFrame, stats: DataFrame, bucket, min_share: float = 0.4) -> DataFrame:
    """New label for heavy forwarders, only where its bucket differs: (channel, old, new, flipped)."""
    heavy = stats.filter(F.col("n_forward_msgs") >= min_share * F.col("n_msgs")).select("channel")
    new = voted.join(heavy, "channel", "left_semi").select("channel", F.col("language").alias("_new"))
    flips = F.col("_new").isNotNull() & ~bucket(F.col("_new")).eqNullSafe(bucket(F.col("language")))
    return current.join(new, "channel", "left").select("channel", F.col("language").alias("old"), F.when(flips, F.col("_new")).otherwise(F.col("language")).alias("new"), flips.alias("flipped"))


def flip_matrix(relabelled: DataFrame) -> DataFrame:
    return relabelled.filter("flipped").groupBy("old", "new").agg(F.count("*").alias("n"))


def language_map(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """(handle, lang) folded to canonical handles: the canonical row wins, then the least alias."""
    named = rows.withColumn("_raw", F.lower("handle"))
    folded = canonicalise(named.withColumn("handle", F.col("_raw")), "handle", aliases)
    return folded.groupBy("handle").agg(F.min_by("lang", F.struct(F.col("_raw") != F.col("handle"), "_raw")).alias("lang"))


def duplicate_clusters(posts: DataFrame, min_chars: int = 80) -> DataFrame:
    """(hash, n_channels, n_msgs, channel, msg_id): normalised texts of min_chars or more found in two
    channels or more, a row for each occurrence, so that a text of any number of posts fits."""
    rows = posts.withColumn("norm", T.normalise(F.col("text"))).filter(F.length("norm") >= min_chars).select(F.md5("norm").alias("hash"), "channel", "msg_id")
    shared = rows.groupBy("hash").agg(F.count_distinct("channel").alias("n_channels"), F.count("*").alias("n_msgs")).filter("n_channels >= 2")
    return rows.join(shared, "hash").select("hash", "n_channels", "n_msgs", "channel", "msg_id")


def unique_texts(posts: DataFrame, min_chars: int = 100, truncate: int = 400) -> tuple[DataFrame, DataFrame]:
    """(texts, occurrences). A text's representative is its first occurrence by channel, newest message first."""
    keyed = posts.withColumn("key", T.content_key(F.col("text"), min_chars, truncate)).filter("key is not null")
    order = F.struct("channel", (-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("msg_id")).alias("m"))
    texts = keyed.groupBy("key").agg(F.min_by(F.struct("channel", "msg_id", F.substring("text", 1, truncate).alias("text")), order).alias("r"), F.count("*").alias("n_occurrences"), F.count_distinct("channel").alias("n_channels"))
    return texts.select("key", "r.*", "n_occurrences", "n_channels"), keyed.select("key", "channel", "msg_id", "ts", *[c for c in ("is_fwd",) if c in posts.columns])


def encode_missing(texts: DataFrame, cache: DataFrame, encoder, dims: str = "array<float>") -> DataFrame:
    """(key, vec): cached vectors are reused, only the other texts go through ``encoder`` (strings to rows)."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "vec": list(encoder(pdf["text"].tolist()))})

    known = cache.select("key", "vec").dropDuplicates(["key"])
    fresh = texts.select("key", "text").join(known, "key", "left_anti").mapInPandas(run, f"key string, vec {dims}")
    return texts.select("key").join(known, "key").select("key", "vec").unionByName(fresh)


def channel_terms(posts: DataFrame, stop: DataFrame | None = None, top: int = 120) -> tuple[DataFrame, DataFrame]:
    """(terms, totals): the top terms of each channel and its number of tokens, stop words counted in it."""
    words = posts.select("channel", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("channel", "term").agg(F.count("*").alias("n"))
    totals = words.groupBy("channel").agg(F.sum("n").alias("n_tokens"))
    kept = words if stop is None else words.join(stop.select("term"), "term", "left_anti")
    order = Window.partitionBy("channel").orderBy(F.desc("n"), "term")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top), totals


def bfs_members(seeds: DataFrame, edges: DataFrame, has_data: DataFrame, max_depth: int = 2) -> DataFrame:
    """(handle, depth, origins, has_data): breadth first from the seeds; only nodes with data expand; the
    first depth wins; origins are the first discoverers, eight at most, in order."""
    held = has_data.select("handle").distinct()
    out = materialise(seeds.select("handle").distinct().select("handle", F.lit(0).alias("depth"), F.array().cast("array<string>").alias("origins")), "bfs")
    frontier = out
    clean = edges.filter(~F.col("target").isin(T.RESERVED)).select("source", "target").distinct()
    for depth in range(1, max_depth + 1):
        step = frontier.join(held, "handle", "left_semi").select(F.col("handle").alias("source")).join(clean, "source")
        found = step.join(out.select(F.col("handle").alias("target")), "target", "left_anti").groupBy(F.col("target").alias("handle"))
        frontier = materialise(found.agg(F.slice(F.array_sort(F.collect_set("source")), 1, 8).alias("origins")).select("handle", F.lit(depth).alias("depth"), "origins"), "bfs")
        out = out.unionByName(frontier)
    return out.join(held.withColumn("has_data", F.lit(True)), "handle", "left").na.fill(False, ["has_data"])


def gap_report(members: DataFrame, errors: DataFrame) -> DataFrame:
    """Discovered without data: (handle, depth, origins, status), failed or unattempted."""
    failed = errors.select("handle").distinct().withColumn("_f", F.lit(True))
    gap = members.filter("not has_data").join(failed, "handle", "left")
    return gap.select("handle", "depth", "origins", F.when(F.col("_f"), "failed").otherwise("unattempted").alias("status"))


def resolve(col: Column) -> Column:
    """False for an origin that stayed an id."""
    return ~T.unresolved(col)
