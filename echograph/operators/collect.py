"""Collection-side tables: the work queue, the channel registry, the error registry."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.functions import ordering


def merge_queue(queue: DataFrame, discovered: DataFrame) -> DataFrame:
    """(handle, is_seed, status) after new handles join: known ones keep their status, a seed flag spreads
    to them, a skipped seed is pending again, unknown ones are pending."""
    new = discovered.groupBy("handle").agg(F.max(F.coalesce("is_seed", F.lit(False))).alias("_seed"))
    both = queue.join(new, "handle", "full_outer")
    seed = F.coalesce("is_seed", F.lit(False)) | F.coalesce("_seed", F.lit(False))
    status = F.when(F.col("status").isNull(), "pending").when(seed & (F.col("status") == "skipped"), "pending").otherwise(F.col("status"))
    return both.select("handle", seed.alias("is_seed"), status.alias("status"))


def prefilter(queue: DataFrame, registry_handles: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pending handles that are no seeds and are registered or known to fail are skipped. Returns the queue
    and the error registry, whose attempts go up for what was skipped because of it."""
    known = registry_handles.select("handle").distinct().withColumn("_known", F.lit(True))
    bad = errors.select("handle").distinct().withColumn("_bad", F.lit(True))
    open_ = (F.col("status") == "pending") & ~F.col("is_seed")
    joined = queue.join(known, "handle", "left").join(bad, "handle", "left")
    by_error = open_ & F.col("_known").isNull() & F.col("_bad").isNotNull()
    out = joined.withColumn("_hit", by_error).withColumn("status", F.when(open_ & (F.col("_known").isNotNull() | F.col("_bad").isNotNull()), "skipped").otherwise(F.col("status")))
    hits = out.filter("_hit").select("handle", F.lit(1).alias("_more"))
    bumped = errors.join(hits, "handle", "left").withColumn("attempt_count", F.col("attempt_count") + F.coalesce("_more", F.lit(0))).drop("_more")
    return out.drop("_known", "_bad", "_hit"), bumped


def upsert_registry(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """registry and seen: (channel_id, handles, title, discoveries, last_scraped_step, last_scraped_tag,
    last_scraped_at). The latest scrape gives title (if it has one), step, tag and time; handles keep their
    order, new ones last; discoveries unite."""
    rows = registry.withColumn("_new", F.lit(0)).unionByName(seen.withColumn("_new", F.lit(1)))
    order = F.struct("_new", "last_scraped_at", "last_scraped_step")
    last = F.struct("last_scraped_step", "last_scraped_tag", "last_scraped_at")
    grouped = rows.groupBy("channel_id").agg(
        F.max_by("title", F.when(F.col("title").isNotNull(), order)).alias("title"), F.max_by(last, order).alias("last"),
        F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("handles").alias("h"), F.col("discoveries").alias("d")))).alias("rows"),
    )
    return grouped.select(
        "channel_id", F.array_distinct(F.flatten(F.transform("rows", lambda x: x["h"]))).alias("handles"), "title",
        F.array_sort(F.array_distinct(F.flatten(F.transform("rows", lambda x: x["d"])))).alias("discoveries"), "last.*",
    )


def migrate_registry(old: DataFrame) -> DataFrame:
    """Records with one first sighting get a list of discoveries."""
    first = F.array(F.struct(F.col("first_seen_tag").alias("tag"), F.col("first_seen_step").alias("step")))
    return old.withColumn("discoveries", F.coalesce("discoveries", first)).drop("first_seen_tag", "first_seen_step")


def credit_discoveries(registry: DataFrame, handles: DataFrame, tag: str, step: int) -> DataFrame:
    """(tag, step) is added to the channels of known handles; unknown handles change nothing."""
    found = registry.select("channel_id", F.explode("handles").alias("handle")).join(handles.select("handle").distinct(), "handle", "left_semi").select("channel_id").distinct().withColumn("_hit", F.lit(True))
    credit = F.array(F.struct(F.lit(tag).alias("tag"), F.lit(step).alias("step")))
    return registry.join(found, "channel_id", "left").withColumn("discoveries", F.when(F.col("_hit"), F.array_union("discoveries", credit)).otherwise(F.col("discoveries"))).drop("_hit")


def upsert_errors(errors: DataFrame, failures: DataFrame) -> DataFrame:
    """errors: (handle, first_seen_step, first_seen_tag, seen_in_tags, attempt_count, last_attempt_at,
    last_error); failures: (handle, tag, step, at, error). What was seen first stays, tags unite, attempts
    add up, and the last error that is not null stands."""
    order = F.struct("at", "step", "tag")
    new = failures.groupBy("handle").agg(
        F.collect_set("tag").alias("_tags"), F.count("*").alias("_n"), F.max_by("error", F.when(F.col("error").isNotNull(), order)).alias("_error"),
        F.min_by(F.struct("step", "tag"), order).alias("_first"), F.max("at").alias("_at"),
    )
    none = F.array().cast("array<string>")
    old = F.col("attempt_count").isNotNull()
    return errors.join(new, "handle", "full_outer").select(
        "handle", F.when(old, F.col("first_seen_step")).otherwise(F.col("_first.step")).alias("first_seen_step"), F.when(old, F.col("first_seen_tag")).otherwise(F.col("_first.tag")).alias("first_seen_tag"),
        F.array_sort(F.array_union(F.coalesce("seen_in_tags", none), F.coalesce("_tags", none))).alias("seen_in_tags"),
        (F.coalesce("attempt_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("attempt_count"),
        F.greatest("last_attempt_at", "_at").alias("last_attempt_at"), F.coalesce("_error", "last_error").alias("last_error"),
    )


def status_summary(queue: DataFrame, duration: str = "duration_s") -> DataFrame:
    """Per status the number of handles and the upper median of the durations."""
    counts = queue.groupBy("status").agg(F.count("*").alias("n"))
    return counts.join(ordering.middle(queue, ["status"], duration, "median_duration"), "status", "left")


def in_window(messages: DataFrame, start, end, col: str = "date") -> DataFrame:
    """Half open: start included, end not."""
    return messages.filter((F.col(col) >= F.lit(start).cast("timestamp")) & (F.col(col) < F.lit(end).cast("timestamp")))


def project_messages(messages: DataFrame) -> DataFrame:
    """Messages as the pipeline reads them: a forward flag, reactions summed, headers kept nested."""
    reactions = F.aggregate(F.map_values("reactions_json"), F.lit(0).cast("long"), lambda a, x: a + x)
    return messages.select(
        "channel", F.col("id").alias("msg_id"), F.col("date").alias("ts"), F.coalesce("message", F.lit("")).alias("text"), "views", "has_media", "grouped_id", "post",
        F.col("entities_json").alias("entities"), "fwd_from", F.col("fwd_from").isNotNull().alias("is_fwd"), F.coalesce(reactions, F.lit(0)).alias("reactions"),
    )
