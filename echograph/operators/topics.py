"""Class-based TF-IDF."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions.text import CALL_WORDS, JUNK_WORDS, STOP_WORDS


def stop_words(spark, extra: DataFrame | None = None) -> DataFrame:
    """Function words, boilerplate, calls to action, and what else is given (handles, other lists)."""
    words = spark.createDataFrame([(w,) for w in sorted({*STOP_WORDS, *JUNK_WORDS, *CALL_WORDS})], "term string")
    return words if extra is None else words.unionByName(extra.select("term")).distinct()


def ctfidf(terms: DataFrame, membership: DataFrame, stop: DataFrame | None = None, min_size: int = 20, k: int = 20) -> DataFrame:
    """(community, term, score, rank). terms: stored bags (id, term, n). Only communities of min_size members
    count, for df and for output; tf divides by the tokens kept; idf is ln((1 + N) / (1 + df)) + 1."""
    large = membership.groupBy("community").agg(F.count("*").alias("size")).filter(F.col("size") >= min_size).select("community")
    m = membership.join(large, "community", "left_semi").select("id", "community")
    kept = terms.filter((F.length("term") >= 3) & ~F.col("term").rlike(r"^\d+$"))
    if stop is not None:
        kept = kept.join(stop.select("term"), "term", "left_anti")
    bags = kept.join(m, "id").groupBy("community", "term").agg(F.sum("n").alias("n"))
    sums = bags.groupBy("community").agg(F.sum("n").alias("total"))
    df = bags.groupBy("term").agg(F.count("*").alias("df"))
    count = large.agg(F.count("*").alias("n_all"))
    scored = bags.join(sums, "community").join(df, "term").join(F.broadcast(count), F.lit(True))
    scored = scored.withColumn("score", F.col("n") / F.col("total") * (F.log((1 + F.col("n_all")) / (1 + F.col("df"))) + 1))
    order = Window.partitionBy("community").orderBy(F.desc(F.round("score", 12)), "term")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("community", "term", F.round("score", 8).alias("score"), "rank")
