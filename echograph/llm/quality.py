"""Quality rules with cross-document line frequency, native Spark only.

Base rules judge a text by itself. The corpus rule hashes normalised lines, counts the distinct
documents of each host (``source``) that hold a line, and takes a line away if more than ``min_docs``
have it, however large the host is; a document with too little of its words left is depleted and
rejected. A document is a doc_id with a text: copies under other ids count as documents of their own,
so text that one host repeats in more than ``min_docs`` documents goes, whole copies included.

Nulls: a null text has no words and fails; a null host is a host of its own; a null doc_id is an id
like any other. Rows that repeat id and text count once and get equal results. A text without line
breaks, however long, is one line. Ties can't arise: nothing is ranked. Empty tables give no rows.
``judge`` reads doc_id, text and source only; ``clean`` packs all columns, so any names may occur.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.session import materialise

#: A line is common if more documents of its host than this have it.
MIN_DOCS = 10
#: A document is depleted if under this share of its words is left.
MIN_LEFT = 0.2

_SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _SPACE), lambda w: w != "")


def _repeated(words: Column) -> Column:
    """Words in 3-word windows found twice or more. Windows hash to longs; sorted with their places,
    equal ones are neighbours; the places found, in order, then cover up to three words each."""
    n = F.size(words)

    def windows(w: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(w) - 3)
        return F.array_sort(F.transform(places, lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))

    def found(s: Column) -> Column:
        def twice(k: Column) -> Column:
            same = lambda x, j: F.get(k, j - 1).eqNullSafe(x["h"]) | F.get(k, j + 1).eqNullSafe(x["h"])
            return F.filter(F.transform(s, lambda x, j: F.when(same(x, j), x["i"])), lambda i: i.isNotNull())

        return F.array_sort(let(s["h"], twice))

    def covered(p: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(p, start, lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(let(windows(words), found), covered))


def base_rules(docs: DataFrame) -> DataFrame:
    """docs (with ``text``) and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    measured = docs.withColumn(
        "_m",
        let(
            _words(text),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("word_chars"),
                _repeated(w).alias("n_repeat_words"),
            ),
        ),
    ).withColumn("_d", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))))
    failed = (F.col("_m.n_words") < 50) | (100 * F.col("_m.n_repeat_words") > 50 * F.col("_m.n_words"))
    return measured.select(
        *docs.columns,
        F.col("_m.n_words").alias("n_words"),
        F.col("_m.word_chars").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.col("_d").cast("long").alias("n_dup_lines"),
        F.col("_m.n_repeat_words").alias("n_repeat_words"),
        failed.alias("base_failed"),
    )


def row_key(text: Column) -> list[Column]:
    """What tells a row from others with another id or text, for narrow joins."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("_text")]


def normal_line(line: Column) -> Column:
    """Case, outer space and runs of space don't tell lines apart."""
    return F.lower(F.trim(F.regexp_replace(line, _SPACE, " ")))


def document_lines(docs: DataFrame) -> DataFrame:
    """(host, _id, _text, line, words): a row for each line with a word, line as its hash."""
    host = F.coalesce(F.col("source").cast("string"), F.lit("\x00"))
    rows = docs.select(F.xxhash64(host).alias("host"), *row_key(F.col("text")), F.explode(F.split("text", "\n")).alias("raw"))
    return rows.select("host", "_id", "_text", normal_line(F.col("raw")).alias("clean")).filter("clean <> ''").select(
        "host", "_id", "_text", F.xxhash64("clean").alias("line"), (F.length("clean") - F.length(F.replace("clean", F.lit(" "))) + 1).alias("words")
    )


def common_lines(lines: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(host, line, n_docs) of lines above the limit. Each document counts once; the counts combine on
    the map side, so a line or host with a third of all rows doesn't meet in one task."""
    seen = lines.select("host", "line", "_id", "_text").distinct()
    return seen.groupBy("host", "line").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)


def depleted(lines: DataFrame, common: DataFrame, min_left: float = MIN_LEFT) -> DataFrame:
    """(_id, _text, left_share) of the documents that lose words, with what share is left. Repeats of
    one row weigh both sums alike."""
    hit = lines.join(common.select("host", "line", F.lit(1).alias("hit")), ["host", "line"], "left")
    per_doc = hit.groupBy("_id", "_text").agg(F.sum("words").alias("all"), F.sum(F.when(F.col("hit") == 1, F.col("words")).otherwise(0)).alias("gone"))
    return per_doc.filter("gone > 0").select("_id", "_text", ((F.col("all") - F.col("gone")) / F.col("all")).alias("left_share")).withColumn("depleted", F.col("left_share") < min_left)


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """Per row: doc_id, base measures, base_failed, left_share and kept."""
    docs = docs.select("doc_id", "text", "source")
    lines = materialise(document_lines(docs), "quality-lines")
    poor = depleted(lines, common_lines(lines, min_docs), min_left)
    base = base_rules(docs.select("doc_id", "text")).select(*row_key(F.col("text")), "*").drop("text")
    return base.join(poor, ["_id", "_text"], "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.coalesce("left_share", F.lit(1.0)).alias("left_share"),
        (~F.col("base_failed") & ~F.coalesce("depleted", F.lit(False))).alias("kept"),
    )


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that pass, all their columns, without their common lines."""
    columns = docs.columns
    lines = materialise(document_lines(docs.select("doc_id", "text", "source")), "quality-lines")
    common = materialise(common_lines(lines, min_docs), "quality-common")
    poor = depleted(lines, common, min_left)
    gone = lines.join(common, ["host", "line"], "left_semi").groupBy("_id", "_text").agg(F.collect_set("line").alias("_gone"))
    verdict = poor.join(gone, ["_id", "_text"], "left").select("_id", "_text", "depleted", "_gone")
    packed = docs.select(F.struct(*columns).alias("_row"), "doc_id", "text")
    base = base_rules(packed).filter(~F.col("base_failed")).select(*row_key(F.col("text")), "_row", "text")
    left = F.filter(F.split("text", "\n"), lambda x: ~F.array_contains(F.col("_gone"), F.xxhash64(normal_line(x))))
    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    kept = base.join(verdict, ["_id", "_text"], "left").filter(~F.coalesce("depleted", F.lit(False))).withColumn("text", text)
    new = {"text": F.col("text"), "n_chars": F.length("text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return kept.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in columns])


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
