"""Substring deduplication over a log-structured fingerprint index.

Of every window of ``WINDOW`` words the least ``GRAM``-word hash inside it is its fingerprint; equal
windows have equal fingerprints, and few positions are chosen, so the index holds about one entry per
14 words. Each batch of documents becomes a sorted immutable run (fingerprint, count). A batch is
merge-joined with the runs before it: its fingerprints that an earlier run holds, and those that it
holds twice itself, nominate windows. Nominated windows, in this batch and in the earlier documents,
are verified by a second hash over all their words, counted with map-side combination (with the
fingerprint 128 bits in all). Then compaction merges the runs. ``dedup`` with an ``index_path`` goes on
with the index that it finds there: a manifest names the live runs and the earlier documents kept for
verification, and its next version is written last, so a failed call leaves the index as it was.

A word goes if a window that occurs anywhere else covers it, the first occurrence of the batch
included; earlier batches aren't rewritten. Nulls have no words; repeated rows are documents of their
own, so each one's windows repeat in the others; a null doc_id is kept and told apart by its text.
There are no ties to break. Texts of any length are handled in whole, in blocks of documents. Other
columns, whatever their names, are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.bytewords import Words, among, as_long, pack, pack_rows, unpack, window_hashes
from echograph.llm.quality import row_key
from echograph.llm.tokens import text_blocks
from echograph.session import materialise, new_path

WINDOW = 35
GRAM = 8
BATCHES = 2
BLOCK_CHARS = 500_000
_SEED = 5


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every ``width`` neighbours, by doubling."""
    have, size = values, 1
    while size * 2 <= width:
        have, size = pick(have[:-size], have[size:]), size * 2
    return have if size == width else pick(have[: len(values) - width + 1], have[width - size :][: len(values) - width + 1])


class Block:
    """Windows of some texts: words, fingerprints of windows, and which starts are windows."""

    def __init__(self, texts: list[str], window: int = WINDOW, gram: int = GRAM):
        self.words = words = Words(texts, "space")
        n = len(words.start)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(words.first))
        self.window, self.gram, self.per = window, gram, window - gram + 1
        if n < window:
            self.grams = self.least = np.zeros(0, np.uint64)
            self.valid = np.zeros(0, bool)
            return
        self.grams = window_hashes(words.hashes(_SEED), gram, _SEED + 1)
        self.least = _sliding(self.grams, self.per, np.minimum)
        self.valid = self.doc[: n - window + 1] == self.doc[window - 1 :]

    def chosen(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, fingerprint, places) of the grams that are least in some window."""
        if not self.valid.any():
            return (np.zeros(0, np.int64),) * 3
        pad = np.zeros(self.per - 1, np.uint64)
        best = _sliding(np.concatenate([pad, np.where(self.valid, self.least, 0), pad]), self.per, np.maximum)
        at = np.flatnonzero(best == self.grams)
        doc, fp = self.doc[at], self.grams[at]
        order = np.lexsort((fp, doc))
        doc, fp = doc[order], fp[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (fp[1:] != fp[:-1])]))
        return doc[first], fp[first], np.diff(np.append(first, len(doc)))

    def full_hashes(self) -> np.ndarray:
        return window_hashes(self.words.hashes(_SEED + 2), self.window, _SEED + 3)


def _fingerprint_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        own, text, runs = (batch.column(c).to_numpy() for c in ("_id", "_text", "run"))
        for a, b in text_blocks(texts, BLOCK_CHARS):
            doc, fp, n = Block(texts[a:b]).chosen()
            yield pa.RecordBatch.from_arrays(
                [pa.array(runs[a:b][doc]), as_long(fp), pa.array(own[a:b][doc]), pa.array(text[a:b][doc]), pa.array(n.astype(np.int32))], ["run", "fp", "_id", "_text", "n"]
            )


_PLACES = "fp long, _id long, _text long, n int"


class FingerprintIndex:
    """Sorted immutable runs of (fp, n) below ``path``, and of the documents before: their places
    (fp, _id, _text, n) and texts. Opening it reads the latest manifest."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.version = spark, path, -1
        self.runs: list[str] = []
        self.batches: list[str] = []
        try:
            stored = spark.read.parquet(f"{path}/manifest")
        except AnalysisException:  # a new index
            return
        self.version = stored.agg(F.max(F.col("version").cast("int"))).first()[0]
        for row in stored.filter(F.col("version") == self.version).orderBy("place").collect():
            (self.runs if row.kind == "run" else self.batches).append(row.name)

    def commit(self) -> None:
        """The state as a new version of the manifest: a row for each run and batch."""
        rows = [(k, kind, name) for k, (kind, name) in enumerate([("run", r) for r in self.runs] + [("batch", b) for b in self.batches])]
        self.version += 1
        self.spark.createDataFrame(rows, "place int, kind string, name string").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/manifest/version={self.version}")

    def _write(self, rows: DataFrame) -> str:
        run = new_name(self.spark, "run")
        rows.sortWithinPartitions("fp").write.parquet(f"{self.path}/{run}")
        return run

    def _read(self, run: str) -> DataFrame:
        return self.spark.read.schema("fp long, n long").parquet(f"{self.path}/{run}")

    def append(self, fingerprints: DataFrame) -> DataFrame:
        """A batch's (fp, n) rows as a new run. Gives the fps of the batch that repeat: those it holds
        twice, and those it shares with an earlier run, merge-joined run by run. An fp may come up more than once."""
        earlier = list(self.runs)
        self.runs.append(self._write(fingerprints.groupBy("fp").agg(F.sum("n").cast("long").alias("n"))))
        new = self._read(self.runs[-1])
        out = new.filter("n > 1").select("fp")
        for run in earlier:
            out = out.unionByName(new.select("fp").join(self._read(run).hint("merge").select("fp"), "fp", "left_semi"))
        return out

    def compact(self) -> None:
        """All runs merged into one; the old ones are no longer referred to."""
        if len(self.runs) > 1:
            rows = self._read(self.runs[0])
            for run in self.runs[1:]:
                rows = rows.unionByName(self._read(run))
            self.runs = [self._write(rows.groupBy("fp").agg(F.sum("n").alias("n")))]

    def keep(self, places: DataFrame, texts: DataFrame) -> None:
        """A batch's places and texts, for the verification of later ones."""
        batch = new_name(self.spark, "batch")
        places.select("fp", "_id", "_text", "n").write.parquet(f"{self.path}/{batch}/places")
        texts.select("_id", "_text", "text").write.parquet(f"{self.path}/{batch}/texts")
        self.batches.append(batch)

    def earlier(self, kind: str, schema: str) -> list[DataFrame]:
        return [self.spark.read.schema(schema).parquet(f"{self.path}/{b}/{kind}") for b in self.batches]


def new_name(spark: SparkSession, name: str) -> str:
    return new_path(spark, name).rsplit("/", 1)[1]


def _nominated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, _id, _text, start, hashes): runs of nominated windows with one fingerprint, their full hashes packed."""
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        own, text = batch.column("_id").to_numpy(), batch.column("_text").to_numpy()
        wanted = batch.column("fps").to_pylist()
        for a, b in text_blocks(texts, BLOCK_CHARS):
            block = Block(texts[a:b])
            n = len(block.valid)
            pick = np.zeros(n, bool)
            for d in range(b - a):
                lo, hi = int(block.words.first[d]), min(int(block.words.first[d + 1]), n)
                if lo < hi:
                    pick[lo:hi] = np.isin(block.least[lo:hi], np.array(wanted[a + d], np.int64).view(np.uint64))
            at = np.flatnonzero(pick & block.valid)
            if not len(at):
                continue
            least, doc = block.least[at], block.doc[at]
            first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])]))
            head, whose = at[first], doc[first]
            start = (head - block.words.first[whose]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [as_long(block.least[head]), pa.array(own[a:b][whose]), pa.array(text[a:b][whose]), pa.array(start), pack(block.full_hashes()[at], first)], ["fp", "_id", "_text", "start", "hashes"]
            )


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(fp, h, n): the windows of each run, those of one batch added up."""
    for batch in batches:
        h, row = unpack(batch.column("hashes"))
        fp, n = batch.column("fp").to_numpy()[row], batch.column("n").to_numpy()[row]
        order = np.lexsort((h, fp))
        fp, h, n = fp[order], h[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        total = np.add.reduceat(n, first) if len(first) else n
        yield pa.RecordBatch.from_arrays([pa.array(fp[first]), as_long(h[first]), pa.array(total)], ["fp", "h", "n"])


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_id, _text, start, n): runs of windows that are among the repeated ones of their fingerprint."""
    for batch in batches:
        h, row = unpack(batch.column("hashes"))
        found, of = unpack(batch.column("found"))
        if not len(h):
            continue
        hit = among(h, row, found, of, batch.num_rows)
        at = np.flatnonzero(hit)
        if not len(at):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (row[at][1:] != row[at][:-1])]))
        head = at[new]
        place = head - np.searchsorted(row, row[head])
        own, text, start = (batch.column(c).to_numpy() for c in ("_id", "_text", "start"))
        whose = row[head]
        yield pa.RecordBatch.from_arrays([pa.array(own[whose]), pa.array(text[whose]), pa.array(start[whose] + place), pa.array(np.diff(np.append(new, len(at))))], ["_id", "_text", "start", "n"])


_RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def _kept_rows(with_text: bool, window: int = WINDOW):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[], [], [], []]
            for text, marks in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if marks:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.array([m["start"] for m in marks])
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + np.array([m["n"] for m in marks]) + window - 1, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()]
                joined = b" ".join(kept)
                for column, value in zip(columns, (len(words), len(words) - len(kept), hashlib.sha256(joined).hexdigest(), joined.decode() if with_text else None)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return run


def dedup(docs: DataFrame, batches: int = BATCHES, with_text: bool = False, index_path: str | None = None) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256, kept_text (null unless asked for). The documents
    go through the index in ``batches``; with an ``index_path`` they come after those that it has seen."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", *row_key(F.col("text")), "text")
    run = F.pmod(F.shiftright(F.xxhash64("_id", "_text"), 7), F.lit(batches)).cast("int")
    path = new_path(spark, "fingerprints")
    rows.select("_id", "_text", "text", run.alias("run")).mapInArrow(_fingerprint_rows, f"run int, {_PLACES}").write.partitionBy("run").parquet(path)
    places = spark.read.schema(f"{_PLACES}, run int").parquet(path)
    index = FingerprintIndex(spark, index_path or new_path(spark, "fingerprint-index"))
    every, texts = [places.drop("run"), *index.earlier("places", _PLACES)], [rows.drop("doc_id"), *index.earlier("texts", "_id long, _text long, text string")]
    repeated = [index.append(places.filter(F.col("run") == k).select("fp", "n")) for k in range(batches)]
    twice = materialise(reduce(DataFrame.unionByName, repeated).distinct(), "repeated-fingerprints")
    wanted = reduce(DataFrame.unionByName, every).join(twice, "fp").groupBy("_id", "_text").agg(F.collect_set("fp").alias("fps"))
    nominated = reduce(DataFrame.unionByName, texts).join(wanted, ["_id", "_text"]).mapInArrow(_nominated, "fp long, _id long, _text long, start long, hashes binary")
    nominated = materialise(nominated, "nominated")
    alike = nominated.groupBy("fp", "hashes").agg(F.count("*").alias("n")).mapInArrow(_windows, "fp long, h long, n long")
    again = alike.groupBy("fp", "h").agg(F.sum("n").alias("n")).filter("n > 1").select("fp", "h")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialise(again.repartition(n, "fp").sortWithinPartitions("fp").mapInArrow(pack_rows("fp", "h", "found"), "fp long, found binary"), "repeated-windows")
    # Both sides are stored tables, so that the join can split a fingerprint with many places.
    marks = nominated.join(found, "fp").mapInArrow(_marks, "_id long, _text long, start long, n long")
    marks = marks.groupBy("_id", "_text").agg(F.collect_set(F.struct("start", "n")).alias("marks"))
    out = rows.join(marks, ["_id", "_text"], "left").select("doc_id", "text", "marks")
    index.compact()
    if index_path:
        index.keep(places, rows)
        index.commit()
    return out.mapInArrow(_kept_rows(with_text), _RESULT)


def op5_fingerprint_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept_text")
