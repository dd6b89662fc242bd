"""Benchmark decontamination by a distributed positional inverted index over the training tokens.

The index is stored: each task cuts its documents into blocks and writes, for every block and bucket of
terms, the sorted terms with their word positions, and the documents of the block. A search takes from
it the postings of the benchmark's terms, by a join on buckets that is a broadcast only where Spark
finds the term list small, and counts them over the corpus. Benchmark items travel as segments of up to
``SEGMENT`` windows. A segment goes to the blocks that hold one of the ``ANCHORS`` rarest terms of one of
its windows, by a join on terms, so what a search costs is the postings that it touches. There the lists
of each window's two rarest terms, moved back by the term's offset in the window, are intersected, and
what is left is held against the lists of all its terms: exact phrases. Proximity matches are windows
without an exact place in the document of which, around a place of one of the anchors, ``NEAR_SHARE`` of
the words stand at most ``SLOP`` words before or after where the window would lie. The driver sees no
postings, windows or items.

Words match by 64-bit hashes, a window by those of all its words. Nulls have no words; a null item_id
counts as an empty one; repeated item_ids count once; repeated documents get equal rows, and a null
doc_id is told apart by its text. Ties in rarity go by the place in the window. A text longer than a
block is a block of its own, searched whole. Empty tables give no hits or no rows. Other columns,
whatever their names, aren't read, and ``drop_contaminated`` returns them as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.bytewords import Words, among, as_long, pack, pack_rows, unpack, window_hashes
from echograph.llm.quality import row_key
from echograph.llm.tokens import text_blocks
from echograph.session import discard, materialise, new_path
from echograph.session import stored as stored_table

WINDOW = 10
SLOP = 5
NEAR_SHARE = 0.8
#: With two of ten words gone one of the three rarest is still there.
ANCHORS = 3
SEGMENT = 64
BLOCK_CHARS = 500_000
#: Buckets of terms, by the first bits of their hashes.
BUCKET_BITS = 10
SEED = 9
#: Postings of anchors that a task expands at a time.
MOST_PLACES = 1 << 19

_STORED = "bucket int, block long, terms binary, sizes binary, gaps binary, doc_ids array<long>, text_hashes array<long>, n_words array<long>"
_NAMES = ["bucket", "block", "terms", "sizes", "gaps", "doc_ids", "text_hashes", "n_words"]


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


def _gaps(positions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Ascending positions as differences, each list from 0."""
    out = np.diff(positions, prepend=0)
    out[first] = positions[first]
    return out.astype("<u4")


def _positions(gaps: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(gaps, dtype=np.int64)
    return total - np.repeat(total[first] - gaps[first], size)


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in text_blocks(texts, BLOCK_CHARS):
            words = Words(texts[a:b], "alnum")
            h = words.hashes(SEED)
            order = np.argsort(h, kind="stable")
            ranked = h[order]
            first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])) if len(h) else np.zeros(0, np.int64)
            terms, sizes = ranked[first], np.diff(np.append(first, len(h)))
            bucket = _bucket(terms)
            cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(terms) else np.zeros(0, np.int64)
            n = len(cut)
            none = pa.nulls(n, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[cut]), pa.array(np.full(n, block)), pack(terms, cut), pack(sizes.astype("<u4"), cut), pack(_gaps(order, first), first[cut]), none, none, none], _NAMES
            )
            one = pa.nulls(1, pa.binary())
            held = [pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), v) for v in (batch.column("doc_id").slice(a, b - a), batch.column("_text").slice(a, b - a), pa.array(np.diff(words.first)))]
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([block]), one, one, one, *held], _NAMES)
            block += 1


def write_index(docs: DataFrame, path: str) -> None:
    """Store the postings of all words of ``docs`` (doc_id, text) below ``path``. No shuffle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("text"))[1], F.coalesce("text", F.lit("")).alias("text"))
    rows.mapInArrow(_index_rows, _STORED).write.option("compression", "zstd").parquet(path)


def _segment_rows(window: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, texts = batch.column("item_id"), batch.column("text").to_pylist()
            for a, b in text_blocks(texts, BLOCK_CHARS):
                words = Words(texts[a:b], "alnum")
                h, n = words.hashes(SEED), np.diff(words.first)
                count = -(-np.where(n > 0, np.maximum(1, n - window + 1), 0) // most)
                item = np.repeat(np.arange(b - a), count)
                skip = (np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)) * most
                size = np.minimum(n[item] - skip, most + window - 1)
                first = np.cumsum(size) - size
                terms = h[np.repeat(words.first[item] + skip - first, size) + np.arange(int(size.sum()))]
                yield pa.RecordBatch.from_arrays([items.slice(a, b - a).take(pa.array(item)), pack(terms, first)], ["item_id", "terms"])

    return run


def segments(benchmark: DataFrame, window: int = WINDOW, most: int = SEGMENT) -> DataFrame:
    """(item_id, terms, segment): every item's windows, up to ``most`` neighbours together, as the hashes
    of their words; segment is a hash of these."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_segment_rows(window, most), "item_id string, terms binary").distinct().withColumn("segment", F.xxhash64("terms"))


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, term, segment, place) of each word of each segment."""
    for batch in batches:
        terms, row = unpack(batch.column("terms"))
        place = np.arange(len(row)) - np.searchsorted(row, row)
        yield pa.RecordBatch.from_arrays([pa.array(_bucket(terms)), as_long(terms), pa.array(batch.column("segment").to_numpy()[row]), pa.array(place.astype(np.int32))], ["bucket", "term", "segment", "place"])


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(block, terms, sizes, gaps): the wanted terms of stored rows, those of one block in a batch together."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        terms, row = unpack(batch.column("terms"))
        sizes, _ = unpack(batch.column("sizes"), np.uint32)
        gaps, _ = unpack(batch.column("gaps"), np.uint32)
        wanted, of = unpack(batch.column("wanted"))
        pick = np.flatnonzero(among(terms, row, wanted, of, batch.num_rows))
        size = sizes[pick].astype(np.int64)
        start = (np.cumsum(sizes, dtype=np.int64) - sizes)[pick]
        base = np.cumsum(size) - size
        own = gaps[np.repeat(start - base, size) + np.arange(int(size.sum()))]
        whose = block[row[pick]]
        first = np.flatnonzero(np.concatenate([[True], whose[1:] != whose[:-1]])) if len(pick) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(whose[first]), pack(terms[pick], first), pack(sizes[pick], first), pack(own, base[first])], ["block", "terms", "sizes", "gaps"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n) of packed postings, those of a batch added up."""
    for batch in batches:
        terms, at = np.unique(unpack(batch.column("terms"))[0], return_inverse=True)
        n = np.bincount(at, unpack(batch.column("sizes"), np.uint32)[0], len(terms)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([as_long(terms), pa.array(n)], ["term", "n"])


def _term_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms, row = unpack(batch.column("terms"))
        yield pa.RecordBatch.from_arrays([as_long(terms), pa.array(batch.column("block").to_numpy()[row])], ["term", "block"])


def _spread(terms: np.ndarray, row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment's row, first word, length) of the windows of packed segments."""
    size = np.bincount(row)
    n = np.maximum(1, size - window + 1)
    of = np.repeat(np.arange(len(size)), n)
    start = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.cumsum(size) - size, n)
    return of, start, np.minimum(window, size[of])


def _rarest(ranks: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Which words of each window are its anchors: the rarest that the corpus has, the first of equals. A
    window that lacks too many words has none, a short one only if it has all, and then its rarest."""
    width = ranks.shape[1]
    known = (ranks > 0) & (np.arange(width) < length[:, None])
    rank = np.argsort(np.argsort(np.where(known, ranks, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1, kind="stable")
    whole = length == width
    enough = known.sum(axis=1) >= np.where(whole, int(np.ceil(NEAR_SHARE * width)), length)
    return known & (rank < np.where(whole, ANCHORS, 1)[:, None]) & enough[:, None]


def _gather(values: np.ndarray, start: np.ndarray, length: np.ndarray, window: int, fill: int) -> np.ndarray:
    step = np.arange(window)
    return np.where(step < length[:, None], values[start[:, None] + np.minimum(step, length[:, None] - 1)], fill)


def _anchor_rows(window: int):
    """(segment, term) of the anchors of all windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            terms, row = unpack(batch.column("terms"))
            ranks, _ = unpack(batch.column("ranks"), np.uint16)
            of, start, length = _spread(terms, row, window)
            w, k = np.nonzero(_rarest(_gather(ranks, start, length, window, 0), length))
            at = np.unique(start[w] + k)
            yield pa.RecordBatch.from_arrays([pa.array(batch.column("segment").to_numpy()[row[at]]), as_long(terms[at])], ["segment", "term"])

    return run


def _with_ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(segment, terms, ranks): beside each term its rank by count within the segment, from 1, equal counts
    alike, and 0 where the corpus lacks a word."""
    for batch in batches:
        terms, row = unpack(batch.column("terms"))
        ranks = np.zeros(len(terms), "<u2")
        first = np.searchsorted(row, np.arange(batch.num_rows))
        for k, places in enumerate(batch.column("known").to_pylist()):
            if places:
                at = np.array([x["place"] for x in places])
                ranks[first[k] + at] = np.unique([x["count"] for x in places], return_inverse=True)[1] + 1
        yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("terms"), pack(ranks, first)], ["segment", "terms", "ranks"])


class Block:
    """A block's postings of the benchmark's terms and its documents, as the search wants them."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray, gaps: np.ndarray, n_words: np.ndarray):
        order = np.argsort(terms)
        begin = np.cumsum(sizes) - sizes
        positions = _positions(gaps, begin, sizes) if len(gaps) else np.zeros(0, np.int64)
        size = sizes[order]
        self.terms, self.begin = terms[order], np.concatenate([[0], np.cumsum(size)])
        self.positions = positions[np.repeat(begin[order] - self.begin[:-1], size) + np.arange(int(size.sum()))]
        self.counts = size
        self.first = np.concatenate([[0], np.cumsum(n_words)])
        self.total = int(self.first[-1])
        self.ids = np.full(self.total, -1, np.int64)
        self.ids[self.positions] = np.repeat(np.arange(len(size)), size)
        self.doc = np.repeat(np.arange(len(n_words)), n_words)

    def numbers(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.full(terms.shape, -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, at, -1)

    def places(self, row: np.ndarray, term: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) for every posting of each row's term, moved back by its offset."""
        size = self.counts[term]
        at = np.arange(int(size.sum())) + np.repeat(self.begin[term] - np.cumsum(size) + size, size)
        return np.repeat(row, size), self.positions[at] - np.repeat(offset, size)

    def exact(self, ids: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place) where all words of a window stand in order, in one document. ids: (rows, window),
        -1 where a word isn't in the block or the window has ended."""
        width = ids.shape[1]
        inside = np.arange(width) < length[:, None]
        live = np.flatnonzero((np.where(inside, ids, 0) >= 0).all(axis=1))
        none = np.zeros(0, np.int64)
        if not len(live):
            return none, none
        ids, length, inside = ids[live], length[live], inside[live]
        weight = np.where(inside, self.counts[ids], np.iinfo(np.int64).max)
        rarest = np.argsort(weight, axis=1, kind="stable")[:, :2]
        rarest[:, 1] = np.where(length > 1, rarest[:, 1], rarest[:, 0])
        row, span = np.arange(len(live)), self.total + 2 * width
        lists = []
        for k in (0, 1):
            w, place = self.places(row, ids[row, rarest[:, k]], rarest[:, k])
            lists.append(np.sort(w * span + place + width))
        key = np.intersect1d(*lists, assume_unique=True)
        w, place = key // span, key % span - width
        fits = (place >= 0) & (place + length[w] <= self.total)
        w, place = w[fits], place[fits]
        good = self.doc[place] == self.doc[place + length[w] - 1] if len(w) else fits[fits]
        for k in range(width):
            good &= (k >= length[w]) | (self.ids[np.minimum(place + k, self.total - 1)] == ids[w, k])
        return live[w[good]], place[good]

    def near(self, ids: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, document) where most words of a whole window stand around a place of an anchor."""
        width = ids.shape[1]
        row, k = np.nonzero(anchors & (ids >= 0))
        w, place = self.places(row, ids[row, k], k)
        offset = np.repeat(k, self.counts[ids[row, k]])
        order = np.argsort(np.where(ids >= 0, self.counts[ids], -1), axis=1, kind="stable")  # absent words come first
        missed, allowed = np.zeros(len(w), np.int64), width - int(np.ceil(NEAR_SHARE * width))
        doc = self.doc[place + offset]
        lo, hi = np.maximum(place - SLOP, self.first[doc]), np.minimum(place + width + SLOP, self.first[doc + 1])
        for step in range(width):
            term = ids[w, order[w, step]]
            held = np.zeros(len(w), bool)
            for at in range(-SLOP, width + SLOP):
                p = place + at
                held |= (p >= lo) & (p < hi) & (self.ids[np.clip(p, 0, self.total - 1)] == term)
            missed += ~held | (term < 0)
            keep = missed <= allowed
            w, place, lo, hi, doc, missed = w[keep], place[keep], lo[keep], hi[keep], doc[keep], missed[keep]
        return w, doc


_FOUND = "block long, place int, doc_id long, text_hash long, n_words long, n_hit long, found array<bigint>, n_near long"


def _match(window: int):
    """Rows sorted by block: its postings (kind 0), its documents (1), then segments to search for (2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def start(number: int) -> None:
            state.update(number=number, terms=[], sizes=[], gaps=[], docs=None, block=None, edge=None, exact=[], sure=[], close=[])

        def look_for(rows: pa.RecordBatch) -> None:
            if state["block"] is None:
                join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
                state["block"] = Block(join(state["terms"], np.uint64), join(state["sizes"], np.int64), join(state["gaps"], np.uint32), state["docs"][2])
                state["edge"] = np.zeros(state["block"].total + 1, np.int64)
            block, number = state["block"], rows.column("segment").to_numpy()
            terms, row = unpack(rows.column("terms"))
            ranks, _ = unpack(rows.column("ranks"), np.uint16)
            of, start, length = _spread(terms, row, window)
            ids = _gather(block.numbers(terms), start, length, window, -1)
            anchors = _rarest(_gather(ranks, start, length, window, 0), length) & (ids >= 0)
            whole = window_hashes(terms, window, SEED + 1) if len(terms) >= window else np.zeros(0, np.uint64)
            name = np.where(length == window, whole[np.minimum(start, max(len(whole) - 1, 0))].view(np.int64) if len(whole) else 0, 0)
            # The anchors' postings bound what an intersection holds: so many at a time.
            load = np.cumsum(np.where(anchors, block.counts[ids] if len(block.counts) else 0, 0).sum(axis=1)) // MOST_PLACES
            cuts = np.flatnonzero(np.diff(load)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
                w, place = block.exact(ids[a:b], length[a:b])
                np.add.at(state["edge"], place, 1)
                np.add.at(state["edge"], place + length[a:b][w], -1)
                state["exact"].append(np.stack([block.doc[place], number[of[a:b]][w]]))
                state["sure"].append(np.stack([block.doc[place], name[a:b][w]]))
                w, doc = block.near(ids[a:b], anchors[a:b] & (length[a:b] == window)[:, None])
                state["close"].append(np.stack([doc, name[a:b][w]]))

        def finish() -> pa.RecordBatch:
            doc_ids, hashes, n_words = state["docs"]
            n = len(n_words)
            pairs = lambda parts: np.unique(np.concatenate(parts, axis=1), axis=1) if parts else np.zeros((2, 0), np.int64)
            exact, close = pairs(state["exact"]), pairs(state["close"])
            n_hit = np.zeros(n, np.int64)
            n_near = np.zeros(n, np.int64)
            if exact.size or close.size:
                first = state["block"].first
                total = np.concatenate([[0], np.cumsum(np.cumsum(state["edge"][:-1]) > 0)])
                n_hit = total[first[1:]] - total[first[:-1]]
                sure = set(zip(*pairs(state["sure"]).tolist()))
                only = [d for d, w in zip(*close.tolist()) if (d, w) not in sure]
                n_near = np.bincount(only, minlength=n) if only else n_near
            found = pa.ListArray.from_arrays(pa.array(np.searchsorted(exact[0], np.arange(n + 1)).astype(np.int32)), pa.array(exact[1]))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, state["number"])), pa.array(np.arange(n, dtype=np.int32)), doc_ids, hashes, pa.array(n_words), pa.array(n_hit), found, pa.array(n_near)],
                ["block", "place", "doc_id", "text_hash", "n_words", "n_hit", "found", "n_near"],
            )

        for batch in batches:
            numbers, kinds = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if state.get("number") != numbers[a]:
                    if state:
                        yield finish()
                    start(int(numbers[a]))
                if kinds[a] == 0:
                    state["terms"].append(unpack(part.column("terms"))[0])
                    state["sizes"].append(unpack(part.column("sizes"), np.uint32)[0].astype(np.int64))
                    state["gaps"].append(unpack(part.column("gaps"), np.uint32)[0])
                elif kinds[a] == 1:
                    state["docs"] = [part.column(c)[0].values for c in ("doc_ids", "text_hashes")] + [part.column("n_words")[0].values.to_numpy()]
                else:
                    look_for(part)
        if state:
            yield finish()

    return run


def search(spark: SparkSession, path: str, benchmark: DataFrame, window: int = WINDOW, scratch: list[str] | None = None) -> DataFrame:
    """Per document of the index below ``path``: block, place, doc_id, text_hash, n_words, n_hit, items
    (the ids of items with exact windows there) and n_near. ``scratch`` is told the tables written."""

    def materialise(df: DataFrame, name: str) -> DataFrame:
        table, at = stored_table(df, name)
        if scratch is not None:
            scratch.append(at)
        return table

    wanted = materialise(segments(benchmark, window), "benchmark-segments")
    stored = spark.read.schema(_STORED).parquet(path)
    distinct = wanted.select("segment", "terms").distinct()
    words = materialise(distinct.mapInArrow(_term_rows, "bucket int, term long, segment long, place int"), "benchmark-terms")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    lists = words.select("bucket", "term").distinct().repartition(n, "bucket").sortWithinPartitions("bucket", "term").mapInArrow(pack_rows("bucket", "term", "wanted"), "bucket int, wanted binary")
    held = stored.filter("bucket >= 0").select("bucket", "block", "terms", "sizes", "gaps").join(lists, "bucket").drop("bucket")
    postings = materialise(held.mapInArrow(_taken, "block long, terms binary, sizes binary, gaps binary"), "benchmark-postings")
    counts = postings.select("terms", "sizes").mapInArrow(_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("count"))
    known = words.join(counts, "term").groupBy("segment").agg(F.collect_list(F.struct("place", "count")).alias("known"))  # a segment's words
    chosen = materialise(distinct.join(known, "segment").mapInArrow(_with_ranks, "segment long, terms binary, ranks binary"), "benchmark-ranks")
    rare = chosen.mapInArrow(_anchor_rows(window), "segment long, term long")
    blocks = postings.select("block", "terms").mapInArrow(_term_blocks, "term long, block long")
    sought = materialise(rare.join(blocks, "term").select("segment", "block").distinct(), "benchmark-blocks")
    empty = {"kind": "int", "segment": "long", "terms": "binary", "sizes": "binary", "gaps": "binary", "ranks": "binary", "doc_ids": "array<long>", "text_hashes": "array<long>", "n_words": "array<long>"}

    def row(df: DataFrame, kind: int, *columns: str) -> DataFrame:
        value = lambda c: F.lit(kind) if c == "kind" else F.col(c) if c in columns else F.lit(None).cast(empty[c])
        return df.select("block", *[value(c).alias(c) for c in empty])

    rows = row(postings, 0, "terms", "sizes", "gaps").unionByName(row(stored.filter("bucket = -1"), 1, "doc_ids", "text_hashes", "n_words"))
    rows = rows.unionByName(row(sought.join(chosen, "segment"), 2, "segment", "terms", "ranks"))
    found = materialise(rows.repartition(n, "block").sortWithinPartitions("block", "kind").mapInArrow(_match(window), _FOUND), "benchmark-found")
    hit = found.filter("size(found) > 0").select("block", "place", F.explode("found").alias("segment"))
    items = hit.join(wanted.select("segment", "item_id"), "segment").groupBy("block", "place").agg(F.collect_set("item_id").alias("items"))
    return found.drop("found").join(items, ["block", "place"], "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near. Texts don't shuffle."""
    spark = docs.sparkSession
    path = new_path(spark, "positional-index")
    write_index(docs, path)
    names: Column = F.array_join(F.array_sort("items"), ",")
    return search(spark, path, benchmark, window).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "n_near"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``docs``, all their columns, that hold no benchmark window."""
    spark = docs.sparkSession
    path = new_path(spark, "positional-index")
    write_index(docs, path)
    key = row_key(F.lit(None))[0]
    scratch = [path]
    bad = search(spark, path, benchmark, window, scratch).filter("n_hit > 0").select(key.alias("b_id"), F.col("text_hash").alias("b_text")).distinct()
    bad = materialise(bad, "contaminated")  # stored, so that its size is measured, and what it came from can go
    for gone in scratch:
        discard(spark, gone)
    rows = docs.select(F.struct(*docs.columns).alias("row"), *row_key(F.col("text")))
    return rows.join(bad, (rows["_id"] == bad["b_id"]) & (rows["_text"] == bad["b_text"]), "left_anti").select("row.*")


def op9_positional_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
