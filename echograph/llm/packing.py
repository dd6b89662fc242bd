"""Packing by lexical retrieval.

Texts are encoded once and stored with a route, a weighted MinHash of their words: a word weighs as
many tokens as it has beyond the first, so words that the vocabulary holds whole, the common ones, don't
count, and two documents share a route with the probability of their weighted similarity, wherever
they lie in the table. The same pass counts documents for each word (hashed to ``BUCKETS`` numbers)
and their length, so the BM25 statistics are those of the corpus. Shards of a bounded number of
documents are cut from the order of routes; each has an inverted index of its words. A seed document
opens a window; its unused neighbours, best first, fill the window, and the last is cut where the
window ends and goes on in the next one. An open window carries over to the next shard, so only the
last window of a task has padding.

The order is dealt by range with ties broken by text and id, so copies of one text don't meet in one
task; memory holds one shard. Ties in BM25 go by the order. A null text is a document of its end id
alone; repeated rows are documents of their own; an empty table gives no rows. A document longer than
the window runs on through as many as it needs. Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm import tokens as token_cache
from echograph.llm.bytewords import mix
from echograph.llm.tokens import CACHED_UNITS, encoder, text_blocks, vocabulary_path
from echograph.session import materialise

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 512
SHARD_CHARS = 4_000_000
BLOCK_CHARS = 1_500_000
K1, B = 1.2, 0.75
#: MinHashes in the order's key: each one parts documents that share those before it.
ROUTES = 3
#: Numbers that words hash to when their documents are counted: a bound for what the driver gathers.
BUCKETS = 1 << 18
SEED = 7

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Lexicon:
    """Words of token ids: a word is a run of ids up to the next one that starts with white space or a mark."""

    def __init__(self, vocabulary: dict[str, int], end_id: int):
        n = max(max(vocabulary.values()), end_id) + 1
        self.starts = np.zeros(n, bool)
        for token, i in vocabulary.items():
            self.starts[i] = ord(token[0]) in _SPACES or token[0].isascii() and not token[0].isalnum()
        self.starts[end_id] = True
        rng = np.random.default_rng(SEED)
        self.draw = rng.integers(0, 2**63, n, np.int64).view(np.uint64)
        self.turn = rng.integers(0, 2**63, 64, np.int64).view(np.uint64) | np.uint64(1)

    def words(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, tokens) of each word of the documents that begin at ``first``."""
        starts = self.starts[ids]
        starts[first] = True
        at = np.flatnonzero(starts).astype(np.int32)
        size = np.diff(np.append(at, np.int32(len(ids))))
        place = np.arange(len(ids), dtype=np.int32) - np.repeat(at, size)
        h = mix(np.add.reduceat(self.draw[ids] * self.turn[place & 63], at))
        return h, np.repeat(np.arange(len(first)), np.diff(np.searchsorted(at, np.append(first, len(ids))))), size


#: Letters that byte-level vocabularies have for space and newline.
_SPACES = {0x100 + 0x20, 0x100 + 0x0A}


_HASH, _DOC, _SIZE = 40, 20, 4  # bits of a key: a word's hash, a document of a block, tokens up to 15


def distinct_words(h: np.ndarray, doc: np.ndarray, size: np.ndarray, by_doc: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, count, tokens) of each document's distinct words, by document or by word. The
    hashes keep 40 bits; sorted keys hold all there is to know, which spares an index sort."""
    h, doc, size = h >> np.uint64(64 - _HASH), doc.astype(np.uint64), np.minimum(size, 15).astype(np.uint64)
    keys = doc << np.uint64(_HASH + _SIZE) | h << np.uint64(_SIZE) if by_doc else h << np.uint64(_DOC + _SIZE) | doc << np.uint64(_SIZE)
    keys = np.sort(keys | size)
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    tf = np.diff(np.append(new, len(keys)))
    keys = keys[new]
    low = lambda k, bits: k & np.uint64((1 << bits) - 1)
    h = low(keys >> np.uint64(_SIZE), _HASH) if by_doc else keys >> np.uint64(_DOC + _SIZE)
    doc = keys >> np.uint64(_HASH + _SIZE) if by_doc else low(keys >> np.uint64(_SIZE), _DOC)
    return h << np.uint64(64 - _HASH), doc.astype(np.int64), tf, low(keys, _SIZE).astype(np.int64)


def _idf(n: int, df: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))


class Corpus(NamedTuple):
    """Over all documents: inverse document frequency of each number of words, and the mean length."""

    idf: np.ndarray
    mean: float


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 18)).astype(np.int64)


class ShardIndex:
    """BM25 over the words of a shard's documents, weighted as in the corpus if that is given."""

    def __init__(self, docs: list[np.ndarray], lexicon: Lexicon, corpus: Corpus | None = None):
        self.n = n = len(docs)
        lengths = np.array([len(d) for d in docs], np.int64)
        ids = np.concatenate(docs) if n else np.zeros(0, np.uint32)
        h, doc, size = lexicon.words(ids, np.cumsum(lengths) - lengths) if n else (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
        length = np.bincount(doc, minlength=n)
        h, doc, tf, _ = distinct_words(h, doc, size, False)
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        df = np.diff(np.append(first, len(h)))
        idf = corpus.idf[bucket(h[first])] if corpus else _idf(n, df)
        norm = K1 * (1 - B + B * length / max(1.0, corpus.mean if corpus else length.mean() if n else 1.0))
        row = np.repeat(np.arange(len(first)), df)
        weight = np.repeat(idf, df) * tf * (K1 + 1) / (tf + norm[doc])
        live = (weight > 0) & np.repeat(df > 1, df)  # what one document alone has ranks no other
        row, doc, weight = row[live], doc[live], weight[live]
        self.postings, self.weights = doc, weight
        self.begin = np.searchsorted(row, np.arange(len(first) + 1))
        order = np.argsort(doc, kind="stable")
        self.doc_terms, self.doc_begin = row[order], np.searchsorted(doc[order], np.arange(n + 1))

    def scores(self, seed: int) -> np.ndarray:
        terms = self.doc_terms[self.doc_begin[seed] : self.doc_begin[seed + 1]]
        begin, size = self.begin[terms], self.begin[terms + 1] - self.begin[terms]
        total = int(size.sum())
        at = np.arange(total) + np.repeat(begin - np.cumsum(size) + size, size)
        return np.bincount(self.postings[at], self.weights[at], self.n)


def fill(docs: list[np.ndarray], used: int, lexicon: Lexicon, window: int = WINDOW, corpus: Corpus | None = None) -> Iterator[tuple[int, int, int, int, int]]:
    """(doc, start, length, windows closed before, offset) of each piece; ``used`` tokens of the first
    window are taken already."""
    index = ShardIndex(docs, lexicon, corpus)
    free = np.ones(len(docs), bool)
    closed, ranked, at, next_seed = 0, None, 0, 0
    while True:
        if ranked is None:
            while next_seed < len(docs) and not free[next_seed]:
                next_seed += 1
            if next_seed == len(docs):
                return
            doc, ranked = next_seed, []
        else:
            if not len(ranked):
                ranked, at = np.argsort(-index.scores(seed), kind="stable"), 0
            while at < len(ranked) and not free[ranked[at]]:
                at += 1
            if at == len(ranked):
                return
            doc = int(ranked[at])
        free[doc] = False
        if isinstance(ranked, list):
            seed = doc
        start, n = 0, len(docs[doc])
        while start < n:
            length = min(window - used, n - start)
            yield doc, start, length, closed, used
            start, used = start + length, used + length
            if used == window:
                # A document that is cut is the seed of the window that it goes on in.
                closed, used, seed, ranked = closed + 1, 0, doc, ([] if start < n else None)


def store(ids: bytes) -> bytes:
    """Ids (uint32) behind a byte that tells how wide each is: two bytes where all of a document fit."""
    values = np.frombuffer(ids, "<u4")
    return b"\x02" + values.astype("<u2").tobytes() if values.max(initial=0) < 1 << 16 else b"\x04" + ids


def load(stored: bytes) -> np.ndarray:
    return np.frombuffer(stored, f"<u{stored[0]}", offset=1).astype("<u4")


_lexicons: dict[tuple[str, int], Lexicon] = {}


def lexicon_of(path: str, end_id: int) -> Lexicon:
    if (path, end_id) not in _lexicons:
        from tokenizers import Tokenizer

        _lexicons[path, end_id] = Lexicon(Tokenizer.from_file(path).get_vocab(), end_id)
    return _lexicons[path, end_id]


_ROUTES = [f"route{k}" for k in range(ROUTES)]
_ENCODED = ", ".join(["doc_id long", "tokens binary", *(f"{c} long" for c in _ROUTES), "words binary", "counts binary"])


def _routes(h: np.ndarray, doc: np.ndarray, tokens: np.ndarray, n: int) -> list[np.ndarray]:
    """The word with the least exponential draw, by weight, of each document: its hash, three times over.
    The words come ordered by document."""
    weight, first, out = (tokens - 1).astype(np.float64), np.searchsorted(doc, np.arange(n)), []
    for k in range(ROUTES):
        luck = -np.log(((mix(h + np.uint64(k)) >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53)
        cost = np.divide(luck, weight, out=np.full(len(h), np.inf), where=weight > 0)
        least = np.minimum.reduceat(cost, first)  # every document has its end id, so no run is empty
        at = np.flatnonzero(cost == np.repeat(least, np.diff(np.append(first, len(h)))))
        at = at[np.searchsorted(doc[at], np.arange(n))]
        out.append(np.where(np.isinf(least), 0, h[at].view(np.int64)))
    return out


def _token_rows(path: str, end_id: int, cached_units: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents, then what the task has counted: documents for each number of words, all, words."""
        end, lexicon = np.array([end_id], "<u4").tobytes(), lexicon_of(path, end_id)
        names = ["doc_id", "tokens", *_ROUTES, "words", "counts"]
        df, docs, total = np.zeros(BUCKETS, np.int64), 0, 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in text_blocks(texts, BLOCK_CHARS):
                n = b - a
                parts = [t + end for t in encoder(path, cached_units).encode(texts[a:b])]
                size = np.array([len(t) // 4 for t in parts])
                h, doc, tokens = lexicon.words(np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size)
                total, docs = total + len(h), docs + n
                h, doc, _, tokens = distinct_words(h, doc, tokens, True)
                df += np.bincount(bucket(h), minlength=BUCKETS)
                stored = pa.array([store(t) for t in parts], pa.binary())
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, n), stored, *map(pa.array, _routes(h, doc, tokens, n)), empty, empty], names)
        seen = np.flatnonzero(df)
        counted = [pa.array([np.append(x, y).astype("<i8").tobytes()], pa.binary()) for x, y in ((seen, [-1, -2]), (df[seen], [docs, total]))]
        none = pa.nulls(1, pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.nulls(1, pa.binary()), *[none] * ROUTES, *counted], names)

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of the tasks' counts, those of one batch added up."""
    for batch in batches:
        words, counts = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<i8") for c in ("words", "counts"))
        seen, at = np.unique(words, return_inverse=True)
        total = np.zeros(len(seen), np.int64)
        np.add.at(total, at, counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total)], ["word", "n"])


def corpus_of(encoded: DataFrame) -> Corpus:
    """Collects a row for each of the ``BUCKETS`` numbers at most."""
    counted = encoded.filter("counts is not null").select("words", "counts").mapInArrow(_unpacked, "word long, n long")
    rows = counted.groupBy("word").agg(F.sum("n").alias("n")).toArrow()
    word, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    df, docs, total = np.zeros(BUCKETS), int(n[word == -1].sum()), int(n[word == -2].sum())
    df[word[word >= 0]] = n[word >= 0]
    return Corpus(_idf(docs, np.minimum(df, docs)), total / max(1, docs))


def by_content(encoded: DataFrame) -> DataFrame:
    """(doc_id, tokens) with like documents side by side."""
    keys = [*_ROUTES, "text", "doc_id"]
    n = int(encoded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = encoded.filter("counts is null").select("doc_id", "tokens", *_ROUTES, F.xxhash64("tokens").alias("text"))
    return routed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "tokens")


def _pack_rows(window: int, shard_docs: int, corpus: Corpus, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token_cache._encoders.clear()  # a worker that has encoded keeps its units, which nobody needs now
        lexicon = lexicon_of(path, end_id)
        sequence, used = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            tokens = batch.column("tokens").to_pylist()
            keys = batch.column("doc_id").to_pylist()
            for a, b in text_blocks(tokens, SHARD_CHARS):
                for c in range(a, b, shard_docs):
                    docs = [load(t) for t in tokens[c : min(c + shard_docs, b)]]
                    rows = []
                    for doc, start, length, closed, offset in fill(docs, used, lexicon, window, corpus):
                        crc = zlib.crc32(docs[doc][start : start + length])
                        rows.append((keys[c + doc], start, length, crc, len(docs[doc]), sequence + closed, offset))
                    last = rows[-1]  # every document has its end id, so there is a piece
                    full = last[6] + last[2] == window
                    sequence, used = last[5] + full, 0 if full else last[6] + last[2]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, window: int = WINDOW, end_id: int = END_ID, vocabulary: str | None = None, shard_docs: int = SHARD_DOCS, cached_units: int = CACHED_UNITS) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text); see the contract of op7 for the columns.
    ``cached_units`` trades a worker's memory for speed; results don't depend on it."""
    path = vocabulary or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    encoded = materialise(rows.mapInArrow(_token_rows(path, end_id, cached_units), _ENCODED), "packing-tokens")
    return by_content(encoded).mapInArrow(_pack_rows(window, shard_docs, corpus_of(encoded), path, end_id), _PIECES)


def op7_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
