"""Token ids in files of range-coded segments.

A segment holds the ids of whole documents. Its blocks share one static frequency table and each is
an interleaved range asymmetric numeral system stream: id k goes to lane k mod lanes, all lanes step
together, and renormalised 32-bit words lie in the order in which decoding wants them. Checkpoints
(word offset and lane states every ``CHECKPOINT`` steps) let a reader start inside a block; every
block carries the crc32 of its ids. Segments are rows of a Parquet table, written and read by Spark.

Documents are written in ascending (doc_id, text hash) order, null ids first; a null text is empty;
repeated rows are written each, and ties among them are rows alike. A text of any length is encoded whole;
a segment closes after the document that fills it. Other columns, whatever their names, are not read. An
empty table gives no rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from echograph.llm.tokens import encoder, text_blocks, vocabulary_path
from echograph.session import new_path

END_ID = 2
SCALE = 18  # bits of the frequency table's total
LOW = np.uint64(1 << 31)  # lane states lie in [2^31, 2^63)
LANES = 2048
BLOCK = 1 << 18
CHECKPOINT = 64
SEGMENT = 1 << 21
#: Bytes of text that one range of doc_ids holds, about.
PART_BYTES = 256 << 20
_SEGMENT = struct.Struct("<4sIII")
_BLOCK = struct.Struct("<IIIIII")


def frequency_table(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, freqs): counts scaled to sum 2^SCALE, each at least 1."""
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    counts = counts[symbols]
    total = 1 << SCALE
    freqs = np.maximum(1, counts * total // counts.sum())
    over = int(freqs.sum()) - total
    if over < 0:
        freqs[np.argmax(freqs)] -= over
    while over > 0:  # rare symbols were raised to 1: the larger ones give
        give = np.minimum(freqs - 1, np.maximum(1, freqs * over // freqs.sum()))
        give = np.where(np.cumsum(give) <= over, give, 0) if give.sum() > over else give
        if not give.any():
            give[np.argmax(freqs)] = 1
        freqs -= give
        over -= int(give.sum())
    return symbols.astype("<u4"), freqs.astype("<u4")


def encode_block(ids: np.ndarray, symbols: np.ndarray, freqs: np.ndarray) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, n // 64))
    steps = -(-n // lanes)
    rank = np.zeros(int(symbols[-1]) + 1, np.int32)
    rank[symbols] = np.arange(len(symbols), dtype=np.int32)
    at = rank[ids]
    padded = np.concatenate([at, np.zeros(steps * lanes - n, at.dtype)]).reshape(steps, lanes)
    freq64, start64 = freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64)
    limit = freq64 << np.uint64(63 - SCALE)
    state = np.full(lanes, LOW, np.uint64)
    words: list[np.ndarray] = []
    marks: list[tuple[int, bytes]] = []
    written = 0
    for step in range(steps - 1, -1, -1):
        sym = padded[step]
        f = freq64[sym]
        full = state >= limit[sym]
        if full.any():
            out = state[full].astype("<u4")
            words.append(out)
            written += len(out)
            state[full] >>= np.uint64(32)
        q = state // f
        state = (q << np.uint64(SCALE)) + (state - q * f) + start64[sym]
        if step % CHECKPOINT == 0:
            marks.append((written, state.astype("<u8").tobytes()))
    head = _BLOCK.pack(n, lanes, steps, len(marks), written, zlib.crc32(ids.astype("<u4").tobytes()))
    marks.reverse()
    offsets = np.array([written - w for w, _ in marks], "<u4").tobytes()
    return head + offsets + b"".join(s for _, s in marks) + b"".join(w.tobytes() for w in reversed(words))


def decode_steps(block: bytes, table: tuple, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of a block from checkpoint ``first`` up to, not including, ``last``."""
    lookup, freq64, start64, symbols = table
    n, lanes, steps, marks, n_words, _ = _BLOCK.unpack_from(block)
    last = marks if last is None else last
    at = _BLOCK.size
    word = int(np.frombuffer(block, "<u4", marks, at)[first])
    states = at + 4 * marks
    state = np.frombuffer(block, "<u8", lanes, states + 8 * lanes * first).astype(np.uint64)
    words = np.frombuffer(block, "<u4", n_words, states + 8 * lanes * marks).astype(np.uint64)
    begin, stop = first * CHECKPOINT, min(steps, last * CHECKPOINT)
    out = np.empty((stop - begin, lanes), lookup.dtype)
    mask, scale, half = np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    for step in range(stop - begin):
        slot = state & mask
        sym = lookup[slot]
        out[step] = sym
        state = freq64[sym] * (state >> scale) + slot - start64[sym]
        low = np.flatnonzero(state < LOW)
        if len(low):
            state[low] = (state[low] << half) | words[word : word + len(low)]
            word += len(low)
    return symbols[out.reshape(-1)[: n - begin * lanes]]


def encode_segment(ids: np.ndarray) -> bytes:
    symbols, freqs = frequency_table(ids)
    blocks = [encode_block(ids[i : i + BLOCK], symbols, freqs) for i in range(0, len(ids), BLOCK)]
    lengths = np.array([len(b) for b in blocks], "<u4").tobytes()
    return _SEGMENT.pack(b"RANS", 1, len(symbols), len(blocks)) + symbols.tobytes() + freqs.tobytes() + lengths + b"".join(blocks)


def segment_blocks(data: bytes) -> tuple[tuple, list[bytes]]:
    """The shared table, ready to decode with, and the blocks; each decodes alone."""
    magic, version, n_symbols, n_blocks = _SEGMENT.unpack_from(data)
    if magic != b"RANS" or version != 1:
        raise ValueError("not a segment of this format")
    at = _SEGMENT.size
    symbols = np.frombuffer(data, "<u4", n_symbols, at)
    freqs = np.frombuffer(data, "<u4", n_symbols, at + 4 * n_symbols)
    lengths = np.frombuffer(data, "<u4", n_blocks, at + 8 * n_symbols)
    at += 8 * n_symbols + 4 * n_blocks
    lookup = np.repeat(np.arange(n_symbols, dtype=np.uint32), freqs)
    ends = at + np.cumsum(lengths.astype(np.int64))
    table = (lookup, freqs.astype(np.uint64), (np.cumsum(freqs) - freqs).astype(np.uint64), symbols)
    return table, [data[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())]


def decode_segment(data: bytes) -> np.ndarray:
    table, blocks = segment_blocks(data)
    parts = [decode_steps(b, table) for b in blocks]
    for block, part in zip(blocks, parts):
        if zlib.crc32(part.astype("<u4").tobytes()) != _BLOCK.unpack_from(block)[5]:
            raise ValueError("a block's checksum differs")
    return np.concatenate(parts).astype("<u4")


_WRITTEN = "part int, segment int, n_tokens long, doc_id array<bigint>, length array<bigint>, payload binary"
_READ = "part int, segment int, before long, doc_id long, n_tokens long, ids_crc32 long"


def _encode_rows(path: str, end_id: int, segment_tokens: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        ids, lengths, data, size = [], [], [], 0
        schema = pa.schema([("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("length", pa.list_(pa.int64())), ("payload", pa.binary())])

        def flush() -> pa.RecordBatch:
            payload = encode_segment(np.frombuffer(b"".join(data), "<u4"))
            return pa.RecordBatch.from_pydict({"part": [part], "segment": [number], "n_tokens": [size], "doc_id": [ids], "length": [lengths], "payload": [payload]}, schema)

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            keys = batch.column("doc_id").to_pylist()
            for a, b in text_blocks(texts, 3_000_000):
                for key, tokens in zip(keys[a:b], encoder(path).encode(texts[a:b])):
                    ids.append(key)
                    data.append(tokens + end)
                    lengths.append(len(tokens) // 4 + 1)
                    size += lengths[-1]
                    if size >= segment_tokens:
                        yield flush()
                        number += 1
                        ids, lengths, data, size = [], [], [], 0
        if data:
            yield flush()

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, segment_tokens: int = SEGMENT) -> None:
    """Write the ids of ``docs`` (doc_id, text) below ``path``, a part for each range of doc_id, as many as
    the bytes of the texts ask for and at least as many as a shuffle has. A text hash breaks ties, so that
    repeated ids can be dealt to several parts."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows.mapInArrow(_encode_rows(vocabulary or vocabulary_path(), end_id, segment_tokens), _WRITTEN).write.parquet(path)


def _decode_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in range(batch.num_rows):
            one = batch.slice(row, 1)
            ids = decode_segment(one.column("payload")[0].as_py())
            doc_ids, lengths = one.column("doc_id")[0].values, one.column("length")[0].values.to_numpy()
            ends = np.cumsum(lengths)
            data = memoryview(ids.tobytes())
            crcs = [zlib.crc32(data[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            n = len(lengths)
            head = [pa.array(np.full(n, one.column(c)[0].as_py(), np.int32)) for c in ("part", "segment")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(ends - lengths), doc_ids, pa.array(lengths), pa.array(crcs, pa.int64())], ["part", "segment", "before", "doc_id", "n_tokens", "ids_crc32"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Decode the files below ``path``: doc_id, start, n_tokens, ids_crc32 per document. Segments
    decode on their own; where a part starts comes from a table with a row for each segment, summed
    in two steps so that only a row for each part meets in one place."""
    stored = spark.read.schema(_WRITTEN).parquet(path)
    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_base"))
    inside = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    segments = stored.select("part", "segment", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("segment_base"))
    bases = segments.join(parts, "part").select("part", "segment", (F.col("part_base") + F.col("segment_base")).alias("base"))
    decoded = stored.select("part", "segment", "doc_id", "length", "payload").mapInArrow(_decode_rows, _READ)
    return decoded.join(bases, ["part", "segment"]).select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op10_range_coded_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-files")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_tokens(spark, path)
