"""SimHash near-duplicates with bit-sliced comparison.

``near_duplicates`` links fingerprints at most ``RADIUS`` bits apart. They agree on ``AGREE`` of
``BLOCKS`` bit blocks at least, so distinct fingerprints meet in a table for each choice of such blocks.
``near_copies`` links texts that share ``SIMILARITY`` of their five-word shingles; their fingerprints are
up to some 14 bits apart, too far for bit blocks, so texts meet by bands of a MinHash, and what lies
within ``WIDE`` bits there is verified by its shingles.

Within a bucket fingerprints are compared bit-sliced: bit planes lie vertically, a word holding one bit of
64 fingerprints or pairs; carry-save counters add a plane to all distances at once, and a block is
abandoned as soon as every distance in it exceeds the radius. Links become components in distributed
rounds.

Equal texts share one fingerprint and count once in the search. Buckets over ``BUCKET`` fingerprints are
dealt out as pairs of parts, so no task holds or compares more than two parts at a time; of a large bucket
only edges that span its components leave the task. ``near_copies`` tries the nearest members of a large
bucket first; whatever the links found so far leave apart there is then compared in full.

A null or empty text has fingerprint zero, which links like any other. Repeated rows link. Ties for the
row that stays go to the least id, text hash and then row as JSON. A null doc_id counts for no component
id but gets its group's. Texts are fingerprinted whole, however long. Other columns, whatever their names,
are carried along in ``keep_one`` and not read elsewhere. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echograph.llm.bytewords import mix
from echograph.operators.components import connected_components
from echograph.session import materialise

SHINGLE = 4
RADIUS = 4
BLOCKS = 6
AGREE = 2
BUCKET = 4096
#: Buckets up to this size are compared pair by pair, in lanes over many buckets.
SMALL = 16
SEED = 42
#: Of near_copies: words of a shingle, the least similarity, the radius, and the MinHash's bands.
COPY_SHINGLE = 5
SIMILARITY = 0.8
WIDE = 18
BANDS, BAND = 8, 3
#: Texts of a large bucket on either side of a task that compares what is still apart.
PART = 512


def shingle_hashes(text: str, shingle: int, seed: int = SEED) -> np.ndarray:
    """bytes.lower and bytes.split know ASCII only, which is what the words' definition asks for."""
    data = b" ".join(text.encode().lower().split())
    if not data:
        return np.zeros(0, "<u8")
    starts = np.concatenate([[0], np.flatnonzero(np.frombuffer(data, np.uint8) == 0x20) + 1])
    n = max(1, len(starts) - shingle + 1)
    ends = np.append(starts[shingle:] - 1, len(data)).tolist() if len(starts) > shingle else [len(data)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(data[a:b], seed) for a, b in zip(starts[:n].tolist(), ends)], "<u8")


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def majority(h: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; 0 without any."""
    n = len(h)
    if not n:
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprint_rows(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64))], ["doc_id", "text_hash", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp) per row, fp as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    return rows.mapInArrow(_fingerprint_rows(shingle), "doc_id long, text_hash long, fp long")


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def masks(blocks: int = BLOCKS, agree: int = AGREE) -> list[int]:
    """Signed bit masks of every choice of ``agree`` blocks."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    block = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    chosen = [sum(c) for c in combinations(block, agree)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(64, words): word w of plane b holds bit b of values 64w to 64w + 63."""
    pad = -len(values) % 64
    bits = np.unpackbits(np.concatenate([values, np.zeros(pad, np.uint64)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def within(planes, shape: tuple, radius: int) -> np.ndarray | None:
    """A bit per lane: at most ``radius`` of the planes are set. planes(b) gives the b-th difference
    plane. None if the block was abandoned. Planes go in three at a time through a full adder."""
    width = max(1, radius.bit_length())
    counter = [np.zeros(shape, np.uint64) for _ in range(width)]
    over = np.zeros(shape, np.uint64)
    full = np.uint64(2**64 - 1)

    def add(carry: np.ndarray, at: int) -> None:
        nonlocal over
        for k in range(at, width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        over = over | carry

    def beyond() -> np.ndarray:
        """Lanes whose counter exceeds the radius, from the highest bit down."""
        more, same = over, ~over
        for k in range(width - 1, -1, -1):
            if radius >> k & 1:
                same = same & counter[k]
            else:
                more, same = more | (same & counter[k]), same & ~counter[k]
        return more

    for b in range(0, 64, 3):
        x = planes(b)
        if b + 2 < 64:
            y, z = planes(b + 1), planes(b + 2)
            half = x ^ y
            add(half ^ z, 0)
            add((x & y) | (half & z), 1) if width > 1 else None
            if width == 1:
                over = over | (x & y) | (half & z)
        else:
            add(x, 0)
        if b % 12 == 9 and (beyond() == full).all():
            return None
    return ~beyond()


def _lanes(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), axis=-1, bitorder="little")[..., :n].astype(bool)


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Which of the pairs are near: pairs as lanes, in blocks of 4096."""
    out = np.zeros(len(left), bool)
    for i in range(0, len(left), 4096):
        planes = bit_planes(left[i : i + 4096] ^ right[i : i + 4096])
        bits = within(lambda b: planes[b], planes.shape[1:], radius)
        if bits is not None:
            out[i : i + 4096] = _lanes(bits, min(4096, len(left) - i))
    return out


def spanning(values: np.ndarray, queries: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Label of each value: links of the values at ``queries`` with all values, as components."""
    planes, n = bit_planes(values), len(values)
    label = np.arange(n)
    for i in range(0, len(queries), 32):
        own = queries[i : i + 32]
        bit = lambda b: np.where(values[own] >> np.uint64(b) & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))[:, None]
        bits = within(lambda b: planes[b][None, :] ^ bit(b), (len(own), planes.shape[1]), radius)
        if bits is None:
            continue
        for near in _lanes(bits, n):
            seen = np.unique(label[near])
            if len(seen) > 1:
                label[np.isin(label, seen)] = seen[0]
    return label


def _bucket_edges(radius: int):
    def edges(keys: np.ndarray, part: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """keys: (rows, 4) of table, key and the two parts compared, sorted; part: each row's own."""
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        u, v = [], []
        small = size[group] <= SMALL
        g, f, own = group[small], fp[small], part[small]
        cross = (keys[small, 2] != keys[small, 3])
        for step in range(1, min(SMALL, len(g))):
            at = np.flatnonzero((g[:-step] == g[step:]) & ~(cross[:-step] & (own[:-step] == own[step:])))
            if not len(at):
                continue
            near = near_pairs(f[at], f[at + step], radius)
            u.append(f[at[near]])
            v.append(f[at[near] + step])
        first = np.flatnonzero(new)
        for k in np.flatnonzero(size > SMALL).tolist():
            rows = slice(first[k], first[k] + size[k])
            values = fp[rows]
            # Of two parts the first is held against both: links within a part are found with it too.
            queries = np.flatnonzero(part[rows] == keys[first[k], 2])
            label = spanning(values, queries, radius)
            moved = np.flatnonzero(label != np.arange(len(values)))
            u.append(values[label[moved]])
            v.append(values[moved])
        none = np.zeros(0, np.uint64)
        return (np.concatenate(u) if u else none), (np.concatenate(v) if v else none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("table", "key", "p", "q", "part", "fp")], axis=1)
            held = rows if held is None else np.concatenate([held, rows])
            if not len(held):
                continue
            whole = int(np.flatnonzero((held[:, :4] != held[-1, :4]).any(axis=1))[-1]) + 1 if (held[0, :4] != held[-1, :4]).any() else 0
            if whole:
                yield emit(*edges(held[:whole, :4], held[:whole, 4], held[:whole, 5].astype(np.uint64)))
                held = held[whole:]
        if held is not None and len(held):
            yield emit(*edges(held[:, :4], held[:, 4], held[:, 5].astype(np.uint64)))

    def emit(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u.astype(np.int64)), pa.array(v.astype(np.int64))], ["u", "v"])

    return run


def links(distinct: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Edges (u, v) that join fingerprints (column fp, distinct) exactly as links within ``radius`` do."""
    tables = F.array(*[F.struct(F.lit(t).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks())])
    rows = distinct.select("fp", F.inline(tables))
    large = rows.groupBy("table", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket)
    parts = F.coalesce(F.ceil(F.col("n") / bucket), F.lit(1)).cast("int")
    dealt = rows.join(large, ["table", "key"], "left").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("table", "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "fp")
    keys = ["table", "key", "p", "q"]
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *keys).sortWithinPartitions(*keys, "fp").mapInArrow(_bucket_edges(radius), "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row: doc_id, text_hash, fp, root (the component's least fp) and component_id, the least doc_id
    that links reach."""
    prints = materialise(fingerprints(docs, shingle), "simhash-fingerprints")
    least = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    members = connected_components(links(least.select("fp"), radius))
    named = least.join(members.withColumnRenamed("node", "fp"), "fp")
    heads = named.groupBy("component").agg(F.min("least").alias("head"))
    other = named.join(heads, "component").select("fp", "component", F.coalesce("head", "least").alias("head"))
    class_of = least.join(other, "fp", "left").select("fp", F.coalesce("component", "fp").alias("root"), F.coalesce("head", "least").alias("component_id"))
    # Both sides of the last join are stored tables, so a fingerprint with a third of the rows can be split.
    class_of = materialise(class_of, "simhash-classes")
    return prints.join(class_of, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def _copy_rows(shingle: int):
    turn = np.random.default_rng(SEED).integers(0, 2**63, BANDS * BAND, np.int64).view(np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, bands = np.zeros(batch.num_rows, np.uint64), np.zeros((batch.num_rows, BANDS), np.uint64)
            for k, text in enumerate(batch.column("text").to_pylist()):
                h = shingle_hashes(text or "", shingle)
                if len(h):
                    prints[k] = majority(h)
                    least = np.array([(h * t).min() for t in turn])  # the order of products by an odd number
                    for j in range(BAND):
                        bands[k] = mix(bands[k] * np.uint64(31) + least[j::BAND])
            keys = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).reshape(-1)), BANDS).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(prints.view(np.int64)), keys], ["doc_id", "text_hash", "fp", "bands"])

    return run


def _nearest(radius: int):
    """Edges of sorted buckets (key, parts p and q): each member's, of all small buckets, or of a large one
    to the nearest member before it and to the bucket's first within the radius."""

    def edges(part: np.ndarray, p: int, text: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(text)
        if n <= SMALL:
            i, j = np.triu_indices(n, 1)
            near = near_pairs(fp[i], fp[j], radius)
            return text[i[near]], text[j[near]]
        u, v, planes = [], [], bit_planes(fp)
        for a in range(0, n, 32):
            own = np.arange(a, min(a + 32, n))
            bit = lambda b: np.where(fp[own] >> np.uint64(b) & np.uint64(1), np.uint64(2**64 - 1), np.uint64(0))[:, None]
            bits = within(lambda b: planes[b][None, :] ^ bit(b), (len(own), planes.shape[1]), radius)
            if bits is None:
                continue
            near = _lanes(bits, n) & (np.arange(n) < own[:, None])
            for k in np.flatnonzero(near.any(axis=1)).tolist():
                at = np.flatnonzero(near[k])
                best = at[np.argmin(np.bitwise_count(fp[at] ^ fp[own[k]]))]
                for other in {int(at[0]), int(best)}:
                    u.append(text[other])
                    v.append(text[own[k]])
        return np.array(u, np.int64), np.array(v, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("band", "key", "q", "part", "text_hash", "fp")], axis=1)
            held = rows if held is None else np.concatenate([held, rows])
            cuts = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
            if len(cuts):
                yield emit(held[: cuts[-1]], cuts[:-1])
                held = held[cuts[-1] :]
        if held is not None and len(held):
            yield emit(held, np.zeros(0, np.int64))

    def emit(rows: np.ndarray, cuts: np.ndarray) -> pa.RecordBatch:
        found = [edges(g[:, 3], int(g[0, 2]), g[:, 4], g[:, 5].view(np.uint64)) for g in np.split(rows, cuts) if len(g) > 1]
        join = lambda k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(join(0)), pa.array(join(1))], ["u", "v"])

    return run


def _shingle_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t or "", shingle) >> np.uint64(32)).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), pa.array(sets, pa.binary())], ["text_hash", "held"])

    return run


def _alike(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= similarity * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(radius: int, similarity: float):
    """Links between texts with different roots, of sorted groups (band, key, p, q): each text that asks is
    held against all others of its group within the radius, nearest first, as long as links found here leave
    the two apart. Texts that share no root have been compared in full when a group is done."""

    def edges(asks: np.ndarray, text: np.ndarray, fp: np.ndarray, root: np.ndarray, held: list[np.ndarray]) -> tuple[list, list]:
        u, v = [], []
        label, size = np.unique(root, return_inverse=True)[1], np.array([len(x) for x in held])
        for i in np.flatnonzero(asks).tolist():
            far = np.bitwise_count(fp ^ fp[i])
            fits = np.minimum(size, size[i]) >= similarity * np.maximum(size, size[i]) - 1e-9  # no other can be alike
            left = np.flatnonzero(~asks & fits & (far <= radius) & (label != label[i]))
            left = left[np.argsort(far[left], kind="stable")]
            while len(left):
                now, left = left[:64], left[64:]
                words = np.concatenate([held[k] for k in now])
                at = np.minimum(np.searchsorted(held[i], words), max(0, size[i] - 1))
                both = np.bincount(np.repeat(np.arange(len(now)), size[now]), held[i][at] == words, len(now))
                alike = now[both >= similarity * (size[now] + size[i] - both)]
                for k in alike.tolist():
                    if label[k] != label[i]:
                        u.append(text[i])
                        v.append(text[k])
                        label[label == label[k]] = label[i]
                left = left[label[left] != label[i]]
        return u, v

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            kept = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
            keys = np.stack([kept.column(c).to_numpy() for c in ("band", "key", "p", "q")], axis=1).astype(np.int64)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            if len(cuts):
                yield emit(kept.slice(0, cuts[-1]), cuts[:-1])
                kept = kept.slice(cuts[-1])
        if kept is not None and kept.num_rows:
            yield emit(kept, np.zeros(0, np.int64))

    def emit(rows: pa.Table, cuts: np.ndarray) -> pa.RecordBatch:
        u, v, ends = [], [], [0, *cuts.tolist(), rows.num_rows]
        for a, b in zip(ends, ends[1:]):
            g = rows.slice(a, b - a)
            asks, text, fp, root = (g.column(c).to_numpy() for c in ("asks", "text_hash", "fp", "root"))
            found = edges(asks.astype(bool), text, fp.astype(np.int64).view(np.uint64), root, [np.frombuffer(x, "<u4") for x in g.column("held").to_pylist()])
            u += found[0]
            v += found[1]
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _links_left(met: DataFrame, large: DataFrame, members: DataFrame, sets: DataFrame, radius: int, similarity: float, part: int) -> DataFrame | None:
    """Links (u, v) in large buckets (band, key) between texts that ``members`` (text_hash, component) leaves
    apart; None if it leaves none apart. One of two such texts at least has another root than most of its
    bucket: these ask, in parts, and meet all of the bucket, in parts."""
    rows = met.join(large, ["band", "key"], "left_semi").join(members, "text_hash", "left")
    rows = materialise(rows.select("band", "key", "text_hash", "fp", F.coalesce("component", "text_hash").alias("root")), "copy-large")
    roots = rows.groupBy("band", "key", "root").agg(F.count("*").alias("n"))
    most = F.max(F.struct("n", "root"))
    mixed = roots.groupBy("band", "key").agg(most["root"].alias("top"), F.sum("n").alias("n"), (F.sum("n") - most["n"]).alias("n_apart")).filter("n_apart > 0")
    parts = {"ps": F.ceil(F.col("n_apart") / part).cast("int"), "qs": F.ceil(F.col("n") / part).cast("int")}
    mixed = materialise(mixed.select("band", "key", "top", *[c.alias(name) for name, c in parts.items()]), "copy-mixed")
    if mixed.isEmpty():
        return None
    rows = rows.join(mixed, ["band", "key"]).join(sets, "text_hash")
    own = lambda count: F.pmod(F.xxhash64("text_hash"), F.col(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    asking = rows.filter("root <> top").withColumn("p", own("ps")).withColumn("q", every("qs")).withColumn("asks", F.lit(1))
    asked = rows.withColumn("q", own("qs")).withColumn("p", every("ps")).withColumn("asks", F.lit(0))
    order = ["band", "key", "p", "q"]
    dealt = asking.unionByName(asked).select(*order, "asks", "text_hash", "fp", "root", "held")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, *order).sortWithinPartitions(*order, "asks", "text_hash").mapInArrow(_across(radius, similarity), "u long, v long")


def near_copies(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY, radius: int = WIDE, bucket: int = BUCKET, part: int = PART) -> DataFrame:
    """Per row: doc_id, text_hash and root, the same for all texts that links of ``similarity`` reach. A text
    meets another with probability 1 - (1 - s^BAND)^BANDS at similarity s: 0.997 at 0.8. No link between
    texts that meet within the radius is lost, however large the bucket."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_hash().alias("text_hash"))
    prints = materialise(rows.mapInArrow(_copy_rows(shingle), "doc_id long, text_hash long, fp long, bands array<long>"), "copy-fingerprints")
    distinct = prints.groupBy("text_hash").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"))  # both depend on the text alone
    met = materialise(distinct.select("text_hash", "fp", F.posexplode("bands").alias("band", "key")), "copy-bands")
    sizes = met.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1")
    parts = F.ceil(F.col("n") / bucket).cast("int")
    dealt = met.join(sizes, ["band", "key"]).withColumn("part", F.pmod(F.xxhash64("text_hash"), parts).cast("int"))
    # Every part is compared within itself and, where there are several, the first part with each other one;
    # what this leaves apart in buckets that are not compared pair by pair is compared below.
    dealt = dealt.withColumn("q", F.explode(F.when(F.col("part") == 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.array("part"))))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["band", "key", "q", "text_hash"]
    pairs = dealt.select("band", "key", "q", "part", "text_hash", "fp").repartition(n, "band", "key", "q").sortWithinPartitions(*order).mapInArrow(_nearest(radius), "u long, v long")
    pairs = materialise(pairs.distinct(), "copy-pairs")
    large = materialise(sizes.filter(F.col("n") > min(SMALL, bucket)).select("band", "key"), "copy-large-keys")
    wanted = pairs.select(F.col("u").alias("text_hash")).unionByName(pairs.select(F.col("v").alias("text_hash")))
    wanted = wanted.unionByName(met.join(large, ["band", "key"], "left_semi").select("text_hash")).distinct()
    texts = rows.select("text_hash", "text").join(wanted, "text_hash", "left_semi").mapInArrow(_shingle_sets(shingle), "text_hash long, held binary")
    sets = materialise(texts.groupBy("text_hash").agg(F.first("held").alias("held")), "copy-sets")
    checked = pairs.join(sets.toDF("u", "a"), "u").join(sets.toDF("v", "b"), "v").select("u", "v", "a", "b")
    linked = materialise(checked.mapInArrow(_alike(similarity), "u long, v long"), "copy-links")
    members = materialise(connected_components(linked), "copy-classes")  # stored, so that the join can split a text with many rows
    more = _links_left(met, large, members.toDF("text_hash", "component"), sets, radius, similarity, part)
    if more is not None:
        linked = linked.unionByName(materialise(more, "copy-links-left"))
        members = materialise(connected_components(linked), "copy-classes")
    return prints.select("doc_id", "text_hash").join(members.toDF("text_hash", "component"), "text_hash", "left").select("doc_id", "text_hash", F.coalesce("component", "text_hash").alias("root"))


def keep_one(docs: DataFrame, shingle: int = COPY_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """One row of each group of near copies, all its columns: the least doc_id, then the least text hash; a
    row without an id only where no row of the group has one. Texts shuffle once."""
    found = near_copies(docs, shingle, similarity)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "text_hash"))
    heads = found.groupBy("root").agg(first.alias("k")).select("root", F.col("k.doc_id").alias("h_id"), F.col("k.text_hash").alias("h_text"))
    copies = found.groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_text")).agg(F.count("*").alias("copies"))
    heads = materialise(heads.join(copies, heads["h_id"].eqNullSafe(copies["c_id"]) & (heads["h_text"] == copies["c_text"])).select("h_id", "h_text", "copies"), "copy-heads")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), text_hash().alias("text_hash"))
    kept = rows.join(heads, rows["id"].eqNullSafe(heads["h_id"]) & (rows["text_hash"] == heads["h_text"]))
    # Only rows that repeat id and text need a choice among them.
    chosen = kept.filter("copies > 1").groupBy("id", "text_hash").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return kept.filter("copies = 1").select("row.*").unionByName(chosen.select("row.*"))


def op6_bit_sliced_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
