"""Undeclared reuse: pairs, validation, edges and their timing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import ordering
from echograph.functions.text import seconds_between

#: Upper ends of latency buckets in seconds, half open; the last bucket has none.
BUCKETS = [(300, "<5min"), (3600, "5-60min"), (86400, "1-24h"), (604800, "1-7d"), (None, ">7d")]
FLOORS = [0, 300, 3600, 21600, 86400]
BARS = [1, 2, 3, 4, 5, 7, 10]


def earliest_by_channel(posts: DataFrame) -> DataFrame:
    """(key, channel, ts, msg_id, is_fwd): a channel's first dated post of a text."""
    fwd = F.coalesce("is_fwd", F.lit(False)) if "is_fwd" in posts.columns else F.lit(False)
    first = posts.filter("ts is not null and key is not null and channel is not null").groupBy("key", "channel").agg(F.min(F.struct("ts", "msg_id", fwd.alias("is_fwd"))).alias("m"), F.count("*").alias("n"))
    return first.select("key", "channel", "m.ts", "m.msg_id", "m.is_fwd", "n")


def star_pairs(posts: DataFrame, exclude_forwarded: bool = False) -> DataFrame:
    """The earliest poster of a text with each later channel: n channels give n - 1 rows. Ties go to the
    lesser channel. The origin is one row per key, so a hot text is one aggregate and a splittable join."""
    first = earliest_by_channel(posts)
    origin = first.groupBy("key").agg(F.min(F.struct("ts", "channel", "msg_id")).alias("o"), F.count("*").alias("n_channels")).filter("n_channels > 1")
    pairs = first.join(origin, "key").filter("channel <> o.channel")
    if exclude_forwarded:
        pairs = pairs.filter("not is_fwd")
    return pairs.select("key", F.col("o.channel").alias("a"), F.col("o.msg_id").alias("a_msg_id"), F.col("o.ts").alias("a_ts"), F.col("channel").alias("b"), F.col("msg_id").alias("b_msg_id"), F.col("ts").alias("b_ts"), F.lit(1.0).alias("sim"), "n_channels", "is_fwd")


def directed_copy_edges(posts: DataFrame) -> DataFrame:
    """(src, dst, n_texts, n_dst_fwd) from origins to later channels."""
    return star_pairs(posts).groupBy(F.col("a").alias("src"), F.col("b").alias("dst")).agg(F.count("*").alias("n_texts"), F.count_if("is_fwd").alias("n_dst_fwd"))


def cosine_pairs(vectors: DataFrame, threshold: float = 0.85, block: int = 8192, f16_compat: bool = False) -> DataFrame:
    """(i, j, sim) with i < j and sim >= threshold, for unit vectors (id, vec). Vectors are dealt into blocks;
    a task multiplies two blocks at a time and keeps only survivors, so memory is two blocks and each vector
    travels once per block. Products are in double precision; f16_compat rounds kept similarities to half."""
    rows = vectors.filter("vec is not null").select(F.col("id").cast("long").alias("id"), "vec")
    blocks = max(1, -(-rows.count() // block))
    b = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    dealt = rows.withColumn("b", b).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(F.least("b", "o").alias("p"), F.greatest("b", "o").alias("q"), "b", "id", "vec")

    def multiply(table: pa.Table) -> pa.Table:
        ids, own = table.column("id").to_numpy(), table.column("b").to_numpy()
        p, q = table.column("p")[0].as_py(), table.column("q")[0].as_py()
        flat = table.column("vec").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        m = flat.astype(np.float64).reshape(table.num_rows, -1)
        left, right = np.flatnonzero(own == p), np.flatnonzero(own == q)
        out_i, out_j, out_s = [], [], []
        for at in range(0, len(left), 256):
            rows_ = left[at : at + 256]
            s = m[rows_] @ m[right].T
            x, y = np.nonzero(s >= threshold)
            i, j, v = ids[rows_[x]], ids[right[y]], s[x, y]
            keep = (i < j) if p == q else np.ones(len(i), bool)
            i, j, v = i[keep], j[keep], v[keep]
            out_i.append(np.minimum(i, j)), out_j.append(np.maximum(i, j)), out_s.append(v.astype(np.float16).astype(float) if f16_compat else v)
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
        return pa.table({"i": join(out_i, np.int64), "j": join(out_j, np.int64), "sim": join(out_s, np.float64)})

    return dealt.groupBy("p", "q").applyInArrow(multiply, "i long, j long, sim double")


def representatives(occurrences: DataFrame) -> DataFrame:
    """Occurrences (key, channel, msg_id, ts) with is_rep, the earliest post of each text, and n_channels."""
    per = occurrences.groupBy("key").agg(F.min(F.struct("ts", "channel", "msg_id")).alias("_rep"), F.count_distinct("channel").alias("n_channels"))
    return occurrences.join(per, "key").withColumn("is_rep", F.struct("ts", "channel", "msg_id") == F.col("_rep")).drop("_rep")


def expand_pairs(pairs: DataFrame, occurrences: DataFrame, mode: str = "representative", cap: int = 10_000) -> DataFrame:
    """Text pairs (i, j, sim) to post pairs over occurrences (key, channel, msg_id, ts, is_rep). With
    ``all``, a pair with more than ``cap`` combinations keeps each side's earliest post only (capped)."""
    if mode == "representative":
        occ = occurrences.filter("is_rep")
        wide = None
    else:
        order = Window.partitionBy("key").orderBy("ts", "channel", "msg_id")
        occ = occurrences.withColumn("_first", F.row_number().over(order) == 1)
        wide = occurrences.groupBy("key").agg(F.count("*").alias("n"))
    side = lambda p: occ.select(*[F.col(c).alias(f"{p}_{c}" if c != "key" else f"{p}_key") for c in occ.columns])
    joined = pairs
    if wide is not None:
        joined = joined.join(wide.select(F.col("key").alias("i"), F.col("n").alias("a_n")), "i").join(wide.select(F.col("key").alias("j"), F.col("n").alias("b_n")), "j").withColumn("capped", F.col("a_n") * F.col("b_n") > cap)
    else:
        joined = joined.withColumn("capped", F.lit(False))
    a, b = side("a"), side("b")
    if wide is not None:
        out = joined.join(a, (joined.i == a.a_key) & (~F.col("capped") | F.col("a__first"))).join(b, (F.col("j") == b.b_key) & (~F.col("capped") | F.col("b__first")))
    else:
        out = joined.join(a, joined.i == a.a_key).join(b, F.col("j") == b.b_key)
    more = ["n_channels"] if "n_channels" in occurrences.columns else []
    return out.select(*[F.col(f"{p}_{c}").alias(p if c == "channel" else f"{p}_{c}") for p in "ab" for c in ("channel", "msg_id", "ts", *more)], "sim", "capped")


def keep_threshold(la: Column, lb: Column, same: float = 0.98, cross: float = 0.95, unknown: float = 0.98) -> Column:
    """The least similarity that counts between two classes."""
    either = la.isNull() | lb.isNull() | (la == "unknown") | (lb == "unknown")
    return F.when(either, F.lit(unknown)).when(la == lb, F.lit(same)).otherwise(F.lit(cross))


def is_cross(la: Column, lb: Column) -> Column:
    """True across classes, false within, null if a side is unknown."""
    either = la.isNull() | lb.isNull() | (la == "unknown") | (lb == "unknown")
    return F.when(~either, la != lb)


def without_declared(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """Pairs where neither message names the other's channel; mentions: (channel, msg_id, target)."""
    m = mentions.select("channel", "msg_id", "target").distinct()
    for me, other in (("a", "b"), ("b", "a")):
        pairs = pairs.join(m, (F.col(me) == m.channel) & (F.col(f"{me}_msg_id") == m.msg_id) & (F.col(other) == m.target), "left_anti")
    return pairs


def declared_drops(pairs: DataFrame, mentions: DataFrame) -> DataFrame:
    """(n_before, n_kept, n_dropped) of the declared exclusion."""
    before = pairs.agg(F.count("*").alias("n_before"))
    kept = without_declared(pairs, mentions).agg(F.count("*").alias("n_kept"))
    return before.join(F.broadcast(kept), F.lit(True)).select("n_before", "n_kept", (F.col("n_before") - F.col("n_kept")).alias("n_dropped"))


def orient(pairs: DataFrame) -> DataFrame:
    """u is the lesser channel; ids and dates swap along; a vote says who came first; latency in seconds."""
    flip = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(flip, F.col(y)).otherwise(F.col(x))
    out = pairs.select(pick("a", "b").alias("u"), pick("b", "a").alias("v"), pick("a_msg_id", "b_msg_id").alias("u_msg_id"), pick("a_ts", "b_ts").alias("u_ts"), pick("b_msg_id", "a_msg_id").alias("v_msg_id"), pick("b_ts", "a_ts").alias("v_ts"), *[c for c in pairs.columns if c not in ("a", "b", "a_msg_id", "b_msg_id", "a_ts", "b_ts")])
    vote = F.when(F.col("u_ts").isNull() | F.col("v_ts").isNull(), None).when(F.col("u_ts") < F.col("v_ts"), "u").when(F.col("u_ts") > F.col("v_ts"), "v").otherwise("tie")
    return out.withColumn("vote", vote).withColumn("latency_s", F.abs(seconds_between(F.col("v_ts"), F.col("u_ts"))))


def validate(pairs: DataFrame, members: DataFrame, classes: DataFrame, mentions: DataFrame | None = None, same: float = 0.98, cross: float = 0.95, unknown: float = 0.98) -> DataFrame:
    """Self pairs, outsiders, pairs under their class's threshold and declared pairs go; the rest is oriented."""
    inside = members.select("handle").distinct()
    out = pairs.filter("a <> b")
    for side in "ab":
        out = out.join(inside.withColumnRenamed("handle", side), side, "left_semi")
        out = out.join(classes.select(F.col("handle").alias(side), F.col("cls").alias(f"{side}_cls")), side, "left")
    la, lb = F.coalesce("a_cls", F.lit("unknown")), F.coalesce("b_cls", F.lit("unknown"))
    out = out.filter(F.col("sim") >= keep_threshold(la, lb, same, cross, unknown)).withColumn("is_cross", is_cross(la, lb)).drop("a_cls", "b_cls")
    return orient(without_declared(out, mentions) if mentions is not None else out)


def edge_table(pairs: DataFrame) -> DataFrame:
    """Undirected edges of oriented pairs (with layer semantic or copy): counts, votes, similarities of the
    semantic layer, mean latency of each layer, reciprocity."""
    sem, cop = F.col("layer") == "semantic", F.col("layer") == "copy"
    votes = [F.count_if(on & (F.col("vote") == v)).alias(f"n_{name}{suffix}") for on, suffix in ((sem, ""), (cop, "_copy")) for v, name in (("u", "u_first"), ("v", "v_first"), ("tie", "tie"))]
    out = pairs.groupBy("u", "v").agg(
        F.count_if(sem).alias("n_semantic"), F.count_if(cop).alias("n_copy"), *votes,
        F.round(F.avg(F.when(sem, F.col("sim"))), 4).alias("mean_sim"), F.round(F.max(F.when(sem, F.col("sim"))), 4).alias("max_sim"),
        F.round(F.avg(F.when(sem, F.col("latency_s"))), 1).alias("mean_latency_s"), F.round(F.avg(F.when(cop, F.col("latency_s"))), 1).alias("mean_latency_copy"),
        F.bool_or("is_cross").alias("is_cross"),
    )
    return out.withColumn("reciprocal", (F.col("n_u_first") > 0) & (F.col("n_v_first") > 0))


def directed_edges(pairs: DataFrame, strong: float = 0.9) -> DataFrame:
    """Post pairs to earlier-to-later channel edges, ties to the first side, with the true median latency."""
    forward = F.col("a_ts") <= F.col("b_ts")
    rows = pairs.select(F.when(forward, F.col("a")).otherwise(F.col("b")).alias("src"), F.when(forward, F.col("b")).otherwise(F.col("a")).alias("dst"), "sim", F.abs(seconds_between(F.col("b_ts"), F.col("a_ts"))).alias("lat"))
    return rows.groupBy("src", "dst").agg(F.count("*").alias("n_texts"), F.count_if(F.col("sim") >= strong).alias("n_strong"), F.round(F.avg("sim"), 4).alias("mean_sim"), F.round(F.max("sim"), 4).alias("max_sim"), F.median("lat").alias("median_latency_s"))


def bucket(latency: Column, edges: list = BUCKETS) -> Column:
    out = None
    for end, name in edges:
        if end is None:
            return out.otherwise(name)
        out = F.when(latency < end, name) if out is None else out.when(latency < end, name)
    return out


def latency_histogram(pairs: DataFrame, edges: list = BUCKETS) -> DataFrame:
    """Per class: pairs in each bucket, their number, and the upper median of the latencies."""
    dated = pairs.filter("latency_s is not null")
    counts = dated.groupBy("cls").agg(*[F.count_if(bucket(F.col("latency_s"), edges) == name).alias(name) for _, name in edges], F.count("*").alias("n_pairs"))
    mid = ordering.middle(dated, ["cls"], "latency_s", "median_s")
    return counts.join(mid.select("cls", F.round("median_s", 1).alias("median_s")), "cls")


def latency_by_bar(pairs: DataFrame, bars: list[int]) -> DataFrame:
    """Per class and bar: pairs on edges with that many pairs or more, those under five minutes, median."""
    sizes = pairs.groupBy("u", "v").agg(F.count("*").alias("n_edge"))
    rows = pairs.filter("latency_s is not null").join(sizes, ["u", "v"]).withColumn("bar", F.explode(F.array(*map(F.lit, bars)))).filter("n_edge >= bar")
    counts = rows.groupBy("cls", "bar").agg(F.count("*").alias("n_pairs"), F.count_if(F.col("latency_s") < 300).alias("lt5min"))
    mid = ordering.middle(rows, ["cls", "bar"], "latency_s", "median_s")
    return counts.join(mid.select("cls", "bar", F.round("median_s", 1).alias("median_s")), ["cls", "bar"])


def direction_pivot(pairs: DataFrame, floors: list = FLOORS, ks: list[int] = BARS, by: list[str] | None = None) -> DataFrame:
    """Per floor and k: edges whose votes at or above the floor number k or more, and the unanimous ones.
    Unanimity is judged after the votes under the floor are gone."""
    by = by or []
    rows = pairs.filter("vote in ('u', 'v')").withColumn("floor_s", F.explode(F.array(*map(F.lit, floors)))).filter("latency_s >= floor_s")
    edges = rows.groupBy(*by, "u", "v", "floor_s").agg(F.count_if(F.expr("vote = 'u'")).alias("nu"), F.count_if(F.expr("vote = 'v'")).alias("nv"))
    bars = edges.withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("nu + nv >= k")
    return bars.groupBy(*by, "k", "floor_s").agg(F.count("*").alias("n_edges"), F.count_if(F.expr("nu = 0 or nv = 0")).alias("n_unanimous"))


def build_summary(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n_edges"), F.sum("n_semantic").alias("n_semantic"), F.sum("n_copy").alias("n_copy"), F.count_if("reciprocal").alias("n_reciprocal"), F.count_if("is_cross").alias("n_cross"))


def freeze(edges: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """The published columns of an edge table, with the classes of both ends where (handle, cls) are given."""
    out = edges.select("u", "v", "n_semantic", "n_copy", "n_u_first", "n_v_first", "n_tie", "mean_sim", "max_sim", "mean_latency_s", "is_cross", "n_u_first_copy", "n_v_first_copy", "n_tie_copy", "mean_latency_copy")
    if classes is None:
        return out
    c = classes.select("handle", "cls")
    return out.join(c.toDF("u", "u_cls"), "u", "left").join(c.toDF("v", "v_cls"), "v", "left")


def sample_accuracy(samples: DataFrame) -> DataFrame:
    return samples.groupBy("sample", "threshold").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "yes").alias("n_yes")).withColumn("accuracy", F.col("n_yes") / F.col("n"))
