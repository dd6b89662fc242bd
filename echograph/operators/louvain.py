"""Modularity communities: local moves, refinement into connected parts, aggregation.

One algorithm in whole numbers, so that it gives the same communities in memory and over DataFrames: in
memory only after a count has shown a small graph.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echograph.functions import ordering
from echograph.operators.components import connected_components
from echograph.session import discard, materialise, stored

#: Vertices move in two halves, told apart by a hash: moves of all at once could swap for ever.
_A, _B, _C, _P = 40503, 7919, 104729, 65537


def _turn(node, seed: int, turn: int):
    """Whether it is a vertex's turn; for numpy arrays and columns alike."""
    return ((node * _A + (seed * _B + turn // 2 * _C) % _P) % _P + turn) % 2 == 0


def in_memory(u: np.ndarray, v: np.ndarray, n: int, seed: int, levels: int, rounds: int) -> np.ndarray:
    """The community, named by its least vertex, of each of n vertices."""
    src, dst, w = np.concatenate([u, v]), np.concatenate([v, u]), np.ones(2 * len(u), np.int64)
    total, reached, member = int(w.sum()), None, np.arange(n)
    for level in range(levels if total else 0):
        deg = np.bincount(src, w, n).astype(np.int64)
        nodes = np.unique(src)
        label = np.arange(n)
        still = 0
        loose = src != dst
        for turn in range(rounds):
            volume = np.bincount(label[nodes], deg[nodes], n).astype(np.int64)
            key = np.concatenate([src[loose] * n + label[dst[loose]], nodes * n + label[nodes]])
            pair, at = np.unique(key, return_inverse=True)
            links = np.bincount(at, np.concatenate([w[loose], np.zeros(len(nodes), np.int64)])).astype(np.int64)
            node, to = pair // n, pair % n
            here = to == label[node]
            gain = links * total - (volume[to] - np.where(here, deg[node], 0)) * deg[node]
            order = np.lexsort((-to, here, gain, node))
            last = np.flatnonzero(np.append(node[order][1:] != node[order][:-1], True))
            best = to[order[last]]
            go = _turn(nodes, seed + level, turn) & (best != label[nodes])
            label[nodes[go]] = best[go]
            still = 0 if go.any() else still + 1
            if still == 2:
                break
        inside = label[src] == label[dst]
        volume = np.bincount(label[nodes], deg[nodes], n).astype(np.int64)
        quality = int(w[inside].sum()) * total - sum(int(x) ** 2 for x in volume.tolist())
        if reached is not None and quality <= reached:
            break
        reached, part = quality, np.arange(n)
        a, b = src[inside], dst[inside]
        while True:  # the least vertex that links within the community reach
            least = part.copy()
            np.minimum.at(least, a, part[b])
            least = least[least]
            if (least == part).all():
                break
            part = least
        member = part[member]
        pair, at = np.unique(part[src] * n + part[dst], return_inverse=True)
        src, dst, w = pair // n, pair % n, np.bincount(at, w).astype(np.int64)
    return member


def _moved(e: DataFrame, label: DataFrame, deg: DataFrame, total: int, seed: int, turn: int) -> DataFrame:
    """(id, community, moved) after a round in which half of the vertices may go to the neighbouring
    community that gains most; equal gains keep a vertex where it is, then prefer the least community."""
    whole = lambda c: c.cast("decimal(38,0)")
    own = deg.join(label, "id")
    volume = own.groupBy(F.col("community").alias("to")).agg(F.sum("d").alias("vol"))
    links = e.filter("src <> dst").join(label.toDF("dst", "to"), "dst").select(F.col("src").alias("id"), "to", "w")
    stay = own.select("id", F.col("community").alias("to"), F.lit(0).cast("long").alias("w"))  # with no links to it, too
    rated = links.unionByName(stay).groupBy("id", "to").agg(F.sum("w").alias("w")).join(own, "id").join(volume, "to")
    here = F.col("to") == F.col("community")
    gain = whole(whole(F.col("w")) * total) - whole(whole(F.col("vol") - F.when(here, F.col("d")).otherwise(0)) * F.col("d"))
    best = rated.groupBy("id", "community").agg(F.max(F.struct(whole(gain).alias("gain"), here.alias("here"), (-F.col("to")).alias("to"))).alias("b"))
    go = _turn(F.col("id"), seed, turn) & (-F.col("b.to") != F.col("community"))
    return best.select("id", F.when(go, -F.col("b.to")).otherwise(F.col("community")).alias("community"), go.alias("moved"))


def _quality(e: DataFrame, label: DataFrame, deg: DataFrame, total: int) -> int:
    """Modularity times the square of the total weight: weight inside, less what the volumes give by chance."""
    inner = e.join(label.toDF("src", "cs"), "src").join(label.toDF("dst", "cd"), "dst").filter("cs = cd").agg(F.sum("w")).first()[0] or 0
    volumes = deg.join(label, "id").groupBy("community").agg(F.sum("d").cast("decimal(19,0)").alias("vol"))
    return inner * total - int(volumes.agg(F.sum((F.col("vol") * F.col("vol")).cast("decimal(38,0)"))).first()[0] or 0)


def distributed(edges: DataFrame, seed: int, levels: int, rounds: int) -> DataFrame:
    """(id, part) of edges (u, v) between numbered vertices. State lies in the shared folder; a round
    replaces the one before. The driver sees sums only."""
    spark = edges.sparkSession
    both = edges.select(F.col("u").alias("src"), F.col("v").alias("dst")).unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst")))
    e, e_path = stored(both.withColumn("w", F.lit(1).cast("long")), "community-edges")
    member = materialise(e.select(F.col("src").alias("id")).distinct().withColumn("part", F.col("id")), "community-members")
    total, reached = e.agg(F.sum("w")).first()[0] or 0, None
    for level in range(levels if total else 0):
        deg, deg_path = stored(e.groupBy(F.col("src").alias("id")).agg(F.sum("w").alias("d")), "community-degrees")
        label, path, still = deg.select("id", F.col("id").alias("community")), None, 0
        for turn in range(rounds):
            old, (label, path) = path, stored(_moved(e, label.select("id", "community"), deg, total, seed + level, turn), "community-labels")
            discard(spark, old)
            still = 0 if label.filter("moved").limit(1).count() else still + 1
            if still == 2:  # neither half of the vertices moves
                break
        label = label.select("id", "community")
        quality = _quality(e, label, deg, total)
        if reached is not None and quality <= reached:
            break
        reached = quality
        inner = e.join(label.toDF("src", "cs"), "src").join(label.toDF("dst", "cd"), "dst").filter("cs = cd and src < dst")
        joined = connected_components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))
        part = materialise(deg.select("id").join(joined.toDF("id", "part"), "id", "left").select("id", F.coalesce("part", "id").alias("part")), "community-parts")
        member = materialise(member.withColumnRenamed("part", "at").join(part.toDF("at", "part"), "at").select("id", "part"), "community-members")
        merged = e.join(part.toDF("src", "ps"), "src").join(part.toDF("dst", "pd"), "dst").groupBy(F.col("ps").alias("src"), F.col("pd").alias("dst")).agg(F.sum("w").alias("w"))
        old, (e, e_path) = e_path, stored(merged, "community-edges")
        for gone in (old, deg_path, path):
            discard(spark, gone)
    return member


def communities(edges: DataFrame, seed: int, levels: int = 10, rounds: int = 8, small: int = 200_000) -> DataFrame:
    """(id, community) of undirected edges (u, v), numbered by falling size, equal ones by their least
    vertex. Each level moves vertices for ``rounds`` rounds, or until nothing moves, splits the communities
    into their connected parts, and goes on with the parts as vertices as long as modularity grows. Up to
    ``small`` edges, by count, this runs in memory, with the same result."""
    spark = edges.sparkSession
    edges = materialise(edges.select("u", "v"), "community-input")
    kind = dict(edges.dtypes)["u"]
    if edges.count() <= small:
        rows = edges.toArrow()
        names, numbers = np.unique(np.array(rows.column("u").to_pylist() + rows.column("v").to_pylist()), return_inverse=True)
        member = in_memory(numbers[: rows.num_rows], numbers[rows.num_rows :], len(names), seed, levels, rounds) if len(names) else []
        size = np.bincount(member, minlength=len(names)) if len(names) else []
        order = sorted(set(np.asarray(member).tolist()), key=lambda c: (-size[c], c))
        place = {c: k for k, c in enumerate(order)}
        return spark.createDataFrame([(x, place[c]) for x, c in zip(names.tolist(), np.asarray(member).tolist())], f"id {kind}, community long")
    ids = edges.select(F.col("u").alias("id")).unionByName(edges.select(F.col("v").alias("id"))).distinct()
    names = materialise(ordering.numbered(ids, ["id"], "number").withColumn("number", F.col("number") - 1), "community-names")
    numbered = edges.join(names.toDF("u", "nu"), "u").join(names.toDF("v", "nv"), "v").select(F.col("nu").alias("u"), F.col("nv").alias("v"))
    member = distributed(numbered, seed, levels, rounds)
    sizes = member.groupBy("part").agg(F.count("*").alias("n"))
    named = ordering.numbered(sizes, [F.desc("n"), "part"], "place")
    out = member.join(named.select("part", (F.col("place") - 1).alias("community")), "part").join(names, F.col("number") == member["id"])
    return out.select(names["id"], "community")
