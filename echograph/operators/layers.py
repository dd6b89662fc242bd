"""Comparing declared and undeclared layers; orientation, evidence bars, significance."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echograph.functions import ordering


def all_rows():
    """One window over a table with a row for each class, tier or bar."""
    return Window.partitionBy(F.lit(1))


def pair_key(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


def disjointness(reuse: DataFrame, declared: DataFrame) -> DataFrame:
    """Reuse pairs (u, v) and how many are also declared, in either direction."""
    d = pair_key(declared, "src", "dst").withColumn("d", F.lit(1))
    return pair_key(reuse, "u", "v").join(d, ["u", "v"], "left").agg(F.count("*").alias("n_pairs"), F.count("d").alias("n_declared"), F.round(F.try_divide(F.count("d"), F.count("*")), 6).alias("share"))


def cross_not_declared(reuse: DataFrame, declared: DataFrame) -> DataFrame:
    return disjointness(reuse.filter("is_cross"), declared).withColumn("not_declared", F.round(1 - F.col("share"), 6))


def either_direction(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs with a flag: is there an edge one way or the other."""
    e = pair_key(edges, "src", "dst").withColumn("_e", F.lit(True))
    return pairs.withColumn("_u", F.least("u", "v")).withColumn("_v", F.greatest("u", "v")).join(e.toDF("_u", "_v", "_e"), ["_u", "_v"], "left").withColumn("linked", F.coalesce("_e", F.lit(False))).drop("_u", "_v", "_e")


def votes(edges: DataFrame, layer: str = "") -> DataFrame:
    """nu, nv and their sum nv_total of an edge table's layer ("" or "_copy")."""
    return edges.withColumn("nu", F.col(f"n_u_first{layer}")).withColumn("nv", F.col(f"n_v_first{layer}")).withColumn("votes", F.col("nu") + F.col("nv"))


def unanimous() -> Column:
    """Meaningful only where votes >= 1: no votes at all agree too."""
    return (F.col("nu") == 0) | (F.col("nv") == 0)


def source_of(nu: Column, nv: Column, u: Column, v: Column, min_votes: int) -> Column:
    """The earlier side of a confident edge, else null."""
    return F.when((nu + nv >= min_votes) & (nv == 0), u).when((nu + nv >= min_votes) & (nu == 0), v)


def directed_layer(edges: DataFrame, min_votes: int = 5, layer: str = "") -> DataFrame:
    """(src, dst) of edges with enough votes that all agree, earlier to later."""
    e = votes(edges, layer).withColumn("src", source_of(F.col("nu"), F.col("nv"), F.col("u"), F.col("v"), min_votes)).filter("src is not null")
    return e.select("src", F.when(F.col("src") == F.col("u"), F.col("v")).otherwise(F.col("u")).alias("dst"))


def bar_sweep(edges: DataFrame, bars: list[int], count: str = "n_semantic") -> DataFrame:
    """Per bar: edges, vertices and cross edges that remain."""
    rows = edges.withColumn("bar", F.explode(F.array(*map(F.lit, bars)))).filter(F.col(count) >= F.col("bar"))
    ends = rows.select("bar", F.col("u").alias("id")).unionByName(rows.select("bar", F.col("v").alias("id"))).groupBy("bar").agg(F.count_distinct("id").alias("n_vertices"))
    return rows.groupBy("bar").agg(F.count("*").alias("n_edges"), F.count_if(F.coalesce("is_cross", F.lit(False))).alias("n_cross")).join(ends, "bar")


def bar_structure(edges: DataFrame, bars: list[int], count: str = "n_semantic") -> DataFrame:
    """Per bar: vertices, edges, density, giant component, transitivity and degree assortativity of what
    remains; a plan for each of the few bars."""
    from echograph.operators import graph

    out = None
    for bar in bars:
        e = edges.filter(F.col(count) >= bar).select(F.col("u").alias("src"), F.col("v").alias("dst"))
        g = graph.Graph.from_edges(e)
        giant = g.component_census().agg(F.max("size").alias("giant"))
        parts = [g.density().select("n", "m", F.col("undirected_density").alias("density")), giant, g.triangles().select("transitivity"), graph.degree_assortativity(g.edges)]
        row = parts[0]
        for more in parts[1:]:
            row = row.join(F.broadcast(more), F.lit(True))  # one row each
        row = row.select(F.lit(bar).alias("bar"), "n", "m", "density", "giant", "transitivity", "assortativity")
        out = row if out is None else out.unionByName(row)
    return out


def direction_by_k(edges: DataFrame, top: int = 10, layer: str = "") -> DataFrame:
    """Per k: edges with k votes or more, one-way and both ways."""
    rows = votes(edges, layer).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(top)))).filter("votes >= k")
    return rows.groupBy("k").agg(F.count("*").alias("n_edges"), F.count_if(unanimous()).alias("n_one_way"), F.count_if(~unanimous()).alias("n_both"), F.round(F.count_if(~unanimous()) / F.count("*"), 6).alias("both_share"))


def fair_coin(edges: DataFrame, ks: list[int], layer: str = "") -> DataFrame:
    """Per k: unanimous edges against what fair coins give: sum of 2^(1 - votes), and its variance."""
    rows = votes(edges, layer).withColumn("k", F.explode(F.array(*map(F.lit, ks)))).filter("votes >= k").withColumn("p", F.pow(F.lit(0.5), F.col("votes") - 1))
    out = rows.groupBy("k").agg(F.count("*").alias("base"), F.count_if(unanimous()).alias("observed"), F.sum("p").alias("expected"), F.sum(F.col("p") * (1 - F.col("p"))).alias("var"))
    excess = F.col("observed") - F.col("expected")
    return out.select("k", "base", "observed", F.round("expected", 6).alias("expected"), F.round(excess, 6).alias("excess"), F.round(F.try_divide(F.col("expected"), F.col("observed")), 6).alias("contamination"), F.round(F.try_divide(excess, F.sqrt("var")), 6).alias("z"))


def pivot_shares(pivot: DataFrame) -> DataFrame:
    return pivot.withColumn("both_share", F.round(1 - F.col("n_unanimous") / F.col("n_edges"), 6))


def schedule_offset(edges: DataFrame, modal: DataFrame) -> DataFrame:
    """Does the earlier side merely post earlier in the day: circular hour difference of (src, dst)."""
    m = modal.select("channel", "modal_hour")
    e = edges.join(m.toDF("src", "hs"), "src").join(m.toDF("dst", "hd"), "dst").withColumn("d", F.pmod(F.col("hd") - F.col("hs") + 12, F.lit(24)) - 12)
    return e.agg(F.count_if(F.expr("d > 0")).alias("n_earlier"), F.count_if(F.expr("d < 0")).alias("n_later"), F.count_if(F.expr("d = 0")).alias("n_tie"))


def schedule_offset_p(counts: DataFrame) -> DataFrame:
    """The counts of ``schedule_offset`` (one row) with the two-sided binomial p of earlier against later."""
    from echograph.functions.stats import binom_test

    r = counts.first()
    n = r.n_earlier + r.n_later
    p = binom_test(r.n_earlier, n) if n <= 10_000 else normal_two_sided(r.n_earlier, n)
    return counts.withColumn("p", F.lit(p if n else 1.0))


def connectors(edges: DataFrame, min_votes: int) -> DataFrame:
    """(id, links, n_out, n_in, net) from oriented edges, with rank."""
    e = votes(edges).withColumn("src", source_of(F.col("nu"), F.col("nv"), F.col("u"), F.col("v"), min_votes))
    ends = e.select(F.col("u").alias("id"), "src").unionByName(e.select(F.col("v").alias("id"), "src"))
    out = ends.groupBy("id").agg(F.count("*").alias("links"), F.count_if(F.expr("src = id")).alias("n_out"), F.count_if(F.expr("src <> id")).alias("n_in"))
    return out.withColumn("net", F.col("n_out") - F.col("n_in")).transform(ordering.numbered, [F.desc("links"), "id"], "rank")


def brokers(edges: DataFrame, cls: DataFrame, min_votes: int) -> DataFrame:
    """Per class: each member's cross-class links, its share of them, and their confident split."""
    e = votes(edges).join(cls.toDF("u", "cu"), "u").join(cls.toDF("v", "cv"), "v").filter("cu <> cv").withColumn("src", source_of(F.col("nu"), F.col("nv"), F.col("u"), F.col("v"), min_votes))
    ends = e.select(F.col("u").alias("id"), F.col("cu").alias("cls"), F.col("cv").alias("partner"), "src").unionByName(e.select(F.col("v").alias("id"), F.col("cv").alias("cls"), F.col("cu").alias("partner"), "src"))
    out = ends.groupBy("cls", "id").agg(F.count("*").alias("links"), F.count_if(F.expr("src = id")).alias("n_out"), F.count_if(F.expr("src <> id")).alias("n_in"))
    return out.withColumn("share", F.round(F.col("links") / F.sum("links").over(Window.partitionBy("cls")), 6))


def partner_mix(edges: DataFrame, cls: DataFrame, top: int = 3) -> DataFrame:
    """(id, n_partners, mix): classes of a channel's partners as text, most frequent first."""
    both = edges.select(F.col("u").alias("id"), F.col("v").alias("p")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("p")))
    n = both.join(cls.toDF("p", "cls"), "p", "left").groupBy("id", F.coalesce("cls", F.lit("unknown")).alias("cls")).agg(F.count("*").alias("n"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "cls")))
    return n.groupBy("id").agg(F.sum("n").alias("n_partners"), F.array_join(F.transform(F.slice(ordered, 1, top), lambda x: F.concat(x["cls"], F.lit(" "), (-x["o"]).cast("string"))), ", ").alias("mix"))


def provenance(df: DataFrame, shown: Column) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(shown).alias("n_shown"))


def concentration(df: DataFrame, key: str, n: str, tops: list[int]) -> DataFrame:
    """Share of the total that the first 1, 4, 10 ... keys hold."""
    first = df.orderBy(F.desc(n), key).limit(max(tops)).withColumn("_r", F.row_number().over(all_rows().orderBy(F.desc(n), key)))  # max(tops) rows
    head = first.agg(*[F.sum(F.when(F.col("_r") <= t, F.col(n)).otherwise(0)).alias(f"top{t}") for t in tops])
    total = df.agg(F.count("*").alias("n_keys"), F.sum(n).alias("total"))
    return total.join(F.broadcast(head), F.lit(True)).select("n_keys", "total", *[F.round(F.col(f"top{t}") / F.col("total"), 6).alias(f"top{t}") for t in tops])


def split_by_bars(edges: DataFrame, membership: DataFrame, bars: list[int]) -> DataFrame:
    """Per community and bar: edges inside it with enough votes, and the unanimous ones."""
    m = membership.select("id", "community")
    e = votes(edges).join(m.toDF("u", "cu"), "u").join(m.toDF("v", "cv"), "v").filter("cu = cv").withColumn("bar", F.explode(F.array(*map(F.lit, bars)))).filter("votes >= bar")
    return e.groupBy(F.col("cu").alias("community"), "bar").agg(F.count("*").alias("n_edges"), F.count_if(unanimous()).alias("n_one_way"))


def orientation_coverage(edges: DataFrame, min_votes: int) -> DataFrame:
    """Edges, those with enough votes, those that agree, and what chance would give of the latter."""
    v = votes(edges)
    enough = F.col("votes") >= min_votes
    return v.agg(F.count("*").alias("n_edges"), F.count_if(enough).alias("n_eligible"), F.count_if(enough & unanimous()).alias("n_oriented"), F.round(F.sum(F.when(enough, 2 * F.pow(F.lit(0.5), F.col("votes"))).otherwise(0.0)), 6).alias("by_chance"))


def pareto(df: DataFrame, key: str, n: str) -> DataFrame:
    """(key, n, rank, cum_share): running share of the total, largest first."""
    placed = ordering.numbered(df.select(key, n), [F.desc(n), key], "rank", {"_run": n})
    total = df.agg(F.sum(n).alias("_total"))
    return placed.join(F.broadcast(total), F.lit(True)).select(key, n, "rank", F.round(F.col("_run") / F.col("_total"), 6).alias("cum_share"))


def rank_of(df: DataFrame, col: str) -> DataFrame:
    """1 plus the number of greater values."""
    return ordering.ranked(df, col, "rank", "least", descending=True)


def partners(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("id"), F.col("v").alias("p")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("p"))).distinct()


def partner_overlap(edges: DataFrame, anchors: DataFrame | None = None, keep: DataFrame | None = None) -> DataFrame:
    """(a, b, n_both, n_a, n_b, of_smaller, jaccard) over pairs of channels with a shared partner."""
    p = partners(edges)
    if keep is not None:
        p = p.join(keep.select(F.col("id").alias("p")), "p", "left_semi").select("id", "p")
    if anchors is not None:
        p = p.join(anchors.select("id"), "id", "left_semi").select("id", "p")
    size = p.groupBy("id").agg(F.count("*").alias("n"))
    both = p.toDF("a", "p").join(p.toDF("b", "p"), "p").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n_both"))
    out = both.join(size.toDF("a", "n_a"), "a").join(size.toDF("b", "n_b"), "b")
    return out.select("a", "b", "n_both", "n_a", "n_b", F.round(F.col("n_both") / F.least("n_a", "n_b"), 6).alias("of_smaller"), F.round(F.col("n_both") / (F.col("n_a") + F.col("n_b") - F.col("n_both")), 6).alias("jaccard"))


def direction_index(edges: DataFrame, cls: DataFrame, min_votes: int) -> DataFrame:
    """Per unordered class pair: edges, orientable share, and (forward - back) / oriented in -1..1."""
    e = votes(edges).join(cls.toDF("u", "cu"), "u").join(cls.toDF("v", "cv"), "v").filter("cu <> cv").withColumn("src", source_of(F.col("nu"), F.col("nv"), F.col("u"), F.col("v"), min_votes))
    from_ = F.when(F.col("src") == F.col("u"), F.col("cu")).when(F.col("src") == F.col("v"), F.col("cv"))
    g = e.withColumn("f", from_).groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count("*").alias("n"), F.count("f").alias("o"), F.count_if(F.col("f") == F.least("cu", "cv")).alias("fa"))
    return g.select("a", "b", F.col("n").alias("n_edges"), F.round(F.col("o") / F.col("n"), 6).alias("orientable"), F.round(F.try_divide(2 * F.col("fa") - F.col("o"), F.col("o")), 6).alias("direction_index"))


def cross_layer_channels(edges: DataFrame, directed: DataFrame, declared: DataFrame) -> DataFrame:
    """Per channel: undirected links, directed verdict and declared verdict (out, in, both, none)."""
    links = partners(edges).groupBy("id").agg(F.count("*").alias("links"))

    def verdict(e: DataFrame, name: str) -> DataFrame:
        ends = e.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(e.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        s = ends.groupBy("id").agg(F.max("o").alias("o"), F.max("i").alias("i"))
        return s.select("id", F.when((F.col("o") == 1) & (F.col("i") == 1), "both").when(F.col("o") == 1, "out").otherwise("in").alias(name))

    return links.join(verdict(directed, "directed"), "id", "full_outer").join(verdict(declared, "declared"), "id", "full_outer").na.fill(0, ["links"]).na.fill("none", ["directed", "declared"])


def layer_partner_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per channel: partners in each layer (u, v) and in both."""
    pa, pb = partners(a).withColumn("x", F.lit(1)), partners(b).withColumn("y", F.lit(1))
    return pa.join(pb, ["id", "p"], "full_outer").groupBy("id").agg(F.count("x").alias("n_a"), F.count("y").alias("n_b"), F.count(F.col("x") + F.col("y")).alias("n_both"))


def division_of_labour(flows: DataFrame, supply: str = "exports", take: str = "imports") -> DataFrame:
    role = F.when((F.col(supply) > 0) & (F.col(take) > 0), "both").when(F.col(supply) > 0, "supplier").when(F.col(take) > 0, "importer").otherwise("neither")
    return flows.groupBy(role.alias("role")).agg(F.count("*").alias("n"), F.median(supply).alias("median_supply"), F.round(F.avg(supply), 6).alias("mean_supply"), F.count_if(F.col(take) == 0).alias("zero_take"))


def availability(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per class: share of imports over share of nodes."""
    i = imports.groupBy("cls").agg(F.count("*").alias("n_imports")).withColumn("import_share", F.col("n_imports") / F.sum("n_imports").over(all_rows()))
    n = nodes.groupBy("cls").agg(F.count("*").alias("n_nodes")).withColumn("node_share", F.col("n_nodes") / F.sum("n_nodes").over(all_rows()))
    return n.join(i, "cls", "left").na.fill(0, ["n_imports"]).na.fill(0.0, ["import_share"]).select("cls", "n_imports", "n_nodes", F.round(F.col("import_share") / F.col("node_share"), 6).alias("ratio"))


def roles_by_depth(roles: DataFrame, depth: DataFrame) -> DataFrame:
    return roles.join(depth, "id").groupBy("depth", "role").agg(F.count("*").alias("n"))


def outside_share(edges: DataFrame, depth: DataFrame) -> DataFrame:
    """Per depth of the forwarding member: its edges, and the share that come from outside the members."""
    d = depth.select("id", "depth")
    e = edges.join(d.toDF("dst", "depth"), "dst").join(d.select(F.col("id").alias("src"), F.lit(1).alias("_in")), "src", "left")
    return e.groupBy("depth").agg(F.count("*").alias("n_edges"), F.count_if(F.col("_in").isNull()).alias("n_outside"), F.round(F.count_if(F.col("_in").isNull()) / F.count("*"), 6).alias("share"))


def term_overlap(terms: DataFrame, a: str, b: str) -> DataFrame:
    """Shared and own terms of two communities, and their Jaccard index; terms: (community, term)."""
    side = lambda c: F.array_sort(F.collect_set(F.when(F.col("community") == c, F.col("term"))))
    s = terms.agg(side(a).alias("x"), side(b).alias("y"))
    return s.select(F.array_intersect("x", "y").alias("shared"), F.array_except("x", "y").alias("only_a"), F.array_except("y", "x").alias("only_b"), F.round(F.try_divide(F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))), 6).alias("jaccard"))


def tier_direction(directed: DataFrame, top: DataFrame) -> DataFrame:
    """Four cells of directed edges by whether their ends are in a tier."""
    t = top.select("id", F.lit(True).alias("t"))
    e = directed.join(t.toDF("src", "a"), "src", "left").join(t.toDF("dst", "b"), "dst", "left").na.fill(False, ["a", "b"])
    return e.groupBy(F.col("a").alias("src_top"), F.col("b").alias("dst_top")).agg(F.count("*").alias("n"))


def tier_base_rate(df: DataFrame, value: str, flag: str, tiers: int = 10) -> DataFrame:
    """Per percentile tier of value: rows and flagged share, with the overall share beside it."""
    r, n = F.col("_r") - 1, F.col("_n")
    size, more = F.floor(n / tiers), n % tiers
    t = ordering.numbered(df, [F.desc(value), "id"], "_r").join(F.broadcast(df.agg(F.count("*").alias("_n"))), F.lit(True))
    t = t.withColumn("tier", (F.when(r < more * (size + 1), F.floor(r / (size + 1))).otherwise(more + F.floor((r - more * (size + 1)) / F.greatest(size, F.lit(1)))) + 1).cast("int"))
    return t.groupBy("tier").agg(F.count("*").alias("n"), F.round(F.avg(F.col(flag).cast("double")), 6).alias("share")).withColumn("base", F.round(F.sum(F.col("share") * F.col("n")).over(all_rows()) / F.sum("n").over(all_rows()), 4))


def out_profile(degrees: DataFrame) -> DataFrame:
    """out / (in + out), null without edges; sorted either way nulls come last."""
    d = degrees.withColumn("out_share", F.round(F.try_divide(F.col("n_out"), F.col("n_in") + F.col("n_out")), 6))
    return ordering.numbered(ordering.numbered(d, [F.desc_nulls_last("out_share"), "id"], "rank_desc"), [F.asc_nulls_last("out_share"), "id"], "rank_asc")


def top_composition(df: DataFrame, value: str, kind: str, k: int = 100) -> DataFrame:
    """Kinds among the first k and among all."""
    first = df.orderBy(F.desc(value), "id").limit(k).groupBy(F.col(kind).alias("_kind")).agg(F.count("*").alias("n_top"))
    every = df.groupBy(kind).agg(F.count("*").alias("n_all"))
    return every.join(first, F.col(kind).eqNullSafe(F.col("_kind")), "left").select(kind, F.coalesce("n_top", F.lit(0)).alias("n_top"), "n_all")


def selection_effect(df: DataFrame, inside: DataFrame, measures: list[str]) -> DataFrame:
    flag = inside.select("id", F.lit(True).alias("inside"))
    return df.join(flag, "id", "left").na.fill(False, ["inside"]).groupBy("inside").agg(F.count("*").alias("n"), *[F.median(m).alias(f"median_{m}") for m in measures])


def normal_two_sided(k: int, n: int) -> float:
    """Binomial p at one half for large n, continuity corrected."""
    return math.erfc(max(0.0, abs(k - n / 2) - 0.5) / math.sqrt(n / 4) / math.sqrt(2)) if n else 1.0
