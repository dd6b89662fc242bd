"""Traps of the semantics on hand-made rows."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from echograph.functions import stats
from echograph.functions import text as T
from echograph.operators import collect, extract, graph, layers, match, topics
from echograph.operators.graph import Graph
from echograph.sources import files

T0 = datetime(2023, 1, 1)


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'int' if isinstance(values[n], int) else 'string'}" for n in names)).select(column).first()[0]


def test_text_functions(spark):
    t = F.col("t")
    assert one(spark, T.normalise(t), t="  A  b\r\n\tC ") == "a b c"
    assert one(spark, T.mentions(t), t="@aaaaa@bbbbb x@mail1 @1abcd @abc") == ["aaaaa", "bbbbb", "mail1"]
    assert one(spark, T.mentions(t), t="hi @Channel_1, mail a@gmail") == ["channel_1", "gmail"]
    assert one(spark, T.links(t), t="https://t.me/" + "a" * 40) == ["a" * 32]
    assert one(spark, T.utf16_slice(t, F.col("o"), F.col("n")), t="\U0001f600 @abcde x", o=3, n=6) == "@abcde"
    assert one(spark, T.content_key(t), t="x" * 99) is None
    assert one(spark, T.content_key(t), t="x" * 400) == one(spark, T.content_key(t), t="x" * 401)
    assert one(spark, T.tokens(t), t="Ab abc ½½½ d1ef straße") == ["abc", "½½½", "straße"]
    assert one(spark, T.has_text(t), t="   ") is False
    assert one(spark, T.language_bucket(t), t="fr") == "other" and one(spark, T.language_bucket(t), t="ru") == "ru"
    assert one(spark, T.permalink(t, F.col("n")), t="abc", n=7) == "https://t.me/abc/7"
    assert one(spark, T.snippet(t, F.lit(41), F.lit(3)), t="a" * 40 + "XYZ" + "b" * 40) == "…" + "a" * 30 + "XYZ" + "b" * 30 + "…"


def test_statistics(spark):
    d = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "x int")
    assert d.agg(stats.upper_median(F.col("x"))).first()[0] == 3
    assert stats.upper_median_by_rank(d.withColumn("g", F.lit(1)), ["g"], "x").first()[1] == 3
    assert stats.binom_test(5, 10) == pytest.approx(1.0)
    assert stats.binom_test(0, 10) == pytest.approx(2 / 1024)
    assert stats.mcnemar(10, 2)["chi2"] == pytest.approx(49 / 12)
    assert stats.upper_gamma(0.5, 3.841458820694124 / 2) == pytest.approx(0.05, abs=1e-9)
    h = {r.test: r.p_holm for r in stats.holm(spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "test string, p double")).collect()}
    assert h == pytest.approx({"a": 0.03, "b": 0.06, "c": 0.06})
    m = stats.mann_whitney(spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 3.0), ("b", 4.0)], "g string, v double"), "g", "v", "a", "b")
    assert m["u"] == 0
    x = stats.chi2_gof(spark.createDataFrame([(10.0, 15.0), (20.0, 15.0)], "o double, e double"), "o", "e")
    assert x["chi2"] == pytest.approx(10 / 3) and x["df"] == 1


def posts(spark, rows):
    return spark.createDataFrame(rows, "key string, channel string, msg_id long, ts timestamp, is_fwd boolean")


def test_star_ties_and_forwards(spark):
    p = posts(spark, [("k", "b", 1, T0, False), ("k", "a", 2, T0, False), ("k", "c", 3, T0 + timedelta(1), True), ("k", "a", 9, T0 + timedelta(2), False), ("z", "a", 4, None, False)])
    rows = match.star_pairs(p).collect()
    assert {(r.a, r.b) for r in rows} == {("a", "b"), ("a", "c")}
    assert {(r.a, r.b) for r in match.star_pairs(p, exclude_forwarded=True).collect()} == {("a", "b")}
    o = match.orient(match.star_pairs(p)).collect()
    assert {(r.u, r.v, r.vote) for r in o} == {("a", "b", "tie"), ("a", "c", "u")}


def test_thresholds_and_declared(spark):
    rows = [("a", 1, T0, "b", 1, T0, 0.96), ("a", 2, T0, "c", 1, T0, 0.96), ("a", 3, T0, "x", 1, T0, 0.97), ("a", 4, T0, "a", 5, T0, 1.0), ("a", 6, T0, "c", 2, T0, 0.99)]
    pairs = spark.createDataFrame(rows, "a string, a_msg_id long, a_ts timestamp, b string, b_msg_id long, b_ts timestamp, sim double")
    members = spark.createDataFrame([(h,) for h in "abcx"], "handle string")
    cls = spark.createDataFrame([("a", "ru"), ("b", "ru"), ("c", "cs")], "handle string, cls string")
    named = spark.createDataFrame([("c", 2, "a")], "channel string, msg_id long, target string")
    out = match.validate(pairs, members, cls, named).collect()
    assert [(r.u, r.v, r.u_msg_id, r.is_cross) for r in out] == [("a", "c", 2, True)]


def test_unanimity_is_judged_after_the_floor(spark):
    rows = [("a", "b", "u", 10.0), ("a", "b", "v", 4000.0), ("a", "b", "v", 5000.0)]
    d = spark.createDataFrame(rows, "u string, v string, vote string, latency_s double")
    got = {(r.k, r.floor_s): (r.n_edges, r.n_unanimous) for r in match.direction_pivot(d, [0, 300], [1, 2, 3]).collect()}
    assert got == {(1, 0): (1, 0), (2, 0): (1, 0), (3, 0): (1, 0), (1, 300): (1, 1), (2, 300): (1, 1)}


def test_cosine_blocks_equal_brute_force(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(60, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vec array<double>")
    s = v @ v.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if s[i, j] >= 0.5}
    assert {(r.i, r.j) for r in match.cosine_pairs(df, 0.5, block=16).collect()} == want


def test_mentions_fold_aliases_after_counting(spark):
    p = spark.createDataFrame([("src", 1, "@Alias_one and @alias_two", None), ("src", 2, "@src_chan @alias_one", None)], "channel string, msg_id long, text string, entities array<struct<type:string,offset:int,length:int,url:string>>")
    aliases = spark.createDataFrame([("alias_one", "main"), ("alias_two", "main"), ("src_chan", "src")], "alias string, canonical string")
    e = extract.mention_edges(extract.raw_mentions(p), aliases).collect()
    assert [(r.source, r.target, r.n_msgs, r.methods) for r in e] == [("src", "main", 3, ["mention"])]


def test_registry_and_queue(spark):
    q = spark.createDataFrame([("a", True, "skipped"), ("b", False, "done"), ("c", False, "pending"), ("e", False, "pending")], "handle string, is_seed boolean, status string")
    new = spark.createDataFrame([("b", True), ("d", False)], "handle string, is_seed boolean")
    assert {(r.handle, r.is_seed, r.status) for r in collect.merge_queue(q, new).collect()} == {("a", True, "pending"), ("b", True, "done"), ("c", False, "pending"), ("d", False, "pending"), ("e", False, "pending")}
    known = spark.createDataFrame([("c",)], "handle string")
    errors = spark.createDataFrame([("e", 2)], "handle string, attempt_count int")
    out, bumped = collect.prefilter(q, known, errors)
    assert {r.handle: r.status for r in out.collect()} == {"a": "skipped", "b": "done", "c": "skipped", "e": "skipped"}
    assert bumped.first().attempt_count == 3
    reg = "channel_id long, handles array<string>, title string, discoveries array<struct<tag:string,step:int>>, last_scraped_step int, last_scraped_tag string, last_scraped_at timestamp"
    day = lambda d: datetime(2023, 1, d)
    up = collect.upsert_registry(spark.createDataFrame([(1, ["x"], "old", [("t", 1)], 1, "t", day(1))], reg), spark.createDataFrame([(1, ["y", "x"], None, [("t", 2)], 3, "v", day(3)), (1, ["x"], "new", [("t", 2)], 2, "u", day(2)), (2, ["z"], None, [], 2, "u", day(2))], reg))
    assert {r.channel_id: (r.handles, r.title, len(r.discoveries), r.last_scraped_tag) for r in up.collect()} == {1: (["x", "y"], "new", 2, "v"), 2: (["z"], None, 0, "u")}
    err = collect.upsert_errors(
        spark.createDataFrame([("h", 1, "t1", ["t1"], 1, day(1), "E")], "handle string, first_seen_step int, first_seen_tag string, seen_in_tags array<string>, attempt_count int, last_attempt_at timestamp, last_error string"),
        spark.createDataFrame([("h", "t2", 5, day(5), None), ("k", "t2", 5, day(5), "A"), ("k", "t0", 4, day(4), "Z")], "handle string, tag string, step int, at timestamp, error string"),
    )
    assert {r.handle: (r.first_seen_tag, r.seen_in_tags, r.attempt_count, r.last_attempt_at, r.last_error) for r in err.collect()} == {"h": ("t1", ["t1", "t2"], 2, day(5), "E"), "k": ("t0", ["t0", "t2"], 2, day(5), "A")}


def test_message_files(spark, tmp_path):
    folder = tmp_path / "step_01_seed_20230101_20230201"
    folder.mkdir()
    (folder / "Chan_inspect.json").write_text(json.dumps([{"id": 2, "date": "2023-01-02T00:00:00+00:00", "message": "hello", "reactions_json": {"x": 3}, "fwd_from": {"source_channel_id": 5}}, {"id": 1, "message": None}]))
    (folder / "bad_inspect.json").write_text("{not json")
    msgs, bad = files.read_messages(spark, str(folder))
    p = collect.project_messages(msgs)
    assert {(r.channel, r.msg_id, r.text, r.is_fwd, r.reactions) for r in p.collect()} == {("chan", 2, "hello", True, 3), ("chan", 1, "", False, 0)}
    assert bad.select("path").distinct().count() == 1
    e = extract.forward_edges(p, spark.createDataFrame([(9, "nine")], "channel_id long, handle string")).first()
    assert (e.origin, e.target, e["count"], e.origin_resolved) == ("id:5", "chan", 1, False)
    listed = files.first_files(files.list_files(spark, str(folder)))
    assert {r.channel for r in listed.collect()} == {"chan", "bad"}
    start, end = files.folder_window(F.lit(str(folder)))
    row = spark.range(1).select(start.alias("s"), end.alias("e")).first()
    assert (row.s, row.e) == (datetime(2023, 1, 1), datetime(2023, 2, 1))
    (tmp_path / "x.csv").write_text("﻿a;b\n1;2\n", encoding="utf-8")
    assert files.read_delimited(spark, str(tmp_path / "x.csv"), ";").columns == ["a", "b"]


def test_resumable_output(spark, tmp_path):
    ran = []
    work = spark.createDataFrame([(1, "a"), (2, "b")], "g int, x string")

    def run(df):
        ran.append(df.count())
        return df

    files.resume_groups(work.filter("g = 1"), "g", str(tmp_path / "o"), run)
    assert files.resume_groups(work, "g", str(tmp_path / "o"), run).count() == 2 and ran == [1, 1]


def test_graph_in_memory_and_distributed_agree(spark, monkeypatch):
    edges = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 1), (7, 8)]
    g = Graph.from_edges(spark.createDataFrame(edges, "src long, dst long"))
    small = sorted(map(tuple, g.scc().collect())), g.path_summary().first(), sorted(map(tuple, g.reachability().collect()))
    monkeypatch.setattr(graph, "SMALL_EDGES", 0)
    large = sorted(map(tuple, g.scc().collect())), g.path_summary().first(), sorted(map(tuple, g.reachability().collect()))
    assert small[0] == large[0] == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6), (7, 7), (8, 8)]
    assert tuple(small[1]) == tuple(large[1]) and small[2] == large[2]
    assert g.condensation_pairs()["total"] == small[1].n_pairs
    assert g.giant().vertices.count() == 6


def test_partition_agreement(spark):
    a = spark.createDataFrame([(i, i // 3) for i in range(9)], "id int, community int")
    assert graph.partition_agreement(a, a) == pytest.approx({"ari": 1.0, "ami": 1.0})
    b = spark.createDataFrame([(i, i % 3) for i in range(9)], "id int, community int")
    assert graph.partition_agreement(a, b)["ari"] < 0.1


def test_ctfidf_ignores_small_communities(spark):
    terms = spark.createDataFrame([(1, "alpha", 3), (1, "123", 9), (2, "alpha", 1), (3, "beta", 5)], "id int, term string, n long")
    member = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id int, community int")
    out = topics.ctfidf(terms, member, min_size=2).collect()
    assert [(r.community, r.term) for r in out] == [(0, "alpha")]


def test_sources_need_votes(spark):
    e = spark.createDataFrame([("a", "b", 0, 0), ("a", "c", 5, 0), ("a", "d", 0, 5), ("a", "e", 4, 1)], "u string, v string, n_u_first long, n_v_first long")
    assert {tuple(r) for r in layers.directed_layer(e, 5).collect()} == {("a", "c"), ("d", "a")}


def test_streamed_sightings_equal_batch(spark, tmp_path):
    from echograph.plans import views
    from echograph.streaming import posts as stream

    p = views.posts(spark, "/root/testdata/sf0.001").withColumn("ts", F.col("ts").cast("timestamp"))
    p.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(p.schema).parquet(str(tmp_path / "in"))
    q = stream.first_sightings(src, "400 days").writeStream.foreachBatch(stream.tally_sink(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).select("key", "channel")
    assert got.count() == p.select("key", "channel").distinct().count()
