"""What each method adds to its base, against plain versions and on tables made for it."""

import os
import random
import sys
from collections import Counter, defaultdict

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
from test_contracts import awkward  # noqa: E402

from echograph.llm import licenses, quality  # noqa: E402

FULL = {t: text for t, (_, text, _) in enumerate(licenses.TEMPLATES)}
LABEL = {t: label for t, (label, _, _) in enumerate(licenses.TEMPLATES)}
MIT, BSD, MPL = (next(t for t in FULL if LABEL[t] == label) for label in ("mit", "bsd", "mpl"))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def plain_licences(rows):
    """Labels and score of each row, by their definition."""
    words = [brute.WA.findall(brute.low(t or "")) for _, t in rows]
    df = Counter(w for ws in words for w in set(ws))
    base = [v[4] for _, v in brute.op4(rows)]
    out = []
    for (i, _), ws, own in zip(rows, words, base):
        norm, labels, best = " " + " ".join(ws) + " ", set(filter(None, own.split(","))), 0.0
        for label, text, keys in licenses.TEMPLATES:
            if not any(f" {k} " in norm for k in keys):
                continue
            body = licenses.template_words(text)
            rare = sorted(set(body), key=lambda w: (not df[w], df[w], w))[: licenses.RARE_WORDS]
            places = [(w, p) for p, w in enumerate(body) if w in rare]
            bins = defaultdict(set)
            for at, w in enumerate(ws):
                for v, p in places:
                    if v == w:
                        for k in (0, 1):
                            bins[k, (at - p + k * licenses.SLACK) // (2 * licenses.SLACK)].add(p)
            share = max((len(b) for b in bins.values()), default=0) / len(places)
            best = max(best, share)
            if share >= licenses.AGREEMENT:
                labels.add(label)
        out.append((i, ",".join(sorted(labels)), best))
    return out


def licence_rows():
    rng = random.Random(8)
    rows = [(i, prose(rng, 80)) for i in range(70)]
    rows += [(100 + i, prose(rng, 20) + "\n" + FULL[MIT] + prose(rng, 20)) for i in range(30)]
    rows += [
        (200, "\n".join([FULL[BSD], FULL[MPL], FULL[MIT]])),
        (201, "permission is hereby granted"),
        (202, "Mozilla Public License"),
        (203, FULL[BSD].replace("following", "following following")),
        (204, FULL[MIT].split("granted")[1]),
        (205, None),
        (206, ""),
        (207, prose(rng, 5000) + FULL[MPL] + prose(rng, 5000)),
        (208, "Some words (MIT License) and CC BY"),
    ]
    return rows + [(200, "another text under an old id"), (None, FULL[MPL]), rows[-1], rows[-1]]


def test_licences_by_the_method(spark):
    rows = licence_rows()
    got = [(r.doc_id, r.labels, r.score) for r in licenses.scan(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(plain_licences(rows))
    label = {i: x for i, x, _ in got}
    assert all(label[100 + i] == "mit" for i in range(30)) and label[201] == label[202] == label[204] == ""
    assert ("bsd,mit,mpl") in [x for i, x, _ in got if i == 200] and label[207] == "mpl"
    few = rows[70:75] + rows[:10]
    assert [r.labels for r in licenses.scan(frame(spark, few)).filter("doc_id >= 100").collect()] == ["mit"] * 5


def plain_quality(rows, min_docs, min_left):
    """kept and left_share of each (doc_id, text, source), by their definition."""
    clean = lambda x: brute.low(" ".join(brute.W8.findall(x)))
    lines = [[c for x in (t or "").split("\n") if (c := clean(x))] for _, t, _ in rows]
    docs = defaultdict(set)
    for (i, t, s), own in zip(rows, lines):
        for x in own:
            docs[s, x].add((i, t))
    out = []
    for (i, t, s), own, (_, v) in zip(rows, lines, brute.op8([r[:2] for r in rows])):
        total, left = (sum(x.count(" ") + 1 for x in own if k or len(docs[s, x]) <= min_docs) for k in (1, 0))
        share = left / total if total else 1.0
        out.append((i, share, not v[5] and share >= min_left))
    return out


def test_quality_by_documents(spark):
    rng = random.Random(4)
    menu, text = "Home | About | Contact us", "\n".join(prose(rng, 12) for _ in range(8))
    rows = [(i, menu + "\n" + "\n".join(prose(rng, 15) for _ in range(5)), "a") for i in range(30)]
    rows += [(100 + i, "\n".join([" ".join(f"menu{k}" for k in range(60))]), "b") for i in range(200)]
    rows += [(400 + i, text, "c") for i in range(8)] + [(500 + i, text, "d") for i in range(40)]
    rows += [(600, menu, None), (None, text, None), (600, menu, None), (601, None, "a"), (602, "", "a"), (500, text, "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = [(r.doc_id, r.left_share, r.kept) for r in quality.judge(docs).collect()]
    assert Counter(got) == Counter(plain_quality(rows, quality.MIN_DOCS, quality.MIN_LEFT))
    kept = {i for i, _, k in got if k}
    assert set(range(30)) <= kept and not kept & set(range(100, 300)) and set(range(400, 408)) <= kept and not kept & set(range(500, 540))
    out = quality.clean(docs.withColumn("line", docs.source))
    assert out.columns == ["doc_id", "text", "source", "line"]
    assert all("Home" not in r.text and r.text.count("\n") == 4 for r in out.filter("source = 'a'").collect())
    assert {r.doc_id for r in out.collect()} == kept


@pytest.mark.parametrize("sf", ["0.01", "0.1"])
def test_quality_is_active(spark, sf):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()]
    got = [(r.doc_id, r.left_share, r.kept) for r in quality.judge(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet")).collect()]
    if sf == "0.01":
        assert Counter(got) == Counter(plain_quality(rows, quality.MIN_DOCS, quality.MIN_LEFT))
    else:
        assert sum(s < 1 for _, s, _ in got) > 1000 and sum(s < quality.MIN_LEFT for _, s, _ in got) > 0


def test_awkward_rows_are_judged_plainly(spark):
    rows = [(i, t, f"s{(i or 0) % 2}") for i, t in awkward()]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert Counter((r.doc_id, r.left_share, r.kept) for r in got) == Counter(plain_quality(rows, quality.MIN_DOCS, quality.MIN_LEFT))


def test_sharding_edits_a_stored_map(spark, tmp_path):
    from echograph.llm import sharding

    path, rng = str(tmp_path / "map"), random.Random(2)
    rows = [(i, prose(rng, rng.randint(0, 60))) for i in range(500)]
    first = sharding.shard(frame(spark, rows), 8, map_path=path).collect()
    grown = [*rows, *((7, prose(rng, 30)) for _ in range(4000)), *([(8, "same row " * 20)] * 4000), *[(None, None)] * 50]
    second = sharding.shard(frame(spark, grown), 8, map_path=path).collect()
    third = sharding.shard(frame(spark, grown), 9, map_path=path).collect()
    fewer = sharding.shard(frame(spark, grown), 3, map_path=path).collect()
    assert [len(x) for x in (first, second, third, fewer)] == [500, 8550, 8550, 8550]
    assert [x[0].map_version for x in (first, second, third, fewer)] == [1, 2, 3, 4] and sharding.map_version(spark, path) == 4
    maps = spark.read.parquet(path)
    assert maps.groupBy("version", "virtual_slot").count().filter("count > 1").count() == 0 and maps.count() == 5 * sharding.SLOTS
    for got, n in ((second, 8), (third, 9), (fewer, 3)):
        loads = Counter()
        for r in got:
            loads[r.shard] += r["size"]
        assert set(loads) == set(range(n)) and max(loads.values()) <= 1.05 * sum(loads.values()) / n
        for k in range(n):
            assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    key = lambda r: (r.doc_id, r.text_crc32, r["size"], r.virtual_slot)
    assert Counter(map(key, second)) == Counter(map(key, third))
    moved = sum(a.shard != b.shard for a, b in zip(sorted(second, key=key_order), sorted(third, key=key_order)))
    assert moved < 0.3 * len(second)
    with pytest.raises(Exception):
        sharding.save_map(sharding.load_map(spark, path), path, 4)


def key_order(r):
    return (r.doc_id is None, r.doc_id or 0, r.text_crc32, r.virtual_slot, r.slot)


def test_chain_scores_by_definition(spark):
    """Scoring against a loop over words, on whole texts of the plain and the awkward rows."""
    import math

    from echograph.llm import toxicity
    from echograph.llm.bytewords import Words

    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    chain = toxicity.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.limit(300).collect()] + awkward()
    number = {int(h): k for k, h in enumerate(chain.hashes)}
    want = []
    for i, t in rows:
        held = {number[h] for h in Words([(t or "").lower()], "alnum").hashes(3).tolist() if h in number}
        odds = []
        for bias, weights, earlier in zip(chain.bias, chain.weights, chain.earlier):
            z = bias + sum(weights[k] for k in held) + sum(w * max(-4.0, min(4.0, o)) for w, o in zip(earlier, odds))
            odds.append(z)
        want.append((i, *(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) for z in odds)))
    got = [(r.doc_id, r.p_low_quality, r.p_toxic, r.p_severe) for r in toxicity.score(frame(spark, rows), chain).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order)):
        assert a[0] == b[0] and all(abs(x - y) < 2e-6 for x, y in zip(a[1:], b[1:]))


def test_training_rows_are_bounded(spark):
    from echograph.llm import toxicity

    rng = random.Random(3)
    docs = frame(spark, [(i % 20, prose(rng, 20)) for i in range(2000)] + [(3, "same text again")] * 50)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(20)] + [(3, 1, 0), (3, None, 1), (None, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.training_rows(docs, labels, 100).collect()
    assert len(rows) == 100 and len({(r.doc_id, r["hash"]) for r in rows}) == 100
    assert all(len({r.fold for r in rows if r.doc_id == i}) <= 1 for i in range(20))
    whole = toxicity.training_rows(docs, labels).collect()
    assert len(whole) == 2001 and all(0 <= r.fold < toxicity.FOLDS for r in whole)
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == docs.count()


def test_substrings_of_earlier_batches_go(spark, tmp_path):
    """Batches over one index against all documents so far: what a batch loses is what occurs elsewhere
    by then; failed calls and repeated rows leave the index right."""
    from echograph.llm import substring_dedup

    rng = random.Random(7)
    passages = [prose(rng, 60) for _ in range(4)]
    batch = lambda k, own: [(100 * k + i, " ".join([prose(rng, 50), *own, prose(rng, 50)])) for i in range(6)]
    first = batch(0, passages[:1]) + [(1, prose(rng, 90)), (1, "short"), (None, passages[1])]
    second = [*batch(1, []), (200, prose(rng, 40) + " " + passages[0] + "\n" + passages[1]), (201, passages[2]), (202, "x " + passages[2]), (None, None)]
    third = [(300, passages[2] + " end"), (301, passages[3]), first[2], first[2], (302, "")]
    path, before = str(tmp_path / "index"), []
    for k, rows in enumerate((first, second, third)):
        got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows), index_path=path).collect())
        every = list(brute.op5(before + rows))[len(before) :]
        assert got == Counter((i, *v) for i, v in every)
        before += rows
        if k:
            assert sum(n for _, _, n, _ in got) >= 60
    assert substring_dedup.FingerprintIndex(spark, path).version == 2
