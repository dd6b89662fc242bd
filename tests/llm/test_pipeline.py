"""The pipeline, stage by stage, against plain versions."""

import os
import sys
from collections import Counter

import pytest

pytest.importorskip("corpus_pipeline")
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from test_contracts import SF, awkward, bench_of, ids_of, write  # noqa: E402

from echograph.llm import secret_scan  # noqa: E402


@pytest.fixture(scope="module", params=["odd", "plain", "empty"])
def tables(request, spark, tmp_path_factory):
    if request.param == "plain":
        return SF
    return write(spark, tmp_path_factory.mktemp("p"), awkward() if request.param == "odd" else [], bench=[(2, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"), (4, "one two")])


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def test_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows, columns = rows_of(docs), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, tables)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.schema(out.schema).parquet(str(tmp_path / name))
        if k < 4:
            assert out.columns == columns
        if k == 0:
            # No line is common enough for the corpus rule here, so the base rules decide.
            want = [r for r, (_, v) in zip(rows, brute.op8(rows)) if not v[5]]
        elif k == 1:
            heads, groups = {}, copies([t for _, t in rows])
            for (i, t), g in zip(rows, groups):
                key = (i is None, i or 0)
                if g not in heads or key < heads[g][0]:
                    heads[g] = (key, i)
            assert Counter(r[0] for r in rows_of(out)) == Counter(i for _, i in heads.values())
            want = rows_of(out)
            assert not Counter(want) - Counter(rows)
        elif k == 2:
            want = [r for r, (_, v) in zip(rows, brute.op9(rows, bench_of(spark, tables))) if not v[4]]
        elif k == 3:
            want = [(i, t if t is None else secret_scan.redact_text(t, secret_scan.block_spans([t])[0])) for i, t in rows]
            for (_, v), (_, t) in zip(brute.op2(rows), want):
                assert (v[0] + v[1] + v[2] > 0) <= ("[" in (t or ""))
        else:
            assert sum(r.length for r in out.collect()) == sum(len(x) for _, x in ids_of(rows, 1))
            break
        assert Counter(rows_of(out)) == Counter(want)
        docs, rows = out, rows_of(out)


def shingles(text):
    w = brute.W8.findall(brute.low(text or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def copies(texts):
    """A number for each text's group: texts linked by 0.8 of their shingles, without a search index."""
    distinct = sorted({t or "" for t in texts})
    held, group = [shingles(t) for t in distinct], list(range(len(distinct)))
    where = {}
    for k, own in enumerate(held):
        for x in own or {None}:
            where.setdefault(x, []).append(k)

    def find(k):
        while group[k] != k:
            k = group[k]
        return k

    for k, own in enumerate(held):
        for j in {j for x in own or {None} for j in where[x] if j < k}:
            both = len(own & held[j])
            if both >= 0.8 * len(own | held[j]):
                a, b = find(j), find(k)
                group[max(a, b)] = min(a, b)
    place = {t: k for k, t in enumerate(distinct)}
    return [find(place[t or ""]) for t in texts]


def test_run_equals_stages(spark, tables, tmp_path):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, tables)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.schema(docs.schema).parquet(str(tmp_path / name))
    piece = lambda r: (r.doc_id, r.doc_tokens)
    want, got = docs.collect(), corpus_pipeline.run(spark, tables).collect()
    lengths = lambda rows: {k: sum(r.length for r in rows if piece(r) == k) for k in set(map(piece, rows))}
    assert lengths(got) == lengths(want)
    for rows in (got, want):
        filled = Counter()
        for r in rows:
            filled[r.sequence_id] += r.length
        assert all(n <= 2048 for n in filled.values())


def test_near_copies_are_found(spark):
    """Edited copies of every similarity: those at 0.8 or more go, unlike documents stay."""
    import random

    from echograph.llm import simhash

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, base = [], [word() for _ in range(300)]
    for k in range(60):
        own = [word() for _ in range(rng.choice([60, 200, 800]))]
        rows.append((10 * k, " ".join(own)))
        for j in range(1, 4):
            edited = [word() if rng.random() < 0.008 * j else w for w in own]
            rows.append((10 * k + j, " ".join(edited)))
    rows += [(1000 + k, " ".join(word() if i == k % 300 or i == 7 * k % 300 else w for i, w in enumerate(base))) for k in range(400)]
    rows += [(2000, None), (2001, ""), (2002, "  "), (2003, "short"), (2004, "Short"), (None, "short"), (5, "other words of an old id"), (2003, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    groups = copies([t for _, t in rows])
    best = {}
    for (i, _), g in zip(rows, groups):
        key = (i is None, i or 0)
        best[g] = min(best.get(g, key), key)
    got = Counter(r.doc_id for r in simhash.keep_one(docs).collect())
    want = Counter(i for _, i in best.values())
    extra, missing = got - want, want - got
    assert sum(extra.values()) <= 0.02 * len(rows) and not missing, (extra, missing)
    small = Counter(r.doc_id for r in simhash.near_copies(docs, bucket=32).groupBy("root").agg({"doc_id": "min"}).withColumnRenamed("min(doc_id)", "doc_id").collect())
    assert sum((small - want).values()) <= 0.02 * len(rows)
