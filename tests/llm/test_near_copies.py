"""Near copies in large buckets against all pairs that meet."""

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from echograph.llm import simhash


def texts():
    """Variants of two texts, many of them just above or below the similarity, and empty ones."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    out = ["", " ", "  "]
    for size, n, least, most in ((300, 150, 4, 10), (120, 120, 2, 4)):
        base = [word() for _ in range(size)]
        for _ in range(n):
            edited = set(rng.sample(range(size), rng.randint(least, most)))
            out.append(" ".join(word() if i in edited else w for i, w in enumerate(base)))
    return out


@pytest.mark.parametrize("bucket, part", [(simhash.BUCKET, simhash.PART), (4, 7)])
def test_large_buckets_lose_no_link(spark, bucket, part):
    rows = list(enumerate(texts()))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    prints = docs.select("doc_id", "text", simhash.text_hash().alias("text_hash")).mapInArrow(simhash._copy_rows(simhash.COPY_SHINGLE), "doc_id long, text_hash long, fp long, bands array<long>")
    prints = {r.doc_id: r for r in prints.collect()}
    sets = {i: set(simhash.shingle_hashes(t, simhash.COPY_SHINGLE).tolist()) for i, t in rows}
    root = {i: i for i, _ in rows}
    buckets = defaultdict(set)
    for i, r in prints.items():
        for band in enumerate(r.bands):
            buckets[band].add(i)
    assert max(map(len, buckets.values())) > simhash.SMALL
    for a, b in combinations(root, 2):
        meet = any(x == y for x, y in zip(prints[a].bands, prints[b].bands))
        near = int(np.int64(prints[a].fp ^ prints[b].fp).view(np.uint64)).bit_count() <= simhash.WIDE
        both = len(sets[a] & sets[b])
        if meet and near and both >= simhash.SIMILARITY * len(sets[a] | sets[b]) and root[a] != root[b]:
            gone = root[b]
            root = {i: root[a] if r == gone else r for i, r in root.items()}
    want, got = defaultdict(set), defaultdict(set)
    for i, r in root.items():
        want[r].add(i)
    for r in simhash.near_copies(docs, bucket=bucket, part=part).collect():
        got[r.root].add(r.doc_id)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
