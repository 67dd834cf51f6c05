from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftfield.llm import jaccard


def shingles(text, size):
    w = re.findall(r"[^ \t\n\v\f\r]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    if not w:
        return frozenset()
    return frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1)))


def brute(rows, size=4, percent=85):
    """(doc_id, n, component, links) from all pairs of documents."""
    sets = [shingles(t, size) for _, t in rows]
    holders = defaultdict(set)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].add(k)
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    links = [0] * len(rows)
    for k, s in enumerate(sets):
        for other in {j for g in s for j in holders[g]}:
            both = len(s & sets[other])
            if other < k and 100 * both >= percent * (len(s) + len(sets[other]) - both):
                links[k] += 1
                links[other] += 1
                root[find(k)] = find(other)
    least = {}
    for k, (d, _) in enumerate(rows):
        r = find(k)
        least[r] = d if least.get(r) is None else least[r] if d is None else min(least[r], d)
    return sorted((str(d), len(s), str(least[find(k)]), links[k]) for k, ((d, _), s) in enumerate(zip(rows, sets)))


def result(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in df.collect())


def near_copies(seed, families=6, members=40):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    passage = [rng.choice(words) for _ in range(60)]  # shared by many texts that are not alike
    rows = []
    for _ in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(5, 150))]
        for _ in range(members):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.2:
                text += passage
            rows.append((rng.randrange(10**6), rng.choice([" ", "\n", "  "]).join(text)))
    return rows


@pytest.mark.parametrize("seed,block", [(1, 512), (2, 7)])
def test_matches_all_pairs(spark, ws, seed, block):
    rows = near_copies(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert result(jaccard.similar_components(df, ws, block_rows=block)) == brute(rows)


def test_odd_rows(spark, ws):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "ONE"), (6, "one two"), (6, "one two"), (None, "one two"),
        (None, None), (7, "a b c d"), (8, "a b c d e"), (9, "Ä b c d"), (10, "ä b c d"), (11, "x " * 40_000), (12, "x " * 39_000),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"digest": F.lit(1), "n": F.lit("x")})
    got = result(jaccard.similar_components(df, ws))
    want = [r for r in brute(rows)]
    assert got == want
    assert jaccard.similar_components(df.limit(0), ws).count() == 0


def test_given_documents(spark, ws):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    assert result(jaccard.similar_components(df, ws)) == brute(rows)


def test_prefix_rows_are_dealt_out_once(spark):
    levels = np.zeros(1 << jaccard.SKETCH_BITS, np.uint8)
    df = spark.createDataFrame(near_copies(3, families=1, members=20), "doc_id long, text string").repartition(4)
    edges = jaccard.neighbours(jaccard.prefixes(df, levels, 4, 85, "text"))
    assert edges._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(column") == 1
    assert edges.count()


@pytest.mark.parametrize("seed,percent", [(5, 80), (6, 60), (7, 100)])
def test_neighbours_connect_every_similar_pair(spark, ws, seed, percent):
    rows = near_copies(seed, families=4, members=25)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(jaccard.similar_components(df, ws, 3, percent)) == brute(rows, 3, percent)
    assert result(jaccard.similar_components(df.coalesce(1), ws, 3, percent)) == brute(rows, 3, percent)
