from __future__ import annotations

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from driftfield.llm import simhash
from driftfield.workspace import Workspace

SF = "/root/testdata/sf0.01"


def plain_fingerprint(text, size=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lowered) if w]
    if not words:
        return 0
    shingles = [" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, limit):
    """Smallest number of each value's component, all pairs compared."""
    values = np.array(values, np.uint64)
    label = np.arange(len(values))
    while True:
        new = np.array([label[np.bitwise_count(values ^ v) <= limit].min() for v in values])
        if np.array_equal(new, label):
            return label
        label = new


def test_fingerprints_are_those_of_the_definition(spark, trouble):
    rows = trouble.collect()
    got = simhash.fingerprints(trouble.withColumn("fp", F.lit(1))).collect()
    want = sorted((str(r.doc_id), plain_fingerprint(r.text)) for r in rows)
    assert sorted((str(g.doc_id), g.fp % (1 << 64)) for g in got) == want
    one = spark.createDataFrame([(1, "a b c d")], "doc_id long, text string")
    assert simhash.fingerprints(one).first().fp == one.select(F.xxhash64("text")).first()[0]


def test_majority_of_many_hashes():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 1 << 64, 5000, dtype=np.uint64)
    count = np.array([0, 1, 2, 255, 256, 0, 1000, 3486])
    at = np.append(0, np.cumsum(count))
    for k, got in enumerate(simhash.majority(hashes, count)):
        own = hashes[at[k] : at[k + 1]]
        assert int(got) == sum(1 << b for b in range(64) if 2 * int(((own >> np.uint64(b)) & np.uint64(1)).sum()) > len(own))


def sets_of_values(seed):
    """Random values, chains a few bits apart, a dense ball, and values at both ends of the range."""
    rng = np.random.default_rng(seed)
    values = list(rng.integers(0, 1 << 64, 400, dtype=np.uint64))
    for _ in range(60):
        v = values[rng.integers(0, len(values))]
        for b in rng.choice(64, rng.integers(1, 7), replace=False):
            v = v ^ np.uint64(1 << int(b))
        values.append(v)
    centre = rng.integers(0, 1 << 64, dtype=np.uint64)
    for _ in range(300):
        values.append(centre ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(1, 6), replace=False).astype(np.uint64)))
    values += [np.uint64(0), np.uint64(1), np.uint64((1 << 64) - 1), np.uint64(1 << 63)]
    return np.unique(np.array(values, np.uint64))


@pytest.mark.parametrize("limit", [1, 2, 3, 4, 6])
def test_kernel_finds_every_link(limit):
    values = sets_of_values(limit)
    owner = np.arange(len(values), dtype=np.int64)
    wanted = {(i, j) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= limit) if i < j}
    got = set()
    for turn, half in enumerate(simhash.budgets(limit)):
        walked = values if not turn else (values << np.uint64(32)) | (values >> np.uint64(32))
        order = np.argsort(walked)
        walked, whose = walked[order], owner[order]
        runs = simhash.cut(walked, 40)
        assert [a for a, _, _ in runs] == [0, *[z for _, z, _ in runs][:-1]] and runs[-1][1] == len(values)
        for x, (a, z, _) in enumerate(runs):
            for b, y, _ in runs[x:]:
                found = simhash.linked(walked[a:z], whose[a:z], walked[b:y], whose[b:y], a == b, half, limit)
                got |= {(int(i), int(j)) for i, j in found}
    assert got == wanted


@pytest.mark.parametrize(("run", "limit"), [(16, 4), (200, 4), (16, 3)])
def test_trie_join_against_all_pairs(spark, ws, run, limit):
    values = sets_of_values(7)
    fps = [(int(v), int(v)) for v in values.view(np.int64)]
    found = simhash.trie_links(spark.createDataFrame(fps, "fp long, component long"), ws, limit, run).collect()
    links = {tuple(sorted((r.src % (1 << 64), r.dst % (1 << 64)))) for r in found}
    wanted = {
        tuple(sorted((int(values[i]), int(values[j]))))
        for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= limit) if i < j
    }
    assert links == wanted


def test_components_of_documents(spark, ws, trouble):
    base = [f"{k} alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho {k % 3}" * 4 for k in range(60)]
    rows = [(100 + k, t) for k, t in enumerate(base)] + [(300 + k, t + " end") for k, t in enumerate(base)] + [(None, base[0]), (None, "alone here")]
    docs = trouble.unionByName(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("component", F.lit("x"))
    got = simhash.near_components(docs, ws, run=8).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    distinct = sorted({fp for _, fp in rows})
    label = dict(zip(distinct, brute_components(distinct, 4)))
    least = {}
    for i, fp in rows:
        if i is not None:
            least[label[fp]] = min(i, least.get(label[fp], i))
    wanted = sorted((str(i), f"{fp:016x}", str(least.get(label[fp]))) for i, fp in rows)
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == wanted
    assert simhash.near_components(docs.limit(0), ws).count() == 0


def test_whole_table_against_all_pairs(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = simhash.near_components(docs, Workspace(spark, str(tmp_path))).collect()
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.select("doc_id", "text").collect()]
    distinct = sorted({fp for _, fp in rows})
    label = dict(zip(distinct, brute_components(distinct, 4)))
    least = {}
    for i, fp in sorted(rows):
        least.setdefault(label[fp], i)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{fp:016x}", least[label[fp]]) for i, fp in rows}
    assert len(got) == len(rows) > len(set(least.values()))
