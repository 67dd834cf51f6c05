from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from driftfield.llm import manifest as mf
from driftfield.llm.queries import remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def leaf(row, more=0):
    i, text, lang, source, n = row
    return h(*map(field, (i, source, lang, None if n is None else n + more, text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, at):
    """(sibling or None, whether it is on the left) per level."""
    out = []
    for nodes in tree[:-1]:
        other = at ^ 1
        out.append((nodes[other] if other < len(nodes) else None, other < at))
        at >>= 1
    return out


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees, order = {}, {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        order[lang], trees[lang] = own, levels([leaf(r) for r in own])
    top = levels([trees[x][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        for at, r in enumerate(order[lang]):
            path = siblings(trees[lang], at) + siblings(top, k)
            end = leaf(r, int(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0))
            for other, left in path:
                end = h(end) if other is None else h(other, end) if left else h(end, other)
            proof = h(*[s for s, _ in path if s is not None])
            out.append((r[0], leaf(r), trees[lang][-1][0], top[-1][0], proof, end, end == top[-1][0]))
    return sorted(out, key=str)


def test_documents_equal_brute_force(spark, ws):
    rows = [(k, f"text {k}" * (k % 5), "en" if k % 3 else "de", "s", k) for k in range(90)]
    rows += [(200, "Ünï", "ü", None, 3), (201, None, None, "a", None), (202, "", None, "b", 0), (None, "x", "en", "s", 1), (None, None, None, None, None)]
    rows += [(14, "other text", "en", "s", 2), (5, "text 5" * 0, "en", "s", 5), (5, "text 5" * 0, "en", "s", 5), (-3, "neg", "fr", "s", -1), (301, "y" * 100_000, "de", "z", 9)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({"tree": F.lit("x"), "at": F.lit(1), "block": F.lit(2), "digest": F.lit("d")})
    got = [tuple(r) for r in mf.audit_documents(docs, remainder("doc_id", 7) == 0, ws, bits=3).collect()]
    assert sorted(got, key=str) == brute(rows)
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_few_documents_and_none(spark, ws):
    rows = [(7, "a", "en", "s", 1)]
    got = mf.audit_documents(spark.createDataFrame(rows, SCHEMA), remainder("doc_id", 7) == 0, ws).collect()
    assert [tuple(r) for r in got] == brute(rows)
    assert mf.audit_documents(spark.createDataFrame([], SCHEMA), F.lit(False), ws).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 16, 21, 64, 100])
def test_positions_are_those_of_completion(n):
    top = mf.height(n)
    log = mf.completed([bytes([k]) * 32 for k in range(n)], top)
    nodes = levels([(bytes([k]) * 32).hex() for k in range(n)])
    places = {mf.position(level, k, n): nodes[level][k] for level in range(top + 1) for k in range(len(nodes[level]))}
    assert sorted(places) == list(range(len(log))) and [places[k] for k in sorted(places)] == [x.hex() for x in log]
    for level in range(1, top + 1):  # children are complete before their parent
        for k in range(len(nodes[level])):
            assert mf.position(level - 1, 2 * k, n) < mf.position(level, k, n)


def test_log_of_several_stages(spark, ws):
    """Trees of very different sizes, in blocks of four leaves; claims on other leaves lead elsewhere."""
    sizes = {"a": 1, "b": 4, "c": 5, "d": 77}
    rows = [(t, k, n, hashlib.sha256(f"{t}{k}".encode()).digest()) for t, n in sizes.items() for k in range(n)]
    leaves = spark.createDataFrame(rows, "tree string, at long, n long, digest binary")
    log = mf.build(leaves, ws, bits=2)
    roots = {r.tree: bytes(r.root).hex() for r in log.roots.collect()}
    trees = {t: levels([r[3].hex() for r in rows if r[0] == t]) for t in sizes}
    assert roots == {t: trees[t][-1][0] for t in sizes}
    claims = leaves.select("tree", "at", F.col("digest").alias("claimed"), F.col("at").alias("extra"))
    more = spark.createDataFrame([("d", 500, b"x" * 32, 1), ("zz", 0, b"x" * 32, 2), ("d", 9, b"y" * 32, 3), ("d", 9, None, 4)], claims.schema)
    got = mf.audited(log, claims.unionByName(more), ws).collect()
    assert len(got) == len(rows) + 4
    for r in got:
        if r.tree == "zz" or r.at == 500:
            assert r.path is None and r.folded is None
            continue
        path = [(s.hex() if s else None, side == 0) for side, s in mf.unpacked(bytes(r.path))]
        assert path == [(s, left if s else False) for s, left in siblings(trees[r.tree], r.at)]
        if r.claimed is not None:
            true = bytes(r.claimed).hex() == trees[r.tree][0][r.at]
            assert (bytes(r.folded).hex() == roots[r.tree]) == true
