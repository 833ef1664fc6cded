"""The Merkle manifest against a direct calculation."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from probscape.llm import merkle, queries

COLUMNS = "extra string, source string, text string, doc_id long, lang string, n_chars long, tree string, pos long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[3], r[1], r[4], r[5], text)))


def tree(nodes):
    """The root and, for every node, its steps (others on the left, on the right)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16: k // 16 * 16 + 16]
            paths[i].append((run[: k % 16], run[k % 16 + 1:]))
            at[i] = k // 16
        nodes = [h(*nodes[k: k + 16]) for k in range(0, len(nodes), 16)]
    return nodes[0] if nodes else None, paths


def brute(rows):
    out, tops = [], {}
    for source in {r[1] for r in rows}:
        mine = sorted((r for r in rows if r[1] == source), key=lambda r: (r[3] is not None, r[3] or 0, leaf(r, r[2])))
        tops[source] = (mine, *tree([leaf(r, r[2]) for r in mine]))
    order = sorted(tops, key=lambda s: (s is not None, (s or "").encode()))
    root, upper = tree([tops[s][1] for s in order])
    for s, up in zip(order, upper, strict=True):
        for r, path in zip(tops[s][0], tops[s][2], strict=True):
            text = r[2]
            if text is not None and r[3] is not None and zlib.crc32(str(r[3]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            node = leaf(r, text)
            for left, right in path + up:
                node = h(*left, node, *right)
            proof = h(*(x for left, right in path + up for x in left + right))
            out.append((r[3], leaf(r, r[2]), tops[s][1], root, proof, node, node == root))
    return out


def got(spark, rows, height=merkle.HEIGHT):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(5)
    found = merkle.manifest(docs, F.crc32(F.col("doc_id").cast("string")) % 5 == 0, height)
    return [tuple(r)[1:] for r in found.collect()]


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.mark.parametrize(("height", "counts"), [(1, [600, 33, 16, 1]), (3, [300, 17, 1])])
def test_against_brute_force(spark, height, counts):
    rng = random.Random(height)
    rows, k = [], 0
    for source, n in zip(["big", None, "é", ""], counts, strict=False):
        for _ in range(n):
            k += 1
            rows.append(("x", source, rng.choice(["Some Text é", "lower only", "", None]) and f"{k} Text", k * 7 % 1009, "en", 3, "clash", 4))
    rows += [("x", f"s{i}", "A" * i, i, None, None, None, None) for i in range(40)]
    assert sorted(got(spark, rows, height), key=key) == sorted(brute(rows), key=key)


def test_odd_rows(spark):
    rows = [
        (None, "a", None, 1, None, None, None, None), (None, "a", None, 1, None, None, None, None), (None, "a", "", 1, "en", 0, None, None),
        (None, None, "Text", None, None, 4, None, None), (None, "", "T" * 3_000_000, 5, "fr", 9, None, None), (None, "a", "Z", 10, "de", -1, None, None)]
    assert sorted(got(spark, rows), key=key) == sorted(brute(rows), key=key)
    assert got(spark, []) == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(None, r.source, r.text, r.doc_id, r.lang, r.n_chars, None, None) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    found = queries.QUERIES["op11_merkle_manifest"](spark, folder)
    assert sorted(tuple(r) for r in found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()) == sorted(brute(rows))
