"""Binary containers: round trips, ranges, both ways round."""

import io
import random

import numpy as np
import pytest

from probscape.sources import audit
from probscape.sources import containers as ct


class Counting(io.BytesIO):
    """Counts the bytes that are read."""

    count = 0

    def read(self, *a):
        out = super().read(*a)
        self.count += len(out)
        return out

    def size(self):
        return len(self.getbuffer())


def sparse(rng, rows, cols, density=0.2):
    full = np.array([[rng.choice([0.5, -1.0, 3.0]) if rng.random() < density else 0.0 for _ in range(cols)] for _ in range(rows)])
    at = [np.flatnonzero(full[:, c]) for c in range(cols)]
    ends = np.concatenate(([0], np.cumsum([len(a) for a in at])))
    return full, (rows, np.concatenate(at), ends, np.concatenate([full[a, c] for c, a in enumerate(at)]))


@pytest.mark.parametrize("packed", [False, True])
def test_ranges_give_the_matrix(packed, monkeypatch):
    monkeypatch.setattr(ct, "CHUNK", 7)
    rng = random.Random(1)
    full, value = sparse(rng, 9, 23)
    dense = np.arange(12.0).reshape(3, 4)
    file = Counting(ct.container_bytes({"S": value, "d": dense, "one": 4.0, "K": {"l": [3.0], "s": [2.0, 5.0], "t": {}}}, packed))
    found = {h.name: (h, at, p) for h, at, p in ct.heads(file)}
    assert {n: (h.rows, h.cols) for n, (h, _, _) in found.items()} == {"S": (9, 23), "d": (3, 4), "one": (1, 1), "K": (1, 1)}
    for name, want in (("S", full), ("d", dense), ("one", np.array([[4.0]]))):
        got = np.zeros_like(want)
        for first in range(0, want.shape[1], 5):
            for r, c, v in ct.entries(file, *found[name][1:], first, min(first + 5, want.shape[1])):
                assert ((first <= c) & (c < first + 5)).all()
                np.add.at(got, (r, c), v)
        assert (got == want).all()
    assert ct.fields(file, *found["K"][1:]) == {"l": [3.0], "s": [2.0, 5.0]}


def test_heads_and_ranges_read_little():
    n = 300_000
    value = (10, np.zeros(n, int), np.arange(n + 1), np.ones(n))
    file = Counting(ct.container_bytes({"A": value, "b": [1.0]}))
    (head, at, packed), _ = list(ct.heads(file))
    assert head.entries == n and file.count < 1000
    file.count = 0
    assert sum(len(v) for _, _, v in ct.entries(file, at, packed, 1000, 1100)) == 100 and file.count < 20_000


def test_corpus_of_containers(spark, tmp_path):
    rng = random.Random(2)
    want, rhs = set(), {}
    for k, (name, packed) in enumerate([("At", True), ("A", False), ("A", True)]):
        m, sizes = 4 + k, {"f": [2.0], "l": [3.0], "q": [2.0, 4.0], "s": [3.0]}
        full, value = sparse(rng, m, 20) if k == 1 else sparse(rng, 20, m)
        turned = full if k == 1 else full.T
        c = np.array([rng.choice([0.0, 2.0]) for _ in range(20)])
        (tmp_path / f"p{k}.mat").write_bytes(ct.container_bytes({"K": sizes, "b": np.arange(m) * 1.0, name: value, "c": c if k else c[:, None]}, packed))
        rhs[f"p{k}"] = [float(i) for i in range(m)]
        places = [*((1, i, i) for i in range(1, 3)), *((2, i, i) for i in range(1, 4)), (3, 1, 1), (3, 2, 2), *((4, i, i) for i in range(1, 5)),
                  *((5, min(r, s), max(r, s)) for s in range(1, 4) for r in range(1, 4))]
        for mat, row in enumerate([c, *turned]):
            want |= {(f"p{k}", mat, *places[j], j, row[j]) for j in np.flatnonzero(row)}
    corpus = ct.read_containers(spark, str(tmp_path))
    got = sorted(tuple(r) for r in corpus.entries.select("instance", "mat_id", "block_id", "row", "col", "value").collect())
    assert got == sorted((a, b, c, d, e, v) for a, b, c, d, e, _, v in want)
    assert {i: [r["b"] for r in corpus.rhs.where(f"instance = '{i}'").orderBy("mat_id").collect()] for i in rhs} == rhs
    assert {(r["instance"], r["m"], r["n_blocks"]) for r in corpus.problems.collect()} == {("p0", 4, 5), ("p1", 5, 5), ("p2", 6, 5)}
    small = ct.container_entries(ct.container_variables(spark, str(tmp_path)).where("variable IN ('A', 'At')"), range_entries=3)
    assert small.count() == sum(1 for x in want if x[1] > 0)


def test_broken_containers():
    with pytest.raises(ct.DataError):
        list(ct.heads(Counting(b"nothing")))
    whole = ct.container_bytes({"d": np.ones((50, 50))})
    file = Counting(whole[:-300])
    (_, at, packed), = ct.heads(file)
    with pytest.raises(ct.DataError):
        list(ct.entries(file, at, packed, 0, 50))


def test_audit_of_containers(spark, tmp_path):
    b, c, a = [1.0], [2.0], (1, [0], [0, 1], [1.0])
    made = {
        "s": {"K": {"s": [2.0]}, "b": b, "c": c, "At": a}, "l": {"K": {"l": [2.0], "s": []}, "b": b, "c": c, "A": a},
        "t": {"blk": b, "At": a, "C": c, "b": b}, "n": {"K": {"s": [2.0]}, "b": b}}
    for k, v in made.items():
        (tmp_path / f"{k}.mat").write_bytes(ct.container_bytes(v))
    variables = ct.container_variables(spark, str(tmp_path))
    verdicts = audit.classify_containers(variables, ct.container_cones(variables))
    files = variables.selectExpr("path", "1L AS size_bytes").distinct().union(spark.sql("SELECT 'x/other.mat', 1L"))
    lines = spark.createDataFrame([], "path string, line_no long, line string")
    got = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["is_instance"], r["is_sdp"]) for r in audit.classify_files(files, lines, containers=verdicts).collect()}
    assert got == {
        "s.mat": ("sedumi-mat", True, True), "l.mat": ("sedumi-mat", True, False), "t.mat": ("sdpt3-mat", True, True), "n.mat": ("matlab-mat", False, None),
        "other.mat": ("matlab-mat", False, None)}


def test_ranges_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """Many small containers are read by many tasks, each opened once for all its variables, and heads are read once."""
    monkeypatch.setattr(ct, "TASK_RANGES", 10)
    rows = [(f"i{i % 30}", i % 4, i // 60, float(i + 1)) for i in range(600)]
    vec = spark.createDataFrame(rows, "instance string, mat_id int, idx int, value double")
    assert ct.write_containers(vec, str(tmp_path), 10, 3, {"l": [10.0]}).count() == 30
    variables = ct.container_variables(spark, str(tmp_path))
    found = ct.container_entries(variables)
    assert found.rdd.getNumPartitions() == 9 and found.groupBy("variable").count().count() == 3
    assert "binaryFile" not in ct.read_containers(spark, str(tmp_path)).entries._jdf.queryExecution().optimizedPlan().toString()
    want = {}
    for name, mat, idx, value in rows:
        want[name, mat, idx + 1] = value
    got = ct.read_containers(spark, str(tmp_path)).entries.collect()
    assert {(r["instance"], r["mat_id"], r["row"]): r["value"] for r in got} == want and len(got) == len(want)
