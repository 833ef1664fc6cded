"""Audits and graphs read from real files."""

import pytest

from probscape.common import DataError
from probscape.operators.graphs import graph_weight_matrix, plan_conversion, read_graphs
from probscape.sources.audit import audit_folder, audit_summary, classify_graph_text


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "torus").mkdir()
    (tmp_path / "torus" / "g.dat").write_text("3 2\n2 1 1.5\n3 3 2.0D0\n")
    (tmp_path / "torus" / "far.dat").write_text("3 1\n7 1 1.5\n")
    (tmp_path / "torus" / "empty.dat").write_text("# nothing\n\n")
    (tmp_path / "lib.dat-s").write_text('"c\n1\n1\n4\n1.0\n0 1 1 1 2\n')
    (tmp_path / "lp.sdpa").write_text("1\n1\n-4\n1.0\n")
    (tmp_path / "gen.m").write_text("x")
    (tmp_path / "read me.txt").write_text("x")
    return tmp_path


def test_audit(spark, folder):
    out = audit_folder(spark, str(folder))
    got = {r["path"]: (r["family"], r["is_instance"], r["is_sdp"], r["kind"], r["reason"]) for r in out.collect()}
    assert got == {
        "torus/g.dat": ("torus", True, False, "raw-dimacs-data", "numeric DIMACS data file; not a solver-ready SDP formulation"),
        "torus/far.dat": ("torus", False, None, "text", "entry index outside header dimensions"),
        "torus/empty.dat": ("torus", False, None, "empty", "empty or comment-only file"),
        "lib.dat-s": ("", True, True, "sdpa-text", "has semidefinite blocks"),
        "lp.sdpa": ("", True, False, "sdpa-text", "has only linear diagonal blocks"),
        "gen.m": ("", False, None, "matlab-script", "source/generator script"),
        "read me.txt": ("", False, None, "unknown", "unsupported extension '.txt'"),
    }
    assert tuple(audit_summary(out).first()) == (7, 3, 1, 2, 4)


def test_graph_files(spark, tmp_path):
    (tmp_path / "g.dat").write_text("3 2 2\n2 1 1.5\n3 3 2.0\n")
    heads, edges = read_graphs(spark, str(tmp_path))
    assert [tuple(r) for r in heads.collect()] == [("g.dat", 3, 2, 2)]
    assert sorted(tuple(r) for r in graph_weight_matrix(edges).collect()) == [
        ("g.dat", 1, 2, 1.5), ("g.dat", 2, 1, 1.5), ("g.dat", 3, 3, 4.0)]
    (tmp_path / "h.dat").write_text("3 5\n2 1 1.5\n")
    with pytest.raises(DataError):
        read_graphs(spark, str(tmp_path))


def test_conversion_switches(spark):
    files = spark.createDataFrame(
        [("FAP/a.dat", True, False, 9000), ("FAP/b.dat", True, False, 10), ("FAP/b.mat", True, True, 0), ("NQL/c.dat", True, False, 5)],
        "path string, is_instance boolean, is_sdp boolean, n int",
    )
    none = spark.createDataFrame([], "path string")

    def plan(existing=none, **kw):
        return {r["source"]: r["status"] for r in plan_conversion(files, existing, **kw).collect()}

    assert plan() == {"FAP/a.dat": "skipped-huge", "FAP/b.dat": "skipped", "FAP/b.mat": "copied"}
    assert plan(allow_huge=True)["FAP/a.dat"] == "converted"
    assert plan(convert_existing_raw=True)["FAP/b.dat"] == "converted"
    there = spark.createDataFrame([("FAP/b.mat",), ("FAP/a.mat",)], "path string")
    assert plan(there)["FAP/b.mat"] == "exists" and plan(there)["FAP/a.dat"] == "skipped"
    assert plan(there, overwrite=True)["FAP/b.mat"] == "copied"


def test_graph_lines_are_taken_apart_once(spark):
    """Headers that look like rows, rows that repeat them, text, and lines that are no rows, in one pass behind the headers' places."""
    texts = {
        "a.dat": ["# c", "3 9 2", "1 2 1.0", "some words", "3 9 2x", "2 3 1d0"], "b.dat": ["3 9 2", "3 9 2", "1 2 1"], "c.dat": ["5 1", "x", "+2. 1 .5"],
        "d.dat": ["0 1 1", "1 1 1"], "e.dat": ["5 2 1 1", "1 1 1"], "f.dat": ["5 2 x", "1 1 1"], "g.dat": ["4 1", "inf 1 1", "1 1"], "h.dat": ["4 0"], "i.dat": ["9 9 9", "0 1 1"]}
    lines = spark.createDataFrame([(p, i, x) for p, t in texts.items() for i, x in enumerate(t)], "path string, line_no long, line string")
    found = classify_graph_text(lines)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(") == 1
    got = {r["path"][0]: r["v"]["reason"] for r in found.collect()}
    bad, size, none, good = (
        "entry index outside header dimensions", "invalid DIMACS dimensions", "no valid DIMACS data rows found",
        "numeric DIMACS data file; not a solver-ready SDP formulation")
    text = "header is not DIMACS numeric data"
    assert got == {"a": good, "b": bad, "c": good, "d": size, "e": text, "f": text, "g": none, "h": good, "i": bad}
    few = {r["path"][0]: r["v"]["reason"] for r in classify_graph_text(lines, checked_rows=1).collect()}
    assert few == got
