"""Flattening of nested records: every shape, and a brute-force reading of random ones."""

import json

from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.operators import nested
from tests.conftest import rows

SCHEMA = "result_id long, result string, child string, pos int"  # child and pos clash with result columns


def links(spark, *texts, ids=None):
    data = [(i, t, "x", 9) for i, t in zip(ids or range(len(texts)), texts)]
    return rows(nested.links(spark.createDataFrame(data, SCHEMA)))


def record(findings=None, commits=None):
    return json.dumps({"vulnerabilities": {"findings": findings}, "git": {"large_commits": commits}})


def test_shapes(spark):
    f = {"file_path": "a.py"}
    assert links(spark, record([f, None, {"file_path": None}, {}])) == [(0, "finding", 0, "a.py"), (0, "finding", 2, ""), (0, "finding", 3, "")]
    assert links(spark, record({"3": f, "7": None, "10": {}})) == [(0, "finding", 10, ""), (0, "finding", 3, "a.py")]
    assert links(spark, record({"items": [None, f], "count": 2})) == [(0, "finding", 1, "a.py")]
    assert links(spark, record(f)) == [(0, "finding", 0, "a.py")]
    assert links(spark, record(json.dumps([f, f]))) == [(0, "finding", 0, "a.py"), (0, "finding", 1, "a.py")]
    assert links(spark, record(None, [{"hash": "ab"}])) == [(0, "large_commit", 0, "ab")]
    assert links(spark, json.dumps({"git": {"largeCommits": [{"hash": "ab"}]}, "vulnerabilities": {"findings": [{"filePath": "b"}]}})) == [(0, "finding", 0, "b"), (0, "large_commit", 0, "ab")]


def test_envelopes_and_failures(spark):
    inner = record([{"file_path": "a"}])
    assert links(spark, json.dumps({"success": True, "result": json.loads(inner)})) == [(0, "finding", 0, "a")]
    assert links(spark, json.dumps({"success": True, "result": inner})) == [(0, "finding", 0, "a")]
    assert links(spark, None, "", "  ", inner[:-9], json.dumps({"success": False, "message": "no", "result": None}), "path not found", "[]", "5") == []


def test_received_twice_and_empty(spark):
    text = record([{"file_path": "a"}, {"file_path": "a"}])
    assert links(spark, text, text, ids=[1, 1]) == [(1, "finding", 0, "a"), (1, "finding", 1, "a")]
    assert links(spark) == []


def test_tables(spark):
    text = record([{"file_path": "a", "line_number": 3, "trace": [{"x": 1}, None]}], [{"hash": "h", "files_changed": 2, "is_too_large": True}])
    df = spark.createDataFrame([(1, text)], "result_id long, result string")
    assert rows(nested.children_table(df, nested.FINDING), "result_id", "pos", "file_path", "line_number", "severity") == [(1, 0, "a", 3, None)]
    assert rows(nested.children_table(df, nested.LARGE_COMMIT), "hash", "files_changed", "is_too_large", "author") == [("h", 2, True, None)]
    assert rows(nested.grandchildren_table(df, nested.FINDING)) == [(1, 0, 0, '{"x":1}')]


entry = st.one_of(st.none(), st.fixed_dictionaries({}, optional={"file_path": st.one_of(st.none(), st.text("ab/.é", max_size=5)), "severity": st.just("high")}))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.lists(entry, max_size=4), min_size=1, max_size=12))
def test_against_brute_force(spark, lists):
    expected = [(i, "finding", p, (e.get("file_path") or "")) for i, entries in enumerate(lists) for p, e in enumerate(entries) if e is not None]
    assert links(spark, *(record(x) for x in lists)) == sorted(expected, key=str)


def test_results(spark):
    texts = [(1, '{"vulnerabilities": {"findings": [{"file_path": "a"}, null]}, "git": {"large_commits": []}}'), (1, '{"vulnerabilities": {"findings": [{"file_path": "a"}, null]}, "git": {"large_commits": []}}'), (2, "{}"), (3, None), (4, "{cut")]
    df = spark.createDataFrame(texts, "result_id long, result string")
    assert rows(nested.results_table(df)) == [(1, 1, 0), (2, 0, 0)] and nested.results_table(df.limit(0)).count() == 0
