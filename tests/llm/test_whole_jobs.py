"""Cases in which an operator once did less than the whole job."""

from __future__ import annotations

from pathlib import Path

from voxmill.llm import neardup, urllists
from voxmill.llm.shared import bounded_batches

BASE = [f"w{k}" for k in range(60)]
BASE_TEXT = " ".join(BASE)


def _copy(changes: dict[int, str]) -> str:
    return " ".join(changes.get(place, word) for place, word in enumerate(BASE))


def test_only_rows_of_one_component_fall_together(spark):
    """Rows without an id and rows that share an id, with texts of their own."""
    unlike = lambda name: " ".join(f"{name}{k}" for k in range(30))
    rows = [
        (None, unlike("a")), (None, unlike("b")), (None, unlike("c")), (None, unlike("c")),
        (3, BASE_TEXT), (5, _copy({59: "x"})), (5, unlike("z")),
        (7, unlike("d")), (7, unlike("e")), (None, ""), (None, None),
    ]
    table = bounded_batches(spark).createDataFrame([(*row, 1) for row in rows], "doc_id long, text string, root int")
    found = [(r.doc_id, r.text) for r in neardup.keep_one_each(table, words=2).collect()]
    expected = set(rows) - {(5, _copy({59: "x"}))}
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_rows_without_an_id_are_linked(spark):
    """Alone with each other, and as the middle of a chain of documents with ids."""
    other = [f"v{k}" for k in range(60)]
    rows = [
        (9, BASE_TEXT), (None, _copy({3: "x", 9: "x"})), (4, _copy({3: "x", 9: "x", 30: "y", 40: "y"})),
        (None, " ".join(other)), (None, " ".join([*other, "z"])), (None, " ".join([*other, "z"])),
        (6, "a row that is like no other"),
    ]
    table = bounded_batches(spark).createDataFrame(rows, "doc_id long, text string")
    found = sorted(((r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(table, 2).collect()), key=repr)
    assert found == sorted(
        [(9, 4, False), (None, 4, False), (4, 4, True), *[(None, None, True)] * 3, (6, 6, True)], key=repr
    )
    assert len(neardup.keep_one_each(table, 2).where("doc_id IS NULL").collect()) == 1


def test_hosts_of_many_labels_and_top_level_domains(spark):
    host = "a.b.c.d.e.f.g.h.i.example"
    urls = [(1, f"http://{host}/x"), (2, f"http://z.{host}/"), (3, "http://b.c.d.e.f.g.h.i.example/"), (4, "http://y.bad/"), (5, "http://bad/")]
    captures = spark.createDataFrame([(*row, 5) for row in urls], "page_id long, url string, fetched int")
    events = [("l", host, "add", 3), ("l", "bad", "add", 3)]
    listed = spark.createDataFrame(events, "list string, pattern string, action string, day int")
    found = {r.page_id: r.pattern for r in urllists.evaluate(captures, urllists.validity(listed)).collect()}
    assert found == {1: host, 2: host, 3: None, 4: "bad", 5: "bad"}


def test_rows_with_map_columns(spark):
    """Two rows of one component that share the smallest id, beside a column that has no order."""
    rows = [(1, BASE_TEXT, {"k": 2}), (1, BASE_TEXT, {"k": 1}), (2, _copy({59: "x"}), None), (3, "a row like no other", {})]
    table = bounded_batches(spark).createDataFrame(rows, "doc_id long, text string, extra map<string, int>")
    found = sorted((r.doc_id, r.extra) for r in neardup.keep_one_each(table, words=2).collect())
    assert found == [(1, {"k": 1}), (3, {})]


def test_near_duplicates_leave_one_table(spark):
    folder = Path(spark.conf.get("spark.checkpoint.dir"))
    before = set(folder.glob("voxmill-*"))
    table = bounded_batches(spark).createDataFrame([(k, _copy({k: "x"})) for k in range(6)], "doc_id long, text string")
    assert neardup.near_duplicates(table, words=2).where("component_id = 0").count() == 6
    assert len(set(folder.glob("voxmill-*")) - before) == 1


def test_addresses_last_dots_and_equal_entries(spark):
    urls = [
        (1, "http://10.2.3.4/"), (2, "http://3.4/"), (3, "http://[2001:db8::1]:80/x"), (4, "http://a.b.c./x"),
        (5, "http://u:p@x.tie/"), (6, "http://.../"), (7, "http://10.2.3.4:8080/y"),
    ]
    captures = spark.createDataFrame([(*row, 5) for row in urls], "page_id long, url string, fetched int")
    events = [("l", "3.4", "add", 3), ("l", "4", "add", 3), ("l", "b.c", "add", 3), ("l", "[2001:db8::1]", "add", 3),
              ("spam2", "x.tie", "add", 3), ("spam", "x.tie", "add", 3), ("spammer", "x.tie", "add", 3)]
    listed = spark.createDataFrame(events, "list string, pattern string, action string, day int")
    found = {r.page_id: (r.host, r.list, r.pattern) for r in urllists.evaluate(captures, urllists.validity(listed)).collect()}
    assert found == {
        1: ("10.2.3.4", None, None), 2: ("3.4", "l", "3.4"), 3: ("[2001:db8::1]", "l", "[2001:db8::1]"),
        4: ("a.b.c", "l", "b.c"), 5: ("x.tie", "spam", "x.tie"), 6: (None, None, None), 7: ("10.2.3.4", None, None),
    }
