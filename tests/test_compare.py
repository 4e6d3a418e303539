import tempfile

from stowage.operators import dedup, diff, drives
from stowage.operators.filters import FilterSpec
from stowage.sources import export

SCAN = "path string, name string, ext string, size long, mtime long, ord long"


def test_diff_of_two_scans(make):
    before = make([
        ("/a/same", "same", "", 1, 1, 0), ("/a/grown", "grown", "", 1, 1, 1), ("/a/gone", "gone", "", 3, 1, 2),
        ("/a/old", "old", "", 4, 9, 3), ("/a/twice", "twice", "", 5, 1, 4), ("/b/twice", "twice", "", 5, 1, 5),
        ("/a/same", "same", "", 8, 8, 6), (None, "x", None, 1, None, 7), ("/a/null", "null", None, None, None, 8)], SCAN)
    after = make([
        ("/a/same", "same", "", 1, 1, 0), ("/a/grown", "grown", "", 2, 1, 1), ("/z/old", "old", "", 4, 9, 2),
        ("/z/twice", "twice", "", 5, 1, 3), ("/a/new", "new", "", 3, 1, 4), (None, "x", None, 1, None, 5),
        ("/z/null", "null", None, None, None, 6)], SCAN)
    rows = {(r.change, r.old_path, r.path, r.old_size, r.size) for r in diff.scan_diff(before, after).collect()}
    assert rows == {
        ("changed", "/a/grown", "/a/grown", 1, 2), ("removed", "/a/gone", "/a/gone", 3, None),
        ("moved", "/a/old", "/z/old", 4, 4), ("moved", "/a/twice", "/z/twice", 5, 5),
        ("removed", "/b/twice", "/b/twice", 5, None), ("added", None, "/a/new", None, 3),
        ("moved", "/a/null", "/z/null", None, None)}
    plain = diff.scan_diff(before, after, moves=False)
    assert {(r.change, r.files, r.bytes) for r in diff.diff_totals(plain).collect()} == {
        ("changed", 1, 2), ("removed", 5, 17), ("added", 4, 12)}
    assert diff.scan_diff(before, before).count() == 0
    assert diff.scan_diff(before.limit(0), after).filter("change = 'added'").count() == 7


def test_drive_pairs_count_keys_once(make):
    files = make([("A", "x", "t", 2), ("A", "x", "t", 2), ("B", "x", "t", 2), ("C", "x", "t", 2), ("B", "y", None, 5),
                  ("C", "y", "", 5), ("A", "z", "t", 7), (None, "x", "t", 2)], "drive_name string, name string, ext string, size long")
    got = {(r.drive_a, r.drive_b): (r.shared_keys, r.shared_bytes) for r in drives.drive_pairs(files).collect()}
    assert got == {("A", "B"): (1, 2), ("A", "C"): (1, 2), ("B", "C"): (2, 7), (None, "A"): (1, 2), (None, "B"): (1, 2),
                   (None, "C"): (1, 2)}


def test_equal_names_and_sizes_with_other_content_are_no_copies(make):
    files = make([(0, "/a/x.t", "x.t", 3, "t", 1), (1, "/b/x.t", "x.t", 3, "t", 1), (2, "/c/x.t", "x.t", 3, "t", 1),
                  (3, "/d/y.t", "y.t", 3, "t", 1), (4, "/e/z.t", "z.t", 9, "t", 1), (5, "/f/x.t", "x.t", 3, "t", 1)],
                 "scan_order int, path string, name string, size long, ext string, mtime long").selectExpr("*", "0L as ord")
    contents = make([("/a/x.t", "one"), ("/b/x.t", "two"), ("/c/x.t", "one"), ("/d/y.t", "one"), ("/e/z.t", "big"),
                     ("/f/x.t", None)], "path string, content string")
    assert {r.path for r in dedup.content_candidates(files).collect()} == {"/a/x.t", "/b/x.t", "/c/x.t", "/f/x.t"}
    got = {r.path: (r.is_winner, r.winner_path) for r in dedup.dedupe_by_content(files, contents).collect()}
    assert got == {"/a/x.t": (True, "/a/x.t"), "/c/x.t": (False, "/a/x.t")}
    loose = dedup.dedupe_by_content(files, contents, by=("size",))
    assert {r.path for r in loose.filter("not is_winner").collect()} == {"/c/x.t", "/d/y.t"}


def test_exports_come_back_as_they_were(spark, make):
    odd = ['a "quoted" name', "line\nend", "comma, here", " blanks ", "", None, "back\\slash", "\\N", '"', "null", "ü漢"]
    rows = [(n * 3, odd[n % len(odd)], None if n % 5 == 0 else n) for n in range(200)]
    files = make(rows, "ord long, name string, size long")
    for kind in export.FORMATS:
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/out"
        export.export_filtered(files, FilterSpec(), path, ["ord"], kind, rows_per_file=30)
        back = export.read_export(spark, path, files.schema, kind)
        got = sorted((r.position, r.ord, r.name, r.size) for r in back.collect())
        assert got == [(i, *r) for i, r in enumerate(rows)]
        parts = back.selectExpr("_metadata.file_name as part", "position").groupBy("part").agg({"position": "min"})
        assert [r[1] for r in sorted(parts.collect())] == sorted(r[1] for r in parts.collect())
