"""What a plan's entries and outcomes carry through a shuffle."""

from stowage.plans import build, edit

FIELDS = "src_path string, drive_name string, dst_rel_path string, size long, ext string, dupe_key string, status string, " \
         "error string, copied_at long, ord long"
ROWS = [
    ("/Volumes/D/a/x.txt", "D", "D/a/x.txt", 1, "txt", "1::x.txt::txt", "pending", None, None, 0),
    ("/Volumes/D/b/x.txt", "D", None, 1, "txt", "1::x.txt::txt", "skipped-duplicate", None, None, 1),
    # Keys and destinations that the path does not tell, or that lie at its very ends.
    ("/Volumes/D/c", "D", "c", 2, "", "project::7", "pending", None, None, 2),
    ("/Volumes/D/d", "a/b", "a_b/d", 3, "", "manual::/Volumes/D/d", "failed", "EIO", 5, 3),
    ("x", "D", "D", 4, "", "", "pending", None, None, 4),
    ("", "", "", None, None, None, "pending", None, None, 5),
    (None, None, "p/q", 6, None, "6::", "source-error", "EACCES", None, 6),
    ("i/y", None, "y", 7, "txt", "7::y::txt", "pending", None, None, 7),
    ("/é/ß.txt", "Ü", "Ü/ß.txt", 8, "txt", "8::ß.txt::txt", "pending", None, None, 8),
]


def test_slim_entries_come_back_whole(make):
    entries = make(ROWS, FIELDS)
    thin = build.slim(entries)
    assert [tuple(r) for r in build.full(thin).select(entries.columns).collect()] == ROWS
    told = {r.ord: (r.dst_rel_path, r.dupe_key) for r in thin.collect()}
    assert told[0] == told[1] == told[8] == (None, None) and told[2] == ("c", "project::7")
    assert build.full(thin).columns == entries.columns
    few = entries.select("src_path", "status")
    assert build.slim(few).columns == few.columns and build.full(few).columns == few.columns


def test_in_order_keeps_rows_and_order(make):
    entries = make(ROWS, FIELDS)
    rows = [tuple(r) for r in build.in_order(entries, "src_path").collect()]
    assert rows == sorted(ROWS, key=lambda r: (r[0] is not None, r[0]))


def test_outcomes_are_shuffled_once(spark, make):
    entries = make(ROWS, FIELDS)
    outcomes = make([("/Volumes/D/a/x.txt", "D", "copied", None, 9), ("i/y", None, "failed", "EIO", 9),
                     ("i/y", "D", "copied", None, 9), (None, None, "source-missing", None, 9)],
                    "src_path string, drive_name string, status string, error string, at long")
    broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        after = edit.apply_outcomes(entries, outcomes)
        got = {r.ord: tuple(r) for r in after.collect()}
        plan = after._jdf.queryExecution().sparkPlan().toString()
        exchanges = after._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    want = {r[-1]: r for r in ROWS}
    want[0] = (*ROWS[0][:6], "copied", None, 9, 0)
    want[6] = (*ROWS[6][:6], "source-missing", None, None, 6)
    want[7] = (*ROWS[7][:6], "failed", "EIO", None, 7)
    assert got == want and after.columns == entries.columns
    assert "SortMergeJoin" in plan and exchanges == 2
