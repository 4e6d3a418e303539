import pytest
from pyspark.sql import functions as F

from stowage.plans import edit, preflight
from stowage.schemas import ENTRY


def entries(spark, rows):
    """Pending entries of ``(path, uuid, drive, size)`` in the given order."""
    made = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)],
                                 "ord long, src_path string, volume_uuid string, drive_name string, size long")
    missing = {f.name: f.dataType for f in ENTRY.fields if f.name not in made.columns}
    from pyspark.sql import functions as F
    return made.select("*", *[F.lit("pending" if n == "status" else None).cast(t).alias(n) for n, t in missing.items()])


def test_mount_tiers(spark, make):
    plan = entries(spark, [
        ("/Volumes/Photos/a", "AA-1", "Photos", 1), ("/Volumes/Music/a", None, "Music", 2), ("/Volumes/Video/a", None, "Video", 3),
        ("/Volumes/Docs/a", None, "Docs", 4), ("/Volumes/Old 2/a", None, "Old 2", 5), ("/Volumes/Lost/a", None, "Lost", 6),
        ("/Users/me/a", "AA-1", "Home", 7)])
    mounts = make([
        ("/Volumes/P", "Other", "aa-1", 0), ("/Volumes/Photos", "Photos", None, 1), ("/Volumes/music", "music", None, 2),
        ("/Volumes/Music", "Music", None, 3), ("/Volumes/VIDEO", "VIDEO", None, 4), ("/Volumes/Docs 1", "Docs 1", None, 5),
        ("/Volumes/Docs 2", "Docs 2", None, 6), ("/Volumes/Old", "Old", None, 7), ("/Volumes/Lostly", "Lostly", None, 8)],
        "path string, name string, uuid string, ord int")
    groups = preflight.drive_groups(plan)
    matched = preflight.match_mounts(groups, mounts)
    assert {r.group_key: (r.tier, r.mount_path) for r in matched.collect()} == {
        "AA-1": (1, "/Volumes/P"), "name:Music": (2, "/Volumes/Music"), "name:Video": (3, "/Volumes/VIDEO"),
        "name:Docs": (4, "/Volumes/Docs 1"), "name:Old 2": (4, "/Volumes/Old"), "name:Lost": (None, None), "internal": (0, "/")}
    now = {r.src_path: r.src_now for r in preflight.current_sources(plan, matched).collect()}
    assert now["/Volumes/Photos/a"] == "/Volumes/P/a" and now["/Volumes/Lost/a"] == "/Volumes/Lost/a"
    assert now["/Users/me/a"] == "/Users/me/a"


def test_outcome_ladder(spark, make):
    plan = entries(spark, [("/Volumes/A/x", None, "A", 1), ("/Volumes/B/x", None, "A", 1), ("/Volumes/A/gone", None, "A", 1),
                           ("/Volumes/A/there", None, "A", 1)])
    live = make([("/Volumes/A/x",), ("/Volumes/B/x",), ("/Volumes/A/there",)], "path string")
    there = make([("/B/A/there",)], "path string")
    resolved = preflight.resolve_destinations(plan, "/B", "mirrored", there)
    assert {r.dst_path for r in resolved.collect()} == {"/B/A/x", "/B/A/gone", "/B/A/there"}
    for mode, second, existing in (("additive", "skipped-exists", "skipped-exists"), ("fresh", "failed", "failed"),
                                   ("overwrite", "copied", "copied")):
        got = {r.src_path: r.predicted for r in preflight.predict_outcomes(resolved, live, there, "/B", mode).collect()}
        assert got == {"/Volumes/A/x": "copied", "/Volumes/B/x": second, "/Volumes/A/gone": "source-missing",
                       "/Volumes/A/there": existing}
    flat = preflight.resolve_destinations(plan, "/B/", "flat", make([("/B/x",), ("/B/sub/gone",)], "path string"))
    assert {r.src_path: r.dst_path for r in flat.collect()} == {
        "/Volumes/A/x": "/B/x (2)", "/Volumes/B/x": "/B/x (3)", "/Volumes/A/gone": "/B/gone", "/Volumes/A/there": "/B/there"}


def test_checks(spark, make):
    plan = entries(spark, [("/Volumes/A/x", None, "A", 10)])
    assert preflight.space_check(plan, None).first().fits
    assert preflight.space_check(plan, 1024 ** 3 + 10).first().fits
    assert not preflight.space_check(plan, 1024 ** 3 + 9).first().fits
    assert preflight.destination_error("/") and preflight.destination_error("") and preflight.destination_error("/app/x", ["/app"])
    assert preflight.destination_error("/Volumes/B") is None
    paths = make([("/", "root"), ("/Volumes/A", "volume root"), ("/Volumes/A/", "volume root"), ("/app/x", "protected folder"),
                  ("", "no path"), ("/Volumes/A/x", None)], "path string, want string")
    got = paths.select("want", preflight.protected_path("path", ["/app"]).alias("why")).collect()
    assert [r.want for r in got] == [r.why for r in got]


def test_edits(spark):
    header = edit.working_plan(spark)[1]
    assert edit.plan_update_settings(header, layout="flat", name="N", destination=None)["layout"] == "flat"
    with pytest.raises(ValueError):
        edit.plan_update_settings(header, layout="sideways")
    assert edit.saved_name("My plan!") == "My_plan_" and edit.saved_name(None) == "plan"
    plan = entries(spark, [("/a", None, None, 1), ("/b", None, None, 2)])
    from pyspark.sql import functions as F
    lost = plan.withColumn("status", F.when(F.col("ord") == 0, "skipped-project-duplicate").otherwise("copied"))
    for keep, want in ((False, 2), (True, 1)):
        copy, head = edit.plan_save_as(lost, header, "x", 1000, keep)
        assert copy.filter("status = 'pending'").count() == want
        assert (head["totalFiles"], head["kind"], head["id"]) == (want, "saved", "plan_x_1000")
    assert edit.plan_clear(lost).count() == 0


def test_many_destinations_are_refused_for_the_reasons_of_one(make):
    there = make([("/Volumes/B/x/y/f",), ("/Volumes/B/top",), (None,), ("/at-root",)], "path string")
    paths = ["/", "", "/Volumes/B", "/Volumes/B/", "/Volumes/B/x", "/Volumes/B/x/y/", "/Volumes/B/x/y/f", "/Volumes/B/xy",
             "/Keep", "/Keep/a", "/Keeper"]
    wanted = make([(p,) for p in paths], "path string")
    for mode, existing in (("fresh", there), ("additive", there), ("fresh", None)):
        got = {r.path: r.why for r in preflight.refused_destinations(wanted, ["/Keep/"], mode, existing).collect()}
        assert got == {p: preflight.destination_error(p, ["/Keep/"], mode, existing) for p in paths}
    unknown = preflight.refused_destinations(make([(None,)], "path string"), (), "fresh", there.limit(0)).collect()
    assert [r.why for r in unknown] == ["no destination"]


def test_entries_of_one_drive_do_not_meet_in_one_task(spark):
    entries = spark.createDataFrame([(f"/Volumes/A/f{i}", None, "A", i) for i in range(20)] + [("/Volumes/B/g", None, "B", 7)],
                                    "src_path string, volume_uuid string, drive_name string, ord long")
    ordered = preflight.in_run_order(entries)
    assert {(r.drive_name, r.group_ord) for r in ordered.collect()} == {("A", 0), ("B", 7)}
    assert "hashpartitioning" not in ordered._jdf.queryExecution().toString()


def test_flat_destinations_are_made_from_stored_entries(spark):
    entries = spark.createDataFrame(
        [("/Volumes/A/x.txt", "A", "x.txt", "pending", 1), ("/Volumes/A/b/x.txt", "A", "x.txt", "pending", 2),
         ("/Volumes/A/gone.txt", "A", "gone.txt", "pending", 3)],
        "src_path string, drive_name string, name string, status string, ord long").withColumn(
        "volume_uuid", F.lit(None).cast("string"))
    live = spark.createDataFrame([("/Volumes/A/x.txt",), ("/Volumes/A/b/x.txt",)], "path string")
    resolved = preflight.resolve_destinations(entries, "/B", "flat", live.limit(0), live=live)
    assert {(r.src_path, r.dst_path) for r in resolved.collect()} == {
        ("/Volumes/A/x.txt", "/B/x.txt"), ("/Volumes/A/b/x.txt", "/B/x (2).txt"), ("/Volumes/A/gone.txt", None)}
    assert "ExistingRDD" not in resolved._jdf.queryExecution().executedPlan().toString()
