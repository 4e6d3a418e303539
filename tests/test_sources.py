import json
import tempfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from threading import Barrier

import pytest

from stowage.plans import edit, trash
from stowage.session import work_dir
from stowage.sources import catalogs, inventory, plan_store, scan_store, trash_log, versions
from stowage.streaming import live


@pytest.fixture
def folder():
    return Path(tempfile.mkdtemp(prefix="run-", dir="/tmp"))


def record(path, size=1, mtime=5):
    name = path.rsplit("/", 1)[-1]
    return {"name": name, "path": path, "size": size, "mtime": mtime, "ext": name.rsplit(".", 1)[-1]}


def scan(folder, stem, root, records, errors=None, **head):
    (folder / f"{stem}.ndjson").write_text("".join(json.dumps(r) + "\n" for r in records))
    header = {"root": root, "ndjson": f"{stem}.ndjson"} | head
    if errors is not None:
        (folder / f"{stem}.errors.ndjson").write_text("".join(json.dumps(e) + "\n" for e in errors))
        header["errors"] = f"{stem}.errors.ndjson"
    (folder / f"{stem}.header.json").write_text(json.dumps(header))
    return str(folder / f"{stem}.header.json")


def test_bad_lines(spark, folder):
    good = json.dumps(record("/a/x.txt"))
    (folder / "s.ndjson").write_text(good + "\n\n{broken\n" + '{"path": "/a/y", "size": "big"}\n' + "not json\n")
    rows = inventory.read_inventory(spark, str(folder / "s.ndjson")).orderBy("ord").collect()
    assert [(r.path, r.size) for r in rows] == [("/a/x.txt", 1), ("/a/y", None)]
    assert inventory.read_inventory(spark, str(folder / "none.ndjson")).count() == 0


def test_line_order_over_many_splits_and_files(spark, folder):
    """Places are dense, in the order of part numbers, whatever the size and packing of splits."""
    (folder / "parts").mkdir()
    n = 0
    for part in (3, 20, 100):
        lines = []
        for _ in range(4000):
            lines += [json.dumps(record(f"/r/{n}.txt", n)) + "\n", "{broken\n" * (n % 3), "\n" * (n % 2)]
            n += 1
        (folder / "parts" / f"part-{part}.ndjson").write_text("".join(lines))
    (folder / "parts" / "first.ndjson").write_text(json.dumps(record("/r/x.txt", -1)))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for size, cost in (("100000", "100"), ("10000", "40000"), ("128m", "4m")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
        try:
            rows = inventory.read_inventory(spark, str(folder / "parts")).select("ord", "size").collect()
        finally:
            for key, value in old.items():
                spark.conf.set(key, value)
        assert sorted((r.ord, r.size) for r in rows) == [(i, i - 1) for i in range(n + 1)]


def test_names_that_look_like_globs_or_escapes(spark, folder):
    names = ["a b", "a+b", "100%", "a%20b", "{a,b}", "[ab]", "a*", "a?", "naïve"]
    heads = [scan(folder, name, f"/Volumes/{n}", [record(f"/Volumes/{n}/x", n)]) for n, name in enumerate(names)]
    files, sources, warnings = inventory.read_scans(spark, heads)
    assert not warnings and sorted((r.scan_order, r.size) for r in files.collect()) == [(n, n) for n in range(len(names))]
    assert [s.drive_name for s in sources] == [str(n) for n in range(len(names))]


def test_any_number_of_scans_is_read_at_once(spark, folder, capsys):
    paths = []
    for n in range(30):
        paths.append(folder / f"s{n}.ndjson")
        paths[-1].write_text(json.dumps(record(f"/r/{n}")))
    inventory._text_of(spark, [str(p) for p in [*paths, folder / "gone.ndjson"]]).explain()
    assert capsys.readouterr().out.count("Scan text") == 1
    assert inventory._text_of(spark, [str(folder / "gone.ndjson")]) is None


def test_scans_that_share_a_file_both_have_its_records(spark, folder):
    heads = [scan(folder, stem, "/Volumes/A", [record("/Volumes/A/x"), record("/Volumes/A/y")], ndjson="one.ndjson")
             for stem in ("one", "two")]
    files, _, _ = inventory.read_scans(spark, heads)
    assert sorted((r.scan_order, r.ord, r.path[-1]) for r in files.collect()) == [
        (0, 0, "x"), (0, 1, "y"), (1, 0, "x"), (1, 1, "y")]


def test_scans_keep_their_place(spark, folder):
    one = scan(folder, "one", "/Volumes/A/", [record("/Volumes/A/x")], [{"path": "/Volumes/A/no", "error": "EACCES"}], volumeUUID="U1")
    two = scan(folder, "two", "/Volumes/B", [record("/Volumes/B/x")], volumeName="Bee")
    files, sources, warnings = inventory.read_scans(spark, [one, str(folder / "gone.header.json"), two])
    assert [(s.drive_name, s.scan_order, s.volume_uuid) for s in sources] == [("A", 0, "U1"), ("Bee", 2, None)]
    assert len(warnings) == 1
    assert sorted((r.scan_order, r.path) for r in files.collect()) == [(0, "/Volumes/A/x"), (2, "/Volumes/B/x")]
    assert [(r.path, r.drive_name) for r in inventory.read_errors(spark, sources).collect()] == [("/Volumes/A/no", "A")]
    with pytest.raises(ValueError):
        inventory.read_scans(spark, [one, one])


def test_catalogs(spark, folder):
    scan(folder, "one", "/Volumes/A", [record("/Volumes/A/x")])
    (folder / "p1.plan.json").write_text(json.dumps({"id": "p1", "totalFiles": 3}))
    (folder / "p2.plan.json").write_text("{oops")
    rows = catalogs.scan_catalog(spark, str(folder)).collect()
    assert [(r.file, r.size) for r in rows] == [
        ("one.header.json", (folder / "one.header.json").stat().st_size + (folder / "one.ndjson").stat().st_size)]
    heads = {r.file: r.header for r in catalogs.plan_catalog(spark, str(folder)).collect()}
    assert heads["p2.plan.json"] is None and heads["p1.plan.json"].totalFiles == 3


def test_listing(spark, make):
    listing = make([
        ("/r/a.TXT", "file", 1, 5.9), ("/r/link", "symlink", 1, 1.0), ("/r/.Trashes", "file", 1, 1.0),
        ("/r/.Spotlight-V9/x", "file", 1, 1.0), ("/r/.TimeMachine", "file", 2, 1.0), ("/r/.TimeMachine/x", "file", 1, 1.0),
        ("/r/d", "dir", 0, 1.0), ("/r/.TimeMachine", "dir", 0, 1.0)], "path string, kind string, size long, mtime double")
    rows = inventory.inventory_from_listing(listing, "/r").orderBy("path").collect()
    assert [(r.path, r.ext, r.mtime) for r in rows] == [("/r/.TimeMachine", "", 1), ("/r/a.TXT", "txt", 5)]
    assert inventory.inventory_from_listing(listing, "/r", skip_time_machine=False).count() == 3
    assert inventory.directory_count(listing, "/r").first()[0] == 2
    system = make([("/System/x", "file", 1, 1.0)], "path string, kind string, size long, mtime double")
    assert inventory.inventory_from_listing(system, "/System").count() == 1
    assert inventory.inventory_from_listing(system, "/").count() == 0


def test_plan_store_versions(spark, folder, make):
    entries, header = edit.working_plan(spark)
    picked = make([("/a/x.txt", 4), ("/a/x.txt", 9), (None, 1), ("/a/y.txt", 2)], "src_path string, size long").coalesce(1)
    from pyspark.sql import functions as F
    added = edit.plan_add(entries, picked.withColumn("n", F.monotonically_increasing_id()), ["n"])
    assert added.report() == {"added": 2, "skipped": 1, "total": 2}
    plan_store.write_plan(spark, added.entries, header, str(folder / "plan"))
    stored, head = plan_store.read_plan(spark, str(folder / "plan"))
    assert head == header and {(r.src_path, r.size, r.name) for r in stored.collect()} == {("/a/x.txt", 4, "x.txt"), ("/a/y.txt", 2, "y.txt")}
    # The new version is read from the old one.
    plan_store.write_plan(spark, edit.plan_remove(stored, make([("/a/x.txt",)], "src_path string")), head, str(folder / "plan"))
    assert plan_store.read_plan(spark, str(folder / "plan"))[0].count() == 1
    assert plan_store.preview(stored, 1).count() == 1 and plan_store.preview(stored, 0).count() == 2


def test_trash_log_file(spark, folder):
    (folder / "t.json").write_text(json.dumps({"entries": [{"path": "/a", "queuedAt": "2024-01-01T00:00:00Z", "status": "trashed"}],
                                               "retentionOverride": "24h"}))
    log = trash_log.read_trash_log(spark, str(folder / "t.json"))
    assert log.retention == "24h" and [r.path for r in log.entries.collect()] == ["/a"]
    (folder / "bad.json").write_text("{")
    assert trash_log.read_trash_log(spark, str(folder / "bad.json")).entries.count() == 0
    assert trash_log.read_trash_log(spark, str(folder / "none.json")).entries.count() == 0


def test_trash_states(make):
    log = trash.TrashLog(make([
        ("/Volumes/A/back", "2024-01-14T00:00:00Z", "trashed"), ("/Volumes/A/gone", "2024-01-14T00:00:00Z", "trashed"),
        ("/Volumes/Z/off", "2024-01-14T00:00:00Z", "trashed"), ("/Volumes/A/ack", "2024-01-14T00:00:00Z", "restored"),
        ("/home/dead", "2024-01-14T00:00:00Z", "deleted"), ("/home/old", "2023-01-01T00:00:00Z", "trashed"),
        ("/home/bad", "soon", "trashed"), ("/home/none", None, "trashed")], "path string, queued_at string, status string"))
    inv = make([("/Volumes/A/gone", 5), ("/home/dead", 6), ("/home/bad", 7)], "path string, size long")
    live, mounts = make([("/Volumes/A/back",)], "path string"), make([("/Volumes/A",)], "path string")
    done = trash.reconcile_trash(log, inv, live, mounts, 1_705_320_000_000, label="30d")
    assert {(r.path, r.status) for r in done.log.entries.collect()} == {("/Volumes/A/back", "restored"), ("/Volumes/Z/off", "trashed")}
    assert done.totals({"fileCount": 9}) == {"fileCount": 1, "totalBytes": 7}
    report = done.report(inv).first().asDict()
    assert report == {"checked": 5, "restored": 1, "restored_acked": 1, "retention_pruned": 3, "still_pending": 1, "removed": 2}
    assert trash.apply_retention(log, 1_705_320_000_000).entries.count() == 8
    with pytest.raises(ValueError):
        trash.set_retention(log, "1y")
    assert trash.set_retention(trash.set_retention(log, "24h"), None).retention is None


def test_streams(spark, folder, make):
    scan(folder, "one", "/A", [record("/A/x.t", 2), record("/A/y.t", 3), record("/B/x.t", 2)], [{"path": "/A/no", "error": "E"}])
    records = live.stream_inventory(spark, str(folder), max_files=1)
    got = live.run_to_table(live.stream_scan_totals(records), "complete").collect()
    assert [(r.scan, r.file_count, r.total_bytes, r.error_count) for r in got] == [("one", 3, 7, 1)]
    kept = live.run_to_table(live.stream_dedupe(live.stream_inventory(spark, str(folder)).filter("not is_error")))
    assert kept.count() == 2
    entries, header = edit.working_plan(spark)
    picked = make([("/A/x.t", 2, 1), ("/A/y.t", 3, 2)], "src_path string, size long, n long")
    plan_store.write_plan(spark, edit.plan_add(entries, picked, ["n"]).entries, header, str(folder / "plan"))
    make([("/A/x.t", "failed", "EIO", 1, 1), ("/A/x.t", "copied", None, 7, 2)],
         "src_path string, status string, error string, at long, seq long").coalesce(1).write.parquet(str(folder / "out"))
    stream = spark.readStream.schema("src_path string, status string, error string, at long, seq long").parquet(str(folder / "out"))
    live.stream_apply_outcomes(stream, str(folder / "plan"), ["seq"], f"{work_dir(spark)}/{folder.name}").awaitTermination()
    rows = {r.src_path: (r.status, r.error, r.copied_at) for r in plan_store.read_plan(spark, str(folder / "plan"))[0].collect()}
    assert rows == {"/A/x.t": ("copied", None, 7), "/A/y.t": ("pending", None, None)}


def test_of_two_writers_on_one_base_one_wins(spark, folder, make):
    plan = str(folder / "plan")
    entries, header = edit.working_plan(spark)
    for round_ in range(4):
        base = plan_store.write_plan(spark, entries, header, plan)
        gate = Barrier(2)

        def writer(n):
            gate.wait()
            try:
                return plan_store.write_plan(spark, entries, {**header, "name": f"{round_} {n}"}, plan, base)
            except plan_store.StalePlan:
                return None

        with ThreadPoolExecutor(2) as pool:
            done = list(pool.map(writer, range(2)))
        assert sum(d is not None for d in done) == 1
        winner = next(n for n, d in enumerate(done) if d)
        assert plan_store.read_plan(spark, plan)[1]["name"] == f"{round_} {winner}"
        assert plan_store.current_version(spark, plan) == done[winner]
    with pytest.raises(plan_store.StalePlan):
        plan_store.write_plan(spark, entries, header, plan, base)


def test_one_of_many_creates_a_file(spark, folder):
    with ThreadPoolExecutor(8) as pool:
        made = list(pool.map(lambda n: versions.create_if_absent(spark, f"{folder}/x/1.json", str(n)), range(40)))
    assert sum(made) == 1 and (folder / "x" / "1.json").read_text() == str(made.index(True))
    assert [p.name for p in (folder / "x").iterdir()] == ["1.json"]


def test_writers_without_a_base_replace_the_plan_one_after_the_other(spark, folder):
    plan = str(folder / "plan")
    entries, header = edit.working_plan(spark)
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda n: plan_store.write_plan(spark, entries, {**header, "name": str(n)}, plan), range(6)))
    assert versions.latest(spark, plan).number == 6


@pytest.fixture
def planned(spark, folder, make):
    entries, header = edit.working_plan(spark)
    picked = make([("/A/x.t", 2, 1), ("/A/y.t", 3, 2), ("/A/z.t", 4, 3)], "src_path string, size long, n long")
    plan_store.write_plan(spark, edit.plan_add(entries, picked, ["n"]).entries, header, str(folder / "plan"))
    return str(folder / "plan")


OUTCOME = "src_path string, status string, error string, at long, seq long"


def statuses(spark, plan):
    return {r.src_path[3]: r.status for r in plan_store.read_plan(spark, plan)[0].collect()}


def test_outcomes_are_appended_merged_and_compacted(spark, planned, make, folder):
    tell = lambda rows, batch, stream="run": plan_store.tell_outcomes(
        spark, planned, make(rows, OUTCOME), ["seq"], batch, stream)
    before = plan_store.current_version(spark, planned)
    assert tell([("/A/x.t", "failed", "EIO", 1, 1), ("/A/y.t", "copied", None, 2, 5)], 0)
    assert not tell([("/A/z.t", "copied", None, 2, 5)], 0)  # the batch runs again
    assert statuses(spark, planned) == {"x": "failed", "y": "copied", "z": "pending"}
    # A late report of an earlier try does not undo a later one.
    assert tell([("/A/x.t", "copied", None, 3, 2), ("/A/y.t", "failed", "EIO", 2, 4)], 1)
    assert tell([("/A/z.t", "skipped-exists", None, None, 1)], 0, "other")
    assert statuses(spark, planned) == {"x": "copied", "y": "copied", "z": "skipped-exists"}
    assert plan_store.current_version(spark, planned) == before
    stored = len(list((folder / "plan" / "tables").iterdir()))
    version = plan_store.compact_plan(spark, planned)
    assert version == plan_store.current_version(spark, planned) != before
    assert plan_store.compact_plan(spark, planned) is None
    assert len(list((folder / "plan" / "tables").iterdir())) == stored + 1
    # Told outcomes are part of the version: a reset is not undone by them, only by new ones.
    plan = plan_store.load_plan(spark, planned)
    plan_store.write_plan(spark, edit.plan_reset(plan.entries), plan.header, planned, plan)
    assert set(statuses(spark, planned).values()) == {"pending"}
    tell([("/A/y.t", "copied", None, 9, 1)], 2)
    assert statuses(spark, planned) == {"x": "pending", "y": "copied", "z": "pending"}


def test_an_edit_keeps_outcomes_told_while_it_was_made(spark, planned, make):
    plan = plan_store.load_plan(spark, planned)
    plan_store.tell_outcomes(spark, planned, make([("/A/x.t", "copied", None, 1, 1)], OUTCOME), ["seq"], 0)
    kept = edit.plan_remove(plan.entries, make([("/A/y.t",)], "src_path string"))
    plan_store.write_plan(spark, kept, plan.header, planned, plan)
    assert statuses(spark, planned) == {"x": "copied", "z": "pending"}


def test_stored_scan(spark, folder, make):
    path, now = str(folder / "scan"), 1_705_320_000_000
    files = make([(f"/Volumes/A/{n}", n) for n in range(5)], "path string, size long")
    scan_store.write_scan(spark, path, None, files, {"root": "/Volumes/A", "fileCount": 5, "totalBytes": 10})
    trashed = make([("/Volumes/A/1",), ("/Volumes/A/2",), ("/Volumes/B/9",)], "path string")
    scan_store.log_trashed(spark, path, trashed, "2024-01-15T00:00:00Z", ["path"])
    scan_store.log_trashed(spark, path, make([("/Volumes/A/1",), ("/old",)], "path string"), "2020-01-01T00:00:00Z", ["path"])
    stale = scan_store.read_scan(spark, path)
    assert scan_store.set_scan_retention(spark, path, "30d").log.retention == "30d"
    with pytest.raises(versions.StaleVersion):
        scan_store.write_scan(spark, path, stale, header={})
    live, mounts = make([("/Volumes/A/1",), ("/Volumes/A/3",)], "path string"), make([("/Volumes/A",)], "path string")
    scan, report = scan_store.reconcile_scan(spark, path, live, mounts, now)
    assert report == {"checked": 3, "restored": 1, "restored_acked": 0, "retention_pruned": 1, "still_pending": 1, "removed": 1}
    assert scan.header == {"root": "/Volumes/A", "fileCount": 4, "totalBytes": 8}
    assert sorted(r.path for r in scan.records.collect()) == [f"/Volumes/A/{n}" for n in (0, 1, 3, 4)]
    assert {(r.path, r.status) for r in scan.log.entries.collect()} == {("/Volumes/A/1", "restored"), ("/Volumes/B/9", "trashed")}
    old = scan.version.content["records"]
    scan, report = scan_store.reconcile_scan(spark, path, live, mounts, now)
    assert report["restored_acked"] == 1 and report["removed"] == 0 and scan.version.content["records"] == old
    assert scan_store.set_scan_retention(spark, path, None).log.retention is None
    assert versions.latest(spark, path).number == 7
    with pytest.raises(FileNotFoundError):
        scan_store.read_scan(spark, str(folder / "none"))


def test_plan_catalog_shows_stored_plans(spark, folder):
    entries, header = edit.working_plan(spark)
    for name in ("one", "two", "three"):
        plan_store.write_plan(spark, entries, {**header, "name": name}, str(folder / "plans" / ("b" if name == "two" else "a")))
    (folder / "plans" / "c.plan.json").write_text(json.dumps({"name": "old"}))
    rows = catalogs.plan_catalog(spark, str(folder / "plans")).collect()
    assert {r.file: r.header.name for r in rows} == {"a": "three", "b": "two", "c.plan.json": "old"}
    assert all(r.header.layout == "mirrored" for r in rows if r.file != "c.plan.json")
    (folder / "empty").mkdir()
    assert catalogs.plan_catalog(spark, str(folder / "empty")).count() == 0


def test_stored_plan_is_compressed_and_keeps_its_order(spark, folder):
    paths = spark.range(0, 4000, 1, 3).selectExpr("concat('/Volumes/D0/orders/o', id, '/part.jpg') as src_path", "'D0' as drive_name")
    entries = edit.manual_entry(paths)
    plan_store.write_plan(spark, entries, {"id": "p"}, str(folder / "plan"))
    stored = sum(f.stat().st_size for f in (folder / "plan" / "tables").rglob("part-*"))
    assert stored * 4 < sum(len(line) for line in entries.toJSON().collect())
    back = [r.src_path for r in plan_store.read_plan(spark, str(folder / "plan"))[0].orderBy("ord").collect()]
    assert back == [f"/Volumes/D0/orders/o{i}/part.jpg" for i in range(4000)]
