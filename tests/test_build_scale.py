"""What a plan build sorts, shuffles and looks up."""

from pyspark.sql import functions as F

from stowage.functions.globs import glob_in_path, glob_match
from stowage.operators import projects, similarity
from stowage.operators.rules import ProjectSettings, Rule, name
from stowage.plans.build import PlanOptions, build_plan
from stowage.session import materialize
from trees import tree

SETTINGS = ProjectSettings(rules=(Rule("p", "P", "", name("p*")),))


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]


def test_folders_are_grouped_without_a_sort(spark):
    paths = [f"/Volumes/D/p{k}/{sub}same_start_{n:02d}.txt" for k in range(2) for sub in ("", "in/") for n in (7, 3, 5)]
    files = materialize(tree(spark, paths + ["/Volumes/D/p1/é.txt", "/Volumes/D/q/a.txt"]))
    own = projects.own_folders(files, SETTINGS.rules, "path", exact=False)
    assert "Sort" not in planned(own) and "first_ord" not in own.columns
    own = materialize(own)
    found = materialize(projects.detect_projects(own, SETTINGS))
    tagged, loose = projects.split_files(files, projects.folder_projects(own, found), "path", unused=("name", "mtime"))
    assert tagged.filter("_first").count() < tagged.count() and tagged.filter("name is not null").count() == 0
    assert [r.path for r in loose.select("path", "name").filter("name = 'a.txt'").collect()] == ["/Volumes/D/q/a.txt"]
    got = {r.folder: r.first_ord for r in projects.first_seen(found, tagged, "path").collect()}
    exact = projects.detect_projects(materialize(projects.own_folders(files, SETTINGS.rules, "path")), SETTINGS)
    assert got == {r.folder: r.first_ord for r in exact.collect()} == {
        f"/Volumes/D/p{k}": f"/Volumes/D/p{k}/in/same_start_03.txt" for k in range(2)}


def test_values_are_stored_apart_without_a_sort(spark):
    # Spark's own setting is as it was before.
    many = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(many)
    rows = spark.range(0, 1000, 1, 1).withColumn("part", F.col("id") % 2)
    stored = materialize(rows, "apart", "part")
    assert stored.filter("part = 1").agg(F.sum("id")).first()[0] == 250_000
    # Of one task's rows those of a value stand in the order in which they came.
    assert [r.id for r in stored.filter("part = 0").limit(3).collect()] == [0, 2, 4]
    assert spark.conf.get(many) == before


def test_paths_that_projects_of_other_scans_claim(spark):
    fields = "scan_order int, drive_name string, root string, name string, path string, size long, mtime long, ext string, ord long"
    inside = ["/V/a/p1/x.txt", "/V/a/p1/y.txt"]
    rows = [(0, "A", "/V/a", p[-5:], p, 1, 0, "txt", n) for n, p in enumerate(inside)]
    # The second scan begins inside that project: its root is no project, so its files are loose there.
    rows += [(1, "B", "/V/a/p1", p[-5:], p, 1, 0, "txt", n) for n, p in enumerate([inside[0], "/V/a/p1/z.txt", "/V/a/p1/s/x.txt"])]
    plan = build_plan(spark.createDataFrame(rows, fields), PlanOptions(projects=SETTINGS))
    got = sorted((r.src_path, r.drive_name, r.status) for r in plan.entries.collect())
    assert got == [("/V/a/p1/s/x.txt", "B", "pending"), ("/V/a/p1/x.txt", "A", "pending"), ("/V/a/p1/y.txt", "A", "pending"),
                   ("/V/a/p1/z.txt", "B", "pending")]


def test_items_are_folded_as_texts(make):
    items = materialize(make([(p, i) for p, own in {"a": "xyz", "b": "xy", "c": "z"}.items() for i in own], "project_key string, item string"))
    got = {(r.project_key, r.weight) for r in similarity.folded(items).collect()}
    assert got == {("a", 2), ("a", 1), ("b", 2), ("c", 1)}
    assert not similarity.folded(items).filter("repeats").count()
    twice = similarity.folded(items.unionByName(make([("b", "y")], "project_key string, item string")))
    assert {r.project_key for r in twice.filter("repeats").collect()} == {"b"}


def test_globs_ignore_case_in_what_they_spell_out(make):
    df = make([("PHOTO.JpG",), ("photo.jpeg",), ("a/photo.jpg",), ("É.JPG",), ("x.png",)], "n string")
    assert [r[0] for r in df.filter(glob_match("n", "*.{jpg, jpeg}")).collect()] == ["PHOTO.JpG", "photo.jpeg", "É.JPG"]
    assert [r[0] for r in df.filter(glob_match("n", "é.?pg")).collect()] == ["É.JPG"]
    # A wildcard that ignores case folds every character it passes.
    assert "(?iu:" in glob_in_path("p*") and glob_in_path("p*").count("(?iu:[^/]") == 0
