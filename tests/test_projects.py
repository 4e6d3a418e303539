import random
import re

import pytest

from stowage.operators import projects as P
from stowage.operators.rules import (
    BUILTIN_RULES, OPAQUE_NAMES, ProjectSettings, Rule, all_, any_, count, depth, dir, file, name, not_,
)
from stowage.plans.build import PlanOptions, build_plan
from trees import tree


def detect(files, settings=ProjectSettings()):
    found = P.detect_projects(P.own_folders(files, settings.rules), settings).collect()
    return {r.folder: r for r in found}


def test_builtin_rules(spark):
    files = tree(spark, [
        "/Volumes/D/repo/.git/HEAD", "/Volumes/D/repo/src/package.json",
        "/Volumes/D/web/package.json", "/Volumes/D/web/node_modules/left/package.json",
        "/Volumes/D/app/App.xcodeproj/p", "/Volumes/D/rs/Cargo.toml", "/Volumes/D/py/setup.py",
        "/Volumes/D/song/x/y.ALS", "/Volumes/D/film/cut.prproj", "/Volumes/D/loose.txt",
    ] + [f"/Volumes/D/trip/day/{i}.nef" for i in range(30)])
    got = {f: r.rule_id for f, r in detect(files).items()}
    assert got == {
        "/Volumes/D/repo": "git", "/Volumes/D/web": "node", "/Volumes/D/app": "xcode", "/Volumes/D/rs": "rust",
        "/Volumes/D/py": "python", "/Volumes/D/song": "ableton", "/Volumes/D/film": "video", "/Volumes/D/trip": "photoshoot"}


def test_nested_and_opaque(spark):
    files = tree(spark, [
        "/Volumes/D/a/package.json", "/Volumes/D/a/lib/Cargo.toml", "/Volumes/D/a/node_modules/m/package.json",
        ("/Volumes/D/a/lib/build/out.bin", 50)])
    assert set(detect(files)) == {"/Volumes/D/a"}
    nested = detect(files, ProjectSettings(detect_nested=True))
    assert set(nested) == {"/Volumes/D/a", "/Volumes/D/a/lib"}
    assert (nested["/Volumes/D/a"].file_count, nested["/Volumes/D/a"].total_bytes) == (4, 53)


def test_root_is_never_a_project_and_opaque_root_hides_all(spark):
    assert detect(tree(spark, ["/Volumes/D/package.json"])) == {}
    assert detect(tree(spark, ["/Volumes/build/x/package.json"], root="/Volumes/build")) == {}
    assert set(detect(tree(spark, ["/x/package.json"], root="/"))) == {"/x"}


def test_rule_edges(spark):
    files = tree(spark, ["/Volumes/D/p/a.txt"])
    cases = {"zero": count("*.txt", 0), "none": count("*.zip", 0), "empty_and": all_(), "empty_or": any_(),
             "unknown": {"op": "what"}, "missing": None, "not_missing": not_({"op": "what"}), "deep": depth(4)}
    hit = {k for k, e in cases.items() if detect(files, ProjectSettings(rules=(Rule(k, k, "", e),)))}
    assert hit == {"zero", "empty_and", "not_missing"}


RULES = (
    Rule("one", "One", "", all_(file("*.a"), not_(name("x*")))), Rule("two", "Two", "", any_(dir("y?"), count("*.b", 4))),
    Rule("three", "Three", "", all_(depth(4), count("*.{c,d}", 2))))


def model(paths, root, rules, opaque, nested):
    """Rule matching on plain Python sets, written from the description of the operators."""
    folders = {}
    for path in paths:
        parts = path[len(root) + 1:].split("/")
        for i in range(len(parts)):
            at = "/".join([root] + parts[:i])
            entry = folders.setdefault(at, {"files": [], "dirs": set(), "below": []})
            entry["below"].append(path)
            (entry["dirs"].add(parts[i]) if i < len(parts) - 1 else entry["files"].append(parts[i]))

    def like(text, glob):
        pattern = "".join({"*": "[^/]*", "?": "[^/]", "{": "(?:", "}": ")", ",": "|"}.get(c, re.escape(c)) for c in glob)
        return re.fullmatch(pattern, text, re.I) is not None

    def holds(e, at):
        entry, op = folders[at], e["op"]
        if op in ("and", "or"):
            return (all if op == "and" else any)(holds(x, at) for x in e["items"])
        if op == "not":
            return not holds(e["expr"], at)
        if op == "depth":
            return at.count("/") >= e["min"]
        if op == "name":
            return like(at.rsplit("/", 1)[1], e["glob"])
        if op == "count":
            return sum(like(p.rsplit("/", 1)[1], e["glob"]) for p in entry["below"]) >= e["min"]
        return any(like(x, e["glob"]) for x in entry["files" if op == "file" else "dirs"])

    hits = {}
    for at in folders:
        if at == root or set(at.split("/")) & set(opaque):
            continue
        rule = next((r.id for r in rules if holds(r.expr, at)), None)
        if rule:
            hits[at] = (rule, len(folders[at]["below"]))
    return {a: h for a, h in hits.items() if nested or not any(a.startswith(b + "/") for b in hits)}


@pytest.mark.parametrize("seed,nested", [(1, False), (2, True), (3, False)])
def test_against_model(spark, seed, nested):
    rng = random.Random(seed)
    paths = set()
    while len(paths) < 120:
        parts = [rng.choice(["x1", "y1", "p", "q", "dist", "yy"]) for _ in range(rng.randint(0, 4))]
        paths.add("/".join(["/Volumes/D"] + parts + [f"f{rng.randint(0, 9)}.{rng.choice('abcd')}"]))
    paths = sorted(paths)
    got = detect(tree(spark, paths).repartition(3), ProjectSettings(rules=RULES, detect_nested=nested))
    assert {k: (r.rule_id, r.file_count) for k, r in got.items()} == model(paths, "/Volumes/D", RULES, OPAQUE_NAMES, nested)


def test_plan_accounts_for_every_file(spark):
    def drive(n, extra):
        base = f"/Volumes/D{n}"
        paths = [(f"{base}/code/app/f{i}.c", i) for i in range(20)] + [(f"{base}/code/app/package.json", 3)]
        return tree(spark, paths + [(f"{base}/{p}", s) for p, s in extra], n, f"D{n}", base)
    a = drive(0, [("pics/a.jpg", 5), ("pics/b.jpg", 6)])
    b = drive(1, [("old/a.jpg", 5), ("code/app/more.c", 9)])
    errors = spark.createDataFrame([("/Volumes/D1/locked", "D1", "EACCES")], "path string, drive_name string, error string")
    for nested in (None, 10):
        plan = build_plan(a.unionByName(b), PlanOptions(destination="/B"), errors=errors)
        rows = {r.src_path: r for r in plan.entries.collect()}
        assert len(rows) == 47
        assert rows["/Volumes/D0/code/app/f3.c"].status == "pending"
        assert rows["/Volumes/D0/code/app/f3.c"].dst_rel_path == "D0/code/app/f3.c"
        lost = rows["/Volumes/D1/code/app/more.c"]
        assert (lost.status, lost.winner_project_root, lost.winner_drive) == (
            "skipped-project-duplicate", "/Volumes/D0/code/app", "D0")
        assert rows["/Volumes/D1/old/a.jpg"].winner_path == "/Volumes/D0/pics/a.jpg"
        assert rows["/Volumes/D1/locked"].status == "source-error"
        head = plan.header("p")
        assert (head["totalFiles"], head["duplicatesCollapsed"], head["projectDuplicatesCollapsed"], head["errorCount"]) == (23, 1, 22, 1)
        assert head["projectDedup"]["byRule"] == {"Node project": {"kept": 1, "collapsed": 1}}


def test_settings_override():
    stored = ProjectSettings(threshold=0.0)
    assert stored.effective_threshold == 0.9
    assert stored.override(detect_nested=True, rules=None).rules == BUILTIN_RULES
    assert Rule.from_json({"id": "x", "expr": {"op": "file", "glob": "*"}}).name == "x"


def test_names_leave_folders_out_of_detection(spark):
    paths = [f"/v/{top}/{name}/img/{i}.jpg" for top in "ab" for name in ("p1", "q1") for i in range(3)]
    rules = (Rule("p", "P", "", all_(name("P*"), count("*.jpg", 2))), Rule("x", "X", "", all_(not_(name("*")), file("*.jpg"))))
    files = tree(spark, paths, root="/v")
    own = P.own_folders(files, rules, everywhere=False)
    assert {r.folder for r in own.collect()} == {"/v/a/p1/img", "/v/b/p1/img"}
    settings = ProjectSettings(rules=rules)
    assert sorted(map(tuple, P.detect_projects(own, settings).collect())) == sorted(
        map(tuple, P.detect_projects(P.own_folders(files, rules), settings).collect()))
    assert P.own_folders(files, (), everywhere=False).count() == 0 and P.own_folders(files, ()).count() == 4
    assert P.own_folders(files, (Rule("f", "F", "", file("*.jpg")),), everywhere=False).count() == 4


def test_names_are_judged_by_whole_folder_names(spark):
    paths = ["/v/pics/x/1.jpg", "/v/my pics/1.jpg", "/v/a/PICS.old/2.jpg", "/v/b/pics", "/v/c/d/1.jpg", "/v/1.jpg"]
    files = tree(spark, paths, root="/v")

    def held(expr):
        return {r.folder for r in P.own_folders(files, (Rule("r", "R", "", expr),), everywhere=False).collect()}

    assert held(name("pics")) == {"/v/pics/x"}
    assert held(any_(name("pics*"), all_(name("?"), not_(name("[abc]")), not_(name("b"))))) == {"/v/pics/x", "/v/a/PICS.old", "/v/c/d"}
    assert held(not_(name("b"))) == {"/v/pics/x", "/v/my pics", "/v/a/PICS.old", "/v/c/d"}
    assert held(name("c/d")) == set() and held(not_(name("c/d"))) == {"/v/pics/x", "/v/my pics", "/v/a/PICS.old", "/v/b", "/v/c/d"}


def test_split_files_stores_no_part_of_a_path_twice(spark):
    files = tree(spark, ["/v/p/a/1.jpg", "/v/p/a/2.jpg", "/v/q/3.jpg"], root="/v")
    own = P.own_folders(files, (Rule("p", "P", "", name("p")),))
    found = P.detect_projects(own, ProjectSettings(rules=(Rule("p", "P", "", name("p")),)))
    inside, loose = P.split_files(files, P.folder_projects(own, found))
    assert set(inside.columns) == {*files.columns, "project_key", "project_folder"} and loose.columns == files.columns
    assert {r.path for r in inside.collect()} == {"/v/p/a/1.jpg", "/v/p/a/2.jpg"} and [r.path for r in loose.collect()] == ["/v/q/3.jpg"]
    assert all(name.endswith(".zstd.parquet") for name in inside.inputFiles())
