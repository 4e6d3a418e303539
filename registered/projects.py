"""Queries over folder trees: roll-up, project detection, similarity, groups, plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from registered.base import query, using
from stowage.inventory_views import view
from stowage.operators import projects, reports, similarity
from stowage.operators.rules import ProjectSettings, Rule, all_, any_, count, depth, dir, file, name, not_
from stowage.plans import build
from stowage.session import materialize
from stowage.sources.inventory import ScanSource

SEEN = ("scan_order", "path")
FOLDERS = (Rule("photos", "Photos", "teal", all_(name("p*"), count("*.jpg", 10))),)
SETTINGS = ProjectSettings(rules=FOLDERS)

# One row per (file, folder above it), the scan root included as level 0.
ABOVE = """select f.*, g.i as level, case when g.i = 0 then root else
  root || '/' || array_to_string(string_split(substring(path, length(root) + 2), '/')[1:g.i], '/') end as folder,
  string_split(substring(path, length(root) + 2), '/') as segs
  from {source} f, generate_series(0, len(string_split(substring(path, length(root) + 2), '/')) - 1) as g(i)"""


def _tree(source: str) -> str:
    return ABOVE.format(source=source)


def _detect(files, settings):
    own = materialize(projects.own_folders(files, settings.rules, "path", everywhere=False))
    return own, projects.detect_projects(own, settings)


@query("folder_rollup", using("files_li", """
select scan_order, folder, count(*) as file_count, cast(sum(size) as bigint) as total_bytes,
  count(*) filter (len(segs) = level + 1) as own_files,
  cast(len(list_filter(string_split(folder, '/'), lambda x: x <> '')) as int) as depth
from tree group by scan_order, folder""", tree=_tree("files_li")))
def _(spark, sf_dir):
    rolled = projects.folder_rollup(projects.own_folders(view(spark, sf_dir, "files_li"), (), "path"))
    return rolled.select("scan_order", "folder", "file_count", "total_bytes", "own_files", "depth")


_MIXED = (
    Rule("src", "With source", "blue", all_(dir("src"), not_(name("work")))),
    Rule("pics", "Pictures", "teal", all_(count("*.{jpg,png}", 12), depth(5))),
    Rule("leaf", "Has a film", "red", any_(file("part_1*.mp4"), name("nothing"))),
)

_MIXED_SQL = """
select scan_order, folder, rule_id, file_count, total_bytes from (
  select scan_order, folder, count(*) as file_count, cast(sum(size) as bigint) as total_bytes,
    case when bool_or(level + 1 < len(segs) and segs[level + 1] = 'src') and not regexp_full_match(folder, '.*/work') then 'src'
         when count(*) filter (regexp_full_match(lower(name), '.*\\.(jpg|png)')) >= 12
              and len(list_filter(string_split(folder, '/'), lambda x: x <> '')) >= 5 then 'pics'
         when bool_or(level + 1 = len(segs) and regexp_full_match(lower(name), 'part_1.*\\.mp4')) then 'leaf' end as rule_id
  from tree where level > 0 group by scan_order, folder)
where rule_id is not null and not regexp_matches(folder || '/', '/node_modules/')"""


@query("match_folders_nested", using("files_proj", _MIXED_SQL, tree=_tree("files_proj")))
def _(spark, sf_dir):
    settings = ProjectSettings(rules=_MIXED, detect_nested=True)
    found = _detect(view(spark, sf_dir, "files_proj"), settings)[1]
    return found.select("scan_order", "folder", "rule_id", "file_count", "total_bytes")


@query("detect_projects_outermost", using("files_proj", """
select m.* from matches m where not exists (
  select 1 from matches o where o.scan_order = m.scan_order and starts_with(m.folder, o.folder || '/'))""",
    tree=_tree("files_proj"), matches=_MIXED_SQL))
def _(spark, sf_dir):
    found = _detect(view(spark, sf_dir, "files_proj"), ProjectSettings(rules=_MIXED))[1]
    return found.select("scan_order", "folder", "rule_id", "file_count", "total_bytes")


@query("detect_builtin_rules", using("files_proj", """
select scan_order, folder, 'Photo shoot' as rule_name, count(*) as file_count,
  cast(sum(size) as bigint) as total_bytes
from tree where level = 1 and folder like '%/work' group by scan_order, folder
having count(*) filter (ext = 'jpg') >= 30""", tree=_tree("files_proj")))
def _(spark, sf_dir):
    found = _detect(view(spark, sf_dir, "files_proj"), ProjectSettings())[1]
    return found.select("scan_order", "folder", "rule_name", "file_count", "total_bytes")


def _parts(spark, sf_dir, source="files_proj"):
    files = view(spark, sf_dir, source)
    own, found = _detect(files, SETTINGS)
    found = materialize(found)
    holders = materialize(projects.folder_projects(own, found))
    tagged = projects.tag_files(files, holders)
    # Repeats are kept as they come: the comparison counts them.
    items = projects.signature_items(tagged, SETTINGS.opaque, count_repeats=False)
    return files, found, tagged, items


PROJ = """select scan_order, drive_name, folder, count(*) as file_count, cast(sum(size) as bigint) as total_bytes,
  min(path) as first_path
  from tree where level = 2 and regexp_full_match(folder, '.*/work/p[^/]*')
  group by scan_order, drive_name, folder having count(*) filter (ext = 'jpg') >= 10"""
ITEMS = """select p.scan_order, p.folder, cast(floor(log2(p.file_count) + 0.5) as int) as bucket,
  substring(path, length(p.folder) + 2) || ':' || size as item
  from {source} f join proj p on f.scan_order = p.scan_order and starts_with(f.path, p.folder || '/')
  where not regexp_matches(f.path, '/node_modules/')"""
PAIRS = """select a.scan_order as a_scan, a.folder as a, b.scan_order as b_scan, b.folder as b,
  count(*) / cast(any_value(na.n) + any_value(nb.n) - count(*) as double) as similarity
  from items a join items b on a.item = b.item and a.bucket = b.bucket and a.folder < b.folder
  join sizes na on na.folder = a.folder join sizes nb on nb.folder = b.folder
  group by all having similarity >= 0.9"""
SIZES = "select folder, count(*) as n from items group by folder"


def steps(source: str, **more: str) -> dict[str, str]:
    return {"tree": _tree(source), "proj": PROJ, "items": ITEMS.format(source=source), "sizes": SIZES,
            "pairs": PAIRS, **more}


@query("project_files", using("files_proj", """
select p.folder as project_folder, f.path from files_proj f
join proj p on f.scan_order = p.scan_order and starts_with(f.path, p.folder || '/')""",
    tree=_tree("files_proj"), proj=PROJ))
def _(spark, sf_dir):
    return _parts(spark, sf_dir)[2].select("project_folder", "path")


@query("signature_items", using("files_proj", "select folder, item from items", tree=_tree("files_proj"), proj=PROJ,
                                items=ITEMS.format(source="files_proj")))
def _(spark, sf_dir):
    items = projects.signature_items(_parts(spark, sf_dir)[2], SETTINGS.opaque)
    return items.select(F.substring_index("project_key", "::", -1).alias("folder"), "item")


@query("similar_pairs", using("files_proj", "select a, b, similarity from pairs", **steps("files_proj")))
def _(spark, sf_dir):
    _, found, _, items = _parts(spark, sf_dir)
    pairs = similarity.similar_pairs(found, items, 0.9)
    return pairs.select(*[F.substring_index(c, "::", -1).alias(c) for c in ("a", "b")], "similarity")


# Transitive closure of the pairs; the smallest folder names the group.
GROUPS = {
    "links": "select a, b from pairs union all select b, a from pairs union all select folder, folder from proj",
    "reach": "select a, b from links union select r.a, l.b from reach r join links l on l.a = r.b",
    "comps": "select a as folder, min(b) as component from reach group by a",
}


@query("project_groups", using("files_proj", "select folder, component from comps", recursive=True,
                               **steps("files_proj", **GROUPS)))
def _(spark, sf_dir):
    _, found, _, items = _parts(spark, sf_dir)
    groups = similarity.similar_groups(found, items, 0.9)
    return groups.select(F.substring_index("project_key", "::", -1).alias("folder"),
                         F.substring_index("component", "::", -1).alias("component"))


# Classes of equal projects: the smallest folder stands for the class, links are counted for every member.
CLASSES = {
    "both_ways": "select a, b, similarity from pairs union all select b, a, similarity from pairs",
    "classes": """select p.folder, least(p.folder, coalesce(min(b) filter (similarity = 1), p.folder)) as class_folder,
  1 + count(b) filter (similarity = 1) as class_size, count(b) as n_links
  from proj p left join both_ways on a = p.folder group by p.folder""",
}


def _classes(spark, sf_dir, source):
    _, found, _, items = _parts(spark, sf_dir, source)
    return similarity.similar_classes(found, items, 0.9)


@query("similar_classes", using("files_ord", "select * from classes", **steps("files_ord", **CLASSES)))
def _(spark, sf_dir):
    members = _classes(spark, sf_dir, "files_ord")[0]
    return members.select(
        F.substring_index("project_key", "::", -1).alias("folder"),
        F.substring_index("class_key", "::", -1).alias("class_folder"), "class_size", "n_links")


@query("similar_class_pairs", using("files_ord", """
select a, b, similarity from pairs where similarity < 1
  and a in (select class_folder from classes) and b in (select class_folder from classes)""",
    **steps("files_ord", **CLASSES)))
def _(spark, sf_dir):
    pairs = _classes(spark, sf_dir, "files_ord")[1]
    return pairs.select(*[F.substring_index(c, "::", -1).alias(c) for c in ("a", "b")], "similarity")


@query("project_groups_shared_items", using("files_ord", "select folder, component from comps", recursive=True,
                                            **steps("files_ord", **GROUPS)))
def _(spark, sf_dir):
    _, found, _, items = _parts(spark, sf_dir, "files_ord")
    groups = similarity.similar_groups(found, items, 0.9)
    return groups.select(F.substring_index("project_key", "::", -1).alias("folder"),
                         F.substring_index("component", "::", -1).alias("component"))


_PROJECT_METRIC = {
    "firstScanned": "scan_order", "newest": "file_count + total_bytes desc", "oldest": "file_count + total_bytes",
    "shortestPath": "length(folder), folder", "largest": "total_bytes desc",
}


def chosen_sql(mode: str) -> str:
    return f"""select p.*, 'Photos' as rule_name, row_number() over w = 1 as is_winner,
  first_value(p.folder) over w as winner_root, first_value(p.drive_name) over w as winner_drive
  from proj p join comps c on c.folder = p.folder
  window w as (partition by c.component order by {_PROJECT_METRIC[mode].replace('folder', 'p.folder')},
               scan_order, first_path)"""


def _register_winners(suffix: str, mode: str):
    @query(f"project_winners_{suffix}", using(
        "files_proj", "select folder, is_winner, winner_root, winner_drive from chosen", recursive=True,
        **steps("files_proj", **GROUPS, chosen=chosen_sql(mode))))
    def run(spark, sf_dir):
        _, found, _, items = _parts(spark, sf_dir)
        chosen = build.choose_projects(found, similarity.similar_groups(found, items, 0.9), mode)
        return chosen.select("folder", "is_winner", "winner_root", "winner_drive")


for _suffix, _mode in (("first_scanned", "firstScanned"), ("newest", "newest"), ("oldest", "oldest"),
                       ("shortest_path", "shortestPath"), ("largest", "largest")):
    _register_winners(_suffix, _mode)


@query("rule_stats", using("files_proj", """
select rule_name, count(*) filter (is_winner) as kept, count(*) filter (not is_winner) as collapsed
from chosen group by rule_name""", recursive=True, **steps("files_proj", **GROUPS, chosen=chosen_sql("largest"))))
def _(spark, sf_dir):
    _, found, _, items = _parts(spark, sf_dir)
    return reports.rule_stats(build.choose_projects(found, similarity.similar_groups(found, items, 0.9), "largest"))


# ----------------------------------------------------------------- full plans

SOURCES = [ScanSource(f"c{i}.header.json", f"c{i}.ndjson", f"/Volumes/C{i}", f"C{i}", None, i) for i in range(3)] + [
    ScanSource(f"d{i}.header.json", f"d{i}.ndjson", f"/Volumes/D{i}", f"D{i}", None, i + 3) for i in range(4)]

_FILE_METRIC = {
    "firstScanned": "scan_order", "newest": "mtime desc, scan_order", "oldest": "mtime, scan_order",
    "shortestPath": "length(path), scan_order", "largest": "scan_order",
}


def plan_steps(mode: str, layout: str) -> dict[str, str]:
    def dst(nm):
        return nm if layout == "flat" else "drive_name || '/' || substring(path, length(root) + 2)"
    inside = "regexp_extract(f.path, '^/Volumes/C[0-9]/work/p[^/]*')"
    entries = f"""
select f.path as src_path, f.drive_name, case when c.is_winner then {dst("f.name").replace('drive_name', 'f.drive_name')
    .replace('(path', '(f.path').replace('(root', '(f.root')} end as dst_rel_path, f.size,
  cast(0 as bigint) as mtime, f.ext, 'project::' || c.drive_name || '::' || c.folder as dupe_key,
  case when c.is_winner then 'pending' else 'skipped-project-duplicate' end as status,
  cast(null as varchar) as winner_path, c.folder as project_root, c.rule_name as project_rule,
  case when not c.is_winner then c.winner_root end as winner_project_root,
  case when not c.is_winner then c.winner_drive end as winner_drive
from files_all f join chosen c on c.folder = {inside}
union all
select path, drive_name, case when rn = 1 then {dst("name")} end, size, mtime, ext,
  size || '::' || name || '::' || ext, case when rn = 1 then 'pending' else 'skipped-duplicate' end,
  case when rn > 1 then wp end, null, null, null, null
from (select *, row_number() over w as rn, first_value(path) over w as wp from files_all f
      where {inside} not in (select folder from proj)
      window w as (partition by size, name, ext order by {_FILE_METRIC[mode]}, path))"""
    return steps("files_all", **GROUPS, chosen=chosen_sql(mode), entries=entries)


PLAN_COLUMNS = ["src_path", "drive_name", "dst_rel_path", "size", "mtime", "ext", "dupe_key", "status", "winner_path",
                "project_root", "project_rule", "winner_project_root", "winner_drive"]


def make_plan(spark, sf_dir, mode, layout, sources=SOURCES) -> build.Plan:
    options = build.PlanOptions(destination="/Volumes/Backup", tie_break=mode, layout=layout, projects=SETTINGS, order=SEEN)
    return build.build_plan(view(spark, sf_dir, "files_all"), options, sources)


def _register_plan(suffix: str, mode: str, layout: str, sources):
    @query(f"build_plan_{suffix}", using("files_all", f"select {', '.join(PLAN_COLUMNS)} from entries",
                                         recursive=True, **plan_steps(mode, layout)))
    def run(spark, sf_dir):
        return make_plan(spark, sf_dir, mode, layout, sources).entries.select(*PLAN_COLUMNS)


_register_plan("mirrored_first_scanned", "firstScanned", "mirrored", SOURCES)
_register_plan("flat_newest", "newest", "flat", None)
_register_plan("mirrored_shortest_path", "shortestPath", "mirrored", SOURCES)
_register_plan("mirrored_oldest", "oldest", "mirrored", SOURCES)
_register_plan("mirrored_largest", "largest", "mirrored", SOURCES)


@query("plan_totals", using("files_all", """
select count(*) filter (status = 'pending') as total_files,
  cast(sum(size) filter (status = 'pending') as bigint) as total_bytes,
  count(*) filter (status = 'skipped-duplicate') as duplicates_collapsed,
  count(*) filter (status = 'skipped-project-duplicate') as project_duplicates_collapsed,
  count(*) filter (status = 'source-error') as error_count from entries""",
    recursive=True, **plan_steps("firstScanned", "mirrored")))
def _(spark, sf_dir):
    return reports.plan_totals(make_plan(spark, sf_dir, "firstScanned", "mirrored").entries)


@query("build_plan_without_projects", using("files_all", """
select path as src_path, case when rn = 1 then 'pending' else 'skipped-duplicate' end as status,
  case when rn > 1 then wp end as winner_path
from (select *, row_number() over w as rn, first_value(path) over w as wp from files_all
      window w as (partition by size, name, ext order by scan_order, path))"""))
def _(spark, sf_dir):
    options = build.PlanOptions(projects=ProjectSettings(enabled=False), order=SEEN)
    return build.build_plan(view(spark, sf_dir, "files_all"), options).entries.select("src_path", "status", "winner_path")
