"""Queries over the order of a run, its destinations, drives known by id, rule settings, and plans begun empty."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from registered.base import query, using
from registered.plans import ENTRIES, entries_of
from stowage.functions.names import utf16_length
from stowage.inventory_views import view
from stowage.operators import projects
from stowage.operators.rules import ProjectSettings, Rule
from stowage.operators.skew import running_count
from stowage.plans import build, edit, preflight
from stowage.session import materialize, work_dir
from stowage.sources import plan_store


@query("run_order", using("files_li", """
select src_path, min(src_path) over (partition by drive_name) as group_ord,
  row_number() over (partition by drive_name order by src_path) as place from entries""", entries=ENTRIES))
def _(spark, sf_dir):
    # Stored, as the drives, the bounds of the ranges and the ranges are each made of it.
    entries = materialize(entries_of(spark, sf_dir).select("src_path", "volume_uuid", "drive_name"), "entries")
    ordered = preflight.in_run_order(entries, "src_path")
    return running_count(ordered, "group_ord", ["src_path"], F.lit(True), "place").select(
        "src_path", "group_ord", F.col("place").cast("long").alias("place"))


# Names of hexadecimal digits, which every collation sorts alike.
@query("copy_order", using("files_li", """
select drive_name, md5(src_path) as src_path, row_number() over (partition by drive_name order by md5(src_path)) as place
from entries""", entries=ENTRIES))
def _(spark, sf_dir):
    entries = entries_of(spark, sf_dir).withColumn("src_path", F.md5("src_path"))
    placed = materialize(build.with_position(build.in_copy_order(entries)))
    # Positions of a whole plan: a drive's entries follow one another, so a place counts from the drive's first.
    return running_count(placed, "drive_name", ["ord"], F.lit(True), "place").select(
        "drive_name", "src_path", F.col("place").cast("long").alias("place"))


_DESTINATIONS = """select distinct substring(path, 1, length(path) - length(name) - 1) as path from files_li
union all select distinct substring(path, 1, length(path) - length(name)) || 'new/' from files_li
union all select * from (values ('/'), (''), (cast(null as varchar)))"""


@query("refused_destinations", using("files_li", """
select path, case when coalesce(path, '') = '' then 'no destination' when path = '/' then 'destination is the root'
  when starts_with(path || '/', '/Volumes/D2/') then 'destination is protected'
  when path not like '%/new/' then 'destination is not empty' end as why
from destinations""", destinations=_DESTINATIONS))
def _(spark, sf_dir):
    files = view(spark, sf_dir, "files_li")
    wanted = spark.sql(_DESTINATIONS.replace("from files_li", "from {files}").replace("varchar", "string"), files=files)
    return preflight.refused_destinations(wanted, ["/Volumes/D2/"], "fresh", files).select("path", "why")


_PICKED = """select '/picked/' || event_id || '.bin' as src_path, case event_id % 3 when 0 then drive_name when 1 then '' end as drive_name,
  case when event_id % 2 = 0 then 'f' || event_id end as name, size from outcomes_ev"""


@query("mirrored_paths", using("outcomes_ev", """
select src_path, '/Backup/' || coalesce(nullif(drive_name, ''), 'unknown_drive') || '/' ||
  coalesce(name, substring(src_path, 9)) as dst_path from picked""", picked=_PICKED))
def _(spark, sf_dir):
    picked = spark.sql(_PICKED.replace("from outcomes_ev", "from {events}"), events=view(spark, sf_dir, "outcomes_ev"))
    return preflight.resolve_destinations(
        edit.manual_entry(picked), "/Backup/", "mirrored", picked.select(F.col("src_path").alias("path")).limit(0),
        "src_path").select("src_path", "dst_path")


_IDS = """select * replace (case drive_name when 'D0' then 'AAAA-0' when 'D1' then '' when 'D3' then 'BBBB-3' end as volume_uuid)
from (select *, cast(null as varchar) as volume_uuid from entries)"""
_ID_MOUNTS = """select '/Volumes/M' || r_regionkey as path,
  case r_regionkey when 0 then 'D0' when 1 then 'other' when 2 then 'D1' when 3 then 'd3' else 'D33' end as name,
  case r_regionkey when 1 then 'aaaa-0' when 3 then 'zzzz' end as uuid, r_regionkey as ord from region"""
_ID_GROUPS = """select case when coalesce(volume_uuid, '') <> '' then volume_uuid else 'name:' || drive_name end as group_key,
  nullif(volume_uuid, '') as uuid, drive_name, count(*) as files, cast(sum(size) as bigint) as bytes
from ids where status = 'pending' group by all"""


def _grouped(spark, sf_dir):
    known = F.when(F.col("drive_name") == "D0", "AAAA-0").when(F.col("drive_name") == "D1", "").when(
        F.col("drive_name") == "D3", "BBBB-3")
    return preflight.drive_groups(entries_of(spark, sf_dir).withColumn("volume_uuid", known), "src_path")


@query("drive_groups_by_id", using("files_li", "select * from id_groups", entries=ENTRIES, ids=_IDS, id_groups=_ID_GROUPS))
def _(spark, sf_dir):
    return _grouped(spark, sf_dir).select("group_key", "uuid", "drive_name", "files", "bytes")


@query("match_mounts_by_id", using("files_li", """
select group_key, t.tier, t.path as mount_path, t.name as mount_name, t.path is null as needs_swap
from id_groups g left join (
  select *, row_number() over (partition by k order by tier, ord) as rn from (
    select g.group_key as k, m.*, case when lower(m.uuid) = lower(g.uuid) then 1 when m.name = g.drive_name then 2
      when lower(m.name) = lower(g.drive_name) then 3 end as tier from id_groups g, mounts m) where tier is not null) t
  on t.k = group_key and t.rn = 1""", entries=ENTRIES, ids=_IDS, id_groups=_ID_GROUPS, mounts=_ID_MOUNTS))
def _(spark, sf_dir):
    region = spark.read.parquet(f"{sf_dir}/region.parquet")
    mounts = spark.sql(_ID_MOUNTS.replace("from region", "from {region}"), region=region)
    return preflight.match_mounts(_grouped(spark, sf_dir), mounts).select(
        "group_key", "tier", "mount_path", "mount_name", "needs_swap")


# One folder per part with what marks a project of each built-in rule, and two that mark none.
_MARKERS = {
    "Git repo": [".git/HEAD"], "Node project": ["package.json", "yarn.lock", "pnpm-lock.yaml"],
    "Xcode project": ["App.xcodeproj/project", "App.xcworkspace/contents"], "Rust project": ["Cargo.toml"],
    "Python project": ["pyproject.toml", "setup.py", "Pipfile", "requirements.txt"], "Ableton session": ["Song.als"],
    "Video project": ["cut.prproj", "comp.aep", "film.fcpxbundle/data", "film.fcpxml"], None: ["notes.txt", "target/Cargo.toml"],
}
_MARKED = [(rule, path) for rule, paths in _MARKERS.items() for path in paths]
_CASES = " ".join(f"when {i} then '{path}'" for i, (_, path) in enumerate(_MARKED))
_RULES = " ".join(f"when {i} then {f"'{rule}'" if rule else 'null'}" for i, (rule, _) in enumerate(_MARKED))


def _marked_files(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    picked = F.col("p_partkey") % (len(_MARKED) + 1)
    shots = F.transform(F.sequence(F.lit(1), F.lit(29) + (F.col("p_partkey") % 2).cast("int")),
                        lambda i: F.concat(F.lit("IMG_"), i.cast("string"), F.lit(".jpg")))
    inside = F.when(picked == len(_MARKED), shots).otherwise(F.array(F.expr(
        f"case p_partkey % {len(_MARKED) + 1} {_CASES} end")))
    return part.select(
        F.lit(0).alias("scan_order"), F.lit("D0").alias("drive_name"), F.lit("/Volumes/D0/all").alias("root"),
        F.col("p_size").cast("long").alias("size"), F.concat(F.lit("/Volumes/D0/all/p"), F.col("p_partkey")).alias("at"),
        F.explode(inside).alias("below")).withColumn("path", F.concat_ws("/", "at", "below")).drop("at", "below")


@query("detect_every_builtin_rule", f"""
select folder, rule_name, files as file_count from (
  select '/Volumes/D0/all/p' || p_partkey as folder, case when p_partkey % {len(_MARKED) + 1} < {len(_MARKED)} then 1
      else 29 + p_partkey % 2 end as files,
    case p_partkey % {len(_MARKED) + 1} {_RULES} else case when p_partkey % 2 = 1 then 'Photo shoot' end end as rule_name
  from part) where rule_name is not null""")
def _(spark, sf_dir):
    own = materialize(projects.own_folders(_marked_files(spark, sf_dir), ProjectSettings().rules, "path"))
    found = projects.detect_projects(own, ProjectSettings())
    return found.select("folder", "rule_name", "file_count")


# What a build states replaces what is stored; what it leaves open does not.
_STORED = ProjectSettings(rules=(Rule.from_json({"id": "rust", "expr": {"op": "file", "glob": "Cargo.toml"}}),), opaque=("dist",))
_STATED = [{"id": "notes", "name": "Notes", "expr": {"op": "or", "items": [
    {"op": "file", "glob": "notes.*"}, {"op": "and", "items": [
        {"op": "count", "glob": "*.jpg", "min": 30}, {"op": "not", "expr": {"op": "name", "glob": "p1*"}}]}]}},
           {"id": "broken", "expr": {"op": "unheard-of"}}]


@query("detect_overridden_rules", f"""
select 'stored' as settings, '/Volumes/D0/all/p' || p_partkey || case p_partkey % {len(_MARKED) + 1}
    when {len(_MARKED) - 1} then '/target' else '' end as folder, 'rust' as rule_name
from part where p_partkey % {len(_MARKED) + 1} in ({[p for _, p in _MARKED].index('Cargo.toml')}, {len(_MARKED) - 1})
union all select 'stated', '/Volumes/D0/all/p' || p_partkey, 'Notes' from part
where p_partkey % {len(_MARKED) + 1} = {[p for _, p in _MARKED].index('notes.txt')}
  or p_partkey % {len(_MARKED) + 1} = {len(_MARKED)} and p_partkey % 2 = 1 and p_partkey::varchar not like '1%'""")
def _(spark, sf_dir):
    files = _marked_files(spark, sf_dir)
    stated = _STORED.override(rules=tuple(map(Rule.from_json, _STATED)), opaque=None, threshold=None)

    def found(label, settings):
        own = materialize(projects.own_folders(files, settings.rules, "path"))
        return projects.detect_projects(own, settings).select(F.lit(label).alias("settings"), "folder", "rule_name")

    return found("stored", _STORED).unionByName(found("stated", stated))


@query("plan_begun_empty", using("outcomes_ev", """
select count(*) as entries, cast(sum(size) as bigint) as bytes, 0 as left_after_clear, '/Volumes/Backup' as destination,
  'flat' as layout, 'newest' as tie_break, 'additive' as dest_mode, 'Working plan' as name
from (select size, row_number() over (partition by src_path order by event_id) as rn from outcomes_ev) where rn = 1"""))
def _(spark, sf_dir):
    entries, header = edit.working_plan(spark)
    added = edit.plan_add(entries, view(spark, sf_dir, "outcomes_ev"), ["event_id"])
    header = edit.plan_update_settings(header, destination="/Volumes/Backup", layout="flat", tieBreak="newest", name=None)
    folder = f"{work_dir(spark)}/stowage/plan-{uuid.uuid4().hex}"
    plan_store.write_plan(spark, added.entries, header, folder)
    stored, kept = plan_store.read_plan(spark, folder)
    cleared = edit.plan_clear(stored).count()
    told = {"destination": "destination", "layout": "layout", "tie_break": "tieBreak", "dest_mode": "destMode", "name": "name"}
    return stored.agg(F.count("*").alias("entries"), F.sum("size").alias("bytes")).withColumns({
        "left_after_clear": F.lit(cleared), **{column: F.lit(kept[key]) for column, key in told.items()}})


@query("utf16_lengths", using("outcomes_ev", """
select src_path, cast(length(src_path) + 2 * (event_id % 3) + event_id % 2 as int) as length
from outcomes_ev"""))
def _(spark, sf_dir):
    # A clef is two units, an accented letter one.
    named = F.concat("src_path", F.repeat(F.lit("\U0001d11e"), (F.col("event_id") % 3).cast("int")),
                     F.repeat(F.lit("é"), (F.col("event_id") % 2).cast("int")))
    return view(spark, sf_dir, "outcomes_ev").select("src_path", utf16_length(named).cast("int").alias("length"))
