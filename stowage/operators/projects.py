"""Folder roll-up, project detection and the files of each project."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.globs import FLAGS, glob_match
from stowage.functions.names import (
    at_depth, has_segment, open_ended, parent, rel_path, signature_item,
)
from stowage.operators.rules import ProjectSettings, could_be, first_match, leaf_facts
from stowage.operators.skew import join_keys
from stowage.session import materialize

SCAN = ["scan_order", "drive_name", "root"]
# When a folder or project was first seen.
_FIRST = ("first_ord",)
HAS_PATH = "path is not null and path <> ''"


def _located(files: DataFrame) -> DataFrame:
    """Files with their own folder (null without a path) and file name.

    Every path is clean (single slashes) and lies below its scan's root, as a
    scanner writes it. Folders are kept without a trailing slash, so the root
    of a file system is the empty string until the result is shown.
    """
    return files.select(
        *[c for c in files.columns if c not in ("root", "folder", "file_name")],
        open_ended("root").alias("root"), F.when(F.expr(HAS_PATH), parent("path")).alias("folder"),
        F.substring_index("path", "/", -1).alias("file_name"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.when(F.col(c) == "", F.lit("/")).otherwise(F.col(c)) for c in ("root", "folder")})


def _depth(folder) -> Column:
    return F.length(folder) - F.length(F.translate(folder, "/", ""))


def _above(folders: DataFrame, include_root: bool, include_self: bool) -> DataFrame:
    """Repeat each folder row per folder at or above it, down from the scan root.

    Adds ``at`` (that folder) and ``child`` (the name of the next folder on the
    way down, null at the folder itself).
    """
    own = _depth("folder")
    first = _depth(F.rtrim("root", F.lit("/"))) + (0 if include_root else 1)
    last = own - (0 if include_self else 1)
    repeated = folders.withColumn("_d", F.explode(F.when(first <= last, F.sequence(first, last))))
    deeper = F.substring_index(at_depth("folder", F.col("_d") + 1), "/", -1)
    return repeated.withColumns({
        "at": at_depth("folder", F.col("_d")), "child": F.when(F.col("_d") < own, deeper)}).drop("_d")


def _below_named(files: DataFrame, rules) -> DataFrame:
    """Files below a folder whose name lets some rule hold there; all of them if no name rules that out."""
    possible = could_be({"op": "or", "items": [rule.expr for rule in rules]}, True)
    if isinstance(possible, bool):
        return files if possible else files.limit(0)
    # One regex a file, over the folders below the scan root: a name with a slash behind it is a folder's.
    below = F.substr(F.col("path"), F.length(open_ended("root")) + 1)
    return files.filter(below.rlike(f"{FLAGS}/{possible}(?=[^/]*/)"))


def _lead(text) -> Column:
    """A long that sorts as the first seven bytes of a text do."""
    return F.conv(F.hex(F.rpad(F.substring(F.col(text).cast("binary"), 1, 7), 7, F.lit(b"\0"))), 16, 10).cast("long")


def _first_lead(order: str) -> Column:
    # Paths of one folder sort as the names do.
    return _lead("file_name" if order == "path" else order)


def own_folders(
    files: DataFrame, rules=(), order: str = "ord", everywhere: bool = True, exact: bool = True,
) -> DataFrame:
    """One row per folder that directly holds files, with the facts that ``rules`` ask of its files.

    The only step of detection that reads every file. Store it when both the
    projects and their files are wanted. Without ``everywhere`` folders are left
    out if neither they nor a folder above them can be a project by their names.
    A text as ``order`` makes Spark sort all files; unless ``exact``, the folder's
    ``first_ord`` is then replaced by ``first_lead``, a number by which
    ``split_files`` and ``first_seen`` find it among few files.
    """
    rough = not exact and files.schema[order].dataType == T.StringType()
    facts = leaf_facts(rules)
    named = files.filter(HAS_PATH)
    located = _located(named if everywhere else _below_named(named, rules))
    leaves: list[Column] = []
    for (op, glob), column in facts.items():
        if op == "file":
            leaves.append(F.max(glob_match("file_name", glob).cast("int")).alias(column))
        elif op == "count":
            leaves.append(F.count_if(glob_match("file_name", glob)).alias(column))
    return located.groupBy(*SCAN, "folder").agg(
        F.count("*").alias("own_files"), F.sum(F.coalesce("size", F.lit(0))).alias("own_bytes"),
        F.min(_first_lead(order)).alias("first_lead") if rough else F.min(order).alias("first_ord"), *leaves,
    )


def folder_rollup(own: DataFrame, rules=()) -> DataFrame:
    """Every folder below a scan root, and the root, with what lies anywhere below it.

    Works on ``own_folders``: files are reduced to their own folder before
    anything is repeated per ancestor. The child through which an ancestor is
    reached is known at that moment, so rules on child folders need no second
    grouping.
    """
    facts = leaf_facts(rules)
    reached = _above(own, include_root=True, include_self=True)
    here = F.col("at") == F.col("folder")
    leaves = []
    for (op, glob), column in facts.items():
        if op == "file":
            leaves.append(F.max(F.when(here, F.col(column))).alias(column))
        elif op == "dir":
            leaves.append(F.max(F.coalesce(glob_match("child", glob), F.lit(False)).cast("int")).alias(column))
        else:
            leaves.append(F.sum(column).alias(column))
    rolled = reached.groupBy(*SCAN, "at").agg(
        F.sum("own_files").alias("file_count"), F.sum("own_bytes").alias("total_bytes"),
        F.coalesce(F.sum(F.when(here, F.col("own_files"))), F.lit(0)).alias("own_files"),
        *[F.min(c).alias(c) for c in _FIRST if c in own.columns], *leaves,
    ).withColumnRenamed("at", "folder")
    named = rolled.withColumns({"depth": _depth("folder"), "folder_name": F.substring_index("folder", "/", -1)})
    return _shown(named)


def not_opaque(names) -> Column:
    """No folder from the scan root (itself included) down to this one is opaque."""
    if not names:
        return F.lit(True)
    # From the root's own name downwards: cut what lies before that name.
    before = F.length("root") - F.length(F.substring_index("root", "/", -1))
    return ~has_segment(F.substr(F.col("folder"), before + 1), names)


def match_folders(own: DataFrame, settings: ProjectSettings) -> DataFrame:
    """Folders that satisfy a rule, with the first rule that holds."""
    folders = folder_rollup(own, settings.rules)
    eligible = folders.filter((F.col("folder") != F.col("root")) & not_opaque(settings.opaque))
    matched = eligible.withColumn("_rule", first_match(settings.rules, leaf_facts(settings.rules)))
    return matched.filter("_rule is not null").select(
        *SCAN, "folder", "depth", "file_count", "total_bytes", *[c for c in _FIRST if c in own.columns], "_rule.*")


def outermost(matches: DataFrame) -> DataFrame:
    """Drop a match that lies inside another one."""
    inner = _above(matches, include_root=False, include_self=False).select(
        "scan_order", F.col("folder").alias("inner"), F.col("at").alias("folder"))
    held = inner.join(matches.select("scan_order", "folder"), ["scan_order", "folder"], "left_semi")
    nested = held.select("scan_order", F.col("inner").alias("folder")).distinct()
    return matches.join(nested, ["scan_order", "folder"], "left_anti")


def detect_projects(
    own: DataFrame, settings: ProjectSettings = ProjectSettings(),
) -> DataFrame:
    """Project folders of every scan, from ``own_folders``.

    ``project_key`` identifies a project; ``first_ord`` and ``depth`` give the
    order in which projects were first seen.
    """
    matches = match_folders(own, settings)
    if not settings.detect_nested:
        matches = outermost(materialize(matches, "matches"))
    drive = F.coalesce(F.nullif("drive_name", F.lit("")), F.lit("drive"))
    return matches.select(
        F.concat(F.col("scan_order").cast("string"), F.lit("::"), F.col("folder")).alias("project_key"),
        F.concat(drive, F.lit("::"), F.col("folder")).alias("project_id"), "*")


def folder_projects(own: DataFrame, projects: DataFrame) -> DataFrame:
    """Which project each file-holding folder belongs to (several when projects nest)."""
    lead = [c for c in ("first_lead",) if c in own.columns]
    reached = _above(own, include_root=False, include_self=True).select(
        "scan_order", F.col("folder").alias("holder"), "own_files", *lead, F.col("at").alias("folder"))
    few = projects.select("scan_order", "folder", "project_key")
    found = reached.join(few, ["scan_order", "folder"])
    return found.select("scan_order", F.col("holder").alias("folder"), "project_key",
                        F.col("folder").alias("project_folder"), "own_files", *lead)


def tag_files(files: DataFrame, holders: DataFrame, how: str = "inner") -> DataFrame:
    """Files with the project they belong to; ``left`` keeps files without one, and without a path.

    ``holders`` should be a stored table: its size in bytes then decides
    whether it goes to every task or files shuffle once by folder.
    """
    lead = [c for c in ("first_lead",) if c in holders.columns]
    return join_keys(_located(files), holders.select("scan_order", "folder", "project_key", "project_folder", *lead),
                     ["scan_order", "folder"], how)


def split_files(
    files: DataFrame, holders: DataFrame, order: str = "ord", claims: bool = False, unused: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """Files inside projects, tagged, and all others, from one pass whose result is stored.

    What paths and names tell again (``folder``, ``file_name``) is not stored,
    nor the ``unused`` columns of files inside projects, which are null there.
    With ``claims`` a file is left out of the others if a project of any scan
    holds its path: only files in folders that some scan's project holds are
    looked up.
    """
    tagged = tag_files(files, holders, "left")
    part = F.when(F.col("project_key").isNotNull(), "inside")
    if claims:
        named = materialize(holders.select("folder").distinct(), "named").withColumnRenamed("folder", "_named")
        tagged = tagged.join(named, F.col("folder") == F.col("_named"), "left")
        part = part.when(F.col("_named").isNotNull(), "disputed")
    first = [(F.col("first_lead") == _first_lead(order)).alias("_first")] if "first_lead" in holders.columns else []
    kept = [F.when(F.col("project_key").isNull(), F.col(c)).alias(c) if c in unused else F.col(c) for c in files.columns]
    stored = materialize(tagged.select(
        *kept, "project_key", "project_folder", *first, part.otherwise("free").alias("_part")), "tagged", "_part")
    inside = stored.filter("_part = 'inside'").drop("_part")
    others = stored.filter("_part = 'free'").select(files.columns)
    if claims:
        disputed = materialize(stored.filter("_part = 'disputed'").select(files.columns), "disputed")
        held = inside.select("path").join(disputed.select("path"), "path", "left_semi").distinct()
        others = others.unionByName(disputed.join(held, "path", "left_anti"))
    return inside, others


def first_seen(projects: DataFrame, tagged: DataFrame, order: str) -> DataFrame:
    """``projects`` with ``first_ord``, the first ``order`` of their files, also where folders have only its ``first_lead``."""
    if "first_ord" in projects.columns:
        return projects
    mine = ["project_key", "drive_name", "root"]
    firsts = materialize(tagged.filter("_first").groupBy(*mine).agg(F.min(order).alias("first_ord")), "firsts")
    rows = projects.withColumns({"shown_root": F.col("root"), "root": open_ended("root")})
    return join_keys(rows, firsts, mine, "left").withColumn("root", F.col("shown_root")).drop("shown_root")


def signature_items(tagged: DataFrame, opaque, count_repeats: bool = True) -> DataFrame:
    """``(project_key, item)`` of every project file outside opaque folders.

    A path listed twice in one scan gives an item twice; the second one is
    numbered, so that set sizes and overlaps count it.
    """
    rel = rel_path("path", "project_folder")
    plain = tagged.withColumn("_rel", rel)
    if opaque:
        plain = plain.filter(~has_segment("_rel", opaque))
    items = plain.select("project_key", signature_item("_rel", "size").alias("item"))
    if not count_repeats:
        return items
    counted = items.groupBy("project_key", "item").agg(F.count("*").alias("_n"))
    each = counted.select("project_key", "item", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
    return each.select("project_key", F.when(F.col("_k") == 1, F.col("item")).otherwise(
        F.concat("item", F.lit("\u0000"), F.col("_k").cast("string"))).alias("item"))
