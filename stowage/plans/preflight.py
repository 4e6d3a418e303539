"""Look at a plan before it runs: drives, mounts, sources, destinations, space, likely outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.names import (
    ancestors, base_name, drive_key, parent, rebase_path, sanitize_for_path, volume_of,
)
from stowage.operators.flat_names import resolve_flat_names
from stowage.operators.reports import bytes_if, bytes_of
from stowage.operators.skew import join_keys, pick_first
from stowage.session import materialize

FREE_MARGIN = 1024 ** 3


def pending_only(entries: DataFrame) -> DataFrame:
    return entries.filter("status = 'pending'")


def drive_groups(entries: DataFrame, order: str = "ord") -> DataFrame:
    """Pending entries per source drive, in the order in which the drives turn up."""
    key = drive_key()
    named = F.coalesce(F.nullif("drive_name", F.lit("")),
                       F.nullif(F.regexp_extract("src_path", "^/Volumes/([^/]+)", 1), F.lit("")), F.lit("unknown"))
    tagged = pending_only(entries).withColumn("group_key", key).withColumn(
        "_drive", F.when(F.col("group_key") == "internal", F.lit("Internal"))
        .when(F.startswith("group_key", F.lit("name:")), named).otherwise(F.col("drive_name")))
    return tagged.groupBy("group_key").agg(
        F.min_by(F.when(F.col("group_key") != "internal", F.nullif("volume_uuid", F.lit(""))), order).alias("uuid"),
        F.min_by("_drive", order).alias("drive_name"),
        F.count("*").alias("files"), bytes_of().alias("bytes"), F.min(order).alias("first_ord"),
    )


def _space_prefixes(text: Column) -> Column:
    """Everything before each blank of ``text``."""
    parts = F.split(text, " ")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), " "))


def _name_keys(df: DataFrame, ident: list[str], uuid: str, name: str, swap: bool) -> DataFrame:
    """Rows ``(kind, key)`` under which a drive or a mount can be found.

    Kinds 4 and 5 pair a whole name on one side with the leading words of the
    name on the other, which is how a drive mounted twice gets its number.
    """
    low = F.lower(name)
    words = F.when(F.contains(low, F.lit(" ")), _space_prefixes(low)).otherwise(F.array().cast("array<string>"))
    whole, parts = F.array(low), words
    keys = [(1, F.array(F.lower(F.nullif(F.col(uuid), F.lit(""))))), (2, F.array(F.col(name))), (3, whole),
            (4, parts if swap else whole), (5, whole if swap else parts)]

    def labelled(kind: int, values: Column) -> Column:
        return F.transform(values, lambda key: F.struct(F.lit(kind).alias("kind"), key.alias("key")))

    pairs = F.flatten(F.array(*[labelled(kind, values) for kind, values in keys]))
    exploded = df.select(*ident, F.explode(pairs).alias("_p"))
    return exploded.select(*ident, "_p.kind", "_p.key").filter("key is not null")


def match_mounts(groups: DataFrame, mounts: DataFrame) -> DataFrame:
    """The mounted volume of every drive group, null where a drive has to be plugged in.

    Tried in this order: volume id, exact name, name in any case, and a name
    that continues the other after a blank. Within one step the first mount
    counts. ``mounts`` has ``path, name, uuid, ord``.
    """
    outside = groups.filter("group_key <> 'internal'")
    left = _name_keys(outside, ["group_key"], "uuid", "drive_name", False)
    right = _name_keys(mounts, ["path", "name", "uuid", "ord"], "uuid", "name", True).withColumnRenamed(
        "name", "mount_name").withColumnRenamed("uuid", "mount_uuid")
    tier = F.least("kind", F.lit(4))
    best = left.join(right, ["kind", "key"]).groupBy("group_key").agg(F.min_by(
        F.struct(tier.alias("tier"), F.col("path").alias("mount_path"), "mount_name"), F.struct(tier, "ord")).alias("m"))
    internal = F.col("group_key") == "internal"
    found = groups.join(best, "group_key", "left")
    return found.select(
        groups["*"], F.when(internal, F.lit(0)).otherwise(F.col("m.tier")).alias("tier"),
        F.when(internal, F.lit("/")).otherwise(F.col("m.mount_path")).alias("mount_path"),
        F.when(internal, F.lit("Internal")).otherwise(F.col("m.mount_name")).alias("mount_name"),
    ).withColumn("needs_swap", F.col("mount_path").isNull())


def current_sources(entries: DataFrame, matched: DataFrame) -> DataFrame:
    """Adds ``src_now``, where the source file is today given where its drive is mounted, and ``needs_swap``."""
    tagged = entries.withColumn("group_key", drive_key())
    places = matched.select("group_key", F.col("drive_name").alias("_drive"), "mount_path")
    joined = join_keys(tagged, places, ["group_key"], "left")
    moved = F.col("mount_path").isNotNull() & (F.col("group_key") != "internal") & F.col("_drive").isNotNull()
    now = F.when(moved, rebase_path("src_path", "_drive", "mount_path")).otherwise(F.col("src_path"))
    swap = F.col("mount_path").isNull() & (F.col("group_key") != "internal")
    return joined.withColumn("src_now", now).withColumn("needs_swap", swap).drop("_drive", "mount_path")


def verify_sources(entries: DataFrame, live: DataFrame, mounts: DataFrame) -> DataFrame:
    """Pending entries with ``check``: ok, missing, or offline when the volume is not mounted."""
    tagged = pending_only(entries).withColumn("_volume", volume_of("src_path", needs_child=False))
    volumes = mounts.select(F.col("path").alias("_volume")).distinct().withColumn("_mounted", F.lit(True))
    tagged = join_keys(tagged, volumes, ["_volume"], "left")
    present = live.select(F.col("path").alias("src_path")).distinct().withColumn("_live", F.lit(True))
    joined = tagged.join(present, "src_path", "left")
    check = (F.when(F.col("_volume").isNotNull() & F.col("_mounted").isNull(), F.lit("offline"))
             .when(F.col("_live"), F.lit("ok")).otherwise(F.lit("missing")))
    return joined.withColumn("check", check).select(*entries.columns, "check")


def verify_summary(verified: DataFrame) -> DataFrame:
    """Checks per drive and over all drives (``drive`` null)."""
    check = F.col("check")
    return verified.select(F.coalesce(F.nullif("drive_name", F.lit("")), F.lit("Internal")).alias("drive"), "check").rollup(
        "drive").agg(
        F.count("*").alias("total"), F.count_if(check == "ok").alias("ok"),
        F.count_if(check == "missing").alias("missing"), F.count_if(check == "offline").alias("drive_offline"))


def space_check(entries: DataFrame, free_bytes: int | None) -> DataFrame:
    """Whether the destination has room for what is pending and 1 GiB more; unknown space passes."""
    need = entries.agg(bytes_if(F.col("status") == "pending").alias("pending_bytes"))
    free = F.lit(free_bytes).cast("long")
    return need.withColumn("fits", F.coalesce(free >= F.col("pending_bytes") + FREE_MARGIN, F.lit(True)))


def destination_error(
    destination: str, protected: list[str] = (), dest_mode: str = "additive", existing: DataFrame | None = None,
) -> str | None:
    """Why a destination is refused, or None. A fresh one must hold nothing of what ``existing`` lists."""
    clean = destination.rstrip("/")
    if not clean:
        return "destination is the root" if destination else "no destination"
    if any(clean == p.rstrip("/") or clean.startswith(p.rstrip("/") + "/") for p in protected):
        return "destination is protected"
    if dest_mode == "fresh" and existing is not None and existing.filter(
            F.startswith("path", F.lit(clean + "/"))).limit(1).count():
        return "destination is not empty"
    return None


def refused_destinations(
    destinations: DataFrame, protected: list[str] = (), dest_mode: str = "additive", existing: DataFrame | None = None,
) -> DataFrame:
    """Adds ``why`` to many destinations (``path``) at once: the reason of ``destination_error``, or null.

    Files of ``existing`` are reduced to their folders before these are
    repeated per folder above them.
    """
    clean = F.rtrim("path", F.lit("/"))
    why = F.when(F.coalesce("path", F.lit("")) == "", F.lit("no destination")).when(
        clean == "", F.lit("destination is the root"))
    for folder in protected:
        stem = folder.rstrip("/")
        why = why.when((clean == stem) | F.startswith(clean, F.lit(stem + "/")), F.lit("destination is protected"))
    if dest_mode != "fresh" or existing is None:
        return destinations.withColumn("why", why)
    folders = existing.select(parent("path").alias("_own")).distinct()
    taken = folders.select(F.explode(ancestors(F.concat("_own", F.lit("/x")), F.lit("/"))).alias("_taken")).distinct()
    found = destinations.join(taken, clean == F.col("_taken"), "left")
    return found.withColumn(
        "why", why.when(F.col("_taken").isNotNull(), F.lit("destination is not empty"))).drop("_taken")


def protected_path(path="path", protected: list[str] = ()) -> Column:
    """Why a path must not be trashed, or null: the root, a protected folder, or a whole volume."""
    path = F.col(path) if isinstance(path, str) else path
    clean = F.rtrim(path, F.lit("/"))
    out = F.when(path.isNull() | (path == ""), F.lit("no path")).when(clean == "", F.lit("root"))
    for folder in protected:
        stem = folder.rstrip("/")
        out = out.when((clean == stem) | F.startswith(clean, F.lit(stem + "/")), F.lit("protected folder"))
    return out.when(clean.rlike(r"\A/Volumes/[^/]+\z"), F.lit("volume root"))


def mirrored_path() -> Column:
    """Destination below the root: as planned, or ``<drive>/<name>`` for picked files."""
    drive = F.when(F.coalesce("drive_name", F.lit("")) == "", F.lit("unknown_drive")).otherwise(
        sanitize_for_path("drive_name"))
    name = F.coalesce(F.nullif("name", F.lit("")), base_name("src_path"))
    return F.coalesce(F.nullif("dst_rel_path", F.lit("")), F.concat(drive, F.lit("/"), name))


def in_run_order(entries: DataFrame, order: str = "ord") -> DataFrame:
    """Adds ``group_ord``: entries are copied drive by drive, drives in the order they turn up."""
    tagged = entries.withColumn("group_key", drive_key())
    # Stored, so that its size shows: the few drives go to every task, and no drive's entries meet in one.
    firsts = materialize(tagged.groupBy("group_key").agg(F.min(order).alias("group_ord")), "drives")
    return join_keys(tagged, firsts, ["group_key"], "left").drop("group_key")


def resolve_destinations(
    entries: DataFrame, destination: str, layout: str, existing: DataFrame, order: str = "ord", live: DataFrame | None = None, source: str = "src_path",
) -> DataFrame:
    """Adds ``dst_path`` to pending entries. ``existing`` lists full paths at the destination.

    With ``live`` (the source paths that can be read) only entries that a run
    would get to copy are given a place: one that is missing, or whose drive
    has to be plugged in (``needs_swap``), takes no name from another.
    """
    root = destination.rstrip("/")
    rows = pending_only(entries)
    if live is not None:
        there = live.select(F.col("path").alias(source)).distinct().withColumn("_live", F.lit(True))
        ready = F.lit(True) if "needs_swap" not in rows.columns else ~F.coalesce("needs_swap", F.lit(False))
        known = rows.join(there, source, "left").select(*rows.columns, (ready & F.col("_live").isNotNull()).alias("_ready"))
        if layout == "flat":
            known = materialize(known, "known")  # flat names read their entries several times
        named = resolve_destinations(known.filter("_ready").drop("_ready"), destination, layout, existing, order)
        rest = known.filter("not _ready").drop("_ready")
        return named.unionByName(rest.withColumn("dst_path", F.lit(None).cast("string")).select(named.columns))
    if layout != "flat":
        return rows.withColumn("dst_path", F.concat(F.lit(root + "/"), mirrored_path()))
    direct = existing.filter(F.startswith("path", F.lit(root + "/"))).select(
        F.substr("path", F.lit(len(root) + 2)).alias("name")).filter("name not like '%/%'")
    named = resolve_flat_names(in_run_order(rows, order), direct, ["group_ord", order])
    return named.withColumn("dst_path", F.concat(F.lit(root + "/"), F.col("dst_name"))).drop("dst_name", "group_ord")


def predict_outcomes(
    resolved: DataFrame, live: DataFrame, existing: DataFrame, destination: str, dest_mode: str,
    order: str = "ord", source: str = "src_path", protected: list[str] = (),
) -> DataFrame:
    """Adds the status a run would give each entry (``predicted``) and why (``reason``).

    A drive that has to be plugged in (``needs_swap``) makes the entry
    unavailable before its source is looked for. A destination at or below a
    protected folder fails, entry by entry.

    Of several entries with one destination the first that can be read
    creates the file; the later ones find it there.
    """
    present = live.select(F.col("path").alias(source)).distinct().withColumn("_live", F.lit(True))
    there = existing.select(F.col("path").alias("dst_path")).distinct().withColumn("_there", F.lit(True))
    # Stored: the first of each destination is found before all are marked.
    joined = materialize(resolved.join(present, source, "left").join(there, "dst_path", "left"), "resolved")
    away = F.coalesce("needs_swap", F.lit(False)) if "needs_swap" in resolved.columns else F.lit(False)
    read = F.col("_live").isNotNull() & ~away
    readable = pick_first(joined.filter(read), ["dst_path"], [F.col(order)], {})
    unread = joined.filter(~read).withColumn("is_winner", F.lit(True))
    exists = F.col("_there").isNotNull() | ~F.col("is_winner")
    unsafe = F.rtrim("dst_path", F.lit("/")) == destination.rstrip("/")
    for folder in protected:
        stem = folder.rstrip("/")
        unsafe = unsafe | (F.col("dst_path") == stem) | F.startswith("dst_path", F.lit(stem + "/"))
    status = F.when(away, F.lit("skipped-volume-unavailable")).when(
        F.col("_live").isNull(), F.lit("source-missing")).when(unsafe, F.lit("failed"))
    if dest_mode == "additive":
        status = status.when(exists, F.lit("skipped-exists"))
    elif dest_mode == "fresh":
        status = status.when(exists, F.lit("failed"))
    status = status.otherwise(F.lit("copied"))
    reason = F.when(away | F.col("_live").isNull(), F.lit(None)).when(unsafe, F.lit("unsafe-destination")).when(
        exists & F.lit(dest_mode == "fresh"), F.lit("EEXIST")).when(exists & F.lit(dest_mode == "overwrite"), F.lit("overwritten"))
    both = readable.unionByName(unread)
    return both.withColumns({"predicted": status, "reason": reason}).select(*resolved.columns, "predicted", "reason")
