"""File-level duplicates: files that agree on size, name and extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import utf16_length
from stowage.operators.skew import join_keys, pick_first, with_group

KEY = ["size", "name", "ext"]
TIE_BREAKS = ("firstScanned", "newest", "oldest", "shortestPath", "largest")
ORDER = ("scan_order", "ord")


def tie_order(tie_break: str, order: tuple[str, ...] = ORDER) -> list[Column]:
    """Sort columns that put the copy to keep first.

    A later copy wins only when it is strictly better, so ties fall back to
    the order in which files were seen. ``largest`` always ties: size is part
    of the key.
    """
    if tie_break not in TIE_BREAKS:
        raise ValueError(f"unknown tie-break: {tie_break!r}")
    modified = F.coalesce(F.col("mtime"), F.lit(0))
    metric = {
        "newest": [modified.desc()],
        "oldest": [modified.asc()],
        "shortestPath": [utf16_length(F.coalesce(F.col("path"), F.lit(""))).asc()],
    }.get(tie_break, [])
    return metric + [F.col(c).asc() for c in order]


def _plain(order: list[Column], tie_break: str) -> list[Column]:
    """The same order as values that sort ascending, for min over a struct."""
    modified = F.coalesce(F.col("mtime"), F.lit(0))
    metric = {
        "newest": [-modified],
        "oldest": [modified],
        "shortestPath": [utf16_length(F.coalesce(F.col("path"), F.lit("")))],
    }.get(tie_break, [])
    return metric + order


def _with_key(files: DataFrame) -> DataFrame:
    return files.withColumn("ext", F.coalesce(F.col("ext"), F.lit("")))


def dedupe_files(
    files: DataFrame, tie_break: str = "firstScanned", order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """All files, with ``is_winner`` and the ``winner_path`` of each duplicate group."""
    tie_order(tie_break, order)
    ranked = _plain([F.col(c) for c in order], tie_break)
    # Where the path is part of the order, it is told from there.
    told = len(ranked) - len(order) + order.index("path") if "path" in order else F.col("path")
    return pick_first(_with_key(files), KEY, ranked, {"winner_path": told})


def dedupe_winners(
    files: DataFrame, tie_break: str = "firstScanned", order: tuple[str, ...] = ORDER,
) -> DataFrame:
    """Only the kept copies.

    The rank filter lets each map task drop all but its best row per key
    before the shuffle, so a hot key costs nothing.
    """
    window = Window.partitionBy(*KEY).orderBy(*tie_order(tie_break, order))
    return (
        _with_key(files).withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1").drop("_rank")
    )


def content_candidates(files: DataFrame, by: tuple[str, ...] = tuple(KEY)) -> DataFrame:
    """Files that may have an equal: first those whose size is not alone, then those whose ``by`` is not.

    Each stage is a semi-join with the repeated values, which map tasks count
    before the shuffle. Most files leave at the first, on one number.
    """
    left = _with_key(files)
    for columns in ([["size"]] if "size" in by and len(by) > 1 else []) + [list(by)]:
        repeated = left.groupBy(*columns).agg(F.count("*").alias("_n")).filter("_n > 1").drop("_n")
        left = join_keys(left, repeated, columns)
    return left


def dedupe_by_content(
    files: DataFrame, contents: DataFrame, order: tuple[str, ...] = ORDER, by: tuple[str, ...] = tuple(KEY),
    tie_break: str = "firstScanned",
) -> DataFrame:
    """Files that have an equal, with ``content_hash``, ``is_winner`` and the group's ``winner_path``.

    ``contents`` (``path, content``) is read for candidates only; a candidate
    whose content is not there or null is left out. Files are equal if ``by``
    and the SHA-256 of their whole content agree; ``by=("size",)`` finds copies
    under other names. Of equal files the ``tie_break`` keeps one.
    """
    tie_order(tie_break, order)
    read = contents.filter("content is not null").select(F.col("path").alias("_path"), "content").join(
        content_candidates(files, by).select(F.col("path").alias("_path")).distinct(), "_path", "left_semi")
    hashed = read.select("_path", F.sha2(F.col("content").cast("binary"), 256).alias("content_hash")).distinct()
    known = _with_key(files).join(hashed, F.col("path") == F.col("_path")).drop("_path")
    keys = [*by, "content_hash"]
    ranked = _plain([F.col(c) for c in order], tie_break)
    equal = with_group(known, keys, {"_copies": F.count("*")}).filter("_copies > 1").drop("_copies")
    return pick_first(equal, keys, ranked, {"winner_path": F.col("path")})


def only_duplicates(files: DataFrame) -> DataFrame:
    """Files that share size, name and extension with another one; adds ``copies``."""
    counted = with_group(_with_key(files), KEY, {"copies": F.count("*")})
    return counted.filter("copies > 1")


def hide_duplicates(files: DataFrame) -> DataFrame:
    """One file per duplicate group: the one with the shortest path."""
    window = Window.partitionBy(*KEY).orderBy(F.length("path"), "path")
    return (
        _with_key(files).withColumn("_rank", F.row_number().over(window))
        .filter("_rank = 1").drop("_rank")
    )


def first_in_batch(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per ``key``; the rest of the batch is ignored."""
    window = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")


def last_in_batch(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Last row per key, placed where the key was first seen (``position``)."""
    places = df.groupBy(*keys).agg(F.min(F.struct(*order)).alias("position"))
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    last = df.withColumn("_rank", F.row_number().over(window)).filter("_rank = 1").drop("_rank")
    return last.join(places, keys)
