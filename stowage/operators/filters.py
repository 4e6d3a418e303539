"""Row filters of the inventory browser and of the scanner."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions.buckets import age_bucket, category, parse_size
from stowage.functions.names import has_segment, path_depth, top_folder
from stowage.operators.dedup import hide_duplicates, only_duplicates

# Places a scan never enters.
SYSTEM_DIRS = [
    "/System", "/private/var/vm", "/private/var/db",
    "/.Spotlight-V100", "/.Trashes", "/.fseventsd",
]
SYSTEM_NAMES = [".Trashes", ".fseventsd"]
SYSTEM_PREFIX = ".Spotlight"
TIME_MACHINE_DIRS = [
    "Backups.backupdb", ".MobileBackups", ".TimeMachine", "Time Machine Backups",
    ".com.apple.TimeMachine.supported", ".com.apple.timemachine.donotpresent",
    ".com.apple.timemachine.supported",
]


def hygiene(path="path", root="root", skip_time_machine: bool = True, is_dir=None) -> Column:
    """True for rows a scan of ``root`` would list.

    Only what lies below the root is tested, so scanning a system folder
    itself works. Time-machine names count for folders; the last segment is a
    folder only where ``is_dir`` says so.
    """
    path = F.col(path) if isinstance(path, str) else path
    root = F.col(root) if isinstance(root, str) else root
    stem = F.regexp_replace(root, r"/+\z", "")
    below = F.substr(path, F.length(stem) + 2)
    bad = has_segment(below, SYSTEM_NAMES) | below.rlike(r"(?:\A|/)" + SYSTEM_PREFIX.replace(".", r"\."))
    for place in SYSTEM_DIRS:
        inside = (path == place) | F.startswith(path, F.lit(place + "/"))
        root_inside = (root == place) | F.startswith(root, F.lit(place + "/"))
        bad = bad | (inside & ~root_inside)
    if skip_time_machine:
        whole = has_segment(below, TIME_MACHINE_DIRS)
        folders = has_segment(F.regexp_replace(below, r"(?s)(?:\A|/)[^/]*\z", ""), TIME_MACHINE_DIRS)
        bad = bad | (folders if is_dir is None else F.when(is_dir, whole).otherwise(folders))
    return ~bad


def hygiene_filter(df: DataFrame, root="root", skip_time_machine: bool = True) -> DataFrame:
    return df.filter(hygiene("path", root, skip_time_machine))


def regular_files(listing: DataFrame) -> DataFrame:
    """Keep plain files; links and special files are never followed."""
    return listing.filter(F.col("kind") == "file")


@dataclass(frozen=True)
class FilterSpec:
    """Criteria of the inventory browser; unset ones do not filter."""

    name_contains: str | None = None
    path_contains: str | None = None
    top_folder: str | None = None
    extensions: list[str] = field(default_factory=list)
    min_size: int | str | None = None
    max_size: int | str | None = None
    modified_after: int | None = None
    modified_before: int | None = None
    age: str | None = None
    category: str | None = None
    min_depth: int | None = None
    max_depth: int | None = None
    duplicates: str | None = None  # "only" or "hide"
    size_base: int = 1000

    def condition(self, now_ms: int | None = None) -> Column | None:
        """All row criteria as one predicate; comparisons on stored columns come first."""
        tests: list[Column] = []
        if self.min_size is not None:
            tests.append(F.col("size") >= parse_size(self.min_size, self.size_base))
        if self.max_size is not None:
            tests.append(F.col("size") <= parse_size(self.max_size, self.size_base))
        if self.modified_after is not None:
            tests.append(F.col("mtime") >= self.modified_after)
        if self.modified_before is not None:
            tests.append(F.col("mtime") <= self.modified_before)
        if self.extensions:
            tests.append(F.col("ext").isin([e.lower().lstrip(".") for e in self.extensions]))
        if self.category:
            tests.append(category("ext") == self.category)
        if self.age:
            if now_ms is None:
                raise ValueError("an age filter needs now_ms")
            tests.append(age_bucket("mtime", now_ms) == self.age)
        if self.name_contains:
            tests.append(F.contains(F.lower("name"), F.lit(self.name_contains.lower())))
        if self.path_contains:
            tests.append(F.contains(F.lower("path"), F.lit(self.path_contains.lower())))
        if self.top_folder:
            tests.append(F.startswith(F.col("path"), F.lit(self.top_folder)) & (top_folder("path") == self.top_folder))
        if self.min_depth is not None:
            tests.append(path_depth("path") >= self.min_depth)
        if self.max_depth is not None:
            tests.append(path_depth("path") <= self.max_depth)
        return reduce(lambda a, b: a & b, tests) if tests else None


def filter_inventory(files: DataFrame, spec: FilterSpec, now_ms: int | None = None) -> DataFrame:
    """Files that meet every criterion; duplicates are judged among the files left by the others."""
    condition = spec.condition(now_ms)
    out = files if condition is None else files.filter(condition)
    if spec.duplicates == "only":
        return only_duplicates(out).drop("copies")
    if spec.duplicates == "hide":
        return hide_duplicates(out)
    return out
