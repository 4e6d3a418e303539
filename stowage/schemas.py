"""Schemas of the tables that are read and written."""

from __future__ import annotations

from pyspark.sql import types as T

INVENTORY = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("size", T.LongType()),
    T.StructField("mtime", T.LongType()),
    T.StructField("ext", T.StringType()),
])

SCAN_ERROR = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("error", T.StringType()),
])

SCAN_HEADER = T.StructType([
    T.StructField("root", T.StringType()),
    T.StructField("scannedAt", T.StringType()),
    T.StructField("durationMs", T.LongType()),
    T.StructField("fileCount", T.LongType()),
    T.StructField("dirCount", T.LongType()),
    T.StructField("totalBytes", T.LongType()),
    T.StructField("currentDir", T.StringType()),
    T.StructField("done", T.BooleanType()),
    T.StructField("paused", T.BooleanType()),
    T.StructField("cancelled", T.BooleanType()),
    T.StructField("errorCount", T.LongType()),
    T.StructField("errorsSample", T.ArrayType(SCAN_ERROR)),
    T.StructField("ndjson", T.StringType()),
    T.StructField("errors", T.StringType()),
    T.StructField("volumeUUID", T.StringType()),
    T.StructField("volumeName", T.StringType()),
])

# Entry columns inside the library, with the name each has in an NDJSON plan.
ENTRY_FIELDS = [
    ("src_path", "srcPath", T.StringType()),
    ("volume_uuid", "srcVolumeUUID", T.StringType()),
    ("drive_name", "driveName", T.StringType()),
    ("dst_rel_path", "dstRelPath", T.StringType()),
    ("size", "size", T.LongType()),
    ("mtime", "mtime", T.LongType()),
    ("ext", "ext", T.StringType()),
    ("dupe_key", "dupeKey", T.StringType()),
    ("status", "status", T.StringType()),
    ("name", "name", T.StringType()),
    ("winner_path", "winnerPath", T.StringType()),
    ("project_root", "projectRoot", T.StringType()),
    ("project_rule", "projectRule", T.StringType()),
    ("winner_project_root", "winnerProjectRoot", T.StringType()),
    ("winner_drive", "winnerDrive", T.StringType()),
    ("error", "error", T.StringType()),
    ("copied_at", "copiedAt", T.LongType()),
]
ENTRY = T.StructType([T.StructField(ours, kind) for ours, _, kind in ENTRY_FIELDS])
ENTRY_JSON = T.StructType([T.StructField(theirs, kind) for _, theirs, kind in ENTRY_FIELDS])

PLAN_SOURCE = T.StructType([
    T.StructField("scan", T.StringType()),
    T.StructField("ndjson", T.StringType()),
    T.StructField("volumeUUID", T.StringType()),
    T.StructField("driveName", T.StringType()),
    T.StructField("root", T.StringType()),
])

RULE_COUNTS = T.StructType([
    T.StructField("kept", T.LongType()),
    T.StructField("collapsed", T.LongType()),
])

PLAN_HEADER = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("createdAt", T.StringType()),
    T.StructField("sources", T.ArrayType(PLAN_SOURCE)),
    T.StructField("destination", T.StringType()),
    T.StructField("layout", T.StringType()),
    T.StructField("dedup", T.StringType()),
    T.StructField("tieBreak", T.StringType()),
    T.StructField("destMode", T.StringType()),
    T.StructField("projectDedup", T.StructType([
        T.StructField("enabled", T.BooleanType()),
        T.StructField("similarityThreshold", T.DoubleType()),
        T.StructField("projectsKept", T.LongType()),
        T.StructField("projectsCollapsed", T.LongType()),
        T.StructField("byRule", T.MapType(T.StringType(), RULE_COUNTS)),
    ])),
    T.StructField("totalFiles", T.LongType()),
    T.StructField("totalBytes", T.LongType()),
    T.StructField("duplicatesCollapsed", T.LongType()),
    T.StructField("projectDuplicatesCollapsed", T.LongType()),
    T.StructField("errorCount", T.LongType()),
    T.StructField("entriesFile", T.StringType()),
    T.StructField("status", T.StringType()),
])

TRASH_ENTRY = T.StructType([
    T.StructField("path", T.StringType()),
    T.StructField("queuedAt", T.StringType()),
    T.StructField("status", T.StringType()),
])
TRASH_LOG = T.StructType([
    T.StructField("entries", T.ArrayType(TRASH_ENTRY)),
    T.StructField("retentionOverride", T.StringType()),
])

# The statuses an entry can have.
STATUSES = (
    "pending", "copied", "skipped-duplicate", "skipped-project-duplicate", "source-error",
    "skipped-exists", "skipped-volume-unavailable", "source-missing", "failed",
)
