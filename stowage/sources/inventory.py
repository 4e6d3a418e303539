"""Inventories: NDJSON scans, their headers and errors, and raw listings."""

from __future__ import annotations

import posixpath
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage.functions.names import base_name, file_ext, sanitize_for_path
from stowage.operators.filters import hygiene, regular_files
from stowage.schemas import INVENTORY, SCAN_ERROR, SCAN_HEADER
from stowage.session import materialize


def _variant_fields(line: str, schema: T.StructType) -> list[Column]:
    return [F.try_variant_get(line, f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in schema]


def _with_fields(parsed: DataFrame, line: str, schema: T.StructType) -> DataFrame:
    """``parsed`` with ``_variant_fields`` in place of the line, looked up in one pass over it, not in one each."""
    found = F.try_variant_get(line, "$", schema.simpleString())
    return parsed.withColumn("_fields", found).select("_fields.*", *[c for c in parsed.columns if c != line])


def _records(text: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per valid JSON line of ``text``, with its file, split and number within its task.

    Each line is parsed once; the number of the raw line, which no optimizer
    moves, keeps the filter behind the parse. Numbers count valid lines and
    grow by one within a split.
    """
    parsed = text.select(
        F.try_parse_json("value").alias("_json"), F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_raw"))
    valid = parsed.filter("_json is not null and _raw >= 0")
    return _with_fields(valid, "_json", schema).select(
        *schema.names, "source_file", "_block", F.monotonically_increasing_id().alias("_line"))


def read_ndjson(spark: SparkSession, paths, schema: T.StructType) -> DataFrame:
    """One row per valid JSON line, with its place (``ord``) and file.

    Lines that are not JSON are dropped; a valid line with one field of the
    wrong type keeps the others.
    """
    place = F.struct(F.col("source_file").alias("file"), F.col("_block").alias("block"), F.col("_line").alias("line"))
    return _records(spark.read.text(paths), schema).withColumn("ord", place).drop("_block", "_line")


_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def _path_key(path: str) -> str:
    """The path without scheme, host and doubled slashes, as ``_file_key`` gives it for a file."""
    key = re.sub("/+", "/", re.sub(_SCHEME, "", path))
    if not key.startswith("/"):
        raise ValueError(f"not an absolute path: {path}")
    return key.rstrip("/")


def _file_key(file: str, encoded: bool = True) -> Column:
    if not encoded:
        return F.regexp_replace(F.regexp_replace(F.col(file), _SCHEME, ""), "/+", "/")
    plain = F.try_url_decode(F.replace(F.col(file), F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(F.regexp_replace(F.coalesce(plain, F.col(file)), _SCHEME, ""), "/+", "/")


def _keys_above(file: str, encoded: bool = True) -> Column:
    """Keys of a file and of all folders it lies in: a path the user names may be either."""
    steps = F.split(_file_key(file, encoded), "/")
    return F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, 1, n), "/"))


def _any_of(paths: list[str]) -> list[str]:
    """Globs for those of the paths that are there, one for each file system.

    Letters that have a meaning in globs are matched by any letter; the keys
    of the files then tell them apart.
    """
    homes: dict[str, list[str]] = {}
    for path in paths:
        home = re.match(_SCHEME, path)
        home = home[0] if home else ""
        homes.setdefault(home, []).append(re.sub(r"[\\{}\[\]*,]", "?", path[len(home):].lstrip("/")))
    # The slash in front makes the whole glob absolute.
    return [home + "/{" + ",".join(dict.fromkeys(found)) + "}" for home, found in homes.items()]


def _text_of(spark: SparkSession, paths: list[str], **options) -> DataFrame | None:
    """One read of all the paths that are there, None if none is."""
    there = [glob for glob in _any_of(paths) if _exists(spark, glob)]
    return spark.read.text(there, **options) if there else None


def _exists(spark: SparkSession, path: str) -> bool:
    # A probe for presence only; the reader itself decides how the file is split.
    try:
        spark.read.text(path).schema
        return True
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def read_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Records of one scan, a file or a folder of parts; an unreadable one is an empty inventory."""
    found = _in_line_order(spark, _text_of(spark, [path]), INVENTORY, [(_path_key(path), 0)], "key string, scan_order int")
    return found.drop("scan_order")


def _in_line_order(spark: SparkSession, text: DataFrame | None, schema: T.StructType, owners: list, kind: str) -> DataFrame:
    """Records with ``ord``, their place in their scan as a dense long, and the columns of their owner.

    ``owners`` are rows of ``kind`` with ``key``, the path of a scan's file or
    folder, and ``scan_order``; a file below two of them gives its rows to
    both. The lines are read, parsed and stored once. Valid lines are counted
    by split; a split's lines come behind those of the splits before it, a
    scan's files in the order of their part numbers, then names. So ``ord`` is
    the same for any size and packing of splits.
    """
    known = spark.createDataFrame(owners, kind)
    tags = [c for c in known.columns if c != "key"]
    if text is None:
        return spark.createDataFrame([], T.StructType([
            *schema.fields, T.StructField("source_file", T.StringType()), T.StructField("ord", T.LongType()),
            *known.drop("key").schema.fields]))
    stored = materialize(_records(text, schema), "lines")
    splits = stored.groupBy("source_file", "_block").agg(F.min("_line").alias("_first"), F.count("*").alias("_n"))
    owned = splits.withColumn("key", F.explode(_keys_above("source_file"))).join(known, "key")
    number = F.coalesce(F.expr(r"try_cast(regexp_extract(source_file, 'part-([0-9]+)[^/]*$', 1) as long)"), F.lit(-1))
    before = Window.partitionBy("scan_order").orderBy(number, "source_file", "_block").rowsBetween(
        Window.unboundedPreceding, -1)
    places = owned.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first"))
    places = materialize(places.select("source_file", "_block", "_shift", *tags), "splits")
    return stored.join(places, ["source_file", "_block"]).select(
        *schema.names, "source_file", (F.col("_line") + F.col("_shift")).alias("ord"), *tags)


@dataclass(frozen=True)
class ScanSource:
    """One scan as the user listed it. ``scan_order`` is its place in that list."""

    scan: str
    ndjson: str
    root: str
    drive_name: str
    volume_uuid: str | None
    scan_order: int
    errors: str | None = None


def scan_sources(spark: SparkSession, headers: list[str]) -> tuple[list[ScanSource], list[str]]:
    """Sources for the listed header files, and warnings for those that cannot be read.

    A missing header still takes up its place in the order. Naming one twice
    is an error.
    """
    if len(set(headers)) != len(headers):
        raise ValueError("the same scan is listed twice")
    text = _text_of(spark, headers, wholetext=True)
    heads = {}
    if text is not None:
        places = spark.createDataFrame([(_path_key(h), n) for n, h in enumerate(headers)], "key string, place int")
        parsed = text.filter("try_parse_json(value) is not null").select(
            F.explode(_keys_above("_metadata.file_path")).alias("key"), "value").join(places, "key")
        parsed = parsed.select("place", F.from_json("value", SCAN_HEADER).alias("h"))
        unnamed = F.concat(F.lit("drive_"), F.col("place"))
        fallback = sanitize_for_path(base_name(F.rtrim(F.coalesce("h.root", unnamed), F.lit("/"))))
        rows = parsed.select("place", "h.*", F.coalesce(F.nullif("h.volumeName", F.lit("")), fallback).alias("drive"))
        heads = {row.place: row for row in rows.collect()}
    found, warnings = [], []
    for place, header in enumerate(headers):
        head = heads.get(place)
        if head is None:
            warnings.append(f"Missing scan {header}")
            continue
        folder = posixpath.dirname(header)
        stem = posixpath.basename(header).replace(".header.json", "")
        found.append(ScanSource(
            scan=header, ndjson=posixpath.join(folder, head.ndjson or f"{stem}.ndjson"),
            root=head.root, drive_name=head.drive, volume_uuid=head.volumeUUID, scan_order=place,
            errors=posixpath.join(folder, head.errors) if head.errors else None,
        ))
    return found, warnings


_TAGS = "key string, scan_order int, drive_name string, volume_uuid string, root string"


def _tags(source: ScanSource, path: str) -> tuple:
    return _path_key(path), source.scan_order, source.drive_name, source.volume_uuid, source.root


def read_scans(spark: SparkSession, headers: list[str]) -> tuple[DataFrame, list[ScanSource], list[str]]:
    """Records of the listed scans in one read, each tagged with its scan's place, drive and root.

    A scan is one file or a folder of parts. Missing data is an empty scan.
    The records are stored, so that ``ord`` is fixed.
    """
    sources, warnings = scan_sources(spark, headers)
    if not sources:
        raise ValueError("no readable scan")
    text = _text_of(spark, [s.ndjson for s in sources])
    return _in_line_order(spark, text, INVENTORY, [_tags(s, s.ndjson) for s in sources], _TAGS), sources, warnings


def ingest(files: DataFrame, path: str) -> DataFrame:
    """Store a scan union as Parquet by scan, where it stays and scans prune."""
    files.write.partitionBy("scan_order").parquet(path)
    return files.sparkSession.read.schema(files.schema).parquet(path)


def ingest_temporary(files: DataFrame) -> DataFrame:
    return materialize(files, "inventory")


def read_errors(spark: SparkSession, sources: list[ScanSource]) -> DataFrame | None:
    """Paths the scans could not read, in one read, or None when no scan has an error file."""
    named = [s for s in sources if s.errors]
    text = _text_of(spark, [s.errors for s in named]) if named else None
    return None if text is None else _in_line_order(spark, text, SCAN_ERROR, [_tags(s, s.errors) for s in named], _TAGS)


def normalize_record(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The five inventory columns; ``mtime`` floored to a whole millisecond."""
    name = base_name("path")
    return df.select(
        *(keep or []), name.alias("name"), "path", F.col("size").cast("long").alias("size"),
        F.floor("mtime").cast("long").alias("mtime"), file_ext(name).alias("ext"),
    )


def inventory_from_listing(
    listing: DataFrame, root: str, skip_time_machine: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """Inventory from a raw listing ``(path, kind, size, mtime)`` of any storage system."""
    wanted = regular_files(listing).filter(hygiene("path", F.lit(root), skip_time_machine))
    return normalize_record(wanted, keep)


def directory_count(listing: DataFrame, root: str, skip_time_machine: bool = True) -> DataFrame:
    """Folders a scan of ``root`` would visit, the root included."""
    folders = listing.filter("kind = 'dir'").filter(
        hygiene("path", F.lit(root), skip_time_machine, is_dir=F.lit(True)) & (F.col("path") != root))
    return folders.agg((F.count("*") + 1).alias("dir_count"))


def listing_from_files(spark: SparkSession, path: str) -> DataFrame:
    """Listing of files below ``path`` without reading their content.

    Spark hides names that start with a dot or an underscore, so rules on such
    names need a listing from elsewhere.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "length", "modificationTime")
    )
    local = F.regexp_replace("path", "^file:", "")
    return files.select(
        local.alias("path"), F.lit("file").alias("kind"), F.col("length").alias("size"),
        F.unix_millis("modificationTime").alias("mtime"))
