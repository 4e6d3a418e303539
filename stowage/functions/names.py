"""Column functions over file names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VOLUMES = "/Volumes/"


def _col(value) -> Column:
    return value if isinstance(value, Column) else F.col(value)


def base_name(path) -> Column:
    """Last segment of a path."""
    return F.substring_index(_col(path), "/", -1)


def file_ext(name) -> Column:
    """Lower-case extension without the dot; a name that only starts with a dot has none."""
    return F.regexp_extract(F.lower(_col(name)), r"(?s)^.+\.([^.]*)$", 1)


def dotted_ext(name) -> Column:
    """Extension as written, with its dot (empty when there is none)."""
    return F.regexp_extract(_col(name), r"(?s)^.+(\.[^.]*)$", 1)


def dupe_key(size="size", name="name", ext="ext") -> Column:
    """Printable form of the duplicate key. Group on the three columns, not on this."""
    return F.concat_ws("::", _col(size).cast("string"), _col(name), F.coalesce(_col(ext), F.lit("")))


def sanitize_for_path(text) -> Column:
    """Make a name safe as one folder name on common destination file systems."""
    plain = _col(text).rlike(r"\A[A-Za-z0-9_.-]+\z")
    flat = F.regexp_replace(_col(text), r'[/\\:*?"<>|]+', "_")
    space = r"[\s\x{FEFF}&&[^\x85]]+"
    trimmed = F.regexp_replace(flat, rf"(?U)\A{space}|{space}\z", "")
    return F.when(plain, _col(text)).otherwise(F.coalesce(F.when(trimmed != "", trimmed), F.lit("unknown")))


def clean_path(path) -> Column:
    """Path with one slash between segments and none at the end; the root itself becomes empty."""
    path = _col(path)
    messy = F.contains(path, F.lit("//")) | F.endswith(path, F.lit("/"))
    return F.when(messy, F.regexp_replace(F.regexp_replace(path, "/+", "/"), r"/\z", "")).otherwise(path)


def segments(path) -> Column:
    """Non-empty path segments."""
    return F.filter(F.split(_col(path), "/"), lambda part: part != "")


def path_depth(path) -> Column:
    """Number of non-empty segments, counted by slashes so that it stays in generated code."""
    clean = clean_path(F.concat(F.lit("/"), _col(path)))
    clean = F.regexp_replace(clean, r"\A/{2,}", "/")
    return F.length(clean) - F.length(F.replace(clean, F.lit("/"), F.lit("")))


def at_depth(path, depth) -> Column:
    """The first ``depth`` segments of a clean absolute path."""
    cut = F.substring_index if isinstance(depth, int) else None
    if cut is not None:
        return cut(_col(path), "/", depth + 1)
    return F.call_function("substring_index", _col(path), F.lit("/"), (depth + 1).cast("int"))


def parent(path) -> Column:
    """Folder of a clean absolute path."""
    path = _col(path)
    return F.left(path, F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)


def ancestors(path, root) -> Column:
    """Folders that hold ``path``: from just below ``root`` down to the file's own folder."""
    clean, top, own = clean_path(path), path_depth(root), path_depth(path) - 1
    chain = F.transform(F.sequence(top + 1, own), lambda d: at_depth(clean, d))
    return F.when(own > top, chain).otherwise(F.array().cast("array<string>"))


def rel_path(path, folder) -> Column:
    """Part of ``path`` after ``folder/``."""
    return F.substr(_col(path), F.length(_col(folder)) + 2)


def open_ended(folder) -> Column:
    """A folder without slashes at its end; few have any, and looking for them costs more than one look."""
    folder = _col(folder)
    return F.when(F.endswith(folder, F.lit("/")), F.rtrim(folder, F.lit("/"))).otherwise(folder)


def under(path, folder) -> Column:
    """True when ``path`` is ``folder`` or lies below it, on a segment boundary."""
    stem = open_ended(folder)
    return (_col(path) == stem) | F.startswith(_col(path), F.concat(stem, F.lit("/")))


def joined_dst(drive, path, root) -> Column:
    """``<drive>/<path below the scan root>`` with separators as they come."""
    slash = F.lit("/")
    below = F.when(under(path, root), F.substr(_col(path), F.length(open_ended(root)) + 1)).otherwise(_col(path))
    return F.concat_ws("/", sanitize_for_path(drive), F.ltrim(below, slash))


def one_separator(path) -> Column:
    """``path`` with repeated separators collapsed."""
    return F.regexp_replace(_col(path), r"/(?:\.?/)+", "/")


def repeats_separator(path) -> Column:
    """True where ``one_separator`` changes a path."""
    return F.contains(_col(path), F.lit("//")) | F.contains(_col(path), F.lit("/./"))


def mirrored_dst(drive, path, root) -> Column:
    """``<drive>/<path below the scan root>`` with repeated separators collapsed."""
    return one_separator(joined_dst(drive, path, root))


def flat_dst(path) -> Column:
    return base_name(path)


def volume_of(path, needs_child: bool = True) -> Column:
    """``/Volumes/<x>`` prefix, or null on the internal disk."""
    pattern = r"(?s)^(/Volumes/[^/]+)/" if needs_child else r"(?s)^(/Volumes/[^/]*)"
    found = F.regexp_extract(_col(path), pattern, 1)
    return F.when(found != "", found)


def drive_key(path="src_path", uuid="volume_uuid", drive="drive_name") -> Column:
    """Key under which the entries of one source drive are copied together."""
    named = F.nullif(_col(drive), F.lit(""))
    segment = F.nullif(F.regexp_extract(_col(path), r"^/Volumes/([^/]+)", 1), F.lit(""))
    return (
        F.when(~F.coalesce(F.startswith(_col(path), F.lit(VOLUMES)), F.lit(False)), F.lit("internal"))
        .when(F.coalesce(_col(uuid), F.lit("")) != "", _col(uuid))
        .otherwise(F.concat(F.lit("name:"), F.coalesce(named, segment, F.lit("unknown"))))
    )


def rebase_path(path, drive, mount) -> Column:
    """Move ``path`` from ``/Volumes/<drive>`` to the place the drive is mounted now."""
    old = F.concat(F.lit(VOLUMES), _col(drive))
    moved = F.concat(_col(mount), F.substr(_col(path), F.length(old) + 1))
    return F.when(under(path, old) & (_col(mount) != old), moved).otherwise(_col(path))


def top_folder(path) -> Column:
    """First three segments of an absolute path."""
    return F.array_join(F.slice(F.split(_col(path), "/"), 1, 4), "/")


def utf16_length(text) -> Column:
    """Length in UTF-16 units, the length the shortest-path tie-break compares."""
    return (F.octet_length(F.encode(_col(text), "UTF-16BE")) / 2).cast("int")


def signature_item(rel, size) -> Column:
    return F.concat(_col(rel), F.lit(":"), F.coalesce(_col(size), F.lit(0)).cast("string"))


def has_segment(path, names) -> Column:
    """True when any segment of ``path`` is one of ``names`` (exact match)."""
    if not names:
        return F.lit(False)
    # Every segment begins behind a slash then, which is found faster than a choice.
    return F.concat(F.lit("/"), _col(path)).rlike(r"(?s)/(?:" + "|".join(map(_literal, names)) + r")(?:/|\z)")


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_-" or ord(c) > 127 else "\\" + c for c in text)
