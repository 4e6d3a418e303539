"""Derived classes: file category, age, project size bucket, size literals."""

from __future__ import annotations

import re
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# File categories by extension.
CATEGORIES = {
    "image": "jpg jpeg png gif heic webp tif tiff bmp svg raw nef cr2 arw dng".split(),
    "video": "mp4 mov m4v avi mkv webm".split(),
    "audio": "mp3 wav aac flac m4a ogg aif aiff".split(),
    "document": "pdf doc docx xls xlsx ppt pptx txt md rtf csv pages".split(),
    "archive": "zip tar gz tgz bz2 7z rar dmg iso".split(),
    "code": "code py js ts java c cpp h go rs rb swift html css json sh sql".split(),
    "binary": "exe dll so dylib bin o".split(),
}
AGES = ("today", "this-week", "this-month", "this-year", "older", "ancient")


def category(ext="ext", table: dict[str, list[str]] | None = None) -> Column:
    ext = F.col(ext) if isinstance(ext, str) else ext
    out = None
    for label, exts in (table or CATEGORIES).items():
        out = (F if out is None else out).when(ext.isin(exts), F.lit(label))
    return out.otherwise(F.lit("other"))


def age_starts(now_ms: int) -> dict[str, int]:
    """First epoch millisecond (UTC) that still counts as each age, newest first."""
    now = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=now_ms)
    day = now.replace(hour=0, minute=0, second=0, microsecond=0)
    try:
        five = now.replace(year=now.year - 5)
    except ValueError:
        five = now.replace(year=now.year - 5, day=28)
    starts = (day, day - timedelta(days=day.weekday()), day.replace(day=1), day.replace(month=1, day=1), five)
    epoch = datetime(1970, 1, 1, tzinfo=timezone.utc)
    return {age: (at - epoch) // timedelta(milliseconds=1) for age, at in zip(AGES, starts)}


def age_bucket(mtime, now_ms: int) -> Column:
    """Calendar age of a file at ``now_ms``; plain comparisons on the stored long."""
    mtime = F.col(mtime) if isinstance(mtime, str) else mtime
    out = None
    for label, start in age_starts(now_ms).items():
        out = (F if out is None else out).when(mtime >= start, F.lit(label))
    return out.otherwise(F.lit("ancient"))


def size_bucket(file_count) -> Column:
    """Nearest power of two of a project's file count."""
    file_count = F.col(file_count) if isinstance(file_count, str) else file_count
    return F.floor(F.log2(F.greatest(file_count, F.lit(1))) + 0.5).cast("int")


_UNITS = {"": 0, "b": 0, "k": 1, "kb": 1, "m": 2, "mb": 2, "g": 3, "gb": 3, "t": 4, "tb": 4, "p": 5, "pb": 5}


def parse_size(text: str | int, base: int = 1000) -> int:
    """``1MB``, ``2.5GB`` or ``1024`` as bytes. A filter argument, so plain Python."""
    if isinstance(text, int):
        return text
    found = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([a-zA-Z]*)\s*", text)
    if not found or found[2].lower() not in _UNITS:
        raise ValueError(f"not a size: {text!r}")
    return round(float(found[1]) * base ** _UNITS[found[2].lower()])
