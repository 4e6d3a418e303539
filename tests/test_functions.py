import re

import pytest
from pyspark.sql import functions as F

from stowage.functions import buckets, globs, names


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


@pytest.mark.parametrize("name,ext", [
    ("a.b.C", "c"), (".bashrc", ""), ("foo.", ""), ("..foo", "foo"), ("..", ""), ("none", ""), ("A.JPG", "jpg")])
def test_file_ext(spark, name, ext):
    assert one(spark, names.file_ext("n"), n=name) == ext


@pytest.mark.parametrize("text,safe", [
    ("a/b:c", "a_b_c"), ('x<>|*?"y', "x_y"), ("    ", "unknown"), ("", "unknown"), (" My Drive ", "My Drive"), ("\\//", "_")])
def test_sanitize(spark, text, safe):
    assert one(spark, names.sanitize_for_path("t"), t=text) == safe


def test_paths(spark):
    p = "/Volumes/D/a/b/c.txt"
    assert one(spark, names.ancestors("p", "r"), p=p, r="/Volumes/D") == ["/Volumes/D/a", "/Volumes/D/a/b"]
    assert one(spark, names.ancestors("p", "r"), p="/x.txt", r="/") == []
    assert one(spark, names.ancestors("p", "r"), p="/e/x.txt", r="/") == ["/e"]
    assert [one(spark, names.path_depth("p"), p=x) for x in ("/", "/a", "//a//b/", "a/b")] == [0, 1, 2, 2]
    assert one(spark, names.mirrored_dst("d", "p", "r"), d="My:D", p=p, r="/Volumes/D/") == "My_D/a/b/c.txt"
    # A root that is only a prefix of another volume's name does not count.
    assert one(spark, names.mirrored_dst("d", "p", "r"), d="F", p="/Volumes/F 1/x", r="/Volumes/F") == "F/Volumes/F 1/x"
    assert one(spark, names.volume_of("p"), p="/Volumes/D") is None
    assert one(spark, names.volume_of("p", needs_child=False), p="/Volumes/D") == "/Volumes/D"
    assert one(spark, names.rebase_path("p", "d", "m"), p="/Volumes/F 1/x", d="F", m="/Volumes/G") == "/Volumes/F 1/x"
    assert one(spark, names.rebase_path("p", "d", "m"), p="/Volumes/F/x", d="F", m="/Volumes/F 1") == "/Volumes/F 1/x"
    assert one(spark, names.top_folder("p"), p=p) == "/Volumes/D/a"
    assert one(spark, names.utf16_length("p"), p="a😀") == 3


@pytest.mark.parametrize("path,uuid,drive,key", [
    ("/Users/me/x", "U", "D", "internal"), ("/Volumes/D/x", "U", "D", "U"), ("/Volumes/D/x", None, "N", "name:N"),
    ("/Volumes/D/x", "", None, "name:D"), ("/Volumes/", None, None, "name:unknown"), (None, "U", "D", "internal")])
def test_drive_key(spark, path, uuid, drive, key):
    assert one(spark, names.drive_key("p", "u", "d"), p=path, u=uuid, d=drive) == key


@pytest.mark.parametrize("glob,yes,no", [
    ("*.JPG", ["a.jpg", ".jpg"], ["a.jpeg", "a/b.jpg", "a.jpg\n"]),
    ("a?c", ["abc", "A.C"], ["ac", "a/c"]),
    ("*.{jpg, png}", ["x.png", "x.JPG"], ["x. png", "x.gif"]),
    ("{a*,b}.x", ["abc.x", "b.x"], ["bc.x"]),
    ("{a?}.x", ["ab.x"], ["a.x"]),
    ("a{b", ["a{b", "A{B"], ["ab"]),
    ("c++(1).[x]^$|", ["C++(1).[x]^$|"], ["c"]),
    ("", [""], ["a"]),
])
def test_globs(spark, glob, yes, no):
    rows = spark.createDataFrame([(x, True) for x in yes] + [(x, False) for x in no], "s string, want boolean")
    assert rows.filter(globs.glob_match("s", glob) != F.col("want")).collect() == []
    assert re.compile(globs.glob_to_regex(glob).replace("(?siu)", "(?si)").replace(r"\z", r"\Z"))


def test_buckets(spark):
    got = spark.createDataFrame([(n,) for n in (0, 1, 11, 12, 22, 23)], "n long").select(buckets.size_bucket("n"))
    assert [r[0] for r in got.collect()] == [0, 0, 3, 4, 4, 5]
    now = 1_705_320_000_000  # 2024-01-15 12:00 UTC, a Monday
    day = 86_400_000
    ages = [(now, "today"), (now - day, "this-month"), (now - 15 * day, "older"), (now - 14 * day, "this-month"),
            (now - 6 * 365 * day, "ancient")]
    rows = spark.createDataFrame(ages, "m long, want string")
    assert rows.filter(buckets.age_bucket("m", now) != F.col("want")).collect() == []


@pytest.mark.parametrize("text,size", [("1MB", 10**6), ("2.5GB", 25 * 10**8), ("1024", 1024), (" 3 kb ", 3000)])
def test_parse_size(text, size):
    assert buckets.parse_size(text) == size


def test_parse_size_refuses():
    assert buckets.parse_size("1kb", base=1024) == 1024
    with pytest.raises(ValueError):
        buckets.parse_size("big")


def test_mirrored_dst_collapses_mixed_runs_of_separators(spark):
    rows = [("D 1", "/v/a//./b/.//././c", "/v"), ("a:b", "/v//x/.y/./z", "/v//"), ("..", "/w/./.", "/v"), ("　", "/v", "/v")]
    frame = spark.createDataFrame(rows, "drive string, path string, root string")
    got = frame.select(names.mirrored_dst("drive", "path", "root").alias("dst"))
    assert [r.dst for r in got.collect()] == ["D 1/a/b/c", "a_b/x/.y/z", "../w/.", "unknown/"]
