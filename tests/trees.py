"""Small inventories that several tests share."""


def tree(spark, paths, scan_order=0, drive="D", root="/Volumes/D", size=1):
    """An inventory of the given paths; ``(path, size)`` pairs set a size."""
    rows = []
    for n, item in enumerate(paths):
        path, bytes_ = item if isinstance(item, tuple) else (item, size)
        name = path.rsplit("/", 1)[-1]
        ext = name.rsplit(".", 1)[-1].lower() if "." in name[1:] else ""
        rows.append((scan_order, drive, root, n, name, path, bytes_, 1000 + n, ext))
    return spark.createDataFrame(
        rows, "scan_order int, drive_name string, root string, ord long, name string, path string, size long, mtime long, ext string")
