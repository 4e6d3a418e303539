"""Totals and breakdowns. Every one is a map-side combined aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.buckets import age_bucket, category
from stowage.functions.names import top_folder
from stowage.operators.dedup import KEY

ERROR_SAMPLE = 50


def bytes_of(column: str = "size") -> Column:
    return F.coalesce(F.sum(column), F.lit(0)).cast("long")


def bytes_if(condition: Column, column: str = "size") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0)).cast("long")


def scan_totals(files: DataFrame, errors: DataFrame | None = None, by: str = "scan_order") -> DataFrame:
    """Files and bytes per scan; with errors also their count and the first 50 of them."""
    totals = files.groupBy(by).agg(F.count("*").alias("file_count"), bytes_of().alias("total_bytes"))
    if errors is None:
        return totals
    counts = errors.groupBy(by).agg(F.count("*").alias("error_count"))
    first = Window.partitionBy(by).orderBy("ord")
    sample = (
        errors.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= ERROR_SAMPLE)
        .groupBy(by).agg(F.sort_array(F.collect_list(F.struct("_n", "path", "error"))).alias("_s"))
        .select(by, F.transform("_s", lambda e: F.struct(e["path"].alias("path"), e["error"].alias("error")))
                .alias("errors_sample"))
    )
    return (
        totals.join(counts, by, "full").join(sample, by, "left")
        .select(by, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("file_count", "total_bytes", "error_count")],
                "errors_sample")
    )


def breakdown(files: DataFrame, now_ms: int) -> DataFrame:
    """Files and bytes by category, by age, by extension and by top folder in one pass."""
    tagged = files.select(
        "size", F.coalesce("ext", F.lit("")).alias("ext"), category("ext").alias("category"),
        age_bucket("mtime", now_ms).alias("age"), top_folder("path").alias("top_folder"),
    )
    dims = ["category", "age", "ext", "top_folder"]
    grouped = tagged.groupingSets([[F.col(d)] for d in dims], *dims).agg(
        F.grouping_id().alias("_g"), F.count("*").alias("files"), bytes_of().alias("bytes"),
    )
    # Bit i of the grouping id is 0 for the one dimension that is kept.
    masks = {d: 0b1111 ^ (1 << (len(dims) - 1 - i)) for i, d in enumerate(dims)}
    name = F.coalesce(*[F.when(F.col("_g") == m, F.lit(d)) for d, m in masks.items()])
    value = F.coalesce(*[F.when(F.col("_g") == m, F.col(d)) for d, m in masks.items()])
    return grouped.select(name.alias("dimension"), value.alias("value"), "files", "bytes")


def top_values(report: DataFrame, dimension: str, n: int) -> DataFrame:
    """Largest values of one breakdown dimension by bytes."""
    return report.filter(F.col("dimension") == dimension).orderBy(F.desc("bytes"), "value").limit(n)


def largest_files(files: DataFrame, n: int) -> DataFrame:
    return files.orderBy(F.desc("size"), "path").limit(n)


def facets(files: DataFrame, wanted_category: str | None = None) -> DataFrame:
    """Values the filter panel can offer: top folders, and extensions of the chosen category."""
    folders = files.groupBy(top_folder("path").alias("value")).agg(F.count("*").alias("files"))
    exts = files if wanted_category is None else files.filter(category("ext") == wanted_category)
    exts = exts.groupBy(F.coalesce("ext", F.lit("")).alias("value")).agg(F.count("*").alias("files"))
    return folders.select(F.lit("top_folder").alias("facet"), "value", "files").unionByName(
        exts.select(F.lit("ext").alias("facet"), "value", "files"))


def duplicate_summary(files: DataFrame) -> DataFrame:
    """Number of duplicate groups, of extra copies, and the bytes those take."""
    groups = files.withColumn("ext", F.coalesce("ext", F.lit(""))).groupBy(*KEY).agg(F.count("*").alias("n"))
    extra = F.col("n") - 1
    return groups.filter("n > 1").agg(
        F.count("*").alias("groups"),
        F.coalesce(F.sum(extra), F.lit(0)).cast("long").alias("extra_copies"),
        F.coalesce(F.sum(extra * F.coalesce("size", F.lit(0))), F.lit(0)).cast("long").alias("reclaimable_bytes"),
    )


def status_counts(entries: DataFrame) -> DataFrame:
    """Entries per status, and a row for all of them."""
    status = F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown"))
    return entries.select(status.alias("status")).rollup("status").agg(
        F.grouping("status").alias("_g"), F.count("*").alias("entries"),
    ).select(F.when(F.col("_g") == 1, F.lit("(total)")).otherwise(F.col("status")).alias("status"), "entries")


def plan_totals(entries: DataFrame) -> DataFrame:
    """Totals a freshly built plan states in its header."""
    status = F.col("status")
    return entries.agg(
        F.count_if(status == "pending").alias("total_files"),
        bytes_if(status == "pending").alias("total_bytes"),
        F.count_if(status == "skipped-duplicate").alias("duplicates_collapsed"),
        F.count_if(status == "skipped-project-duplicate").alias("project_duplicates_collapsed"),
        F.count_if(status == "source-error").alias("error_count"),
    )


def recompute_totals(entries: DataFrame) -> DataFrame:
    """Totals after a change: copied files still count; project duplicates are not counted again."""
    kept = F.col("status").isin("pending", "copied")
    return entries.agg(
        F.count_if(kept).alias("total_files"), bytes_if(kept).alias("total_bytes"),
        F.count_if(F.col("status") == "skipped-duplicate").alias("duplicates_collapsed"),
        F.count_if(F.col("status") == "source-error").alias("error_count"),
    )


def rule_stats(projects: DataFrame) -> DataFrame:
    """Kept and collapsed projects under the rule name of the project that won."""
    return projects.groupBy(F.col("winner_rule").alias("rule_name")).agg(
        F.count_if(F.col("is_winner")).alias("kept"), F.count_if(~F.col("is_winner")).alias("collapsed"),
    )
