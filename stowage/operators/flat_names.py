"""Names in a flat destination, where every file lands in one folder.

An entry gets its own name if that is free, else ``stem (2).ext``, ``(3)`` and
so on. The n-th request for a name therefore takes the n-th free slot of that
name, slot 1 being the name itself. Slots can be blocked by files already at
the destination, and by other entries that are *called* ``stem (2).ext``:
those hold their slot from their first request on.

So the work is split. How often a name is requested, and how many requests
came before a blocking one, are running counts over ranges, in which one name
may fill many tasks. Every blocked slot is a *mark* at the request from which
on it has to be passed. Slots blocked by files at the destination get theirs
from a window; where entries are called like numbered slots, distinct names are
streamed by slot number, with the request reached so far carried along, once
for each level of numbering. Requests and marks are then merged in order, and a
request's slot is its number plus the marks before it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.names import base_name, dotted_ext
from stowage.operators.skew import running_count
from stowage.session import materialize


def _parts(name: str) -> tuple[Column, Column]:
    ext = dotted_ext(name)
    return F.left(F.col(name), F.length(name) - F.length(ext)), ext


def numbered(name: Column, slot: Column) -> Column:
    """Name of a slot: the name itself, or with its number before the extension."""
    ext = dotted_ext(name)
    stem = F.left(name, F.length(name) - F.length(ext))
    return F.when(slot == 1, name).otherwise(F.concat(stem, F.lit(" ("), slot.cast("string"), F.lit(")"), ext))


def _numbering(names: DataFrame) -> DataFrame:
    """Adds the name of which this one is a numbered slot (``parent``, ``k``), and the unnumbered ``family``."""
    stem, ext = _parts("name")
    pattern = r"(?s)\A(.+) \(([1-9][0-9]*)\)\z"
    k = F.expr("try_cast(nullif(_k, '') as bigint)")
    return (
        names.withColumn("_k", F.regexp_extract(stem, pattern, 2))
        .withColumn("k", F.when(k >= 2, k))
        .withColumn("parent", F.when(F.col("k").isNotNull(), F.concat(F.regexp_extract(stem, pattern, 1), ext)))
        .withColumn("family", F.concat(F.regexp_replace(stem, r"(?: \([1-9][0-9]*\))+\z", ""), ext))
        .drop("_k")
    )


def _marks_past_existing(contended: DataFrame) -> DataFrame:
    """Marks ``(name, from_rank)`` where only files at the destination block slots."""
    taken = contended.filter("exists").select(F.explode(F.array(
        F.struct(F.col("name").alias("name"), F.lit(1).cast("long").alias("k")),
        F.struct(F.col("parent").alias("name"), F.col("k").alias("k")))).alias("s")).select("s.*")
    wanted = contended.filter("requests > 0").select("name")
    before = F.row_number().over(Window.partitionBy("name").orderBy("k")) - 1
    return taken.filter("name is not null and k is not null").join(wanted, "name", "left_semi").select(
        "name", (F.col("k") - before).cast("long").alias("from_rank"))


def _pass_slots(batches):
    """Marks of each name, and the numbered names it takes; rows come by name and slot."""
    name, requests, rank, slot = None, 0, 0, 0
    for batch in batches:
        out = []
        rows = zip(*(batch.column(c).to_pylist() for c in ("name", "k", "requests", "blocked", "earlier", "child")))
        for owner, k, wanted, blocked, earlier, child in rows:
            if child is None:
                name, requests, slot = owner, wanted, 2
                rank = 1 if blocked else 2
                if blocked:
                    out.append((owner, 1, None))
                continue
            reached = rank + k - slot
            if reached > requests:
                # All requests have their slot; the slots behind stay free.
                requests = 0
                continue
            rank, slot = reached, k + 1
            if blocked or (wanted > 0 and rank > earlier):
                out.append((owner, rank, None))
            else:
                out.append((owner, None, child))
                rank += 1
        yield pa.record_batch([pa.array([x[i] for x in out], kind) for i, kind in enumerate(
            (pa.string(), pa.int64(), pa.string()))], names=["name", "from_rank", "taken"])


def _marks_past_requests(facts: DataFrame) -> DataFrame:
    """Marks ``(name, from_rank)`` where entries are themselves called like numbered slots.

    A name is settled after the name whose slot it is, as that one may have
    taken it: one round for each level of ``x (2) (2) (2)``.
    """
    wanted = facts.filter("requests > 0")
    owners = wanted.join(wanted.select(F.col("name").alias("parent")), "parent", "left_anti").select(
        "name", "requests", F.col("exists").alias("blocked"))
    marks = None
    while True:
        first = owners.select("name", F.lit(1).cast("long").alias("k"), "requests", "blocked",
                              F.lit(0).cast("long").alias("earlier"), F.lit(None).cast("string").alias("child"))
        children = facts.filter("parent is not null").join(owners.select(F.col("name").alias("parent")), "parent").select(
            F.col("parent").alias("name"), "k", "requests", F.col("exists").alias("blocked"), "earlier",
            F.col("name").alias("child"))
        slots = first.unionByName(children).repartition("name").sortWithinPartitions("name", "k")
        passed = materialize(slots.mapInArrow(_pass_slots, "name string, from_rank long, taken string"), "slots")
        found = passed.filter("taken is null").select("name", "from_rank")
        marks = found if marks is None else marks.unionByName(found)
        taken = passed.filter("taken is not null").select(F.col("taken").alias("child"), F.lit(True).alias("_taken"))
        owners = materialize(children.filter("requests > 0").join(taken, "child", "left").select(
            F.col("child").alias("name"), "requests", (F.col("blocked") | F.col("_taken").isNotNull()).alias("blocked")), "owners")
        if owners.limit(1).count() == 0:
            return marks


def resolve_flat_names(
    entries: DataFrame, existing: DataFrame, order: list[str],
) -> DataFrame:
    """Adds ``dst_name`` to every entry.

    ``existing`` lists the names directly at the destination (``name``);
    ``order`` is the order in which entries are copied.
    """
    own = F.nullif(F.col("name"), F.lit("")) if "name" in entries.columns else F.lit(None)
    asked = entries.withColumn("_base", F.coalesce(own, base_name("src_path")))
    wanted = asked.groupBy(F.col("_base").alias("name")).agg(
        F.count("*").alias("requests"), F.min(F.struct(*order)).alias("first"))
    present = existing.select("name").distinct().withColumn("_exists", F.lit(True))
    names = _numbering(wanted.join(present, "name", "full").select(
        "name", F.coalesce("requests", F.lit(0)).alias("requests"), "first",
        F.coalesce("_exists", F.lit(False)).alias("exists")))
    names = materialize(names, "names")
    # Only families in which some requested name cannot simply be taken need settling.
    crowded = names.filter("requests > 1 or (requests > 0 and exists)").select("family").distinct()
    contended = materialize(names.join(crowded, "family", "left_semi"), "contended")
    # How many requests for a name came before the first request for one of its numbered slots.
    blockers = contended.filter("requests > 0 and parent is not null").select(
        F.col("parent").alias("_base"), "first.*", F.col("name").alias("_child"))
    requests = asked.withColumn("_child", F.lit(None).cast("string"))
    both = requests.unionByName(blockers, allowMissingColumns=True)
    ranked = running_count(both, "_base", order, F.col("_child").isNull(), "_rank")
    if blockers.limit(1).count() == 0:
        marks = _marks_past_existing(contended)
    else:
        ranked = materialize(ranked, "ranked")
        earlier = ranked.filter("_child is not null").select(F.col("_child").alias("name"), F.col("_rank").alias("earlier"))
        mixed = contended.filter("requests > 0 and parent is not null").select("family").distinct()
        facts = materialize(contended.join(mixed, "family", "left_semi").join(earlier, "name", "left").fillna(
            {"earlier": 0}), "facts")
        marks = _marks_past_existing(contended.join(mixed, "family", "left_anti")).unionByName(_marks_past_requests(facts))
    marks = materialize(marks.select(F.col("name").alias("_base"), F.col("from_rank").alias("_rank")), "marks")
    # Names without a mark keep their request number as slot; the others are merged with their marks in order.
    marked = marks.groupBy("_base").agg(F.lit(True).alias("_marked"))
    placed = ranked.filter("_child is null").drop("_child").join(marked, "_base", "left")
    merged = placed.filter("_marked").withColumn("_mark", F.lit(0)).unionByName(
        marks.withColumn("_mark", F.lit(-1)), allowMissingColumns=True)
    merged = running_count(merged, "_base", ["_rank", "_mark"], F.col("_mark") < 0, "_shift").filter("_mark = 0")
    plain = placed.filter("_marked is null").withColumn("_shift", F.lit(0).cast("long"))
    slots = plain.unionByName(merged.drop("_mark"))
    return slots.withColumn("dst_name", numbered(F.col("_base"), F.col("_rank") + F.col("_shift"))).select(
        *entries.columns, "dst_name")
