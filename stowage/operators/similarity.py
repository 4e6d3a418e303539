"""Groups of near-identical projects by exact Jaccard similarity of their items.

Only projects of the same rule and of the same size bucket are compared.

Comparing all pairs is avoided in four steps, none of which loses a pair:

1. Projects with equal signatures are collapsed to one representative, after
   their items were compared with those of the representative.
2. Items are ranked from rare to common. Two sets with similarity ``t`` or more
   share an item among the first ``n - ceil(t * n) + 1`` of each (prefix
   filtering: Chaudhuri et al. 2006, Bayardo et al. 2007). Only those items
   enter the index. Items that no other project has cannot match and only use
   up the prefix.
3. Candidates must agree in length (``t * larger <= smaller``) and in a 256-bit
   parity sketch: every item in which two sets differ flips one bit, so the
   number of different bits is a lower bound of their difference.
4. What is left is counted exactly. Items are stored once as sorted arrays by
   project, cut into parts by hash, and merged part by part; sides of different
   size meet because a part of the smaller one covers whole parts of the larger.
   An item is a number there: a hash, where no other item has it (``coded``).

All of this works on items that were folded first (``folded``): those that the
same projects hold count alike in every comparison, so they become one item
with a weight. That takes one shuffle of all item texts, and what is left grows
with the ways in which projects share items, not with their files.

Projects that differ only in items nobody else has share all their links, so
after step 1 the index holds one of each such core (``collapse_cores``).

An index item shared by many projects does not become all pairs. Its members
are compared with one pivot; members that end up in one component need no
further comparison, as grouping is transitive. Only members of different
components go on, to the next pivot and finally to a tiled comparison in which
no task sees more than one tile pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.functions.buckets import size_bucket
from stowage.operators.components import connected_components
from stowage.operators.skew import pick_first, with_group
from stowage.session import materialize

SKETCH = ["s0", "s1", "s2", "s3"]
PAIR_GROUP = 24      # members of an index item that are compared directly
TILE = 2_000         # members per tile of a large index item
PART = 4_096         # items of one array, about
CODE_BITS = 63       # of an item's hash; negative numbers are for items whose hash another item has
RANGE_BITS = 6       # of a token: the ranges in which the items of a project are ranked
PIVOT_ROUNDS = 4
SLACK = 1e-9         # widens the filters against rounding; the exact test decides


def jaccard(shared: Column, na: Column, nb: Column) -> Column:
    """Similarity from the overlap and both sizes; two empty sets are not alike."""
    union = na + nb - shared
    return F.when(union > 0, shared / union).otherwise(F.lit(0.0))


def signatures(projects: DataFrame, items: DataFrame, blocking: bool = True) -> DataFrame:
    """Size, content hashes, sketch and comparison block of every project, from ``folded`` items."""
    facts = items.groupBy("project_key").agg(
        F.sum("weight").alias("n"),
        F.bit_xor(F.xxhash64(F.lit("a"), "item")).alias("h1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "item", F.xxhash64("item"))).alias("h2"),
        *[F.bit_xor(name).alias(name) for name in SKETCH],
    )
    block = F.struct("rule_id", size_bucket("file_count").alias("bucket")) if blocking else F.struct(
        F.lit("all").alias("rule_id"), F.lit(0).alias("bucket"))
    keyed = projects.select("project_key", block.alias("block"))
    filled = {"n": 0, "h1": 0, "h2": 0, **dict.fromkeys(SKETCH, 0)}
    return keyed.join(facts, "project_key", "left").fillna(filled)


def coded(items: DataFrame) -> DataFrame:
    """``items`` with texts turned into longs that only equal items share. ``items`` is read twice.

    Item texts meet once, to find hashes that several of them have; those items
    are numbered. What follows moves and compares eight bytes an item.
    """
    code = F.shiftrightunsigned(F.xxhash64(F.lit("code"), "item"), 64 - CODE_BITS)
    texts = items.select("item", code.alias("code"))
    clashes = materialize(
        texts.distinct().groupBy("code").agg(F.count("*").alias("_n")).filter("_n > 1").select("code"), "clashes")
    if clashes.limit(1).count() == 0:
        return items.withColumn("item", code)
    # Stored, so that a number cannot change between its uses.
    numbered = materialize(texts.join(clashes, "code", "left_semi").select("item").distinct().withColumn(
        "_number", -1 - F.monotonically_increasing_id()), "numbered")
    return materialize(items.join(numbered, "item", "left").withColumn(
        "item", F.coalesce("_number", code)).select(items.columns), "codes")


def number_repeats(items: DataFrame) -> DataFrame:
    """Item texts in which the second and further ones of a project have texts of their own, alike in all projects."""
    counted = items.groupBy("project_key", "item").agg(F.count("*").alias("_n"))
    each = counted.select("project_key", "item", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int"))).alias("_k"))
    text = F.coalesce(F.concat(F.lit(":"), "item"), F.lit(""))
    return each.select("project_key", F.concat(F.col("_k").cast("string"), text).alias("item"))


def folded(items: DataFrame) -> DataFrame:
    """``(project_key, item, weight, repeats, s0..s3)``: the items that the same projects hold as one of them, stored.

    ``item`` stands for the set of projects, ``weight`` is how many items they
    hold, and the sketch is that of all of them; ``repeats`` tells that a
    project lists an item more than once, which makes the others wrong. Sets of
    projects are told apart by their number and two 64-bit hashes. Item texts
    are shuffled and sorted once, by a hash and by themselves.
    """
    dealt = items.select("project_key", "item").repartition("item").withColumn("_h", F.xxhash64("item"))
    # Sorted before the window needs it, so that hashes of projects are not sorted with them.
    dealt = dealt.sortWithinPartitions("_h", "item", "project_key").withColumns({
        "_a": F.xxhash64(F.lit("a"), "project_key"), "_b": F.xxhash64(F.lit("b"), "project_key")})
    one = Window.partitionBy("_h", "item").orderBy("project_key")
    every = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    held = dealt.select(
        "project_key", "_h", (F.lag("project_key").over(one) == F.col("project_key")).alias("_again"),
        F.count("*").over(every).alias("_by"), F.bit_xor("_a").over(every).alias("_by1"),
        F.bit_xor("_b").over(every).alias("_by2"))
    # Each item flips one of 256 bits, spread over four longs.
    sketch = [
        F.expr(f"bit_xor(if(pmod(_h, 4) = {i}, shiftleft(1L, cast(pmod(shiftright(_h, 2), 64) as int)), 0L))")
        .alias(name) for i, name in enumerate(SKETCH)
    ]
    alike = held.groupBy("project_key", "_by", "_by1", "_by2").agg(
        F.count("*").alias("weight"), F.coalesce(F.max("_again"), F.lit(False)).alias("repeats"), *sketch)
    named = alike.withColumn("item", F.concat_ws(":", *[F.col(c).cast("string") for c in ("_by", "_by1", "_by2")]))
    return materialize(named.drop("_by", "_by1", "_by2"), "folded")


def _parts(n: Column) -> Column:
    """Arrays that the ``n`` items of a project are cut into: a power of two."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(n / F.lit(PART), F.lit(1))))).cast("long")


def item_store(sigs: DataFrame, items: DataFrame) -> DataFrame:
    """``(project_key, part, level, items)``: the items of every project as sorted arrays of bounded size.

    An item counts ``2 ** level`` where it stands. One with a weight stands in
    the levels that add up to it, the same in every project.
    """
    level = F.lit(0)
    if "weight" in items.columns:
        bits = F.filter(F.sequence(F.lit(0), F.floor(F.log2("weight")).cast("int")),
                        lambda i: F.getbit("weight", i) == 1)
        level = F.explode(F.when(F.col("weight") == 1, F.array(F.lit(0))).otherwise(bits))
    sized = items.withColumn("level", level).join(sigs.select("project_key", "n"), "project_key")
    # The part takes its hash with a seed of its own, unlike the shuffle's and the sketch's.
    part = F.pmod(F.xxhash64(F.lit("part"), "item"), _parts(F.col("n")))
    # Dealt first: map tasks have nothing to combine, as an item comes once in a project.
    dealt = sized.select("project_key", part.alias("part"), "level", "item").repartition("project_key", "part")
    return dealt.groupBy("project_key", "part", "level").agg(F.sort_array(F.collect_set("item")).alias("items"))


def stored_items(store: DataFrame) -> DataFrame:
    return store.select("project_key", "level", F.explode("items").alias("item"))


def collapse_equal(sigs: DataFrame, store: DataFrame) -> DataFrame:
    """Adds ``twin``: the first project with the same items (itself when there is no other).

    Size and hashes only propose a twin; the items decide. A project whose
    items turn out to be others stands for itself. Projects without items are
    alike to nothing, not even to each other. ``sigs`` and ``store`` must be
    stored tables.
    """
    full, empty = sigs.filter("n > 0"), sigs.filter("n = 0")
    marked = with_group(full, ["block", "n", "h1", "h2"], {"first": F.min("project_key")})
    proposed = marked.filter("first <> project_key").select(
        F.col("first").alias("a"), F.col("project_key").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    equal = verify(proposed, store, 1.0).select(F.col("b").alias("project_key"), F.col("a").alias("_first"))
    twins = full.join(equal, "project_key", "left").withColumn("twin", F.coalesce("_first", "project_key"))
    return twins.drop("_first").unionByName(empty.withColumn("twin", F.col("project_key")))


def _weight() -> Column:
    return F.pow(F.lit(2), F.col("level")).cast("long")


def _shared_items(reps: DataFrame, items: DataFrame) -> DataFrame:
    """``(project_key, token, weight, df)`` of the items that more than one representative has, stored."""
    level = F.col("level") if "level" in items.columns else F.lit(0)
    rows = items.withColumn("level", level).join(reps.select("project_key", "block"), "project_key")
    # Two items with one token only add candidates, which the exact count then refuses.
    token = F.xxhash64("block.rule_id", "block.bucket", "item", "level")
    rows = rows.select("project_key", token.alias("token"), _weight().alias("weight"))
    return materialize(with_group(rows, ["token"], {"df": F.count("*")}).filter("df > 1"), "shared")


def collapse_cores(reps: DataFrame, shared: DataFrame, store: DataFrame) -> DataFrame:
    """Representatives that share items, with ``n_shared`` and ``core``: the first with the same size and shared items.

    An item nobody else has is in no overlap, so projects of one core are
    similar to the same others, and all or none of them to each other. Hashes
    propose a core; the items decide: what two projects have in common is
    shared, so they share the same items if the overlap has as many as each.
    """
    facts = shared.groupBy("project_key").agg(
        F.sum("weight").alias("n_shared"), F.bit_xor(F.xxhash64(F.lit("a"), "token")).alias("c1"),
        F.bit_xor(F.xxhash64(F.lit("b"), "token")).alias("c2"))
    full = materialize(reps.join(facts, "project_key"), "sharing")
    marked = with_group(full, ["block", "n", "n_shared", "c1", "c2"], {"first": F.min("project_key")})
    proposed = marked.filter("first <> project_key").select(
        F.col("first").alias("a"), F.col("project_key").alias("b"), F.col("n").alias("na"), F.col("n").alias("nb"))
    met = overlaps(proposed, store).select(F.col("a").alias("_first"), F.col("b").alias("project_key"), "shared")
    core = F.when(F.col("shared") == F.col("n_shared"), F.col("_first")).otherwise(F.col("project_key"))
    return materialize(full.join(met, "project_key", "left").withColumn("core", core).drop("_first", "shared", "c1", "c2"), "cores")


def _prefix_index(cores: DataFrame, shared: DataFrame, t: float) -> DataFrame:
    """``(token, project_key, n, sketch)`` for the rare-first prefix of the first project of every core.

    Items are ranked by how many projects have them and then by token, in
    ranges of tokens that are counted, so nothing sorts the items of a project.
    A prefix ends with its last range: a longer one is still exact.
    """
    # Items nobody else has come first in the ranking, so they shorten what is left to take.
    left = F.col("n") - F.ceil(F.lit(t) * F.col("n") - SLACK) + 1 - (F.col("n") - F.col("n_shared"))
    taking = cores.filter("project_key = core").withColumn("_left", left).filter("_left > 0")
    rows = shared.withColumn("_range", F.shiftrightunsigned("token", 64 - RANGE_BITS))
    counts = rows.join(taking.select("project_key", "_left"), "project_key").groupBy(
        "project_key", "_left", "df", "_range").agg(F.sum("weight").alias("_n"))
    before = Window.partitionBy("project_key").orderBy("df", "_range").rowsBetween(Window.unboundedPreceding, -1)
    last = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).filter("_before < _left").groupBy(
        "project_key").agg(F.max(F.struct("df", "_range")).alias("_last"))
    # Stored: one row a project, so its size decides whether the items need a shuffle to meet it.
    facts = materialize(taking.select("project_key", "n", *SKETCH).join(last, "project_key"), "taken")
    taken = rows.join(facts, "project_key").filter(F.struct("df", "_range") <= F.col("_last"))
    return materialize(taken.select("token", "project_key", "n", *SKETCH), "prefixes")


def _could_match(t: float, a: str = "a", b: str = "b") -> Column:
    """Length and sketch filter on two sides named ``a`` and ``b``."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    differing = reduce(lambda x, y: x + y, [
        F.bit_count(F.col(f"{a}.{s}").bitwiseXOR(F.col(f"{b}.{s}"))) for s in SKETCH])
    most = F.lit((1 - t) / (1 + t)) * (na + nb) + 1e-6
    return (F.least(na, nb) >= F.lit(t) * F.greatest(na, nb) - SLACK) & (differing <= most)


def _side(rows: DataFrame) -> Column:
    return F.struct("project_key", "n", *SKETCH)


def _pairs_of(candidates: DataFrame, t: float) -> DataFrame:
    ordered = F.when(F.col("a.project_key") < F.col("b.project_key"), F.struct("a", "b")).otherwise(
        F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    kept = candidates.filter((F.col("a.project_key") != F.col("b.project_key")) & _could_match(t))
    return kept.select(ordered.alias("p")).select(
        F.col("p.a.project_key").alias("a"), F.col("p.b.project_key").alias("b"),
        F.col("p.a.n").alias("na"), F.col("p.b.n").alias("nb")).distinct()


def _direct_pairs(index: DataFrame, t: float) -> DataFrame:
    """Pairs inside index items with few members."""
    members = index.filter("members <= {}".format(PAIR_GROUP)).select("token", _side(index).alias("r"))
    left, right = members.withColumnRenamed("r", "a"), members.withColumnRenamed("r", "b")
    joined = left.join(right, "token").filter("a.project_key < b.project_key")
    return _pairs_of(joined, t)


def _tiled_pairs(index: DataFrame, t: float) -> DataFrame:
    """Pairs of different components inside index items with many members, tile by tile."""
    tiles = F.ceil(F.col("members") / TILE).cast("int")
    rows = index.select("token", "comp", tiles.alias("tiles"), _side(index).alias("r")).withColumn(
        "tile", F.pmod(F.xxhash64("r.project_key"), F.col("tiles")).cast("int"))
    left = rows.select("token", "comp", F.col("r").alias("a"), F.col("tile").alias("ta"),
                       F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("tb"))
    right = rows.select("token", F.col("comp").alias("comp_b"), F.col("r").alias("b"), F.col("tile").alias("tb"),
                        F.explode(F.sequence(F.lit(0), F.col("tile"))).alias("ta"))
    # The size of an exploded side is that of its files to the planner, so it could be broadcast.
    joined = left.join(right.hint("merge"), ["token", "ta", "tb"]).filter(
        "comp <> comp_b and (ta <> tb or a.project_key < b.project_key)")
    return _pairs_of(joined, t)


def overlaps(pairs: DataFrame, store: DataFrame) -> DataFrame:
    """Pairs ``(a, b, na, nb)`` with ``shared``, the number of items both have.

    Parts are counted by powers of two of one hash, so part ``p`` of the side
    with more parts lies inside part ``p`` modulo its number of the other. The
    joins are never broadcast: items that repeat are far larger than their files.
    Only projects of a pair leave the store.
    """
    pairs = materialize(pairs.select("a", "b", "na", "nb"), "proposed")
    pa, pb = _parts(F.col("na")), _parts(F.col("nb"))
    spread = pairs.select("a", "b", "na", "nb", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(pa, pb) - 1)).alias("p"))
    spread = spread.select("a", "b", "na", "nb", F.pmod("p", pa).alias("part_a"), F.pmod("p", pb).alias("part_b"))
    mine = store.select(F.col("project_key").alias("a"), F.col("part").alias("part_a"), "level", F.col("items").alias("items_a")).join(
        pairs.select("a").distinct(), "a", "left_semi")
    theirs = store.select(F.col("project_key").alias("b"), F.col("part").alias("part_b"), "level", F.col("items").alias("items_b")).join(
        pairs.select("b").distinct(), "b", "left_semi")
    met = spread.join(mine.hint("merge"), ["a", "part_a"]).join(theirs.hint("merge"), ["b", "part_b", "level"])
    return met.groupBy("a", "b", "na", "nb").agg(
        F.sum(F.size(F.array_intersect("items_a", "items_b")) * _weight()).alias("shared"))


def verify(pairs: DataFrame, store: DataFrame, t: float) -> DataFrame:
    """Candidate pairs ``(a, b, na, nb)`` whose exact similarity reaches ``t``, with that similarity."""
    scored = overlaps(pairs, store).withColumn("similarity", jaccard(F.col("shared"), F.col("na"), F.col("nb")))
    return scored.filter(F.col("similarity") >= F.lit(t)).select("a", "b", "similarity")


def _prepared(projects: DataFrame, items: DataFrame, blocking: bool) -> tuple[DataFrame, DataFrame]:
    """Signatures with verified twins, and the item store."""
    few = folded(items)
    if few.filter("repeats").limit(1).count():
        few = folded(number_repeats(items))
    few = coded(few)
    plain = materialize(signatures(projects, few, blocking), "sizes")
    store = materialize(item_store(plain, few), "items")
    return materialize(collapse_equal(plain, store), "signatures"), store


def _indexed(reps: DataFrame, items: DataFrame, store: DataFrame, t: float) -> tuple[DataFrame, DataFrame]:
    """Cores, and the index items that several of them have, with their number of ``members``."""
    shared = _shared_items(reps, items)
    cores = collapse_cores(reps, shared, store)
    index = with_group(_prefix_index(cores, shared, t), ["token"], {"members": F.count("*")})
    return cores, materialize(index.filter("members > 1"), "index")


def _within() -> Column:
    """Similarity of two projects of one core."""
    return jaccard(F.col("n_shared"), F.col("n"), F.col("n"))


def _alike(t: float) -> Column:
    return _within() >= F.lit(t)


def similar_groups(
    projects: DataFrame, items: DataFrame, threshold: float = 0.9, blocking: bool = True,
) -> DataFrame:
    """``(project_key, component)``: the transitive groups of similar projects, singletons included.

    An item that a project lists twice counts twice; ``items`` is read again then.
    """
    t = threshold or 0.9
    sigs, store = _prepared(projects, items, blocking)
    reps = sigs.filter("project_key = twin and n > 0")
    cores, index = _indexed(reps, stored_items(store), store, t)
    found = materialize(verify(_direct_pairs(index, t), store, t).select("a", "b"), "pairs")
    crowded = index.filter(F.col("members") > PAIR_GROUP)
    if crowded.limit(1).count():
        found = _crowded_edges(crowded, found, store, t)
    twins = sigs.filter("project_key <> twin").select(F.col("twin").alias("a"), F.col("project_key").alias("b"))
    # A core that is similar to another, or within itself, is one component.
    linked = found.select(F.explode(F.array("a", "b")).alias("core")).unionByName(
        cores.filter(_alike(t)).select("core")).distinct()
    others = cores.filter("project_key <> core").join(linked, "core", "left_semi").select(
        F.col("core").alias("a"), F.col("project_key").alias("b"))
    edges = found.unionByName(twins).unionByName(others)
    nodes = sigs.select(F.col("project_key").alias("node"))
    groups = connected_components(edges, nodes)
    return groups.withColumnRenamed("node", "project_key")


def _labelled(rows: DataFrame, edges: DataFrame) -> DataFrame:
    """Index rows with the component of their project, without items that need no more comparing."""
    labels = connected_components(edges, None).withColumnRenamed("node", "project_key")
    tagged = rows.join(labels, "project_key", "left").withColumn("comp", F.coalesce("component", "project_key"))
    spans = with_group(tagged.drop("component"), ["token"], {"lo": F.min("comp"), "hi": F.max("comp")})
    return spans.filter("lo <> hi").drop("lo", "hi")


def _crowded_edges(
    crowded: DataFrame, found: DataFrame, store: DataFrame, t: float,
) -> DataFrame:
    """Similar pairs inside index items with many members, as far as grouping needs them."""
    edges = found
    rows = crowded
    for _ in range(PIVOT_ROUNDS):
        side = F.struct("project_key", "n", *SKETCH)
        marked = materialize(pick_first(
            rows.select("token", "project_key", "n", *SKETCH, "members"), ["token"],
            [F.col("project_key")], {"pivot": side}), "pivots")
        stars = marked.filter("not is_winner").select(F.col("pivot").alias("a"), side.alias("b"))
        good = verify(_pairs_of(stars, t), store, t).select("a", "b")
        edges = materialize(edges.unionByName(good), "pairs")
        # A pivot has met every member of its item; it needs no further look there.
        rest = marked.filter("not is_winner").drop("is_winner", "pivot")
        rows = materialize(_labelled(rest, edges), "open")
        if rows.limit(1).count() == 0:
            return edges
    sized = with_group(rows.drop("members"), ["token"], {"members": F.count("*")})
    last = verify(_tiled_pairs(sized, t), store, t).select("a", "b")
    return edges.unionByName(last)


def similar_classes(
    projects: DataFrame, items: DataFrame, threshold: float = 0.9, blocking: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Every link between projects, with equal projects named once.

    Two tables. Members, one row per project: ``project_key, class_key`` (the
    first project with the same items), ``class_size`` and ``n_links``, the
    number of other projects similar to it. Pairs ``a, b, similarity`` between
    the ``class_key`` of different classes. Two projects are similar if they
    have one class or their classes are a pair; a project without items is in
    a class of its own without links. An item that a project lists twice counts
    twice; ``items`` is read again then.
    """
    t = threshold or 0.9
    sigs, store = _prepared(projects, items, blocking)
    reps = sigs.filter("project_key = twin and n > 0")
    cores, index = _indexed(reps, stored_items(store), store, t)
    between = materialize(verify(_tiled_pairs(index.withColumn("comp", F.col("project_key")), t), store, t), "core_pairs")
    sizes = materialize(sigs.groupBy(F.col("twin").alias("class_key")).agg(F.count("*").alias("class_size")), "classes")
    held = cores.select(F.col("project_key").alias("class_key"), "core", "n", "n_shared").join(sizes, "class_key")
    weights = materialize(held.groupBy("core", "n", "n_shared").agg(F.sum("class_size").alias("weight")), "weights")
    both = between.select(F.col("a").alias("core"), F.col("b").alias("other")).unionByName(
        between.select(F.col("b").alias("core"), F.col("a").alias("other")))
    others = both.join(weights.select(F.col("core").alias("other"), "weight"), "other").groupBy("core").agg(
        F.sum("weight").alias("_outside"))
    around = weights.join(others, "core", "left").select(
        "core", (F.coalesce("_outside", F.lit(0)) + F.when(_alike(t), F.col("weight")).otherwise(0)).alias("_near"),
        _alike(t).alias("_alike"))
    linked = held.select("class_key", "core", "class_size").join(around, "core").select(
        "class_key", (F.col("_near") - F.when(F.col("_alike"), F.col("class_size")).otherwise(0)).alias("_outside"))
    facts = sizes.join(linked, "class_key", "left").withColumn(
        "n_links", F.col("class_size") - 1 + F.coalesce("_outside", F.lit(0)))
    members = sigs.select("project_key", F.col("twin").alias("class_key")).join(facts, "class_key")
    inside = weights.filter(_alike(t)).select(F.col("core").alias("a"), F.col("core").alias("b"), _within().alias("similarity"))
    pairs = _spelled_out(between.unionByName(inside), cores.select("core", "project_key"))
    return members.select("project_key", "class_key", "class_size", "n_links"), pairs


def _spelled_out(links: DataFrame, members: DataFrame) -> DataFrame:
    """Pairs of projects for links ``(a, b, similarity)`` between cores, tile by tile; a core may be linked with itself."""
    sized = materialize(with_group(members, ["core"], {"_m": F.count("*")}).withColumn(
        "tiles", F.ceil(F.col("_m") / TILE).cast("int")).drop("_m"), "members")
    tiles = sized.select("core", "tiles").distinct()
    tile = F.pmod(F.xxhash64(F.lit("tile"), "project_key"), F.col("tiles")).cast("int")
    spread = links.join(tiles.select(F.col("core").alias("a"), F.col("tiles").alias("_na")), "a").join(
        tiles.select(F.col("core").alias("b"), F.col("tiles").alias("_nb")), "b")
    spread = spread.withColumn("ta", F.explode(F.sequence(F.lit(0), F.col("_na") - 1))).withColumn(
        "tb", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))).drop("_na", "_nb")
    keys = ["a", "b", "ta", "tb"]
    mine = spread.join(sized.select(F.col("core").alias("a"), tile.alias("ta"), F.col("project_key").alias("x")), ["a", "ta"])
    theirs = spread.select(keys).join(
        sized.select(F.col("core").alias("b"), tile.alias("tb"), F.col("project_key").alias("y")), ["b", "tb"])
    joined = mine.join(theirs.hint("merge"), keys).filter("a <> b or x < y")
    return joined.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")


def similar_pairs(
    projects: DataFrame, items: DataFrame, threshold: float = 0.9, blocking: bool = True,
) -> DataFrame:
    """All similar pairs ``(a, b, similarity)``, equal projects included.

    This writes out the classes of ``similar_classes``, so the result itself is
    quadratic in the size of a group of copies; use that function, or
    ``similar_groups`` where only the groups matter.
    """
    members, pairs = similar_classes(projects, items, threshold, blocking)
    members = materialize(members.select("project_key", "class_key"), "members")
    mine = members.select(F.col("class_key").alias("ca"), F.col("project_key").alias("x"))
    theirs = members.select(F.col("class_key").alias("cb"), F.col("project_key").alias("y"))
    equal = mine.join(theirs, F.col("ca") == F.col("cb")).filter("x < y").select("x", "y", F.lit(1.0).alias("similarity"))
    across = pairs.join(mine, F.col("a") == F.col("ca")).join(theirs, F.col("b") == F.col("cb"))
    return equal.unionByName(across.select("x", "y", "similarity")).select(
        F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
