"""Documents whose sets of word shingles are similar, joined by signature trees.

Sets are joined exactly and never all with all:

1. Equal sets become one class. Classes that agree in several minimum hashes
   with the lead of those hashes are compared with it, so that dense groups
   grow together through few comparisons. The lead is the class whose rarest
   shingles are the most common: what an edit brings in is rare, so that is
   the one most others were made from.
2. The shingles of each set are ordered rare first (by counts over all texts in
   a fixed number of buckets; any order gives the same links). Two similar sets
   share some of the first shingles of either. Such a shingle that meets sets
   of different components makes a *cell* of these sets.
3. In a cell a signature tree is built: leaves are sets, inner nodes the OR of
   their children's token bitmaps with their ranges of sizes. Two trees (or one
   with itself) are descended together; a pair of nodes is left where sizes do
   not fit, where the bitmaps in common leave too small an overlap, or where
   both lie in one component. The rows of a very common shingle make several
   trees, which meet in pairs of fitting size and component.
4. Pairs of sets that remain are verified on their whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import runs
from stowage.llm.graph import components
from stowage.llm.tables import documents, numbered, partitions
from stowage.session import materialize

SHINGLE = 4  # words
SIMILAR = (85, 100)  # intersection to union, as a fraction
BUCKETS = 1 << 16  # of the shingle counts that order shingles
KEYS, AGREE = 4, 2  # minimum hashes of a set, and how many must agree to be compared early
WIDTH = 1024  # bits of a token bitmap
LARGE = 1024  # shingles beyond which bitmaps fill up, so that more than one shared shingle is asked for
FAN = 8  # children of a tree node
TILE = 512  # sets of a tree
SLICE = 4096  # node pairs descended at once
TOGETHER = 2000  # sets compared with one other in one task
SMALL = 1 << 18  # rows that may be broadcast (32 bytes each)

_MASK = np.uint64(BUCKETS - 1)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z in lower case."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(size + 1) - 1
    begin = (end - size).tolist()
    end = end.tolist()[shingle - 1:] or [len(joined)]
    hashed = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((hashed(joined[a:z]) for a, z in zip(begin, end)), np.uint64, len(end)))


def shared_at_least(n: int) -> int:
    """How many of the first shingles a set of ``n`` must share with one as large."""
    return 1 if n <= LARGE else 1 + n // 16


def first_shingles(n: int, similar: tuple[int, int] = SIMILAR) -> int:
    """Similar sets share ``shared_at_least`` of so many of their first shingles, in any common order."""
    part, whole = similar
    return min(n, n + part * n // -whole + shared_at_least(n))


def _texts(docs: DataFrame, *more: Column | str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), *more)


def bucket_counts(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Shingles of all texts by hash bucket. What comes to the driver is one number a bucket."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            data, offsets = runs.texts(batch)
            for low, high in runs.packs(offsets):
                found = [shingle_hashes(data[a:z].tobytes(), shingle) & _MASK
                         for a, z in zip(offsets[low:high], offsets[low + 1:high + 1])]
                total += np.bincount(np.concatenate(found).astype(np.int64), minlength=BUCKETS)
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counted = _texts(docs).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    return out


def bitmap(hashes: np.ndarray) -> bytes:
    bits = np.zeros(WIDTH, bool)
    bits[((hashes >> np.uint64(40)) % np.uint64(WIDTH)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def sets(docs: DataFrame, counts: np.ndarray, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """One row per row of ``docs``: its set's size, digest, minimum hashes, first shingles, their commonness, bitmap."""
    known = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        order = known.value
        for batch in batches:
            data, offsets = runs.texts(batch)
            columns: tuple[list, ...] = ([], [], [], [], [], [])
            for a, z in zip(offsets, offsets[1:]):
                h = shingle_hashes(data[a:z].tobytes(), shingle)
                if not len(h):
                    row = (0, None, None, None, None, None)
                else:
                    often = order[(h & _MASK).astype(np.int64)]
                    rare = np.lexsort((h, often))[:first_shingles(len(h), similar)]
                    row = (len(h), xxhash.xxh3_128_digest(h.tobytes()),
                           [int(runs.mix(h ^ s).min()) >> 1 for s in _SEEDS[:KEYS]], h[rare].view(np.int64),
                           float(np.log(often[rare]).mean()), bitmap(h))
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64(), pa.binary())
            yield pa.record_batch(
                [batch.column("doc_id"), batch.column("text_hash")] + [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=["doc_id", "text_hash", "n", "set", "keys", "first", "common", "bits"])

    return _texts(docs, F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n long, set binary, keys array<long>, first array<long>, common double, bits binary")


# ---- verification ---------------------------------------------------------------------------------------------------

def _similar(a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> bool:
    part, whole = similar
    if min(len(a), len(b)) * whole < max(len(a), len(b)) * part:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * whole >= (len(a) + len(b) - both) * part


def verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, similar: tuple[int, int]) -> DataFrame:
    """The pairs ``a, b`` of sets that are similar, by their whole texts.

    Texts come to the task of ``b``, which reads its text first and then one
    ``a`` after the other. Where many sets are compared with one, they are dealt
    to several tasks, each with that one's text.
    """
    pairs = materialize(pairs.select("a", "b").distinct(), "pairs")
    tasks = pairs.groupBy("b").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    others = pairs.join(tasks, "b").select(
        F.col("a").alias("set"), F.col("b").alias("lead"), F.pmod(F.xxhash64("a"), "parts").alias("part"))
    leads = tasks.select(F.col("b").alias("set"), F.col("b").alias("lead"),
                         F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    wanted = others.unionByName(leads).join(classes.select("set", "origin"), "set").select(
        F.col("origin.doc_id").alias("from_id"), F.col("origin.text_hash").alias("from_hash"), "set", "lead", "part")
    wanted = materialize(wanted, "wanted")
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    texts = _texts(docs, F.xxhash64("text").alias("text_hash"))
    rows = texts.join(wanted, (F.col("text_hash") == F.col("from_hash")) & F.col("doc_id").eqNullSafe(F.col("from_id")))
    rows = rows.select("set", "lead", "part", "text", (F.col("set") != F.col("lead")).alias("other"))
    dealt = rows.repartition(partitions(docs.sparkSession), "lead", "part").sortWithinPartitions(
        "lead", "part", "other", "set")

    def run(batches):
        lead = held = None
        for batch in batches:
            data, offsets = runs.texts(batch)
            out = []
            for n, (name, one) in enumerate(zip(batch.column("lead").to_pylist(), batch.column("set").to_pylist())):
                if name == lead and one == lead:
                    continue
                hashes = shingle_hashes(data[offsets[n]:offsets[n + 1]].tobytes(), shingle)
                if one == name:
                    lead, held = name, hashes
                elif _similar(held, hashes, similar):
                    out.append((one, name))
            yield pa.record_batch([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def early_pairs(classes: DataFrame) -> DataFrame:
    """Sets that agree in ``AGREE`` minimum hashes with the lead of each of them."""
    keyed = classes.select("set", "common", F.posexplode("keys").alias("place", "key"))
    leads = keyed.groupBy("place", "key").agg(F.max(F.struct("common", "set"))["set"].alias("lead"))
    return keyed.join(leads, ["place", "key"]).filter("set <> lead").groupBy("set", "lead").count().filter(
        F.col("count") >= AGREE).select(F.col("set").alias("a"), F.col("lead").alias("b"))


# ---- signature trees ------------------------------------------------------------------------------------------------

class Trees:
    """Signature trees over consecutive rows, one a group, all of one height.

    ``levels[0]`` are the rows. A node knows the OR of the bitmaps below it, the
    least and greatest size, the most tokens that share a bit with another
    token of their set, and the range of components.
    """

    def __init__(self, group: np.ndarray, bits: np.ndarray, size: np.ndarray, component: np.ndarray) -> None:
        hidden = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, hidden, component, component)]
        self.children: list[np.ndarray] = []
        while True:
            starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
            if len(starts) == len(group):
                break
            first = np.flatnonzero(place % FAN == 0)
            bits, low, high, hidden, least, most = self.levels[-1]
            self.children.append(np.append(first, len(group)))
            self.levels.append((
                np.bitwise_or.reduceat(bits, first, axis=0), np.minimum.reduceat(low, first),
                np.maximum.reduceat(high, first), np.maximum.reduceat(hidden, first),
                np.minimum.reduceat(least, first), np.maximum.reduceat(most, first)))
            group = group[first]
        self.groups = group  # of each root

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> np.ndarray:
        part, whole = similar
        bits, low, high, hidden, least, most = self.levels[level]
        fits = (high[a] * whole >= low[b] * part) & (high[b] * whole >= low[a] * part)
        fits &= (least[a] != most[a]) | (least[b] != most[b]) | (least[a] != least[b])
        a, b = a[fits], b[fits]
        # The greatest overlap: each bit in common one token, and tokens hidden behind another's bit.
        overlap = np.bitwise_count(bits[a] & bits[b]).sum(axis=1, dtype=np.int64) + np.minimum(hidden[a], hidden[b])
        out = np.flatnonzero(fits)
        return out[overlap * (part + whole) >= (low[a] + low[b]) * part]

    def meet(self, a: np.ndarray, b: np.ndarray, similar: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs that may be similar below the pairs of roots ``a, b``; a root may meet itself."""
        todo = [(len(self.levels) - 1, a, b)]
        while todo:
            level, a, b = todo.pop()
            if len(a) > SLICE:
                todo.append((level, a[SLICE:], b[SLICE:]))
                a, b = a[:SLICE], b[:SLICE]
            if level == 0:
                other = a != b
                a, b = a[other], b[other]
            keep = self._possible(level, a, b, similar)
            a, b = a[keep], b[keep]
            if not len(a):
                continue
            if level == 0:
                yield a, b
                continue
            cut = self.children[level - 1]
            wide, deep = cut[a + 1] - cut[a], cut[b + 1] - cut[b]
            n = wide * deep
            pair = np.repeat(np.arange(len(a)), n)
            place = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
            x, y = cut[a][pair] + place // deep[pair], cut[b][pair] + place % deep[pair]
            once = (a[pair] != b[pair]) | (x <= y)
            todo.append((level - 1, x[once], y[once]))


def _whole_cells(batches) -> Iterator[pa.Table]:
    """Tables that end where a cell ends; ``cell`` numbers change with the cell."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        cell = _cells(table)
        last = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and rest.num_rows:
        yield rest


def _cells(table: pa.Table) -> np.ndarray:
    new = np.zeros(table.num_rows, bool)
    for name in ("token", "i", "j"):
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def tree_pairs(cells: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """``a, b, need``: pairs of sets of a cell that its trees do not rule out. Rows come sorted by cell and side."""
    def run(batches):
        for table in _whole_cells(batches):
            cell, side = _cells(table), table.column("side").to_numpy().astype(np.int64)
            raw = b"".join(table.column("bits").to_pylist())
            trees = Trees(cell * 2 + side, np.frombuffer(raw, np.uint64).reshape(-1, WIDTH // 64),
                          table.column("n").to_numpy(), table.column("mark").to_numpy())
            roots = np.arange(len(trees.groups))
            other = (trees.groups[1:] // 2 == trees.groups[:-1] // 2)
            alone = np.ones(len(roots), bool)
            alone[1:] &= ~other
            alone[:-1] &= ~other
            a = np.concatenate((roots[alone], roots[:-1][other]))
            b = np.concatenate((roots[alone], roots[1:][other]))
            names, need = table.column("set").combine_chunks(), table.column("need").to_numpy()
            for x, y in trees.meet(a, b, similar):
                yield pa.record_batch([names.take(pa.array(x)), names.take(pa.array(y)),
                                       pa.array(np.minimum(need[x], need[y]))], names=["a", "b", "need"])

    found = cells.mapInArrow(run, "a binary, b binary, need long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need").groupBy("a", "b").agg(
        F.count("*").alias("shared"), F.min("need").alias("need")).filter("shared >= need").select("a", "b")


def open_cells(members: DataFrame, classes: DataFrame, similar: tuple[int, int]) -> DataFrame:
    """Rows ``token, i, j, side, set, n, need, mark, bits`` of shingles that meet sets of different components.

    ``classes`` has ``set, n, bits, code`` (a hash of the set) and ``mark`` (a
    hash of its component). Equal hashes of different sets only add rows.
    """
    postings = members.select(F.xxhash64("set").alias("code"), F.explode("first").alias("token"))

    def differ(rows: DataFrame, column: str) -> DataFrame:
        return rows.groupBy("token").agg(F.min(column).alias("low"), F.max(column).alias("high")).filter(
            "low <> high").select("token")

    several = postings.join(differ(postings, "code"), "token", "left_semi").distinct()
    several = materialize(several.join(classes.select("code", "mark").distinct(), "code"), "postings")
    rows = several.join(differ(several, "mark"), "token", "left_semi").select("token", "code")
    need = F.when(F.col("n") <= LARGE, F.lit(1)).otherwise(F.expr("1 + n div 16")).cast("long").alias("need")
    counted = rows.groupBy("token").agg(F.count("*").alias("rows"))
    rows = materialize(rows.join(counted, "token"), "open")
    info = classes.select("code", "set", "n", need, "mark", "bits")
    tiny = rows.filter(F.col("rows") <= TILE).join(info, "code").select(
        "token", F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(0).alias("side"),
        "set", "n", "need", "mark", "bits")

    # Tiles of a common shingle hold like sizes, then like components, so that most pairs of tiles need no look.
    part, whole = similar
    step = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(whole / part)))
    large = rows.filter(F.col("rows") > TILE).join(info.drop("bits"), "code").withColumn("step", step)
    large = numbered(large, ["token"], ["step", "mark", "n", "set"], "place")
    large = materialize(large.withColumn("tile", F.floor(F.col("place") / TILE)), "tiles")
    tiles = large.groupBy("token", "tile").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.min("mark").alias("least"), F.max("mark").alias("most"))
    one = tiles.select("token", *[F.col(c).alias(f"{c}_i") for c in ("tile", "low", "high", "least", "most")])
    two = tiles.select("token", *[F.col(c).alias(f"{c}_j") for c in ("tile", "low", "high", "least", "most")])
    met = one.join(two, "token").filter(
        (F.col("tile_i") <= F.col("tile_j"))
        & (F.col("high_i") * whole >= F.col("low_j") * part) & (F.col("high_j") * whole >= F.col("low_i") * part)
        & ~((F.col("least_i") == F.col("most_i")) & (F.col("least_j") == F.col("most_j"))
            & (F.col("least_i") == F.col("least_j"))))
    met = met.select("token", F.col("tile_i").alias("i"), F.col("tile_j").alias("j"))
    sides = met.select("token", "i", "j", F.col("i").alias("tile"), F.lit(0).alias("side")).unionByName(
        met.filter("i < j").select("token", "i", "j", F.col("j").alias("tile"), F.lit(1).alias("side")))
    common = large.join(sides, ["token", "tile"]).join(classes.select("set", "bits"), "set").select(*tiny.columns)
    return tiny.unionByName(common).repartition(
        partitions(members.sparkSession), "token", "i", "j").sortWithinPartitions("token", "i", "j", "side")


def similar_sets(docs: DataFrame, shingle: int = SHINGLE, similar: tuple[int, int] = SIMILAR) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id``.

    A document's set holds its distinct runs of ``shingle`` words (A-Z in lower
    case, cut at ASCII white space), the whole sequence if it has fewer. Two
    documents link if ``whole * intersection >= part * union`` for ``similar =
    (part, whole)``. ``component_id`` is the smallest id that links reach; null
    ids come last, a component of null ids alone has a null one. Null texts and
    texts without words have no shingles, link with nothing and keep their own
    id. Rows that repeat are in one component; ids that repeat are rows like
    others; texts are taken whole; other columns are ignored; an empty table
    gives an empty result. Shingles are told apart by 64-bit hashes, sets by
    128-bit ones.
    """
    part, whole = similar
    if not 0 < part <= whole:
        raise ValueError("the similarity is above 0 and at most 1")
    members = materialize(sets(docs, bucket_counts(docs, shingle), shingle, similar), "sets")
    full = members.filter("n > 0")
    classes = materialize(full.groupBy("set").agg(
        F.first("n").alias("n"), F.min("doc_id").alias("low"),
        F.min(F.struct("doc_id", "text_hash")).alias("origin"),
        F.first("keys").alias("keys"), F.first("common").alias("common"), F.first("bits").alias("bits")), "classes")
    links = materialize(verified(docs, classes, early_pairs(classes), shingle, similar), "links")
    grown = materialize(_with_roots(classes, links), "grown")
    marked = grown.select("set", "n", "bits", F.xxhash64("set").alias("code"), F.xxhash64("root").alias("mark"))
    pairs = tree_pairs(open_cells(full, marked, similar), similar)
    links = links.unionByName(verified(docs, classes, pairs, shingle, similar))
    roots = materialize(_with_roots(classes.select("set", "low"), links), "roots")
    smallest = roots.groupBy("root").agg(F.min("low").alias("component_id"))
    named = roots.join(smallest, "root").select("set", "component_id")
    empty = F.col("set").isNull()
    return members.select("doc_id", "n", "set").join(named, "set", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def _with_roots(rows: DataFrame, links: DataFrame) -> DataFrame:
    found = components(links).select(F.col("node").alias("set"), "root")
    return rows.join(found, "set", "left").withColumn("root", F.coalesce("root", "set"))


def op12_signature_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_sets(documents(spark, sf_dir))


QUERIES = {"op12_signature_join": op12_signature_join}
SQL: dict[str, str] = {}
