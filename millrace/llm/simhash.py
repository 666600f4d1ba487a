"""SimHash fingerprints, and all pairs of them within a few bits by a tree of vantage points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, pick
from .components import components

#: Shingles that are turned into bits at a time.
BLOCK = 1 << 14
ZERO = bytes(8)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, big end first: a bit is 1 if it is set in over half of the shingles' XXH64.

    Words are runs without ASCII white space, after A-Z are lower-cased; a text of fewer words than ``width`` is one
    shingle; one without words (or null) has the fingerprint zero.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return ZERO
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    ends = ends[width - 1 :].tolist()
    digest, counts = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(ends), BLOCK):
        raw = b"".join([digest(joined[a:b], seed) for a, b in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)])
        bits = np.unpackbits(np.frombuffer(raw, np.uint8)).reshape(-1, 64)
        counts += bits.sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(ends)).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp) for every row: the id, a hash of the text, the fingerprint as a signed long."""
    rows = pick(docs, doc_id=id_col, text=text_col)
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = b"".join([fingerprint(t.as_py()) for t in batch.column("text")])
            fps = np.frombuffer(raw, ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array(fps)], ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


class VantageTree:
    """A balanced tree of vantage points over 64-bit words, as arrays; leaves are numbered from 0.

    Node i has the children 2i + 1 (within ``radius[i]`` of ``point[i]``) and 2i + 2 (beyond). It is built from a
    bounded sample; any tree gives exact results, a fitting one only less work.
    """

    def __init__(self, sample: np.ndarray, depth: int, reach: int, seed: int = 1) -> None:
        self.depth, self.reach = depth, reach
        inner = (1 << depth) - 1
        self.point, self.radius = np.zeros(inner, np.uint64), np.zeros(inner, np.int64)
        rng, members = np.random.default_rng(seed), {0: sample}
        for i in range(inner):
            mine = members.pop(i)
            self.point[i], self.radius[i], near = split(mine, reach, rng)
            if 2 * i + 1 < inner:
                members[2 * i + 1], members[2 * i + 2] = mine[near], mine[~near]

    def route(self, fps: np.ndarray, home: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in ``fps``, leaf, home): each word's own leaf, and the leaves in which it is a guest.

        A word within ``reach`` of a home on the other side of a boundary must visit it. Of two words at home on both
        sides it is enough that the inner one visits. ``home`` is false for words that come as guests already: they
        visit every leaf that can have a partner, and are at home in none.
        """
        row, node, home = np.arange(len(fps)), np.zeros(len(fps), np.int64), np.ones(len(fps), bool) if home is None else home
        for _ in range(self.depth):
            far = np.bitwise_count(fps[row] ^ self.point[node]).astype(np.int64)
            near = far <= self.radius[node]
            inside = near | (~home & (far <= self.radius[node] + self.reach))
            outside = ~near | (far > self.radius[node] - self.reach)
            row, node, home = (
                np.concatenate((row[inside], row[outside])),
                np.concatenate((2 * node[inside] + 1, 2 * node[outside] + 2)),
                np.concatenate((home[inside] & near[inside], home[outside] & ~near[outside])),
            )
        return row, node - ((1 << self.depth) - 1), home


class Router:
    """A tree, and a second one below each of its leaves that has more than its share of rows.

    Leaf l of the tree keeps its number; leaf k of the tree below it has the number l + (k + 1) * 2 ** depth.
    """

    def __init__(self, tree: VantageTree) -> None:
        self.tree, self.below = tree, {}

    def route(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row, leaf, home = self.tree.route(fps)
        parts = [(row, leaf, home)]
        if self.below:
            divided = np.isin(leaf, list(self.below))
            parts = [(row[~divided], leaf[~divided], home[~divided])]
            for k in np.unique(leaf[divided]).tolist():
                mine = np.flatnonzero(leaf == k)
                at, lower, still = self.below[k].route(fps[row[mine]], home[mine])
                parts.append((row[mine][at], k + ((lower + 1) << self.tree.depth), still))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def split(fps: np.ndarray, reach: int, rng: np.random.Generator, tries: int = 8) -> tuple[np.uint64, int, np.ndarray]:
    """(vantage point, radius, who is within): the least crowded boundary that leaves 30 to 70 % within."""
    if not len(fps):
        return np.uint64(rng.integers(0, 1 << 63)), 31, np.zeros(0, bool)
    best = None
    for v in fps[rng.integers(0, len(fps), tries)]:
        upto = np.cumsum(np.bincount(np.bitwise_count(fps ^ v), minlength=65)) / len(fps)
        shell = upto - np.concatenate((np.zeros(reach), upto[:-reach] if reach else upto))
        for r in np.flatnonzero((upto >= 0.3) & (upto <= 0.7)) if ((upto >= 0.3) & (upto <= 0.7)).any() else [int(np.argmin(np.abs(upto - 0.5)))]:
            cost = shell[r] + (2 if not 0 < upto[r] < 1 else 0)
            if best is None or cost < best[0]:
                best = (cost, v, int(r))
    _, v, r = best
    return v, r, np.bitwise_count(fps ^ v) <= r


class Classes:
    """Union-find over places 0..n-1 that takes links as arrays."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def flatten(self) -> None:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return
            self.parent = up

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.flatten()
            a, b = self.parent[a], self.parent[b]
            apart = a != b
            low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            if not len(low):
                return
            np.minimum.at(self.parent, high, low)
            a, b = low, high


def link_leaf(fps: np.ndarray, home: np.ndarray, guest: np.ndarray, reach: int, classes: Classes, rng: np.random.Generator, small: int = 4096, level: int = 0) -> None:
    """Link all homes to each other and to guests within ``reach`` bits: a tree within the leaf, down to small blocks.

    home, guest: places in ``fps``. A split that separates little (a ball of near copies) is compared in blocks.
    """
    if len(home) > small and level < 24:
        v, r, near = split(fps[home], reach, rng)
        part = near.mean()
        if 0.1 <= part <= 0.9:
            far_home, far_guest = np.bitwise_count(fps[home] ^ v).astype(int), np.bitwise_count(fps[guest] ^ v).astype(int)
            crossing = near & (far_home > r - reach)
            if crossing.mean() < 0.6:
                link_leaf(fps, home[near], guest[far_guest <= r + reach], reach, classes, rng, small, level + 1)
                link_leaf(fps, home[~near], np.concatenate((guest[far_guest > r - reach], home[crossing])), reach, classes, rng, small, level + 1)
                return
    link_across(fps, home, np.concatenate((home, guest)), reach, classes)


def link_across(fps: np.ndarray, rows: np.ndarray, others: np.ndarray, reach: int, classes: Classes) -> None:
    """Link ``rows`` to ``others`` (both places in ``fps``) within ``reach`` bits, a block at a time.

    Most of a block of rows may be of one class by then, as in a ball of near copies; those are compared only with words
    that aren't of it yet.
    """
    for a in range(0, len(rows), 512):
        part = rows[a : a + 512]
        classes.flatten()
        roots = classes.parent[part]
        found, times = np.unique(roots, return_counts=True)
        main = found[np.argmax(times)]
        for mine, rest in ((part[roots == main], others[classes.parent[others] != main]), (part[roots != main], others)):
            for b in range(0, len(rest), 8192) if len(mine) else ():
                i, j = np.nonzero(np.bitwise_count(fps[mine][:, None] ^ fps[rest[b : b + 8192]][None, :]) <= reach)
                classes.add(mine[i], rest[b + j])


def lower_tree(sample: np.ndarray, parts: float, reach: int) -> VantageTree | None:
    """A tree that divides a leaf into about ``parts``, from a sample of its homes; None if it would divide little.

    It does if a part keeps over 60 % of the homes, or if homes become over two rows each: in a ball of near copies all
    are near each boundary.
    """
    if len(sample) < 64:
        return None
    tree = VantageTree(sample, min(max(1, int(np.ceil(np.log2(parts)))), 10), reach)
    _, leaf, home = tree.route(sample)
    return tree if np.bincount(leaf[home]).max() <= 0.6 * len(sample) and len(leaf) <= 2 * len(sample) else None


def linked(distinct: DataFrame, reach: int = 3, sample: int = 1 << 16, leaf: int = 1 << 18, depth: int = 6, least: int = 2048) -> DataFrame:
    """(u, v): links that join all fingerprints of ``distinct`` (fp, once each) that lie within ``reach`` bits.

    The tree comes from at most ``sample`` fingerprints (picked by a hash), its depth from the number of all:
    at least ``depth``, and more where leaves would hold over ``leaf``. Each leaf gives a spanning forest of its links,
    fewer rows than it has members, in place of the pairs. A leaf of over twice the mean of rows (and over ``least``) is
    divided by a tree of its own, from a sample of its homes. What no tree divides (a ball of near copies) is dealt by
    hash into blocks of about the mean, and each two blocks become a task: every pair still meets, and no task gets more
    than about twice the mean.
    """
    spark = distinct.sparkSession
    n = distinct.count()
    if n < 2:
        return spark.createDataFrame([], "u long, v long")

    def some(rows: DataFrame, total: int) -> DataFrame:
        # About a fifth more than is wanted pass the hash's filter, so that no task gathers a full sample from each other one.
        passed = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(min(1.0, 1.2 * sample / max(total, 1)) * (1 << 30))
        return rows.where(passed).withColumn("h", F.xxhash64("fp")).orderBy("h").limit(sample)

    first = np.array([r.fp for r in some(distinct, n).select("fp").collect()], np.int64).view(np.uint64)
    depth = min(max(depth, int(np.ceil(np.log2(n / leaf)))), int(np.log2(max(len(first) // 4, 2))))
    router = Router(VantageTree(first, depth, reach))

    def routed(router: Router) -> DataFrame:
        shared = spark.sparkContext.broadcast(router)

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fps = batch.column("fp").to_numpy(zero_copy_only=False)
                for at in range(0, len(fps), 1 << 16):
                    part = fps[at : at + (1 << 16)]
                    row, leaf, home = shared.value.route(part.view(np.uint64))
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(part[row]), pa.array(home)], ["leaf", "fp", "home"])

        return distinct.select("fp").mapInArrow(route, "leaf long, fp long, home boolean")

    def sizes(rows: DataFrame) -> tuple[list, int]:
        """(leaves of over twice the mean of rows, with their rows and homes; that mean): a row for each leaf at most."""
        found = rows.groupBy("leaf").agg(F.count_if("home").alias("homes"), F.count(F.lit(1)).alias("n")).collect()
        mean = max(least // 2, -(-sum(r.n for r in found) // max(len(found), 1 << depth)))
        return [r for r in found if r.n > 2 * mean], mean

    large, mean = sizes(routed(router))
    if large:
        places = spark.createDataFrame([(r.leaf,) for r in large], "leaf long")
        homes = routed(router).where("home").join(F.broadcast(places), "leaf")
        drawn = some(homes, sum(r.homes for r in large)).select("leaf", "fp").toArrow()
        of, fps = drawn.column("leaf").to_numpy(), drawn.column("fp").to_numpy().view(np.uint64)
        made = {r.leaf: lower_tree(fps[of == r.leaf], r.n / mean, reach) for r in large}
        router.below = {k: tree for k, tree in made.items() if tree is not None}
        if router.below:
            large, mean = sizes(routed(router))

    def solve(key, group):
        fps = group.column("fp").to_numpy().view(np.uint64)
        home = group.column("home").to_numpy(zero_copy_only=False)
        classes = Classes(len(fps))
        if key[1] == key[2]:
            link_leaf(fps, np.flatnonzero(home), np.flatnonzero(~home), reach, classes, np.random.default_rng(1))
        else:  # words of one block have met each other in a task of its own
            one = group.column("b").to_numpy() == key[1].as_py()
            link_across(fps, np.flatnonzero(home & one), np.flatnonzero(~one), reach, classes)
            link_across(fps, np.flatnonzero(home & ~one), np.flatnonzero(~home & one), reach, classes)
        classes.flatten()
        bound = classes.parent != np.arange(len(fps))
        return pa.table({"u": fps[bound].view(np.int64), "v": fps[classes.parent[bound]].view(np.int64)})

    parts = spark.createDataFrame([(r.leaf, -(-r.n // mean)) for r in large], "leaf long, blocks long")  # a row for each leaf at most
    rows = routed(router).join(F.broadcast(parts), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
    rows = rows.withColumn("b", F.pmod(F.xxhash64("fp"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = rows.select("leaf", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "fp", "home")
    # Work is far more than bytes here, so small partitions aren't to be put together: about one for each group.
    tasks = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), (1 << depth) + 4 * len(large)), 20_000)
    return dealt.repartition(tasks, "leaf", "i", "j").groupBy("leaf", "i", "j").applyInArrow(solve, "u long, v long")


def simhash_components(docs: DataFrame, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fp, component_id) for every row of ``docs``.

    Rows link if their fingerprints differ in ``reach`` bits or fewer; component_id is the smallest doc_id that can be
    reached over links (null ids are passed over; null if there is no other). Texts without words, null ones included,
    share the fingerprint zero and link like any other. An empty table gives an empty result. Equal fingerprints are
    one from the start: copies, however many, cost a row for each task. The join back is by fingerprint; a hot one is
    split by the skew join. So is a large component in the join by label, which takes two tables that are written: Spark
    doesn't split a join above an aggregate.
    """
    rows = checkpoint(fingerprints(docs, id_col, text_col))
    least = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = components(linked(least, reach))
    named = checkpoint(least.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("label", "fp").alias("label")))
    ids = checkpoint(named.groupBy("label").agg(F.min("least").alias("component_id")))
    of = named.join(ids, "label").select("fp", "component_id")
    return rows.join(of, "fp").select("doc_id", "text_key", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, reach: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (then of the smallest text hash).

    Of rows alike in id and text one stays. All columns are kept.
    """
    rows = simhash_components(docs, reach, id_col, text_col)
    group = F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.col("fp").cast("string")))
    first = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("text_key"))).alias("first")
    stay = rows.groupBy(group.alias("g")).agg(first).select(F.col("first.doc_id").alias("stay_id"), F.col("first.text_key").alias("stay_key"))
    names = docs.columns
    flat = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    doc_id, text = F.col(f"_c{names.index(id_col)}"), F.col(f"_c{names.index(text_col)}")
    keys = ["no_id", "id", "text_key"]  # join and window deal rows by the same keys, so texts move once
    flat = flat.withColumns({"no_id": doc_id.isNull(), "id": F.coalesce(doc_id.cast("string"), F.lit("")), "text_key": F.xxhash64(text)})
    stay = stay.select(F.col("stay_id").isNull().alias("no_id"), F.coalesce(F.col("stay_id").cast("string"), F.lit("")).alias("id"), F.col("stay_key").alias("text_key"))
    once = F.row_number().over(Window.partitionBy(*keys).orderBy("text_key"))
    return flat.join(stay, keys, "left_semi").withColumn("n", once).where("n = 1").select(*flat.columns[: len(names)]).toDF(*names)
