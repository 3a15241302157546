"""Near-duplicate records by an LSH forest: several sorted signature orders, cut at a depth that suits each region.

Every record stands in each tree's order, sorted by its signature there; records with a common signature prefix, a region,
are neighbours and are held against each other with a sketch that never loses a link; what remains is checked exactly. The
number of records gives the first depth, and the depth the number of trees, so that a pair at the threshold meets in some
tree with a chance of 1 - LOSS at any size. Regions that are crowded there go deeper: each is sorted anew in as many orders
as keep that chance, as long as this saves comparisons, and is compared in full, block by block, where it doesn't.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.operators.components import connected_components
from skein.session import cut

#: Records a region holds on average at the first depth, at most, and records from which a region is crowded; a crowded region
#: is also what a block of a full comparison holds.
LEAF, CROWD = 1024, 4096
#: The chance to lose a pair at the threshold at the first depth and at each further one.
LOSS = 0.001
#: The share of unlike records that agree at one level, roughly: for words, and for vectors in 64 dimensions.
WORDS_ALIKE, VECTORS_ALIKE = 1 / 12, 1 / 128
#: Directions of a cross-polytope hash at most, bits of a word sketch, levels a crowded region may go deeper.
DIRECTIONS, SKETCH_BITS, LEVELS = 64, 128, 16

FOREST = "key long, cls long, top long, side int, sketch binary"


def trees_for(agree: float, depth: int) -> int:
    """The trees in which a pair that agrees at a level with chance ``agree`` meets at ``depth`` but for LOSS."""
    return max(1, math.ceil(math.log(LOSS) / math.log1p(-min(agree**depth, 1 - 1e-9))))


def depth_for(records: int, alike: float) -> int:
    """The least depth at which regions hold LEAF records on average, if unlike records agree with chance ``alike``."""
    return max(1, math.ceil(math.log(max(1.0, records / LEAF)) / -math.log(alike)))


def vectors_agree(cosine: float) -> float:
    """The chance that two vectors of this cosine have one cross-polytope hash, by a simulation that is always the same."""
    rng = np.random.default_rng(11)
    x, z = rng.standard_normal((2, 20_000, DIRECTIONS))
    y = cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * z
    i, j, at = np.abs(x).argmax(axis=1), np.abs(y).argmax(axis=1), np.arange(len(x))
    return float(np.mean((i == j) & (np.sign(x[at, i]) == np.sign(y[at, j]))))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return x


def _rows(cls: pa.Array, top: np.ndarray, keys: list[np.ndarray], sketch: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The records of a batch once a tree: (key, cls, top, side, sketch)."""
    n, width = sketch.shape
    data = pa.py_buffer(np.ascontiguousarray(sketch).tobytes())
    offsets = pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    binary = pa.BinaryArray.from_buffers(pa.binary(), n, [None, offsets, data])
    for key in keys:
        cols = [pa.array(key.view(np.int64)), cls, pa.array(top), pa.array(np.zeros(n, dtype=np.int32)), binary]
        yield pa.RecordBatch.from_arrays(cols, names=["key", "cls", "top", "side", "sketch"])


def _keys(top: np.ndarray, signature: Callable[[int], np.ndarray], trees: int, depth: int, tag: int) -> list[np.ndarray]:
    """For each tree the hash of a record's first ``depth`` signature values, told apart by the region they are in."""
    out = []
    for t in range(trees):
        key = _mix(top.view(np.uint64) ^ np.uint64(((1 + t) * 7919 + tag * 104_729) & (2**63 - 1)))
        for d in range(depth):
            key = _mix(key ^ (_mix(signature(t * depth + d)) + np.uint64(d)))
        out.append(key)
    return out


def word_forest(trees: int, depth: int, level: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the forest from (cls, top, words: hashes of a record's distinct words): minimum hashes; the sketch is the number
    of words and a set of bits."""
    rng = np.random.default_rng([20_240_601, level])
    seeds = rng.integers(1, 2**63, trees * depth, dtype=np.uint64) | np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column("words")
            flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            sizes = words.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bits = np.zeros((len(sizes), SKETCH_BITS), dtype=bool)
            bits[np.repeat(np.arange(len(sizes)), sizes), (_mix(flat) >> np.uint64(40)).astype(np.int64) % SKETCH_BITS] = True
            sketch = np.concatenate([sizes.astype(np.float32)[:, None].view(np.uint8), np.packbits(bits, axis=1)], axis=1)
            top = batch.column("top").to_numpy(zero_copy_only=False).astype(np.int64)

            def signature(i: int, flat=flat, starts=starts) -> np.ndarray:
                return np.minimum.reduceat(_mix(flat ^ seeds[i]) * (seeds[i] * np.uint64(2) + np.uint64(1)), starts)

            yield from _rows(batch.column("cls"), top, _keys(top, signature, trees, depth, level), sketch)

    return run


def vector_forest(trees: int, depth: int, level: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows of the forest from (cls, top, vector): the nearest signed random direction; the sketch is the vector in steps, two
    places a byte, with the size of a step and the length of what the rounding left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directions: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = batch.column("vector").value_lengths().to_numpy(zero_copy_only=False)
            for dim in map(int, np.unique(lengths)):
                part = batch.take(pa.array(np.flatnonzero(lengths == dim)))
                x = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                if dim not in directions:
                    rng = np.random.default_rng([7, dim, level])
                    directions[dim] = rng.standard_normal((trees * depth, dim, min(dim, DIRECTIONS)), dtype=np.float32)
                small = x.astype(np.float32)

                def signature(i: int, small=small, dim=dim) -> np.ndarray:
                    at = small @ directions[dim][i]
                    best = np.abs(at).argmax(axis=1)
                    return (2 * best + (at[np.arange(len(at)), best] < 0)).astype(np.uint64)

                step = np.abs(x).max(axis=1, keepdims=True) / 7
                q = np.round(x / step)
                left = np.linalg.norm(x - q * step, axis=1, keepdims=True) + 1e-6
                even = np.pad((q + 8).astype(np.uint8), ((0, 0), (0, dim % 2)), constant_values=8)
                sketch = np.concatenate(
                    [step.astype(np.float32).view(np.uint8), left.astype(np.float32).view(np.uint8), even[:, ::2] << 4 | even[:, 1::2]], axis=1
                )
                top = part.column("top").to_numpy(zero_copy_only=False).astype(np.int64)
                yield from _rows(part.column("cls"), top, _keys(top, signature, trees, depth, level * 65_537 + dim), sketch)

    return run


def word_sides(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Two matrices, an order of the records and a bound: of two records that may have the similarity, the first in this order, the
    product of the first's row in the one and the second's in the other is at least the bound. A bit set on one side only is a
    word the other side lacks; the records are ordered by the words that share a bit, for the fewer don't matter."""
    size = np.ascontiguousarray(sketch[:, :4]).view(np.float32)
    bits = np.unpackbits(sketch[:, 4:], axis=1).astype(np.float32)
    want, spare = size * np.float32(least / (1 + least)), bits.sum(axis=1, keepdims=True) - size
    one = np.ones_like(size)
    return np.hstack([bits, one, -want]), np.hstack([bits, -(want + spare), one]), spare[:, 0], -1e-3


def vector_sides(sketch: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """The same for the cosine: the product of the rounded vectors and what rounding may have taken from it, in any order."""
    step, left = (np.ascontiguousarray(sketch[:, i : i + 4]).view(np.float32) for i in (0, 4))
    q = np.stack([sketch[:, 8:] >> 4, sketch[:, 8:] & 15], axis=2).reshape(len(sketch), -1).astype(np.float32) - 8
    q *= step
    long = np.linalg.norm(q, axis=1, keepdims=True)
    return np.hstack([q, long, left, left]), np.hstack([q, left, long, left]), np.zeros(len(q), dtype=np.float32), least - 1e-4


def compare(sides: Callable, least: float, crowd: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows sorted by key: the pairs (a, b) of each region's records that may be links, and, with a null b, the
    records a of each region (key) of more than ``crowd``. Sides other than 0 are compared with each other only."""

    def pairs_of(key, cls, side, sketch):
        widths = np.array([len(p) for p in sketch])
        found = []
        for width in np.unique(widths):
            own = np.flatnonzero(widths == width)
            left, right, rank, bound = sides(np.frombuffer(b"".join(sketch[i] for i in own), dtype=np.uint8).reshape(-1, width), least)
            order = np.lexsort((rank, key[own]))
            own, left, right = own[order], left[order], right[order]
            k, c, s = key[own], cls[own], side[own]
            starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(k)]]))
            for m in np.unique(counts[(counts > 1) & (counts <= 24)]):
                heads = starts[counts == m]
                for at in range(0, len(heads), 4096):
                    rows = heads[at : at + 4096, None] + np.arange(m)
                    h, i, j = np.nonzero(np.matmul(left[rows], right[rows].transpose(0, 2, 1)) >= bound)
                    found.append((rows[h, i][i < j], rows[h, j][i < j]))
            for at, m in zip(starts[counts > 24], counts[counts > 24]):
                for sub in range(at, at + m, 1024):
                    i, j = np.nonzero(left[sub : min(sub + 1024, at + m)] @ right[sub : at + m].T >= bound)
                    found.append((sub + i[i < j], sub + j[i < j]))
            if found:
                i, j = (np.concatenate(x) for x in zip(*found))
                use = (s[i] == 0) | (s[i] != s[j])
                x, y = c[i[use]], c[j[use]]
                yield np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1)
            found = []

    def numbers(table: pa.Table, col: str) -> np.ndarray:
        return table.column(col).to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0, dtype=np.int64)

    def batch(key, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(a, pa.int64()), b], names=["key", "a", "b"])

    def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, cls, side = (numbers(table, c) for c in ("key", "cls", "side"))
        if crowd is not None and len(key):
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            counts = np.diff(np.concatenate([starts, [len(key)]]))
            many = np.repeat(counts > crowd, counts)
            if many.any():
                yield batch(key[many], cls[many], pa.nulls(int(many.sum()), pa.int64()))
                table = table.filter(pa.array(~many))
                key, cls, side = key[~many], cls[~many], side[~many]
        pairs = list(pairs_of(key, cls, side, table.column("sketch").to_pylist()))
        if pairs:
            out = np.unique(np.concatenate(pairs), axis=0)
            yield batch(np.zeros(len(out), dtype=np.int64), out[:, 0], pa.array(out[:, 1]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows, passing = 0, None  # passing: the crowded region whose records go on as they come
        for part in batches:
            if passing is not None:
                keys = part.column("key").to_numpy(zero_copy_only=False)
                n = int(np.searchsorted(keys, passing, "right"))
                if n:
                    yield batch(keys[:n], part.column("cls").slice(0, n).to_numpy(zero_copy_only=False), pa.nulls(n, pa.int64()))
                    part = part.slice(n)
                if part.num_rows:
                    passing = None
            if not part.num_rows:
                continue
            held.append(part)
            rows += part.num_rows
            if rows < 20_000:
                continue
            table = pa.Table.from_batches(held)
            keys = numbers(table, "key")
            whole = int(np.searchsorted(keys, keys[-1], "left"))  # the last region may go on in the next batch
            if crowd is not None and rows - whole > crowd:
                whole, passing = rows, keys[-1]
            if whole:
                yield from flush(table.slice(0, whole))
                rest = table.slice(whole)
                held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield from flush(pa.Table.from_batches(held))

    return run


def meetings(forest: DataFrame, sides: Callable, least: float, crowd: int | None, name: str) -> DataFrame:
    """Rows (key, a, b) of :func:`compare` over the forest's regions, written down: one shuffle by region and one sort."""
    tasks = int(forest.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes, much work: not to be coalesced
    near = forest.repartition(tasks, "key").sortWithinPartitions("key").select("key", "cls", "side", "sketch")
    return cut(near.mapInArrow(compare(sides, least, crowd), "key long, a long, b long"), name)


def blocks(crowd: DataFrame, size: int = CROWD) -> DataFrame:
    """Forest rows for the full comparison of regions (top, n, cls, sketch): every pair of blocks a region of its own."""
    parts = crowd.withColumn("parts", F.ceil(F.col("n") / F.lit(size)).cast("int"))
    parts = parts.withColumn("blk", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("parts")).cast("int"))
    parts = parts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = F.xxhash64("top", F.least("blk", "other"), F.greatest("blk", "other"))
    side = F.when(F.col("blk") < F.col("other"), 1).when(F.col("blk") > F.col("other"), 2).otherwise(0)
    return parts.select(key.alias("key"), "cls", "top", side.alias("side"), "sketch")


def forest_pairs(one: DataFrame, make: Callable, sides: Callable, least: float, agree: float, alike: float, crowd: int = CROWD) -> DataFrame:
    """Distinct candidate pairs (a, b), a < b, of records (cls, value) that meet in some region and pass the sketch."""
    records = one.count()
    depth = depth_for(records, alike)
    flat = one.withColumn("top", F.lit(0).cast("long"))
    met = meetings(flat.mapInArrow(make(trees_for(agree, depth), depth), FOREST), sides, least, crowd, "met")
    found = met.where("b is not null").select("a", "b")
    for level in range(1, LEVELS + 1):
        open_rows = met.where("b is null").select(F.col("key").alias("top"), F.col("a").alias("cls")).distinct()
        if open_rows.isEmpty():
            break
        deeper = cut(open_rows.join(one, "cls").mapInArrow(make(trees_for(agree, 1), 1, level), FOREST), "deeper")
        sizes = open_rows.groupBy("top").agg(F.count(F.lit(1)).alias("n"))
        own = deeper.groupBy("top", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("top").agg(F.sum(F.col("m") * F.col("m")).alias("s"))
        judged = own.join(sizes, "top").withColumn("split", (F.col("s") <= F.col("n") * F.col("n") / 2) & F.lit(level < LEVELS))
        judged = cut(judged.select("top", "n", "split"), "judged")
        full = deeper.join(judged.where("not split"), "top").groupBy("top", "cls").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        done = meetings(blocks(full, crowd), sides, least, None, "blocks")
        met = meetings(deeper.join(judged.where("split"), "top", "left_semi").select(*[x.split()[0] for x in FOREST.split(", ")]), sides, least, crowd, "met")
        found = found.unionByName(done.select("a", "b")).unionByName(met.where("b is not null").select("a", "b"))
    return found.distinct()


# --- the two kinds of likeness ----------------------------------------------------------------------------------------


def words_of(*texts: Column) -> Column:
    """The distinct runs of letters or digits of the texts, joined by blanks, in lower case."""
    whole = F.concat_ws(" ", *[F.coalesce(t, F.lit("")) for t in texts])
    return F.array_distinct(F.regexp_extract_all(F.lower(whole), F.lit(r"([\p{L}\p{N}]+)"), 1))


def word_classes(nodes: DataFrame, least_words: int = 10) -> DataFrame:
    """(seq, cls, words): records with equal word sets share a class; words are hashes, at least ``least_words`` of them."""
    words = nodes.select(F.col("seq").cast("long").alias("seq"), words_of(F.col("label"), F.col("summary")).alias("w"))
    words = words.where((F.size("w") >= least_words) & F.col("seq").isNotNull())
    words = words.select("seq", F.sort_array(F.transform("w", lambda x: F.xxhash64(x))).alias("words"))
    return words.select("seq", F.xxhash64("words").alias("cls"), "words")


def vector_classes(nodes: DataFrame) -> DataFrame:
    """(seq, cls, vector): records with equal vectors share a class; empty, zero, broken and infinite vectors are out."""
    v = nodes.select(F.col("seq").cast("long").alias("seq"), F.col("embedding").alias("vector")).where("seq is not null")
    most, least = F.array_max("vector"), F.array_min("vector")  # NaN is the greatest; what contains a null says null
    v = v.where((most < 1e30) & (least > -1e30) & ((most > 0) | (least < 0)) & ~F.array_contains("vector", F.lit(1e31).cast("float")))
    return v.select("seq", F.xxhash64("vector").alias("cls"), "vector")


def _norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def links(classes: DataFrame, what: str, jaccard: float, cosine: float) -> DataFrame:
    """Checked links (a, b) between different classes, a < b."""
    one = cut(classes.groupBy("cls").agg(F.first(what).alias(what)), what)
    if what == "words":
        found = forest_pairs(one, word_forest, word_sides, jaccard, jaccard, WORDS_ALIKE)
    else:
        found = forest_pairs(one, vector_forest, vector_sides, cosine, vectors_agree(cosine), VECTORS_ALIKE)
    pairs = found.join(one.select(F.col("cls").alias("a"), F.col(what).alias("x")), "a").join(
        one.select(F.col("cls").alias("b"), F.col(what).alias("y")), "b"
    )
    if what == "words":
        common = F.size(F.array_intersect("x", "y"))
        exact = common / (F.size("x") + F.size("y") - common) >= F.lit(jaccard)
    else:
        pairs = pairs.select("a", "b", *[F.col(c).cast("array<double>").alias(c) for c in ("x", "y")])
        dot = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
        exact = (F.size("x") == F.size("y")) & (dot / (_norm(F.col("x")) * _norm(F.col("y"))) >= F.lit(cosine))
    return pairs.where(exact).select("a", "b")


def near_links(nodes: DataFrame, jaccard: float = 0.6, cosine: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (kind, cls, seq) of the classes of equal records by words and by vector, and the links
    (kind, a, b) between different classes: shared distinct words / all >= ``jaccard`` (both with at least ten), or cosine
    >= ``cosine`` with equal dimension. Null labels and summaries count as empty; records without a seq are out; those with
    too few words and no usable vector have no class. Copies are not expanded into pairs."""
    members, found = [], []
    for kind, classes in (("words", word_classes(nodes)), ("vector", vector_classes(nodes))):
        classes = cut(classes, f"{kind}-classes")
        members.append(classes.select(F.lit(kind).alias("kind"), "cls", "seq"))
        found.append(links(classes, kind, jaccard, cosine).select(F.lit(kind).alias("kind"), "a", "b"))
    return members[0].unionByName(members[1]), found[0].unionByName(found[1])


def near_pairs(nodes: DataFrame, jaccard: float = 0.6, cosine: float = 0.9) -> DataFrame:
    """Rows (seq_a, seq_b), seq_a < seq_b: the links of :func:`near_links` between records, copies included."""
    members, found = near_links(nodes, jaccard, cosine)
    members = members.distinct()
    left = members.select("kind", F.col("cls").alias("a"), F.col("seq").alias("s"))
    right = members.select("kind", F.col("cls").alias("b"), F.col("seq").alias("t"))
    across = found.join(left, ["kind", "a"]).join(right, ["kind", "b"]).select("s", "t")
    within = left.join(right.withColumnRenamed("b", "a"), ["kind", "a"]).where("s < t").select("s", "t")
    pairs = across.unionByName(within).where("s <> t")
    return pairs.select(F.least("s", "t").alias("seq_a"), F.greatest("s", "t").alias("seq_b")).distinct()


def near_groups(nodes: DataFrame, jaccard: float = 0.6, cosine: float = 0.9) -> DataFrame:
    """Rows (seq, group_seq, n_links): every record with its group, named by its smallest seq, and the number of links of
    its classes; a record without links is its own group."""
    members, found = near_links(nodes, jaccard, cosine)
    members = cut(members.distinct(), "members")
    found = cut(found, "links")
    heads = members.groupBy("kind", "cls").agg(F.min("seq").alias("head"))
    star = members.join(heads, ["kind", "cls"]).where("seq <> head").select(F.col("head").alias("src"), F.col("seq").alias("dst"))
    over = (
        found.join(heads.select("kind", F.col("cls").alias("a"), F.col("head").alias("src")), ["kind", "a"])
        .join(heads.select("kind", F.col("cls").alias("b"), F.col("head").alias("dst")), ["kind", "b"])
        .where("src <> dst")
        .select("src", "dst")
    )
    labels = connected_components(star.unionByName(over))
    ends = found.select("kind", F.explode(F.array("a", "b")).alias("cls")).groupBy("kind", "cls").agg(F.count(F.lit(1)).alias("n"))
    counts = members.join(ends, ["kind", "cls"]).groupBy("seq").agg(F.sum("n").alias("n_links"))
    every = nodes.select(F.col("seq").cast("long").alias("seq")).where("seq is not null").distinct()
    return (
        every.join(labels.withColumnRenamed("id", "seq"), "seq", "left")
        .join(counts, "seq", "left")
        .select("seq", F.coalesce("component", "seq").alias("group_seq"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
