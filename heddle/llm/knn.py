"""All-vectors nearest neighbours by collision counting.

Every vector is hashed by ``m`` single random projections.  A projection's
sorted array is kept as base-level bucket numbers (one byte each); a window
centred on the query covers the buckets within a radius, and virtual rehashing
widens it by merging base buckets, without hashing again.  A vector that falls
into the windows of enough projections collides with the query and is verified
by its exact cosine: all that collide are, as single pairs where a query has
few of them, else by products of blocks where its cell lies.

Windows of single projections alone hold a fixed share of all vectors, so
counting them over the whole collection would be quadratic.  The vectors are
therefore first routed, by sign bits of further projections, into cells of a
fixed target size, in as many independent tables as make a pair at the wanted
cosine meet in some cell with the wanted probability; collisions are counted
inside cells.  At cosine 0.90 tables grow as n^0.16 and work as n^1.4.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.vectors import matrix
from heddle.session import cut


@dataclass(frozen=True)
class Counting:
    """Parameters of the collision counting.

    ``floor`` is the least cosine that must be found; ``miss`` the probability
    that a pair at the floor meets in no cell; ``cell`` the target cell size
    for up to 16384 vectors, which grows as n to the power ``growth`` beyond, to
    keep tables (and so what is shuffled) few at the cost of more counting;
    ``projections`` the number of single projections, of which ``first`` are
    counted for all pairs of a cell and the others only for pairs that may
    still reach the threshold; ``sent`` the candidates of a query in one cell, as
    a multiple of k, up to which they are sent on as pairs.  A query with more
    is verified inside the cell; none is left out.  ``part`` bounds the rows of
    a cell that one task verifies against as many others.
    """

    dim: int = 64
    floor: float = 0.90
    miss: float = 0.03
    cell: int = 512
    growth: float = 0.25
    projections: int = 48
    first: int = 24
    width: float = 1.5
    sent: int = 4
    part: int = 8192
    seed: int = 7

    @property
    def radius(self) -> float:
        """Distance of unit vectors at the floor."""
        return math.sqrt(2 - 2 * self.floor)

    def target(self, n: int) -> float:
        """Cell size aimed at for n vectors."""
        return self.cell * max(1.0, n / 16384) ** self.growth

    def bits(self, n: int) -> int:
        """Sign bits of a cell number, so that n vectors fill cells of the target size."""
        return max(0, round(math.log2(max(1, n) / self.target(n))))

    def tables(self, n: int) -> int:
        """Tables needed for n vectors."""
        bits = self.bits(n)
        if bits == 0:
            return 1
        meet = (1 - math.acos(self.floor) / math.pi) ** bits
        return max(1, math.ceil(math.log(self.miss) / math.log(1 - meet)))

    def reach(self) -> int:
        """Window radius in base buckets at the floor."""
        return max(1, round(self.width * self.radius / STEP))

    def threshold(self, m: int) -> int:
        """Collisions among m projections that a vector at the floor has with probability 0.999."""
        p = math.erf(self.width / math.sqrt(2))
        return max(1, math.floor(m * p - 3.1 * math.sqrt(m * p * (1 - p))))


#: Width of a base bucket; projections of unit vectors have standard deviation 1.
STEP = 1 / 32


def _route(params: Counting, n: int):  # noqa: ANN202
    bits, tables = params.bits(n), params.tables(n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(params.seed)
        lines = rng.standard_normal((params.dim, params.projections)).astype(np.float32)
        planes = rng.standard_normal((params.dim, max(1, bits * tables))).astype(np.float32)
        powers = 1 << np.arange(bits, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1), params.dim)
            buckets = np.clip(np.floor(x @ lines / STEP) + 128, 0, 255).astype(np.uint8)
            h = pa.array([row.tobytes() for row in buckets], pa.binary())
            signs = (x @ planes > 0).astype(np.int64)
            for t in range(tables):
                cell = signs[:, t * bits : (t + 1) * bits] @ powers + (t << 40) if bits else np.full(len(x), t << 40, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column(0), h], names=["cell", "id", "h"])

    return run


def count_collisions(h: np.ndarray, k: int, params: Counting, block: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query rows, other rows, asks, held) of one cell: which rows reach the threshold in the floor's windows.

    Pairs come out for queries with up to ``sent`` * k such rows.  Queries with
    more are marked in ``asks``, and all rows that reach their thresholds in ``held``.
    """
    n = len(h)
    reach = params.reach()
    first, whole = params.threshold(params.first), params.threshold(params.projections)
    columns = np.ascontiguousarray(h[:, : params.first].T)
    wide = np.uint8(min(255, 2 * reach))
    asks, held = np.zeros(n, bool), np.zeros(n, bool)
    queries, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for start in range(0, n, block):
        stop = min(n, start + block)
        counts = np.zeros((stop - start, n), np.uint8)
        for column in columns:
            # Window test by one unsigned comparison: 0 <= x - (q - R) <= 2R.
            low = column[start:stop].astype(np.int16) - reach
            offset = (column[None, :] - (low & 255).astype(np.uint8)[:, None]).astype(np.uint8)
            counts += offset <= wide
        a, b = np.nonzero(counts >= first)
        a += start
        other = a != b
        a, b = a[other], b[other]
        hit = np.zeros(len(a), bool)
        for part in range(0, len(a), 1 << 18):
            own = slice(part, part + (1 << 18))
            hit[own] = (np.abs(h[a[own]].astype(np.int16) - h[b[own]]) <= reach).sum(1) >= whole
        a, b = a[hit], b[hit]
        asks[start:stop] = np.bincount(a - start, minlength=stop - start) > params.sent * k
        crowded = asks[a]
        held[b[crowded]] = True
        queries.append(a[~crowded])
        others.append(b[~crowded])
    return np.concatenate(queries), np.concatenate(others), asks, held


def collisions(routed: DataFrame, k: int, params: Counting) -> DataFrame:
    """(a, b, cell, asks): pairs (a < b) to verify, and with a cell the rows (a) to verify inside it."""

    def run(group: pa.Table) -> pa.Table:
        ids = group["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        h = np.frombuffer(b"".join(group["h"].to_pylist()), np.uint8).reshape(len(ids), -1)[order]
        a, b, asks, held = count_collisions(h, k, params)
        ids = ids[order]
        # Rows collide mutually: a pair goes on once, whichever side asks.
        a, b = np.divmod(np.unique(np.minimum(a, b) * len(ids) + np.maximum(a, b)), len(ids))
        inside = np.flatnonzero(asks | held)
        none, cell = pa.nulls(len(a), pa.int64()), pa.array(np.full(len(inside), group["cell"][0].as_py()), pa.int64())
        pairs = pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64()), "cell": none, "asks": pa.nulls(len(a), pa.bool_())})
        rows = pa.table({"a": pa.array(ids[inside], pa.int64()), "b": pa.nulls(len(inside), pa.int64()), "cell": cell, "asks": pa.array(asks[inside])})
        return pa.concat_tables([pairs, rows])

    return routed.groupBy("cell").applyInArrow(run, "a long, b long, cell long, asks boolean")


def nearest(asked: np.ndarray, x: np.ndarray, held: np.ndarray, y: np.ndarray, k: int, floor: float, block: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cosine): the k best of the rows ``y`` for each of the queries ``x``, by exact cosine of at least the floor.

    ``asked`` and ``held`` are their ids, ``held`` in order; equal cosines go by the smaller id.
    """
    if not len(y):
        x, asked = x[:0], asked[:0]
    x, y = x.astype(np.float64), y.astype(np.float64)
    norms = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
    u, v = x / np.sqrt(norms[0])[:, None], (y / np.sqrt(norms[1])[:, None]).T
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for start in range(0, len(x), block):
        ids = asked[start : start + block]
        c = u[start : start + block] @ v
        own = np.minimum(np.searchsorted(held, ids), len(held) - 1)
        same = np.flatnonzero(held[own] == ids)
        c[same, own[same]] = -2
        # Products round otherwise than single cosines: what is within rounding of the k-th best is computed singly.
        bound = np.full(len(ids), floor)
        more = np.flatnonzero((c >= floor).sum(1) > k)
        if len(more):
            bound[more] = np.partition(c[more], len(held) - k, axis=1)[:, len(held) - k]
        i, j = np.nonzero(c >= bound[:, None] - 1e-12)
        cosine = np.empty(len(i))
        for part in range(0, len(i), 1 << 16):
            o = slice(part, part + (1 << 16))
            cosine[o] = np.einsum("ij,ij->i", x[start + i[o]], y[j[o]]) / np.sqrt(norms[0][start + i[o]] * norms[1][j[o]])
        order = np.lexsort((held[j], -cosine, i))
        i, j, cosine = i[order], j[order], cosine[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & (cosine >= floor)
        out.append((ids[i[keep]], held[j[keep]], cosine[keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _inside(rows: DataFrame, vectors: DataFrame, k: int, params: Counting) -> DataFrame:
    """(a, b, cosine): the best k of the rows of its cell for each row that asks; ``rows``: (cell, id, asks).

    Cells of more than ``part`` rows meet part by part, so that a task holds two parts.
    """
    sizes = rows.groupBy("cell").agg(F.ceil(F.count("*") / params.part).cast("int").alias("parts"))
    spread = rows.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    spread = spread.select("cell", "id", "asks", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("cell", "id", "asks", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        ids, asks, own = (group[c].to_numpy() for c in ("id", "asks", "own"))
        x = matrix(group["vec"], params.dim)
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        found = []
        for p, q in {(i, j), (j, i)}:
            asking, held = asks & (own == p), own == q
            found.append(nearest(ids[asking], x[asking], ids[held], x[held], k, params.floor))
        a, b, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": cosine})

    return spread.join(vectors, "id").groupBy("cell", "i", "j").applyInArrow(run, "a long, b long, cosine double")


def verified(classes: DataFrame, n: int, k: int, params: Counting) -> DataFrame:
    """Distinct (a, b, cosine) of vectors that collide in some cell, by exact cosine of at least the floor; ``classes``: (id, vec).

    Cells above four times the target are not counted: all their pairs are
    verified.  The numbers of these cells are joined back, by broadcast while
    there are at most 20000 of them, else by a shuffle.
    """
    vectors = classes.select("id", "vec")
    # Routing is cheaper to repeat than to keep: nothing of it is written before the one shuffle by cell.
    routed = vectors.mapInArrow(_route(params, n), "cell long, id long, h binary")
    large = cut(routed.groupBy("cell").agg(F.count("*").alias("_n")).where(F.col("_n") > 4 * params.target(n)).select("cell"))
    number = large.count()
    whole = F.broadcast(large) if number <= 20_000 else large
    found = cut(collisions(routed.join(whole, "cell", "left_anti") if number else routed, k, params))
    single = _cosines(found.where("cell is null").select("a", "b").distinct(), vectors, params.dim).where(F.col("cosine") >= params.floor)
    sides = F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("s")
    single = single.select(sides, "cosine").select("s.a", "s.b", "cosine")
    rows = found.where("cell is not null").select("cell", F.col("a").alias("id"), "asks")
    if number:
        rows = rows.unionByName(routed.join(whole, "cell", "left_semi").select("cell", "id", F.lit(True).alias("asks")))
    return single.unionByName(_inside(cut(rows), vectors, k, params)).dropDuplicates(["a", "b"])


def _cosines(pairs: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """(a, b, cosine) of pairs (a, b)."""
    # Only vectors of some pair travel; their ids are broadcast up to a million (under 16 MB).
    pairs = cut(pairs)
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    needed = vectors.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "id", "left_semi")
    sides = pairs.join(needed.select(F.col("id").alias("a"), F.col("vec").alias("va")), "a")
    sides = sides.join(needed.select(F.col("id").alias("b"), F.col("vec").alias("vb")), "b").select("a", "b", "va", "vb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (matrix(batch.column(i), dim).astype(np.float64) for i in (2, 3))
            cosine = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cosine)], names=["a", "b", "cosine"])

    return sides.mapInArrow(run, "a long, b long, cosine double")


def neighbours(vectors: DataFrame, k: int, params: Counting | None = None) -> DataFrame:
    """(id, neighbour, cosine, rank): up to k most similar others with cosine of at least the floor.

    ``vectors``: (id, vec) from ``read_vectors``; rows with an id seen twice
    count once.  Equal cosines rank by the smaller neighbour id.  Equal
    vectors form a class that is indexed once: its members are each other's
    nearest, however many they are.  An empty input gives an empty result.
    """
    params = params or Counting()
    # Classes of equal vectors go by 128 bits of hash, so that vectors travel once.
    vectors = cut(vectors.select("id", "vec", F.xxhash64("vec").alias("k1"), F.xxhash64(F.lit(1), "vec").alias("k2")))
    classes = cut(vectors.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.first("vec").alias("vec")).select("id", "vec", "k1", "k2"))
    members = cut(vectors.select("id", "k1", "k2").distinct())
    # Heads of a class: its k+1 smallest ids, taken per salt first, so that no task sees a whole class.
    salted = Window.partitionBy("k1", "k2", F.pmod(F.xxhash64("id"), F.lit(32))).orderBy("id")
    local = members.withColumn("_p", F.row_number().over(salted)).where(F.col("_p") <= k + 1)
    heads = local.withColumn("pos", F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))).where(F.col("pos") <= k + 1)
    heads = cut(heads.select(F.min("id").over(Window.partitionBy("k1", "k2")).alias("rep"), "id", "pos"))
    n = classes.count()
    exact = verified(classes, n, k, params)
    best = exact.withColumn("_r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "b"))).where(F.col("_r") <= k)
    best = best.select(F.col("a").alias("rep"), F.col("b").alias("other"), "cosine")
    own = heads.select(F.col("rep"), F.col("id").alias("neighbour"), F.lit(1.0).alias("cosine"))
    more = best.join(heads.select(F.col("rep").alias("other"), F.col("id").alias("neighbour")), "other").select("rep", "neighbour", "cosine")
    ranked = own.unionByName(more).withColumn("_r", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("cosine"), "neighbour")))
    lists = ranked.where(F.col("_r") <= k + 1).groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("_r", "neighbour", "cosine"))).alias("list"))
    # A class without a second member and without a neighbour holds only itself.
    lists = lists.where(F.size("list") > 1)
    reps = classes.select("k1", "k2", F.col("id").alias("rep")).join(lists, "rep")
    rows = members.join(reps, ["k1", "k2"]).select("id", F.slice(F.filter("list", lambda e: e["neighbour"] != F.col("id")), 1, k).alias("list"))
    return rows.select("id", F.posexplode("list").alias("_at", "e")).select("id", F.col("e.neighbour").alias("neighbour"), F.col("e.cosine").alias("cosine"), (F.col("_at") + 1).alias("rank"))


def _packed(vectors: DataFrame, params: Counting, size: int) -> DataFrame:
    """(ids, data, buckets): rows packed into blocks, with the base buckets of their projections."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = np.random.default_rng(params.seed).standard_normal((params.dim, params.projections)).astype(np.float32)
        for batch in batches:
            x = matrix(batch.column(1), params.dim) if batch.num_rows else np.zeros((0, params.dim), np.float32)
            ids = batch.column(0).to_numpy()
            buckets = np.clip(np.floor(x @ lines / STEP) + 128, 0, 255).astype(np.uint8)
            for part in range(0, len(ids), size):
                own = slice(part, part + size)
                yield pa.RecordBatch.from_arrays([pa.array([ids[own].tolist()], pa.list_(pa.int64())), pa.array([x[own].tobytes()], pa.binary()), pa.array([buckets[own].tobytes()], pa.binary())], names=["ids", "data", "buckets"])

    return vectors.select("id", "vec").mapInArrow(run, "ids array<long>, data binary, buckets binary")


def widened(asked: np.ndarray, held: np.ndarray, want: int, params: Counting) -> np.ndarray:
    """Boolean matrix (queries, rows): rows to verify for each query.

    Windows are widened level by level for queries that have fewer than
    ``want`` rows above the collision threshold; at the last level the rows
    with the most collisions fill up.
    """
    out = np.zeros((len(asked), len(held)), bool)
    opened = np.arange(len(asked))
    threshold = params.threshold(params.projections)
    columns = np.ascontiguousarray(held.T)
    for radius in (0.45, 0.6, 0.75, 0.9, 1.05, 1.2):
        reach = round(params.width * radius / STEP)
        counts = np.zeros((len(opened), len(held)), np.uint8)
        low = (asked[opened].astype(np.int16) - reach).T
        for column, q in zip(columns, low, strict=True):
            counts += (column[None, :].astype(np.int16) - q[:, None]).view(np.uint16) <= 2 * reach
        hit = counts >= threshold
        enough = hit.sum(axis=1) >= want
        out[opened[enough]] = hit[enough]
        opened, counts = opened[~enough], counts[~enough]
        if not len(opened):
            return out
    keep = min(want, len(held))
    bound = np.partition(counts, len(held) - keep, axis=1)[:, len(held) - keep]
    out[opened] = counts >= bound[:, None]
    return out


def search(queries: DataFrame, vectors: DataFrame, k: int, share: float = 0.06, params: Counting | None = None, size: int = 2048) -> DataFrame:
    """(id, neighbour, cosine, rank): the k most similar vectors of each query among all, whatever their cosine.

    A stated set of queries meets all rows block by block.  Of each block of
    ``size`` rows, those in enough query-centred windows are verified: at
    least k and ``share`` of the block.  A query is not its own neighbour;
    equal cosines rank by the smaller id; ids seen twice count once.
    """
    params = params or Counting()
    rows = _packed(vectors.dropDuplicates(["id"]), params, size).select(*[F.col(c).alias(f"b_{c}") for c in ("ids", "data", "buckets")])
    asked = _packed(queries.dropDuplicates(["id"]), params, 256).select(*[F.col(c).alias(f"a_{c}") for c in ("ids", "data", "buckets")])
    # Only blocks are paired, one row for 256 queries or for ``size`` vectors.
    pairs = rows.join(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                b_ids, b_data, b_held, a_ids, a_data, a_held = (c[r].as_py() for c in batch.columns)
                a_ids, b_ids = np.array(a_ids, np.int64), np.array(b_ids, np.int64)
                x, y = (np.frombuffer(z, "<f4").reshape(-1, params.dim).astype(np.float64) for z in (a_data, b_data))
                held = [np.frombuffer(z, np.uint8).reshape(-1, params.projections) for z in (a_held, b_held)]
                hit = widened(*held, k + 1 + int(share * len(b_ids)), params) & (a_ids[:, None] != b_ids[None, :])
                i, j = np.nonzero(hit)
                cosine = np.einsum("ij,ij->i", x[i], y[j]) / np.sqrt(np.einsum("ij,ij->i", x, x)[i] * np.einsum("ij,ij->i", y, y)[j])
                order = np.lexsort((b_ids[j], -cosine, i))
                i, j, cosine = i[order], j[order], cosine[order]
                best = np.arange(len(i)) - np.searchsorted(i, i) < k
                yield pa.RecordBatch.from_arrays([pa.array(a_ids[i[best]]), pa.array(b_ids[j[best]]), pa.array(cosine[best])], names=["id", "neighbour", "cosine"])

    found = pairs.mapInArrow(run, "id long, neighbour long, cosine double")
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
