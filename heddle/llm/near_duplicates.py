"""Groups of nearly equal texts by multi-index hashing.

A text's fingerprint is a string of symbols, each the first of its distinct
words in one random order, so two texts differ in a symbol with probability
one minus their word similarity.  All words count alike here as they do in
the similarity itself, so that a pair is found by what makes it a case.
The fingerprint is cut into segments; for each segment the ball of Hamming
radius one around it is enumerated (all ways to leave one symbol open) and
looked up in that segment's table.  Texts that share a table row are compared
by a complete distance over 112 further symbols of two bits, and those near enough by
their complete word sets.  Segments and the distance follow from the
probability to overlook a pair at the least similarity, nothing else.

Bit fingerprints would not do here: at a similarity of 0.60 about a fifth of
all bits differ, and balls that wide hold a seventh of all segment values.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.operators.graph import components
from heddle.llm.words import Codes, mix, words
from heddle.session import cut, partitions


#: Two-bit symbols of the complete distance.
SKETCH = 112


@dataclass(frozen=True)
class MultiIndex:
    """``similarity``: least share of common words; ``least_words``: texts with fewer distinct words take no part.

    ``symbols`` in a segment and ``miss``, the probability that a pair just at
    ``similarity`` shares no table row, give the number of segments; the
    complete distance overlooks such a pair with a tenth of ``miss``.
    ``block`` bounds the members of a table row that one task compares.
    """

    similarity: float = 0.60
    least_words: int = 8
    symbols: int = 5
    miss: float = 0.00065
    block: int = 2048
    seed: int = 11

    @property
    def segments(self) -> int:
        """Segments needed to overlook a pair at the least similarity with at most ``miss``."""
        s, j = self.symbols, self.similarity
        hit = j**s + s * (1 - j) * j ** (s - 1)
        return math.ceil(math.log(self.miss) / math.log(1 - hit))

    @property
    def agreeing(self) -> int:
        """Of 112 two-bit symbols, how many a pair at the least similarity shares but for a tenth of ``miss``."""
        p = self.similarity + (1 - self.similarity) / 4
        below = 0.0
        for k in range(SKETCH + 1):
            below += math.comb(SKETCH, k) * p**k * (1 - p) ** (SKETCH - k)
            if below > self.miss / 10:
                return k
        return SKETCH


def _word_sets(params: MultiIndex):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            ids, sets, keys = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                distinct = set(words(text))
                if len(distinct) >= params.least_words:
                    members = codes(list(distinct))
                    ids.append(i)
                    sets.append(np.sort((members >> np.uint64(32)).astype(np.uint32)).tobytes())
                    keys.append(int(mix(mix(members).sum(keepdims=True) + np.uint64(len(members)))[0].astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(sets, pa.binary())], names=["id", "class", "words"])

    return run


#: The half of a class number that goes with a table entry, and the other half.
HALF, LOW = np.uint64(0xFFFFFFFF00000000), np.int64(0xFFFFFFFF)


def _table_keys(params: MultiIndex):  # noqa: ANN202
    segments, symbols = params.segments, params.symbols

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salts = mix(np.arange(1, segments * symbols + SKETCH + 1, dtype=np.uint64) + np.uint64(params.seed << 32))
        place = mix(np.arange(1, segments * symbols + 1, dtype=np.uint64) + np.uint64(977 << 32)).reshape(segments, symbols)
        drawn: dict[int, np.ndarray] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            out = np.empty((batch.num_rows, segments * symbols), np.uint64)
            sketches = np.empty((batch.num_rows, SKETCH), np.uint64)
            for row, raw in enumerate(batch.column(1).to_pylist()):
                members = np.frombuffer(raw, np.uint32).tolist()
                if len(drawn) > 1 << 16:
                    drawn.clear()
                for w in members:
                    if w not in drawn:
                        # The word's place in each order: the smallest marks the symbol.
                        drawn[w] = mix(np.uint64(w * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF) ^ salts)
                first = np.stack([drawn[w] for w in members]).argmin(axis=0)
                drawn_words = np.asarray(members, np.uint64)[first]
                sketches[row] = mix(drawn_words[segments * symbols :]) & np.uint64(3)
                chosen = drawn_words[: segments * symbols].reshape(segments, symbols)
                part = mix((chosen << np.uint64(20)) ^ place)
                # The ball of radius one: each symbol in turn is left open.
                out[row] = (part.sum(axis=1, keepdims=True) - part + place).reshape(-1)
            keys = mix(out).astype(np.int64).reshape(-1)
            wide = lambda x: pa.array(np.repeat(x, segments * symbols))
            twos = np.arange(32, dtype=np.uint64) * np.uint64(2)
            # Half of the class number and 16 sketch symbols share one word, the other 96 symbols fill three more.
            tagged = (batch.column(0).to_numpy().view(np.uint64) & HALF) | (sketches[:, :16] << twos[:16]).sum(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(keys), wide(tagged.astype(np.int64)), *[wide((sketches[:, i : i + 32] << twos).sum(axis=1).astype(np.int64)) for i in (16, 48, 80)]], names=["key", "tagged", "s1", "s2", "s3"])

    return run


def agreeing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many of the 32 two-bit symbols of two words agree."""
    z = (x ^ y).astype(np.uint64)
    z |= z >> np.uint64(1)
    return 32 - np.bitwise_count(z & np.uint64(0x5555555555555555)).astype(np.int64)


def _rows_to_pairs(params: MultiIndex):  # noqa: ANN202
    """Pairs of members of table rows, read as runs of sorted keys; members of too long rows go on unpaired."""
    block, least = params.block, params.agreeing

    def close(keys: np.ndarray, classes: np.ndarray, s1: np.ndarray, s2: np.ndarray, s3: np.ndarray, large: int | None) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(starts, len(keys)))
        long = np.repeat(sizes, sizes) > block
        if large is not None:
            long |= keys == large
        place = np.arange(len(keys)) - np.repeat(starts, sizes)
        out = [(classes[long] >> 32, np.full(int(long.sum()), -1), keys[long])]
        paired = [np.zeros(int(long.sum()), bool)]
        later = np.flatnonzero((place >= 1) & ~long)
        step = 0
        while len(later):
            step += 1
            x, y = classes[later - step], classes[later]
            # The lower half of a tagged word holds 16 symbols; the upper half is masked, and so agrees in 16.
            agree = agreeing(s1[later - step], s1[later]) + agreeing(s2[later - step], s2[later]) + agreeing(s3[later - step], s3[later]) + agreeing(x & LOW, y & LOW) - 16
            real = (x != y) & (agree >= least)
            x, y = x[real] >> 32, y[real] >> 32
            out.append((np.minimum(x, y), np.maximum(x, y), np.zeros(int(real.sum()), np.int64)))
            paired.append(np.ones(int(real.sum()), bool))
            later = later[place[later] > step]
        columns = [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(paired))], names=["a", "b", "key", "paired"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 5
        large: int | None = None
        for batch in batches:
            joined = [np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns, strict=True)]
            keys = joined[0]
            if not len(keys):
                continue
            # The last run may go on in the next batch; one that is long already need not be held.
            last = int(np.searchsorted(keys, keys[-1]))
            if len(keys) - last > block or keys[-1] == large:
                yield close(*joined, large)
                large, held = int(keys[-1]), [c[:0] for c in joined]
            else:
                yield close(*[c[:last] for c in joined], large)
                held = [c[last:] for c in joined]
        if len(held[0]):
            yield close(*held, large)

    return run


def common_words(left: pa.Array, right: pa.Array) -> np.ndarray:
    """How many words the packed word sets of each row share, for all rows of two columns at once."""
    sides = []
    for column in (left, right):
        words_, sizes = np.frombuffer(b"".join(column.to_pylist()), np.uint32), pc.binary_length(column).to_numpy(zero_copy_only=False) // 4
        sides.append((np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes) << np.uint64(32)) | words_)
    # Both sides are in order of row and word, so the stable sort merges two runs.
    both = np.concatenate(sides)
    both.sort(kind="stable")
    return np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(left))


def shared_words(left: list[bytes], right: list[bytes], width: int = 4096) -> np.ndarray:
    """How many words each packed word set of ``left`` shares with each of ``right``."""
    sets = [np.frombuffer(w, np.uint32) for w in (*left, *right)]
    row = np.repeat(np.arange(len(sets)), [len(w) for w in sets])
    _, word, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Words of one set alone are shared by none.
    number = np.cumsum(seen > 1) - 1
    twice = seen[word] > 1
    row, column = row[twice], number[word[twice]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(left), len(right)), np.int64)
    for start in range(0, int((seen > 1).sum()), width):
        own = slice(*np.searchsorted(column, [start, start + width]))
        has = np.zeros((len(sets), width), np.float32)
        has[row[own], column[own] - start] = 1
        out += (has[: len(left)] @ has[len(left) :].T).astype(np.int64)
    return out


def _links_of_blocks(params: MultiIndex):  # noqa: ANN202
    """Verified links between the members of two blocks, as few as join what they join."""

    def run(group: pa.Table) -> pa.Table:
        members = sorted({*zip(group["class"].to_pylist(), group["part"].to_pylist(), group["words"].to_pylist())})
        i, j = group["i"][0].as_py(), group["j"][0].as_py()
        left, right = ([m for m in members if m[1] == part] for part in (i, j))
        links = []
        if left and right:
            common = shared_words([m[2] for m in left], [m[2] for m in right])
            sizes = [np.array([len(m[2]) // 4 for m in side]) for side in (left, right)]
            alike = common / (sizes[0][:, None] + sizes[1] - common) >= params.similarity - 1e-12
            x, y = np.nonzero(alike)
            names = [np.array([m[0] for m in side], np.int64) for side in (left, right)]
            nodes, at = np.unique(np.concatenate([names[0][x], names[1][y]]), return_inverse=True)
            low = np.arange(len(nodes))
            x, y = at[: len(x)], at[len(x) :]
            while True:
                # Every link pulls both ends to the lower label; labels are then followed to their own.
                before = low.copy()
                np.minimum.at(low, x, before[y])
                np.minimum.at(low, y, before[x])
                low = low[low]
                if (low == before).all():
                    break
            links = [(int(nodes[r]), int(n)) for n, r in zip(nodes, low, strict=True) if nodes[r] != n]
        columns = list(zip(*links, strict=True)) if links else [[], []]
        return pa.table({"a": pa.array(columns[0], pa.int64()), "b": pa.array(columns[1], pa.int64())})

    return run


def similar_classes(classes: DataFrame, params: MultiIndex) -> DataFrame:
    """(a, b): links between classes whose word sets are alike; ``classes``: (class, words).

    All alike pairs of table rows of up to ``block`` members come out, of
    longer rows as many as join the same classes.
    """
    keys = classes.select("class", "words").mapInArrow(_table_keys(params), "key long, tagged long, s1 long, s2 long, s3 long")
    # At most two million table entries, 80 MB, for each task.
    tasks = max(partitions(classes.sparkSession), classes.count() * params.segments * params.symbols // 2_000_000)
    rows = keys.repartition(tasks, "key").sortWithinPartitions("key", "tagged")
    found = cut(rows.mapInArrow(_rows_to_pairs(params), "a long, b long, key long, paired boolean"))
    # Pairs are of half class numbers; the few classes that share one are all verified.
    pairs = cut(found.where("paired").select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b")).distinct())
    halved = classes.select(F.shiftright("class", 32).cast("int").alias("half"), "class", "words")
    # Only word sets of some pair travel; their numbers are broadcast up to a million (under 16 MB).
    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("half")).distinct())
    needed = halved.join(F.broadcast(ids) if ids.count() <= 1_000_000 else ids, "half", "left_semi")
    left = needed.select(F.col("half").alias("a"), F.col("class").alias("ca"), F.col("words").alias("wa"))
    right = needed.select(F.col("half").alias("b"), F.col("class").alias("cb"), F.col("words").alias("wb"))
    sides = pairs.join(left, "a").join(right, "b").where("ca <> cb").select("ca", "cb", "wa", "wb")
    # A class with many candidates must not be verified by one task.
    sides = sides.repartition(partitions(classes.sparkSession), "ca", "cb")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            common = common_words(batch.column(2), batch.column(3))
            sizes = sum(pc.binary_length(batch.column(i)).to_numpy(zero_copy_only=False) // 4 for i in (2, 3))
            alike = pa.array(common >= (params.similarity - 1e-12) * (sizes - common))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(alike), batch.column(1).filter(alike)], names=["a", "b"])

    few = sides.mapInArrow(verify, "a long, b long")
    large = found.where(~F.col("paired")).select("key", F.col("a").cast("int").alias("half")).join(halved.select("half", "class"), "half").select("key", "class")
    large = large.join(large.groupBy("key").agg(F.ceil(F.count("*") / params.block).cast("int").alias("parts")), "key")
    spread = large.select("key", "class", "parts", F.pmod(F.xxhash64("class"), F.col("parts")).cast("int").alias("part"))
    spread = spread.select("key", "class", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    spread = spread.select("key", "class", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j")).join(classes, "class")
    many = spread.groupBy("key", "i", "j").applyInArrow(_links_of_blocks(params), "a long, b long")
    return few.unionByName(many)


def groups(texts: DataFrame, params: MultiIndex | None = None) -> DataFrame:
    """(id, class, group): every text that takes part, with its class of equal word sets and its group.

    ``texts``: (id, text).  An id seen with several texts counts with the
    one of them (the smallest class).  Null, blank and short
    texts take no part.  A group is named by its smallest class; it joins
    classes that are alike directly or through others.
    """
    params = params or MultiIndex()
    rows = texts.where("id is not null and text is not null").select(F.col("id").cast("long").alias("id"), "text")
    read = cut(rows.mapInArrow(_word_sets(params), "id long, class long, words binary"))
    members = read.groupBy("id").agg(F.min("class").alias("class"))
    classes = cut(read.groupBy("class").agg(F.first("words").alias("words")))
    links = cut(similar_classes(classes, params))
    named = components(links)
    joined = members.join(named.select(F.col("node").alias("class"), F.col("component").alias("root")), "class", "left")
    return joined.select("id", "class", F.coalesce("root", "class").alias("group"))


def pairs_of_groups(grouped: DataFrame) -> DataFrame:
    """(id_a, id_b) of each pair inside a group, id_a < id_b.

    The result is quadratic in the group by its definition.  Pairs come from
    a join on the group, so a large group is split by the join's skew
    handling and never collected.
    """
    other = grouped.select("group", F.col("id").alias("id_b"))
    return grouped.select("group", F.col("id").alias("id_a")).join(other, "group").where("id_a < id_b").select("id_a", "id_b")
