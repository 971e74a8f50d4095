"""Items of varying length into containers of fixed capacity: best-two-fit.

Items are packed greedily, largest first, each into the fullest bin that holds
it.  Then bins are mended: while the smallest item of a bin can be replaced by
two unpacked items that fill the widened gap more tightly, it is.  Items above
the capacity are cut into full pieces and a rest; nothing else is split.

A shard of items is packed by one task, with a bounded number of rows; the
partly filled bins of all shards are packed once more, so that the space left
over does not grow with the number of shards.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.tokens import VOCABULARY, encoding
from heddle.session import cut


def best_two_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin number of each item; all sizes are between 1 and the capacity.

    Bins are opened one after another.  A bin is filled greedily with the
    largest item that still fits; while its smallest item can be exchanged for
    two unpacked ones that together leave a smaller gap, it is exchanged.
    """
    n = len(sizes)
    bins = np.full(n, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    # Unpacked items as a multiset of sizes: distinct sizes in order and how many of each are left.
    values, first = np.unique(sizes[order], return_index=True)
    stock = {int(v): list(order[a:b]) for v, a, b in zip(values, first, [*first[1:], n], strict=True)}
    left = [int(v) for v in values]

    def take(v: int) -> int:
        items = stock[v]
        item = items.pop()
        if not items:
            del left[bisect_left(left, v)]
        return item

    def give(v: int, item: int) -> None:
        if not stock[v]:
            insort(left, v)
        stock[v].append(item)

    number = 0
    while left:
        content: list[tuple[int, int]] = []
        gap = capacity
        while left and (at := bisect_right(left, gap)):
            v = left[at - 1]
            content.append((v, take(v)))
            gap -= v
        # The smallest item went in last.
        while gap and left and content:
            small, item = content[-1]
            room = gap + small
            pair = _two(left, stock, room, small)
            if pair is None:
                break
            give(small, item)
            content.pop()
            content += [(v, take(v)) for v in pair]
            content.sort(reverse=True)
            gap = room - sum(pair)
        for _, item in content:
            bins[item] = number
        number += 1
    return bins


def _two(left: list[int], stock: dict[int, list], room: int, least: int) -> tuple[int, int] | None:
    """Two unpacked sizes with the largest sum in (least, room], by two pointers from both ends."""
    best, found = least, None
    i, j = 0, bisect_right(left, room) - 1
    while i <= j:
        a, b = left[i], left[j]
        total = a + b
        if total > room:
            j -= 1
            continue
        if total > best and (i < j or len(stock[a]) > 1):
            best, found = total, (b, a)
            if best == room:
                break
        i += 1
    return found


def measure(df: DataFrame, key: str, text: str, capacity: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, piece_no, start_token, tokens): items, those above the capacity cut into pieces.

    Null and empty texts hold no token and are no items.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            lengths = np.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], np.int64)
            pieces = -(-lengths // capacity)
            row = np.repeat(np.arange(len(lengths)), pieces)
            place = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            size = np.minimum(capacity, lengths[row] - place * capacity)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(place.astype(np.int32)), pa.array(place * capacity), pa.array(size)], names=["key", "piece_no", "start_token", "tokens"])

    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "key long, piece_no int, start_token long, tokens long").withColumnRenamed("key", key)


def pack(items: DataFrame, key: str, capacity: int, shard_rows: int = 50_000, full: float = 0.99) -> DataFrame:
    """Items with ``container`` (string) and ``container_tokens``.

    ``items`` comes from ``measure``.  Every item is in exactly one container
    and no container is above the capacity.  ``shard_rows`` bounds what one
    task packs.  Bins filled below ``full`` are opened again and packed
    together in a second round of shards.
    """
    items = cut(items)
    n = items.count()

    def packer(prefix: str):  # noqa: ANN202
        def run(group: pa.Table) -> pa.Table:
            order = np.lexsort((group["piece_no"].to_numpy(), group[key].to_numpy()))
            group = group.take(pa.array(order))
            sizes = group["tokens"].to_numpy()
            bins = best_two_fit(sizes, capacity)
            used = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
            shard = group["shard"][0].as_py()
            names = pa.array([f"{prefix}{shard}-{b}" for b in bins])
            return group.select([key, "piece_no", "start_token", "tokens"]).append_column("container", names).append_column("container_tokens", pa.array(used))

        return run

    schema = f"`{key}` long, piece_no int, start_token long, tokens long, container string, container_tokens long"

    def round_of(rows: DataFrame, count: int, prefix: str) -> DataFrame:
        shards = max(1, -(-count // shard_rows))
        sharded = rows.select(key, "piece_no", "start_token", "tokens", F.pmod(F.xxhash64(key, "piece_no"), F.lit(shards)).alias("shard"))
        return sharded.groupBy("shard").applyInArrow(packer(prefix), schema)

    first = cut(round_of(items, n, "a"))
    done = first.where(F.col("container_tokens") >= full * capacity)
    rest = first.where(F.col("container_tokens") < full * capacity)
    return done.unionByName(round_of(rest, rest.count(), "b"))
