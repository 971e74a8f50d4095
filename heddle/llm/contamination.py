"""Evaluation passages inside a training corpus, by winnowing.

Each text is a row of words; its k-word grams are hashed and of every window
of w consecutive hashes the smallest is kept.  Two texts that share w + k - 1
consecutive words share a kept hash, so with w + k - 1 equal to the least
passage no such passage is missed.  Kept hashes of corpus and test items are
joined, and each hit is extended word by word in both directions to the whole
common span.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.words import Codes, mix, words
from heddle.session import cut


@dataclass(frozen=True)
class Winnowing:
    """``span``: least number of consecutive words of a passage; ``gram``: words in a hashed gram.

    Up to ``broadcast_bytes`` of test fingerprints and words, and of ids of
    texts that share a fingerprint, are broadcast; beyond that the joins
    shuffle.
    """

    span: int = 12
    gram: int = 8
    broadcast_bytes: int = 8 << 20

    @property
    def window(self) -> int:
        """Consecutive grams of which one is kept."""
        return self.span - self.gram + 1


def kept_grams(codes: np.ndarray, params: Winnowing) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and word positions of the grams that winnowing keeps (rightmost smallest of each window)."""
    k, w = params.gram, params.window
    n = len(codes) - k + 1
    if n < w:
        return np.zeros(0, np.int64), np.zeros(0, np.int32)
    total = np.zeros(n, np.uint64)
    factor = np.uint64(0x9E3779B97F4A7C15)
    for i in range(k):
        total = total * factor + codes[i : i + n]
    hashes = mix(total)
    windows = np.lib.stride_tricks.sliding_window_view(hashes, w)
    at = np.unique(np.arange(n - w + 1) + (w - 1 - windows[:, ::-1].argmin(axis=1)))
    return hashes[at].astype(np.int64), at.astype(np.int32)


def _winnow(params: Winnowing):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            ids, hashes, places = [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                h, at = kept_grams(codes(words(text)), params)
                ids.append(np.full(len(h), i, np.int64))
                hashes.append(h)
                places.append(at)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, hashes, places)], names=["id", "gram", "at"])

    return run


def common_span(a: np.ndarray, i: int, b: np.ndarray, j: int) -> tuple[int, int]:
    """Start in ``a`` and length of the longest common run through a[i] and b[j]."""
    back = min(i, j)
    same = a[i - back : i][::-1] == b[j - back : j][::-1]
    left = back if same.all() else int(same.argmin())
    ahead = min(len(a) - i, len(b) - j)
    same = a[i : i + ahead] == b[j : j + ahead]
    right = ahead if same.all() else int(same.argmin())
    return i - left, left + right


def leaks(corpus: DataFrame, items: DataFrame, params: Winnowing | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, length): the longest common span of each leaking pair.

    ``corpus``: (doc_id, text); ``items``: (item_id, text).  Null, empty and
    shorter texts hold no passage.  A pair comes out once if the span has at
    least ``span`` words.  Repeated rows of an id count as further texts of it.

    All corpus texts are fingerprinted; only those that share a fingerprint
    with some item are read again and travel for the extension.
    """
    params = params or Winnowing()
    corpus = corpus.where("doc_id is not null and text is not null").select("doc_id", "text")
    items = items.where("item_id is not null and text is not null").select("item_id", "text")
    sizes = items.agg(F.coalesce(F.sum(F.octet_length("text") * 4), F.lit(0)).alias("b")).first()["b"]
    small = F.broadcast if sizes <= params.broadcast_bytes else (lambda df: df)
    wanted = cut(items.mapInArrow(_winnow(params), "id long, gram long, at int").select(F.col("id").alias("item_id"), "gram").distinct())
    # Grams of the corpus meet the items' grams first; only hits go on.
    grams = corpus.mapInArrow(_winnow(params), "id long, gram long, at int")
    hits = cut(grams.join(small(wanted), "gram").select(F.col("id").alias("doc_id"), "item_id").distinct())
    # The hits' ids go to where the texts are, 16 bytes each; more of them than may be broadcast meet the texts in a shuffle.
    near = F.broadcast if hits.count() * 16 <= params.broadcast_bytes else (lambda df: df)
    texts = corpus.join(near(hits), "doc_id").join(small(items.withColumnRenamed("text", "item_text")), "item_id").select("doc_id", "item_id", "text", "item_text")

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = Codes()
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, item, text, other in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = codes(words(text)), codes(words(other))
                h, at = kept_grams(a, params)
                g, place = kept_grams(b, params)
                best = (0, 0)
                order = np.argsort(h, kind="stable")
                for x, j in zip(g, place, strict=True):
                    for r in order[np.searchsorted(h[order], x) : np.searchsorted(h[order], x, "right")]:
                        start, length = common_span(a, int(at[r]), b, int(j))
                        if length > best[1] or (length == best[1] and start < best[0]):
                            best = (start, length)
                if best[1] >= params.span:
                    out.append((doc, item, *best))
            columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start_word", "length"])

    found = texts.mapInArrow(extend, "doc_id long, item_id long, start_word int, length int")
    best = F.max_by(F.struct("start_word", "length"), F.struct("length", (-F.col("start_word")).alias("s"))).alias("b")
    return found.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "b.start_word", "b.length")
