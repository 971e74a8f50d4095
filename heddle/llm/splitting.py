"""Oversized texts into overlapping pieces, by ranges.

A text is read in ranges with a halo; each range finds its own natural
boundaries, and neighbours agree on where one range ends and the next starts
by looking at the same halo.  Each range's boundaries become a table of
positions and token counts; the counts of the ranges are summed up to global
token offsets.  Cuts are then chosen by offset alone: cut k is the best
boundary among the tokens [k*stride - slack, k*stride), so every cut is
independent of the others, and pieces are put together from the ranges they
touch.  A text of one range needs no stitching: its offsets are known where it
is read, and its pieces come out there by the same rule, without a shuffle.

``split`` takes texts of a table, ``split_files`` whole files, of which each
task reads byte ranges only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heddle.llm.tokens import VOCABULARY, encoding
from heddle.session import cut, partitions

#: Strength of a boundary: paragraph, line, sentence, word, none.
PARAGRAPH, LINE, SENTENCE, WORD, HARD = 4, 3, 2, 1, 0

#: Natural boundaries further apart than this many tokens get hard ones between them.
LONGEST_ATOM = 48
#: Bytes between hard boundaries.
HARD_BYTES = 64


#: An atom as stored and as it travels with the window of a cut: global token and position offsets.
ATOM = np.dtype([("width", "<u4"), ("tokens", "u1"), ("strength", "u1")])
PLACE = np.dtype([("tok", "<i8"), ("pos", "<i8"), ("strength", "u1")])


@dataclass(frozen=True)
class Pieces:
    """``limit``: most tokens of a piece; ``overlap``: tokens a piece repeats of the one before.

    ``slack``: tokens before a cut's latest place among which the strongest
    boundary is looked for.  ``size`` and ``halo``: characters (bytes of a
    file) of a range and of what it reads beyond its end.
    """

    limit: int = 512
    overlap: int = 64
    slack: int = 128
    size: int = 16_384
    halo: int = 256
    vocabulary: str = VOCABULARY

    def __post_init__(self) -> None:
        if self.slack <= LONGEST_ATOM + HARD_BYTES or self.overlap > self.stride or self.stride <= 0 or self.halo < 8:
            raise ValueError("the limit is too small for this overlap and slack")

    @property
    def stride(self) -> int:
        """Tokens between the latest places of two cuts; two tokens are kept in reserve."""
        return self.limit - self.overlap - self.slack - 2


_BREAK = re.compile(r"(?<=\S)[ \t\n\r\v\f]")
_BYTE_BREAK = re.compile(rb"(?<=[^ \t\n\r\v\f])[ \t\n\r\v\f]")


def _agreed(body: str | bytes, start: int, halo: int) -> int:
    """The first place from ``start`` within the halo where white space follows something else, else ``start`` (of bytes: of the next character)."""
    found = (_BREAK if isinstance(body, str) else _BYTE_BREAK).search(body, max(1, start), min(len(body), start + halo))
    if found:
        return found.start()
    while isinstance(body, bytes) and start < len(body) and body[start] & 0xC0 == 0x80:
        start += 1
    return start


def atoms(text: str, encode, in_bytes: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:  # noqa: ANN001
    """End positions (characters, or bytes if asked), token counts and end strengths of the atoms of ``text``, and its tokens.

    Atoms end where white space follows something else; there the tokenizer
    always splits, so counts of atoms add up exactly.  Stretches without such
    places get hard ends, counted with one token in reserve.
    """
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int8), 0
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    starts = np.flatnonzero(space[1:] & ~space[:-1]) + 1
    ids = encode(text)
    widths = _widths(encode)[np.asarray(ids, np.int64)]
    begin = np.cumsum(widths) - widths
    ends = np.append(starts, len(raw))
    counts = np.diff(np.searchsorted(begin, ends, "left"), prepend=0)
    # Strength: what the run of white space after the end holds, or the mark before it.
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    words = np.flatnonzero(~space[1:] & space[:-1]) + 1
    run_end = np.append(words, len(raw))[np.searchsorted(words, starts, "right")] if len(starts) else starts
    lines = newline[run_end] - newline[starts]
    mark = np.isin(raw[starts - 1], np.frombuffer(b".!?:;", np.uint8)) if len(starts) else np.zeros(0, bool)
    strength = np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(mark, SENTENCE, WORD)))
    strength = np.append(strength, HARD)
    long = np.flatnonzero(counts > LONGEST_ATOM)
    if len(long):
        ends, counts, strength = _hard(text, raw, ends, counts, strength, set(long.tolist()), encode)
    if not in_bytes:
        ends = np.cumsum((raw & 0xC0) != 0x80)[ends - 1]
    return ends, counts, strength.astype(np.int8), len(ids)


def _hard(text: str, raw: np.ndarray, ends: np.ndarray, counts: np.ndarray, strength: np.ndarray, long: set[int], encode):  # noqa: ANN001, ANN202
    out: list[tuple[int, int, int]] = []
    begin = 0
    for i, end in enumerate(ends.tolist()):
        if i in long:
            at = begin
            while at < end:
                stop = min(end, at + HARD_BYTES)
                while stop < end and raw[stop] & 0xC0 == 0x80:
                    stop -= 1
                part = raw[at:stop].tobytes().decode("utf-8", "surrogatepass")
                out.append((stop, len(encode(part)) + 1, HARD if stop < end else int(strength[i])))
                at = stop
        else:
            out.append((end, int(counts[i]), int(strength[i])))
        begin = end
    table = np.array(out, np.int64)
    return table[:, 0], table[:, 1], table[:, 2]


_WIDTHS: dict[int, np.ndarray] = {}


def _widths(encode) -> np.ndarray:  # noqa: ANN001
    """Bytes of each token."""
    owner = encode.__self__
    if id(owner) not in _WIDTHS:
        _WIDTHS[id(owner)] = np.array([len(b) for b in owner.token_byte_values()], np.int64)[np.argsort(_ranks(owner))]
    return _WIDTHS[id(owner)]


def _ranks(owner) -> np.ndarray:  # noqa: ANN001
    return np.array([owner.encode_single_token(b) for b in owner.token_byte_values()])


def _own(body: str | bytes, number: int, last: bool, params: Pieces) -> tuple[int, str | bytes]:
    """Global start and content of what belongs to a range."""
    off = 0 if number == 0 else 1
    low = 0 if number == 0 else _agreed(body, off, params.halo)
    high = len(body) if last else _agreed(body, off + params.size, params.halo)
    return number * params.size - off + low, body[low:high]


def _text(body: str | bytes) -> str:
    return body if isinstance(body, str) else body.decode("utf-8", "replace")


def best_cut(at: np.ndarray, strength: np.ndarray, k: int, params: Pieces) -> tuple[int, int]:
    """Index of the atom that ends at cut k (the last of the strongest), and of the one where the next piece starts."""
    low, high = np.searchsorted(at, [k * params.stride - params.slack, k * params.stride])
    i = int(high - 1 - np.argmax(strength[low:high][::-1]))
    return i, int(np.searchsorted(at, at[i] - params.overlap))


def _whole_texts(params: Pieces):  # noqa: ANN202
    """Pieces of texts that are one range each; columns key and body."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(params.vocabulary).encode_ordinary
        for batch in batches:
            out: list[tuple] = []
            for key, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ends, counts, strength, real = atoms(_text(body), encode, isinstance(body, bytes))
                if real <= params.limit:
                    continue
                at = np.cumsum(counts)
                tok = pos = 0
                pieces = -(-int(at[-1]) // params.stride)
                for k in range(1, pieces + 1):
                    i, j = best_cut(at, strength, k, params) if k < pieces else (len(at) - 1, 0)
                    out.append((key, k, pos, int(ends[i]), int(at[i]) - tok, _text(body[pos : int(ends[i])])))
                    tok, pos = int(at[j]), int(ends[j])
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "piece_no", "start", "stop", "tokens", "piece"])

    return run


def _tables(params: Pieces):  # noqa: ANN202
    """The boundary table of each range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(params.vocabulary).encode_ordinary
        for batch in batches:
            out: list[tuple] = []
            for k, number, last, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start, own = _own(body, number, last, params)
                ends, counts, strength, real = atoms(_text(own), encode, isinstance(own, bytes))
                packed = zlib.compress(np.rec.fromarrays([np.diff(ends, prepend=0), counts, strength], dtype=ATOM).tobytes(), 1)
                out.append((k, number, start, len(own), packed, int(counts.sum()), real))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64())
            names = ["key", "range_no", "start", "length", "atoms", "total", "real"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return run


def _windows(params: Pieces):  # noqa: ANN202
    """The atoms that can matter to a cut: those of its slack and of the overlap before that."""
    reach = params.slack + params.overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, numbers, packed = [], [], []
            for key, start, base, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                table = np.frombuffer(zlib.decompress(raw), ATOM)
                at, ends = base + np.cumsum(table["tokens"], dtype=np.int64), start + np.cumsum(table["width"], dtype=np.int64)
                places = np.rec.fromarrays([at, ends, table["strength"]], dtype=PLACE)
                if not len(at):
                    continue
                cuts = np.arange(at[0] // params.stride + 1, (at[-1] + reach) // params.stride + 1)
                low, high = np.searchsorted(at, cuts * params.stride - reach), np.searchsorted(at, cuts * params.stride)
                for k, a, b in zip(cuts.tolist(), low.tolist(), high.tolist(), strict=True):
                    if a < b:
                        keys.append(key)
                        numbers.append(k)
                        packed.append(places[a:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(numbers, pa.int64()), pa.array(packed, pa.binary())], names=["key", "k", "places"])

    return run


def _cuts(params: Pieces):  # noqa: ANN202
    """Where each cut is, and where the piece after it starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                table = np.frombuffer(b"".join(sorted(parts, key=lambda p: np.frombuffer(p, PLACE, 1)["pos"][0])), PLACE)
                i, j = best_cut(table["tok"], table["strength"], k, params)
                found.append((int(table["tok"][i]), int(table["pos"][i]), int(table["tok"][j]), int(table["pos"][j])))
            columns = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in columns]], names=["key", "k", "tok", "pos", "from_tok", "from_pos"])

    return run


def _stitched(bodies: DataFrame, params: Pieces) -> DataFrame:
    """(key, piece_no, start, stop, tokens, piece) of texts of several ranges; ``bodies``: (key, range_no, last, body)."""
    kind = bodies.schema["body"].dataType.simpleString()
    tabled = cut(bodies.mapInArrow(_tables(params), "key long, range_no long, start long, length long, atoms binary, total long, real long"))
    # One row for each range travels here.
    within = Window.partitionBy("key")
    sums = tabled.select("key", "range_no", "start", "length", "total", "real")
    sums = sums.withColumn("base", F.sum("total").over(within.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select("key", "range_no", "start", (F.col("start") + F.col("length")).alias("end"), F.coalesce("base", F.lit(0)).alias("base"), F.sum("total").over(within).alias("whole"), F.sum("real").over(within).alias("_real"))
    sums = cut(sums.where(F.col("_real") > params.limit).drop("_real"))
    docs = sums.groupBy("key").agg(F.ceil(F.max("whole") / params.stride).alias("pieces"), F.max("whole").alias("whole"), F.max("end").alias("end"))
    based = tabled.select("key", "range_no", "atoms").join(sums.select("key", "range_no", "start", "base"), ["key", "range_no"]).select("key", "start", "base", "atoms")
    windows = based.mapInArrow(_windows(params), "key long, k long, places binary").join(docs.select("key", "pieces"), "key").where("k < pieces")
    # A window holds as many atoms as slack and overlap have tokens, from the few ranges it touches.
    windows = windows.groupBy("key", "k").agg(F.collect_list("places").alias("places"))
    cuts = cut(windows.mapInArrow(_cuts(params), "key long, k long, tok long, pos long, from_tok long, from_pos long"))
    ends = cuts.select("key", F.col("k").alias("piece_no"), F.col("tok").alias("to_tok"), F.col("pos").alias("stop"))
    ends = ends.unionByName(docs.select("key", F.col("pieces").alias("piece_no"), F.col("whole").alias("to_tok"), F.col("end").alias("stop")))
    pieces = ends.join(cuts.select("key", (F.col("k") + 1).alias("piece_no"), "from_tok", "from_pos"), ["key", "piece_no"], "left")
    pieces = pieces.select("key", "piece_no", F.coalesce("from_pos", F.lit(0)).alias("start"), "stop", (F.col("to_tok") - F.coalesce("from_tok", F.lit(0))).alias("tokens"))
    # A range may reach into the halo of the next one, never further.
    low, high = F.floor(F.col("start") / params.size) - 1, F.floor(F.col("stop") / params.size)
    touched = pieces.withColumn("range_no", F.explode(F.sequence(F.greatest(low, F.lit(0)), high)))

    def owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_own(body, number, last, params) for number, last, body in zip(*[c.to_pylist() for c in batch.columns[1:]], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([s for s, _ in found], pa.int64()), pa.array([o for _, o in found], batch.column(3).type)], names=["key", "range_no", "from", "own"])

    # Ranges are read again rather than kept.
    texts = touched.join(bodies.mapInArrow(owned, f"key long, range_no long, from long, own {kind}"), ["key", "range_no"])
    begin, stop = F.greatest("start", "from"), F.least("stop", F.col("from") + (F.length("own")))
    part = F.substring("own", (begin - F.col("from") + 1).cast("int"), (stop - begin).cast("int"))
    texts = texts.where(begin < stop).select("key", "piece_no", "start", "stop", "tokens", F.struct("range_no", part.alias("t")).alias("p"))
    whole = texts.groupBy("key", "piece_no", "start", "stop", "tokens").agg(F.array_sort(F.collect_list("p")).alias("p"))
    joined = F.array_join("p.t", "") if kind == "string" else F.make_valid_utf8(F.aggregate("p.t", F.lit(b""), lambda a, b: F.concat(a, b)).cast("string"))
    return whole.select("key", "piece_no", "start", "stop", "tokens", joined.alias("piece"))


_PIECE = "key long, piece_no long, start long, stop long, tokens long, piece string"


def ranges(params: Pieces):  # noqa: ANN201
    """(key, range_no, last, body) of rows (key, text): each text is cut once, with one character before each range and the halo after."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                n = -(-len(text) // params.size)
                # A giant text leaves in several batches.
                for first in range(0, n, 256):
                    own = range(first, min(n, first + 256))
                    found = [text[max(0, r * params.size - 1) : (r + 1) * params.size + params.halo] for r in own]
                    columns = [pa.array([key] * len(own), pa.int64()), pa.array(list(own), pa.int64()), pa.array([r == n - 1 for r in own]), pa.array(found, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "range_no", "last", "body"])

    return run


def split(df: DataFrame, key: str, text: str, params: Pieces | None = None) -> DataFrame:
    """(key, piece_no, start_char, end_char, tokens, piece) of every text above the limit.

    Texts up to the limit, null and empty ones give no rows; a key should name
    one text.  ``tokens`` is at most ``limit`` and an upper bound of the
    piece's tokens, exact where the piece holds no hard cut.  Consecutive
    pieces share as many whole atoms (words) as fit into ``overlap`` tokens.
    Pieces cover the text without a gap.
    """
    params = params or Pieces()
    rows = df.where(F.col(key).isNotNull() & (F.octet_length(F.col(text)) > params.limit)).select(F.col(key).cast("long").alias("key"), F.col(text).alias("body"))
    one = rows.where(F.length("body") <= params.size).mapInArrow(_whole_texts(params), _PIECE)
    several = rows.where(F.length("body") > params.size).mapInArrow(ranges(params), "key long, range_no long, last boolean, body string")
    out = one.unionByName(_stitched(several, params))
    return out.select(F.col("key").alias(key), F.col("piece_no").cast("int").alias("piece_no"), F.col("start").alias("start_char"), F.col("stop").alias("end_char"), "tokens", "piece")


def split_files(spark: SparkSession, paths: list[str], params: Pieces | None = None) -> DataFrame:
    """(path, piece_no, start_byte, end_byte, tokens, piece) of UTF-8 files above the limit, whatever their size.

    ``paths`` are files or folders (read recursively) on storage that all
    executors see.  Only names and sizes are listed; tasks open a file at
    their range and read that and its halo.  Bytes that are no UTF-8 come out
    as replacement characters.
    """
    from pyarrow import fs

    params = params or Pieces()
    listed: list[tuple[str, int]] = []
    for path in paths:
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
        info = system.get_file_info(inner)
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
        listed += [(prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and f.size > params.limit]
    listed = sorted(set(listed))
    files = spark.createDataFrame([(i, p, n) for i, (p, n) in enumerate(listed)], "key long, path string, n long")
    spread = files.select("key", "path", F.ceil(F.col("n") / params.size).alias("count")).select("key", "path", "count", F.explode(F.sequence(F.lit(0).cast("long"), F.col("count") - 1)).alias("range_no"))
    # Neighbouring ranges go to one task, so that it reads on where it is; 256 of them are 4 MB by default.
    spread = spread.repartition(partitions(spark), "key", F.floor(F.col("range_no") / 256)).sortWithinPartitions("key", "range_no")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, opened, handle = [], None, None
            for path, number in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if path != opened:
                    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
                    opened, handle = path, system.open_input_file(inner)
                begin = max(0, number * params.size - 1)
                bodies.append(handle.read_at((number + 1) * params.size + params.halo - begin, begin))
            last = pc.equal(batch.column(3), pc.subtract(batch.column(2), 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), last, pa.array(bodies, pa.binary())], names=["key", "range_no", "last", "body"])

    bodies = lambda one: spread.where(F.col("count") == 1 if one else F.col("count") > 1).mapInArrow(read, "key long, range_no long, last boolean, body binary")
    out = bodies(True).select("key", "body").mapInArrow(_whole_texts(params), _PIECE).unionByName(_stitched(bodies(False), params))
    return out.join(files.select("key", "path"), "key").select("path", F.col("piece_no").cast("int").alias("piece_no"), F.col("start").alias("start_byte"), F.col("stop").alias("end_byte"), "tokens", "piece")
