"""Operator 8: chroma audio fingerprints of media columns.

A recording's samples give overlapping frames; a frame's spectrum is folded onto the 12 pitch classes.  Over the integral
image of these frames, filters compare the sums of rectangles, as wide in time as FILTER_FRAMES and some pitch classes
high; each filter's answer is quantised to two bits in Gray code, and the 16 filters make one packed 32-bit integer a
frame.  Recordings are aligned over all differences of their positions: Fourier transforms count the equal bits at every
one, and those whose overlap has few enough bit errors are verified on the integers.  There a run of RUN integers is a
vote if at most VOTE_ERRORS of its bits differ; of the differences with LEAST_VOTES votes the one with the least bit error
wins.  With least_votes=0 the bit errors alone decide.

Recordings with the same integers are one class, named by the smallest id; alignment runs between classes, so a recording
with many copies costs no more than one.

Edge cases: a null or empty recording, or one shorter than a filter, has no integers and aligns with nothing, itself
included in the class of such recordings; silence gives constant integers; integers that repeat within a recording vote at
every position; ties between offsets go to the smallest shift; rows without id are fingerprinted but are never
queries; repeated rows are one class; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches
from weftspark.session import stored

RATE = 4000
FRAME, HOP = 512, 256
FILTER_FRAMES = 8
FILTERS = 16
#: Quantiser: the logarithm of the ratio of two sums, cut at these places.
CUTS = (-0.35, 0.0, 0.35)
GRAY = np.array([0, 1, 3, 2], np.uint32)
RUN = 4
#: Votes that the winning offset needs, the least overlap in frames, and the largest share of differing bits.
LEAST_VOTES, LEAST_OVERLAP, MOST_ERRORS = 2, 16, 0.25
#: The largest share of differing bits in a run that votes.
VOTE_ERRORS = MOST_ERRORS / 2
#: Bytes of integers in a block of queries and in a block of classes; of a product of two blocks' parts; of kept spectra.
QUERY_BYTES, CLASS_BYTES, PRODUCT_BYTES, SPECTRA_BYTES = 4 << 20, 512 << 10, 1 << 20, 64 << 20
#: Far above what single precision loses in a share of equal bits.
SLACK = 1e-4


def _filters() -> list[tuple[int, int, int]]:
    """(kind, first pitch class, height) of each filter, by rule: kinds alternate, bands step through the octave."""
    return [(i % 4, (5 * i) % 12, 1 + (i // 4) % 3) for i in range(FILTERS)]


def _fold() -> np.ndarray:
    """Spectrum bins x pitch classes: each bin's class by its frequency; bins below 100 Hz are left out."""
    hz = np.fft.rfftfreq(FRAME, 1 / RATE)
    out = np.zeros((len(hz), 12), np.float32)
    for i in np.flatnonzero(hz >= 100):
        out[i, round(12 * np.log2(hz[i] / 440)) % 12] = 1
    return out


_WINDOW, _CLASSES = np.hanning(FRAME).astype(np.float32), _fold()


def chroma(samples: np.ndarray) -> np.ndarray:
    """Frames x 12 pitch-class energies, each frame scaled to sum to one."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12), np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n] * _WINDOW
    energy = (np.abs(np.fft.rfft(frames, axis=1)) ** 2).astype(np.float32) @ _CLASSES
    return energy / (energy.sum(axis=1, keepdims=True) + 1e-6)


def packed(frames: np.ndarray) -> np.ndarray:
    """The packed integer of each position that a filter fits at, from the integral image of the frames."""
    n = len(frames) - FILTER_FRAMES + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    wide = np.concatenate([frames, frames[:, :6]], axis=1)  # bands wrap round the octave
    image = np.zeros((len(wide) + 1, wide.shape[1] + 1))
    image[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)

    def total(start: int, frames_: int, low: int, high: int) -> np.ndarray:
        a, b = image[start : start + n], image[start + frames_ : start + frames_ + n]
        return b[:, high] - b[:, low] - a[:, high] + a[:, low]

    half, out = FILTER_FRAMES // 2, np.zeros(n, np.uint32)
    for kind, low, height in _filters():
        high, full = low + height, FILTER_FRAMES
        if kind == 0:  # a band against the band above it
            x, y = total(0, full, low, high), total(0, full, high, high + height)
        elif kind == 1:  # earlier against later
            x, y = total(0, half, low, high), total(half, half, low, high)
        elif kind == 2:  # crosswise
            x = total(0, half, low, high) + total(half, half, high, high + height)
            y = total(half, half, low, high) + total(0, half, high, high + height)
        else:  # the middle against both ends
            x = 2 * total(half // 2, half, low, high)
            y = total(0, full, low, high)
        level = np.searchsorted(CUTS, np.log((0.05 + x) / (0.05 + y)))
        out = out << np.uint32(2) | GRAY[level]
    return out


def pcm16(value: bytes | None) -> np.ndarray:
    """Samples of raw little-endian 16-bit mono audio at RATE."""
    value = value or b""
    return np.frombuffer(value[: len(value) // 2 * 2], "<i2").astype(np.float32) / 32768


_NOTES = np.array([[np.sin(2 * np.pi * 220 * 2 ** (c / 12) * t / RATE) for t in range(2 * HOP)] for c in range(12)], np.float32)


def melody(vector: list[float] | None) -> np.ndarray:
    """Samples of the tune that a vector stands for: one note a value, its pitch by the value, for tables without audio."""
    if not vector:
        return np.zeros(0, np.float32)
    values = np.nan_to_num(np.array([0.0 if v is None else v for v in vector], np.float64))
    steps = np.clip(np.floor(values * 3 * len(values) ** 0.5) + 6, 0, 11).astype(int)
    return _NOTES[steps].ravel()


def fingerprints(df: DataFrame, media: str, id_column: str, decode: Callable[[object], np.ndarray] = pcm16) -> DataFrame:
    """id and prints (array<int>) of every row; decode turns the media column's value into samples at RATE."""
    small_batches(df.sparkSession)
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [packed(chroma(decode(v))).view(np.int32) for v in column(batch, "__media").to_pylist()]
            offsets = pa.array(np.cumsum([0, *map(len, rows)]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "__id"), lists], names=["id", "prints"])

    return df.select(F.col(id_column).alias("__id"), F.col(media).alias("__media")).mapInArrow(run, f"id {kind}, prints array<int>")


def _spectra(prints: list[np.ndarray], size: int) -> np.ndarray:
    """Frequencies x recordings x 32: the transform of each bit over time, as 1 and -1, and 0 behind the end."""
    bits = np.zeros((size, len(prints), 32), np.float32)
    for i, own in enumerate(prints):
        bits[: len(own), i] = np.unpackbits(own.view(np.uint8).reshape(-1, 4), axis=1) * np.float32(2) - 1
    return np.fft.rfft(bits, axis=0)


def best_shift(own: np.ndarray, other: np.ndarray, shifts: np.ndarray, shares: np.ndarray, least_votes: int) -> tuple[float, int] | None:
    """Bit error and shift of the best of these shifts, whose shares (equal less differing bits) are known up to SLACK."""
    best = None
    for i in np.lexsort((-shifts, np.abs(shifts), -np.round(shares, 4))):
        if best is not None and (best[0] == 0 or shares[i] + 2 * SLACK < 1 - 2 * best[0]):
            break
        s = int(shifts[i])
        a, b = own[max(s, 0) :], other[max(-s, 0) :]
        n = min(len(a), len(b))
        differ = np.bitwise_count(a[:n] ^ b[:n]).astype(np.int64)
        error = int(differ.sum()) / (32.0 * n)
        if error > MOST_ERRORS or least_votes and (np.convolve(differ, np.ones(RUN, np.int64), "valid") <= VOTE_ERRORS * 32 * RUN).sum() < least_votes:
            continue
        best = min(best or (2.0,), (error, abs(s), -s))
    return best and (best[0], -best[2])


def _links(asked: list[np.ndarray], others: list[np.ndarray], least_votes: int, kept: dict[tuple[int, int], np.ndarray] | None = None) -> Iterator[tuple[int, int, float, int]]:
    """(index in asked, index in others, bit error, shift) of each pair with a link; all offsets are compared.

    kept has spectra of the same asked recordings from a call before, and takes new ones.
    """
    kept = {} if kept is None else kept
    room: dict[tuple[int, int, int], tuple[np.ndarray, np.ndarray]] = {}
    by_length = [sorted(range(len(x)), key=lambda i: len(x[i])) for x in (asked, others)]
    longest = max(len(x[o[-1]]) for x, o in zip((asked, others), by_length, strict=True))
    step = max(1, int((PRODUCT_BYTES / (8 * longest)) ** 0.5))
    parts = [[o[i : i + step] for i in range(0, len(o), step)] for o in by_length]
    for there in parts[1]:
        b, held = [others[j] for j in there], (0, None)
        for k, here in enumerate(parts[0]):
            a = [asked[i] for i in here]
            least = len(a[-1]) + len(b[-1]) - LEAST_OVERLAP  # so that no offset with enough overlap meets another one
            unit = 1 << max(1, least.bit_length() - 4)
            size = -(-least // unit) * unit
            if (k, size) not in kept:
                if sum(x.nbytes for x in kept.values()) > SPECTRA_BYTES:
                    kept.clear()
                kept[k, size] = _spectra(a, size)
            if held[0] != size:
                held = size, np.conj(_spectra(b, size)).transpose(0, 2, 1)
            shape = size, len(a), len(b)
            if shape not in room:  # the arrays of a block are written over by the next one
                room.clear()
                room[shape] = np.empty((size // 2 + 1, *shape[1:]), np.complex64), np.empty(shape, np.float32)
            product, equal = room[shape]
            np.matmul(kept[k, size], held[1], out=product)
            np.fft.irfft(product, size, axis=0, out=equal)  # equal bits less differing ones
            shifts = np.arange(size)
            shifts[shifts > len(a[-1]) - LEAST_OVERLAP] -= size
            la, lb = (np.array([len(x) for x in side][: 1 if len(side[0]) == len(side[-1]) else None]) for side in (a, b))
            overlap = np.minimum(la[:, None], lb + shifts[:, None, None]) - np.maximum(shifts, 0)[:, None, None]
            low = 1 - 2 * MOST_ERRORS - SLACK
            wanted = np.where(overlap >= LEAST_OVERLAP, 32 * low * overlap, np.inf).astype(np.float32)
            for i, j in zip(*np.nonzero((equal >= wanted).any(axis=0)), strict=True):
                own = overlap[:, min(i, len(la) - 1), min(j, len(lb) - 1)]
                at = np.flatnonzero(equal[:, i, j] >= wanted[:, min(i, len(la) - 1), min(j, len(lb) - 1)])
                if (best := best_shift(a[i], b[j], shifts[at], equal[at, i, j] / (32 * own[at]), least_votes)) is not None:
                    yield here[i], there[j], *best


def align(prints: DataFrame, every: int = 50, least_votes: int = LEAST_VOTES) -> DataFrame:
    """Of every row: id, prints, class_id; and for rows whose id is divisible by `every`, the alignment with other classes:
    n_links, and the best one's match_id, shift and bit_error (null without a link).

    Blocks of queries meet blocks of classes, each pair of blocks at all offsets: the work is the product of their numbers.
    """
    digest = F.md5(F.array_join(F.col("prints").cast("array<string>"), ",").cast("binary"))  # a short key for equal integers
    prints = stored(prints.withColumn("digest", digest), "prints")
    is_query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    classes = prints.groupBy("digest").agg(F.min("id").alias("class_id"), F.max(is_query).alias("asked"), F.any_value("prints").alias("prints"))
    classes = stored(classes, "classes")
    kind = classes.schema["class_id"].dataType.simpleString()
    able = classes.filter((F.size("prints") >= LEAST_OVERLAP) & F.col("class_id").isNotNull())
    size = F.size("prints").cast("bigint") * 4
    total = able.agg(F.sum(F.when(F.col("asked"), size)), F.sum(size)).first()
    q_blocks, c_blocks = max(1, -(-(total[0] or 0) // QUERY_BYTES)), max(1, -(-(total[1] or 0) // CLASS_BYTES))
    block = lambda n: F.pmod(F.xxhash64("digest"), F.lit(n)).cast("int")
    every_block = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = able.select("class_id", "prints", block(c_blocks).alias("cb")).withColumn("qb", every_block(q_blocks))
    right = able.filter("asked").select(F.col("class_id").alias("query"), "prints", block(q_blocks).alias("qb")).withColumn("cb", every_block(c_blocks))

    last: dict[str, object] = {"queries": None, "kept": {}}  # of the task's group before: often the same queries again

    def compare(others: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = pa.schema([("query", others.schema.field("class_id").type), ("n_links", pa.int64()), ("bit_error", pa.float64()), ("class_id", others.schema.field("class_id").type), ("shift", pa.int32())])
        if not others.num_rows or not asked.num_rows:
            return kinds.empty_table()
        asked = asked.sort_by("query")
        names, queries = others["class_id"].to_pylist(), asked["query"].to_pylist()
        if last["queries"] != queries:
            last.update(queries=queries, kept={})
        arrays = [[row.values.to_numpy(zero_copy_only=False).view(np.uint32) for chunk in table["prints"].chunks for row in chunk] for table in (asked, others)]
        found: dict = {}
        for i, j, error, shift in _links(*arrays, least_votes, last["kept"]):
            if queries[i] != names[j]:
                n, top = found.get(queries[i], (0, None))
                link = error, names[j], shift
                found[queries[i]] = n + 1, link if top is None else min(top, link)
        return pa.Table.from_pylist([{"query": q, "n_links": n, "bit_error": top[0], "class_id": top[1], "shift": top[2]} for q, (n, top) in found.items()], schema=kinds)

    links = left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(compare, f"query {kind}, n_links bigint, bit_error double, class_id {kind}, shift int")
    found = links.groupBy("query").agg(F.sum("n_links").alias("n_links"), F.min(F.struct("bit_error", "class_id", "shift")).alias("top"))
    named = classes.select("digest", "class_id").join(found, F.col("class_id") == F.col("query"), "left")
    return prints.join(named, "digest").select(
        "id",
        "prints",
        "class_id",
        F.when(is_query, F.coalesce("n_links", F.lit(0))).alias("n_links"),
        F.when(is_query, F.col("top.class_id")).alias("match_id"),
        F.when(is_query, F.col("top.shift")).alias("shift"),
        F.when(is_query, F.col("top.bit_error")).alias("bit_error"),
    )
