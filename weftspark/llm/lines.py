"""Operator 7: line dedup with two Bloom filters, for hashes seen once and hashes seen twice.

A line's key is the line without ASCII white space at its ends, A-Z in lower case.  Keys of at least MIN_CHARS code
points that at least MIN_DOCS documents hold lose all their lines but those of the largest id that holds the key.

1. Every task fills a once filter and a twice filter with the key hashes of its documents.  Filters are merged segment
   by segment in two levels of shuffles: once = OR, twice = OR of the twice filters and of what two once filters share.
   The filters' size follows the number of lines up to max_filter_bits; a fuller filter only lets more lines through.
2. Only suspected repeats, whose bits are all in the twice filter, are shuffled: 128-bit digests, counted per task first.
   The exact count decides, and the largest id is chosen.
3. The repeats are applied to the texts: from a broadcast table if there are at most broadcast_rows of them, else joined
   by digest, gathered per document and joined to the documents.

Edge cases: a null or empty text is one empty line and comes back as ''; each row is a document of its own when holders
are counted, so repeated rows count, and rows with the largest id all keep the line; rows whose id is null count but
never are the keeper, and a key held by null ids alone is kept everywhere; an empty table gives an empty result; other
columns pass through, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches, texts
from weftspark.llm.rows import PRIVATE, add_columns
from weftspark.session import stored

MIN_CHARS = 40
MIN_DOCS = 5
#: Bits of a filter for each line, and at most (32 MB, which is broadcast).
BITS_PER_LINE = 8
MAX_FILTER_BITS = 1 << 28
#: Repeated keys that may be broadcast: some 200 bytes each as a Python table in a worker.
BROADCAST_ROWS = 200_000
SEGMENT_BITS = 1 << 18
PROBES = 3
#: Filters of one segment are merged in so many groups first, then these.
SLOTS = 32


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The key of a line, or None if it is too short to be dropped."""
    key = line.strip().lower()  # bytes: ASCII white space and A-Z only
    if len(key) < min_chars or (not key.isascii() and len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _digests(text: bytes, min_chars: int) -> list[tuple[int, int]]:
    """Line number and 128-bit digest of each line that has a key."""
    if len(text) < min_chars:
        return []
    digest = xxhash.xxh3_128_intdigest
    return [(i, digest(key)) for i, line in enumerate(text.split(b"\n")) if (key := line_key(line, min_chars)) is not None]


def _probe(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The PROBES bit positions of each 64-bit hash."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    return np.stack([(hashes + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


def _bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits // 8, np.uint8)
    at = _probe(hashes, bits).ravel().astype(np.int64)
    np.bitwise_or.at(out, at >> 3, (128 >> (at & 7)).astype(np.uint8))
    return out


def _low(digests: list[int]) -> np.ndarray:
    mask = (1 << 64) - 1
    return np.fromiter((d & mask for d in digests), np.uint64, len(digests))


def twice_filter(docs: DataFrame, text: str, min_chars: int = MIN_CHARS, max_bits: int = MAX_FILTER_BITS) -> np.ndarray:
    """The bits of the twice filter of all documents, packed."""
    small_batches(docs.sparkSession)
    breaks = F.length(text) - F.length(F.replace(F.col(text), F.lit("\n"), F.lit("")))
    lines, chars = (n or 0 for n in docs.agg(F.sum(breaks + 1), F.sum(F.length(text))).first())
    lines = max(1, min(lines, chars // max(1, min_chars)))  # shorter ones have no key
    bits = min(max_bits, max(SEGMENT_BITS, 1 << int(BITS_PER_LINE * lines - 1).bit_length()))
    schema = "segment int, slot int, once binary, twice binary"

    def pieces(once: np.ndarray, twice: np.ndarray, slot: int) -> pd.DataFrame:
        width = SEGMENT_BITS // 8
        rows = [(i // width, slot, zlib.compress(once[i : i + width], 1), zlib.compress(twice[i : i + width], 1)) for i in range(0, bits // 8, width) if once[i : i + width].any()]
        return pd.DataFrame(rows, columns=["segment", "slot", "once", "twice"])

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [_low(list({d for _, d in _digests(t, min_chars)})) for batch in batches for t in texts(column(batch, text))]
        hashes, counts = np.unique(np.concatenate(seen), return_counts=True) if seen else (np.zeros(0, np.uint64), np.zeros(0))
        if len(hashes):
            slot = TaskContext.get().partitionId() % SLOTS
            yield pa.RecordBatch.from_pandas(pieces(_bitmap(hashes, bits), _bitmap(hashes[counts > 1], bits), slot).astype({"segment": "int32", "slot": "int32"}), preserve_index=False)

    def merge(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        once = np.zeros(SEGMENT_BITS // 8, np.uint8)
        twice = once.copy()
        for a, b in zip(group["once"], group["twice"], strict=True):
            own = np.frombuffer(zlib.decompress(a), np.uint8)
            twice |= np.frombuffer(zlib.decompress(b), np.uint8) | (once & own)
            once |= own
        return pd.DataFrame([(key[0], 0, zlib.compress(once, 1), zlib.compress(twice, 1))], columns=["segment", "slot", "once", "twice"])

    filled = docs.select(F.col(text).cast("string").alias(text)).mapInArrow(fill, schema)
    merged = filled.groupBy("segment", "slot").applyInPandas(merge, schema).groupBy("segment").applyInPandas(merge, schema)
    out = np.zeros(bits // 8, np.uint8)
    for row in merged.select("segment", "twice").toLocalIterator():  # bounded by max_bits
        at = row["segment"] * (SEGMENT_BITS // 8)
        out[at : at + SEGMENT_BITS // 8] = np.frombuffer(zlib.decompress(row["twice"]), np.uint8)
    return out


def _suspects(bitmap: np.ndarray, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of the (line, digest) pairs whose bits are all in the filter."""
    if not found:
        return []
    at = _probe(_low([d for _, d in found]), 8 * len(bitmap)).astype(np.int64)
    held = ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)
    return [f for f, h in zip(found, held.tolist(), strict=True) if h]


def _halves(digest: int) -> tuple[int, int]:
    """The digest as two signed 64-bit integers."""
    raw = digest.to_bytes(16, "little")
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def repeated_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_FILTER_BITS) -> tuple[DataFrame, object]:
    """h1, h2 (halves of the digest), holders and keeper of each key to be dropped elsewhere; and the broadcast filter."""
    bitmap = docs.sparkSession.sparkContext.broadcast(twice_filter(docs, text, min_chars, max_bits))

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for doc, t in zip(column(batch, "__id").to_pylist(), texts(column(batch, "__text")), strict=True):
                for digest in {d for _, d in _suspects(bitmap.value, _digests(t, min_chars))}:
                    entry = held.setdefault(digest, [0, None])
                    entry[0] += 1
                    if doc is not None and (entry[1] is None or doc > entry[1]):
                        entry[1] = doc
            if len(held) > 200_000:
                yield rows(held)
                held = {}
        if held:
            yield rows(held)

    def rows(held: dict[int, list]) -> pa.RecordBatch:
        halves = [_halves(d) for d in held]
        return pa.RecordBatch.from_arrays(
            [pa.array([a for a, _ in halves], pa.int64()), pa.array([b for _, b in halves], pa.int64()), pa.array([v[0] for v in held.values()], pa.int64()), pa.array([v[1] for v in held.values()], pa.int64())],
            names=["h1", "h2", "holders", "keeper"],
        )

    slim = docs.select(F.col(id_column).cast("bigint").alias("__id"), F.col(text).cast("string").alias("__text"))
    counted = slim.mapInArrow(suspected, "h1 bigint, h2 bigint, holders bigint, keeper bigint").groupBy("h1", "h2").agg(F.sum("holders").alias("holders"), F.max("keeper").alias("keeper"))
    return stored(counted.filter((F.col("holders") >= min_docs) & F.col("keeper").isNotNull()), "lines"), bitmap


def _cut(text: bytes, drop: set[int]) -> bytes:
    return b"\n".join([line for i, line in enumerate(text.split(b"\n")) if i not in drop]) if drop else text


def dedup_lines(docs: DataFrame, text: str = "text", id_column: str = "doc_id", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, max_bits: int = MAX_FILTER_BITS, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """docs with the private columns kept (the text without dropped lines), n_lines and n_dropped behind its own."""
    repeats, bitmap = repeated_lines(docs, text, id_column, min_chars, min_docs, max_bits)
    fields = {"kept": "string", "n_lines": "bigint", "n_dropped": "bigint"}

    def out(results: list[tuple[bytes, int, int]]) -> list[pa.Array]:
        return [pa.array([r[0].decode("utf-8", "replace") for r in results], pa.string()), pa.array([r[1] for r in results], pa.int64()), pa.array([r[2] for r in results], pa.int64())]

    if repeats.count() <= broadcast_rows:
        known = repeats.toPandas()
        keeper = docs.sparkSession.sparkContext.broadcast({(a, b): k for a, b, k in zip(known["h1"].tolist(), known["h2"].tolist(), known["keeper"].tolist(), strict=True)})

        def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            for batch in batches:
                results = []
                for doc, t in zip(column(batch, id_column).to_pylist(), texts(column(batch, text)), strict=True):
                    drop = set()
                    for i, d in _suspects(bitmap.value, _digests(t, min_chars)):
                        if keeper.value.get(_halves(d), doc) != doc:
                            drop.add(i)
                    results.append((_cut(t, drop), t.count(b"\n") + 1, len(drop)))
                yield out(results)

        return add_columns(docs, fields, apply)

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(column(batch, "__id").to_pylist(), column(batch, "__digest").to_pylist(), texts(column(batch, "__text")), strict=True)
            found = [(doc, digest, *_halves(d)) for doc, digest, t in rows for d in {d for _, d in _suspects(bitmap.value, _digests(t, min_chars))}]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64()))], names=["__id", "__digest", "h1", "h2"])

    # by id and text: rows without id, or with the same one, are gathered text by text
    digest = F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))
    slim = docs.select(F.col(id_column).cast("bigint").alias("__id"), digest.alias("__digest"), F.col(text).cast("string").alias("__text"))
    places = slim.mapInArrow(occurrences, "__id bigint, __digest string, h1 bigint, h2 bigint").distinct().join(repeats, ["h1", "h2"]).filter(~F.col("__id").eqNullSafe(F.col("keeper")))
    gathered = places.groupBy(F.col("__id").alias(f"{PRIVATE}id"), F.col("__digest").alias(f"{PRIVATE}digest")).agg(F.collect_list(F.struct("h1", "h2")).alias(f"{PRIVATE}drop"))
    same = docs[id_column].cast("bigint").eqNullSafe(F.col(f"{PRIVATE}id")) & (digest == F.col(f"{PRIVATE}digest"))
    joined = docs.join(gathered, same, "left").drop(f"{PRIVATE}id", f"{PRIVATE}digest")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            results = []
            for t, gone in zip(texts(column(batch, text)), column(batch, f"{PRIVATE}drop").to_pylist(), strict=True):
                keys = {(g["h1"], g["h2"]) for g in gone or ()}
                drop = {i for i, d in _digests(t, min_chars) if _halves(d) in keys} if keys else set()
                results.append((_cut(t, drop), t.count(b"\n") + 1, len(drop)))
            yield out(results)

    return add_columns(joined, fields, cut).drop(f"{PRIVATE}drop")
