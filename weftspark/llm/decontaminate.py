"""Operator 6: benchmark decontamination by Wu-Manber multi-pattern search.

Documents and items are reduced to words (A-Z lower-cased, ASCII letters, digits and all other code points from U+0080)
joined by one space.  The patterns are windows of WINDOW consecutive item words, or a whole item of fewer words.  Over
the first m bytes of all patterns, m being the length of the shortest, a shift table says for each block of bytes how
far the search may jump; a block that ends such a prefix selects a bucket of patterns, which are compared directly.
Patterns are grouped by length, so that a short item does not shorten everyone's jumps.

The benchmark's windows are broadcast, WINDOWS_PER_SCAN pairs of window and item at a time, dealt by their hash: neither a
long item nor a window that very many items share makes a broadcast grow, and a larger benchmark is searched for in as many
scans as it takes.  Scans after the first give only what they find, by the text's digest; the corpus is never rewritten.  A
worker builds the tables of a scan once.

Edge cases: null and empty texts have no words, on either side; an item without words or without an id is never found;
repeated items are one; items equal in text all count; an empty benchmark or table gives no hits or no rows; a word in
several occurrences is hit once; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches, texts
from weftspark.llm.rows import PRIVATE, add_columns
from weftspark.session import stored

WINDOW = 10
#: Pairs of window and item searched for in one scan, at most but for uneven hashing; a window takes up to 40 shift entries.
WINDOWS_PER_SCAN = 50_000
BLOCK = 8
#: A byte to itself if it is of a word, A-Z to a-z, any other byte to a space.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    """Each window as bytes, with a space at either end so that it starts and ends with whole words."""
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))] if words else []


class WuManber:
    """All occurrences of many byte strings."""

    def __init__(self, patterns: list[bytes]):
        by_class: dict[int, list[bytes]] = {}
        for p in patterns:
            by_class.setdefault(min(5, max(1, len(p) // 8)), []).append(p)
        self.tables = []
        for own in by_class.values():
            m = min(map(len, own))
            block = min(BLOCK, m)
            shift: dict[bytes, int] = {}
            buckets: dict[bytes, list[bytes]] = {}
            for p in own:
                for end in range(block, m + 1):
                    key = p[end - block : end]
                    if m - end < shift.get(key, m):
                        shift[key] = m - end
                buckets.setdefault(p[m - block : m], []).append(p)
            self.tables.append((m, block, m - block + 1, shift, buckets))

    def search(self, text: bytes) -> Iterator[tuple[int, bytes]]:
        """Start and pattern of each occurrence."""
        n = len(text)
        for m, block, furthest, shift, buckets in self.tables:
            end, jump = m, shift.get
            while end <= n:
                key = text[end - block : end]
                step = jump(key, furthest)
                if step:
                    end += step
                    continue
                start = end - m
                for p in buckets[key]:
                    if text.startswith(p, start):
                        yield start, p
                end += 1


class Patterns:
    """Windows with the items that hold them; the search tables are built once in each worker that asks for them."""

    def __init__(self, pairs: list[tuple[bytes, str]]):
        self.pairs = pairs
        self.built: tuple[WuManber, dict[bytes, set[str]], dict[bytes, int]] | None = None

    def __getstate__(self) -> dict[str, object]:
        return {"pairs": self.pairs, "built": None}

    def tables(self) -> tuple[WuManber, dict[bytes, set[str]], dict[bytes, int]]:
        if self.built is None:
            holders: dict[bytes, set[str]] = {}
            for w, item in self.pairs:
                holders.setdefault(w, set()).add(item)
            self.built = WuManber(list(holders)), holders, {w: w.count(b" ") - 1 for w in holders}
        return self.built

    def find(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges of all occurrences, and the items they belong to."""
        search, holders, widths = self.tables()
        whole = b" " + b" ".join(words) + b" "
        spans, items = [], set()
        at = word = 0
        for start, w in search.search(whole):
            if start < at:  # the next group of patterns begins at the front again
                at = word = 0
            word += whole.count(b" ", at, start)
            at = start
            spans.append((word, word + widths[w]))
            items |= holders[w]
        return spans, items


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SPANS = "array<struct<first: bigint, after: bigint>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int64()), ("after", pa.int64())]))


def item_windows(benchmark: DataFrame, item_id: str, item_text: str, window: int) -> DataFrame:
    """Each window (w, as bytes) with each item that holds it."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("string").alias("body")).filter("item is not null and body is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [(w, i) for i, t in zip(column(batch, "item").to_pylist(), texts(column(batch, "body")), strict=True) for w in windows_of(words_of(t), window)]
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in pairs], pa.binary()), pa.array([i for _, i in pairs], pa.string())], names=["w", "item"])

    return items.mapInArrow(cut, "w binary, item string").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, windows_per_scan: int = WINDOWS_PER_SCAN) -> DataFrame:
    """docs with the private columns n_words, spans (array of hit word ranges: first, after last) and items (ids as strings)."""
    small_batches(docs.sparkSession)
    pairs = stored(item_windows(benchmark, item_id, item_text, window), "windows")
    scans = max(1, -(-pairs.count() // windows_per_scan))
    held = []
    for k in range(scans):
        part = pairs.filter(F.pmod(F.xxhash64("w", "item"), F.lit(scans)) == k)
        held.append(docs.sparkSession.sparkContext.broadcast(Patterns([(bytes(r["w"]), r["item"]) for r in part.toLocalIterator()])))
    digest, more_spans, more_items = f"{PRIVATE}digest", f"{PRIVATE}more_spans", f"{PRIVATE}more_items"
    source = docs
    if scans > 1:
        hits = _hits(docs, text, held[1])
        for patterns in held[2:]:
            hits = hits.unionByName(_hits(docs, text, patterns))
        found = hits.distinct().groupBy(digest).agg(F.flatten(F.collect_list("spans")).alias(more_spans), F.flatten(F.collect_list("items")).alias(more_items))
        source = docs.withColumn(digest, _digest(text)).join(stored(found, "hits"), digest, "left").drop(digest)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            counts, spans, found = [], [], []
            others = zip(column(batch, more_spans).to_pylist(), column(batch, more_items).to_pylist(), strict=True) if scans > 1 else None
            for t in texts(column(batch, text)):
                words = words_of(t)
                own, items = held[0].value.find(words)
                for more, names in [next(others)] if others else ():
                    own += [(s["first"], s["after"]) for s in more or ()]
                    items.update(names or ())
                counts.append(len(words))
                spans.append([{"first": a, "after": b} for a, b in _merge(own)])
                found.append(sorted(items))
            yield [pa.array(counts, pa.int64()), pa.array(spans, _SPAN_TYPE), pa.array(found, pa.list_(pa.string()))]

    return add_columns(source, {"n_words": "bigint", "spans": _SPANS, "items": "array<string>"}, compute).drop(more_spans, more_items)


def _digest(text: str) -> Column:
    return F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary"))


def _hits(docs: DataFrame, text: str, held) -> DataFrame:
    """What one scan finds: digest of the text, spans and items of the texts that hold any of its windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, t in zip(column(batch, "digest").to_pylist(), texts(column(batch, "body")), strict=True):
                spans, items = held.value.find(words_of(t))
                if spans:
                    rows.append((digest, [{"first": a, "after": b} for a, b in _merge(spans)], sorted(items)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], _SPAN_TYPE), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=[f"{PRIVATE}digest", "spans", "items"])

    return docs.select(_digest(text).alias("digest"), F.col(text).cast("string").alias("body")).mapInArrow(run, f"{PRIVATE}digest string, spans {_SPANS}, items array<string>")
