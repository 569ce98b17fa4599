"""Operator 9: SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight positional bytes.  Two fingerprints that differ in at most three bits share at least five of
the eight, and any five positions hold three of one half (0-3 or 4-7).  So the index has, for each fingerprint, eight
postings: the eight ways to take three positions of one half, with the bytes there.  Within a posting list the shared
positional bytes of each pair are tallied; pairs with at least five are verified by their differing bits.

Exact copies meet before the search: it runs over distinct fingerprints.  A posting list that more than HOT_LIST
fingerprints share is split: such pairs also share two of the five other positions, so its members get ten finer
postings of five bytes.  Those lists hold 2**24 fingerprints at most; long ones are searched by looking up all values
within three bits of the three free bytes, which takes time in proportion to the list.  From each list only a spanning
star of each connected group goes on, never all pairs; what it connects is unchanged.  Components are found by
alternating large and small stars over shuffled edges; no links reach the driver.

Edge cases: a null or empty text has no shingles and fingerprint 0, linked like any other; one or two words are one
shingle; null ids get a fingerprint and component, and a component's id is its smallest id that is not null (null if
it has none); rows that repeat are ordinary members; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftspark.llm.arrow_text import column, small_batches, texts
from weftspark.llm.rows import PRIVATE
from weftspark.session import cut_lineage, stored

SHINGLE_WORDS = 3
SEED = 42
MOST_BITS = 3
#: Distinct fingerprints in a posting list beyond which it is split into finer ones.
HOT_LIST = 2000
#: Members of a finer list up to which all its pairs are tallied; beyond, neighbours are looked up.
PAIRWISE = 4000
TRIPLES = [tuple(half + i for i in t) for half in (0, 4) for t in combinations(range(4), 3)]


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint of one text."""
    words = text.lower().split()  # bytes: A-Z only, and white space is 20 and 09-0D
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    last = min(SHINGLE_WORDS, len(words)) - 1
    starts = (ends - lengths)[: len(words) - last].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[last:].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 65536):
        part = h[i : i + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """The columns `keep` and fingerprint (its 64 bits as a signed bigint) of every row."""
    small_batches(docs.sparkSession)
    kinds = T.StructType([*[docs.schema[c] for c in keep], T.StructField("fingerprint", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t) for t in texts(column(batch, "__text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[column(batch, f"__{c}") for c in keep], pa.array(values.view(np.int64))], names=kinds.names)

    return docs.select(*[F.col(c).alias(f"__{c}") for c in keep], F.col(text).cast("string").alias("__text")).mapInArrow(run, kinds)


def _byte(value: Column, position: int) -> Column:
    return F.shiftrightunsigned(value, 8 * position).bitwiseAND(F.lit(255))


def _key(value: Column, positions: tuple[int, ...]) -> Column:
    out = F.lit(0).cast("bigint")
    for p in positions:
        out = F.shiftleft(out, 8).bitwiseOR(_byte(value, p))
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node it is connected with by the edges a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _verified(x: np.ndarray) -> np.ndarray:
    """Count filter, then verification: at least five equal positional bytes, at most three differing bits."""
    enough = (np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8) == 0).sum(axis=1) >= 8 - MOST_BITS
    enough[enough] = np.bitwise_count(x[enough]) <= MOST_BITS
    return enough


def _near(values: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within three bits among distinct values that differ in the bits `free` only, by looking neighbours up."""
    order = np.argsort(values)
    ranked = values[order]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    masks = [np.bitwise_or.reduce(free[list(c)]) for k in range(1, MOST_BITS + 1) for c in combinations(range(len(free)), k)]
    for mask in masks:
        other = ranked ^ mask
        at = np.minimum(np.searchsorted(ranked, other), len(ranked) - 1)
        hit = np.flatnonzero((ranked[at] == other) & (ranked < other))
        found.append((order[hit], order[at[hit]]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _stars(key: np.ndarray, value: np.ndarray, fine: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, least member connected to it) of each posting list; key is sorted and its lists are whole."""
    n = len(key)
    value = value.view(np.uint64)
    left, right = [], []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    active = np.ones(n, bool)
    if fine is not None:
        for s, m in zip(starts[sizes > PAIRWISE].tolist(), sizes[sizes > PAIRWISE].tolist(), strict=True):
            active[s : s + m] = False
            bits = np.array([1 << (8 * int(p) + b) for p in np.unpackbits(np.uint8(fine[s])).nonzero()[0] for b in range(8)], np.uint64)
            a, b = _near(value[s : s + m], bits)
            left.append(a + s)
            right.append(b + s)
    at = np.flatnonzero(active)
    step = 1
    while len(at):
        at = at[at + step < n]
        at = at[key[at] == key[at + step]]
        good = at[_verified(value[at] ^ value[at + step])]
        left.append(good)
        right.append(good + step)
        step += 1
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right))
    root = _roots(n, a, b)
    moved = np.flatnonzero(root != np.arange(n))
    return value[moved].view(np.int64), value[root[moved]].view(np.int64)


def _search(postings: DataFrame) -> DataFrame:
    """Edges a, b from postings (key, free, fingerprint): free has the positions that a finer list leaves open, or null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("key", "free", "fingerprint")]
            rest = new if rest is None else [np.concatenate(x) for x in zip(rest, new, strict=True)]
            cut = int(np.searchsorted(rest[0], rest[0][-1]))  # the last list may go on
            if cut >= 100_000:
                yield edges(*(x[:cut] for x in rest))
                rest = [x[cut:] for x in rest]
        if rest is not None:
            yield edges(*rest)

    def edges(key: np.ndarray, free: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        a, b = _stars(key, value, free if free.any() else None)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a bigint, b bigint")


def links(distinct: DataFrame, hot_list: int = HOT_LIST) -> DataFrame:
    """Edges a, b (fingerprints) that connect what is within three bits, from one row per fingerprint."""
    value = F.col("fingerprint")
    keys = [F.shiftleft(F.lit(i).cast("bigint"), 24).bitwiseOR(_key(value, t)) for i, t in enumerate(TRIPLES)]
    postings = distinct.select("fingerprint", F.explode(F.array(*keys)).alias("key"))
    lists = postings.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1")
    marked = stored(postings.join(lists, "key").select("key", "fingerprint", (F.col("members") > hot_list).alias("hot")), "postings")
    short = _search(marked.filter("not hot").select("key", F.lit(0).alias("free"), "fingerprint"))
    if not marked.filter("hot").limit(1).count():
        return short.distinct()
    finer = []
    for i, t in enumerate(TRIPLES):
        others = [p for p in range(8) if p not in t]
        for j, pair in enumerate(combinations(others, 2)):
            open_ = sum(128 >> p for p in others if p not in pair)
            key = F.shiftleft(F.lit(i * 10 + j).cast("bigint"), 40).bitwiseOR(F.shiftleft(_key(value, t), 16)).bitwiseOR(_key(value, pair))
            finer.append((i, F.struct(key.alias("key"), F.lit(open_).alias("free"))))
    triple = F.shiftright("key", 24)
    choice = F.array(*[s for i, s in finer if i == 0])
    for i in range(1, len(TRIPLES)):
        choice = F.when(triple == i, F.array(*[s for k, s in finer if k == i])).otherwise(choice)
    split = marked.filter("hot").select("fingerprint", F.explode(choice).alias("p")).select("p.key", "p.free", "fingerprint")
    return short.union(_search(split)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node that each node of the edges a-b is connected with, by alternating stars."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(small)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _classes(prints: DataFrame, least: Column, hot_list: int) -> DataFrame:
    """fingerprint and least: for each fingerprint the least value of `least` among all rows of its component."""
    distinct = stored(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "distinct")
    joined = components(links(distinct, hot_list)).withColumnRenamed("node", "fingerprint")
    rooted = distinct.join(joined, "fingerprint", "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("least"))
    return rooted.select("fingerprint", "root").join(named, "root").select("fingerprint", "least")


def near_duplicates(docs: DataFrame, text: str = "text", id_column: str = "doc_id", hot_list: int = HOT_LIST) -> DataFrame:
    """id_column, fingerprint (bigint) and component_id of every row."""
    prints = stored(fingerprints(docs, text, id_column), "fingerprints")
    classes = _classes(prints, F.col(id_column), hot_list).withColumnRenamed("least", "component_id")
    return prints.join(classes, "fingerprint", "left").select(id_column, "fingerprint", "component_id")


def first_of_each(docs: DataFrame, text: str = "text", id_column: str = "doc_id", hot_list: int = HOT_LIST) -> DataFrame:
    """One row of each component: that of the smallest id (null ids last), and of several such rows the one stored first.

    Rows, not ids, are kept or dropped, so an id that repeats with unrelated texts loses none of them.
    """
    row = f"{PRIVATE}row"
    marked = stored(docs.withColumn(row, F.monotonically_increasing_id()), "marked")
    prints = stored(fingerprints(marked, text, id_column, row), "fingerprints")
    order = F.struct(F.col(id_column).isNull().alias("missing"), F.col(id_column).alias("id"), F.col(row).alias("row"))
    gone = prints.join(_classes(prints, order, hot_list), "fingerprint").filter(F.col(row) != F.col("least.row")).select(row)
    return marked.join(stored(gone, "dropped"), row, "left_anti").select(*docs.columns)
