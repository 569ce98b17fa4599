"""Operator 2: exact substring dedup by distributed suffix sorting.

Removed is each byte covered by a LENGTH-byte string that also starts in a document with a smaller id.

Of a text that several documents hold only the smallest id takes part; its copies lose all their bytes.  Sorting every
suffix of the rest would shuffle many times the input, so the suffixes that are sorted are those at anchors: in any
LENGTH-byte string the least hash among its GRAM-byte grams is an anchor, so equal strings have equal anchors.

1. anchors: each group of documents finds its anchors and deals out their hashes, packed, one for each group and hash; where
   there are so many buckets that a group would send each of them next to nothing, they are dealt in two levels.
2. repeats: buckets of hashes tell the groups which of them other groups have too, and which very many groups have.
3. suffixes: around the anchors that several documents have, the LENGTH bytes from the anchor and what a string may hold
   before it are cut out, once for each document and surroundings however often they repeat in it.  Equal ones meet within
   the group; all but the smallest document's are resolved there.  The others are range-partitioned by their leading bytes
   between splitters taken from a sample of anchors.
4. buckets sort their suffixes by multikey quicksort over 8-byte tokens, resolve equal ones, and sort the strings that
   start before the anchor likewise where different surroundings share an anchor.  Splitters never part suffixes that
   agree in their leading bytes, and those bytes are fewer than a gram, so the last suffix of a bucket and the first of
   the next have no string in common: the comparison across boundaries is decided by the splitters themselves.
   An anchor that more than HOT_GROUPS groups have would make such a bucket grow without bound: its strings are cut out one
   by one, equal ones meet within the group first, and the rest is dealt by the hash of the string.
5. spans go back to their documents, are merged and cut.

All tables between the steps hold packed arrays per pair of task and bucket.  Copies and repeated passages are resolved
within the groups first, so a bucket gets one of each from every group at most.

Edge cases: a null text is empty; texts shorter than LENGTH lose nothing; rows without id lose nothing and no row loses
anything to them; rows that repeat an id are not smaller than one another, and each gets its own result; long runs of one
byte or of a short period are one suffix each; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches, utf8

LENGTH = 50
GRAM = 26
REACH = LENGTH - GRAM  # bytes of a string that may come before its anchor
LEAD = 16  # leading bytes that splitters compare; fewer than GRAM
#: Bytes of text in a group of documents; anchors in a bucket; bytes of text whose suffixes share a range bucket.
GROUP_BYTES, GROUP_BYTES_MOST = 4 << 20, 64 << 20
BUCKET_ANCHORS = 1_000_000
RANGE_BYTES = 12 << 20
#: Buckets that a group deals its hashes to; beyond, there are two levels, the first one of so many.
DIRECT_BUCKETS, COARSE_BUCKETS = 16_384, 2_048
#: Groups that share an anchor, beyond which its strings are dealt one by one.
HOT_GROUPS = 4_000
#: Documents whose anchors give the splitters, and about how many anchors they give.
SAMPLED_DOCUMENTS, SAMPLED_ANCHORS = 2_000, 50_000
#: Rows over which the copies of one text are spread when their first one is looked up.
SALTS = 8
#: Rows that a multikey quicksort hands to a plain sort.
SMALL = 256
_TABLE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_RECORD = np.dtype([("doc", "<i8"), ("part", "<u4"), ("pos", "<u4"), ("left", "u1"), ("right", "u1"), ("multi", "u1"), ("bytes", "u1", REACH + LENGTH)])
_STRING = np.dtype([("doc", "<i8"), ("part", "<u4"), ("pos", "<u4"), ("multi", "u1"), ("bytes", "u1", LENGTH)])
_SPAN = np.dtype([("doc", "<i8"), ("part", "<u4"), ("start", "<u4"), ("end", "<u4"), ("multi", "u1")])
_HASH = np.dtype([("h", "<u8"), ("g", "<i8")])
_REPEAT = np.dtype([("h", "<u8"), ("hot", "u1")])
_BUCKET_SCHEMA = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])


def _pack(array: np.ndarray) -> bytes:
    """Compressed bytes of a record array, field by field and byte plane by byte plane."""
    planes = [np.ascontiguousarray(array[f]).view(np.uint8).reshape(len(array), -1) for f in array.dtype.names]
    return zstd.ZstdCompressor(level=1).compress(b"".join(p.tobytes() if f == "bytes" else p.T.tobytes() for f, p in zip(array.dtype.names, planes, strict=True)))


def _unpack(blob: bytes, dtype: np.dtype) -> np.ndarray:
    raw = np.frombuffer(zstd.ZstdDecompressor().decompress(blob), np.uint8)
    n = len(raw) // dtype.itemsize
    out = np.zeros(n, dtype)
    at = 0
    for f in dtype.names:
        width = dtype[f].itemsize
        part = raw[at : at + n * width]
        at += n * width
        if f == "bytes":
            out[f] = part.reshape(n, width)
        else:
            out[f] = np.ascontiguousarray(part.reshape(width, n).T).view(dtype[f]).ravel()
    return out


def anchors(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the anchors of a text and their hashes."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h1 = _TABLE[raw]
    h2 = h1[:-1] * _ODD[0] + h1[1:]
    h4 = h2[:-2] * _ODD[1] + h2[2:]
    h8 = h4[:-4] * _ODD[2] + h4[4:]
    h = h8[:-8] * _ODD[3] + h8[8:]  # 16 bytes
    h = h[: n - 23] * _ODD[4] + h8[16 : n - 7]  # 24 bytes
    h = h[: n - 25] * _ODD[5] + h2[24 : n - 1]  # 26 bytes
    h ^= h >> np.uint64(29)
    h *= _ODD[6]
    h ^= h >> np.uint64(32)
    low = _slide(h, np.minimum)
    edge = np.zeros(REACH, np.uint64)
    at = np.flatnonzero(h == _slide(np.concatenate([edge, low, edge]), np.maximum))
    return at, h[at]


def _slide(x: np.ndarray, best: np.ufunc) -> np.ndarray:
    """best over each REACH + 1 = 25 consecutive values."""
    for step in (1, 2, 4, 8):
        x = best(x[:-step], x[step:])
    return best(x[:-9], x[9:])


def multikey_sort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of tokens (n x q, compared from the left) and, along it, the number of each row's class of equals.

    Multikey quicksort: a run of rows that agree in the tokens before `depth` is split by a pivot among the tokens there into
    smaller, equal and larger ones; the equal ones go on with the next token.  All runs are split at once, round by round;
    runs of SMALL rows are left to plain sorts, token by token, at the end.
    """
    n, q = tokens.shape
    order, new = np.arange(n), np.zeros(n, bool)
    new[:1] = True
    start, size, depth = np.array([0]), np.array([n]), np.array([0])
    small: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while True:
        open_ = (size > 1) & (depth < q)
        few = open_ & (size <= SMALL)
        small.append((start[few], size[few], depth[few]))
        start, size, depth = (x[open_ & ~few] for x in (start, size, depth))
        if not len(start):
            break
        run, at = _spread(start, size)
        rows = order[at]
        token = tokens[rows, depth[run]]
        first = np.cumsum(size) - size
        three = np.sort(np.stack([token[first], token[first + size // 2], token[first + size - 1]]), axis=0)
        pivot = three[1][run]
        sides = [token < pivot, token == pivot, token > pivot]
        counts = np.stack([np.add.reduceat(side, first, dtype=np.int64) for side in sides], axis=1)
        starts = start[:, None] + np.cumsum(counts, axis=1) - counts
        for side, to, before in zip(sides, starts.T, (np.cumsum(counts, axis=0) - counts).T, strict=True):
            own = run[side]
            order[to[own] + np.arange(len(own)) - before[own]] = rows[side]
        depth = (depth[:, None] + np.array([0, 1, 0])).ravel()
        start, size = starts.ravel(), counts.ravel()
        new[start[size > 0]] = True
    start, size, depth = (np.concatenate(x) for x in zip(*small, strict=True))
    while len(start):
        run, at = _spread(start, size)
        rows = order[at]
        token = tokens[rows, depth[run]]
        rank = np.lexsort((token, run))
        order[at], token = rows[rank], token[rank]
        differ = np.r_[True, (token[1:] != token[:-1]) | (run[1:] != run[:-1])]
        new[at[differ]] = True
        edges = np.flatnonzero(differ)
        size = np.diff(np.r_[edges, len(at)])
        start, depth = at[edges], depth[run[edges]] + 1
        open_ = (size > 1) & (depth < q)
        start, size, depth = start[open_], size[open_], depth[open_]
    return order, np.cumsum(new) - 1


def _spread(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of so many places from these starts: each place and the number of its run."""
    run = np.repeat(np.arange(len(start)), size)
    return run, np.arange(len(run)) - np.repeat(np.cumsum(size) - size, size) + start[run]


def _tokens(strings: np.ndarray) -> np.ndarray:
    """Rows of bytes as rows of big-endian 8-byte tokens."""
    wide = np.zeros((len(strings), -(-strings.shape[1] // 8) * 8), np.uint8)
    wide[:, : strings.shape[1]] = strings
    return wide.view(">u8").astype(np.uint64)


def _least(values: np.ndarray, order: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """For each row the least value in its class."""
    if not len(order):
        return values
    ranked = values[order]
    lows = np.minimum.reduceat(ranked, np.flatnonzero(np.r_[True, classes[1:] != classes[:-1]]))
    out = np.empty_like(values)
    out[order] = lows[classes]
    return out


def _once(records: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One of the records with the same surroundings in the same document, marked if there are more, and beside each the
    smallest document with these surroundings."""
    names = [f for f in ("bytes", "left", "right") if f in records.dtype.names]
    key = np.concatenate([records[f].reshape(len(records), -1) for f in names], axis=1)
    order, classes = multikey_sort(_tokens(key))
    ranked = records[order]
    order = np.lexsort((ranked["pos"], ranked["part"], ranked["doc"], classes))
    ranked, classes = ranked[order], classes[order]
    new = np.r_[True, (classes[1:] != classes[:-1]) | (ranked["doc"][1:] != ranked["doc"][:-1]) | (ranked["part"][1:] != ranked["part"][:-1])]
    starts = np.flatnonzero(new)
    out = ranked[starts].copy()
    out["multi"] |= np.diff(np.r_[starts, len(ranked)]) > 1
    classes = classes[starts]
    return out, _least(out["doc"], np.arange(len(out)), classes)


def _spans(records: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.zeros(len(records), _SPAN)
    for f in ("doc", "part", "multi"):
        out[f] = records[f]
    out["start"], out["end"] = start, end
    return out


def _whole(records: np.ndarray) -> np.ndarray:
    """Spans of all strings around the anchors."""
    left, right, pos = (records[f].astype(np.int64) for f in ("left", "right", "pos"))
    return _spans(records, pos - left, pos + right)[left + right >= LENGTH]


def _joined(spans: np.ndarray) -> np.ndarray:
    """Spans with overlaps within a document merged; those that stand for more of their kind stay apart."""
    if not len(spans):
        return spans
    several = np.unique(spans[spans["multi"] > 0])
    spans = spans[spans["multi"] == 0]
    if not len(spans):
        return several
    spans = spans[np.lexsort((spans["start"], spans["part"], spans["doc"]))]
    owner = np.r_[True, (spans["doc"][1:] != spans["doc"][:-1]) | (spans["part"][1:] != spans["part"][:-1])]
    number = np.cumsum(owner) - 1
    reach = np.maximum.accumulate(spans["end"].astype(np.int64) + number * (1 << 33)) - number * (1 << 33)
    first = owner | np.r_[True, spans["start"][1:] > reach[:-1]]
    at = np.flatnonzero(first)
    out = spans[at].copy()
    out["end"] = reach[np.r_[at[1:] - 1, len(spans) - 1]]
    return np.concatenate([out, several])


def _expanded(raw: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """The merged byte ranges of one text; a span that stands for more of its kind is searched for in the whole text."""
    found = [(a, b) for a, b, several in spans if not several]
    for pattern in {raw[a:b] for a, b, several in spans if several}:
        at, size = raw.find(pattern), len(pattern)
        while at >= 0:
            end = at + size
            after = raw.find(pattern, at + 1)
            while 0 <= after <= end:  # one range as long as they touch
                end = after + size
                after = raw.find(pattern, after + 1)
            found.append((at, end))
            at = after
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _within(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    """Whether each value is among the ranked ones."""
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def resolve(records: np.ndarray) -> np.ndarray:
    """All spans that a bucket's suffixes give."""
    if not len(records):
        return np.zeros(0, _SPAN)
    records, least = _once(records)
    later = records["doc"] > least
    found = [_whole(records[later])]
    rest = records[~later]
    gram_order, grams = multikey_sort(_tokens(rest["bytes"][:, REACH : REACH + GRAM]))
    # different surroundings of one anchor: compare the strings that start 0, 1, ... bytes before it
    docs_low = _least(rest["doc"], gram_order, grams)
    docs_high = -_least(-rest["doc"], gram_order, grams)
    rest = rest[docs_low != docs_high]
    for before in range(REACH + 1):
        found.append(resolve_strings(_strings(rest, before)))
    return _joined(np.concatenate(found))


def _strings(records: np.ndarray, before: int) -> np.ndarray:
    """The strings that start so many bytes before the anchor, as far as the text has them."""
    fits = np.flatnonzero((records["left"] >= before) & (records["right"] >= LENGTH - before))
    out = np.zeros(len(fits), _STRING)
    for f in ("doc", "part", "multi"):
        out[f] = records[f][fits]
    out["pos"] = records["pos"][fits] - before
    out["bytes"] = records["bytes"][fits][:, REACH - before : REACH - before + LENGTH]
    return out


def resolve_strings(strings: np.ndarray) -> np.ndarray:
    """Spans of the strings that a smaller document has too."""
    if len(strings) < 2:
        return np.zeros(0, _SPAN)
    order, classes = multikey_sort(_tokens(strings["bytes"]))
    hit = strings[strings["doc"] > _least(strings["doc"], order, classes)]
    return _spans(hit, hit["pos"], hit["pos"] + LENGTH)


def _texts(table: pa.Table) -> Iterator[tuple[int, str, np.ndarray]]:
    """Id, digest and bytes of each row."""
    for batch in table.to_batches():
        raw, offs = utf8(column(batch, "text"))
        for doc, digest, a, b in zip(column(batch, "doc").to_pylist(), column(batch, "digest").to_pylist(), offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            yield doc, digest, raw[a:b]


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[k] for r in rows], t.type) for k, t in enumerate(_BUCKET_SCHEMA)], schema=_BUCKET_SCHEMA)


def _runs(new: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Start and end of each run of n elements; new tells where one begins."""
    starts = np.flatnonzero(new[:n]).tolist()
    return list(zip(starts, [*starts[1:], n], strict=True)) if n else []


def _deal(array: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """Packed rows (bucket, kind, blob) of an array whose elements go to these buckets."""
    order = np.argsort(bucket, kind="stable")
    array, bucket = array[order], bucket[order]
    return [(int(bucket[a]), kind, _pack(array[a:b])) for a, b in _runs(np.r_[True, bucket[1:] != bucket[:-1]], len(array))]


def remove_repeats(docs: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, spans (array of removed byte ranges: start, end) and kept (binary) of every row."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col(id_column).cast("bigint").alias("doc"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    total, n_docs = plain.agg(F.sum(F.octet_length("text")), F.count("doc")).first()
    total = total or 0
    group_bytes = min(GROUP_BYTES_MOST, max(GROUP_BYTES, total // 2000))
    groups = max(1, -(-total // group_bytes))
    buckets = max(1, total // (13 * BUCKET_ANCHORS))
    ranges = max(1, total // RANGE_BYTES)
    group = F.pmod(F.xxhash64("doc"), F.lit(groups))
    rows = plain.filter("doc is not null").select("doc", "text", F.md5(F.col("text").cast("binary")).alias("digest"), group.alias("g"))
    copies = _copies(rows).select("own", "own_digest", F.lit(None).cast("binary").alias("blob"), F.pmod(F.xxhash64("own"), F.lit(groups)).alias("own_g"))
    splitters = _splitters(plain.filter("doc is not null").select("doc", "text"), n_docs, total, ranges)

    def group_of(ids_: np.ndarray) -> np.ndarray:
        own, which = np.unique(ids_, return_inverse=True)
        return np.fromiter((_spark_hash(d) % groups for d in own.tolist()), np.int64, len(own))[which]

    def find_anchors(texts: pa.Table, known: pa.Table) -> pa.Table:
        hashes = [h for *_, h in _anchored(texts, known)]
        if not hashes:
            return _blobs([])
        h = np.unique(np.concatenate(hashes))
        out = np.zeros(len(h), _HASH)
        out["h"], out["g"] = h, texts["g"][0].as_py()
        if buckets <= DIRECT_BUCKETS:
            return _blobs(_deal(out, (h % np.uint64(buckets)).astype(np.int64), 0))
        # a first bucket is a coarse one for some of the groups
        part = int(out["g"][0]) % -(-buckets // COARSE_BUCKETS)
        return _blobs(_deal(out, (h % np.uint64(COARSE_BUCKETS)).astype(np.int64) + COARSE_BUCKETS * part, 0))

    def deal_again(table: pa.Table) -> pa.Table:
        out = np.concatenate([_unpack(b, _HASH) for b in table["blob"].to_pylist()])
        fine = np.uint64(-(-buckets // COARSE_BUCKETS))
        coarse, own = out["h"] % np.uint64(COARSE_BUCKETS), out["h"] // np.uint64(COARSE_BUCKETS) % fine
        return _blobs(_deal(out, (coarse * fine + own).astype(np.int64), 0))

    def find_repeats(table: pa.Table) -> pa.Table:
        all_ = np.concatenate([_unpack(b, _HASH) for b in table["blob"].to_pylist()])
        all_ = all_[np.argsort(all_["h"], kind="stable")]
        starts = np.flatnonzero(np.r_[True, all_["h"][1:] != all_["h"][:-1]])
        count = np.diff(np.r_[starts, len(all_)])
        count = np.repeat(count, count)
        out = np.zeros(int((count > 1).sum()), _REPEAT)
        out["h"], out["hot"] = all_["h"][count > 1], count[count > 1] > HOT_GROUPS
        return _blobs(_deal(out, all_["g"][count > 1], 0))

    def cut_suffixes(texts: pa.Table, known: pa.Table) -> pa.Table:
        blobs = [b for b in known["blob"].to_pylist() if b is not None]
        elsewhere = np.concatenate([_unpack(b, _REPEAT) for b in blobs]) if blobs else np.zeros(0, _REPEAT)
        elsewhere = elsewhere[np.argsort(elsewhere["h"])]
        found = list(_anchored(texts, known))
        if not found:
            return _blobs([])
        here, holders = np.unique(np.concatenate([np.unique(h) for *_, h in found]), return_counts=True)
        wanted = np.union1d(here[holders > 1], elsewhere["h"])
        hot = elsewhere["h"][elsewhere["hot"] > 0]
        cut = [(_cut_out(doc, part, raw, at[keep := _within(h, wanted)]), _within(h[keep], hot)) for doc, part, raw, at, h in found]
        records, is_hot = (np.concatenate(x) for x in zip(*cut, strict=True))
        if not len(records):
            return _blobs([])
        own = int(texts["g"][0].as_py())
        strings = [_strings(_once(records[is_hot])[0], before) for before in range(REACH + 1)] if is_hot.any() else []
        out, spans = [], []
        if strings and len(single := np.concatenate(strings)):
            single, least = _once(single)
            spans.append(_spans(single, single["pos"], single["pos"] + LENGTH)[single["doc"] > least])
            single = single[single["doc"] == least]
            to = np.fromiter((xxhash.xxh64_intdigest(b.tobytes()) % ranges for b in single["bytes"]), np.int64, len(single))
            out += _deal(single, to, 2)
        if not is_hot.all():
            records, least = _once(records[~is_hot])
            spans.append(_whole(records[records["doc"] > least]))
            rest = records[records["doc"] == least]
            leads = np.ascontiguousarray(rest["bytes"][:, REACH : REACH + LEAD]).view(f"S{LEAD}").ravel()
            out += _deal(rest, np.searchsorted(splitters, leads, side="right").astype(np.int64), 0)
        done = _joined(np.concatenate(spans))
        return _blobs(out + ([(ranges + own, 1, _pack(done))] if len(done) else []))

    def sort_suffixes(table: pa.Table) -> pa.Table:
        by_kind: list[list[bytes]] = [[], [], []]
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"].to_pylist(), strict=True):
            by_kind[kind].append(blob)
        suffixes, done, strings = by_kind
        out = [(int(table["bucket"][0].as_py()) - ranges, 1, b) for b in done]  # what a group found out by itself
        if suffixes:
            spans = resolve(np.concatenate([_unpack(b, _RECORD) for b in suffixes]))
            out += _deal(spans, group_of(spans["doc"]), 1)
        if strings:
            spans = _joined(resolve_strings(np.concatenate([_unpack(b, _STRING) for b in strings])))
            out += _deal(spans, group_of(spans["doc"]), 1)
        return _blobs(out)

    result = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])

    def cut(texts: pa.Table, known: pa.Table) -> pa.Table:
        blobs = [b for b in known["blob"].to_pylist() if b is not None]
        spans: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
        for b in blobs:
            for doc, part, start, end, several in _unpack(b, _SPAN).tolist():
                spans.setdefault((doc, part), []).append((start, end, several))
        gone = _copies_of(known)
        out: list[list] = [[], [], [], []]
        for doc, digest, raw in _texts(texts):
            n, whole = len(raw), raw.tobytes()
            own = [(0, n)] if (doc, digest) in gone else _expanded(whole, spans.get((doc, _part(digest)), []))
            kept, at = [], 0
            for a, b in own:
                kept.append(whole[at:a])
                at = b
            kept.append(whole[at:])
            for values, value in zip(out, (doc, n, [{"start": a, "end": b} for a, b in own], b"".join(kept)), strict=True):
                values.append(value)
        return pa.Table.from_arrays([pa.array(v, t.type) for v, t in zip(out, result, strict=True)], schema=result)

    schema = "bucket long, kind int, blob binary"
    by_group = rows.groupBy("g")

    def with_copies(blobs: DataFrame) -> DataFrame:
        own = blobs.select(F.lit(None).cast("long").alias("own"), F.lit(None).cast("string").alias("own_digest"), "blob", F.col("bucket").alias("own_g"))
        return own.unionByName(copies)

    found = by_group.cogroup(copies.groupBy("own_g")).applyInArrow(find_anchors, schema)
    if buckets > DIRECT_BUCKETS:
        found = found.groupBy("bucket").applyInArrow(deal_again, schema)
    repeated = found.groupBy("bucket").applyInArrow(find_repeats, schema)
    dealt = by_group.cogroup(with_copies(repeated).groupBy("own_g")).applyInArrow(cut_suffixes, schema)
    spans = dealt.groupBy("bucket").applyInArrow(sort_suffixes, schema)
    done = by_group.cogroup(with_copies(spans).groupBy("own_g")).applyInArrow(cut, "doc long, n_bytes long, spans array<struct<start: bigint, end: bigint>>, kept binary")
    content = F.col("text").cast("binary")
    none = plain.filter("doc is null").select("doc", F.length(content).cast("bigint").alias("n_bytes"), F.array().cast("array<struct<start: bigint, end: bigint>>").alias("spans"), content.alias("kept"))
    return done.unionByName(none).withColumnRenamed("doc", "doc_id")


def _copies(rows: DataFrame) -> DataFrame:
    """own, own_digest: documents of at least LENGTH bytes whose text a smaller id has too.

    A text of which there are very many copies is spread over SALTS tasks.
    """
    ids = rows.filter(F.octet_length("text") >= LENGTH).select("doc", "digest").distinct()
    firsts = ids.groupBy("digest").agg(F.min("doc").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    salted = firsts.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    ids = ids.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int"))
    return ids.join(salted, ["digest", "salt"]).filter("first < doc").select(F.col("doc").alias("own"), F.col("digest").alias("own_digest"))


def _copies_of(known: pa.Table) -> set[tuple[int, str]]:
    return {(d, x) for d, x in zip(known["own"].to_pylist(), known["own_digest"].to_pylist(), strict=True) if d is not None}


def _splitters(texts: DataFrame, n_docs: int, total: int, ranges: int) -> np.ndarray:
    """Leading bytes that part the suffixes into so many ranges, from the anchors of some SAMPLED_DOCUMENTS documents, of
    which about SAMPLED_ANCHORS are taken however long the documents are."""
    share = max(1, n_docs // SAMPLED_DOCUMENTS)
    thin = np.uint64(max(1, total // share // (13 * SAMPLED_ANCHORS)))

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offs = utf8(column(batch, "text"))
            found = []
            for a, b in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                at, h = anchors(raw[a:b])
                found += [raw[a + p : a + p + LEAD].tobytes() for p in at[h % thin == 0].tolist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["lead"])

    if ranges == 1:
        return np.zeros(0, f"S{LEAD}")
    sampled = texts.filter(F.pmod(F.xxhash64(F.lit(1), "doc"), F.lit(share)) == 0).select("text").mapInArrow(lead, "lead binary").toPandas()["lead"]
    leads = np.sort(np.array([bytes(x) for x in sampled], f"S{LEAD}"))
    return np.unique(leads[np.linspace(0, len(leads) - 1, ranges + 1).astype(int)[1:-1]]) if len(leads) else leads


def _anchored(texts: pa.Table, known: pa.Table) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Id, part, bytes, anchors and their hashes (48 bits) of each document that is no copy of a smaller one."""
    gone, done = _copies_of(known), set()
    for doc, digest, raw in _texts(texts):
        if len(raw) < LENGTH or (doc, digest) in gone or (doc, digest) in done:
            continue
        done.add((doc, digest))
        at, h = anchors(raw)
        yield doc, _part(digest), raw, at, h >> np.uint64(16)


def _cut_out(doc: int, part: int, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Records of a document's anchors with the bytes around them."""
    out = np.zeros(len(at), _RECORD)
    out["doc"], out["part"], out["pos"] = doc, part, at
    out["left"], out["right"] = np.minimum(at, REACH), np.minimum(len(raw) - at, LENGTH)
    index = at[:, None] + np.arange(-REACH, LENGTH)
    inside = (index >= 0) & (index < len(raw))
    out["bytes"] = np.where(inside, raw[np.clip(index, 0, len(raw) - 1)], 0)
    return out


def _part(digest: str) -> int:
    """32 bits of a text's digest: tells apart the texts of rows that share an id."""
    return int(digest[:8], 16)


def _spark_hash(value: int) -> int:
    """Spark's xxhash64 of a bigint, as the signed number that pmod takes; Python's % is never negative either."""
    return _signed(xxhash.xxh64_intdigest(value.to_bytes(8, "little", signed=True), 42))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value
