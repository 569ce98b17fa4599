"""Plain versions of what the operators compute, over lists of (doc_id, text)."""

import hashlib
import re
import zlib

import xxhash


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def substrings(rows, length=50):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            first.setdefault(raw[i : i + length], doc)
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        if doc is not None:
            for i in range(len(raw) - length + 1):
                if first[raw[i : i + length]] < doc:
                    gone[i : i + length] = b"\1" * length
        runs = len(re.findall(b"\1+", bytes(gone)))
        out.append((doc, len(raw), sum(gone), runs, sha(bytes(b for b, g in zip(raw, gone, strict=True) if not g))))
    return out


def line_dedup(rows, chars=40, least=5):
    keys, holders = [], {}
    for doc, text in rows:
        own = [low(line.strip(" \t\n\x0b\x0c\r")) for line in (text or "").split("\n")]
        keys.append(own)
        for key in {k for k in own if len(k) >= chars}:
            holders.setdefault(key, []).append(doc)
    keeper = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= least}
    keeper = {k: d for k, d in keeper.items() if d is not None}
    out = []
    for (doc, text), own in zip(rows, keys, strict=True):
        lines = (text or "").split("\n")
        kept = [line for line, key in zip(lines, own, strict=True) if key not in keeper or keeper[key] == doc]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low(text or ""))


def decontaminate(rows, items, size=10):
    windows = {}
    for item, text in items:
        own = words(text)
        if item is None or not own:
            continue
        for i in range(max(1, len(own) - size + 1)):
            windows.setdefault(tuple(own[i : i + size]), set()).add(str(item))
    out = []
    for doc, text in rows:
        own, hit, found = words(text), set(), set()
        for w, ids in windows.items():
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit.update(range(i, i + len(w)))
                    found |= ids
        out.append((doc, len(own), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


def fingerprint(text):
    own = re.findall(r"[^\x20\x09-\x0D]+", low(text or ""))
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(own[i : i + 3]).encode(), 42) for i in range(max(1, len(own) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash(rows, bits=3):
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    return [(doc, format(prints[i], "016x"), least[group[i]]) for i, (doc, _) in enumerate(rows)]


def held_out(doc, modulus, remainder):
    return doc is not None and zlib.crc32(str(doc).encode()) % modulus == remainder


def first_of_each(rows):
    """One row of each near-duplicate group: the smallest id, null ids last."""
    prints = [fingerprint(t) for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            i = todo.pop()
            if i in left:
                left.discard(i)
                group.add(i)
                todo += [j for j in left if (prints[i] ^ prints[j]).bit_count() <= 3]
        out.append(min(group, key=lambda i: (rows[i][0] is None, rows[i][0] or 0)))
    return [rows[i] for i in sorted(out)]


def gains(model, text):
    """Bytes that the toxic dictionary saves in each window, every window with compressors of its own."""
    import zstandard as zstd

    from weftspark.llm import toxicity as T

    def size(window, content):
        held = zstd.ZstdCompressionDict(content or b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
        how = zstd.ZstdCompressionParameters.from_level(6, dict_size=T.TOXIC_BYTES + T.ORDINARY_BYTES, source_size=2 * T.WINDOW_BYTES, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
        held.precompute_compress(compression_params=how)
        return len(zstd.ZstdCompressor(dict_data=held, compression_params=how).compress(window))

    words = re.sub(rb"[\x00-\x60\x7b-\x7f]+", b" ", (text or "").lower().encode()).split()
    windows, own = [], b""
    for word in words:
        own = own + b" " + word if own else word
        if len(own) >= T.WINDOW_BYTES:
            windows.append(own)
            own = b""
    windows += [own] if own else []
    return [size(b" " + w + b" ", model.ordinary) - size(b" " + w + b" ", model.toxic + model.ordinary) for w in windows]


def toxicity(model, text):
    import math

    own = gains(model, text)
    over = [(g - model.mean) / model.spread for g in own]
    high = sum(max(o - 2, 0) for o in over)
    root = math.sqrt(len(over)) or 1
    features = [sum(over) / root, math.log1p(high), math.log1p(high / root), max(over), sum(o > 2 for o in over) / len(over)] if over else [0.0] * 5
    mean, scale, weights = model.fit
    z = weights[5] + sum((f - m) / s * w for f, m, s, w in zip(features, mean, scale, weights, strict=False))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def network(net, raw, chunk=32, stride=16):
    """The score of a convolutional network, chunk by chunk and filter by filter."""
    import math

    n = max(chunk, -(-len(raw) // stride) * stride)
    padded = bytes(raw) + b"\0" * (n - len(raw))
    top = [-math.inf] * len(net.bias)
    for start in range(0, n - chunk + 1, stride):
        flat = [float(v) for b in padded[start : start + chunk] for v in net.vectors[b]]
        for k in range(len(top)):
            top[k] = max(top[k], sum(x * float(w) for x, w in zip(flat, net.filters[:, k], strict=True)))
    z = float(net.out[-1]) + sum(math.tanh(t + float(b)) * float(o) for t, b, o in zip(top, net.bias, net.out, strict=False))
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def trigram_shares(text, likelihood, rounds, bits):
    """Proportions of the languages and the log-likelihood by plain expectation-maximisation, trigram by trigram."""
    import math

    raw = b" " + re.sub(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+", b" ", text.lower().encode()) + b" "
    codes = [((a << 16 | b << 8 | c) * 2654435761 % 2**32) >> (32 - bits) for a, b, c in zip(raw, raw[1:], raw[2:], strict=False)]
    k = likelihood.shape[1]
    share = [1 / k] * k
    for _ in range(rounds):
        new = [0.0] * k
        for c in codes:
            whole = sum(share[i] * likelihood[c][i] for i in range(k))
            for i in range(k):
                new[i] += share[i] * likelihood[c][i] / whole
        share = [x / len(codes) for x in new]
    return share, sum(math.log(sum(share[i] * likelihood[c][i] for i in range(k))) for c in codes)


def shard(doc, places):
    """The shard whose draw is the largest; places are (region, rack, shard, weight) of every shard."""
    import math

    def draw(region, rack, number, weight):
        seed = xxhash.xxh64_intdigest(doc.to_bytes(8, "little", signed=True), 42)
        value = xxhash.xxh64_intdigest(f"region {region}/rack {rack}/shard {number}".encode(), seed)
        return math.log(((value >> 11) + 1) / 2**53) / weight

    return max(places, key=lambda p: (draw(*p), -p[2]))[2]
