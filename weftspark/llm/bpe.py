"""Operator 10: BPE encoding and decoding with a public tokenizer file, by a pair occurrence index.

The words a batch has not met before are laid out as one chain of symbols.  An index maps each mergeable pair to all
its positions in that chain.  The active ranks are applied in ascending order; each merge takes the pair's whole
position list at once and updates the lists of the pairs to its left and right.  Words are independent, so this gives
the merges that a word-by-word encoder makes.  Results are remembered per word in a bounded table of the worker.

Normalising and splitting follow the tokenizer file (NFC, white space to one space, lower case, word pattern).  Texts
within the code points on which the interpreter's and the tokenizer's Unicode tables agree are split here; others are
split by the tokenizer library itself.  Merging is always done here.

Edge cases: a null or empty text has no ids and decodes to ''; special-token strings in a text are their own ids, as in
the library; a tokenizer file with other steps is refused (UnsupportedTokenizer); very long words are merged like any other; repeated rows give repeated results; other input columns are
never read, so their names cannot clash.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches

#: Words a worker remembers at most; the table is emptied beyond that.
REMEMBERED_WORDS = 400_000
#: Characters of text whose new words are merged together.
BLOCK_CHARS = 4_000_000
#: Latin, Greek, Cyrillic, punctuation and the main CJK blocks: assigned and cased alike in every Unicode version in use.
_AGREED = regex.compile(r"[\x00-ͷЀ-ԯḀ-ỿ‐-⁤₠-₿　-ヿ一-龥]*")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


# The kind of tokenizer file that is understood, part by part.
_NORMALIZERS, _PRE_TOKENIZERS = ["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]


class UnsupportedTokenizer(ValueError):
    """A tokenizer file asks for steps that this encoder does not make."""


def _require_known(spec: dict, path: str) -> None:
    """Refuse a file whose steps are not those that the encoder makes, and say which one is not."""
    kinds = lambda part, key: [p.get("type") for p in (spec.get(part) or {}).get(key, [spec.get(part) or {}])]
    model = spec.get("model") or {}
    wanted = {
        "normalizer": (kinds("normalizer", "normalizers"), _NORMALIZERS),
        "pre_tokenizer": (kinds("pre_tokenizer", "pretokenizers"), _PRE_TOKENIZERS),
        "decoder": (spec.get("decoder"), None),
        "model": (model.get("type"), "BPE"),
        "model.dropout": (model.get("dropout"), None),
        "model.byte_fallback": (bool(model.get("byte_fallback")), False),
        "model.ignore_merges": (bool(model.get("ignore_merges")), False),
        "model.continuing_subword_prefix": (model.get("continuing_subword_prefix") or "", ""),
    }
    for name, (found, known) in wanted.items():
        if found != known:
            raise UnsupportedTokenizer(f"{path}: {name} is {found!r}, known is {known!r}")


class PairIndexEncoder:
    """Ids and tokens of words, by the pair occurrence index."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        _require_known(spec, path)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"] or ""
        self.tokens = {i: t for t, i in self.vocab.items()}
        letters = _byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for left, right in (m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            a, b = self.vocab[left], self.vocab[right]
            self.rank[a << 32 | b] = len(self.merge)
            self.merge.append((a, b, self.vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens.update({i: t for t, i in self.special.items()})
        self.pattern = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.path = path
        self._library = None
        self._letter_bytes = {c: b for b, c in enumerate(letters)}

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token stands as itself behind a NUL, which no word can begin with alone."""
        if self.special_pattern is None or "<|" not in text:
            return self._split(text)
        out: list[str] = []
        for i, part in enumerate(self.special_pattern.split(text)):
            out += ["\0" + part] if i % 2 else self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        if not text:
            return []
        if _AGREED.fullmatch(text):
            if not text.isascii():
                text = unicodedata.normalize("NFC", text)
                if "Σ" in text:  # lower case goes letter by letter: no final sigma
                    text = text.replace("Σ", "σ")
            return self.pattern.findall(text.lower())
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        pieces = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(self._letter_bytes[c] for c in piece).decode("utf-8") for piece, _ in pieces]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The ids of each word."""
        raws = [w.encode("utf-8") for w in words]
        lengths = np.fromiter(map(len, raws), np.int64, len(raws))
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        raw = np.frombuffer(b"".join(raws), np.uint8)
        first = np.asarray(self.inner, np.int64)[raw]
        tails = ends[lengths > 0] - 1
        first[tails] = np.asarray(self.last, np.int64)[raw[tails]]
        follows = np.arange(1, total + 1)
        follows[tails] = -1
        precedes = np.arange(-1, total - 1)
        precedes[(ends - lengths)[lengths > 0]] = -1
        # the index: rank -> all positions of the pair
        at = np.flatnonzero(follows >= 0)
        keys, which = np.unique(first[at] << 32 | first[at + 1], return_inverse=True)
        rank = self.rank
        ranks = np.fromiter((rank.get(k, -1) for k in keys.tolist()), np.int64, len(keys))[which]
        at, ranks = at[ranks >= 0], ranks[ranks >= 0]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        index = {int(ranks[c]): p.tolist() for c, p in zip(cuts, np.split(at, cuts[1:]), strict=False)} if len(at) else {}
        symbol, after, before = first.tolist(), follows.tolist(), precedes.tolist()
        heap = list(index)
        heapq.heapify(heap)
        merge = self.merge
        while heap:
            r = heapq.heappop(heap)
            a, b, new = merge[r]
            places = index.pop(r)
            places.sort()
            for p in places:
                q = after[p]
                if symbol[p] != a or q < 0 or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = new, -1
                right = after[p] = after[q]
                if right >= 0:
                    before[right] = p
                    other = rank.get(new << 32 | symbol[right])
                    if other is not None:
                        if other in index:
                            index[other].append(p)
                        else:
                            index[other] = [p]
                            heapq.heappush(heap, other)
                left = before[p]
                if left >= 0:
                    other = rank.get(symbol[left] << 32 | new)
                    if other is not None:
                        if other in index:
                            index[other].append(left)
                        else:
                            index[other] = [left]
                            heapq.heappush(heap, other)
        out, start = [], 0
        for end in ends.tolist():
            out.append([s for s in symbol[start:end] if s >= 0])
            start = end
        return out


class _Remembered:
    """Per worker: word -> (ids as text, tokens as text)."""

    def __init__(self, path: str):
        self.encoder = PairIndexEncoder(path)
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, pieces: list[list[str]]) -> None:
        new = set().union(*pieces).difference(self.ids) if pieces else set()
        if len(self.ids) + len(new) > REMEMBERED_WORDS:
            self.ids, self.decoded = {}, {}
            new = set().union(*pieces)
        own = [w for w in new if w[0] == "\0" and w[1:] in self.encoder.special]
        for w in own:
            self.ids[w], self.decoded[w] = str(self.encoder.special[w[1:]]), w[1:]
        plain = sorted(new.difference(own))
        tokens = self.encoder.tokens
        for w, ids in zip(plain, self.encoder.encode_words(plain), strict=True):
            self.ids[w] = " ".join(map(str, ids))
            self.decoded[w] = " ".join([tokens[i] for i in ids])


@lru_cache(maxsize=2)
def _remembered(path: str) -> _Remembered:
    return _Remembered(path)


def _blocks(texts: list[str | None]) -> Iterator[list[str]]:
    block: list[str] = []
    size = 0
    for t in texts:
        block.append(t or "")
        size += len(t or "")
        if size >= BLOCK_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def encode(docs: DataFrame, tokenizer_path: str, text: str = "text", id_column: str = "doc_id", decoded: bool = True) -> DataFrame:
    """One row per input row: id_column, token_ids array<int>, n_tokens and, if asked for, the decoded text.

    tokenizer_path names a tokenizer file that is installed on every executor; the file is never shipped or copied.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _remembered(tokenizer_path)
        for batch in batches:
            at = 0
            for block in _blocks(column(batch, "__text").to_pylist()):
                pieces = [memory.encoder.words(t) for t in block]
                memory.learn(pieces)
                get, say = memory.ids.__getitem__, memory.decoded.__getitem__
                rows = [np.fromstring(" ".join(map(get, p)), np.int32, sep=" ") if p else np.zeros(0, np.int32) for p in pieces]
                counts = np.fromiter(map(len, rows), np.int64, len(rows))
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32)))
                arrays = [column(batch, "__id").slice(at, len(block)), lists, pa.array(counts)]
                if decoded:
                    arrays.append(pa.array([" ".join(map(say, p)) for p in pieces], pa.string()))
                yield pa.RecordBatch.from_arrays(arrays, names=names)
                at += len(block)

    names = [id_column, "token_ids", "n_tokens"] + ["decoded"] * decoded
    schema = f"`{id_column}` {kind}, token_ids array<int>, n_tokens bigint" + ", decoded string" * decoded
    return docs.select(F.col(id_column).alias("__id"), F.col(text).cast("string").alias("__text")).mapInArrow(run, schema)
