"""Operator 1: toxicity by compression distance.

Texts are folded to words (lower case; anything but ASCII letters and code points from U+0080 is one space).  The
ordinary dictionary is a word-frequency list: what zstandard trains on strings of the commonest ordinary words, and those
words themselves, the commonest last; ordinary texts as such are not trained on.  The toxic dictionary is trained on the stretches of toxic
text whose byte n-grams are significantly more frequent among toxic documents (likelihood ratio), and stands in front of
the ordinary content, so that the two compressors differ in nothing but what toxic text adds.  Each window of a text is
compressed with either; the gain is the bytes that the toxic dictionary saves.  The windows' gains, measured against the
mean and spread of gains in ordinary text, are combined by a logistic regression, fitted on documents that neither
dictionary has seen, into the score.

Training takes at most 2 x per_class labelled documents.  Edge cases: null and empty texts have no window and get the
score of a text without gain; texts of any length are read whole; rows that repeat score alike; without labels of both
classes every score is 0; other columns pass through, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame

from weftspark.llm.arrow_text import column
from weftspark.llm.rows import add_columns
from weftspark.llm.sampling import logistic

PER_CLASS = 3000
WINDOW_BYTES = 24
LONGEST_BYTES = 4 * WINDOW_BYTES
TOXIC_BYTES = 2000
ORDINARY_BYTES = 8000
GRAMS = (4, 5, 6)
#: An n-gram marks toxic text if its likelihood ratio statistic is RATIO_SHARE of the toxic documents it is counted in,
#: within these bounds, and if it is in at least LEAST_DOCS of them.
RATIO_SHARE, RATIO_BOUNDS, LEAST_DOCS = 0.06, (15.0, 80.0), 5
#: Share of the sample that trains the dictionaries; the rest calibrates.
DICTIONARY_SHARE = 0.65
#: Threshold of the prediction.
THRESHOLD = 0.3
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> bytes:
    return b" ".join((text or "").lower().encode("utf-8", "replace").translate(_FOLD).split())


def windows(folded: bytes) -> list[bytes]:
    """Consecutive windows of WINDOW_BYTES or a little more, cut between words; where no word ends within LONGEST_BYTES,
    between code points."""
    out, start, n = [], 0, len(folded)
    while start < n:
        end = folded.find(b" ", start + WINDOW_BYTES)
        end = n if end < 0 else end
        whole = end - start <= LONGEST_BYTES
        if not whole:
            end = start + LONGEST_BYTES
            while folded[end] & 0xC0 == 0x80:
                end -= 1
        out.append(b" " + folded[start:end] + b" ")
        start = end + whole
    return out


def _grams(data: bytes, k: int) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).astype(np.uint64)
    if len(raw) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(raw) - k + 1, np.uint64)
    for i in range(k):
        out = out << np.uint64(8) | raw[i : len(raw) - k + 1 + i]
    return out


def _frequencies(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each n-gram and the number of texts it is in."""
    held = [np.unique(_grams(b" " + t + b" ", k)) for t in texts]
    return np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)


def _entropy(part: np.ndarray, whole: float, expected: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(part > 0, part * np.log(part / (whole * expected)), 0.0)


def toxic_stretches(toxic: list[bytes], ordinary: list[bytes]) -> Counter:
    """The maximal stretches of the toxic texts that marking n-grams cover, with their counts."""
    a_all, b_all = len(toxic), len(ordinary)
    least = float(np.clip(RATIO_SHARE * a_all, *RATIO_BOUNDS))
    marks = {}
    for k in GRAMS:
        grams, a = _frequencies(toxic, k)
        grams, a = grams[a >= LEAST_DOCS], a[a >= LEAST_DOCS].astype(float)
        others, counts = _frequencies(ordinary, k)
        at = np.minimum(np.searchsorted(others, grams), max(0, len(others) - 1))
        b = np.where(others[at] == grams, counts[at], 0).astype(float) if len(others) else np.zeros(len(grams))
        p = (a + b) / (a_all + b_all)
        ratio = 2 * (_entropy(a, a_all, p) + _entropy(b, b_all, p) + _entropy(a_all - a, a_all, 1 - p) + _entropy(b_all - b, b_all, 1 - p))
        marks[k] = grams[(ratio >= least) & (a / a_all > 3 * b / b_all)]
    found: Counter = Counter()
    for t in toxic:
        t = b" " + t + b" "
        edges = np.zeros(len(t) + 1, np.int64)
        for k in GRAMS:
            at = np.flatnonzero(np.isin(_grams(t, k), marks[k]))
            np.add.at(edges, at, 1)
            np.add.at(edges, at + k, -1)
        cuts = np.flatnonzero(np.diff(np.r_[0, np.cumsum(edges)[:-1] > 0, 0].astype(np.int8)))
        found.update(t[s:e] for s, e in zip(cuts[::2], cuts[1::2], strict=True))
    return found


#: The last field in front of a trained dictionary's content: its three repeat offsets.
_REPEAT_OFFSETS = b"".join(n.to_bytes(4, "little") for n in (1, 4, 8))


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """Content of a dictionary that zstandard trains on the samples, without the tables in front of it; the most frequent
    samples where it can't fill half of it."""
    try:
        trained = zstd.train_dictionary(size, samples, k=16, d=6).as_bytes()
    except zstd.ZstdError:
        trained = b""
    trained = trained[trained.find(_REPEAT_OFFSETS) + len(_REPEAT_OFFSETS) :]
    return trained if 2 * len(trained) >= size else b"".join([s for s, _ in Counter(samples).most_common(size // 7)][::-1])[-size:]


@dataclass(frozen=True)
class ToxicityModel:
    toxic: bytes
    ordinary: bytes
    mean: float = 0.0  # of window gains in ordinary text
    spread: float = 1.0
    fit: tuple | None = None  # mean, scale and weights of the features

    def gains(self) -> Gains:
        return Gains(self)


class Gains:
    """The two compressors of a model."""

    def __init__(self, model: ToxicityModel):
        def compressor(content: bytes) -> zstd.ZstdCompressor:
            held = zstd.ZstdCompressionDict(content or b" " * 8, dict_type=zstd.DICT_TYPE_RAWCONTENT)
            how = zstd.ZstdCompressionParameters.from_level(6, dict_size=TOXIC_BYTES + ORDINARY_BYTES, source_size=2 * WINDOW_BYTES, min_match=4, write_checksum=False, write_content_size=False, write_dict_id=False)
            held.precompute_compress(compression_params=how)
            return zstd.ZstdCompressor(dict_data=held, compression_params=how)

        self.model = model
        self.toxic, self.ordinary = compressor(model.toxic + model.ordinary).compress, compressor(model.ordinary).compress

    def of(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves in each window."""
        own = windows(fold(text))
        return np.fromiter((len(self.ordinary(w)) - len(self.toxic(w)) for w in own), np.float64, len(own))

    def features(self, text: str | None) -> np.ndarray:
        gain = self.of(text)
        if not len(gain):
            return np.zeros(5)
        over = (gain - self.model.mean) / self.model.spread
        root = np.sqrt(len(gain))
        high = np.clip(over - 2, 0, None)
        return np.array([over.sum() / root, np.log1p(high.sum()), np.log1p(high.sum() / root), over.max(), (over > 2).mean()])

    def score(self, text: str | None) -> float:
        if self.model.fit is None:
            return 0.0
        mean, scale, weights = self.model.fit
        return float(1 / (1 + np.exp(-np.clip(np.r_[(self.features(text) - mean) / scale, 1.0] @ weights, -30, 30))))


def fit(sample: list[tuple[bytes, int]], counts: tuple[int, int] | None = None) -> ToxicityModel:
    """A model from whole texts (UTF-8) and labels: part of each class for the dictionaries, the rest for calibration.

    counts has the sizes of both classes, of which the sample may hold unequal parts; the score allows for that.
    """
    classes: list[list[str]] = [[], []]
    for text, label in sample:
        classes[label].append(text.decode("utf-8", "replace"))
    if not all(classes):
        return ToxicityModel(b"", b"")
    cuts = [max(1, round(DICTIONARY_SHARE * len(c))) for c in classes]
    halves = [(c[:k], c[k:] or c) for c, k in zip(classes, cuts, strict=True)]
    (ordinary, clean), (toxic, bad) = halves
    folded = [[fold(t) for t in part] for part in (ordinary, toxic)]
    words = Counter(w for t in folded[0] for w in dict.fromkeys(t.split()))
    common = [b" " + w for w, _ in words.most_common(4000)][::-1]
    base = _dictionary([b"".join(common[i : i + 40]) for i in range(0, len(common), 40)], ORDINARY_BYTES)[-ORDINARY_BYTES // 3 :] + b"".join(common)[-ORDINARY_BYTES:]
    stretches = toxic_stretches(folded[1], folded[0])
    model = ToxicityModel(_dictionary([s for s, n in stretches.items() for _ in range(n)], TOXIC_BYTES) if stretches else b"", base)
    gains = model.gains()
    usual = np.concatenate([gains.of(t) for t in clean] or [np.zeros(1)])
    if len(usual):
        model = ToxicityModel(model.toxic, base, float(usual.mean()), float(usual.std()) + 0.05)
    gains = model.gains()
    features = np.array([gains.features(t) for t in clean + bad])
    target = np.r_[np.zeros(len(clean)), np.ones(len(bad))]
    mean, scale, weights = logistic(features, target, ridge=1e-3)
    if counts is not None:
        weights[-1] += np.log(counts[1] / counts[0]) - np.log(len(classes[1]) / len(classes[0]))
    return ToxicityModel(model.toxic, base, model.mean, model.spread, (mean, scale, weights))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """docs with the private column toxic_score behind its own."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        gains = held.value.gains()
        for batch in batches:
            yield [pa.array([gains.score(t) for t in column(batch, text).to_pylist()], pa.float64())]

    return add_columns(docs, {"toxic_score": "double"}, compute)
