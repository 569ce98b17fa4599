"""Operator 3: language identification by multilingual mixture inference.

Letters in lower case, everything else one space, give hashed byte trigrams.  A language's model is its smoothed trigram
distribution, averaged over every training document.  A document's trigrams are taken as draws from a mixture of
languages: expectation-maximisation estimates the proportions.  The set of languages is chosen by penalised likelihood:
each language beyond the first must raise the log-likelihood by PENALTY times the logarithm of the trigram count.  The
prediction is the language of the largest proportion in the chosen set, and that proportion is its score.

Edge cases: a text that is null or has no letter is `und` with score 0 and no proportions; equal proportions go to the
language that sorts first; rows without language or id are not learnt from, yet predicted; rows that repeat count in
training as often as they occur; a language column with more than MOST_LANGUAGES values is an error; without any training row every text is `und`; other columns pass through, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.llm.arrow_text import column, small_batches
from weftspark.llm.rows import add_columns

#: Trigram buckets: a language model has this many numbers, which bounds what is collected and broadcast.
BUCKET_BITS = 14
#: Every training document has this weight, so that a few very long ones don't make up a language.
DOCUMENT_MASS = 1_000_000
ROUNDS = 12
PENALTY = 3.0
#: Proportions below this are not reported and do not enter the search for the set.
LEAST_SHARE = 0.02
UNDETERMINED = "und"
#: Languages that a model may have: a column with more values is none of languages, and would make the model grow with it.
MOST_LANGUAGES = 1024
_LETTER = regex.compile(r"\p{L}")
#: Bytes to themselves if they may belong to a letter, A-Z to a-z, others to a space.
_FOLD = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)], np.uint8)


def held_out(id_column: str, modulus: int, remainder: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; false where the id is null."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def trigrams(raw: np.ndarray) -> np.ndarray:
    """Buckets of the trigrams of UTF-8 bytes (upper case beyond A-Z is folded by the caller)."""
    b = _FOLD[raw]
    space = b == 32
    if space.any():  # runs of other characters are one space
        b = b[~(space & np.r_[False, space[:-1]])]
    b = np.concatenate([[np.uint8(32)], b, [np.uint8(32)]]).astype(np.uint32)
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def _documents(array: pa.Array) -> Iterator[tuple[bool, np.ndarray]]:
    """For each text: whether it has a letter, and its trigram counts over all buckets."""
    for t in array.to_pylist():
        if not t or not _LETTER.search(t):
            yield False, np.zeros(0, np.int64)
            continue
        raw = t.encode("utf-8") if t.isascii() else t.lower().encode("utf-8")
        yield True, np.bincount(trigrams(np.frombuffer(raw, np.uint8)), minlength=1 << BUCKET_BITS)


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    likelihood: np.ndarray  # buckets x languages, each column sums to one


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang") -> LanguageModel:
    """Models of all languages from every row of docs that is usable and has a language."""
    small_batches(docs.sparkSession)
    rows = docs.filter(usable & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"))

    if rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"{lang} has more than {MOST_LANGUAGES} values")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for language, (_, counts) in zip(column(batch, "lang").to_pylist(), _documents(column(batch, "text")), strict=True):
                if len(counts):
                    counts = (counts * DOCUMENT_MASS) // counts.sum()
                    sums[language] = sums[language] + counts if language in sums else counts
        for language, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "bucket", "n"])

    totals = rows.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(totals["lang"].unique()))
    table = np.zeros((1 << BUCKET_BITS, len(languages)))
    for k, language in enumerate(languages):
        own = totals[totals["lang"] == language]
        table[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    table += DOCUMENT_MASS / 2000  # half a trigram of a document of a thousand
    return LanguageModel(languages, table / table.sum(axis=0, keepdims=True))


def mixture(counts: np.ndarray, likelihood: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the languages (columns) and the log-likelihood, by expectation-maximisation."""
    share = np.full(likelihood.shape[1], 1 / likelihood.shape[1])
    total = counts.sum()
    for _ in range(rounds):
        share = share * ((counts / (likelihood @ share)) @ likelihood) / total
    return share, float(counts @ np.log(likelihood @ share))


def infer(counts: np.ndarray, likelihood: np.ndarray, logs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The chosen languages (column numbers, largest proportion first) and their proportions."""
    at = np.flatnonzero(counts)
    counts, p = counts[at].astype(float), likelihood[at]
    single = counts @ logs[at]
    best = int(np.argmax(single))
    if p.shape[1] == 1:
        return np.array([best]), np.ones(1)
    price = PENALTY * np.log(counts.sum() + 1)
    share, whole = mixture(counts, p)
    if whole - single[best] <= price:  # no larger set can pay for itself
        return np.array([best]), np.ones(1)
    chosen, value, shares = np.array([best]), single[best], np.ones(1)
    order = [k for k in np.argsort(-share, kind="stable") if share[k] >= LEAST_SHARE]
    for size in range(2, len(order) + 1):
        own = np.array(order[:size])
        part, likely = mixture(counts, p[:, own])
        if likely - price * (size - 1) > value:
            chosen, value, shares = own, likely - price * (size - 1), part
    ranked = np.argsort(-shares, kind="stable")
    return chosen[ranked], shares[ranked]


def identify(docs: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """docs with the private columns lang_pred, lang_score and languages (array of language and share) behind its own."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        languages, likelihood = held.value.languages, held.value.likelihood
        logs = np.log(likelihood)
        for batch in batches:
            found = []
            for letters, counts in _documents(column(batch, text)):
                if not letters or not languages:
                    found.append([])
                    continue
                which, shares = infer(counts, likelihood, logs)
                found.append([{"lang": languages[k], "share": float(s)} for k, s in zip(which, shares, strict=True)])
            yield [
                pa.array([f[0]["lang"] if f else UNDETERMINED for f in found], pa.string()),
                pa.array([min(1.0, f[0]["share"]) if f else 0.0 for f in found], pa.float64()),
                pa.array(found, kind),
            ]

    return add_columns(docs, {"lang_pred": "string", "lang_score": "double", "languages": "array<struct<lang: string, share: double>>"}, compute)
