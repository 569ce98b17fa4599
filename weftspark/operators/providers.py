"""What a run needs from outside, as functions from tables to tables, with stand-ins for tests and for doing without."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Outcomes of asking a provider: an answer, a failure in passing, or one that asking again won't mend.
SUCCEEDED, TRANSIENT, FAILED = "succeeded", "transient", "failed"


class Provider(Protocol):
    """Answers units of work (unit_id, unit_sha256, ...) with unit_id, response (JSON text or null) and outcome."""

    name: str

    def answer(self, units: DataFrame, attempt: int) -> DataFrame: ...


class DictionaryValidator(Protocol):
    """Compares evidence (record_id, field, source_text, value, ...) with dictionaries: a row per record and field with status."""

    def __call__(self, evidence: DataFrame) -> DataFrame: ...


class MaterialMatcher(Protocol):
    """Ranks materials for formal records (order_id, record): order_id, rank, material_code, match_score."""

    def __call__(self, records: DataFrame) -> DataFrame: ...


class StructureResolver(Protocol):
    """Chooses among layout candidates (candidate_id, role, scope_ids, ...): scope_id of what is to be read."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


class NullProvider:
    """Answers nothing: every unit fails, so that the rules' values stand."""

    name = "null"

    def answer(self, units: DataFrame, attempt: int) -> DataFrame:
        return units.select("unit_id", F.lit(None).cast("string").alias("response"), F.lit(FAILED).alias("outcome"))


class FakeProvider:
    """Answers from a table (unit_sha256, response, fails: how many attempts fail in passing before the answer)."""

    name = "fake"

    def __init__(self, answers: DataFrame):
        self.answers = answers

    def answer(self, units: DataFrame, attempt: int) -> DataFrame:
        joined = units.select("unit_id", "unit_sha256").join(self.answers, "unit_sha256", "left")
        late = F.coalesce("fails", F.lit(0)) >= attempt
        outcome = F.when(late, TRANSIENT).when(F.col("response").isNull(), FAILED).otherwise(SUCCEEDED)
        return joined.select("unit_id", F.when(~late, F.col("response")).alias("response"), outcome.alias("outcome"))


def first_layout(candidates: DataFrame) -> DataFrame:
    """A structure resolver that takes every order that blocks make up, and nothing auxiliary."""
    return candidates.filter("role = 'order'").select(F.explode("scope_ids").alias("scope_id"))
