"""Units of work through a provider: bounded retries, a cache that is read as if it were new, and the decided records."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftspark.operators import contracts, resolution, states
from weftspark.operators.providers import FAILED, SUCCEEDED, TRANSIENT, Provider
from weftspark.session import stored
from weftspark.streaming.runs import MOST_ATTEMPTS

RESPONSE = "fields array<struct<field: string, value: string, interpretation: string, quote: string, references: array<string>>>"
#: The contract of a response.
RESPONSE_CONTRACT: contracts.Schema = {
    "type": "object",
    "required": ("fields",),
    "properties": {
        "fields": {
            "type": "array",
            "items": {
                "type": "object",
                "required": ("field", "value", "interpretation"),
                "properties": {
                    "field": {"type": "string", "enum": resolution.BUSINESS_FIELDS},
                    "value": {"type": "string"},
                    "interpretation": {"type": "string", "enum": resolution.INTERPRETATIONS},
                    "quote": {"type": "string"},
                    "references": {"type": "array", "items": {"type": "string"}},
                },
            },
        }
    },
}


@dataclass(frozen=True)
class Extraction:
    outcomes: DataFrame  # one row per unit: response, attempts, outcome, cached
    decisions: DataFrame  # one row per record and field
    gate: DataFrame  # one row per record: ready or why not


def sound(response: Column) -> Column:
    """Whether a response keeps the contract."""
    checks = F.array_compact(F.array(*contracts.checks(response, RESPONSE_CONTRACT, "$")))
    return F.try_parse_json(response).isNotNull() & (F.size(checks) == 0)


def ask(units: DataFrame, provider: Provider, most_attempts: int = MOST_ATTEMPTS, cache: DataFrame | None = None) -> DataFrame:
    """unit_id, response, attempts, outcome and cached of every unit (unit_id, unit_sha256).

    A unit whose result the cache has (unit_sha256, response, response_sha256) is not asked for again, if the result still
    keeps the contract.  Failures in passing are asked for again, most_attempts times in all; an answer that breaks the
    contract is a failure that asking again won't mend.
    """
    units = stored(units, "units")
    none = F.lit(None).cast("string")
    out = units.limit(0).select("unit_id", none.alias("response"), F.lit(0).alias("attempts"), none.alias("outcome"), F.lit(False).alias("cached"))
    pending = units
    if cache is not None:
        known = states.revalidated(cache, "unit_sha256", "response", "response_sha256", units, sound).dropDuplicates(["unit_sha256"])
        hits = stored(units.join(known.select("unit_sha256", "response"), "unit_sha256").select("unit_id", "response", F.lit(0).alias("attempts"), F.lit(SUCCEEDED).alias("outcome"), F.lit(True).alias("cached")), "cached")
        out, pending = out.unionByName(hits), units.join(hits, "unit_id", "left_anti")
    for attempt in range(1, most_attempts + 1):
        answers = provider.answer(pending, attempt)
        judged = F.when((F.col("outcome") == SUCCEEDED) & ~F.coalesce(sound(F.col("response")), F.lit(False)), FAILED).otherwise(F.col("outcome"))
        said = stored(answers.select("unit_id", "response", F.lit(attempt).alias("attempts"), judged.alias("outcome"), F.lit(False).alias("cached")), "answers")
        final = said if attempt == most_attempts else said.filter(F.col("outcome") != TRANSIENT)
        out = out.unionByName(final.withColumn("outcome", F.when(F.col("outcome") == TRANSIENT, FAILED).otherwise(F.col("outcome"))))
        pending = units.join(said.filter(F.col("outcome") == TRANSIENT).select("unit_id"), "unit_id", "left_semi")
        if attempt < most_attempts and not pending.limit(1).count():
            break
    return out


def to_cache(units: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What a later run may take from this one."""
    new = outcomes.filter((F.col("outcome") == SUCCEEDED) & ~F.col("cached")).select("unit_id", "response")
    return units.select("unit_id", "unit_sha256").join(new, "unit_id").select("unit_sha256", "response", F.sha2("response", 256).alias("response_sha256")).dropDuplicates(["unit_sha256"])


def extract(units: DataFrame, provider: Provider, rules: DataFrame, catalog: DataFrame, most_attempts: int = MOST_ATTEMPTS, cache: DataFrame | None = None) -> Extraction:
    """A whole run: units are asked, candidates bound to their evidence, decided against the rules, and the records gated.

    units: unit_id, unit_sha256, record_id, scope_id, evidence_ids; rules: record_id, field, value, has_evidence for every
    record and field; catalog: evidence_id, scope_id, text.  Candidates whose evidence is unsound are left out.
    """
    outcomes = stored(ask(units.select("unit_id", "unit_sha256"), provider, most_attempts, cache), "outcomes")
    answered = outcomes.filter(F.col("outcome") == SUCCEEDED).join(units.select("unit_id", "record_id"), "unit_id")
    fields = answered.select("record_id", F.explode(F.from_json("response", RESPONSE)["fields"]).alias("f")).select("record_id", "f.*")
    none = F.array().cast("array<string>")
    candidates = fields.select("record_id", "field", "value", "interpretation", F.coalesce("quote", F.lit("")).alias("quote"), F.coalesce("references", none).alias("references")).dropDuplicates(["record_id", "field"])
    bound = resolution.bind(candidates, catalog, units.select("record_id", "scope_id", "evidence_ids"))
    decisions = stored(resolution.decide(bound.filter("violation is null"), rules), "decisions")
    return Extraction(outcomes, decisions, resolution.ready_gate(decisions, units.select("record_id")))
