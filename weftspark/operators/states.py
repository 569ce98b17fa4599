"""Run state as tables: transitions, claims, staleness, lineage, revisions, resume."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def check_transitions(events: DataFrame, key: list[str], order: list[str], state: str, allowed: dict[str, tuple[str, ...]], first: tuple[str, ...]) -> DataFrame:
    """events with previous_state and legal: whether the step from the state before is allowed."""
    at = Window.partitionBy(*key).orderBy(*order)
    previous = F.lag(state).over(at)
    pairs = F.array(*[F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs]) if any(allowed.values()) else F.array().cast("array<string>")
    legal = F.when(previous.isNull(), F.col(state).isin(*first)).otherwise(F.array_contains(pairs, F.concat_ws(">", previous, F.col(state))))
    return events.withColumns({"previous_state": previous, "legal": legal})


def claims(requests: DataFrame, client_key: str, identity: list[str], order: list[str]) -> DataFrame:
    """One row per client key: its first request's identity, how often it was asked, and whether identities conflict."""
    return requests.groupBy(client_key).agg(
        *[F.min_by(c, F.struct(*order)).alias(c) for c in identity],
        F.count(F.lit(1)).alias("requests"),
        (F.count_distinct(F.struct(*identity)) > 1).alias("conflict"),
    )


def gaps_over(events: DataFrame, key: list[str], at: str, order: list[str], seconds: int) -> DataFrame:
    """Events after which the key was silent for more than `seconds` before its next event."""
    window = Window.partitionBy(*key).orderBy(at, *order)
    following = F.lead(at).over(window)
    elapsed = F.unix_micros(following.cast("timestamp")) - F.unix_micros(F.col(at).cast("timestamp"))
    return events.withColumn("gap_us", elapsed).filter(F.col("gap_us") > seconds * 1_000_000)


def latest(revisions: DataFrame, key: list[str], number: list[str], values: list[str]) -> DataFrame:
    """Of each key the values with the highest number."""
    return revisions.groupBy(*key).agg(F.count(F.lit(1)).alias("revisions"), *[F.max_by(v, F.struct(*number)).alias(v) for v in values])


def check_lineage(revisions: DataFrame, key: list[str], number: str, revision: str, parent: str) -> DataFrame:
    """One row per key: whether numbers run 0, 1, 2, ... and each row's parent is the revision before."""
    at = Window.partitionBy(*key).orderBy(number)
    sound = (F.col(number) == F.row_number().over(at) - 1) & F.lag(revision).over(at).eqNullSafe(F.col(parent))
    return revisions.withColumn("_sound", sound).groupBy(*key).agg(F.count(F.lit(1)).alias("revisions"), F.bool_and("_sound").alias("contiguous"))


def missing(wanted: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """What is still to do: rows of wanted whose key is not in done."""
    return wanted.join(done.select(*key).distinct(), key, "left_anti")


def number_gaps(df: DataFrame, number: str) -> DataFrame:
    """Numbers between the least and the greatest that no row has."""
    low, high = df.agg(F.min(number), F.max(number)).first()
    if low is None:
        return df.sparkSession.range(0).select(F.col("id").alias(number))
    return df.sparkSession.range(int(low), int(high) + 1).select(F.col("id").alias(number)).join(df.select(F.col(number).cast("bigint").alias(number)), number, "left_anti")


def leases(events: DataFrame, key: str, owner: str, kind: str, at: str, now: str, seconds: int = 30) -> DataFrame:
    """Per key who holds its lease at `now`: owner, since, last_beat and expired; keys that were released last have no row.

    kind is acquire, heartbeat or release.  An acquisition counts if nobody holds the lease then, or its holder gave no sign
    of life for more than `seconds`; from then on only the holder's events count.  Who holds a lease depends on all events
    before, so each key's events are read in order, without being gathered.
    """
    rows = events.select(F.col(key).cast("string").alias("k"), F.col(owner).cast("string").alias("o"), F.col(kind).alias("e"), F.unix_micros(F.col(at).cast("timestamp")).alias("t"))

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held = None, None
        for batch in batches:
            out = []
            for k, o, e, t in batch.itertuples(index=False):
                if k != current:
                    if held:
                        out.append((current, *held))
                    current, held = k, None
                if e == "acquire" and (held is None or t - held[2] > seconds * 1_000_000):
                    held = (o, t, t)
                elif held and held[0] == o:
                    held = None if e == "release" else (o, held[1], t)
            yield pd.DataFrame(out, columns=["k", "owner", "since", "beat"])
        if held:
            yield pd.DataFrame([(current, *held)], columns=["k", "owner", "since", "beat"])

    found = rows.repartition("k").sortWithinPartitions("k", "t", "o").mapInPandas(follow, "k string, owner string, since long, beat long")
    late = F.unix_micros(F.lit(now).cast("timestamp")) - F.col("beat") > seconds * 1_000_000
    return found.select(F.col("k").cast(events.schema[key].dataType).alias(key), "owner", F.timestamp_micros("since").alias("since"), F.timestamp_micros("beat").alias("last_beat"), late.alias("expired"))


def next_attempts(outcomes: DataFrame, key: list[str], order: list[str], outcome: str, most: int) -> DataFrame:
    """Per key what is to be done next: its attempts so far and next_step (done, retry, failed or recover).

    outcome is succeeded, transient, failed or running; a unit whose last word is running was abandoned and is taken up again
    as long as attempts are left.
    """
    last = F.max_by(outcome, F.struct(*order))
    out = outcomes.groupBy(*key).agg(F.count_if(F.col(outcome) != "running").alias("attempts"), last.alias("_last"), F.bool_or(F.col(outcome) == "succeeded").alias("_done"))
    left = F.col("attempts") < most
    step = F.when(F.col("_done"), "done").when(F.col("_last") == "failed", "failed").when(~left, "failed").when(F.col("_last") == "running", "recover").otherwise("retry")
    return out.select(*key, "attempts", step.alias("next_step"))


def revalidated(cached: DataFrame, identity: str, payload: str, digest: str, wanted: DataFrame, sound) -> DataFrame:
    """What a content-addressed cache has of the wanted identities, read as if it were new: results whose payload no longer
    has the digest it was stored under, or that `sound` (payload column -> condition) refuses, are left out and made again."""
    fits = (F.sha2(F.col(payload), 256) == F.col(digest)) & F.coalesce(sound(F.col(payload)), F.lit(False))
    return cached.join(wanted.select(identity).distinct(), identity, "left_semi").filter(fits)


#: Decisions of a match, and what a job's overview calls them.
JOB_STATUSES = {"unique_best_candidate": "recommended", "ranked_candidates": "choose", "ambiguous_tie": "choose", "insufficient_evidence": "incomplete", "no_candidate": "none"}


def job_summary(decisions: DataFrame, job: str = "job", decision: str = "decision") -> DataFrame:
    """Per job the number of its records by what has to be done about them."""
    names = F.create_map(*[F.lit(x) for pair in JOB_STATUSES.items() for x in pair])
    status = F.coalesce(F.try_element_at(names, F.col(decision)), F.lit("none"))
    return decisions.withColumn("_s", status).groupBy(job).agg(F.count(F.lit(1)).alias("records"), *[F.count_if(F.col("_s") == s).alias(s) for s in dict.fromkeys(JOB_STATUSES.values())])
