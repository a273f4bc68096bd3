"""Which candidates are shown: vetoes, cooldown after what was really shown, quiet hours and budgets, in one ordered pass for each subject."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    threshold: float = 0.55
    cooldown_hours: int = 24
    quiet_start: int = 22
    quiet_end: int = 7
    total: int = 3
    each: int = 2
    critical: float = 0.95


#: Verdicts that need no other candidate, the first that holds; the pass over a subject's candidates decides the rest.
def veto(policy: Policy, at: Column) -> Column:
    """Null for a candidate that only cooldown, quiet hours or budgets can stop."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    return (
        F.when(F.coalesce(F.col("sensitive"), F.lit(True)), "privacy_veto")
        .when(no("evidence"), "evidence_veto")
        .when(no("trusted"), "trust_veto")
        .when(F.col("expires").isNotNull() & (at >= F.col("expires")), "expired")
        .when(F.coalesce(F.col("score"), F.lit(0.0)) < policy.threshold, "below_threshold")
        .when(F.coalesce(F.col("repeated"), F.lit(False)), "duplicate_no_material_change")
    )


def quiet_until(policy: Policy, at: Column, zone: Column) -> Column:
    """End of the quiet hours that ``at`` is in by local time, null outside them. A start after the end spans midnight."""
    local = F.from_utc_timestamp(at, zone)
    hour, day = F.hour(local), F.date_trunc("day", local)
    end = lambda d: F.to_utc_timestamp(d + F.make_interval(hours=F.lit(policy.quiet_end)), zone)
    if policy.quiet_start == policy.quiet_end:
        return F.lit(None).cast("timestamp")
    if policy.quiet_start < policy.quiet_end:
        return F.when((hour >= policy.quiet_start) & (hour < policy.quiet_end), end(day))
    return F.when(hour >= policy.quiet_start, end(F.date_add(day, 1).cast("timestamp"))).when(hour < policy.quiet_end, end(day))


COLUMNS = ("subject", "window", "at", "candidate", "score", "urgency", "domains", "cooldown_key", "sensitive", "evidence", "trusted", "expires", "repeated", "zone")


def evaluate(df: DataFrame, policy: Policy = Policy()) -> DataFrame:  # noqa: B008
    """(subject, window, candidate, verdict, deferred_until) of candidates with COLUMNS.

    Windows of a subject are evaluated in order at their time ``at``, and candidates of a window in falling score,
    falling urgency, and by name. The verdict is a veto, else ``cooldown_active`` if the candidate's key was shown
    less than the cooldown before, be it in an earlier window or earlier in this one, ``quiet_period`` with its end,
    ``global_budget_exhausted``, ``domain_budget_exhausted`` or ``shown``. Budgets are those of a window; what is
    critical takes no heed of them but counts. Only what is shown starts a cooldown or uses a budget. Null scores
    are 0, null flags count against a candidate, null zones are UTC; a subject is one ordered stream.
    """
    missing = [c for c in COLUMNS if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}")
    quiet = quiet_until(policy, F.col("at"), F.coalesce("zone", F.lit("UTC")))
    judged = df.select("subject", "window", "at", "candidate", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("urgency", F.lit(0.0)).alias("urgency"), F.array_distinct(F.coalesce("domains", F.array().cast("array<string>"))).alias("domains"), F.coalesce("cooldown_key", F.lit("")).alias("cooldown_key"), veto(policy, F.col("at")).alias("veto"), quiet.alias("quiet"))
    # Only what no veto stops changes what comes later, so the vetoed don't pass through the ordered scan.
    stopped = judged.where(F.col("veto").isNotNull()).select("subject", "window", "candidate", F.col("veto").alias("verdict"), F.lit(None).cast("timestamp").alias("deferred_until"))
    types = dict(df.dtypes)
    cooldown = pd.Timedelta(hours=policy.cooldown_hours)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        subject, window = object(), object()
        shown: dict[str, pd.Timestamp] = {}
        used, room = {}, policy.total
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                if r.subject != subject:
                    subject, window, shown = r.subject, object(), {}
                if r.window != window:
                    window, used, room = r.window, {}, policy.total
                    shown = {k: t for k, t in shown.items() if r.at - t < cooldown}
                critical = r.score >= policy.critical
                if r.cooldown_key in shown and r.at - shown[r.cooldown_key] < cooldown:
                    verdict = "cooldown_active"
                elif not pd.isna(r.quiet):
                    verdict = "quiet_period"
                elif room <= 0 and not critical:
                    verdict = "global_budget_exhausted"
                elif any(used.get(d, 0) >= policy.each for d in r.domains) and not critical:
                    verdict = "domain_budget_exhausted"
                else:
                    verdict, room = "shown", room - 1
                    shown[r.cooldown_key] = r.at
                    for d in r.domains:
                        used[d] = used.get(d, 0) + 1
                out.append((r.subject, r.window, r.candidate, verdict, r.quiet if verdict == "quiet_period" else pd.NaT))
            made = pd.DataFrame(out, columns=["subject", "window", "candidate", "verdict", "deferred_until"])
            made["deferred_until"] = pd.to_datetime(made["deferred_until"])
            yield made

    rows = judged.where(F.col("veto").isNull()).select("subject", "window", "at", "candidate", "score", "urgency", "domains", "cooldown_key", "quiet")
    ordered = rows.repartition("subject").sortWithinPartitions("subject", "at", "window", F.desc("score"), F.desc("urgency"), "candidate")
    schema = f"subject {types['subject']}, window {types['window']}, candidate {types['candidate']}, verdict string, deferred_until timestamp"
    return ordered.mapInPandas(scan, schema).unionByName(stopped)
