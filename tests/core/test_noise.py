"""The noise policy against a plain loop that keeps everything it has shown."""

import random
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from driftwell.operators.noise import COLUMNS, Policy, evaluate

SCHEMA = "subject long, window long, at timestamp, candidate string, score double, urgency double, domains array<string>, cooldown_key string, sensitive boolean, evidence boolean, trusted boolean, expires timestamp, repeated boolean, zone string"


def plain(rows, p):
    out, shown = {}, []
    rows = sorted(rows, key=lambda r: (r[0], r[2], r[1], -(r[4] or 0), -(r[5] or 0), r[3]))
    for r in rows:
        subject, window, at, name, score, _, domains, key, sensitive, evidence, trusted, expires, repeated, zone = r
        score, domains, key = score or 0.0, domains or [], key or ""
        here = [s for s in shown if s[:2] == (subject, window)]
        local = at.replace(tzinfo=ZoneInfo("UTC")).astimezone(ZoneInfo(zone or "UTC"))
        end = None
        if local.hour >= p.quiet_start or local.hour < p.quiet_end:
            day = local + timedelta(days=1) if local.hour >= p.quiet_start else local
            end = day.replace(hour=p.quiet_end, minute=0, second=0, microsecond=0).astimezone(ZoneInfo("UTC")).replace(tzinfo=None)
        critical = score >= p.critical
        if sensitive is not False:
            v = "privacy_veto"
        elif not evidence:
            v = "evidence_veto"
        elif not trusted:
            v = "trust_veto"
        elif expires is not None and at >= expires:
            v = "expired"
        elif score < p.threshold:
            v = "below_threshold"
        elif repeated:
            v = "duplicate_no_material_change"
        elif any(s[0] == subject and s[3] == key and at - s[2] < timedelta(hours=p.cooldown_hours) for s in shown):
            v = "cooldown_active"
        elif end:
            v = "quiet_period"
        elif len(here) >= p.total and not critical:
            v = "global_budget_exhausted"
        elif any(sum(d in s[4] for s in here) >= p.each for d in domains) and not critical:
            v = "domain_budget_exhausted"
        else:
            v = "shown"
            shown.append((subject, window, at, key, domains))
        out[subject, window, name] = (v, end if v == "quiet_period" else None)
    return out


@pytest.mark.parametrize("policy", [Policy(), Policy(threshold=0.2, cooldown_hours=5, total=2, each=1, critical=0.9), Policy(quiet_start=20, quiet_end=9)])
def test_equals_plain_loop(spark, policy):
    r = random.Random(8)
    rows = []
    for subject in range(8):
        at = datetime(2026, 3, 27, 1)
        for window in range(12):
            at += timedelta(hours=r.randint(1, 20), minutes=r.randint(0, 59))
            for c in range(r.randint(0, 9)):
                flag = lambda good: r.random() < good if r.random() < 0.95 else None
                domains = r.sample(["work", "home", "health"], r.randint(0, 3)) if r.random() < 0.9 else None
                rows.append((subject, window, at, f"c{c}", r.choice([None, round(r.random(), 2), round(0.5 + r.random() / 2, 2)]), r.choice([None, 0.1, 0.5]), domains, r.choice(["a", "b", "c", "d", None]), not flag(0.92), flag(0.95), flag(0.95), r.choice([None, at, at + timedelta(days=1)]), flag(0.05), r.choice([None, "UTC", "Europe/Berlin", "Asia/Shanghai"])))
    zoneless = spark.createDataFrame(rows, SCHEMA)
    got = {(x.subject, x.window, x.candidate): (x.verdict, x.deferred_until) for x in evaluate(zoneless, policy).collect()}
    want = plain([tuple(x) for x in zoneless.select(*COLUMNS).collect()], policy)
    assert got == want
    assert len({v for v, _ in want.values()}) >= 9


def test_nothing_and_missing_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert evaluate(none).collect() == []
    with pytest.raises(ValueError, match="zone"):
        evaluate(none.drop("zone"))
    assert evaluate(none.withColumn("more", F.lit(1))).columns == ["subject", "window", "candidate", "verdict", "deferred_until"]
