"""Daily tables kept up to date by runs, against one rollup over everything."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest

from footfall.operators.rollup import rollup
from footfall.plans.increments import DailyRollup, signed_sessions
from footfall.sources.parts import PartTable

TZ = "Africa/Nairobi"
SESSION = (
    "session_id long, visitor_key string, started_at timestamp_ntz, duration_seconds long, engaged_seconds long, pageviews long, conversions long, "
    "is_engaged int, is_returning int, landing_path string, exit_path string, channel string, utm_source string, utm_medium string, "
    "utm_campaign string, referrer_domain string, country string, region string, city string, device_type string, browser string, os string, "
    "language string, viewport string"
)
EVENT = (
    "occurred_at timestamp_ntz, session_id long, visitor_key string, event_name string, category string, module string, page_path string, "
    "post_id long, post_type string, page_title string, is_conversion int, event_value_base decimal(18,4), attributes string"
)
START = datetime(2024, 1, 10, 18)


def history(seed, runs):
    """For each run the sessions it touches, as they are then, and its events; times, paths, values and visitors may be missing."""
    rnd, sessions, out = random.Random(seed), {}, []
    for run in range(runs):
        events, touched = [], set()
        for _ in range(25):
            if not sessions or rnd.random() < 0.4:
                i = len(sessions) + 1
                at = START + timedelta(hours=12 * run, minutes=rnd.randrange(700))
                first = [rnd.choice(["a", "b", "", None]) for _ in range(13)]
                sessions[i] = [i, rnd.choice(["v1", "v2", "v3", "v4", None]), at, 0, 0, 0, 0, 0, rnd.choice([0, 1, None]), rnd.choice(["/", "/x"]), "/", *first]
            s = sessions[rnd.choice([len(sessions), rnd.randrange(len(sessions)) + 1])]
            touched.add(s[0])
            name = rnd.choice(["page_view", "page_view", "page_engagement", "purchase", "site_search"])
            buy, path = int(name == "purchase"), rnd.choice(["/", "/x", "/y", None])
            s[3], s[4], s[5], s[6] = s[3] + rnd.randrange(900), s[4] + rnd.randrange(6), s[5] + (name == "page_view"), s[6] + buy
            s[7], s[10] = int(s[4] > 10 or s[5] >= 2 or s[6] > 0), path or s[10]
            at = s[2] + timedelta(seconds=s[3] + 40000 * rnd.randrange(3))
            told = {"page_engagement": f'{{"engaged_seconds": {rnd.randrange(2500)}, "pv": "{rnd.randrange(2)}"}}', "site_search": f'{{"query": "q{rnd.randrange(2)}", "results": {rnd.randrange(2)}}}'}
            value = Decimal(rnd.randrange(10**6)) / 10000 if buy and rnd.random() < 0.8 else None
            events.append((at, s[0], s[1], name, "c", rnd.choice(["m", None]), path, rnd.choice([1, 2, None]), rnd.choice(["post", None]), rnd.choice(["t", "u", None]), buy, value, told.get(name)))
        events.append((None, 1, "v1", "page_view", "c", "m", "/", 1, "post", "t", 0, None, None))
        out.append(([tuple(sessions[i]) for i in sorted(touched)], events))
    return out


def tables(spark, sessions, events):
    return spark.createDataFrame(sessions, SESSION), spark.createDataFrame(events, EVENT)


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=repr)


def assert_whole(spark, daily, runs):
    latest = {s[0]: s for sessions, _ in runs for s in sessions}
    sessions, events = tables(spark, list(latest.values()), [e for _, es in runs for e in es if e[0]])
    for name, want in rollup(sessions, events, None, TZ).items():
        got = daily.read(name)
        assert rows(got) == rows(want) and dict(got.dtypes) == dict(want.dtypes), name


def test_grown_tables_equal_one_rollup(spark, tmp_path, monkeypatch):
    """Each run fails once, at another step, and is repeated; the last comes twice. Parts of a day are merged once it has two."""
    runs, daily, before = history(5, 3), DailyRollup(spark, str(tmp_path), TZ, folders=2), {}
    publish = PartTable._publish
    for n, (sessions, events) in enumerate(runs):
        left = [(3, 9, 12)[n]]

        def fail(table, m):
            left[0] -= 1
            if left[0] == 0:
                raise OSError("lost")
            return publish(table, m)

        now, new = tables(spark, sessions, events)
        old = spark.createDataFrame(list(before.values()), SESSION)
        monkeypatch.setattr(PartTable, "_publish", fail)
        with pytest.raises(OSError):
            daily.add(now, old, new, n)
        monkeypatch.setattr(PartTable, "_publish", publish)
        for _ in range(1 + (n == 2)):
            days = daily.add(now, old, new, n)
        assert days and all(len(d) == 10 for d in days)
        before |= {s[0]: s for s in sessions}
    assert_whole(spark, daily, runs)
    kept = daily.read("daily_events", "2024-01-11", "2024-01-11")
    assert {str(r.day) for r in kept.select("day").distinct().collect()} == {"2024-01-11"}
    assert max(len(v) for v in PartTable(spark, f"{tmp_path}/parts/visitor_days").manifest().parts.values()) <= 2
    none = tables(spark, [], [])
    assert daily.add(none[0], None, none[1], 3) == []


def test_sessions_that_went_on_are_taken_back(spark):
    a, b = (1, "v", START, 5, 1, 1, 0, 0, 0, "/", "/x", *["a"] * 13), (2, "w", START, 5, 1, 1, 0, 0, 0, "/", "/x", *["a"] * 13)
    now, before = tables(spark, [a], [])[0], tables(spark, [a, b], [])[0].drop("viewport")
    got = [(r.session_id, r.sign, r.viewport) for r in signed_sessions(now, before).collect()]
    assert sorted(got) == [(1, -1, None), (1, 1, "a")]
    assert [r.sign for r in signed_sessions(now, None).collect()] == [1]


def test_a_run_reads_only_the_parts_of_its_days(spark, tmp_path):
    """Parts and reports of other days are made unreadable; a run that does not touch them does not notice."""
    runs, daily = history(7, 1), DailyRollup(spark, str(tmp_path), TZ)
    now, new = tables(spark, *runs[0])
    days = daily.add(now, None, new, 0)
    for f in tmp_path.glob("**/day=*/*.parquet"):
        f.write_bytes(b"")
    later = [(*s[:2], s[2] + timedelta(days=30), *s[3:]) for s in runs[0][0]]
    moved = [(e[0] and e[0] + timedelta(days=30), *e[1:]) for e in runs[0][1]]
    now, new = tables(spark, later, moved)
    more = daily.add(now, None, new, 1)
    assert more and not set(more) & set(days)
    total = daily.read("daily_traffic", more[0]).agg({"sessions": "sum"}).first()[0]
    assert total == len(later)
