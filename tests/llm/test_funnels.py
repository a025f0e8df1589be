import datetime
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from sigla.llm import funnels
from sigla.llm.funnels import Funnel
from sigla.llm.queries import FUNNELS, op12_funnels

START = datetime.datetime(2024, 1, 31, 22, 0)
SCHEMA = "click_id long, ts timestamp_ntz, client_id long, kind string"


def by_hand(rows, flows):
    """Row by row: every attempt followed through all rows of its client."""
    clean = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    own = defaultdict(list)
    for c, k, t in clean:
        own[c].append((t, k))
    out = {}
    for f in flows:
        for c, events in own.items():
            n, waits = Counter(), defaultdict(list)
            for t1, k1 in events:
                if k1 != f.steps[0]:
                    continue
                n[1] += 1
                before = t1
                for step, kind in enumerate(f.steps[1:], 2):
                    later = [t for t, k in events if k == kind and t > before]
                    if not later or min(later) - before > datetime.timedelta(minutes=f.minutes):
                        break
                    if any(k in f.excluded and before < t <= min(later) for t, k in events):
                        break
                    n[step] += 1
                    waits[step].append((min(later) - before) // datetime.timedelta(microseconds=1))
                    before = min(later)
            if n:
                times = [sorted(waits[s])[-(-90 * len(waits[s]) // 100) - 1] if waits[s] else None for s in (2, 3, 4)]
                out[f.name, c] = (*[n[s] for s in (1, 2, 3, 4)], max(n), *times)
    alike = Counter((k[0], v[4]) for k, v in out.items())
    return {k: (*v, alike[k[0], v[4]]) for k, v in out.items()}


def found(df):
    names = ["n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    rows = df.collect()
    got = {(r.funnel, r.client_id): tuple(r[c] for c in names) for r in rows}
    assert len(got) == len(rows)
    return got


def random_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        client = rng.choice([7, 7, 7, 1, 2, 3, None])
        ts = START + datetime.timedelta(minutes=rng.randrange(0, 900, 5), microseconds=rng.choice([0, 0, 1]))
        rows.append((client, rng.choice(["view", "click", "click", "purchase", "error", "signup", "other", None]), rng.choice([ts] * 20 + [None])))
    return rows + rows[: n // 5]


@pytest.mark.parametrize("hours", [1, 6])
@pytest.mark.parametrize("zone", ["UTC", "Europe/Berlin"])
def test_equals_following_each_attempt(spark, hours, zone, monkeypatch):
    monkeypatch.setattr(funnels, "CHUNK_ROWS", 50)
    rows = random_rows(hours, 900)
    df = spark.createDataFrame([(k, t, c, kind) for k, (c, kind, t) in enumerate(rows)], SCHEMA)
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert found(funnels.counted(df, FUNNELS, range_hours=hours)) == by_hand(rows, FUNNELS)
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def at(minutes, micro=0):
    return START + datetime.timedelta(minutes=minutes, microseconds=micro)


@pytest.mark.parametrize(
    "rows, reached",
    [
        ([("a", 0), ("b", 0)], (1, 0)),  # of one time is not later
        ([("a", 0), ("b", 60)], (1, 1)),  # the limit itself is in time
        ([("a", 0), ("b", 60, 1)], (1, 0)),
        ([("a", 0), ("x", 5), ("b", 5)], (1, 0)),  # an exclusion at the step's time ends the attempt
        ([("a", 0), ("x", 0), ("b", 5), ("x", 6)], (1, 1)),  # at the first step's, or after: not
        ([("a", 0), ("a", 0), ("b", 1), ("b", 1)], (1, 1)),  # repeated rows are one
        ([("a", 119), ("b", 121)], (1, 1)),  # over the border of two ranges
        ([("b", 0)], None),
    ],
)
def test_edges_of_a_step(spark, rows, reached):
    df = spark.createDataFrame([(0, at(*when), 5, kind) for kind, *when in rows], SCHEMA)
    got = funnels.counted(df, [Funnel("f", ("a", "b"), ("x",))], range_hours=1).collect()
    assert [(r.n1, r.n2) for r in got] == ([] if reached is None else [reached])


def test_ranks_far_beyond_one_range_of_times(spark):
    rng = random.Random(4)
    for n in (1, 9, 10, 11, 400):
        values = [rng.choice([3, 5, rng.randrange(3_600_000_000)]) for _ in range(n)]
        df = spark.createDataFrame([("k", v, 1) for v in values], "key string, wait long, n long")
        assert funnels.ranked(df, ["key"]).first().time == sorted(values)[-(-90 * n // 100) - 1]


def test_no_rows_and_clashing_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert funnels.counted(empty, FUNNELS).columns == ["funnel", "client_id", "n1", "n2", "n3", "n4", "deepest", "t2", "t3", "t4", "same_depth"]
    assert funnels.counted(empty, FUNNELS).count() == 0
    rows = random_rows(3, 100)
    df = spark.createDataFrame([(k, t, c, kind, 1, "x", "y") for k, (c, kind, t) in enumerate(rows)], SCHEMA + ", part int, own string, n1 string")
    assert found(funnels.counted(df, FUNNELS)) == by_hand(rows, FUNNELS)


def test_cells_are_never_cut():
    batches = [pa.RecordBatch.from_pydict({"client_id": c, "part": p}) for c, p in ([[1, 1], [0, 0]], [[1, 1], [0, 1]], [[1, 2], [1, 1]])]
    old, funnels.CHUNK_ROWS = funnels.CHUNK_ROWS, 2
    try:
        chunks = [t.to_pydict() for t in funnels._whole_cells(iter(batches))]
    finally:
        funnels.CHUNK_ROWS = old
    cells = [set(zip(c["client_id"], c["part"])) for c in chunks]
    assert cells == [{(1, 0)}, {(1, 1), (2, 1)}]


def test_the_plan_of_the_query_broadcasts_only_depths(spark):
    df = op12_funnels(spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "SinglePartition" not in plan
