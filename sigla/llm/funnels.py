"""Ordered funnel counting: strict as-of joins per client and time range.

1. Rows of the kinds that some funnel names are made distinct, with a partial aggregation first, so
   that repeated rows meet as one.
2. Each row goes to the range of time it lies in, and to those before it in which an attempt may
   still need it: a funnel of k steps with a time limit sees no further than (k - 1) limits ahead
   (the halo).  Cells of client and range are dealt by hash, so a client with a third of all rows is
   as many cells as there are ranges.
3. In ``mapInArrow``, whole cells are gathered up to CHUNK_ROWS rows and go through DuckDB together:
   a strict-inequality as-of join for each step finds the next step's row, and one for each
   exclusion the first excluded row.  Attempts belong to the cell in which they start.
4. Spark adds the cells up by client, and ranks the times in two levels: how many times are in each
   range of 2**COARSE microseconds, then the distinct times of the one range that holds the rank.
   No window has more rows than there are such ranges or values in one, however many attempts a
   client has.  No join broadcasts but that with the number of clients per funnel and depth, which
   has a row for each funnel and step.

A cell is the rows of one client in RANGE_HOURS hours and the halo; where a client has more rows in
that time than a task can hold, DuckDB spills beyond MEMORY.

Edge cases: rows with a null client, kind or time are left out; repeated rows and rows of equal
times count once, and a row is never later than one of the same time; an attempt that reaches no
second step has null times; texts and other columns are not read, so extra columns are ignored
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import write_shared

#: Hours of a range, rows that go through DuckDB at a time (whole cells, so there may be more), and
#: DuckDB's memory.
RANGE_HOURS, CHUNK_ROWS, MEMORY = 6, 200_000, "512MB"
#: Times are ranked by ranges of 2**COARSE microseconds first.
COARSE = 21
PERCENT = 90


@dataclass(frozen=True)
class Funnel:
    """Kinds in order, kinds that end an attempt, and the minutes within which the next step comes."""

    name: str
    steps: tuple[str, ...]
    excluded: tuple[str, ...] = ()
    minutes: int = 60

    @property
    def limit(self) -> int:
        return self.minutes * 60_000_000


def micros(df: DataFrame, column: str) -> Column:
    """Microseconds since 1970 of a time; one without a zone is taken as it is, in any session zone."""
    c = F.col(column)
    if not isinstance(df.schema[column].dataType, T.TimestampNTZType):
        return F.unix_micros(c)
    days = F.datediff(F.to_date(c), F.lit("1970-01-01").cast("date")).cast("long")
    second = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
    return days * 86_400_000_000 + (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000 + second


def cells(events: DataFrame, funnels: Sequence[Funnel], range_hours: int = RANGE_HOURS) -> DataFrame:
    """client_id, part (number of the range), kind, ts (microseconds), own (false in the halo)."""
    kinds = sorted({k for f in funnels for k in (*f.steps, *f.excluded)})
    width = range_hours * 3_600_000_000
    halo = max((len(f.steps) - 1) * f.limit for f in funnels)
    rows = events.where(F.col("kind").isin(kinds) & F.col("client_id").isNotNull() & F.col("ts").isNotNull())
    rows = rows.select("client_id", "kind", micros(events, "ts").alias("ts")).distinct()
    last = F.floor(F.col("ts") / width)  # times of this century are exact in a double
    first = F.floor((F.col("ts") - halo) / width)
    rows = rows.withColumn("part", F.explode(F.sequence(first, last)))
    return rows.select("client_id", "part", "kind", "ts", (F.col("part") == last).alias("own"))


def _quoted(kinds: Sequence[str]) -> str:
    return ", ".join("'" + k.replace("'", "''") + "'" for k in kinds)


def attempts_sql(funnel: Funnel, number: int) -> str:
    """DuckDB SQL over ``cells``: how many attempts of a client reach each step (wait: microseconds
    from the step before, 0 for the first)."""
    out = [f"a1 AS (SELECT client_id, part, ts AS t1 FROM cells WHERE own AND kind IN ({_quoted(funnel.steps[:1])}))"]
    counted = [f"SELECT {number} AS funnel, client_id, 1 AS step, 0 AS wait, count(*) AS n FROM a1 GROUP BY ALL"]
    for k, kind in enumerate(funnel.steps[1:], 2):
        step = (
            f"s{k} AS (SELECT a.client_id, a.part, a.t{k - 1}, b.ts AS t{k} FROM a{k - 1} a "
            f"ASOF JOIN (SELECT client_id, part, ts FROM cells WHERE kind IN ({_quoted([kind])})) b "
            f"ON a.client_id = b.client_id AND a.part = b.part AND a.t{k - 1} < b.ts WHERE b.ts - a.t{k - 1} <= {funnel.limit})"
        )
        reached = f"a{k} AS (SELECT client_id, part, t{k - 1}, t{k} FROM s{k})"
        if funnel.excluded:
            reached = (
                f"a{k} AS (SELECT s.client_id, s.part, s.t{k - 1}, s.t{k} FROM s{k} s "
                f"ASOF LEFT JOIN (SELECT client_id, part, ts FROM cells WHERE kind IN ({_quoted(funnel.excluded)})) x "
                f"ON s.client_id = x.client_id AND s.part = x.part AND s.t{k - 1} < x.ts WHERE x.ts IS NULL OR x.ts > s.t{k})"
            )
        out += [step, reached]
        counted.append(f"SELECT {number}, client_id, {k}, t{k} - t{k - 1}, count(*) FROM a{k} GROUP BY ALL")
    return f"WITH {', '.join(out)} " + " UNION ALL ".join(counted)


def steps_reached(dealt: DataFrame, funnels: Sequence[Funnel]) -> DataFrame:
    """funnel (its place), client_id, step, wait, n of cells that lie together, one after the other."""
    statement = " UNION ALL ".join(f"SELECT * FROM ({attempts_sql(f, k)})" for k, f in enumerate(funnels))
    client = dealt.schema["client_id"].dataType
    schema = T.StructType([T.StructField("client_id", client), *T._parse_datatype_string("funnel int, step int, wait long, n long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        db = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY})
        for chunk in _whole_cells(batches):
            db.register("chunk", chunk)
            db.execute("CREATE OR REPLACE TEMP TABLE cells AS SELECT * FROM chunk")
            found = db.sql(f"SELECT client_id, funnel::INTEGER AS funnel, step::INTEGER AS step, wait::BIGINT AS wait, n::BIGINT AS n FROM ({statement})")
            yield from found.to_arrow_reader(100_000)
            db.unregister("chunk")
        db.close()

    return dealt.mapInArrow(run, schema)


def _whole_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to CHUNK_ROWS rows and cut where a cell ends."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if rows >= CHUNK_ROWS:
            cut = _first_of_next(held[-1], batch)
            if cut is not None:
                yield pa.Table.from_batches([*held, batch.slice(0, cut)])
                held, rows, batch = [], 0, batch.slice(cut)
        held.append(batch)
        rows += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def _first_of_next(before: pa.RecordBatch, batch: pa.RecordBatch) -> int | None:
    """Where in ``batch`` the cell of the last row of ``before`` has ended."""
    same = None
    for name in ("client_id", "part"):
        at = batch.schema.get_field_index(name)
        equal = pa.compute.equal(batch.column(at), before.column(at)[-1])
        same = equal if same is None else pa.compute.and_(same, equal)
    cut = pa.compute.index(same, False).as_py()
    return None if cut < 0 else cut


def ranked(waits: DataFrame, keys: Sequence[str], percent: int = PERCENT) -> DataFrame:
    """keys and time: the ceil(percent * n / 100)-th smallest ``wait`` of n, each ``n`` times."""
    keys = list(keys)
    coarse = F.shiftright("wait", COARSE).alias("coarse")
    values = waits.groupBy(*keys, coarse, "wait").agg(F.sum("n").alias("n"))
    ranges = values.groupBy(*keys, "coarse").agg(F.sum("n").alias("n"))
    below = F.sum("n").over(Window.partitionBy(*keys).orderBy("coarse").rowsBetween(Window.unboundedPreceding, -1))
    total = F.sum("n").over(Window.partitionBy(*keys))
    rank = F.expr(f"({percent} * total + 99) div 100") - F.coalesce("below", F.lit(0))
    ranges = ranges.withColumns({"below": below, "total": total}).withColumn("rank", rank)
    chosen = ranges.where("rank between 1 and n").select(*keys, "coarse", "rank")
    up_to = F.sum("n").over(Window.partitionBy(*keys, "coarse").orderBy("wait").rowsBetween(Window.unboundedPreceding, 0))
    inside = values.join(chosen.hint("shuffle_merge"), [*keys, "coarse"]).withColumn("up_to", up_to)
    return inside.where("up_to >= rank").groupBy(*keys).agg(F.min("wait").alias("time"))


def counted(events: DataFrame, funnels: Sequence[Funnel], percent: int = PERCENT, range_hours: int = RANGE_HOURS) -> DataFrame:
    """A row per funnel and client with attempts: n1.. (attempts that reach each step), deepest,
    t2.. (the percentile of each step's times), same_depth (clients of that funnel and depth)."""
    depth = max(len(f.steps) for f in funnels)
    dealt = cells(events, funnels, range_hours).repartition("client_id", "part").sortWithinPartitions("client_id", "part")
    reached = write_shared(steps_reached(dealt, funnels), "funnels")
    of_step = [F.sum(F.when(F.col("step") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in range(1, depth + 1)]
    clients = reached.groupBy("funnel", "client_id").agg(*of_step, F.max("step").cast("int").alias("deepest"))
    times = ranked(reached.where("step > 1"), ["funnel", "client_id", "step"], percent)
    of_time = [F.max(F.when(F.col("step") == k, F.col("time"))).alias(f"t{k}") for k in range(2, depth + 1)]
    times = times.groupBy("funnel", "client_id").agg(*of_time)
    clients = write_shared(clients.join(times.hint("shuffle_merge"), ["funnel", "client_id"], "left"), "funnel-clients")
    alike = clients.groupBy("funnel", "deepest").agg(F.count("*").alias("same_depth"))
    # A row for each funnel and depth, whatever the tables' size.
    out = clients.join(F.broadcast(alike), ["funnel", "deepest"])
    name = F.element_at(F.array(*[F.lit(f.name) for f in funnels]), F.col("funnel") + 1)
    numbers = [f"n{k}" for k in range(1, depth + 1)]
    return out.select(name.alias("funnel"), "client_id", *numbers, "deepest", *[f"t{k}" for k in range(2, depth + 1)], "same_depth")


def sql(funnels: Sequence[Funnel]) -> str:
    """DuckDB SQL for :func:`counted` over ``clicks``: all rows of a client at once, the next row of a
    kind as the least later one."""
    depth = max(len(f.steps) for f in funnels)
    parts = ["clean AS (SELECT DISTINCT client_id, kind, epoch_us(ts) AS ts FROM clicks WHERE client_id IS NOT NULL AND kind IS NOT NULL AND ts IS NOT NULL)"]
    for f in funnels:
        last = f"{f.name}_1"
        parts.append(f"{last} AS (SELECT '{f.name}' AS funnel, client_id, ts AS t1 FROM clean WHERE kind = '{f.steps[0]}')")
        for k, kind in enumerate(f.steps[1:], 2):
            others_ = _quoted(f.excluded or ("",))
            parts.append(
                f"{f.name}_{k} AS (SELECT p.*, CASE WHEN s.ts - p.t{k - 1} <= {f.limit} AND (x.ts IS NULL OR x.ts > s.ts) THEN s.ts END AS t{k} FROM {last} p "
                f"ASOF LEFT JOIN (SELECT client_id, ts FROM clean WHERE kind = '{kind}') s ON p.client_id = s.client_id AND p.t{k - 1} < s.ts "
                f"ASOF LEFT JOIN (SELECT client_id, ts FROM clean WHERE kind IN ({others_})) x ON p.client_id = x.client_id AND p.t{k - 1} < x.ts)"
            )
            last = f"{f.name}_{k}"
    parts.append("every AS (" + " UNION ALL ".join(f"SELECT * FROM {f.name}_{len(f.steps)}" for f in funnels) + ")")
    steps = range(1, depth + 1)
    counts = ", ".join(f"count(t{k}) AS n{k}" for k in steps)
    deepest = "max(CASE " + " ".join(f"WHEN t{k} IS NOT NULL THEN {k}" for k in reversed(steps)) + " END)::INTEGER AS deepest"
    times = ", ".join(f"(list_sort(list(t{k} - t{k - 1}) FILTER (t{k} IS NOT NULL)))[({PERCENT} * count(t{k}) + 99) // 100] AS t{k}" for k in steps if k > 1)
    parts.append(f"clients AS (SELECT funnel, client_id, {counts}, {deepest}, {times} FROM every GROUP BY funnel, client_id)")
    return f"WITH {', '.join(parts)} SELECT *, count(*) OVER (PARTITION BY funnel, deepest) AS same_depth FROM clients"
