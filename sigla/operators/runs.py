"""Runs as a table: a row for each step of each run, what it read and what it wrote."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import shared
from . import ordered

FIRST_OUTPUT = "base/step1.csv"


def name(model: Column, thinking: Column, effort: Column) -> Column:
    """A run's name: the model and what was asked of its thinking; a level implies thinking."""
    ending = F.when(effort.isNotNull(), effort).when(thinking, "think").when(~thinking, "nothink")
    return F.concat_ws("-", model, ending)


def output_path(run: str, step: int) -> str:
    return FIRST_OUTPUT if step == 1 else f"runs/{run}/step{step}.csv"


def layout(run: str, step: int) -> dict[str, str]:
    """Where a run's step keeps what it reads, writes and tells."""
    home = f"runs/{run}"
    return {
        "output": output_path(run, step),
        "dump": f"{home}/step{step}.json",
        "report": f"{home}/step{step}_report.md",
        "manifest": f"{home}/manifest.json",
        "checkpoint": f"checkpoints/{run}/step{step}.jsonl",
        "baseline": f"{home}/evaluation_baseline.json",
    }


def chain(manifests: DataFrame, run: str) -> DataFrame:
    """A run's steps by number."""
    return manifests.where(F.col("run") == run).orderBy("step")


def having(manifests: DataFrame, step: int) -> DataFrame:
    return manifests.where(F.col("step") == step).select("run").distinct()


def only_run(manifests: DataFrame, run: str | None = None) -> str:
    """The run that is meant: the one named, or the only one there is."""
    names = [r.run for r in manifests.select("run").where("run is not null").distinct().orderBy("run").limit(100).collect()]
    if run is None and len(names) == 1:
        return names[0]
    if run in names:
        return run
    raise LookupError(f"no run {run!r}; there is: {', '.join(names) or 'none yet'}" if run or not names else f"several runs, so which one? {', '.join(names)}")


def with_inherited(manifests: DataFrame, run: str, step: int, parent: str | None = None) -> tuple[str, DataFrame]:
    """What a step reads, and the entries of the run it builds on, as entries of this run."""
    if step == 2:
        if parent is not None:
            raise ValueError("step 2 always reads the rules' output")
        return FIRST_OUTPUT, manifests.limit(0)
    source = parent or run
    before = manifests.where((F.col("run") == source) & (F.col("step") == step - 1)).select("output").limit(1).collect()
    if not before:
        others = [r.run for r in having(manifests, step - 1).orderBy("run").limit(20).collect()]
        raise LookupError(f"run {source!r} has no step {step - 1} to build on; these have one: {', '.join(others) or 'none'}")
    return before[0].output, manifests.where((F.col("run") == source) & (F.col("step") < step)).withColumn("run", F.lit(run))


def recorded(manifests: DataFrame, inherited: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of a run: a new one goes before its own, and those before inherited ones."""
    ranked = new.withColumn("k", F.lit(0)).unionByName(manifests.withColumn("k", F.lit(1))).unionByName(inherited.withColumn("k", F.lit(2)))
    best = F.row_number().over(Window.partitionBy("run", "step").orderBy("k"))
    return ranked.withColumn("best", best).where("best = 1").drop("best", "k")


def _writers(manifests: DataFrame) -> DataFrame:
    """file, run, step, input: who wrote each file; of several the first by run and step."""
    first = manifests.groupBy(F.col("output").alias("file")).agg(F.min(F.struct("run", "step", "input")).alias("w"))
    return first.select("file", "w.run", "w.step", "w.input")


def _jumps(manifests: DataFrame) -> Iterator[DataFrame]:
    """file, back of written files: the file 1, 2, 4, 8, ... steps behind each, while there is one.

    As many joins as the longest chain has binary digits; a table each, so that plans stay small.
    Where files lead in a circle there is always one, and the jumps end when they are longer than
    there are files.
    """
    writers = _writers(manifests)
    written = writers.select(F.col("file").alias("back"))
    jumps = shared.settled(writers.select("file", F.col("input").alias("back")).join(written, "back", "left_semi"))
    most, length = jumps.count(), 1
    while most and length <= most and not jumps.isEmpty():
        yield jumps
        further = jumps.select(F.col("file").alias("back"), F.col("back").alias("next"))
        jumps = shared.settled(jumps.join(further, "back").select("file", F.col("next").alias("back")))
        length *= 2


def _chains(manifests: DataFrame) -> DataFrame:
    """chain, won, input, members: steps of a run in a row of which each reads what the one before wrote.

    members (pos, run, step, file) are in order, and input is what the first of them read.  An entry
    whose output another one wrote first (not won) is a chain of its own, which nothing leads to.
    """
    first = F.row_number().over(Window.partitionBy("output").orderBy("run", "step", "input")) == 1
    own = manifests.select("run", "step", "input", F.col("output").alias("file"), first.alias("won"))
    order = Window.partitionBy("run", "won").orderBy("step", "file")
    goes_on = F.coalesce(F.col("won") & (F.col("input") == F.lag("file").over(order)), F.lit(False))
    numbered = own.withColumn("goes_on", goes_on).withColumn("no", F.count_if(~F.col("goes_on")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    placed = numbered.withColumn("pos", F.row_number().over(Window.partitionBy("run", "won", "no").orderBy("step", "file")))
    member = F.struct("pos", "run", "step", "file")
    grouped = placed.groupBy("run", "won", "no").agg(F.sort_array(F.collect_list(member)).alias("members"), F.min(F.struct("pos", "input")).input.alias("input"))
    return shared.settled(grouped.select(F.struct("run", "won", "no").alias("chain"), "won", "input", "members"))


def _led(chains: DataFrame) -> DataFrame:
    """chain, up, upto, by_run, by_step: where the first step of a chain reads from, if anyone wrote it."""
    files = chains.where("won").select(F.col("chain").alias("up"), F.explode("members").alias("m"))
    files = files.select(F.col("m.file").alias("input"), "up", F.col("m.pos").alias("upto"), F.col("m.run").alias("by_run"), F.col("m.step").alias("by_step"))
    return shared.settled(chains.select("chain", "input").join(files, "input").drop("input"))


def _paths(led: DataFrame) -> DataFrame:
    """chain, path (chain, upto), closed: the chains behind each, nearest first, and how far along each.

    Paths are put together by doubling lengths, so rounds are few; one that comes back to a chain
    ends there (closed), with that chain as its last.
    """
    one = F.struct(F.col("up").alias("chain"), "upto")
    paths = led.select("chain", F.array(one).alias("path"), F.col("chain").eqNullSafe(F.col("up")).alias("closed"))
    paths = shared.settled(paths.withColumn("open", ~F.col("closed")))
    while not paths.where("open").isEmpty():
        further = paths.select(F.col("chain").alias("last"), F.col("path").alias("more"), F.col("open").alias("goes_on"))
        both = paths.withColumn("last", F.when(F.col("open"), F.element_at("path", -1).chain)).join(further, "last", "left")
        both = both.withColumn("path", F.when(F.col("more").isNotNull(), F.concat("path", "more")).otherwise(F.col("path")))
        seen = F.concat(F.array("chain"), F.transform("path", lambda x: x.chain))
        both = both.withColumn("seen", seen).withColumn("again", F.size(F.array_distinct("seen")) < F.size("seen"))
        back = F.filter(F.sequence(F.lit(1), F.size("path")), lambda i: F.array_position("seen", F.get("seen", i)) <= i)
        path = F.when(F.col("again"), F.slice("path", F.lit(1), F.get(back, F.lit(0)))).otherwise(F.col("path"))
        open_ = F.col("more").isNotNull() & ~F.col("again") & F.col("goes_on")
        paths = shared.settled(both.select("chain", path.alias("path"), F.col("again").alias("closed"), open_.alias("open")))
    return paths.select("chain", "path", "closed")


def lineage(manifests: DataFrame) -> DataFrame:
    """run, step, output, by_run, by_step, depth, first, circular: a row for each step.

    by_run and by_step wrote what it read (null: no entry did); depth is how many steps lie behind
    it, and first the file that the earliest of them wrote.  Where files lead in a circle, depth and
    first are null.  Chains may be of any length: only what leads from chain to chain is followed.
    """
    chains = _chains(manifests)
    led = _led(chains)
    rest = F.aggregate("path", F.lit(0).cast("long"), lambda n, x: n + x.upto)
    ways = _paths(led).select("chain", rest.alias("rest"), F.element_at("path", -1).chain.alias("end"), "closed")
    heads = chains.select(F.col("chain").alias("end"), F.get("members", F.lit(0)).file.alias("at"))
    ways = ways.join(heads, "end", "left").join(led.select("chain", "by_run", "by_step"), "chain")
    before = lambda i: F.when(i > 0, F.get("members", i - 1))
    each = F.transform("members", lambda m, i: F.struct(m.run.alias("run"), m.step.alias("step"), m.file.alias("output"), m.pos.alias("pos"), before(i).run.alias("own_run"), before(i).step.alias("own_step")))
    own = chains.select("chain", F.get("members", F.lit(0)).file.alias("head"), F.explode(each).alias("m")).select("chain", "head", "m.*")
    out = own.join(ways, "chain", "left")
    circular, within = F.coalesce("closed", F.lit(False)), F.col("pos") > 1
    by = lambda c: F.when(within, F.col(f"own_{c}")).otherwise(F.col(f"by_{c}")).alias(f"by_{c}")
    depth = F.when(~circular, F.col("pos") - 1 + F.coalesce("rest", F.lit(0).cast("long")))
    return out.select("run", "step", "output", by("run"), by("step"), depth.alias("depth"), F.when(~circular, F.coalesce("at", "head")).alias("first"), circular.alias("circular"))


def lineages(manifests: DataFrame) -> DataFrame:
    """run, step, depth, from_run, from_step, output, circular: each step (depth 0) and every step behind it, each once.

    Follows each step's input to the entry that wrote it; stops where no entry did, or at a file
    that has been passed (circular).  What lies behind a chain is put together once for all its
    steps, and a step's rows are made beside its chain: they are not shuffled.
    """
    chains = _chains(manifests)
    paths = _paths(_led(chains))
    seen = F.concat(F.array("chain"), F.transform("path", lambda x: x.chain))
    last = F.size("path")
    told = paths.withColumn("seen", seen).withColumn("at", F.when(F.col("closed"), F.array_position("seen", F.element_at("seen", -1)).cast("int") - 1))
    # A path that comes back to a chain takes what it has not passed of it: above its own place there.
    low = lambda i: F.when(F.col("closed") & (i + 1 == last) & (F.col("at") > 0), F.get("path", F.col("at") - 1).upto).otherwise(F.lit(0))
    pieces = F.transform("path", lambda x, i: F.struct((i + 1).alias("i"), x.chain.alias("of"), low(i).alias("low"), x.upto.alias("upto")))
    other = F.filter(pieces, lambda x: (x.upto > x.low) & ~(F.col("closed") & (x.i == last) & (F.col("at") == 0)))
    part = lambda members, low, upto: F.reverse(F.slice(members, low + 1, upto - low))
    rows = told.select("chain", F.explode(other).alias("p")).select("chain", "p.*")
    found = rows.join(chains.select(F.col("chain").alias("of"), "members"), "of").select("chain", F.struct("i", part(F.col("members"), F.col("low"), F.col("upto")).alias("part")).alias("p"))
    above = found.groupBy("chain").agg(F.flatten(F.transform(F.sort_array(F.collect_list("p")), lambda p: p.part)).alias("above"))
    ends = told.select("chain", "closed", F.when(F.col("closed") & (F.col("at") == 0), F.element_at("path", -1).upto).alias("round"))
    kind = dict(chains.dtypes)["members"]
    own = chains.join(ends, "chain", "left").join(above, "chain", "left").withColumn("above", F.coalesce("above", F.array().cast(kind)))
    own = own.select("members", "above", "won", "round", F.coalesce("closed", F.lit(False)).alias("circular"), F.explode("members").alias("m"))
    pos = F.col("m.pos")
    rest = F.when(F.col("round") > pos, part(F.col("members"), pos, F.col("round"))).otherwise(F.array().cast(kind))
    way = own.select("won", "circular", "m", F.concat(part(F.col("members"), F.lit(0), pos), "above", rest).alias("way"))
    # Whose output another entry wrote first may come to that file: it has been passed.
    again = F.array_position(F.transform(F.slice("way", 2, F.size("way")), lambda x: x.file), F.col("m.file")).cast("int")
    way = way.withColumn("way", F.when(~F.col("won") & (again > 0), F.slice("way", F.lit(1), again)).otherwise(F.col("way")))
    out = way.select("m.run", "m.step", "circular", F.posexplode("way").alias("depth", "b"))
    return out.select("run", "step", "depth", F.col("b.run").alias("from_run"), F.col("b.step").alias("from_step"), F.col("b.file").alias("output"), "circular")


def behind(manifests: DataFrame, run: str, step: int) -> DataFrame:
    """depth, run, step, output of a step (depth 0) and of every step behind it, each once."""
    own = manifests.where((F.col("run") == run) & (F.col("step") == step)).select(F.col("input").alias("file"))
    writers = _writers(manifests)
    found = own.join(writers.select("file"), "file", "left_semi").select("file", F.lit(1).cast("long").alias("depth"))
    for k, jumps in enumerate(_jumps(manifests)):
        further = found.join(jumps, "file").select(F.col("back").alias("file"), (F.col("depth") + (1 << k)).alias("depth"))
        found = shared.settled(found.unionByName(further).groupBy("file").agg(F.min("depth").alias("depth")))
    rows = found.join(writers, "file").select("depth", "run", "step", F.col("file").alias("output"))
    first = manifests.where((F.col("run") == run) & (F.col("step") == step)).select(F.lit(0).cast("long").alias("depth"), "run", "step", "output")
    again = first.select("output")
    return first.unionByName(rows.join(again, "output", "left_anti").select(first.columns))


def producers(stages: DataFrame, manifests: DataFrame) -> DataFrame:
    """Stage files (output) with the run and step that a manifest says wrote them."""
    first = F.row_number().over(Window.partitionBy("output").orderBy("run", "step"))
    own = manifests.withColumn("k", first).where("k = 1").select("output", F.col("run").alias("by_run"), F.col("step").alias("by_step"))
    return stages.join(own, "output", "left")


def changed_prompts(now: DataFrame, manifests: DataFrame) -> DataFrame:
    """run, step of steps (run, step, prompt_sha1) whose prompt differs from the one recorded."""
    old = manifests.select("run", "step", F.col("prompt_sha1").alias("was"))
    return now.join(old, ["run", "step"]).where("was is not null and was <> prompt_sha1").select("run", "step")


def slots(requests: DataFrame, spacing: float, at: str = "at", order: tuple[str, ...] = ("at",), within: tuple[str, ...] = ()) -> DataFrame:
    """When each request may start, if starts are ``spacing`` apart.

    slot_i = max(at_i, slot_(i-1) + spacing) unrolls to i * spacing + the running maximum of
    at_j - j * spacing, so a window does it; one over all requests goes by ranges of the order.
    """
    if within:
        numbered = requests.withColumn("i", F.row_number().over(Window.partitionBy(*within).orderBy(*order)).cast("long"))
        free = F.max(F.col(at) - F.col("i") * spacing).over(Window.partitionBy(*within).orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        return numbered.withColumn("slot", F.col("i") * spacing + free)
    numbered = ordered.numbered(requests, order, "i")
    out = ordered.running_max(numbered, F.col(at) - F.col("i") * spacing, "i", "slot")
    return out.withColumn("slot", F.col("i") * spacing + F.col("slot"))


def current_dump(entries: DataFrame, stage: DataFrame) -> DataFrame:
    """Recorded entries (volume, entry, text) whose text is still the stage's: the others are stale."""
    own = stage.select("volume", "entry", F.sha2("text", 256).alias("h"), F.col("text").alias("now"))
    both = entries.withColumn("h", F.sha2("text", 256)).join(own, ["volume", "entry", "h"])
    return both.where(F.col("text") == F.col("now")).drop("h", "now")
