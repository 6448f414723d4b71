"""Per-entity sequences: windows where a frame says it, sorted streams with one state where state is carried. Null means not detected.

Input columns: key, i (position, from 0 without gaps) and x (nullable double), or the names given. Smoothing resets at every
null, so runs without nulls are dealt apart.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .durable import cut

TWO_PI = 2 * math.pi
HOLD = 8


def _order(key="key"):
    return W.partitionBy(key).orderBy("i")


def before(c: Column, key="key") -> Column:
    """Last non-null value up to and with this row."""
    return F.last(c, ignorenulls=True).over(_order(key).rowsBetween(W.unboundedPreceding, 0))


def after(c: Column, key="key") -> Column:
    """First non-null value strictly after this row."""
    return F.first(c, ignorenulls=True).over(_order(key).rowsBetween(1, W.unboundedFollowing))


#: Rows of a key from which on its ranges are walked by several tasks.
HOT_ROWS = 1 << 20


def scan(d: DataFrame, by: list[str], order: list[str], out: str, start: Callable, step: Callable, hot_rows: int | None = None) -> DataFrame:
    """The by columns and the columns of the DDL `out`: a state carried along the rows of each group, in order.

    step(state, row) gives (state, values of out) or (state, None) for no row. Groups are dealt, sorted and read as a
    stream, so a task holds one state and a batch of rows. Groups of hot_rows rows or more are cut into ranges, see
    scan_ranges().
    """
    most = HOT_ROWS if hot_rows is None else hot_rows
    schema, walk = _walker(d, by, out, start, step)
    # dealt by a value of its own: Spark leaves out a repartition by columns that a union or a join below claims to be dealt
    # by already, and then reads the sides of that union in partitions of different sizes, or cuts those of that join
    dealt = lambda x: x.repartition(F.xxhash64(*by)).sortWithinPartitions(*by, *order)
    few = dealt(d).mapInArrow(lambda it: walk(it, None), schema)
    hot = d.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(*by)
    if hot.isEmpty():
        return few
    hot = cut(hot)
    cold = dealt(d.join(hot, by, "left_anti")).mapInArrow(lambda it: walk(it, None), schema)
    return cold.unionByName(scan_ranges(d.join(hot, by, "left_semi"), by, order, out, start, step))


class _Row:
    """One row of a batch of columns; `at` is its place."""

    __slots__ = ("columns", "at")

    def __init__(self, columns: dict[str, list]):
        self.columns, self.at = columns, 0

    def __getitem__(self, name: str):
        return self.columns[name][self.at]


def _walker(d: DataFrame, by: list[str], out: str, start: Callable, step: Callable):
    """The result's schema, and walk(batches, first state, ends): the rows as batches; ends gets (first key, last key, last
    state, whether there was one key only)."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    fields = T.StructType.fromDDL(out).fields
    schema = T.StructType([*[d.schema[c] for c in by], *fields])
    arrow = to_arrow_schema(schema)

    def walk(it, first, ends=None):
        open_, state, head, one = None, None, None, True
        for batch in it:
            columns = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            row, keys, values = _Row(columns), [], []
            for row.at, key in enumerate(zip(*[columns[c] for c in by], strict=True)):
                if key != open_:
                    one = open_ is None
                    state = first[0] if one and first is not None else start()
                    head, open_ = key if one else head, key
                state, y = step(state, row)
                if y is not None and ends is None:
                    keys.append(key)
                    values.append(y)
            if keys:
                done = [*zip(*keys, strict=True), *zip(*values, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(done, arrow, strict=True)], schema=arrow)
        if ends is not None and open_ is not None:
            ends.append((head, open_, state, one))

    return schema, walk


def scan_ranges(d: DataFrame, by: list[str], order: list[str], out: str, start: Callable, step: Callable, rounds: list | None = None) -> DataFrame:
    """scan() with the rows in ranges of equal size, however many of them are one group's, and with the very same values.

    A range needs the state in which the range before it ends. Every range is walked from the start state; of those that
    go on with a group, the driver then follows the chain of states as far as it is known, and asks for the ranges at which
    it is not: from the state reached, and for the ranges behind also from the states that it takes to be theirs, the
    one reached and the one in which the range before ended last. States that forget (averages, holds, debounced jumps) or
    seldom change (matchers, plans) agree after two or three rounds; at worst every round settles one more range. Then one
    pass gives the rows. The driver holds a few states a range. `rounds` gets the number of ranges walked in each round.
    """
    schema, walk = _walker(d, by, out, start, step)
    n = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a stated number is not coalesced
    ranged = cut(d.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id()))

    def number(it):
        """The range's number, and its batches; none for a range without rows."""
        it = iter(it)
        head = next((b for b in it if b.num_rows), None)
        return (None, ()) if head is None else (head.column("_range")[0].as_py(), itertools.chain([head], it))

    def ask(wanted: dict[int, list]) -> dict[tuple[int, bytes], tuple]:
        held = d.sparkSession.sparkContext.broadcast(wanted)

        def run(it):
            import pyarrow as pa

            p, batches = number(it)
            todo = [] if p is None else held.value.get(p, []) if held.value else [None]
            batches = list(batches) if len(todo) > 1 else batches  # one range of bounded size, walked from several states
            found = []
            for first in todo:
                ends: list = []
                for _ in walk(iter(batches), None if first is None else (pickle.loads(first),), ends):
                    pass
                found += [(p, first or b"", pickle.dumps(e)) for e in ends]
            yield pa.RecordBatch.from_pydict({"p": pa.array([f[0] for f in found], pa.int32()), "first": pa.array([f[1] for f in found], pa.binary()), "ends": pa.array([f[2] for f in found], pa.binary())})

        got = ranged.mapInArrow(run, "p int, first binary, ends binary").collect()
        return {(r.p, bytes(r.first)): pickle.loads(r.ends) for r in got}

    known = ask({})  # by range and first state, empty for the start state
    if rounds is not None:
        rounds.append(len(known))
    parts = sorted(p for p, _ in known)
    goes_on = {q: known[p, b""][1] == known[q, b""][0] for p, q in zip(parts, parts[1:], strict=False)}
    while True:
        firsts: dict[int, bytes] = {}
        wanted: dict[int, set] = {}
        before, guess = None, b""  # how the range before ended, if that is settled; else the state taken for it
        for k, p in enumerate(parts):
            alone = known[p, b""][3]  # a range with several groups ends as it does from the start state
            if not goes_on.get(p):
                firsts[p], before = b"", known[p, b""]
                continue
            if before is not None:
                guess = firsts[p] = pickle.dumps(before[2])
                before = known.get((p, guess))
                wanted[p] = {guess} if before is None and alone else set()
            elif alone:  # behind an open range of the same group
                last = next(known[x] for x in reversed(known) if x[0] == parts[k - 1])
                wanted[p] = {x for x in (guess, pickle.dumps(last[2])) if (p, x) not in known}
            if not alone:
                before = known[p, b""]
        wanted = {p: x for p, x in wanted.items() if x}
        if not wanted:
            break
        if rounds is not None:
            rounds.append(len(wanted))
        known |= ask({p: sorted(x) for p, x in wanted.items()})
    held = d.sparkSession.sparkContext.broadcast(firsts)

    def replay(it):
        p, batches = number(it)
        first = held.value.get(p, b"")
        yield from walk(batches, (pickle.loads(first),) if first else None)

    return ranged.mapInArrow(replay, schema)


def scan_runs(s: DataFrame, value: str, kind: str, start: Callable, step: Callable, key: str = "key") -> DataFrame:
    """key, i, y (of type kind): scan() over the runs without nulls of a value; where it is null, y is null."""
    run = F.count_if(F.col("_v").isNull()).over(_order(key).rowsBetween(W.unboundedPreceding, 0))
    d = s.select(key, "i", F.col(value).alias("_v")).withColumn("_run", run)
    at = s.schema["i"].dataType.simpleString()

    def one(state, r):
        state, y = step(state, r["_v"])
        return state, (r["i"], y)

    found = scan(d.where("_v is not null"), [key, "_run"], ["i"], f"i {at}, y {kind}", start, one).select(key, "i", "y")
    return found.unionByName(d.where("_v is null").select(key, "i", F.lit(None).cast(kind).alias("y")))


def ema(s: DataFrame, alpha: float = 0.25, key="key") -> DataFrame:
    """Exponential average that starts anew after a null."""

    def step(y, x):
        y = x if y is None else y * (1 - alpha) + x * alpha
        return y, y

    return scan_runs(s, "x", "double", lambda: None, step, key)


def _alpha(cutoff: float, dt: float) -> float:
    return 1.0 / (1.0 + (1.0 / (TWO_PI * cutoff)) / dt)


def one_euro(s: DataFrame, fps: float = 25.0, min_cutoff: float = 1.0, beta: float = 0.3, d_cutoff: float = 1.0, key="key") -> DataFrame:
    """Speed-adaptive low-pass filter; state is the last raw value, the filtered value and the filtered speed."""
    dt = 1.0 / fps
    steady = _alpha(d_cutoff, dt)

    def step(state, x):
        if state is None:
            return (x, x, 0.0), x
        last, y, d = state
        d = steady * ((x - last) / dt) + (1 - steady) * d
        a = _alpha(min_cutoff + beta * abs(d), dt)
        y = a * x + (1 - a) * y
        return (x, y, d), y

    return scan_runs(s, "x", "double", lambda: None, step, key)


def denoise(s: DataFrame, min_run: int = 4, min_gap: int = 8, key="key") -> DataFrame:
    """Null out runs shorter than min_run with gaps of min_gap or more on both sides; the ends of the series are big gaps."""
    run = F.sum(F.col("x").isNull().cast("int")).over(_order(key).rowsBetween(W.unboundedPreceding, 0))
    d = s.withColumn("run", run)
    span = d.where("x is not null").groupBy(key, "run").agg(F.min("i").alias("a"), (F.max("i") + 1).alias("b"))
    w = W.partitionBy(key).orderBy("a")
    left, right = F.col("a") - F.lag("b").over(w), F.lead("a").over(w) - F.col("b")
    blips = span.withColumn("blip", (F.col("b") - F.col("a") < min_run) & (F.coalesce(left, F.lit(min_gap)) >= min_gap) & (F.coalesce(right, F.lit(min_gap)) >= min_gap))
    return d.join(blips.select(key, "run", "blip"), [key, "run"], "left").select(key, "i", F.when(~F.col("blip"), F.col("x")).alias("y"))


def next_nonnull(s: DataFrame, key="key") -> DataFrame:
    at = F.when(F.col("x").isNotNull(), F.struct("i", "x"))
    return s.select(key, "i", after(at, key).alias("n")).select(key, "i", F.col("n.i").alias("next_i"), F.col("n.x").alias("next_x"))


def _bracket(s: DataFrame, key: str) -> DataFrame:
    at = F.when(F.col("x").isNotNull(), F.struct("i", "x"))
    d = s.select(key, "i", "x", before(at, key).alias("l"), after(at, key).alias("n"))
    return d.withColumn("t", F.when(F.col("l").isNotNull() & F.col("n").isNotNull(), (F.col("i") - F.col("l.i")) / (F.col("n.i") - F.col("l.i"))))


def gap_bridge(s: DataFrame, hold: int = HOLD, key="key") -> DataFrame:
    """Bridge gaps of at most hold frames: fade in before the first value, glide between, fade out after the last."""
    d = _bracket(s, key)
    gap, lead = F.col("i") - F.col("l.i"), F.col("n.i") - F.col("i")
    l, n, t = F.col("l.x"), F.col("n.x"), F.col("t")
    glide = l + ((l * (1 - t) + n * t) - l)
    inside = F.col("l").isNotNull() & (gap <= hold)
    y = F.when(F.col("x").isNotNull(), F.col("x")).when(F.col("l").isNull() & (lead <= hold), n).when(inside & F.col("n").isNotNull(), glide).when(inside, l)
    alpha = F.when(F.col("x").isNotNull(), 1.0).when(F.col("l").isNull() & (lead <= hold), 1.0 - lead / float(hold)).when(inside & F.col("n").isNotNull(), 1.0).when(inside, 1.0 - gap / float(hold)).otherwise(0.0)
    return d.select(key, "i", y.alias("y"), alpha.alias("alpha"))


def gap_fill(s: DataFrame, key="key") -> DataFrame:
    """Fill every gap: hold the first and last value at the ends, straight lines between."""
    d = _bracket(s, key)
    l, n = F.col("l.x"), F.col("n.x")
    return d.select(key, "i", F.coalesce("x", l + (n - l) * F.col("t"), n, l).alias("y"))


def upsample(s: DataFrame, factor: int = 2, key="key") -> DataFrame:
    """factor rows per step; values in between on a straight line, held next to nulls."""
    d = s.select(key, "i", "x", F.lead("x").over(_order(key)).alias("n"), F.lead("i").over(_order(key)).isNull().alias("end"))
    d = d.withColumn("k", F.explode(F.sequence(F.lit(0), F.when(F.col("end"), 0).otherwise(factor - 1))))
    t = F.col("k") / float(factor)
    return d.select(key, "i", "k", F.when((F.col("k") == 0) | F.col("x").isNull() | F.col("n").isNull(), F.col("x")).otherwise(F.col("x") * (1 - t) + F.col("n") * t).alias("y"))


def dilate(s: DataFrame, flag: Column, around: int = 3, key="key") -> DataFrame:
    d = s.withColumn("flag", flag)
    near = F.max("flag").over(_order(key).rowsBetween(-around, around))
    return d.select(key, "i", F.when(F.col("flag").isNotNull(), F.coalesce(near, F.lit(False))).alias("flag"))


def hold_last(s: DataFrame, hidden: Column, key="key") -> DataFrame:
    """On hidden frames the last good value; nulls stay null and do not clear it."""
    good = F.when(F.col("x").isNotNull() & ~hidden, F.col("x"))
    return s.withColumn("g", before(good, key)).select(key, "i", F.when(F.col("x").isNotNull(), F.when(hidden, F.col("g")).otherwise(F.col("x"))).alias("y"))


def trajectory(s: DataFrame, fps: float = 25.0, key="key") -> DataFrame:
    """Speed, direction and displacement from the previous detected sample; needs x and y."""
    d = s.where("x is not null")
    d = d.withColumn("dx", F.col("x") - F.lag("x").over(_order(key))).withColumn("dy", F.col("y") - F.lag("y").over(_order(key))).where("dx is not null")
    norm = F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy"))
    return d.select(key, "i", "dx", "dy", (norm / (1.0 / fps)).alias("speed"), F.when(norm > 1e-6, F.degrees(F.atan2("dy", "dx"))).alias("direction"), (norm / (1.0 / fps) < 15.0).alias("is_hold"))


def active_window(s: DataFrame, hit: Column, pad: int = 6, fps: float = 25.0, key="key") -> DataFrame:
    """First and last hit, padded and clamped, in seconds."""
    d = s.groupBy(key).agg(F.min(F.when(hit, F.col("i"))).alias("a"), F.max(F.when(hit, F.col("i"))).alias("b"), F.max("i").alias("n")).where("a is not null")
    return d.select(key, (F.greatest(F.lit(0), F.col("a") - pad) / fps).alias("start_s"), (F.least(F.col("n"), F.col("b") + pad) / fps).alias("end_s"))


def state_changes(s: DataFrame, step_s: float = 0.1, threshold: float = 12.0, min_state: float = 0.6, shortest: float = 0.35, key="key") -> DataFrame:
    """Segments between debounced jumps of x."""
    jump = F.abs(F.col("x") - F.lag("x").over(_order(key)))
    jumps = s.withColumn("t", F.col("i") * step_s).withColumn("jump", jump).where((F.col("i") > 0) & (F.col("jump") > threshold)).select(key, "t")

    def step(last, r):
        return (r["t"], (r["t"],)) if r["t"] - last >= min_state else (last, None)

    ends = s.groupBy(key).agg((F.count(F.lit(1)) * step_s).alias("duration")).select(key, F.explode(F.array(F.lit(0.0), "duration")).alias("s"))
    b = scan(jumps, [key], ["t"], "s double", lambda: 0.0, step).unionByName(ends)
    return b.withColumn("e", F.lead("s").over(W.partitionBy(key).orderBy("s"))).where(F.col("e") - F.col("s") >= shortest)


def unit_seconds(n: Column, clip: str = "2.27", overlap: str = "0.16") -> Column:
    """n clips one after the other with overlaps, exact to the cent."""
    d = lambda v: F.lit(v).cast("decimal(10,2)")
    return F.when(n == 0, d("0.00")).otherwise((n * d(clip) - F.greatest(F.lit(0), n - 1) * d(overlap)).cast("decimal(18,2)"))


def duration_plan(units: DataFrame, budget: str, key="key") -> DataFrame:
    """included per unit: the first always, later ones if they still fit; one dropped does not end the plan."""
    limit = Decimal(budget)

    def step(state, r):
        run, first = state
        ok = first or run + r["dur"] <= limit
        return (run + r["dur"] if ok else run, False), (r["i"], r["dur"], ok)

    kinds = {c: units.schema[c].dataType.simpleString() for c in ("i", "dur")}
    return scan(units.select(key, "i", "dur"), [key], ["i"], f"i {kinds['i']}, dur {kinds['dur']}, included boolean", lambda: (Decimal(0), True), step)


def selected_then_dropped(plan: DataFrame, key="key") -> DataFrame:
    """plan with its new position: the included units in order, then the others in order."""
    return plan.withColumn("place", F.row_number().over(W.partitionBy(key).orderBy(F.desc("included"), "i")) - 1)


def crossfade_offsets(s: DataFrame, overlap: str = "0.16", key="key") -> DataFrame:
    total = F.coalesce(F.sum("dur").over(_order(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("decimal(18,2)"))
    return s.select(key, "i", (total - F.lit(overlap).cast("decimal(10,2)") * F.col("i")).cast("double").alias("offset_s"))


def global_number(df: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """Position of every row in one global order, from 0, without a single-task window: ranges are sorted on their own and
    shifted by the counts of the ranges before them (one count per range reaches the driver). Each run of a plan cuts ranges
    by another sample, so counts and rows are read from one run's."""
    spark = df.sparkSession
    sorted_ = cut(df.repartitionByRange(*[F.col(c) for c in order]).withColumn("_p", F.spark_partition_id()))
    counts = {r["_p"]: r["n"] for r in sorted_.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, at = [], 0
    for p in sorted(counts):
        shift.append((p, at))
        at += counts[p]
    offsets = spark.createDataFrame(shift, "_p int, _shift long")
    within = F.row_number().over(W.partitionBy("_p").orderBy(*order)) - 1
    return sorted_.withColumn("_k", within).join(F.broadcast(offsets), "_p").withColumn(name, (F.col("_k") + F.col("_shift")).cast("long")).drop("_p", "_k", "_shift")


def run_length(s: DataFrame, value: str, key="key") -> DataFrame:
    """Consecutive rows with one value as one row: value, count, first position."""
    change = (~F.col(value).eqNullSafe(F.lag(value).over(_order(key)))) | (F.col("i") == 0)
    d = s.withColumn("_run", F.sum(change.cast("int")).over(_order(key).rowsBetween(W.unboundedPreceding, 0)))
    return d.groupBy(key, "_run").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first_i"), F.min_by(value, "i").alias(value)).drop("_run")


def align_labels(samples: DataFrame, labels: DataFrame, key="key") -> DataFrame:
    """key, i, pos: per sample in order the first label, at or after the current one, that its text contains.

    samples: key, i, text; labels: key, pos, label. The current label moves forward only. A task holds the labels of one
    key, which come before its samples; keys without labels give no rows.
    """
    l = labels.select(key, F.lit(0).alias("_k"), F.col("pos").cast("long").alias("_at"), F.col("label").alias("_text"))
    s = samples.select(key, F.lit(1).alias("_k"), F.col("i").cast("long").alias("_at"), F.col("text").alias("_text"))
    at = samples.schema["i"].dataType.simpleString()

    def step(state, r):
        known, current = state
        if r["_k"] == 0:
            known.append((r["_at"], r["_text"]))
            return (known, current), None
        hit = next((p for p, t in known if p >= current and t and t in r["_text"]), None) if r["_text"] is not None else None
        return (known, current if hit is None else hit), (r["_at"], hit) if known else None

    return scan(l.unionByName(s), [key], ["_k", "_at"], f"i {at}, pos int", lambda: ([], 0), step)


def label_intervals(aligned: DataFrame, step_s: float, key="key") -> DataFrame:
    """key, pos, start_s, end_s: first and last time at which each label was matched."""
    t = F.bround(F.col("i") * step_s, 1)
    return aligned.where("pos is not null").groupBy(key, "pos").agg(F.min(t).alias("start_s"), F.max(t).alias("end_s"))


def interval_gate(items: DataFrame, key="key") -> DataFrame:
    """Verdict per key over items (pos, start_s, end_s, all nullable but pos): all matched and sane, partly matched, or unreliable."""
    w = W.partitionBy(key).orderBy("pos")
    m = items.where("start_s is not null").withColumn("next", F.lead("start_s").over(w))
    sane = F.coalesce(F.col("end_s") >= F.col("start_s"), F.lit(False)) & (F.col("next").isNull() | F.coalesce(F.col("end_s") <= F.col("next") + 0.01, F.lit(False)))
    per = m.groupBy(key).agg(F.count(F.lit(1)).alias("n_matched"), F.every(F.col("next").isNull() | (F.col("start_s") <= F.col("next"))).alias("mono"), F.every(sane).alias("sane"), F.count_distinct("start_s").alias("starts"))
    n = items.groupBy(key).agg(F.count(F.lit(1)).alias("n_expected")).join(per, key, "left").withColumn("n_matched", F.coalesce("n_matched", F.lit(0)))
    good = F.col("mono") & F.col("sane") & (F.col("starts") == F.col("n_matched"))
    verdict = F.when(F.col("n_matched") == 0, "REJECT").when(good & (F.col("n_matched") == F.col("n_expected")), "AUTO_ACCEPT").when(~good, "REJECT").otherwise("REVIEW_REQUIRED")
    return n.select(key, "n_expected", "n_matched", verdict.alias("verdict"))


def gate_summary(verdicts: DataFrame, key="key") -> DataFrame:
    """verdict, n, members (struct of key, n_expected, n_matched, by key)."""
    return verdicts.groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(key, "n_expected", "n_matched"))).alias("members"))
