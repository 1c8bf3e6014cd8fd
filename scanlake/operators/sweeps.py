"""Focus sweeps: rows (sweep_id, i, z_mm, metric), with i the gapless visiting index of a sweep."""

from __future__ import annotations

import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanlake.operators import ordered
from scanlake.operators.ordered import INDEX_SLICE, SLICE
from scanlake.session import cut_lineage

KEY = "sweep_id"
# Fixed value: the noise floor is this many times the median small step.
NOISE_FACTOR = 5.0


def clean_sweep(sweep: DataFrame, size: int = INDEX_SLICE) -> DataFrame:
    """Drop steps without a metric and close the gaps they leave in the index."""
    kept = sweep.where(F.col("metric").isNotNull()).withColumnRenamed("i", "_was")
    out = ordered.dense_index(kept, [KEY], ["_was"], ordered.index_slice(F.col("_was"), size))
    return out.select(*sweep.columns)


def half_window(trend_n: int) -> int:
    return max(2, max(4, trend_n) // 2)


def metric_delta(sweep: DataFrame, size: int = INDEX_SLICE) -> DataFrame:
    """Add ``delta``, the metric minus the one before."""
    w = ordered.halo_window([KEY], "i")
    rows = ordered.with_halo(sweep, "i", 1, size)
    return ordered.drop_halo(rows.withColumn("delta", F.col("metric") - F.lag("metric").over(w)))


def smoothed_delta(sweep: DataFrame, trend_n: int = 10, size: int = INDEX_SLICE, keep_slice: bool = False) -> DataFrame:
    """Add ``delta`` and ``smoothed``, the mean of the last few deltas.

    The mean of consecutive deltas is the metric's change over them divided by their number, which needs one look back
    and gives an exact zero where the metric returns to its old value.
    """
    half = half_window(trend_n)
    w = ordered.halo_window([KEY], "i")
    rows = ordered.with_halo(sweep, "i", half, size)
    span = F.least(F.col("i"), F.lit(half))
    start = F.when(F.col("i") < half, F.first("metric").over(w)).otherwise(F.lag("metric", half).over(w))
    rows = rows.withColumn("delta", F.col("metric") - F.lag("metric").over(w))
    rows = rows.withColumn("smoothed", F.when(span > 0, (F.col("metric") - start) / span))
    return ordered.drop_halo(rows, keep_slice)


def _median_of_lower_half(values: Column) -> Column:
    """Median of the smaller half of a short array."""
    ordered_values = F.sort_array(values)
    half = F.greatest(F.lit(1), F.floor(F.size(values) / 2).cast("int"))
    upper = F.get(ordered_values, F.floor(half / 2).cast("int"))
    lower = F.get(ordered_values, F.floor((half - 1) / 2).cast("int"))
    return (lower + upper) / 2.0


def noise_floor_from(abs_deltas) -> float:
    """``noise_floor_of`` for numbers at hand."""
    small = sorted(float(d) for d in abs_deltas)[: max(1, len(abs_deltas) // 2)]
    return statistics.median(small) * NOISE_FACTOR if len(abs_deltas) >= 3 else 0.0


def noise_floor_of(abs_deltas: Column) -> Column:
    """Noise floor of an array of absolute deltas, 0 for fewer than three."""
    return F.when(F.size(abs_deltas) >= 3, _median_of_lower_half(abs_deltas) * NOISE_FACTOR).otherwise(F.lit(0.0))


def _at() -> Column:
    return F.struct(F.col("i").cast("long").alias("i"), F.col("z_mm").alias("z"))


def _steps(head: Column, trend_n: int) -> Column:
    """The steps behind the first one of a short array (i, z_mm, metric), with delta and smoothed delta."""
    half = half_window(trend_n)

    def metric_at(k: Column) -> Column:
        return F.get(head, k)["metric"]

    def step(e: Column, k: Column) -> Column:
        span = F.least(F.lit(half), k + 1)
        return F.struct(
            e["i"].alias("i"), e["z_mm"].alias("z_mm"), e["metric"].alias("metric"),
            (e["metric"] - metric_at(k)).alias("delta"), ((e["metric"] - metric_at(k + 1 - span)) / span).alias("smoothed"),
        )

    return F.transform(F.slice(head, 2, max(4, trend_n)), step)


def noise_floor(sweep: DataFrame, trend_n: int = 10, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Noise floor of each sweep from its first ``trend_n`` steps."""
    first = F.when(F.col("i") <= max(4, trend_n), F.struct("i", "z_mm", "metric"))
    heads = sweep.groupBy(*keys).agg(F.sort_array(F.collect_list(first)).alias("head"))
    return heads.select(*keys, noise_floor_of(F.transform(_steps(F.col("head"), trend_n), lambda e: F.abs(e["delta"]))).alias("noise_floor"))


def _first_phase(rows: DataFrame, trend_n: int, turns: bool) -> DataFrame:
    """Add ``phase`` (noise_floor, was_up, early) to rows that have ``head``, the first steps of their sweep; null where that is null."""
    if turns:  # only the steps before the first turn
        ways = F.transform("head", lambda e, k: F.signum(e["z_mm"] - F.get("head", k - 1)["z_mm"]))
        rows = rows.withColumn("_ways", F.when(F.size("head") > 2, ways))
        after = F.filter(F.transform("_ways", lambda w, k: F.when((k > 1) & (w != F.get("_ways", k - 1)), k)), lambda k: k.isNotNull())
        rows = rows.withColumn("head", F.slice("head", 1, F.coalesce(F.array_min(after), F.size("head")))).drop("_ways")
    rows = rows.withColumn("_steps", _steps(F.col("head"), trend_n))
    rows = rows.withColumn("_up", F.array_min(F.transform(F.filter("_steps", lambda e: e["smoothed"] > 0), lambda e: e["i"])))
    falls = F.filter("_steps", lambda e: (e["smoothed"] < 0) & (e["i"] > F.col("_up")))
    early = F.array_min(F.transform(falls, lambda e: F.struct(e["i"].cast("long").alias("i"), e["z_mm"].alias("z"))))
    floor = noise_floor_of(F.transform("_steps", lambda e: F.abs(e["delta"])))
    rise = F.array_max(F.transform("_steps", lambda e: e["metric"])) - F.get("head", F.lit(0))["metric"]
    rows = rows.withColumns({"_early": early, "_floor": floor, "_rise": rise})
    lost = (F.col("_floor") > 0) & F.col("_early").isNull() & (F.col("_rise") <= F.col("_floor"))
    up = F.col("_up").isNotNull() & ~F.coalesce(lost, F.lit(False))
    phase = F.struct(F.col("_floor").alias("noise_floor"), up.alias("was_up"), F.col("_early").alias("early"))
    return rows.withColumn("phase", F.when(F.col("head").isNotNull(), phase)).drop("head", "_steps", "_up", "_early", "_floor", "_rise")


def _with_length(sweep: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``sweep`` with ``n``, the number of its steps; a table that has it already (``dense_index``) needs no pass of its own."""
    if "n" in sweep.columns:
        return sweep
    per = sweep.groupBy(*keys).agg((F.max("i") + 1).alias("n"), F.max("i").alias("_last"))
    return ordered.attach(sweep.withColumn(SLICE, ordered.index_slice(F.col("i"), size)), per, keys, "_last", size).drop(SLICE, "_last")


def _pieces(sweep: DataFrame, trend_n: int, size: int, keys: list[str], turns: bool, fresh: bool) -> DataFrame:
    """What a search needs to know of each piece: the steps of one slice between two turns (all steps of the slice without ``turns``).

    One row per (keys, slice, seg): steps, start_i, end, phase, and for the two ways to judge the piece (as the rest of a search with a
    first phase, or fresh) whether it rises, its first falling step, and its first falling step behind a rise of its own. One exchange: a
    slice gets copies of the last steps before it and of the sweep's first steps.
    """
    first, half = max(4, trend_n), half_window(trend_n)
    back = half + 2
    if back > size:
        raise ValueError("the frame is longer than a slice")
    rows = _with_length(sweep, keys, size).select(*keys, F.col("i").cast("long").alias("i"), "z_mm", "metric", "n")
    own, last = ordered.index_slice(F.col("i"), size), ordered.index_slice(F.col("n") - 1, size)

    def home(slice_no: Column, kind: int) -> Column:
        return F.struct(slice_no.cast("long").alias("s"), F.lit(kind).alias("kind"))

    none = F.array().cast("array<struct<s:bigint,kind:int>>")
    halo = F.when((F.pmod(F.col("i"), F.lit(size)) >= size - back) & (own < last), F.array(home(own + 1, 1))).otherwise(none)
    others = F.filter(F.sequence(F.lit(0).cast("long"), last), lambda s: s != own)
    heads = F.when((F.col("i") <= first) & (last > 0), F.transform(others, lambda s: home(s, 2))).otherwise(none) if not fresh else none
    rows = rows.withColumn("_h", F.explode(F.concat(F.array(home(own, 0)), halo, heads))).withColumns({SLICE: F.col("_h.s"), "_kind": F.col("_h.kind")}).drop("_h", "n")
    rows = rows.withColumn("_far", F.col("_kind") == 2)

    # one sort serves all windows, as those over ``line`` come first; the sweep's first steps of other slices stand behind the slice's own rows
    whole = Window.partitionBy(*keys, SLICE)
    line = whole.orderBy("_far", "i")
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    upto = line.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = F.lit(False)
    if turns:
        rows = rows.withColumn("_way", F.signum(F.col("z_mm") - F.lag("z_mm").over(line)))
        turn = F.coalesce(F.col("_way") != F.lag("_way").over(line), F.lit(False))
    rows = rows.withColumn("_turn", turn)
    rows = rows.withColumns({
        "_since": F.max(F.when(F.col("_turn"), F.col("i"))).over(upto), "_first": F.last(F.when(F.col("_turn"), F.col("metric")), ignorenulls=True).over(upto),
        "_was": F.lag("metric").over(line), "_back": F.lag("metric", half).over(line), "_zero": F.first("metric").over(upto),
    })
    if turns:
        rows = rows.withColumn("seg", F.sum(F.when(F.col("_turn") & (F.col("_kind") == 0), 1).otherwise(0)).over(upto))
    rows = rows.withColumn("head", F.collect_list(F.when((F.col("_kind") != 1) & (F.col("i") <= first), F.struct("i", "z_mm", "metric"))).over(whole))
    # the first row of a slice works the first phase out for all of them
    rows = rows.withColumn("head", F.when(F.row_number().over(line) == 1, F.sort_array("head")))
    rows = _first_phase(rows, trend_n, turns).withColumn("phase", F.first("phase", ignorenulls=True).over(whole))
    # without a turn among the copied steps the piece is longer than the window, or begins the sweep
    start = F.coalesce("_since", F.when(F.col(SLICE) == 0, F.lit(0).cast("long")))
    span = F.least(F.coalesce(F.col("i") - start, F.lit(half)), F.lit(half))
    then = F.when(span == half, F.col("_back")).otherwise(F.coalesce("_first", "_zero"))
    rows = rows.withColumns({"_delta": F.when(span > 0, F.col("metric") - F.col("_was")), "_smooth": F.when(span > 0, (F.col("metric") - then) / span)})
    begin = F.greatest(F.coalesce("_since", F.lit(0).cast("long")), F.col(SLICE) * size)
    floors = {"a": F.col("phase.noise_floor"), "b": F.lit(0.0)}
    ways = "ab" if turns else "b" if fresh else "a"
    rises = {w: F.coalesce(F.col("_smooth") > floors[w], F.lit(False)) & (F.col("i") > (first if w == "a" else 0)) for w in ways}
    rows = rows.withColumns({f"_r{w}": rises[w] for w in ways})
    rows = rows.withColumns({f"_u{w}": F.coalesce(F.max(F.when(F.col(f"_r{w}"), F.col("i"))).over(before) >= begin, F.lit(False)) for w in ways})
    measures = []
    for w in ways:
        falls = (F.col("_delta") < -floors[w]) | (~F.col(f"_r{w}") & (F.col("_smooth") < 0))
        falls = falls & (F.col("i") > (first if w == "a" else 0))
        measures += [
            F.max(f"_r{w}").alias(f"up_{w}"), F.min(F.when(falls, _at())).alias(f"any_{w}"), F.min(F.when(falls & F.col(f"_u{w}"), _at())).alias(f"own_{w}"),
        ]
    pieces = rows.where("_kind = 0").groupBy(*keys, SLICE, *(["seg"] if turns else []))
    pieces = pieces.agg(F.count(F.lit(1)).alias("steps"), F.min("i").alias("start_i"), F.max(_at()).alias("end"), F.first("phase").alias("phase"), *measures)
    return pieces if turns else pieces.withColumn("seg", F.lit(0).cast("long"))


def _put_together(pieces: DataFrame, on: list[str], two_phase: Column, ways: str) -> DataFrame:
    """Outcome of each search (``on``) from its pieces in order; ``two_phase`` says which way to judge it."""

    def judged(name: str) -> Column:
        return F.col(f"{name}_{ways}") if len(ways) == 1 else F.when(two_phase, F.col(f"{name}_a")).otherwise(F.col(f"{name}_b"))

    rows = pieces.withColumns({name: judged(name) for name in ("up", "any", "own")})
    rows = rows.withColumn("phase", F.when(two_phase, F.col("phase")))
    started = F.coalesce(F.col("phase.was_up"), F.lit(False))
    earlier = Window.partitionBy(*on).orderBy(SLICE, "seg").rowsBetween(Window.unboundedPreceding, -1)
    fall = F.when(started | F.coalesce(F.max("up").over(earlier), F.lit(False)), F.col("any")).otherwise(F.col("own"))
    rows = rows.withColumns({"_fall": fall, "_up": started | F.col("up")})
    done = rows.groupBy(*on).agg(
        F.min("_fall").alias("late"), F.max("_up").alias("rising"), F.first("phase").alias("phase"), F.max("end").alias("end"), F.min("start_i").alias("start_i"), F.sum("steps").alias("steps"),
    )
    peak = F.coalesce("phase.early", "late")
    kind = F.when(peak.isNotNull(), "crossing").when(F.col("rising"), "boundary").otherwise("none")
    place = F.coalesce(peak, F.when(F.col("rising"), F.col("end")))
    floor = F.coalesce(F.col("phase.noise_floor"), F.lit(0.0))
    return done.select(*on, "start_i", "steps", kind.alias("peak_kind"), place["i"].alias("peak_i"), place["z"].alias("peak_z"), floor.alias("noise_floor"))


def find_peak_crossing(sweep: DataFrame, trend_n: int = 10, fresh: bool = False, size: int = INDEX_SLICE, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Where the smoothed slope of a one-direction sweep turns from rising to falling.

    The first ``trend_n`` steps use no threshold and give the noise floor of the rest; ``fresh`` judges the
    sweep as one that continues an earlier search (no first phase, floor 0). ``peak_kind`` is ``crossing``,
    ``boundary`` (still rising at the end) or ``none``.

    One pass over slices of the sweeps: each is reduced to what a later slice needs to know (was it rising) and to its first falling
    step with and without that knowledge. Give ``n``, the steps of each sweep, as a column to spare the pass that counts them.
    """
    on = list(keys)
    out = _put_together(_pieces(sweep, trend_n, size, on, False, fresh), on, F.lit(not fresh), "b" if fresh else "a")
    return out.drop("start_i", "steps")


def segment_peaks(sweep: DataFrame, trend_n: int = 10, size: int = INDEX_SLICE, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The search of a whole log that turns round: one row per segment (see ``sweep_segments``), each searched on its own steps.

    The first segment is searched in two phases, the ones behind a turn fresh: their first step has no delta, and what was seen
    before the turn does not count. Gives segment (from 0), start_i, steps, peak_kind, peak_i and peak_z; places count in the sweep.
    """
    on = list(keys)
    pieces = cut_lineage(_pieces(sweep, trend_n, size, on, True, False))  # a few rows for each slice and turn
    turns = F.col("seg") - F.coalesce(F.lag("seg").over(Window.partitionBy(*on, SLICE).orderBy("seg")), F.lit(0))
    numbered = ordered.running(pieces.withColumn("_turns", turns), on, ["seg"], segment=("sum", F.col("_turns").cast("long")))
    return _put_together(numbered, [*on, "segment"], F.col("segment") == 0, "ab")


def autofocus_log(sweep: DataFrame, trend_n: int = 10, n_neighbors: int | None = None, size: int = INDEX_SLICE) -> DataFrame:
    """A recorded search from start to end: its segments with their crossings, the parabola through the steps round the best one of
    all segments (z_peak), and the best step (z_best)."""
    found = segment_peaks(sweep, trend_n, size)
    curve = parabolic_peak(sweep, trend_n if n_neighbors is None else n_neighbors, size)
    return found.join(curve.select(KEY, "z_peak", F.col("z_argmax").alias("z_best")), KEY)


def best_focus(sweep: DataFrame, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """Step with the largest metric; the first visit wins ties."""
    top = F.max(F.struct(F.col("metric"), (-F.col("i")).alias("back"), F.col("z_mm").alias("z")))
    rows = sweep.where(F.col("metric").isNotNull()).groupBy(*keys).agg(top.alias("top"))
    return rows.select(*keys, (-F.col("top.back")).alias("best_i"), F.col("top.z").alias("z_best"), F.col("top.metric").alias("m_best"))


def best_so_far(sweep: DataFrame, size: int = INDEX_SLICE) -> DataFrame:
    """Add ``z_best``, the z of the largest metric seen up to each step."""
    sliced = sweep.withColumn(SLICE, ordered.index_slice(F.col("i"), size))
    top = F.struct(F.col("metric"), (-F.col("i")).alias("back"), F.col("z_mm").alias("z"))
    seen = ordered.running(sliced, [KEY], ["i"], top=("max", F.when(F.col("metric").isNotNull(), top)))
    return seen.select(*sweep.columns, F.col("top.z").alias("z_best"))


def nearest_k(rows: DataFrame, centre: Column, k: int, keys: tuple[str, ...] = (KEY,)) -> DataFrame:
    """The k rows of each key nearest ``centre`` in z; the visiting index breaks ties.

    Spark cuts each task's rows to k per key before the shuffle, so a hot key sends k rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(F.col("_dist"), F.col("i"))
    ranked = rows.withColumn("_dist", F.abs(F.col("z_mm") - centre)).withColumn("near_rank", F.row_number().over(w))
    return ranked.where(F.col("near_rank") <= k).drop("_dist")


def parabolic_peak(sweep: DataFrame, n_neighbors: int = 5, size: int = INDEX_SLICE) -> DataFrame:
    """Vertex of the least-squares parabola through the 2n+1 steps nearest the best one.

    Falls back to the best step for fewer than three different z or an upward curve, and never leaves the window.
    """
    valid = sweep.where(F.col("metric").isNotNull())
    best = valid.groupBy(KEY).agg(
        F.max(F.struct(F.col("metric"), (-F.col("i")).alias("back"), F.col("z_mm").alias("z"))).alias("top"), F.max("i").alias("_last")
    ).select(KEY, F.col("top.z").alias("z_top"), "_last")
    rows = valid.withColumn(SLICE, ordered.index_slice(F.col("i"), size))
    rows = ordered.attach(rows, best, [KEY], "_last", size)
    near = nearest_k(rows, F.col("z_top"), 2 * n_neighbors + 1)
    u, m = F.col("z_mm") - F.col("z_top"), F.col("metric")
    sums = near.groupBy(KEY).agg(
        F.max("z_top").alias("z_top"), F.min("z_mm").alias("lo"), F.max("z_mm").alias("hi"), F.size(F.collect_set("z_mm")).alias("n_z"),
        *[F.sum(F.pow(u, F.lit(float(p))) if p else F.lit(1.0)).alias(f"s{p}") for p in range(5)],
        *[F.sum((F.pow(u, F.lit(float(p))) if p else F.lit(1.0)) * m).alias(f"t{p}") for p in range(3)],
    )
    s = [F.col(f"s{p}") for p in range(5)]
    t = [F.col(f"t{p}") for p in range(3)]
    det = _det3([[s[4], s[3], s[2]], [s[3], s[2], s[1]], [s[2], s[1], s[0]]])
    a = _det3([[t[2], s[3], s[2]], [t[1], s[2], s[1]], [t[0], s[1], s[0]]]) / F.nullif(det, F.lit(0.0))
    b = _det3([[s[4], t[2], s[2]], [s[3], t[1], s[1]], [s[2], t[0], s[0]]]) / F.nullif(det, F.lit(0.0))
    fitted = sums.select("*", a.alias("a"), b.alias("b"))
    vertex = F.col("z_top") - F.col("b") / (2.0 * F.col("a"))
    usable = (F.col("n_z") >= 3) & (F.col("a") < 0)
    z = F.when(usable, F.greatest(F.col("lo"), F.least(F.col("hi"), vertex))).otherwise(F.col("z_top"))
    return fitted.select(KEY, z.alias("z_peak"), F.col("z_top").alias("z_argmax"), usable.alias("fitted"))


def _det3(m: list[list[Column]]) -> Column:
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def sweep_segments(sweep: DataFrame, size: int = INDEX_SLICE) -> DataFrame:
    """Add ``segment``: it grows by one at every step whose direction differs from the step before."""
    w = ordered.halo_window([KEY], "i")
    rows = ordered.with_halo(sweep, "i", 2, size)
    step = F.signum(F.col("z_mm") - F.lag("z_mm").over(w))
    rows = rows.withColumn("_dir", step)
    rows = rows.withColumn("_turn", F.coalesce((F.col("_dir") != F.lag("_dir").over(w)).cast("long"), F.lit(0).cast("long")))
    # the first halo row has no direction, so its follower may not turn: both are copies and dropped here
    rows = ordered.drop_halo(rows, keep_slice=True).drop("_dir")
    out = ordered.running(rows, [KEY], ["i"], segment=("sum", F.col("_turn")))
    return out.select(*sweep.columns, "segment")


def fine_plan(peaks: DataFrame, z: str, coarse_step: float, fine_step: float, fine_range: float = 1.0) -> DataFrame:
    """Evenly spaced z positions of the fine sweep round column ``z``."""
    lo, hi = F.col(z) - coarse_step * fine_range, F.col(z) + coarse_step * fine_range
    n = F.greatest(F.lit(3), F.rint((hi - lo) / fine_step).cast("int") + 1)
    rows = peaks.select("*", lo.alias("_lo"), hi.alias("_hi"), n.alias("_n"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    z_mm = F.col("_lo") + F.col("k") * (F.col("_hi") - F.col("_lo")) / (F.col("_n") - 1)
    return rows.withColumn("z_mm", z_mm).drop("_lo", "_hi", "_n")


def average_metric(measures: DataFrame, keys: tuple[str, ...] = (KEY, "i")) -> DataFrame:
    """Mean of repeated measurements; nulls are ignored, all null gives null."""
    return measures.groupBy(*keys).agg(F.avg("metric").alias("metric"))
