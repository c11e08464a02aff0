"""Cleaning of tracked points: gates, limits, gaps and smoothers.

Whatever looks only a fixed way back or ahead, or at a session's statistics, is a window expression;
filters that feed back are ordered scans. A rejected position is null, never another value, unless
the function says so. Positions of a frame that was rejected keep their place in the series.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.scan import ordered_scan
from burrow.operators.series import along, onward


def _kept(df: DataFrame, ok: Column, *columns: str) -> DataFrame:
    return df.withColumns({c: F.when(ok, F.col(c)) for c in columns})


def gate(df: DataFrame, least: float, conf: str = "conf", x: str = "x", y: str = "y") -> DataFrame:
    """Drops positions of too little confidence; a null confidence is too little."""
    return _kept(df, F.col(conf) >= least, x, y)


def part_gate(df: DataFrame, percent: float = 5, floor: float = 0.1, ceiling: float = 0.6, conf: str = "conf", x: str = "x", y: str = "y", keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """Like ``gate`` with a threshold from each series' own confidences, between floor and ceiling; a null confidence stays."""
    cut = F.percentile(conf, percent / 100).over(Window.partitionBy(*keys))
    limit = F.least(F.greatest(F.coalesce(cut, F.lit(floor)), F.lit(floor)), F.lit(ceiling))
    return _kept(df.withColumn("part_limit", limit), F.col(conf).isNull() | (F.col(conf) >= F.col("part_limit")), x, y).drop("part_limit")


def jump_gate(df: DataFrame, spreads: float = 6, least_steps: int = 8, x: str = "x", y: str = "y", keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """Drops positions that a step beyond median + spreads x spread leads to, judged by the positions before the gate.

    The spread is the interquartile range of the series' steps, else 1.4826 times their median absolute
    deviation, else the larger of a quarter of the median and 1. Too few steps: nothing is dropped.
    """
    w, all_rows = Window.partitionBy(*keys).orderBy("frame"), Window.partitionBy(*keys)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    d = df.withColumn("jump", step)
    d = d.withColumns({"jump_q": F.percentile("jump", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(all_rows), "jump_n": F.count("jump").over(all_rows)})
    d = d.withColumn("jump_mad", F.percentile(F.abs(F.col("jump") - F.col("jump_q")[1]), 0.5).over(all_rows))
    iqr = F.col("jump_q")[2] - F.col("jump_q")[0]
    spread = F.when(iqr > 0, iqr).when(F.col("jump_mad") > 0, 1.4826 * F.col("jump_mad")).otherwise(F.greatest(0.25 * F.col("jump_q")[1], F.lit(1.0)))
    far = (F.col("jump_n") >= least_steps) & (F.col("jump") > F.col("jump_q")[1] + spreads * spread)
    return _kept(d, ~F.coalesce(far, F.lit(False)), x, y).drop("jump", "jump_q", "jump_n", "jump_mad")


def teleport_gate(df: DataFrame, most_speed: float, dt: str = "dt_us", x: str = "x", y: str = "y", parts: tuple[str, ...] = (), hold: bool = False) -> DataFrame:
    """Drops positions reached faster than most_speed per second from the position before, as recorded; with hold, that position takes their place."""
    w = along(*parts)
    step = F.sqrt(F.pow(F.col(x) - F.lag(x).over(w), 2) + F.pow(F.col(y) - F.lag(y).over(w), 2))
    if hold:
        # of a run of such positions each takes the corrected one before it, so all take the last kept one
        d = df.withColumn("teleport", F.coalesce((F.col(dt) > 0) & (step * 1e6 / F.col(dt) > most_speed), F.lit(False)))
        kept = {c: F.last(F.when(~F.col("teleport"), F.struct(F.col(c).alias("v"))), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))["v"] for c in (x, y)}
        return d.withColumns({f"kept_{c}": v for c, v in kept.items()}).withColumns({c: F.when(F.col("teleport"), F.col(f"kept_{c}")).otherwise(F.col(c)) for c in (x, y)}).drop("teleport", *(f"kept_{c}" for c in (x, y)))
    return _kept(df.withColumn("teleport", F.coalesce((F.col(dt) > 0) & (step * 1e6 / F.col(dt) > most_speed), F.lit(False))), ~F.col("teleport"), x, y).drop("teleport")


def held_clamp(df: DataFrame, most_speed: float, dt: str = "dt_us", x: str = "x", y: str = "y") -> DataFrame:
    """Like ``teleport_gate`` but compares with the corrected position before, and holds that one where the speed is too high."""

    def start():
        last = None

        def step(xs: list, ys: list, gaps: list) -> tuple[list, list]:
            nonlocal last
            out_x, out_y = [], []
            for px, py, gap in zip(xs, ys, gaps):
                if px is not None and py is not None:
                    if last is not None and gap and math.hypot(px - last[0], py - last[1]) * 1e6 / gap > most_speed:
                        px, py = last
                    last = px, py
                out_x.append(px)
                out_y.append(py)
            return out_x, out_y

        return step

    return ordered_scan(df, start, [x, y, dt], "clamped_x double, clamped_y double")


def fill_gaps(df: DataFrame, most_us: int, clock: str = "t_us", *columns: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Straight lines in time across gaps of at most most_us between known values; longer and open gaps stay null."""
    before, after = (w.rowsBetween(Window.unboundedPreceding, -1) for w in (along(*parts), onward(*parts)))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col(clock).alias("t"), F.col(c).alias("v"))) for c in columns}
    d = df.withColumns({f"known_{c}": k for c, k in known.items()})
    for side, w in (("before", before), ("after", after)):
        d = d.withColumns({f"{side}_{c}": F.last(f"known_{c}", ignorenulls=True).over(w) for c in columns})

    def value(c: str) -> Column:
        a, b = F.col(f"before_{c}"), F.col(f"after_{c}")
        span = b["t"] - a["t"]
        line = a["v"] + (b["v"] - a["v"]) * (F.col(clock) - a["t"]) / F.when(span > 0, span)
        return F.coalesce(F.col(c), F.when(span <= most_us, line))

    return d.withColumns({c: value(c) for c in columns}).drop(*(f"{k}_{c}" for k in ("known", "before", "after") for c in columns))


def rolling_median(df: DataFrame, value: str, out: str, half: int = 2, parts: tuple[str, ...] = ()) -> DataFrame:
    """Median of the known values among a frame and ``half`` frames on either side; null where all are."""
    return df.withColumn(out, F.percentile(value, 0.5).over(along(*parts).rowsBetween(-half, half)))


#: A centred quadratic fit over seven points.
SAVGOL_7_2 = (-2.0, 3.0, 6.0, 7.0, 6.0, 3.0, -2.0)


def savgol(df: DataFrame, value: str, out: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Quadratic smoothing over seven frames; the first and last three frames mirror the series at its ends. Null where any of the seven is."""
    w = along(*parts)
    d = df.withColumns({"sg_i": F.row_number().over(w), "sg_n": F.count("*").over(Window.partitionBy("session", *parts))})

    def at(k: int) -> Column:
        straight = F.lag(value, -k).over(w) if k < 0 else (F.lead(value, k).over(w) if k else F.col(value))
        # a place p frames beyond an end is read p frames before it: k becomes 2 (end - i) - k
        folds = {}
        for i in (1, 2, 3):
            if i + k < 1:
                folds[i] = 2 - 2 * i - k
        out = straight
        for i, m in folds.items():
            out = F.when(F.col("sg_i") == i, F.lead(value, m).over(w)).otherwise(out)
        for i in (0, 1, 2):  # frames from the end
            if k > i:
                m = 2 * i - k
                out = F.when(F.col("sg_n") - F.col("sg_i") == i, F.lead(value, m).over(w) if m > 0 else F.lag(value, -m).over(w)).otherwise(out)
        return out

    total = sum((weight * at(k) for k, weight in zip(range(-3, 4), SAVGOL_7_2)), F.lit(0.0)) / sum(SAVGOL_7_2)
    return d.withColumn(out, F.when(F.col("sg_n") >= 7, total).otherwise(F.col(value))).drop("sg_i", "sg_n")


def zero_lag(df: DataFrame, value: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Quadratic smoothing over seven frames that keeps holes: they are bridged by straight lines (by place) for the smoothing, and are holes again."""
    w = along(*parts)
    d = df.withColumn("zl_i", F.row_number().over(w))
    known = F.when(F.col(value).isNotNull(), F.struct(F.col("zl_i").alias("i"), F.col(value).alias("v")))
    d = d.withColumns({"zl_a": F.last(known, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "zl_b": F.last(known, ignorenulls=True).over(onward(*parts).rowsBetween(Window.unboundedPreceding, 0))})
    line = F.col("zl_a.v") + (F.col("zl_b.v") - F.col("zl_a.v")) * (F.col("zl_i") - F.col("zl_a.i")) / F.nullif(F.col("zl_b.i") - F.col("zl_a.i"), F.lit(0))
    d = d.withColumns({"zl": F.coalesce(line, "zl_a.v", "zl_b.v"), "zl_n": F.count(value).over(Window.partitionBy("session", *parts))})
    d = savgol(d, "zl", "zl_s", parts)
    return d.withColumn(value, F.when(F.col(value).isNotNull(), F.when(F.col("zl_n") >= 2, F.col("zl_s")).otherwise(F.col(value)))).drop("zl", "zl_i", "zl_a", "zl_b", "zl_s", "zl_n")


def one_euro(df: DataFrame, value: str, out: str, min_cutoff: float = 1.0, beta: float = 0.007, d_cutoff: float = 1.0, clock: str = "t_us", keys: tuple[str, ...] = ("session",), dealt: bool = False) -> DataFrame:
    """Low-pass filter whose cut-off rises with speed. The first known value passes; without time since it, the output stays; null stays null."""

    def start():
        level, slope, since = None, 0.0, 0

        def step(values: list, clocks: list) -> tuple[list]:
            nonlocal level, slope, since
            smooth = []
            for v, t in zip(values, clocks):
                if v is None or v != v:
                    smooth.append(None)
                    continue
                if level is None:
                    level, since = v, t
                elif t > since:
                    turn = 2 * math.pi * (t - since) / 1e6
                    slope += d_cutoff * turn / (d_cutoff * turn + 1) * ((v - level) * 1e6 / (t - since) - slope)
                    turn *= min_cutoff + beta * abs(slope)
                    level += turn / (turn + 1) * (v - level)
                    since = t
                smooth.append(level)
            return (smooth,)

        return step

    return ordered_scan(df, start, [value, clock], f"{out} double", keys, dealt=dealt)


def ema(df: DataFrame, value: str, out: str, tau: float) -> DataFrame:
    """Exponential moving average with the memory e^(-1/tau) per row, from 0; null rows leave it as it was."""
    memory = math.exp(-1.0 / tau)

    def start():
        level = 0.0

        def step(values: list) -> tuple[list]:
            nonlocal level
            levels = []
            for v in values:
                if v is not None:
                    level = v * (1 - memory) + memory * level
                levels.append(level)
            return (levels,)

        return step

    return ordered_scan(df, start, [value], f"{out} double")


def forward_clock(df: DataFrame, clock: str, out: str, most_back: float = 250.0) -> DataFrame:
    """A clock that doesn't run backward: small steps back hold the last value, larger ones start anew from the new value."""

    def start():
        last = None

        def step(clocks: list) -> tuple[list]:
            nonlocal last
            forward = []
            for t in clocks:
                if t is not None:
                    last = float(t if last is None or not 0 < last - t <= most_back else last)
                forward.append(None if t is None else last)
            return (forward,)

        return step

    return ordered_scan(df, start, [clock], f"{out} double")


def process_variance(df: DataFrame, x: str, y: str, measure: float, dt: str = "dt_us", least: int = 8, keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """df with motion_q, the motion's acceleration variance of each series, from the spread of its second differences."""
    everywhere = Window.partitionBy(*keys)
    known = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    w = Window.partitionBy(*keys).orderBy("frame")
    second = lambda c: F.col(c) - 2 * F.lag(c, 1).over(w) + F.lag(c, 2).over(w)
    d = known.withColumns({"sx": second(x), "sy": second(y)})
    d = d.withColumns({f"m{c}": F.percentile(c, 0.5).over(everywhere) for c in ("sx", "sy")})
    step = F.percentile(F.when(F.col(dt) > 0, F.col(dt) / 1e6), 0.5)
    stats = d.groupBy(*keys).agg(F.count("*").alias("points"), *(F.percentile(F.abs(F.col(c) - F.col(f"m{c}")), 0.5).alias(f"d{c}") for c in ("sx", "sy")), step.alias("step_s"))
    motion = lambda c: F.greatest(F.pow(1.4826 * F.col(c), 2) - 6 * measure * measure, F.lit(0.0)) / F.pow("step_s", 4)
    q = F.greatest((motion("dsx") + motion("dsy")) / 2, measure * measure / F.pow("step_s", 4) * 0.01)
    stats = stats.select(*keys, F.when((F.col("points") >= least) & (F.col("step_s") > 0), q).otherwise(1000.0).alias("motion_q"), F.coalesce("step_s", F.lit(1 / 30)).alias("median_dt"))
    return df.join(stats, list(keys), "left").fillna({"motion_q": 1000.0, "median_dt": 1 / 30})


def _onward(x: float, u: float, a: float, b: float, d: float, h: float, q: float) -> tuple[float, float, float, float, float]:
    """Place, velocity and covariance (a, b; b, d) after a time h of constant velocity, disturbed by accelerations of variance q."""
    return x + h * u, u, a + h * (2 * b + h * d) + q * h**3 / 3, b + h * d + q * h * h / 2, d + q * h


def rts(df: DataFrame, value: str, out: str, measure: float = 2.0, conf: str | None = None, dt: str = "dt_us", keys: tuple[str, ...] = ("session",), dealt: bool = False) -> DataFrame:
    """Constant-velocity Kalman filter and Rauch-Tung-Striebel smoother of one axis; needs motion_q and median_dt. Null stays null.

    The forward scan leaves the filtered states in columns; the backward scan reads them in
    descending order and makes the predictions anew, so memory doesn't grow with the recording. Both need one exchange.
    """

    def forward():
        now = None

        def step(values: list, gaps: list, motion: list, usual: list, *confs: list) -> tuple[list, ...]:
            nonlocal now
            rows = []
            for v, gap, q, median, *c in zip(values, gaps, motion, usual, *confs):
                h = gap / 1e6 if gap and gap > 0 else median
                noise = measure * measure / (min(max(c[0], 0.05), 1.0) if c and c[0] is not None else 1.0)
                if now is None:
                    now = None if v is None else (v, 0.0, noise, 0.0, q * h * h)
                else:
                    x, u, a, b, d = _onward(*now, h, q)
                    if v is not None:
                        gain, pull = a / (a + noise), b / (a + noise)
                        x, u, a, b, d = x + gain * (v - x), u + pull * (v - x), a - gain * a, b - gain * b, d - pull * b
                    now = x, u, a, b, d
                rows.append((*(now or (None,) * 5), h))
            return tuple(map(list, zip(*rows)))

        return step

    def backward():
        after = None

        def step(values: list, motion: list, *states: list) -> tuple[list]:
            nonlocal after
            smooth = []
            for v, q, x, u, a, b, d, h in zip(values, motion, *states):
                if x is None:
                    smooth.append(None)
                    continue
                if after is not None:
                    x1, u1, h1 = after
                    px, pu, pa_, pb, pd = _onward(x, u, a, b, d, h1, q)
                    det = pa_ * pd - pb * pb
                    if det > 0:
                        # the states' covariance with the predicted ones, times the inverse of the latter's
                        ex, eu = (pd * (x1 - px) - pb * (u1 - pu)) / det, (pa_ * (u1 - pu) - pb * (x1 - px)) / det
                        x, u = x + (a + h1 * b) * ex + b * eu, u + (b + h1 * d) * ex + d * eu
                after = x, u, h
                smooth.append(None if v is None else x)
            return (smooth,)

        return step

    names = [f"rts_{n}" for n in "xuabdh"]
    ahead = ordered_scan(df, forward, [value, dt, "motion_q", "median_dt", *([conf] if conf else [])], ", ".join(f"{n} double" for n in names), keys, dealt=dealt)
    return ordered_scan(ahead, backward, [value, "motion_q", *names], f"{out} double", keys, descending=True, dealt=True).drop(*names)


def two_state_path(df: DataFrame, evidence: str, out: str, cost: float = 0.15, keys: tuple[str, ...] = ("session",), dealt: bool = False) -> DataFrame:
    """The cheapest path of keep (false) or swap (true): contradicting evidence costs its size, each change ``cost``. Two scans, one exchange."""

    def forward():
        keep = swap = None

        def step(evidences: list) -> tuple[list, list, list]:
            nonlocal keep, swap
            from_keep, from_swap, better = [], [], []
            for e in evidences:
                e = e or 0.0
                turned = keep is not None and swap + cost < keep, keep is not None and keep + cost < swap
                if keep is None:
                    keep = swap = 0.0
                keep, swap = min(keep, swap + cost) + max(0.0, -e), min(swap, keep + cost) + max(0.0, e)
                from_keep.append(int(turned[0]))
                from_swap.append(int(not turned[1]))
                better.append(int(swap < keep))
            return from_keep, from_swap, better

        return step

    def backward():
        state = None

        def step(from_keep: list, from_swap: list, better: list) -> tuple[list]:
            nonlocal state
            path = []
            for a, b, last in zip(from_keep, from_swap, better):
                now = last if state is None else state
                state = b if now else a
                path.append(bool(now))
            return (path,)

        return step

    names = ["vp_keep", "vp_swap", "vp_last"]
    ahead = ordered_scan(df, forward, [evidence], ", ".join(f"{n} int" for n in names), keys, dealt=dealt)
    return ordered_scan(ahead, backward, names, f"{out} boolean", keys, descending=True, dealt=True).drop(*names)


def crossed_pairs(df: DataFrame, threshold: float = 0.3, anchor: tuple[str, str] | None = None, farther: str | None = None) -> DataFrame:
    """df with crossed: whether the two points (ax, ay) and (bx, by) have exchanged names.

    The state toggles where exchanging the points takes more than ``threshold`` off the way both have come since the last
    frame that had them and, with an anchor point, brings the first one on its proper side of the anchor: farther from it
    than the second, or nearer where the column ``farther`` is false. Where it is null there is no anchor. Frames without both points keep the state.
    """

    def start():
        crossed, before = False, None

        def placed(one: complex, two: complex, x: float | None, y: float | None, far: bool | None) -> bool:
            if far is None:
                return True
            if x is None or y is None:
                return False
            more = abs(one - complex(x, y)) - abs(two - complex(x, y))
            return more > 0 if far else more < 0

        def step(ax: list, ay: list, bx: list, by: list, *anchors: list) -> tuple[list]:
            nonlocal crossed, before
            states = []
            for x1, y1, x2, y2, *at in zip(ax, ay, bx, by, *anchors):
                if None not in (x1, y1, x2, y2):
                    pair = complex(x1, y1), complex(x2, y2)
                    one, two = pair[::-1] if crossed else pair
                    if before:
                        way = abs(one - before[0]) + abs(two - before[1])
                        other = abs(two - before[0]) + abs(one - before[1])
                        if way - other > threshold * way and placed(two, one, *at):
                            crossed = not crossed
                            one, two = two, one
                    before = one, two
                states.append(crossed)
            return (states,)

        return step

    d = df.withColumn("anchor_far", F.lit(True if anchor else None).cast("boolean") if farther is None else F.col(farther))
    d = d.withColumns({"anchor_x": F.col(anchor[0]), "anchor_y": F.col(anchor[1])} if anchor else {c: F.lit(None).cast("double") for c in ("anchor_x", "anchor_y")})
    return ordered_scan(d, start, ["ax", "ay", "bx", "by", "anchor_x", "anchor_y", "anchor_far"], "crossed boolean").drop("anchor_x", "anchor_y", "anchor_far")


def refined(df: DataFrame, conf: str = "conf", most_gap_us: int = 250_000) -> DataFrame:
    """The default chain for one point: its own confidence gate, then jumps, then short gaps."""
    return fill_gaps(jump_gate(part_gate(df, conf=conf)), most_gap_us, "t_us", "x", "y")
