"""Per-frame features and edge-triggered rules on them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.functions.geometry import between, heading, turn
from burrow.operators.scan import ordered_scan
from burrow.operators.series import SESSION, along, runs


def features(df: DataFrame, dt: str = "dt_us", alpha: float = 0.4, body_frames: int = 200) -> DataFrame:
    """Adds raw_speed, speed_ema, heading, turning (deg/s), axis, body (running median of axis) and elongation.

    df has x, y (the point that moves) and hx, hy, tx, ty (head and tail of the body's axis); with nx, ny (the neck) head_angle is added, too: the head's
    signed angle to the body, from tail over neck to head; null where a part of it has no length.
    """
    w = along()
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2))
    d = df.withColumn("raw_speed", F.coalesce(F.when(F.col(dt) > 0, step * 1e6 / F.col(dt)), F.lit(0.0)))

    def start():
        level = None

        def step(speeds: list) -> tuple[list]:
            nonlocal level
            levels = []
            for v in speeds:
                level = v if level is None else level + alpha * (v - level)
                levels.append(level)
            return (levels,)

        return step

    d = ordered_scan(d, start, ["raw_speed"], "speed_ema double")
    d = d.withColumn("heading", heading(F.col("hx") - F.col("tx"), F.col("hy") - F.col("ty")))
    d = d.withColumn("turning", F.when(F.col(dt) > 0, turn(F.col("heading"), F.lag("heading").over(w)) * 1e6 / F.col(dt)))
    d = d.withColumn("axis", F.sqrt(F.pow(F.col("hx") - F.col("tx"), 2) + F.pow(F.col("hy") - F.col("ty"), 2)))
    d = d.withColumn("body", F.percentile("axis", 0.5).over(w.rowsBetween(-(body_frames - 1), 0)))
    d = d.withColumn("elongation", F.when(F.col("body") > 0, F.col("axis") / F.col("body")))
    if "nx" in df.columns:
        d = d.withColumn("head_angle", between(F.col("nx") - F.col("tx"), F.col("ny") - F.col("ty"), F.col("hx") - F.col("nx"), F.col("hy") - F.col("ny")))
    return d


def facing(target: tuple[float, float]) -> Column:
    """Signed degrees from the body's axis (tail to head) to the target as the head sees it; null without either direction."""
    return between(F.col("hx") - F.col("tx"), F.col("hy") - F.col("ty"), F.lit(float(target[0])) - F.col("hx"), F.lit(float(target[1])) - F.col("hy"))


@dataclass(frozen=True)
class Rule:
    """A condition by name, with its threshold (in px, or bodies where unit says so), zones and hold."""

    name: str
    condition: str
    threshold: float | None = None
    zones: tuple[str, ...] = ()
    unit: str = "px"
    duration_us: int = 0
    speed_max: float = 2.0
    target: tuple[float, float] | None = None

    def column(self) -> Column:
        """Whether the condition holds on a frame, before any hold; an unset threshold never fires unless the condition has one of its own."""
        never = F.lit(False)
        speed = F.col("speed_ema") / F.col("body") if self.unit == "bodylen" else F.col("speed_ema")
        inside = F.coalesce(F.col("zone").isin(*self.zones), never) if self.zones else never
        over = lambda v: never if self.threshold is None else F.coalesce(v > self.threshold, never)
        under = lambda v: never if self.threshold is None else F.coalesce(v < self.threshold, never)
        limit = lambda default: default if self.threshold is None else self.threshold
        known = {
            "in_zone": lambda: inside,
            "enter_zone": lambda: inside,
            "not_in_zone": lambda: ~inside,
            "exit_zone": lambda: ~inside,
            "exit_edge": lambda: ~inside,
            "speed_gt": lambda: over(speed),
            "speed_lt": lambda: under(speed),
            "rotation_gt": lambda: over(F.abs("turning")),
            "rotation_lt": lambda: under(F.abs("turning")),
            "head_angle_gt": lambda: over(F.abs("head_angle")),
            "head_angle_lt": lambda: under(F.abs("head_angle")),
            "facing_line": lambda: never if self.target is None else F.coalesce(F.abs(facing(self.target)) <= limit(30.0), never),
            "elongation_gt": lambda: over(F.col("elongation")),
            "rearing": lambda: F.coalesce((F.col("elongation") < limit(0.6)) & (F.col("speed_ema") / F.col("body") < self.speed_max), never),
            "freezing": lambda: F.coalesce(speed < limit(1.0), never),
            "distance_gt": lambda: over(F.col("axis")),
            "distance_lt": lambda: under(F.col("axis")),
        }
        if self.condition not in known:
            raise ValueError(f"no such condition: {self.condition}")
        return known[self.condition]()


def zone_policies(zones: DataFrame, part: str = "centroid", coordinates: bool = True, events: bool = True) -> DataFrame:
    """name, kind, condition, target, carries_pixels: what each zone sends, from its transmit_mode, coord_var, event_on_enter and event_on_exit.

    A coordinate zone feeds the variable coord_var (``loc_center`` if blank) with the part's zone, or, as ``carries_pixels`` warns, with its pixel place if the name ends
    in _x or _y. An event zone has a rule in_zone for its entering event and, in the mode event_enter_exit, one exit_edge for its leaving event; blank
    events make no rule, unknown modes nothing.
    """
    mode = F.coalesce("transmit_mode", F.lit("coord"))
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    variable = F.coalesce(blank("coord_var"), F.lit("loc_center"))
    low = F.lower(variable)
    row = lambda kind, condition, target, pixels: F.struct(F.lit(kind).alias("kind"), F.lit(condition).cast("string").alias("condition"), target.alias("target"), pixels.alias("carries_pixels"))
    no = F.lit(False)
    sends = F.array(
        F.when((mode == "coord") & F.lit(coordinates), row("coordinate", None, variable, low.isin("x", "y") | low.endswith("_x") | low.endswith("_y"))),
        F.when(mode.isin("event_enter", "event_enter_exit") & F.lit(events) & blank("event_on_enter").isNotNull(), row("event", "in_zone", F.col("event_on_enter"), no)),
        F.when((mode == "event_enter_exit") & F.lit(events) & blank("event_on_exit").isNotNull(), row("event", "exit_edge", F.col("event_on_exit"), no)),
    )
    return zones.select("name", F.explode(F.array_compact(sends)).alias("s")).select("name", F.lit(part).alias("part"), "s.*")


def rules_of(policies: DataFrame) -> list[Rule]:
    """The rules of ``zone_policies``' events; zones are a handful."""
    rows = policies.where("kind = 'event'").orderBy("name", "condition").collect()
    return [Rule(r["target"], r["condition"], zones=(r["name"],)) for r in rows]


def states(df: DataFrame, rules: list[Rule], clock: str = "t_us") -> DataFrame:
    """session, frame, rule, active, fired. A held rule is active once its condition has held for duration_us by the clock; it fires on turning active.

    All rules are columns of one pass over the sessions' windows; only then does each frame become a row per rule.
    """
    w = along()
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumns({f"raw_{i}": r.column() for i, r in enumerate(rules)})
    turned = lambda c: F.coalesce(F.col(c) != F.lag(c).over(w), F.lit(True))
    d = d.withColumns({f"turned_{i}": F.when(turned(f"raw_{i}"), F.col(clock)) for i, r in enumerate(rules) if r.duration_us})
    long = lambda i, r: F.col(clock) - F.last(f"turned_{i}", ignorenulls=True).over(so_far) >= r.duration_us
    d = d.withColumns({f"active_{i}": F.col(f"raw_{i}") & long(i, r) if r.duration_us else F.col(f"raw_{i}") for i, r in enumerate(rules)})
    before = lambda i: F.lag(f"active_{i}").over(w)
    # leaving needs having been inside: a session's first frame doesn't fire it
    fired = lambda i, r: F.col(f"active_{i}") & ~F.coalesce(before(i), F.lit(r.condition == "exit_edge"))
    d = d.withColumns({f"fired_{i}": fired(i, r) for i, r in enumerate(rules)})
    each = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.col(f"active_{i}").alias("active"), F.col(f"fired_{i}").alias("fired")) for i, r in enumerate(rules)))
    return d.select(SESSION, "frame", F.explode(each).alias("r")).select(SESSION, "frame", "r.*")


def interaction(df: DataFrame, in_zone: Column, past_line: Column, facing_deg: Column, confirm_us: int = 100_000, most_deg: float = 45.0, dt: str = "dt_us") -> DataFrame:
    """session, zone_us, near_us, investigating_us, entries: head in a zone, past its inner line, confirmed after confirm_us, and facing the target.

    An entry is a confirmed run; investigating is what of it faces the target.
    """
    d = df.withColumn("near", F.coalesce(in_zone & past_line, F.lit(False)))
    d = runs(d, "near", "near_run")
    w = along("near_run").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("confirmed", F.col("near") & (F.sum(dt).over(w) >= confirm_us))
    d = d.withColumn("entered", F.col("confirmed") & ~F.coalesce(F.lag("confirmed").over(along("near_run")), F.lit(False)))
    time = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), F.col(dt)).otherwise(0))
    return d.groupBy(SESSION).agg(time(in_zone).alias("zone_us"), time(F.col("near")).alias("near_us"), time(F.col("confirmed") & (facing_deg <= most_deg)).alias("investigating_us"), F.count(F.when(F.col("entered"), 1)).alias("entries"))


def zone_stats(df: DataFrame, state: str, zone: str, zones: list[str], width_us: int, least_us: int, dt: str = "dt_us", step: str = "step", speed: str = "speed", clock: str = "t_us") -> DataFrame:
    """The wide table: a row per session, state and bin, with path, top speed, and time and entries of each zone.

    Bins count from the state's first frame. A zone's entries are its runs within the bin of at
    least two frames and least_us.
    """
    d = df.where(F.col(state).isNotNull())
    d = d.withColumn("bin", F.floor((F.col(clock) - F.min(clock).over(Window.partitionBy(SESSION, state))) / width_us))
    d = runs(d, F.struct(state, "bin", zone), "zone_run")
    visits = d.groupBy(SESSION, state, "bin", "zone_run", zone).agg(F.sum(dt).alias("us"), F.count("*").alias("n"), F.sum(step).alias("path"), F.max(speed).alias("top"))
    each = []
    for z in zones:
        here = F.col(zone) == z
        each += [F.sum(F.when(here, F.col("us")).otherwise(0)).alias(f"{z}_us"), F.count(F.when(here & (F.col("us") >= least_us) & (F.col("n") >= 2), 1)).alias(f"{z}_entries")]
    return visits.groupBy(SESSION, state, "bin").agg(F.sum("path").alias("path"), F.max("top").alias("top_speed"), *each)
