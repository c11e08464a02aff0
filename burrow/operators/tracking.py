"""Live Kalman filters of points, in batch: per part with a short coast, per session with a forecast.

A filter's state is a handful of numbers, so the same step (``PointFilter``, ``CentreFilter``) runs over an ordered scan here and over the state
store in ``burrow.streaming.tracking``. Both axes share one covariance, as they are measured and disturbed alike.

Defined results: a frame without position, or with too little or no confidence, isn't measured; before the first measured
frame there is nothing; time between frames counts as at least 1 ms and at most 1 s.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from burrow.operators.scan import ordered_scan

#: Time between frames in seconds, at least and at most, and without a clock; the least confidence that scales the noise.
LEAST_DT, MOST_DT, USUAL_DT, CONF_FLOOR = 0.001, 1.0, 1 / 30, 0.1


def _between(t: int, since: int) -> float:
    return min(max((t - since) / 1e6, LEAST_DT), MOST_DT)


def _noise(variance: float, conf: float | None) -> float:
    """Of a measurement: weak detections are trusted less, down to a tenth."""
    c = 1.0 if conf is None or conf - conf != 0 else conf
    return variance * min(10.0, 1.0 / max(c, CONF_FLOOR))


@dataclass(frozen=True)
class PointFilter:
    """One part: constant velocity, at most ``max_gap`` predicted frames with falling confidence, then nothing until it is seen again."""

    max_gap: int = 5
    min_conf: float = 0.1
    acceleration: float = 300.0
    variance: float = 4.0

    #: clock, place, velocity, covariance of place, of both, of velocity, misses, last measured confidence
    STATE = "t long, x double, y double, u double, v double, p double, r double, s double, misses int, conf double"
    OUT = "kx double, ky double, kconf double, filled boolean"

    def step(self, state: tuple | None, t: int, x: float | None, y: float | None, conf: float | None) -> tuple[tuple | None, tuple]:
        """The next state, and place, confidence and whether it is predicted."""
        seen = None not in (x, y, conf) and conf >= self.min_conf and x - x == 0 == y - y
        if state is None:
            return ((t, x, y, 0.0, 0.0, 1.0, 0.0, 1.0, 0, conf), (x, y, conf, False)) if seen else (None, (None, None, None, False))
        since, px, py, u, v, p, r, s, misses, last = state
        h, q = _between(t, since), self.acceleration**2
        px, py = px + h * u, py + h * v
        p, r, s = p + h * (2 * r + h * s) + q * h**3 / 3, r + h * s + q * h * h / 2, s + q * h
        if seen:
            total = p + _noise(self.variance, conf)
            gain, pull = p / total, r / total
            dx, dy = x - px, y - py
            px, py, u, v = px + gain * dx, py + gain * dy, u + pull * dx, v + pull * dy
            p, r, s = p - gain * p, r - gain * r, s - pull * r
            return (t, px, py, u, v, p, r, s, 0, conf), (px, py, conf, False)
        # misses beyond the coast needn't be counted
        misses = min(misses + 1, self.max_gap + 1)
        after = (t, px, py, u, v, p, r, s, misses, last)
        if misses > self.max_gap:
            return after, (None, None, None, False)
        return after, (px, py, last * (1 - misses / (self.max_gap + 1)), True)


@dataclass(frozen=True)
class CentreFilter:
    """The animal's centre: constant acceleration; lost after ``most_misses`` frames, when it stays where it was last."""

    most_misses: int = 30
    variance: float = 4.0

    #: clock, place, velocity, acceleration, covariance (upper triangle), misses and the place last told
    STATE = "t long, x double, y double, u double, v double, a double, b double, xx double, xu double, xa double, uu double, ua double, aa double, misses int, tx double, ty double"
    OUT = "cx double, cy double, vx double, vy double, ax double, ay double, lost boolean"

    def step(self, state: tuple | None, t: int, x: float | None, y: float | None, conf: float | None) -> tuple[tuple | None, tuple]:
        """The next state, and place, velocity, acceleration and whether it is lost. A null confidence is full."""
        seen = None not in (x, y)
        if state is None:
            if not seen:
                return None, (None,) * 6 + (False,)
            return (t, x, y, 0.0, 0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 50.0, 0.0, 100.0, 0, x, y), (x, y, 0.0, 0.0, 0.0, 0.0, False)
        since, px, py, u, v, a, b, xx, xu, xa, uu, ua, aa, misses, tx, ty = state
        h = _between(t, since) if t > since else USUAL_DT
        k = h * h / 2
        px, py, u, v = px + h * u + k * a, py + h * v + k * b, u + h * a, v + h * b
        # covariance after the move: each row and column gets its derivative's
        xx, xu, xa, uu, ua = (
            xx + 2 * h * xu + 2 * k * xa + h * h * uu + 2 * h * k * ua + k * k * aa + 0.5 * h,
            xu + h * xa + h * uu + h * h * ua + k * ua + h * k * aa,
            xa + h * ua + k * aa,
            uu + 2 * h * ua + h * h * aa + 2 * h,
            ua + h * aa,
        )
        aa += 5 * h
        if seen:
            total = xx + _noise(self.variance, conf)
            g, e, f = xx / total, xu / total, xa / total
            dx, dy = x - px, y - py
            px, py, u, v, a, b = px + g * dx, py + g * dy, u + e * dx, v + e * dy, a + f * dx, b + f * dy
            xx, xu, xa, uu, ua, aa = xx - g * xx, xu - g * xu, xa - g * xa, uu - e * xu, ua - e * xa, aa - f * xa
            misses = 0
        else:
            misses = min(misses + 1, self.most_misses + 1)
        lost = misses > self.most_misses
        told = (tx, ty, 0.0, 0.0) if lost else (px, py, u, v)
        return (t, px, py, u, v, a, b, xx, xu, xa, uu, ua, aa, misses, *told[:2]), (*told, a, b, lost)


def filtered(df: DataFrame, how: PointFilter | CentreFilter, keys: tuple[str, ...], x: str = "x", y: str = "y", conf: str = "conf", clock: str = "t_us") -> DataFrame:
    """df with the columns of ``how.OUT``, by key in frame order."""

    def start():
        state = None

        def step(clocks: list, xs: list, ys: list, confs: list) -> tuple[list, ...]:
            nonlocal state
            rows = []
            for row in zip(clocks, xs, ys, confs):
                state, told = how.step(state, *row)
                rows.append(told)
            return tuple(map(list, zip(*rows)))

        return step

    return ordered_scan(df, start, [clock, x, y, conf], how.OUT, keys)


def kept_points(df: DataFrame, how: PointFilter = PointFilter(), keys: tuple[str, ...] = ("session", "part")) -> DataFrame:
    """df (x, y, conf by part and frame) with kx, ky, kconf and filled: what a rig goes on with."""
    return filtered(df, how, keys)


def centres(df: DataFrame, how: CentreFilter = CentreFilter(), keys: tuple[str, ...] = ("session",)) -> DataFrame:
    """df (x, y, conf by frame) with cx, cy, vx, vy, ax, ay and lost."""
    return filtered(df, how, keys)


def forecast(axis: str, ms: Column) -> Column:
    """Where the centre of ``centres`` will be after ms, on axis x or y; where it is if ms isn't positive or it is lost."""
    s = F.greatest(ms, F.lit(0)) / 1000.0
    return F.when(F.col("lost"), F.col(f"c{axis}")).otherwise(F.col(f"c{axis}") + F.col(f"v{axis}") * s + F.col(f"a{axis}") * s * s / 2)
