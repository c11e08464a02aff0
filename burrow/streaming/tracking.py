"""Live Kalman filters on streams: the steps of ``burrow.operators.tracking`` over the state store."""

from __future__ import annotations

from pyspark.sql import DataFrame

from burrow.operators.tracking import CentreFilter, PointFilter
from burrow.streaming.stateful import Steps, stepped


class _Filter(Steps):
    reads = ["x", "y", "conf"]

    def __init__(self, how: PointFilter | CentreFilter):
        self.how = how
        self.state, self.out = how.STATE, f"frame long, t_us long, {how.OUT}"

    def row(self, state, now_ms, t_us, frame, x, y, conf):
        state, told = self.how.step(state, t_us, x, y, conf)
        return state, [(frame, t_us, *told)]


def kept_points(df: DataFrame, how: PointFilter = PointFilter(), keys: tuple[str, ...] = ("session", "part"), late: str | None = None) -> DataFrame:
    """Each frame's place, confidence and whether it is predicted, by part."""
    return stepped(df, _Filter(how), keys, late)


def centres(df: DataFrame, how: CentreFilter = CentreFilter(), keys: tuple[str, ...] = ("session",), late: str | None = None) -> DataFrame:
    """Each frame's centre, velocity, acceleration and whether it is lost."""
    return stepped(df, _Filter(how), keys, late)
