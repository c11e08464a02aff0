"""Which clock a recording has, how plausible it is, and whether its zones can be recomputed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from burrow.operators.series import SESSION
from burrow.operators.tracks import fits_frame

#: Plausible intervals between frames in ms, and the spread (deviation over median) from which a rate varies.
PLAUSIBLE_MS, VARIES = (5.0, 1000.0), 0.05
#: By how much a rate that a user gives may differ.
DIFFERS = 0.05


def measured(times: DataFrame, clock: str = "t_ms", order: str = "frame") -> DataFrame:
    """session, n, fps, vfr, backward, step_ms: of a series of times; fps 0 without two different ones. Absent times are left out."""
    t = times.where(F.col(clock).isNotNull() & ~F.isnan(F.col(clock).cast("double")))
    d = t.withColumn("step", F.col(clock) - F.lag(clock).over(Window.partitionBy(SESSION).orderBy(order)))
    positive = F.when(F.col("step") > 0, F.col("step"))
    median = F.percentile(positive, 0.5)
    out = d.groupBy(SESSION).agg(F.count("*").alias("n"), F.max(clock).alias("last_ms"), F.count_if(F.col("step") < 0).alias("backward"), median.alias("step_ms"), F.stddev_pop(positive).alias("spread"))
    return out.select(SESSION, "n", "last_ms", F.coalesce(1000.0 / F.col("step_ms"), F.lit(0.0)).alias("fps"), F.coalesce(F.col("spread") / F.col("step_ms") > VARIES, F.lit(False)).alias("vfr"), "backward", "step_ms")


def _implausible(step_ms: Column) -> Column:
    return F.coalesce((step_ms < PLAUSIBLE_MS[0]) | (step_ms > PLAUSIBLE_MS[1]), F.lit(False))


def clock_models(sessions: DataFrame, recorded: DataFrame, stamps: DataFrame) -> DataFrame:
    """session, source, fps, vfr, warnings (an array of words) by the ladder of clocks.

    sessions has session, container_fps, container_frames (nulls: no container that can be read) and user_fps; recorded and stamps have session, frame, t_ms.
    The file's own times come first, then the container's stamps, then its rate (the user's, if it differs by more than 5 %), then the
    user's; without any, frames only have their index. A series needs two times, stamps also one above 0.
    Warnings: backward, implausible, no_times (the file has none), no_stamps, user_differs (stamps were used though the user's rate differs),
    user_overrides, count_differs (rows and the container's frames), no_rate.
    """
    a = measured(recorded).select(SESSION, *(F.col(c).alias(f"a_{c}") for c in ("n", "fps", "vfr", "backward", "step_ms")))
    b = measured(stamps).select(SESSION, *(F.col(c).alias(f"b_{c}") for c in ("n", "fps", "vfr", "backward", "step_ms", "last_ms")))
    d = sessions.join(a, SESSION, "left").join(b, SESSION, "left")
    opened = F.col("container_frames").isNotNull()
    user, rate = F.col("user_fps") > 0, F.col("container_fps") > 0
    yes = lambda c: F.coalesce(c, F.lit(False))
    has_a = yes(F.col("a_n") >= 2)
    has_b = ~has_a & opened & yes((F.col("b_n") >= 2) & (F.col("b_last_ms") > 0))
    has_c = ~has_a & ~has_b & opened & yes(rate)
    overrides = has_c & yes(user & (F.abs(F.col("container_fps") - F.col("user_fps")) / F.col("container_fps") > DIFFERS))
    has_u = ~has_a & ~has_b & ~has_c & yes(user)
    source = F.when(has_a, "recorded").when(has_b, "container_pts").when(overrides, "user").when(has_c, "container_fps").when(has_u, "user").otherwise("index")
    fps = F.when(has_a, F.col("a_fps")).when(has_b, F.col("b_fps")).when(overrides | has_u, F.col("user_fps")).when(has_c, F.col("container_fps")).otherwise(0.0)
    step = F.when(has_a, F.col("a_step_ms")).when(has_b, F.col("b_step_ms")).when(has_c, 1000.0 / F.nullif(fps, F.lit(0.0)))
    told = {
        "backward": (has_a & yes(F.col("a_backward") > 0)) | (has_b & yes(F.col("b_backward") > 0)),
        "implausible": _implausible(step),
        "no_times": ~has_a & yes(F.col("a_n").isNull()),
        "no_stamps": ~has_a & ~has_b & opened,
        "user_differs": has_b & yes(user & (F.col("b_fps") > 0) & (F.abs(F.col("b_fps") - F.col("user_fps")) / F.col("b_fps") > DIFFERS)),
        "user_overrides": overrides,
        "count_differs": (has_a & opened & yes(F.col("a_n") != F.col("container_frames"))) | (has_b & yes(F.col("b_n") != F.col("container_frames"))),
        "no_rate": source == "index",
    }
    warnings = F.array_compact(F.array(*(F.when(c, F.lit(w)) for w, c in told.items())))
    vfr = F.when(has_a, F.col("a_vfr")).when(has_b, F.col("b_vfr")).otherwise(False)
    return d.select(SESSION, source.alias("source"), fps.cast("double").alias("fps"), vfr.alias("vfr"), warnings.alias("warnings"))


def rezoning(frames: DataFrame, spaces: DataFrame, location: str = "location") -> DataFrame:
    """session, fits, rezone: whether a recording's zones are to be computed anew.

    spaces has session, width, height and edited (whether the user changed the zones). They are, if the user changed them; else not
    if the recording has zones of its own and its points lie outside the declared frame, for then zones and points are in different spaces.
    """
    absent = F.lower(F.trim(location)).isin("", "na", "none") | F.col(location).isNull()
    d = frames.join(spaces.select(SESSION, "width", "height"), SESSION)
    fits = fits_frame(d.withColumns({"x": F.col("x") / F.col("width") * 1e4, "y": F.col("y") / F.col("height") * 1e4}), 1e4, 1e4)
    has = frames.groupBy(SESSION).agg(F.max(~absent).alias("has"))
    j = spaces.join(has, SESSION, "left").join(fits.select(SESSION, "fits"), SESSION, "left")
    ok = F.coalesce("fits", F.lit(True))
    return j.select(SESSION, ok.alias("fits"), (F.coalesce("edited", F.lit(False)) | ok | ~F.coalesce("has", F.lit(False))).alias("rezone"))


def rezoned(frames: DataFrame, decision: DataFrame, computed: str, location: str = "location", out: str = "zone") -> DataFrame:
    """frames with out: the computed zone where a session's zones are computed anew, else the recorded one."""
    return frames.join(decision.select(SESSION, "rezone"), SESSION, "left").withColumn(out, F.when(F.coalesce("rezone", F.lit(True)), F.col(computed)).otherwise(F.col(location))).drop("rezone")
