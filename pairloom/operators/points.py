"""Reduction of pixel and point tables to observation and cluster summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .ordering import exact_quantiles, keyed_quantiles

ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]


def with_rotation(df: DataFrame, quaternion: Sequence[str] = ("qw", "qx", "qy", "qz")) -> DataFrame:
    """Nine rotation columns, computed once so that later algebra stays short."""
    q = [F.col(c).cast("double") for c in quaternion]
    return df.withColumns(dict(zip(ROTATION, G.rotation(*q))))


def rotation_columns() -> tuple:
    return tuple(F.col(c) for c in ROTATION)


def depth_summary(points: DataFrame, keys: Sequence[str], depth: str = "depth") -> DataFrame:
    """Count, five quantiles, mean and population deviation of the depth per key."""
    levels = {"q05": 0.05, "q25": 0.25, "median": 0.5, "q75": 0.75, "q95": 0.95}
    value = F.when(~F.isnan(F.col(depth).cast("double")), F.col(depth).cast("double"))
    rows = points.withColumn("_value", value)
    moments = rows.groupBy(F.struct(*keys).alias("_key")).agg(F.avg(depth).alias("mean"), F.stddev_pop(depth).alias("std"), F.count("_value").alias("n"))
    found = keyed_quantiles(rows, keys, ["_value"], list(levels.values())).select(F.struct(*keys).alias("_key"), F.col("_value").alias("_q"))
    return moments.join(found, "_key").select("_key.*", "mean", "std", "n", *[F.col("_q")[i].alias(name) for i, name in enumerate(levels)])


def robust_shape(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = ("x", "y", "z")) -> DataFrame:
    """Median centroid and q95-q05 extent per axis."""
    found = keyed_quantiles(points, keys, list(axes), (0.05, 0.5, 0.95))
    return found.select(
        *keys, *[F.col(a)[1].alias(f"c{a}") for a in axes], *[(F.col(a)[2] - F.col(a)[0]).alias(f"e{a}") for a in axes]
    )


def mask_summary(pixels: DataFrame, keys: Sequence[str], padding: float, width: int, height: int) -> DataFrame:
    """Area, half-open tight box, padded box clipped to the frame, centre, aspect and fill."""
    box = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("area"), F.min("col").alias("x0"), F.min("row").alias("y0"),
        (F.max("col") + 1).alias("x1"), (F.max("row") + 1).alias("y1"),
        ((F.avg("col") + 0.5) / width).alias("center_x"), ((F.avg("row") + 0.5) / height).alias("center_y"),
    )
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    pad_x, pad_y = F.ceil(w * padding), F.ceil(h * padding)
    return box.select(
        *keys, "area", "x0", "y0", "x1", "y1",
        F.greatest(F.lit(0), F.col("x0") - pad_x).alias("px0"), F.greatest(F.lit(0), F.col("y0") - pad_y).alias("py0"),
        F.least(F.lit(width), F.col("x1") + pad_x).alias("px1"), F.least(F.lit(height), F.col("y1") + pad_y).alias("py1"),
        "center_x", "center_y", (w / h).alias("aspect"), (F.col("area") / (w * h)).alias("fill"),
    )


def static_stability(observations: DataFrame, track: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Median deviation from each track's median centre, in camera and world space, and their ratio.

    Tracks with one observation are left out. Columns camera_x.. and world_x..
    """
    names = [f"{s}_{a}" for s in ("camera", "world") for a in "xyz"]
    tracked = list(dict.fromkeys([*keys, *track]))
    seen = observations.groupBy(*tracked).agg(F.count(names[0]).alias("_n")).where("_n > 1").drop("_n")
    medians = keyed_quantiles(observations, tracked, names, [0.5]).select(*tracked, *[F.col(n)[0].alias(f"m_{n}") for n in names])
    centre = medians.join(seen, tracked)
    joined = observations.join(centre, tracked)
    gaps = {s: G.norm(tuple(F.col(f"{s}_{a}") - F.col(f"m_{s}_{a}") for a in "xyz")) for s in ("camera", "world")}
    deviations = joined.select(*keys, *[g.alias(s) for s, g in gaps.items()]).unpivot(list(keys), list(gaps), "space", "value")
    medians = exact_quantiles(deviations, [*keys, "space"], "value", {"m": 0.5})
    tracks = centre.groupBy(*keys).agg(F.count(F.lit(1)).alias("tracks"))
    wide = medians.groupBy(*keys).agg(
        *[F.max(F.when(F.col("space") == s, F.col("m"))).alias(f"{s}_median") for s in gaps]
    )
    out = wide.join(tracks, list(keys)) if keys else wide.withColumn("tracks", tracks.scalar())
    return out.withColumns(
        {
            "ratio": F.col("world_median") / F.greatest("camera_median", F.lit(1e-12)),
            "world_more_stable": F.col("world_median") < F.col("camera_median"),
        }
    )


def camera_motion(poses: DataFrame, cluster: str = "cluster_id", frame: str = "frame") -> DataFrame:
    """Path and rotation summary of each cluster's camera.

    One row per frame enters the window, so a group is bounded by the frame count
    of a cluster.
    """
    posed = with_rotation(poses)
    here, turn = G.vector("p"), rotation_columns()
    order = Window.partitionBy(cluster).orderBy(frame)
    state = F.struct(*[c.alias(n) for n, c in zip(["px", "py", "pz", *ROTATION], [*here, *turn])])
    steps = posed.withColumn("_before", F.lag(state).over(order))
    before = tuple(F.col(f"_before.p{a}") for a in "xyz")
    turned = tuple(F.col(f"_before.{c}") for c in ROTATION)
    steps = steps.withColumns(
        {
            "_step": G.norm(G.subtract(here, before)),
            "_turn": F.when(F.col("_before").isNotNull(), G.angle_degrees(turned, turn)),
            "_far": G.norm(here),
            "_state": state,
        }
    )
    per = steps.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("frames"), F.min_by("_state", frame).alias("_first"), F.max_by("_state", frame).alias("_last"),
        F.sum("_step").alias("path_length"), F.median("_step").alias("step_median"), F.max("_step").alias("step_max"),
        F.median("_turn").alias("turn_median"), F.max("_turn").alias("turn_max"), F.avg("_far").alias("mean_distance"),
    )
    ends = [tuple(F.col(f"{e}.p{a}") for a in "xyz") for e in ("_first", "_last")]
    turns = [tuple(F.col(f"{e}.{c}") for c in ROTATION) for e in ("_first", "_last")]
    total = G.norm(G.subtract(ends[1], ends[0]))
    return per.where("frames > 1").select(
        cluster, "frames", total.alias("displacement"), "path_length", "step_median", "step_max",
        G.angle_degrees(turns[0], turns[1]).alias("rotation"), "turn_median", "turn_max", "mean_distance",
        (total / F.col("mean_distance")).alias("normalized_displacement"),
    )
