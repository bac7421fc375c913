"""Pair features, named systems and the checks on both."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from .pairs import log_ratio, suppress_still_rotation

# Depth levels and the feature groups of the named systems.
DEPTH_LEVELS = ("d05", "d25", "d50", "d75", "d95")
APPEARANCE = ("cosine",)
PLANE = ("gap", "dx", "dy", "dxy", "area_ratio", "area_mean", "crop_ratio", "crop_mean", "aspect_ratio", "visibility_ratio", "visibility_min")
DEPTH = ("depth_05", "depth_25", "depth_50", "depth_75", "depth_95", "depth_spread", "depth_rate")
GEOMETRY = ("cx", "cy", "cz", "distance", "distance_rate", "ex", "ey", "ez", "extent", "ex_ratio", "ey_ratio", "ez_ratio")
POSE = ("camera_displacement", "camera_rotation", "camera_displacement_scaled")
SHARED = APPEARANCE + PLANE + DEPTH


def geometry_names(space: str) -> tuple[str, ...]:
    return tuple(f"{space}_{n}" for n in GEOMETRY)


SYSTEMS: dict[str, tuple[str, ...]] = {
    "A_appearance": APPEARANCE,
    "B_plane": APPEARANCE + PLANE,
    "C_camera": SHARED + geometry_names("camera"),
    "D_world": SHARED + geometry_names("world"),
    "G_camera_only": DEPTH + geometry_names("camera"),
    "G_world_only": DEPTH + geometry_names("world"),
    "P_pose_only": POSE,
    "S_shuffled": SHARED + geometry_names("shuffled"),
}


def with_endpoints(pairs: DataFrame, observations: DataFrame, fields: Sequence[str],
                   cluster: str = "cluster_id", key: str = "observation_id") -> DataFrame:
    """Attach ``fields`` of both endpoints. Cluster is part of the key, so a table kept
    partitioned or bucketed by cluster needs no further shuffle."""

    def side(suffix: str) -> DataFrame:
        return observations.select(
            cluster, F.col(key).alias(f"{key}_{suffix}"), *[F.col(f).alias(f"{f}_{suffix}") for f in fields]
        )

    return pairs.join(side("a"), [cluster, f"{key}_a"]).join(side("b"), [cluster, f"{key}_b"])


def unit_embedding(embedding: Column) -> Column:
    """Scaled to length one, once per observation; a zero vector is an error."""
    wide = F.transform(embedding, lambda x: x.cast("double"))
    length = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda total, x: total + x * x))
    safe = F.when(length > 0, length).otherwise(F.raise_error(F.lit("zero embedding")).cast("double"))
    return F.transform(wide, lambda x: x / safe)


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def shared_features() -> dict[str, Column]:
    """The nineteen features every geometric system shares, over ``<field>_a`` and ``<field>_b``."""
    a, b = (lambda n: F.col(f"{n}_a")), (lambda n: F.col(f"{n}_b"))
    gap = F.col("gap").cast("double")
    dx, dy = F.abs(a("mx") - b("mx")), F.abs(a("my") - b("my"))
    crop = [s("crop_w") * s("crop_h") for s in (a, b)]
    depth = {n: F.abs(a(n) - b(n)) for n in DEPTH_LEVELS}
    spread = F.abs((a("d75") - a("d25")) - (b("d75") - b("d25")))
    return {
        "cosine": cosine(a("unit"), b("unit")),
        "gap": gap, "dx": dx, "dy": dy, "dxy": F.hypot(dx, dy),
        "area_ratio": log_ratio(a("area"), b("area")),
        "area_mean": (F.log1p(a("area")) + F.log1p(b("area"))) / 2,
        "crop_ratio": log_ratio(*crop),
        "crop_mean": (F.log1p(crop[0].cast("double")) + F.log1p(crop[1].cast("double"))) / 2,
        "aspect_ratio": log_ratio(a("aspect"), b("aspect")),
        "visibility_ratio": log_ratio(a("visibility"), b("visibility")),
        "visibility_min": F.log1p(F.least(a("visibility"), b("visibility")).cast("double")),
        **{f"depth_{n[1:]}": c for n, c in depth.items()},
        "depth_spread": spread, "depth_rate": depth["d50"] / gap,
    }


def geometry_features(space: str, center: Sequence[str], extent: Sequence[str]) -> dict[str, Column]:
    """The twelve centre and extent features in one coordinate space."""
    gap = F.col("gap").cast("double")
    dc = [F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) for n in center]
    de = [F.abs(F.col(f"{n}_a") - F.col(f"{n}_b")) for n in extent]
    far = G.norm(tuple(dc))
    values = [*dc, far, far / gap, *de, G.norm(tuple(de)), *[log_ratio(F.col(f"{n}_a"), F.col(f"{n}_b")) for n in extent]]
    return dict(zip(geometry_names(space), values))


def pose_features(position: Sequence[str], rotation: Sequence[str]) -> dict[str, Column]:
    """Camera displacement, rotation, and displacement over the mean distance to the origin."""
    p = [tuple(F.col(f"{n}_{s}") for n in position) for s in "ab"]
    r = [tuple(F.col(f"{n}_{s}") for n in rotation) for s in "ab"]
    moved = G.norm(G.subtract(p[0], p[1]))
    far = (G.norm(p[0]) + G.norm(p[1])) / 2
    return {
        "camera_displacement": moved,
        "camera_rotation": suppress_still_rotation(moved, G.angle_degrees(*r)),
        "camera_displacement_scaled": F.when(far > 0, moved / far).otherwise(0.0),
    }


def system_matrix(wide: DataFrame, system: str, keys: Sequence[str] = ("pair_id",),
                  systems: Mapping[str, Sequence[str]] = SYSTEMS) -> DataFrame:
    """Exactly the allowed features of one system, in order."""
    missing = [f for f in systems[system] if f not in wide.columns]
    if missing:
        raise ValueError(f"system {system} lacks {missing}")
    return wide.select(*keys, *systems[system])


def system_catalog(spark, systems: Mapping[str, Sequence[str]] = SYSTEMS) -> DataFrame:
    rows = [(s, i, f) for s, features in systems.items() for i, f in enumerate(features)]
    return spark.createDataFrame(rows, "system string, position int, feature string")


def catalog_audit(catalog: DataFrame, twins: tuple[str, str], pose_only: str) -> DataFrame:
    """Checks on the catalog: equal widths and one-to-one features of the twin systems,
    pose scalars nowhere else, no feature twice in a system."""
    first, second = twins
    plain = F.regexp_replace("feature", "^(camera|world|shuffled)_", "")
    a, b = F.col("system") == first, F.col("system") == second
    per_place = catalog.where(a | b).groupBy("position").agg(F.count_distinct(plain).alias("names"), F.count(F.lit(1)).alias("systems"))
    pose = catalog.groupBy("feature").agg(F.bool_or(F.col("system") == pose_only).alias("pose"), F.count(F.lit(1)).alias("uses"))
    twice = catalog.groupBy("system", "feature").agg(F.count(F.lit(1)).alias("n"))
    checks = {
        "twin_widths": catalog.agg((F.count_if(a) == F.count_if(b)).alias("passed")),
        "twin_correspondence": per_place.agg(F.bool_and((F.col("names") == 1) & (F.col("systems") == 2)).alias("passed")),
        "pose_disjoint": pose.agg(F.bool_and(~F.col("pose") | (F.col("uses") == 1)).alias("passed")),
        "features_unique": twice.agg((F.max("n") == 1).alias("passed")),
    }
    out = None
    for name, row in checks.items():
        part = row.select(F.lit(name).alias("check_name"), "passed")
        out = part if out is None else out.unionByName(part)
    return out
