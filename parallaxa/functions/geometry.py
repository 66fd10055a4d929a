"""Cameras, rays and grids as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Least depth in front of a camera, least angle between two rays of a point.
LEAST_DEPTH, LEAST_PARALLAX = 1e-9, 1e-4


def camera_point(r: list[Column], t: list[Column], p: list[Column]) -> list[Column]:
    """R p + t with the rotation in row order."""
    return [r[3 * i] * p[0] + r[3 * i + 1] * p[1] + r[3 * i + 2] * p[2] + t[i] for i in range(3)]


def project(point: list[Column], k: dict[str, Column]) -> tuple[Column, Column]:
    """Pixel of a point in camera axes with radial (k1, k2) and tangential (p1, p2) distortion; null behind the camera."""
    ahead = point[2] > LEAST_DEPTH
    x, y = F.when(ahead, point[0] / point[2]), F.when(ahead, point[1] / point[2])
    r2 = x * x + y * y
    radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2
    u = x * radial + 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x)
    v = y * radial + k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y
    return k["fx"] * u + k["cx"], k["fy"] * v + k["cy"]


def undistort(u: Column, v: Column, k: dict[str, Column], rounds: int = 10) -> tuple[Column, Column]:
    """Normalized coordinates of a pixel: the distortion undone by fixed-point rounds, folded over an array."""
    x0, y0 = (u - k["cx"]) / k["fx"], (v - k["cy"]) / k["fy"]

    def step(s: Column, _: Column) -> Column:
        x, y = s["x"], s["y"]
        r2 = x * x + y * y
        radial = 1 + k["k1"] * r2 + k["k2"] * r2 * r2
        dx = 2 * k["p1"] * x * y + k["p2"] * (r2 + 2 * x * x)
        dy = k["p1"] * (r2 + 2 * y * y) + 2 * k["p2"] * x * y
        return F.struct(((x0 - dx) / radial).alias("x"), ((y0 - dy) / radial).alias("y"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.struct(x0.alias("x"), y0.alias("y")), step)
    return found["x"], found["y"]


def camera_centre(r: list[Column], t: list[Column]) -> list[Column]:
    """-R'T."""
    return [-(r[i] * t[0] + r[3 + i] * t[1] + r[6 + i] * t[2]) for i in range(3)]


def rotation_of_quaternion(w: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y),
        2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x),
        2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y),
    ]


def quaternion_of_rotation(r: list[Column]) -> Column:
    """Struct w, x, y, z with w >= 0 (and the first non-zero of x, y, z positive where w is 0)."""
    trace = r[0] + r[4] + r[8]

    def of(scale: Column, w: Column, x: Column, y: Column, z: Column) -> Column:
        return F.struct((w / scale).alias("w"), (x / scale).alias("x"), (y / scale).alias("y"), (z / scale).alias("z"))

    s0, s1 = F.sqrt(F.greatest(trace + 1, F.lit(0.0))) * 2, F.sqrt(F.greatest(1 + r[0] - r[4] - r[8], F.lit(0.0))) * 2
    s2, s3 = F.sqrt(F.greatest(1 + r[4] - r[0] - r[8], F.lit(0.0))) * 2, F.sqrt(F.greatest(1 + r[8] - r[0] - r[4], F.lit(0.0))) * 2
    q = (
        F.when(trace > 0, of(s0, s0 * s0 / 4, r[7] - r[5], r[2] - r[6], r[3] - r[1]))
        .when((r[0] > r[4]) & (r[0] > r[8]), of(s1, r[7] - r[5], s1 * s1 / 4, r[1] + r[3], r[2] + r[6]))
        .when(r[4] > r[8], of(s2, r[2] - r[6], r[1] + r[3], s2 * s2 / 4, r[5] + r[7]))
        .otherwise(of(s3, r[3] - r[1], r[2] + r[6], r[5] + r[7], s3 * s3 / 4))
    )
    first = F.when(q["w"] != 0, q["w"]).when(q["x"] != 0, q["x"]).when(q["y"] != 0, q["y"]).otherwise(q["z"])
    sign = F.when(first < 0, -1.0).otherwise(1.0)
    return F.struct(*[(q[c] * sign).alias(c) for c in "wxyz"])


def parallax(a: list[Column], b: list[Column]) -> Column:
    """Angle between two rays in radians."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    size = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / (size(a) * size(b)))))


def grid_cell(x: Column, extent: Column, cells: int) -> Column:
    """min(cells - 1, int(x / extent * cells)) in single precision."""
    share = x.cast("float") / extent.cast("float") * F.lit(float(cells)).cast("float")
    return F.least(F.lit(cells - 1), F.floor(share).cast("int"))


def spatial_cell(x: Column, radius: float) -> Column:
    return F.floor(x / F.lit(float(radius))).cast("bigint")


def angle_class(degrees: Column) -> Column:
    """-1 outside 20 to 60 degrees, else 0 up to 35, 1 up to 50, 2 beyond."""
    return F.when((degrees < 20) | (degrees > 60), -1).when(degrees <= 35, 0).when(degrees <= 50, 1).otherwise(2)


def image_region(x: Column, y: Column) -> Column:
    """Of unit coordinates: 4 in the centre third, else the quadrant 0 to 3."""
    third = lambda v: (v >= 1 / 3) & (v <= 2 / 3)
    return F.when(third(x) & third(y), 4).otherwise((x >= 0.5).cast("int") + 2 * (y >= 0.5).cast("int"))
