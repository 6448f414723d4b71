"""Motion geometry over landmark columns: scales and anchors, angles, facing, lean, bounding boxes, affine maps.

A point is struct(x, y, z); a hand is array<struct<x,y,z>> of 21 points; null means not detected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import medians

WRIST, THUMB_TIP, INDEX, MIDDLE, PINKY = 0, 4, 5, 9, 17
FINGERS = {"index": (5, 6, 8), "middle": (9, 10, 12), "ring": (13, 14, 16), "pinky": (17, 18, 20)}


def scales(d: DataFrame, key: str, value: str) -> DataFrame:
    """key, median_value, scale: the median of all keys' medians over the key's own."""
    per = medians(d, key, {"median_value": value})
    return per.crossJoin(F.broadcast(medians(per, None, {"g": "median_value"}))).select(key, "median_value", "g", (F.col("g") / F.col("median_value")).alias("scale"))


def normalize(d: DataFrame, key: str, value: str) -> DataFrame:
    """y: every value scaled around its key's median and shifted to the global one."""
    m = scales(d, key, value)
    return d.join(m, key).withColumn("y", (F.col(value) - F.col("median_value")) * (F.col("g") / F.col("median_value")) + F.col("g"))


def sub(a: Column, b: Column) -> Column:
    return F.struct((a["x"] - b["x"]).alias("x"), (a["y"] - b["y"]).alias("y"), (a["z"] - b["z"]).alias("z"))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return F.struct((a["y"] * b["z"] - a["z"] * b["y"]).alias("x"), (a["z"] * b["x"] - a["x"] * b["z"]).alias("y"), (a["x"] * b["y"] - a["y"] * b["x"]).alias("z"))


def length(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def point(hand: Column, i: int) -> Column:
    return F.get(hand, F.lit(i))


def joint_angle(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b; 180 if a limb has no length."""
    u, v = sub(a, b), sub(c, b)
    n = length(u) * length(v)
    return F.when(n < 1e-9, 180.0).otherwise(F.degrees(F.acos(clamp(dot(u, v) / n, -1.0, 1.0))))


def finger_angles(hand: Column) -> dict[str, Column]:
    return {name: joint_angle(*[point(hand, i) for i in at]) for name, at in FINGERS.items()}


def palm_normal(hand: Column, left: Column | bool = False) -> Column:
    """Unit normal of wrist, index and pinky base; y and z turned for left hands; null if degenerate."""
    n = cross(sub(point(hand, INDEX), point(hand, WRIST)), sub(point(hand, PINKY), point(hand, WRIST)))
    side = F.when(left if isinstance(left, Column) else F.lit(left), -1.0).otherwise(1.0)
    l = length(n)
    return F.when(l >= 1e-6, F.struct((n["x"] / l).alias("x"), (side * n["y"] / l).alias("y"), (side * n["z"] / l).alias("z")))


def facing(normal: Column) -> Column:
    return F.when(normal.isNull(), "undetermined").when(normal["z"] < -0.15, "toward_camera").when(normal["z"] > 0.15, "away_from_camera").otherwise("edge_on")


def spread(hand: Column) -> list[Column]:
    """Angles at the wrist between neighbouring finger bases."""
    base = [5, 9, 13, 17]
    return [joint_angle(point(hand, a), point(hand, WRIST), point(hand, b)) for a, b in zip(base, base[1:])]


def openness(hand: Column) -> Column:
    """Mean distance of the finger tips from the wrist over the palm's length."""
    scale = length(sub(point(hand, MIDDLE), point(hand, WRIST)))
    tips = [length(sub(point(hand, i), point(hand, WRIST))) for i in (8, 12, 16, 20)]
    return F.when(scale > 1e-9, (tips[0] + tips[1] + tips[2] + tips[3]) / 4.0 / scale)


def thumb_opposition(hand: Column) -> tuple[Column, Column]:
    scale = length(sub(point(hand, MIDDLE), point(hand, WRIST)))
    return tuple(F.when(scale > 1e-9, length(sub(point(hand, THUMB_TIP), point(hand, i))) / scale) for i in (8, 20))


def torso_lean(neck: Column, hip: Column) -> Column:
    """Degrees from upright."""
    return F.degrees(F.atan2(neck["x"] - hip["x"], hip["y"] - neck["y"]))


def eye_state(openness_: Column) -> Column:
    return F.when(openness_ < 0.02, "blink").when(openness_ <= 0.035, "squint").otherwise("open")


def affine(p: Column, dx: Column, dy: Column, degrees: Column, scale: Column) -> Column:
    """Scale, turn, then shift a point of the plane."""
    a = F.radians(degrees)
    return F.struct((dx + scale * (p["x"] * F.cos(a) - p["y"] * F.sin(a))).alias("x"), (dy + scale * (p["x"] * F.sin(a) + p["y"] * F.cos(a))).alias("y"))


def bounding_box(d: DataFrame, key: str, points: str, margin: float = 0.25) -> DataFrame:
    """Union box of all points per key with a margin, clamped to the unit square."""
    p = d.select(key, F.explode(points).alias("p"))
    b = p.groupBy(key).agg(F.min("p.x").alias("x0"), F.max("p.x").alias("x1"), F.min("p.y").alias("y0"), F.max("p.y").alias("y1"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    return b.select(key, clamp(F.col("x0") - margin * w, 0.0, 1.0).alias("x0"), clamp(F.col("y0") - margin * h, 0.0, 1.0).alias("y0"), clamp(F.col("x1") + margin * w, 0.0, 1.0).alias("x1"), clamp(F.col("y1") + margin * h, 0.0, 1.0).alias("y1"))
