"""Head pose from six face points: the rotation under which a fixed head model is seen where the points are.

A pinhole camera with the image's width as focal length and its middle as centre, without distortion. A batch of faces is
solved at once: a linear start from the projection equations (its rotation made orthogonal), then damped Gauss-Newton steps
on rotation and shift until the reprojection error settles.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Nose tip, chin, outer corner of the left and right eye, left and right corner of the mouth, in the head's units.
MODEL = np.array([(0.0, 0.0, 0.0), (0.0, -63.6, -12.5), (-43.3, 32.7, -26.0), (43.3, 32.7, -26.0), (-28.9, -28.9, -24.1), (28.9, -28.9, -24.1)])


def _cross(v: np.ndarray) -> np.ndarray:
    """The matrices of the cross product with each vector."""
    z = np.zeros(len(v))
    return np.stack([z, -v[:, 2], v[:, 1], v[:, 2], z, -v[:, 0], -v[:, 1], v[:, 0], z], 1).reshape(-1, 3, 3)


def _turn(w: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors."""
    a = np.linalg.norm(w, axis=1)
    k = _cross(w / np.where(a == 0, 1, a)[:, None])
    s, c = np.sin(a)[:, None, None], np.cos(a)[:, None, None]
    return np.eye(3) + s * k + (1 - c) * k @ k


def _start(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and shift that solve the projection equations of points p (faces, 6, 2) in the least squares sense."""
    m = np.concatenate([MODEL / 50.0, np.ones((6, 1))], 1)
    zero = np.zeros((len(p), 6, 4))
    x = np.broadcast_to(m, (len(p), 6, 4))
    rows = np.concatenate([np.concatenate([x, zero, -p[..., :1] * x], 2), np.concatenate([zero, x, -p[..., 1:] * x], 2)], 1)
    h = np.linalg.svd(rows)[2][:, -1].reshape(-1, 3, 4)
    h = h * np.where((h[:, 2:3] @ m.T[None])[:, :, :].mean(2, keepdims=True) < 0, -1.0, 1.0)  # in front of the camera
    u, s, v = np.linalg.svd(h[:, :, :3])
    flip = np.eye(3)[None].repeat(len(p), 0)
    flip[:, 2, 2] = np.sign(np.linalg.det(u @ v))
    return u @ flip @ v, h[:, :, 3] / np.maximum(s.mean(1), 1e-300)[:, None] * 50.0


def solve(p: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rotations, shifts, whether a pose in front of the camera was found) for points (faces, 6, 2) in focal lengths."""
    with np.errstate(all="ignore"):
        r, t = _start(p)
        damp, err = np.full(len(p), 1e-3), None
        for _ in range(rounds):
            turned = MODEL @ r.transpose(0, 2, 1)
            q = turned + t[:, None]
            miss = (q[..., :2] / q[..., 2:] - p).reshape(len(p), 12)
            err = (miss**2).sum(1)
            inv = 1 / q[..., 2]
            by_q = np.zeros((len(p), 6, 2, 3))
            by_q[..., 0, 0] = by_q[..., 1, 1] = inv
            by_q[..., 0, 2], by_q[..., 1, 2] = -q[..., 0] * inv**2, -q[..., 1] * inv**2
            turn = -_cross(turned.reshape(-1, 3)).reshape(len(p), 6, 3, 3)
            j = np.concatenate([by_q @ turn, by_q], 3).reshape(len(p), 12, 6)
            a = j.transpose(0, 2, 1) @ j
            diag = np.einsum("nii->ni", a)
            step = -np.linalg.solve(a + np.eye(6) * (damp[:, None] * diag + 1e-15)[:, :, None], (j.transpose(0, 2, 1) @ miss[..., None]))[..., 0]
            r2, t2 = _turn(step[:, :3]) @ r, t + step[:, 3:]
            q2 = MODEL @ r2.transpose(0, 2, 1) + t2[:, None]
            better = ((q2[..., :2] / q2[..., 2:] - p) ** 2).sum((1, 2)) <= err
            r, t = np.where(better[:, None, None], r2, r), np.where(better[:, None], t2, t)
            damp = np.where(better, damp / 5, damp * 5)
        ok = np.isfinite(r).all((1, 2)) & np.isfinite(err) & ((MODEL @ r.transpose(0, 2, 1) + t[:, None])[..., 2] > 0).all(1)
    return r, t, ok


def angles(r: np.ndarray) -> np.ndarray:
    """pitch, yaw, roll in degrees; roll is 0 where the head looks straight up or down its own axis."""
    s = np.hypot(r[:, 0, 0], r[:, 1, 0])
    flat = s < 1e-6
    pitch = np.where(flat, np.arctan2(-r[:, 1, 2], r[:, 1, 1]), np.arctan2(r[:, 2, 1], r[:, 2, 2]))
    roll = np.where(flat, 0.0, np.arctan2(r[:, 1, 0], r[:, 0, 0]))
    return np.degrees(np.stack([pitch, np.arctan2(-r[:, 2, 0], s), roll], 1))


def head_pose(d: DataFrame, key: str, points: str, width: str, height: str) -> DataFrame:
    """key, pitch_deg, yaw_deg, roll_deg, solve_ok. points: six structs (x, y) as shares of the image's width and height.

    Faces without all six points, or without a pose in front of the camera, have null angles and are not ok.
    """
    kind = d.schema[key].dataType.simpleString()
    flat = F.flatten(F.transform(points, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))

    def run(it):
        for pdf in it:
            out = np.full((len(pdf), 3), np.nan)
            have = np.array([p is not None and len(p) == 12 and w == w and h == h and w > 0 and h > 0 and not np.isnan(np.array(p, float)).any() for p, w, h in zip(pdf["p"], pdf["w"], pdf["h"], strict=True)], bool)
            if have.any():
                some = pdf[have]
                p = np.array(some["p"].tolist(), float).reshape(-1, 6, 2)
                w, h = some["w"].to_numpy(float)[:, None], some["h"].to_numpy(float)[:, None]
                x = np.stack([(p[..., 0] * w - w / 2) / w, (p[..., 1] * h - h / 2) / w], 2)
                if not (good := np.ptp(x, axis=1).min(1) > 0).all():  # points on a line of the image say nothing
                    x[~good] = MODEL[:, :2] / 1000
                r, _, ok = solve(x)
                out[np.flatnonzero(have)[ok & good]] = angles(r)[ok & good]
            found = pd.DataFrame(out, columns=["pitch_deg", "yaw_deg", "roll_deg"])
            yield pd.concat([pdf[["k"]].reset_index(drop=True).set_axis([key], axis=1), found.astype("Float64").mask(np.isnan(out)), pd.DataFrame({"solve_ok": ~np.isnan(out[:, 0])})], axis=1)

    rows = d.select(F.col(key).alias("k"), flat.alias("p"), F.col(width).cast("double").alias("w"), F.col(height).cast("double").alias("h"))
    return rows.mapInPandas(run, f"`{key}` {kind}, pitch_deg double, yaw_deg double, roll_deg double, solve_ok boolean")
