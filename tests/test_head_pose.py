"""Angles back from projected points, whatever the image's shape; faces that cannot be solved; token sets without a common token."""

import math
import random

import numpy as np
import pytest

from quillspan.operators import head_pose, landmarks, reports


def turn(pitch, yaw, roll):
    x, y, z = map(math.radians, (pitch, yaw, roll))
    rx = np.array([[1, 0, 0], [0, math.cos(x), -math.sin(x)], [0, math.sin(x), math.cos(x)]])
    ry = np.array([[math.cos(y), 0, math.sin(y)], [0, 1, 0], [-math.sin(y), 0, math.cos(y)]])
    rz = np.array([[math.cos(z), -math.sin(z), 0], [math.sin(z), math.cos(z), 0], [0, 0, 1]])
    return rz @ ry @ rx


def seen(angles, shift, w, h):
    q = head_pose.MODEL @ turn(*angles).T + shift
    return [(float((a / c * w + w / 2) / w), float((b / c * w + h / 2) / h)) for a, b, c in q]


def test_angles_come_back(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(300):
        a = (rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(-80, 80))
        w, h = rng.choice([(640, 480), (720, 1280), (1920, 1080)])
        rows.append((k, seen(a, np.array([rng.uniform(-60, 60), rng.uniform(-60, 60), rng.uniform(350, 1500)]), w, h), w, h))
        want[k] = a
    rows += [(1000, None, 640, 480), (1001, [(0.5, 0.5)] * 5, 640, 480), (1002, [(0.5, 0.5)] * 6, 640, 480), (1003, [(None, 0.5)] + [(0.1, 0.2)] * 5, 640, 480), (1004, rows[0][1], None, 480)]
    d = spark.createDataFrame(rows, "k long, p array<struct<x:double,y:double>>, w int, h int").repartition(3)
    got = {r.k: r for r in head_pose.head_pose(d, "k", "p", "w", "h").collect()}
    assert len(got) == 305 and all(not got[k].solve_ok and got[k].pitch_deg is None for k in range(1000, 1005))
    for k, a in want.items():
        assert got[k].solve_ok and np.allclose((got[k].pitch_deg, got[k].yaw_deg, got[k].roll_deg), a, atol=0.1), (a, got[k])
    assert head_pose.head_pose(d.limit(0), "k", "p", "w", "h").count() == 0


def test_noise_moves_angles_little():
    rng = np.random.default_rng(1)
    p = np.array([[((x - 0.5), (y - 0.5)) for x, y in seen((10, -20, 5), np.array([0, 0, 700.0]), 1000, 1000)]] * 50)
    r, _, ok = head_pose.solve(p + rng.normal(size=p.shape) * 2e-4)
    assert ok.all() and np.abs(head_pose.angles(r) - [10, -20, 5]).max() < 5


@pytest.mark.parametrize(("block", "few"), [(3, 0), (2048, 0), (4, 6), (2048, 64)])
def test_disjoint_token_sets_in_blocks(spark, block, few):
    rng = random.Random(block)
    rows, words = [], [f"{a}{b}" for a in "abcdef" for b in "xyz"]
    for k in range(25):
        hub = rng.random() < 0.5
        for _ in range(rng.randint(1, 14)):
            rows.append((f"k{k}", " ".join(rng.sample(words, rng.randint(2, 5)) + ["hub"] * hub)))
    rows += [("", "a"), (None, "b"), ("digits", "12 34"), ("one", "solo")]
    d = spark.createDataFrame(rows, "k string, w string").repartition(4)
    want = {}
    for k, _ in rows:
        sets = [s for s in {frozenset(w for w in t.split() if w.isalpha()) for q, t in rows if q == k} if s]
        want[k] = "MISSING" if not k else "SUSPECT" if any(not a & b for a in sets for b in sets) else "VALID"
    assert {r.shared: r.status for r in reports.integrity(d, "k", "w", block, few).collect()} == want


def test_landmark_frames_and_expected_hands(spark):
    rows = [("c", 0, [(0.5, 0.5, 0.0, 0.9)], [(0.1, 0.1, 0.0, None)]), ("c", 1, [(0.5, 1.2, 0.0, 0.9)], None), ("c", 2, [(0.5, 0.5, 0.0, None)], None), ("c", 3, None, None), ("d", 0, [(0.5, 0.5, 0.0, 0.5)], None)]
    point = "array<struct<x:double,y:double,z:double,visibility:double>>"
    f = landmarks.landmark_frames(spark.createDataFrame(rows, f"clip string, i int, pose {point}, hand {point}"), "clip", 25.0, "pose", "hand")
    got = {(r.clip, r.frame): r for r in f.collect()}
    assert got["c", 2].pose[0].visibility == 1.0 and got["c", 2].t == 0.08 and got["c", 0].hand[0].visibility == 1.0 and got["c", 3].pose is None
    r = {x.clip: tuple(x)[1:] for x in landmarks.detection_when_expected(f, "clip", f["pose"][0], f["hand"]).collect()}
    assert r == {"c": (4, 1, 2, 1, 50.0), "d": (1, 0, 0, 0, None)}
