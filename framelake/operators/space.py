"""From views to space: rays, triangulation, consensus between views, ground fusion of candidates."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

Camera = np.ndarray


def triangulate(points: Sequence[tuple[float, float]], cameras: Sequence[Camera]) -> np.ndarray:
    """The point in space that two or more views see, by the direct linear transform."""
    rows = [r for (u, v), p in zip(points, cameras, strict=True) for r in (u * p[2] - p[0], v * p[2] - p[1])]
    x = np.linalg.svd(np.array(rows))[2][-1]
    return x[:3] / x[3] if abs(x[3]) > 1e-12 else np.full(3, np.nan)


def reproject(point: np.ndarray, camera: Camera) -> np.ndarray:
    h = camera @ np.append(point, 1.0)
    return h[:2] / h[2] if h[2] > 0 else np.full(2, np.inf)


def ray_meeting(origins: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """The point of least squared distance to all rays."""
    d = directions / np.linalg.norm(directions, axis=1, keepdims=True)
    planes = np.eye(3)[None] - d[:, :, None] * d[:, None, :]
    return np.linalg.lstsq(planes.sum(axis=0), (planes @ origins[:, :, None]).sum(axis=0)[:, 0], rcond=None)[0]


def ground_point(pixel: tuple[float, float], camera: Camera) -> np.ndarray:
    """Where the ray of a pixel meets the floor."""
    h = camera[:, [0, 1, 3]]
    x = np.linalg.solve(h, np.array([*pixel, 1.0]))
    return x[:2] / x[2]


def consensus(candidates: Mapping[str, list[tuple[float, float, float]]], cameras: Mapping[str, Camera], gate: float, low: float = -0.75, high: float = 6.0) -> tuple[np.ndarray, dict[str, int], float] | None:
    """Point, chosen candidate of each view and mean error, from candidates (x, y, confidence) of several views.

    Every pair of candidates of two views is a hypothesis; views support it with the nearest candidate within
    ``gate`` pixels. Supported by most views, then by most confidence, then by the least error wins.
    """
    best, key = None, None
    for a, b in combinations(sorted(candidates), 2):
        for pa in candidates[a]:
            for pb in candidates[b]:
                point = triangulate([pa[:2], pb[:2]], [cameras[a], cameras[b]])
                chosen: dict[str, int] = {}
                for v, ps in candidates.items():
                    off = [float(np.linalg.norm(reproject(point, cameras[v]) - p[:2])) for p in ps]
                    if off and min(off) <= gate:
                        chosen[v] = int(np.argmin(off))
                if len(chosen) < 2:
                    continue
                views = sorted(chosen)
                again = triangulate([candidates[v][chosen[v]][:2] for v in views], [cameras[v] for v in views])
                error = float(np.mean([np.linalg.norm(reproject(again, cameras[v]) - candidates[v][chosen[v]][:2]) for v in views]))
                if not np.isfinite(again).all() or not low <= again[2] <= high:
                    continue
                score = (len(chosen), sum(candidates[v][chosen[v]][2] for v in views), -error)
                if key is None or score > key:
                    best, key = (again, chosen, error), score
    return best


def select_balls(candidates: DataFrame, cameras: Mapping[str, Sequence[Sequence[float]]], gate: float = 30.0) -> DataFrame:
    """segment, frame, x, y, z, views, error of the ball in each frame from candidates (segment, frame, view, x, y, confidence)."""
    matrices = {v: np.array(m, float) for v, m in cameras.items()}

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        views = {v: list(zip(g["x"], g["y"], g["confidence"], strict=True)) for v, g in rows.groupby("view") if v in matrices}
        found = consensus(views, matrices, gate)
        head = [rows["segment"].iloc[0], rows["frame"].iloc[0]]
        out = [] if found is None else [(*head, *found[0].tolist(), len(found[1]), found[2])]
        return pd.DataFrame(out, columns=["segment", "frame", "x", "y", "z", "views", "error"])

    types = dict(candidates.dtypes)
    return candidates.groupBy("segment", "frame").applyInPandas(run, f"segment {types['segment']}, frame {types['frame']}, x double, y double, z double, views long, error double")


def follow_centres(boxes: DataFrame, gate: float = 100.0, look_back: int = 10) -> DataFrame:
    """Track of each box (segment, frame, det, x, y): the globally nearest pairs of box and recent track first, then new tracks.

    A track may take several boxes of one frame; the last one taken is its place.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna(subset="frame").sort_values(["frame", "det"])
        frames, dets, xs, ys = (rows[c].to_numpy() for c in ("frame", "det", "x", "y"))
        cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(rows)]
        last: dict[int, tuple] = {}
        out, fresh = [], 0
        for a, b in zip(cuts[:-1], cuts[1:], strict=True) if len(rows) else ():
            frame, now, x, y = frames[a], dets[a:b].tolist(), xs[a:b], ys[a:b]
            # Frames only grow, so a track out of reach stays so.
            last = {t: p for t, p in last.items() if frame - p[0] <= look_back}
            taken: dict[int, int] = {}
            if last:
                tracks, places = list(last), np.array([p[1:] for p in last.values()])
                far = np.hypot(x[:, None] - places[:, 0], y[:, None] - places[:, 1])
                i, j = np.nonzero(far < gate)
                for _, det, t in sorted(zip(far[i, j].tolist(), [now[k] for k in i.tolist()], [tracks[k] for k in j.tolist()], strict=True)):
                    taken.setdefault(det, t)
            for det in now:
                if det not in taken:
                    taken[det], fresh = fresh, fresh + 1
            for det, cx, cy in zip(now, x.tolist(), y.tolist(), strict=True):
                last[taken[det]] = (frame, cx, cy)
                out.append(taken[det])
        return pd.DataFrame({"segment": rows["segment"], "frame": frames, "det": dets, "track": np.array(out, np.int64)})

    types = dict(boxes.dtypes)
    return boxes.groupBy("segment").applyInPandas(run, f"segment {types['segment']}, frame {types['frame']}, det {types['det']}, track long")


def best_chains(candidates: DataFrame, gap: int = 2, step: float = 48.0, least: int = 3) -> DataFrame:
    """Candidates (segment, frame, x, y, confidence) that chain up over at least ``least`` frames; the most confident of each frame."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["frame", "confidence", "x", "y"], ascending=[True, False, True, True]).reset_index(drop=True)
        chains: list[list[int]] = []
        for i, r in rows.iterrows():
            for c in chains:
                p = rows.loc[c[-1]]
                d = r["frame"] - p["frame"]
                if 0 < d <= gap and np.hypot(r["x"] - p["x"], r["y"] - p["y"]) <= step * d:
                    c.append(i)
                    break
            else:
                chains.append([i])
        kept = rows.loc[sorted(i for c in chains if len(c) >= least for i in c)]
        return kept.drop_duplicates("frame")

    schema = ", ".join(f"{c} {t}" for c, t in candidates.dtypes)
    return candidates.groupBy("segment").applyInPandas(run, schema)


def clusters(points: DataFrame, keys: Sequence[str], width: float = 200.0) -> DataFrame:
    """One cluster where x spans less than ``width``, else two around the middle; median place of each."""
    w = Window.partitionBy(*keys)
    low, high = F.min("x").over(w), F.max("x").over(w)
    placed = points.withColumn("cluster", F.when(high - low < width, 0).when(F.col("x") < (low + high) / 2, 0).otherwise(1))
    return placed.groupBy(*keys, "cluster").agg(F.percentile("x", 0.5).alias("x"), F.percentile("y", 0.5).alias("y"), F.count("*").alias("n"))


def agree(candidates: DataFrame, keys: Sequence[str], band: float = 0.5, spread: float = 0.45) -> DataFrame:
    """Median of the candidates (x, y, z, distance) within ``band`` of the least distance; ambiguous where they spread."""
    w = Window.partitionBy(*keys)
    near = candidates.withColumn("least_", F.min("distance").over(w)).where(F.col("distance") <= F.col("least_") + band)
    middle = near.withColumns({f"m{c}": F.percentile(c, 0.5).over(w) for c in "xyz"})
    off = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{c}"), 2) for c in "xyz"), F.lit(0.0)))
    return middle.groupBy(*keys).agg(*[F.first(f"m{c}").alias(c) for c in "xyz"], F.count("*").alias("n"), (F.max(off) > spread).alias("ambiguous"))


def bone_lengths(joints: DataFrame, bones: Sequence[tuple[int, int]], least: int = 20, error: float = 20.0) -> DataFrame:
    """Usual length of each bone of each track, from reliable frames of ``joints`` (track, frame, joints, error_px, predicted)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in bones]))
    rows = joints.where(~F.coalesce("predicted", F.lit(False)) & (F.col("error_px") <= error)).select("track", "joints", pairs.alias("bone"))
    a, b = F.get("joints", F.col("bone.a")), F.get("joints", F.col("bone.b"))
    size = F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return rows.withColumn("length", size).where("length between 0.01 and 1.25").groupBy("track", F.col("bone.a").alias("a"), F.col("bone.b").alias("b")).agg(F.percentile("length", 0.5).alias("length"), F.count("*").alias("n")).where(F.col("n") >= max(3, least))


def per_segment(f: Callable[[pd.DataFrame], pd.DataFrame], rows: DataFrame, schema: str) -> DataFrame:
    """A numeric rule over all rows of a segment, in frame order."""
    return rows.groupBy("segment").applyInPandas(lambda g: f(g.sort_values("frame")), schema)
