"""Persons across views, frames and segments: fusion of views, tracking with a roster, registry of identities."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import matching, ranking, statistics


def fuse_views(people: DataFrame, gate: float = 1.5, weights: tuple[float, float] = (0.6, 0.4), veto: float = 0.85) -> DataFrame:
    """Groups of one person seen in several views of a frame.

    ``people`` has segment, frame, view, det, x, y (floor) and appearance. Views join in order of their number of
    people; each is assigned to the groups so far at least cost of floor distance and appearance. A pair farther
    than ``gate`` or with appearances more than ``veto`` apart never joins; who fits nowhere opens a group.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        order = rows.groupby("view")["det"].count().sort_index().sort_values(ascending=False, kind="stable").index
        groups: list[list[int]] = []
        place, look = rows[["x", "y"]].to_numpy(float), [np.asarray(a, float) for a in rows["appearance"]]
        for view in order:
            own = np.flatnonzero((rows["view"] == view).to_numpy())
            cost = np.full((len(own), len(groups)), np.inf)
            for i, r in enumerate(own):
                for j, g in enumerate(groups):
                    far = float(np.linalg.norm(place[r] - place[g].mean(axis=0)))
                    mean = np.mean([look[k] for k in g], axis=0)
                    apart = 1 - float(look[r] @ mean / max(np.linalg.norm(look[r]) * np.linalg.norm(mean), 1e-12))
                    if far <= gate and apart <= veto:
                        cost[i, j] = weights[0] * far / gate + weights[1] * apart
            pairs = dict(matching.hungarian(cost)) if len(groups) else {}
            for i, r in enumerate(own):
                if i in pairs:
                    groups[pairs[i]].append(r)
                else:
                    groups.append([r])
        out = [(rows["segment"].iloc[r], rows["frame"].iloc[r], rows["view"].iloc[r], rows["det"].iloc[r], g) for g, members in enumerate(groups) for r in members]
        return pd.DataFrame(out, columns=["segment", "frame", "view", "det", "person"])

    t = dict(people.dtypes)
    return people.groupBy("segment", "frame").applyInPandas(run, f"segment {t['segment']}, frame {t['frame']}, view {t['view']}, det {t['det']}, person long")


class Roster:
    """Tracks of at most ``most`` persons: least-cost assignment to predicted places, revival of lost tracks by appearance."""

    OUT = "track long, revived boolean"

    def __init__(self, most: int = 10, gate: float = 2.0, lost: int = 60, alike: float = 0.75, gallery: int = 50) -> None:
        self.most, self.gate, self.lost, self.alike, self.gallery = most, gate, lost, alike, gallery
        self.tracks: dict[int, dict] = {}

    def _likeness(self, track: dict, look: np.ndarray) -> float:
        mean = np.mean(track["looks"], axis=0)
        return float(look @ mean / max(np.linalg.norm(look) * np.linalg.norm(mean), 1e-12))

    def step(self, frame: int, places: np.ndarray, looks: Sequence[np.ndarray]) -> list[tuple[int | None, bool]]:
        """Track of each detection of the frame, and whether it was lost before; None when the roster is full."""
        live = [t for t, v in self.tracks.items() if frame - v["seen"] <= self.lost]
        cost = np.full((len(places), len(live)), np.inf)
        for j, t in enumerate(live):
            v = self.tracks[t]
            gap = frame - v["seen"]
            ahead = v["place"] + v["speed"] * gap
            for i, p in enumerate(places):
                far = float(np.linalg.norm(p - ahead))
                if far <= self.gate * min(3.0, 0.5 + 0.5 * gap):
                    cost[i, j] = far / self.gate + 1 - self._likeness(v, looks[i])
        pairs = {i: live[j] for i, j in matching.hungarian(cost)} if len(live) and len(places) else {}
        out: list[tuple[int | None, bool]] = []
        taken = set(pairs.values())
        for i, p in enumerate(places):
            track, revived = pairs.get(i), False
            if track is None:
                gone = [t for t in self.tracks if t not in taken]
                best = max(gone, key=lambda t: self._likeness(self.tracks[t], looks[i]), default=None)
                full = len(self.tracks) >= self.most
                if best is not None and self._likeness(self.tracks[best], looks[i]) >= (0.0 if full else self.alike) and (full or frame - self.tracks[best]["seen"] > self.lost):
                    track, revived = best, True
                elif not full:
                    track = len(self.tracks)
                    self.tracks[track] = {"place": p, "speed": np.zeros(len(p)), "seen": frame, "looks": []}
            if track is not None:
                taken.add(track)
                v = self.tracks[track]
                gap = max(1, frame - v["seen"])
                if not revived and v["looks"]:
                    v["speed"] = 0.7 * v["speed"] + 0.3 * (p - v["place"]) / gap
                elif revived:
                    v["speed"] = np.zeros(len(p))
                v["place"], v["seen"] = p, frame
                v["looks"] = [*v["looks"], looks[i]][-self.gallery :]
            out.append((track, revived))
        return out


def track_people(people: DataFrame, **settings: float) -> DataFrame:
    """segment, frame, det, track, revived of people (segment, frame, det, x, y, appearance), frames in order."""
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        roster, out = Roster(**settings), []
        for frame, now in rows.sort_values(["frame", "det"]).groupby("frame"):
            got = roster.step(int(frame), now[["x", "y"]].to_numpy(float), [np.asarray(a, float) for a in now["appearance"]])
            out += [(now["segment"].iloc[0], frame, d, t, r) for d, (t, r) in zip(now["det"], got, strict=True)]
        return pd.DataFrame(out, columns=["segment", "frame", "det", "track", "revived"]).astype({"track": "Int64"})

    t = dict(people.dtypes)
    return people.groupBy("segment").applyInPandas(run, f"segment {t['segment']}, frame {t['frame']}, det {t['det']}, {Roster.OUT}")


def face_candidates(faces: DataFrame, people: DataFrame) -> DataFrame:
    """Pairs of a face and a person of one picture whose head it may be, with their distance as cost.

    The face's centre lies in the upper 55% of the box and within 0.28 of its height from the head's usual place.
    """
    p = people.select("segment", "frame", "view", F.col("det").alias("col"), *[F.col(c).alias(f"p{c}") for c in ("x1", "y1", "x2", "y2")])
    met = faces.select("segment", "frame", "view", F.col("face").alias("row"), "cx", "cy").join(p, ["segment", "frame", "view"])
    tall = F.col("py2") - F.col("py1")
    cost = F.sqrt(F.pow(F.col("cx") - (F.col("px1") + F.col("px2")) / 2, 2) + F.pow(F.col("cy") - (F.col("py1") + 0.12 * tall), 2)) / tall
    return met.withColumn("cost", cost).where(F.col("cx").between(F.col("px1"), F.col("px2")) & F.col("cy").between(F.col("py1"), F.col("py1") + 0.55 * tall) & (F.col("cost") <= 0.28)).select("segment", "frame", "view", "row", "col", "cost")


def faces_to_people(faces: DataFrame, people: DataFrame) -> DataFrame:
    return matching.assign(face_candidates(faces, people), ["segment", "frame", "view"])


def track_quality(looks: DataFrame, spans: DataFrame) -> DataFrame:
    """Share of its span in which a track was seen and its median likeness to its mean appearance, with a verdict."""
    keys = ["segment", "track"]
    mean = statistics.mean_unit_vector(looks, keys, "appearance")
    like = looks.join(mean, keys).groupBy(*keys).agg(F.percentile(ranking.cosine(F.col("appearance"), F.col("unit")), 0.5).alias("consistency"), F.count("*").alias("seen"))
    rows = spans.join(like, keys).withColumn("coverage", F.col("seen") / (F.col("end") - F.col("start")))
    return rows.withColumn("usable", (F.col("seen") >= 4) & (F.col("coverage") >= 0.7) & (F.col("consistency") >= 0.72))


def link_segments(known: DataFrame, new: DataFrame, least: float = 0.94, margin: float = 0.08) -> DataFrame:
    """Known players (player, unit) of new tracks (segment, track, unit): clear best matches, one to one by likeness.

    Players are few (a roster), tracks many; they meet by segment through the roster listed for it.
    """
    roster = known.select(F.lit(1).alias("one_"), F.col("player").alias("col"), F.col("unit").alias("k_"))
    listed = new.select("segment").distinct().withColumn("one_", F.lit(1)).join(roster, "one_").drop("one_")
    scored = new.select("segment", F.col("track").alias("row"), "unit").join(listed, "segment").withColumn("score", ranking.cosine(F.col("unit"), F.col("k_"))).select("segment", "row", "col", "score")
    clear = matching.mutual_margin(scored, ["segment"], least, margin)
    w = Window.partitionBy("segment", "col").orderBy(F.desc("score"), "row")
    return clear.withColumn("n_", F.row_number().over(w)).where("n_ = 1").select("segment", F.col("row").alias("track"), F.col("col").alias("player"), "score")
