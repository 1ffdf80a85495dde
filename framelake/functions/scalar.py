"""Scalar functions as column expressions: time codes, geometry, scores, distances, digests, prompts."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- time ----


def frames_of(seconds: float, fps: float) -> int:
    """A threshold in seconds as frames, rounded half to even."""
    return round(seconds * fps)


def source_frame(sync: Column, frame_zero: Column) -> Column:
    """Frame of a view's own video for a common frame."""
    return sync - frame_zero


def checked_source_frame(sync: Column, frame_zero: Column, total: Column) -> Column:
    """As ``source_frame``; null outside the video."""
    f = sync - frame_zero
    return F.when((f >= 0) & (f < total), f)


def timecode_frame(code: Column, fps: int = 30) -> Column:
    """Frame of ``HH:MM:SS:FF``; null for anything else."""
    ok = code.rlike(r"^\d+:\d+:\d+:\d+$")
    part = F.split(code, ":")
    return F.when(ok, ((F.get(part, F.lit(0)).try_cast("long") * 60 + F.get(part, F.lit(1)).try_cast("long")) * 60 + F.get(part, F.lit(2)).try_cast("long")) * fps + F.get(part, F.lit(3)).try_cast("long"))


def timestamp_seconds(code: Column) -> Column:
    """Seconds of ``HH:MM:SS`` or ``HH:MM:SS.s``; null for anything else."""
    ok = code.rlike(r"^\d+(\.\d+)?:\d+(\.\d+)?:\d+(\.\d+)?$")
    part = F.split(code, ":")
    return F.when(ok, F.floor(F.get(part, F.lit(0)).try_cast("double")) * 3600 + F.floor(F.get(part, F.lit(1)).try_cast("double")) * 60 + F.get(part, F.lit(2)).try_cast("double"))


def image_key(video: Column, second: Column) -> Column:
    return F.format_string("%s,%04d", video, second)


# ---- text ----


def categories(text: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """Names of the categories of which a keyword stands in the text, in order."""
    found = [F.when(_any([text.contains(w) for w in ws]), F.lit(name)) for name, ws in words.items()]
    return F.array_compact(F.array(*found))


def _any(conditions: Sequence[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out |= c
    return out


def multiplicity(kind: Column, text: Column, word: str, times: int = 3) -> Column:
    """``times`` for a made shot whose text names the word, else 1."""
    return F.when((kind == "made") & text.contains(word), times).otherwise(1)


def prompts(names: Column, templates: Sequence[str]) -> Column:
    """Every template with the class name in it."""
    return F.array(*[F.replace(F.lit(t), F.lit("{}"), names) for t in templates])


def _sorted_keys(value: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        fields = [_sorted_keys(value[f.name], f.dataType).alias(f.name) for f in sorted(kind, key=lambda f: f.name)]
        return F.when(value.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: _sorted_keys(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_entries(F.sort_array(F.map_entries(F.transform_values(value, lambda _, x: _sorted_keys(x, kind.valueType)))))
    return value


def digest(row: Column, kind: T.DataType | None = None) -> Column:
    """SHA-256 of the row's JSON without spaces, nulls kept, keys sorted at every depth as ``kind`` (its type) names them.

    Without ``kind`` keys stand in the order of the fields.
    """
    return F.sha2(F.to_json(row if kind is None else _sorted_keys(row, kind), {"ignoreNullFields": "false"}), 256)


# ---- geometry ----


def distance(*pairs: tuple[Column, Column]) -> Column:
    total = F.lit(0.0)
    for a, b in pairs:
        total += F.pow(a - b, 2)
    return F.sqrt(total)


def inside_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Whether a ray to the right crosses the outline an odd number of times."""
    odd = F.lit(False)
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if y0 == y1:
            continue
        cross = (F.lit(y0) > y) != (F.lit(y1) > y)
        odd = odd != (cross & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0))
    return odd


def polygon_distance(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Distance to the outline, positive inside."""
    best = None
    for (x0, y0), (x1, y1) in zip(corners, [*corners[1:], corners[0]], strict=True):
        dx, dy = x1 - x0, y1 - y0
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x0) * dx + (y - y0) * dy) / (dx * dx + dy * dy)))
        d = F.sqrt(F.pow(x - (x0 + t * dx), 2) + F.pow(y - (y0 + t * dy), 2))
        best = d if best is None else F.least(best, d)
    return F.when(inside_polygon(x, y, corners), best).otherwise(-best)


def shot_zone(x: Column, y: Column, arc: Sequence[tuple[float, float]], margin: float = 0.30) -> Column:
    """inside_arc or outside_arc where clear by ``margin``, else unknown."""
    d = polygon_distance(x, y, arc)
    return F.when(d >= margin, "inside_arc").when(d <= -margin, "outside_arc").otherwise("unknown")


def project(point: Sequence[Column], camera: Sequence[Sequence[float]]) -> tuple[Column, Column]:
    """Image place of a point in space under a 3 by 4 camera matrix; null behind it."""
    u, v, w = (sum((F.lit(r[k]) * point[k] for k in range(3)), F.lit(float(r[3]))) for r in camera)
    return F.when(w > 0, u / w), F.when(w > 0, v / w)


def court_pixel(x: Column, y: Column, court: tuple[float, float] = (15.0, 28.0), canvas: tuple[int, int] = (800, 1400)) -> tuple[Column, Column]:
    """Place on a drawing of the court, scaled to fit and centred."""
    scale = math.floor(min(canvas[0] / court[0], canvas[1] / court[1]))
    ox, oy = (canvas[0] - court[0] * scale) / 2, (canvas[1] - court[1] * scale) / 2
    return (x * scale + ox).cast("int"), (y * scale + oy).cast("int")


def in_court(x: Column, y: Column, court: tuple[float, float] = (15.0, 28.0), margin: float = 0.0) -> Column:
    return x.between(-margin, court[0] + margin) & y.between(-margin, court[1] + margin)


def square_box(x1: Column, y1: Column, x2: Column, y2: Column, grow: float = 1.0) -> Column:
    """The square around a box's centre with its longer side times ``grow``."""
    half = F.greatest(x2 - x1, y2 - y1) * grow / 2
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    return F.struct((cx - half).alias("x1"), (cy - half).alias("y1"), (cx + half).alias("x2"), (cy + half).alias("y2"))


def fall_roots(z0: Column, vz: Column, level: float, g: float = 9.81) -> Column:
    """Later time at which a throw from z0 with speed vz passes ``level``; null if it never does."""
    inner = vz * vz + 2 * g * (z0 - level)
    return F.when(inner >= 0, (vz + F.sqrt(inner)) / g)


# ---- scores ----


def highlight_score(made: Column, outside: Column, team_play: Column) -> Column:
    """75 for a made shot from outside, 65 after team play, 50 for another, 10 without a make."""
    return F.when(made & outside, 75).when(made & team_play, 65).when(made, 50).otherwise(10)


def face_cost(similarity: Column, low: float = 0.55, high: float = 0.75) -> Column:
    """0 for a sure match, 1 for none, linear between; 0.5 without evidence."""
    return F.when(similarity.isNull(), 0.5).when(similarity >= high, 0.0).when(similarity <= low, 1.0).otherwise((high - similarity) / (high - low))


def softmax(scores: Column) -> Column:
    """Shares of an array of scores; the largest is taken off first."""
    e = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def cross_entropy(scores: Column, truth: Column) -> Column:
    return -F.log(F.get(softmax(scores), truth))


def focal_loss(scores: Column, truth: Column, gamma: float = 2.0) -> Column:
    p = F.get(softmax(scores), truth)
    return -F.pow(1 - p, F.lit(gamma)) * F.log(p)


def one_hot(label: Column, classes: int, smoothing: float = 0.0) -> Column:
    """Smoothed indicator vector."""
    off = smoothing / classes
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.when(i == label, 1 - smoothing + off).otherwise(off))


def binary_vector(labels: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: F.array_contains(labels, i).cast("int"))


def mix_targets(a: Column, b: Column, share: float) -> Column:
    return F.zip_with(a, b, lambda x, y: share * x + (1 - share) * y)


def cosine_rate(epoch: Column, base: float, last: float, epochs: float, warmup: float = 0.0, first: float = 0.0) -> Column:
    """Learning rate: linear from ``first`` over the warm-up, then half a cosine from ``base`` to ``last``."""
    half = (F.cos(F.lit(math.pi) * (epoch - warmup) / (epochs - warmup)) + 1) / 2
    late = last + (base - last) * half
    if not warmup:
        return late
    at_end = last + (base - last)
    return F.when(epoch < warmup, first + (at_end - first) * epoch / warmup).otherwise(late)


def step_rate(epoch: Column, base: float, factors: Sequence[tuple[float, float]]) -> Column:
    """Learning rate: base times the factor of the last step reached; steps rise."""
    out = F.lit(base)
    for start, factor in factors:
        out = F.when(epoch >= start, base * factor).otherwise(out)
    return out
