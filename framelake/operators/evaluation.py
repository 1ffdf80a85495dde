"""Detections against annotations: tolerance matches, extras, diagnoses, figures by category."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import matching


def expected_types(spark, table: Mapping[str, Sequence[str]]) -> DataFrame:  # noqa: ANN001
    """category, type, rank: which detected types an annotated category may match, in order."""
    return spark.createDataFrame([(c, t, i) for c, ts in table.items() for i, t in enumerate(ts)], "category string, type string, rank int")


def match_within(truth: DataFrame, found: DataFrame, expected: DataFrame, tolerance: int, actors: bool = True) -> DataFrame:
    """For each annotation (truth_id, category, start, ids) the nearest detection (det_id, type, frame, actor).

    The first expected type with any detection in reach decides. Matches are not exclusive. With ``actors``, a
    detection must name one of the annotation's ids. Of the detections of one frame (type and actor) only the first by
    id can be nearest, so an annotation meets no more of them than it has frames in reach, and ids.
    """
    keys = ["type", "actor"] if actors else ["type"]
    wanted = truth.select("truth_id", "category", "start", "ids").join(expected, "category")
    if actors:
        wanted = wanted.withColumn("actor", F.explode(F.array_distinct("ids")))
    first = found.groupBy(*keys, "frame").agg(F.min("det_id").alias("det_id"))
    pairs = matching.within(wanted.drop("category", "ids"), first, keys, "start", "frame", -tolerance, tolerance)
    best = pairs.groupBy("truth_id").agg(F.min(F.struct("rank", F.abs(F.col("frame") - F.col("start")).alias("off"), "det_id")).alias("m"))
    return truth.join(best, "truth_id", "left").select(*truth.columns, F.col("m.det_id").alias("det_id"), F.col("m.off").alias("off"))


def extras(found: DataFrame, truth: DataFrame, expected: DataFrame, tolerance: int) -> DataFrame:
    """Detections with no annotation of a matching category within reach."""
    wanted = truth.join(expected, "category").select("type", "start")
    return matching.without(found, wanted, ["type"], "det_id", "frame", "start", -tolerance, tolerance)


def diagnose(missed: DataFrame, found: DataFrame, expected: DataFrame, reach: int = 150, k: int = 3) -> DataFrame:
    """The nearest detections of any type to each missed annotation, and why they do not count."""
    pairs = matching.within(missed.withColumn("one_", F.lit(1)), found.withColumn("one_", F.lit(1)), ["one_"], "start", "frame", -reach, reach)
    pairs = pairs.withColumn("off", F.abs(F.col("frame") - F.col("start"))).join(expected.withColumn("fits", F.lit(True)), ["category", "type"], "left")
    w = Window.partitionBy("truth_id").orderBy("off", "det_id")
    reason = F.when(F.col("fits").isNull(), "other type").when(~F.array_contains("ids", F.col("actor")), "other actor").otherwise("too far")
    return pairs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).select("truth_id", "det_id", "off", "n", reason.alias("reason"))


def by_category(matched: DataFrame, comparable: Sequence[str]) -> DataFrame:
    """Matched, missed, incomparable and bad annotations (end before start) of each category, with the match rate."""
    kind = F.when(~F.col("category").isin(*comparable), "incomparable").when(F.col("end") < F.col("start"), "bad").when(F.col("det_id").isNotNull(), "matched").otherwise("missed")
    counts = matched.withColumn("kind", kind).groupBy("category").pivot("kind", ["matched", "missed", "incomparable", "bad"]).count().na.fill(0)
    return counts.withColumn("match_rate", F.round(F.try_divide("matched", F.col("matched") + F.col("missed")), 3))


def id_map(truth: DataFrame, found: DataFrame, expected: DataFrame, reach: int = 60) -> DataFrame:
    """The actor that most often acts alike near each annotated id's events."""
    wanted = truth.join(expected, "category").withColumn("id", F.explode("ids"))
    pairs = matching.within(wanted, found, ["type"], "start", "frame", -reach, reach).where("actor is not null")
    return pairs.groupBy("id", "actor").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("actor", F.struct("n", "actor")).alias("actor"), F.max("n").alias("n"))


def slot_figures(matches: DataFrame, events: DataFrame, slots: DataFrame, kind: str) -> DataFrame:
    """tp, predicted and slots of each kind, ready for ``statistics.retrieval_figures``, with recall of whole intervals."""
    tp = matches.join(slots.select(kind, "slot", "interval"), [kind, "slot"]).groupBy(kind).agg(F.count("*").alias("tp"), F.count_distinct("interval").alias("hit"))
    predicted = events.groupBy(kind).agg(F.count("*").alias("predicted"))
    total = slots.groupBy(kind).agg(F.count("*").alias("slots"), F.count_distinct("interval").alias("intervals"))
    rows = total.join(predicted, kind, "full").join(tp, kind, "left").na.fill(0, ["tp", "predicted", "slots", "hit"])
    return rows.withColumn("interval_recall", F.try_divide("hit", "intervals"))


def compare_runs(old: DataFrame, new: DataFrame, keys: Sequence[str], most: int = 30) -> DataFrame:
    """What became of the findings of an earlier run: (keys, before, after, distance, status).

    ``old`` has keys, before, at; ``new`` keys, after, at. Earlier findings in order of time (then name) take the nearest
    later one that is still free, within ``most`` frames; of equals the earlier, then the lesser name. Status is matched,
    lost (only before) or new (only after). Findings that more than ``most`` frames part from all others cannot compete,
    so each such stretch is one group.
    """
    old = old.where("before is not null").select(*keys, "at", F.col("before").cast("string").alias("before"))
    new = new.where("after is not null").select(*keys, "at", F.col("after").cast("string").alias("after"))
    # The choice depends on the numbers of findings at each time only, so it runs on these; names follow by their order.
    both = old.select(*keys, "at", F.lit(1).alias("o"), F.lit(0).alias("n")).unionByName(new.select(*keys, "at", F.lit(0).alias("o"), F.lit(1).alias("n")))
    counts = both.where("at is not null").groupBy(*keys, "at").agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    w = Window.partitionBy(*keys).orderBy("at")
    parted = counts.withColumn("new_", F.when(F.col("at") - F.lag("at").over(w) <= most, 0).otherwise(1))
    blocks = parted.withColumn("block_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("at")
        taken = pd.DataFrame(_nearest_free(rows["at"].tolist(), rows["o"].tolist(), rows["n"].tolist(), most), columns=["at", "i", "to", "j", "size"])
        for i, k in enumerate(keys):
            taken.insert(i, k, rows[k].iloc[0])
        return taken

    types = dict(both.dtypes)
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], f"at {types['at']}, i long, to {types['at']}, j long, size long"])
    taken = blocks.groupBy(*keys, "block_").applyInPandas(match, schema)
    one = taken.select(*keys, "at", "i", "to", "j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("u_"))
    one = one.select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], F.col("at").alias("from_"), (F.col("i") + F.col("u_")).alias("i_"), F.col("to").alias("to_"), (F.col("j") + F.col("u_")).alias("j_"))

    def numbered(rows: DataFrame, name: str) -> DataFrame:
        return rows.withColumn("n_", (F.row_number().over(Window.partitionBy(*keys, "at").orderBy(name)) - 1).cast("long"))

    def same(rows: DataFrame, at: str, n: str) -> Column:
        own = [rows[k].eqNullSafe(F.col(f"k{i}_")) for i, k in enumerate(keys)]
        return reduce(Column.__and__, own, (rows["at"] == F.col(at)) & (rows["n_"] == F.col(n)))

    first, later = numbered(old, "before"), numbered(new, "after")
    kept = first.join(one, same(first, "from_", "i_"), "left").select(*keys, "before", F.col("at").alias("a_"), "to_", "j_")
    matched = kept.where("to_ is not null").select(*[F.col(k).alias(f"k{i}_") for i, k in enumerate(keys)], "before", "a_", "to_", "j_")
    lost = kept.where("to_ is null").select(*keys, "before", F.lit(None).cast("string").alias("after"), F.lit(None).cast(types["at"]).alias("distance"), F.lit("lost").alias("status"))
    status = F.when(F.col("before").isNull(), "new").otherwise("matched")
    rest = later.join(matched, same(later, "to_", "j_"), "left").select(*keys, "before", "after", F.abs(F.col("to_") - F.col("a_")).cast(types["at"]).alias("distance"), status.alias("status"))
    return lost.unionByName(rest)


def _nearest_free(at: list, old: list[int], new: list[int], most: float) -> list[tuple]:
    """(time, from, time taken, from, number): which of ``new`` findings at each time the ``old`` ones take, in order of time.

    Times with none free are skipped by links to the next one on either side, so the work grows with the times.
    """
    n, free, used = len(at), list(new), [0] * len(at)

    def find(links: list[int], i: int, empty: Callable[[int], bool]) -> int:
        path = []
        while empty(i):
            path.append(i)
            i = links[i]
        for x in path:
            links[x] = i
        return i

    # Place i of ``after`` and place i + 1 of ``before`` stand for time i; the ends hold no time.
    after = [i + 1 for i in range(n)]
    before = [0, *range(n)]
    out = []
    for i in range(n):
        done = 0
        while done < old[i]:
            low = find(before, i + 1, lambda x: x > 0 and not free[x - 1]) - 1
            high = find(after, i, lambda x: x < n and not free[x])
            best = low if low >= 0 and (high >= n or at[i] - at[low] <= at[high] - at[i]) else high
            if best >= n or abs(at[best] - at[i]) > most:
                break
            size = min(old[i] - done, free[best])
            out.append((at[i], done, at[best], used[best], size))
            done, used[best], free[best] = done + size, used[best] + size, free[best] - size
    return out
