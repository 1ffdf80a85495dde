"""Joins in time and one-to-one matching.

As-of and tolerance joins are equi-joins on (keys, time bin) with a range condition, then one aggregate by
row; no nested loops. One-to-one matching depends on what earlier rows have used, so candidates are found by a
join and only the choice runs in order, per key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], l_at: str, r_at: str, low: float, high: float) -> DataFrame:
    """All pairs with low <= r_at - l_at <= high."""
    width = max(high - low, 1e-9)
    bins = F.explode(F.sequence(F.floor((F.col(l_at) + low) / width), F.floor((F.col(l_at) + high) / width)))
    a, b = left.withColumn("bin_", bins), right.withColumn("bin_", F.floor(F.col(r_at) / width))
    return a.join(b, [*keys, "bin_"]).where((F.col(r_at) - F.col(l_at)).between(low, high)).drop("bin_")


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, l_at: str, r_at: str, tolerance: float, direction: str = "backward", prefer: Sequence[str] = ()) -> DataFrame:
    """For each row of ``left`` (named by ``row``) the nearest row of ``right`` within ``tolerance``, as struct ``match``.

    ``direction`` is backward, forward or nearest; equal distances go to the earlier one, then by ``prefer``.
    Rows without a match stay, with a null struct.
    """
    low, high = {"backward": (-tolerance, 0), "forward": (0, tolerance), "nearest": (-tolerance, tolerance)}[direction]
    pairs = _pairs(left.select(*keys, row, l_at), right, keys, l_at, r_at, low, high)
    values = [c for c in right.columns if c not in keys]
    rank = F.struct(F.abs(F.col(r_at) - F.col(l_at)).alias("d"), F.col(r_at).alias("t"), *[F.col(c).alias(f"p_{c}") for c in prefer])
    best = pairs.groupBy(row).agg(F.min_by(F.struct(*values), rank).alias("match"))
    return left.join(best, row, "left")


def within(left: DataFrame, right: DataFrame, keys: Sequence[str], l_at: str, r_at: str, low: float, high: float) -> DataFrame:
    """Range join: all pairs whose distance in time lies in [low, high]."""
    return _pairs(left, right, keys, l_at, r_at, low, high)


def without(left: DataFrame, right: DataFrame, keys: Sequence[str], row: str, l_at: str, r_at: str, low: float, high: float) -> DataFrame:
    """Rows of ``left`` that have no row of ``right`` in the range: a left anti theta join."""
    near = _pairs(left.select(*keys, row, l_at), right.select(*keys, r_at), keys, l_at, r_at, low, high).select(row).distinct()
    return left.join(near, row, "left_anti")


def adjacent(rows: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Each row beside the next of its key, as ``next_<column>``; the last row of a key has none."""
    w = Window.partitionBy(*keys).orderBy(order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns}).where(F.col(f"next_{columns[0]}").isNotNull())


def nearest(queries: DataFrame, rows: DataFrame, keys: Sequence[str], query: str, distance: Column, name: str, k: int = 1) -> DataFrame:
    """The k rows of the same key least distant from each query; ties go to the smaller ``name``."""
    pairs = queries.join(rows, list(keys)).withColumn("distance", distance)
    w = Window.partitionBy(*keys, query).orderBy("distance", name)
    return pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _greedy(events: pd.DataFrame, kind: str) -> pd.DataFrame:
    """Events in order of time take the free slot around them whose middle is nearest."""
    used, out = set(), []
    for (at, event), own in events.groupby(["at", "event"], sort=True):
        free = own[~own["slot"].isin(used)]
        if len(free):
            pick = free.assign(d=(free["middle"] - at).abs()).sort_values(["d", "slot"]).iloc[0]
            used.add(pick["slot"])
            out.append((pick[kind], event, pick["slot"]))
    return pd.DataFrame(out, columns=[kind, "event", "slot"])


def match_slots(events: DataFrame, slots: DataFrame, kind: str, bin_width: float = 60.0) -> DataFrame:
    """One-to-one matches (kind, event, slot) of events (kind, event, at) to slots (kind, slot, start, end), ends included.

    Only pairs that fit leave the join. The greedy choice sees the events of one block: slots that overlap, directly or
    by others, since no event beyond them can take one of them.
    """
    w = Window.partitionBy(kind).orderBy("start", "end", "slot")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = slots.withColumn("new_", F.when(F.col("start") <= reach, 0).otherwise(1))
    blocks = fresh.withColumn("block_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    listed = blocks.withColumn("bin_", F.explode(F.sequence(F.floor(F.col("start") / bin_width), F.floor(F.col("end") / bin_width))))
    pairs = events.withColumn("bin_", F.floor(F.col("at") / bin_width)).join(listed, [kind, "bin_"]).where(F.col("at").between(F.col("start"), F.col("end")))
    pairs = pairs.select(kind, "block_", "event", F.col("at").cast("double").alias("at"), "slot", ((F.col("start") + F.col("end")) / 2).cast("double").alias("middle"))
    types = dict(pairs.dtypes)
    return pairs.groupBy(kind, "block_").applyInPandas(_bound(_greedy, kind), f"`{kind}` {types[kind]}, event {types['event']}, slot {types['slot']}")


def _bound(f: Callable, *more: object) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(group: pd.DataFrame) -> pd.DataFrame:
        return f(group, *more)

    return run


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of a least-cost assignment of rows to columns; infinite cost never pairs.

    Shortest augmenting paths with potentials; rows are added one at a time.
    """
    n, m = cost.shape
    if n > m:
        return sorted((r, c) for c, r in hungarian(cost.T))
    top = np.where(np.isfinite(cost), cost, 0).sum() + 1.0
    c = np.where(np.isfinite(cost), cost, top * (n + 1))
    u, v, row_of = np.zeros(n), np.zeros(m + 1), np.full(m + 1, -1)
    for i in range(n):
        row_of[m], j0 = i, m
        low, via, done = np.full(m + 1, np.inf), np.full(m + 1, m), np.zeros(m + 1, bool)
        while row_of[j0] >= 0:
            done[j0] = True
            r = row_of[j0]
            slack = c[r] - u[r] - v[:m]
            better = ~done[:m] & (slack < low[:m])
            low[:m][better], via[:m][better] = slack[better], j0
            j1 = int(np.argmin(np.where(done, np.inf, np.append(low[:m], np.inf))))
            delta = low[j1]
            u[row_of[done]] += delta
            v[done] -= delta
            low[~done] -= delta
            j0 = j1
        while j0 != m:
            row_of[j0] = row_of[via[j0]]
            j0 = via[j0]
    return sorted((int(row_of[j]), j) for j in range(m) if row_of[j] >= 0 and np.isfinite(cost[row_of[j], j]))


def _clusters(a: np.ndarray, b: np.ndarray, n: int, m: int) -> np.ndarray:
    """The least row of the pairs that each pair (a, b) of n rows and m columns is chained to."""
    row = np.arange(n)
    while True:
        col = np.full(m, n)
        np.minimum.at(col, b, row[a])
        low = row.copy()
        np.minimum.at(low, a, col[b])
        low = low[low]
        if (low == row).all():
            return row[a]
        row = low


def _assign(group: pd.DataFrame, keys: list[str]) -> pd.DataFrame:
    """Pairs that share no row and no column, directly or by others, do not compete: each cluster is solved alone."""
    rows, a = np.unique(group["row"].to_numpy(), return_inverse=True)
    cols, b = np.unique(group["col"].to_numpy(), return_inverse=True)
    price = group["cost"].to_numpy(float)
    cluster = _clusters(a, b, len(rows), len(cols))
    order = np.argsort(cluster, kind="stable")
    found = []
    for part in np.split(order, np.flatnonzero(np.diff(cluster[order])) + 1):
        r, i = np.unique(a[part], return_inverse=True)
        c, j = np.unique(b[part], return_inverse=True)
        cost = np.full((len(r), len(c)), np.inf)
        cost[i, j] = price[part]
        found += [(r[x], c[y], cost[x, y]) for x, y in hungarian(cost)]
    r, c, costs = zip(*found, strict=True) if found else ((), (), ())
    out = pd.DataFrame({k: [group[k].iloc[0]] * len(found) for k in keys})
    return out.assign(row=rows[list(r)], col=cols[list(c)], cost=np.array(costs, float))


def assign(candidates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Least-cost one-to-one assignment within each key of candidates (keys, row, col, cost); absent pairs are vetoed."""
    schema = ", ".join(f"`{c}` {t}" for c, t in candidates.select(*keys, "row", "col", "cost").dtypes)
    return candidates.select(*keys, "row", "col", F.col("cost").cast("double").alias("cost")).groupBy(*keys).applyInPandas(_bound(_assign, list(keys)), schema.replace("decimal", "double"))


def greedy_best(candidates: DataFrame, keys: Sequence[str], descending: bool = False) -> DataFrame:
    """One-to-one pairs by global greed: the best pair first, then the best of those left."""
    schema = ", ".join(f"`{c}` {t}" for c, t in candidates.select(*keys, "row", "col", "cost").dtypes)

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken_r, taken_c, out = set(), set(), []
        for x in group.sort_values(["cost", "row", "col"], ascending=[not descending, True, True]).itertuples(index=False):
            if x.row not in taken_r and x.col not in taken_c:
                taken_r.add(x.row)
                taken_c.add(x.col)
                out.append(x)
        return pd.DataFrame(out, columns=list(group.columns))

    return candidates.select(*keys, "row", "col", "cost").groupBy(*keys).applyInPandas(run, schema)


def mutual_margin(candidates: DataFrame, keys: Sequence[str], least: float, margin: float) -> DataFrame:
    """Pairs (row, col, score) that are the best of their row, reach ``least`` and beat the runner-up by ``margin``."""
    w = Window.partitionBy(*keys, "row").orderBy(F.desc("score"), "col")
    ranked = candidates.withColumns({"rank_": F.row_number().over(w), "second": F.lead("score").over(w)})
    return ranked.where((F.col("rank_") == 1) & (F.col("score") >= least) & (F.col("score") - F.coalesce("second", F.lit(-1.0)) >= margin)).drop("rank_")
