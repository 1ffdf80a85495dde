"""Comparison of all members of large groups without emitting pairs.

A group is cut into tiles of bounded size and every pair of tiles is a task group of its own, so no group is
ever held whole. From a pair of tiles come one row for each member at most: a count, and a root to which links
within the two tiles lead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def deal(rows: DataFrame, keys: list[str], member: str, tiles: Column, groups: int) -> DataFrame:
    """Adds own, i, j (tile of the row, and the pair of tiles) and g (task group) to ``rows``, once for each pair."""
    named = rows.withColumn("tiles_", tiles.cast("int")).withColumn("own", F.pmod(F.xxhash64(F.lit("tile"), member), F.col("tiles_")).cast("int"))
    spread = named.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("tiles_") - 1)))
    spread = spread.withColumns({"i": F.least("own", "other_"), "j": F.greatest("own", "other_")}).drop("other_", "tiles_")
    return spread.withColumn("g", F.pmod(F.xxhash64(*keys, "i", "j"), F.lit(groups)))


def pairs_of_tiles(table: pa.Table, keys: list[str]) -> Iterator[tuple[dict[str, int], np.ndarray, np.ndarray]]:
    """Key and the rows of both sides of every pair of tiles in a task group; one tile with itself gives the same rows twice."""
    if not table.num_rows:
        return
    names = [*keys, "i", "j"]
    values = np.stack([table.column(c).to_numpy().astype(np.int64) for c in names])
    own = table.column("own").to_numpy()
    order = np.lexsort(values[::-1])
    ranked = values[:, order]
    begin = np.flatnonzero(np.append(True, (ranked[:, 1:] != ranked[:, :-1]).any(axis=0)))
    for b, e in zip(begin, np.append(begin[1:], len(order)), strict=True):
        rows = order[b:e]
        key = dict(zip(names, values[:, rows[0]].tolist(), strict=True))
        if key["i"] == key["j"]:
            if len(rows) > 1:
                yield key, rows, rows
        else:
            one, two = rows[own[rows] == key["i"]], rows[own[rows] == key["j"]]
            if len(one) and len(two):
                yield key, one, two


def roots(near: np.ndarray, one: np.ndarray, two: np.ndarray, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Least id that each row and each column of the link matrix ``near`` reaches through links in it."""
    big = np.iinfo(np.int64).max
    root_one, root_two = one.astype(np.int64), two.astype(np.int64)
    while True:
        new_two = np.minimum(root_two, np.where(near, root_one[:, None], big).min(axis=0))
        new_one = np.minimum(root_one, np.where(near, new_two[None, :], big).min(axis=1))
        if same:
            new_one = new_two = np.minimum(new_one, new_two)
        if (new_one == root_one).all() and (new_two == root_two).all():
            return root_one, root_two
        root_one, root_two = new_one, new_two
