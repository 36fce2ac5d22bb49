"""All-pairs work over a vector table, in bounded blocks.

The table is hashed into blocks of at most a few thousand rows and every unordered
pair of blocks becomes one task group. A group multiplies two small matrices and
emits a bounded digest per row (its best or worst partners), never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK_ROWS = 4096
TILE_ROWS = 512

Digest = Callable[[np.ndarray, np.ndarray, np.ndarray, bool], pd.DataFrame]


def block_count(rows: int, block_rows: int = BLOCK_ROWS) -> int:
    """Blocks of bounded size; small tables still get a few, to use several cores."""
    return max(math.ceil(rows / block_rows), min(4, math.ceil(rows / 256)), 1)


def _tiles(digest: Digest, ids, a, partner_ids, b, same: bool, decimals: int):
    for start in range(0, len(ids), TILE_ROWS):
        rows = slice(start, start + TILE_ROWS)
        yield digest(ids[rows], partner_ids, np.round(a[rows] @ b.T, decimals), same)


def _all(parts: list[pd.DataFrame], schema: str) -> pd.DataFrame:
    return pd.concat(parts) if parts else pd.DataFrame(columns=[c.split()[0] for c in schema.split(",")])


def block_pairs(vecs: DataFrame, digest: Digest, schema: str, blocks: int, decimals: int = 6) -> DataFrame:
    """Digest rows of every vector against every block of the table of (id, vec).

    ``digest(ids, partner_ids, sims, same)`` sees a tile of similarities, rounded to
    ``decimals``, with both id arrays ascending; ``same`` marks tiles of a block against itself.
    """
    tagged = vecs.select("id", "vec", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("own"))
    left = tagged.select("id", "vec", F.col("own").alias("i"), F.explode(F.sequence("own", F.lit(blocks - 1))).alias("j"))
    # Own names on the right side: with shared ones the column pruning of a cogroup
    # of a table with itself can lose the right-hand columns.
    right = tagged.select(
        F.col("id").alias("right_id"), F.col("vec").alias("right_vec"),
        F.explode(F.sequence(F.lit(0), "own")).alias("right_i"), F.col("own").alias("right_j"),
    )

    def run(key, x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        same = key[0] == key[1]
        out = []
        if len(x) and len(y):
            x, y = x.sort_values("id"), y.sort_values("right_id")
            a, b = np.stack(x["vec"].to_numpy()), np.stack(y["right_vec"].to_numpy())
            ia, ib = x["id"].to_numpy(), y["right_id"].to_numpy()
            out.extend(_tiles(digest, ia, a, ib, b, same, decimals))
            if not same:
                out.extend(_tiles(digest, ib, b, ia, a, False, decimals))
        return _all(out, schema)

    return left.groupBy("i", "j").cogroup(right.groupBy("right_i", "right_j")).applyInPandas(run, schema)


def best_partners(k: int, threshold: float | None, inclusive: bool) -> Digest:
    """The k highest partners of each row, ties by partner id."""

    def digest(ids, partners, sims, same):
        keep = np.ones_like(sims, dtype=bool)
        if same:
            keep &= ids[:, None] != partners[None, :]
        if threshold is not None:
            keep &= (sims >= threshold) if inclusive else (sims > threshold)
        if k < sims.shape[1]:
            masked = np.where(keep, sims, -np.inf)
            cut = np.partition(masked, -k, axis=1)[:, -k]
            keep &= sims >= cut[:, None]
        row, col = np.nonzero(keep)
        score = sims[row, col]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        first = np.searchsorted(row, row, side="left")
        top = np.arange(len(row)) - first < k
        return pd.DataFrame({"id": ids[row[top]], "neighbour": partners[col[top]], "score": score[top] + 0.0})

    return digest


def low_partners(flag_below: float) -> Digest:
    """Per row: how many partners are at most ``flag_below``, and the lowest one."""

    def digest(ids, partners, sims, same):
        own = ids[:, None] == partners[None, :] if same else np.zeros_like(sims, dtype=bool)
        low = np.where(own, np.inf, sims)
        at = low.argmin(axis=1)
        floor = low[np.arange(len(ids)), at]
        found = np.isfinite(floor)
        return pd.DataFrame({
            "id": ids[found], "n": (low <= flag_below).sum(axis=1)[found],
            "floor": floor[found] + 0.0, "partner": partners[at[found]],
        })

    return digest


def lowest_partners(k: int, flag_below: float) -> Digest:
    """The k lowest partners of each row that are at most ``flag_below``, ties by partner id."""

    def digest(ids, partners, sims, same):
        keep = sims <= flag_below
        if same:
            keep &= ids[:, None] != partners[None, :]
        if k < sims.shape[1]:
            masked = np.where(keep, sims, np.inf)
            keep &= sims <= np.partition(masked, k - 1, axis=1)[:, k - 1][:, None]
        row, col = np.nonzero(keep)
        score = sims[row, col]
        order = np.lexsort((col, score, row))
        row, col, score = row[order], col[order], score[order]
        top = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
        return pd.DataFrame({"id": ids[row[top]], "other": partners[col[top]], "sim": score[top] + 0.0})

    return digest
