"""Filling fixed-capacity containers with items.

Best-two-fit: a bin is filled greedily with the largest item that fits; then its
smallest item is taken out if two unpacked items fill the widened gap better.

Items are split at random into groups of about ``group_rows`` (by a hash of the id,
so a group is bounded whatever the data) and each group and capacity is packed by
itself: the loss is one part-filled bin per group. An item above the capacity gives
full pieces, each a bin of its own, and a rest that is packed.

Within a group only the sizes matter, so the packer works on counts per size with the
free sizes as the bits of one integer: the largest size up to a gap is one mask.

Defined results: items of null, zero or negative size are left out; capacities below
one are left out; equal sizes are told apart by id; repeated ids are distinct items
only if their ``piece`` differs (ids are unique by contract); empty tables give an
empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "container_id int, capacity int, bin string, id long, piece int, size int"


def best_two_fit(counts: dict[int, int], capacity: int) -> list[list[int]]:
    """Bins (lists of sizes) for ``counts`` of sizes of at most ``capacity``."""
    left = {s: n for s, n in counts.items() if n > 0}
    free = 0
    for s in left:
        free |= 1 << s
    bins: list[list[int]] = []

    def take(s: int) -> None:
        nonlocal free
        left[s] -= 1
        if not left[s]:
            free &= ~(1 << s)

    def put(s: int) -> None:
        nonlocal free
        left[s] += 1
        free |= 1 << s

    def largest(gap: int) -> int:
        return (free & ((1 << (gap + 1)) - 1)).bit_length() - 1 if gap > 0 else -1

    while free:
        gap, content = capacity, []
        while (s := largest(gap)) > 0:
            take(s)
            content.append(s)
            gap -= s
        while gap > 0 and content and free:
            worst = content[-1]
            wide = gap + worst
            best = (worst, 0, 0)
            low = free & ((1 << (wide // 2 + 1)) - 1)
            while low:
                a = low.bit_length() - 1
                low &= ~(1 << a)
                take(a)
                b = largest(wide - a)
                put(a)
                if b > 0 and a + b > best[0]:
                    best = (a + b, a, b)
                    if a + b == wide:
                        break
            if best[0] <= worst:
                break
            content.pop()
            put(worst)
            take(best[1])
            take(best[2])
            content += sorted(best[1:], reverse=True)
            content.sort(reverse=True)
            gap = wide - best[0]
        bins.append(content)
    return bins


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity, container, group = int(pdf["capacity"].iloc[0]), int(pdf["container_id"].iloc[0]), int(pdf["g"].iloc[0])
    ids, sizes = pdf["id"].to_numpy(), pdf["size"].to_numpy()
    full = np.where(sizes > capacity, sizes // capacity, 0)
    rest = sizes - full * capacity
    order = np.lexsort((ids, rest))
    edges = np.flatnonzero(np.diff(rest[order], prepend=-1))
    by_size = {int(rest[order[i]]): list(order[i:j]) for i, j in zip(edges, [*edges[1:], len(order)], strict=True)}
    by_size.pop(0, None)
    picked: list[int] = []
    bins: list[int] = []
    for k, content in enumerate(best_two_fit({s: len(r) for s, r in by_size.items()}, capacity)):
        for s in content:
            picked.append(by_size[s].pop())
            bins.append(k)
    at = np.array(picked, dtype=np.int64)
    packed = pd.DataFrame({"bin": pd.Series(bins, dtype="int64").map(lambda k: f"{group}-{k}"), "id": ids[at], "piece": full[at], "size": rest[at]})
    owner = np.repeat(np.arange(len(ids)), full)
    piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
    whole = pd.DataFrame({"bin": [f"whole-{i}-{p}" for i, p in zip(ids[owner], piece, strict=True)], "id": ids[owner], "piece": piece, "size": capacity})
    out = pd.concat([packed, whole], ignore_index=True) if len(whole) else packed
    return out.assign(container_id=container, capacity=capacity)[["container_id", "capacity", "bin", "id", "piece", "size"]]


def pack(items: DataFrame, capacities: dict[int, int], n_items: int, group_rows: int = 20000) -> DataFrame:
    """``items``: id, size. One row per item (or piece) and container size: container_id, capacity, bin, id, piece, size.

    ``n_items`` (a count, or a bound on it) sets the number of groups.
    """
    usable = {k: c for k, c in capacities.items() if c is not None and c >= 1}
    if not usable:
        return items.sparkSession.createDataFrame([], SCHEMA)
    groups = max(1, -(-n_items // group_rows))
    sizes = F.array(*[F.struct(F.lit(k).cast("int").alias("container_id"), F.lit(c).cast("int").alias("capacity")) for k, c in sorted(usable.items())])
    each = items.select(F.col("id").cast("long").alias("id"), F.col("size").cast("int").alias("size"), F.pmod(F.xxhash64("id"), F.lit(groups)).alias("g"))
    each = each.withColumn("c", F.explode(F.when(F.col("size") > 0, sizes))).select("id", "size", "g", "c.container_id", "c.capacity")
    return each.groupBy("container_id", "g").applyInPandas(_pack, SCHEMA)
