"""Filling fixed-capacity containers with items (problem 8): first-fit decreasing in randomised groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each size: largest first, each into the first bin with room. A tournament tree over the bins' room finds
    that bin in log(bins) steps."""
    leaves = 1 << max(len(sizes) - 1, 0).bit_length()
    room = [capacity] * (2 * leaves)
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size, at = sizes[i], 1
        while at < leaves:
            at *= 2
            if room[at] < size:
                at += 1
        bins[i] = at - leaves
        room[at] -= size
        at >>= 1
        while at:
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
            at >>= 1
    return bins


def pack(items: DataFrame, capacity: int = 2048, group_items: int = 4096, seed: int = 0) -> DataFrame:
    """(id, piece, pieces, start, size, container) of items (id, size).

    Items over the capacity are cut into full containers and one rest; others stay whole. Items meet in randomised
    groups of about group_items, packed apart, so no task holds more than a group and at most about one container a group
    is badly filled. Null or non-positive sizes take no room: one row with container null. Repeated rows are items of
    their own: counted first and numbered, so that the copies of an id (or of null) spread over the groups as any other items do.
    """
    items = items.select("id", F.coalesce(F.col("size").cast("long"), F.lit(0)).alias("size"))
    counted = items.groupBy("id", "size").agg(F.count("*").alias("copies")).persist(StorageLevel.MEMORY_AND_DISK)
    groups = max(1, -(-(counted.agg(F.sum("copies")).first()[0] or 0) // group_items))
    single = counted.select("id", "size", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    grouped = single.select("id", "size", F.pmod(F.xxhash64("id", "size", "copy", F.lit(seed)), F.lit(groups)).alias("grp"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("size", "ascending")])
        size = np.maximum(table.column("size").to_numpy(), 0)
        pieces = -(-size // capacity)
        rows = np.repeat(np.arange(len(size)), np.maximum(pieces, 1))
        piece = np.arange(len(rows)) - np.repeat(np.cumsum(np.maximum(pieces, 1)) - np.maximum(pieces, 1), np.maximum(pieces, 1))
        start = piece * capacity
        part = np.minimum(size[rows] - start, capacity)
        fits = np.flatnonzero(part > 0)
        bins = np.full(len(rows), -1, np.int64)
        bins[fits] = first_fit_decreasing(part[fits].tolist(), capacity)
        group = table.column("grp")[0].as_py()
        container = pa.array([f"{group}-{b}" if b >= 0 else None for b in bins.tolist()], pa.string())
        return pa.table([table.column("id").take(pa.array(rows)), pa.array(piece.astype("i4")), pa.array(pieces[rows].astype("i4")), pa.array(start), pa.array(part), container], names=["id", "piece", "pieces", "start", "size", "container"])

    kind = items.schema["id"].dataType.simpleString()
    return grouped.groupBy("grp").applyInArrow(run, f"id {kind}, piece int, pieces int, start long, size long, container string")


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """(containers, least_containers, tokens, fill) of packed items; fill is null without containers."""
    used = packed.where("container is not null")
    out = used.agg(F.countDistinct("container").alias("containers"), F.coalesce(F.sum("size"), F.lit(0)).alias("tokens"))
    return out.select("containers", F.ceil(F.col("tokens") / capacity).alias("least_containers"), "tokens", F.try_divide("tokens", F.col("containers") * capacity).alias("fill"))
