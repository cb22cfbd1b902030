"""Grouping records into similarity clusters (problem 2): density peaks over blocked neighbour joins.

Unit vectors are put into the cell of their nearest pivot (home) and read in the cells of their nearest pivots, at most `probes`
of them and none so far off that a neighbour of the vector is unlikely to have it as home. A vector is compared with all
that probe its home cell; every ordered pair meets at most once. Pivots are a bounded sample of the vectors that lie apart from each
other, so a dense group has few cells (its density takes all its comparisons anyway) and the rest many. Their number grows with the square
root of the data: finding the cells and comparing inside them then cost the same, n^1.5 in all. Cells with many vectors
are cut into tiles of bounded size, so no task holds a whole cell. The vectors of a tile are sent once and kept for both passes.

Density is the number of neighbours at the threshold or above. Each vector points to its nearest denser neighbour;
vectors without one are peaks; following the pointers labels the rest. Neighbour links that join two peaks' basins merge
them, so groups are the connected groups of the threshold, as the problem asks; peaks name their centres.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from railcorpus.llm.arrows import chunks, summed, union_array
from railcorpus.llm.components import components, follow
from railcorpus.llm.textform import _within

CHUNK = 4096
STRIP = 256
APART = 0.5  # similarity under which pivots lie apart
SLACK = 0.16  # two deviations of the similarity of a 64-dimensional vector to a pivot, given a neighbour's
POOL = 1 << 15
PART_BYTES = 16 << 20


def unit_vectors(df: DataFrame, key: str, vector: str, dims: int) -> DataFrame:
    """(key: long, vec: binary of float32) of unit length, one a key; null keys, null, zero, non-finite vectors and those of other
    dimensions are left out. Of different vectors of a key the smallest counts."""
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) == dims)).groupBy(F.col(key).cast("long").alias("key")).agg(F.min(vector).alias("v"))

    def run(batches):
        for batch in batches:
            flat = batch.column(1).flatten()
            x = np.nan_to_num(flat.to_numpy(zero_copy_only=False).astype(np.float64), nan=np.nan).reshape(-1, dims)
            norm = np.sqrt((x * x).sum(1))
            ok = np.isfinite(norm) & (norm > 0)
            x = (x[ok] / norm[ok][:, None]).astype("<f4")
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in x], pa.binary())], ["key", "vec"])

    return rows.mapInArrow(run, "key long, vec binary")


def _matrix(column, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dims)


def _cells(x: np.ndarray, pivots: np.ndarray, probes: int, threshold: float) -> np.ndarray:
    """The probes nearest pivots of each row, nearest first; -1 where a neighbour of the row is unlikely to have the pivot as home.

    A neighbour at the threshold t is about t as similar to a pivot as the row is. Its home is at least as near to it as the row's, so
    about t s, and the row itself about t^2 s similar to it, where s is the row's similarity to its own home.
    """
    s = x @ pivots.T
    near = np.argpartition(-s, probes - 1, axis=1)[:, :probes] if probes < s.shape[1] else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    value = np.take_along_axis(s, near, 1)
    order = np.argsort(-value, axis=1, kind="stable")
    near, value = np.take_along_axis(near, order, 1), np.take_along_axis(value, order, 1)
    far = value < threshold * threshold * value[:, :1] - SLACK
    far[:, 0] = False
    return np.where(far, -1, near).astype("<i2")


def spread(pool: np.ndarray, most: int) -> np.ndarray:
    """The first `most` rows that lie apart from all before them."""
    kept = np.empty((most, pool.shape[1]), np.float32)
    n = 0
    for row in pool:
        if n == most:
            break
        if n == 0 or (kept[:n] @ row).max() < APART:
            kept[n] = row
            n += 1
    return kept[:n]


class Blocks:
    """Pivots, cell sizes and tile numbers, all bounded by the number of pivots; and where each vector goes."""

    def __init__(self, base: DataFrame, dims: int, threshold: float, probes: int, most_pivots: int, tile: int) -> None:
        spark = base.sparkSession
        self.rows = n = base.count()
        wanted = int(min(most_pivots, max(8, (12 * n) ** 0.5)))
        pool = min(POOL, 8 * wanted)
        share = min(1.0, 2 * pool / max(n, 1) + 64 / max(n, 1))  # twice the pool in all tasks together goes on to the sort
        lot = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
        sample = base.where(lot <= int(share * (1 << 40))).orderBy(lot, "key").limit(pool).collect()
        pivots = spread(np.stack([np.frombuffer(r["vec"], "<f4") for r in sample]), wanted) if sample else np.zeros((1, dims), np.float32)
        k, probes = len(pivots), min(probes, len(pivots))
        shared = spark.sparkContext.broadcast(pivots)

        def place(batches):
            for batch in chunks(batches, CHUNK):
                if batch.num_rows:
                    near = _cells(_matrix(batch.column(1), dims), shared.value, probes, threshold)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes() for r in near], pa.binary())], ["key", "vec", "near"])

        self.placed = base.mapInArrow(place, "key long, vec binary, near binary").persist(StorageLevel.MEMORY_AND_DISK)

        def fill(cells, batch):
            near = _near(batch.column(0), probes)
            cells[:k] += np.bincount(near[:, 0], minlength=k).astype(np.uint32)
            cells[k:] += np.bincount(near[near >= 0], minlength=k).astype(np.uint32)

        sizes = union_array(self.placed.select("near"), fill, 2 * k, "u4", CHUNK, summed).astype(np.int64)
        home_strips, read_strips = np.maximum(1, -(-sizes[:k] // tile)), np.maximum(1, -(-sizes[k:] // tile))
        self.copies = int((sizes[:k] * read_strips).sum() + (sizes[k:] * home_strips).sum())
        offset = np.concatenate([[0], np.cumsum(home_strips * read_strips)])
        self.dims, self.probes, self.tiles = dims, probes, spark.sparkContext.broadcast((home_strips, read_strips, offset))

    def entries(self, rows: DataFrame, value: str, kind: np.dtype) -> DataFrame:
        """(tile, blob) of rows (key, near, value): entries (key, value, home) by tile; every home part meets every reading part of its cell."""
        tiles, probes = self.tiles, self.probes
        vector = kind.names[1] == "vec"
        dims = self.dims

        def run(batches):
            home_strips, read_strips, offset = tiles.value
            for batch in chunks(batches, CHUNK):
                if not batch.num_rows:
                    continue
                key, near = batch.column(0).to_numpy(), _near(batch.column(1), probes)
                values = _matrix(batch.column(2), dims) if vector else batch.column(2).to_numpy()
                mix = (key.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                home = near[:, 0].astype(np.int64)
                own = (mix % home_strips[home].astype(np.uint64)).astype(np.int64)
                reps = read_strips[home]
                at = np.repeat(np.arange(len(key)), reps)
                own_tile = offset[home[at]] + own[at] * read_strips[home[at]] + _within(reps)
                row, column = np.nonzero(near >= 0)
                cell = near[row, column].astype(np.int64)
                part = (mix[row] % read_strips[cell].astype(np.uint64)).astype(np.int64)
                reps = home_strips[cell]
                pick = np.repeat(np.arange(len(cell)), reps)
                read_tile = offset[cell[pick]] + _within(reps) * read_strips[cell[pick]] + part[pick]
                tile = np.concatenate([own_tile, read_tile])
                order = np.argsort(tile, kind="stable")
                who = np.concatenate([at, row[pick]])[order]
                out = np.empty(len(who), kind)
                out["key"], out[kind.names[1]], out["home"] = key[who], values[who], order < len(at)
                here, start = np.unique(tile[order], return_index=True)
                ends = np.append(start[1:], len(who))
                yield pa.RecordBatch.from_pydict({"tile": pa.array(here, pa.int64()), "blob": pa.array([out[a:b].tobytes() for a, b in zip(start, ends, strict=True)], pa.binary())})

        return rows.select("key", "near", value).mapInArrow(run, "tile long, blob binary")


def _near(column, probes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i2").reshape(-1, probes)


def _sides(table: pa.Table, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """Home and read rows of a tile, each by key."""
    e = np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in table.column("blob")])
    e = e[np.argsort(e["key"], kind="stable")]
    return e[e["home"] == 1], e[e["home"] == 0]


def _strips(home: np.ndarray, read: np.ndarray):
    """Strips of the home rows: where they start, and their similarity with all read rows; -1 with themselves."""
    if not len(home) or not len(read):
        return
    x, y = np.ascontiguousarray(home["vec"]), np.ascontiguousarray(read["vec"])
    own = np.minimum(np.searchsorted(read["key"], home["key"]), len(read) - 1)
    here = read["key"][own] == home["key"]
    for at in range(0, len(home), STRIP):
        s = x[at : at + STRIP] @ y.T
        self_ = np.flatnonzero(here[at : at + STRIP])
        s[self_, own[at + self_]] = -1
        yield at, s


def count_tile(table: pa.Table, kind: np.dtype, threshold: float) -> pa.Table:
    """(a, b, link): number b of neighbours of home vector a; or a link from a to the first member b of its part in this tile.

    Parts are kept as roots of all keys. A row of neighbours with a single root needs no step of its own.
    """
    home, read = _sides(table, kind)
    keys = np.unique(np.concatenate([home["key"], read["key"]]))
    of_read, of_home = np.searchsorted(keys, read["key"]), np.searchsorted(keys, home["key"])
    root = np.arange(len(keys))
    count = np.zeros(len(home), np.int64)
    for at, s in _strips(home, read):
        i, j = np.nonzero(s >= threshold)
        if not len(i):
            continue
        count[at : at + len(s)] = np.bincount(i, minlength=len(s))
        rows, first = np.unique(i, return_index=True)
        seen, own = root[of_read[j]], root[of_home[at + rows]]
        low, high = np.minimum(np.minimum.reduceat(seen, first), own), np.maximum(np.maximum.reduceat(seen, first), own)
        ends = np.append(first[1:], len(i))
        for k in np.flatnonzero(low != high):
            met = np.unique(np.append(seen[first[k] : ends[k]], own[k]))
            while not (root[met] == met).all():
                met = np.unique(root[met])
            root[met] = met[0]
        while not (root[root] == root).all():
            root = root[root]
    moved = np.flatnonzero(root != np.arange(len(keys)))
    some = count > 0
    a, b = np.concatenate([home["key"][some], keys[moved]]), np.concatenate([count[some], keys[root[moved]]])
    return pa.table({"a": pa.array(a), "b": pa.array(b), "link": pa.array(np.arange(len(a)) >= some.sum())})


def point_tile(table: pa.Table, ranks: pa.Table, kind: np.dtype, rank: np.dtype, threshold: float) -> pa.Table:
    """(node, to, similarity): the nearest denser neighbour in this tile of each home vector that has one. ranks: the densities of the
    tile's vectors that have any; equal densities go by key."""
    home, read = _sides(table, kind)
    node, to, how = ([np.zeros(0, np.int64)] for _ in range(3))
    if ranks.num_rows:
        e = np.concatenate([np.frombuffer(x.as_buffer(), rank) for x in ranks.column("blob")])
        key, first = np.unique(e["key"], return_index=True)
        rho = e["rho"][first]
        place = np.empty(len(key), np.int64)
        place[np.lexsort((key, -rho))] = np.arange(len(key))
        home, read = home[np.isin(home["key"], key)], read[np.isin(read["key"], key)]
        of_home, of_read = place[np.searchsorted(key, home["key"])], place[np.searchsorted(key, read["key"])]
        for at, s in _strips(home, read):
            s[(s < threshold) | (of_read[None, :] >= of_home[at : at + len(s), None])] = -1
            np.round(s, 5, out=s)
            best = s.argmax(1)
            top = s[np.arange(len(s)), best]
            some = np.flatnonzero(top > 0)
            node.append(home["key"][at + some])
            to.append(read["key"][best[some]])
            how.append(top[some].astype(np.float64))
    return pa.table({"node": pa.array(np.concatenate(node)), "to": pa.array(np.concatenate(to)), "similarity": pa.array(np.concatenate(how).astype(np.float64))})


def density_peaks(df: DataFrame, key: str, vector: str, threshold: float = 0.8, dims: int = 64, probes: int = 32, most_pivots: int = 8192, tile: int = 32768) -> DataFrame:
    """(key, density, peak, group_key) of every usable vector with a neighbour at the threshold or above.

    group_key is the smallest key of the group, peak the densest vector that the pointers lead to. An empty table gives no rows.
    """
    spark = df.sparkSession
    base = unit_vectors(df, key, vector, dims).persist(StorageLevel.MEMORY_AND_DISK)
    blocks = Blocks(base, dims, threshold, probes, most_pivots, tile)
    kind = np.dtype([("key", "<i8"), ("vec", "<f4", (dims,)), ("home", "u1")])
    rank = np.dtype([("key", "<i8"), ("rho", "<i8"), ("home", "u1")])
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-blocks.copies * kind.itemsize // PART_BYTES))
    packed = blocks.entries(blocks.placed, "vec", kind).repartition(parts, "tile").persist(StorageLevel.MEMORY_AND_DISK)
    met = packed.groupBy("tile").applyInArrow(lambda t: count_tile(t, kind, threshold), "a long, b long, link boolean").persist(StorageLevel.MEMORY_AND_DISK)
    counted = met.where("not link").groupBy(F.col("a").alias("key")).agg(F.sum("b").alias("rho"))
    links = met.where("link").select(F.col("a").alias("u"), F.col("b").alias("v"))
    # a link may be seen from one side only: its other end is dense too
    ends = links.select(F.explode(F.array("u", "v")).alias("key"), F.lit(1).cast("long").alias("rho"))
    rho = counted.unionByName(ends).groupBy("key").agg(F.max("rho").alias("rho")).persist(StorageLevel.MEMORY_AND_DISK)
    ranks = blocks.entries(blocks.placed.select("key", "near").join(rho, "key"), "rho", rank)
    pointed = packed.groupBy("tile").cogroup(ranks.groupBy("tile")).applyInArrow(lambda t, r: point_tile(t, r, kind, rank, threshold), "node long, to long, similarity double")
    best = pointed.groupBy("node").agg(F.max_by("to", F.struct("similarity", -F.col("to"))).alias("to"))
    pointers = rho.join(best, rho["key"] == best["node"], "left").select("key", F.coalesce("to", "key").alias("to"))
    peaks = follow(pointers.select(F.col("key").alias("node"), "to"))
    across = links.join(peaks.select(F.col("node").alias("u"), F.col("root").alias("x")), "u").join(peaks.select(F.col("node").alias("v"), F.col("root").alias("y")), "v")
    merged = components(across.where("x <> y").select(F.col("x").alias("u"), F.col("y").alias("v")))
    grouped = peaks.join(merged.withColumnRenamed("node", "peak_of").withColumnRenamed("root", "basin"), F.col("peak_of") == F.col("root"), "left")
    grouped = grouped.select(F.col("node").alias("key"), F.col("root").alias("peak"), F.coalesce("basin", "root").alias("basin"))
    least = grouped.groupBy("basin").agg(F.min("key").alias("group_key"))
    return grouped.join(least, "basin").join(rho.withColumnRenamed("rho", "density"), "key").select("key", "density", "peak", "group_key")


def describe(groups: DataFrame, names: DataFrame, typical: int = 5) -> DataFrame:
    """(group_key, members, peak, typical: names of the densest members) of each group. names: (key, name); ties fall by key."""
    by = Window.partitionBy("group_key").orderBy(F.desc("density"), "key")
    top = groups.withColumn("place", F.row_number().over(by)).where(F.col("place") <= typical)
    one = names.groupBy("key").agg(F.min("name").alias("name"))
    shown = top.join(one, "key", "left").groupBy("group_key").agg(
        F.array_sort(F.collect_list(F.struct("place", "name"))).getField("name").alias("typical"), F.min_by("key", "place").alias("peak")
    )
    return groups.groupBy("group_key").agg(F.count("*").alias("members")).join(shown, "group_key")
