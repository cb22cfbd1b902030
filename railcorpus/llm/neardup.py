"""Near-duplicate records with small edits (problem 5).

Exact for a Jaccard threshold t on shingle sets, without comparing all pairs:

1. Copies (equal sets) are one set, by signature.
2. Two sets with similarity >= t share a shingle among the first n - ceil(t n) + 1 of each in any common order.
   The order is rare first, by a table of counts of fixed size (an estimate only changes the cost), so each set goes
   into the blocks of its rarest shingles. Blocks of frequent shingles are cut into tiles and compared tile by tile.
3. In a block, sorted by population count (the set's size), 192-bit parity sketches are compared by exclusive-or and bit
   counts. Sets with similarity >= t differ in at most (1-t)/(1+t) (n_a + n_b) shingles, so in no more bits: nothing is
   lost. Stretches whose population counts are too far apart are skipped, as are sets that meet too late in the common
   order to still share enough.
4. The few pairs left are verified exactly on their texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railcorpus.llm.arrows import SLICE, chunks, union_array
from railcorpus.llm.components import components
from railcorpus.llm.jaccard import members, verified
from railcorpus.llm.textform import ROWS, WORDS, Shingles, _splitmix, _within

SET = np.dtype([("sig", "<u8"), ("bits", "<u8", (WORDS,)), ("n", "<u4")])
ENTRY = np.dtype([("key", "<u4"), ("at", "<u2"), ("place", "<u2"), ("side", "u1")])
PAIRS_AT_ONCE = 1 << 20
FINE, COARSE = 1 << 23, 1 << 16  # slots: one byte each, ending at 255; four bytes each


def rarity_tables(posts: DataFrame, width: int, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Upper estimates of the number of posts with a shingle, by its hash: exact up to 254 but for shared slots; log2 of
    large numbers; and the number of posts with shingles."""
    last = FINE + 4 * COARSE

    def fill(cells, batch):
        s = Shingles(batch.column(0), width, least)
        flat = s.flat
        cells[last:].view("<u8")[0] += len(s.rows)
        slot, count = np.unique((flat & np.uint64(FINE - 1)).astype(np.int64), return_counts=True)
        cells[slot] = np.minimum(cells[slot] + count, 255).astype(np.uint8)
        coarse = cells[FINE:last].view("<u4")
        coarse += np.bincount((flat & np.uint64(COARSE - 1)).astype(np.int64), minlength=COARSE).astype(np.uint32)

    def join(a, b, k):
        if k * SLICE < FINE:
            return np.minimum(a.astype(np.uint16) + b, 255).astype(np.uint8)
        kind = "<u4" if k * SLICE < last else "<u8"
        return (a.view(kind) + b.view(kind)).view(np.uint8)

    cells = union_array(posts.select(F.col("text").cast("string")), fill, last + 8, "u1", ROWS, join)
    coarse = cells[FINE:last].view("<u4")
    return cells[:FINE], np.ceil(np.log2(np.maximum(coarse - coarse.mean(), 1) + 1)).astype(np.uint8), int(cells[last:].view("<u8")[0])


class Seen:
    """Signatures met lately in this partition, by slots of a table of fixed size: a slot forgets the one before. What it forgets only
    costs work, as copies are told apart again later."""

    def __init__(self, log2_slots: int = 18) -> None:
        self.slots = np.zeros(1 << log2_slots, np.uint64)
        self.mask = np.uint64((1 << log2_slots) - 1)

    def fresh(self, sig: np.ndarray) -> np.ndarray:
        """Which rows bring a signature that is not known yet; they are from now on."""
        at = (sig & self.mask).astype(np.int64)
        _, first = np.unique(sig, return_index=True)
        out = np.zeros(len(sig), bool)
        out[first] = True
        out &= self.slots[at] != sig
        self.slots[at[out]] = sig[out]
        return out


def blobs(s: Shingles, sig: np.ndarray, of: np.ndarray, key: np.ndarray, place: np.ndarray, side: np.ndarray, parts: int) -> pa.RecordBatch:
    """Block entries (set number, key, place in the set's order, side) by part; a part's sets come once."""
    part = (key >> np.uint64(40)).astype(np.int64) % parts
    order = np.argsort(part * len(sig) + of, kind="stable")
    of, part, key = of[order], part[order], key[order]
    new_part = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, np.int64)
    new_set = np.concatenate([[True], (part[1:] != part[:-1]) | (of[1:] != of[:-1])]) if len(part) else np.zeros(0, bool)
    number = np.cumsum(new_set) - 1
    sets = np.empty(int(new_set.sum()), SET)
    pick = of[new_set]
    sets["sig"], sets["bits"], sets["n"] = sig[pick], s.sketch()[pick], s.size[pick]
    ends = np.append(new_part[1:], len(part))[: len(new_part)]
    out = np.empty(len(of), ENTRY)
    base = number[new_part] if len(new_part) else number
    out["key"], out["at"], out["place"], out["side"] = key.astype(np.uint32), number - np.repeat(base, ends - new_part), np.minimum(place[order], 65535), side[order]
    to = np.append(base[1:], len(sets))[: len(base)]
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(part[new_part], pa.int32()),
            "sets": pa.array([sets[a:b].tobytes() for a, b in zip(base, to, strict=True)], pa.binary()),
            "entries": pa.array([out[a:b].tobytes() for a, b in zip(new_part, ends, strict=True)], pa.binary()),
        }
    )


BLOBS = "part int, sets binary, entries binary"


def block_entries(batches, fine, coarse, width, least, threshold, parts, tile_log2):
    """Each set's entries in the blocks of its rarest shingles; blocks that only one set is in are left out."""
    seen = Seen()
    for batch in chunks(batches, ROWS):
        s = Shingles(batch.column(0), width, least)
        sig = s.signature()
        fresh = seen.fresh(sig)
        rare = fine[(s.flat & np.uint64(FINE - 1)).astype(np.int64)].astype(np.uint32)
        crowd = coarse[(s.flat & np.uint64(COARSE - 1)).astype(np.int64)].astype(np.uint32)
        rank = np.where(rare < 255, rare, 255 + crowd)
        order = np.argsort((s.of.astype(np.uint32) << np.uint32(9)) | rank, kind="stable")
        prefix = s.size - np.ceil(threshold * s.size - 1e-9).astype(np.int64) + 1
        place = _within(s.size)
        pick = (place < np.repeat(prefix, s.size)) & fresh[s.of] & (rare[order] > 1)
        order, place = order[pick], place[pick]
        of, rare, crowd = s.of[order], rare[order], crowd[order].astype(np.int64)
        key = _splitmix(s.flat[order])
        side = np.zeros(len(of), np.uint8)
        hot = np.flatnonzero((rare == 255) & (crowd > tile_log2))
        if len(hot):  # a frequent shingle's block as tiles: every pair of strips meets in one tile
            strips = 1 << (crowd[hot] - tile_log2)
            mine = (_splitmix(sig[of[hot]] ^ np.uint64(0x5BD1)) & (strips - 1).astype(np.uint64)).astype(np.int64)
            rep = np.repeat(np.arange(len(hot)), strips)
            other, own = _within(strips), mine[rep]
            low, high = np.minimum(own, other), np.maximum(own, other)
            tile = _splitmix(key[hot][rep] ^ _splitmix((low * 1000003 + high + 1).astype(np.uint64)))
            cold = np.setdiff1d(np.arange(len(of)), hot, assume_unique=True)
            side = np.concatenate([side[cold], np.where(own == other, 0, np.where(own < other, 1, 2)).astype(np.uint8)])
            of, key, place = np.concatenate([of[cold], of[hot][rep]]), np.concatenate([key[cold], tile]), np.concatenate([place[cold], place[hot][rep]])
        yield blobs(s, sig, of, key, place, side, parts)


def tiles(table: pa.Table, threshold: float) -> pa.Table:
    """Candidate pairs of one part: equal key, sketches within the radius. Copies that several partitions sent are one entry first."""
    sets = [np.frombuffer(x.as_buffer(), SET) for x in table.column("sets")]
    entries = [np.frombuffer(x.as_buffer(), ENTRY) for x in table.column("entries")]
    base = np.cumsum([0] + [len(x) for x in sets[:-1]])
    at = np.concatenate([e["at"].astype(np.int64) + b for e, b in zip(entries, base, strict=True)])
    e, sets = np.concatenate(entries), np.concatenate(sets)
    _, first, number = np.unique(sets["sig"], return_index=True, return_inverse=True)
    at, sets = number[at], sets[first]
    _, first = np.unique((_splitmix(e["key"].astype(np.uint64) | (e["side"].astype(np.uint64) << np.uint64(32))) ^ sets["sig"][at]), return_index=True)
    at, e = at[first], e[first]
    bits = [np.ascontiguousarray(sets["bits"][:, w]) for w in range(WORDS)]
    size = sets["n"].astype(np.int64)
    where = (e["key"].astype(np.uint64) << np.uint64(32)) | size[at].astype(np.uint64)
    order = np.argsort(where, kind="stable")
    at, where, side, place = at[order], where[order], e["side"][order], e["place"][order].astype(np.int64)
    n = size[at]
    radius, overlap = (1 - threshold) / (1 + threshold), threshold / (1 + threshold)
    # the partner comes later, so it is no smaller; it is no larger than n / t, nor than the shingles left from here on allow
    most = np.floor(np.minimum(n / threshold, (n - place) / overlap - n) + 1e-6).astype(np.int64)
    stop = np.searchsorted(where, (where - n.astype(np.uint64)) + np.maximum(most, 0).astype(np.uint64), side="right")
    partners = np.maximum(stop - np.arange(len(where)) - 1, 0)
    ends = np.cumsum(partners)
    found = [np.zeros((0, 2), np.int64)]
    first = 0
    while first < len(where):
        to = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PAIRS_AT_ONCE, side="right")))
        reps = partners[first:to]
        i = np.repeat(np.arange(first, to), reps)
        j = i + 1 + _within(reps)
        total = n[i] + n[j]
        met = ((side[i] == 0) | (side[i] != side[j])) & (n[j] - place[j] >= overlap * total - 1e-6)
        x, y, total = at[i[met]], at[j[met]], total[met]
        differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int64) for b in bits)
        ok = differ <= radius * total + 1e-6
        a, b = sets["sig"][x[ok]].view("i8"), sets["sig"][y[ok]].view("i8")
        ok = a != b
        found.append(np.unique(np.stack([np.minimum(a, b)[ok], np.maximum(a, b)[ok]], 1), axis=0))
        first = to
    pairs = np.unique(np.concatenate(found), axis=0)
    return pa.table({"sig_a": pa.array(pairs[:, 0]), "sig_b": pa.array(pairs[:, 1])})


def near_sets(posts: DataFrame, threshold: float = 0.8, width: int = 5, least: int = 5, tile_log2: int = 13, extra: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Near-same sets among posts (id, text).

    Returns (sig_a, sig_b, jaccard) with sig_a < sig_b, and the members (sig, id, *extra). Null texts and texts under
    `least` tokens belong to no set. A repeated id is one record for each different text it has.
    """
    spark = posts.sparkSession
    *found, rows = rarity_tables(posts, width, least)
    parts = parts_of(rows)
    tables = spark.sparkContext.broadcast(found)
    entries = posts.select(F.col("text").cast("string")).mapInArrow(lambda batches: block_entries(batches, *tables.value, width, least, threshold, parts, tile_log2), BLOBS)
    return settle(compared(entries, parts, threshold), posts, threshold, width, least, extra)


def parts_of(rows: int) -> int:
    """Parts of about 16,384 sets; their size stays the same however many rows there are."""
    return int(max(8, 2 ** np.ceil(np.log2(max(rows, 1) / 16384))))


def compared(entries: DataFrame, parts: int, threshold: float) -> DataFrame:
    """Candidate pairs of block entries by part, each part a partition of its own."""
    return entries.repartitionById(parts, F.col("part")).groupBy("part").applyInArrow(lambda t: tiles(t, threshold), "sig_a long, sig_b long")


def settle(pairs: DataFrame, posts: DataFrame, threshold: float, width: int, least: int, extra: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Verified candidate pairs, and the members of all sets. What is kept is recomputed if an executor is lost."""
    pairs = pairs.distinct().persist(StorageLevel.MEMORY_AND_DISK)
    sigs = pairs.select(F.explode(F.array("sig_a", "sig_b")).alias("sig"))
    held = members(posts, width, least, sigs, 2 * pairs.count(), extra).persist(StorageLevel.MEMORY_AND_DISK)
    near = verified(pairs, held.select("sig", "text"), width, least, threshold).persist(StorageLevel.MEMORY_AND_DISK)
    return near, held.drop("text").dropDuplicates(["sig", "id"])


def near_pairs(near: DataFrame, held: DataFrame, most_copies: int = 1000) -> DataFrame:
    """Pairs of ids (post_a < post_b) that are near-same or copies.

    A set with more than most_copies copies stands in the pairs with other sets by its smallest id, and its copies
    are paired with that id only: linear in the copies, no link between different texts lost.
    """
    size = held.groupBy("sig").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    linked = near.select("sig_a", "sig_b")
    inside = size.where("copies > 1").select(F.col("sig").alias("sig_a"), F.col("sig").alias("sig_b"))
    links = linked.unionByName(inside)
    wanted = links.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).distinct()
    rows = held.join(wanted, "sig", "left_semi").join(size, "sig").withColumn("stands", (F.col("copies") <= most_copies) | (F.col("id") == F.col("first")))
    a = rows.where("stands").select(F.col("sig").alias("sig_a"), F.col("id").alias("id_a"))
    b = rows.select(F.col("sig").alias("sig_b"), F.col("id").alias("id_b"), "stands")
    out = links.join(a, "sig_a").join(b, "sig_b")
    out = out.where((F.col("sig_a") == F.col("sig_b")) & (F.col("id_a") < F.col("id_b")) | (F.col("sig_a") != F.col("sig_b")) & F.col("stands"))
    return out.select(F.least("id_a", "id_b").alias("post_a"), F.greatest("id_a", "id_b").alias("post_b")).where("post_a <> post_b").distinct()


def near_groups(near: DataFrame, held: DataFrame) -> DataFrame:
    """(post_id, group_id, links) of every post with a near-same or equal one; links counts near-same sets, copies not among
    them."""
    size = held.groupBy("sig").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    joined = components(near.select(F.col("sig_a").alias("u"), F.col("sig_b").alias("v")))
    degree = near.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
    sets = size.join(joined.withColumnRenamed("node", "sig"), "sig", "left").join(degree, "sig", "left").where("copies > 1 or root is not null")
    sets = sets.withColumn("root", F.coalesce("root", "sig"))
    least = sets.groupBy("root").agg(F.min("first").alias("group_id"))
    rows = held.join(sets.select("sig", "root", "links"), "sig").join(least, "root")
    return rows.groupBy(F.col("id").alias("post_id")).agg(F.min("group_id").alias("group_id"), F.max(F.coalesce("links", F.lit(0))).alias("links"))
