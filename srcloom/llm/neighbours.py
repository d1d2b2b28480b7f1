"""The k most similar vectors of every vector by an adaptive dimension scan.

A k-means index is fitted on a bounded sample and indexes every vector.  Neighbouring
lists make up regions of about equal numbers of vectors, however dense some part of the
space is.  A vector is sent once to every region that holds one of the lists it probes,
as half-precision numbers rotated to their principal axes; the vectors that probe a
region are cut into slices, so that a task holds one region and one slice.  There each
list is scanned in column blocks: after every block a test on the numbers not yet read
abandons the candidates that are not likely to reach the k-th best so far.  What is
found is scored again from the vectors as they were given.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from srcloom.runtime import cut

DIM = 64
K = 10
#: Vectors per list on average, and lists probed by a vector in an index of 384 lists; with the
#: number of lists their number grows by the power GROWTH.
LIST_SIZE, PROBES, GROWTH = 512, 28, 0.4
#: Members of a region and queries of a slice, at most, as estimated from the sample; a task holds both.
#: Every slice beyond the first gets a copy of the members, so slices are made for regions that many probe only.
BLOCK_SIZE, SLICE_SIZE = 32_768, 196_608
#: Half-precision similarities are this close to the exact ones.
HALF_ERROR = 0.004
#: The index is fitted on at most this many vectors and has at most this many lists.
SAMPLE_ROWS, MOST_LISTS = 131_072, 8192
#: Columns after which candidates are tested, and the width of the test in standard deviations.
COLUMN_BLOCKS, TEST_Z = (24, 40, 64), 2.4


@dataclass
class Index:
    rotation: np.ndarray  # DIM x DIM
    centres: np.ndarray  # lists x DIM, rotated
    region: np.ndarray  # of each list
    blocks: np.ndarray  # of each region: more than one only for a single list beyond the size of a region
    slices: np.ndarray  # of each region, of the vectors that probe it
    probes: int


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means; an empty centre moves to a point of the largest cluster."""
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])
        sizes = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        for e in np.nonzero(sizes == 0)[0]:
            sums[e] = x[rng.choice(np.nonzero(near == sizes.argmax())[0])]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c, np.concatenate([(x[i : i + 8192] @ c.T).argmax(1) for i in range(0, len(x), 8192)])


def _regions(centres: np.ndarray, weight: np.ndarray, most: float) -> np.ndarray:
    """Region of each list: lists are halved along their main axis until a region weighs at most most or is one list."""
    region, todo, n = np.zeros(len(centres), dtype=np.int32), [np.arange(len(centres))], 0
    while todo:
        part = todo.pop()
        w = weight[part].sum()
        if w <= most or len(part) == 1:
            region[part], n = n, n + 1
            continue
        x = centres[part] - np.average(centres[part], axis=0, weights=weight[part] + 1e-9)
        order = np.argsort(x @ np.linalg.eigh(x.T @ x)[1][:, -1], kind="stable")
        # Parts come in whole multiples of a region's weight, so that none is left half empty.
        share = np.ceil(w / most) // 2 / np.ceil(w / most)
        at = int(np.clip(np.searchsorted(np.cumsum(weight[part][order]), w * share), 1, len(part) - 1))
        todo += [part[order[:at]], part[order[at:]]]
    return region


def fit(sample: np.ndarray, rows: int, list_size: int = LIST_SIZE, block_size: int = BLOCK_SIZE, slice_size: int = SLICE_SIZE, probes: int = PROBES, exact: bool = False) -> Index:
    """Index over rows vectors, from a sample of unit vectors; exact probes every list."""
    rng = np.random.default_rng(7)
    _, axes = np.linalg.eigh(sample.T @ sample)
    rotation = np.ascontiguousarray(axes[:, ::-1]).astype(np.float32)
    x = sample @ rotation
    lists = int(max(1, min(rows // list_size, MOST_LISTS, len(x) // 16)))
    centres, near = _k_means(x, lists, rng)
    probes = lists if exact else min(lists, round(probes * max(1.0, (lists / 384) ** GROWTH)))
    members = np.bincount(near, minlength=lists) * (rows / len(x))
    region = _regions(centres, members, block_size)
    regions = int(region.max()) + 1
    asked = np.zeros(regions)
    for low in range(0, len(x), 8192):
        similar = x[low : low + 8192] @ centres.T
        top = np.argpartition(-similar, probes - 1, axis=1)[:, :probes]
        seen = np.zeros((len(top), regions), dtype=bool)
        np.put_along_axis(seen, region[top].astype(np.int64), True, axis=1)
        asked += seen.sum(axis=0)
    up = lambda n, most: np.maximum(1, np.ceil(n / most)).astype(np.int32)
    return Index(rotation, centres.astype(np.float32), region, up(np.bincount(region, weights=members, minlength=regions), block_size), up(asked * (rows / len(x)), slice_size), probes)


def usable(vectors: DataFrame, chunks: DataFrame | None = None, dim: int = DIM) -> DataFrame:
    """(chunk_id, embedding): one usable vector per id, of chunks only where chunks are given.

    Null ids, null embeddings, embeddings with nulls, NaN or another number of numbers and
    all-zero ones are left out.  Of several usable rows of one id the greatest counts.
    """
    good = (F.size("embedding") == dim) & F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 3e38))
    v = vectors.where(F.col("chunk_id").isNotNull() & F.col("embedding").isNotNull() & good).select("chunk_id", "embedding")
    if chunks is not None:
        v = v.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
    return v.groupBy("chunk_id").agg(F.max("embedding").alias("embedding"))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, offsets.buffers()[1], pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32()))


_SENT = "region int, block int, slice int, id long, home int, probes array<int>, v binary"


def _send(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = shared.value
        p = ix.probes
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_numpy()
            x = _unit(batch.column(1)) @ ix.rotation
            for low in range(0, len(x), 2048):
                y, key = x[low : low + 2048], ids[low : low + 2048]
                near = y @ ix.centres.T
                top = np.argpartition(-near, p - 1, axis=1)[:, :p]
                home = near.argmax(1)
                half = y.astype(np.float16)
                where, own = ix.region[top], ix.region[home]
                mixed = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                # As a query: once to every block of every region that holds a probed list, in the slice of its id.
                pairs = np.unique(np.stack([np.repeat(np.arange(len(y)), p), where.ravel()], axis=1), axis=0)
                n_blocks = ix.blocks[pairs[:, 1]]
                rows = np.repeat(pairs, n_blocks, axis=0)
                q, r = rows[:, 0], rows[:, 1]
                block = np.arange(len(rows)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
                cut_ = (mixed[q] // np.uint64(64) % ix.slices[r].astype(np.uint64)).astype(np.int32)
                my_block, my_slice = (mixed % ix.blocks[own].astype(np.uint64)).astype(np.int32), (mixed // np.uint64(64) % ix.slices[own].astype(np.uint64)).astype(np.int32)
                at_home = (own[q] == r) & (my_block[q] == block)
                probed = [t[w == z].astype(np.int32) for t, w, z in zip(top[q], where[q], r, strict=True)]
                # As a member: to its block in every other slice.
                others = ix.slices[own] - 1
                m = np.repeat(np.arange(len(y)), others)
                other = np.arange(len(m)) - np.repeat(np.cumsum(others) - others, others)
                other = other + (other >= my_slice[m])
                both = lambda a, b: pa.array(np.concatenate([a, b]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [both(r, own[m]), both(block, my_block[m]), both(cut_, other), pa.array(np.concatenate([key[q], key[m]])), both(np.where(at_home, home[q], -1), home[m]),
                     _lists(probed + [np.zeros(0, np.int32)] * len(m)), _binary(half[np.concatenate([q, m])])],
                    ["region", "block", "slice", "id", "home", "probes", "v"],
                )

    return run


def scan(queries: np.ndarray, candidates: np.ndarray, floor: np.ndarray, rest_q: list[np.ndarray], rest_c: list[np.ndarray], z: float = TEST_Z) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, similarity) of the pairs that are not abandoned and reach the query's floor.

    rest_q and rest_c are the norms of the numbers behind each column block; what they
    still add to a dot product is about normal with deviation rest_q * rest_c / sqrt(columns left).
    """
    first, *more = COLUMN_BLOCKS
    # One more column holds the norms of the rest, so the product is the dot product so far plus its slack.
    part = np.c_[queries[:, :first], rest_q[0] * (z / np.sqrt(DIM - first))] @ np.c_[candidates[:, :first], rest_c[0]].T
    qi, ci = np.divmod(np.flatnonzero(part >= floor[:, None]), part.shape[1])
    s = part[qi, ci] - rest_q[0][qi] * rest_c[0][ci] * np.float32(z / np.sqrt(DIM - first))
    done = first
    for k, to in enumerate(more, 1):
        s = s + np.einsum("ij,ij->i", queries[qi, done:to], candidates[ci, done:to])
        slack = (z / np.sqrt(DIM - to)) * rest_q[k][qi] * rest_c[k][ci] if to < DIM else 0.0
        keep = s + slack >= floor[qi]
        qi, ci, s, done = qi[keep], ci[keep], s[keep], to
    return qi, ci, s


def _scan_block(shared, k: int, z: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, home = table["id"].to_numpy(), table["home"].to_numpy()
        sent = table["v"].combine_chunks()
        sent = sent.chunk(0) if isinstance(sent, pa.ChunkedArray) else sent
        begin = np.frombuffer(sent.buffers()[1], dtype=np.int32)[sent.offset]
        v = np.frombuffer(sent.buffers()[2], dtype=np.float16, offset=int(begin), count=len(ids) * DIM).reshape(-1, DIM).astype(np.float32)
        del sent
        probes = table["probes"].combine_chunks()
        probe_list, probe_query = probes.flatten().to_numpy(), np.repeat(np.arange(len(ids)), np.diff(probes.offsets.to_numpy()))
        rests = [np.sqrt(np.maximum((v[:, b:] ** 2).sum(1), 0)) for b in COLUMN_BLOCKS]
        # The nearest list here is searched whole; its k-th best is the floor for the others.
        centres = shared.value.centres
        near = np.einsum("ij,ij->i", v[probe_query], centres[probe_list])
        order = np.lexsort((-near, probe_query))
        first = np.zeros(len(order), dtype=bool)
        first[order[np.r_[True, probe_query[order][1:] != probe_query[order][:-1]]]] = True
        members = {int(c): np.nonzero(home == c)[0] for c in np.unique(home[home >= 0])}
        floor = np.full(len(ids), -2.0, dtype=np.float32)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for stage in (True, False):
            chosen = np.nonzero(first == stage)[0]
            chosen = chosen[np.argsort(probe_list[chosen], kind="stable")]
            cuts = np.nonzero(np.diff(probe_list[chosen]))[0] + 1
            for part in np.split(chosen, cuts) if len(chosen) else []:
                c = members.get(int(probe_list[part[0]]))
                if c is None:
                    continue
                for low in range(0, len(part), 1024):
                    q = probe_query[part[low : low + 1024]]
                    for at in range(0, len(c), 2048):
                        cc = c[at : at + 2048]
                        if stage:
                            s = v[q] @ v[cc].T
                            s[ids[q][:, None] == ids[cc][None, :]] = -3
                            m = min(k, len(cc))
                            best = np.argpartition(-s, m - 1, axis=1)[:, :m]
                            value = np.take_along_axis(s, best, axis=1)
                            if m == k:
                                floor[q] = np.maximum(floor[q], value.min(axis=1))
                            out.append((np.repeat(q, m), cc[best.ravel()], value.ravel()))
                        else:
                            qi, ci, s = scan(v[q], v[cc], floor[q], [r[q] for r in rests], [r[cc] for r in rests], z)
                            out.append((q[qi], cc[ci], s))
        if not out:
            return pa.table({"id": pa.array([], pa.int64()), "near": pa.array([], pa.list_(pa.int64())), "sim": pa.array([], pa.list_(pa.float32()))})
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        keep = (ids[q] != ids[c]) & (s > -2)
        q, c, s = q[keep], c[keep], s[keep]
        order = np.lexsort((ids[c], -s, q))
        q, c, s = q[order], c[order], s[order]
        starts = np.nonzero(np.r_[True, q[1:] != q[:-1]])[0] if len(q) else np.zeros(0, int)
        rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
        q, c, s = q[rank < k], c[rank < k], s[rank < k]
        starts = np.nonzero(np.r_[True, q[1:] != q[:-1]])[0] if len(q) else np.zeros(0, int)
        offsets = pa.array(np.r_[starts, len(q)].astype(np.int32))
        return pa.table({"id": ids[q[starts]], "near": pa.ListArray.from_arrays(offsets, pa.array(ids[c])), "sim": pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32)))})

    return run


def _search(numbered: DataFrame, rows: int, k: int, probes: int, exact: bool) -> DataFrame:
    """(id, near, sim): per vector, region block and slice the k best found there."""
    spark = numbered.sparkSession
    got = numbered.select("embedding").orderBy(F.xxhash64("id")).limit(min(SAMPLE_ROWS, max(4096, 64 * (rows // LIST_SIZE)))).toArrow().combine_chunks()
    shared = spark.sparkContext.broadcast(fit(_unit(got["embedding"].combine_chunks()), rows, probes=probes, exact=exact))  # at most MOST_LISTS centres
    sent = numbered.select("id", "embedding").mapInArrow(_send(shared), _SENT)
    return sent.groupBy("region", "block", "slice").applyInArrow(_scan_block(shared, k, 100.0 if exact else TEST_Z), "id long, near array<long>, sim array<float>")


def _copies(v: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """v (id, chunk_id, embedding) without surplus copies, and those.

    Of the chunks with one and the same vector the k + 1 smallest ids are searched; the
    others are surplus, with the group's id (the smallest of its ids).  A vector shared by
    many is ranked within salted parts before it is ranked whole.
    """
    keyed = v.select("id", "chunk_id", F.xxhash64("embedding").alias("h1"), F.hash("embedding").alias("h2"))
    large = keyed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min_by("id", "chunk_id").alias("leader")).where(F.col("n") > k + 1).drop("n")
    members = cut(keyed.join(large, ["h1", "h2"]).select("id", "chunk_id", "leader"))
    w = Window.partitionBy("leader", F.pmod(F.xxhash64("chunk_id"), F.lit(64))).orderBy("chunk_id")
    part = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1)
    kept = part.withColumn("r", F.row_number().over(Window.partitionBy("leader").orderBy("chunk_id"))).where(F.col("r") <= k + 1).select("id")
    surplus = members.join(kept, "id", "left_anti")
    return v.join(surplus.select("id"), "id", "left_anti"), surplus


def _start(vectors: DataFrame, chunks: DataFrame | None) -> tuple[DataFrame, int]:
    v = cut(usable(vectors, chunks).withColumn("id", F.monotonically_increasing_id()))
    return v, v.count()


def neighbours(vectors: DataFrame, chunks: DataFrame | None = None, k: int = K, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """(chunk_id, neighbours): the k most similar other chunks of every usable vector, by cosine.

    neighbours is an array of (similarity, chunk_id), best first, ties by smaller id.
    Of chunks with the same vector the k + 1 smallest ids are searched and the others get
    those as neighbours, at similarity 1.  Accuracy: lists outside the probed ones are not
    seen and tests can err, see PROBES and TEST_Z; the recall is measured in tests.  With
    exact every list is probed and no candidate abandoned, at quadratic cost; only ties
    within HALF_ERROR at the k-th place remain open.  Similarities are rounded to half
    precision.  An empty table gives an empty result.
    """
    v, rows = _start(vectors, chunks)
    if not rows:
        return v.select("chunk_id", F.array().cast("array<struct<similarity:float,chunk_id:string>>").alias("neighbours"))
    searched, surplus = _copies(v, k)
    found = _search(searched, rows, k, probes, exact)
    merged = found.groupBy("id").agg(F.flatten(F.collect_list(F.arrays_zip("near", "sim"))).alias("z"))
    best = merged.select("id", F.explode(F.slice(F.array_sort(F.transform("z", lambda e: F.struct((-e["sim"]).alias("s"), e["near"].alias("near")))), 1, k)).alias("e"))
    names = v.select("id", "chunk_id")
    named = best.select("id", "e.s", F.col("e.near").alias("near")).join(names.toDF("near", "other"), "near")
    lists = named.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("s", F.col("other").alias("o")))).alias("es"))
    own = lists.join(names, "id")
    # A surplus copy takes its leader and the leader's copies among its neighbours.
    copied = surplus.select("chunk_id", F.col("leader").alias("id")).join(own.withColumnRenamed("chunk_id", "first"), "id")
    copied = copied.select("chunk_id", F.slice(F.concat(F.array(F.struct(F.lit(-1.0).cast("float").alias("s"), F.col("first").alias("o"))), "es"), 1, k).alias("es"))
    rows_out = own.select("chunk_id", "es").unionByName(copied)
    return rows_out.select("chunk_id", F.transform("es", lambda e: F.struct((-e["s"]).alias("similarity"), e["o"].alias("chunk_id"))).alias("neighbours"))


def similar_pairs(vectors: DataFrame, chunks: DataFrame | None = None, least: float = 0.9, k: int = K, probes: int = PROBES, exact: bool = False) -> DataFrame:
    """Distinct (chunk_id_a, chunk_id_b), smaller id first, of the scan's hits at or above a cosine.

    The scan keeps the k best of every vector per region block, so up to k partners of a
    vector are kept; hits near the bound are scored again on the vectors as given.  Surplus
    copies (see neighbours) are paired with their group's first chunk.  An empty table
    gives an empty result.
    """
    v, rows = _start(vectors, chunks)
    if not rows:
        return v.select(F.col("chunk_id").alias("chunk_id_a"), F.col("chunk_id").alias("chunk_id_b"))
    searched, surplus = _copies(v, k)
    found = _search(searched, rows, k, probes, exact)
    close = F.filter(F.arrays_zip("near", "sim"), lambda e: e["sim"] >= least - HALF_ERROR)
    hits = found.select("id", F.explode(close).alias("x")).groupBy(F.least("id", "x.near").alias("i"), F.greatest("id", "x.near").alias("j")).agg(F.max("x.sim").alias("sim"))
    copies = surplus.select(F.least("id", "leader").alias("i"), F.greatest("id", "leader").alias("j"))
    hits = cut(hits)  # its size is known from here on, so that vectors and names are not moved to a few pairs
    given = v.select("id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    doubtful = cut(hits.where(F.col("sim") < least + HALF_ERROR).select("i", "j"))
    doubtful = doubtful.join(given.toDF("i", "x"), "i").join(given.toDF("j", "y"), "j")
    settled = doubtful.where(dot("x", "y") >= least * F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))).select("i", "j")
    sure = hits.where(F.col("sim") >= least + HALF_ERROR).select("i", "j")
    names = v.select("id", "chunk_id")
    pairs = sure.unionByName(settled).unionByName(copies).join(names.toDF("i", "a"), "i").join(names.toDF("j", "b"), "j")
    return pairs.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()
