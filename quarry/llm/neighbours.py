"""Most similar vectors by inverted lists of randomly rotated one-bit codes (problem 3).

Vectors are made unit vectors and assigned to lists. A list is a pair of a coarse centroid and a fine one, which refines
every coarse one alike, so the number of lists follows the number of vectors while both kinds are fitted on a bounded
sample. A member of a list is kept as the signs of its rotated residual (one bit a dimension) with two correction
scalars, its residual's length and the inner product of the residual with its own code. A query visits its nearest
lists; the inner product with each member is estimated from bit counts against the query's rotated residual in four bit
planes, and an error bound on the estimate says which members can still matter. Only these are compared by their vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F


#: What a row does in a list.
MEMBER, QUERY = 1, 2


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the rows the centroids are fitted on (drawn by a hash of the id); all rows are indexed."""

    k: int = 10
    #: Lists a vector visits where a floor is given (tuned for one of about 0.9), and where the nearest are wanted at any distance.
    probes: int = 6
    probes_nearest: int = 32
    list_size: int = 600
    sample: int = 32_768
    #: Coarse centroids at most; more lists come from fine centroids, as many for each coarse one.
    most_coarse: int = 2048
    #: Coarse centroids whose lists a vector is compared with.
    near_coarse: int = 12
    #: Bytes that a task of the comparison gets, about.
    task_bytes: int = 48 << 20
    #: Vectors that occur so often or more, and in a ten-thousandth of all rows, are searched for and in once.
    many_copies: int = 64
    #: Width of the error bound in standard deviations of the estimate.
    bound: float = 3.5
    #: Members and queries of a list that meet in one task; larger lists are cut into blocks of either.
    member_block: int = 8192
    query_block: int = 16384
    seed: int = 7


def unit(matrix: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(matrix.astype(np.float64), axis=1, keepdims=True)
    return (matrix / np.where(norm > 0, norm, 1)).astype(np.float32)


def rotation(dimensions: int, seed: int) -> np.ndarray:
    """A random rotation: the orthogonal factor of a Gaussian matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, dimensions)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def fit_centroids(sample: np.ndarray, count: int, seed: int, rounds: int = 8, spherical: bool = True) -> np.ndarray:
    """k-means, on the sphere or in space; a list that loses all its rows keeps its centroid."""
    rng = np.random.default_rng(seed)
    count = max(1, min(count, len(sample)))
    centroids = sample[rng.choice(len(sample), count, replace=False)].copy()
    for _ in range(rounds if count > 1 else 1):
        half = (centroids * centroids).sum(1) / 2
        own = np.concatenate([(sample[i : i + 8192] @ centroids.T - half).argmax(1) for i in range(0, len(sample), 8192)])
        order = np.argsort(own, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(own[order]) > 0])
        sums = np.add.reduceat(sample[order], starts, axis=0)
        centroids[own[order][starts]] = unit(sums) if spherical else sums / np.diff(np.r_[starts, len(order)])[:, None]
    return centroids


class Codes:
    """One-bit codes of the members of one list."""

    def __init__(self, members: np.ndarray, centroid: np.ndarray, turn: np.ndarray):
        residual = members - centroid
        self.length = np.linalg.norm(residual, axis=1)
        turned = (residual / np.where(self.length > 0, self.length, 1)[:, None]) @ turn.T
        self.dimensions = members.shape[1]
        bits = turned > 0
        self.fit = np.maximum(np.abs(turned).sum(1) / np.sqrt(self.dimensions), 1e-3)  # <code, residual>, at most 1
        self.packed = _pack(bits)
        self.ones = np.bitwise_count(self.packed).sum(1).astype(np.float32)
        self.offset = residual @ centroid
        fit = np.minimum(self.fit, 1.0)
        self.error = np.sqrt((1 - fit * fit) / (fit * fit) / max(1, self.dimensions - 1)) * self.length

    def estimate(self, queries: np.ndarray, centroid: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inner products of all queries with all members, and the standard deviations of their errors."""
        residual = queries - centroid
        turned = residual @ turn.T
        low = turned.min(1, keepdims=True)
        step = np.maximum((turned.max(1, keepdims=True) - low) / 15, 1e-12)
        level = np.rint((turned - low) / step).astype(np.uint8)
        count = np.zeros((len(queries), len(self.packed)), np.uint16)
        for plane in range(4):
            words = _pack((level >> plane) & 1 > 0)
            for w in range(words.shape[1]):
                part = np.bitwise_count(words[:, w, None] & self.packed[None, :, w])
                count += part.astype(np.uint16) << plane
        # <2 b - 1, low + step * level> / sqrt(D), from sum(b * level), sum(b) and the query's own sum.
        total = (low[:, 0] * self.dimensions + step[:, 0] * level.sum(1))[:, None]
        product = (2 * step) * count.astype(np.float32) + (2 * low) * self.ones[None, :] - total
        scale = (self.length / self.fit / np.sqrt(self.dimensions)).astype(np.float32)
        at = (queries @ centroid)[:, None] + self.offset[None, :] + product.astype(np.float32) * scale[None, :]
        return at, np.linalg.norm(residual, axis=1)[:, None] * self.error[None, :]


def _pack(bits: np.ndarray) -> np.ndarray:
    width = -(-bits.shape[1] // 64) * 64
    if width != bits.shape[1]:
        bits = np.pad(bits, ((0, 0), (0, width - bits.shape[1])))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def search_list(query_ids, queries, member_ids, members, centroid, turn, k, floor, bound) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of one list: (query id, member id, similarity) of the ``k`` best members of each query, at least ``floor``."""
    # Repeated rows of an id lie side by side: the limit is taken over ids, and an id takes one place.
    by_id = np.argsort(member_ids, kind="stable")
    if (member_ids[by_id[1:]] == member_ids[by_id[:-1]]).any():
        member_ids, members = member_ids[by_id], members[by_id]
        starts = np.flatnonzero(np.r_[True, member_ids[1:] != member_ids[:-1]])
    else:
        starts = np.arange(len(member_ids))
    codes = Codes(members, centroid, turn)
    rows = max(1, 400_000 // len(members))
    for start in range(0, len(queries), rows):
        part, ids = queries[start : start + rows], query_ids[start : start + rows]
        at, error = codes.estimate(part, centroid, turn)
        least = np.full((len(part), 1), max(floor, -1.0), np.float32)
        if floor <= -1 and len(starts) > k + 1:
            # The k + 1 ids of best estimate (one may be the query) are compared first: what can't reach the last of them is out.
            best = np.maximum.reduceat(at, starts, axis=1) if len(starts) < len(members) else at
            first = np.argpartition(-best, k, axis=1)[:, : k + 1]
            ends = np.r_[starts[1:], len(members)] - 1
            sure = np.einsum("qd,qkd->qk", part, members[starts[first]])
            if len(starts) < len(members):
                sure = np.maximum(sure, np.einsum("qd,qkd->qk", part, members[ends[first]]))
            least = sure.min(1, keepdims=True)
        a, b = np.nonzero(at + bound * error >= least - 1e-6)
        similar = np.concatenate([np.einsum("ij,ij->i", part[a[i : i + 65536]], members[b[i : i + 65536]]) for i in range(0, max(1, len(a)), 65536)])
        keep = similar >= max(floor, -1.0) - 1e-6
        a, b, similar = a[keep], b[keep], similar[keep]
        other = ids[a] != member_ids[b]
        a, b, similar = a[other], b[other], similar[other]
        order = np.lexsort((-similar, member_ids[b], a))
        a, b, similar = a[order], b[order], similar[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (member_ids[b[1:]] != member_ids[b[:-1]])] if len(a) else np.zeros(0, bool)
        a, b, similar = a[fresh], b[fresh], similar[fresh]
        order = np.lexsort((member_ids[b], -similar, a))
        a, b, similar = a[order], b[order], similar[order]
        first = np.searchsorted(a, a, side="left")
        best = np.arange(len(a)) - first < k
        yield ids[a[best]], member_ids[b[best]], similar[best]


class Index:
    """Coarse and fine centroids by vector length, and the blocks their lists are cut into.

    List ``i * fine + j`` of a length has the sum of coarse centroid ``i`` and fine centroid ``j`` in its middle.
    """

    def __init__(self, sample: dict[int, np.ndarray], counts: dict[int, int], settings: Settings, probes: int, asking: float = 1.0):
        """``asking`` is the share of the rows that are searched for."""
        self.settings, self.probes, self.asking = settings, probes, asking
        self.coarse: dict[int, np.ndarray] = {}
        self.fine: dict[int, np.ndarray] = {}
        self.half: dict[int, np.ndarray] = {}
        self.turns: dict[int, np.ndarray] = {}
        self.blocks: dict[int, np.ndarray] = {}
        self.query_blocks: dict[int, np.ndarray] = {}
        self.base: dict[int, int] = {}
        lists = 0
        for dimensions, rows in sorted(counts.items()):
            matrix = unit(sample[dimensions]) if dimensions in sample else np.zeros((1, dimensions), np.float32)
            wanted, most = -(-rows // settings.list_size), max(1, len(matrix) // 16)
            coarse = fit_centroids(matrix, min(settings.most_coarse, wanted, most), settings.seed)
            each = min(-(-wanted // len(coarse)), most)
            rest = matrix - coarse[(matrix @ coarse.T).argmax(1)]
            fine = fit_centroids(rest, each, settings.seed, spherical=False) if each > 1 else np.zeros((1, dimensions), np.float32)
            self.coarse[dimensions], self.fine[dimensions], self.turns[dimensions] = coarse, fine, rotation(dimensions, settings.seed)
            self.half[dimensions] = (((coarse * coarse).sum(1)[:, None] + (fine * fine).sum(1)[None, :]) / 2 + coarse @ fine.T).astype(np.float32)
            near = self.nearest(matrix, probes)
            self.blocks[dimensions] = self._blocks(near[:, :1], len(coarse), len(fine), rows / max(1, len(matrix)), settings.member_block)
            # A list near the middle of everything may be visited by all queries, however few members it has.
            self.query_blocks[dimensions] = self._blocks(near, len(coarse), len(fine), rows * asking / max(1, len(matrix)), settings.query_block)
            self.base[dimensions] = lists
            lists += len(coarse) * len(fine)
        self.lists = lists

    @staticmethod
    def _blocks(near: np.ndarray, coarse: int, fine: int, times: float, most: int) -> np.ndarray:
        """Blocks of each list, from its share of the sample's visits; where lists outnumber the sample, shares of both centroids multiply."""
        number = near.ravel()
        share = np.outer(np.bincount(number // fine, minlength=coarse), np.bincount(number % fine, minlength=fine)) / max(1, len(number))
        return np.maximum(1, np.ceil(share.ravel() * (times / most))).astype(np.int32)

    def nearest(self, matrix: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` nearest lists of each row, the nearest first, among those of its nearest coarse centroids."""
        coarse, fine, half = (x[matrix.shape[1]] for x in (self.coarse, self.fine, self.half))
        among, probes = min(len(coarse), max(self.settings.near_coarse, probes)), min(probes, len(coarse) * len(fine))
        rows, out = max(1, (4 << 20) // max(len(coarse), among * len(fine))), []
        for part in (matrix[i : i + rows] for i in range(0, len(matrix), rows)):
            near = part @ coarse.T
            top = np.argpartition(-near, among - 1, axis=1)[:, :among]
            score = (np.take_along_axis(near, top, 1)[:, :, None] + (part @ fine.T)[:, None, :] - half[top]).reshape(len(part), -1)
            number = (top[:, :, None] * len(fine) + np.arange(len(fine))[None, None, :]).reshape(len(part), -1)
            best = np.argpartition(-score, probes - 1, axis=1)[:, :probes]
            order = np.lexsort((np.take_along_axis(number, best, 1), -np.take_along_axis(score, best, 1)), axis=1)
            out.append(np.take_along_axis(np.take_along_axis(number, best, 1), order, 1))
        return np.concatenate(out) if out else np.zeros((0, probes), np.int64)

    def place(self, number: int) -> tuple[int, np.ndarray]:
        """The vector length and the middle of a running list number."""
        dimensions = max((d for d, b in self.base.items() if b <= number), key=lambda d: self.base[d])
        i, j = divmod(number - self.base[dimensions], len(self.fine[dimensions]))
        return dimensions, self.coarse[dimensions][i] + self.fine[dimensions][j]


def fit_index(vectors: DataFrame, settings: Settings, counts: dict[int, int], probes: int, wanted=None) -> Index:
    """Fits centroids on at most ``settings.sample`` rows, drawn alike from every length of vector by a hash of the id."""
    total = sum(counts.values())
    # By share of the rows, but at least some thousand of each length, so that rare lengths are fitted too.
    share = F.lit(0.0)
    for dimensions, rows in counts.items():
        share = F.when(F.size("vector") == dimensions, F.lit(min(1.0, max(settings.sample / total, min(2000, settings.sample) / rows)))).otherwise(share)
    drawn = F.pmod(F.xxhash64("id", F.lit(settings.seed)), F.lit(1 << 30)) < share * (1 << 30)
    sample = vectors.filter(drawn).select("id", "vector", (F.lit(True) if wanted is None else wanted).alias("asks")).toArrow().combine_chunks()
    if not len(sample):
        return Index({}, counts, settings, probes)
    asking = (sample.column("asks").to_numpy().sum() + 1) / (len(sample) + 1)
    column = sample.column("vector").chunk(0).take(pa.array(np.argsort(sample.column("id").to_numpy(), kind="stable")))
    sizes, values = np.diff(column.offsets.to_numpy()), column.values.to_numpy()
    of_value = np.repeat(sizes, sizes)
    return Index({int(d): values[of_value == d].reshape(-1, d) for d in np.unique(sizes)}, counts, settings, probes, asking)


def usable_vectors(df: DataFrame, key: str = "chunk_id", vector: str = "embedding") -> DataFrame:
    """``id, vector`` of the rows that have neighbours: an id, and a vector without null, NaN or infinite elements, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"))


def _often(vectors: DataFrame, total: int, settings: Settings) -> tuple[DataFrame, DataFrame] | None:
    """Vectors of very many rows: ``one, two, vector``, at most 10,000, and their lowest ids ``one, two, id, place``; None without any."""
    least = max(settings.many_copies, total // 10_000 + 1)
    often = vectors.groupBy("one", "two").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("one", "two").collect()
    if not often:
        return None
    marks = vectors.sparkSession.createDataFrame(often, "one long, two long")
    rows = vectors.join(F.broadcast(marks), ["one", "two"])
    order = W.partitionBy("one", "two").orderBy("id")
    lowest = rows.select("one", "two", "id").distinct().withColumn("place", F.row_number().over(order)).filter(F.col("place") <= settings.k + 1)
    return rows.groupBy("one", "two").agg(F.first("vector").alias("vector")), lowest


def nearest_neighbours(df: DataFrame, key: str = "chunk_id", vector: str = "embedding", floor: float = -1.0, queries=None, settings: Settings = Settings()) -> DataFrame:
    """``id, neighbour, similarity``: for each vector its ``settings.k`` most similar others by cosine, of at least ``floor``.

    ``queries`` is a condition on ``id`` that chooses the rows to search for; every row is searched in. Repeated rows
    of an id count once; null, all-zero and non-finite vectors have no neighbours; vectors of different lengths never
    meet. Ties go to the lower id. One shuffle brings members and queries of a list together; lists over
    ``member_block`` rows or ``query_block`` visits are cut into blocks of members and of queries, so none is gathered in
    one task. Of a vector that very many rows have only the ``k + 1`` lowest ids take part: no more can be neighbours
    of anything, and the last of them has the neighbours of all further ones.
    """
    vectors = usable_vectors(df, key, vector).withColumn("one", F.xxhash64("vector")).withColumn("two", F.xxhash64(F.lit(1), "vector"))
    counts = {r["dimensions"]: r["count"] for r in vectors.groupBy(F.size("vector").alias("dimensions")).count().collect()}  # as many rows as there are lengths
    often = _often(vectors, sum(counts.values()), settings)
    wanted = F.lit(True) if queries is None else queries
    everyone = vectors
    vectors = vectors.withColumn("asks", wanted)
    if often is not None:
        kept = often[1].join(F.broadcast(often[0]), ["one", "two"]).select("id", "vector", (wanted | (F.col("place") == settings.k + 1)).alias("asks"))
        vectors = vectors.join(F.broadcast(often[0].select("one", "two")), ["one", "two"], "left_anti").select("id", "vector", "asks").unionByName(kept)
    probes = settings.probes if floor > -1 else settings.probes_nearest
    index = fit_index(vectors, settings, counts, probes, F.col("asks"))
    shared = df.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            ids, asks = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2).to_numpy(zero_copy_only=False)
            lists = batch.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            for dimensions in np.unique(sizes):
                rows = np.flatnonzero(sizes == dimensions)
                matrix = unit(values[(offsets[rows][:, None] + np.arange(dimensions)[None, :])])
                near = index.nearest(matrix, probes)
                blocks, parts, base = index.blocks[dimensions], index.query_blocks[dimensions], index.base[dimensions]
                home = near[:, 0]
                salt = (ids[rows].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                out_rows, out_list, out_member, out_query, out_role = [], [], [], [], []

                def add(row, number, member, query, role):
                    out_rows.append(row), out_list.append(number), out_member.append(member), out_query.append(query)
                    out_role.append(np.full(len(row), role, np.int8))

                # In a list of one block a row that asks is its own query as well, and isn't sent twice.
                asks_here = asks[rows]
                both = asks_here & (blocks[home] == 1) & (parts[home] == 1)
                for q in range(int(parts[home].max())):
                    here = np.flatnonzero((parts[home] > q) & ~both)
                    add(here, home[here], (salt[here] % blocks[home[here]].astype(np.uint64)).astype(np.int64), np.full(len(here), q), MEMBER)
                here = np.flatnonzero(both)
                add(here, home[here], np.zeros(len(here), np.int64), np.zeros(len(here), np.int64), MEMBER | QUERY)
                for p in range(near.shape[1]):
                    asking = np.flatnonzero(asks_here & ~both if p == 0 else asks_here)
                    number = near[asking, p]
                    for m in range(int(blocks[number].max()) if len(number) else 0):
                        here = np.flatnonzero(blocks[number] > m)
                        add(asking[here], number[here], np.full(len(here), m), (salt[asking[here]] % parts[number[here]].astype(np.uint64)).astype(np.int64), QUERY)
                row = np.concatenate(out_rows)
                packed = matrix[row].tobytes()
                width = dimensions * 4
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((np.arange(len(row) + 1, dtype=np.int32) * width).tobytes()), pa.py_buffer(packed)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array((np.concatenate(out_list) + base).astype(np.int32)), pa.array(np.concatenate(out_member).astype(np.int32)), pa.array(np.concatenate(out_query).astype(np.int32)), pa.array(np.concatenate(out_role)), pa.array(ids[rows][row]), binary],
                    ["list", "member_part", "query_part", "role", "id", "vector"],
                )

    schema = "list int, member_part int, query_part int, role byte, id long, vector binary"
    placed = vectors.select("id", "vector", "asks").mapInArrow(assign, schema)
    # As many tasks as keep each at about the same size, whatever the number of vectors.
    sent = sum(n * (4 * d + 24) for d, n in counts.items()) * (1 + probes * index.asking)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartition(max(least, int(sent // settings.task_bytes) + 1), "list", "member_part", "query_part")

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        index = shared.value
        dimensions, middle = index.place(key[0].as_py())
        role = table.column("role").to_numpy()
        ids = table.column("id").to_numpy()
        vectors = np.frombuffer(b"".join(table.column("vector").to_pylist()), np.float32).reshape(-1, dimensions)
        member, query = np.flatnonzero(role & MEMBER), np.flatnonzero(role & QUERY)
        found = []
        if len(member) and len(query):
            found = list(search_list(ids[query], vectors[query], ids[member], vectors[member], middle, index.turns[dimensions], settings.k, floor, settings.bound))
        columns = [np.concatenate([f[i] for f in found]) if found else np.zeros(0) for i in range(3)]
        return pa.table({"id": pa.array(columns[0], pa.int64()), "neighbour": pa.array(columns[1], pa.int64()), "similarity": pa.array(columns[2], pa.float32())})

    near = placed.groupBy("list", "member_part", "query_part").applyInArrow(compare, "id long, neighbour long, similarity float")
    found = _best(near, settings.k)
    if often is None:
        return found
    # The further rows of a vector get the neighbours of its last one that took part.
    last = often[1].filter(F.col("place") == settings.k + 1).select("one", "two", F.col("id").alias("last"))
    theirs = found.join(F.broadcast(last), F.col("id") == F.col("last")).select("one", "two", "neighbour", "similarity")  # at most 10,000 times k rows
    further = everyone.filter(wanted).join(F.broadcast(last), ["one", "two"]).filter(F.col("id") > F.col("last")).select("one", "two", "id").distinct()
    both = found.filter(wanted).unionByName(further.join(F.broadcast(theirs), ["one", "two"]).select("id", "neighbour", "similarity"))
    return _best(both, settings.k)


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each id. A pair may be found in several blocks of repeated rows: partial aggregation first."""
    once = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("minus"), "neighbour"))), 1, k)  # at most k a list visited
    each = once.groupBy("id").agg(best.alias("best")).select("id", F.explode("best").alias("n"))
    return each.select("id", F.col("n.neighbour").alias("neighbour"), (-F.col("n.minus")).alias("similarity"))


def similar_pairs(neighbours: DataFrame, floor: float) -> DataFrame:
    """``chunk_id_a, chunk_id_b`` (a < b): each pair that is among the neighbours of either side, once."""
    kept = neighbours.filter(F.col("similarity") >= F.lit(floor))
    return kept.select(F.least("id", "neighbour").alias("chunk_id_a"), F.greatest("id", "neighbour").alias("chunk_id_b")).distinct()
