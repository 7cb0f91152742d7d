"""Problem 4: the k most similar vectors of every vector.

Method: Gaussian (2-stable) projections to few dimensions, indexed by a kd-tree. Of two points at distance d
the squared projected distance is d^2 times a chi-square variable, so a point may be left out once its
projected distance is so large that a neighbour nearer than the k-th found would lie below it with the given
probability. A query takes the tree's leaves by growing projected distance, verifies their vectors, and stops
when that test holds for its k-th distance so far.

The kd-tree's upper leaves are the cells of the distributed index; a vector is at home in one cell and is sent
as a query to every later cell whose box passes the test, so each pair of cells meets once. Cells are split
further into small leaves, which are what a query walks. Vectors travel as 8-bit codes; what is returned is
scored exactly. Equal vectors are one point from the start.

How much the test rules out depends on the data: neighbours at a cosine of 0.8 lie at 0.45 of the distance of
unlike vectors, and most cells are left out; where the tenth neighbour has a cosine of 0.3, few are.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.session import stored

#: Projected dimensions, confidence of the stopping test where a least cosine bounds the search and where none does, seed.
DIMENSIONS, CONFIDENCE, OPEN_CONFIDENCE, SEED = 4, 0.5, 0.6, 20_24
#: Vectors in a cell, and in a leaf within it.
CELL, LEAF = 8_192, 128
#: Bounds of what the driver holds: projected vectors sampled for the tree, and cells. Larger cells are cut into blocks.
SAMPLE, CELLS = 65_536, 16_384
#: Neighbours kept beyond k until they are scored exactly.
SPARE = 6
#: Queries that a cell answers at once.
BATCH = 4_096


def chi_square_cdf(x: float, m: int) -> float:
    """P(X <= x) of a chi-square variable with m degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-15:
        n += 1
        term *= h / n
        total += term
    return min(1.0, total * math.exp(-h + a * math.log(h) - math.lgamma(a)))


def chi_square_quantile(p: float, m: int) -> float:
    low, high = 0.0, float(m)
    while chi_square_cdf(high, m) < p:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square_cdf(middle, m) < p else (low, middle)
    return high


def projection(dim: int, m: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, m)).astype(np.float32)


class Tree:
    """A kd-tree in heap order: boxes of all nodes, cuts of the inner ones. Leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.levels = max(0, math.ceil(math.log2(max(1, cells))))
        m = sample.shape[1]
        inner = 2**self.levels - 1
        self.axis, self.at = np.zeros(inner, np.int64), np.zeros(inner, np.float32)
        self.low, self.high = np.full((2 * inner + 1, m), -np.inf, np.float32), np.full((2 * inner + 1, m), np.inf, np.float32)
        parts = {0: sample}
        for node in range(inner):
            p = parts.pop(node)
            low, high = self.low[node], self.high[node]
            axis = int(np.argmax(p.var(axis=0))) if len(p) > 1 else node % m
            at = np.float32(np.median(p[:, axis])) if len(p) else np.float32(0 if np.isinf(low[axis]) else low[axis])
            self.axis[node], self.at[node] = axis, at
            for child in (2 * node + 1, 2 * node + 2):
                self.low[child], self.high[child] = low, high
            self.high[2 * node + 1, axis], self.low[2 * node + 2, axis] = min(at, high[axis]), max(at, low[axis])
            inside = p[:, axis] <= at
            parts[2 * node + 1], parts[2 * node + 2] = p[inside], p[~inside]
        self.share = np.array([len(parts[node]) for node in sorted(parts)]) / max(1, len(sample))

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        row = np.arange(len(points))
        for _ in range(self.levels):
            node = 2 * node + 1 + (points[row, self.axis[node]] > self.at[node])
        return node - (2**self.levels - 1)

    def reach(self, points: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Squared projected distance of each point to the box of its node."""
        gap = np.maximum(np.maximum(self.low[node] - points, points - self.high[node]), 0)
        return np.einsum("ij,ij->i", gap, gap)

    def route(self, points: np.ndarray, far: np.ndarray, wide: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) of all leaves that the test does not rule out; far: each point's squared distance still of interest, wide: the largest in each leaf."""
        widest = np.concatenate([np.zeros(2**self.levels - 1, np.float32), wide])
        for node in range(2**self.levels - 2, -1, -1):
            widest[node] = max(widest[2 * node + 1], widest[2 * node + 2])
        row, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for _ in range(self.levels):
            row, node = np.concatenate([row, row]), np.concatenate([2 * node + 1, 2 * node + 2])
            ok = self.reach(points[row], node) <= bound * np.maximum(far[row], widest[node])
            row, node = row[ok], node[ok]
        return row, node - (2**self.levels - 1)


def _best(query: np.ndarray, other: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
    """Positions of the keep best pairs of each query; ties by the other's number."""
    order = np.lexsort((other, -score, query))
    q = query[order]
    first = np.concatenate([[0], np.flatnonzero(np.diff(q)) + 1]) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.concatenate([first, [len(q)]])))
    return order[rank < keep]


class Cell:
    """The vectors at home in a cell, in leaves of a local kd-tree, and the search of queries among them.

    points: numbers, unit: unit vectors, low: projections, far: squared distance of the k-th neighbour known so far.
    """

    def __init__(self, points: np.ndarray, unit: np.ndarray, low: np.ndarray, far: np.ndarray, *, k: int, keep: int, bound: float) -> None:
        self.k, self.keep, self.bound = k, keep, bound
        leaves = [np.arange(len(points))]
        while max(map(len, leaves)) > LEAF:
            halves = []
            for leaf in leaves:
                if len(leaf) <= LEAF:
                    halves.append(leaf)
                    continue
                axis = int(np.argmax(low[leaf].var(axis=0)))
                order = leaf[np.argsort(low[leaf, axis], kind="stable")]
                halves += [order[: len(order) // 2], order[len(order) // 2 :]]
            leaves = halves
        order = np.concatenate(leaves)
        self.points, self.unit, self.low, self.far = points[order], unit[order], low[order], far[order]
        self.cut = np.concatenate([[0], np.cumsum([len(leaf) for leaf in leaves])])
        spans = [slice(a, b) for a, b in zip(self.cut[:-1], self.cut[1:], strict=True)]
        self.box = np.array([self.low[x].min(axis=0) for x in spans]), np.array([self.low[x].max(axis=0) for x in spans])
        self.wide = np.array([self.far[x].max() for x in spans])
        self.spans = spans
        self.verified = 0

    def ask(self, points: np.ndarray, unit: np.ndarray, low: np.ndarray, far: np.ndarray, *, dense: bool, same: bool = False) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(point, other, score) found for the queries, and for the vectors at home unless they ask themselves.

        Leaves are taken by growing projected distance until the test holds. dense: each query's best are kept
        from round to round, so that its k-th distance shrinks; else far bounds the search from the start.
        """
        n, rows = len(points), np.arange(len(points))
        gap = np.zeros((n, len(self.spans)), np.float32)
        for axis in range(low.shape[1]):
            gap += np.maximum(np.maximum(self.box[0][None, :, axis] - low[:, axis, None], low[:, axis, None] - self.box[1][None, :, axis]), 0) ** 2
        order = np.argsort(gap, axis=1, kind="stable")
        kth = far.astype(np.float32).copy()
        best, at = (np.full((n, self.keep), -2, np.float32), np.full((n, self.keep), -1)) if dense else (None, None)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for turn in range(len(self.spans)):
            leaf = order[:, turn]
            near = gap[rows, leaf]
            if not (near <= self.bound * np.maximum(kth, self.wide.max())).any():
                break
            active = near <= self.bound * (kth if same else np.maximum(kth, self.wide[leaf]))
            for x in np.unique(leaf[active]):
                i, home = np.flatnonzero(active & (leaf == x)), self.spans[x]
                score = unit[i] @ self.unit[home].T
                self.verified += score.size
                if same:
                    score[points[i][:, None] == self.points[home][None, :]] = -2
                if not dense or not same:
                    limit = np.minimum(1 - kth[i] / 2, 2)[:, None] if same or not dense else np.full((len(i), 1), 2, np.float32)
                    if not same:
                        limit = np.minimum(limit, 1 - self.far[home][None, :] / 2)
                    a, b = np.nonzero(score >= limit - 0.005)
                    found.append((i[a], b + home.start, score[a, b]))
                if dense:
                    better = np.flatnonzero(score.max(axis=1) > best[i].min(axis=1))
                    if len(better):
                        i, score = i[better], score[better]
                        both = np.concatenate([best[i], score], axis=1)
                        who = np.concatenate([at[i], np.broadcast_to(np.arange(home.start, home.stop), score.shape)], axis=1)
                        top = np.argpartition(-both, self.keep - 1, axis=1)[:, : self.keep]
                        best[i], at[i] = np.take_along_axis(both, top, 1), np.take_along_axis(who, top, 1)
                        full = 2 - 2 * np.partition(best[i], -self.k, axis=1)[:, -self.k] + 0.01
                        kth[i] = np.minimum(kth[i], full)
        if found:
            i, j, score = (np.concatenate(c) for c in zip(*found, strict=True))
            if not dense:
                top = _best(i, j, score, self.keep)
                yield points[i[top]], self.points[j[top]], score[top]
            if not same:
                top = _best(j, i, score, self.keep)
                yield self.points[j[top]], points[i[top]], score[top]
        if dense:
            i, j = np.nonzero(at >= 0)
            yield points[i], self.points[at[i, j]], best[i, j]


def _codes(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors of 8-bit codes."""
    flat = np.frombuffer(b"".join(column.to_pylist()), np.int8).reshape(-1, dim).astype(np.float32)
    return flat / np.linalg.norm(flat, axis=1, keepdims=True)


def usable(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """(key, v) of the rows whose vector has dim finite values, not all zero; one row a key (the smallest vector, should they differ)."""
    v = F.col(vector).cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.filter((F.size(v) == dim) & ~bad & F.exists(v, lambda x: x != 0)).select(F.col(key).alias("key"), v.alias("v"))
    return rows.filter("key is not null").groupBy("key").agg(F.min("v").alias("v"))


def nearest(df: DataFrame, key: str, vector: str, *, k: int = 10, dim: int = 96, least: float | None = None, dimensions: int = DIMENSIONS, confidence: float | None = None, cell: int = CELL) -> DataFrame:
    """(key, other, cosine, rank) of the k most similar other vectors of every usable one, ties by the other's key.

    least: neighbours of a smaller cosine are left out, which also bounds the search. confidence: the probability
    with which a neighbour as far as the k-th (or at the least cosine) passes the test; nearer ones pass it with
    more. Unusable vectors (null, zero, of another length, with nulls or NaN) and null keys give no row. A key
    that repeats counts once. An empty table gives an empty result.
    """
    spark = df.sparkSession
    bound = chi_square_quantile(confidence or (OPEN_CONFIDENCE if least is None else CONFIDENCE), dimensions)
    plane = projection(dim, dimensions)
    farthest = 4.0 if least is None else max(0.0, 2 - 2 * least)
    keep = k + SPARE

    named = usable(df, key, vector, dim).withColumn("point", F.xxhash64("v"))
    named = stored(named.select("key", "point", F.col("v").cast("array<float>").alias("v")))
    members = named.select("point", "key")
    points = named.groupBy("point").agg(F.first("v").alias("v"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64)
            codes = np.rint(v * (127 / np.abs(v).max(axis=1, keepdims=True))).astype(np.int8)
            yield pa.RecordBatch.from_arrays([batch.column("point"), pa.array([c.tobytes() for c in codes], pa.binary())], ["point", "code"])

    coded = stored(points.mapInArrow(encode, "point long, code binary"))
    total = coded.count()
    cells = min(CELLS, max(1, math.ceil(total / cell)))
    some = coded.orderBy("point").limit(SAMPLE).select("code").toArrow().column("code").combine_chunks() if cells > 1 else None
    tree = Tree(_codes(some, dim) @ plane if some is not None else np.zeros((0, dimensions), np.float32), cells)
    cells = 2**tree.levels
    blocks = np.maximum(1, np.ceil(tree.share * total / (2 * cell))).astype(np.int64)  # cells are larger than meant only beyond CELLS
    known = spark.sparkContext.broadcast((tree, plane, blocks))  # bounded by CELLS

    def sent(own: bool, wide: np.ndarray):
        """Rows of each block of a cell: those at home (role 0) and those that ask (role 1). own: only the former."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree, plane, blocks = known.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                p, far = _codes(batch.column("code"), dim) @ plane, batch.column("far").to_numpy()
                home = tree.cell(p)
                row, to = (np.arange(len(p)), home) if own else tree.route(p, far, wide, bound)
                if not own:
                    row, to = row[to > home[row]], to[to > home[row]]
                    row, to = np.concatenate([np.arange(len(p)), row]), np.concatenate([home, to])
                many = blocks[to]
                row, to = np.repeat(row, many), np.repeat(to, many)
                block = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                mine = np.abs(batch.column("point").to_numpy()[row]) % blocks[to]
                inside = to == home[row]
                ok = ~inside | (block >= mine)
                row, group, role = row[ok], (to * 2**20 + block)[ok], (~inside | (block > mine))[ok]
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pa.array(group), pa.array(role.astype(np.int32)), *part.columns], ["block", "role", *part.schema.names])

        return run

    def searched(own: bool, others: bool):
        """Answers block after block; the rows come sorted by block and role."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            _, plane, _ = known.value
            block, held, there = None, [], None

            def out(parts) -> Iterator[pa.RecordBatch]:
                for q, o, s in parts:
                    if len(q):
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(o), pa.array(s.astype(np.float32))], ["point", "other", "score"])

            def built() -> Cell:
                t = pa.Table.from_batches(held)
                unit = _codes(t.column("code").combine_chunks(), dim)
                return Cell(t.column("point").to_numpy(), unit, unit @ plane, t.column("far").to_numpy(), k=k, keep=keep, bound=bound)

            def within(c: Cell) -> Iterator[pa.RecordBatch]:
                for a in range(0, len(c.points) if own else 0, BATCH):
                    x = slice(a, a + BATCH)
                    yield from out(c.ask(c.points[x], c.unit[x], c.low[x], c.far[x], dense=least is None, same=True))

            for batch in batches:
                ids, roles = batch.column("block").to_numpy(), batch.column("role").to_numpy()
                edges = np.concatenate([[0], np.flatnonzero((np.diff(ids) != 0) | (np.diff(roles) != 0)) + 1, [len(ids)]])
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    if ids[a] != block:
                        if held and there is None:
                            yield from within(built())
                        block, held, there = ids[a], [], None
                    part = batch.slice(a, b - a)
                    if roles[a] == 0:
                        held.append(part)
                        continue
                    if not held:
                        continue  # nobody is at home
                    if there is None:
                        there = built()
                        yield from within(there)
                    if others:
                        for x in range(0, part.num_rows, BATCH):
                            q = part.slice(x, BATCH)
                            unit = _codes(q.column("code"), dim)
                            yield from out(there.ask(q.column("point").to_numpy(), unit, unit @ plane, q.column("far").to_numpy(), dense=least is None))
            if held and there is None:
                yield from within(built())

        return run

    schema, found = "block long, role int, point long, code binary, far float", "point long, other long, score float"
    met = lambda rows, own, others, wide: rows.mapInArrow(sent(not others, wide), schema).repartition("block").sortWithinPartitions("block", "role").mapInArrow(searched(own, others), found)
    start = coded.withColumn("far", F.lit(farthest).cast("float"))
    if least is not None:  # the search is bounded already: one round over all cells that pass the test
        near = met(start, True, True, np.full(cells, farthest, np.float32))
    else:  # first every vector's own block, which bounds the k-th distance, then all that the test does not rule out
        own = stored(met(start, True, False, np.zeros(cells, np.float32)))
        if cells == 1 and blocks[0] == 1:
            near = own
        else:
            kth = own.groupBy("point").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s")).select("point", F.when(F.size("s") >= k, 2 - 2 * F.element_at("s", k) + 0.01).cast("float").alias("far"))
            bounded = stored(coded.join(kth, "point", "left").withColumn("far", F.coalesce(F.col("far"), F.lit(farthest)).cast("float")))

            def widest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                tree, plane, _ = known.value
                for batch in batches:
                    home = tree.cell(_codes(batch.column("code"), dim) @ plane) if batch.num_rows else np.zeros(0, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(home), batch.column("far")], ["cell", "far"])

            wide = np.zeros(cells, np.float32)
            for r in bounded.mapInArrow(widest, "cell long, far float").groupBy("cell").agg(F.max("far").alias("far")).collect():  # at most CELLS rows
                wide[r["cell"]] = r["far"]
            near = own.unionByName(met(bounded, False, True, wide))

    ranked = Window.partitionBy("point").orderBy(F.desc("score"), "other")
    near = near.withColumn("n", F.row_number().over(ranked)).filter(F.col("n") <= keep).select("point", "other")
    sized = points.select("point", "v", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).alias("norm"))
    a, b = sized.toDF("point", "va", "la"), sized.toDF("other", "vb", "lb")
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    exact = near.join(a, "point").join(b, "other").select("point", "other", (dot / (F.col("la") * F.col("lb"))).alias("cosine"))
    if least is not None:
        exact = exact.filter(F.col("cosine") >= least)
    # copies: of a point's keys only the k + 1 smallest can be anyone's neighbours
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy("key"))).filter(F.col("n") <= k + 1).select(F.col("point").alias("other"), F.col("key").alias("other_key"))
    copied = members.groupBy("point").count().filter("count > 1").select("point", F.col("point").alias("other"), F.lit(1.0).alias("cosine"))
    rows = exact.unionByName(copied).join(few, "other").select("point", "other_key", "cosine")
    short = rows.withColumn("n", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("cosine"), "other_key"))).filter(F.col("n") <= k + 1)
    per_key = members.join(short, "point").filter("key <> other_key")
    rank = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("cosine"), "other_key"))
    out = per_key.withColumn("rank", rank).filter(F.col("rank") <= k)
    return out.select(F.col("key").alias(key), F.col("other_key").alias("other"), "cosine", "rank")
