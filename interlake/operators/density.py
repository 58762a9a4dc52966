"""Clusters by density with noise, and the reduction of vectors before it.

1. Vectors meet in windows of `window` rows along several random orders (bits of random half spaces, sorted). Each window gives as many of its
   rows' nearest neighbours as their core distances can need; of all windows' a row's distance to its `min_samples`-th neighbour is its core distance.
2. The weight of a pair is the largest of their distance and both core distances. Each window gives the minimum spanning tree of its
   rows; the spanning forest of all windows' trees together is that of all pairs that ever met. Ties go by the pair's ids.
3. Boruvka's rounds on those edges contract every vertex with its lightest edge. The edges that one round contracts into a vertex
   lie on one path of the merging hierarchy, in order of weight, as long as they are lighter than the lightest edge that leaves
   the vertex; heavier ones are looked at again a round later. So the hierarchy comes out as chains, without sorting all merges in one place.
4. Going up the chains, merges of two groups of at least `min_cluster_size` split clusters, and smaller groups fall out of the cluster
   they merge with. A cluster is kept if its stability is at least that of the best choice below it; what is in none is noise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from interlake.storage import dealt_in_order, last_before, numbered, running_sum, stored

NOISE = -1
BITS = 48  # half spaces of an order
LEAST = 1e-12  # smaller weights count as this, so that no level is infinite


def reduced(vectors: DataFrame, dims: int = 50, column: str = "embedding", times: str | None = None) -> DataFrame:
    """The column by its first `dims` principal components (all of them if it has no more); null vectors stay null.

    One pass sums up the centred products of all rows tree-wise (dims x dims numbers), whose eigenvectors are taken on the driver.
    times: a column that says for how many equal rows each one stands.
    """
    head = vectors.filter(F.col(column).isNotNull()).select(F.size(column).alias("n")).first()
    if head is None or head["n"] <= dims:
        return vectors
    rows = vectors.filter(F.col(column).isNotNull())
    rows = _weighted(rows, column, times) if times else rows.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    model = PCA(k=dims, inputCol="v", outputCol="r").fit(rows)
    there = vectors.filter(F.col(column).isNotNull()).withColumn("v", array_to_vector(F.col(column).cast("array<double>")))
    turned = model.transform(there).withColumn(column, vector_to_array("r")).drop("v", "r")
    return turned.unionByName(vectors.filter(F.col(column).isNull()).withColumn(column, F.lit(None).cast("array<double>")))


def _weighted(rows: DataFrame, column: str, times: str) -> DataFrame:
    """(v): rows of mean 0 with the principal components of rows that each count `times`: centred, times the root of that number, with both signs."""
    x = F.col(column).cast("array<double>")
    mean = rows.groupBy(F.lit(0).alias("all")).agg(vector_to_array(Summarizer.mean(array_to_vector(x), F.col(times).cast("double"))).alias("m")).first()["m"]
    both = F.explode(F.array(F.sqrt(times), -F.sqrt(times))).alias("by")
    return rows.select(F.zip_with(x, F.array(*map(F.lit, mean)), lambda a, b: a - b).alias("x"), both).select(array_to_vector(F.transform("x", lambda a: a * F.col("by"))).alias("v"))


def explained_variance(vectors: DataFrame, dims: int = 50, column: str = "embedding") -> list[float]:
    """The share of the variance on each of the first principal components."""
    rows = vectors.filter(F.col(column).isNotNull()).select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    return PCA(k=dims, inputCol="v", outputCol="r").fit(rows).explainedVariance.toArray().tolist()


class _Windows:
    """Runs of rows along several orders, and a function of each window's ids, weights, cores and vectors."""

    def __init__(self, points: DataFrame, n: int, tables: int, window: int, seed: int):
        mean = points.groupBy(F.lit(0).alias("all")).agg(vector_to_array(Summarizer.mean(array_to_vector("x"))).alias("m")).first()["m"]
        dims = len(mean)
        planes = np.random.default_rng(seed).standard_normal((tables, dims, BITS))
        centre = np.array(mean)
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)

        def keys(batches):
            for batch in batches:
                x = np.array(batch.column(3).to_pylist(), np.float64).reshape(batch.num_rows, dims) - centre
                keys = np.stack([(x @ p > 0) @ powers for p in planes], 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys.tolist(), pa.list_(pa.int64()))], names=["id", "n", "core", "x", "keys"])

        found = points.select("id", "n", "core", "x").mapInArrow(keys, "id long, n long, core double, x array<double>, keys array<long>")
        each = found.select("id", "n", "core", "x", F.posexplode("keys").alias("t", "key"))
        parts = max(1, n * tables // (8 * window))
        self.rows = each.repartitionByRange(parts, "t", "key", "id").sortWithinPartitions("t", "key", "id").select("t", "id", "n", "core", "x")
        self.dims, self.window = dims, window

    def map(self, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
        """fn(ids, counts, cores, vectors) of windows that overlap by half; the last of an order may be short."""
        dims, window = self.dims, self.window

        def run(batches: Iterator[pa.RecordBatch]):
            held, table, fresh = None, None, 0
            for batch in batches:
                ts = batch.column(0).to_numpy()
                columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)] + [batch.column(4).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)]
                edges = [0, *(np.flatnonzero(np.diff(ts)) + 1).tolist(), len(ts)]
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if a == b:
                        continue
                    part = [c[a:b] for c in columns]
                    if ts[a] != table:
                        if fresh:
                            yield fn(*held)
                        held, table, fresh = part, ts[a], 0
                    else:
                        held = [np.concatenate(c) for c in zip(held, part, strict=True)]
                    fresh += b - a
                    while len(held[0]) >= window:
                        yield fn(*[c[:window] for c in held])
                        held = [c[window // 2 :] for c in held]
                        fresh = len(held[0]) - (window - window // 2)
            if fresh:
                yield fn(*held)

        return self.rows.mapInArrow(run, schema)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distance of each row of x to the row of y beside it; the same number whatever else is in the arrays."""
    return np.sqrt(np.square(x - y).sum(-1))


def nearest(ids: np.ndarray, n: np.ndarray, core: np.ndarray, x: np.ndarray, k: int = 24, least: int = 24) -> pa.RecordBatch:
    """(id, near): of each row's k nearest rows in a window (d, other, n of the other), from the nearest on as many as make `least` with the row's own copies.

    What comes before a row in the order of all windows' together is no less than in its window's, so none of those that count is left out.
    """
    k = min(k, len(ids) - 1)
    need = least - (n - 1)
    todo = np.flatnonzero(need > 0) if k > 0 else []
    sizes, own, other, d = [], [], [], []
    squares = np.square(x).sum(1)
    for first in range(0, len(todo), 512):
        rows = todo[first : first + 512]
        far = squares[None, :] - 2 * (x[rows] @ x.T)
        far[np.arange(len(rows)), rows] = np.inf
        near = np.argpartition(far, k - 1, axis=1)[:, :k]
        apart = _distances(x[rows][:, None, :], x[near])
        order = np.lexsort((ids[near], apart))
        near, apart = np.take_along_axis(near, order, 1), np.take_along_axis(apart, order, 1)
        keep = np.cumsum(n[near], 1) - n[near] < need[rows][:, None]  # the first ones
        own.append(ids[rows])
        sizes.append(keep.sum(1))
        other.append(near[keep])
        d.append(apart[keep])
    put = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    at, ends = put(other, np.int64), np.concatenate([[0], np.cumsum(put(sizes, np.int64))])
    pairs = pa.StructArray.from_arrays([pa.array(put(d, np.float64)), pa.array(ids[at]), pa.array(n[at])], names=["d", "other", "n"])
    return pa.RecordBatch.from_arrays([pa.array(put(own, np.int64)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], names=["id", "near"])


NEAR = "array<struct<d:double,other:bigint,n:bigint>>"


def spanning_tree(ids: np.ndarray, n: np.ndarray, core: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
    """(w, lo, hi): the edges of a window's minimum spanning tree, by Prim, equal weights in the order of (lo, hi)."""
    size = len(ids)
    weight, lo, hi = np.full(size, np.inf), np.zeros(size, np.int64), np.zeros(size, np.int64)
    todo = np.arange(size)
    out: list[tuple[float, int, int]] = []
    at = 0
    while len(todo) > 1:
        todo = todo[todo != at]
        w = np.maximum(np.maximum(_distances(x[todo], x[at]), core[todo]), core[at])
        a, b = np.minimum(ids[todo], ids[at]), np.maximum(ids[todo], ids[at])
        better = (w < weight[todo]) | ((w == weight[todo]) & ((a < lo[todo]) | ((a == lo[todo]) & (b < hi[todo]))))
        put = todo[better]
        weight[put], lo[put], hi[put] = w[better], a[better], b[better]
        ties = todo[weight[todo] == weight[todo].min()]
        at = int(ties[np.lexsort((hi[ties], lo[ties]))[0]])
        out.append((float(weight[at]), int(lo[at]), int(hi[at])))
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.float64(), pa.int64(), pa.int64()), strict=True)], names=["w", "lo", "hi"])


def core_distances(found: DataFrame, points: DataFrame, min_samples: int, k: int) -> DataFrame:
    """(id, n, x, core): the distance at which a row's own copies and its neighbours, with theirs, are `min_samples` besides itself."""
    near = found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))), 1, k).alias("near"))  # some windows times k at most
    both = points.join(near, "id", "left")
    start = F.struct((F.col("n") - 1).alias("have"), F.when(F.col("n") - 1 >= min_samples, 0.0).alias("core"))
    step = lambda acc, o: F.struct((acc["have"] + o["n"]).alias("have"), F.coalesce(acc["core"], F.when(acc["have"] + o["n"] >= min_samples, o["d"])).alias("core"))
    reached = F.aggregate(F.coalesce("near", F.array().cast(NEAR)), start, step)["core"]
    return both.select("id", "n", F.coalesce(reached, F.element_at("near", -1)["d"], F.lit(0.0)).alias("core"), "x")


def contracted(edges: DataFrame) -> tuple[list[DataFrame], int]:
    """Boruvka's rounds: for each level k from 1 the chains' edges (v, e, kids), and the number of edges of the forest.

    edges: (w, lo, hi). e is struct(w, lo, hi); v is the vertex of level k in whose chain it lies; kids are the level and vertex of what it joins
    to the chain: two for a chain's lightest edge, else one.
    """
    e = F.struct("w", "lo", "hi").alias("e")
    left = stored(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v"), e))  # one row a pair, seen from both sides below
    pending, chains, level, count = None, [], 0, 0
    while True:
        sides = left.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("s"), "e").select("s.u", "s.v", "e")
        light = stored(sides.groupBy("u").agg(F.min(F.struct("e", "v")).alias("m")).select("u", "m.e", "m.v"))
        over = light.isEmpty()
        if pending is not None:  # what lies in a vertex, and isn't heavier than its lightest way out, is in the vertex's chain
            met = pending.join(light.select(F.col("u").alias("own"), F.col("e").alias("out")), pending["v"] == F.col("own"), "left")
            stays = F.col("out").isNull() | (F.col("e") < F.col("out"))
            chains.append(stored(met.filter(stays).select("v", "e", "kids")))
            pending = met.filter(~stays).select("v", "e", "kids")
        if over:
            return chains, count
        back = light.select(F.col("u").alias("v"), F.col("e").alias("e_back"))
        root = (F.col("e") == F.col("e_back")) & (F.col("u") < F.col("v"))
        up = stored(light.join(back, "v").select("u", F.when(root, F.col("u")).otherwise(F.col("v")).alias("p")))
        while True:  # pointers are doubled until all show the root
            further = up.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            jumped = stored(up.join(further, "p").select("u", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            up = jumped.select("u", "p")
            if jumped.filter("moved").isEmpty():
                break
        kid = F.struct(F.lit(level).alias("l"), F.col("u").alias("v"))
        joined = light.join(up, "u").groupBy("e").agg(F.first("p").alias("v"), F.sort_array(F.collect_list(kid)).alias("kids"))  # one or two
        if pending is not None:
            pending = pending.join(up, pending["v"] == up["u"]).select(F.col("p").alias("v"), "e", "kids").unionByName(joined.select("v", "e", "kids"))
        else:
            pending = joined.select("v", "e", "kids")
        pending = stored(pending)
        count += joined.count()
        a, b = up.select("u", F.col("p").alias("a")), up.select(F.col("u").alias("v"), F.col("p").alias("b"))
        left = left.join(a, "u").join(b, "v").filter("a <> b")
        left = stored(left.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.min("e").alias("e")))
        level += 1


def _level(w: Column) -> Column:
    return 1 / F.greatest(w, F.lit(LEAST))


def _name(lo: Column, hi: Column) -> Column:
    return F.concat_ws(":", lo.cast("string"), hi.cast("string"))


class _Hierarchy:
    """Clusters, what falls out of them where, and how they split, gathered chain by chain from the lowest level."""

    def __init__(self, points: DataFrame, chains: list[DataFrame], least: int):
        self.least = least
        alone = F.when(F.col("n") >= least, _name(F.col("id"), F.col("id")))
        self.nodes = points.select(F.lit(0).alias("l"), F.col("id").alias("v"), F.col("n").alias("size"), alone.alias("top"))
        self.leaves = points.filter(F.col("n") >= least).select(_name(F.col("id"), F.col("id")).alias("cluster"), F.col("n").alias("size"), _level(F.col("core")).alias("level"))
        self.falls: list[DataFrame] = []  # (l, v, size, cluster, level)
        self.small: list[DataFrame] = []  # (l, v, own): kids of chains that stay small
        self.made: list[DataFrame] = []  # (v, e, upto, cluster, kind, one, two): where a chain's cluster changes
        for k, chain in enumerate(chains, 1):
            self._add(k, chain)

    def _add(self, k: int, chain: DataFrame) -> None:
        least = self.least
        big = lambda c: F.col(c) >= least
        kids = chain.select(F.col("v").alias("own"), "e", F.explode("kids").alias("kid")).select("own", "e", "kid.l", "kid.v").join(self.nodes, ["l", "v"])
        edges = kids.groupBy("own", "e").agg(F.sum("size").alias("joined"), F.sort_array(F.collect_list(F.struct("l", "v", "size", "top"))).alias("kids"))  # one or two
        edges = running_sum(dealt_in_order(edges, "own", "e"), ["own"], ["e"], "joined", "upto")
        first = F.size("kids") == 2
        edges = edges.withColumn("side", F.when(first, F.col("kids")[0]["size"]).otherwise(F.col("upto") - F.col("joined")))
        edges = edges.withColumn("pendant", F.when(first, F.col("kids")[1]["size"]).otherwise(F.col("joined")))
        edges = edges.withColumn("two", F.when(first, F.col("kids")[1]["top"]).otherwise(F.col("kids")[0]["top"])).withColumn("low", F.when(first, F.col("kids")[0]["top"]))
        kind = F.when(big("side") & big("pendant"), "split").when(big("pendant"), "adopt").when(big("side"), F.when(first, "keep")).when(big("upto"), "leaf")
        edges = edges.withColumn("kind", kind)
        made = F.when(F.col("kind").isin("split", "leaf"), _name(F.col("e.lo"), F.col("e.hi"))).when(F.col("kind") == "adopt", F.col("two")).when(F.col("kind") == "keep", F.col("low"))
        edges = stored(last_before(edges.withColumn("made", made), ["own"], ["e"], "made", "earlier"))
        edges = edges.withColumn("one", F.coalesce("low", "earlier")).withColumn("cluster", F.coalesce("made", "earlier"))
        self.made.append(edges.filter("kind is not null").select(F.col("own").alias("v"), "e", "upto", "cluster", "kind", "one", "two"))
        start = edges.filter(big("upto")).groupBy("own").agg(F.min(F.struct("e", "cluster")).alias("first"))
        each = edges.select("own", "e", "upto", "cluster", F.explode("kids").alias("kid")).filter(F.col("kid.size") < least)
        each = each.join(start, "own", "left")
        begun = F.col("e") > F.col("first.e")
        falls = each.filter("first is not null").select(
            "kid.l", "kid.v", "kid.size", F.when(begun, F.col("cluster")).otherwise(F.col("first.cluster")).alias("cluster"), _level(F.when(begun, F.col("e.w")).otherwise(F.col("first.e.w"))).alias("level")
        )
        self.falls.append(stored(falls))
        self.small.append(stored(each.filter("first is null").select("kid.l", "kid.v", F.col("own"))))
        top = edges.groupBy("own").agg(F.max("upto").alias("size"), F.max_by("cluster", "e").alias("top"))
        self.nodes = self.nodes.union(stored(top.select(F.lit(k).alias("l"), F.col("own").alias("v"), "size", "top")))

    def clusters(self, many_trees: bool) -> DataFrame:
        """(cluster, parent, stability, able, death): stability sums sizes times levels above the cluster's birth; the only tree's root isn't able to be chosen."""
        splits = [made.filter("kind = 'split'") for made in self.made]  # none where all vectors are equal
        events = _union([self.leaves, *[f.select("cluster", "size", "level") for f in self.falls], *[s.select("cluster", F.col("upto").alias("size"), _level(F.col("e.w")).alias("level")) for s in splits]])
        sizes = events.groupBy("cluster").agg(F.sum("size").alias("size"), F.sum(F.col("size") * F.col("level")).alias("area"), F.max("level").alias("death"))
        none = self.leaves.limit(0).select(F.col("cluster").alias("parent"), F.col("level").alias("birth"), "cluster")
        sides = _union([none, *[s.select(F.col("cluster").alias("parent"), _level(F.col("e.w")).alias("birth"), F.explode(F.array("one", "two")).alias("cluster")) for s in splits]])
        both = sizes.join(sides, "cluster", "left")
        stability = F.col("area") - F.col("size") * F.coalesce("birth", F.lit(0.0))
        return stored(both.select("cluster", "parent", stability.alias("stability"), (F.col("parent").isNotNull() | F.lit(many_trees)).alias("able"), "death"))

    def chosen(self, clusters: DataFrame) -> DataFrame:
        """(cluster, value, best): the stability of the best choice at or below each cluster, and whether that is the cluster itself."""
        leaves = self.leaves.select("cluster").join(clusters, "cluster")
        known = stored(leaves.select("cluster", F.when(F.col("able"), F.col("stability")).otherwise(0.0).alias("value"), F.col("able").alias("best")))
        for made in self.made:
            value = lambda side: known.select(F.col("cluster").alias(side), F.col("value").alias(f"value_{side}"))  # noqa: B023, E731
            rows = made.join(clusters.select("cluster", "stability", "able"), "cluster").join(value("one"), "one", "left").join(value("two"), "two", "left")
            rows = rows.select("v", "e", "cluster", "kind", "stability", "able", "value_one", "value_two").repartition("v").sortWithinPartitions("v", "e").drop("e")
            known = known.union(stored(rows.mapInPandas(_follow, "cluster string, value double, best boolean")))
        return known


def _follow(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Go up each chain: a new cluster is chosen if it is as stable as what was chosen below it."""
    chain, value = None, None
    for frame in frames:
        out = []
        for v, cluster, kind, stability, able, one, two in frame.itertuples(index=False):
            if v != chain:
                chain, value = v, None
            if kind == "adopt":
                value = two
            elif kind == "keep":
                value = one
            else:
                below = 0.0 if kind == "leaf" else (one if value is None else value) + two
                best = bool(able) and stability >= below
                value = stability if best else below
                out.append((cluster, value, best))
        yield pd.DataFrame(out, columns=["cluster", "value", "best"]).astype({"cluster": object, "value": float, "best": bool})


def _topmost(clusters: DataFrame, chosen: DataFrame) -> DataFrame:
    """(cluster, top): the highest chosen cluster at or above each cluster; rounds by the logarithm of the tree's height."""
    state = clusters.join(chosen, "cluster").select("cluster", F.col("parent").alias("up"), F.when(F.col("best"), F.col("cluster")).alias("top"))
    state = stored(state)
    while not state.filter("up is not null").isEmpty():
        above = state.select(F.col("cluster").alias("up"), F.col("up").alias("further"), F.col("top").alias("higher"))
        state = stored(state.join(above, "up", "left").select("cluster", F.col("further").alias("up"), F.coalesce("higher", "top").alias("top")))
    return state.select("cluster", "top")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def density_clusters(
    vectors: DataFrame, *, id: str = "id", column: str = "embedding", times: str | None = None, min_cluster_size: int = 50, min_samples: int = 10, tables: int = 8, window: int = 2048, neighbours: int = 24, seed: int = 5
) -> DataFrame:
    """(id, cluster, prob) of every row: cluster -1 and prob 0 for noise, else prob is the level at which the row leaves its cluster, over the cluster's highest.

    Clusters are numbered from 0 by their smallest id. Vectors that are null, empty, hold null or non-finite entries, or are of another length
    than most, are noise. Equal vectors count with their number and share a result. Up to `window` different vectors are all compared with
    one another, and the result is that of all pairs; beyond that, neighbours that never meet in a window of one of the `tables`
    orders are missed. Trees that no window links are apart as by an infinite distance. neighbours must be at least min_samples.
    times: a column that says for how many equal rows, with no smaller id, each one stands.
    """
    if neighbours < min_samples:
        raise ValueError("neighbours must be at least min_samples")
    x = F.col(f"`{column}`").cast("array<double>")
    good = x.isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    rows = vectors.select(F.col(f"`{id}`").alias("row_id"), F.when(good, F.transform(x, lambda v: v + F.lit(0.0))).alias("x"), (F.col(f"`{times}`").cast("long") if times else F.lit(1).cast("long")).alias("n"))
    length = rows.filter("x is not null").groupBy(F.size("x").alias("s")).agg(F.sum("n").alias("count")).orderBy(F.desc("count"), F.desc("s")).first()
    empty = rows.select(F.col("row_id").alias("id"), F.lit(NOISE).alias("cluster"), F.lit(0.0).alias("prob"))
    if length is None:
        return empty
    rows = rows.withColumn("x", F.when(F.size("x") == length["s"], F.col("x")))
    unnamed = -1 - F.pmod(F.xxhash64("x"), F.lit(1 << 48))  # a vector of rows without an id
    points = stored(rows.filter("x is not null").groupBy("x").agg(F.coalesce(F.min("row_id"), unnamed).alias("id"), F.sum("n").alias("n")))
    count = points.count()
    schema = f"id long, near {NEAR}"
    if points.filter(F.col("n") <= min_samples).isEmpty():  # copies alone make all core distances 0
        near = points.sparkSession.createDataFrame([], schema)
    else:
        near = _Windows(points.withColumn("core", F.lit(0.0)), count, tables, window, seed).map(lambda *w: nearest(*w, k=neighbours, least=min_samples), schema)
    cored = stored(core_distances(near, points, min_samples, neighbours))
    edges = _Windows(cored, count, tables, window, seed).map(spanning_tree, "w double, lo long, hi long")
    chains, joined = contracted(edges.distinct())
    tree = _Hierarchy(cored.select("id", "n", "core"), chains, min_cluster_size)
    clusters = tree.clusters(count - joined > 1)
    tops = _topmost(clusters, tree.chosen(clusters)).filter("top is not null")
    tops = stored(tops.join(clusters.select(F.col("cluster").alias("top"), "death"), "top"))

    placed = _union([f.select("l", "v", "cluster", "level") for f in tree.falls]) if tree.falls else None
    for k in range(len(chains), 0, -1):  # what is in a chain that stays small leaves with it
        whole = placed.filter(F.col("l") == k).select(F.col("v").alias("own"), "cluster", "level")
        placed = placed.unionByName(stored(tree.small[k - 1].join(whole, "own").select("l", "v", "cluster", "level")))
    own = cored.filter(F.col("n") >= min_cluster_size).select(F.lit(0).alias("l"), F.col("id").alias("v"), _name(F.col("id"), F.col("id")).alias("cluster"), _level(F.col("core")).alias("level"))
    placed = own if placed is None else placed.filter("l = 0").unionByName(own)
    told = stored(placed.join(tops, "cluster").select(F.col("v").alias("id"), "top", (F.least("level", "death") / F.col("death")).alias("prob")))
    names = numbered(told.groupBy("top").agg(F.min("id").alias("least")), "least").select("top", F.col("nth").cast("int").alias("cluster"))
    by_vector = points.join(told.join(names, "top"), "id", "left").select("x", "cluster", "prob")
    return rows.join(by_vector, "x", "left").select(F.col("row_id").alias("id"), F.coalesce("cluster", F.lit(NOISE)).alias("cluster"), F.coalesce("prob", F.lit(0.0)).alias("prob"))
