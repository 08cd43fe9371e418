"""Vectors: norm, exact cosine search, a tuned cut-off."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType
from pyspark.sql.window import WindowSpec

from lumencat.operators.storage import stored


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalised(v: Column) -> Column:
    """A vector of length 1, summed in double precision; null for a zero or non-finite one. The length is beside each number, not in the function of one."""
    n = norm(v)
    return F.when((n > 0) & ~F.isnan(n) & (n < float("inf")), F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, m: x.cast("double") / m))


#: Vectors of a block on either side; a task multiplies two blocks.
BLOCK = 4096
#: Directions that blocks gather around, at most.
PIVOTS = 256
#: Similarities are compared with this allowance for rounding.
SLACK = 1e-9
_ANGLE_SLACK = 1e-6


def valid(rows: DataFrame, vector: str, space: str | None = None) -> DataFrame:
    """rows whose vector has a direction, as vectors of length 1, with ``space``: the named column, and the number of dimensions.

    A null vector, one with a null, a number that is not finite, or only zeros has none and is left out. Vectors of different spaces are
    never compared.
    """
    whole = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & ~F.exists(vector, lambda x: x.isNull()))
    own = F.col(space).cast("string") if space else F.lit("")
    out = whole.withColumns({vector: normalised(F.col(vector)), "_space": F.concat_ws("/", F.coalesce(own, F.lit("")), F.size(vector).cast("string"))})
    return out.where(F.col(vector).isNotNull())


def _blocks(queries: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """Both sides dealt out by hash to blocks of bounded size, each block of one side beside each of the other."""
    n_items, n_queries = (max(1, -(-df.count() // BLOCK)) for df in (items, queries))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = items.withColumn("_i", own("item", n_items)).withColumn("_q", every(n_queries))
    right = queries.withColumn("_q", own("query", n_queries)).withColumn("_i", every(n_items))
    n = n_items * n_queries
    return left.repartition(n, "_i", "_q"), right.repartition(n, "_i", "_q"), n


def _matrix(c: pa.ChunkedArray) -> np.ndarray:
    flat = c.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.empty((0, 0))


def _products(queries: pa.Table, items: pa.Table) -> np.ndarray:
    return _matrix(queries.column("q")) @ _matrix(items.column("embedding")).T


def _gathered(rows: DataFrame, key: str, vector: str, block: int, pivots: int) -> tuple[DataFrame, DataFrame]:
    """rows with ``block``, and (block, space, centre, reach, n): blocks of about that many rows around pivots, with the largest angle to their centre.

    The pivots are the rows of the ``pivots`` least hashes of each space, so their number is bounded. A pivot's rows are split by hash. A row
    belongs to the pivot it is most similar to.
    """
    w = Window.partitionBy("_space").orderBy(F.xxhash64(key), key)
    sizes = rows.groupBy("_space").agg(F.count("*").alias("_n"))
    chosen = rows.select("_space", key, vector).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pivots).join(sizes, "_space")
    chosen = chosen.where(F.col("_r") <= F.greatest(F.lit(1), F.ceil(F.col("_n") / block * 2)))
    held: dict[str, list] = {}
    for r in chosen.select("_space", vector).orderBy("_space", "_r").toLocalIterator():
        held.setdefault(r["_space"], []).append(r[vector])
    directions = rows.sparkSession.sparkContext.broadcast({k: np.array(v, np.float64) for k, v in held.items()})

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spaces = b.column("_space").to_pylist()
            out = np.zeros(b.num_rows, np.int32)
            for s in set(spaces):
                at = np.array([k for k, x in enumerate(spaces) if x == s])
                m = _matrix(pa.chunked_array([b.column(vector).take(pa.array(at))]))
                for lo in range(0, len(at), 4096):
                    out[at[lo : lo + 4096]] = np.argmax(m[lo : lo + 4096] @ directions.value[s].T, axis=1)
            yield b.append_column("_pivot", pa.array(out))

    placed = stored(rows.mapInArrow(place, StructType([*rows.schema.fields, StructField("_pivot", IntegerType())])), "placed")
    sizes = placed.groupBy("_space", "_pivot").agg(F.ceil(F.count("*") / block).cast("int").alias("_parts"))
    named = F.concat_ws(":", "_space", F.col("_pivot").cast("string"), F.pmod(F.xxhash64(key), F.col("_parts")).cast("string"))
    dealt = stored(placed.join(sizes, ["_space", "_pivot"]).withColumn("block", named).drop("_pivot", "_parts"), "blocks")

    def measured(t: pa.Table) -> pa.Table:
        m = _matrix(t.column(vector))
        centre = m.mean(axis=0)
        length = np.linalg.norm(centre)
        centre = centre / length if length > 0 else m[0]
        reach = float(np.arccos(np.clip(m @ centre, -1, 1)).max())
        return pa.table({"block": [t.column("block")[0].as_py()], "space": [t.column("_space")[0].as_py()], "centre": [centre.tolist()], "reach": [reach], "n": [len(m)]})

    about = dealt.select("block", "_space", vector).groupBy("block").applyInArrow(measured, "block string, space string, centre array<double>, reach double, n long")
    return dealt, stored(about, "about")


def _best(k: int, own: bool):
    """(query, item, similarity): the k best of a block of items for each query beside it that is above the query's floor."""

    def best(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if mine.num_rows and theirs.num_rows:
            item, query, s = mine.column("item").to_numpy(), theirs.column("query").to_numpy(), _products(theirs, mine)
            if not own:
                s[query[:, None] == item[None, :]] = -np.inf
            least = theirs.column("floor").to_numpy() - SLACK
            for row, name, low in zip(s, query, least, strict=True):
                at = np.flatnonzero((row >= low) & (row > -np.inf))
                order = at[np.lexsort((item[at], -row[at]))[:k]]
                out.append((np.full(len(order), name), item[order], row[order]))
        column = lambda i, t: pa.array(np.concatenate([o[i] for o in out]) if out else [], t)
        return pa.table({"query": column(0, pa.int64()), "item": column(1, pa.int64()), "similarity": column(2, pa.float64())})

    return best


class Ranking:
    """``rows``: (query, item, similarity, rank); ``pairs``: pairs of blocks in all; ``compared``: those that were multiplied."""

    def __init__(self, rows: DataFrame, pairs: int, compared: int):
        self.rows, self.pairs, self.compared = rows, pairs, compared


def pruned_ranking(queries: DataFrame, items: DataFrame, k: int, own: bool = True, space: str | None = None, block: int | None = None, pivots: int = PIVOTS) -> Ranking:
    """The k items (item, embedding) most similar to each stated query (query, q), ties by item, exactly; pairs of blocks that cannot matter are skipped.

    A block of vectors has a centre and the largest angle to it, so no two vectors of two blocks are nearer than the angle of the centres
    less both reaches. Each block of queries is first multiplied by the block of items whose centre is nearest; then by those whose bound
    is not below the k-th similarity that its queries have by then, the nearer ones first: half of them in the second round, whose results
    raise the bar for the third.
    """
    block = block or BLOCK
    keep = [space] if space else []
    asked = valid(queries.select(F.col("query").cast("long").alias("query"), "q", *keep), "q", space).drop(*keep)
    held = valid(items.select(F.col("item").cast("long").alias("item"), "embedding", *keep), "embedding", space).drop(*keep)
    if items.count() <= block and queries.count() <= block:  # one pair of blocks a space
        found = held.groupBy("_space").cogroup(asked.withColumn("floor", F.lit(-1.0)).groupBy("_space")).applyInArrow(_best(k, own), _FOUND)
        return Ranking(found.withColumn("rank", F.row_number().over(_by_similarity())), 1, 1)
    left, about_items = _gathered(stored(held, "items"), "item", "embedding", block, pivots)
    right, about_queries = _gathered(stored(asked, "queries"), "query", "q", max(1, block // 8), pivots)
    i, q = about_items.selectExpr("block as _i", "space", "centre as ci", "reach as ri", "n as ni"), about_queries.selectExpr("block as _q", "space", "centre as cq", "reach as rq")
    # a row for each pair of blocks, none of vectors; a bound on cosine: the angle of the centres less both reaches
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(F.col("ci"), F.col("cq")))))
    bounds = q.join(i, "space").select("_q", "_i", "ni", F.cos(F.greatest(F.lit(0.0), angle - F.col("ri") - F.col("rq") - _ANGLE_SLACK)).alias("bound"), angle.alias("angle"))
    bounds = stored(bounds, "bounds")
    order = Window.partitionBy("_q").orderBy("angle", "_i")
    ahead = F.sum("ni").over(order.rowsBetween(Window.unboundedPreceding, -1))
    bounds = stored(bounds.withColumns({"place": F.row_number().over(order), "ahead": F.coalesce(ahead, F.lit(0))}), "bounds")
    first = bounds.where((F.col("place") == 1) | (F.col("ahead") <= k))  # as many as hold k items and one more

    found, done, compared = asked.sparkSession.createDataFrame([], _FOUND), None, 0
    for step in range(3):
        if step == 0:
            wanted = first.select("_q", "_i")
        else:
            floors = right.select("query", F.col("block").alias("_q")).join(_floors(found, k), "query", "left").groupBy("_q").agg(F.min(F.coalesce("floor", F.lit(-1.0))).alias("low"))
            open_ = bounds.join(done, ["_q", "_i"], "left_anti").join(floors, "_q").where(F.col("bound") >= F.col("low") - SLACK)
            if step == 1:
                half = open_.withColumns({"_n": F.count("*").over(Window.partitionBy("_q")), "_r": F.row_number().over(Window.partitionBy("_q").orderBy("angle", "_i"))})
                open_ = half.where(F.col("_r") * 2 <= F.col("_n") + 1)
            wanted = open_.select("_q", "_i")
        wanted = stored(wanted, "wanted")
        n = wanted.count()
        if n:
            compared += n
            theirs = right.withColumnRenamed("block", "_q").join(_floors(found, k), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0))).join(wanted, "_q")
            mine = left.withColumnRenamed("block", "_i").join(wanted, "_i")
            new = mine.groupBy("_i", "_q").cogroup(theirs.groupBy("_i", "_q")).applyInArrow(_best(k, own), _FOUND)
            best = new.unionByName(found).withColumn("rank", F.row_number().over(_by_similarity())).where(F.col("rank") <= k)
            found = stored(best.select("query", "item", "similarity"), "found")
        done = wanted if done is None else done.unionByName(wanted)
    return Ranking(found.withColumn("rank", F.row_number().over(_by_similarity())), bounds.count(), compared)


_FOUND = "query long, item long, similarity double"


def _by_similarity() -> WindowSpec:
    return Window.partitionBy("query").orderBy(F.desc("similarity"), "item")


def _floors(found: DataFrame, k: int) -> DataFrame:
    """(query, floor): the k-th similarity of the queries that have k items."""
    return found.groupBy("query").agg(F.count("*").alias("_n"), F.min("similarity").alias("floor")).where(F.col("_n") >= k).select("query", "floor")


def ranking(queries: DataFrame, items: DataFrame, k: int, own: bool = True, space: str | None = None) -> DataFrame:
    """(query, item, similarity, rank from 1) of ``pruned_ranking``."""
    return pruned_ranking(queries, items, k, own, space).rows


def top_k(queries: DataFrame, items: DataFrame, k: int, least: float, space: str | None = None) -> DataFrame:
    return ranking(queries, items, k, space=space).where(F.col("similarity") >= least)


def label_retrieval(queries: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(query, size, found, first): of each query (query, q, ql) the items of its label, how many of them are among the k nearest, and the first one's rank.

    The first one's rank is one more than the number of items before it, counted block by block: its similarity is a first
    pass over the blocks, the count a second one.
    """
    own = stored(valid(items.select(F.col("item").cast("long").alias("item"), "embedding", "vl"), "embedding").drop("_space"), "items")
    asked = stored(valid(queries.select(F.col("query").cast("long").alias("query"), "q", "ql"), "q").drop("_space"), "queries")

    def each(task):
        def run(mine: pa.Table, theirs: pa.Table) -> pa.Table:
            rows: list[tuple] = []
            if mine.num_rows and theirs.num_rows:
                item, label, s = mine.column("item").to_numpy(), mine.column("vl").to_numpy(zero_copy_only=False), _products(theirs, mine)
                for r in range(theirs.num_rows):
                    rows += task(theirs.slice(r, 1), item, label, s[r])
            return pa.table({"query": pa.array([x[0] for x in rows], pa.int64()), "n": pa.array([x[1] for x in rows], pa.int64()), "s": pa.array([x[2] for x in rows], pa.float64()), "item": pa.array([x[3] for x in rows], pa.int64())})

        return run

    def nearest(query: pa.Table, item: np.ndarray, label: np.ndarray, s: np.ndarray) -> list[tuple]:
        name = query.column("query")[0].as_py()
        same = np.flatnonzero((label == query.column("ql")[0].as_py()) & (item != name))
        best = same[np.lexsort((item[same], -s[same]))[:1]]
        return [(name, len(same), float(s[i]), int(item[i])) for i in best]

    def before(query: pa.Table, item: np.ndarray, label: np.ndarray, s: np.ndarray) -> list[tuple]:
        name, least, at = (query.column(c)[0].as_py() for c in ("query", "least", "at"))
        ahead = (item != name) & ((s > least) | ((s == least) & (item < at)))
        return [(name, int(ahead.sum()), 0.0, 0)]

    kind = "query long, n long, s double, item long"
    left, right, _ = _blocks(asked, own)
    first = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInArrow(each(nearest), kind)
    least = first.groupBy("query").agg(F.sum("n").alias("size"), F.max(F.struct("s", (-F.col("item")).alias("i"))).alias("m")).select("query", "size", F.col("m.s").alias("least"), (-F.col("m.i")).alias("at"))
    least = stored(least, "least")
    left, right, _ = _blocks(asked.join(least, "query"), own)
    ahead = left.groupBy("_i", "_q").cogroup(right.groupBy("_i", "_q")).applyInArrow(each(before), kind).groupBy("query").agg((F.sum("n") + 1).alias("first"))
    near = ranking(asked, own, k, own=False).join(asked.select("query", "ql"), "query").join(own.select("item", "vl"), "item")
    found = near.groupBy("query").agg(F.count_if(F.col("ql") == F.col("vl")).alias("found"))
    return least.join(ahead, "query").join(found, "query").select("query", "size", "found", "first")


def cutoff(near: DataFrame, keep: float) -> DataFrame:
    """(cutoff): the largest of 0.00 to 0.99 that keeps the share of hits among the near (query, hit, similarity) rows."""
    hits = near.where("hit").agg(*[F.count_if(F.col("similarity") >= c / 100).alias(f"c{c}") for c in range(100)], F.count("*").alias("uncut"))
    fits = [F.when(F.col(f"c{c}") >= keep * F.col("uncut"), c / 100) for c in range(100)]
    return hits.select(F.array_max(F.array(*fits)).alias("cutoff"))


def embedding_text(*parts: Column) -> Column:
    """The parts that are not empty, in order."""
    return F.concat_ws(" | ", *[F.when(p != "", p) for p in parts])
