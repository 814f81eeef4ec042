"""Exact top-k search by inner product with M-trees.

Inner products become distances: a candidate x gets one more component, sqrt(M - |x|^2) with M the greatest squared norm,
a query gets 0 there, and then |q - x|^2 = |q|^2 + M - 2 q.x, so that the nearest are those with the highest product. Distances
prune with a slack for rounding; scores are exact integers.

Candidates are dealt to bounded trees by the nearest of a few pivots, and in crowded cells by the nearest of the cell's own pivots. A
tree is a file of pages; a page holds entries with their vector (routing object), covering radius and distance to the page's
parent object. Search is best first: a page is opened in the order of the least distance that anything below it can have,
and an entry's own distance is only computed if the triangle inequality with the stored parent distance doesn't rule it out.

A query first searches the tree of its own cell. The k-th score from there, with the trees' root objects and covering radii,
tells which other trees can hold anything better; only these pairs are formed, and only their pages travel. The nearest few trees
come first and tighten the bound for the rest.
"""

from __future__ import annotations

import heapq
import math
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.llm.common import bound_batches, durable

_FLAT = "vec_id long, q array<long>"


@dataclass(frozen=True)
class Params:
    """`pivots`: of the routing sample (rows of least hash); a crowded cell gets up to `inner` of its own, so that there are 4096 at most
    whatever the input. `tree_rows`: about the most rows of one tree; cells beyond are dealt to several trees. `page`: entries of
    a page. `block`: queries in a block. `first`: trees that a query searches before the others. `roots`: root objects in a group."""

    k: int = 5
    scale: int = 256
    pivots: int = 16
    inner: int = 256
    tree_rows: int = 16384
    page: int = 256
    block: int = 2048
    first: int = 4
    roots: int = 4096


#: The greatest squared norm: by it every inner product is a long.
LARGEST = float(1 << 62)


def quantised(rows: DataFrame, p: Params, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, q: floor(scale * x) of every component. Rows with a null id, a null vector, or a null or non-finite component
    are left out, and so are vectors whose quantised squared norm exceeds 2**62, as their scores need not fit in a long. Vectors of
    different lengths are compared as if the shorter ended in zeros."""
    x = F.col(vector_col).cast("array<double>")
    small = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v * p.scale) < float(1 << 31)))
    norm = F.aggregate(x, F.lit(0.0), lambda a, v: a + F.pow(F.floor(v * p.scale).cast("double"), F.lit(2.0)))
    fine = F.when(F.col(id_col).isNotNull() & x.isNotNull() & small, norm <= LARGEST).otherwise(False)
    return rows.where(F.coalesce(fine, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * p.scale).cast("long")).alias("q"))


def _matrix(vectors, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _nearest(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    f, g = x.astype(np.float64), pivots.astype(np.float64)
    return ((g * g).sum(axis=1)[None, :] - 2 * f @ g.T).argmin(axis=1)


class Tree:
    """An M-tree over distinct vectors. Ids of equal vectors share an entry, smallest first. Entries of a leaf page are neighbours in memory.

    A leaf page is (first entry, end, distances to the parent object); an inner page (objects, radii, distances to the parent object,
    pages below).
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, top: int, page: int) -> None:
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        distinct, back = np.unique(x, axis=0, return_inverse=True)
        by = np.argsort(back.reshape(-1), kind="stable")
        starts = np.searchsorted(back.reshape(-1)[by], np.arange(len(distinct) + 1))
        spare = np.maximum(top - (distinct * distinct).sum(axis=1), 0)
        points = np.column_stack((distinct.astype(np.float64), np.sqrt(spare.astype(np.float64))))
        self.pages: list[tuple] = []
        self.leaves: list[np.ndarray] = []
        self.filled = 0
        self.root_object = points.mean(axis=0)
        self.root = self._build(points, np.arange(len(points)), self.root_object, page)
        self.root_radius = float(_gap(points, self.root_object).max(initial=0.0))
        entries = np.concatenate(self.leaves)
        del self.leaves
        #: Whole numbers that floats hold exactly, so that products are exact as well (see `search`).
        self.exact = top < 1 << 52
        self.x = distinct[entries].astype(np.float64) if self.exact else distinct[entries]
        self.ids = np.concatenate([ids[by[starts[e] : starts[e + 1]]] for e in entries])
        self.id_starts = np.concatenate(([0], np.cumsum((starts[1:] - starts[:-1])[entries])))

    def _build(self, points: np.ndarray, rows: np.ndarray, parent: np.ndarray, page: int) -> int:
        if len(rows) <= page:
            self.leaves.append(rows)
            self.pages.append((True, self.filled, self.filled + len(rows), _gap(points[rows], parent)))
            self.filled += len(rows)
            return len(self.pages) - 1
        fan = min(page, -(-len(rows) // page) * 2)
        seeds = [int(rows[0])]
        own = points[rows]
        least = _gap(own, own[0])
        for _ in range(fan - 1):  # objects far from each other
            nxt = int(least.argmax())
            seeds.append(int(rows[nxt]))
            least = np.minimum(least, _gap(own, own[nxt]))
        centres = points[seeds]
        home = ((centres**2).sum(axis=1)[None, :] - 2 * own @ centres.T).argmin(axis=1)
        below, radii, objects = [], [], []
        for j in range(len(seeds)):
            part = rows[home == j]
            if len(part):
                objects.append(centres[j])
                radii.append(float(_gap(points[part], centres[j]).max()))
                below.append(self._build(points, part, centres[j], page))
        objects = np.array(objects)
        self.pages.append((False, objects, np.array(radii), _gap(objects, parent), below))
        return len(self.pages) - 1

    def search(self, q: np.ndarray, own: int, k: int, reach: float, best: list[tuple[int, int]]) -> int:
        """Adds to `best`, a heap of (score, -id) with the worst first, what beats it; the number of distances computed.

        `reach` is |q|^2 + M: a score s lies at the squared distance reach - 2 s.
        """
        point = np.append(q, 0).astype(np.float64)
        vector = point[:-1] if self.exact and reach < 1 << 52 else q
        slack = 1e-6 * (1.0 + math.sqrt(reach))
        limit = limit_of([s for s, _ in best[:1]] * len(best), reach, k)
        to_root = float(np.sqrt(((point - self.root_object) ** 2).sum()))
        todo = [(max(0.0, to_root - self.root_radius), self.root, to_root)]
        computed = 1
        while todo:
            nearest, number, to_parent = heapq.heappop(todo)
            if nearest > limit:
                break
            page = self.pages[number]
            if page[0]:
                _, first, end, gap = page
                may = np.flatnonzero(np.abs(gap - to_parent) <= limit)
                computed += len(may)
                x = self.x[first:end] if 2 * len(may) > end - first else self.x[first + may]
                scores = x @ vector if x.dtype == vector.dtype else x.astype(np.int64) @ q
                good = np.flatnonzero(scores >= best[0][0]) if len(best) >= k else np.argsort(-scores, kind="stable")
                for i in good.tolist():
                    s, at = int(scores[i]), first + (i if len(x) == end - first else int(may[i]))
                    for one in self.ids[self.id_starts[at] : min(self.id_starts[at] + k + 1, self.id_starts[at + 1])].tolist():
                        if one != own:
                            item = (s, -one)
                            if len(best) < k:
                                heapq.heappush(best, item)
                            elif item > best[0]:
                                heapq.heapreplace(best, item)
                            else:
                                break
                if len(good) and len(best) >= k:
                    limit = math.sqrt(max(reach - 2.0 * best[0][0], 0.0)) + slack
            else:
                _, objects, radii, gap, below = page
                may = np.flatnonzero(np.abs(gap - to_parent) - radii <= limit)
                computed += len(may)
                gone = _gap(objects[may], point)
                for i, d, low in zip(may.tolist(), gone.tolist(), np.maximum(gone - radii[may], 0.0).tolist(), strict=True):
                    if low <= limit:
                        heapq.heappush(todo, (low, below[i], d))
        return computed


def _gap(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of rows to a point."""
    d = x - y
    return np.sqrt(np.einsum("ij,ij->i", d, d))


def _distinct(rows: DataFrame) -> DataFrame:
    return rows.groupBy("vec_id").agg(F.min("q").alias("q"))


def _cells(rows: DataFrame, width: int, p: Params) -> list[np.ndarray]:
    """The pivots: for each outer one its inner ones (itself alone where the cell isn't crowded)."""
    hashed = F.xxhash64("vec_id")
    outer = np.unique(_matrix([r[0] for r in rows.orderBy(hashed).select("q").limit(p.pivots).collect()], width), axis=0)

    def route(batches):
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "q": pdf["q"], "pivot": _nearest(_matrix(pdf["q"], width), outer)})

    routed = rows.mapInPandas(route, f"{_FLAT}, pivot int")
    out = [outer[j : j + 1] for j in range(len(outer))]
    crowded = {r["pivot"]: min(p.inner, 2 * -(-r["count"] // p.tree_rows)) for r in routed.groupBy("pivot").count().where(F.col("count") > p.tree_rows).collect()}
    if crowded:
        rank = F.row_number().over(Window.partitionBy("pivot").orderBy(hashed))
        few = routed.where(F.col("pivot").isin(*crowded)).withColumn("rank", rank).where(F.col("rank") <= p.inner).collect()
        for j, n in crowded.items():
            out[j] = np.unique(_matrix([r["q"] for r in few if r["pivot"] == j and r["rank"] <= n], width), axis=0)
    return out


def search(rows: DataFrame, queries: DataFrame, p: Params | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query, fewer if there are fewer candidates, ties to
    the smaller vec_id; never the row with the query's own id.

    `rows` and `queries` hold vec_id and q (see `quantised`). Rows that repeat an id count as one; of different vectors with
    the same id the first in order counts. Empty tables give no rows.
    """
    p = p or Params()
    spark = rows.sparkSession
    bound_batches(spark)
    rows, queries = durable(_distinct(rows)), _distinct(queries)
    width, top, total = rows.agg(F.max(F.size("q")), F.max(F.aggregate("q", F.lit(0).cast("long"), lambda a, v: a + v * v)), F.count("*")).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, queries.agg(F.coalesce(F.max(F.size("q")), F.lit(0))).first()[0])
    cells = _cells(rows, width, p)
    outer = np.stack([c.mean(axis=0) if len(c) > 1 else c[0] for c in cells])
    starts = np.concatenate(([0], np.cumsum([len(c) for c in cells])))

    def route(batches):
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["q"], width)
                at = _nearest(x, outer)
                cell = starts[at]
                for j in np.unique(at):
                    if len(cells[j]) > 1:
                        mine = at == j
                        cell[mine] += _nearest(x[mine], cells[j])
                yield pd.DataFrame({"vec_id": pdf["vec_id"], "q": pdf["q"], "cell": cell.astype(np.int32)})

    routed = durable(rows.mapInPandas(route, f"{_FLAT}, cell int"))
    parts = routed.groupBy("cell").agg(F.ceil(F.count("*") / p.tree_rows).cast("int").alias("parts"))  # 4096 cells at most
    tree = F.concat_ws("-", "cell", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1)))).alias("tree")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = Tree(pdf["vec_id"].to_numpy(), _matrix(pdf["q"], width), top, p.page)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "root": [own.root_object.tolist()], "radius": [own.root_radius], "pages": [pickle.dumps(own)]})

    dealt = routed.join(F.broadcast(parts), "cell").select(tree, "vec_id", "q")
    trees = durable(dealt.groupBy("tree").applyInPandas(build, "tree string, root array<double>, radius double, pages binary"))

    # queries of a cell are neighbours: cells side by side fill blocks, a crowded one is dealt to several
    asked = durable(queries.mapInPandas(route, f"{_FLAT}, cell int").join(F.broadcast(parts), "cell", "left").select("vec_id", "q", "cell", tree))
    dealt, base, held = [], 0, 0
    for cell, n in sorted((r["cell"], r["count"]) for r in asked.groupBy("cell").count().collect()):  # 4096 cells at most
        if held and held + n > p.block:
            base, held = base + 1, 0
        many = max(1, -(-n // p.block))
        dealt.append((cell, base, many))
        base, held = (base + many, 0) if many > 1 else (base, held + n)
    blocks = spark.createDataFrame(dealt, "cell int, base int, many int")
    block = (F.col("base") + F.pmod(F.xxhash64("vec_id", F.lit(3)), F.col("many"))).cast("int").alias("block")
    asked = durable(asked.join(F.broadcast(blocks), "cell").select("vec_id", "q", "tree", block))

    def look(them: pd.DataFrame, pages: pd.DataFrame) -> pd.DataFrame:
        """What a block's queries find in a tree beyond what they know."""
        out = []
        one = pickle.loads(pages["pages"].iloc[0]) if len(pages) else None
        for own, vector, before in zip(them["vec_id"].tolist(), _matrix(them["q"], width), them["known"], strict=True):
            start = [] if before is None else [(int(r["score"]), -int(r["vec_id"])) for r in before]
            best = sorted(start)
            if one is not None:
                one.search(vector, own, p.k, _reach(vector, top), best)
            out += [(own, -i, s) for s, i in best if (s, i) not in start]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    def visit(pairs: DataFrame) -> DataFrame:
        """`pairs`: vec_id, q, known, tree, block. The pages of a tree go to the blocks that need them."""
        needed = pairs.select(F.col("tree").alias("of"), F.col("block").alias("to")).distinct().join(trees.select(F.col("tree").alias("of"), "pages"), "of")
        return pairs.groupBy("tree", "block").cogroup(needed.groupBy("of", "to")).applyInPandas(look, "query_id long, vec_id long, score long")

    def best_of(found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", rank).where(F.col("rank") <= p.k)

    def known_by(found: DataFrame) -> DataFrame:
        return found.groupBy("query_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("known")).withColumnRenamed("query_id", "vec_id")  # k at most

    nothing = F.lit(None).cast("array<struct<vec_id: bigint, score: bigint>>").alias("known")
    best = durable(visit(asked.select("vec_id", "q", nothing, "tree", "block")))

    def bounds(them: pd.DataFrame, tops: pd.DataFrame) -> pd.DataFrame:
        """The trees that can hold something better for the queries of a block, and how near it can be at best."""
        if not len(them) or not len(tops):
            return pd.DataFrame({"vec_id": [], "tree": [], "low": []})
        roots, radii, names = np.stack(tops["root"]), tops["radius"].to_numpy(), tops["tree"].to_numpy()
        out = []
        for own, vector, home, before in zip(them["vec_id"].tolist(), _matrix(them["q"], width), them["tree"], them["known"], strict=True):
            low = np.maximum(_gap(roots, np.append(vector, 0).astype(np.float64)) - radii, 0.0)
            known = [] if before is None else sorted(int(r["score"]) for r in before)
            may = np.flatnonzero((low <= limit_of(known, _reach(vector, top), p.k)) & (names != home))
            out.append(pd.DataFrame({"vec_id": own, "tree": names[may], "low": low[may]}))
        return pd.concat(out)

    # every query meets every group of root objects (of 4096), bin by bin
    groups, bins = 1 + trees.count() // p.roots, 1 + asked.count() // p.block
    with_known = asked.join(known_by(best), "vec_id", "left").withColumn("bin", F.pmod(F.xxhash64("vec_id"), F.lit(bins)).cast("int"))
    roots = trees.select("tree", "root", "radius", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    them = with_known.select("vec_id", "q", "known", "tree", "bin", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"))
    open_pairs = them.groupBy("bin", "part").cogroup(roots.groupBy("bin", "part")).applyInPandas(bounds, "vec_id long, tree string, low double")
    order = F.row_number().over(Window.partitionBy("vec_id").orderBy("low", "tree"))
    open_pairs = durable(open_pairs.withColumn("order", order))
    for near in (True, False):
        pairs = open_pairs.where(F.col("order") <= p.first if near else F.col("order") > p.first)
        now = asked.drop("tree").join(known_by(best), "vec_id", "left")
        limit = F.when(F.size("known") >= p.k, _limit_column("q", "known", top)).otherwise(float("inf"))
        pairs = pairs.join(now, "vec_id").where(F.col("low") <= limit).select("vec_id", "q", "known", "tree", "block")
        best = durable(best_of(best.select("query_id", "vec_id", "score").unionByName(visit(pairs)).distinct()))
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _reach(vector: np.ndarray, top: int) -> float:
    """|q|^2 + M: a score s lies at the squared distance reach - 2 s."""
    return float((vector * vector).sum()) + float(top)


def limit_of(scores: list[int], reach: float, k: int) -> float:
    """The distance that a candidate must not exceed to be among the k best (scores in rising order), with a slack for rounding."""
    return math.sqrt(max(reach - 2.0 * scores[0], 0.0)) + 1e-6 * (1.0 + math.sqrt(reach)) if len(scores) >= k else math.inf


def _limit_column(q: str, known: str, top: int):
    """`limit_of` where k scores are known."""
    reach = F.aggregate(q, F.lit(float(top)), lambda a, v: a + v.cast("double") * v.cast("double"))
    worst = F.array_min(F.transform(known, lambda x: x.score)).cast("double")
    return F.sqrt(F.greatest(reach - 2 * worst, F.lit(0.0))) + 2e-6 * (1 + F.sqrt(reach))
