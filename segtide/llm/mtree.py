"""Exact top-k search by inner product: M-trees over parts of the vectors, searched best first with stored distances."""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from segtide.llm.common import written

#: Vectors of a tree, entries of a leaf page and children of an inner page on average, pivots that deal vectors to trees at most.
TREE, LEAF, FAN, PIVOTS = 8192, 512, 16, 1024
#: Centres that are held against a pack of queries at once.
CENTRES = 4096
#: Packs of queries that go to one tree together; a tree gets about a pack from each other tree that it isn't pruned for.
TOGETHER = 64
#: Sums of products below this are exact in floating point.
EXACT = 2.0**53


@dataclass
class Page:
    """A node. Inner nodes route to children by rows of the vectors, with covering radii; a leaf holds the rows of a span. Both keep the distances to their own routing object."""

    rows: np.ndarray
    to_parent: np.ndarray
    radii: np.ndarray | None = None
    children: list[Page] = field(default_factory=list)
    span: tuple[int, int] = (0, 0)


class MTree:
    """An M-tree over whole-number vectors.

    Inner products become distances by one more coordinate that lifts all vectors to the same length: the farther
    a lifted vector is from the query (lifted by zero), the smaller is their inner product. The
    tree is loaded in bulk: pivots taken from the vectors route the others to the nearest. Vectors are laid out leaf by leaf.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.points = ids, vectors.astype(np.float64)
        squares = (self.points**2).sum(axis=1)
        self.length = float(squares.max())
        self.lift = np.sqrt(np.maximum(self.length - squares, 0))
        every = np.arange(len(ids))
        self.centre = int(self._distances(self.points.mean(axis=0), float(self.lift.mean()), every).argmin())
        reach = self._distances(self.points[self.centre], self.lift[self.centre], every)
        self.radius = float(reach.max())
        self.root = self._load(every, self.centre, reach, np.random.default_rng(0))
        self._lay_out()
        # Larger numbers are kept whole as well, as their products aren't exact in floating point.
        self.most = float(np.abs(self.points).max(initial=0))
        self.whole = vectors[self.order] if self.most**2 * vectors.shape[1] >= EXACT else None

    def _distances(self, point: np.ndarray, lift: float, rows: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1) + (self.lift[rows] - lift) ** 2)

    def _load(self, rows: np.ndarray, parent: int, to_parent: np.ndarray, random: np.random.Generator) -> Page:
        if len(rows) <= LEAF:
            return Page(rows, to_parent)
        pivots = random.choice(rows, min(FAN, -(-len(rows) // LEAF) + 1), replace=False)
        reach = np.stack([self._distances(self.points[p], self.lift[p], rows) for p in pivots])
        nearest = reach.argmin(axis=0)
        if np.bincount(nearest).max() == len(rows):
            # Copies of one vector can't be told apart by distance and are cut evenly.
            nearest = np.arange(len(rows)) % len(pivots)
        page = Page(np.zeros(0, np.int64), np.zeros(0))
        kept, radii = [], []
        for k, pivot in enumerate(pivots):
            mine = nearest == k
            if mine.any():
                kept.append(pivot)
                radii.append(float(reach[k][mine].max()))
                page.children.append(self._load(rows[mine], int(pivot), reach[k][mine], random))
        page.rows, page.radii = np.array(kept), np.array(radii)
        page.to_parent = self._distances(self.points[parent], self.lift[parent], page.rows)
        return page

    def _pages(self, page: Page) -> Iterator[Page]:
        yield page
        for child in page.children:
            yield from self._pages(child)

    def _lay_out(self) -> None:
        leaves = [p for p in self._pages(self.root) if p.radii is None]
        ends = np.cumsum([len(p.rows) for p in leaves])
        self.order = np.concatenate([p.rows for p in leaves])
        place = np.empty_like(self.order)
        place[self.order] = np.arange(len(place))
        for page, end in zip(leaves, ends.tolist(), strict=True):
            page.span, page.rows = (end - len(page.rows), end), np.zeros(0, np.int64)
        for page in self._pages(self.root):
            page.rows = place[page.rows]
        self.centre = int(place[self.centre])
        self.ids, self.points, self.lift = self.ids[self.order], self.points[self.order], self.lift[self.order]

    def products(self, rows: slice | np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
        """Inner products, whole numbers: by floating point where that is exact, else in 64 bits."""
        return self.points[rows] @ query if exact else self.whole[rows] @ query

    def search(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The ids and scores of the k best vectors with another id than the query's and a score of ``least`` or more, ties to smaller ids.

        Pages wait in a queue by the smallest distance they can hold. An entry is left out without computing its
        distance if the parent's distance and the stored one already differ too much. Bounds keep a margin for rounding; scores are whole numbers.
        """
        floats = query.astype(np.float64)
        size = float(floats @ floats)
        exact = self.whole is None and self.most * float(np.abs(floats).max(initial=0)) * len(query) < EXACT
        if not exact and self.whole is None:
            self.whole = self.points.astype(np.int64)
        asked = floats if exact else query
        margin = 1e-7 * (1 + size + self.length) ** 0.5
        ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def far(score: float) -> float:
            return np.inf if score == -np.inf else max(0.0, size + self.length - 2 * score) ** 0.5 + margin

        limit = far(least)
        start = float(self._distances(floats, 0.0, np.array([self.centre]))[0])
        queue = [(max(0.0, start - self.radius), 0, start, self.root)]
        ticket = 1
        while queue:
            nearest, _, to_page, page = heapq.heappop(queue)
            if nearest > limit:
                break
            slack = page.radii if page.radii is not None else 0.0
            near = np.abs(page.to_parent - to_page) - slack <= limit
            if page.radii is not None:
                open_ = np.flatnonzero(near)
                distances = self._distances(floats, 0.0, page.rows[open_])
                for at, d in zip(open_.tolist(), distances.tolist(), strict=True):
                    bound = max(nearest, d - float(page.radii[at]))
                    if bound <= limit:
                        heapq.heappush(queue, (bound, ticket, d, page.children[at]))
                        ticket += 1
                continue
            rows = slice(*page.span) if near.all() else page.span[0] + np.flatnonzero(near)
            found = self.products(rows, asked, exact)
            fits = np.flatnonzero(found >= least)
            if len(fits):
                some, points = self.ids[rows][fits], found[fits].astype(np.int64)
                others = some != own
                ids, scores = np.concatenate([ids, some[others]]), np.concatenate([scores, points[others]])
                if len(ids) > k:
                    best = np.lexsort((ids, -scores))[:k]
                    ids, scores = ids[best], scores[best]
                if len(ids) == k:
                    least = max(least, float(scores.min()))
                    limit = far(least)
        return ids, scores


def scaled(column: str, scale: int) -> Column:
    """The whole-number vector; null if the vector is null or empty, or a component is null, not finite or beyond 64 bits."""
    whole = F.transform(column, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).try_cast("long"))
    sound = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float(2**56)))
    return F.when(sound & (F.size(column) > 0), whole)


def _blob(vectors: np.ndarray) -> list[bytes]:
    return [v.tobytes() for v in vectors]


def _route(pivots: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Deal each vector to the nearest pivot of its dimension."""
        for batch in batches:
            vectors = [np.array(v, np.int64) for v in batch.column(1).to_pylist()]
            region = np.zeros(len(vectors), np.int64)
            dims = np.array([len(v) for v in vectors])
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                region[at] = int(dim) * (PIVOTS + 1)
                if int(dim) in pivots:
                    x, p = np.stack([vectors[k] for k in at]).astype(np.float64), pivots[int(dim)]
                    region[at] += 1 + ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(region), pa.array(_blob(vectors), pa.binary())], ["id", "region", "vector"])

    return run


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nearest of its region's pivots for each vector."""
    for batch in batches:
        rows, packs = batch.column("vector").to_pylist(), batch.column("pivots").to_pylist()
        child = np.zeros(len(rows), np.int64)
        groups: dict[bytes, list[int]] = {}
        for k, pack in enumerate(packs):
            groups.setdefault(pack, []).append(k)
        for pack, at in groups.items():
            x = np.stack([np.frombuffer(rows[k], np.int64) for k in at]).astype(np.float64)
            p = np.frombuffer(pack, np.int64).reshape(-1, x.shape[1]).astype(np.float64)
            child[at] = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        yield pa.RecordBatch.from_arrays([*batch.select(["id", "region", "above", "vector"]).columns, pa.array(child)], ["id", "region", "above", "vector", "child"])


def fitted(routed: DataFrame) -> DataFrame:
    """Vectors with the tree that each belongs to: ``id``, ``vector``, ``tree``, from regions of any size.

    A region with more vectors than a tree holds is divided among up to ``FAN`` of its own vectors, each going to the nearest, and so are its parts, so trees stay close together
    in space however many vectors there are. A region that hardly divides, as one of copies does, is dealt by hash. Rounds grow with the logarithm of the largest region.
    """
    settled, rows = None, routed.withColumn("above", F.lit(2**59))
    while True:
        sizes = written(rows.groupBy("region").agg(F.count("*").alias("n"), F.max("above").alias("above")), "mtree-sizes")
        large, stuck = F.col("n") > TREE, F.expr("10 * n > 9 * above")
        parts = F.when(large, F.ceil(F.col("n") / TREE)).otherwise(1).cast("long")
        named = rows.drop("above").join(sizes, "region")
        ready = named.filter(~large | stuck).select("id", "vector", F.xxhash64("region", F.pmod(F.xxhash64("id"), parts)).alias("tree"))
        settled = ready if settled is None else settled.unionByName(ready)
        if sizes.filter(large & ~stuck).isEmpty():
            return settled
        open_ = named.filter(large & ~stuck)
        drawn = W.partitionBy("region").orderBy(F.xxhash64("vector", F.lit(1)), "vector")
        some = open_.select("region", "vector", "n").distinct().withColumn("k", F.row_number().over(drawn)).filter(F.col("k") <= FAN).filter(F.col("k") <= 2 * F.ceil(F.col("n") / TREE))
        packs = some.groupBy("region").agg(F.array_sort(F.collect_list("vector")).alias("v")).select("region", F.aggregate("v", F.lit(b""), lambda a, v: F.concat(a, v)).alias("pivots"))
        dealt = open_.select("id", "region", F.col("n").alias("above"), "vector").join(packs, "region").mapInArrow(_nearest, "id long, region long, above long, vector binary, child long")
        rows = written(dealt.select("id", F.xxhash64("region", "child", F.lit(2)).alias("region"), "vector", "above"), "mtree-routed")


TREES = "tree long, dim int, centre binary, radius double, length double, pages binary, queries binary, own binary, least binary, found binary"


def _build(k: int, every: int):
    def run(table: pa.Table) -> pa.Table:
        """One tree, and what its own queries find in it: their results and the score that the k-th of them has."""
        ids = table["id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        vectors = np.stack([np.frombuffer(v, np.int64) for v in table["vector"].to_pylist()])[order]
        ids = ids[order]
        tree = MTree(ids, vectors)
        centre = np.append(tree.points[tree.centre], tree.lift[tree.centre])
        asked = np.flatnonzero(ids % every == 0)
        results, least = [], []
        for at in asked:
            found, scores = tree.search(vectors[at], int(ids[at]), k)
            results.append(np.stack([np.full(len(found), ids[at]), found, scores], axis=1))
            least.append(float(scores.min()) if len(found) == k else -np.inf)
        found = np.concatenate(results) if results else np.zeros((0, 3), np.int64)
        row = {
            "tree": [table["tree"][0].as_py()], "dim": [vectors.shape[1]], "centre": [centre.tobytes()], "radius": [tree.radius], "length": [tree.length],
            "pages": [pickle.dumps(tree)], "queries": [ids[asked].tobytes()], "own": [vectors[asked].tobytes()], "least": [np.array(least).tobytes()], "found": [found.tobytes()],
        }
        return pa.table({c: pa.array(v, pa.int32() if c == "dim" else None) for c, v in row.items()})

    return run


def _triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for found in batch.column(0).to_pylist():
            rows = np.frombuffer(found, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, c]) for c in range(3)], ["query_id", "vec_id", "score"])


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each tree that may hold better vectors than a query's home tree, the queries for which it may."""
    for batch in batches:
        for home, dim, queries, own, least, centres in zip(*(batch.column(c).to_pylist() for c in ("home", "dim", "queries", "own", "least", "centres")), strict=True):
            ids, vectors, floor = np.frombuffer(queries, np.int64), np.frombuffer(own, np.int64).reshape(-1, dim), np.frombuffer(least, np.float64)
            sizes = (vectors.astype(np.float64) ** 2).sum(axis=1)
            rows = []
            for c in centres:
                if c["tree"] == home or c["dim"] != dim or not len(ids):
                    continue
                centre = np.frombuffer(c["centre"], np.float64)
                apart = np.sqrt(((vectors - centre[:-1]) ** 2).sum(axis=1) + centre[-1] ** 2)
                margin = 1e-7 * np.sqrt(1 + sizes + c["length"])
                best = (sizes + c["length"] - np.maximum(0, apart - c["radius"] - margin) ** 2) / 2 + margin
                may = best + 1 >= floor
                if may.any():
                    rows.append((c["tree"], dim, ids[may].tobytes(), vectors[may].tobytes(), floor[may].tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["tree", "dim", "queries", "own", "least"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tree = None, None
        for batch in batches:
            for name, dim, packs, pages in zip(*(batch.column(c) for c in ("tree", "dim", "packs", "pages")), strict=True):
                if name != last:
                    last, tree = name, pickle.loads(pages.as_py())
                asked = packs.as_py()
                ids, floor = (np.concatenate([np.frombuffer(p[c], kind) for p in asked]) for c, kind in (("queries", np.int64), ("least", np.float64)))
                vectors = np.concatenate([np.frombuffer(p["own"], np.int64) for p in asked]).reshape(-1, dim.as_py())
                rows = []
                for i, v, f in zip(ids, vectors, floor, strict=True):
                    found, scores = tree.search(v, int(i), k, float(f))
                    rows.append(np.stack([np.full(len(found), i), found, scores], axis=1))
                both = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, c]) for c in range(3)], ["query_id", "vec_id", "score"])

    return run


def top_k(df: DataFrame, k: int, scale: int, every: int, row: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The k best vectors by inner product for each query, a row whose id is divisible by ``every``: ``query_id``, ``rank``, ``vec_id``, ``score``.

    Components become floor(scale * x). A query's own id is no candidate; ties go to smaller ids; queries with fewer candidates give
    them all. Null ids, and vectors that are null, empty or not finite, or have a component of 2^56 or more, whose products don't fit 64 bits, take no part; vectors of different length don't meet. Rows that repeat id and vector
    count once; one id with several vectors is a query with each, ranked together. An empty table gives an empty result; further columns play no part, whatever they are called.

    Vectors go to the nearest of a bounded sample of pivots; regions beyond a tree's size are divided again by vectors of their own. Each query first searches the tree it
    lies in; its k-th score there prunes whole trees by centre and radius and starts the search of the others. Queries and trees travel in packs of bounded size.
    """
    whole = df.select(F.col(row).cast("long").alias("id"), scaled(vector, scale).alias("vector")).filter("id IS NOT NULL AND vector IS NOT NULL").distinct()
    whole = written(whole, "mtree-vectors")
    n, largest = whole.agg(F.count("*"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    if (largest or 0) >= 2.0**63:
        raise ValueError("inner products don't fit 64 bits")
    chosen = whole.orderBy(F.xxhash64("id", "vector"), "id").limit(min(PIVOTS, -(-n // TREE))).select("vector").toArrow()["vector"].to_pylist() if n else []
    pivots: dict[int, list] = {}
    for v in chosen:
        pivots.setdefault(len(v), []).append(v)
    routed = written(whole.mapInArrow(_route({d: np.array(v, np.float64) for d, v in pivots.items()}), "id long, region long, vector binary"), "mtree-routed")
    dealt = fitted(routed)
    trees = written(dealt.groupBy("tree").applyInArrow(_build(k, every), TREES), "mtree-trees")

    numbered = trees.select(F.pmod(F.xxhash64("tree"), F.lit(-(-max(n, 1) // (TREE * CENTRES)))).alias("block"), F.struct("tree", "dim", "centre", "radius", "length").alias("centre"))
    centres = numbered.groupBy("block").agg(F.collect_list("centre").alias("centres"))
    asked = trees.select(F.col("tree").alias("home"), "dim", "queries", "own", "least").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-max(n, 1) // (TREE * CENTRES)) - 1))))
    packs = asked.join(centres, "block").select("home", "dim", "queries", "own", "least", "centres").mapInArrow(_prune, "tree long, dim int, queries binary, own binary, least binary")
    # A tree travels once for some ``TOGETHER`` packs of queries.
    slot = F.pmod(F.xxhash64("queries"), F.lit(max(n // (TREE * TOGETHER), 1)))
    asked = packs.groupBy("tree", "dim", slot.alias("slot")).agg(F.collect_list(F.struct("queries", "own", "least")).alias("packs"))
    elsewhere = asked.join(trees.select("tree", "pages"), "tree").select("tree", "dim", "packs", "pages").mapInArrow(_search(k), "query_id long, vec_id long, score long")
    at_home = trees.select("found").mapInArrow(_triples, "query_id long, vec_id long, score long")
    best = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return at_home.unionByName(elsewhere).select("query_id", F.row_number().over(best).alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
