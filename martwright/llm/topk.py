"""Exact top-k inner products by best-first search in M-trees.

Vectors are cut into blocks, and an M-tree is built for each: pages of entries, every
routing entry with its vector, the covering radius of what lies below it and the distance
to its parent's vector; every leaf entry with its distance to the parent's vector. For a
query q and a routing entry c with radius r, no vector below can score more than
<q,c> + |q| r; and <q,c> itself is at most <q,p> + |q| d(c,p) with the parent p, so many
entries are passed over without computing a product. Pages are taken in the order of
their bound, until the bound falls below the k-th score.

Trees are a table on shared storage. Queries come in blocks and meet every tree; a tree
gives k rows for each query at most, and the best k of them all are the answer.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martwright.llm.shared import saved

PAGE = 64


def _whole(vectors: pd.Series, scale: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions of usable vectors and the vectors as floor(scale * x)."""
    kept, out = [], []
    for k, v in enumerate(vectors):
        if v is None:
            continue
        x = np.asarray([np.nan if e is None else e for e in v] if getattr(v, "dtype", None) == object else v, np.float64)
        if np.isfinite(x).all():
            x = np.floor(scale * x)
            if len(x) and (np.abs(x).max() >= 2.0**53 or np.dot(x, x) >= 2.0**62):
                raise ValueError("a component is too large for scores of 64 bits")
            kept.append(k)
            out.append(x.astype(np.int64))
    return np.array(kept, np.int64), out


class Node:
    """A page. Routing pages have `children`; `radius` is 0 in leaves. `parent` holds the
    distances of the entries to the vector of the routing entry above."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, radius: np.ndarray, parent: np.ndarray, children: list[Node] | None):
        self.vectors, self.ids, self.radius, self.parent, self.children = vectors, ids, radius, parent, children


def build(ids: np.ndarray, vectors: np.ndarray, center: np.ndarray | None = None) -> Node:
    """An M-tree of integer vectors, bulk-loaded from the top: far-apart vectors of a page
    become routing entries and every other goes below the nearest one."""
    exact = vectors.astype(np.float64)
    center = exact.mean(0) if center is None else center
    parent = np.sqrt(((exact - center) ** 2).sum(1))
    if len(ids) <= PAGE:
        return Node(vectors, ids, np.zeros(len(ids)), parent, None)
    pivots = _pivots(exact, min(PAGE, max(2, -(-len(ids) // PAGE))))
    squares = (exact**2).sum(1)[:, None] - 2 * exact @ exact[pivots].T + (exact[pivots] ** 2).sum(1)
    nearest = squares.argmin(1)
    if len(np.unique(nearest)) == 1:  # equal vectors: pages by order
        nearest = np.arange(len(ids)) * len(pivots) // len(ids)
    kept = np.unique(nearest)
    children = [build(ids[nearest == k], vectors[nearest == k], exact[pivots[k]]) for k in kept]
    radius = np.array([np.sqrt(((exact[nearest == k] - exact[pivots[k]]) ** 2).sum(1)).max() for k in kept])
    top = pivots[kept]
    return Node(vectors[top], ids[top], radius, parent[top], children)


def _pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Positions of `n` vectors spread over `x`: each the furthest of a few from those before."""
    rng = np.random.default_rng(len(x))
    chosen = [int(rng.integers(len(x)))]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(n - 1):
        few = rng.integers(len(x), size=8)
        chosen.append(int(few[far[few].argmax()]))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def search(root: Node, center_product: float, query: np.ndarray, own: int | None, k: int) -> list[tuple[int, int]]:
    """The best k of a tree as (score, id): highest score, ties to the smaller id."""
    q = query.astype(np.float64)
    norm = float(np.sqrt(q @ q))
    best: list[tuple[int, int]] = []  # (score, -id), the worst on top
    heap: list[tuple[float, int, float, Node]] = [(-np.inf, 0, center_product, root)]
    count = 0
    while heap:
        bound, _, above, node = heapq.heappop(heap)
        least = best[0][0] if len(best) == k else -np.inf
        slack = 1e-9 * (abs(above) + norm * (1 + float(node.parent.max(initial=0)) + float(node.radius.max(initial=0)))) + 1e-6
        if -bound < least - slack:
            break
        may = np.flatnonzero(above + norm * (node.parent + node.radius) + slack >= least)
        if not len(may):
            continue
        if node.children is None:
            for score, i in zip((node.vectors[may] @ query).tolist(), node.ids[may].tolist(), strict=True):
                if i == own:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        else:
            products = node.vectors[may] @ q
            for e, product in zip(may, products, strict=True):
                top = product + norm * node.radius[e]
                if top + slack >= least:
                    count += 1
                    heapq.heappush(heap, (-top, count, float(product), node.children[e]))
    return [(score, -i) for score, i in best]


def _trees(vectors: DataFrame, scale: int, block: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def grown(dim: int) -> pd.DataFrame:
            parts = held.pop(dim)
            ids, x = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            center = x.astype(np.float64).mean(0)
            return pd.DataFrame({"dim": [dim], "tree": [pickle.dumps((center, build(ids, x, center)), protocol=5)]})

        for batch in batches:
            kept, usable = _whole(batch["embedding"], scale)
            ids = batch["vec_id"].to_numpy()[kept].astype(np.int64)
            dims = np.array([len(x) for x in usable], np.int64)
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                for at in range(0, len(pick), block):
                    own = pick[at : at + block]
                    x = np.stack([usable[p] for p in own]) if dim else np.zeros((len(own), 0), np.int64)
                    held.setdefault(int(dim), []).append((ids[own], x))
                    if sum(len(p[0]) for p in held[int(dim)]) >= block:
                        yield grown(int(dim))
        for dim in list(held):
            yield grown(dim)

    usable = vectors.where("vec_id is not null and embedding is not null").select(vectors["vec_id"].cast("long"), "embedding")
    return usable.mapInPandas(run, "dim int, tree binary")


def _query_blocks(queries: DataFrame, scale: int, block: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kept, usable = _whole(batch["embedding"], scale)
            ids = batch["vec_id"].to_numpy()[kept].astype(np.int64)
            dims = np.array([len(x) for x in usable], np.int64)
            for dim in np.unique(dims):
                pick = np.flatnonzero(dims == dim)
                for at in range(0, len(pick), block):
                    own = pick[at : at + block]
                    x = np.stack([usable[p] for p in own]) if dim else np.zeros((len(own), 0), np.int64)
                    yield pd.DataFrame({"dim": [int(dim)], "ids": [ids[own].tobytes()], "queries": [x.tobytes()]})

    return queries.select(queries["vec_id"].cast("long"), "embedding").mapInPandas(run, "dim int, ids binary, queries binary")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, tree: int = 16384, block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows for each row whose id `every` divides.

    Components become floor(scale * x), the score is their integer inner product, ties go
    to the smaller vec_id, and rows with the query's own id are no candidates. Rows with a
    null id, a null vector, or a null or non-finite component take no part; a vector
    is compared with those of its own length only. Repeated rows are separate candidates,
    identical ones too; as queries, identical rows ask once, and of several vectors under
    one id all ask.
    A score beyond 64 bits is an error. Empty tables give no rows.
    """
    rows = vectors.select("vec_id", "embedding")
    trees = saved(_trees(rows, scale, tree))
    numbered = trees.select("dim", F.xxhash64("tree").alias("tree_id"), "tree")
    blocks = _query_blocks(rows.where(F.col("vec_id") % every == 0).distinct(), scale, block)
    # Blocks of queries, each sent to the trees of its length.
    asked = blocks.join(numbered.select("dim", "tree_id").distinct(), "dim").join(numbered, ["dim", "tree_id"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                center, root = pickle.loads(r.tree)
                ids = np.frombuffer(r.ids, np.int64)
                queries = np.frombuffer(r.queries, np.int64).reshape(len(ids), r.dim)
                found = [
                    (int(i), vec_id, score)
                    for i, q in zip(ids, queries, strict=True)
                    for score, vec_id in search(root, float(center @ q), q, int(i), k)
                ]
                yield pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = asked.select("dim", "ids", "queries", "tree").mapInPandas(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
