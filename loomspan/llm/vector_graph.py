"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Rows of one id count once (the smallest vector). Equal vectors are one graph node with their `k + 1` smallest ids, which is
all a top k can need; so neither a frequent id nor a frequent vector is large anywhere. Nodes are dealt to shards of about
`shard_rows` by a hash of the vector. Each shard's graph grows in batches: greedy beam searches from the medoid propose
neighbours for a batch, relaxed distance pruning (an edge p -> b goes when some kept neighbour a has
alpha * d(a, b) <= d(p, b)) keeps at most `degree` diverse ones, and reverse edges are added and pruned the same way. All
searches of a batch move in step, so numpy works on whole batches; each step goes on from the `expand` nearest open nodes.

A query beam-searches every shard, where it sees a share of the nodes that falls with the shard's size (`seen_share`);
candidates are ranked by their exact double-precision distance, and each query keeps its k best over all shards. In a
shard's task the graph comes first and queries stream past it in batches, so memory follows the shard and not the queries.

Vectors that are null, zero, of another length than most in their shard, or hold null or non-finite components take no
part, neither as rows nor as queries; nor do rows with a null id. Ties go to smaller ids. Vectors of very many components
work like others. An empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm import common as C


@dataclass(frozen=True)
class Settings:
    shard_rows: int = 32768
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 112
    alpha: float = 1.2
    batch: int = 256
    expand: int = 4


def usable(column: str) -> Column:
    """True for vectors that take part."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of a[i] to b[i, j] (float32: for steering only)."""
    d = b - a[:, None, :]
    return np.einsum("ijk,ijk->ij", d, d)


def beam_search(x: np.ndarray, edges: np.ndarray, start: int, queries: np.ndarray, beam: int, expand: int = 1) -> tuple[np.ndarray, np.ndarray, int]:
    """(nodes, squared distances, how many nodes were seen) of the `beam` best found, nearest first, for all queries; -1 fills up."""
    n = len(queries)
    nodes = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    nodes[:, 0] = start
    dist[:, 0] = _square(queries, x[[start]][None].repeat(n, 0))[:, 0]
    done = nodes < 0
    seen = np.zeros((n, len(x)), bool)
    seen[:, start] = True
    active = np.arange(n)
    while len(active):
        open_ = ~done[active]
        some = open_.any(1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        now = open_ & (np.cumsum(open_, 1) <= expand)  # lists are sorted: the first open entries are the nearest
        done[active] |= now
        r, c = np.nonzero(now)
        found = edges[nodes[active[r], c]]
        r, c = np.nonzero(found >= 0)[0], found[found >= 0]  # rows of `now`, node ids
        r = np.nonzero(now)[0][r]
        fresh = ~seen[active[r], c]
        pair = np.unique(r[fresh] * len(x) + c[fresh])  # two nodes may name the same neighbour
        r, ids = pair // len(x), pair % len(x)
        seen[active[r], ids] = True
        diff = x[ids] - queries[active[r]]
        d = np.einsum("ij,ij->i", diff, diff)
        counts = np.bincount(r, minlength=len(active))
        place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        width = int(counts.max(initial=0))
        more_n, more_d = np.full((len(active), width), -1, np.int64), np.full((len(active), width), np.inf, np.float32)
        more_n[r, place], more_d[r, place] = ids, d
        all_n, all_d = np.concatenate([nodes[active], more_n], 1), np.concatenate([dist[active], more_d], 1)
        all_done = np.concatenate([done[active], more_n < 0], 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        nodes[active], dist[active], done[active] = (np.take_along_axis(z, order, 1) for z in (all_n, all_d, all_done))
    return nodes, dist, int(seen.sum())


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most `degree` diverse out-neighbours for each of `points`, from padded candidate lists."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    order = np.sort(candidates, 1)
    candidates = np.where(np.concatenate([np.zeros((len(order), 1), bool), order[:, 1:] == order[:, :-1]], 1), -1, order)
    d = _square(x[points], x[np.maximum(candidates, 0)])
    d[candidates < 0] = np.inf
    order = np.argsort(d, 1, kind="stable")[:, : 4 * degree]
    candidates, d = np.take_along_axis(candidates, order, 1), np.take_along_axis(d, order, 1)
    vectors = x[np.maximum(candidates, 0)] - x[points][:, None, :]  # seen from the point, so that close ones don't cancel
    norm = np.einsum("ijk,ijk->ij", vectors, vectors)
    between = norm[:, :, None] + norm[:, None, :] - 2 * np.matmul(vectors, vectors.transpose(0, 2, 1))
    alive = np.isfinite(d)
    out = np.full((len(points), degree), -1, np.int64)
    row = np.arange(len(points))
    for k in range(degree):
        best = np.argmax(alive, 1)
        some = alive[row, best]
        if not some.any():
            break
        out[some, k] = candidates[some, best[some]]
        alive &= alpha * alpha * between[row, best] > d
        alive[row, best] = False
    return out


def build_graph(x: np.ndarray, s: Settings) -> tuple[np.ndarray, int]:
    """(out-edges, entry node) of one shard's distinct vectors."""
    n = len(x)
    edges = np.full((n, s.degree), -1, np.int64)
    mean = x.mean(0)
    start = int(np.argmin(((x - mean) ** 2).sum(1)))
    order = np.random.default_rng(11).permutation(n)
    order = np.concatenate([[start], order[order != start]])

    def link(points: np.ndarray, proposals: np.ndarray) -> None:
        edges[points] = robust_prune(x, points, np.concatenate([proposals, edges[points]], 1), s.degree, s.alpha)
        source, target = points.repeat(s.degree), edges[points].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        back = np.full((len(heads), min(int(counts.max(initial=1)), 3 * s.degree)), -1, np.int64)
        place = np.arange(len(target)) - first.repeat(counts)
        fits = place < back.shape[1]
        back[np.arange(len(heads)).repeat(counts)[fits], place[fits]] = source[fits]
        filled = (edges[heads] >= 0).sum(1)
        simple = filled + counts <= s.degree
        for h, b, f, c in zip(heads[simple], back[simple], filled[simple], counts[simple]):
            new = b[:c][~np.isin(b[:c], edges[h])]
            edges[h, f : f + len(new)] = new
        if (~simple).any():
            hard = heads[~simple]
            edges[hard] = robust_prune(x, hard, np.concatenate([back[~simple], edges[hard]], 1), s.degree, s.alpha)

    done = min(n, s.degree)
    first = order[:done]
    link(first, np.tile(first, (done, 1)))
    for turn in range(2):
        at = done if turn == 0 else 0
        while at < n:
            step = min(s.batch, max(s.degree, at)) if turn == 0 else s.batch
            points = order[at : at + step]
            found, _, _ = beam_search(x, edges, start, x[points], s.build_beam, s.expand)
            link(points, found)
            at += step
    return edges, start


def seen_share(index: DataFrame, queries: np.ndarray, settings: Settings = Settings()) -> float:
    """The share of a shard's nodes that searches for `queries` see, over all shards: how far the graph is from a scan."""
    parts = [(len(g.exact), beam_search(g.x, g.edges, g.start, queries.astype(np.float32), settings.search_beam)[2]) for g in _graphs_of(index.toPandas(), settings)]
    return sum(seen for _, seen in parts) / max(1, len(queries) * sum(n for n, _ in parts))


class Graph:
    """A shard's nodes as arrays, from its index rows."""

    def __init__(self, rows: pa.Table, degree: int):
        rows = rows.combine_chunks()
        vectors, ids, edges = (rows.column(c).chunk(0) for c in ("vector", "ids", "edges"))
        self.exact = vectors.flatten().to_numpy().reshape(len(vectors), -1)
        self.x = self.exact.astype(np.float32)
        self.start = int(np.flatnonzero(rows.column("entry").to_numpy(zero_copy_only=False))[0])
        at = np.diff(edges.offsets.to_numpy())
        self.edges = np.full((len(vectors), degree), -1, np.int64)
        self.edges[np.arange(degree)[None, :] < at[:, None]] = edges.flatten().to_numpy()
        self.lens = np.diff(ids.offsets.to_numpy())
        self.ids, self.begin = ids.flatten().to_numpy(), np.cumsum(self.lens) - self.lens

    def nearest(self, qid: np.ndarray, q: np.ndarray, k: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, distance) of the k nearest that a beam search finds for each query, itself left out."""
        found, _, _ = beam_search(self.x, self.edges, self.start, q.astype(np.float32), max(s.search_beam, 2 * k))
        r, c = np.nonzero(found >= 0)
        node = found[r, c]
        d = np.sqrt(((self.exact[node] - q[r]) ** 2).sum(1))
        n = self.lens[node]
        vec = self.ids[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(self.begin[node], n)]
        r, d = np.repeat(r, n), np.repeat(d, n)
        other = vec != qid[r]
        r, d, vec = r[other], d[other], vec[other]
        order = np.lexsort((vec, d, r))
        r, d, vec = r[order], d[order], vec[order]
        best = np.arange(len(r)) - np.searchsorted(r, r) < k
        return qid[r[best]], vec[best], d[best]


def _graphs_of(pdf: pd.DataFrame, s: Settings) -> list[Graph]:
    return [Graph(pa.Table.from_pandas(part.sort_values("node"), preserve_index=False), s.degree) for _, part in pdf.groupby("shard")]


def distinct_nodes(vectors: DataFrame, keep_ids: int) -> DataFrame:
    """(embedding, ids): usable vectors, each once, with its smallest ids; an id with several vectors has the smallest of them."""
    rows = vectors.where(F.col("vec_id").isNotNull() & usable("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    one = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    # a limit for each group is taken before the shuffle, too, so a frequent vector sends few rows
    ranked = one.withColumn("__n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("__n") <= keep_ids)
    return ranked.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


_INDEX = "shard int, node int, ids array<long>, vector array<double>, edges array<int>, entry boolean"


def build_index(nodes: DataFrame, shards: int, settings: Settings = Settings()) -> DataFrame:
    """One row per graph node: shard, node, its smallest ids, vector, out-edges, and whether searches enter here."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        width = pdf["embedding"].map(len).mode()[0]
        pdf = pdf[pdf["embedding"].map(len) == width]
        matrix = np.stack(pdf["embedding"])
        order = np.lexsort(matrix.T[::-1])  # the same whatever order the shuffle delivered
        matrix, ids = matrix[order], [pdf["ids"].iloc[i] for i in order]
        edges, entry = build_graph(matrix.astype(np.float32), settings)
        n = len(matrix)
        return pd.DataFrame({"shard": int(pdf["shard"].iloc[0]), "node": np.arange(n, dtype=np.int32), "ids": ids, "vector": list(matrix), "edges": [e[e >= 0].astype(np.int32) for e in edges], "entry": np.arange(n) == entry})

    return nodes.withColumn("shard", F.pmod(F.xxhash64("embedding"), F.lit(shards)).cast("int")).groupBy("shard").applyInPandas(run, _INDEX)


def search(index: DataFrame, queries: DataFrame, shards: int, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest that beam searches of all shards found, itself left out.

    Each shard gets all queries (the stated query set against all rows) and returns k rows for each.
    """
    kinds = (pa.int64(), pa.int64(), pa.float64())
    names = ["query_id", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, graph = None, [], None
        for batch in batches:
            own, asks = batch.column("shard").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((np.diff(own) != 0) | (np.diff(asks.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(batch)]):
                if own[a] != shard:
                    shard, held, graph = own[a], [], None
                if not asks[a]:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    graph, held = Graph(pa.Table.from_batches(held), settings.degree), []
                if graph is None:
                    continue
                qid, vectors = batch.column("number").to_numpy()[a:b], batch.column("vector").slice(a, b - a)
                fits = np.flatnonzero(np.diff(vectors.offsets.to_numpy()) == graph.exact.shape[1])
                for at in range(0, len(fits), settings.batch):
                    some = fits[at : at + settings.batch]
                    q = vectors.take(pa.array(some)).flatten().to_numpy().reshape(len(some), -1)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(graph.nearest(qid[some], q, k, settings), kinds)], names)

    asked = queries.where(F.col("vec_id").isNotNull() & usable("embedding")).groupBy("vec_id").agg(F.min(F.col("embedding").cast("array<double>")).alias("vector"))
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("asks"), F.col("vec_id").alias("number"), "vector")
    none = {"ids": F.lit(None).cast("array<bigint>"), "edges": F.lit(None).cast("array<int>"), "entry": F.lit(None).cast("boolean")}
    nodes = index.select("shard", F.lit(False).alias("asks"), F.col("node").cast("long").alias("number"), "vector", "ids", "edges", "entry")
    stream = nodes.unionByName(asked.withColumns(none)).repartition("shard").sortWithinPartitions("shard", "asks", "number")
    found = stream.mapInArrow(C.trimmed(run), "query_id long, vec_id long, score double")
    # k rows from each shard for each query: a bounded, even aggregation
    best = found.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("score", "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, settings: Settings = Settings()) -> DataFrame:
    nodes = C.materialise(distinct_nodes(vectors, k + 1), "nodes")
    shards = max(1, math.ceil(nodes.count() / settings.shard_rows))
    return search(build_index(nodes, shards, settings), queries, shards, k, settings)


def op1_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))
