"""Approximate nearest neighbours by largest inner product, over sharded robust-pruned graphs.

Vectors are dealt to shards by hash. In a shard, batches of vectors search the graph so far with a
beam; what they visit is pruned with a relaxed distance, so an edge stays unless a kept one is
closer to its end by the factor ``alpha``; back edges are added and pruned alike. Inner products
become distances by one more dimension that gives all vectors the same norm. Graphs are written to
the shared folder. A query beam-searches every shard, scores what it found in double precision on
the original vectors, and the shards' best are merged.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; where lengths differ, missing components count as zero. Equal vectors are one node of the
graph, of which the k + 1 smallest ids are kept, as no query can return more of them. Repeated ids
with one vector are one row. Empty tables give empty tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shroud.llm.scratch import write_table


@dataclass(frozen=True)
class GraphParams:
    degree: int = 32
    build_beam: int = 64
    search_beam: int = 128
    alpha: float = 1.2
    batch: int = 512
    seed: int = 7


def beam_search(x: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, width: int, visited: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of all queries at once: (ids, squared distances) by distance; -1 where fewer.

    ``visited`` gets (query, node, distance) of every node that was expanded.
    """
    m, norms = len(q), np.einsum("nd,nd->n", x, x)
    ids, dist = np.full((m, width), -1, np.int64), np.full((m, width), np.inf, np.float32)
    ids[:, 0] = entry
    dist[:, 0] = ((q - x[entry]) ** 2).sum(1)
    done = np.zeros((m, width), bool)
    qn = np.einsum("md,md->m", q, q)
    live = np.arange(m)
    while True:
        open_ = np.where(done[live] | (ids[live] < 0), np.inf, dist[live])
        pos = open_.argmin(1)
        some = np.isfinite(open_[np.arange(len(live)), pos])
        live, pos = live[some], pos[some]
        if not len(live):
            return ids, dist
        node = ids[live, pos]
        done[live, pos] = True
        if visited is not None:
            visited.append((live, node, dist[live, pos]))
        near, own = graph[node], ids[live]
        fresh = (near >= 0) & ~(near[:, :, None] == own[:, None, :]).any(2)
        d = qn[live, None] + norms[near] - 2 * np.matmul(x[near], q[live][:, :, None])[:, :, 0]
        d = np.where(fresh, np.maximum(d, 0), np.inf).astype(np.float32)
        both_d, both_i = np.concatenate([dist[live], d], 1), np.concatenate([own, near], 1)
        both_done = np.concatenate([done[live], np.zeros_like(fresh)], 1)
        best = np.argsort(both_d, 1, kind="stable")[:, :width]
        dist[live], ids[live], done[live] = (np.take_along_axis(a, best, 1) for a in (both_d, both_i, both_done))
        ids[live] = np.where(np.isfinite(dist[live]), ids[live], -1)


def robust_prune(x: np.ndarray, p: np.ndarray, cand: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Out-edges of each point of ``p`` from its row of candidates (-1: none), at most ``degree``."""
    cand = np.where(cand == p[:, None], -1, cand)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = -1
    xc = x[cand]
    dist = np.where(cand >= 0, ((xc - x[p][:, None, :]) ** 2).sum(2), np.inf)
    order = np.argsort(dist, 1, kind="stable")
    cand, dist = np.take_along_axis(cand, order, 1), np.take_along_axis(dist, order, 1)
    xc = np.take_along_axis(xc, order[:, :, None], 1)
    norms = np.einsum("bcd,bcd->bc", xc, xc)
    between = norms[:, :, None] + norms[:, None, :] - 2 * np.matmul(xc, xc.transpose(0, 2, 1))
    alive, out, rows = np.isfinite(dist), np.full((len(p), degree), -1, np.int64), np.arange(len(p))
    for r in range(degree):
        first = alive.argmax(1)
        has = alive[rows, first]
        if not has.any():
            break
        out[has, r] = cand[rows, first][has]
        alive &= ~(alpha * alpha * between[rows, first] <= dist)
        alive[rows, first] = False
        alive &= has[:, None]
    return out


def build_graph(x: np.ndarray, params: GraphParams) -> tuple[np.ndarray, int]:
    """Out-edges of every row of ``x`` and the entry point, the row nearest the mean."""
    n, rng = len(x), np.random.default_rng(params.seed)
    degree = params.degree
    graph = rng.integers(0, n, (n, degree)) if n > 1 else np.full((n, degree), -1, np.int64)
    graph[graph == np.arange(n)[:, None]] = -1
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin()) if n else 0
    turns = np.random.default_rng(params.seed + 1).permutation(n)
    for alpha in (1.0, params.alpha):
        for i in range(0, n, params.batch):
            batch = turns[i : i + params.batch]
            visited: list = []
            beam_search(x, graph, entry, x[batch], params.build_beam, visited)
            q = np.concatenate([v[0] for v in visited])
            node = np.concatenate([v[1] for v in visited])
            graph[batch] = robust_prune(x, batch, np.concatenate([_rows(q, node, len(batch)), graph[batch]], 1), alpha, degree)
            source = np.repeat(batch, degree)
            target = graph[batch].ravel()
            _add_back(x, graph, target[target >= 0], source[target >= 0], alpha)
    return graph, entry


def _rows(key: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Values of each key as a row, -1 where a row has fewer."""
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    count = np.bincount(key, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1, np.int64)
    out[key, np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)] = value
    return out


def _add_back(x: np.ndarray, graph: np.ndarray, target: np.ndarray, source: np.ndarray, alpha: float) -> None:
    """Add edges target -> source; rows that overflow are pruned."""
    nodes, index = np.unique(target, return_inverse=True)
    added = _rows(index, source, len(nodes))
    for i in range(0, len(nodes), 1024):
        p, both = nodes[i : i + 1024], np.concatenate([graph[nodes[i : i + 1024]], added[i : i + 1024]], 1)
        both = np.sort(both, 1)[:, ::-1]
        both[:, 1:][both[:, 1:] == both[:, :-1]] = -1
        both = np.sort(both, 1)[:, ::-1]
        room = (both >= 0).sum(1) <= graph.shape[1]
        graph[p[room]] = both[room][:, : graph.shape[1]] if both.shape[1] >= graph.shape[1] else graph[p[room]]
        full = ~room
        if full.any():
            used = int((both[full] >= 0).sum(1).max())
            graph[p[full]] = robust_prune(x, p[full], both[full][:, :used], alpha, graph.shape[1])


def valid_vector(v: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    return v.isNotNull() & F.forall(v, finite) & F.exists(v, lambda c: c != 0)


def distinct_vectors(rows: DataFrame, id_col: str, vector_col: str, k: int, is_query: Column) -> DataFrame:
    """(rep, v, ids, asked): each valid vector once, its smallest k + 1 ids, and whether a query has it.

    The rank filter limits equal vectors before the shuffle; the flag and the least id are partial aggregates.
    """
    valid = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), is_query.alias("asked")).where(
        F.col("id").isNotNull() & valid_vector(F.col("v"))
    )
    ids = valid.select("id", "v").distinct()
    nearest = ids.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    kept = nearest.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    asked = valid.groupBy("v").agg(F.max("asked").alias("asked"))
    return kept.join(asked, "v").select(F.col("ids")[0].alias("rep"), "v", "ids", "asked")


def _augmented(v: np.ndarray, top: float) -> np.ndarray:
    rest = np.sqrt(np.maximum(top - np.einsum("nd,nd->n", v, v), 0))
    return np.concatenate([v, rest[:, None]], 1).astype(np.float32)


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(column), dim))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def build_index(vectors: DataFrame, shard_rows: int = 1 << 14, params: GraphParams = GraphParams()) -> tuple[DataFrame, dict]:
    """Graphs of all shards as a table (shard, pos, rep, v, ids, edges, entry), and its meta data."""
    meta = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("top")).first()
    shards = max(1, -(-meta["n"] // shard_rows))
    dim, top = meta["dim"] or 1, meta["top"] or 0.0

    def build(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rep", ignore_index=True)
        graph, entry = build_graph(_augmented(_matrix(group["v"], dim), top), params)
        return group.assign(pos=np.arange(len(group)), edges=list(graph.astype(np.int32)), entry=entry)

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    schema = "rep long, v array<double>, ids array<long>, asked boolean, shard int, pos long, edges array<int>, entry long"
    index = dealt.repartitionById(shards, "shard").groupBy("shard").applyInPandas(build, schema)
    return write_table(index, "graph"), {"shards": shards, "dim": dim, "top": top, "params": params}


def search_index(index: DataFrame, meta: dict, queries: DataFrame, k: int, block_rows: int = 1 << 16) -> DataFrame:
    """(q, id, score): for each row of ``queries`` (q, v) its ``k`` nearest ids found in all shards."""
    shards, dim, top, params = meta["shards"], meta["dim"], meta["top"], meta["params"]
    blocks = max(1, -(-queries.count() // block_rows))
    asked = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    graphs = index.select("shard", "pos", "v", "ids", "edges", "entry").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    task = (F.col("block") * shards + F.col("shard")).cast("int").alias("task")  # one a shard and block, in a partition of its own
    graphs = graphs.select("*", task).repartitionById(shards * blocks, "task")
    asked = asked.select("*", task).repartitionById(shards * blocks, "task")

    def search(graph: pd.DataFrame, ask: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(graph) and len(ask):
            graph = graph.sort_values("pos")
            v, edges = _matrix(graph["v"], dim), np.stack(graph["edges"].to_numpy()).astype(np.int64)
            x, ids = _augmented(v, top), graph["ids"].to_numpy()
            for i in range(0, len(ask), params.batch):
                part = ask.iloc[i : i + params.batch]
                q = _matrix(part["v"], dim)
                length = np.sqrt(np.einsum("nd,nd->n", q, q))[:, None]
                flat = np.concatenate([q / length * np.sqrt(top), np.zeros((len(q), 1))], 1).astype(np.float32)
                found, _ = beam_search(x, edges, int(graph["entry"].iloc[0]), flat, max(params.search_beam, k))
                score = np.where(found >= 0, np.matmul(v[found], q[:, :, None])[:, :, 0], -np.inf)
                for name, row, s in zip(part["q"], found, score, strict=True):
                    best = [(-s[j], id_) for j in np.argsort(-s, kind="stable")[: len(row)] if row[j] >= 0 for id_ in ids[row[j]]]
                    best = sorted(best)[:k]
                    parts.append(pd.DataFrame({"q": name, "id": [b[1] for b in best], "score": [-b[0] for b in best]}))
        return pd.concat(parts) if parts else pd.DataFrame({"q": [], "id": [], "score": []})

    found = graphs.groupBy("task").cogroup(asked.groupBy("task")).applyInPandas(search, "q long, id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select("q", "id", "score")


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = 1 << 14, params: GraphParams = GraphParams()) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest other rows of every row for which ``is_query`` holds."""
    vectors = write_table(distinct_vectors(rows, id_col, vector_col, k, is_query), "vectors")
    index, meta = build_index(vectors, shard_rows, params)
    found = search_index(index, meta, vectors.where("asked").select(F.col("rep").alias("q"), "v"), k + 1)
    askers = rows.where(is_query).select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).cast("array<double>").alias("v")).where(valid_vector(F.col("v"))).distinct()
    askers = askers.join(vectors.where("asked").select("v", F.col("rep").alias("q")), "v").select("query_id", "q")
    others = askers.join(found, "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = others.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
