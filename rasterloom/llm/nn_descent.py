"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy graph search.

Equal vectors are one node; as ties go to the smaller id, the TOP + 1 smallest ids of a node are all
that a result can name, whatever the number of copies. Nodes lie in shards of about `SHARD` nodes (fewer
where vectors are long): each node goes with the pivot of the largest cosine, of at most `PIVOTS` nodes
that a hash picks, and what one pivot attracts is cut by hash, so no shard is hot.

Within a shard each node starts with `K` neighbours; in every iteration Spark joins the neighbours
and reverse neighbours of each node on that node, the lists meet their shard's vectors in a co-group,
and every node keeps the K neighbours' neighbours of largest inner product. Long vectors thus
become hubs, as they are also what most searches look for.

A search holds a beam of the best nodes met; in each round the best not yet expanded are, and their
unseen neighbours are scored. It starts from the longest nodes, some fixed ones, one node of each
connected part of the graph, and the query's own node. How wide the beam must be depends on the
data, so it is measured: for `SAMPLE` nodes of one shard the search is held against all its nodes, and
the narrowest beam of `BEAMS` that finds `RECALL` of the true neighbours is taken for all shards.

Queries go to the shard of their nearest centre first. With what they have found there, a shard is
left out if none of its nodes can be better: by Cauchy-Schwarz, none scores over
min(|q| longest, <q, centre> + |q| radius). So routing loses nothing; recall is that of the searches.
On vectors without any structure (independent directions in 64 dimensions) the bound leaves out
no shard and the beam becomes wide. `exact` scores all nodes of the shards that the bound leaves.

A shard, its graph and a block of queries are all that a task holds. Scores are inner products of
the original vectors in double precision.

Defined cases: null or empty vectors, those with null, NaN or infinite components, all-zero ones, and
those whose length is not the most frequent one (of equally frequent: the smaller) take no part,
neither as query nor as candidate; a row that is there twice counts once; a null id takes no part;
fewer than TOP candidates give fewer rows; ties go to the smaller id; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, claim, hot_join, table, written

TOP, EVERY = 20, 20
SHARD, SHARD_VALUES, PIVOTS = 8192, 1 << 20, 4096
K, REVERSE, SEARCHED, ITERATIONS = 20, 12, 24, 7
#: Beam, nodes expanded at a time, rounds at most.
BEAMS = ((22, 2, 40), (32, 4, 40), (48, 4, 40), (64, 8, 40), (128, 16, 40), (256, 16, 60), (512, 32, 60), (1024, 32, 100), (2048, 64, 100), (1 << 30, 256, 1000))
SAMPLE, RECALL, ENTRIES, BLOCK, QUERIES = 100, 0.95, 32, 64, 4096


@dataclass
class Index:
    """Nodes (node, shard, r, vec, ids), where rows are (vec_id, node), the vectors' dimension, and per shard its centre, radius, longest vector and size."""

    placed: DataFrame
    rows: DataFrame
    dims: int
    centres: np.ndarray
    radius: np.ndarray
    longest: np.ndarray
    size: np.ndarray


def _vectors(column: pa.ChunkedArray | pa.Array, dims: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _to_pivots(pivots, dims: int):
    """Adds to each node the pivot of the largest cosine, the distance to it, and the node's length."""

    def run(batches):
        claim(__name__)
        centres = pivots.value
        unit = (centres / np.linalg.norm(centres, axis=1, keepdims=True)).astype(np.float32)
        for b in batches:
            v = _vectors(b.column(b.schema.get_field_index("vec")), dims)
            size = np.linalg.norm(v, axis=1)
            best = np.zeros(len(v), np.int32)
            for at in range(0, len(v), 1024):
                best[at : at + 1024] = ((v[at : at + 1024] / size[at : at + 1024, None]).astype(np.float32) @ unit.T).argmax(axis=1)
            far = np.linalg.norm(v - centres[best], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(best), pa.array(far), pa.array(size)], names=[*b.schema.names, "pivot", "far", "length"])

    return run


def index(rows: DataFrame, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding") -> Index:
    spark = rows.sparkSession
    x = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("vec")).where("vec_id is not null and size(vec) > 0")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    x = x.where(F.coalesce(finite, F.lit(False)) & F.exists("vec", lambda v: v != 0.0))
    sizes = x.groupBy(F.size("vec").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "n").first()
    dims = sizes["n"] if sizes else 1
    x = x.where(F.size("vec") == dims).withColumn("key", F.xxhash64("vec"))
    first = x.withColumn("k", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("k") <= top + 1)
    first = first.groupBy("key").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"), F.min_by("vec", "vec_id").alias("vec"))
    first = written(first.withColumn("node", F.col("ids")[0]), "nodes")
    aim = max(min(SHARD, 1024), min(SHARD, SHARD_VALUES // dims))
    wanted = min(PIVOTS, max(1, -(-first.count() // aim)))
    pivots = [r["vec"] for r in first.orderBy(F.xxhash64("node"), "node").limit(wanted).collect()] or [[1.0] * dims]
    centres = np.array(pivots, float).reshape(-1, dims)
    near = written(first.mapInArrow(_to_pivots(spark.sparkContext.broadcast(centres), dims), "key long, ids array<long>, vec array<double>, node long, pivot int, far double, length double"), "nodes")
    held = np.zeros(len(centres), np.int64)
    for r in near.groupBy("pivot").count().collect():  # at most PIVOTS
        held[r["pivot"]] = r["count"]
    cuts = np.maximum(1, -(-held // aim))
    start = np.cumsum(cuts) - cuts
    at = spark.createDataFrame([(p, int(start[p]), int(cuts[p])) for p in range(len(centres))], "p int, start int, cuts int")
    placed = near.join(F.broadcast(at), near["pivot"] == at["p"]).withColumn("shard", (F.col("start") + F.pmod(F.xxhash64("node"), F.col("cuts"))).cast("int"))
    placed = written(placed.withColumn("r", (F.row_number().over(Window.partitionBy("shard").orderBy("node")) - 1).cast("int")), "shards")
    all_rows = hot_join(written(x.select("vec_id", "key").distinct(), "rows"), "key", placed.select(F.col("key").alias("k"), "node"), "k", "inner").select("vec_id", "node")
    shards = int(cuts.sum())
    out = Index(placed.select("node", "shard", "r", "vec", "ids"), all_rows, dims, np.repeat(centres, cuts, axis=0), np.zeros(shards), np.zeros(shards), np.zeros(shards, np.int64))
    for r in placed.groupBy("shard").agg(F.max("far").alias("far"), F.max("length").alias("length"), F.count(F.lit(1)).alias("n")).collect():  # a row a shard
        out.radius[r["shard"]], out.longest[r["shard"]], out.size[r["shard"]] = r["far"], r["length"], r["n"]
    return out


def _lists(rows, n: int) -> np.ndarray:
    """(n + 1, w) members of each node's list, -1 where there are none; the last row has none."""
    at = rows["u"].to_numpy()
    column = rows["members"].combine_chunks() if isinstance(rows["members"], pa.ChunkedArray) else rows["members"]
    offsets, flat = column.offsets.to_numpy(), column.values.to_numpy()
    sizes = np.diff(offsets)
    out = np.full((n + 1, max(1, int(np.max(sizes, initial=0)))), -1, np.int64)
    fill = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(at, sizes), fill] = flat[offsets[0] : offsets[-1]] if len(offsets) else flat
    return out


def _array(members, dims: int, scale: float, dtype=np.float32) -> np.ndarray:
    x = np.zeros((members.num_rows, dims), dtype)
    x[members["r"].to_numpy()] = _vectors(members["vec"], dims) / scale
    return x


def best_of_neighbours(x: np.ndarray, lists: np.ndarray, k: int, block: int = 128) -> tuple[np.ndarray, np.ndarray]:
    """For each node the k of its neighbours and their neighbours with the largest inner product, -1 where there are fewer, and the products."""
    n = len(x)
    s = np.concatenate([np.append(np.arange(n), -1)[:, None], lists], axis=1)
    ids, scores = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf, np.float32)
    for a in range(0, n, block):
        u = np.arange(a, min(a + block, n))
        met = s[s[u]].reshape(len(u), -1)
        met.sort(axis=1)
        out = (met < 0) | (met == u[:, None])
        out[:, 1:] |= met[:, 1:] == met[:, :-1]
        p = np.matmul(x[np.maximum(met, 0)], x[u][:, :, None])[:, :, 0]
        p[out] = -np.inf
        some = min(k, p.shape[1])
        best = np.argpartition(-p, some - 1, axis=1)[:, :some]
        scores[u, :some] = np.take_along_axis(p, best, 1)
        ids[u, :some] = np.where(np.isfinite(scores[u, :some]), np.take_along_axis(met, best, 1), -1)
    return ids, scores


def _descend(dims: int, scale: float, k: int):
    """One iteration within a shard."""

    def run(key, lists, members):
        claim(__name__)
        n = members.num_rows
        ids, scores = best_of_neighbours(_array(members, dims, scale), _lists(lists, n), k)
        u, j = np.nonzero(ids >= 0)
        return pa.table([pa.array(np.full(len(u), key[0].as_py(), np.int32)), pa.array(u.astype(np.int32)), pa.array(ids[u, j].astype(np.int32)), pa.array(scores[u, j])], names=["shard", "u", "v", "score"])

    return run


def _neighbours(edges: DataFrame, reverse: int) -> DataFrame:
    """(shard, u, members): for each node its neighbours, and of the nodes that have it as neighbour the `reverse` nearest."""
    back = edges.select("shard", F.col("v").alias("u"), F.col("u").alias("v"), "score")
    back = back.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "u").orderBy(F.desc("score"), "v"))).where(F.col("rank") <= reverse)
    both = edges.select("shard", "u", "v").unionByName(back.select("shard", "u", "v"))
    return both.groupBy("shard", "u").agg(F.collect_set("v").alias("members"))


def graph(index: Index, k: int = K, iterations: int = ITERATIONS) -> DataFrame:
    """(shard, u, v, score): the neighbour graph, nodes by their number within the shard."""
    placed, dims = index.placed, index.dims
    scale = float(index.longest.max(initial=0.0)) or 1.0
    size = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("size"))
    start = placed.select("shard", F.col("r").alias("u")).join(F.broadcast(size), "shard")  # one row a shard
    step = F.pmod(F.xxhash64("u", "j"), F.col("size") - 1) + 1
    edges = start.where("size > 1").withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(k)))).select("shard", "u", ((F.col("u") + step) % F.col("size")).cast("int").alias("v"), F.rand(7).cast("float").alias("score")).distinct()
    vectors = placed.selectExpr("shard as at", "r", "vec").groupBy("at")
    for _ in range(iterations):
        lists = _neighbours(edges, REVERSE).groupBy("shard")
        edges = written(lists.cogroup(vectors).applyInArrow(_descend(dims, scale, k), "shard int, u int, v int, score float"), "graph")
    return edges


def _parts(near: np.ndarray) -> np.ndarray:
    """One node of each connected part of the graph."""
    n = len(near)
    label = np.arange(n)
    u = np.repeat(np.arange(n), near.shape[1])
    v = near.ravel()
    u, v = u[v >= 0], v[v >= 0]
    while True:
        new = label.copy()
        np.minimum.at(new, u, label[v])
        np.minimum.at(new, v, label[u])
        new = new[new]
        if (new == label).all():
            return np.unique(label)
        label = new


def entries(x: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Where searches begin: the longest nodes, some at fixed places, and one node of each connected part."""
    n = len(x)
    longest = np.argsort(-np.einsum("ij,ij->i", x, x), kind="stable")[:ENTRIES]
    return np.unique(np.concatenate([longest, np.linspace(0, n - 1, min(n, ENTRIES)).astype(np.int64), _parts(near[:n])]))


def search(q: np.ndarray, own: np.ndarray, x: np.ndarray, near: np.ndarray, first: np.ndarray, top: int, width: tuple[int, int, int]) -> tuple[np.ndarray, int]:
    """For a block of queries, greedy search from `first` and from own (-1: none): the numbers of the `top` best nodes met, -1 where there are fewer, and how many were scored."""
    m, n = len(q), len(x)
    beam, step, rounds = width
    row = np.arange(m)[:, None]
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # place n: nothing

    def once(ids):
        """Each row's unseen nodes, once and in front."""
        ids = np.where((ids < 0) | seen[row, ids], n, ids)
        ids.sort(axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = n
        ids.sort(axis=1)
        ids = ids[:, : int((ids < n).sum(axis=1).max(initial=0))]
        seen[row, ids] = True
        s = np.empty(ids.shape, np.float32)
        for c in range(0, ids.shape[1], 1024):
            part = ids[:, c : c + 1024]
            s[:, c : c + 1024] = np.matmul(x[np.minimum(part, n - 1)], q[:, :, None])[:, :, 0]
        s[ids == n] = -np.inf
        return ids, s

    ids, score = once(np.concatenate([np.broadcast_to(first, (m, len(first))), own[:, None]], axis=1))
    done = np.zeros(ids.shape, bool)
    for _ in range(rounds):
        if ids.shape[1] > beam:
            at = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
            ids, score, done = (np.take_along_axis(c, at, 1) for c in (ids, score, done))
        open_ = np.where(done, -np.inf, score)
        some = min(step, open_.shape[1])
        if not some:
            break
        at = np.argpartition(-open_, some - 1, axis=1)[:, :some]
        live = np.isfinite(np.take_along_axis(open_, at, 1))
        if not live.any():
            break
        done[row, at] |= live
        new, s = once(near[np.where(live, np.take_along_axis(ids, at, 1), n)].reshape(m, -1))
        ids, score, done = np.concatenate([ids, new], axis=1), np.concatenate([score, s], axis=1), np.concatenate([done, np.zeros(new.shape, bool)], axis=1)
    some = min(top, ids.shape[1])
    at = np.argpartition(-score, some - 1, axis=1)[:, :some] if some else np.zeros((m, 0), np.int64)
    out = np.take_along_axis(ids, at, 1)
    return np.where(np.isfinite(np.take_along_axis(score, at, 1)), out, -1), int(seen[:, :n].sum())


def width_for(x: np.ndarray, near: np.ndarray, top: int, wanted: float = RECALL) -> tuple[tuple[int, int, int], float, float]:
    """The narrowest of BEAMS that finds the wanted share of the true neighbours of SAMPLE nodes, that share, and the share of the nodes scored."""
    n = len(x)
    some = np.unique(np.linspace(0, n - 1, min(n, SAMPLE)).astype(np.int64))
    first, k = entries(x, near), min(top, n)
    true = np.argpartition(-(x[some] @ x.T), k - 1, axis=1)[:, :k]
    for width in BEAMS:
        found, scored = [], 0
        for a in range(0, len(some), BLOCK):
            ids, c = search(x[some[a : a + BLOCK]], some[a : a + BLOCK], x, near, first, k, width)
            found.append(ids)
            scored += c
        recall = float(np.mean([len(set(f.tolist()) & set(t.tolist())) / k for f, t in zip(np.concatenate(found), true, strict=True)]))
        if recall >= wanted:
            break
    return width, recall, scored / (n * len(some))


def _search(dims: int, top: int, scale: float, width):
    def run(key, blocks, shard):
        claim(__name__)
        n = shard.num_rows
        at = shard["r"].to_numpy()
        exact, node = _array(shard, dims, 1.0, float), np.zeros(n, np.int64)
        node[at] = shard["node"].to_numpy()
        x = (exact / scale).astype(np.float32)
        out = [[], [], []]
        q_node, q = blocks["q"].to_numpy(), _vectors(blocks["qvec"], dims) if blocks.num_rows else np.zeros((0, dims))
        if n and len(q) and width:
            near = _lists(pa.table([shard["r"], shard["members"]], names=["u", "members"]), n)
            first = entries(x, near)
            order = np.argsort(node)
        for a in range(0, len(q) if n else 0, BLOCK):
            part = q[a : a + BLOCK]
            if width:
                own = order[np.minimum(np.searchsorted(node[order], q_node[a : a + BLOCK]), n - 1)]
                own = np.where(node[own] == q_node[a : a + BLOCK], own, -1)
                ids, _ = search((part / scale).astype(np.float32), own, x, near, first, top + 8, width)
                s = np.einsum("ijk,ik->ij", exact[ids], part)
                s[ids < 0] = -np.inf
            else:
                s = np.einsum("jk,ik->ij", exact, part)
                ids = np.broadcast_to(np.arange(n), s.shape)
            best = np.lexsort((node[ids], -s), axis=1)[:, :top]
            s, ids = np.take_along_axis(s, best, 1), np.take_along_axis(ids, best, 1)
            i, j = np.nonzero(np.isfinite(s))
            for column, v in zip(out, (q_node[a + i], node[ids[i, j]], s[i, j]), strict=True):
                column.append(v)
        cat = lambda xs, t: pa.array(np.concatenate(xs) if xs else np.zeros(0, t))
        return pa.table([cat(out[0], np.int64), cat(out[1], np.int64), cat(out[2], np.float64)], names=["q", "node", "score"])

    return run


def _routed(index: Index, shards, home: bool):
    """Rows (q, qvec, shard): the shard of the nearest centre, or all others that can hold a better node than what is known (least)."""

    def run(batches):
        claim(__name__)
        centres, radius, longest, size = shards.value
        schema = pa.schema([("q", pa.int64()), ("qvec", pa.list_(pa.float64())), ("shard", pa.int32())])
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                q = _vectors(part.column(1), index_dims)
                near = q @ centres.T
                near[:, size == 0] = -np.inf
                first = near.argmax(axis=1)
                if home:
                    i, shard = np.arange(len(q)), first
                else:
                    norm = np.linalg.norm(q, axis=1)[:, None]
                    most = np.minimum(norm * longest[None, :], near + norm * radius[None, :])
                    least = part.column(2).to_numpy(zero_copy_only=False)[:, None]
                    go = (most * (1 + 1e-9 * np.sign(most)) >= least) & (size > 0)[None, :]
                    go[np.arange(len(q)), first] = False
                    i, shard = np.nonzero(go)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(i)), part.column(1).take(pa.array(i)).cast(schema.field(1).type), pa.array(shard.astype(np.int32))], schema=schema)

    index_dims = index.dims
    return run


def nearest(rows: DataFrame, is_query, top: int = TOP, vec_id: str = "vec_id", embedding: str = "embedding", exact: bool = False, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` nearest found of each row that is_query (a condition on vec_id) holds for.

    exact: score all nodes of the shards that the bound leaves. report: takes the beam, its recall and the share of nodes scored.
    """
    spark = rows.sparkSession
    arrow_rows(spark, 4000)
    at = index(rows, top, vec_id, embedding)
    placed, dims, shards = at.placed, at.dims, len(at.size)
    scale = float(at.longest.max(initial=0.0)) or 1.0
    width = None
    if exact:
        full = placed.withColumn("members", F.array().cast("array<int>"))
    else:
        near = _neighbours(graph(at), SEARCHED).withColumnsRenamed({"shard": "s", "u": "n"})
        full = placed.join(near, (F.col("shard") == F.col("s")) & (F.col("r") == F.col("n")), "left")
        full = written(full.select("shard", "r", "node", "vec", F.coalesce("members", F.array().cast("array<int>")).alias("members")), "full")
        if at.size.any():
            one = full.where(F.col("shard") == int(at.size.argmax())).toArrow()  # about SHARD nodes
            width, recall, share = width_for(_array(one, dims, scale), _lists(pa.table([one["r"], one["members"]], names=["u", "members"]), one.num_rows), top + 1)
            if report is not None:
                report.update(beam=width[0], recall=recall, scored=share, shards=shards)
            del one
    asked = written(at.rows.where(is_query), "queries")
    unique = asked.select(F.col("node").alias("q")).distinct().join(placed.select(F.col("node").alias("n"), F.col("vec").alias("qvec")), F.col("q") == F.col("n")).select("q", "qvec")
    unique = written(unique, "asked")
    info = spark.sparkContext.broadcast((at.centres, at.radius, at.longest, at.size))
    schema = "q long, qvec array<double>, shard int"

    def searched(routed: DataFrame) -> DataFrame:
        """The best nodes found for (q, qvec, shard); each shard goes to as many tasks as its queries fill."""
        routed = written(routed, "routed")
        tasks = routed.groupBy(F.col("shard").alias("at")).agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("tasks"))
        tasks = spark.createDataFrame(tasks.collect(), "at int, tasks int")  # a row a shard
        blocks = routed.join(F.broadcast(tasks), F.col("shard") == F.col("at")).withColumn("part", F.pmod(F.xxhash64("q"), F.col("tasks")).cast("int")).drop("at", "tasks")
        nodes = full.join(F.broadcast(tasks), F.col("shard") == F.col("at")).withColumn("p", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("shard", "tasks")
        got = blocks.groupBy("shard", "part").cogroup(nodes.groupBy("at", "p")).applyInArrow(_search(dims, top + 1, scale, width), "q long, node long, score double")
        return written(got, "found")

    found = searched(unique.mapInArrow(_routed(at, info, True), schema))
    if shards > 1:
        least = found.groupBy("q").agg(F.when(F.count(F.lit(1)) > top, F.min("score")).otherwise(float("-inf")).alias("least")).withColumnRenamed("q", "k")
        others = unique.join(least, unique["q"] == least["k"], "left").select("q", "qvec", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        found = found.unionByName(searched(others.mapInArrow(_routed(at, info, False), schema)))
    best = found.withColumn("k", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "node"))).where(F.col("k") <= top + 1)
    named = best.join(placed.select(F.col("node").alias("n"), "ids"), F.col("node") == F.col("n")).select("q", "score", F.explode("ids").alias("id"))
    lists = named.groupBy("q").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("d"), "id"))), 1, top + 1).alias("list"))  # at most (top + 1) ** 2 entries
    out = hot_join(asked, "node", written(lists, "lists"), "q", "inner").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("list", lambda x: x["id"] != F.col("vec_id")), 1, top).alias("list"))
    out = out.select("query_id", F.posexplode("list").alias("k", "x"))
    return out.select("query_id", (F.col("k") + 1).cast("int").alias("rank"), F.col("x.id").alias("vec_id"), (-F.col("x.d")).alias("score"))


def op6_nn_descent(spark, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)
