"""Exact top-k inner-product search with a pivot-distance index.

Vectors are lifted by one coordinate so that larger inner products are smaller
Euclidean distances. Each is keyed by its nearest pivot and its distance to it;
a pivot's distances are cut into annuli, and an annulus with many rows into
pieces of about ``piece_rows``. A query first searches the annulus it would
itself lie in, which bounds its k-th best score; then it visits the other
annuli, except those that the triangle inequality puts beyond that bound. The
result is exact.

An annulus is sent out once for each ``query_group`` queries that visit it, and
not at all if none does: a task holds one piece and one group of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellar.session import materialize

SCALE = 64
PIECE_ROWS = 2048
MAX_PIVOTS = 256
SAMPLE = 8192
QUERY_GROUP = 4096
ANNULI = 8


def _valid(v: Column) -> Column:
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return v.isNotNull() & F.coalesce(ok, F.lit(False))


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Integer vectors as rows; shorter vectors are filled with zeros."""
    flat, off = col.flatten().to_numpy(zero_copy_only=False), col.offsets.to_numpy()
    off = off - off[0]
    out = np.zeros((len(col), dim))
    n = np.diff(off)
    if len(flat):
        out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat
    return out


def _lift(x: np.ndarray, norm2: float) -> np.ndarray:
    return np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", x, x), 0.0))


def _distances(x: np.ndarray, top: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Euclidean distances of lifted rows (x, top) to lifted pivots."""
    p, pt = pivots[:, :-1], pivots[:, -1]
    d2 = np.einsum("ij,ij->i", x, x)[:, None] + top[:, None] ** 2 - 2 * (x @ p.T + top[:, None] * pt[None, :]) + (np.einsum("ij,ij->i", p, p) + pt**2)[None, :]
    return np.sqrt(np.maximum(d2, 0.0))


def _choose_pivots(x: np.ndarray, k: int, seed: int = 9) -> np.ndarray:
    """Spread-out pivots: each next one is drawn far from those before (squared-distance weights)."""
    rng = np.random.default_rng(seed)
    out = [x[rng.integers(len(x))]]
    d = ((x - out[0]) ** 2).sum(axis=1)
    while len(out) < k and d.sum() > 0:
        out.append(x[rng.choice(len(x), p=d / d.sum())])
        d = np.minimum(d, ((x - out[-1]) ** 2).sum(axis=1))
    return np.array(out)


def _key_task(model, dim: int):
    """Adds pivot and distance to (id, v) rows."""

    def task(batches):
        pivots, norm2 = model.value
        for b in batches:
            for k in range(0, b.num_rows, 8192):
                c = b.slice(k, 8192)
                x = _matrix(c.column(1), dim)
                d = _distances(x, _lift(x, norm2), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([c.column(0), c.column(1), pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near])], names=["id", "v", "pivot", "dist"])

    return task


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, least: np.ndarray):
    """For each query (a row of scores) its k best candidates with at least ``least``: query, candidate and score arrays.

    Ties at the k-th score are all kept here; the final ranking breaks them by id.
    """
    s = np.where(ids[None, :] == own[:, None], -np.inf, scores)
    if s.shape[1] > k:
        kth = -np.partition(-s, k - 1, axis=1)[:, k - 1]
        cut = np.maximum(kth, least)
        # of equal scores at the cut only the k smallest ids can be ranked
        order = np.argsort(ids, kind="stable")
        s, ids = s[:, order], ids[order]
        above = s > cut[:, None]
        at = (s == cut[:, None]) & (np.cumsum(s == cut[:, None], axis=1) <= k)
        i, j = np.nonzero((above | at) & np.isfinite(s))
    else:
        i, j = np.nonzero((s >= least[:, None]) & np.isfinite(s))
    return i, ids[j], s[i, j]


def _search(dim: int, k: int):
    """One piece of the index against one group of the queries that visit it."""

    def task(left, right):
        got = ([], [], [])
        if left.num_rows and right.num_rows:
            x = _matrix(left.column("v").combine_chunks(), dim)
            ids = left.column("id").to_numpy()
            q, own = _matrix(right.column("v").combine_chunks(), dim), right.column("id").to_numpy()
            least = right.column("least").to_numpy()
            for a in range(0, len(q), 512):
                i, who, s = _best(q[a : a + 512] @ x.T, ids, own[a : a + 512], k, least[a : a + 512])
                for lst, val in zip(got, (own[a : a + 512][i], who, s)):
                    lst.append(val)
        cat = lambda z, t: np.concatenate(z).astype(t) if z else np.empty(0, t)
        return pa.table({x: cat(got[i], np.int64) for i, x in enumerate(["query_id", "vec_id", "score"])})

    return task


def _plan_task(model, rings, dim: int, home: bool, narrow: bool):
    """The annuli that each query visits: the one it lies in, or all within its bound; ``narrow``: their numbers alone."""

    def task(batches):
        pivots, norm2 = model.value
        p = rings.value
        for b in batches:
            for a in range(0, b.num_rows, 256):
                c = b.slice(a, 256)
                col = lambda x, c=c: c.column(c.schema.get_field_index(x))
                q = _matrix(col("v"), dim)
                d = _distances(q, np.zeros(len(q)), pivots)[:, p["pivot"]]
                away = np.maximum(np.maximum(p["near"][None, :] - d, d - p["far"][None, :]), 0.0)
                least = np.full(len(q), -np.inf) if home else col("least").to_numpy(zero_copy_only=False)
                if home:  # the annulus nearest to the query; ties: the first
                    i, j = np.arange(len(q)), (away + 1e-9 * d).argmin(axis=1)
                else:
                    # |q - v|^2 = |q|^2 + norm2 - 2 score: beyond this distance every score is below the bound
                    reach2 = np.einsum("ij,ij->i", q, q) + norm2 - 2 * least
                    with np.errstate(invalid="ignore"):
                        reach = np.where(np.isfinite(least), np.sqrt(np.maximum(reach2, 0)) * (1 + 1e-9) + 1e-6, np.inf)
                    i, j = np.nonzero(away <= reach[:, None])
                ring = pa.array(p["annulus"][j], pa.int32())
                if narrow:
                    yield pa.RecordBatch.from_arrays([ring], names=["annulus"])
                    continue
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays(
                    [col("id").take(take), col("v").take(take), pa.array(least[i]), ring],
                    names=["id", "v", "least", "annulus"],
                )

    return task


def _rank(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, id_col="vec_id", vector_col="embedding", scale: int = SCALE, piece_rows: int = PIECE_ROWS, query_group: int = QUERY_GROUP) -> DataFrame:
    """Each query's k best rows by integer inner product: query_id, rank, vec_id, score.

    Components are floor(scale * x). Queries are the rows for which
    ``is_query`` holds, candidates all rows but the query's own id. Ties go to
    the smaller id; with fewer than k candidates all are returned. Rows with a
    null id, a null vector, or a null or non-finite component take no part;
    shorter vectors are filled with zeros; rows that repeat id and vector count
    once. Different vectors under one id are candidates of their own; as queries
    they share one ranking of the scores of all of them. Inner products are
    exact below 2**53.

    The pivots are fitted on a bounded sample; every row is indexed. What is
    broadcast is a row per annulus, at most ``MAX_PIVOTS * ANNULI`` whatever the
    table; the pieces of an annulus are numbered, so their number is not bounded
    and their size is.
    """
    spark = vectors.sparkSession
    t = vectors.where(F.col(id_col).isNotNull() & _valid(F.col(vector_col)))
    ints = F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * scale).cast("long"))
    t = t.select(F.col(id_col).cast("long").alias("id"), ints.alias("v"), is_query.alias("q"))
    t = materialize(t.dropDuplicates(["id", "v"]))
    size = t.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("norm2"), F.count_if(F.coalesce("q", F.lit(False))).alias("nq")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not size.n or not size.nq:
        return spark.createDataFrame([], schema)
    n, dim, norm2 = size.n, max(size.dim, 1), float(size.norm2)
    rows = t.select("id", "v")
    # a sample of about SAMPLE rows by the hash of their id
    h = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 40))
    some = rows.where(h < F.lit(int((1 << 40) * min(1.0, SAMPLE / n)))).orderBy("id").toPandas()
    if not len(some):
        some = rows.orderBy("id").limit(1).toPandas()
    x = _matrix(pa.array(some["v"], pa.list_(pa.int64())), dim)
    x = np.column_stack([x, _lift(x, norm2)])
    pivots = _choose_pivots(x, int(min(MAX_PIVOTS, max(1, round((n / piece_rows) ** 0.5 * 2)))))
    model = spark.sparkContext.broadcast((pivots, norm2))
    keyed = materialize(rows.mapInArrow(_key_task(model, dim), "id long, v array<long>, pivot int, dist double"))
    cuts = keyed.groupBy("pivot").agg(
        F.percentile_approx("dist", [i / ANNULI for i in range(1, ANNULI)], 1000).alias("cut"), F.count(F.lit(1)).alias("n")
    ).toPandas()  # a row for each pivot
    # fewer rows, fewer annuli: about a piece each
    ladder = {int(r.pivot): sorted(set(np.asarray(r.cut)[:: max(1, round(ANNULI * piece_rows / max(r.n, 1)))].tolist())) if r.n > piece_rows else [] for r in cuts.itertuples()}
    at = F.create_map(*[y for p, c in ladder.items() for y in (F.lit(p), F.array(*map(F.lit, c)).cast("array<double>"))])[F.col("pivot")]
    ring = F.size(F.filter(at, lambda c: c < F.col("dist")))
    ringed = keyed.withColumn("annulus", F.col("pivot") * 1000 + ring)
    rings = ringed.groupBy("annulus").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).toPandas()
    rings["pieces"] = np.maximum(1, -(-rings["n"] // piece_rows))
    directory = spark.sparkContext.broadcast({
        "pivot": (rings["annulus"] // 1000).to_numpy(), "annulus": rings["annulus"].to_numpy(), "near": rings["near"].to_numpy() - 1e-6, "far": rings["far"].to_numpy() + 1e-6,
    })
    index = materialize(ringed.select("id", "v", "annulus"))
    queries = t.where("q").select("id", "v", F.lit(float("-inf")).alias("least"))

    def visit(q: DataFrame, home: bool) -> DataFrame:
        q = q.select("id", "v", "least")
        load = q.mapInArrow(_plan_task(model, directory, dim, home, True), "annulus int").groupBy("annulus").agg(F.count(F.lit(1)).alias("visits")).toPandas()
        load = load.merge(rings[["annulus", "pieces"]], on="annulus")
        load["groups"] = -(-load["visits"] // query_group)
        # a row for each visited annulus
        shape = F.broadcast(spark.createDataFrame([(int(r.annulus), int(r.pieces), int(r.groups)) for r in load.itertuples()], "annulus int, pieces long, groups long"))
        visits = q.mapInArrow(_plan_task(model, directory, dim, home, False), "id long, v array<long>, least double, annulus int").join(shape, "annulus")
        visits = visits.select("id", "v", "least", "annulus", F.pmod(F.xxhash64("id", F.lit(3)), F.col("groups")).alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        parts = index.join(shape, "annulus")
        parts = parts.select("id", "v", "annulus", F.pmod(F.xxhash64("id", "v", F.lit(3)), F.col("pieces")).alias("piece"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("grp"))
        at = ["annulus", "piece", "grp"]
        return parts.groupBy(*at).cogroup(visits.groupBy(*at)).applyInArrow(_search(dim, k), "query_id long, vec_id long, score long")

    first = materialize(_rank(visit(queries, True), k))
    bound = first.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("least"))
    bounded = queries.drop("least").join(bound, "id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    return _rank(visit(bounded, False), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


