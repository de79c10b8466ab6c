"""Approximate nearest neighbours by cosine: lists of an inverted file, scanned column block by column block.

Unit vectors are turned by a random orthogonal matrix, so that the first m of D dimensions are a fair sample of a
distance. Within each probed list, partial squared distances grow by blocks of BLOCK dimensions; a candidate is
abandoned once the hypothesis that it can still be among the k nearest is rejected, that is once
`partial * D / m > best * (1 + EPSILON / sqrt(m)) ** 2`. Survivors get the exact cosine of the original vectors.

Centres, and the number of lists to probe, are fitted on a sample on the driver; every row is indexed. The sample has
2 * sqrt(rows) vectors, from SAMPLE[0] to SAMPLE[1], and there are sqrt(rows) / 4 lists, one for each eight of the
sample at most. The number of probes is the least with which the sample's own neighbours are found with recall `aim`.
Lists and the queries that probe them are dealt out in pieces of bounded size, so a list with a third of all rows is
no burden. Each piece of a list meets each piece of its queries once.

Vectors that are null, zero, of another length than most (so without a cosine to the others), or hold null or
non-finite components take no part; nor do rows without an id. Rows are told apart by id and vector: exact repeats
count once, both as queries and as candidates. Rows with the query's id are the query's own. An id with several vectors
has one answer for each, told apart by query_key; as a candidate it can stand in one answer with each of them.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

BLOCK, EPSILON = 16, 2.1
#: Bytes of the vectors of a list, and of its queries, that one group holds, roughly.
PIECE = 4 << 20
#: Queries that are held against a piece at once.
AT_ONCE = 512
#: Vectors that centres are fitted on, at least (if there are so many) and at most.
SAMPLE = (20_000, 200_000)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    scaled = x / np.abs(x).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def closest(u: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The centre of the largest cosine to each row, in blocks."""
    return np.concatenate([(u[i : i + 4096] @ centres.T).argmax(1) for i in range(0, len(u), 4096)]) if len(u) else np.empty(0, np.int64)


def fit(x: np.ndarray, n_lists: int, k: int, aim: float, seed: int) -> tuple[np.ndarray, int]:
    """Centres of spherical k-means, and how many lists to probe."""
    rng = np.random.default_rng(seed)
    u = unit(x)
    centres = u[rng.permutation(len(u))[:n_lists]]
    for _ in range(10):
        own = closest(u, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, u)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    own = closest(u, centres)
    asked = rng.permutation(len(u))[:256]
    near = u[asked] @ u.T
    near[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-near, axis=1)[:, : min(k, len(u) - 1)]
    place = np.argsort(np.argsort(-(u[asked] @ centres.T), axis=1), axis=1)
    found = np.sort(np.take_along_axis(place, own[best], 1).ravel())
    return centres, int(found[int(np.ceil(aim * len(found))) - 1]) + 1 if len(found) else 1


def scan(ids: np.ndarray, u: np.ndarray, qids: np.ndarray, v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of the queries, row of the candidates) of the pairs that no test abandons. u, v: turned unit vectors."""
    d = u.shape[1]
    same = qids[:, None] == ids[None, :]
    head = min(len(u), 256)
    first = 2 - 2 * (v @ u[:head].T)
    first[same[:, :head]] = np.inf
    best = np.partition(first, k - 1, 1)[:, k - 1] if head >= k else np.full(len(v), np.inf)
    best = np.where(np.isfinite(best), best, 4.0)
    done = min(BLOCK, d)
    part = (v[:, :done] ** 2).sum(1)[:, None] + (u[:, :done] ** 2).sum(1)[None, :] - 2 * (v[:, :done] @ u[:, :done].T)
    limit = best * (1 + EPSILON / np.sqrt(done)) ** 2 if done < d else best + 1e-9
    a, b = np.nonzero((part * (d / done) <= limit[:, None] + 1e-9) & ~same)
    part = part[a, b]
    while done < d:
        until = min(done + BLOCK, d)
        gap = v[a, done:until] - u[b, done:until]
        part = part + np.einsum("ij,ij->i", gap, gap)
        done = until
        limit = best * (1 + EPSILON / np.sqrt(done)) ** 2 if done < d else best + 1e-9
        on = part * (d / done) <= limit[a] + 1e-9
        a, b, part = a[on], b[on], part[on]
    return a, b


def near_one(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two that bring their largest components near one: cosines stay what they are to the last
    bit, and no square is too large or too small."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0))[1][:, None])


def hits_of(cands: pa.Table, asked: pa.Table, k: int, turn: np.ndarray) -> list[tuple]:
    """(query, its key, candidate, cosine) of each query's k nearest among these candidates; exact repeats count once."""
    only = lambda t: np.unique(np.stack([t["id"].to_numpy(), t["key"].to_numpy()]), axis=1, return_index=True)[1]
    at, ask = only(cands), only(asked)
    ids, x = cands["id"].to_numpy()[at], near_one(matrix(cands["vec"])[at])
    qids, qkeys, q = asked["id"].to_numpy()[ask], asked["key"].to_numpy()[ask], near_one(matrix(asked["vec"])[ask])
    u, norm, out = unit(x) @ turn, np.sqrt((x * x).sum(1)), []
    for i in range(0, len(q), AT_ONCE):
        part, own = q[i : i + AT_ONCE], qids[i : i + AT_ONCE]
        a, b = scan(ids, u, own, unit(part) @ turn, k)
        score = (x[b] * part[a]).sum(1) / (norm[b] * np.sqrt((part * part).sum(1))[a])
        order = np.lexsort((ids[b], -score, a))
        a, b, score = a[order], b[order], score[order]
        on = np.arange(len(a)) - np.searchsorted(a, a) < k
        out += zip(own[a[on]].tolist(), qkeys[i + a[on]].tolist(), ids[b[on]].tolist(), score[on].tolist(), strict=True)
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, key, vec) of the vectors that take part, and their length; key: a hash of the vector."""
    given = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vec"))
    own = given.select("id", F.xxhash64("vec").alias("key"), "vec")
    fine = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("vec", lambda c: c != 0)
    own = own.where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)
    most = own.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    size = most.d if most else 1
    return own.where(F.size("vec") == size), size


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, sample: tuple[int, int] = SAMPLE, aim: float = 0.96, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, query_key): for each row whose id is divisible by `every`, the k nearest other
    rows found, nearest first, ties to the smaller id. Columns besides the id and the vector are not read; an empty
    table gives an empty one. What nulls, repeats and odd vectors do is said above."""
    own, d = usable(vectors, id_col, vector_col)
    n = own.count()
    drawn = own.orderBy(F.xxhash64(F.lit(seed), "id", "key"), "id", "key").limit(min(sample[1], max(sample[0], round(2 * n**0.5)))).select("vec").toArrow()
    x = matrix(drawn["vec"]) if len(drawn) else np.ones((1, d))
    n_lists = max(1, min(round(n**0.5 / 4), len(x) // 8))
    centres, probes = fit(x, n_lists, k, aim, seed)
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))[0]

    def assign(batches):
        for batch in batches:
            if len(batch):
                own_list = closest(unit(matrix(batch.column(2))), centres)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own_list, pa.int32()), batch.column(2)], ["id", "key", "list", "vec"])

    rows = written(own.mapInArrow(assign, "id long, key long, list int, vec array<double>"), "ann-lists")
    # Exact repeats go before they meet in a piece, where there are any.
    if not rows.groupBy("id", "key").count().where("count > 1").isEmpty():
        rows = written(rows.dropDuplicates(["id", "vec"]), "ann-lists")
    sizes = np.zeros(n_lists, np.int64)
    for r in rows.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]

    def probe(batches):
        for batch in batches:
            for at in range(0, len(batch), AT_ONCE):
                b = batch.slice(at, AT_ONCE)
                order = np.argsort(-(unit(matrix(b.column(2))) @ centres.T), axis=1, kind="stable")
                reach = np.cumsum(sizes[order], axis=1)
                # Small lists: on until ten times k rows are probed, or all.
                wanted = np.maximum(probes, 1 + (reach < min(10 * k, n)).sum(1)).clip(max=n_lists)
                row = pa.array(np.repeat(np.arange(len(b)), wanted))
                lists = np.concatenate([o[:w] for o, w in zip(order, wanted, strict=True)])
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.int32()), *(b.column(i).take(row) for i in range(3))], ["list", "id", "key", "vec"])

    asked = written(rows.where(F.col("id") % every == 0).select("id", "key", "vec").mapInArrow(probe, "list int, id long, key long, vec array<double>"), "ann-queries")
    askers = np.zeros(n_lists, np.int64)
    for r in asked.groupBy("list").count().collect():
        askers[r["list"]] = r["count"]
    held = max(1, PIECE // (8 * d))
    parts = lambda sums: [max(1, int(-(-s // held))) for s in sums]
    plan = F.broadcast(rows.sparkSession.createDataFrame(list(zip(range(n_lists), parts(sizes), parts(askers), strict=True)), "list int, pieces int, turns int"))  # SAMPLE[1] / 8 rows at most
    dealt = lambda df, own, other: df.join(plan, "list").withColumn("own", F.pmod(F.xxhash64("id", "key"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
    left = dealt(rows, "pieces", "turns").select("list", F.col("own").alias("piece"), F.col("other").alias("turn"), "id", "key", "vec")
    right = dealt(asked, "turns", "pieces").select("list", F.col("other").alias("piece"), F.col("own").alias("turn"), "id", "key", "vec")

    def search(key, cands: pa.Table, asked: pa.Table) -> pa.Table:
        hits = hits_of(cands, asked, k, turn) if len(cands) and len(asked) else []
        return pa.table([pa.array(c, t) for c, t in zip(zip(*hits, strict=True) if hits else ([], [], [], []), (pa.int64(), pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "query_key", "vec_id", "score"])

    keys = ["list", "piece", "turn"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
