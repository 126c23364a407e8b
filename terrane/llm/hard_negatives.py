"""Hard-negative mining over k-means inverted lists.

Vectors are quantized to whole numbers, ``floor(scale * x)``, so scores (inner products) are exact.

1. K-means is fitted on a bounded sample (``sample_rows``); centroids are rounded to whole numbers.
   Every row goes to the list of its nearest centroid, and each list stores its radius.
2. For a query a, no row of a list scores over ``a.c + |a| r`` nor under ``a.c - |a| r`` (Cauchy-Schwarz).
   A query visits lists by falling upper bound, in rounds that go eight times as far each; it leaves out lists
   outside its window of scores and stops when the bound falls strictly below its k-th score.
3. Two such searches: an anchor's positives are its best rows of the same label; then for each
   positive the best rows of another label in the window that the positive's score sets.

Bounds only skip what can't count, so the result is exact whatever the sample was. Lists are packed
into rows of up to LIST_ROWS vectors, queries into rows of up to QUERY_ROWS, and a round is a join of both
by list; the queries are broadcast only if their bytes, known from their number, allow it.

Rows with a null id, label or vector or a component that is null or not finite take no part. Shorter
vectors count as filled up with zeros. Rows with equal id, label and vector count once; others with an
anchor's id are anchors of their own, and none is a positive or negative of its own id. Ties go to the
smaller id. Scores that 64 bits can't hold are an error. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from terrane.plans.shipping import ship
from terrane.plans.storage import BROADCAST_BYTES, discard, sized, written

#: Rows in a packed row of a list and of queries.
LIST_ROWS, QUERY_ROWS = 4096, 1024
#: Lists at most, and bytes of all centroids at most.
MOST_LISTS, CENTROID_BYTES = 4096, 16 << 20
#: Lists that a query visits in the first round; each round goes FURTHER times as far.
FIRST_LISTS, FURTHER = 32, 8
I64 = np.iinfo(np.int64)


def quantized(column: pa.Array, scale: float, width: int | None = None) -> tuple[np.ndarray, list[np.ndarray] | np.ndarray]:
    """(which rows take part, their whole numbers as float64: a matrix if ``width`` is given, else their flat values' largest and each row's length).

    Nulls, NaN and infinities put a row out.
    """
    size = np.array(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    flat = column.flatten().cast(pa.float64())  # without the values of null rows
    values = np.asarray(flat.fill_null(float("nan")), np.float64)
    row = np.repeat(np.arange(len(column)), np.maximum(size, 0))
    ok = size >= 0
    ok[row[~np.isfinite(values)]] = False
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(scale * values)
    if width is None:
        return ok, [np.abs(values[ok[row]]), size[ok]]
    kept = ok[row]
    matrix = np.zeros((int(ok.sum()), width))
    at = np.cumsum(ok) - 1
    place = np.arange(len(row)) - np.repeat(np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0), np.maximum(size, 0))
    matrix[at[row[kept]], place[kept]] = values[kept]
    return ok, matrix


def kmeans(x: np.ndarray, k: int, rounds: int = 6, seed: int = 1) -> np.ndarray:
    """Whole-number centroids of the rows of ``x`` (a bounded sample), by Lloyd's rounds from random rows."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest(x, centroids)
        number = np.bincount(own, minlength=len(centroids))
        order = np.argsort(own, kind="stable")
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]))]), np.cumsum(number) - number, axis=0)
        centroids = np.where(number[:, None] > 0, sums / np.maximum(number, 1)[:, None], centroids)
    return np.unique(np.rint(centroids), axis=0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of each row's nearest centroid, in slices of bounded size."""
    half = (centroids * centroids).sum(1) / 2
    step = max(1, (8 << 20) // max(1, 8 * len(centroids)))
    return np.concatenate([np.argmax(x[a : a + step] @ centroids.T - half, axis=1) for a in range(0, max(1, len(x)), step)])


def scores_of(queries: np.ndarray, rows: np.ndarray, most: float) -> np.ndarray:
    """Exact inner products of whole numbers. ``most``: the largest product of two norms, which bounds every partial sum."""
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)


class Index:
    """The lists of a table of vectors: their rows, packed, and what bounds them."""

    def __init__(self, df: DataFrame, id_col: str, label_col: str, vector_col: str, scale: float, sample_rows: int) -> None:
        spark = df.sparkSession
        ship(spark)
        self.rows = self.packed = None
        raw = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
        raw = raw.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, width, most = 0, 0, 0.0
            for batch in batches:
                ok, (values, size) = quantized(batch.column("v"), scale)
                n, width, most = n + int(ok.sum()), max(width, int(size.max(initial=0))), max(most, float(values.max(initial=0)))
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([width]), pa.array([most])], ["n", "width", "most"])

        measured = raw.select("v").mapInArrow(measure, "n long, width long, most double").agg(F.sum("n"), F.max("width"), F.max("most")).first()
        self.n, width, most = measured[0] or 0, measured[1] or 0, measured[2] or 0.0
        if not self.n:
            return
        self.most = most * most * max(1, width)
        if self.most > I64.max:
            raise ValueError(f"components up to {most:.3g} in {width} dimensions give scores beyond 64 bits")
        self.width = width = max(1, width)
        self.kind = kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ok, x = quantized(batch.column("v"), scale, width)
                keys = np.column_stack([np.array(batch.column(c), np.int64)[ok] for c in ("id", "label")])
                yield pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())], ["id", "label", "q"])

        spread = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 30)) < int(min(1.0, sample_rows / self.n) * (1 << 30)) + 1
        some = raw.filter(spread).limit(2 * sample_rows).mapInArrow(whole, "id long, label long, q binary").select("q").toPandas()["q"]  # bounded
        x = np.stack([np.frombuffer(q, kind) for q in some]).astype(float) if len(some) else np.zeros((1, width))
        lists = int(min(max(1, np.sqrt(self.n)), MOST_LISTS, max(1, CENTROID_BYTES // (8 * width))))
        centroids = kmeans(x, lists)
        shared = spark.sparkContext.broadcast(centroids)  # CENTROID_BYTES at most

        def assigned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in whole(batches):
                q = batch.column("q")
                seen: dict = {}  # equal rows of a batch go on once
                once = [k for k, key in enumerate(zip(batch.column("id").to_pylist(), batch.column("label").to_pylist(), q.to_pylist(), strict=True)) if seen.setdefault(key, k) == k]
                batch = batch.take(pa.array(once, pa.int64()))
                rows = np.frombuffer(b"".join(batch.column("q").to_pylist()), kind).reshape(-1, width).astype(float)
                own = nearest(rows, shared.value) if len(rows) else np.zeros(0, np.int64)
                away = np.sqrt(((rows - shared.value[own]) ** 2).sum(1)) if len(rows) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(away, pa.float64()), *batch.columns], ["list", "away", *batch.schema.names])

        self.rows = written(raw.mapInArrow(assigned, "list int, away double, id long, label long, q binary"))
        about = self.rows.groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).toPandas()  # a row a list
        radius = np.full(len(centroids), -1.0)  # lists without rows aren't visited
        radius[about["list"].to_numpy()] = about["r"].to_numpy() * (1 + 1e-12)
        self.bounds = spark.sparkContext.broadcast((centroids, radius))
        self.lists = len(centroids)
        blocks = F.create_map(*[F.lit(int(v)) for k, n in zip(about["list"], about["n"], strict=True) if n > LIST_ROWS for v in (k, -(-n // (LIST_ROWS // 2)))]) if (about["n"] > LIST_ROWS).any() else None
        number = F.lit(1) if blocks is None else F.coalesce(blocks[F.col("list")], F.lit(1))
        block = F.pmod(F.xxhash64("id", "label", "q"), number).cast("int")

        def pack(table: pa.Table) -> pa.Table:
            keys = sorted(set(zip(table.column("id").to_pylist(), table.column("label").to_pylist(), table.column("q").to_pylist(), strict=True)))
            ids, labels = (np.array([k[c] for k in keys], np.int64).tobytes() for c in (0, 1))
            return pa.table({"list": [table.column("list")[0].as_py()], "ids": pa.array([ids], pa.binary()), "labels": pa.array([labels], pa.binary()), "qs": pa.array([b"".join(k[2] for k in keys)], pa.binary())})

        grouped = self.rows.withColumn("block", block).groupBy("list", "block")
        self.packed = written(grouped.applyInArrow(pack, "list long, ids binary, labels binary, qs binary"))

    def close(self) -> None:
        discard(*[t for t in (self.rows, self.packed) if t is not None])


def bounds_of(queries: np.ndarray, centroids: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(upper, lower) bounds of the scores of each query in each list; a list without rows has none."""
    middle = queries @ centroids.T
    norm = np.sqrt((queries * queries).sum(1))
    reach = norm[:, None] * np.maximum(radius, 0) * (1 + 1e-12) + 1e-6  # rounding only ever widens it
    return np.where(radius < 0, -np.inf, middle + reach), np.where(radius < 0, np.inf, middle - reach)


def _array(cell: pa.Scalar, kind: str | type) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind)


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(qid, id, score) of each query's best ``k`` rows: a written table.

    ``queries``: qid, own (its id, which doesn't count), label, q, lo, hi. With ``same`` rows of the query's
    label count, else those of another; scores lie between ``lo`` and ``hi``, both included.
    """
    width, kind, most = index.width, index.kind, index.most
    queries = written(queries)
    n = queries.count()
    blocks = n // (QUERY_ROWS // 2) + 1  # dealt by hash: half full on average
    small = n * (40 + width * np.dtype(kind).itemsize) <= BROADCAST_BYTES
    queries_schema = "qb long, qids binary, owns binary, labels binary, los binary, his binary, qs binary"

    def pack(table: pa.Table) -> pa.Table:
        order = np.argsort(np.array(table.column("qid"), np.int64))
        take = lambda c: np.array(table.column(c), np.int64)[order].tobytes()
        qs = table.column("q").to_pylist()
        cells = {"qb": [table.column("qb")[0].as_py()], **{f"{c}s": pa.array([take(c)], pa.binary()) for c in ("qid", "own", "label", "lo", "hi")}, "qs": pa.array([b"".join(qs[x] for x in order)], pa.binary())}
        return pa.table(cells)

    def visits(first: int, last: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centroids, radius = index_bounds.value
            for batch in batches:
                for b in range(batch.num_rows):
                    x = _array(batch.column("qs")[b], kind).reshape(-1, width).astype(float)
                    lo, hi = (_array(batch.column(c)[b], np.int64) for c in ("los", "his"))
                    upper, lower = bounds_of(x, centroids, radius)
                    order = np.argsort(-upper, axis=1, kind="stable")[:, first:last]
                    wanted = np.zeros(upper.shape, bool)
                    np.put_along_axis(wanted, order, True, axis=1)
                    wanted &= (upper >= lo[:, None]) & (lower <= hi[:, None])
                    lists = np.flatnonzero(wanted.any(0))
                    who = [np.packbits(wanted[:, c]).tobytes() for c in lists.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column("qb")[b].as_py()] * len(lists), pa.int64()), pa.array(lists, pa.int64()), pa.array(who, pa.binary())], ["qb", "list", "who"])

        return run

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(batch.num_rows):
                cell = lambda c, t: _array(batch.column(c)[b], t)  # noqa: B023, E731
                qid, own, label, lo, hi = (cell(c, np.int64) for c in ("qids", "owns", "labels", "los", "his"))
                chosen = np.flatnonzero(np.unpackbits(cell("who", np.uint8), count=len(qid)))
                ids, labels = cell("ids", np.int64), cell("list_labels", np.int64)
                x, rows = cell("qs", kind).reshape(-1, width), cell("list_qs", kind).reshape(-1, width)
                for at in range(0, len(chosen), 256):
                    c = chosen[at : at + 256]
                    s = scores_of(x[c], rows, most)
                    fits = (s >= lo[c, None]) & (s <= hi[c, None]) & ((label[c, None] == labels) == same) & (own[c, None] != ids)
                    q, r = np.nonzero(fits)
                    score = s[q, r]
                    order = np.lexsort((ids[r], -score, q))
                    q, r, score = q[order], r[order], score[order]
                    place = np.arange(len(q)) - np.searchsorted(q, q)
                    best = place < k
                    yield pa.RecordBatch.from_arrays([pa.array(qid[c][q[best]]), pa.array(ids[r[best]]), pa.array(score[best])], ["qid", "id", "score"])

    index_bounds = index.bounds
    ranked = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    lists = index.packed.select("list", "ids", F.col("labels").alias("list_labels"), F.col("qs").alias("list_qs"))
    found, first = None, 0
    while first < index.lists:
        last = max(FIRST_LISTS, FURTHER * first)
        live = queries
        if found is not None:
            kth = found.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
            live = queries.join(kth, "qid", "left").withColumn("lo", F.greatest("lo", "kth")).drop("kth")
        qs = written(live.withColumn("qb", F.pmod(F.xxhash64("qid"), F.lit(blocks))).groupBy("qb").applyInArrow(pack, queries_schema))
        units = qs.mapInArrow(visits(first, last), "qb long, list long, who binary").join(lists, "list").join(F.broadcast(qs) if small else qs, "qb")
        hits = units.select("qids", "owns", "labels", "los", "his", "qs", "who", "ids", "list_labels", "list_qs").mapInArrow(meet, "qid long, id long, score long")
        hits = hits if found is None else hits.unionByName(found)
        newer = written(hits.withColumn("__r", ranked).filter(F.col("__r") <= k).drop("__r"))
        discard(qs, *([] if found is None else [found]))
        found, first = newer, last
    discard(queries)
    return found


def mine(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", anchors: Column | None = None, n_positives: int = 5, n_negatives: int = 10, low_percent: int = 30, high_percent: int = 90, scale: float = 256.0, sample_rows: int = 16_384) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: which rows are anchors, a condition on column ``id`` (all, if None). A negative's score is
    between ``low_percent`` and ``high_percent`` of its positive's.
    """
    spark = df.sparkSession
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = Index(df, id_col, label_col, vector_col, scale, sample_rows)
    if not index.n:
        return spark.createDataFrame([], schema)
    chosen = index.rows.select("id", "label", "q").filter(F.lit(True) if anchors is None else anchors).distinct()
    chosen = written(chosen.withColumn("aid", F.monotonically_increasing_id()))
    everything = (F.lit(int(I64.min)).alias("lo"), F.lit(int(I64.max)).alias("hi"))
    positives = search(index, chosen.select(F.col("aid").alias("qid"), F.col("id").alias("own"), "label", "q", *everything), n_positives, True)
    pairs = positives.select(F.col("qid").alias("aid"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pairs = written(pairs.withColumn("qid", F.monotonically_increasing_id()))
    score = F.col("positive_score").cast("decimal(20,0)")
    window = (F.ceil(score * low_percent / 100).cast("long").alias("lo"), F.floor(score * high_percent / 100).cast("long").alias("hi"))
    queries = pairs.join(sized(chosen), "aid").select("qid", F.col("id").alias("own"), "label", "q", *window).filter("lo <= hi")
    found = search(index, queries, n_negatives, False)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "id"))
    named = pairs.join(sized(chosen.select("aid", F.col("id").alias("anchor_id"))), "aid")
    out = found.withColumn("rank", rank).join(sized(written(named)), "qid")
    index.close()
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
