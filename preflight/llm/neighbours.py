"""Operator 10 — approximate nearest neighbours on shifted Hilbert curves.

Vectors are split by length into bands, each from half the longest of it
to the longest (the first one's is the longest of all).  In a band, the
direction of every vector is projected by random orthonormal maps to 16
dimensions, shifted at random, cut to 3 bits a dimension and placed on a
Hilbert curve, once for each of ``CURVES`` curves.  The curve is cut into
``BLOCKS`` ranges of about equally many vectors (quantiles of a bounded
sample of keys); a query looks at its own range and the two next to it on
every curve of every band.  Its best by inner product of each window are
merged, and reranked in double precision on the original vectors.  A band
of fewer than ``3 * LEAST_BLOCK`` vectors is looked at whole.

Queries and candidates are placed by direction alone, so no vector's length
moves another one's place; the scale of a band's cells is taken from its
vectors and the queries.  Within a band vectors are held times a power of
two that brings their lengths to 1/4 to 1, and windows are scored in double
precision with that power taken back, so no magnitude is lost.

Equal vectors are one point of the index with its ``k + 1`` smallest ids (no
larger id can be among a query's k), so a vector that a third of all rows
hold is one row.  Ranges are dealt as curve x run of ranges, with the
neighbouring ranges repeated; a run of more than ``PIECE_ROWS`` candidates is
split into pieces, each of which sees the run's queries; where more than
``PIECE_ROWS`` queries (by a sample) meet in a run, they are split too.

A window is a share of the band, 3 / BLOCKS of each curve: vectors without
any structure need windows that grow with their number for a steady
recall; for clustered ones more blocks do.

Cases: vectors that are null, empty, zero, hold null or non-finite components or
are not of the most common length take no part, nor do null ids; repeated
rows (same id and vector) are one; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preflight.llm.ship import ship
from preflight.session import materialize

CURVES, BLOCKS = 48, 150
DIMS, BITS = 16, 3
RUN = 15                # ranges of one task
SAMPLE = 20_000         # vectors whose keys fix the ranges (expected number)
BAND_SAMPLE = 2_000     # of one band at least
PIECE_ROWS = 50_000
LEAST_BLOCK = 64        # vectors in a range, or there are fewer ranges
LAST_BAND = 1_000       # vectors of less than 2^-1000 of the longest one's length are one band
SCORES = 4 << 20        # inner products held at a time
SEED = 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position of integer points [n, dims] (``bits`` bits each) on the
    Hilbert curve: Skilling's transform, then the bits interleaved."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        turn ^= np.where((x[-1] & q) != 0, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Band:
    """Scale, ranges and splits of one band on its curves."""

    def __init__(self, n: int, curves: int, blocks: int):
        blocks = max(1, min(blocks, n // LEAST_BLOCK))
        self.blocks = 1 if blocks <= 2 else blocks      # a window of two ranges is the whole band
        self.curves = 1 if blocks <= 2 else curves
        self.runs = -(-self.blocks // RUN)
        self.pieces = max(1, -(-n * min(RUN + 2, self.blocks) // self.blocks // PIECE_ROWS))
        self.low, self.span, self.edges, self.parts = [], [], [], []


class Curves:
    """Projections and shifts of every curve and (after ``fit``) the bands."""

    def __init__(self, dim: int, curves: int):
        rng = np.random.default_rng(SEED)
        d = min(DIMS, dim)
        self.maps = [np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, :d] for _ in range(curves)]
        self.shifts = rng.random((curves, d))
        self.bands: dict[int, Band] = {}

    def points(self, x: np.ndarray) -> np.ndarray:
        x = x / np.maximum(np.abs(x).max(1, keepdims=True), 1e-300)
        return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)

    def blocks(self, y: np.ndarray, c: int, band: Band) -> np.ndarray:
        """Range of every point; ``y`` are the points on the map of curve c."""
        if band.blocks == 1:
            return np.zeros(len(y), np.int64)
        return np.searchsorted(band.edges[c], self._keys(y, c, band), side="right")

    def _keys(self, y: np.ndarray, c: int, band: Band) -> np.ndarray:
        y = np.clip((y - band.low[c]) / band.span[c], 0, 1) * 0.5 + self.shifts[c] * 0.5
        return hilbert_keys(np.minimum((y * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)

    def fit(self, at: int, sample: np.ndarray, asking: np.ndarray, n: int, n_asking: int, blocks: int) -> Curves:
        """Band ``at`` of ``n`` vectors from a sample of it and one of all
        ``n_asking`` queries."""
        band = self.bands[at] = Band(n, len(self.maps), blocks)
        p, q = self.points(sample), self.points(asking)
        for c in range(band.curves):
            y, z = p @ self.maps[c], q @ self.maps[c]
            both = np.vstack([y, z])
            band.low.append(both.min(0))
            band.span.append(np.maximum(both.max(0) - both.min(0), 1e-9))
            k = np.sort(self._keys(y, c, band))
            band.edges.append(k[(np.arange(1, band.blocks) * len(k)) // band.blocks])
            load = np.bincount(self.blocks(z, c, band) // RUN, minlength=band.runs) / max(len(z), 1)
            band.parts.append(np.maximum(1, np.ceil(load * n_asking / PIECE_ROWS)).astype(np.int64))
        return self


def _matrix(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(len(col), -1)


SPOTS = "band int, curve int, run int, piece int, part int, block int, query boolean, cid long, vector binary"
GROUP = ["band", "curve", "run", "piece", "part"]


def _candidates(at: np.ndarray, cid: np.ndarray, c: int, band: Band):
    """Row, run, piece, part of vectors in ranges ``at``: in their run, in
    the run next to a range at its edge, and in every part of these."""
    row, own = [np.arange(len(at))], [at // RUN]
    for shift, edge in ((-1, 0), (1, RUN - 1)):
        i = np.flatnonzero(at % RUN == edge)
        row.append(i)
        own.append(at[i] // RUN + shift)
    row, own = np.concatenate(row), np.concatenate(own)
    real = (own >= 0) & (own < band.runs)
    row, own = row[real], own[real]
    many = band.parts[c][own]
    part = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    row, own = np.repeat(row, many), np.repeat(own, many)
    return row, own, cid[row] % band.pieces, part


def _queries(at: np.ndarray, cid: np.ndarray, c: int, band: Band):
    """Row, run, piece, part of queries in ranges ``at``: one part of their
    run, in every piece of it."""
    row = np.repeat(np.arange(len(at)), band.pieces)
    own = at[row] // RUN
    mixed = (cid[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).astype(np.int64)
    return row, own, np.tile(np.arange(band.pieces), len(at)), mixed % band.parts[c][own]


def _place(shared):
    """Every vector on every curve of its band, queries on those of all."""
    def run(batches):
        curves = shared.value
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                b = whole.slice(lo, 1024)
                cid, bands = b.column(0).to_numpy(), b.column(3).to_numpy()
                ask = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
                raw = b.column(1)
                flat = curves.points(_matrix(raw).astype(float))
                for c in range(len(curves.maps)):
                    y, out = flat @ curves.maps[c], []
                    for name, band in curves.bands.items():
                        if c >= band.curves:
                            continue
                        for rows, spread, query in ((np.flatnonzero(bands == name), _candidates, False),
                                                    (ask, _queries, True)):
                            if len(rows):
                                at = curves.blocks(y[rows], c, band)
                                row, *where = spread(at, cid[rows], c, band)
                                out.append([np.full(len(row), name), *where, at[row],
                                            np.full(len(row), query), rows[row]])
                    if not out:
                        continue
                    name, own, piece, part, spot, query, row = (np.concatenate(v) for v in zip(*out))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v.astype(np.int32)) for v in (name, np.full(len(row), c), own, piece, part, spot)]
                        + [pa.array(query), pa.array(cid[row]), raw.take(pa.array(row))],
                        names=[*GROUP, "block", "query", "cid", "vector"])
    return run


def _best(k: int):
    """The best ``k`` candidates of each query in its window."""
    def run(table: pa.Table) -> pa.Table:
        query = table["query"].to_numpy()
        block, cid = table["block"].to_numpy(), table["cid"].to_numpy()
        x = _matrix(table["vector"].combine_chunks()).astype(float) if table.num_rows else np.zeros((0, 1))
        scale = 0.5 ** (table["band"][0].as_py() if table.num_rows else 0)
        c = np.flatnonzero(~query)
        c = c[np.argsort(block[c], kind="stable")]
        spots, cands, ids = block[c], x[c], cid[c]
        out = [[], [], []]
        for b in np.unique(block[query]):
            q = np.flatnonzero(query & (block == b))
            lo, hi = np.searchsorted(spots, [b - 1, b + 2])
            if lo == hi:
                continue
            n, step = min(k, hi - lo), max(1, SCORES // (hi - lo))
            for i in range(0, len(q), step):
                s = x[q[i:i + step]] @ cands[lo:hi].T * scale
                top = np.argpartition(-s, n - 1, axis=1)[:, :n]
                out[0].append(np.repeat(cid[q[i:i + step]], n))
                out[1].append(ids[lo:hi][top].reshape(-1))
                out[2].append(np.take_along_axis(s, top, 1).reshape(-1))
        cat = lambda v, kind: np.concatenate(v) if v else np.zeros(0, kind)
        return pa.table({"q": pa.array(cat(out[0], np.int64), pa.int64()), "c": pa.array(cat(out[1], np.int64), pa.int64()),
                         "near": pa.array(cat(out[2], float), pa.float64())})
    return run


def _packed(exponent: int):
    """Vectors as bytes, times 2^(band - exponent): lengths of 1/4 to 1."""
    def run(batches):
        for b in batches:
            col, band = (b.column(b.schema.get_field_index(c)) for c in ("vector", "band"))
            off = col.offsets.to_numpy()
            flat = col.flatten().to_numpy(zero_copy_only=False).astype(float)
            power = np.repeat(band.to_numpy().astype(np.int64) - exponent, np.diff(off))
            raw = np.ldexp(flat, power).astype(np.float32).tobytes()
            base = off[0]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("cid")),
                 pa.array([raw[4 * (x - base):4 * (y - base)] for x, y in zip(off[:-1], off[1:])], pa.binary()),
                 b.column(b.schema.get_field_index("asks")), band], names=["cid", "vector", "asks", "band"])
    return run


def _sampled(rows: DataFrame, limit) -> DataFrame:
    """Rows chosen by a hash of cid: ``limit`` of 2^30 parts."""
    return rows.filter(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) < limit)


def _limit(share: float) -> int:
    return int(min(1.0, share) * (1 << 30)) + 1


def inner_product(a: str, b: str):
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0),
                       lambda s, v: s + v)


def nearest(vectors: DataFrame, queries, k: int = 20, curves: int = CURVES, blocks: int = BLOCKS) -> DataFrame:
    """``query_id, rank, vec_id, score`` of the rows that the predicate
    ``queries`` on vec_id selects, against all rows (vec_id, embedding)."""
    spark = ship(vectors.sparkSession)
    usable = vectors.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector")).filter(
        F.col("id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
        & F.exists("vector", lambda v: v != 0))
    sizes = usable.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    out = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], out)
    dim = sizes["d"]
    rows = usable.filter(F.size("vector") == dim).distinct()
    # equal vectors: one point, named by its smallest id, with k + 1 ids
    by = Window.partitionBy("vector").orderBy("id")
    points = materialize(
        rows.withColumn("r", F.row_number().over(by)).filter(F.col("r") <= k + 1).groupBy("vector")
        .agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("cid", F.col("ids")[0])
        .withColumn("top", F.array_max(F.transform("vector", lambda v: F.abs(v).cast("double"))))
        .withColumn("length", F.col("top") * F.sqrt(F.aggregate(
            F.transform("vector", lambda v: F.pow(v.cast("double") / F.col("top"), F.lit(2.0))), F.lit(0.0),
            lambda s, v: s + v))).drop("top"), "points")
    asked = rows.filter(queries(F.col("id"))).select(F.col("id").alias("query_id"), "vector")
    asked = materialize(asked.join(points.select("vector", "cid"), "vector").select("query_id", "cid"), "asked")
    longest = points.agg(F.max("length")).first()[0]
    exponent = int(np.frexp(longest)[1])            # 2^exponent is more than any length
    band = F.floor(F.lit(float(np.log2(longest))) - F.log2("length"))
    band = F.greatest(F.lit(0), F.least(F.lit(LAST_BAND), F.coalesce(band, F.lit(LAST_BAND)))).cast("int")
    marked = points.join(asked.select("cid").distinct().withColumn("asks", F.lit(True)), "cid", "left").select(
        "cid", "vector", F.coalesce("asks", F.lit(False)).alias("asks"), band.alias("band"))
    held = {r["band"]: (r["n"], r["q"]) for r in marked.groupBy("band").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).collect()}      # 1,001 rows at most
    n, n_asked = (sum(v) for v in zip(*held.values()))
    limits = F.create_map(*[F.lit(v) for at, (m, _) in held.items()
                            for v in (at, _limit(max(SAMPLE / n, BAND_SAMPLE / m)))])
    sample = _sampled(marked, limits[F.col("band")]).select("band", "vector").toArrow()
    asking = _sampled(marked.filter("asks"), _limit(SAMPLE / max(n_asked, 1))).select("vector").toArrow()
    flat = lambda t: t["vector"].combine_chunks().flatten().to_numpy().astype(float).reshape(-1, dim)
    of, sample, asking = sample["band"].to_numpy(), flat(sample), flat(asking)
    index = Curves(dim, curves)
    for at, (m, _) in sorted(held.items()):
        index.fit(at, sample[of == at] if (of == at).any() else np.ones((1, dim)), asking, m, n_asked, blocks)
    shared = spark.sparkContext.broadcast(index)
    spots = (marked.mapInArrow(_packed(exponent), "cid long, vector binary, asks boolean, band int")
             .mapInArrow(_place(shared), SPOTS))
    found = spots.groupBy(*GROUP).applyInArrow(_best(k + 4), "q long, c long, near double")
    merged = found.groupBy("q", "c").agg(F.max("near").alias("near"))
    first = Window.partitionBy("q").orderBy(F.desc("near"), "c")
    merged = materialize(merged.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= 2 * k + 8)
                         .select("q", "c"), "merged")
    # rerank on the original vectors
    p = points.select("cid", "vector", "ids")
    both = (merged.join(p.select(F.col("cid").alias("c"), F.col("vector").alias("y"), "ids"), "c")
            .join(p.select(F.col("cid").alias("q"), F.col("vector").alias("x")), "q")
            .withColumn("score", inner_product("x", "y")).select("q", "score", F.explode("ids").alias("vec_id")))
    order = [F.desc("score"), F.asc("vec_id")]
    some = (both.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
            .filter(F.col("r") <= k + 1).select(F.col("q").alias("cid"), "score", "vec_id"))
    own = Window.partitionBy("query_id", "cid").orderBy(*order)
    return (asked.join(some, "cid").filter("vec_id <> query_id").withColumn("rank", F.row_number().over(own))
            .filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def op10_nearest(spark, sf_dir):
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
