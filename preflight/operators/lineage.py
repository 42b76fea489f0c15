"""G1 / G2 — downstream reach of changed nodes (bounded multi-source BFS).

Level-synchronous BFS as joins: each round joins the frontier with the
edge list, keeps unseen nodes (``left_anti`` against the visited set) and
tags them with the round number, so ``depth`` is the shortest hop count
from any seed.

Semantics kept from the reviewed tool: seeds are excluded, first-hop
nodes are always returned (``max_depth`` ≤ 0 acts as 1), nodes at
``depth >= max_depth`` are not expanded, cycles terminate, and with
``node_prefix`` only matching nodes are entered (others cut the path).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from preflight.config import BLAST_MAX_DEPTH
from preflight.session import discard, ensure_checkpoint_dir, materialize, size_setting

MODEL_PREFIX = "model."
EDGES_PER_PARTITION = 1_000_000
# Of a row in a broadcast, beside its id: the hash map's entry.
ROW_BYTES = 64
# Edges are first counted by so many hash bins of their source.
BINS = 1 << 16
# A large frontier's key filter: bits per id, and bits in all (half a million words).
FILTER_BITS, FILTER_LOG2 = 8, 25


def _seed_frame(spark, seeds) -> DataFrame:
    if isinstance(seeds, DataFrame):
        return seeds.select(F.col(seeds.columns[0]).cast("string").alias("id"))
    return spark.createDataFrame([(str(s),) for s in seeds], "id string")


def _hot_sources(e: DataFrame, edges: int, n: int) -> DataFrame:
    """``src, salts`` of sources whose out-degree exceeds the average
    partition load edges / n, each with ⌈deg · n / edges⌉ salts (≤ n).
    Degrees sum to the number of edges, so at most n sources qualify: a
    bound on what is broadcast.  Only sources in a hash bin above that load
    can qualify, so a first count keeps ``BINS`` numbers, not one per source."""
    share = F.col("deg") * F.lit(n) / F.lit(max(edges, 1))
    own = e.select("src", F.pmod(F.xxhash64("src"), F.lit(BINS)).alias("bin"))
    full = own.groupBy("bin").agg(F.count(F.lit(1)).alias("deg")).filter(share > 1).select("bin")
    return (own.join(F.broadcast(full), "bin", "left_semi")
            .groupBy("src").agg(F.count(F.lit(1)).alias("deg")).filter(share > 1)
            .select("src", F.ceil(share).cast("int").alias("salts")))


def _maybe(e: DataFrame, frontier: DataFrame, size: int) -> DataFrame:
    """Edges whose source may be one of ``size`` frontier ids: their ``key``
    is looked up in a bit set of the frontier's keys, broadcast as 64-bit
    words (at most 2^``FILTER_LOG2`` bits; a set that would be mostly full is
    not made).  Strangers may pass, no edge of the frontier is lost."""
    bits = max(16, (FILTER_BITS * size - 1).bit_length())
    bits = min(bits, FILTER_LOG2)
    if size > 1 << bits:
        return e
    place = F.col("key").bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    word = F.shiftright(place, 6)
    words = (frontier.select(word.alias("word"), F.expr("shiftleft(1L, CAST(key & 63 AS INT))").alias("bit"))
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    return (e.withColumn("word", word).join(F.broadcast(words), "word")
            .filter(F.expr("shiftright(bits, CAST(key & 63 AS INT)) & 1L = 1L")).drop("word", "bits"))


def blast_radius(edges: DataFrame, seeds, max_depth: int = BLAST_MAX_DEPTH,
                 node_prefix: str | None = MODEL_PREFIX,
                 partitions: int | None = None) -> DataFrame:
    """``unique_id, depth`` of every node reachable from ``seeds`` within
    ``max_depth`` hops (seeds excluded).  ``edges`` has ``src, dst``;
    ``seeds`` is a list of ids or a one-column DataFrame of ids.

    The edges are read once and written to the checkpoint folder with a
    64-bit ``key`` of their source; their number sets the least
    number of partitions of shuffles (``EDGES_PER_PARTITION``).  Each round scans the
    keys, keeps the edges that may start in the frontier and joins these to
    it by id:

    * a frontier whose measured bytes fit the session's broadcast threshold
      is broadcast, its keys and its ids, and the edges stream through in
      place — no shuffle, and a ``src`` holding a third of all edges is
      spread over every task;
    * of a larger frontier a bit set of keys of bounded size is broadcast
      (``_maybe``); the edges that pass are shuffled to the frontier.  An
      edge belongs to one round's frontier at most, so beside the bit set's
      strangers an edge is shuffled once.  Edges of sources above the average
      partition load (``_hot_sources``, looked for before the first such
      round) get a salt over a number of buckets proportional to their share,
      and each hot source's row is repeated once per salt.

    Each round's new nodes are written under ``spark.checkpoint.dir`` and read
    back (lineage cut, computed once; rows and bytes are observed during the
    write); the rounds are the result.  The edges' files are deleted."""
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    rounds = max(int(max_depth), 1)
    budget = size_setting(spark, "spark.sql.autoBroadcastJoinThreshold", 10 << 20)
    row = F.octet_length("id") + F.lit(ROW_BYTES)

    e = edges.select(F.col("src").cast("string").alias("src"),
                     F.col("dst").cast("string").alias("dst"))
    if node_prefix:
        e = e.filter(F.col("dst").startswith(node_prefix))
    e, total = materialize(e.withColumn("key", F.xxhash64("src")), "bfs-edges", count=True)
    n = partitions or max(1, -(-total // EDGES_PER_PARTITION))
    salts = F.coalesce(F.col("salts"), F.lit(1))
    hot, n_hot, scratch = None, 0, [e]

    seed = _seed_frame(spark, seeds).dropDuplicates(["id"]).withColumn("depth", F.lit(0))
    if isinstance(seeds, DataFrame):
        seed, size, width = materialize(seed, "bfs-seed", size=row)
        scratch.append(seed)
    else:
        size, width = len(seeds), sum(len(str(x).encode()) + ROW_BYTES for x in seeds)
    levels, seen = [seed], width
    for d in range(1, rounds + 1):
        f = levels[-1].select(F.col("id").alias("src"), F.xxhash64("id").alias("key"))
        if width <= budget:
            cand = (e.join(F.broadcast(f.select("key")), "key", "left_semi")
                    .join(F.broadcast(f.select("src")), "src"))
        else:
            if hot is None and n > 1:                    # of one partition no source exceeds the load
                hot, n_hot = materialize(_hot_sources(e, total, n), "bfs-hot", count=True)
                scratch.append(hot)
            near, fs = (x.join(F.broadcast(hot), "src", "left") if n_hot else x.withColumn("salts", F.lit(1))
                        for x in (_maybe(e, f, size), f.select("src")))
            near = near.select("src", "dst", F.pmod(F.xxhash64("dst"), salts).cast("int").alias("salt"))
            if n > int(spark.conf.get("spark.sql.shuffle.partitions")):      # else the session's number does, adaptively fewer
                near = near.repartition(n, "src", "salt")
            # a shuffled hash join building on the frontier
            fs = fs.withColumn("salt", F.explode(F.sequence(F.lit(0), salts - F.lit(1)))).drop("salts")
            cand = near.join(fs.hint("shuffle_hash"), ["src", "salt"])
        visited = levels[0].select("id")
        for lv in levels[1:]:
            visited = visited.union(lv.select("id"))
        v = F.broadcast(visited) if seen <= budget else visited
        nxt, size, width = materialize(cand.select(F.col("dst").alias("id")).distinct()
                                       .join(v, "id", "left_anti")
                                       .withColumn("depth", F.lit(d)), f"bfs-round{d}", size=row)
        if size == 0:
            scratch.append(nxt)
            break
        seen += width
        levels.append(nxt)
    out = levels[0].limit(0)
    for lv in levels[1:]:
        out = out.unionByName(lv) if lv is not levels[1] else lv
    out = out.select(F.col("id").alias("unique_id"), F.col("depth").cast("long").alias("depth"))
    discard(scratch)
    return out


def reached_models(catalog, reach: DataFrame) -> DataFrame:
    """Reached ids → catalog models (unknown ids dropped)."""
    return reach.join(catalog.models.select("unique_id", "name"), "unique_id")


def row_lineage_edges(tables: dict) -> DataFrame:
    """Row-level lineage of the order schema: a parent row feeds every row
    that references it (region → nation → customer / supplier → orders →
    lineitem, part → lineitem, supplier → lineitem).  Node ids are
    ``<table>:<key>``; each edge comes from the child table alone."""
    def node(table, *cols):
        parts = [F.lit(table + ":")]
        for i, c in enumerate(cols):
            if i:
                parts.append(F.lit(":"))
            parts.append(F.col(c).cast("string"))
        return F.concat(*parts)

    t = tables
    pieces = [
        t["nation"].select(node("region", "n_regionkey").alias("src"),
                           node("nation", "n_nationkey").alias("dst")),
        t["customer"].select(node("nation", "c_nationkey").alias("src"),
                             node("customer", "c_custkey").alias("dst")),
        t["supplier"].select(node("nation", "s_nationkey").alias("src"),
                             node("supplier", "s_suppkey").alias("dst")),
        t["orders"].select(node("customer", "o_custkey").alias("src"),
                           node("orders", "o_orderkey").alias("dst")),
        # one scan of lineitem, three parents per line
        t["lineitem"].select(F.explode(F.array(*[
            F.struct(node(parent, key).alias("src"),
                     node("lineitem", "l_orderkey", "l_linenumber").alias("dst"))
            for parent, key in (("orders", "l_orderkey"), ("part", "l_partkey"),
                                ("supplier", "l_suppkey"))])).alias("e")).select("e.src", "e.dst"),
    ]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    return out
