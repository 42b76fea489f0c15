"""Operator 11 — the prefix trie of conversations.

A node is a distinct sequence of first turns (role, text); its members are
the conversations that start with it.  Subtrees are measured on a balanced
parentheses encoding: each shard of the trie is a sequence of parentheses
with range min-max blocks over its excess; ``findclose`` delimits a subtree,
a rank of the pairs ``()`` counts its leaves, cumulative arrays over the
opening parentheses give its savings.

Plan:

* Turns become slim rows (two 64-bit digests and the bytes of role and text);
  no text is moved.  They are range-partitioned and sorted by conversation
  and turn and numbered within the task; a conversation that reaches over
  several tasks carries its count (one broadcast row per task at most).
* The first d turns are named by the XOR of the hashes of (place, turn), a
  running window over blocks of ``BLOCK`` turns with carried block totals.
  One aggregation by (depth, name) gives the nodes and their members' number.
* A run of nodes with the same members is one chain, named by its smallest
  member and their number.  Only chains go into the shards: every
  conversation that ends in a leaf gives the path of its chains, and the
  paths are range-partitioned and sorted, which is depth-first order.  A task
  cuts its paths into shards of about ``SHARD`` nodes.
* Neighbouring shards share the chains on the spine between them.  Within a
  task the spine is known; between tasks the last path of one and the first
  of the next are compared, and what they share is taken off once.
* The ids that end at a node are joined into pieces in sorted tasks; the
  digest reads the pieces in order.

Cases: a null role or text is empty, a null turn comes first; ties of a turn
go by role, then by the text's first 64 characters, then by its digest.  Rows
without conv_id are no conversation and are left out.  Repeated rows are
repeated turns.  Texts of any length count whole.  No conversations give no
node, not even a root.  Other columns are ignored.  A path's length is at
most the square root of twice the number of turns, as each of its chains has
fewer members than the one before.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from preflight.llm.ship import ship
from preflight.session import materialize

#: Turns of a conversation within one window.
BLOCK = 4096
#: Path elements of a shard of parentheses (a longer path is a shard of its own).
SHARD = 1 << 18
#: Places of a range min-max block.
RMM = 64
#: Shared turns at most, and every so many conversations share a base.
SHARED, FAMILY = 9, 5

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PATH = "array<struct<neg:long,m:long,bytes:long>>"
EMPTY = hashlib.sha256(b"").hexdigest()


# --- turns ---------------------------------------------------------------

def _number(batches):
    """Place ``k`` of each row within its conversation, from 1, as far as
    this task holds it."""
    last, n = None, 0
    for b in batches:
        conv = b.column(0).to_numpy()
        if not len(conv):
            continue
        at = np.arange(len(conv))
        new = np.ones(len(conv), bool)
        new[1:] = conv[1:] != conv[:-1]
        new[0] = last is None or conv[0] != last
        start = np.maximum.accumulate(np.where(new, at, -1))
        k = np.where(start < 0, at + 1 + n, at - start + 1)
        last, n = conv[-1], int(k[-1])
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(k)], names=[*b.schema.names, "k"])


def numbered(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, j, d1, d2, bytes)`` with their place ``j``, and the
    conversations ``(conv_id, total)``."""
    ship(df.sparkSession)
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    slim = materialize(df.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.substring(text, 1, 64).alias("head"), F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.md5(text), F.md5(role)).alias("d2"), F.octet_length(text).cast("long").alias("bytes"),
        F.monotonically_increasing_id().alias("at")), "trie-slim")
    keys = ["conv_id", "turn", "role", "head", "d1", "d2", "at"]
    ranged = (slim.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select("conv_id", "d1", "d2", "bytes", F.spark_partition_id().alias("chunk")))
    turns = materialize(ranged.mapInArrow(_number, "conv_id long, d1 long, d2 long, bytes long, chunk int, k long"),
                        "trie-turns")
    spans = turns.groupBy("conv_id", "chunk").agg(F.max("k").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    spans = materialize(spans.withColumn("off", F.coalesce(F.sum("n").over(before), F.lit(0))), "trie-spans")
    # a task continues one conversation at most
    carried = F.broadcast(spans.filter("off > 0").select("conv_id", "chunk", "off"))
    turns = (turns.join(carried, ["conv_id", "chunk"], "left")
             .select("conv_id", (F.col("k") + F.coalesce("off", F.lit(0))).alias("j"), "d1", "d2", "bytes"))
    return turns, spans.groupBy("conv_id").agg(F.sum("n").alias("total"))


def as_they_are(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    convs = convs.withColumnRenamed("total", "len")
    return turns.withColumnRenamed("j", "pos").join(convs, "conv_id"), convs


def rebuilt(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversation c with the first h turns of conversation c - c % 5 before
    its own turns from the (h+1)-th on; h is crc32(c) % 9."""
    heads = (turns.filter((F.col("j") < SHARED) & (F.col("conv_id") % FAMILY == 0))
             .groupBy(F.col("conv_id").alias("base"))
             .agg(F.sort_array(F.collect_list(F.struct("j", "d1", "d2", "bytes"))).alias("head")))
    h = F.crc32(F.col("conv_id").cast("string")) % SHARED
    info = convs.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("h", h)
    info = info.join(heads, "base", "left")
    info = info.withColumn("head", F.filter(F.coalesce("head", F.array()), lambda x: x["j"] <= F.col("h")))
    info = info.withColumn("len", F.size("head") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    info = materialize(info.select("conv_id", "h", "head", F.col("len").cast("long").alias("len")), "trie-convs")
    shared = info.select("conv_id", "len", F.explode("head").alias("x")).select(
        "conv_id", F.col("x.j").alias("pos"), "x.d1", "x.d2", "x.bytes", "len")
    own = (turns.join(info.select("conv_id", "h", "len", F.size("head").alias("shared")), "conv_id")
           .filter("j > h").select("conv_id", (F.col("j") - F.col("h") + F.col("shared")).alias("pos"),
                                   "d1", "d2", "bytes", "len"))
    return shared.unionByName(own), info.select("conv_id", "len")


def prefixes(turns: DataFrame) -> DataFrame:
    """Name (``f1``, ``f2``) and bytes (``cum``) of the first ``pos`` turns."""
    t = (turns.withColumn("block", F.floor((F.col("pos") - 1) / F.lit(BLOCK)).cast("long"))
         .withColumn("h1", F.xxhash64("pos", "d1", "d2")).withColumn("h2", F.xxhash64("d2", F.lit(17), "d1", "pos")))
    blocks = (t.filter(F.col("len") > BLOCK).groupBy("conv_id", "block")
              .agg(F.bit_xor("h1").alias("g1"), F.bit_xor("h2").alias("g2"), F.sum("bytes").alias("g")))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.bit_xor("g1").over(before).alias("g1"),
                           F.bit_xor("g2").over(before).alias("g2"), F.sum("g").over(before).alias("g"))
    w = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "block", "pos", "bytes", "len", F.bit_xor("h1").over(w).alias("f1"),
                 F.bit_xor("h2").over(w).alias("f2"), F.sum("bytes").over(w).alias("cum"))
    none = F.lit(0).cast("long")
    return t.join(blocks, ["conv_id", "block"], "left").select(
        "conv_id", "pos", "bytes", (F.col("pos") == F.col("len")).alias("last"),
        F.col("f1").bitwiseXOR(F.coalesce("g1", none)).alias("f1"),
        F.col("f2").bitwiseXOR(F.coalesce("g2", none)).alias("f2"), (F.col("cum") + F.coalesce("g", none)).alias("cum"))


# --- balanced parentheses ------------------------------------------------

class Parentheses:
    """Balanced parentheses with range min-max blocks over the excess."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.excess = np.cumsum(np.where(bits, 1, -1), dtype=np.int64)
        pairs = np.zeros(len(bits) + 1, np.int64)
        pairs[1:-1] = np.cumsum(bits[:-1] & ~bits[1:])
        pairs[-1] = pairs[-2]
        self.pairs = pairs                        # pairs "()" that open before a place
        blocks = 1 << max(0, (-(-len(bits) // RMM) - 1).bit_length())
        far = np.iinfo(np.int64).max
        padded = np.full(blocks * RMM, far, np.int64)
        padded[:len(bits)] = self.excess
        self.mins = [padded.reshape(blocks, RMM).min(axis=1)]
        while len(self.mins[-1]) > 1:
            self.mins.append(self.mins[-1].reshape(-1, 2).min(axis=1))
        self._padded = padded

    def _scan(self, at: np.ndarray, target: np.ndarray) -> np.ndarray:
        """First place from ``at`` to the end of its block with an excess of
        ``target`` or less, else -1."""
        out = np.full(len(at), -1, np.int64)
        left, at = np.arange(len(at)), at.copy()
        stop = (at // RMM + 1) * RMM
        for _ in range(RMM):
            ok = at < stop[left]
            left, at = left[ok], at[ok]
            if not len(left):
                break
            hit = self._padded[at] <= target[left]
            out[left[hit]] = at[hit]
            left, at = left[~hit], at[~hit] + 1
        return out

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The closing place of each opening one."""
        target = self.excess[opens] - 1
        inside = (opens + 1) % RMM != 0
        out = np.full(len(opens), -1, np.int64)
        out[inside] = self._scan(opens[inside] + 1, target[inside])
        todo = np.flatnonzero(out < 0)
        node, goal = opens[todo] // RMM, target[todo]
        found = np.full(len(todo), -1, np.int64)          # level at which a later block qualifies
        for level, mins in enumerate(self.mins[:-1]):
            up = found < 0
            right = up & (node % 2 == 0)
            right[right] = mins[node[right] + 1] <= goal[right]
            node = np.where(right, node + 1, np.where(up, node >> 1, node))
            found[right] = level
        for level in range(len(self.mins) - 2, 0, -1):
            down = found == level
            first = node[down] * 2
            node[down] = np.where(self.mins[level - 1][first] <= goal[down], first, first + 1)
            found[down] = level - 1
        out[todo] = self._scan(node * RMM, goal)
        return out


def common(off, neg, m) -> np.ndarray:
    """Levels that each path shares with the one before (the first: 0)."""
    n = len(off) - 1
    size = np.diff(off)
    level = np.arange(off[-1]) - np.repeat(off[:-1], size)
    prev = np.repeat(np.concatenate([[0], off[:-2]]), size) + level
    short = level >= np.repeat(np.concatenate([[0], size[:-1]]), size)
    prev[short] = 0
    same = ~short & (neg == neg[prev]) & (m == m[prev])
    first = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, level), off[:-1]) if n else size
    out = np.minimum(first, size)
    out[:1] = 0
    return out


def shard(off, neg, m, size, shared: int):
    """Nodes of the trie of sorted leaf paths: chain (m, n), parent's m (-1
    with ``top``), leaves, savings and children below; the first path's first
    ``shared`` levels belong to an earlier shard."""
    lcp = common(off, neg, m)
    length = np.diff(off)
    level = np.arange(off[-1]) - np.repeat(off[:-1], length)
    fresh = level >= np.repeat(lcp, length)
    at = np.flatnonzero(fresh)                              # nodes in preorder
    depth, path = level[at], np.repeat(np.arange(len(length)), length)[at]
    closes = np.concatenate([[0], np.cumsum(length[:-1] - lcp[1:])])
    opens = np.arange(len(at)) + closes[path]
    bits = np.zeros(2 * len(at), bool)
    bits[opens] = True
    p = Parentheses(bits)
    close = p.findclose(opens)
    below = (close - opens + 1) // 2
    leaves = p.pairs[close] - p.pairs[opens]
    worth = (-neg[at] - 1) * size[at]
    worth[:shared] = 0
    sums = np.concatenate([[0], np.cumsum(worth)])
    k = np.arange(len(at))
    saved = sums[k + below] - sums[k]
    order = np.lexsort((k, depth))
    key = depth[order] * len(at) + order
    up = order[np.maximum(np.searchsorted(key, (depth - 1) * len(at) + k) - 1, 0)]
    children = np.bincount(up[depth > 0], minlength=len(at)).astype(np.int64)
    children[:max(shared - 1, 0)] -= 1
    return m[at], -neg[at], np.where(depth > 0, m[at][up], -1), depth == 0, leaves, saved, children


def _shards(batches):
    from pyspark import TaskContext
    task = TaskContext.get().partitionId()
    none = pa.nulls(1, pa.list_(pa.struct([("neg", pa.int64()), ("m", pa.int64()), ("bytes", pa.int64())])))
    last = None

    def edge(side, path):
        one = [pa.array([0], pa.int64())] * 6
        return pa.RecordBatch.from_arrays([*one, pa.array([task], pa.int32()), pa.array([side], pa.int32()), path],
                                          names=["conv_id", "n", "parent", "leaves", "saved", "children", "task", "side", "path"])

    for b in batches:
        col = b.column(0)
        lo = 0
        while lo < len(col):
            whole = col.offsets.to_numpy().astype(np.int64)
            hi = int(np.searchsorted(whole, whole[lo] + SHARD, "right")) - 1
            hi = min(max(hi, lo + 1), len(col))
            off = whole[lo:hi + 1] - whole[lo]
            neg, m, size = (col.values.field(i).to_numpy()[whole[lo]:whole[hi]] for i in range(3))
            shared = 0
            if last is None:
                yield edge(1, col.slice(lo, 1))
            else:
                both = [np.concatenate([x, y[:off[1]]]) for x, y in zip(last, (neg, m))]
                shared = int(common(np.array([0, len(last[0]), len(both[0])]), *both)[1])
            out = shard(off, neg, m, size, shared)
            n = len(out[0])
            parent = pa.array(out[2], mask=out[3])
            side = pa.array(np.zeros(n, np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out[0]), pa.array(out[1]), parent, *(pa.array(x) for x in out[4:]),
                 pa.array(np.full(n, task, np.int32)), side, none.take(pa.array(np.zeros(n, np.int32)))],
                names=["conv_id", "n", "parent", "leaves", "saved", "children", "task", "side", "path"])
            last = (neg[off[-2]:].copy(), m[off[-2]:].copy())
            end = col.slice(hi - 1, 1)
            lo = hi
    if last is not None:
        yield edge(2, pa.array(end.to_pylist(), none.type))


def chains(paths: DataFrame) -> DataFrame:
    """``(conv_id, n, parent, leaves, saved, children)`` of every chain, from
    the leaf paths."""
    ranged = paths.repartitionByRange("path").sortWithinPartitions("path").select("path")
    got = materialize(ranged.mapInArrow(_shards, "conv_id long, n long, parent long, leaves long, saved long, "
                                        f"children long, task int, side int, path {PATH}"), "trie-shards")
    # between tasks: one row per task
    ends = got.filter("side > 0").groupBy("task").agg(
        F.max_by("path", F.when(F.col("side") == 1, 1).otherwise(0)).alias("first"),
        F.max_by("path", F.when(F.col("side") == 2, 1).otherwise(0)).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("task"))).filter(F.col("before").isNotNull())
    level = lambda c: ends.select("task", F.posexplode(c).alias("l", "x")).select("task", "l", "x.*")
    same = level("first").join(level("before").select("task", "l", "neg", "m"), ["task", "l", "neg", "m"])
    deeper = Window.partitionBy("task").orderBy(F.col("l").desc()).rowsBetween(Window.unboundedPreceding, 0)
    twice = same.select(
        F.col("m").alias("conv_id"), (-F.col("neg")).alias("n"), F.lit(None).cast("long").alias("parent"),
        F.lit(0).cast("long").alias("leaves"), (-F.sum((-F.col("neg") - 1) * F.col("bytes")).over(deeper)).alias("saved"),
        F.when(F.row_number().over(Window.partitionBy("task").orderBy(F.col("l").desc())) == 1, 0).otherwise(-1)
        .cast("long").alias("children"))
    return (got.filter("side = 0").select("conv_id", "n", "parent", "leaves", "saved", "children").unionByName(twice)
            .groupBy("conv_id", "n").agg(F.max("parent").alias("parent"), F.sum("leaves").alias("leaves"),
                                         F.sum("saved").alias("saved"), F.sum("children").alias("children")))


# --- the ids that end at a node --------------------------------------------

def _changes(cols) -> np.ndarray:
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _pieces(batches):
    seq = 0
    for b in batches:
        if not len(b):
            continue
        depth, f1, f2, chunk = (b.column(i).to_numpy() for i in (0, 1, 2, 4))
        ids = b.column(3).to_pylist()
        lo = _changes([depth, f1, f2])
        hi = [*lo[1:].tolist(), len(ids)]
        text = [",".join(map(str, ids[x:y])) for x, y in zip(lo.tolist(), hi)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(depth[lo]), pa.array(f1[lo]), pa.array(f2[lo]), pa.array(chunk[lo]),
             pa.array(np.arange(seq, seq + len(lo))), pa.array(text)], names=["depth", "f1", "f2", "chunk", "seq", "piece"])
        seq += len(lo)


def _digests(batches):
    now, sha, out = None, None, []
    flush = lambda: pa.RecordBatch.from_arrays(
        [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.string()))],
        names=["depth", "f1", "f2", "ends_sha256"])
    for b in batches:
        for *node, _, _, piece in zip(*(c.to_pylist() for c in b.columns)):
            if node == now:
                sha.update(b"," + piece.encode())
                continue
            if now:
                out.append((*now, sha.hexdigest()))
            now, sha = node, hashlib.sha256(piece.encode())
        if len(out) > 10_000:
            yield flush()
            out.clear()
    if now:
        out.append((*now, sha.hexdigest()))
        yield flush()


def ends(members: DataFrame) -> DataFrame:
    """``(depth, f1, f2, ends_sha256)`` from rows ``(depth, f1, f2, conv_id)``."""
    keys = ["depth", "f1", "f2", "conv_id"]
    pieces = (members.repartitionByRange(*keys).sortWithinPartitions(*keys)
              .select(*keys, F.spark_partition_id().alias("chunk"))
              .mapInArrow(_pieces, "depth long, f1 long, f2 long, chunk int, seq long, piece string"))
    node = ["depth", "f1", "f2"]
    return (pieces.repartition(*node).sortWithinPartitions(*node, "chunk", "seq")
            .mapInArrow(_digests, "depth long, f1 long, f2 long, ends_sha256 string"))


def prefix_trie(df: DataFrame, rebuild: bool = False) -> DataFrame:
    """One row per node (``NODE``) of the conversations ``(conv_id, turn,
    role, text)``; ``rebuild``: of the conversations that ``rebuilt`` makes."""
    spark = df.sparkSession
    turns, convs = numbered(df)
    turns, convs = (rebuilt if rebuild else as_they_are)(turns, convs)
    root = convs.agg(F.count(F.lit(1)), F.min("conv_id"), F.count(F.when(F.col("len") == 0, 1))).first()
    if not root[0]:
        return spark.createDataFrame([], NODE)
    steps = materialize(prefixes(turns), "trie-steps")
    zero = F.lit(0).cast("long")
    nodes = (steps.groupBy(F.col("pos").alias("depth"), "f1", "f2")
             .agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"), F.min("bytes").alias("bytes"),
                  F.min("cum").alias("cum"), F.sum(F.col("last").cast("long")).alias("ends")))
    top = spark.createDataFrame([(0, 0, 0, root[0], root[1], 0, 0, root[2])],
                                "depth long, f1 long, f2 long, n long, conv_id long, bytes long, cum long, ends long")
    nodes = materialize(nodes.unionByName(top), "trie-nodes")
    chain = nodes.groupBy("conv_id", "n").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"),
        F.min(F.col("cum") - F.col("bytes")).alias("above"), F.sum("ends").alias("ends"))
    chain = materialize(chain, "trie-chains")
    leaf = chain.filter("ends = n").select("conv_id")
    # the chains on the path of every leaf
    many = nodes.filter("n > 1").select(F.col("depth").alias("pos"), "f1", "f2", "n", F.col("conv_id").alias("m"))
    on = (steps.join(leaf, "conv_id", "left_semi").join(many, ["pos", "f1", "f2"], "left")
          .select("conv_id", (-F.coalesce("n", F.lit(1))).cast("long").alias("neg"),
                  F.coalesce("m", "conv_id").alias("m"), "bytes"))
    on = on.unionByName(leaf.select("conv_id", F.lit(-root[0]).cast("long").alias("neg"),
                                    F.lit(root[1]).cast("long").alias("m"), zero.alias("bytes")))
    paths = (on.groupBy("conv_id", "neg", "m").agg(F.sum("bytes").alias("bytes")).groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("neg", "m", "bytes"))).alias("path")))
    known = chains(materialize(paths.select("path"), "trie-paths")).join(chain.drop("ends"), ["conv_id", "n"])
    members = steps.filter("last").select(F.col("pos").alias("depth"), "f1", "f2", "conv_id").unionByName(
        convs.filter("len = 0").select(zero.alias("depth"), zero.alias("f1"), zero.alias("f2"), "conv_id"))
    out = nodes.join(known, ["conv_id", "n"]).join(ends(materialize(members, "trie-members")), ["depth", "f1", "f2"], "left")
    inside = F.col("depth") > F.col("top")
    return out.select(
        "conv_id", "depth", F.when(inside, F.col("conv_id")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("bottom"), F.lit(1)).otherwise(F.col("children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("saved") - (F.col("n") - 1) * (F.col("cum") - F.col("bytes") - F.col("above"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir):
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), rebuild=True)


OP11_SQL = """WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) r(i))),
o AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT c, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, r, x) AS t FROM o GROUP BY c),
hc AS (SELECT c, t, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))),
  lambda a, b: xor(a >> 8, z[1 + (xor(a, b) & 255)])), 4294967295) % 9 AS h FROM l, (SELECT t AS z FROM tab)),
p AS (SELECT hc.c, list_concat(coalesce(list_slice(b.t, 1, h), []), list_slice(hc.t, h + 1, len(hc.t))) AS t
  FROM hc LEFT JOIN l b ON b.c = hc.c - hc.c % 5),
s AS (SELECT c, d, list_slice(t, 1, d) AS k, len(t) = d AS e FROM (SELECT c, t, unnest(range(0, len(t) + 1)) AS d FROM p)),
g AS (SELECT k, d, min(c) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN e THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '') AS ids
  FROM s GROUP BY k, d),
ch AS (SELECT list_slice(k, 1, d - 1) AS k, d - 1 AS d, count(*) AS n_children FROM g WHERE d > 0 GROUP BY 1, 2),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children, CASE WHEN g.d > 0 THEN (n - 1) * octet_length(encode(g.k[g.d].x)) ELSE 0 END AS v
  FROM g LEFT JOIN ch ON ch.d = g.d AND ch.k = g.k),
sub AS (SELECT list_slice(k, 1, a) AS k, a AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(v) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM w) GROUP BY 1, 2)
SELECT w.conv_id, CAST(w.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, CAST(w.n AS BIGINT) AS n_convs,
  CAST(w.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(w.ids) AS ends_sha256
FROM w JOIN sub ON sub.d = w.d AND sub.k = w.k LEFT JOIN g up ON up.d = w.d - 1 AND up.k = list_slice(w.k, 1, w.d - 1)"""
