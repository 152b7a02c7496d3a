"""Sharding by k-d tree partitioning.

Each document is a point of numeric metadata with its size in bytes as its weight. A node of the tree is split along
the dimension in which its points spread widest (relative to the spread of all points) at the weighted median, until
the leaves reach the target bytes; the leaves are the shards. A node for an odd number of leaves is split in that proportion.

The medians are found by distributed histograms: all nodes of a level at once, the range of each node is
cut into BINS intervals, their weights are summed, and the interval that holds the median is cut again until it weighs at
most TOLERANCE of a leaf or cannot be cut. To the driver come the histograms of the nodes of one level, whose
size is bounded by leaves * BINS, never rows; the tree is one expression. So a call makes MAX_LEAVES leaves at most, and more shards are
had by sharding each shard again.

Documents of equal text are a group and stay in one shard. Points are ordered within a dimension by (value, hash of the text), so
groups that weigh little are never cut by the tree. Those heavier than TOLERANCE of a leaf (at most leaves / TOLERANCE of them) are
placed before it: the heaviest first, each into the leaf that has most room, and the tree then fills what room the leaves have
left. Only a group that no leaf has room for is cut, by hashes of its doc_ids, and fills leaf after leaf; so no hot
group makes the shards uneven.

Defined results: null texts have size 1 and the crc of the empty text, and are a group with the empty texts; null metadata
is its own value; repeated rows (equal doc_id and text) each get a row and a slot, and are never parted; texts of any length are
measured whole; doc_ids are cast to long; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

BINS = 1024
TOLERANCE = 0.01
#: Rows numbered together when slots are given out.
SLOT_ROWS = 20_000
FILE_ROWS = 20_000
DIMS = ("d_size", "d_lang", "d_source", "d_doc")
_TIE = 1 << 20
MAX_LEAVES = 4096
#: A group that must be cut is cut at hashes of its doc_ids.
CUTS = 1 << 20


def heavy_places(weights: list[tuple], total: int, leaves: int) -> tuple[list[list[tuple]], list[int]]:
    """For each of the groups (weight, key), heaviest first: its leaves as (leaf, upper bound of the hashes that go there); and the room left in each leaf.

    A group goes whole into the leaf with most room if it fits there, over by TOLERANCE at most; otherwise it is cut and fills leaves in that order.
    """
    leaf = total / leaves
    room = [leaf] * leaves
    heap = [(-leaf, k) for k in range(leaves)]
    out = []
    for weight, *_ in weights:
        places, left = [], weight
        while True:
            spare, k = -heap[0][0], heap[0][1]
            if left <= spare + TOLERANCE * leaf or len(places) == leaves - 1:
                places.append((k, CUTS))
                heapq.heapreplace(heap, (-(spare - left), k))
                room[k] = spare - left
                break
            places.append((k, round(CUTS * (weight - left + spare) / weight)))
            left -= spare
            heapq.heapreplace(heap, (0.0, k))
            room[k] = 0.0
        out.append(places)
    return out, [max(0.0, r) for r in room]


def points(docs: DataFrame, leaf_bytes: float | None, leaves: int | None) -> tuple[DataFrame, DataFrame, list[float]]:
    """The light documents (doc_id, size, text_crc32, the dimensions), the heavy ones (doc_id, size, text_crc32, shard), and the room that is left in each leaf."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(text).alias("a"), F.crc32(text.cast("binary")).alias("b"), F.octet_length(text).alias("n")).alias("group"),
        # order-preserving for short codes; other values are told apart by a hash
        *[F.pmod(F.xxhash64(F.coalesce(c, F.lit("\0"))), F.lit(1 << 20)).alias(f"d_{c}") for c in ("lang", "source")],
    )
    rows = stored(rows, "documents")
    groups = rows.groupBy("group").agg(
        F.sum("size").alias("weight"), F.min(F.struct("doc_id", "d_lang", "d_source")).alias("first"), F.max("size").alias("d_size"), F.count("*").alias("n")
    )
    groups = stored(groups, "groups")
    total, n_rows = (x or 0 for x in groups.agg(F.sum("weight"), F.sum("n")).first())
    n = leaves or max(1, math.ceil(total / leaf_bytes))
    if n > MAX_LEAVES:
        raise ValueError(f"{n} leaves: at most {MAX_LEAVES} are made at once; shard coarsely first and each shard again")
    heavy = groups.where(F.col("n") > 1).where(F.col("weight") > TOLERANCE * total / n)
    found = sorted(((r["weight"], tuple(r["group"])) for r in heavy.select("weight", "group").collect()), reverse=True)  # at most n / TOLERANCE
    places, room = heavy_places(found, total, n)
    spark = docs.sparkSession
    table_ = spark.createDataFrame([(*key, p) for (_, key), p in zip(found, places, strict=True)], "a long, b long, n int, places array<struct<shard: int, upto: long>>")
    keyed = rows.withColumns({"a": F.col("group.a"), "b": F.col("group.b"), "n": F.col("group.n")}).join(F.broadcast(table_), ["a", "b", "n"], "left")
    at = F.pmod(F.xxhash64("doc_id"), F.lit(CUTS))
    shard = F.get(F.filter("places", lambda p: p["upto"] > at), 0)["shard"]
    placed = stored(keyed.select("doc_id", "size", "text_crc32", "group", shard.alias("shard")), "placed") if found else rows.withColumn("shard", F.lit(None).cast("int"))
    dims = groups.select("group", "d_size", "first.d_lang", "first.d_source", F.col("first.doc_id").alias("d_doc"))
    joined = placed.where("shard is null").select("doc_id", "size", "text_crc32", "group").join(dims, "group")
    tie = F.pmod(F.xxhash64("group"), F.lit(_TIE))
    keys = [(F.coalesce(d, F.lit(0)) * _TIE + tie).alias(d) for d in DIMS]
    # the table is read some twenty times: no more files than its rows are worth
    light = stored(joined.select("doc_id", "size", "text_crc32", *keys).coalesce(1 + n_rows // FILE_ROWS), "points")
    return light, placed.where("shard is not null").select("doc_id", "size", "text_crc32", "shard"), room


class Node:
    def __init__(self, first: int, room: list[float]):
        self.first, self.room, self.dim, self.cut, self.low, self.high = first, room, None, None, None, None

    @property
    def leaves(self) -> int:
        return len(self.room)

    def expression(self, depth: int = 0) -> str:
        """The shard of a point as nested conditions; a level of the tree is one comparison."""
        if self.low is None:
            return str(self.first)
        return f"if({self.dim} < {self.cut}L, {self.low.expression()}, {self.high.expression()})"


def _split_level(pts: DataFrame, root: Node, nodes: list[Node], spread: dict[str, int], leaf_weight: float) -> list[Node]:
    """Splits nodes (all of one level, each with two leaves or more) and returns their children."""
    at = F.expr(root.expression())
    asked = pts.withColumn("node", at).where(F.col("node").isin([n.first for n in nodes]))
    ranges = {r["node"]: r for r in asked.groupBy("node").agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).collect()}
    search = {}
    for n in nodes:
        r = ranges.get(n.first)
        if r is None:  # no points: any cut does
            n.dim, n.cut = DIMS[0], 0
            continue
        n.dim = max(DIMS, key=lambda d: ((r[f"hi_{d}"] - r[f"lo_{d}"]) / max(1, spread[d]), -DIMS.index(d)))
        low, all_ = sum(n.room[: n.leaves // 2]), sum(n.room)
        want = r["w"] * (low / all_ if all_ else (n.leaves // 2) / n.leaves)
        search[n] = [r[f"lo_{n.dim}"], r[f"hi_{n.dim}"] + 1, want]  # the cut is in (lo, hi], and `want` of the weight from lo on is below it
    while search:
        cases = " ".join(f"when {n.first} then if({n.dim} >= {lo}L and {n.dim} < {hi}L, ({n.dim} - {lo}L) div {-(-(hi - lo) // BINS)}L, null)" for n, (lo, hi, _) in search.items())
        binned = asked.withColumn("bin", F.expr(f"case node {cases} end")).where("bin is not null")
        found: dict[int, dict[int, int]] = {}
        for r in binned.groupBy("node", "bin").agg(F.sum("size").alias("w")).collect():
            found.setdefault(r["node"], {})[r["bin"]] = r["w"]
        for n, (lo, hi, want) in list(search.items()):
            width, below = -(-(hi - lo) // BINS), 0
            bins = sorted(found[n.first].items())
            for b, w in bins:
                if below + w >= want or b == bins[-1][0]:
                    break
                below += w
            if width == 1 or w <= TOLERANCE * leaf_weight:
                # the border that comes closer to what is wanted
                n.cut = lo + (b + (want - below > below + w - want)) * width
                del search[n]
            else:
                search[n] = [lo + b * width, min(hi, lo + (b + 1) * width), want - below]
    for n in nodes:
        half = n.leaves // 2
        n.low, n.high = Node(n.first, n.room[:half]), Node(n.first + half, n.room[half:])
    return [c for n in nodes for c in (n.low, n.high)]


def kd_tree(pts: DataFrame, room: list[float]) -> Node:
    """The tree over points, whose leaves get weight in proportion to their room."""
    root = Node(0, room)
    r = pts.agg(F.sum("size").alias("w"), *[f(d).alias(f"{k}_{d}") for d in DIMS for k, f in (("lo", F.min), ("hi", F.max))]).first()
    spread = {d: (r[f"hi_{d}"] or 0) - (r[f"lo_{d}"] or 0) for d in DIMS}
    level = [root]
    while level := [x for x in level if x.leaves > 1]:
        level = _split_level(pts, root, level, spread, (r["w"] or 0) / len(room))
    return root


def kd_shards(docs: DataFrame, leaf_bytes: float | None = None, leaves: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in each shard) of every row of docs."""
    light, heavy, room = points(docs, leaf_bytes, leaves)
    root = kd_tree(light, room)
    return _with_slots(light.select("doc_id", "size", "text_crc32", F.expr(root.expression()).cast("int").alias("shard")).unionByName(heavy))


def _with_slots(sharded: DataFrame) -> DataFrame:
    """Numbers the rows of each shard without bringing a shard into one task: buckets of about SLOT_ROWS rows are
    numbered by themselves, after the rows of the shard's earlier buckets."""
    rows = sharded.count()
    buckets = max(1, -(-rows // SLOT_ROWS))
    dealt = stored(sharded.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets))), "sharded")
    before = dealt.groupBy("shard", "bucket").count().selectExpr(
        "shard", "bucket", "coalesce(sum(count) over (partition by shard order by bucket rows between unbounded preceding and 1 preceding), 0) as before"
    )
    numbered = dealt.selectExpr("*", "row_number() over (partition by shard, bucket order by doc_id) - 1 as place")
    return numbered.join(before, ["shard", "bucket"]).selectExpr("doc_id", "size", "text_crc32", "shard", "before + place as slot")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards(table(spark, sf_dir, "documents"), leaves=16)
    return stored(placed.selectExpr("doc_id", "size", "text_crc32", "'bytes' as law", "shard", "cast(slot as bigint) as slot", "cast(null as int) as grown_shard"), "shards")
