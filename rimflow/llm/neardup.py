"""Near-duplicate groups by HyperMinHash sketches.

A document's set holds its distinct shingles of `words` words (five; the query op8 is bound to two), each as a 64-bit hash. The hash space is split
into REGISTERS buckets; a bucket's register is what HyperMinHash keeps of the smallest hash in it: the
count of leading zeros (6 bits) and the MANTISSA bits after the first one. Empty buckets borrow the
register of a bucket picked by a fixed hash sequence, so that small sets can be banded too.

1. Documents with the same set are one class (key: 128 bits over the sorted set); the rest works on classes.
2. Bands of ROWS registers are bucketed. In each bucket every class is compared with the bucket's hub (its
   smallest id): first by sizes, then by the collision-corrected Jaccard estimate of the registers, and
   what remains is confirmed on the full sets. Links give components.
3. A bucket whose classes all lie in one component is settled. In the others the classes of different
   components are compared on the registers alone, in blocks of BLOCK classes and inside a task, which emits
   no more than one pair for each component that it joins: links, hub pairs and these give soft clusters.
   Two classes that share a bucket and whose estimate allows a link are in the same soft cluster.
4. In a soft cluster of more than one component, the classes outside the largest component are compared on the
   full sets with all others, in pairs of blocks (products of 0/1 matrices); again a task emits only
   the links that join components.

So dense groups never emit their pairs, hot buckets are split into blocks, and no pair that shares a
bucket and could join two components goes untested. Two sets at the threshold share no bucket with
probability (1 - 0.8 ** ROWS) ** BANDS, about 1e-7.

Defined results: null, empty and white-space texts have an empty set and are linked with nothing;
fewer words than a shingle has are one shingle; texts of any length are shingled whole, in the memory of one text and its set;
repeated doc_ids give one row for each input row, in the same component (different texts under one doc_id are one node,
confirmed by one of them); doc_ids are cast to long: one that is no number counts as null; rows
without a doc_id belong to the group of the documents with the same set, are not kept where there are such, and
form no group with others; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ROW_KEY, keyed_filter, stored, table, with_row_key
from .texthash import mix, word_hashes

REGISTERS = 200
ROWS = 5
BANDS = REGISTERS // ROWS
MANTISSA = 10
#: How far below the threshold an estimate may lie (about five standard deviations) before a pair is dropped.
MARGIN = 0.16
#: Classes of one side that are compared at once: on registers, on full sets.
BLOCK = 2048
BLOCK_SETS = 512
#: Hashes of the full sets of one side that are in memory at once: long documents make smaller blocks.
BLOCK_HASHES = 1 << 22
WORDS = 5

#: Where an empty bucket looks for a register, step by step. In a set of few hashes the share of a bucket among the
#: registers must stay even, so the sequence is long enough to end in a filled one whatever the size of the set.
STEPS = 2048
_STEP = (mix(np.arange(1, REGISTERS * STEPS + 1, dtype=np.uint64)).reshape(STEPS, REGISTERS) % np.uint64(REGISTERS)).astype(np.intp)
_SHIFT = np.uint64(32)


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles of a whole text (A-Z in lower case)."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    words = word_hashes(raw)
    if not len(words):
        return words
    if len(words) < k:
        k = len(words)
    h = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : len(words) - k + 1 + i])
    return np.unique(h)


def registers(hashes: np.ndarray) -> np.ndarray:
    """The densified HyperMinHash registers (uint16) of a set of at least one hash."""
    bucket = ((hashes >> _SHIFT) * np.uint64(REGISTERS)) >> _SHIFT
    rest = mix(hashes ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    low = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    # hashes are sorted, so equal buckets are neighbours
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    low[bucket[first].astype(np.intp)] = np.minimum.reduceat(rest, first)
    full = np.zeros(REGISTERS, bool)
    full[bucket[first].astype(np.intp)] = True
    top = (low >> np.uint64(11)).astype(np.float64)  # 53 bits, exact
    exponent = np.frexp(top)[1]
    zeros = np.minimum(53 - exponent, 63)
    shift = np.maximum(64 - 1 - zeros - MANTISSA, 0).astype(np.uint64)
    mantissa = (low >> shift) & np.uint64((1 << MANTISSA) - 1)
    out = ((zeros.astype(np.uint16) << np.uint16(MANTISSA)) | mantissa.astype(np.uint16)).astype(np.uint16)
    todo = np.flatnonzero(~full)
    for step in _STEP[:64]:
        if not len(todo):
            break
        at = step[todo]
        ok = full[at]
        out[todo[ok]] = out[at[ok]]
        todo = todo[~ok]
    if len(todo):  # a small set: the other steps at once
        at = _STEP[64:, todo]
        at = at[full[at].argmax(axis=0), np.arange(len(todo))]
        out[todo] = out[np.where(full[at], at, int(bucket[first[0]]))]
    return out


def estimate(equal: np.ndarray | float) -> np.ndarray | float:
    """Jaccard estimate from the share of equal registers, corrected for chance collisions.

    Two independent minima share their leading-zero count with probability 1/3 and then the mantissa
    with 2**-MANTISSA.
    """
    chance = 2.0**-MANTISSA / 3
    return (equal - chance) / (1 - chance)


def _sketch(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, fp, regs = [], [], []
            for x in batch.column(batch.num_columns - 1):
                s = shingles(x.as_py(), words)
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                regs.append(registers(s).tobytes() if len(s) else None)
            made = [pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(regs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], [*batch.schema.names[:-1], "n_shingles", "class_key", "regs"])

    return run


def sketch_table(docs: DataFrame, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, "text")
    kept = T.StructType([f for f in narrow.schema.fields if f.name != "text"])
    made = [T.StructField("n_shingles", T.LongType()), T.StructField("class_key", T.BinaryType()), T.StructField("regs", T.BinaryType())]
    return narrow.mapInArrow(_sketch(words), T.StructType(kept.fields + made))


def _bands(classes: DataFrame) -> DataFrame:
    """key, id, n: one row for each class and band."""
    keys = F.array(*[F.xxhash64(F.lit(i), F.substring("regs", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)])
    return classes.select(F.explode(keys).alias("key"), "id", "n")


def _sizes_fit(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _estimated(floor: float):
    """Keeps the pairs whose registers' estimate is at least floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            b = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint16).reshape(-1, REGISTERS)
            ok = estimate((a == b).mean(axis=1)) >= floor
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok))

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shingles(x.as_py(), words).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.binary())], ["id", "hashes"])

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                ok.append(100 * both >= percent * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _set_table(ids: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """id, hashes: the full sets of the documents with these doc_ids."""
    ids = stored(ids, "verify_ids")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(keyed_filter(narrow, ids, "doc_id", "left_semi").mapInArrow(_sets(words), "id long, hashes binary").dropDuplicates(["id"]), "sets")


def _links(pairs: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """The pairs (a, b) of class ids that the full sets confirm."""
    sets = _set_table(pairs.selectExpr("explode(array(a, b)) as doc_id").distinct(), docs, words)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(
        sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b"
    )
    return stored(both.select("a", "b", "ha", "hb").mapInArrow(_confirmed(percent), "a long, b long"), "links")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """id, comp: the smallest id reachable, for every id of the undirected links (a, b).

    Alternates two steps until nothing changes: every node sends its larger neighbours to its smallest
    neighbour, then every node sends its smaller neighbours to the smallest of them. Each step is a grouped
    minimum and an equi-join; the result of a round is stored. Nothing is collected but one checksum.
    The minima are stored too: a join of stored tables is one whose hot keys the adaptive planner splits.
    """
    edges = stored(links.selectExpr("greatest(a, b) as u", "least(a, b) as v").where("u <> v").distinct(), "edges")
    last = None
    for _ in range(max_rounds):
        both = edges.union(edges.selectExpr("v as u", "u as v"))
        low = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = stored(both.where("v > u").join(low, "u").selectExpr("v as u", "m as v").where("u <> v").distinct(), "large")
        low2 = stored(large.groupBy("u").agg(F.min("v").alias("m")), "low2")
        small = large.join(low2, "u").selectExpr("explode(array(struct(u, m as v), struct(v as u, m as v))) as e").select("e.*")
        edges = stored(small.where("u <> v").distinct(), "edges")
        state = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("comp")).selectExpr("u as id", "comp").union(
        edges.selectExpr("v as id", "v as comp").distinct()
    )


def _joined_up(comp: np.ndarray, ids: np.ndarray, x: int, others: np.ndarray, out: list[tuple[int, int]]) -> None:
    """Records one pair for each component among others that is not yet x's, and gives it x's label."""
    for y in others:
        if comp[y] != comp[x]:
            out.append((int(min(ids[x], ids[y])), int(max(ids[x], ids[y]))))
            comp[comp == comp[y]] = comp[x]


def _likely(rows: list, floor: float, percent: int, out: list[tuple[int, int]]) -> None:
    """Pairs that join the components which estimates connect within one group of (side, id, n, comp, regs)."""
    side = np.array([r[0] for r in rows])
    i, j = np.flatnonzero(side != 2), np.flatnonzero(side != 1)  # 0: one block with itself
    regs = np.frombuffer(b"".join(r[4] for r in rows), np.uint16).reshape(-1, REGISTERS)
    ids, n, comp = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
    for x in i:
        c = j[comp[j] != comp[x]]
        c = c[100 * np.minimum(n[c], n[x]) >= percent * np.maximum(n[c], n[x])]
        if len(c):
            _joined_up(comp, ids, x, c[estimate((regs[c] == regs[x]).mean(axis=1)) >= floor], out)


#: So many hashes are compared at once; more are taken in parts.
AT_ONCE = 1 << 21


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of each set of a with each of b, as products of 0/1 matrices."""
    both = a + b
    out = np.zeros((len(a), len(b)), np.float32)
    value = np.concatenate(both)
    doc = np.repeat(np.arange(len(both)), [len(s) for s in both])
    order = np.argsort(value, kind="stable")
    value, doc = value[order], doc[order]
    first = np.r_[True, value[1:] != value[:-1]]
    column = np.cumsum(first) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    doc, column = doc[keep], (np.cumsum(often) - 1)[column[keep]]
    width = 4096
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, [at, at + width])
        m = np.zeros((len(both), width), np.float32)
        m[doc[lo:hi], column[lo:hi] - at] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _linked(rows: list, floor: float, percent: int, out: list[tuple[int, int]]) -> None:
    """Pairs that join the components which links connect within one group of (side, id, n, comp, hashes)."""
    side = np.array([r[0] for r in rows])
    ids, n, comp = (np.array([r[k] for r in rows], np.int64) for k in (1, 2, 3))
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]

    def parts(at: np.ndarray) -> list[np.ndarray]:
        return np.split(at, np.flatnonzero(np.diff(np.cumsum(n[at]) // AT_ONCE)) + 1) if len(at) else []

    for i in parts(np.flatnonzero(side != 2)):
        for j in parts(np.flatnonzero(side != 1)):
            both = _common([sets[k] for k in i], [sets[k] for k in j])
            link = 100 * both >= percent * (n[i][:, None] + n[j][None, :] - both)
            for x, row in zip(i, link, strict=True):
                _joined_up(comp, ids, x, j[row], out)


def _grouped(handle, floor: float, percent: int):
    """Input sorted by its first two columns: handle gets the rest of the rows of each group."""

    def made(out: list[tuple[int, int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, rows, out = None, [], []
        for batch in batches:
            for key, pair, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if (key, pair) != at:
                    if rows:
                        handle(rows, floor, percent, out)
                    at, rows = (key, pair), []
                rows.append(row)
            yield made(out)
            out = []
        if rows:
            handle(rows, floor, percent, out)
        yield made(out)

    return run


def _pairs_of_blocks(member: DataFrame, block: int, hashes: int = 1 << 62) -> DataFrame:
    """key, pair, side, id, n, comp: who is to be compared with whom within each key.

    Of a key's members (key, id, n, comp) those outside its largest component are compared with each other (side 0
    in a block, else 1 and 2) and with the members of the largest, in blocks of about `block` members
    and `hashes` hashes at most. Keys of one component are settled.
    """
    # so many blocks are c members worth
    sizes = member.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("h"))
    main = sizes.groupBy("key").agg(F.max(F.struct("c", "comp", "h")).alias("top"), F.sum("c").alias("m"), F.sum("h").alias("h")).where("m > top.c")
    blocks = lambda c, h: f"cast(greatest(ceil(({c}) / {block}), ceil(({h}) / {hashes})) as int)"
    main = stored(main.selectExpr("key", "top.comp as main", f"{blocks('top.c', 'top.h')} as n_main", f"{blocks('m - top.c', 'h - top.h')} as n_rest"), "main")
    member = member.join(main, "key")
    n = {k: f"n_{k}" for k in ("rest", "main")}
    place = {k: f"cast(pmod(xxhash64(id), {v}) as int)" for k, v in n.items()}
    dealt = member.selectExpr(
        "key", "id", "n", "comp", "comp <> main as rest",
        f"if(comp <> main, {place['rest']}, {place['main']}) as own",
        # a member outside meets all blocks outside and, numbered after them, all of the largest component
        f"explode(if(comp <> main, sequence(0, {n['rest']} + {n['main']} - 1), sequence(0, {n['rest']} - 1))) as other", f"{n['rest']} as n_blocks",
    )
    return dealt.selectExpr(
        "key",
        "case when not rest then concat_ws('x', other, own) when other >= n_blocks then concat_ws('x', own, other - n_blocks) "
        "else concat_ws('-', least(own, other), greatest(own, other)) end as pair",
        "case when not rest then 2 when other = own then 0 when other >= n_blocks or own < other then 1 else 2 end as side",
        "id", "n", "comp",
    )


def _by_group(rows: DataFrame) -> DataFrame:
    return rows.repartition("key", "pair").sortWithinPartitions("key", "pair")


def _across(soft: DataFrame, comp: DataFrame, classes: DataFrame, docs: DataFrame, percent: int, words: int) -> DataFrame:
    """Links between the components of each soft cluster (id, key), looked for on the full sets.

    The members outside the cluster's largest component are compared with each other and with those of the
    largest, block by block; of the links found in a block only those that join components are returned.
    """
    member = soft.join(comp, "id", "left").selectExpr("key", "id", "coalesce(comp, id) as comp")
    rows = stored(_pairs_of_blocks(member.join(classes.select("id", "n"), "id"), BLOCK_SETS, BLOCK_HASHES), "members")
    rows = rows.join(_set_table(rows.selectExpr("id as doc_id").distinct(), docs, words), "id")
    rows = _by_group(rows.select("key", "pair", "side", "id", "n", "comp", "hashes"))
    return rows.mapInArrow(_grouped(_linked, 0.0, percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 80, words: int = WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns named in keep, n_shingles and component_id of every row of docs; links are 100 * both >= percent * either."""
    floor = percent / 100 - MARGIN
    all_docs = stored(sketch_table(docs, words, keep), "sketches")
    classes = stored(
        all_docs.where("n_shingles > 0")
        .groupBy("class_key")
        .agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("regs").alias("regs"))
        .where("id is not null"),
        "classes",
    )
    banded = _bands(classes)
    # stored, so that the adaptive planner can split the hot buckets of the join
    hubs = stored(banded.groupBy("key").agg(F.min(F.struct("id", "n")).alias("hub"), F.count("*").alias("m")).where("m > 1"), "hubs")
    shared = stored(banded.join(hubs, "key").select("key", "id", "n", F.col("hub.id").alias("hub"), F.col("hub.n").alias("hub_n"), "m"), "shared")

    regs = classes.select("id", "regs")
    near_hub = shared.where("id <> hub and " + _sizes_fit("n", "hub_n", percent)).selectExpr("hub as a", "id as b").distinct()
    stars = near_hub.join(regs.selectExpr("id as a", "regs as ra"), "a").join(regs.selectExpr("id as b", "regs as rb"), "b")
    stars = stored(stars.select("a", "b", "ra", "rb").mapInArrow(_estimated(floor), "a long, b long"), "stars")
    links = _links(stars, docs, percent, words)
    comp = components(links)

    labelled = shared.where("m > 2").join(comp, "id", "left").selectExpr("key", "id", "n", "coalesce(comp, id) as comp")
    rest = _pairs_of_blocks(stored(labelled, "labelled"), BLOCK).join(regs, "id")
    rest = _by_group(rest.select("key", "pair", "side", "id", "n", "comp", "regs"))
    likely = stored(rest.mapInArrow(_grouped(_likely, floor, percent), "a long, b long").distinct(), "likely")
    if likely.limit(1).count():
        soft = components(links.union(stars).union(likely)).withColumnRenamed("comp", "key")
        comp = components(links.union(_across(soft, comp, classes, docs, percent, words)))

    rep = classes.select("class_key", "id").join(comp, "id", "left").select("class_key", F.coalesce("comp", "id").alias("component"))
    found = all_docs.select("doc_id", *keep, "n_shingles", "class_key").join(rep, "class_key", "left")
    return found.select("doc_id", *keep, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), words=2).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    return stored(found, "components")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The document with the smallest doc_id of each group of near duplicates (all its rows, if it occurs more than once); rows without a doc_id stay.

    Rows go by doc_id and text: another text under the doc_id of a copy stays.
    """
    keyed = with_row_key(docs, "doc_id", "text")
    gone = stored(near_duplicates(keyed, keep=tuple(ROW_KEY)).where("doc_id <> component_id").select(*ROW_KEY).distinct(), "near_copies")
    return keyed_filter(keyed, gone, ROW_KEY, "left_anti").drop(*ROW_KEY)
