"""Periodic runs of words: stretches in which the same few words come again and again.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that no neighbouring word extends,
of at least max(6, 4 q) words. So the positions i at which word i equals word i + q hold an interval of 3 q or more
places, and finding runs is finding these intervals for all q at once.

1. Periods are taken by octaves: P <= q < 2 P with P a power of two. For each octave a document is laid out in overlapping
   tiles of max(tile, 16 P) words, a quarter of which overlaps. A document that fits a tile whole has one tile for all those octaves.
2. A tile is solved by itself. Its boundaries lie P apart. At a boundary b the Z-function (how far the words from b on and
   those from b + q on agree) and its mirror image (how far those before b agree) bound the interval of each q that holds the P
   words from b on. Both are found for all boundaries and periods at once by doubling: windows of 2**l words have hashes
   that are mixed from those of their halves, a boundary and a period are looked at only where the windows of P words agree, and
   the extents are descended from long windows to short ones. Intervals of 2 P places and more are kept as fragments, cut
   off where the tile ends, so that two neighbouring tiles' fragments overlap. Fragments whose q is a multiple of a smaller
   period (by the hashes) are dropped; each other one is compared with the words themselves (and searched for plainly if a hash deceived).
3. Fragments are shuffled by document and period and stitched where they touch; the intervals that are long enough are the runs.

Tiles of documents that fit one are solved where they arise. Tiles of longer documents are dealt out to all tasks, so one very
long document is not one task's work. Fragments are few: a document of n words has less than n runs.

Defined results: a null or empty text has no words and no run; repeated rows, and rows with a null or repeated doc_id, each
give a row; doc_ids are cast to long; other columns are not read, so none clashes; an empty table gives an empty result. A text of
any length is held in the memory of one row when it is laid out; its largest tile takes about 200 bytes a word when it is solved.
"""

from __future__ import annotations

import functools
import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import job_settings, stored, table
from .texthash import mix

#: Words of the smallest tile.
TILE = 1 << 14
#: Words of short documents that are solved at once.
GROUP = 1 << 16
LEAST, TIMES = 6, 4
#: From here on numbers stand for the ends of documents.
ENDS = 1 << 40

Prepare = Callable[[int | None, list[bytes]], list[bytes]]


@functools.lru_cache(maxsize=100_000)
def _primes(q: int) -> tuple[int, ...]:
    """The prime divisors of q."""
    out, r = [], 2
    while r * r <= q:
        if q % r == 0:
            out.append(r)
            while q % r == 0:
                q //= r
        r += 1
    return tuple(out + [q] * (q > 1))


class _Windows:
    """Hashes of all windows of 2**l words, made when they are first asked for."""

    def __init__(self, ids: np.ndarray, longest: int):
        self.n, self.top = len(ids), max(longest, 1).bit_length() - 1
        self.made = [mix(ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))]

    def level(self, k: int) -> np.ndarray:
        while len(self.made) <= k:
            half, w = self.made[-1], 1 << (len(self.made) - 1)
            n = max(0, self.n - 2 * w + 1)
            self.made.append(mix(half[:n] * np.uint64(0xD6E8FEB86659FD93) + mix(half[w : w + n])))
        return self.made[k]

    def forward(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words from x on equal those from x + q on."""
        at = x.copy()
        for k in range(self.top, -1, -1):
            h = self.level(k)
            inside = at + q < len(h)
            i = np.where(inside, at, 0)
            j = np.where(inside, at + q, 0)
            at += np.where(inside & (h[i] == h[j]), 1 << k, 0) if len(h) else 0
        return at - x

    def backward(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words before x equal those before x + q."""
        at = x.copy()
        for k in range(self.top, -1, -1):
            h, w = self.level(k), 1 << k
            inside = (at >= w) & (at - w + q < len(h))
            i = np.where(inside, at - w, 0)
            j = np.where(inside, at - w + q, 0)
            at -= np.where(inside & (h[i] == h[j]), w, 0) if len(h) else 0
        return x - at


def _plainly(ids: np.ndarray, q: int, least: int) -> list[tuple[int, int, int]]:
    """The intervals of q by comparing words."""
    same = np.concatenate([[False], ids[:-q] == ids[q:], [False]])
    turns = np.flatnonzero(same[1:] != same[:-1]).reshape(-1, 2)
    return [(q, int(a), int(b)) for a, b in turns if b - a >= least]


def fragments(ids: np.ndarray, octaves: range, longest: int | None = None) -> list[tuple[int, int, int]]:
    """(q, a, b): word i equals word i + q for a <= i < b, maximal within ids, b - a at least twice the octave's P, q no multiple
    of a smaller period. longest bounds the words of a stretch (the longest document of several)."""
    out: list[tuple[int, int, int]] = []
    windows = _Windows(ids, longest or len(ids))
    for k in octaves:
        p = 1 << k
        h = windows.level(k)
        later = h[p:]
        if not len(later):
            break
        rows = -(-len(later) // p)
        match = np.zeros(rows * p, bool)
        np.equal(later, np.repeat(h[: rows * p : p], p)[: len(later)], out=match[: len(later)])
        if not match.any():
            continue
        match = match.reshape(rows, p)
        match[1:] &= ~match[:-1]  # neighbouring boundaries lie in one interval; & reads old rows, so a chain keeps its first one
        r, j = np.nonzero(match)
        b, q = r * p, p + j
        lo, hi = b - windows.backward(b, q), b + windows.forward(b, q)
        found = np.unique(np.stack([q, lo, hi])[:, hi - lo >= 2 * p], axis=1)
        out += _primitive(ids, windows, found, 2 * p)
    return out


def _primitive(ids: np.ndarray, windows: _Windows, found: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    if not found.shape[1]:
        return []
    q, lo, hi = found
    pairs = [(i, x // r) for i, x in enumerate(q.tolist()) for r in _primes(x)]
    keep = np.ones(len(q), bool)
    if pairs:
        i, d = np.array(pairs).T
        keep[i[windows.forward(lo[i], d) >= q[i] - d]] = False
    out, again = [], set()
    for x, a, b in zip(q[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), strict=True):
        left, right = a == 0 or ids[a - 1] != ids[a - 1 + x], b + x == len(ids) or ids[b] != ids[b + x]
        if left and right and np.array_equal(ids[a:b], ids[a + x : b + x]):
            out.append((x, a, b))
        else:
            again.add(x)
    return out + [f for x in again for f in _plainly(ids, x, least)]


def octaves_of(n: int) -> range:
    """The octaves in which a document of n words can have a run."""
    return range(max(0, (n // TIMES).bit_length())) if n >= LEAST else range(0)


def tiles_of(n: int, tile: int) -> Iterator[tuple[range, int, int]]:
    """Octaves, first word and end of the tiles of a document of n words."""
    rest = octaves_of(n)
    while rest:
        size = max(tile, 16 << rest[0])
        upto = rest[-1] + 1 if size >= n else min(rest[-1] + 1, size.bit_length() - 4)
        for at in range(0, max(1, n - size // 4), size - size // 4):
            yield range(rest[0], upto), at, min(n, at + size)
        rest = range(upto, rest[-1] + 1)


def _numbers(words: list[bytes], number: dict[bytes, int]) -> list[int]:
    return [number.setdefault(w, len(number)) for w in words]


COLUMNS = "kind int, key binary, doc_id long, n long, plain_sha256 string, words binary, first_octave int, last_octave int, q long, a long, b long, ids binary"
_ARROW = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
_DOC, _FRAGMENT, _TILE = range(3)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _ARROW, strict=True)], names)


def _solve_group(docs: list[tuple[bytes, list[bytes]]]) -> list[tuple[bytes, int, int, int]]:
    """Fragments of documents of about one length, laid one after another with a number of its own at each end."""
    number: dict[bytes, int] = {}
    ids, starts = [], []
    for k, (_, words) in enumerate(docs):
        starts.append(len(ids))
        ids += _numbers(words, number)
        ids.append(ENDS + k)
    longest = max(len(w) for _, w in docs)
    out, first = [], np.array(starts)
    for q, a, b in fragments(np.array(ids, np.int64), octaves_of(longest), longest):
        k = int(np.searchsorted(first, a, "right")) - 1
        out.append((docs[k][0], q, a - starts[k], b - starts[k]))
    return out


def _laid_out(tile: int, prepare: Prepare | None, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document, with its words if it may have runs (whole: in any case); fragments of documents of one tile; tiles of the others."""
        for batch in batches:
            docs, short, rows, busy = [], [], [], set()
            for doc_id, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
                words = prepare(doc_id, words) if prepare else words
                joined = b" ".join(words)
                key = hashlib.blake2b(f"{doc_id} ".encode() + joined, digest_size=16).digest()
                docs.append((key, doc_id, len(words), joined))
                if len(words) <= tile:
                    short.append((key, words))
                else:
                    ids = np.array(_numbers(words, {}), "<i4")
                    busy.add(key)
                    for octaves, at, end in tiles_of(len(words), tile):
                        rows.append((_TILE, key, None, None, None, None, octaves[0], octaves[-1], None, at, None, zstandard.compress(ids[at:end].tobytes(), 3)))
            short.sort(key=lambda x: len(x[1]))
            group: list[tuple[bytes, list[bytes]]] = []
            size = 0
            for k, (key, words) in enumerate(short):
                if len(words) >= LEAST:
                    group.append((key, words))
                    size += len(words) + 1
                if group and (size >= GROUP or k + 1 == len(short)):
                    for key_, q, a, b in _solve_group(group):
                        busy.add(key_)
                        rows.append((_FRAGMENT, key_, None, None, None, None, None, None, q, a, b, None))
                    group, size = [], 0
            for key, doc_id, n, joined in docs:
                words = zstandard.compress(joined, 3) if whole or key in busy else None
                rows.append((_DOC, key, doc_id, n, hashlib.sha256(joined).hexdigest(), words, None, None, None, None, None, None))
            yield _batch(rows)

    return run


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, lo, hi, at, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            ids = np.frombuffer(zstandard.decompress(raw), "<i4")
            found = [(key, q, a + at, b + at) for q, a, b in fragments(ids, range(lo, hi + 1))]
            cols = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), *[pa.int64()] * 3), strict=True)], ["key", "q", "a", "b"])


def stitched(found: DataFrame) -> DataFrame:
    """key, runs (start, length, period; by start, then period) of fragments (key, q, a, b)."""
    found = found.distinct()
    marked = found.selectExpr("*", "coalesce(a > max(b) over (partition by key, q order by a, b rows between unbounded preceding and 1 preceding), true) as opens")
    islands = marked.selectExpr("*", "sum(int(opens)) over (partition by key, q order by a, b rows unbounded preceding) as island")
    intervals = islands.groupBy("key", "q", "island").agg(F.min("a").alias("start"), (F.max("b") - F.min("a") + F.col("q")).alias("length"))
    runs = intervals.where(F.col("length") >= F.greatest(F.lit(LEAST), TIMES * F.col("q")))
    each = F.sort_array(F.collect_list(F.struct("start", F.col("q").alias("period"), "length")))
    return runs.groupBy("key").agg(F.transform(each, lambda r: F.struct(r["start"], r["length"], r["period"])).alias("runs"))


def _collapsed(want: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for plain, words, runs in zip(*[c.to_pylist() for c in batch.columns[2:]], strict=True):
                if words is None:
                    out.append(plain)
                    continue
                kept = zstandard.decompress(words)
                if runs:
                    each = kept.split(b" ")
                    drop = bytearray(len(each))
                    for r in runs:
                        a, b = r["start"] + r["period"], r["start"] + r["length"]
                        drop[a:b] = b"\1" * (b - a)
                    kept = b" ".join([w for w, d in zip(each, drop, strict=True) if not d])
                out.append(kept.decode("utf-8", "surrogatepass") if want == "collapsed" else hashlib.sha256(kept).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(out, pa.string())], ["doc_id", "n_words", "runs", want])

    return run


def periodic_runs(docs: DataFrame, want: str = "collapsed", prepare: Prepare | None = None, tile: int = TILE) -> DataFrame:
    """doc_id, n_words, runs (start, length, period of each, by start, then period) and what is wanted: collapsed (the words but for those that a
    run has after its first period, joined by a space) or collapsed_sha256. prepare(doc_id, words) gives the words to search."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    laid = stored(narrow.mapInArrow(_laid_out(tile, prepare, want == "collapsed"), COLUMNS), "tiles")
    tiles = laid.where(f"kind = {_TILE}").select("key", "first_octave", "last_octave", "a", "ids").repartition("key", "first_octave", "a")
    found = laid.where(f"kind = {_FRAGMENT}").select("key", "q", "a", "b").union(tiles.mapInArrow(_solved, "key binary, q long, a long, b long"))
    each = laid.where(f"kind = {_DOC}")
    runs = stitched(found)
    kind = runs.schema["runs"].dataType.simpleString()
    columns = ["doc_id", "n as n_words", "plain_sha256", "words", f"coalesce(runs, cast(array() as {kind})) as runs"]
    without = each.where("words is null").selectExpr(*columns[:-1], f"cast(array() as {kind}) as runs")
    with_words = each.where("words is not null").join(runs, "key", "left").selectExpr(*columns)
    return without.union(with_words).mapInArrow(_collapsed(want), f"doc_id long, n_words long, runs {kind}, {want} string")


def repeated_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of the query: of one document in ten the words from some place on become a repetition. Without a doc_id they stay."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), "collapsed_sha256", repeated_tail)
    # the greatest length / period, compared by multiplication; the first of equal ones, as runs come by start and period
    better = lambda best, r: F.when(best.isNull() | (r["length"] * best["period"] > best["length"] * r["period"]), r).otherwise(best)
    kind = found.schema["runs"].dataType.elementType.simpleString()
    best = found.withColumn("best", F.aggregate("runs", F.lit(None).cast(kind), better))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")])), "\n")
    text = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit(""))
    out = best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"),
        F.sha2(text.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
    with job_settings(found):
        return stored(out, "runs")
