"""How the tokens of two tokenizers lie over one another, and how often each pair of tokens meets in the corpus.

A text's bytes are cut by a byte-level tokenizer (A) and by a sentencepiece model (B). Where tokens of both end, a group ends;
the tokens of A and of B in one group are linked. The count of a pair of ids is the number of documents that link it.

1. Documents are encoded once, in chunks of about CHUNK bytes. A chunk is stored as its documents' ids and, for each of
   SHARDS shards of A's ids (id mod SHARDS), as the sorted distinct pairs that it links with their numbers of documents.
2. The distinct pairs of a shard are united by a tree of FAN chunks or unions to one, and get a minimal perfect hash: bit arrays
   in levels, in which a pair stands at the first level where it has a place for itself, and the ranks of the set
   bits. The pairs are stored in the order of their hashes, so that every look-up is verified.
3. Chunks add their numbers to dense vectors that are indexed by the hash, a vector for each shard and some
   PER_GROUP numbers of its chunks; the vectors are summed by the same tree. As all pairs of an id of A are in one shard, its highest
   count is found there.
4. Chunks send their distinct pairs to the shards' vectors and get counts back; documents are aligned again from their stored
   ids and look their links up.

What is bounded and by what: a shard has at most (ids of A / SHARDS + 1) * ids of B pairs, 6.3 million here, at any size of
the input. Chunks and what they send grow with the input; nothing goes through the driver but the number of pairs sent. A pair or
token in every document is one pair in each chunk, so there is no hot key.

Defined results: null and empty texts, and texts whose tokens of A or B do not spell a space and the text (such as one with U+2581), have no
tokens: zeros and an empty string; repeated rows, and rows with a null or repeated doc_id, are documents of their own and each count;
doc_ids are cast to long; other columns are not read, so none clashes; an empty table gives an empty result; a text of any length is one
member of a chunk; a group of very many tokens is counted by its distinct ids instead of its links.
"""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bitpack import Encoder, _Parts
from .bpe import _spread, _squeezed, tokenizer_path
from .shared import stored, table
from .texthash import mix

A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
CHUNK = 2 << 20
SHARDS = 256
FAN = 64
#: Pairs that the chunks of one group send to a shard, on the average.
PER_GROUP = 1 << 20
#: A group of tokens with more links is counted by its distinct ids.
WIDE = 4096
#: Parts of texts of which each encoder keeps the ids, in each of two generations.
KEPT = 300_000
MARK = "▁"


def _bytes_of_a(path: str) -> list[bytes]:
    """The bytes of each id of a byte-level tokenizer."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    out = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = bytes(byte[c] for c in piece)
    return out


class Pieces(Encoder):
    """Ids of sentencepiece for texts that begin with the space that it puts before a text; segments that occur again are encoded once.

    No piece goes on after white space begins (its mark stands only at the beginning of pieces) and none holds a line break, so a text
    may be cut before spaces and around line breaks. A model of which this is not so, and very long texts, are encoded whole. Where
    ids do not spell the text, `bad` is among them.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if lib.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(names)]
        self.length = [len(x) for x in self.bytes]
        self.bad = len(names)
        self.line = [i for i in range(len(names)) if lib.is_byte(i) and self.bytes[i] == b"\n"]
        self.mark = lib.piece_to_id(MARK)
        as_is = " a\n b 　ééﬁ"
        self.plain = (
            not any(MARK in p.lstrip(MARK) or "\n" in p for p in names) and len(self.line) == 1
            and lib.encode("\n") == [self.mark, *self.line] and b"".join(self.bytes[i] for i in lib.encode(as_is)).decode() == " " + as_is
        )
        self.special: list[str] = []
        self.kind = "<u2" if self.bad < 1 << 16 else "<u4"
        self.known, self.older = _Parts(self.kind), _Parts(self.kind)

    def _spelt(self, ids: list[int], text: str) -> list[int]:
        return ids if b"".join([self.bytes[i] for i in ids]) == text.encode("utf-8", "surrogatepass") else [self.bad]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self._spelt(self.lib.encode(text[1:]) if text != " " else [self.mark], text), np.uint32)

    _long = _whole

    def _classified(self, chars: np.ndarray) -> np.ndarray:
        return np.zeros(len(chars), np.uint8)

    def _begins(self, chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
        start = np.ones(len(chars), bool)
        space, line = chars == 32, chars == 10
        start[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1] | (kind[1:] != kind[:-1])
        return start

    def _coded(self, parts: list[str]) -> list[list[int]]:
        """The library puts a space before what it encodes."""
        coded = self.lib.encode([s[1:] if s[:1] == " " else "\n" + s for s in parts], num_threads=1)
        for k, s in enumerate(parts):
            if s[:1] != " ":
                coded[k] = coded[k][2:] if s != "\n" else self.line
            elif s == " ":  # an empty text has no ids, so the library has none for a space alone
                coded[k] = [self.mark]
        whole = b"".join(map(self.bytes.__getitem__, chain.from_iterable(coded)))
        if whole == "".join(parts).encode("utf-8", "surrogatepass") and all(
            sum(map(self.length.__getitem__, ids)) == len(s.encode("utf-8", "surrogatepass")) for ids, s in zip(coded, parts, strict=True)
        ):
            return coded
        return [self._spelt(ids, s) for ids, s in zip(coded, parts, strict=True)]


@functools.lru_cache(maxsize=2)
def sides_of(path_a: str, path_b: str) -> tuple[Encoder, Pieces, list[bytes]]:
    """The encoders and the bytes of A's ids: one of each for all tasks of a Python worker."""
    a, b = Encoder(path_a, plain=True), Pieces(path_b)
    a.keep = b.keep = KEPT
    return a, b, _bytes_of_a(path_a)


@functools.lru_cache(maxsize=2)
def lengths_of(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that each id of A and of B has."""
    sides_of.cache_clear()  # a worker that is past encoding gives its memory back
    return _lengths(_bytes_of_a(path_a)), _lengths(Pieces(path_b).bytes)


class Aligned:
    """The groups and links of documents, from their ids one after another.

    a, b: ids; n_a, n_b: their numbers in each document; len_a, len_b: the bytes of each id. Both sides of a document spell the same bytes.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, len_a: np.ndarray, len_b: np.ndarray):
        self.a, self.b, self.n_docs = a.astype(np.int64), b.astype(np.int64), len(n_a)
        end_a, end_b = np.cumsum(len_a[self.a]), np.cumsum(len_b[self.b])
        ends = end_a[np.isin(end_a, end_b, assume_unique=True)]
        self.of_a, self.of_b = np.searchsorted(ends, end_a), np.searchsorted(ends, end_b)  # groups of tokens
        self.in_a, self.in_b = np.bincount(self.of_a, minlength=len(ends)), np.bincount(self.of_b, minlength=len(ends))
        self.first_a, self.first_b = np.cumsum(self.in_a) - self.in_a, np.cumsum(self.in_b) - self.in_b
        self.doc_of_a = np.repeat(np.arange(self.n_docs), n_a)
        self.doc = self.doc_of_a[self.first_a]  # documents of groups
        self.n_groups = np.bincount(self.doc, minlength=self.n_docs)
        self.n_links = np.zeros(self.n_docs, np.int64)
        np.add.at(self.n_links, self.doc, self.in_a * self.in_b)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, pair (id of A * 2**32 + id of B) and multiplicity of links; a pair may come more than once."""
        narrow = self.in_a * self.in_b <= WIDE
        times = np.where(narrow, self.in_b, 0)[self.of_a]
        i = np.repeat(np.arange(len(self.a)), times)
        upto = np.cumsum(times)
        j = self.first_b[self.of_a[i]] + np.arange(len(i)) - np.repeat(upto - times, times)
        found = [(self.doc_of_a[i], (self.a[i] << 32) | self.b[j], np.ones(len(i), np.int64))]
        for g in np.flatnonzero(~narrow).tolist():
            x, m = np.unique(self.a[self.first_a[g] : self.first_a[g] + self.in_a[g]], return_counts=True)
            y, n = np.unique(self.b[self.first_b[g] : self.first_b[g] + self.in_b[g]], return_counts=True)
            found.append((np.full(len(x) * len(y), self.doc[g]), ((x << 32)[:, None] | y).ravel(), (m[:, None] * n).ravel()))
        doc, pair, times = zip(*found, strict=True)
        return np.concatenate(doc), np.concatenate(pair), np.concatenate(times)

    def written(self, names_a: tuple[np.ndarray, np.ndarray], names_b: tuple[np.ndarray, np.ndarray]) -> list[str]:
        """a1,a2|b1;a3|b2,b3 of each document; names: the decimals of ids with a comma, and with the sign that ends a side."""
        out = np.empty(len(self.a) + len(self.b), object)
        for ids, of, before, last, (comma, end) in (
            (self.a, self.of_a, self.first_b[self.of_a], (self.first_a + self.in_a)[self.of_a], names_a),
            (self.b, self.of_b, (self.first_a + self.in_a)[self.of_b], (self.first_b + self.in_b)[self.of_b], names_b),
        ):
            at = np.arange(len(ids))
            out[at + before] = np.where(at + 1 == last, end[ids], comma[ids])
        size = np.zeros(self.n_docs, np.int64)
        np.add.at(size, self.doc, self.in_a + self.in_b)
        upto = np.cumsum(size)
        return ["".join(out[lo:hi].tolist())[:-1] for lo, hi in zip((upto - size).tolist(), upto.tolist(), strict=True)]


def distinct_pairs(pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs by shard and value, their shards, and where each link's pair is."""
    pairs, where = np.unique(pair, return_inverse=True)
    shard = (pairs >> 32) % SHARDS
    order = np.argsort(shard, kind="stable")
    place = np.empty(len(pairs), np.int64)
    place[order] = np.arange(len(pairs))
    return pairs[order], shard[order], place[where]


def documents_of(doc: np.ndarray, where: np.ndarray, n_pairs: int) -> np.ndarray:
    """In how many documents each distinct pair is; links come by document but for those of wide groups."""
    seen = np.unique(doc * max(1, n_pairs) + where)
    return np.bincount(seen % max(1, n_pairs), minlength=n_pairs)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays in levels, ranks of their set bits."""

    def __init__(self, bits: list[np.ndarray]):
        self.bits = bits
        self.upto, total = [], 0
        for b in bits:
            self.upto.append(np.cumsum(b, dtype=np.int64) + total - 1)
            total += int(b.sum())
        self.n = total

    @staticmethod
    def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(mix(keys.astype(np.uint64)) + np.uint64(level)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        bits: list[np.ndarray] = []
        while len(keys):
            at = cls._at(keys, len(bits), size := 2 * len(keys) + 1)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(bits)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for one that has no place. Other keys than those it was made of may get a number too."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (b, upto) in enumerate(zip(self.bits, self.upto, strict=True)):
            at = self._at(keys[left], level, len(b))
            hit = b[at]
            out[left[hit]] = upto[at[hit]]
            left = left[~hit]
            if not len(left):
                break
        return out

    def dumped(self) -> tuple[list[int], bytes]:
        return [len(b) for b in self.bits], zstandard.compress(b"".join(np.packbits(b).tobytes() for b in self.bits), 3)

    @classmethod
    def loaded(cls, sizes: list[int], raw: bytes) -> PerfectHash:
        data, at, bits = np.frombuffer(zstandard.decompress(raw), np.uint8), 0, []
        for n in sizes:
            bits.append(np.unpackbits(data[at : at + -(-n // 8)], count=n).astype(bool))
            at += -(-n // 8)
        return cls(bits)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype("<i8").tobytes(), 3)


def _unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), "<i8")


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


_LONGS = pa.list_(pa.int64())
_CODED = pa.schema([
    ("chunk", pa.int64()), ("shard", pa.int32()), ("n", pa.int64()), ("pairs", pa.binary()), ("counts", pa.binary()),
    ("doc_ids", _LONGS), ("n_a", _LONGS), ("n_b", _LONGS), ("groups", pa.list_(pa.string())), ("a", pa.binary()), ("b", pa.binary()),
])
CODED = "chunk long, shard int, n long, pairs binary, counts binary, doc_ids array<long>, n_a array<long>, n_b array<long>, groups array<string>, a binary, b binary"


def _lengths(of: list[bytes]) -> np.ndarray:
    return np.array([len(x) for x in of], np.int64)


def _flat(parts: list[np.ndarray]) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def _coded(path_a: str, path_b: str, want: str, chunk_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_a, encode_b, bytes_a = sides_of(path_a, path_b)
        lengths = _lengths(bytes_a), _lengths(encode_b.bytes)
        names = [[np.array([f"{i}{c}" for i in range(len(x))], object) for c in signs] for x, signs in zip(lengths, (",|", ",;"), strict=True)]
        task, number, none = TaskContext.get().partitionId(), 0, np.empty(0, np.uint32)

        def chunk(docs: list[tuple[int | None, str]]) -> pa.RecordBatch:
            nonlocal number
            texts = [" " + t for _, t in docs if t]
            coded = iter(zip(texts, encode_a.all(texts), encode_b.all(texts), strict=True))
            side_a, side_b = [], []
            for _, t in docs:
                spaced, a, b = next(coded) if t else ("", none, none)
                spelt = not (b == encode_b.bad).any() and b"".join([bytes_a[i] for i in a.tolist()]) == spaced.encode("utf-8", "surrogatepass")
                side_a.append(a if spelt else none)
                side_b.append(b if spelt else none)
            n_a, n_b = np.array([len(x) for x in side_a]), np.array([len(x) for x in side_b])
            flat_a, flat_b = _flat(side_a), _flat(side_b)
            aligned = Aligned(flat_a, flat_b, n_a, n_b, *lengths)
            texts = aligned.written(*names)
            if want == "groups_sha256":
                texts = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in texts]
            doc, pair, _ = aligned.links()
            pairs, shard, where = distinct_pairs(pair)
            n = documents_of(doc, where, len(pairs))
            key, number = (task << 32) + number, number + 1
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = [
                (key, int(s[0]), len(p), _packed(p), _packed(m), *[None] * 6)
                for p, s, m in zip(np.split(pairs, cuts), np.split(shard, cuts), np.split(n, cuts), strict=True) if len(p)
            ]
            rows.append((key, -1, None, None, None, [i for i, _ in docs], n_a.tolist(), n_b.tolist(), texts, _squeezed(flat_a), _squeezed(flat_b)))
            return _rows(rows, _CODED)

        docs: list[tuple[int | None, str]] = []
        size = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append((doc_id, text.as_py() or ""))
                size += len(docs[-1][1]) + 64
                if size >= chunk_bytes:
                    yield chunk(docs)
                    docs, size = [], 0
        if docs:
            yield chunk(docs)

    return run


def _tree(rows: DataFrame, parts: int, fold: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """shard, part, x of rows folded to one row for each shard, FAN rows at a time."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        x = fold([_unpacked(raw) for raw in group["x"].to_pylist()])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([key[1].as_py()], pa.int64()), "x": pa.array([_packed(x)], pa.binary())})

    while True:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.expr(f"part div {FAN}")).groupBy("shard", "part").applyInArrow(run, "shard int, part long, x binary")
        if parts <= 1:
            return rows


_HASH = pa.schema([("shard", pa.int32()), ("sizes", _LONGS), ("bits", pa.binary()), ("keys", pa.binary())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            pairs = _unpacked(raw)
            perfect = PerfectHash.of(pairs)
            keys = np.empty(len(pairs), np.int64)
            keys[perfect(pairs)] = pairs
            rows.append((shard, *perfect.dumped(), _packed(keys)))
        yield _rows(rows, _HASH)


def _placed(row: dict) -> Callable[[np.ndarray], np.ndarray]:
    """The numbers of pairs in a shard's vectors, each verified."""
    perfect, keys = PerfectHash.loaded(row["sizes"], row["bits"]), _unpacked(row["keys"])

    def at(pairs: np.ndarray) -> np.ndarray:
        found = perfect(pairs)
        if (found < 0).any() or (keys[found] != pairs).any():
            raise RuntimeError("a pair is not among the distinct pairs")
        return found

    return at


def _added(key: tuple, sent: pa.Table, hashes: pa.Table) -> pa.Table:
    """The dense vector of one group of chunks."""
    rows = []
    if sent.num_rows:
        place = _placed(hashes.to_pylist()[0])
        total = None
        for raw_pairs, raw_counts in zip(sent["pairs"].to_pylist(), sent["counts"].to_pylist(), strict=True):
            at, n = place(_unpacked(raw_pairs)), _unpacked(raw_counts)
            total = np.zeros(len(_unpacked(hashes["keys"][0].as_py())), np.int64) if total is None else total
            total[at] += n  # the pairs of a chunk differ
        rows = [(key[0].as_py(), key[1].as_py(), _packed(total))]
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    return pa.table({"shard": pa.array(cols[0], pa.int32()), "part": pa.array(cols[1], pa.int64()), "x": pa.array(cols[2], pa.binary())})


def _answered(_key: tuple, sent: pa.Table, hashes: pa.Table) -> pa.Table:
    """Counts of the pairs that each chunk sent, and whether they are the highest of their ids of A."""
    chunks, shards, counts, best = [], [], [], []
    if sent.num_rows:
        row = hashes.to_pylist()[0]
        place, total, ids = _placed(row), _unpacked(row["x"]), _unpacked(row["keys"]) >> 32
        top = np.zeros(int(ids.max()) + 1, np.int64)
        np.maximum.at(top, ids, total)
        for chunk, shard, raw in zip(sent["chunk"].to_pylist(), sent["shard"].to_pylist(), sent["pairs"].to_pylist(), strict=True):
            at = place(_unpacked(raw))
            chunks.append(chunk)
            shards.append(shard)
            counts.append(_packed(total[at]))
            best.append(np.packbits(total[at] == top[ids[at]]).tobytes())
    return pa.table({"chunk": pa.array(chunks, pa.int64()), "shard": pa.array(shards, pa.int32()), "counts": pa.array(counts, pa.binary()), "best": pa.array(best, pa.binary())})


def _looked_up(path_a: str, path_b: str, want: str):
    def run(_key: tuple, coded: pa.Table, answers: pa.Table) -> pa.Table:
        lengths = lengths_of(path_a, path_b)
        row = coded.to_pylist()[0]
        n_a, n_b = np.array(row["n_a"], np.int64), np.array(row["n_b"], np.int64)
        aligned = Aligned(_spread(row["a"]), _spread(row["b"]), n_a, n_b, *lengths)
        doc, pair, times = aligned.links()
        pairs, shard, where = distinct_pairs(pair)
        count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), np.int64)
        seen = 0
        for s, raw, bits in zip(answers["shard"].to_pylist(), answers["counts"].to_pylist(), answers["best"].to_pylist(), strict=True):
            lo, hi = np.searchsorted(shard, [s, s + 1])
            count[lo:hi] = _unpacked(raw)
            best[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo)
            seen += hi - lo
        if seen != len(pairs):
            raise RuntimeError("counts of some pairs of a chunk are missing")
        n_best, count_sum = np.zeros(aligned.n_docs, np.int64), np.zeros(aligned.n_docs, np.int64)
        np.add.at(n_best, doc, times * best[where])
        np.add.at(count_sum, doc, times * count[where])
        longs = {"doc_id": row["doc_ids"], "n_a": n_a, "n_b": n_b, "n_groups": aligned.n_groups, "n_links": aligned.n_links, "n_best": n_best, "count_sum": count_sum}
        return pa.table({k: pa.array(v, pa.int64()) for k, v in longs.items()} | {want: pa.array(row["groups"], pa.string())})

    return run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, {want} string"


def _encoded(docs: DataFrame, path_a: str, path_b: str, want: str, chunk_bytes: int) -> DataFrame:
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(narrow.mapInArrow(_coded(path_a, path_b, want, chunk_bytes), CODED), "coded")


def _counted(coded: DataFrame, per_group: int) -> tuple[DataFrame, DataFrame]:
    """What chunks sent, with the group that counts it, and the hashes and counts of every shard, once for each group."""
    sent = coded.where("shard >= 0").select("chunk", "shard", "n", "pairs", "counts")
    total, rows = sent.agg(F.sum("n"), F.approx_count_distinct("chunk")).first()
    parts, groups = max(1, rows or 0), max(1, -(-(total or 0) // (SHARDS * per_group)))
    united = _tree(sent.select("shard", F.expr(f"pmod(xxhash64(chunk), {parts})").alias("part"), F.col("pairs").alias("x")), parts, lambda x: np.unique(np.concatenate(x)))
    hashes = stored(united.select("shard", "x").mapInArrow(_hashed, "shard int, sizes array<long>, bits binary, keys binary"), "hashes")
    sent = sent.withColumn("part", F.expr(f"pmod(xxhash64(chunk), {groups})"))
    each = hashes.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))))
    vectors = sent.groupBy("shard", "part").cogroup(each.groupBy("shard", "part")).applyInArrow(_added, "shard int, part long, x binary")
    totals = stored(_tree(vectors, groups, lambda x: np.sum(x, axis=0)).select("shard", "x"), "totals")
    return sent, each.join(totals, "shard")


def pair_counts(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK, per_group: int = PER_GROUP) -> DataFrame:
    """a, b, n_docs: every pair of ids that some document links, and how many documents do."""
    coded = _encoded(docs, path_a or tokenizer_path(A_FILE), path_b or tokenizer_path(B_FILE), "groups_sha256", chunk_bytes)
    _, counts = _counted(coded, per_group)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pairs = _unpacked(keys)
                yield pa.RecordBatch.from_arrays([pa.array(pairs >> 32), pa.array(pairs & 0xFFFFFFFF), pa.array(_unpacked(x))], ["a", "b", "n_docs"])

    return counts.where("part = 0").select("keys", "x").mapInArrow(rows, "a long, b long, n_docs long")


def alignments(docs: DataFrame, want: str = "groups", path_a: str | None = None, path_b: str | None = None, chunk_bytes: int = CHUNK, per_group: int = PER_GROUP) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups (a1,a2|b1;a3|b2,b3) or groups_sha256 of every row."""
    path_a, path_b = path_a or tokenizer_path(A_FILE), path_b or tokenizer_path(B_FILE)
    coded = _encoded(docs, path_a, path_b, want, chunk_bytes)
    sent, counts = _counted(coded, per_group)
    answers = sent.groupBy("shard", "part").cogroup(counts.groupBy("shard", "part")).applyInArrow(_answered, "chunk long, shard int, counts binary, best binary")
    run, schema = _looked_up(path_a, path_b, want)
    chunks = coded.where("shard < 0").select("chunk", "doc_ids", "n_a", "n_b", "groups", "a", "b")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, schema)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(alignments(table(spark, sf_dir, "documents"), "groups_sha256"), "alignments")
