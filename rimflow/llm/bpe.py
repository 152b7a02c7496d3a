"""BPE encoding over a table of distinct words.

Documents are split at ASCII white space into words, which the tokenizer encodes independently of one
another (its normaliser collapses white space and its splitter never joins two words).

1. A task gathers documents into chunks of about CHUNK bytes and numbers a chunk's distinct words by frequency. It
   emits the chunk's documents as sequences of these numbers (rows "text") and its distinct words dealt out
   into buckets by a hash of the word, one row for each bucket (rows "word").
2. All rows "word" of a bucket come to one task, which encodes each distinct word of the corpus exactly once.
   There is a bucket for every BUCKET_BYTES of text, so a bucket's words fit a task at any size.
3. The ids go back to their chunk in the order in which the words came, where documents take them up by position.
4. Decoding joins ids with the table of pieces, which has as many rows as the vocabulary.

What is shuffled is the word numbers of the texts (a byte or two a word, compressed) and each chunk's distinct words;
no row is made for each word of a text. A chunk's key is a digest of its documents, so a task that runs again
makes the same rows; a chunk that misses any of its words stops the job instead of giving a wrong result.

Defined results: null and empty texts have no ids and decode to an empty text; repeated rows each give a row;
documents that contain special-token strings are encoded as the tokenizer does by default; an empty
table gives an empty result; doc_ids are cast to long; a text of any length is one member of a chunk, in the memory of one task; other columns of
the input are not read, so none clashes.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stored, table

CHUNK = 4 << 20
BUCKET_BYTES = 16 << 20
MIN_BUCKETS = 64
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library would start a thread for each of the machine
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def pieces_of(path: str) -> list[str]:
    """The piece of each id."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    vocab = dict(model["model"]["vocab"])
    vocab.update({t["content"]: t["id"] for t in model["added_tokens"]})
    out = [""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        out[i] = piece
    return out


class _Chunk:
    """Documents as sequences of numbers of their distinct words."""

    def __init__(self) -> None:
        self.size, self.ids, self.docs, self.number = 0, [], [], {}
        self.hash = hashlib.blake2b(digest_size=8)

    def add(self, doc_id: int | None, text: str | None) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        number = self.number
        words = raw.split()
        for w in words:
            if w not in number:
                number[w] = len(number)
        self.docs.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
        self.ids.append(doc_id)
        self.hash.update(f"{doc_id} {len(raw)} ".encode())
        self.hash.update(raw)
        self.size += len(raw) + 16

    def ranked(self, buckets: int) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """Word numbers of all documents, the words in the order of their numbers, and their buckets; frequent words first."""
        flat = np.concatenate(self.docs) if self.docs else np.empty(0, np.uint32)
        order = np.argsort(-np.bincount(flat, minlength=len(self.number)), kind="stable") if len(self.number) else np.empty(0, np.int64)
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        words = list(self.number)
        words = [words[k] for k in order.tolist()]
        bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.uint32, len(words))
        return rank[flat], words, bucket

    @property
    def key(self) -> int:
        return int.from_bytes(self.hash.digest(), "little", signed=True)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
    chunk = _Chunk()
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk.add(i, x.as_py())
            if chunk.size >= CHUNK:
                yield chunk
                chunk = _Chunk()
    if chunk.ids:
        yield chunk


def _squeezed(a: np.ndarray) -> bytes:
    """uint32 numbers as four byte planes, compressed: the planes of the higher bytes are mostly zeros."""
    return zstandard.compress(a.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _spread(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _words(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            _, words, bucket = chunk.ranked(buckets)
            dealt: dict[int, list[bytes]] = {}
            for w, b in zip(words, bucket.tolist(), strict=True):
                dealt.setdefault(b, []).append(w)
            rows = [(chunk.key, b, zstandard.compress(b"\n".join(ws), 3)) for b, ws in dealt.items()]
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["chunk", "bucket", "words"])

    return run


def _texts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            flat, _, bucket = chunk.ranked(buckets)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([chunk.key], pa.int64()),
                    pa.array([chunk.ids], pa.list_(pa.int64())),
                    pa.array([_squeezed(np.array([len(d) for d in chunk.docs], np.uint32))], pa.binary()),
                    pa.array([_squeezed(flat)], pa.binary()),
                    pa.array([_squeezed(bucket)], pa.binary()),
                ],
                ["chunk", "ids", "n_words", "numbers", "buckets"],
            )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Input sorted by bucket: every word of a bucket is encoded once."""
        t = load(path)
        at, known = None, {}
        for batch in batches:
            out = []
            for bucket, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if bucket != at:
                    at, known = bucket, {}
                words = zstandard.decompress(blob).split(b"\n")
                new = [w for w in words if w not in known]
                got = t.encode_batch([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
                known.update((w, np.array(e.ids, "<u4")) for w, e in zip(new, got, strict=True))
                ids = [known[w] for w in words]
                out.append(zstandard.compress(np.array([len(x) for x in ids], "<u4").tobytes() + np.concatenate(ids).tobytes(), 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["chunk", "bucket", "ids"])

    return run


def _joined(path: str, want: tuple[str, ...]):
    names = np.array(pieces_of(path), object)
    decimal = np.array([str(i) for i in range(len(names))], object)

    def decoded(ids: np.ndarray) -> str:
        """The join of ids with the table of pieces; this tokenizer has no decoder, so pieces are parted by spaces."""
        return " ".join(names[ids].tolist())

    text_of = {
        "ids_sha256": lambda ids: hashlib.sha256(" ".join(decimal[ids].tolist()).encode()).hexdigest(),
        "decoded": decoded,
        "decoded_sha256": lambda ids: hashlib.sha256(decoded(ids).encode("utf-8", "surrogatepass")).hexdigest(),
    }

    def run(_key, left: pa.Table, right: pa.Table) -> pa.Table:
        docs: list = []
        coded: list[np.ndarray] = []
        if left.num_rows:
            bucket = _spread(left["buckets"][0].as_py())
            blobs = dict(zip(right["bucket"].to_pylist(), right["ids"].to_pylist(), strict=True))  # equal chunks send equal rows
            sizes_in, flat_in = [], []
            for b, n in zip(*np.unique(bucket, return_counts=True), strict=True):
                if int(b) not in blobs:
                    raise RuntimeError("words of a chunk did not come back: its input differs from one evaluation to the next")
                got = np.frombuffer(zstandard.decompress(blobs[int(b)]), "<u4")
                sizes_in.append(got[:n])
                flat_in.append(got[n:])
            flat = np.concatenate(flat_in) if flat_in else np.empty(0, np.uint32)
            in_order = np.argsort(bucket, kind="stable")
            sizes, begin = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
            sizes[in_order] = np.concatenate(sizes_in) if sizes_in else []
            begin[in_order] = np.cumsum(sizes[in_order]) - sizes[in_order]
        for row in range(left.num_rows):
            ids, counts = left["ids"][row].as_py(), _spread(left["n_words"][row].as_py()).tolist()
            numbers, at = _spread(left["numbers"][row].as_py()), 0
            for doc, k in zip(ids, counts, strict=True):
                w = numbers[at : at + k]
                at += k
                if k:
                    each = sizes[w]
                    ends = np.cumsum(each)
                    mine = flat[np.arange(ends[-1]) + np.repeat(begin[w] - ends + each, each)]
                else:
                    mine = np.empty(0, np.uint32)
                docs.append(doc)
                coded.append(mine)
        out = {"doc_id": pa.array(docs, pa.int64()), "n_tokens": pa.array([len(x) for x in coded], pa.int64())}
        for name in want:
            if name == "ids":
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in coded])]).astype(np.int32)
                out[name] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(coded).astype(np.int32) if coded else np.empty(0, np.int32)))
            else:
                out[name] = pa.array([text_of[name](x) for x in coded], pa.string())
        return pa.table(out)

    return run, ", ".join(["doc_id long", "n_tokens long", *[f"{x} array<int>" if x == "ids" else f"{x} string" for x in want]])


def bpe(docs: DataFrame, want: tuple[str, ...] = ("ids", "decoded"), path: str | None = None) -> DataFrame:
    """doc_id, n_tokens and what is wanted of: ids, ids_sha256, decoded (the text decoded from the ids), decoded_sha256.

    docs is evaluated twice and must come out alike both times: a scan of files, a stored or a checkpointed table.
    """
    path = path or tokenizer_path()
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(MIN_BUCKETS, -(-size // BUCKET_BYTES))
    words = narrow.mapInArrow(_words(buckets), "chunk long, bucket long, words binary").repartition("bucket").sortWithinPartitions("bucket")
    ids = words.mapInArrow(_encoded(path), "chunk long, bucket long, ids binary")
    texts = narrow.mapInArrow(_texts(buckets), "chunk long, ids array<long>, n_words binary, numbers binary, buckets binary")
    run, schema = _joined(path, want)
    return texts.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(run, schema)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(bpe(table(spark, sf_dir, "documents"), ("ids_sha256", "decoded_sha256")), "digests")


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the ids of every document."""
    return stored(bpe(docs, ("ids",)), "ids")
