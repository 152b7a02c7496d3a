"""Token ids as fixed-width bit-packed blocks.

The format: a dataset of blocks, in files in ascending order of doc_id. A block holds the ids of some consecutive
documents, every id in the least number of bits that the vocabulary needs, packed little-endian without gaps:

    file_no  int     the file's place in the order
    block_no int     the block's place in the file
    first    long    ids in the file before this block
    width    int     bits of an id
    doc_ids  array   the documents of the block, ascending
    offsets  array   the ids in the block before each document, and at the end their number
    ids      binary  ceil(number * width / 8) bytes

Because the width is fixed, id j of a block is the bits j * width ... of `ids`: any document of a block can be
read without those before it (`document_ids`), and a whole block is unpacked by a few numpy operations (`unpack`).
The container is Parquet, so blocks are written and read by Spark wherever its file systems reach.

Defined results: null and empty texts are the end id alone; repeated doc_ids stand next to one another, and count in
`start` like different ones; null doc_ids come first; doc_ids are cast to long; very long texts are encoded whole, in pieces that are cut
where the tokenizer would cut; a block ends with the document that fills it, so one long document is one block; other columns are ignored; an empty table gives no block and an empty result.
"""

from __future__ import annotations

import functools
import json
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import load, tokenizer_path
from .shared import job_settings, shared_dir, stored, table
from .texthash import mix

TOKENIZER = "byte_bpe_50k.json"
END = 0
BLOCK_IDS = 1 << 17
#: Parts of texts of which a generation keeps the ids.
KNOWN = 500_000

BLOCK_SCHEMA = "file_no int, block_no int, first long, width int, doc_ids array<long>, offsets array<long>, ids binary"


def width_of(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    if width == 16:
        return ids.astype("<u2").tobytes()
    bits = (ids.astype(np.uint64)[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack(raw: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Ids start to stop of a packed block; reads only the bytes that hold them."""
    if stop <= start:
        return np.empty(0, np.uint32)
    if width == 16:
        return np.frombuffer(raw, "<u2", stop - start, 2 * start).astype(np.uint32)
    lo, hi = start * width // 8, -(-stop * width // 8)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8, hi - lo, lo), bitorder="little")
    bits = bits[start * width - lo * 8 :][: (stop - start) * width].reshape(-1, width).astype(np.uint32)
    return (bits << np.arange(width, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


def document_ids(block: dict, doc_id: int) -> np.ndarray:
    """The ids of the first document of a block that has this doc_id."""
    k = block["doc_ids"].index(doc_id)
    return unpack(block["ids"], block["width"], block["offsets"][k], block["offsets"][k + 1])


#: White space of the tokenizer's pattern (Unicode White_Space).
_SPACES = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_SPACE, _LETTER, _NUMBER, _OTHER, _END, _UNSURE = range(6)
#: Code points that are cut and looked up at once.
AT_ONCE = 1 << 20


@functools.lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point. Those whose category has changed since an early edition of Unicode are _UNSURE: the library may know another edition."""
    out = np.full(0x110000, _UNSURE, np.uint8)
    old = unicodedata.ucd_3_2_0
    for i in range(0x30000):
        kind = unicodedata.category(c := chr(i))
        if kind not in ("Cn", "Cs") and old.category(c) == kind:
            out[i] = {"L": _LETTER, "N": _NUMBER}.get(kind[0], _OTHER)
    out[_SPACES] = _SPACE
    return out


# A fixed odd number, whose powers weigh the places of a part in its hash.
_ODD = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=4)
def _powers(of: int, n: int) -> np.ndarray:
    x = np.full(n, of, np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x)


def _starts(chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern begins a part: contractions; runs of letters, of numbers or of others, each with one
    space before it; white space, of which a run before another part leaves its last character to that part or by itself."""
    n = len(chars)
    start = np.ones(n, bool)
    start[1:] = kind[1:] != kind[:-1]
    after = np.flatnonzero(start[1:] & (kind[:-1] == _SPACE) & (kind[1:] != _END)) + 1  # first characters after white space
    start[after - 1] = True
    start[after[chars[after - 1] == 32]] = False
    quote = np.flatnonzero(start[:-1] & (chars[:-1] == 39))
    if len(quote):
        a, b = chars[quote + 1], np.append(chars, 0)[quote + 2]
        one = np.isin(a, [115, 116, 109, 100])  # s t m d
        two = ((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108))  # re ve ll
        start[quote[one | two] + 1] = False
        start[np.concatenate([quote[one] + 2, quote[two] + 3])] = True
    start[kind == _END] = True
    return start


class _Deceived(Exception):
    """Two different parts have one hash."""


class _Parts:
    """Different parts of texts in sorted order of their hashes, with their characters in `chars` and their ids in `flat`."""

    def __init__(self, kind: str):
        self.key, self.chars, self.flat = np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, kind)
        self.at, self.length, self.begin, self.size = (np.empty(0, np.int64) for _ in range(4))

    def find(self, key: np.ndarray, chars: np.ndarray, at: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which are there, and where; those of a known hash are compared by their characters."""
        if not len(self.key):
            return np.zeros(len(key), bool), np.zeros(len(key), np.int64)
        where = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        there = self.key[where] == key
        found = where[there]
        if (self.length[found] != length[there]).any() or (_taken(self.chars, self.at[found], self.length[found]) != _taken(chars, at[there], length[there])).any():
            raise _Deceived
        return there, where

    def add(self, key: np.ndarray, chars: np.ndarray, length: np.ndarray, flat: np.ndarray, size: np.ndarray) -> None:
        """New parts, in ascending order of key; chars and flat hold their characters and ids one after another."""
        to = np.searchsorted(self.key, key)
        self.at = np.insert(self.at, to, len(self.chars) + np.cumsum(length) - length)
        self.begin = np.insert(self.begin, to, len(self.flat) + np.cumsum(size) - size)
        self.key, self.length, self.size = np.insert(self.key, to, key), np.insert(self.length, to, length), np.insert(self.size, to, size)
        self.chars, self.flat = np.concatenate([self.chars, chars]), np.concatenate([self.flat, flat])


def _taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that begin and size name, one after another."""
    upto = np.cumsum(size)
    return flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(begin - (upto - size), size)]


class Encoder:
    """The tokenizer's ids of whole texts, with parts that occur again encoded once.

    A byte-level tokenizer first cuts a text by a pattern and then encodes each part by itself with its model. Here the
    cuts of many texts are found at once by numpy operations on their code points. Parts are looked up by a 64-bit hash and
    compared by their characters; the library's model encodes those that are not known yet. Where different parts have one hash,
    their texts go to the library whole. So do texts in which a special token's string (plain=True: such strings are
    ordinary text) or a code point of uncertain class occurs, and all texts of a tokenizer that is built otherwise. What is known is held in two generations of about KNOWN parts; when the younger is full it becomes the
    older, from which parts are taken over when they occur.
    """

    keep = KNOWN

    def __init__(self, path: str, plain: bool = False):
        self.lib = load(path)
        self.lib.encode_special_tokens = plain
        self.kind = "<u2" if self.lib.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [] if plain else [t.content for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        cutter = made.get("pre_tokenizer") or {}
        self.plain = not made.get("normalizer") and cutter.get("type") == "ByteLevel" and cutter.get("use_regex", True) and not cutter.get("add_prefix_space")
        self.known, self.older = _Parts(self.kind), _Parts(self.kind)
        # a byte is written as the character of its number where that can be printed, the others as those from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(shown)))}

    def __call__(self, text: str) -> np.ndarray:
        return self.all([text])[0]

    def all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Texts go through in groups of about AT_ONCE code points, longer ones in pieces cut before white space."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        group, size = [], 0
        for k, text in enumerate(texts):
            if not self.plain or any(s in text for s in self.special):
                out[k] = self._whole(text)
            elif len(text) > AT_ONCE:
                out[k] = self._long(text)
            elif text:
                if size + len(text) > AT_ONCE:
                    self._fill(out, texts, group)
                    group, size = [], 0
                group.append(k)
                size += len(text) + 1
        self._fill(out, texts, group)
        return out

    def _long(self, text: str) -> np.ndarray:
        pieces = [self._cut([x]) for x in _pieces(text)]
        return self._whole(text) if any(p is None for p in pieces) else np.concatenate([p[0] for p in pieces])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)

    def _fill(self, out: list[np.ndarray], texts: list[str], group: list[int]) -> None:
        if group:
            found = self._cut([texts[k] for k in group])
            if found is None:  # some code point is of uncertain class: find its texts
                unsure = [self._classified(_code_points(texts[k])) is None for k in group]
                for k, u in zip(group, unsure, strict=True):
                    if u:
                        out[k] = self._whole(texts[k])
                self._fill(out, texts, [k for k, u in zip(group, unsure, strict=True) if not u])
            else:
                for k, x in zip(group, found, strict=True):
                    out[k] = x

    def _classified(self, chars: np.ndarray) -> np.ndarray | None:
        """The classes of characters; None if one is uncertain."""
        kind = _classes()[chars]
        return None if (kind == _UNSURE).any() else kind

    def _begins(self, chars: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return _starts(chars, kind)

    def _coded(self, parts: list[str]) -> list[list[int]]:
        encode, byte = self.lib.model.tokenize, self.byte
        return [[t.id for t in encode(p.encode().decode("latin-1").translate(byte))] for p in parts]

    def _cut(self, texts: list[str]) -> list[np.ndarray] | None:
        joined = "\n".join(texts) + "\n"
        chars = _code_points(joined).copy()
        kind = self._classified(chars)
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        if kind is None:
            return None
        kind[ends], chars[ends] = _END, 0x110000
        starts = np.flatnonzero(self._begins(chars, kind))
        length = np.append(starts[1:], len(chars)) - starts
        key = _hashes(chars, starts, length)
        order = np.argsort(key)
        new = np.empty(len(key), bool)
        new[:1] = True
        np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
        which = np.empty(len(key), np.int64)
        which[order] = np.cumsum(new) - 1
        first = order[new]
        like = first[which]  # the part that stands for each part
        try:
            if (length[like] != length).any() or (_taken(chars, starts[like], length) != chars).any():
                raise _Deceived
            size, flat = self._ids(key[first], chars, starts[first], length[first], lambda k: joined[starts[first[k]] : starts[first[k]] + length[first[k]]] if kind[starts[first[k]]] != _END else "")
        except _Deceived:
            return [self._whole(t) for t in texts]
        ids = _taken(flat, (np.cumsum(size) - size)[which], size[which]).astype(np.uint32)
        return np.split(ids, np.cumsum(size[which])[np.searchsorted(starts, ends)])[:-1]

    def _ids(self, key: np.ndarray, chars: np.ndarray, at: np.ndarray, length: np.ndarray, part: Callable[[int], str]) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of different parts, whose keys ascend; part(k) has the characters of the k-th."""
        if len(self.known.key) > self.keep:
            self.known, self.older = _Parts(self.kind), self.known
        there, _ = self.known.find(key, chars, at, length)
        new = np.flatnonzero(~there)
        if len(new):
            there, where = self.older.find(key[new], chars, at[new], length[new])
            old = new[there]
            if len(old):
                begin, size = self.older.begin[where[there]], self.older.size[where[there]]
                self.known.add(key[old], _taken(chars, at[old], length[old]), length[old], _taken(self.older.flat, begin, size), size)
            new = new[~there]
        if len(new):
            coded = self._coded([part(k) for k in new.tolist()])
            size = np.array([len(x) for x in coded], np.int64)
            self.known.add(key[new], _taken(chars, at[new], length[new]), length[new], np.array([i for x in coded for i in x], self.kind), size)
        where = np.searchsorted(self.known.key, key)  # all are there now
        size = self.known.size[where]
        return size, _taken(self.known.flat, self.known.begin[where], size)


def _hashes(chars: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The sum of each part's characters times powers of an odd number, its first power taken out again."""
    places = max(2 * AT_ONCE, len(chars))
    total = np.zeros(len(chars) + 1, np.uint64)
    np.cumsum((chars.astype(np.uint64) + np.uint64(1)) * _powers(_ODD, places)[: len(chars)], out=total[1:])
    return mix((total[starts + length] - total[starts]) * _powers(pow(_ODD, -1, 1 << 64), places)[starts] + length.astype(np.uint64))


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _pieces(text: str) -> Iterator[str]:
    """text in pieces of about AT_ONCE code points, each but the first beginning with the first character of a run of white space."""
    at = 0
    while len(text) - at > AT_ONCE:
        cut = max(text.rfind(" ", at + 1, at + AT_ONCE), text.rfind("\n", at + 1, at + AT_ONCE))
        if cut < 0:
            cut = min((p for c in " \n" if (p := text.find(c, at + AT_ONCE)) >= 0), default=len(text))
        while cut > at and cut < len(text) and text[cut - 1].isspace():
            cut -= 1
        if cut <= at:  # white space only: up to the first character that is none
            cut = len(text) - len(text[at:].lstrip())
            while cut < len(text) and not text[cut].isspace():
                cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


@functools.lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(path)


def _block(no: tuple[int, int, int], width: int, docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    cols = [[no[0]], [no[1]], [no[2]], [width], [docs], [offsets.tolist()], [pack(np.concatenate(ids), width)]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
    names = ["file_no", "block_no", "first", "width", "doc_ids", "offsets", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)


def _encode(path: str, width: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        file_no, block_no, first, size = TaskContext.get().partitionId(), 0, 0, 0
        docs: list = []
        ids: list[np.ndarray] = []
        for batch in batches:
            for doc, x in zip(batch.column(0).to_pylist(), encoder.all([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                docs.append(doc)
                ids.append(np.append(x, np.uint32(end)))
                size += len(x) + 1
                if size >= BLOCK_IDS:
                    yield _block((file_no, block_no, first), width, docs, ids)
                    block_no, first, size, docs, ids = block_no + 1, first + size, 0, [], []
        if docs:
            yield _block((file_no, block_no, first), width, docs, ids)

    return run


def write_blocks(docs: DataFrame, to: str, path: str | None = None, end: int = END) -> None:
    """Encodes every text of docs and writes the blocks, files in ascending order of doc_id."""
    path = path or tokenizer_path(TOKENIZER)
    width = width_of(max(load(path).get_vocab_size(), end + 1))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("h", F.xxhash64("text"))
    # a repeated doc_id may go on in the next file
    ordered = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    with job_settings(ordered):
        ordered.mapInArrow(_encode(path, width, end), BLOCK_SCHEMA).write.parquet(to)


def _summaries(bases: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for file_no, first, width, docs, offsets, raw in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                ids = unpack(raw, width, 0, offsets[-1]).astype("<u4")
                base = bases[file_no] + first
                out += [(d, base + a, b - a, zlib.crc32(ids[a:b])) for d, a, b in zip(docs, offsets, offsets[1:], strict=False)]
            cols = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_summaries(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the blocks.

    To the driver goes one number for each file: the partitions that wrote them, not the documents, bound it.
    """
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(at)
    per_file = blocks.groupBy("file_no").agg(F.max(F.struct("first", F.element_at("offsets", -1).alias("n"))).alias("x"))
    bases, total = {}, 0
    for r in sorted(per_file.select("file_no", (F.col("x.first") + F.col("x.n")).alias("n")).collect()):
        bases[r["file_no"]] = total
        total += r["n"]
    narrow = blocks.select("file_no", "first", "width", "doc_ids", "offsets", "ids")
    return narrow.mapInArrow(_summaries(bases), "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bitpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{shared_dir(spark)}/rimflow-{uuid.uuid4().hex}/token_blocks"
    write_blocks(table(spark, sf_dir, "documents"), at)
    return stored(read_summaries(spark, at), "summaries")
