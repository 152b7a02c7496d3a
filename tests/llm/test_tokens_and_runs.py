"""Token counts, periodic runs and alignments against brute force, and rows at their edges."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from rimflow.llm import alignment, bitpack, periodic, tokencounts

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\r\x0b\x0c"


def documents():
    t = pq.read_table(f"{SF}/documents.parquet").to_pydict()
    return list(zip(t["doc_id"], t["text"], strict=True))


def thue_morse(k, a, b):
    s = a
    for _ in range(k):
        s += s.translate(str.maketrans(a + b, b + a))
    return s


ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "<|endoftext|>", "A <|ENDOFTEXT|> b<|endoftext|>c", "It's  WE'LL\tgo now ▁x", "<s> </s> <unk> <0x41>",
    "é́ 中文 \U0001f600\U0001f600 İK", "  two  spaces\n  and\r\nlines  \n", "▁", "x" * 5000, "ab " * 3000, "\x00nul",
    thue_morse(10, "a", "b"), thue_morse(10, "b", "a"), " ".join(thue_morse(9, "p", "q")),
]


def rows_at_the_edges(extra=0):
    rng = random.Random(5)
    rows = [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "no id"), (None, None), (7, "one"), (7, "two"), (7, "two"), (-1, "conv minus one")]
    rows += [(5000 + i, " ".join(f"w{rng.randint(0, 30)}" for _ in range(rng.randint(0, 60)))) for i in range(extra)]
    rows += [(6000 + i, "the very same text of a large group") for i in range(60)]
    return [(i, t, k, str(k), 0.5, "x") for k, (i, t) in enumerate(rows)]


#: with names that the operators use for columns of their own
EDGE_SCHEMA = "doc_id long, text string, n_tokens int, digest string, key double, chunk string"


def by_row(got):
    return Counter(tuple(r) for r in got)


# --- op11


def library_counts(path):
    if path.endswith(".model"):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: len(lib.encode(t))
    lib = Tokenizer.from_file(path)
    lib.no_truncation()
    lib.no_padding()
    return lambda t: len(lib.encode(t, add_special_tokens=False).ids)


def want_counts(rows, path, limit=2048):
    count = library_counts(path)
    return Counter((i, len((t or "").encode()), n := count(t or ""), n > limit) for i, t, *_ in rows)


def test_op11_equals_the_library(spark):
    assert by_row(tokencounts.op11_token_counts(spark, SF).collect()) == want_counts(documents(), public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_odd_texts_come_from_the_cache(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), f"file://{tmp_path}/cache"
    rows = rows_at_the_edges(50)
    first, second = rows[: len(rows) // 2], rows
    for part in (first, second, second):
        got = tokencounts.token_counts(spark.createDataFrame(part, EDGE_SCHEMA).repartition(3), cache, path, limit=20)
        assert by_row(got.collect()) == want_counts(part, path, 20)
    stored = spark.read.parquet(cache).collect()
    counter = tokencounts.Counter(path)
    assert len(stored) == len({counter.content(t) for _, t, *_ in rows}) and {r["tokenizer"] for r in stored} == {tokencounts.version_of(path)}


def test_cached_counts_are_used_and_doubled_rows_do_no_harm(spark, tmp_path):
    path, cache = public_tokenizers.path("word_bpe_49k.json"), f"file://{tmp_path}/cache"
    docs = spark.createDataFrame([(1, "One  two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    tokencounts.token_counts(docs.where("doc_id = 1"), cache, path).collect()
    at = f"{cache}/tokenizer={tokencounts.version_of(path)}"
    spark.createDataFrame([(tokencounts._digest(b"three"), 77)] * 2, tokencounts.CACHE_SCHEMA).write.mode("append").parquet(at)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencounts.token_counts(docs, cache, path).collect()}
    assert got == {1: 2, 2: 2, 3: 77}  # 77 can only be from the cache
    assert tokencounts.token_counts(docs.limit(0), cache, path).count() == 0


def test_an_empty_table_has_no_counts(spark, tmp_path):
    empty = spark.createDataFrame([], EDGE_SCHEMA)
    assert tokencounts.token_counts(empty, f"file://{tmp_path}/cache").collect() == []
    assert periodic.periodic_runs(empty).collect() == [] and alignment.alignments(empty).collect() == [] and alignment.pair_counts(empty).collect() == []


def test_case_is_kept_where_a_special_token_may_stand():
    counter = tokencounts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    assert counter.by_words and counter.content("A\tB  ") == b"a b" and counter.content("A <|ENDOFTEXT|>") == b"A <|ENDOFTEXT|>"


# --- op12


def plain_runs(w):
    """Every period by comparing words; a stretch with several periods keeps the smallest."""
    n, best = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                best.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in best.items())


def tail_repeated(doc_id, w):
    n, h = len(w), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def words_of(text):
    for c in SPACE:
        text = (text or "").replace(c, " ")
    return [x for x in text.split(" ") if x]


def want_runs(doc_id, text):
    w = tail_repeated(doc_id, words_of(text))
    runs = plain_runs(w)
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(x for i, x in enumerate(w) if i not in drop)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    best = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(runs), *best, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def test_op12_equals_brute_force(spark):
    got = by_row(periodic.op12_periodic_runs(spark, SF).collect())
    assert got == Counter(want_runs(i, t) for i, t in documents()) and sum(r[1] for r in got) > 5


def test_runs_do_not_depend_on_tiles():
    rng = random.Random(1)
    for _ in range(250):
        n, k = rng.randint(0, 300), rng.choice([1, 2, 3, 50])
        w = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n > 10 else 0):
            p = rng.randint(1, max(1, n // 5))
            length = rng.randint(p, min(n, 8 * p))
            s = rng.randint(0, n - length)
            block = [rng.randrange(k) for _ in range(p)]
            w[s : s + length] = [block[i % p] for i in range(length)]
        want = plain_runs(w)
        for tile in (16, 64, periodic.TILE):
            found = defaultdict(list)
            for octaves, at, end in periodic.tiles_of(n, tile):
                for q, a, b in periodic.fragments(np.array(w[at:end], np.int64), octaves):
                    found[q].append((a + at, b + at))
            got = []
            for q, each in found.items():
                merged: list[list[int]] = []
                for a, b in sorted(each):
                    if merged and a <= merged[-1][1]:
                        merged[-1][1] = max(b, merged[-1][1])
                    else:
                        merged.append([a, b])
                got += [(a, b - a + q, q) for a, b in merged if b - a + q >= max(6, 4 * q)]
            assert sorted(got) == want


def test_extents_of_deceiving_hashes_are_put_right(monkeypatch):
    """Extents that come out too long are found again by the words."""
    w = np.array([0, 4, 0, 4, 0, 4, 0, 4, 0, 8, 1, 2, 3] * 2)
    want, plain = periodic.fragments(w, range(3)), periodic._Windows.forward
    monkeypatch.setattr(periodic._Windows, "forward", lambda self, x, q: plain(self, x, q) + (q == 2))
    assert periodic.fragments(w, range(3)) == want and (2, 0, 7) in want


def test_stitched_runs_of_long_documents(spark):
    """Tiles of 16 words: everything goes through tiles, shuffle and stitching; runs and texts are whole."""
    rng = random.Random(8)
    rows = rows_at_the_edges(40)
    long = [f"w{rng.randint(0, 9)}" for _ in range(700)]
    long[100:400] = [f"p{i % 37}" for i in range(300)]
    rows += [(9000 + k, " ".join(long[k:] * (1 + 4 * (k % 2))), 0, "", 0.0, "") for k in range(6)] + [(9100, "same " * 1500, 0, "", 0.0, "")]
    docs = spark.createDataFrame(rows, EDGE_SCHEMA).repartition(5)
    got = periodic.periodic_runs(docs, tile=16).collect()
    want = Counter()
    for i, t, *_ in rows:
        w = words_of(t)
        runs = plain_runs(w)
        drop = {x for s, length, q in runs for x in range(s + q, s + length)}
        want[i, len(w), tuple(runs), " ".join(x for k, x in enumerate(w) if k not in drop)] += 1
    assert Counter((r["doc_id"], r["n_words"], tuple(tuple(x) for x in r["runs"]), r["collapsed"]) for r in got) == want
    assert sum(len(r["runs"]) for r in got) > 20


# --- op13


def bytes_of_a():
    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    shown = list(range(ord("!"), ord("~") + 1)) + list(range(0xA1, 0xAD)) + list(range(0xAE, 0x100))
    table, extra = {}, 0
    for b in range(256):
        if b in shown:
            table[chr(b)] = b
        else:
            table[chr(256 + extra)] = b
            extra += 1
    return made, lambda i: bytes(table[c] for c in made.id_to_token(i))


def want_alignments(rows):
    lib, of_a = bytes_of_a()
    lib.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    of_b = lambda i: bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
    docs, count = [], Counter()
    for doc_id, text, *_ in rows:
        groups = []
        if text:
            a, b = lib.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
            raw = (" " + text).encode()
            if b"".join(map(of_a, a)) == raw == b"".join(map(of_b, b)):
                i = j = at_a = at_b = 0
                xs, ys = [], []
                while i < len(a) or j < len(b):
                    if at_a <= at_b and i < len(a):
                        xs.append(a[i])
                        at_a += len(of_a(a[i]))
                        i += 1
                    else:
                        ys.append(b[j])
                        at_b += len(of_b(b[j]))
                        j += 1
                    if at_a == at_b:
                        groups.append((xs, ys))
                        xs, ys = [], []
        count.update({(x, y) for xs, ys in groups for x in xs for y in ys})
        docs.append((doc_id, groups))
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    out = Counter()
    for doc_id, groups in docs:
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        written = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out[
            doc_id, sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), sum(links.values()),
            sum(m for p, m in links.items() if count[p] == top[p[0]]), sum(m * count[p] for p, m in links.items()), hashlib.sha256(written.encode()).hexdigest() if written else "",
        ] += 1
    return out, count


def test_op13_equals_brute_force(spark):
    want, _ = want_alignments(documents())
    assert by_row(alignment.op13_alignment(spark, SF).collect()) == want


def test_alignments_of_odd_texts_in_many_chunks_and_groups(spark):
    rows = rows_at_the_edges(200)
    docs = spark.createDataFrame(rows, EDGE_SCHEMA).repartition(4)
    want, count = want_alignments(rows)
    got = alignment.alignments(docs, "groups_sha256", chunk_bytes=200, per_group=4)
    assert by_row(got.collect()) == want
    pairs = alignment.pair_counts(docs, chunk_bytes=200, per_group=4)
    assert Counter({(r["a"], r["b"]): r["n_docs"] for r in pairs.collect()}) == count and pairs.count() == len(count)
    texts = {r["doc_id"]: r["groups"] for r in alignment.alignments(docs).collect()}
    assert all((hashlib.sha256(t.encode()).hexdigest() if t else "") in {w[-1] for w in want if w[0] == i} for i, t in texts.items() if i not in (None, 7))


def test_wide_groups_count_like_their_links(monkeypatch):
    """Groups of many tokens: counted by their distinct ids they give what their links give."""
    rng = np.random.default_rng(3)
    len_a, len_b = np.array([2, 4, 6]), np.array([1, 3, 5])  # no common end but those of documents, mostly
    a, b, n_a, n_b = [], [], [], []
    while len(n_a) < 30:
        x, y = rng.integers(0, 3, rng.integers(1, 40)), rng.integers(0, 3, rng.integers(1, 40))
        if len_a[x].sum() == len_b[y].sum():
            a, b, n_a, n_b = [*a, *x], [*b, *y], [*n_a, len(x)], [*n_b, len(y)]
    found = []
    for wide in (4096, 3, 0):
        monkeypatch.setattr(alignment, "WIDE", wide)
        made = alignment.Aligned(np.array(a), np.array(b), np.array(n_a), np.array(n_b), len_a, len_b)
        total = Counter()
        for d, p, m in zip(*[x.tolist() for x in made.links()], strict=True):
            total[d, p] += m
        assert [sum(m for (d, _), m in total.items() if d == k) for k in range(30)] == made.n_links.tolist()
        found.append(total)
    assert found[0] == found[1] == found[2]


def test_perfect_hash_is_minimal_and_verifiable():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(0, 1 << 50, n))
        made = alignment.PerfectHash.of(keys)
        again = alignment.PerfectHash.loaded(*made.dumped())
        assert sorted(again(keys).tolist()) == list(range(len(keys))) == sorted(made(keys).tolist()) and again.n == len(keys)
    row = {"keys": alignment._packed(keys[np.argsort(made(keys))])} | dict(zip(("sizes", "bits"), made.dumped(), strict=True))
    place = alignment._placed(row)
    assert (keys[np.argsort(made(keys))][place(keys[:100])] == keys[:100]).all()
    with pytest.raises(RuntimeError):
        place(np.array([keys[0] + 1 if keys[0] + 1 not in keys else keys[0] + 2]))


# --- op4: parts of one hash


def test_parts_of_one_hash_get_their_own_ids(spark, tmp_path):
    """Words of Thue and Morse with their letters exchanged: sums of characters times powers of odd numbers cannot tell them apart."""
    texts = [thue_morse(k, *ab) for k in (9, 10, 11, 12) for ab in ("ab", "ba", "xy", "yx")] + ["plain words", None]
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    want = [lib.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = bitpack.Encoder(path)
    assert [x.tolist() for x in encoder.all([t or "" for t in texts])] == want and [encoder(t or "").tolist() for t in texts] == want
    to = f"file://{tmp_path}/blocks"
    bitpack.write_blocks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), to, path)
    crc = lambda ids: zlib.crc32(np.array([*ids, 0], "<u4").tobytes())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in bitpack.read_summaries(spark, to).collect()}
    assert got == {i: (len(w) + 1, crc(w)) for i, w in enumerate(want)}
