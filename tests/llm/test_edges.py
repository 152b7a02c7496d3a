"""Brute-force versions of op1, op2 and op6, and rows at the edges: very long texts, null and repeated ids, clashing columns, hot groups."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rimflow.llm import bitpack, bpe, chat, fingerprint, mixing, quality_classifier, quality_rules, sharding, texthash, urlfilter

M64 = (1 << 64) - 1


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randint(0, vocabulary)}" for _ in range(n))


def test_posteriors_and_rates_equal_brute_force(spark):
    rng = random.Random(2)
    domains = ["a", "b", "c"]
    rows = [(i, " ".join(f"{rng.choice('ab') if rng.random() < 0.3 else 'abc'[i % 3]}{rng.randint(0, 30)}" for _ in range(rng.randint(1, 12))), "abc"[i % 3]) for i in range(240)]
    rows += [(500, None, "a"), (501, "", "b"), (None, "a1 b2", None), (7, rows[7][1], rows[7][2]), (7, "b1 b2 b3", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 240, 2)], "doc_id long, quality int, toxic int")
    targets = {"a": 0.5, "b": 0.3, "c": 0.2}
    got = mixing.mix(docs, labels, targets).collect()
    known = [(t or "", la) for i, t, la in rows if i is not None and i < 240 and i % 2 == 0]
    count = {d: Counter(w for t, la in known if la == d for w in t.split()) for d in domains}
    vocabulary = set().union(*count.values())
    prior = {d: math.log((sum(la == d for _, la in known) + 1) / (len(known) + 3)) for d in domains}
    weight = {w: [math.log((count[d][w] + 0.5) / (count[d].total() + 0.5 * len(vocabulary))) for d in domains] for w in vocabulary}
    want = defaultdict(lambda: [0, None])
    for i, t, _ in rows:
        ws = (t or "").lower().split()
        logs = [prior[d] + sum(weight[w][k] for w in ws if w in weight) for k, d in enumerate(domains)]
        e = [math.exp(x - max(logs)) for x in logs]
        m = [int(1000 * x / sum(e) + 0.5) for x in e]
        m[m.index(max(m))] += 1000 - sum(m)
        want[i, t or ""] = [want[i, t or ""][0] + len(ws), m]
    assert len(got) == len(want)
    seen = Counter((r["doc_id"], r["tokens"], tuple(round(1000 * r[f"p_{d}"]) for d in domains)) for r in got)
    near = Counter((i, n, tuple(m)) for (i, _), (n, m) in want.items())
    assert sum((seen - near).values()) <= 2  # a digit may fall on the other side of a half
    total = {d: sum(r["rate"] * r["tokens"] * r[f"p_{d}"] for r in got) for d in domains}
    assert all(abs(total[d] / sum(total.values()) - w) < 2e-4 for d, w in targets.items()) and {r["missed"] for r in got} < {x["missed"] for x in got} | {0}
    assert all(0 <= r["rate"] <= mixing.MAX_RATE and abs(r["copies"] - r["rate"]) <= 1 for r in got) and all(r["rate"] == 1 for r in got if r["tokens"] == 0)
    by_p = defaultdict(set)
    for r in got:
        if r["tokens"]:
            by_p[r["p_a"], r["p_b"], r["p_c"]].add(r["rate"])
    assert all(len(x) == 1 for x in by_p.values())


def test_rates_are_bounded_and_the_miss_is_told(spark):
    """Two long texts of one domain: the short ones of the other cannot be repeated often enough."""
    rows = [(1, "en " * 60_000, "en"), (2, "en " * 60_000, "en"), (3, "fr", "fr"), (4, None, "fr"), (5, "", None), (6, "en fr", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in mixing.mix(docs, labels, {"en": 0.5, "fr": 0.5}, lower=1.0).collect()}
    assert max(r["rate"] for r in got.values()) <= mixing.MAX_RATE and got[4]["rate"] == got[5]["rate"] == 1 and got[1]["missed"] > 0.3


def scalar_mix(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & M64
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & M64
    return x ^ (x >> 33)


def test_features_equal_a_scalar_version():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice("ab é\n#") for _ in range(rng.randint(0, 40)))
        want, ws = Counter(), text.encode().split()
        for i, w in enumerate(ws):
            want[scalar_mix(int(texthash.word_hashes(w)[0])) >> 47] += 1
            if i and ws[i - 1] == w:
                want[scalar_mix(12345) >> 47] += 1
        padded = bytes(32 if c in b" \n" else c for c in b" " + text.encode() + b" ") if ws else b""
        for k in quality_classifier.GRAMS:
            for i in range(len(padded) - k + 1):
                g = padded[i : i + k]
                if 32 not in g[1:-1]:
                    want[scalar_mix((int.from_bytes(g, "little") * 2 + (k << 40)) & M64) >> 47] += 1
        idx, cnt = quality_classifier.counted_features(text)
        assert dict(zip(idx.tolist(), cnt.tolist(), strict=True)) == want
    value = np.random.default_rng(1).standard_normal(quality_classifier.BUCKETS)
    idx, cnt = quality_classifier.counted_features("one two two")
    z = 0.25 + (value[idx] * cnt).sum() / cnt.sum()
    assert quality_classifier.scorer(value, 0.25)("one two two") == pytest.approx(1 / (1 + math.exp(-z)))


def test_long_texts_are_featurised_and_learnt_from_whole(spark):
    rng = random.Random(3)
    text = words(rng, 70_000, 10**6)  # more than two pieces of features and half a piece of hashes
    assert len(text) > quality_classifier.PIECE
    idx, cnt = quality_classifier.counted_features(text)
    n = len(text.split())
    grams = sum(max(0, len(w) + 2 - k + 1) for w in text.split() for k in quality_classifier.GRAMS)
    assert abs(cnt.sum() - n - grams) <= 12 * len(text) // quality_classifier.PIECE + 12
    rows = [(i, ("good " if i % 2 else "bad ") * (200_000 if i < 4 else 30)) for i in range(60)] + [(60, None), (None, "good"), (3, "good")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(61)], "doc_id long, quality int, toxic int")
    features, y = quality_classifier.sample(docs, labels)
    assert len(y) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(61)) and max(c.sum() for _, c in features) > 200_000
    few, _ = quality_classifier.sample(docs, labels, max_features=200)
    assert 0 < len(few) < len(y) and sum(len(i) for i, _ in few) <= 200
    got = quality_classifier.quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(r["predicted"] == r["doc_id"] % 2 for r in got if r["doc_id"] is not None and r["doc_id"] < 60)


def test_word_hashes_of_a_long_text():
    rng = random.Random(4)
    ws = [f"v{rng.randint(0, 50)}" for _ in range(400_000)]
    one = {w: texthash.word_hashes(w.encode())[0] for w in set(ws)}
    assert (texthash.word_hashes(" \n".join(ws).encode()) == np.array([one[w] for w in ws])).all()
    giant = b"x" * (3 << 20)
    assert len(texthash.word_hashes(b"a " + giant + b" b")) == 3 and texthash.word_hashes(giant + b" b")[0] == texthash.word_hashes(b"a " + giant)[1]


def test_blocks_of_long_and_repeated_documents(spark, tmp_path):
    rng = random.Random(5)
    texts = [(1, "a b " * 70_000), (2, words(rng, 50)), (2, words(rng, 50)), (2, None), (None, "none"), (3, " \n" * 400_000 + "x"), (4, "漢字 and é ²"), (5, "a<|endoftext|>b")]
    texts += [(10 + i, words(rng, 40)) for i in range(30)]
    to = f"file://{tmp_path}/blocks"
    bitpack.write_blocks(spark.createDataFrame(texts, "doc_id long, text string").repartition(4), to)
    lib = bitpack.load(bitpack.tokenizer_path(bitpack.TOKENIZER))
    want = Counter()
    for i, t in texts:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    got = sorted(bitpack.read_summaries(spark, to).collect(), key=lambda r: r["start"])
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in texts), key=lambda i: -1 if i is None else i)
    assert [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got])[:-1].tolist()
    assert spark.read.parquet(to).count() > 2


def test_encoder_cuts_long_texts_where_the_tokenizer_does(monkeypatch):
    path = bitpack.tokenizer_path(bitpack.TOKENIZER)
    encoder, lib, rng = bitpack.Encoder(path), bitpack.load(path), random.Random(7)
    monkeypatch.setattr(bitpack, "AT_ONCE", 48)
    monkeypatch.setattr(bitpack, "KNOWN", 300)
    texts = ["".join(rng.choice(" \t\n\r'abstmdrevl09AZ!?.éßÀ\x0b\x1c\x85\xa0²½漢　\U0001f600") for _ in range(rng.randint(0, 300))) for _ in range(500)]
    texts += ["", " " * 200, "\n" * 130 + "x", "x" * 400, "it's we'll 'S ''s\n's"]
    for t, x in zip(texts, encoder.all(texts), strict=True):
        assert x.tolist() == lib.encode(t, add_special_tokens=False).ids, t


def test_stable_code_points_are_cut_as_the_library_cuts():
    path = bitpack.tokenizer_path(bitpack.TOKENIZER)
    encoder, lib, rng = bitpack.Encoder(path), bitpack.load(path), random.Random(8)
    sure = np.flatnonzero(bitpack._classes() != bitpack._UNSURE).tolist()
    texts = ["".join(rng.choice("a 5!") + chr(i) for i in sure[k : k + 200]) for k in range(0, len(sure), 200)]
    for t, x in zip(texts, encoder.all(texts), strict=True):
        assert x.tolist() == lib.encode(t, add_special_tokens=False).ids


def test_bpe_over_several_chunks(monkeypatch):
    """The tasks' functions by themselves, with small chunks and few buckets."""
    monkeypatch.setattr(bpe, "CHUNK", 300)
    rng = random.Random(6)
    texts = [None, "", *[words(rng, rng.randint(1, 60), 40) for _ in range(40)], words(rng, 500, 40)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    dealt = pa.Table.from_batches(bpe._words(5)(iter([batch]))).sort_by("bucket")
    whole = pa.Table.from_batches(bpe._texts(5)(iter([batch])))
    ids = pa.Table.from_batches(bpe._encoded(bpe.tokenizer_path())(iter(dealt.to_batches())))
    assert whole.num_rows > 5
    run, _ = bpe._joined(bpe.tokenizer_path(), ("ids", "decoded"))
    lib, seen = bpe.load(bpe.tokenizer_path()), 0
    for row in range(whole.num_rows):
        chunk = whole["chunk"][row]
        made = run(None, whole.slice(row, 1), ids.filter(pa.compute.equal(ids["chunk"], chunk)))
        for doc, got, text in zip(made["doc_id"].to_pylist(), made["ids"].to_pylist(), made["decoded"].to_pylist(), strict=True):
            want = lib.encode(texts[doc] or "", add_special_tokens=False).ids
            assert got == want and text == lib.decode(want, skip_special_tokens=False)
            seen += 1
    assert seen == len(texts)


def test_bpe_of_null_ids_and_other_columns(spark):
    rows = [(None, "a b", 1), (None, "a b", 2), (3, None, 3)]
    got = bpe.bpe(spark.createDataFrame(rows, "doc_id long, text string, ids int")).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == {(None, 2): 2, (3, 0): 1}


def shards_of(spark, rows, leaves):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    return df, sharding.kd_shards(df, leaves=leaves).collect()


def test_equal_texts_share_a_shard_and_shards_are_even(spark):
    rng = random.Random(1)
    rows = [(i, words(rng, rng.randint(1, 60)), rng.choice(["en", "fr", None]), f"s{rng.randint(0, 5)}") for i in range(1200)]
    for k, copies in enumerate((2, 3, 40, 90, 150)):  # up to most of a leaf
        text = words(rng, 30)
        rows += [(2000 + 1000 * k + i, text, "en", "s1") for i in range(copies)]
    rows += [(9000, "same", "en", "s1"), (9000, "same", "en", "s1"), (None, "same", None, None), (9100, None, "a", "b"), (9101, "", "c", "d")]
    _, got = shards_of(spark, rows, 8)
    text_of = {(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())): r[1] or "" for r in rows}
    size, where, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in got:
        size[r["shard"]] += r["size"]
        where[text_of[r["doc_id"], r["size"], r["text_crc32"]]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    leaf = sum(size.values()) / 8
    assert len(got) == len(rows) and all(len(s) == 1 for s in where.values())
    assert all(abs(x - leaf) < 0.04 * leaf for x in size.values()) and len(size) == 8
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_a_group_larger_than_a_leaf_fills_whole_shards(spark):
    rng = random.Random(2)
    rows = [(i, "the same text over and over", "en", "s") for i in range(3000)] + [(5000 + i, words(rng, 6), "fr", "t") for i in range(2500)]
    _, got = shards_of(spark, rows, 6)
    size, hot = Counter(), Counter()
    for r in got:
        size[r["shard"]] += r["size"]
        hot[r["shard"]] += r["doc_id"] < 5000
    assert max(size.values()) < 1.06 * sum(size.values()) / 6 and min(size.values()) > 0.94 * sum(size.values()) / 6
    assert sum(x > 0 for x in hot.values()) == math.ceil(3000 * 28 * 6 / sum(size.values()))


@pytest.mark.parametrize("leaves", [2, 5])
def test_tree_equals_plain_recursion(spark, leaves):
    """Each node: the dimension of widest spread, a cut as near to the wanted weight as values allow, and the shards that follow from it."""
    rng = random.Random(leaves)
    rows = [(i, words(rng, rng.randint(1, 40)), rng.choice(["en", "fr", "de"]), f"s{rng.randint(0, 9)}") for i in range(700)]
    df, got = shards_of(spark, rows, leaves)
    light, heavy, room = sharding.points(df, None, leaves)
    assert heavy.count() == 0
    pts = [r.asDict() for r in light.collect()]
    root = sharding.kd_tree(light, room)
    spread = {d: max(p[d] for p in pts) - min(p[d] for p in pts) for d in sharding.DIMS}
    leaf, found = sum(p["size"] for p in pts) / leaves, {}

    def descend(node, inside):
        if node.low is None:
            found.update({p["doc_id"]: node.first for p in inside})
            return
        widest = max(sharding.DIMS, key=lambda d: ((max(p[d] for p in inside) - min(p[d] for p in inside)) / max(1, spread[d]), -sharding.DIMS.index(d)))
        assert node.dim == widest
        below = [p for p in inside if p[widest] < node.cut]
        want = sum(p["size"] for p in inside) * sum(node.low.room) / sum(node.room)
        values, best, run = sorted((p[widest], p["size"]) for p in inside), math.inf, 0
        for _, w in values:
            best = min(best, abs(run - want))
            run += w
        assert abs(sum(p["size"] for p in below) - want) <= best + 0.011 * leaf
        descend(node.low, below)
        descend(node.high, [p for p in inside if p[widest] >= node.cut])

    descend(root, pts)
    assert {r["doc_id"]: r["shard"] for r in got} == found


def test_fingerprints_of_null_and_repeated_ids(spark):
    rows = [(None, "none"), (5, "a\nb"), (5, "a\nb"), (5, "c"), (7, None), (9, "é" * 9)]
    got = fingerprint.edited_fingerprints(spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, rng int, halo string")).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(i for i, _ in rows)
    assert {r["near_next"] for r in got if r["doc_id"] == 5} == {0.0, 1.0}


def test_ranges_follow_one_another_over_many_spans(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "SPAN", 3)
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 1)
    rows = [(i * i, f"text {i}") for i in range(300)]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    own = {r["doc_id"]: r for r in got}
    for i in range(300):
        after = rows[i - 1][1]
        t = rows[i][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        import hashlib

        assert own[i * i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_ranges_of_null_far_clumped_and_hot_ids_are_bounded(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, f"text {rng.random()} " * rng.randint(0, 5)) for i in range(1000)] + [(None, None), (None, "a"), (None, "b" * 40), (2**62, "far"), (-(2**62), "far down"), (2**63 - 1, None)]
    rows += [(7_000_000 + i // 3, f"clump {i}") for i in range(900)] + [(555_555, f"{k} hot {rng.random()}") for k in range(700)] + [(None, f"{k} null") for k in range(600)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for name, value in (("RANGE_ROWS", 50), ("QUANTILES", 5), ("SPAN", 7)):
        monkeypatch.setattr(fingerprint, name, value)
    sizes = [r["count"] for r in fingerprint.with_ranges(docs.selectExpr("doc_id", "coalesce(text, '') as text")).groupBy("rng").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) <= 50
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in fingerprint.edited_fingerprints(docs).collect()) == edited_in_order(rows)


def edited_in_order(rows):
    """Descending doc_id, then text, nulls last; each text's last third from the next one."""
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()), reverse=True)
    texts = [t or "" for _, t in order]
    return Counter(
        (i, len(t), hashlib.sha256((t[: len(t) - len(t) // 3] + texts[(k + 1) % len(texts)][: len(t) // 3]).encode()).hexdigest()) for k, ((i, _), t) in enumerate(zip(order, texts, strict=True))
    )


def test_null_ids_in_a_table_of_a_thousand_rows(spark):
    rows = [(i, f"t {i}") for i in range(1000)] + [(None, "none"), (None, None), (3, "again")]
    got = fingerprint.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == edited_in_order(rows)


def test_a_text_of_a_million_words_is_counted():
    n, words_, symbols, dup, repeat, lines = quality_rules.count_text("a b c d\n" * 250_000)
    assert (n, words_, symbols, dup, repeat, lines) == (10**6, 10**6, 0, 249_999, 10**6, 250_000)
    text = " ".join(f"w{i}" for i in range(10**6))
    assert quality_rules.count_text(text)[:5] == (10**6, len(text) - 10**6 + 1, 0, 0, 0)


def test_a_tree_without_an_id_is_a_conversation(spark):
    rows = [(None, 1, None, "user", "hi", 0.0), (None, 2, 1, "assistant", "yo", 0.0), ("t", None, None, "user", "alone", 0.0)]
    df = spark.createDataFrame(rows, "tree string, msg long, parent long, role string, text string, score double")
    made = chat.ranked(chat.conversations(df))
    assert sorted((str(r["tree"]), str(r["leaf"]), r["n_turns"], r["rank"]) for r in made.collect()) == [("None", "2", 2, 1), ("t", "None", 1, 1)]
    assert chat.best_per_tree(made).count() == 2


def test_rules_of_hosts_in_capitals_and_clashing_columns(spark):
    rules = spark.createDataFrame([("Example.COM", "/a", "block")], "host string, path string, action string")
    pages = spark.createDataFrame([(1, "http://www.example.com/ab", "x", "y")], "page_id long, url string, host string, verdict string")
    row = urlfilter.filter_urls(pages, rules).first()
    assert (row["rule"], row["verdict"], row["host"]) == ("Example.COM/a", "block", "www.example.com") or (row["rule"].lower(), row["verdict"]) == ("example.com/a", "block")


def test_verdicts_on_ties_and_repeated_rows(spark):
    rows = [(1, " ".join(f"w{i}" for i in range(60)), None, None)] * 3 + [(None, None, "en", "a"), (2, "x " * 200_000, "en", "a")]
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert Counter((r["doc_id"], r["kept"]) for r in got) == {(1, True): 3, (None, False): 1, (2, False): 1}
    assert next(r["n_repeat_words"] for r in got if r["doc_id"] == 2) == 200_000


def test_the_pipeline_of_an_empty_table(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, docs, "/root/testdata/sf0.001")
        assert after.columns == docs.columns and after.count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs, None).count() == 0
