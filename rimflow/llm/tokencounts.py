"""Token counts behind a cache that is keyed by digests.

A count depends on a text's content and on the tokenizer alone. So it is kept under two digests: that of the normalised
content, and that of the tokenizer's version (its file, its library's version and the way contents are normalised).
The cache is a Parquet folder with a part for each tokenizer version and rows (digest, n_tokens).

1. Every row of the input gets the digest of its normalised content (`stored`: doc_id, n_bytes, digest; no text).
2. Distinct digests without a count in the cache are the misses (an anti join of narrow rows).
3. The contents of the misses, one for each digest, are encoded, and their counts appended to the cache. Partial
   aggregation leaves one copy of a content in each task before the shuffle, so a text that many rows share is no hot key.
4. Rows are joined with the counts of their digests. The join is a shuffled one of narrow rows, which the adaptive planner
   splits where a digest is frequent.

Normalising must not change a count. For a tokenizer that lower-cases, collapses white space and drops it (word_bpe_49k)
a content is its words in lower-case ASCII, joined by one space; a text in which a special token's string
occurs in any case of letters keeps its case. For all other tokenizers the content is the text itself.

Appending is safe to repeat: a job that fails or runs beside another one may leave counts twice or in part, which are equal and
are read once. A digest whose count is missing in the end stops the job (the input is evaluated twice and must come out alike).

Defined results: a null text is an empty one (0 bytes, 0 tokens); repeated rows, and rows with a null or repeated doc_id, each
give a row; doc_ids are cast to long; a text of any length is encoded whole, in the memory of one row; other columns are not
read, so none clashes; an empty table gives an empty result and appends nothing.
"""

from __future__ import annotations

import functools
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import TOKENIZER, load, tokenizer_path
from .shared import counted, job_settings, shared_dir, stored, table

LIMIT = 2048
#: Part of a tokenizer's version: change it with what `Counter.content` does.
NORMALISED = "content-1"
#: Words that a worker keeps with their counts.
KNOWN_WORDS = 1_000_000
CACHE_SCHEMA = "digest binary, n_tokens long"


class Counter:
    """Counts the tokens of contents; path is a .json file of tokenizers or a .model file of sentencepiece."""

    def __init__(self, path: str):
        self.piece = path.endswith(".model")
        self.by_words, self.special, self.known = False, [], {}
        if self.piece:
            import sentencepiece

            self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        self.lib = load(path)
        self.special = [t.content.lower().encode() for t in self.lib.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [x.get("type") for x in (made.get("normalizer") or {}).get("normalizers", [])]
        cut = ((made.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        drops_space = cut.get("type") == "Split" and cut.get("behavior") == "Removed" and cut.get("invert")
        self.by_words = steps == ["NFC", "Replace", "Lowercase"] and bool(drops_space) and not any(s.split() != [s] for s in self.special)

    def content(self, text: str | None) -> bytes:
        """The normalised content, which has as many tokens as the text."""
        raw = (text or "").encode("utf-8", "surrogatepass")
        if not self.by_words:
            return raw
        low = raw.lower()
        return b" ".join((raw if any(s in low for s in self.special) else low).split())

    def counts(self, contents: list[bytes]) -> list[int]:
        if self.by_words:
            return [self._by_words(c.split()) for c in contents]
        texts = [c.decode("utf-8", "surrogatepass") for c in contents]
        if self.piece:
            return [len(x) for x in self.lib.encode(texts, num_threads=1)] if texts else []
        return [len(e.ids) for e in self.lib.encode_batch(texts, add_special_tokens=False)]

    def _by_words(self, words: list[bytes]) -> int:
        """Words are encoded independently of one another, so each is encoded once."""
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            if len(self.known) > KNOWN_WORDS:
                self.known.clear()
            new = [w for w in dict.fromkeys(words) if w not in self.known]
            got = self.lib.encode_batch([w.decode("utf-8", "surrogatepass") for w in new], add_special_tokens=False)
            self.known.update((w, len(e.ids)) for w, e in zip(new, got, strict=True))
            return sum(map(self.known.__getitem__, words))


@functools.lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    """One for all tasks of a Python worker."""
    return Counter(path)


def version_of(path: str) -> str:
    """The digest of the tokenizer's version."""
    import sentencepiece
    import tokenizers

    library = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{library} {NORMALISED} ".encode() + f.read()).hexdigest()


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=32).digest()


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            digests = pa.array([_digest(counter.content(x.as_py())) for x in batch.column(2)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], ["doc_id", "n_bytes", "digest"])

    return run


def _contents(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            found = {_digest(c): c for c in (counter.content(x.as_py()) for x in batch.column(0))}
            yield pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.binary())], ["digest", "content"])

    return run


def _counted(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counter.counts(batch.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def cached(spark: SparkSession, at: str) -> DataFrame | None:
    """The counts of one tokenizer version, each digest once; None before the first."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(at).dropDuplicates(["digest"])
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def token_counts(docs: DataFrame, cache: str, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every row; `cache` is the folder of the counts."""
    path, spark = path or tokenizer_path(TOKENIZER), docs.sparkSession
    at = f"{cache.rstrip('/')}/tokenizer={version_of(path)}"
    text = docs.select("text")
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    rows = stored(narrow.mapInArrow(_digests(path), "doc_id long, n_bytes long, digest binary"), "digests")
    known = cached(spark, at)
    contents = text.mapInArrow(_contents(path), "digest binary, content binary")
    if known is not None:
        misses = stored(rows.select("digest").distinct().join(known, "digest", "left_anti"), "misses")
        contents = contents.join(counted(misses), "digest", "left_semi") if not misses.isEmpty() else None
    if contents is not None:
        new = contents.dropDuplicates(["digest"]).mapInArrow(_counted(path), CACHE_SCHEMA)
        with job_settings(docs):
            new.write.mode("append").parquet(at)
    # stored, so that only the join stands behind its exchanges and rows of a frequent digest can be dealt to several tasks
    found = rows.join(stored(cached(spark, at), "counts"), "digest", "left").withColumn(
        "n_tokens", F.coalesce("n_tokens", F.raise_error(F.lit("the input differs from one evaluation to the next: a content has no count")).cast("long"))
    )
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a cache of its own, so that every content is a miss and each call does the whole work."""
    return stored(token_counts(table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/rimflow-{uuid.uuid4().hex}/token_cache"), "counts")
