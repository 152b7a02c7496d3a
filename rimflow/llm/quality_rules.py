"""Quality rules whose thresholds follow the data: mergeable quantile sketches per language and source.

Each document gets exact counts (words, symbols, repeated lines, repeated three-word windows). The
method then asks, for each of a few ratios, whether the document lies far outside what its own
language and source usually show. "Usually" is read from quantile sketches: every value keeps its BITS
leading binary digits (a relative error of less than 1/128) and the sketch of a group is the count of each
rounded value. Such sketches merge by adding counts, so partial sketches are combined before the
shuffle, a language's sketch is the sum of its sources' and the whole corpus' the sum of those.

The sketches are made of the documents that pass the base rule: what it rejects would only hide what is usual.

A group with fewer than `min_rows` documents takes the thresholds of its language, and a language with
fewer than that those of the corpus. A document fails a rule when its ratio is above

    high + times * max(high - low, one unit of the sketch's resolution)

of its group, where low and high are two quantiles of the ratio. Which quantiles these are is a setting of each rule: quartiles
where all documents have the ratio to some degree (word length), the median and a quantile further up where most documents have none
(symbols, repeated lines, repeated windows), so that the spread is seen and not supposed. There is no fixed cutoff: a limit moves with the
group's own quantiles, upwards and downwards. Nothing is sampled and all documents count.

Defined results: a null text has no words and fails the base rule; null lang or source form a group of
their own; repeated rows, and rows without a doc_id, each count and are judged by themselves; an empty table
gives an empty result; texts of any length are counted whole, in the memory of one text; columns of the input that are named like a computed column are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import ROW_KEY, counted, keyed_filter, stored, table, with_row_key

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: ratio (in thousandths): numerator, denominator, low and high quantile in hundredths, times
RATIOS = {
    "r_symbols": ("n_symbols", "n_words", 50, 90, 3),
    "r_dup_lines": ("n_dup_lines", "n_lines", 50, 99, 1),
    "r_repeats": ("n_repeat_words", "n_words", 50, 95, 3),
    "r_word_length": ("word_chars", "n_words", 25, 75, 3),
}
BITS = 8
MIN_ROWS = 200
Rules = dict[str, tuple[str, str, int, int, int]]


def count_text(text: str | None) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines that have a word."""
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, WHITE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup = lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
            lines += 1
        elif line.strip(WHITE):
            seen.add(line)
            lines += 1
    repeat = 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(windows)) < len(windows):
            first: dict[tuple, int] = {}
            marked = bytearray(n)
            for i, w in enumerate(windows):
                if (j := first.setdefault(w, i)) != i:
                    marked[i : i + 3] = marked[j : j + 3] = b"\1\1\1"
            repeat = sum(marked)
    return n, word_chars, n_symbols, dup, repeat, lines


def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        k = batch.schema.get_field_index("text")
        rows = [count_text(x.as_py()) for x in batch.column(k)]
        cols = list(zip(*rows, strict=True)) or [[] for _ in COUNTS]
        rest = [i for i in range(batch.num_columns) if i != k]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in rest] + [pa.array(c, pa.int64()) for c in cols],
            [batch.schema.names[i] for i in rest] + list(COUNTS),
        )


def quality_counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """The counts of every document beside the columns named in keep (the text itself is not returned)."""
    narrow = docs.select(*keep, "text")
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "text"] + [T.StructField(c, T.LongType()) for c in COUNTS])
    return narrow.mapInArrow(_with_counts, schema)


def _ratios(counts: DataFrame) -> DataFrame:
    for name, (top, bottom, *_) in RATIOS.items():
        counts = counts.withColumn(name, F.expr(f"if({bottom} > 0, ({top} * 1000) div {bottom}, 0)"))
    return counts.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))


def _rounded(x: str) -> str:
    """x with its BITS leading binary digits."""
    drop = f"cast(greatest(length(bin({x})) - {BITS}, 0) as int)"
    return f"shiftleft(shiftright({x}, {drop}), {drop})"


def sketches(ratios: DataFrame) -> DataFrame:
    """lang, source, ratio, v, n: how often each rounded value occurs in each group, among documents that pass the base rule."""
    stacked = ", ".join(f"'{r}', {r}" for r in RATIOS)
    long = ratios.where("not base_failed").selectExpr("coalesce(lang, '\\0') as g_lang", "coalesce(source, '\\0') as g_source", f"stack({len(RATIOS)}, {stacked}) as (ratio, x)")
    return long.groupBy("g_lang", "g_source", "ratio", F.expr(_rounded("x")).alias("v")).agg(F.count("*").alias("n"))


def _by_ratio(rules: Rules, k: int) -> str:
    return "case ratio " + " ".join(f"when '{r}' then {x[k]}" for r, x in rules.items()) + " end"


def _fences(sketch: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """For each group and ratio: rows, the quantiles by cumulated counts, and the fence."""
    merged = sketch.groupBy(*keys, "ratio", "v").agg(F.sum("n").alias("n"))
    by = ", ".join([*keys, "ratio"])
    run = merged.selectExpr("*", f"sum(n) over (partition by {by} order by v) as upto", f"sum(n) over (partition by {by}) as total")
    q = run.groupBy(*keys, "ratio").agg(
        F.max("total").alias("total"),
        F.min(F.expr(f"if(100 * upto >= {_by_ratio(rules, 2)} * total, v, null)")).alias("low"),
        F.min(F.expr(f"if(100 * upto >= {_by_ratio(rules, 3)} * total, v, null)")).alias("high"),
    )
    unit = f"shiftleft(1L, cast(greatest(length(bin(high)) - {BITS}, 0) as int))"
    return q.selectExpr(*keys, "ratio", "total", f"high + {_by_ratio(rules, 4)} * greatest(high - low, {unit}) as fence")


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS, rules: Rules = RATIOS) -> DataFrame:
    """One row for each language and source: the limit of each ratio, from the narrowest group with min_rows documents."""
    own = _fences(sketch, ["g_lang", "g_source"], rules)
    lang = _fences(sketch, ["g_lang"], rules).select("g_lang", "ratio", F.col("total").alias("l_total"), F.col("fence").alias("l_fence"))
    whole = _fences(sketch, [], rules).select("ratio", F.col("fence").alias("w_fence"))
    joined = own.join(lang, ["g_lang", "ratio"]).join(whole, "ratio")
    limit = joined.withColumn("top", F.expr(f"case when total >= {min_rows} then fence when l_total >= {min_rows} then l_fence else w_fence end"))
    return limit.groupBy("g_lang", "g_source").agg(*[F.max(F.when(F.col("ratio") == r, F.col("top"))).alias(f"max_{r}") for r in rules])


def quality_verdicts(docs: DataFrame, min_rows: int = MIN_ROWS, keep: tuple[str, ...] = ("doc_id",), rules: Rules = RATIOS) -> DataFrame:
    """The columns named in keep, the counts, base_failed, failed (the rules that the document fails) and kept, for every row of docs.

    The limits have a row for each language and source; where they are few they are broadcast, so that the rows of a
    frequent source stay dealt out as they are.
    """
    ratios = stored(_ratios(quality_counts(docs, (*keep, "lang", "source"))), "quality_counts")
    limits = counted(stored(thresholds(sketches(ratios), min_rows, rules), "limits"))
    keyed = ratios.withColumn("g_lang", F.expr("coalesce(lang, '\\0')")).withColumn("g_source", F.expr("coalesce(source, '\\0')"))
    judged = keyed.join(limits, ["g_lang", "g_source"], "left")
    broken = F.filter(F.array(*[F.when(F.col(r) > F.col(f"max_{r}"), F.lit(r)) for r in RATIOS]), lambda x: x.isNotNull())
    return judged.select(*keep, *COUNTS, "base_failed", broken.alias("failed")).withColumn(
        "kept", ~F.col("base_failed") & (F.size("failed") == 0)
    )


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def keep_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str | None = None) -> DataFrame:
    """The rows of docs that the rules keep."""
    keyed = with_row_key(docs, "doc_id", "text", "lang", "source")
    rejected = stored(quality_verdicts(keyed, keep=tuple(ROW_KEY)).where("not kept").select(*ROW_KEY).distinct(), "rejected")
    return keyed_filter(keyed, rejected, ROW_KEY, "left_anti").drop(*ROW_KEY)


def _sql_fences(keys: str) -> str:
    by = f"{keys}, ratio" if keys else "ratio"
    return f"""(
  select {by}, total, high + {_by_ratio(RATIOS, 4)} * greatest(high - low, 1::bigint << greatest(length(bin(high)) - {BITS}, 0)) as fence
  from (select {by}, max(total) as total, min(case when 100 * upto >= {_by_ratio(RATIOS, 2)} * total then v end) as low, min(case when 100 * upto >= {_by_ratio(RATIOS, 3)} * total then v end) as high
        from (select {by}, v, sum(n) over (partition by {by} order by v) as upto, sum(n) over (partition by {by}) as total
              from (select {by}, v, sum(n) as n from sketch group by {by}, v) m) r
        group by {by}) q)"""


OP9_SQL = (
    r"""
with base as (
  select doc_id, coalesce(lang, chr(1)) as lang, coalesce(source, chr(1)) as source, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from documents
), placed as (
  select doc_id, unnest(ws) as w, unnest(generate_series(1, len(ws))) as i from base
), windows as (
  select doc_id, i, w, lead(w, 1) over (partition by doc_id order by i) as w2, lead(w, 2) over (partition by doc_id order by i) as w3 from placed
), again as (
  select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, w, w2, w3) as c from windows where w3 is not null) x where c > 1
), repeated as (
  select doc_id, count(distinct i + d) as n_repeat_words from again, (values (0), (1), (2)) as v(d) group by doc_id
), counts as (
  select b.doc_id, lang, source, cast(len(ws) as bigint) as n_words, cast(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
         cast(coalesce(n_repeat_words, 0) as bigint) as n_repeat_words, cast(len(ls) as bigint) as n_lines
  from base b left join repeated r on b.doc_id = r.doc_id
), ratios as ("""
    + " union all ".join(
        f"select doc_id, lang, source, '{r}' as ratio, case when {bottom} > 0 then ({top} * 1000) // {bottom} else 0 end as x from counts where not (n_words < 50 or 100 * n_repeat_words > 50 * n_words)"
        for r, (top, bottom, *_) in RATIOS.items()
    )
    + f"""), sketch as (
  select lang, source, ratio, (x >> greatest(length(bin(x)) - {BITS}, 0)) << greatest(length(bin(x)) - {BITS}, 0) as v, count(*) as n from ratios group by all
), verdicts as (
  select a.doc_id, bool_or(a.x > case when o.total >= {MIN_ROWS} then o.fence when l.total >= {MIN_ROWS} then l.fence else w.fence end) as failed
  from ratios a join {_sql_fences('lang, source')} o on a.lang = o.lang and a.source = o.source and a.ratio = o.ratio
       join {_sql_fences('lang')} l on a.lang = l.lang and a.ratio = l.ratio join {_sql_fences('')} w on a.ratio = w.ratio
  group by a.doc_id
)
select c.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and not coalesce(failed, false) as kept
from counts c left join verdicts v on c.doc_id = v.doc_id
"""
)
