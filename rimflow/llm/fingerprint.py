r"""Document fingerprints: a Merkle tree over sections and paragraphs.

Sections are parted by empty lines, paragraphs by line breaks. A paragraph's digest is the SHA-256 of its text; a
section's is that of its paragraphs' digests joined; the root is that of the sections' digests joined. So equal roots
mean equal texts, and where roots differ, differing sections and then paragraphs lead to the edits (`changed`). Below a
paragraph lie its pieces of PIECE code points, so that an edit inside a long paragraph is placed and weighed.

The fingerprint is one string: root;section;section... with a section as digest:paragraph,paragraph... and a paragraph
as its digest and its pieces' digests, all of them shortened to 8 hexadecimal digits but the root.

Likeness of two fingerprints is 1 when the roots are equal, and otherwise the Dice coefficient of the sets of their
pieces' digests (0 if neither has any).

Next documents (descending doc_id, after the last the first) come without ordering all documents in one task: rows are cut
into ranges by quantiles of their doc_ids, ranges of more than RANGE_ROWS rows again by quantiles of their own, and those of a single
doc_id (or of none) by the first bytes of their texts, until none is too large. So far ids, clumps of ids and hot ids do no
harm. A window orders each range, and the first document of each range is also sent to the range before. Texts are shuffled once.

Defined results: null texts are empty; of rows with equal doc_id the next is by text; a single document is its own next
one; null doc_ids come last; doc_ids are cast to long; a text of any length is fingerprinted whole, in the memory of one row;
rows that agree in doc_id and in the first seven bytes of the text are in one range; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import counted, stored, table

PIECE = 32
SHORT = 8
#: Parts into which quantiles cut a range that has more than RANGE_ROWS rows, and how often that is done at most.
QUANTILES = 200
RANGE_ROWS = 4000
LEVELS = 6
SPAN = 4096


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, SHORT)


def _paragraph(text: Column) -> Column:
    pieces = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda x: _short(F.md5(x.cast("binary"))))
    return F.struct(F.sha2(text.cast("binary"), 256).alias("digest"), F.array_join(pieces, "").alias("pieces"))


def fingerprint(text: Column) -> Column:
    sections = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.split(s, "\n", -1), _paragraph))
    summed = F.transform(
        sections,
        lambda ps: F.struct(
            F.sha2(F.array_join(F.transform(ps, lambda p: p["digest"]), "").cast("binary"), 256).alias("digest"),
            F.array_join(F.transform(ps, lambda p: F.concat(_short(p["digest"]), p["pieces"])), ",").alias("rest"),
        ),
    )
    root = lambda a: F.sha2(F.array_join(F.transform(a, lambda s: s["digest"]), "").cast("binary"), 256)
    written = lambda a: F.array_join(F.transform(a, lambda s: F.concat(_short(s["digest"]), F.lit(":"), s["rest"])), ";")
    # through one array of one element, so that the tree is built once and not for each use
    return F.element_at(F.transform(F.array(summed), lambda a: F.concat(root(a), F.lit(";"), written(a))), 1)


def pieces(fp: Column) -> Column:
    """The different digests of the pieces of a fingerprint."""
    paragraphs = F.regexp_extract_all(F.substring(fp, 65, 1 << 30), F.lit(r"[:,]([0-9a-f]*)"), F.lit(1))
    joined = F.array_join(F.transform(paragraphs, lambda p: F.substring(p, SHORT + 1, 1 << 30)), "")
    return F.array_distinct(F.regexp_extract_all(joined, F.lit(f".{{{SHORT}}}"), F.lit(0)))


def likeness_of(fp_a: Column, fp_b: Column, pieces_a: Column, pieces_b: Column) -> Column:
    both = F.size(F.array_intersect(pieces_a, pieces_b))
    all_ = F.size(pieces_a) + F.size(pieces_b)
    return F.when(F.substring(fp_a, 1, 64) == F.substring(fp_b, 1, 64), F.lit(1.0)).when(all_ == 0, F.lit(0.0)).otherwise(2.0 * both / all_)


def likeness(fp_a: Column, fp_b: Column) -> Column:
    return likeness_of(fp_a, fp_b, pieces(fp_a), pieces(fp_b))


def changed(fp_a: Column, fp_b: Column) -> Column:
    """(section, paragraph) numbers from 0 of fp_a that fp_b has not at the same place: branches with equal digests are not opened."""
    a, b = F.split(fp_a, ";"), F.split(fp_b, ";")
    section = lambda x: F.split(F.split(x, ":")[1], ",")
    numbers = F.sequence(F.lit(1), F.size(a) - 1)
    differ = lambda i: F.filter(
        F.transform(section(F.get(a, i)), lambda p, k: F.struct((i - 1).alias("section"), k.alias("paragraph"), p.alias("p"))),
        lambda x: ~x["p"].eqNullSafe(F.get(section(F.get(b, i)), x["paragraph"])),
    )
    found = F.flatten(F.transform(numbers, lambda i: F.when(F.get(a, i).eqNullSafe(F.get(b, i)), F.filter(differ(i), lambda x: F.lit(False))).otherwise(differ(i))))
    return F.transform(found, lambda x: F.struct(x["section"], x["paragraph"]))


#: The first seven bytes of a text as a number; texts are ordered by their bytes.
_PREFIX = "cast(conv(rpad(hex(substring(cast(text as binary), 1, 7)), 14, '0'), 16, 10) as bigint)"


def _within(cuts: DataFrame, rows: DataFrame) -> DataFrame:
    """rows with rng replaced by the part of the range that cuts (rng, by_text, cuts) put them in."""
    part = "coalesce(size(filter(cuts, c -> c <= if(by_text, p, i))), 0)"
    return rows.join(counted(cuts), "rng", "left").withColumn("rng", F.expr(f"rng * {2 * QUANTILES} + {part}")).drop("by_text", "cuts")


def with_ranges(rows: DataFrame) -> DataFrame:
    """doc_id, text, p (the text's first bytes) and rng: ranges of about RANGE_ROWS rows at most, whose numbers ascend with (doc_id, text)."""
    keyed = rows.selectExpr("doc_id", "text", f"{_PREFIX} as p", "coalesce(doc_id, 0) as i", "if(doc_id is null, 0L, 1L) as rng")
    narrow = stored(keyed.select("i", "p", "rng"), "keys")
    fractions = [k / QUANTILES for k in range(1, QUANTILES)]
    quantiles = lambda c: F.percentile_approx(c, fractions, 20 * QUANTILES)
    for level in range(LEVELS):
        each = narrow.groupBy("rng").agg(F.count("*").alias("n"), F.min("i").alias("lo"), F.max("i").alias("hi"), F.min("p").alias("p_lo"), F.max("p").alias("p_hi"), quantiles("i").alias("by_i"), quantiles("p").alias("by_p"))
        large = each.where(f"n > {RANGE_ROWS} and (lo < hi or p_lo < p_hi)" if level else "true")
        # a number that fills a quantile is parted from the next one too
        cuts = large.selectExpr("rng", "lo = hi as by_text", "array_distinct(if(lo = hi, by_p, by_i)) as q").selectExpr("rng", "by_text", "array_union(q, filter(transform(q, x -> try_add(x, 1L)), x -> x is not null)) as cuts")
        cuts = stored(cuts, "cuts")
        if level and cuts.isEmpty():
            break
        keyed, narrow = _within(cuts, keyed), _within(cuts, narrow)
    return keyed.drop("i")


def in_ranges(docs: DataFrame) -> DataFrame:
    """doc_id, text, rng, halo: every document in its range of doc_ids, and the first of each range (halo) once more in
    the range that comes before it in descending order; the very first also after the last."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ranged = with_ranges(rows)
    tops = ranged.groupBy("rng").agg(F.max(F.struct("doc_id", "p")).alias("t"))
    # each range's successor, or the first for the last: within SPAN ranges by a window for each span, between spans by one over the spans
    tops = stored(tops, "ranges").selectExpr("rng", "t.doc_id as top_id", "t.p as top_p", f"rng div {SPAN} as span")
    spans = tops.groupBy("span").agg(F.min("rng").alias("head")).selectExpr("span", "coalesce(lead(head) over (order by span), min(head) over ()) as after")
    tops = tops.withColumn("next", F.expr("lead(rng) over (partition by span order by rng)")).join(spans, "span").selectExpr("rng", "top_id", "top_p", "coalesce(next, after) as to")
    with_top = ranged.join(counted(stored(tops, "successors")), "rng", "left")
    own = F.struct(F.col("rng"), F.lit(0).alias("halo"))
    copies = F.when(F.expr("doc_id <=> top_id and p = top_p"), F.array(own, F.struct(F.col("to").alias("rng"), F.lit(1).alias("halo")))).otherwise(F.array(own))
    return with_top.select("doc_id", "text", F.explode(copies).alias("c")).select("doc_id", "text", "c.rng", "c.halo")


def op7_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(edited_fingerprints(table(spark, sf_dir, "documents")), "fingerprints")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    order = "over (partition by rng order by halo, doc_id desc, text desc)"
    rows = in_ranges(docs).selectExpr("*", "cast(length(text) as bigint) as n_chars", f"lead(text) {order} as next_text")
    edited = rows.withColumn("edited", F.expr("concat(substring(text, 1, cast(n_chars - n_chars div 3 as int)), substring(next_text, 1, cast(n_chars div 3 as int)))"))
    # a halo row of the wrong end is dropped below; its edited text is never made
    printed = edited.select(
        "doc_id", "n_chars", "rng", "halo", "text",
        fingerprint(F.col("text")).alias("fingerprint"),
        F.when(F.col("halo") == 0, F.sha2(F.col("edited").cast("binary"), 256)).alias("edited_sha256"),
        F.when(F.col("halo") == 0, fingerprint(F.col("edited"))).alias("edited_fingerprint"),
    )
    with_next = printed.selectExpr("*", f"lead(fingerprint) {order} as next_fingerprint").where("halo = 0")
    own = with_next.withColumn("own", pieces(F.col("fingerprint")))
    like = lambda other: likeness_of(F.col("fingerprint"), F.col(other), F.col("own"), pieces(F.col(other)))
    return own.select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        like("edited_fingerprint").alias("near_edited"), like("next_fingerprint").alias("near_next"),
    )


OP7_SQL = r"""
with recursive docs as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id desc, coalesce(text, '') desc) as k, count(*) over () as n from documents
), paired as (
  select a.doc_id, a.text, length(a.text) as n_chars, b.k as next_k,
         substr(a.text, 1, length(a.text) - length(a.text) // 3) || substr(b.text, 1, length(a.text) // 3) as edited, a.k
  from docs a join docs b on b.k = case when a.k = a.n then 1 else a.k + 1 end
), texts as (
  select k, 0 as kind, text as t from paired union all select k, 1 as kind, edited as t from paired
), paragraphs as (
  select k, kind, s.no as s_no, p.no as p_no, sha256(p.pt) as digest,
         array_to_string(list_transform(regexp_extract_all(p.pt, '(?s).{1,32}'), lambda x: substr(md5(x), 1, 8)), '') as pieces
  from texts,
       lateral (select unnest(string_split(texts.t, chr(10) || chr(10))) as st, unnest(generate_series(1, len(string_split(texts.t, chr(10) || chr(10))))) as no) s,
       lateral (select unnest(string_split(s.st, chr(10))) as pt, unnest(generate_series(1, len(string_split(s.st, chr(10))))) as no) p
), sections as (
  select k, kind, s_no, sha256(string_agg(digest, '' order by p_no)) as digest,
         string_agg(substr(digest, 1, 8) || pieces, ',' order by p_no) as rest, string_agg(pieces, '' order by p_no) as pieces
  from paragraphs group by k, kind, s_no
), prints as (
  select k, kind, sha256(string_agg(digest, '' order by s_no)) as root,
         sha256(string_agg(digest, '' order by s_no)) || ';' || string_agg(substr(digest, 1, 8) || ':' || rest, ';' order by s_no) as fp,
         list_distinct(regexp_extract_all(string_agg(pieces, '' order by s_no), '.{8}')) as pieces
  from sections group by k, kind
), joined as (
  select p.doc_id, p.n_chars, p.edited, a.fp, e.fp as e_fp, a.root, e.root as e_root, x.root as x_root, a.pieces, e.pieces as e_pieces, x.pieces as x_pieces
  from paired p join prints a on a.k = p.k and a.kind = 0 join prints e on e.k = p.k and e.kind = 1 join prints x on x.k = p.next_k and x.kind = 0
)
select doc_id, n_chars, sha256(edited) as edited_sha256, fp as fingerprint, e_fp as edited_fingerprint,
       case when root = e_root then 1.0 when len(pieces) + len(e_pieces) = 0 then 0.0
            else 2.0::double * len(list_intersect(pieces, e_pieces)) / (len(pieces) + len(e_pieces)) end::double as near_edited,
       case when root = x_root then 1.0 when len(pieces) + len(x_pieces) = 0 then 0.0
            else 2.0::double * len(list_intersect(pieces, x_pieces)) / (len(pieces) + len(x_pieces)) end::double as near_next
from joined
"""
