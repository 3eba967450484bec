"""Document fingerprints: a Merkle tree over sections, paragraphs and their pieces, in DataFrame functions only.

A text's paragraphs are its lines. A paragraph's hash is the MD5 of its text, a section's that of eight paragraph hashes,
the root's that of the sections', all of full width, so equal roots mean equal texts as surely as MD5 does for texts that
nobody forges; where roots differ, the first section and, within it, the first paragraph that differ locate the edit. A
fingerprint is the root and the smallest 64 distinct hashes (32 bits) of the text's pieces of up to four words, in hex, so
the likeness of two texts (0 to 1, the share of pieces they have in common) can be told from fingerprints alone.

Null texts count as empty; an empty text has one empty paragraph and no piece. Rows that repeat a doc_id are each kept,
and as one another's neighbours count as one document, the one whose text sorts first. Ids are whole numbers; a null one
sorts first (the least 64-bit number stands for it). Texts are read whole, however long. Columns besides those named are
ignored, whatever their names; an empty table gives no rows. Nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise

#: Smallest leaves that a fingerprint keeps.
KEPT = 64
#: Paragraphs in a section.
SECTION = 8
_PIECE = r"(?: *+[^ \n]++){1,4}+ *+"
_NULL = -(1 << 63)


def _hash(x: Column) -> Column:
    return F.md5(x.cast("binary"))


def tree(text: Column) -> Column:
    """Hashes of paragraphs."""
    return F.transform(F.split(text, "\n"), _hash)


def sections(hashes: Column) -> Column:
    """Hashes of sections, from ``tree``."""
    count = F.ceil(F.size(hashes) / SECTION).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: _hash(F.array_join(F.slice(hashes, i * SECTION + 1, SECTION), "")))


def root(section_hashes: Column) -> Column:
    return _hash(F.array_join(section_hashes, ""))


def sketch(text: Column) -> Column:
    """The smallest hashes of pieces; a piece lies in one paragraph and has the spaces around its words."""
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.slice(F.array_sort(F.array_distinct(F.transform(pieces, lambda x: F.left(_hash(x), F.lit(8))))), 1, KEPT)


def fingerprinted(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds ``{name}_tree`` (paragraph hashes), ``{name}_sections``, ``{name}_root`` and ``{name}_sketch`` of a column without nulls."""
    df = df.withColumns({f"{name}_tree": tree(F.col(text)), f"{name}_sketch": sketch(F.col(text))})
    df = df.withColumn(f"{name}_sections", sections(F.col(f"{name}_tree")))
    return df.withColumn(f"{name}_root", root(F.col(f"{name}_sections")))


def fingerprint(name: str) -> Column:
    return F.concat_ws("-", F.col(f"{name}_root"), F.array_join(f"{name}_sketch", ""))


def likeness(root_a: Column, a: Column, root_b: Column, b: Column) -> Column:
    """Share of leaves in common (twice the common ones over both), estimated from the smallest of the union; 1 for equal roots."""
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, KEPT)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(root_a == root_b, F.lit(1.0)).when(F.size(union) == 0, F.lit(0.0)).otherwise(2.0 * both / (F.size(union) + both))


def first_difference(a: Column, b: Column) -> Column:
    """Place (from 0) of the first differing branch, null if there is none."""
    longest = F.greatest(F.size(a), F.size(b))
    place = F.array_position(F.transform(F.sequence(F.lit(0), longest - 1), lambda i: F.get(a, i).eqNullSafe(F.get(b, i))), F.lit(False))
    return F.when(place > 0, place - 1)


def neighbours(ids: DataFrame) -> DataFrame:
    """For distinct longs ``key``: rows (key, next_key), the next key in ascending order, the first one after the last.

    Keys are sorted by ranges. Each range finds the next key of all its own but the last one, whose next is the smallest
    of the range after it; only these, one a range, go through one task.
    """
    dealt = materialise(ids.orderBy("key").withColumn("part", F.spark_partition_id()), "ids")
    heads = dealt.groupBy("part").agg(F.min("key").alias("head"))
    first = F.first("head").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(Window.orderBy("part")), first).alias("after"))
    following = F.lead("key").over(Window.partitionBy("part").orderBy("key"))
    return dealt.withColumn("following", following).join(F.broadcast(heads), "part").select("key", F.coalesce("following", "after").alias("next_key"))


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, whose second half comes from the next document's beginning.

    Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs,
    n_sections, and the first section and paragraph that the edit changed (from 0; null if none).
    """
    # one key stands for the id, so both joins read the same columns and share one exchange of the texts
    texts = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NULL)).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    own_id = F.when(F.col("key") != _NULL, F.col("key")).cast(docs.schema[doc_id].dataType)
    lengths = texts.groupBy("key").agg(F.max(F.char_length("text")).alias("n"), F.count("*").alias("rows"))
    repeated = bool(lengths.where("rows > 1").take(1))
    links = neighbours(lengths.select("key")).join(lengths, "key").select(F.col("key").alias("to"), "next_key", F.floor(F.col("n") / 2).cast("int").alias("most"))
    follower = fingerprinted(texts.join(links, texts["key"] == links["next_key"]), "text", "next").select("to", F.col("text").substr(F.lit(1), F.col("most")).alias("head"), "next_root", "next_sketch", *(["text"] if repeated else []))
    if repeated:
        follower = follower.groupBy("to").agg(F.min_by(F.struct("head", "next_root", "next_sketch"), "text").alias("x")).select("to", "x.*")
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    both = texts.join(follower, texts["key"] == follower["to"]).withColumn("edited", F.concat(F.col("text").substr(F.lit(1), n - half), F.col("head").substr(F.lit(1), half)))
    both = fingerprinted(fingerprinted(both, "text", "own"), "edited", "edited")
    return both.select(
        own_id.alias("doc_id"),
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own").alias("fingerprint"),
        fingerprint("edited").alias("edited_fingerprint"),
        likeness(F.col("own_root"), F.col("own_sketch"), F.col("edited_root"), F.col("edited_sketch")).alias("near_edited"),
        likeness(F.col("own_root"), F.col("own_sketch"), F.col("next_root"), F.col("next_sketch")).alias("near_next"),
        F.size("own_tree").alias("n_paragraphs"),
        F.size("own_sections").alias("n_sections"),
        first_difference(F.col("own_sections"), F.col("edited_sections")).alias("changed_section"),
        first_difference(F.col("own_tree"), F.col("edited_tree")).alias("changed_paragraph"),
    )


SQL = """
WITH doc AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
pair AS (SELECT doc_id, n, text, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS next_text FROM doc),
both_texts AS (SELECT doc_id, n, text, next_text, left(text, n - n // 2) || left(next_text, n // 2) AS edited FROM pair),
hashed AS (SELECT doc_id, n, edited, list_transform(string_split(text, chr(10)), lambda p: md5(p)) AS t0,
  list_transform(string_split(edited, chr(10)), lambda p: md5(p)) AS t1, list_transform(string_split(next_text, chr(10)), lambda p: md5(p)) AS t2,
  list_transform(regexp_extract_all(text, '(?: *[^ \\n]+){1,4} *'), lambda x: left(md5(x), 8)) AS l0,
  list_transform(regexp_extract_all(edited, '(?: *[^ \\n]+){1,4} *'), lambda x: left(md5(x), 8)) AS l1,
  list_transform(regexp_extract_all(next_text, '(?: *[^ \\n]+){1,4} *'), lambda x: left(md5(x), 8)) AS l2 FROM both_texts),
cut AS (SELECT *,
  list_transform(range(0, (len(t0) + 7) // 8), lambda i: md5(array_to_string(t0[i * 8 + 1:i * 8 + 8], ''))) AS s0,
  list_transform(range(0, (len(t1) + 7) // 8), lambda i: md5(array_to_string(t1[i * 8 + 1:i * 8 + 8], ''))) AS s1,
  list_transform(range(0, (len(t2) + 7) // 8), lambda i: md5(array_to_string(t2[i * 8 + 1:i * 8 + 8], ''))) AS s2,
  list_sort(list_distinct(l0))[1:64] AS k0, list_sort(list_distinct(l1))[1:64] AS k1, list_sort(list_distinct(l2))[1:64] AS k2 FROM hashed),
rooted AS (SELECT *, md5(array_to_string(s0, '')) AS r0, md5(array_to_string(s1, '')) AS r1, md5(array_to_string(s2, '')) AS r2,
  list_sort(list_distinct(list_concat(k0, k1)))[1:64] AS u1, list_sort(list_distinct(list_concat(k0, k2)))[1:64] AS u2 FROM cut),
met AS (SELECT *, len(list_intersect(list_intersect(u1, k0), k1)) AS m1, len(list_intersect(list_intersect(u2, k0), k2)) AS m2 FROM rooted)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256,
  r0 || '-' || array_to_string(k0, '') AS fingerprint, r1 || '-' || array_to_string(k1, '') AS edited_fingerprint,
  CASE WHEN r0 = r1 THEN 1.0::DOUBLE WHEN len(u1) = 0 THEN 0.0 ELSE 2.0::DOUBLE * m1 / (len(u1) + m1) END AS near_edited,
  CASE WHEN r0 = r2 THEN 1.0::DOUBLE WHEN len(u2) = 0 THEN 0.0 ELSE 2.0::DOUBLE * m2 / (len(u2) + m2) END AS near_next,
  len(t0)::INT AS n_paragraphs, len(s0)::INT AS n_sections,
  list_position(list_transform(range(1, greatest(len(s0), len(s1)) + 1), lambda i: s0[i] IS NOT DISTINCT FROM s1[i]), false) - 1 AS changed_section,
  list_position(list_transform(range(1, greatest(len(t0), len(t1)) + 1), lambda i: t0[i] IS NOT DISTINCT FROM t1[i]), false) - 1 AS changed_paragraph
FROM met
"""
