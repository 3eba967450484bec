"""Fill-in-middle examples: texts cut at unit ends into prefix, middle and suffix, and put together in another order.

Units are the matches of a regular expression, found by the tokenizers library's Split pre-tokenizer with isolated
matches, which needs no training and gives code-point offsets. The number of offsets is the number of units; the offsets
at two drawn ranks are the cuts. Python gives three numbers a text back; draws, slices, the output and the text restored
from it are column expressions. A text goes to the library in blocks of ``BLOCK`` code points and a unit that goes on in
the next block is joined again, so a text or a line of any length needs bounded memory (the pattern must be one that
matches each line, or each rest of a line, whole).

Null texts count as empty. Empty texts and texts that hold a marker stay as they are, as plain ones, without cuts. A null
id is drawn for as the text ``null``. Rows with one id get the same draws, repeated rows the same result; every row is
kept. New columns get underscores where their names are taken; an empty table gives no rows.
"""

from __future__ import annotations

import re
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, pre_tokenizers

#: A unit is a line with its end; what follows the last end is one, too.
LINES = r"[^\n]*\n|[^\n]+"
MARKERS = ("<P>", "<S>", "<M>")
#: Code points that the library gets at once.
BLOCK = 1 << 20


def unit_ends(text: str, split: pre_tokenizers.Split) -> array:
    """Code-point offsets of the ends of a text's units."""
    ends = array("q")
    for at in range(0, len(text), BLOCK):
        if at and text[at - 1] != "\n":
            ends.pop()  # the unit goes on here
        ends.extend(at + end for _, (_, end) in split.pre_tokenize_str(text[at : at + BLOCK]))
    return ends


def cuts(text: Column, first: Column, second: Column, pattern: str = LINES) -> Column:
    """Struct (n, low, high): units of a text, and code points before the cuts at ranks ``first`` and ``second`` modulo n + 1."""

    @F.arrow_udf("n long, low long, high long")
    def run(texts: pa.Array, firsts: pa.Array, seconds: pa.Array) -> pa.Array:
        split = pre_tokenizers.Split(Regex(pattern), "isolated")
        n, low, high = array("q"), array("q"), array("q")
        for text, a, b in zip(texts, firsts.to_pylist(), seconds.to_pylist()):
            ends = unit_ends(text.as_py() or "", split)
            a, b = sorted((a % (len(ends) + 1), b % (len(ends) + 1)))
            n.append(len(ends))
            low.append(ends[a - 1] if a else 0)
            high.append(ends[b - 1] if b else 0)
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (n, low, high)], ["n", "low", "high"])

    return run(text, first, second)


def _apart(markers: tuple[str, str, str]) -> None:
    """Markers are told apart in an output only if none can overlap another."""
    if len(set(markers)) < 3 or any(not a or a.endswith(b[:k]) for a in markers for b in markers for k in range(1, len(b) + (a != b))):
        raise ValueError(f"markers overlap: {markers}")


def transform(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 7, rate: int = 100, spm: int = 50, pattern: str = LINES, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """Every column of ``docs`` plus n, form (plain, psm, spm), prefix_chars, middle_chars and output.

    Draws are the first four groups of eight digits of the SHA-256 of seed and id: two cuts, whether a text is cut
    (``rate`` percent are), and whether the suffix goes first (``spm`` percent).
    """
    _apart(markers)
    names = {}
    for name in ("n", "form", "prefix_chars", "middle_chars", "output"):
        names[name] = name
        while names[name] in docs.columns:
            names[name] += "_"
    t = F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring("_digest", 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]
    cut = docs.withColumn("_digest", digest).withColumn("_cut", cuts(t, draws[0], draws[1], pattern))
    prefix, middle, suffix = F.substring(t, F.lit(1), F.col("_low")), F.substring(t, F.col("_low") + 1, F.col("_high") - F.col("_low")), F.substring(t, F.col("_high") + 1, F.length(t))
    plain = (t == "") | F.contains(t, F.lit(markers[0])) | F.contains(t, F.lit(markers[1])) | F.contains(t, F.lit(markers[2])) | (draws[2] % 100 >= rate)
    form = F.when(plain, "plain").when(draws[3] % 100 < spm, "spm").otherwise("psm")
    p, s, m = map(F.lit, markers)
    output = F.when(F.col("_form") == "plain", t).when(F.col("_form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    placed = cut.withColumns({"_form": form, "_low": F.col("_cut.low").cast("int"), "_high": F.col("_cut.high").cast("int")})
    whole = F.col("_form") != "plain"
    return placed.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.col("_cut.n").alias(names["n"]),
        F.col("_form").alias(names["form"]),
        F.when(whole, F.col("_cut.low")).alias(names["prefix_chars"]),
        F.when(whole, F.col("_cut.high") - F.col("_cut.low")).alias(names["middle_chars"]),
        output.alias(names["output"]),
    )


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made from, by its form alone."""
    parts = F.split(output, "|".join(re.escape(m) for m in markers), -1)
    part = lambda k: F.get(parts, k)
    return F.when(form == "plain", output).when(form == "psm", F.concat(part(1), part(3), part(2))).otherwise(F.concat(part(2), part(3), part(1)))


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """Per document: doc_id, n, form, prefix_chars, middle_chars, SHA-256 of the output and of the text restored from it."""
    made = transform(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), **settings)
    markers = settings.get("markers", MARKERS)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form"), markers), 256).alias("restored_sha256"))


#: DuckDB SQL of ``digests`` with its defaults.
SQL = r"""WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, 'null')) AS digest FROM documents),
drawn AS (SELECT doc_id, t, units, len(units)::BIGINT AS n, ('0x' || substr(digest, 1, 8))::BIGINT % (len(units) + 1) AS a, ('0x' || substr(digest, 9, 8))::BIGINT % (len(units) + 1) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || substr(digest, 17, 8))::BIGINT % 100 >= 100 THEN 'plain' WHEN ('0x' || substr(digest, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (SELECT doc_id, t, n, form, array_to_string(units[1:least(a, b)], '') AS p, array_to_string(units[least(a, b) + 1:greatest(a, b)], '') AS m, array_to_string(units[greatest(a, b) + 1:n], '') AS s FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM parts"""
