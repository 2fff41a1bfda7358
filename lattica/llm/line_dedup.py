"""Lines that many documents share: drop them and put the rest together again.

Lines are exploded with their position as narrow rows (document, position, 128-bit hash of the normalised line), written once
in the shared folder. Documents are counted per hash with partial sums, so a line in every document is no hot spot. The join
that marks lines keeps clear of hot hashes as well: the ``HOT`` most frequent ones are broadcast, which leaves at most one
``HOT``-th of all rows to any other. The whole texts move once, when they meet the positions they lose.

A line's key is the line without ``[\\x20\\x09-\\x0D]`` at both ends and with A-Z in lower case. A null or empty text is one
empty line. Rows that share a ``doc_id`` (null is one more) count as one document, but each keeps its own text and lines; equal
rows get equal results. An empty table gives an empty result. Further columns stay as they are; only ``doc_id`` and ``text`` are
read, and the added columns replace any of the same name.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.plans.lineage import cut

#: Hashes whose lines are marked by broadcast; 16 bytes each.
HOT = 4096
_SPACE = " \t\n\x0b\f\r"


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in order."""
    folded = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.transform(F.split(folded, "\n", -1), lambda line: F.btrim(line, F.lit(_SPACE)))


def _digest(of: Column, name: str) -> list[Column]:
    """128 bits in two columns."""
    return [F.xxhash64(of).alias(f"{name}1"), F.xxhash64(F.lit(1), of).alias(f"{name}2")]


def exploded(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """A row for each line whose key has ``min_chars`` code points: doc_id, t1, t2 (hash of the text), position, h1, h2."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = docs.select("doc_id", *_digest(text, "t"), F.posexplode(line_keys(F.col("text"))).alias("position", "key"))
    return lines.filter(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "position", *_digest(F.col("key"), "h"))


def frequent(lines: DataFrame, min_docs: int = 10) -> DataFrame:
    """h1, h2 and n_docs of the hashes found in at least ``min_docs`` different documents."""
    return lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)


def drop_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with the kept lines as ``text``, and n_lines (before), n_dropped."""
    lines = cut(exploded(docs, min_chars), "lines")
    often = cut(frequent(lines, min_docs), "frequent-lines")
    hot = F.broadcast(often.orderBy(F.desc("n_docs"), "h1", "h2").limit(HOT).select("h1", "h2"))
    others = lines.join(hot, ["h1", "h2"], "left_anti").join(often.join(hot, ["h1", "h2"], "left_anti"), ["h1", "h2"], "left_semi")
    marked = lines.join(hot, ["h1", "h2"], "left_semi").unionByName(others)
    gone = marked.groupBy(F.col("doc_id").alias("_id"), "t1", "t2").agg(F.array_sort(F.collect_set("position")).alias("_gone"))
    given = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`").alias(c) for c in given]).alias("_row"), F.coalesce(F.col("text"), F.lit("")).alias("_text")).select("_row", "_text", *[c.alias("_" + n) for c, n in zip(_digest(F.col("_text"), "t"), ("t1", "t2"))])
    met = rows.join(gone, F.col("_row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left")
    split = met.select("_row", F.split("_text", "\n", -1).alias("_lines"), F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    # Kept lines are the stretches between neighbouring dropped positions, so a long text takes time in proportion to its lines.
    bounds = split.select("_row", "_lines", F.concat(F.array(F.lit(-1)), "_gone", F.array(F.size("_lines"))).alias("_b"))
    kept = F.expr("flatten(transform(sequence(1, size(_b) - 1), k -> slice(_lines, _b[k - 1] + 2, _b[k] - _b[k - 1] - 1)))")
    columns = [F.array_join(kept, "\n").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c) for c in given]
    return bounds.select(*columns, F.size("_lines").cast("long").alias("n_lines"), (F.size("_b") - 2).cast("long").alias("n_dropped"))
