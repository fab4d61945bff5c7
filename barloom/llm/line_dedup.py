"""Drop lines that repeat across documents, keeping each in the document with the smallest id.

Lines travel as (document, position, 128-bit hash of the normalised line), never as text. The
hash table is reduced with min/max of the document id, which Spark combines before the shuffle,
so a line of millions of documents costs one row per task there. Lines meet the table by hash; the
most frequent ones by hash and salt, with the table's row copied to every salt.

Defined cases: a null or empty text is one empty line; a null id stands for one document after
all others; repeated rows of one id are one document; other columns pass through unchanged,
whatever their names, but one named like a count is replaced; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import BLANK, NO_ID, keep

#: A line is hot above this share of all repeats (1 / HEAVY); tasks that a hot line is dealt to.
HEAVY, SALTS = 1_000, 64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """Blanks stripped at both ends, A-Z lower-cased; other letters stay as they are."""
    line = F.btrim(line, F.lit(BLANK))
    return F.when(F.octet_length(line) == F.char_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def repeated_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, pos, text_hash) of every line to drop, by the row's id and the hash of its whole text."""
    lines = docs.select(
        F.coalesce(F.col(id_col), F.lit(NO_ID)).alias("d"),
        F.xxhash64(text_col).alias("th"),
        F.posexplode(_lines(F.col(text_col))).alias("pos", "line"),
    )
    lines = lines.withColumn("key", line_key(F.col("line"))).where(F.char_length("key") >= min_chars)
    lines = lines.select("d", "th", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    if min_docs == 2:  # two ids differ where the least and the greatest do, which needs no distinct
        common = lines.groupBy("h1", "h2").agg(F.min("d").alias("first"), F.max("d").alias("last"), F.count("*").alias("n")).where("first < last")
    else:
        common = lines.groupBy("h1", "h2", "d").agg(F.count("*").alias("n")).groupBy("h1", "h2").agg(F.min("d").alias("first"), F.count("*").alias("docs"), F.sum("n").alias("n")).where(F.col("docs") >= min_docs)
    common = keep(common.select("h1", "h2", "first", "n"), "lines")
    # lines with more than a thousandth of all repeats, a thousand at most, are dealt to many tasks
    total = common.agg(F.sum("n")).first()[0] or 0
    heavy = F.col("n") * HEAVY > total
    spread = F.broadcast(common.where(heavy).select("h1", "h2", F.lit(True).alias("hot")))
    salts = [F.lit(i).cast("long") for i in range(SALTS)]
    lines = lines.join(spread, ["h1", "h2"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("d", "pos"), F.lit(SALTS))).otherwise(salts[0]))
    common = common.select("h1", "h2", "first", F.explode(F.when(heavy, F.array(*salts)).otherwise(F.array(salts[0]))).alias("salt"))
    return lines.join(common, ["h1", "h2", "salt"]).where("d > first").select("d", "th", "pos")


def dedup_lines(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, id_col: str = "doc_id", text_col: str = "text", suffix: str = "") -> DataFrame:
    """All rows and columns of docs with the text rewritten, plus n_lines and n_dropped (with the suffix)."""
    gone = repeated_lines(docs, min_chars, min_docs, id_col, text_col).groupBy("d", "th").agg(F.collect_set("pos").alias("gone"))
    row = F.struct(*[docs[c] for c in docs.columns])
    left = docs.select(row.alias("row"), F.coalesce(docs[id_col], F.lit(NO_ID)).alias("d"), F.xxhash64(docs[text_col]).alias("th"))
    both = left.join(gone, ["d", "th"], "left")
    text = F.col("row").getField(text_col)
    both = both.withColumn("lines", F.when(F.col("gone").isNotNull(), _lines(text)))
    stay = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone")))
    kept = F.when(F.col("gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("lines"), i)), "\n"))
    total = F.when(F.col("gone").isNull(), F.char_length(F.coalesce(text, F.lit(""))) - F.char_length(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(""))) + 1).otherwise(F.size("lines"))
    counts = {"n_lines" + suffix: total, "n_dropped" + suffix: F.coalesce(F.size("gone"), F.lit(0))}
    out = [(kept if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns if c not in counts]
    return both.select(*out, *[v.cast("long").alias(k) for k, v in counts.items()])
