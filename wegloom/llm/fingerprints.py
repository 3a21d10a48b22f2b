"""Homomorphic multiset fingerprints of texts. DataFrame operations only.

A text is a multiset of paragraphs (lines), and these of clauses. Paragraphs are hashed to sixteen 32-bit words, summed
modulo 2**32: equal for equal multisets, whatever the order, and updated by adding or subtracting a paragraph's words.
Clauses are hashed to 64 bits; bit by bit these are counted, two 32-bit counters to a sum modulo 2**64. With n clauses
and a count c, 2c - n is a sum of random signs, so that inner products over the 64 counters estimate how many clauses
two texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from wegloom.llm import common

WORDS, SUMS = 16, 32
LOW = 0xFFFFFFFF
PAIR = (1 << 32) | 1
CLAUSE_END = r"[.,;:!?\n]+"


def paragraph_words(text: Column) -> Column:
    """Array of WORDS sums modulo 2**32 over the text's lines; empty lines don't count.

    The word's number is hashed first and so seeds the hash of the line: the words are hashes of the line's own bytes
    each, so lines that meet in one word don't meet in the others."""
    lines = F.filter(F.split(text, "\n"), lambda p: p != "")

    def add(sums: Column, p: Column) -> Column:
        return F.array(*[(sums[j] + F.xxhash64(F.lit(j), p).bitwiseAND(F.lit(LOW))).bitwiseAND(F.lit(LOW)) for j in range(WORDS)])

    return F.aggregate(lines, F.array(*[F.lit(0).cast("bigint")] * WORDS), add)


def clause_sums(clause: Column) -> list[Column]:
    h = F.xxhash64(F.trim(clause))
    some = F.trim(clause) != ""
    return [F.sum(F.when(some, F.shiftrightunsigned(h, i).bitwiseAND(F.lit(PAIR))).otherwise(0)).alias(f"s{i}") for i in range(SUMS)]


def signs(sums: Column, n: Column) -> Column:
    """The 64 sums of signs as doubles."""
    both = F.concat(F.transform(sums, lambda x: x.bitwiseAND(F.lit(LOW))), F.transform(sums, lambda x: F.shiftrightunsigned(x, 32)))
    return F.transform(both, lambda c: (c * 2 - n).cast("double"))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """2ab / (aa + bb) of two arrays of signs, from 0 to 1; 1 where the fingerprints are the same."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = dot(a, a) + dot(b, b)
    return F.when(same, 1.0).when(norm == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b) * 2 / norm)))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """Words of the union of two multisets (sign 1), or of a without b (sign -1)."""
    return F.zip_with(a, b, lambda x, y: (x + y * sign).bitwiseAND(F.lit(LOW)))


def fingerprint(texts: DataFrame, key: list[str], text: str = "text", merged: str | None = None) -> DataFrame:
    """key, words, n, sums, fingerprint (string) of each text; the key columns must tell rows apart, or the column `merged`
    say how many rows of the same text have the same key.

    If texts is partitioned by the first key column, nothing is shuffled.
    """
    t = F.col(text)
    # both are made below the explosion, once a text, and the text itself is not carried through it
    cut = texts.select(*key, paragraph_words(t).alias("words"), F.split(t, CLAUSE_END).alias("clauses"))
    clauses = cut.select(*key, "words", F.explode_outer("clauses").alias("clause"))
    counted = clauses.groupBy(*key).agg(F.first("words").alias("words"), F.sum(F.when(F.trim("clause") != "", 1).otherwise(0)).alias("n"), *clause_sums(F.col("clause")))
    one = lambda c: F.col(c) if merged is None else F.expr(f"{c} div {merged}")  # noqa: E731  # sums of as many equal rows
    packed = counted.select(*key, "words", one("n").alias("n"), F.array(*[one(f"s{i}") for i in range(SUMS)]).alias("sums"))
    text_of = F.concat_ws(":", F.array_join(F.transform("words", lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")), ""), F.col("n").cast("string"), F.array_join(F.transform("sums", lambda s: F.lower(F.hex(s))), ","))
    return packed.withColumn("fingerprint", text_of)


def neighbours(lengths: DataFrame, parts: int) -> DataFrame:
    """row, n_chars, copies, next_row, prev_row, prev_chars in ascending order of row (a struct), going round at the ends.

    Rows are dealt over ranges; inside a range a window sees the neighbours, and at its ends a table with a row a range
    (as many as parts) has the first and last rows of the ranges beside it.
    """
    dealt = common.materialize(lengths.repartitionByRange(parts, "row").withColumn("_p", F.spark_partition_id()), "ordered")
    w = Window.partitionBy("_p").orderBy("row")
    ends = dealt.groupBy("_p").agg(F.min("row").alias("low"), F.max(F.struct("row", "n_chars")).alias("high"))
    every = Window.partitionBy(F.lit(0)).orderBy("_p")
    whole = Window.partitionBy(F.lit(0))
    ends = ends.select(
        "_p",
        F.coalesce(F.lead("low").over(every), F.min("low").over(whole)).alias("after"),
        F.coalesce(F.lag("high").over(every), F.max("high").over(whole)).alias("before"),
    )
    near = dealt.withColumns({"_next": F.lead("row").over(w), "_prev": F.lag(F.struct("row", "n_chars")).over(w)}).join(ends, "_p")
    prev = F.coalesce("_prev", "before")
    return near.select("row", "n_chars", "copies", F.coalesce("_next", "after").alias("next_row"), prev["row"].alias("prev_row"), prev["n_chars"].alias("prev_chars"))


def edited_fingerprints(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints of all texts and of their edited texts: the last n_chars div share code points give way to as many
    (or all) from the start of the next document.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null texts are
    empty ones; an only document is its own successor; an empty table gives no rows. Rows without doc_id come first; rows
    of one doc_id follow one another in the order of their texts' hashes; repeated rows (doc_id and text) are one document
    in that order, and each gets its result. Other columns are not read.
    """
    # a row is told by doc_id and its text's hash together, nulls included
    # (a nullable hash, as in the tables read back: else the joins cast the key, and its partitioning is lost)
    row = F.struct("doc_id", F.try_add(F.xxhash64(common.empty_if_null("text")), F.lit(0).cast("bigint")).alias("hash")).alias("row")
    base = docs.select(row, common.empty_if_null("text").alias("text"))
    parts = common.parts_for(docs, 64 << 20)
    lengths = docs.select(row, F.length(common.empty_if_null("text")).cast("bigint").alias("n_chars")).groupBy("row", "n_chars").agg(F.count(F.lit(1)).alias("copies"))
    near = common.materialize(neighbours(lengths, parts), "near")
    joined = base.join(near.hint("shuffle_hash"), "row")
    cut = lambda n: F.floor(n / share).cast("int")
    heads = joined.where(cut(F.col("prev_chars")) > 0).select(F.col("prev_row").alias("row"), F.substring(F.col("text"), F.lit(1), cut(F.col("prev_chars"))).alias("head")).dropDuplicates(["row"])
    whole = joined.join(heads.hint("shuffle_hash"), "row", "left")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - cut(F.col("n_chars"))).cast("int")), common.empty_if_null("head"))
    both = whole.select("row", "copies", F.inline(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("text")), F.struct(F.lit(1).alias("which"), edited.alias("text")))))
    printed = fingerprint(both.select("row", "copies", "which", "text", F.when(F.col("which") == 1, F.sha2(F.col("text").cast("binary"), 256)).alias("sha")), ["row", "copies", "which", "sha"], merged="copies")
    pick = lambda k: F.max(F.when(F.col("which") == k, F.struct("fingerprint", "sums", "n", "sha")))
    wide = printed.groupBy("row", "copies").agg(pick(0).alias("a"), pick(1).alias("e"))
    a, e, b = F.col("a"), F.col("e"), F.col("b")
    full = common.materialize(
        wide.join(near.select("row", "n_chars", "next_row"), "row").select("row", "copies", "n_chars", "next_row", e["sha"].alias("edited_sha256"), a["fingerprint"].alias("fingerprint"), e["fingerprint"].alias("edited_fingerprint"), likeness(signs(a["sums"], a["n"]), signs(e["sums"], e["n"]), a["fingerprint"] == e["fingerprint"]).alias("near_edited"), a.alias("a")),
        "printed",
    )
    after = full.select(F.col("row").alias("next_row"), F.struct(F.col("a.fingerprint"), F.col("a.sums"), F.col("a.n")).alias("b"))
    out = full.join(after, "next_row").select("row", "copies", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", likeness(signs(a["sums"], a["n"]), signs(b["sums"], b["n"]), a["fingerprint"] == b["fingerprint"]).alias("near_next"))
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("row.doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
