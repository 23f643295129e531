"""Texts that lost their end, per source: at a field limit, or somewhere on the way.

Vocabulary. All tokens that are followed by another one are complete; they and their proper prefixes are counted, with
digits replaced by 9 so that measures count by their shape. A last token is broken if no complete token has it and it is
the beginning of some that do.

Limits. Per source the lengths of its texts, in characters and in bytes, form histograms. A length is a limit if it holds at
least `spike` times as many texts as the three lengths below on average, has at least
`share` of the source's texts, and if at least `evidence` of its texts end broken: many texts that merely fill a field end in whole words. The unit (characters or bytes) that explains more broken ends is the source's.

Cut texts. At a limit: the last token is broken, or is a shape that goes on more often than it is complete, or never ends a
text elsewhere although it is common (a number without its unit, a label without its number). Away from limits, in sources
where at least `stray` of the texts there end broken (lost in transfer): the same, but only for tokens never seen complete.
A last character that is the replacement character is half a character: cut, wherever it stands. Terminal punctuation (an abbreviation's point, closing brackets) is a
real end; but two or more points, an ellipsis or a tilde glued to the last token at a limit are the sign that a system sets where it cuts, and the token before it is
judged like any other. Away from limits they are a person's way of writing.

Null and blank texts are never cut. Repeated rows are judged each on their own. A null source is a source. The vocabulary is counted
with partial aggregation and joined by distinct token, never gathered. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stammwerk.session import Scratch

#: COMMON is a share of all complete tokens (30 of 1.1 million).
SPIKE, EVIDENCE, SHARE, STRAY, COMMON = 1.6, 0.15, 0.02, 0.005, 2.7e-5
ENDS = r"[.!?)\]}:;\"'%-]\z"
SIGN = r"(?<=[\p{L}\p{N}])(?:\.{2,}|\u2026|~)\z"  # set by a system behind what it cut


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != "")


def shape(token: Column) -> Column:
    return F.regexp_replace(token, "[0-9]", "9")


def _prepared(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    base = df.select(F.col(f"`{row_id}`").alias("row_id"), F.col(f"`{source}`").alias("source"), F.col(f"`{text}`").alias("text")).filter(F.trim("text") != "")
    split = base.withColumn("_t", tokens(F.col("text"))).filter(F.size("_t") > 0)
    last = F.try_element_at("_t", F.lit(-1))
    return split.select(
        "row_id", "source", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"), F.transform(F.slice("_t", F.lit(1), F.greatest(F.size("_t") - 1, F.lit(0))), shape).alias("inner"),
        shape(F.regexp_replace(last, SIGN, "")).alias("last"), last.rlike(SIGN).alias("signed"), F.substring(F.regexp_replace("text", r"\s+\z", ""), -1, 1).alias("final"),
    )


def vocabulary(rows: DataFrame) -> DataFrame:
    """(token, inner, longer): how often a token is followed by another, and how often a longer complete token begins with it."""
    complete = Scratch(rows.sparkSession, "tokens").write(rows.select(F.explode("inner").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")))
    begun = complete.filter(F.length("token") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda k: F.substring(F.col("token"), F.lit(1), k))).alias("token"), "n").groupBy("token").agg(F.sum("n").alias("longer"))
    return complete.withColumnRenamed("n", "inner").join(begun, "token", "full").select("token", F.coalesce("inner", F.lit(0)).alias("inner"), F.coalesce("longer", F.lit(0)).alias("longer"))


def _lengths(rows: DataFrame) -> DataFrame:
    each = F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("length")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("length"))))
    return rows.select("source", each.alias("_l"), "broken").groupBy("source", "_l.unit", "_l.length").agg(F.count(F.lit(1)).alias("n"), F.count_if("broken").alias("n_broken"))


def limits(rows: DataFrame) -> DataFrame:
    """(source, unit, length, n, n_broken): the limits of each source; rows has source, chars, bytes, broken."""
    counted = _lengths(rows)
    below = counted.select("source", "unit", F.explode(F.array(*(F.col("length") + k for k in (1, 2, 3)))).alias("length"), F.col("n").alias("m")).groupBy("source", "unit", "length").agg(F.sum("m").alias("m"))
    found = counted.alias("c").join(below.alias("b"), F.col("c.source").eqNullSafe(F.col("b.source")) & (F.col("c.unit") == F.col("b.unit")) & (F.col("c.length") == F.col("b.length")), "left").select("c.*", F.coalesce("m", F.lit(0)).alias("m"))
    found = found.filter((F.col("n") * 3 >= F.col("m") * SPIKE) & (F.col("n_broken") >= F.greatest(F.lit(3), F.col("n") * EVIDENCE)))
    total = counted.filter("unit = 'chars'").groupBy("source").agg(F.sum("n").alias("_all")).select(F.col("source").alias("_src"), "_all")
    found = found.join(total, F.col("source").eqNullSafe(F.col("_src"))).filter(F.col("n") >= F.col("_all") * SHARE).drop("_src", "_all")
    best = found.groupBy("source", "unit").agg(F.sum("n_broken").alias("_k")).groupBy("source").agg(F.max(F.struct("_k", "unit")).alias("_b")).select(F.col("source").alias("_s"), F.col("_b.unit").alias("_u"))
    return found.join(best, F.col("source").eqNullSafe(F.col("_s")) & (F.col("unit") == F.col("_u"))).select("source", "unit", "length", "n", "n_broken")


def judged(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(row_id, source, at_limit, cut) of every row with a text."""
    scratch = Scratch(df.sparkSession, "texts")
    rows = scratch.write(_prepared(df, row_id, source, text))  # split once; the vocabulary and the verdicts start here
    known = scratch.write(vocabulary(rows))
    common = F.lit((known.agg(F.sum("inner")).first()[0] or 0) * COMMON)
    looked = rows.drop("inner").join(known.withColumnRenamed("token", "last"), "last", "left").withColumn("inner", F.coalesce("inner", F.lit(0))).withColumn("longer", F.coalesce("longer", F.lit(0)))
    half, real_end = F.col("final") == "\ufffd", F.col("final").rlike(ENDS)
    looked = looked.withColumn("half", half).withColumn("real_end", real_end & ~F.col("signed")).withColumn("broken", half | (~F.col("real_end") & (F.col("inner") == 0) & (F.col("longer") > 0)))
    looked = scratch.write(looked.drop("final"))  # the limits, the losses and the verdicts all start here
    found = F.broadcast(limits(looked).groupBy("source", "unit").agg(F.array_agg("length").alias("_lengths")))
    at = looked.alias("r").join(found.alias("l"), F.col("r.source").eqNullSafe(F.col("l.source")), "left").select("r.*", F.coalesce(F.array_contains("_lengths", F.when(F.col("unit") == "chars", F.col("chars")).otherwise(F.col("bytes"))), F.lit(False)).alias("at_limit"))
    at = at.withColumn("real_end", F.col("real_end") | (F.col("signed") & ~F.col("at_limit"))).withColumn("broken", F.col("half") | (F.col("broken") & ~F.col("real_end")))
    at = scratch.write(at.drop("chars", "bytes", "signed"))
    stray = F.broadcast(at.filter("NOT at_limit").groupBy("source").agg((F.count_if("broken") >= F.greatest(F.lit(3), F.count(F.lit(1)) * STRAY)).alias("loses")))
    at = at.alias("r").join(stray.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")), "left").select("r.*", F.coalesce("loses", F.lit(False)).alias("loses"))
    ended = at.filter("NOT at_limit AND NOT broken AND NOT loses").groupBy("last").agg(F.count(F.lit(1)).alias("ended"))
    seen = at.join(ended, "last", "left").withColumn("ended", F.coalesce("ended", F.lit(0)))
    real_end = F.col("real_end")
    never_last = (F.col("ended") * 1000 <= F.col("inner")) & (F.col("inner") >= common)
    goes_on = F.col("longer") > F.col("inner") + F.col("ended")
    has_digit = F.col("last").rlike("9")
    cut_at_limit = F.col("broken") | (~real_end & ((has_digit & goes_on) | never_last))
    cut_on_way = F.col("broken") & (F.col("ended") == 0) | (~real_end & never_last & (F.col("ended") == 0)) | (~real_end & has_digit & (F.col("ended") == 0) & (F.col("longer") > 0))
    return seen.select("row_id", "source", "at_limit", F.coalesce(F.when(F.col("half"), F.lit(True)).when(F.col("at_limit"), cut_at_limit).when(F.col("loses"), cut_on_way).otherwise(F.lit(False)), F.lit(False)).alias("cut"))


def report(df: DataFrame, row_id: str, source: str, text: str) -> DataFrame:
    """(source, n_texts, n_at_limit, n_cut, cut_share) per source."""
    return judged(df, row_id, source, text).groupBy("source").agg(F.count(F.lit(1)).alias("n_texts"), F.count_if("at_limit").alias("n_at_limit"), F.count_if("cut").alias("n_cut")).withColumn("cut_share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
