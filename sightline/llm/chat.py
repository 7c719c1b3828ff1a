"""Preference formatting: one prompt of the turns that both conversations begin with, and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: How a turn is written: a line with its role, its text, and a line that ends it.
OPEN, CLOSE = ("<|", "|>\n"), "\n<|end|>\n"
#: Whose turns count for the loss.
TRAINED = "assistant"


def _turn(t: Column) -> Column:
    return F.concat(F.lit(OPEN[0]), F.coalesce(t["role"], F.lit("")), F.lit(OPEN[1]), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _turn), "")


def spans(turns: Column) -> Column:
    """Start and end (not included) of what the loss counts, in characters of rendered(turns): the trained role's texts
    and the mark that ends them."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def add(a: Column, t: Column) -> Column:
        head = F.length(F.concat(F.lit(OPEN[0]), F.coalesce(t["role"], F.lit("")), F.lit(OPEN[1])))
        end = a["at"] + F.length(_turn(t))
        own = F.array(F.struct((a["at"] + head).alias("start"), end.alias("end")))
        none = F.array().cast("array<struct<start:int,end:int>>")
        return F.struct(end.alias("at"), F.concat(a["out"], F.when(t["role"] == TRAINED, own).otherwise(none)).alias("out"))

    return F.aggregate(turns, start, add, lambda a: a["out"])


def paired(turns: DataFrame) -> DataFrame:
    """turns(pair_id, chosen boolean, turn, role, text) -> pair_id, n_chosen, n_rejected, n_common, prompt, chosen,
    rejected, chosen_spans, rejected_spans.

    Turns are in order of turn (nulls first), of equal ones in order of role and text; a repeated row counts once. Two
    turns are alike if role and text are, null being like null only. A pair that lacks a side has an empty completion
    there and no common turns. Null pair_id or side: left out. Null roles and texts are written as empty.
    """
    one = lambda side: F.array_sort(F.collect_set(F.when(F.col("chosen") == side, F.struct("turn", "role", "text"))))
    sides = turns.where("pair_id is not null and chosen is not null").groupBy("pair_id").agg(one(True).alias("c"), one(False).alias("r"))
    same = F.zip_with("c", "r", lambda a, b: a.isNotNull() & b.isNotNull() & a["role"].eqNullSafe(b["role"]) & a["text"].eqNullSafe(b["text"]))
    n = F.least(F.size("c"), F.size("r"))
    miss = F.array_position(same, False).cast("int")
    sides = sides.withColumn("n_common", F.when(miss == 0, n).otherwise(miss - 1).cast("int"))
    rest = lambda side: F.slice(F.col(side), F.col("n_common") + 1, F.size(side))
    sides = sides.select("pair_id", F.size("c").alias("n_chosen"), F.size("r").alias("n_rejected"), "n_common", F.slice("c", F.lit(1), F.col("n_common")).alias("p"), rest("c").alias("c"), rest("r").alias("r"))
    return sides.select("pair_id", "n_chosen", "n_rejected", "n_common", rendered(F.col("p")).alias("prompt"), rendered(F.col("c")).alias("chosen"), rendered(F.col("r")).alias("rejected"), spans(F.col("c")).alias("chosen_spans"), spans(F.col("r")).alias("rejected_spans"))


def neighbours(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as pairs: of ids 2 k and 2 k + 1 the even one is the chosen one."""
    return conversations.where("conv_id is not null").select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")
