"""Byte-trigram language models.

A model is a frame (tg, n); tg is a byte trigram in hexadecimal. Counting and scoring explode trigrams inside a task and
aggregate there first, so one row per trigram or text and task is shuffled. The evidence of a model has at most 256 ** 3 rows
by definition; it is broadcast only when its counted size is small and shuffled else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.functions.text import byte_hex, trigrams
from cartoweave.session import spread

ALL_TRIGRAMS = 256**3
OFFSET, OTHER_OFFSET = 0.5, 1.0
#: Rows of evidence up to which it is broadcast.
BROADCAST_ROWS = 200_000


def trigram_counts(texts: DataFrame, text_col: str, mode: str = "word_aware_lc") -> DataFrame:
    """(tg, n) over all texts."""
    each = spread(texts.select(text_col)).select(F.explode(trigrams(text_col, mode)).alias("t"))
    return each.groupBy(byte_hex("t").alias("tg")).agg(F.count("*").alias("n"))


def add_models(*models: DataFrame) -> DataFrame:
    """Counts of several models added up."""
    made = models[0]
    for m in models[1:]:
        made = made.unionByName(m)
    return made.groupBy("tg").agg(F.sum("n").alias("n"))


def scalars(model: DataFrame, offset_factor: float = OFFSET) -> DataFrame:
    """One row (total, known, mean_count, count_offset, log_norm, min_evidence)."""
    total = F.sum("n").cast("double")
    row = model.agg(total.alias("total"), F.count("*").alias("known"))
    row = row.withColumn("mean_count", F.col("total") / ALL_TRIGRAMS).withColumn("count_offset", F.col("mean_count") * offset_factor)
    row = row.withColumn("log_norm", -F.log2(F.col("total") + F.lit(float(ALL_TRIGRAMS)) * F.col("count_offset")))
    return row.withColumn("min_evidence", F.log2("count_offset") + F.col("log_norm"))


def evidence(model: DataFrame, other: DataFrame | None = None, offset_factor: float = OFFSET, other_offset_factor: float = OTHER_OFFSET) -> tuple[DataFrame, float]:
    """(tg, evidence) and the evidence of trigrams that neither model knows.

    Without another model the opposing hypothesis is uniform noise (none at factor 0). An empty model has no evidence.
    """
    s = scalars(model, offset_factor).first()
    if not s["total"]:
        return model.select("tg", F.lit(0.0).alias("evidence")), 0.0
    own = model.select("tg", (F.log2(F.col("n") + s["count_offset"]) + s["log_norm"]).alias("own"))
    if other is None:
        noise = 0.0
        if other_offset_factor:
            import math

            noise = math.log2((s["mean_count"] + s["count_offset"]) * other_offset_factor) + s["log_norm"]
        return own.select("tg", (F.col("own") - noise).alias("evidence")), s["min_evidence"] - noise
    o = scalars(other, other_offset_factor).first()
    theirs = other.select("tg", (F.log2(F.col("n") + o["count_offset"]) + o["log_norm"]).alias("theirs"))
    both = own.join(theirs, "tg", "full")
    value = F.coalesce("own", F.lit(s["min_evidence"])) - F.coalesce("theirs", F.lit(o["min_evidence"]))
    return both.select("tg", value.alias("evidence")), s["min_evidence"] - o["min_evidence"]


def scored(texts: DataFrame, id_cols: list[str], text_col: str, model: DataFrame, other: DataFrame | None = None, mode: str = "word_aware_lc", offset_factor: float = OFFSET, other_offset_factor: float = OTHER_OFFSET) -> DataFrame:
    """(id_cols, score): mean evidence per trigram; 0 for texts without any, which keep their row."""
    table, default = evidence(model, other, offset_factor, other_offset_factor)
    small = table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    each = spread(texts.select(*id_cols, text_col)).select(*id_cols, F.explode_outer(trigrams(text_col, mode)).alias("t")).withColumn("tg", byte_hex("t"))
    hit = each.join(F.broadcast(table) if small else table, "tg", "left")
    gain = F.when(F.col("tg").isNotNull(), F.coalesce("evidence", F.lit(default)))
    return hit.groupBy(*id_cols).agg(F.coalesce(F.avg(gain), F.lit(0.0)).alias("score"))


def bisect(scores: DataFrame, threshold: float, score: Column | str = "score") -> tuple[DataFrame, DataFrame]:
    """P10: rows with a score of at least the threshold, and the rest (null scores are rest)."""
    good = F.coalesce((F.col(score) if isinstance(score, str) else score) >= threshold, F.lit(False))
    return scores.where(good), scores.where(~good)


def user_means(scores: DataFrame, user_col: str, score_col: str = "score") -> DataFrame:
    """(user, tweets, mean_score)."""
    return scores.groupBy(user_col).agg(F.count("*").alias("tweets"), F.avg(score_col).alias("mean_score"))


def partition_users(means: DataFrame, threshold: float) -> DataFrame:
    """Users with ``kept``: whether their mean reaches the threshold."""
    return means.withColumn("kept", F.coalesce(F.col("mean_score") >= threshold, F.lit(False)))


def tweets_per_user_histogram(rows: DataFrame, user_col: str) -> DataFrame:
    """(tweets, users) for every number of tweets from 1 to the largest, empty ones too."""
    per = rows.groupBy(user_col).agg(F.count("*").alias("tweets")).groupBy("tweets").agg(F.count("*").alias("users"))
    span = per.agg(F.max("tweets").alias("m")).where("m is not null").select(F.explode(F.sequence(F.lit(1).cast("bigint"), "m")).alias("tweets"))
    return span.join(per, "tweets", "left").select("tweets", F.coalesce("users", F.lit(0).cast("bigint")).alias("users"))
