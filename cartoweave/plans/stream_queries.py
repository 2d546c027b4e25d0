"""Streaming forms over real streams of files, with the SQL of the same result over the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.operators import trigram_model as M
from cartoweave.operators import views as V
from cartoweave.plans import base as B
from cartoweave.plans import text_queries as X
from cartoweave.plans.queue_queries import _folder
from cartoweave.session import materialise, table
from cartoweave.streaming import hose as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: Files that a table is streamed in; one is taken at each trigger.
FILES, LATE, THRESHOLD = 3, "36500 days", 0.5


def query(sql: str):  # noqa: ANN201
    """Register a function as a query, with the SQL that states the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _stream(spark: SparkSession, rows: DataFrame) -> DataFrame:
    path = _folder(spark, "stream")
    rows.repartition(FILES).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark: SparkSession, made: DataFrame, batch: Callable[[DataFrame, int], None], mode: str) -> None:
    made.writeStream.foreachBatch(batch).outputMode(mode).option("checkpointLocation", _folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()


def _last(spark: SparkSession, made: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of every key of a stream in update mode."""
    target = _folder(spark, "updates")
    _run(spark, made, lambda b, epoch: b.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}"), "update")
    return V.top_by(spark.read.option("basePath", target).parquet(f"{target}/epoch=*"), keys, "epoch", []).drop("epoch")


_LINES = "lines as (select distinct tweet_id, text, username from raw_tweets)"
_TWEET_TRI = f"""twords as (select tweet_id, unnest(regexp_split_to_array(array_to_string(list_filter(regexp_split_to_array(text, '{X.WS}'), lambda w: w <> '' and not starts_with(w, 'http') and w[1] not in ('#', '@') and w <> 'RT' and not regexp_matches(w, '^-?\\$?\\d+\\.?\\d*$')), ' '), '[!@#$%^&*_+|}}{{;":?><,./ ]+')) as w from lines),
thex as (select tweet_id, '3C' || hex(encode(w)) || '3E' as h from twords where w <> ''),
ttri as (select tweet_id, substr(h, 2 * i + 1, 6) as tg from (select tweet_id, h, unnest(range(0, length(h) // 2 - 2)) as i from thex))"""
_HOSE = X._EVIDENCE + ", " + _LINES + ", " + _TWEET_TRI + """, tscores as (select lines.tweet_id, lines.username, lines.text, coalesce(m.score, 0) as score from lines left join (select tweet_id, avg(coalesce(evidence, (select log2(s.off) + s.norm - log2(a.off) - a.norm from s, a))) as score from ttri left join ev using (tg) group by tweet_id) m using (tweet_id))"""


def _hose(spark: SparkSession, d: str) -> DataFrame:
    """Tweets as lines, each once, with a time that is never null."""
    rows = table(spark, d, "raw_tweets").groupBy("tweet_id", "text", "username").agg(F.min("created_at").alias("t"))
    return rows.select("tweet_id", "text", F.col("username").alias("screen_name"), F.coalesce(F.col("t"), F.lit("2000-01-01").cast("timestamp_ntz")).cast("timestamp").alias("created_at"))


@query(_HOSE + " select tweet_id, round(score, 6) as score from tscores")
def t06_scored_hose(spark: SparkSession, d: str) -> DataFrame:
    """The score of every tweet of the stream against the English model, by a stream-static join."""
    _, model, other = X._models(spark, d)
    evidence, default = M.evidence(model, other)
    made = H.scored_stream(_stream(spark, _hose(spark, d)), materialise(evidence), default, ("tweet_id",), "created_at", "word_aware", LATE)
    return _last(spark, made, ["tweet_id"]).select("tweet_id", F.round("score", 6).alias("score"))


@query(_HOSE + f" select score >= {THRESHOLD} as good, count(*) as lines, count(distinct username) as users from tscores group by all")
def t07_split_hose(spark: SparkSession, d: str) -> DataFrame:
    """Lines and users on either side of a threshold, as two sinks received them."""
    _, model, other = X._models(spark, d)
    good, bad = _folder(spark, "good"), _folder(spark, "rejected")
    lines = _stream(spark, _hose(spark, d).drop("created_at"))
    _run(spark, lines, H.split_sink(model, other, THRESHOLD, good, bad, "word_aware"), "append")
    sides = [spark.read.parquet(p).select(F.lit(side).alias("good"), "screen_name") for p, side in ((good, True), (bad, False))]
    return sides[0].union(sides[1]).groupBy("good").agg(F.count("*").alias("lines"), F.count_distinct("screen_name").alias("users"))


@query(X._MEANS + " select screen_name, tweets, round(m, 6) as mean_score from means")
def t08_running_means(spark: SparkSession, d: str) -> DataFrame:
    """Tweets and mean score of every user, kept up to date by a stream of scores."""
    scores = X._scores(spark, d).join(table(spark, d, "documents").select("doc_id", "screen_name"), "doc_id").select("screen_name", "score")
    return _last(spark, H.user_running_means(_stream(spark, scores)), ["screen_name"]).select("screen_name", "tweets", F.round("mean_score", 6).alias("mean_score"))


@query("with " + B.TOKENS + ' select "user", token, count(*) as count from tokens group by all')
def t11_running_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(user, token) counts kept up to date by a stream of tweets."""
    rows = B.tweets(spark, d, "username", "text").where("username is not null and text is not null").select("username", "text")
    return _last(spark, H.running_token_counts(_stream(spark, rows), "username", "text"), ["user", "token"])
