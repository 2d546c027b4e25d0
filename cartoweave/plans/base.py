"""The relations that the queries read, as frames and as SQL with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.functions.text import simple_words, user_key
from cartoweave.session import table


def tweets(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The id and the named columns of tweets, repeated rows once; only these columns are read and shuffled."""
    return table(spark, d, "raw_tweets").select("tweet_id", *cols).distinct()


def tweet_tokens(spark: SparkSession, d: str) -> DataFrame:
    """(user, token) stream of the tweets' simple words."""
    return tweets(spark, d, "username", "text").where("username is not null and text is not null").select(user_key("username").alias("user"), F.explode(simple_words(F.lower("text"))).alias("token"))


def word_counts(spark: SparkSession, d: str) -> DataFrame:
    """(user, token, count) of the word vectors; rows repeated, null, zero or negative do not count."""
    rows = table(spark, d, "fake_word_vectors").where("user_id is not null and word_id is not null and count > 0").select("user_id", "word_id", "count").distinct()
    return rows.groupBy(F.col("user_id").alias("user"), F.col("word_id").alias("token")).agg(F.sum("count").alias("count"))


def people(spark: SparkSession, d: str) -> DataFrame:
    """(user, x, y) of the map's users, imports repeated once; a coordinate that is not a number is null."""
    number = lambda c: F.nanvl(c, F.lit(None).cast("double"))
    return table(spark, d, "user_docs").where("doc_type = 'twuser' and trained_as_id is not null").select(F.col("trained_as_id").alias("user"), number("x_coord").alias("x"), number("y_coord").alias("y")).distinct()


def positioned(spark: SparkSession, d: str) -> DataFrame:
    """(token, user, x, y, count): named words of users with a place on the map."""
    named = word_counts(spark, d).join(table(spark, d, "fake_words").select(F.col("word_id").alias("token"), "word"), "token")
    return named.join(people(spark, d), "user").select(F.col("word").alias("token"), "user", "x", "y", "count")


def requests(spark: SparkSession, d: str) -> DataFrame:
    """Work requests, made of the events."""
    e, i = table(spark, d, "events"), F.col("event_id")
    kind = F.when(F.col("event_type").isin("view", "click"), "download_request").when(F.col("event_type").isin("purchase", "error"), "hash_request").otherwise("other")
    return e.select(
        i.alias("request_id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("username"),
        (i % 3 + 1).alias("page"),
        (i % 4).alias("priority"),
        F.col("ts").alias("request_time"),
        kind.alias("doc_type"),
        F.when(i % 3 == 0, F.col("ts") + F.expr("interval 30 seconds")).alias("started_time"),
        F.when((i % 5 == 0) | (F.col("user_id") % 4 == 0), F.col("ts") + F.expr("interval 60 seconds")).alias("completed_time"),
        F.when(i % 2 == 1, i % 6).alias("attempts"),
    )


def request_events(spark: SparkSession, d: str) -> DataFrame:
    """(request_id, event, ts): what happened to the request of each user."""
    names = {"signup": "requested", "view": "started", "purchase": "completed", "error": "failed"}
    event = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])[F.col("event_type")]
    return table(spark, d, "events").select(F.col("user_id").cast("string").alias("request_id"), event.alias("event"), "ts")


TWEETS = "tweets as (select distinct _id, tweet_id, doc_type, provider_namespace, username, text, lang, created_at from raw_tweets)"
TOKENS = TWEETS + ", tokens as (select \"user\", token from (select '@' || lower(username) as \"user\", unnest(regexp_split_to_array(lower(text), '[^\\w]+')) as token from tweets where username is not null and text is not null) where token <> '')"
COUNTS = "wc as (select user_id as \"user\", word_id as token, cast(sum(count) as bigint) as count from (select distinct user_id, word_id, count from fake_word_vectors where user_id is not null and word_id is not null and count > 0) group by all)"
PEOPLE = "people as (select distinct trained_as_id as \"user\", case when isnan(x_coord) then null else x_coord end as x, case when isnan(y_coord) then null else y_coord end as y from user_docs where doc_type = 'twuser' and trained_as_id is not null)"
POSITIONED = COUNTS + ", " + PEOPLE + ", positioned as (select w.word as token, wc.\"user\", p.x, p.y, wc.count from wc join fake_words w on w.word_id = wc.token join people p on p.\"user\" = wc.\"user\")"
ON_MAP = "isfinite(x) and isfinite(y) and x > -104 and x < 56 and y > -104 and y < 56"
QUAD = "list_transform(range(14, -1, -1), lambda i: 2 * (((try_cast(trunc(-(y + 104) * 204.8) as bigint) & 32767) >> i) & 1) + ((try_cast(trunc((x + 104) * 204.8) as bigint) >> i) & 1))"
REQUESTS = """requests as (select event_id as request_id, 'u' || user_id as username, event_id % 3 + 1 as page, event_id % 4 as priority, ts as request_time,
 case when event_type in ('view', 'click') then 'download_request' when event_type in ('purchase', 'error') then 'hash_request' else 'other' end as doc_type,
 case when event_id % 3 = 0 then ts + interval 30 second end as started_time, case when event_id % 5 = 0 or user_id % 4 = 0 then ts + interval 60 second end as completed_time,
 case when event_id % 2 = 1 then event_id % 6 end as attempts from events)"""
REQUEST_EVENTS = """revents as (select cast(user_id as varchar) as request_id, case event_type when 'signup' then 'requested' when 'view' then 'started' when 'purchase' then 'completed' when 'error' then 'failed' end as event, ts from events)"""
