"""Queries of requests, sources, sinks, set operations, streaming twins and numerical operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.functions import quad as Q
from cartoweave.ml import people as P
from cartoweave.ml import rbm as R
from cartoweave.operators import requests as W
from cartoweave.operators import views as V
from cartoweave.plans import base as B
from cartoweave.session import checkpoint_dir, materialise, table
from cartoweave.sources import corpora as S
from cartoweave.sources import readers, writers
from cartoweave.streaming import hose as H

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function as a query, with the SQL that states the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors reach, under the shared checkpoint folder."""
    import uuid

    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OPEN = "completed_time is null"
_TRIES = "(attempts is null or attempts < 3)"
_VIEWS = {
    "rel_p04_queued": ("queued_downloads", f"doc_type = 'download_request' and {_OPEN} and started_time is null and {_TRIES}"),
    "rel_p05_underway": ("underway_downloads", f"doc_type = 'download_request' and {_OPEN} and started_time is not null and {_TRIES}"),
    "rel_p06_queued_hashes": ("queued_hashes", f"doc_type = 'hash_request' and {_OPEN} and started_time is null"),
    "rel_p07_underway_hashes": ("underway_hashes", f"doc_type = 'hash_request' and {_OPEN} and started_time is not null"),
    "rel_p08_pending_by_user": ("pending_user_downloads", f"doc_type = 'download_request' and {_OPEN} and {_TRIES}"),
}


def _view_query(key: str, view: str, predicate: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return V.request_view(B.requests(spark, d), view).select("request_id", "username", "page", "priority", "request_time")

    run.__name__, run.__doc__ = key, f"{key[4:7].upper()}: requests of the view {view}."
    query(f"with {B.REQUESTS} select request_id, username, page, priority, request_time from requests where {predicate}")(run)


for _key, (_view, _predicate) in _VIEWS.items():
    _view_query(_key, _view, _predicate)


@query(f"with {B.REQUESTS} select request_id, username, page from requests where {_VIEWS['rel_p04_queued'][1]} order by priority, request_time, request_id limit 350")
def t02_dequeue(spark: SparkSession, d: str) -> DataFrame:
    """The next 350 requests."""
    return W.dequeue(B.requests(spark, d)).select("request_id", "username", "page")


@query("with u as (select distinct username from raw_tweets where username is not null) select sha256(username || '/' || page) as request_id, username, page, cast(0 as bigint) as priority, 'download_request' as doc_type, timestamp '2024-01-01 00:00:00' as request_time from u, (select unnest(range(1, 4)) as page)")
def t01_enqueue(spark: SparkSession, d: str) -> DataFrame:
    """Three pages of requests for every user."""
    return _enqueued(spark, d, 0, "2024-01-01").select("request_id", "username", "page", "priority", "doc_type", "request_time")


def _enqueued(spark: SparkSession, d: str, priority: int, day: str) -> DataFrame:
    return W.download_requests(table(spark, d, "raw_tweets"), "username", priority, at=F.lit(day).cast("timestamp_ntz"))


@query("with u as (select distinct username from raw_tweets where username is not null), q as (select sha256(username || '/' || page) as request_id, username, page, p as priority, t as request_time from u, (select unnest(range(1, 4)) as page), (values (1, timestamp '2024-01-01'), (0, timestamp '2024-01-02')) v(p, t)) select username, page, cast(priority as bigint) as priority from q order by priority, request_time, request_id limit 350")
def t01_enqueue_dequeue(spark: SparkSession, d: str) -> DataFrame:
    """Requests of two days and priorities go into the queue and the first 350 come out."""
    both = _enqueued(spark, d, 1, "2024-01-01").union(_enqueued(spark, d, 0, "2024-01-02"))
    return W.dequeue(both).select("username", "page", "priority")


@query(f"""with {B.REQUEST_EVENTS}, k as (select * from revents where event is not null and request_id is not null and ts is not null),
a as (select request_id, cast(sum(case when event = 'failed' then 1 else 0 end) as bigint) as attempts, min(case when event = 'completed' then ts end) as completed_time, max(case when event in ('started', 'failed') then {{'ts': ts, 'event': event}} end) as last from k group by request_id),
b as (select request_id, attempts, case when last.event = 'started' then last.ts end as started_time, completed_time from a)
select request_id, attempts, started_time, completed_time, case when completed_time is not null then 'completed' when attempts >= 3 then 'dead' when started_time is not null then 'underway' else 'queued' end as state from b""")
def t03_state(spark: SparkSession, d: str) -> DataFrame:
    """The state of every request after its events."""
    return W.request_state(B.request_events(spark, d))


@query(f"with {B.REQUESTS} select distinct username from requests where username not in (select username from requests where {_VIEWS['rel_p08_pending_by_user'][1]})")
def j10_users_without_pending(spark: SparkSession, d: str) -> DataFrame:
    """Users without an open download."""
    r = B.requests(spark, d)
    return V.users_without_pending(r.select("username").distinct(), r)


@query("select tweet_id, text, stored_at from (select tweet_id, text, stored_at, row_number() over (partition by tweet_id order by stored_at desc nulls last) as r from raw_tweets) where r = 1")
def t05_upsert(spark: SparkSession, d: str) -> DataFrame:
    """The latest row of every tweet."""
    rows = table(spark, d, "raw_tweets").select("tweet_id", "text", "stored_at")
    return W.upserted(rows.where("false"), rows, "tweet_id", "stored_at")


@query("with h as (select distinct user_id, hash from twusers), c as (select user_id, any_value(coords) as coords from twusers where coords is not null group by user_id) select distinct u.trained_as_id as user_id, coalesce(c.coords, 'none') as coords from user_docs u left join c on c.user_id = u.trained_as_id where u.trained_as_id is not null")
def r06_stored_results(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates stored onto user rows where there are any."""
    users = table(spark, d, "user_docs").where("trained_as_id is not null").select(F.col("trained_as_id").alias("user_id"), F.lit("none").alias("coords")).distinct()
    fresh = table(spark, d, "twusers").where("coords is not null").groupBy("user_id").agg(F.min("coords").alias("coords"))
    return W.updated(users, fresh, "user_id", "coords")


@query(f"with {B.REQUESTS} select request_id, least(600.0::double, 0.5::double * pow(2.0::double, coalesce(attempts, 0))) as wait from requests")
def f34_backoff(spark: SparkSession, d: str) -> DataFrame:
    """the wait of every request after its failures."""
    return B.requests(spark, d).select("request_id", W.backoff(F.coalesce("attempts", F.lit(0))).alias("wait"))


@query("select distinct _id, username from raw_tweets where starts_with(_id, 'tweet_')")
def s13_paged_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Tweets by key, repeated keys once."""
    return readers.documents_by_key(table(spark, d, "raw_tweets"), "_id", "tweet_").select("_id", "username")


@query("select user_id, word_id, count from fake_word_vectors")
def s06_csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The word vectors written as quoted CSV and read again."""
    path = _folder(spark, "csv")
    writers.quoted_csv(table(spark, d, "fake_word_vectors").select("user_id", "word_id", "count"), path)
    return readers.quoted_csv(spark, path, "user_id long, word_id long, count long")


@query("select distinct tweet_id, username, text from raw_tweets")
def s14_export_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Tweets exported as gzip JSON by source language and read again, recursively."""
    path = _folder(spark, "export")
    rows = table(spark, d, "raw_tweets").select("tweet_id", "username", "text").distinct()
    writers.export_by_user(rows.withColumn("shelf", F.substring(F.lower("username"), 1, 1)), path, "shelf")
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("tweet_id", T.LongType()), T.StructField("username", T.StringType()), T.StructField("text", T.StringType())])
    return readers.json_lines(spark, path, schema, recursive=True)


@query("with per as (select word_id as token, count(*) as n from fake_word_vectors where word_id is not null group by word_id) select token, n, cast(floor((sum(n) over (order by token) - n) / 1000) as bigint) as file_no from per")
def s10_file_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Files of about a thousand rows in which no token is cut."""
    return writers.file_numbers(table(spark, d, "fake_word_vectors").where("word_id is not null").select(F.col("word_id").alias("token")), 1000)


@query("select row_id::varchar || ',' || array_to_string([printf('%.10f', c0), printf('%.10f', c1), printf('%.10f', c2)], ',') as value from test_codes where isfinite(c0) and isfinite(c1) and isfinite(c2)")
def s18_code_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of codes with ten decimals."""
    cols = ["c0", "c1", "c2"]
    rows = table(spark, d, "test_codes").where(" and ".join(f"{c} is not null and not isnan({c})" for c in cols))
    return writers.formatted_codes(rows.select("row_id", F.array(*cols).alias("v")), "row_id", "v")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


_LINES = "with lines as (select doc, line_no - 1 as line_no, l[line_no] as line from (select doc_id as doc, string_split(text, chr(10)) as l, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents where text is not null))"


@query(_LINES + " select doc, cast(line_no as int) as line_no, string_split(line, '> ')[2] as message from lines where len(string_split(line, '> ')) = 2 and not starts_with(string_split(line, '> ')[2], '*.split')")
def s20_chat_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of chat lines."""
    return S.chat_messages(_lines(spark, d)).select("doc", "line_no", "message")


@query(_LINES + """, m as (select doc, line_no, regexp_replace(case when contains(line, '>') then substr(line, instr(line, '>') + 1) when contains(line, ')') then substr(line, instr(line, ')') + 1) when contains(line, ']') then substr(line, instr(line, ']') + 1) end, '^\\s+', '') as message from lines)
select doc, cast(line_no as int) as line_no, message from m where length(message) > 0 and message[1] not in ('+', '(', '[', '/', '>', '-', '|', '=', '0')""")
def s20_quote_messages(spark: SparkSession, d: str) -> DataFrame:
    """Messages of quoted lines."""
    return S.quote_messages(_lines(spark, d)).select("doc", "line_no", "message")


_PARTS = {"es": 5, "de": 2, "en": 1}


@query("""with b as (select doc_id, lang, octet_length(encode(text)) as bytes from documents where lang in ('es', 'de', 'en') and text is not null), c as (select cast(coalesce(sum(bytes), 0) as bigint) // 5 as chunk from b where lang = 'es'),
r as (select doc_id, lang, bytes, coalesce(sum(bytes) over (partition by lang order by doc_id rows between unbounded preceding and 1 preceding), 0) as before from b)
select doc_id, lang from r, c where lang = 'es' or before < chunk * case lang when 'de' then 2 else 1 end""")
def s21_mixed_corpus(spark: SparkSession, d: str) -> DataFrame:
    """Documents of three languages within their byte budgets."""
    return S.mixed_by_bytes(table(spark, d, "documents").select("doc_id", "lang", "text"), "lang", "doc_id", "text", _PARTS, "es").select("doc_id", "lang")


@query("select 'both' as side, count(*) as n from (select lower(username) as u from raw_tweets where username is not null intersect select lower(screen_name) from twusers) union all select 'tweets only', count(*) from (select lower(username) from raw_tweets where username is not null except select lower(screen_name) from twusers)")
def u02_user_sets(spark: SparkSession, d: str) -> DataFrame:
    """Users of tweets that are and are not stored."""
    a = table(spark, d, "raw_tweets").where("username is not null").select(F.lower("username").alias("u"))
    b = table(spark, d, "twusers").select(F.lower("screen_name").alias("u"))
    return a.intersect(b).agg(F.count("*").alias("n")).select(F.lit("both").alias("side"), "n").union(a.subtract(b).agg(F.count("*").alias("n")).select(F.lit("tweets only").alias("side"), "n"))


@query("select k, kind, id from (select username as k, 1 as kind, cast(tweet_id as varchar) as id from (select distinct username, tweet_id from raw_tweets where username is not null and doc_type = 'raw_tweet') union all select screen_name, 0, cast(user_id as varchar) from (select distinct screen_name, user_id from twusers where screen_name is not null))")
def j11_users_and_tweets(spark: SparkSession, d: str) -> DataFrame:
    """Users and their tweets under one composite key, users first."""
    tweets = table(spark, d, "raw_tweets").where("username is not null and doc_type = 'raw_tweet'").select(F.col("username").alias("k"), F.lit(1).alias("kind"), F.col("tweet_id").cast("string").alias("id")).distinct()
    users = table(spark, d, "twusers").where("screen_name is not null").select(F.col("screen_name").alias("k"), F.lit(0).alias("kind"), F.col("user_id").cast("string").alias("id")).distinct()
    return tweets.union(users)


@query("with k as (select subject, row_number() over (order by subject) - 1 as i from (select distinct subject from subjects)) select example_id, array_to_string(list_transform(range((select count(*) from k)), lambda j: case when j = k.i then 1 else 0 end), '') as hot, cast(k.i as bigint) as last_label from subject_examples e join k on k.subject = e.subject")
def j12_multi_hot(spark: SparkSession, d: str) -> DataFrame:
    """Multi-hot labels of the examples and their last set position."""
    from cartoweave.operators.counts import dense_ids

    codes = materialise(dense_ids(table(spark, d, "subjects"), "subject", "i"))
    n = codes.count()
    rows = table(spark, d, "subject_examples").join(F.broadcast(codes), "subject").groupBy("example_id").agg(F.collect_set("i").alias("set"))
    hot = rows.select("example_id", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")), lambda j: F.array_contains("set", j).cast("int")).alias("hot"))
    return hot.select("example_id", F.array_join(F.transform("hot", lambda x: x.cast("string")), "").alias("hot"), R.argmax_label("hot").cast("bigint").alias("last_label"))


@query("select _id, stored_at from raw_tweets order by stored_at desc nulls last, _id limit 50")
def o10_recent(spark: SparkSession, d: str) -> DataFrame:
    """The fifty rows stored last."""
    return table(spark, d, "raw_tweets").select("_id", "stored_at").orderBy(F.desc_nulls_last("stored_at"), "_id").limit(50)


@query("select time_bucket(interval '1 hour', ts) as start, time_bucket(interval '1 hour', ts) + interval 1 hour as \"end\", event_type, count(*) as n from events where ts is not null group by all")
def t12_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Events by hour and type."""
    return _times(H.windowed_counts(_stamped(spark, d), "ts", ["event_type"], "1 hour"))


@query("select s as start, s + interval 1 hour as \"end\", event_type, count(*) as n from (select event_type, unnest([time_bucket(interval '30 minutes', ts), time_bucket(interval '30 minutes', ts) - interval 30 minute]) as s from events where ts is not null) group by all")
def t12_sliding(spark: SparkSession, d: str) -> DataFrame:
    """Events by hours that begin every half hour."""
    return _times(H.windowed_counts(_stamped(spark, d), "ts", ["event_type"], "1 hour", "30 minutes"))


@query("""with g as (select user_id, ts, case when ts >= lag(ts) over w + interval 30 minute or lag(ts) over w is null then 1 else 0 end as new from events where ts is not null window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(new) over (partition by user_id order by ts, new desc rows unbounded preceding) as sid from g) select min(ts) as start, max(ts) + interval 30 minute as "end", user_id, count(*) as n from s group by user_id, sid""")
def t12_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of users that end after half an hour."""
    return _times(H.session_counts(_stamped(spark, d), "ts", ["user_id"], "30 minutes"))


def _stamped(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _times(df: DataFrame) -> DataFrame:
    return df.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query()
def t03_machine(spark: SparkSession, d: str) -> DataFrame:
    """The same states from the stream of events, one file trigger at a time."""
    path, target = _folder(spark, "events"), _folder(spark, "states")
    events = B.request_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    events.where("event is not null").repartition(2).write.parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{target}/epoch={epoch}")

    run = H.request_machine(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", _folder(spark, "progress")).trigger(availableNow=True).start()
    run.awaitTermination()
    seen = spark.read.option("basePath", target).parquet(f"{target}/epoch=*")
    return V.top_by(seen, ["request_id"], "epoch", []).select("request_id", "attempts", "state")


@query("select id, neighbour, round(distance, 6) as distance from (select q.row_id as id, r.row_id as neighbour, sqrt(" + " + ".join(f"(q.c{i} - r.c{i}) * (q.c{i} - r.c{i})" for i in range(16)) + ") as distance from test_codes q join test_codes r on q.row_id <> r.row_id where q.row_id % 50 = 0 and " + " and ".join(f"isfinite(q.c{i}) and isfinite(r.c{i})" for i in range(16)) + ") qualify row_number() over (partition by id order by distance, neighbour) <= 5")
def m20_nearest_codes(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest codes of every fiftieth code."""
    v = F.array(*[F.col(f"c{i}") for i in range(16)])
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table(spark, d, "test_codes").where(finite).select(F.col("row_id").alias("id"), v.alias("v"))
    return P.nearest_codes(rows, rows.where("id % 50 = 0"), 5).select("id", "neighbour", F.round("distance", 6).alias("distance"))


@query("select row_id as id, round(1 / (1 + exp(-(c0 * 0.5 - c1 + c2 * 0.25 + 0.1))), 9) as h0, round(1 / (1 + exp(-(c1 * 0.75 - c0 * 0.2 - 0.3))), 9) as h1 from test_codes where isfinite(c0) and isfinite(c1) and isfinite(c2)")
def m07_encode(spark: SparkSession, d: str) -> DataFrame:
    """Codes of one fixed small layer."""
    import numpy as np

    layer = [(np.array([[0.5, -0.2], [-1.0, 0.75], [0.25, 0.0]]), np.array([0.1, -0.3]))]
    cols = ["c0", "c1", "c2"]
    rows = table(spark, d, "test_codes").where(" and ".join(f"{c} is not null and not isnan({c})" for c in cols)).select("row_id", F.array(*cols).alias("v"))
    made = R.encode(rows, "row_id", "v", layer)
    return made.select("id", F.round(F.col("code")[0], 9).alias("h0"), F.round(F.col("code")[1], 9).alias("h1"))


@query()
def m05_semantic_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of all embeddings by an autoencoder fitted on all of them up to the limit of the fit."""
    rows = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: 1 / (1 + F.exp(-8 * x.cast("double")))).alias("v"))
    x = R.training_matrix(rows, "vec_id", "v")
    half = R.pretrain(x, [32, 8])
    net = R.fine_tune(x[: len(x) * 4 // 5], R.unrolled(half), x[len(x) * 4 // 5 :])
    return R.encode(rows, "vec_id", "v", net[: len(half)])


@query()
def m11_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Coordinates of all codes: all up to t-SNE's limit by exact t-SNE, every row placed next to them."""
    from cartoweave.ml import tsne

    v = F.array(*[F.col(f"c{i}") for i in range(16)])
    rows = table(spark, d, "test_codes").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))).select("row_id", v.alias("v"))
    x = R.training_matrix(rows, "row_id", "v", tsne.LIMIT)
    return tsne.place_rows(rows, "row_id", "v", x, tsne.annealed(x, 20.0))


@query("with c as (select row_id, " + ", ".join(f"c{i}" for i in range(16)) + " from test_codes where " + " and ".join(f"isfinite(c{i})" for i in range(16)) + ") select row_id as id, round(" + " + ".join(f"pow(c{i} - avg(c{i}) over (), 2)" for i in range(16)) + ", 6) as length from c")
def m19_principal_axes(spark: SparkSession, d: str) -> DataFrame:
    """Squared lengths of all codes on their principal axes, which a rotation leaves as they are."""
    from cartoweave.ml import tsne

    v = F.array(*[F.col(f"c{i}") for i in range(16)])
    rows = table(spark, d, "test_codes").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select("row_id", v.alias("v"))
    made = tsne.principal(rows, "row_id", "v", 16)
    return made.select("id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("length"))


@query()
def m16_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of the users on the map with the orientation of its components."""
    return P.components(P.fit_mixture(B.people(spark, d).where(Q.on_map("x", "y")), 5))


@query(f"with {B.PEOPLE}, c as (select covar_pop(x, x) as xx, covar_pop(x, y) as xy, covar_pop(y, y) as yy from people where {B.ON_MAP}) select round(degrees(atan2(2 * xy, xx - yy)) / 2, 6) as angle, round(sqrt((xx + yy) / 2 + sqrt(pow((xx - yy) / 2, 2) + xy * xy)), 6) as long, round(sqrt((xx + yy) / 2 - sqrt(pow((xx - yy) / 2, 2) + xy * xy)), 6) as short from c")
def m18_orientation(spark: SparkSession, d: str) -> DataFrame:
    """Orientation of all users on the map."""
    c = B.people(spark, d).where(Q.on_map("x", "y")).agg(F.covar_pop("x", "x").alias("xx"), F.covar_pop("x", "y").alias("xy"), F.covar_pop("y", "y").alias("yy"))
    angle, long, short = P.orientation(F.col("xx"), F.col("xy"), F.col("yy"))
    return c.select(F.round(angle, 6).alias("angle"), F.round(long, 6).alias("long"), F.round(short, 6).alias("short"))


@query()
def m17_word_labels(spark: SparkSession, d: str) -> DataFrame:
    """Mixture means of every word over the users on the map."""
    words = [r[0] for r in table(spark, d, "fake_words").where("word is not null").select("word").distinct().orderBy("word").limit(10_000).collect()]
    rows = B.positioned(spark, d).where(Q.on_map("x", "y")).groupBy("user", "x", "y", "token").agg(F.sum("count").cast("double").alias("n"))
    per = rows.groupBy("user", "x", "y").agg(F.map_from_entries(F.collect_list(F.struct("token", "n"))).alias("m"))
    histo = F.transform(F.array(*[F.lit(w) for w in words]), lambda w: F.coalesce(F.try_element_at("m", w), F.lit(0.0)))
    return P.word_labels(per.select("x", "y", histo.alias("histo")), words)


@query()
def m09_softmax(spark: SparkSession, d: str) -> DataFrame:
    """Error rate of a softmax regression of the embeddings' labels."""
    rows = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    _, wrong = R.softmax_regression(rows, "v", "label", 50)
    return spark.createDataFrame([(float(wrong),)], "error_rate double")


@query("select user_id, event_type, count(*) as n from events group by all")
def x01_custom_emitter(spark: SparkSession, d: str) -> DataFrame:
    """A map function written in Python that emits keys and values, reduced by a sum."""
    from collections.abc import Iterator

    import pyarrow as pa

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("user_id"), b.column("event_type"), pa.array([1] * b.num_rows, pa.int64())], ["user_id", "event_type", "value"])

    made = table(spark, d, "events").select("user_id", "event_type").mapInArrow(emit, "user_id long, event_type string, value long")
    return made.groupBy("user_id", "event_type").agg(F.sum("value").alias("n"))


@query("select user_id, event_type, sum(v) as sum, count(v) as count, min(v) as min, max(v) as max, sum(v * v) as sumsqr from (select user_id, event_type, event_id % 7 as v from events) group by all")
def x02_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics reducer over emitted values."""
    emitted = table(spark, d, "events").select("user_id", "event_type", (F.col("event_id") % 7).alias("value"))
    return V.reduced(emitted, ["user_id", "event_type"], "_stats").select("user_id", "event_type", "value.*")


@query("select user_id, count(*) as value from events group by all")
def x02_count_by_level(spark: SparkSession, d: str) -> DataFrame:
    """The counting reducer at the first level of the keys."""
    emitted = table(spark, d, "events").select("user_id", "event_type", F.lit(1).alias("value"))
    return V.reduced(emitted, ["user_id", "event_type"], "_count", 1)


_WEIGHTS = [5.0, 1.0, 3.0, 0.5, 2.5, 8.0]
_BOUNDS = [sum(_WEIGHTS[: i + 1]) / sum(_WEIGHTS) for i in range(len(_WEIGHTS) - 1)]


@query(f"with u as (select (event_id * 0.6180339887498949::double) % 1.0::double as u from events where event_id is not null) select cast(w as int) as word, count(*) as n from (select len(list_filter([{', '.join(f'{b!r}::double' for b in _BOUNDS)}], lambda b: b < u)) as w from u) group by w")
def w11_inverse_cdf(spark: SparkSession, d: str) -> DataFrame:
    """Words drawn through a cumulative distribution from evenly spread numbers."""
    from cartoweave.sources.synthetic import inverse_cdf

    u = (F.col("event_id") * 0.6180339887498949) % 1.0
    return table(spark, d, "events").where("event_id is not null").select(inverse_cdf(u, _WEIGHTS).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query()
def s24_synthetic_counts(spark: SparkSession, d: str) -> DataFrame:
    """Synthetic counts of 200 users and 34 words."""
    from cartoweave.sources.synthetic import topic_counts

    return topic_counts(spark, 200, 34)


@query()
def m15_perplexities(spark: SparkSession, d: str) -> DataFrame:
    """Divergences of the whole sweep of perplexities over all codes up to t-SNE's limit."""
    from cartoweave.ml import tsne

    v = F.array(*[F.col(f"c{i}") for i in range(16)])
    rows = table(spark, d, "test_codes").where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x))).select("row_id", v.alias("v"))
    return spark.createDataFrame(tsne.sweep(R.training_matrix(rows, "row_id", "v", tsne.LIMIT)))
