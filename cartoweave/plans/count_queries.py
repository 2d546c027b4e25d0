"""Queries of counts, vocabulary and training relations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.operators import counts as C
from cartoweave.operators.running import global_rank, running_sum
from cartoweave.plans import base as B
from cartoweave.session import materialise, table

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


@query(f"with {B.TOKENS} select \"user\", count(*) as total from tokens group by \"user\"")
def a06_user_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens per user."""
    return B.tweet_tokens(spark, d).groupBy("user").agg(F.count("*").alias("total"))


@query(f"with {B.TOKENS} select token, count(*) as total from tokens group by token")
def a07_token_totals(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences of every token."""
    return B.tweet_tokens(spark, d).groupBy("token").agg(F.count("*").alias("total"))


@query(f"with {B.TOKENS} select \"user\", token, count(*) as count from tokens group by all")
def a08_user_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts by user and token."""
    return C.token_counts(B.tweet_tokens(spark, d))


_COVER = f"with {B.COUNTS}, cover as (select token, count(distinct \"user\") as users, count(distinct \"user\") / (select count(distinct \"user\") from wc)::double as percent_cover from wc group by token)"


@query(_COVER + " select token, users, round(percent_cover, 9) as percent_cover from cover")
def a09_cover(spark: SparkSession, d: str) -> DataFrame:
    """Users per word and their share."""
    return C.cover(B.word_counts(spark, d)).select("token", "users", F.round("percent_cover", 9).alias("percent_cover"))


_KEPT = _COVER + """, tt as (select token, sum(count) as total from wc group by token), good as (select token from tt join cover using (token) where length(cast(token as varchar)) >= 2 and total >= 10 and percent_cover <= 0.95),
gu as (select "user" from wc group by "user" having sum(count) >= 30), stage as (select * from wc where token in (select token from good) and "user" in (select "user" from gu))"""


def _stage(spark: SparkSession, d: str) -> DataFrame:
    counts = B.word_counts(spark, d)
    return C.kept(counts, C.filter_users(counts), C.pre_filter_tokens(counts, least_length=2))


@query(_KEPT + " select \"user\", token, count from stage")
def j01_semi_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the kept users and words."""
    return _stage(spark, d)


@query(_KEPT + " select token, cast(sum(count) as bigint) as total from stage group by token")
def a10_retotals(spark: SparkSession, d: str) -> DataFrame:
    """A10: totals again after the filters."""
    return C.totals(_stage(spark, d), "token")


@query(_COVER + ", tt as (select token, cast(sum(count) as bigint) as total from wc group by token) select token, total, users from tt join cover using (token) where length(cast(token as varchar)) >= 2 and total >= 10 and percent_cover <= 0.95")
def rel_p12_pre_filter(spark: SparkSession, d: str) -> DataFrame:
    """Words that pass the filter."""
    return C.pre_filter_tokens(B.word_counts(spark, d), least_length=2).select("token", "total", "users")


@query(f"with {B.COUNTS} select \"user\", cast(sum(count) as bigint) as total from wc group by \"user\" having sum(count) >= 30")
def rel_p13_users(spark: SparkSession, d: str) -> DataFrame:
    """Users with enough words."""
    return C.filter_users(B.word_counts(spark, d))


@query(f"with {B.COUNTS} select \"user\", token, count, round(count / sum(count) over (partition by \"user\"), 9) as p from wc")
def j02_probability(spark: SparkSession, d: str) -> DataFrame:
    """P(word | user)."""
    return C.with_probability(B.word_counts(spark, d)).withColumn("p", F.round("p", 9))


@query(f"with {B.COUNTS}, names as (select distinct user_id, screen_name from twusers) select n.screen_name, w.word, wc.count from wc join names n on n.user_id = wc.\"user\" join fake_words w on w.word_id = wc.token")
def j03_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Counts with the names of users and words; unknown ids leave."""
    names = table(spark, d, "twusers").select(F.col("user_id").alias("user"), "screen_name").distinct()
    words = table(spark, d, "fake_words").select(F.col("word_id").alias("token"), "word")
    return C.decoded(C.decoded(B.word_counts(spark, d), names, "user", "screen_name"), words, "token", "word").select("screen_name", "word", "count")


@query(f"with {B.TOKENS} select t.\"user\", w.word_id, count(*) as count from tokens t join fake_words w on lower(w.word) = t.token group by all")
def j04_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Dictionary words in the tweets of every user."""
    words = table(spark, d, "fake_words").select(F.lower("word").alias("token"), "word_id")
    return B.tweet_tokens(spark, d).join(words, "token").groupBy("user", "word_id").agg(F.count("*").alias("count"))


@query(f"with {B.TOKENS}, tt as (select token, count(*) as total from tokens group by token), r as (select token, total, row_number() over (order by total desc) - 1 as rank from tt) select token, total from r where total <= (select total from r where rank = cast(floor((select count(*) from tt) * 0.01) as bigint))")
def w06_common_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Tokens without the most popular hundredth."""
    return C.popular_cutoff(materialise(a07_token_totals(spark, d)), 0.01)


@query(f"with {B.COUNTS} select token, row_number() over (order by token) - 1 as id from (select distinct token from wc)")
def w09_dense_ids(spark: SparkSession, d: str) -> DataFrame:
    """Dense ids of the words."""
    return C.dense_ids(B.word_counts(spark, d), "token", "id")


@query(f"with {B.COUNTS}, u as (select \"user\", row_number() over (order by \"user\") - 1 as user_id from (select distinct \"user\" from wc)), t as (select token, row_number() over (order by token) - 1 as token_id from (select distinct token from wc)) select user_id, token_id, count from wc join u using (\"user\") join t using (token)")
def w09_training_relation(spark: SparkSession, d: str) -> DataFrame:
    """The training relation with dense ids."""
    return C.TokenCounts(B.word_counts(spark, d)).training()


_PROBS = _KEPT + """, pr as (select token, count / sum(count) over (partition by "user") as p from stage), sorted as (select p, row_number() over (order by p) - 1 as r from pr),
bounds as (select cast(b as int) as bucket, p as bound from sorted join (select unnest(range(10)) as b) on r = b * ((select count(*) from pr) // 10))"""


def _probabilities(spark: SparkSession, d: str) -> DataFrame:
    return materialise(C.with_probability(_stage(spark, d)).select("token", "p"))


@query(_PROBS + " select bucket, round(bound, 9) as bound from bounds")
def w08_deciles(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of ten equally filled buckets of the probabilities."""
    return C.boundaries(_probabilities(spark, d)).select("bucket", F.round("bound", 9).alias("bound"))


_HIST = _PROBS + ", hist as (select token, (select count(*) from bounds where bucket > 0 and bound <= p) as bucket, count(*) as n from pr group by all)"


def _histogram(spark: SparkSession, d: str) -> DataFrame:
    p = _probabilities(spark, d)
    bounds = [r["bound"] for r in C.boundaries(p).orderBy("bucket").collect()]
    return C.probability_histogram(p, bounds)


@query(_HIST + " select token, cast(bucket as int) as bucket, n from hist")
def a26_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Probabilities of every word by bucket."""
    return _histogram(spark, d)


_MEASURES = _HIST + """, cells as (select token, b, coalesce(h.n, 0) as n from (select distinct token from hist) cross join (select unnest(range(10)) as b) left join hist h using (token) where h.bucket = b or h.bucket is null),
full_cells as (select t.token, c.b, coalesce(h.n, 0) as n from (select distinct token from hist) t cross join (select unnest(range(10)) as b) c left join hist h on h.token = t.token and h.bucket = c.b),
ms as (select token, sum(-((n + 1e-8) / (s + 1e-7)) * ln((n + 1e-8) / (s + 1e-7))) as entropy, var_pop(n) as variance from (select token, n, sum(n) over (partition by token) as s from full_cells) group by token)"""


@query(_MEASURES + " select token, round(entropy, 6) as entropy, round(variance, 6) as variance from ms")
def a27_entropy(spark: SparkSession, d: str) -> DataFrame:
    """Entropy and variance of every word's histogram."""
    return C.histogram_measures(_histogram(spark, d)).select("token", F.round("entropy", 6).alias("entropy"), F.round("variance", 6).alias("variance"))


@query(_MEASURES + " select token, entropy from (select token, round(entropy, 6) as entropy from ms) order by entropy desc, token limit 100")
def o03_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """The hundred words of the largest entropy."""
    return C.best_tokens(a27_entropy(spark, d).select("token", "entropy"), 100)


@query(_COVER + _MEASURES[len(_COVER):] + " select token, round(variance * (1 - percent_cover), 6) as value from ms join cover using (token)")
def a28_variance_score(spark: SparkSession, d: str) -> DataFrame:
    """Variance weighed by how few users know the word."""
    cover = C.cover(B.word_counts(spark, d))
    return C.histogram_measures(_histogram(spark, d)).join(cover, "token").select("token", F.round(F.col("variance") * (1 - F.col("percent_cover")), 6).alias("value"))


@query(f"with {B.COUNTS} select \"user\", token, round(count / sum(count) over (partition by \"user\"), 9) as value from wc")
def a29_normalised(spark: SparkSession, d: str) -> DataFrame:
    """Rows of the count matrix that add up to 1."""
    return C.row_normalised(B.word_counts(spark, d)).withColumn("value", F.round("value", 9))


@query(f"with {B.COUNTS} select round(avg(t), 6) as mean_size from (select sum(count) as t from wc group by \"user\")")
def a30_mean_size(spark: SparkSession, d: str) -> DataFrame:
    """Mean size of a user's counts."""
    return C.mean_document_size(B.word_counts(spark, d)).select(F.round("mean_size", 6).alias("mean_size"))


@query(f"with {B.TOKENS} select token, count(*) as total from tokens group by token order by total desc, token desc limit 2000")
def o04_top_words(spark: SparkSession, d: str) -> DataFrame:
    """The 2000 commonest tokens."""
    return a07_token_totals(spark, d).orderBy(F.desc("total"), F.desc("token")).limit(2000)


@query(f"with {B.TOKENS} select token, count(*) as total from tokens group by token order by total desc, token limit 90 offset 10")
def o06_skip_limit(spark: SparkSession, d: str) -> DataFrame:
    """Tokens at places 11 to 100."""
    return a07_token_totals(spark, d).orderBy(F.desc("total"), "token").offset(10).limit(90)


@query(f"with {B.COUNTS} select \"user\", token, count from wc where \"user\" < 200 and token < 400")
def rel_p19_truncated(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the first users and words."""
    return C.TokenCounts(B.word_counts(spark, d)).truncate(200, 400)


@query(f"with {B.COUNTS}, tt as (select token from wc group by token having sum(count) between 10 and 2000), uu as (select \"user\" from wc group by \"user\" having sum(count) >= 30) select \"user\", token, count from wc where token in (select token from tt) and \"user\" in (select \"user\" from uu)")
def rel_p20_filtered_load(spark: SparkSession, d: str) -> DataFrame:
    """Counts of tokens within bounds and users above one, by predicates."""
    return C.TokenCounts(B.word_counts(spark, d)).where(F.col("total") >= 30, F.col("total").between(10, 2000)).counts


_SPLIT = f"with {B.COUNTS}, r as (select \"user\", row_number() over (order by \"user\") - 1 as place from (select distinct \"user\" from wc))"


@query(_SPLIT + " select \"user\", place, case when place < 500 then 'train' when place < 600 then 'validation' else 'test' end as part from r")
def rel_p21_split(spark: SparkSession, d: str) -> DataFrame:
    """Users split by position into training, validation and test."""
    return C.split_rows(C.dense_ids(B.word_counts(spark, d), "user", "place"), "place", 500, 100)


@query("select l_orderkey, l_linenumber, cast(sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as double) as running from lineitem")
def w07_running(spark: SparkSession, d: str) -> DataFrame:
    """Running quantity of every order."""
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return running_sum(rows, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")], F.col("l_quantity"), "running").select("l_orderkey", "l_linenumber", F.col("running").cast("double").alias("running"))


@query(f"with {B.TOKENS}, tt as (select token, count(*) as total from tokens group by token) select token, total, row_number() over (order by total desc, token) as place from tt")
def o02_ranked_totals(spark: SparkSession, d: str) -> DataFrame:
    """Tokens with their place by total, ranked without a single sorting task."""
    ranked = global_rank(a07_token_totals(spark, d), [F.desc("total"), F.col("token")], "place")
    return ranked.withColumn("place", F.col("place") + 1)


@query(f"with {B.COUNTS} select token, max(count) as most, round(max(count) / max(max(count)) over (), 9) as fraction from wc group by token")
def w10_fraction_of_max(spark: SparkSession, d: str) -> DataFrame:
    """The largest count of every word as a fraction of the largest of all."""
    per = B.word_counts(spark, d).groupBy("token").agg(F.max("count").alias("most"))
    whole = per.agg(F.max("most").alias("all"))
    return per.join(F.broadcast(whole)).select("token", "most", F.round(F.col("most") / F.col("all"), 9).alias("fraction"))


_FINDER = f"""with {B.COUNTS}, tt as (select token, sum(count) as total, count(*) as users from wc group by token),
bound as (select min(total) as most from (select total, row_number() over (order by total desc) as r, count(*) over () as n from tt) where r <= 1 + cast(floor(n * 0.0001) as bigint)),
good as (select token from tt, bound where length(cast(token as varchar)) >= 3 and total >= 10 and total <= most and users / (select count(distinct "user") from wc) <= 0.95),
busy as (select "user" from wc group by "user" having sum(count) >= 30),
p as (select token, count / sum(count) over (partition by "user") as p from wc where token in (select token from good) and "user" in (select "user" from busy)),
placed as (select p, row_number() over (order by p) - 1 as r, count(*) over () as n from p),
bounds as (select list(p order by i) as b from placed join (select unnest(range(1, 10)) as i) on r = i * (n // 10)),
hist as (select token, len(list_filter(b, lambda x: p >= x)) as bucket, count(*) as n from p, bounds group by all),
cells as (select t.token, coalesce(h.n, 0) as n from (select distinct token from hist) t cross join (select unnest(range(10)) as b) c left join hist h on h.token = t.token and h.bucket = c.b)
"""


@query(_FINDER + "select token, round(sum(-((n + 1e-8) / (s + 1e-7)) * ln((n + 1e-8) / (s + 1e-7))), 6) as entropy from (select token, n, sum(n) over (partition by token) as s from cells) group by token")
def r05_word_finder(spark: SparkSession, d: str) -> DataFrame:
    """The vocabulary by the word finder's fixed thresholds."""
    return C.word_finder(B.word_counts(spark, d)).select("token", F.round("entropy", 6).alias("entropy"))


@query(f"with {B.COUNTS}, m as (select \"user\", map(list(token), list(count)) as m from wc where token between 0 and 499 group by \"user\") select \"user\", array_to_string(list_transform(range(500), lambda i: coalesce(m[i], 0)), ' ') as row from m")
def r03_dense_rows(spark: SparkSession, d: str) -> DataFrame:
    """The counts of every user as the row of a matrix of 500 words."""
    made = C.dense_rows(B.word_counts(spark, d), "user", "token", "count", 500)
    return made.select("user", F.array_join(F.transform("values", lambda v: v.cast("bigint").cast("string")), " ").alias("row"))
