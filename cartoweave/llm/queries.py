"""Queries of the training-data problems, over their whole tables, and SQL where SQL can state the result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.llm import canonical, clusters, language, leaks, mixing, neighbours, subjects, terms
from cartoweave.session import checkpoint_dir, table

MAP_LOW, MAP_HIGH, MAP_STEP, MAP_LEAST = -104.0, 56.0, 0.15, 5
HASH_SIZE, HASH_WITHIN, CODE_WITHIN, NEIGHBOURS = 64, 1.2, 0.6, 5
CODE_COLUMNS = [f"c{i}" for i in range(16)]
#: The last so manieth part of the time in which tweets were stored is merged as a change set.
LATE = 10
TEXT_RARE, TEXT_COMMON, WORD_RARE, WORD_COMMON = 5, 0.1, 10, 0.9


def _map_points(spark: SparkSession, d: str) -> DataFrame:
    return clusters.map_points(table(spark, d, "user_docs"), "trained_as_id", "x_coord", "y_coord", MAP_LOW, MAP_HIGH)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Accounts that follow each other by id within a cluster of the map."""
    return clusters.followers(clusters.clusters(_map_points(spark, d), MAP_STEP, MAP_LEAST))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Each cluster of the map with its size, centre and the accounts where the fitted mixture is densest."""
    points = _map_points(spark, d)
    return clusters.describe(clusters.with_density(clusters.clusters(points, MAP_STEP, MAP_LEAST), points))


def p1_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Each component of the mixture fitted on the map with the accounts it holds, their centre and the densest of them."""
    return clusters.describe(clusters.mixture_clusters(_map_points(spark, d)))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose text or screen name reads the same but is stored in other characters."""
    tweets = canonical.same_look_pairs(table(spark, d, "raw_tweets"), "tweet_id", "text").withColumn("tbl", F.lit("raw_tweets"))
    names = canonical.same_look_pairs(table(spark, d, "fake_raw_data"), "record_id", "screen_name").withColumn("tbl", F.lit("fake_raw_data"))
    return tweets.union(names).select("tbl", "id_a", "id_b")


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    """The same records one by one: each with its class of look and its class of stored characters."""
    tweets = canonical.same_look_classes(table(spark, d, "raw_tweets"), "tweet_id", "text").withColumn("tbl", F.lit("raw_tweets"))
    names = canonical.same_look_classes(table(spark, d, "fake_raw_data"), "record_id", "screen_name").withColumn("tbl", F.lit("fake_raw_data"))
    return tweets.union(names).select("tbl", "id", "form", "spelling")


def p2_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Every screen name of the raw data with its one consistent form."""
    rows = table(spark, d, "fake_raw_data").select("record_id", "screen_name").distinct()
    return rows.withColumn("form", canonical.canonical("screen_name", canonical.public_lookalikes(spark)))


def tweet_passages(spark: SparkSession, d: str) -> DataFrame:
    """Passages of every tweet, repeated rows included."""
    tweets = table(spark, d, "raw_tweets")
    model = language.fit_from(tweets, "tweet_id", "text", "lang")
    return language.language_passages(tweets.where("tweet_id is not null"), "tweet_id", "text", "lang", model)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Passages of the tweets whose label is missing, wrong or cannot be right."""
    found = language.missing_or_wrong(tweet_passages(spark, d))
    return found.select(F.col("id").alias("tweet_id"), F.col("seg_no").cast("long").alias("seg_no"), "lang").dropDuplicates(["tweet_id", "seg_no"])


def p3_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every passage of every tweet with its language and confidence."""
    found = tweet_passages(spark, d).dropDuplicates(["id", "seg_no"])
    return found.select(F.col("id").alias("tweet_id"), F.col("seg_no").cast("long").alias("seg_no"), "lang", F.round("confidence", 6).alias("confidence"), "words")


def _hash_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "twusers").select(F.col("user_id").alias("id"), neighbours.vector_from_text("hash", HASH_SIZE).alias("v"))


def _code_vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "test_codes").select(F.col("row_id").alias("id"), neighbours.vector_from_columns(CODE_COLUMNS).alias("v"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near vectors in which one is among the five nearest of the other."""
    users = neighbours.near_pairs(_hash_vectors(spark, d), HASH_SIZE, HASH_WITHIN, NEIGHBOURS).withColumn("tbl", F.lit("twusers"))
    codes = neighbours.near_pairs(_code_vectors(spark, d), len(CODE_COLUMNS), CODE_WITHIN, NEIGHBOURS).withColumn("tbl", F.lit("test_codes"))
    return users.union(codes).select("tbl", "id_a", "id_b")


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest others of every usable vector of both tables."""
    users = neighbours.nearest(_hash_vectors(spark, d), HASH_SIZE, NEIGHBOURS).withColumn("tbl", F.lit("twusers"))
    codes = neighbours.nearest(_code_vectors(spark, d), len(CODE_COLUMNS), NEIGHBOURS).withColumn("tbl", F.lit("test_codes"))
    return users.union(codes).select("tbl", "id", "neighbour", F.round("distance", 9).alias("distance"), F.col("place").cast("long").alias("place"))


def _store_path(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/terms-{uuid.uuid4().hex}"


def _text_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the tweets: a first load, then the tweets stored in the last tenth of the time as a signed change set."""
    tweets = table(spark, d, "raw_tweets").where("tweet_id is not null").select("tweet_id", "text", "stored_at")
    low, high = tweets.agg(F.min(F.to_date("stored_at")), F.max(F.to_date("stored_at"))).first()
    late = F.coalesce(F.col("stored_at") >= F.lit(str(high - (high - low) / LATE)).cast("timestamp_ntz"), F.lit(False)) if high else F.lit(False)
    first, later = tweets.where(~late), tweets.where(late)
    store = terms.TermStore(spark, _store_path(spark))
    store.apply(terms.text_deltas(terms.latest_records(first, "tweet_id", "text"), "text"))
    store.apply(terms.text_deltas(terms.change_set(first, later, "tweet_id", "text", whole=False), "text", "sign"))
    return store.table()


def _word_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the word vectors, whose rows carry a term and its count."""
    store = terms.ValuedStore(spark, _store_path(spark))
    store.apply(terms.row_deltas(table(spark, d, "fake_word_vectors"), "word_id", "count", "user_id"))
    return store.counts()


def p5_terms(spark: SparkSession, d: str) -> DataFrame:
    """Every term with its occurrences, its records and its mark."""
    made = []
    for field, counts, rare, common in (("raw_tweets.text", _text_counts(spark, d), TEXT_RARE, TEXT_COMMON), ("fake_word_vectors.word_id", _word_counts(spark, d), WORD_RARE, WORD_COMMON)):
        made.append(terms.mark_terms(counts, terms.record_total(counts), rare, common).withColumn("field", F.lit(field)))
    return made[0].union(made[1]).select("field", "term", "occurrences", "records", "mark")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Terms too rare or too common to be useful."""
    return p5_terms(spark, d).where("mark is not null").select("field", "term", "mark")


def leaked_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the items they hold and the share of each item's words found."""
    return leaks.leaked(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold at least half of an item's passage."""
    return leaked_items(spark, d).select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"))


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every leaked item with the number of documents that hold it and the largest share found."""
    return leaked_items(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("documents"), F.round(F.max("covered"), 6).alias("largest_share"))


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Every appearance of a document in the mixture with the target shares."""
    return _mixture(spark, d).withColumnRenamed("id", "doc_id")


def p8_tempered(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source in a mixture twice as large as the targets allow, its exponent bisected."""
    aims = table(spark, d, "mix_targets")
    return mixing.report(mixing.mixture(table(spark, d, "documents"), "doc_id", "text", "source", aims, stretch=2.0), aims)


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share, tokens and repetitions of every source."""
    return mixing.report(_mixture(spark, d), table(spark, d, "mix_targets"))


def subjects_of_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents with their subjects and posteriors."""
    return subjects.document_subjects(table(spark, d, "documents"), "doc_id", "text", "lang", table(spark, d, "subject_examples"), "text", "subject", table(spark, d, "subjects"), "subject")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The subjects each document deals with."""
    return subjects_of_documents(spark, d).select(F.col("id").alias("doc_id"), "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and mean posterior of each subject."""
    return subjects_of_documents(spark, d).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("posterior"), 4).alias("mean_posterior"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_clusters, p1_mixture, p2_found, p2_canonical, p2_classes, p3_found, p3_passages, p4_found, p4_nearest, p5_found, p5_terms, p7_found, p7_items, p8_mixture, p8_report, p8_tempered, p9_found, p9_composition)}

_TERMS = """
with tweets as (select tweet_id, any_value(text) as text from raw_tweets where tweet_id is not null group by tweet_id),
each as (select tweet_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{Nd}]+')) as term from tweets),
texts as (select 'raw_tweets.text' as field, term, count(*) as occurrences, count(distinct tweet_id) as records, (select count(*) from tweets) as total, 5 as rare, 0.1 as common from each group by term),
vectors as (select distinct user_id, word_id, count from fake_word_vectors where user_id is not null and word_id is not null and count > 0),
words as (select 'fake_word_vectors.word_id' as field, cast(word_id as varchar) as term, cast(sum(count) as bigint) as occurrences, count(distinct user_id) as records, (select count(distinct user_id) from vectors) as total, 10 as rare, 0.9 as common from vectors group by word_id),
marked as (select field, term, occurrences, records, case when occurrences < rare then 'rare' when records > common * total then 'common' end as mark from (select * from texts union all select * from words))
"""
_FINITE = "list_bool_and(list_transform(v, lambda x: x is not null and isfinite(x)))"
_NEAREST = f"""
with parts as (select user_id as id, list_filter(string_split(trim(regexp_replace(regexp_replace(hash, '(?i)dtype\\s*=\\s*[\\w.'']+|\\b(array|list|tuple)\\s*([(\\[])', ' \\2', 'g'), '[\\[\\](){{}},;\\s]+', ' ', 'g')), ' '), lambda x: x <> '') as p from twusers where user_id is not null),
users as (select 'twusers' as tbl, id, any_value(v) as v from (select id, list_transform(p, lambda x: try_cast(x as double)) as v from parts) where len(v) = {HASH_SIZE} and {_FINITE} group by id),
codes as (select 'test_codes' as tbl, row_id as id, any_value(v) as v from (select row_id, [{", ".join(CODE_COLUMNS)}] as v from test_codes where row_id is not null) where {_FINITE} group by row_id),
vectors as (select * from users union all select * from codes),
ranked as (select a.tbl, a.id, b.id as neighbour, list_distance(a.v, b.v) as distance, row_number() over (partition by a.tbl, a.id order by list_distance(a.v, b.v), b.id) as place from vectors a join vectors b on a.tbl = b.tbl and a.id <> b.id qualify place <= {NEIGHBOURS})
"""
ORACLE_SQL: dict[str, str] = {
    "p4_nearest": _NEAREST + "select tbl, id, neighbour, round(distance, 9) as distance, place from ranked",
    "p4_found": _NEAREST + f"select distinct tbl, least(id, neighbour) as id_a, greatest(id, neighbour) as id_b from ranked where distance <= case tbl when 'twusers' then {HASH_WITHIN} else {CODE_WITHIN} end",
    "p1_found": f"""
with recursive points as (select id, p.x as x, p.y as y from (select trained_as_id as id, min({{'x': x_coord, 'y': y_coord}}) as p from user_docs
 where trained_as_id is not null and isfinite(x_coord) and isfinite(y_coord) and x_coord > {MAP_LOW} and x_coord < {MAP_HIGH} and y_coord > {MAP_LOW} and y_coord < {MAP_HIGH} group by trained_as_id)),
steps as (select a.id as a, b.id as b from points a join points b on b.x between a.x - 0.2 and a.x + 0.2 where (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= {MAP_STEP}::double * {MAP_STEP}::double),
reached as (select id, id as other from points union select r.id, s.b from reached r join steps s on r.other = s.a),
roots as (select id, min(other) as root, count(*) as size from reached group by id)
select * from (select lag(id) over (partition by root order by id) as id_a, id as id_b from roots where size >= {MAP_LEAST}) where id_a is not null""",
    "p5_found": _TERMS + "select field, term, mark from marked where mark is not null",
    "p5_terms": _TERMS + "select field, term, occurrences, records, mark from marked",
}
