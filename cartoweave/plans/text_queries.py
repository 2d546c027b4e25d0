"""Queries of the text functions and trigram models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoweave.functions import text as X
from cartoweave.operators import trigram_model as M
from cartoweave.plans import base as B
from cartoweave.plans import nested_queries as N
from cartoweave.session import materialise, table
from cartoweave.sources.readers import ENTITIES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WS = "[ \\t\\n\\x0B\\f\\r]+"


def query(sql: str | None = None):  # noqa: ANN201
    """Register a function as a query, with the SQL that states the same."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _collapsed(rows: str, name: str) -> str:
    """CTEs of a recursive query: ``name`` (id, s) holds the rows (id, s) of the relation ``rows`` with repeats collapsed.

    On the hexadecimal bytes: the places where one or two bytes stand at least four times are listed, and each step copies up
    to the next one, writes the unit three times and goes on behind its last repetition.
    """
    return f"""
{name}_h as (select id, hex(encode(s)) as h from {rows}),
{name}_p as (select id, h, list_filter(range(1, length(h), 2), lambda i: (substr(h, i, 8) = repeat(substr(h, i, 2), 4) and length(substr(h, i, 8)) = 8 and substr(h, i, 2) <> '0A')
 or (substr(h, i, 16) = repeat(substr(h, i, 4), 4) and length(substr(h, i, 16)) = 16 and substr(h, i, 2) <> '0A' and substr(h, i + 2, 2) <> '0A')) as ps from {name}_h),
{name}_r as (select id, h, ps, cast(1 as bigint) as i, '' as o from {name}_p union all
 select id, h, ps, case when u is null then length(h) + 1 else p + n * length(u) end, o || case when u is null then substr(h, i) else substr(h, i, p - i) || repeat(u, 3) end from (
  select *, len(list_filter(range(1, (length(h) - p + 1) // length(u) + 1), lambda x: starts_with(substr(h, p), repeat(u, x)))) as n from (
   select *, case when p is null then null when substr(h, p, 8) = repeat(substr(h, p, 2), 4) and length(substr(h, p, 8)) = 8 and substr(h, p, 2) <> '0A' then substr(h, p, 2) else substr(h, p, 4) end as u from (
    select *, list_min(list_filter(ps, lambda x: x >= i)) as p from {name}_r where i <= length(h))))),
{name} as (select id, decode(unhex(o)) as s from {name}_r where i > length(h))"""


def _stripped(rows: str, name: str) -> str:
    """CTEs (id, s): F03 of the rows (id, s) of the relation ``rows``."""
    return f"""{name}_u as (select id, replace(replace(replace(replace(replace(s, '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), chr(39), ''), '"', '') as s from {rows}),{_collapsed(f"{name}_u", f"{name}_c")},
{name} as (select id, array_to_string(list_filter(regexp_split_to_array({_LOWER.format('s')}, '{WS}'), lambda w: w <> '' and not starts_with(w, 'http') and w[1] not in ('#', '@')), ' ') as s from {name}_c)"""


_URLS = N._OPEN.rstrip() + ", u as (select distinct o->>'$.expanded_url' as url from child where kind = 'url' and json_type(o) = 'OBJECT' and o->>'$.expanded_url' is not null), labels as (select url, list_filter(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1)), '.'), lambda x: x <> 'www') as l from u)\n"


def _urls(spark: SparkSession, d: str) -> DataFrame:
    return N.p6_urls(spark, d).where("expanded_url is not null").select(F.col("expanded_url").alias("url")).distinct()


@query(_URLS + "select url, 'http://' || array_to_string(l, '.') as domain from labels")
def f01_domain(spark: SparkSession, d: str) -> DataFrame:
    """F01 over all expanded links."""
    return _urls(spark, d).select("url", X.get_domain("url").alias("domain"))


@query(_URLS + "select url, 'http://' || array_to_string(l[len(l) - i + 1:], '.') as domain, i as labels from (select url, l, unnest(range(2, len(l) + 1)) as i from labels where len(l) >= 2)")
def f02_domains(spark: SparkSession, d: str) -> DataFrame:
    """F02 over all expanded links."""
    return _urls(spark, d).select("url", F.posexplode(X.get_domains("url")).alias("i", "domain")).select("url", "domain", (F.col("i") + 2).cast("long").alias("labels"))


@query("with recursive t as (select row_number() over () as id, * from (select distinct tweet_id, text as s from raw_tweets)), kept as (select * from t where s is not null), " + _stripped("kept", "f") + " select t.tweet_id, f.s as plain from t left join f using (id)")
def f03_strip_sanitize(spark: SparkSession, d: str) -> DataFrame:
    """F03 over all tweets."""
    return B.tweets(spark, d, "text").select("tweet_id", X.from_bytes(X.strip_sanitize_lc("text")).alias("plain"))


@query(f"select doc_id, array_to_string(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '' and not starts_with(w, 'http') and w[1] not in ('#', '@') and w <> 'RT' and not regexp_matches(w, '^-?\\$?\\d+\\.?\\d*$')), ' ') as plain from documents")
def f04_sanitise(spark: SparkSession, d: str) -> DataFrame:
    """F04, case kept, over all documents."""
    return table(spark, d, "documents").select("doc_id", X.from_bytes(X.sanitise_string("text")).alias("plain"))


@query("with recursive t as (select doc_id as id, text as s from documents where text is not null)," + _collapsed("t", "c") + " select c.id as doc_id, c.s as collapsed from c join t on t.id = c.id where c.s <> t.s")
def f05_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """documents with a repetition and their collapsed text."""
    made = table(spark, d, "documents").select("doc_id", "text", X.from_bytes(X.collapse_repeats(X.byte_view("text"))).alias("collapsed"))
    return made.where("text <> collapsed").select("doc_id", "collapsed")


@query("with tokens as (select unnest(regexp_split_to_array(lower(text), '[^\\w]+')) as token from documents) select token, count(*) as n from tokens where token <> '' group by token")
def f10_simple_words(spark: SparkSession, d: str) -> DataFrame:
    """how often each simple word occurs in the documents."""
    return table(spark, d, "documents").select(F.explode(X.simple_words(F.lower("text"))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


_WORDS_OF_F = "select id, unnest(list_filter(regexp_split_to_array(s, '[^\\w]+'), lambda w: w <> '')) as token from f"


def _tweets_of(doc_type: str) -> str:
    return f"with recursive tw as (select row_number() over () as id, * from (select distinct tweet_id, username, text, entities from raw_tweets where doc_type = '{doc_type}' and username is not null)), kept as (select id, text as s from tw where text is not null), " + _stripped("kept", "f")


_COUNTED = """ select '@' || lower(username) as "user", token, count(*) as count from tokens join tw using (id) where token is not null group by all"""


_HOST = "lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"
_LABELS = "list_filter(string_split({}, '.'), lambda x: x <> 'www')"


def _raw_tokens() -> str:
    return _tweets_of("raw_tweet") + f""", e as (select id, entities::json as e from tw where json_valid(entities) and json_type(entities) = 'OBJECT'),
 item as (select id, kind, unnest(from_json(l, '["json"]')) as o from (select id, 'm' as kind, e->'$.user_mentions' as l from e union all select id, 'h', e->'$.hashtags' from e union all select id, 'u', e->'$.urls' from e) where json_type(l) = 'ARRAY'),
 got as (select id, kind, o->>'$.screen_name' as name, o->>'$.text' as tag, o->>'$.url' as url, o->>'$.expanded_url' as wide from item where json_type(o) = 'OBJECT'),
 link as (select id, url, wide, case when length(wide) > 0 then wide else url end as base from got where kind = 'u'),
 host as (select id, wide, {_LABELS.format(_HOST.format("base"))} as l, {_HOST.format("base")} as h, {_HOST.format("url")} as own from link),
 tokens as (select id, '@' || lower(name) as token from got where kind = 'm' union all select id, '#' || lower(tag) from got where kind = 'h' union all select id, url from link union all select id, wide from link where length(wide) > 0
  union all select id, 'http://' || array_to_string(l[len(l) - i + 1:], '.') from (select id, l, unnest(range(2, len(l) + 1)) as i from host where h <> '')
  union all select id, 'http://' || array_to_string({_LABELS.format("own")}, '.') from host where length(wide) > 0 and own <> ''
  union all {_WORDS_OF_F})""" + _COUNTED


@query(_raw_tokens())
def f11_raw_tweet_tokens(spark: SparkSession, d: str) -> DataFrame:
    """tokens of raw tweets with their users, counted."""
    rows = table(spark, d, "raw_tweets").where("doc_type = 'raw_tweet' and username is not null").select("tweet_id", "username", "text", "entities").distinct()
    tokens = rows.select(X.user_key("username").alias("user"), F.explode(X.raw_tweet_tokens("text", F.from_json("entities", ENTITIES))).alias("token"))
    return tokens.groupBy("user", "token").agg(F.count("*").alias("count"))


@query(_tweets_of("csharp_munged_tweet") + ", tokens as (select id, unnest(list_transform(json_extract_string(entities, '$[*]'), lambda x: lower(x))) as token from tw where json_valid(entities) and json_type(entities) = 'ARRAY' union all " + _WORDS_OF_F + ")" + _COUNTED)
def f12_munged_tweet_tokens(spark: SparkSession, d: str) -> DataFrame:
    """tokens of reshaped tweets with their users, counted."""
    rows = table(spark, d, "raw_tweets").where("doc_type = 'csharp_munged_tweet' and username is not null").select("tweet_id", "username", "text", "entities").distinct()
    tokens = rows.select(X.user_key("username").alias("user"), F.explode(X.munged_tweet_tokens("text", F.from_json("entities", T.ArrayType(T.StringType())))).alias("token"))
    return tokens.groupBy("user", "token").agg(F.count("*").alias("count"))


_A03 = "with {t}, w as (select username as \"user\", unnest(string_split(lower(regexp_replace(text, '[^a-z@#_1-9A-Z]+', ' ', 'g')), ' ')) as word from tweets where doc_type = 'raw_tweet')".format(t=B.TWEETS)


@query(_A03 + " select \"user\", word, count(*) as n from w where length(word) > 2 group by all")
def a03_term_freq(spark: SparkSession, d: str) -> DataFrame:
    """Word frequencies by user of the raw tweets."""
    from cartoweave.operators.counts import word_frequencies

    return word_frequencies(B.tweets(spark, d, "doc_type", "username", "text").where("doc_type = 'raw_tweet'"), F.col("username"), "text")


@query(_A03 + " select case when word[1] = '#' then 'tag' when word[1] = '@' then 'mention' else 'word' end as kind, count(*) as n from w where length(word) > 2 group by all")
def f15_token_types(spark: SparkSession, d: str) -> DataFrame:
    """counted words by type."""
    words = B.tweets(spark, d, "doc_type", "username", "text").where("doc_type = 'raw_tweet'").select(F.explode(X.counted_words("text")).alias("word"))
    return words.groupBy(X.token_type("word").alias("kind")).agg(F.count("*").alias("n"))


@query("select word_id, case when lower(word) = word then upper(word[1]) || word[2:] else word end as token from fake_words where word is not null")
def f25_normalised(spark: SparkSession, d: str) -> DataFrame:
    """F25 over the dictionary."""
    return table(spark, d, "fake_words").where("word is not null").select("word_id", X.normalise_token("word").alias("token"))


@query("select distinct screen_name, regexp_replace(screen_name, '[^a-zA-Z]', '', 'g') as file from user_docs")
def f27_file_names(spark: SparkSession, d: str) -> DataFrame:
    """F27 over the screen names."""
    return table(spark, d, "user_docs").select("screen_name", X.clean_filename("screen_name").alias("file")).distinct()


_WORDS = f"""words as (select lang, doc_id, unnest(regexp_split_to_array(array_to_string(list_filter(regexp_split_to_array(text, '{WS}'), lambda w: w <> '' and not starts_with(w, 'http') and w[1] not in ('#', '@') and w <> 'RT' and not regexp_matches(w, '^-?\\$?\\d+\\.?\\d*$')), ' '), '[!@#$%^&*_+|}}{{;":?><,./ ]+')) as w from documents),
hexed as (select lang, doc_id, '3C' || hex(encode(w)) || '3E' as h from words where w <> ''),
tri as (select lang, doc_id, substr(h, 2 * i + 1, 6) as tg from (select lang, doc_id, h, unnest(range(0, length(h) // 2 - 2)) as i from hexed))"""


@query("with " + _WORDS + " select tg, count(*) as n from tri group by tg")
def a22_trigrams(spark: SparkSession, d: str) -> DataFrame:
    """Word-aware byte trigrams of all documents, in hexadecimal."""
    return M.trigram_counts(table(spark, d, "documents"), "text", "word_aware")


_PUNCTUATION = '[!@#$%^&*_+|}{;":?><,./ ]+'
_MODES = f"""lowered as (select doc_id as id, array_to_string(list_filter(regexp_split_to_array({_LOWER.format('text')}, '{WS}'), lambda w: w <> '' and not starts_with(w, 'http') and w[1] not in ('#', '@') and w <> 'rt' and not regexp_matches(w, '^-?\\$?\\d+\\.?\\d*$')), ' ') as s from documents where text is not null),
 opened as (select id, replace(replace(s, '&lt;', '<'), '&gt;', '>') as s from lowered),{_collapsed("opened", "lc")},
 padded as (select 'lowercase' as mode, ' ' || s || ' ' as s from lc where s <> ''
  union all select 'lowercase_depunctuated', ' ' || s || ' ' from (select array_to_string(list_filter(regexp_split_to_array(s, '{_PUNCTUATION}'), lambda w: w <> ''), ' ') as s from lc) where s <> ''
  union all select 'word_aware_lc', '<' || w || '>' from (select unnest(regexp_split_to_array(s, '{_PUNCTUATION}')) as w from lc) where w <> ''),
 grams as (select mode, substr(h, 2 * i + 1, 6) as tg from (select mode, h, unnest(range(0, length(h) // 2 - 2)) as i from (select mode, hex(encode(s)) as h from padded)) union all select 'word_aware', tg from tri)"""


@query("with recursive " + _WORDS + ", " + _MODES + " select mode, count(distinct tg) as known, count(*) as total from grams group by mode")
def a22_trigrams_by_mode(spark: SparkSession, d: str) -> DataFrame:
    """Distinct and total trigrams of the documents in every mode."""
    docs = table(spark, d, "documents")
    made = None
    for mode in X.MODES:
        part = M.trigram_counts(docs, "text", mode).agg(F.count("*").alias("known"), F.sum("n").alias("total")).select(F.lit(mode).alias("mode"), "known", "total")
        made = part if made is None else made.union(part)
    return made


def _models(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = table(spark, d, "documents")
    return docs, materialise(M.trigram_counts(docs.where("lang = 'en'"), "text", "word_aware")), materialise(M.trigram_counts(docs.where("lang <> 'en'"), "text", "word_aware"))


_MODEL = "with " + _WORDS + """, en as (select tg, count(*) as n from tri where lang = 'en' group by tg), foe as (select tg, count(*) as n from tri where lang <> 'en' group by tg),
s as (select sum(n)::double as total, count(*) as known, sum(n)::double / 16777216 as mean_count, sum(n)::double / 16777216 * 0.5 as off, -log2(sum(n)::double + 16777216.0 * (sum(n)::double / 16777216 * 0.5)) as norm from en),
a as (select sum(n)::double / 16777216 as off, -log2(sum(n)::double + 16777216.0 * (sum(n)::double / 16777216)) as norm from foe)"""


@query(_MODEL + " select total, known, round(mean_count, 9) as mean_count, round(off, 9) as count_offset, round(norm, 6) as log_norm, round(log2(off) + norm, 6) as min_evidence from s")
def a23_scalars(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of the English model."""
    row = M.scalars(_models(spark, d)[1])
    return row.select("total", "known", *[F.round(c, n).alias(c) for c, n in (("mean_count", 9), ("count_offset", 9), ("log_norm", 6), ("min_evidence", 6))])


@query(_MODEL + " select tg, round(log2(n + s.off) + s.norm - (log2(s.mean_count + s.off) + s.norm), 6) as evidence from en, s")
def a24_noise_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of English against noise."""
    return M.evidence(_models(spark, d)[1])[0].select("tg", F.round("evidence", 6).alias("evidence"))


_EVIDENCE = _MODEL + ", ev as (select tg, coalesce(log2(en.n + s.off) + s.norm, log2(s.off) + s.norm) - coalesce(log2(foe.n + a.off) + a.norm, log2(a.off) + a.norm) as evidence from en full join foe using (tg), s, a)"


@query(_EVIDENCE + " select tg, round(evidence, 6) as evidence from ev")
def j05_model_vs_anti(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of English against the other languages."""
    _, model, other = _models(spark, d)
    return M.evidence(model, other)[0].select("tg", F.round("evidence", 6).alias("evidence"))


_SCORES = _EVIDENCE + ", scores as (select documents.doc_id, coalesce(m.score, 0) as score from documents left join (select doc_id, avg(coalesce(evidence, (select log2(s.off) + s.norm - log2(a.off) - a.norm from s, a))) as score from tri left join ev using (tg) group by doc_id) m using (doc_id))"


def _scores(spark: SparkSession, d: str) -> DataFrame:
    docs, model, other = _models(spark, d)
    return M.scored(docs, ["doc_id"], "text", model, other, "word_aware")


@query(_SCORES + " select doc_id, round(score, 6) as score from scores")
def a25_scores(spark: SparkSession, d: str) -> DataFrame:
    """Score of every document."""
    return _scores(spark, d).select("doc_id", F.round("score", 6).alias("score"))


@query(_SCORES + " select score >= 0.5 as good, count(*) as documents from (select round(score, 6) as score from scores) group by all")
def rel_p10_bisect(spark: SparkSession, d: str) -> DataFrame:
    """P10: documents on both sides of a threshold."""
    good, rest = M.bisect(materialise(a25_scores(spark, d)), 0.5)
    return good.agg(F.count("*").alias("documents")).select(F.lit(True).alias("good"), "documents").union(rest.agg(F.count("*").alias("documents")).select(F.lit(False).alias("good"), "documents"))


_MEANS = _SCORES + ", means as (select screen_name, count(*) as tweets, avg(score) as m from scores join documents using (doc_id) group by screen_name)"


def _means(spark: SparkSession, d: str) -> DataFrame:
    return M.user_means(_scores(spark, d).join(table(spark, d, "documents").select("doc_id", "screen_name"), "doc_id"), "screen_name")


@query(_MEANS + " select screen_name, tweets, round(m, 6) as mean_score from means")
def a19_user_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean score of every user."""
    return _means(spark, d).select("screen_name", "tweets", F.round("mean_score", 6).alias("mean_score"))


@query(_MEANS + " select screen_name, tweets, round(m, 6) >= 0.5 as kept from means")
def rel_p11_partition_users(spark: SparkSession, d: str) -> DataFrame:
    """Users by their mean score."""
    return M.partition_users(a19_user_means(spark, d), 0.5).select("screen_name", "tweets", "kept")


@query("with " + B.TWEETS + ", per as (select username, count(*) as tweets from tweets where username is not null group by username), h as (select tweets, count(*) as users from per group by tweets) select t.tweets, coalesce(h.users, 0) as users from (select unnest(range(1, (select max(tweets) from per) + 1)) as tweets) t left join h using (tweets)")
def a20_hist(spark: SparkSession, d: str) -> DataFrame:
    """Users by number of tweets."""
    return M.tweets_per_user_histogram(B.tweets(spark, d, "username").where("username is not null"), "username")


@query(_SCORES + " select doc_id, score, row_number() over (order by score, doc_id) as place from (select doc_id, round(score, 6) as score from scores)")
def o01_by_score(spark: SparkSession, d: str) -> DataFrame:
    """Documents in the order of their scores."""
    from cartoweave.operators.running import global_rank

    return global_rank(a25_scores(spark, d), [F.col("score"), F.col("doc_id")], "place").withColumn("place", F.col("place") + 1)


@query("with " + _WORDS + " select tg, count(*) as n from tri where lang is not null group by tg")
def u03_added_models(spark: SparkSession, d: str) -> DataFrame:
    """The models of English and of the other languages added up."""
    _, a, b = _models(spark, d)
    return M.add_models(a, b)
