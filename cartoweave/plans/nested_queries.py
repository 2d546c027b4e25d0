"""Queries over the nested entities of tweets, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.operators.nested import Layout, flat_rows, flat_table, path_counts
from cartoweave.session import table

CHILDREN = {"mention": ("user_mentions", "screen_name"), "hashtag": ("hashtags", "text"), "url": ("urls", "url"), "media": ("media", "media_url")}
_LISTS = [path for path, _ in CHILDREN.values()]
ENTITIES = Layout(
    lists=frozenset(_LISTS),
    maps=frozenset({"media[].sizes"}),
    tables={kind: (f"{path}[]", (value, "", *extra)) for (kind, (path, value)), extra in zip(CHILDREN.items(), ((), (), ("expanded_url",), ("id",)), strict=True)} | {"size": ("media[].sizes{}", ("w", "h")), "plain": ("[]", ("",))},
)


def _rows(spark: SparkSession, d: str) -> DataFrame:
    return flat_rows(table(spark, d, "raw_tweets").where("tweet_id is not null"), "tweet_id", "entities", ENTITIES)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every child of the entities with its kind, place, name and value."""
    rows = _rows(spark, d).where("tbl <> 'plain' or values[0] is not null")
    own, plain = F.col("values")[0], F.col("values")[1]
    size = F.col("tbl") == "size"
    is_plain = ~size & (F.col("tbl") != "plain") & plain.isNotNull()
    return (
        rows.where(~size | (own.isNotNull() & plain.isNotNull()))
        .select(
            F.col("id").alias("tweet_id"),
            F.when(is_plain, "plain").otherwise(F.col("tbl")).alias("kind"),
            F.col("ordinals")[0].cast("long").alias("pos"),
            F.when(size, F.try_element_at("ordinals", F.lit(2))).otherwise("").alias("sub"),
            F.when(size, F.concat(own, F.lit("x"), plain)).when(is_plain, plain).otherwise(own).alias("value"),
        )
        .distinct()
    )


def _one(spark: SparkSession, d: str, name: str, keys: list[str]) -> DataFrame:
    return flat_table(_rows(spark, d), ENTITIES, name, keys, "tweet_id").withColumn("pos", F.col("pos").cast("long")).drop("value").distinct()


def p6_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Mentions: tweet, place, screen name."""
    return _one(spark, d, "mention", ["pos"])


def p6_urls(spark: SparkSession, d: str) -> DataFrame:
    """Links: tweet, place, link, expanded link."""
    return _one(spark, d, "url", ["pos"])


def p6_media(spark: SparkSession, d: str) -> DataFrame:
    """Media objects: tweet, place, address, id."""
    return _one(spark, d, "media", ["pos"])


def p6_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of media objects, linked to them by tweet and place."""
    return _one(spark, d, "size", ["pos", "name"])


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Every path of the entities with its repeated ancestor, how many values it holds, and whether a table has it."""
    return path_counts(table(spark, d, "raw_tweets"), "entities", ENTITIES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p6_found, p6_mentions, p6_urls, p6_media, p6_sizes, p6_paths)}

_OPEN = """
with a as (select distinct tweet_id, case when json_valid(entities) then entities::json end as e from raw_tweets where tweet_id is not null and entities is not null),
b as (select tweet_id, case when json_type(e) = 'VARCHAR' then case when json_valid(e->>'$') then (e->>'$')::json end else e end as e from a),
lists as (select tweet_id, kind, case when json_type(l) = 'OBJECT' then json_array(l) else l end as l from (
  select tweet_id, 'mention' as kind, e->'$.user_mentions' as l from b where json_type(e) = 'OBJECT'
  union all select tweet_id, 'hashtag', e->'$.hashtags' from b where json_type(e) = 'OBJECT'
  union all select tweet_id, 'url', e->'$.urls' from b where json_type(e) = 'OBJECT'
  union all select tweet_id, 'media', e->'$.media' from b where json_type(e) = 'OBJECT'
  union all select tweet_id, 'plain', e from b where json_type(e) = 'ARRAY')),
places as (select tweet_id, kind, l, unnest(range(json_array_length(l)::bigint)) as pos from lists where json_type(l) = 'ARRAY'),
child as (select tweet_id, kind, pos, l->pos::int as o from places),
sizes as (select tweet_id, pos, o, unnest(json_keys(o->'$.sizes')) as name from child where kind = 'media' and json_type(o->'$.sizes') = 'OBJECT')
"""
_VALUE = "case when json_type(o) = 'VARCHAR' then o->>'$' when kind = 'mention' then o->>'$.screen_name' when kind = 'hashtag' then o->>'$.text' when kind = 'url' then o->>'$.url' when kind = 'media' then o->>'$.media_url' end"
ORACLE_SQL: dict[str, str] = {
    "p6_found": _OPEN + f"""select distinct tweet_id, case when json_type(o) = 'VARCHAR' then 'plain' else kind end as kind, pos, '' as sub, {_VALUE} as value from child where json_type(o) in ('OBJECT', 'VARCHAR') and (kind <> 'plain' or json_type(o) = 'VARCHAR')
union select tweet_id, 'size', pos, name, (o->'$.sizes'->name->>'$.w') || 'x' || (o->'$.sizes'->name->>'$.h') from sizes where (o->'$.sizes'->name->>'$.w') is not null and (o->'$.sizes'->name->>'$.h') is not null""",
    "p6_mentions": _OPEN + "select distinct tweet_id, pos, o->>'$.screen_name' as screen_name from child where kind = 'mention' and json_type(o) = 'OBJECT'",
    "p6_urls": _OPEN + "select distinct tweet_id, pos, o->>'$.url' as url, o->>'$.expanded_url' as expanded_url from child where kind = 'url' and json_type(o) = 'OBJECT'",
    "p6_media": _OPEN + "select distinct tweet_id, pos, o->>'$.media_url' as media_url, o->>'$.id' as id from child where kind = 'media' and json_type(o) = 'OBJECT'",
    "p6_sizes": _OPEN + "select distinct tweet_id, pos, name, o->'$.sizes'->name->>'$.w' as w, o->'$.sizes'->name->>'$.h' as h from sizes",
}
