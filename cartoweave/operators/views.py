"""Named views over documents, requests and positioned tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.functions.quad import js_round, prefix, quadkey

ATTEMPTS = 3


def doc_type_counts(docs: DataFrame, col: str = "doc_type") -> DataFrame:
    """Documents per type, a missing type as 'unknown', and their total under 'total'."""
    typed = docs.select(F.coalesce(col, F.lit("unknown")).alias("doc_type"))
    return typed.rollup("doc_type").agg(F.count("*").alias("n"), F.grouping("doc_type").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("doc_type")).alias("doc_type"), "n")


def checked_type(col: str = "doc_type", known: tuple[str, ...] = ("raw_tweet", "csharp_munged_tweet")) -> Column:
    """The document type; an unknown one stops the query."""
    return F.when(F.col(col).isin(*known), F.col(col)).otherwise(F.raise_error(F.concat(F.lit("unexpected doc type "), F.coalesce(F.col(col), F.lit("null")))))


def normalised_tweets(munged: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """Reshaped tweets in the shape of raw ones; the key is the id as text."""
    return munged.select(F.col(id_col).cast("string").alias("key"), F.col(name_col).alias("username"), F.col(id_col).alias("id"), F.lit("twitter").alias("provider_namespace"), "text", "entities", F.lit("raw_tweet").alias("doc_type"), F.lit("true").alias("from_csharp"))


def distinct_users(munged: DataFrame, name_col: str) -> DataFrame:
    """A user document for every name."""
    return munged.where(F.col(name_col).isNotNull()).select(F.col(name_col).alias("screen_name"), F.lit("user").alias("doc_type"), F.lit(None).cast("string").alias("hash"), F.lit(None).cast("string").alias("coords")).distinct()


def _open(kind: str) -> Column:
    return (F.col("doc_type") == kind) & F.col("completed_time").isNull()


def _tries_left() -> Column:
    return F.col("attempts").isNull() | (F.col("attempts") < ATTEMPTS)


#: Named request views as predicates.
REQUEST_VIEWS = {
    "queued_downloads": lambda: _open("download_request") & F.col("started_time").isNull() & _tries_left(),
    "underway_downloads": lambda: _open("download_request") & F.col("started_time").isNotNull() & _tries_left(),
    "queued_hashes": lambda: _open("hash_request") & F.col("started_time").isNull(),
    "underway_hashes": lambda: _open("hash_request") & F.col("started_time").isNotNull(),
    "pending_user_downloads": lambda: _open("download_request") & _tries_left(),
}


#: The built-in reducers of emitted values.
REDUCERS = {
    "_sum": lambda v: F.sum(v),
    "_count": lambda v: F.count(F.lit(1)),
    "_stats": lambda v: F.struct(F.sum(v).alias("sum"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(F.col(v) * F.col(v)).alias("sumsqr")),
}


def reduced(emitted: DataFrame, keys: list[str], reducer: str, level: int | None = None, value: str = "value") -> DataFrame:
    """Emitted rows reduced by the first ``level`` of their keys (all of them; at 0 over everything)."""
    return emitted.groupBy(*keys[: len(keys) if level is None else level]).agg(REDUCERS[reducer](value).alias("value"))


def request_view(requests: DataFrame, name: str) -> DataFrame:
    """Requests of a named view."""
    return requests.where(REQUEST_VIEWS[name]())


def single_token(positioned: DataFrame, token: str) -> DataFrame:
    """The rows of one token (equality, not a range of collation keys)."""
    return positioned.where(F.col("token") == token)


def summed(docs: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """The sum of a value by keys."""
    return docs.groupBy(*keys).agg(F.sum(value).alias(name))


def with_quadkey(docs: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Documents on the map with their key."""
    return docs.withColumn("quadkey", quadkey(x, y)).where("quadkey is not null")


def token_density(positioned: DataFrame, digits: int = 15) -> DataFrame:
    """(token, quadkey, value): word counts by token and cell."""
    return with_quadkey(positioned).groupBy("token", prefix("quadkey", digits).alias("quadkey")).agg(F.sum("count").alias("value"))


def locations(users: DataFrame, digits: int = 15) -> DataFrame:
    """(quadkey, value): users by cell."""
    return with_quadkey(users).groupBy(prefix("quadkey", digits).alias("quadkey")).agg(F.count("*").alias("value"))


def roll_up(rows: DataFrame, digits: int, keys: list[str] | None = None) -> DataFrame:
    """Values of finer cells summed to cells of ``digits`` digits."""
    return rows.groupBy(*(keys or []), prefix("quadkey", digits).alias("quadkey")).agg(F.sum("value").alias("value"))


def token_per_square(positioned: DataFrame, value: str) -> DataFrame:
    """(x, y, token, value) by rounded coordinates, halves upwards."""
    return positioned.groupBy(js_round("x").alias("x"), js_round("y").alias("y"), "token").agg(F.sum(value).alias("value"))


def top_by(rows: DataFrame, keys: list[str], value: str, tie: list[str]) -> DataFrame:
    """The row of the largest value for each group of keys; ties by the largest of ``tie``."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), *[F.desc(t) for t in tie])
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def users_without_pending(users: DataFrame, requests: DataFrame) -> DataFrame:
    """Users none of whose downloads is open."""
    return users.join(request_view(requests, "pending_user_downloads"), "username", "left_anti")
