"""User-token counts, vocabulary and training relations.

The relation is long: (user, token, count). Ranks over a whole relation are range-partitioned (``running``).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.functions.text import counted_words
from cartoweave.operators.running import global_rank
from cartoweave.session import materialise

BUCKETS = 10
EPSILON = 1e-8


def word_frequencies(docs: DataFrame, user: Column, text_col: str) -> DataFrame:
    """(user, word, n) over counted words; the sum of the per-document counts."""
    each = docs.select(user.alias("user"), F.explode(counted_words(text_col)).alias("word"))
    return each.groupBy("user", "word").agg(F.count("*").alias("n"))


def token_counts(tokens: DataFrame) -> DataFrame:
    """(user, token, count) of a stream of (user, token); users need not come together."""
    return tokens.groupBy("user", "token").agg(F.count("*").alias("count"))


def totals(counts: DataFrame, key: str) -> DataFrame:
    """(key, total)."""
    return counts.groupBy(key).agg(F.sum("count").alias("total"))


def cover(counts: DataFrame) -> DataFrame:
    """(token, users, percent_cover): how many users use a token, and their share of all users; one row per user and token."""
    users = counts.agg(F.count_distinct("user").alias("all_users"))
    per = counts.groupBy("token").agg(F.count("user").alias("users"))
    return per.join(F.broadcast(users)).select("token", "users", (F.col("users") / F.col("all_users")).alias("percent_cover"))


def with_probability(counts: DataFrame) -> DataFrame:
    """Counts with P(token | user)."""
    return counts.join(counts.groupBy("user").agg(F.sum("count").alias("user_total")), "user").select("user", "token", "count", (F.col("count") / F.col("user_total")).alias("p"))


def kept(counts: DataFrame, users: DataFrame, tokens: DataFrame) -> DataFrame:
    """Counts of the kept users and tokens (semi joins); AQE broadcasts whichever side proves small."""
    return counts.join(users.select("user"), "user", "left_semi").join(tokens.select("token"), "token", "left_semi")


def decoded(counts: DataFrame, names: DataFrame, key: str, name: str) -> DataFrame:
    """Ids replaced by their names; ids without a name leave."""
    return counts.join(names.select(key, name), key)


def pre_filter_tokens(counts: DataFrame, least_length: int = 3, least_total: int = 10, most_cover: float = 0.95) -> DataFrame:
    """Tokens that are long, frequent and not too common."""
    both = totals(counts, "token").join(cover(counts), "token")
    return both.where((F.length("token") >= least_length) & (F.col("total") >= least_total) & (F.col("percent_cover") <= most_cover))


def filter_users(counts: DataFrame, least_total: int = 30) -> DataFrame:
    """Users with enough tokens."""
    return totals(counts, "user").where(F.col("total") >= least_total)


def popular_cutoff(token_totals: DataFrame, share: float) -> DataFrame:
    """Totals without tokens above the total at rank int(n * share) in descending order; ties with it stay."""
    n = token_totals.count()
    if not n:
        return token_totals
    at = int(n * share)
    bound = token_totals.orderBy(F.desc("total")).limit(at + 1).agg(F.min("total")).first()[0] if at < 100_000 else global_rank(token_totals, [F.desc("total")]).where(F.col("rank") == at).first()["total"]
    return token_totals.where(F.col("total") <= bound)


def dense_ids(df: DataFrame, key: str, name: str) -> DataFrame:
    """0-based ids in the order of the key."""
    return global_rank(df.select(key).distinct(), [F.col(key)], name)


def boundaries(probabilities: DataFrame, col: str = "p", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, bound): the values at positions bucket * (n // buckets) of the sorted column."""
    n = probabilities.count()
    step = n // buckets
    spots = probabilities.sparkSession.createDataFrame([(b, b * step) for b in range(buckets if n else 0)], "bucket int, rank long")
    ranked = global_rank(probabilities.select(F.col(col).alias("bound")), [F.col("bound")])
    return ranked.join(F.broadcast(spots), "rank").select("bucket", "bound")


def bucket_of(value: Column, bounds: list[float]) -> Column:
    """the first bucket whose next bound is larger than the value, else the last."""
    return sum(((value >= b).cast("int") for b in bounds[1:]), F.lit(0))


def probability_histogram(probabilities: DataFrame, bounds: list[float]) -> DataFrame:
    """(token, bucket, n) of the probabilities by bucket."""
    return probabilities.groupBy("token", bucket_of(F.col("p"), bounds).alias("bucket")).agg(F.count("*").alias("n"))


def histogram_measures(histogram: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(token, entropy, variance) over all cells of a token's histogram, empty ones too."""
    whole = histogram.groupBy("token").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("ss"), F.count("*").alias("used"), F.collect_list("n").alias("cells"))
    mass = F.col("s") + buckets * EPSILON
    part = lambda x: -((x + EPSILON) / mass) * F.ln((x + EPSILON) / mass)
    filled = F.aggregate(F.array_sort("cells"), F.lit(0.0), lambda a, x: a + part(x.cast("double")))
    entropy = filled + (buckets - F.col("used")) * part(F.lit(0.0))
    variance = F.col("ss") / buckets - (F.col("s") / buckets) * (F.col("s") / buckets)
    return whole.select("token", entropy.alias("entropy"), variance.alias("variance"))


def best_tokens(measures: DataFrame, wanted: int, order: str = "entropy") -> DataFrame:
    """The ``wanted`` tokens of the largest measure, ties by token."""
    return measures.orderBy(F.desc(order), "token").limit(wanted)


def word_finder(counts: DataFrame, wanted: int = 20_000, cutoff: float = 0.0001) -> DataFrame:
    """(token, entropy): the vocabulary by the fixed thresholds of the word finder.

    Tokens of at least 3 letters, used at least 10 times, by at most 95 % of the users and not among the commonest share
    ``cutoff``; users with at least 30 words; of what is left the ``wanted`` tokens of the largest entropy.
    """
    counts = materialise(counts)
    tokens = pre_filter_tokens(counts)
    usual = popular_cutoff(totals(counts, "token"), cutoff)
    left = materialise(kept(counts, filter_users(counts), tokens.join(usual.select("token"), "token", "left_semi")))
    probabilities = materialise(with_probability(left))
    bounds = [r["bound"] for r in boundaries(probabilities).orderBy("bucket").collect()]
    return best_tokens(histogram_measures(probability_histogram(probabilities, bounds)), wanted).select("token", "entropy")


def dense_rows(cells: DataFrame, row: str, column: str, value: str, width: int) -> DataFrame:
    """(row, values): coordinates and values as rows of a matrix of ``width`` columns; cells that are not there are 0.

    Of several values of one cell the sum holds; columns outside of the width leave.
    """
    inside = cells.where((F.col(column) >= 0) & (F.col(column) < width) & F.col(row).isNotNull())
    per = inside.groupBy(row, column).agg(F.sum(value).cast("double").alias("v")).groupBy(row).agg(F.map_from_entries(F.collect_list(F.struct(F.col(column).cast("int"), "v"))).alias("m"))
    return per.select(row, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("values"))


def row_normalised(counts: DataFrame) -> DataFrame:
    """Counts divided by the total of their user; a total of 0 divides by 1."""
    both = counts.join(totals(counts, "user"), "user")
    return both.select("user", "token", (F.col("count") / F.when(F.col("total") == 0, 1).otherwise(F.col("total"))).alias("value"))


def mean_document_size(counts: DataFrame) -> DataFrame:
    """One row with the mean total of a user."""
    return totals(counts, "user").agg(F.avg("total").alias("mean_size"))


def split_rows(df: DataFrame, position: str, train: int, validation: int) -> DataFrame:
    """Rows with ``part``: train below the first cut, validation below the second, then test.

    An empty validation part repeats the training rows, an empty test part the validation rows.
    """
    p = F.col(position)
    made = df.withColumn("part", F.when(p < train, "train").when(p < train + validation, "validation").otherwise("test"))
    if validation == 0:
        made = made.unionByName(made.where("part = 'train'").withColumn("part", F.lit("validation")))
    if made.where("part = 'test'").isEmpty():
        made = made.unionByName(made.where("part = 'validation'").withColumn("part", F.lit("test")))
    return made


@dataclass
class TokenCounts:
    """The relation with its totals; every method returns a new one or a frame, nothing is collected."""

    counts: DataFrame

    def user_totals(self) -> DataFrame:
        return totals(self.counts, "user")

    def token_totals(self) -> DataFrame:
        return totals(self.counts, "token")

    def percent_cover(self) -> DataFrame:
        return cover(self.counts)

    def where(self, users: Column | None = None, tokens: Column | None = None) -> TokenCounts:
        """Keep users and tokens by predicates over their totals (columns user, total; token, total)."""
        made = self.counts
        if users is not None:
            made = made.join(self.user_totals().where(users), "user", "left_semi")
        if tokens is not None:
            made = made.join(self.token_totals().where(tokens), "token", "left_semi")
        return TokenCounts(made)

    def truncate(self, users: int, tokens: int) -> DataFrame:
        """Counts of the first users and tokens by id."""
        return self.counts.where((F.col("user") < users) & (F.col("token") < tokens))

    def training(self) -> DataFrame:
        """(user_id, token_id, count) with dense ids."""
        return self.counts.join(dense_ids(self.counts, "user", "user_id"), "user").join(dense_ids(self.counts, "token", "token_id"), "token").select("user_id", "token_id", "count")
