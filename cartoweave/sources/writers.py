"""Sinks (S06, S09, S10, S12, S14-S18)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.operators.labels import view_line
from cartoweave.operators.running import running_sum


def quoted_csv(df: DataFrame, path: str) -> None:
    """No header, text in ' quotes, embedded quotes doubled."""
    df.write.mode("overwrite").options(sep=",", quote="'", escape="'", quoteAll="true", emptyValue="''").csv(path)


def view_json(rows: DataFrame, path: str, has_token: bool = True) -> None:
    """A line for each row, as ``operators.labels.parsed_rows`` reads them."""
    view_line(rows, has_token).write.mode("overwrite").text(path)


def file_numbers(rows: DataFrame, size: int = 100_000) -> DataFrame:
    """(token, n, file_no): files of whole tokens; a file ends with the token that holds its ``size``-th further row.

    The ends depend on each other only through the counts of tokens, which are summed up per token first; the file of a token
    follows from where its rows begin in the order of tokens.
    """
    per = rows.groupBy("token").agg(F.count("*").alias("n"))
    placed = running_sum(per, [], [F.col("token")], F.col("n"), "upto")
    return placed.select("token", "n", F.floor((F.col("upto") - F.col("n")) / size).alias("file_no"))


def split_by_token(rows: DataFrame, path: str, size: int = 100_000) -> None:
    """Files of about ``size`` rows in which no token is cut."""
    rows.join(file_numbers(rows, size).drop("n"), "token").write.mode("overwrite").partitionBy("file_no").json(path)


def export_by_user(tweets: DataFrame, path: str, user: str = "username") -> None:
    """Gzip JSON under initial/user; users without a name go to '_'.

    Rows are rebalanced by user: small users share tasks, one that writes a large part of all rows is split over several.
    """
    name = F.coalesce(F.col(user), F.lit("_"))
    tweets.withColumn("initial", F.lower(F.substring(name, 1, 1))).withColumn("owner", name).hint("rebalance", "owner").write.mode("append").partitionBy("initial", "owner").json(path, compression="gzip")


def trigram_model(model: DataFrame, path: str) -> None:
    """Trigrams and counts, the commonest first, ties by trigram descending."""
    model.orderBy(F.desc("n"), F.desc("tg")).write.mode("overwrite").csv(path, sep="\t")


def formatted_codes(codes: DataFrame, index: str, vector: str) -> DataFrame:
    """The line of each code: its index and the numbers with ten decimals."""
    return codes.select(F.concat_ws(",", F.col(index).cast("string"), F.array_join(F.transform(vector, lambda x: F.format_string("%.10f", x)), ",")).alias("value"))


def rows_of_matrix(df: DataFrame, path: str) -> None:
    """Rows of matrices or weights as parquet."""
    df.write.mode("overwrite").parquet(path)
