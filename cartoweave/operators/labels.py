"""Labels of map cells.

Rows are (token, cell, value): how often a token is used in a cell; cells are keys as text ("0,1,0"). Every mode gives
(cell, token, value) ranked within its cell; cells without tokens are only in ``with_users``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.functions.quad import quad_to_xy

LIMIT, TOKEN_LIMIT = 10, 100


def parsed_rows(lines: DataFrame, has_token: bool, col: str = "value") -> DataFrame:
    """Rows of view text such as ``{"key":["tea",0,1],"value":3},``; lines of another form are skipped.

    Gives (token,) cell, value. The last row, which ends without a comma, counts as any other.
    """
    line = F.col(col)
    head = r'^\{"key":\["((?:[^"\\]|\\.)*)",' if has_token else r'^\{"key":\[()'
    pattern = head + r'([0-9,]*)\],"value":(\d+)\}'
    rows = lines.where(line.rlike(pattern))
    cell, value = F.regexp_extract(line, pattern, 2), F.regexp_extract(line, pattern, 3).cast("bigint")
    token = F.from_json(F.concat(F.lit('["'), F.regexp_extract(line, pattern, 1), F.lit('"]')), "array<string>")[0]
    return rows.select(*([token.alias("token")] if has_token else []), cell.alias("cell"), value.alias("value"))


def view_line(rows: DataFrame, has_token: bool) -> DataFrame:
    """The text line of each row."""
    key = F.concat(F.lit("["), *([F.get_json_object(F.to_json(F.struct(F.array("token").alias("t"))), "$.t[*]"), F.lit(",")] if has_token else []), F.col("cell"), F.lit("]"))
    return rows.select(F.concat(F.lit('{"key":'), key, F.lit(',"value":'), F.col("value").cast("string"), F.lit("},")).alias("value"))


def with_totals(rows: DataFrame) -> DataFrame:
    """Rows with the total of their token over all cells."""
    return rows.join(rows.groupBy("token").agg(F.sum("value").alias("total")), "token")


def top_tokens(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The ``limit`` first rows of each cell by (value, total, token), all descending, with ``place``."""
    w = Window.partitionBy("cell").orderBy(F.desc("value"), F.desc("total"), F.desc("token"))
    return with_totals(rows).withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit)


def location_labels(rows: DataFrame, order: str, limit: int = LIMIT) -> DataFrame:
    """Labels by cell; ``order`` is total, relative or adjusted; the limit applies before adjusting."""
    share = F.lit(10000.0) * F.col("value") / F.col("total")
    made = {"total": F.col("value"), "relative": share.cast("bigint"), "adjusted": (share * (4 + F.ln("total"))).cast("bigint")}[order]
    return top_tokens(rows, limit).select("cell", "token", made.alias("value"))


def best_cells(rows: DataFrame) -> DataFrame:
    """The cells of the largest value of each token, ties kept."""
    top = rows.groupBy("token").agg(F.max("value").alias("most"), F.sum("value").alias("total"))
    return rows.join(top, "token").where("value = most").drop("most")


def token_labels(rows: DataFrame, order: str, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Labels of tokens at their best cells; ``order`` is token_total or token_relative (per mille)."""
    value = F.col("value") if order == "token_total" else (F.col("value") * (F.lit(1000.0) / F.col("total"))).cast("bigint")
    w = Window.partitionBy("cell").orderBy(F.desc("value"), F.desc("token"))
    made = best_cells(rows).select("cell", "token", value.alias("value"))
    return made.withColumn("place", F.row_number().over(w)).where(F.col("place") <= limit).drop("place")


def penalised(labels: DataFrame) -> DataFrame:
    """long tokens lose in proportion to their bytes, mentions and links nine tenths; values of 0 leave."""
    size = F.octet_length("token")
    value = F.when(size > 8, F.expr("value * 8 div octet_length(token)")).otherwise(F.col("value"))
    less = F.col("token").startswith("@") | F.col("token").startswith("http://")
    return labels.withColumn("value", value.cast("bigint")).withColumn("value", F.when(less, F.expr("value div 10")).otherwise(F.col("value"))).where("value > 0")


def magic_labels(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Totals by cell and best cells of tokens, summed by token, penalised, the first 2 * limit of a cell.

    Only cells that have location labels take part. Every token group is kept, the last one too.
    """
    here = location_labels(rows, "total", limit)
    there = token_labels(rows, "token_total", limit).join(here.select("cell").distinct(), "cell", "left_semi")
    both = here.unionByName(there).groupBy("cell", "token").agg(F.sum("value").alias("value"))
    w = Window.partitionBy("cell").orderBy(F.desc("value"), F.desc("token"))
    return penalised(both).withColumn("place", F.row_number().over(w)).where(F.col("place") <= 2 * limit).drop("place")


def with_users(labels: DataFrame, users: DataFrame) -> DataFrame:
    """(cell, labels, users): cells of labels and of users, either may be missing."""
    per = labels.groupBy("cell").agg(F.count("*").alias("labels"))
    return per.join(users.select("cell", F.col("value").alias("users")), "cell", "full").select("cell", F.coalesce("labels", F.lit(0).cast("bigint")).alias("labels"), "users")


def cell_frame(labels: DataFrame, users: DataFrame) -> DataFrame:
    """(cell, x, y, users, labels): every cell of labels or users with its place in the square, the labels ranked.

    A cell holds at most a few hundred labels. Nothing is drawn; this is the frame that a table or a page is made of.
    """
    ranked = F.sort_array(F.collect_list(F.struct("value", "token")), asc=False)
    per = labels.groupBy("cell").agg(F.transform(ranked, lambda t: F.struct(t["token"].alias("token"), t["value"].alias("value"))).alias("labels"))
    both = per.join(users.select("cell", F.col("value").alias("users")), "cell", "full")
    place = quad_to_xy(F.split("cell", ",").cast("array<int>"))
    return both.select("cell", place["x"].cast("int").alias("x"), place["y"].cast("int").alias("y"), "users", "labels")


def neighbour_classes(labels: DataFrame) -> DataFrame:
    """(cell, side): sides on which the neighbouring cell shares a token.

    An equi-join of shifted cells and tokens; cells hold at most a few hundred labels, so the join is linear in the labels.
    """
    spot = labels.select("cell", "token", quad_to_xy(F.split("cell", ",").cast("array<int>")).alias("q")).select("cell", "token", F.col("q.x").alias("x"), F.col("q.y").alias("y"))
    made = None
    for side, back, dx, dy in (("left", "right", -1, 0), ("up", "down", 0, -1)):
        other = spot.select(F.col("cell").alias("other"), "token", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"))
        pairs = spot.join(other, ["token", "x", "y"]).select("cell", "other").distinct()
        part = pairs.select("cell", F.lit(side).alias("side")).union(pairs.select(F.col("other").alias("cell"), F.lit(back).alias("side")))
        made = part if made is None else made.union(part)
    return made.distinct()
