"""How often every term occurs, and in how many records, kept up to date by signed deltas (problem 5).

A change set holds records that were added (+1), deleted (-1) or changed (-1 for the old form, +1 for the new one). Only
these records are tokenised; their signed contributions are pre-aggregated per term and merged into the persistent counts,
which are partitioned by a hash of the term. A merge rewrites the partitions that hold a changed term and no other ones.

Terms: in texts the longest runs of Unicode letters and digits after lower-casing, as stored. Null and empty texts hold no
term but count as records. Rows that carry a term and a count instead need to know which rows of the same term and record
are there already: their state (term, record, count, copies) is kept beside the counts, and a change of the counts is derived
from the state before and after. The row whose term is null stands for all records: its ``records`` is their number.
Everything runs on the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.session import materialise
from cartoweave.sources.store import ROWS_PER_BUCKET, BucketStore

NOT_TERM = r"[^\p{L}\p{Nd}]+"


def term_array(text: Column | str) -> Column:
    """The terms of a text, in order, repeated ones repeated."""
    col = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.lower(col), NOT_TERM), lambda t: t != "")


def _term_counts(text: Column) -> Column:
    """Array of (term, first): one element per occurrence, ``first`` is 1 for one occurrence of each term of the record; the first one stands for the record."""
    terms = F.sort_array(F.concat(F.array(F.lit(None).cast("string")), F.coalesce(term_array(text), F.array().cast("array<string>"))))
    before = F.concat(F.array(F.lit("").cast("string")), F.slice(terms, 1, F.size(terms) - 1))
    return F.zip_with(terms, before, lambda a, b: F.struct(a.alias("term"), F.when(a.eqNullSafe(b), 0).otherwise(1).alias("first")))


def _sign(sign_col: str | None) -> Column:
    return F.col(sign_col).cast("long") if sign_col else F.lit(1).cast("long")


def text_deltas(records: DataFrame, text_col: str, sign_col: str | None = None) -> DataFrame:
    """(term, occurrences, records): signed changes that the records make. ``sign_col`` holds +1 or -1; without it all are added."""
    each = records.select(_term_counts(F.col(text_col)).alias("terms"), _sign(sign_col).alias("sign")).select("sign", F.inline("terms"))
    return each.groupBy("term").agg(F.sum("sign").alias("occurrences"), F.sum(F.col("sign") * F.col("first")).alias("records"))


def row_deltas(records: DataFrame, term_col: str, count_col: str, record_col: str, sign_col: str | None = None) -> DataFrame:
    """(term, record, n, copies): signed numbers of rows that already carry a term and its count.

    Rows whose count is null, zero or negative, or whose term or record is null, hold nothing. The null term stands for the
    record itself.
    """
    used = F.col(term_col).isNotNull() & F.col(record_col).isNotNull() & (F.col(count_col) > 0)
    n = F.col(count_col).cast("long")
    both = F.array(F.struct(F.col(term_col).cast("string").alias("term"), n.alias("n")), F.struct(F.lit(None).cast("string").alias("term"), F.lit(1).cast("long").alias("n")))
    rows = records.where(used).select(F.col(record_col).cast("string").alias("record"), _sign(sign_col).alias("sign"), F.inline(both))
    return rows.groupBy("term", "record", "n").agg(F.sum("sign").alias("copies")).where("copies <> 0")


def merge_rows(state: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """(term, record, n, copies, before): the state after the deltas; ``before`` is the number of copies before them."""
    new = deltas.select("term", "record", "n", "copies", F.lit(0).cast("long").alias("before"))
    if state is not None:
        new = new.union(state.select("term", "record", "n", "copies", F.col("copies").alias("before")))
    return new.groupBy("term", "record", "n").agg(F.sum("copies").alias("copies"), F.sum("before").alias("before"))


def valued_deltas(merged: DataFrame) -> DataFrame:
    """(term, occurrences, records): the change of the counts that a ``merge_rows`` makes.

    Repeated rows of one term, record and count count once; a record counts once per term however many of its rows hold it.
    """
    now, was = (F.col("copies") > 0).cast("long"), (F.col("before") > 0).cast("long")
    per = merged.groupBy("term", "record").agg(F.sum(F.col("n") * (now - was)).alias("n"), (F.max(now) - F.max(was)).alias("r"))
    return per.groupBy("term").agg(F.sum("n").alias("occurrences"), F.sum("r").alias("records")).where("occurrences <> 0 or records <> 0")


def merge_counts(counts: DataFrame | None, deltas: DataFrame) -> DataFrame:
    """Counts after the deltas; terms that no record holds any more leave."""
    both = deltas.select("term", "occurrences", "records")
    if counts is not None:
        both = both.union(counts.select("term", "occurrences", "records")).groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
    return both.where("records > 0 or occurrences > 0")


def record_total(counts: DataFrame) -> int:
    """The number of records that the counts stand for."""
    row = counts.where("term is null").select("records").first()
    return int(row[0]) if row else 0


def mark_terms(counts: DataFrame, total_records: int, rare_below: int, common_above: float) -> DataFrame:
    """Counts with ``mark``: 'rare' under ``rare_below`` occurrences, 'common' above that share of all records, else null."""
    mark = F.when(F.col("occurrences") < rare_below, "rare").when(F.col("records") > F.lit(common_above) * total_records, "common")
    return counts.where("term is not null").withColumn("mark", mark)


def change_set(before: DataFrame, after: DataFrame, id_col: str, text_col: str, whole: bool = True) -> DataFrame:
    """(text, sign): the signed records that lead from one state of a table to the next; unchanged records are left out.

    Repeated rows of one id hold the same text and count once. With ``whole`` records that ``after`` lacks were deleted, else ``after`` holds additions
    and changes only. Ids and hashes of the texts are compared first; the texts are then fetched for the changed ids alone
    (their ids are broadcast by Spark while they are few).
    """
    was, now = (df.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.xxhash64(text_col, F.col(text_col).isNull())).alias(name)) for df, name in ((before, "was"), (after, "now")))
    changed = materialise(was.join(now, "id", "full" if whole else "right").where("not (was <=> now)"))
    signed = []
    for df, name, sign in ((before, "was", -1), (after, "now", 1)):
        own = changed.where(F.col(name).isNotNull()).select(F.col("id").alias(id_col))
        signed.append(df.select(id_col, text_col).join(own, id_col, "left_semi").dropDuplicates([id_col]).select(F.col(text_col).alias("text"), F.lit(sign).alias("sign")))
    return signed[0].union(signed[1])


class TermStore(BucketStore):
    """Counts of terms kept on disk, partitioned by a hash of the term; a merge rewrites only the partitions it changes."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        super().__init__(spark, path, ("term",), rows_per_bucket)

    def counts(self) -> DataFrame | None:
        """The counts in force, or None before the first merge."""
        return self.table()

    def apply(self, deltas: DataFrame) -> int:
        """Merge signed deltas of counts and return the number of the new version."""
        return self.merged(deltas, merge_counts)[0]


class ValuedStore:
    """Counts of rows that carry a term and its count, with the state of these rows that signed deltas need."""

    def __init__(self, spark: SparkSession, path: str, rows_per_bucket: int = ROWS_PER_BUCKET) -> None:
        self.state = BucketStore(spark, f"{path}/rows", ("term", "record"), rows_per_bucket)
        self.terms = TermStore(spark, f"{path}/terms", rows_per_bucket)

    def apply(self, deltas: DataFrame) -> None:
        """Merge ``row_deltas``: the state first, then the change of the counts that it makes."""
        _, merged = self.state.merged(deltas, merge_rows, again=True)
        self.terms.apply(valued_deltas(merged))

    def counts(self) -> DataFrame | None:
        return self.terms.table()


def latest_records(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """One row per id (null ids are left out); rows of one id are repeats of the same content."""
    return df.where(F.col(id_col).isNotNull()).select(id_col, *cols).dropDuplicates([id_col])


__all__ = ["TermStore", "ValuedStore", "change_set", "latest_records", "mark_terms", "merge_counts", "merge_rows", "record_total", "row_deltas", "term_array", "text_deltas", "valued_deltas"]
