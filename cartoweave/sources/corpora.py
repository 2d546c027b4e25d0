"""Corpus tidying and mixing (S20, S21). Lines come as (doc, line_no, line); order within a document is by line_no."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.operators.running import running_sum


# The marks by which the line filters know the formats of their inputs.
CHAT_MARK, CHAT_SPLIT = "> ", "*.split"
QUOTE_ENDS, QUOTE_OTHERS = "])>", "+([/>-|=0"
CONTENTS_MARKS = ("***** Contents *****", "Skip_to_table_of_contents")
ARTICLE_ENDS = ("See also *****", 'Retrieved from "http://en.wikipedia.org/', "***** Notes *****")


def _any_of(c: Column, marks: tuple[str, ...]) -> Column:
    found = c.contains(marks[0])
    for m in marks[1:]:
        found = found | c.contains(m)
    return found


def chat_messages(lines: DataFrame, col: str = "line") -> DataFrame:
    """The message of lines with exactly one '> '; network splits leave."""
    parts = F.split(col, CHAT_MARK)
    return lines.where((F.size(parts) == 2) & ~parts[1].startswith(CHAT_SPLIT)).withColumn("message", parts[1])


def quote_messages(lines: DataFrame, col: str = "line") -> DataFrame:
    """What follows the first '>', else ')', else ']'; messages that begin with a mark of their own leave."""
    c = F.col(col)
    message = F.lit(None).cast("string")
    for sep in QUOTE_ENDS:
        at = F.locate(sep, c)
        message = F.when(at > 0, F.regexp_replace(F.substr(c, at + 1), r"^\s+", "")).otherwise(message)
    return lines.withColumn("message", message).where((F.length("message") > 0) & ~F.substring("message", 1, 1).isin(*QUOTE_OTHERS))


def _state_before(event: Column, order: Window) -> Column:
    return F.last(event, ignorenulls=True).over(order)


def article_lines(lines: DataFrame, col: str = "line", talk: str = "talk") -> DataFrame:
    """The running text of dumped encyclopaedia pages, by the last mark above each line.

    Contents mark: a list of contents begins; the next heading after it, or the jump line (not on talk pages), begins the
    text; 'See also', notes and the source line end it. The state is a window function over the lines of a document.
    """
    c = F.col(col)
    contents, ends = _any_of(c, CONTENTS_MARKS), _any_of(c, ARTICLE_ENDS)
    heading = c.startswith("*****")
    jump = c.startswith("Jump to: navigation") & ~F.col(talk)
    w = Window.partitionBy("doc").orderBy("line_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    mark = F.when(contents, 1).when(ends, 0).when(heading, 3).when(jump, 2)
    marked = lines.withColumn("mark", mark)
    firm = F.when(F.col("mark") != 3, F.col("mark"))
    marked = marked.withColumn("firm", F.coalesce(_state_before(firm, before), F.lit(0))).withColumn("run", F.sum(F.when(F.col("mark") != 3, 1).otherwise(0)).over(w))
    heads = F.sum(F.when(F.col("mark") == 3, 1).otherwise(0)).over(Window.partitionBy("doc", "run").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("heads", F.coalesce(heads, F.lit(0)))
    text = (F.col("firm") == 2) | ((F.col("firm") == 1) & (F.col("heads") > 0))
    takes = F.col("mark").isNull() | ((F.col("mark") == 3) & text)
    return marked.where(takes & text & ~F.substring(c, 1, 1).isin("[", "*")).drop("mark", "firm", "run", "heads")


def without_references(lines: DataFrame, col: str = "line") -> DataFrame:
    """Lines before the search box, without numbered references and the lines that follow them: each reference takes
    three lines, references among these three more."""
    c = F.trim(col)
    w = Window.partitionBy("doc").orderBy("line_no")
    rows = lines.withColumn(col, c).withColumn("over", F.max(F.col(col).startswith("[search              ]").cast("int")).over(w)).where("over = 0").drop("over")
    i = F.row_number().over(w)
    refs = F.sum(F.col(col).rlike(r"^\d+\. ").cast("int") * 3).over(w)
    level = rows.withColumn("i", i).withColumn("refs", refs).withColumn("net", F.col("refs") - F.col("i"))
    low = F.least(F.lit(0), F.min("net").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    waiting = F.col("refs") - (F.col("i") - 1) - F.coalesce(low, F.lit(0))
    return level.withColumn("waiting", waiting).where("waiting <= 0").drop("i", "refs", "net", "waiting")


def mixed_by_bytes(docs: DataFrame, lang: str, order: str, text: str, parts: dict[str, int], whole: str) -> DataFrame:
    """Documents of each language, in order, as long as they begin within its byte budget.

    The budget of a language is its part of the bytes of ``whole``, which is taken as a whole.
    """
    size = F.octet_length(F.encode(text, "UTF-8")).cast("bigint")
    rows = docs.where(F.col(lang).isin(*parts) & F.col(text).isNotNull()).withColumn("bytes", size)
    chunk = rows.where(F.col(lang) == whole).agg(F.expr(f"coalesce(sum(bytes), 0) div {parts[whole]}").alias("chunk"))
    share = F.create_map(*[F.lit(x) for pair in parts.items() for x in pair])[F.col(lang)]
    made = running_sum(rows, [lang], [F.col(order)], F.col("bytes"), "upto").withColumn("before", F.col("upto") - F.col("bytes")).drop("upto").join(F.broadcast(chunk))
    return made.where((F.col(lang) == whole) | (F.col("before") < F.col("chunk") * share)).drop("chunk", "before")
