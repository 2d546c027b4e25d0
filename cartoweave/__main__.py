"""Command line (X11): ``list``, ``run``, ``density``, ``labels`` and ``hose``; ``--help`` after each tells its options.

``python -m cartoweave`` knows the queries of the core, ``python __spark_entry__.py`` all that are registered.
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartoweave.functions.text import MODES
from cartoweave.operators import labels as L
from cartoweave.operators import requests as W
from cartoweave.operators import trigram_model as M
from cartoweave.plans import catalogue
from cartoweave.session import get_session
from cartoweave.sources import readers


def labels(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Labels of the cells of a file of (token, cell) rows in one of the modes."""
    rows = L.parsed_rows(readers.view_lines(spark, args.rows_file), True)
    if args.precision:
        cell = F.array_join(F.slice(F.split("cell", ","), 1, args.precision), ",")
        rows = rows.groupBy("token", cell.alias("cell")).agg(F.sum("value").alias("value"))
    if args.mode == "magic":
        return L.magic_labels(rows, args.limit)
    if args.mode.startswith("token_"):
        return L.token_labels(rows, args.mode, args.limit)
    return L.location_labels(rows, args.mode, args.limit)


def hose(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    """Scores of the lines of the hose, or of their users, against the models of two folders of texts."""
    model = M.trigram_counts(spark.read.text(args.corpus, recursiveFileLookup=True), "value", args.trigram_mode)
    other = M.trigram_counts(spark.read.text(args.anti_corpus, recursiveFileLookup=True), "value", args.trigram_mode) if args.anti_corpus else None
    lines = readers.json_lines(spark, args.input, recursive=True).select("id", "screen_name", "text")
    scores = M.scored(lines, ["id", "screen_name", "text"], "text", model, other, args.trigram_mode, args.offset_factor, args.anti_offset_factor)
    made = scores if args.trial else M.user_means(scores, "screen_name").withColumnRenamed("mean_score", "score")
    good, bad = M.bisect(made, args.threshold)
    for part, path in ((good, args.good_file), (bad, args.bad_file), (made.orderBy("score"), args.dump_file)):
        if path:
            part.write.mode("overwrite").json(path)
    if args.queue:
        W.download_requests(good, "screen_name").write.mode("append").parquet(args.queue)
    if args.report:
        return made.agg(F.count("*").alias("n"), F.min("score").alias("least"), F.avg("score").alias("mean"), F.stddev("score").alias("deviation"), F.max("score").alias("most"))
    return good.orderBy(F.desc("score"))


def main(argv: list[str] | None = None, queries: dict[str, Callable[[SparkSession, str], DataFrame]] | None = None) -> int:
    """Run a registered query or a tool and show the result, write it as parquet, or explain its plan."""
    queries = catalogue.QUERIES if queries is None else queries
    parser = argparse.ArgumentParser(prog="cartoweave")
    todo = parser.add_subparsers(dest="todo", required=True)
    todo.add_parser("list")
    run = todo.add_parser("run")
    run.add_argument("query", choices=sorted(queries))
    run.add_argument("data")
    run.add_argument("--out")
    run.add_argument("--explain", action="store_true")
    grid = todo.add_parser("density")
    grid.add_argument("text")
    grid.add_argument("data")
    label = todo.add_parser("labels")
    label.add_argument("rows_file")
    label.add_argument("--mode", default="magic", choices=("magic", "total", "relative", "adjusted", "token_total", "token_relative"))
    label.add_argument("--precision", type=int, default=0, help="digits of the cells; all by default")
    label.add_argument("--limit", type=int, default=L.LIMIT)
    label.add_argument("--out")
    tap = todo.add_parser("hose")
    tap.add_argument("-i", "--input", required=True, help="file or folder of lines")
    tap.add_argument("--corpus", required=True, help="folder of texts of the wanted kind")
    tap.add_argument("--anti-corpus", help="folder of texts of other kinds")
    tap.add_argument("-m", "--trigram-mode", default="word_aware_lc", choices=sorted(MODES))
    tap.add_argument("-t", "--threshold", type=float, default=0.0)
    tap.add_argument("-f", "--offset-factor", type=float, default=M.OFFSET)
    tap.add_argument("-a", "--anti-offset-factor", type=float, default=M.OTHER_OFFSET)
    tap.add_argument("-T", "--trial", action="store_true", help="scores of lines, not of users")
    tap.add_argument("-g", "--good-file")
    tap.add_argument("-b", "--bad-file")
    tap.add_argument("-d", "--dump-file", help="all of them, by score")
    tap.add_argument("-q", "--queue", help="table that requests for the good users are added to")
    tap.add_argument("-r", "--report", action="store_true", help="statistics of the scores")
    for p in (run, grid, label, tap):
        p.add_argument("--master")
        p.add_argument("--rows", type=int, default=20)
    args = parser.parse_args(argv)
    if args.todo == "list":
        for name, f in sorted(queries.items()):
            print(f"{name}: {(f.__doc__ or '').splitlines()[0]}")
        return 0
    spark = get_session(master=args.master)
    if args.todo == "density":
        from cartoweave.operators.density_query import density_query
        from cartoweave.plans import map_queries as m

        df = density_query(args.text, m._named(spark, args.data), m.WHOLE, m.KERNEL)
    elif args.todo in ("labels", "hose"):
        df = {"labels": labels, "hose": hose}[args.todo](spark, args)
    else:
        df = queries[args.query](spark, args.data)
    if getattr(args, "explain", False):
        df.explain("formatted")
    elif getattr(args, "out", None):
        df.write.mode("overwrite").parquet(args.out)
    else:
        df.show(args.rows, False)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
