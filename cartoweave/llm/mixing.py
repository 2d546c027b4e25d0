"""Mixtures of sources with target shares of the total size in tokens (problem 8).

1. Tokens of every document are counted by a public tokenizer in Arrow batches; sources are compared without case and outer
   blanks. Totals per source are the only figures that reach the driver.
2. Weights: the token shares of the sources are tempered, w ~ target * (own share / target) ** e. The exponent e is bisected
   to the least value at which no source needs more than its allowed repetitions; e = 0 are the targets themselves. Without
   a wish for the total size, the largest total is taken at which the targets hold exactly. (Plain temperature weights, and
   the exponent that meets a target entropy, are there too: ``temperature_weights`` and ``exponent_for_entropy``.)
3. The budget of a source is realised as whole passes over its documents and the beginning of one further pass. Every pass is
   a permutation of its own, by blocks: documents fall into blocks by a hash of seed, pass and id, blocks are summed up
   first, and only the one block in which the budget ends is walked document by document. So the largest source is spread
   over many tasks. ``position`` is the place of an appearance in the order of its source over all passes.

Every step depends on hashes of the ids and passes only, so a lost executor repeats the same choice.
"""

from __future__ import annotations

import base64
import functools
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from cartoweave.session import materialise, spread

#: Documents in a block, about; and characters of a text after which it is cut where a token begins in any case.
BLOCK_ROWS, PIECE = 20_000, 4_096
BORDER = re.compile(r"(?<=\S) (?=\S)")


def default_tokenizer() -> str:
    """Path of the byte-level vocabulary that comes with the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def _encoder(path: str, pattern: str):  # noqa: ANN202
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _pieces(text: str) -> list[str]:
    """The text in pieces of at least PIECE characters, the last one apart, with the same tokens as the whole.

    Cuts lie before a single blank between two other characters, where a token of the pattern begins in any case; a text
    without such a place stays whole.
    """
    out, at = [], 0
    for found in BORDER.finditer(text):
        if found.start() - at >= PIECE:
            out.append(text[at : found.start()])
            at = found.start()
    return [*out, text[at:]]


def token_count(text: Column | str, path: str | None = None, pattern: str | None = None) -> Column:
    """Column: number of tokens of a text; null for null, 0 for the empty text. Long texts are counted piece by piece."""
    path = path or default_tokenizer()
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        encode = _encoder(path, pattern).encode_ordinary
        return pd.Series([None if t is None else sum(len(encode(p)) for p in (_pieces(t) if len(t) > PIECE else (t,))) for t in texts], dtype="Int64")

    return count(text)


def source_name(source: str) -> Column:
    """The name under which a source is compared."""
    return F.lower(F.trim(F.col(source)))


def temperature_weights(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to ``exponent`` and normalised: 1 keeps them, 0 makes all sources equal."""
    powers = {s: x**exponent for s, x in shares.items() if x > 0}
    total = sum(powers.values())
    return {s: p / total for s, p in powers.items()}


def entropy(weights: dict[str, float]) -> float:
    """Entropy of normalised weights in nats."""
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def _bisect(fits: Callable[[float], bool], low: float, high: float, steps: int = 60) -> float:
    """The least number between ``low`` and ``high`` that fits, when all larger ones fit too."""
    if fits(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


def exponent_for_entropy(shares: dict[str, float], target: float, largest: float = 8.0) -> float:
    """The exponent at which the tempered shares have the ``target`` entropy (nats), within 0 and ``largest``."""
    return _bisect(lambda e: entropy(temperature_weights(shares, e)) <= target, 0.0, largest)


def tempered_targets(targets: dict[str, float], tokens: dict[str, int], repeats: dict[str, int], total: float) -> tuple[dict[str, float], float]:
    """Weights next to the targets at which ``total`` tokens need no forbidden repetition, and the exponent that led there."""
    own = {s: t for s, t in tokens.items() if t > 0 and targets.get(s, 0) > 0}
    size = sum(own.values())
    aims = {s: targets[s] / sum(targets[x] for x in own) for s in own}

    def weights(e: float) -> dict[str, float]:
        return temperature_weights({s: aims[s] * (own[s] / size / aims[s]) ** e for s in own}, 1.0)

    fits = lambda e: all(w * total <= own[s] * repeats[s] * (1 + 1e-12) for s, w in weights(e).items())
    e = _bisect(fits, 0.0, 1.0)
    return weights(e), e


def largest_total(targets: dict[str, float], tokens: dict[str, int], repeats: dict[str, int]) -> float:
    """The largest total at which every source with documents can have exactly its target share."""
    own = [s for s, t in tokens.items() if t > 0 and targets.get(s, 0) > 0]
    whole = sum(targets[s] for s in own)
    return min((tokens[s] * repeats[s] * whole / targets[s] for s in own), default=0.0)


def counted(documents: DataFrame, id_col: str, text_col: str, source_col: str, path: str | None = None) -> DataFrame:
    """(id, source, tokens) of every document that has an id, a source and at least one token; repeated rows count once."""
    documents = spread(documents.select(id_col, text_col, source_col))
    rows = documents.where(F.col(id_col).isNotNull() & F.col(source_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), source_name(source_col).alias("source"), token_count(text_col, path).alias("tokens"))
    return rows.groupBy("id").agg(F.min(F.struct("source", "tokens")).alias("x")).select("id", "x.source", "x.tokens").where("tokens > 0")


def mixture(documents: DataFrame, id_col: str, text_col: str, source_col: str, targets: DataFrame, total: float | None = None, stretch: float = 1.0, path: str | None = None, seed: int = 7, budget_of_targets: int = 100_000) -> DataFrame:
    """(id, source, epoch, block, position, tokens): one row for each appearance of a document in the mixture.

    ``targets`` has source, target_share and max_repeats; rows with nulls or a share of 0 ask for nothing. Sources that are
    in only one of the tables have no part; the other targets then share the whole. ``total``: wished size in tokens; without
    it ``stretch`` times the largest size at which the targets hold exactly. A larger size than that tempers the shares.
    ``position`` counts from 1 within the source. A source misses its share by at most one document.
    """
    aims = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("share"), F.max("max_repeats").alias("repeats")).limit(budget_of_targets + 1).collect()
    if len(aims) > budget_of_targets:
        raise ValueError(f"more than {budget_of_targets} targets")
    share, repeats = {r[0]: r[1] for r in aims}, {r[0]: int(r[2]) for r in aims}
    spark = documents.sparkSession
    plan = spark.createDataFrame([(s,) for s in share], "source string")
    rows = materialise(counted(documents, id_col, text_col, source_col, path).join(F.broadcast(plan), "source"))
    sums = {r[0]: (r[1], r[2]) for r in rows.groupBy("source").agg(F.sum("tokens"), F.count("*")).collect()}
    tokens = {s: t for s, (t, _) in sums.items()}
    most = float(sum(tokens[s] * repeats[s] for s in tokens))
    size = min(most, stretch * largest_total(share, tokens, repeats) if total is None else float(total))
    weights, _ = tempered_targets(share, tokens, repeats, size)
    parts = []
    for s, w in weights.items():
        budget = min(round(w * size), tokens[s] * repeats[s])
        parts.append((s, budget // tokens[s], budget % tokens[s], max(1, -(-sums[s][1] // BLOCK_ROWS))))
    plan = spark.createDataFrame(parts, "source string, passes long, rest long, blocks long")
    every = rows.join(F.broadcast(plan), "source").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("passes") + F.when(F.col("rest") > 0, 1).otherwise(0))))
    every = every.where("passes > 0 or rest > 0").where("epoch > 0").withColumn("h", F.xxhash64(F.lit(seed), "epoch", "id")).withColumn("block", F.pmod("h", "blocks"))
    blocks = every.groupBy("source", "epoch", "block", "passes", "rest").agg(F.sum("tokens").alias("size"), F.count("*").alias("rows"))
    earlier = Window.partitionBy("source").orderBy("epoch", "block").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy("source", "epoch").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("offset", F.coalesce(F.sum("rows").over(earlier), F.lit(0))).withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    # blocks of the last pass that begin beyond the budget leave, the one in which it ends is cut by its own running sum
    blocks = materialise(blocks.where("epoch <= passes or before < rest").withColumn("left", F.when(F.col("epoch") <= F.col("passes"), F.col("size")).otherwise(F.col("rest") - F.col("before"))))
    order = Window.partitionBy("source", "epoch", "block").orderBy("h", "id")
    placed = every.select("id", "source", "epoch", "block", "tokens", "h").join(blocks.select("source", "epoch", "block", "offset", "left"), ["source", "epoch", "block"])
    placed = placed.withColumn("upto", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("place", F.row_number().over(order))
    return placed.where("upto <= left").select("id", "source", "epoch", "block", (F.col("offset") + F.col("place")).alias("position"), "tokens")


def report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, tokens, appearances, documents, most_repeats) of every target, absent ones too."""
    per = mixed.groupBy("source", "id").agg(F.count("*").alias("times"), F.sum("tokens").alias("tokens"))
    own = per.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.sum("times").alias("appearances"), F.count("*").alias("documents"), F.max("times").alias("most_repeats"))
    aims = targets.where("source is not null").groupBy(source_name("source").alias("source")).agg(F.sum("target_share").alias("target_share"))
    both = aims.join(own, "source", "left").fillna(0, ["tokens", "appearances", "documents", "most_repeats"])
    everything = F.sum("tokens").over(Window.partitionBy())
    return both.withColumn("actual_share", F.round(F.col("tokens") / F.greatest(everything, F.lit(1)), 6)).select("source", "target_share", "actual_share", "tokens", "appearances", "documents", "most_repeats")
