"""Languages of documents and of the passages of mixed ones (problem 3).

Multinomial naive Bayes over hashed character n-grams. A bounded, documented sample of labelled rows is fitted on the
driver (labels are noisy and texts are mixed, so the fit is repeated on the passages the first fit finds); the
log-probability matrix (languages x buckets, a few MB whatever the corpus holds) is broadcast, and every row of the corpus
is scored in numpy: each distinct word of a batch once, then a best path over the words of all texts of the batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.llm.canonical import bounded
from cartoweave.llm.words import Words, mix, words_of, words_of_many
from cartoweave.session import spread

LANGUAGES = ("en", "es", "de", "fr", "pt", "id", "nl", "ru")
BUCKETS = 1 << 17
#: Longest character n-gram; the whole word is a feature besides.
NGRAM = 4
#: Rows of the labelled sample that is fitted on the driver.
SAMPLE_ROWS = 24_000
#: Costs (log units) of changing the language at a mark between words, and where there is none.
CHANGE_AT_MARK, CHANGE_INSIDE = 5.0, 13.0
#: One word adds at most this much against a language, so a single odd word decides nothing.
WORD_LIMIT = 7.0


def label_language(label: str = "lang", languages: tuple[str, ...] = LANGUAGES):  # noqa: ANN201
    """Column: the language a label names, without region and case; null where it names none of ``languages``."""
    base = F.lower(F.trim(F.regexp_extract(F.col(label), r"^\s*([A-Za-z]+)", 1)))
    return F.when(base.isin(*languages), base)


def word_features(w: Words, which: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of every n-gram of the chosen words, with a mark on both ends of the word."""
    size = (w.end - w.start)[which] + 2
    first = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(len(which)), size)
    pos = np.arange(total) - first[word]
    cps = np.full(total, 0x5F, np.uint64)
    body = (pos > 0) & (pos < size[word] - 1)
    cps[body] = w.cps[(w.start[which][word] + pos - 1)[body]]
    owners, found = [np.arange(len(which))], [mix(w.key[which]) % np.uint64(buckets)]
    gram = np.zeros(total, np.uint64)
    for n in range(1, NGRAM + 1):
        if total < n:
            break
        gram = (gram[: total - n + 1] * np.uint64(0x100000001B3) + cps[n - 1 :]) if n > 1 else cps.copy()
        ok = pos[: total - n + 1] + n <= size[word[: total - n + 1]]
        owners.append(word[: total - n + 1][ok])
        found.append(mix(gram[ok] ^ np.uint64(n << 56)) % np.uint64(buckets))
    return np.concatenate(owners), np.concatenate(found).astype(np.int64)


@dataclass
class LanguageModel:
    """Log probabilities (languages x buckets) and how often each bucket was seen in the fit."""

    languages: tuple[str, ...]
    logp: np.ndarray
    seen: np.ndarray

    def word_scores(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score of each word for each language, whether the whole word is known from the fit)."""
        _, at, inverse = np.unique(w.key, return_index=True, return_inverse=True)
        owner, bucket = word_features(w, at)
        sums = np.stack([np.bincount(owner, self.logp[k][bucket], minlength=len(at)) for k in range(len(self.languages))], 1)
        sums -= sums.max(1, keepdims=True)
        known = self.seen[(mix(w.key[at]) % np.uint64(self.logp.shape[1])).astype(np.int64)] > 0
        sums = np.maximum(sums, np.where(known[:, None], -WORD_LIMIT, -WORD_LIMIT / 3))
        return sums[inverse], known[inverse]


def _logp(counts: np.ndarray, smoothing: float = 0.05) -> np.ndarray:
    p = counts + smoothing
    return np.log(p / p.sum(1, keepdims=True)).astype(np.float32)


def best_path(scores: np.ndarray, w: Words) -> np.ndarray:
    """The language number of every word: the best path over the words of each text, all texts of the batch at once."""
    n, k = scores.shape
    if not n:
        return np.zeros(0, np.int64)
    sizes = np.bincount(w.row, minlength=w.rows)
    first = np.cumsum(sizes) - sizes
    back = np.zeros((n, k), np.int8)
    total = np.array(scores, np.float64)
    texts = np.flatnonzero(sizes > 0)
    order = texts[np.argsort(-sizes[texts], kind="stable")]
    many = sizes[order]
    for t in range(1, int(many[0])):
        at = first[order[: np.searchsorted(-many, -t, "left")]] + t
        before = total[at - 1]
        change = np.where(w.brk[at], CHANGE_AT_MARK, CHANGE_INSIDE)
        best = before.argmax(1)
        jump = before[np.arange(len(at)), best] - change
        stay = before >= jump[:, None]
        total[at] += np.where(stay, before, jump[:, None])
        back[at] = np.where(stay, np.arange(k)[None], best[:, None])
    out = np.zeros(n, np.int64)
    last = first[order] + many - 1
    state = total[last].argmax(1)
    for t in range(int(many[0]) - 1, -1, -1):
        live = np.searchsorted(-many, -t, "left")
        at = first[order[:live]] + t
        out[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return out


def fit_languages(texts: pa.Array, labels: list[str | None], languages: tuple[str, ...] = LANGUAGES, rounds: int = 3) -> LanguageModel:
    """Fit on labelled texts; after the first round every word counts for the language its passage was found to be in."""
    w = words_of_many(texts)
    number = {x: i for i, x in enumerate(languages)}
    label = np.array([number.get(x, -1) for x in labels], np.int64)
    _, at, inverse = np.unique(w.key, return_index=True, return_inverse=True)
    owner, bucket = word_features(w, at)
    model = None
    for r in range(rounds):
        if model is None:
            of_word = label[w.row] if len(w.row) else np.zeros(0, np.int64)
        else:
            of_word = best_path(model.word_scores(w)[0], w)
        per = np.zeros((len(languages), len(at)))
        used = of_word >= 0
        np.add.at(per, (of_word[used], inverse[used]), 1.0)
        if r:  # a word seen once is a slip or an invented word, not evidence
            per[:, per.sum(0) < 3] = 0
            per[per < 0.02 * per.sum(0)] = 0
        per = np.where(per > 0, 1 + np.log(np.maximum(per, 1)), 0) if r else per
        counts = np.stack([np.bincount(bucket, per[k][owner], minlength=BUCKETS) for k in range(len(languages))])
        known = np.bincount((mix(w.key[at]) % np.uint64(BUCKETS)).astype(np.int64), (per.sum(0) > 0).astype(float), minlength=BUCKETS)
        model = LanguageModel(languages, _logp(counts), known.astype(np.float32))
    return model


def labelled_sample(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """At most ``rows`` labelled rows, chosen by the hash of their id (documented bound of the fit)."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), label_language(label_col, languages).alias("label")).where("label is not null and text is not null").orderBy(F.xxhash64("id"), "text", "label").limit(rows)


def passages(w: Words, path: np.ndarray, scores: np.ndarray, known: np.ndarray) -> dict[str, np.ndarray]:
    """Passages of a batch: row, number within the row, language, confidence, words, known words."""
    new = np.r_[True, (path[1:] != path[:-1]) | (w.row[1:] != w.row[:-1])]
    at = np.flatnonzero(new)
    piece = np.cumsum(new) - 1
    row = w.row[at]
    first_of_row = np.r_[True, row[1:] != row[:-1]]
    no = np.arange(len(at)) - np.maximum.accumulate(np.where(first_of_row, np.arange(len(at)), 0)) + 1
    sums = np.add.reduceat(scores, at, axis=0)
    sums -= sums.max(1, keepdims=True)
    conf = np.exp(sums)[np.arange(len(at)), path[at]] / np.exp(sums).sum(1)
    return {"row": row, "no": no, "lang": path[at], "conf": conf, "words": np.bincount(piece), "known": np.bincount(piece, known.astype(float)).astype(np.int64)}


def _detect(texts: pa.Array, model: LanguageModel) -> dict[str, np.ndarray]:
    """Passages of the batch. Passages without any word of the fit are invented words: they join a neighbour or vanish."""
    w = words_of(texts)
    none = {k: np.zeros(0, np.int64) for k in ("row", "no", "lang", "conf", "words", "known")}
    if not len(w.row):
        return none
    scores, known = model.word_scores(w)
    path = best_path(scores, w)
    found = passages(w, path, scores, known)
    if (found["known"] == 0).any():
        piece = np.repeat(np.arange(len(found["row"])), found["words"])
        keep = found["known"][piece] > 0
        if not keep.any():
            return none
        w, scores, known, path = w.take(keep), scores[keep], known[keep], path[keep]
        found = passages(w, path, scores, known)
    return found


SCHEMA = "id long, seg_no int, lang string, confidence double, words int, label string, several boolean"


def language_passages(df: DataFrame, id_col: str, text_col: str, label_col: str | None, model: LanguageModel) -> DataFrame:
    """One row for each passage in one language of each text.

    (id, seg_no from 1, lang, confidence, words, label as named by ``label_col``, several: the text has more than one passage). Texts that are null, empty or without a word give
    no row. Repeated rows are scored like any other; callers that want one result per id drop duplicates of (id, seg_no).
    """
    label = label_language(label_col, model.languages) if label_col else F.lit(None).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), label.alias("label")).where("text is not null and text <> ''")
    shared = df.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.seen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        names = np.array(own.languages, object)
        for b in bounded(batches):
            x = _detect(b.column("text"), own)
            many = np.bincount(x["row"], minlength=b.num_rows) > 1
            at = pa.array(x["row"], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(at), pa.array(x["no"], pa.int32()), pa.array(names[x["lang"]] if len(x["lang"]) else [], pa.string()), pa.array(x["conf"], pa.float64()), pa.array(x["words"], pa.int32()), b.column("label").take(at), pa.array(many[x["row"]], pa.bool_())],
                ["id", "seg_no", "lang", "confidence", "words", "label", "several"],
            )

    return spread(rows).mapInArrow(run, SCHEMA)


def fit_from(df: DataFrame, id_col: str, text_col: str, label_col: str, rows: int = SAMPLE_ROWS, languages: tuple[str, ...] = LANGUAGES) -> LanguageModel:
    """Fit a model on the bounded labelled sample of ``df``."""
    sample = labelled_sample(df, id_col, text_col, label_col, rows, languages).select("text", "label").toArrow()
    return fit_languages(sample.column("text").combine_chunks(), sample.column("label").to_pylist(), languages)


def missing_or_wrong(found: DataFrame) -> DataFrame:
    """Passages of texts whose label is missing, is not the text's language, or cannot be right as the text mixes several."""
    return found.where("several or label is null or label <> lang")
