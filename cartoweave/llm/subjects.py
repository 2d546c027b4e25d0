"""Subject areas of documents (problem 9).

A complement naive Bayes is fitted on the labelled examples, by language, and refined by expectation-maximisation over all
documents:

* a weight is the log-odds of a word in a subject against all other subjects and the rest of the corpus, shrunk towards the
  corpus and set to 0 where it is within chance; words stand in hashed buckets, one table per language;
* an example that the others clearly give another subject is taken for wrongly labelled and left out;
* each step scores windows of words of every document; the windows' posteriors (the subjects and a class without subject)
  give the word counts of the next weights. Counts are fixed-size matrices summed on the executors;
* a language without examples of a subject starts from its words that are spelled much like words of that subject in the
  other languages, and learns the rest from the documents. All words of the corpus are looked at, on the executors.

A document deals with a subject when its posterior reaches a half for the text or for one of its halves. The posteriors of
the subjects are independent of each other. Each is a logistic function of the naive Bayes evidence of the segment: the mean
posterior of its short pieces, the mean log-odds of its words, the longest stretch without evidence, and the length. Its
coefficients are fitted on a quarter of the labelled examples that is held out of the naive Bayes, in compositions that state
the task: a subject runs through a segment alone or in turn with another one, or it is a passage or a few words in a segment
of another subject or of none.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.llm.canonical import _code_points, bounded
from cartoweave.llm.language import LanguageModel, fit_from
from cartoweave.llm.sums import matrix_sum
from cartoweave.llm.words import Words, mix, words_of
from cartoweave.session import materialise, spread

LANGUAGES = ("en", "es", "de")
BUCKETS, WINDOW = 1 << 16, 16
#: Words of one piece of a segment, and words that are scored at once (a longer text is scored by itself).
PIECE, WORDS_AT_ONCE = 8, 250_000
#: Bounds of what is fitted on the driver: labelled documents for the language model, labelled examples.
LANGUAGE_ROWS, EXAMPLES = 3_000, 20_000
#: Every so manieth example of a subject and language is held out for the calibration; texts paired with each of these there.
HELD_OUT, PARTNERS = 4, 12
#: What the calibration calls passing: the largest share of a segment that one passage covers, and that scattered words have.
PASSAGE_SHARE, SCATTERED_SHARE = 0.6, 0.06
#: Weight of an example beside a document's window; evidence (log units) that the class without subject has.
EXAMPLE_WEIGHT, REST = 3.0, 3.0
LIMIT, CHANCE = 4.0, 2.5
KINSHIP = 0.5


@dataclass
class SubjectModel:
    """Weights ((language, bucket) x subjects) and the coefficients of the calibration (subjects x features)."""

    subjects: tuple[str, ...]
    language: LanguageModel
    weights: np.ndarray
    coefficients: np.ndarray


def _bucket(w: Words) -> np.ndarray:
    return (w.key % np.uint64(BUCKETS)).astype(np.int32)


def text_language(w: Words, model: LanguageModel) -> np.ndarray:
    """The main language (number) of each text."""
    scores, _ = model.word_scores(w)
    return np.stack([np.bincount(w.row, scores[:, k], minlength=w.rows) for k in range(scores.shape[1])], 1).argmax(1)


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window number of every word, and the text of every window; a text is cut into about equal windows."""
    count = np.where(sizes > 0, np.maximum(1, np.rint(sizes / WINDOW)), 0).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    pos = np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]
    return (np.cumsum(count) - count)[row] + pos * count[row] // np.maximum(sizes[row], 1), np.repeat(np.arange(len(sizes)), count)


def _distinct(window: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.unique(window.astype(np.int64) * BUCKETS + bucket)
    return pairs // BUCKETS, (pairs % BUCKETS).astype(np.int64)


def corpus_words(documents: DataFrame, id_col: str, text_col: str, model: LanguageModel) -> tuple[DataFrame, DataFrame]:
    """(id, language, words) of every document that has any words, and (language, word) of the vocabulary; one pass over the texts."""
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    shared = documents.sparkSession.sparkContext.broadcast((model.languages, model.logp, model.seen))
    names = ["id", "language", "words", "word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        told = np.zeros(0, np.uint64)
        for b in bounded(batches):
            w = words_of(b.column("text"))
            if not len(w.row):
                continue
            ends = np.r_[0, np.cumsum(np.bincount(w.row, minlength=w.rows))].astype(np.int32)
            lang = text_language(w, own)
            words = pa.ListArray.from_arrays(pa.array(ends), pa.array(_bucket(w)))
            full = pa.array(np.diff(ends) > 0)
            ids = b.column("id").filter(full)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lang, pa.int32()).filter(full), words.filter(full), pa.nulls(len(ids), pa.string())], names)
            key, first = np.unique(w.key ^ lang[w.row].astype(np.uint64), return_index=True)
            new = first[~np.isin(key, told)]
            told = np.union1d(told, key) if len(told) < WORDS_AT_ONCE else key
            yield pa.RecordBatch.from_arrays([pa.nulls(len(new), pa.int64()), pa.array(lang[w.row[new]], pa.int32()), pa.nulls(len(new), words.type), pa.array([w.text(i) for i in new], pa.string())], names)

    made = materialise(spread(rows).mapInArrow(run, "id long, language int, words array<int>, word string"))
    return made.where("words is not null").select("id", "language", "words"), made.where("word is not null").select("language", "word").distinct()


def _slices(b: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, language of each text, words in each text, all words) of about ``WORDS_AT_ONCE`` words of a batch at a time."""
    words = b.column("words")
    lang, sizes, bucket = b.column("language").to_numpy(), np.diff(words.offsets.to_numpy()), words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        base = ends[lo] - sizes[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, base + WORDS_AT_ONCE, "right")))
        yield lo, lang[lo:hi], sizes[lo:hi], bucket[base : ends[hi - 1]]
        lo = hi


def frequencies(words: DataFrame) -> np.ndarray:
    """In how many windows of each language each bucket occurs (languages x buckets), over all documents."""

    def make(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, lang, sizes, bucket in _slices(b):
            window, text = _windows(sizes)
            own, word = _distinct(window, bucket)
            total[:, 0] += np.bincount(lang[text[own]] * BUCKETS + word, minlength=len(total))

    return matrix_sum(words, make, len(LANGUAGES) * BUCKETS, 1).reshape(len(LANGUAGES), BUCKETS)


def complement_weights(counts: np.ndarray, corpus: np.ndarray, chance: float = CHANCE) -> np.ndarray:
    """Log-odds of each bucket in each class against all other classes, shrunk towards the corpus; 0 within chance."""
    prior = 400.0 * (corpus + 0.5) / (corpus.sum() + 0.5 * len(corpus))
    a, b = counts + prior, counts.sum(0) - counts + prior
    return _odds(counts, a, b, a.sum(1, keepdims=True), b.sum(1, keepdims=True), chance)


def _odds(counts: np.ndarray, a: np.ndarray, b: np.ndarray, a_sum: np.ndarray, b_sum: np.ndarray, chance: float) -> np.ndarray:
    odds = np.log(a / a_sum) - np.log(b / b_sum)
    sure = odds / np.sqrt(1 / a + 1 / b) > chance
    return np.where(sure & (counts >= 2), np.clip(odds, 0, LIMIT), 0)


def table_of(weights: np.ndarray) -> np.ndarray:
    """Weights (languages x subjects x buckets) as one row of subjects for each (language, bucket)."""
    return np.ascontiguousarray(weights.transpose(0, 2, 1).reshape(-1, weights.shape[1]), np.float32)


def _posteriors(own: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Posterior of each subject for each window (``own``, ascending); what is missing to 1 belongs to the class without subject."""
    scores = np.add.reduceat(evidence, np.flatnonzero(np.r_[True, own[1:] != own[:-1]]), axis=0)
    top = np.maximum(scores.max(1, keepdims=True), REST)
    p = np.exp(scores - top)
    return p / (p.sum(1, keepdims=True) + np.exp(REST - top))


def _expected(words: DataFrame, weights: np.ndarray) -> np.ndarray:
    """Expected counts (languages x buckets x subjects and rest) of one pass over all documents."""
    k = weights.shape[1]
    shared = words.sparkSession.sparkContext.broadcast(table_of(weights))

    def make(b: pa.RecordBatch, total: np.ndarray) -> None:
        for _, lang, sizes, bucket in _slices(b):
            window, text = _windows(sizes)
            own, word = _distinct(window, bucket)
            at = lang[text[own]] * BUCKETS + word
            p = _posteriors(own, shared.value[at])
            for s in range(k):
                some = np.flatnonzero(p[own, s] > 1e-3)
                total[:, s] += np.bincount(at[some], p[own[some], s], minlength=len(total))
            total[:, k] += np.bincount(at, 1 - p.sum(1)[own], minlength=len(total))

    made = matrix_sum(words, make, len(LANGUAGES) * BUCKETS, k + 1).reshape(len(LANGUAGES), BUCKETS, k + 1)
    shared.unpersist()
    return made


@dataclass
class _Examples:
    """Labelled texts: subject (-1: left out) and language of each, words in each, all words, one spelling of each bucket."""

    subject: np.ndarray
    lang: np.ndarray
    sizes: np.ndarray
    bucket: np.ndarray
    spelling: dict[tuple[int, int], str]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, bucket) of the distinct words of every window."""
        window, of = _windows(self.sizes)
        own, word = _distinct(window, self.bucket)
        return of[own], word

    def counts(self, subjects: int, chosen: np.ndarray) -> np.ndarray:
        c = np.zeros((len(LANGUAGES), subjects, BUCKETS))
        text, word = self.windows()
        used = (self.subject[text] >= 0) & chosen[text]
        np.add.at(c, (self.lang[text][used], self.subject[text][used], word[used]), 1)
        return c

    def drop_wrong(self, corpus: np.ndarray, subjects: int, margin: float = 6.0) -> None:
        """Leave out examples that the other examples of their language clearly give another subject."""
        everything = self.counts(subjects, np.ones(len(self.subject), bool))
        prior = 400.0 * (corpus + 0.5) / (corpus.sum(1, keepdims=True) + 0.5 * BUCKETS)
        sums, priors = everything.sum(2), prior.sum(1)
        text, word = self.windows()
        ends = np.searchsorted(text, np.arange(len(self.subject)), "right")
        wrong = []
        for i, (s, lang) in enumerate(zip(self.subject, self.lang, strict=True)):
            own = word[ends[i - 1] if i else 0 : ends[i]]
            if s < 0 or not len(own):
                continue
            seen, many = np.unique(own, return_counts=True)
            counts, total = everything[lang][:, seen], sums[lang].copy()
            counts[s] -= many
            total[s] -= len(own)
            rest = total.sum() - total
            p = prior[lang, seen]
            score = _odds(counts, counts + p, counts.sum(0) - counts + p, (total + priors[lang])[:, None], (rest + priors[lang])[:, None], 2.0).sum(1)
            if score.argmax() != s and score.max() > score[s] + margin:
                wrong.append(i)
        self.subject[wrong] = -1

    def held_out(self) -> np.ndarray:
        """Every ``HELD_OUT``-th example of each subject and language, where there are so many."""
        out = np.zeros(len(self.subject), bool)
        for lang in range(len(LANGUAGES)):
            for s in np.unique(self.subject[self.subject >= 0]):
                out[np.flatnonzero((self.lang == lang) & (self.subject == s))[HELD_OUT - 1 :: HELD_OUT]] = True
        return out

    def take(self, chosen: np.ndarray) -> _Examples:
        return _Examples(self.subject[chosen], self.lang[chosen], self.sizes[chosen], self.bucket[np.repeat(chosen, self.sizes)], self.spelling)


def spelling_grams(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) without repeats: pairs and triples of letters in a spelling that kindred words of the languages share.

    Without accents, with one letter for sounds that are written alike, without doubled letters, with a mark on both ends.
    """
    plain = pc.replace_substring_regex(pc.utf8_normalize(words, "NFD"), r"\p{Mn}", "")
    for a, b in (("ph", "f"), ("th", "t"), ("ch", "k"), ("qu", "k"), ("c", "k"), ("y", "i"), ("z", "s"), ("v", "b")):
        plain = pc.replace_substring(plain, a, b)
    cps, offsets = _code_points(pc.binary_join_element_wise("_", plain, "_", ""))
    owner = np.repeat(np.arange(len(words)), np.diff(offsets))
    keep = np.r_[True, (cps[1:] != cps[:-1]) | (owner[1:] != owner[:-1])][: len(cps)]
    cps, owner = cps[keep].astype(np.uint64), owner[keep]
    pairs = []
    for n in (2, 3):
        if len(cps) >= n:
            gram = np.zeros(len(cps) - n + 1, np.uint64)
            for i in range(n):
                gram = gram * np.uint64(0x110000) + cps[i : len(cps) - n + 1 + i]
            same = owner[: len(gram)] == owner[n - 1 :]
            pairs.append(np.stack([owner[: len(gram)][same].astype(np.uint64), mix(gram[same])], 1))
    made = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
    return made[:, 0].astype(np.int64), made[:, 1]


def _usual(words: pa.Array) -> np.ndarray:
    return np.array(pc.and_(pc.greater(pc.utf8_length(words), 3), pc.invert(pc.match_substring(words, "'"))), bool)


def _kindred(vocabulary: DataFrame, examples: _Examples, weights: np.ndarray, corpus: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Starting weights for subjects without examples in a language, from kindred words of the other languages.

    The strong words of the labelled examples (bounded, as these are) are broadcast; every word of the corpus is compared with
    them where it is read, and only kindred ones leave as (language, bucket, subject, weight).
    """
    seeds = np.zeros_like(weights)
    strong = [(lang, bucket, word) for (lang, bucket), word in sorted(examples.spelling.items()) if (have[lang] & (weights[lang, :, bucket] > 2)).any()]
    if not strong:
        return seeds
    spelled = pa.array([x[2] for x in strong], pa.string())
    owner, gram = spelling_grams(spelled)
    order = np.argsort(gram, kind="stable")
    usual = _usual(spelled)
    of = np.array([have[lang] & (weights[lang, :, bucket] > 2) for lang, bucket, _ in strong]) & usual[:, None]
    known = weights.max(1) >= 1
    rare = corpus < 0.2 * corpus.sum(0)
    shared = vocabulary.sparkSession.sparkContext.broadcast((owner[order], gram[order], np.bincount(owner, minlength=len(strong)), of, known | rare, ~have))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, gram, sizes, of, out, lacks = shared.value
        for b in batches:
            lang = b.column("language").to_numpy()
            w = words_of(b.column("word"), skip_marked=False)
            bucket = np.full(b.num_rows, -1)
            bucket[w.row] = _bucket(w)
            at = np.flatnonzero((bucket >= 0) & _usual(b.column("word")) & ~out[lang, bucket] & lacks[lang].any(1))
            if not len(at):
                continue
            own, g = spelling_grams(b.column("word").take(pa.array(at)))
            many = np.bincount(own, minlength=len(at))
            low = np.searchsorted(gram, g, "left")
            hits = np.searchsorted(gram, g, "right") - low
            spot = np.repeat(low, hits) + np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits)
            pair, common = np.unique(np.repeat(own, hits) * len(sizes) + owner[spot], return_counts=True)
            word, kin = pair // len(sizes), pair % len(sizes)
            dice = 2 * common / (many[word] + sizes[kin])
            best = np.zeros((len(at), of.shape[1]))
            near = dice >= KINSHIP
            np.maximum.at(best, word[near], dice[near, None] * of[kin[near]])
            i, s = np.nonzero((best >= KINSHIP) & lacks[lang[at]])
            yield pa.RecordBatch.from_arrays([pa.array(lang[at[i]], pa.int32()), pa.array(bucket[at[i]], pa.int32()), pa.array(s, pa.int32()), pa.array(2.5 * np.minimum(1.0, best[i, s] + 0.2))], ["language", "bucket", "subject", "weight"])

    made = spread(vocabulary).mapInArrow(run, "language int, bucket int, subject int, weight double").groupBy("language", "bucket", "subject").agg(F.max("weight").alias("weight"))
    for lang, bucket, s, weight in made.collect():  # at most one row for each weight of the table
        seeds[lang, s, bucket] = weight
    return seeds


def segment_features(lang: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, table: np.ndarray, part: int = 0) -> np.ndarray:
    """(texts x subjects x 4): evidence in the whole text (part 0), its first half (1) or its second half (2).

    Mean posterior of its pieces (each subject by itself against the class without subject), mean log-odds of its words,
    longest stretch without evidence as a share, logarithm of its length. An empty half has no evidence.
    """
    n, k = len(sizes), table.shape[1]
    first, half = np.cumsum(sizes) - sizes, (sizes + 1) // 2
    lo, hi = (half if part == 2 else np.zeros(n, np.int64)), (half if part == 1 else sizes)
    size = hi - lo
    some = np.flatnonzero(size > 0)
    out = np.zeros((n, k, 4))
    out[:, :, 2] = 1
    if not len(some):
        return out
    row = np.repeat(some, size[some])
    place = np.arange(len(row)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
    evidence = table[lang[row] * BUCKETS + bucket[(first + lo)[row] + place]]
    pieces = np.maximum(1, np.rint(size / PIECE)).astype(np.int64)
    heads = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    piece = place * pieces[row] // size[row]
    starts = np.flatnonzero(np.r_[True, (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])])
    posterior = 1 / (1 + np.exp(REST - np.add.reduceat(evidence, starts, axis=0)))
    out[some, :, 0] = np.add.reduceat(posterior, np.searchsorted(starts, heads), axis=0) / pieces[some, None]
    out[some, :, 1] = np.add.reduceat(evidence, heads, axis=0) / size[some, None] / 3
    out[:, :, 3] = np.log(np.maximum(size, 1))[:, None] / 4
    for s in range(k):
        at = np.flatnonzero(evidence[:, s] > 0)
        if not len(at):
            continue
        r, p = row[at], place[at]
        head = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        before = np.r_[-1, p[:-1]]
        before[head] = -1
        gap = np.maximum.reduceat(p - before - 1, head)
        last = np.r_[head[1:], len(p)] - 1
        out[r[head], s, 2] = np.maximum(gap, size[r[head]] - p[last] - 1) / size[r[head]]
    return out


def compositions(x: _Examples, subjects: int, table: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(language, words in each, all words, subjects that run through): segments made of labelled texts."""
    rng = np.random.default_rng(seed)
    ends = np.cumsum(x.sizes)
    texts = [x.bucket[e - n : e] for e, n in zip(ends, x.sizes, strict=True)]
    langs, segments, labels = [], [], []

    def add(i: int, words: np.ndarray, *through: int) -> None:
        if len(words):
            langs.append(x.lang[i])
            segments.append(words)
            labels.append(np.isin(np.arange(subjects), through))

    def touched(host: np.ndarray, guest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The host with one passage of the guest, and with some words of it scattered over the host."""
        passage, scattered = host.copy(), host.copy()
        n = max(1, int(len(host) * rng.uniform(0.1, PASSAGE_SHARE)))
        at = rng.integers(0, len(host) - n + 1)
        passage[at : at + n] = np.resize(guest, n)
        own = guest[table[x.lang[i] * BUCKETS + guest].max(1) > 0]
        if len(own):
            n = max(1, round(len(host) * rng.uniform(0, SCATTERED_SHARE)))
            scattered[rng.permutation(len(host))[:n]] = rng.choice(own, n)
        return passage, scattered

    for i, a in enumerate(texts):
        add(i, a, x.subject[i])
        add(i, a[: max(PIECE, len(a) // 2)], x.subject[i])
        plain = a[table[x.lang[i] * BUCKETS + a].max(1) <= 0]
        others = np.flatnonzero((x.lang == x.lang[i]) & (x.subject != x.subject[i]))
        for j in rng.permutation(others)[:PARTNERS]:
            b, step = texts[j], rng.integers(PIECE // 2, PIECE * 3 // 2)
            turns = np.concatenate([part[k : k + step] for k in range(0, min(len(a), len(b)), step) for part in (a, b)])
            add(i, turns, x.subject[i], x.subject[j])
            add(i, turns[: len(turns) // 2], x.subject[i], x.subject[j])
            if len(plain):
                host = np.resize(plain, len(a))
                passage, scattered = touched(host, b)
                add(i, passage)
                add(i, scattered)
                add(i, np.tile(scattered, 2))
            add(i, touched(a, b)[1], x.subject[i])
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, subjects), bool)
    return np.array(langs), np.array([len(s) for s in segments]), np.concatenate(segments), np.array(labels)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Coefficients of a ridged logistic regression, the constant last, by Newton's steps."""
    x = np.c_[x, np.ones(len(x))]
    b, penalty = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ b))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ b)
        b -= step
        if np.abs(step).max() < 1e-8:
            break
    return b


def calibrate(x: _Examples, subjects: int, table: np.ndarray) -> np.ndarray:
    """Coefficients (subjects x features and constant), each subject by itself; one without held-out texts takes those of all."""
    lang, sizes, bucket, through = compositions(x, subjects, table)
    if not through.any():
        return np.tile([4.0, 4.0, 0.0, 0.0, -4.0], (subjects, 1))  # without any held-out text: even odds at an even split
    f = segment_features(lang, sizes, bucket, table)
    pooled = logistic(f.reshape(-1, f.shape[2]), through.ravel())
    return np.array([logistic(f[:, s], through[:, s]) if through[:, s].any() else pooled for s in range(subjects)])


def subject_posteriors(lang: np.ndarray, sizes: np.ndarray, bucket: np.ndarray, table: np.ndarray, coefficients: np.ndarray) -> np.ndarray:
    """(texts x subjects): the larger of the posteriors of the text and of its halves."""
    best = np.zeros((len(sizes), table.shape[1]))
    for part in range(3):
        f = segment_features(lang, sizes, bucket, table, part)
        best = np.maximum(best, 1 / (1 + np.exp(-(np.einsum("nsf,sf->ns", f, coefficients[:, :-1]) + coefficients[:, -1]))))
    return best


def labelled_examples(examples: DataFrame, text: str, label: str, subjects: tuple[str, ...], language: LanguageModel) -> _Examples:
    """At most ``EXAMPLES`` labelled texts, an equal share of each subject, chosen by the hash of the text."""
    pick = Window.partitionBy("s").orderBy(F.xxhash64("t"), "t")
    rows = examples.where(F.col(text).isNotNull() & F.col(label).isin(*subjects)).select(F.col(text).alias("t"), F.col(label).alias("s"))
    taken = rows.withColumn("n", F.row_number().over(pick)).where(F.col("n") <= max(1, EXAMPLES // len(subjects))).orderBy("s", "n").select("t", "s").toArrow()
    w = words_of(taken.column("t").combine_chunks() if taken.num_rows else pa.array([], pa.string()))
    lang = text_language(w, language) if len(w.row) else np.zeros(w.rows, np.int64)
    number, bucket = {s: i for i, s in enumerate(subjects)}, _bucket(w).astype(np.int64)
    pair, first = np.unique(lang[w.row] * BUCKETS + bucket, return_index=True)
    spelling = {divmod(int(p), BUCKETS): w.text(i) for p, i in zip(pair, first, strict=True)}
    return _Examples(np.array([number[s] for s in taken.column("s").to_pylist()], np.int64), lang, np.bincount(w.row, minlength=w.rows), bucket, spelling)


def fit_subjects(words: DataFrame, vocabulary: DataFrame, examples: _Examples, subjects: tuple[str, ...], language: LanguageModel, rounds: tuple[int, int, int] = (2, 2, 2)) -> SubjectModel:
    """Fit on the examples and on all documents; ``rounds``: steps before, with and after the starting words by kinship."""
    k = len(subjects)
    corpus = frequencies(words)
    examples.drop_wrong(corpus, k)
    held = examples.held_out()
    labelled = examples.counts(k, ~held)
    have = np.array([[((examples.lang == m) & (examples.subject == s) & ~held).any() for s in range(k)] for m in range(len(LANGUAGES))])
    weights = np.stack([complement_weights(labelled[m], corpus[m]) for m in range(len(LANGUAGES))])

    def steps(weights: np.ndarray, n: int, seeds: np.ndarray | None = None) -> np.ndarray:
        for _ in range(n):
            counts = _expected(words, weights).transpose(0, 2, 1)
            counts[:, :k] += EXAMPLE_WEIGHT * labelled
            weights = np.stack([complement_weights(counts[m], corpus[m])[:k] for m in range(len(LANGUAGES))])
            if seeds is not None:
                weights = np.maximum(weights, seeds)
        return weights

    weights = steps(weights, rounds[0])
    if not have.all():
        seeds = _kindred(vocabulary, examples, weights, corpus, have)
        weights = steps(np.maximum(weights, seeds), rounds[1], seeds)
    weights = table_of(steps(weights, rounds[2]))
    return SubjectModel(subjects, language, weights, calibrate(examples.take(held & (examples.subject >= 0)), k, weights))


def document_subjects(documents: DataFrame, id_col: str, text_col: str, lang_col: str, examples: DataFrame, text: str, label: str, subjects: DataFrame, code: str, most_subjects: int = 10_000) -> DataFrame:
    """(id, subject, posterior): a row for each subject that a document deals with.

    ``posterior`` is at least a half; every subject has its own, they need not add up to 1. Null, empty and wordless texts
    have no subject; copies are decided alike; repeated rows of an id count once. Without examples or subjects the result is
    empty. More than ``most_subjects`` codes are an error, as weights of all of them are broadcast.
    """
    codes = tuple(r[0] for r in subjects.where(F.col(code).isNotNull()).select(F.col(code).cast("string").alias(code)).distinct().orderBy(code).limit(most_subjects + 1).collect())
    if len(codes) > most_subjects:
        raise ValueError(f"more than {most_subjects} subjects")
    schema = "id long, subject string, posterior double"
    if not codes or documents.where(F.col(text_col).isNotNull()).isEmpty():
        return documents.select(F.col(id_col).cast("long").alias("id"), F.lit("").alias("subject"), F.lit(0.0).alias("posterior")).where("false")
    language = fit_from(documents, id_col, text_col, lang_col, LANGUAGE_ROWS, LANGUAGES)
    words, vocabulary = corpus_words(documents, id_col, text_col, language)
    model = fit_subjects(words, vocabulary, labelled_examples(examples, text, label, codes, language), codes, language)
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.coefficients))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(codes, object)
        for b in batches:
            for lo, *part in _slices(b):
                posterior = subject_posteriors(*part, *shared.value)
                i, s = np.nonzero(posterior >= 0.5)
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(lo + i)), pa.array(names[s], pa.string()), pa.array(posterior[i, s])], ["id", "subject", "posterior"])

    return words.mapInArrow(run, schema).groupBy("id", "subject").agg(F.max("posterior").alias("posterior"))
