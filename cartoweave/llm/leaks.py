"""Evaluation passages inside a large corpus, found by latent semantic retrieval and an alignment check (problem 7).

1. Texts become words once (canonical, lower-cased, hashed; layout, case, marks and character forms leave no trace). Words
   fall into buckets; how many passages hold each bucket is counted over all documents.
2. A randomised SVD of the TF-IDF passages gives the latent space. Its products are summed over the executors; it is fitted
   on a bounded, documented sample of documents together with all items, and every document is searched in it.
3. The latent passages of the items are indexed by cells around means; every passage of every document looks into its nearest
   cells, and pairs of a document and an item above ``cosine`` are candidates. An item in a few pieces that lie apart fills no
   passage, so pairs whose shared word triples alone could make up the asked share are candidates too.
4. A candidate is decided by the longest common subsequence of words: on every diagonal of the two texts that holds enough
   equal words, a bit-parallel LCS of the item and the window of the text there; matched words count where they stand densely
   (so that shared vocabulary adds nothing), and the pieces are chained in the order of both texts. ``share`` of the item's
   words must be found.

Nothing is shuffled in the search: each document is decided where it is read. Items come in blocks of a bounded size, each
with one pass over the words of the corpus. An item's instruction before its first colon is left out. Items have no separate
answers here, so the check of an answer is the check of the passage.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartoweave.llm.canonical import bounded
from cartoweave.llm.sums import matrix_sum
from cartoweave.llm.words import mix, words_of
from cartoweave.session import materialise, spread

BUCKETS, RANK, OVERSAMPLE = 4096, 128, 16
#: Words of a passage, and words between the starts of two passages (a passage is a whole number of such steps).
PASSAGE, STRIDE = 28, 7
#: Documents of the sample the latent space is fitted on.
SAMPLE_DOCUMENTS = 6_000
COSINE, SHARE = 0.65, 0.5
#: The largest weight of a word: slips of the pen are rare and would else outweigh the passage around them.
IDF_MOST = 4.0
#: Diagonals that are looked at together; the least words of a piece; what a word costs that stands between two equal ones.
BAND, PIECE, BETWEEN = 8, 6, 0.5
#: Passages of documents that are searched at once, cells that each looks into, and characters of items in one broadcast.
PASSAGES_AT_ONCE, PROBES, ITEM_CHARS_AT_ONCE = 8_192, 8, 2_000_000


def passage_text(text: Column | str) -> Column:
    """Column: the text of an item without the instruction before its first colon."""
    c = F.col(text) if isinstance(text, str) else text
    at = F.instr(c, ":")
    return F.when(at > 0, F.substr(c, at + 1)).otherwise(c)


def item_passages(texts: list[str | None]) -> pa.Array:
    """Item texts without the instruction before the first colon."""
    return pa.array([None if t is None else t.split(":", 1)[-1] for t in texts], pa.string())


def text_words(rows: DataFrame) -> DataFrame:
    """(id, words): the hashed words of every text of ``rows`` (id, text) that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            w = words_of(b.column("text"))
            sizes = np.bincount(w.row, minlength=w.rows)
            words = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array((w.key >> np.uint64(32)).astype(np.uint32).view(np.int32)))
            full = pa.array(sizes > 0)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(full), words.filter(full)], ["id", "words"])

    return rows.mapInArrow(run, "id long, words array<int>")


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(all words, number of words of each text) of a batch of ``text_words``."""
    words = b.column("words")
    return words.flatten().to_numpy(zero_copy_only=False).view(np.uint32), np.diff(words.offsets.to_numpy())


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end word) of the overlapping passages of texts with ``sizes`` words; the last one ends with the text."""
    count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - PASSAGE) // STRIDE)), 0)
    row = np.repeat(np.arange(len(sizes)), count)
    no = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first = (np.cumsum(sizes) - sizes)[row]
    return row, first + no * STRIDE, first + np.minimum(no * STRIDE + PASSAGE, sizes[row])


def passage_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """In how many disjoint passages of all texts each bucket occurs, and the number of these passages."""

    def make(b: pa.RecordBatch, total: np.ndarray) -> None:
        key, sizes = _batch(b)
        count = -(-sizes // PASSAGE)
        row = np.repeat(np.arange(len(sizes)), sizes)
        passage = (np.cumsum(count) - count)[row] + (np.arange(len(row)) - (np.cumsum(sizes) - sizes)[row]) // PASSAGE
        total[:-1, 0] += np.bincount(np.unique(passage * BUCKETS + key % BUCKETS) % BUCKETS, minlength=BUCKETS)
        total[-1, 0] += count.sum()

    out = matrix_sum(words, make, BUCKETS + 1, 1)[:, 0]
    return out[:-1], int(out[-1])


def _slabs(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The passages of all texts, ``PASSAGES_AT_ONCE`` at a time, however long a single text is."""
    row, a, e = _windows(sizes)
    for lo in range(0, len(row), PASSAGES_AT_ONCE):
        yield row[lo : lo + PASSAGES_AT_ONCE], a[lo : lo + PASSAGES_AT_ONCE], e[lo : lo + PASSAGES_AT_ONCE]


def _latent(key: np.ndarray, row: np.ndarray, a: np.ndarray, e: np.ndarray, weighted: np.ndarray) -> np.ndarray:
    """Latent vectors of consecutive passages [a, e): sums of whole steps, then of the steps of a passage."""
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    last = np.r_[first[1:], len(row)] - 1
    many = -(-(e[last] - a[first]) // STRIDE)
    step = np.repeat(a[first], many) + STRIDE * (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
    sums = np.zeros((len(step) + 1, weighted.shape[1]))
    np.cumsum(np.add.reduceat(weighted[(key[step[0] : e[-1]] % BUCKETS).astype(np.int64)], step - step[0], axis=0, dtype=np.float32), axis=0, out=sums[1:])
    return sums[np.searchsorted(step, e, "left")] - sums[np.searchsorted(step, a, "left")]


def _tfidf_product(key: np.ndarray, sizes: np.ndarray, idf: np.ndarray, basis: np.ndarray, total: np.ndarray) -> None:
    """total += A'A basis for the TF-IDF passages A of the texts."""
    weighted = (idf[:, None] * basis).astype(np.float32)
    for row, a, e in _slabs(sizes):
        latent = _latent(key, row, a, e, weighted)
        passage = np.repeat(np.arange(len(a)), e - a)
        word = (key[np.arange(len(passage)) - np.repeat(np.cumsum(e - a) - (e - a), e - a) + np.repeat(a, e - a)] % BUCKETS).astype(np.int64)
        order = np.argsort(word, kind="stable")
        heads = np.flatnonzero(np.r_[True, np.diff(word[order]) > 0])
        found = word[order][heads]
        total[found] += np.add.reduceat(latent[passage[order]], heads, axis=0) * idf[found][:, None]


def _unit(x: np.ndarray) -> np.ndarray:
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


@dataclass
class LatentSpace:
    """Weights of the buckets and the map of buckets to latent dimensions."""

    idf: np.ndarray
    basis: np.ndarray


def fit_space(words: DataFrame, items: DataFrame, rank: int = RANK, sample: int = SAMPLE_DOCUMENTS, seed: int = 11) -> LatentSpace:
    """Randomised SVD (one power step) of the TF-IDF passages of the sample and of all items; frequencies over all documents."""
    df, n = passage_frequencies(words)
    idf = np.minimum(np.log((n + 1) / (df + 1)) + 0.1, IDF_MOST)
    rows = spread(materialise(words.orderBy(F.xxhash64("id"), F.xxhash64("words")).limit(sample)))
    basis = np.random.default_rng(seed).standard_normal((BUCKETS, rank + OVERSAMPLE)) / np.sqrt(BUCKETS)
    for _ in range(2):

        def make(b: pa.RecordBatch, total: np.ndarray, current: np.ndarray = basis) -> None:
            _tfidf_product(*_batch(b), idf, current, total)

        total, own = (matrix_sum(t, make, BUCKETS, rank + OVERSAMPLE) for t in (rows, items))
        basis, _ = np.linalg.qr(total + own * max(1.0, np.linalg.norm(total) / max(1e-9, np.linalg.norm(own))))
    return LatentSpace(idf, basis[:, :rank])


@dataclass
class CellIndex:
    """Latent passages in cells around their means; a search looks into the ``probes`` nearest cells."""

    means: np.ndarray
    members: list[np.ndarray]
    latent: np.ndarray

    def pairs(self, x: np.ndarray, cosine: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray]:
        """(row of x, passage) of at least that cosine."""
        near = x @ self.means.T
        k = min(probes, near.shape[1])
        least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for c, own in enumerate(self.members):
            at = np.flatnonzero(near[:, c] >= least)
            if len(at):
                i, j = np.nonzero(x[at] @ self.latent[own].T >= cosine)
                rows.append(at[i])
                found.append(own[j])
        return np.concatenate(rows), np.concatenate(found)


def cell_index(latent: np.ndarray, steps: int = 4) -> CellIndex:
    """About sqrt(n) cells by a few steps of k-means on the unit vectors; empty cells vanish."""
    cells = max(1, round(np.sqrt(len(latent))))
    means = latent[np.random.default_rng(3).permutation(len(latent))[:cells]]
    for _ in range(steps):
        of = (latent @ means.T).argmax(1)
        sums = np.zeros((len(means), latent.shape[1]), np.float32)
        np.add.at(sums, of, latent)
        means = _unit(sums[np.bincount(of, minlength=len(means)) > 0])
    of = (latent @ means.T).argmax(1)
    return CellIndex(means, [np.flatnonzero(of == c) for c in range(len(means))], latent)


def lcs_pairs(item: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the item, in the text) of a longest common subsequence, by one integer of bits per word of the text."""
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    everything = (1 << len(item)) - 1
    v, states = everything, []
    for w in text.tolist():
        u = v & places.get(w, 0)
        v = ((v + u) | (v - u)) & everything
        states.append(v)
    # the number of zero bits among the first i of state j is the length for item[:i] and text[:j]
    i, j, rows, cols = len(item), len(text), [], []
    while i and j:
        length = i - (states[j - 1] & ((1 << i) - 1)).bit_count()
        if not length:
            break
        above = states[j - 2] if j > 1 else everything
        if i - (above & ((1 << i) - 1)).bit_count() == length:
            j -= 1
        elif i - 1 - (states[j - 1] & ((1 << (i - 1)) - 1)).bit_count() == length:
            i -= 1
        else:
            i, j = i - 1, j - 1
            rows.append(i)
            cols.append(j)
    return np.array(rows[::-1], np.int64), np.array(cols[::-1], np.int64)


def _dense(i: np.ndarray, j: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    """(end in the text, end in the item, words, start in the text, start in the item) of dense parts of a common subsequence.

    Every matched word adds 1 and every word between two of them (in the text that has more) costs ``BETWEEN``; a part ends
    where nothing is left of it, and is cut back to its best place.
    """
    made = []
    start = best = 0
    score = top = 1.0
    for k in range(1, len(i) + 1):
        left = score - BETWEEN * (max(i[k] - i[k - 1], j[k] - j[k - 1]) - 1) if k < len(i) else -1.0
        if left <= 0:
            if best - start + 1 >= least and top >= least / 2:
                made.append((int(j[best]) + 1, int(i[best]) + 1, best - start + 1, int(j[start]), int(i[start])))
            start, best, score, top = k, k, 1.0, 1.0
        else:
            score = left + 1
            if score > top:
                best, top = k, score
    return made


def aligned_words(item: np.ndarray, text: np.ndarray, piece: int = PIECE, need: float = 0.0) -> int:
    """How many words of ``item`` the text holds in its order, in pieces; 0 where it cannot be ``need``.

    A piece is a dense part, of at least ``piece`` words (or half of a short item), of the longest common subsequence of the
    item and a window of the text around one diagonal. Of these the best chain that keeps the order of both texts counts.
    """
    least = min(piece, max(3, len(item) // 2))
    order = np.argsort(item, kind="stable")
    low, high = np.searchsorted(item[order], text, "left"), np.searchsorted(item[order], text, "right")
    many = high - low
    j = np.repeat(np.arange(len(text)), many)
    i = order[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    spots, reach = [], int((1 + 1 / BETWEEN) * least)
    held = np.zeros(len(item), bool)
    for shift in (0, BAND // 2):  # two sets of bands, so that a drift across the border of one lies within another
        band = (j - i + shift + len(item)) // BAND
        by = np.lexsort((i, j, band))
        x, y, z = band[by], j[by], i[by]
        head = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])[: len(x)]
        if len(head) < least:
            continue
        first, last = head[: len(head) - least + 1], head[least - 1 :]
        close = (x[first] == x[last]) & (y[last] - y[first] <= reach)  # enough equal words close together
        if not close.any():
            continue
        spots.append((x, y, z, first[close], last[close]))
        edges = np.bincount(first[close], minlength=len(x) + 1) - np.bincount(last[close] + 1, minlength=len(x) + 1)
        held[z[np.cumsum(edges)[:-1] > 0]] = True
    if not spots or held.sum() < need:
        return 0
    pieces: set[tuple[int, int, int, int, int]] = set()
    for x, y, z, first, last in spots:
        for b in np.unique(x[first]):
            lo, hi = int(y[first[x[first] == b]].min()), int(y[last[x[first] == b]].max()) + 1
            lo, hi = max(0, lo - reach), min(len(text), hi + reach)
            inside = (x == b) & (y >= lo) & (y < hi)
            start, end = int(z[inside].min()), int(z[inside].max()) + 1
            found = _dense(*lcs_pairs(item[start:end], text[lo:hi]), least)
            for e, f, *_ in list(found):  # matches lie as early as they can; once more from the end, as late as they can
                u, v = lcs_pairs(item[start : start + f][::-1], text[lo : lo + e][::-1])
                found += _dense(f - 1 - u[::-1], e - 1 - v[::-1], least)
            pieces.update((e + lo, f + start, n, s + lo, t + start) for e, f, n, s, t in found)
    ordered = sorted(pieces)
    chain: list[int] = []
    for _, _, words, sj, si in ordered:
        before = [c for c, p in zip(chain, ordered, strict=False) if p[0] <= sj and p[1] <= si]
        chain.append(words + max(before, default=0))
    return max(chain, default=0)


def _triples(key: np.ndarray) -> np.ndarray:
    """A key of every word and the two after it."""
    if len(key) < 3:
        return np.zeros(0, np.uint64)
    k = key.astype(np.uint64)
    return mix(k[:-2] + mix(k[1:-1] + mix(k[2:])))


def _shared_triples(grams: np.ndarray, of: np.ndarray, items: int, key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, places of the text that begin a triple of the item); ``grams`` are the sorted triples of the items ``of``."""
    none = np.zeros(0, np.int64)
    if len(key) < 3:
        return none, none, none
    inside = text[:-2] == text[2:]
    triple, text = _triples(key)[inside], text[:-2][inside]
    low = np.searchsorted(grams, triple, "left")
    many = np.searchsorted(grams, triple, "right") - low
    at = np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    pair, count = np.unique(np.repeat(text, many) * items + of[at], return_counts=True)
    return pair // items, pair % items, count


@dataclass
class ItemBlock:
    """The items of one broadcast: ids, words, the index of their passages and their word triples."""

    ids: np.ndarray
    keys: list[np.ndarray]
    weighted: np.ndarray
    index: CellIndex
    of: np.ndarray
    grams: np.ndarray
    gram_of: np.ndarray


def item_block(rows: pa.Table, space: LatentSpace) -> ItemBlock:
    """The block of the items in ``rows`` (id, words)."""
    (batch,) = rows.combine_chunks().to_batches()
    key, sizes = _batch(batch)
    ends = np.cumsum(sizes)
    keys = [key[e - n : e] for e, n in zip(ends, sizes, strict=True)]
    weighted = (space.idf[:, None] * space.basis).astype(np.float32)
    latent, of = [], []
    for row, a, e in _slabs(sizes):
        latent.append(_unit(_latent(key, row, a, e, weighted)))
        of.append(row)
    triples = [np.unique(_triples(k)) for k in keys]
    grams, gram_of = np.concatenate(triples), np.repeat(np.arange(len(keys)), [len(t) for t in triples])
    by = np.argsort(grams, kind="stable")
    return ItemBlock(batch.column("id").to_numpy(), keys, weighted, cell_index(np.concatenate(latent)), np.concatenate(of), grams[by], gram_of[by])


def candidates(block: ItemBlock, key: np.ndarray, sizes: np.ndarray, cosine: float, share: float) -> np.ndarray:
    """(text, item) pairs, sorted: near in the latent space, or with enough shared triples."""
    most = len(block.ids)
    found = []
    for row, a, e in _slabs(sizes):
        at, passage = block.index.pairs(_unit(_latent(key, row, a, e, block.weighted)), cosine)
        found.append(np.unique(row[at] * most + block.of[passage]))
    text, item, count = _shared_triples(block.grams, block.gram_of, most, key, np.repeat(np.arange(len(sizes)), sizes))
    enough = 3 * count >= share * np.array([len(k) for k in block.keys])[item]
    pairs = np.unique(np.concatenate([*found, text[enough] * most + item[enough]]))
    return np.stack([pairs // most, pairs % most], 1)


def leaked(documents: DataFrame, id_col: str, text_col: str, items: DataFrame, item_id: str, item_text: str, cosine: float = COSINE, share: float = SHARE) -> DataFrame:
    """(id, item, covered): documents that hold at least ``share`` of an item's words in order, with that share.

    Null and empty texts hold nothing. Repeated rows of one document are decided alike and give one row. Copies each get
    their own row. With no items, or items without words, the result is empty.
    """
    spark = documents.sparkSession
    taken = items.where(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(item_text).cast("string").alias("text")).groupBy("id").agg(F.min("text").alias("text"))
    own = materialise(text_words(taken.select("id", passage_text("text").alias("text"))))
    rows = documents.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sizes = own.agg(F.count("*"), F.sum(F.size("words"))).first()
    if not sizes[0]:
        return rows.select("id", F.lit(0).cast("long").alias("item"), F.lit(0.0).alias("covered")).where("false")
    words = materialise(text_words(spread(rows)))
    space = fit_space(words, own)
    blocks = -(-int(sizes[1]) * 8 // ITEM_CHARS_AT_ONCE)
    made = None
    for c in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == c).orderBy("id").toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast(item_block(part, space))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            block: ItemBlock = shared.value
            for b in batches:
                key, sizes = _batch(b)
                ends = np.cumsum(sizes)
                found = []
                for text, item in candidates(block, key, sizes, cosine, share).tolist():
                    wanted = block.keys[item]
                    covered = aligned_words(wanted, key[ends[text] - sizes[text] : ends[text]], need=share * len(wanted)) / len(wanted)
                    if covered >= share:
                        found.append((text, block.ids[item], covered))
                at = pa.array([f[0] for f in found], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("id").take(at), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.float64())], ["id", "item", "covered"])

        found = spread(words).mapInArrow(run, "id long, item long, covered double")
        made = found if made is None else made.union(found)
    return made.groupBy("id", "item").agg(F.max("covered").alias("covered"))
