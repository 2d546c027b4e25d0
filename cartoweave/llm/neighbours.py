"""The most similar vectors of every vector, from shifted space-filling curves (problem 4).

1. Every vector is projected several times (principal axes, a random rotation and a shift for each ordering) and gets the
   index of its cell on a Hilbert curve of ``DIMS`` dimensions and ``BITS`` bits, so fine that dense groups are told apart.
2. How many orderings and how wide a window are needed is measured, not fixed: ``SAMPLE`` rows are compared with all rows, and
   one pass counts how far their true neighbours lie from them in each ordering. The cheapest pair of both that finds the
   asked ``recall`` of these neighbours is taken. A window is never below ``WINDOW_LEAST``, so tables up to that size are
   compared completely.
3. All orderings are range-partitioned and sorted together; every vector is compared with the vectors of its window in blocks
   of one matrix product, and the nearest ones by exact distance in float64 leave. What a window would see beyond the border
   of its range is compared in a second step: the outermost rows of neighbouring ranges meet in one bounded group.
4. The best of all orderings are merged by exact distance.

Where no window up to ``WINDOW_MOST`` would do (vectors without structure in very many dimensions) an exact way takes over:
rows in chunks of ``CHUNK`` are broadcast and compared with all rows.

Vectors travel packed without loss: numbers of few decimals as integers of two or four bytes. At most k + 1 exact copies of a
vector (those with the smallest ids) enter the curves; every further copy has the first k copies, at distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cartoweave.functions.text import let
from cartoweave.llm.sums import matrix_sum
from cartoweave.ml.blocks import nearest_in_block
from cartoweave.session import materialise, spread

DIMS, BITS, WORD, SEED = 12, 10, 60, 17
#: Numbers of orderings that are tried, and the cost of carrying a row into one more, in compared rows.
ORDERINGS, CARRY = (2, 4, 8, 16), 4_000
RECALL = 0.95
#: Rows whose true neighbours are sought to choose the search (documented bound), and the bounds of a window.
SAMPLE, WINDOW_LEAST, WINDOW_MOST = 1_024, 2_048, 65_536
#: Rows of a range at least, rows compared with a window at once, rows of one broadcast.
ROWS_PER_PARTITION, ROWS_AT_ONCE, CHUNK = 24_000, 256, 8_192


def vector_from_text(text: Column | str, size: int) -> Column:
    """``size`` finite numbers written in any bracketed, comma-, semicolon- or blank-separated notation; else null."""
    col = F.col(text) if isinstance(text, str) else text
    body = F.regexp_replace(F.regexp_replace(col, r"(?i)dtype\s*=\s*[\w.']+|\b(array|list|tuple)\s*(?=[(\[])", " "), r"[\[\](){},;\s]+", " ")
    return let(F.split(F.trim(body), " "), lambda parts: _complete(F.transform(parts, lambda x: x.try_cast("double")), size))


def vector_from_columns(cols: list[str]) -> Column:
    """The columns as one vector; null where any is null or no finite number."""
    return _complete(F.array(*[F.col(c).cast("double") for c in cols]), len(cols))


def _complete(numbers: Column, size: int) -> Column:
    finite = lambda v: F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return let(numbers, lambda v: F.when((F.size(v) == size) & finite(v), F.transform(v, lambda x: x + 0.0)))


def hilbert_words(cells: np.ndarray, bits: int) -> list[np.ndarray]:
    """Index on the Hilbert curve of integer cells (rows x dims), its bits in words of ``WORD`` bits, highest first."""
    x = cells.astype(np.uint64).T.copy()
    dims = len(x)
    one = np.uint64(1)
    for level in range(bits - 1, 0, -1):
        bit, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for i in range(dims):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            if i:
                x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    fix = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        fix ^= np.where((x[-1] >> np.uint64(level)) & one == one, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= fix
    words: list[np.ndarray] = []
    for n, (level, i) in enumerate((level, i) for level in range(bits - 1, -1, -1) for i in range(dims)):
        if n % WORD == 0:
            words.append(np.zeros(x.shape[1], np.uint64))
        words[-1] = words[-1] << one | (x[i] >> np.uint64(level)) & one
    return [w.astype(np.int64) for w in words]


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The index of at most ``WORD`` bits as one integer."""
    (word,) = hilbert_words(cells, bits)
    return word


def pack(x: np.ndarray) -> list[bytes]:
    """Every row as bytes, without loss: two or four bytes a number where that holds it exactly, else eight."""
    made: list[bytes] = [b""] * len(x)
    left = np.arange(len(x))
    for kind, scale in ((np.int16, 1e4), (np.int32, 1e7)):
        scaled = np.rint(x[left] * scale)
        fits = ((np.abs(scaled) < np.iinfo(kind).max) & (scaled / scale == x[left])).all(1)
        for i, row in zip(left[fits], scaled[fits].astype(kind), strict=True):
            made[i] = row.tobytes()
        left = left[~fits]
    for i in left:
        made[i] = x[i].tobytes()
    return made


def unpack(column: pa.Array, size: int) -> np.ndarray:
    """The rows that ``pack`` made, as float64."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    width = np.diff(offsets) // max(size, 1)
    out = np.empty((len(column), size))
    for kind, scale in ((np.int16, 1e4), (np.int32, 1e7), (np.float64, 1.0)):
        rows = np.flatnonzero(width == np.dtype(kind).itemsize)
        if len(rows):
            at = offsets[rows][:, None] + np.arange(size * np.dtype(kind).itemsize)
            out[rows] = np.ascontiguousarray(data[at]).view(kind) / scale
    return out


@dataclass
class Curves:
    """Projections of all orderings; ``keys`` gives the words of the Hilbert index of rows in one of them."""

    mean: np.ndarray
    axes: list[np.ndarray]
    shifts: list[np.ndarray]
    scales: list[float]

    def keys(self, x: np.ndarray, o: int) -> list[np.ndarray]:
        y = (x - self.mean) @ self.axes[o] / self.scales[o]
        top = 1 << BITS
        cells = np.clip(np.floor((y / 8 + 0.5 + self.shifts[o]) * top), 0, top - 1)
        words = hilbert_words(cells, BITS)
        return [*words, *[np.zeros(len(x), np.int64)] * (2 - len(words))]

    def places(self, x: np.ndarray, ids: np.ndarray, o: int) -> np.ndarray:
        """Sortable keys of rows in ordering ``o``; rows of one cell are ordered by id."""
        parts = [*self.keys(x, o), ids ^ np.int64(-(2**63))]
        return np.ascontiguousarray(np.stack(parts, 1).astype(">i8")).view("S24").ravel()


def curves_of(n: int, total: np.ndarray, products: np.ndarray, orderings: int, seed: int) -> Curves:
    """Principal axes that hold 95 % of the variance, rotated at random for every ordering."""
    mean = total / n
    cov = products / n - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    by = np.argsort(-values)
    values, vectors = np.maximum(values[by], 0), vectors[:, by]
    dims = min(DIMS, len(mean))
    share = np.cumsum(values) / max(values.sum(), 1e-300)
    top = min(len(mean), max(dims, int(np.searchsorted(share, 0.95)) + 1))
    axes, shifts, scales = [], [], []
    for o in range(orderings):
        rng = np.random.default_rng([seed, o])
        a = vectors[:, :top] @ np.linalg.qr(rng.standard_normal((top, dims)))[0]
        axes.append(a)
        shifts.append(rng.uniform(-0.03, 0.03, dims))
        scales.append(float(np.sqrt(max(np.einsum("ij,ik,kj->j", a, cov, a).max(), 1e-24))))
    return Curves(mean, axes, shifts, scales)


def _moments(kept: DataFrame, size: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of all vectors, summed on the executors."""

    def make(b: pa.RecordBatch, total: np.ndarray) -> None:
        x = np.c_[np.ones(b.num_rows), unpack(b.column("p"), size)]
        total += x.T @ x

    m = matrix_sum(kept.select("p"), make, size + 1, size + 1)
    return int(m[0, 0]), m[0, 1:], m[1:, 1:]


def _sample_neighbours(kept: DataFrame, size: int, k: int, within: float | None, sample: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, vectors, place of each query, place of its neighbour) of a bounded sample compared with all rows."""
    drawn = kept.orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    ids, x = drawn.column("id").to_numpy(), unpack(drawn.column("p").combine_chunks(), size)
    shared = kept.sparkSession.sparkContext.broadcast((ids, x))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, v = shared.value
        kept_d, kept_id = np.full((len(own), k), np.inf), np.full((len(own), k), -1, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 4 * ROWS_AT_ONCE):
                b = whole.slice(lo, 4 * ROWS_AT_ONCE)
                y, other = unpack(b.column("p"), size), b.column("id").to_numpy()
                d = (v * v).sum(1)[:, None] + (y * y).sum(1) - 2 * v @ y.T
                d[own[:, None] == other] = np.inf
                d, other = np.concatenate([kept_d, d], 1), np.concatenate([kept_id, np.broadcast_to(other, d.shape)], 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                kept_d, kept_id = np.take_along_axis(d, near, 1), np.take_along_axis(other, near, 1)
        real = np.isfinite(kept_d)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(own, real.sum(1))), pa.array(kept_id[real]), pa.array(np.sqrt(np.maximum(kept_d[real], 0)))], ["id", "neighbour", "distance"])

    place = Window.partitionBy("id").orderBy("distance", "neighbour")
    pairs = kept.mapInArrow(compare, "id long, neighbour long, distance double").withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)
    if within is not None:
        pairs = pairs.where(F.col("distance") <= within)
    found = pairs.select("id", "neighbour").toArrow()
    shared.unpersist()
    query, other = found.column("id").to_numpy(), found.column("neighbour").to_numpy()
    further = np.setdiff1d(other, ids)
    if len(further):
        spark = kept.sparkSession
        wanted = spark.createDataFrame(pa.table({"id": further}))
        more = kept.join(F.broadcast(wanted), "id").toArrow()
        ids, x = np.r_[ids, more.column("id").to_numpy()], np.r_[x, unpack(more.column("p").combine_chunks(), size)]
    by = np.argsort(ids)
    ids, x = ids[by], x[by]
    return ids, x, np.searchsorted(ids, query), np.searchsorted(ids, other)


@dataclass
class Search:
    """The chosen search: orderings, places on either side, and the share of the sample's neighbours these find."""

    orderings: int
    window: int
    recall: float


def choose_search(kept: DataFrame, size: int, n: int, curves: Curves, k: int, within: float | None, recall: float, sample: int) -> Search:
    """The cheapest orderings and window that find ``recall`` of the neighbours of the sample.

    One pass counts the rows between the sample's rows and their neighbours in every ordering; its result has a fixed size.
    """
    if n <= WINDOW_LEAST + 1:
        return Search(1, n, 1.0)
    ids, x, query, other = _sample_neighbours(kept, size, k, within, sample)
    if not len(query):
        return Search(ORDERINGS[0], WINDOW_LEAST, 1.0)
    most = ORDERINGS[-1]
    places = [np.sort(curves.places(x, ids, o)) for o in range(most)]
    shared = kept.sparkSession.sparkContext.broadcast((curves, places))

    def make(b: pa.RecordBatch, total: np.ndarray) -> None:
        own, cuts = shared.value
        v, i = unpack(b.column("p"), size), b.column("id").to_numpy()
        for o in range(most):
            at = np.searchsorted(cuts[o], own.places(v, i, o), "right")
            total[o] += np.bincount(at, minlength=total.shape[1])

    counts = matrix_sum(kept, make, most, len(ids) + 1)
    shared.unpersist()
    apart = []
    for o in range(most):
        rank = np.cumsum(counts[o])[np.searchsorted(places[o], curves.places(x, ids, o))]
        apart.append(np.abs(rank[query] - rank[other]))
    found = []
    for m in ORDERINGS:
        least = np.minimum.reduce(apart[:m])
        window = max(WINDOW_LEAST, int(np.quantile(least, min(1.0, recall), method="higher")))
        found.append((m * (2 * window + CARRY), Search(m, window, float((least <= window).mean()))))
    return min(found, key=lambda s: (s[1].window > WINDOW_MOST, s[0]))[1]


RESULT = "id long, neighbour long, distance double, seam long, side int, w0 long, w1 long, ordering int, p binary"


def _pairs_batch(a: np.ndarray, b: np.ndarray, d: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(d), *[pa.nulls(len(a), f.type) for f in list(schema)[3:]]], schema=schema)


_SCHEMA = pa.schema([("id", pa.int64()), ("neighbour", pa.int64()), ("distance", pa.float64()), ("seam", pa.int64()), ("side", pa.int32()), ("w0", pa.int64()), ("w1", pa.int64()), ("ordering", pa.int32()), ("p", pa.binary())])


def _scan(size: int, window: int, k: int, within: float | None, parts: int):  # noqa: ANN202
    """The comparison of one sorted range: pairs, and the outermost rows on either side for the seams."""

    def seam_rows(t: pa.Table, seam: int, side: int) -> pa.RecordBatch:
        n = t.num_rows
        one = t.combine_chunks()
        cols = [one.column(c).chunk(0) if n else pa.array([], _SCHEMA.field(c).type) for c in ("id", "w0", "w1", "ordering", "p")]
        return pa.RecordBatch.from_arrays([cols[0], pa.nulls(n, pa.int64()), pa.nulls(n, pa.float64()), pa.array(np.full(n, seam, np.int64)), pa.array(np.full(n, side, np.int32)), *cols[1:4], cols[4]], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        ids, order, v = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, size))
        at, head, tail = 0, [], []
        for b in _ended(batches):
            if b is not None:
                if not b.num_rows:
                    continue
                ids, order = np.concatenate([ids, b.column("id").to_numpy()]), np.concatenate([order, b.column("ordering").to_numpy()])
                v = np.concatenate([v, unpack(b.column("p"), size)])
                if parts > 1:
                    if sum(x.num_rows for x in head) < window:
                        head.append(b.slice(0, window - sum(x.num_rows for x in head)))
                    tail.append(b)
                    while len(tail) > 1 and sum(x.num_rows for x in tail[1:]) >= window:
                        tail.pop(0)
            upto = len(ids) if b is None else max(at, len(ids) - window)
            lo = at
            while lo < upto:
                hi = min(upto, lo + ROWS_AT_ONCE)
                seg_lo, seg_hi = int(np.searchsorted(order, order[lo], "left")), int(np.searchsorted(order, order[lo], "right"))
                hi = min(hi, seg_hi)
                others = np.arange(max(seg_lo, lo - window), min(seg_hi, hi + window))
                yield _pairs_batch(*nearest_in_block(ids, v, np.arange(lo, hi), others, ids, v, k, within), _SCHEMA)
                lo = hi
            cut = max(0, upto - window)
            ids, order, v, at = ids[cut:], order[cut:], v[cut:], upto - cut
        if parts > 1 and head:
            first, last = pa.Table.from_batches(head), pa.Table.from_batches(tail)
            yield seam_rows(first, part - 1, 1)
            yield seam_rows(last.slice(max(0, last.num_rows - window)), part, 0)

    return run


def _seam(size: int, window: int, k: int, within: float | None):  # noqa: ANN202
    """The comparison across one border between ranges: at most ``window`` rows of either side."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        made = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        side, order = t.column("side").to_numpy(), t.column("ordering").to_numpy()
        ids, v = t.column("id").to_numpy(), unpack(t.column("p").combine_chunks(), size)
        w = [t.column(c).to_numpy() for c in ("w0", "w1")]
        by = np.lexsort((ids, w[1], w[0], order, side))
        side, order, ids, v = side[by], order[by], ids[by], v[by]
        parts = []
        for o in np.intersect1d(order[side == 0], order[side == 1]):
            left, right = np.flatnonzero((side == 0) & (order == o)), np.flatnonzero((side == 1) & (order == o))
            for lo in range(0, len(left), ROWS_AT_ONCE):
                own = left[lo : lo + ROWS_AT_ONCE]
                parts.append(nearest_in_block(ids, v, own, right[: max(0, window - (len(left) - 1 - lo - len(own) + 1))], ids, v, k, within))
            for lo in range(0, len(right), ROWS_AT_ONCE):
                own = right[lo : lo + ROWS_AT_ONCE]
                parts.append(nearest_in_block(ids, v, own, left[max(0, len(left) - (window - lo)) :] if window > lo else left[:0], ids, v, k, within))
        made = [np.concatenate(x) for x in zip(made, *parts, strict=True)] if parts else made
        return pa.table({"id": made[0], "neighbour": made[1], "distance": made[2]})

    return run


def _all_pairs(kept: DataFrame, size: int, n: int, k: int, within: float | None) -> DataFrame:
    """Every row against all rows: chunks of at most about ``CHUNK`` rows are broadcast, one pass over the rows for each."""
    chunks = -(-n // CHUNK)
    made = None
    for c in range(chunks):
        one = kept.where(F.pmod(F.xxhash64("id"), F.lit(chunks)) == c).orderBy("id").toArrow()
        shared = kept.sparkSession.sparkContext.broadcast((one.column("id").to_numpy(), unpack(one.column("p").combine_chunks(), size)))

        def compare(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, x = shared.value
            for b in batches:
                other, y = b.column("id").to_numpy(), unpack(b.column("p"), size)
                for lo in range(0, len(ids), ROWS_AT_ONCE):
                    a, o, d = nearest_in_block(ids, x, np.arange(lo, min(len(ids), lo + ROWS_AT_ONCE)), np.arange(len(other)), other, y, k, within)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(o), pa.array(d)], ["id", "neighbour", "distance"])

        part = materialise(_top(kept.mapInArrow(compare, "id long, neighbour long, distance double"), k))
        shared.destroy()
        made = part if made is None else made.union(part)
    return made


def _top(pairs: DataFrame, k: int) -> DataFrame:
    place = Window.partitionBy("id").orderBy("distance", "neighbour")
    merged = pairs.groupBy("id", "neighbour").agg(F.min("distance").alias("distance"))
    return merged.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, size: int, k: int = 5, within: float | None = None, recall: float = RECALL, sample: int = SAMPLE, seed: int = SEED) -> DataFrame:
    """(id, neighbour, distance, place): the k nearest others of every vector of ``vectors`` (id long, v array<double>).

    Null ids and null vectors take no part; repeated rows of one id count once. Equal distances are ordered by the smaller
    id. An empty table gives an empty result, a table of n <= k rows n - 1 neighbours for each. With ``within``, only
    neighbours at most so far away are sought and returned. ``recall`` is the share of the true neighbours that the search is
    chosen to find, as measured on ``sample`` rows; up to ``WINDOW_LEAST`` rows the result is exact.
    """

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            full = v.is_valid()
            x = v.filter(full).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            yield pa.RecordBatch.from_arrays([b.column("id").filter(full), pa.array(pack(x), pa.binary())], ["id", "p"])

    rows = vectors.where("id is not null").select(F.col("id").cast("long").alias("id"), "v").mapInArrow(packed, "id long, p binary")
    rows = materialise(rows.withColumn("h1", F.xxhash64("p")).withColumn("h2", F.xxhash64(F.lit(3), "p")))
    own = materialise(rows.groupBy("id").agg(F.min(F.struct("h1", "h2")).alias("h")).select("id", "h.h1", "h.h2"))
    copy = own.withColumn("copy", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("copy") <= k + 1)
    copies = materialise(copy.join(rows.groupBy("h1", "h2").agg(F.first("p").alias("p")), ["h1", "h2"]))
    kept = spread(copies.select("id", "p"))
    n, total, products = _moments(kept, size)
    if not n:
        return kept.select("id", F.col("id").alias("neighbour"), F.lit(0.0).alias("distance"), F.lit(1).alias("place"))
    curves = curves_of(n, total, products, ORDERINGS[-1], seed)
    search = choose_search(kept, size, n, curves, k, within, recall, sample)
    if search.window > WINDOW_MOST:
        ranked = _all_pairs(kept, size, n, k, within)
    else:
        ranked = _by_curves(kept, size, n, curves, search, k, within)
    firsts = copies.where(F.col("copy") <= k).select("h1", "h2", F.col("id").alias("neighbour"), F.col("copy").alias("place"))
    full = copies.where(F.col("copy") == k + 1).select("h1", "h2", F.col("id").alias("last"))
    further = own.join(full, ["h1", "h2"]).where("id > last").select("id", "h1", "h2").join(firsts, ["h1", "h2"]).select("id", "neighbour", F.lit(0.0).alias("distance"), "place")
    return ranked.select("id", "neighbour", "distance", "place").unionByName(further)


def _by_curves(kept: DataFrame, size: int, n: int, curves: Curves, search: Search, k: int, within: float | None) -> DataFrame:
    shared = kept.sparkSession.sparkContext.broadcast(curves)
    names = ["ordering", "w0", "w1", "id", "p"]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = unpack(b.column("p"), size)
            for o in range(search.orderings):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, o, np.int32)), *[pa.array(w) for w in shared.value.keys(x, o)], b.column("id"), b.column("p")], names)

    parts = max(1, n * search.orderings // max(ROWS_PER_PARTITION, 4 * search.window))
    placed = kept.select("id", "p").mapInArrow(keyed, "ordering int, w0 long, w1 long, id long, p binary")
    placed = placed.repartitionByRange(parts, *names[:4]) if parts > 1 else placed.coalesce(1)
    found = placed.sortWithinPartitions(*names[:4]).mapInArrow(_scan(size, search.window, k, within, parts), RESULT)
    pairs = ["id", "neighbour", "distance"]
    if parts == 1:
        return _top(found.select(*pairs), k)
    found = materialise(found)
    across = found.where("seam is not null").select("seam", "side", "ordering", "w0", "w1", "id", "p").groupBy("seam").applyInArrow(_seam(size, search.window, k, within), "id long, neighbour long, distance double")
    return _top(found.where("seam is null").select(*pairs).union(across), k)


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def near_pairs(vectors: DataFrame, size: int, within: float, k: int = 5, recall: float = 0.9995, **options: int) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs in which one is among the k nearest of the other and that are at most ``within`` apart."""
    found = nearest(vectors, size, k, within=within, recall=recall, **options).where(F.col("distance") <= within)
    return found.select(F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")).distinct()
