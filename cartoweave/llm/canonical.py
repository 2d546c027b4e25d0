"""One consistent character form for texts that look the same (problem 2).

The work is done on whole Arrow batches: the UTF-8 buffer becomes one numpy array of code points, a lookup table turns
every code point into its look-alike expansion (offsets into one expansion array), canonical ordering and composition of
the marks run as array passes over all texts of the batch at once. No string call is made per row.

Rules, in this order, for every code point:

* what cannot be seen is removed (format characters, variation selectors, fillers, joiners);
* every blank (space separators, tabs, line ends) becomes one U+0020, so the number and order of blanks stay;
* compatibility forms that read the same (width, font, ligature, no-break, presentation forms) are expanded; superscripts,
  fractions and circled forms look different and stay;
* look-alike letters of other alphabets become the Latin letter of the same shape and case: a fixed list, and in the queries
  over tables the Unicode confusables of all alphabets with two cases; digits are never mapped to or from letters;
* marks are ordered and composed canonically.

Null stays null and an empty text stays empty; a text of invisible characters only becomes the empty text. Bytes that are
no UTF-8 become U+FFFD. The length of a text is not limited other than by Arrow's batch (2 GB).
"""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoweave.session import materialise

# Letters of the same shape, as "foreign letters" -> "Latin letters", position by position.
LOOKALIKES = (
    ("АВЕЅІЈКМНОРСТУХҮԌԚԜӀѴԁһԛԝаеорсухѕіјӏѵ", "ABESIJKMHOPCTYXYGQWIVdhqwaeopcyxsijlv"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿονϲϳ", "ABEZHIKMNOPTYXCJovcj"),  # Greek
    ("ՕՏԼօսո", "OSLoun"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏞᏟᏢᏦᏚᏙ", "DRTAJEWMHGZLCPKSV"),  # Cherokee
    ("ɡ", "g"),  # Latin letter of another block
)
#: Marks of the same shape.
LOOKALIKE_MARKS = {0x2010: 0x2D, 0x2011: 0x2D, 0x02BC: 0x2019, 0x2024: 0x2E}
#: Compatibility decompositions that keep the look; the others (super, sub, circle, fraction, square, vertical) do not.
SAME_LOOK = {"", "<compat>", "<wide>", "<narrow>", "<font>", "<noBreak>", "<small>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: Compatibility forms that nevertheless look different from their decomposition.
OWN_LOOK = {0x017F, 0x1E9B}
INVISIBLE_RANGES = ((0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0xE0000, 0xE0FFF))
BLANK_CONTROLS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85, 0x2028, 0x2029}
TABLE_SIZE = 0x110000
#: Bytes of text that are turned into arrays at once.
SLICE_BYTES = 1 << 20
HANGUL = (0x1100, 19, 0x1161, 21, 0x11A7, 28, 0xAC00)


def _blank(cp: int) -> bool:
    return cp in BLANK_CONTROLS or unicodedata.category(chr(cp)) == "Zs"


def _invisible(cp: int) -> bool:
    return any(a <= cp <= b for a, b in INVISIBLE_RANGES) or unicodedata.category(chr(cp)) == "Cf"


def _expand(cp: int, latin: dict[int, int]) -> list[int]:
    """The expansion of one code point; called only while the table is built."""
    if _blank(cp):
        return [0x20]
    if _invisible(cp):
        return []
    made = unicodedata.decomposition(chr(cp))
    if made and cp not in OWN_LOOK:
        kind, _, rest = made.rpartition("> ")
        parts = [int(x, 16) for x in rest.split()]
        spaced = parts[0] == 0x20 and len(parts) > 1
        if (f"{kind}>" if kind else "") in SAME_LOOK and not spaced:
            return [y for x in parts for y in _expand(x, latin)]
    return [latin.get(cp, LOOKALIKE_MARKS.get(cp, cp))]


#: Alphabets with two cases whose letters are sought among the public look-alikes: first and last code points.
CASED_RANGES = ((0x370, 0x588), (0x10A0, 0x10FF), (0x13A0, 0x13FD), (0x1C80, 0x1CBF), (0x1F00, 0x1FFF), (0x2C00, 0x2DFF), (0xA640, 0xA69F), (0xAB70, 0xABBF), (0x10400, 0x104FF), (0x118A0, 0x118FF), (0x16E40, 0x16E7F))


def _skeletons(ask) -> tuple[tuple[int, int], ...]:  # noqa: ANN001
    ascii_letters = [chr(c) for c in range(0x41, 0x7B) if chr(c).isalpha()]
    cased = [chr(c) for a, b in CASED_RANGES for c in range(a, b + 1) if unicodedata.category(chr(c)) in ("Lu", "Ll")]
    looks = ask("\n".join([*ascii_letters, *cased])).split("\n")
    own: dict[tuple[str, str], str] = {}
    for letter, look in zip(ascii_letters, looks, strict=False):
        own.setdefault((look, unicodedata.category(letter)), letter)
    found = ((c, own.get((look, unicodedata.category(c)))) for c, look in zip(cased, looks[len(ascii_letters) :], strict=True))
    return tuple((ord(c), ord(letter)) for c, letter in found if letter)


def public_lookalikes(spark: SparkSession) -> tuple[tuple[int, int], ...]:
    """(foreign letter, Latin letter): letters of other cased alphabets with the look and the case of an ASCII letter.

    Taken from the Unicode confusables, which the JVM's text library holds; ``LOOKALIKES`` goes before them.
    """
    return _skeletons(spark._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton)


@functools.cache
def tables(lookalikes: tuple[tuple[int, int], ...] = ()) -> dict[str, np.ndarray]:
    """Lookup tables by code point, built once in each Python worker from the Unicode database."""
    latin = dict(lookalikes) | {ord(a): ord(b) for foreign, own in LOOKALIKES for a, b in zip(foreign, own, strict=True)}
    length = np.ones(TABLE_SIZE, np.int64)
    first = np.arange(TABLE_SIZE, dtype=np.uint32)
    start = np.zeros(TABLE_SIZE, np.int64)
    rank = np.zeros(TABLE_SIZE, np.uint8)
    more: list[int] = []
    composed: dict[int, int] = {}
    ranges = [(0, 0x3400), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE1000)]
    for cp in (c for a, b in ranges for c in range(a, b)):
        rank[cp] = unicodedata.combining(chr(cp))
        x = _expand(cp, latin)
        length[cp] = len(x)
        if len(x) > 1:
            start[cp] = len(more)
            more += x
        elif x:
            first[cp] = x[0]
        made = unicodedata.decomposition(chr(cp))
        if made and "<" not in made and len(parts := made.split()) == 2 and unicodedata.normalize("NFC", chr(cp)) == chr(cp):
            composed[int(parts[0], 16) << 21 | int(parts[1], 16)] = cp
    keys = np.array(sorted(composed), np.int64)
    return {"length": length, "first": first, "start": start, "rank": rank, "more": np.array(more, np.uint32), "keys": keys, "made": np.array([composed[int(k)] for k in keys], np.uint32), "plain": _plain(length, first)}


def _plain(length: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Code points that stay as they are next to any other one without a combining rank."""
    plain = (length == 1) & (first == np.arange(TABLE_SIZE))
    plain[HANGUL[2] : HANGUL[4] + HANGUL[5]] = False
    return plain


def _compose_runs(cps: np.ndarray, owner: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Canonical order and composition of marks for all texts at once; owner is the row of each code point."""
    rank = t["rank"][cps]
    marks = rank > 0
    if marks.any():
        starts = np.flatnonzero(marks & np.r_[True, ~marks[:-1] | (owner[1:] != owner[:-1])])
        run_of = np.cumsum(np.isin(np.arange(len(cps)), starts)) - 1
        at = np.flatnonzero(marks)
        order = np.lexsort((at, rank[at], run_of[at]))
        cps = cps.copy()
        cps[at] = cps[at][order]
        rank[at] = rank[at][order]
        sizes = np.bincount(run_of[at], minlength=len(starts))
        base = starts - 1
        usable = (base >= 0) & (owner[np.maximum(base, 0)] == owner[starts])
        blocked = np.zeros(len(starts), np.uint8)
        keep = np.ones(len(cps), bool)
        for k in range(int(sizes.max())):
            runs = np.flatnonzero(usable & (sizes > k))
            if not len(runs):
                break
            mark = starts[runs] + k
            key = cps[base[runs]].astype(np.int64) << 21 | cps[mark]
            spot = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
            fits = (t["keys"][spot] == key) & (blocked[runs] < rank[mark])
            cps[base[runs[fits]]] = t["made"][spot[fits]]
            keep[mark[fits]] = False
            left = runs[~fits]
            blocked[left] = np.maximum(blocked[left], rank[mark[~fits]])
        cps, owner = cps[keep], owner[keep]
    lead, leads, vowel, vowels, tail, tails, block = HANGUL
    for first_at, n_first, second_at, n_second in ((lead, leads, vowel, vowels), (block, leads * vowels * tails, tail + 1, tails - 1)):
        a, b = cps[:-1].astype(np.int64) - first_at, cps[1:].astype(np.int64) - second_at
        hit = (a >= 0) & (a < n_first) & (b >= 0) & (b < n_second) & (owner[1:] == owner[:-1])
        if first_at == block:
            hit &= a % tails == 0
        if hit.any():
            at = np.flatnonzero(hit)
            cps = cps.copy()
            cps[at] = block + (a[at] * vowels + b[at]) * tails if first_at == lead else block + a[at] + b[at] + 1
            keep = np.ones(len(cps), bool)
            keep[at + 1] = False
            cps, owner = cps[keep], owner[keep]
    return cps, owner


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offset of each text in them."""
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    try:
        text = raw.tobytes().decode("utf-8")
    except UnicodeDecodeError:
        fixed = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1] - offsets[0], offsets[1:] - offsets[0], strict=True)]
        return np.frombuffer("".join(fixed).encode("utf-32-le"), np.uint32), np.cumsum([0, *map(len, fixed)])
    counted = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=counted[1:])
    return np.frombuffer(text.encode("utf-32-le"), np.uint32), counted[offsets - offsets[0]]


def bounded(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices whose texts have about ``most`` bytes; a longer text is a slice of its own.

    The array passes take some dozens of bytes per character, so the size of a slice bounds the memory of a task.
    """
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if b.num_rows else []
        lo = 0
        while lo < b.num_rows:
            done = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, done + most, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def canonical_array(column: pa.Array | pa.ChunkedArray, lookalikes: tuple[tuple[int, int], ...] = ()) -> pa.Array:
    """The texts of ``column`` in the canonical form, as an Arrow string array of the same length.

    ``lookalikes``: pairs of code points besides the fixed ones, such as ``public_lookalikes``.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return pa.array([], pa.string())
    t = tables(lookalikes)
    cps, offsets = _code_points(column)
    if not len(cps) or (t["plain"][cps].all() and not t["rank"][cps].any() and not (cps == 0xFFFD).any()):
        return column.cast(pa.string())
    owner = np.repeat(np.arange(n), np.diff(offsets))
    sizes = t["length"][cps]
    out = np.repeat(t["first"][cps], sizes)
    if (sizes > 1).any():
        ends = np.cumsum(sizes)
        wide = np.flatnonzero(sizes > 1)
        within = np.arange(sizes[wide].sum()) - np.repeat(np.cumsum(sizes[wide]) - sizes[wide], sizes[wide])
        out[np.repeat(ends[wide] - sizes[wide], sizes[wide]) + within] = t["more"][np.repeat(t["start"][cps[wide]], sizes[wide]) + within]
    owner = np.repeat(owner, sizes)
    out, owner = _compose_runs(out, owner, t)
    widths = 1 + (out > 0x7F) + (out > 0x7FF) + (out > 0xFFFF)
    ends = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(owner, weights=widths, minlength=n).astype(np.int64), out=ends[1:])
    data = out.astype("<u4").tobytes().decode("utf-32-le").encode("utf-8")
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(ends), pa.py_buffer(data))
    if column.null_count:
        made = pc.if_else(column.is_valid(), made, pa.scalar(None, pa.large_string()))
    return made.cast(pa.string())


def canonical(column: Column | str, lookalikes: tuple[tuple[int, int], ...] = ()) -> Column:
    """Column expression: the canonical form of a string column."""

    @F.arrow_udf(T.StringType())
    def form(texts: pa.Array) -> pa.Array:
        return canonical_array(texts, lookalikes)

    return form(column)


def canonical_keys(df: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, k1, k2, v, *keep): 128 bits that stand for the canonical form, 64 for the form as stored.

    Null ids and null texts give no row. One pass over the two columns; only keys leave it. Look-alike letters are those of
    the fixed list and of the Unicode confusables.
    """
    lookalikes = public_lookalikes(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *keep).where("id is not null and text is not null")
    fields = [*rows.schema.fields, T.StructField("form", T.StringType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in bounded(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, canonical_array(b.column("text"), lookalikes)], [*b.schema.names, "form"])

    made = rows.mapInArrow(run, T.StructType(fields))
    return made.select("id", F.xxhash64("form").alias("k1"), F.xxhash64(F.lit(7), "form", F.length("form")).alias("k2"), F.xxhash64("text").alias("v"), *keep)


#: Records of one form that one task pairs with all records of the form.
FORM_ROWS = 2_000


def _spelled_apart(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, v, n): the records of forms that are stored in more than one spelling, with their number in the form.

    Forms stored in a single spelling never reach a join: a pre-aggregated pass finds the others first.
    """
    keys = materialise(canonical_keys(df, id_col, text_col))
    mixed = keys.groupBy("k1", "k2").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("k1", "k2", "n")
    return materialise(keys.join(mixed, ["k1", "k2"]).select("id", "k1", "k2", "v", "n").distinct())


def same_look_classes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, form, spelling): a row for each record whose text reads the same as another one stored in different characters.

    ``form`` is the smallest id of those that read the same, ``spelling`` the smallest id stored in the same characters. Two
    records with one form and two spellings are a pair of ``same_look_pairs``; this result stays linear in the records.
    """
    rows = _spelled_apart(df, id_col, text_col)
    spellings = rows.groupBy("k1", "k2", "v").agg(F.min("id").alias("spelling"))
    forms = rows.groupBy("k1", "k2").agg(F.min("id").alias("form"))
    return rows.join(spellings, ["k1", "k2", "v"]).join(forms, ["k1", "k2"]).select("id", "form", "spelling").distinct()


def same_look_pairs(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records whose text reads the same but is stored in different characters.

    The result itself is quadratic in the records of one form (``same_look_classes`` is not). Records of a form that many
    share are salted: each task pairs at most about ``FORM_ROWS`` of them with the others. Records of one spelling are never
    paired.
    """
    rows = _spelled_apart(df, id_col, text_col)
    a, b = (rows.select(F.col("id").alias(f"id_{s}"), F.col("v").alias(f"v_{s}"), "k1", "k2", F.ceil(F.col("n") / FORM_ROWS).cast("int").alias("salts")) for s in "ab")
    a = a.withColumn("salt", F.pmod(F.xxhash64("id_a"), "salts").cast("int")).drop("salts")
    b = b.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return a.join(b, ["k1", "k2", "salt"]).where("id_a < id_b and v_a <> v_b").select("id_a", "id_b").distinct()
