"""Words of a batch of texts as numpy arrays: no call per row or per word.

A word is a longest run of letters (with marks inside it); an apostrophe between letters belongs to it. Blank-separated
chunks that are mentions, tags, links or escaped marks can be left out. Everything is found by table lookups on the
code-point array of the whole batch.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cartoweave.llm.canonical import TABLE_SIZE, _code_points, bounded, canonical_array

MULT = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(1099511628211)


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    letter = np.zeros(TABLE_SIZE, bool)
    lower = np.arange(TABLE_SIZE, dtype=np.uint32)
    for cp in (*range(0x3400), *range(0xA000, 0xD800), *range(0xF900, 0x20000)):
        c = chr(cp)
        letter[cp] = c.isalpha() or 0x300 <= cp <= 0x36F
        low = c.lower()
        if len(low) == 1:
            lower[cp] = ord(low)
    letter[0x3400:0xA000] = True
    letter[0x20000:0x32000] = True
    return letter, lower


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit."""
    h = h.astype(np.uint64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """Words of a batch: row of each, [start, end) in ``cps`` (lower-cased code points), a 64-bit key, a break before it."""

    cps: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    key: np.ndarray
    brk: np.ndarray
    rows: int

    def text(self, i: int) -> str:
        return self.cps[self.start[i] : self.end[i]].astype("<u4").tobytes().decode("utf-32-le")

    def take(self, keep: np.ndarray) -> Words:
        brk = self.brk
        if not keep.all():  # a break before a dropped word moves to the next kept one
            upto = np.cumsum(brk)
            kept = np.flatnonzero(keep)
            before = np.r_[0, upto[kept[:-1]]] if len(kept) else kept
            brk_kept = upto[kept] > before
        else:
            brk_kept = brk
        return Words(self.cps, self.row[keep], self.start[keep], self.end[keep], self.key[keep], brk_kept, self.rows)


def words_of(texts: pa.Array, skip_marked: bool = True, line_break: bool = True) -> Words:
    """The words of canonicalised ``texts``; null and empty texts have none.

    ``skip_marked`` leaves out chunks that hold ``@``, ``#``, ``://``, are escaped marks such as ``&amp;`` or stand in angle
    brackets (speakers, tags), and "RT" as the first word.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if line_break:
        texts = pc.replace_substring(texts.cast(pa.string()), "\n", " | ")
    form = canonical_array(texts)
    n = len(form)
    letter, lower = _tables()
    raw, offsets = _code_points(pc.fill_null(form, ""))
    owner = np.repeat(np.arange(n), np.diff(offsets))
    empty = np.zeros(0, np.int64)
    if not len(raw):
        return Words(raw, empty, empty, empty, empty.astype(np.uint64), empty.astype(bool), n)
    blank = raw == 0x20
    edge = np.r_[True, (owner[1:] != owner[:-1])]
    chunk = np.cumsum(blank | edge) - 1
    is_letter = letter[raw]
    apostrophe = (raw == 0x27) | (raw == 0x2019)
    inner = np.zeros(len(raw), bool)
    inner[1:-1] = apostrophe[1:-1] & is_letter[:-2] & is_letter[2:] & (owner[1:-1] == owner[:-2]) & (owner[1:-1] == owner[2:])
    if skip_marked:
        marked = (raw == 0x40) | (raw == 0x23)
        marked[:-2] |= (raw[:-2] == 0x3A) & (raw[1:-1] == 0x2F) & (raw[2:] == 0x2F)
        bad = np.zeros(chunk[-1] + 1, bool)
        bad[chunk[marked]] = True
        amp, semi = np.zeros_like(bad), np.zeros_like(bad)
        amp[chunk[raw == 0x26]] = True
        semi[chunk[raw == 0x3B]] = True
        bad |= amp & semi
        opened, closed = np.zeros_like(bad), np.zeros_like(bad)
        opened[chunk[raw == 0x3C]] = True
        closed[chunk[raw == 0x3E]] = True
        bad |= opened & closed
        is_letter = is_letter & ~bad[chunk]
        inner &= ~bad[chunk]
    inside = is_letter | inner
    starts = np.flatnonzero(inside & (np.r_[True, ~inside[:-1]] | edge))
    if not len(starts):
        return Words(raw, empty, empty, empty, empty.astype(np.uint64), empty.astype(bool), n)
    ends = np.flatnonzero(inside & np.r_[~inside[1:] | edge[1:], True]) + 1
    cps = lower[raw]
    lead = np.zeros(starts[0], np.int64)
    pos = np.r_[lead, np.arange(starts[0], len(cps)) - np.repeat(starts, np.diff(np.r_[starts, len(cps)]))]
    term = mix(cps.astype(np.uint64) * MULT + (pos.astype(np.uint64) + np.uint64(1)) * STEP)
    term[~inside] = 0
    sums = np.zeros(len(cps) + 1, np.uint64)
    np.cumsum(term, out=sums[1:])
    key = mix(sums[ends] - sums[starts] + (ends - starts).astype(np.uint64))
    row = owner[starts]
    seps = np.isin(raw, [0x2D, 0x2F, 0x7C, 0x2E, 0x3A, 0x3B, 0x21, 0x3F, 0x2026, 0x2013, 0x2014])
    upto = np.cumsum(seps & ~inside)
    brk = np.r_[True, (upto[starts[1:]] > upto[starts[:-1]]) | (row[1:] != row[:-1])]
    found = Words(cps, row, starts, ends, key, brk, n)
    if skip_marked:  # the mark of a repeated message, "RT" as the first word
        first = np.r_[True, row[1:] != row[:-1]]
        mark = first & (ends - starts == 2) & (cps[starts] == 0x72) & (cps[np.minimum(starts + 1, len(cps) - 1)] == 0x74)
        if mark.any():
            return found.take(~mark)
    return found


def words_of_many(texts: pa.Array) -> Words:
    """``words_of`` for texts of any total size: slice by slice, keeping the code points of the words only."""
    parts, rows, at = [], 0, 0
    for b in bounded([pa.RecordBatch.from_arrays([texts], ["text"])]):
        w = words_of(b.column("text"))
        size = w.end - w.start
        first = np.cumsum(size) - size
        cps = w.cps[np.repeat(w.start - first, size) + np.arange(size.sum())]
        parts.append((cps, w.row + rows, first + at, first + size + at, w.key, w.brk))
        rows, at = rows + b.num_rows, at + len(cps)
    if not parts:
        return words_of(texts)
    return Words(*[np.concatenate(x) for x in zip(*parts, strict=True)], rows)
