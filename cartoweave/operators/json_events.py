"""JSON of a whole Arrow batch as arrays of values, without a parser call or a tree per record.

The bytes of all records are scanned at once: quotes and escapes, then marks and plain values outside of strings, then the
depth of each token and the container that holds it, then the grammar by pairs of neighbouring tokens within a container.
Records that are no JSON (cut off, unbalanced, stray tokens, bad numbers or escapes) give no value.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

OBJECT, LIST, STRING, PLAIN, NULL = range(5)
#: Token types of the grammar: begin of a container, string, other value, colon, comma, end of a container.
_START, _STRING, _VALUE, _COLON, _COMMA, _END = range(6)
_NUMBER = re.compile(r"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?|true|false|null|NaN|-?Infinity")


def _lookup(marks: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(marks)] = True
    return table


_MARKS, _BLANKS = _lookup(b"{}[]:,"), _lookup(b" \t\n\r")


@dataclass
class Values:
    """The values of a batch in the order of their bytes.

    ``row``: record; ``parent``: value of the container that holds it, -1 at the top; ``name``: number of its name in
    ``names`` within an object, else -1; ``place``: its place within a list, else -1; ``text``: of strings and plain values.
    """

    row: np.ndarray
    parent: np.ndarray
    name: np.ndarray
    place: np.ndarray
    kind: np.ndarray
    text: pa.Array
    names: list[str]


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of the texts in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _spans(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """The texts of the spans [start, end)."""
    size = end - start
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[at]))).cast(pa.string())


def _each(texts: pa.Array, make) -> tuple[pa.Array, np.ndarray]:  # noqa: ANN001
    """``make`` of every distinct text (None where it is no JSON), and which are JSON."""
    coded = texts.dictionary_encode()
    made, good = [], []
    for x in coded.dictionary.to_pylist():
        try:
            made.append(make(x))
            good.append(True)
        except ValueError:
            made.append(None)
            good.append(False)
    return pa.array(made, pa.string()).take(coded.indices), np.array(good, bool)[coded.indices.to_numpy()] if len(texts) else np.zeros(0, bool)


def _unescaped(body: str) -> str:
    return json.loads(f'"{body}"').encode("utf-8", "replace").decode()


def _plain(text: str) -> str | None:
    if not _NUMBER.fullmatch(text):
        raise ValueError(text)
    if text.isdigit() or text in ("true", "false"):
        return text
    return None if text == "null" else json.dumps(json.loads(text))


def _lex(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, end, mark, row) of the tokens and which rows have strings that end; strings without their quotes."""
    rows = len(offsets) - 1
    index = np.arange(len(raw))
    solid = np.maximum.accumulate(np.where(raw != 0x5C, index, -1))
    quote = np.flatnonzero(raw == 0x22)
    row = np.searchsorted(offsets, quote, "right") - 1
    before = np.where(quote > 0, solid[quote - 1], -1)
    escaped = (quote - 1 - np.maximum(before, offsets[row] - 1)) % 2 == 1
    quote, row = quote[~escaped], row[~escaped]
    even = np.bincount(row, minlength=rows) % 2 == 0
    quote = quote[even[row]]
    opened, closed = quote[0::2], quote[1::2]
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[opened] = 1
    inside[closed + 1] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8) > 0
    good = even.copy()
    good[np.searchsorted(offsets, np.flatnonzero(inside & (raw < 0x20)), "right") - 1] = False
    mark = ~inside & _MARKS[raw]
    plain = ~inside & ~mark & ~_BLANKS[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    first = np.flatnonzero(plain & (np.r_[True, ~plain[:-1]] | edge[:-1]))
    last = np.flatnonzero(plain & (np.r_[~plain[1:], True] | edge[1:])) + 1
    marks = np.flatnonzero(mark)
    start, end = np.concatenate([marks, opened + 1, first]), np.concatenate([marks + 1, closed, last])
    kind = np.concatenate([raw[marks], np.full(len(opened), 0x22, np.uint8), np.full(len(first), 0x30, np.uint8)])
    by = np.argsort(start - (kind == 0x22), kind="stable")
    start, end, kind = start[by], end[by], kind[by]
    return start, end, kind, np.searchsorted(offsets, start - (kind == 0x22), "right") - 1, good


def _holders(depth: np.ndarray, after: np.ndarray, opening: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token that opens the container which holds each token (-1 at the top), and all tokens grouped by it.

    Tokens are sorted by depth, stably: what lies between two openings of one depth belongs to the first of them.
    """
    opened, held = np.flatnonzero(opening), np.flatnonzero(depth > 0)
    token = np.concatenate([opened, held])
    merged = np.argsort(token, kind="stable")
    token, source = token[merged], merged < len(opened)
    level = np.where(source, after[token], depth[token])
    by = np.argsort(level.astype(np.uint16) if len(level) and level.max() < 1 << 16 else level, kind="stable")
    token, source = token[by], source[by]
    at = np.maximum.accumulate(np.where(source, np.arange(len(by)), 0))
    holder = np.full(len(depth), -1)
    holder[token[~source]] = token[at[~source]]
    return holder, np.concatenate([np.flatnonzero(depth == 0), token[~source]])


def parse(column: pa.Array) -> Values:
    """The values of all records of ``column`` (strings); null and blank records and such that are no JSON have none."""
    data, bounds = _bytes(pc.fill_null(column, ""))
    rows = len(column)
    start, end, mark, row, good = _lex(data, bounds)
    change = np.isin(mark, (0x7B, 0x5B)).astype(np.int64) - np.isin(mark, (0x7D, 0x5D))
    after = np.cumsum(change)
    many = np.bincount(row, minlength=rows)
    heads = np.cumsum(many) - many
    after = after - np.r_[0, after][heads][row]
    some = np.flatnonzero(many)
    good &= many > 0
    good[row[after < 0]] = False
    good[some[after[heads[some] + many[some] - 1] != 0]] = False
    fine = good[row]  # tokens of records that are not balanced leave before the others are judged
    start, end, mark, row, change, after = (x[fine] for x in (start, end, mark, row, change, after))
    opening, closing = change > 0, change < 0
    depth = after - np.where(opening, 1, 0) + np.where(closing, 1, 0)
    holder, by = _holders(depth, after, opening)
    kind = np.select([mark == 0x22, mark == 0x3A, mark == 0x2C, closing], [_STRING, _COLON, _COMMA, _END], _VALUE)
    in_object = np.where(holder >= 0, mark[holder], 0) == 0x7B
    held, sorted_kind = np.where(holder < 0, -1 - row, holder)[by], kind[by]
    fresh = np.r_[True, held[1:] != held[:-1]][: len(by)]
    previous = np.where(fresh, _START, np.r_[0, sorted_kind[:-1]][: len(by)])
    earlier = np.where(fresh, _START, np.r_[0, previous[:-1]][: len(by)])
    value = (sorted_kind == _STRING) | (sorted_kind == _VALUE)
    was_value, begin = (previous == _STRING) | (previous == _VALUE), (previous == _START) | (previous == _COMMA)
    object_ok = np.select(
        [value, sorted_kind == _COLON, sorted_kind == _COMMA],
        [(previous == _COLON) | ((sorted_kind == _STRING) & begin), (previous == _STRING) & ((earlier == _START) | (earlier == _COMMA)), was_value & (earlier == _COLON)],
        (previous == _START) | (was_value & (earlier == _COLON)),
    )
    list_ok = np.select([value, sorted_kind == _COLON, sorted_kind == _COMMA], [begin, np.zeros(len(by), bool), was_value], previous != _COMMA)
    top_ok = value & (previous == _START)
    ok = np.where(held < 0, top_ok, np.where(in_object[by], object_ok, list_ok))
    ok &= ~closing[by] | (mark[by] == np.where(mark[holder[by]] == 0x7B, 0x7D, 0x5D))
    good[row[by[~ok]]] = False
    is_name = value & in_object[by] & (previous != _COLON)
    texts = pa.array([None] * len(mark), pa.string()) if not len(mark) else _texts(data, start, end, mark, row, good)
    token = np.sort(by[value & ~is_name & good[row[by]]])
    number = np.full(len(mark), -1)
    number[token] = np.arange(len(token))
    spot = np.empty(len(by), np.int64)
    spot[by] = np.arange(len(by))
    rank = np.cumsum(value) - 1  # values of one list follow each other in the sorted order
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(by)), 0)) if len(by) else np.zeros(0, np.int64)
    place = rank - (rank[first] - value[first]) - 1 if len(by) else rank
    names = texts.take(pa.array(by[np.maximum(spot[token] - 2, 0)])).dictionary_encode() if len(token) else pa.array([], pa.string()).dictionary_encode()
    member = in_object[token]
    of = np.where(mark[token] == 0x7B, OBJECT, np.where(mark[token] == 0x5B, LIST, np.where(mark[token] == 0x22, STRING, PLAIN)))
    own = texts.take(pa.array(token))
    of[(of == PLAIN) & ~np.array(own.is_valid(), bool)] = NULL
    return Values(row[token], np.where(holder[token] >= 0, number[holder[token]], -1), np.where(member, np.array(names.indices.fill_null(0), np.int64), -1), np.where(member | (holder[token] < 0), -1, place[spot[token]]), of, own, names.dictionary.to_pylist())


def _texts(data: np.ndarray, start: np.ndarray, end: np.ndarray, mark: np.ndarray, row: np.ndarray, good: np.ndarray) -> pa.Array:
    """The text of every string and plain token, null for others; rows with a bad one are no longer ``good``."""
    texted = np.flatnonzero((mark == 0x22) | (mark == 0x30))
    found = _spans(data, start[texted], end[texted])
    plain = mark[texted] == 0x30
    escaped = ~plain & np.array(pc.match_substring(found, "\\"), bool)
    for chosen, make in ((plain, _plain), (escaped, _unescaped)):
        if chosen.any():
            made, fine = _each(found.filter(pa.array(chosen)), make)
            good[row[texted[chosen][~fine]]] = False
            found = pc.replace_with_mask(found, pa.array(chosen), made)
    where = np.full(len(mark), -1)
    where[texted] = np.arange(len(texted))
    return found.take(pa.array(where, mask=where < 0))
