"""Deeply nested records to related flat tables (problem 6).

Records are parsed a batch at a time (``json_events``) into triples: the path of a value (``[]`` for a place in a list,
``{}`` for a name in a map), the value, and the places and names that lead to it (its ordinals). Paths are grouped by their
last repeated ancestor; each group becomes one table whose rows are the instances of the ancestor and whose columns are the
paths below it. All of a record's triples arise in one task, so they are pivoted there and nothing is shuffled. The ordinals
of a row start with the ordinals of its parent row, which keeps the parent-child links.

Which groups there are is found, not only declared: ``path_counts`` reports every path with its ancestor and whether a table
of the layout holds it, and ``found_layout`` makes a table of every group.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartoweave.operators.json_events import LIST, NULL, OBJECT, PLAIN, STRING, Values, parse

Triple = tuple[str, tuple[str, ...], str | None]
#: Bytes of records that are parsed at once; a longer record is parsed by itself.
SLICE_BYTES = 1 << 20
#: Paths up to which a layout is made from the data; names that are data belong into ``maps``.
MOST_PATHS = 10_000


@dataclass(frozen=True)
class Layout:
    """What is repeated in the records.

    ``lists``: paths that hold lists; an object or a lone text standing there counts as place 0. ``maps``: paths whose names
    are data. ``tables``: table name -> (path of the repeated ancestor, paths of its columns below it). A column path of ""
    is the place itself when it holds a plain value.
    """

    lists: frozenset[str]
    maps: frozenset[str] = frozenset()
    tables: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)


def ancestor(path: str) -> str:
    """The last repeated ancestor of a path: up to its last ``[]`` or ``{}``; "" above all lists."""
    last = max(path.rfind("[]"), path.rfind("{}"))
    return path[: last + 2] if last >= 0 else ""


def _repeats(path: str) -> int:
    return path.count("[]") + path.count("{}")


class Events:
    """All values of a batch of records with their paths and repeated ancestors.

    JSON written as a string inside JSON is opened, however often it was wrapped: at the top, where a list belongs, and as an
    object in a list. Null places of a list count but hold nothing. Of several values of one name the last holds.
    """

    def __init__(self, records: pa.Array, layout: Layout) -> None:
        self.layout = layout
        self.names: dict[str, int] = {}
        self.paths: list[str] = [""]
        self.path_ids: dict[str, int] = {"": 0}
        self.row = self.parent = self.name = self.place = self.kind = self.text_at = np.zeros(0, np.int64)
        self.texts: list[pa.Array] = []
        self._add(parse(records), None)
        top = np.flatnonzero((self.parent < 0) & (self.kind == STRING))
        self.kind[top[~self._open(top)]] = NULL
        n = len(self.row)
        self.path, self.element, self.depth = np.zeros(n, np.int64), np.full(n, -1), np.zeros(n, np.int64)
        self._walk()

    def _intern(self, names: list[str]) -> np.ndarray:
        return np.array([self.names.setdefault(x, len(self.names)) for x in names], np.int64)

    def _add(self, v: Values, onto: np.ndarray | None) -> None:
        """Append values; with ``onto`` the top value of each record takes the place of that older value."""
        n, base, text = len(v.row), len(self.row), sum(len(t) for t in self.texts)
        name = np.where(v.name >= 0, np.r_[self._intern(v.names), 0][v.name], -1)
        self.texts.append(v.text)
        if onto is None:
            self.row, self.parent, self.name, self.place, self.kind, self.text_at = v.row.copy(), v.parent.copy(), name, v.place.copy(), v.kind.copy(), np.arange(n)
            return
        top = v.parent < 0
        old = onto[v.row[top]]
        self.kind[old], self.text_at[old] = v.kind[top], text + np.flatnonzero(top)
        number = np.empty(n, np.int64)
        number[top], number[~top] = old, base + np.arange((~top).sum())
        more = (self.row[onto[v.row[~top]]], number[v.parent[~top]], name[~top], v.place[~top], v.kind[~top], text + np.flatnonzero(~top))
        self.row, self.parent, self.name, self.place, self.kind, self.text_at = (np.concatenate(x) for x in zip((self.row, self.parent, self.name, self.place, self.kind, self.text_at), more, strict=True))

    def text(self, values: np.ndarray, mask: np.ndarray | None = None) -> pa.Array:
        """The texts of values; null where ``mask``."""
        whole = self.texts[0] if len(self.texts) == 1 else pa.concat_arrays(self.texts)
        return whole.take(pa.array(self.text_at[values], mask=mask))

    def _open(self, values: np.ndarray) -> np.ndarray:
        """Open strings that hold JSON, until they hold none; which of the values became something else than a string or null."""
        done, left = np.zeros(len(values), bool), np.arange(len(values))
        kept_kind, kept_text = self.kind[values].copy(), self.text_at[values].copy()
        while len(left):
            found = parse(self.text(values[left]))
            self._add(found, values[left])
            has = np.zeros(len(left), bool)
            has[found.row[found.parent < 0]] = True
            kind = self.kind[values[left]]
            done[left[has & (kind != STRING) & (kind != NULL)]] = True
            left = left[has & (kind == STRING)]
        self.kind[values[~done]], self.text_at[values[~done]] = kept_kind[~done], kept_text[~done]
        return done

    def _path(self, parents: np.ndarray, steps: np.ndarray, make) -> np.ndarray:  # noqa: ANN001
        """Path numbers of values whose parents have the paths ``parents``; ``make`` gives the path of one parent and step."""
        width = int(steps.max(initial=0)) + 1
        pair, inverse = np.unique(parents * width + steps, return_inverse=True)
        found = []
        for parent, step in (divmod(x, width) for x in pair.tolist()):
            path = make(self.paths[parent], step)
            if path not in self.path_ids:
                self.path_ids[path] = len(self.paths)
                self.paths.append(path)
            found.append(self.path_ids[path])
        return np.array(found, np.int64)[inverse]

    def _is(self, chosen: frozenset[str], paths: np.ndarray) -> np.ndarray:
        return np.isin(paths, [self.path_ids[p] for p in chosen if p in self.path_ids])

    def _starts(self, values: np.ndarray, marks: tuple[str, ...]) -> np.ndarray:
        if not len(values):
            return np.zeros(0, bool)
        return np.array(pc.fill_null(pc.is_in(pc.utf8_slice_codeunits(self.text(values), 0, 1), value_set=pa.array(marks)), False), bool)

    def _walk(self) -> None:
        """Paths and repeated ancestors, one level of nesting at a time."""
        level, by, parents = np.flatnonzero(self.parent < 0), np.zeros(0, np.int64), np.zeros(0, np.int64)
        while len(level):
            parent = self.parent[level]
            below = parent >= 0
            in_list = below & (self.kind[parent] == LIST)
            in_map = below & ~in_list & self._is(self.layout.maps, self.path[parent])
            in_object = below & ~in_list & ~in_map
            names = list(self.names)
            for chosen, make in ((in_list, lambda p, _: f"{p}[]"), (in_map, lambda p, _: f"{p}{{}}"), (in_object, lambda p, k: f"{p}.{names[k]}" if p else names[k])):
                own = level[chosen]
                if len(own):
                    steps = self.name[own] if chosen is in_object else np.zeros(len(own), np.int64)
                    self.path[own] = self._path(self.path[self.parent[own]], steps, make)
            strings = level[self.kind[level] == STRING]
            listed = self._is(self.layout.lists, self.path[strings])
            listed[listed] = self._starts(strings[listed], ("[", "{", '"'))
            placed = ~listed & (self.parent[strings] >= 0) & (self.kind[self.parent[strings]] == LIST)
            placed[placed] = self._starts(strings[placed], ("{",))
            wrapped = strings[listed | placed]
            if len(wrapped):
                self._open(wrapped)
                grown = len(self.row) - len(self.path)
                self.path, self.element, self.depth = np.r_[self.path, np.zeros(grown, np.int64)], np.r_[self.element, np.full(grown, -1)], np.r_[self.depth, np.zeros(grown, np.int64)]
            single = self._is(self.layout.lists, self.path[level]) & (self.kind[level] != LIST) & (self.kind[level] != NULL)
            lone = level[single]
            if len(lone):
                self.path[lone] = self._path(self.path[lone], np.zeros(len(lone), np.int64), lambda p, _: f"{p}[]")
                self.place[lone], self.name[lone] = 0, -1
            self.element[level] = np.where(below, self.element[parent], -1)
            self.depth[level] = np.where(below, self.depth[parent], 0)
            own = level[in_list | in_map | single]
            self.element[own] = own
            self.depth[own] += 1
            if len(by) < len(self.parent):  # children are found by a sort that is repeated when values were added
                by = np.argsort(self.parent, kind="stable")
                parents = self.parent[by]
            low, high = np.searchsorted(parents, level, "left"), np.searchsorted(parents, level, "right")
            many = high - low
            level = np.sort(by[np.repeat(low, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)])

    def above(self, elements: np.ndarray) -> np.ndarray:
        """The repeated ancestor next above; -1 where there is none."""
        parent = self.parent[elements]
        return np.where(parent >= 0, self.element[parent], -1)

    def ordinals(self, elements: np.ndarray) -> pa.Array:
        """The places and names that lead to repeated elements (-1: none), outermost first."""
        size = np.where(elements >= 0, self.depth[elements], 0)
        ends = np.cumsum(size)
        steps = np.full(int(ends[-1]) if len(ends) else 0, -1)
        at, left, now = ends - 1, size.copy(), elements.copy()
        while (live := np.flatnonzero(left > 0)).size:
            steps[at[live]] = now[live]
            now[live] = self.above(now[live])
            at[live] -= 1
            left[live] -= 1
        named = self.name[steps] >= 0
        place = pa.array(self.place[steps]).cast(pa.string())
        name = pa.array(list(self.names), pa.string()).take(pa.array(self.name[steps], mask=~named))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pc.if_else(pa.array(named), name, place))

    def told(self) -> np.ndarray:
        """The values that are triples: plain ones, and objects that are places of a list or names of a map."""
        is_object = (self.kind == OBJECT) & (self.element == np.arange(len(self.kind))) & ~self._is(self.layout.maps, self.path)
        return np.flatnonzero((self.kind == STRING) | (self.kind == PLAIN) | is_object)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column("record")), 0).to_numpy(zero_copy_only=False).astype(np.int64)) if b.num_rows else []
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def triples(text: str | None, layout: Layout) -> Iterator[Triple]:
    """Path, ordinals and value of everything a record holds; nothing of a null, empty, cut off one or one that is no JSON."""
    e = Events(pa.array([text], pa.string()), layout)
    at = e.told()
    values = e.text(at, e.kind[at] == OBJECT).to_pylist()
    for p, o, v in zip(e.path[at].tolist(), e.ordinals(e.element[at]).to_pylist(), values, strict=True):
        yield e.paths[p], tuple(o), v


def _records(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    return df.where(F.col(json_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(json_col).cast("string").alias("record"))


def json_triples(df: DataFrame, id_col: str, json_col: str, layout: Layout) -> DataFrame:
    """(id, path, ancestor, ordinals, value): the triples of every record; records without any give no row."""
    rows = _records(df, id_col, json_col)
    schema = T.StructType([rows.schema["id"], *(T.StructField(n, T.StringType()) for n in ("path", "ancestor")), T.StructField("ordinals", T.ArrayType(T.StringType())), T.StructField("value", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            e = Events(b.column("record"), layout)
            at = e.told()
            path = pa.array(e.path[at])
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(e.row[at])), pa.array(e.paths, pa.string()).take(path), pa.array([ancestor(p) for p in e.paths], pa.string()).take(path), e.ordinals(e.element[at]), e.text(at, e.kind[at] == OBJECT)], schema.names)

    return rows.mapInArrow(run, schema)


def path_counts(df: DataFrame, json_col: str, layout: Layout) -> DataFrame:
    """(path, ancestor, values, declared): every path of the records; ``declared``: a table of the layout has it as a column."""
    known = {f"{group}.{c}" if c else group for group, columns in layout.tables.values() for c in columns} | {group for group, _ in layout.tables.values()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            e = Events(b.column("record"), layout)
            path, many = np.unique(e.path[e.told()], return_counts=True)
            names = [e.paths[p] for p in path]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([ancestor(p) for p in names], pa.string()), pa.array(many)], ["path", "ancestor", "n"])

    found = _records(df, json_col, json_col).select("record").mapInArrow(run, "path string, ancestor string, n long").groupBy("path", "ancestor").agg(F.sum("n").alias("values"))
    return found.withColumn("declared", F.col("path").isin(*known) if known else F.lit(False))


def found_layout(df: DataFrame, json_col: str, layout: Layout, most: int = MOST_PATHS) -> Layout:
    """``layout`` with a table for every group of paths that the records hold, named by its ancestor ("" above all lists)."""
    paths = [r[0] for r in path_counts(df, json_col, layout).select("path").limit(most + 1).collect()]
    if len(paths) > most:
        raise ValueError(f"more than {most} paths: name those whose names are data as maps")
    groups: dict[str, list[str]] = {}
    for p in sorted(paths):
        group = ancestor(p)
        groups.setdefault(group, []).append(p[len(group) :].lstrip("."))
    return Layout(layout.lists, layout.maps, {group: (group, tuple(columns)) for group, columns in groups.items()})


def flat_rows(df: DataFrame, id_col: str, json_col: str, layout: Layout) -> DataFrame:
    """(id, tbl, ordinals, values): the rows of all tables of ``layout``, one parse for all of them.

    ``values`` follow the columns that the layout names for the table. Rows of one table are linked to their parent rows by
    the id and by the leading ordinals.
    """
    rows = _records(df, id_col, json_col)
    schema = T.StructType([rows.schema["id"], T.StructField("tbl", T.StringType()), T.StructField("ordinals", T.ArrayType(T.StringType())), T.StructField("values", T.ArrayType(T.StringType()))])

    def pivoted(e: Events, at: np.ndarray, group: str, columns: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
        """(ancestor, value of each column or -1) of every instance of a table's ancestor that holds anything."""
        column = np.full(len(e.paths), -2)  # -2: not of this table, -1: the instance itself
        for path, k in [(group, -1), *((f"{group}.{c}" if c and group else c or group, k) for k, c in enumerate(columns))]:
            if path in e.path_ids:
                column[e.path_ids[path]] = k
        values = at[column[e.path[at]] > -2]
        element = e.element[values]
        while (deeper := np.flatnonzero(np.where(element >= 0, e.depth[element], 0) > _repeats(group))).size:
            element[deeper] = e.above(element[deeper])
        made, of = np.unique(element if group else e.row[values], return_inverse=True)
        cells = np.full((len(made), len(columns)), -1)
        k = column[e.path[values]]
        filled = (k >= 0) & (e.kind[values] != OBJECT)
        cells[of[filled], k[filled]] = values[filled]
        return made, cells

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            e = Events(b.column("record"), layout)
            at = e.told()
            for name, (group, columns) in layout.tables.items():
                made, cells = pivoted(e, at, group, columns)
                if not len(made):
                    continue
                cell = cells.ravel()
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(cell) + 1, len(columns), dtype=np.int32)) if columns else pa.array(np.zeros(len(made) + 1, np.int32)), e.text(np.maximum(cell, 0), cell < 0))
                row, element = (e.row[made], made) if group else (made, np.full(len(made), -1))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(row)), pa.array([name], pa.string()).take(pa.array(np.zeros(len(made), np.int64))), e.ordinals(element), values], schema.names)

    return rows.mapInArrow(run, schema)


def flat_table(rows: DataFrame, layout: Layout, name: str, keys: list[str], id_name: str = "record") -> DataFrame:
    """One table of ``flat_rows``: the id as ``id_name``, the ordinals under the names ``keys``, and its columns (dots become underscores)."""
    columns = layout.tables[name][1]
    picked = [F.col("ordinals")[k].alias(key) for k, key in enumerate(keys)] + [F.col("values")[k].alias((c or "value").replace(".", "_").replace("[]", "")) for k, c in enumerate(columns)]
    return rows.where(F.col("tbl") == name).select(F.col("id").alias(id_name), *picked)
