"""The small query language over token densities.

``A op B`` with op in + * - ^, ``op A`` with op in ~ ^ \\ ` ", ``>N A`` for the N largest points of A, ``A B`` for a product, and
``A`` alone (further words are ignored). Tokens all in lower case get a capital letter.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoweave.operators import density as D


@dataclass(frozen=True)
class Query:
    """A parsed query: tokens, the operator if any, and the number of points if limited."""

    tokens: tuple[str, ...]
    op: str | None = None
    top: int | None = None


def normalised(token: str) -> str:
    """F25 on the driver: a token all in lower case gets a capital letter."""
    return token[:1].upper() + token[1:] if token.lower() == token else token


def parse(text: str) -> Query:
    """The query of a text; an empty text is an error."""
    words = text.split()[:4]
    match words:
        case []:
            raise ValueError("an empty query")
        case [a, op, b] if op in D.BINARY:
            return Query((normalised(a), normalised(b)), op)
        case [op, a] if op in D.UNARY or op == D.GATE:
            return Query((normalised(a),), op)
        case [limit, a] if re.fullmatch(r">\d+", limit):
            return Query((normalised(a),), top=int(limit[1:]))
        case [a, b]:
            return Query((normalised(a), normalised(b)), "*")
        case [a, *_]:
            return Query((normalised(a),))


def density_query(text: str, positioned: DataFrame, frame: D.Frame, k: float, threshold: float = 0.01, zoom: int = 0, x: float = 0.0, y: float = 0.0) -> DataFrame:
    """The grid (gx, gy, v) of a query over ``positioned`` (token, x, y, v). A token without points is an error."""
    q = parse(text)
    grids = []
    for token in q.tokens:
        points = positioned.where(F.col("token") == token)
        if points.isEmpty():
            raise ValueError(f"there is no data for {token}")
        if q.top is not None:
            points = D.top_points(points, q.top)
        grids.append(D.zoomed_density(points, frame, zoom, x, y, frame.width, frame.height, k, threshold) if zoom else D.density(points, frame, k, threshold))
    if q.op is None:
        return grids[0]
    return D.binary(grids[0], grids[1], q.op) if len(grids) == 2 else D.unary(grids[0], q.op, frame.width, frame.height)
