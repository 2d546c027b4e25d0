"""Configuration trees (X07, X08): merging, references and arithmetic, evaluated after the merge; nothing is executed.

A tree is a mapping of mappings and values. ``merged`` lays one tree over another: mappings of the top level are merged key by
key or overwritten as a whole, by name. A text ``$a.b`` is the value at that path; ``$a.b * 2 + 1`` computes with + - * / %.
"""

from __future__ import annotations

import ast
import contextlib
import operator
import re
from collections.abc import Mapping

_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod}
_REFERENCE = re.compile(r"\$([A-Za-z_][\w.]*)")


def merged(base: Mapping, over: Mapping, overwrite: frozenset[str] = frozenset()) -> dict:
    """``base`` with the values of ``over``; keys in ``overwrite`` are replaced, other mappings are merged, at any depth."""
    out = dict(base)
    for key, value in over.items():
        both = isinstance(value, Mapping) and isinstance(out.get(key), Mapping)
        out[key] = merged(out[key], value) if both and key not in overwrite else value
    return out


class Config:
    """A tree whose references are resolved when a value is read."""

    def __init__(self, tree: Mapping) -> None:
        self.tree = tree

    def get(self, path: str, _seen: tuple[str, ...] = ()) -> object:
        """The value at a dotted path; a missing path is a KeyError, a circle of references a ValueError."""
        if path in _seen:
            raise ValueError(f"circular reference: {' -> '.join((*_seen, path))}")
        value: object = self.tree
        for part in path.split("."):
            value = value[part] if isinstance(value, Mapping) else value[int(part)]  # type: ignore[index]
        return self._value(value, (*_seen, path))

    def _value(self, value: object, seen: tuple[str, ...]) -> object:
        if not isinstance(value, str) or "$" not in value:
            return value
        whole = _REFERENCE.fullmatch(value.strip())
        if whole:
            return self.get(whole[1], seen)
        found: dict[str, object] = {}

        def name(m: re.Match) -> str:
            found[f"_{len(found)}"] = self.get(m[1], seen)
            return f"_{len(found) - 1}"

        return _compute(ast.parse(_REFERENCE.sub(name, value), mode="eval").body, found)


def _compute(node: ast.expr, names: dict[str, object]) -> object:
    match node:
        case ast.BinOp(left, op, right) if type(op) in _OPERATORS:
            return _OPERATORS[type(op)](_compute(left, names), _compute(right, names))
        case ast.UnaryOp(ast.USub(), operand):
            return -_compute(operand, names)  # type: ignore[operator]
        case ast.Constant(value) if isinstance(value, (int, float, str)):
            return value
        case ast.Name(name) if name in names:
            return names[name]
    raise ValueError(f"not an expression of a configuration: {ast.dump(node)}")


def coerced(known: dict[str, object], given: dict[str, str]) -> dict[str, object]:
    """``known`` with the values of ``given`` for the names it has, in the type of the known value.

    Numbers that do not parse and unknown names change nothing; "", "0", "no" and "false" in any case are False.
    """
    made = dict(known)
    for name, text in given.items():
        old = known.get(name)
        if isinstance(old, bool):
            made[name] = text.lower() not in ("", "0", "no", "false")
        elif isinstance(old, (int, float)):
            with contextlib.suppress(ValueError):
                number = float(text)
                made[name] = int(number) if isinstance(old, int) and number.is_integer() else number
        elif isinstance(old, str):
            made[name] = text
    return made
