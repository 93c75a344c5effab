"""Strict JSON texts of any depth: no ``NaN``, numbers kept as their text, objects built as the caller wants them.

The library's decoder reads ordinary texts; only where a text is nested more deeply than it goes, a reader with a stack
of its own takes over, so that depth alone never changes what a text is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

_TOKEN = re.compile(r'[ \t\r\n]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)|(true|false|null))')
_WORDS = {"true": True, "false": False, "null": None}


class Number(str):
    """A number as its JSON text."""


def _refuse(name: str) -> None:
    raise ValueError(name)


def _stacked(text: str, pairs: Callable, number: Callable) -> object:
    """The value of a text, read token by token; ``ValueError`` if it isn't JSON."""
    at, end = 0, len(text.rstrip(" \t\r\n"))
    open_: list[tuple[list, bool]] = []  # lists that are being read, and whether they are an object's keys and values
    expect = "value"
    root = None
    while at < end:
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"no JSON at {at}")
        at = m.end()
        mark, string, num, word = m.groups()
        if mark in ("{", "["):
            if expect not in ("value", "value or end"):
                raise ValueError("unexpected " + mark)
            open_.append(([], mark == "{"))
            expect = "key or end" if mark == "{" else "value or end"
            continue
        if mark == ":" or mark == ",":
            if expect != mark and not (mark == "," and expect == ", or end"):
                raise ValueError("unexpected " + mark)
            expect = "value" if mark == ":" or not open_[-1][1] else "key"
            continue
        if mark:
            if not open_ or not expect.endswith("end") or (mark == "}") != open_[-1][1]:
                raise ValueError("unexpected " + mark)
            items, is_object = open_.pop()
            value: object = pairs(list(zip(items[::2], items[1::2]))) if is_object else items
        elif expect in ("key", "key or end"):
            if string is None:
                raise ValueError("no key")
            open_[-1][0].append(json.loads(string))
            expect = ":"
            continue
        elif expect in ("value", "value or end"):
            value = json.loads(string) if string is not None else number(num) if num is not None else _WORDS[word]
        else:
            raise ValueError("unexpected value")
        if open_:
            open_[-1][0].append(value)
            expect = ", or end"
        else:
            root, expect = value, "nothing"
    if expect != "nothing":
        raise ValueError("unfinished")
    return root


def read(text: str, pairs: Callable = dict, number: Callable = Number) -> object:
    """The value of a JSON text; ``pairs`` makes an object of its key-value pairs, ``number`` a number of its text."""
    try:
        return json.loads(text, object_pairs_hook=pairs, parse_float=number, parse_int=number, parse_constant=_refuse)
    except RecursionError:
        return _stacked(text, pairs, number)


def sorted_text(value: object, text: Callable[[str], str] = str) -> str:
    """A value of dictionaries and lists as JSON text with sorted keys, whatever its depth; ``text`` rewrites strings that
    aren't keys."""
    out: list[str] = []
    todo: list[object] = [(value,)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.append(x)
            continue
        (v,) = x
        if isinstance(v, dict):
            todo.append("}")
            for k, (key, y) in reversed(list(enumerate(sorted(v.items(), key=lambda e: e[0])))):
                todo += [(y,), (", " if k else "") + json.dumps(key, ensure_ascii=False) + ": "]
            todo.append("{")
        elif isinstance(v, list):
            todo.append("]")
            for k in range(len(v) - 1, -1, -1):
                todo += [(v[k],), ", "] if k else [(v[k],)]
            todo.append("[")
        else:
            out.append(str(v) if isinstance(v, Number) else json.dumps(text(v) if isinstance(v, str) else v, ensure_ascii=False))
    return "".join(out)
