"""Signatures of cases that don't depend on how their input is written.

Texts are in NFKC with single blanks, keys of objects in order, ``1.0`` is ``1`` and ``true`` stays apart from ``1``; a state
that is JSON counts as the structure, whether it came as text or not. Keys that become equal make a case
unsignable: its signature is null, as is that of a case without type or state.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .strict_json import read, sorted_text

_BLANKS = re.compile(r"\s+")


def spaced(text: str) -> str:
    """NFKC with runs of white space as one blank and none at the ends."""
    return _BLANKS.sub(" ", unicodedata.normalize("NFKC", text)).strip()


class _Whole:
    """Reads numbers so that equal ones are written alike."""

    def __new__(cls, text: str) -> int | float:
        value = float(text)
        if value in (float("inf"), float("-inf")):
            raise ValueError("number out of range")
        return int(text) if text.lstrip("-").isdigit() else int(value) if value.is_integer() else value


def _members(pairs: list[tuple]) -> dict:
    out: dict = {}
    for key, value in pairs:
        key = spaced(key)
        if key in out:
            raise KeyError(key)
        out[key] = value
    return out


def _canonical(text: str | None) -> str:
    """A JSON text in canonical form, or a plain text marked as such."""
    if text is None:
        return "null"
    try:
        return "json:" + sorted_text(read(text, _members, _Whole), spaced)
    except ValueError:
        return "text:" + spaced(text)


def signature(kind: str | None, state: str | None, instructions: str | None, criteria: str | None) -> str | None:
    if kind is None or state is None:
        return None
    try:
        parts = spaced(kind).lower(), _canonical(state), "null" if instructions is None else "text:" + spaced(instructions), _canonical(criteria)
    except KeyError:
        return None
    return hashlib.sha256("\x1e".join(parts).encode("utf-8", "surrogatepass")).hexdigest()


def input_signature(kind: Column, state: Column, instructions: Column, criteria: Column) -> Column:
    """SHA-256 of the canonical input."""
    return F.udf(signature, "string", useArrow=True)(kind, state, instructions, criteria)
