"""Records that differ only in how they are written: commutative hashing of folded fields, then field equality.

Each field name and folded value is hashed; the hashes of a record's fields, and of the pairs of a JSON object
inside a field, are added, so that order doesn't matter and nothing is sorted. Records with equal sums are
compared field by field with the record of the smallest id before they count as copies.

Nulls: a record without an id, or whose required field folds to nothing, never counts. A null plain field counts
as empty; a null JSON field equals only null. Repeated rows with one id are one record. Repeated keys of an object
count as often as they stand. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.folding import fold
from ..functions.strict_json import Number, read
from ..plans.staging import stage

_ALL = (1 << 128) - 1
BLOCK = 2000


@dataclass(frozen=True)
class Fields:
    """How the fields of a record are compared: as folded text, as text or JSON, or as JSON that may be missing."""

    plain: tuple[str, ...] = ("type", "instructions")
    mixed: tuple[str, ...] = ("state",)
    structured: tuple[str, ...] = ("criteria",)
    required: str = "state"

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.plain, *self.mixed, *self.structured)


class _Object(list):
    """The pairs of a JSON object in the order in which they are written."""


def parse(text: str, scalars: bool) -> object | None:
    """A JSON object or array (with ``scalars`` any JSON value) of a text in a list of one; None where it isn't one."""
    if not scalars and text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        value = read(text.strip(), _Object)
    except ValueError:
        return None
    return [value] if scalars or isinstance(value, list) else None


def _h(tag: bytes, text: str = "") -> int:
    return xxhash.xxh3_128_intdigest(tag + text.encode("utf-8", "surrogatepass"))


def inside_out(v: object, combine: Callable[[object, list[int]], int]) -> int:
    """``combine`` of a parsed value and of what it gave for the values right inside, from the innermost ones on;
    without recursion, since values may be nested as deeply as they like."""
    every, begins = [v], []
    for x in every:
        begins.append(len(every))
        if isinstance(x, list):
            every.extend((y for _, y in x) if isinstance(x, _Object) else x)
    out = [0] * len(every)
    for i in range(len(every) - 1, -1, -1):
        x = every[i]
        out[i] = combine(x, out[begins[i] : begins[i] + len(x)] if isinstance(x, list) else [])
    return out[0]


def _hashed(v: object, inner: list[int]) -> int:
    if isinstance(v, _Object):
        total = sum(xxhash.xxh3_128_intdigest(_h(b"k", fold(k)).to_bytes(16, "big") + x.to_bytes(16, "big")) for (k, _), x in zip(v, inner))
        return xxhash.xxh3_128_intdigest(b"o" + (total & _ALL).to_bytes(16, "big"))
    if isinstance(v, list):
        return xxhash.xxh3_128_intdigest(b"a" + b"".join(x.to_bytes(16, "big") for x in inner))
    if isinstance(v, Number):
        return _h(b"n", v)
    if isinstance(v, str):
        return _h(b"s", fold(v))
    return _h(b"c", {True: "true", False: "false", None: "null"}[v])


def value_hash(v: object) -> int:
    """128 bits of a parsed JSON value with folded strings; an object's pairs are added up."""
    return inside_out(v, _hashed)


def equal_values(a: object, b: object) -> bool:
    """Whether two parsed values are equal but for the order of keys and how strings are written."""
    numbers: dict[tuple, int] = {}  # equal values, whether of a or b, get the same number

    def number(v: object, inner: list[int]) -> int:
        if isinstance(v, _Object):
            form = ("o", frozenset(Counter((fold(k), x) for (k, _), x in zip(v, inner)).items()))
        elif isinstance(v, list):
            form = ("a", tuple(inner))
        elif isinstance(v, Number):
            form = ("n", str(v))
        else:
            form = ("s", fold(v)) if isinstance(v, str) else ("c", v)
        return numbers.setdefault(form, len(numbers))

    return inside_out(a, number) == inside_out(b, number)


def _field(kind: str, text: str | None) -> tuple[str, object]:
    """The folded text of a field, or its parsed value in a list."""
    if kind == "structured" and text is None:
        return "missing", None
    found = parse(text, kind == "structured") if text and kind != "plain" else None
    return ("text", fold(text)) if found is None else ("json", found[0])


def _kinds(fields: Fields) -> list[tuple[str, str]]:
    return [*((n, "plain") for n in fields.plain), *((n, "mixed") for n in fields.mixed), *((n, "structured") for n in fields.structured)]


def fingerprint(record: dict[str, str | None], fields: Fields) -> int:
    """Sum of the hashes of all fields' names and values."""
    total = 0
    for name, kind in _kinds(fields):
        form, value = _field(kind, record[name])
        h = value_hash(value) if form == "json" else _h(form.encode(), value or "")
        total += xxhash.xxh3_128_intdigest(name.encode() + b"=" + h.to_bytes(16, "big"))
    return total & _ALL


def same_fields(a: dict[str, str | None], b: dict[str, str | None], fields: Fields) -> bool:
    """Whether all fields of two records are equal when folded."""
    for name, kind in _kinds(fields):
        if a[name] == b[name]:
            continue
        (form_a, x), (form_b, y) = _field(kind, a[name]), _field(kind, b[name])
        if form_a != form_b or (not equal_values(x, y) if form_a == "json" else x != y):
            return False
    return True


def _rows(batch: pa.RecordBatch) -> Iterator[list[dict]]:
    for at in range(0, batch.num_rows, BLOCK):
        yield batch.slice(at, BLOCK).to_pylist()


def _picked(df: DataFrame, id_col: str, names: Sequence[str]) -> DataFrame:
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), *(F.col(f"`{n}`").cast("string").alias(n) for n in names)).where("id IS NOT NULL")


def fingerprints(df: DataFrame, id_col: str, fields: Fields) -> DataFrame:
    """``(id, fp)`` of every record that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in _rows(whole):
                kept = [r for r in rows if fold(r[fields.required])]
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in kept], pa.string()), pa.array([fingerprint(r, fields).to_bytes(16, "big") for r in kept], pa.binary())], ["id", "fp"])

    return _picked(df, id_col, fields.names).mapInArrow(run, "id string, fp binary")


def format_copies(df: DataFrame, id_col: str = "id", fields: Fields = Fields()) -> DataFrame:
    """``(keep_id, copy_id)``: for each record that is a copy, the smallest id among its copies."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for rows in _rows(whole):
                equal = [r for r in rows if same_fields({n: r[f"a_{n}"] for n in fields.names}, {n: r[f"b_{n}"] for n in fields.names}, fields)]
                yield pa.RecordBatch.from_arrays([pa.array([r["keep_id"] for r in equal], pa.string()), pa.array([r["copy_id"] for r in equal], pa.string())], ["keep_id", "copy_id"])

    marked = stage(fingerprints(df, id_col, fields), "fingerprints")
    sets = marked.groupBy("fp").agg(F.min("id").alias("keep_id"), F.max("id").alias("last")).where("keep_id <> last").select("fp", "keep_id")
    pairs = stage(marked.join(sets, "fp").where("id <> keep_id").select("keep_id", F.col("id").alias("copy_id")).distinct(), "copies")
    records = _picked(df, id_col, fields.names)
    a = records.select(F.col("id").alias("keep_id"), *(F.col(n).alias(f"a_{n}") for n in fields.names))
    b = records.select(F.col("id").alias("copy_id"), *(F.col(n).alias(f"b_{n}") for n in fields.names))
    return pairs.join(b, "copy_id").join(a, "keep_id").mapInArrow(check, "keep_id string, copy_id string").distinct()


def copy_counts(df: DataFrame, id_col: str = "id", fields: Fields = Fields()) -> DataFrame:
    """``(keep_id, copies)``: every record that counts once, with the number of records it stands for."""
    pairs = stage(format_copies(df, id_col, fields), "pairs")
    all_ids = fingerprints(df, id_col, fields).select("id").distinct()
    kept = all_ids.join(pairs.select(F.col("copy_id").alias("id")), "id", "left_anti")
    more = pairs.groupBy(F.col("keep_id").alias("id")).agg(F.count("*").alias("n"))
    return kept.join(more, "id", "left").select(F.col("id").alias("keep_id"), (F.coalesce("n", F.lit(0)) + 1).cast("long").alias("copies"))
