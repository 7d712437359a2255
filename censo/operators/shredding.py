"""Nested records to flat tables: columnar shredding with repetition and definition levels.

Every leaf path of a batch of JSON records becomes one column stripe of (record, r, d, value): ``r`` is the repeated level at
which the entry repeats, ``d`` the number of steps of the path that are defined. A path step is a key or ``[]`` (an element of
a list). A place that holds a scalar in one record, an object in another and a list in a third simply has several paths, so
records of varying shape need no common schema. The tables of a repeated ancestor are rebuilt from the level sequences alone:
the position counters of an entry follow from the ``r`` of its stripe, and stripes with the same repeated ancestor are aligned
by (record, positions).

The stage is narrow (``mapInArrow``): no shuffle, no driver work, one batch in memory.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ITEM = "[]"
Path = tuple[str, ...]


class Node:
    """A place in the union of all shapes seen: it may hold scalars, keys and list elements at once."""

    __slots__ = ("item", "keys", "leaf")

    def __init__(self) -> None:
        self.leaf = False
        self.keys: dict[str, Node] = {}
        self.item: Node | None = None


def _no_constant(name: str) -> None:
    raise ValueError(f"{name} is not JSON")


#: Numbers are kept as they were sent.
DECODER = json.JSONDecoder(parse_int=str, parse_float=str, parse_constant=_no_constant)


def decode(text: str | None):
    """(valid, value) of one JSON text; numbers stay text, NaN and infinities are not valid JSON."""
    if text is None:
        return False, None
    try:
        return True, DECODER.decode(text)
    except (ValueError, RecursionError):
        return False, None


def unwrap(value):
    """A string that is itself a JSON object or list stands for that object or list."""
    if isinstance(value, str) and value[:8].lstrip()[:1] in ("{", "["):
        ok, inner = decode(value)
        if ok and isinstance(inner, (dict, list)):
            return inner
    return value


def learn(node: Node, value) -> None:
    """Widen ``node`` by the shape of ``value``."""
    if isinstance(value, dict):
        for key, child in value.items():
            learn(node.keys.setdefault(key, Node()), child)
    elif isinstance(value, list):
        if node.item is None:
            node.item = Node()
        for child in value:
            learn(node.item, child)
    elif value is not None:
        node.leaf = True


def text_of(value) -> str:
    return value if isinstance(value, str) else "true" if value is True else "false"


class Stripes:
    """Column stripes by leaf path."""

    def __init__(self) -> None:
        self.by_path: dict[Path, tuple[list, list, list, list]] = {}

    def add(self, path: Path, record: int, r: int, d: int, value: str | None) -> None:
        stripe = self.by_path.get(path)
        if stripe is None:
            stripe = self.by_path[path] = ([], [], [], [])
        stripe[0].append(record)
        stripe[1].append(r)
        stripe[2].append(d)
        stripe[3].append(value)


def shred(node: Node, value, record: int, out: Stripes, path: Path = (), r: int = 0, d: int = 0, level: int = 0) -> None:
    """Append the entries of one record for every leaf path under ``node``.

    A missing place gives one entry without value on each path below it, as the level encoding demands, so a null element of a
    list keeps its position.
    """
    if node.leaf:
        scalar = value is not None and not isinstance(value, (dict, list))
        out.add(path, record, r, d, text_of(value) if scalar else None)
    if node.keys:
        here = value if isinstance(value, dict) else {}
        for key, child in node.keys.items():
            inner = here.get(key)
            shred(child, inner, record, out, (*path, key), r, d + (inner is not None), level)
    if node.item is not None:
        if isinstance(value, list) and value:
            for i, inner in enumerate(value):
                shred(node.item, inner, record, out, (*path, ITEM), r if i == 0 else level + 1, d + 1, level + 1)
        else:
            shred(node.item, None, record, out, (*path, ITEM), r, d, level + 1)


def positions(path: Path, r: list[int], record: list[int]) -> list[tuple[int, ...]]:
    """Zero-based element positions of every entry of a stripe, from its repetition levels alone."""
    depth = path.count(ITEM)
    if not depth:
        return [()] * len(r)
    now, found, last = [0] * depth, [], None
    for level, rec in zip(r, record):
        if rec != last or level == 0:
            now, last = [0] * depth, rec
        else:
            now[level - 1] += 1
            for k in range(level, depth):
                now[k] = 0
        found.append(tuple(now))
    return found


def element_rows(values: list) -> tuple[list, list, list, list]:
    """Columns (record, tabla, ruta, padre) of all elements of all lists of a batch: the parent tables of the flat leaves.

    ``tabla`` is the list's path, ``ruta`` the element's positions, ``padre`` those of the element its list lies in ('' at the top). Which
    elements exist follows from the definition levels: an entry whose level reaches the list's step has the element, an empty or absent list
    has an entry of a lower level and no row. Null and empty elements are rows, so that the positions of the others have their parent.
    """
    root = Node()
    for value in values:
        learn(root, value)
    stripes = Stripes()
    for k, value in enumerate(values):
        shred(root, value, k, stripes)
    seen: dict[tuple[int, Path, tuple[int, ...]], None] = {}
    for path, (recs, r, d, _) in stripes.by_path.items():
        steps = [i for i, s in enumerate(path) if s == ITEM]
        for rec, at, level in zip(recs, positions(path, r, recs), d):
            for depth, i in enumerate(steps):
                if level > i:
                    seen.setdefault((rec, path[: i + 1], at[: depth + 1]))
    text = lambda at: ".".join(map(str, at))
    return [k[0] for k in seen], [".".join(k[1]) for k in seen], [text(k[2]) for k in seen], [text(k[2][:-1]) for k in seen]


def flatten_batch(values: list, records: list, pair: tuple[str, str] | None) -> tuple[list, list, list, list, list]:
    """Columns (record, ruta, tabla, campo, valor) of the flat tables of a batch, empty leaves left out.

    ``tabla`` is the repeated ancestor's path, ``campo`` the leaf's path below it. Lists of (name, value) pairs under the two keys of
    ``pair`` are rebuilt as a two-column table of their ancestor and come out as campo = name, valor = value.
    """
    root = Node()
    for value in values:
        learn(root, value)
    stripes = Stripes()
    for k, value in enumerate(values):
        shred(root, value, k, stripes)
    rec_out, ruta_out, tabla_out, campo_out, valor_out = [], [], [], [], []
    for path, (recs, r, _, vals) in stripes.by_path.items():
        last = max((i for i, s in enumerate(path) if s == ITEM), default=-1)
        table, leaf = path[: last + 1], path[last + 1 :]
        if pair and leaf == (pair[0],) and (*table, pair[1]) in stripes.by_path:
            continue
        at = positions(path, r, recs)
        names = None
        if pair and leaf == (pair[1],) and (*table, pair[0]) in stripes.by_path:
            n_recs, n_r, _, n_vals = stripes.by_path[(*table, pair[0])]
            names = {(a, p): v for a, p, v in zip(n_recs, positions((*table, pair[0]), n_r, n_recs), n_vals) if v is not None}
        tabla, campo = ".".join(table), ".".join(leaf)
        for k, p, v in zip(recs, at, vals):
            if v is None:
                continue
            v = v.strip()
            if not v:
                continue
            name = campo if names is None else names.get((k, p))
            if name is None:
                continue
            rec_out.append(records[k])
            ruta_out.append(".".join(map(str, p)))
            tabla_out.append(tabla)
            campo_out.append(name.strip())
            valor_out.append(v)
    return rec_out, ruta_out, tabla_out, campo_out, valor_out


def shred_json(
    df: DataFrame, json_col: str, keep: list[str], roots: list[str], pair: tuple[str, str] | None = ("campo", "valor"), batch: int = 512,
    mark_valid: bool = False,
) -> DataFrame:
    """One row per non-blank leaf of the blocks ``roots`` of a JSON column.

    Result: the columns ``keep``, ``bloque`` (the root key), ``tabla`` (path of the repeated ancestor below it), ``ruta`` (positions in the
    lists passed, joined by dots, '' without list), ``campo`` (path below the repeated ancestor), ``valor`` (text without outer spaces).

    Invalid or null JSON, records that are no object, and absent, null or blank leaves give no rows; a block sent as a JSON text counts as
    its content; numbers are the digits sent; a key given twice counts once, as its last value. Other columns of ``df`` are not read, so
    clashing names do no harm. ``batch`` bounds the records whose shapes are united at once. With ``mark_valid`` every valid record gives one more row whose ``bloque`` is
    '' and the other columns null, so records can be counted in the same pass.
    """
    kept = [f for f in df.schema.fields if f.name in keep]
    kept.sort(key=lambda f: keep.index(f.name))
    columns = ("bloque", "tabla", "ruta", "campo", "valor")
    schema = T.StructType([*kept, *(T.StructField(c, T.StringType()) for c in columns)])
    roots = list(roots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                decoded = [decode(x) for x in part.column(len(kept)).to_pylist()]
                rows, parts = [], {c: [] for c in columns}
                for root in roots:
                    values, records = [], []
                    for i, (ok, value) in enumerate(decoded):
                        if ok and isinstance(value, dict) and value.get(root) is not None:
                            values.append(unwrap(value[root]))
                            records.append(i)
                    if not values:
                        continue
                    rec, ruta, tabla, campo, valor = flatten_batch(values, records, pair)
                    rows += rec
                    parts["bloque"] += [root] * len(rec)
                    parts["tabla"] += tabla
                    parts["ruta"] += ruta
                    parts["campo"] += campo
                    parts["valor"] += valor
                if mark_valid:
                    valid = [i for i, (ok, _) in enumerate(decoded) if ok]
                    rows += valid
                    parts["bloque"] += [""] * len(valid)
                    for c in columns[1:]:
                        parts[c] += [None] * len(valid)
                at = pa.array(rows, pa.int64())
                arrays = [part.column(i).take(at) for i in range(len(kept))]
                arrays += [pa.array(parts[c], pa.string()) for c in columns]
                yield pa.RecordBatch.from_arrays(arrays, [f.name for f in schema.fields])

    return df.select(*(F.col(f.name) for f in kept), F.col(json_col).alias("_json")).mapInArrow(run, schema)



def shred_elements(df: DataFrame, json_col: str, keep: list[str], roots: list[str], batch: int = 512) -> DataFrame:
    """One row per element of every list in the blocks ``roots``: ``keep``, bloque, tabla, ruta, padre (see ``element_rows``).

    With ``shred_json`` these are related tables: leaves join their element on (keep, bloque, tabla, ruta), elements their parent's on padre.
    """
    kept = sorted((f for f in df.schema.fields if f.name in keep), key=lambda f: keep.index(f.name))
    schema = T.StructType([*kept, *(T.StructField(c, T.StringType()) for c in ("bloque", "tabla", "ruta", "padre"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, batch):
                part = whole.slice(start, batch)
                decoded = [decode(x) for x in part.column(len(kept)).to_pylist()]
                rows, cols = [], ([], [], [], [])
                for root in roots:
                    at = [i for i, (ok, v) in enumerate(decoded) if ok and isinstance(v, dict) and v.get(root) is not None]
                    rec, *found = element_rows([unwrap(decoded[i][1][root]) for i in at])
                    rows += [at[k] for k in rec]
                    for c, values in zip(cols, ([root] * len(rec), *found)):
                        c.extend(values)
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(len(kept))), *(pa.array(c, pa.string()) for c in cols)], [f.name for f in schema.fields])

    return df.select(*(F.col(f.name) for f in kept), F.col(json_col).alias("_json")).mapInArrow(run, schema)
