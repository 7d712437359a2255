"""A Python data source for registries that answer one id at a time.

The network call is a function named by its import path, so tests and offline runs bring their own. Each answer is a row with a status
('encontrado', 'no existe', 'error'), the record as text and a reason: failures are data, not exceptions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from datetime import date
from importlib import import_module

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

NOT_FOUND = "no existe"


class IdRange(InputPartition):
    def __init__(self, ids: list[str]) -> None:
        super().__init__(ids)
        self.ids = ids


def named(path: str):
    """The function an import path 'module:function' names."""
    module, _, name = path.rpartition(":")
    return getattr(import_module(module), name)


class LookupReader(DataSourceReader):
    """Options: ids, fetch; idsPerTask (100); delaySeconds between calls (0); deadline, a Unix time after which no call is begun;
    abortAfter (5), consecutive errors after which a task stops calling: absences and answers begin the count anew. Ids not called are left
    out, so the next run finds them pending."""

    def __init__(self, options: dict) -> None:
        self.ids = [i for i in options.get("ids", "").split(",") if i]
        self.fetch = options["fetch"]
        self.size = int(options.get("idspertask", options.get("idsPerTask", "100")))
        self.delay = float(options.get("delayseconds", options.get("delaySeconds", "0")))
        self.deadline = float(options.get("deadline", "inf"))
        self.abort = int(options.get("abortafter", options.get("abortAfter", "5")))

    def partitions(self) -> list[InputPartition]:
        return [IdRange(self.ids[i : i + self.size]) for i in range(0, len(self.ids), self.size)] or [IdRange([])]

    def read(self, partition: IdRange) -> Iterator[tuple]:
        fetch, failed = named(self.fetch), 0
        for at, i in enumerate(partition.ids):
            if failed >= self.abort or time.time() > self.deadline:
                return
            if at and self.delay:
                time.sleep(self.delay)
            try:
                body = fetch(i)
            except Exception as e:  # noqa: BLE001 - any failure of a call is an answer of status error
                failed += 1
                yield i, "error", None, f"{type(e).__name__}: {e}"
                continue
            if body is not None and body.strip() != NOT_FOUND and not readable(body):
                failed += 1
                yield i, "error", None, "no es JSON"
                continue
            failed = 0
            if body is None or body.strip() == NOT_FOUND:
                yield i, "no existe", None, "el registro no lo tiene"
            else:
                yield i, "encontrado", body, None


def readable(body: str) -> bool:
    try:
        return isinstance(json.loads(body), dict)
    except ValueError:
        return False


class LookupSource(DataSource):
    """``spark.read.format("registro").option("ids", "a,b").option("fetch", "module:function")``."""

    @classmethod
    def name(cls) -> str:
        return "registro"

    def schema(self) -> str:
        return "identificador string, estado string, registro string, motivo string"

    def reader(self, schema) -> DataSourceReader:
        return LookupReader(self.options)


class Span(InputPartition):
    def __init__(self, year: int | None, first: str, last: str | None) -> None:
        super().__init__((year, first, last))
        self.year, self.first, self.last = year, first, last


class ListReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.fetch = options["fetch"]
        self.since = options.get("since")
        self.years = [int(y) for y in options.get("years", "").split(",") if y]

    def partitions(self) -> list[InputPartition]:
        if self.since:
            return [Span(None, date.fromisoformat(self.since).isoformat(), None)]
        return [Span(y, f"{y:04d}-01-01", f"{y:04d}-12-31") for y in self.years]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield partition.year, named(self.fetch)(partition.first, partition.last)


class ListSource(DataSource):
    """Lists of the registry: ``spark.read.format("registro_lista")`` with fetch 'module:function' of (first day, last day or None), and
    either ``since`` (a day) or ``years`` ('2019,2020', one task each). Rows: (anio, documento). A failing call fails the read."""

    @classmethod
    def name(cls) -> str:
        return "registro_lista"

    def schema(self) -> str:
        return "anio int, documento string"

    def reader(self, schema) -> DataSourceReader:
        return ListReader(self.options)
