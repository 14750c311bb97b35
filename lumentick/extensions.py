"""Names under which users add filters, field rules, sources and event types; each is a function or a schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from lumentick.functions import filters as own

Filter = Callable[[Column], Column]
FieldRule = Callable[[DataFrame], DataFrame]
Source = Callable[..., DataFrame]

#: Condition on a symbol column by name; the built-in classes are there from the start.
filters: dict[str, Filter] = {name: (lambda c, name=name: own.of_class(c, name)) for name in own.CLASSES}
field_rules: dict[str, Callable[..., FieldRule]] = {}
sources: dict[str, Source] = {}
event_types: dict[str, T.StructType] = {}


def register(kind: dict, name: str, value) -> None:
    """Add ``value`` to one of the tables above; a taken name is an error."""
    if name in kind:
        raise ValueError(f"{name!r} is taken")
    kind[name] = value


def selected(rows: DataFrame, name: str, symbol: Column) -> DataFrame:
    """Rows that a named filter passes."""
    return rows.where(filters[name](symbol))


def replaced(rows: DataFrame, *rules: tuple) -> DataFrame:
    """Rows after field rules (name, arguments...) in turn."""
    for name, *arguments in rules:
        rows = field_rules[name](*arguments)(rows)
    return rows


def connected(spark: SparkSession, address: str, **options) -> DataFrame:
    """A source by address ``name:rest``."""
    name, _, rest = address.partition(":")
    return sources[name](spark, rest, **options)


def listened(stream: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Call ``listener`` with each batch of a stream."""
    writer = stream.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
