"""Spans in texts: their Spark type, their order, and digests of them."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: A span: kind, first code point, one past the last, and whether a base pattern found it.
Span = tuple[str, int, int, bool]
SPANS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType()),
]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))


class Taken:
    """Intervals of a text, to ask in logarithmic time whether another one overlaps any of them."""

    def __init__(self, intervals: list[tuple[int, int]]):
        self.starts, self.ends = [], []
        for start, end in sorted(intervals):
            self.starts.append(start)
            self.ends.append(max(end, self.ends[-1] if self.ends else end))

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect.bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def ordered(spans: list[Span], kinds: list[str]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], kinds.index(s[0]), s[2]))


def with_spans(df: DataFrame, find: Callable[[list[str]], list[list[Span]]], kinds: list[str], text: str, keep: list[str] | None, name: str = "spans") -> DataFrame:
    """``df`` (or its columns ``keep``) with ``spans``, what ``find`` reports for the whole texts of a batch (null: empty)."""
    columns = [c for c in (keep or df.columns) if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.names.index("_text")).to_pylist()]
            found = [[dict(zip(("kind", "start", "end", "base"), s)) for s in ordered(spans, kinds)] for spans in find(texts)]
            rest = batch.select(columns)
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found, _ARROW)], names=[*columns, name])

    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField(name, SPANS)])
    return df.select(*columns, df[text].cast("string").alias("_text")).mapInArrow(run, schema)


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["base"])


def digest(df: DataFrame, kinds: list[str], keep: list[str], name: str = "spans") -> DataFrame:
    """Counts of the base spans by kind, their SHA-256, and all spans as text."""
    base = base_only(F.col(name))
    kind_of = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kind_of) - F.size(F.array_remove(kind_of, k))).cast("long").alias(f"n_{k}") for k in kinds]
    return df.select(*keep, *counts, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col(name)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in angle brackets; of a span that begins inside another one the part beyond it counts."""
    start = lambda acc, s: F.greatest(s["start"], acc["at"])
    parts = F.aggregate(
        spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, s: F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, start(acc, s) - acc["at"]), F.lit("<"), s["kind"], F.lit(">")).alias("out"),
            s["end"].alias("at"))))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(parts["out"], F.substring(text, parts["at"] + 1, F.char_length(text))))
