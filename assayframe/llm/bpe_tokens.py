"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

The rank file is a path parameter (a local path on every executor). Long texts are cut before encoding at safe
boundaries: a white-space character that follows a letter or digit always begins a new match of the pattern, since
no alternative continues from a word character into white space and none looks back. A stretch without such a
boundary is matched by the ``regex`` library and its matches are encoded one by one, so that no text reaches the
library's own matcher with a run that overflows its stack. Ids decode to the raw bytes, never through a lossy string.

Defined results: a null or empty text has no ids and decodes to no bytes; null ids decode like empty ones; repeated
rows give repeated rows; an empty table gives an empty table; columns named ``ids`` or ``decoded`` are replaced.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, types as T

#: Texts over so many characters are cut.
LONG = 50_000
_BOUNDARY = re.compile(r"[^\W_](?=[ \n])")


class Codec:
    """An encoding of one rank file; build it inside a task through ``codec``."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(piece): int(rank) for piece, rank in (line.split() for line in lines if line.strip())}
        self.library = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if len(text) <= LONG:
            return self.library.encode_ordinary(text)
        ids: list[int] = []
        for part in safe_parts(text):
            if len(part) <= 2 * LONG:
                ids += self.library.encode_ordinary(part)
            else:
                for match in self.pattern.finditer(part):
                    ids += self.library._core_bpe.encode_single_piece(match.group().encode())
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.library.decode_bytes(ids)


def safe_parts(text: str, about: int = LONG) -> Iterator[str]:
    """``text`` in parts of at least ``about`` characters, cut only where a match of the pattern always ends."""
    at = 0
    while len(text) - at > about:
        cut = _BOUNDARY.search(text, at + about - 1)
        if cut is None:
            break
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text):
        yield text[at:]


@functools.cache
def codec(rank_file: str, pattern: str) -> Codec:
    return Codec(rank_file, pattern)


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``df`` (or its columns ``keep``) with ``ids array<int>``, the ids of the whole text."""
    columns = [c for c in (keep or df.columns) if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            lists = [np.asarray(own.encode(x.as_py()), np.int32) for x in batch.column(batch.schema.names.index("_text"))]
            ends = np.cumsum([0, *map(len, lists)])
            if ends[-1] >= 2**31:
                raise ValueError("a batch has over 2^31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
            flat = np.concatenate([*lists, np.empty(0, np.int32)])
            rest = batch.select([n for n in batch.schema.names if n != "_text"])
            yield _with(rest, "ids", pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32())))

    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.select(*columns, df[text].alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` with ``decoded binary``, the bytes of the ids."""
    columns = [c for c in df.columns if c != "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        for batch in batches:
            lists = batch.column(batch.schema.names.index(ids))
            yield _with(batch, "decoded", pa.array([own.decode(_ints(x)) for x in lists], pa.binary()))

    schema = T.StructType([df.schema[c] for c in columns] + [T.StructField("decoded", T.BinaryType())])
    return df.select(*columns).mapInArrow(run, schema)


def _ints(cell: pa.ListScalar) -> list[int]:
    return cell.values.to_numpy(zero_copy_only=False).tolist() if cell.is_valid else []


def digests(df: DataFrame, rank_file: str, pattern: str, keep: list[str]) -> DataFrame:
    """``keep``, ``n_tokens``, and the SHA-256 of the ids as text and of the decoded bytes, for encoded rows."""
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(rank_file, pattern)
        names = [str(i) for i in range(own.library.n_vocab + 1)]
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for cell in batch.column(batch.schema.names.index("ids")):
                found = _ints(cell)
                counts.append(len(found))
                of_ids.append(hashlib.sha256(",".join([names[i] for i in found]).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(own.decode(found)).hexdigest())
            rest = batch.select([n for n in batch.schema.names if n != "ids"])
            out = _with(rest, "n_tokens", pa.array(counts, pa.int64()))
            yield _with(_with(out, "ids_sha256", pa.array(of_ids, pa.string())), "decoded_sha256", pa.array(of_bytes, pa.string()))

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    schema = T.StructType([df.schema[c] for c in keep] + fields)
    return df.select(*keep, "ids").mapInArrow(run, schema)
