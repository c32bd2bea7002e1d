"""Byte-level BPE encoding and decoding with a local rank file.

Long texts are cut where a match of the splitting pattern must end: before a single space that follows a character which is
not white space, for no match goes on past such a character into white space, and none looks back. The pieces are encoded on
their own, so neither the pattern nor the merging ever sees more than about ``PIECE`` characters unless a text has no
such place. Decoding joins the tokens' raw bytes; characters may span tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from flowlab.llm.common import map_texts, slices

PIECE = 100_000
SAFE = re.compile(r"(?<=\S)(?= \S)")


@lru_cache(maxsize=2)
def encoding(ranks: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks, "rb") as lines:
        table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, piece: int = PIECE) -> Iterator[str]:
    """The text in pieces that end at safe places."""
    begin = 0
    while len(text) - begin > piece:
        m = SAFE.search(text, begin + piece)
        if m is None:
            break
        yield text[begin : m.start()]
        begin = m.start()
    yield text[begin:]


def encode(enc: tiktoken.Encoding, text: str, piece: int = PIECE) -> list[int]:
    if len(text) <= piece:
        return enc.encode_ordinary(text)
    return [t for part in safe_pieces(text, piece) for t in enc.encode_ordinary(part)]


def encode_texts(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids) of every row; ids: little-endian unsigned 32-bit values. Null texts count as empty (no tokens); repeated
    rows stay; other columns are not read. One pass without shuffle."""

    def encoded(texts: list[str]) -> list:
        enc = encoding(ranks, pattern)
        ids = [np.array(encode(enc, t), "<u4") for t in texts]
        return [[len(x) for x in ids], [x.tobytes() for x in ids]]

    return map_texts(docs, id_col, text_col, "n_tokens long, ids binary", encoded)


def decode_ids(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """The rows with the raw bytes of their ids in a new column ``out_col`` (null ids: empty), some 500 KB of ids at a time."""
    schema = StructType(list(rows.schema)).add(out_col, "binary")

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks, pattern)
        at = schema.names.index(ids_col)
        for batch in (part for b in batches for part in slices(b, at)):
            raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(raw, pa.binary())], names=schema.names)

    return rows.mapInArrow(decoded, schema)
