"""Secret scan: keywords by an Aho-Corasick automaton, anchored patterns near hits only, embedded checksums.

The automaton runs once over the text in ASCII lower case (which keeps every offset). Its keywords are those that begin
an assignment or an access key, prefixes of tokens that carry a checksum, and all strings of four hex digits, of which a run of
hex digits has one at every place, the first one at its beginning. At a hit the kind's pattern must match right there.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from flowlab.llm.common import map_texts, slices

# Kinds in their order, base patterns, least lengths.
KINDS = ("assign", "access", "hex", "github", "npm")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
# Tokens of 30 random characters and 6 that hold their CRC-32 in base 62.
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for kind, words in {"assign": ("password", "passwd", "secret", "token", "api_key", "apikey"), "access": ("akia",), "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), "npm": ("npm_",)}.items():
        for w in words:
            out.add_word(w, (kind, len(w)))
    for quad in map("".join, product("0123456789abcdef", repeat=4)):
        out.add_word(quad, ("hex", 4))
    out.make_automaton()
    return out


def checksum(body: str) -> str:
    """Six base-62 digits of the body's CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = BASE62[d] + out
    return out


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans in a text, by start and then kind."""
    found, past = [], dict.fromkeys(KINDS, 0)  # where each kind's last match ended
    lower = text.lower() if text.isascii() else text.encode().lower().decode()
    for end, (kind, size) in automaton().iter(lower):
        start = end + 1 - size
        if start < past[kind]:
            continue
        m = (HEX if kind == "hex" else ASSIGN if kind == "assign" else ACCESS if kind == "access" else GITHUB if kind == "github" else NPM).match(text, start)
        if m is None:
            continue
        past[kind] = m.end()
        good = (m.end() - start >= HEX_LEAST) if kind == "hex" else len(m[2]) >= ASSIGN_LEAST if kind == "assign" else m.end() - start >= ACCESS_LEAST if kind == "access" else checksum(m[1]) == m[2]
        if good:
            found.append((start, KINDS.index(kind), m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(found)]


SPANS = "array<struct<start: int, end: int, kind: string>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row; offsets count code points, ends are exclusive. Null texts count as empty; repeated rows stay;
    other columns are not read. One pass without shuffle."""

    def scanned(texts: list[str]) -> list:
        return [[[{"start": a, "end": b, "kind": k} for a, b, k in find_secrets(t)] for t in texts]]

    return map_texts(docs, id_col, text_col, f"spans {SPANS}", scanned)


def redacted(text: str, mark: str) -> str:
    """The text with every stretch of overlapping spans replaced by ``mark``."""
    out, at, begun = [], 0, -1
    for a, b, _ in find_secrets(text):
        if a >= at or begun < 0:
            out += [text[at:a], mark]
            begun = a
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", mark: str = "[SECRET]") -> DataFrame:
    """The documents with all spans replaced by ``mark``, and the length column (if there is one) renewed where the text
    changed. All rows and columns stay; null texts stay null."""
    schema, at = docs.schema, docs.columns.index(text_col)
    marked = StructType(list(schema)).add("__changed", "boolean")

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in slices(b, at)):
            old = batch.column(at).to_pylist()
            new = [t and redacted(t, mark) for t in old]
            columns = list(batch.columns)
            columns[at] = pa.array(new, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([a != b for a, b in zip(old, new, strict=True)])], names=marked.names)

    out = docs.mapInArrow(cleaned, marked)
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.when(F.col("__changed"), F.length(text_col).cast(schema[length_col].dataType)).otherwise(F.col(length_col)))
    return out.drop("__changed")
