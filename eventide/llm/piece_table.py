"""Fill-in-the-middle transformation of documents as piece tables.

A document is a list of descriptors ``(buffer, start, length)`` over two immutable byte
buffers, the UTF-8 text and the sentinels; no step edits or copies a buffer. Cutting splits
a descriptor in two, an arrangement permutes descriptors and puts descriptors of sentinels
between them, and the inverse permutation restores. Digests and texts come from walking the
descriptors, one slice after the other.

A text is cut into n tokens, a word with the white space before it or the white space at the
end, at two places that hashes of the document's id choose. Three of these hashes' digits
decide the form: ``plain`` (the text itself), ``psm`` (prefix, suffix, middle, each behind its
sentinel) or ``spm`` (suffix, prefix, middle). :func:`transformed` gives texts, descriptors
and digests, :func:`restored` reads texts back from output and form alone.

Everything is one pass over the rows, a document at a time: no shuffle, no hot key, and memory
for one Arrow batch and one document's output.

Defined results: a NULL or empty text is empty, plain, with no token; a text of white space is
one token; a text that holds a sentinel stays plain; a NULL id is hashed as no digits; rows
that repeat an id are cut alike, each by its own text; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WHITE, empty_text, ship_package

#: Names of the parts' sentinels, seed and percentages of the contract.
SENTINELS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
SEED = 42
FIM_PERCENT = 50
SPM_PERCENT = 80

TEXT, MARKS = 0, 1
#: The order in which a form shows the parts of a document.
FORMS = {"psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
PARTS = ("prefix", "middle", "suffix")

_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[ord(c) for c in WHITE]] = True


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


class PieceTable:
    """Descriptors over immutable buffers; every operation returns a new table."""

    __slots__ = ("buffers", "pieces")

    def __init__(self, buffers: tuple, pieces: list[Piece]):
        self.buffers, self.pieces = buffers, pieces

    @classmethod
    def of(cls, text) -> "PieceTable":
        view = memoryview(text)
        return cls((view, memoryview(b"".join(SENTINELS.values()))), [Piece(TEXT, 0, len(view))])

    def split(self, at: int) -> "PieceTable":
        """The same content with a border at byte ``at`` of it."""
        out, seen = [], 0
        for p in self.pieces:
            cut = at - seen
            if 0 <= cut <= p.length:
                out += [Piece(p.buffer, p.start, cut), Piece(p.buffer, p.start + cut, p.length - cut)]
                at = -1  # done
            else:
                out.append(p)
            seen += p.length
        return PieceTable(self.buffers, out)

    def arranged(self, order: list[int]) -> "PieceTable":
        return PieceTable(self.buffers, [self.pieces[i] for i in order])

    def marked(self, names: tuple[str, ...]) -> "PieceTable":
        """A sentinel's descriptor before each piece."""
        starts, at = {}, 0
        for k, v in SENTINELS.items():
            starts[k], at = Piece(MARKS, at, len(v)), at + len(v)
        return PieceTable(self.buffers, [q for n, p in zip(names, self.pieces) for q in (starts[n], p)])

    def stream(self) -> Iterator[memoryview]:
        for p in self.pieces:
            if p.length:
                yield self.buffers[p.buffer][p.start:p.start + p.length]

    def sha256(self) -> str:
        h = hashlib.sha256()
        for part in self.stream():
            h.update(part)
        return h.hexdigest()

    def content(self) -> bytes:
        return b"".join(self.stream())


def inverse(order: list[int]) -> list[int]:
    out = [0] * len(order)
    for at, i in enumerate(order):
        out[i] = at
    return out


def _order(form: str) -> list[int]:
    return [PARTS.index(p) for p in FORMS[form]]


def token_ends(raw) -> np.ndarray:
    """Byte positions where the tokens of a UTF-8 text end."""
    white = _IS_WHITE[np.frombuffer(raw, np.uint8)]
    if not len(white):
        return np.empty(0, np.int64)
    last = ~white
    last[:-1] &= white[1:]
    last[-1] = True  # the last word, or the white space after it
    return np.flatnonzero(last) + 1


def code_points(raw) -> int:
    return int(((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80).sum())


def choices(doc_id: int | None, seed: int = SEED) -> list[int]:
    """The four numbers of a document: 32-bit groups of the SHA-256 of ``seed:id``."""
    d = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(d[i:i + 4], "big") for i in range(0, 16, 4)]


def fim(raw, doc_id: int | None, seed: int = SEED, fim_percent: int = FIM_PERCENT,
        spm_percent: int = SPM_PERCENT) -> tuple[int, str, PieceTable, list[Piece] | None]:
    """Tokens, form, the arranged table and, unless plain, the pieces of prefix, middle and suffix."""
    table = PieceTable.of(raw)
    ends = token_ends(raw)
    n = len(ends)
    h = choices(doc_id, seed)
    if n == 0 or h[2] % 100 >= fim_percent or any(s in raw for s in SENTINELS.values()):
        return n, "plain", table, None
    form = "spm" if h[3] % 100 < spm_percent else "psm"
    cuts = [0, *ends.tolist()]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    # the later border first, so that the earlier one splits the piece before it
    whole = table.split(cuts[second])
    head = PieceTable(whole.buffers, whole.pieces[:1]).split(cuts[first])
    parts = PieceTable(whole.buffers, head.pieces + whole.pieces[1:])
    return n, form, parts.arranged(_order(form)).marked(FORMS[form]), parts.pieces


def rebuilt(output, form: str) -> PieceTable:
    """The document's table again, from an output and its form: the sentinels' places cut the
    output, which is the text buffer here, and the inverse permutation puts the parts back."""
    table = PieceTable.of(output)
    if form == "plain":
        return table
    raw = bytes(output)
    pieces, at = [], 0
    for k, name in enumerate(FORMS[form]):
        mark = SENTINELS[name]
        if raw[at:at + len(mark)] != mark:
            raise ValueError(f"no {mark!r} at byte {at} of a {form} output")
        at += len(mark)
        following = FORMS[form][k + 1:k + 2]
        end = raw.index(SENTINELS[following[0]], at) if following else len(raw)
        pieces.append(Piece(TEXT, at, end - at))
        at = end
    return PieceTable(table.buffers, pieces).arranged(inverse(_order(form)))


_DIGESTS = [("doc_id", pa.int64(), "long"), ("n", pa.int64(), "long"), ("form", pa.string(), "string"),
            ("prefix_chars", pa.int64(), "long"), ("middle_chars", pa.int64(), "long"),
            ("output_sha256", pa.string(), "string"), ("restored_sha256", pa.string(), "string")]
_TEXTS = [("output", pa.string(), "string"),
          ("pieces", pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])),
           "array<struct<buffer:int,start:long,length:long>>")]


def _schema(fields: list[tuple]) -> tuple[pa.Schema, str]:
    return pa.schema([f[:2] for f in fields]), ", ".join(f"{f[0]} {f[2]}" for f in fields)


def _utf8(column: pa.Array) -> Iterator[pa.Buffer]:
    for value in column.cast(pa.large_binary()):
        yield value.as_buffer()


def transformed(docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT,
                texts: bool = True) -> DataFrame:
    """A row per row of ``docs(doc_id, text)``: tokens, form, the lengths of prefix and middle in code
    points, digests of the output and of the text rebuilt from it and, with ``texts``, output and descriptors."""
    ship_package(docs.sparkSession)
    schema, ddl = _schema(_DIGESTS + (_TEXTS if texts else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, buffer in zip(b.column(0).to_pylist(), _utf8(b.column(1))):
                raw = buffer.to_pybytes()
                n, form, table, parts = fim(raw, doc_id, seed, fim_percent, spm_percent)
                chars = [None, None] if parts is None else [
                    code_points(table.buffers[TEXT][p.start:p.start + p.length]) for p in parts[:2]]
                output = table.content()
                row = [doc_id, n, form, *chars, table.sha256(), rebuilt(output, form).sha256()]
                rows.append(row + [output.decode("utf-8", "replace"), [p._asdict() for p in table.pieces]] if texts else row)
            cols = list(zip(*rows)) if rows else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(F.col("text")).alias("text")).mapInArrow(run, ddl)


def restored(outputs: DataFrame) -> DataFrame:
    """``outputs(doc_id, form, output)`` back to ``(doc_id, text)``."""
    ship_package(outputs.sparkSession)
    schema, ddl = _schema([("doc_id", pa.int64(), "long"), ("text", pa.string(), "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [rebuilt(buffer.to_pybytes(), form).content().decode("utf-8", "replace")
                     for form, buffer in zip(b.column(1).to_pylist(), _utf8(b.column(2)))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], schema=schema)

    return outputs.select("doc_id", "form", "output").mapInArrow(run, ddl)
