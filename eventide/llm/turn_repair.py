"""Repair of conversations by weighted CYK interval parsing.

A conversation is right if its role initials read ``(s?(ua)+)?``. The repair grammar is in
Chomsky normal form: its nonterminals are pairs ``(p, q)`` of what has been read before and after
a span (nothing, the system turn, a user turn, an assistant turn), with rules
``(p, q) -> (p, r) (r, q)`` and one terminal rule for each edit of a row: Keep, Rerole, Delete.
Inserted turns have no row, so their closure is taken into each terminal's cells, before and
after it. A span's cells hold the least ``(cost, audit)`` per nonterminal, and spans are combined
bottom-up by length: rows, then pairs, fours and so on. As the nonterminals hold all that passes
a border, each split of a span gives the same cells, so one split per span is enough; the
audits of one nonterminal and span with equal cost are never prefixes of each other, so the
least audit of a whole is made of least audits of its parts.

On Spark, the parse needs no texts: rows go to it as conversation, turn, role, two hashes and
marks. Equal rows are counted first; the first turn of a role and text comes from an aggregate
joined back, which splits where one text is frequent; then the rows are ranged over the cluster by
(conversation, turn), so a conversation that holds a third of all rows lies in many tasks, each of
which sends the cells of its span. A last shuffle by conversation joins spans and texts in order;
there the spans meet, and the texts are streamed through the audit. A digest of a whole
conversation has to be taken in one task, but it holds one batch of its rows at a time.

Defined results: NULL role or text counts as one space, so such a row is blank or has a role that
cannot be kept; NULL turns come first; rows that share a turn stand in the order of role and a
hash of the text; a NULL conv_id is one conversation; roles count by their first character, an
empty role by none; rows that are equal in all columns are duplicates but for one; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, ship_package

#: The costs of the edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
FINAL = (START, ASSISTANT)
#: Where a turn of that role leads.
STEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Symbols whose span is kept in the workers' bounded memory.
CACHED_SPAN = 8
#: Rows that a task holds of a conversation before it sends their span.
SPAN_ROWS = 4096

Cell = tuple[int, str] | None
Cells = tuple[tuple[Cell, ...], ...]


def _least(found: list[tuple[int, str, str]]) -> Cell:
    if not found:
        return None
    low = min(f[0] for f in found)
    return low, min(a + b for c, a, b in found if c == low)


def combined(left: Cells, right: Cells) -> Cells:
    """The cells of two neighbouring spans' union."""
    return tuple(tuple(_least([(left[p][r][0] + right[r][q][0], left[p][r][1], right[r][q][1])
                               for r in STATES if left[p][r] and right[r][q]]) for q in STATES) for p in STATES)


def _closure() -> Cells:
    """Insertions alone: every state to every state by inserted turns, or none."""
    none = [[(0, "") if p == q else None for q in STATES] for p in STATES]
    once = [row[:] for row in none]
    for to in ("u", "a"):
        for p, q in STEPS[to].items():
            once[p][q] = min(once[p][q] or (INSERT, "I"), (INSERT, "I"))
    out = tuple(map(tuple, once))
    for _ in STATES:
        out = combined(out, tuple(map(tuple, once)))
    return out


INSERTIONS = _closure()


@lru_cache(maxsize=None)  # nine symbols
def terminal(symbol: str) -> Cells:
    """Cells of one row: ``s u a`` or ``o`` (another role), upper case if truncated, ``x`` to be deleted."""
    cells = [[(DELETE, "D") if p == q else None for q in STATES] for p in STATES]
    more = TRUNCATED if symbol.isupper() else 0
    role = symbol.lower()
    edits = [(0, "K", role)] if role in STEPS else []
    if role != "x":
        edits += [(REROLE, "R", "u"), (REROLE, "R", "a")]
    for cost, name, to in edits:
        for p, q in STEPS[to].items():
            cells[p][q] = min(filter(None, (cells[p][q], (cost + more, name))))
    return combined(combined(INSERTIONS, tuple(map(tuple, cells))), INSERTIONS)


def merged(spans: list[Cells]) -> Cells:
    """Neighbouring spans combined bottom-up."""
    if not spans:
        return INSERTIONS
    while len(spans) > 1:
        pairs = [combined(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + ([spans[-1]] if len(spans) % 2 else [])
    return spans[0]


@lru_cache(maxsize=1 << 14)
def _short(symbols: str) -> Cells:
    return merged([terminal(s) for s in symbols])


def cells_of(symbols: str) -> Cells:
    return merged([_short(symbols[i:i + CACHED_SPAN]) for i in range(0, len(symbols), CACHED_SPAN)])


def answer(cells: Cells) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    return min(cells[START][q] for q in FINAL if cells[START][q])


class Replay:
    """Walks an audit along the rows it was made for and tells the repaired turns."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _made(self) -> str:
        to = "a" if self.state == USER else "u"
        self.state = STEPS[to][self.state]
        return ROLES[to]

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield "I", self._made(), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = STEPS[role[:1]][self.state]
            yield edit, role, text
        elif edit == "R":
            yield edit, self._made(), text


# ---------------------------------------------------------------------------
# rows
# ---------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with faults that a hash of (conversation, turn) puts in: the rows, and the
    conversation of each row that was dropped."""
    text, role = (F.coalesce(F.col(c), F.lit(" ")) for c in ("text", "role"))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    kind = F.col("fault")
    out = rows.where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1))).alias("copy")).drop("copy")
    return out, rows.where(kind == 0).select("conv_id")


def _rows(conversations: DataFrame) -> DataFrame:
    text, role = (F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("text", "role"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role, text)
    return rows.withColumn("h1", F.xxhash64("role", "text")).withColumn("h2", F.xxhash64(F.lit(1), "text", "role"))


def _symbol(blank: Column, later: Column, cut: Column) -> Column:
    first = F.substring("role", 1, 1)
    plain = F.when(first.isin("s", "u", "a"), first).otherwise(F.lit("o"))
    return F.when(blank | later, F.lit("x")).when(cut, F.upper(plain)).otherwise(plain)


def marked(rows: DataFrame) -> DataFrame:
    """Thin rows, one per distinct (conversation, turn, role, text): how many (``n``), initial, symbol of
    the first of them and its fault."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    thin = (rows.select("conv_id", "turn", "role", "h1", "h2", (bare == "").alias("blank"),
                        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
            .groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut")))
    again = (thin.groupBy("conv_id", "h1", "h2").agg(F.count("*").alias("turns"), F.min("turn").alias("first"),
                                                     F.max(F.col("turn").isNull()).alias("unset"))
             .where("turns > 1").select(F.col("conv_id").alias("c"), F.col("h1").alias("g1"), F.col("h2").alias("g2"), "first", "unset"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h1") == F.col("g1")) & (F.col("h2") == F.col("g2"))
    later = F.coalesce(F.when(F.col("unset"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("first")), F.lit(False))
    fault = F.when(F.col("blank"), "b").when(later, "d").when(F.col("cut"), "t").otherwise("")
    return thin.join(again, same, "left").select(
        "conv_id", "turn", "role", "h1", "h2", "n", F.substring("role", 1, 1).alias("initial"),
        _symbol(F.col("blank"), later, F.col("cut")).alias("symbol"), fault.alias("fault"))


_PLACE = ["turn", "role", "h1", "h2"]
_SPAN = pa.struct([("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()),
                   ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()),
                   ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))])
_SPAN_DDL = ("struct<low:long,high:long,turns:long,blank:long,duplicate:long,truncated:long,illegal:long,first:string,"
             "last:string,costs:array<long>,audits:array<string>>")


def _span(rows: list[tuple]) -> dict:
    """What a run of thin rows ``(turn, n, initial, symbol, fault)`` of one conversation comes to."""
    turns = [r[0] for r in rows if r[0] is not None]
    out = {"low": turns[0] if turns else None, "high": turns[-1] if turns else None,
           "turns": sum(1 for k, t in enumerate(turns) if not k or t != turns[k - 1]),
           "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "first": rows[0][2], "last": rows[-1][2]}
    before = None
    for _, n, initial, _, fault in rows:
        if before is not None and before + initial not in LEGAL:
            out["illegal"] += 1
        before = initial
        out["illegal"] += n - 1  # a role beside itself
        if fault == "b":
            out["blank"] += n
        else:
            out["duplicate"] += n if fault == "d" else n - 1
            out["truncated"] += fault == "t"
    cells = cells_of("".join(symbol + "x" * (n - 1) for _, n, _, symbol, _ in rows))
    flat = [c for row in cells for c in row]
    return out | {"costs": [c and c[0] for c in flat], "audits": [c and c[1] for c in flat]}


def spans(thin: DataFrame) -> DataFrame:
    """``(conv_id, turn, role, h1, h2, span)``: a row per conversation and task that holds rows of it (or per
    ``SPAN_ROWS`` of them), named by the first of the rows."""
    order = ["conv_id", *_PLACE]
    sorted_rows = thin.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("h1", pa.int64()), ("h2", pa.int64()), ("span", _SPAN)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, rows, done = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) if done else [()] * len(schema)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for b in batches:
            for conv, turn, role, h1, h2, *more in zip(*(c.to_pylist() for c in b.columns)):
                if head is None or head[0] != conv or len(rows) >= SPAN_ROWS:
                    if head is not None:
                        done.append((*head, _span(rows)))
                    head, rows = (conv, turn, role, h1, h2), []
                rows.append((turn, *more))
            if len(done) >= 4096:
                yield flush()
        if head is not None:
            done.append((*head, _span(rows)))
        yield flush()

    return (sorted_rows.select(*order, "n", "initial", "symbol", "fault")
            .mapInArrow(run, f"conv_id long, turn long, role string, h1 long, h2 long, span {_SPAN_DDL}"))


def _whole(parts: list[dict]) -> dict:
    """The spans of one conversation, in order, as one."""
    out = {"gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    low = high = before = None
    distinct = 0
    for s in parts:
        for k in ("blank", "duplicate", "truncated", "illegal"):
            out[k] += s[k]
        if before is not None and before + s["first"] not in LEGAL:
            out["illegal"] += 1
        before = s["last"]
        if s["turns"]:
            distinct += s["turns"] - (high is not None and high == s["low"])
            low, high = s["low"] if low is None else low, s["high"]
    if low is not None:
        out["gaps"] = min(high - low + 1 - distinct, (1 << 63) - 1)
    cells = merged([tuple(tuple(None if s["costs"][4 * p + q] is None else (s["costs"][4 * p + q], s["audits"][4 * p + q])
                                for q in STATES) for p in STATES) for s in parts])
    cost, audit = answer(cells) if parts else (0, "")
    return out | {"cost": cost, "audit": audit}


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
DROPPED, SPAN, ROW = range(3)


def _met(conversations: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Per task whole conversations, in order: their ids, their spans, then their rows with texts."""
    rows = _rows(conversations)
    long, text, span = F.lit(None).cast("long"), F.lit(None).cast("string"), F.lit(None).cast(_SPAN_DDL)
    order = ["conv_id", "kind", *_PLACE]
    every = rows.select("conv_id", F.lit(ROW).alias("kind"), *_PLACE, "text", span.alias("span")).unionByName(
        spans(marked(rows)).select("conv_id", F.lit(SPAN).alias("kind"), *_PLACE, text.alias("text"), "span"))
    if ids is not None:
        every = every.unionByName(ids.select(F.col("conv_id").cast("long").alias("conv_id"), F.lit(DROPPED).alias("kind"), long.alias("turn"),
                                             text.alias("role"), long.alias("h1"), long.alias("h2"), text.alias("text"), span.alias("span")).distinct())
    return every.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "kind", "turn", "role", "text", "span")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """``("begin", conv_id, result)``, ``("turn", source turn, edit, role, text)`` and ``("end",)`` of each conversation."""
    open_, conv, parts, replay = False, None, [], None
    for whole in batches:
        for b in (whole.slice(s, 1024) for s in range(0, whole.num_rows, 1024)):
            for c, kind, turn, role, text, span in zip(*(x.to_pylist() for x in b.columns)):
                if not open_ or c != conv:
                    if open_:
                        if replay is None:
                            yield "begin", conv, _whole(parts)
                        else:
                            yield from (("turn", None, *t) for t in replay.inserted())
                        yield ("end",)
                    open_, conv, parts, replay = True, c, [], None
                if kind == SPAN:
                    parts.append(span)
                elif kind == ROW:
                    if replay is None:
                        result = _whole(parts)
                        parts, replay = [], Replay(result["audit"])
                        yield "begin", conv, result
                    yield from (("turn", None if t[0] == "I" else turn, *t) for t in replay.row(role, text))
    if open_:
        if replay is None:
            yield "begin", conv, _whole(parts)
        else:
            yield from (("turn", None, *t) for t in replay.inserted())
        yield ("end",)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1024) -> Iterator[pa.RecordBatch]:
    some: list[tuple] = []

    def batch() -> pa.RecordBatch:
        cols = list(zip(*some)) if some else [()] * len(schema)
        some.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for r in rows:
        some.append(r)
        if len(some) >= size:
            yield batch()
    yield batch()


def repaired(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation of ``conversations(conv_id, turn, role, text)`` and of ``ids(conv_id)``: faults,
    cost, audit and the digest of the repaired turns."""
    ship_package(conversations.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for what, *more in _conversations(batches):
                if what == "begin":
                    (conv, result), digest, first = more, hashlib.sha256(), True
                elif what == "turn":
                    if not first:
                        digest.update(b"\n")
                    first = False
                    digest.update(f"{more[2]}:{more[3]}".encode("utf-8", "replace"))
                else:
                    yield (conv, *[result[c] for c in _COUNTS], result["audit"], digest.hexdigest())
        yield from _batched(rows(), schema)

    return _met(conversations, ids).mapInArrow(
        run, "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string")


def repaired_turns(conversations: DataFrame) -> DataFrame:
    """The repaired conversations themselves: conv_id, position from 0, edit (K, R or I), source turn, role, text."""
    ship_package(conversations.sparkSession)
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("source_turn", pa.int64()),
                        ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for what, *more in _conversations(batches):
                if what == "begin":
                    conv, at = more[0], 0
                elif what == "turn":
                    yield conv, at, more[1], more[0], more[2], more[3]
                    at += 1
        yield from _batched(rows(), schema)

    return _met(conversations, None).mapInArrow(
        run, "conv_id long, position long, edit string, source_turn long, role string, text string")
