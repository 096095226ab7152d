"""Language-model scoring by cross-entropy difference.

Two bigram models share one closed vocabulary, order and smoothing: one of a target corpus, one
of all documents. A document's score is the mean over its tokens of target loss minus background
loss (in nats): the lower, the more it reads like the target.

The vocabulary is every word of the target that occurs twice or more; all others are one unknown
word. Counts cover every document and are exact. Smoothing is Dirichlet: a bigram count is topped
up by ``PRIOR`` words drawn from the model's own unigrams, those by one of each word.

Texts are read once, into blocks of about ``HELD`` tokens: a row each with its words' hashes, its
tokens as places among them, and its documents. A block asks for each of its distinct words, and
then for each of its distinct bigrams, once: the question carries the block's own counts and goes to
the part of the key's hash, where the counts of all blocks meet, and the answer brings the sums back.
So what is shuffled follows the distinct bigrams of a block, a key meets once per block however
frequent it is, and whether a word is in the vocabulary, and its number there, comes with the answer.
A block then scores its documents by itself; its row is shuffled once for both uses. Nothing that
grows with the input is broadcast or sent to the driver. Words are told apart by hashes of 64 bits,
bigrams by the numbers of their words (below 2^31).

A document must not be scored by a model that has read it, or every target document would look
like the target. So documents fall into two folds by the hash of their id, both models are kept
per fold, and each document is scored by the models of the other fold.

Defined results: a text without words (NULL, empty, blank) has no tokens and NULL losses and
score; an empty target gives a uniform target model; repeated rows count as often as they come;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, ship_package, written
from .toxicity import held_out

PRIOR = 50.0
#: Tokens of a block (a longer document makes it longer), and parts for each shuffle partition; a task holds
#: one block or the questions to one part.
HELD, PARTS = 1 << 21, 2
#: Slots of the filter that lets target documents through before the exact join (16 MB at most).
TARGET_SLOTS = 1 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_KIND = {1: np.uint8, 4: np.int32, 8: np.int64}


def tokens(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_LOWER).split() if text else []


def packed(*arrays: np.ndarray) -> bytes:
    """Integer arrays as bytes: of each its length, width and the sizes of its planes (bytes of equal
    significance), then the planes, each compressed by itself and none where it is all zero."""
    head, body = [len(arrays)], []
    for a in arrays:
        planes = np.ascontiguousarray(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)
        planes = [pa.compress(p.tobytes(), codec="zstd", asbytes=True) if p.any() else b"" for p in planes]
        head += [len(a), a.itemsize, *map(len, planes)]
        body += planes
    return np.array(head, np.int32).tobytes() + b"".join(body)


def unpacked(body: bytes) -> list[np.ndarray]:
    count = int(np.frombuffer(body, np.int32, 1)[0])
    shapes, at = [], 4
    for _ in range(count):
        n, width = np.frombuffer(body, np.int32, 2, at).tolist()
        shapes.append((n, width, np.frombuffer(body, np.int32, width, at + 8).tolist()))
        at += 8 + 4 * width
    out = []
    for n, width, sizes in shapes:
        planes = np.zeros((n, width), np.uint8)
        for k, size in enumerate(sizes):
            if size:
                planes[:, k] = np.frombuffer(pa.decompress(body[at:at + size], n, codec="zstd", asbytes=True), np.uint8)
            at += size
        out.append(planes.reshape(-1).view(_KIND[width]))
    return out


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        counts: Counter = Counter()
        for t in b.column("text").to_pylist():
            counts.update(tokens(t))
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())],
                                         names=["word", "n"])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)


def _by_fold(of: np.ndarray, fold: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(of * 2 + fold, minlength=2 * size).reshape(-1, 2)


_BLOCK = pa.schema([("block", pa.int64()), ("model", pa.int32()), ("body", pa.binary()), ("words", pa.binary()),
                    *((c, pa.int64()) for c in ("tokens0", "tokens1", "docs0", "docs1"))])
_BLOCK_SQL = "block long, model int, body binary, words binary, tokens0 long, tokens1 long, docs0 long, docs1 long"


class _Block:
    """Documents as places of their tokens among the words seen."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.rows: list[tuple] = []
        self.n = 0

    def add(self, b: pa.RecordBatch) -> None:
        split = pc.ascii_split_whitespace(pc.ascii_lower(b.column("text")))
        flat, doc = split.flatten(), pc.list_parent_indices(split).to_numpy()
        full = pc.greater(pc.binary_length(flat), 0)
        words = flat.filter(full).dictionary_encode()
        lens = np.bincount(doc[full.to_numpy(zero_copy_only=False)], minlength=b.num_rows)
        known = self.known
        places = [known.setdefault(w, len(known)) for w in words.dictionary.cast(pa.binary()).to_pylist()]
        seq = np.array(places, np.int32)[words.indices.to_numpy()]
        ids = b.column("doc_id")
        self.rows.append((seq, lens, pc.fill_null(ids, 0).to_numpy(), pc.is_valid(ids).to_numpy(zero_copy_only=False).astype(np.uint8),
                          b.column("fold").to_numpy().astype(np.uint8)))
        self.n += len(seq)

    def row(self, block: int, model: int) -> pa.RecordBatch:
        import xxhash
        seq, lens, ids, valid, folds = (np.concatenate(c) for c in zip(*self.rows))
        fold = np.repeat(folds, lens).astype(np.int64)
        counts = _by_fold(seq, fold, len(self.known))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in self.known), np.uint64, len(self.known)).view(np.int64)
        order = np.lexsort((hashes, -counts.sum(axis=1)))  # frequent words first, for short bodies
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order))
        seq, counts, hashes = place[seq], counts[order], hashes[order]
        last = (np.cumsum(lens) - 1)[lens > 0]
        ends = _by_fold(seq[last], fold[last], len(order))
        n = [int((fold == f).sum()) for f in (0, 1)] + [int(((lens > 0) & (folds == f)).sum()) for f in (0, 1)]
        words = packed(hashes, *(c[:, f].astype(np.int32) for c in (counts, ends) for f in (0, 1)))
        values = [block, model, packed(seq, lens.astype(np.int32), ids, valid, folds), words, *n]
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _BLOCK)], schema=_BLOCK)


def _blocks(model: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made, held = TaskContext.get().partitionId() << 24, 0, _Block()
        for b in _slices(batches):
            held.add(b)
            if held.n >= most:
                yield held.row(first + made, model)
                made, held = made + 1, _Block()
        if held.rows:
            yield held.row(first + made, model)

    return run


#: A block's questions to one part (keys with the block's counts), and a part's answers to one block.
_ASKED = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("model", pa.int32()), ("body", pa.binary())])
_ASKED_SQL = "part int, block long, model int, body binary"
_SUMS = [f"s{k}" for k in range(9)]
_ANSWER_SQL = _ASKED_SQL + "".join(f", {c} long" for c in _SUMS)


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _asked(block: int, model: int, part: np.ndarray, columns: list[np.ndarray], stepped: tuple[int, ...]) -> Iterator[pa.RecordBatch]:
    """The rows of ``columns`` dealt to their parts, in the given order; of the ``stepped`` columns the differences."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    ends = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    rows = [(int(part[a]), block, model, packed(*(_steps(c[a:z]) if k in stepped else c[a:z] for k, c in enumerate(columns))))
            for a, z in zip(ends, ends[1:]) if z > a]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ASKED)], schema=_ASKED)


def _word_questions(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, model, words in zip(*(b.column(c).to_pylist() for c in ("block", "model", "words"))):
                hashes, *counts = unpacked(words)
                part = (hashes.view(np.uint64) % np.uint64(parts)).astype(np.int32)
                yield from _asked(block, model, part, [hashes, np.arange(len(hashes), dtype=np.int32), *counts], (0, 1))

    return run


def _groups(batches: Iterator[pa.RecordBatch], by: str, columns: tuple[str, ...]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by ``by``, a group at a time."""
    key, held = None, []
    for b in batches:
        for k, *row in zip(*(b.column(c).to_pylist() for c in (by, *columns))):
            if held and k != key:
                yield key, held
                held = []
            key = k
            held.append(tuple(row))
    if held:
        yield key, held


def _met(rows: list[tuple], key: Callable) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray, list[list[np.ndarray]]]:
    """Distinct keys of a part's questions, the key of each row, where rows begin, the sums of the counts
    by key, model and column, and the arrays of each question (counts from the third on)."""
    asked = [unpacked(body) for *_, body in rows]
    starts = np.cumsum([0, *(len(a[0]) for a in asked)]).tolist()
    keys, of = np.unique(np.concatenate([key(*a[:2]) for a in asked]), return_inverse=True)
    cell = of * 2 + np.repeat([model for _, model, _ in rows], [len(a[0]) for a in asked])
    sums = [np.bincount(cell, np.concatenate([a[c] for a in asked]), 2 * len(keys)).reshape(-1, 2) for c in range(2, len(asked[0]))]
    return keys, of, starts, np.stack(sums, axis=2).astype(np.int64), asked


def _word_answers(allowed: np.ndarray | None, parts: int):
    """For each block the words of the vocabulary that it has: place and number, and for a block of documents
    by model the counts and the counts at the end of a text, by fold. A row without block has the part's words and sums.
    Numbers are low for words that the target often has; 0 and 1 stand for the unknown word and the start."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _groups(batches, "part", ("block", "model", "body")):
            keys, of, starts, sums, asked = _met(rows, lambda steps, _: np.cumsum(steps))
            often = sums[:, 0, :2].sum(axis=1)
            inside = often >= 2
            if allowed is not None:
                inside &= np.isin(keys, allowed)
            number = np.zeros(len(keys), np.int64)
            ranked = np.flatnonzero(inside)
            ranked = ranked[np.argsort(-often[ranked], kind="stable")]
            number[ranked] = np.arange(len(ranked)) * parts + part + 2
            flat = sums.reshape(-1, 8)
            out = [(part, None, None, None, int(inside.sum()), *flat[inside].sum(axis=0).tolist())]
            for (block, model, _), a, z, q in zip(rows, starts, starts[1:], asked):
                mine = inside[of[a:z]]
                at = of[a:z][mine]
                told = []
                if model == 1:  # as with bigrams, the counts of a fold are for documents of the other
                    told = sums[at]
                    for fold in (0, 1):
                        told[:, :, fold::2] *= (q[3 - fold][mine] > 0)[:, None, None]
                    told = told.reshape(-1, 8).T
                out.append((part, block, model, packed(_steps(np.cumsum(q[1], dtype=np.int32)[mine]), number[at], *told), *(None,) * 9))
            types = [f.type for f in _ASKED] + [pa.int64()] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=[*_ASKED.names, *_SUMS])

    return run


def _pair_answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each block of documents the counts of its bigrams by model and fold, without those that no document
    of the block is scored by."""
    for part, rows in _groups(batches, "part", ("block", "model", "body")):
        _, of, starts, sums, asked = _met(rows, lambda steps, x: np.cumsum(steps) << 32 | x)
        out = []
        for (block, model, _), a, z, q in zip(rows, starts, starts[1:], asked):
            if model == 1:
                mine = sums[of[a:z]]
                out.append((part, block, model, packed(*(np.where(q[3 - fold] > 0, mine[:, m, fold], 0) for m in (0, 1) for fold in (0, 1)))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _ASKED)], schema=_ASKED)


class _Read:
    """A block's bigrams, from its body and the answers on its words. Words are places in a table:
    the unknown word, the start of a text, then the block's words of the vocabulary by number."""

    def __init__(self, body: bytes, answers: list[bytes], stats: tuple, parts: int) -> None:
        seq, self.lens, self.ids, self.valid, folds = unpacked(body)
        unknown, start = stats[:2]
        got = [unpacked(a) for a in answers]
        local, number, *columns = ((np.concatenate(c) for c in zip(*((np.cumsum(g[0]), *g[1:]) for g in got)))
                                   if got else [np.zeros(0, np.int64)] * 10)
        order = np.argsort(number)
        place = np.zeros(int(seq.max(initial=-1)) + 1, np.int64)
        place[local[order]] = np.arange(len(local)) + 2
        # word, model, (count, count at the end of a text) by fold; a block of the target has none
        if columns:
            self.counts = np.concatenate([[unknown, start], np.stack(columns, axis=1)[order].reshape(-1, 2, 4)])
        number = np.concatenate([np.arange(2), number[order]])
        x = place[seq]
        h = np.roll(x, 1)
        h[(np.cumsum(self.lens) - self.lens)[self.lens > 0]] = 1
        self.fold = np.repeat(folds, self.lens).astype(np.int64)
        pairs, self.pair = np.unique(h * len(number) + x, return_inverse=True)
        self.h, self.x = np.divmod(pairs, len(number))
        self.numbers = number[self.h], number[self.x]
        z = self.numbers[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.numbers[1].astype(np.uint64)
        z = (z ^ z >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        self.part = ((z ^ z >> np.uint64(32)) % np.uint64(parts)).astype(np.int32)


def _pair_questions(stats: tuple, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _groups(batches, "block", ("model", "kind", "body")):
            read = _Read(rows[0][2], [body for *_, body in rows[1:]], stats, parts)
            n = _by_fold(read.pair, read.fold, len(read.part)).astype(np.int32)
            yield from _asked(block, rows[0][0], read.part, [*read.numbers, n[:, 0], n[:, 1]], (0,))

    return run


_SCORED_SQL = "doc_id long, n_tokens long, target_loss double, background_loss double, score double"
_SCORED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), *((c, pa.float64()) for c in ("target_loss", "background_loss", "score"))])


def _scored(stats: tuple, parts: int, prior: float):
    """Scores of a block's documents, from its body, the answers on its words and those on its bigrams."""
    def run(block: pa.Table, answers: pa.Table) -> pa.Table:
        block = block.sort_by([("kind", "ascending"), ("part", "ascending")])
        if block.column("model")[0].as_py() == 0:
            return _SCORED.empty_table()
        body, *words = block.column("body").to_pylist()
        read = _Read(body, words, stats, parts)
        both = np.zeros((len(read.part), 4), np.int64)  # model * 2 + fold
        if len(both):
            told = answers.sort_by("part").column("body").to_pylist()
            both[np.argsort(read.part, kind="stable")] = np.concatenate([np.stack(unpacked(a), axis=1) for a in told])
        n, ends = read.counts[:, :, :2], read.counts[:, :, 2:]
        doc = np.repeat(np.arange(len(read.lens)), read.lens)
        mean = []
        for m in (0, 1):
            by_fold = [np.log(n[read.h, m, f] - ends[read.h, m, f] + prior)
                       - np.log(both[:, m * 2 + f] + prior * (n[read.x, m, f] + 1) / stats[2][m][f]) for f in (0, 1)]
            loss = np.where(read.fold == 0, by_fold[1][read.pair], by_fold[0][read.pair])  # of the other fold's model
            mean.append(np.bincount(doc, loss, len(read.lens)) / np.maximum(read.lens, 1))
        none = read.lens == 0
        return pa.Table.from_arrays([pa.array(read.ids, mask=read.valid == 0), pa.array(read.lens.astype(np.int64)),
                                     *(pa.array(v, mask=none) for v in (*mean, mean[0] - mean[1]))], schema=_SCORED)

    return run


def _numbered(blocks: DataFrame, words: DataFrame) -> DataFrame:
    return (blocks.select("block", "model", F.lit(0).alias("kind"), F.lit(-1).alias("part"), "body")
            .unionByName(words.where("block is not null").select("block", "model", F.lit(1).alias("kind"), "part", "body")))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, vocabulary: int | None = None,
                             prior: float = PRIOR, held: int = HELD) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, n_tokens, target_loss,
    background_loss, score. ``target(doc_id, text)`` is the target corpus. ``vocabulary`` keeps
    only that many of its most frequent words (their hashes go to every task); ``held``, the
    tokens of a block, has no influence on the result."""
    spark = docs.sparkSession
    ship_package(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = PARTS * n
    docs, target = (d.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(F.col("text")).alias("text"))
                    .withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(2)).cast("int")) for d in (docs, target))
    allowed = None
    if vocabulary is not None:
        target = written(target, "lm-target")
        words = target.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
        top = words.where("n >= 2").orderBy(F.desc("n"), "word").limit(vocabulary)
        allowed = top.select(F.xxhash64("word").alias("h")).toArrow().column("h").to_numpy()
    encoded = [d.mapInArrow(_blocks(k, held), _BLOCK_SQL) for k, d in enumerate((target, docs))]
    blocks = written(encoded[0].unionByName(encoded[1]), "lm-blocks")

    def answered(asked: DataFrame, answer: Callable, schema: str) -> DataFrame:
        return asked.repartition(n, "part").sortWithinPartitions("part", "block").mapInArrow(answer, schema)

    words = written(answered(blocks.select("block", "model", "words").mapInArrow(_word_questions(parts), _ASKED_SQL),
                             _word_answers(allowed, parts), _ANSWER_SQL), "lm-words")
    sums = [v or 0 for v in words.where("block is null").agg(*(F.sum(c) for c in _SUMS)).first()]
    known = np.array(sums[1:], np.int64).reshape(2, 4)
    sizes = {r.model: list(r)[1:] for r in blocks.groupBy("model").agg(*(F.sum(c) for c in ("tokens0", "tokens1", "docs0", "docs1"))).collect()}
    size = np.array([sizes.get(m, [0] * 4) for m in (0, 1)], np.int64)
    start = np.concatenate([size[:, 2:], np.zeros((2, 2), np.int64)], axis=1)
    stats = (size - known, start, (size[:, :2] + sums[0] + 1).tolist())
    # one exchange, used for the questions and again for the scores
    by_block = _numbered(blocks, words).repartition(n, "block")
    asked = by_block.sortWithinPartitions("block", "kind", "part").mapInArrow(_pair_questions(stats, parts), _ASKED_SQL)
    told = answered(asked, _pair_answers, _ASKED_SQL).repartition(n, "block")
    return by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_scored(stats, parts, prior), _SCORED_SQL)


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents labelled as of good quality and not toxic, without the held-out ones.

    A bounded filter of id slots goes first, so that only documents likely to match are shuffled
    for the exact join, which hashes the ids: the texts are neither sorted nor are all ids broadcast."""
    good = (labels.where((F.col("quality") == 1) & (F.col("toxic") == 0) & ~held_out(F.col("doc_id")))
            .select(F.col("doc_id").cast("long").alias("good_id")).distinct())
    slot = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(TARGET_SLOTS)).cast("int")
    slots = good.select(slot("good_id").alias("slot")).distinct()
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("slot", slot("doc_id"))
            .join(F.broadcast(slots), "slot", "left_semi").join(good.hint("shuffle_hash"), F.col("doc_id") == F.col("good_id"), "left_semi")
            .select("doc_id", "text"))
