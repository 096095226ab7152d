"""Best-fit packing of tokenized documents into sequences.

Every piece asks for three things of a sequence: tokens, one document, and attention cost (the
square of its length). Pieces are placed longest first; among the sequences that can still take
a piece under every capacity, vector best-fit picks by the weighted norm of what would be left
(``rule="norm"``) or by the weighted dot product of the piece with what is left (``"dot"``).

Pieces are dealt by hash into groups of about ``GROUP`` and each group is packed in one task, so
a run wastes at most a part of one sequence per group. Tokens are found per white-space separated word and
kept in a bounded cache: the tokenizer never joins across white space.

Defined results: NULL or empty text is the end token alone; repeated rows are packed each; ties
in length go by doc_id and piece; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import empty_text, ship_package, written

TOKENIZER = "word_bpe_49k.json"
MAX_TOKENS = 2048
END_ID = 0
GROUP = 16384
#: Bytes of text whose words are looked up at once.
HELD = 1 << 24
#: Weights of tokens, documents and attention cost in the choice of a sequence.
WEIGHTS = (1.0, 0.01, 0.01)

_CACHES: dict[str, "_Words"] = {}


class _Words(dict):
    """Token ids of white-space separated words as little-endian bytes; emptied when it has grown
    to ``limit`` words.

    Words are learned in batches. One that ends in plain punctuation after a letter or digit is
    put together from both parts, which the tokenizer separates anyway. Words of letters only are
    encoded in one run: each is one unit of the tokenizer, whose last token carries the end mark."""

    limit = 1_000_000
    #: Words encoded at once.
    run = 16_384
    tail = b".,!?;:*%&$#|)"

    def __init__(self, path: str) -> None:
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        self.last = np.zeros(max(model["vocab"].values(), default=0) + 4096, bool)
        if mark := model.get("end_of_word_suffix"):
            self.last[[i for t, i in model["vocab"].items() if t.endswith(mark)]] = True

    def _encoded(self, words: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def _of_letters(self, words: list[str]) -> list[bytes]:
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # a letter that the normalizer turns into more than letters
            return self._encoded(words)
        raw, at = ids.tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def learn(self, words: list[bytes]) -> None:
        if len(self) > self.limit:
            self.clear()
        self[b""] = b""
        plain, other, split = set(), {}, []
        for w in words:
            if w in self:
                continue
            if w.isalpha():
                plain.add(w)
                continue
            core = w.rstrip(self.tail)
            if core != w:
                # the last character as the tokenizer normalizes it must be a letter or digit
                if core[-1:].isalnum() or self._ends_plain(core):
                    tail = w[len(core):]
                    split.append((w, core, tail))
                    if tail not in self:
                        other[tail] = tail.decode()
                    if core in self:
                        continue
                    if core.isalpha():
                        plain.add(core)
                        continue
                else:
                    core = w
            text = core.decode("utf-8", "replace")
            if text.isalpha():
                plain.add(core)
            else:
                other[core] = text
        plain, other = list(plain), list(other.items())
        for k in range(0, len(plain), self.run):
            some = plain[k:k + self.run]
            self.update(zip(some, self._of_letters(b" ".join(some).decode("utf-8", "replace").split(" "))))
        for k in range(0, len(other), self.run):
            self.update(zip((w for w, _ in other[k:k + self.run]), self._encoded([t for _, t in other[k:k + self.run]])))
        for w, core, tail in split:
            self[w] = self[core] + self[tail]

    @staticmethod
    def _ends_plain(core: bytes) -> bool:
        end = unicodedata.normalize("NFC", core.decode("utf-8", "replace")[-1:].lower())[-1:]
        return end.isalpha() or end.isdecimal()


def token_bytes(texts: pa.Array, words: "_Words", end_id: int = END_ID) -> tuple[memoryview, np.ndarray]:
    """The ids of all ``texts`` one after the other, four bytes each, with the end id behind each text, and
    the bytes where each text's ids end. A word is looked up once however often the texts have it."""
    texts = pc.fill_null(texts, "")
    # the tokenizer ignores case, but not in the names of its special tokens
    split = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
    seen = split.flatten().dictionary_encode()
    known = seen.dictionary.cast(pa.large_binary()).to_pylist()
    words.learn(known)
    ids = pa.array([*map(words.__getitem__, known), np.array([end_id], "<u4").tobytes()], pa.large_binary())
    until = np.cumsum(pc.list_value_length(split).to_numpy())
    run = ids.take(pa.array(np.insert(seen.indices.to_numpy(), until, len(known))))
    _, offsets, body = run.buffers()
    ends = np.frombuffer(offsets, np.int64)[until + np.arange(1, len(until) + 1)]
    return memoryview(body or b""), ends


def _words(path: str) -> "_Words":
    if path not in _CACHES:  # one tokenizer per Python worker
        _CACHES[path] = _Words(path)
    return _CACHES[path]


def _slices(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``b`` in runs of rows of about ``HELD`` bytes of text; a longer text is a run of its own."""
    bytes_before = np.cumsum(pc.fill_null(pc.binary_length(b.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(bytes_before // HELD)) + 1).tolist(), b.num_rows]
    for a, z in zip(cuts, cuts[1:]):
        if z > a:
            yield b.slice(a, z - a)


def _cut(path: str, size: int, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(path)
        for b in batches:
            for some in _slices(b):
                ids, ends = token_bytes(some.column(1), words)
                begins = ends - np.diff(ends, prepend=0)
                tokens = (ends - begins) // 4
                count = -(-tokens // size)
                doc = np.repeat(np.arange(some.num_rows), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * size
                length = np.minimum(size, tokens[doc] - start)
                at = begins[doc] + 4 * start
                parts = [ids[a:z] for a, z in zip(at.tolist(), (at + 4 * length).tolist())]
                cols = [some.column(0).take(pa.array(doc)), piece, start, length, [zlib.crc32(p) for p in parts]]
                if with_ids:
                    cols.append([p.tobytes() for p in parts])
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")


def pieces(docs: DataFrame, path: str, size: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` tokens of ``docs(doc_id, text)``; only longer documents are cut."""
    ship_package(docs.sparkSession)
    fn, schema = _cut(path, size, with_ids)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(F.col("text")).alias("text")).mapInArrow(fn, schema)


def best_fit(lengths: np.ndarray, max_tokens: int, max_docs: int, max_cost: int,
             weights: tuple = WEIGHTS, rule: str = "norm") -> np.ndarray:
    """The sequence of each piece, ``lengths`` in falling order, under all three capacities."""
    n = len(lengths)
    out = np.empty(n, np.int64)
    cap = np.array([max_tokens, max_docs, max_cost], float)
    w = np.array(weights) / cap
    left = np.empty((3, n))
    name = np.empty(n, np.int64)
    live = made = 0
    smallest = int(lengths.min()) if n else 0
    for i, length in enumerate(lengths):
        ask = np.array([length, 1, float(length) * length])
        pick = -1
        if live:
            r = left[:, :live]
            fits = np.flatnonzero((r[0] >= ask[0]) & (r[1] >= 1) & (r[2] >= ask[2]))
            if len(fits):
                r = r[:, fits]
                if rule == "norm":
                    rest = (r - ask[:, None]) * w[:, None]
                    pick = fits[np.argmin((rest * rest).sum(axis=0))]
                else:
                    pick = fits[np.argmax(((r * w[:, None]) * (ask * w)[:, None]).sum(axis=0))]
        if pick < 0:
            pick, live, made = live, live + 1, made + 1
            left[:, pick], name[pick] = cap, made - 1
        left[:, pick] -= ask
        out[i] = name[pick]
        if left[0, pick] < smallest or left[1, pick] < 1 or left[2, pick] < 1:  # full: nothing fits any more
            live -= 1
            left[:, pick], name[pick] = left[:, live], name[live]
    return out


def _pack(size: int, max_docs: int, max_cost: int, weights: tuple, rule: str):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        lengths = t.column("length").to_numpy()
        seq = best_fit(lengths, size, max_docs, max_cost, weights, rule)
        order = np.argsort(seq, kind="stable")
        before = np.cumsum(lengths[order]) - lengths[order]
        first = np.r_[True, seq[order][1:] != seq[order][:-1]] if len(order) else np.empty(0, bool)
        offset = np.empty(len(seq), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(first, before, 0)) if len(order) else 0
        t = t.drop_columns(["__group"])
        return (t.append_column("sequence_id", pa.array(seq + (key[0].as_py() << 32), pa.int64()))
                .append_column("offset", pa.array(offset, pa.int64())))

    return run


def pack(parts: DataFrame, size: int = MAX_TOKENS, max_docs: int = MAX_TOKENS, max_cost: int = MAX_TOKENS * MAX_TOKENS,
         weights: tuple = WEIGHTS, rule: str = "norm", group: int = GROUP) -> DataFrame:
    """``parts`` (of :func:`pieces`) with sequence_id and offset."""
    parts = written(parts, "pieces")
    groups = parts.count() // group + 1
    dealt = parts.withColumn("__group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    schema = ", ".join(f"{n} {t}" for n, t in parts.dtypes) + ", sequence_id long, offset long"
    return dealt.groupBy("__group").applyInArrow(_pack(size, max_docs, max_cost, weights, rule), schema)


def packed(docs: DataFrame, path: str, **options) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(pieces(docs, path, options.get("size", MAX_TOKENS)), **options)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
