"""Toxicity: a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel compares short stretches of a word (with marks for its start and end) by their common
subsequences of three characters, gaps allowed and discounted by ``DECAY`` per character
spanned. So an insult with letters dropped in or left out, or with an unseen ending, still
shares most subsequences with the insult. A document is toxic when some stretch of it is: its
decision value is the largest over its words.

Training is multiple-instance: a word of a toxic document is only suspected, a word of a
clean document is clean. Character 4-grams found in toxic documents and hardly in clean ones
(near copies counted once) name the first witnesses; then a linear SVM is fitted on Nyström
features (kernel against landmarks, whitened by the landmarks' own kernel matrix), picks new
witnesses in each suspected document, takes the clean stretches it finds hardest as negatives,
and is fitted again. Only words that hold such a 4-gram can be witnesses: a label without a cause
in its text then names no filler word, and the document stays unexplained. Witnesses also enter with a character inserted, so that such forms are
learned. A logistic curve over the documents' values gives the score.

The decision function is a sum over landmarks of kernels that are sums over subsequences, so it
folds exactly into one weight per subsequence: scoring a word is a few table lookups, and
workers keep the values of words they have seen in a bounded cache.

Bounds: the fit sees at most ``MAX_TOXIC`` and ``MAX_CLEAN`` labelled documents, taken by hash of
the id, and within it ``WITNESSES`` positive words, ``INSERTED`` of them also with a character inserted,
``NEGATIVES`` random and ``HARDEST`` hard negative stretches, and ``CANDIDATES`` stretches of either kind that
landmarks are picked from. Everything else covers all documents and whole texts.

Defined results: NULL or empty text has the score of a text without any toxic stretch; NULL or
repeated labels count as no label or once (toxic if any says so); with no usable label of either kind every
score is 0; repeated rows get equal scores; an empty table gives an empty result; other columns are
never read.
"""

from __future__ import annotations

import itertools
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import empty_text, ship_package

MAX_TOXIC = 1000
MAX_CLEAN = 2000
THRESHOLD = 0.3
#: Characters told apart; all others share one code. Codes 0, 1 and 2 are padding, start and end.
ALPHABET = 56
DECAY = 0.7
#: Starts per stretch; with the longest span of 5 a stretch covers eight characters.
STARTS = 4
#: The second and third character of a subsequence, counted from the first.
STEPS = tuple((a, b) for b in (2, 3, 4) for a in range(1, b))
LANDMARKS = 224
#: Bounds of the fit, see above.
WITNESSES, INSERTED, CANDIDATES = 4000, 600, 600
NEGATIVES, HARDEST = 8000, 5000
#: Likelihood ratio and toxic groups that mark a 4-gram; where none passes (few labels), the next pair counts.
MARKED = ((20.0, 3), (8.0, 2), (0.0, 1))
CACHE = 300_000

_SPACED = re.compile(r"(?<!\S)\w(?:[ \t]\w){2,}(?!\S)")


@dataclass
class Model:
    codes: np.ndarray  # the code of every code point
    weights: np.ndarray  # one weight per subsequence of three codes
    bias: float
    slope: float
    offset: float

    def probability(self, value: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * value + self.offset, -50, 50)))


def letters(word: str) -> str:
    return word if word.isalpha() else "".join(filter(str.isalpha, word))


def text_words(text: str) -> list[str]:
    """The words of a text in lower case, split at white space; letters written apart ("a b c") are
    also read as a word. The fit and the scoring both see a text as these words."""
    text = text.lower()
    words = text.split()
    return words + [m[0].replace(" ", "").replace("\t", "") for m in _SPACED.finditer(text)]


def encoded(words: list[str], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All words as codes, one after another with padding between, and where each begins."""
    units = list(map(letters, words))
    text = "\x01" + "\x02\0\0\0\0\x01".join(units) + "\x02\0\0\0\0"
    sizes = np.fromiter(map(len, units), np.int64, len(units)) + 6
    return codes[np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")].astype(np.int32), np.cumsum(sizes) - sizes


def code_table(alphabet: list[str]) -> np.ndarray:
    """The code of every code point: 0 to 2 as they are, then the alphabet, all others last."""
    out = np.full(0x110000, ALPHABET - 1, np.uint8)
    out[:3] = range(3)
    for i, c in enumerate(alphabet[:ALPHABET - 4]):
        out[ord(c)] = i + 3
    return out


def subsequences(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per position and step pair the code of the subsequence that starts there (0: runs into
    padding), and the discount of each step pair."""
    n = len(x)
    y = np.concatenate([x, np.zeros(4, np.int32)])
    out = np.empty((n, len(STEPS)), np.int32)
    for k, (a, b) in enumerate(STEPS):
        c = (x * ALPHABET + y[a:a + n]) * ALPHABET + y[b:b + n]
        c[(x == 0) | (y[a:a + n] == 0) | (y[b:b + n] == 0)] = 0
        out[:, k] = c
    return out, np.array([DECAY ** (b + 1) for _, b in STEPS])


def stretches(values: np.ndarray) -> np.ndarray:
    """Sums of ``STARTS`` following positions, per position."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0)])
    ends = np.minimum(np.arange(len(values)) + STARTS, len(values))
    return total[ends] - total[:-1]


def word_values(words: list[str], model: Model) -> np.ndarray:
    """Decision value of each word: the largest over its stretches."""
    if not words:
        return np.empty(0)
    x, begins = encoded(words, model.codes)
    subs, decay = subsequences(x)
    # column by column: a matrix product may round a word's value by its place among the others
    value = stretches(sum(model.weights[codes] * d for codes, d in zip(subs.T, decay)))
    value[(x == 0) | (x == 2)] = -np.inf
    return np.maximum.reduceat(value, begins) + model.bias


class _Scored(dict):
    """Decision values by word, filled in batches; emptied when it has grown to ``CACHE`` words."""

    def __init__(self, model: Model) -> None:
        super().__init__()
        self.model = model

    def learn(self, words: set[str]) -> None:
        if len(self) > CACHE:
            self.clear()
        new = [w for w in words if w not in self]
        self.update(zip(new, word_values(new, self.model).tolist()))


def text_values(texts: list[str], scored: "_Scored") -> list[tuple[float, str | None]]:
    """Largest decision value of each text and the word that has it."""
    split = [text_words(t) for t in texts]
    scored.learn(set().union(*split) if split else set())
    get = scored.get
    out = []
    for words in split:
        if len(words) and all(w in scored for w in words[:1]):
            best = max(words, key=get)
            out.append((get(best), best))
        else:
            out.append((-np.inf, None))
    return out


# --- fitting, in one task, from the bounded sample -------------------------------------------

def _sketch(words: list[str]) -> list[int]:
    """The smallest hashes of a text's word pairs; near copies share most of them."""
    import zlib
    pairs = (f"{a} {b}" for a, b in zip(words, words[1:])) if len(words) > 1 else words
    return sorted({zlib.crc32(p.encode("utf-8", "replace")) for p in pairs})[:12]


def _copies_once(sketches: list[list[int]]) -> list[int]:
    """A group number per document; documents that share half a sketch or more share one."""
    seen: dict[int, int] = {}
    out = []
    for g, pairs in enumerate(sketches):
        votes = Counter(seen[p] for p in pairs if p in seen)
        group, n = votes.most_common(1)[0] if votes else (g, 0)
        if 2 * n < len(pairs):
            group = g
        for p in pairs:
            seen.setdefault(p, group)
        out.append(group)
    return out


def _grams(word: str, k: int = 4) -> set[str]:
    w = f"^{letters(word)}$"
    return {w[i:i + k] for i in range(len(w) - k + 1)}


def _marked_grams(words: list[set[str]], groups: list[int], toxic: np.ndarray) -> dict[str, float]:
    """4-grams that stand in toxic documents far more than in clean ones: likelihood ratio, by the
    first pair of ``MARKED`` that any passes."""
    found: tuple[Counter, Counter] = (Counter(), Counter())
    cache: dict[str, set[str]] = {}
    n = [len({g for g, t in zip(groups, toxic) if t == k}) for k in (0, 1)]
    order = sorted(range(len(words)), key=lambda i: (toxic[i], groups[i]))
    for (t, _), same in itertools.groupby(order, key=lambda i: (toxic[i], groups[i])):
        grams: set[str] = set()
        for w in set().union(*[words[i] for i in same]):
            if w not in cache:
                cache[w] = _grams(w)
            grams |= cache[w]
        found[t].update(grams)
        if len(cache) > 20_000:
            cache.clear()
    def ll(k: int, m: int, p: float) -> float:
        return (k * np.log(p) if k else 0.0) + ((m - k) * np.log(1 - p) if m > k else 0.0)

    ratios = {}
    for x, a in found[1].items():
        b = found[0][x]
        p, q, r = a / n[1], b / n[0], (a + b) / (n[0] + n[1])
        if p > 4 * q:
            ratios[x] = 2 * (ll(a, n[1], p) + ll(b, n[0], q) - ll(a, n[1], r) - ll(b, n[0], r))
    for least, few in MARKED:
        out = {x: v for x, v in ratios.items() if v >= least and found[1][x] >= few}
        if out:
            return out
    return {}


def _kernel(subs: np.ndarray, codes_of: np.ndarray, table: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Kernel of stretches, given as ``(n, STARTS, steps)`` subsequence codes, with the landmarks."""
    out = np.zeros((len(subs), table.shape[1]))
    for s in range(subs.shape[1]):
        for k in range(subs.shape[2]):
            out += decay[k] * table[codes_of[subs[:, s, k]]]
    return out


def _features(subs: np.ndarray, decay: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Explicit subsequence features of the landmarks: a code index and a ``(codes, landmarks)`` table."""
    used = np.unique(subs)
    used = used[used > 0]
    codes_of = np.zeros(ALPHABET ** 3, np.int32)
    codes_of[used] = np.arange(1, len(used) + 1)
    table = np.zeros((len(used) + 1, len(subs)))
    for k in range(subs.shape[2]):
        for s in range(subs.shape[1]):
            np.add.at(table, (codes_of[subs[:, s, k]], np.arange(len(subs))), decay[k])
    table[0] = 0.0
    return codes_of, table


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Linear SVM with squared hinge loss by Newton steps with halving; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w = np.zeros(x.shape[1])
    reg = np.ones(x.shape[1])
    reg[-1] = 1e-3

    def loss(w: np.ndarray) -> float:
        m = np.maximum(0.0, 1.0 - y * (x @ w))
        return float((reg * w * w).sum() + (cost * m * m).sum())

    now = loss(w)
    for _ in range(rounds):
        m = 1.0 - y * (x @ w)
        a = m > 0
        near = x[a]
        grad = reg * w - near.T @ (cost[a] * y[a] * m[a])
        near *= np.sqrt(cost[a])[:, None]
        step = np.linalg.solve(np.diag(reg) + near.T @ near, grad)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        then = loss(w)
        if now - then < 1e-6 * now:
            break
        now = then
    return w


def _spread(kernel_rows, n: int, wanted: int) -> list[int]:
    """Farthest-first picks of landmarks: each next one has the least kernel with those picked."""
    picks = [0]
    near = kernel_rows(0)
    while len(picks) < min(wanted, n):
        i = int(np.argmin(near))
        if near[i] > 0.999:
            break
        picks.append(i)
        near = np.maximum(near, kernel_rows(i))
    return picks


def fit(texts: list[str], toxic: list[int], rounds: int = 5, seed: int = 5) -> Model | None:
    """A model from labelled documents, or None without usable documents of both kinds."""
    labels = np.array(toxic, int)
    if not len(labels) or labels.min() == labels.max():
        return None
    letters_seen: Counter = Counter()
    for t in texts:
        letters_seen.update(filter(str.isalpha, t.lower()))
    codes = code_table(sorted(letters_seen, key=lambda c: (-letters_seen[c], c)))
    shared: dict[str, str] = {}
    words, sketches = [], []
    for t in texts:
        listed = [shared.setdefault(w, w) for w in text_words(t)]
        sketches.append(_sketch(listed))
        words.append({w for w in listed if letters(w)})
    groups = _copies_once(sketches)
    marked = _marked_grams(words, groups, labels)
    if not marked:
        return None
    rng = np.random.default_rng(seed)
    clean_words = sorted(set().union(*[w for w, t in zip(words, labels) if not t]))
    clean_set = Counter(w for ws, t in zip(words, labels) if not t for w in ws)
    toxic_docs = [sorted(w) for w, t in zip(words, labels) if t]

    x_clean, begin_clean = encoded(clean_words, codes)
    subs_clean, decay = subsequences(x_clean)
    start_clean = np.flatnonzero((x_clean != 0) & (x_clean != 2))

    def at(subs: np.ndarray, starts: np.ndarray) -> np.ndarray:
        padded = np.vstack([subs, np.zeros((STARTS, subs.shape[1]), subs.dtype)])
        return np.stack([padded[starts + s] for s in range(STARTS)], axis=1)

    # first witnesses: in each toxic document the words with the strongest marked 4-gram
    strength = {w: max((marked.get(g, 0.0) for g in _grams(w)), default=0.0) for ws in toxic_docs for w in ws}
    witness: Counter = Counter()
    for ws in toxic_docs:
        top = max((strength[w] for w in ws), default=0.0)
        if top > 0:
            witness.update(w for w in ws if strength[w] >= 0.5 * top and clean_set[w] == 0)
    if not witness:  # every marked word is in some clean document too
        witness.update(w for ws in toxic_docs for w in ws if strength[w] > 0)

    def first_place(word: str) -> int:
        w = f"^{letters(word)}$"
        places = [(marked.get(w[i:i + 4], 0.0), -i) for i in range(max(1, len(w) - 3))]
        return max(0, -max(places)[1] - 1)

    model = None
    hard = np.empty(0, np.int64)
    for r in range(rounds):
        names = [w for w, _ in witness.most_common(WITNESSES)]
        # a character inserted at a place inside: forms that gaps must bridge
        noisy = []
        for w in names[:INSERTED]:
            x = letters(w)
            if len(x) >= 4:
                k = int(rng.integers(2, min(5, len(x))))
                noisy.append(x[:k] + "abcdefghijklmnopqrstuvwxyz"[int(rng.integers(26))] + x[k:])
        pos_words = names + noisy
        x_pos, begin_pos = encoded(pos_words, codes)
        subs_pos, _ = subsequences(x_pos)
        if model is None:
            place = [first_place(w) for w in names] + [0] * len(noisy)
        else:
            value = stretches(model.weights[subs_pos] @ decay)
            value[(x_pos == 0) | (x_pos == 2)] = -np.inf
            place = [int(np.argmax(value[b:e])) for b, e in zip(begin_pos, np.append(begin_pos[1:], len(value)))]
        pos = at(subs_pos, begin_pos + np.array(place))
        random_neg = rng.choice(start_clean, min(NEGATIVES, len(start_clean)), replace=False)
        neg = at(subs_clean, np.unique(np.concatenate([random_neg, hard])))

        # landmarks: spread over the witnesses, and over the negatives (the hardest first)
        def self_kernel(s: np.ndarray):
            codes_of, table = _features(s, decay)
            norm = np.sqrt(np.maximum((table * table).sum(axis=0), 1e-12))
            return lambda i: _kernel(s, codes_of, table[:, i:i + 1], decay)[:, 0] / norm / norm[i]
        some_pos = pos[:CANDIDATES]
        hard_neg = at(subs_clean, hard[:CANDIDATES]) if len(hard) else neg[rng.choice(len(neg), min(CANDIDATES, len(neg)), replace=False)]
        marks = np.concatenate([some_pos[_spread(self_kernel(some_pos), len(some_pos), LANDMARKS // 2)],
                                hard_neg[_spread(self_kernel(hard_neg), len(hard_neg), LANDMARKS // 2)]])
        codes_of, table = _features(marks, decay)
        scale = 1.0 / np.sqrt(STARTS * (decay * decay).sum())  # one length for all stretches
        table = table * scale
        own = _kernel(marks, codes_of, table, decay * scale)
        values, vectors = np.linalg.eigh(own)
        good = values > 1e-6 * values.max()
        white = vectors[:, good] / np.sqrt(values[good])
        k_pos, k_neg = _kernel(pos, codes_of, table, decay * scale), _kernel(neg, codes_of, table, decay * scale)
        x = np.vstack([k_pos @ white, k_neg @ white])
        del k_pos, k_neg
        y = np.r_[np.ones(len(pos)), -np.ones(len(neg))]
        # a witness weighs by the number of documents it speaks for, all together as much as the negatives
        often = np.array([min(witness[w], 30) for w in names] + [1] * len(noisy), float)
        cost = np.concatenate([5.0 * len(neg) * often / often.sum(), np.full(len(neg), 5.0)])
        w = _svm(x, y, np.minimum(cost, 300.0))
        # the sum over landmarks folds into one weight per subsequence
        beta = white @ w[:-1]
        weights = np.zeros(ALPHABET ** 3)
        used = np.flatnonzero(codes_of)
        weights[used] = table[codes_of[used]] @ beta * scale
        model = Model(codes, weights, float(w[-1]), 1.0, 0.0)

        value = stretches(weights[subs_clean] @ decay) + model.bias
        value[(x_clean == 0) | (x_clean == 2)] = -np.inf
        order = np.argsort(-value)[:HARDEST]
        hard = order[value[order] > -1.0]
        witness = Counter()
        known = sorted(set().union(*toxic_docs)) if toxic_docs else []
        value_of = dict(zip(known, word_values(known, model).tolist()))
        for ws in toxic_docs:
            if ws:
                top = max(value_of[x] for x in ws)
                witness.update(x for x in ws if strength[x] > 0 and value_of[x] >= max(0.0, 0.5 * top) and clean_set[x] == 0)
        if not witness:
            break

    # the threshold over documents with the fewest errors (near copies share one weight, a clean
    # document counts double), in the middle of its gap; then the slope of a logistic curve there
    doc_value = np.array([word_values(sorted(ws), model).max(initial=-3.0) for ws in words])
    share = Counter(groups)
    weight = np.array([1.0 / share[g] for g in groups])
    weight *= np.where(labels == 1, 1.0 / weight[labels == 1].sum(), 2.0 / weight[labels == 0].sum())
    x = np.clip(doc_value, -3.0, 3.0)
    order = np.argsort(x)
    v = x[order]
    missed = np.cumsum(np.where(labels[order] == 1, weight[order], 0.0))
    alarms = 2.0 - np.cumsum(np.where(labels[order] == 0, weight[order], 0.0))
    gap = np.append(np.diff(v), 0.0)
    errors = missed + alarms
    k = max(np.flatnonzero(errors <= errors.min() + 1e-9), key=lambda i: gap[i])  # the widest gap among equals
    middle = v[k] + gap[k] / 2
    at_middle = np.log(THRESHOLD / (1 - THRESHOLD))
    slopes = np.linspace(3.0, 12.0, 37)
    t = np.where(labels == 1, 0.99, 0.01)
    p = [1.0 / (1.0 + np.exp(-np.clip(a * (x - middle) + at_middle, -50, 50))) for a in slopes]
    a = slopes[int(np.argmin([-(weight * (t * np.log(q + 1e-12) + (1 - t) * np.log(1 - q + 1e-12))).sum() for q in p]))]
    b = at_middle - a * middle
    model.slope, model.offset = float(a), float(b)
    model.weights = model.weights.astype(np.float32)
    return model


# --- Spark ---------------------------------------------------------------------------------------

def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model | None:
    """Fit, in one task, on a bounded sample of the labelled documents that are not held out."""
    usable = (labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
              .groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.max("toxic").cast("int").alias("__toxic")))
    pick = F.xxhash64("__id")
    ids = (usable.where("__toxic = 1").orderBy(pick, "__id").limit(max_toxic)
           .unionByName(usable.where("__toxic = 0").orderBy(pick, "__id").limit(max_clean)))
    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in batches for r in zip(*[b.column(c).to_pylist() for c in ("__doc", "text", "toxic")]))
        model = fit([t for _, t, _ in rows], [y for _, _, y in rows])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    ship_package(docs.sparkSession)
    sample = (docs.select(F.col("doc_id").cast("long").alias("__doc"), empty_text(F.col("text")).alias("__text"))
              .join(F.broadcast(ids), F.col("__doc") == F.col("__id"))  # at most max_toxic + max_clean ids
              .groupBy("__doc").agg(F.min("__text").alias("text"), F.max("__toxic").alias("toxic"))
              .select("__doc", "text", "toxic"))
    # one task holds the bounded sample, so that the driver gets the model only
    found = sample.repartition(1).mapInArrow(fitted, "model binary").first()
    return pickle.loads(bytes(found[0])) if found else None


def _scores(model, step: int = 256):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        scored = _Scored(m)
        for b in batches:
            texts = b.column("__text")
            found: list = []
            for k in range(0, len(texts), step):
                found += text_values([t or "" for t in texts.slice(k, step).to_pylist()], scored)
            value = np.clip(np.array([v for v, _ in found], float), -3.0, 3.0)
            cols = [b.column(i) for i, n in enumerate(b.schema.names) if n != "__text"]
            names = [n for n in b.schema.names if n != "__text"]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(m.probability(value)), pa.array([w for _, w in found], pa.string())],
                                             names=names + ["__score", "__worst"])

    return run


def score(rows: DataFrame, text: str, model: Model | None) -> DataFrame:
    """``rows`` with ``__score`` and ``__worst`` (the word behind it) of the column ``text``."""
    spark = rows.sparkSession
    ship_package(spark)
    if model is None:
        return rows.withColumn("__score", F.lit(0.0)).withColumn("__worst", F.lit(None).cast("string"))
    shared = spark.sparkContext.broadcast(model)
    schema = rows.schema.add("__score", "double").add("__worst", "string")
    return rows.withColumn("__text", F.col(text)).mapInArrow(_scores(shared), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document of ``docs(doc_id, text)``: doc_id, held_out, score, predicted, worst_word."""
    model = train(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty_text(F.col("text")).alias("text"))
    out = score(rows, "text", model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__score").alias("score"),
                      (F.col("__score") >= threshold).cast("int").alias("predicted"), F.col("__worst").alias("worst_word"))


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents of ``docs`` that score below ``threshold``; all columns stay."""
    model = train(docs, labels)
    rows = docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__body"))
    return score(rows, "__body", model).where(F.col("__score") < threshold).select("__row.*")
