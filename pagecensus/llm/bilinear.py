"""Log-bilinear language model, trained with noise-contrastive estimation and normalised for scoring.

The vocabulary is open. Every word belongs to one of ``CLASSES`` classes: the end of a text has one, the most
frequent words have one each, all others share one with the words of the same ending. A token's probability is
that of its class after the two classes before it, from the neural model, times the word's smoothed share of its
class, from the counts. Each class has one unknown word, so the probabilities of all known and unknown words
sum to 1 after any context.

The model adds up to a predicted vector from the vectors of the two context classes, one matrix per position,
and compares it with the vectors of all classes. Every task trains on its own documents in numpy against noise
drawn from the class frequencies, starting from the same parameters; Spark averages what the tasks return,
weighted by tokens, and the next round goes on from there with other documents. All training documents are read
once. There are ``CLASSES ** 2`` contexts, so a worker normalises all of them with batches of matrix products and
scoring a token is one look-up.

Words are counted by 64-bit hashes: among a billion distinct words, two share one with a chance of 3 percent. Words that make up at least one token in ``FREQUENT`` are at most ``FREQUENT`` many; their counts go to
the workers. All other words are joined with their counts by Spark.

Defined results: a null or empty text has one token, its end. Null ids are held out or not as the text ``''``
is. Repeated rows are counted and scored each. Without training texts all counts are 0 and all classes equally
likely. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import arrow_map, stage

# The model's size: classes, of which so many hold a single frequent word (the end of a text is the first).
CLASSES, SINGLES, DIMS = 256, 96, 32
FREQUENT = 1 << 20
# Training: rounds, tokens a step, noise classes a step, step size, range of the first random vectors.
ROUNDS, STEP_TOKENS, NOISE, RATE, START = 3, 2048, 32, 0.2, 0.1
# Pseudo-count of every word.
PRIOR = 0.1
# A line break is no word, so it can stand for the end of a text.
END = b"\n"
# Distinct words a worker remembers, and sends at a time.
REMEMBERED = 1 << 18

HELD_OUT = "crc32(binary(coalesce(CAST(doc_id AS STRING), ''))) % 10 = 0"


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case (A to Z) and the end. ``bytes.split`` splits at blanks and 0x09 to 0x0D."""
    words = (text or b"").lower().split()
    words.append(END)
    return words


def texts_of(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("text").cast(pa.binary()).to_pylist()


def hash_of(word: bytes) -> int:
    """Signed, as Spark has no unsigned numbers."""
    return xxhash.xxh64_intdigest(word) - 2**63


def ending_class(word: bytes) -> int:
    """The class of words without one of their own, by their last three bytes."""
    return SINGLES + crc32(word[-3:]) % (CLASSES - SINGLES)


# ---- counts ----------------------------------------------------------------------------------

_COUNT = "word_hash long, ending int, n long"


def _count_batch(counts: Counter) -> pa.RecordBatch:
    hashes = np.fromiter((hash_of(w) for w in counts), dtype=np.int64, count=len(counts))
    endings = np.fromiter((ending_class(w) for w in counts), dtype=np.int32, count=len(counts))
    numbers = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
    return pa.record_batch([pa.array(hashes), pa.array(endings), pa.array(numbers)], names=["word_hash", "ending", "n"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()
    for batch in batches:
        for text in texts_of(batch):
            counts.update(words_of(text))
            if len(counts) > REMEMBERED:
                yield _count_batch(counts)
                counts = Counter()
    yield _count_batch(counts)


def word_counts(training: DataFrame) -> DataFrame:
    """``word_hash, ending, n`` of every distinct word of ``training`` (``text``)."""
    counted = arrow_map(training.select("text"), _counted, _COUNT)
    return counted.groupBy("word_hash", "ending").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Counts:
    """What the corpus says about words: ``table`` in the shared folder, the rest small.

    ``hashes`` (ascending), ``numbers`` and ``classes`` describe the frequent words; ``class_tokens`` and
    ``class_words`` all words of each class.
    """

    table: DataFrame
    tokens: int
    words: int
    hashes: np.ndarray
    numbers: np.ndarray
    classes: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray


def _is_frequent(tokens: int) -> str:
    return f"(n >= {tokens}D / {FREQUENT})"


def count_words(training: DataFrame) -> Counts:
    """Count all words and give each its class. At most ``FREQUENT`` words come to the driver."""
    table = stage(word_counts(training), "words")
    tokens, words = table.selectExpr("coalesce(sum(n), 0L)", "count(*)").first()
    end = hash_of(END)
    frequent = table.where(_is_frequent(tokens)).toPandas()
    top = frequent[frequent.word_hash != end].sort_values(["n", "word_hash"], ascending=[False, True])
    singles = [end, *top.word_hash[: SINGLES - 1].tolist()]
    own = {h: number for number, h in enumerate(singles)}
    frequent = frequent.sort_values("word_hash")
    classes = [own.get(h, c) for h, c in zip(frequent.word_hash.tolist(), frequent.ending.tolist(), strict=True)]
    pairs = ", ".join(f"{h}L, {c}" for h, c in own.items())
    per_class = table.groupBy(F.expr(f"coalesce(try_element_at(map({pairs}), word_hash), ending) AS class"))
    sums = per_class.agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("words")).toPandas()
    class_tokens, class_words = np.zeros(CLASSES), np.zeros(CLASSES)
    class_tokens[sums["class"]], class_words[sums["class"]] = sums.tokens, sums.words
    return Counts(
        table, tokens, words, frequent.word_hash.to_numpy(np.int64), frequent.n.to_numpy(np.float64),
        np.array(classes, dtype=np.uint8), class_tokens, class_words,
    )


# ---- texts as classes ------------------------------------------------------------------------


class _Codes(dict):
    """Word -> index of its hash, count and class in arrays that grow with the new words of a batch."""

    def __init__(self, hashes: np.ndarray, numbers: np.ndarray, classes: np.ndarray):
        super().__init__()
        self.frequent = dict(zip(hashes.tolist(), zip(numbers.tolist(), classes.tolist(), strict=True), strict=True))
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.hashes, self.numbers, self.classes = np.empty(0, np.int64), np.empty(0), np.empty(0, np.uint8)
        self.new: list[tuple[int, float, int]] = []

    def __missing__(self, word: bytes) -> int:
        own = hash_of(word)
        number, kind = self.frequent.get(own) or (0.0, ending_class(word))
        self[word] = code = len(self)
        self.new.append((own, number, kind))
        return code

    def grow(self) -> None:
        """Take the new words into the arrays."""
        if self.new:
            hashes, numbers, classes = zip(*self.new, strict=True)
            self.hashes = np.append(self.hashes, np.array(hashes, dtype=np.int64))
            self.numbers = np.append(self.numbers, np.array(numbers))
            self.classes = np.append(self.classes, np.array(classes, dtype=np.uint8))
            self.new = []


_CODED = (
    "uid long, doc_id long, held_out boolean, n_tokens long, n_frequent long, frequent_score double, "
    "classes binary, rare array<long>"
)
_CODED_KINDS = [
    pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.list_(pa.int64()),
]


def encoded(docs: DataFrame, counts: Counts) -> DataFrame:
    """Texts as classes, with the sum over their frequent words and the hashes of all others.

    ``docs`` has ``uid, doc_id, held_out, text``; the words are looked up once for each worker's memory.
    """
    sent = docs.sparkSession.sparkContext.broadcast((counts.hashes, counts.numbers, counts.classes))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _Codes(*sent.value)
        for batch in batches:
            keys = zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "held_out")), strict=True)
            rows = []
            for key, text in zip(keys, texts_of(batch), strict=True):
                words = words_of(text)
                rows.append((*key, np.fromiter(map(codes.__getitem__, words), dtype=np.int64, count=len(words))))
                if len(codes) > REMEMBERED:
                    yield _coded_batch(rows, codes)
                    codes.forget()
                    rows = []
            yield _coded_batch(rows, codes)

    return arrow_map(docs.select("uid", "doc_id", "held_out", "text"), encode, _CODED)


def _coded_batch(rows: list[tuple], codes: _Codes) -> pa.RecordBatch:
    codes.grow()
    hashes, numbers, kinds = codes.hashes, codes.numbers, codes.classes
    scores = np.log10(numbers + PRIOR)
    out = []
    for uid, doc_id, held_out, own in rows:
        known = numbers[own] > 0
        score = float(scores[own[known]].sum())
        out.append((
            uid, doc_id, held_out, len(own), int(known.sum()), score, kinds[own].tobytes(), hashes[own[~known]],
        ))
    columns = zip(*out, strict=True) if out else [[]] * len(_CODED_KINDS)
    names = [f.split()[0] for f in _CODED.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, _CODED_KINDS, strict=True)], names=names)


def streams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The context pairs, the classes they precede, and the text each belongs to; ends stand before a text."""
    sizes = np.array([len(t) for t in texts])
    stream = np.frombuffer(b"".join(b"\0\0" + t for t in texts), dtype=np.uint8).astype(np.int64)
    begins = np.cumsum(sizes + 2) - sizes - 2
    target = np.ones(len(stream), dtype=bool)
    target[begins] = target[begins + 1] = False
    at = np.flatnonzero(target)
    return stream[at - 2] * CLASSES + stream[at - 1], stream[at], np.repeat(np.arange(len(texts)), sizes)


# ---- the model -------------------------------------------------------------------------------

# Rows of the parameter table: vectors of context classes, of predicted classes, the two matrices, the biases.
_PARTS = np.cumsum([0, CLASSES, CLASSES, DIMS, DIMS, CLASSES // DIMS])


class Model:
    """The parameters as one table of rows of ``DIMS`` numbers."""

    def __init__(self, table: np.ndarray):
        self.table = table
        parts = [table[a:b] for a, b in zip(_PARTS, _PARTS[1:])]
        self.context, self.output, self.second, self.first = parts[:4]
        self.bias = parts[4].reshape(-1)

    @classmethod
    def start(cls, shares: np.ndarray) -> Model:
        """Small random vectors, and biases that give each class its share."""
        draw = np.random.default_rng(20240501)
        model = cls(draw.uniform(-START, START, (_PARTS[-1], DIMS)).astype(np.float32))
        model.second[:] = model.first[:] = np.eye(DIMS, dtype=np.float32)
        model.bias[:] = np.log(shares)
        return model

    def log_probabilities(self) -> np.ndarray:
        """Normalised natural logarithms for all pairs of context classes, one row a pair."""
        out = np.empty((CLASSES * CLASSES, CLASSES), dtype=np.float32)
        far, near = self.context @ self.second, self.context @ self.first
        for c in range(CLASSES):
            scores = (far[c] + near) @ self.output.T + self.bias
            scores -= scores.max(axis=1, keepdims=True)
            out[c * CLASSES : (c + 1) * CLASSES] = scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))
        return out


def _sums(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Rows added up by class."""
    order = np.argsort(keys.astype(np.uint8), kind="stable")
    counts = np.bincount(keys, minlength=CLASSES)
    present = np.flatnonzero(counts)
    out = np.zeros((CLASSES, rows.shape[1]), dtype=np.float32)
    out[present] = np.add.reduceat(rows[order], (np.cumsum(counts) - counts)[present], axis=0)
    return out


class Trainer:
    """Steps of noise-contrastive estimation with a step size per parameter (AdaGrad)."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int):
        self.model, self.draw = model, np.random.default_rng(seed)
        self.noise = np.cumsum(shares)
        self.log_noise = (np.log(shares) + np.log(NOISE)).astype(np.float32)
        self.seen = np.full(model.table.shape, 1e-3, dtype=np.float32)

    def step(self, pairs: np.ndarray, classes: np.ndarray) -> None:
        m = self.model
        second, first = pairs // CLASSES, pairs % CLASSES
        predicted = (m.context @ m.second)[second] + (m.context @ m.first)[first]
        drawn = np.minimum(np.searchsorted(self.noise, self.draw.random(NOISE)), CLASSES - 1)
        offset = m.bias - self.log_noise
        true = np.einsum("ij,ij->i", predicted, m.output[classes]) + offset[classes]
        false = predicted @ m.output[drawn].T + offset[drawn]
        # Slopes of the log-likelihood of telling data from noise.
        up = _sigmoid(-true) / np.float32(len(classes))
        down = _sigmoid(false) / np.float32(-len(classes))
        slope = up[:, None] * m.output[classes] + down @ m.output[drawn]
        step = Model(np.zeros_like(m.table))
        step.output[:] = _sums(classes, up[:, None] * predicted)
        np.add.at(step.output, drawn, down.T @ predicted)
        step.bias[:] = np.bincount(classes, up, CLASSES) + np.bincount(drawn, down.sum(axis=0), CLASSES)
        by_second, by_first = _sums(second, slope), _sums(first, slope)
        step.second[:], step.first[:] = m.context.T @ by_second, m.context.T @ by_first
        step.context[:] = by_second @ m.second.T + by_first @ m.first.T
        self.seen += step.table**2
        m.table += RATE * step.table / np.sqrt(self.seen)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -30, 30)))


_TRAINED = "place int, tokens long, " + ", ".join(f"p{i} double" for i in range(DIMS))


def trained(texts: DataFrame, model: Model, shares: np.ndarray, seed: int) -> Model:
    """The mean of what the tasks make of ``model`` with their part of ``texts`` (``classes``), weighted by tokens."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(model.table.copy())
        trainer, tokens = Trainer(own, shares, seed), 0
        for batch in batches:
            listed = batch.column("classes").to_pylist()
            if not listed:
                continue
            pairs, classes, _ = streams(listed)
            order = trainer.draw.permutation(len(classes))
            for begin in range(0, len(order), STEP_TOKENS):
                some = order[begin : begin + STEP_TOKENS]
                trainer.step(pairs[some], classes[some])
            tokens += len(classes)
        if tokens:
            places = pa.array(np.arange(len(own.table), dtype=np.int32))
            weight = pa.array(np.full(len(own.table), tokens))
            columns = [pa.array(own.table[:, i].astype(np.float64)) for i in range(DIMS)]
            yield pa.record_batch([places, weight, *columns], names=[f.split()[0] for f in _TRAINED.split(", ")])

    means = [F.expr(f"sum(p{i} * tokens) / sum(tokens) AS p{i}") for i in range(DIMS)]
    rows = arrow_map(texts.select("classes"), train, _TRAINED).groupBy("place").agg(*means).toPandas()
    if not len(rows):
        return model
    return Model(rows.sort_values("place").drop(columns="place").to_numpy(dtype=np.float32))


@lru_cache(maxsize=1)
def _tables(raw: bytes) -> np.ndarray:
    """One table for the tasks of a worker."""
    return Model(np.frombuffer(raw, dtype=np.float32).reshape(-1, DIMS)).log_probabilities()


def class_scores(texts: DataFrame, model: Model, share_of: np.ndarray) -> DataFrame:
    """``uid, class_score``: log10 of each text's classes in their contexts, with ``share_of`` added for each class."""
    raw = model.table.tobytes()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _tables(raw)
        for batch in batches:
            listed = batch.column("classes").to_pylist()
            if not listed:
                continue
            pairs, classes, owner = streams(listed)
            values = table[pairs, classes] / np.log(10) + share_of[classes]
            sums = np.bincount(owner, values, len(listed))
            yield pa.record_batch([batch.column("uid"), pa.array(sums)], names=["uid", "class_score"])

    return arrow_map(texts.select("uid", "classes"), score, "uid long, class_score double")


# ---- scores ----------------------------------------------------------------------------------


def fit(texts: DataFrame, counts: Counts) -> tuple[Model, np.ndarray]:
    """The model trained on ``texts`` (``uid, classes``) in rounds, and log10 of what divides a word's count in its class."""
    mass = counts.class_tokens + PRIOR * (counts.class_words + 1)
    shares = mass / mass.sum()
    model = Model.start(shares)
    for turn in range(ROUNDS):
        model = trained(texts.where(f"pmod(xxhash64(uid), {ROUNDS}) = {turn}"), model, shares, turn)
    return model, -np.log10(mass)


def scored(docs: DataFrame, held_out: str = HELD_OUT) -> DataFrame:
    """Every text of ``docs`` (``doc_id, text``) with its score; the model learns from those not ``held_out``.

    Returns ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``. The base score is that of the
    smoothed word frequencies alone.
    """
    read = docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text", f"{held_out} AS held_out")
    counts = count_words(read.where("NOT held_out"))
    # The id of a row is fixed by writing it.
    ids = read.selectExpr("monotonically_increasing_id() AS uid", "*")
    rows = stage(encoded(ids, counts), "texts")
    model, shares = fit(rows.where("NOT held_out").select("uid", "classes"), counts)
    rare = rows.selectExpr("uid", "explode(rare) AS word_hash")
    rare = rare.join(counts.table.where(f"NOT {_is_frequent(counts.tokens)}"), "word_hash", "left")
    rare = rare.groupBy("uid").agg(
        F.expr(f"sum(log10(coalesce(n, 0) + {PRIOR}D)) AS rare_score"), F.count("n").alias("n_rare")
    )
    base = float(np.log10(counts.tokens + PRIOR * (counts.words + 1)))
    words = "(frequent_score + coalesce(rare_score, 0D))"
    return (
        rows.drop("classes", "rare")
        .join(class_scores(rows, model, shares), "uid")
        .join(rare, "uid", "left")
        .selectExpr(
            "doc_id", "held_out", "n_tokens", "n_frequent + coalesce(n_rare, 0) AS n_known",
            f"{counts.tokens}L AS train_tokens", f"{words} - n_tokens * {base!r}D AS base_score",
            f"class_score + {words} AS score",
        )
    )
