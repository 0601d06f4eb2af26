"""The language model: counts and base scores by recount, normalisation, gradients, held-out gain."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pagecensus.llm import bilinear
from pagecensus.llm.common import load

SCHEMA = "doc_id long, text string"


def words(text):
    """Words by hand: ASCII lower case, split at blanks and 0x09 to 0x0D only."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for space in "\t\n\x0b\x0c\r":
        lower = lower.replace(space, " ")
    return [w for w in lower.split(" ") if w] + ["<end>"]


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def recounted(rows):
    counts = Counter()
    for doc_id, text in rows:
        if not held_out(doc_id):
            counts.update(words(text))
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for doc_id, text in rows:
        own = words(text)
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        out.append((doc_id, held_out(doc_id), len(own), sum(counts[w] > 0 for w in own), total, base))
    return out


def check(scored, rows):
    got = sorted(scored.collect(), key=lambda r: (repr(r.doc_id), r.n_tokens, r.base_score))
    want = sorted(recounted(rows), key=lambda r: (repr(r[0]), r[2], r[5]))
    assert len(got) == len(want)
    for r, w in zip(got, want, strict=True):
        assert (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:5]
        assert r.base_score == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert math.isfinite(r.score) and r.score <= 0


def test_odd_texts(spark):
    rows = [
        (1, "The cat THE Cat sat\x0bon mats"), (2, None), (3, ""), (4, " \t\r\n"), (None, "no id"), (None, None),
        (5, "ÄRGER ärger"), (5, "ÄRGER ärger"), (6, "same words " * 5000), (7, "a\x00b \U0001f600 \x85x"),
    ]
    rows += [(i, f"common words and w{i}") for i in range(10, 60)]
    check(bilinear.scored(spark.createDataFrame(rows, SCHEMA).repartition(3)), rows)


def test_no_texts_and_more_columns(spark):
    assert bilinear.scored(spark.createDataFrame([], SCHEMA)).collect() == []
    more = [(i, f"word {i % 7}", "x", 1, 2, 3.0) for i in range(30)]
    schema = SCHEMA + ", uid string, held_out int, n int, rare double"
    check(bilinear.scored(spark.createDataFrame(more, schema)), [r[:2] for r in more])
    alone = [i for i in range(200) if held_out(i)][:2]  # nothing to learn from
    rows = [(i, "some words") for i in alone]
    check(bilinear.scored(spark.createDataFrame(rows, SCHEMA)), rows)


def test_rare_words_take_the_join(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "FREQUENT", 8)
    monkeypatch.setattr(bilinear, "REMEMBERED", 16)
    rows = [(i, " ".join(f"w{(i * j) % 37}" for j in range(30))) for i in range(80)]
    check(bilinear.scored(spark.createDataFrame(rows, SCHEMA).repartition(4)), rows)


def test_probabilities_sum_to_one():
    draw = np.random.default_rng(3)
    model = bilinear.Model.start(np.full(bilinear.CLASSES, 1 / bilinear.CLASSES))
    model.table[:] = draw.normal(0, 1, model.table.shape)
    sums = np.exp(model.log_probabilities().astype(float)).sum(axis=1)
    assert np.abs(sums - 1).max() < 1e-4


def test_score_is_the_sum_over_tokens(spark):
    """Class of each token after the two before it, times its share of the class, from the parts."""
    rows = [(i, " ".join(f"w{(i + j * j) % 23}" for j in range(25))) for i in range(60)]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("doc_id AS uid", "doc_id", f"{bilinear.HELD_OUT} AS held_out", "text")
    counts = bilinear.count_words(docs.where("NOT held_out"))
    coded = bilinear.encoded(docs, counts)
    model, shares = bilinear.fit(coded.where("NOT held_out").select("uid", "classes"), counts)
    got = {r.uid: r.class_score for r in bilinear.class_scores(coded, model, shares).collect()}
    table = model.log_probabilities()
    for r in coded.collect():
        kinds = [0, 0, *r.classes]
        want = sum(float(table[a * bilinear.CLASSES + b, c]) / math.log(10) + shares[c] for a, b, c in zip(kinds, kinds[1:], kinds[2:]))
        assert got[r.uid] == pytest.approx(want, rel=1e-6)
    # The shares of a class and its unknown word sum to 1.
    for c in set(counts.classes.tolist()):
        inside = (counts.numbers[counts.classes == c] + bilinear.PRIOR).sum() + bilinear.PRIOR
        assert inside * 10 ** shares[c] == pytest.approx(1)


def test_steps_follow_the_slope():
    """A step changes every parameter as the numeric derivative of the objective says."""
    draw = np.random.default_rng(5)
    shares = draw.dirichlet(np.ones(bilinear.CLASSES))
    start = bilinear.Model.start(shares)
    pairs, classes = draw.integers(0, bilinear.CLASSES**2, 40), draw.integers(0, bilinear.CLASSES, 40)

    def objective(table):
        model, noise = bilinear.Model(table), np.random.default_rng(9).random(bilinear.NOISE)
        drawn = np.minimum(np.searchsorted(np.cumsum(shares), noise), bilinear.CLASSES - 1)
        offset = model.bias - np.log(shares) - np.log(bilinear.NOISE)
        r = model.context[pairs // bilinear.CLASSES] @ model.second + model.context[pairs % bilinear.CLASSES] @ model.first
        true = (r * model.output[classes]).sum(axis=1) + offset[classes]
        false = r @ model.output[drawn].T + offset[drawn]
        return (-np.log1p(np.exp(-true)) - np.log1p(np.exp(false)).sum(axis=1)).mean()

    trainer = bilinear.Trainer(bilinear.Model(start.table.copy()), shares, 9)
    trainer.step(pairs, classes)
    moved = trainer.model.table - start.table
    wide = start.table.astype(float)
    for place in [(int(classes[0]), 3), (bilinear.CLASSES + int(classes[1]), 7), (2 * bilinear.CLASSES + 4, 5), (2 * bilinear.CLASSES + 40, 1)]:
        up, down = wide.copy(), wide.copy()
        up[place] += 1e-5
        down[place] -= 1e-5
        slope = (objective(up) - objective(down)) / 2e-5
        want = bilinear.RATE * slope / math.sqrt(1e-3 + slope**2)
        assert moved[place] == pytest.approx(want, rel=0.05, abs=2e-6)


def test_better_than_frequencies_on_held_out_texts(spark):
    rows = bilinear.scored(load(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    tokens = sum(r.n_tokens for r in rows)
    assert sum(r.score for r in rows) / tokens > sum(r.base_score for r in rows) / tokens + 0.08
