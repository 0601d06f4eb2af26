"""Quality of documents: a classifier's evidence on the text, combined with what sites are like.

The classifier adds up log odds of words and of a few measures of form, learnt from a bounded sample of
labelled documents. Sites are seen in two levels, host and path. Each site's share of good documents is
a grouped sum of the documents' probabilities, shrunk towards the level above: a site with few documents
keeps the prior, one with many shows its own share (empirical Bayes, with the strength of the prior
estimated from how much sites differ). A document's posterior adds its evidence to its path's log odds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from pagecensus.llm.buckets import text_groups
from pagecensus.llm.common import arrow_map, mixed, prefix_hashes, span_hashes, stage, utf8, word_spans

# The classifier is fitted on at most this many labelled documents, and keeps at most so many features.
SAMPLE_DOCS = 20_000
MAX_FEATURES = 20_000
# A feature counts if its share differs between good and bad documents by so many standard errors.
LEAST_Z = 6.0
LEAST_DOCS = 10
# Longer words also count by so many bytes of their beginning.
STEM_BYTES = 5
SMOOTHING = 0.5
# Reject a document if it is less likely good than this.
THRESHOLD = 0.5

# Words for the classifier: lower case, without the signs around them.
_FOLD = bytes(
    32 if chr(b) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else b + 32 if 65 <= b <= 90 else b for b in range(256)
)
_SIGNS = np.isin(np.arange(256), [ord(c) for c in "#$%&*@^~<>{}\\!"])
_BARS = np.isin(np.arange(256), [ord("|")])
_DIGITS = np.isin(np.arange(256), [ord(c) for c in "0123456789"])
_CAPITALS = np.isin(np.arange(256), list(range(65, 91)))


def _forms(texts: list[bytes]) -> np.ndarray:
    """One feature per measure and text: which range the measure falls into."""
    rows = []
    for text in texts:
        words = text.split()
        data = np.frombuffer(text, dtype=np.uint8)
        count = max(1, len(words))
        counts = np.bincount(data, minlength=256)
        measures = (
            counts[_SIGNS].sum() / count,
            counts[_BARS].sum() / count,
            counts[_DIGITS].sum() / count,
            counts[_CAPITALS].sum() / count,
            (1 - len(set(words)) / count) * min(1, count / 20),
            len(data) / count / 10,
            text.count(b"\n") / count,
        )
        steps = [int(np.searchsorted([0.01, 0.03, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0, 1.5, 3.0], m)) for m in measures]
        rows.append([100 * i + s for i, s in enumerate([*steps, min(11, len(words).bit_length())], start=1)])
    return mixed(np.array(rows, dtype=np.uint64).reshape(len(texts), -1) + np.uint64(1 << 60))


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the distinct features of each text."""
    owners, hashes = [], []
    for begin, some in text_groups(texts):
        joined = b"\n".join(some).translate(_FOLD)
        starts, ends = word_spans(joined)
        doc = np.searchsorted(np.cumsum([len(t) + 1 for t in some]), starts, side="right")
        if len(starts):
            prefix = prefix_hashes(np.frombuffer(joined, dtype=np.uint8))
            hashes.append(span_hashes(prefix, starts, ends))
            owners.append(doc + begin)
            # Compounds and inflections of a rare word have its beginning in common.
            long = ends - starts > STEM_BYTES
            hashes.append(mixed(span_hashes(prefix, starts[long], starts[long] + STEM_BYTES) + np.uint64(1)))
            owners.append(doc[long] + begin)
    forms = _forms(texts)
    hashes.append(forms.ravel())
    owners.append(np.repeat(np.arange(len(texts)), forms.shape[1] if len(texts) else 1))
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


@dataclass(frozen=True)
class Model:
    """Log odds of good against bad: of all documents, and of each feature (sorted by hash)."""

    prior: float
    hashes: np.ndarray
    weights: np.ndarray

    def evidence(self, texts: list[bytes]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        owner, value = features(texts)
        at = np.minimum(np.searchsorted(self.hashes, value), max(0, len(self.hashes) - 1))
        found = self.hashes[at] == value if len(self.hashes) else np.zeros(len(value), dtype=bool)
        return np.bincount(owner[found], weights=self.weights[at[found]], minlength=len(texts))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [utf8(t) for t in batch.column(1).to_pylist()]
        owner, value = features(texts)
        good = np.array(batch.column(0).to_pylist(), dtype=np.int32)[owner]
        yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(good)], ["feature", "good"])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    good: str = "quality = 1 AND toxic = 0",
    sample_docs: int = SAMPLE_DOCS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> Model:
    """The classifier, from ``labels`` (an id and what ``good`` tests) and the texts of ``docs``.

    The sample is the labelled ids with the smallest hashes. Labels that ``good`` cannot decide because
    of a null, and those without a document, are left out. Without any labels all documents are good.
    """
    sample = (
        labels.selectExpr(f"`{id_col}` AS labelled", f"CAST({good} AS INT) AS good")
        .where("labelled IS NOT NULL AND good IS NOT NULL")
        .orderBy(F.xxhash64("labelled"), "labelled")
        .limit(sample_docs)
    )
    # At most sample_docs rows of two numbers each. Copies of a text count once.
    texts = docs.selectExpr(f"`{id_col}` AS labelled", f"`{text_col}` AS text").join(F.broadcast(sample), "labelled")
    texts = stage(texts.select("good", "text").dropDuplicates(["text"]), "labelled")
    rows = arrow_map(texts, _featured, "feature long, good int")
    counted = stage(rows.groupBy("feature").agg(F.count("*").alias("n"), F.sum("good").alias("n_good")), "features")
    totals = texts.agg(F.count("*").alias("n"), F.sum("good").alias("n_good")).first()
    good_docs, bad_docs = totals.n_good or 0, totals.n - (totals.n_good or 0)
    if not good_docs or not bad_docs:
        return Model(6.0 if not bad_docs else -6.0, np.empty(0, dtype=np.uint64), np.empty(0))
    share_good, share_bad = f"n_good / {good_docs}", f"(n - n_good) / {bad_docs}"
    pooled = f"(n / {good_docs + bad_docs})"
    error = f"sqrt({pooled} * (1 - {pooled}) * ({1 / good_docs} + {1 / bad_docs}) + 1e-12)"
    kept = (
        counted.where(f"n >= {LEAST_DOCS}")
        .withColumn("z", F.expr(f"abs({share_good} - {share_bad}) / {error}"))
        .where(f"z >= {LEAST_Z}")
        .orderBy(F.desc("z"), "feature")
        .limit(MAX_FEATURES)
        .select("feature", "n", "n_good")
        .collect()
    )
    hashes = np.array([r.feature for r in kept], dtype=np.int64).view(np.uint64)
    n, n_good = (np.array([r[i] for r in kept], dtype=float) for i in (1, 2))
    weights = np.log((n_good + SMOOTHING) / (good_docs + 2 * SMOOTHING)) - np.log(
        (n - n_good + SMOOTHING) / (bad_docs + 2 * SMOOTHING)
    )
    order = np.argsort(hashes)
    return Model(float(np.log(good_docs / bad_docs)), hashes[order], weights[order])


def _evidenced(model: Model):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.evidence([utf8(t) for t in batch.column(0).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.float64())], ["_row", "_evidence"])

    return score


def with_evidence(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows with ``_evidence``, the classifier's log odds; a null text is an empty one."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != "_evidence"]
    rows = docs.select(F.col(f"`{text_col}`").alias("_text"), F.struct(*own).alias("_row"))
    schema = StructType([rows.schema["_row"], StructField("_evidence", DoubleType())])
    return arrow_map(rows, _evidenced(model), schema).select("_row.*", "_evidence")


def _strength(level: DataFrame, above: str) -> float:
    """How many documents the level above is worth, from how much the sites' shares differ."""
    row = level.agg(
        F.sum("n").alias("n"),
        F.sum(F.expr(f"n * pow(total / n - {above}, 2)")).alias("between"),
        F.sum(F.expr(f"{above} * (1 - {above})")).alias("chance"),
        F.sum(F.expr(f"n * {above} * (1 - {above})")).alias("spread"),
    ).first()
    if not row.n or not row.spread:
        return 1e4
    # Sites differ by chance even if they are alike; only what is beyond that weakens the prior.
    excess = max(float(row.between) - float(row.chance), 0) / float(row.spread)
    return float(min(1e4, max(1.0, 1 / excess - 1 if excess > 0 else 1e4)))


def site_shares(evidence: DataFrame, model: Model, host: str, path: str) -> DataFrame:
    """``_host, _path, host_share, path_share``: shrunk shares of good documents; nulls are a site."""
    prior = float(1 / (1 + np.exp(-model.prior)))
    probable = f"1 / (1 + exp(-greatest(-30, least(30, _evidence + {model.prior}))))"
    paths = stage(
        evidence.selectExpr(f"{host} AS _host", f"{path} AS _path", f"{probable} AS p")
        .groupBy("_host", "_path")
        .agg(F.count("*").alias("n"), F.sum("p").alias("total")),
        "paths",
    )
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    strength = _strength(hosts, str(prior))
    hosts = hosts.selectExpr("_host AS h", f"(total + {strength} * {prior}) / (n + {strength}) AS host_share")
    both = stage(paths.join(hosts, F.expr("_host <=> h")).drop("h"), "sites")
    strength = _strength(both, "host_share")
    return stage(
        both.selectExpr(
            "_host", "_path", "host_share", f"(total + {strength} * host_share) / (n + {strength}) AS path_share"
        ),
        "site-shares",
    )


def posteriors(
    docs: DataFrame, model: Model, host: str = "source", path: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The rows with ``_evidence, _host_share, _path_share, _good``, the probability of being good.

    ``host`` and ``path`` are columns or SQL expressions that name a document's site. The shares of the
    sites are a table; Spark broadcasts it only if it is small. Null sites are sites like others; rows
    repeat as given; an empty table gives no rows; columns with the added names are replaced. Other columns
    may have any names.
    """
    own = [c for c in docs.columns if c not in ("_evidence", "_host_share", "_path_share", "_good")]
    scored = with_evidence(docs.select(*[F.col(f"`{c}`") for c in own]), model, text_col)
    shares = site_shares(scored, model, host, path)
    odds = "_evidence + ln(path_share / (1 - path_share))"
    # Names of their own for both sides: the documents may have columns called like the shares'.
    mark = f"_{uuid.uuid4().hex}"
    shares = shares.withColumnsRenamed({c: c + mark for c in shares.columns})
    keyed = scored.withColumns({f"_h{mark}": F.expr(host), f"_p{mark}": F.expr(path)})
    odds = odds.replace("path_share", f"path_share{mark}")
    joined = keyed.join(shares, F.expr(f"_h{mark} <=> _host{mark} AND _p{mark} <=> _path{mark}"))
    return joined.selectExpr(
        *[f"`{c}`" for c in own],
        "_evidence",
        f"host_share{mark} AS _host_share",
        f"path_share{mark} AS _path_share",
        f"1 / (1 + exp(-greatest(-30, least(30, {odds})))) AS _good",
    )


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that are likelier good than ``threshold``, with their columns unchanged, whatever their names."""
    added = ("_evidence", "_host_share", "_path_share", "_good")
    put_away = {c: f"{c}_{uuid.uuid4().hex}" for c in docs.columns if c in added}
    judged = posteriors(docs.withColumnsRenamed(put_away), fit(docs, labels))
    return judged.where(f"_good >= {threshold}").select(
        *[F.col(f"`{put_away.get(c, c)}`").alias(c) for c in docs.columns]
    )
