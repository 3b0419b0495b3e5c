"""Quality classifier by co-training: a view of the text and a view of its metadata teach each other."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from insidertrail.llm.common import cut, release_memory, released, table

ROUNDS = 3
CONFIDENT = 0.98  # calibrated probability from which a view's opinion becomes a label for the other
PSEUDO_WEIGHT = 0.3
RIDGE = 1.0
STEPS = 6
CALIBRATION_FOLD = 5  # every fifth labelled document is kept for calibration
BINS = 400
SCORE_RANGE = 20.0
SOURCE_BUCKETS = 32
WORDS = 12
CONTENT = 32 + WORDS  # features of the text
METADATA = 8 + SOURCE_BUCKETS  # features of the metadata
KEEP_FROM = 0.5

_KIND = np.zeros(256, np.int64)  # kind of each byte, for shares of kinds in a text
for _i, _c in enumerate("!#$%&*|.,;:?-'\"()=/@_+<>~^\\", 6):
    _KIND[ord(_c)] = min(_i, 31)
_KIND[[*range(97, 123)]] = 1
_KIND[[*range(65, 91)]] = 2
_KIND[[*range(48, 58)]] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 4
_KIND[128:] = 5


def content_features(text: str | None) -> np.ndarray:
    """Square roots of the shares of kinds of bytes, and how words repeat, shout and carry symbols."""
    raw = (text or "").encode()
    words = raw.split()
    out = np.zeros(CONTENT)
    if not words:
        out[-1] = 1
        return out
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    out[:32] = np.sqrt(np.bincount(_KIND, weights=counts, minlength=32) / len(raw))
    n = len(words)
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    shouted = sum(map(bytes.isupper, words))
    plain = sum(map(bytes.isalpha, words))
    lines = raw.count(b"\n") + 1
    distinct = len(set(words))
    out[32:] = (repeats / n, np.sqrt(repeats / n), shouted / n, plain / n, distinct / n,
                distinct / n ** 0.8, np.log1p(n) / 10, len(raw) / n / 10, np.log1p(n / lines) / 5,
                np.sqrt(sum(w.endswith((b"!!", b"***", b"###", b"$$$", b"%%%", b"&&&")) for w in words) / n),
                np.sqrt(words.count(b"|") / n), 0)
    return out


def metadata_features(lang: str | None, source: str | None, length: int | None, size: int) -> np.ndarray:
    """Source and language by hash, the stated length, and whether it agrees with the text's."""
    out = np.zeros(METADATA)
    stated = max(0, length or 0)
    out[:4] = np.log1p(stated) / 10, length is None, stated != size, (np.log1p(stated) / 10) ** 2
    out[4 + _bucket(lang, 4)] = 1
    out[8 + _bucket(source, SOURCE_BUCKETS)] = 1
    return out


def _bucket(value: str | None, n: int) -> int:
    return hashlib.md5(("=" + value if value is not None else "").encode()).digest()[0] % n


def features(text: Column, lang: Column, source: Column, length: Column) -> Column:
    """Both views of a document as one array of floats, content first."""

    @F.arrow_udf("array<float>")
    def run(text: pa.Array, lang: pa.Array, source: pa.Array, length: pa.Array) -> pa.Array:
        out = np.empty((len(text), CONTENT + METADATA), np.float32)
        for i, (t, *meta) in enumerate(zip(text, lang.to_pylist(), source.to_pylist(), length.to_pylist())):
            t = t.as_py()
            out[i, :CONTENT] = content_features(t)
            out[i, CONTENT:] = metadata_features(*meta, len(t or ""))
        release_memory()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]), pa.array(out.reshape(-1)))

    return run(text, lang.cast("string"), source.cast("string"), length.cast("long"))


VIEWS = (slice(0, CONTENT), slice(CONTENT, CONTENT + METADATA))


class Model:
    """Weights of both views with an intercept each, and the line that calibrates each view's score."""

    def __init__(self):
        self.weights = [np.zeros(v.stop - v.start + 1) for v in VIEWS]
        self.lines = [(1.0, 0.0), (1.0, 0.0)]
        self.prior = 0.0

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, v] @ w[:-1] + w[-1] for v, w in zip(VIEWS, self.weights)]

    def calibrated(self, x: np.ndarray) -> list[np.ndarray]:
        """Log odds of each view."""
        return [a * s + b for (a, b), s in zip(self.lines, self.scores(x))]

    def combined(self, x: np.ndarray) -> np.ndarray:
        """Log odds of both views together; what both take from the prior counts once."""
        one, other = self.calibrated(x)
        return one + other - self.prior


def probability(log_odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(log_odds, -500, 500)))


def _summed(rows: DataFrame, per_batch, size: int) -> np.ndarray:
    """Sum over all documents of a vector of ``size`` numbers that ``per_batch(x, label, fold)`` gives per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                label = batch.column(1).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
                total += per_batch(x, label, batch.column(2).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "value"])

    sums = rows.select("x", "label", "fold").mapInArrow(released(run), "at int, value double").groupBy("at").agg(F.sum("value"))
    out = np.zeros(size)
    for at, value in sums.collect():  # as many rows as the model has numbers
        out[at] = value
    return out


def _fit(rows: DataFrame, model: Model, teacher: Model | None) -> None:
    """Newton steps of both views at once; a view's unlabelled documents get the other view's confident labels."""
    widths = [len(w) for w in model.weights]
    sizes = [n * n + n + 1 for n in widths]
    strict = np.log(CONFIDENT / (1 - CONFIDENT))

    def step(weights, teacher):
        def per_batch(x, label, fold):
            opinions = teacher.calibrated(x) if teacher else None
            out = []
            for v, (view, w) in enumerate(zip(VIEWS, weights)):
                y, weight = np.nan_to_num(label), np.where(np.isnan(label) | (fold == 0), 0.0, 1.0)
                if opinions is not None:
                    other = opinions[1 - v]
                    sure = np.isnan(label) & (np.abs(other) >= strict)
                    y, weight = np.where(sure, other > 0, y), np.where(sure, PSEUDO_WEIGHT, weight)
                z = np.column_stack([x[:, view], np.ones(len(x))])
                p = probability(z @ w)
                out += [((z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ z).ravel(), z.T @ (weight * (y - p)),
                        [weight.sum()]]
            return np.concatenate(out)
        return per_batch

    for _ in range(STEPS):
        sums, largest = _summed(rows, step(list(model.weights), teacher), sum(sizes)), 0.0
        for v, n in enumerate(widths):
            part = sums[sum(sizes[:v]):sum(sizes[:v + 1])]
            ridge = np.diag([RIDGE] * (n - 1) + [1e-6])
            move = np.linalg.solve(part[:n * n].reshape(n, n) + ridge, part[n * n:n * n + n] - ridge @ model.weights[v])
            move *= min(1.0, 10.0 / max(1e-12, np.abs(move).max()))
            model.weights[v] = model.weights[v] + move
            largest = max(largest, np.abs(move).max())
        if largest < 1e-3:
            break


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Platt's line per view, from counts of the scores of the labelled documents that fitting left out."""
    def per_batch(x, label, fold):
        out = np.zeros((2, 2, BINS))
        own = ~np.isnan(label) & (fold == 0)
        for v, s in enumerate(model.scores(x)):
            at = np.clip((s + SCORE_RANGE) * BINS / (2 * SCORE_RANGE), 0, BINS - 1).astype(int)
            np.add.at(out[v], (label[own].astype(int), at[own]), 1)
        return out.ravel()

    counts = _summed(rows, per_batch, 4 * BINS).reshape(2, 2, BINS)
    middles = (np.arange(BINS) + 0.5) * 2 * SCORE_RANGE / BINS - SCORE_RANGE
    bad, good = counts[0].sum(axis=1)
    model.prior = float(np.log((good + 1) / (bad + 1)))
    z = np.column_stack([middles, np.ones(BINS)])
    for v in range(2):
        # Platt's targets: a little short of 0 and 1, so that clean separation does not give endless slopes.
        zeros, ones = counts[v]
        n, y = zeros + ones, (ones * (good + 1) / (good + 2) + zeros / (bad + 2))
        line = np.array([0.0, model.prior])
        for _ in range(50):
            p = probability(z @ line)
            hessian = (z * (n * p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-6])
            move = np.linalg.solve(hessian, z.T @ (y - n * p) - np.array([1e-3, 0]) * line)
            line = line + move * min(1.0, 2.0 / max(1e-12, np.abs(move).max()))
            if np.abs(move).max() < 1e-8:
                break
        model.lines[v] = (float(max(0.0, line[0])), float(line[1]) if line[0] >= 0 else model.prior)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
          source: str = "source", length: str = "n_chars", label: str = "quality", rounds: int = ROUNDS) -> Model | None:
    """A model of both views, or None where no document of one of the two classes has a label.

    All documents take part: those with a label teach, the others get labels from the view that is sure.
    Features are computed once and written to the shared folder; each step of the fit is one pass over
    them, and only sums come to the driver.  Labels other than 0 and 1, contradictory labels of a key, and
    null keys count as no label.
    """
    wanted = (labels.filter(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("__label_key"))
              .agg(F.min(label).alias("label"), F.max(label).alias("__most")).filter("label = __most").drop("__most"))
    x = features(*(F.col(c) for c in (text, lang, source, length)))
    rows = docs.select(F.col(key).alias("__key"), x.alias("x"))
    fold = F.pmod(F.xxhash64("__key"), F.lit(CALIBRATION_FOLD)).cast("int")
    joined = rows.join(wanted, F.col("__key") == F.col("__label_key"), "left")
    kept = cut(joined.select("x", F.col("label").cast("int").alias("label"), fold.alias("fold")), "quality-features")
    seen = {r["label"] for r in kept.filter("fold > 0 and label is not null").select("label").distinct().collect()}
    if seen != {0, 1}:
        return None
    model, teacher = Model(), None
    for _ in range(rounds):
        _fit(kept, model, teacher)
        _calibrate(kept, model)
        teacher = Model()
        teacher.weights, teacher.lines, teacher.prior = list(model.weights), list(model.lines), model.prior
    return model


def quality(model: Model, text: Column, lang: Column, source: Column, length: Column) -> Column:
    """Struct of three probabilities of good quality: by content, by metadata, and combined."""

    @F.arrow_udf("struct<content: double, metadata: double, combined: double>")
    def run(x: pa.Array) -> pa.Array:
        rows = x.flatten().to_numpy().reshape(len(x), CONTENT + METADATA).astype(float)
        one, other = model.calibrated(rows)
        return pa.StructArray.from_arrays([pa.array(probability(p)) for p in (one, other, one + other - model.prior)],
                                          ["content", "metadata", "combined"])

    return run(features(text, lang, source, length))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
             source: str = "source", length: str = "n_chars", **options) -> DataFrame:
    """One row per document: key, content_score, metadata_score, quality_score and keep.

    ``keep`` holds where both views together give good quality at least even odds.  Without a model every
    document is kept and has null scores.  Null and empty texts, and nulls in any other column, have features
    of their own; repeated rows and null keys give a row each; an empty table gives no rows.
    """
    model = train(docs, labels, key, text, lang, source, length, **options)
    if model is None:
        none = F.lit(None).cast("double")
        return docs.select(F.col(key), none.alias("content_score"), none.alias("metadata_score"),
                           none.alias("quality_score"), F.lit(True).alias("keep"))
    scored = docs.select(F.col(key).alias("__key"), quality(model, *(F.col(c) for c in (text, lang, source, length))).alias("__q"))
    return scored.select(F.col("__key").alias(key), F.col("__q.content").alias("content_score"),
                         F.col("__q.metadata").alias("metadata_score"), F.col("__q.combined").alias("quality_score"),
                         (F.col("__q.combined") >= KEEP_FROM).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
              source: str = "source", length: str = "n_chars", **options) -> DataFrame:
    """The documents that ``classify`` keeps, with all their columns."""
    model = train(docs, labels, key, text, lang, source, length, **options)
    if model is None:
        return docs
    verdict = quality(model, *(F.col(c) for c in (text, lang, source, length)))["combined"] >= KEEP_FROM
    return docs.filter(verdict)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
