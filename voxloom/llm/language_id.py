"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies cover all training documents. The weights are fitted on a bounded, documented sample of
labelled documents with the follow-the-regularised-leader rule under elastic-net penalties; a temperature fitted
on parts of the sample, each scored by a fit on the others, calibrates the scores.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SMALL_BATCH, documents, give_back, in_batches, slices, text_slices

#: Hashed features of n-grams of 1 to 3 characters; the model is this large for any corpus.
DIMENSIONS = 1 << 15
ORDERS = (1, 2, 3)
FACTORS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: The sample: the labelled training documents with the so many smallest hashes of doc_id, then of text and language.
SAMPLE = 4000
#: Parts of the sample that take turns in being left out, for calibration.
FOLDS = 5
UNKNOWN = "und"
ROWS = 64


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, feature and count of all n-grams of lower-cased texts, each with a space before and after it."""
    padded = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    codes = np.frombuffer(b"".join(padded), dtype="<u4").astype(np.uint64)
    codes[(codes >= 9) & (codes <= 13)] = 32
    row = np.repeat(np.arange(len(texts)), [len(x) // 4 for x in padded])
    total = np.zeros(len(texts) * DIMENSIONS, dtype=np.int64)
    mixed = np.zeros(len(codes), dtype=np.uint64)
    for k, n in enumerate(ORDERS):
        mixed = codes * np.uint64(FACTORS[0]) if k == 0 else (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * np.uint64(FACTORS[k]) + codes[n - 1 :]
        inside = row[: len(mixed)] == row[n - 1 :]
        slot = ((mixed * np.uint64(FACTORS[1])) >> np.uint64(49)).astype(np.int64)
        total += np.bincount((row[: len(mixed)] * DIMENSIONS + slot)[inside], minlength=len(total))
    at = np.flatnonzero(total)
    return at // DIMENSIONS, at % DIMENSIONS, total[at]


def weighed(row: np.ndarray, feature: np.ndarray, count: np.ndarray, idf: np.ndarray, rows: int) -> np.ndarray:
    """TF-IDF values with unit length for each row."""
    value = (1 + np.log(count)) * idf[feature]
    length = np.sqrt(np.bincount(row, value * value, minlength=rows))
    return value / np.maximum(length, 1e-12)[row]


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """How many documents have each feature, over all of docs, and their number: a table of fixed size."""

    def run(batches):
        seen, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for part in slices(batch, ROWS):
                texts = [t or "" for t in part.column("text").to_pylist()]
                seen += np.bincount(features(texts)[1], minlength=DIMENSIONS)
                rows += len(texts)
        at = np.append(np.flatnonzero(seen), -1)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen[at[:-1]], rows))], names=["feature", "n"])

    found = docs.select("text").mapInArrow(run, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    feature, n = (found.column(c).to_numpy() for c in ("feature", "n"))
    out, some = np.zeros(DIMENSIONS), feature >= 0
    out[feature[some]] = n[some]
    return out, int(n[~some].sum())


def sample_features(docs: DataFrame, size: int) -> list[tuple]:
    """(lang, features, counts) of the sampled rows, repeated rows once: size rows at most.

    A row is bounded by DIMENSIONS, however long its text. The arrays lie in Arrow's buffers: rows of Python numbers
    would take ten times as much of the driver's memory, which keeps it.
    """
    order = {"rank": F.xxhash64("doc_id"), "tie": F.xxhash64("text", "lang")}
    ranked = docs.withColumns(order)
    last = ranked.select("rank", "tie").orderBy("rank", "tie").limit(size).agg(F.max(F.struct("rank", "tie")).alias("x")).first()["x"]
    if last is None:
        return []
    inside = (F.col("rank") < last["rank"]) | ((F.col("rank") == last["rank"]) & (F.col("tie") <= last["tie"]))
    chosen = ranked.filter(inside).groupBy("rank", "tie").agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.first("text").alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                row, feature, count = features([t or "" for t in part.column("text").to_pylist()])
                cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
                pairs = list(zip(cuts, cuts[1:]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("lang"), pa.array([feature[a:b].astype(np.int32) for a, b in pairs], pa.list_(pa.int32())), pa.array([count[a:b].astype(np.int32) for a, b in pairs], pa.list_(pa.int32()))],
                    names=["doc_id", "lang", "feature", "n"],
                )

    rows = []
    for batch in chosen.select("doc_id", "lang", "text").mapInArrow(run, "doc_id long, lang string, feature array<int>, n array<int>").toArrow().to_batches():
        ends = np.cumsum(batch.column("feature").value_lengths().to_numpy())[:-1]
        feature, count = (np.split(batch.column(c).flatten().to_numpy(), ends) for c in ("feature", "n"))
        rows += zip(batch.column("doc_id").to_pylist(), batch.column("lang").to_pylist(), feature, count)
    rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), str(r[1]), r[2].astype(">u2").tobytes()))
    return [r[1:] for r in rows]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(
    docs: DataFrame, sample: int = SAMPLE, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.05, passes: int = 3
) -> Model:
    """Fit on docs (doc_id, text, lang); rows without text or lang teach nothing."""
    docs = in_batches(docs).filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "text", "lang")
    seen, total = document_frequencies(docs)
    idf = np.log((1 + total) / (1 + seen)) + 1
    rows = sample_features(docs, sample)
    languages = sorted({lang for lang, _, _ in rows})
    k = len(languages)
    if not k:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), np.zeros(0), 1.0)
    y = {lang: i for i, lang in enumerate(languages)}
    data = [(y[lang], f, weighed(np.zeros(len(f), dtype=np.int64), f, n, idf, 1)) for lang, f, n in rows]
    del rows
    folds = min(FOLDS, len(data)) if len(data) > 1 else 0
    w = learnt(data, k, folds, alpha, beta, l1, l2, passes)
    model = Model(languages, idf, w[:-1, 0], w[-1, 0], 1.0)
    if folds:
        logits = np.array([v @ w[f, 1 + j % folds] + w[-1, 1 + j % folds] for j, (_, f, v) in enumerate(data)])
        labels = np.array([label for label, _, _ in data])
        options = np.exp(np.linspace(np.log(0.05), np.log(5), 60))
        loss = [-np.log(softmax(logits / t)[np.arange(len(labels)), labels] + 1e-12).mean() for t in options]
        model.temperature = float(options[int(np.argmin(loss))])
    del data
    give_back()
    return model


def learnt(data: list[tuple], k: int, folds: int, alpha: float, beta: float, l1: float, l2: float, passes: int) -> np.ndarray:
    """Weights (feature, fit, language), the bias as last feature, by passes of the follow-the-regularised-leader rule.

    The first fit sees all data, fit i + 1 all but every folds-th row from row i on. They share one walk over the
    data: a row adds nothing to the fit that leaves it out.
    """
    fits = 1 + folds
    z, root = np.zeros((DIMENSIONS + 1, fits * k)), np.zeros((DIMENSIONS + 1, fits * k))

    def shrunk(z: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Zero below the L1 bound, shrunk by L2 and the learning rate otherwise."""
        return (np.clip(z, -l1, l1) - z) / (root / alpha + (beta / alpha + l2))

    seen, truth = np.ones((max(folds, 1), fits, 1)), np.eye(k)
    for i in range(folds):
        seen[i, i + 1] = 0
    for _ in range(passes):
        for j, (label, f, v) in enumerate(data):
            at, x = np.append(f, DIMENSIONS), np.append(v, 1.0)
            old, was = z[at], root[at]
            w = shrunk(old, was)
            error = (softmax((x @ w).reshape(fits, k)) - truth[label]) * seen[j % len(seen)]
            g = np.outer(x, error)
            now = np.sqrt(was * was + g * g)
            z[at] = old + g - (now - was) / alpha * w
            root[at] = now
    return shrunk(z, root).reshape(-1, fits, k)


def judged(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Predicted language and score of each text."""
    lettered = np.array([bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in texts])
    if not lettered.any():
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    row, feature, count = features([t or "" for t in texts])
    value = weighed(row, feature, count, model.idf, len(texts))
    each = range(len(model.languages))
    z = np.stack([np.bincount(row, value * model.weights[feature, j], minlength=len(texts)) for j in each], axis=1)
    p = softmax((z + model.bias) / model.temperature)
    best = p.argmax(axis=1)
    score = np.where(lettered, np.round(p[np.arange(len(texts)), best], 6), 0.0)
    return [model.languages[k] if ok else UNKNOWN for k, ok in zip(best, lettered)], score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score (the calibrated probability of the predicted language) from the text alone.

    A null text, one without a letter, and any text if no language was learned give `und` with score 0. Rows are
    independent: repeated rows and null doc_ids come back as given, an empty table gives no rows, extra columns
    are ignored. Of equal probabilities the first language by name wins.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part in slices(batch, ROWS):
                languages, score = judged(sent.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), pa.array(languages, pa.string()), pa.array(score)],
                    names=["doc_id", "lang_pred", "score"],
                )

    return in_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows of docs, as they are, whose language is recognised with min_score or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("boolean")
    def clear(texts: pa.Array) -> pa.Array:
        out = []
        for part in text_slices(texts, ROWS):
            languages, score = judged(sent.value, part)
            out += [x != UNKNOWN and s >= min_score for x, s in zip(languages, score)]
        return pa.array(out, pa.bool_())

    return in_batches(docs, SMALL_BATCH).filter(clear("text"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def op8_language_id(spark, sf_dir):
    docs = documents(spark, sf_dir)
    model = fit(docs.filter(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
