"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.llm.common import let_go, let_go_driver, pieces_of, table, word_hashes

BUCKET_BITS = 16  # hashed words
RANK = 8
BINS = 8  # of each statistic
SAMPLE = 8_000  # labelled documents that the fit may use, at most
EPOCHS = 8
STATISTICS = (
    "log characters", "log words", "log lines", "mean word length", "upper case", "digits", "white space", "ASCII symbols",
    "bars", "exclamation marks", "beyond ASCII", "distinct words", "words equal to the one before", "most frequent word",
)
_CLASSES = np.zeros((256, 7), np.float32)
_CLASSES[65:91, 0] = 1
_CLASSES[48:58, 1] = 1
_CLASSES[[9, 10, 11, 12, 13, 32], 2] = 1
_CLASSES[[i for i in range(33, 127) if not chr(i).isalnum() and chr(i) not in ".,;:'\"-()"], 3] = 1
_CLASSES[124, 4] = 1
_CLASSES[33, 5] = 1
_CLASSES[128:, 6] = 1


def raw_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For a batch: (document, bucket, weight) of its hashed words, and one row of statistics per document."""
    hashes, offsets = word_hashes(texts)
    n_docs, n_words = len(texts), np.diff(offsets)
    doc = np.repeat(np.arange(n_docs), n_words)
    keys, counts = np.unique((doc << BUCKET_BITS) | (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), return_counts=True)
    of, bucket = keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)
    weight = 1 + np.log(counts)
    norm = np.sqrt(np.bincount(of, weight * weight, n_docs))
    weight = (weight / norm[of]).astype(np.float32)

    letters = np.array([np.bincount(np.frombuffer(t, np.uint8), minlength=256) for t in texts], np.float32).reshape(n_docs, 256)
    size = letters.sum(1)
    share = letters @ _CLASSES / np.maximum(size, 1)[:, None]
    same = np.zeros(len(hashes), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    most = np.zeros(n_docs)
    np.maximum.at(most, of, counts)
    each = np.maximum(n_words, 1)
    stats = np.column_stack([
        np.log1p(size), np.log1p(n_words), np.log1p(letters[:, 10]), (size - letters @ _CLASSES[:, 2]) / each, share,
        np.bincount(of, minlength=n_docs) / each, np.bincount(doc, same, n_docs) / each, most / each,
    ])
    return of, bucket, weight, stats.astype(np.float32)


class FactorisationMachine:
    """w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), squashed to 0..1.

    The pairwise part costs one pass over a document's features for each rank, by the sum-of-squares identity.
    """

    def __init__(self, edges: np.ndarray, seed: int = 7):
        self.edges = edges  # (statistic, inner bin edge)
        n = (1 << BUCKET_BITS) + edges.shape[0] * BINS
        self.w0, self.w = np.float32(0), np.zeros(n, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.01, (n, RANK)).astype(np.float32)

    def rows(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature, value) sorted by document."""
        of, bucket, weight, stats = raw_features(texts)
        binned = np.column_stack([np.searchsorted(e, s, side="right") for e, s in zip(self.edges, stats.T, strict=True)])
        feature = (1 << BUCKET_BITS) + np.arange(binned.shape[1]) * BINS + binned
        doc = np.concatenate([of, np.repeat(np.arange(len(texts)), binned.shape[1])])
        order = np.argsort(doc, kind="stable")
        return doc[order], np.concatenate([bucket, feature.ravel()])[order], np.concatenate([weight, np.full(feature.size, 0.5, np.float32)])[order]

    def raw(self, doc: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        vx = self.v[feature] * value[:, None]
        first = np.searchsorted(doc, np.arange(n))  # every document has features: its statistics
        sums = np.add.reduceat(vx, first, axis=0)
        linear = np.add.reduceat(self.w[feature] * value, first)
        return self.w0 + linear + 0.5 * (sums**2 - np.add.reduceat(vx * vx, first, axis=0)).sum(1), sums, vx

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b in pieces_of(texts):
            z, _, _ = self.raw(*self.rows(texts[a:b]), b - a)
            out[a:b] = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
        return out

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = 0.02, decay: float = 1e-4) -> None:
        """Adam on the log loss; rows are (features, values) of one document each."""
        rng = np.random.default_rng(11)
        params = [self.w, self.v]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        step, bias = 0, [0.0, 0.0]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 128):
                pick = order[at : at + 128]
                doc = np.repeat(np.arange(len(pick)), [len(rows[i][0]) for i in pick])
                feature, value = (np.concatenate([rows[i][k] for i in pick]) for k in (0, 1))
                z, sums, vx = self.raw(doc, feature, value, len(pick))
                step += 1
                err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
                each = err[doc] * value
                seen, inverse = np.unique(feature, return_inverse=True)
                grads = [np.bincount(inverse, each), np.column_stack([np.bincount(inverse, each * (sums[doc, f] - vx[:, f])) for f in range(RANK)])]
                fade = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, (m, s), g in zip(params, moments, grads, strict=True):
                    g = g + decay * p[seen]
                    m[seen] = 0.9 * m[seen] + 0.1 * g
                    s[seen] = 0.999 * s[seen] + 0.001 * g * g
                    p[seen] -= rate * fade * m[seen] / (np.sqrt(s[seen]) + 1e-8)
                g = float(err.sum())
                bias = [0.9 * bias[0] + 0.1 * g, 0.999 * bias[1] + 0.001 * g * g]
                self.w0 -= np.float32(rate * fade * bias[0] / (np.sqrt(bias[1]) + 1e-8))


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_quality(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorisationMachine:
    """A machine fitted on labelled documents that are not held out, at most `sample` of them.

    The sample is the ids with the smallest hashes, so it does not depend on the order or the number of
    partitions. Rows with a null id or label are not used; of several labels of one id the smallest counts.
    Without any label every score is 0.5.
    """
    ids = labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("y"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id")

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t.encode("utf-8", "replace") for t in frame.text]
            for a, b in pieces_of(texts):
                of, bucket, weight, stats = raw_features(texts[a:b])
                cut = np.searchsorted(of, np.arange(b - a + 1))
                yield pd.DataFrame({
                    "doc_id": frame.doc_id.iloc[a:b], "y": frame.y.iloc[a:b],
                    "bucket": [bucket[i:j].astype("<u4").tobytes() for i, j in zip(cut, cut[1:], strict=False)],
                    "weight": [weight[i:j].astype("<f2").tobytes() for i, j in zip(cut, cut[1:], strict=False)],
                    "stats": [s.astype("<f4").tobytes() for s in stats],
                })

    got = chosen.mapInPandas(features, "doc_id long, y int, bucket binary, weight binary, stats binary").toPandas()
    got = got.sort_values(["doc_id", "bucket"]).drop_duplicates("doc_id").reset_index(drop=True)
    if not len(got):
        model = FactorisationMachine(np.zeros((len(STATISTICS), BINS - 1), np.float32))
        model.v[:] = 0
        return model
    stats = np.array([np.frombuffer(s, "<f4") for s in got.stats])
    edges = np.quantile(stats, np.arange(1, BINS) / BINS, axis=0).T.astype(np.float32)
    model = FactorisationMachine(edges)
    binned = np.column_stack([np.searchsorted(e, s, side="right") for e, s in zip(edges, stats.T, strict=True)])
    shown = (1 << BUCKET_BITS) + np.arange(binned.shape[1]) * BINS + binned
    half = np.full(binned.shape[1], 0.5, np.float32)
    rows = [
        (np.concatenate([np.frombuffer(b, "<u4").astype(np.int64), f]), np.concatenate([np.frombuffer(w, "<f2").astype(np.float32), half]))
        for b, w, f in zip(got.bucket, got.weight, shown, strict=True)
    ]
    model.fit(rows, got.y.to_numpy(np.float32))
    return model


def score_quality(df: DataFrame, model: FactorisationMachine, text: str = "text", out: str = "score") -> DataFrame:
    """df plus the machine's score of each text, 0 to 1; a null text scores as an empty one, equal texts alike.

    A column of df with the name `out` is replaced. An empty table stays empty.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == out.lower() and c != text])
    shared = df.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the input's size

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for series in texts:
            yield pd.Series(shared.value.score([(t or "").encode("utf-8", "replace") for t in series]))
        let_go()

    return df.withColumn(out, score(F.col(text)))


def keep_good(documents: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents that score at least `least`, with their columns as they were."""
    model = fit_quality(documents, labels)
    let_go_driver(documents.sparkSession)  # of the sample's features
    scored = score_quality(documents, model, out="__quality")
    return scored.where(F.col("__quality") >= least).drop("__quality")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_quality(documents, table(spark, sf_dir, "labels"))
    let_go_driver(spark)
    return score_quality(documents, model).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
