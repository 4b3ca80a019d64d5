"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-proximal).

Features of a text are its words and punctuation runs, one and two in a row, how many repeat the one before, and their shapes (upper, title, lower case,
digits, the punctuation itself), one to three in a row, hashed into 2**BITS places; a value is log(1 + count), scaled to unit
length. The score is the logistic function of a sparse dot product. The model is fitted in one task on a sample of at most
``max_rows`` labelled documents, drawn by a hash of the id, and has a fixed size; scoring reads every whole text.

Edge cases: null and empty texts get the bias' score; without labelled rows all scores are 0.5; null labels and ids of no
document teach nothing; repeated rows are scored alike; of rows that share an id the least text teaches; an empty table gives an empty result;
other columns are kept by ``score_quality`` unless they clash with score and predicted, which are replaced; texts may be of any
length.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, labelled_sample, ship, split_remainder, table

BITS = 18
MAX_ROWS = 6_000
CUT = 0.3
#: Length of a feature vector, against 1 for the bias.
SCALE = 3.0
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 0.02, 0.5, 3
TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


class Hashes(dict):
    """token -> hash of the token * 2**32 + hash of its shape; forgets all when it has grown large."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        c = token[0]
        shape = ("U" if token.isupper() and len(token) > 1 else "T" if c.isupper() else "l") if c.isalpha() else "0" if c.isdigit() else token[:4]
        self[token] = got = crc32(token.lower().encode()) << 32 | crc32(b"shape " + shape.encode())
        return got


_hashes = Hashes()
REPEAT = np.uint64(0x5BD1E9955BD1E995)
MIX, MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text, place 0 being the bias."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.zeros(1, np.int64), np.ones(1, np.float32)
    both = np.fromiter(map(_hashes.__getitem__, tokens), np.uint64, len(tokens))
    w, s = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
    parts = [w * MIX, s * MIX2, (w[:-1] * MIX2 + w[1:]) * MIX, (s[:-1] * MIX + s[1:]) * MIX2, ((s[:-2] * MIX + s[1:-1]) * MIX2 + s[2:]) * MIX, np.full(np.count_nonzero(w[1:] == w[:-1]), REPEAT)]
    all_ = (np.concatenate(parts) >> np.uint64(64 - BITS)).astype(np.int32) + 1
    all_.sort()
    ends = np.flatnonzero(np.concatenate([all_[1:] != all_[:-1], [True]]))
    values = np.log1p(np.diff(ends, prepend=-1).astype(np.float32))
    values *= SCALE / np.sqrt(values @ values)
    return np.concatenate([[0], all_[ends]]), np.concatenate([[np.float32(1)], values])


def sigmoid(x: float) -> float:
    return 1.0 / (1.0 + float(np.exp(-max(-35.0, min(35.0, x)))))


def fit(rows: list[tuple[str | None, int]]) -> np.ndarray:
    """FTRL-proximal weights from (text, label) rows, in the order given."""
    z, n = np.zeros(2**BITS + 1), np.zeros(2**BITS + 1)

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    seen = [(features(t), float(y)) for t, y in rows]
    for _ in range(EPOCHS):
        for (i, x), y in seen:
            w = weights(i)
            g = (sigmoid(float(w @ x)) - y) * x
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    return weights(np.arange(len(z))).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", max_rows: int = MAX_ROWS) -> np.ndarray:
    """The model, fitted on at most ``max_rows`` labelled rows where ``learn`` (a column of doc_id) holds."""
    ordered = labelled_sample(docs, labels, learn, label, max_rows)
    schema = T.StructType([T.StructField("model", T.BinaryType())])

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        order = np.random.default_rng(7).permutation(len(rows))
        yield pa.RecordBatch.from_pydict({"model": pa.array([fit([rows[i] for i in order]).tobytes()], pa.binary())})

    ship(docs.sparkSession)
    found = ordered.mapInArrow(run, schema).collect()  # one row of fixed size
    return np.frombuffer(found[0][0], np.float32) if found else np.zeros(2**BITS + 1, np.float32)


def score_quality(docs: DataFrame, model: np.ndarray, cut: float = CUT) -> DataFrame:
    """``docs`` with score and predicted."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def rows(c: dict[str, list]) -> dict[str, list]:
        w = sent.value
        scores = []
        for text in c["text"]:
            i, x = features(text)
            scores.append(sigmoid(float(w[i] @ x)))
        return c | {"score": scores, "predicted": [int(s >= cut) for s in scores]}

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(docs, rows, schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = split_remainder("doc_id", 5)
    model = train(docs, table(spark, sf_dir, "labels"), r != 0)
    return score_quality(docs, model).select("doc_id", (r == 0).alias("held_out"), "score", "predicted")
