"""Toxicity: a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two words counts their common subsequences of three letters, gaps allowed: an occurrence that spans s letters
weighs GAP ** (s - 3), up to SPAN letters. So ``idiot``, ``idxiot``, ``i.d.i.o.t`` and a longer word around the same letters
are near each other. A text falls into words; marks inside a word are dropped, digits and signs that stand for letters are
read as letters, and runs of single letters count as one word. Longer words are cut into overlapping pieces of WIDTH letters.

The kernel of two texts follows from that of their words: a text's likeness to a landmark word is that of its nearest word, to the
power POWER, so that a long text of ordinary words stays far from an insult. Landmarks are LANDMARKS words, half of them
drawn from words that stand in toxic texts more often than chance allows, half from words of clean ones; texts that are copies of
others have no say in that. The Nystroem map of the landmarks turns a text into a vector, and a squared-hinge SVM is trained on
the labelled texts' vectors and labels (``max_rows`` texts at most, drawn by a hash of the id), in one task. Its margin goes
through a logistic function fitted on the same texts. Letters outside a to z (other scripts) are hashed into the same triples.

Edge cases: null and empty texts have no words and get the score of such texts; without both labels all scores are 0;
null labels teach nothing; of rows that share an id the least text teaches; repeated rows are scored alike; an empty table gives
an empty result; other columns are ignored, whatever their names; texts may be of any length.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from math import comb, log
from typing import NamedTuple
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, labelled_sample, ship, split_remainder, table

MAX_ROWS = 6_000
CUT = 0.3
WIDTH, SPAN, GAP = 16, 6, 0.6
LANDMARKS, POWER, RIDGE = 128, 4, 1.0
#: Words whose likeness to the landmarks a worker keeps at a time, up to 4 in STEPS steps a unit (2 bytes a landmark; repeated letters make it more than 1).
KEPT, STEPS = 200_000, 16_000
LEET = str.maketrans("013457@$!|+", "oieastasiit")
#: Letters spelled out. An underscore is a mark between letters only, so each text has one reading and lines of marks cost no backtracking.
SINGLES = re.compile(r"(?<![^\W_])(?:[^\W_][\s.\-_*]{1,3}){3,}[^\W_](?![^\W_])")
TRIPLES = [(i, j, k, GAP ** (k - i - 2)) for i in range(WIDTH) for j in range(i + 1, WIDTH) for k in range(j + 1, min(WIDTH, i + SPAN))]
PAIRS = [(i, j) for i in range(WIDTH - 2) for j in range(i + 1, min(WIDTH - 1, i + SPAN - 1))]
#: Length of the feature vector of a word of n letters, repeats apart.
NORM = np.sqrt(np.array([1e-9 + sum(w * w for _, _, k, w in TRIPLES if k < n) for n in range(WIDTH + 1)]))


def _base(c: str) -> str:
    d = unicodedata.normalize("NFKD", c)
    return d[0] if all(map(unicodedata.combining, d[1:])) else c


#: Accented Latin letters as their base letters.
FOLD = {c: _base(chr(c)) for c in range(0xC0, 0x250)}
MARKS = ".,;:!?\"'()[]{}*#%&-_~`<>/\\"


def letters(token: str) -> str:
    """A lower-case word's letters without accents; other marks are dropped, signs that stand for letters are read as such."""
    if not token.isalpha():
        token = token.strip(MARKS)
        if not token.isalpha():
            token = token.translate(LEET) if any(c.isalpha() for c in token) else ""
            token = "".join(c for c in token if c.isalpha())
    return token if token.isascii() else token.translate(FOLD)


def pieces(word: str) -> list[str]:
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - WIDTH // 2, WIDTH // 2)]


def tokens_of(text: str | None) -> set[str]:
    if not text:
        return set()
    text = text.lower()
    plain = text.replace("\n", " ")
    for mark in (". ", ", "):  # most marks at words' ends, so that fewer spellings are met
        plain = plain.replace(mark, " ")
    found = set(plain.split())
    found.update("".join(c for c in m if c.isalnum()) for m in SINGLES.findall(text))
    return found


def codes(words: list[str]) -> np.ndarray:
    """Letters as numbers from 1, one word of at most WIDTH letters a row: a to z as 1 to 26, others by 15 bits of a hash."""
    raw = np.zeros((len(words), WIDTH), np.uint32)
    if words:
        flat = np.array([w.ljust(WIDTH, "\0") for w in words], dtype=f"<U{WIDTH}").view(np.uint32).reshape(len(words), WIDTH)
        raw = np.where(flat == 0, 0, np.where((flat >= 97) & (flat <= 122), flat - 96, 1 + ((flat * np.uint32(0x9E3779B1)) >> np.uint32(17)) % 0x7FFE))
    return raw.astype(np.int32)


def kernel_sums(c: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each word, its feature vector times ``weights`` (one row or number per letter triple), at unit length."""
    out = np.zeros((len(c), *weights.shape[1:]), np.float32)
    n = (c > 0).sum(1)
    order = np.argsort(-n, kind="stable")  # longest first: a triple's words are then a prefix
    c, n = c[order], n[order]
    have = np.searchsorted(-n, -np.arange(WIDTH + 1), side="right")  # words of at least so many letters
    got = np.zeros_like(out)
    c = np.ascontiguousarray(c.T)
    for i, j in PAIRS:
        m = have[j + 2] if j + 2 <= WIDTH else 0
        if not m:
            continue
        pair = ((c[i, :m] << 10) ^ (c[j, :m] << 5)) & 0x7FFF
        for k in range(j + 1, min(WIDTH, i + SPAN)):
            m = have[k + 1]
            if not m:
                break
            got[:m] += np.float32(GAP ** (k - i - 2)) * weights[pair[:m] ^ c[k, :m]]
    got /= NORM[n].reshape(-1, *[1] * (out.ndim - 1))
    out[order] = got
    return out


def feature_rows(words: list[str]) -> np.ndarray:
    """Dense feature vectors of a few words."""
    c = codes(words)
    out = np.zeros((len(words), 1 << 15), np.float32)
    for r, row in enumerate(c):
        n = int((row > 0).sum())
        for i, j, k, w in TRIPLES:
            if k < n:
                out[r, ((row[i] << 10) ^ (row[j] << 5) ^ row[k]) & 0x7FFF] += w
        out[r] /= NORM[n]
    return out


def squared_hinge(z: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; the last column of z is the bias."""
    w = np.zeros(z.shape[1])
    for _ in range(25):
        out = z @ w
        bad = y * out < 1
        zs, cs = z[bad], cost[bad]
        new = np.linalg.solve((zs * cs[:, None]).T @ zs + ridge * np.eye(len(w)), (zs * cs[:, None]).T @ y[bad])
        if np.allclose(new, w, atol=1e-6):
            break
        w = new
    return w


def beyond_chance(toxic: int, clean: int, share: float) -> bool:
    """Whether a word found in so many toxic and clean documents is tied to toxic ones: a binomial tail under 1e-6."""
    n = toxic + clean
    if toxic <= share * n:
        return False
    if n > 200:
        p = toxic / n
        return n * (p * log(p / share) + (1 - p) * log(max(1 - p, 1e-12) / (1 - share))) > 14
    return sum(comb(n, k) * share**k * (1 - share) ** (n - k) for k in range(toxic, n + 1)) < 1e-6


def pair_minima(text: str | None) -> list[tuple[int, int]]:
    """Four least hashes of the text's pairs of neighbouring words, each by another hash function."""
    h = np.fromiter(map(crc32, (text or "").encode().split()), np.uint64)
    pairs = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (h[1:] * np.uint64(0xC2B2AE3D27D4EB4F))
    return [(i, int((pairs * np.uint64(m)).min())) for i, m in enumerate((0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))] if len(pairs) else []


class Likeness:
    """How near words are to the landmarks; keeps what it has worked out for KEPT words, and forgets all when that is full."""

    def __init__(self, landmarks: list[str], kept: int = KEPT):
        self.features = np.ascontiguousarray(feature_rows(landmarks).T)  # triple -> landmarks
        self.rows, self.place, self.kept = np.zeros((1024, len(landmarks)), np.uint16), {}, kept

    def learn(self, tokens: list[str]) -> None:
        new = [t for t in tokens if t not in self.place]
        if len(self.place) + len(new) > self.kept:
            self.place.clear()
            new = tokens
        cut = [[p for p in pieces(letters(t)) if len(p) >= 3] for t in new]
        words = list({p for c in cut for p in c})
        at = {p: i for i, p in enumerate(words)}
        near = np.zeros((len(words) + 1, self.rows.shape[1]), np.uint16)  # the last row is that of no word
        for a in range(0, len(words), 4096):
            near[a : min(a + 4096, len(words))] = np.rint(np.minimum(kernel_sums(codes(words[a : a + 4096]), self.features), 4) * STEPS)
        start = len(self.place)
        while len(self.rows) < start + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[start : start + len(new)] = near[[at[c[0]] if c else len(words) for c in cut]]
        for i, c in enumerate(cut):
            if len(c) > 1:  # a long word is as near as its nearest piece
                self.rows[start + i] = near[[at[p] for p in c]].max(0)
        self.place.update(zip(new, range(start, start + len(new)), strict=True))

    def vectors(self, texts: list[set[str]]) -> np.ndarray:
        """A row for each text, given by its words: its likeness to each landmark."""
        out = np.zeros((len(texts), self.rows.shape[1]), np.uint16)
        step = self.kept // 4
        for first in range(0, len(texts), 128):
            part = texts[first : first + 128]
            every = list(set().union(*part))
            if len(every) > step:
                every.sort()
            for a in range(0, len(every), step):  # one turn, unless the texts are very long
                own = every[a : a + step]
                self.learn(own)
                inside = part if len(every) <= step else [[t for t in p if own[0] <= t <= own[-1]] for p in part]
                for i, tokens in enumerate(inside):
                    if tokens:
                        np.maximum(out[first + i], self.rows[[self.place[t] for t in tokens]].max(0), out=out[first + i])
        return (out.astype(np.float32) / STEPS) ** POWER


class Model(NamedTuple):
    landmarks: list[str]
    weights: np.ndarray  # of the landmarks' likeness, and the bias
    slope: float
    offset: float

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        margin = vectors @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -35, 35)))


def landmarks_of(texts: list[set[str]], rows: list[tuple[str | None, int]], count: int = LANDMARKS) -> list[str]:
    """Words to compare with: half tied to toxic texts, half of clean ones. None if no word is tied to toxic ones."""
    toxic, clean = Counter(), Counter()
    seen: set[tuple[int, int]] = set()
    cut: dict[str, list[str]] = {}
    for tokens, (text, label) in zip(texts, rows, strict=True):
        marks = set(pair_minima(text))
        if len(marks & seen) >= 2:
            continue  # a copy, near or exact, of an earlier text: its words are no new evidence
        seen |= marks
        for t in tokens:
            if t not in cut:
                cut[t] = [p for p in pieces(letters(t)) if len(p) >= 3]
        (toxic if label else clean).update({p for t in tokens for p in cut[t]})
    share = sum(int(y) for _, y in rows) / len(rows)
    tied = sorted((w for w in toxic if beyond_chance(toxic[w], clean[w], share)), key=lambda w: (-toxic[w], w))[: count // 2]
    ordinary = sorted(set(clean) - set(tied))
    np.random.default_rng(11).shuffle(ordinary)
    return tied + ordinary[: count // 2] if tied else []


def fit(rows: list[tuple[str | None, int]]) -> Model | None:
    """The model from (text, label) rows."""
    y = np.array([int(v) for _, v in rows])
    if not 0 < y.sum() < len(y):
        return None
    texts = [tokens_of(text) for text, _ in rows]
    marks = landmarks_of(texts, rows)
    if not marks:
        return None
    z = Likeness(marks).vectors(texts)
    own = feature_rows(marks)
    values, parts = np.linalg.eigh((own @ own.T).astype(float) ** POWER)
    keep = values > 1e-3 * values[-1]
    root = parts[:, keep] / np.sqrt(values[keep])  # the Nystroem map
    x = np.hstack([z @ root, np.ones((len(z), 1))])
    w = squared_hinge(x, 2.0 * y - 1, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())), RIDGE)
    margin = np.column_stack([x @ w, np.ones(len(x))])
    b = np.zeros(2)
    for _ in range(50):  # Newton steps of ridge logistic regression
        p = 1 / (1 + np.exp(-np.clip(margin @ b, -30, 30)))
        step = np.linalg.solve((margin * (p * (1 - p))[:, None]).T @ margin + 1e-2 * np.eye(2), margin.T @ (y - p) - 1e-2 * b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(marks, np.append(root @ w[:-1], w[-1]), float(b[0]), float(b[1]))


def train(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic", max_rows: int = MAX_ROWS):
    """The model, fitted on at most ``max_rows`` labelled rows where ``learn`` (a column of doc_id) holds; None: no model."""
    import pickle

    ordered = labelled_sample(docs, labels, learn, label, max_rows)

    def run(batches):
        import pyarrow as pa

        rows = [r for b in batches for r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
        model = fit(rows) if rows else None
        yield pa.RecordBatch.from_pydict({"model": pa.array([pickle.dumps(model and tuple(model))], pa.binary())})

    ship(docs.sparkSession)
    found = ordered.mapInArrow(run, T.StructType([T.StructField("model", T.BinaryType())])).collect()  # one row of fixed size
    model = pickle.loads(found[0][0]) if found else None
    return model and Model(*model)


def score_toxicity(docs: DataFrame, model: Model | None, cut: float = CUT) -> DataFrame:
    """doc_id, score and predicted for each row of ``docs(doc_id, text)``."""
    sent = docs.sparkSession.sparkContext.broadcast(model and tuple(model))  # LANDMARKS words and as many numbers
    memo: dict[str, Likeness] = {}

    def rows(c: dict[str, list]) -> dict[str, list]:
        scores = [0.0] * len(c["text"])
        if sent.value is not None:
            m = Model(*sent.value)
            if not memo:
                memo["m"] = Likeness(m.landmarks)
            near = memo["m"]
            scores = []
            for at in range(0, len(c["text"]), 128):
                scores += m.scores(near.vectors([tokens_of(t) for t in c["text"][at : at + 128]])).tolist()
        return {"doc_id": c["doc_id"], "score": scores, "predicted": [int(s >= cut) for s in scores]}

    schema = T.StructType([docs.schema["doc_id"], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return arrow_map(docs.select("doc_id", "text"), rows, schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    r = split_remainder("doc_id", 4)
    model = train(docs, table(spark, sf_dir, "labels"), r != 2)
    return score_toxicity(docs, model).select("doc_id", (r == 2).alias("held_out"), "score", "predicted")
