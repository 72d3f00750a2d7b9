"""Language identification by error-correcting output codes over hashed byte n-grams.

Every language gets a codeword; a linear classifier per bit predicts that bit from the text's letter
n-grams (1 to 3 bytes of the lower-cased text, everything but letters read as one space). A text's
language is the codeword with the least loss summed over bits, each bit weighted by how well its
classifier predicts that language in training. Texts whose two best codewords are close are flagged."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text
from .words import flat, slices

BUCKETS = 1 << 13
_KEEP = np.zeros(256, np.uint8)  # bytes that are not part of a letter read as 0
_KEEP[97:123] = np.arange(97, 123)
_KEEP[128:] = np.arange(128, 256)


def features(col: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first row, last row, matrix): root shares of each n-gram bucket, one row per whole text."""
    col = pc.utf8_lower(col.cast(pa.large_string()))
    for i, j in slices(col, 1_000_000):
        raw, at = flat(col.slice(i, j - i))
        b = _KEEP[raw].astype(np.uint32)
        n = len(b)
        row = np.repeat(np.arange(j - i, dtype=np.int64), np.diff(at)) * BUCKETS
        out = np.zeros((j - i) * BUCKETS, np.float32)
        one, two = np.zeros(n, np.uint32), np.zeros(n, np.uint32)
        one[1:], two[2:] = b[:-1], b[:-2]
        first = np.zeros(n, bool)
        starts = at[:-1][np.diff(at) > 0]
        first[starts] = True
        one[first] = 0
        second = starts + 1
        two[first] = 0
        two[second[second < n]] = 0
        use = (b > 0) | (one > 0)  # runs of other bytes count once
        for code in (b, one * 257 + b, (two * 257 + one) * 257 + b + 77):
            mixed = (code * np.uint32(2654435761)) >> np.uint32(32 - 13)
            out += np.bincount(row[use] + mixed[use], minlength=len(out)).astype(np.float32)
        out = np.sqrt(out.reshape(j - i, BUCKETS))
        out /= np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-9)
        yield i, j, out


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """k codewords of -1 and 1. Up to six languages: every way to split them in two. More: of random
    codes of 15 + 5 log2 k balanced bits, the one whose nearest codewords are farthest apart."""
    if k <= 6:
        bits = [[1 if (c >> i) & 1 else -1 for c in range(1, 2 ** (k - 1))] for i in range(k - 1)]
        return np.array([*bits, [-1] * (2 ** (k - 1) - 1)], np.float32)
    rng, best, far = np.random.default_rng(seed), None, -1
    length = 15 + int(np.ceil(5 * np.log2(k)))
    for _ in range(200):
        half = np.array([1] * (k // 2) + [-1] * (k - k // 2), np.float32)
        code = np.stack([rng.permutation(half) for _ in range(length)], axis=1)
        gaps = code @ code.T
        np.fill_diagonal(gaps, -length)
        if (d := length - gaps.max()) > far:
            best, far = code, d
    return best


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    bias: np.ndarray
    trust: np.ndarray  # languages x bits

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Each row's probability of each language from the loss-weighted distances."""
        margin = np.clip(x @ self.weights + self.bias, -30, 30)
        far = -(np.log1p(np.exp(-margin)) @ (self.trust * (self.code > 0)).T + np.log1p(np.exp(margin)) @ (self.trust * (self.code < 0)).T)
        p = np.exp(far - far.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 150, decay: float = 1e-5) -> Model:
    """Logistic regression of all bits at once, by Nesterov's accelerated gradient; languages weigh alike."""
    code = codewords(len(langs))
    target, share = code[y], 1.0 / np.maximum(np.bincount(y, minlength=len(langs)), 1)
    each = (share[y] / share[y].sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    w_at, b_at, rate = w, b, np.float32(3.5)  # rows have unit length: the gradient's slope is at most 1/2
    for s in range(steps):
        g = -target * each / (1 + np.exp(np.clip(target * (x @ w_at + b_at), -30, 30)))
        w_new, b_new = w_at - rate * (x.T @ g + decay * w_at), b_at - rate * g.sum(axis=0)
        pull = np.float32(s / (s + 3))
        w_at, b_at = w_new + pull * (w_new - w), b_new + pull * (b_new - b)
        w, b = w_new, b_new
    right = ((x @ w + b) * target > 0).astype(np.float32)
    trust = np.stack([right[y == i].mean(axis=0) if (y == i).any() else np.ones(code.shape[1]) for i in range(len(langs))])
    return Model(langs, code, w, b, (trust / trust.sum(axis=1, keepdims=True) * code.shape[1]).astype(np.float32))


def fit(labelled: DataFrame, max_docs: int = 4000, max_languages: int | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", parts: int = 16) -> Model | None:
    """Learns from rows of (id, text, language) whose language and text aren't null.

    ``max_docs`` bounds the sample, spread evenly over the languages (about; at least one row of each is looked
    for): rows enter by a hash of their id and text, equal ones once. Their whole texts are read, in ``parts`` tasks.
    All languages are learnt, or, where ``max_languages`` is given, so many of the commonest. No rows: None."""
    rows = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    commonest = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r.lang: r.n for r in (commonest.limit(max_languages) if max_languages else commonest).collect()}  # a row per language, as the model has
    if not counts:
        return None
    langs = sorted(counts)
    per = max(1, max_docs // len(langs))
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit("draw")), F.lit(1 << 30)) / F.lit(1 << 30)
    chance = F.create_map(*[F.lit(v) for x in langs for v in (x, min(1.0, per / counts[x]))])
    drawn = rows.filter(draw < chance[F.col("lang")]).groupBy("lang", F.xxhash64("doc_id", "text").alias("h")).agg(F.min("text").alias("text"))
    sample = drawn.select("text", "lang").repartition(parts)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, x in features(b.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary()), b.column("lang").slice(i, j - i)], ["x", "lang"])

    got = sample.mapInArrow(vectors, "x binary, lang string").toArrow()  # about max_docs rows of fixed size
    if not got.num_rows:
        return None
    x = np.stack([np.frombuffer(r, np.float16) for r in got.column("x").to_pylist()]).astype(np.float32)
    index = {name: i for i, name in enumerate(langs)}
    return train(x, np.array([index[v] for v in got.column("lang").to_pylist()]), langs)


def predict(docs: DataFrame, model: Model | None, ambiguous_below: float = 0.2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous) of every whole text.

    Null texts, texts without a letter, and all texts where there is no model: ``und``, score 0, not
    ambiguous. ``score`` is the best language's probability; where it leads the next by less than
    ``ambiguous_below`` the row is flagged. Other columns are not read."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: buckets x bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            col = b.column("text")
            has = [t is not None and (t.isalpha() or any(map(str.isalpha, t))) for t in col.to_pylist()]
            langs, scores, close = ["und"] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, bool)
            if m is not None:
                for i, j, x in features(col):
                    p = m.decode(x)
                    top = p.argmax(axis=1)
                    ranked = np.sort(p, axis=1)
                    lead = ranked[:, -1] - (ranked[:, -2] if p.shape[1] > 1 else 0)
                    for r in range(j - i):
                        if has[i + r]:
                            langs[i + r], scores[i + r], close[i + r] = m.langs[top[r]], min(1.0, float(p[r, top[r]])), lead[r] < ambiguous_below
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs), pa.array(scores), pa.array(close)], ["doc_id", "lang_pred", "score", "ambiguous"])

    kept = id_and_text(docs, id_col, text_col)
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
