"""Toxicity by a counterfactually regularised linear classifier on words and word stems.

Features are the presence of a word or of a word's first 4, 5 or 6 bytes. Every labelled sentence has
counterfactual copies. Where it mentions a group, the mention is swapped for another of its kind, and
for a neutral word that has no features; where it mentions none, a mention is put in, and in another
copy a second one of the same kind. The squared change of the score's logit is penalised, so what the
classifier learns rests neither on which group is named nor on a group's being named."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import id_and_text, materialise, roomy
from .words import U, Words, mix, slices

#: Group mentions that may be swapped for one another, by kind.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "african", "european"), ("gay", "lesbian", "bisexual", "straight", "transgender"),
    ("immigrants", "natives", "foreigners", "refugees"), ("immigrant", "native", "foreigner", "refugee"), ("disabled", "blind", "deaf"), ("old", "young", "elderly"),
)
PREFIXES = (4, 5, 6)
_SALT = [U(s) for s in (0, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def _lower(col: pa.Array) -> pa.Array:
    return pc.utf8_lower(col.cast(pa.large_string()))


def _codes(w: Words) -> list[np.ndarray]:
    """For each kind of feature, each word's code."""
    return [w.hash ^ _SALT[0], *(w.prefix_hash(n) ^ s for n, s in zip(PREFIXES, _SALT[1:], strict=True))]


def word_codes(word: str) -> np.ndarray:
    return np.array([c[0] for c in _codes(Words(_lower(pa.array([word])), alnum=True))], np.uint64)


@dataclass
class Model:
    codes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float
    pairs: int = 0  # counterfactual copies learnt from
    seen: np.ndarray | None = None  # which low bits of codes occur

    def ready(self) -> Model:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.codes & U((1 << 20) - 1)).astype(np.int64)] = True
        return self

    def logits(self, col: pa.Array) -> np.ndarray:
        """Of each whole text of the column."""
        out, col = np.full(len(col), self.bias), _lower(col)
        for i, j in slices(col):
            w = Words(col.slice(i, j - i), alnum=True)
            row, found = w.row_of(), []
            for c in _codes(w):
                at = np.flatnonzero(self.seen[(c & U((1 << 20) - 1)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.codes, c[at]), len(self.codes) - 1)
                same = self.codes[k] == c[at]
                found.append(row[at[same]] * len(self.codes) + k[same])
            pairs = np.unique(np.concatenate(found))
            np.add.at(out, i + pairs // len(self.codes), self.weights[pairs % len(self.codes)])
        return out


def _presence(rows: list[np.ndarray], n: int) -> np.ndarray:
    """A row of 0 and 1 for each array of feature numbers."""
    x = np.zeros((len(rows), n), np.float32)
    for i, r in enumerate(rows):
        x[i, r] = 1
    return x


def train(codes: np.ndarray, sets: list[np.ndarray], gone: list[np.ndarray], come: list[np.ndarray], y: np.ndarray, fairness: float, decay: float = 1e-3, steps: int = 400) -> Model:
    """Logistic regression on the presence of features, classes weighed alike.

    ``sets``: each document's features as places in ``codes``; ``gone`` and ``come``: what each counterfactual copy
    loses and gains. ``fairness`` weighs the mean squared logit change over the copies."""
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    x, change = _presence(sets, len(codes)), _presence(come, len(codes)) - _presence(gone, len(codes))
    change = change[change.any(axis=1)]  # of others the change is 0
    each = np.where(y == 1, 0.5 / n1, 0.5 / n0).astype(np.float32)
    w, b = np.zeros(len(codes), np.float32), np.float32(0)
    m, v = np.zeros(len(codes) + 1, np.float32), np.zeros(len(codes) + 1, np.float32)
    for s in range(1, steps + 1):  # Adam
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - y).astype(np.float32) * each
        gw = x.T @ g + decay * w / len(codes)
        if len(change):
            gw += 2 * fairness / len(change) * (change.T @ (change @ w))
        g = np.append(gw, g.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**s)) / (np.sqrt(v / (1 - 0.999**s)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    return Model(codes, w.astype(np.float64), float(b), len(gone)).ready()


def _features(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each text's codes, a column for a word."""
    col = _lower(texts)
    for i, j in slices(col):
        w = Words(col.slice(i, j - i), alnum=True)
        codes = np.stack(_codes(w))
        for a, z in zip(w.rows[:-1], w.rows[1:], strict=True):
            yield codes[:, a:z]


def copies(own: np.ndarray, terms: list[list[np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What each counterfactual copy of a text loses and gains. ``terms``: by kind, the codes of each mention."""
    kind_of = {int(t[0]): (k, n) for k, group in enumerate(terms) for n, t in enumerate(group)}
    named = np.flatnonzero(np.isin(own[0], np.array(list(kind_of), np.uint64)))
    every = np.unique(own)
    if len(named):
        rest = np.unique(np.delete(own, named, axis=1))
        swaps = [terms[k][(n + 1) % len(terms[k])] for k, n in (kind_of[int(own[0, at])] for at in named)]
        new = np.unique(np.concatenate([rest, *swaps]))
        return [(np.setdiff1d(every, new), np.setdiff1d(new, every)), (np.setdiff1d(every, rest), every[:0])]
    if not terms:
        return []
    group = terms[int(every.sum(dtype=np.uint64) % U(len(terms)))]  # drawn by what the text holds
    one = int(mix(every.sum(dtype=np.uint64, keepdims=True))[0] % U(len(group)))
    return [(every[:0], np.setdiff1d(group[n % len(group)], every)) for n in (one, one + 1)]


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_features: int = 2048, min_docs: int = 3, min_z: float = 3.0, fairness: float = 1.0, identity_terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Learns from ``labels`` (id, 0/1) of ``docs``. None where a class has no document.

    Null labels and texts are left out; of several labels of an id the highest counts, and rows that repeat
    an id are each learnt from. ``max_docs`` bounds the sample (half of each label, as far as there are; drawn by a hash
    of the id): its ids are sent to the tasks that read the texts. Features are counted in the sample's whole texts by a shuffle;
    those that occur in ``min_docs`` documents of label 1 and are commoner there by ``min_z`` standard errors count, at most
    ``max_features``, and the codes of group mentions regardless. Only each document's places among them reach the driver."""
    marks = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("y"))
    counts = {r.y: r.n for r in marks.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        return None
    draw = F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) / F.lit(1 << 30)
    chance = F.when(F.col("y") == 1, min(1.0, max_docs / 2 / counts[1])).otherwise(min(1.0, max_docs / 2 / counts[0]))
    chosen = marks.filter(draw < chance).limit(2 * max_docs)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("text is not null").join(F.broadcast(chosen), "doc_id").select("text", "y").limit(2 * max_docs)
    sample = materialise(sample, "labelled").repartition(docs.sparkSession.sparkContext.defaultParallelism)
    have = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(have) < 2:
        return None

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = b.column("y").to_numpy()
            for label in (0, 1):
                some = b.filter(pa.array(y == label)).column("text")
                if len(some):
                    codes, n = np.unique(np.concatenate([np.unique(own) for own in _features(some)]), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n * label), pa.array(n * (1 - label))], ["code", "k1", "k0"])

    n1, n0 = have[1], have[0]
    found = sample.mapInArrow(roomy(count), "code long, k1 long, k0 long").groupBy("code").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    p = (F.col("k1") + F.col("k0") + 1) / (n1 + n0 + 2)
    z = (F.col("k1") / n1 - F.col("k0") / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
    good = found.filter(F.col("k1") >= min_docs).withColumn("z", z).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "code").limit(max_features)
    terms = [[word_codes(t) for t in group] for group in identity_terms]
    always = [c for group in terms for t in group for c in t.tolist()]
    codes = np.unique(np.array([*[r.code & (2**64 - 1) for r in good.select("code").collect()], *always], np.uint64))

    def places(some: np.ndarray) -> bytes:
        return np.flatnonzero(np.isin(codes, some)).astype(np.int32).tobytes()

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets, gone, come = [], [], []
            for own in _features(b.column("text")):
                sets.append(places(own))
                changes = copies(own, terms)
                gone.append([places(x) for x, _ in changes])
                come.append([places(x) for _, x in changes])
            lists = pa.list_(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(sets, pa.binary()), pa.array(gone, lists), pa.array(come, lists), b.column("y")], ["features", "gone", "come", "y"])

    got = sample.mapInArrow(roomy(vectors), "features binary, gone array<binary>, come array<binary>, y int").toArrow()  # rows and features are bounded
    as_places = lambda column: [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    flat_ = lambda column: as_places(pc.list_flatten(column))
    return train(codes, as_places(got.column("features")), flat_(got.column("gone")), flat_(got.column("come")), got.column("y").to_numpy(), fairness)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score from 0 to 1, predicted: 1 from ``threshold``) of every whole text.

    Null or empty text: the score of a text without features. No model: 0.0. Other columns are not read."""
    rows = id_and_text(docs, id_col, text_col)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features weights and a bitmap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            p = np.zeros(b.num_rows) if m is None else 1 / (1 + np.exp(-np.clip(m.logits(b.column("text")), -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return rows.mapInArrow(roomy(run), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def reject_toxic(docs: DataFrame, model: Model | None, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below the threshold (all rows where there is no model)."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = 1 / (1 + np.exp(-np.clip(sent.value.logits(b.column(text_col)), -30, 30)))
            yield b.filter(pa.array(p < threshold))

    return docs.mapInArrow(roomy(run), docs.schema)
