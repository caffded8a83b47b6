"""Quality classifier by co-training.

Two views describe a document and share nothing: its text (presence of hashed words, punctuation taken off, and of the
beginnings of longer ones, each weighed by how much more often it stands in one kind of documents; and what is
counted from the text: lines, repeated lines, cases, digits, symbols) and its page metadata (source, language and
stated length).  A logistic model of each view starts from labelled documents.  In each round both views score all
unlabelled documents, and each gives the `exchange` documents it is surest of, of either kind, to the other view's
training set.  Three folds of the labelled documents are held out: one calibrates the two views' logits, one fits
their combination, one is scored for the report.  This is done for two questions, whether a document is of quality
and whether it is clean of toxic words; `score` is the product of their probabilities, and `keep` holds where both
are 0.6 or more.

Training takes at most `most_labelled` labelled documents, those with the smallest hashes of doc_id, as far as their
word slots fill `most_bytes` together, and the documents exchanged (8 * exchange a round).  Scoring and the choice of
pseudo-labels cover all documents, whole.  The sample never comes to the driver: a task for each question and view
fits a model, and only weights and the held-out logits are collected.

Labels that disagree on a doc_id count as bad; a null toxic is 0.  A question without labels of both kinds cannot be
learnt: its probabilities are 1, so it rejects nothing.  A null text is empty; null source and language are values of
their own; a null n_chars counts as the length of the text.  Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from . import kernels as K
from .common import forget, row_hash, stash, without

WORD_BITS = 18
#: Bytes of a longer word's beginning, which is a feature beside the word.
STEM = 5
SOURCE_SLOTS, LANG_SLOTS = 64, 16
SYMBOLS = b"|#$%&*!<>{}[]@_=~^\\"
N_LAYOUT = 11 + len(SYMBOLS)
N_META = 1 + SOURCE_SLOTS + LANG_SLOTS
#: ASCII punctuation parts words, letters are lowered.
_PLAIN = K.LOWER.copy()
for _c in range(128):
    if not chr(_c).isalnum():
        _PLAIN[_c] = 32
_KINDS = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower, 3 digit, 4 punctuation, 5 space, 6 beyond ASCII
for _c in range(256):
    _ch = chr(_c)
    _KINDS[_c] = 6 if _c > 127 else 1 if _ch.isupper() else 2 if _ch.islower() else 3 if _ch.isdigit() else 5 if K.SPACE[_c] else 4


def _slot(values: list, slots: int) -> np.ndarray:
    return np.array([slots - 1 if v is None else zlib.crc32(str(v).encode()) % (slots - 1) for v in values], dtype=np.int64)


def views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For ranges [a, b) of rows: a, b, (row, word slot) pairs without repeats as two arrays, the layout and the metadata matrix."""
    data, offsets = K.utf8(batch.column("text"))
    sources, langs = _slot(batch.column("source").to_pylist(), SOURCE_SLOTS), _slot(batch.column("lang").to_pylist(), LANG_SLOTS)
    stated = batch.column("n_chars").to_pylist()
    for a, b in K.slices(offsets):
        part, off = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        n = b - a
        sizes = np.diff(off)
        plain = _PLAIN[part]
        start, end, row = K.words(plain, off)
        sums, long = K.prefix(plain), end - start > STEM
        hashes = np.concatenate((K.window_hash(sums, start, end), K.mix(K.window_hash(sums, start[long], start[long] + STEM))))
        pairs = np.unique((np.concatenate((row, row[long])).astype(np.uint64) << np.uint64(WORD_BITS)) | (hashes >> np.uint64(64 - WORD_BITS)))
        rows, slots = (pairs >> np.uint64(WORD_BITS)).astype(np.int64), (pairs & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)

        owner = np.repeat(np.arange(n), sizes)
        per = lambda mask: np.bincount(owner[mask], minlength=n)
        kinds = np.bincount(owner * 8 + _KINDS[part], minlength=n * 8).reshape(n, 8).astype(float)
        size = np.maximum(1, sizes)
        letters = np.maximum(1, kinds[:, 1] + kinds[:, 2])
        feeds = np.flatnonzero(part == 10)
        lines = np.bincount(owner[feeds], minlength=n) + 1
        line_start = np.sort(np.concatenate((off[:-1][sizes > 0], feeds[feeds + 1 < len(part)] + 1)))
        line_start = np.unique(line_start)
        line_end = np.append(line_start[1:], len(part))
        if len(part):
            h = K.window_hash(K.prefix(part), line_start, line_end) ^ K.mix(owner[line_start].astype(np.uint64) + np.uint64(1))
            first = np.unique(h, return_index=True)[1]
            distinct = np.bincount(owner[line_start[first]], minlength=n)
        else:
            distinct = np.ones(n)
        n_words = np.bincount(row, minlength=n)
        vocabulary = np.bincount(np.unique((row.astype(np.uint64) << np.uint64(40)) | (hashes[: len(row)] >> np.uint64(24))).astype(np.uint64) >> np.uint64(40), minlength=n)
        chars = np.array([s - c if v is None else v for v, s, c in zip(stated[a:b], sizes, per(part & 0xC0 == 0x80) if len(part) else np.zeros(n), strict=True)], float)
        layout = np.column_stack([
            np.log1p(lines), np.log1p(size / lines), distinct / lines, kinds[:, 1] / letters, kinds[:, 3] / size, kinds[:, 4] / size,
            kinds[:, 5] / size, kinds[:, 6] / size, np.log1p(n_words), vocabulary / np.maximum(1, n_words), size / np.maximum(1, n_words) / 10,
            *[np.sqrt(per(part == c) / size) for c in SYMBOLS],
        ])
        meta = np.zeros((n, N_META))
        meta[:, 0] = np.log1p(np.maximum(chars, 0))
        meta[np.arange(n), 1 + sources[a:b]] = 1
        meta[np.arange(n), 1 + SOURCE_SLOTS + langs[a:b]] = 1
        yield a, b, rows, slots, layout, meta


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


class View:
    """Documents of one view: sets of word slots (none for metadata), a value for each slot, and a dense matrix."""

    def __init__(self, sets: list[np.ndarray], dense: np.ndarray, value: np.ndarray | None = None):
        self.n, self.dense = len(dense), dense
        self.value = np.ones(1 << WORD_BITS if sets else 0) if value is None else value
        self.size = (1 << WORD_BITS if sets else 0) + dense.shape[1]
        self.slot = np.concatenate(sets) if sets else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(len(sets)), [len(x) for x in sets]) if sets else np.zeros(0, np.int64)

    def dot(self, w: np.ndarray) -> np.ndarray:
        wide = self.dense.shape[1]
        return self.dense @ w[:wide] + np.bincount(self.row, weights=(w[wide:] * self.value)[self.slot], minlength=self.n)

    def back(self, g: np.ndarray) -> np.ndarray:
        words = np.bincount(self.slot, weights=g[self.row], minlength=self.size - self.dense.shape[1])
        return np.concatenate((self.dense.T @ g, words * self.value))


def slot_ratios(sets: list[np.ndarray], y: np.ndarray, smooth: float = 5.0) -> np.ndarray:
    """The logarithm of how much more often a slot stands in good documents than in bad ones."""
    n = [max(1, int((y == k).sum())) for k in (0, 1)]
    bad, good = (np.bincount(np.concatenate([np.zeros(0, np.int64), *[x for x, v in zip(sets, y, strict=True) if v == k]]), minlength=1 << WORD_BITS) for k in (0, 1))
    less = smooth * n[0] / n[1]
    return np.log((good + smooth) / (n[1] + 2 * smooth)) - np.log((bad + less) / (n[0] + 2 * less))


def fit_logistic(x: View, y: np.ndarray, weight: np.ndarray, decay: float, steps: int = 150, rate: float = 0.1) -> tuple[np.ndarray, float]:
    """Weighted logistic regression with L2, by Adam over the whole sample."""
    w, b = np.zeros(x.size), 0.0
    m, v, mb, vb = np.zeros(x.size), np.zeros(x.size), 0.0, 0.0
    total = weight.sum()
    for t in range(1, steps + 1):
        g = weight * (_sigmoid(x.dot(w) + b) - y) / total
        gw, gb = x.back(g) + decay * w, g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        step = rate / (1 + t / 40)
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return w, float(b)


@dataclass(frozen=True)
class Linear:
    """A view's model: weights of the dense columns (standardised) and then of the words."""

    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray

    def logits(self, dense: np.ndarray, rows: np.ndarray | None = None, slots: np.ndarray | None = None) -> np.ndarray:
        wide = dense.shape[1]
        z = ((dense - self.mean) / self.scale) @ self.weights[:wide] + self.bias
        return z if rows is None else z + np.bincount(rows, weights=self.weights[wide:][slots], minlength=len(dense))


@dataclass(frozen=True)
class Model:
    """Both views, their calibrated combination, and the accuracy on the fold that took part in neither."""

    text: Linear
    meta: Linear
    calibration: tuple[tuple[float, float], tuple[float, float]] = ((1.0, 0.0), (1.0, 0.0))
    combination: tuple[float, float, float] = (1.0, 1.0, 0.0)
    report: tuple[int, float] | None = None

    def logits(self, rows: np.ndarray, slots: np.ndarray, layout: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.text.logits(layout, rows, slots), self.meta.logits(meta)

    def combined(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t, m = (np.clip(a * z + c, -30, 30) for z, (a, c) in zip((text, meta), self.calibration, strict=True))
        wt, wm, b = self.combination
        return _sigmoid(t), _sigmoid(m), _sigmoid(wt * t + wm * m + b)


def _plain(models: dict[str, Model]) -> dict[str, dict]:
    """Models as plain values, which tasks can load without this module at hand."""
    return {k: vars(m) | {"text": vars(m.text), "meta": vars(m.meta)} for k, m in models.items()}


def _models(plain: dict[str, dict]) -> dict[str, Model]:
    return {k: Model(**v | {"text": Linear(**v["text"]), "meta": Linear(**v["meta"])}) for k, v in plain.items()}


QUESTIONS, VIEWS = ("quality", "clean"), ("text", "meta")
#: Folds of the labelled documents.
TRAIN, CALIBRATE, COMBINE, REPORT = range(4)


def row_key(seed: int) -> Column:
    """The same for rows with the same features; extra columns do not count."""
    return row_hash(seed, F.col("doc_id"), F.col("text"), F.col("lang"), F.col("source"), F.col("n_chars"))


def features(docs: DataFrame, seed: int) -> DataFrame:
    """key, doc_id and both views of every row."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, row, slot, layout, meta in views(batch):
                cut = np.searchsorted(row, np.arange(b - a + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("key").slice(a, b - a), batch.column("doc_id").slice(a, b - a).cast(pa.int64()),
                        pa.array([slot[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in range(b - a)], pa.binary()),
                        *[pa.array([x.astype(np.float32).tobytes() for x in m], pa.binary()) for m in (layout, meta)],
                    ],
                    names=["key", "doc_id", "slots", "layout", "meta"],
                )

    rows = docs.select(row_key(seed).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars")
    return rows.mapInArrow(build, "key long, doc_id long, slots binary, layout binary, meta binary")


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """rows, slots, layout and meta of stored features."""
    sets = [np.frombuffer(x, np.uint32) for x in batch.column("slots").to_pylist()]
    slots = np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64)
    dense = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.float32).astype(float).reshape(len(sets), n) for c, n in (("layout", N_LAYOUT), ("meta", N_META))]
    return np.repeat(np.arange(len(sets)), [len(x) for x in sets]), slots, *dense


def _trained(rows: DataFrame) -> dict[str, Model]:
    """Models of both views of each question, each fitted by a task of its own; only weights are collected."""

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        question, view = pdf["question"].iloc[0], pdf["view"].iloc[0]
        pdf = pdf.sort_values(["key", "given"])
        y = pdf["y"].to_numpy(float)
        wide = N_LAYOUT if view == "text" else N_META
        dense = np.array([np.frombuffer(x, np.float32) for x in pdf["dense"]], dtype=float).reshape(len(pdf), wide)
        mean, scale = dense.mean(axis=0), dense.std(axis=0) + 1e-3
        sets = [np.frombuffer(x, np.uint32).astype(np.int64) for x in pdf["slots"]] if view == "text" else []
        weight = np.where(y == 0, 0.5 / max(1, (y == 0).sum()), 0.5 / max(1, (y == 1).sum()))
        ratios = slot_ratios(sets, y) if view == "text" else None
        w, b = fit_logistic(View(sets, (dense - mean) / scale, ratios), y, weight, 2e-3 if view == "text" else 1e-3)
        if view == "text":
            w[wide:] *= ratios
        return pd.DataFrame({"question": [question], "view": [view], "weights": [w.astype(np.float32).tobytes()], "bias": [b], "mean": [mean.tobytes()], "scale": [scale.tobytes()]})

    fitted = rows.groupBy("question", "view").applyInPandas(train, "question string, view string, weights binary, bias double, mean binary, scale binary")
    own = {(r["question"], r["view"]): Linear(np.frombuffer(r["weights"], np.float32), r["bias"], np.frombuffer(r["mean"]), np.frombuffer(r["scale"])) for r in fitted.collect()}
    return {q: Model(own[q, "text"], own[q, "meta"]) for q in {q for q, _ in own}}


def _training_rows(rows: DataFrame, question: str, view: str, y: Column, given: int) -> DataFrame:
    slots = F.col("slots") if view == "text" else F.lit(None).cast("binary")
    dense = F.col("layout" if view == "text" else "meta")
    return rows.select(F.lit(question).alias("question"), F.lit(view).alias("view"), "key", F.lit(given).alias("given"), y.alias("y"), slots.alias("slots"), dense.alias("dense"))


def _logits(rows: DataFrame, models: dict[str, Model], kept: list[str]) -> DataFrame:
    """`kept` columns and the logit of each question and view (text_quality and so on)."""
    sent = rows.sparkSession.sparkContext.broadcast(_plain(models))  # 2**WORD_BITS and a few numbers each
    names = [f"{v}_{q}" for q in models for v in VIEWS]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _models(sent.value).values()
        for batch in batches:
            own = _unpacked(batch)
            got = [z for m in held for z in m.logits(*own)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], *map(pa.array, got)], names=[*kept, *names])

    schema = StructType([rows.schema[c] for c in kept])
    for n in names:
        schema = schema.add(n, DoubleType())
    return rows.mapInArrow(build, schema)


def fit(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, rounds: int = 2, exchange: int = 250, sure: float = 0.97, most_bytes: int = 256 << 20, seed: int = 11) -> dict[str, Model]:
    """The models of the questions that can be learnt."""
    labels = (
        labels.where("doc_id is not null and quality is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.min("quality").cast("int").alias("quality"), (1 - F.max(F.coalesce("toxic", F.lit(0)))).cast("int").alias("clean"))
    )
    seen = stash(features(docs, seed))
    order = row_hash(seed, F.col("doc_id"))
    # the rows to train on are chosen by ids and sizes alone
    ids = seen.select("key", "doc_id", F.octet_length("slots").alias("bytes")).join(labels, "doc_id").dropDuplicates(["key"])
    ids = ids.withColumn("order", order).orderBy("order", "doc_id", "key").limit(most_labelled)
    # most_labelled rows at most: their running total fits a task
    known = ids.withColumn("filled", F.sum("bytes").over(Window.orderBy("order", "doc_id", "key").rowsBetween(Window.unboundedPreceding, 0)))
    draw = F.pmod(row_hash(seed + 1, F.col("doc_id")), F.lit(10))
    fold = F.when(draw == 0, CALIBRATE).when(draw == 1, COMBINE).when(draw == 2, REPORT).otherwise(TRAIN)
    known = F.broadcast(stash(known.where(F.col("filled") <= most_bytes).select("key", "quality", "clean", fold.alias("fold"))))
    known = stash(seen.join(known, "key").dropDuplicates(["key"]).select("key", "slots", "layout", "meta", "quality", "clean", "fold"))
    tally = {(r["fold"], q, k): r[f"{q}{k}"] for r in known.groupBy("fold").agg(*[F.count(F.when(F.col(q) == k, 1)).alias(f"{q}{k}") for q in QUESTIONS for k in (0, 1)]).collect() for q in QUESTIONS for k in (0, 1)}
    questions = [q for q in QUESTIONS if tally.get((TRAIN, q, 0)) and tally.get((TRAIN, q, 1))]
    if not questions:
        forget(seen)
        return {}
    base = [_training_rows(known.where(F.col("fold") == TRAIN), q, v, F.col(q), 0) for q in questions for v in VIEWS]
    rows = reduce(DataFrame.unionByName, base)
    models = _trained(rows)
    edge = math.log(sure / (1 - sure))
    for turn in range(1, rounds + 1):
        logits = _logits(seen, models, ["key", "doc_id"]).join(labels.select("doc_id"), "doc_id", "left_anti")
        logits = stash(logits.drop("doc_id").distinct())
        picks = []
        for q in questions:
            for giver, taker in (("text", "meta"), ("meta", "text")):
                z = F.col(f"{giver}_{q}")
                for kind, best in ((1, z.desc()), (0, z.asc())):
                    surest = logits.where(z >= edge if kind else z <= -edge).orderBy(best, "key").limit(exchange)
                    picks.append(surest.select("key", F.lit(q).alias("q"), F.lit(taker).alias("v"), F.lit(kind).alias("y")))
        picked = stash(reduce(DataFrame.unionByName, picks))  # 8 * exchange rows at most
        if turn > 1:  # a document that was given before does not count twice
            picked = picked.join(F.broadcast(before), ["key", "q", "v"], "left_anti")
        before = picked.select("key", "q", "v") if turn == 1 else before.unionByName(picked.select("key", "q", "v"))
        given = seen.join(F.broadcast(picked), "key").dropDuplicates(["key", "q", "v"])
        given = stash(given.select("key", "slots", "layout", "meta", "q", "v", "y"))
        more = [_training_rows(given.where((F.col("q") == q) & (F.col("v") == v)), q, v, F.col("y"), turn) for q in questions for v in VIEWS]
        rows = reduce(DataFrame.unionByName, [rows, *more])
        models = _trained(rows)
        forget(logits)
    held = _logits(known.where(F.col("fold") != TRAIN), models, ["key", "fold", *QUESTIONS]).toPandas().sort_values("key")  # some numbers for each of most_labelled rows
    forget(seen)
    return {q: _calibrated(models[q], held, q) for q in questions}


def _calibrated(model: Model, held: pd.DataFrame, question: str) -> Model:
    """Calibration on one fold, combination on another, accuracy on the third; a fold without both kinds is replaced by all of them."""

    def fold(k: int) -> tuple[np.ndarray, np.ndarray]:
        own = held[held["fold"] == k]
        own = held if own[question].nunique() < 2 else own
        return own[[f"{v}_{question}" for v in VIEWS]].to_numpy(float), own[question].to_numpy(float)

    if held[question].nunique() < 2:
        return model
    logit, y = fold(CALIBRATE)
    calibration = []
    for k in range(2):
        spread = max(1e-6, float(logit[:, k].std()))
        w, b = fit_logistic(View([], logit[:, k : k + 1] / spread), y, np.ones(len(y)), 1e-4, steps=300)
        calibration.append((max(float(w[0]), 0.0) / spread, b))
    logit, y = fold(COMBINE)
    t = np.clip(np.column_stack([logit[:, k] * calibration[k][0] + calibration[k][1] for k in range(2)]), -30, 30)
    w, b = fit_logistic(View([], t), y, np.ones(len(y)), 1e-4, steps=300)
    model = replace(model, calibration=tuple(calibration), combination=(float(w[0]), float(w[1]), b))
    logit, y = fold(REPORT)
    return replace(model, report=(len(y), float(((model.combined(logit[:, 0], logit[:, 1])[2] >= 0.5) == (y == 1)).mean())))


OUT = ("p_text_quality", "p_meta_quality", "p_quality", "p_text_clean", "p_meta_clean", "p_clean")


def score(docs: DataFrame, models: dict[str, Model], threshold: float = 0.6) -> DataFrame:
    """All columns of `docs` with each view's and the combined probability of each question, score and keep."""
    docs = without(docs, *OUT, "score", "keep")
    sent = docs.sparkSession.sparkContext.broadcast(_plain(models))  # 2**WORD_BITS and a few numbers each

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _models(sent.value)
        for batch in batches:
            got = np.ones((6, batch.num_rows))
            for a, b, *seen in views(batch):
                for i, question in enumerate(QUESTIONS):
                    if question in own:
                        got[3 * i : 3 * i + 3, a:b] = own[question].combined(*own[question].logits(*seen))
            keep = (got[2] >= threshold) & (got[5] >= threshold)
            arrays = [*batch.columns, *[pa.array(g) for g in got], pa.array(got[2] * got[5]), pa.array(keep)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *OUT, "score", "keep"])

    schema = StructType(list(docs.schema.fields))
    for c in (*OUT, "score"):
        schema = schema.add(c, DoubleType())
    return docs.mapInArrow(build, schema.add("keep", BooleanType()))


def kept(docs: DataFrame, models: dict[str, Model], threshold: float = 0.6) -> DataFrame:
    """The rows of `docs` that pass, with all of its columns, whatever their names."""
    read, names = {"doc_id", "text", "lang", "source", "n_chars"}, []
    for i, c in enumerate(docs.columns):
        names.append(c if c in read and c not in names else f"__{i}")
    return score(docs.toDF(*names), models, threshold).where("keep").select(*names).toDF(*docs.columns)


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs.select("doc_id", "text", "lang", "source", "n_chars"), fit(docs, labels)).select("doc_id", *OUT, "score", "keep")
