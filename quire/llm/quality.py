"""Quality classifier by co-training.

Two views of a document, each with a classifier of its own: what its text is made of (frequencies of bytes
and of hashed three-byte runs), and its metadata (source, language, length). They are fitted on a bounded
sample of labelled documents. In each round both score a fresh share of all unlabelled documents, and what one
is sure of becomes a label for the other; the executors add up what Newton's method needs of these, so that the
driver sees sums only. Both are then calibrated on labelled documents kept apart, and their calibrated odds
combined score every document of the corpus in one pass.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, fixed, task_number, text_or_empty

LABELLED = 6_000  # labelled documents that are looked at, at most
ROUNDS = 3
SURE = 0.97  # calibrated probability from which a pseudo-label is handed over
KEEP = 0.5  # documents with a lower probability of being good are rejected

SMOOTHING = 50.0  # bytes

_RUNS = 256  # hashed three-byte runs
_TEXT = 256 + _RUNS + 1
_SOURCES, _LANGS = 64, 16
_META = _SOURCES + _LANGS + 8
_PENALTY = 0.3
_SCALE = 1 << 30
_SLICE = 8  # rows of a matrix of sums that travel together


def _frequencies(text: str) -> tuple[np.ndarray, int, float]:
    """Counts of bytes and hashed three-byte runs, the length, and how much the text repeats itself."""
    data = np.frombuffer(text.encode(), np.uint8)
    counts = np.zeros(256 + _RUNS, np.float32)
    if len(data) < 8:
        counts[:256] = np.bincount(data, minlength=256)
        return counts, len(data), 0.0
    wide = data.astype(np.uint32)
    runs = wide[:-2] | (wide[1:-1] << 8) | (wide[2:] << 16)
    counts[:256] = np.bincount(data, minlength=256)
    counts[256:] = np.bincount((runs * np.uint32(2654435761)) >> np.uint32(24), minlength=_RUNS)
    # the chance that two windows of six bytes are the same, whatever the length
    windows = (runs[:-3] * np.uint32(2654435761) + runs[3:] * np.uint32(2246822519)) >> np.uint32(18)
    again = np.bincount(windows, minlength=1 << 14).astype(np.float64)
    n = len(windows)
    same = (float(again @ again) - n) / max(n * (n - 1), 1)
    return counts, len(data), math.log1p(1000 * same)


def _smoothed(counts: np.ndarray, n: np.ndarray, repeats: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """Square roots of relative frequencies less the usual ones, and how much the text repeats itself.

    The usual frequencies count as much as SMOOTHING bytes, so that a short text says little.
    """
    out = np.empty((len(counts), _TEXT), np.float32)
    out[:, :-1] = np.sqrt((counts + SMOOTHING * usual) / (n + SMOOTHING)[:, None]) - np.sqrt(usual)
    out[:, -1] = repeats
    return out


def text_features(texts: list[str], usual: np.ndarray) -> np.ndarray:
    """The text view of each text; ``usual``: mean relative frequencies of bytes and runs."""
    parts = []
    for at in range(0, len(texts), 1000):
        found = [_frequencies(text) for text in texts[at : at + 1000]]
        counts, n, repeats = (np.array(c, np.float32) for c in zip(*found, strict=True))
        parts.append(_smoothed(counts, n, repeats, usual))
    return np.concatenate(parts) if parts else np.empty((0, _TEXT), np.float32)


def _counts_of(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, lengths and repetition of stored rows."""
    found = [np.frombuffer(c, np.float32) for c in rows.column("counts").to_pylist()]
    counts = np.array(found, np.float32).reshape(len(found), 256 + _RUNS)
    return counts, np.array(rows.column("n").to_pylist(), np.float32), np.array(rows.column("repeats").to_pylist(), np.float32)


def _usual(stored: DataFrame) -> np.ndarray:
    """Mean relative frequencies of bytes and runs over all documents; even if there are no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 + _RUNS)
        for batch in batches:
            counts, n, _ = _counts_of(batch)
            total += (counts / np.maximum(n, 1)[:, None]).sum(axis=0, dtype=np.float64)
        yield from _sliced({"usual": total[None]})

    total = _added(stored.select("counts", "n", "repeats").mapInArrow(run, _SLICES)).get("usual", np.zeros((1, 256 + _RUNS)))[0] + 1e-3
    total[:256] /= total[:256].sum()
    total[256:] /= total[256:].sum()
    return total.astype(np.float32)


_SLICES = "name string, slice int, task int, sums binary"


def _sliced(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A task's matrices of sums as rows of a few matrix rows each."""
    for name, matrix in sums.items():
        parts = [matrix[at : at + _SLICE].tobytes() for at in range(0, len(matrix), _SLICE)]
        columns = [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([task_number()] * len(parts), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(parts, pa.binary())], names=["name", "slice", "task", "sums"])


def _added(slices: DataFrame) -> dict[str, np.ndarray]:
    """Sums of the tasks' matrices, added slice by slice in the order of tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {}
        for batch in batches:
            for name, at, sums in zip(*[batch.column(c).to_pylist() for c in ("name", "slice", "sums")], strict=True):
                some = np.frombuffer(sums, np.float64)
                totals[name, at] = totals[name, at] + some if (name, at) in totals else some
        columns = [pa.array([k[0] for k in totals], pa.string()), pa.array([k[1] for k in totals], pa.int32())]
        columns += [pa.array([0] * len(totals), pa.int32()), pa.array([v.tobytes() for v in totals.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["name", "slice", "task", "sums"])

    placed = slices.repartition("name", "slice").sortWithinPartitions("name", "slice", "task")
    rows = placed.mapInArrow(run, _SLICES).collect()  # one matrix of each name
    found: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["name"], r["slice"])):
        found.setdefault(r["name"], []).append(np.frombuffer(r["sums"], np.float64))
    widths = {"usual": 256 + _RUNS, "text": _TEXT + 1, "meta": _META + 1}
    return {name: np.concatenate(parts).reshape(-1, widths[name]) for name, parts in found.items()}


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces the text, the first column, by its counts, length and repetition."""
    for batch in batches:
        found = [_frequencies(text.as_py()) for text in batch.column(0)]
        counts = pa.array([c.tobytes() for c, _, _ in found], pa.binary())
        n = pa.array([n for _, n, _ in found], pa.int64())
        repeats = pa.array([r for _, _, r in found], pa.float64())
        names = ["counts", "n", "repeats", *batch.schema.names[1:]]
        yield pa.RecordBatch.from_arrays([counts, n, repeats, *batch.columns[1:]], names=names)


def meta_features(sources: list, langs: list, lengths: list) -> np.ndarray:
    """Hashed source and language, and bands of the length; nulls have places of their own."""
    out = np.zeros((len(sources), _META), np.float32)
    for row, source, lang, length in zip(out, sources, langs, lengths, strict=True):
        if source is not None:
            row[1 + zlib.crc32(source.encode()) % (_SOURCES - 1)] = 1
        else:
            row[0] = 1
        at = _SOURCES
        row[at if lang is None else at + 1 + zlib.crc32(lang.encode()) % (_LANGS - 1)] = 1
        at += _LANGS
        if length is None or not math.isfinite(length):
            row[at] = 1
        else:
            size = math.log1p(max(float(length), 0.0))
            row[at + 1] = size / 10
            row[at + 2 + min(int(size / 2), 5)] = 1
    return out


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def _newton_sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Hessian of the log-loss at ``weights``, and its negative slope as the last row."""
    sums = np.zeros((len(weights) + 1, len(weights)))
    for at in range(0, len(x), 1000):  # a piece at a time stays small
        some = np.c_[x[at : at + 1000].astype(np.float64), np.ones(len(x[at : at + 1000]))]
        p = _logistic(some @ weights)
        sums[:-1] += (some * (p * (1 - p) + 1e-6)[:, None]).T @ some
        sums[-1] += some.T @ (y[at : at + 1000] - p)
    return sums


def _newton_step(sums: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The step from ``weights`` with an L2 penalty."""
    penalty = np.full(len(weights), _PENALTY)
    penalty[-1] = 1e-3
    return np.linalg.solve(sums[:-1] + np.diag(penalty), sums[-1] - penalty * weights)


def _fit(x: np.ndarray, y: np.ndarray, steps: int = 8) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression with an L2 penalty, by Newton's method."""
    weights = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        step = _newton_step(_newton_sums(x, y, weights), weights)
        weights = weights + step
        if np.abs(step).max() < 1e-4:
            break
    return weights


@dataclass
class _View:
    """A linear classifier, and the line that turns its margins into calibrated log-odds."""

    weights: np.ndarray
    slope: float
    offset: float

    def odds(self, x: np.ndarray) -> np.ndarray:
        margin = x.astype(np.float64) @ self.weights[:-1] + self.weights[-1]
        return self.slope * margin + self.offset


def _calibrated(weights: np.ndarray, held_x: np.ndarray, held_y: np.ndarray) -> _View:
    if len(np.unique(held_y)) < 2:
        return _View(weights, 1.0, 0.0)
    margins = held_x.astype(np.float64) @ weights[:-1] + weights[-1]
    # Platt: labels pulled in a little, so that a perfect split keeps finite odds
    good, bad = (held_y == 1).sum(), (held_y == 0).sum()
    aims = np.where(held_y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    slope, offset = _fit(margins[:, None], aims, steps=30)
    return _View(weights, max(float(slope), 0.0), float(offset))


def _handed_sums(stored: DataFrame, usual: np.ndarray, teachers: list[dict[str, _View]], weights: dict, rounds: int) -> dict:
    """Newton sums at ``weights`` over the pseudo-labels that the teachers of all rounds so far hand over.

    ``stored``: unlabelled documents. One more row of each matrix begins with the labels handed over in the last
    round.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {v: np.zeros((len(w) + 2, len(w))) for v, w in weights.items()}
        for batch in batches:
            xs = {"text": _smoothed(*_counts_of(batch), usual)}
            xs["meta"] = meta_features(*[batch.column(c).to_pylist() for c in ("source", "lang", "n_chars")])
            number = batch.column("fold").to_numpy() // 3 % rounds
            for at, views in enumerate(teachers):
                fresh = np.flatnonzero(number == at)
                for teacher, pupil in (("text", "meta"), ("meta", "text")):
                    if pupil not in weights or not len(fresh):
                        continue
                    p = _logistic(views[teacher].odds(xs[teacher][fresh]))
                    sure = (p >= SURE) | (p <= 1 - SURE)
                    sums[pupil][:-1] += _newton_sums(xs[pupil][fresh[sure]], (p[sure] >= 0.5).astype(float), weights[pupil])
                    sums[pupil][-1, 0] += sure.sum() if at == len(teachers) - 1 else 0
        yield from _sliced(sums)

    asked = stored.where((F.expr("fold div 3") % rounds) < len(teachers))
    return _added(asked.mapInArrow(run, _SLICES))


@dataclass
class QualityModel:
    text: _View
    meta: _View
    usual: np.ndarray  # mean frequencies of bytes and runs
    prior: float  # log-odds of a good document
    rounds: list[tuple[int, int]]  # pseudo-labels handed over in each round: from text, from metadata

    def odds(self, texts: list[str], sources: list, langs: list, lengths: list) -> tuple[np.ndarray, ...]:
        """Calibrated log-odds of the text view, the metadata view, and both."""
        by_text = self.text.odds(text_features(texts, self.usual))
        by_text = np.where([len(t) > 0 for t in texts], by_text, self.prior)  # an empty text says nothing
        by_meta = self.meta.odds(meta_features(sources, langs, lengths))
        return by_text, by_meta, by_text + by_meta - self.prior


def _sampled(rows: DataFrame, key: Column, n: int, bound: int) -> DataFrame:
    """About ``bound`` of ``n`` rows, chosen by a hash; all of them if there are no more."""
    if n <= bound:
        return rows
    return rows.where(F.pmod(key, F.lit(_SCALE)) < int(_SCALE * 0.95 * bound / n))


def _stored_counts(docs: DataFrame, labels: DataFrame, labelled: int, seed: int) -> DataFrame:
    """Every document: counts of its text, quality (null unless in the bounded labelled sample), fold, metadata."""
    known = labels.where("doc_id is not null").groupBy("doc_id")
    known = known.agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
    known = fixed(known.where("quality = other and quality in (0, 1)").select("doc_id", "quality"), "labels")
    drawn = _sampled(known, F.xxhash64(F.lit(seed), "doc_id"), known.count(), labelled)
    drawn = F.broadcast(drawn.limit(labelled))  # bounded by the parameter
    joined = docs.select("doc_id", "text", *_metadata(docs)).join(drawn, "doc_id", "left")
    fold = F.pmod(F.xxhash64(F.lit(seed + 2), "doc_id", "text"), F.lit(3 * ROUNDS * 100)).cast("long").alias("fold")
    rows = joined.select(text_or_empty().alias("text"), "quality", fold, "source", "lang", "n_chars")
    kind = rows.schema["quality"].dataType.simpleString()
    kinds = f"counts binary, n long, repeats double, quality {kind}, fold long, source string, lang string, n_chars double"
    return fixed(rows.mapInArrow(_count_batches, kinds), "training")


def _metadata(docs: DataFrame) -> list[Column]:
    """source, lang, n_chars; a column that is not there counts as null."""
    have = {c.lower() for c in docs.columns}
    kinds = {"source": "string", "lang": "string", "n_chars": "double"}
    return [(F.col(c) if c in have else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]


def fit_quality(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS, seed: int = 5) -> QualityModel:
    """Fit on at most ``labelled`` labelled and all other documents of ``docs`` (doc_id, text, metadata).

    ``labels``: doc_id, quality (0 or 1); ids with null or contradictory labels are left out. A third of the
    labelled sample is kept apart for calibration. Without labels of both kinds every document scores the
    share of good labels (a half if there are none).
    """
    bounded_batches(docs.sparkSession)
    stored = _stored_counts(docs, labels, labelled, seed)
    usual = _usual(stored)
    rows = stored.where("quality is not null").limit(labelled).toArrow()
    others = stored.where("quality is null")
    xs = {"text": _smoothed(*_counts_of(rows), usual)}
    xs["meta"] = meta_features(*[rows.column(c).to_pylist() for c in ("source", "lang", "n_chars")])
    quality = np.array(rows.column("quality").to_pylist(), np.int64)
    kept_apart = np.array(rows.column("fold").to_pylist(), np.int64) % 3 == 0
    good = (quality.sum() + 1) / (len(quality) + 2)
    prior = float(np.log(good / (1 - good)))
    own = quality[~kept_apart].astype(float)
    if len(np.unique(own)) < 2:
        text, meta = (_View(np.zeros(x.shape[1] + 1), 0.0, prior) for x in xs.values())
        return QualityModel(text, meta, usual, prior, [(0, 0)] * rounds)

    weights = {v: _fit(x[~kept_apart], own) for v, x in xs.items()}

    def views() -> dict[str, _View]:
        return {v: _calibrated(weights[v], x[kept_apart], quality[kept_apart]) for v, x in xs.items()}

    teachers, handed = [], []
    for _ in range(rounds):
        teachers.append(views())
        going, given = list(xs), {}
        for _ in range(8):
            sums = _handed_sums(others, usual, teachers, {v: weights[v] for v in going}, rounds)
            for v in list(going):
                total = _newton_sums(xs[v][~kept_apart], own, weights[v])
                given.setdefault(v, int(sums[v][-1, 0]) if v in sums else 0)
                step = _newton_step(total + sums[v][:-1] if v in sums else total, weights[v])
                weights[v] = weights[v] + step
                if np.abs(step).max() < 1e-4:
                    going.remove(v)
            if not going:
                break
        handed.append((given["meta"], given["text"]))  # the pupils' labels
    now = views()
    return QualityModel(now["text"], now["meta"], usual, prior, handed)


def quality_columns(model: QualityModel):
    """A function of (text, source, lang, n_chars) columns: struct of text_score, meta_score, quality."""

    @F.arrow_udf("text_score double, meta_score double, quality double")
    def score(text: pa.Array, source: pa.Array, lang: pa.Array, n_chars: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, len(text), 200):
            some = [c.slice(at, 200).to_pylist() for c in (text, source, lang, n_chars)]
            parts.append(np.array([_logistic(odds) for odds in model.odds(*some)]))
        scores = np.concatenate(parts, axis=1) if parts else np.empty((3, 0))
        return pa.StructArray.from_arrays([pa.array(s) for s in scores], ["text_score", "meta_score", "quality"])

    return score


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, text_score, meta_score, quality (probabilities of being good), kept, for every row of ``docs``.

    Null and empty texts are judged by their metadata; nulls in the metadata are values of their own. Repeated
    rows score alike. Extra columns are not looked at. An empty table gives an empty result.
    """
    found = quality_columns(model)(text_or_empty(), *_metadata(docs))
    scored = docs.select("doc_id", found.alias("found")).select("doc_id", "found.*")
    return scored.withColumn("kept", F.col("quality") >= KEEP)


def good_documents(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of ``docs`` that are kept, unchanged."""
    found = quality_columns(model)(text_or_empty(), *_metadata(docs))
    scored = docs.select(F.struct("*").alias("row"), found.alias("found"))
    return scored.where(F.col("found.quality") >= KEEP).select("row.*")
