"""Quality classifier: random Fourier features, ridge by summed normal equations, isotonic calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Texts, crc_mod, mixed, per_batch, shipped, stored, sum_rows
from pageloom.llm.quality import CLASSES, base_counts, class_counts

#: Fourier features, kernel width in deviations for each root of a statistic, ridge for each labelled row.
FEATURES, WIDTH, RIDGE = 384, 0.7, 1e-4
#: Scores are calibrated on a grid of this many steps over ``SPAN``.
STEPS, SPAN = 2000, (-0.5, 1.5)
STATISTICS = (
    "log_bytes", "log_words", "word_length", *(f"share_{c}" for c in CLASSES), "distinct", "top_word", "entropy",
    "repeat_words", "dup_lines", "line_words", "capitals", "marked", "same_next", "doubled",
)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def statistics(texts: Texts) -> np.ndarray:
    """Document statistics by row; an empty text gives zeros."""
    n_rows = len(texts)
    classes, words = class_counts(texts), texts.words()
    h, rows, n = words.hashes(), words.rows(), words.counts
    base = base_counts(texts, classes, words, h)
    safe = np.maximum(n, 1)
    chars = np.maximum(classes.sum(1), 1)
    # Word counts of each row: runs of equal (row, word) hashes.
    own = np.sort(mixed(h + rows.astype(np.uint64) * _STEP)) if len(h) else h
    order = np.argsort(mixed(h + rows.astype(np.uint64) * _STEP), kind="stable")
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(own)))
    of = rows[order[begin]] if len(begin) else np.zeros(0, np.int64)
    distinct = np.bincount(of, minlength=n_rows)
    spread = np.bincount(of, weights=count * np.log(np.maximum(count, 1)), minlength=n_rows)
    top = np.zeros(n_rows, np.int64)
    np.maximum.at(top, of, count)
    d = texts.data
    lead, tail = d[words.start], d[words.end - 1] if len(h) else d[:0]
    per = lambda flags: sum_rows(flags.astype(np.int64), words.first) / safe
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    doubled = np.zeros(len(d), bool)
    doubled[1:] = d[1:] == d[:-1]
    return np.column_stack([
        np.log1p(np.diff(texts.at)), np.log1p(n), base["word_chars"] / safe, *(classes / chars[:, None]).T,
        distinct / safe, top / safe, np.where(n > 1, (np.log(safe) - spread / safe) / np.log(np.maximum(n, 2)), 0),
        base["n_repeat_words"] / safe, base["n_dup_lines"] / safe, classes[:, CLASSES.index("line")] / safe,
        per((lead >= 65) & (lead <= 90)), per(((tail >= 33) & (tail <= 47)) | ((tail >= 58) & (tail <= 64)) | (tail == 124)),
        per(same), sum_rows(doubled.astype(np.int64), texts.at) / np.maximum(np.diff(texts.at), 1),
    ]).astype(np.float32)


class Fourier:
    """A fixed random map whose inner products approximate a Gaussian kernel of standardized statistics."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, size: int = FEATURES, width: float = WIDTH, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.weights = rng.normal(size=(len(mean), size)) / (width * np.sqrt(len(mean)))
        self.phase = rng.uniform(0, 2 * np.pi, size)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -6, 6)
        wave = np.sqrt(2 / len(self.phase)) * np.cos(z @ self.weights + self.phase)
        return np.hstack([wave, np.ones((len(x), 1))])


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray, int]:
    """(Z'Z, Z'y, rows) of ``(x, y)``: summed in each task, then row by row of the matrix."""
    size = len(fourier.phase) + 1

    def add(batches):
        a, n = np.zeros((size, size + 1)), 0
        for batch in batches:
            if batch.num_rows:
                z = fourier(_matrix(batch))
                y = batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)
                a += z.T @ np.column_stack([z, y])
                n += len(y)
        if n:
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(range(size), pa.int32()), "part": pa.array([TaskContext.get().partitionId()] * size, pa.int32()),
                "n": pa.array([n] * size, pa.int64()), "row": pa.array([r.tobytes() for r in a], pa.binary())})

    def total(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        whole = np.sum([np.frombuffer(r.as_py()) for r in table.column("row")], 0)
        return pa.table({"i": table.column("i")[:1], "n": pa.array([sum(table.column("n").to_pylist())], pa.int64()),
                         "row": pa.array([whole.tobytes()], pa.binary())})

    found = (
        rows.mapInArrow(add, "i int, part int, n long, row binary").groupBy("i")
        .applyInArrow(total, "i int, n long, row binary").orderBy("i").collect()
    )
    if not found:
        return np.eye(size), np.zeros(size), 0
    a = np.array([np.frombuffer(r["row"]) for r in found])
    return a[:, :-1], a[:, -1], found[0]["n"]


def isotonic(position: np.ndarray, hits: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising rates at rising positions: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for x, h, n in zip(position, hits, count):
        blocks.append([x * n, h, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality",
                   folds: int = 5) -> DataFrame:
    """Calibrated probability of label 1 for each document: the id, ``held_out`` and ``score``.

    Rows whose id's crc32 is 0 modulo ``folds`` are held out and teach nothing; of the others the last
    fold calibrates and the rest fit.  Inputs are statistics of the text alone, standardized
    over all documents.  Every task sums its part of the normal equations, whose size does not grow with the
    data; calibration counts labels on a fixed grid of scores.  Null and empty
    texts have statistics 0 and a score like any other; rows without a label or with a null one only get
    scores; repeated labels all count; a null id's crc is that of the empty text.  Without labels
    the score is 0.5.  Extra columns are ignored.
    """
    shipped(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    made = stored(per_batch(
        rows, lambda b: {"doc_id": b.column("doc_id"), "x": pa.array([r.tobytes() for r in statistics(Texts.of(b.column("text")))], pa.binary())},
        f"doc_id {kind}, x binary"), "statistics")
    mean, deviation = moments(made)
    fourier = Fourier(mean, deviation)

    known = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    fold = crc_mod("doc_id", folds)
    taught = stored(made.join(known.where(fold != 0), "doc_id").select("x", "y", fold.alias("fold")), "labelled")
    a, b, n = normal_equations(taught.where(F.col("fold") != folds - 1), fourier)
    weights = np.linalg.solve(a + RIDGE * max(n, 1) * np.eye(len(a)), b)

    def raw(batch):
        return np.clip((fourier(_matrix(batch)) @ weights - SPAN[0]) / (SPAN[1] - SPAN[0]), 0, 1) * STEPS

    def count(batches):
        total = np.zeros((STEPS + 1, 2))
        for batch in batches:
            if batch.num_rows:
                y = batch.column("y").to_numpy(zero_copy_only=False)
                at = raw(batch).astype(np.int64)
                total += np.column_stack([np.bincount(at, y, STEPS + 1), np.bincount(at, minlength=STEPS + 1)])
        used = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_pydict({
            "step": pa.array(used, pa.int32()), "hits": pa.array(total[used, 0]), "n": pa.array(total[used, 1].astype(np.int64))})

    grid = (
        taught.where(F.col("fold") == folds - 1).mapInArrow(count, "step int, hits double, n long")
        .groupBy("step").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("step").collect()
    )
    place, rate = isotonic([r["step"] + 0.5 for r in grid], [r["hits"] for r in grid], [r["n"] for r in grid])

    def score(batches):
        for batch in batches:
            if batch.num_rows:
                at = raw(batch)
                if len(place):
                    value = np.interp(at, place, rate)
                else:  # nothing to calibrate with
                    value = np.clip(at / STEPS * (SPAN[1] - SPAN[0]) + SPAN[0], 0, 1) if n else np.full(len(at), 0.5)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value)], ["doc_id", "score"])

    return made.mapInArrow(score, f"doc_id {kind}, score double").select(
        F.col("doc_id").alias(id), (fold == 0).alias("held_out"), "score")


def moments(made: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of every statistic over all documents."""
    size = len(STATISTICS)

    def add(batches):
        total = np.zeros(2 * size + 1)
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                total += np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(len(total)), pa.int32()), "v": pa.array(total)})

    found = made.mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
    v = np.array([r["v"] for r in found])
    n = max(v[0], 1)
    mean = v[1:size + 1] / n
    return mean, np.sqrt(np.maximum(v[size + 1:] / n - mean**2, 0))
