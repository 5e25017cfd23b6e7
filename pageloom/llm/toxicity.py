"""Toxicity: a support vector machine over gapped subsequences of characters, with Nyström landmarks."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import Texts, crc_mod, matrix_sum, mixed, shipped, slices, stored

#: Characters of a subsequence, places that it may stretch over, and how much each place left out weakens it.
ORDER, SPAN, DECAY = 4, 7, 0.75
#: Places at which the subsequences of a window begin.
WINDOW = 8
#: Labelled rows that teach and calibrate at most, those of the least id hashes.
SAMPLE = 24_000
#: Landmarks, and windows of each label that they are chosen from.
LANDMARKS, CHOICE = 256, 800
#: Windows of a toxic text at most, and their share of the worst one's suspicion at least; other windows of a clean text.
TOPS, SHARE, OTHERS = 5, 0.3, 2
#: Copies of every such window with a character or two put in.
VIRTUAL = 2
#: Rounds of choosing windows, Newton steps, and the weight of all errors together against the length of the weights.
ROUNDS, STEPS, COST = 2, 12, 1e5
#: Scores are calibrated on a grid of this many steps over ``REACH``.
GRID, REACH = 4000, (-4.0, 12.0)

# Letters are told apart; white space, digits, marks, and the first and further bytes of other characters are one symbol each.
_END = 31
_SYMBOL = np.full(256, 28, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(26)
_SYMBOL[[0x20, *range(0x09, 0x0E)]] = 26
_SYMBOL[48:58] = 27
_SYMBOL[0x80:0xC0], _SYMBOL[0xC0:] = 30, 29
CODES = 1 << (5 * ORDER)
_PLACES = list(combinations(range(1, SPAN), ORDER - 1))
_WEIGHTS = np.array([DECAY ** (p[-1] + 1 - ORDER) for p in _PLACES], np.float32)
_CHUNK = 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_READ = WINDOW + SPAN - 1


def symbols(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols with ``WINDOW`` ends after each row, and where rows begin (one more at the end)."""
    at = texts.at + WINDOW * np.arange(len(texts.at))
    out = np.full(at[-1], _END, np.uint8)
    out[np.arange(len(texts.data)) + np.repeat(WINDOW * np.arange(len(texts)), np.diff(texts.at))] = _SYMBOL[texts.data]
    return out, at


def plain_codes(line: np.ndarray) -> np.ndarray:
    """Codes of the subsequences without gaps that begin at each place; the last ones read ends."""
    c = np.append(line, np.full(SPAN, _END, np.uint8)).astype(np.int32)
    code = np.zeros(len(line), np.int32)
    for k in range(ORDER):
        code = (code << 5) | c[k:k + len(line)]
    return code


def sums_by_place(line: np.ndarray, table: np.ndarray) -> np.ndarray:
    """By place, the weighted sum of ``table`` over all subsequences that begin there."""
    out = np.zeros(len(line), np.float32)
    padded = np.append(line, np.full(SPAN, _END, np.uint8))
    for a in range(0, len(line), _CHUNK):
        c = padded[a:a + _CHUNK + SPAN - 1].astype(np.int32)
        m = min(_CHUNK, len(line) - a)
        parts = [c[k:k + m] for k in range(SPAN)]
        shifted = {(k, s): parts[k] << (5 * s) for k in range(SPAN) for s in range(1, ORDER)}
        by_gaps = np.zeros((SPAN - ORDER + 1, m), np.float32)
        code, value = np.empty(m, np.int32), np.empty(m, np.float32)
        head, last = None, None
        for places in _PLACES:
            if places[:-1] != last:
                last = places[:-1]
                head = shifted[0, ORDER - 1].copy()
                for s, k in enumerate(last):
                    head += shifted[k, ORDER - 2 - s]
            np.add(head, parts[places[-1]], out=code)
            np.take(table, code, out=value, mode="clip")
            by_gaps[places[-1] + 1 - ORDER] += value
        out[a:a + m] = (DECAY ** np.arange(len(by_gaps), dtype=np.float32)) @ by_gaps
    return out


def window_sums(values: np.ndarray) -> np.ndarray:
    """By place, the sum of ``values`` over the window that begins there."""
    total = np.zeros(len(values) + WINDOW)
    np.cumsum(values, out=total[1:len(values) + 1], dtype=np.float64)
    total[len(values) + 1:] = total[len(values)]
    return total[WINDOW:] - total[:-WINDOW]


def largest(sums: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The largest sum by row, ends apart; 0 for an empty one."""
    out, full = np.zeros(len(at) - 1), np.flatnonzero(np.diff(at) > WINDOW)
    if len(full):
        inner = np.column_stack([at[:-1][full], at[1:][full] - WINDOW]).reshape(-1)
        out[full] = np.maximum.reduceat(sums, inner)[::2]
    return out


def worst(sums: np.ndarray, at: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of each row's windows of the largest sums, apart from each other, ``most`` at most.

    The first is there whatever its sum, the others while they reach ``SHARE`` of it.  The first of equal ones counts.
    """
    rows, places = [], []
    for i, (a, z, n) in enumerate(zip(at[:-1].tolist(), np.maximum(at[1:] - WINDOW, at[:-1] + 1).tolist(), most.tolist())):
        own, least = sums[a:z] if n == 1 else sums[a:z].copy(), -np.inf
        for _ in range(n):
            k = int(own.argmax())
            if own[k] < least:
                break
            rows.append(i)
            places.append(a + k)
            least = max(SHARE * own[k], 1e-9) if least == -np.inf else least
            if n > 1:
                own[max(0, k - _READ):k + _READ] = -np.inf
    return np.array(rows, np.int64), np.array(places, np.int64)


def condensed(line: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, begins, rows) of the rows that hold letters parted one by one, without what parts them."""
    letter = np.concatenate([[False, False], line < 26, [False, False]])
    sep = np.concatenate([[False, False], (line >= 26) & (line != _END), [False, False]])
    near = lambda k: letter[2 + k:2 + k + len(line)]
    drop = sep[2:-2] & near(-1) & near(1) & ~near(-2) & ~near(2)
    gone = np.add.reduceat(drop, at[:-1]) if len(at) > 1 else np.zeros(0, np.int64)
    rows = np.flatnonzero(gone > 1)
    keep = np.repeat(gone > 1, np.diff(at)) & ~drop
    return line[keep], np.append(0, np.cumsum(np.diff(at)[rows] - gone[rows])), rows


def cut(line: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The windows' symbols, a row each, with as many more as their subsequences can read."""
    padded = np.append(line, np.full(SPAN, _END, np.uint8))
    out = padded[places[:, None] + np.arange(_READ)]
    # What follows a row's end belongs to others.
    out[np.maximum.accumulate(out == _END, axis=1)] = _END
    return out


def window_codes(windows: np.ndarray) -> np.ndarray:
    """Codes of all subsequences, a row a window; the place in ``_WEIGHTS`` changes fastest."""
    c = windows.astype(np.int32)
    out = np.empty((len(c), WINDOW, len(_PLACES)), np.int32)
    for n, places in enumerate(_PLACES):
        code = c[:, :WINDOW] << (5 * (ORDER - 1))
        for s, k in enumerate(places):
            code = code + (c[:, k:k + WINDOW] << (5 * (ORDER - 2 - s)))
        out[:, :, n] = code
    return out.reshape(len(c), -1)


def _whole(codes: np.ndarray) -> np.ndarray:
    """Which codes hold no end."""
    out = np.ones(codes.shape, bool)
    for s in range(ORDER):
        out &= ((codes >> (5 * s)) & 31) != _END
    return out


class Landmarks:
    """Windows that stand for all others: kernels with them are the features."""

    def __init__(self, windows: np.ndarray):
        self.windows = windows
        codes = window_codes(windows)
        real = _whole(codes)
        self.codes, row = np.unique(codes[real], return_inverse=True)
        self.table = np.zeros((len(self.codes) + 1, len(windows)), np.float32)
        weights = np.broadcast_to(np.tile(_WEIGHTS, WINDOW), codes.shape)[real]
        np.add.at(self.table, (row, np.nonzero(real)[0]), weights)

    def place(self) -> np.ndarray:
        out = np.full(CODES, len(self.codes), np.int32)
        out[self.codes] = np.arange(len(self.codes))
        return out

    def kernels(self, windows: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
        """Gap-weighted subsequence kernels of windows, a row each, with the landmarks."""
        place = self.place() if place is None else place
        out = np.zeros((len(windows), self.table.shape[1]), np.float32)
        for a in range(0, len(windows), 512):
            rows = place[window_codes(windows[a:a + 512])]
            weights = np.tile(_WEIGHTS, WINDOW)
            for k in range(rows.shape[1]):
                hit = np.flatnonzero(rows[:, k] < len(self.codes))
                out[a + hit] += weights[k] * self.table[rows[hit, k]]
        return out

    def spread(self, beta: np.ndarray) -> np.ndarray:
        """The weight of every subsequence in the sum of ``beta`` times the kernels."""
        out = np.zeros(CODES, np.float32)
        out[self.codes] = self.table[:-1] @ beta.astype(np.float32)
        return out


def pivots(kernel: np.ndarray, most: int) -> list[int]:
    """Rows that leave the least of a kernel matrix unexplained, one after the other (pivoted Cholesky)."""
    rest, found = np.diag(kernel).copy(), []
    factor = np.zeros((len(kernel), most))
    for k in range(min(most, len(kernel))):
        i = int(rest.argmax())
        if rest[i] < 1e-3:
            break
        found.append(i)
        factor[:, k] = (kernel[:, i] - factor[:, :k] @ factor[i, :k]) / np.sqrt(rest[i])
        rest -= factor[:, k] ** 2
    return found


def _windows_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("w").to_pylist()), np.uint8).reshape(-1, _READ)


def suspicious(taught: DataFrame) -> np.ndarray:
    """For every subsequence without gaps, by how much its documents are oftener of label 1, as far as counts are sure of it.

    Counts are documents, all labelled training rows; the number of subsequences is fixed.
    """
    def count(batches):
        total = np.zeros((2, CODES), np.int64)
        documents = np.zeros(2, np.int64)
        for batch in slices(batches):
            y = (batch.column("y").to_numpy(zero_copy_only=False) > 0).astype(np.int64)
            line, at = symbols(Texts.of(batch.column("text")))
            code = plain_codes(line)
            row = np.repeat(np.arange(len(y)), np.diff(at))
            real = _whole(code)
            held = np.unique(row[real] * CODES + code[real])
            np.add.at(total, (y[held // CODES], held % CODES), 1)
            documents += np.bincount(y, minlength=2)
        used = np.append(np.flatnonzero(total.any(0)), CODES)
        total = np.column_stack([total, documents])
        yield pa.RecordBatch.from_pydict({
            "code": pa.array(used.astype(np.int32)), "clean": pa.array(total[0, used]), "toxic": pa.array(total[1, used])})

    found = taught.mapInArrow(count, "code int, clean long, toxic long").groupBy("code").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    counts = np.zeros((2, CODES + 1))
    counts[:, found.column("code").to_numpy()] = [found.column(c).to_numpy() for c in ("clean", "toxic")]
    # The last place counts the documents.
    (clean, toxic), (n_clean, n_toxic) = counts[:, :-1], counts[:, -1]
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    sure = odds - 2 * np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    return np.maximum(sure, 0).astype(np.float32)


def varied(windows: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The windows with one strange character or two put in, where and which by ``seed``."""
    out, place, n = windows, np.arange(_READ), np.arange(len(windows))
    for k in range(2):
        draw = mixed(seed * _STEP + np.uint64(k + 1))
        at = (draw % np.uint64(_READ - 6)).astype(np.int64) + 2
        symbol = np.array([26, 27, 28, *range(26)], np.uint8)[((draw >> np.uint64(20)) % np.uint64(29)).astype(np.int64)]
        moved = np.where(place > at[:, None], np.roll(out, 1, 1), out)
        moved[n, at] = symbol
        out = np.where((draw >> np.uint64(40) & np.uint64(1) == 1)[:, None], moved, out) if k else moved
    out[np.maximum.accumulate(out == _END, axis=1)] = _END
    return out


def chosen(taught: DataFrame, values, base: float) -> DataFrame:
    """``(y, h, kind, v, w)``: the windows that teach, ``values(line)`` summed over a window and ``base`` being its suspicion ``v``.

    ``kind`` 0 are the worst windows, up to ``TOPS`` of a toxic text and one of a clean one, 1 such with characters put in, 2
    others of clean texts at hashed places.
    """
    def choose(batches):
        for batch in slices(batches):
            y = batch.column("y").to_numpy(zero_copy_only=False) > 0
            h = batch.column("h").to_numpy(zero_copy_only=False)
            line, at = symbols(Texts.of(batch.column("text")))
            sums = window_sums(values(line)) + base
            rows, places = worst(sums, at, np.where(y, TOPS, 1))
            clean = np.repeat(np.flatnonzero(~y), OTHERS)
            seed = mixed(h[clean].astype(np.uint64) + np.tile(np.arange(OTHERS, dtype=np.uint64), len(clean) // OTHERS) * _STEP)
            other = at[clean] + (seed % np.maximum(np.diff(at)[clean] - WINDOW, 1).astype(np.uint64)).astype(np.int64)
            w, more = cut(line, places), cut(line, other)
            seeds = [mixed(h[rows].astype(np.uint64) * _STEP + places.astype(np.uint64) - at[rows].astype(np.uint64) + np.uint64(k)) for k in range(VIRTUAL)]
            w = np.vstack([w, *[varied(w, x) for x in seeds], more])
            of = np.concatenate([*[rows] * (VIRTUAL + 1), clean])
            kind = np.repeat(np.array([0, 1, 2], np.int32), [len(rows), VIRTUAL * len(rows), len(clean)])
            v = np.concatenate([*[sums[places]] * (VIRTUAL + 1), sums[other]])
            yield pa.RecordBatch.from_pydict({
                "y": pa.array(np.where(y[of], 1, -1).astype(np.int32)), "h": pa.array(h[of]), "kind": pa.array(kind), "v": pa.array(v.astype(np.float64)),
                "w": pa.array([x.tobytes() for x in w], pa.binary())})

    return stored(taught.mapInArrow(choose, "y int, h long, kind int, v double, w binary"), "windows")


def landmarks_of(windows: DataFrame) -> Landmarks:
    """Landmarks among the worst windows of ``CHOICE`` toxic and half as many clean ones, by the least id hashes.

    Pivots of their kernels, weighted by suspicion: windows that are suspicious and unlike the landmarks so far.
    """
    found = [windows.where((F.col("y") == y) & (F.col("kind") == 0)).orderBy("h", "v", "w").limit(n).select("v", "w").collect()
             for y, n in ((1, CHOICE), (-1, CHOICE // 2))]
    usual = float(np.median([r["v"] for r in found[1]])) if found[1] else 0.0
    weight = {}
    for r in found[0] + found[1]:
        weight[bytes(r["w"])] = max(r["v"] - usual, 1e-3)
    some = np.frombuffer(b"".join(weight), np.uint8).reshape(-1, _READ)
    kernel = np.hstack([Landmarks(some[a:a + 64]).kernels(some) for a in range(0, len(some), 64)]).astype(np.float64)
    share = np.sqrt(np.array(list(weight.values())) / np.maximum(np.diag(kernel), 1e-9))
    return Landmarks(some[pivots(kernel * np.outer(share, share), LANDMARKS)])


def machine(windows: DataFrame, landmarks: Landmarks) -> tuple[np.ndarray, float]:
    """(weight of each landmark's kernel, constant) of the support vector machine with squared hinge errors.

    Features are K(w, Z) K(Z, Z)^-1/2; Newton steps sum the errors' rows in every task, so all windows count and the
    driver holds a matrix of the landmarks' size.
    """
    kernel = landmarks.kernels(landmarks.windows).astype(np.float64)
    scale = float(np.diag(kernel).mean())
    values, vectors = np.linalg.eigh(kernel / scale)
    root = vectors / np.sqrt(np.maximum(values, 1e-3)) / scale
    size = len(kernel) + 1

    def measure(batches):
        place = landmarks.place()
        for batch in batches:
            if batch.num_rows:
                z = (landmarks.kernels(_windows_of(batch), place) @ root).astype(np.float32)
                yield pa.RecordBatch.from_pydict({"y": batch.column("y"), "z": pa.array([r.tobytes() for r in z], pa.binary())})

    rows = stored(windows.mapInArrow(measure, "y int, z binary"), "kernels")
    n = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    w = np.zeros(size)

    def read(batch):
        z = np.frombuffer(b"".join(batch.column("z").to_pylist()), np.float32).reshape(batch.num_rows, -1).astype(np.float64)
        return np.column_stack([z, np.ones(len(z))]), batch.column("y").to_numpy(zero_copy_only=False).astype(np.float64)

    def errors(w):
        def add(batch):
            z, y = read(batch)
            short = 1 - y * (z @ w)
            bad = short > 0
            zb, c = z[bad], COST / sum(n.values())
            loss = np.zeros((1, size + 1))
            loss[0, 0] = c * (short[bad] ** 2).sum()
            return np.vstack([np.column_stack([c * zb.T @ zb, -c * zb.T @ (y[bad] * short[bad])]), loss])
        total = matrix_sum(rows, add, (size + 1, size + 1))
        ridge = np.append(np.ones(size - 1), 1e-6)
        return total[:size, :size] + np.diag(ridge), total[:size, size] + ridge * w, total[size, 0] + (ridge * w * w).sum()

    hessian, slope, height = errors(w)
    for _ in range(STEPS):
        step, t = np.linalg.solve(hessian, slope), 1.0
        while True:
            after = errors(w - t * step)
            if after[2] <= height or t < 0.1:
                break
            t /= 2
        done = height - after[2] < 1e-4 * height
        if after[2] <= height:
            w, (hessian, slope, height) = w - t * step, after
        if done:
            break
    return root @ w[:-1], float(w[-1])


def toxicity_scores(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
                    folds: int = 3, held_out: int = 1, sample: int = SAMPLE) -> DataFrame:
    """Calibrated probability of label 1 for each document: the id, ``held_out``, ``score`` and ``margin``.

    A text's margin is that of its worst window of ``WINDOW`` places.  Windows compare by the gap-weighted subsequence
    kernel: ``ORDER`` characters in their order, up to ``SPAN`` - ``ORDER`` others between them, each of which weakens the match by ``DECAY``; so letters set
    apart or strange ones put in leave a likeness; letters that are all set apart one by one are read together as well.  Landmarks make the kernel a finite set of features (Nyström), and as
    these are sums over subsequences, the machine's weights collapse into one table of all ``CODES`` subsequences, with
    which every place of every text is read.

    Labels belong to documents.  Of one labelled 1 the most suspicious windows are positives; of another the worst is a
    negative, besides some at hashed places; copies with characters put in teach alike.  Suspicion is first that of counted
    subsequences, then the machine's own.
    Rows whose id's crc32 is ``held_out`` modulo ``folds`` teach nothing; of the others at most ``sample`` labelled rows
    are learnt from, those of the least id hashes, a quarter of which calibrates and the rest fits.  So the labels that are joined have a
    size bound, and no text but those of the sample moves.  Landmarks are chosen among ``CHOICE`` windows.  All texts are scored, whole.
    Null and empty texts have the margin of an empty window and a score like any other; rows without a label or with a null one only
    get scores; repeated labels all count; a null id's crc is that of the empty text.  Without labels of both kinds
    the score is the share of label 1, 0.5 without any.  Extra columns are ignored.
    """
    shipped(docs.sparkSession)
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    known = labels.select(F.col(id).alias("doc_id"), F.col(label).cast("double").alias("y")).where("y IS NOT NULL")
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    some = stored(known.where("doc_id IS NOT NULL").where(crc_mod("doc_id", folds) != held_out).orderBy(hashed, "doc_id", "y").limit(sample), "sample")
    labelled = stored(
        rows.join(F.broadcast(some), "doc_id")
        .select("text", "y", hashed.alias("h"), (F.pmod(hashed, F.lit(4)) == 0).alias("calibrates")), "labelled")
    taught = labelled.where("NOT calibrates").select("text", "y", "h")
    counts = {r["y"]: r["n"] for r in labelled.groupBy((F.col("y") > 0).alias("y"), "calibrates").agg(F.count(F.lit(1)).alias("n")).groupBy("y").agg(F.sum("n").alias("n")).collect()}
    out = rows.select(F.col("doc_id").alias(id), (crc_mod("doc_id", folds) == held_out).alias("held_out"))
    both = taught.groupBy((F.col("y") > 0).alias("y")).count().count() == 2
    if not both:
        share = counts.get(True, 0) / sum(counts.values()) if counts else 0.5
        return out.select(id, "held_out", F.lit(share).alias("score"), F.lit(0.0).alias("margin"))

    odds = suspicious(taught)
    windows = chosen(taught, lambda line: odds[plain_codes(line)], 0.0)
    for turn in range(ROUNDS):
        if turn:
            # What the machine puts at its clean edge is not suspicious at all.
            windows = chosen(taught, lambda line, table=theta: sums_by_place(line, table), constant + 1)
        landmarks = landmarks_of(windows)
        beta, constant = machine(windows, landmarks)
        theta = landmarks.spread(beta)

    def margins(batch):
        line, at = symbols(Texts.of(batch.column("text")))
        out = largest(window_sums(sums_by_place(line, theta)), at)
        # Letters set apart one by one are read together as well.
        line, at, rows = condensed(line, at)
        if len(rows):
            out[rows] = np.maximum(out[rows], largest(window_sums(sums_by_place(line, theta)), at))
        return out + constant

    def steps(batch):
        return np.clip((margins(batch) - REACH[0]) / (REACH[1] - REACH[0]) * GRID, 0, GRID).astype(np.int64)

    def count(batches):
        total = np.zeros((GRID + 1, 2), np.int64)
        for batch in slices(batches):
            at = steps(batch)
            total[:, 0] += np.bincount(at, batch.column("y").to_numpy(zero_copy_only=False) > 0, GRID + 1).astype(np.int64)
            total[:, 1] += np.bincount(at, minlength=GRID + 1)
        used = np.flatnonzero(total[:, 1])
        yield pa.RecordBatch.from_pydict({"step": pa.array(used, pa.int32()), "hits": pa.array(total[used, 0]), "n": pa.array(total[used, 1])})

    grid = (
        labelled.where("calibrates").select("text", "y").mapInArrow(count, "step int, hits long, n long")
        .groupBy("step").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).orderBy("step").collect()
    )
    place, rate = levels([(r["step"], r["hits"], r["n"]) for r in grid])

    def score(batches):
        for batch in slices(batches):
            m = margins(batch)
            at = (np.clip(m, *REACH) - REACH[0]) / (REACH[1] - REACH[0]) * GRID
            value = np.interp(at, place, rate) if len(place) else 1 / (1 + np.exp(-2 * m))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(value), pa.array(m)], ["doc_id", "score", "margin"])

    return rows.mapInArrow(score, f"doc_id {kind}, score double, margin double").select(
        F.col("doc_id").alias(id), (crc_mod("doc_id", folds) == held_out).alias("held_out"), "score", "margin")


def levels(grid: list[tuple[int, int, int]]) -> tuple[list[float], list[float]]:
    """Rising rates of label 1 by margin step: neighbours that fall are pooled.

    Flat over a pool and a third of the gap to the next, straight between.
    """
    pools: list[tuple[int, int, int, int]] = []
    for step, hits, n in grid:
        pools.append((step, step + 1, hits, n))
        while len(pools) > 1 and pools[-2][2] * pools[-1][3] >= pools[-1][2] * pools[-2][3]:
            _, last, h, m = pools.pop()
            pools[-1] = (pools[-1][0], last, pools[-1][2] + h, pools[-1][3] + m)
    place, rate = [], []
    for k, (first, last, hits, n) in enumerate(pools):
        below = (first - pools[k - 1][1]) / 3 if k else 0
        above = (pools[k + 1][0] - last) / 3 if k + 1 < len(pools) else 0
        place += [first - below, last + above]
        rate += [hits / n] * 2
    return place, rate
