"""The classifier and the language model against plain arithmetic on all rows at once."""

import math
import zlib

import numpy as np
import pyarrow as pa
from brute import FOLDER
from pageloom.llm import classifier, language
from pageloom.llm.common import Texts


def crc(i):
    return zlib.crc32(("" if i is None else str(i)).encode())


def test_classifier_matches_normal_equations_on_the_driver(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    quality = {r.doc_id: r.quality for r in labels.collect()}
    x = classifier.statistics(Texts.of(pa.array([r.text for r in rows]))).astype(np.float64)
    fourier = classifier.Fourier(x.mean(0), x.std(0))
    fold = np.array([crc(r.doc_id) % 5 for r in rows])
    known = np.array([quality.get(r.doc_id) is not None for r in rows])
    y = np.array([quality.get(r.doc_id) or 0 for r in rows], float)
    fit = known & (fold != 0) & (fold != 4)
    z = fourier(x[fit])
    weights = np.linalg.solve(z.T @ z + classifier.RIDGE * fit.sum() * np.eye(z.shape[1]), z.T @ y[fit])
    low, high = classifier.SPAN
    at = np.clip((fourier(x) @ weights - low) / (high - low), 0, 1) * classifier.STEPS
    steps = {}
    for k in np.flatnonzero(known & (fold == 4)):
        hits, n = steps.get(int(at[k]), (0, 0))
        steps[int(at[k])] = hits + y[k], n + 1
    # Pooled neighbours in plain loops: weighted place, hits, count.
    pools = []
    for s in sorted(steps):
        pools.append([(s + 0.5) * steps[s][1], *steps[s]])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    want = np.interp(at, [p / n for p, _, n in pools], [h / n for _, h, n in pools])
    got = {r.doc_id: r.score for r in classifier.quality_scores(docs, labels).collect()}
    assert np.abs(np.array([got[r.doc_id] for r in rows]) - want).max() < 2e-3


def plain_places(row):
    """Places of both half-bytes of a row's bytes in the tables, by predictor, and whether a word has begun."""
    data = np.frombuffer(row, np.uint8)
    return language.contexts(data, np.array([0, len(data)]))


def plain_nats(row, table):
    """The cost of a row, byte by byte and bit by bit; weights are corrected after each block."""
    found, inside = plain_places(row)
    weights = [[[language.FIRST[i]] * 8 for _ in range(2)] for i in range(3)]
    cost, change = 0.0, [[[0.0] * 8 for _ in range(2)] for _ in range(3)]
    for k, byte in enumerate(row):
        gate = int(inside[k])
        for b in range(8):
            half, depth = divmod(b, 4)
            value = byte >> 4 if half == 0 else byte & 15
            node = (1 << depth) | (value >> (4 - depth)) if depth else 1
            inputs = [table[int(found[i][half][k]) // 16][node] / language.SCALE for i in range(3)]
            bit = (byte >> (7 - b)) & 1
            mixed = min(max(sum(weights[i][gate][b] * s for i, s in enumerate(inputs)), -16), 16)
            cost += math.log1p(math.exp(mixed)) - bit * mixed
            error = bit - 1 / (1 + math.exp(-mixed))
            for i, s in enumerate(inputs):
                change[i][gate][b] += language.RATE * error * s
        if (k + 1) % language.BLOCK == 0:
            for i in range(3):
                for g in range(2):
                    for j in range(8):
                        weights[i][g][j] += change[i][g][j]
                        change[i][g][j] = 0.0
    return cost


def test_mixing_matches_plain_loops(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    rows = [(i, t if k % 7 else None) for k, (i, t) in enumerate(rows)][:60] + [(None, "one more text")]
    lower = lambda t: (t or "").encode().lower() + b"\x00"
    counts = {}
    for i, t in rows:
        if crc(i) % 5 == 1:
            continue
        row = lower(t)
        for high, low in plain_places(row)[0]:
            for at in (*high.tolist(), *low.tolist()):
                counts[at] = counts.get(at, 0) + 1
    table = {}

    class Table:
        """Stored logits of a row's decision tree, from its sixteen counts."""

        def __getitem__(self, r):
            if r not in table:
                own = [counts.get(16 * r + v, 0) for v in range(16)]
                table[r] = [0] * 16
                for node in range(1, 16):
                    depth = node.bit_length() - 1
                    under = [n for v, n in enumerate(own) if (1 << depth | v >> (4 - depth)) == node]
                    half = len(under) // 2
                    ones, zeros = sum(under[half:]) + language.ADDED, sum(under[:half]) + language.ADDED
                    table[r][node] = min(max(round(language.SCALE * math.log(ones / zeros)), -127), 127)
            return table[r]

    got = {r.doc_id: r for r in language.scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    for i, t in rows:
        nats = plain_nats(lower(t), Table())
        assert abs(got[i].score + nats / math.log(10)) < 1e-3 * nats + 1e-3
