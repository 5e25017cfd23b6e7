"""Plain models of the operators, one document after the other."""

import hashlib
import re

#: The smallest given tables.
FOLDER = "/root/testdata/sf0.001"


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def sha(data):
    return hashlib.sha256(data).hexdigest()


def without_repeated_words(rows, window=13):
    """{doc_id: (n_words, n_removed, sha)} by the first document of every window."""
    texts = {i: words_of(t) for i, t in rows}
    least = {}
    for i in sorted(texts):
        w = texts[i]
        for j in range(len(w) - window + 1):
            least.setdefault(tuple(w[j:j + window]), i)
    out = {}
    for i, w in texts.items():
        gone = set()
        for j in range(len(w) - window + 1):
            if least[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), sha(kept.encode()))
    return out


def without_repeated_bytes(rows, window=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)} by the first place of every byte string."""
    texts = {i: (t or "").encode() for i, t in rows}
    first = {}
    for i in sorted(texts):
        b = texts[i]
        for j in range(len(b) - window + 1):
            first.setdefault(b[j:j + window], (i, j))
    out = {}
    for i, b in texts.items():
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if first[b[j:j + window]] < (i, j):
                gone[j:j + window] = b"\x01" * window
        spans = len(re.findall(b"\x01+", bytes(gone)))
        out[i] = (len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g)))
    return out


def near_components(rows, size=5, percent=85):
    """{doc_id: (n_shingles, component_id)} by comparing all documents that share a shingle."""
    sets = {}
    for i, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = words_of(lowered)
        sets[i] = {tuple(w[j:j + size]) for j in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = {}
    for i in sorted(sets):
        shared = {}
        for s in sets[i]:
            for j in holders.setdefault(s, []):
                shared[j] = shared.get(j, 0) + 1
            holders[s].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def word_scores(rows, folds=5, held_out=1):
    """{doc_id: (held_out, n_tokens, n_known, train_tokens, base_score)} by smoothed word frequencies."""
    import math
    import zlib
    from collections import Counter

    end = object()
    tokens, held = {}, {}
    for i, t in rows:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        tokens[i] = [*words_of(lowered), end]
        held[i] = zlib.crc32(("" if i is None else str(i)).encode()) % folds == held_out
    counts = Counter(w for i, ws in tokens.items() if not held[i] for w in ws)
    n, v = sum(counts.values()), len(counts)
    out = {}
    for i, ws in tokens.items():
        score = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)
        out[i] = (held[i], len(ws), sum(counts[w] > 0 for w in ws), n, score)
    return out


def merkle(rows, fan=3):
    """{doc_id: (leaf, subroot, root, proof, folded_root)} of rows (doc_id, source, lang, n_chars, text); line ends are cut from even crc32s."""
    import zlib

    def leaf(row):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row).encode())

    def climb(digests):
        """(root, per leaf the (left, right) siblings of each step)"""
        at, steps = list(range(len(digests))), [[] for _ in digests]
        while len(digests) > 1:
            runs = [digests[i:i + fan] for i in range(0, len(digests), fan)]
            for k, p in enumerate(at):
                steps[k].append((runs[p // fan][:p % fan], runs[p // fan][p % fan + 1:]))
                at[k] = p // fan
            digests = [sha("".join(r).encode()) for r in runs]
        return digests[0], steps

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r)))
        trees[s] = climb([leaf(r) for r in groups[s]])
    root, tops = climb([trees[s][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for r, steps in zip(groups[s], trees[s][1]):
            bad = r
            if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None:
                bad = (*r[:4], r[4].replace("\n", ""))
            h, proof = leaf(bad), ""
            for left, right in steps + tops[k]:
                h = sha(("".join(left) + h + "".join(right)).encode())
                proof += "".join(left + right)
            out.append((r[0], leaf(r), trees[s][0], root, sha(proof.encode()), h, h == root))
    return out
