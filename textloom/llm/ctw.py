"""LM scoring (3): context-tree weighting over bytes, decomposed into bits.

Each bit of a byte has a context tree over the bytes before it, up to `depth`; a node is (context, the byte's earlier bits). Nodes
hold Krichevsky-Trofimov estimates, and CTW's recursion weights every depth by what the training corpus says, so the probability of
a bit is the exact CTW mixture of the KT estimates along its path. Nodes seen `least` times or more are kept; rarer contexts of a
node, and those never seen, are pooled in one child of it. The count is absolute, so the tree grows with the corpus.

The tree is never held in one place. Contexts that share their nearest three bytes lie in one part, whose subtrees are weighted on
their own (`subtree`); the sums of their children's weights go up to the nodes of two bytes and less (`upper`), which are at most
256 * 256 * 255 whatever the corpus (UTF-8 text has far fewer) and come back down as a broadcast. Grams are (context, byte) in one
long: the nearest byte on top, the byte itself lowest. Texts are lower-cased UTF-8 bytes and an end mark.

Without training rows all bits have 1/2. All functions here are numpy on arrays; lm_score.py deals them out.
"""
from __future__ import annotations

import zlib

import numpy as np

START, END = 0xFE, 0xFF  # bytes that UTF-8 never has
DEPTH, LEAST = 6, 2
TOP = 2  # depth of the nodes that all parts share


def grams_of(texts: list[bytes], depth: int, limit: int = 1 << 18):
    """(keys, text of each stretch, where each stretch starts) of about `limit` symbols each. Long texts come in stretches."""
    buffer, owners, starts, size = [], [], [], 0

    def keys():
        b = np.frombuffer(b"".join(buffer), dtype=np.uint8).astype(np.uint64)
        k = b[depth:].copy()
        for back in range(1, depth + 1):
            k |= b[depth - back : len(b) - back] << np.uint64(8 * (depth + 1 - back))
        keep = np.ones(len(k), dtype=bool)
        for s in starts[1:]:
            keep[s - depth : s] = False  # the context that a stretch begins with is no symbol
        at = np.array(starts) - depth * np.arange(len(starts))
        return k[keep].view(np.int64), np.array(owners), at

    for n, text in enumerate(texts):
        text = text.lower() + bytes([END])
        for a in range(0, len(text), limit):
            part = text[max(0, a - depth) : a] if a else b""
            part = bytes([START]) * (depth - len(part)) + part
            piece = text[a : a + limit]
            starts.append(size)
            owners.append(n)
            buffer += [part, piece]
            size += depth + len(piece)
            if size >= limit:
                yield keys()
                buffer, owners, starts, size = [], [], [], 0
    if size:
        yield keys()


def add_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


class Sum:
    """Counts by key of many arrays; merged whenever what waits outgrows the total, so memory follows the distinct keys."""

    def __init__(self, wait: int = 500_000):
        self.total, self.waiting, self.size, self.wait = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)), [], 0, wait

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.waiting.append((keys, counts))
        self.size += len(keys)
        if self.size > max(self.wait, len(self.total[0])):
            self.get()

    def get(self) -> tuple[np.ndarray, np.ndarray]:
        if self.waiting:
            self.total = add_up(*(np.concatenate(x) for x in zip(self.total, *self.waiting)))
            self.waiting, self.size = [], 0
        return self.total


def count(texts: list[bytes], learned: list[bool], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of all texts and their counts in those that are learned from."""
    found = Sum()
    for use in (True, False):
        for keys, _, _ in grams_of([t for t, own in zip(texts, learned) if own == use], depth, 1 << 20):
            grams, n = np.unique(keys, return_counts=True)
            found.add(grams, n if use else np.zeros(len(n), dtype=np.int64))
    return found.get()


def _half(n: int) -> np.ndarray:
    return np.concatenate([[0.0], np.cumsum(np.log(np.arange(n - 1) + 0.5))])  # log gamma(k + 1/2), less that of 1/2


_SMALL = 1 << 12
_GAMMA_HALF, _GAMMA_ONE = _half(_SMALL), np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, _SMALL)))])


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3)


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the KT estimate of a sequence with so many zeros and ones; counts are whole numbers."""
    def gamma(table, n, shift):
        small = n < _SMALL
        out = table[np.where(small, n, 0).astype(np.int64)]
        if not small.all():
            out[~small] = _log_gamma(n[~small] + shift) - (0.5 * np.log(np.pi) if shift == 0.5 else 0.0)
        return out

    return gamma(_GAMMA_HALF, zeros, 0.5) + gamma(_GAMMA_HALF, ones, 0.5) - gamma(_GAMMA_ONE, zeros + ones, 1.0)


def kept_nodes(rows: np.ndarray, n: np.ndarray, least: float) -> list[dict]:
    """For each bit, the nodes with a count of `least` or more of sorted rows (context, byte): key (context, earlier bits after a leading 1), zeros, ones."""
    out = []
    for bit in range(7, -1, -1):
        key = rows & ~np.int64(255) | (1 << (7 - bit)) | (rows & 255) >> (bit + 1)
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        total, one = (np.add.reduceat(x, first) if len(first) else x for x in (n, np.where(rows >> bit & 1, n, 0)))
        keep = total >= least
        out.append({"key": key[first][keep], "zeros": (total - one)[keep].astype(float), "ones": one[keep].astype(float)})
    return out


def _parent(key: np.ndarray) -> np.ndarray:
    return (key >> 16) << 8 | (key & 255)


def weigh(tree: dict[int, list[dict]], below: list[tuple] | None = None) -> None:
    """CTW's recursion from the deepest nodes up. below: for each bit (key, log weight, zeros, ones), summed over the kept children, of nodes of the last depth."""
    last = max(tree)
    for d in sorted(tree, reverse=True):
        for b, x in enumerate(tree[d]):
            n, own = len(x["key"]), log_kt(x["zeros"], x["ones"])
            if d < last:
                y = tree[d + 1][b]
                up = y["up"] = np.searchsorted(x["key"], _parent(y["key"]))
                sums = y["weighted"], y["zeros"], y["ones"]
            else:
                key, *sums = below[b] if below else (x["key"][:0], *[own[:0]] * 3)
                up = np.searchsorted(x["key"], key)
            children, zeros, ones = (np.bincount(up, weights=s, minlength=n) for s in sums)
            rest0, rest1 = np.maximum(x["zeros"] - zeros, 0), np.maximum(x["ones"] - ones, 0)
            inner, split = np.bincount(up, minlength=n) > 0, children + log_kt(rest0, rest1)
            x["weighted"] = np.where(inner, np.logaddexp(own, split) - np.log(2), own)
            x["stay"] = np.where(inner, 1 / (1 + np.exp(np.clip(split - own, -600, 600))), 1.0)
            x["kt"], x["pooled"] = (x["ones"] + 0.5) / (x["zeros"] + x["ones"] + 1), (rest1 + 0.5) / (rest0 + rest1 + 1)


def spread(tree: dict[int, list[dict]], above: list[dict] | None = None) -> dict[int, list[dict]]:
    """The mixture's probability of a 1 for contexts whose kept path ends at a node (p), and what goes on to its children (carry, so_far)."""
    out: dict[int, list[dict]] = {}
    for d in sorted(tree):
        out[d] = []
        for b, x in enumerate(tree[d]):
            before = out[d - 1][b] if d - 1 in out else above[b] if above else None
            if before is None:
                carry, so_far = np.ones(len(x["key"])), np.zeros(len(x["key"]))
            else:
                up = np.searchsorted(before["key"], _parent(x["key"]))
                carry, so_far = before["carry"][up], before["so_far"][up]
            p = so_far + carry * (x["stay"] * x["kt"] + (1 - x["stay"]) * x["pooled"])
            out[d].append({"key": x["key"], "p": np.clip(p, 1e-12, 1 - 1e-12), "carry": carry * (1 - x["stay"]), "so_far": so_far + carry * x["stay"] * x["kt"]})
    return out


def subtree(grams: np.ndarray, counts: np.ndarray, depth: int, least: float) -> dict[int, list[dict]]:
    """The weighted nodes deeper than TOP of whole parts' sorted grams."""
    seen = counts > 0
    grams, counts, tree = grams[seen], counts[seen], {}
    for d in range(depth, TOP, -1):
        rows, n = add_up((grams >> 8 * (depth - d + 1)) << 8 | (grams & 255), counts)
        tree[d] = kept_nodes(rows, n, least)
    weigh(tree)
    return tree


def going_up(tree: dict[int, list[dict]]) -> tuple[np.ndarray, ...]:
    """(key, log weight, zeros, ones) sums over the children of nodes of depth TOP; a key names its bit too."""
    out = []
    for x in tree[TOP + 1]:
        key, order = _parent(x["key"]), np.argsort(_parent(x["key"]), kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, dtype=np.int64)
        out.append((key[first], *(np.add.reduceat(x[c][order], first) if len(first) else x[c] for c in ("weighted", "zeros", "ones"))))
    return tuple(np.concatenate(c) for c in zip(*out))


def upper(rows: np.ndarray, n: np.ndarray, sums: tuple[np.ndarray, ...], least: float) -> dict[int, list[dict]]:
    """The nodes of depth TOP and less, from (two bytes, byte) rows of the whole corpus and what goes_up; the root's nodes are all there."""
    tree = {}
    for d in range(TOP, 0, -1):
        tree[d] = kept_nodes(*add_up((rows >> 8 * (TOP - d + 1)) << 8 | (rows & 255), n), least)
    zero, one = np.zeros(256), np.zeros(256)
    for x in kept_nodes(*add_up(rows & 255, n), 1):
        zero[x["key"]], one[x["key"]] = x["zeros"], x["ones"]
    tree[0] = [{"key": np.arange(1 << b, 2 << b), "zeros": zero[1 << b : 2 << b], "ones": one[1 << b : 2 << b]} for b in range(8)]
    order = np.argsort(sums[0])
    sums = tuple(x[order] for x in sums)
    bit = np.frexp((sums[0] & 255).astype(float))[1] - 1 if len(sums[0]) else sums[0]
    weigh(tree, [tuple(x[bit == b] for x in sums) for b in range(8)])
    return spread(tree)


def _find(keys: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Places of want in sorted keys; -1: absent."""
    if not len(keys):
        return np.full(len(want), -1)
    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
    return np.where(keys[at] == want, at, -1)


class Model:
    """Scores grams of some parts: their subtree under the shared upper nodes."""

    def __init__(self, tree: dict[int, list[dict]], top: dict[int, list[dict]], depth: int):
        self.depth, self.levels = depth, {**top, **spread(tree, top[TOP])}
        self.whole = {d: self._whole(d) for d in self.levels}

    def _whole(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores of the bytes whose nodes are all kept in one context of depth d."""
        last = self.levels[d][7]["key"]
        rows = np.repeat(last & ~np.int64(255) | (last << 1 & 255), 2)
        rows[1::2] |= 1
        score = np.zeros(len(rows))
        for b, x in enumerate(self.levels[d]):
            p = x["p"][np.searchsorted(x["key"], rows & ~np.int64(255) | (1 << b) | (rows & 255) >> (8 - b))]
            score += np.log10(np.where(rows >> (7 - b) & 1, p, 1 - p))
        return rows, score

    def scores(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte in its context; grams sorted. Bytes whose deepest context has them whole take one search."""
        score, left = np.zeros(len(grams)), np.arange(len(grams))
        for d in range(self.depth, -1, -1):
            context = grams[left] >> 8 * (self.depth - d + 1) << 8
            here = _find(self.levels[d][0]["key"], context | 1) >= 0
            own, context = left[here], context[here]
            at = _find(self.whole[d][0], context | grams[own] & 255)
            score[own] = self.whole[d][1][at] if len(self.whole[d][1]) else 0.0
            if (slow := own[at < 0]).size:
                score[slow] = self._by_bits(grams[slow], d)
            left = left[~here]
        return score

    def _by_bits(self, grams: np.ndarray, d: int) -> np.ndarray:
        """Bit by bit; a path that ended at some depth for earlier bits goes no deeper for later ones."""
        score, deepest = np.zeros(len(grams)), np.full(len(grams), d)
        for b in range(8):
            p = np.empty(len(grams))
            for k in range(d, -1, -1):
                left = np.flatnonzero(deepest == k)
                some, x = grams[left], self.levels[k][b]
                at = _find(x["key"], some >> 8 * (self.depth - k + 1) << 8 | (1 << b) | (some & 255) >> (8 - b))
                p[left[at >= 0]] = x["p"][at[at >= 0]]
                deepest[left[at < 0]] = k - 1
            score += np.log10(np.where(grams >> (7 - b) & 1, p, 1 - p))
        return score


def whole_model(grams: np.ndarray, counts: np.ndarray, depth: int, least: float) -> Model:
    """The model of one part that holds everything: for small corpora and tests."""
    tree = subtree(grams, counts, depth, least)
    low, n = low_rows(grams, counts, depth)
    return Model(tree, upper(low, n, going_up(tree), least), depth)


def low_rows(grams: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(TOP bytes, byte) rows and counts of sorted grams."""
    seen = counts > 0
    return add_up((grams[seen] >> 8 * (depth - TOP + 1)) << 8 | (grams[seen] & 255), counts[seen])


def squeeze(x: np.ndarray) -> bytes:
    """Non-negative 64-bit integers by byte planes, deflated."""
    return zlib.compress(x.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(b), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def score_texts(texts: list[bytes], grams: np.ndarray, scores: np.ndarray, depth: int) -> np.ndarray:
    """log10 probability of each text with its end, from the scores of its sorted distinct grams."""
    total = np.zeros(len(texts))
    for keys, owners, starts in grams_of(texts, depth):
        u, inverse = np.unique(keys, return_inverse=True)
        total += np.bincount(owners, weights=np.add.reduceat(scores[np.searchsorted(grams, u)][inverse], starts), minlength=len(texts))
    return total
