"""A linear-chain conditional random field in numpy: trained by gradient, decoded by Viterbi in batches.

Tokens of many sentences are laid out in one row with edge positions between them. What a token looks like is a unit of
some group; a unit has a few hashed features, and a group a table of weights for each distance at which it is seen. So
the score of a position is a sum of rows of tables over units, worked out once per distinct unit, without a loop over tokens.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

SPAN = 4  # edge positions around a sentence, and the greatest distance of a feature
HASHED = 1 << 17  # rows of the table of joint features
EDGE, NONE = np.uint64(1), np.uint64(0)


@dataclass
class Group:
    """``units`` (unit, feature) hashes, the unit of each position of the row, and the distances; the last unit is the edge."""

    units: np.ndarray
    of: np.ndarray
    reach: tuple[int, ...]


@dataclass
class Coded:
    """Sentences as rows of units. ``at``: position of each token; ``begin``: number of the first token of each sentence (and the end)."""

    groups: dict[str, Group]
    joint: np.ndarray  # (token, feature) rows of the hashed table
    at: np.ndarray
    begin: np.ndarray


@dataclass
class Weights:
    keys: dict[str, np.ndarray] = field(default_factory=dict)  # known hashes of a group, sorted
    tables: dict[str, np.ndarray] = field(default_factory=dict)  # (distance, feature, label); the last feature is the unknown one
    joint: np.ndarray | None = None
    trans: np.ndarray | None = None
    first: np.ndarray | None = None


class Crf:
    def __init__(self, labels: list[str], weights: Weights | None = None):
        self.labels = labels
        self.w = weights or Weights()
        self.never = np.array([[b.startswith("I-") and a[2:] != b[2:] for b in labels] for a in labels])
        self.never_first = np.array([x.startswith("I-") for x in labels])

    def known(self, name: str, units: np.ndarray) -> np.ndarray:
        """Feature numbers of the units; unknown ones are the last."""
        keys = self.w.keys[name]
        i = np.searchsorted(keys, units)
        return np.where(keys[np.minimum(i, len(keys) - 1)] == units, i, len(keys))

    def scores(self, c: Coded) -> np.ndarray:
        """Score of each label at each token."""
        out = np.zeros((len(c.at), len(self.labels)), np.float32)
        for name, g in c.groups.items():
            ids, table = self.known(name, g.units), self.w.tables[name]
            for k, o in enumerate(g.reach):
                rows = table[k, ids[:, 0]].copy()
                for f in range(1, ids.shape[1]):
                    rows += table[k, ids[:, f]]
                out += rows[g.of[c.at + o]]
        for f in range(c.joint.shape[1]):
            out += self.w.joint[c.joint[:, f]]
        return out

    def decode(self, c: Coded) -> np.ndarray:
        """Best label number of each token.

        A token is surely O where O leads every other label by more than any change of neighbours can be worth: putting O in
        its place changes three transitions at most, and the label after it from I to B. Such tokens cut the row into pieces, which are decoded on their own,
        whatever the length of the text; the result is that of the whole row.
        """
        n, k = len(c.at), len(self.labels)
        path = np.zeros(n, np.int8)
        if not n:
            return path
        s = self.scores(c)
        trans, first = np.where(self.never, -1e4, self.w.trans).astype(np.float32), np.where(self.never_first, -1e4, self.w.first).astype(np.float32)
        allowed = np.concatenate([self.w.trans[~self.never], self.w.first[~self.never_first], [0.0]])
        worth = 3 * (allowed.max() - allowed.min())
        begins = [i for i, x in enumerate(self.labels) if x[0] == "B"]
        restart = np.maximum(0, np.max([s[:, b + 1] - s[:, b] for b in begins], axis=0))  # I-x follows B-x in the labels
        lead = s[:, 0] - s[:, 1:].max(1)
        open_ = lead <= worth + np.append(restart[1:], 0)
        starts_text = np.zeros(n, bool)
        starts_text[c.begin[:-1][c.begin[:-1] < n]] = True
        piece = open_ & (starts_text | ~np.append(False, open_[:-1]))
        begin = np.flatnonzero(piece)
        if not len(begin):
            return path
        ends = open_ & np.append(starts_text[1:] | ~open_[1:], True)
        end = np.flatnonzero(ends) + 1
        ends_text = np.append(starts_text[1:], True)[end - 1]
        length = end - begin
        order = np.argsort(length, kind="stable")
        i = 0
        while i < len(order):
            size = int(np.searchsorted(np.cumsum(length[order[i : i + 65_536]]), 1 << 19)) + 1  # tokens of a batch, about
            rows = order[i : i + size]
            i += size
            a, ln = begin[rows], length[rows]
            t = int(ln.max())
            back = np.zeros((t, len(rows), k), np.int8)
            best = s[a] + np.where(starts_text[a][:, None], first, trans[0])
            live = len(rows)  # rows are ordered by length: those still going on are the last
            final = best.copy()
            for j in range(1, t):
                gone = int(np.searchsorted(ln, j, "right"))
                if gone > len(rows) - live:
                    final[len(rows) - live : gone] = best[: gone - (len(rows) - live)]
                    best = best[gone - (len(rows) - live) :]
                    live = len(rows) - gone
                step = best[:, :, None] + trans
                back[j, gone:] = step.argmax(1)
                best = step.max(1) + s[a[gone:] + j]
            final[len(rows) - live :] = best
            final = final + np.where(ends_text[rows][:, None], 0, trans[:, 0])
            last = final.argmax(1)
            for j in range(t - 1, -1, -1):
                gone = int(np.searchsorted(ln, j, "right"))
                path[a[gone:] + j] = last[gone:]
                if j:
                    last[gone:] = back[j, np.arange(gone, len(rows)), last[gone:]]
        return path

    # -- training -------------------------------------------------------------------------------------------------

    def train(self, parts: list[tuple[Coded, np.ndarray]], epochs: int = 10, rate: float = 0.08, l2: float = 3e-5, drop: float = 0.3, hidden: dict[str, list[int]] | None = None, seed: int = 3) -> None:
        """Maximum likelihood by Adam over ``parts``, batches of coded sentences with their labels.

        Hashes seen once are left out. In each step a share ``drop`` of the units hides its first feature, the word
        itself, and half of these also those named in ``hidden`` by group, so that form and context must carry what the word would. The weights are means over the last third of the epochs.
        """
        k, w, hidden = len(self.labels), self.w, hidden or {}
        for name, g in parts[0][0].groups.items():
            seen, count = np.unique(np.concatenate([np.concatenate([np.repeat(p.groups[name].units, np.minimum(np.bincount(p.groups[name].of, minlength=len(p.groups[name].units)), 2), axis=0).ravel()]) for p, _ in parts]), return_counts=True)
            w.keys[name] = seen[(count > 1) & (seen != NONE)]
            w.tables[name] = np.zeros((len(g.reach), len(w.keys[name]) + 1, k), np.float32)
        w.joint, w.trans, w.first = np.zeros((HASHED, k), np.float32), np.zeros((k, k)), np.zeros(k)
        params = {("joint", 0): w.joint, ("trans", 0): w.trans, ("first", 0): w.first} | {(name, i): t[i] for name, t in w.tables.items() for i in range(len(t))}
        m, v = {x: np.zeros_like(p) for x, p in params.items()}, {x: np.zeros_like(p) for x, p in params.items()}
        ids = [{name: self.known(name, g.units) for name, g in c.groups.items()} for c, _ in parts]
        rng = np.random.default_rng(seed)
        step = 0
        mean = {x: np.zeros_like(p) for x, p in params.items()}
        late = epochs - max(1, epochs // 3)

        def move(name: tuple[str, int], rows: np.ndarray | slice, grad: np.ndarray, lr: float) -> None:
            p = params[name]
            grad = grad + l2 * p[rows]
            m[name][rows] = 0.9 * m[name][rows] + 0.1 * grad
            v[name][rows] = 0.99 * v[name][rows] + 0.01 * grad * grad
            p[rows] -= lr * (m[name][rows] / (1 - 0.9**step)) / (np.sqrt(v[name][rows] / (1 - 0.99**step)) + 1e-6)

        def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Values (n, label) added up by row number: the distinct rows and their sums."""
            here, of = np.unique(rows, return_inverse=True)
            flat = (of.reshape(-1, 1) * k + np.arange(k)).ravel()
            return here, np.bincount(flat, values.ravel(), len(here) * k).reshape(-1, k)

        for epoch in range(epochs):
            lr = rate * (1 - 0.9 * epoch / epochs)
            for b in rng.permutation(len(parts)):
                c, y = parts[b]
                step += 1
                used = {}
                for name, x in ids[b].items():
                    x = x.copy()
                    hide = rng.random(len(x))
                    x[hide < drop, 0] = len(w.keys[name])
                    rows = np.flatnonzero(hide < drop / 2)
                    x[np.ix_(rows, hidden.get(name, ()))] = len(w.keys[name])
                    used[name] = x
                s = np.zeros((len(c.at), k))
                for name, g in c.groups.items():
                    for i, o in enumerate(g.reach):
                        s += w.tables[name][i][used[name]].sum(1)[g.of[c.at + o]]
                for f in range(c.joint.shape[1]):
                    s += w.joint[c.joint[:, f]]
                d, g_trans, g_first = self._gradient(s, y, c.begin)
                d /= len(c.begin) - 1
                for name, g in c.groups.items():
                    for i, o in enumerate(g.reach):
                        unit, gu = summed(g.of[c.at + o], d)
                        f = used[name][unit]
                        rows, gf = summed(f.ravel(), np.repeat(gu, f.shape[1], axis=0))
                        real = rows < len(w.keys[name])
                        move((name, i), rows[real], gf[real], lr)
                rows, gf = summed(c.joint.ravel(), np.repeat(d, c.joint.shape[1], axis=0))
                move(("joint", 0), rows, gf, lr)
                move(("trans", 0), slice(None), g_trans / (len(c.begin) - 1), lr)
                move(("first", 0), slice(None), g_first / (len(c.begin) - 1), lr)
            if epoch >= late:
                for x, p in params.items():
                    mean[x] += p / (epochs - late)
        for x, p in params.items():
            p[:] = mean[x]

    def _gradient(self, s: np.ndarray, y: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected minus true counts: by token and label, of label pairs, of first labels."""
        k = s.shape[1]
        length = np.diff(begin)
        rows = np.flatnonzero(length)
        rows = rows[np.argsort(-length[rows], kind="stable")]
        a, ln = begin[rows], length[rows]
        t = int(ln[0])
        trans, first = np.where(self.never, -1e4, self.w.trans), np.where(self.never_first, -1e4, self.w.first)
        et, es = np.exp(trans), np.exp(s - s.max(1, keepdims=True))
        alpha, beta, scale = np.zeros_like(s), np.ones_like(s), np.ones(len(s))
        x = np.exp(first) * es[a]
        scale[a] = x.sum(1)
        alpha[a] = x / scale[a][:, None]
        live = [int(np.searchsorted(-ln, -j, "left")) for j in range(t)]  # sentences longer than j come first
        for j in range(1, t):
            at = a[: live[j]] + j
            x = (alpha[at - 1] @ et) * es[at]
            scale[at] = x.sum(1)
            alpha[at] = x / scale[at][:, None]
        g_trans = np.zeros((k, k))
        for j in range(t - 1, 0, -1):
            at = a[: live[j]] + j
            x = beta[at] * es[at] / scale[at][:, None]
            beta[at - 1] = x @ et.T
            g_trans += (alpha[at - 1].T @ x) * et
        p = alpha * beta
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        inner = np.ones(len(y), bool)
        inner[a] = False
        after = np.flatnonzero(inner)
        np.add.at(g_trans, (y[after - 1], y[after]), -1)
        return p, g_trans, p[a].sum(0)
