"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the embedding of its hashed form joined with the mean
embedding of its hashed character 3- and 4-grams. A window of words runs
through a forward and a backward GRU; attention pools the states into one
vector and a logistic unit gives the window's score. Training is Adam on
hand-written gradients; each document teaches through its highest window, and a
clean one also through a window that repeats one of its words.
"""

from __future__ import annotations

import numpy as np

from .words import hash_words, mix, word_bounds

WINDOW, STRIDE = 24, 12        # words per window; windows overlap by half
HIDDEN = 10
EMBED = 12
BUCKETS = 1 << 15
DECISION = 0.3                 # the score from which a text counts as label 1
CALIBRATE, LEAST_APART = 5, 40 # one training text of so many, of classes of at least so many, only places the decision point
CLEAN_COST = 4.0               # a clean text called toxic, against a missed one
_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
_A = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """The distinct words of a slice of texts, with their features."""

    def __init__(self, buf: bytes, offs: np.ndarray):
        doc, starts, ends = word_bounds(buf, offs)
        raw = np.frombuffer(buf, dtype=np.uint8)
        if starts.size:
            for _ in range(4):  # punctuation at the borders is not part of the word
                cut = _PUNCT[raw[ends - 1]] & (ends - starts > 1)
                ends = ends - cut
                cut = _PUNCT[raw[starts]] & (ends - starts > 1)
                starts = starts + cut
        self.first = np.searchsorted(doc, np.arange(offs.size))
        h = hash_words(buf, starts, ends)
        u, pick, self.index = np.unique(h, return_index=True, return_inverse=True)
        self.bucket = (u % np.uint64(BUCKETS)).astype(np.int64)
        size = ends[pick] - starts[pick]
        if not size.size:
            self.grams, self.gram_at = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            self.gram_n = np.zeros(0, dtype=np.int64)
            return
        wide = size + 2
        head = np.cumsum(wide) - wide
        flat = np.ones(int(wide.sum()) + 1, dtype=np.uint64)     # byte 1 marks the borders of a word
        pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        flat[np.repeat(head + 1, size) + pos] = raw[np.repeat(starts[pick], size) + pos]
        three = flat[:-2] + (flat[1:-1] << np.uint64(8))
        three[:-1] += flat[2:-1] << np.uint64(16)
        four = three[:-1] + (flat[3:] << np.uint64(24)) if flat.size > 3 else three[:0]
        # word of size n: n 3-grams and n - 1 4-grams
        count = 2 * size - 1
        at = np.repeat(np.cumsum(count) - count, count)
        k = np.arange(int(count.sum())) - at
        n = np.repeat(size, count)
        src = np.repeat(head, count)
        is4 = k >= n
        key = np.where(is4, four[np.minimum(src + k - n, four.size - 1)] if four.size else 0, three[src + np.minimum(k, n - 1)])
        self.grams = (mix(key * _A + is4.astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)
        self.gram_at = np.cumsum(count) - count
        self.gram_n = count


def windows(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of every window of documents whose words
    begin at ``first``; the last window of a document ends with it."""
    n = np.diff(first)
    count = np.where(n > WINDOW, -(-(n - WINDOW) // STRIDE) + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(n.size), count)
    k = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    start = first[doc] + k * STRIDE
    return doc, start, np.minimum(WINDOW, first[doc + 1] - start)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-x))


class BiGru:
    """Parameters and passes; arrays are float32."""

    def __init__(self, seed: int = 7, params: dict | None = None):
        if params is not None:
            self.p = params
            return
        rng = np.random.default_rng(seed)

        def normal(scale, *shape):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        self.p = {"word": normal(0.05, BUCKETS, EMBED), "gram": normal(0.05, BUCKETS, EMBED)}
        for d in "fb":
            self.p |= {f"W{d}": normal(0.2, 2 * EMBED, 3 * HIDDEN), f"U{d}": normal(0.2, HIDDEN, 3 * HIDDEN),
                       f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.p |= {"A": normal(0.2, 2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32),
                   "v": normal(0.2, HIDDEN), "o": normal(0.2, 2 * HIDDEN), "bias": np.zeros(1, np.float32)}

    def inputs(self, w: Words) -> np.ndarray:
        """One row per distinct word, and a zero row for padding."""
        out = np.zeros((w.bucket.size + 1, 2 * EMBED), dtype=np.float32)
        if w.bucket.size:
            out[:-1, :EMBED] = self.p["word"][w.bucket]
            out[:-1, EMBED:] = np.add.reduceat(self.p["gram"][w.grams], w.gram_at, axis=0) / w.gram_n[:, None]
        return out

    def _run(self, gates: np.ndarray, at: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """One direction over time-major word rows ``at``; the states per step."""
        u = self.p[f"U{d}"]
        steps, n = at.shape
        h = np.zeros((n, HIDDEN), dtype=np.float32)
        states = np.empty((steps, n, HIDDEN), dtype=np.float32)
        cache = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            x, g = gates[at[t]], h @ u
            zr = _sigmoid(x[:, :2 * HIDDEN] + g[:, :2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            gn = g[:, 2 * HIDDEN:]
            c = np.tanh(x[:, 2 * HIDDEN:] + r * gn)
            m = mask[t][:, None]
            new = h + m * (1 - z) * (c - h)
            if keep:
                cache.append((t, h, z, r, gn, c, m))
            h = new
            states[t] = h
        return states, cache

    def forward(self, table: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logit of every window (columns of ``at``)."""
        p = self.p
        sf, cf = self._run(table @ p["Wf"] + p["cf"], at, mask, "f", keep)
        sb, cb = self._run(table @ p["Wb"] + p["cb"], at, mask, "b", keep)
        s = np.concatenate((sf, sb), axis=2)
        q = np.tanh(s @ p["A"] + p["a"])
        e = q @ p["v"] + (mask - 1) * np.float32(1e4)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[:, :, None] * s).sum(axis=0)
        logit = pooled @ p["o"] + p["bias"][0]
        return logit, (s, q, alpha, pooled, cf, cb) if keep else None

    def backward(self, table, at, mask, held, dlogit) -> dict:
        """Gradients of all parameters but the embeddings, and of ``table``."""
        p = self.p
        s, q, alpha, pooled, cf, cb = held
        g = {"o": pooled.T @ dlogit, "bias": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["o"]
        dalpha = (s * dpool).sum(axis=2)
        de = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
        g["v"] = np.tensordot(de, q, axes=([0, 1], [0, 1]))
        dq = de[:, :, None] * p["v"] * (1 - q * q)
        g["A"] = np.tensordot(s, dq, axes=([0, 1], [0, 1]))
        g["a"] = dq.sum(axis=(0, 1))
        ds = alpha[:, :, None] * dpool + dq @ p["A"].T
        dtable = np.zeros_like(table)
        for d, cache, part in (("f", cf, ds[:, :, :HIDDEN]), ("b", cb, ds[:, :, HIDDEN:])):
            u, w = p[f"U{d}"], p[f"W{d}"]
            dgates = np.zeros((table.shape[0], 3 * HIDDEN), np.float32)
            du = np.zeros_like(u)
            dh = np.zeros((at.shape[1], HIDDEN), np.float32)
            for t, h, z, r, gn, c, m in reversed(cache):
                dh = dh + part[t]
                dn = dh * m
                dz = dn * (h - c) * z * (1 - z)
                dc = dn * (1 - z) * (1 - c * c)
                dr = dc * gn * r * (1 - r)
                dg = np.concatenate((dz, dr, dc * r), axis=1)
                du += h.T @ dg
                np.add.at(dgates, at[t], np.concatenate((dz, dr, dc), axis=1))
                dh = dh * (1 - m) + dn * z + dg @ u.T
            g[f"U{d}"] = du
            g[f"W{d}"] = table.T @ dgates
            g[f"c{d}"] = dgates.sum(axis=0)
            dtable += dgates @ w.T
        dtable[-1] = 0
        g["table"] = dtable
        return g


def gather(w: Words, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-major word rows and mask of windows."""
    t = np.arange(WINDOW)[:, None]
    mask = t < size
    at = np.where(mask, w.index[np.minimum(start + t, max(w.index.size - 1, 0))] if w.index.size else 0, w.bucket.size)
    return at, mask.astype(np.float32)


def score_windows(net: BiGru, w: Words, start: np.ndarray, size: np.ndarray, block: int = 4096) -> np.ndarray:
    """Logits of windows, in blocks of bounded size."""
    table = net.inputs(w)
    out = np.empty(start.size, dtype=np.float32)
    for i in range(0, start.size, block):
        at, mask = gather(w, start[i: i + block], size[i: i + block])
        out[i: i + block] = net.forward(table, at, mask)[0]
    return out


def top_window(logit: np.ndarray, doc: np.ndarray, n_docs: int) -> np.ndarray:
    """Place of each document's highest window, -1 for a document without one."""
    order = np.lexsort((-logit, doc))
    begin = np.flatnonzero(np.append(True, doc[order][1:] != doc[order][:-1])) if order.size else []
    out = np.full(n_docs, -1, dtype=np.int64)
    out[doc[order][begin]] = order[begin]
    return out


class Adam:
    def __init__(self, rate: float):
        self.rate, self.t = rate, 0
        self.m: dict = {}

    def step(self, p: dict, g: dict) -> None:
        self.t += 1
        fix = np.sqrt(1 - 0.999 ** self.t) / (1 - 0.9 ** self.t)
        for k, x in g.items():
            m, v = self.m.setdefault(k, (np.zeros_like(p[k]), np.zeros_like(p[k])))
            m *= 0.9
            m += 0.1 * x
            v *= 0.999
            v += 0.001 * x * x
            p[k] -= (self.rate * fix * m / (np.sqrt(v) + 1e-7)).astype(np.float32)

    def step_rows(self, p: dict, k: str, rows: np.ndarray, x: np.ndarray) -> None:
        """The same for the touched rows of an embedding only (AdaGrad scale)."""
        v = self.m.setdefault(k, np.full(p[k].shape[0], 1e-8, np.float32))
        v[rows] += (x * x).mean(axis=1)
        p[k][rows] -= self.rate * x / np.sqrt(v[rows])[:, None]


def _odds(w: Words, label: np.ndarray, doc_of: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed log-odds of word and gram buckets, by documents that hold them and are not ``apart``."""
    out = []
    taught = ~apart[doc_of]
    held = np.unique(doc_of[taught] * max(w.bucket.size, 1) + w.index[taught])           # a document's distinct words
    owner, word = np.divmod(held, max(w.bucket.size, 1))
    rep = w.gram_n[word]                                                 # every document that holds a word holds its grams
    at = np.repeat(w.gram_at[word] - (np.cumsum(rep) - rep), rep) + np.arange(int(rep.sum()))
    for buckets, holder in ((w.bucket[word], owner), (w.grams[at], np.repeat(owner, rep))):
        pair = np.unique(holder * BUCKETS + buckets)
        lab, b = label[pair // BUCKETS], pair % BUCKETS
        pos = np.bincount(b, weights=lab, minlength=BUCKETS)
        neg = np.bincount(b, weights=1 - lab, minlength=BUCKETS)
        np_, nn = max(label[~apart].sum(), 1), max((1 - label[~apart]).sum(), 1)
        out.append(np.clip(np.log((pos + 0.5) / np_) - np.log((neg + 0.5) / nn), -3, 3) * ((pos + neg) >= 3))
    return out[0], out[1]


def train(texts: list[str], label: np.ndarray, steps: int = 240, batch: int = 96, rate: float = 0.01,
          seed: int = 7) -> BiGru:
    """Fit on whole texts with one 0/1 label each; deterministic for a seed.

    About ``steps`` batches are run whatever the number of texts, in 4 to 48
    passes; the rarer class is repeated until it makes up a third of a pass."""
    import pyarrow as pa

    from .words import text_slices

    net = BiGru(seed)
    label = np.asarray(label, dtype=np.float32)
    if not len(texts) or label.min() == label.max():
        net.p["bias"][0] = -4.0 if not len(texts) or label[0] == 0 else 4.0
        net.p["o"][:] = 0
        return net
    _, buf, offs = next(iter(text_slices(pa.array(texts, pa.large_string()), 1 << 40)))
    w = Words(buf, offs)
    doc, start, size = windows(w.first)
    word_doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
    # one text of CALIBRATE of each class is not learned from: it only helps to place the decision point
    apart = np.zeros(label.size, dtype=bool)
    for k in (0, 1):
        own = np.flatnonzero(label == k)
        apart[own[CALIBRATE - 1::CALIBRATE] if own.size >= LEAST_APART else own[:0]] = True
    word_odds, gram_odds = _odds(w, label, word_doc, apart)
    net.p["word"][:, 0] = word_odds * 0.5
    net.p["gram"][:, 0] = gram_odds * 0.5
    # first choice of windows: the one with the highest word evidence
    gram_mean = np.add.reduceat(gram_odds[w.grams], w.gram_at) / w.gram_n
    strength = (word_odds[w.bucket] + gram_mean)[w.index]
    at, mask = gather(w, start, size)
    pad = np.append(strength, -9)
    logit = pad[np.where(mask > 0, np.minimum(start + np.arange(WINDOW)[:, None], strength.size), strength.size)].max(axis=0)
    rng = np.random.default_rng(seed)
    adam = Adam(rate)
    taught = np.flatnonzero(~apart)
    rare = taught[label[taught] == (label.mean() < 0.5)]
    often = max(0, int((taught.size - rare.size) / (2 * rare.size)) - 1)
    every = np.concatenate((taught, np.tile(rare, often)))
    for epoch in range(int(np.clip(-(-steps * batch // every.size), 4, 48))):
        if epoch:
            logit = score_windows(net, w, start, size)
        top = top_window(logit, doc, len(texts))
        order = rng.permutation(every[top[every] >= 0])
        for i in range(0, order.size, batch):
            docs = order[i: i + batch]
            pick = top[docs]
            at, mask = gather(w, start[pick], size[pick])
            # a clean document also teaches that one word repeated is clean
            clean = docs[label[docs] == 0]
            word = w.first[clean] + (rng.random(clean.size) * np.diff(w.first)[clean]).astype(np.int64)
            at = np.concatenate((at, np.repeat(w.index[word][None, :], WINDOW, axis=0)), axis=1)
            mask = np.concatenate((mask, np.ones((WINDOW, clean.size), np.float32)), axis=1)
            _step(net, adam, w, at, mask, np.append(label[docs], np.zeros(clean.size, np.float32)))
    logit = score_windows(net, w, start, size)
    best = np.full(len(texts), -np.inf)
    np.maximum.at(best, doc, logit)
    judged = (apart if apart.any() and len(set(label[apart])) == 2 else ~apart) & (best > -np.inf)
    net.p["bias"][0] += np.log(DECISION / (1 - DECISION)) - decision_point(best[judged & (label == 0)], best[judged & (label == 1)])
    return net


def decision_point(clean: np.ndarray, toxic: np.ndarray) -> float:
    """The score with the least cost (a clean text called toxic costs CLEAN_COST times a missed one, as shares
    of their classes), in the middle of the stretch of equal cost; 0 without scores of both classes."""
    if not clean.size or not toxic.size:
        return 0.0
    at = np.unique(np.concatenate((clean, toxic)))
    cuts = np.concatenate(([at[0] - 1], (at[1:] + at[:-1]) / 2, [at[-1] + 1]))
    cost = CLEAN_COST * (clean.size - np.searchsorted(np.sort(clean), cuts)) / clean.size + np.searchsorted(np.sort(toxic), cuts) / toxic.size
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    run = best[: 1 + int(np.argmax(np.append(np.diff(best) > 1, True)))]       # the first stretch
    low = at[run[0] - 1] if run[0] else at[0] - 1
    high = at[run[-1]] if run[-1] < at.size else at[-1] + 1
    return float((low + high) / 2)


def _step(net: BiGru, adam: Adam, w: Words, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> None:
    used, local = np.unique(at, return_inverse=True)
    local = local.reshape(at.shape)
    pad = w.bucket.size
    if used[-1] != pad:
        used = np.append(used, pad)
    sub = used[:-1]
    rep = w.gram_n[sub]
    begin = np.cumsum(rep) - rep
    flat = w.grams[np.repeat(w.gram_at[sub], rep) + np.arange(int(rep.sum())) - np.repeat(begin, rep)]
    table = np.zeros((used.size, 2 * EMBED), np.float32)
    table[:-1, :EMBED] = net.p["word"][w.bucket[sub]]
    table[:-1, EMBED:] = np.add.reduceat(net.p["gram"][flat], begin, axis=0) / rep[:, None]
    logit, held = net.forward(table, local, mask, keep=True)
    dlogit = ((_sigmoid(logit) - y) / y.size).astype(np.float32)
    g = net.backward(table, local, mask, held, dlogit)
    dt = g.pop("table")[:-1]
    adam.step(net.p, g)
    for k, rows, x in (("word", w.bucket[sub], dt[:, :EMBED]),
                       ("gram", flat, np.repeat(dt[:, EMBED:] / rep[:, None], rep, axis=0))):
        u, inv = np.unique(rows, return_inverse=True)
        total = np.zeros((u.size, EMBED), np.float32)
        np.add.at(total, inv, x)
        adam.step_rows(net.p, k, u, total)
