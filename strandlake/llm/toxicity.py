"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as the sum of a hashed word vector and the mean of its hashed character n-gram
vectors.  The network reads a window of ``WINDOW`` words at every word; attention pools its states
into one score a window, and a text's score is the greatest of its windows', so one abusive
passage in a long text counts, wherever it stands.  Gates and attention are straight lines cut at
both ends, which cost a small part of a hyperbolic tangent; only the states' candidates take one.

Training uses a bounded sample (``SAMPLE_EACH`` rows of either label, ``SAMPLE_BYTES`` of text at
most, chosen by a hash of the key) of labelled rows whose crc32(key as text) mod 3 is not 1.
Vectors start from the log odds of documents that hold a word or n-gram; then all weights learn
by gradient descent on the windows that the network itself finds most suspect.

Defined results: null and empty texts get the score of a window without words; rows that repeat
are scored each; null labels and null keys are never learnt from; without rows of both labels the
score is 0; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_ALNUM, map_arrow, slices, strings, table

WINDOW = 32
#: Windows that are scored at once; their states stay in a core's cache, and rows do not share its sets.
BLOCK = 2000
#: Score from which a text counts as toxic.
THRESHOLD = 0.7
#: Parameters: bounds of the training sample.
SAMPLE_EACH = 2000
SAMPLE_BYTES = 16_000_000

DIM, HIDDEN, ATTEND = 12, 8, 8
GRAMS = (3, 4, 5)
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 17
#: Distinct words whose inputs a worker remembers.
REMEMBERED = 100_000
STEPS, BATCH = 240, 64


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(LOWER_ALNUM).split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(29))


def features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its row of word vectors, its n-gram rows one after another, and their counts."""
    parts = [_features(vocabulary[a : a + 20_000]) for a in range(0, len(vocabulary), 20_000)] or [_features([])]
    return tuple(np.concatenate(p) for p in zip(*parts))


def _features(vocabulary: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join([b"<%b>" % w for w in vocabulary]), np.uint8).astype(np.uint64)
    size = np.array([len(w) + 2 for w in vocabulary], np.int64)
    start = np.cumsum(size) - size
    powers = np.cumprod(np.concatenate(([1], np.full(max(int(size.max(initial=1)) - 1, 0), 0x9E3779B97F4A7C15, np.uint64))).astype(np.uint64))
    place = np.arange(len(raw)) - np.repeat(start, size)
    word = np.add.reduceat((raw + np.uint64(1)) * powers[place], start) if len(start) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(vocabulary), dtype=np.int32), size)
    rows, owners = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    for n in GRAMS:
        m = len(raw) - n + 1
        if m <= 0:
            continue
        h = np.full(m, np.uint64(n))
        for k in range(n):
            h = h * np.uint64(0x100000001B3) ^ raw[k : m + k]
        inside = owner[:m] == owner[n - 1 :]
        rows.append((_mix(h[inside]) % np.uint64(GRAM_ROWS)).astype(np.int32))
        owners.append(owner[:m][inside])
    gram, own = np.concatenate(rows), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return (_mix(word) % np.uint64(WORD_ROWS)).astype(np.int32), gram[order], np.bincount(own, minlength=len(vocabulary))


def window_starts(n: int) -> range:
    """Starts of the windows of a text of n words: every word from which a whole window is left."""
    return range(max(1, n - WINDOW + 1))


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _clipped(x, out=None):
    return np.clip(x, -1, 1, out=out)


class Network:
    """The weights; about 8 MB, so it may be broadcast."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        draw = lambda *shape, scale: g.normal(0, scale, shape).astype(np.float32)
        self.word = draw(WORD_ROWS, DIM, scale=0.05)
        self.gram = draw(GRAM_ROWS, DIM, scale=0.05)
        self.p = {}
        for d in "fb":
            self.p["W" + d] = draw(DIM, 3 * HIDDEN, scale=0.4)
            self.p["U" + d] = draw(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p["c" + d] = np.zeros(3 * HIDDEN, np.float32)
        self.p |= {"A": draw(2 * HIDDEN, ATTEND, scale=0.4), "v": draw(ATTEND, scale=0.4), "o": draw(2 * HIDDEN, scale=0.4), "q": np.zeros(1, np.float32)}

    def inputs(self, vocabulary: list[bytes]) -> np.ndarray:
        if not vocabulary:
            return np.empty((0, DIM), np.float32)
        word, gram, count = features(vocabulary)
        ends = np.cumsum(count)
        out = self.word[word]
        for a in range(0, len(vocabulary), 20_000):
            z = min(len(vocabulary), a + 20_000)
            lo = ends[a] - count[a]
            part = self.gram[gram[lo : ends[z - 1]]]
            some = count[a:z] > 0
            at = (ends[a:z] - count[a:z] - lo)[some]
            out[a:z][some] += np.add.reduceat(part, at) / count[a:z][some, None]
        return out

    # -- forward and backward over windows: x is (T, B, 3H) for either direction ----------------

    def _run(self, x: np.ndarray, mask: np.ndarray | None, U: np.ndarray, keep: list | None = None) -> np.ndarray:
        steps, size = x.shape[:2]
        h = np.zeros((size, HIDDEN), np.float32)
        out = np.empty((steps, size, HIDDEN), np.float32)
        for t in range(steps):
            u = h @ U
            zr = (1 + _clipped((x[t, :, : 2 * HIDDEN] + u[:, : 2 * HIDDEN]) / 2)) / 2
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[t, :, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            new = n + z * (h - n)
            if mask is not None:
                new = np.where(mask[t][:, None], new, h)
            if keep is not None:
                keep.append((h, z, r, n, u[:, 2 * HIDDEN :]))
            h = out[t] = new
        return out

    def _pool(self, both: np.ndarray, mask: np.ndarray | None):
        s = _clipped(both @ self.p["A"])
        e = s @ self.p["v"]
        if mask is not None:
            e = np.where(mask, e, -1e9)
        a = np.exp(e - e.max(axis=0))
        if mask is not None:
            a = a * mask
        a /= np.maximum(a.sum(axis=0), 1e-9)
        pooled = (a[:, :, None] * both).sum(axis=0)
        return s, a, pooled, pooled @ self.p["o"] + self.p["q"][0]

    def score(self, projected: np.ndarray, index: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
        """Scores of windows: index is (T, B) rows of the projected inputs."""
        f = self._run(projected[:, : 3 * HIDDEN][index], mask, self.p["Uf"])
        b = self._run(projected[:, 3 * HIDDEN :][index[::-1]], None if mask is None else mask[::-1], self.p["Ub"])[::-1]
        return _sigmoid(self._pool(np.concatenate([f, b], axis=2), mask)[3])

    def scan(self, projected: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Scores of the whole windows at each word of ids; equal to those of ``score`` but for rounding.

        Neighbouring windows read the same columns, so a step of a block of windows is a slice.  A
        gate is (1 + x / 2) / 2, cut to 0 and 1, and the halves are taken into the weights beforehand.  One
        product with a state gives the next gates and the state's part of the attention.
        """
        H, p = HIDDEN, self.p
        out = np.empty(max(0, len(ids) - WINDOW + 1), np.float32)
        half = np.repeat(np.array([0.5, 0.5], np.float32), [2 * H, H])
        size = min(BLOCK, len(out))
        looks = np.empty((WINDOW, (ATTEND + 1) * size), np.float32)
        buffers = [np.empty(k * size, np.float32) for k in (3 * H + ATTEND + 1, H, H)]
        U = [np.concatenate([(p["U" + d] * half).T, p["A"][k * H : k * H + H].T, p["o"][None, k * H : k * H + H]]).astype(np.float32) for k, d in enumerate("fb")]
        for lo in range(0, len(out), BLOCK):
            n = min(BLOCK, len(out) - lo)
            every, h, d = (x[: len(x) // size * n].reshape(-1, n) for x in buffers)
            zr, z, r, new, look = every[: 2 * H], every[:H], every[H : 2 * H], every[2 * H : 3 * H], every[3 * H :]
            seen = looks[:, : (ATTEND + 1) * n].reshape(WINDOW, ATTEND + 1, n)
            inputs = projected[ids[lo : lo + n + WINDOW - 1]].T.astype(np.float32, order="C")
            for k in range(2):
                x = inputs[k * 3 * H : (k + 1) * 3 * H]
                x[: 2 * H] *= 0.5
                at = WINDOW - 1 if k else 0  # the first step starts from nothing: no product, no reset
                _clipped(x[:H, at : at + n], out=z)
                np.tanh(x[2 * H :, at : at + n], out=h)
                z *= -0.5
                z += 0.5
                h *= z
                for t in range(1, WINDOW + 1):
                    np.matmul(U[k], h, out=every)
                    if k:
                        seen[WINDOW - t] += look
                    else:
                        seen[t - 1] = look
                    if t == WINDOW:
                        break
                    at = WINDOW - 1 - t if k else t
                    zr += x[: 2 * H, at : at + n]
                    _clipped(zr, out=zr)
                    r *= new
                    new += r
                    new += x[2 * H :, at : at + n]
                    np.tanh(new, out=new)
                    np.subtract(h, new, out=d)
                    d *= 0.5
                    z *= d
                    d += z
                    np.add(d, new, out=h)
            s = _clipped(seen[:, :ATTEND])
            e = p["v"] @ s
            e -= e.max(axis=0)
            np.exp(e, out=e)
            out[lo : lo + n] = _sigmoid((e * seen[:, ATTEND]).sum(axis=0) / e.sum(axis=0) + p["q"][0])
        return out

    def project(self, x: np.ndarray) -> np.ndarray:
        """What the gates of both directions take from inputs, side by side."""
        return np.concatenate([x @ self.p["W" + d] + self.p["c" + d] for d in "fb"], axis=-1)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray):
        """Loss, gradients of the weights, and gradients of the inputs x (T, B, DIM)."""
        p, H = self.p, HIDDEN
        kept: dict[str, list] = {"f": [], "b": []}
        proj = self.project(x)
        f = self._run(proj[..., : 3 * H], mask, p["Uf"], kept["f"])
        b = self._run(proj[::-1, :, 3 * H :], mask[::-1], p["Ub"], kept["b"])[::-1]
        both = np.concatenate([f, b], axis=2)
        s, a, pooled, logit = self._pool(both, mask)
        prob = _sigmoid(logit)
        loss = float(-np.mean(np.where(y > 0, np.log(prob + 1e-7), np.log(1 - prob + 1e-7))))
        dl = ((prob - y) / len(y)).astype(np.float32)
        g = {"o": pooled.T @ dl, "q": np.array([dl.sum()], np.float32)}
        dpool = dl[:, None] * p["o"]
        dboth = a[:, :, None] * dpool
        da = (both * dpool).sum(axis=2)
        de = a * (da - (a * da).sum(axis=0))
        g["v"] = (s * de[:, :, None]).sum(axis=(0, 1))
        ds = de[:, :, None] * p["v"] * (np.abs(s) < 1)
        g["A"] = np.tensordot(both, ds, ([0, 1], [0, 1]))
        dboth = dboth + ds @ p["A"].T
        dx = np.zeros_like(x)
        for d, grad, m in (("f", dboth[:, :, :H], mask), ("b", dboth[::-1, :, H:], mask[::-1])):
            U, dproj, dU = p["U" + d], np.zeros((*mask.shape, 3 * H), np.float32), np.zeros_like(p["U" + d])
            dh = np.zeros((x.shape[1], H), np.float32)
            for t in range(len(grad) - 1, -1, -1):
                h, z, r, n, un = kept[d][t]
                on = m[t][:, None]
                dnew = (dh + grad[t]) * on
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * ((z > 0) & (z < 1)) / 4
                dr = dn * un * ((r > 0) & (r < 1)) / 4
                gate = np.concatenate([dz, dr, dn * r], axis=1)
                dproj[t, :, : 2 * H], dproj[t, :, 2 * H :] = gate[:, : 2 * H], dn
                dU += h.T @ gate
                dh = dnew * z + gate @ U.T + (dh + grad[t]) * ~on
            g["U" + d] = dU
            if d == "b":
                dproj = dproj[::-1]
            g["W" + d] = np.tensordot(x, dproj, ([0, 1], [0, 1]))
            g["c" + d] = dproj.sum(axis=(0, 1))
            dx += dproj @ p["W" + d].T
        return loss, g, dx


def _pack(starts: list[tuple[int, int]], ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (start, words) as (T, B) word ids and their mask."""
    place = np.arange(WINDOW)[:, None]
    begin, size = np.array([a for a, _ in starts], np.int64), np.array([n for _, n in starts], np.int64)
    mask = place < size
    return np.where(mask, ids[np.minimum(begin + place, max(len(ids) - 1, 0))] if len(ids) else 0, 0), mask


class Scorer:
    """Scores texts with a trained network; remembers the inputs of words it has met."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()
        self.known = np.zeros((0, 6 * HIDDEN), np.float32)

    def _forget(self) -> None:
        self.row, self.used = defaultdict(count().__next__), 0  # numbers words in the order in which they are first asked for

    def _rows(self, tokens: list[bytes]) -> np.ndarray:
        if len(self.row) > REMEMBERED:
            self._forget()
        at = self.used
        ids = np.fromiter(map(self.row.__getitem__, tokens), np.int64, len(tokens))
        if len(self.row) > at:
            self.used = len(self.row)
            if len(self.known) < self.used:
                self.known = np.concatenate([self.known[:at], np.empty((max(self.used, 2 * at) - at, 6 * HIDDEN), np.float32)])
            self.known[at : self.used] = self.net.project(self.net.inputs(list(islice(self.row, at, None))))
        return ids

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """The greatest window score of each text."""
        cut = [words(t) for t in texts]
        ids = self._rows([w for c in cut for w in c])
        if not self.used:
            self._rows([b""])
        out = np.zeros(len(texts))
        size = np.array([len(c) for c in cut], np.int64)
        begin = np.cumsum(size) - size
        whole, short = np.flatnonzero(size >= WINDOW), np.flatnonzero(size < WINDOW)
        every, at = self.net.scan(self.known, ids[np.repeat(size >= WINDOW, size)]), 0
        for i in whole:
            out[i] = every[at : at + size[i] - WINDOW + 1].max()
            at += size[i]
        for a in range(0, len(short), 2048):
            part = short[a : a + 2048]
            out[part] = self.net.score(self.known, *_pack(list(zip(begin[part], size[part])), ids))
        return out


def _presence(docs: list[np.ndarray], labels: np.ndarray, word: np.ndarray, gram: np.ndarray, ends: np.ndarray, count: np.ndarray):
    """Log odds of toxic documents for each row of word and n-gram vectors."""
    out = []
    n = np.maximum([(labels == 0).sum(), (labels == 1).sum()], 1)
    for rows_of, size in ((lambda d: word[d], WORD_ROWS), (lambda d: np.concatenate([gram[ends[i] - count[i] : ends[i]] for i in d] or [word[:0]]), GRAM_ROWS)):
        seen = np.zeros((2, size))
        for d, y in zip(docs, labels):
            seen[y, np.unique(rows_of(d))] += 1
        odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
        enough = (seen.sum(axis=0) / (seen.sum(axis=0) + 2.0)).clip(0, 1)
        out.append((np.clip(odds, -2.5, 4.0) * enough).astype(np.float32))
    return out


def _summed(x: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of x by their group, of which none of the n is empty."""
    order = np.argsort(at, kind="stable")
    return np.add.reduceat(x[order], np.searchsorted(at[order], np.arange(n)))


def train(texts: list[str], labels: list[int], seed: int = 7) -> Network | None:
    """Fits a network; the same rows in the same order give the same weights."""
    y = np.array(labels, np.int64)
    if not (y == 1).any() or not (y == 0).any():
        return None
    net, g = Network(seed), np.random.default_rng(seed)
    vocabulary: dict[bytes, int] = {}
    docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words(t)], np.int64) for t in texts]
    word, gram, count = features(list(vocabulary))
    ends = np.cumsum(count)
    odds = _presence([np.unique(d) for d in docs], y, word, gram, ends, count)
    net.word[:, 0], net.gram[:, 0] = odds[0], odds[1]
    lexical = net.inputs(list(vocabulary))[:, 0]
    ids = np.concatenate([*docs, np.empty(0, np.int64)])
    begin = np.cumsum([0, *map(len, docs)])
    many = [len(window_starts(len(d))) for d in docs]
    window = lambda i, s: (int(begin[i]) + int(s), min(WINDOW, len(docs[i])))
    running = np.concatenate(([0.0], np.cumsum(np.maximum(lexical[ids], 0), dtype=np.float64)))
    worst = []
    for i, d in enumerate(docs):
        a, n = begin[i], min(WINDOW, len(d))
        worst.append(window(i, np.argmax(running[a + n : a + n + many[i]] - running[a : a + many[i]])))
    state = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    speed = {"word": np.full(WORD_ROWS, 1e-6, np.float32), "gram": np.full(GRAM_ROWS, 1e-6, np.float32)}
    toxic, clean, names = np.flatnonzero(y == 1), np.flatnonzero(y == 0), list(vocabulary)
    for step in range(1, STEPS + 1):
        if step == STEPS // 2:  # look for each text's most suspect window again, with what is learnt
            proj = net.project(net.inputs(list(vocabulary)))
            every = net.scan(proj, ids)
            for i, d in enumerate(docs):
                if len(d) > WINDOW:
                    worst[i] = window(i, np.argmax(every[begin[i] : begin[i] + many[i]]))
        pick = np.concatenate([g.choice(toxic, BATCH // 2), g.choice(clean, BATCH // 2)])
        chosen = [worst[i] if y[i] or g.random() < 0.6 else window(i, g.integers(many[i])) for i in pick]
        index, mask = _pack(chosen, ids)
        used, inverse = np.unique(index, return_inverse=True)
        own = [gram[ends[i] - count[i] : ends[i]] for i in used] if len(ids) else []
        x_used = net.inputs([names[i] for i in used]) if names else np.zeros((1, DIM), np.float32)
        _, grads, dx = net.gradients(x_used[inverse.reshape(index.shape)], mask, y[pick].astype(np.float32))
        rate = 0.02 * min(1.0, 2.0 * (1 - step / (STEPS + 1)))
        for k, v in grads.items():
            m, s = state[k]
            m += 0.1 * (v - m)
            s += 0.01 * (v * v - s)
            net.p[k] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        if names:
            dw = _summed((dx * mask[:, :, None]).reshape(-1, DIM), inverse.reshape(-1), len(used))
            rows = np.concatenate([word[used], *own])
            each = np.concatenate([dw, np.repeat(dw / np.maximum(count[used], 1)[:, None], count[used], axis=0)])
            for name, part in (("word", slice(0, len(used))), ("gram", slice(len(used), None))):
                row, at = np.unique(rows[part], return_inverse=True)
                total = _summed(each[part], at, len(row))
                speed[name][row] += (total * total).mean(axis=1)
                getattr(net, name)[row] -= 0.02 * total / np.sqrt(speed[name][row])[:, None]
    return net


def held_out(key: str):
    """True for rows that training never sees; false for a null key, which it does not see either."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str) -> tuple[list[str], list[int]]:
    """The bounded training sample: at most SAMPLE_EACH rows a label and SAMPLE_BYTES of text."""
    marked = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).where(~held_out(key)).groupBy(key).agg(F.max(label).alias("y"))
    ids = [r for v in (0, 1) for r in marked.where(F.col("y") == v).orderBy(F.xxhash64(key), key).limit(SAMPLE_EACH).collect()]
    if not ids:
        return [], []
    few = docs.sparkSession.createDataFrame(ids, marked.schema)
    src = docs.select(docs[key].alias(key), docs[text].alias("text")).join(F.broadcast(few), key)
    size = src.select(key, F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).groupBy(key).agg(F.max("n").alias("n")).collect()
    rank = {r[key]: (r["y"], k) for k, r in enumerate(ids)}
    held, fit = {0: 0, 1: 0}, []
    for r in sorted(size, key=lambda r: rank[r[key]][1]):
        y = rank[r[key]][0]
        if held[y] + r["n"] <= SAMPLE_BYTES // 2:
            held[y] += r["n"]
            fit.append(r[key])
    if not fit:
        return [], []
    few = docs.sparkSession.createDataFrame([(k,) for k in fit], few.select(key).schema)
    rows = docs.select(docs[key].alias(key), docs[text].alias("text")).join(F.broadcast(few), key).groupBy(key).agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).collect()  # the least text of a repeated key
    rows.sort(key=lambda r: rank[r[key]][1])
    return [r["text"] or "" for r in rows], [rank[r[key]][0] for r in rows]


def score_documents(docs: DataFrame, net: Network | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``score`` of each row; rows are scored alone, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for whole in batches:
            for batch in slices(whole, "text", 750_000):
                texts = strings(batch.column(1))
                out = scorer.scores(texts) if scorer else np.zeros(len(texts))
                yield pa.RecordBatch.from_pydict({"key": batch.column(0), "score": pa.array(out.astype(np.float64))})

    return map_arrow(docs.select(docs[key].alias("key"), docs[text].alias("text")), run, f"key {docs.schema[key].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    return train(*sample(docs, labels, key, text, label))


def keep_clean(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below THRESHOLD, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at = docs.schema.names.index(text)

    def run(batches):
        scorer = Scorer(shared.value) if shared.value else None
        for whole in batches:
            for batch in slices(whole, text, 750_000):
                score = scorer.scores(strings(batch.column(at))) if scorer else np.zeros(batch.num_rows)
                yield batch.filter(pa.array(score < THRESHOLD))

    return map_arrow(docs, run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_documents(docs, learn(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
