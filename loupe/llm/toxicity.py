"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text is lower-cased and split into words.  A word's input is its own vector (words of the training
sample; others share one) beside the mean vector of its hashed character trigrams.  Windows of
WINDOW words at a stride of STRIDE run through a forward and a backward GRU; attention weighs the
states of both into one vector, and a linear layer gives the window's logit.  A text's score comes
from its highest window by a logistic calibration, so one toxic passage marks a long text.

The network is fitted on the driver on a bounded sample of labelled rows (FIT_TOXIC and FIT_CLEAN
rows of whole texts, chosen by hash).  Labels are of whole texts, so a first round takes all
sampled windows at their text's label, and a second one the highest windows of each text.  Scoring
covers every window of every whole text; workers remember the input projection of words seen.
"""

from __future__ import annotations

import hashlib
import pickle
import string
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loupe.llm.common import small_batches, word_count, worker_store

#: Bounds of the training sample: toxic and clean rows, words of a row (longer texts are not sampled; those
#: that are, are taught whole), and windows that a row lends to round one, drawn over the whole text.
FIT_TOXIC, FIT_CLEAN = 1500, 3000
FIT_LONGEST = 1 << 16
FIT_WINDOWS = 8
#: Gradient steps of each round at least, for small samples.
LEAST_STEPS = (80, 150)
WINDOW, STRIDE = 32, 24
HIDDEN, WORD_DIM, CHAR_DIM, TRIGRAMS = 8, 16, 16, 4096
#: Words with a vector of their own: in so many sampled texts at least, the most frequent so many.
WORD_LEAST, WORDS_MOST = 3, 20_000
THRESHOLD = 0.3
HELD_OUT = 2
#: Windows scored at a time, and words whose projection a worker remembers.
AT_ONCE, MEMO_MOST = 2048, 1 << 19


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


#: Marks that are cut off a word's ends.
MARKS = string.punctuation + "\u00a1\u00ab\u00bb\u00bf\u2013\u2014\u2018\u2019\u201c\u201d\u2026"


def bare(word: str) -> str:
    """A word without the marks around it; a word of marks only stays as it is."""
    return word.strip(MARKS) or word


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of bytes of <word>, for all words in one array, and how many each word has."""
    data = [f"<{w}>".encode() for w in words]
    sizes = np.array([len(x) for x in data])
    codes = np.frombuffer(b"".join([*data, b"  "]), np.uint8).astype(np.uint32)
    hashed = (codes[:-2] * 0x9E3779B1 + codes[1:-1] * 0x85EBCA77 + codes[2:] * 0xC2B2AE3D).astype(np.uint32)
    hashed = (hashed ^ hashed >> 15) % TRIGRAMS
    n = np.maximum(sizes - 2, 1)
    first = np.cumsum(sizes) - sizes
    return hashed[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())].astype(np.int64), n


def sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


@dataclass
class Network:
    vocabulary: dict[str, int]
    seed: int = 7
    dtype: type = np.float32
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self):
        rng = np.random.default_rng(self.seed)
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        scale = {"words": ((len(self.vocabulary) + 1, WORD_DIM), 0.1), "chars": ((TRIGRAMS, CHAR_DIM), 0.1), "w": ((2, d, 3 * h), d**-0.5),
                 "b": ((2, 3 * h), 0.0), "u": ((2, h, 3 * h), h**-0.5), "attend": ((2 * h,), 0.3), "out": ((2 * h,), 0.3), "bias": ((1,), 0.0)}
        self.p = self.p or {k: (rng.standard_normal(s) * f).astype(self.dtype) for k, (s, f) in scale.items()}

    def inputs(self, words: list[str]):
        """(word ids, trigram ids, first trigram of each word, trigrams of each word)."""
        grams, n = trigrams(words)
        return np.array([self.vocabulary.get(w, 0) for w in words]), grams, np.cumsum(n) - n, n

    def project(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Gate inputs of each word for both directions: (words, 2, 3 * HIDDEN)."""
        ids, grams, first, n = self.inputs(words)
        chars = np.add.reduceat(self.p["chars"][grams], first, axis=0) / n[:, None].astype(self.dtype)
        x = np.concatenate([self.p["words"][ids], chars], axis=1)
        return np.einsum("nd,kdg->nkg", x, self.p["w"], optimize=True) + self.p["b"], (x, ids, grams, first, n)

    def logits(self, table: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Logits of full windows, as run() has them, with buffers used over again.  Both directions'
        gates are computed transposed (gates by windows), so each gate is one block of memory."""
        (b, t), h = index.shape, HIDDEN
        u = np.ascontiguousarray(self.p["u"].transpose(0, 2, 1))
        u[:, :2 * h] *= 0.5  # sigmoid(x) = 0.5 + 0.5 tanh(x / 2)
        state, states = np.zeros((2, h, b), np.float32), np.empty((2, t, h, b), np.float32)
        a, g, zr, n = (np.empty((2, k * h, b), np.float32) for k in (3, 3, 2, 1))
        columns = np.ascontiguousarray(index.T)
        for s in range(t):
            g[0] = table[columns[s], 0].T
            g[1] = table[columns[t - 1 - s], 1].T
            np.matmul(u, state, out=a)
            g[:, :2 * h] *= 0.5
            np.add(g[:, :2 * h], a[:, :2 * h], out=zr)
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            np.multiply(zr[:, h:], a[:, 2 * h:], out=n)
            n += g[:, 2 * h:]
            np.tanh(n, out=n)
            state -= n
            state *= zr[:, :h]
            state += n
            states[0, s], states[1, t - 1 - s] = state
        att, out = self.p["attend"], self.p["out"]
        e = att[:h] @ states[0] + att[h:] @ states[1]
        e -= e.max(axis=0)
        np.exp(e, out=e)
        e /= e.sum(axis=0)
        values = out[:h] @ states[0] + out[h:] @ states[1]
        return (e * values).sum(axis=0) + self.p["bias"]

    def run(self, table: np.ndarray, index: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows: ``index`` (windows, steps) into ``table``, ``mask`` 0 where a step is void."""
        b, t, h = len(index), index.shape[1], HIDDEN
        u, state = self.p["u"], np.zeros((2, b, h), self.dtype)
        states, trace = np.empty((2, t, b, h), self.dtype), []
        for s in range(t):
            g = np.stack([table[index[:, s], 0], table[index[:, t - 1 - s], 1]])
            a = np.matmul(state, u)
            zr = sigmoid(g[..., :2 * h] + a[..., :2 * h])
            z, r = zr[..., :h], zr[..., h:]
            n = np.tanh(g[..., 2 * h:] + r * a[..., 2 * h:])
            new = n + z * (state - n)
            if keep:
                trace.append((state, a, z, r, n))
            if mask is not None:
                m = np.stack([mask[:, s], mask[:, t - 1 - s]])[..., None]
                new = state + m * (new - state)
            state = new
            states[0, s], states[1, t - 1 - s] = state
        att = self.p["attend"]
        e = states[0] @ att[:h] + states[1] @ att[h:]  # (steps, windows)
        if mask is not None:
            e = np.where(mask.T > 0, e, -30.0).astype(self.dtype)
        alpha = np.exp(e - e.max(axis=0)) if t else e
        alpha /= alpha.sum(axis=0)
        if mask is not None:
            alpha = alpha * mask.T
        pooled = np.concatenate([np.einsum("tb,tbh->bh", alpha, states[k], optimize=True) for k in (0, 1)], axis=1)
        logits = pooled @ self.p["out"] + self.p["bias"]
        return (logits, (states, alpha, pooled, trace)) if keep else logits

    def gradients(self, words: list[str], index: np.ndarray, mask: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        """Weighted mean log loss of windows and its gradients."""
        h, t = HIDDEN, index.shape[1]
        table, (x, ids, grams, first, n_grams) = self.project(words)
        logits, (states, alpha, pooled, trace) = self.run(table, index, mask, keep=True)
        share = (weights / weights.sum()).astype(self.dtype)
        loss = float((share * (np.logaddexp(0, logits) - labels * logits)).sum())
        d = (share * (sigmoid(logits) - labels)).astype(self.dtype)
        g = {"out": d @ pooled, "bias": d.sum(keepdims=True)}
        d_pooled = d[:, None] * self.p["out"]
        both = np.concatenate([states[0], states[1]], axis=2)  # (steps, windows, 2h)
        d_alpha = np.einsum("bh,tbh->tb", d_pooled, both)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        g["attend"] = np.einsum("tb,tbh->h", d_e, both)
        d_both = alpha[..., None] * d_pooled + d_e[..., None] * self.p["attend"]
        u, g["u"] = self.p["u"], np.zeros_like(self.p["u"])
        d_gates = np.empty((2, t, len(index), 3 * h), self.dtype)
        d_state = np.zeros((2, len(index), h), self.dtype)
        for s in range(t - 1, -1, -1):
            before, a, z, r, n = trace[s]
            d_state = d_state + np.stack([d_both[s, :, :h], d_both[t - 1 - s, :, h:]])
            m = np.stack([mask[:, s], mask[:, t - 1 - s]])[..., None]
            d_new = m * d_state
            d_n = d_new * (1 - z) * (1 - n * n)
            d_z = d_new * (before - n) * z * (1 - z)
            d_r = d_n * a[..., 2 * h:] * r * (1 - r)
            d_a = np.concatenate([d_z, d_r, d_n * r], axis=2)
            gates = np.concatenate([d_z, d_r, d_n], axis=2)
            d_gates[0, s], d_gates[1, t - 1 - s] = gates
            g["u"] += np.matmul(before.transpose(0, 2, 1), d_a)
            d_state = (1 - m) * d_state + d_new * z + np.matmul(d_a, u.transpose(0, 2, 1))
        # back to the words: gate gradients of equal words are summed
        flat = d_gates.transpose(2, 1, 0, 3).reshape(-1, 2, 3 * h)
        order = np.argsort(index.ravel(), kind="stable")
        used, starts = np.unique(index.ravel()[order], return_index=True)
        d_table = np.zeros_like(table)
        d_table[used] = np.add.reduceat(flat[order], starts, axis=0)
        g["b"] = d_table.sum(axis=0)
        g["w"] = np.einsum("nd,nkg->kdg", x, d_table, optimize=True)
        d_x = np.einsum("nkg,kdg->nd", d_table, self.p["w"], optimize=True)
        g["words"], g["chars"] = np.zeros_like(self.p["words"]), np.zeros_like(self.p["chars"])
        np.add.at(g["words"], ids, d_x[:, :WORD_DIM])
        np.add.at(g["chars"], grams, np.repeat(d_x[:, WORD_DIM:] / n_grams[:, None], n_grams, axis=0).astype(self.dtype))
        return loss, g


def window_starts(n_words: int) -> np.ndarray:
    """Starts of the overlapping windows that cover a text; one for a text without words."""
    return np.arange(0, max(n_words - WINDOW, 0) + STRIDE, STRIDE)


@dataclass
class Model:
    """A fitted network, the calibration (weight of the highest logit, and a constant)."""

    network: Network | None
    calibration: tuple[float, float]

    def window_logits(self, group: list[list[str]], memo: dict) -> tuple[np.ndarray, np.ndarray]:
        """(logits of all windows of the texts' words, number of windows of each text)."""
        net = self.network
        if not memo:
            memo |= {"place": {}, "table": np.zeros((1024, 2, 3 * HIDDEN), np.float32)}
        place = memo["place"]
        if len(place) > MEMO_MOST:
            place.clear()
        fresh = list({w for words in group for w in words if w not in place})
        for k in range(0, len(fresh), 20_000):
            some = fresh[k:k + 20_000]
            rows, _ = net.project([bare(w) for w in some])
            first = len(place)
            if first + len(some) > len(memo["table"]):
                grown = np.zeros((2 * (first + len(some)), 2, 3 * HIDDEN), np.float32)
                grown[:first] = memo["table"][:first]
                memo["table"] = grown
            memo["table"][first:first + len(some)] = rows
            place.update(zip(some, range(first, first + len(some))))
        look = place.__getitem__
        flat = np.array([i for words in group for i in map(look, words)] or [0], np.int64)
        sizes = np.array([len(words) for words in group])
        offsets = np.cumsum(sizes) - sizes
        starts = [window_starts(n) for n in sizes]
        n = np.array([len(s) for s in starts])
        owner, start = np.repeat(np.arange(len(group)), n), np.concatenate(starts)
        left = np.minimum(sizes[owner] - start, WINDOW)
        logits, steps = np.empty(len(start)), np.arange(WINDOW)
        for some in (np.flatnonzero(left == WINDOW), np.flatnonzero(left < WINDOW)):
            for k in range(0, len(some), AT_ONCE):
                pick = some[k:k + AT_ONCE]
                index = (offsets[owner[pick]] + start[pick])[:, None] + steps
                if left[pick[0]] == WINDOW:
                    logits[pick] = net.logits(memo["table"], flat[index])
                else:
                    mask = (steps < left[pick][:, None]).astype(np.float32)
                    logits[pick] = net.run(memo["table"], flat[np.minimum(index, len(flat) - 1)], mask)
        return logits, n

    def highest(self, texts: list[str | None], memo: dict) -> np.ndarray:
        """The highest logit of each text, over all windows of the whole text; as many texts at a time as
        make up a few rounds of windows."""
        best, group, held = [], [], 0
        for k, text in enumerate(texts):
            group.append(words_of(text))
            held += len(group[-1])
            if held >= 16 * AT_ONCE * STRIDE or k == len(texts) - 1:
                logits, n = self.window_logits(group, memo)
                best.append(np.maximum.reduceat(logits, np.cumsum(n) - n))
                group, held = [], 0
        return np.concatenate(best or [np.empty(0)])

    def score(self, texts: list[str | None], memo: dict | None = None) -> np.ndarray:
        a, c = self.calibration
        if self.network is None:
            return np.full(len(texts), sigmoid(c))
        return np.clip(sigmoid(a * self.highest(texts, {} if memo is None else memo) + c), 0.0, 1.0)


# ---------------------------------------------------------------- training

def _calibrate(best: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on the highest logit of whole texts, by Newton steps with a small ridge,
    each halved until the loss falls (whole steps can swing for ever where the classes lie far apart); the
    score does not fall with the logit, and a text's length plays no other part."""
    x = np.stack([best, np.ones_like(best)], axis=1).astype(float)
    beta, ridge = np.zeros(2), np.array([0.1, 0.01])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((weights * (np.logaddexp(0, z) - labels * z)).sum() + (ridge * beta * beta).sum() / 2)

    now = loss(beta)
    for _ in range(100):
        q = sigmoid(x @ beta)
        grad = x.T @ (weights * (q - labels)) + ridge * beta
        hess = (x * (weights * q * (1 - q))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        while (new := loss(beta - step)) > now and np.abs(step).max() > 1e-12:
            step = step / 2
        if new > now or np.abs(step).max() <= 1e-12:
            break
        beta, now = beta - step, new
    return max(float(beta[0]), 0.0), float(beta[1])


def train(texts: list[list[str]], labels: list[int], toxic_share: float, seed: int = 7, rounds: tuple[int, int] = (2, 5)) -> Model:
    """Fit on the words of sampled texts.  Four fifths train the network, the rest calibrate it to
    ``toxic_share``, the share of toxic rows among all labelled ones."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        share = min(max(toxic_share, 1e-3), 1 - 1e-3)
        return Model(None, (0.0, float(np.log(share / (1 - share)))))
    rng = np.random.default_rng(seed)
    fit = np.ones(len(y), bool)
    for kind in (0, 1):
        mine = rng.permutation(np.flatnonzero(y == kind))
        fit[mine[:len(mine) // 5]] = False
    bare_texts = [[bare(w) for w in words] for words in texts]
    held: dict[str, int] = {}
    for i in np.flatnonzero(fit):
        for w in set(bare_texts[i]):
            held[w] = held.get(w, 0) + 1
    frequent = sorted((w for w, n in held.items() if n >= WORD_LEAST), key=lambda w: (-held[w], w))[:WORDS_MOST]
    net = Network({w: i + 1 for i, w in enumerate(frequent)}, seed)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0

    def epoch(windows: list[tuple[int, int]], target: np.ndarray, rate: float) -> None:
        """One pass over windows (text, start); both classes weigh the same."""
        nonlocal step
        weight = np.where(target == 1, len(target) / max(1, target.sum()), len(target) / max(1, (1 - target).sum())) / 2
        order = rng.permutation(len(windows))
        for k in range(0, len(order), 256):
            part = order[k:k + 256]
            cut = [bare_texts[windows[i][0]][windows[i][1]:windows[i][1] + WINDOW] for i in part]
            distinct = {w: j for j, w in enumerate(dict.fromkeys(w for c in cut for w in c))} or {"": 0}
            index, mask = np.zeros((len(part), WINDOW), np.int64), np.zeros((len(part), WINDOW), np.float32)
            for r, c in enumerate(cut):
                index[r, :len(c)] = [distinct[w] for w in c]
                mask[r, :len(c)] = 1
            _, g = net.gradients(list(distinct), index, mask, target[part], weight[part])
            step += 1
            norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
            for name, value in g.items():
                value = value * min(1.0, 5.0 / (norm + 1e-9))
                m, v = moments[name]
                m += 0.1 * (value - m)
                v += 0.001 * (value * value - v)
                net.p[name] -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    all_windows = {i: window_starts(len(bare_texts[i])) for i in np.flatnonzero(fit)}
    done, began = 0, step
    while done < rounds[0] or step - began < LEAST_STEPS[0]:
        done += 1
        windows = [(i, int(s)) for i, starts in all_windows.items() for s in rng.permutation(starts)[:FIT_WINDOWS]]
        epoch(windows, np.array([y[i] for i, _ in windows], np.float32), 0.01)
    done, began = 0, step
    while done < rounds[1] or step - began < LEAST_STEPS[1]:
        done += 1
        # the highest windows of each text stand for it, and a few others of clean texts
        windows = []
        logits, n = Model(net, (1.0, 0.0)).window_logits([bare_texts[i] for i in all_windows], {})
        for (i, starts), own in zip(all_windows.items(), np.split(logits, np.cumsum(n)[:-1])):
            top = starts[np.argsort(-own, kind="stable")[:3 if y[i] == 0 else 1]]
            windows += [(i, int(s)) for s in top]
            if y[i] == 0:
                windows += [(i, int(s)) for s in rng.permutation(starts)[:2]]
        epoch(windows, np.array([y[i] for i, _ in windows], np.float32), 0.005)
    rest = np.flatnonzero(~fit) if len(set(y[~fit])) == 2 else np.arange(len(y))
    best = Model(net, (1.0, 0.0)).highest([" ".join(texts[i]) for i in rest], {})
    share = min(max(toxic_share, 1e-3), 1 - 1e-3)
    weights = np.where(y[rest] == 1, share / y[rest].mean(), (1 - share) / (1 - y[rest]).mean())
    return Model(net, _calibrate(best, y[rest], weights))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on labelled rows that are not held out: FIT_TOXIC and FIT_CLEAN rows at most, those of the
    smallest md5 of their id; their texts whole, but for those of over FIT_LONGEST words, which are left out.  Without rows of both classes the model scores every text with the labels' share."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(
        F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"), F.md5(F.concat(F.lit("toxic:"), F.col(id_col).cast("string"))).alias("key"))
    n, n_toxic = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    # the smallest keys of each class, by a bounded top-n of every task
    chosen = None
    for label, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        part = known.where(F.col("label") == label).orderBy("key", "id").limit(most)
        chosen = part if chosen is None else chosen.unionByName(part)
    # one text for each id (that of the smallest digest, where ids repeat), so the driver gets no more rows than chosen
    rows = (docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen.select("id", "label", "key")), "id")
            .where(word_count("text") <= FIT_LONGEST).groupBy("key", "label").agg(F.min_by("text", F.md5("text")).alias("text")).toPandas().sort_values(["key", "label"]))
    return train([words_of(t) for t in rows["text"]], rows["label"].tolist(), n_toxic / max(1, n))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` (it replaces one of that name): 0 to 1, the higher the likelier toxic.

    Null and empty texts are scored as a window without words.  Every window of a whole text counts,
    whatever its length; equal texts score the same, so repeated rows do; an empty table gives an
    empty result.  No column but the text is read."""
    small_batches(docs.sparkSession)
    data = pickle.dumps((model.network and (model.network.vocabulary, model.network.p), model.calibration))
    digest = hashlib.md5(data).hexdigest()

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        store = worker_store()
        if store.get("toxicity", (None,))[0] != digest:  # one model at a time is remembered
            network, calibration = pickle.loads(data)
            store["toxicity"] = (digest, Model(network and Network(network[0], p=network[1]), calibration), {})
        _, fitted, memo = store["toxicity"]
        return pd.Series(fitted.score(texts.tolist(), memo), dtype="float64")

    return docs.withColumn(name, scores(F.col(text_col)))
