"""Language ID by a bidirectional gated recurrent network over bytes, trained here in numpy.

The network reads maximal runs of letters (ASCII letters in lower case and all non-ASCII bytes),
cut at ``SEGMENT`` bytes, in both directions and labels every byte. A document's probabilities are
the mean over all its labelled positions. Equal segments give equal labels, so a task runs every
distinct segment of its documents once and weighs it by its places.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, stash, text_bytes, word_codes, word_spans

UNKNOWN = "und"
SEGMENT = 32
#: Bounds of the labelled sample: documents, then distinct (language, segment) pairs, then labels.
SAMPLE_DOCS = 3000
SAMPLE_SEGMENTS = 24_000
MAX_LANGUAGES = 512
HIDDEN = 12
EMBED = 8
STEPS = 400
BATCH = 256
CACHE = 1_000_000
#: The least score told from the scores of held-out labelled documents (``least_score``).
LEAST_SCORED = 30
LOW_QUANTILE = 0.01
ABOVE_CHANCE = 0.25

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32
LETTER = np.zeros(256, bool)
LETTER[ord("a") : ord("z") + 1] = LETTER[0x80:] = True


def _sigmoid(x):
    return 0.5 * (np.tanh(0.5 * x) + 1)


@dataclass
class Network:
    """Weights of the network; ``labels`` are its outputs."""

    labels: list[str]
    w: dict[str, np.ndarray]

    @classmethod
    def fresh(cls, labels: list[str], seed: int = 5) -> Network:
        r = np.random.default_rng(seed)
        k, h, e = len(labels), HIDDEN, EMBED
        shapes = {"embed": (256, e), "out_b": (k,)}
        for d in "fb":
            shapes |= {f"{d}_in": (e, 3 * h), f"{d}_rec": (h, 3 * h), f"{d}_bias": (3 * h,), f"{d}_out": (h, k)}
        w = {}
        for name, s in shapes.items():
            scale = 0.0 if len(s) == 1 else (0.5 if name == "embed" else 1 / np.sqrt(s[0]))
            w[name] = (r.standard_normal(s) * scale).astype(np.float32)
        return cls(labels, w)

    def _pass(self, d: str, bytes_: np.ndarray, keep: bool):
        """Hidden states (steps, rows, hidden) of one direction over equal-long segments."""
        n, steps = bytes_.shape
        h3 = 3 * HIDDEN
        inputs = self.w["embed"] @ self.w[f"{d}_in"] + self.w[f"{d}_bias"]
        rec = self.w[f"{d}_rec"]
        h = np.zeros((n, HIDDEN), np.float32)
        states = np.empty((steps, n, HIDDEN), np.float32)
        kept = []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a, u = inputs[bytes_[:, t]], h @ rec
            gates = _sigmoid(a[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
            c = np.tanh(a[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN : h3])
            new = c + z * (h - c)
            if keep:
                kept.append((t, h, z, r, c, u[:, 2 * HIDDEN :]))
            h = states[t] = new
        return states, kept

    def positions(self, bytes_: np.ndarray, keep: bool = False):
        """Label probabilities (steps, rows, labels) of every byte."""
        (f, kf), (b, kb) = self._pass("f", bytes_, keep), self._pass("b", bytes_, keep)
        logits = f @ self.w["f_out"] + b @ self.w["b_out"] + self.w["out_b"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        return (p, f, b, kf, kb) if keep else p

    def gradients(self, bytes_: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean cross entropy over all positions, by backpropagation through time."""
        p, f, b, kf, kb = self.positions(bytes_, keep=True)
        steps, n, _ = p.shape
        d = p.copy()
        d[:, np.arange(n), label] -= 1
        d *= (weight / (weight.sum() * steps))[None, :, None]
        g = {"out_b": d.sum(axis=(0, 1)), "embed": np.zeros_like(self.w["embed"])}
        for name, states, kept in (("f", f, kf), ("b", b, kb)):
            g[f"{name}_out"] = np.einsum("tnh,tnk->hk", states, d)
            down = d @ self.w[f"{name}_out"].T
            rec, win = self.w[f"{name}_rec"], self.w[f"{name}_in"]
            g[f"{name}_rec"], g_table = np.zeros_like(rec), np.zeros((256, 3 * HIDDEN), np.float32)
            dh = np.zeros((n, HIDDEN), np.float32)
            for t, before, z, r, c, uc in reversed(kept):
                dh = dh + down[t]
                dz = dh * (before - c) * z * (1 - z)
                dc = dh * (1 - z) * (1 - c * c)
                dr = dc * uc * r * (1 - r)
                da = np.concatenate([dz, dr, dc], axis=1)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                np.add.at(g_table, bytes_[:, t], da)
                g[f"{name}_rec"] += before.T @ du
                dh = dh * z + du @ rec.T
            g[f"{name}_bias"] = g_table.sum(axis=0)
            g[f"{name}_in"] = self.w["embed"].T @ g_table
            g["embed"] += g_table @ win.T
        return g

    def pooled(self, segments: np.ndarray) -> np.ndarray:
        """Sum over positions of the label probabilities of equal-long segments, worked in pieces."""
        out = np.empty((len(segments), len(self.labels)), np.float32)
        for i in range(0, len(segments), 8192):
            out[i : i + 8192] = self.positions(segments[i : i + 8192]).sum(axis=0)
        return out


def train(samples: list[tuple[str, bytes, int]], steps: int = STEPS, seed: int = 5) -> Network:
    """A network from (label, segment, count) triples: Adam on batches of equal-long segments, drawn by
    count inside a label and evenly over labels."""
    labels = sorted({s[0] for s in samples})
    net = Network.fresh(labels, seed)
    if len(labels) < 2:
        return net
    r = np.random.default_rng(seed)
    number = {x: i for i, x in enumerate(labels)}
    totals = np.zeros(len(labels))
    for x, _, c in samples:
        totals[number[x]] += c
    by_length: dict[int, list] = {}
    for x, s, c in samples:
        by_length.setdefault(len(s), []).append((number[x], s, c / totals[number[x]]))
    groups = []
    for rows in by_length.values():
        weight = np.array([q[2] for q in rows])
        groups.append((np.array([list(q[1]) for q in rows], np.uint8), np.array([q[0] for q in rows]), weight / weight.sum(), weight.sum()))
    # a step's share of lengths follows the positions they hold, so every position counts alike
    share = np.array([g[3] * g[0].shape[1] for g in groups])
    m = {k: np.zeros_like(v) for k, v in net.w.items()}
    v = {k: np.zeros_like(x) for k, x in net.w.items()}
    for step in range(1, steps + 1):
        bytes_, label, weight, _ = groups[r.choice(len(groups), p=share / share.sum())]
        pick = r.choice(len(label), min(BATCH, 4 * len(label)), p=weight)
        grad = net.gradients(bytes_[pick], label[pick], np.ones(len(pick), np.float32))
        rate = 0.02 * (1 - 0.9 * step / steps)
        norm = float(np.sqrt(sum((x * x).sum() for x in grad.values())))
        for k, x in grad.items():
            x = x * min(1.0, 1.0 / max(norm, 1e-9))
            m[k] = 0.9 * m[k] + 0.1 * x
            v[k] = 0.99 * v[k] + 0.01 * x * x
            net.w[k] = (net.w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves no remainder by 5; a null id is not held out (nor learnt from)."""
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(5)) == 0, F.lit(False))


def _sample(usable: DataFrame, docs: int) -> DataFrame:
    """(h, doc_id, lang, text) of at most ``docs`` rows, those of smallest hash of their id."""
    usable = usable.select(F.xxhash64("doc_id").alias("h"), "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # the last hash first, from ids alone: then no task merges more texts than the sample has
    last = usable.select("h").orderBy("h").limit(docs).agg(F.max("h")).first()[0]
    usable = usable.where(F.col("h") <= F.lit(last if last is not None else 0).cast("long"))
    return usable.orderBy("h", "doc_id", "lang", F.xxhash64("text")).limit(docs)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_segments: int = SAMPLE_SEGMENTS) -> Network:
    """Train on at most ``sample_docs`` labelled documents that are not held out, those of smallest hash
    of their id, and of these at most ``sample_segments`` distinct (language, segment) pairs."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    picked = _sample(usable, sample_docs)
    schema = "lang string, segment binary, n long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, "text"):
                found: dict[tuple[str, bytes], int] = {}
                raw, start, end, first = segments(b.column("text"))
                text = raw.tobytes()
                for i, lang in enumerate(b.column("lang").to_pylist()):
                    for j in range(first[i], first[i + 1]):
                        k = (lang, text[start[j] : end[j]])
                        found[k] = found.get(k, 0) + 1
                yield pa.RecordBatch.from_pydict(
                    {"lang": [k[0] for k in found], "segment": pa.array([k[1] for k in found], pa.binary()), "n": pa.array(found.values(), pa.int64())}
                )

    counts = picked.select("lang", "text").mapInArrow(cut, schema).groupBy("lang", "segment").agg(F.sum("n").alias("n"))
    rows = counts.orderBy(F.xxhash64("lang", "segment"), "lang", "segment").limit(sample_segments).collect()
    if len({r.lang for r in rows}) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages in the sample")
    return train([(r.lang, bytes(r.segment), r.n) for r in rows])


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(folded bytes, start, end, first): runs of letters cut at ``SEGMENT`` bytes, all of them."""
    raw, offsets = text_bytes(texts)
    raw = FOLD[raw]
    start, end, first = word_spans(raw, offsets, LETTER[raw])
    pieces = -(-(end - start) // SEGMENT)
    if len(pieces) and pieces.max() > 1:
        upto = np.concatenate(([0], np.cumsum(pieces)))
        nth = np.arange(upto[-1]) - np.repeat(upto[:-1], pieces)
        stop = np.repeat(end, pieces)
        start = np.repeat(start, pieces) + nth * SEGMENT
        end, first = np.minimum(start + SEGMENT, stop), upto[first]
    return raw, start, end, first


class Labeller:
    """Pools documents; keeps the pooled labels of up to ``CACHE`` distinct segments."""

    def __init__(self, net: Network):
        self.net = net
        self.codes = np.zeros(0, np.uint64)
        self.sums = np.zeros((0, len(net.labels)), np.float32)

    def pooled(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(best label number, its probability) per text; -1 and 0 where nothing could be labelled."""
        raw, start, end, first = segments(texts)
        rows, k = len(texts), len(self.net.labels)
        if not len(start) or not k:
            return np.full(rows, -1), np.zeros(rows)
        codes, example, where = np.unique(word_codes(raw, start, end), return_index=True, return_inverse=True)
        at = np.searchsorted(self.codes, codes)
        known = np.zeros(len(codes), bool)
        if len(self.codes):
            known = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
        sums = np.empty((len(codes), k), np.float32)
        sums[known] = self.sums[at[known]]
        new = np.flatnonzero(~known)
        lengths = (end - start)[example[new]]
        for n in np.unique(lengths).tolist():
            mine = new[lengths == n]
            sums[mine] = self.net.pooled(raw[start[example[mine]][:, None] + np.arange(n)])
        if len(self.codes) + len(new) > CACHE:
            self.codes, self.sums = codes, sums
        else:
            order = np.argsort(both := np.concatenate([self.codes, codes[new]]))
            self.codes, self.sums = both[order], np.concatenate([self.sums, sums[new]])[order]
        upto = np.zeros((len(where) + 1, k))
        np.cumsum(sums[where], axis=0, out=upto[1:], dtype=np.float64)
        total = upto[first[1:]] - upto[first[:-1]]
        length = np.concatenate(([0], np.cumsum(end - start)))
        length = (length[first[1:]] - length[first[:-1]])[:, None]
        mean = total / np.maximum(length, 1)
        best = mean.argmax(axis=1)
        score = np.clip(mean[np.arange(rows), best], 0.0, 1.0)
        none = length[:, 0] == 0
        return np.where(none, -1, best), np.where(none, 0.0, score)


def _labels_of(labeller: Labeller, b: pa.RecordBatch, text: str, lettered: str) -> tuple[list[str], np.ndarray]:
    best, score = labeller.pooled(b.column(text))
    some = b.column(lettered).to_numpy(zero_copy_only=False).astype(bool) & (best >= 0)
    names = [labeller.net.labels[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), some.tolist(), strict=True)]
    return names, np.where(some, score, 0.0)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, lang_pred, score) per row. ``und`` with score 0 for null texts, texts without a letter
    and a network without labels."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), has_letter(F.col("text").cast("string")).alias("lettered"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    weights = rows.sparkSession.sparkContext.broadcast((net.labels, net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Network(*weights.value))
        for whole in batches:
            for b in slices(whole, "text"):
                names, score = _labels_of(labeller, b, "text", "lettered")
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score, pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


CELLS = 4096


def value_at(values: DataFrame, column: str, rank: int) -> float:
    """The value of 0-based ``rank`` in ascending order, exactly: counts over ``CELLS`` cells, then over cells of the
    one that holds it, until it holds one value. No value is sorted, and a round returns a row per cell at most."""
    x = F.col(column)
    lo, hi = values.agg(F.min(x), F.max(x)).first()
    while lo < hi:
        cell = F.least(F.floor((x - F.lit(lo)) / F.lit(hi - lo) * CELLS), F.lit(CELLS - 1)).alias("cell")
        inside = values.where(x.between(lo, hi)).groupBy(cell)
        for r in sorted(inside.agg(F.count(F.lit(1)).alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi")).collect()):
            if rank < r.n:
                lo, hi = r.lo, r.hi
                break
            rank -= r.n
    return lo


def least_score(docs: DataFrame, net: Network) -> float:
    """The score from which on a language counts as told: a quarter of the way from chance (one by the
    number of labels) to the score that 99 in 100 held-out labelled documents reach.

    Found on all such documents. Under ``LEAST_SCORED`` of them, or under two labels, there is nothing to
    tell by and 0 is returned.
    """
    if len(net.labels) < 2:
        return 0.0
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & held_out(F.col("doc_id")))
    scores = stash(predict(usable, net).where(F.col("lang_pred") != UNKNOWN).select("score"), "held-out-scores")
    n = scores.count()
    if n < LEAST_SCORED:
        return 0.0
    place = LOW_QUANTILE * (n - 1)
    below, above = (value_at(scores, "score", int(f(place))) for f in (np.floor, np.ceil))
    low = below + (above - below) * (place - np.floor(place))
    chance = 1 / len(net.labels)
    return float(chance + ABOVE_CHANCE * (low - chance))


def keep_identified(docs: DataFrame, net: Network, min_score: float) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose language is told with ``min_score`` or more.

    One narrow pass: rows are judged and filtered where they are read. A network that has learnt no
    language rejects only texts without a letter.
    """
    if not net.labels:
        return docs.where(has_letter(F.col("text").cast("string")))
    columns = docs.columns
    names = {"t": "_text_", "l": "_lettered_"}
    taken = {c.lower() for c in columns}
    for k, v in names.items():
        while v in taken:
            v = f"_{v}"
        names[k] = v
    text = F.col("text").cast("string")
    rows = docs.withColumns({names["t"]: text, names["l"]: has_letter(text)})
    weights = rows.sparkSession.sparkContext.broadcast((net.labels, net.w))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(Network(*weights.value))
        for whole in batches:
            for b in slices(whole, names["t"]):
                found, score = _labels_of(labeller, b, names["t"], names["l"])
                ok = (np.array(found, dtype=object) != UNKNOWN) & (score >= min_score)
                yield b.select(columns).filter(pa.array(ok, pa.bool_()))

    return rows.mapInArrow(run, docs.schema)
