"""Toxicity: a convolutional text classifier over hashed word embeddings.

A text's words (lower case, split at what is neither letter nor digit) index ``ROWS``
embeddings by hash: a word's vector is the sum of its own row and of the rows of its first
4 and 5 bytes, so that inflected forms share what they have learnt. Filters of several widths run over the whole text, each keeps its
largest response, and a logistic layer joins these. The network is trained here, in numpy,
by mini-batches with adaptive steps. The gradient of a max goes to one place per filter
and text only, so a step costs little more than the forward pass.

Thresholds are calibrated by language afterwards, on rows that the weights were not fitted
to; a score itself sees nothing but the text.

Training takes at most ``SAMPLE`` labelled documents of each label, the first by a hash of
their id among the texts of up to ``TRAIN_BYTES`` bytes: what reaches the driver is
bounded by these. Scoring streams whole texts in blocks.

Defined cases: a null or empty text is padding alone and gets the score of that; without
labels of both kinds every score is 0; labels of one document that differ count as toxic;
of rows with one id the least text is trained on; repeated rows are scored alike; a null id
is not held out; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloft.llm import bytesvec as B
from graphloft.llm.common import table
from graphloft.shipping import ship

ROWS, DIM, FILTERS, WIDTHS = 1 << 15, 12, 12, (1, 2, 3)
#: Bytes of the word starts that have rows of their own.
PREFIXES = (4, 5)
#: Labelled documents that are trained on: of each label, and bytes of each.
SAMPLE, TRAIN_BYTES = 1500, 20_000
#: Documents of label 0 for each of label 1.
CALM = 2
#: Passes over the sample: EPOCHS, or more (up to MOST_EPOCHS) until STEPS batches are done.
EPOCHS, MOST_EPOCHS, STEPS = 10, 60, 700
BATCH, RATE, DECAY = 32, 0.05, 1e-4
#: Fixed value: the score from which a document is predicted toxic.
PREDICT = 0.3
_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
PAD = max(WIDTHS) - 1
#: Places of a text that are scored at once.
TILE = 1 << 16


def tokens(texts: pa.Array):
    """(first row, ids, starts): rows of embeddings for a block's texts, each padded at its end."""
    for lo, hi, data, off in B.blocks(texts):
        h, at, *short = B.word_hashes(data, off, spaces=_BREAK, prefixes=PREFIXES)
        n = at[1:] - at[:-1]
        starts = at[:-1] + (PAD + 1) * np.arange(hi - lo)
        ids = np.zeros((len(h) + (PAD + 1) * (hi - lo), 1 + len(PREFIXES)), np.int64)
        place = np.arange(len(h)) + np.repeat((PAD + 1) * np.arange(hi - lo), n)
        for k, x in enumerate([h, *short]):
            ids[place, k] = 1 + (x % np.uint64(ROWS - 1)).astype(np.int64)
        yield lo, ids, starts


class Network:
    """Weights: emb (row 0 is padding), one (width, DIM, FILTERS) array per width, and the last layer."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.emb = r.normal(0, 0.3, (ROWS, DIM)).astype(np.float32)
        self.emb[0] = 0
        self.conv = [r.normal(0, (w * DIM) ** -0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.bias = np.zeros((len(WIDTHS), FILTERS), np.float32)
        self.out = r.normal(0, 0.1, len(WIDTHS) * FILTERS).astype(np.float32)
        self.off = np.zeros(1, np.float32)

    def vectors(self, ids):
        x = self.emb[ids[..., 0]]
        for k in range(1, ids.shape[-1]):
            x += self.emb[ids[..., k]]
        return x

    def responses(self, ids):
        """Per width, the response of each filter at each place."""
        x = self.vectors(ids)
        flat = x @ np.concatenate([c.transpose(1, 0, 2).reshape(DIM, -1) for c in self.conv], 1)
        at, all_ = 0, []
        for w, bias in zip(WIDTHS, self.bias):
            y = flat[: len(ids) - w + 1, at : at + FILTERS] + bias
            for j in range(1, w):
                y += flat[j : len(ids) - w + 1 + j, at + j * FILTERS : at + (j + 1) * FILTERS]
            all_.append(y)
            at += w * FILTERS
        return all_

    def score(self, ids, starts) -> np.ndarray:
        """Of each text; responses are made for TILE places at a time, so that memory does not follow a text's length."""
        best = np.full((len(starts), len(WIDTHS) * FILTERS), -1e9, np.float32)
        ends = np.append(starts[1:], len(ids))
        for lo in range(0, len(ids), TILE):
            hi = min(lo + TILE, len(ids))
            part = ids[lo : hi + PAD]
            first = int(np.searchsorted(starts, lo, "right")) - 1
            last = int(np.searchsorted(starts, hi, "left"))
            cut = np.maximum(starts[first:last], lo) - lo
            for k, (w, y) in enumerate(zip(WIDTHS, self.responses(part))):
                y = y[: hi - lo]
                for j in range(1, w):  # a filter that starts in a text's last places would see the next text
                    over = ends - j - lo
                    y[over[(over >= 0) & (over < len(y))]] = -1e9
                if len(y) < hi - lo:  # places at the very end see padding only
                    y = np.concatenate([y, np.full((hi - lo - len(y), FILTERS), -1e9, y.dtype)])
                own = best[first:last, k * FILTERS : (k + 1) * FILTERS]
                np.maximum(own, np.maximum.reduceat(y, cut, axis=0), out=own)
        z = np.maximum(best, 0) @ self.out + self.off[0]
        return 1 / (1 + np.exp(-z.astype(np.float64)))


def fit(texts: list[str], labels: np.ndarray, share: float = 1.0, seed: int = 7) -> Network:
    net, rng = Network(seed), np.random.default_rng(seed)
    rows = []
    for _, ids, starts in tokens(pa.array(texts, pa.large_string())):
        ends = [*starts[1:], len(ids)]
        rows += [ids[a:b] for a, b in zip(starts, ends)]
    params = [net.emb, *net.conv, net.bias, net.out, net.off]
    seen = [np.full_like(p, 1e-4) for p in params]
    field = len(WIDTHS) * FILTERS
    epochs = min(MOST_EPOCHS, max(EPOCHS, -(-STEPS * BATCH // len(rows))))
    for _ in range(max(1, int(share * epochs))):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            ids = np.concatenate([rows[i] for i in batch])
            starts = np.cumsum([0, *[len(rows[i]) for i in batch]])
            ys = net.responses(ids)
            pos = np.empty((len(batch), field), np.int64)
            best = np.empty((len(batch), field), np.float32)
            for k, y in enumerate(ys):
                for d in range(len(batch)):
                    part = y[starts[d] : starts[d + 1] - WIDTHS[k] + 1]  # inside the text and its padding
                    a = part.argmax(0)
                    pos[d, k * FILTERS : (k + 1) * FILTERS] = starts[d] + a
                    best[d, k * FILTERS : (k + 1) * FILTERS] = part[a, np.arange(FILTERS)]
            on = best > 0
            act = np.where(on, best, 0)
            p = 1 / (1 + np.exp(-(act @ net.out + net.off[0])))
            g = ((p - labels[batch]) / len(batch)).astype(np.float32)
            back = g[:, None] * net.out * on
            grads = [None, *[np.zeros_like(c) for c in net.conv], np.zeros_like(net.bias), act.T @ g + DECAY * net.out, np.array([g.sum()], np.float32)]
            touched, delta = [], []
            for k, w in enumerate(WIDTHS):
                b, q = back[:, k * FILTERS : (k + 1) * FILTERS], pos[:, k * FILTERS : (k + 1) * FILTERS]
                grads[1 + len(WIDTHS)][k] = b.sum(0)
                for j in range(w):
                    where = ids[np.minimum(q + j, len(ids) - 1)]
                    grads[1 + k][j] = np.einsum("dfe,df->ef", net.vectors(where), b)
                    step = (b[:, :, None] * net.conv[k][j].T[None]).reshape(-1, DIM)
                    for part in range(where.shape[-1]):
                        touched.append(where[..., part].ravel())
                        delta.append(step)
            rows_, inverse = np.unique(np.concatenate(touched), return_inverse=True)
            summed = np.zeros((len(rows_), DIM), np.float32)
            np.add.at(summed, inverse, np.concatenate(delta))
            summed[rows_ == 0] = 0
            seen[0][rows_] += summed**2
            net.emb[rows_] -= RATE * summed / np.sqrt(seen[0][rows_])
            for p_, s_, g_ in zip(params[1:], seen[1:], grads[1:]):
                s_ += g_**2
                p_ -= RATE * g_ / np.sqrt(s_)
    return net


def held_out(doc_id):
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list:
    """Rows (doc_id, text, lang, toxic): at most `limit` of label 1 and CALM times as many of label 0, none of them held out."""
    known = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(~held_out(F.col("doc_id")))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    short = docs.filter(F.octet_length("text") <= TRAIN_BYTES).select("doc_id", "text", lang.alias("lang"))
    known = known.join(short.select("doc_id"), "doc_id", "left_semi")  # chosen among those that can be taken
    pick = lambda t: known.filter(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit if t else CALM * limit)
    ids = F.broadcast(pick(1).unionByName(pick(0)))  # (1 + CALM) * limit rows at most
    one = short.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.struct("text", "lang")).alias("x"))  # of rows with one id, the least
    return sorted(one.select("doc_id", "x.text", "x.lang", "toxic").collect(), key=lambda r: r["doc_id"])


def train(rows: list) -> tuple[Network | None, dict[str, float]]:
    """The network, and a threshold for each language; None without both labels."""
    y = np.array([r["toxic"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None, {}
    test = np.arange(len(rows)) % 5 == 4
    texts = [r["text"] for r in rows]
    half = fit([t for t, x in zip(texts, test) if not x], y[~test], share=0.5)
    s = score_texts(half, [t for t, x in zip(texts, test) if x])
    langs = np.array([r["lang"] or "" for r in rows])[test]
    cut = {}
    for lang in set(langs):
        a, b = s[langs == lang], y[test][langs == lang]
        tries = np.linspace(0.1, 0.9, 33)
        f1 = [2 * ((a >= t) & (b == 1)).sum() / max(1, (a >= t).sum() + (b == 1).sum()) for t in tries]
        if b.sum() >= 3:
            cut[str(lang)] = float(np.mean(tries[np.isclose(f1, max(f1))]))
    return fit(texts, y), cut


def score_texts(net: Network | None, texts) -> np.ndarray:
    texts = texts if isinstance(texts, (pa.Array, pa.ChunkedArray)) else pa.array(texts, pa.large_string())
    out = np.zeros(len(texts))
    if net is not None:
        for lo, ids, starts in tokens(texts):
            out[lo : lo + len(starts)] = net.score(ids, starts)
    return out


def classify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, lang, score) of each row."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(net)  # ROWS * DIM floats

    def work(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score_texts(sent.value, b.column(2)))], ["doc_id", "lang", "score"])

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), lang.alias("lang"), "text").mapInArrow(work, "doc_id long, lang string, score double")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    net, cut = train(sample(docs, table(spark, sf_dir, "labels")))
    limit = F.lit(0.5)
    for lang, t in cut.items():
        limit = F.when(F.col("lang") == lang, t).otherwise(limit)
    out = classify(docs, net).withColumn("threshold", limit)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= PREDICT).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))
