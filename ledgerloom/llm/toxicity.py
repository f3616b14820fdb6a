"""Toxicity by subword bags: a linear softmax over averaged embeddings, trained jointly in numpy.

A word is the average of the embeddings of the word itself and its character n-grams (hashed), so misspellings that
were never seen share most of their vector with what was. A window of ``WINDOW`` words is the average of its words (up to
a constant factor: their sum over ``scales``), and a linear softmax over it gives the probability. A document is as toxic
as its most toxic window: a few words in a long text are not averaged away. Embeddings and softmax are learned together:
each epoch takes every training document's window that is most toxic under the model so far (every ``SHORT``-th epoch one
of ``SCALE`` words, so that few words can be enough) and runs Adam over mini-batches. The first windows are those with most of the n-grams that can tell toxic documents.

Only such n-grams have an embedding: found in ``LEAST_DOCS`` documents and ``LEAST_EXCESS`` standard deviations more
often in toxic ones than in others (a document counts up to ``CLIP`` occurrences). With some hundreds of labels all other
n-grams of a window would merely be learned by heart.

Since averaging and softmax are linear, a trained model folds into one number per hashed n-gram; scoring is the mean of
numbers. Every text is scored whole.

Learning uses whole texts of at most ``SAMPLE_DOCS`` labelled documents per class, those with the smallest hash of the
id, and of fewer if these have more than ``SAMPLE_CHARS`` characters in all. Cases: null and empty texts and texts without words score as the bias alone says;
without labels of both classes the score is the share of label 1, or 0; repeated labels of a document all count;
repeated rows give equal scores; null ids are never learned from; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_arrow
from .tokens import by_bytes

SAMPLE_DOCS, SAMPLE_CHARS = 1500, 12_000_000
BUCKETS, DIMENSION, SIZES = 1 << 17, 12, (4, 5, 6, 7)
WINDOW, SCALE = 128, 12
SHORT = 4
EPOCHS, STEPS, BATCH, RATE = 30, 300, 64, 0.03
LEAST_DOCS, LEAST_EXCESS, CLIP = 3, 5.0, 3
_KEEP = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased words; a word repeated at once counts once."""
    words = text.lower().encode().translate(_KEEP).split()
    return words[:1] + [b for a, b in zip(words, words[1:]) if a != b]


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words one after another, and where each word's begin (one more entry at the end).
    Every word has at least its own bucket."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(ends, sizes) - np.arange(text.size)  # characters to the end of the word
    found, of = [], []
    value = np.zeros(text.size, np.uint64)
    for n in range(1, max(SIZES) + 1):
        value[: text.size - n + 1] = value[: text.size - n + 1] * np.uint64(0x100000001B3) + text[n - 1 :] + np.uint64(1)
        if n in SIZES:
            at = np.flatnonzero(left >= n)
            found.append(value[at] + np.uint64(n))
            of.append(owner[at])
    power = np.cumprod(np.full(int(sizes.max()), 0x9E3779B97F4A7C15, np.uint64))
    place = np.repeat(sizes, sizes) - left
    found.append(np.add.reduceat(text * power[place], ends - sizes) ^ np.uint64(0x5851F42D4C957F2D))
    of.append(np.arange(len(words)))
    of = np.concatenate(of)
    order = np.argsort(of, kind="stable")
    mixed = np.concatenate(found)[order] * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.append(0, np.cumsum(np.bincount(of, minlength=len(words))))


@dataclass
class Model:
    """What each bucket adds to the logit of label 1, and the bias."""

    gain: np.ndarray
    bias: float
    known: dict

    def word_scores(self, words: list[bytes]) -> np.ndarray:
        missing = list({w for w in words if w not in self.known})
        extra = {}
        if missing:
            buckets, begin = subwords(missing)
            means = np.add.reduceat(self.gain[buckets], begin[:-1]) / np.diff(begin)
            extra = dict(zip(missing, means.tolist(), strict=True))
            if len(self.known) > 400_000:
                extra.update((w, self.known[w]) for w in words if w in self.known)
                self.known.clear()
            self.known.update((w, v) for w, v in extra.items() if len(w) <= 40)
        known = self.known
        try:
            return np.array([known[w] for w in words])
        except KeyError:
            return np.array([known[w] if w in known else extra[w] for w in words])

    def scores(self, texts: list[str]) -> np.ndarray:
        own = [words_of(x) for x in texts]
        top, _ = best_windows(self.word_scores([w for x in own for w in x]), np.array([len(x) for x in own], np.int64), WINDOW)
        return 1 / (1 + np.exp(-np.clip(top + self.bias, -30, 30)))


def scales(sizes: np.ndarray) -> np.ndarray:
    """What the sum of a window's words is divided by: SCALE, or the number of words of shorter texts, half of SCALE at least."""
    return np.clip(sizes, SCALE // 2, SCALE)


def best_windows(scores: np.ndarray, sizes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """For each document the highest sum of ``window`` consecutive words over ``scales``, and where that window
    begins among all words."""
    sums = np.append(0.0, np.cumsum(scores))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    short = np.minimum(sizes, window)
    count = sizes - short + 1
    count[sizes == 0] = 0
    owner = np.repeat(np.arange(sizes.size), count)
    at = np.arange(owner.size) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begins, count)
    mean = (sums[at + short[owner]] - sums[at]) / scales(sizes)[owner]
    top, where = np.zeros(sizes.size), begins.copy()
    filled = np.flatnonzero(count)
    if filled.size:
        edge = (np.cumsum(count) - count)[filled]
        top[filled] = np.maximum.reduceat(mean, edge)
        hit = np.flatnonzero(mean == top[owner])
        first = np.unique(owner[hit], return_index=True)
        where[first[0]] = at[hit[first[1]]]
    return top, where


@dataclass
class Corpus:
    """Documents as numbers of words; for each word the buckets of its n-grams (``first`` and ``held``: where they begin
    and how many they are) and the share of each in the word's average."""

    stream: np.ndarray
    sizes: np.ndarray
    begins: np.ndarray
    buckets: np.ndarray
    first: np.ndarray
    held: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> Corpus:
        own = [words_of(x) for x in texts]
        sizes = np.array([len(x) for x in own], np.int64)
        vocabulary: dict[bytes, int] = {}
        stream = np.array([vocabulary.setdefault(w, len(vocabulary)) for x in own for w in x], np.int64)
        buckets, first = subwords(list(vocabulary) or [b"-"])
        held = np.diff(first)
        return cls(stream, sizes, np.cumsum(sizes) - sizes, buckets, first[:-1], held, 1 / held)

    def only(self, keep: np.ndarray) -> Corpus:
        """With no other buckets than those of ``keep``; the averages stay as they are."""
        ok = keep[self.buckets]
        held = np.add.reduceat(ok.astype(np.int64), self.first)
        return replace(self, buckets=self.buckets[ok], first=np.cumsum(held) - held, held=held)

    def ngrams(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of the words' n-grams, and for each the place of its word in ``words``."""
        held = self.held[words]
        place = np.repeat(np.arange(words.size), held)
        nth = np.arange(place.size) - (np.cumsum(held) - held)[place]
        return self.buckets[self.first[words[place]] + nth], place

    def word_means(self, gain: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(self.held.size), self.held), gain[self.buckets], self.held.size) * self.share


def telling(corpus: Corpus, y: np.ndarray) -> np.ndarray:
    """Which buckets are clearly more frequent in documents of label 1."""
    found, docs = np.zeros((2, BUCKETS)), np.zeros(BUCKETS)
    for begin, size, label in zip(corpus.begins.tolist(), corpus.sizes.tolist(), y.tolist(), strict=True):
        words, times = np.unique(corpus.stream[begin : begin + size], return_counts=True)
        bucket, place = corpus.ngrams(words)
        used, slot = np.unique(bucket, return_inverse=True)
        found[int(label), used] += np.minimum(np.bincount(slot, times[place], used.size), CLIP)
        docs[used] += 1
    expected = (found[0] + 1) * (found[1].sum() / max(1.0, found[0].sum()))
    return (docs >= LEAST_DOCS) & (found[1] - expected >= LEAST_EXCESS * np.sqrt(expected + 1))


def train(texts: list[str], labels: list[int], seed: int = 11) -> Model:
    y = np.array(labels, np.float64)
    if not y.size or y.min() == y.max():
        share = float(y.mean()) if y.size else 0.0
        return Model(np.zeros(BUCKETS), float(np.log((share + 1e-9) / (1 - share + 1e-9))), {})
    rng = np.random.default_rng(seed)
    corpus = Corpus.of(texts)
    keep = telling(corpus, y)
    corpus = corpus.only(keep)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION)) * keep[:, None]
    weight, bias = rng.normal(0, 0.1, (DIMENSION, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, weight, bias)]
    over = scales(corpus.sizes)
    step = 0
    for epoch in range(max(EPOCHS, STEPS * BATCH // y.size)):
        gain = embedding @ (weight[:, 1] - weight[:, 0]) if epoch else keep.astype(np.float64)
        window = SCALE if epoch % SHORT == SHORT - 1 else WINDOW
        at = best_windows(corpus.word_means(gain)[corpus.stream], corpus.sizes, window)[1]
        length = np.minimum(corpus.sizes, window)
        order = rng.permutation(y.size)  # a document without words is an empty window
        for some in np.array_split(order, max(1, order.size // BATCH)):
            step += 1
            row = np.repeat(np.arange(some.size), length[some])
            nth = np.arange(row.size) - (np.cumsum(length[some]) - length[some])[row]
            words = corpus.stream[at[some][row] + nth]
            bucket, place = corpus.ngrams(words)
            used, slot = np.unique(bucket, return_inverse=True)
            bag = np.zeros((some.size, used.size))
            np.add.at(bag, (row[place], slot), (corpus.share[words] / over[some][row])[place])
            mean = bag @ embedding[used]
            logits = mean @ weight + bias
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(some.size), y[some].astype(int)] -= 1
            p /= some.size
            slopes = (bag.T @ (p @ weight.T), mean.T @ p, p.sum(axis=0))
            for values, own_state, slope, part in zip((embedding, weight, bias), state, slopes, (used, slice(None), slice(None)), strict=True):
                own_state[0][part] = 0.9 * own_state[0][part] + 0.1 * slope
                own_state[1][part] = 0.999 * own_state[1][part] + 0.001 * slope**2
                scale = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                values[part] -= scale * own_state[0][part] / (np.sqrt(own_state[1][part]) + 1e-8)
    return Model(embedding @ (weight[:, 1] - weight[:, 0]), float(bias[1] - bias[0]), {})


def learn(df: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """``labels`` has ``doc_id`` and ``label_col``; ``learnable`` is an expression over its ``doc_id``."""
    given = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isin(0, 1) & learnable)
    given = given.select(F.col("doc_id").cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).withColumn("_hash", F.xxhash64("_id", F.lit(6)))
    chosen = [r for label in (0, 1) for r in given.where(F.col("_label") == label).orderBy("_hash", "_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return train([], [])
    table = F.broadcast(given.sparkSession.createDataFrame(chosen, given.schema))  # at most 2 x SAMPLE_DOCS rows
    docs = keyed(df, id_col, text_col)
    found = docs.join(table, docs.doc_id == table["_id"]).select("_hash", "_id", "_label", F.coalesce("text", F.lit("")).alias("part"))
    found = found.withColumn("_size", F.length("part"))
    sizes = found.groupBy("_hash", "_id", "_label", "_size").count().collect()
    left, taken = [SAMPLE_CHARS, SAMPLE_CHARS], []
    for _, doc, label, size, n in sorted(map(tuple, sizes)):  # what does not fit leaves its room to later ones
        if size * n <= left[label]:
            left[label] -= size * n
            taken.append((doc, label, size))
    if len(taken) < len(sizes):
        keep = F.broadcast(given.sparkSession.createDataFrame(taken, "_id long, _label int, _size int"))
        found = found.join(keep, ["_id", "_label", "_size"], "left_semi")
    rows = sorted(found.select("_hash", "_id", "_label", "part").collect())
    return train([r["part"] for r in rows], [r["_label"] for r in rows])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""
    sent = df.sparkSession.sparkContext.broadcast((model.gain.astype(np.float32), model.bias))
    own: dict[str, Model] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        if not own:
            own["model"] = Model(*sent.value, {})
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            for first, last in by_bytes(texts, 2 << 20):
                yield {"doc_id": ids[first:last], "score": own["model"].scores([x or "" for x in texts[first:last]])}

    return map_arrow(keyed(df, id_col, text_col), rows, "doc_id long, score double")


def scored(df: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """Learns from the labels of all folds but one and scores every document: doc_id, held_out, score, predicted."""
    fold = F.crc32(F.col("doc_id").cast("string")) % folds
    found = score(df, learn(df, labels, fold != held_out))
    return found.select("doc_id", F.coalesce(fold == held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
