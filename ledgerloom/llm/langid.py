"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over a bounded sample of labelled text. A text is cross-parsed against
each automaton: the longest match with the sample is one phrase, and the next starts after it. The language that needs
the fewest phrases, normalised by the bits that address its sample (log2 of the sample's length), wins.

Learning: all languages that have labelled text are learned. ``SAMPLE_DOCS`` documents of each, those with the smallest
hash of the id, give ``SAMPLE_CHARS`` characters each from a place set by that hash; where there are so many languages
that this would be more than ``SAMPLE_ROWS`` documents, each gives an equal part of these, ``LEAST_DOCS`` at least. The
bound is one of labelled rows; the automata's size depends on it, so they can be broadcast. Predicting: whole texts, as
UTF-8 of the lower-cased text with everything between letters as one class. Texts
are cut into stretches of ``STRETCH`` bytes that are parsed side by side; each stretch starts a new phrase for every
language alike.

Cases: null text, empty text and text without a letter give ``und`` with score 0; so does everything if there is
nothing to learn from. Ties go to the first language in order. Repeated rows give equal results; null ids stay null and
are never learned from; other columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed, map_arrow
from .tokens import by_bytes

SAMPLE_DOCS, SAMPLE_CHARS = 120, 400
SAMPLE_ROWS, LEAST_DOCS = 24_000, 12
STRETCH = 1024
UNDETERMINED = "und"


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string")) % folds


@dataclass
class Automaton:
    """A suffix automaton in flat arrays; state 0 is none, 1 the start. Most states have one transition: ``symbol`` and
    ``to``. The others are rows of ``wide``, found by ``row`` (0: an empty row)."""

    symbol: np.ndarray
    to: np.ndarray
    row: np.ndarray
    wide: np.ndarray

    @classmethod
    def of(cls, text: bytes, width: int) -> Automaton:
        """Of a text of classes 1 to ``width`` - 1."""
        edges: list[dict[int, int]] = [{}, {}]
        link, length = [0, 0], [0, 0]
        last = 1
        for c in text:
            new = len(edges)
            edges.append({})
            length.append(length[last] + 1)
            link.append(1)
            p = last
            while p and c not in edges[p]:
                edges[p][c] = new
                p = link[p]
            if p:
                q = edges[p][c]
                if length[q] == length[p] + 1:
                    link[new] = q
                else:
                    twin = len(edges)
                    edges.append(dict(edges[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = link[new] = twin
                    while p and edges[p].get(c) == q:
                        edges[p][c] = twin
                        p = link[p]
            last = new
        symbol, to, row = np.zeros(len(edges), np.uint8), np.zeros(len(edges), np.int32), np.zeros(len(edges), np.int32)
        several = [s for s, out in enumerate(edges) if len(out) > 1]
        wide = np.zeros((len(several) + 1, width), np.int32)
        for i, s in enumerate(several, 1):
            row[s] = i
            wide[i, list(edges[s])] = list(edges[s].values())
        for s, out in enumerate(edges):
            if len(out) == 1:
                ((symbol[s], to[s]),) = out.items()
        return cls(symbol, to, row, wide)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each state goes with its symbol, 0 where it can't."""
        return np.where(self.symbol[state] == symbol, self.to[state], self.wide[self.row[state], symbol])

    def phrases(self, steps: np.ndarray) -> np.ndarray:
        """For each column of ``steps`` (0: unknown, 255: the filling after its end) its number of phrases."""
        state = np.ones(steps.shape[1], np.int32)
        ended = np.ones(steps.shape[1], np.int64)
        first = self.step(np.ones(256, np.int32), np.minimum(np.arange(256), self.wide.shape[1] - 1).astype(np.uint8))
        first = np.where(first, first, 1).astype(np.int32)
        for symbol in steps:
            live = symbol != 255
            known = np.where(live, symbol, 0)
            to = self.step(state, known)
            stop = (to == 0) & live
            ended += stop
            state = np.where(live, np.where(stop, first[known], to), state)
        return ended


@dataclass
class Model:
    """Languages, byte classes (0: not met in learning), and per language the automaton and the bits of a phrase."""

    languages: list[str]
    classes: bytes
    automata: list[Automaton]
    bits: list[float]

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases [text, language]; ``texts`` are prepared and not empty."""
        sizes = np.array([len(x) for x in texts])
        stretches = -(-sizes // STRETCH)
        owner = np.repeat(np.arange(sizes.size), stretches)
        flat = np.full(int(stretches.sum()) * STRETCH, 255, np.uint8)
        place = (np.cumsum(stretches) - stretches) * STRETCH
        data = np.frombuffer(b"".join(texts).translate(self.classes), np.uint8)
        flat[np.repeat(place - (np.cumsum(sizes) - sizes), sizes) + np.arange(data.size)] = data
        steps = np.ascontiguousarray(flat.reshape(-1, STRETCH).T)
        return np.stack([np.bincount(owner, a.phrases(steps), sizes.size) for a in self.automata], axis=1)


def prepared(text: str) -> bytes:
    """Lower case, UTF-8, every run of ASCII that is no letter as one space."""
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def learn(df: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """A model from the rows of ``df`` that ``learnable`` admits and whose language and text are given."""
    rows = df.where(learnable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    rows = rows.withColumn("_hash", F.xxhash64("doc_id", F.lit(5)))
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    if not sizes:
        return None
    docs = max(LEAST_DOCS, min(SAMPLE_DOCS, SAMPLE_ROWS // len(sizes)))
    below = [(lang, min(int(min(1.0, 2 * docs / n) * ((1 << 64) - 1)) - (1 << 63), (1 << 63) - 1)) for lang, n in sizes.items()]  # about twice as many as wanted pass the hash; the smallest are taken below
    passing = rows.join(F.broadcast(df.sparkSession.createDataFrame(below, "lang string, _below long")), "lang").where("_hash <= _below")
    begin = F.pmod("_hash", F.greatest(F.lit(1), F.length("text") - SAMPLE_CHARS + 1)).cast("int") + 1
    sample = passing.select("lang", "_hash", "doc_id", F.substr("text", begin, F.lit(SAMPLE_CHARS)).alias("part")).collect()
    parts: dict[str, list] = {}
    for r in sorted(sample, key=lambda r: (r["lang"], r["_hash"], r["doc_id"], r["part"])):
        parts.setdefault(r["lang"], []).append(r["part"])
    texts = {lang: b" ".join(prepared(x) for x in own[:docs]) for lang, own in parts.items()}
    texts = {lang: x for lang, x in texts.items() if x.strip()}
    if not texts:
        return None
    met = sorted({c for x in texts.values() for c in x})[:253]
    classes = bytearray(256)
    for i, c in enumerate(met):
        classes[c] = i + 1
    languages = sorted(texts)
    automata = [Automaton.of(texts[x].translate(bytes(classes)), len(met) + 1) for x in languages]
    return Model(languages, bytes(classes), automata, [float(np.log2(len(texts[x]) + 1)) for x in languages])


def with_language(df: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` with lang_pred and score (columns of these names in ``df`` are replaced). The score is the
    winner's share of the inverse fourth powers of phrase bits."""
    df = df.drop("lang_pred", "score")
    if model is None:
        return df.withColumns({"lang_pred": F.lit(UNDETERMINED), "score": F.lit(0.0)})
    sent = df.sparkSession.sparkContext.broadcast(pickle.dumps(model, protocol=5))  # bounded by the sample
    columns = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", lang_pred string, score double"

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        model = pickle.loads(sent.value)
        bits = np.array(model.bits)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            for first, last in by_bytes(texts, 2 << 20):
                some = [i for i in range(first, last) if texts[i] and any(map(str.isalpha, texts[i]))]
                if some:
                    cost = model.phrases([prepared(texts[i]) for i in some]) * bits
                    best = cost.argmin(axis=1)
                    share = (cost.min(axis=1, keepdims=True) / cost) ** 4
                    for i, b, s in zip(some, best.tolist(), (1 / share.sum(axis=1)).tolist(), strict=True):
                        lang[i], score[i] = model.languages[b], s
            yield {c: batch.column(c) for c in columns} | {"lang_pred": lang, "score": score}

    return map_arrow(df, rows, schema)


def predict(df: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score."""
    return with_language(keyed(df, id_col, text_col), model).select("doc_id", "lang_pred", "score")


def identified(df: DataFrame, folds: int = 5, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from all folds but one and predicts every document: doc_id, held_out, lang_pred, score."""
    model = learn(df, fold(F.col(id_col), folds) != held_out, id_col, text_col, lang_col)
    found = predict(df, model, id_col, text_col)
    return found.select("doc_id", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
