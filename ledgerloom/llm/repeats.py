"""Exact removal of long repeats with run-length indexes.

A window is ``LENGTH`` bytes of a document. A byte goes if a window that covers it also starts in a document with a
smaller id. Windows find each other by their anchor, the smallest hash of the ``GRAM``-byte grams inside: equal windows
have equal anchors, and a stretch of consecutive windows with one anchor travels as one segment.

1. Documents are dealt to batches; ``shared`` tells each batch which of its anchors other documents hold too. The rest,
   most of the text, goes nowhere.
2. Each batch sends every distinct segment with a shared anchor once, with the smallest document that has it, to the
   anchor's group. Where a larger document of the batch has an equal segment, it is covered, which needs no message.
3. A group builds a run-length index of its distinct segments (of those whose anchor is contested; a segment alone with
   its anchor covers its equals and nothing else): suffix array by doubling, Burrows-Wheeler transform cut
   into runs with the suffix array sampled at run ends, and, also by runs of rows, the smallest document among suffixes
   that agree in ``LENGTH`` bytes. Suffix array and text are then dropped. Segments stream through it backwards by
   LF steps, all side by side; at each byte the row tells whether the longest match with a smaller document reaches
   ``LENGTH``.
4. What was found returns to the documents' batches, where intervals become spans.

A passage of a third of all documents costs one segment per batch and variant. Before and after such a passage every
document has windows of its own under the passage's anchors; from ``HOT`` documents on the windows of an anchor are dealt
by their own hash, so that they do not meet in one group. A group's memory is that of its distinct shared text; groups
grow in number with the batches.

Cases: a null text counts as empty; texts under ``LENGTH`` bytes keep all; rows with one id are one document for what
counts as smaller (they don't remove from each other); null ids are smallest; repeated rows repeat; very long texts are
hashed in blocks; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, keyed
from .shared import batches_of, classes_of, distinct_keys, with_classes
from .shingles import BLOCK, mixed, powers, prefix_sums

LENGTH, GRAM = 50, 20
#: Class (bit length of the number of documents) from which the windows of an anchor go their own ways: 65536 documents.
HOT = 17
_LOWEST = -(1 << 63)


def segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document (place in ``raw``), first byte, number of windows and anchor of every segment. Texts are hashed in blocks;
    one longer than a block is cut into blocks that share all but one byte of a window."""
    parts, start = [], 0
    while start < len(raw):
        end, size = start, 0
        while end < len(raw) and size + len(raw[end]) <= BLOCK:
            size += len(raw[end])
            end += 1
        if end > start:
            blocks = [(0, raw[start:end])]
        else:
            blocks, end = [(at, [raw[start][at : at + BLOCK]]) for at in range(0, len(raw[start]), BLOCK - LENGTH + 1)], start + 1
        for shift, block in blocks:
            doc, at, count, anchor = _segments(block)
            parts.append((doc + start, at + shift, count, anchor))
        start = end
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _segments(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = np.frombuffer(b"".join(raw), np.uint8)
    grams = data.size - GRAM + 1
    wide = LENGTH - GRAM + 1  # grams in a window
    if grams < wide:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    sums = prefix_sums(data)
    least = mixed((sums[GRAM:] - sums[:-GRAM]) * powers()[1][:grams])
    reach = 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: least.size - (wide - reach)], least[wide - reach :])
    sizes = np.array([len(x) for x in raw], np.int64)
    edges = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - LENGTH + 1, 0)
    doc = np.repeat(np.arange(sizes.size), windows)
    at = np.arange(doc.size) - np.repeat(np.cumsum(windows) - windows, windows)
    anchor = least[at + edges[doc]]
    first = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]))) if doc.size else np.zeros(0, np.int64)
    return doc[first], at[first], np.diff(np.append(first, doc.size)), anchor[first]


def single_windows(texts: list[bytes], doc: np.ndarray, at: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments taken apart: each window for itself, with the hash of its bytes as anchor."""
    each = np.repeat(np.arange(doc.size), windows)
    place = at[each] + np.arange(each.size) - (np.cumsum(windows) - windows)[each]
    parts = [np.zeros(0, np.uint64)]
    for d, p, n in zip(doc.tolist(), at.tolist(), windows.tolist(), strict=True):
        for shift in range(0, n, BLOCK - LENGTH + 1):
            count = min(n - shift, BLOCK - LENGTH + 1)
            sums = prefix_sums(np.frombuffer(texts[d], np.uint8, count + LENGTH - 1, p + shift))
            parts.append(mixed((sums[LENGTH:] - sums[:-LENGTH]) * powers()[1][:count]))
    return doc[each], place, np.ones(each.size, np.int64), np.concatenate(parts)


@dataclass
class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of texts, each closed by an own terminator (rows 0 to texts - 1).

    run_start, run_to: first row of each run and where LF takes it; head, tail: the suffix array at a run's first and
    last row; row_start, row_owner: stretches of rows whose suffixes agree in LENGTH bytes with a smaller owner's, and
    the smallest owner (rows in no stretch are in one that starts with the owner -1)."""

    run_start: np.ndarray
    run_to: np.ndarray
    head: np.ndarray
    tail: np.ndarray
    row_start: np.ndarray
    row_owner: np.ndarray

    @classmethod
    def build(cls, texts: list[bytes], owner: np.ndarray) -> RunLengthIndex:
        """``owner``: rank of each text's document; texts are ordered as given."""
        sizes = np.array([len(x) for x in texts], np.int64)
        total = int(sizes.sum()) + sizes.size
        end = np.cumsum(sizes + 1) - 1  # terminators
        symbol = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 1
        symbol[end] = 0
        text_of = np.repeat(np.arange(sizes.size), sizes + 1)
        rest = end[text_of] - np.arange(total)  # bytes before the terminator
        suffix, agree = _suffix_array(symbol, rest)
        before = np.where(suffix > 0, symbol[suffix - 1], 0)
        run_start = np.flatnonzero(np.append(True, (before[1:] != before[:-1]) | (before[1:] == 0)))
        run_size = np.diff(np.append(run_start, total))
        order = np.argsort(before[run_start], kind="stable")
        run_to = np.empty(run_start.size, np.int64)
        run_to[order] = np.cumsum(run_size[order]) - run_size[order]
        stretch = np.flatnonzero(np.append(True, ~agree[1:]))
        own = owner[text_of[suffix]]
        smallest = np.minimum.reduceat(own, stretch)
        several = smallest != np.maximum.reduceat(own, stretch)
        kept = several | np.append(False, several[:-1])
        kept[0] = True
        return cls(run_start, run_to, suffix[run_start], suffix[run_start + run_size - 1], stretch[kept], np.where(several, smallest, -1)[kept])

    def step(self, row: np.ndarray) -> np.ndarray:
        run = np.searchsorted(self.run_start, row, side="right") - 1
        return self.run_to[run] + row - self.run_start[run]

    def stream(self, sizes: np.ndarray, owner: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pairs (texts, places): where a match of LENGTH bytes with a smaller owner begins. The indexed texts stream
        from their terminators back to their first bytes."""
        found = []
        text, row = np.arange(sizes.size), np.arange(sizes.size)
        at = sizes.copy()
        while True:
            live = at > 0
            if not live.all():
                text, row, at = text[live], row[live], at[live]
            if not text.size:
                return found
            row, at = self.step(row), at - 1
            smallest = self.row_owner[np.searchsorted(self.row_start, row, side="right") - 1]
            hit = (smallest >= 0) & (smallest < owner[text])
            if hit.any():
                found.append((text[hit], at[hit]))


def _suffix_array(symbol: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array (suffixes end at their terminator; terminators order by place), and for each row whether it agrees
    with the row above in LENGTH bytes."""
    n = symbol.size
    key = np.zeros(n, np.int64)
    for i in range(7):  # nine bits each
        key <<= 9
        key[: n - i] |= np.where(rest[: n - i] >= i, symbol[i:], 0)
    depth = 7
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    ended = rest < depth
    new = np.append(True, (key[order][1:] != key[order][:-1]) | ended[order][1:])
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    half = None
    while True:
        if depth == 28:
            half = rank.copy()
        alone = np.append(new[1:], True) & new
        open_rows = np.flatnonzero(~alone)
        if depth >= LENGTH and not open_rows.size:
            break
        if not open_rows.size:  # all differ: no window repeats
            return order, np.zeros(n, bool)
        some = order[open_rows]
        beyond = rank[np.minimum(some + depth, n - 1)]  # not ended, so inside the text or at its terminator
        again = np.lexsort((beyond, rank[some]))
        some, beyond = some[again], beyond[again]
        order[open_rows] = some
        group = rank[some]
        depth *= 2
        fresh = np.append(True, (group[1:] != group[:-1]) | (beyond[1:] != beyond[:-1]) | (rest[some][1:] < depth))
        new[open_rows] = fresh
        rank[some] = open_rows[np.maximum.accumulate(np.where(fresh, np.arange(some.size), 0))]
    above, below = order[:-1], order[1:]
    whole = (rest[above] >= LENGTH) & (rest[below] >= LENGTH)
    shift = LENGTH - 28
    same = whole & (half[above] == half[below]) & (half[np.minimum(above + shift, n - 1)] == half[np.minimum(below + shift, n - 1)])
    return order, np.append(False, same)


def contested(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """Places of the segments whose anchor another segment of another document has: only these can share a window."""
    anchor = segments(texts)[3]  # one segment each
    order = np.argsort(anchor, kind="stable")
    first = np.flatnonzero(np.append(True, anchor[order][1:] != anchor[order][:-1]))
    own = docs[order]
    several = np.minimum.reduceat(own, first) != np.maximum.reduceat(own, first)
    return np.sort(order[np.repeat(several, np.diff(np.append(first, order.size)))])


def covered_places(texts: list[bytes], docs: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For distinct texts and the documents they stand for: (texts, places) of windows that a smaller document has."""
    owner = np.unique(docs, return_inverse=True)[1]
    if owner.size < 2 or owner.max() == 0:
        return []
    return RunLengthIndex.build(texts, owner).stream(np.array([len(x) for x in texts], np.int64), owner)


_SENT = "_route int, _batch int, _texts binary, _sizes binary, _which binary, _doc binary, _at binary, _done binary"
_MARKED = "_batch int, _marks binary"


def repeated_spans(docs: DataFrame, count: int) -> DataFrame:
    """_batch and _marks for ``docs`` (doc_id, text, _batch): packed (doc_id, first byte, end) of covered intervals."""
    routes = 1 << max(6, min(16, (2 * count - 1).bit_length()))
    sent, marked = arrow_schema(_SENT), arrow_schema(_MARKED)

    def raw(table: pa.Table) -> list[bytes]:
        return [(x or "").encode() for x in table.column("text").to_pylist()]

    def keys_of(table: pa.Table) -> list[np.ndarray]:
        texts = raw(table)
        doc, _, _, anchor = segments(texts)
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        return [np.unique(anchor[a:b] >> np.uint64(16)) << np.uint64(16) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]

    def rows_of(table: pa.Table, classes: np.ndarray) -> pa.Table:
        texts, ids = raw(table), table.column("doc_id").to_numpy()
        doc, at, windows, anchor = segments(texts)
        keys = np.unique(anchor >> np.uint64(16))
        held = classes[np.searchsorted(keys, anchor >> np.uint64(16))]
        whole, hot = (held > 1) & (held < HOT), held >= HOT
        parts = (doc[whole], at[whole], windows[whole], anchor[whole]), single_windows(texts, doc[hot], at[hot], windows[hot])
        doc, at, windows, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
        route = (mixed(anchor) % np.uint64(routes)).astype(np.int64)
        order = np.lexsort((ids[doc], route))
        batch = table.column("_batch")[0].as_py()
        out: dict[str, list] = {f.name: [] for f in sent}
        done = []
        doc, at, size, route = doc[order], at[order], windows[order] + LENGTH - 1, route[order]
        owners = ids[doc]
        cuts = np.flatnonzero(np.diff(route)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), route.size], strict=True):
            if a == b:
                continue
            known: dict[bytes, tuple[int, int]] = {}
            which, who, where = [], [], []
            for d, p, n, owner in zip(doc[a:b].tolist(), at[a:b].tolist(), size[a:b].tolist(), owners[a:b].tolist(), strict=True):
                text = texts[d][p : p + n]
                held = known.setdefault(text, (len(known), owner))
                if held[1] < owner:
                    done.append((owner, p, p + n))
                else:
                    which.append(held[0])
                    who.append(owner)
                    where.append(p)
            row = (int(route[a]), batch, b"".join(known), np.array([len(x) for x in known], np.int32).tobytes(), np.array(which, np.int32).tobytes(), np.array(who, np.int64).tobytes(), np.array(where, np.int64).tobytes(), b"")
            for k, v in zip(out, row, strict=True):
                out[k].append(v)
        if done:  # found already: passes through a group unchanged
            for k, v in zip(out, (batch % routes, batch, b"", b"", b"", b"", b"", np.array(done, np.int64).tobytes()), strict=True):
                out[k].append(v)
        return pa.table(out, schema=sent)

    def search(table: pa.Table) -> pa.Table:
        known: dict[bytes, int] = {}
        text_of, docs_of, places, batches, out_batch, out_marks = [], [], [], [], [], []
        for batch, data, sizes, which, who, where, done in zip(*(table.column(c).to_pylist() for c in ("_batch", "_texts", "_sizes", "_which", "_doc", "_at", "_done")), strict=True):
            if done:
                out_batch.append(batch)
                out_marks.append(done)
                continue
            ends = np.cumsum(np.frombuffer(sizes, np.int32), dtype=np.int64).tolist()
            local = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip([0, *ends], ends, strict=False)], np.int64)
            text_of.append(local[np.frombuffer(which, np.int32)])
            docs_of.append(np.frombuffer(who, np.int64))
            places.append(np.frombuffer(where, np.int64))
            batches.append(np.full(places[-1].size, batch))
        if text_of:
            text, doc, place, batch = (np.concatenate(x) for x in (text_of, docs_of, places, batches))
            texts = list(known)
            size = np.array([len(x) for x in texts], np.int64)
            smallest = np.full(len(texts), np.iinfo(np.int64).max)
            np.minimum.at(smallest, text, doc)
            marks = []
            later = doc > smallest[text]
            marks.append(np.stack([batch[later], doc[later], place[later], (place + size[text])[later]], axis=1))
            rivals = contested(texts, smallest)
            found = covered_places([texts[i] for i in rivals], smallest[rivals])
            if found:
                hit, at = (np.concatenate(x) for x in zip(*found, strict=True))
                hit = rivals[hit]
                order = np.lexsort((at, hit))
                hit, at = hit[order], at[order]
                first = np.append(True, (hit[1:] != hit[:-1]) | (at[1:] - at[:-1] > LENGTH))
                begin = at[first]
                finish = at[np.append(first[1:], True)] + LENGTH
                owner = hit[first]
                rows = np.flatnonzero(~later)
                rows = rows[np.argsort(text[rows], kind="stable")]
                low, high = np.searchsorted(text[rows], owner), np.searchsorted(text[rows], owner, side="right")
                each = np.repeat(np.arange(owner.size), high - low)
                row = rows[np.arange(each.size) - np.repeat(np.cumsum(high - low) - (high - low), high - low) + low[each]]
                marks.append(np.stack([batch[row], doc[row], place[row] + begin[each], place[row] + finish[each]], axis=1))
            every = np.concatenate(marks)
            every = every[np.argsort(every[:, 0], kind="stable")]
            cuts = np.flatnonzero(np.diff(every[:, 0])) + 1
            for part in np.split(every, cuts) if every.size else []:
                out_batch.append(int(part[0, 0]))
                out_marks.append(np.ascontiguousarray(part[:, 1:]).tobytes())
        return pa.table({"_batch": out_batch, "_marks": out_marks}, schema=marked)

    return with_classes(docs, classes_of(docs, count, keys_of), rows_of, _SENT).groupBy("_route").applyInArrow(search, _MARKED)


def _merged(ranges: np.ndarray) -> list[tuple[int, int]]:
    """Sorted intervals that overlap or touch, as one each."""
    out: list[tuple[int, int]] = []
    for a, b in ranges.tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept: the bytes that are left (not always whole characters)."""
    docs = keyed(df, id_col, text_col).withColumn("doc_id", F.coalesce("doc_id", F.lit(_LOWEST)))
    docs, count = batches_of(docs)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"
    to = arrow_schema(schema)

    def cut(table: pa.Table, marks: pa.Table) -> pa.Table:
        every = np.frombuffer(b"".join(marks.column("_marks").to_pylist()), np.int64).reshape(-1, 3)
        every = every[np.lexsort((every[:, 1], every[:, 0]))]
        out: dict[str, list] = {f.name: [] for f in to}
        ids = table.column("doc_id").to_pylist()
        low, high = (np.searchsorted(every[:, 0], ids, side=s).tolist() for s in ("left", "right"))
        for doc_id, text, a, b in zip(ids, table.column("text").to_pylist(), low, high, strict=True):
            data = (text or "").encode()
            spans = [(x, min(y, len(data))) for x, y in _merged(every[a:b, 1:])] if b > a else []
            spans = [s for s in spans if s[0] < s[1]]
            kept = b"".join(data[x:y] for x, y in zip([0, *[s[1] for s in spans]], [*[s[0] for s in spans], len(data)], strict=True)) if spans else data
            for k, v in zip(out, (None if doc_id == _LOWEST else doc_id, len(data), len(data) - len(kept), len(spans), kept), strict=True):
                out[k].append(v)
        return pa.table(out, schema=to)

    return docs.groupBy("_batch").cogroup(repeated_spans(docs, count).groupBy("_batch")).applyInArrow(cut, schema)
