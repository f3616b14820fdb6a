"""Token counts and token ids with a public tokenizer, in Arrow batches.

Texts are cut into chunks at borders that the pre-tokenizer cuts at anyway (see ``common.safe_chunks``). Chunks repeat
a great deal, so each worker encodes only chunks it has not met, in encode_batch calls balanced by bytes, and looks the
others up. The cache is bounded by bytes and emptied when full, which changes speed only.

A byte-level vocabulary may come a second time as a file of ranks. Where both files agree in full (see ``same_merges``)
unseen chunks go through the ranks, which is several times as fast.

Cases: a null text counts as empty (0 bytes, 0 tokens); a very long text is walked in slices of ``SLICE`` characters; a
null doc_id stays null; repeated rows give repeated results; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import json
import os
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import keyed, map_arrow, safe_chunks, safe_slices, utf8_length

#: Bytes of unseen chunks in one encode_batch call, bytes a worker's cache may hold, longest chunk that is kept.
BATCH_BYTES = 256 << 10
CACHE_BYTES = 40 << 20
KEPT_CHUNK = 64
SLICE = 1 << 20

#: The pattern that byte-level tokenizer files split by. Fixed value.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def size_of(text: str) -> int:
    """Bytes of the text as UTF-8."""
    return len(text) if text.isascii() else len(text.encode())


def byte_letters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: a printable byte for itself, the others in order
    from U+0100 on."""
    out, following = {}, 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 255 and byte != 173:
            out[chr(byte)] = byte
        else:
            out[chr(following)] = byte
            following += 1
    return out


def ranks_of(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def same_merges(path: str, ranks: dict[bytes, int], pattern: str) -> bool:
    """Whether the tokenizer file is plain byte-level BPE with exactly these ids, these merges in the order of the ids
    and this pattern. Added tokens are left out: their strings are the library's to find."""
    spec = json.loads(Path(path).read_text("utf-8"))
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")) and not spec.get("normalizer")
    if not plain or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True) or pattern != BYTE_LEVEL_PATTERN:
        return False
    letters, added = byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
    raw = lambda token: bytes(letters[c] for c in token)
    if {raw(t): i for t, i in model["vocab"].items() if t not in added} != ranks:
        return False
    merged = [ranks[raw("".join(m if isinstance(m, list) else m.split(" ")))] for m in model["merges"]]
    return merged == sorted(set(merged)) and len(merged) + 256 == len(ranks)


class ChunkEncoder:
    """Encodes chunks with a tokenizer file; what it keeps for a chunk is its ids as little-endian uint32 bytes, or
    only their number if ``lengths_only``. ``ranks``: rank file and pattern of the same vocabulary, if there is one."""

    _own: dict[tuple, ChunkEncoder] = {}

    def __init__(self, path: str, lengths_only: bool, ranks: tuple[str, str] | None = None):
        self.path, self.lengths_only = path, lengths_only
        self.known: dict[str, bytes | int] = {}
        self.held = 0
        self._tokenizer = None
        self.quick: Callable[[str], list[int]] | None = None
        self.added: list[str] = []
        if ranks:
            own = ranks_of(ranks[0])
            if same_merges(path, own, ranks[1]):
                import tiktoken

                self.quick = tiktoken.Encoding("ranks", pat_str=ranks[1], mergeable_ranks=own, special_tokens={}).encode_ordinary
                self.added = [x["content"] for x in json.loads(Path(path).read_text("utf-8")).get("added_tokens", [])]

    @property
    def tokenizer(self):
        """The library's tokenizer, loaded when first needed."""
        if self._tokenizer is None:
            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            self._tokenizer = Tokenizer.from_file(self.path)
            self._tokenizer.no_truncation()
            self._tokenizer.no_padding()
        return self._tokenizer

    @classmethod
    def of(cls, path: str, lengths_only: bool, ranks: tuple[str, str] | None = None) -> ChunkEncoder:
        """One encoder for each file and worker process: later tasks find its cache filled."""
        if (path, lengths_only, ranks) not in cls._own:
            cls._own[path, lengths_only, ranks] = cls(path, lengths_only, ranks)
        return cls._own[path, lengths_only, ranks]

    def _learn(self, chunks: list[str]) -> dict[str, bytes | int]:
        found: dict[str, bytes | int] = {}
        if quick := self.quick:
            rest = [c for c in chunks if any(a in c for a in self.added)]  # added tokens are the library's to find
            special = set(rest)
            for c in chunks:
                if c not in special:
                    ids = quick(c)
                    found[c] = len(ids) if self.lengths_only else array("I", ids).tobytes()
            chunks = rest
        at = 0
        while at < len(chunks):
            batch, size = [], 0
            while at < len(chunks) and (not batch or size < BATCH_BYTES):
                batch.append(chunks[at])
                size += size_of(chunks[at])
                at += 1
            for chunk, code in zip(batch, self.tokenizer.encode_batch(batch, add_special_tokens=False), strict=True):
                found[chunk] = len(code) if self.lengths_only else array("I", code.ids).tobytes()
        return found

    def values(self, texts: list[str]) -> Iterator[list]:
        """For each text the values of its chunks, in order."""
        split = [safe_chunks(x) for x in texts]
        known = self.known
        found = self._learn(list(set().union(*split).difference(known)))
        if self.held > CACHE_BYTES:
            for chunks in split:  # what this call still needs outlives the emptied cache
                found.update((c, known[c]) for c in chunks if c in known)
            known.clear()
            self.held = 0
        short = {c: v for c, v in found.items() if len(c) <= KEPT_CHUNK}
        known.update(short)
        self.held += sum(map(len, short)) + len(short) * (160 if self.lengths_only else 180)
        look, whole = known.__getitem__, len(short) == len(found)
        for chunks in split:
            yield list(map(look, chunks)) if whole else [known[c] if c in known else found[c] for c in chunks]


def by_bytes(texts: list[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes of UTF-8 each."""
    start = size = 0
    for i, text in enumerate(texts):
        size += size_of(text) if text else 0
        if size >= limit:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def counted(texts: list[str | None], encoder: ChunkEncoder) -> Iterator[int]:
    for start, end in by_bytes(texts):
        parts, owner = [], []
        for i in range(start, end):
            for part in safe_slices(texts[i] or "", SLICE):
                parts.append(part)
                owner.append(i - start)
        totals = [0] * (end - start)
        for i, values in zip(owner, encoder.values(parts), strict=True):
            totals[i] += sum(values)
        yield from totals


def encoded(texts: list[str | None], encoder: ChunkEncoder) -> Iterator[bytes]:
    """The ids of each text as little-endian uint32 bytes."""
    for start, end in by_bytes(texts):
        parts, owner = [], []
        for i in range(start, end):
            for part in safe_slices(texts[i] or "", SLICE):
                parts.append(part)
                owner.append(i - start)
        ids: list[list[bytes]] = [[] for _ in range(end - start)]
        for i, values in zip(owner, encoder.values(parts), strict=True):
            ids[i].append(b"".join(values))
        yield from (b"".join(x) for x in ids)


def token_counts(df: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every text, without added special tokens."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        encoder = ChunkEncoder.of(tokenizer_path, True)
        for batch in batches:
            yield {
                "doc_id": batch.column("doc_id"),
                "n_bytes": batch.column("n_bytes"),
                "n_tokens": list(counted(batch.column("text").to_pylist(), encoder)),
            }

    docs = keyed(df, id_col, text_col)
    return map_arrow(docs.withColumn("n_bytes", utf8_length(docs.text)), rows, "doc_id long, n_bytes long, n_tokens long")
