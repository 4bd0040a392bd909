"""Token counts of byte-pair encodings: a heap of adjacent pairs over a linked list of symbols, no identifiers.

A text is cut at special strings and then into chunks by the vocabulary's pattern. In a chunk, the adjacent pair of the lowest rank
(leftmost on ties) is merged until no known pair is left; the chunk's count is its bytes minus its merges. Chunks repeat, so a worker
remembers up to ``MEMORY`` of them and starts afresh beyond that; the memory changes speed, never a count.
"""

from __future__ import annotations

import heapq
import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNKS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of the vocabulary
LIMIT = 512
MEMORY = 800_000


def byte_signs() -> dict[str, int]:
    """The printable sign that the vocabulary file writes for each byte: itself where it shows, else the next free one from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    signs = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        signs[chr(256 + k)] = b
    return signs


@dataclass
class Merges:
    """Ranked pairs of symbols and the special strings of a vocabulary file. Symbols are numbered within this process only."""

    ranks: dict[int, int]
    made: list[int]
    special: list[str]

    @classmethod
    def load(cls, raw: str) -> Merges:
        spec, signs = json.loads(raw), byte_signs()
        symbols = {s: b for s, b in signs.items()}  # the 256 bytes come first, so a byte is its own number
        ranks, made = {}, []
        for i, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ranks[symbols[a] << 32 | symbols[b]] = i
            made.append(symbols.setdefault(a + b, len(symbols)))
        return cls(ranks, made, [t["content"] for t in spec["added_tokens"]])

    def tokens(self, chunk: bytes) -> int:
        """Symbols left after all merges of one chunk."""
        n = len(chunk)
        known, made, pop, push = self.ranks.get, self.made, heapq.heappop, heapq.heappush
        part = list(chunk)
        heap = [r << 32 | i for i in range(n - 1) if (r := known(part[i] << 32 | part[i + 1])) is not None]
        heapq.heapify(heap)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        merged = 0
        while heap:
            top = pop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            # a pair that has changed since it was pushed has another rank or none; a swallowed symbol is -1
            if part[i] < 0 or j >= n or known(part[i] << 32 | part[j]) != rank:
                continue
            whole = part[i] = made[rank]
            part[j] = -1
            k = after[i] = after[j]
            merged += 1
            if k < n:
                before[k] = i
                if (r := known(whole << 32 | part[k])) is not None:
                    push(heap, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := known(part[h] << 32 | whole)) is not None:
                push(heap, r << 32 | h)
        return n - merged


class Counter(dict):
    """Token count by chunk, filled on demand."""

    def __init__(self, merges: Merges, pattern: str = CHUNKS):
        import regex
        self.merges = merges
        self.chunks = regex.compile(pattern).findall
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(merges.special, key=len, reverse=True))).split if merges.special else None

    def __missing__(self, chunk: str) -> int:
        n = self.merges.tokens(chunk.encode())
        if len(self) >= MEMORY:
            self.clear()
        if len(chunk) <= 64:
            self[chunk] = n
        return n

    def count(self, text: str) -> int:
        if self.cut is not None and any(s in text for s in self.merges.special):
            parts = self.cut(text)
            return len(parts) - 1 + sum(sum(map(self.__getitem__, self.chunks(p))) for p in parts)
        return sum(map(self.__getitem__, self.chunks(text)))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    ``vocabulary`` is the path of a byte-level pair vocabulary as JSON; the driver reads it and the tasks get it by broadcast (a
    vocabulary has a fixed size). Special strings inside a text count as one token each. A null text counts as empty: 0 bytes, 0
    tokens. Rows with null ids and repeated rows come out as they are, an empty table gives no rows, other columns are not read.
    """
    with open(vocabulary, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    ready = []

    def task(batches):
        if not ready:
            ready.append(Counter(Merges.load(shared.value)))
        counter = ready[0]
        for batch in batches:
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 256):
                part = texts.slice(at, 256)
                n = np.fromiter((counter.count(t.as_py()) if t.is_valid else 0 for t in part), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), batch.column(2).slice(at, 256), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    text = F.col(text_col).cast("string")
    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"))
            .mapInArrow(task, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit))
