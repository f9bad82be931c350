"""Token counts by heap-and-linked-list byte-pair merging.

A text is cut into pre-tokens; the bytes of a pre-token form a doubly linked list, and a heap holds its adjacent
pairs by merge rank. Popping the lowest rank (leftmost on ties) joins two nodes and pushes the two new neighbour
pairs. The count is the number of initial bytes minus the number of merges; token identifiers are never written.

The work is one pass over the scan without any shuffle. Each Python worker remembers the counts of the
whitespace-delimited units it has met in a dictionary of bounded size, so frequent words are merged once.
"""

from __future__ import annotations

import functools
import heapq
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: the pre-token pattern of the byte-level vocabulary
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

SPACE_AFTER_SPACE = re.compile(r"\s ")
UNITS = regex.compile(r"\s*\S+|\s+")
CACHED_UNITS = 800_000
SINGLE = frozenset(".,;:!?")  # one byte and one token when it ends a word


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies use for each of the 256 bytes."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    shifted = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    return [chr(shifted.get(b, b)) for b in range(256)]


class HeapMerger:
    """Counts tokens of single strings under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.first = [vocab[c] for c in byte_symbols()]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.rank.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.made.append(vocab[left + right])
        self.start = [-1] * 65536  # merge rank of two adjacent bytes
        for a in range(256):
            for b in range(256):
                self.start[a << 8 | b] = self.rank.get(self.first[a] << 20 | self.first[b], -1)
        self.special = [t["content"] for t in spec.get("added_tokens", ()) if t["special"]]
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pieces = regex.compile(PRE_TOKENS)
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> int:
        """Number of tokens of one pre-token: its bytes minus the merges the heap allows."""
        n = len(data)
        if n < 2:
            return n
        start = self.start
        heap = [r << 32 | i for i, (a, b) in enumerate(zip(data, data[1:], strict=False)) if (r := start[a << 8 | b]) >= 0]
        if not heap:
            return n
        heapq.heapify(heap)
        rank, made, first = self.rank.get, self.made, self.first
        symbol = [first[b] for b in data]
        after, before, count = list(range(1, n + 1)), list(range(-1, n - 1)), n
        pop, push = heapq.heappop, heapq.heappush
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            if symbol[i] < 0 or j >= n or rank(symbol[i] << 20 | symbol[j]) != r:
                continue  # one of the two nodes has been merged since
            symbol[i], symbol[j] = made[r], -1
            count -= 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := rank(symbol[i] << 20 | symbol[k])) is not None:
                    push(heap, x << 32 | i)
            if (h := before[i]) >= 0 and (x := rank(symbol[h] << 20 | symbol[i])) is not None:
                push(heap, x << 32 | h)
        return count

    def plain(self, text: str) -> int:
        known, total = self.known, 0
        for piece in self.pieces.findall(text):
            n = known.get(piece)
            if n is None:
                n = self.merged(piece.encode())
                if len(piece) <= 64:
                    if len(known) >= CACHED_UNITS // 8:
                        known.clear()
                    known[piece] = n
            total += n
        return total

    def exact(self, text: str) -> int:
        """Token count of any string; a special string in it is one token, as the library's default has it."""
        if any(s in text for s in self.special):
            return len(self.marks.findall(text)) + sum(map(self.plain, self.marks.split(text)))
        return self.plain(text)


class UnitCache(dict):
    """Token counts of whitespace-delimited units; grows on demand and starts anew when it is full.

    No pre-token holds white space after another character, so a text may be cut before any space
    that follows a non-space, and the parts be handled one by one.
    """

    def __init__(self, merger: HeapMerger, limit: int = CACHED_UNITS):
        super().__init__()
        self.merger, self.limit = merger, limit

    def __missing__(self, unit: str) -> int:
        if unit.isalpha():
            n = self.merger.merged(b" " + unit.encode())
        elif unit[-1:] in SINGLE and unit[:-1].isalpha():
            return self[unit[:-1]] + 1
        else:
            n = self.merger.exact(" " + unit)
        if len(unit) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[unit] = n
        return n

    def parts(self, units: list[str]) -> int:
        """Tokens of units that each follow a space."""
        found = list(map(self.get, units))
        if None in found:
            found = [self[u] if n is None else n for u, n in zip(units, found, strict=True)]
        return sum(found)

    def count(self, text: str) -> int:
        if SPACE_AFTER_SPACE.search(text):
            return sum(self[u[1:]] if u[0] == " " else self.merger.exact(u) for u in UNITS.findall(text))
        head, *rest = text.split(" ")
        n = self.merger.exact(head)
        if rest and not rest[-1]:
            rest.pop()
            n += self.merger.exact(" ")
        return n + self.parts(rest)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> UnitCache:
    return UnitCache(HeapMerger(path))


def count_tokens(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows and ids stay separate rows, null ids stay null.
    Other columns are not read, whatever their names. ``vocabulary`` is a file of the public_tokenizers package.
    Texts of any length are handled whole; a single pre-token of n bytes takes O(n log n) time and O(n) memory.
    """

    def run(batches):
        import public_tokenizers

        cache = counter(public_tokenizers.path(vocabulary))
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = [cache.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)
