"""Texts as the token ids of a byte-level BPE vocabulary.

Two tiers. A minimal perfect hash over the vocabulary resolves every pre-token that is a token itself: a lookup computes one place and
compares one entry. Pre-tokens that are none go through the merges: a heap of adjacent pairs by rank over a linked list of bytes,
n log n in the length, so that megabytes without a blank are no trouble. Distinct pre-tokens of a batch are resolved once, and remembered
between batches.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the rank file is looked for; a parameter of every function here.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that splits text before the merges of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points that are letters or numbers only in editions of Unicode after the tokenizer's; to its pattern they are neither.
LATER = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6),
    (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6),
    (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4),
    (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F),
)
#: The largest rank file that is sent to the workers; vocabularies have a fixed size of about a megabyte.
MOST_BYTES = 64 << 20
#: Pre-tokens remembered by a worker.
REMEMBERED = 1 << 19


class PerfectHash:
    """A minimal perfect hash of a fixed set of byte strings: levels of bit arrays, in each of which the keys without a collision
    stay and the others go on; a key's number is the rank of its bit."""

    GAMMA = 2.0

    def __init__(self, keys: list[bytes]):
        h = self._hash(keys)
        if len(np.unique(h)) != len(h):
            raise ValueError("keys repeat")
        self.size, self.levels = len(keys), []
        rest, rank = h, 0
        while len(rest):
            m = max(64, int(self.GAMMA * len(rest)))
            at = self._place(rest, len(self.levels), m)
            alone = np.bincount(at, minlength=m) == 1
            self.levels.append((alone, np.cumsum(alone) - 1 + rank))
            rank += int(alone.sum())
            rest = rest[~alone[at]]
        self.number = self.lookup(h)

    @staticmethod
    def _hash(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    @staticmethod
    def _place(h: np.ndarray, level: int, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            z = h + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
            z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            z ^= z >> np.uint64(31)
        return (z % np.uint64(m)).astype(np.int64)

    def lookup(self, h: np.ndarray) -> np.ndarray:
        """The numbers of hashed keys; for others any number or -1."""
        out, open_ = np.full(len(h), -1), np.arange(len(h))
        for level, (bits, rank) in enumerate(self.levels):
            if not len(open_):
                break
            at = self._place(h[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = rank[at[hit]]
            open_ = open_[~hit]
        return out

    def numbers(self, keys: list[bytes]) -> np.ndarray:
        return self.lookup(self._hash(keys))


class Encoder:
    def __init__(self, ranks: bytes, pattern: str = PATTERN):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        keys = list(self.ranks)
        self.table = PerfectHash(keys)
        self.token, self.id = [b""] * len(keys), np.empty(len(keys), np.int64)
        for k, n in zip(keys, self.table.number.tolist(), strict=True):
            self.token[n], self.id[n] = k, self.ranks[k]
        later = "".join(f"{chr(a)}-{chr(b)}" for a, b in LATER)
        self.plain, self.unlike = regex.compile(pattern), regex.compile(f"[{later}]")
        self.careful = regex.compile("(?V1)" + pattern.replace(r"[^\s\p{L}\p{N}]", f"[^\\s[\\p{{L}}\\p{{N}}--[{later}]]]").replace(r" ?\p{L}", f" ?[\\p{{L}}--[{later}]]").replace(r" ?\p{N}", f" ?[\\p{{N}}--[{later}]]"))
        self.known: dict[str, tuple[int, ...]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges, lowest rank first and of equal ranks the leftmost, over a linked list."""
        n, ranks = len(piece), self.ranks
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j], end[i], nxt[i] = False, stop, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (p := prv[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Resolve pre-tokens that are not remembered."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        numbers = self.table.numbers(raw).tolist() if raw else []
        token, ids = self.token, self.id
        for p, b, n in zip(pieces, raw, numbers, strict=True):
            self.known[p] = (int(ids[n]),) if n >= 0 and token[n] == b else tuple(self.merge(b))

    def split(self, text: str) -> list[str]:
        return (self.careful if self.unlike.search(text) else self.plain).findall(text)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.split(t) if t else [] for t in texts]
        new = set().union(*split) if split else set()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
        self.learn([p for p in new if p not in self.known])
        known = self.known
        return [[i for p in pieces for i in known[p]] for pieces in split]


_encoders: dict[int, Encoder] = {}


def encoder_of(ranks: bytes) -> Encoder:
    key = xxhash.xxh3_64_intdigest(ranks)
    if key not in _encoders:
        _encoders[key] = Encoder(ranks)
    return _encoders[key]


def encode(documents: DataFrame, row_id: str, text: str, ranks_path: str = RANKS) -> DataFrame:
    """(``row_id``, ids) of each row, in whole texts and without special tokens: strings that look like those are ordinary text.

    A null and an empty text give an empty list. Repeated rows come out as often. Empty input gives an empty result; other columns are ignored.
    The rank file is read on the driver and sent along; it is refused beyond ``MOST_BYTES``.
    """
    if os.path.getsize(ranks_path) > MOST_BYTES:
        raise ValueError(f"{ranks_path} is larger than {MOST_BYTES} bytes")
    with open(ranks_path, "rb") as f:
        ranks = documents.sparkSession.sparkContext.broadcast(f.read())
    kind = documents.schema[row_id].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder_of(ranks.value)
        for b in batches:
            ids, texts = b.column("row_id"), b.column("text")
            ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(texts):  # a few megabytes at a time
                end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 4_000_000)))
                out = e.encode(texts.slice(at, end - at).to_pylist())
                yield pa.RecordBatch.from_pydict({"row_id": ids.slice(at, end - at), "ids": pa.array(out, pa.list_(pa.int32()))})
                at = end

    rows = documents.select(F.col(row_id).alias("row_id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(kernel, f"row_id {kind}, ids array<int>").withColumnRenamed("row_id", row_id)
