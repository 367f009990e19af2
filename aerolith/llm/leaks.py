"""Evaluation items that leak into training texts.

Texts are compared as strings of letters and digits alone: without case, accents, punctuation, markup and its escapes, blanks, line breaks and invisible characters. So a word
that a text splits or glues to the next is no obstacle, neither here nor in the verification.

The terms of such a string are shingles of ``Q`` characters at places that the string itself chooses (winnowing: the least hash of every ``W`` successive ones), so two strings that
share ``Q + W - 1`` characters share a term, wherever it stands in them. An item's parts (passage, question) are the units of an inverted index: per term a list of postings (unit, BM25 weight) in
order of units, with the greatest weight of each block of ``BLOCK`` postings. A unit's threshold is the least weight that any of its windows of ``SHARED`` successive words is sure to have by
its own terms, so a passage of a text that holds such a window reaches it: retrieving all units at or above their thresholds loses nothing. Weights are divided by the thresholds, so every unit is due at 1.

Every text is cut into overlapping passages, each passage is a query, and block-max WAND finds the units due: cursors in order of their units, a pivot where the greatest weights add up to 1, the
block's greatest weights before any posting is scored, skips over the rest. Retrieved pairs are verified: one of the unit's windows must stand in the text. Whether
the item's answer stands there too is told of each leak.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that an item and a text must share in a row.
SHARED = 10
#: Characters in a shingle, and shingles of which the least is a term (a power of two).
Q, W = 10, 8
#: Characters from one passage of a text to the next; a passage is longer by the longest window.
STEP = 1024
#: Postings in a block of the index.
BLOCK = 64
#: Characters of items in one index (some 30 000 items), which every worker holds in about 100 MB; of more items several indexes are made, each with its own pass over the texts.
INDEX_CHARS = 16_000_000
K1, B = 1.2, 0.75

_TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.DOTALL)
_IGNORED = regex.compile(r"[\p{M}\p{Cf}]+")
_WORD = regex.compile(r"[\p{L}\p{N}]+")
_NO_WORD = re.compile(r"[\W_]+")
_ASCII = {i: None for i in range(128) if not chr(i).isalnum()}


def _plain(text: str) -> str:
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "\\" in text:
        text = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m[1], 16)), text)
        text = re.sub(r"\\[nrt]", " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = text.casefold()
    if not text.isascii():
        text = _IGNORED.sub("", unicodedata.normalize("NFKD", text).replace("œ", "oe").replace("æ", "ae").replace("ø", "o").replace("ł", "l"))
    return text


def words(text: str | None) -> list[str]:
    """The words of a text, without regard to case, accents, punctuation, markup and its escapes, blanks and invisible characters."""
    return _WORD.findall(_plain(text)) if text else []


def joined(text: str | None) -> str:
    """The words of a text with nothing between them."""
    if not text:
        return ""
    text = _plain(text)
    return text.translate(_ASCII) if text.isascii() else _NO_WORD.sub("", text)


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def shingles(c: np.ndarray, q: int) -> np.ndarray:
    """A hash of each ``q`` successive characters."""
    n = len(c) - q + 1
    if n < 1:
        return np.empty(0, np.uint64)
    c = c.astype(np.uint64)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for i in range(q):
            h *= np.uint64(0x9E3779B97F4A7C15)
            h += c[i : i + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h


def _slide(f: np.ufunc, x: np.ndarray, w: int) -> np.ndarray:
    """``f`` over each ``w`` (a power of two) successive values."""
    k = 1
    while k < w:
        x = f(x[:-k], x[k:])
        k *= 2
    return x


def least(h: np.ndarray) -> np.ndarray:
    """The least of each ``W`` successive hashes; what a string of at least ``Q + W - 1`` characters is sure to have among its terms."""
    return _slide(np.minimum, h, W) if len(h) >= W else np.empty(0, np.uint64)


def chosen(h: np.ndarray) -> np.ndarray:
    """Places of the hashes that are the least of some ``W`` successive ones."""
    m = least(h)
    if not len(m):
        return np.empty(0, np.int64)
    pad = np.zeros(W - 1, np.uint64)
    return np.flatnonzero(h == _slide(np.maximum, np.concatenate([pad, m, pad]), W))


@dataclass
class Unit:
    """A part (0, 1, ...) of an item, as its words."""

    item: object
    words: list[str]
    part: int = 0


class Index:
    """Postings with BM25 weights, divided by each unit's threshold, in blocks with their greatest weights."""

    def __init__(self, units: list[Unit], answers: dict[object, str] | None = None, shared: int = SHARED):
        units = [u for u in units if len(u.words) >= shared]
        self.items, self.parts = [u.item for u in units], [u.part for u in units]
        self.shared, self.answers = shared, answers or {}
        self.texts = ["".join(u.words) for u in units]
        self.borders = [np.cumsum([0] + [len(w) for w in u.words]).astype(np.int32) for u in units]
        n = len(units)
        self.longest = max([int((b[shared:] - b[:-shared]).max()) for b in self.borders], default=0)
        minima = [least(shingles(codes(t), Q)) for t in self.texts]
        pairs = [np.unique(m, return_counts=True) for m in minima]
        every = np.concatenate([p[0] for p in pairs]) if pairs else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(n, dtype=np.int32), [len(p[0]) for p in pairs])
        tf = np.concatenate([p[1] for p in pairs]).astype(float) if pairs else np.empty(0)
        self.terms, term = np.unique(every, return_inverse=True)
        df = np.bincount(term, minlength=len(self.terms))
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        size = np.array([len(t) for t in self.texts], float)
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[owner] / max(size.mean() if n else 1, 1)))
        # Thresholds: the least that any window is sure to have; windows too short to be sure of a term are looked up whole.
        starts = np.cumsum([0] + [len(p[0]) for p in pairs])
        self.short: dict[int, dict[int, list[int]]] = {}
        for j, (m, b) in enumerate(zip(minima, self.borders, strict=True)):
            own, w = pairs[j][0], weight[starts[j] : starts[j + 1]]
            at = np.searchsorted(own, m) if len(own) else np.empty(0, int)
            due = np.inf
            for a, e in zip(b[:-shared], b[shared:], strict=True):
                if e - a < Q + W - 1:
                    for h in shingles(codes(self.texts[j][a:e]), int(e - a)):
                        self.short.setdefault(int(e - a), {}).setdefault(int(h), []).append(j)
                else:
                    due = min(due, float(w[np.unique(at[a : e - Q - W + 2])].sum()))
            weight[starts[j] : starts[j + 1]] /= due * (1 - 1e-6)
        order = np.lexsort((owner, term))
        self.unit, self.weight = owner[order], weight[order].astype(np.float32)
        self.start = np.searchsorted(term[order], np.arange(len(self.terms) + 1))
        self.most = np.maximum.reduceat(self.weight, self.start[:-1]) if len(self.terms) else np.empty(0, np.float32)
        # Blocks: BLOCK postings of one term; block_start[t] is the term's first block.
        count = -(-np.diff(self.start) // BLOCK)
        self.block_start = np.concatenate([[0], np.cumsum(count)])
        block_at = np.repeat(self.start[:-1], count) + BLOCK * (np.arange(count.sum()) - np.repeat(self.block_start[:-1], count))
        self.block_most = np.maximum.reduceat(self.weight, block_at) if len(block_at) else np.empty(0, np.float32)
        # A table of bits tells most shingles that are no terms.
        self.bits = np.zeros(1 << max(16, int(np.ceil(np.log2(16 * max(len(self.terms), 1))))), bool)
        self.bits[(self.terms & np.uint64(len(self.bits) - 1)).astype(np.int64)] = True

    def due(self, terms: np.ndarray) -> list[int]:
        """Units whose weights for the terms (distinct) add up to 1: block-max WAND."""
        start, unit, weight, most, found = self.start, self.unit, self.weight, self.most, []
        # A cursor: [unit, place in the postings, term]
        cursors = [[int(unit[start[t]]), int(start[t]), int(t)] for t in terms.tolist()]
        while True:
            cursors.sort()
            bound, p = 0.0, -1
            for i, c in enumerate(cursors):
                bound += float(most[c[2]])
                if bound >= 1:
                    p = i
                    break
            if p < 0:
                return found
            pivot = cursors[p][0]
            while p + 1 < len(cursors) and cursors[p + 1][0] == pivot:
                p += 1
            # The blocks in which the cursors up to the pivot would find it.
            bound, ends = 0.0, len(self.items)
            for c in cursors[: p + 1]:
                t = c[2]
                at = c[1] if c[0] == pivot else c[1] + int(unit[c[1] : start[t + 1]].searchsorted(pivot))
                if at < start[t + 1]:
                    block = (at - int(start[t])) // BLOCK
                    bound += float(self.block_most[self.block_start[t] + block])
                    last = min(int(start[t]) + (block + 1) * BLOCK, int(start[t + 1])) - 1
                    ends = min(ends, int(unit[last]))
            if bound < 1:  # nothing up to the end of the nearest block, or the next cursor, can be due
                ahead = max(min(ends + 1, cursors[p + 1][0] if p + 1 < len(cursors) else len(self.items)), pivot + 1)
                moved = cursors[: p + 1]
            elif cursors[0][0] == pivot:
                if sum(float(weight[c[1]]) for c in cursors[: p + 1]) >= 1:
                    found.append(pivot)
                ahead, moved = pivot + 1, cursors[: p + 1]
            else:
                ahead, moved = pivot, [c for c in cursors[:p] if c[0] < pivot]
            for c in moved:
                end = int(start[c[2] + 1])
                c[1] += int(unit[c[1] : end].searchsorted(ahead))
                c[0] = int(unit[c[1]]) if c[1] < end else -1
            cursors = [c for c in cursors if c[0] >= 0]

    def retrieve(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text, unit) of every unit that some passage of the text (as ``joined`` makes it) scores at or above its threshold."""
        if not self.items or not texts:
            return []
        c = codes("\0".join(texts))
        begin = np.cumsum([0] + [len(t) + 1 for t in texts])
        h = shingles(c, Q)
        at = chosen(h)
        at = at[self.bits[(h[at] & np.uint64(len(self.bits) - 1)).astype(np.int64)]]
        term = np.minimum(np.searchsorted(self.terms, h[at]), max(len(self.terms) - 1, 0))
        hit = self.terms[term] == h[at] if len(self.terms) else np.zeros(len(at), bool)
        at, term = at[hit], term[hit]
        owner = np.searchsorted(begin, at, "right") - 1
        place = at - begin[owner]
        pairs = []
        for back in range(1 + -(-max(self.longest, 1) // STEP)):  # a term stands in the passage that begins before it, and in those that reach it
            p = place // STEP - back
            ok = (p >= 0) & (place < p * STEP + STEP + self.longest)
            pairs.append(np.stack([owner[ok], p[ok], term[ok]]))
        found = set()
        if pairs and sum(p.shape[1] for p in pairs):
            o, p, t = np.concatenate(pairs, axis=1)
            key = np.unique(np.stack([o, p, t], axis=1), axis=0)
            first = np.flatnonzero(np.r_[True, (key[1:, :2] != key[:-1, :2]).any(1)])
            reach = np.add.reduceat(self.most[key[:, 2]], first) >= 1
            for a, b in zip(first[reach], np.r_[first[1:], len(key)][reach], strict=True):
                found.update((int(key[a, 0]), u) for u in self.due(key[a:b, 2]))
        for length, known in self.short.items():
            g = shingles(c, length)
            for i in np.flatnonzero(np.isin(g, np.fromiter(known, np.uint64, len(known)))).tolist():
                found.update((int(np.searchsorted(begin, i, "right")) - 1, u) for u in known[int(g[i])])
        return sorted(found)

    def holds(self, text: str, unit: int) -> bool:
        """One of the unit's windows stands in the text."""
        s, b = self.texts[unit], self.borders[unit]
        return any(s[a:e] in text for a, e in zip(b[: -self.shared].tolist(), b[self.shared :].tolist(), strict=True))

    def leaks(self, texts: list[str]) -> list[tuple[int, object, int, bool]]:
        """(text, item, parts as bits, whether the answer stands in the text too), verified, each text and item once."""
        found: dict[tuple[int, object], int] = {}
        for i, j in self.retrieve(texts):
            if self.holds(texts[i], j):
                found[i, self.items[j]] = found.get((i, self.items[j]), 0) | 1 << self.parts[j]
        return [(i, item, bits, bool(a := self.answers.get(item)) and a in texts[i]) for (i, item), bits in found.items()]


def find_leaks(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, parts: tuple[str, ...], answer: str | None = None) -> DataFrame:
    """(``item_id``, ``doc_id``, ``parts``, ``answered``) of each item and document that share ``SHARED`` successive words of one of the item's parts, once.

    ``parts`` names those that leak; ``answered`` tells whether the words of ``answer`` stand in the document too (false without one). Null and empty texts and parts, and parts of fewer words, make no case. Of
    repeated rows of one item or document all count, as one. Texts are searched whole. Items come to the driver, in sets of at most ``INDEX_CHARS`` characters or so; their number is the number of
    evaluation items, not of documents.
    """
    d = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t")).where("d is not null and t is not null")
    kind = {"i": items.schema[item_id].dataType.simpleString(), "d": documents.schema[doc_id].dataType.simpleString()}
    last = F.col(answer).cast("string").alias("a") if answer else F.lit(None).cast("string").alias("a")
    e = items.select(F.col(item_id).alias("i"), *[F.col(p).cast("string").alias(f"p{k}") for k, p in enumerate(parts)], last).where("i is not null")
    size = e.select(F.sum(sum((F.coalesce(F.length(f"p{k}"), F.lit(0)) for k in range(len(parts))), F.lit(0))).alias("n")).first()["n"] or 0
    sets = max(1, -(-size // INDEX_CHARS))
    out = None
    for s in range(sets):
        rows = (e.where(F.pmod(F.xxhash64("i"), F.lit(sets)) == s) if sets > 1 else e).collect()
        index = Index([Unit(r["i"], words(r[f"p{k}"]), k) for r in rows for k in range(len(parts))], {r["i"]: joined(r["a"]) for r in rows})

        def kernel(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, 1000):
                    ids = b.column("d").slice(at, 1000)
                    found = index.leaks([joined(t) for t in b.column("t").slice(at, 1000).to_pylist()])
                    if found:
                        k, item, bits, answered = zip(*found, strict=True)
                        yield pa.RecordBatch.from_pydict({"i": pa.array(item), "d": ids.take(pa.array(k)), "parts": pa.array(bits, pa.int32()), "answered": pa.array(answered)})

        one = d.mapInArrow(kernel, f"i {kind['i']}, d {kind['d']}, parts int, answered boolean")
        out = one if out is None else out.unionByName(one)
    out = out.groupBy("i", "d").agg(F.bit_or("parts").alias("parts"), F.bool_or("answered").alias("answered"))
    named = F.array_compact(F.array(*[F.when(F.col("parts").bitwiseAND(1 << k) != 0, F.lit(p)) for k, p in enumerate(parts)]))
    return out.select(F.col("i").alias(item_id), F.col("d").alias(doc_id), named.alias("parts"), "answered")
