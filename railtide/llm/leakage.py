"""Evaluation texts leaking into training text: q-gram lemma filter in diagonal bands, verified by banded alignment.

Both sides are reduced to lower-case words with single blanks between them; markup commands, punctuation and line
breaks are set aside and comments stay. The passages, a set far smaller than the corpus, are indexed by the hashes of
their character q-grams. Each task slides over whole documents: a q-gram of the document that a passage shares is a hit
on a diagonal (document position - passage position). Hits are counted in overlapping bands of diagonals.

The bound is the q-gram lemma with whole words as edits, worked out for every passage: of all q-grams those are lost that
touch an exchanged word, and the bound is the least number left over all placements of the edit budget (``BUDGETS``: half
of the passage with every fourth word exchanged, all of it with every third). q-grams that other passages share too
tell little and cost much, so a passage is indexed by its rarest q-grams, as many as its bound needs to stay at ``BOUND``;
the bound is worked out on just these, so nothing is lost by it, and a passage whose q-grams are all common keeps all.

A passage whose few best bands hold fewer distinct q-grams than ``SLACK`` of its bound is dropped (the slack pays for the
q-grams that end at the borders of stretches). What is left is aligned word by word inside the bands (local alignment,
iterated), alignments are chained in passage order over the document's word positions, and a passage is reported if at
least half of its words are held, a single word exchanged between two matches being held too.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railtide.llm.texts import whole_words

Q = 12
BAND = 96
#: Fewest hits of a band, or the passage's bound where that is less.
BAND_HITS = 4
#: Edits that must not hide a passage: (every which word is exchanged, share of the passage that is there).
BUDGETS = ((4, 0.5), (3, 1.0))
#: A passage gets rarer q-grams left in its index until its bound is at least this.
BOUND = 12
#: Share of the bound that bands must hold; the rest may be lost where stretches begin and end.
SLACK = 0.7
#: Bands looked at per passage: both shifts of the best four stretches.
BEST_BANDS = 8
SHARE = 0.5
MIN_STRETCH = 5
WORD_BAND = 28
#: Passages are indexed in blocks of at most this many characters, one pass over the corpus each.
BLOCK_CHARS = 16_000_000

_COMMAND = re.compile(r"\\[A-Za-z@]+\*?")
_KEEP = bytes(c if (48 <= c <= 57 or 97 <= c <= 122 or c >= 128) else 32 for c in range(256))
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]


def normalize(text: str) -> bytes:
    """Lower-case words of a text as UTF-8, one blank between them."""
    text = whole_words(text)
    plain = _COMMAND.sub(" ", text) if "\\" in text else text
    return b" ".join(plain.lower().encode("utf-8", "replace").translate(_KEEP).split())


def gram_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of every q-gram of a normalized text."""
    n = len(text) - Q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw = np.frombuffer(text, np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[: len(raw) - 7].view(), (len(raw) - 7, 8), (1, 1))
    v = np.ascontiguousarray(words).view("<u8").ravel()
    h = v[:n] * _M[0]
    h ^= h >> np.uint64(31)
    h += v[Q - 8 : Q - 8 + n] * _M[1]
    h ^= h >> np.uint64(32)
    h *= _M[0]
    return h


def bound(words: list[bytes], usable: np.ndarray) -> int:
    """The least number of usable q-grams that any placement of the edit budgets leaves of a passage."""
    start = np.cumsum([0, *(len(w) + 1 for w in words)])
    least = len(usable)
    for every, share in BUDGETS:
        held = math.ceil(len(words) * share)
        first = np.arange(len(words) - held + 1)
        begin = start[first]
        end = np.maximum(begin, start[first + held] - Q)
        for phase in range(every):
            edited = np.zeros(start[-1], np.int64)
            for k in range(phase, len(words), every):
                edited[start[k] : start[k + 1] - 1] = 1
            upto = np.r_[0, edited.cumsum()]
            left = usable & (upto[Q : Q + len(usable)] == upto[: len(usable)])
            upto = np.r_[0, left.cumsum()]
            least = min(least, int((upto[np.minimum(end, len(usable))] - upto[np.minimum(begin, len(usable))]).min()))
    return least


@dataclass
class Index:
    """Postings of the usable q-grams: sorted hashes, their ranges, and (passage, position) of every occurrence.

    ``need`` is the number of distinct q-grams that a passage's best bands must hold."""

    ids: list[list[int]]
    words: list[list[bytes]]
    sizes: np.ndarray
    need: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    passage: np.ndarray
    position: np.ndarray

    def bitmap(self) -> np.ndarray:
        seen = np.zeros(1 << 22, bool)
        seen[(self.hashes >> np.uint64(42)).astype(np.int64)] = True
        return seen


def build_index(items: list[tuple[int, str | None]]) -> Index:
    """Index (item id, passage) pairs; equal passages are indexed once. Empty and null passages match nothing."""
    by: dict[bytes, list[int]] = {}
    for i, text in items:
        if (t := normalize(text or "")):
            by.setdefault(t, []).append(i)
    words, hashes = [t.split() for t in by], [gram_hashes(t) for t in by]
    known, spread = np.unique(np.concatenate([*(np.unique(h) for h in hashes), np.empty(0, np.uint64)]), return_counts=True)
    need, kept, owner, at = [], [], [], []
    for k, (ws, h) in enumerate(zip(words, hashes)):
        shared = spread[np.searchsorted(known, h)]
        limit, most = 1, shared.max(initial=1)
        while (least := bound(ws, shared <= limit)) < BOUND and limit < most:
            limit *= 2
        at.append(np.flatnonzero(shared <= limit).astype(np.int32))
        kept.append(h[at[-1]])
        owner.append(np.full(len(at[-1]), k, np.int32))
        need.append(max(1, int(SLACK * least)))
    h = np.concatenate([*kept, np.empty(0, np.uint64)])
    p, a = np.concatenate([*owner, np.empty(0, np.int32)]), np.concatenate([*at, np.empty(0, np.int32)])
    order = np.lexsort((a, p, h))
    h, p, a = h[order], p[order], a[order]
    uniq, starts = np.unique(h, return_index=True)
    return Index(list(by.values()), words, np.array([len(t) for t in by], np.int64), np.array(need, np.int64), uniq,
                 np.r_[starts, len(h)].astype(np.int64), p, a)


def _bands(index: Index, pos: np.ndarray, slot: np.ndarray) -> dict[int, list[int]]:
    """Passages that may be in the text, and the diagonals of their bands."""
    count = index.starts[slot + 1] - index.starts[slot]
    doc = np.repeat(pos, count)
    entry = np.repeat(index.starts[slot] - np.r_[0, count.cumsum()[:-1]], count) + np.arange(count.sum())
    item, at = index.passage[entry].astype(np.int64), index.position[entry].astype(np.int64)
    diagonal = doc - at + (1 << 20)
    bands: dict[int, list[np.ndarray]] = {}
    fewest = np.minimum(index.need, BAND_HITS)
    for shift in (0, BAND // 2):
        key = item * (1 << 40) + (diagonal + shift) // BAND
        order = np.argsort(key, kind="stable")
        k = key[order]
        edge = np.flatnonzero(np.r_[True, k[1:] != k[:-1], True])
        for x in np.flatnonzero(np.diff(edge) >= fewest[item[order[edge[:-1]]]]):
            rows = order[edge[x] : edge[x + 1]]
            bands.setdefault(int(item[rows[0]]), []).append(rows)
    found: dict[int, list[int]] = {}
    for i, kept in bands.items():
        best = sorted(kept, key=len, reverse=True)[:BEST_BANDS]
        if sum(map(len, best)) >= index.need[i] and len(np.unique(at[np.concatenate(best)])) >= index.need[i]:
            found[i] = [int(np.sort(doc[r] - at[r])[len(r) // 2]) for r in best]
    return found


def align(passage: list[bytes], region: list[bytes], offset: int, band: int = WORD_BAND) -> list[tuple[int, int, int, int, int]]:
    """Local alignments (passage from, to, region from, to, words held) within a band around a diagonal, best first.

    A match counts 1, an exchanged, missing or added word -1. Words held are the matches and each single word exchanged
    between two of them. Found words are taken out and the search repeated, so stretches that stand apart come out one
    by one; a stretch needs at least MIN_STRETCH matches.
    """
    taken = [False] * len(passage)
    out = []
    n, m = len(passage), len(region)
    while True:
        best, end = 0, None
        prev: dict[int, tuple] = {}
        for i in range(n):
            row: dict[int, tuple] = {}
            w = None if taken[i] else passage[i]
            for j in range(max(0, i + offset - band), min(m, i + offset + band + 1)):
                # score, where it began, matches, single exchanges, and words exchanged since the last match (2: no longer single)
                score, si, sj, hits, single, since = prev.get(j - 1) or (0, i, j, 0, 0, 2)
                if region[j] == w:
                    cell = (score + 1, si, sj, hits + 1, single + (since == 1), 0)
                else:
                    cell = (score - 1, si, sj, hits, single, 1 if since == 0 else 2)
                u = prev.get(j)
                if u and u[0] - 1 > cell[0]:
                    cell = (u[0] - 1, *u[1:5], 2)
                left = row.get(j - 1)
                if left and left[0] - 1 > cell[0]:
                    cell = (left[0] - 1, *left[1:5], 2)
                if cell[0] > 0:
                    row[j] = cell
                    if cell[0] > best:
                        best, end = cell[0], (cell[1], i, cell[2], j, cell[3], cell[4])
            prev = row
        if end is None or end[4] < MIN_STRETCH:
            return out
        out.append((*end[:4], end[4] + end[5]))
        for i in range(end[0], end[1] + 1):
            taken[i] = True


def _near(words: np.ndarray, region: np.ndarray, offset: int) -> np.ndarray:
    """Per word of a passage: whether the region has it, or a single other word, where three of five words on one diagonal
    of the band match."""
    at = np.arange(len(words))[:, None] + np.arange(offset - WORD_BAND, offset + WORD_BAND + 1)[None, :]
    same = np.zeros((len(words) + 8, at.shape[1]), np.int8)
    same[4:-4] = (at >= 0) & (at < len(region)) & (region[np.clip(at, 0, len(region) - 1)] == words[:, None])
    dense = same[:-4] + same[1:-3] + same[2:-2] + same[3:-1] + same[4:] >= 3
    dense = dense[:-4] | dense[1:-3] | dense[2:-2] | dense[3:-1] | dense[4:]
    return (dense & ((same[4:-4] > 0) | (same[3:-5] + same[5:-3] == 2))).any(1)


def matched_words(index: Index, item: int, text: bytes, diagonals: list[int]) -> int:
    """Words of a passage held in its order, over the stretches of text that its bands left.

    Bands next to each other make one region. A word that no region has among other words of the passage is held by no
    alignment, so a passage with too many of them needs none."""
    words, size = index.words[item], int(index.sizes[item])
    spans: list[list[int]] = []
    for diagonal in sorted(diagonals):
        lo, hi = max(0, diagonal - BAND), min(len(text), diagonal + size + BAND)
        if spans and abs(diagonal - spans[-1][2]) <= BAND // 2:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi, diagonal])
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    ids = np.array([number[w] for w in words])
    regions = []
    for lo, hi, diagonal in spans:
        lo = text.rfind(b" ", 0, lo) + 1  # whole words
        end = text.find(b" ", hi)
        region = text[lo : end if end >= 0 else len(text)].split()
        offset = text.count(b" ", lo, diagonal) if diagonal > lo else -words_before(words, lo - diagonal)
        held = _near(ids, np.array([number.get(w, -1) for w in region]), offset)
        if held.sum() >= MIN_STRETCH:
            regions.append((held, lo, region, offset))
    regions = sorted(regions, key=lambda r: r[0].sum(), reverse=True)[:BEST_BANDS]
    if not regions or np.any([r[0] for r in regions], axis=0).sum() < SHARE * len(words):
        return 0
    parts = []
    for _, lo, region, offset in regions:
        base = text.count(b" ", 0, lo)
        parts += [(base + s, p0, p1, base + e, held) for p0, p1, s, e, held in align(words, region, offset)]
    parts.sort()
    best: list[int] = []
    for k, (s, p0, p1, e, held) in enumerate(parts):
        # alignments of two regions may share a few words: they count once
        before = [best[x] - max(0, x_e - s + 1, x_p1 - p0 + 1) for x, (x_s, x_p0, x_p1, x_e, _) in enumerate(parts[:k])
                  if x_s < s and x_e < e and x_p0 < p0 and x_p1 < p1]
        best.append(held + max([0, *before]))
    return max(best, default=0)


def words_before(words: list[bytes], size: int) -> int:
    """Words of a passage that begin within its first size characters."""
    k = 0
    while k < len(words) and size > 0:
        size -= len(words[k]) + 1
        k += 1
    return k


def search(index: Index, bitmap: np.ndarray, text: str | None) -> list[int]:
    """Numbers of the indexed passages of which the text holds at least half."""
    if not text:
        return []
    t = normalize(text)
    h = gram_hashes(t)
    if not len(h) or not len(index.hashes):
        return []
    pos = np.flatnonzero(bitmap[(h >> np.uint64(42)).astype(np.int64)])
    if not len(pos):
        return []
    slot = np.searchsorted(index.hashes, h[pos])
    slot[slot == len(index.hashes)] = 0
    real = index.hashes[slot] == h[pos]
    pos, slot = pos[real], slot[real]
    if not len(pos):
        return []
    return [i for i, diagonals in _bands(index, pos, slot).items() if matched_words(index, i, t, diagonals) >= SHARE * len(index.words[i])]


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
               passage: str = "passage", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id): every document that holds at least half of an item's passage.

    Null or empty texts and passages match nothing; passages shorter than q characters have no q-gram and match
    nothing. Items with equal passages each count. A document row that is repeated gives its rows again; a passage that
    stands several times in a document counts once. Other columns are ignored. Empty tables give no rows. Items are
    indexed in blocks of at most block_chars characters, with one pass over the documents for each block.
    """
    size = items.agg(F.sum(F.length(passage))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).where("p is not null")
    rows = rows.withColumn("b", F.pmod(F.xxhash64("p"), F.lit(blocks)))  # equal passages fall into one block
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for b in range(blocks):
        index = build_index([(r["i"], r["p"]) for r in rows.where(F.col("b") == b).orderBy("i").toLocalIterator()])
        part = docs.mapInArrow(_searcher(index), "doc_id long, item_id long")
        out = part if out is None else out.unionByName(part)
    return out


def _searcher(index: Index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = index.bitmap()
        for b in batches:
            docs, found = [], []
            for d, t in zip(b.column(0).to_pylist(), b.column(1)):
                for i in search(index, bitmap, t.as_py()):
                    docs += [d] * len(index.ids[i])
                    found += index.ids[i]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(found, pa.int64())], ["doc_id", "item_id"])

    return run
