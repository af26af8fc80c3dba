"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items are word sequences. Runs of ``MATCH`` words that a text shares with an item are seeds. Where a text
meets an item, the longest run both share outside of marked words is found by Karp-Rabin hashes (the length by bisection),
all its non-overlapping occurrences are marked as tiles, and so on down to ``MATCH`` words. The share of the item's words
under tiles does not depend on their order, so reordered passages count in full; from ``COVERED`` on, the text holds the item.

The items go to the tasks in blocks of at most ``BLOCK_WORDS`` words, counted before they are sent; a larger benchmark takes
one pass over the texts per block. Texts are never shuffled, and nothing is gathered per item, so copied passages make no
hot key.

Defined results: a text without words holds nothing; an item with fewer than ``MATCH`` words has no seed and is never
reported; items with equal texts are each reported; a repeated doc_id or item_id is reported per row; null ids stay null; an
empty table gives an empty result; columns other than the id and the text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import words

MATCH, COVERED = 5, 0.5
BLOCK_WORDS = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _windows(prefix: np.ndarray, marks: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Start positions and hashes of the runs of n words without a mark."""
    free = np.flatnonzero(marks[n:] == marks[:-n])
    back = words._powers(words._INV, len(prefix))
    return free, (prefix[free + n] - prefix[free]) * back[free]


def tiles(text: np.ndarray, item: np.ndarray, least: int = MATCH) -> list[tuple[int, int, int]]:
    """(position in text, position in item, length) of the tiles, longest first."""
    power = words._powers(words._BASE, max(len(text), len(item)) + 1)
    sides = []
    for seq in (text, item):
        prefix = np.zeros(len(seq) + 1, np.uint64)
        np.cumsum(seq * power[: len(seq)], out=prefix[1:])
        sides.append((prefix, np.zeros(len(seq), bool)))
    found: list[tuple[int, int, int]] = []

    def common(n: int):
        pairs = []
        for prefix, mark in sides:
            pairs.append(_windows(prefix, np.append(0, np.cumsum(mark)), n) if n <= len(mark) else (np.empty(0, np.int64), np.empty(0, np.uint64)))
        return *pairs, np.intersect1d(pairs[0][1], pairs[1][1])

    top = min(len(text), len(item))
    while top >= least:
        low, high = least - 1, top  # the longest run length is in [low, high]; every shorter run is common as well
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if len(common(middle)[2]) else (low, middle - 1)
        if low < least:
            break
        (at_text, hash_text), (at_item, hash_item), both = common(low)
        use: dict[int, list[int]] = {}
        for p, h in zip(at_text.tolist(), hash_text.tolist()):
            use.setdefault(h, []).append(p)
        wanted = set(both.tolist())
        for p, h in zip(at_item.tolist(), hash_item.tolist()):
            if h not in wanted or sides[1][1][p : p + low].any():
                continue
            for q in use[h]:
                if not sides[0][1][q : q + low].any():
                    sides[0][1][q : q + low] = True
                    sides[1][1][p : p + low] = True
                    found.append((q, p, low))
                    break
        top = low
    return found


class _Block:
    """Some items ready for lookup: their words, the seeds in hash order and the items of each seed."""

    def __init__(self, ids: list, texts: list) -> None:
        w = words.split(pa.array(texts, pa.large_string()))
        self.ids, self.items = ids, [w.text(i) for i in range(len(ids))]
        marks = [np.unique(words.grams(t, MATCH)) for t in self.items]
        seeds = np.concatenate(marks) if marks else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(ids)), [len(m) for m in marks])
        order = np.argsort(seeds, kind="stable")
        self.seeds, self.owner = seeds[order], owner[order]
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.seeds & np.uint64(0xFFFFF)).astype(np.int64)] = True

    def find(self, ids: pa.Array, texts: pa.Array, least: float) -> Iterator[tuple]:
        w = words.split(texts)
        marks = words.grams(w.hashes, MATCH)
        at = np.flatnonzero(self.sieve[(marks & np.uint64(0xFFFFF)).astype(np.int64)])
        lo = np.searchsorted(self.seeds, marks[at], "left")
        hi = np.searchsorted(self.seeds, marks[at], "right")
        doc = np.searchsorted(w.bounds, at, "right") - 1
        ok = (hi > lo) & (at + MATCH <= w.bounds[doc + 1])
        at, lo, hi, doc = at[ok], lo[ok], hi[ok], doc[ok]
        hits: dict[tuple[int, int], list[int]] = {}
        for p, l, h, d in zip(at.tolist(), lo.tolist(), hi.tolist(), doc.tolist()):
            for o in self.owner[l:h].tolist():
                hits.setdefault((d, o), []).append(p)
        for (d, o), places in hits.items():
            spot = np.array(places)
            cut = np.flatnonzero(np.diff(spot) > 1) + 1
            runs = [w.hashes[r[0] : r[-1] + MATCH] for r in np.split(spot, cut)]  # words next to a run that are not seeds cannot be in a tile
            wall = np.arange(1, len(runs) + 1, dtype=np.uint64) * _BASE  # separates the runs
            joined = np.concatenate([x for r, b in zip(runs, wall) for x in (r, b[None])])
            item = self.items[o]
            marked = tiles(joined, item)
            share = sum(n for _, _, n in marked) / len(item)
            if share >= least - 1e-12:
                yield ids[d].as_py(), self.ids[o], share, len(marked)


def _run(ids: list, texts: list, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block(ids, texts)
        for batch in batches:
            for lo, hi in words.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                rows = list(zip(*block.find(part["doc_id"], part["text"], least))) or [[]] * 4
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(rows, kinds)], ["doc_id", "item_id", "coverage", "tiles"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, coverage, tiles) for every text and item where the text's tiles cover at least ``least`` of the item."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id bigint, item_id bigint, coverage double, tiles int"
    out = None
    ids: list = []
    block: list = []
    size = 0

    def flush() -> None:
        nonlocal out, ids, block, size
        part = texts.mapInArrow(_run(ids, block, least), kind)
        out = part if out is None else out.unionByName(part)
        ids, block, size = [], [], 0

    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text IS NOT NULL").orderBy("item_id", "text")
    for item_id, text in items.toLocalIterator():  # one block in the driver's memory at a time
        ids.append(item_id), block.append(text)
        size += len(text) // 2 + 1
        if size >= block_words:
            flush()
    if block or out is None:
        flush()
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = COVERED) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns; rows without doc_id stay."""
    bad = contaminated(docs, benchmark, least).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
