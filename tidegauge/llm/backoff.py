"""Language-model scores by stupid backoff, computed as joins.

Counts come from the whole corpus: how often each pair of words follows each other, and how often each word stands first or
second in such a pair; the start of a text is a word, too. A document is scored against all the others: its own occurrences
are taken off every count. The score of a word w after u is c(uw)/c(u) where the pair is left, else 0.4 c(w)/N where the word
is left, else 0.4 * 0.4 / N, with N all words of the others.

Texts are split into words once and stored in chunks of about a million words. A chunk asks for the counts of its distinct
pairs and words: the count tables are partitioned by ranges of the hash, and each partition gets one packed array of sorted
hashes with the chunk's own counts from every chunk that has some. It adds them up and sends back, in the same order and so
without hashes, how often each occurs outside the chunk. The chunk then scores its documents and takes their own counts off.

Defined results: a text without words (null, empty, symbols only) has 0 words, log score 0 and a null mean; rows that repeat
a doc_id add up in one row, each scored against all other rows; a null doc_id is such an id, too; a corpus of one text is
scored with N = 1; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm import words
from tidegauge.llm.tables import spread, stored

BACKOFF = 0.4
CHUNK = 1 << 20  # words and texts of a chunk
PART = 1 << 20  # keys that meet in a partition of the count tables, at most about
LEAST_PART = 1 << 15  # the same where partitions are made smaller for more tasks
_START = np.uint64(0x5851F42D4C957F2D)
_CHUNKS = "doc_ids array<bigint>, sizes array<bigint>, vocabulary binary, known bigint, said binary, words bigint"
_ASKED = "chunk bigint, part bigint, n bigint, keys binary, counts binary"
_TOLD = "chunk bigint, part bigint, n bigint, others binary"
_SCORED = "doc_id bigint, words bigint, log_score double"


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers byte by byte of their places, compressed: the zeros of small numbers cost nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8).T)
    return pa.Codec("zstd").compress(planes, asbytes=True)


def _unpacked(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.Codec("zstd").decompress(packed, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


class Grams(NamedTuple):
    """Keys of a chunk, those of its distinct pairs, its words and the start of a text, with two rows of counts in the chunk.

    The first row counts the pair, or the word as the second of a pair; the other row counts the word as the first of a pair.
    ``first``, ``second`` and ``pair`` have the places of the keys of every word said; ``order`` sorts the keys.
    """

    keys: np.ndarray
    counts: np.ndarray
    order: np.ndarray
    first: np.ndarray
    second: np.ndarray
    pair: np.ndarray


def _grams(vocabulary: np.ndarray, said: np.ndarray, sizes: np.ndarray) -> Grams:
    known = np.append(vocabulary, _START)
    first = np.append(np.int64(len(vocabulary)), said[:-1])[: len(said)]
    first[(np.cumsum(sizes) - sizes)[sizes > 0]] = len(vocabulary)
    code, pair, n = np.unique(first * len(known) + said, return_inverse=True, return_counts=True)
    u, w = np.divmod(code, len(known))
    keys = np.append(words.mix(known[u] * np.uint64(0x9E3779B97F4A7C15) + known[w], 3), known)
    seconds, firsts = (np.bincount(x, minlength=len(known)) for x in (said, first))
    counts = np.stack([np.append(n, seconds), np.append(np.zeros_like(n), firsts)])
    return Grams(keys, counts, np.argsort(keys), len(code) + first, len(code) + said, pair)


def _chunk_row(held: list[tuple[pa.Array, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    ids = pa.concat_arrays([x for x, _, _ in held])
    sizes = np.concatenate([x for _, x, _ in held])
    vocabulary, said, n = np.unique(np.concatenate([x for _, _, x in held]), return_inverse=True, return_counts=True)
    by = np.argsort(-n, kind="stable")  # frequent words get small numbers
    rank = np.empty_like(by)
    rank[by] = np.arange(len(by))
    ends = pa.array([0, len(ids)], pa.int32())
    lists = [pa.ListArray.from_arrays(ends, x) for x in (ids, pa.array(sizes, pa.int64()))]
    blobs = [pa.array([_packed(x)], pa.binary()) for x in (vocabulary[by], rank[said])]
    known, many = (pa.array([n], pa.int64()) for n in (len(vocabulary), len(said)))
    return pa.RecordBatch.from_arrays([*lists, blobs[0], known, blobs[1], many], [x.split()[0] for x in _CHUNKS.split(", ")])


def _chunker(chunk: int):
    """The words of the texts in chunks, one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, many = [], 0
        for batch in batches:
            for lo, hi in words.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w = words.split(part["text"])
                held.append((part["doc_id"], np.diff(w.bounds), w.hashes))
                many += len(w.hashes) + part.num_rows
                if many >= chunk:
                    yield _chunk_row(held)
                    held, many = [], 0
        if held:
            yield _chunk_row(held)

    return run


def _read(row: dict) -> tuple[np.ndarray, Grams]:
    """The sizes of a chunk's texts and its keys."""
    sizes = np.array(row["sizes"], np.int64)
    return sizes, _grams(_unpacked(row["vocabulary"], row["known"]), _unpacked(row["said"], row["words"]).view(np.int64), sizes)


def _asker(parts: int):
    """A row for each chunk and partition of the count tables: the keys that the chunk has there, and their counts in it."""
    width = -(-(1 << 64) // parts)
    edges = np.array([i * width for i in range(parts) if i * width < 1 << 64], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                _, g = _read(row)
                keys, counts = g.keys[g.order], g.counts[:, g.order]
                cuts = np.append(np.searchsorted(keys, edges), len(keys))
                n = np.diff(cuts)
                some = np.flatnonzero(n)
                spans = [slice(cuts[p], cuts[p + 1]) for p in some]
                gaps = [_packed(np.diff(keys[s], prepend=np.uint64(0))) for s in spans]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(some), row["chunk"]), pa.int64()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64()),
                     pa.array(gaps, pa.binary()), pa.array([_packed(counts[:, s]) for s in spans], pa.binary())],
                    [x.split()[0] for x in _ASKED.split(", ")])

    return run


def _added(asked: pa.Table) -> pa.Table:
    """A partition of the count tables: for each chunk how often its keys occur in the others, in the chunk's order."""
    n = asked["n"].to_pylist()
    keys = np.concatenate([np.cumsum(_unpacked(x.as_py(), m), dtype=np.uint64) for x, m in zip(asked["keys"], n)])
    own = np.concatenate([_unpacked(x.as_py(), 2 * m).reshape(2, m) for x, m in zip(asked["counts"], n)], axis=1)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    total = np.empty_like(own)
    total[:, order] = np.repeat(np.add.reduceat(own[:, order], starts, axis=1), np.diff(np.append(starts, len(keys))), axis=1)
    others = [_packed(x) for x in np.split(total - own, np.cumsum(n)[:-1], axis=1)]
    return asked.select(["chunk", "part", "n"]).append_column("others", pa.array(others, pa.binary()))


def _scorer(total: int, run_words: int):
    """The texts of a chunk against the counts of all other texts, some texts of about ``run_words`` words at a time."""
    back = np.log(BACKOFF)

    def log(x: np.ndarray) -> np.ndarray:
        return np.log(np.maximum(x, 1))

    def scores(counts: np.ndarray, sizes: np.ndarray, first: np.ndarray, second: np.ndarray, pair: np.ndarray) -> np.ndarray:
        text = np.repeat(np.arange(len(sizes)), sizes)

        def rest(row: np.ndarray, place: np.ndarray) -> np.ndarray:
            _, at, n = np.unique(text * len(row) + place, return_inverse=True, return_counts=True)
            return row[place] - n[at]

        left, first, second = rest(counts[0], pair), rest(counts[1], first), rest(counts[0], second)
        others = log(total - sizes)[text]
        one = np.where(left > 0, log(left) - log(first), np.where(second > 0, back + log(second) - others, 2 * back - others))
        return np.bincount(text, weights=one, minlength=len(sizes))

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        sizes, g = _read(row)
        told = told.sort_by("part")
        others = [_unpacked(x.as_py(), 2 * n).reshape(2, n) for x, n in zip(told["others"], told["n"].to_pylist())]
        g.counts[:, g.order] += np.concatenate(others, axis=1).view(np.int64)
        ends = np.cumsum(sizes)
        cuts = np.unique([0, *np.searchsorted(ends, np.arange(run_words, ends[-1], run_words)), len(sizes)])
        summed = []
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            span = slice(ends[lo] - sizes[lo], ends[hi - 1])
            summed.append(scores(g.counts, sizes[lo:hi], g.first[span], g.second[span], g.pair[span]))
        return pa.table({
            "doc_id": pa.array(row["doc_ids"], pa.int64()), "words": pa.array(sizes, pa.int64()), "log_score": pa.array(np.concatenate(summed), pa.float64()),
        })

    return run


def score(docs: DataFrame, chunk: int = CHUNK, part: int = PART, least_part: int = LEAST_PART) -> DataFrame:
    """(doc_id, words, log_score, mean_log): every document against the counts of all the others."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = stored(texts.mapInArrow(_chunker(chunk), _CHUNKS).withColumn("chunk", F.monotonically_increasing_id()))
    total, known = (n or 0 for n in chunks.agg(F.sum("words"), F.sum("known")).first())  # two numbers
    keys = total + 2 * known  # at most
    parts = 1 + max(keys // part, min(keys // least_part, 2 * spread(docs.sparkSession)))
    asked = chunks.select("chunk", "sizes", "vocabulary", "known", "said", "words").mapInArrow(_asker(parts), _ASKED)
    told = asked.groupBy("part").applyInArrow(_added, _TOLD)
    rows = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_scorer(total, max(1, chunk // 16)), _SCORED)
    summed = rows.groupBy("doc_id").agg(F.sum("words").alias("words"), F.sum("log_score").alias("log_score"))
    return summed.withColumn("mean_log", F.when(F.col("words") > 0, F.col("log_score") / F.col("words")))


BACKOFF_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[0-9a-z_\x{80}-\x{10FFFF}]+') AS ws FROM documents),
t AS (SELECT r, doc_id, unnest(ws) AS w, unnest(list_prepend(chr(1), ws[1:len(ws)-1])) AS u, len(ws) AS words FROM d WHERE len(ws) > 0),
p AS (SELECT r, doc_id, words, u, w, count(*) AS n FROM t GROUP BY ALL),
c2 AS (SELECT u, w, sum(n) AS c FROM p GROUP BY ALL), cu AS (SELECT u, sum(n) AS c FROM p GROUP BY ALL), cw AS (SELECT w, sum(n) AS c FROM p GROUP BY ALL),
ou AS (SELECT r, u, sum(n) AS c FROM p GROUP BY ALL), ow AS (SELECT r, w, sum(n) AS c FROM p GROUP BY ALL), tot AS (SELECT sum(n) AS c FROM p),
s AS (SELECT p.doc_id, p.n, p.n * CASE WHEN c2.c > p.n THEN ln(c2.c - p.n) - ln(cu.c - ou.c)
             WHEN cw.c > ow.c THEN ln(0.4) + ln(cw.c - ow.c) - ln(greatest(tot.c - p.words, 1)) ELSE 2 * ln(0.4) - ln(greatest(tot.c - p.words, 1)) END AS v
      FROM p JOIN c2 USING (u, w) JOIN cu USING (u) JOIN cw USING (w) JOIN ou ON ou.r = p.r AND ou.u = p.u JOIN ow ON ow.r = p.r AND ow.w = p.w, tot),
g AS (SELECT doc_id, sum(n)::BIGINT AS words, sum(v)::DOUBLE AS log_score FROM s GROUP BY doc_id)
SELECT x.doc_id, coalesce(words, 0)::BIGINT AS words, coalesce(log_score, 0) AS log_score, log_score / words AS mean_log
FROM (SELECT DISTINCT doc_id FROM documents) x LEFT JOIN g ON x.doc_id IS NOT DISTINCT FROM g.doc_id
"""
