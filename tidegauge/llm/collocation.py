"""Phrase collocations by top-order marginalisation.

A text is cut at punctuation and line ends into pieces, and these at spaces and tabs into words; A-Z are lower-cased. Only the
longest windows are counted: each word with its lead columns, the ``order - 1`` words after it in the piece, padded behind the
piece's end. Counts of shorter phrases are sums over windows that begin alike, so one ROLLUP over the window's columns gives
every shorter count and the number of words of each language; no shorter n-gram is ever exploded.

Windows are counted slice by slice where the text lies, sorted and packed, one compressed block of lines for each slice and
bucket; a bucket is a hash of the language and the first two words. The blocks meet by bucket in one shuffle. There the counts
of a window and of its prefixes of two words and more are final, so a window below ``least`` is folded into its longest prefix that
reaches it (or into its first word): what the ROLLUP then adds up is small, and every sum stays exact. A bucket is added up
block by block, so its memory follows the distinct windows in it; the number of buckets follows the size of the texts.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count each; ties in a score go by the
phrase's count, then by the phrase in byte order; an empty table gives an empty result; very long texts are worked on in runs of
words; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.llm import words
from tidegauge.llm.tables import spread, stored

ENDS = r"[.,;:!?\x0A-\x0D]"
GAPS = r"[\x20\x09]+"
RUN = 1_000_000  # words counted at a time
BUCKET_BYTES = 4 << 20  # text that goes to one bucket
_BLOCKS = "lang string, bucket int, packed binary, size int"


def _name(i: int) -> str:
    return f"w{i + 1}"


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, and the number of the piece each one stands in."""
    whole = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])  # a slice's offset would mislead ascii_lower
    lowered = pc.ascii_lower(whole)
    pieces = pc.list_flatten(pc.split_pattern_regex(lowered, ENDS))
    split = pc.split_pattern_regex(pieces, GAPS)
    said = pc.list_flatten(split)
    piece = pc.list_parent_indices(split).to_numpy()
    real = pc.greater(pc.binary_length(said), 0)
    return said.filter(real), piece[real.to_numpy(zero_copy_only=False)]


def _dense(columns: list[np.ndarray]) -> np.ndarray:
    """Order-preserving codes of the rows of several code columns; below the number of rows after each step."""
    codes = columns[0]
    for col in columns[1:]:
        codes = np.unique(codes * np.int64(int(col.max(initial=0)) + 1) + col, return_inverse=True)[1].astype(np.int64)
    return codes


def _coded(said: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The distinct words in byte order and each word's place among them, from 1 on; 0 is the pad."""
    coded = said.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def _hashes(vocabulary: pa.Array) -> np.ndarray:
    """64-bit hashes of the words, the pad first."""
    _, offs, body = vocabulary.buffers()
    at = np.frombuffer(offs, np.int64)[vocabulary.offset : vocabulary.offset + len(vocabulary) + 1]
    data = np.frombuffer(body, np.uint8)
    return np.append(np.zeros(1, np.uint64), words._hash_runs(data, at[:-1], at[1:]))


def _lines(vocabulary: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """``w1 w2 ... count`` lines of coded rows: byte offsets of the rows and the bytes."""
    spelled = pa.concat_arrays([pa.array([""], pa.large_string()), vocabulary])
    parts = [spelled.take(pa.array(c)) for c in columns]
    nothing, new_line, space = (pa.scalar(x, pa.large_string()) for x in ("", "\n", " "))
    end = pc.binary_join_element_wise(pa.array(counts).cast(pa.large_string()), nothing, new_line)
    line = pc.binary_join_element_wise(*parts, end, space)
    _, offs, body = line.buffers()
    return np.frombuffer(offs, np.int64)[: len(line) + 1], memoryview(body)


def _packer(order: int, buckets: int):
    """Packed counts of the padded windows of each slice of text."""

    def count_run(lang: str, said: pa.Array, piece: np.ndarray, begun: int) -> Iterator[pa.RecordBatch]:
        vocabulary, code = _coded(said)
        columns = [code[:begun]]
        for i in range(1, order):
            lead = np.zeros(begun, np.int64)
            n = max(0, min(begun, len(code) - i))
            lead[:n] = np.where(piece[i : i + n] == piece[:n], code[i : i + n], 0)
            columns.append(lead)
        _, first, counts = np.unique(_dense(columns), return_index=True, return_counts=True)
        columns = [c[first] for c in columns]
        h = _hashes(vocabulary)
        seed = words._hash_runs(np.frombuffer(lang.encode() or b"\0", np.uint8), np.array([0]), np.array([len(lang.encode()) or 1]))[0]
        mixed = words.mix(h[columns[0]] * np.uint64(3) + (h[columns[1]] if order > 1 else np.uint64(0)) + seed, 7)
        bucket = (mixed % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        offs, body = _lines(vocabulary, [c[by] for c in columns], counts[by])
        bucket = bucket[by]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = np.append(cuts[1:], len(bucket))
        codec = pa.Codec("zstd")
        raw = [body[offs[s] : offs[e]] for s, e in zip(cuts, ends)]
        packed = [codec.compress(r, asbytes=True) for r in raw]
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(cuts), pa.string()), pa.array(bucket[cuts].astype(np.int32)), pa.array(packed, pa.binary()),
             pa.array([len(r) for r in raw], pa.int32())], ["lang", "bucket", "packed", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = pc.fill_null(batch["lang"], "und")
            for lang in pc.unique(langs).to_pylist():
                texts = batch["text"].filter(pc.equal(langs, lang))
                for lo, hi in _slices(texts):
                    said, piece = _pieces(texts.slice(lo, hi - lo))
                    for at in range(0, len(said), RUN):
                        end = min(len(said), at + RUN)
                        yield from count_run(lang, said[at : end + order - 1], piece[at : end + order - 1], end - at)

    return run


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about six bytes a word of a run."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        done = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, done + 6 * RUN, "right")))
        yield lo, hi
        lo = hi


def _merger(order: int, least: int):
    """Windows of a bucket added up; those below ``least`` are folded into the longest prefix that reaches it."""
    names = [_name(i) for i in range(order)]
    schema = pa.schema([("lang", pa.string()), *((n, pa.string()) for n in names), ("n", pa.int64())])

    def parsed(raw: bytes) -> pa.Table:
        return csv.read_csv(
            pa.BufferReader(raw), csv.ReadOptions(use_threads=False, column_names=[*names, "n"], block_size=len(raw) + 1),
            csv.ParseOptions(delimiter=" ", quote_char=False, double_quote=False, escape_char=False),
            csv.ConvertOptions(check_utf8=False, strings_can_be_null=False, column_types={**{n: pa.large_string() for n in names}, "n": pa.int64()}))

    def added(tables: list[pa.Table]) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
        """(vocabulary, code columns, counts) of the distinct windows, in order."""
        all_rows = pa.concat_tables(tables)
        rows = all_rows.num_rows
        said = pa.concat_arrays([c for n in names for c in all_rows[n].chunks])
        vocabulary, code = _coded(said)
        columns = [code[i * rows : (i + 1) * rows] for i in range(order)]
        dense = _dense(columns)
        by = np.argsort(dense, kind="stable")
        starts = np.flatnonzero(np.diff(dense[by], prepend=-1))
        counts = np.add.reduceat(all_rows["n"].to_numpy()[by], starts)
        return vocabulary, [c[by[starts]] for c in columns], counts

    def folded(lang: str, tables: list[pa.Table]) -> pa.RecordBatch:
        vocabulary, columns, counts = added(tables)
        pad = 1 if vocabulary[0].as_py() == "" else 0
        for depth in range(order, 1, -1):  # prefixes of this length that are too rare, or end in a pad, lose their last word
            dense = _dense(columns[:depth])
            starts = np.flatnonzero(np.diff(dense, prepend=-1))
            total = np.add.reduceat(counts, starts)
            rare = np.repeat(total < least, np.diff(np.append(starts, len(dense))))
            for i in range(depth - 1, order):
                columns[i] = np.where(rare, pad, columns[i])
        dense = _dense(columns)
        by = np.argsort(dense, kind="stable")
        starts = np.flatnonzero(np.diff(dense[by], prepend=-1))
        spelled = pa.concat_arrays([pa.array([""], pa.large_string()), vocabulary])
        out = [spelled.take(pa.array(c[by[starts]])).cast(pa.string()) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(starts), pa.string()), *out, pa.array(np.add.reduceat(counts[by], starts))], schema=schema)

    def squeezed(tables: list[pa.Table]) -> pa.Table:
        vocabulary, columns, counts = added(tables)
        return pa.table([*(vocabulary.take(pa.array(c - 1)) for c in columns), pa.array(counts)], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        now, tables, held, kept = None, [], 0, 0
        for batch in batches:
            for lang, bucket, packed, size in zip(*(batch[c].to_pylist() for c in ("lang", "bucket", "packed", "size"))):
                if now is not None and now != (lang, bucket):
                    yield folded(now[0], tables)
                    tables, held, kept = [], 0, 0
                now = (lang, bucket)
                tables.append(parsed(codec.decompress(packed, size, asbytes=True)))
                held += tables[-1].num_rows
                if held > max(RUN, 2 * kept):
                    tables = [squeezed(tables)]
                    held = kept = tables[0].num_rows
        if now is not None:
            yield folded(now[0], tables)

    return run


def window_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = 3, least: int = 10) -> DataFrame:
    """(lang, w1 .. w<order>, n): padded windows; those that occur less than ``least`` times are folded into a shorter prefix."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, min(1 << 24, total // BUCKET_BYTES))
    packed = rows.mapInArrow(_packer(order, buckets), _BLOCKS)
    met = packed.repartition(spread(spark), "lang", "bucket").sortWithinPartitions("lang", "bucket")
    return met.mapInArrow(_merger(order, least), "lang string, " + ", ".join(f"{_name(i)} string" for i in range(order)) + ", n bigint")


def phrase_counts(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = 3, least: int = 10) -> DataFrame:
    """(lang, size, phrase, n): every phrase of up to ``order`` words that occurs at least ``least`` times, and size 0: all words."""
    names = [_name(i) for i in range(order)]
    windows = window_counts(docs, lang, text, order, least)
    kept = windows.select("lang", *[F.when(F.col(c) != "", F.col(c)).alias(c) for c in names], "n")
    size = sum((F.when(F.grouping(c) == 0, 1).otherwise(0) for c in names), F.lit(0))
    rolled = kept.rollup("lang", *names).agg(F.sum("n").alias("n"), size.cast("int").alias("size"), F.grouping("lang").alias("all_langs"))
    ends_in_word = F.get(F.array(*names), F.col("size") - 1).isNotNull()
    real = rolled.where("all_langs = 0").where((F.col("size") == 0) | (ends_in_word & (F.col("n") >= least)))
    return real.select("lang", "size", F.concat_ws(" ", *names).alias("phrase"), "n")


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """The first ``top`` phrases of 2 to ``order`` words of each language: lang, rank, phrase, a, l, r, n, score.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its lowest-scoring cut, ``n`` all words of the language; the score
    is floor(1000000 a a / (l r)). A phrase that stands in a longer candidate with ``share`` percent of its count or more drops out.
    """
    counts = stored(phrase_counts(docs, lang, text, order, least))
    lookup = counts.where("size > 0").select("lang", "phrase", "n")
    total = counts.where("size = 0").select("lang", F.col("n").alias("all_words"))
    found = counts.where("size > 1").select("lang", "phrase", F.col("n").alias("a"), "size", F.split("phrase", " ", -1).alias("w"))

    inner = F.explode(F.flatten(F.transform(
        F.sequence(F.lit(2), F.col("size") - 1),
        lambda m: F.transform(F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " ")))))
    longer = found.where("size > 2").select("lang", inner.alias("phrase"), F.col("a").alias("held")).groupBy("lang", "phrase").agg(F.max("held").alias("held"))
    kept = found.join(longer, ["lang", "phrase"], "left").where(F.col("held").isNull() | (F.col("held") * 100 < F.col("a") * share)).drop("held")

    cuts = kept.select("lang", "phrase", "a", "w", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    parts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("head"),
        F.array_join(F.expr("slice(w, k + 1, size - k)"), " ").alias("tail"))
    heads = lookup.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l"))
    tails = lookup.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r"))
    score = F.expr("(cast(1000000 AS decimal(38,0)) * cast(a AS decimal(38,0)) * cast(a AS decimal(38,0))) div (cast(l AS decimal(38,0)) * cast(r AS decimal(38,0)))")
    scored = parts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).withColumn("score", score.cast("long"))
    least_cut = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    rows = least_cut.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")

    order_by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(16))
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order_by))).where(F.col("rank") <= top).drop("rank")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order_by))).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("all_words").alias("n"), "score")
