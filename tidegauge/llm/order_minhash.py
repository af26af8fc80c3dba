"""Near copies by order MinHash with banded alignment.

A text is its sequence of five-word shingles, each labelled with its occurrence number in the text. One sketch takes the
``PICK`` labelled shingles that are least under one hash function and keeps them in text order, so it depends on order as
well as on content; a text has ``SKETCHES`` of them. A text of at most ``SHORT`` shingles has prefix keys as well: its
n - ceil(0.8 n) + 1 labelled shingles that are least under one hash function for all texts. Two texts that share a sketch or a
prefix key are candidates. A candidate is verified
by an alignment of the two shingle sequences restricted to the diagonals that a similar pair can use: with L aligned
shingles of n1 and n2 the similarity is L / (n1 + n2 - L), and a pair counts from 0.8. Of two similar texts of at most
``SHORT`` shingles the prefixes always share a key, so none of these pairs is missed. Where the longer text has more, a pair
at similarity 0.8 has no sketch in common with a chance of at most 1.6 in 10 000 (32 shingles of 40 shared), of 0.7 in 10 000
for long texts. A text that is too short to be similar to one of more than ``SHORT`` shingles has prefix keys only.

Copies first fall together by a 128-bit fingerprint of the word sequence. Of the rest, each group with one key is linked
to its centre (the text that meets most others), which finds groups of any size with one pair per member. Only where members
of one key are still apart after that, texts from different components are compared with each other, in blocks of at most
2 x ``CHUNK`` members: each pair once, in the least key it shares, and only similar pairs leave the block. No pair is
dropped for the size of a group.

Defined results: a text with fewer than five words is one shingle; a text without any word (null, empty, blank, symbols only)
is compared with nothing and forms its own class; every text of a repeated doc_id is searched, and the id stands in the union of
their classes; a null doc_id is one document that is no copy of another; an empty table gives an empty result; other columns are not
read. Where documents are filtered, a row goes only if its own text has an earlier copy: of a class of texts the rows with the least
doc_id stay (of one id with several such texts, one text), rows that repeat the same id and text stay together, and rows without words or without doc_id stay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.core.session import kept
from tidegauge.llm import words
from tidegauge.llm.components import components
from tidegauge.llm.tables import stored

SHINGLE, SIMILAR = 5, 0.8
PICK, SKETCHES, CHUNK = 5, 24, 256
SHORT = 36  # shingles; a text of fewer than 30 is similar to no text of more than that


def shingles(tokens: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles in text order; of all words where there are fewer."""
    return words.grams(tokens, min(SHINGLE, len(tokens))) if len(tokens) else tokens


def labelled(seq: np.ndarray) -> np.ndarray:
    """Shingle hashes joined with their occurrence number, so that no value repeats."""
    order = np.argsort(seq, kind="stable")
    ranked = seq[order]
    fresh = np.append(True, ranked[1:] != ranked[:-1])
    if fresh.all():
        return seq
    index = np.arange(len(seq))
    nth = np.empty(len(seq), np.int64)
    nth[order] = index - np.maximum.accumulate(np.where(fresh, index, 0))
    return np.where(nth > 0, words.mix(seq + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), 77), seq)


_SEEDS = np.array([(i * 0xD6E8FEB86659FD93 + 0x2545F4914F6CDD1D) % (1 << 64) for i in range(1, SKETCHES + 1)], np.uint64)


def sketch(seq: np.ndarray) -> np.ndarray:
    """The sketches of one text: hashes of the least labelled shingles in text order, each joined with its own number."""
    marks = labelled(seq)
    k = min(PICK, len(marks))
    rows = max(1, (1 << 20) // len(marks))
    out = []
    for lo in range(0, SKETCHES, rows):
        seeds = _SEEDS[lo : lo + rows]
        x = (marks[None, :] ^ seeds[:, None]) * np.uint64(0xE7037ED1A0B428DB)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x8EBC6AF09C88C6E3)
        at = np.argpartition(x, k - 1, axis=1)[:, :k] if k < len(marks) else np.broadcast_to(np.arange(k), (len(seeds), k))
        picked = marks[np.sort(at, axis=1)]
        key = seeds.copy()
        for j in range(k):
            key = (key ^ picked[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        out.append(key)
    return np.concatenate(out).view(np.int64)


def prefix(seq: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """The labelled shingles that are least in one order for all texts: of two similar texts each has one that the other has.

    A text has n - ceil(least n) + 1 of them; without a common one, at least that many shingles of one text would be missing
    in the other, which leaves fewer than ``least`` of its own.
    """
    marks = words.mix(labelled(seq), 91)
    k = len(marks) - math.ceil(least * len(marks) - 1e-9) + 1
    return np.sort(marks)[:k].view(np.int64)


def keys_of(seq: np.ndarray, least: float = SIMILAR) -> np.ndarray:
    """The keys that make candidates: prefix keys up to ``SHORT`` shingles, sketches where a similar text may be longer."""
    if len(seq) > SHORT:
        return sketch(seq)
    if len(seq) + 1e-9 < least * (SHORT + 1):
        return prefix(seq, least)
    return np.unique(np.concatenate([prefix(seq, least), sketch(seq)]))


def _fingerprint(tokens: np.ndarray) -> tuple[int, int]:
    place = np.arange(1, len(tokens) + 1, dtype=np.uint64)
    high, low = (int(np.bitwise_xor.reduce(words.mix(tokens + place * np.uint64(odd), odd % 1000)).view(np.int64)) for odd in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
    return high, low


def _key_batches(least: float):
    """Fingerprint, number of shingles and keys of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in words.slices(batch["text"]):
                part = batch.slice(lo, hi - lo)
                w = words.split(part["text"])
                high, low, count, keys = [], [], [], []
                for i in range(part.num_rows):
                    t = w.text(i)
                    count.append(max(0, len(t) - SHINGLE + 1) or int(len(t) > 0))
                    if not len(t):
                        high.append(None), low.append(None), keys.append(None)
                        continue
                    for out, half in zip((high, low), _fingerprint(t)):
                        out.append(half)
                    keys.append(keys_of(shingles(t), least))
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(count, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                    ["doc_id", "high", "low", "n", "keys"],
                )

    return run


def _sequence_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, seq): the shingle sequence as bytes of 32-bit hashes; two unlike shingles of a pair agree with a chance of 2**-32."""
    for batch in batches:
        for lo, hi in words.slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            w = words.split(part["text"])
            seqs = [(shingles(w.text(i)) >> np.uint64(32)).astype(np.uint32).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(seqs, pa.binary())], ["doc", "seq"])


def _printed_sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(high, low, seq): shingle sequences under the fingerprints of their texts."""
    for batch in batches:
        for lo, hi in words.slices(batch["text"]):
            part = batch.slice(lo, hi - lo)
            w = words.split(part["text"])
            prints = [_fingerprint(w.text(i)) for i in range(part.num_rows)]
            seqs = [(shingles(w.text(i)) >> np.uint64(32)).astype(np.uint32).tobytes() for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()), pa.array(seqs, pa.binary())], ["high", "low", "seq"])


@F.pandas_udf(T.StructType([T.StructField("high", T.LongType()), T.StructField("low", T.LongType())]))
def text_print(texts: pd.Series) -> pd.DataFrame:
    """Fingerprint of the word sequence of a text; null for a text without words."""
    w = words.split(pa.Array.from_pandas(texts, type=pa.string()))
    return pd.DataFrame([_fingerprint(w.text(i)) if len(w.text(i)) else (None, None) for i in range(len(texts))], columns=["high", "low"]).astype("Int64")


def _read(seq: pa.Scalar) -> np.ndarray:
    return np.frombuffer(seq.as_py(), np.uint32).astype(np.uint64)


def aligned(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Longest common subsequence of two sequences within ``band`` diagonals of the main one (bit-parallel)."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    a, b, n = a[head:], b[head:], n - head
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - tail], b[: len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    places: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        places[x] = places.get(x, 0) | (1 << i)
    full = (1 << len(a)) - 1
    width = (1 << (2 * band + 1)) - 1
    open_bits = full
    for j, y in enumerate(b.tolist()):
        hit = places.get(y, 0)
        if hit:
            hit &= (width << (j - band)) if j >= band else (width >> (band - j))
            use = open_bits & hit
            open_bits = ((open_bits + use) | (open_bits - use)) & full
    return head + tail + len(a) - open_bits.bit_count()


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """Aligned shingles over all; 0.0 as soon as ``least`` is out of reach."""
    total = len(a) + len(b)
    need = least / (1 + least) * total
    if min(len(a), len(b)) + 1e-9 < need:
        return 0.0
    la, lb = np.sort(labelled(a)), np.sort(labelled(b))
    at = np.minimum(np.searchsorted(la, lb), len(la) - 1)
    if np.count_nonzero(la[at] == lb) + 1e-9 < need:
        return 0.0
    got = aligned(a, b, int(total - 2 * need) + 1)
    return got / (total - got)


def _verify(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch["left"], batch["right"]
            got = [similarity(_read(x), _read(y), least) for x, y in zip(left, right)]
            keep = [i for i, s in enumerate(got) if s >= least - 1e-12]
            yield pa.RecordBatch.from_arrays(
                [batch["a"].take(pa.array(keep, pa.int32())), batch["b"].take(pa.array(keep, pa.int32())), pa.array([got[i] for i in keep], pa.float64())], ["a", "b", "similarity"]
            )

    return run


def _verified(pairs: DataFrame, seqs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sequences (doc, seq) are similar enough."""
    left = pairs.join(seqs.select(F.col("doc").alias("a"), F.col("seq").alias("left")), "a")
    both = left.join(seqs.select(F.col("doc").alias("b"), F.col("seq").alias("right")), "b")
    return stored(both.select("a", "b", "left", "right").mapInArrow(_verify(least), "a bigint, b bigint, similarity double"))


def _block_batches(least: float):
    """Similar pairs of the members of each block; the rows of a block follow each other.

    A pair of texts is compared in the least key that both share, and only if their components differ.
    """

    def compare(key: int, first: int, second: int, rows: list[tuple]) -> Iterator[tuple[int, int, float]]:
        for i, (a, root_a, own_a, keys_a, seq_a) in enumerate(rows):
            for b, root_b, own_b, keys_b, seq_b in rows[i + 1 :]:
                short, long = sorted((len(seq_a), len(seq_b)))
                if root_a == root_b or (first != second and own_a == own_b) or short < least * long - 1e-9:
                    continue
                if min(keys_a & keys_b) == key and (s := similarity(seq_a, seq_b, least)) >= least - 1e-12:
                    yield min(a, b), max(a, b), s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            blocks = zip(*(batch[c].to_pylist() for c in ("key", "first", "second")))
            fields = zip(*(batch[c].to_pylist() for c in ("doc", "root", "own")), batch["keys"], batch["seq"])
            for at, (doc, root, own, keys, seq) in zip(blocks, fields):
                if at != block:
                    found.extend(compare(*block, rows) if block else ())
                    block, rows = at, []
                rows.append((doc, root, own, frozenset(keys.as_py()), _read(seq)))
            yield _links(found)
        if block:
            yield _links(list(compare(*block, rows)))

    return run


def _links(found: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*found)) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], ["a", "b", "similarity"])


def _classes_of_texts(docs: DataFrame, least: float, chunk: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, high, low, root) of all unlike texts of all ids, where texts of one class have one root (null without words); the ids that
    have several texts; and whether there are rows without id (at most one row)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "doc_id bigint, high bigint, low bigint, n int, keys array<bigint>"
    made = stored(texts.mapInArrow(_key_batches(least), kind))
    by_id = made.where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.struct("high", "low", "n", "keys")).alias("s"), F.min(F.struct("high", "low")).alias("x"), F.max(F.struct("high", "low")).alias("y"))
    by_id = stored(by_id.select("doc_id", "s.*", (F.col("x") != F.col("y")).alias("several")))
    several = kept(by_id.where("several").select("doc_id"))
    others = made.join(several, "doc_id").dropDuplicates(["doc_id", "high", "low"]).select("doc_id", "high", "low", "n", "keys", F.lit(True).alias("several"))
    every = by_id.where("NOT several").unionByName(others)
    # A text is known by the least id that has no other text, else by a hash of its fingerprint.
    named = every.where("n > 0").groupBy("high", "low").agg(F.min(F.when(~F.col("several"), F.col("doc_id"))).alias("least_id"), F.min(F.struct("n", "keys")).alias("s"))
    first = stored(named.select("high", "low", F.coalesce("least_id", F.xxhash64("high", "low")).alias("doc"), "s.n", "s.keys", F.col("least_id").isNull().alias("hashed")))
    exploded = first.select("doc", "n", F.explode("keys").alias("key"))
    groups = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    member = stored(exploded.join(groups, "key").select("key", "size", "doc", "n"))
    # The centre of a group meets most others: a text with many near copies is at their middle.
    met = member.groupBy("doc").agg(F.sum("size").alias("met"))
    hubs = member.join(met, "doc").groupBy("key").agg(F.max(F.struct("met", (-F.col("doc")).alias("d"), "n")).alias("h")).select("key", (-F.col("h.d")).alias("hub"), F.col("h.n").alias("hub_n"))
    fit = F.least("n", "hub_n") >= F.greatest("n", "hub_n") * F.lit(least)
    star = member.join(hubs, "key").where((F.col("doc") != F.col("hub")) & fit).select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()
    star = stored(star)
    # One pass over the texts for all comparisons: only members of some group are cut into shingles again.
    ids = member.select("doc").distinct()
    plain = first.where("NOT hashed").select("doc").join(ids, "doc", "left_semi").withColumnRenamed("doc", "doc_id")
    seqs = texts.join(plain, "doc_id", "left_semi").mapInArrow(_sequence_batches, "doc bigint, seq binary")
    printed = texts.join(several, "doc_id", "left_semi").where("text IS NOT NULL").mapInArrow(_printed_sequences, "high bigint, low bigint, seq binary")
    hashed = printed.dropDuplicates(["high", "low"]).join(first.where("hashed").select("high", "low", "doc"), ["high", "low"]).select("doc", "seq")
    seqs = stored(seqs.unionByName(hashed.join(ids, "doc", "left_semi")))
    links = _verified(star, seqs, least)
    roots = stored(components(links))
    rooted = member.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("component", "doc"))
    apart = rooted.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    rest = stored(rooted.join(apart, "key").select("key", "size", "doc", "n", "root"))
    # Groups are cut into chunks; each pair of chunks is a block of bounded size, and no pair becomes a row unless it is similar.
    chunks = F.ceil(F.col("size") / chunk).cast("int")
    cut = rest.withColumn("own", F.pmod(F.xxhash64("doc"), chunks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    cut = cut.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "doc", "root")
    held = cut.join(first.select("doc", "keys").join(seqs.dropDuplicates(["doc"]), "doc"), "doc")
    blocks = held.repartition("key", "first", "second").sortWithinPartitions("key", "first", "second", "doc")
    more = stored(blocks.mapInArrow(_block_batches(least), "a bigint, b bigint, similarity double"))
    final = components(links.select("a", "b").unionByName(more.select("a", "b")))
    of_text = first.select("high", "low", "doc").join(final.withColumnRenamed("node", "doc"), "doc", "left").select("high", "low", F.coalesce("component", "doc").alias("root"))
    own = every.alias("o").join(of_text.alias("t"), ["high", "low"], "left").select("doc_id", "high", "low", "root")
    return own, several, made.where("doc_id IS NULL").limit(1)


def near_classes(docs: DataFrame, least: float = SIMILAR, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, class_id, copies): the least doc_id of every document's class and the number of documents in it."""
    own, several, nulls = _classes_of_texts(docs, least, chunk)
    # the classes of the texts of one id are one: an id that has several joins their roots
    spread = own.join(several, "doc_id").where("root IS NOT NULL")
    met = spread.groupBy("doc_id").agg(F.min("root").alias("lo"))
    joins = kept(spread.join(met, "doc_id").where("root <> lo").select(F.col("root").alias("a"), F.col("lo").alias("b")))
    if not joins.isEmpty():
        merged = components(joins).select(F.col("node").alias("root"), "component")
        own = own.join(merged, "root", "left").withColumn("root", F.coalesce("component", "root")).drop("component")
    rooted = own.groupBy("doc_id").agg(F.min("root").alias("root")).withColumn("alone", F.when(F.col("root").isNull(), F.col("doc_id")))
    sizes = rooted.groupBy("root", "alone").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("copies"))
    same = F.col("r.root").eqNullSafe(F.col("s.root")) & F.col("r.alone").eqNullSafe(F.col("s.alone"))
    found = rooted.alias("r").join(sizes.alias("s"), same).select("r.doc_id", "s.class_id", "s.copies")
    return found.unionByName(nulls.select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("copies")))


def keep_first(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """The rows that stand for the class of their text, with all their columns."""
    own, several, _ = _classes_of_texts(docs, least, CHUNK)
    heads = own.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("doc_id", "high", "low")).alias("h")).select("h.*")
    # ids with one text need no look at the text; the rows of the others are told apart by its fingerprint
    stay = heads.join(several, "doc_id", "left_anti").select("doc_id").unionByName(own.where("root IS NULL").join(several, "doc_id", "left_anti").select("doc_id"))
    single = docs.join(stay.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    many = docs.join(several.select(F.col("doc_id").alias("_id")), F.col("doc_id").cast("long") == F.col("_id"), "left_semi")
    told = many.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), text_print("text").alias("p"))
    of_heads = heads.join(several, "doc_id")
    first = told.alias("t").join(of_heads.alias("h"), (F.col("t.doc_id") == F.col("h.doc_id")) & (F.col("t.p.high") == F.col("h.high")) & (F.col("t.p.low") == F.col("h.low")), "left_semi")
    wordless = told.where("p.high IS NULL")
    return single.unionByName(first.unionByName(wordless).select("row.*")).unionByName(docs.where("doc_id IS NULL")).select(*[F.col(f"`{c}`") for c in docs.columns])
