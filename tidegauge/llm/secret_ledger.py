"""Secret scans over an incremental blob ledger.

Every version of a text is a blob named by its SHA-256. A rule set is a list of (kind, version, pattern); the ledger holds
the (blob, kind, version) triples that have been scanned and what was found. A run scans only the triples the ledger
lacks, one row per blob and not per path, and joins the findings back to every path that ever held the blob.

Defined results: a null text is the empty blob and has no finding; equal texts share one scan and all get its findings;
rows repeated with the same path stay as they are; an empty table gives an empty result; other columns are not read.
Positions count code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.tables import stored


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    least: int  # characters of group 2 if there is one, else of the match
    hint: str  # a literal every match holds; '' for none


# The three base rules of the contract, then the rules that the operator adds.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, ""),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 20, "AKIA"),
    Rule("hex", 1, r"[0-9a-f]+", 24, ""),
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 27, "-----BEGIN "),
    Rule("hosted", 1, r"gh[pousr]_[A-Za-z0-9]+", 24, "gh"),
    Rule("webtoken", 1, r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40, "eyJ"),
)

_FOUND = "blob string, kind string, version int, starts array<int>, ends array<int>"


def find(rule: Rule, text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough; a failing match still uses up its characters."""
    if rule.hint and rule.hint not in text:
        return []
    if rule.pattern == r"[0-9a-f]+":  # whole runs: no shorter one can start inside a longer
        return [m.span() for m in re.finditer(rf"[0-9a-f]{{{rule.least},}}", text)]
    group = 2 if re.compile(rule.pattern).groups >= 2 else 0
    return [m.span() for m in re.finditer(rule.pattern, text, re.ASCII) if m.end(group) - m.start(group) >= rule.least]


def _scan(rules: Sequence[Rule]):
    by_id = {(r.kind, r.version): r for r in rules}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for blob, text, todo in zip(batch["blob"].to_pylist(), batch["text"], batch["todo"].to_pylist()):
                body = text.as_py()
                for one in todo:
                    spans = find(by_id[one["kind"], one["version"]], body)
                    rows.append((blob, one["kind"], one["version"], [s for s, _ in spans], [e for _, e in spans]))
            cols = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.string(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["blob", "kind", "version", "starts", "ends"])

    return run


def paths_of(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob): the content address of every version."""
    return docs.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256).alias("blob"))


def scan_new(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Ledger rows (blob, kind, version, starts, ends) for every blob and rule version that ``ledger`` lacks.

    One path stands for each blob (the least), so of a large group of copies one text is read; the choice combines map-side.
    Blobs that the ledger has under all rules drop out before their text is touched.
    """
    wanted = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    row = docs.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    row = row.withColumn("blob", F.sha2(F.col("text").cast("binary"), 256))
    blobs = row.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        todo = blobs.withColumn("todo", wanted)
    else:
        done = ledger.select("blob", F.struct("kind", "version").alias("one")).groupBy("blob").agg(F.collect_set("one").alias("done"))
        todo = blobs.join(done, "blob", "left").withColumn(
            "todo", F.when(F.col("done").isNull(), wanted).otherwise(F.array_except(wanted, "done"))
        ).where(F.size("todo") > 0).drop("done")
    key = F.col("r.path").eqNullSafe(F.col("t.path")) & (F.col("r.blob") == F.col("t.blob"))
    texts = row.alias("r").join(todo.alias("t"), key).select("r.blob", "r.text", "t.todo")  # a path listed twice is scanned twice, and joined once
    return texts.mapInArrow(_scan(rules), _FOUND)


def findings(docs: DataFrame, ledger: DataFrame, rules: Sequence[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, spans): per path the findings of its blob under the given rule versions, ordered by start, then rule order."""
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(f"{r.kind}:{r.version}"), F.lit(i))])
    named = ledger.where(F.size("starts") > 0).select("blob", order[F.concat_ws(":", "kind", "version")].alias("nth"), "kind", F.arrays_zip("starts", "ends").alias("at"))
    spans = named.where(F.col("nth").isNotNull()).groupBy("blob", "nth", "kind").agg(F.first("at").alias("at")).select(
        "blob", F.expr("transform(at, x -> struct(x.starts AS start, nth, kind, x.ends AS end))").alias("s")
    ).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("s"))).alias("spans"))
    return paths_of(docs, path, text).join(spans, "blob", "left").select("path", "blob", F.coalesce("spans", F.array()).alias("spans"))


def scan(docs: DataFrame, ledger: DataFrame | None = None, rules: Sequence[Rule] = RULES) -> tuple[DataFrame, DataFrame]:
    """Findings per document and the ledger after the run (old rows plus new ones, stored in the shared folder)."""
    new = stored(scan_new(docs, ledger, rules))
    whole = new if ledger is None else ledger.select(new.columns).unionByName(new)
    return findings(docs, whole, rules), whole


def redact(docs: DataFrame, found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced by ``mark`` (overlapping findings as one); n_chars follows the text.

    All other columns stay as they are, whatever their names; a null text stays null; repeated rows are redacted each; a text of any length
    is cut at its findings only.
    """
    spans = found.where(F.size("spans") > 0).select(F.col("path").alias("p"), F.col("blob").alias("b"), "spans").dropDuplicates(["p", "b"]).alias("f")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    blob = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("blob")
    own = docs.select(row, blob, F.col("doc_id").alias("id"), F.col("text").alias("text")).alias("o")
    joined = own.join(spans, F.col("o.id").eqNullSafe(F.col("f.p")) & (F.col("o.blob") == F.col("f.b")), "left")
    # Fold the ordered spans: keep the text between them, write one mark for each run of overlapping spans.
    fold = f"""aggregate(f.spans, struct(cast('' AS string) AS out, 0 AS at),
        (a, x) -> CASE WHEN x.end <= a.at THEN a
                       WHEN x.start < a.at THEN struct(a.out AS out, x.end AS at)
                       ELSE struct(concat(a.out, substring(o.text, a.at + 1, x.start - a.at), '{mark}') AS out, x.end AS at) END,
        a -> concat(a.out, substring(o.text, a.at + 1)))"""
    clean = F.when(F.col("f.spans").isNull(), F.col("o.text")).otherwise(F.expr(fold))
    told = joined.select(F.col("o.row").alias("row"), clean.alias("text"), F.col("f.spans").isNull().alias("whole"))

    def column(c: str) -> F.Column:
        old = F.col("row").getField(c)
        if c == "text":
            return F.col("text")
        return F.when(F.col("whole"), old).otherwise(F.length("text").cast(docs.schema[c].dataType)).alias(c) if c == "n_chars" else old.alias(c)

    return told.select(*[column(c) for c in docs.columns])
