"""Chat formatting with offset-aligned loss masks.

A conversation is rendered once: ``<|im_start|>role\\n`` text ``<|im_end|>\\n`` per turn. Inside roles and texts every ``<|`` is
written ``<\\|`` and every ``<\\`` is written ``<\\\\``, so no text can hold a marker and the original comes back exactly. The
whole rendering is encoded once with character offsets; turn spans and token spans are both sorted, and a binary search
finds the tokens that meet each assistant span. A token on a border counts with its part inside the span only.

Defined results: a null text or role is the empty string; turns are ordered by (turn, role, text), null turns first, so ties
and repeated rows have one order; a null conversation id is a conversation; an empty table gives an empty result; other
columns are not read. A conversation is one value of the result, so its turns meet in one task; different conversations never
do, and each task holds one batch of conversations at a time.
"""

from __future__ import annotations

import functools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, BETWEEN, STOP = "<|im_start|>", "\n", "<|im_end|>\n"
_TURN = re.compile(re.escape(START) + r"(.*?)" + BETWEEN + r"(.*?)" + re.escape(STOP), re.DOTALL)

FORMATTED = (
    "conv_id bigint, formatted string, n_turns bigint, n_tokens bigint, loss_tokens array<int>, loss_starts array<int>, loss_ends array<int>"
)


def escape(text: str) -> str:
    return text.replace("<\\", "<\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"<\\([\\|])", r"<\1", text)


def escape_role(role: str) -> str:
    """A role also may not hold the line break that ends it."""
    return escape(role).replace("%", "%25").replace("\n", "%0A")


def unescape_role(role: str) -> str:
    return unescape(role.replace("%0A", "\n").replace("%25", "%"))


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The rendering and the spans of the assistant texts in it."""
    parts: list[str] = []
    spans, at = [], 0
    for role, text in turns:
        head, body = START + escape_role(role) + BETWEEN, escape(text)
        parts += (head, body, STOP)
        begin = at + len(head)
        if role == "assistant":
            spans.append((begin, begin + len(body)))
        at = begin + len(body) + len(STOP)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from a rendering."""
    return [(unescape_role(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def mask(offsets: list[tuple[int, int]], spans: list[tuple[int, int]]) -> tuple[list[int], list[int], list[int]]:
    """Tokens that meet a span, and the character pieces of the text under them, cut to the spans."""
    starts, ends = [s for s, _ in offsets], [e for _, e in offsets]
    tokens, lo_out, hi_out = [], [], []
    for s, e in spans:
        if s == e:
            continue
        first, last = bisect_right(ends, s), bisect_left(starts, e)
        tokens.extend(range(first, last))
        if first < last:
            lo_out.append(max(s, starts[first]))
            hi_out.append(min(e, ends[last - 1]))
    return tokens, lo_out, hi_out


@functools.cache
def encoder(path: str | None):
    """The byte-level tokenizer of the given file (the public 50k vocabulary when none is given), once per worker."""
    from tokenizers import Tokenizer

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True  # a control string of the tokenizer inside a text stays ordinary text
    return made


def _format(path: str | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                turns = [[(t["role"], t["text"]) for t in ts] for ts in part["turns"].to_pylist()]
                made = [render(t) for t in turns]
                rows = []
                for (text, spans), code, ts in zip(made, tok.encode_batch([m[0] for m in made], add_special_tokens=False), turns):
                    rows.append((text, len(ts), len(code.ids), *mask(code.offsets, spans)))
                cols = list(zip(*rows))
                kinds = [pa.string(), pa.int64(), pa.int64(), *[pa.list_(pa.int32())] * 3]
                arrays = [part["conv_id"], *[pa.array(list(c), k) for c, k in zip(cols, kinds)]]
                names = ["conv_id", "formatted", "n_turns", "n_tokens", "loss_tokens", "loss_starts", "loss_ends"]
                yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def format_chats(rows: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per conversation: the rendering, token counts, masked token positions and the masked character pieces."""
    empty = F.lit("")
    turn = F.struct(F.col("turn"), F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    chats = rows.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # array_sort puts a null turn inside a struct first, as struct comparison does.
    return chats.select("conv_id", "turns").mapInArrow(_format(tokenizer), FORMATTED)


def digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests read back from formatted conversations."""
    import hashlib

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            turns = hashlib.sha256("".join(f"{role}\n{text}\n" for role, text in parse(r["formatted"])).encode("utf-8", "surrogatepass")).hexdigest()
            loss = "".join(unescape(r["formatted"][s:e]) for s, e in zip(r["loss_starts"], r["loss_ends"]))
            out.append((r["conv_id"], len(parse(r["formatted"])), turns, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(r["formatted"])))
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], names)


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
