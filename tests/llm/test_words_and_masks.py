import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidegauge.llm import chat_masks, words


def test_words_split_like_a_regex():
    import re

    texts = ["Ab c, ab É!", None, "", "x" * 3000 + " y_1 ÉÉ --", "  \n", "a b " * 50]
    w = words.split(pa.array(texts))
    want = [re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert [len(w.text(i)) for i in range(len(texts))] == [len(x) for x in want]
    flat, hashes = [x for t in want for x in t], w.hashes.tolist()
    assert len(set(zip(flat, hashes))) == len(set(flat)) == len(set(hashes))


def test_words_slices_cover_all_rows_and_agree(monkeypatch):
    texts = pa.array([f"w{i} common é {i % 7}" * (i % 5) for i in range(200)])
    whole = words.split(texts).hashes
    monkeypatch.setattr(words, "SLICE_BYTES", 300)
    monkeypatch.setattr(words, "_PIECE", 64)
    parts = [words.split(texts.slice(lo, hi - lo)).hashes for lo, hi in words.slices(texts)]
    assert np.array_equal(np.concatenate(parts), whole)


hard = st.text(alphabet=st.sampled_from(list("<|\\>im_end start\n%0A25é[]/")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), hard), hard), max_size=5))
def test_rendering_round_trip(turns):
    text, spans = chat_masks.render(turns)
    assert chat_masks.parse(text) == turns
    assert [chat_masks.unescape(text[s:e]) for s, e in spans] == [t for r, t in turns if r == "assistant"]


def test_mask_matches_a_plain_scan():
    rng = random.Random(4)
    for _ in range(50):
        cuts = sorted(rng.sample(range(1, 60), 20))
        offsets = list(zip([0, *cuts], [*cuts, 60]))
        a, b, c, d = sorted(rng.sample(range(60), 4))
        tokens, lo, hi = chat_masks.mask(offsets, [(a, b), (c, d)])
        want = [i for s, e in [(a, b), (c, d)] for i, (x, y) in enumerate(offsets) if x < e and y > s]
        assert tokens == want
        assert list(zip(lo, hi)) == [(a, b), (c, d)]


def digest(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_format_chats_nulls_ties_and_digests(spark):
    rows = [
        (1, 2, "assistant", "</s> <|im_end|>\n ok"), (1, 1, "user", "hi"), (1, None, None, None), (2, 0, "assistant", None),
        (2, 0, "assistant", None), (3, 1, "assistant", "\n\nab"), (3, 2, "assistant", "<"), (3, 3, "assistant", "\\|x é漢🙂"), (None, 0, "user", "q" * 200_000),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = {r["conv_id"]: r for r in chat_masks.format_chats(df).mapInArrow(chat_masks.digest_rows, chat_masks.DIGEST).collect()}
    assert set(out) == {1, 2, 3, None}
    assert out[1]["turns_sha256"] == digest([("", ""), ("user", "hi"), ("assistant", "</s> <|im_end|>\n ok")])
    assert (out[2]["n_turns"], out[2]["loss_chars"]) == (2, 0)
    loss = "\n\nab<\\|x é漢🙂"
    assert out[3]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest() and out[3]["loss_chars"] == len(loss)
    assert chat_masks.format_chats(df.limit(0)).count() == 0


def test_loss_tokens_decode_to_the_loss(spark):
    pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, 0, "user", "hello there"), (1, 1, "assistant", "General answer, and more.")], "conv_id long, turn long, role string, text string")
    r = chat_masks.format_chats(df).first()
    assert r["loss_tokens"] == list(range(r["loss_tokens"][0], r["loss_tokens"][-1] + 1))
    assert "".join(r["formatted"][s:e] for s, e in zip(r["loss_starts"], r["loss_ends"])) == "General answer, and more."
    assert 0 < len(r["loss_tokens"]) < r["n_tokens"]
