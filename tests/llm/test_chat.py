import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from themeloom.llm import chat


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 5), max_size=8), st.lists(st.integers(0, 4), max_size=12))
def test_mask_matches_every_pair_of_spans(turns, tokens):
    starts, ends, at = [], [], 2
    for n in turns:
        starts.append(at)
        ends.append(at + n)
        at += n + 3
    spans, at = [], 0
    for n in tokens:
        spans.append((at, at + n))
        at += n
    which = np.array([i % 2 == 0 for i in range(len(turns))], bool)
    a, b = (np.array([s[k] for s in spans], np.int64) for k in (0, 1))
    turn, on = chat.mask(a, b, np.array(starts, np.int64), np.array(ends, np.int64), which)
    for i, (s, e) in enumerate(spans):
        if s == e:
            continue
        hits = [k for k in range(len(turns)) if starts[k] < e and s < ends[k]]
        assert turn[i] == (hits[0] if hits else -1)
        assert on[i] == bool(hits and which[hits[0]])


def test_masked_tokens_spell_the_trained_turns(spark):
    rows = [(1, 1, "assistant", "Grüße 漢字 you!"), (1, 0, "user", "hello"), (1, 2, "user", "bye"), (2, 0, "assistant", "x" * 3000), (2, 0, "assistant", "x" * 3000)]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    one = got[1]
    assert one.rendered == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nGrüße 漢字 you!<|im_end|>\n<|im_start|>user\nbye<|im_end|>\n"
    encode = chat.tokenizer(chat.TOKENIZER)
    assert one.token_ids == encode.encode(one.rendered, add_special_tokens=False).ids
    spelt = encode.decode([t for t, m in zip(one.token_ids, one.loss_mask, strict=True) if m])
    assert spelt.startswith("Grüße 漢字 you!<|im_end|>"[:-2])
    assert {t for t, m in zip(one.token_turn, one.loss_mask, strict=True) if m} == {1}
    assert got[2].n_turns == 1


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string, turns string, loss_mask string"
    rows = [(None, 0, "user", "a", "x", "x"), (None, None, None, None, "x", "x"), (3, 0, None, "", "x", "x"), (3, 0, "assistant", None, "x", "x"), (4, 0, "assistant", "long " * 50_000, "x", "x")]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, schema)).collect()}
    assert got[None].rendered.startswith("<|im_start|>unknown\n<|im_end|>\n") and got[None].n_turns == 2
    assert got[3].n_turns == 2 and len(got[4].token_ids) == len(got[4].loss_mask) > 50_000
    assert chat.format_chats(spark.createDataFrame([], schema)).count() == 0


def test_an_unknown_tokenizer_is_an_error(spark):
    with pytest.raises(Exception, match="No such file|not found|os error"):
        chat.tokenizer("/nowhere.json")
