"""Chat formatting: conversations rendered whole, encoded once with offsets, masks by intersecting sorted spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from themeloom.llm.common import ready

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
OPEN, CLOSE, TRAINED = "<|im_start|>", "<|im_end|>", ("assistant",)
_BATCH = 2 << 20
_made: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of that file, whose special tokens' strings are ordinary text; one a worker."""
    if path not in _made:
        _made[path] = Tokenizer.from_file(path)
        _made[path].encode_special_tokens = True
    return _made[path]


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The conversation's text, and the start and end of each turn's content with its closing mark."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head = f"{OPEN}{role}\n"
        body = f"{text}{CLOSE}"
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        parts += [head, body, "\n"]
        at = ends[-1] + 1
    return "".join(parts), starts, ends


def mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray, trained: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Turn of each token (-1: none) and whether it is trained. A token belongs to the first turn whose span it overlaps; turns are sorted and apart, so
    that is the first that ends after the token starts, if it starts before the token ends."""
    if not len(starts):
        return np.full(len(token_starts), -1, np.int64), np.zeros(len(token_starts), bool)
    turn = np.searchsorted(ends, token_starts, "right")
    inside = np.minimum(turn, len(starts) - 1)
    hit = (turn < len(starts)) & (starts[inside] < token_ends)
    return np.where(hit, inside, -1), hit & trained[inside]


def format_chats(conversations: DataFrame, path: str = TOKENIZER, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, n_turns, rendered, token_ids, loss_mask (1: trained), token_turn (place of its turn, -1: markup); one row a conversation.

    Turns are ordered by turn, then role and text, nulls first. null role: "unknown"; null text: empty; null turn: before all others; null conv_id:
    those rows are one conversation. A row repeated in full is one turn. Turns of any length are encoded whole. An empty table gives no rows;
    other columns don't matter. A token is trained if it overlaps the content, closing mark included, of a turn by a trained role.
    """
    ready(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path)
        for batch in batches:
            ids, turns = batch.column(0), batch.column(1).to_pylist()
            i = 0
            while i < len(turns):
                made, size = [], 0
                while i + len(made) < len(turns) and size < _BATCH:
                    made.append(render([(t["role"], t["text"]) for t in turns[i + len(made)]]))
                    size += len(made[-1][0])
                out = []
                for (text, starts, ends), e, own in zip(made, encode.encode_batch([m[0] for m in made], add_special_tokens=False), turns[i:], strict=False):
                    spans = np.array(e.offsets, np.int64).reshape(-1, 2)
                    which = np.array([t["role"] in trained for t in own], bool)
                    turn, on = mask(spans[:, 0], spans[:, 1], np.array(starts, np.int64), np.array(ends, np.int64), which)
                    out.append((len(own), text, e.ids, on.astype(np.int32).tolist(), turn.tolist()))
                n, text, tokens, on, turn = zip(*out, strict=True)
                lists = pa.list_(pa.int32())
                yield pa.RecordBatch.from_arrays([ids.slice(i, len(made)), pa.array(n, pa.int32()), pa.array(text, pa.string()), *(pa.array(x, lists) for x in (tokens, on, turn))], ["conv_id", "n_turns", "rendered", "token_ids", "loss_mask", "token_turn"])
                i += len(made)

    return whole.mapInArrow(work, "conv_id long, n_turns int, rendered string, token_ids array<int>, loss_mask array<int>, token_turn array<int>")
