"""Chat formatting with loss masks aligned by character offsets.

A conversation is rendered as one text, each turn as ``<s>role[INST]text</s>``, and encoded once,
with the offsets of every token. The spans of the turns are known from rendering; a binary search
among them tells for each token whether it lies in an assistant's text. The three markers
are special tokens, so no token crosses the edge of a text.

Control strings inside roles and texts are broken up by an escape character after their first
character; the escape character itself is doubled. ``read_back`` undoes both.

Defined results. Null roles and texts are empty. Turns are ordered by turn, nulls first, then role
and text, so ties and repeated rows have a fixed order and all are kept. A null conversation id is
a conversation of its own. An empty table gives an empty result. Columns besides those named
are not looked at. A conversation is one row of the result, however long it is; the
rows of one conversation are read in a stream, sorted by Spark.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"
ASSISTANT = "assistant"

#: The markers of the template, and strings that must not be read as such.
OPEN, HEAD, CLOSE = "<s>", "[INST]", "</s>"
CONTROL = (OPEN, CLOSE, HEAD, "[/INST]", "<|endoftext|>")
ESCAPE = "␛"

_INSERT = re.compile("|".join([ESCAPE, *[f"(?<={re.escape(c[0])})(?={re.escape(c[1:])})" for c in CONTROL]]))
_ESCAPED = re.compile(f"{ESCAPE}(.)", re.DOTALL)
_TURN = re.compile(f"{OPEN}(.*?){re.escape(HEAD)}(.*?){CLOSE}", re.DOTALL)

#: Code points that are encoded in one call.
CALL = 1 << 20

SCHEMA = (
    "formatted string, n_turns long, token_ids array<int>, token_starts array<int>, token_ends array<int>, "
    "loss_mask array<boolean>"
)


def escape(text: str) -> str:
    return _INSERT.sub(lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[int], list[int]]:
    """The text of a conversation, with starts and ends of the assistant's texts in it."""
    parts, starts, ends, at = [], [], [], 0
    for role, text in turns:
        head, body = OPEN + escape(role) + HEAD, escape(text)
        if role == ASSISTANT:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += [head, body, CLOSE]
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), starts, ends


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The turns of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def masked_texts(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> list[str]:
    """Texts under the mask, one for each run of masked tokens, unescaped."""
    texts, run = [], None
    for start, end, on in zip(starts, ends, mask, strict=True):
        if on:
            # The bytes of one character may be several tokens with the same offsets.
            run = (start, end) if run is None else (run[0], max(run[1], end))
        elif run is not None:
            texts.append(unescape(formatted[run[0] : run[1]]))
            run = None
    return texts if run is None else [*texts, unescape(formatted[run[0] : run[1]])]


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_special_tokens([AddedToken(c, special=True, normalized=False) for c in (OPEN, HEAD, CLOSE)])
    tokenizer.post_processor = processors.ByteLevel(trim_offsets=False)  # a token's blank is a part of it
    return tokenizer


def mask_of(token_starts: np.ndarray, token_ends: np.ndarray, starts: list[int], ends: list[int]) -> np.ndarray:
    """Whether each token lies inside one of the sorted spans."""
    if not starts:
        return np.zeros(len(token_starts), dtype=bool)
    span = np.searchsorted(np.array(starts), token_starts, side="right") - 1
    return (span >= 0) & (token_ends <= np.array(ends)[span]) & (token_ends > token_starts)


def _encoded(ids: list, rendered: list[tuple[str, list[int], list[int]]], turns: list[int], path: str, kind: pa.DataType) -> pa.RecordBatch:
    encodings = _tokenizer(path).encode_batch([text for text, _, _ in rendered], add_special_tokens=False)
    columns: dict[str, list] = {"token_ids": [], "token_starts": [], "token_ends": [], "loss_mask": []}
    for (_, starts, ends), encoding in zip(rendered, encodings, strict=True):
        offsets = np.array(encoding.offsets, dtype=np.int32).reshape(-1, 2)
        columns["token_ids"].append(encoding.ids)
        columns["token_starts"].append(offsets[:, 0])
        columns["token_ends"].append(offsets[:, 1])
        columns["loss_mask"].append(mask_of(offsets[:, 0], offsets[:, 1], starts, ends))
    kinds = {"token_ids": pa.int32(), "token_starts": pa.int32(), "token_ends": pa.int32(), "loss_mask": pa.bool_()}
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, kind),
            pa.array([text for text, _, _ in rendered], pa.string()),
            pa.array(turns, pa.int64()),
            *[pa.array(columns[c], pa.list_(k)) for c, k in kinds.items()],
        ],
        ["conv", "formatted", "n_turns", *kinds],
    )


def _formatter(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None
        conv, turns, open_conv = None, [], False
        ids, rendered, counts, size = [], [], [], 0

        def close() -> None:
            nonlocal turns, size
            ids.append(conv)
            rendered.append(render(turns))
            counts.append(len(turns))
            size += len(rendered[-1][0])
            turns = []

        for batch in batches:
            kind = batch.column("conv").type
            columns = [batch.column(c).to_pylist() for c in ("conv", "role", "text")]
            for key, role, text in zip(*columns, strict=True):
                if open_conv and key != conv:
                    close()
                    if size >= CALL:
                        yield _encoded(ids, rendered, counts, path, kind)
                        ids, rendered, counts, size = [], [], [], 0
                conv, open_conv = key, True
                turns.append((role or "", text or ""))
        if open_conv:
            close()
            yield _encoded(ids, rendered, counts, path, kind)

    return run


def format_conversations(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    tokenizer_path: str = TOKENIZER,
) -> DataFrame:
    """One row per conversation: id, formatted, n_turns, token_ids, token_starts, token_ends
    (code points of ``formatted``) and loss_mask (true for tokens of assistants' texts)."""
    named = rows.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = named.schema["conv"].dataType.simpleString()
    done = (
        named.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .mapInArrow(_formatter(tokenizer_path), f"conv {kind}, {SCHEMA}")
    )
    return done.withColumnRenamed("conv", conv)


def _digester(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    def hex_of(text: str) -> str:
        return sha256(text.encode()).hexdigest()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("formatted", "token_starts", "token_ends", "loss_mask")]
        out: dict[str, list] = {c: [] for c in ("n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")}
        for formatted, starts, ends, mask in zip(*columns, strict=True):
            turns = read_back(formatted)
            loss = "".join(masked_texts(formatted, starts, ends, mask))
            out["n_turns"].append(len(turns))
            out["turns_sha256"].append(hex_of("".join(f"{role}\n{text}\n" for role, text in turns)))
            out["loss_chars"].append(len(loss))
            out["loss_sha256"].append(hex_of(loss))
            out["formatted_chars"].append(len(formatted))
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *[pa.array(v) for v in out.values()]], ["conv", *out])


def digests(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """What the output of ``format_conversations`` says, read back from it: conv, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select(F.col(conv).alias("conv"), "formatted", "token_starts", "token_ends", "loss_mask")
    kind = rows.schema["conv"].dataType.simpleString()
    schema = f"conv {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return rows.mapInArrow(_digester, schema).withColumnRenamed("conv", conv)
