"""Conversations as training text with token-exact loss masks.

A turn is rendered as ``<|im_start|>role<|im_sep|>text<|im_end|>``. Inside roles and
texts a ``<``, any number of ``\\`` and a ``|`` get one more ``\\`` before the bar, so no
control string can stand there, and one less gives the text back. The whole
conversation is rendered and encoded once, with offsets; the three markers are
tokens of their own, so no token reaches over a marker. The characters to learn
(texts of the assistant) and the tokens' characters are both sorted, and a binary
search of the spans' ends among the tokens' gives the mask.

A conversation's turns are sorted by turn, role and text and pass through a task one
by one; what is rendered is put out in pieces of whole turns of about ``PIECE``
characters, numbered, so a conversation of any length needs bounded memory and its
pieces follow each other in a partition. A marker ends every piece, so its tokens
are those of the whole. Null role or text is empty; a null conversation id is a
conversation of its own; repeated rows are turns each; an empty table gives no row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, parts

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LEARNED = "assistant"
PIECE = 1 << 20
PIECES = "conv_id bigint, piece bigint, n_turns bigint, formatted string, token_ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"
SUMS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEP) + "(.*?)" + re.escape(END), re.S)
_LOADED: dict[str, object] = {}


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of the turns and the spans of it that are to be learned."""
    out, spans, size = [], [], 0
    for role, text in turns:
        head, body = START + escape(role) + SEP, escape(text)
        if role == LEARNED and body:
            spans.append((size + len(head), size + len(head) + len(body)))
        out += [head, body, END]
        size += len(head) + len(body) + len(END)
    return "".join(out), spans


def loss_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tokens that share a character with a span; spans and tokens are sorted."""
    if not spans:
        return np.zeros(len(starts), dtype=bool)
    low, high = np.array(spans).T
    after = np.searchsorted(high, starts, "right")  # the first span that ends behind the token's start
    inside = np.minimum(after, len(low) - 1)
    return (after < len(low)) & (low[inside] < ends) & (starts < ends)


def _tokenizer(path: str):
    if path not in _LOADED:
        from tokenizers import AddedToken, Tokenizer

        found = Tokenizer.from_file(path)
        found.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (START, SEP, END)])
        _LOADED[path] = found
    return _LOADED[path]


def format_conversations(rows: DataFrame, tokenizer: str) -> DataFrame:
    """Pieces of the formatted conversations, in order within partitions."""

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer).encode_batch
        current, piece, held, size = None, 0, [], 0
        ready: list[tuple] = []

        def flush():
            nonlocal ready
            texts = [render(turns) for _, _, turns in ready]
            found = encode([t for t, _ in texts], add_special_tokens=False)
            columns: list[list] = [[] for _ in range(8)]
            for (conv, number, turns), (text, spans), e in zip(ready, texts, found):
                starts, ends = np.array(e.offsets, dtype=np.int32).reshape(-1, 2).T
                for column, value in zip(columns, (conv, number, len(turns), text, e.ids, starts, ends, loss_mask(spans, starts, ends))):
                    column.append(value)
            ready = []
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.bool_())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])

        total = 0
        for batch in batches:
            for conv, role, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                role, text = role or "", text or ""
                if held and (conv != current or size > PIECE):
                    ready.append((current, piece, held))
                    total += size
                    held, size, piece = [], 0, piece + 1
                    if total > PIECE:
                        yield flush()
                        total = 0
                if conv != current:
                    current, piece = conv, 0
                held.append((role, text))
                size += len(role) + len(text)
        if held:
            ready.append((current, piece, held))
        if ready:
            yield flush()

    turns = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", "role", "text")
    ordered = turns.repartition(parts(rows), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").transform(in_batches, formatted, PIECES)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def learned_texts(formatted: str, starts, ends, loss) -> list[str]:
    """What the mask covers: each run of neighbouring tokens, with escapes undone."""
    found, at = [], -1
    for a, b, on in zip(starts, ends, loss):
        if on:
            if found and a <= at:
                found[-1][1] = max(at, b)
            else:
                found.append([a, b])
            at = found[-1][1]
        else:
            at = -1
    return [unescape(formatted[a:b]) for a, b in found]


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests of each conversation, from its pieces alone (in the order they came)."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = None  # conversation, turns, digests of turns and of learned text, characters of both

        def row():
            conv, n, turns, chars, learned, size = current
            return conv, n, turns.hexdigest(), chars, learned.hexdigest(), size

        def batch_of(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [c.split()[0] for c in SUMS.split(", ")])

        for batch in batches:
            rows = []
            convs, numbers, texts = (batch.column(k).to_pylist() for k in range(3))
            for k, (conv, number, text) in enumerate(zip(convs, numbers, texts)):
                if number == 0:
                    if current is not None:
                        rows.append(row())
                    current = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in turns_of(text):
                    current[1] += 1
                    current[2].update(f"{role}\n{said}\n".encode())
                for said in learned_texts(text, *(batch.column(c)[k].as_py() for c in (3, 4, 5))):
                    current[3] += len(said)
                    current[4].update(said.encode())
                current[5] += len(text)
            if rows:
                yield batch_of(rows)
        if current is not None:
            yield batch_of([row()])

    return pieces.select("conv_id", "piece", "formatted", "starts", "ends", "loss").transform(in_batches, summed, SUMS)
