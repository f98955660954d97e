"""Chat formatting: whole conversations rendered by one template, encoded once
with offsets, and a loss mask from intersecting turn spans with token spans."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template's control strings.
HEAD, COLON, END = "### ", ": ", "</turn>"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_TURN = re.compile(r"### ((?:[^\\:]|\\\\|\\:|\\###|\\</turn>)*): ((?:[^\\<]|\\\\|\\###|\\</turn>|<(?!/turn>))*)</turn>\n")


def escape(text: str) -> str:
    """Put a backslash before every control string and backslash of a text."""
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


@dataclass
class Rendered:
    text: str
    roles: list[str]
    starts: np.ndarray  # of the escaped texts, in characters
    ends: np.ndarray


def render(turns: list[tuple[str, str]]) -> Rendered:
    parts, roles, starts, ends, at = [], [], [], [], 0
    for role, text in turns:
        head = HEAD + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + COLON
        body = escape(text)
        parts += [head, body, END + "\n"]
        roles.append(role)
        starts.append(at + len(head))
        ends.append(at + len(head) + len(body))
        at = ends[-1] + len(END) + 1
    return Rendered("".join(parts), roles, np.array(starts, np.int64), np.array(ends, np.int64))


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation, unescaped."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def loss_pieces(starts: np.ndarray, ends: np.ndarray, t0: np.ndarray, t1: np.ndarray):
    """Intersect sorted disjoint turn spans with token spans in order: for each
    span, its tokens by binary search, and the characters that they cover in it.
    Tokens that share a character (a character of several byte tokens) give it once.
    Returns (mask over tokens, [(start, end)] character ranges)."""
    mask = np.zeros(len(t0), dtype=bool)
    done = np.maximum.accumulate(t1) if len(t1) else t1
    out = []
    first = np.searchsorted(done, starts, side="right")
    last = np.searchsorted(t0, ends, side="left")
    for s, e, i, j in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist(), strict=True):
        if i >= j or s >= e:
            continue
        mask[i:j] = t1[i:j] > t0[i:j]
        b = np.minimum(done[i:j], e)
        a = np.maximum(t0[i:j], np.concatenate(([s], b[:-1])))  # what earlier tokens gave is left out
        some = b > a
        a, b = a[some], b[some]
        new = np.flatnonzero(a[1:] != b[:-1]) + 1
        out += zip(a[np.concatenate(([0], new))].tolist() if len(a) else (), b[np.concatenate((new - 1, [len(b) - 1]))].tolist() if len(a) else (), strict=True)
    return mask, out


def conversations_of(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[object, list[tuple[str, str]]]]:
    """Whole conversations from sorted rows; one conversation is held at a time. A row
    without a conv_id is a conversation of its own."""
    key, turns, some = None, [], False
    for pdf in batches:
        for conv, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
            conv = None if pd.isna(conv) else int(conv)
            if some and (conv is None or conv != key):
                yield key, turns
                turns = []
            key, some = conv, True
            turns.append((role if isinstance(role, str) else "", text if isinstance(text, str) else ""))
    if some:
        yield key, turns


def format_conversations(df: DataFrame, tokenizer: str, loss_role: str = "assistant", batch: int = 64) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted (text), n_tokens, n_loss_tokens,
    input_ids, loss_mask (per token) and loss_spans (characters of formatted under
    the mask).

    Rows of a conversation follow turn, then role and text where turns tie; nulls
    come first. A null role or text is empty; a row with a null conv_id is a conversation
    of its own. Repeated rows stay as turns of their own. Other columns are not
    read. Each conversation is rendered whole, which one task must hold; tasks hold
    one batch of conversations at a time. tokenizer is a byte-level tokenizers file
    that every executor can read."""
    schema = "conv_id long, n_turns long, formatted string, n_tokens long, n_loss_tokens long, input_ids array<int>, loss_mask array<boolean>, loss_spans array<struct<start:int,end:int>>"

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(tokenizer)
        tok.encode_special_tokens = True
        held: list = []
        size = 0

        def flush():
            codes = tok.encode_batch([r.text for _, r in held], add_special_tokens=False)
            rows = []
            for (conv, r), code in zip(held, codes, strict=True):
                spans = np.fromiter(chain.from_iterable(code.offsets), np.int64, 2 * len(code)).reshape(-1, 2)
                ours = np.array([x == loss_role for x in r.roles], dtype=bool)
                mask, pieces = loss_pieces(r.starts[ours], r.ends[ours], spans[:, 0], spans[:, 1])
                rows.append((conv, len(r.roles), r.text, len(mask), int(mask.sum()), code.ids, mask.tolist(), [{"start": a, "end": b} for a, b in pieces]))
            return pd.DataFrame(rows, columns=["conv_id", "n_turns", "formatted", "n_tokens", "n_loss_tokens", "input_ids", "loss_mask", "loss_spans"]).astype({"conv_id": "Int64"})

        for conv, turns in conversations_of(batches):
            held.append((conv, render(turns)))
            size += len(held[-1][1].text)
            if len(held) >= batch or size > 1 << 20:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    rows = df.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    lone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    return rows.repartition("conv_id", lone).sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(work, schema)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def digests(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
    """Read back from the output alone: turns by parsing, loss text by its spans."""
    rows = []
    for text, ranges in zip(formatted, spans, strict=True):
        turns = "".join(f"{role}\n{body}\n" for role, body in parse(text))
        loss = unescape("".join(text[r["start"] : r["end"]] for r in ranges))
        rows.append((_sha(turns), len(loss), _sha(loss)))
    return pd.DataFrame(rows, columns=["turns_sha256", "loss_chars", "loss_sha256"])


def op6_chat_formatting(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = format_conversations(rows.unionByName(extra), public_tokenizers.path("byte_bpe_50k.json"))
    read_back = F.pandas_udf(digests, "turns_sha256 string, loss_chars long, loss_sha256 string")
    out = out.withColumn("d", read_back("formatted", "loss_spans"))
    return out.select("conv_id", "n_turns", "d.turns_sha256", "d.loss_chars", "d.loss_sha256", F.length("formatted").cast("long").alias("formatted_chars"), "n_tokens", "n_loss_tokens")
