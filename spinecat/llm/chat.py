"""Chat formatting by token-level assembly.

Each turn becomes <|turn|> role <|text|> text <|end|>, the marks being ids outside the tokenizer's
vocabulary. Role and text are encoded on their own and spliced between the marks, so no token
crosses a border and no text can turn into a mark. Control strings that occur inside a role or a
text (the printed marks and those of other common templates) are escaped by an escape character
after their first character; the escape character itself is escaped first, so reading back is
exact. The loss mask is the prefix sum of +1 where an assistant's text starts and -1 where it
ends.

Encoding is done row by row, wherever a row lies; only then are the rows of a conversation brought
together in order, and read as a stream, so a conversation of any length needs no more memory than
a batch. Turns are ordered by turn (nulls first), then role and text; repeated rows stay. A null
text or role is empty. Rows with a null conv_id form one conversation. An empty table gives no
rows. Columns other than the named ones are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spinecat.llm import common as c

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Printed forms of the marks, in the order of their ids after the vocabulary's.
MARKS = ("<|turn|>", "<|text|>", "<|end|>")
#: Control strings of widespread chat templates, escaped inside texts too.
FOREIGN = (
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>",
    "<|startoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>",
)
ESCAPE = "␛"
CONTROL = re.compile("|".join(re.escape(x) for x in (*MARKS, *FOREIGN)))


def escape(text: str) -> str:
    safe = text.replace(ESCAPE, ESCAPE + "0")
    return CONTROL.sub(lambda m: m[0][0] + ESCAPE + "1" + m[0][1:], safe)


def unescape(text: str) -> str:
    return text.replace(ESCAPE + "1", "").replace(ESCAPE + "0", ESCAPE)


class Codec:
    """Ordinary text to ids and back, and the ids of the marks."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        # The public pattern of byte-level BPE: contractions, letters, digits, others, white space.
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self._encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        base = max(ranks.values()) + 1
        self.turn, self.text, self.end = base, base + 1, base + 2

    #: Longer texts are encoded piece by piece, cut before a space where there is one.
    PIECE = 100_000

    def encode(self, text: str) -> list[int]:
        out, at = [], 0
        while at < len(text):
            end = at + self.PIECE
            if end < len(text):
                space = text.rfind(" ", at + 1, end)
                end = space if space > at else end
            out.extend(self._encoding.encode_ordinary(text[at:end]))
            at = end
        return out

    def decode(self, ids) -> str:
        return self._encoding.decode_bytes(list(ids)).decode()


@cache
def codec(path: str) -> Codec:
    return Codec(path)


def assemble(role: str, text: str, with_loss: bool, own: Codec) -> tuple[np.ndarray, np.ndarray]:
    """Ids and loss mask of one turn."""
    head, body = own.encode(escape(role)), own.encode(escape(text))
    ids = np.array([own.turn, *head, own.text, *body, own.end], dtype=np.int32)
    delta = np.zeros(len(ids) + 1, dtype=np.int8)
    if with_loss:
        start = len(head) + 2
        delta[start] += 1
        delta[start + len(body)] -= 1
    return ids, np.cumsum(delta)[:-1].astype(np.int8)


def read_back(ids: np.ndarray, mask: np.ndarray, own: Codec) -> tuple[str, str, str, int]:
    """(role, text, text under the mask, code points of the printed form) of one turn's ids."""
    cut = int(np.flatnonzero(ids == own.text)[0])
    head, body = own.decode(ids[1:cut]), own.decode(ids[cut + 1 : -1])
    loss = own.decode(ids[mask > 0])
    printed = sum(map(len, MARKS)) + len(head) + len(body)
    return unescape(head), unescape(body), unescape(loss), printed


KEYS = ("conv_", "turn_", "role_", "text_")


def format_turns(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    loss_role: str = "assistant",
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """One row per turn: conv_, turn_, role_, text_, ids (array of int), mask (array of 0 and 1)."""
    picked = rows.select(*[F.col(x).alias(k) for x, k in zip((conv_col, turn_col, role_col, text_col), KEYS, strict=True)])

    def scan(batches):
        own = codec(tokenizer)
        for batch in batches:
            roles = pc.fill_null(batch.column(2).cast(pa.string()), "").to_pylist()
            texts = pc.fill_null(batch.column(3).cast(pa.string()), "").to_pylist()
            done = [assemble(r, t, r == loss_role, own) for r, t in zip(roles, texts, strict=True)]
            ids = pa.array([x[0] for x in done], pa.list_(pa.int32()))
            mask = pa.array([x[1] for x in done], pa.list_(pa.int8()))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, mask], [*KEYS, "ids", "mask"])

    kinds = ", ".join(f"{k} {picked.schema[k].dataType.simpleString()}" for k in KEYS)
    return picked.mapInArrow(scan, f"{kinds}, ids array<int>, mask array<tinyint>")


RESULT = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long"


def conversations(turns: DataFrame, conv_col: str = "conv_id", tokenizer: str = TOKENIZER) -> DataFrame:
    """Digests of every conversation, read back from the ids and masks of ``format_turns``."""
    ordered = turns.select("conv_", "turn_", "role_", "text_", "ids", "mask").repartition("conv_")
    # Only ids and masks are read; role and text order ties.
    ordered = ordered.sortWithinPartitions("conv_", "turn_", "role_", "text_").select("conv_", "ids", "mask")
    kind = turns.schema["conv_"].dataType.simpleString()

    def scan(batches):
        own = codec(tokenizer)
        now, state, out = None, None, []

        def finish():
            n, whole, chars, loss, printed, tokens = state
            out.append((now[0], n, whole.hexdigest(), chars, loss.hexdigest(), printed, tokens))

        def flush(like):
            cols = list(zip(*out, strict=True))
            out.clear()
            kinds = (like, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays(
                [pa.array(x, k) for x, k in zip(cols, kinds, strict=True)],
                [conv_col, *(x.split()[0] for x in RESULT.split(", "))],
            )

        like = None
        for batch in batches:
            like = batch.column(0).type
            convs = batch.column(0).to_pylist()
            for at, conv in enumerate(convs):
                if now is None or now[0] != conv:
                    if now is not None:
                        finish()
                    now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                ids = np.asarray(batch.column(1)[at].values)
                mask = np.asarray(batch.column(2)[at].values)
                role, text, loss, printed = read_back(ids, mask, own)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += printed
                state[5] += len(ids)
            if len(out) > 1000:
                yield flush(like)
        if now is not None:
            finish()
        if out:
            yield flush(like)

    return ordered.mapInArrow(scan, f"{conv_col} {kind}, {RESULT}")
