"""Chat formatting with loss masks aligned by offsets.

A conversation is rendered as one string whose turns lie between control strings,
encoded once with offsets, and the spans of the texts to learn are intersected
with the spans of the tokens by binary search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.text import full_text

# Fixed values of the template. Every control string starts with the two characters
# that escaping keeps out of roles and texts.
TURN, SEP, END = "<|turn|>", "<|text|>", "<|done|>"
FLUSH_CHARS = 1_000_000


def escape(text: str) -> str:
    """Put a backslash into every ``<|``, and one more where some are there already.

    After that ``<|`` occurs in no text, and taking one backslash out of each such
    place gives the text back.
    """
    import re

    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    import re

    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _format_batches(tokenizer_json: str, learn: Sequence[str], outputs: bool):
    """Function over Arrow batches sorted by conversation and turn."""

    learned, markers = frozenset(learn), (TURN, SEP, END)

    def run(batches):
        import hashlib
        import os
        import re

        import numpy as np
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import AddedToken, Tokenizer

        tokenizer = Tokenizer.from_str(tokenizer_json)
        # As added tokens the control strings are cut out before any other rule.
        tokenizer.add_special_tokens([AddedToken(m, normalized=False) for m in markers])
        added, opened, back = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|"), re.compile(
            "|".join(map(re.escape, markers))
        )

        def hide(text):
            return added.sub(r"<\\\1|", text)

        def show(text):
            return opened.sub(r"<\1|", text)

        class Conversation:
            def __init__(self, ident):
                self.ident = ident
                self.pending, self.waiting = [], 0
                self.turns = self.loss_chars = self.chars = 0
                self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()
                self.ids, self.mask, self.texts = [], [], []

            def add(self, role, text):
                self.pending.append((role, text))
                self.waiting += len(text)
                # Control strings stand alone as tokens, so a conversation may be
                # encoded in parts that end with one: the ids are the same.
                if self.waiting > FLUSH_CHARS:
                    self.flush()

            def flush(self):
                parts, spans, at = [], [], 0
                for role, text in self.pending:
                    head, body = TURN + hide(role) + SEP, hide(text)
                    if role in learned and body:
                        spans.append((at + len(head), at + len(head) + len(body)))
                    parts += (head, body, END)
                    at += len(head) + len(body) + len(END)
                self.pending, self.waiting = [], 0
                rendered = "".join(parts)
                encoding = tokenizer.encode(rendered, add_special_tokens=False)
                offsets = np.array(encoding.offsets, np.int64).reshape(-1, 2)
                mask = np.zeros(len(offsets), bool)
                # Of tokens sorted by place, those of a span are one slice.
                for first, last in spans:
                    low = np.searchsorted(offsets[:, 1], first, side="right")
                    high = np.searchsorted(offsets[:, 0], last, side="left")
                    mask[low:high] = True
                self.read_back(rendered, offsets, mask)
                self.chars += len(rendered)
                if outputs:
                    self.texts.append(rendered)
                    self.ids.extend(encoding.ids)
                    self.mask.extend(mask.tolist())

            def read_back(self, rendered, offsets, mask):
                """Turns and learned text, from the string and the token mask alone."""
                for turn in rendered.split(TURN)[1:]:
                    role, _, rest = turn.partition(SEP)
                    text = rest[: -len(END)]
                    self.turn_hash.update(f"{show(role)}\n{show(text)}\n".encode())
                    self.turns += 1
                edges = np.flatnonzero(np.diff(np.concatenate(([0], mask, [0])).astype(np.int8)))
                for first, last in zip(edges[::2], edges[1::2]):
                    text = show(rendered[offsets[first, 0] : offsets[last - 1, 1]])
                    self.loss_hash.update(text.encode())
                    self.loss_chars += len(text)

            def row(self):
                self.flush()
                values = [
                    self.ident,
                    self.turns,
                    self.turn_hash.hexdigest(),
                    self.loss_chars,
                    self.loss_hash.hexdigest(),
                    self.chars,
                ]
                return [*values, "".join(self.texts), self.ids, self.mask] if outputs else values

        def batch_of(rows, kind):
            columns = list(zip(*rows))
            kinds = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            if outputs:
                kinds += [pa.string(), pa.list_(pa.int32()), pa.list_(pa.bool_())]
                names += ["formatted", "ids", "loss_mask"]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], names=names
            )

        current, rows, kind = None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for ident, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if current is None or ident != current.ident:
                    if current is not None:
                        rows.append(current.row())
                    current = Conversation(ident)
                current.add(role, text)
                if len(rows) >= 1000:
                    yield batch_of(rows, kind)
                    rows = []
        if current is not None:
            rows.append(current.row())
        if rows:
            yield batch_of(rows, kind)

    return run


def format_conversations(
    turns: DataFrame,
    tokenizer_json: str,
    id_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    learn: Sequence[str] = ("assistant",),
    outputs: bool = True,
) -> DataFrame:
    """One row per conversation.

    Columns ``id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line
    feed per turn), ``loss_chars`` and ``loss_sha256`` of the text under the loss
    mask, ``formatted_chars``; with ``outputs`` also ``formatted``, ``ids`` and
    ``loss_mask``. The digests are read back from the formatted string and the
    mask.

    Rows are taken by turn (null first); rows that share a turn by role, then
    text, and repeated rows stay. A null role or text counts as empty, rows with
    a null id are one conversation. An empty text has no loss tokens. An empty
    table gives an empty result; other columns are ignored. Rows of a
    conversation go through one task one after the other; without ``outputs``
    only about ``FLUSH_CHARS`` characters of it are held.
    """
    read = turns.select(
        F.col(f"`{id_col}`").alias("id"),
        full_text(f"`{role_col}`").alias("role"),
        full_text(f"`{text_col}`").alias("text"),
        F.col(f"`{turn_col}`").alias("turn"),
    )
    fields = [
        read.schema["id"],
        T.StructField("n_turns", T.LongType()),
        T.StructField("turns_sha256", T.StringType()),
        T.StructField("loss_chars", T.LongType()),
        T.StructField("loss_sha256", T.StringType()),
        T.StructField("formatted_chars", T.LongType()),
    ]
    if outputs:
        fields += [
            T.StructField("formatted", T.StringType()),
            T.StructField("ids", T.ArrayType(T.IntegerType())),
            T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
        ]
    ordered = read.repartition("id").sortWithinPartitions("id", "turn", "role", "text")
    return ordered.mapInArrow(
        _format_batches(tokenizer_json, tuple(learn), outputs), T.StructType(fields)
    )
