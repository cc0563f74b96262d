"""Best-fit packing of token sequences, planned on the histogram of their lengths.

Texts become token counts, longer documents are cut, and best fit runs over
(length, count) pairs, at most one per length. The plan says where the pieces of
one length go by their rank within it; pieces then look up their place.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence
from unicodedata import is_normalized

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.ordered import with_rank
from flowweir.llm.text import full_text, shared_table

CACHED_WORDS = 600_000
TAIL = b".,!?;:$&%#*|"


# The steps of a tokenizer that can be asked word by word.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def goes_by_words(tokenizer_json: str) -> bool:
    """Whether a text's ids are those of its space-separated words in a row.

    So it is when white space is dropped, no token spans it, and special tokens are
    found by their own characters alone.
    """
    import json

    parts = json.loads(tokenizer_json)
    normalizer, splitter = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
    steps = normalizer.get("normalizers", [])
    splits = splitter.get("pretokenizers", [])
    return (
        [s["type"] for s in steps] == NORMALIZERS
        and steps[1]["pattern"] == {"Regex": r"\s+"}
        and steps[1]["content"] == " "
        and [s["type"] for s in splits] == ["Split", "ByteLevel"]
        and splits[0]["pattern"] == {"Regex": SPLIT}
        and (splits[0]["behavior"], splits[0]["invert"]) == ("Removed", True)
        and not splits[1]["add_prefix_space"]
        and not splits[1]["use_regex"]
        and parts["post_processor"] is None
        and not any(
            t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or " " in t["content"]
            for t in parts["added_tokens"]
        )
    )


class TextIds:
    """Ids of whole texts, by a tokenizer of any kind."""

    def __init__(self, tokenizer_json: str):
        import os

        # A task has one core: its threads would take those of other tasks.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        from array import array

        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", f.ids).tobytes() for f in found]


class WordIds(TextIds):
    """Ids of words, kept for the life of a Python worker and of bounded size.

    For tokenizers that go by words. They also part letters and digits from the marks
    in ``TAIL``, and lower-case; so words share the ids of their part before such marks,
    if that is ASCII or stays as it is under normalisation.
    """

    def __init__(self, tokenizer_json: str):
        super().__init__(tokenizer_json)
        # Byte-level alphabet: printable Latin-1 stands for itself, the rest follows 255.
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: 256 + n for n, b in enumerate(hidden)}
        self.words: dict[bytes, bytes] = {}
        self.cores: dict[bytes, bytes] = {}

    @classmethod
    def parts(cls, word: bytes) -> tuple[bytes, bytes]:
        """The word as a core and a tail of marks that is tokenized on its own."""
        # A control string counts in its own letter case only.
        plain = word.lower() if word.isascii() and b"<|" not in word else word
        core = plain.rstrip(TAIL)
        if core and len(core) < len(plain):
            text = core.decode()
            # Lower-casing and composing can end a word in a mark, which joins the tail.
            if text[-1].isalnum() if core.isascii() else cls.is_plain(text):
                return core, plain[len(core) :]
        return plain, b""

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of words that normalisation and splitting leave as they are.

        That holds for letters only, in lower case and composed form; they go to
        the merges directly, which is three times as fast.
        """
        merge, alphabet = self.tokenizer.model.tokenize, self.alphabet
        return [
            [t.id for t in merge(w.encode().decode("latin-1").translate(alphabet))] for w in words
        ]

    @staticmethod
    def is_plain(word: str) -> bool:
        return word.isalpha() and word == word.lower() and is_normalized("NFC", word)

    def learn_plain(self, new: set[bytes]) -> list[bytes]:
        """Learns the words of ASCII letters, before known marks or none; returns the others.

        Such letters stand for themselves in the byte-level alphabet.
        """
        from array import array

        words, cores, merge = self.words, self.cores, self.tokenizer.model.tokenize
        others = []
        for word in new:
            core = word.rstrip(TAIL)
            if not core.isalpha() or (len(core) < len(word) and word[len(core) :] not in cores):
                others.append(word)
                continue
            plain = core.lower()
            ids = cores.get(plain)
            if ids is None:
                ids = array("I", [t.id for t in merge(plain.decode())]).tobytes()
                cores[plain] = ids
            words[word] = ids + cores[word[len(core) :]] if len(core) < len(word) else ids
        return others

    def learn(self, texts: list[list[bytes]]) -> None:
        from array import array

        new = set().union(*texts).difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = set().union(*texts)
        if len(self.cores) > CACHED_WORDS:
            self.cores.clear()
        parts = {word: self.parts(word) for word in self.learn_plain(new)}
        wanted = {p for pair in parts.values() for p in pair if p}.difference(self.cores)
        fresh = [w.decode() for w in wanted]
        plain = [w for w in fresh if self.is_plain(w)]
        other = [w for w in fresh if not self.is_plain(w)]
        found = self.tokenizer.encode_batch_fast(other, add_special_tokens=False)
        for words, ids in ((plain, self.encode(plain)), (other, (f.ids for f in found))):
            self.cores.update((w.encode(), array("I", i).tobytes()) for w, i in zip(words, ids))
        cores = self.cores
        cores[b""] = b""
        self.words.update((w, cores[core] + cores[tail]) for w, (core, tail) in parts.items())

    def ids(self, texts: list[str]) -> list[bytes]:
        # Bytes split at ASCII white space only, which the tokenizer drops too.
        group = [t.encode().split() for t in texts]
        self.learn(group)
        return [b"".join(map(self.words.__getitem__, found)) for found in group]


_KNOWN: dict[str, TextIds] = {}


def known_ids(tokenizer_json: str) -> TextIds:
    """The worker's ids for this tokenizer; one tokenizer at a time is kept."""
    if tokenizer_json not in _KNOWN:
        _KNOWN.clear()
        kind = WordIds if goes_by_words(tokenizer_json) else TextIds
        _KNOWN[tokenizer_json] = kind(tokenizer_json)
    return _KNOWN[tokenizer_json]


def _piece_batches(tokenizer_json: str, capacity: int, end_id: int, with_ids: bool):
    """Function over Arrow batches of (id, text) that gives one row per piece."""

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        # Imported here, so that tasks of one worker share what it has learned.
        from flowweir.llm.packing import known_ids

        known = known_ids(tokenizer_json)
        end = np.array([end_id], "<u4").tobytes()

        for batch in batches:
            texts = batch.column(1).to_pylist()
            owner, piece, start, length, checksum, tokens = [], [], [], [], [], []
            for base in range(0, len(texts), 256):
                for at, found in enumerate(known.ids(texts[base : base + 256]), base):
                    ids = found + end
                    for number, first in enumerate(range(0, len(ids), 4 * capacity)):
                        cut = ids[first : first + 4 * capacity]
                        owner.append(at)
                        piece.append(number)
                        start.append(first // 4)
                        length.append(len(cut) // 4)
                        checksum.append(zlib.crc32(cut))
                        if with_ids:
                            tokens.append(np.frombuffer(cut, "<u4").astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(checksum, pa.int64()),
            ]
            names = ["id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def token_pieces(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each text and the end token."""
    read = docs.select(F.col(f"`{id_col}`").alias("id"), full_text(f"`{text_col}`").alias("text"))
    fields = [
        read.schema["id"],
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    return read.mapInArrow(
        _piece_batches(tokenizer_json, capacity, end_id, with_ids), T.StructType(fields)
    )


def plan_by_counts(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best fit, longest pieces first, over counts of equal lengths.

    Sequences with the same room left form runs of consecutive numbers. Of each
    length, the run with the least sufficient room takes as many pieces as fit,
    layer on layer, until the pieces are used up; what is left opens new
    sequences. Rows are (length, first rank, pieces, first sequence, sequences,
    first offset): rank ``r`` from 0 goes to sequence ``first + (r - first rank)
    % sequences`` in layer ``(r - first rank) // sequences``.
    """
    plan: list[tuple[int, ...]] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    opened = 0

    def put_back(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((first, count))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, count = runs[room].pop()
                if not runs[room]:
                    del runs[room]
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                count = -(-left // (capacity // length))
                opened += count
            # A sequence takes equal pieces until it is full, so some get all they
            # can hold and, at the end of the pieces, one gets the rest.
            layers = room // length
            used = min(count, left // layers)
            if not used:
                used, layers = 1, left
            put_back(room, first + used, count - used)
            plan.append((length, rank, layers * used, first, used, capacity - room))
            rank += layers * used
            left -= layers * used
            put_back(room - layers * length, first, used)
    return plan


def _place_batches(plan: Sequence[tuple[int, ...]]):
    """Function over Arrow batches that adds each piece's sequence and offset."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        table = np.array(plan, np.int64).reshape(-1, 6)
        table = table[np.lexsort((table[:, 1], table[:, 0]))]
        shift = np.int64(44)
        keys = (table[:, 0] << shift) + table[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False) - 1
            row = table[np.searchsorted(keys, (length << shift) + rank, side="right") - 1]
            step = rank - row[:, 1]
            sequence = row[:, 3] + step % np.maximum(row[:, 4], 1)
            offset = row[:, 5] + step // np.maximum(row[:, 4], 1) * length
            kept = [n for n in batch.schema.names if n != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in kept], pa.array(sequence), pa.array(offset)],
                names=[*kept, "sequence_id", "offset"],
            )

    return run


def pack(
    docs: DataFrame,
    tokenizer_json: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 4096,
    end_id: int = 1,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``id``, ``piece``, ``start``, ``length``, ``ids_crc32``,
    ``sequence_id`` and ``offset``, with ``with_ids`` also ``ids``.

    A text gives the tokenizer's ids without special tokens, then ``end_id``; a
    null text counts as empty and gives the end token alone. Only what is longer
    than ``capacity`` is cut. Places in a sequence are gapless from 0. Equal
    rows are packed one by one, and an empty table gives an empty result.
    Columns other than id and text are ignored, so none can clash.

    The driver holds one count per length and the plan: both are bounded by
    ``capacity``, whatever the number of documents.
    """
    pieces = shared_table(
        token_pieces(docs, tokenizer_json, id_col, text_col, capacity, end_id, with_ids), "pieces"
    )
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    plan = plan_by_counts(counts, capacity)
    ranked = with_rank(pieces, ["length"], ["id", "piece"])
    schema = T.StructType(
        [
            *pieces.schema.fields,
            T.StructField("sequence_id", T.LongType()),
            T.StructField("offset", T.LongType()),
        ]
    )
    ordered = ranked.select(*pieces.columns, "rank")
    return ordered.mapInArrow(_place_batches(plan), schema)
