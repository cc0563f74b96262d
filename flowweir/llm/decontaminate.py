"""Benchmark decontamination with suffix arrays over the training texts.

Each task cuts its documents into shards of bounded size, builds the suffix array
of a shard's words and binary-searches every suffix of every benchmark item in it.
What is left of the interval after a window's length are the window's places; going
on until the interval is empty gives the longest verbatim match at each place.

A benchmark of any size is taken in blocks of bounded size, one pass per block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.text import full_text, shared_table

WINDOW = 10
SHARD_WORDS = 2_000_000
BLOCK_BYTES = 16 << 20

_LETTERS = b"0123456789abcdefghijklmnopqrstuvwxyz"
# A-Z to a-z; ASCII that is in no word becomes a space; other bytes are parts of letters.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _LETTERS else 32 for b in range(256)
)

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]
                )
            ),
        ),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("longest", T.LongType()),
        T.StructField("longest_start", T.LongType()),
    ]
)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Benchmark:
    """Items of one block: their words as numbers, item after item with 0 between."""

    numbers: dict[bytes, int]
    words: np.ndarray  # int32, ends with 0
    suffixes: np.ndarray  # places where a window starts
    needed: np.ndarray  # its window's length, for each of them
    text_of: np.ndarray  # number of its text, for each of them
    ids: list[list[str | None]]  # of each text
    deepest: int


def prepare_benchmark(items: list[tuple[str | None, bytes]], window: int = WINDOW) -> Benchmark:
    """Equal texts are kept once, with all their ids; texts without words are left out."""
    texts: dict[tuple[bytes, ...], list[str | None]] = {}
    for ident, text in items:
        found = tuple(words_of(text))
        if found:
            texts.setdefault(found, []).append(ident)
    numbers: dict[bytes, int] = {}
    words, suffixes, needed, text_of = [], [], [], []
    for number, text in enumerate(texts):
        need = min(window, len(text))
        starts = range(len(words), len(words) + len(text) - need + 1)
        suffixes += starts
        needed += [need] * len(starts)
        text_of += [number] * len(starts)
        words += [numbers.setdefault(w, len(numbers) + 1) for w in text]
        words.append(0)
    return Benchmark(
        numbers,
        np.array(words or [0], np.int32),
        np.array(suffixes, np.int64),
        np.array(needed, np.int64),
        np.array(text_of, np.int64),
        list(texts.values()),
        max(map(len, texts), default=0),
    )


def suffix_array(words: np.ndarray, deepest: int, largest: int) -> np.ndarray:
    """Places of all words but 0, sorted by their next ``deepest`` words.

    0 ends a suffix: what follows it makes no difference. Words are numbers from 1
    to ``largest``, and ``words`` ends with 0. The first words are sorted in one
    packed key; groups that are still equal are split by the rank of what follows,
    doubling the length that is sorted each time.
    """
    n = len(words)
    bits = max(1, int(largest).bit_length())
    packed = min(63 // bits, deepest, 8)
    padded = np.concatenate([words, np.zeros(packed, words.dtype)])
    key = padded[:n].astype(np.int64)
    live = key > 0
    for step in range(1, packed):
        live = live & (padded[step : n + step] > 0)
        key <<= bits
        # Past the end of a suffix the key is filled with zeros.
        key |= np.where(live, padded[step : n + step], 0)
    order = np.flatnonzero(words)
    key = key[order]
    by_key = np.argsort(key, kind="stable")
    order, key = order[by_key], key[by_key]
    if packed >= deepest or not len(order):
        return order
    place = np.arange(len(order))
    first = np.empty(len(order), bool)
    first[0] = True
    np.not_equal(key[1:], key[:-1], out=first[1:])
    head = np.maximum.accumulate(np.where(first, place, 0))
    rank = np.zeros(n, np.int64)
    rank[order] = head + 1
    ends = np.flatnonzero(words == 0)
    run = ends[np.searchsorted(ends, order)] - order
    single = first & np.append(first[1:], True)
    active = np.flatnonzero(~single & (run >= packed))
    length = packed
    while length < deepest and len(active):
        at = order[active]
        pair = rank[at] * (n + 1) + rank[at + length]
        by_pair = np.argsort(pair, kind="stable")
        at, pair = at[by_pair], pair[by_pair]
        order[active] = at
        first = np.empty(len(active), bool)
        first[0] = True
        np.not_equal(pair[1:], pair[:-1], out=first[1:])
        rank[at] = np.maximum.accumulate(np.where(first, active, 0)) + 1
        length *= 2
        single = first & np.append(first[1:], True)
        run = ends[np.searchsorted(ends, at)] - at
        active = active[~single & (run >= length)]
    return order


def _bound(words, order, low, high, depth, wanted, above):
    """First place in each [low, high) whose word at ``depth`` is not below ``wanted``."""
    low, high = low.copy(), high.copy()
    open_ = np.flatnonzero(low < high)
    while len(open_):
        middle = (low[open_] + high[open_]) >> 1
        word = words[order[middle] + depth]
        goes_up = word <= wanted[open_] if above else word < wanted[open_]
        low[open_[goes_up]] = middle[goes_up] + 1
        high[open_[~goes_up]] = middle[~goes_up]
        open_ = open_[low[open_] < high[open_]]
    return low


def _members(low, high):
    """All numbers of the given ranges, and for each the number of its range."""
    sizes = high - low
    owner = np.repeat(np.arange(len(low)), sizes)
    before = np.cumsum(sizes) - sizes
    return np.arange(sizes.sum()) - before[owner] + low[owner], owner


def search(words: np.ndarray, order: np.ndarray, bench: Benchmark):
    """Binary-search every suffix of the benchmark in the suffix array ``order``.

    Returns the longest match that starts at each word (0 where no window does),
    and per interval of a found window (low, high, numbers of the texts with it).
    """
    longest = np.zeros(len(words), np.int32)
    found: dict[tuple[int, int], set[int]] = {}
    counts = np.bincount(words, minlength=len(bench.numbers) + 1)
    counts[0] = 0
    upto = np.cumsum(counts)
    suffix, needed, text_of = bench.suffixes, bench.needed, bench.text_of
    wanted = bench.words[suffix]
    high = upto[wanted]
    low = high - counts[wanted]
    depth = 1
    while True:
        some = low < high
        suffix, needed, text_of = suffix[some], needed[some], text_of[some]
        low, high = low[some], high[some]
        if not len(suffix):
            return longest, found
        for i in np.flatnonzero(needed == depth):
            found.setdefault((int(low[i]), int(high[i])), set()).add(int(text_of[i]))
        wanted = bench.words[suffix + depth]
        next_low = _bound(words, order, low, high, depth, wanted, above=False)
        next_high = _bound(words, order, next_low, high, depth, wanted, above=True)
        over = wanted == 0
        next_high[over] = next_low[over] = high[over]
        # Places that leave the interval here match this far and no further.
        full = needed <= depth
        left = np.stack([low, next_low, next_high, high])[:, full]
        if left.shape[1]:
            left = np.unique(left, axis=1)
            gone, _ = _members(np.append(left[0], left[2]), np.append(left[1], left[3]))
            at = order[gone]
            longest[at] = np.maximum(longest[at], depth)
        low, high = next_low, next_high
        depth += 1


def scan_shard(texts: list[bytes], earlier: list[dict | None], bench: Benchmark) -> list[dict]:
    """``FOUND`` of each text; ``earlier`` holds what other blocks have found."""
    number = bench.numbers.get
    pieces, starts, sizes, total = [], [], [], 0
    end = np.zeros(1, np.int32)
    for text in texts:
        split = words_of(text)
        starts.append(total)
        sizes.append(len(split))
        total += len(split) + 1
        pieces += [np.array([number(w, 0) for w in split], np.int32), end]
    words = np.concatenate([*pieces, end])
    results = [
        {"n_words": size, "spans": [], "items": [], "longest": 0, "longest_start": None}
        for size in sizes
    ]
    hits, items = np.zeros(0, np.int64), {}
    if bench.deepest:
        order = suffix_array(words, bench.deepest, len(bench.numbers))
        longest, found = search(words, order, bench)
        hits = np.flatnonzero(longest)
        lists = {}
        for place, texts_of in found.items():
            lists.setdefault(frozenset(texts_of), []).append(place)
        for texts_of, places in lists.items():
            ranges = np.array(places, np.int64)
            at, _ = _members(ranges[:, 0], ranges[:, 1])
            for doc in np.unique(np.searchsorted(starts, order[at], side="right") - 1):
                items.setdefault(int(doc), set()).update(texts_of)
    edges = np.zeros(len(words) + 1, np.int64)
    if len(hits):
        np.add.at(edges, hits, 1)
        np.add.at(edges, hits + longest[hits], -1)
    touched = set(items)
    for doc, old in enumerate(earlier):
        if old and old["spans"]:
            touched.add(doc)
            for span in old["spans"]:
                edges[starts[doc] + span["start"]] += 1
                edges[starts[doc] + span["end"]] -= 1
    inside = np.cumsum(edges[:-1]) > 0
    for doc in touched:
        first, size, result = starts[doc], sizes[doc], results[doc]
        own = np.diff(np.concatenate([[0], inside[first : first + size].view(np.int8), [0]]))
        result["spans"] = [
            {"start": int(a), "end": int(b)}
            for a, b in zip(np.flatnonzero(own == 1), np.flatnonzero(own == -1))
        ]
        names = {ident for text in items.get(doc, ()) for ident in bench.ids[text]}
        if doc in items:
            part = longest[first : first + size]
            result["longest_start"] = int(part.argmax())
            result["longest"] = int(part.max())
        old = earlier[doc]
        if old:
            names.update(old["items"])
            if old["longest"] >= result["longest"]:
                result["longest"], result["longest_start"] = old["longest"], old["longest_start"]
        result["items"] = sorted(names, key=lambda s: (s is None, s))
    return results


def _scan_batches(bench: Benchmark, shard_words: int):
    """Function over Arrow batches (doc, text, found) that fills ``found``."""

    def run(batches):
        import pyarrow as pa

        kind = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            earlier = batch.column("found").to_pylist()
            found, low, room = [], 0, 0
            for at, text in enumerate(texts):
                # A word takes a byte and a separator at least.
                room += len(text) // 2 + 1
                if room >= 2 * shard_words or at == len(texts) - 1:
                    found += scan_shard(texts[low : at + 1], earlier[low : at + 1], bench)
                    low, room = at + 1, 0
            kind = batch.schema.field("found").type
            columns = [batch.column("doc"), batch.column("text"), pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc", "text", "found"])

    return run


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    shard_words: int = SHARD_WORDS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Columns ``doc`` (struct of the given columns) and what was found in its text.

    ``n_words``, ``spans`` (start and end in words of every hit run), ``items``
    (ids of the items with an occurring window, as sorted strings), ``longest`` (words
    of the longest verbatim match, 0 if no window occurs) and ``longest_start``.

    A word is a longest run of a-z, 0-9 and characters beyond ASCII after A-Z are
    lower-cased; a window is ``window`` of them in a row in one item, or the whole of
    a shorter one. Null and empty texts have no words: such a document has no hit,
    such an item no window. Items with equal words count each, an id that
    several items share counts once, and a null id is listed last. Equal documents
    are scanned one by one. An empty table of either kind gives no hits. The given
    columns stay in ``doc``, so no name can clash.

    A shard has about ``shard_words`` words; a longer text is a shard of its own.
    The driver holds one block of items: those of about ``block_bytes`` of
    text, or one longer item.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"),
        full_text(f"`{text_col}`").cast("binary").alias("text"),
        F.lit(None).cast(FOUND).alias("found"),
    )
    schema = rows.schema
    items = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"),
        full_text(f"`{item_text_col}`").alias("text"),
    )
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + 2 * size // block_bytes
    if blocks > 1:
        dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
        items = shared_table(dealt.repartition("block"), "benchmark")
    for block in range(blocks):
        part = items if blocks == 1 else items.filter(F.col("block") == block)
        listed = [(r[0], r[1].encode()) for r in part.select("item", "text").collect()]
        bench = prepare_benchmark(listed, window)
        rows = rows.mapInArrow(_scan_batches(bench, shard_words), schema)
        if block < blocks - 1:
            rows = shared_table(rows, "decontaminated")
    return rows.select("doc", *[F.col(f"found.{f.name}").alias(f.name) for f in FOUND.fields])


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """The documents without any hit, with their own columns."""
    clean = find_contamination(docs, benchmark, **settings).filter(F.size("spans") == 0)
    return clean.select("doc.*")
