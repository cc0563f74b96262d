"""Each operator against a plain version, and on the cases named in its docstring."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm import chat
from flowweir.llm.chat import format_conversations
from flowweir.llm.exact_dedup import exact_dedup
from flowweir.llm.language import identify, train
from flowweir.llm.licences import scan_licences
from flowweir.llm.mixing import mix, mix_sizes, mixed_documents, taken_parts
from flowweir.llm.oracle import SQL as LLM_SQL
from flowweir.llm.packing import WordIds, known_ids, pack, plan_by_counts
from flowweir.llm.passages import (
    _across,
    _common_batches,
    _inside,
    _many_held,
    _shared,
    _shared_batches,
    shared_passages,
)
from flowweir.llm.pii import find_personal_data
from flowweir.llm.quality import clean_lines
from flowweir.llm.queries import op7_personal_data
from flowweir.llm.simhash import simhash_groups
from flowweir.llm.vocabularies import vocabulary
from tests.llm import brute

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that the operators use themselves.
        T.StructField("row", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("digest", T.LongType()),
    ]
)
VOCABULARY = "ab cde fgh ij klmno pq rst uvw xyz the of and in to".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices(VOCABULARY, k=rng.randint(1, 3))) for _ in range(n))


def table(spark, rows):
    full = [(i, t, *rest, *[None] * (2 - len(rest)), "r", "k", 1, 2) for i, t, *rest in rows]
    return spark.createDataFrame(full, SCHEMA)


EDGES = [
    (1, None),
    (2, ""),
    (3, " \t\n\x0b\x0c\r"),
    (4, "One Two three."),
    (5, "one TWO three."),
    (6, "ÉCOLE İstanbul K"),
    (7, "école İstanbul k"),
    (8, "a b c " * 400),
    (9, prose(1, 40_000)),
    (10, prose(2, 60)),
    (10, prose(2, 60)),
    (11, "x" * 200_000),
    (12, "   \U0001f600 日本語 "),
]
NULL_ID = [(None, "one two three."), (None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return table(spark, EDGES + NULL_ID).cache()


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))


# ---- exact dedup ---------------------------------------------------------


def expected_groups(rows):
    groups = {}
    for i, text in rows:
        groups.setdefault(brute.fold(text), []).append(i)
    return {
        text: (max((i for i in ids if i is not None), default=None), len(ids))
        for text, ids in groups.items()
    }


def weak_digest(text):
    return F.substring(F.sha2(text, 256), 1, 1)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_matches_groups_by_full_text(spark, edges, weak):
    options = {"digest": weak_digest} if weak else {}
    # One byte length for all, so that a weak digest really mixes texts.
    got = exact_dedup(edges, carry=True, **options).collect()
    groups = expected_groups([(i, t) for i, t in EDGES + NULL_ID])
    assert len(got) == len(EDGES + NULL_ID)
    for r in got:
        assert (r.keep_id, r.group_size) == groups[brute.fold(r.doc.text)]
        if not weak:
            assert r.digest == brute.sha(brute.fold(r.doc.text))
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups)
    assert all(r.doc_id == r.keep_id for r in kept)


def test_exact_dedup_separates_texts_of_equal_digest(spark):
    docs = table(spark, [(i, f"text {i % 3}") for i in range(30)])
    got = exact_dedup(docs, digest=lambda text: F.lit("same")).collect()
    assert {(r.doc_id % 3, r.keep_id, r.group_size) for r in got} == {
        (0, 27, 10),
        (1, 28, 10),
        (2, 29, 10),
    }
    assert sum(r.kept for r in got) == 3


def test_exact_dedup_takes_text_ids(spark):
    docs = spark.createDataFrame([("b", "x"), ("a", "X"), (None, "x")], "doc_id string, text string")
    assert {(r.doc_id, r.keep_id, r.kept) for r in exact_dedup(docs).collect()} == {
        ("b", "b", True),
        ("a", "b", False),
        (None, "b", False),
    }


# ---- SimHash -------------------------------------------------------------


def near_rows():
    rng = random.Random(7)
    rows = []
    for base in range(6):
        words = prose(100 + base, 300).split()
        for copy in range(15):
            edited = list(words)
            for _ in range(copy % 4):
                edited[rng.randrange(len(edited))] = "edited"
            rows.append((base * 100 + copy, " ".join(edited)))
    return rows


def test_simhash_matches_brute_force(spark):
    rows = near_rows() + [r for r in EDGES if r[0] != 10]
    rows = [(n, t) for n, (_, t) in enumerate(rows)]
    got = {r.id: r for r in simhash_groups(table(spark, rows)).collect()}
    values = [brute.fingerprint(t) for _, t in rows]
    expected = brute.components([i for i, _ in rows], values, 3)
    linked = brute.components([i for i, _ in rows], values, 0)
    assert len(set(expected.values())) < len(set(linked.values())), "no near link in the test"
    for (i, _), value in zip(rows, values):
        assert got[i].fingerprint % 2**64 == value
        assert got[i].component_id == expected[i]


def test_simhash_links_every_distance_to_three(spark):
    from flowweir.llm.simhash import fingerprint_links

    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(20)]
    for v in list(values):
        for bits in (1, 2, 3, 4):
            for _ in range(10):
                other = v
                for b in rng.sample(range(64), bits):
                    other ^= 1 << b
                values.append(other)
    values = sorted(set(values))
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    links = fingerprint_links(spark.createDataFrame(signed, "fingerprint long")).collect()
    got = {frozenset((a % 2**64, b % 2**64)) for a, b in links}
    expected = {
        frozenset((a, b))
        for i, a in enumerate(values)
        for b in values[:i]
        if (a ^ b).bit_count() <= 3
    }
    assert got == expected


def test_simhash_sends_no_balls_to_every_executor(spark):
    """Spark sizes exploded balls as one row a fingerprint, far below what would be sent."""
    from flowweir.llm.simhash import fingerprint_links

    links = fingerprint_links(spark.range(50).withColumnRenamed("id", "fingerprint"))
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_simhash_repeated_and_null_ids(spark, edges):
    got = simhash_groups(edges).collect()
    assert len(got) == len(EDGES + NULL_ID)
    words_free = [r for r in got if r.fingerprint == 0]
    assert {r.component_id for r in words_free} == {1}


# ---- quality -------------------------------------------------------------


def test_quality_counts(spark, edges):
    got = by_id(clean_lines(edges).collect())
    assert len(got) == len(EDGES + NULL_ID)
    for r, (i, text) in zip(got, by_id(EDGES + NULL_ID)):
        if i in (10, None):
            continue
        words = brute.WORD.findall(text or "")
        lines = [line for line in (text or "").split("\n") if brute.WORD.search(line)]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text or "")
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == brute.repeated_words(words)
        assert r.base_failed == (len(words) < 50 or 2 * r.n_repeat_words > len(words))


def test_quality_line_rules(spark):
    good = " ".join(prose(5, 60).split()) + "."
    menu = "Home | Products | About us | Contact."
    rows = [
        (1, f"{good}\n{menu}\nAll rights reserved.\nno sentence end"),
        (2, f"{menu}\n" * 40 + good),
        (3, "\n".join(prose(50 + i, 8) for i in range(12))),
        (4, " ".join(w + "&&&" for w in good.split())),
    ]
    got = by_id(clean_lines(table(spark, rows)).collect())
    assert [r.kept for r in got] == [True, False, False, False]
    assert got[0].clean_text == good


# ---- personal data -------------------------------------------------------

PRIVATE = [
    "mail a.b_c@d-e.co.uk, x@y.z@w.v and a@b or %@-.-",
    "a@b.c_d@e.f @ .@. a@b..c",
    "ip 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 0000255.01.1.1 99999999999999999999.1.1.1",
    "card 4539 1488 0343 6467, 4539148803436467 4539148803436468 4539-1488-0343-6467 1 2 3  4",
    "phone +1 (555) 123-4567 +12 +1-2-3-4-5-6-7-8-9-0) +441234567890123456",
    "é日本 +1 (555) 123-4567 \U0001f600 4539148803436467 a@b.cd",
    "+4539 1488 0343 6467@x.yz 4539148803436467.1.1.1",
    "1 " * 5000,
    "a" * 50_000 + "@",
    "+" + "1" * 3000,
]


def test_personal_data_base_spans(spark):
    rows = list(enumerate(PRIVATE)) + [(100, None), (101, "")]
    got = by_id(find_personal_data(table(spark, rows)).collect())
    for r, (_, text) in zip(got, rows):
        base = [s for s in r.spans if s.rank < 4]
        assert ",".join(f"{s.kind}:{s.start}:{s.end}" for s in base) == brute.base_spans(text)
        assert all(0 < s.score <= 1.0 for s in r.spans)


def test_personal_data_scores_equal_statement(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    far = "x " * 30
    texts = [
        "Write to a@b.co or call +44 20 7946 0958", f"mail {far} a@b.co", "hotel 1.2.3.4", "tel +1 555 010 9999",
        f"1.2.3.4 {far} server", "1.2.3.4 server", "visa 4242424242424242", "4242424242424242 debit", None, "",
        "my ssn 123-45-6789, bank GB29 NWBK 6016 1331 9268 19 and host 10.0.0.1", "éé mail é@b.co a@b.co " * 40,
    ]
    table(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    names = ["doc_id", "spans", "scores"]
    wanted = con.sql(f"SELECT doc_id, spans, scores FROM ({LLM_SQL['op7_personal_data']}) ORDER BY 1").fetchall()
    got = op7_personal_data(spark, str(tmp_path)).select(*names).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == wanted
    assert got[0].scores == "100,80" and got[1].scores == "80" and got[5].scores == "80" and got[8].scores == ""


def test_personal_data_checksum_and_context(spark):
    rows = [
        (1, "account GB29 NWBK 6016 1331 9268 19 here"),
        (2, "account GB29 NWBK 6016 1331 9268 18 here"),
        (3, "DE89370400440532013000"),
        (4, "social security 123-45-6789"),
        (5, "part number 123-45-6789"),
        (6, "call 1.2.3.4"),
        (7, "server 1.2.3.4"),
    ]
    got = by_id(find_personal_data(table(spark, rows)).collect())
    kinds = [[s.kind for s in r.spans] for r in got]
    assert kinds == [["iban"], [], ["iban"], ["ssn"], [], ["ip"], ["ip"]]
    scores = [[round(100 * s.score) for s in r.spans] for r in got]
    # Words nearby raise every kind; 1.2.3.4 is only "called" in row 6.
    assert scores == [[100], [], [80], [60], [], [60], [80]]


# ---- mixing --------------------------------------------------------------


def mix_rows():
    rows = []
    for i in range(400):
        source = ["big", "a", "b", None, "é", "tiny"][0 if i % 3 == 0 else 1 + i % 5]
        n = 4 if source == "tiny" else 40 + i % 90
        rows.append((i, prose(i, n), "en", source))
    return rows + [(1000, None, None, "empty"), (1001, "", None, "a"), (7, prose(7, 30), "en", "a")]


def test_mix_meets_targets(spark):
    rows = mix_rows()
    docs = table(spark, rows)
    got = mix_sizes(docs).collect()
    assert len(got) == len(rows)
    size = lambda t: len(brute.WORD.findall(t or ""))
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    expected = brute.targets(sizes)
    assert any(expected[s] == 3 * sizes[s] > 0 for s in sizes), "no source is at its cap"
    source_of = {(i, size(t)): s for i, t, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        source = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[source]
        assert r.target == pytest.approx(expected[source])
        assert r.taken <= 3 * r["size"]
        taken[source] += r.taken
    for s, t in taken.items():
        assert abs(t - expected[s]) <= max(64, 0.01 * expected[s])
    again = mix_sizes(docs.repartition(7)).collect()
    assert sorted(again) == sorted(got)


def test_mix_slots_are_a_permutation(spark):
    placed, parts, slots = mix(table(spark, mix_rows()))
    rows = slots.collect()
    places = sorted((r.shard, r.place) for r in rows)
    assert len(set(places)) == len(places) and places[0] == (0, 0)
    counts = {}
    for r in rows:
        counts.setdefault(r.source_no, {}).setdefault(r.block, 0)
        counts[r.source_no][r.block] += 1
    for blocks in counts.values():
        # No block comes twice before every block came once.
        assert max(blocks.values()) <= 3
        if min(blocks.values()) < max(blocks.values()):
            assert max(blocks.values()) - min(blocks.values()) <= 1


def test_mixed_documents_hold_the_words_taken(spark):
    docs = table(spark, mix_rows())
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
    expected = {}
    for r in mix_sizes(docs).collect():
        expected[r.doc_id] = expected.get(r.doc_id, 0) + r.taken
    assert got == {i: n for i, n in expected.items() if n}


def test_mix_sends_no_parts_to_every_executor(spark):
    """Parts, block counts and arrays of parts grow with the corpus, but their files are small."""
    docs = table(spark, mix_rows())
    placed, parts, slots = mix(docs)
    for result in (taken_parts(parts, slots), mixed_documents(docs)):
        plan = result._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


# ---- packing -------------------------------------------------------------


def test_packing_round_trip(spark, edges):
    import numpy as np
    from tokenizers import Tokenizer

    text = vocabulary("word_bpe_49k.json")
    tokenizer = Tokenizer.from_str(text)
    extra = [
        (20, "a\x1cb \x85 c d <|endoftext|> x<|startoftext|>y It's 'll 2.5 é İ")]
    rows = EDGES + NULL_ID + extra
    got = pack(table(spark, rows), text, with_ids=True).collect()
    expected = []
    for i, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            expected.append((i, n, at, cut, zlib.crc32(np.array(cut, "<u4").tobytes())))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2], r[3])
    found = [(r.id, r.piece, r.start, list(r.ids), r.ids_crc32) for r in got]
    assert sorted(found, key=key) == sorted(expected, key=key)
    check_places([(r.length, r.sequence_id, r.offset) for r in got], 4096)


def test_ids_of_words_whose_last_character_changes():
    """Composing and lower-casing can end a word in a mark, which then joins the tail."""
    from unicodedata import normalize

    known = known_ids(vocabulary("word_bpe_49k.json"))
    assert isinstance(known, WordIds)
    every = [chr(c) for c in range(0x21, 0x110000) if not 0xD800 <= c < 0xE000]
    changed = [c for c in every if normalize("NFC", c).lower() != c]
    chosen = changed + every[::211]
    texts = [form.format(c) for c in chosen for form in ("{}", "a{},", "é{}!", "{}.", "{};a")]
    texts += ["ALİ,", "GELDİ.", "SAATİ!", "ISTANBULİ?", "x" + "İ" * 3 + "|*", "\u0301,", "a\u0301."]
    want = known.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
    for text, ids, found in zip(texts, known.ids(texts), want):
        assert list(memoryview(ids).cast("I")) == found.ids, ascii(text)


def test_plain_words_go_to_the_merges_directly():
    known = WordIds(vocabulary("word_bpe_49k.json"))
    known.ids([". , ! ;"])
    words = "Plain plain, PLAIN. plain! a é, x1 don't <|im_end|> im_end| im| |im ,a plain;".split()
    left = known.learn_plain({w.encode() for w in words})
    assert {w.decode() for w in left} == set("é, x1 don't <|im_end|> im_end| im| |im ,a".split())
    for word, ids in zip(words, known.ids(words)):
        assert list(memoryview(ids).cast("I")) == known.tokenizer.encode(word, add_special_tokens=False).ids


def test_packing_with_a_tokenizer_that_keeps_white_space(spark):
    from tokenizers import Tokenizer

    text = vocabulary("byte_bpe_50k.json")
    assert not isinstance(known_ids(text), WordIds)
    tokenizer = Tokenizer.from_str(text)
    rows = [(1, "Two  words, and\n\n lines "), (2, None), (3, " é"), (4, "<|endoftext|> x")]
    for r in pack(table(spark, rows), text, with_ids=True).collect():
        assert r.ids == [*tokenizer.encode(dict(rows)[r.id] or "", add_special_tokens=False).ids, 1]


def check_places(places, capacity):
    ends = {}
    for length, sequence, offset in sorted(places, key=lambda p: (p[1], p[2])):
        assert ends.get(sequence, 0) == offset
        ends[sequence] = offset + length
    assert max(ends.values()) <= capacity
    return len(ends)


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fitting = [r for r in rooms if r >= n]
        if fitting:
            rooms.remove(min(fitting))
            rooms.append(min(fitting) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([16, 50, 101])
    lengths = [rng.randint(1, rng.choice([3, capacity])) for _ in range(rng.randint(1, 300))]
    counts = {}
    for n in lengths:
        counts[n] = counts.get(n, 0) + 1
    places = []
    for length, rank, pieces, first, used, offset in plan_by_counts(counts, capacity):
        for r in range(pieces):
            places.append((length, first + r % used, offset + r // used * length))
    assert sorted(p[0] for p in places) == sorted(lengths)
    assert check_places(places, capacity) == best_fit(lengths, capacity)


# ---- chat ----------------------------------------------------------------

TURNS = [
    (1, 1, "assistant", "b <|turn|>user<|text|>x<|done|> <\\|done|> <\\\\| <||"),
    (1, 0, "user", "a\n<|endoftext|>"),
    (1, 2, "assistant", ""),
    (1, 3, "assistant", None),
    (1, None, None, "first \U0001f600 é"),
    (2, 0, "assistant", "\U0001f469‍\U0001f680 日本 é" * 300),
    (2, 0, "assistant", "tie"),
    (None, 0, "assistant", "no id"),
    (3, 0, "as<|text|>sistant", "<"),
    (3, 1, "assistant", "<"),
    (3, 1, "assistant", "|done|>"),
    (4, 0, "assistant", "word " * 300_000),
    (4, 1, "user", "word " * 300_000),
    (4, 2, "assistant", "end"),
]


def test_chat_reads_back_every_turn(spark):
    docs = spark.createDataFrame(
        [(*r, "x", 1) for r in TURNS],
        "conv_id long, turn long, role string, text string, id string, n_turns int",
    )
    got = {r.id: r for r in format_conversations(docs, vocabulary("byte_bpe_50k.json")).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    assert set(got) == {r[0] for r in TURNS}
    for conv, r in got.items():
        rows = sorted((t for t in TURNS if t[0] == conv), key=order)
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in rows)
        learned = "".join(t[3] or "" for t in rows if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(rows), brute.sha(said))
        assert (r.loss_chars, r.loss_sha256) == (len(learned), brute.sha(learned))
        assert r.formatted_chars == len(r.formatted)
        assert len(r.ids) == len(r.loss_mask)
    assert got[4].formatted_chars > chat.FLUSH_CHARS


def test_escaping_is_reversible():
    rng = random.Random(0)
    for _ in range(2000):
        text = "".join(rng.choices("<|\\a", k=rng.randint(0, 9)))
        assert "<|" not in chat.escape(text)
        assert chat.unescape(chat.escape(text)) == text


def test_lines_end_in_the_marks_of_their_writing(spark):
    words = " ".join(["शब्द"] * 9)
    marks = ["।", "॥", "۔", "؟", "።", "፧", "։", "។", "။", "།", "。", "｡", "。」", "."]
    docs = [(i, "\n".join(f"{words} {'ab' * n}{mark}" for n in range(1, 9))) for i, mark in enumerate(marks)]
    docs.append((len(marks), "\n".join(f"{words} {'ab' * n}" for n in range(1, 9))))
    got = by_id(clean_lines(table(spark, docs), repeat_percent=100).collect())
    assert all(got[i].n_good_lines == 8 and got[i].kept for i in range(len(marks)))
    assert got[-1].n_good_lines == 0 and not got[-1].kept


# ---- language ------------------------------------------------------------


def test_language_on_held_out_rows(spark):
    forms = {"aa": "ka ta ra ma na".split(), "bb": "ish osh esh ath".split(), "cc": "ñu öl éz".split()}
    rng = random.Random(1)
    rows = []
    for i in range(300):
        lang = rng.choice(list(forms))
        text = " ".join("".join(rng.choices(forms[lang], k=2)) for _ in range(30))
        rows.append((i, text, lang))
    rows += [(1000, None, "aa"), (1001, "12 --  ", "bb"), (1002, "\U0001f600", None), (None, "kata", None)]
    docs = table(spark, rows)
    got = {r.id: r for r in identify(docs, train(docs)).collect()}
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows if i is not None)
    hits = [got[i].lang_pred == lang for i, text, lang in held if i < 1000]
    assert sum(hits) / len(hits) > 0.95
    assert {got[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert got[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got.values())
    blind = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0, F.col("lang")))
    again = {r.id: r.lang_pred for r in identify(docs, train(blind)).collect()}
    assert again == {i: r.lang_pred for i, r in got.items()}


def test_language_equals_plain_kernel_ridge(spark):
    """With every learned row a landmark the scores are those of kernel ridge regression."""
    forms = {"aa": "kat tar ram nak".split(), "bb": "ish tosh resh nath".split(), "cc": "lun kal tis rem".split()}
    rng = random.Random(4)
    rows = []
    for i in range(90):
        lang = rng.choice(list(forms))
        pool = forms[lang] + forms[rng.choice(list(forms))][:2]
        rows.append((i, " ".join("".join(rng.choices(pool, k=2)) for _ in range(12)), lang))
    docs = table(spark, rows)
    model = train(docs, sample_per_label=1000, landmarks_per_label=1000, ridge=0.01)
    got = {r.id: r for r in identify(docs, model).collect()}
    learned = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5]
    texts, labels = [r[1] for r in learned], sorted(forms)
    own = np.array(brute.kernel(texts, texts))
    wanted = np.where(np.array([r[2] for r in learned])[:, None] == np.array(labels), 1.0, -1.0)
    dual = np.linalg.solve(own + 0.01 * len(learned) * np.eye(len(learned)), wanted)
    scores = np.array(brute.kernel([r[1] for r in rows], texts)) @ dual
    for (i, _, _), row in zip(rows, scores):
        assert got[i].score == pytest.approx(min(1, max(0, (1 + row.max()) / 2)), abs=2e-3)
        if np.diff(np.sort(row))[-1] > 0.01:
            assert got[i].lang_pred == labels[row.argmax()]


def test_language_without_labels(spark):
    docs = table(spark, [(1, "abc"), (2, None)])
    assert {r.lang_pred for r in identify(docs, train(docs)).collect()} == {"und"}


# ---- licences ------------------------------------------------------------


def test_licence_rules(spark):
    bsd = (
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:\n"
        "Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.\n"
        "Redistributions in binary form must reproduce the above copyright notice, this list of "
        "conditions and the following disclaimer in the documentation and/or other materials "
        "provided with the distribution."
    )
    names = (
        "Neither the name of the copyright holder nor the names of its contributors may be used to "
        "endorse or promote products derived from this software without specific prior written "
        "permission."
    )
    rows = [
        (1, "Some text. Released under the MIT License."),
        (2, bsd),
        (3, f"{bsd}\n{names}"),
        (4, f"{names}\n{bsd}"),
        (5, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (6, None),
        (7, "The MIT licence is nice."),
        (8, "You may not use this file except in compliance with the License."),
    ]
    got = {r.doc_id: r.licences for r in scan_licences(table(spark, rows)).collect()}
    assert got == {
        1: ["MIT"],
        2: ["BSD-2-Clause"],
        3: ["BSD-3-Clause"],
        4: ["BSD-2-Clause"],
        5: ["Apache-2.0", "CC-BY-NC-4.0"],
        6: [],
        7: [],
        8: [],
    }


OFFICIAL = {
    "MIT": """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE""",
    "Apache-2.0": """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

     http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.""",
    "GPL-3.0": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
 * GNU General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file""",
}
OFFICIAL["BSD-3-Clause"] = OFFICIAL["BSD-2-Clause"] + """

3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission."""


def test_licences_of_official_texts(spark):
    spdx = {"MIT": "MIT", "Apache-2.0": "Apache-2.0", "GPL-3.0": "GPL-3.0-or-later"}
    spdx |= {"GPL-2.0": "GPL-2.0-only"}
    rows = [(f"w {name}", text) for name, text in OFFICIAL.items()]
    rows += [(f"s {name}", f"// SPDX-License-Identifier: {i}\nint a;") for name, i in spdx.items()]
    rows += [("- apart", "Licensed under\n\nthe MIT License of sorts")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r.doc_id: r for r in scan_licences(docs).collect()}
    for ident, row in got.items():
        assert row.licences == ([] if ident[0] == "-" else [ident[2:]]), ident
    assert got["w MIT"].sentence_ids == ["mit-notice", "mit-grant", "mit-condition", "as-is"]
    assert got["w GPL-3.0"].sentence_ids == ["gpl-grant", "gpl-warranty"]
    assert len(got["w Apache-2.0"].sentence_ids) == 3


# ---- passages ------------------------------------------------------------


def passage_rows():
    passage, long = prose(900, 60), prose(901, 400)
    rng = random.Random(5)
    rows = []
    for i in range(30):
        own = prose(i, 120).split()
        if i % 3 == 0:
            at = rng.randrange(len(own))
            own[at:at] = passage.split()
        if i % 5 == 0:
            edited = long.split()
            for p in range(20, 400, 40):
                edited[p : p + 1] = ["edit", str(i)] if i % 2 else []
            own += edited
        rows.append((i, " ".join(own)))
    return rows + [(50, rows[7][1].upper()), (51, rows[7][1]), (52, "the of " * 500), (53, "the of " * 300)]


def test_passages_cover_every_shared_run(spark):
    rows = passage_rows()
    got = shared_passages(table(spark, rows)).collect()
    texts = dict(rows)
    spans = {}
    for r in got:
        spans.setdefault(r.doc_id, []).append((r.start, r.end))
        spans.setdefault(r.other_id, []).append((r.other_start, r.other_end))
        a = brute.WORD.findall(brute.fold(texts[r.doc_id]))[r.start : r.end]
        b = brute.WORD.findall(brute.fold(texts[r.other_id]))[r.other_start : r.other_end]
        assert len(a) == r.end - r.start and len(b) == r.other_end - r.other_start
        assert min(len(a), len(b)) >= 50 and r.matches >= 0.8 * max(len(a), len(b))
        assert r.matches <= min(len(a), len(b))
        assert r.doc_id != r.other_id
    ids = [i for i, _ in rows]
    for n, at in brute.shared_runs([t for _, t in rows], 50):
        assert any(s < at + 50 and at < e for s, e in spans.get(ids[n], [])), (ids[n], at)
    linked = {frozenset((r.doc_id, r.other_id)) for r in got}
    assert {i for pair in linked for i in pair} >= {0, 5, 10, 15, 20, 25, 7, 50, 51, 52, 53}
    assert not {1, 2, 4, 8} & set(spans)
    # Copies are tied to the first one: n - 1 ties, not all pairs.
    assert len(got) < 3 * len(rows)


def edited_passage(words, identity, seed):
    """The words with 1 - identity of them replaced, dropped or doubled, spread evenly."""
    rng = random.Random(seed)
    out, edits = list(words), int(len(words) * (1 - identity) + 1e-9)
    for n in reversed(range(edits)):
        at = (2 * n + 1) * len(words) // (2 * edits)
        new = f"new{rng.randrange(10**9)}"
        out[at : at + 1] = ([new], [new], [out[at], new], [])[rng.randrange(4)]
    return out


def test_passages_with_scattered_edits(spark):
    rng = random.Random(11)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, planted = [], []
    for n, (length, identity) in enumerate(
        (length, identity) for length in (52, 60, 80, 100) for identity in (0.82, 0.85, 0.9, 0.95)
        for _ in range(5)
    ):
        passage = fresh(length)
        edited = edited_passage(passage, identity, n)
        rows.append((2 * n, " ".join(fresh(70) + passage + fresh(70))))
        rows.append((2 * n + 1, " ".join(fresh(40) + edited + fresh(90))))
        sides = sorted((len(passage), len(edited)))
        if sides[0] >= 50 and brute.common_words(passage, edited) >= 0.8 * sides[1]:
            planted.append((2 * n, 2 * n + 1))
    got = set()
    for r in shared_passages(table(spark, rows)).collect():
        assert r.matches >= 0.8 * max(r.end - r.start, r.other_end - r.other_start)
        got.add(tuple(sorted((r.doc_id, r.other_id))))
    assert len(planted) > 60 and got >= set(planted)
    assert all(a % 2 == 0 and b == a + 1 for a, b in got)


def test_passage_behind_earlier_excerpts(spark):
    rng = random.Random(12)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, expected = [], set()
    for n in range(0, 60, 6):
        passage = fresh(60)
        parts = (passage[:45], passage[15:], passage, passage)
        rows += [(n + i, " ".join(fresh(30) + p + fresh(30))) for i, p in enumerate(parts)]
        expected.add((n + 2, n + 3))
    ordered = table(spark, rows).coalesce(1)
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in shared_passages(ordered).collect()}
    assert got >= expected


def test_passage_with_excerpts_before_both_holders(spark):
    rng = random.Random(13)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, expected = [], set()
    for n in range(0, 240, 6):
        passage = fresh(60)
        parts = (passage[:45], passage[15:], passage) * 2
        rows += [(n + i, " ".join(fresh(30) + p + fresh(30))) for i, p in enumerate(parts)]
        expected.add((n + 2, n + 5))
    ordered = table(spark, rows).coalesce(1)
    got = {tuple(sorted((r.doc_id, r.other_id))) for r in shared_passages(ordered).collect()}
    assert got == expected
    once = shared_passages(ordered, rounds=1).count()
    assert once < len(expected)


def linked(spark, parts_of, cases=6):
    """Pairs of numbers within a case that are linked; a case has these texts in this order."""
    rng = random.Random(15)
    fresh = lambda n: [f"v{rng.randrange(10**7)}" for _ in range(n)]
    rows, size = [], 1000
    for n in range(cases):
        for i, part in enumerate(parts_of(fresh(60))):
            rows.append((n * size + i, " ".join(fresh(70) + part + fresh(70))))
    ordered = table(spark, rows).coalesce(1)
    pairs = [sorted((r.doc_id, r.other_id)) for r in shared_passages(ordered).collect()]
    assert len(pairs) == len({tuple(p) for p in pairs})
    assert all(a // size == b // size for a, b in pairs)
    return [{(a % size, b % size) for a, b in pairs if a // size == n} for n in range(cases)]


@pytest.mark.parametrize("times", [1, 12])
def test_passage_behind_short_excerpts_before_both_holders(spark, times):
    """Excerpts of 20 words, which come to nothing with either holder, by few and by many texts."""

    def parts(passage):
        excerpts = [passage[:20], passage[20:40], passage[40:]] * times
        return [*excerpts, passage, *excerpts, passage]

    assert linked(spark, parts) == [{(3 * times, 6 * times + 1)}] * 6


def test_passage_behind_overlapping_short_excerpts(spark):
    """No seed and no pair of neighbouring seeds is rare, and no excerpt has enough in common."""

    def parts(passage):
        excerpts = [passage[:30], passage[15:45], passage[30:]] * 12
        return [*excerpts, passage, *excerpts, passage]

    assert linked(spark, parts) == [{(36, 73)}] * 6


@pytest.mark.parametrize("layers", [4, 14])
def test_passage_behind_more_layers_of_excerpts_than_rounds(spark, layers):
    def parts(passage):
        excerpts = [passage[:45], passage[15:]] * layers
        return [*excerpts, passage, *excerpts, passage]

    assert linked(spark, parts) == [{(2 * layers, 4 * layers + 1)}] * 6


def test_every_pair_of_few_texts_with_a_passage(spark):
    got = linked(spark, lambda passage: [passage] * 7)
    assert got == [{(a, b) for b in range(7) for a in range(b)}] * 6


def test_many_texts_with_a_passage_are_joined(spark):
    got = linked(spark, lambda passage: [passage] * 40, cases=2)
    for pairs in got:
        assert {b for _, b in pairs} == set(range(1, 40)) and len(pairs) < 3 * 40


def test_copies_stand_for_one_text(spark):
    passage = prose(31, 60)
    one, other = prose(32, 70) + " " + passage, passage + " " + prose(33, 80)
    rows = [(i, one.upper() if i % 2 else one) for i in range(30)] + [(i, other) for i in (30, 31)]
    rows += [(32, "short text"), (33, "short text")]
    got = shared_passages(table(spark, rows).coalesce(1)).collect()
    whole = {(r.doc_id, r.other_id) for r in got if r.matches >= 120}
    assert whole == {(i, 0) for i in range(1, 30)} | {(31, 30)}
    assert {(r.doc_id, r.other_id) for r in got} - whole == {(30, 0)}


def test_common_seed_over_blocks_and_batches(spark):
    """Ties of seeds whose holders lie in several blocks, against a plain loop."""
    rng = random.Random(16)
    entries = sorted({(rng.randrange(9), rng.randrange(400), rng.randrange(3)) for _ in range(900)})
    entries += [(20, i, 0) for i in range(8)] + [(21, 3, 0)]
    holders, places = {}, {}
    for s, r, a in entries:
        holders.setdefault(s, [])
        if r not in holders[s][-1:]:
            holders[s].append(r)
            places[s, r] = a
    expected = set()
    for s, r, a in entries:
        before = [h for h in holders[s] if h < r]
        for h in before if len(holders[s]) <= 10 else before[-1:] if a == places[s, r] else []:
            expected.add((r, h, a, places[s, h]))
    possible = {(r, h, a, places[s, h]) for s, r, a in entries for h in holders[s] if h < r}
    kinds = "seed long, row long, at int"
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    for whole_blocks in ("true", "false"):
        spark.conf.set(coalesce, whole_blocks)
        try:
            seeds = _shared(spark.createDataFrame(entries, kinds), 10)
            across, firsts = _across(seeds, 10)
            got = {tuple(r) for r in _inside(seeds).unionByName(across).collect()}
            first = {r.seed: r.first for r in _many_held(seeds, firsts, 10).collect()}
        finally:
            spark.conf.set(coalesce, "true")
        assert expected <= got <= possible
        for s, h in holders.items():
            met = [(r, h[0], a, places[s, h[0]]) in got for t, r, a in entries if t == s and r != h[0]]
            assert len(h) <= 10 or first[s] == -1 or first[s] == h[0] and all(met)
    assert seeds.select("block").distinct().count() > 1


def test_screen_keeps_what_common_words_allow(spark):
    """The screen against a plain subsequence count, with ends of every length up to 64."""
    rng = random.Random(14)
    rows = []
    for n in range(400):
        a = bytes(rng.randrange(6) for _ in range(rng.randrange(4, 132)))
        b = bytes(rng.randrange(6) for _ in range(rng.randrange(4, 132)))
        x, f = rng.randrange(min(65, len(a) - 3)), rng.randrange(min(65, len(b) - 3))
        a, b = a[: x + 68], b[: f + 68]
        rows.append((n, n, [x + 9], [f + 5], 9, 5, bytearray(a), bytearray(b)))
    kinds = "row long, other long, xs array<int>, fs array<int>"
    chains = spark.createDataFrame(
        rows, kinds + ", x_from int, f_from int, x_words binary, f_words binary"
    )
    got = {r.row for r in chains.mapInArrow(_common_batches(4, 40), kinds).collect()}

    def bound(row):
        _, _, (x,), (f,), x_from, f_from, a, b = row
        x, f = x - x_from, f - f_from
        return 4 + brute.common_words(a[:x], b[:f]) + brute.common_words(a[x + 4 :], b[f + 4 :])

    assert got == {r[0] for r in rows if bound(r) >= 40}
    assert 0 < len(got) < len(rows)


def test_hot_seed_goes_on_across_batches_and_blocks(spark):
    entries = [(7, i, i % 5) for i in range(70_000)] + [(9, 1, 0), (11, 1, 0), (11, 2, 3), (13, 5, 1)]
    seeds = spark.createDataFrame(entries, "seed long, row long, at int").coalesce(1)
    kinds = "seed long, row long, at int, previous long, there int, block int"
    got = seeds.sortWithinPartitions("seed", "row").mapInArrow(_shared_batches, kinds).collect()
    assert [(r.seed, r.row, r.previous, r.there) for r in got if r.seed == 7] == [
        (7, i, i - 1, (i - 1) % 5 if i else -1) for i in range(70_000)
    ]
    assert [(r.seed, r.row, r.previous, r.there) for r in got if r.seed != 7] == [
        (11, 1, -1, -1), (11, 2, 1, 0), (13, 5, -1, -1)
    ]


# ---- all operators -------------------------------------------------------


def every(docs):
    yield exact_dedup(docs)
    yield simhash_groups(docs)
    yield clean_lines(docs)
    yield find_personal_data(docs)
    yield scan_licences(docs)
    yield mix_sizes(docs)
    yield mixed_documents(docs.withColumn("n_chars", F.lit(1).cast("long")))
    yield pack(docs, vocabulary("word_bpe_49k.json"))
    yield identify(docs, train(docs))
    yield shared_passages(docs)


def test_empty_table(spark):
    for result in every(table(spark, [])):
        assert result.collect() == []
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string, id string")
    assert format_conversations(turns, vocabulary("byte_bpe_50k.json")).collect() == []


def test_odd_rows(spark, edges):
    rows = len(EDGES + NULL_ID)
    for n, result in enumerate(every(edges)):
        count = result.count()
        if n < 6 or n == 8:
            assert count == rows
