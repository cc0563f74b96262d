"""Decontamination, manifest and whitening against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.decontaminate import (
    find_contamination,
    prepare_benchmark,
    remove_contaminated,
    scan_shard,
    suffix_array,
    words_of,
)
from flowweir.llm.manifest import (
    build_manifest,
    derive_nodes,
    digest,
    fold,
    level_sizes,
    missing_nodes,
    multiproofs,
    siblings,
)
from flowweir.llm.text import ascii_lower
from flowweir.llm.whitening import fit_whitening, scaled, usable, whiten

# ---- benchmark decontamination -------------------------------------------


def plain_hits(text, items, window=10):
    """Words, hit places and item ids by trying every window at every place."""
    words, hit, names = words_of(text), set(), set()
    for ident, item in items:
        own = words_of(item)
        n = min(window, len(own))
        wins = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if own else set()
        for p in range(len(words) - n + 1):
            if tuple(words[p : p + n]) in wins:
                names.add(ident)
                hit.update(range(p, p + n))
    return len(words), hit, names


def plain_longest(text, items, window=10):
    words, best = words_of(text), 0
    for _, item in items:
        own = words_of(item)
        for i in range(len(own)):
            for p in range(len(words)):
                n = 0
                while i + n < len(own) and p + n < len(words) and own[i + n] == words[p + n]:
                    n += 1
                if n >= window or n == len(own) < window:
                    best = max(best, n)
    return best


@pytest.mark.parametrize("seed", range(40))
def test_shard_equals_every_window_at_every_place(seed):
    rng = random.Random(seed)
    words = [f"w{i}".encode() for i in range(rng.choice([1, 2, 3, 6]))]
    window = rng.choice([3, 5, 10])
    texts = [b" ".join(rng.choices([*words, b"-zz"], k=rng.randint(0, 60))) for _ in range(5)]
    texts += texts[:2]
    items = [(str(i), b" ".join(rng.choices(words, k=rng.randint(0, 15)))) for i in range(4)]
    items += [("cut", texts[0][:50]), ("same", items[0][1]), (None, items[1][1])]
    found = scan_shard(texts, [None] * len(texts), prepare_benchmark(items, window))
    for text, row in zip(texts, found):
        n, hit, names = plain_hits(text, items, window)
        places = {p for s in row["spans"] for p in range(s["start"], s["end"])}
        assert (row["n_words"], places, set(row["items"])) == (n, hit, names)
        assert row["longest"] == plain_longest(text, items, window)


def test_suffix_array_sorts_to_the_depth_asked_for():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 3, 400).astype(np.int32)
    words[100:200] = words[200:300]
    words[-1] = 0

    def suffix(p):
        return words[p : p + np.argmin(words[p:] != 0)].tolist()[:64]

    order = suffix_array(words, 64, 2)
    assert sorted(order) == np.flatnonzero(words).tolist()
    assert [suffix(p) for p in order] == sorted(map(suffix, order))


BENCH = [
    (1, "the quick brown fox jumps over the lazy dog again and again"),
    (2, "Short Item"),
    (3, None),
    (4, " ... "),
    (5, "short item"),
    (None, "the QUICK brown fox jumps over the lazy dog again"),
    (7, "été à la plage avec toute la famille réunie hier soir"),
]
TEXTS = [
    (1, "so the quick, brown fox jumps over the lazy dog AGAIN and then"),
    (2, None),
    (3, ""),
    (4, "a short\nitem, and shortitem"),
    (5, "the quick brown fox jumps over the lazy dog"),
    (6, "x " * 30_000 + "été à la plage avec toute la famille réunie hier soir"),
    (6, "x " * 30_000 + "été à la plage avec toute la famille réunie hier soir"),
    (None, "Ete a la plage"),
]
DOCS = "doc_id long, text string, words string, found string, doc string"


def doc_table(spark, rows):
    return spark.createDataFrame([(*r, "w", "f", "d") for r in rows], DOCS)


@pytest.mark.parametrize("block_bytes", [1 << 20, 64])
def test_documents_in_blocks_and_shards(spark, block_bytes):
    docs, bench = doc_table(spark, TEXTS), spark.createDataFrame(BENCH, "item_id long, text string")
    found = find_contamination(docs, bench, shard_words=20_000, block_bytes=block_bytes).collect()
    items = [(None if i is None else str(i), (t or "").encode()) for i, t in BENCH]
    assert len(found) == len(TEXTS)
    for row in found:
        text = (row.doc.text or "").encode()
        n, hit, names = plain_hits(text, items)
        places = {p for s in row.spans for p in range(s.start, s.end)}
        assert (row.n_words, places, set(row["items"])) == (n, hit, names)
        assert (row.longest_start is None) == (not hit)
    kept = remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5]


def test_decontamination_of_empty_tables(spark):
    docs, bench = doc_table(spark, TEXTS), spark.createDataFrame(BENCH, "item_id long, text string")
    assert find_contamination(docs.limit(0), bench).count() == 0
    assert remove_contaminated(docs, bench.limit(0)).count() == len(TEXTS)


# ---- Merkle manifest -----------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row):
    parts = []
    for value in row:
        text = None if value is None else str(value)
        parts.append("-" if text is None else f"{len(text.encode())}:{text}")
    return sha("".join(parts))


def plain_tree(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([sha("".join(below[i : i + 16])) for i in range(0, len(below), 16)])
    return levels


def plain_path(levels, i):
    path = []
    for level in levels[:-1]:
        first = i // 16 * 16
        run = level[first : first + 16]
        path.append((i - first, run[: i - first] + run[i - first + 1 :]))
        i //= 16
    return path


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof, folded root of every row."""
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = {s: [r for r in rows if r[1] == s] for s in sources}
    for s, group in groups.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = {s: plain_tree([plain_leaf(r) for r in group]) for s, group in groups.items()}
    upper = plain_tree([trees[s][-1][0] for s in sources])
    root, out = upper[-1][0], []
    for at, s in enumerate(sources):
        for i, row in enumerate(groups[s]):
            path = plain_path(trees[s], i) + plain_path(upper, at)
            text = row[4]
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and text:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = plain_leaf((*row[:4], text))
            for place, beside in path:
                folded = sha("".join([*beside[:place], folded, *beside[place:]]))
            proof = sha("".join(x for _, beside in path for x in beside))
            out.append((row[0], trees[s][0][i], trees[s][-1][0], root, proof, folded))
    return out


def manifest_rows():
    rng = random.Random(8)
    rows = [(i, "hot", "en", i % 7, f"Text {i}" if i % 5 else None) for i in range(4500)]
    rows += [(10_000 + i, f"s{i % 40}", None, None, "É " * i) for i in range(300)]
    rows += [(20_000, "alone", "de", 3, ""), (None, None, None, None, None), (None, "hot", "x", 1, "N")]
    rows += [(7, "hot", "en", 0, "Text 7"), (7, "hot", "en", 0, "other"), (30_000, None, "fr", 1, "L" * 200_000)]
    rng.shuffle(rows)
    return rows


MANIFEST = "doc_id long, source string, lang string, n_chars long, text string"


def tampered():
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return {"text": F.when(fifth, ascii_lower(F.col("text"))).otherwise(F.col("text"))}


@pytest.mark.parametrize("part_leaves", [100, 4096])
def test_manifest_equals_the_plain_one(spark, part_leaves):
    rows = manifest_rows()
    extra = ", tree string, leaf long, part string, id string"
    docs = spark.createDataFrame([(*r, "t", 1, "p", "i") for r in rows], MANIFEST + extra)
    manifest = build_manifest(docs, tampered=tampered(), part_leaves=part_leaves)
    got = multiproofs(manifest).collect()
    key = lambda r: tuple((v is not None, v) for v in r)
    found = [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in got]
    assert sorted(found, key=key) == sorted(plain_manifest(rows), key=key)
    assert all(r.verified == (r.folded_root == r.root) for r in got)
    assert {r.verified for r in got} == {True, False}


def test_proofs_of_a_selection_fetch_only_what_they_lack(spark):
    docs = spark.createDataFrame(manifest_rows(), MANIFEST)
    manifest = build_manifest(docs)
    chosen = manifest.leaves.filter(F.col("id") % 97 == 0)
    got = multiproofs(manifest, chosen, with_siblings=True).collect()
    whole = {r.id: r for r in multiproofs(manifest).collect()}
    assert len(got) == chosen.count()
    for row in got:
        assert row.verified and row.proof_sha256 == whole[row.id].proof_sha256
        assert digest(row.siblings) == row.proof_sha256
        assert len(row.places) >= 1


@pytest.mark.parametrize("size", [1, 2, 15, 16, 17, 255, 257, 5000])
def test_octopus_fetches_the_least_nodes(size):
    rng = random.Random(size)
    tree = plain_tree([sha(str(i)) for i in range(size)])
    assert level_sizes(size) == list(map(len, tree))
    chosen = sorted(rng.sample(range(size), max(1, size // 9)))
    wanted = missing_nodes(chosen, size)
    # Least: none is on a path of a chosen leaf, and each is beside one.
    paths = [{i // 16**k for i in chosen} for k in range(len(tree))]
    assert len(set(wanted)) == len(wanted)
    for level, i in wanted:
        assert i not in paths[level] and i // 16 in paths[level + 1]
    fetched = {(level, i): tree[level][i] for level, i in wanted}
    levels = derive_nodes({i: tree[0][i] for i in chosen}, fetched, size)
    for i in chosen:
        path = siblings(i, size, levels)
        assert path == plain_path(tree, i)
        assert fold(tree[0][i], path) == tree[-1][0]


def test_manifest_of_an_empty_table_and_a_single_row(spark):
    docs = spark.createDataFrame([(5, None, None, None, "A")], MANIFEST)
    empty = build_manifest(docs.limit(0))
    assert empty.root is None and multiproofs(empty).count() == 0
    (row,) = multiproofs(build_manifest(docs)).collect()
    assert row.leaf == row.subroot == row.root == plain_leaf((5, None, None, None, "A"))
    assert row.verified and row.proof_sha256 == sha("")


# ---- whitening -----------------------------------------------------------

VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("x", T.StringType()),
        T.StructField("id", T.StringType()),
    ]
)


def vector_table(spark, rows):
    return spark.createDataFrame([(i, v, "x", "i") for i, v in rows], VECTORS)


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, np.float32).astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = (fit * n - sums) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    values, basis = values[::-1][:k], basis[:, ::-1][:, :k]
    exact = x * n - sums
    return n, (exact**2).sum(1), exact / n @ basis / np.sqrt(values), values / np.trace(
        centred.T @ centred / n
    )


@pytest.mark.parametrize("shape", [(60, 5), (200, 24), (7, 12)])
def test_whitening_equals_the_eigen_decomposition(spark, shape):
    rng = np.random.default_rng(shape[0])
    vectors = rng.standard_normal(shape) * (1 + np.arange(shape[1]))
    vectors = [[float(c) for c in v] for v in vectors.astype(np.float32)]
    vectors += [vectors[0]] * 50
    rows = whiten(vector_table(spark, enumerate(vectors))).collect()
    n, deviation, whitened, explained = plain_whitening(vectors)
    assert len(rows) == 4 * len(vectors)
    found = np.zeros((len(vectors), 4))
    for r in rows:
        assert (r.n, r.deviation) == (n, deviation[r.id])
        assert math.isclose(r.explained, explained[r.component - 1], rel_tol=1e-9)
        assert r.identity_error < 1e-10
        found[r.id, r.component - 1] = r.whitened
    for k in range(4):
        sign = np.sign(found[0, k] * whitened[0, k])
        np.testing.assert_allclose(sign * found[:, k], whitened[:, k], atol=1e-9)


def test_repeated_singular_values_and_low_rank(spark):
    # Plus and minus each of six axes: all singular values are equal.
    axes = [[s * float(i == j) for j in range(6)] for i in range(6) for s in (1, -1)]
    rows = whiten(vector_table(spark, enumerate(axes)), k=6).collect()
    assert {r.component for r in rows} == set(range(1, 7))
    assert max(r.identity_error for r in rows) < 1e-10
    # Three directions only, two of them with equal deviations, in ten dimensions.
    flat = [[*v, *[0.0] * 7] for v in ([2, 0, 0], [-2, 0, 0], [0, 1, 0], [0, -1, 0], [0, 0, 1], [0, 0, -1])]
    rows = whiten(vector_table(spark, enumerate([list(map(float, v)) for v in flat]))).collect()
    assert {r.component for r in rows} == {1, 2, 3}
    assert max(r.identity_error for r in rows) < 1e-10


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [1.0, inf]), (5, [-inf, 1.0])]
    good = [(6, [0.0, 1.0]), (6, [0.0, 1.0]), (None, [-0.0, 2.0]), (8, [0.5, -1.0])]
    table = vector_table(spark, bad + good)
    assert sorted(r.id or 0 for r in whiten(table, k=1).collect()) == [0, 6, 6, 8]
    for rows in ([], bad, good[:2], [(1, [])]):
        assert whiten(vector_table(spark, rows)).count() == 0
    with pytest.raises(ValueError):
        whiten(vector_table(spark, [(1, [1.0]), (2, [1.0, 2.0])]))


def test_lanczos_takes_fewer_steps_than_dimensions(spark):
    rng = np.random.default_rng(1)
    strong = rng.standard_normal((400, 3)) @ rng.standard_normal((3, 60)) * 10
    vectors = (strong + 0.05 * rng.standard_normal((400, 60))).tolist()
    table = vector_table(spark, enumerate(vectors))
    x = table.filter(usable(F.col("embedding"))).select(scaled(F.col("embedding")).alias("x"))
    model = fit_whitening(x, k=3)
    assert model.steps < 30
    np.testing.assert_allclose(model.vectors.T @ model.vectors, np.eye(3), atol=1e-13)
