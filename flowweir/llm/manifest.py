"""Merkle manifest of a dataset, with proofs by the Octopus multiproof.

Rows are leaves of one tree per source, and the roots of those are leaves of one more
tree. A node is the SHA-256 of up to ``ARITY`` consecutive children, as hex text; a
level ends the tree when it has one node. Trees are built in blocks of leaves that
lie under one node a few levels up, so a source of any size is many blocks.

Proofs are made for any selection of rows. A leaf partition is a run of leaves in the
order of the dataset. Each works out the least set of nodes that it can't derive itself,
all fetch theirs in one join, and each derives the nodes in between once and expands the
proofs of its own rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.functions.ordered import with_rank
from flowweir.llm.text import shared_table

ARITY = 16
# Levels that one pass builds from a block of 16 ** 3 nodes.
BLOCK_LEVELS = 3
PART_LEAVES = 4096
UPPER = -1

LEAF_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(values: Iterable[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]).cast("binary"), 256)


def digest(parts: Iterable[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def level_sizes(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the single top."""
    sizes = [leaves]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // ARITY))
    return sizes


def run_of(index: int, size: int) -> range:
    """The nodes that share a parent with this one, itself included."""
    first = index // ARITY * ARITY
    return range(first, min(first + ARITY, size))


def missing_nodes(indices: Iterable[int], leaves: int) -> list[tuple[int, int]]:
    """Octopus: (level, index) of the least set of nodes that derives the top with the
    given leaves. A sibling that is itself derived from given leaves is not in it."""
    known, missing = set(indices), []
    for level, size in enumerate(level_sizes(leaves)[:-1]):
        firsts = {i // ARITY * ARITY for i in known}
        missing += [(level, i) for f in firsts for i in run_of(f, size) if i not in known]
        known = {f // ARITY for f in firsts}
    return missing


def derive_nodes(
    leaves: dict[int, str], fetched: dict[tuple[int, int], str], size: int
) -> list[dict[int, str]]:
    """The nodes on the paths of the leaves and beside them, level by level."""
    levels, own = [], leaves
    sizes = level_sizes(size)
    for level, count in enumerate(sizes):
        known = dict(own)
        if level < len(sizes) - 1:
            for first in {i // ARITY * ARITY for i in own}:
                for i in run_of(first, count):
                    if i not in own:
                        known[i] = fetched[level, i]
            own = {
                f // ARITY: digest(known[i] for i in run_of(f, count))
                for f in {i // ARITY * ARITY for i in own}
            }
        levels.append(known)
    return levels


def siblings(index: int, size: int, levels: list[dict[int, str]]) -> list[tuple[int, list[str]]]:
    """Of each level the place in its run and the others of the run, left to right."""
    path = []
    for known, count in zip(levels, level_sizes(size)[:-1]):
        path.append((index % ARITY, [known[i] for i in run_of(index, count) if i != index]))
        index //= ARITY
    return path


def fold(leaf: str, path: list[tuple[int, list[str]]]) -> str:
    """The top, recomputed from a leaf and its siblings."""
    for place, beside in path:
        leaf = digest([*beside[:place], leaf, *beside[place:]])
    return leaf


NODE = T.StructType(
    [
        T.StructField("tree", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("index", T.LongType()),
        T.StructField("digest", T.StringType()),
        T.StructField("count", T.LongType()),
    ]
)
COORDINATE = T.StructType(
    [
        T.StructField("part", T.LongType()),
        T.StructField("tree", T.LongType()),
        T.StructField("level", T.IntegerType()),
        T.StructField("index", T.LongType()),
    ]
)


def _batch(rows: list[tuple], names: list[str], kinds: list):
    import pyarrow as pa

    columns = zip(*rows) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)


def _build_batches(batches):
    """From sorted nodes of one level, whole blocks of them, to the nodes of the next
    ``BLOCK_LEVELS`` levels, as far as the tree goes."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64()]
    span = ARITY**BLOCK_LEVELS

    def above(tree, block, level, count, nodes):
        rows, first = [], block * span
        for _ in range(BLOCK_LEVELS):
            if count == 1:
                break
            first, level, count = first // ARITY, level + 1, -(-count // ARITY)
            nodes = [digest(nodes[i : i + ARITY]) for i in range(0, len(nodes), ARITY)]
            rows += [(tree, level, first + i, value, count) for i, value in enumerate(nodes)]
        return rows

    at, nodes = None, []
    for batch in batches:
        rows = []
        for tree, level, index, value, count in zip(*(c.to_pylist() for c in batch.columns)):
            here = (tree, index // span, level, count)
            if here != at:
                rows += above(*at, nodes) if at else []
                at, nodes = here, []
            nodes.append(value)
        yield _batch(rows, NODE.names, kinds)
    yield _batch(above(*at, nodes) if at else [], NODE.names, kinds)


def build_nodes(leaves: DataFrame, largest: int, name: str) -> DataFrame:
    """Leaves and all nodes above them, as rows of ``NODE``.

    ``leaves`` are rows of ``NODE`` at level 0, with ``index`` from 0 without gaps and ``count``
    nodes in their tree's level, at most ``largest``.
    """
    span = ARITY**BLOCK_LEVELS
    nodes, level = leaves, 0
    while largest > 1:
        # Trees that ended below this level have no node at it.
        dealt = (
            nodes.filter((F.col("level") == level) & (F.col("count") > 1))
            .repartition("tree", F.floor(F.col("index") / span))
            .sortWithinPartitions("tree", "index")
        )
        made = shared_table(dealt.mapInArrow(_build_batches, NODE), f"{name}-nodes")
        nodes, level = nodes.unionByName(made), level + BLOCK_LEVELS
        largest = -(-largest // span)
    return nodes


@dataclass
class Manifest:
    """``leaves``: ``id``, ``tree``, ``index``, ``leaf``, ``other``, ``leaves`` (of the tree), ``part``.
    ``trees``: ``tree``, ``source``, ``leaves``, ``subroot``. ``nodes``: rows of ``NODE``; tree -1 is the one
    over the sources. ``root``: its top, None for an empty dataset."""

    leaves: DataFrame
    trees: DataFrame
    nodes: DataFrame
    n_trees: int
    root: str | None


def build_manifest(
    docs: DataFrame,
    fields: Iterable[str] = LEAF_FIELDS,
    id_col: str = "doc_id",
    tree_col: str = "source",
    tampered: dict[str, Column] | None = None,
    part_leaves: int = PART_LEAVES,
) -> Manifest:
    """Leaves, nodes and root of a dataset.

    ``tampered`` replaces the values of some fields in ``other``, a second digest per row
    that proofs can be tried with; without it that is the leaf itself.

    Leaves of a source are ordered by id, nulls first, and rows of one id by their
    digest; equal rows are leaves of their own. Sources are ordered by their bytes, null
    first. A null field counts as ``-``, which no value gives. Texts of any length are
    digested whole. An empty table has no root. Only ``fields``, id and source are read, so
    no other column can clash.
    """
    fields = list(fields)
    values = {c: F.col(f"`{c}`") for c in fields}
    rows = shared_table(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.col(f"`{tree_col}`").cast("string").alias("source"),
            leaf_digest(values.values()).alias("leaf"),
            leaf_digest({**values, **(tampered or {})}.values()).alias("other"),
        ),
        "digests",
    )
    order = [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), "leaf"]
    ranked = shared_table(with_rank(rows, [], order, "place"), "places")
    sizes = ranked.groupBy("source").agg(
        F.count(F.lit(1)).alias("leaves"), F.min("place").alias("first")
    )
    # The first place of a source orders the sources as they are ordered.
    sources = with_rank(shared_table(sizes, "sizes"), [], ["first"], "tree")
    sources = shared_table(sources.withColumn("tree", F.col("tree") - 1), "sources")
    named = sources.withColumnRenamed("source", "name")
    leaves = shared_table(
        ranked.join(named, F.col("source").eqNullSafe(F.col("name"))).select(
            "id",
            "tree",
            (F.col("place") - F.col("first")).alias("index"),
            "leaf",
            "other",
            "leaves",
            F.floor((F.col("place") - 1) / part_leaves).alias("part"),
        ),
        "leaves",
    )
    largest, n_trees = sources.agg(F.max("leaves"), F.count(F.lit(1))).first()
    level_0 = leaves.select(
        "tree",
        F.lit(0).alias("level"),
        "index",
        F.col("leaf").alias("digest"),
        F.col("leaves").alias("count"),
    )
    nodes = build_nodes(level_0, largest or 0, "source")
    tops = nodes.filter(F.col("count") == 1).select("tree", F.col("digest").alias("subroot"))
    trees = shared_table(sources.drop("first").join(tops, "tree"), "subroots")
    subroots = trees.select(
        F.lit(UPPER).cast("long").alias("tree"),
        F.lit(0).alias("level"),
        F.col("tree").alias("index"),
        F.col("subroot").alias("digest"),
        F.lit(n_trees).cast("long").alias("count"),
    )
    upper = build_nodes(subroots, n_trees, "dataset")
    top = upper.filter(F.col("count") == 1).first()
    return Manifest(leaves, trees, nodes.unionByName(upper), n_trees, top and top["digest"])


def _coordinate_batches(n_trees: int):
    """Function over sorted rows (part, tree, index, leaves): missing coordinates of parts."""

    def run(batches):
        import pyarrow as pa

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]

        def missing(part, trees):
            wanted = [(t, *c) for t, (n, known) in trees.items() for c in missing_nodes(known, n)]
            wanted += [(UPPER, *c) for c in missing_nodes(trees, n_trees)]
            return [(part, *c) for c in wanted]

        at, trees = None, {}
        for batch in batches:
            rows = []
            for part, tree, index, leaves in zip(*(c.to_pylist() for c in batch.columns)):
                if part != at:
                    rows += missing(at, trees) if trees else []
                    at, trees = part, {}
                trees.setdefault(tree, (leaves, []))[1].append(index)
            yield _batch(rows, COORDINATE.names, kinds)
        yield _batch(missing(at, trees) if trees else [], COORDINATE.names, kinds)

    return run


def _expand_batches(n_trees: int, with_siblings: bool):
    """Function over sorted rows (part, level, tree, index, digest, other, leaves, id);
    rows that were fetched come before the leaves, whose level is null."""

    def run(batches):
        import pyarrow as pa

        def expand(fetched, rows):
            trees = {}
            for tree, index, leaf, _, leaves in rows:
                trees.setdefault(tree, (leaves, {}))[1][index] = leaf
            derived = {}
            for tree, (leaves, known) in trees.items():
                derived[tree] = derive_nodes(known, fetched.get(tree, {}), leaves)
            tops = {tree: levels[-1][0] for tree, levels in derived.items()}
            upper = derive_nodes(tops, fetched.get(UPPER, {}), n_trees)
            paths = {tree: siblings(tree, n_trees, upper) for tree in tops}
            for tree, index, leaf, other, leaves in rows:
                path = siblings(index, leaves, derived[tree]) + paths[tree]
                listed = [s for _, beside in path for s in beside]
                made = (leaf, tops[tree], digest(listed), fold(other, path))
                yield (*made, listed, [place for place, _ in path]) if with_siblings else made

        names = ["leaf", "subroot", "proof_sha256", "folded_root"]
        kinds = [pa.string()] * 4
        if with_siblings:
            names += ["siblings", "places"]
            kinds += [pa.list_(pa.string()), pa.list_(pa.int32())]

        def table(ids, proofs):
            made = _batch(proofs, names, kinds)
            return pa.RecordBatch.from_arrays([ids, *made.columns], ["id", *names])

        at, fetched, rows, ids = None, {}, [], []
        for batch in batches:
            id_column, start = batch.column("id"), 0
            lists = [batch.column(n).to_pylist() for n in batch.schema.names if n != "id"]
            for i, (part, level, tree, index, value, other, leaves) in enumerate(zip(*lists)):
                if part != at:
                    if rows:
                        ids.append(id_column.slice(start, i - start))
                        yield table(pa.concat_arrays(ids), list(expand(fetched, rows)))
                    at, fetched, rows, ids, start = part, {}, [], [], i
                if level is None:
                    rows.append((tree, index, value, other, leaves))
                else:
                    # Only leaves have an id to hand on.
                    start = i + 1
                    fetched.setdefault(tree, {})[level, index] = value
            ids.append(id_column.slice(start))
        if rows:
            yield table(pa.concat_arrays(ids), list(expand(fetched, rows)))

    return run


def multiproofs(
    manifest: Manifest, chosen: DataFrame | None = None, with_siblings: bool = False
) -> DataFrame:
    """Proofs of the chosen leaves, by default of all.

    Per leaf: ``id``, ``leaf``, ``subroot``, ``proof_sha256`` (digest of all siblings up to the root,
    left to right, level by level), ``folded_root`` (recomputed from ``other`` and those
    siblings), ``root`` and ``verified``; with ``with_siblings`` also the ``siblings`` themselves and the
    ``places`` of the path in its runs.
    """
    chosen = manifest.leaves if chosen is None else chosen
    dealt = (
        chosen.select("part", "tree", "index", "leaves")
        .repartition("part")
        .sortWithinPartitions("part")
    )
    wanted = shared_table(
        dealt.mapInArrow(_coordinate_batches(manifest.n_trees), COORDINATE), "coordinates"
    )
    fetched = wanted.join(manifest.nodes, ["tree", "level", "index"]).select(
        "part",
        "level",
        "tree",
        "index",
        "digest",
        F.lit(None).cast("string").alias("other"),
        F.lit(None).cast("long").alias("leaves"),
        F.lit(None).cast(chosen.schema["id"].dataType).alias("id"),
    )
    leaves = chosen.select(
        "part",
        F.lit(None).cast("int").alias("level"),
        "tree",
        "index",
        F.col("leaf").alias("digest"),
        "other",
        "leaves",
        "id",
    )
    rows = (
        fetched.unionByName(leaves)
        .repartition("part")
        .sortWithinPartitions("part", F.col("level").asc_nulls_last())
    )
    text = T.StringType()
    fields = [T.StructField("id", chosen.schema["id"].dataType)]
    fields += [
        T.StructField(n, text) for n in ("leaf", "subroot", "proof_sha256", "folded_root")
    ]
    if with_siblings:
        fields.append(T.StructField("siblings", T.ArrayType(text)))
        fields.append(T.StructField("places", T.ArrayType(T.IntegerType())))
    proofs = rows.mapInArrow(_expand_batches(manifest.n_trees, with_siblings), T.StructType(fields))
    root = F.lit(manifest.root).cast("string")
    return proofs.select(
        "*", root.alias("root"), (F.col("folded_root") == root).alias("verified")
    )
