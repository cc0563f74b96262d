"""Language identification with a string kernel.

Texts become sets of letter n-grams up to length three (a blended spectrum). The
kernel of two texts is the number of shared n-grams over the geometric mean of
their set sizes. Nyström landmarks turn kernel rows into features, and a ridge
regression per language, one against the rest, scores them. Scoring is a product
of presence, landmark and weight matrices per batch of texts.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowweir.llm.text import full_text

SYMBOLS = 128
UNKNOWN = "und"
CHUNK = 64


def gram_coder():
    """Function from a text to its sorted distinct n-gram codes; none without letters.

    a-z have symbols of their own, other letters share a hundred, and a run of
    anything else is one break.
    """
    import numpy as np

    plane = np.arange(65536, dtype=np.int64)
    table = 27 + (plane * 2654435761 >> 16) % 100
    table[97:123] = np.arange(1, 27)
    letters = np.fromiter((chr(c).isalpha() for c in range(65536)), bool, 65536)
    table[~letters] = 0

    def codes(text: str):
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points.astype(np.int64)
        symbols = table[points & 65535]
        for far in np.unique(points[points > 65535]).tolist():
            symbols[points == far] = 27 + (far * 2654435761 >> 16) % 100 if chr(far).isalpha() else 0
        s = np.concatenate(([0], symbols, [0]))
        s = s[np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))]
        if len(s) < 3:
            return np.empty(0, np.int64)
        two = s[:-1] * SYMBOLS + s[1:]
        three = two[:-1] * SYMBOLS + s[2:]
        return np.unique(np.concatenate((s[1:-1], SYMBOLS + two, SYMBOLS + SYMBOLS**2 + three)))

    return codes


@dataclass
class Model:
    labels: list[str]
    vocabulary: np.ndarray  # sorted n-gram codes of the landmarks
    landmarks: np.ndarray  # presence, n-grams x landmarks, over the root of the set size
    weights: np.ndarray  # landmarks x labels


def fit(samples: Iterable[tuple[str, list[int]]], per_label: int, ridge: float) -> Model | None:
    """Model from (label, n-gram codes) rows; the first ``per_label`` of a label are landmarks."""
    rows = sorted(((label, np.array(codes, np.int64)) for label, codes in samples), key=lambda r: r[0])
    labels = sorted({label for label, _ in rows})
    if not labels:
        return None
    marks = [
        codes
        for name in labels
        for codes in [c for label, c in rows if label == name][:per_label]
    ]
    vocabulary = np.unique(np.concatenate(marks))
    landmarks = np.zeros((len(vocabulary), len(marks)), np.float32)
    for column, codes in enumerate(marks):
        landmarks[np.searchsorted(vocabulary, codes), column] = 1 / np.sqrt(len(codes))
    kernel = np.zeros((len(rows), len(marks)))
    for row, (_, codes) in enumerate(rows):
        at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
        known = at[vocabulary[at] == codes]
        kernel[row] = landmarks[known].sum(axis=0) / np.sqrt(len(codes))
    among = landmarks.T.astype(np.float64) @ landmarks
    values, vectors = np.linalg.eigh(among)
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    features = kernel @ root
    targets = np.where(np.array([label for label, _ in rows])[:, None] == np.array(labels), 1.0, -1.0)
    gram = features.T @ features + ridge * len(rows) * np.eye(features.shape[1])
    weights = root @ np.linalg.solve(gram, features.T @ targets)
    return Model(labels, vocabulary, landmarks, weights.astype(np.float32))


def _code_batches():
    code_of = gram_coder

    def run(batches):
        import pyarrow as pa

        codes = code_of()
        for batch in batches:
            found = [codes(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["key", "codes"]
            )

    return run


def held_out(id_col: str) -> Column:
    """Rows whose id, as text, has a CRC-32 that 5 divides (a null id counts as empty)."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    return F.crc32(ident.cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "lang",
    sample_per_label: int = 200,
    landmarks_per_label: int = 16,
    ridge: float = 1e-4,
) -> Model | None:
    """Fit on at most ``sample_per_label`` labelled rows of each language, none held out.

    The bound makes the fit a small matrix problem for the driver: it receives
    the n-gram sets of the sampled rows, which are bounded too. Rows are chosen
    by a hash of their id, so reruns agree. ``None`` without labelled rows.
    """
    labelled = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.col(f"`{label_col}`").alias("label"),
        F.col(f"`{text_col}`").alias("text"),
        held_out(id_col).alias("held"),
    ).filter("label IS NOT NULL AND text IS NOT NULL AND NOT held")
    order = Window.partitionBy("label").orderBy(F.xxhash64("id"), "id")
    chosen = (
        labelled.select("id", "label")
        .withColumn("n", F.row_number().over(order))
        .filter(F.col("n") <= sample_per_label)
        .select("id", "label", "n")
    )
    # Bounded: sample_per_label rows of each label.
    sample = labelled.join(F.broadcast(chosen), ["id", "label"]).select(
        F.struct("label", "n", "id").alias("key"), "text"
    )
    keys = T.StructField("key", sample.schema["key"].dataType)
    codes = T.StructField("codes", T.ArrayType(T.LongType()))
    coded = sample.mapInArrow(_code_batches(), T.StructType([keys, codes]))
    found = sorted(coded.collect(), key=lambda r: (r.key.label, r.key.n))
    rows = [(r.key.label, r.codes) for r in found if r.codes]
    return fit(rows, landmarks_per_label, ridge)


def _score_batches(model: Model | None):
    code_of = gram_coder

    def run(batches):
        import numpy as np
        import pyarrow as pa

        codes = code_of()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for base in range(0, len(texts) if model else 0, CHUNK):
                group = [codes(t) if t else () for t in texts[base : base + CHUNK]]
                presence = np.zeros((len(group), len(model.vocabulary)), np.float32)
                sizes = np.ones(len(group), np.float32)
                for row, found in enumerate(group):
                    if len(found):
                        at = np.searchsorted(model.vocabulary, found)
                        at[at == len(model.vocabulary)] = 0
                        presence[row, at[model.vocabulary[at] == found]] = 1
                        sizes[row] = len(found)
                kernel = presence @ model.landmarks / np.sqrt(sizes)[:, None]
                result = kernel @ model.weights
                best = result.argmax(axis=1)
                for row, found in enumerate(group):
                    if len(found):
                        names[base + row] = model.labels[best[row]]
                        scores[base + row] = min(1.0, max(0.0, (1 + result[row, best[row]]) / 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores)],
                names=["id", "held_out", "lang_pred", "score"],
            )

    return run


def identify(
    docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id``, ``held_out``, ``lang_pred`` and ``score`` (0 to 1) of each row.

    Whole texts are scored. A null text or one without letters gets ``und`` and
    score 0, and so does every text without a model. Equal texts get equal
    results; an empty table gives an empty result; other columns are ignored.
    """
    read = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        held_out(id_col).alias("held_out"),
        full_text(f"`{text_col}`").alias("text"),
    )
    schema = T.StructType(
        [
            read.schema["id"],
            T.StructField("held_out", T.BooleanType()),
            T.StructField("lang_pred", T.StringType()),
            T.StructField("score", T.DoubleType()),
        ]
    )
    return read.mapInArrow(_score_batches(model), schema)
