"""Line-first cleaning: rules per line, then a verdict on what is left of the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.llm.text import full_text, let, words

# Fixed values of the rules.
SYMBOLS = "#*$%&|<>"
# Full stops and question marks of Latin, CJK, Arabic, Indic, Ethiopic, Armenian, Khmer,
# Burmese and Tibetan writing, then closing marks.
SENTENCE_END = r"""[.!?…。！？｡؟۔।॥።፧։។။།]["'”’»)」』）\]]*([\x20\x09-\x0D]|$)"""
SEPARATORS = r"[|»›•·→]"
BOILERPLATE = (
    "all rights reserved|cookie policy|privacy policy|terms of (use|service)|"
    "accept cookies|enable javascript|lorem ipsum|sign up for our newsletter|"
    "click here|read more|share on (facebook|twitter)|skip to content"
)


def _repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that occur at least twice in the text.

    Window hashes of 8 bytes tell whether anything repeats; only then are the
    windows sorted by their words, so equal hashes of unlike windows do no harm.
    """

    def windows(w: Column, of) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), of)

    def hashed(w: Column) -> Column:
        return windows(w, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def covered(w: Column) -> Column:
        ordered = F.sort_array(
            windows(
                w,
                lambda i: F.struct(
                    F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"),
                    i.alias("i"),
                ),
            )
        )

        def starts(g: Column) -> Column:
            return F.filter(
                g,
                lambda x, j: (x.g.eqNullSafe(F.get(g, j - 1).g))
                | (x.g.eqNullSafe(F.get(g, j + 1).g)),
            )

        spread = let(
            ordered,
            lambda g: F.flatten(F.transform(starts(g), lambda s: F.array(s.i, s.i + 1, s.i + 2))),
        )
        return F.size(F.array_distinct(spread))

    repeats = let(tokens, lambda w: let(hashed(w), lambda h: F.size(F.array_distinct(h)) < F.size(h)))
    return (
        F.when(F.size(tokens) < 3, F.lit(0))
        .when(repeats, let(tokens, covered))
        .otherwise(F.lit(0))
        .cast("long")
    )


def line_fails(line: Column) -> Column:
    """Whether a line with a word breaks the punctuation, navigation or boilerplate rule.

    Punctuation: no sentence ends in it, or it has more symbols and exclamation
    marks than a tenth of its characters. Navigation: two or more separators.
    Boilerplate: it is one of the known phrases, or has one and under twelve words.
    """
    marks = F.regexp_count(line, F.lit(r"[#*$%&|<>!]"))
    phrase = F.lower(line).rlike(BOILERPLATE)
    return (
        ~line.rlike(SENTENCE_END)
        | (marks * 10 > F.length(line))
        | (F.regexp_count(line, F.lit(SEPARATORS)) >= 2)
        | (phrase & (F.size(words(line)) < 12))
    )


def clean_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_words: int = 50,
    repeat_percent: int = 50,
    lost_percent: int = 50,
) -> DataFrame:
    """One row per input row with counts, ``clean_text`` and the verdict ``kept``.

    A document fails the base when it has under ``min_words`` words or more than
    ``repeat_percent`` of its words lie in repeated 3-word windows. Else its
    lines are judged one by one; it is rejected when lines with more than
    ``lost_percent`` of its characters in lines with a word fail.

    A null text has no words and fails. Equal rows get equal results. Very long
    texts are worked on whole, inside their row. An empty table gives an empty
    result. Columns other than id and text are ignored, so none can clash.
    """
    text = F.col("text")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), full_text(f"`{text_col}`").alias("text"))
    split = read.select(
        "doc_id", "text", words(text).alias("tokens"), lines.alias("lines")
    )
    symbols = F.length(text) - F.length(F.translate(text, SYMBOLS, ""))
    length_of = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.length(x))
    counted = split.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeated_words(F.col("tokens")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        length_of(F.col("lines")).cast("long").alias("line_chars"),
        F.filter("lines", lambda x: ~line_fails(x)).alias("good"),
    )
    base_failed = (F.col("n_words") < min_words) | (
        100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words")
    )
    lost = 100 * (F.col("line_chars") - F.col("good_chars")) > lost_percent * F.col("line_chars")
    return (
        counted.withColumn("good_chars", length_of(F.col("good")).cast("long"))
        .withColumn("base_failed", base_failed)
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            "n_lines",
            F.size("good").cast("long").alias("n_good_lines"),
            "line_chars",
            "good_chars",
            "base_failed",
            (~F.col("base_failed") & ~lost).alias("kept"),
            F.array_join("good", "\n").alias("clean_text"),
        )
    )
