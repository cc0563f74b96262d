"""Personal data: patterns propose spans, checksums confirm them, context scores them."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowweir.llm.text import full_text, let

SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _is_ip(match: Column) -> Column:
    """Parts at most 255, whatever their number of leading zeros."""
    return ~F.exists(
        F.split(match, r"\."),
        lambda part: let(
            F.ltrim(part, F.lit("0")),
            lambda p: (F.length(p) > 3) | (F.coalesce(p.try_cast("int"), F.lit(0)) > 255),
        ),
    )


def _is_card(match: Column) -> Column:
    return let(
        _digits(match), lambda d: F.length(d).between(14, 19) & F.call_function("luhn_check", d)
    )


def _is_phone(match: Column) -> Column:
    return F.length(_digits(match)).between(10, 15)


def _is_iban(match: Column) -> Column:
    """Country and check digits moved to the end, letters as 10 to 35, modulo 97 is 1."""

    def remainder(code: Column) -> Column:
        moved = F.concat(F.substring(code, 5, 34), F.substring(code, 1, 4))
        value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
        return F.aggregate(
            F.split(moved, ""),
            F.lit(0),
            lambda acc, c: F.when(c == "", acc).otherwise(
                (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
            ),
        )

    return let(
        F.replace(match, F.lit(" "), F.lit("")),
        lambda code: F.length(code).between(15, 34) & (remainder(code) == 1),
    )


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    valid: Callable[[Column], Column] | None
    score: float
    context: str
    least: float = 0.0


# Patterns as given, with guards that only spare the search starts that
# cannot match. (?:\G|(?<!x)) starts at the end of the last match or at the start of a
# run of x, and ++ never gives back; no character after such a run could need it.
RULES = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        None,
        0.8,
        "mail|contact|write to|reach",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
        _is_ip,
        0.6,
        "ip|address|server|host|client|login",
    ),
    Kind(
        "card",
        r"[0-9](?:[ -]?[0-9])++",
        _is_card,
        0.7,
        "card|credit|debit|visa|master|payment|account",
    ),
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        _is_phone,
        0.6,
        "phone|call|tel|mobile|fax|reach|contact",
    ),
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
        _is_iban,
        0.8,
        "iban|bank|account|transfer",
        0.5,
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        None,
        0.4,
        "ssn|social security|taxpayer",
        0.5,
    ),
)
KINDS = tuple(rule.name for rule in RULES)
BEFORE, AFTER, CONTEXT_BONUS = 48, 24, 0.2


def _spans(text: Column, rank: int, rule: Kind) -> Column:
    """Confirmed spans of one kind, in order of their start.

    The text between matches gives their places: each match starts where the
    pieces and matches before it end.
    """
    matches = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))

    def place(found: Column) -> Column:
        def step(acc: Column, piece: Column) -> Column:
            start = acc.at + piece.gap
            end = start + F.length(piece.match)
            valid = F.lit(True) if rule.valid is None else rule.valid(piece.match)
            span = F.struct(start.alias("start"), end.alias("end"))
            return F.struct(
                end.alias("at"),
                F.when(valid, F.array_append(acc.spans, span)).otherwise(acc.spans).alias("spans"),
            )

        gaps = F.zip_with(
            F.slice(F.split(text, rule.pattern, -1), 1, F.size(found)),
            found,
            lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match")),
        )
        start = F.struct(
            F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")
        )
        return F.aggregate(gaps, start, step, lambda acc: acc.spans)

    def scored(span: Column) -> Column:
        first = F.greatest(span.start - BEFORE, F.lit(0))
        around = F.concat(
            F.substring(text, first + 1, span.start - first),
            F.lit(" "),
            F.substring(text, span.end + 1, F.lit(AFTER)),
        )
        named = F.lower(around).rlike(rf"(?<![a-z])(?:{rule.context})")
        return F.struct(
            span.start.alias("start"),
            F.lit(rank).alias("rank"),
            span.end.alias("end"),
            F.lit(rule.name).alias("kind"),
            (F.lit(rule.score) + F.when(named, CONTEXT_BONUS).otherwise(0.0)).alias("score"),
        )

    none = F.array().cast(f"array<{SPAN}>")
    found = let(
        matches,
        lambda m: F.when(F.size(m) == 0, none).otherwise(F.transform(place(m), scored)),
    )
    return F.filter(found, lambda s: s.score >= rule.least) if rule.least else found


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``spans`` of each row: start, rank of the kind, end, kind, score.

    Places are code points from 0, the end exclusive; spans are ordered by start,
    then kind. Kinds do not exclude each other. E-mail, ip, card and phone spans
    that pass their check always stay; an iban or ssn stays when its score,
    raised by words near it, reaches its threshold.

    A null text counts as empty and gives an empty list. Equal rows get equal
    results, an empty table an empty one; texts are searched whole. Columns other
    than id and text are ignored, so none can clash.
    """
    text = F.col("text")
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), full_text(f"`{text_col}`").alias("text"))
    every = [_spans(text, rank, rule) for rank, rule in enumerate(RULES)]
    return read.select("doc_id", F.sort_array(F.concat(*every)).alias("spans"))
