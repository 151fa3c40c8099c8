"""Personal data: patterns propose spans, checks confirm them, words nearby set the score.

All of it is SQL on one row. A pattern splits the text into gaps and matches; their
lengths give the places. Matches that fail the check of their kind go (parts of an
address, Luhn for cards, mod 97 for account numbers, digits of a telephone number). Kinds
that are sure by themselves keep every confirmed match; the others need a word such as
"tel" or "iban" shortly before the match to reach the score.

The patterns never retry inside a run that they have read, so very long texts take linear
time: a look back (or the end of the previous match) tells where a run starts.

Defined cases: a null text counts as empty and has no spans; equal texts have equal spans;
an empty table gives an empty table; other columns, whatever their names, pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import let

LOCAL = "[A-Za-z0-9._%+-]"
NEARBY = 48
#: Matches whose places are summed in one go, so that time does not grow with their square.
BLOCK = 256


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(match: Column) -> Column:
    """The check digit of payment cards: doubled every second digit from the right."""

    def checked(number: Column) -> Column:
        figures = F.transform(F.split(F.reverse(number), ""), lambda d: d.cast("int"))
        doubled = F.transform(
            figures,
            lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d),
        )
        return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0

    return let(digits(match), checked)


def mod_97(match: Column) -> Column:
    """The check of account numbers: country and check digits last, letters from 10, rest 1."""

    def checked(number: Column) -> Column:
        moved = F.concat(F.expr("''"), F.substr(number, F.lit(5)), F.substring(number, 1, 4))
        codes = F.transform(F.split(moved, ""), lambda c: F.ascii(c))
        rest = F.aggregate(
            codes,
            F.lit(0),
            lambda a, c: F.when(c < 58, (a * 10 + c - 48) % 97).otherwise(
                (a * 100 + c - 55) % 97
            ),
        )
        return rest == 1

    return let(F.regexp_replace(match, " ", ""), checked)


def byte_parts(match: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return match.rlike(rf"^{part}(?:\.{part}){{3}}$")


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column]
    #: A text without this has no match; looking for it is cheaper than the pattern.
    hint: str
    #: Score of a confirmed match, and what a word nearby adds; from 1 on it is reported.
    score: float = 1.0
    nearby: str = ""
    bonus: float = 0.0


def _has_digits(least: int, most: int) -> Callable[[Column], Column]:
    return lambda match: F.length(digits(match)).between(least, most)


BASE = (
    Kind(
        "email",
        rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda match: F.lit(True),
        "@",
    ),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}", byte_parts, "."),
    # at most 19 digits are ever read; a longer run is no card and is not entered again
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){11,18}+(?![\x20-]?[0-9])",
        luhn,
        "",
    ),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _has_digits(9, 15), "+"),
)
EXTRA = (
    Kind(
        "iban",
        r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
        mod_97,
        "",
        0.8,
        r"(?i)(?:iban|account|konto|compte|cuenta|bank)",
        0.5,
    ),
    Kind(
        "phone_local",
        r"(?<![0-9+().-])(?<![0-9+][\x20])[(0][0-9]{2,4}[)\x20./-]{1,2}[0-9][0-9\x20-]{4,11}[0-9](?![0-9])",
        _has_digits(8, 13),
        "",
        0.4,
        r"(?i)(?:tel|phone|call|mobile|fax|telefon|tél|llam)",
        0.6,
    ),
)


def kind_spans(text: Column, kind: Kind) -> Column:
    """``array<struct<start int, end int, score double>>`` of one kind, in order."""
    regex = F.lit(kind.pattern)

    def located(matches: Column) -> Column:
        gaps = F.split(text, kind.pattern, -1)
        pairs = F.arrays_zip(gaps.alias("gap"), matches.alias("match"))

        def step(acc: Column, pair: Column) -> Column:
            start = acc["at"] + F.length(pair["gap"])
            end = start + F.coalesce(F.length(pair["match"]), F.lit(0))
            span = F.struct(
                start.alias("start"),
                end.alias("end"),
                pair["match"].alias("match"),
                F.right(pair["gap"], F.lit(NEARBY)).alias("before"),
            )
            # the gap after the last match has no match
            spans = F.when(
                pair["match"].isNotNull() & kind.check(pair["match"]),
                F.array_append(acc["spans"], span),
            ).otherwise(acc["spans"])
            return F.struct(end.alias("at"), spans.alias("spans"))

        def from_place(block: Column, at: Column) -> Column:
            none = F.array().cast(
                "array<struct<start:int,end:int,match:string,before:string>>"
            )
            first = F.struct(at.alias("at"), none.alias("spans"))
            return F.aggregate(block, first, step, lambda acc: acc["spans"])

        def summed(blocks: Column) -> Column:
            lengths = F.transform(
                blocks,
                lambda block: F.aggregate(
                    block,
                    F.lit(0),
                    lambda n, p: n + F.length(p["gap"]) + F.coalesce(F.length(p["match"]), F.lit(0)),
                ),
            )
            start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
            places = F.aggregate(
                lengths,
                start,
                lambda acc, n: F.struct(
                    (acc["at"] + n).alias("at"),
                    F.array_append(acc["places"], acc["at"]).alias("places"),
                ),
                lambda acc: acc["places"],
            )
            return F.flatten(F.zip_with(blocks, places, from_place))

        def in_blocks(each: Column) -> Column:
            at = F.sequence(F.lit(1), F.size(each), F.lit(BLOCK))
            return let(F.transform(at, lambda i: F.slice(each, i, BLOCK)), summed)

        return let(pairs, in_blocks)

    found = let(F.regexp_extract_all(text, regex, F.lit(0)), located)
    score = F.lit(kind.score)

    def scored(span: Column) -> Column:
        bonus = F.when(span["before"].rlike(kind.nearby), kind.bonus).otherwise(0.0)
        return F.struct(
            span["start"].alias("start"),
            span["end"].alias("end"),
            (score + bonus if kind.nearby else score).alias("score"),
        )

    none = F.array().cast("array<struct<start:int,end:int,score:double>>")
    spans = F.filter(F.transform(found, scored), lambda s: s["score"] >= 1)
    hinted = text.contains(kind.hint) if kind.hint else text.rlike(kind.pattern)
    return F.when(hinted, spans).otherwise(none)


def find_personal_data(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``doc`` (the row), ``text`` and an array of spans for each kind."""
    rows = docs.select(
        F.struct("*").alias("doc"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )
    kinds = (*BASE, *EXTRA)
    return rows.select("doc", "text", *[kind_spans(F.col("text"), k).alias(k.name) for k in kinds])


def listing(kinds: tuple[Kind, ...]) -> Column:
    """``kind:start:end`` of all spans of the kinds by start, comma-joined."""

    def marked_as(i: int):
        return lambda s: F.struct(
            s["start"].alias("start"), F.lit(i).alias("kind"), s["end"].alias("end")
        )

    marked = [F.transform(k.name, marked_as(i)) for i, k in enumerate(kinds)]
    names = F.array(*[F.lit(k.name) for k in kinds])
    return F.array_join(
        F.transform(
            F.array_sort(F.concat(*marked)),
            lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
        ),
        ",",
    )
