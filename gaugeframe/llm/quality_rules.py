"""Quality rules as a learned decision list.

Row-wise SQL expressions measure each text. Sequential covering then learns rules from
the measures of labelled rows: a rule is grown by adding the threshold with the best
information gain, pruned on rows held out from growing, and accepted if it is precise
there; the rows it covers leave, and the next rule is grown. If the rule from the best first
threshold is not accepted, that from the best one of another measure or direction is tried, and
so on; the list ends when none of them is accepted, however many rules that takes. The list becomes one
conditional expression. Only counts by measure and bin reach the driver, as many
whatever the size of the data. Rules are fitted on about ``max_labelled`` labelled rows, chosen
by a hash of the id; everything else reads all rows.

Defined cases: a null or empty text has no words and fails the base; labels that are null
or not 0/1 teach nothing; without rows of both kinds there are no rules and the base
alone decides; an empty table gives an empty table; other columns, whatever their names,
pass through; equal texts get equal verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import written
from .words import SPACE_RUN, SPACES, UPPER, WORD, let

SYMBOLS = "#*$%&|<>"
WINDOW = 8
DIGITS = "0123456789"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Measures that rules may use; none of them grows with the length of a text.
MEASURES = (
    "word_length",
    "symbol_share",
    "upper_share",
    "digit_share",
    "shout_share",
    "repeat_share",
    "dup_line_share",
    "line_words",
    "echo_share",
)


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _repeated(words: Column) -> Column:
    """Words in windows of ``WINDOW`` words that the text holds twice or more."""

    def over(hashes: Column) -> Column:
        def covered(order: Column) -> Column:
            def same(i: Column, step: int) -> Column:
                other = F.get(order, i + step)
                return other.isNotNull() & (other["h"] == F.get(order, i)["h"])

            twice = F.filter(order, lambda _, i: ((i > 0) & same(i, -1)) | same(i, 1))
            starts = F.array_sort(F.transform(twice, lambda s: s["i"]))
            none = F.struct(F.lit(0).alias("n"), F.lit(0).alias("until"))
            return F.aggregate(
                starts,
                none,
                lambda acc, s: F.struct(
                    (acc["n"] + s + WINDOW - F.greatest(s, acc["until"])).alias("n"),
                    (s + WINDOW).alias("until"),
                ),
                lambda acc: acc["n"],
            )

        marked = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
            let(F.sort_array(marked), covered)
        )

    def windows(each: Column) -> Column:
        at = F.sequence(F.lit(1), F.size(each) - WINDOW + 1)
        return F.transform(at, lambda i: F.xxhash64(F.slice(each, i, WINDOW)))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(
        let(hashed, lambda each: let(windows(each), over))
    )


def counted(text: Column) -> Column:
    """A struct of ``COUNTS`` and what the measures need besides."""
    text = F.coalesce(text, F.lit(""))

    def of(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
        bare = F.length(F.translate(text, SPACES, ""))
        chars = F.length(text)
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            bare.cast("long").alias("word_chars"),
            (chars - _without(text, SYMBOLS)).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
            .cast("long")
            .alias("n_dup_lines"),
            _repeated(words).cast("long").alias("n_repeat_words"),
            (chars - _without(text, UPPER)).cast("long").alias("n_upper"),
            (chars - _without(text, DIGITS)).cast("long").alias("n_digits"),
            (chars - _without(text, "!?")).cast("long").alias("n_shouts"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w, i: (i > 0) & (w == F.get(words, i - 1))))
            .cast("long")
            .alias("n_echoes"),
        )

    bare = F.btrim(text, F.lit(SPACES))
    return let(F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE_RUN)), of)


def measured(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """Columns ``doc`` (the row) and ``q`` (struct of counts, measures, ``base_failed``)."""
    rows = docs.select(F.struct("*").alias("doc"), counted(docs[text_col]).alias("c"))
    c = {name: F.col(f"c.{name}") for name in COUNTS}
    words, chars = F.greatest(c["n_words"], F.lit(1)), F.greatest(c["word_chars"], F.lit(1))
    lines = F.greatest(F.col("c.n_lines"), F.lit(1))
    values = (
        c["word_chars"] / words,
        c["n_symbols"] / chars,
        F.col("c.n_upper") / chars,
        F.col("c.n_digits") / chars,
        F.col("c.n_shouts") / words,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / lines,
        c["n_words"] / lines,
        F.col("c.n_echoes") / words,
    )
    failed = (c["n_words"] < 20) | (100 * c["n_repeat_words"] > 30 * c["n_words"])
    return rows.select(
        "doc",
        F.struct(
            *[c[name].alias(name) for name in COUNTS],
            *[v.alias(name) for v, name in zip(values, MEASURES, strict=True)],
            failed.alias("base_failed"),
        ).alias("q"),
    )


@dataclass(frozen=True)
class Threshold:
    measure: str
    above: bool
    value: float

    def column(self, prefix: str) -> Column:
        x = F.col(f"{prefix}{self.measure}")
        return x > self.value if self.above else x <= self.value

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.value:.6g}"


Rule = tuple[Threshold, ...]


def rule_column(rule: Rule, prefix: str = "") -> Column:
    out = F.lit(True)
    for threshold in rule:
        out = out & threshold.column(prefix)
    return out


def verdict(rules: Sequence[Rule], prefix: str = "q.") -> Column:
    """The list as one conditional: the first rule that holds rejects, else the row stays."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule_column(rule, prefix), F.lit(False)).otherwise(out)
    return out


def _gain(p: float, n: float, p0: float, n0: float) -> float:
    if p == 0:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def learn_rules(
    labelled: DataFrame,
    *,
    cuts: int = 24,
    max_rules: int | None = None,
    max_length: int = 3,
    min_precision: float = 0.9,
    min_cover: int = 4,
    min_held: int = 2,
) -> list[Rule]:
    """Rules for rejection from ``labelled(bad boolean, grow boolean, <MEASURES>)``.

    Thresholds are quantiles of the growing rows that no earlier rule covers, of either
    kind, so that a rare kind has thresholds too. A rule is kept if at least
    ``min_precision`` of the held-out rows it covers are bad, ``min_held`` at least, and it
    covers ``min_cover`` bad rows in all.
    """
    at = [(i + 0.5) / cuts for i in range(cuts)]
    rows = written(labelled.select("bad", "grow", *MEASURES))

    def points_of(rest: Column) -> list[list[float]] | None:
        row = rows.where(F.col("grow") & rest).agg(
            *[
                F.percentile_approx(F.when(F.col("bad") == kind, F.col(m)), at, 2000).alias(
                    f"{m}_{kind}"
                )
                for m in MEASURES
                for kind in (True, False)
            ]
        ).first()
        if any(row[f"{MEASURES[0]}_{kind}"] is None for kind in (True, False)):
            return None
        return [sorted({*row[f"{m}_True"], *row[f"{m}_False"]}) for m in MEASURES]

    def bins_of(points: list[list[float]]) -> Column:
        def below(x: Column):
            return lambda v: v < x

        return F.array(
            *[
                F.size(F.filter(F.array(*[F.lit(v) for v in values]), below(F.col(m))))
                for m, values in zip(MEASURES, points, strict=True)
            ]
        )

    def grown(rest: Column, points: list[list[float]]) -> list[Rule]:
        """For each direction of a first threshold that gains, the rule grown from it; best first.

        All of them are grown together, a pass for each length.
        """
        out: list[tuple[float, Rule]] = [(0.0, ())]
        for length in range(max_length):
            places = [k for k, (_, rule) in enumerate(out) if len(rule) == length]
            if not places:
                break
            holds = [F.when(rule_column(out[k][1]), F.lit(k)) for k in places]
            found = (
                rows.where(F.col("grow") & rest)
                .select("bad", bins_of(points).alias("bins"), F.explode(F.array_compact(F.array(*holds))).alias("k"))
                .select("k", "bad", F.posexplode("bins").alias("m", "bin"))
                .groupBy("k", "m", "bin")
                .agg(F.sum(F.col("bad").cast("long")).alias("p"), F.count("*").alias("all"))
                .collect()
            )
            seen: dict[int, list[dict]] = {k: [{} for _ in MEASURES] for k in places}
            for r in found:
                seen[r["k"]][r["m"]][r["bin"]] = (r["p"], r["all"] - r["p"])
            if not length:
                out = sorted(
                    ((gain, (t,)) for t, gain in steps(seen[0], points).values()), key=lambda x: -x[0]
                )
            else:
                for k in places:
                    better = max(steps(seen[k], points).values(), key=lambda x: x[1], default=None)
                    if better is not None:
                        out[k] = (out[k][0], (*out[k][1], better[0]))
        return [rule for _, rule in out if rule]

    def steps(
        seen: list[dict], points: list[list[float]]
    ) -> dict[tuple[str, bool], tuple[Threshold, float]]:
        """The threshold of each measure and direction that gains most, with its gain."""
        top: dict[tuple[str, bool], tuple[Threshold, float]] = {}
        for m, by_bin, values in zip(MEASURES, seen, points, strict=True):
            p0, n0 = (sum(v[k] for v in by_bin.values()) for k in (0, 1))
            p = n = 0
            for i, value in enumerate(values):
                # a value in bin i is above exactly i of the points
                p, n = (x + y for x, y in zip((p, n), by_bin.get(i, (0, 0)), strict=True))
                for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                    gain = _gain(a, b, p0, n0) if p0 else 0.0
                    if gain > top.get((m, above), (None, 1e-9))[1]:
                        top[m, above] = (Threshold(m, above, value), gain)
        return top

    def accepted(rest: Column, tries: list[Rule]) -> Rule | None:
        """The first try that has a valid beginning, cut to its best; judged in one pass."""
        whos = {"True": "bad and not grow", "False": "not bad and not grow", "all": "bad"}
        held = rows.where(rest).agg(
            *[
                F.count(F.when(rule_column(rule[:k]) & F.expr(who), 1)).alias(f"{t}_{k}_{name}")
                for t, rule in enumerate(tries)
                for k in range(1, len(rule) + 1)
                for name, who in whos.items()
            ]
        ).first()
        for t, rule in enumerate(tries):
            worth = [(held[f"{t}_{k}_True"], held[f"{t}_{k}_False"]) for k in range(1, len(rule) + 1)]
            _, at = max(((p - n) / max(p + n, 1), -k) for k, (p, n) in enumerate(worth))
            p, n = worth[-at]
            if p >= min_held and held[f"{t}_{1 - at}_all"] >= min_cover and p >= min_precision * (p + n):
                return rule[: 1 - at]
        return None

    rules: list[Rule] = []
    rest, points = F.lit(True), points_of(F.lit(True))
    while points is not None and (max_rules is None or len(rules) < max_rules):
        tries = grown(rest, points)
        rule = accepted(rest, tries) if tries else None
        if rule is None:
            break
        rules.append(rule)
        rest = rest & ~rule_column(rule)
        points = points_of(rest)
    return rules


def labelled_rows(narrow: DataFrame, chosen: DataFrame, seed: str = "rules") -> DataFrame:
    """Measures ``narrow(id, q)`` of the rows ``chosen(id, bad)`` that pass the base.

    A third is held out from growing.
    """
    held = F.pmod(F.xxhash64(F.lit(seed + "-held"), F.col("id")), F.lit(3)) == 0
    return (
        narrow.join(chosen, "id")
        .where(~F.col("q.base_failed"))
        .select("bad", (~held).alias("grow"), *[F.col(f"q.{m}").alias(m) for m in MEASURES])
    )


def chosen_labels(
    labels: DataFrame,
    *,
    label_id_col: str = "doc_id",
    label_col: str = "quality",
    max_labelled: int = 30_000,
    seed: str = "rules",
) -> DataFrame:
    """``id, bad`` of about ``max_labelled`` labels, chosen by a hash of the id."""
    known = (
        labels.select(
            labels[label_id_col].alias("id"), labels[label_col].cast("double").alias("label")
        )
        .where("label in (0, 1) and id is not null")
        .select("id", (F.col("label") == 0).alias("bad"))
    )
    bits = 60  # a share far below a millionth is a number still
    limit = (1 << bits) * max_labelled // max(known.count(), max_labelled)
    place = F.xxhash64(F.lit(seed), F.col("id")).bitwiseAND(F.lit((1 << bits) - 1))
    return known.where(place < F.lit(limit))


def kept(rules: Sequence[Rule]) -> Column:
    """Whether a row with the measures ``q`` passes base and rules."""
    return ~F.col("q.base_failed") & verdict(rules)


def _label_options(options: dict) -> tuple[dict, dict]:
    names = ("label_id_col", "label_col", "max_labelled")
    return {k: v for k, v in options.items() if k in names}, {
        k: v for k, v in options.items() if k not in names
    }


def judged_ids(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> tuple[DataFrame, list[Rule]]:
    """``id, q, kept`` of each row, and the rules. Texts are read once."""
    of_labels, of_rules = _label_options(options)
    rows = measured(docs.select(id_col, text_col), text_col=text_col)
    narrow = written(rows.select(F.col("doc")[id_col].alias("id"), "q"))
    rules = learn_rules(labelled_rows(narrow, chosen_labels(labels, **of_labels)), **of_rules)
    return narrow.withColumn("kept", kept(rules)), rules


def keep_good(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options
) -> DataFrame:
    """The rows of ``docs`` that pass base and rules.

    Only the texts of chosen labels are measured to learn; then each row is measured once.
    """
    of_labels, of_rules = _label_options(options)
    chosen = written(chosen_labels(labels, **of_labels))
    # as many ids as ``max_labelled`` says
    few = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(
        F.broadcast(chosen.select("id").distinct()), "id", "left_semi"
    )
    narrow = measured(few).select(F.col("doc.id").alias("id"), "q")
    rules = learn_rules(labelled_rows(narrow, chosen), **of_rules)
    return measured(docs, text_col=text_col).where(kept(rules)).select("doc.*")
