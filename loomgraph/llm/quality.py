"""Quality rules as a learned decision list, in built-in Spark functions only.

Statistics of each text are column expressions. Sequential covering learns from labelled rows: a rule
for low quality grows condition by condition (information gain on two thirds of the sample) and is
pruned from its end (precision on the other third); covered rows leave, and the next rule is sought.
Rules become one ordered conditional expression, so each verdict names the rule that gave it.

Training takes at most SAMPLE labelled rows, those with the smallest hashed ids; the statistics of
documents, and the verdicts, cover every row and whole texts.

Defined results: a null text has no words and fails the base rules; an empty one likewise; without
labelled rows the list is empty and every text is kept that passes the base rules; labels of unknown or
null documents are ignored; of several labels for a document the lowest counts; repeated rows get equal verdicts; an
empty table gives an empty one; texts of any length are read whole; other columns are passed on, and one that is
named as a result is an error.
"""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.scalars import once
from loomgraph.llm.common import WORD_BREAKS

#: Bound of the training sample: labelled rows.
SAMPLE = 12_000
#: Cut points tried per statistic and class.
CUTS = 24
MAX_RULES, MAX_CONDITIONS = 8, 4
SYMBOLS = "#*$%&|<>"
#: Ratios that the rules may test.
RATIOS = ("symbols_per_word", "chars_per_word", "repeated_share", "repeated_lines", "marks_per_word", "capital_share")


#: What statistics() and judged() add.
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", *RATIOS)
VERDICT = ("rule", "kept")


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(WORD_BREAKS)) == ""


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the RATIOS.

    Repeated words: the three-word windows of a text are hashed and sorted with their positions; neighbours
    with equal hashes are windows that occur twice or more, and the union of their words is counted.
    """
    clash = [c for c in (*COLUMNS, *VERDICT) if c in docs.columns]
    if clash:
        raise ValueError(f"columns {', '.join(clash)} exist; rename them first")
    own = "_"
    while any(c.startswith(own) for c in docs.columns):
        own += "_"
    t = F.coalesce(F.col(text), F.lit(""))

    def without(chars: str) -> Column:
        return F.length(F.translate(t, chars, ""))

    c = lambda x: F.col(own + x)
    w, s = c("words"), c("windows")

    def added(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({own + name: x for name, x in columns.items()})

    df = added(docs, words=F.array_remove(F.split(t, r"[ \t\n\x0B\f\r]+"), ""), lines=F.filter(F.split(t, "\n"), lambda x: ~_blank(x)), word_chars=without(WORD_BREAKS).cast("long"), length=F.length(t).cast("long"))
    df = added(
        df,
        n=F.size(w).cast("long"),
        symbols=c("length") - without(SYMBOLS),
        marks=c("length") - without("!?.,;:"),
        capitals=c("word_chars") - F.length(F.translate(F.regexp_replace(t, r"\p{Lu}", ""), WORD_BREAKS, "")),
        dup_lines=(F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        n_lines=F.size(c("lines")),
        windows=F.when(F.size(w) >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i"))))),
    )
    twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: (F.get(s, j)["h"] == F.get(s, j - 1)["h"]) | (F.get(s, j)["h"] == F.get(s, j + 1)["h"]))
    starts = F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(starts, start, lambda a, p: F.struct(p.alias("last"), (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n")), lambda a: a["n"])
    df = added(df, repeat=F.coalesce(F.when(F.size(s) > 1, covered), F.lit(0)).cast("long"))
    # the numbers come from a generator, so that no later filter or column works the arrays out again
    numbers = {"word_chars": "word_chars", "n_words": "n", "n_symbols": "symbols", "n_dup_lines": "dup_lines", "n_repeat_words": "repeat"}
    df = once(df, **{name: c(x) for name, x in numbers.items()}, **{own + "number_of_" + x: c(x) for x in ("marks", "capitals", "n_lines")})
    marks, capitals, n_lines = (c("number_of_" + x) for x in ("marks", "capitals", "n_lines"))
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.select(
        *docs.columns,
        *COLUMNS[:5],
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("word_chars") / n).alias("chars_per_word"),
        (F.col("n_repeat_words") / n).alias("repeated_share"),
        (F.col("n_dup_lines") / F.greatest(n_lines, F.lit(1))).alias("repeated_lines"),
        (marks / n).alias("marks_per_word"),
        (capitals / F.greatest(F.col("word_chars"), F.lit(1))).alias("capital_share"),
    )


@dataclass(frozen=True)
class Condition:
    """`statistic > cut` if above, else `statistic <= cut`."""

    statistic: str
    above: bool
    cut: float

    def column(self) -> Column:
        c = F.col(self.statistic)
        return c > self.cut if self.above else c <= self.cut

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.cut:.6g}"


Rule = tuple[Condition, ...]


def learn(cells: list[tuple[tuple[int, ...], bool, bool, int]], cuts: dict[str, list[float]]) -> list[Rule]:
    """Rules for bad rows from counted cells: (number of cuts below each statistic, bad, in the pruning part, count)."""
    names = list(cuts)

    def holds(cell: tuple[int, ...], cond: tuple[int, int, bool]) -> bool:
        k, at, above = cond
        return (cell[k] > at) == above

    def split(rows, rule):
        inside = [r for r in rows if all(holds(r[0], c) for c in rule)]
        return sum(r[3] for r in inside if r[1]), sum(r[3] for r in inside if not r[1])

    rules, rows = [], cells
    while len(rules) < MAX_RULES:
        growing, pruning = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        rule: list[tuple[int, int, bool]] = []
        inside = growing
        while len(rule) < MAX_CONDITIONS:
            p0, n0 = split(inside, ())
            if not p0 or not n0:
                break
            best, gain = None, 1e-9
            for k in range(len(names)):
                by = defaultdict(lambda: [0, 0])
                for cell, bad, _, c in inside:
                    by[cell[k]][not bad] += c
                p = n = 0
                for at in range(len(cuts[names[k]])):
                    p, n = p + by[at][0], n + by[at][1]
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        if pp:
                            g = pp * (math.log2(pp / (pp + nn)) - math.log2(p0 / (p0 + n0)))
                            if g > gain * (1 + 1e-12):
                                best, gain = (k, at, above), g
            if best is None:
                break
            rule.append(best)
            inside = [r for r in inside if holds(r[0], best)]
        if not rule:
            break

        def worth(conds, pruning=pruning):
            p, n = split(pruning, conds)
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule.pop()
        if worth(rule) <= 0.5:  # three bad rows to a good one, at least
            break
        rules.append(tuple(Condition(names[k], above, cuts[names[k]][at]) for k, at, above in rule))
        rows = [r for r in rows if not all(holds(r[0], c) for c in rule)]
    return rules


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """The decision list of the labelled sample. Sent to the driver: cut points, and cells with counts (at most `sample`)."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    # a hash lets through about three times the sample, so few rows are sorted however many labels there are
    rate = min(1.0, 3.0 * sample / max(1, usable.count()))
    ids = (
        usable.where(F.shiftrightunsigned(F.xxhash64(F.col(key), F.lit(1)), 11).cast("double") / float(1 << 53) <= rate)
        .groupBy(key)
        .agg((F.min(label) == 0).alias("_bad"))
        .withColumn("_h", F.xxhash64(key))
        .orderBy("_h", key)
        .limit(sample)
        .withColumn("_pruning", F.pmod("_h", F.lit(3)) == 0)
        .drop("_h")
    )
    # the sample has a fixed bound, so its ids and labels may go to every task
    known = statistics(docs.select(key, "text").join(F.broadcast(ids), key)).select(*RATIOS, "base_failed", "_bad", "_pruning").persist()
    try:
        share = [i / CUTS for i in range(CUTS + 1)]
        passed = known.where(~F.col("base_failed"))  # above the cache, so the statistics are worked out once
        found = passed.groupBy("_bad").agg(*(F.percentile_approx(r, share, 10_000).alias(r) for r in RATIOS)).collect()
        cuts = {}
        for r in RATIOS:
            edges = sorted({x for row in found for x in row[r] or []})
            cuts[r] = [(a + b) / 2 for a, b in zip(edges, edges[1:], strict=False)]
        cuts = {r: c for r, c in cuts.items() if c}
        if not cuts:
            return []
        cell = F.array(*(sum(((F.col(r) > x).cast("int") for x in c), F.lit(0)) for r, c in cuts.items()))
        rows = passed.groupBy(cell.alias("cell"), "_bad", "_pruning").count().collect()
    finally:
        known.unpersist()
    return learn(sorted((tuple(r[0]), r[1], r[2], r[3]) for r in rows), cuts)


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1; null if none does."""
    out = None
    for i, rule in enumerate(rules, 1):
        c = rule[0].column()
        for x in rule[1:]:
            c = c & x.column()
        out = F.when(c, F.lit(i)) if out is None else out.when(c, F.lit(i))
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judged(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """docs with its statistics, `rule` (that rejects it) and `kept`."""
    df = statistics(docs, text).withColumn("rule", verdict(rules))
    return df.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
