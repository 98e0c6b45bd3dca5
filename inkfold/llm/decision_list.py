r"""Quality rules as learned decision lists: statistics, learning and verdicts are DataFrame expressions only.

text_stats computes whole-text statistics. learn grows an ordered list of rules by sequential covering
over the labelled rows: each rule is a conjunction of threshold tests that is grown test by test for FOIL
gain on two thirds of the rows and pruned on the rest. Counts come from Spark aggregates over all
labelled rows; the driver sees only counts per (statistic, bin). The list becomes one ordered CASE.

Defined cases: a null text is an empty one; text without words has zero statistics; labels that are null
or whose document is missing are ignored; repeated labels count once each; without labels of both kinds
the list is empty and its default keeps; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkfold.llm.tables import materialize

GAP = r"[\x20\x09-\x0D]+"
GAP_CHARS = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _let(value: Column, use) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _covered(hashes: Column, width: int) -> Column:
    """Entries covered by the windows whose hash occurs twice or more; hashes: one per window, in order."""

    def from_sorted(z: Column) -> Column:
        n = F.size(z)
        same_as_next = F.concat(F.zip_with(F.slice(z, 1, n - 1), F.slice(z, 2, n - 1), lambda a, b: a.h == b.h), F.array(F.lit(False)))
        return _let(same_as_next, lambda e: places(z, e))

    def places(z: Column, e: Column) -> Column:
        before = F.concat(F.array(F.lit(False)), F.slice(e, 1, F.size(e) - 1))
        either = F.zip_with(e, before, lambda a, b: a | b)
        found = F.zip_with(z, either, lambda x, keep: F.when(keep, x.i))
        return _let(F.array_sort(F.filter(found, lambda i: i.isNotNull())), widths)

    def widths(p: Column) -> Column:
        n = F.size(p)
        steps = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda a, b: F.least(F.lit(width), b - a))
        return F.when(n > 0, F.aggregate(steps, F.lit(width), lambda acc, x: acc + x)).otherwise(0)

    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(F.array_sort(pairs), from_sorted))


def _repeat_words(words: Column, width: int = 5) -> Column:
    def windows(w: Column) -> Column:
        n = F.size(w) - (width - 1)
        hashes = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(width)]))
        return F.when(n > 1, _let(hashes, lambda h: _covered(h, width))).otherwise(0)

    return _let(F.transform(words, lambda x: F.xxhash64(x)), windows)


def text_stats(docs: DataFrame) -> DataFrame:
    """doc_id and COUNTS, as longs, for every row of docs; whole texts."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, GAP), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, GAP_CHARS, "") != "")
    counted = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        _let(words, lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))).alias("w"),
        F.length(F.translate("text", GAP_CHARS, "")).alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"),
    )
    return counted.select("doc_id", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.r").alias("n_repeat_words")).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in COUNTS]
    )


def features() -> dict[str, Column]:
    """Scale-free statistics that rules may test."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {
        "words": F.col("n_words").cast("double"),
        "mean_word": F.col("word_chars") / n,
        "symbols_per_word": F.col("n_symbols") / n,
        "dup_lines": F.col("n_dup_lines").cast("double"),
        "dup_lines_per_word": F.col("n_dup_lines") / n,
        "repeat_share": F.col("n_repeat_words") / n,
    }


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules: the first that holds gives the verdict; the default keeps or rejects."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)
    keeps: bool = True

    def rejects(self) -> Column:
        """The verdict over columns named as in features(), as one ordered CASE."""
        case = None
        for rule in self.rules:
            holds = _all(rule)
            case = F.when(holds, True) if case is None else case.when(holds, True)
        return F.lit(not self.keeps) if case is None else case.otherwise(not self.keeps)

    def __str__(self) -> str:
        return "\n".join("reject if " + " and ".join(map(str, r)) for r in self.rules) + f"\nelse {'keep' if self.keeps else 'reject'}"


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _gain(p0: float, n0: float, p1: float, n1: float) -> float:
    """FOIL's information gain of narrowing (p0, n0) to (p1, n1)."""
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 and p0 else 0.0


def _bin(name: str, cuts: list[float]) -> Column:
    """How many cuts lie below the value."""
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(name)))


def learn(labelled: DataFrame, names: list[str], bins: int = 64, max_rules: int = 8, max_tests: int = 3, precision: float = 0.9, least: int = 20) -> DecisionList:
    """A list that rejects rows of label 0. labelled: label, fold (0 to 2; 2 prunes) and the named columns.

    A rule stays if it is right for `precision` of the pruning rows that it covers, and covers `least`
    growing rows at least.
    """
    totals = {r.label: r["count"] for r in labelled.groupBy("label").count().collect()}
    if not totals.get(0) or not totals.get(1):
        return DecisionList()
    cuts = labelled.agg(*[F.percentile_approx(n, [i / bins for i in range(1, bins)], 10_000).alias(n) for n in names]).first()
    cuts = {n: sorted(set(cuts[n])) for n in names}
    rest, out = labelled, DecisionList()
    bad = F.sum(F.when(F.col("label") == 0, 1).otherwise(0))
    good = F.sum(F.when(F.col("label") == 1, 1).otherwise(0))
    while len(out.rules) < max_rules:
        tests: list[Test] = []
        while len(tests) < max_tests:
            grow = rest.where((F.col("fold") < 2) & _all(tests))
            bin_of = [F.struct(F.lit(n).alias("name"), _bin(n, cuts[n]).alias("bin")) for n in names]
            counts = grow.select("label", F.explode(F.array(*bin_of)).alias("b")).groupBy("b.name", "b.bin").agg(bad.alias("p"), good.alias("n")).collect()
            best, best_gain = None, 0.0
            for name in names:
                at = {r["bin"]: (r["p"], r["n"]) for r in counts if r["name"] == name}
                p0, n0 = sum(x[0] for x in at.values()), sum(x[1] for x in at.values())
                p, n = 0, 0
                for i, cut in enumerate(cuts[name]):
                    p, n = p + at.get(i, (0, 0))[0], n + at.get(i, (0, 0))[1]
                    for above, p1, n1 in ((False, p, n), (True, p0 - p, n0 - n)):
                        if p1 >= least and (gain := _gain(p0, n0, p1, n1)) > best_gain:
                            best, best_gain, clean = Test(name, above, cut), gain, not n1
            if best is None:
                break
            tests.append(best)
            if clean:
                break
        if not tests:
            break
        prefixes = [_all(tests[: k + 1]) for k in range(len(tests))]
        pruning = rest.where("fold = 2").agg(*[
            F.sum(F.when(c & (F.col("label") == label), 1).otherwise(0)).alias(f"c{k}_{label}") for k, c in enumerate(prefixes) for label in (0, 1)
        ]).first()
        scored = []
        for k in range(len(tests)):
            p, n = pruning[f"c{k}_0"] or 0, pruning[f"c{k}_1"] or 0
            scored.append(((p - n) / (p + n) if p + n else -1.0, -k, p, n))
        worth, k, p, n = max(scored)
        if not p or p < precision * (p + n):
            break
        rule = tuple(tests[: 1 - k])
        out.rules.append(rule)
        rest = rest.where(~_all(rule))
    return out


def verdicts(docs: DataFrame, labels: DataFrame, min_words: int = 10, repeat_percent: int = 20, **how) -> tuple[DataFrame, DecisionList]:
    """doc_id, COUNTS, base_failed and kept for every row of docs, and the list that decided."""
    stats = materialize(text_stats(docs), "stats")
    named = features()
    labelled = (
        labels.where("doc_id is not null and quality is not null").select("doc_id", F.col("quality").cast("int").alias("label"))
        .join(stats, "doc_id")
        .select("label", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *[c.alias(n) for n, c in named.items()])
    )
    rules = learn(materialize(labelled, "labelled"), list(named), **how)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    judged = stats.select("doc_id", *COUNTS, failed.alias("base_failed"), *[c.alias(n) for n, c in named.items()])
    return judged.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~rules.rejects()).alias("kept")), rules
