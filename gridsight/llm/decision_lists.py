"""Quality rules: a decision list learned by sequential covering, in DataFrame functions alone.

Texts become counts, counts become features on a coarse whole-number grid, and labelled rows become cells: how many rows of
each label fall into the same bins. Covering then works on the cells. A rule grows by the threshold that gains
most information about the rows to reject, until it covers no other, on two thirds of the rows; conditions are pruned from its
end by the last third. A rule precise enough there is added, what it covers goes, and the next one grows. Each step is one
aggregate of a row per feature and bin, whatever the number of rows; the list itself is a CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from gridsight.functions.scale import saved

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
#: Base rules: fewer words, or more than this percentage of them in repeated windows, fail.
LEAST_WORDS, MOST_REPEATED = 50, 50
BINS, CONDITIONS, RULES = 32, 4, 16
#: One row in so many, by a hash of its key, prunes; the others grow.
FOLDS = 3
#: Share of rows to reject among those that a rule covers in the pruning rows, and how many of them, at least.
PRECISION, COVER = 0.9, 10


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _count(chars: str) -> Column:
    """Characters of ``text`` in a class of a regular expression."""
    return F.regexp_count("text", F.lit(f"[{chars}]"))


def _beside_equal(values: Column, part, place) -> Column:
    """The ``place`` of each of the sorted ``values`` whose ``part`` equals that of a neighbour."""
    equal = lambda s: F.transform(s, lambda x, j: F.when((part(F.get(s, j - 1)) == part(x)) | (part(F.get(s, j + 1)) == part(x)), place(x)))
    return F.filter(_let(F.sort_array(values), equal), lambda i: i.isNotNull())


def _in_repeats(words: Column, window: int = 3) -> Column:
    """Words in windows that occur twice or more in the same text, all occurrences included.

    Sorted hashes, with the place of the window in the lower half, put windows that may be equal side by side. The words of
    these alone are sorted and compared, and the places of equal ones, sorted, cover up to ``window`` words each.
    """
    hashed = lambda x, i: F.shiftleft(F.xxhash64(x, *[F.get(words, i + k) for k in range(1, window)]), 32).bitwiseOR(i.cast("bigint"))
    starts = F.slice(words, F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(0)))
    likely = _beside_equal(F.transform(starts, hashed), lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    windows = F.transform(likely, lambda i: F.struct(F.array_join(F.slice(words, i + 1, window), " ").alias("w"), i.alias("i")))
    places = F.sort_array(_beside_equal(windows, lambda x: x["w"], lambda x: x["i"]))
    reach = lambda p: F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window))))
    return F.aggregate(_let(places, reach), F.lit(0), lambda a, b: a + b)


def measured(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts over each whole text: ``key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` and others.

    A null text has no words. A line counts if it holds a word, and as a duplicate if an earlier one is equal.
    """
    whole = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = documents.select(F.col(f"`{key}`").alias("key"), whole.alias("text"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: F.regexp_like(line, F.lit(WORD)))
    counts = rows.select(
        "key", _count(SYMBOLS).alias("n_symbols"), _count("0-9").alias("n_digits"), _count("A-Z").alias("n_capitals"), _count(".!?").alias("n_stops"),
        _count(",;:'\"()-").alias("n_marks"),
        _let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines"))).alias("l"),
        _let(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.struct(
            F.size(w).alias("n_words"), F.char_length(F.array_join(w, "")).alias("word_chars"), F.size(F.array_distinct(w)).alias("n_distinct"),
            _in_repeats(w).alias("n_repeat_words"))).alias("w"))
    counts = counts.select("*", "l.*", "w.*").drop("l", "w")
    return counts.select("key", *[F.col(c).cast("bigint").alias(c) for c in counts.columns if c != "key"])


def base_failed() -> Column:
    """The fixed rules over the counts."""
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


def _two_digits(x: Column) -> Column:
    """A count with all but its two leading digits 0, so that a feature has few values."""
    unit = F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.floor(F.log10(F.greatest(x, F.lit(1)))) - 1)).cast("bigint")
    return x - x % unit


def _per(part: str, whole: str, scale: int = 1000) -> Column:
    return F.coalesce(F.expr(f"try_divide({part} * {scale}, {whole})").cast("bigint"), F.lit(0).cast("bigint"))


def features() -> dict[str, Column]:
    """The columns that rules are made of, from the counts: whole numbers to two digits, or per thousand."""
    return {
        "words": _two_digits(F.col("n_words")), "letters_per_ten_words": _two_digits(_per("word_chars", "n_words", 10)),
        "symbols": _per("n_symbols", "word_chars"), "digits": _per("n_digits", "word_chars"), "capitals": _per("n_capitals", "word_chars"),
        "stops": _per("n_stops", "n_words"), "marks": _per("n_marks", "n_words"), "dup_lines": _per("n_dup_lines", "n_lines"),
        "repeat_words": _per("n_repeat_words", "n_words"), "distinct_words": _per("n_distinct", "n_words"),
        "words_per_line": _two_digits(_per("n_words", "n_lines", 1))}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: int

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds, from 1 on, or null: one conditional expression in the order of the list."""
    case = F.lit(None).cast("int")
    for number, rule in reversed(list(enumerate(rules, 1))):
        case = F.when(_all(rule), F.lit(number)).otherwise(case)
    return case


def _information(bad: int, good: int) -> float:
    return log2(bad / (bad + good)) if bad else 0.0


def _bin(name: str, cuts: list[int]) -> Column:
    """A row's bin in a column: the number of cuts below its value, so that "<= cut i" holds for bins up to i."""
    return F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < F.col(name)))


def learn(rows: DataFrame, names: list[str], key: str = "key", reject: str = "reject", bins: int = BINS, conditions: int = CONDITIONS,
          most: int = RULES, precision: float = PRECISION, cover: int = COVER) -> list[Rule]:
    """An ordered list of rules from rows with whole-number columns ``names`` and a boolean ``reject``.

    Thresholds are the exact quantiles of each column. Null keys and labels are left out, repeated rows count as often as they
    stand there; without both labels, or where no rule is precise enough, the list is empty.
    """
    known = saved(rows.filter(F.col(key).isNotNull() & F.col(reject).isNotNull()).select(
        *names, F.col(reject).alias("_bad"), (F.pmod(F.xxhash64(F.lit("prune"), F.col(key)), F.lit(FOLDS)) == 0).alias("_prune")))
    shares = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    cuts = known.agg(*[F.percentile(n, shares).alias(n) for n in names]).first()
    cuts = {n: sorted({int(c // 1) for c in cuts[n] or []}) for n in names}
    binned = [_bin(n, cuts[n]).alias(n) for n in names]
    count = lambda bad, prune: F.count_if((F.col("_bad") == bad) & (F.col("_prune") == prune))
    cells = saved(known.select(*binned, "_bad", "_prune").groupBy(*names).agg(
        count(True, False).alias("grow_bad"), count(False, False).alias("grow_good"), count(True, True).alias("prune_bad"), count(False, True).alias("prune_good")))
    place = {n: {c: i for i, c in enumerate(cuts[n])} for n in names}
    in_bins = lambda rule: _all(tuple(Condition(c.feature, c.above, place[c.feature][c.threshold]) for c in rule))
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < most:
        rule = _pruned(cells, left, _grown(cells, left, names, cuts, in_bins, conditions), in_bins, precision, cover)
        if not rule:
            break
        rules.append(rule)
        left = left & ~in_bins(rule)
    return rules


def _grown(cells: DataFrame, left: Column, names: list[str], cuts: dict[str, list[int]], in_bins, most: int) -> Rule:
    """Add the condition of the largest gain until only rows to reject are covered. One aggregate a condition."""
    rule: Rule = ()
    while len(rule) < most:
        bins = F.posexplode(F.array(*[F.col(n) for n in names])).alias("feature", "bin")
        sums = cells.filter(left & in_bins(rule)).select(bins, "grow_bad", "grow_good").groupBy("feature", "bin").agg(
            F.sum("grow_bad").alias("bad"), F.sum("grow_good").alias("good")).collect()
        found = {(r["feature"], r["bin"]): (r["bad"], r["good"]) for r in sums}
        bad = sum(b for (f, _), (b, _) in found.items() if f == 0)
        good = sum(g for (f, _), (_, g) in found.items() if f == 0)
        if not bad or not good:
            break
        best, chosen = 0.0, None
        for index, name in enumerate(names):
            below_bad = below_good = 0
            for at, cut in enumerate(cuts[name]):
                add = found.get((index, at), (0, 0))
                below_bad, below_good = below_bad + add[0], below_good + add[1]
                for above, b, g in ((False, below_bad, below_good), (True, bad - below_bad, good - below_good)):
                    gain = b * (_information(b, g) - _information(bad, good))
                    if gain > best + 1e-9:
                        best, chosen = gain, Condition(name, above, cut)
        if chosen is None:
            break
        rule += (chosen,)
    return rule


def _pruned(cells: DataFrame, left: Column, rule: Rule, in_bins, precision: float, cover: int) -> Rule:
    """The beginning of a rule that tells labels apart best on the pruning rows, or nothing if it is not precise there."""
    if not rule:
        return ()
    parts = [F.struct(F.sum(F.when(in_bins(rule[:n]), F.col("prune_bad"))).alias("bad"), F.sum(F.when(in_bins(rule[:n]), F.col("prune_good"))).alias("good"))
             for n in range(1, len(rule) + 1)]
    found = cells.filter(left).agg(F.array(*parts).alias("f")).first()["f"]
    sides = [(f["bad"] or 0, f["good"] or 0) for f in found]
    worth = [(b - g) / (b + g) if b + g else -1.0 for b, g in sides]
    best = max(range(len(worth)), key=lambda i: (worth[i], -i))
    bad, good = sides[best]
    return rule[:best + 1] if bad >= cover and bad >= precision * (bad + good) else ()


def judged(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``key``, the counts, ``base_failed``, ``rule`` (the number of the first learned rule that holds) and ``kept``.

    The list is learned from the labelled documents that pass the base rules: label 0 is to be rejected. Documents are
    kept unless a base or a learned rule holds. Null keys are judged, but do not teach.
    """
    counts = saved(measured(documents, key, text).withColumn("base_failed", base_failed()))
    named = features()
    known = labels.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{label}`") == 0).alias("reject")).dropna()
    rows = counts.filter(~F.col("base_failed")).select("key", *[c.alias(n) for n, c in named.items()]).join(known, "key")
    rules = learn(rows, list(named))
    found = counts.select("*", *[c.alias(n) for n, c in named.items()]).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    kept = ~F.col("base_failed") & F.col("rule").isNull()
    return found.select(F.col("key").alias(key), *[c for c in counts.columns if c != "key"], "rule", kept.alias("kept"))
