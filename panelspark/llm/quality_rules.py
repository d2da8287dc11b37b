"""Quality rules: text statistics, fixed base limits and a learned decision list. DataFrame functions only.

Statistics are computed row by row, without a shuffle. For words that repeat, the 64-bit hashes of all 8-word windows
are compared; only texts that hold an equal pair sort them.

The list is learned by sequential covering. From a sample of labelled rows of a fixed size (max_train, the rows with
the least hashes of their ids; equal rows once) each rule is grown on one part, one threshold condition at a time by information gain
(FOIL), pruned on the other part by (right - wrong) / covered, and taken if it is right often enough there; the rows
that it covers go, and the next rule is grown, until no bad row is left, none is good enough, or max_rules (12) are found;
a rule has at most longest (4) conditions. Both bound the model, not the rows it judges. Rules and the default become one
nested CASE expression.

Defined results: a null text has no words and fails the base; a null id is returned as null and never used for
learning; repeated rows are judged each; ties between conditions go to the first statistic and the lower threshold;
labels that are null, or say both, take no part; without both kinds of labels the list is empty and keeps all that
passes the base; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, let

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, f"[{ASCII_SPACE}]+"), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """Words that lie in a WINDOW-word window whose words occur again in the text, first occurrences included."""

    def doubled(h: Column, step: int) -> Column:
        """Hashes of windows of two times step words from those of step words, of which there are step fewer."""
        return let(h, lambda w: F.transform(F.slice(w, F.lit(1), F.size(w) - step), lambda x, i: F.xxhash64(x, F.get(w, i + step))))

    def windows(h: Column) -> Column:
        step = 1
        while step < WINDOW:  # a power of two
            h, step = doubled(h, step), 2 * step
        return h

    def covered(w: Column) -> Column:
        def at(s: Column) -> Column:
            same = lambda i, k: F.coalesce(F.get(s, i + k)["w"] == F.get(s, i)["w"], F.lit(False))
            return F.array_sort(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, -1) | same(i, 1)), lambda i: F.get(s, i)["i"]))

        # each window that repeats covers up to where the next one begins
        steps = lambda p: F.aggregate(F.sequence(F.lit(1), F.size(p)), F.lit(0).cast("long"), lambda n, k: n + F.coalesce(F.least(F.lit(WINDOW), F.get(p, k) - F.get(p, k - 1)), F.lit(WINDOW)))
        order = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(let(order, lambda s: let(at(s), steps)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < WINDOW + 1, F.lit(0).cast("long")).otherwise(let(hashes, lambda h: let(windows(h), covered)))


def base_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and what the rules read besides) of every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    lines = F.filter(F.split("text", "\n"), lambda x: F.translate(x, SPACES, "") != "")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.size(F.array_distinct(w)).cast("long").alias("n_distinct_words"), repeated_words(w).alias("n_repeat_words"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    n = lambda c: F.char_length(c).cast("long")
    packed = rows.select(
        "doc_id",
        n("text").alias("n_chars_"),
        n(F.translate("text", SPACES, "")).alias("word_chars"),
        (n("text") - n(F.translate("text", SYMBOLS, ""))).alias("n_symbols"),
        (n("text") - n(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).alias("n_upper"),
        (n("text") - n(F.translate("text", "0123456789", ""))).alias("n_digits"),
        (n("text") - n(F.translate("text", ".,;:!?", ""))).alias("n_marks"),
        let(words_of(F.col("text")), of_words).alias("w"),
        let(lines, of_lines).alias("l"),
    )
    return packed.select("doc_id", "w.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "w.n_distinct_words", "l.n_lines", "n_upper", "n_digits", "n_marks")


def rule_statistics() -> dict[str, Column]:
    """What conditions may test; whole numbers, so that thresholds mean the same everywhere."""
    per = lambda a, b: F.floor(F.lit(1000) * F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("long")
    return {
        "n_words": F.col("n_words"),
        "chars_per_1000_words": per("word_chars", "n_words"),
        "symbols_per_1000_chars": per("n_symbols", "word_chars"),
        "upper_per_1000_chars": per("n_upper", "word_chars"),
        "digits_per_1000_chars": per("n_digits", "word_chars"),
        "marks_per_1000_words": per("n_marks", "n_words"),
        "distinct_per_1000_words": per("n_distinct_words", "n_words"),
        "repeats_per_1000_words": per("n_repeat_words", "n_words"),
        "dup_lines_per_1000_lines": per("n_dup_lines", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: int

    def holds(self, row: dict) -> bool:
        return row[self.statistic] > self.threshold if self.above else row[self.statistic] <= self.threshold

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.statistic] > self.threshold if self.above else of[self.statistic] <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold}"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    good: bool

    def covers(self, row: dict) -> bool:
        return all(c.holds(row) for c in self.conditions)


@dataclass(frozen=True)
class DecisionList:
    rules: tuple[Rule, ...]
    default: bool = True

    def good(self, row: dict) -> bool:
        return next((r.good for r in self.rules if r.covers(row)), self.default)

    def fired(self, of: dict[str, Column]) -> Column:
        """The number of the first rule that covers a row (from 1), else 0."""
        out = F.lit(0)
        for k, r in reversed([*enumerate(self.rules, 1)]):
            out = F.when(self._all(r, of), F.lit(k)).otherwise(out)
        return out

    def column(self, of: dict[str, Column]) -> Column:
        out = F.lit(self.default)
        for r in reversed(self.rules):
            out = F.when(self._all(r, of), F.lit(r.good)).otherwise(out)
        return out

    @staticmethod
    def _all(rule: Rule, of: dict[str, Column]) -> Column:
        out = F.lit(True)
        for c in rule.conditions:
            out = out & c.column(of)
        return out

    def __str__(self) -> str:
        said = [f"if {' and '.join(map(str, r.conditions))}: {'good' if r.good else 'bad'}" for r in self.rules]
        return "\n".join([*said, f"else: {'good' if self.default else 'bad'}"])


def _thresholds(values: list[int], most: int) -> list[int]:
    """Values that cut the rows into about most equal parts, each but the largest of its kind."""
    v = sorted(values)
    cuts = {v[min(len(v) - 1, len(v) * k // most)] for k in range(most)} | set(v[:1]) | {x for x in (v[len(v) * k // 200] for k in range(200))}
    return sorted(x for x in cuts if x < v[-1])


def _grow(rows: list[tuple[dict, bool]], names: list[str], target: bool, longest: int, cuts: int) -> list[Condition]:
    """FOIL: adds the condition with the largest gain until only the target class is covered."""
    conditions: list[Condition] = []
    while len(conditions) < longest:
        right = sum(y == target for _, y in rows)
        if not right or right == len(rows):
            break
        before, best, found = math.log2(right / len(rows)), 0.0, None
        for name in names:
            ordered = sorted((x[name], y == target) for x, y in rows)
            limits = _thresholds([v for v, _ in ordered], cuts)
            at = below = hits = 0
            for t in limits:
                while at < len(ordered) and ordered[at][0] <= t:
                    below, hits, at = below + 1, hits + ordered[at][1], at + 1
                for above, n, p in ((False, below, hits), (True, len(rows) - below, right - hits)):
                    if p and (gain := p * (math.log2(p / n) - before)) > best + 1e-9:
                        best, found = gain, Condition(name, above, t)
        if not found:
            break
        conditions.append(found)
        rows = [r for r in rows if found.holds(r[0])]
    return conditions


def _prune(conditions: list[Condition], rows: list[tuple[dict, bool]], target: bool) -> tuple[list[Condition], float, int]:
    """The head of the conditions that does best on held-back rows, its precision and coverage there."""
    best = ([], -2.0, 0.0, 0)
    for k in range(1, len(conditions) + 1):
        got = [y for x, y in rows if all(c.holds(x) for c in conditions[:k])]
        right = sum(y == target for y in got)
        worth = (2 * right - len(got)) / len(got) if got else -1.0
        if worth > best[1] + 1e-9:
            best = (conditions[:k], worth, right / len(got) if got else 0.0, len(got))
    return best[0], best[2], best[3]


def learn(rows: list[tuple[dict, bool]], names: list[str], max_rules: int = 12, longest: int = 4, precision: float = 0.9, least_covered: int = 3, cuts: int = 32) -> DecisionList:
    """rows: statistics and whether the text is good, in a fixed order. Rules for bad texts; what none covers is good."""
    rules: list[Rule] = []
    left = list(rows)
    while len(rules) < max_rules and any(not y for _, y in left):
        grow, prune = [r for k, r in enumerate(left) if k % 3], [r for k, r in enumerate(left) if k % 3 == 0]
        conditions = _grow(grow, names, False, longest, cuts)
        conditions, right, covered = _prune(conditions, prune, False)
        if not conditions or right < precision or covered < least_covered:
            break
        rules.append(Rule(tuple(conditions), False))
        left = [r for r in left if not rules[-1].covers(r[0])]
    return DecisionList(tuple(rules))


def fit(docs: DataFrame, labels: DataFrame, max_train: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> DecisionList:
    """A list learned from at most max_train labelled rows."""
    named = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2")).where("y = y2").select("doc_id", "y")
    sample = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    some = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    of = rule_statistics()
    stats = base_statistics(some.select("doc_id", "text")).join(F.broadcast(sample), "doc_id")
    rows = stats.select("doc_id", F.col("y").cast("int").alias("y"), *(c.alias(k) for k, c in of.items())).distinct()
    got = rows.orderBy(F.xxhash64("doc_id"), *rows.columns).limit(max_train).collect()  # ids may stand for many rows
    rows = sorted(got, key=lambda r: (crc32(str(r["doc_id"]).encode()), str(r["doc_id"])))
    return learn([({k: r[k] for k in of}, r["y"] > 0) for r in rows], list(of), **options)


def judge(docs: DataFrame, rules: DecisionList, id_col: str = "doc_id", text_col: str = "text", least_words: int = 20, most_repeat: int = 30) -> DataFrame:
    """Statistics, base_failed, kept and the number of the rule that fired, of every row."""
    stats = base_statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))
    of = rule_statistics()
    out = stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.column(of)).alias("kept"), rules.fired(of).alias("rule"))
    return out.withColumnRenamed("doc_id", id_col)


def quality_rules(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    return judge(docs, fit(docs, labels, **options))
