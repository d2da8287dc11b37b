"""URL filters: host and path rules, then a character language-model ratio. DataFrame functions only.

Rules: a rule is a host and a path (`example.com/en/`). It fits urls of its host and of its subdomains whose path
starts with its own; of several that fit, the longest decides.

Model: urls that a rule allows are the accepted ones, those that a rule blocks the rejected ones. For each class a
character Markov model of variable order is estimated from counts over all such urls, with Witten-Bell smoothing: each
order is mixed with the next lower one, by how many different symbols followed the context; a context that a class has
not seen leaves it to the lower order. Symbols are the characters as they stand (A-Z of hosts lower-cased). The highest
order grows with the logarithm of the characters counted, so that contexts of that length outnumber them. Counts and
probabilities are tables of a row for each string seen, and grow with the corpus; only sizes come to the driver.

Scores: a url's score is the mean log ratio of its symbols. It is joined by the longest context of each symbol; the
contexts that are a thousandth of all or more (so 1000 at most) are broadcast, as one key would else fill a task.
Ratios are whole millionths, so that sums do not depend on the order of rows.

Calibration: a fifth of the ruled urls (by hash) is held back; the threshold is the one that tells the classes apart
best there (true less false rejections). A url without a rule is blocked if its score lies above it.

Defined results: a null url, or one without `://`, has an empty host and path; a null or empty url has no score and is
allowed; repeated rows are judged, and counted, each; a tie at the threshold is allowed; if either class has no urls,
all without a rule are allowed; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, let, written

START, END = "\x02", "\x03"
BINS = 100
FOLDS = 5
MILLION = 1_000_000
OFTEN = 1000


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @classmethod
    def of(cls, verdict: str, text: str) -> Rule:
        host, slash, path = text.partition("/")
        return cls(verdict, host, slash + path)

    @property
    def text(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """After the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(ascii_lower(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*", 0)))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(F.coalesce(at, F.lit(0)) == 0, "").otherwise(F.regexp_extract(F.substr(url, at + 3), "^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The text of the longest rule that fits, or null."""
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.text), r.text)):
        out = F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path), r.text).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The characters after the first `://`, or all, between edges."""
    at = F.instr(url, "://")
    text = F.when(at == 0, url).otherwise(F.substr(url, at + 3))
    lowered = lambda t: let(F.regexp_extract(t, "^[^/?#]*", 0), lambda h: F.concat(ascii_lower(h), F.substr(t, F.char_length(h) + 1)))
    return F.concat(F.array(F.lit(START)), F.regexp_extract_all(let(text, lowered), F.lit("(?s)."), 0), F.array(F.lit(END)))


def windows(url: Column, order: int) -> Column:
    """Each symbol but the first edge, after the order symbols before it, or all there are."""
    one = lambda s, i: F.array_join(F.slice(s, F.greatest(F.lit(1), i - order), F.least(i, F.lit(order + 1))), "")
    return let(symbols(url), lambda s: F.transform(F.sequence(F.lit(2), F.size(s)), lambda i: one(s, i)))


def order_for(characters: int) -> int:
    """The logarithm to base 8, rounded up."""
    return max(2, -(-(characters - 1).bit_length() // 3))


def log_ratios(seen: DataFrame, order: int) -> DataFrame:
    """(w, ratio): log P(rejected) - log P(accepted), in millionths, of windows (w, good, bad) with their counts."""
    spread = seen.select(F.explode(F.sequence(F.lit(1), F.char_length("w"))).alias("size"), "w", "good", "bad")
    grams = spread.groupBy(F.expr("right(w, size)").alias("gram"), "size").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    grams = written(grams.withColumn("context", F.expr("left(gram, size - 1)")))
    of = grams.groupBy("context").agg(
        F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad"), F.count_if(F.col("good") > 0).alias("kinds_good"), F.count_if(F.col("bad") > 0).alias("kinds_bad"),
    )
    grams = written(grams.join(of, "context"))
    u = 1.0 / (grams.where("size = 1").count() + 1)

    def mixed(k: str, below: Column) -> Column:
        total, kinds = F.col(f"all_{k}"), F.col(f"kinds_{k}")
        return F.when(total > 0, (F.col(k) + kinds * below) / (total + kinds)).otherwise(below).alias(f"p_{k}")

    lower, out = None, []
    for size in range(1, order + 2):
        level = grams.where(F.col("size") == size)
        if lower is None:
            level = level.withColumns({"below_good": F.lit(u), "below_bad": F.lit(u)})
        else:
            below = lower.select(F.col("gram").alias("rest"), F.col("p_good").alias("below_good"), F.col("p_bad").alias("below_bad"))
            level = level.withColumn("rest", F.expr("right(gram, size - 1)")).join(below, "rest")
        lower = written(level.select("gram", mixed("good", F.col("below_good")), mixed("bad", F.col("below_bad"))))
        whole = lower if size == order + 1 else lower.where(F.col("gram").startswith(START))
        out.append(whole.select(F.col("gram").alias("w"), F.round((F.ln("p_bad") - F.ln("p_good")) * MILLION).cast("long").alias("ratio")))
    return reduce(DataFrame.unionByName, out)


def scores(rows: DataFrame) -> DataFrame | None:
    """(row, score) of the rows (row, url, counts, rejected) whose url is not empty; the model is that of those that
    count. None if a class has none."""
    rows = rows.where("url is not null and url != ''")
    sizes = rows.where("counts").agg(F.count_if("rejected").alias("bad"), F.count_if(~F.col("rejected")).alias("good"), F.sum(F.char_length("url")).alias("characters")).first()
    if not sizes["bad"] or not sizes["good"]:
        return None
    order = order_for(sizes["characters"])
    each = rows.select("row", "counts", "rejected", F.explode(windows(F.col("url"), order)).alias("w"))
    seen = written(each.groupBy("w").agg(F.count("*").alias("n"), F.count_if(F.col("counts") & ~F.col("rejected")).alias("good"), F.count_if(F.col("counts") & F.col("rejected")).alias("bad")))
    ratios = log_ratios(seen, order)
    total = seen.agg(F.sum("n")).first()[0]
    often = F.broadcast(written(ratios.join(F.broadcast(seen.where(F.col("n") * OFTEN >= total).select("w")), "w")))
    each = each.select("row", "w").join(often, "w", "left")
    rest = each.where("ratio is null").select("row", "w").join(ratios, "w")
    both = each.where("ratio is not null").select("row", "ratio").unionByName(rest.select("row", "ratio"))
    return written(both.groupBy("row").agg((F.sum("ratio") / F.count("*") / MILLION).alias("score")))


def threshold(held: DataFrame) -> float:
    """The cut of (rejected, score) rows that tells the classes apart best."""
    bins = F.greatest(F.lit(-10 * BINS), F.least(F.lit(10 * BINS), F.floor(F.col("score") * BINS)))
    held = held.groupBy("rejected", bins.alias("bin")).agg(F.count("*").alias("n")).collect()
    total = {k: max(1, sum(r["n"] for r in held if r["rejected"] == k)) for k in (False, True)}
    best, at = -1.0, 0.0
    for cut in sorted({r["bin"] + 1 for r in held} | {0}, key=lambda c: (abs(c), c)):
        worth = sum((1 if r["rejected"] else -1) * r["n"] / total[r["rejected"]] for r in held if r["bin"] >= cut)
        if worth > best + 1e-12:
            best, at = worth, cut / BINS
    return at


def scored(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> tuple[DataFrame, float]:
    """(rows with the rules' verdicts (said) and the model's scores, the cut). learns: false for the part of the urls that
    the model does not count and the cut is chosen on."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))
    said = F.lit(None).cast("string")
    for r in rules:
        said = F.when(F.col("rule") == r.text, r.verdict).otherwise(said)
    fold = F.pmod(F.xxhash64("url"), F.lit(FOLDS))
    rows = written(rows.select(F.monotonically_increasing_id().alias("row"), "*", said.alias("said"), (fold != 0).alias("learns")))
    rejected = F.col("said") == "block"
    found = scores(rows.select("row", "url", (F.col("said").isNotNull() & F.col("learns")).alias("counts"), rejected.alias("rejected")))
    if found is None:
        return rows.withColumn("score", F.lit(None).cast("double")), math.inf
    rows = rows.join(found, "row", "left")
    return rows, threshold(rows.where("said is not null and score is not null and not learns").select(rejected.alias("rejected"), "score"))


def judge_urls(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, score) of every row of pages."""
    rows, most = scored(pages, rules, id_col, url_col)
    by_model = F.when(F.coalesce(F.col("score") > F.lit(most), F.lit(False)), "block").otherwise("allow")
    return rows.select(F.col("page_id").alias(id_col), "host", "path", "rule", F.coalesce("said", by_model).alias("verdict"), "score")


def held_back_error(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(said, n, wrong): of the urls with a rule that the model has not counted, by the rule's verdict, how many there are
    and how many the model judges otherwise (the cut is chosen on them)."""
    rows, most = scored(pages, rules, id_col, url_col)
    held = rows.where("said is not null and score is not null and not learns")
    return held.groupBy("said").agg(F.count("*").alias("n"), F.count_if((F.col("score") > F.lit(most)) != (F.col("said") == "block")).alias("wrong"))
