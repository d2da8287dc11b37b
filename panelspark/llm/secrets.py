"""Secret scans with corpus-wide ownership frequency. DataFrame functions only.

Base kinds are found by fixed expressions. Besides, each text gives candidates: runs of CANDIDATE that look random. The
hash of every value found, base or candidate, is counted over the corpus by distinct repositories and owners (here:
documents and their sources). A value that example_owners owners or more share, or that stands in example_repos
repositories or more, is a copied example; any other is specific to its few owners and looks live. Candidates that look
live and lie outside the base spans are added as spans of kind "owned"; base spans stay whatever their counts, and are
told apart in a column of their own.

Positions are code points, end exclusive. Spark has no function for the places of all matches: they follow from the
lengths of the matches and of the pieces between them, summed in blocks, so that the work stays near linear.

The counts are pre-aggregated, by value, owner and repository first, so that a value that a third of all rows hold is
a few rows. They are written before they are joined: both sides of the join are then plain tables, and Spark splits
the partition of a value with many spans. What is joined is a row for each span, never a text.

Defined results: a null or empty text has no spans; a null owner counts as one owner, null ids as one repository;
repeated rows are scanned each and are one repository; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column_place, let, written

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9_-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
LEAST_ASSIGNED = 12
BLOCK = 256
LARGER = lambda a, x: F.greatest(a, x)
MARK = "<SECRET>"
MOST = (1 << 31) - 1
CUT = 1024
SPANS = "array<struct<start:int,end:int,kind:int>>"


def _before(numbers: Column, put: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """For each element the sum of those before it, or what put makes of two of them; 0 before the first."""
    total = lambda a: F.aggregate(a, F.lit(0), put)

    def of(n: Column) -> Column:
        last = F.floor((F.size(n) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: total(F.slice(n, b * BLOCK + 1, F.lit(BLOCK))))
        starts = let(blocks, lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b))))
        return let(starts, lambda s: F.transform(n, lambda _, i: put(F.get(s, F.floor(i / BLOCK).cast("int")), total(F.slice(n, i - i % BLOCK + 1, i % BLOCK)))))

    return F.when(F.size(numbers) == 0, F.array().cast("array<int>")).otherwise(let(numbers, of))


def matches(text: Column, pattern: str, kind: str, value_group: int = 0) -> Column:
    """An array of (start, end, kind, value) of the leftmost non-overlapping matches; value: what value_group holds."""
    number = KINDS.index(kind)
    span = "array<struct<start:int,end:int,kind:int,value:string>>"

    def found(whole: Column) -> Column:
        def placed(start: Column) -> Column:
            values = F.regexp_extract_all(text, F.lit(pattern), value_group) if value_group else whole

            def spans(v: Column) -> Column:
                def one(m: Column, i: Column) -> Column:
                    # start: the lengths of pieces and matches before, and of the piece before this match
                    at = F.get(start, 2 * i + 1)
                    return F.struct(at.alias("start"), (at + F.char_length(m)).alias("end"), F.lit(number).alias("kind"), F.get(v, i).alias("value"))

                return F.transform(whole, one)

            return let(values, spans)

        pieces = F.split(text, pattern, -1)
        lengths = let(pieces, lambda p: F.flatten(F.transform(p, lambda x, i: F.array(F.char_length(x), F.coalesce(F.char_length(F.get(whole, i)), F.lit(0))))))
        return let(_before(lengths), placed)

    some = let(F.regexp_extract_all(text, F.lit(pattern), 0), found)
    return F.when(text.rlike(pattern), some).otherwise(F.array()).cast(span)


def base_spans(text: Column) -> Column:
    assigned = F.filter(matches(text, ASSIGN, "assign", 1), lambda s: F.char_length(s["value"]) >= LEAST_ASSIGNED)
    return F.concat(assigned, matches(text, ACCESS, "access"), matches(text, HEX, "hex"))


def _outside(base: Column, more: Column) -> Column:
    """Those of more that overlap none of base: by the ends of base spans that begin before, and the starts of those
    that begin after, in order of all starts."""
    owned = KINDS.index("owned")

    def of(s: Column) -> Column:
        ends = _before(F.transform(s, lambda x: F.when(x["kind"] < owned, x["end"]).otherwise(0)), LARGER)
        # distances from the largest number, so that the least start is a maximum
        starts = F.reverse(_before(F.reverse(F.transform(s, lambda x: F.when(x["kind"] < owned, MOST - x["start"]).otherwise(0))), LARGER))
        free = lambda e, a: F.filter(s, lambda x, i: (x["kind"] == owned) & (F.get(e, i) <= x["start"]) & (MOST - F.get(a, i) >= x["end"]))
        return let(ends, lambda e: let(starts, lambda a: free(e, a)))

    return F.when((F.size(base) == 0) | (F.size(more) == 0), more).otherwise(let(F.sort_array(F.concat(base, more)), of))


def looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= 10)


def candidate_spans(text: Column, base: Column) -> Column:
    return let(F.filter(matches(text, CANDIDATE, "owned"), lambda s: looks_random(s["value"])), lambda more: _outside(base, more))


def ordered(spans: Column) -> Column:
    return F.sort_array(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(ordered(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _scanned(docs: DataFrame, id_col: str, text_col: str, owner_col: str) -> DataFrame:
    """(row, repo, owner, base, more): each row's base spans and candidates, with hashes in place of values."""
    rows = docs.select(F.col(id_col).alias("repo"), F.col(owner_col).cast("string").alias("owner"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    packed = rows.select("repo", "owner", let(base_spans(F.col("text")), lambda b: F.struct(b.alias("base"), candidate_spans(F.col("text"), b).alias("more"))).alias("s"))
    hashed = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.sha2(s["value"], 256).alias("hash")))
    return packed.select(F.monotonically_increasing_id().alias("row"), "repo", "owner", hashed(F.col("s.base")).alias("base"), hashed(F.col("s.more")).alias("more"))


def ownership(found: DataFrame) -> DataFrame:
    """(hash, n_repos, n_owners) of (hash, owner, repo) rows."""
    a = found.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    a = a.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return a.groupBy("hash").agg(F.sum("n").alias("n_repos"), F.count("*").alias("n_owners"))


def copied_values(found: DataFrame, example_owners: int, example_repos: int) -> DataFrame:
    """(hash, copied, n_repos, n_owners) of all values of (hash, owner, repo) rows, as a table in the shared folder."""
    copied = (F.col("n_owners") >= example_owners) | (F.col("n_repos") >= example_repos)
    return written(ownership(found).select("hash", copied.alias("copied"), "n_repos", "n_owners"))


def scan(docs: DataFrame, example_owners: int = 3, example_repos: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans, live, n_owned, n_copied, n_repos, n_owners) of every row of
    docs. live: the spans whose values look live, written as spans; n_copied: the other spans and candidates; n_repos
    and n_owners: of the row's value that is copied most."""
    rows = written(_scanned(docs, id_col, text_col, owner_col))
    each = rows.select("row", "repo", "owner", F.explode(F.concat("base", "more")).alias("s")).select("row", "repo", "owner", "s.*")
    counts = copied_values(each.select("hash", "owner", "repo"), example_owners, example_repos)
    known = each.select("row", "start", "end", "kind", "hash").join(counts, "hash").groupBy("row").agg(
        F.collect_list(F.when(~F.col("copied"), F.struct("start", "end", "kind"))).alias("live"),
        F.count_if("copied").alias("n_copied"), F.max("n_repos").alias("n_repos"), F.max("n_owners").alias("n_owners"),
    )
    out = rows.join(known, "row", "left").withColumn("live", F.coalesce("live", F.array().cast(SPANS)))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.filter("live", lambda s: s["kind"] == KINDS.index("owned"))
    number = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("repo").alias(id_col), count("assign"), count("access"), count("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat(plain, added)).alias("spans"), joined(F.col("live")).alias("live"), F.size(added).cast("long").alias("n_owned"), number("n_copied"), number("n_repos"), number("n_owners"),
    )


def masked(text: Column, spans: Column) -> Column:
    """text with each stretch of overlapping spans replaced by MARK. The text is taken as pieces of CUT code points, so
    that a cut reads a piece, not all that stands before it."""

    def of(s: Column, pieces: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            first, last = F.floor(a / CUT).cast("int"), F.floor(b / CUT).cast("int")
            piece = lambda k: F.coalesce(F.get(pieces, k), F.lit(""))
            many = F.concat(F.substr(piece(first), a % CUT + 1), F.array_join(F.slice(pieces, first + 2, last - first - 1), ""), F.substr(piece(last), F.lit(1), b % CUT))
            return F.when(first == last, F.substr(piece(first), a % CUT + 1, b - a)).otherwise(many)

        ends = _before(F.transform(s, lambda x: x["end"]), LARGER)
        part = lambda e: F.transform(s, lambda x, i: F.when(x["start"] >= F.get(e, i), F.concat(cut(F.get(e, i), x["start"]), F.lit(MARK))).otherwise(""))
        last = F.array_max(F.transform(s, lambda x: x["end"]))
        return F.concat(let(ends, lambda e: F.array_join(part(e), "")), cut(last, F.char_length(text)))

    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), 0)
    return F.when(F.size(spans) > 0, let(ordered(spans), lambda s: let(pieces, lambda p: of(s, p)))).otherwise(text)


def redact(docs: DataFrame, example_owners: int = 3, example_repos: int = 20, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """docs with the spans that scan() gives masked in the text, and n_chars, where there is one, set anew; all other
    columns are kept, whatever their names (a row's columns go through as one). Only texts that hold candidates are joined
    with the counts; base spans are masked in place."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    spans = let(base_spans(text), lambda b: F.struct(b.alias("base"), candidate_spans(text, b).alias("more")))
    rows = written(docs.select(F.struct("*").alias("doc"), spans.alias("spans"), F.monotonically_increasing_id().alias("row")))
    plain = rows.where(F.size("spans.more") == 0).withColumn("all", F.col("spans.base"))
    hard = rows.where(F.size("spans.more") > 0)
    of = lambda c: F.col("doc")[c]
    found = lambda s: rows.select("row", of(id_col).alias("repo"), of(owner_col).cast("string").alias("owner"), F.explode(s).alias("s")).withColumn("hash", F.sha2("s.value", 256))
    counts = copied_values(found(F.concat("spans.base", "spans.more")).select("hash", "owner", "repo"), example_owners, example_repos)
    each = found(F.col("spans.more")).select("row", "s", "hash")
    owned = each.join(counts.where("not copied"), "hash").groupBy("row").agg(F.collect_list("s").alias("added"))
    hard = hard.join(owned, "row", "left").withColumn("all", F.concat("spans.base", F.coalesce("added", F.array().cast(hard.schema["spans"].dataType["more"].dataType))))
    out = plain.unionByName(hard.select(*plain.columns))
    has = F.size("all") > 0
    out = out.withColumn("text", F.when(has, masked(of(text_col), F.col("all"))).otherwise(of(text_col)))
    at = column_place(docs, text_col)

    def column(k: int, name: str) -> Column:
        if k == at:
            return F.col("text").alias(name)
        if name.lower() == "n_chars":
            return F.when(has, F.char_length("text").cast(docs.schema[k].dataType)).otherwise(of(name)).alias(name)
        return of(name).alias(name)

    return out.select(*(column(k, name) for k, name in enumerate(docs.columns)))
