"""The queries of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import secrets
from .ann import nearest
from .common import spread, table
from .mixing import mix
from .packing import pack_documents
from .periodic import periodic_runs
from .quality_rules import quality_rules as rules_of_quality
from .secrets import scan
from .setsketch import near_duplicates
from .simhash import simhash_duplicates
from .token_counts import count_tokens
from .token_files import token_files as id_files
from .toxicity import toxicity
from .urls import Rule, judge_urls
from .vector_codes import compress

URL_RULES = (
    Rule.of("block", "com/en/"),
    Rule.of("allow", "example.com/en/7"),
    Rule.of("allow", "net/de/"),
    Rule.of("block", "example.net/de/8"),
    Rule.of("block", "org/es/"),
)


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), k=20, every=20)


def toxicity_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def setsketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spread(table(spark, sf_dir, "documents")), size=2, percent=80)


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("byte_bpe_50k.json"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules_of_quality(spread(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spread(table(spark, sf_dir, "documents")))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spread(table(spark, sf_dir, "pages")), URL_RULES)


def poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spread(table(spark, sf_dir, "documents")), public_tokenizers.path("piece_bpe_32k.model"))


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def periodic_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(spread(table(spark, sf_dir, "documents")), plant=True, details=False).drop("n_words")


def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(spread(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_nearest_neighbours": nearest_neighbours,
    "op2_toxicity": toxicity_severity,
    "op3_setsketch_near_dedup": setsketch_near_dedup,
    "op4_quality_rules": quality_rules,
    "op5_best_fit_packing": best_fit_packing,
    "op6_secret_scan": secret_scan,
    "op7_url_filter": url_filter,
    "op8_token_counts": token_counts,
    "op9_poisson_mixing": poisson_mixing,
    "op10_token_files": token_files,
    "op11_vector_codes": vector_codes,
    "op12_periodic_runs": periodic_words,
    "op13_simhash_near_dedup": simhash_near_dedup,
}

NEAREST_SQL = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
x AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.e, b.e) AS score FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM x)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""

#: Seed 20240; a source's weight is the square root of its size, and as many rows are wanted as there are.
MIXING_SQL = """WITH n AS (SELECT coalesce(source, chr(0)) AS s, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT sum(sqrt(n)) AS w, CAST(sum(n) AS DOUBLE) AS n FROM n),
rates AS (SELECT s, sqrt(n.n) * (t.n / t.w) / n.n AS rate FROM n, t),
d AS (SELECT documents.*, rate, CAST(CAST('0x' || substr(md5('20240:1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS u FROM documents JOIN rates ON coalesce(source, chr(0)) = s),
k AS (SELECT * EXCLUDE (rate, u), len(list_filter(range(0, 60), lambda j: list_sum(list_transform(range(0, j + 1), lambda i: exp(-rate + i * ln(rate) - lgamma(i + 1)))) <= u)) AS k FROM d),
e AS (SELECT * EXCLUDE (k), CAST(unnest(range(1, k + 1)) AS INTEGER) AS replica FROM k)
SELECT *, CAST('0x' || substr(md5('20240:order:' || replica || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS shuffle_key FROM e"""

#: Sets of word pairs, documents that share a pair, and what they reach. chr(1) stands between words.
NEAR_DEDUP_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS rid, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, rid, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN w ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || chr(1) || w[i + 1])) END AS g FROM w),
e AS MATERIALIZED (SELECT rid, len(g) AS n, unnest(g) AS s FROM g),
p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS shared, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.s = b.s AND a.rid < b.rid AND a.n * 100 >= b.n * 80 AND b.n * 100 >= a.n * 80 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * shared >= 80 * (na + nb - shared) UNION ALL SELECT b, a FROM p WHERE 100 * shared >= 80 * (na + nb - shared)),
r AS (SELECT rid AS a, rid AS b FROM g UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT r.a AS rid, min(doc_id) AS component_id FROM r JOIN g ON r.b = g.rid GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept FROM g JOIN c USING (rid)"""


def _matches_sql(kind: int, pattern: str, group: int = 0) -> str:
    pattern = pattern.replace("'", "''")
    pieces = f"string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS v"
    return f"SELECT rid, {kind} AS kind, p, m, v, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, {pieces} FROM d)"


#: A match begins after the pieces between matches, and the matches, before it.
SECRETS_SQL = f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
x AS ({" UNION ALL ".join((_matches_sql(0, secrets.ASSIGN, 1), _matches_sql(1, secrets.ACCESS), _matches_sql(2, secrets.HEX), _matches_sql(3, secrets.CANDIDATE)))}),
y AS (SELECT rid, kind, m[i] AS m, v[i] AS v, coalesce(list_sum(list_transform(p[1:i], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda q: length(q))), 0) AS a FROM x),
z AS MATERIALIZED (SELECT rid, kind, CAST(a AS BIGINT) AS a, CAST(a AS BIGINT) + length(m) AS b, v FROM y WHERE CASE kind WHEN 0 THEN length(v) >= 12 WHEN 3 THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 10 ELSE true END),
s AS (SELECT * FROM z WHERE kind < 3 OR NOT EXISTS (SELECT 1 FROM z o WHERE o.rid = z.rid AND o.kind < 3 AND o.a < z.b AND z.a < o.b)),
n AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners, count(DISTINCT coalesce(source, chr(0)) || chr(1) || coalesce(CAST(doc_id AS VARCHAR), '')) AS n_repos FROM s JOIN d USING (rid) GROUP BY v),
k AS (SELECT s.*, n_owners, n_repos, n_owners >= 3 OR n_repos >= 20 AS copied, ['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || a || ':' || b AS said FROM s JOIN n USING (v)),
o AS (SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex, string_agg(said, ',' ORDER BY a, kind, b) FILTER (kind < 3) AS base, string_agg(said, ',' ORDER BY a, kind, b) FILTER (kind < 3 OR NOT copied) AS spans, string_agg(said, ',' ORDER BY a, kind, b) FILTER (NOT copied) AS live,
 count(*) FILTER (kind = 3 AND NOT copied) AS n_owned, count(*) FILTER (copied) AS n_copied, max(n_repos) AS n_repos, max(n_owners) AS n_owners FROM k GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce({c}, 0) AS {c}" for c in ("n_assign", "n_access", "n_hex", "n_owned", "n_copied", "n_repos", "n_owners"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(live, '') AS live FROM d LEFT JOIN o USING (rid)"""

def _round_sql(k: int) -> str:
    """Parts assigned to the codebook of round k, and the codebook of the next."""
    return f"""a{k} AS MATERIALIZED (SELECT rid, part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'entry': entry}}) AS found FROM p JOIN b{k} USING (part) GROUP BY ALL),
s{k} AS (SELECT part, found.entry AS entry, x, unnest(range(1, len(x) + 1)) AS i FROM a{k} JOIN p USING (rid, part)),
m{k} AS (SELECT part, entry, i, CAST(sum(CAST(x[i] AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM s{k} GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT part, entry, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM m{k} GROUP BY ALL) m USING (part, entry)),
"""


#: Whole numbers as doubles: far below 2^53 in these tables.
VECTOR_CODES_SQL = f"""WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS MATERIALIZED (SELECT rid, part, e[part * len(e) // 4 + 1 : (part + 1) * len(e) // 4] AS x FROM v, range(4) t(part)),
b0 AS MATERIALIZED (SELECT part, rid - 1 AS entry, x AS c FROM p WHERE rid <= 256),
{"".join(map(_round_sql, range(4)))}a4 AS MATERIALIZED (SELECT rid, part, min({{'d': list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c), 'entry': entry}}) AS found FROM p JOIN b4 USING (part) GROUP BY ALL),
c AS (SELECT rid, string_agg(printf('%02x', found.entry), '' ORDER BY part) AS code, CAST(sum(found.d) AS BIGINT) AS error FROM a4 GROUP BY rid),
h AS (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: CAST(x AS BIGINT)), ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM v JOIN c USING (rid), h"""

#: Stretches of a lag are islands of positions whose next four words recur that lag later; s, n, q: start, length, period.
PERIODIC_SQL = r"""WITH t AS (SELECT row_number() OVER () AS rid, doc_id, CAST(doc_id AS VARCHAR) AS s, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
crc AS (SELECT rid, doc_id, w, len(w) AS n, coalesce(xor(list_reduce(range(0, 8 * length(s)), lambda c, i: xor((xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END)) >> 1, CASE WHEN (xor(c, CASE WHEN i % 8 = 0 THEN ascii(s[i // 8 + 1]) ELSE 0 END)) % 2 = 1 THEN 3988292384 ELSE 0 END), 4294967295), 4294967295), 1) AS h FROM t),
g AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 1 + (n - (h // 10) % greatest(n, 1)) // (3 + (h // 10) % 8) AS p FROM crc),
d AS MATERIALIZED (SELECT rid, doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i >= a THEN a + (i - a) % p ELSE i END]) AS w FROM g),
x AS MATERIALIZED (SELECT rid, n, unnest(range(0, n)) AS i, unnest(w) AS word FROM d),
f AS MATERIALIZED (SELECT rid, n, i, hash(word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o) AS k, word || chr(1) || lead(word, 1) OVER o || chr(1) || lead(word, 2) OVER o || chr(1) || lead(word, 3) OVER o AS four FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
l AS (SELECT a.rid, b.i - a.i AS q, a.i FROM f a JOIN f b ON a.rid = b.rid AND a.k = b.k AND a.four = b.four AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
z AS (SELECT rid, q, min(i) AS s, count(*) + 3 + q AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM l) GROUP BY rid, q, island),
r AS MATERIALIZED (SELECT rid, s, n, min(q) AS q FROM z WHERE n >= greatest(6, 4 * q) GROUP BY rid, s, n),
b AS (SELECT rid, count(*) AS n_runs, max({'n': n, 's': -s, 'q': -q}) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS said FROM r GROUP BY rid),
o AS (SELECT DISTINCT rid, unnest(range(s + q, s + n)) AS i FROM r),
k AS (SELECT rid, string_agg(word, ' ' ORDER BY i) AS kept FROM x ANTI JOIN o USING (rid, i) GROUP BY rid)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, -best.s AS start, best.n AS length, -best.q AS period, 1000 * best.n // -best.q AS exponent_milli, sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM d LEFT JOIN b USING (rid) LEFT JOIN k USING (rid)"""

ORACLE_SQL: dict[str, str] = {
    "op1_nearest_neighbours": NEAREST_SQL,
    "op3_setsketch_near_dedup": NEAR_DEDUP_SQL,
    "op6_secret_scan": SECRETS_SQL,
    "op9_poisson_mixing": MIXING_SQL,
    "op11_vector_codes": VECTOR_CODES_SQL,
    "op12_periodic_runs": PERIODIC_SQL,
}
