"""The queries of the ten operators over their whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, language, lines, links, quality, shards, simhash, sketches
from tidemark.llm.common import table

#: Sites by name, under any prefix and ending.
TRUSTED = ("tionsh", "tionble", "ththes")
BLOCKED = ("casino-win", "free-bets", "ads-track", "spam-farm", "cheap-pills", "adult-x")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op3_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = links.filter_urls(table(spark, sf_dir, "pages"), list(TRUSTED), list(BLOCKED))
    return out.withColumns({c: F.round(c, 4) for c in ("trust", "distrust")})


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shard(table(spark, sf_dir, "documents"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sketches.version_changes(table(spark, sf_dir, "documents"))
    return out.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("added", "removed")})


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_quality, op2_bpe, op3_urls, op4_simhash, op5_token_counts, op6_language, op7_line_dedup, op8_decontamination, op9_shards, op10_fingerprints)
    return {f.__name__: f for f in every}


# --- SQL ------------------------------------------------------------------------------------------

_BLANKLESS = r"regexp_matches(line, '[^ \t\n\x0B\f\r]')"

OP7 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
k AS (SELECT doc_id, line, pos, {_BLANKLESS} AND row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS LAST, pos) > 1 AS gone FROM l),
j AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept, bool_or(gone) AS cut FROM k GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN j.cut THEN j.kept ELSE d.text END AS text, d.lang, d.source,
       CASE WHEN j.cut THEN length(j.kept) ELSE d.n_chars END AS n_chars
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id
"""

_LEAST = decontaminate.GRAM + decontaminate.WINDOW - 1
_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}]+')"

OP8 = f"""
WITH dw AS (SELECT doc_id, {_WORDS} AS w FROM documents), bw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
dp AS (SELECT doc_id, w, unnest(range(1, len(w) - {_LEAST - 2})) AS pos FROM dw WHERE len(w) >= {_LEAST}),
bp AS (SELECT item_id, w, unnest(range(1, len(w) - {_LEAST - 2})) AS ipos FROM bw WHERE len(w) >= {_LEAST}),
dg AS (SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + {_LEAST - 1}), ' ') AS g FROM dp),
bg AS (SELECT item_id, ipos, array_to_string(list_slice(w, ipos, ipos + {_LEAST - 1}), ' ') AS g FROM bp),
h AS (SELECT doc_id, item_id, pos, pos - ipos AS shift FROM dg JOIN bg USING (g)),
i AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos) AS island FROM h),
r AS (SELECT doc_id, item_id, shift, island, count(*) + {_LEAST - 1} AS words FROM i GROUP BY ALL)
SELECT doc_id, item_id, count(*)::BIGINT AS n_spans, max(words)::BIGINT AS longest FROM r GROUP BY doc_id, item_id
"""

OP9 = f"""
WITH s AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes FROM documents),
t AS (SELECT greatest(1, (sum(n_bytes)::BIGINT + {shards.SHARDS - 1}) // {shards.SHARDS})::BIGINT AS target, sum(n_bytes)::BIGINT AS total FROM s),
c AS (SELECT doc_id, n_bytes, (sum(n_bytes) OVER (ORDER BY doc_id NULLS LAST, n_bytes ROWS UNBOUNDED PRECEDING) - n_bytes)::BIGINT AS begun FROM s)
SELECT doc_id, n_bytes, begun AS "start", least(begun // target, greatest(total - 1, 0) // target)::BIGINT AS shard FROM c, t
"""

OP10 = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
p AS (SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id, line ORDER BY pos) AS n FROM l WHERE {_BLANKLESS}),
d AS MATERIALIZED (SELECT doc_id, ('0x' || left(md5(n || ':' || line), 15))::BIGINT AS digest FROM p),
g AS MATERIALIZED (SELECT doc_id, count(*)::BIGINT AS n_paragraphs, list_sort(list(digest)) AS digests FROM d GROUP BY doc_id),
c AS (SELECT digest, {sketches.WEIGHT} // count(*) AS weight FROM d GROUP BY digest),
t AS (SELECT doc_id, sum(weight) AS whole FROM d JOIN c USING (digest) GROUP BY doc_id),
e AS (SELECT doc_id, weight, lag(doc_id) OVER (PARTITION BY digest ORDER BY doc_id) AS earlier FROM d JOIN c USING (digest)),
v AS (SELECT doc_id, earlier, sum(weight) AS shared FROM e WHERE earlier IS NOT NULL GROUP BY ALL),
b AS (SELECT doc_id, earlier AS version_of, shared FROM v QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY shared DESC, earlier DESC) = 1),
w AS (SELECT g.doc_id, version_of, n_paragraphs, digests FROM g JOIN b ON g.doc_id = b.doc_id JOIN t ON g.doc_id = t.doc_id WHERE shared >= whole / {sketches.LEAST_SHARED}e0)
SELECT s.doc_id, w.version_of, coalesce(a.n_paragraphs, 0)::BIGINT AS n_paragraphs,
       CASE WHEN o.doc_id IS NOT NULL THEN array_to_string(list_filter(w.digests, lambda x: NOT list_contains(o.digests, x)), ',') END AS added,
       CASE WHEN o.doc_id IS NOT NULL THEN array_to_string(list_filter(o.digests, lambda x: NOT list_contains(w.digests, x)), ',') END AS removed
FROM documents s LEFT JOIN g a ON s.doc_id = a.doc_id LEFT JOIN w ON s.doc_id = w.doc_id LEFT JOIN g o ON o.doc_id = w.version_of
"""


def _host(url: str) -> str:
    return f"nullif(regexp_replace(lower(regexp_extract({url}, '{links._HOST}', 1)), '\\.$', ''), '')"


def _op3() -> str:
    """links.filter_urls with sites by name, by 150 steps of one recursion; 0.85 ** 150 is below 1e-10."""
    link = links._LINK.replace("'", "''")
    any_of = lambda names: f"regexp_matches('.' || host, '\\.({'|'.join(names)})\\.')"
    return f"""
WITH RECURSIVE p AS MATERIALIZED (SELECT page_id, {_host('url')} AS host, coalesce(html, '') AS html FROM pages),
l AS (SELECT host, unnest(regexp_extract_all(html, '{link}', 1)) AS link FROM p WHERE host IS NOT NULL),
w AS MATERIALIZED (SELECT host AS src, coalesce({_host('link')}, host) AS dst, count(*)::DOUBLE AS weight FROM l GROUP BY ALL),
n AS MATERIALIZED (SELECT host FROM p WHERE host IS NOT NULL UNION SELECT dst FROM w),
u AS (SELECT host AS src, regexp_extract(host, '{links._SITE}', 1) AS dst FROM n),
e AS MATERIALIZED (SELECT src, dst, sum(weight) AS weight FROM (SELECT * FROM w UNION ALL SELECT src, dst, 1e0 FROM u WHERE dst <> '' UNION ALL SELECT dst, src, 1e0 FROM u WHERE dst <> '') WHERE src <> dst GROUP BY ALL),
a AS MATERIALIZED (SELECT host FROM n UNION SELECT src FROM e UNION SELECT dst FROM e),
s AS MATERIALIZED (SELECT 'b' AS walk, host FROM a WHERE {any_of(BLOCKED)} UNION ALL SELECT 't', host FROM a WHERE {any_of(TRUSTED)} AND NOT {any_of(BLOCKED)}),
b AS (SELECT 'b' AS walk, src AS host, dst AS next, weight FROM e UNION ALL SELECT 't', dst, src, weight FROM e),
m AS MATERIALIZED (SELECT walk, host, next, {links.DAMPING}e0 * weight / sum(weight) OVER (PARTITION BY walk, host) AS share FROM b WHERE (walk, host) NOT IN (SELECT (walk, host) FROM s)),
r AS (SELECT walk, host, 1e0 AS score, 0 AS step FROM s UNION ALL
      SELECT walk, host, sum(score), step + 1 FROM (SELECT m.walk, m.host, r.score * m.share AS score, r.step FROM r JOIN m ON m.walk = r.walk AND m.next = r.host UNION ALL
                                                    SELECT r.walk, r.host, r.score, r.step FROM r JOIN s ON s.walk = r.walk AND s.host = r.host) WHERE step < 150 GROUP BY walk, host, step),
f AS (SELECT host, coalesce(max(score) FILTER (walk = 't'), 0) AS trust, coalesce(max(score) FILTER (walk = 'b'), 0) AS distrust FROM r WHERE step = 150 GROUP BY host),
o AS (SELECT page_id, p.host, coalesce(trust, 0) AS t, coalesce(distrust, 0) AS d, coalesce({any_of(BLOCKED).replace("|| host", "|| p.host")}, false) AS bad FROM p LEFT JOIN f ON p.host = f.host)
SELECT page_id, host, CASE WHEN host IS NOT NULL THEN round(t, 4) END AS trust, CASE WHEN host IS NOT NULL THEN round(d, 4) END AS distrust,
       host IS NOT NULL AND NOT bad AND (d < {links.MOST_BAD_LINKS!r} OR (t >= {links.LEAST_BACKING!r} AND t > d)) AS keep
FROM o
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that it can express: no model, tokenizer, compressor or SimHash is needed."""
    return {"op3_urls": _op3(), "op7_line_dedup": OP7, "op8_decontamination": OP8, "op9_shards": OP9, "op10_fingerprints": OP10}
