"""Driver queries of this subpackage: ``QUERIES[name] = (function, SQL or None)``.

Each function applies its operator with production parameters to the whole
table; the SQL computes the same rows in DuckDB where SQL can express them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from spreadforge.llm import bpe, decontaminate, fingerprint, lines, mix, paragraphs, quality, ranked, secrets, simhash, spelling, suffixes, urls
from spreadforge.llm.tables import table

QUERIES: dict = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = (fn, sql)
        return fn
    return put


# ---------------------------------------------------------------- op1

SQL_SUFFIXES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT rid, p, md5(substr(h, 2 * p - 1, 400)) AS m
      FROM (SELECT rid, h, unnest(range(1, length(h) // 2 - 198)) AS p FROM d WHERE length(h) >= 400)),
st AS (SELECT rid, p FROM s WHERE m IN (SELECT m FROM s GROUP BY m HAVING count(*) > 1)),
g AS (SELECT rid, p, sum(n) OVER (PARTITION BY rid ORDER BY p) AS island
      FROM (SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + 200 THEN 0 ELSE 1 END AS n FROM st)),
r AS (SELECT rid, min(p) AS lo, max(p) + 200 AS hi FROM g GROUP BY rid, island),
k AS (SELECT rid, lo, hi, coalesce(lag(hi) OVER (PARTITION BY rid ORDER BY lo), 1) AS before FROM r),
a AS (SELECT rid, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS tail FROM k GROUP BY rid),
t AS (SELECT k.rid, string_agg(substr(h, 2 * before - 1, 2 * (lo - before)), '' ORDER BY lo) AS head FROM k JOIN d USING (rid) GROUP BY k.rid)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(tail, 1) - 1))) AS kept_sha256
FROM d LEFT JOIN a USING (rid) LEFT JOIN t USING (rid)
"""


@query("op1_suffix_dedup", SQL_SUFFIXES)
def op1(spark, sf_dir):
    return suffixes.report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op2

SQL_DECONTAMINATION = r"""
WITH tok AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
itok AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM itok WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM tok, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, win.n FROM grams JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT tok.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tok LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op2_decontamination", SQL_DECONTAMINATION)
def op2(spark, sf_dir):
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


# ---------------------------------------------------------------- op3

SQL_MIX = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS digest,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source IS NULL, source COLLATE C)) - 1) % 3 + 1] AS w,
         source_size * 3.0::DOUBLE AS cap FROM s),
r AS (SELECT *, cap / w AS ratio FROM w),
b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS capped, coalesce(sum(w) OVER o, 0) AS w_capped,
         CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(w) OVER () AS all_w
  FROM r WINDOW o AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (total - capped) / (all_w - w_capped) AS level FROM b),
first_open AS (SELECT ratio AS r0, level AS l0 FROM l WHERE ratio >= level ORDER BY ratio, level LIMIT 1),
t AS (
  SELECT source, source_size, CASE WHEN ratio < r0 THEN cap ELSE least(cap, l0 * w) END AS target,
         CAST(('0x' || substr(md5('17:' || coalesce('s' || source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM l, first_open),
k AS (
  SELECT d.*, row_number() OVER (PARTITION BY d.source ORDER BY size, ((coalesce(doc_id, 0) % 64) + 64) % 64, doc_id, digest) AS rank FROM d)
SELECT doc_id, size, source_size, target,
       size * CAST(floor(rank * rate + u) - floor((rank - 1) * rate + u) AS BIGINT) AS taken
FROM (SELECT k.doc_id, k.size, t.source_size, t.target, k.rank, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
"""


@query("op3_mixture", SQL_MIX)
def op3(spark, sf_dir):
    drawn = mix.copies(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


# ---------------------------------------------------------------- op9

SQL_LINES = r"""
WITH d AS (SELECT DISTINCT doc_id, text FROM documents),
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS w FROM d),
win AS (
  SELECT doc_id, i, w[i:i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM l WHERE len(w) >= 3)),
f AS (SELECT *, first_value(doc_id) OVER o AS d0, first_value(i) OVER o AS i0 FROM win
      WINDOW o AS (PARTITION BY g ORDER BY doc_id, i)),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = d0 THEN greatest(i, i0 + 3) ELSE i END, i + 3)) AS p
  FROM f WHERE NOT (doc_id = d0 AND i = i0)),
line AS (SELECT doc_id, p, w[p] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM l)),
m AS (
  SELECT line.doc_id, line.p, t, gone.p IS NOT NULL AS g,
         lag(gone.p IS NOT NULL, 1, false) OVER (PARTITION BY line.doc_id ORDER BY line.p) AS before
  FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.p = gone.p)
SELECT d.doc_id, count(m.p) AS n_lines, count(*) FILTER (WHERE g) AS n_removed, count(*) FILTER (WHERE g AND NOT before) AS n_spans,
       sha256(coalesce(string_agg(t, chr(10) ORDER BY p) FILTER (WHERE NOT g), '')) AS kept_sha256
FROM d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""


@query("op9_line_dedup", SQL_LINES)
def op9(spark, sf_dir):
    return lines.report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op6

@query("op6_simhash")
def op6(spark, sf_dir):
    found = simhash.groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


# ---------------------------------------------------------------- op10

@query("op10_paragraph_dedup")
def op10(spark, sf_dir):
    return paragraphs.report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op7

@query("op7_quality")
def op7(spark, sf_dir):
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# ---------------------------------------------------------------- op4

@query("op4_secrets")
def op4(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op5

@query("op5_fingerprints")
def op5(spark, sf_dir):
    return fingerprint.report(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op8

@query("op8_url_filter")
def op8(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return urls.judge(pages, urls.labelled_pages(pages, table(spark, sf_dir, "labels")))


# ---------------------------------------------------------------- op13

@query("op13_bpe")
def op13(spark, sf_dir):
    return bpe.report(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


# ---------------------------------------------------------------- op12

@query("op12_spelling")
def op12(spark, sf_dir):
    return spelling.variants(table(spark, sf_dir, "documents"))


# ---------------------------------------------------------------- op11

SQL_RANKED = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
i AS (
  SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
g AS (SELECT CAST(count(*) FILTER (WHERE len(t) > 0) AS BIGINT) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM d),
p AS (SELECT rid, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT rid, doc_id, CAST(len(t) AS BIGINT) AS n, unnest(t) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p, g WHERE term IN (SELECT term FROM i) GROUP BY term, n_docs),
s AS (
  SELECT item_id, text, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN w USING (term) JOIN p USING (term), g GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 10
"""


@query("op11_ranked", SQL_RANKED)
def op11(spark, sf_dir):
    return ranked.ranking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
