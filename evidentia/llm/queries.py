"""The thin queries of the operators, in production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .common import table


def op1_lines(spark, sf_dir):
    from .lines import line_quality

    return line_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_toxicity(spark, sf_dir):
    from .toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_rules(spark, sf_dir):
    from .rules import quality_rules

    found = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")


def op4_suffixes(spark, sf_dir):
    from .suffixes import exact_repeats

    return exact_repeats(table(spark, sf_dir, "documents"), 100)


def op5_mixing(spark, sf_dir):
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("copies")


def op6_decontaminate(spark, sf_dir):
    from .decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_langid(spark, sf_dir):
    from .langid import language_id

    return language_id(table(spark, sf_dir, "documents"))


def op8_passages(spark, sf_dir):
    from .passages import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents"))


def op9_simhash(spark, sf_dir):
    from .simhash import hex16, near_components

    return near_components(table(spark, sf_dir, "documents"), 3).select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op10_warc(spark, sf_dir):
    from .warc import round_trip

    return round_trip(table(spark, sf_dir, "pages"), 0).drop("payload")


def op11_variants(spark, sf_dir):
    from .variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_lines(spark, sf_dir):
    from .linededup import line_digests

    return line_digests(table(spark, sf_dir, "documents"))


def op13_divergence(spark, sf_dir):
    from .divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES = {"op1_lines": op1_lines, "op2_toxicity": op2_toxicity, "op3_rules": op3_rules, "op4_suffixes": op4_suffixes, "op5_mixing": op5_mixing, "op6_decontaminate": op6_decontaminate, "op7_langid": op7_langid, "op8_passages": op8_passages, "op9_simhash": op9_simhash, "op10_warc": op10_warc, "op11_variants": op11_variants, "op12_lines": op12_lines, "op13_divergence": op13_divergence}

#: Learned models, XXH64 fingerprints, Pareto ranks, similar passages and edit distances have no SQL; tests/llm holds
#: these against brute force or held-out labels.
ORACLES: dict[str, str] = {
    "op4_suffixes": """WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM t WHERE length(h) >= 200) q),
g AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS n FROM w) q WHERE n > 1),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM g),
r AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i) q GROUP BY doc_id, k),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM r),
k AS (SELECT e.doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept FROM e JOIN t ON e.doc_id = t.doc_id GROUP BY e.doc_id)
SELECT t.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM t LEFT JOIN k ON t.doc_id = k.doc_id""",
    "op10_warc": """SELECT page_id, strlen(body) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(h, (i // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS first FROM (SELECT page_id, coalesce(html, '') AS body FROM pages) a) b""",
    "op11_variants": """WITH k AS MATERIALIZED (SELECT list_transform(range(0, 256), lambda c: list_reduce(list_prepend(c, range(0, 8)), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS crc),
r AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) q),
c AS MATERIALIZED (SELECT run, n, hex(encode(id || ':' || run)) AS x FROM (SELECT id, run, count(*) AS n FROM r WHERE length(run) >= 7 GROUP BY id, run) q),
h AS (SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda a, b: xor(a >> 8, crc[1 + xor(a % 256, b)]))) AS h FROM c, k),
o AS (SELECT n, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS less FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w) q),
e AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.less = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.less = w.word),
b AS MATERIALIZED (SELECT word, count(*) AS n_near, max(other_n) AS top FROM e GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 10 * w.n THEN (SELECT min(other) FROM e WHERE e.word = w.word AND other_n = top) END AS form, CASE WHEN top >= 10 * w.n THEN top END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
s AS (WITH RECURSIVE s AS (SELECT word, word AS root FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.root = f.word WHERE f.form IS NOT NULL) SELECT * FROM s)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT s.word, s.root FROM s JOIN f g ON s.root = g.word WHERE g.form IS NULL) t ON t.word = f.word""",
    "op12_lines": """WITH t AS MATERIALIZED (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS MATERIALIZED (SELECT doc_id, i, lines[i] AS line, translate(trim(lines[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM t) q),
k AS (SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND doc_id <> keeper) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (keeper IS NULL OR doc_id = keeper), '')) AS kept_sha256
FROM l LEFT JOIN k ON l.key = k.key GROUP BY l.doc_id""",
    "op13_divergence": r"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS MATERIALIZED (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
v AS MATERIALIZED (SELECT lang, term, count(*) AS c FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
l AS MATERIALIZED (SELECT lang, count(*) AS v, sum(c) AS n FROM v GROUP BY lang),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
c AS MATERIALIZED (SELECT w.lang, source, w.term, count(*) AS c FROM w JOIN v ON w.lang = v.lang AND w.term = v.term GROUP BY w.lang, source, w.term),
n AS MATERIALIZED (SELECT g.lang, g.source, coalesce(l.v, 0) AS v, coalesce(l.n, 0) AS ln, coalesce((SELECT sum(c) FROM c WHERE c.lang = g.lang AND c.source = g.source), 0) AS n FROM g LEFT JOIN l ON g.lang = l.lang),
p AS MATERIALIZED (SELECT n.lang, n.source, v.term, coalesce(c.c, 0) AS c, 1 + (1000000000 * CAST(coalesce(c.c, 0) + 1 AS HUGEINT)) // (n.n + n.v) AS p, 1 + (1000000000 * CAST(v.c + 1 AS HUGEINT)) // (n.ln + n.v) AS q
  FROM n JOIN v ON n.lang = v.lang LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = v.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
x AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) y WHERE part = 'pair' OR rank <= 200""",
}
