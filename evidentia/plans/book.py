"""Relational plans as SQL over the tables, written once; DIALECT holds the few words on which the two engines differ.

`@name` is a table, `~name(` a function of the dialect. Spark runs the plan over the tables' files; the same text in the
other dialect is its check.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

DIALECT = {
    "spark": {
        "~stencils": """hz AS (SELECT vec_id, y, x, v, coalesce(lag(v) OVER a, lead(v) OVER a) AS l, coalesce(lead(v) OVER a, lag(v) OVER a) AS r FROM r WINDOW a AS (PARTITION BY vec_id, y ORDER BY x)),
hs AS (SELECT *, l + v + r AS hs, r - l AS hd, l + 2 * v + r AS hg, l * l + v * v + r * r AS hq FROM hz),
vt AS (SELECT *, coalesce(lag(v) OVER c, lead(v) OVER c) AS uv, coalesce(lead(v) OVER c, lag(v) OVER c) AS dv, coalesce(lag(hs) OVER c, lead(hs) OVER c) AS us, coalesce(lead(hs) OVER c, lag(hs) OVER c) AS ds, coalesce(lag(hd) OVER c, lead(hd) OVER c) AS ud, coalesce(lead(hd) OVER c, lag(hd) OVER c) AS dd,
  coalesce(lag(hg) OVER c, lead(hg) OVER c) AS ug, coalesce(lead(hg) OVER c, lag(hg) OVER c) AS dg, coalesce(lag(hq) OVER c, lead(hq) OVER c) AS uq, coalesce(lead(hq) OVER c, lag(hq) OVER c) AS dq FROM hs WINDOW c AS (PARTITION BY vec_id, x ORDER BY y)),
st AS (SELECT vec_id, y, x, v, l + r + uv + dv - 4 * v AS lap, ud + 2 * hd + dd AS gx, dg - ug AS gy, us + hs + ds AS s1, uq + hq + dq AS s2, ug + 2 * hg + dg AS gauss FROM vt)""",
        "~div": "div",
        "~pixels": "SELECT vec_id, CAST(p AS BIGINT) AS p, CAST(e AS DOUBLE) AS e, CAST(array_min(embedding) AS DOUBLE) AS mn, CAST(array_max(embedding) AS DOUBLE) AS mx FROM @embeddings LATERAL VIEW posexplode(embedding) t AS p, e",
        r"~sha\(([^()]*)\)": r"sha2(\1, 256)",
        r"~pct\(([^(),]*), ([^(),]*)\)": r"percentile(\1, \2)",
        r"~xor\(([^(),]*), ([^(),]*)\)": r"(\1 ^ \2)",
        r"~bytes\(([^()]*)\)": r"octet_length(\1)",
        r"~at\(([^(),]*), ([^(),]*)\)": r"instr(\1, \2)",
        r"~hex\(([^()]*)\)": r"lower(hex(\1))",
        r"~seconds\(([^(),]*), ([^(),]*)\)": r"CAST(unix_timestamp(CAST(\2 AS TIMESTAMP)) - unix_timestamp(CAST(\1 AS TIMESTAMP)) AS BIGINT)",
        r"~split\(([^(),]*), ('[^']*')\)": r"SELECT id, n, CAST(length(piece) AS BIGINT) AS len, piece FROM (SELECT id, posexplode(split(\1, '\\\\Q' || \2 || '\\\\E')) AS (n, piece) FROM src)",
        r"~series\(([^(),]*), ([^(),]*)\)": r"SELECT explode(sequence(\1, \2)) AS k",
        r"~vec": "SELECT vec_id, label, CAST(p AS BIGINT) AS p, CAST(e AS DOUBLE) AS e FROM @embeddings LATERAL VIEW posexplode(embedding) t AS p, e",
        r"~json\(([^(),]*), ([^(),]*)\)": r"get_json_object(\1, '$.' || \2)",
        r"~b64\(([^()]*)\)": r"base64(CAST(\1 AS BINARY))",
        r"~md5\(([^()]*)\)": r"md5(\1)",
    },
    "duckdb": {
        "~stencils": """nb AS (SELECT a.vec_id, a.y, a.x, a.v, b.v AS nv, CASE WHEN a.y = 0 AND dy = -1 THEN 1 WHEN a.y = 7 AND dy = 1 THEN -1 ELSE dy END AS sy, dy, dx
  FROM (SELECT r.*, j.k AS dy, i.k AS dx, CASE WHEN y + j.k < 0 THEN 1 WHEN y + j.k > 7 THEN 6 ELSE y + j.k END AS ny, CASE WHEN x + i.k < 0 THEN 1 WHEN x + i.k > 7 THEN 6 ELSE x + i.k END AS nx FROM r CROSS JOIN (~series(-1, 1)) j CROSS JOIN (~series(-1, 1)) i) a
  JOIN r b ON a.vec_id = b.vec_id AND a.ny = b.y AND a.nx = b.x),
st AS (SELECT vec_id, y, x, v, CAST(sum(CASE WHEN dy = 0 AND dx = 0 THEN -4 * nv WHEN dy = 0 OR dx = 0 THEN nv ELSE 0 END) AS BIGINT) AS lap,
  CAST(sum(nv * dx * (CASE WHEN dy = 0 THEN 2 ELSE 1 END)) AS BIGINT) AS gx, CAST(sum(nv * dy * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS BIGINT) AS gy,
  CAST(sum(nv) AS BIGINT) AS s1, CAST(sum(nv * nv) AS BIGINT) AS s2, CAST(sum(nv * (CASE WHEN dy = 0 THEN 2 ELSE 1 END) * (CASE WHEN dx = 0 THEN 2 ELSE 1 END)) AS BIGINT) AS gauss FROM nb GROUP BY vec_id, y, x, v)""",
        "~div": "//",
        "~pixels": "SELECT vec_id, CAST(unnest(range(len(embedding))) AS BIGINT) AS p, CAST(unnest(embedding) AS DOUBLE) AS e, CAST(list_min(embedding) AS DOUBLE) AS mn, CAST(list_max(embedding) AS DOUBLE) AS mx FROM embeddings",
        r"~sha\(([^()]*)\)": r"sha256(\1)",
        r"~pct\(([^(),]*), ([^(),]*)\)": r"quantile_cont(\1, \2)",
        r"~xor\(([^(),]*), ([^(),]*)\)": r"xor(\1, \2)",
        r"~bytes\(([^()]*)\)": r"strlen(\1)",
        r"~at\(([^(),]*), ([^(),]*)\)": r"instr(\1, \2)",
        r"~hex\(([^()]*)\)": r"lower(to_hex(\1))",
        r"~seconds\(([^(),]*), ([^(),]*)\)": r"CAST(epoch(date_trunc('second', \2)) - epoch(date_trunc('second', \1)) AS BIGINT)",
        r"~split\(([^(),]*), ('[^']*')\)": r"SELECT id, n - 1 AS n, CAST(length(piece) AS BIGINT) AS len, piece FROM (SELECT id, unnest(range(1, len(string_split(\1, \2)) + 1)) AS n, unnest(string_split(\1, \2)) AS piece FROM src)",
        r"~series\(([^(),]*), ([^(),]*)\)": r"SELECT unnest(range(\1, \2 + 1)) AS k",
        r"~vec": "SELECT vec_id, label, CAST(unnest(range(len(embedding))) AS BIGINT) AS p, CAST(unnest(embedding) AS DOUBLE) AS e FROM embeddings",
        r"~json\(([^(),]*), ([^(),]*)\)": r"json_extract_string(\1, '$.' || \2)",
        r"~b64\(([^()]*)\)": r"base64(encode(\1))",
        r"~md5\(([^()]*)\)": r"md5(\1)",
    },
}


def in_dialect(sql: str, dialect: str) -> str:
    sql = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", sql)  # doubles, not decimals, in either
    for word, to in DIALECT[dialect].items():
        sql = re.sub(word, to, sql)
    return sql


def for_duckdb(sql: str) -> str:
    return re.sub(r"@(\w+)", r"\1", in_dialect(sql, "duckdb"))


def on_spark(sql: str, read: Callable[[SparkSession, str, str], DataFrame] = table):
    """The plan as a query; `read` gives a table by name."""
    sql = in_dialect(sql, "spark")
    used = sorted(set(re.findall(r"@(\w+)", sql)) & set(TABLES))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for t in used:
            read(spark, sf_dir, t).createOrReplaceTempView(f"evidentia_{t}")
        return spark.sql(re.sub(r"@(\w+)", r"evidentia_\1", sql))

    return run


# ---- building blocks ----

#: 8 x 8 pictures of whole values; the damaged rectangle of each; the damaged picture (0 inside).
R = "r AS (SELECT vec_id, p ~div 8 AS y, p % 8 AS x, CAST(floor(CASE WHEN mx > mn THEN (e - mn) / (mx - mn) * 255 ELSE 0 END) AS BIGINT) AS v FROM (~pixels) q)"
M = R + ", m AS (SELECT vec_id, y, x, v, (x BETWEEN vec_id % 4 AND vec_id % 4 + 1 + vec_id % 3 AND y BETWEEN (vec_id ~div 4) % 4 AND (vec_id ~div 4) % 4 + 1 + (vec_id ~div 3) % 3) AS hit FROM r)"
C = M + ", c AS (SELECT vec_id, y, x, v AS o, hit, CASE WHEN hit THEN 0 ELSE v END AS v FROM m)"
#: Four repairs: nothing, mean of the known pixels of the row, of the picture, of the 5 x 5 around.
K = C + """, known AS (SELECT *, CASE WHEN hit THEN 0 ELSE v END AS kv, CASE WHEN hit THEN 0 ELSE 1 END AS kn FROM c),
box1 AS (SELECT *, sum(kv) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bv, sum(kn) OVER (PARTITION BY vec_id, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS bn FROM known),
fill AS (SELECT vec_id, y, x, o, v, hit,
  CAST(floor(sum(kv) OVER (PARTITION BY vec_id, y) / nullif(sum(kn) OVER (PARTITION BY vec_id, y), 0)) AS BIGINT) AS row_mean,
  CAST(floor(sum(kv) OVER (PARTITION BY vec_id) / nullif(sum(kn) OVER (PARTITION BY vec_id), 0)) AS BIGINT) AS global_mean,
  CAST(floor(sum(bv) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / nullif(sum(bn) OVER (PARTITION BY vec_id, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 0)) AS BIGINT) AS box_mean FROM box1),
cand AS (SELECT vec_id, y, x, o, v AS d, hit, 0 AS seq, 'conservative' AS strategy, 'conservative' AS family, v AS w FROM fill
  UNION ALL SELECT vec_id, y, x, o, v, hit, 1, 'row_mean', 'inpainting', CASE WHEN hit THEN coalesce(row_mean, global_mean, 0) ELSE v END FROM fill
  UNION ALL SELECT vec_id, y, x, o, v, hit, 2, 'global_mean', 'denoise', CASE WHEN hit THEN coalesce(global_mean, 0) ELSE v END FROM fill
  UNION ALL SELECT vec_id, y, x, o, v, hit, 3, 'box_mean', 'inpainting', CASE WHEN hit THEN coalesce(box_mean, global_mean, 0) ELSE v END FROM fill),
errs AS (SELECT vec_id, seq, strategy, family, avg(CAST((w - o) * (w - o) AS DOUBLE)) AS mse, avg(CAST((d - o) * (d - o) AS DOUBLE)) AS mse_before,
  avg(CASE WHEN hit THEN CAST((w - o) * (w - o) AS DOUBLE) END) AS mse_in, avg(CASE WHEN NOT hit THEN CAST((w - o) * (w - o) AS DOUBLE) END) AS mse_out,
  avg(CASE WHEN hit THEN CAST(abs(w - d) AS DOUBLE) END) AS delta_in, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS coverage FROM cand GROUP BY vec_id, seq, strategy, family),
scored AS (SELECT *, CASE WHEN mse = 0 THEN 100.0 ELSE 10 * log10(65025 / mse) END AS psnr, CASE WHEN mse_before = 0 THEN 100.0 ELSE 10 * log10(65025 / mse_before) END AS psnr_before,
  greatest(0.0, 1 - sqrt(coalesce(mse_in, 0)) / 255) * 100 AS inside FROM errs),
ranked AS (SELECT *, round(0.6 * inside + 0.4 * least(psnr, 100.0), 6) AS score FROM scored)"""
#: Sobel, Laplacian and sums of 3 x 3, with borders reflected without the edge pixel: by windows along rows, then columns, on
#: Spark; its check joins each pixel to its nine neighbours.
N = R + ", ~stencils"
#: Three masks of a picture: dark, flat in variance, flat in gradient.
D = N + """, mk AS (SELECT vec_id, y, x, v, v <= 60 AS dark, s2 / 9.0 - (s1 / 9.0) * (s1 / 9.0) < 2500 AS flat, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) < 200 AS calm FROM st)"""

PLANS: dict[str, str] = {}


def plan(name: str, sql: str) -> None:
    PLANS[name] = sql


# ---- carving: offsets, segments, recall ----

S = "src AS (SELECT page_id AS id, html AS body FROM @pages)"
OFF = ", off{i} AS (SELECT id, n, CAST(sum(len + {size}) OVER (PARTITION BY id ORDER BY n) - {size} AS BIGINT) AS spot, count(*) OVER (PARTITION BY id) AS parts FROM (~split(body, '{mark}')) s)"


def offsets(i: str, mark: str) -> str:
    return OFF.format(i=i, mark=mark, size=len(mark))


plan("carve_marker_offsets", f"WITH {S}{offsets('a', '<p>')} SELECT id AS page_id, CAST(n + 1 AS BIGINT) AS idx, spot AS start_offset FROM offa WHERE n < parts - 1")
plan("carve_nonoverlap_offsets", f"WITH {S}{offsets('a', '</')} SELECT id AS page_id, CAST(count(*) AS BIGINT) AS n_markers, min(spot) AS first_offset, max(spot) AS last_offset FROM offa WHERE n < parts - 1 GROUP BY id")
SEG = f"""WITH {S}{offsets('a', '<script')}{offsets('b', '</script>')},
marks AS (SELECT id, spot, 0 AS kind FROM offa WHERE n < parts - 1 UNION ALL SELECT id, spot, 1 FROM offb WHERE n < parts - 1),
paired AS (SELECT id, spot, kind, min(CASE WHEN kind = 1 THEN spot + 9 END) OVER (PARTITION BY id ORDER BY spot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stop FROM marks),
seg AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) AS BIGINT) AS idx, spot AS start_offset, stop AS end_offset_exclusive, stop - spot AS size FROM paired WHERE kind = 0 AND stop IS NOT NULL)"""
plan("carve_segments", f"{SEG} SELECT seg.id AS page_id, idx, start_offset, end_offset_exclusive, size, ~sha(piece) AS sha256 FROM (SELECT seg.*, substring(body, CAST(start_offset + 1 AS INT), CAST(size AS INT)) AS piece FROM seg JOIN src ON seg.id = src.id WHERE size >= 32) seg")
plan("carve_skip_contained", f"""{SEG}, prior AS (SELECT *, max(end_offset_exclusive) OVER (PARTITION BY id ORDER BY start_offset ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg)
SELECT id AS page_id, idx, start_offset, end_offset_exclusive FROM prior WHERE reach IS NULL OR start_offset >= reach""")
plan("carve_recall", f"""{SEG}, want AS (SELECT id, CAST(count(*) AS BIGINT) AS expected FROM offa WHERE n < parts - 1 GROUP BY id)
SELECT want.id AS page_id, expected, CAST(count(seg.id) AS BIGINT) AS found, round(count(seg.id) / expected, 6) AS recall FROM want LEFT JOIN seg ON want.id = seg.id GROUP BY want.id, expected""")
plan("multi_format_union", f"""WITH {S}{offsets('a', '<p>')}{offsets('b', '<li>')}{offsets('d', '<a ')}
SELECT id AS page_id, format, spot AS start_offset, CAST(row_number() OVER (PARTITION BY id ORDER BY spot, format) AS BIGINT) AS idx FROM
(SELECT id, 'p' AS format, spot FROM offa WHERE n < parts - 1 UNION ALL SELECT id, 'li', spot FROM offb WHERE n < parts - 1 UNION ALL SELECT id, 'a', spot FROM offd WHERE n < parts - 1) u""")
plan("header_predicate", """SELECT page_id, CASE WHEN html IS NULL OR length(html) = 0 THEN 'empty' WHEN length(html) > 20971520 THEN 'too_large' WHEN substring(html, 1, 9) <> '<!DOCTYPE' THEN 'bad_magic' WHEN ~at(html, '</html>') = 0 THEN 'truncated' WHEN length(html) < 1000 THEN 'too_small' ELSE 'ok' END AS reason FROM @pages""")
plan("byte_le_decode", """SELECT o_orderkey, b0 + 256 * b1 AS u16, b0 + 256 * b1 + 65536 * b2 + 16777216 * b3 AS u32 FROM
(SELECT o_orderkey, o_orderkey % 256 AS b0, (o_orderkey ~div 256) % 256 AS b1, o_custkey % 256 AS b2, (o_custkey ~div 256) % 256 AS b3 FROM @orders) q""")
plan("hex_roundtrip", "SELECT o_orderkey, lpad(~hex(o_orderkey * 7919), 16, '0') AS hex16, bit_count(o_orderkey * 7919) AS ones FROM @orders")
plan("format_aliases", "SELECT f.raw, f.name, CAST(count(*) AS BIGINT) AS n FROM (SELECT p_type AS raw, CASE WHEN lower(trim(p_type)) IN ('jpg', 'jpeg') THEN 'jpeg' ELSE lower(trim(p_type)) END AS name FROM @part) f GROUP BY f.raw, f.name")

# ---- fragments ----

FR = """fr AS (SELECT doc_id, k AS idx, k * (length(text) ~div 4) AS off, substring(text, CAST(k * (length(text) ~div 4) + 1 AS INT), CAST(CASE WHEN k = 3 THEN length(text) ELSE length(text) ~div 4 END AS INT)) AS data FROM @documents CROSS JOIN (~series(0, 3)) s WHERE length(text) >= 4)"""
plan("fragment_split", f"WITH {FR} SELECT doc_id, CAST(idx AS BIGINT) AS idx, CAST(off AS BIGINT) AS off, CAST(length(data) AS BIGINT) AS size, ~sha(data) AS sha256 FROM fr")
plan("fragment_loss_antijoin", f"""WITH {FR}, kept AS (SELECT doc_id, idx FROM fr WHERE (doc_id * 31 + idx * 17) % 5 <> 0)
SELECT fr.doc_id, CAST(fr.idx AS BIGINT) AS idx, CAST(length(fr.data) AS BIGINT) AS size FROM fr LEFT JOIN kept ON fr.doc_id = kept.doc_id AND fr.idx = kept.idx WHERE kept.idx IS NULL""")
plan("fragment_continuity_pairs", f"""WITH {FR}, pairs AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, a.data AS da, b.data AS db FROM fr a JOIN fr b ON a.doc_id = b.doc_id AND a.idx <> b.idx)
SELECT doc_id, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(0.7 * (CASE WHEN right(da, 4) = left(db, 4) THEN 1.0 ELSE 0.0 END) + 0.3 * (least(length(da), length(db)) / greatest(length(da), length(db))), 6) AS continuity FROM pairs""")
plan("fragment_assemble", f"WITH {FR} SELECT doc_id, CAST(sum(length(data)) AS BIGINT) AS size, ~sha(whole) AS sha256 FROM (SELECT doc_id, data, max(CASE WHEN idx = 0 THEN data END) OVER (PARTITION BY doc_id) || max(CASE WHEN idx = 1 THEN data END) OVER (PARTITION BY doc_id) || max(CASE WHEN idx = 2 THEN data END) OVER (PARTITION BY doc_id) || max(CASE WHEN idx = 3 THEN data END) OVER (PARTITION BY doc_id) AS whole FROM fr) q GROUP BY doc_id, whole")
plan("fragment_report", f"WITH {FR} SELECT doc_id, CAST(count(*) AS BIGINT) AS n_fragments, CAST(sum(CASE WHEN length(data) < 150 THEN 1 ELSE 0 END) AS BIGINT) AS rejected, CAST(min(off) AS BIGINT) AS first_offset, CAST(max(off) AS BIGINT) AS last_offset FROM fr GROUP BY doc_id")

# ---- damage ----

plan("damage_rectangle", f"WITH {C} SELECT vec_id, y, x, v, hit FROM c")
plan("damage_zone_fill", f"WITH {M} SELECT vec_id, y, x, CASE WHEN hit THEN CASE vec_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 255 ELSE 127 END ELSE v END AS v FROM m")
plan("damage_bars", f"WITH {R} SELECT vec_id, y, x, CASE WHEN (y - vec_id % 3) % 3 = 0 AND y >= vec_id % 3 THEN 0 ELSE v END AS v, ((y - vec_id % 3) % 3 = 0 AND y >= vec_id % 3) AS hit FROM r")
plan("damage_shift", f"""WITH {M} SELECT a.vec_id, a.y, a.x, coalesce(b.v, CASE WHEN a.hit THEN 0 ELSE a.v END) AS v, (a.hit OR b.v IS NOT NULL) AS hit FROM m a LEFT JOIN m b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = b.x + 1 AND b.hit""")
plan("damage_square", f"WITH {R} SELECT vec_id, y, x, CASE WHEN y BETWEEN 2 AND 4 AND x BETWEEN 2 AND 4 THEN 0 ELSE v END AS v FROM r")
plan("damage_holes", f"""WITH {R}, holes AS (SELECT vec_id, (vec_id * 7919 + k * 31) % 8 AS cy, (vec_id * 104729 + k * 17) % 8 AS cx, 1 + (vec_id + k) % 2 AS rad FROM @embeddings CROSS JOIN (~series(0, 2)) s)
SELECT r.vec_id, y, x, CASE WHEN count(cy) > 0 THEN 0 ELSE v END AS v, count(cy) > 0 AS hit FROM r LEFT JOIN holes h ON r.vec_id = h.vec_id AND (y - cy) * (y - cy) + (x - cx) * (x - cx) <= rad * rad GROUP BY r.vec_id, y, x, v""")
plan("damage_block_dropout", f"WITH {R} SELECT vec_id, y, x, CASE WHEN (vec_id * 7919 + (y ~div 2) * 131 + (x ~div 2) * 37) % 10 < 2 THEN 0 ELSE v END AS v FROM r")

# ---- masks and detection ----

plan("mask_union", f"WITH {D} SELECT vec_id, y, x FROM mk WHERE dark UNION SELECT vec_id, y, x FROM mk WHERE flat UNION SELECT vec_id, y, x FROM mk WHERE calm")
plan("mask_votes", f"WITH {D} SELECT vec_id, y, x, CAST(count(*) AS BIGINT) AS votes FROM (SELECT vec_id, y, x FROM mk WHERE dark UNION ALL SELECT vec_id, y, x FROM mk WHERE flat UNION ALL SELECT vec_id, y, x FROM mk WHERE calm) u GROUP BY vec_id, y, x HAVING count(*) >= 2")
plan("mask_intersection", f"WITH {D} SELECT vec_id, y, x FROM mk WHERE dark INTERSECT SELECT vec_id, y, x FROM mk WHERE flat")
plan("mask_frontier", f"WITH {M} SELECT vec_id, y, x FROM m WHERE hit EXCEPT SELECT a.vec_id, a.y, a.x FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.hit WHERE a.hit GROUP BY a.vec_id, a.y, a.x HAVING count(*) = 4")
plan("mask_dilate", f"WITH {M} SELECT DISTINCT b.vec_id, b.y, b.x FROM m a JOIN m b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 WHERE a.hit")
plan("mask_area_guard", f"WITH {D}, g AS (SELECT *, avg(CASE WHEN dark OR flat THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY vec_id) AS ratio FROM mk) SELECT vec_id, y, x, ((dark OR flat) AND ratio <= 0.5) AS hit FROM g")
plan("mask_confidence", f"""WITH {D} SELECT vec_id, round(0.6 * avg(CASE WHEN votes >= 2 THEN 1.0 ELSE 0.0 END) + 0.4 * (CASE WHEN avg(CASE WHEN votes > 0 THEN 1.0 ELSE 0.0 END) <= 0.15 THEN 1.0 WHEN avg(CASE WHEN votes > 0 THEN 1.0 ELSE 0.0 END) <= 0.30 THEN 0.7 WHEN avg(CASE WHEN votes > 0 THEN 1.0 ELSE 0.0 END) <= 0.50 THEN 0.4 ELSE 0.1 END), 6) AS confidence
FROM (SELECT vec_id, CASE WHEN dark THEN 1 ELSE 0 END + CASE WHEN flat THEN 1 ELSE 0 END + CASE WHEN calm THEN 1 ELSE 0 END AS votes FROM mk) q GROUP BY vec_id""")
plan("detect_dark_adaptive", f"WITH {R}, t AS (SELECT vec_id, ~pct(v, 0.05) AS p5, ~pct(v, 0.5) AS p50 FROM r GROUP BY vec_id), u AS (SELECT vec_id, greatest(8.0, least(30.0, CASE WHEN p50 < 60 THEN 0.6 * p5 ELSE 22.0 END)) AS thr FROM t) SELECT r.vec_id, y, x, (v < thr OR v > 253) AS hit FROM r JOIN u ON r.vec_id = u.vec_id")
plan("detect_low_variance", f"WITH {N} SELECT vec_id, y, x, s2 / 9.0 - (s1 / 9.0) * (s1 / 9.0) < 1500 AS hit FROM st")
plan("detect_flat_gradient", f"WITH {N} SELECT vec_id, y, x, sqrt(CAST(gx * gx + gy * gy AS DOUBLE)) < 150 AS hit, round(sqrt(CAST(gx * gx + gy * gy AS DOUBLE)), 6) AS magnitude FROM st")
plan("detect_fusion", f"WITH {D} SELECT vec_id, round(avg(CASE WHEN dark THEN 1.0 ELSE 0.0 END), 6) AS dark_share, round(avg(CASE WHEN dark AND flat THEN 1.0 ELSE 0.0 END), 6) AS dark_flat, round(avg(CASE WHEN dark AND calm THEN 1.0 ELSE 0.0 END), 6) AS dark_calm FROM mk GROUP BY vec_id")
plan("mask_iou_precision_recall", """SELECT round(tp / nullif(tp + fp + fn, 0), 6) AS iou, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS prec, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall FROM
(SELECT sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS fp, sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS fn FROM @labels) q""")

# ---- metrics and scores ----

plan("psnr_mse", f"WITH {K} SELECT vec_id, strategy, round(mse, 6) AS mse, round(psnr, 6) AS psnr FROM scored")
plan("masked_rmse", f"WITH {K} SELECT vec_id, strategy, round(inside, 6) AS inside_score, round(delta_in, 6) AS delta_in FROM scored")
plan("outside_preservation", f"WITH {K} SELECT vec_id, strategy, round(greatest(0.0, 1 - coalesce(mse_out, 0) / greatest(mse_before, 0.000001)), 6) AS preservation FROM scored")
plan("bbox_zone", f"WITH {M} SELECT vec_id, greatest(0, min(y) - 1) AS y0, least(7, max(y) + 1) AS y1, greatest(0, min(x) - 1) AS x0, least(7, max(x) + 1) AS x1, CAST(count(*) AS BIGINT) AS area FROM m WHERE hit GROUP BY vec_id")
plan("sharpness_laplacian", f"WITH {N} SELECT vec_id, (64 * sum(lap * lap) - sum(lap) * sum(lap)) / 4096.0 AS sharpness, least((64 * sum(lap * lap) - sum(lap) * sum(lap)) / 4096.0 / 120, 1.0) AS sharp_score, avg(CAST(abs(lap) AS DOUBLE)) AS mean_lap FROM st GROUP BY vec_id")
plan("noise_residual", f"WITH {N} SELECT vec_id, avg(abs(v - gauss / 16.0)) AS noise, 1 - least(avg(abs(v - gauss / 16.0)) / 40, 1.0) AS noise_score FROM st GROUP BY vec_id")
plan("local_entropy_blocks", f"""WITH {R}, h AS (SELECT vec_id, y ~div 4 AS blk_y, x ~div 4 AS blk_x, v ~div 16 AS bin, count(*) / 16.0 AS pr FROM r GROUP BY vec_id, y ~div 4, x ~div 4, v ~div 16)
SELECT vec_id, round(avg(en), 6) AS entropy FROM (SELECT vec_id, blk_y, blk_x, sum(-pr * log2(pr + 0.000000001)) AS en FROM h GROUP BY vec_id, blk_y, blk_x) q GROUP BY vec_id""")
plan("block_variance", f"WITH {R} SELECT vec_id, round(avg(va), 6) AS mean_variance, round(avg(va) / 500, 6) AS artifact FROM (SELECT vec_id, y ~div 4 AS blk_y, x ~div 4 AS blk_x, var_pop(v) AS va FROM r WHERE (y ~div 4) * 4 < 8 - 4 AND (x ~div 4) * 4 < 8 - 4 GROUP BY vec_id, y ~div 4, x ~div 4) q GROUP BY vec_id")
plan("hist_correlation", f"""WITH {C}, bins AS (SELECT k AS bin FROM (~series(0, 31)) s), pics AS (SELECT DISTINCT vec_id FROM r), h AS (SELECT p.vec_id, b.bin, coalesce(x.n, 0) / 64.0 AS a, coalesce(z.n, 0) / 64.0 AS d FROM pics p CROSS JOIN bins b
LEFT JOIN (SELECT vec_id, o ~div 8 AS bin, count(*) AS n FROM c GROUP BY vec_id, o ~div 8) x ON x.vec_id = p.vec_id AND x.bin = b.bin LEFT JOIN (SELECT vec_id, v ~div 8 AS bin, count(*) AS n FROM c GROUP BY vec_id, v ~div 8) z ON z.vec_id = p.vec_id AND z.bin = b.bin)
SELECT vec_id, round(greatest(0.0, coalesce((32 * sum(a * d) - sum(a) * sum(d)) / nullif(sqrt((32 * sum(a * a) - sum(a) * sum(a)) * (32 * sum(d * d) - sum(d) * sum(d))), 0), 0)), 6) AS correlation FROM h GROUP BY vec_id""")
plan("gray_delta", f"WITH {C} SELECT vec_id, round(avg(CAST(abs(o - v) AS DOUBLE)), 6) AS delta, round(coalesce(avg(CASE WHEN hit THEN CAST(abs(o - v) AS DOUBLE) END), 0), 6) AS delta_in, round(greatest(0.2, 1 - least(avg(CAST(abs(o - v) AS DOUBLE)) / 80, 0.8)), 6) AS consistency FROM c GROUP BY vec_id")
plan("percentile_threshold", "SELECT l_returnflag, round(~pct(l_quantity, 0.05), 6) AS p5, round(~pct(l_quantity, 0.5), 6) AS p50, round(~pct(l_extendedprice, 0.7), 6) AS p70 FROM @lineitem GROUP BY l_returnflag")
plan("entropy_256", f"WITH {R}, h AS (SELECT vec_id, v, count(*) / 64.0 AS pr FROM r GROUP BY vec_id, v) SELECT vec_id, round(sum(-pr * log2(pr + 0.0000001)), 6) AS entropy FROM h GROUP BY vec_id")

# ---- classifiers and lookups ----

plan("classify_damage_a", f"""WITH {N}, f AS (SELECT vec_id, avg(CASE WHEN v < 25 THEN 1.0 ELSE 0.0 END) AS dark, avg(CASE WHEN v > 245 THEN 1.0 ELSE 0.0 END) AS bright, round(var_pop(v), 6) AS va, avg(CAST(abs(lap) AS DOUBLE)) AS lap FROM st GROUP BY vec_id)
SELECT vec_id, CASE WHEN dark > 0.12 OR bright > 0.12 THEN 'mask_like' WHEN va > 4500 AND lap > 250 THEN 'noise_like' WHEN dark > 0.05 OR bright > 0.05 THEN 'mixed' ELSE 'unknown' END AS label, CASE WHEN dark > 0.12 OR bright > 0.12 THEN 0.75 WHEN va > 4500 AND lap > 250 THEN 0.65 WHEN dark > 0.05 OR bright > 0.05 THEN 0.60 ELSE 0.45 END AS confidence FROM f""")
plan("classify_damage_b", f"""WITH {N}, f AS (SELECT vec_id, (64 * sum(v * v) - sum(v) * sum(v)) / 4096.0 AS va, round(avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))), 4) AS gr FROM st GROUP BY vec_id)
SELECT vec_id, va AS variance, gr AS gradient, CASE WHEN va < 2000 THEN 'missing' WHEN va > 5500 THEN 'noise' WHEN gr < 250 THEN 'blur' WHEN gr > 450 THEN 'jpeg_block' ELSE 'mixed' END AS label FROM f""")
plan("region_type", f"WITH {N}, g AS (SELECT vec_id, y ~div 4 AS blk_y, x ~div 4 AS blk_x, avg(sqrt(CAST(gx * gx + gy * gy AS DOUBLE))) AS gr, var_pop(v) AS va FROM st GROUP BY vec_id, y ~div 4, x ~div 4) SELECT vec_id, blk_y AS block_y, blk_x AS block_x, CASE WHEN gr >= 350 THEN 'strong_edges' WHEN va >= 3500 THEN 'textured' ELSE 'homogeneous' END AS type FROM g")
plan("severity_lookup", """SELECT o_orderkey, sev, size_ratio FROM (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%' THEN 'heavy' WHEN o_orderpriority LIKE '3%' THEN 'medium' ELSE 'light' END AS sev FROM @orders) o
JOIN (SELECT 'light' AS name, 0.2 AS size_ratio UNION ALL SELECT 'medium', 0.4 UNION ALL SELECT 'heavy', 0.6) s ON o.sev = s.name""")
plan("analysis_labels", f"WITH {K} SELECT vec_id, strategy, CASE WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'poor' END AS label FROM ranked")
plan("effort_multiplier", f"WITH {K} SELECT vec_id, strategy, round(CASE WHEN coalesce(delta_in, 0) < 3 THEN 0.45 WHEN delta_in < 15 THEN 0.60 + delta_in / 75 ELSE least(1.0, 0.80 + delta_in / 200) END, 6) AS effort FROM scored")

# ---- candidates: ranking, plans, flagship ----

plan("candidate_top1", f"WITH {K} SELECT vec_id, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, seq) AS rk FROM ranked) q WHERE rk = 1")
plan("candidate_top3_roles", f"""WITH {K}, b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, seq) AS rk, row_number() OVER (PARTITION BY vec_id ORDER BY CASE WHEN family = 'inpainting' THEN 0 ELSE 1 END, score DESC, seq) AS rv FROM ranked)
SELECT vec_id, max(CASE WHEN rk = 1 THEN strategy END) AS best_score, max(CASE WHEN rv = 1 THEN strategy END) AS best_visual, max(CASE WHEN strategy = 'conservative' THEN strategy END) AS most_conservative FROM b GROUP BY vec_id""")
plan("family_best", f"WITH {K} SELECT vec_id, family, strategy, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, family ORDER BY score DESC, seq) AS rk FROM ranked) q WHERE rk = 1")
plan("attempt_cap", f"WITH {K} SELECT vec_id, CAST(count(*) AS BIGINT) AS attempts, round(max(score), 6) AS best FROM ranked WHERE seq < 3 GROUP BY vec_id")
plan("corrupt_and_repair_best", f"""WITH {K} SELECT vec_id, strategy, round(psnr_before, 6) AS psnr_before, round(psnr, 6) AS psnr_after, round(inside, 6) AS inside, score, CASE WHEN psnr - psnr_before >= 5 AND inside >= 80 THEN 'recoverable' WHEN psnr - psnr_before > 0.5 AND inside >= 60 THEN 'partially_recoverable' ELSE 'not_recoverable' END AS class
FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, seq) AS rk FROM ranked) q WHERE rk = 1""")
plan("compare_masks", f"""WITH {K} SELECT a.vec_id, CASE WHEN a.score >= b.score THEN 'user' ELSE 'auto' END AS winner, round(a.score - b.score, 6) AS margin FROM ranked a JOIN ranked b ON a.vec_id = b.vec_id WHERE a.strategy = 'box_mean' AND b.strategy = 'row_mean'""")
plan("meta_regional_score", f"WITH {K} SELECT strategy, round(sum(score * coverage) / nullif(sum(coverage), 0), 6) AS weighted FROM ranked GROUP BY strategy")

# ---- similarity, steganalysis, noise ----

plan("diff_hash", f"WITH {R} SELECT vec_id, CAST(sum(CASE WHEN v > nx THEN 1 ELSE 0 END) AS BIGINT) AS ones, CAST(sum(CASE WHEN v > nx THEN (y * 7 + x) ELSE 0 END) AS BIGINT) AS places FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS nx FROM r) q WHERE nx IS NOT NULL GROUP BY vec_id")
HB = R + ", bits AS (SELECT vec_id, y, x, CASE WHEN v > nx THEN 1 ELSE 0 END AS b FROM (SELECT *, lead(v) OVER (PARTITION BY vec_id, y ORDER BY x) AS nx FROM r) q WHERE nx IS NOT NULL)"
HP = HB + ", packed AS (SELECT vec_id, CAST(sum(b * CAST(power(2, y * 7 + x) AS BIGINT)) AS BIGINT) AS h FROM bits GROUP BY vec_id)"
plan("hash_label", f"WITH {HP}, d AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(bit_count(~xor(a.h, b.h)) AS BIGINT) AS distance FROM packed a JOIN packed b ON b.vec_id = a.vec_id + 1) SELECT id_a, id_b, distance, CASE WHEN distance = 0 THEN 'identical' WHEN distance <= 5 THEN 'near' WHEN distance <= 10 THEN 'similar' WHEN distance <= 20 THEN 'related' ELSE 'different' END AS label FROM d")
plan("noise_block_outliers", f"""WITH {N}, b AS (SELECT vec_id, y ~div 2 AS blk_y, x ~div 2 AS blk_x, (4 * sum((16 * v - gauss) * (16 * v - gauss)) - sum(16 * v - gauss) * sum(16 * v - gauss)) / 4096.0 AS va FROM st GROUP BY vec_id, y ~div 2, x ~div 2), w AS (SELECT *, avg(va) OVER (PARTITION BY vec_id) AS mu, stddev_pop(va) OVER (PARTITION BY vec_id) AS sd FROM b)
SELECT vec_id, blk_y AS block_y, blk_x AS block_x, va AS variance FROM w WHERE va > mu + 2 * sd""")
plan("signal_correlation", """WITH e AS (~vec), s AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, count(*) AS n, sum(a.e) AS sa, sum(b.e) AS sb, sum(a.e * b.e) AS sab, sum(a.e * a.e) AS saa, sum(b.e * b.e) AS sbb FROM e a JOIN e b ON a.p = b.p AND b.vec_id = a.vec_id + 1 GROUP BY a.vec_id, b.vec_id)
SELECT id_a, id_b, round(coalesce((n * sab - sa * sb) / nullif(sqrt((n * saa - sa * sa) * (n * sbb - sb * sb)), 0), 0), 6) AS correlation FROM s""")
plan("l2_normalize", "WITH e AS (~vec), n AS (SELECT vec_id, sqrt(sum(e * e)) AS len FROM e GROUP BY vec_id) SELECT e.vec_id, p, round(e / (CASE WHEN len = 0 THEN 1 ELSE len END), 6) AS u FROM e JOIN n ON e.vec_id = n.vec_id")
plan("feature_vector", f"""WITH {R}, f AS (SELECT vec_id, avg(v) AS mu, stddev_pop(v) AS sd FROM r GROUP BY vec_id) SELECT r.vec_id, round(max(mu) / 255, 6) AS mean, round(max(sd) / 255, 6) AS std, round(greatest(-1.0, least(1.0, avg(power((v - mu) / (sd + 0.000000001), 3)) / 10)), 6) AS skew, CAST(sum(CASE WHEN v < 128 THEN 1 ELSE 0 END) AS BIGINT) AS low_half FROM r JOIN f ON r.vec_id = f.vec_id GROUP BY r.vec_id""")
plan("cluster_rollup", "SELECT label, CAST(count(*) AS BIGINT) AS size, min(vec_id) AS first_member, max(vec_id) AS last_member, round(count(*) / (SELECT count(*) FROM @embeddings), 6) AS share FROM @embeddings GROUP BY label")

# ---- reports, audit, status, timeline ----

plan("custody_chain", """SELECT doc_id, step, label, sha256 FROM (SELECT doc_id, 1 AS step, 'source' AS label, ~sha(text) AS sha256 FROM @documents UNION ALL SELECT doc_id, 2, 'normalized', ~sha(norm) FROM (SELECT doc_id, lower(text) AS norm FROM @documents WHERE text <> lower(text)) a UNION ALL SELECT doc_id, 3, 'tagged', ~sha(tagged) FROM (SELECT doc_id, lang || ':' || text AS tagged FROM @documents WHERE lang <> 'en') b) u""")
plan("benchmark_summary", f"WITH {K} SELECT strategy, CAST(count(*) AS BIGINT) AS n, round(avg(psnr - psnr_before), 3) AS psnr_gain, round(avg(score), 2) AS mean_score FROM ranked GROUP BY strategy")
plan("strategy_mean_top8", f"WITH {K} SELECT strategy, mean_score FROM (SELECT strategy, round(avg(score), 6) AS mean_score, row_number() OVER (ORDER BY avg(score) DESC, strategy) AS rk FROM ranked GROUP BY strategy) q WHERE rk <= 8")
plan("benchmark_runs", f"WITH {K} SELECT vec_id % 5 AS corruption_type, strategy, CAST(count(*) AS BIGINT) AS n, round(avg(psnr), 6) AS psnr_after, round(avg(psnr_before), 6) AS psnr_before FROM ranked GROUP BY vec_id % 5, strategy")
plan("mode_summary", "SELECT event_type AS execution_mode, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS mean_value, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END), 6) AS improved FROM @events GROUP BY event_type")
plan("status_latest", "SELECT user_id, event_type AS status, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM @events) q WHERE rk = 1")
plan("status_progress", "SELECT user_id, CAST(count(*) AS BIGINT) AS completed, round(max(value), 6) AS best, ~seconds(min(ts), max(ts)) AS elapsed_s FROM @events GROUP BY user_id".replace("~seconds(min(ts), max(ts))", "max(el)").replace("FROM @events", "FROM (SELECT user_id, value, ~seconds(t0, ts) AS el FROM (SELECT user_id, value, ts, min(ts) OVER (PARTITION BY user_id) AS t0 FROM @events) a) b"))
plan("timeline_elapsed", "SELECT event_id, ~seconds(t0, ts) AS elapsed_s FROM (SELECT event_id, ts, min(ts) OVER (PARTITION BY user_id) AS t0 FROM @events) q")
plan("timeline_last_event", "SELECT user_id, max(event_id) AS last_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM @events WHERE event_type = 'purchase') q WHERE rk = 1 GROUP BY user_id")
plan("progress_windows", "SELECT date_trunc('hour', ts) AS hour_start, event_type, CAST(count(*) AS BIGINT) AS n, round(sum(value), 4) AS total FROM @events GROUP BY date_trunc('hour', ts), event_type")
plan("text_gain", "SELECT a.conv_id, a.turn, CASE WHEN length(a.text) = 0 AND length(b.text) > 0 THEN 1.0 ELSE round(least(1.0, greatest(0, length(b.text) - length(a.text)) / greatest(length(a.text), 1)), 6) END AS gain FROM @conversations a JOIN @conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
plan("report_rows", f"WITH {K} SELECT vec_id, CAST(count(*) AS BIGINT) AS n_candidates, round(max(score), 6) AS best_score, round(min(score), 6) AS worst_score, round(max(psnr - psnr_before), 6) AS best_gain FROM ranked GROUP BY vec_id")
