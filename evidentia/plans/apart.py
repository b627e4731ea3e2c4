"""Checks of the plans in book.py that are written from each plan's rule, not from its text: places are searched character by
character, pictures are lists of 64 values, repairs are means over neighbours looked up one by one."""

from __future__ import annotations

#: The characters of each page; pixels of each picture; the damaged rectangle, from its corner and size.
CH = "ch AS MATERIALIZED (SELECT page_id, html, unnest(range(1, length(html) + 1)) AS i FROM pages)"
PX = "px AS MATERIALIZED (SELECT vec_id, i // 8 AS y, i % 8 AS x, CAST(CASE WHEN hi > lo THEN floor((e - lo) / (hi - lo) * 255) ELSE 0 END AS BIGINT) AS v FROM (SELECT vec_id, unnest(range(64)) AS i, CAST(unnest(embedding) AS DOUBLE) AS e, CAST(list_min(embedding) AS DOUBLE) AS lo, CAST(list_max(embedding) AS DOUBLE) AS hi FROM embeddings) q)"
IN = "(x - vec_id % 4 BETWEEN 0 AND 1 + vec_id % 3 AND y - vec_id // 4 % 4 BETWEEN 0 AND 1 + vec_id // 3 % 3)"
HIT = f"{PX}, h AS MATERIALIZED (SELECT vec_id, y, x, v, {IN} AS hit FROM px)"
#: Repairs: each lost pixel is the mean of what is known in its row, its picture, or within two pixels, cut to a whole number.
CAND = f"""{HIT}, kn AS MATERIALIZED (SELECT * FROM h WHERE NOT hit), gm AS (SELECT vec_id, floor(avg(v)) AS m FROM kn GROUP BY vec_id), rm AS (SELECT vec_id, y, floor(avg(v)) AS m FROM kn GROUP BY vec_id, y),
bm AS (SELECT h.vec_id, h.y, h.x, floor(avg(kn.v)) AS m FROM h JOIN kn ON kn.vec_id = h.vec_id AND kn.y BETWEEN h.y - 2 AND h.y + 2 AND kn.x BETWEEN h.x - 2 AND h.x + 2 WHERE h.hit GROUP BY ALL),
fi AS MATERIALIZED (SELECT h.vec_id, h.y, h.x, h.v AS o, h.hit, CASE WHEN h.hit THEN 0 ELSE h.v END AS d, [CASE WHEN h.hit THEN 0 ELSE h.v END, CASE WHEN h.hit THEN coalesce(rm.m, gm.m, 0) ELSE h.v END, CASE WHEN h.hit THEN coalesce(gm.m, 0) ELSE h.v END, CASE WHEN h.hit THEN coalesce(bm.m, gm.m, 0) ELSE h.v END] AS ws
  FROM h LEFT JOIN gm ON gm.vec_id = h.vec_id LEFT JOIN rm ON rm.vec_id = h.vec_id AND rm.y = h.y LEFT JOIN bm ON bm.vec_id = h.vec_id AND bm.y = h.y AND bm.x = h.x),
ca AS MATERIALIZED (SELECT vec_id, o, d, hit, k AS seq, (['conservative', 'row_mean', 'global_mean', 'box_mean'])[k + 1] AS strategy, (['conservative', 'inpainting', 'denoise', 'inpainting'])[k + 1] AS family, ws[k + 1] AS w FROM fi, range(4) s(k)),
er AS (SELECT vec_id, seq, strategy, family, avg((w - o) ** 2) AS m, avg((d - o) ** 2) AS mb, avg((w - o) ** 2) FILTER (WHERE hit) AS mi, avg((w - o) ** 2) FILTER (WHERE NOT hit) AS mo, avg(abs(w - d)) FILTER (WHERE hit) AS delta, count(*) FILTER (WHERE hit) / 64 AS coverage FROM ca GROUP BY ALL),
sd AS (SELECT *, CASE WHEN m = 0 THEN 100e0 ELSE 20 * log10(255 / sqrt(m)) END AS p, CASE WHEN mb = 0 THEN 100e0 ELSE 20 * log10(255 / sqrt(mb)) END AS pb, 100 * greatest(0e0, 1 - sqrt(coalesce(mi, 0)) / 255) AS inside FROM er),
rk AS MATERIALIZED (SELECT *, round(0.6e0 * inside + 0.4e0 * least(100e0, p), 6) AS score FROM sd)"""
FIRST = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, seq) AS k FROM rk) q WHERE k = 1)"
SEG = f"""{CH}, st AS (SELECT page_id, html, i FROM ch WHERE substr(html, i, 7) = '<script'), en AS (SELECT page_id, i FROM ch WHERE substr(html, i, 9) = '</script>'),
sg AS MATERIALIZED (SELECT st.page_id, any_value(st.html) AS html, st.i - 1 AS a, min(en.i) + 8 AS z FROM st JOIN en ON en.page_id = st.page_id AND en.i >= st.i GROUP BY st.page_id, st.i)"""
#: Four pieces of a text of four characters or more; the last takes the rest.
FR = "pc AS MATERIALIZED (SELECT doc_id, text, length(text) // 4 AS n, CAST(unnest([0, 1, 2, 3]) AS BIGINT) AS idx FROM documents WHERE length(text) >= 4), fr AS MATERIALIZED (SELECT doc_id, idx, n * idx AS off, CASE WHEN idx < 3 THEN text[n * idx + 1 : n * idx + n] ELSE text[n * 3 + 1 :] END AS data FROM pc)"
BITS = f"{PX}, bt AS MATERIALIZED (SELECT a.vec_id, a.y, a.x, a.v > b.v AS up FROM px a JOIN px b ON b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x + 1), bl AS MATERIALIZED (SELECT vec_id, list(up ORDER BY y, x) AS u FROM bt GROUP BY vec_id)"
APART_BITS = "len(list_filter(list_zip(a.u, b.u), lambda z: z[1] <> z[2]))"
COSINE = "round(1 - list_dot_product(list_transform(a.embedding, lambda t: CAST(t AS DOUBLE)), list_transform(b.embedding, lambda t: CAST(t AS DOUBLE))) / (sqrt(list_dot_product(list_transform(a.embedding, lambda t: CAST(t AS DOUBLE)), list_transform(a.embedding, lambda t: CAST(t AS DOUBLE)))) * sqrt(list_dot_product(list_transform(b.embedding, lambda t: CAST(t AS DOUBLE)), list_transform(b.embedding, lambda t: CAST(t AS DOUBLE))))), 9)"

ORACLES = {
    # carving
    "carve_marker_offsets": f"WITH {CH} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY i) AS idx, i - 1 AS start_offset FROM ch WHERE substr(html, i, 3) = '<p>'",
    "carve_nonoverlap_offsets": f"WITH {CH} SELECT page_id, count(*) AS n_markers, min(i) - 1 AS first_offset, max(i) - 1 AS last_offset FROM ch WHERE substr(html, i, 2) = '</' GROUP BY page_id",
    "carve_segments": f"WITH {SEG} SELECT * FROM (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY a) AS idx, a AS start_offset, z AS end_offset_exclusive, z - a AS size, sha256(html[a + 1 : z]) AS sha256 FROM sg) q WHERE size >= 32",
    "carve_skip_contained": f"WITH {SEG} SELECT s.page_id, (SELECT count(*) FROM sg o WHERE o.page_id = s.page_id AND o.a <= s.a) AS idx, a AS start_offset, z AS end_offset_exclusive FROM sg s WHERE NOT EXISTS (SELECT 1 FROM sg o WHERE o.page_id = s.page_id AND o.a < s.a AND o.z > s.a)",
    "carve_recall": f"WITH {SEG}, f AS (SELECT page_id, count(*) AS n FROM sg GROUP BY page_id) SELECT st.page_id, count(*) AS expected, coalesce(any_value(f.n), 0) AS found, round(coalesce(any_value(f.n), 0) / count(*), 6) AS recall FROM st LEFT JOIN f ON f.page_id = st.page_id GROUP BY st.page_id",
    "multi_format_union": f"WITH {CH}, m AS (SELECT page_id, i - 1 AS start_offset, CASE WHEN substr(html, i, 3) = '<p>' THEN 'p' WHEN substr(html, i, 4) = '<li>' THEN 'li' WHEN substr(html, i, 3) = '<a ' THEN 'a' END AS format FROM ch) SELECT page_id, format, start_offset, row_number() OVER (PARTITION BY page_id ORDER BY start_offset) AS idx FROM m WHERE format IS NOT NULL",
    "header_predicate": "SELECT page_id, CASE WHEN coalesce(html, '') = '' THEN 'empty' WHEN length(html) > 20 * 1024 * 1024 THEN 'too_large' WHEN NOT starts_with(html, '<!DOCTYPE') THEN 'bad_magic' WHEN NOT contains(html, '</html>') THEN 'truncated' WHEN length(html) <= 999 THEN 'too_small' ELSE 'ok' END AS reason FROM pages",
    "byte_le_decode": "SELECT o_orderkey, o_orderkey & 65535 AS u16, (o_orderkey & 65535) + ((o_custkey & 65535) << 16) AS u32 FROM orders",
    "hex_roundtrip": "SELECT o_orderkey, printf('%016x', o_orderkey * 7919) AS hex16, CAST(length(replace(bin(o_orderkey * 7919), '0', '')) AS INTEGER) AS ones FROM orders",
    # fragments
    "fragment_split": f"WITH {FR} SELECT doc_id, idx, off, length(data) AS size, sha256(data) AS sha256 FROM fr",
    "fragment_loss_antijoin": f"WITH {FR} SELECT doc_id, idx, length(data) AS size FROM fr WHERE (doc_id * 31 + idx * 17) % 5 = 0",
    "fragment_continuity_pairs": f"WITH {FR} SELECT a.doc_id, a.idx AS i, b.idx AS j, round(CASE WHEN right(a.data, 4) = left(b.data, 4) THEN 0.7e0 ELSE 0e0 END + 0.3e0 * (least(length(a.data), length(b.data)) / greatest(length(a.data), length(b.data))), 6) AS continuity FROM fr a JOIN fr b ON a.doc_id = b.doc_id AND a.idx <> b.idx",
    "window_hash_overlap": f"WITH {FR}, w AS MATERIALIZED (SELECT doc_id, idx, list_distinct(list_transform(range(length(data) // 8), lambda k: data[8 * k + 1 : 8 * k + 8])) AS ws FROM fr), p AS (SELECT a.doc_id, a.idx AS i, b.idx AS j, len(list_intersect(a.ws, b.ws)) AS shared, greatest(len(a.ws), len(b.ws)) AS n FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.idx < b.idx) SELECT doc_id, i, j, round(shared / n, 6) AS similarity FROM p WHERE shared > 0",
    "fragment_assemble": "SELECT doc_id, length(text) AS size, sha256(text) AS sha256 FROM documents WHERE length(text) >= 4",
    "fragment_report": "SELECT doc_id, CAST(4 AS BIGINT) AS n_fragments, CAST(CASE WHEN length(text) // 4 < 150 THEN 3 ELSE 0 END + CASE WHEN length(text) - 3 * (length(text) // 4) < 150 THEN 1 ELSE 0 END AS BIGINT) AS rejected, CAST(0 AS BIGINT) AS first_offset, 3 * (length(text) // 4) AS last_offset FROM documents WHERE length(text) >= 4",
    # damage
    "damage_rectangle": f"WITH {PX} SELECT vec_id, y, x, CASE WHEN {IN} THEN 0 ELSE v END AS v, {IN} AS hit FROM px",
    "damage_zone_fill": f"WITH {PX} SELECT vec_id, y, x, CASE WHEN {IN} THEN ([0, 255, 127])[vec_id % 3 + 1] ELSE v END AS v FROM px",
    "damage_bars": f"WITH {PX} SELECT vec_id, y, x, CASE WHEN y % 3 = vec_id % 3 THEN 0 ELSE v END AS v, y % 3 = vec_id % 3 AS hit FROM px",
    "damage_shift": f"WITH {HIT}, t AS (SELECT vec_id, y, x + 1 AS x, v FROM h WHERE hit AND x < 7) SELECT h.vec_id, h.y, h.x, CASE WHEN t.v IS NOT NULL THEN t.v WHEN hit THEN 0 ELSE h.v END AS v, hit OR t.v IS NOT NULL AS hit FROM h LEFT JOIN t ON t.vec_id = h.vec_id AND t.y = h.y AND t.x = h.x",
    "damage_square": f"WITH {PX} SELECT vec_id, y, x, CASE WHEN abs(y - 3) <= 1 AND abs(x - 3) <= 1 THEN 0 ELSE v END AS v FROM px",
    "damage_holes": f"""WITH {PX}, c AS (SELECT *, EXISTS (SELECT 1 FROM range(3) s(k) WHERE sqrt((y - (vec_id * 7919 + k * 31) % 8) ** 2 + (x - (vec_id * 104729 + k * 17) % 8) ** 2) <= 1 + (vec_id + k) % 2 + 1e-9) AS hit FROM px) SELECT vec_id, y, x, CASE WHEN hit THEN 0 ELSE v END AS v, hit FROM c""",
    "damage_block_dropout": f"WITH {PX} SELECT vec_id, y, x, v * CASE WHEN (vec_id * 7919 + y // 2 * 131 + x // 2 * 37) % 10 IN (0, 1) THEN 0 ELSE 1 END AS v FROM px",
    # masks
    "mask_frontier": f"WITH {HIT}, n AS (SELECT h.vec_id, h.y, h.x, count(b.y) AS n FROM h LEFT JOIN h b ON b.vec_id = h.vec_id AND b.hit AND ((b.y = h.y AND b.x IN (h.x - 1, h.x + 1)) OR (b.x = h.x AND b.y IN (h.y - 1, h.y + 1))) WHERE h.hit GROUP BY ALL) SELECT vec_id, y, x FROM n WHERE n < 4",
    "mask_dilate": f"WITH {PX} SELECT vec_id, y, x FROM px WHERE x - vec_id % 4 BETWEEN -1 AND 2 + vec_id % 3 AND y - vec_id // 4 % 4 BETWEEN -1 AND 2 + vec_id // 3 % 3",
    "bbox_zone": "WITH r AS (SELECT vec_id, vec_id // 4 % 4 AS y, vec_id % 4 AS x, 2 + vec_id // 3 % 3 AS h, 2 + vec_id % 3 AS w FROM embeddings) SELECT vec_id, greatest(0, y - 1) AS y0, least(7, y + h) AS y1, greatest(0, x - 1) AS x0, least(7, x + w) AS x1, least(h, 8 - y) * least(w, 8 - x) AS area FROM r",
    "mask_iou_precision_recall": "WITH q AS (SELECT row_number() OVER () AS r FROM labels WHERE quality = 1), n AS (SELECT count(*) FILTER (WHERE quality + toxic = 2) AS b, count(*) FILTER (WHERE quality + toxic >= 1) AS e, count(*) FILTER (WHERE toxic = 1) AS t, count(*) FILTER (WHERE quality = 1) AS g FROM labels) SELECT round(b / e, 6) AS iou, round(b / t, 6) AS prec, round(b / g, 6) AS recall FROM n",
    # measures
    "local_entropy_blocks": f"WITH {PX}, b AS (SELECT vec_id, y // 4 AS r, x // 4 AS c, list(v // 16) AS vs FROM px GROUP BY ALL), e AS (SELECT vec_id, r, c, list_sum(list_transform(list_distinct(vs), lambda k: -len(list_filter(vs, lambda z: z = k)) / 16e0 * log2(len(list_filter(vs, lambda z: z = k)) / 16e0 + 1e-9))) AS e FROM b) SELECT vec_id, round(avg(e), 6) AS entropy FROM e GROUP BY vec_id",
    "block_variance": f"WITH {PX} SELECT vec_id, round(avg(v * v) - avg(v) ** 2, 6) AS mean_variance, round((avg(v * v) - avg(v) ** 2) / 500, 6) AS artifact FROM px WHERE y < 4 AND x < 4 GROUP BY vec_id",
    "hist_correlation": f"WITH {HIT}, g AS (SELECT vec_id, k, (SELECT count(*) FROM h WHERE h.vec_id = e.vec_id AND v // 8 = k) AS a, (SELECT count(*) FROM h WHERE h.vec_id = e.vec_id AND CASE WHEN hit THEN 0 ELSE v END // 8 = k) AS d FROM embeddings e, range(32) s(k)) SELECT vec_id, round(greatest(0e0, coalesce(corr(a, d), 0e0)), 6) AS correlation FROM g GROUP BY vec_id",
    "gray_delta": f"WITH {HIT} SELECT vec_id, round(sum(v) FILTER (WHERE hit) / 64, 6) AS delta, round(avg(v) FILTER (WHERE hit), 6) AS delta_in, round(greatest(0.2e0, 1 - least(0.8e0, sum(v) FILTER (WHERE hit) / 64 / 80)), 6) AS consistency FROM h GROUP BY vec_id",
    "entropy_256": f"WITH {PX}, n AS (SELECT vec_id, v, count(*) AS n FROM px GROUP BY ALL) SELECT vec_id, round(sum(n / 64e0 * -log2(n / 64e0 + 1e-7)), 6) AS entropy FROM n GROUP BY vec_id",
    "percentile_threshold": """WITH s AS (SELECT l_returnflag AS f, list_sort(list(l_quantity)) AS q, list_sort(list(l_extendedprice)) AS e, count(*) - 1 AS n FROM lineitem GROUP BY 1), a AS (SELECT f, q, e, 0.05e0 * n AS a, 0.5e0 * n AS b, 0.7e0 * n AS c FROM s)
SELECT f AS l_returnflag, round(q[1 + CAST(floor(a) AS BIGINT)] + (a - floor(a)) * (q[1 + CAST(ceil(a) AS BIGINT)] - q[1 + CAST(floor(a) AS BIGINT)]), 6) AS p5, round(q[1 + CAST(floor(b) AS BIGINT)] + (b - floor(b)) * (q[1 + CAST(ceil(b) AS BIGINT)] - q[1 + CAST(floor(b) AS BIGINT)]), 6) AS p50, round(e[1 + CAST(floor(c) AS BIGINT)] + (c - floor(c)) * (e[1 + CAST(ceil(c) AS BIGINT)] - e[1 + CAST(floor(c) AS BIGINT)]), 6) AS p70 FROM a""",
    # repairs
    "psnr_mse": f"WITH {CAND} SELECT vec_id, strategy, round(m, 6) AS mse, round(p, 6) AS psnr FROM rk",
    "masked_rmse": f"WITH {CAND} SELECT vec_id, strategy, round(inside, 6) AS inside_score, round(delta, 6) AS delta_in FROM rk",
    "outside_preservation": f"WITH {CAND} SELECT vec_id, strategy, round(1 - least(1e0, coalesce(mo, 0) / greatest(mb, 1e-6)), 6) AS preservation FROM rk",
    "analysis_labels": f"WITH {CAND} SELECT vec_id, strategy, CASE WHEN score < 40 THEN 'poor' WHEN score < 60 THEN 'fair' WHEN score < 80 THEN 'good' ELSE 'excellent' END AS label FROM rk",
    "effort_multiplier": f"WITH {CAND} SELECT vec_id, strategy, round(CASE WHEN coalesce(delta, 0) >= 15 THEN least(1e0, 0.8e0 + delta / 200) WHEN coalesce(delta, 0) >= 3 THEN 0.6e0 + delta / 75 ELSE 0.45e0 END, 6) AS effort FROM rk",
    "candidate_top1": f"WITH {CAND} SELECT vec_id, first(strategy ORDER BY score DESC, seq) AS strategy, max(score) AS score FROM rk GROUP BY vec_id",
    "candidate_top3_roles": f"WITH {CAND} SELECT vec_id, first(strategy ORDER BY score DESC, seq) AS best_score, first(strategy ORDER BY family <> 'inpainting', score DESC, seq) AS best_visual, 'conservative' AS most_conservative FROM rk GROUP BY vec_id",
    "family_best": f"WITH {CAND} SELECT vec_id, family, first(strategy ORDER BY score DESC, seq) AS strategy, max(score) AS score FROM rk GROUP BY vec_id, family",
    "attempt_cap": f"WITH {CAND} SELECT vec_id, CAST(3 AS BIGINT) AS attempts, max(score) FILTER (WHERE strategy <> 'box_mean') AS best FROM rk GROUP BY vec_id",
    "corrupt_and_repair_best": f"WITH {CAND} SELECT vec_id, strategy, round(pb, 6) AS psnr_before, round(p, 6) AS psnr_after, round(inside, 6) AS inside, score, CASE WHEN p - pb <= 0.5 OR inside < 60 THEN 'not_recoverable' WHEN p - pb >= 5 AND inside >= 80 THEN 'recoverable' ELSE 'partially_recoverable' END AS class FROM {FIRST}",
    "compare_masks": f"WITH {CAND}, t AS (SELECT vec_id, max(score) FILTER (WHERE seq = 3) AS a, max(score) FILTER (WHERE seq = 1) AS b FROM rk GROUP BY vec_id) SELECT vec_id, CASE WHEN a < b THEN 'auto' ELSE 'user' END AS winner, round(a - b, 6) AS margin FROM t",
    "meta_regional_score": f"WITH {CAND}, c AS (SELECT strategy, sum(coverage) AS c FROM rk GROUP BY strategy) SELECT rk.strategy, round(sum(score * coverage / c), 6) AS weighted FROM rk JOIN c ON c.strategy = rk.strategy GROUP BY rk.strategy",
    "benchmark_summary": f"WITH {CAND} SELECT strategy, count(*) AS n, round(avg(p) - avg(pb), 3) AS psnr_gain, round(sum(score) / count(*), 2) AS mean_score FROM rk GROUP BY strategy",
    "strategy_mean_top8": f"WITH {CAND} SELECT strategy, round(avg(score), 6) AS mean_score FROM rk GROUP BY strategy ORDER BY avg(score) DESC, strategy LIMIT 8",
    "benchmark_runs": f"WITH {CAND} SELECT vec_id % 5 AS corruption_type, strategy, count(*) AS n, round(sum(p) / count(*), 6) AS psnr_after, round(sum(pb) / count(*), 6) AS psnr_before FROM rk GROUP BY ALL",
    "report_rows": f"WITH {CAND} SELECT vec_id, count(*) AS n_candidates, list_max(list(score)) AS best_score, list_min(list(score)) AS worst_score, round(list_max(list(p - pb)), 6) AS best_gain FROM rk GROUP BY vec_id",
    # similarity
    "diff_hash": f"WITH {BITS} SELECT vec_id, count(*) FILTER (WHERE up) AS ones, CAST(coalesce(sum(7 * y + x) FILTER (WHERE up), 0) AS BIGINT) AS places FROM bt GROUP BY vec_id",
    "diff_hash_pairs": f"WITH {BITS} SELECT a.vec_id AS id_a, b.vec_id AS id_b, {APART_BITS} AS distance, 1 - {APART_BITS} / 56e0 AS similarity FROM bl a JOIN bl b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 AND {APART_BITS} <= 16",
    "hash_label": f"WITH {BITS}, d AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {APART_BITS} AS distance FROM bl a JOIN bl b ON b.vec_id = a.vec_id + 1) SELECT id_a, id_b, distance, CASE WHEN distance > 20 THEN 'different' WHEN distance > 10 THEN 'related' WHEN distance > 5 THEN 'similar' WHEN distance > 0 THEN 'near' ELSE 'identical' END AS label FROM d",
    "signal_correlation": "WITH p AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, CAST(unnest(a.embedding) AS DOUBLE) AS s, CAST(unnest(b.embedding) AS DOUBLE) AS t FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT id_a, id_b, round(corr(s, t), 6) AS correlation FROM p GROUP BY ALL",
    "eps_neighbours": f"WITH d AS (SELECT a.vec_id AS id_a, {COSINE} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT id_a, count(*) AS neighbours, round(min(d), 6) AS nearest FROM d WHERE d <= 0.6 GROUP BY id_a",
    "nearest_patch_argmin": f"WITH d AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {COSINE} AS d FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) SELECT id_a, first(id_b ORDER BY d, id_b) AS id_b, round(min(d), 6) AS dist FROM d GROUP BY id_a",
    # reports and events
    "custody_chain": "WITH s AS (SELECT doc_id, unnest([1, 2, 3]) AS step, unnest(['source', 'normalized', 'tagged']) AS label, unnest([text, CASE WHEN regexp_matches(text, '\\p{Lu}') OR lower(text) <> text THEN lower(text) END, CASE WHEN lang <> 'en' THEN concat(lang, ':', text) END]) AS body FROM documents) SELECT doc_id, step, label, sha256(body) AS sha256 FROM s WHERE body IS NOT NULL",
    "status_latest": "SELECT user_id, last(event_type ORDER BY ts, event_id) AS status, last(event_id ORDER BY ts, event_id) AS event_id FROM events GROUP BY user_id",
    "timeline_last_event": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS last_id FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "timeline_elapsed": "SELECT e.event_id, date_diff('second', f.t, e.ts) AS elapsed_s FROM events e JOIN (SELECT user_id, min(ts) AS t FROM events GROUP BY user_id) f ON f.user_id = e.user_id",
    "mode_summary": "SELECT event_type AS execution_mode, count(*) AS n, round(sum(value) / count(*), 6) AS mean_value, round(count(*) FILTER (WHERE value > 50) / count(*), 6) AS improved FROM events GROUP BY event_type",
    "text_gain": "WITH t AS (SELECT conv_id, turn, length(text) AS n, lead(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS m, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) SELECT conv_id, turn, CASE WHEN n = 0 AND m > 0 THEN 1e0 WHEN m <= n THEN 0e0 ELSE round(least(1e0, (m - n) / greatest(n, 1)), 6) END AS gain FROM t WHERE nxt = turn + 1 AND n IS NOT NULL AND m IS NOT NULL",
    "format_aliases": "WITH t AS (SELECT p_type, trim(lower(p_type)) AS t FROM part) SELECT p_type AS raw, CASE WHEN t = 'jpg' THEN 'jpeg' ELSE t END AS name, count(*) AS n FROM t GROUP BY ALL",
    "detect_dark_adaptive": f"WITH {PX}, s AS (SELECT vec_id, list_sort(list(v)) AS l FROM px GROUP BY vec_id), t AS (SELECT vec_id, CASE WHEN (l[32] + l[33]) / 2 >= 60 THEN 22e0 ELSE greatest(8e0, least(30e0, 0.6e0 * (l[4] + 0.15e0 * (l[5] - l[4])))) END AS limit_ FROM s) SELECT px.vec_id, y, x, v < limit_ OR v >= 254 AS hit FROM px JOIN t ON t.vec_id = px.vec_id",
    "severity_lookup": "SELECT o_orderkey, (['heavy', 'heavy', 'medium', 'light', 'light'])[CAST(left(o_orderpriority, 1) AS INTEGER)] AS sev, ([0.6e0, 0.6e0, 0.4e0, 0.2e0, 0.2e0])[CAST(left(o_orderpriority, 1) AS INTEGER)] AS size_ratio FROM orders",
    "l2_normalize": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda t: CAST(t AS DOUBLE)) AS l FROM embeddings), n AS (SELECT vec_id, l, sqrt(list_dot_product(l, l)) AS n FROM e) SELECT vec_id, CAST(unnest(range(len(l))) AS BIGINT) AS p, round(unnest(list_transform(l, lambda t: t / CASE WHEN n = 0 THEN 1 ELSE n END)), 6) AS u FROM n",
    "feature_vector": f"WITH {PX}, m AS (SELECT vec_id, avg(v) AS m, avg(v * v) AS q, avg(v * v * v) AS c FROM px GROUP BY vec_id), s AS (SELECT *, sqrt(q - m * m) AS s FROM m) SELECT s.vec_id, round(m / 255, 6) AS mean, round(s / 255, 6) AS std, round(greatest(-1e0, least(1e0, (c - 3 * m * q + 2 * m * m * m) / (s + 1e-9) ** 3 / 10)), 6) AS skew, (SELECT count(*) FROM px WHERE px.vec_id = s.vec_id AND v <= 127) AS low_half FROM s",
    "cluster_rollup": "SELECT label, count(*) AS size, list_min(list(vec_id)) AS first_member, list_max(list(vec_id)) AS last_member, round(count(*) / any_value(n), 6) AS share FROM embeddings, (SELECT count(*) AS n FROM embeddings) c GROUP BY label",
    "status_progress": "SELECT user_id, count(*) AS completed, round(list_max(list(value)), 6) AS best, date_diff('second', min(ts), max(ts)) AS elapsed_s FROM events GROUP BY user_id",
    "progress_windows": "SELECT make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) AS hour_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
