"""The registered queries as SQL that DuckDB runs on the same tables."""

from __future__ import annotations

VEC = """v AS (SELECT vec_id AS id, label AS subject, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
n AS (SELECT id, subject, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS f FROM v)"""
COS = VEC + """, cosp AS (SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.f, b.f) AS cos FROM n a JOIN n b ON a.subject = b.subject AND a.id < b.id
WHERE list_dot_product(a.f, b.f) >= 0.35)"""
HAM = """s AS (SELECT vec_id AS id, label AS subject, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings),
hamp AS (SELECT x.id AS id_a, y.id AS id_b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS dist
FROM s x JOIN s y ON x.id < y.id WHERE list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) <= 18)"""
GROUPS = COS + """, sym AS (SELECT id_a AS a, id_b AS b FROM cosp UNION SELECT id_b, id_a FROM cosp),
reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, s.b FROM reach r JOIN sym s ON r.b = s.a),
grouped AS (SELECT v.id, v.subject, min(r.b) AS grp FROM v JOIN reach r ON r.a = v.id GROUP BY v.id, v.subject)"""
ITEMS = """items AS (SELECT vec_id AS image_id, label AS subject, CASE WHEN label % 2 = 1 THEN 'F' ELSE 'M' END AS gender,
CASE WHEN vec_id % 10 < 6 THEN 'train' WHEN vec_id % 10 = 6 THEN 'val' ELSE 'test' END AS split FROM embeddings)"""
SUBJECTS = "subj AS (SELECT c_name AS subject, CASE WHEN c_custkey % 5 < 2 THEN 'F' ELSE 'M' END AS gender FROM customer)"
OUT = VEC + """, cell AS (SELECT subject, unnest(f) AS x, generate_subscripts(f, 1) AS k FROM n),
mean AS (SELECT subject, k, avg(x) AS m FROM cell GROUP BY subject, k), cen AS (SELECT subject, list(m ORDER BY k) AS c FROM mean GROUP BY subject),
cs AS (SELECT n.id, n.subject, list_dot_product(n.f, c) / sqrt(list_dot_product(c, c)) AS cs FROM n JOIN cen USING (subject)),
outl AS (SELECT id, subject, CASE WHEN cnt >= 3 THEN cs END AS cos_to_centroid, CASE WHEN cnt >= 3 THEN CASE WHEN sd < 1e-8 THEN 0 ELSE (cs - mu) / sd END END AS z
FROM (SELECT *, count(*) OVER w AS cnt, avg(cs) OVER w AS mu, stddev_pop(cs) OVER w AS sd FROM cs WINDOW w AS (PARTITION BY subject)))"""
FOLDS = SUBJECTS + """, folds AS (SELECT subject, gender, CAST((CAST('0x' || substr(md5('42|' || gender), 1, 4) AS BIGINT)
+ row_number() OVER (PARTITION BY gender ORDER BY md5('42|' || subject), subject) - 1) % 5 AS INTEGER) AS fold FROM subj)"""
PROTO = VEC + """, cell AS (SELECT subject, unnest(f) AS x, generate_subscripts(f, 1) AS k FROM n WHERE id % 10 < 6),
mean AS (SELECT subject, k, avg(x) AS m FROM cell GROUP BY subject, k), cen AS (SELECT subject AS cls, list(m ORDER BY k) AS c FROM mean GROUP BY subject),
scores AS (SELECT n.id AS probe, n.subject AS y, cls, round(list_dot_product(n.f, c) / sqrt(list_dot_product(c, c)), 9) AS score FROM n, cen WHERE n.id % 10 >= 6),
placed AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY score DESC, cls) AS place FROM scores),
pred AS (SELECT probe, y, cls AS pred FROM placed WHERE place = 1)"""
PRF = """cnt AS (SELECT cls, count(*) FILTER (y = cls AND pred = cls) AS tp, count(*) FILTER (y <> cls AND pred = cls) AS fp, count(*) FILTER (y = cls AND pred <> cls) AS fn
FROM pred, (SELECT DISTINCT y AS cls FROM pred) GROUP BY cls),
prf AS (SELECT cls, tp + fn AS support, CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) ELSE 0 END AS r,
CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM cnt)"""
PRF_COLS = """round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(f), 6) AS macro_f1, round(sum(p * support) / sum(support), 6) AS weighted_precision,
round(sum(r * support) / sum(support), 6) AS weighted_recall, round(sum(f * support) / sum(support), 6) AS weighted_f1"""
BIN = """bin AS (SELECT d.source AS subject, l.quality AS y, d.n_chars / (d.n_chars + 1500.0) AS p FROM documents d JOIN labels l USING (doc_id)),
binp AS (SELECT *, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM bin),
bc AS (SELECT CAST(count(*) FILTER (y = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y <> 1 AND pred = 1) AS DOUBLE) AS fp,
CAST(count(*) FILTER (y = 1 AND pred <> 1) AS DOUBLE) AS fn, CAST(count(*) FILTER (y <> 1 AND pred <> 1) AS DOUBLE) AS tn FROM binp)"""
AUC = """auc AS (SELECT 100.0 * (sum(CASE WHEN y = 1 THEN r END) - n1 * (n1 + 1) / 2.0) / (n1 * n0) AS auc FROM (SELECT y, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0 AS r,
count(*) FILTER (y = 1) OVER () AS n1, count(*) FILTER (y <> 1) OVER () AS n0 FROM bin) GROUP BY n1, n0)"""
MCC = "100.0 * (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))"
CLUSTERS = """clu AS (SELECT vec_id AS id, label AS y, list_position(embedding[1:10], list_max(embedding[1:10])) - 1 AS cluster FROM embeddings),
cont AS (SELECT cluster, y, count(*) AS n FROM clu GROUP BY cluster, y)"""
RANKS = VEC + """, gal AS (SELECT min(id) AS gid FROM v GROUP BY subject),
best AS (SELECT p.id AS probe, p.subject AS y, g.subject AS cls, max(round(list_dot_product(p.f, g.f), 9)) AS score FROM n p, n g
WHERE g.id IN (SELECT gid FROM gal) AND p.id NOT IN (SELECT gid FROM gal) GROUP BY ALL),"""
RANK_TAIL = """ ranks AS (SELECT b.probe, b.y, 1 + count(*) FILTER (b.score > o.score) AS rank, arg_max(b.cls, (b.score, -b.cls)) AS top FROM best b
JOIN best o ON o.probe = b.probe AND o.cls = o.y GROUP BY b.probe, b.y),
pred AS (SELECT probe, y, rank, CASE WHEN rank = 1 THEN y ELSE top END AS pred FROM ranks)"""
RUNS = """runs AS (SELECT event_id, CAST(user_id % 7 AS VARCHAR) AS model, event_type AS task, event_id % 40 AS min_side, value,
CASE WHEN event_id % 19 = 0 THEN 'diverged' ELSE 'ok' END AS status FROM events)"""
DRAWS = """pos AS (SELECT vec_id AS id, label AS cls, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings),
draws AS (SELECT draw, CAST('0x' || substr(md5('21|a|' || draw), 1, 12) AS BIGINT) % (SELECT count(*) FROM pos) AS pa,
CAST('0x' || substr(md5('21|b|' || draw), 1, 12) AS BIGINT) % (SELECT count(*) FROM pos) AS pb FROM range({m}) t(draw)),
imp AS (SELECT draw, a.id AS id_a, b.id AS id_b FROM draws JOIN pos a ON a.pos = pa JOIN pos b ON b.pos = pb WHERE pa <> pb AND a.cls <> b.cls ORDER BY draw LIMIT {n})"""
EPISODE = """im AS (SELECT vec_id AS image_id, label AS subject, vec_id // 3 AS grp FROM embeddings),
d AS (SELECT *, md5('{seed}|{ep}|' || image_id) AS h FROM im),
d2 AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY subject, grp ORDER BY h, image_id) > 1 THEN 1 ELSE 0 END AS rep FROM d),
d3 AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY rep, h, image_id) AS pick FROM d2),
d4 AS (SELECT *, max(CASE WHEN pick <= {c} THEN 1 ELSE 0 END) OVER (PARTITION BY subject, grp) AS hit FROM d3)"""
LAYOUT = """lay AS (SELECT CAST(doc_id AS VARCHAR) AS image_id, source || '-' || lang AS subject, CASE WHEN doc_id % 7 = 0 AND lang <> 'en' THEN '' ELSE 'train' END AS orig_split,
CASE WHEN doc_id % 50 = 3 THEN 'empty_file' ELSE 'ok' END AS status, doc_id % 40 = 5 AS truncated FROM documents),
mix AS (SELECT subject FROM lay GROUP BY subject HAVING bool_or(orig_split <> '') AND bool_or(orig_split = ''))"""
BINS = "bins(ord, bin, lo, hi) AS (VALUES (0, '[0,8)', 0, 8), (1, '[8,16)', 8, 16), (2, '[16,32)', 16, 32), (3, '[32,48)', 32, 48), (4, '[48,64)', 48, 64))"
OLD_NEW = """o AS (SELECT o_orderkey AS key, o_orderstatus AS part, o_totalprice AS value FROM orders), old AS (SELECT * FROM o WHERE key % 3 <> 0),
new AS (SELECT key, part, value + 1 AS value, 'new' AS note FROM o WHERE key % 4 = 0)"""


def with_(*ctes: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(ctes) + " "


def _rule(how: str) -> str:
    same = """same AS (SELECT id AS id_a, id_b FROM (SELECT id, lead(id) OVER (PARTITION BY digest ORDER BY id) AS id_b FROM (SELECT id, md5(subject || '|' || id // 97) AS digest FROM v)) WHERE id_b IS NOT NULL)"""
    return with_(COS, HAM, same) + f"""SELECT coalesce(q.id_a, same.id_a) AS id_a, coalesce(q.id_b, same.id_b) AS id_b, CASE WHEN same.id_a IS NOT NULL THEN 0 ELSE q.dist END AS phash_dist,
round(q.cos, 6) AS cos, same.id_a IS NOT NULL AS identical_file FROM (SELECT coalesce(h.id_a, c.id_a) AS id_a, coalesce(h.id_b, c.id_b) AS id_b, h.dist, c.cos
FROM hamp h {how} JOIN cosp c ON h.id_a = c.id_a AND h.id_b = c.id_b) q FULL JOIN same ON q.id_a = same.id_a AND q.id_b = same.id_b"""


ORACLE: dict[str, str] = {
    "near_dup_cosine_pairs": with_(COS) + "SELECT id_a, id_b, round(cos, 6) AS cos FROM cosp",
    "near_dup_hamming_pairs": with_(HAM) + "SELECT * FROM hamp",
    "hamming_pairs_banded": """WITH h AS (SELECT o_orderkey AS id, CAST(trunc(o_totalprice * 100) AS BIGINT) AS h FROM orders)
SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 2""",
    "hamming_pairs_probed": """WITH h AS (SELECT o_orderkey AS id, xor(CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 16) AS UBIGINT), CAST(o_orderkey % 65536 AS UBIGINT) << (o_custkey % 48)::UBIGINT) AS h FROM orders)
SELECT a.id AS id_a, b.id AS id_b, CAST(bit_count(xor(a.h, b.h)) AS INTEGER) AS dist FROM h a JOIN h b ON a.id < b.id WHERE bit_count(xor(a.h, b.h)) <= 10""",
    "close_cosine_pairs": """WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
UNION ALL SELECT vec_id + 10000000, list_transform(embedding, lambda x, i: CAST(CAST(CAST(x AS DOUBLE) + CASE WHEN i % 5 = 1 THEN vec_id % 10 * 0.02 ELSE 0.0 END AS FLOAT) AS DOUBLE)) FROM embeddings),
n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS f FROM v)
SELECT a.id AS id_a, b.id AS id_b, round(list_dot_product(a.f, b.f), 6) AS cos FROM n a, n b WHERE a.id < b.id AND list_dot_product(a.f, b.f) >= 0.9""",
    "genuine_sample": """WITH m AS (SELECT vec_id AS id, label AS cls, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS place FROM embeddings),
r AS (SELECT cls, p, coalesce(sum(p) OVER (ORDER BY cls ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM (SELECT cls, count(*) * (count(*) - 1) // 2 AS p FROM m GROUP BY cls)),
d AS (SELECT draw, CAST('0x' || substr(md5('33|genuine|' || draw), 1, 15) AS BIGINT) % (SELECT sum(p) FROM r) AS number FROM range(4064) t(draw)),
u AS (SELECT number FROM (SELECT number, min(draw) AS draw FROM d GROUP BY number) ORDER BY draw LIMIT 1000),
k AS (SELECT cls, CAST(number - first AS BIGINT) AS k FROM u JOIN r ON number >= first AND number < first + p)
SELECT a.id AS id_a, b.id AS id_b FROM k JOIN m b USING (cls) JOIN m a USING (cls) WHERE b.place * (b.place - 1) // 2 <= k AND k < b.place * (b.place + 1) // 2 AND a.place = k - b.place * (b.place - 1) // 2""",
    "hamming_pairs_cross": with_(HAM.split(",\nhamp")[0]) + """SELECT x.id AS id_a, y.id AS id_b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) AS INTEGER) AS dist
FROM s x, s y WHERE x.id % 2 = 0 AND y.id % 2 = 1 AND list_sum(list_transform(list_zip(x.b, y.b), lambda p: abs(p[1] - p[2]))) <= 18""",
    "cross_cosine_pairs": with_(VEC) + "SELECT a.id AS id_a, b.id AS id_b, round(list_dot_product(a.f, b.f), 6) AS cos FROM n a, n b WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND list_dot_product(a.f, b.f) >= 0.4",
    "identical_file_chain": """SELECT id AS id_a, id_b FROM (SELECT doc_id AS id, lead(doc_id) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS id_b FROM documents WHERE text IS NOT NULL) WHERE id_b IS NOT NULL""",
    "pair_rule_or": _rule("FULL"), "pair_rule_and": _rule("INNER"), "pair_rule_phash": _rule("LEFT"), "pair_rule_dino": _rule("RIGHT"),
    "small_pairs_dropped": with_(HAM) + "SELECT h.* FROM hamp h JOIN part a ON a.p_partkey - 1 = id_a JOIN part b ON b.p_partkey - 1 = id_b WHERE least(a.p_size, b.p_size) >= 24",
    "duplicate_groups": with_(GROUPS, recursive=True) + "SELECT id, subject, grp FROM grouped",
    "group_stats": with_(GROUPS, recursive=True) + """SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_groups_gt1, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_in_groups_gt1,
max(n) AS largest_group FROM (SELECT grp, count(*) AS n FROM grouped GROUP BY grp)""",
    "oversized_groups": with_(GROUPS, recursive=True) + """SELECT a.subject, grp, a.n, b.n AS n_subject FROM (SELECT subject, grp, count(*) AS n FROM grouped GROUP BY ALL HAVING count(*) > 1) a
JOIN (SELECT subject, count(*) AS n FROM grouped GROUP BY subject) b ON a.subject = b.subject WHERE a.n > 0.04 * b.n""",
    "leakage_report": with_(GROUPS, ITEMS, recursive=True) + """, g AS (SELECT g.*, i.split, grp IN (SELECT grp FROM grouped JOIN items ON id = image_id WHERE split = 'train') AS hit FROM grouped g JOIN items i ON g.id = i.image_id)
SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND hit) AS n_test_with_train_duplicate,
round(coalesce(count(*) FILTER (split = 'test' AND hit) / nullif(count(*) FILTER (split = 'test'), 0)::DOUBLE, 0.0), 6) AS test_leakage_rate,
count(*) FILTER (split = 'val' AND hit) AS n_val_with_train_duplicate, count(DISTINCT CASE WHEN split = 'test' AND hit THEN subject END) AS subjects_affected FROM g""",
    "subject_overlap": with_(VEC) + """SELECT a.subject AS subject_a, b.subject AS subject_b, count(DISTINCT a.id) AS n_matched FROM n a, n b
WHERE a.id % 2 = 0 AND b.id % 2 = 1 AND list_dot_product(a.f, b.f) >= 0.3 GROUP BY ALL HAVING count(DISTINCT a.id) >= 3""",
    "outlier_scores": with_(OUT) + "SELECT id, subject, round(cos_to_centroid, 6) AS cos_to_centroid, round(z, 6) AS z FROM outl",
    "outlier_flagged": with_(OUT) + "SELECT id, subject, round(cos_to_centroid, 6) AS cos_to_centroid, round(z, 6) AS z FROM outl WHERE z < -2",
    "review_consolidation": with_(OUT, HAM) + """, fl AS (SELECT id, subject, 'outlier' AS reason, z, cos_to_centroid AS cos, '' AS other FROM outl WHERE z < -1.5
UNION ALL SELECT q.id, v.subject, 'cross_subject', NULL, NULL, CAST(o AS VARCHAR) FROM (SELECT id_a AS id, id_b AS o FROM hamp UNION ALL SELECT id_b, id_a FROM hamp) q JOIN v ON v.id = q.id)
SELECT id, min(subject) AS subject, array_to_string(list_sort(list(DISTINCT reason)), ';') AS reason, round(min(z), 6) AS z, round(min(cos), 6) AS cos,
coalesce(array_to_string(list_sort(list(DISTINCT other) FILTER (other <> '')), ';'), '') AS other, '' AS remove FROM fl GROUP BY id""",
    "review_applied": """WITH new AS (SELECT event_id AS id, event_type AS reason FROM events WHERE event_id % 3 = 0 OR event_id % 5 = 0)
SELECT * FROM new UNION ALL SELECT event_id, 'earlier' FROM events WHERE event_id % 6 = 0 AND event_id NOT IN (SELECT id FROM new)""",
    "borderline_pairs": with_(VEC) + """, p AS (SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.f, b.f) AS cos FROM n a JOIN n b ON a.subject = b.subject AND a.id < b.id WHERE list_dot_product(a.f, b.f) >= 0.25),
q AS (SELECT *, CASE WHEN cos >= 0.35 THEN 'accepted' ELSE 'rejected' END AS side FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(cos - 0.35), id_a, id_b) AS r FROM q),
t AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY md5('7|' || id_a || '|' || id_b), id_a, id_b) AS d FROM r WHERE r <= 30) SELECT side, id_a, id_b, round(cos, 6) AS cos FROM t WHERE d <= 10""",
    "value_counts": with_(ITEMS) + "SELECT gender, split, count(*) AS n FROM items GROUP BY ALL",
    "group_size_stats": """SELECT count(*) AS n_groups, min(n) AS min, round(quantile_cont(n, 0.5), 6) AS median, round(avg(n), 6) AS mean, max(n) AS max FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)""",
    "describe_quantiles": """SELECT round_even(min(x), 3) AS min, round_even(quantile_cont(x, 0.05), 3) AS p5, round_even(quantile_cont(x, 0.25), 3) AS p25, round_even(quantile_cont(x, 0.5), 3) AS median,
round_even(quantile_cont(x, 0.75), 3) AS p75, round_even(quantile_cont(x, 0.95), 3) AS p95, round_even(max(x), 3) AS max, round_even(avg(x), 3) AS mean FROM (SELECT l_extendedprice AS x FROM lineitem)""",
    "size_histogram": with_(BINS) + "SELECT ord, bin, count(p_partkey) AS n FROM bins LEFT JOIN part ON p_size >= lo AND p_size < hi GROUP BY ord, bin",
    "derived_columns": """WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 11 > 0 THEN CAST(p_size AS DOUBLE) END AS width, p_retailprice % 40 AS height FROM part)
SELECT p_partkey, round(width, 6) AS width, round(height, 6) AS height, round(least(width, height), 6) AS min_side, round(height / width, 6) AS aspect_hw, coalesce(least(width, height) < 8, false) AS tiny FROM p""",
    "mixed_layout": with_(LAYOUT) + "SELECT subject FROM mix",
    "scan_problems": with_(LAYOUT) + """SELECT image_id, status AS problem FROM lay WHERE status <> 'ok' UNION ALL SELECT image_id, 'truncated' FROM lay WHERE status = 'ok' AND truncated UNION ALL SELECT subject, 'mixed layout' FROM mix""",
    "dataset_stats": """WITH s AS (SELECT p_brand AS subject, CASE WHEN CAST(right(p_brand, 1) AS INTEGER) % 2 = 0 THEN 'M' ELSE 'F' END AS g, count(*) AS n FROM part GROUP BY ALL)
SELECT (SELECT count(*) FROM s) AS n_subjects, (SELECT count(*) FROM s WHERE g = 'M') AS subjects_m, (SELECT count(*) FROM s WHERE g = 'F') AS subjects_f, (SELECT count(*) FROM part) AS n_images,
CAST((SELECT sum(n) FROM s WHERE g = 'M') AS BIGINT) AS images_m, CAST((SELECT sum(n) FROM s WHERE g = 'F') AS BIGINT) AS images_f, (SELECT count(*) FROM part WHERE p_size < 8) AS tiny,
(SELECT min(n) FROM s) AS per_subject_min, (SELECT quantile_cont(n, 0.5) FROM s) AS per_subject_median, (SELECT round(avg(n), 6) FROM s) AS per_subject_mean, (SELECT max(n) FROM s) AS per_subject_max,
(SELECT round(quantile_cont(CAST(p_size AS DOUBLE), 0.5), 4) FROM part) AS side_median, (SELECT round_even(quantile_cont((p_size + 10.0) / p_size, 0.95), 4) FROM part) AS aspect_p95, (SELECT count(*) FROM part WHERE p_size < 8) AS smallest_bin""",
    "gender_from_labels": "SELECT s_name AS subject, CASE WHEN s_suppkey % 3 = 0 THEN 'F' ELSE 'M' END AS gender, 'labels_file' AS gender_source FROM supplier",
    "gender_from_order": "SELECT 's' || s_suppkey AS subject, CASE WHEN row_number() OVER (ORDER BY s_suppkey) <= 7 THEN 'M' ELSE 'F' END AS gender, 'folder_order' AS gender_source FROM supplier",
    "load_images": with_(LAYOUT) + """SELECT image_id, subject, CAST(length(subject) AS INTEGER) AS "order", CASE WHEN count(*) OVER (PARTITION BY subject) % 2 = 0 THEN 'F' ELSE 'M' END AS gender, orig_split,
'g' || (CAST(image_id AS BIGINT) - CAST(image_id AS BIGINT) % 2) AS "group" FROM lay QUALIFY status = 'ok' AND CAST(image_id AS BIGINT) % 9 <> 4""",
    "image_positions": "SELECT vec_id AS image_id, row_number() OVER (ORDER BY label * 3 % 7, vec_id) - 1 AS pos FROM embeddings",
    "anti_stale_check": """SELECT 'missing' AS problem, vec_id AS image_id FROM embeddings WHERE vec_id % 13 = 1 UNION ALL SELECT 'extra', 10000000 + x FROM range(3) t(x)
UNION ALL SELECT 'regrouped', vec_id FROM embeddings WHERE vec_id % 13 <> 1 AND vec_id % 17 = 2 AND vec_id <> 0""",
    "natural_sort": "SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'Sub' ELSE 'sub' END || s_suppkey || 'b' AS name, 'sub' || lpad(CAST(s_suppkey AS VARCHAR), 20, '0') || 'b' AS key FROM supplier",
    "label_encoding": "SELECT p_partkey, dense_rank() OVER (ORDER BY CAST(replace(p_brand, 'Brand#', '') AS INTEGER)) - 1 AS label FROM part",
    "first_seen_codes": "SELECT p_partkey, dense_rank() OVER (ORDER BY f) - 1 AS code FROM (SELECT p_partkey, min(p_partkey) OVER (PARTITION BY p_type) AS f FROM part)",
    "hash_hex_roundtrip": """WITH s AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END) AS b FROM embeddings)
SELECT id, lower(array_to_string(list_transform(range(16), lambda k: to_hex(CAST(b[64 - 4 * k] AS INTEGER) * 8 + CAST(b[63 - 4 * k] AS INTEGER) * 4 + CAST(b[62 - 4 * k] AS INTEGER) * 2 + CAST(b[61 - 4 * k] AS INTEGER))), '')) AS hex,
CAST(list_sum(list_transform(b, lambda x: CAST(x AS INTEGER))) AS INTEGER) AS bits FROM s""",
    "canvas_geometry": """WITH p AS (SELECT p_partkey, p_size + 10 AS w, p_partkey % 90 + 15 AS h FROM part), q AS (SELECT *, least(128.0::DOUBLE / w, 224.0::DOUBLE / h) AS sc FROM p),
r AS (SELECT *, CAST(greatest(1, least(128, round_even(w * sc, 0))) AS INTEGER) AS new_w, CAST(greatest(1, least(224, round_even(h * sc, 0))) AS INTEGER) AS new_h FROM q)
SELECT p_partkey, new_w, new_h, (128 - new_w) // 2 AS left_pad, (224 - new_h) // 2 AS top_pad, CAST(least(224, greatest(32, round_even(224.0::DOUBLE / (CAST(h AS DOUBLE) / w) / 32, 0) * 32)) AS INTEGER) AS width FROM r""",
    "learning_rates": """SELECT event_id, step, round(0.3 * CASE WHEN step < 5 THEN (step + 1) / 5.0 ELSE (1 + cos(pi() * (step - 5) / 55.0)) / 2 END, 6) AS cosine,
round(0.3 * CASE WHEN step < 5 THEN (step + 1) / 5.0 ELSE pow(0.1, (step - 5) // 30) END, 6) AS step_, round(0.3 * CASE WHEN step < 5 THEN (step + 1) / 5.0 ELSE 1.0 END, 6) AS constant FROM (SELECT event_id, event_id % 60 AS step FROM events)""",
    "fold_assign": with_(FOLDS) + "SELECT * FROM folds",
    "fold_roles": with_(FOLDS) + "SELECT subject, " + ", ".join(f"CASE WHEN fold = {k} THEN 'test' WHEN fold = {(k + 1) % 5} THEN 'val' ELSE 'train' END AS role{k}" for k in range(5)) + " FROM folds",
    "fold_pivot": with_(FOLDS) + "SELECT fold, count(*) FILTER (gender = 'M') AS M, count(*) FILTER (gender = 'F') AS F FROM folds GROUP BY fold",
    "novel_split": with_(SUBJECTS) + """SELECT subject, gender, CASE WHEN row_number() OVER (PARTITION BY gender ORDER BY md5('42|' || subject), subject)
<= greatest(1, least(count(*) OVER g - 1, round_even(count(*) OVER g * 0.3::DOUBLE, 0))) THEN 'novel' ELSE 'train' END AS role FROM subj WINDOW g AS (PARTITION BY gender)""",
    "episode_sample": with_(EPISODE.format(seed=11, ep=0, c=7)) + """SELECT image_id, subject, CASE WHEN pick <= 5 THEN 'support' WHEN pick <= 7 THEN 'val' ELSE 'test' END AS role FROM d4 WHERE pick <= 7 OR hit = 0""",
    "episode_counters": with_(EPISODE.format(seed=11, ep=0, c=7).replace("vec_id // 3", "vec_id // 40")) + """SELECT (SELECT count(*) FROM (SELECT subject FROM im GROUP BY subject HAVING count(DISTINCT grp) < 7)) AS subjects_without_distinct_groups,
(SELECT count(DISTINCT subject) FROM im WHERE subject NOT IN (SELECT subject FROM d4 WHERE pick > 7 AND hit = 0)) AS subjects_without_test""",
    "gallery_sample": with_(EPISODE.format(seed=5, ep=1, c=3)) + "SELECT image_id, subject, 'support' AS role FROM d4 WHERE pick <= 3",
    "gender_episode": with_(ITEMS) + """, one AS (SELECT image_id, CAST(subject AS VARCHAR) AS subject, gender FROM items QUALIFY row_number() OVER (PARTITION BY subject ORDER BY md5('3|4|' || image_id), image_id) = 1)
SELECT image_id, subject, gender FROM one QUALIFY row_number() OVER (PARTITION BY gender ORDER BY md5('3|4|' || subject), subject) <= 3""",
    "capped_sample": "SELECT c_custkey FROM customer ORDER BY md5('9|' || c_custkey), c_custkey LIMIT 100",
    "novel_frames": with_(ITEMS) + """, su AS (SELECT DISTINCT CAST(subject AS VARCHAR) AS subject, gender FROM items), ro AS (SELECT subject, row_number() OVER (PARTITION BY gender ORDER BY md5('42|' || subject), subject)
<= greatest(1, least(count(*) OVER (PARTITION BY gender) - 1, round_even(count(*) OVER (PARTITION BY gender) * 0.3::DOUBLE, 0))) AS novel FROM su)
SELECT image_id, ro.subject, CASE WHEN split = 'val' THEN 'val' ELSE 'train' END AS role FROM items JOIN ro ON ro.subject = CAST(items.subject AS VARCHAR) WHERE NOT novel""",
    "prototype_scores": with_(PROTO) + "SELECT probe, cls, round(score, 6) AS score FROM scores",
    "prototype_predictions": with_(PROTO) + "SELECT probe, pred FROM pred",
    "top5_predictions": with_(PROTO) + "SELECT probe, arg_min(cls, place) AS pred, string_agg(CAST(cls AS VARCHAR), ' ' ORDER BY place) AS top, round(max(score), 6) AS score FROM placed WHERE place <= 5 GROUP BY probe",
    "identity_metrics": with_(PROTO, PRF) + f""", own AS (SELECT y, place FROM placed WHERE cls = y) SELECT (SELECT round(100 * avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END), 6) FROM own) AS top1,
(SELECT round(100 * avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END), 6) FROM own) AS top5, (SELECT round(100 * avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END), 6) FROM own) AS top10,
(SELECT round(avg(s), 6) FROM (SELECT 100 * avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END) AS s FROM own GROUP BY y)) AS top1_subject_mean, {PRF_COLS} FROM prf""",
    "topk_accuracy": with_(PROTO) + "SELECT round(100 * avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END), 6) AS top5 FROM placed WHERE cls = y",
    "prf_per_class": with_(PROTO, PRF) + "SELECT cls, support, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1 FROM prf",
    "roc_auc": with_(BIN, AUC) + "SELECT round(auc, 6) AS auc FROM auc",
    "mcc": with_(BIN) + f"SELECT round({MCC}, 6) AS mcc FROM bc",
    "gender_metrics": with_(BIN, AUC) + f""", pn AS (SELECT *, tn / nullif(tn + fn, 0) AS p0, tn / (tn + fp) AS r0, 2 * tn / (2 * tn + fn + fp) AS f0, tp / nullif(tp + fp, 0) AS p1, tp / (tp + fn) AS r1, 2 * tp / (2 * tp + fp + fn) AS f1, tn + fp AS n0, tp + fn AS n1 FROM bc)
SELECT round(100 * (tp + tn) / (n0 + n1), 6) AS acc, round(50 * (r0 + r1), 6) AS bal_acc, round(100 * p0, 6) AS precision_male, round(100 * r0, 6) AS recall_male, round(100 * f0, 6) AS f1_male,
round(100 * p1, 6) AS precision_female, round(100 * r1, 6) AS recall_female, round(100 * f1, 6) AS f1_female, round(auc, 6) AS auc, round({MCC}, 6) AS mcc,
round(50 * (p0 + p1), 6) AS macro_precision, round(100 * (p0 * n0 + p1 * n1) / (n0 + n1), 6) AS weighted_precision, round(50 * (r0 + r1), 6) AS macro_recall, round(100 * (r0 * n0 + r1 * n1) / (n0 + n1), 6) AS weighted_recall,
round(50 * (f0 + f1), 6) AS macro_f1, round(100 * (f0 * n0 + f1 * n1) / (n0 + n1), 6) AS weighted_f1,
(SELECT round(100 * avg(CASE WHEN (v > 0.5 AND y = 1) OR (v < 0.5 AND y = 0) THEN 1.0 ELSE 0 END), 6) FROM (SELECT subject, min(y) AS y, avg(pred) AS v FROM binp GROUP BY subject)) AS acc_subject FROM pn, auc""",
    "majority_vote": with_(BIN) + "SELECT subject, min(y) AS y, CASE WHEN avg(pred) > 0.5 THEN 1 WHEN avg(pred) < 0.5 THEN 0 ELSE -1 END AS vote FROM binp GROUP BY subject",
    "contingency": with_(CLUSTERS) + "SELECT CAST(cluster AS INTEGER) AS cluster, y, n FROM cont",
    "cluster_agreement": with_(CLUSTERS) + """, a AS (SELECT cluster, CAST(sum(n) AS DOUBLE) AS a, max(n) AS m FROM cont GROUP BY cluster), b AS (SELECT y, CAST(sum(n) AS DOUBLE) AS b FROM cont GROUP BY y), t AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cont),
q AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM a, t) AS hc, (SELECT -sum(b / t * ln(b / t)) FROM b, t) AS hy, (SELECT sum(n / t * ln(n * t / (a * b))) FROM cont JOIN a USING (cluster) JOIN b USING (y), t) AS mi,
(SELECT sum(n * (n - 1) / 2.0) FROM cont) AS pn, (SELECT sum(a * (a - 1) / 2) FROM a) AS pc, (SELECT sum(b * (b - 1) / 2) FROM b) AS py, (SELECT sum(m) FROM a) AS best, t FROM t)
SELECT round(200 * (mi / hy) * (mi / hc) / (mi / hy + mi / hc), 6) AS nmi, round(100 * (pn - pc * py / (t * (t - 1) / 2)) / ((pc + py) / 2 - pc * py / (t * (t - 1) / 2)), 6) AS ari, round(100 * best / t, 6) AS purity,
round(100 * mi / hy, 6) AS homogeneity, round(100 * mi / hc, 6) AS completeness, round(200 * (mi / hy) * (mi / hc) / (mi / hy + mi / hc), 6) AS v_measure FROM q""",
    "identification_ranks": with_(RANKS + RANK_TAIL) + "SELECT * FROM pred",
    "identification_summary": with_(RANKS + RANK_TAIL, PRF) + f"""SELECT (SELECT round(100 * avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) FROM ranks) AS rank1, (SELECT round(100 * avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) FROM ranks) AS rank5,
(SELECT round(100 * avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 6) FROM ranks) AS rank10, (SELECT round(avg(c), 6) FROM (SELECT 100 * avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END) AS c FROM ranks, range(1, 11) t(k) GROUP BY k)) AS aucmc,
(SELECT round(100 * avg(1.0 / rank), 6) FROM ranks) AS mrr, (SELECT count(*) FROM ranks) AS n_probe, {PRF_COLS} FROM prf""",
    "cmc_curve": with_(RANKS + RANK_TAIL) + "SELECT k AS rank, round(100 * avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END), 6) AS cmc FROM ranks, range(1, 11) t(k) GROUP BY k",
    "mean_cmc": with_(RANKS + RANK_TAIL) + "SELECT k AS rank, round(avg(c), 6) AS cmc FROM (SELECT k, probe % 3, 100 * avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END) AS c FROM ranks, range(1, 11) t(k) GROUP BY ALL) GROUP BY k",
    "loo_identification": with_(VEC + """, m AS (SELECT *, count(*) OVER (PARTITION BY subject) AS c FROM n), best AS (SELECT p.id AS probe, p.subject AS y, g.subject AS cls, max(round(list_dot_product(p.f, g.f), 9)) AS score
FROM m p, m g WHERE p.id <> g.id AND p.c > 1 GROUP BY ALL),""" + RANK_TAIL, PRF) + f"""SELECT (SELECT round(100 * avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 6) FROM ranks) AS rank1, (SELECT round(100 * avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) FROM ranks) AS rank5,
(SELECT round(100 * avg((11 - rank) / 10.0), 6) FROM ranks) AS aucmc, (SELECT round(100 * avg(1.0 / rank), 6) FROM ranks) AS mrr, (SELECT count(*) FROM ranks) AS n_probe, {PRF_COLS} FROM prf""",
    "genuine_pairs": "SELECT a.vec_id AS id_a, b.vec_id AS id_b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id",
    "impostor_pairs": with_(DRAWS.format(m=1500, n=500)) + "SELECT draw, id_a, id_b FROM imp",
    "pair_scores": with_(VEC, DRAWS.format(m=600, n=200)) + "SELECT DISTINCT id_a, id_b, round(list_dot_product(a.f, b.f), 6) AS score FROM imp JOIN n a ON a.id = id_a JOIN n b ON b.id = id_b",
    "verification_eer_tar": with_(VEC) + """, p AS (SELECT a.subject = b.subject AS same, round(list_dot_product(a.f, b.f), 6) AS score FROM n a JOIN n b ON a.id < b.id),
d AS (SELECT score, count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM p GROUP BY score UNION ALL SELECT 'inf'::DOUBLE, 0, 0),
c AS (SELECT score, coalesce(sum(g) OVER w, 0) / (SELECT sum(g) FROM d)::DOUBLE AS frr, ((SELECT sum(i) FROM d) - coalesce(sum(i) OVER w, 0)) / (SELECT sum(i) FROM d)::DOUBLE AS far FROM d
WINDOW w AS (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT (SELECT round(100 * (frr + far) / 2, 6) FROM c ORDER BY abs(frr - far), score LIMIT 1) AS eer, round(100 * coalesce(max(1 - frr) FILTER (far <= 0.01), 0), 6) AS tar_at_far FROM c""",
    "summary_mean_std_ci": with_(RUNS) + """SELECT model, task, count(*) FILTER (status <> 'diverged') AS n_runs, count(*) FILTER (status = 'diverged') AS n_diverged, round(round(avg(value) FILTER (status <> 'diverged'), 4), 3) AS mean,
round(round(stddev_samp(value) FILTER (status <> 'diverged'), 4), 3) AS std, round(round(stddev_samp(value) FILTER (status <> 'diverged') / sqrt(count(*) FILTER (status <> 'diverged')) * (SELECT q FROM t95 WHERE df = count(*) FILTER (status <> 'diverged') - 1), 4), 3) AS ci95
FROM runs GROUP BY model, task""",
    "metric_column_names": "SELECT * FROM (VALUES ('min_side'), ('value')) t(metric)",
    "best_per_group": with_(RUNS) + "SELECT model, task, event_id FROM runs QUALIFY row_number() OVER (PARTITION BY model, task ORDER BY value DESC NULLS LAST, event_id) = 1",
    "top_models": with_(RUNS) + "SELECT model, round(avg(value), 6) AS mean FROM runs GROUP BY model ORDER BY avg(value) DESC, model LIMIT 5",
    "best_epochs": """WITH l AS (SELECT l_orderkey AS run, l_linenumber AS epoch, max(l_quantity) AS val FROM lineitem GROUP BY ALL),
b AS (SELECT *, max(val) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l),
c AS (SELECT *, max(CASE WHEN before IS NULL OR val > before + 1e-9 THEN epoch END) OVER (PARTITION BY run ORDER BY epoch) AS lb FROM b),
e AS (SELECT run, coalesce(min(epoch) FILTER (epoch - lb >= 2), max(epoch)) AS stop FROM c GROUP BY run) SELECT c.run, c.lb AS best_epoch, e.stop AS stop_epoch FROM c JOIN e ON c.run = e.run AND c.epoch = e.stop""",
    "result_pivot_table": with_(RUNS) + "SELECT model, " + ", ".join(f"round(avg(value) FILTER (task = '{k}'), 6) AS {k}" for k in ("click", "purchase", "signup", "view")) + " FROM runs GROUP BY model",
    "class_weights": "SELECT label AS cls, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 6) AS weight FROM embeddings GROUP BY label",
    "resolution_bins": with_(RUNS, BINS) + """SELECT m.model, ord, bin, count(r.event_id) AS n_images, round(100 * avg(CASE WHEN r.event_id IS NULL THEN NULL WHEN r.value > 50 THEN 1.0 ELSE 0.0 END), 6) AS top1
FROM (SELECT DISTINCT model FROM runs) m CROSS JOIN bins LEFT JOIN runs r ON r.model = m.model AND r.min_side >= lo AND r.min_side < hi GROUP BY m.model, ord, bin""",
    "run_health": with_(RUNS) + """SELECT DISTINCT 'a' AS store, model, 'diverged' AS problem FROM runs WHERE event_id % 2 = 0 AND status = 'diverged' UNION ALL SELECT DISTINCT 'b', model, 'fell back' FROM runs WHERE event_id % 2 = 1 AND event_id % 77 = 0
UNION ALL SELECT 'a', model, 'mixed gpu_name' FROM runs WHERE event_id % 2 = 0 GROUP BY model HAVING count(DISTINCT task = 'view') > 1""",
    "grid_filter": "SELECT l_discount, count(*) AS n FROM lineitem WHERE abs(l_discount - 0.01) <= 1e-12 OR abs(l_discount - 0.03) <= 1e-12 OR abs(l_discount - 0.07) <= 1e-12 GROUP BY l_discount",
    "store_upsert": with_(OLD_NEW) + "SELECT key, part, round(value, 6) AS value, NULL AS note FROM old WHERE (key, part) NOT IN (SELECT key, part FROM new) UNION ALL SELECT key, part, round(value, 6), note FROM new",
    "store_upsert_partial": with_(OLD_NEW) + "SELECT key, part, round(value, 6) AS value, NULL AS note FROM old WHERE (key, part) NOT IN (SELECT key, part FROM new) UNION ALL SELECT key, part, round(value, 6), note FROM new",
    "sql_functions": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
h AS (SELECT *, CAST(list_sum(list_transform(range(0, 64), lambda k: CASE WHEN e[k + 1] > 0 THEN (CASE WHEN k = 63 THEN -9223372036854775808 ELSE CAST(1 AS BIGINT) << k END) ELSE 0 END)) AS BIGINT) AS hash FROM v)
SELECT vec_id, round(list_dot_product(e, list_reverse(e)) / list_dot_product(e, e), 6) AS cos, hash, CAST(bit_count(xor(hash, vec_id)) AS INTEGER) AS dist,
CASE WHEN vec_id % 3 = 0 THEN '–' WHEN vec_id % 3 > 1 THEN printf('%.2f ± 0.50', vec_id / 4.0) ELSE printf('%.2f', vec_id / 4.0) END AS text FROM h""",
    "store_get": """SELECT part, CAST(1 AS BIGINT) AS batch, key, has_first, false AS has_other FROM (SELECT o_orderstatus AS part, max(o_orderkey) FILTER (o_orderkey % 3 = 1) AS key,
bool_or(o_orderkey % 3 = 0) AS has_first FROM orders GROUP BY o_orderstatus)""",
    "incremental_groups": with_(HAM, "sym AS (SELECT h.id_a AS a, h.id_b AS b FROM hamp h JOIN s x ON x.id = id_a JOIN s y ON y.id = id_b WHERE x.subject = y.subject)", recursive=True) + """, two AS (SELECT a, b FROM sym UNION SELECT b, a FROM sym),
reach(a, b) AS (SELECT id, id FROM s UNION SELECT r.a, t.b FROM reach r JOIN two t ON r.b = t.a)
SELECT s.id, s.subject, min(r.b) AS grp FROM s JOIN reach r ON r.a = s.id GROUP BY s.id, s.subject""",
    "store_remove": with_(OLD_NEW) + "SELECT key, part, round(value, 6) AS value FROM old WHERE part <> 'F'",
    "store_skip": with_(OLD_NEW) + """SELECT n.key, o.key IS NOT NULL AND coalesce(abs(o.value - (CASE WHEN n.key % 8 = 0 THEN n.value - 1 ELSE n.value END)) <= 1e-12 * greatest(1, abs(o.value), abs(n.value)), false) AS skip
FROM new n LEFT JOIN old o ON o.key = n.key AND o.part = n.part""",
    "fmt_plus_minus": with_(RUNS) + """SELECT model, CASE WHEN count(*) > 1 THEN format('{:.2f} ± {:.2f}', round(avg(value), 4), round(stddev_samp(value), 4)) ELSE format('{:.2f}', round(avg(value), 4)) END
|| CASE WHEN count(*) < 100 THEN ' (n=' || count(*) || '/100)' ELSE '' END AS text FROM runs GROUP BY model""",
    "yes_answers": "SELECT event_id, (event_id % 7) NOT IN (1, 4, 6) AS yes FROM events",
}
ORACLE["learning_rates"] = ORACLE["learning_rates"].replace("AS step_,", "AS step_size,")


def _t95() -> str:
    """The same quantiles for the SQL side: Student's t at 0.975 by the published table and its series."""
    from galleria.operators.metrics import T975

    z = 1.959963984540054
    g = ((z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    table = ", ".join(f"({k + 1}, {t})" for k, t in enumerate(T975))
    series = f"{z} + {g[0]} / df + {g[1]} / df ** 2 + {g[2]} / df ** 3 + {g[3]} / df ** 4"
    return f"t95(df, q) AS (SELECT * FROM (VALUES {table}) UNION ALL SELECT df, {series} FROM (SELECT CAST(x AS DOUBLE) AS df FROM range(31, 200000) r(x)))"


_summary = ORACLE["summary_mean_std_ci"].replace("* (SELECT q FROM t95 WHERE df = count(*) FILTER (status <> 'diverged') - 1)", "* any_value(q)")
ORACLE["summary_mean_std_ci"] = _summary.replace("FROM runs GROUP BY model, task", "FROM runs JOIN (SELECT model, task, count(*) FILTER (status <> 'diverged') - 1 AS df FROM runs GROUP BY ALL) k USING (model, task) LEFT JOIN t95 ON t95.df = k.df GROUP BY model, task").replace("WITH ", f"WITH {_t95()}, ", 1)


# Whole experiments: every draw in one statement, grouped by the columns of the run.


def _on(by: str, a: str, b: str) -> str:
    return " AND ".join(f"{a}.{c.strip()} = {b}.{c.strip()}" for c in by.split(","))


def _draw(tag: str, shots: str, n_val: int, draws: int, seed: int, where: str = "true") -> str:
    return f"""im AS (SELECT vec_id AS image_id, label AS subject, vec_id // 3 AS grp FROM embeddings WHERE {where}),
runs AS (SELECT CAST(shot AS INTEGER) AS shot, CAST(draw AS INTEGER) AS draw FROM (VALUES {shots}) s(shot), range({draws}) t(draw)),
d1 AS (SELECT *, md5('{seed}|{tag}|' || shot || '|' || draw || '|' || image_id) AS h FROM im, runs),
d2 AS (SELECT *, row_number() OVER (PARTITION BY shot, draw, subject, grp ORDER BY h, image_id) > 1 AS again FROM d1),
d3 AS (SELECT *, row_number() OVER (PARTITION BY shot, draw, subject ORDER BY again, h, image_id) AS pick FROM d2),
d4 AS (SELECT *, bool_or(pick <= shot + {n_val}) OVER (PARTITION BY shot, draw, subject, grp) AS hit FROM d3),
drawn AS (SELECT shot, draw, image_id, subject, CASE WHEN pick <= shot THEN 'support' WHEN pick <= shot + {n_val} THEN 'val' ELSE 'test' END AS role FROM d4 WHERE pick <= shot + {n_val} OR NOT hit)"""


def _centres(by: str, source: str) -> str:
    """cen: a class's mean of normalised vectors in each run, of rows (by, cls, f)."""
    return f"""cell AS (SELECT {by}, cls, unnest(f) AS x, generate_subscripts(f, 1) AS k FROM {source}), mean AS (SELECT {by}, cls, k, avg(x) AS m FROM cell GROUP BY ALL),
cen AS (SELECT {by}, cls, list(m ORDER BY k) AS c FROM mean GROUP BY {by}, cls)"""


def _prf(by: str) -> str:
    """prf over pred (by, y, pred)."""
    return f"""cnt AS (SELECT {by}, cls, count(*) FILTER (y = cls AND pred = cls) AS tp, count(*) FILTER (y <> cls AND pred = cls) AS fp, count(*) FILTER (y = cls AND pred <> cls) AS fn
FROM pred JOIN (SELECT DISTINCT {by}, y AS cls FROM pred) USING ({by}) GROUP BY ALL),
prf AS (SELECT {by}, tp + fn AS support, CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) ELSE 0 END AS r,
CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0 END AS f FROM cnt)"""


def _ranks(by: str) -> str:
    """ranks and pred over best (by, probe, y, cls, score)."""
    b = ", ".join(f"b.{c.strip()}" for c in by.split(","))
    return f"""ranks AS (SELECT {b}, b.probe, b.y, 1 + count(*) FILTER (b.score > o.score) AS rank, arg_max(b.cls, (b.score, -b.cls)) AS top FROM best b
JOIN best o ON {_on(by, "o", "b")} AND o.probe = b.probe AND o.cls = o.y GROUP BY {b}, b.probe, b.y), pred AS (SELECT {by}, probe, y, rank, CASE WHEN rank = 1 THEN y ELSE top END AS pred FROM ranks)"""


def _rank_rows(by: str, n: str, at: tuple[int, ...] = (1, 5, 10)) -> str:
    cols = ", ".join(f"round(100 * avg(CASE WHEN rank <= {k} THEN 1.0 ELSE 0 END), 6) AS rank{k}" for k in at)
    return f"""SELECT * FROM (SELECT {by}, {cols}, round(100 * avg(({n} - rank + 1) / CAST({n} AS DOUBLE)), 6) AS aucmc, round(100 * avg(1.0 / rank), 6) AS mrr, count(*) AS n_probe FROM ranks GROUP BY {by})
JOIN (SELECT {by}, {PRF_COLS} FROM prf GROUP BY {by}) USING ({by})"""


BOTH = "vv AS (SELECT 'frozen' AS variant, id, subject, f FROM n UNION ALL SELECT 'finetuned', id, subject, list_transform(e[1:32], lambda x: x / sqrt(list_dot_product(e[1:32], e[1:32]))) FROM v)"
PEOPLE = "subj AS (SELECT DISTINCT label AS subject, CASE WHEN label % 2 = 1 THEN 'F' ELSE 'M' END AS gender FROM embeddings)"
PEOPLE_FOLDS = FOLDS.replace(SUBJECTS, PEOPLE)
NOVEL = PEOPLE + """, ro AS (SELECT subject FROM subj QUALIFY row_number() OVER (PARTITION BY gender ORDER BY md5('42|' || subject), subject)
<= greatest(1, least(count(*) OVER (PARTITION BY gender) - 1, round_even(count(*) OVER (PARTITION BY gender) * 0.3::DOUBLE, 0))))"""
RUN = "shot, draw"
_GALLERY = with_(VEC, _draw("gallery", "(1)", 0, 3, 11)) + f""", best AS (SELECT p.shot, p.draw, p.image_id AS probe, p.subject AS y, g.subject AS cls, max(round(list_dot_product(a.f, b.f), 9)) AS score
FROM drawn p JOIN drawn g ON p.shot = g.shot AND p.draw = g.draw AND p.role = 'test' AND g.role = 'support' JOIN n a ON a.id = p.image_id JOIN n b ON b.id = g.image_id GROUP BY ALL), {_ranks(RUN)}, {_prf(RUN)} """
_RESULTS = """m(k) AS (SELECT * FROM range(8)), models AS (SELECT CAST(k AS INTEGER) AS ord, CAST(k AS VARCHAR) AS key, 'Model ' || k AS name, 'F' || (k % 3) AS family, k % 2 = 0 AS basic, k % 4 = 1 AS square FROM m),
res AS (SELECT CAST(user_id % 7 AS VARCHAR) AS model, [1, 5, 10][event_id % 3 + 1] AS shot, ['S1', 'S2'][event_id % 2 + 1] AS split, ['stretch', 'letterbox', 'nonsquare'][event_id % 3 + 1] AS mode, event_id % 2 AS rate, 'F' || (user_id % 4) AS family, value FROM events)"""


def _text(v: str, spread: str = "stddev_samp({v})", more: str = "''") -> str:
    s = spread.format(v=v)
    return f"CASE WHEN count({v}) = 0 THEN '–' WHEN count({v}) = 1 THEN format('{{:.2f}}', avg({v})) || {more} ELSE format('{{:.2f}} ± {{:.2f}}', avg({v}), {s}) || {more} END"


def _shot_texts() -> str:
    q = "s AS (SELECT model, shot, count(value) AS c, avg(value) AS a, stddev_samp(value) AS sd FROM res GROUP BY ALL), t AS (SELECT s.model, s.shot, CASE WHEN c = 1 THEN format('{:.2f}', a) ELSE format('{:.2f} ± {:.2f}', a, q * sd / sqrt(c)) END AS x FROM s LEFT JOIN t95 ON df = c - 1 WHERE c > 0)"
    cols = ", ".join(f"coalesce(max(x) FILTER (shot = {k}), '–') AS shot{k}" for k in (1, 5, 10))
    return with_(_t95(), _RESULTS, q) + f"SELECT ord, models.family, name, {cols} FROM models LEFT JOIN t ON t.model = models.key GROUP BY ord, models.family, name"


ORACLE |= {
    "store_replace": with_(OLD_NEW) + "SELECT key, part, round(value, 6) AS value, NULL AS note FROM old WHERE part <> 'O' UNION ALL SELECT key, part, round(value, 6), note FROM new WHERE part = 'O'",
    "fewshot_identity": with_(VEC, _draw("identity", "(1), (5)", 2, 2, 11), "sup AS (SELECT shot, draw, drawn.subject AS cls, f FROM drawn JOIN n ON n.id = image_id WHERE role = 'support')", _centres(RUN, "sup")) + f""",
scores AS (SELECT d.shot, d.draw, d.image_id AS probe, d.subject AS y, cls, round(list_dot_product(f, c) / sqrt(list_dot_product(c, c)), 9) AS score FROM drawn d JOIN n ON n.id = d.image_id JOIN cen ON {_on(RUN, "cen", "d")} WHERE role = 'test'),
placed AS (SELECT *, row_number() OVER (PARTITION BY shot, draw, probe ORDER BY score DESC, cls) AS place FROM scores), pred AS (SELECT shot, draw, probe, y, cls AS pred FROM placed WHERE place = 1), {_prf(RUN)},
own AS (SELECT * FROM placed WHERE cls = y) SELECT * FROM (SELECT shot, draw, round(100 * avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END), 6) AS top1, round(100 * avg(CASE WHEN place <= 5 THEN 1.0 ELSE 0 END), 6) AS top5,
round(100 * avg(CASE WHEN place <= 10 THEN 1.0 ELSE 0 END), 6) AS top10 FROM own GROUP BY ALL) JOIN (SELECT shot, draw, round(avg(s), 6) AS top1_subject_mean FROM (SELECT shot, draw, y, 100 * avg(CASE WHEN place <= 1 THEN 1.0 ELSE 0 END) AS s
FROM own GROUP BY ALL) GROUP BY shot, draw) USING (shot, draw) JOIN (SELECT shot, draw, {PRF_COLS} FROM prf GROUP BY shot, draw) USING (shot, draw)""",
    "single_gallery": _GALLERY + f"SELECT * EXCLUDE (shot) FROM ({_rank_rows(RUN, '(SELECT count(DISTINCT subject) FROM im)')})",
    "single_gallery_cmc": _GALLERY + """SELECT k AS rank, round(avg(c), 6) AS cmc FROM (SELECT k, draw, 100 * avg(CASE WHEN rank <= k THEN 1.0 ELSE 0 END) AS c FROM ranks, range(1, (SELECT count(DISTINCT subject) FROM im) + 1) t(k) GROUP BY ALL) GROUP BY k""",
    "fewshot_gender": with_(VEC, PEOPLE_FOLDS) + f""", runs AS (SELECT CAST(shot AS INTEGER) AS shot, CAST(draw AS INTEGER) AS draw FROM (VALUES (1), (3)) s(shot), range(2) t(draw)),
placed AS (SELECT CAST(k AS INTEGER) AS fold, CASE WHEN folds.fold = k THEN 'test' WHEN folds.fold = (k + 1) % 5 THEN 'val' ELSE 'train' END AS role, n.id AS image_id, n.subject, n.subject % 2 AS g, f FROM n JOIN folds ON folds.subject = n.subject, range(5) t(k)),
dr AS (SELECT p.*, shot, draw, md5('42|gender|' || fold || '|' || shot || '|' || draw || '|' || image_id) AS h, md5('42|gender|' || fold || '|' || shot || '|' || draw || '|' || subject) AS s FROM placed p, runs WHERE role = 'train'),
one AS (SELECT * FROM dr QUALIFY row_number() OVER (PARTITION BY fold, shot, draw, subject ORDER BY h, image_id) = 1),
sup AS (SELECT fold, shot, draw, g AS cls, f FROM one QUALIFY row_number() OVER (PARTITION BY fold, shot, draw, g ORDER BY s, subject) <= shot), {_centres("fold, shot, draw", "sup")},
bin AS (SELECT fold, shot, draw, image_id, subject, g AS y, round((sum(CASE WHEN cls = 1 THEN 1 ELSE -1 END * list_dot_product(f, c) / sqrt(list_dot_product(c, c))) + 1) / 2, 9) AS p FROM placed JOIN cen USING (fold) WHERE role = 'test' GROUP BY ALL),
rk AS (SELECT *, rank() OVER (PARTITION BY fold, shot, draw ORDER BY p) + (count(*) OVER (PARTITION BY fold, shot, draw, p) - 1) / 2.0 AS r, CASE WHEN p >= 0.5 THEN 1 ELSE 0 END AS pred FROM bin),
b AS (SELECT fold, shot, draw, CAST(count(*) FILTER (y = 1 AND pred = 1) AS DOUBLE) AS tp, CAST(count(*) FILTER (y = 0 AND pred = 1) AS DOUBLE) AS fp, CAST(count(*) FILTER (y = 1 AND pred = 0) AS DOUBLE) AS fn,
CAST(count(*) FILTER (y = 0 AND pred = 0) AS DOUBLE) AS tn, sum(r) FILTER (y = 1) AS s1, count(*) FILTER (y = 1) AS n1, count(*) FILTER (y = 0) AS n0 FROM rk GROUP BY ALL),
vote AS (SELECT fold, shot, draw, round(100 * avg(CASE WHEN (a > 0.5 AND y = 1) OR (a < 0.5 AND y = 0) THEN 1.0 ELSE 0 END), 6) AS acc_subject FROM (SELECT fold, shot, draw, subject, y, avg(pred) AS a FROM rk GROUP BY ALL) GROUP BY fold, shot, draw)
SELECT fold, shot, draw, round(100 * (tp + tn) / (n0 + n1), 6) AS acc, round(50 * (tp / n1 + tn / n0), 6) AS bal_acc, round(100.0 * (s1 - n1 * (n1 + 1) / 2.0) / (n1 * n0), 6) AS auc,
round(coalesce({MCC.replace("sqrt(", "nullif(sqrt(")}, 0), 0), 6) AS mcc, acc_subject, round(50 * (2 * tp / (2 * tp + fp + fn) + 2 * tn / (2 * tn + fn + fp)), 6) AS macro_f1 FROM b JOIN vote USING (fold, shot, draw)""",
    "new_identity": with_(VEC, BOTH, NOVEL, _draw("new", "(1), (3)", 0, 2, 11, "label IN (SELECT subject FROM ro)")) + f""", best AS (SELECT a.variant, p.shot, p.draw, p.image_id AS probe, p.subject AS y, g.subject AS cls,
max(round(list_dot_product(a.f, b.f), 9)) AS score FROM drawn p JOIN drawn g ON p.shot = g.shot AND p.draw = g.draw AND p.role = 'test' AND g.role = 'support' JOIN vv a ON a.id = p.image_id JOIN vv b ON b.id = g.image_id AND a.variant = b.variant GROUP BY ALL),
{_ranks("variant, shot, draw")}, {_prf("variant, shot, draw")} {_rank_rows("variant, shot, draw", "(SELECT count(*) FROM ro)")}""",
    "new_identity_verification": with_(VEC, BOTH, NOVEL, DRAWS.format(m=900, n=300).replace("AS pos FROM embeddings)", "AS pos FROM embeddings WHERE label IN (SELECT subject FROM ro))")) + """,
pr AS (SELECT a.vec_id AS id_a, b.vec_id AS id_b, true AS same FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id WHERE a.label IN (SELECT subject FROM ro) AND a.vec_id // 3 <> b.vec_id // 3 UNION ALL SELECT id_a, id_b, false FROM imp),
p AS (SELECT a.variant, same, round(list_dot_product(a.f, b.f), 6) AS score FROM pr JOIN vv a ON a.id = id_a JOIN vv b ON b.id = id_b AND a.variant = b.variant),
d AS (SELECT variant, score, count(*) FILTER (same) AS g, count(*) FILTER (NOT same) AS i FROM p GROUP BY ALL UNION ALL SELECT DISTINCT variant, 'inf'::DOUBLE, 0, 0 FROM p),
c AS (SELECT variant, score, coalesce(sum(g) OVER w, 0) / CAST(sum(g) OVER a AS DOUBLE) AS frr, (sum(i) OVER a - coalesce(sum(i) OVER w, 0)) / CAST(sum(i) OVER a AS DOUBLE) AS far, CAST(sum(g) OVER a AS BIGINT) AS n_genuine, CAST(sum(i) OVER a AS BIGINT) AS n_impostor FROM d
WINDOW w AS (PARTITION BY variant ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY variant))
SELECT variant, round(100 * arg_min((frr + far) / 2, (abs(frr - far), score)), 6) AS eer, round(100 * coalesce(max(1 - frr) FILTER (far <= 0.01), 0), 6) AS tar_at_far, max(n_genuine) AS n_genuine, max(n_impostor) AS n_impostor FROM c GROUP BY variant""",
    "cross_dataset": with_(VEC, BOTH) + f""", best AS (SELECT p.variant, p.id AS probe, p.subject AS y, g.subject AS cls, max(round(list_dot_product(p.f, g.f), 9)) AS score FROM vv p JOIN vv g ON p.variant = g.variant AND p.id <> g.id
WHERE p.subject <> 3 AND g.subject <> 3 GROUP BY ALL), {_ranks("variant")}, {_prf("variant")} {_rank_rows("variant", "(SELECT count(DISTINCT label) FROM embeddings WHERE label <> 3)", (1, 5))}""",
    "overlap_union": with_(VEC, HAM) + """, n2 AS (SELECT n.*, s.b FROM n JOIN s USING (id)) SELECT a.subject AS subject_a, c.subject AS subject_b, count(DISTINCT a.id) AS n_matched FROM n2 a, n2 c WHERE a.id % 2 = 0 AND c.id % 2 = 1
AND (list_dot_product(a.f, c.f) >= 0.3 OR list_sum(list_transform(list_zip(a.b, c.b), lambda p: abs(p[1] - p[2]))) <= 18) GROUP BY ALL HAVING count(DISTINCT a.id) >= 3""",
    "duplicate_search": with_(COS, HAM, """pr AS (SELECT id_a, id_b FROM cosp UNION SELECT id_a, id_b FROM hamp JOIN part a ON a.p_partkey - 1 = id_a JOIN part b ON b.p_partkey - 1 = id_b WHERE least(a.p_size, b.p_size) >= 24
UNION SELECT id, id_b FROM (SELECT id, lead(id) OVER (PARTITION BY md5(subject || '|' || id // 97) ORDER BY id) AS id_b FROM v) WHERE id_b IS NOT NULL)""", """inside AS (SELECT id_a, id_b FROM pr JOIN v a ON a.id = id_a JOIN v b ON b.id = id_b WHERE a.subject = b.subject)""",
"sym AS (SELECT id_a AS a, id_b AS b FROM inside UNION SELECT id_b, id_a FROM inside)", "reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, sym.b FROM reach r JOIN sym ON r.b = sym.a)", "g AS (SELECT a, min(b) AS grp FROM reach GROUP BY a)", recursive=True) + """SELECT count(*) AS n_groups,
count(*) FILTER (n > 1) AS n_groups_gt1, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_in_groups_gt1, max(n) AS largest_group FROM (SELECT grp, count(*) AS n FROM g GROUP BY grp)""",
    "search_report": with_(COS, HAM, ITEMS, """pr AS (SELECT id_a, id_b FROM cosp UNION SELECT id_a, id_b FROM hamp JOIN part a ON a.p_partkey - 1 = id_a JOIN part b ON b.p_partkey - 1 = id_b WHERE least(a.p_size, b.p_size) >= 24
UNION SELECT id, id_b FROM (SELECT id, lead(id) OVER (PARTITION BY md5(subject || '|' || id // 97) ORDER BY id) AS id_b FROM v) WHERE id_b IS NOT NULL)""", """inside AS (SELECT id_a, id_b FROM pr JOIN v a ON a.id = id_a JOIN v b ON b.id = id_b WHERE a.subject = b.subject)""",
"sym AS (SELECT id_a AS a, id_b AS b FROM inside UNION SELECT id_b, id_a FROM inside)", "reach(a, b) AS (SELECT id, id FROM v UNION SELECT r.a, sym.b FROM reach r JOIN sym ON r.b = sym.a)", "g AS (SELECT a AS id, min(b) AS grp FROM reach GROUP BY a)",
"gs AS (SELECT g.*, i.subject, i.split, grp IN (SELECT grp FROM g JOIN items ON id = image_id WHERE split = 'train') AS hit FROM g JOIN items i ON g.id = i.image_id)",
"st AS (SELECT count(*) AS n_groups, count(*) FILTER (n > 1) AS n_groups_gt1, CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS n_in_groups_gt1, max(n) AS largest_group FROM (SELECT grp, count(*) AS n FROM g GROUP BY grp))",
"ov AS (SELECT count(*) AS n_oversized FROM (SELECT subject, count(*) AS n FROM gs GROUP BY subject, grp HAVING count(*) > 1) a JOIN (SELECT subject, count(*) AS m FROM gs GROUP BY subject) b USING (subject) WHERE n > 0.04 * m)", recursive=True) + """SELECT st.*, lk.*, ov.* FROM st, ov,
(SELECT count(*) FILTER (split = 'test') AS n_test, count(*) FILTER (split = 'test' AND hit) AS n_test_with_train_duplicate, round(coalesce(count(*) FILTER (split = 'test' AND hit) / nullif(count(*) FILTER (split = 'test'), 0)::DOUBLE, 0.0), 6) AS test_leakage_rate,
count(*) FILTER (split = 'val' AND hit) AS n_val_with_train_duplicate, count(DISTINCT CASE WHEN split = 'test' AND hit THEN subject END) AS subjects_affected FROM gs) lk""",
    "search_borderline": with_(VEC, HAM.replace("<= 18", "<= 20")) + """, p AS (SELECT 'hash' AS kind, CASE WHEN dist <= 18 THEN 'accepted' ELSE 'rejected' END AS side, id_a, id_b, CAST(dist AS DOUBLE) AS value, abs(dist - 18) AS gap
FROM hamp JOIN part a ON a.p_partkey - 1 = id_a JOIN part b ON b.p_partkey - 1 = id_b WHERE least(a.p_size, b.p_size) >= 24
UNION ALL SELECT 'cosine', CASE WHEN c >= 0.35 THEN 'accepted' ELSE 'rejected' END, id_a, id_b, c, abs(c - 0.35) FROM (SELECT a.id AS id_a, b.id AS id_b, list_dot_product(a.f, b.f) AS c FROM n a JOIN n b ON a.subject = b.subject AND a.id < b.id) WHERE c >= 0.35 - 0.1),
r AS (SELECT *, row_number() OVER (PARTITION BY kind, side ORDER BY gap, id_a, id_b) AS r FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY kind, side ORDER BY md5('7|' || id_a || '|' || id_b), id_a, id_b) AS d FROM r WHERE r <= 30) SELECT kind, side, id_a, id_b, round(value, 6) AS value FROM t WHERE d <= 10""",
    "split_frames": with_(ITEMS) + "SELECT image_id, split, dense_rank() OVER (ORDER BY subject) - 1 AS label FROM items WHERE image_id % 23 <> 4",
    "fold_frames": with_(ITEMS, PEOPLE_FOLDS) + "SELECT image_id, CASE WHEN fold = 2 THEN 'test' WHEN fold = 3 THEN 'val' ELSE 'train' END AS role, CAST(items.gender = 'F' AS INTEGER) AS label FROM items JOIN folds USING (subject)",
    "table_supervised": with_(_RESULTS) + f"SELECT ord, models.family, name, {_text('value', more=chr(39) + ' (n=' + chr(39) + ' || count(value) || ' + chr(39) + '/100000)' + chr(39))} AS top1, '–' AS absent FROM models LEFT JOIN res ON model = key GROUP BY ord, models.family, name",
    "table_fewshot": _shot_texts(),
    "table_gap": with_(_RESULTS) + """SELECT ord, CASE WHEN d IS NULL THEN '–' ELSE format('{:+.2f}', d) END AS gap FROM models LEFT JOIN (SELECT model, avg(value) FILTER (split = 'S1') - avg(value) FILTER (split = 'S2') AS d FROM res GROUP BY model) ON model = key""",
    "table_rates": with_(_RESULTS) + f"""SELECT min(ord) AS ord, models.family, CASE WHEN models.family = 'F1' THEN '0.003 (fixed)' ELSE coalesce(any_value(best), '–') END AS chosen, coalesce(any_value(t), '– / – / –') AS values
FROM models LEFT JOIN (SELECT family, concat_ws(' / ', {_text("CASE WHEN rate = 0 THEN value END")}, {_text("CASE WHEN rate = 1 THEN value END")}, '–') AS t, CASE WHEN arg_min(rate, (-value, -rate)) = 0 THEN '0.1' ELSE '0.01' END AS best FROM res GROUP BY family) q ON q.family = models.family GROUP BY models.family""",
    "table_preprocessing": with_(_RESULTS) + "SELECT ord, name, " + ", ".join((f"CASE WHEN square THEN '(not applicable)' ELSE {_text(v)} END" if k == "nonsquare" else _text(v)) + f" AS {k}" for k in ("stretch", "letterbox", "nonsquare") for v in [f"CASE WHEN mode = '{k}' THEN value END"]) + " FROM models JOIN res ON model = key GROUP BY ord, name, square",
}
