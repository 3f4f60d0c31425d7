"""DuckDB SQL of the registered queries, over the base tables.  Shared views are put in front as needed."""

from __future__ import annotations

import re

VIEWS = {
    "inst": """SELECT vec_id AS instance_id, CASE WHEN vec_id % 2 = 0 THEN 'LINCS' ELSE 'scPerturb' END AS dataset,
        CASE WHEN (vec_id // 2) % 2 = 0 THEN 'chemical' ELSE 'genetic' END AS perturbation_type, CASE WHEN (vec_id // 4) % 3 = 0 THEN 'A549' ELSE 'K562' END AS cell_line,
        CASE WHEN (vec_id // 2) % 2 = 1 OR (vec_id // 12) % 2 = 0 THEN 'G' || label WHEN label = 9 THEN 'G0|G9' ELSE 'G' || label || '|G' || (label + 1) END AS perturbation_gene,
        embedding FROM embeddings""",
    "x": "SELECT instance_id, CAST(unnest(range(len(embedding))) AS INT) AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM inst",
    "long": """SELECT instance_id, 'Gene' AS representation, dim, v FROM x
        UNION ALL SELECT instance_id, 'Pathway', dim // 8, avg(v) FROM x GROUP BY instance_id, dim // 8""",
    "member": """SELECT instance_id, dataset, cell_line, perturbation_type, perturbation_gene, unnest(string_split(perturbation_gene, '|')) AS anchor_gene FROM inst""",
    "cover": """SELECT dataset, cell_line, anchor_gene, count(*) FILTER (WHERE perturbation_type = 'chemical') AS n_chem_instances,
        count(*) FILTER (WHERE perturbation_type = 'genetic') AS n_gen_instances FROM member GROUP BY ALL""",
    "law": "SELECT dataset, cell_line, anchor_gene FROM cover WHERE n_chem_instances > 0 AND n_gen_instances > 0",
    "split": """SELECT instance_id, dataset, cell_line, perturbation_type, perturbation_gene,
        row_number() OVER (PARTITION BY dataset, cell_line, perturbation_type, perturbation_gene ORDER BY md5('619|' || instance_id), instance_id) AS rn FROM inst""",
    "matched": """SELECT cell_line, perturbation_type, perturbation_gene, count(*) FILTER (WHERE dataset = 'LINCS') AS n_lincs, count(*) FILTER (WHERE dataset = 'scPerturb') AS n_scperturb,
        min(instance_id) FILTER (WHERE dataset = 'LINCS') AS global_idx_lincs, min(instance_id) FILTER (WHERE dataset = 'scPerturb') AS sc_delta_row_idx
        FROM inst GROUP BY ALL HAVING n_lincs > 0 AND n_scperturb > 0""",
    # both sides of every comparison, in long form; u is the unit's key
    "two_sides": """SELECT to_json([dataset, cell_line, anchor_gene]) AS u, 't2' AS kind, CASE WHEN perturbation_type = 'chemical' THEN 'A' ELSE 'B' END AS s, instance_id FROM member
        UNION ALL SELECT to_json([dataset, cell_line, perturbation_type, perturbation_gene]), 't1', CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END, instance_id FROM split
        UNION ALL SELECT to_json([cell_line, perturbation_type, perturbation_gene]), 'cross', CASE WHEN dataset = 'LINCS' THEN 'A' ELSE 'B' END, instance_id FROM inst""",
    "by_dim": "SELECT u, kind, s, representation, dim, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS var FROM two_sides JOIN long USING (instance_id) GROUP BY ALL",
    "pair_dim": """SELECT a.u, a.kind, a.representation, a.dim, a.n AS n_a, b.n AS n_b, a.m AS x, b.m AS y, a.var AS vx, b.var AS vy
        FROM (SELECT * FROM by_dim WHERE s = 'A') a JOIN (SELECT * FROM by_dim WHERE s = 'B') b USING (u, kind, representation, dim)""",
    "met": """SELECT u, kind, representation, CAST(any_value(n_a) AS BIGINT) AS n_a, CAST(any_value(n_b) AS BIGINT) AS n_b, least(any_value(n_a), any_value(n_b)) < 2 AS under,
        (sum(x * y) / nullif(sqrt(sum(x * x) * sum(y * y)), 0)) AS cosine_centroid, (covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)) AS pcc_centroid,
        CASE WHEN least(any_value(n_a), any_value(n_b)) >= 2 THEN (2 * sum((x - y) * (x - y)) - 2 * sum(vx) / any_value(n_a) - 2 * sum(vy) / any_value(n_b)) END AS e_distance
        FROM pair_dim GROUP BY u, kind, representation""",
    "met_long": "SELECT u, kind, representation, n_a, n_b, under, metric_name, metric_value FROM met UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (cosine_centroid, pcc_centroid, e_distance))",
    "t2w": "SELECT u->>0 AS dataset, u->>1 AS cell_line, u->>2 AS anchor_gene, * EXCLUDE (u, kind) FROM met WHERE kind = 't2'",
    "t2l": """SELECT u->>0 AS dataset, u->>1 AS cell_line, u->>2 AS anchor_gene, representation, n_a AS n_chem_instances_used, n_b AS n_gen_instances_used, n_a AS n_chem_sub, n_b AS n_gen_sub,
        under AS underpowered_for_e_distance, metric_name, metric_value FROM met_long WHERE kind = 't2'""",
    "t1i": """SELECT 'internal' AS scope, u->>0 AS dataset_or_direction, u->>1 AS cell_line, u->>2 AS perturbation_type, u->>3 AS perturbation_gene, representation, n_a, n_b, under, metric_name, metric_value
        FROM met_long WHERE kind = 't1'""",
    "t1c": """SELECT 'cross' AS scope, 'LINCS_to_scPerturb' AS dataset_or_direction, u->>0 AS cell_line, u->>1 AS perturbation_type, u->>2 AS perturbation_gene, representation, n_a, n_b, under, metric_name, metric_value
        FROM met_long WHERE kind = 'cross'""",
    "t1l": """SELECT scope, dataset_or_direction, cell_line, perturbation_type, perturbation_gene, representation, n_a AS n_instances_split_a, n_b AS n_instances_split_b, n_a + n_b AS n_instances_used,
        n_a + n_b AS n_instances_subsampled, under AS underpowered_for_e_distance, metric_name, metric_value FROM (SELECT * FROM t1i UNION ALL SELECT * FROM t1c)""",
    "t2_board": "SELECT dataset, cell_line, representation, avg(cosine_centroid) AS mean_cosine_centroid, avg(pcc_centroid) AS mean_pcc_centroid, avg(e_distance) AS mean_e_distance FROM t2w GROUP BY ALL",
    # retrieval: queries and galleries of all pipelines in one; slice is where they meet
    "ask": """SELECT 't1' AS p, to_json([dataset, perturbation_type, cell_line]) AS slice, instance_id, [perturbation_gene] AS own FROM inst
        UNION ALL SELECT 'cross', to_json([perturbation_type, cell_line]), instance_id, [perturbation_gene] FROM inst JOIN matched USING (cell_line, perturbation_type, perturbation_gene) WHERE dataset = 'LINCS'
        UNION ALL SELECT CASE WHEN perturbation_type = 'chemical' THEN 'C2G' ELSE 'G2C' END, to_json([dataset, cell_line]), instance_id, list_sort(list(anchor_gene))
            FROM member JOIN law USING (dataset, cell_line, anchor_gene) GROUP BY perturbation_type, dataset, cell_line, instance_id""",
    "hold": """SELECT 't1' AS p, to_json([dataset, perturbation_type, cell_line]) AS slice, perturbation_gene AS key, instance_id FROM inst
        UNION ALL SELECT 'cross', to_json([perturbation_type, cell_line]), perturbation_gene, instance_id FROM inst JOIN matched USING (cell_line, perturbation_type, perturbation_gene) WHERE dataset = 'scPerturb'
        UNION ALL SELECT CASE WHEN perturbation_type = 'genetic' THEN 'C2G' ELSE 'G2C' END, to_json([dataset, cell_line]), anchor_gene, instance_id FROM member JOIN law USING (dataset, cell_line, anchor_gene)""",
    "gal": "SELECT p, slice, key, representation, dim, count(*) AS n, avg(v) AS m FROM hold JOIN long USING (instance_id) GROUP BY ALL HAVING p <> 't1' OR count(*) >= 2",
    "sims": """SELECT a.p, a.slice, a.instance_id, l.representation, g.key, list_contains(a.own, g.key) AS pos, round(sum(l.v * w) / nullif(sqrt(sum(l.v * l.v) * sum(w * w)), 0), 9) AS sim
        FROM ask a JOIN long l ON a.instance_id = l.instance_id JOIN (SELECT * FROM gal) g ON g.p = a.p AND g.slice = a.slice AND g.representation = l.representation AND g.dim = l.dim,
        LATERAL (SELECT CASE WHEN a.p = 't1' AND list_contains(a.own, g.key) THEN (g.m * g.n - l.v) / (g.n - 1) ELSE g.m END AS w) GROUP BY ALL""",
    "places": "SELECT *, row_number() OVER (PARTITION BY p, instance_id, representation ORDER BY sim DESC NULLS LAST, key) AS rn FROM sims",
    "ranks": "SELECT p, instance_id AS query_instance_id, representation, count(*) AS gallery_size, count(*) FILTER (WHERE pos) AS n_positive_keys, min(rn) FILTER (WHERE pos) AS rank_true FROM places GROUP BY ALL HAVING n_positive_keys > 0",
    "sizes": "SELECT DISTINCT gallery_size AS g, n_positive_keys AS k FROM ranks",
    "chance": """SELECT g, k, CASE WHEN k = 1 THEN list_sum(list_transform(range(1, g + 1), lambda r: 1.0 / r)) / g ELSE list_sum(list_transform(range(1, g), lambda r: (1.0 / r) * (g - r))) / (g * (g - 1) / 2) END AS e_mrr,
        least(k * 1.0 / g, 1.0) AS e_hit1,
        CASE WHEN k = 1 THEN least(3, g) * 1.0 / g ELSE 1 - greatest(g - least(3, g), 0) * greatest(g - least(3, g) - 1, 0) * 1.0 / (g * (g - 1)) END AS e_hit3,
        CASE WHEN k = 1 THEN least(5, g) * 1.0 / g ELSE 1 - greatest(g - least(5, g), 0) * greatest(g - least(5, g) - 1, 0) * 1.0 / (g * (g - 1)) END AS e_hit5 FROM sizes""",
    "scored": """SELECT ranks.*, (1.0 / rank_true) AS mrr_raw, CAST(rank_true <= 1 AS DOUBLE) AS hit1_raw, CAST(rank_true <= 3 AS DOUBLE) AS hit3_raw, CAST(rank_true <= 5 AS DOUBLE) AS hit5_raw,
        (1.0 / rank_true - e_mrr) AS mrr_corrected, ((rank_true <= 1)::INT - e_hit1) AS hit1_corrected, ((rank_true <= 3)::INT - e_hit3) AS hit3_corrected,
        ((rank_true <= 5)::INT - e_hit5) AS hit5_corrected FROM ranks JOIN chance ON g = gallery_size AND k = n_positive_keys""",
    "t1q": "SELECT i.dataset, i.perturbation_type, i.cell_line, i.perturbation_gene, s.* EXCLUDE (p) FROM scored s JOIN inst i ON s.query_instance_id = i.instance_id WHERE p = 't1'",
    "t2q": """SELECT i.dataset, i.cell_line, s.p AS direction, i.perturbation_gene, array_to_string(a.own, '|') AS anchor_gene, s.* EXCLUDE (p)
        FROM scored s JOIN inst i ON s.query_instance_id = i.instance_id JOIN ask a ON a.p = s.p AND a.instance_id = s.query_instance_id WHERE s.p IN ('C2G', 'G2C')""",
    "t1_lead": """SELECT dataset, perturbation_type, representation, metric_name, metric_value FROM (SELECT dataset, perturbation_type, representation, avg(mrr_corrected) AS mean_mrr_corrected,
        avg(hit1_corrected) AS mean_hit1_corrected, avg(hit3_corrected) AS mean_hit3_corrected, avg(hit5_corrected) AS mean_hit5_corrected FROM t1q GROUP BY ALL)
        UNPIVOT (metric_value FOR metric_name IN (mean_mrr_corrected, mean_hit1_corrected, mean_hit3_corrected, mean_hit5_corrected))""",
    "t2_means": """SELECT dataset, cell_line, direction, representation, count(*) AS n_valid, avg(gallery_size) AS gallery_size_mean, max(gallery_size) AS gallery_size_max,
        avg(n_positive_keys) AS n_positive_keys_mean, avg(mrr_raw) AS mean_mrr_raw, avg(hit1_raw) AS mean_hit1_raw, avg(hit3_raw) AS mean_hit3_raw,
        avg(hit5_raw) AS mean_hit5_raw, avg(mrr_corrected) AS mean_mrr_corrected, avg(hit1_corrected) AS mean_hit1_corrected,
        avg(hit3_corrected) AS mean_hit3_corrected, avg(hit5_corrected) AS mean_hit5_corrected FROM t2q GROUP BY ALL""",
    "t2_sum": """SELECT * FROM t2_means UNPIVOT (metric_value FOR metric_name IN
        (mean_mrr_raw, mean_hit1_raw, mean_hit3_raw, mean_hit5_raw, mean_mrr_corrected, mean_hit1_corrected, mean_hit3_corrected, mean_hit5_corrected))""",
    "t2_bench": """SELECT 'group' AS analysis_family, dataset, cell_line, 'NA' AS direction, representation, metric_name, metric_value
            FROM t2_board UNPIVOT INCLUDE NULLS (metric_value FOR metric_name IN (mean_cosine_centroid, mean_pcc_centroid, mean_e_distance))
        UNION ALL SELECT 'retrieval', dataset, cell_line, direction, representation, metric_name, metric_value FROM t2_sum WHERE metric_name LIKE '%_corrected'""",
    "axes": """SELECT task_axis, analysis_family || ':' || metric_name AS family_id, representation, avg(metric_value) AS metric_value FROM (
            SELECT 'task1' AS task_axis, 'group' AS analysis_family, representation, 'mean_' || metric_name AS metric_name, avg(metric_value) AS metric_value FROM t1l GROUP BY representation, metric_name
            UNION ALL SELECT 'task1', 'retrieval', representation, metric_name, avg(metric_value) FROM t1_lead GROUP BY representation, metric_name
            UNION ALL SELECT 'task2', analysis_family, representation, metric_name, metric_value FROM t2_bench)
        WHERE metric_name <> 'mean_e_distance' GROUP BY ALL""",
    # deltas
    "cell": "SELECT CAST(vec_id AS VARCHAR) AS cell_id, CASE WHEN vec_id % 2 = 0 THEN 'CRISPR' ELSE 'DRUG' END AS dataset_side, CASE WHEN vec_id % 37 = 0 THEN NULL ELSE embedding END AS vec FROM embeddings",
    "spine": """SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, CAST(vec_id AS VARCHAR) AS treated_cell_id, CASE WHEN vec_id % 2 = 0 THEN 'CRISPR' ELSE 'DRUG' END AS dataset_side,
        CAST(1 + (vec_id // 10) % 4 + CASE WHEN vec_id % 130 = 0 THEN 1 ELSE 0 END AS BIGINT) AS n_controls_used FROM embeddings WHERE vec_id % 10 IN (0, 1)""",
    "raw_pairs": """SELECT CAST(e.vec_id AS VARCHAR) AS treated_cell_id, CAST(e.vec_id + 2 * k.k AS VARCHAR) AS control_cell_id, CAST(k.k AS BIGINT) AS control_rank,
        CAST(1 + (e.vec_id // 10) % 4 AS BIGINT) AS n_controls_used, CASE WHEN e.vec_id % 2 = 0 THEN ' crispr' ELSE 'Drug ' END AS dataset_side
        FROM embeddings e JOIN (SELECT unnest([1, 2, 3, 4]) AS k) k ON k.k <= 1 + (e.vec_id // 10) % 4 WHERE e.vec_id % 10 IN (0, 1) AND e.vec_id % 170 <> 0""",
    "pairs": "SELECT treated_cell_id, control_cell_id, control_rank, n_controls_used, upper(trim(dataset_side)) AS dataset_side FROM raw_pairs",
    "means": """SELECT p.dataset_side, p.treated_cell_id, count(DISTINCT p.control_cell_id) AS n_controls, bool_and(c.vec IS NOT NULL) AS ok FROM pairs p
        LEFT JOIN cell c ON c.dataset_side = p.dataset_side AND c.cell_id = p.control_cell_id GROUP BY ALL""",
    "control_dim": """SELECT p.dataset_side, p.treated_cell_id, d.dim, avg(d.v) AS mean FROM pairs p JOIN (SELECT dataset_side, cell_id, CAST(unnest(range(len(vec))) AS INT) AS dim, CAST(unnest(vec) AS DOUBLE) AS v FROM cell) d
        ON d.dataset_side = p.dataset_side AND d.cell_id = p.control_cell_id GROUP BY ALL""",
    "treated_dim": "SELECT dataset_side, cell_id AS treated_cell_id, CAST(unnest(range(len(vec))) AS INT) AS dim, CAST(unnest(vec) AS DOUBLE) AS v FROM cell",
    "delta_sums": "SELECT dataset_side, treated_cell_id, sum(v - mean) AS s, sqrt(sum((v - mean) * (v - mean))) AS nrm FROM treated_dim JOIN control_dim USING (dataset_side, treated_cell_id, dim) GROUP BY ALL",
    "delta": """SELECT row_id, treated_cell_id, dataset_side, n_controls_used, CASE WHEN m.n_controls IS NULL THEN 'missing_pair_key' WHEN m.n_controls <> n_controls_used THEN 'n_controls_mismatch'
        WHEN c.vec IS NULL THEN 'treated_embedding_missing_or_invalid' WHEN NOT m.ok THEN 'control_embedding_missing_or_invalid' ELSE '' END AS invalid_reason
        FROM spine s LEFT JOIN means m USING (dataset_side, treated_cell_id) LEFT JOIN cell c ON c.dataset_side = s.dataset_side AND c.cell_id = s.treated_cell_id""",
    "needed": """SELECT dataset_side, treated_cell_id AS cell_id FROM pairs SEMI JOIN spine USING (dataset_side, treated_cell_id)
        UNION SELECT dataset_side, control_cell_id FROM pairs SEMI JOIN spine USING (dataset_side, treated_cell_id)""",
    # counts
    "cnts": "SELECT CAST(l_orderkey AS VARCHAR) AS cell_id, p_brand AS gene_symbol, sum(CAST(l_quantity AS DOUBLE)) AS cnt FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL",
    "gmap": """SELECT DISTINCT p_brand AS gene_symbol, CASE WHEN CAST(replace(p_brand, 'Brand#', '') AS INT) % 7 = 0 THEN 'ENSMUSG' ELSE 'ENSG' END || replace(p_brand, 'Brand#', '') AS ensembl_id
        FROM part WHERE CAST(replace(p_brand, 'Brand#', '') AS INT) % 5 <> 0""",
    "ensg": "SELECT * FROM gmap WHERE ensembl_id LIKE 'ENSG%'",
    "mcnt": "SELECT * FROM cnts SEMI JOIN ensg USING (gene_symbol)",
    "target": """SELECT DISTINCT p_brand AS gene_symbol, CAST(replace(p_brand, 'Brand#', '') AS BIGINT) AS src_pos, r.tgt_pos FROM part
        JOIN (VALUES ('Brand#3', 0), ('Brand#1', 4), ('Brand#2', 2), ('Brand#5', 3)) r(gene, tgt_pos) ON left(p_brand, 7) = r.gene""",
    "normed": "SELECT cell_id, gene_symbol, round(log2(1 + cnt * CASE WHEN t > 0 THEN 10000.0 / t ELSE 1.0 END), 6) AS x FROM (SELECT *, sum(cnt) OVER (PARTITION BY cell_id) AS t FROM mcnt)",
}

RANK_COLUMNS = "gallery_size, n_positive_keys, rank_true, mrr_raw, hit1_raw, hit3_raw, hit5_raw, mrr_corrected, hit1_corrected, hit3_corrected, hit5_corrected"

SQL = {
    "scan_project": "SELECT * FROM raw_pairs",
    "normalize_scalar": "SELECT c_custkey, CASE WHEN c_custkey % 5 IN (0, 1) THEN 'NA' ELSE coalesce(nullif(trim(c_mktsegment), ''), 'NA') END AS clean FROM customer",
    "side_mapping": "SELECT instance_id, CASE WHEN perturbation_type = 'genetic' THEN 'CRISPR' ELSE 'DRUG' END AS dataset_side FROM inst",
    "strict_cast": "SELECT row_id, n_controls_used FROM spine",
    "double_or_zero": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 0.0 ELSE CAST(replace(p_brand, 'Brand#', '') AS DOUBLE) END AS value FROM part",
    "canonical_target_set": """SELECT instance_id, array_to_string(list_sort(list_distinct(list_transform(string_split(' g9|' || lower(perturbation_gene) || '|G9 | a1', '|'), lambda t: upper(trim(t))))), '|') AS perturbation_gene FROM inst""",
    "membership_expand": "SELECT * FROM member",
    "row_membership": "SELECT instance_id, dataset, cell_line, anchor_gene, perturbation_type FROM member SEMI JOIN law USING (dataset, cell_line, anchor_gene)",
    "coverage": "SELECT * FROM cover",
    "lawful_units": "SELECT * FROM cover WHERE n_chem_instances > 0 AND n_gen_instances > 0",
    "data_inventory": "SELECT dataset, cell_line, perturbation_type, count(*) AS n_instances, count(DISTINCT perturbation_gene) AS n_units FROM inst GROUP BY ALL",
    "representation_registry": "SELECT dataset, cell_line, representation, count(*) AS n_instances FROM inst CROSS JOIN (SELECT unnest(['Gene', 'Pathway']) AS representation) GROUP BY ALL",
    "registered_rows": "SELECT instance_id, dataset, cell_line, representation FROM inst CROSS JOIN (SELECT unnest(['Gene', 'Pathway']) AS representation) WHERE dataset = 'LINCS' OR representation = 'Gene'",
    "split_half": "SELECT *, CASE WHEN rn % 2 = 1 THEN 'A' ELSE 'B' END AS side FROM (SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rn FROM split)",
    "subsample": "SELECT * EXCLUDE (rn), CAST(rn AS INTEGER) AS rn FROM split WHERE rn <= 3",
    "t1_cross_match": "SELECT * FROM matched",
    "t1_cross_proof": """SELECT 'LINCS_to_scPerturb' AS dataset_or_direction, perturbation_type, 'global_idx_lincs' AS alignment_key_lincs, 'sc_delta_row_idx' AS alignment_key_scperturb,
        count(*) AS n_matched_units FROM matched GROUP BY perturbation_type""",
    "centroid": "SELECT dataset, cell_line, perturbation_type, perturbation_gene, representation, count(*) AS n, CAST(dim AS INTEGER) AS dim, avg(v) AS mean FROM inst JOIN long USING (instance_id) GROUP BY ALL",
    "cosine_pcc": "SELECT dataset, cell_line, anchor_gene, representation, cosine_centroid, pcc_centroid FROM t2w",
    "e_distance": "SELECT dataset, cell_line, anchor_gene, representation, n_a, n_b, under AS underpowered_for_e_distance, e_distance FROM t2w",
    "t1_group_long": "SELECT * FROM t1l",
    "t2_group_long": "SELECT * FROM t2l",
    "t2_group_leaderboard": "SELECT * FROM t2_board",
    "loo_centroid": """SELECT instance_id, representation, CAST(dim AS INTEGER) AS dim, ((g.m * g.n - l.v) / (g.n - 1)) AS mean FROM inst i JOIN long l USING (instance_id) JOIN gal g USING (representation, dim)
        WHERE g.p = 't1' AND g.slice = to_json([i.dataset, i.perturbation_type, i.cell_line]) AND g.key = i.perturbation_gene""",
    "t1_retrieval_per_query": f"SELECT dataset, perturbation_type, representation, query_instance_id, cell_line, perturbation_gene, {RANK_COLUMNS} FROM t1q",
    "t1_cross_retrieval": f"SELECT perturbation_type, representation, query_instance_id, cell_line, perturbation_gene, {RANK_COLUMNS} FROM scored JOIN inst ON query_instance_id = instance_id WHERE p = 'cross'",
    "c2g_per_query": f"SELECT dataset, cell_line, direction, representation, query_instance_id, anchor_gene, perturbation_gene, {RANK_COLUMNS} FROM t2q WHERE direction = 'C2G'",
    "g2c_per_query": f"SELECT dataset, cell_line, direction, representation, query_instance_id, anchor_gene, perturbation_gene, {RANK_COLUMNS} FROM t2q WHERE direction = 'G2C'",
    "chance_expectation": f"""WITH sizes AS (SELECT g, k FROM (SELECT DISTINCT count(*) AS g FROM ({VIEWS["inst"]}) GROUP BY dataset, cell_line, perturbation_type, perturbation_gene) CROSS JOIN (SELECT unnest([1, 2]) AS k) WHERE k <= g)
        SELECT g AS gallery_size, CAST(k AS BIGINT) AS n_positive_keys, (e_mrr) AS e_mrr, CAST(e_hit1 AS DOUBLE) AS e_hit1, CAST(e_hit3 AS DOUBLE) AS e_hit3, CAST(e_hit5 AS DOUBLE) AS e_hit5 FROM (@chance)""",
    "t1_retrieval_summary": """SELECT dataset, perturbation_type, representation, n_total, coalesce(n_valid, 0) AS n_valid, n_total - coalesce(n_valid, 0) AS n_excluded, gallery_size_mean, gallery_size_max
        FROM (SELECT dataset, perturbation_type, representation, count(*) AS n_total FROM inst CROSS JOIN (SELECT unnest(['Gene', 'Pathway']) AS representation) GROUP BY ALL)
        LEFT JOIN (SELECT dataset, perturbation_type, representation, count(*) AS n_valid, avg(gallery_size) AS gallery_size_mean, max(gallery_size) AS gallery_size_max FROM t1q GROUP BY ALL)
        USING (dataset, perturbation_type, representation)""",
    "t1_leaderboard": "SELECT * FROM t1_lead",
    "t2_retrieval_summary": "SELECT * FROM t2_sum",
    "t2_retrieval_leaderboard": "SELECT dataset, cell_line, direction, representation, mean_mrr_corrected, mean_hit1_corrected, mean_hit3_corrected, mean_hit5_corrected FROM t2_means",
    "t2_benchmark_summary": "SELECT * FROM t2_bench",
    "axis_inputs": "SELECT * FROM axes",
    "scorecard": """SELECT representation, (t1) AS task1_axis_value_raw, (t2) AS task2_axis_value_raw, ((t1 + t2) / 2) AS overall_axis_value_raw FROM
        (SELECT representation, avg(metric_value) FILTER (WHERE task_axis = 'task1') AS t1, avg(metric_value) FILTER (WHERE task_axis = 'task2') AS t2 FROM axes GROUP BY representation)""",
    "input_registry": """WITH bad AS (SELECT 'S1' AS stage FROM (SELECT count(*) AS n, min(row_id) AS lo, max(row_id) AS hi FROM spine) WHERE NOT (lo = 0 AND hi = n - 1)
            UNION ALL SELECT 'S3' FROM (SELECT count(*) AS n FROM spine ANTI JOIN pairs USING (dataset_side, treated_cell_id)) WHERE n > 0)
        SELECT task, stage_name, 'r1' AS run_id, 'runs/r1/' || stage_name AS stage_dir, 'runs/r1/' || stage_name || '/manifest.json' AS manifest_path,
            'runs/r1/' || stage_name || '/audit_assertions.json' AS audit_assertions_path FROM (VALUES ('task1', 'S1'), ('task2', 'S3'), ('task2', 'S4')) s(task, stage_name) WHERE stage_name NOT IN (SELECT stage FROM bad)""",
    "stage_assertions": """WITH m AS (SELECT count(*) AS n FROM spine ANTI JOIN pairs USING (dataset_side, treated_cell_id)),
        a AS (SELECT 'S1' AS stage_name, 'input' AS gate, 'row_id_contiguous' AS name, min(row_id) = 0 AND max(row_id) = count(*) - 1 AS pass, 0 AS n FROM spine
            UNION ALL SELECT 'S3', 'input', 'delta_rows_have_pair_keys', n = 0, least(n, 5) FROM m
            UNION ALL SELECT s, g, a, true, 0 FROM (SELECT unnest(['S1', 'S3', 'S4']) AS s) CROSS JOIN (VALUES ('input', 'global_seed'), ('leakage', 'stage_output_routing'), ('leakage', 'input_path_isolation')) v(g, a))
        SELECT 'r1' AS run_id, stage_name, gate, name, pass, CAST(n AS INTEGER) AS n_counterexamples FROM a""",
    "panel_composition": "SELECT dataset, cell_line, perturbation_type, count(*) AS n FROM inst GROUP BY ALL",
    "panel_scoreboard": """WITH v AS (SELECT * FROM t1i WHERE metric_value IS NOT NULL), f AS (SELECT dataset_or_direction, cell_line, perturbation_type, perturbation_gene, metric_name FROM v GROUP BY ALL HAVING count(DISTINCT representation) = 2)
        SELECT representation, metric_name, count(*) AS n_units, avg(metric_value) AS mean_value FROM v SEMI JOIN f USING (dataset_or_direction, cell_line, perturbation_type, perturbation_gene, metric_name) GROUP BY ALL""",
    "panel_paired": """SELECT dataset, cell_line, metric_name, count(*) AS n_pairs, avg(a) AS mean_gene, avg(b) AS mean_pathway, avg(a - b) AS mean_difference FROM
        (SELECT dataset, cell_line, anchor_gene, metric_name, max(metric_value) FILTER (WHERE representation = 'Gene') AS a, max(metric_value) FILTER (WHERE representation = 'Pathway') AS b FROM t2l GROUP BY ALL)
        WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY ALL HAVING count(*) >= 3""",
    "panel_paired_significance": """WITH d AS (SELECT dataset, cell_line, anchor_gene, metric_name, max(metric_value) FILTER (WHERE representation = 'Gene') - max(metric_value) FILTER (WHERE representation = 'Pathway') AS d FROM t2l GROUP BY ALL),
        n AS (SELECT dataset, cell_line, metric_name, count(*) AS n_pairs, avg(d) AS mean_difference, sum(d) AS total, list(d ORDER BY d) AS ds FROM d WHERE d IS NOT NULL GROUP BY ALL HAVING count(*) >= 3)
        SELECT dataset, cell_line, metric_name, n_pairs, mean_difference, len(list_filter(range(0, 1 << n_pairs), lambda j: round(abs(list_sum(list_transform(ds, lambda x, i: CASE WHEN (j >> (i - 1)) & 1 = 1 THEN -x ELSE x END))), 9) >= round(abs(total), 9))) / (1 << n_pairs) AS p_value,
        'exact' AS method FROM n""",
    "token_sequences": """WITH g AS (SELECT gene_symbol, row_number() OVER (ORDER BY gene_symbol) AS place, count(*) OVER () AS n FROM ensg),
        t AS (SELECT cell_id, gene_symbol, CAST(least(greatest(floor(x), 0), 5) AS BIGINT) AS token FROM normed)
        SELECT cell_id, CAST(any_value(n) + 1 AS INTEGER) AS seq_len, 7 AS n_classes, 0 AS class_token, CAST(sum(token * place) AS BIGINT) AS checksum FROM t JOIN g USING (gene_symbol) GROUP BY cell_id""",
    "filled_symbols": "SELECT p_partkey, CASE WHEN p_partkey % 3 <> 0 THEN coalesce(p_brand, '') ELSE '' END AS gene_symbol FROM part",
    "panel_degradation": """SELECT perturbation_type, representation, metric_name, count(*) AS n_units, avg(a.metric_value) AS mean_internal, avg(b.metric_value) AS mean_cross,
        avg(b.metric_value - a.metric_value) AS mean_change FROM (SELECT * FROM t1i WHERE dataset_or_direction = 'LINCS' AND metric_value IS NOT NULL) a
        JOIN (SELECT * FROM t1c WHERE metric_value IS NOT NULL) b USING (cell_line, perturbation_type, perturbation_gene, representation, metric_name) GROUP BY ALL""",
    "panel_enrichment": """WITH v AS (SELECT * FROM t2l WHERE metric_value IS NOT NULL), m AS (SELECT representation, metric_name, avg(metric_value) AS slice_mean FROM v GROUP BY ALL),
        e AS (SELECT representation, metric_name, anchor_gene, count(*) AS support_n, (sum(metric_value) / count(*) - any_value(slice_mean)) AS pair_mean_enrichment FROM v JOIN m USING (representation, metric_name) GROUP BY ALL HAVING count(*) >= 3)
        SELECT *, CAST(row_number() OVER (PARTITION BY representation, metric_name ORDER BY round(pair_mean_enrichment, 9) DESC, anchor_gene) AS INTEGER) AS rank FROM e""",
    "panel_enrichment_cell_line": """WITH v AS (SELECT * FROM t2l WHERE metric_value IS NOT NULL), m AS (SELECT dataset, representation, metric_name, avg(metric_value) AS slice_mean FROM v GROUP BY ALL),
        e AS (SELECT dataset, representation, metric_name, cell_line, count(*) AS support_n, (sum(metric_value) / count(*) - any_value(slice_mean)) AS pair_mean_enrichment FROM v JOIN m USING (dataset, representation, metric_name) GROUP BY ALL HAVING count(*) >= 3)
        SELECT *, CAST(row_number() OVER (PARTITION BY dataset, representation, metric_name ORDER BY round(pair_mean_enrichment, 9) DESC, cell_line) AS INTEGER) AS rank FROM e""",
    "panel_enrichment_gene": """WITH v AS (SELECT * FROM t1i WHERE metric_value IS NOT NULL), m AS (SELECT representation, metric_name, avg(metric_value) AS slice_mean FROM v GROUP BY ALL),
        e AS (SELECT representation, metric_name, perturbation_gene, count(*) AS support_n, (sum(metric_value) / count(*) - any_value(slice_mean)) AS pair_mean_enrichment FROM v JOIN m USING (representation, metric_name) GROUP BY ALL HAVING count(*) >= 3)
        SELECT *, CAST(row_number() OVER (PARTITION BY representation, metric_name ORDER BY round(pair_mean_enrichment, 9) DESC, perturbation_gene) AS INTEGER) AS rank FROM e""",
    "panel_fm_local": """WITH b AS (SELECT direction, representation, metric_name, metric_value FROM t2_sum WHERE dataset = 'scPerturb' AND cell_line = 'K562')
        SELECT b.*, g.metric_value AS baseline_value FROM b LEFT JOIN (SELECT * FROM b WHERE representation = 'Gene') g USING (direction, metric_name)""",
    "pair_groups": "SELECT dataset_side, treated_cell_id, string_agg(control_cell_id, ',' ORDER BY control_rank, control_cell_id) AS controls, count(*) AS n_controls FROM pairs GROUP BY ALL",
    "pair_contract_violations": """SELECT dataset_side, treated_cell_id, count(*) AS n_controls, count(DISTINCT n_controls_used) AS n_stated, max(n_controls_used) AS stated FROM pairs
        GROUP BY dataset_side, treated_cell_id HAVING count(DISTINCT n_controls_used) <> 1 OR count(*) <> max(n_controls_used)""",
    "missing_pair_keys": "SELECT row_id, dataset_side, treated_cell_id FROM spine ANTI JOIN pairs USING (dataset_side, treated_cell_id)",
    "required_ids": "SELECT * FROM needed",
    "required_presence": """SELECT n.dataset_side, count(*) AS n_required, count(c.cell_id) AS n_present, count(*) - count(c.cell_id) AS n_missing FROM needed n LEFT JOIN cell c ON c.dataset_side = n.dataset_side AND c.cell_id = n.cell_id GROUP BY ALL""",
    "reindexed_embeddings": """SELECT n.dataset_side, n.cell_id, list_sum(list_transform(c.vec, lambda x: CAST(x AS DOUBLE))) AS total
        FROM needed n LEFT JOIN cell c ON c.dataset_side = n.dataset_side AND c.cell_id = n.cell_id""",
    "first_of_duplicates": "SELECT dataset_side, cell_id, list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS total FROM cell",
    "control_mean": "SELECT dataset_side, treated_cell_id, n_controls, CAST(dim AS INTEGER) AS dim, (mean) AS mean FROM means JOIN control_dim USING (dataset_side, treated_cell_id) WHERE ok",
    "fm_delta": """SELECT row_id, treated_cell_id, dataset_side, n_controls_used, invalid_reason = '' AS valid_mask, invalid_reason, CASE WHEN invalid_reason = '' THEN (s) END AS delta_sum,
        CASE WHEN invalid_reason = '' THEN (nrm) END AS delta_norm, 'stub' AS model_name, 619 AS seed FROM delta LEFT JOIN delta_sums USING (dataset_side, treated_cell_id)""",
    "invalid_reason_top": "SELECT invalid_reason, count(*) AS n FROM delta WHERE invalid_reason <> '' GROUP BY ALL ORDER BY n DESC, invalid_reason LIMIT 10",
    "row_id_audit": "SELECT count(*) AS n, min(row_id) AS lo, max(row_id) AS hi, count(DISTINCT row_id) AS n_distinct, count(*) = 0 OR (min(row_id) = 0 AND max(row_id) = count(*) - 1 AND count(DISTINCT row_id) = count(*)) AS contiguous FROM spine",
    "audit_assertions": """SELECT 'row_id_contiguous' AS name, min(row_id) = 0 AND max(row_id) = count(*) - 1 AS pass, CAST(0 AS BIGINT) AS n_bad FROM spine
        UNION ALL SELECT 'pair_group_contract', count(*) = 0, count(*) FROM (SELECT 1 FROM pairs GROUP BY dataset_side, treated_cell_id HAVING count(DISTINCT n_controls_used) <> 1 OR count(*) <> max(n_controls_used))
        UNION ALL SELECT 'delta_rows_have_pair_keys', count(*) = 0, count(*) FROM spine ANTI JOIN pairs USING (dataset_side, treated_cell_id)
        UNION ALL SELECT 'delta_finite_or_null', true, CAST(0 AS BIGINT) UNION ALL SELECT 'rows_preserved', count(*) = 0, count(*) FROM spine ANTI JOIN delta USING (row_id)""",
    "gene_map_ensembl": "SELECT * FROM ensg",
    "gene_align_lastwins": "SELECT cell_id, CAST(tgt_pos AS BIGINT) AS tgt_pos, cnt FROM cnts JOIN (SELECT tgt_pos, arg_max(gene_symbol, src_pos) AS gene_symbol FROM target GROUP BY tgt_pos) USING (gene_symbol) WHERE cnt <> 0",
    "gene_align_sum": "SELECT cell_id, CAST(tgt_pos AS BIGINT) AS tgt_pos, sum(cnt) AS cnt FROM cnts JOIN target USING (gene_symbol) GROUP BY ALL",
    "libsize_log2": "SELECT * FROM normed",
    "tokens": "SELECT cell_id, gene_symbol, CAST(least(greatest(floor(x), 0), 5) AS INTEGER) AS token FROM normed",
    "token_filter": """SELECT * FROM (SELECT cell_id, sum(cnt) AS row_sum, count(*) FILTER (WHERE cnt <> 0) AS row_nnz,
        count(*) FILTER (WHERE cnt <> 0) + CASE WHEN sum(cnt) > 0.0001 THEN 1 ELSE 0 END + CASE WHEN sum(cnt) > 1 THEN 1 ELSE 0 END AS pos_tokens FROM mcnt GROUP BY cell_id) WHERE row_sum > 0 AND pos_tokens >= 4""",
    "zero_row_filter": "SELECT cell_id, count(*) AS n_genes FROM mcnt GROUP BY cell_id HAVING max(cnt) > 0",
    "duplicate_ids": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) > 1",
    "embed_run_counts": """WITH c AS (SELECT dataset_side, cell_id, (row_number() OVER (PARTITION BY dataset_side ORDER BY CAST(cell_id AS BIGINT)) - 1) // 64 AS chunk FROM cell WHERE vec IS NOT NULL),
        g AS (SELECT dataset_side, chunk, count(*) AS n, count(*) FILTER (WHERE cell_id IN ('5', '10')) AS bad FROM c GROUP BY ALL)
        SELECT dataset_side, count(*) AS chunks_total, count(*) FILTER (WHERE bad > 0) AS chunks_failed, count(*) FILTER (WHERE bad = 0) AS chunks_succeeded,
        CAST(sum(n) AS BIGINT) AS rows_total, CAST(sum(bad) AS BIGINT) AS rows_failed FROM g GROUP BY ALL""",
    "embed_consensus": """SELECT dataset_side, cell_id, CAST(CASE WHEN CAST(cell_id AS BIGINT) % 97 <> 0 THEN 8 END AS INTEGER) AS dim,
        CASE WHEN CAST(cell_id AS BIGINT) % 97 = 0 THEN 'dimension 4, not 8' END AS error FROM cell WHERE vec IS NOT NULL""",
    "aligned_embeddings": "SELECT dataset_side, cell_id, list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))) AS total, CASE dataset_side WHEN 'CRISPR' THEN 'barcode' ELSE 'position' END AS way FROM cell",
    "npy_round_trip": """SELECT row_id, invalid_reason = '' AS valid, CASE WHEN invalid_reason = '' THEN t END AS total FROM delta
        LEFT JOIN (SELECT dataset_side, treated_cell_id, sum(CAST(CAST(v - mean AS FLOAT) AS DOUBLE)) AS t FROM treated_dim JOIN control_dim USING (dataset_side, treated_cell_id, dim) GROUP BY ALL) USING (dataset_side, treated_cell_id)""",
    "csv_round_trip": "SELECT row_id, 'say \"' || treated_cell_id || '\", then' AS treated_cell_id, dataset_side, n_controls_used FROM spine",
    "gene_list_tsv": "SELECT row_number() OVER (ORDER BY lower(p_brand)) - 1 AS pos, upper(p_brand) AS gene FROM (SELECT DISTINCT p_brand FROM part)",
    "cell_matrix": "SELECT CAST(vec_id AS VARCHAR) AS cell_id, CASE WHEN vec_id % 2 = 0 THEN 'CRISPR' ELSE 'DRUG' END AS dataset_side, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) AS total FROM embeddings",
    "error_messages": """WITH m AS (SELECT doc_id, right(coalesce(text, '') || [' CUDA error: no Memory', ' Out Of Memory', ' cuBLAS failed', ' memory', ' CUDA'][1 + doc_id % 5], 2000) AS t FROM documents),
        e AS (SELECT *, lower(right(t, 30)) AS e FROM m)
        SELECT doc_id, CAST(len(t) AS INTEGER) AS n_chars, md5(t) AS digest, contains(e, 'out of memory') OR (contains(e, 'cuda') AND contains(e, 'memory')) OR contains(e, 'cublas') AS memory, 'NA' AS cell_type FROM e""",
    "leakage": """SELECT representation, CAST(sum(n) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_leaks
        FROM (SELECT count(*) AS n FROM inst GROUP BY dataset, cell_line, perturbation_type, perturbation_gene HAVING count(*) >= 2) CROSS JOIN (SELECT unnest(['Gene', 'Pathway']) AS representation) GROUP BY ALL""",
    "stage_tables": """SELECT stage || '_table' AS table_name, keys, 0 AS n_metrics, '1' AS schema_version FROM (VALUES ('S1', 'row_id'), ('S3', 'dataset_side,treated_cell_id'), ('S4', 'dataset,cell_line,anchor_gene')) v(stage, keys)""",
    "chunk_assign": """SELECT dataset_side, cell_id, (row_number() OVER (PARTITION BY dataset_side ORDER BY cell_id) - 1) // 64 AS chunk FROM (SELECT dataset_side, CAST(cell_id AS BIGINT) AS cell_id FROM cell)""",
}


#: The columns of each query that are doubles, rounded where the query ends.
DOUBLES = {
    "double_or_zero": "value", "centroid": "mean", "cosine_pcc": "cosine_centroid pcc_centroid", "e_distance": "e_distance", "t1_group_long": "metric_value", "t2_group_long": "metric_value",
    "t2_group_leaderboard": "mean_cosine_centroid mean_pcc_centroid mean_e_distance", "loo_centroid": "mean", "chance_expectation": "e_mrr e_hit1 e_hit3 e_hit5",
    **dict.fromkeys(("t1_retrieval_per_query", "t1_cross_retrieval", "c2g_per_query", "g2c_per_query"), "mrr_raw hit1_raw hit3_raw hit5_raw mrr_corrected hit1_corrected hit3_corrected hit5_corrected"),
    "t1_retrieval_summary": "gallery_size_mean", "t1_leaderboard": "metric_value", "t2_retrieval_summary": "gallery_size_mean n_positive_keys_mean metric_value",
    "t2_retrieval_leaderboard": "mean_mrr_corrected mean_hit1_corrected mean_hit3_corrected mean_hit5_corrected", "t2_benchmark_summary": "metric_value", "axis_inputs": "metric_value",
    "scorecard": "task1_axis_value_raw task2_axis_value_raw overall_axis_value_raw", "panel_scoreboard": "mean_value", "panel_paired": "mean_gene mean_pathway mean_difference",
    "panel_degradation": "mean_internal mean_cross mean_change", "panel_enrichment": "pair_mean_enrichment", "panel_paired_significance": "mean_difference p_value", "panel_fm_local": "metric_value baseline_value", "control_mean": "mean",
    "fm_delta": "delta_sum delta_norm", "aligned_embeddings": "total", "cell_matrix": "total", "npy_round_trip": "total", "reindexed_embeddings": "total", "first_of_duplicates": "total",
    "panel_enrichment_cell_line": "pair_mean_enrichment", "panel_enrichment_gene": "pair_mean_enrichment",
}


def _needed(sql: str, known: dict[str, None]) -> None:
    for name in VIEWS:
        if name not in known and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql):
            _needed(VIEWS[name], known)
            known[name] = None


def _unrounded(name: str) -> str:
    """The query's SQL with the views it needs in front, each before those that use it."""
    body = SQL[name].replace("@chance", VIEWS["chance"])
    needed: dict[str, None] = {}
    own = re.match(r"\s*WITH\s+", body)
    locals_ = set(re.findall(r"(\w+) AS \(SELECT", body)) if own else set()
    _needed(body, needed)
    views = [f"{v} AS ({VIEWS[v]})" for v in needed if v not in locals_]
    if name == "chance_expectation":
        views = []
    if own:
        body = body[own.end() :]
        return f"WITH {', '.join(views) + ', ' if views else ''}{body}"
    return f"WITH {', '.join(views)} {body}" if views else body


def statement(name: str) -> str:
    inner = _unrounded(name)
    if name not in DOUBLES:
        return inner
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}' for c in DOUBLES[name].split())}) FROM ({inner})"


def statements() -> dict[str, str]:
    return {name: statement(name) for name in SQL}
