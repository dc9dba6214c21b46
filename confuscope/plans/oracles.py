"""DuckDB SQL with the meaning of the engine's queries, from common table expressions that mirror the adapters."""

from __future__ import annotations

NATION = """
pairs AS (SELECT c_mktsegment AS script, nc.n_name AS true_char, ns.n_name AS pred_char
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation nc ON c_nationkey = nc.n_nationkey JOIN nation ns ON s_nationkey = ns.n_nationkey)"""
EVENT = """
pairs AS (SELECT 'u' || (user_id % 4)::VARCHAR AS script, event_type AS true_char, pred_char FROM (
  SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pred_char FROM events) WHERE pred_char IS NOT NULL)"""
TRI = """
pairs AS (SELECT r_name AS script, true_char, pred_char FROM (
  SELECT o_custkey, o_orderstatus AS true_char, lead(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS pred_char FROM orders)
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE pred_char IS NOT NULL)"""
COUNTED = """,
cells AS (SELECT script, true_char, pred_char, count(*)::DOUBLE AS n FROM pairs GROUP BY ALL),
labels AS (SELECT script, (row_number() OVER (PARTITION BY script ORDER BY ch) - 1)::INT AS idx, ch
  FROM (SELECT script, true_char AS ch FROM cells UNION SELECT script, pred_char FROM cells)),
sizes AS (SELECT script, count(*)::INT AS size FROM labels GROUP BY script),
off AS (SELECT * FROM cells WHERE true_char <> pred_char AND n > 0)"""
DENSE = """,
dense AS (SELECT a.script, a.idx AS i, b.idx AS j, a.ch AS true_char, b.ch AS pred_char, coalesce(n, 0) AS n
  FROM labels a JOIN labels b ON a.script = b.script LEFT JOIN cells c ON c.script = a.script AND c.true_char = a.ch AND c.pred_char = b.ch)"""
METRICS = """,
metrics AS (SELECT script, size, t::BIGINT AS total_observations, d / t AS accuracy, 1 - d / t AS error_rate, 1 - nnz / (size::DOUBLE * size) AS sparsity
  FROM sizes JOIN (SELECT script, sum(n) AS t, sum(CASE WHEN true_char = pred_char THEN n ELSE 0 END) AS d, count(*) AS nnz FROM cells GROUP BY script) USING (script))"""
FEATURES = METRICS + DENSE + """,
g AS (SELECT script, 2 * sum(r * n) / (max(k) * sum(n)) - (max(k) + 1) / max(k) AS gini FROM (
  SELECT script, n, row_number() OVER (PARTITION BY script ORDER BY n) AS r, count(*) OVER (PARTITION BY script)::DOUBLE AS k FROM dense WHERE i <> j) GROUP BY script),
ts AS (SELECT script, sum(CASE WHEN r <= 10 THEN n ELSE 0 END) / sum(n) AS top_share FROM (
  SELECT script, n, row_number() OVER (PARTITION BY script ORDER BY n DESC) AS r FROM off) GROUP BY script),
cr AS (SELECT script, sum(CASE WHEN (i < size // 2) <> (j < size // 2) THEN n ELSE 0 END) / greatest(sum(n), 1) AS case_rate FROM dense JOIN sizes USING (script) WHERE i <> j GROUP BY script),
dd AS (SELECT script, sum(CASE WHEN i = j THEN n ELSE 0 END) / sum(CASE WHEN i <> j THEN n ELSE 0 END) AS dominance FROM dense GROUP BY script),
sy AS (SELECT a.script, 1 - sqrt(sum((a.n - b.n) * (a.n - b.n))) / (2 * sqrt(sum(a.n * a.n))) AS symmetry FROM dense a JOIN dense b ON a.script = b.script AND a.i = b.j AND a.j = b.i GROUP BY a.script),
re AS (SELECT script, i, true_char AS ch, coalesce(-sum(CASE WHEN n > 0 THEN n / s * ln(n / s) END), 0) AS entropy
  FROM (SELECT *, sum(n) OVER (PARTITION BY script, i) AS s FROM dense) GROUP BY ALL),
me AS (SELECT script, avg(entropy) AS mean_entropy FROM re GROUP BY script),
features AS (SELECT script, accuracy, error_rate, sparsity, gini, top_share, case_rate, dominance, symmetry, mean_entropy
  FROM metrics JOIN g USING (script) JOIN ts USING (script) JOIN cr USING (script) JOIN dd USING (script) JOIN sy USING (script) JOIN me USING (script))"""
SPREAD = """,
spread AS (SELECT script, var_pop(r) AS row_variance, var_pop(c) AS col_variance, sum((r = 0)::INT)::BIGINT AS zero_rows, sum((c = 0)::INT)::BIGINT AS zero_cols FROM (
  SELECT script, ch, coalesce((SELECT sum(n) FROM cells x WHERE x.script = l.script AND x.true_char = l.ch), 0) AS r,
         coalesce((SELECT sum(n) FROM cells x WHERE x.script = l.script AND x.pred_char = l.ch), 0) AS c FROM labels l) GROUP BY script)"""
SINKHORN = """,
sk(k, script, i, j, x) AS (SELECT 0, script, i, j, n + 1e-10 FROM dense UNION ALL
  SELECT k + 1, script, i, j, x / sum(x) OVER (PARTITION BY script, j)
  FROM (SELECT k, script, i, j, x / sum(x) OVER (PARTITION BY script, i) AS x FROM sk WHERE k < 60)),
b AS (SELECT script, i, j, x FROM sk WHERE k = 60)"""
#: Spectra of 3 x 3 matrices in closed form: one eigenvalue is known, the others solve a quadratic.
SPECTRA = """,
bs AS (SELECT p.script, p.i, p.j, (p.x + q.x) / 2 AS x FROM b p JOIN b q ON p.script = q.script AND p.i = q.j AND p.j = q.i),
deg AS (SELECT script, i, sum(n) AS d FROM (SELECT script, i, n / 2 AS n FROM dense UNION ALL SELECT script, j, n / 2 FROM dense) GROUP BY ALL),
lap AS (SELECT w.script, w.i, w.j, (w.i = w.j)::INT - w.x / sqrt(d1.d * d2.d) AS x
  FROM (SELECT p.script, p.i, p.j, (p.n + q.n) / 2 AS x FROM dense p JOIN dense q ON p.script = q.script AND p.i = q.j AND p.j = q.i) w
  JOIN deg d1 ON w.script = d1.script AND w.i = d1.i JOIN deg d2 ON w.script = d2.script AND w.j = d2.i),
wide AS (SELECT kind, script, max(x) FILTER (i = 0 AND j = 0) AS a, max(x) FILTER (i = 0 AND j = 1) AS b, max(x) FILTER (i = 0 AND j = 2) AS c,
    max(x) FILTER (i = 1 AND j = 0) AS d, max(x) FILTER (i = 1 AND j = 1) AS e, max(x) FILTER (i = 1 AND j = 2) AS f,
    max(x) FILTER (i = 2 AND j = 0) AS g, max(x) FILTER (i = 2 AND j = 1) AS h, max(x) FILTER (i = 2 AND j = 2) AS k
  FROM (SELECT 'bistochastic' AS kind, * FROM b UNION ALL SELECT 'symmetric', * FROM bs UNION ALL SELECT 'laplacian', * FROM lap) GROUP BY ALL),
quad AS (SELECT kind, script, a + e + k - CASE WHEN kind = 'laplacian' THEN 0 ELSE 1 END AS s,
    CASE WHEN kind = 'laplacian' THEN (a * e - b * d) + (a * k - c * g) + (e * k - f * h)
         ELSE a * (e * k - f * h) - b * (d * k - f * g) + c * (d * h - e * g) END AS p FROM wide),
roots AS (SELECT kind, script, CASE WHEN s * s / 4 >= p THEN abs(s / 2 + sqrt(s * s / 4 - p)) ELSE sqrt(p) END AS x,
    CASE WHEN s * s / 4 >= p THEN abs(s / 2 - sqrt(s * s / 4 - p)) ELSE sqrt(p) END AS y FROM quad),
spectra AS (SELECT kind, script, CASE WHEN kind = 'laplacian' THEN [greatest(x, y), least(x, y), 0.0] ELSE [1.0, greatest(x, y), least(x, y)] END AS v FROM roots),
ent AS (SELECT kind, script, -sum(q * ln(q)) AS h FROM (SELECT kind, script, z * z / sum(z * z) OVER (PARTITION BY kind, script) AS q
  FROM (SELECT kind, script, unnest(v) AS z FROM spectra)) WHERE q > 1e-18 GROUP BY ALL),
prof AS (SELECT s1.script, s1.v AS bv, s2.v AS sv, s3.v AS lv, 1 - s1.v[2] AS bistochastic_gap, e1.h AS bistochastic_entropy, exp(e1.h) AS effective_rank,
    1 - s2.v[2] AS symmetric_gap, s3.v[2] AS fiedler_value, e3.h AS laplacian_entropy
  FROM spectra s1 JOIN spectra s2 ON s1.script = s2.script AND s2.kind = 'symmetric' JOIN spectra s3 ON s1.script = s3.script AND s3.kind = 'laplacian'
  JOIN ent e1 ON e1.script = s1.script AND e1.kind = 'bistochastic' JOIN ent e3 ON e3.script = s1.script AND e3.kind = 'laplacian' WHERE s1.kind = 'bistochastic'),
wd AS (SELECT a.kind, a.script AS a, b.script AS b, (abs(a.v[1] / list_sum(a.v) - b.v[1] / list_sum(b.v)) + abs((a.v[1] + a.v[2]) / list_sum(a.v) - (b.v[1] + b.v[2]) / list_sum(b.v))) / 3 AS w
  FROM spectra a JOIN spectra b ON a.kind = b.kind AND a.script < b.script),
spectral AS (SELECT p.script AS a, q.script AS b, 0.8 * w.w + 0.2 * sqrt(((p.bistochastic_gap - q.bistochastic_gap) ** 2 + ((p.bistochastic_entropy - q.bistochastic_entropy) / 5) ** 2
    + ((p.effective_rank - q.effective_rank) / 50) ** 2 + (p.symmetric_gap - q.symmetric_gap) ** 2 + ((p.fiedler_value - q.fiedler_value) / 2) ** 2
    + ((p.laplacian_entropy - q.laplacian_entropy) / 5) ** 2) / 6) AS d
  FROM prof p JOIN prof q ON p.script < q.script JOIN wd w ON w.kind = 'bistochastic' AND w.a = p.script AND w.b = q.script),
multi AS (SELECT a, b, sum(CASE kind WHEN 'symmetric' THEN 0.2 ELSE 0.4 END * w) AS d FROM wd GROUP BY a, b)"""
FROBENIUS = DENSE + """,
norm AS (SELECT script, i, j, n / sum(n) OVER (PARTITION BY script) AS x FROM dense),
fro AS (SELECT a.script AS a, b.script AS b, sqrt(sum((coalesce(p.x, 0) - coalesce(q.x, 0)) ** 2)) AS d
  FROM sizes a JOIN sizes b ON a.script < b.script JOIN (SELECT DISTINCT i, j FROM dense) ij ON true
  LEFT JOIN norm p ON p.script = a.script AND p.i = ij.i AND p.j = ij.j LEFT JOIN norm q ON q.script = b.script AND q.i = ij.i AND q.j = ij.j GROUP BY ALL)"""
ACCURACY = """,
accs AS (SELECT script, sum(CASE WHEN true_char = pred_char THEN n ELSE 0 END) / sum(n) AS accuracy FROM cells GROUP BY script),
accd AS (SELECT a.script AS a, b.script AS b, abs(a.accuracy - b.accuracy) AS d FROM accs a JOIN accs b ON a.script < b.script)"""
OVERLAP = """,
ovl AS (SELECT a.script AS a, b.script AS b, 1 - (SELECT count(*) FROM labels x JOIN labels y ON x.ch = y.ch WHERE x.script = a.script AND y.script = b.script)
    / (SELECT count(DISTINCT ch) FROM labels WHERE script IN (a.script, b.script))::DOUBLE AS d FROM sizes a JOIN sizes b ON a.script < b.script)"""
PATTERN = """,
top20 AS (SELECT script, true_char || '>' || pred_char AS p FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY n DESC, true_char, pred_char) AS r FROM off) WHERE r <= 20),
pat AS (SELECT a.script AS a, b.script AS b, 1 - (SELECT count(*) FROM top20 x JOIN top20 y ON x.p = y.p WHERE x.script = a.script AND y.script = b.script)
    / (SELECT count(DISTINCT p) FROM top20 WHERE script IN (a.script, b.script))::DOUBLE AS d FROM sizes a JOIN sizes b ON a.script < b.script)"""
#: The mean spectrum of each family of embeddings.
FAMILIES = """
emb AS (SELECT vec_id, 'f' || label::VARCHAR AS family, list_reverse_sort(list_transform(embedding, lambda x: abs(x)::DOUBLE)) AS v FROM embeddings),
long AS (SELECT vec_id, family, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM emb),
cum AS (SELECT vec_id, family, pos, sum(x) OVER (PARTITION BY vec_id ORDER BY pos) / sum(x) OVER (PARTITION BY vec_id) AS c FROM long),
fam AS (SELECT family, pos, avg(x) AS x FROM long GROUP BY ALL),
famcum AS (SELECT family, pos, sum(x) OVER (PARTITION BY family ORDER BY pos) / sum(x) OVER (PARTITION BY family) AS c FROM fam),
famd AS (SELECT a.family AS a, b.family AS b, avg(abs(a.c - b.c)) AS d FROM famcum a JOIN famcum b ON a.pos = b.pos AND a.family < b.family GROUP BY ALL),
sq AS (SELECT a, b, d FROM famd UNION ALL SELECT b, a, d FROM famd UNION ALL SELECT DISTINCT family, family, 0.0 FROM fam)"""
TESTS = FAMILIES + """,
tests AS (SELECT 'all' AS family, a || '_' || b AS test_id, least(round(d * 20, 6), 1) AS p FROM famd)"""


#: Each turn with the next one of its conversation, and their edit distance. The built-in function counts bytes, so a pair's
#: characters are numbered first.
TURNS = """
pair AS (SELECT x.role AS script, x.conv_id AS a, x.turn AS b, nfc_normalize(coalesce(x.text, '')) AS truth, nfc_normalize(coalesce(y.text, '')) AS prediction
  FROM conversations x JOIN conversations y ON x.conv_id = y.conv_id AND y.turn = x.turn + 1)"""
DISTANCES = """
kinds AS (SELECT *, list_distinct(string_split(truth || prediction, '')) AS ks FROM pair),
dist AS (SELECT *, levenshtein(array_to_string(list_transform(string_split(truth, ''), lambda c: CASE WHEN c = '' THEN '' ELSE chr(list_position(ks, c)::INT) END), ''),
  array_to_string(list_transform(string_split(prediction, ''), lambda c: CASE WHEN c = '' THEN '' ELSE chr(list_position(ks, c)::INT) END), ''))::INT AS distance FROM kinds)"""


def r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def counted(fixture: str, tail: str, more: str = "", recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{fixture}{COUNTED}{more}\n{tail}"


_HELD = "(SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test_id) AS r, count(*) OVER (PARTITION BY family) AS m FROM tests)"


def _corrected(expression: str, frame: str) -> str:
    return f"""WITH {TESTS}
SELECT family, test_id, {r6('p')}, round(least(adj, 1), 6) + 0.0 AS p_adj, least(adj, 1) < 0.05 AS significant
FROM (SELECT *, {expression} OVER (PARTITION BY family ORDER BY p, test_id {frame}) AS adj FROM {_HELD})"""


FEATURE_NAMES = ("accuracy", "error_rate", "sparsity", "gini", "top_share", "case_rate", "dominance", "symmetry", "mean_entropy")
SCALARS = ("bistochastic_gap", "bistochastic_entropy", "effective_rank", "symmetric_gap", "fiedler_value", "laplacian_entropy")

CHECKS = """
SELECT script, check_name, passed FROM (SELECT script, unnest([
  {'check_name': 'square', 'passed': true}, {'check_name': 'size', 'passed': size BETWEEN 5 AND 500}, {'check_name': 'accuracy', 'passed': accuracy > 0.5},
  {'check_name': 'sample_size', 'passed': total_observations >= 50}, {'check_name': 'no_zero_rows_or_columns', 'passed': zero_rows = 0 AND zero_cols = 0},
  {'check_name': 'diagonal', 'passed': accuracy > 0.3}, {'check_name': 'consistency', 'passed': row_variance < total_observations AND col_variance < total_observations}], recursive := true)
  FROM metrics JOIN spread USING (script))"""

ORACLE_SQL: dict[str, str] = {
    "count_cells": counted(NATION, "SELECT * FROM cells"),
    "count_cells_events": counted(EVENT, "SELECT * FROM cells"),
    "label_table": counted(NATION, "SELECT * FROM labels"),
    "prune_unused": counted(NATION, """, keep AS (SELECT script, ch FROM (SELECT script, true_char AS ch, n FROM cells UNION ALL SELECT script, pred_char, n FROM cells) GROUP BY ALL HAVING sum(n) >= 950)
SELECT c.* FROM cells c JOIN keep a ON c.script = a.script AND c.true_char = a.ch JOIN keep b ON c.script = b.script AND c.pred_char = b.ch"""),
    "prune_report": counted(NATION, """, t AS (SELECT script, ch, sum(n) AS s FROM (SELECT script, true_char AS ch, n FROM cells UNION ALL SELECT script, pred_char, n FROM cells) GROUP BY ALL)
SELECT script, count(*) AS original_size, sum((s >= 950)::INT)::BIGINT AS pruned_size, sum((s < 950)::INT)::BIGINT AS removed FROM t GROUP BY script"""),
    "matrix_metrics": counted(NATION, f"SELECT script, size, total_observations, {r6('accuracy', 'error_rate', 'sparsity')} FROM metrics", METRICS),
    "builder_statistics": counted(EVENT, """SELECT script, sum(n)::BIGINT AS total_samples, count(*) AS unique_pairs, count(DISTINCT true_char) AS total_characters,
  round(sum(CASE WHEN true_char = pred_char THEN n ELSE 0 END) / sum(n), 6) AS accuracy FROM cells GROUP BY script"""),
    "label_accuracy": counted(NATION, """SELECT script, ch, round(coalesce(a, 0), 6) AS accuracy FROM labels LEFT JOIN (
  SELECT script, true_char AS ch, sum(CASE WHEN true_char = pred_char THEN n ELSE 0 END) / sum(n) AS a FROM cells GROUP BY ALL) USING (script, ch)"""),
    "top_confusions": counted(NATION, """SELECT script, rank::INT AS rank, true_char, pred_char, n FROM (
  SELECT *, row_number() OVER (PARTITION BY script ORDER BY n DESC, true_char, pred_char) AS rank FROM off) WHERE rank <= 10"""),
    "interpretable_features": counted(NATION, f"SELECT script, {r6(*FEATURE_NAMES)} FROM features", FEATURES),
    "interpretable_features_events": counted(EVENT, f"SELECT script, {r6(*FEATURE_NAMES)} FROM features", FEATURES),
    "row_entropies": counted(NATION, f"SELECT script, ch, {r6('entropy')} FROM re", FEATURES),
    "row_column_spread": counted(NATION, f"SELECT script, {r6('row_variance', 'col_variance')}, zero_rows, zero_cols FROM spread", SPREAD),
    "row_normalize": counted(NATION, """SELECT script, true_char, pred_char, round(CASE WHEN s > 0 THEN n / s ELSE 1 / size::DOUBLE END, 6) AS n
FROM (SELECT *, sum(n) OVER (PARTITION BY script, i) AS s FROM dense) JOIN sizes USING (script) WHERE n > 0 OR s = 0""", DENSE),
    "symmetrize": counted(NATION, "SELECT a.script, a.true_char, a.pred_char, (a.n + b.n) / 2 AS n FROM dense a JOIN dense b ON a.script = b.script AND a.i = b.j AND a.j = b.i WHERE a.n + b.n > 0", DENSE),
    "laplacian_normalized": counted(TRI, f"SELECT script, i, j, {r6('x')} FROM lap", DENSE + SINKHORN + SPECTRA, True),
    "laplacian_plain": counted(TRI, """, w AS (SELECT a.script, a.true_char, a.pred_char, a.i, a.j, (a.n + b.n) / 2 AS x FROM dense a JOIN dense b ON a.script = b.script AND a.i = b.j AND a.j = b.i)
SELECT script, true_char, pred_char, CASE WHEN i = j THEN sum(x) OVER (PARTITION BY script, i) ELSE 0 END - x AS n FROM w""", DENSE),
    "bistochastic_cells": counted(TRI, f"SELECT script, i, j, {r6('x')} FROM b", DENSE + SINKHORN, True),
    "bistochastic_cells_nation": counted(NATION, f"SELECT script, i, j, {r6('x')} FROM b", DENSE + SINKHORN, True),
    "spectral_features": counted(TRI, f"SELECT script, 3 AS matrix_size, {r6(*SCALARS)} FROM prof", DENSE + SINKHORN + SPECTRA, True),
    "spectra": counted(TRI, f"SELECT kind, script, (generate_subscripts(v, 1) - 1)::INT AS idx, round(unnest(v), 6) + 0.0 AS value FROM spectra", DENSE + SINKHORN + SPECTRA, True),
    "eigen_invariants": counted(NATION, """, w AS (SELECT a.script, a.i, a.j, (a.n + b.n) / 2 AS x FROM dense a JOIN dense b ON a.script = b.script AND a.i = b.j AND a.j = b.i)
SELECT script, round(sum(CASE WHEN i = j THEN x ELSE 0 END), 4) AS trace, round(sum(x * x), 2) AS square FROM w GROUP BY script""", DENSE),
    "normalized_spectra": counted(TRI, """SELECT kind, script, (generate_subscripts(v, 1) - 1)::INT AS idx, round(unnest(list_transform(v, lambda z: z / list_sum(v))), 6) + 0.0 AS value FROM spectra WHERE kind <> 'symmetric'""",
                                  DENSE + SINKHORN + SPECTRA, True),
    "compare_profiles": counted(TRI, """SELECT p.script AS a, q.script AS b, round(abs(p.accuracy - q.accuracy), 6) AS accuracy_diff, round(abs(p.sparsity - q.sparsity), 6) AS sparsity_diff,
  round(abs(p.gini - q.gini), 6) AS gini_diff, round(abs(p.dominance - q.dominance), 6) AS dominance_diff, round(abs(p.symmetry - q.symmetry), 6) AS symmetry_diff,
  round(abs(p.mean_entropy - q.mean_entropy), 6) AS mean_entropy_diff, round(abs(x.bistochastic_gap - y.bistochastic_gap), 6) AS bistochastic_gap_diff,
  round(abs(x.fiedler_value - y.fiedler_value), 6) AS fiedler_value_diff
FROM features p JOIN features q ON p.script < q.script JOIN prof x ON x.script = p.script JOIN prof y ON y.script = q.script""", FEATURES + SINKHORN + SPECTRA, True),
    "spectral_distance": counted(TRI, f"SELECT a, b, {r6('d')}, 'spectral' AS method FROM spectral", DENSE + SINKHORN + SPECTRA, True),
    "multi_spectrum_distance": counted(TRI, f"SELECT a, b, {r6('d')}, 'multi_spectrum' AS method FROM multi", DENSE + SINKHORN + SPECTRA, True),
    "frobenius_distance": counted(NATION, f"SELECT a, b, {r6('d')} FROM fro", FROBENIUS),
    "accuracy_distance": counted(NATION, f"SELECT a, b, {r6('d')} FROM accd", ACCURACY),
    "confusion_pattern_distance": counted(NATION, f"SELECT a, b, {r6('d')} FROM pat", PATTERN),
    "baselines": counted(NATION, """SELECT a, b, round(fro.d, 6) AS frobenius, round(accd.d, 6) AS accuracy, round(ovl.d, 6) + 0.0 AS character_overlap, round(pat.d, 6) AS confusion_pattern
FROM fro JOIN accd USING (a, b) JOIN ovl USING (a, b) JOIN pat USING (a, b)""", FROBENIUS + ACCURACY + OVERLAP + PATTERN),
    "all_distances": counted(TRI, """SELECT a, b, round(d, 6) + 0.0 AS d, method FROM (SELECT *, 'spectral' AS method FROM spectral UNION ALL SELECT *, 'multi_spectrum' FROM multi
  UNION ALL SELECT *, 'frobenius' FROM fro UNION ALL SELECT *, 'accuracy' FROM accd)""", FROBENIUS + ACCURACY + SINKHORN + SPECTRA, True),
    "distance_ranking": counted(NATION, """, s AS (SELECT a, b, d FROM fro UNION ALL SELECT b, a, d FROM fro)
SELECT 'frobenius' AS method, a, b, round(d, 6) AS d, row_number() OVER (PARTITION BY a ORDER BY d, b)::INT AS rank FROM s""", FROBENIUS),
    "nearest_script": counted(NATION, """, s AS (SELECT a, b, d FROM fro UNION ALL SELECT b, a, d FROM fro)
SELECT 'frobenius' AS method, a, arg_min(b, d) AS nearest, round(min(d), 6) AS d FROM s GROUP BY a""", FROBENIUS),
    "metric_axioms": f"""WITH {FAMILIES},
tri AS (SELECT count(*) AS n FROM sq x JOIN sq y ON x.a = y.a JOIN sq z ON z.a = y.b AND z.b = x.b WHERE x.d > y.d + z.d + 1e-10)
SELECT 'wasserstein' AS method, true AS non_negativity, true AS identity, true AS symmetry, n = 0 AS triangle_inequality, true AS self_minimum, n = 0 AS is_metric, n = 0 AS all_passed FROM tri""",
    "wasserstein_families": f"WITH {FAMILIES} SELECT a, b, round(d, 6) AS d FROM famd",
    "wasserstein_nearest": f"""WITH {FAMILIES}, p AS (SELECT a.vec_id AS query, b.vec_id, avg(abs(a.c - b.c)) AS d FROM cum a JOIN cum b ON a.pos = b.pos AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 GROUP BY ALL)
SELECT query, round(min(d), 6) AS d FROM p GROUP BY query""",
    "family_separation": f"""WITH {FAMILIES}, p AS (SELECT substr(a, 2)::INT % 2 = substr(b, 2)::INT % 2 AS same, d FROM famd)
SELECT round(avg(d) FILTER (same), 6) AS within_mean, round(avg(d) FILTER (NOT same), 6) AS between_mean, round(avg(d) FILTER (same) / avg(d) FILTER (NOT same), 6) AS separation,
  count(*) FILTER (same) AS n_within, count(*) FILTER (NOT same) AS n_between FROM p""",
    "spectrum_lines": f"WITH {FAMILIES} SELECT family AS script, (pos - 1)::INT AS idx, round(x, 6) AS value, round(c, 6) AS cum FROM fam JOIN famcum USING (family, pos)",
    "spectral_entropy": """SELECT vec_id, round(h, 6) AS entropy, round(exp(h), 6) AS effective_rank FROM (
  SELECT vec_id, -sum(q * ln(q)) AS h FROM (SELECT vec_id, x * x / sum(x * x) OVER (PARTITION BY vec_id) AS q FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings)) WHERE q > 0 GROUP BY vec_id)""",
    "bonferroni": _corrected("max(p * m)", "ROWS BETWEEN CURRENT ROW AND CURRENT ROW"),
    "holm": _corrected("max(p * (m - r + 1))", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"),
    "fdr_bh": _corrected("min(p * m / r)", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "fdr_by": _corrected("min(p * m * (SELECT sum(1.0 / k) FROM range(1, (SELECT count(*) FROM tests) + 1) t(k)) / r)", "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING"),
    "correction_summary": f"""WITH {TESTS}, adj AS (SELECT least(min(p * m / r) OVER (PARTITION BY family ORDER BY p, test_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1) AS q FROM {_HELD})
SELECT 'all' AS family, count(*) AS n_tests, sum((q < 0.05)::INT)::BIGINT AS n_significant, round(avg((q < 0.05)::INT), 6) AS proportion FROM adj""",
    "rank_correlation": counted(NATION, """, xy AS (SELECT fro.d AS x, accd.d AS y, fro.a || fro.b AS id FROM fro JOIN accd USING (a, b)),
rk AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM xy),
o AS (SELECT sum((sign(p.x - q.x) * sign(p.y - q.y) > 0)::INT)::DOUBLE AS c, sum((sign(p.x - q.x) * sign(p.y - q.y) < 0)::INT)::DOUBLE AS d,
  sum((p.x = q.x AND p.y <> q.y)::INT) AS tx, sum((p.x <> q.x AND p.y = q.y)::INT) AS ty, sum((p.x <> q.x)::INT) AS ordered FROM xy p JOIN xy q ON p.id < q.id)
SELECT 'all' AS family, (SELECT count(*) FROM xy) AS n, (SELECT round(corr(rx, ry), 6) FROM rk) AS rho, round((c - d) / sqrt((c + d + ty) * (c + d + tx)), 6) AS tau, round(c / greatest(ordered, 1), 6) AS rank_preservation FROM o""", FROBENIUS + ACCURACY),
    "historical_validation": f"""WITH {FAMILIES}, rel AS (SELECT * FROM (VALUES ('f0','f1','high'),('f0','f2','medium'),('f1','f2','low'),('f3','f4','high'),('f5','f3','low'),('f6','f7','medium'),('f8','zz','high'),('f9','f8','low')) t(a, b, e)),
x AS (SELECT rel.a || rel.b AS id, CASE e WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS r, sq.d FROM rel JOIN sq ON rel.a = sq.a AND rel.b = sq.b),
rk AS (SELECT rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2.0 AS rx, rank() OVER (ORDER BY -d) + (count(*) OVER (PARTITION BY d) - 1) / 2.0 AS ry FROM x),
o AS (SELECT sum((p.r <> q.r)::INT)::BIGINT AS ordered, sum((p.r <> q.r AND sign(p.r - q.r) = sign(q.d - p.d))::INT)::BIGINT AS correct FROM x p JOIN x q ON p.id < q.id)
SELECT (SELECT count(*) FROM x) AS n_relationships, correct AS n_correct, ordered AS n_ordered, round(correct / greatest(ordered, 1), 6) AS ordering_accuracy,
  (SELECT round(corr(rx, ry), 6) FROM rk) AS rho, correct / greatest(ordered, 1) >= 0.6 AS passed FROM o""",
    "matrix_validation": counted(NATION, CHECKS, METRICS + SPREAD),
    "validation_summary": counted(NATION, f"""SELECT script, sum(passed::INT)::BIGINT AS n_passed, sum((NOT passed)::INT)::BIGINT AS n_failed FROM ({CHECKS}) GROUP BY script""", METRICS + SPREAD),
    "heatmap": counted(NATION, "SELECT script, i, j, round(n / sum(n) OVER (PARTITION BY script, i), 6) AS n FROM dense QUALIFY dense.n > 0", DENSE),
    "csv_export": counted(EVENT, """SELECT script, 0 AS line_no, ',' || string_agg(ch, ',' ORDER BY idx) AS line FROM labels GROUP BY script
UNION ALL SELECT script, i + 1, true_char || ',' || string_agg(n::BIGINT::VARCHAR, ',' ORDER BY j) FROM dense GROUP BY script, i, true_char""", DENSE),
    "char_counts": """SELECT lang AS script, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL""",
    "text_statistics": """SELECT lang AS script, count(*) AS files, sum(length(text))::BIGINT AS total_chars, sum(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END)::BIGINT AS total_lines,
  (SELECT count(DISTINCT ch) FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents x WHERE x.lang = d.lang) WHERE ch <> '') AS unique_chars FROM documents d GROUP BY lang""",
    "top_characters": """SELECT script, rank::INT AS rank, ch, n FROM (SELECT *, row_number() OVER (PARTITION BY script ORDER BY n DESC, ch) AS rank FROM (
  SELECT lang AS script, ch, count(*) AS n FROM (SELECT lang, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL)) WHERE rank <= 20""",
    "charset_coverage": """WITH cs AS (SELECT DISTINCT unnest(string_split('abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.,!?;:''"-()[]{}/ ', '')) AS ch),
seen AS (SELECT DISTINCT lang AS script, unnest(string_split(text, '')) AS ch FROM documents),
j AS (SELECT l.script, cs.ch, s.ch IS NOT NULL AS hit FROM (SELECT DISTINCT lang AS script FROM documents) l CROSS JOIN (SELECT * FROM cs WHERE ch <> '') cs LEFT JOIN seen s ON s.script = l.script AND s.ch = cs.ch)
SELECT script, sum(hit::INT)::BIGINT AS covered, count(*) AS charset_size, round(100.0 * sum(hit::INT) / count(*), 6) AS coverage_percent,
  coalesce(string_agg(CASE WHEN NOT hit AND ch NOT IN (' ', chr(10)) THEN ch END, '' ORDER BY ch), '') AS missing FROM j GROUP BY script""",
    "clean_text": """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' '), ' +', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'),
  '[^\\n a-zA-Z0-9.,!?;:''"()\\[\\]{}/-]', '', 'g'), ' +', ' ', 'g'), ' ' || chr(10)) AS cleaned FROM documents""",
    "segment_texts": r"""WITH RECURSIVE x AS (SELECT lang AS script, format('d{:09d}', doc_id) AS source_file, row_number() OVER () AS r,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^[\x09-\x0D\x{85}\pZ]+|[\x09-\x0D\x{85}\pZ]+$', '', 'g')), lambda x: x <> '') AS ls FROM documents),
l AS (SELECT r, generate_subscripts(ls, 1) AS k, unnest(ls) AS line FROM x),
f(r, k, open, n, c, closed) AS (SELECT r, 0::BIGINT, NULL::VARCHAR, 0::BIGINT, 0, NULL::VARCHAR FROM x WHERE len(ls) > 0 UNION ALL
  SELECT r, k, CASE WHEN full_ OR open IS NULL THEN line ELSE open || chr(10) || line END, CASE WHEN full_ THEN length(line) ELSE n + length(line) END, CASE WHEN full_ THEN 1 ELSE c + 1 END, CASE WHEN full_ THEN open END
  FROM (SELECT f.r, l.k, f.open, f.n, f.c, l.line, f.n + length(l.line) > 100 OR f.c >= 5 AS full_ FROM f JOIN l ON f.r = l.r AND l.k = f.k + 1)),
s AS (SELECT r, k, closed AS text FROM f WHERE closed IS NOT NULL UNION ALL SELECT f.r, f.k + 1, f.open FROM f JOIN x ON f.r = x.r AND f.k = len(x.ls) AND f.k > 0)
SELECT script, source_file, (row_number() OVER (PARTITION BY r ORDER BY k) - 1)::INT AS segment_index, s.text FROM s JOIN x USING (r) WHERE length(s.text) >= 20""",
    "channel_match": """WITH d AS (SELECT lang AS script, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT script, doc_id, string_split(text, '') AS a, string_split(translate(text, 'eaotn', 'εαοτν'), '') AS b, length(text) AS n FROM d),
m AS (SELECT script, doc_id, n, CASE WHEN n = 0 THEN 0 ELSE len(list_filter(list_zip(a, b), lambda z: z[1] = z[2])) END AS matches FROM t)
SELECT script, doc_id, matches::INT AS matches, (n - matches)::INT AS substitutions, 0 AS insertions, 0 AS deletions,
  CASE WHEN n = 0 THEN 0 ELSE round(matches / n::DOUBLE, 6) END AS char_accuracy, CASE WHEN n = 0 THEN 1 ELSE round((n - matches) / n::DOUBLE, 6) END AS cer FROM m""",
    "channel_cells": """WITH z AS (SELECT lang AS script, unnest(string_split(text, '')) AS true_char, unnest(string_split(translate(text, 'eaotn', 'εαοτν'), '')) AS pred_char FROM documents)
SELECT script, true_char, pred_char, count(*)::DOUBLE AS n FROM z WHERE true_char <> '' GROUP BY ALL""",
    "edit_distance": f"WITH {TURNS}, {DISTANCES} SELECT script, a, b, distance FROM dist",
    "turn_alignment": f"""WITH {TURNS}, {DISTANCES}
SELECT script, a, b, distance AS edits, length(truth)::INT AS truth_chars, length(prediction)::INT AS prediction_chars,
  CASE WHEN truth = '' THEN 1 ELSE round(distance / length(truth)::DOUBLE, 6) END AS cer FROM dist""",
    "input_validation": """WITH i AS (SELECT lang AS script, count(*) AS n_images FROM documents GROUP BY lang), t AS (SELECT lang AS script, count(*) AS n_labels FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang)
SELECT script, n_images, n_labels, round(n_labels / n_images::DOUBLE, 6) AS coverage, true AS passed FROM i JOIN t USING (script)""",
    "run_statistics": """SELECT d.lang AS script, sum((quality IS NOT NULL AND toxic = 0)::INT)::BIGINT AS processed, sum((quality IS NULL)::INT)::BIGINT AS skipped, sum((quality IS NOT NULL AND toxic = 1)::INT)::BIGINT AS errors
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
    "label_lines": """WITH x AS (SELECT lang AS script, 'd' || doc_id::VARCHAR AS filename, doc_id, replace(replace(coalesce(text, ''), chr(10), '\\n'), chr(13), '\\r') AS t FROM documents)
SELECT script, filename, arg_max(trim(trim(t, '"'), ), doc_id) AS text FROM x GROUP BY ALL""",
    "labels_join": """SELECT d.lang AS script, count(*) AS images, count(l.doc_id) AS labelled, count(*) - count(l.doc_id) AS unlabelled FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY d.lang""",
}
ORACLE_SQL["channel_engine"] = ORACLE_SQL["channel_cells"]
ORACLE_SQL["streaming_counts"] = """SELECT strftime(ts, '%Y-%m-%d') AS day, event_type AS true_char, CASE WHEN value > 50 THEN 'high' ELSE 'low' END AS pred_char, count(*)::DOUBLE AS n FROM events GROUP BY ALL"""
ORACLE_SQL["image_plan"] = """WITH l AS (SELECT doc_id, lang AS script, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
u AS (SELECT doc_id, script, unnest(ls) AS text, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT *, (row_number() OVER (PARTITION BY script ORDER BY doc_id, pos) - 1) AS number FROM u)
SELECT script, printf('d%09d_%04d_aug%d.png', doc_id, number, aug) AS filename, text FROM k, range(3) t(aug)"""
ORACLE_SQL["dataset_summary"] = """SELECT lang AS script, sum(n)::BIGINT AS total_lines, (3 * sum(n))::BIGINT AS total_images FROM (
  SELECT lang, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents) GROUP BY lang HAVING sum(n) > 0"""
ORACLE_SQL["distance_square"] = counted(NATION, f"""SELECT 'frobenius' AS method, a, b, round(d, 6) AS d FROM (
  SELECT a, b, d FROM fro UNION ALL SELECT b, a, d FROM fro UNION ALL SELECT script, script, 0.0 FROM sizes)""", FROBENIUS)
ORACLE_SQL["feature_bars"] = counted(EVENT, """SELECT script, feature, round(value, 6) + 0.0 AS value FROM (
  UNPIVOT (SELECT script, accuracy, sparsity, gini, top_share, dominance, symmetry, mean_entropy FROM features) ON accuracy, sparsity, gini, top_share, dominance, symmetry, mean_entropy INTO NAME feature VALUE value)""", FEATURES)
ORACLE_SQL["character_overlap"] = """WITH s AS (SELECT DISTINCT lang AS script, unnest(string_split(text, '')) AS ch FROM documents), c AS (SELECT * FROM s WHERE ch <> '')
SELECT a.script AS a, b.script AS b, round(1 - (SELECT count(*) FROM c x JOIN c y ON x.ch = y.ch WHERE x.script = a.script AND y.script = b.script)
  / (SELECT count(DISTINCT ch) FROM c WHERE script IN (a.script, b.script))::DOUBLE, 6) AS d FROM (SELECT DISTINCT script FROM c) a JOIN (SELECT DISTINCT script FROM c) b ON a.script < b.script"""
ORACLE_SQL["distance_histogram"] = f"""WITH {FAMILIES}, e AS (SELECT min(d) AS lo, max(d) AS hi FROM famd)
SELECT 'wasserstein' AS method, least(floor((d - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM famd, e GROUP BY ALL"""
ORACLE_SQL["json_export"] = counted(EVENT, """, tops AS (SELECT script, string_agg(true_char || '>' || pred_char || '=' || n::BIGINT::VARCHAR, ',' ORDER BY n DESC, true_char, pred_char) AS top FROM (
  SELECT *, row_number() OVER (PARTITION BY script ORDER BY n DESC, true_char, pred_char) AS r FROM off) WHERE r <= 10 GROUP BY script),
rows AS (SELECT script, i, string_agg(n::BIGINT::VARCHAR, ',' ORDER BY j) AS line FROM dense GROUP BY ALL)
SELECT script, (SELECT string_agg(ch, ',' ORDER BY idx) FROM labels l WHERE l.script = m.script) AS characters, (SELECT string_agg(line, '/' ORDER BY i) FROM rows r WHERE r.script = m.script) AS matrix,
  top, round(accuracy, 6) AS accuracy, round(sparsity, 6) AS sparsity, total_observations, size FROM metrics m JOIN tops USING (script)""", METRICS + DENSE)
ORACLE_SQL["profile_summary"] = counted(TRI, """SELECT script, printf('%s: n=%d gap=%.4f rank=%.2f fiedler=%.4f accuracy=%.4f gini=%.4f', script, 3, bistochastic_gap, effective_rank, fiedler_value, accuracy, gini) AS summary
FROM prof JOIN features USING (script)""", FEATURES + SINKHORN + SPECTRA, True)
ORACLE_SQL["analysis_json"] = counted(TRI, """, every AS (SELECT a, b, d FROM spectral UNION ALL SELECT b, a, d FROM spectral),
bad AS (SELECT count(*) AS n FROM every x JOIN every y ON x.a = y.a JOIN every z ON z.a = y.b AND z.b = x.b WHERE x.d > y.d + z.d + 1e-10)
SELECT part, name, round(value, 6) + 0.0 AS value FROM (
  SELECT 'size' AS part, script AS name, 3.0 AS value FROM prof UNION ALL SELECT 'accuracy', script, accuracy FROM metrics UNION ALL SELECT 'spectral_gap', script, bistochastic_gap FROM prof
  UNION ALL SELECT 'effective_rank', script, effective_rank FROM prof UNION ALL SELECT 'distance', a || '_vs_' || b, d FROM spectral UNION ALL SELECT 'sanity', 'all_passed', (n = 0)::INT FROM bad)""",
                                      METRICS + DENSE + SINKHORN + SPECTRA, True)
ORACLE_SQL["average_linkage"] = counted(NATION, """, ends AS (SELECT a, b, d FROM fro UNION ALL SELECT b, a, d FROM fro),
leaves AS (SELECT script AS leaf, (row_number() OVER (ORDER BY script) - 1)::INT AS cl, count(*) OVER ()::INT AS n FROM sizes),
tree(step, leaf, cl, n, i, j, h) AS (SELECT 0, leaf, cl, n, NULL::INT, NULL::INT, NULL::DOUBLE FROM leaves UNION ALL
  SELECT t.step + 1, t.leaf, CASE WHEN t.cl IN (m.i, m.j) THEN t.n + t.step ELSE t.cl END, t.n, m.i, m.j, m.h
  FROM tree t, (SELECT x.cl AS i, y.cl AS j, avg(d) AS h FROM tree x JOIN tree y ON x.cl < y.cl JOIN ends e ON e.a = x.leaf AND e.b = y.leaf GROUP BY x.cl, y.cl ORDER BY round(avg(d), 12), x.cl, y.cl LIMIT 1) m)
SELECT 'frobenius' AS method, step - 1 AS step, i AS left, j AS right, round(any_value(h), 6) AS height, count(*) FILTER (cl = n + step - 1)::INT AS size FROM tree WHERE step > 0 GROUP BY step, i, j""", FROBENIUS, True)
ORACLE_SQL["rendered_cells"] = """WITH c AS (SELECT unnest(string_split(nfc_normalize(text), '')) AS ch FROM benchmark)
SELECT 'benchmark' AS script, ch AS true_char, ch AS pred_char, count(*)::DOUBLE AS n FROM c WHERE ch <> '' GROUP BY ch"""
ORACLE_SQL["heatmap_svg"] = counted(NATION, """SELECT script, count(*)::INT AS squares, (count(DISTINCT i) + count(DISTINCT j))::INT AS labels FROM dense WHERE n > 0 GROUP BY script""", DENSE)
