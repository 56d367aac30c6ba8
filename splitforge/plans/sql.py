r"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

_STRIP = r"regexp_replace(text, '^[\x09-\x0D\x20]+|[\x09-\x0D\x20]+$', '', 'g')"
_CLEAN = f"CASE WHEN {_STRIP} = '' OR lower({_STRIP}) IN ('nan', 'none', 'null') THEN NULL ELSE {_STRIP} END"
_LAB = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


def _cleaning(by: str) -> str:
    key = f"{by}, " if by else ""
    return f"""
SELECT {key}CAST(sum(n) AS BIGINT) AS total_rows, CAST(coalesce(sum(n) FILTER (WHERE key IS NULL), 0) AS BIGINT) AS missing_rows, CAST(coalesce(sum(n) FILTER (WHERE key IS NOT NULL), 0) AS BIGINT) AS valid_rows,
  count(*) FILTER (WHERE key IS NOT NULL AND n > 1) AS duplicate_groups, count(*) FILTER (WHERE key IS NOT NULL AND n > 1 AND v > 1) AS conflict_groups,
  CAST(coalesce(sum(CASE WHEN n > 1 AND v > 1 THEN n ELSE n - 1 END) FILTER (WHERE key IS NOT NULL), 0) AS BIGINT) AS removed_rows
FROM (SELECT lang, {_CLEAN} AS key, count(*) AS n, count(DISTINCT struct_pack(q := quality, t := toxic)) AS v FROM {_LAB} GROUP BY 1, 2) {f'GROUP BY {by}' if by else ''}"""


def _concentration(table: str, group: str, by: str) -> str:
    ratios = ", ".join(f"round(count(*) FILTER (WHERE n = {k}) * 1e0 / count(*), 9) AS {name}_ratio" for k, name in ((1, "singleton"), (2, "doubleton"), (3, "tripleton")))
    return f"""
WITH g AS (SELECT {by}, coalesce({_CLEAN.replace('text', group)}, '[NO_GROUP]') AS g, count(*) AS n FROM {table} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, g) AS down, row_number() OVER (PARTITION BY {by} ORDER BY n, g DESC) AS up FROM g)
SELECT {by}, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS total_groups, round(coalesce(sum(n) FILTER (WHERE g = '[NO_GROUP]'), 0) * 1e0 / sum(n), 9) AS no_group_ratio,
  round(sum(n) FILTER (WHERE down <= 1) * 1e0 / sum(n), 9) AS top1_ratio, round(sum(n) FILTER (WHERE down <= 5) * 1e0 / sum(n), 9) AS top5_ratio, {ratios},
  round(2e0 * sum(up * n) / (count(*) * sum(n)) - (count(*) + 1) * 1e0 / count(*), 9) AS gini FROM r GROUP BY {by}"""


_RAW = "raw AS (SELECT s, ord, sum(sz) * r AS x, floor(sum(sz) * r) AS f, sum(sz) AS n FROM g, (VALUES ('train', 0, 0.8e0), ('val', 1, 0.1e0), ('test', 2, 0.1e0)) v(s, ord, r) GROUP BY s, ord, r)"
_FOLD = """
WITH RECURSIVE g AS (__GROUPS__), o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY sz DESC, __ORDER__) AS rn FROM g),
raw AS (SELECT run, s, ord, sum(sz) * r AS x, floor(sum(sz) * r) AS f, sum(sz) AS n FROM g, (VALUES ('train', 0, 0.8e0), ('val', 1, 0.1e0), ('test', 2, 0.1e0)) v(s, ord, r) GROUP BY run, s, ord, r),
tgt AS (SELECT run, ord, CAST(f AS BIGINT) + CASE WHEN row_number() OVER (PARTITION BY run ORDER BY x - f DESC, ord) <= n - sum(f) OVER (PARTITION BY run) THEN 1 ELSE 0 END AS t FROM raw),
tt AS (SELECT run, max(CASE WHEN ord = 0 THEN t END) AS t0, max(CASE WHEN ord = 1 THEN t END) AS t1, max(CASE WHEN ord = 2 THEN t END) AS t2 FROM tgt GROUP BY run),
w(rn, run, k, sz, p, c0, c1, c2) AS (
  SELECT CAST(0 AS BIGINT), run, CAST(NULL AS __KEY__), CAST(0 AS BIGINT), -1, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM tt
  UNION ALL
  SELECT rn, run, k, sz, p, c0 + CASE WHEN p = 0 THEN sz ELSE 0 END, c1 + CASE WHEN p = 1 THEN sz ELSE 0 END, c2 + CASE WHEN p = 2 THEN sz ELSE 0 END FROM (
    SELECT o.rn, o.run, o.k, o.sz, w.c0, w.c1, w.c2, __CHOICE__ AS p FROM w JOIN o ON o.run = w.run AND o.rn = w.rn + 1 JOIN tt ON tt.run = w.run))
SELECT run, k, sz AS n_rows, CASE p WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM w WHERE rn > 0"""


def _tuple(kind: str, k: int) -> str:
    if kind == "quota":
        return f"(t{k} - c{k} > 0, (t{k} - c{k}) * 1e0 / greatest(t{k}, 1), t{k} - c{k})"
    return f"(c{k} >= t{k}, abs(t{k} - c{k} - o.sz), -(t{k} - c{k}))"


def _choice(kind: str) -> str:
    op = ">=" if kind == "quota" else "<="
    a, b, c = (_tuple(kind, k) for k in range(3))
    return f"CASE WHEN {a} {op} {b} AND {a} {op} {c} THEN 0 WHEN {b} {op} {c} THEN 1 ELSE 2 END"


def _fold(groups: str, order: str, kind: str, key: str = "VARCHAR") -> str:
    """(run, k, n_rows, split): the greedy rule, one group a run and step, for groups (run, k, sz, ...)."""
    return _FOLD.replace("__CHOICE__", _choice(kind)).replace("__GROUPS__", groups).replace("__ORDER__", order).replace("__KEY__", key)


_PARTS = "SELECT 0 AS run, p_name AS k, count(*) AS sz FROM part GROUP BY 2"
_QUOTA, _NEAR, _SEEDED_QUOTA = (f"SELECT k AS p_name, n_rows, split FROM ({_fold(_PARTS, order, kind)})" for order, kind in (("k", "quota"), ("k", "near"), ("md5(concat('0:', k))", "quota")))


def _hash_split(seed: int) -> str:
    return f"""(SELECT doc_id, CASE WHEN r <= t0 THEN 'train' WHEN r <= t0 + t1 THEN 'val' ELSE 'test' END AS split FROM
  (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('{seed}:', doc_id))) AS r FROM documents),
  (WITH g AS (SELECT count(*) AS sz FROM documents), {_RAW},
   tgt AS (SELECT ord, f + CASE WHEN row_number() OVER (ORDER BY x - f DESC, ord) <= n - sum(f) OVER () THEN 1 ELSE 0 END AS t FROM raw)
   SELECT max(CASE WHEN ord = 0 THEN t END) AS t0, max(CASE WHEN ord = 1 THEN t END) AS t1 FROM tgt))"""


_TO_INDEX = f"""(SELECT d.doc_id AS "row", split, idx FROM {_hash_split(0)} s JOIN documents d USING (doc_id) LEFT JOIN (SELECT text, lang, min(doc_id) AS idx FROM documents GROUP BY 1, 2) f ON d.text IS NOT DISTINCT FROM f.text AND d.lang IS NOT DISTINCT FROM f.lang)"""


def _word(first: int, last: int) -> str:
    return f"CAST(list_sum(list_transform(range({first}, {last + 1}), lambda i: CASE WHEN embedding[i] > 0 THEN CAST(1 AS HUGEINT) << CAST(i - {first} AS INT) ELSE 0 END)) AS BIGINT)"


_SIGB = f"(SELECT vec_id, {_word(1, 62)} AS w, {_word(63, 64)} AS x FROM embeddings)"
_SIM = "(bit_count(a.w & b.w) + bit_count(a.x & b.x)) * 1e0 / (bit_count(a.w | b.w) + bit_count(a.x | b.x))"
_ALL_TANIMOTO = f"(SELECT a.vec_id AS i, b.vec_id AS j, {_SIM} AS similarity FROM {_SIGB} a JOIN {_SIGB} b ON a.vec_id < b.vec_id WHERE {_SIM} >= 0.5e0)"
#: Pairs between classes of equal entities (named by their least id), and each other member with its class.
_SIG_CLASS = f"(SELECT vec_id AS id, min(vec_id) OVER (PARTITION BY w, x) AS of FROM {_SIGB})"
_TANIMOTO = f"(SELECT i, j, similarity FROM {_ALL_TANIMOTO} JOIN {_SIG_CLASS} p ON p.id = i JOIN {_SIG_CLASS} q ON q.id = j WHERE p.of = i AND (q.of = i OR q.of = j))"
#: The event types of the test tables, in order; the query finds them itself.
_EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
_UC = "(SELECT user_id, event_type, count(*) AS cnt FROM events GROUP BY 1, 2)"


def _count_pairs(ids: str) -> str:
    return f"""(WITH c AS (SELECT * FROM {_UC} WHERE {ids}), u AS (SELECT DISTINCT user_id FROM c), f AS (SELECT DISTINCT event_type FROM c),
  m AS (SELECT u.user_id, f.event_type, coalesce(cnt, 0) AS cnt FROM u CROSS JOIN f LEFT JOIN c USING (user_id, event_type))
  SELECT a.user_id AS i, b.user_id AS j, coalesce(avg(abs(a.cnt - b.cnt) * 1e0 / greatest(a.cnt, b.cnt)) FILTER (WHERE a.cnt + b.cnt > 0), 0e0) AS distance
  FROM m a JOIN m b ON a.user_id < b.user_id AND a.event_type = b.event_type GROUP BY 1, 2)"""



def _butina(links: str, ids: str, dynamic: bool) -> str:
    """(run, center, id, size): one center a run and step, as the sequential rule has it; links (run, i, j) go both ways."""
    n = "1 + count(l.j) FILTER (WHERE o.id IS NOT NULL)" if dynamic else "1 + coalesce(any_value(d.n), 0)"
    return f"""(WITH RECURSIVE links AS MATERIALIZED {links}, ids AS {ids}, d AS MATERIALIZED (SELECT run, i AS id, count(*) AS n FROM links GROUP BY 1, 2),
w(step, run, id, center) AS (
  SELECT 0, run, id, CAST(NULL AS BIGINT) FROM ids
  UNION ALL
  SELECT w.step + 1, w.run, w.id, CASE WHEN w.id = c.id OR l.j IS NOT NULL THEN c.id END FROM w
  JOIN (SELECT DISTINCT ON (run) run, id FROM (SELECT f.run, f.id, {n} AS n FROM w f LEFT JOIN links l ON l.run = f.run AND l.i = f.id LEFT JOIN w o ON o.run = l.run AND o.id = l.j AND o.center IS NULL LEFT JOIN d ON d.run = f.run AND d.id = f.id WHERE f.center IS NULL GROUP BY 1, 2) ORDER BY run, n DESC, id) c ON c.run = w.run
  LEFT JOIN links l ON l.run = c.run AND l.i = c.id AND l.j = w.id WHERE w.center IS NULL)
SELECT run, center, id, count(*) OVER (PARTITION BY run, center) AS size FROM w WHERE center IS NOT NULL)"""


_NEAR_VECTORS = f"(SELECT 0 AS run, i, j FROM {_ALL_TANIMOTO} UNION ALL SELECT 0, j, i FROM {_ALL_TANIMOTO})"
_VECTORS = "(SELECT 0 AS run, vec_id AS id FROM embeddings)"
_DYNAMIC, _STATIC = _butina(_NEAR_VECTORS, _VECTORS, True), _butina(_NEAR_VECTORS, _VECTORS, False)


def _clusters(of: str) -> str:
    return f"SELECT run, center AS k, count(*) AS sz, min(id) AS least FROM {of} GROUP BY 1, 2"


_BUTINA_SPLIT = f"""WITH c AS MATERIALIZED ({_clusters(_DYNAMIC)})
SELECT k AS center, n_rows, least, split FROM ({_fold("SELECT * FROM c", "md5(concat('0:', least))", "quota", "BIGINT")}) JOIN (SELECT k, least FROM c) USING (k)"""

_COUNT_LIST = f"(SELECT user_id AS id, list(struct_pack(f := event_type, c := cnt) ORDER BY event_type) AS k FROM {_UC} GROUP BY 1)"
_COUNT_CLASS = f"(SELECT id, min(id) OVER (PARTITION BY k) AS of FROM {_COUNT_LIST})"
_BOTH_CLASS = f"(SELECT id, min(id) OVER (PARTITION BY k, w, x) AS of FROM {_COUNT_LIST} JOIN {_SIGB} ON vec_id = id)"
_GRID = "(SELECT row_number() OVER () AS run, weight, cutoff FROM (VALUES (0e0), (0.5e0), (1e0)) a(weight), (VALUES (0.35e0), (0.45e0), (0.55e0)) b(cutoff))"
_BOTH = f"""(SELECT d.i, d.j, 1e0 - {_SIM} AS ds, distance AS dc FROM {_count_pairs('user_id IN (SELECT vec_id FROM embeddings)')} d JOIN {_SIGB} a ON a.vec_id = d.i JOIN {_SIGB} b ON b.vec_id = d.j)"""
_SWEEP_LINKS = f"(SELECT run, unnest([i, j]) AS i, unnest([j, i]) AS j FROM {_BOTH}, {_GRID} WHERE CAST(CAST(least(1e0, weight * ds + (1 - weight) * dc) AS FLOAT) AS DOUBLE) <= cutoff)"
_SWEEP_IDS = f"(SELECT run, vec_id AS id FROM {_GRID}, embeddings WHERE vec_id IN (SELECT user_id FROM events))"
_SWEEP = f"""WITH c AS MATERIALIZED ({_clusters(_butina(_SWEEP_LINKS, _SWEEP_IDS, False))}), f AS MATERIALIZED ({_fold("SELECT * FROM c", "least", "near", "BIGINT")}),
a AS (SELECT run, count(*) AS n_clusters, max(sz) AS largest, min(sz) AS smallest, count(*) FILTER (WHERE sz = 1) AS n_singletons FROM c GROUP BY 1)
SELECT weight, cutoff, n_clusters, largest, smallest, n_singletons, {", ".join(f"CAST(coalesce((SELECT sum(n_rows) FROM f WHERE f.run = a.run AND split = '{s}'), 0) AS BIGINT) AS {s}" for s in ("train", "val", "test"))} FROM a JOIN {_GRID} USING (run)"""

_CELLS = "(SELECT o_orderpriority, o_orderstatus, round(avg(o_totalprice), 2) AS value FROM orders GROUP BY 1, 2)"
_DELTAS = f"(SELECT c.o_orderpriority, c.o_orderstatus, c.value - b.value AS delta FROM {_CELLS} c LEFT JOIN {_CELLS} b ON b.o_orderpriority = '1-URGENT' AND b.o_orderstatus = c.o_orderstatus WHERE c.o_orderpriority <> '1-URGENT')"
_ALIGNED = "(o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' OR o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'O' OR o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'P')"
_SEEDED = "(" + " UNION ALL ".join(f"SELECT {c} AS cursor, min(vec_id) AS i, max(vec_id) AS j FROM (SELECT vec_id FROM embeddings ORDER BY md5(concat('7:{c}:', vec_id)) LIMIT 2)" for c in range(3)) + ")"

ORACLE_SQL = {
    "normalize_text": f"SELECT doc_id, {_CLEAN} AS text FROM documents",
    "status_counts": f"SELECT CASE WHEN {_CLEAN} IS NULL THEN 'missing' WHEN quality IS NULL THEN 'unlabelled' ELSE 'valid' END AS status, count(*) AS n_rows FROM {_LAB} GROUP BY 1",
    "distinct_text": f"SELECT min(doc_id) AS doc_id, t AS text FROM (SELECT doc_id, {_STRIP} AS t FROM documents WHERE text IS NOT NULL) WHERE t NOT IN ('', 'nan') GROUP BY t",
    "dedup_keep_first": "SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source FROM documents GROUP BY text",
    "dedup_mean": f"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, count(*) AS n_rows, round(avg(n_chars), 4) AS n_chars, round(avg(quality), 4) AS quality FROM {_LAB} GROUP BY text",
    "dedup_conflict_drop": f"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, min(quality) AS quality, min(toxic) AS toxic, count(*) AS n_rows FROM {_LAB} GROUP BY text HAVING count(DISTINCT struct_pack(q := quality, t := toxic)) = 1",
    "dedup_multitask_merge": f"SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, min(quality) AS quality, min(toxic) AS toxic, count(*) AS n_rows FROM {_LAB} GROUP BY text HAVING count(DISTINCT quality) <= 1 AND count(DISTINCT toxic) <= 1",
    "clean_summary": _cleaning("lang"),
    "clean_summary_total": _cleaning("").replace("FROM (SELECT lang,", "FROM (SELECT lang,"),
    "group_counts": f"SELECT coalesce({_CLEAN.replace('text', 'p_name')}, '[NO_GROUP]') AS p_name, count(*) AS n_rows FROM part GROUP BY 1",
    "group_top5": f"SELECT coalesce({_CLEAN.replace('text', 'source')}, '[NO_GROUP]') AS source, count(*) AS n_rows FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5",
    "concentration": _concentration("part", "p_name", "p_brand"),
    "concentration_by_lang": _concentration("documents", "source", "lang"),
    "target_counts": """WITH t AS (SELECT lang, count(*) AS total FROM documents GROUP BY 1), raw AS (SELECT lang, total, split, ord, total * r AS x, floor(total * r) AS f FROM t, (VALUES ('train', 0, 0.8e0), ('val', 1, 0.1e0), ('test', 2, 0.1e0)) v(split, ord, r))
SELECT lang, split, CAST(f + CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY x - f DESC, ord) <= total - sum(f) OVER (PARTITION BY lang) THEN 1 ELSE 0 END AS BIGINT) AS target FROM raw""",
    "greedy_split_quota": _QUOTA,
    "greedy_split_posttarget": _NEAR,
    "greedy_split_seeded": _SEEDED_QUOTA,
    "split_summary": f"SELECT 'quota' AS run, split, CAST(sum(n_rows) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(sum(n_rows) AS DOUBLE) / sum(sum(n_rows)) OVER () AS fraction FROM ({_QUOTA}) GROUP BY split",
    "random_split_hash": f"SELECT * FROM {_hash_split(0)}",
    "split_to_index": f"SELECT * FROM {_TO_INDEX}",
    "index_mapping": f"SELECT split, count(*) AS n_rows, count(DISTINCT idx) AS n_targets, count(*) FILTER (WHERE idx IS NULL) AS n_unmatched FROM {_TO_INDEX} GROUP BY 1",
    "key_uniqueness": " UNION ALL ".join(f"SELECT '{k}' AS \"columns\", CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE n > 1) AS n_repeated_keys, count(*) FILTER (WHERE n > 1) = 0 AS is_unique FROM (SELECT count(*) AS n FROM documents GROUP BY {k})" for k in ("text", "text,lang", "doc_id")),
    "unmatched_rows": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'F')",
    "duplicate_targets": f"SELECT idx, count(*) AS n_rows FROM {_TO_INDEX} GROUP BY 1 HAVING count(*) > 1",
    "split_overlap": f"SELECT doc_id, count(DISTINCT split) AS n_splits FROM (SELECT * FROM {_hash_split(0)} UNION ALL SELECT * FROM {_hash_split(1)}) GROUP BY 1 HAVING count(DISTINCT split) > 1",
    "index_range": "SELECT p_partkey AS idx FROM part WHERE p_partkey < 0 OR p_partkey >= (SELECT count(*) FROM documents)",
    "signature_bits": f"SELECT vec_id, w AS word_0, x AS word_1, bit_count(w) + bit_count(x) AS n_bits FROM {_SIGB}",
    "tanimoto_pairs": f"SELECT * FROM {_TANIMOTO}",
    "neighbor_counts": f"SELECT vec_id, 1 + count(i) AS n_neighbors FROM embeddings LEFT JOIN (SELECT i, j FROM {_ALL_TANIMOTO} UNION ALL SELECT j, i FROM {_ALL_TANIMOTO}) ON i = vec_id GROUP BY 1",
    "nearest_pairs_topk": f"SELECT * FROM {_TANIMOTO} ORDER BY similarity DESC, i, j LIMIT 100",
    "butina_dynamic": f"SELECT center, id, size FROM {_DYNAMIC}",
    "butina_static": f"SELECT center, id, size FROM {_STATIC}",
    "cluster_summary": f"SELECT run, count(*) AS n_clusters, max(size) AS largest, min(size) AS smallest, count(*) FILTER (WHERE size = 1) AS n_singletons FROM (SELECT DISTINCT run, center, size FROM {_DYNAMIC}) GROUP BY 1",
    "butina_split": _BUTINA_SPLIT,
    "feature_counts": f"SELECT * FROM {_UC}",
    "feature_matrix": f"SELECT user_id, {', '.join(f"count(*) FILTER (WHERE event_type = '{t}') AS {t}" for t in _EVENT_TYPES)} FROM events GROUP BY user_id",
    "vocabulary_summary": f"SELECT event_type, count(DISTINCT user_id) AS n_entities, CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total, count(user_id) > 0 AS ever_hit FROM (SELECT DISTINCT event_type FROM events UNION ALL SELECT 'never') LEFT JOIN {_UC} USING (event_type) GROUP BY 1",
    "count_distance_pairs": f"SELECT i, j, round(distance, 9) AS distance FROM {_count_pairs('true')} JOIN {_COUNT_CLASS} p ON p.id = i JOIN {_COUNT_CLASS} q ON q.id = j WHERE distance <= 0.1e0 AND p.of = i AND (q.of = i OR q.of = j)",
    "active_rows": f"""WITH two AS (SELECT row_number() OVER (ORDER BY user_id) AS k, user_id FROM (SELECT DISTINCT user_id FROM events ORDER BY 1 LIMIT 2)), c AS (SELECT k, event_type, cnt FROM {_UC} JOIN two USING (user_id)),
p AS (SELECT event_type, CAST(coalesce(sum(cnt) FILTER (WHERE k = 1), 0) AS BIGINT) AS count_a, CAST(coalesce(sum(cnt) FILTER (WHERE k = 2), 0) AS BIGINT) AS count_b FROM c GROUP BY 1)
SELECT *, CASE WHEN count_b = 0 THEN 'a_only' WHEN count_a = 0 THEN 'b_only' ELSE 'shared' END AS membership, round(abs(count_a - count_b) * 1e0 / greatest(count_a, count_b), 9) AS gap FROM p""",
    "combined_distance": f"""WITH s AS (SELECT * FROM {_SIGB} WHERE vec_id IN (SELECT user_id FROM events)), p AS (SELECT d.i, d.j, CAST(CAST(least(1e0, 0.5e0 * (1e0 - {_SIM}) + 0.5e0 * distance) AS FLOAT) AS DOUBLE) AS total
FROM {_count_pairs('user_id IN (SELECT vec_id FROM embeddings)')} d JOIN s a ON a.vec_id = d.i JOIN s b ON b.vec_id = d.j) SELECT i, j, round(total, 6) AS total FROM p JOIN {_BOTH_CLASS} r ON r.id = i JOIN {_BOTH_CLASS} t ON t.id = j WHERE total <= 0.45e0 AND r.of = i AND (t.of = i OR t.of = j)""",
    "sweep_summary": _SWEEP,
    "param_grid": "SELECT w AS weight, c AS cutoff FROM (VALUES (0e0), (0.25e0), (0.5e0), (0.75e0), (1e0)) a(w), (VALUES (0.35e0), (0.45e0), (0.55e0)) b(c)",
    "classification_metrics": """WITH b AS (SELECT lang, quality, n_chars AS sc, (n_chars > 1000) = (quality = 1) AS same FROM documents JOIN labels USING (doc_id)),
g AS (SELECT lang, sc, count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n, count(*) FILTER (WHERE same) AS same FROM b GROUP BY 1, 2),
t AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(n) OVER (PARTITION BY lang ORDER BY sc DESC ROWS UNBOUNDED PRECEDING) AS k, coalesce(sum(n - p) OVER (PARTITION BY lang ORDER BY sc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(p) OVER (PARTITION BY lang) AS pp, sum(n - p) OVER (PARTITION BY lang) AS nn FROM g)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(sum(same) * 1e0 / sum(n), 9) AS accuracy, round(sum(p * (below + 0.5e0 * (n - p))) / max(pp * nn), 9) AS roc_auc, CASE WHEN max(pp) > 0 AND max(nn) > 0 THEN round(sum(CAST(p AS DOUBLE) / pp * (CAST(tp AS DOUBLE) / k)), 9) END AS pr_auc FROM t GROUP BY lang""",
    "mae_rmse_r2": "SELECT l_returnflag, count(*) AS n, round(avg(abs(e)), 3) AS mae, round(sqrt(avg(e * e)), 3) AS rmse, round(1 - avg(e * e) / var_pop(y), 6) AS r2 FROM (SELECT l_returnflag, l_extendedprice AS y, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY 1",
    "run_summary": "SELECT o_orderpriority, o_orderstatus, count(*) AS run_count, round(avg(o_totalprice), 3) AS mean, round(stddev_samp(o_totalprice), 3) AS std FROM orders GROUP BY 1, 2",
    "summary_long": f"""WITH m AS (SELECT l_returnflag, l_linestatus, l_linenumber % 3 AS run, CASE l_orderkey % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse
  FROM (SELECT *, l_extendedprice - l_quantity * 1500 AS e FROM lineitem) GROUP BY ALL)
{" UNION ALL ".join(f"SELECT l_returnflag, l_linestatus, s AS split, '{m}' AS metric, '{t}' AS stat, round({f}({m}) FILTER (WHERE split = s), 3) AS value FROM m, (VALUES ('train'), ('val'), ('test')) v(s) GROUP BY 1, 2, 3" for m in ("mae", "rmse") for t, f in (("mean", "avg"), ("std", "stddev_samp")))}""",
    "pivot_first": f"SELECT p AS o_orderpriority, max(value) FILTER (WHERE o_orderstatus = 'F') AS \"F\", max(value) FILTER (WHERE o_orderstatus = 'O') AS \"O\", max(value) FILTER (WHERE o_orderstatus = 'P') AS \"P\" FROM (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) v(p) LEFT JOIN {_CELLS} ON o_orderpriority = p GROUP BY p",
    "delta_vs_baseline": f"SELECT o_orderpriority, o_orderstatus, round(delta, 2) AS delta FROM {_DELTAS}",
    "aligned_effect": f"""WITH m AS (SELECT avg(delta) FILTER (WHERE {_ALIGNED}) AS a, avg(delta) FILTER (WHERE NOT {_ALIGNED}) AS u FROM {_DELTAS})
SELECT round(a, 4) AS aligned_mean, round(u, 4) AS unaligned_mean, round(a - u, 4) AS difference, round((a - u) / abs(u), 4) AS relative_effect, printf('%.2f%%', round_even((a - u) / abs(u) * 100, 2)) AS relative_effect_pct FROM m""",
    "seeded_pairs": f"SELECT * FROM {_SEEDED}",
    "pair_lookup": f"SELECT cursor, i, j, {_SIM} AS similarity FROM {_SEEDED} JOIN {_SIGB} a ON a.vec_id = i JOIN {_SIGB} b ON b.vec_id = j",
}
