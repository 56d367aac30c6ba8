from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean_text, extracted_text, sql_round
from ..operators import clusters as C
from ..operators import dedup as D
from ..operators import effects as E
from ..operators import groups as G
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import similarity as N
from ..operators import splits as S
from ..operators import tasks as T
from ..operators import validate as V
from ..operators.shared import hash_order, saved
from ..operators.signatures import similar_clusters
from ..operators.sweep import sweep_tunable_splits

SIMILARITY, COUNT_CUTOFF = 0.5, 0.1
PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["F", "O", "P"]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _labelled(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id", "left")


def normalize_text(spark, d):
    return _t(spark, d, "documents").select("doc_id", clean_text(F.col("text")).alias("text"))


def status_counts(spark, d):
    status = F.when(clean_text(F.col("text")).isNull(), "missing").when(F.col("quality").isNull(), "unlabelled").otherwise("valid")
    return _labelled(spark, d).groupBy(status.alias("status")).agg(F.count("*").alias("n_rows"))


def distinct_text(spark, d):
    rows = _t(spark, d, "documents").select("doc_id", extracted_text(F.col("text")).alias("text")).filter("text is not null")
    return D.keep_first(rows, "text", "doc_id").select("doc_id", "text")


def dedup_keep_first(spark, d):
    return D.keep_first(_t(spark, d, "documents").select("doc_id", "text", "lang", "source"), "text", "doc_id").select("doc_id", "lang", "source")


def dedup_mean(spark, d):
    out = D.mean_labels(_labelled(spark, d).select("doc_id", "text", "lang", "n_chars", "quality"), "text", "doc_id", ["n_chars", "quality"])
    return out.select("doc_id", "lang", "n_rows", sql_round(F.col("n_chars")).alias("n_chars"), sql_round(F.col("quality")).alias("quality"))


def dedup_conflict_drop(spark, d):
    return D.drop_conflicts(_labelled(spark, d).select("doc_id", "text", "lang", "quality", "toxic"), "text", "doc_id", ["quality", "toxic"]).select("doc_id", "lang", "quality", "toxic", "n_rows")


def dedup_multitask_merge(spark, d):
    return D.merge_tasks(_labelled(spark, d).select("doc_id", "text", "lang", "quality", "toxic"), "text", "doc_id", ["quality", "toxic"]).select("doc_id", "lang", "quality", "toxic", "n_rows")


def _cleaning(spark, d, by):
    rows = _labelled(spark, d).withColumn("key", clean_text(F.col("text")))
    return D.cleaning_summary(rows, "key", by, ["quality", "toxic"])


def clean_summary(spark, d):
    return _cleaning(spark, d, ["lang"])


def clean_summary_total(spark, d):
    each = _cleaning(spark, d, ["lang"])
    return each.agg(*[F.sum(c).alias(c) for c in each.columns if c != "lang"])


def group_counts(spark, d):
    return G.group_counts(_t(spark, d, "part"), "p_name")


def group_top5(spark, d):
    return G.top_groups(G.group_counts(_t(spark, d, "documents"), "source"), "source", 5)


def _concentration(df, group, by):
    out = G.concentration(G.group_counts(df, group, [by]), group, [by])
    return out.select(*[sql_round(F.col(c), 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def concentration(spark, d):
    return _concentration(_t(spark, d, "part"), "p_name", "p_brand")


def concentration_by_lang(spark, d):
    return _concentration(_t(spark, d, "documents"), "source", "lang")


def target_counts(spark, d):
    totals = _t(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("total"))
    return S.compute_target_counts(totals, ["lang"]).select("lang", "split", "target")


def _part_split(spark, d, policy, seed=None):
    groups = G.group_counts(_t(spark, d, "part"), "p_name").withColumn("run", F.lit(policy))
    return S.greedy_split(groups, ["run"], "p_name", policy, seed=seed)


def greedy_split_quota(spark, d):
    return _part_split(spark, d, "quota").select("p_name", "n_rows", "split")


def greedy_split_posttarget(spark, d):
    return _part_split(spark, d, "post_target").select("p_name", "n_rows", "split")


def greedy_split_seeded(spark, d):
    return _part_split(spark, d, "quota", seed=0).select("p_name", "n_rows", "split")


def split_summary(spark, d):
    return S.split_summary(_part_split(spark, d, "quota"), ["run"])


def random_split_hash(spark, d):
    return S.random_split(_t(spark, d, "documents"), "doc_id", 0)


def _hash_splits(spark, d):
    docs = _t(spark, d, "documents")
    return S.random_split(docs, "doc_id", 0).withColumn("run", F.lit(0)).unionByName(S.random_split(docs, "doc_id", 1).withColumn("run", F.lit(1)))


def split_to_index(spark, d):
    docs = _t(spark, d, "documents")
    rows = S.random_split(docs, "doc_id", 0).join(docs.select("doc_id", "text", "lang"), "doc_id").select("split", "text", "lang", F.col("doc_id").alias("row"))
    full = docs.select("text", "lang", "doc_id").groupBy("text", "lang").agg(F.min("doc_id").alias("idx"))
    return V.map_rows(rows, full, ["text", "lang"], "idx").select("row", "split", "idx")


def index_mapping(spark, d):
    return split_to_index(spark, d).groupBy("split").agg(F.count("*").alias("n_rows"), F.count_distinct("idx").alias("n_targets"), F.count_if(F.col("idx").isNull()).alias("n_unmatched"))


def key_uniqueness(spark, d):
    return V.key_uniqueness(_t(spark, d, "documents"), [["text"], ["text", "lang"], ["doc_id"]])


def unmatched_rows(spark, d):
    line = _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_orderkey").alias("o_orderkey"))
    orders = _t(spark, d, "orders").filter("o_orderstatus <> 'F'")
    return V.unmatched(line, orders, ["o_orderkey"]).select("l_orderkey", "l_linenumber")


def duplicate_targets(spark, d):
    return V.repeated_targets(split_to_index(spark, d), "idx")


def split_overlap(spark, d):
    return V.split_overlap(_hash_splits(spark, d), [], "doc_id")


def index_range(spark, d):
    items, docs = _t(spark, d, "part"), _t(spark, d, "documents")
    return V.out_of_range(items.select(F.col("p_partkey").alias("idx")), "idx", docs.count())


def _signatures(spark, d):
    return _t(spark, d, "embeddings").select("vec_id", P.signature_words(F.col("embedding"), 64).alias("words"))


def signature_bits(spark, d):
    return _signatures(spark, d).select("vec_id", F.get("words", 0).alias("word_0"), F.get("words", 1).alias("word_1"), N.popcount(F.col("words")).alias("n_bits"))


def tanimoto_pairs(spark, d):
    return N.tanimoto_pairs(_signatures(spark, d), "vec_id", SIMILARITY)


def _classes(spark, d):
    """Classes of equal signatures, and the class of every vector."""
    rows = _signatures(spark, d)
    found = saved(N.classes(rows, "vec_id", ["words"]))
    return found, N.members(rows, found, "vec_id", ["words"])


def neighbor_counts(spark, d):
    found, of = _classes(spark, d)
    pairs = saved(N.similar(found, "vec_id", SIMILARITY))
    both = pairs.select("i", "j").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    sizes = found.select(F.col("vec_id").alias("j"), "size")
    near = both.join(sizes, "j").groupBy(F.col("i").alias("of")).agg(F.sum("size").alias("n"))
    own = found.select(F.col("vec_id").alias("of"), "size").join(near, "of", "left")
    return of.join(own, "of").select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("size")).alias("n_neighbors"))


def nearest_pairs_topk(spark, d):
    return tanimoto_pairs(spark, d).orderBy(F.desc("similarity"), "i", "j").limit(100)


def _butina(spark, d, dynamic):
    found, of = _classes(spark, d)
    return C.of_members(similar_clusters(found, "vec_id", SIMILARITY, dynamic).withColumn("run", F.lit(0)), of, "vec_id")


def butina_dynamic(spark, d):
    return _butina(spark, d, True).select("center", "id", "size")


def butina_static(spark, d):
    return _butina(spark, d, False).select("center", "id", "size")


def cluster_summary(spark, d):
    return C.summarize_clusters(_butina(spark, d, True), ["run"])


def butina_split(spark, d):
    groups = C.cluster_groups(_butina(spark, d, True), ["run"])
    return S.greedy_split(groups, ["run"], "center", "quota", order="least", seed=0).select("center", "n_rows", "least", "split")


def _user_counts(spark, d):
    return _t(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("cnt"))


def feature_counts(spark, d):
    return _user_counts(spark, d)


def feature_matrix(spark, d):
    """The wide form; ``feature_counts`` is the long one and has no bound on features."""
    counts = saved(_user_counts(spark, d))
    return P.feature_matrix(counts, "user_id", "event_type", "cnt", P.vocabulary(counts, "event_type"))


def vocabulary_summary(spark, d):
    words = _t(spark, d, "events").select("event_type").distinct().unionByName(spark.createDataFrame([("never",)], "event_type string"))
    return P.vocabulary_summary(_user_counts(spark, d), words, "event_type", "user_id", "cnt")


def count_distance_pairs(spark, d):
    out = N.count_distance_pairs(P.count_vectors(_user_counts(spark, d), "user_id", "event_type", "cnt"), "user_id", COUNT_CUTOFF)
    return out.withColumn("distance", sql_round(F.col("distance"), 9))


def active_rows(spark, d):
    counts = saved(_user_counts(spark, d))
    a, b = (r.user_id for r in counts.select("user_id").distinct().orderBy("user_id").limit(2).collect())
    return P.active_rows(counts, "user_id", "event_type", "cnt", a, b).withColumn("gap", sql_round(F.col("gap"), 9))


def _entities(spark, d):
    counts = P.count_vectors(_user_counts(spark, d), "user_id", "event_type", "cnt")
    sig = _signatures(spark, d)
    return saved(sig.join(counts, sig.vec_id == counts.user_id).select("vec_id", "words", "counts"))


def combined_distance(spark, d):
    found, of = N.entity_classes(_entities(spark, d), "vec_id")
    pairs = N.two_distances(found, "vec_id", 0.45, [0.5])
    total = N.combine_distances(F.col("d_structure"), F.col("d_counts"), F.lit(0.5)).cast("double")
    near = pairs.withColumn("total", total).filter("total <= 0.45")
    return N.with_members(near, of, "vec_id", "total", 0.0).withColumn("total", sql_round(F.col("total"), 6))


def param_grid(spark, d):
    weights, cutoffs = P.generate_param_grid(0.0, 1.0, 0.25), P.generate_param_grid(0.35, 0.55, 0.1)
    return spark.createDataFrame([(w, c) for w in weights for c in cutoffs], "weight double, cutoff double")


def sweep_summary(spark, d):
    return sweep_tunable_splits(_entities(spark, d), "vec_id", P.generate_param_grid(0.0, 1.0, 0.5), P.generate_param_grid(0.35, 0.55, 0.1))[2]


def classification_metrics(spark, d):
    docs, labels = _t(spark, d, "documents"), _t(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select("lang", F.col("quality").alias("y"), (F.col("n_chars") > 1000).cast("int").alias("pred"), F.col("n_chars").alias("score"))
    out = M.classification_metrics(rows, ["lang"])
    return out.select("lang", "n", *[sql_round(F.col(c), 9).alias(c) for c in ("accuracy", "roc_auc", "pr_auc")])


def mae_rmse_r2(spark, d):
    rows = _t(spark, d, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"))
    out = M.regression_metrics(rows, ["l_returnflag"])
    return out.select("l_returnflag", "n", sql_round(F.col("mae"), 3).alias("mae"), sql_round(F.col("rmse"), 3).alias("rmse"), sql_round(F.col("r2"), 6).alias("r2"))


def run_summary(spark, d):
    out = M.run_summary(_t(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"], ["o_totalprice"])
    return out.select("o_orderpriority", "o_orderstatus", "run_count", sql_round(F.col("o_totalprice_mean"), 3).alias("mean"), sql_round(F.col("o_totalprice_std"), 3).alias("std"))


def summary_long(spark, d):
    """Metrics of runs (three a return flag and line status), summed up by mean and deviation, as a long table."""
    split = F.when(F.col("l_orderkey") % 10 == 0, "test").when(F.col("l_orderkey") % 10 == 1, "val").otherwise("train")
    keys = ["l_returnflag", "l_linestatus"]
    rows = _t(spark, d, "lineitem").select(*keys, (F.col("l_linenumber") % 3).alias("run"), split.alias("split"), F.col("l_extendedprice").alias("y"), (F.col("l_quantity") * 1500).alias("pred"))
    runs = T.result_rows(M.regression_metrics(rows, [*keys, "run", "split"]), [*keys, "run"], ["mae", "rmse", "r2"])
    wide = M.run_summary(runs, keys, M.numeric_columns(runs, ("run",)))
    return T.summary_long(wide, keys, "regression").withColumn("value", sql_round(F.col("value"), 3))


def _cells(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.round(F.avg("o_totalprice"), 2).alias("value"))


def pivot_first(spark, d):
    return E.pivot_first(_cells(spark, d), [], "o_orderpriority", "o_orderstatus", "value", PRIORITIES, STATUSES)


def _deltas(spark, d):
    return E.delta_vs_baseline(_cells(spark, d), [], "o_orderpriority", "o_orderstatus", "value", PRIORITIES[0])


def delta_vs_baseline(spark, d):
    return _deltas(spark, d).withColumn("delta", sql_round(F.col("delta"), 2))


def aligned_effect(spark, d):
    aligned = ((F.col("o_orderpriority") == "2-HIGH") & (F.col("o_orderstatus") == "F")) | ((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderstatus") == "O")) | ((F.col("o_orderpriority") == "4-NOT SPECIFIED") & (F.col("o_orderstatus") == "P"))
    out = E.aligned_effect(_deltas(spark, d), [], aligned)
    return out.select(*[sql_round(F.col(c), 4).alias(c) for c in ("aligned_mean", "unaligned_mean", "difference", "relative_effect")], "relative_effect_pct")


def seeded_pairs(spark, d):
    """Pairs of distinct ids for three cursors of a seed: the two least hashes."""
    ids, out = _t(spark, d, "embeddings").select("vec_id"), None
    for cursor in range(3):
        two = ids.withColumn("h", hash_order(F.col("vec_id"), f"7:{cursor}")).orderBy("h").limit(2)
        one = two.agg(F.min("vec_id").alias("i"), F.max("vec_id").alias("j")).select(F.lit(cursor).alias("cursor"), "i", "j")
        out = one if out is None else out.unionByName(one)
    return out


def pair_lookup(spark, d):
    pairs = seeded_pairs(spark, d)
    a = _signatures(spark, d).select(F.col("vec_id").alias("i"), F.col("words").alias("x"))
    b = _signatures(spark, d).select(F.col("vec_id").alias("j"), F.col("words").alias("y"))
    both = pairs.join(a, "i").join(b, "j")
    return both.select("cursor", "i", "j", P.tanimoto(F.col("x"), F.col("y")).alias("similarity"))


def forest_evaluation(spark, d):
    """A forest on embeddings, label 5 or more against the rest, with the metrics of a hash split."""
    vec = _t(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") >= 5).cast("int").alias("target"))
    rows = saved(vec.join(S.random_split(vec, "vec_id", 0), "vec_id"))
    out = M.forest_predictions(rows.filter("split = 'train'"), rows, "vec_id", "embedding", "target")
    return M.classification_metrics(out, ["split"])


QUERIES = {
    f.__name__: f
    for f in (
        normalize_text, status_counts, distinct_text, dedup_keep_first, dedup_mean, dedup_conflict_drop, dedup_multitask_merge, clean_summary, clean_summary_total,
        group_counts, group_top5, concentration, concentration_by_lang, target_counts, greedy_split_quota, greedy_split_posttarget, greedy_split_seeded, split_summary,
        random_split_hash, split_to_index, index_mapping, key_uniqueness, unmatched_rows, duplicate_targets, split_overlap, index_range,
        signature_bits, tanimoto_pairs, neighbor_counts, nearest_pairs_topk, butina_dynamic, butina_static, cluster_summary, butina_split,
        feature_counts, feature_matrix, vocabulary_summary, count_distance_pairs, active_rows, combined_distance, param_grid, sweep_summary,
        classification_metrics, mae_rmse_r2, run_summary, summary_long, pivot_first, delta_vs_baseline, aligned_effect, seeded_pairs, pair_lookup, forest_evaluation,
    )
}
