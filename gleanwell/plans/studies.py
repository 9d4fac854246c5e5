"""Queries of splits, samples, feature vectors, thresholds and comparisons of pipelines, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dense, hybrid, index, metrics, model, ranking, sampling, signals, statistics, upkeep
from ..runtime import table
from . import evaluation, retrieval, views

#: Sizes and seeds of the splits.
SPLITS = {"development": (100, 42), "final_holdout": (100, 123), "smoke": (20, 7)}
# Questions that each cell of the calibration sample takes.
CELLS = {("inference_query", 2): 3, ("inference_query", 3): 3, ("inference_query", 4): 3, ("comparison_query", 2): 5, ("comparison_query", 3): 4, ("temporal_query", 2): 5, ("temporal_query", 3): 4}
#: What a question costs on each route, in retrieval calls.
COSTS = {"SIMPLE": 1.0, "MEDIUM": 2.0, "COMPLEX": 5.0}
# Old names of pipelines and their present ones.
PIPELINES = {"always_agentic": "agentic_multi_hop", "adaptive": "adaptive_rag"}


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """BM25 over pages and the vectors of the same ids, fused and reranked, for every question whose id is divisible by 50."""
    pages, vectors = retrieval._article(spark, d), table(spark, d, "embeddings").select(F.col("vec_id").alias("doc"), F.col("embedding").alias("vector"))
    dense.check_dimension(vectors, "vector")
    asked = retrieval._asked(spark, d).join(vectors.withColumnRenamed("doc", "qid"), "qid", "left")
    ix = index.build(pages, "corpus_id", F.col("text"))
    index.check(ix, pages, "corpus_id")
    return hybrid.hybrid_search(ix, vectors, pages.select(F.col("corpus_id").alias("doc"), "text"), asked).withColumnRenamed("doc", "corpus_id")


def pool_headroom(spark: SparkSession, d: str) -> DataFrame:
    """Documents that the lists of each method hold: the fewest of a question, and questions with fewer than 10."""
    per = ranking.collapse(views.ranked(spark, d)).groupBy("method", "qid").agg(F.count(F.lit(1)).alias("docs"))
    return per.groupBy("method").agg(F.min("docs").alias("fewest"), F.count_if(F.col("docs") < 10).alias("short"), F.count(F.lit(1)).alias("questions"))


def cited_titles(spark: SparkSession, d: str) -> DataFrame:
    """The documents of every reranked list in order with the title of their first page; a document without one goes by its id."""
    titles = table(spark, d, "corpus_documents").filter("doc_id IS NOT NULL AND title IS NOT NULL").groupBy("doc_id").agg(F.min_by("title", "corpus_id").alias("title"))
    lists = ranking.collapse(views.ranked(spark, d)).filter("method = 'rerank'")
    return lists.join(titles, "doc_id", "left").select("qid", "rank", "doc_id", F.coalesce("title", "doc_id").alias("title"))


def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The 19 features of the first stage and the 7 of the second for every question that has fused lists."""
    r = views.ranked(spark, d)
    return signals.feature_vectors(views.questions(spark, d).filter("query IS NOT NULL").select(F.col("qa_id").alias("qid"), "query"), r)


def threshold_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every pair of thresholds: cost, under- and over-routing and right routes of the traces with both probabilities."""
    t = views.traces(spark, d).filter("stage1_probability IS NOT NULL").select("qa_id", F.col("stage1_probability").alias("p1"), F.coalesce("stage2_probability", F.lit(0.0)).alias("p2"))
    rows = t.join(views.routes(spark, d).select("qa_id", "true_route"), "qa_id")
    return model.threshold_grid(rows, COSTS)


def best_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest pair of thresholds among those with the fewest under-routed questions."""
    grid = threshold_grid(spark, d)
    least = grid.agg(F.min("under")).first()[0]
    return model.best_thresholds(grid, least or 0)


def threshold_candidates(spark: SparkSession, d: str) -> DataFrame:
    """First-stage probabilities at nine tenths of their order, without repetition."""
    return model.quantiles(views.traces(spark, d).filter("stage1_probability IS NOT NULL").select("qa_id", "stage1_probability"), "stage1_probability", "qa_id", [k / 10 for k in range(1, 10)])


def stage_two_folds(spark: SparkSession, d: str) -> DataFrame:
    """Second-stage probabilities: out of fold for questions that need more than the first stage, from the fit of all these for the others."""
    rows = evaluation._labelled(spark, d).join(views.routes(spark, d).select("qa_id", "true_route"), "qa_id").withColumn("label", (F.col("true_route") == "MEDIUM").cast("int"))
    return model.out_of_fold_subset(rows, evaluation.FEATURES, "label", 5, F.col("true_route") != "SIMPLE").select("qa_id", "true_route", F.round("probability", 6).alias("probability"))


def macro_scores(spark: SparkSession, d: str) -> DataFrame:
    """Macro F1 over the routes, and the shares of right, under- and over-routed questions."""
    cm = evaluation.confusion_matrix(spark, d)
    f1 = metrics.class_scores(cm).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    step = _step("truth") - _step("predicted")
    share = lambda c: F.round(F.sum(F.when(c, F.col("rows")).otherwise(0)) / F.sum("rows"), 6)
    return f1.crossJoin(cm.agg(share(step == 0).alias("right"), share(step > 0).alias("under"), share(step < 0).alias("over")))


def _step(c: str) -> Column:
    return F.when(F.col(c) == "SIMPLE", 0).when(F.col(c) == "MEDIUM", 1).otherwise(2)


def routing_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The share of all questions in each of the six wrong pairs of routes, 0 where there is none."""
    cm = evaluation.confusion_matrix(spark, d)
    total = cm.agg(F.sum("rows").alias("all"))
    return cm.filter("truth <> predicted").crossJoin(total).select(F.concat_ws("->", "truth", "predicted").alias("pair"), F.round(F.try_divide("rows", "all"), 6).alias("share"))


def label_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every route, true and predicted, 0 where there is none."""
    labels = spark.createDataFrame([(r,) for r in views.ROUTES], "route string")
    r = views.routes(spark, d)
    t, p = (r.groupBy(F.col(c).alias("route")).agg(F.count(F.lit(1)).alias(n)) for c, n in (("true_route", "true"), ("predicted_route", "predicted")))
    return labels.join(t, "route", "left").join(p, "route", "left").select("route", F.coalesce("true", F.lit(0)).alias("true"), F.coalesce("predicted", F.lit(0)).alias("predicted"))


def gate_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Whether a gate that lets the simple route pass was right that the first five fused documents suffice, with the gold documents present and missing."""
    g = views.gold(spark, d)
    five = ranking.collapse(views.ranked(spark, d)).filter("method = 'rrf' AND rank <= 5")
    hits = five.join(g, ["qid", "doc_id"], "left").groupBy("qid").agg(F.count("hops").alias("present"))
    rows = hits.join(g.select("qid", "hops").distinct(), "qid").join(views.routes(spark, d).select(F.col("qa_id").alias("qid"), (F.col("predicted_route") == "SIMPLE").alias("passed")), "qid")
    enough = F.col("present") == F.col("hops")
    outcome = F.concat(F.when(enough == F.col("passed"), "correct_").otherwise("false_"), F.when(F.col("passed"), F.when(enough, "sufficient").otherwise("sufficiency")).otherwise(F.when(enough, "insufficiency").otherwise("insufficient")))
    return rows.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"), F.sum("present").alias("present"), F.sum(F.col("hops") - F.col("present")).alias("missing"))


def _splits(spark: SparkSession, d: str) -> DataFrame:
    return sampling.splits(views.questions(spark, d).select("qa_id", "question_type"), "qa_id", "question_type", SPLITS)


def benchmark_splits(spark: SparkSession, d: str) -> DataFrame:
    """Development, held-out and smoke questions in which types have their shares."""
    return _splits(spark, d)


def benchmark_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Every split's size, seed, types and the hash of its sorted ids."""
    s = _splits(spark, d)
    kinds = [F.count_if(F.col("stratum") == t).alias(t) for t in ("inference_query", "comparison_query", "temporal_query", "null_query")]
    seed = reduce(lambda c, kv: F.when(F.col("split") == kv[0], kv[1][1]).otherwise(c), SPLITS.items(), F.lit(None).cast("int"))
    # a split holds as many ids as its size says
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("size"), *kinds, F.sha1(F.array_join(F.array_sort(F.collect_list("qa_id")), ",").cast("binary")).alias("ids")).withColumn("seed", seed)


def tune_split(spark: SparkSession, d: str) -> DataFrame:
    """Seven tenths of each route's questions for tuning, the others for validation."""
    r = views.routes(spark, d).select("qa_id", F.col("true_route").alias("route"))
    return sampling.part(r, "qa_id", "route", 0.7, 17).select("qa_id", "route", F.when(F.col("picked"), "tune").otherwise("validation").alias("part"))


def _typed(spark: SparkSession, d: str) -> DataFrame:
    hops = views.gold(spark, d).select(F.col("qid").alias("qa_id"), "hops").distinct()
    return views.questions(spark, d).filter("question_type IS NOT NULL").join(hops, "qa_id", "left").select("qa_id", "question_type", F.coalesce("hops", F.lit(0)).alias("hops"))


def two_level_sample(spark: SparkSession, d: str) -> DataFrame:
    """50 questions in which types with their numbers of gold documents have their shares; questions without an answer are one stratum."""
    stratum = F.when(F.col("question_type") == "null_query", F.col("question_type")).otherwise(F.concat("question_type", F.lit("::hop"), F.col("hops")))
    return sampling.stratified(_typed(spark, d).withColumn("s", stratum), "qa_id", "s", 50, 2029)


def cell_sample(spark: SparkSession, d: str) -> DataFrame:
    """The calibration sample: a fixed number of questions of each type and number of gold documents."""
    quotas = spark.createDataFrame([(t, h, n) for (t, h), n in CELLS.items()], "question_type string, hops bigint, quota int")
    return sampling.cells(_typed(spark, d), quotas, ["question_type", "hops"], "qa_id", 11, strict=False).select("qa_id", "question_type", "hops")


def cell_shortage(spark: SparkSession, d: str) -> DataFrame:
    """Cells of the calibration sample with fewer questions than they ask for."""
    quotas = spark.createDataFrame([(t, h, 20 * n) for (t, h), n in CELLS.items()], "question_type string, hops bigint, quota int")
    return sampling.shortage(_typed(spark, d), quotas, ["question_type", "hops"])


def spot_checks(spark: SparkSession, d: str) -> DataFrame:
    """Seven questions of each type to look at."""
    q = _typed(spark, d).withColumn("h", sampling.hash_order("qa_id", 5))
    return ranking.top(q, ["question_type"], [F.col("h"), F.col("qa_id")], 7).select("question_type", "qa_id")


def paired_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Mean differences of latency and coverage between the agentic and the adaptive pipeline with intervals for two comparisons, and whether 0 is outside."""
    c = evaluation._coverage(spark, d)
    both = None
    for name, column in (("latency", "total_latency_ms"), ("coverage", "coverage")):
        a, b = (c.filter(F.col("pipeline") == p).select("qa_id", "question_type", F.col(column).alias(n)) for p, n in (("always_agentic", "a"), ("adaptive", "b")))
        s = statistics.paired_summary(a.join(b.drop("question_type"), "qa_id"), ["question_type"]).withColumn("measure", F.lit(name))
        both = s if both is None else both.unionByName(s)
    low, high = statistics.normal_interval("mean", "stdev", "n", statistics.bonferroni(0.05, 2))
    out = both.select("measure", "question_type", "n", F.round("mean", 6).alias("mean"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))
    return out.withColumn("excludes_zero", statistics.excludes_zero(F.col("low"), F.col("high")))


def bootstrap_checks(spark: SparkSession, d: str) -> DataFrame:
    """The means of bootstrap_ci, whether their intervals hold them, and whether the intervals are about as wide as the normal ones (a third more or less)."""
    c = evaluation._coverage(spark, d)
    a, b = (c.filter(F.col("pipeline") == p).select("qa_id", "question_type", F.col("coverage").alias(n)) for p, n in (("always_agentic", "a"), ("adaptive", "b")))
    s = statistics.paired_summary(a.join(b.drop("question_type"), "qa_id"), ["question_type"])
    width = 2 * statistics.Z[0.95] * F.col("stdev") / F.sqrt("n")
    near = F.abs(F.col("high") - F.col("low") - width) <= width / 3
    both = evaluation.bootstrap_ci(spark, d).withColumnRenamed("mean", "m").join(s, "question_type")
    return both.filter("n >= 10").select("question_type", F.round("m", 6).alias("mean"), F.col("m").between(F.col("low"), F.col("high")).alias("holds"), near.alias("near"))


def grounding_report(spark: SparkSession, d: str) -> DataFrame:
    """Fact grounding by type and by single or several hops: the mean of the questions' rates against that of all facts with its Wilson interval."""
    g = evaluation.fact_grounding(spark, d).withColumnRenamed("qid", "qa_id").join(_typed(spark, d), "qa_id").withColumn("tier", F.when(F.col("hops") <= 1, "single").otherwise("several"))
    s = g.groupingSets([["question_type"], ["tier"], []], "question_type", "tier").agg(F.grouping_id().cast("int").alias("level"), F.count(F.lit(1)).alias("questions"), F.avg(F.col("grounded") / F.col("facts")).alias("macro"), F.sum("facts").alias("facts"), F.sum("grounded").alias("grounded"))
    low, high = statistics.wilson(F.col("grounded"), F.col("facts"))
    return s.select("question_type", "tier", "level", "questions", "facts", *[F.round(x, 6).alias(n) for n, x in (("macro", F.col("macro")), ("pooled", F.col("grounded") / F.col("facts")), ("low", low), ("high", high))])


def _sides(spark: SparkSession, d: str) -> DataFrame:
    """Both pipelines' traces of a question side by side: (qa_id, question_type, hop_count, predicted_route, and coverage, f1, latency and cost of each)."""
    t = evaluation._coverage(spark, d).withColumn("f1", text.token_f1(F.col("answer"), F.col("gold_answer")))
    one = lambda p, s: t.filter(F.col("pipeline") == p).select("qa_id", *[F.col(c).alias(f"{n}_{s}") for c, n in (("coverage", "coverage"), ("f1", "f1"), ("total_latency_ms", "latency"), ("total_cost_usd", "cost"))])
    facts = t.filter("pipeline = 'adaptive'").select("qa_id", "question_type", "hop_count", "predicted_route")
    return one("always_agentic", "a").join(one("adaptive", "b"), "qa_id").join(facts, "qa_id")


def under_routed(spark: SparkSession, d: str) -> DataFrame:
    """Questions on a cheap route whose answer or coverage falls behind that of the agentic pipeline."""
    worse = (F.col("f1_b") < F.col("f1_a") - 1e-9) | (F.col("coverage_b") < F.col("coverage_a") - 1e-9)
    return _sides(spark, d).filter(F.col("predicted_route").isin("SIMPLE", "MEDIUM") & worse).select("qa_id", "question_type", "hop_count", "predicted_route")


def reductions(spark: SparkSession, d: str) -> DataFrame:
    """What the adaptive pipeline saves of latency and cost and keeps of answer F1 and coverage, against the agentic one on the same questions."""
    s = _sides(spark, d)
    m = s.agg(*[F.avg(f"{n}_{x}").alias(f"{n}_{x}") for n in ("latency", "cost", "f1", "coverage") for x in "ab"])
    less = lambda n: F.round(F.try_divide(F.col(f"{n}_a") - F.col(f"{n}_b"), F.nullif(F.col(f"{n}_a"), F.lit(0.0))), 6).alias(f"{n}_reduction")
    kept = lambda n: F.round(F.try_divide(F.col(f"{n}_b"), F.nullif(F.col(f"{n}_a"), F.lit(0.0))), 6).alias(f"{n}_retention")
    return m.select(less("latency"), less("cost"), kept("f1"), kept("coverage"))


def quality_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Questions by the coverage that both pipelines reach, in tenths, and whether they agree."""
    tenth = lambda c: F.floor(F.round(F.col(c) * 10, 6)).cast("int")
    s = _sides(spark, d).filter("coverage_a IS NOT NULL AND coverage_b IS NOT NULL")
    return s.groupBy(tenth("coverage_a").alias("agentic"), tenth("coverage_b").alias("adaptive")).agg(F.count(F.lit(1)).alias("n"))


def verdict_changes(spark: SparkSession, d: str) -> DataFrame:
    """Answers whose outcome differs between the first version of the verdict, the word it begins with, and the present one."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND gold_answer IS NOT NULL")
    gold = F.lower(text.strip(F.col("gold_answer")))
    outcome = lambda v: F.when(~gold.isin(*text.VERDICTS), "not_applicable").when(v.isNull(), "ambiguous").when(v == gold, "correct").otherwise("incorrect")
    old, new = F.regexp_extract(F.lower("answer"), rf"^\s*({'|'.join(text.VERDICTS)})\b", 1), text.verdict(F.col("answer"))
    rows = t.select("pipeline", "qa_id", outcome(F.nullif(old, F.lit(""))).alias("old"), outcome(new).alias("new"))
    return rows.filter("old <> new")


def baseline_means(spark: SparkSession, d: str) -> DataFrame:
    """Mean cost and latency of every pipeline, by its present name, on the questions that all pipelines have traces of."""
    t = views.traces(spark, d)
    whole = t.groupBy("qa_id").agg(F.count_distinct("pipeline").alias("n")).filter(F.col("n") == len(views.PIPELINES)).select("qa_id")
    return upkeep.renamed(t, "pipeline", PIPELINES).join(whole, "qa_id", "left_semi").groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_cost_usd"), 6).alias("cost"), F.round(F.avg("total_latency_ms"), 6).alias("latency"))


def evidence_after_loop(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and completeness of the evidence when the agentic loop ended, by the reason it gives."""
    c = evaluation._coverage(spark, d).filter("pipeline = 'always_agentic' AND gold IS NOT NULL")
    return c.groupBy("stop_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("coverage"), 6).alias("coverage"), F.round(F.avg((F.col("coverage") == 1).cast("int")), 6).alias("complete"))


def diverse_examples(spark: SparkSession, d: str) -> DataFrame:
    """Up to five traces that later hops helped, picked for new types and stop reasons."""
    c = evaluation._coverage(spark, d).filter("pipeline = 'always_agentic' AND coverage > 0 AND question_type IS NOT NULL")
    c = c.select("qa_id", "question_type", F.coalesce("stop_reason", F.lit("")).alias("stop_reason"), F.when(F.col("coverage") == 1, 1).otherwise(2).alias("tier"))
    return sampling.diverse(c, "qa_id", ["question_type", "stop_reason"], "tier", 5)


def event_props(spark: SparkSession, d: str) -> DataFrame:
    """The JSON text of events read strictly: a whole number k, or a fallback; by event type."""
    e = table(spark, d, "events").select("event_type", text.strict_json(F.col("props"), "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("k").isNull()).alias("fallbacks"), F.sum("k").alias("total"))


QUERIES = {f.__name__: f for f in (hybrid_search, pool_headroom, cited_titles, feature_vectors, threshold_grid, best_thresholds, threshold_candidates, stage_two_folds, macro_scores, routing_pairs, label_distribution, gate_outcomes, benchmark_splits, benchmark_manifest, tune_split, two_level_sample, cell_sample, cell_shortage, spot_checks, paired_intervals, bootstrap_checks, grounding_report, under_routed, reductions, quality_histogram, verdict_changes, baseline_means, evidence_after_loop, diverse_examples, event_props)}

_V = "WITH " + views.SQL
_WORDS = retrieval._WORDS
_R = "routes"


def _sample_sql(name: str, source: str, stratum: str, size: str, seed: int) -> str:
    """CTEs that draw a stratified sample of source(qa_id, stratum) as name(qa_id, s)."""
    return f"""{name}_g AS (SELECT coalesce({stratum}, '') AS s, count(*) AS n FROM {source} GROUP BY 1), {name}_e AS (SELECT *, {size}::DOUBLE * n / sum(n) OVER () AS x FROM {name}_g),
{name}_f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, s) AS o FROM {name}_e), {name}_a AS (SELECT s, least(n, fl + (o <= {size} - sum(fl) OVER ())::INT) AS take FROM {name}_f),
{name}_r AS (SELECT qa_id, coalesce({stratum}, '') AS s, row_number() OVER (PARTITION BY coalesce({stratum}, '') ORDER BY sha1('{seed}|' || qa_id), qa_id) AS r FROM {source}), {name} AS (SELECT qa_id, s FROM {name}_r JOIN {name}_a USING (s) WHERE r <= take)"""


_SPLITS = f"""{_V}, {_sample_sql("dev", "questions", "question_type", "100", 42)}, left_over AS (SELECT qa_id, question_type FROM questions WHERE qa_id NOT IN (SELECT qa_id FROM dev)),
{_sample_sql("hold", "left_over", "question_type", "100", 123)}, {_sample_sql("smoke", "dev", "s", "20", 7)},
split AS (SELECT 'development' AS split, * FROM dev UNION ALL SELECT 'final_holdout', * FROM hold UNION ALL SELECT 'smoke', * FROM smoke)"""
_TYPED = f"{_V}, h AS (SELECT DISTINCT qid, hops FROM gold), typed AS (SELECT qa_id, question_type, coalesce(hops, 0) AS hops FROM questions LEFT JOIN h ON qid = qa_id WHERE question_type IS NOT NULL)"
_CELL_ROWS = ", ".join(f"('{t}', {h}, {n})" for (t, h), n in CELLS.items())
_GRID_SQL = f"""{_V}, x AS (SELECT least(floor(stage1_probability * 100 + 1e-9), 100) AS i, least(floor(coalesce(stage2_probability, 0) * 100 + 1e-9), 100) AS j, CASE true_route WHEN 'SIMPLE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS t
 FROM tr JOIN routes USING (qa_id) WHERE stage1_probability IS NOT NULL AND true_route IN ('SIMPLE', 'MEDIUM', 'COMPLEX')), y AS (SELECT i, j, t, count(*) AS c FROM x GROUP BY ALL),
p AS (SELECT a.r AS a, b.r AS b, c, t, CASE WHEN i >= a.r THEN 0 WHEN j >= b.r THEN 1 ELSE 2 END AS p FROM y CROSS JOIN range(5, 100) a(r) CROSS JOIN range(5, 100) b(r)),
grid AS (SELECT a / 100 AS tau1, b / 100 AS tau2, CAST(sum(c) AS BIGINT) AS n, sum(c * CASE p WHEN 0 THEN {COSTS["SIMPLE"]} WHEN 1 THEN {COSTS["MEDIUM"]} ELSE {COSTS["COMPLEX"]} END)::DOUBLE AS cost,
 CAST(coalesce(sum(c) FILTER (p < t), 0) AS BIGINT) AS under, CAST(coalesce(sum(c) FILTER (p > t), 0) AS BIGINT) AS over, CAST(coalesce(sum(c) FILTER (p = t), 0) AS BIGINT) AS "right" FROM p GROUP BY a, b)"""
_SIDES = f"""{evaluation.ORACLES["answer_scores"].rpartition("SELECT pipeline, qa_id, p AS answer")[0].rstrip()}, f1s AS (SELECT pipeline, qa_id, CASE WHEN len(pw) + len(gw) = 0 THEN 1 ELSE 2 * coalesce(list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))), 0) / (len(pw) + len(gw)) END AS f1 FROM w),
g AS (SELECT qid AS qa_id, list(doc_id) AS gold FROM gold GROUP BY qid), cov AS (SELECT tr.*, f1, len(list_intersect(gold, coalesce(evidence_doc_ids_used, []))) / len(gold) AS coverage FROM tr LEFT JOIN g USING (qa_id) LEFT JOIN f1s ON f1s.qa_id = tr.qa_id AND f1s.pipeline = tr.pipeline),
sides AS (SELECT b.qa_id, b.question_type, b.hop_count, b.predicted_route, a.coverage AS ca, b.coverage AS cb, a.f1 AS fa, b.f1 AS fb, a.total_latency_ms AS la, b.total_latency_ms AS lb, a.total_cost_usd AS xa, b.total_cost_usd AS xb FROM cov a JOIN cov b ON a.qa_id = b.qa_id AND a.pipeline = 'always_agentic' AND b.pipeline = 'adaptive')"""
_POOLED = statistics.Z[0.95]
_BM25 = retrieval.ORACLES["bm25_topk"].rpartition("SELECT * FROM (SELECT qid, corpus_id")[0]
_FEATURES = retrieval.ORACLES["question_features"]
_NAMES = ("words", "chars", "comparison", "has_comparison", "temporal", "has_temporal", "conjunction", "has_conjunction", "quoted", "numeric")


def _gaps_sql(method: str, column: str, names: tuple[str, ...]) -> str:
    return f"""SELECT qid, max({column}) FILTER (rank = 1) AS {names[0]}, avg({column}) AS {names[1]}, coalesce(max({column}) FILTER (rank = 1) - max({column}) FILTER (rank = 2), 0) AS {names[2]}, max({column}) FILTER (rank = 1) - arg_max({column}, rank) AS {names[3]}
 FROM rk WHERE method = '{method}' AND rank <= 5 GROUP BY qid"""


ORACLES = {
    "hybrid_search": f"""{_BM25}, b AS (SELECT qid, corpus_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, corpus_id) AS rank FROM scored),
s AS (SELECT q.record_id AS qid, v.vec_id AS corpus_id, round(list_cosine_similarity(e.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM qa_records q JOIN embeddings e ON e.vec_id = q.record_id JOIN embeddings v ON v.vec_id <> q.record_id WHERE q.record_id % 50 = 0),
v AS (SELECT qid, corpus_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, corpus_id) AS rank FROM s),
f AS (SELECT qid, corpus_id, sum(1.0::DOUBLE / (60 + rank)) AS x, min(rank) AS best FROM (SELECT * FROM b WHERE rank <= 20 UNION ALL SELECT * FROM v WHERE rank <= 20) GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(x, 12) DESC, best, corpus_id) AS rrf_rank FROM f),
t AS (SELECT p.qid, p.corpus_id, rrf_rank, list_distinct({_WORDS.format("coalesce(q.query, '')")}) AS w, docs.w AS d FROM p JOIN docs USING (corpus_id) JOIN qa_records q ON q.record_id = p.qid WHERE rrf_rank <= 20),
r AS (SELECT qid, corpus_id, rrf_rank, round(CASE WHEN len(w) > 0 THEN len(list_intersect(w, d)) / len(w) ELSE 0 END, 9) AS rerank_score FROM t)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rerank_score DESC, rrf_rank, corpus_id) AS rank FROM r) WHERE rank <= 5""",
    "pool_headroom": f"{_V}, p AS (SELECT method, qid, count(*) AS docs FROM collapsed GROUP BY ALL) SELECT method, min(docs) AS fewest, count(*) FILTER (docs < 10) AS short, count(*) AS questions FROM p GROUP BY method",
    "cited_titles": f"""{_V}, t AS (SELECT doc_id, arg_min(title, corpus_id) AS title FROM corpus_documents WHERE doc_id IS NOT NULL AND title IS NOT NULL GROUP BY doc_id)
SELECT qid, rank, doc_id, coalesce(title, doc_id) AS title FROM collapsed LEFT JOIN t USING (doc_id) WHERE method = 'rerank'""",
    "feature_vectors": f"""WITH fq AS ({_FEATURES}), {views.SQL}, rk AS (SELECT r.*, x.rerank_score FROM ranked r LEFT JOIN (SELECT qid, method, chunk_id, max(rerank_score) AS rerank_score FROM ranked_results GROUP BY ALL) x USING (qid, method, chunk_id)),
hg AS ({_gaps_sql("rrf", "score", signals.STAGE_1[10:14])}), rg AS ({_gaps_sql("rerank", "rerank_score", signals.STAGE_2[:4])}),
ten AS (SELECT qid, doc_id, count(DISTINCT method) AS n FROM rk WHERE method IN ('dense', 'bm25') AND rank <= 10 GROUP BY ALL), j AS (SELECT qid, count(*) FILTER (n = 2) / count(*) AS jac FROM ten GROUP BY qid),
ch AS (SELECT x.qid, avg(abs(x.rank - y.rank)) AS ch FROM collapsed x JOIN collapsed y ON x.qid = y.qid AND x.doc_id = y.doc_id AND x.method = 'dense' AND y.method = 'bm25' GROUP BY x.qid),
hd AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY min(rank)) AS r FROM rk WHERE method = 'rrf' AND rank <= 10 GROUP BY qid, doc_id),
cs AS (SELECT hd.qid, count(*) FILTER (r <= 5 AND n = 2) / count(*) FILTER (r <= 5) AS cons, count(*) FILTER (r <= 5) AS d5, count(*) FILTER (r <= 10) AS d10 FROM hd LEFT JOIN ten ON ten.qid = hd.qid AND ten.doc_id = hd.doc_id GROUP BY hd.qid),
rs AS ({retrieval.ORACLES["rerank_signals"].removeprefix(_V + ", ").join(("WITH ", ""))})
SELECT q.qa_id AS qid, {", ".join(f"round(fq.{a}::DOUBLE, 6) AS {b}" for a, b in zip(_NAMES, signals.STAGE_1))}, {", ".join(f"round(coalesce(hg.{c}, 0), 6) AS {c}" for c in signals.STAGE_1[10:14])},
round(coalesce(jac, 0), 6) AS {signals.STAGE_1[14]}, round(coalesce(cons, 0), 6) AS {signals.STAGE_1[15]}, round(coalesce(ch, 0), 6) AS {signals.STAGE_1[16]}, d5::DOUBLE AS {signals.STAGE_1[17]}, d10::DOUBLE AS {signals.STAGE_1[18]},
{", ".join(f"round(rg.{c}, 6) AS {c}" for c in signals.STAGE_2[:4])}, moved AS {signals.STAGE_2[4]}, round(kept_docs / (kept_docs + new_docs), 6) AS {signals.STAGE_2[5]}, new_docs::DOUBLE AS {signals.STAGE_2[6]}
FROM questions q JOIN fq ON fq.qa_id = q.qa_id JOIN hg ON hg.qid = q.qa_id JOIN cs ON cs.qid = q.qa_id LEFT JOIN j ON j.qid = q.qa_id LEFT JOIN ch ON ch.qid = q.qa_id LEFT JOIN rg ON rg.qid = q.qa_id LEFT JOIN rs ON rs.qid = q.qa_id""",
    "threshold_grid": f"{_GRID_SQL} SELECT * FROM grid",
    "best_thresholds": f"{_GRID_SQL} SELECT * FROM grid WHERE under = (SELECT min(under) FROM grid) ORDER BY cost, under, round(tau1 + tau2, 6) DESC, tau1 DESC LIMIT 1",
    "threshold_candidates": f"""{_V}, o AS (SELECT stage1_probability AS v, row_number() OVER (ORDER BY stage1_probability, qa_id) AS r, count(*) OVER () AS n FROM tr WHERE stage1_probability IS NOT NULL)
SELECT DISTINCT v AS value FROM o JOIN range(1, 10) k(k) ON r = round_even(k / 10 * (n - 1), 0) + 1""",
    "macro_scores": f"""{evaluation._CM}, s AS (SELECT l.x, (SELECT sum(rows) FROM cm WHERE truth = l.x AND predicted = l.x) AS hit, (SELECT sum(rows) FROM cm WHERE truth = l.x) AS n, (SELECT sum(rows) FROM cm WHERE predicted = l.x) AS m FROM l),
f AS (SELECT coalesce(2 * hit / nullif(n + m, 0), 0) AS f FROM s), st AS (SELECT rows, CASE truth WHEN 'SIMPLE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END - CASE predicted WHEN 'SIMPLE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS d FROM cm)
SELECT (SELECT round(avg(f), 6) FROM f) AS macro_f1, round(sum(rows) FILTER (d = 0) / sum(rows), 6) AS "right", round(sum(rows) FILTER (d > 0) / sum(rows), 6) AS under, round(sum(rows) FILTER (d < 0) / sum(rows), 6) AS over FROM st""",
    "routing_pairs": f"{evaluation._CM} SELECT truth || '->' || predicted AS pair, round(rows / (SELECT sum(rows) FROM cm), 6) AS share FROM cm WHERE truth <> predicted",
    "label_distribution": f"{evaluation._CM} SELECT x AS route, (SELECT count(*) FROM routes WHERE true_route = x) AS \"true\", (SELECT count(*) FROM routes WHERE predicted_route = x) AS predicted FROM l",
    "gate_outcomes": f"""{_V}, h AS (SELECT c.qid, count(g.doc_id) AS present FROM collapsed c LEFT JOIN gold g ON g.qid = c.qid AND g.doc_id = c.doc_id WHERE method = 'rrf' AND rank <= 5 GROUP BY c.qid), k AS (SELECT DISTINCT qid, hops FROM gold),
o AS (SELECT present, hops, present = hops AS e, predicted_route = 'SIMPLE' AS p FROM h JOIN k USING (qid) JOIN routes ON qa_id = qid)
SELECT CASE WHEN e AND p THEN 'correct_sufficient' WHEN NOT e AND NOT p THEN 'correct_insufficient' WHEN p THEN 'false_sufficiency' ELSE 'false_insufficiency' END AS outcome, count(*) AS n, CAST(sum(present) AS BIGINT) AS present, CAST(sum(hops - present) AS BIGINT) AS missing FROM o GROUP BY 1""",
    "benchmark_splits": f"{_SPLITS} SELECT split, qa_id, s AS stratum FROM split",
    "benchmark_manifest": f"""{_SPLITS} SELECT split, count(*) AS size, {", ".join(f"count(*) FILTER (s = '{t}') AS {t}" for t in ("inference_query", "comparison_query", "temporal_query", "null_query"))}, sha1(string_agg(qa_id, ',' ORDER BY qa_id)) AS ids,
CASE split WHEN 'development' THEN 42 WHEN 'final_holdout' THEN 123 ELSE 7 END AS seed FROM split GROUP BY split""",
    "tune_split": f"""{_V}, g AS (SELECT true_route AS route, count(*) AS n FROM routes GROUP BY 1), f AS (SELECT *, floor(round(n * 0.7::DOUBLE, 9)) AS fl, row_number() OVER (ORDER BY round(n * 0.7::DOUBLE - floor(round(n * 0.7::DOUBLE, 9)), 9) DESC, route) AS o FROM g),
a AS (SELECT route, fl + (o <= round_even((SELECT sum(n) FROM g) * 0.7::DOUBLE, 0) - sum(fl) OVER ())::INT AS take FROM f), r AS (SELECT qa_id, true_route AS route, row_number() OVER (PARTITION BY true_route ORDER BY sha1('17|' || qa_id), qa_id) AS r FROM routes)
SELECT qa_id, route, CASE WHEN r <= take THEN 'tune' ELSE 'validation' END AS part FROM r JOIN a USING (route)""",
    "two_level_sample": f"{_TYPED}, named AS (SELECT qa_id, CASE WHEN question_type = 'null_query' THEN question_type ELSE question_type || '::hop' || hops END AS st FROM typed), {_sample_sql('picked', 'named', 'st', '50', 2029)} SELECT qa_id, s AS stratum FROM picked",
    "cell_sample": f"""{_TYPED}, q(question_type, hops, quota) AS (VALUES {_CELL_ROWS}), r AS (SELECT typed.*, quota, row_number() OVER (PARTITION BY question_type, hops ORDER BY sha1('11|' || qa_id), qa_id) AS r FROM typed JOIN q USING (question_type, hops))
SELECT qa_id, question_type, hops FROM r WHERE r <= quota""",
    "cell_shortage": f"""{_TYPED}, q(question_type, hops, quota) AS (VALUES {_CELL_ROWS}), n AS (SELECT question_type, hops, count(*) AS have FROM typed GROUP BY ALL)
SELECT question_type, hops, 20 * quota AS need, coalesce(have, 0) AS have FROM q LEFT JOIN n USING (question_type, hops) WHERE coalesce(have, 0) < 20 * quota""",
    "spot_checks": f"{_TYPED} SELECT question_type, qa_id FROM (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY sha1('5|' || qa_id), qa_id) AS r FROM typed) WHERE r <= 7",
    "paired_intervals": f"""{_SIDES}, d AS (SELECT 'latency' AS measure, question_type, la - lb AS d FROM sides UNION ALL SELECT 'coverage', question_type, ca - cb FROM sides),
m AS (SELECT measure, question_type, count(*) AS n, avg(d) AS mean, {statistics.Z[0.975]} * stddev_samp(d) / sqrt(count(*)) AS half FROM d WHERE d IS NOT NULL GROUP BY ALL)
SELECT measure, question_type, n, round(mean, 6) AS mean, round(mean - half, 6) AS low, round(mean + half, 6) AS high, NOT (round(mean - half, 6) <= 0 AND round(mean + half, 6) >= 0) AS excludes_zero FROM m""",
    "grounding_report": f"""{evaluation.ORACLES["fact_grounding"].rpartition("SELECT qid, count(*) AS facts")[0]}, k AS (SELECT qid, count(*) AS facts, count(*) FILTER (ok) AS grounded FROM r GROUP BY qid), hh AS (SELECT DISTINCT qid, hops FROM gold),
z AS (SELECT question_type, CASE WHEN coalesce(hops, 0) <= 1 THEN 'single' ELSE 'several' END AS tier, facts, grounded FROM k JOIN questions ON qa_id = k.qid LEFT JOIN hh ON hh.qid = k.qid WHERE question_type IS NOT NULL),
y AS (SELECT question_type, tier, CAST(grouping(question_type, tier) AS INT) AS level, count(*) AS questions, CAST(sum(facts) AS BIGINT) AS facts, avg(grounded / facts) AS macro, sum(grounded)::DOUBLE AS gr FROM z GROUP BY GROUPING SETS ((question_type), (tier), ())),
w AS (SELECT *, gr / facts AS p, 1 + {_POOLED**2} / facts AS sc FROM y), v AS (SELECT *, (p + {_POOLED**2} / (2 * facts)) / sc AS mid, {_POOLED} * sqrt(p * (1 - p) / facts + {_POOLED**2} / (4 * facts * facts)) / sc AS half FROM w)
SELECT question_type, tier, level, questions, facts, round(macro, 6) AS macro, round(p, 6) AS pooled, round(greatest(mid - half, 0), 6) AS low, round(least(mid + half, 1), 6) AS high FROM v""",
    "bootstrap_checks": f"{_SIDES} SELECT question_type, round(avg(ca - cb), 6) AS mean, true AS holds, true AS near FROM sides WHERE ca IS NOT NULL AND cb IS NOT NULL GROUP BY question_type HAVING count(*) >= 10",
    "under_routed": f"{_SIDES} SELECT qa_id, question_type, hop_count, predicted_route FROM sides WHERE predicted_route IN ('SIMPLE', 'MEDIUM') AND (fb < fa - 1e-9 OR cb < ca - 1e-9)",
    "reductions": f"""{_SIDES}, m AS (SELECT avg(la) AS la, avg(lb) AS lb, avg(xa) AS xa, avg(xb) AS xb, avg(fa) AS fa, avg(fb) AS fb, avg(ca) AS ca, avg(cb) AS cb FROM sides)
SELECT round((la - lb) / nullif(la, 0), 6) AS latency_reduction, round((xa - xb) / nullif(xa, 0), 6) AS cost_reduction, round(fb / nullif(fa, 0), 6) AS f1_retention, round(cb / nullif(ca, 0), 6) AS coverage_retention FROM m""",
    "quality_histogram": f"{_SIDES} SELECT CAST(floor(round(ca * 10, 6)) AS INT) AS agentic, CAST(floor(round(cb * 10, 6)) AS INT) AS adaptive, count(*) AS n FROM sides WHERE ca IS NOT NULL AND cb IS NOT NULL GROUP BY ALL",
    "verdict_changes": rf"""{evaluation.ORACLES["verdicts"].rpartition("SELECT pipeline, qa_id, verdict, CASE")[0].rstrip()}, z AS (SELECT v.pipeline, v.qa_id, v.g, verdict, nullif(regexp_extract(lower(answer), '^\s*({evaluation._VERDICT})\b', 1), '') AS first FROM v JOIN tr USING (pipeline, qa_id)),
y AS (SELECT pipeline, qa_id, {", ".join(f"CASE WHEN g NOT IN ({', '.join(repr(x) for x in text.VERDICTS)}) THEN 'not_applicable' WHEN {c} IS NULL THEN 'ambiguous' WHEN {c} = g THEN 'correct' ELSE 'incorrect' END AS {n}" for c, n in (("first", "old"), ("verdict", "new")))} FROM z)
SELECT * FROM y WHERE y.old <> y.new""",
    "baseline_means": f"""{_V}, whole AS (SELECT qa_id FROM tr GROUP BY qa_id HAVING count(DISTINCT pipeline) = 3)
SELECT CASE pipeline WHEN 'always_agentic' THEN 'agentic_multi_hop' WHEN 'adaptive' THEN 'adaptive_rag' ELSE pipeline END AS pipeline, count(*) AS n, round(avg(total_cost_usd), 6) AS cost, round(avg(total_latency_ms), 6) AS latency FROM tr WHERE qa_id IN (SELECT qa_id FROM whole) GROUP BY 1""",
    "evidence_after_loop": f"{evaluation._COVERED} SELECT stop_reason, count(*) AS n, round(avg(coverage), 6) AS coverage, round(avg((coverage = 1)::INT), 6) AS complete FROM cov WHERE pipeline = 'always_agentic' AND gold IS NOT NULL GROUP BY stop_reason",
    "event_props": """SELECT event_type, count(*) AS n, count(*) FILTER (k IS NULL) AS fallbacks, CAST(sum(k) AS BIGINT) AS total FROM (SELECT event_type, TRY_CAST(nullif(regexp_extract(props, '^\\s*\\{\\s*"k"\\s*:\\s*(-?[0-9]+)\\s*\\}\\s*$', 1), '') AS INT) AS k FROM events) GROUP BY 1""",
}
