"""Queries of answer scoring, routing, statistics, sampling and upkeep, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import chunking, facts, metrics, model, ranking, sampling, statistics, upkeep
from ..runtime import materialise, spread, table
from ..streaming import rate_limit
from . import views

_R6 = lambda *names: [F.round(n, 6).alias(n) for n in names]


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Mean, median and 95th percentile of the total latency by pipeline."""
    rows = views.traces(spark, d).filter("total_latency_ms IS NOT NULL")
    return rows.groupBy("pipeline").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("total_latency_ms"), 6).alias("mean"), metrics.nearest_rank("total_latency_ms", 0.5).alias("p50"), metrics.nearest_rank("total_latency_ms", 0.95).alias("p95"))


def _coverage(spark: SparkSession, d: str) -> DataFrame:
    g = views.gold(spark, d).groupBy(F.col("qid").alias("qa_id")).agg(F.collect_set("doc_id").alias("gold"))
    t = views.traces(spark, d).join(g, "qa_id", "left")
    return t.withColumn("coverage", F.size(F.array_intersect("gold", F.coalesce("evidence_doc_ids_used", F.array().cast("array<string>")))) / F.size("gold"))


def evidence_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of gold documents that each trace used; null without gold."""
    return _coverage(spark, d).select("pipeline", "qa_id", F.round("coverage", 6).alias("coverage"))


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Exact match and token F1 of every trace."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND gold_answer IS NOT NULL")
    em = (text.normal_answer(F.col("answer")) == text.normal_answer(F.col("gold_answer"))).cast("int")
    return t.select("pipeline", "qa_id", text.normal_answer(F.col("answer")).alias("answer"), em.alias("em"), F.round(text.token_f1(F.col("answer"), F.col("gold_answer")), 6).alias("f1"))


def abstention(spark: SparkSession, d: str) -> DataFrame:
    """Refusals against questions that have no answer, by pipeline, with the Wilson interval of the right ones."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND question_type IS NOT NULL")
    null, said = F.col("question_type") == "null_query", text.abstains(F.col("answer"))
    g = t.groupBy("pipeline").agg(
        F.count_if(null & said).alias("right_refusal"), F.count_if(~null & said).alias("wrong_refusal"),
        F.count_if(null & ~said).alias("missed_refusal"), F.count_if(~null & ~said).alias("answered"),
    )
    low, high = statistics.wilson(F.col("right_refusal"), F.col("right_refusal") + F.col("missed_refusal"))
    return g.select("*", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """The verdict each answer commits to, and whether it is the gold one."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND gold_answer IS NOT NULL")
    gold = F.lower(text.strip(F.col("gold_answer")))
    v = text.verdict(F.col("answer"))
    outcome = F.when(~gold.isin(*text.VERDICTS), "not_applicable").when(v.isNull(), "ambiguous").when(v == gold, "correct").otherwise("incorrect")
    return t.select("pipeline", "qa_id", v.alias("verdict"), outcome.alias("outcome"))


def response_structure(spark: SparkSession, d: str) -> DataFrame:
    """Whether answers state something, decline or do both, by pipeline."""
    t = views.traces(spark, d).filter("answer IS NOT NULL")
    return t.groupBy("pipeline", text.response_structure(F.col("answer")).alias("structure")).agg(F.count(F.lit(1)).alias("n"))


def evidence_routes(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest list whose first five documents hold all gold documents of a question: fused, reranked, or neither."""
    lists = ranking.collapse(views.ranked(spark, d)).filter(F.col("method").isin("rrf", "rerank"))
    g = views.gold(spark, d)
    hits = lists.filter(F.col("rank") <= 5).join(g, ["qid", "doc_id"]).groupBy("qid", "method").agg((F.count(F.lit(1)) == F.first("hops")).alias("whole"))
    asked = lists.select("qid").distinct().join(g.select("qid", "hops").distinct(), "qid")
    best = hits.filter("whole").groupBy("qid").agg(F.max(F.col("method") == "rrf").alias("fused"))
    route = F.when(F.col("fused"), "SIMPLE").when(F.col("fused").isNotNull(), "MEDIUM").otherwise("COMPLEX")
    return asked.join(best, "qid", "left").select("qid", F.col("hops").alias("hop_count"), route.alias("route"))


def shortest_questions(spark: SparkSession, d: str) -> DataFrame:
    """The shortest question of every type."""
    q = views.questions(spark, d).filter("query IS NOT NULL AND question_type IS NOT NULL")
    return q.groupBy("question_type").agg(F.min_by("query", F.struct(F.length("query"), "qa_id")).alias("query"))


def entity_containment(spark: SparkSession, d: str) -> DataFrame:
    """Whether answers to inference questions hold the gold entity."""
    t = views.traces(spark, d).filter("question_type = 'inference_query' AND answer IS NOT NULL AND gold_answer IS NOT NULL")
    return t.select("pipeline", "qa_id", text.entity_in(F.col("gold_answer"), F.col("answer")).alias("holds"))


def unsupported(spark: SparkSession, d: str) -> DataFrame:
    """Answers graded right though none of their gold documents was used, by pipeline and type; unknown where grade or coverage is."""
    grades = table(spark, d, "judge_scores").groupBy("qa_id").agg(F.max_by("grade", F.struct("score", "grade")).alias("grade"))
    t = _coverage(spark, d).join(grades, "qa_id", "left")
    flag = F.when(F.col("grade").isNull() | F.col("coverage").isNull(), None).when(~F.col("grade").isin("correct", "partially_correct"), F.lit(False)).otherwise(F.col("coverage") == 0)
    return t.groupBy("pipeline", "question_type").agg(F.count_if(flag).alias("unsupported"), F.count_if(~flag).alias("supported"), F.count_if(flag.isNull()).alias("unknown"))


def _grades(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "judge_scores").groupBy("qa_id").agg(F.max_by(F.struct("grade", "score"), F.struct("score", "grade")).alias("j"))
    return scores.select("qa_id", F.col("j.grade").alias("grade"), F.col("j.score").alias("score"))


def task_success(spark: SparkSession, d: str) -> DataFrame:
    """What can be said of answers without a judge, by pipeline and type, and how often the judge agrees."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND gold_answer IS NOT NULL AND question_type IS NOT NULL").join(_grades(spark, d), "qa_id", "left")
    gold, said = F.lower(text.strip(F.col("gold_answer"))), text.verdict(F.col("answer"))
    plain = ~text.abstains(F.col("answer")) & (F.col("question_type") != "null_query")
    judged = plain & F.col("question_type").isin("comparison_query", "temporal_query") & gold.isin(*text.VERDICTS) & said.isNotNull()
    t = t.withColumn("plain", plain).withColumn("right", F.when(judged, said == gold))
    agree = F.when(F.col("right"), F.col("grade") == "correct").when(~F.col("right"), F.col("grade") == "incorrect")
    return t.groupBy("pipeline", "question_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("plain") | F.col("right").isNotNull()).alias("confident"),
        F.count_if("right").alias("correct"), F.count_if(agree).alias("agree"), F.count_if(~agree).alias("disagree"),
    )


def combined_quality(spark: SparkSession, d: str) -> DataFrame:
    """Mean quality by pipeline: refusal for questions without an answer, the judge's score for the others; unjudged ones are left out."""
    t = views.traces(spark, d).filter("answer IS NOT NULL AND question_type IS NOT NULL").join(_grades(spark, d), "qa_id", "left")
    q = F.when(F.col("question_type") == "null_query", text.abstains(F.col("answer")).cast("double")).otherwise(F.col("score"))
    return t.groupBy("pipeline").agg(F.count(q).alias("n"), F.round(F.avg(q), 6).alias("quality"))


def _facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    pages = spread(table(spark, d, "corpus_documents").select("corpus_id", "url", "body"), "corpus_id")
    return facts.evidence(views.questions(spark, d)), pages.select(text.doc_id(F.col("url")).alias("doc_id"), F.col("body").alias("text"))


def fact_grounding(spark: SparkSession, d: str) -> DataFrame:
    """Facts of every question that its pages hold word for word."""
    g = facts.grounded(*_facts(spark, d)).groupBy("qid").agg(F.count(F.lit(1)).alias("facts"), F.count_if("grounded").alias("grounded"))
    return g.withColumn("rate", F.round(F.col("grounded") / F.col("facts"), 6))


def fact_survival(spark: SparkSession, d: str) -> DataFrame:
    """Whether facts stand in one paragraph, across two or nowhere, to the letter."""
    f, pages = _facts(spark, d)
    return facts.survival(f, pages.select("doc_id", chunking.paragraphs(F.col("text"), "\n").alias("parts"))).groupBy("place").agg(F.count(F.lit(1)).alias("facts"))


def fact_survival_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Whether facts stand in one chunk, across two or nowhere, to the letter."""
    f, pages = _facts(spark, d)
    packed = chunking.pack(chunking.units(F.col("text"), 160, "\n"), 120, 160, 20)
    parts = F.transform(packed, lambda us: F.array_join(F.transform(us, lambda u: u["text"]), "\n"))
    return facts.survival(f, pages.select("doc_id", parts.alias("parts"))).groupBy("place").agg(F.count(F.lit(1)).alias("facts"))


def judge_parse(spark: SparkSession, d: str) -> DataFrame:
    """Raw texts of a judge read strictly: its grades as JSON, one in each four with the brace doubled or text behind it, fallbacks as plain text."""
    first = F.substring("qa_id", 1, 1)
    whole = F.to_json(F.struct("grade", "reason"))
    raw = F.when(F.col("fallback_used"), F.concat(F.lit("grade: "), F.col("grade"))).when(first.isin("0", "1", "2", "3"), F.concat(F.lit("{"), whole)).when(first.isin("c", "d", "e", "f"), F.concat(whole, F.lit(" ok"))).otherwise(whole)
    said = text.parse_judge(raw)
    return table(spark, d, "judge_scores").select("qa_id", said.alias("j")).select("qa_id", "j.grade", "j.score", F.col("j.fallback").cast("int").alias("fallback"))


def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    """True and predicted routes."""
    return metrics.confusion(views.routes(spark, d), "true_route", "predicted_route", views.ROUTES)


def class_scores(spark: SparkSession, d: str) -> DataFrame:
    """Precision, recall, F1 and support of every route."""
    s = metrics.class_scores(confusion_matrix(spark, d))
    return s.select("label", *_R6("precision", "recall", "f1"), "support")


def route_order(spark: SparkSession, d: str) -> DataFrame:
    """How often a route is right, too cheap or too dear, by number of hops."""
    rank = lambda c: F.when(F.col(c) == "SIMPLE", 0).when(F.col(c) == "MEDIUM", 1).otherwise(2)
    r = views.routes(spark, d).withColumn("step", rank("true_route") - rank("predicted_route"))
    return r.groupBy("hop_count").agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((c).cast("int")), 6).alias(n) for n, c in (("right", F.col("step") == 0), ("under", F.col("step") > 0), ("over", F.col("step") < 0))])


def threshold_curve(spark: SparkSession, d: str) -> DataFrame:
    """Questions that each threshold of the first-stage probability keeps, and those of them with a simple true route."""
    t = views.traces(spark, d).filter("stage1_probability IS NOT NULL").select("qa_id", "stage1_probability")
    rows = t.join(views.routes(spark, d).select("qa_id", (F.col("true_route") == "SIMPLE").cast("int").alias("simple")), "qa_id")
    return model.threshold_curve(rows, "stage1_probability", "simple")


FEATURES = ("words", "chars", "comparison", "temporal", "conjunction", "quoted", "numeric")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    q = views.questions(spark, d).filter("query IS NOT NULL").select("qa_id", *[c.cast("double").alias(n) for n, c in text.query_features(F.col("query")).items() if n in FEATURES])
    rows = views.routes(spark, d).select("qa_id", (F.col("true_route") == "SIMPLE").cast("int").alias("label")).join(q, "qa_id")
    return rows.join(sampling.folds(rows, "qa_id", "label", 5, 42).select("qa_id", "fold"), "qa_id")


def fold_assignment(spark: SparkSession, d: str) -> DataFrame:
    """Stratified folds of the routed questions."""
    rows = views.routes(spark, d).select("qa_id", (F.col("true_route") == "SIMPLE").cast("int").alias("label"))
    return sampling.folds(rows, "qa_id", "label", 5, 42)


def router_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Features by the weight that a logistic model gives them for simple questions."""
    m = model.fit(_labelled(spark, d), FEATURES, "label")
    rows = [(n, float(mu), float(s), float(c), m.intercept) for n, mu, s, c in zip(m.names, m.mean, m.scale, m.coef, strict=True)]
    return spark.createDataFrame(rows, "feature string, mean double, scale double, coefficient double, intercept double").orderBy(F.desc(F.abs("coefficient")), "feature")


def router_probabilities(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold probabilities of being simple."""
    rows = materialise(_labelled(spark, d), "labelled")
    return model.out_of_fold(rows, FEATURES, "label", 5).select("qa_id", "fold", "label", F.round("probability", 6).alias("probability"))


def paired_delta(spark: SparkSession, d: str) -> DataFrame:
    """Latency of the agentic against the adaptive pipeline on the same questions, by type."""
    t = views.traces(spark, d)
    a, b = (t.filter(F.col("pipeline") == p).select("qa_id", "question_type", F.col("total_latency_ms").alias(n)) for p, n in (("always_agentic", "a"), ("adaptive", "b")))
    s = statistics.paired_summary(a.join(b.drop("question_type"), "qa_id"), ["question_type"])
    return s.select("question_type", "n", *_R6("mean", "median", "stdev", "effect"))


def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean difference of coverage between the agentic and the adaptive pipeline, by type."""
    c = _coverage(spark, d)
    a, b = (c.filter(F.col("pipeline") == p).select("qa_id", "question_type", F.col("coverage").alias(n)) for p, n in (("always_agentic", "a"), ("adaptive", "b")))
    return statistics.bootstrap(a.join(b.drop("question_type"), "qa_id").withColumnRenamed("qa_id", "id"), "question_type")


def hop_tiers(spark: SparkSession, d: str) -> DataFrame:
    """What traces of several retrieval calls add over the single-pass pipeline on the same question: gold documents it lacked."""
    c = _coverage(spark, d).filter("gold IS NOT NULL")
    base = c.filter("pipeline = 'hybrid_reranker'").select("qa_id", F.col("evidence_doc_ids_used").alias("base"))
    more = c.filter("pipeline = 'always_agentic'").join(base, "qa_id")
    empty = F.array().cast("array<string>")
    added = F.array_intersect(F.array_except(F.coalesce("evidence_doc_ids_used", empty), F.coalesce("base", empty)), F.col("gold"))
    tier = F.when((F.size(added) > 0) & (F.col("coverage") == 1), "completed").when(F.size(added) > 0, "added").otherwise("none")
    return more.groupBy("hop_count", tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size(added)).alias("documents"))


def replay_overlap(spark: SparkSession, d: str) -> DataFrame:
    """How the documents two pipelines used for a question overlap."""
    t = views.traces(spark, d).withColumn("docs", F.coalesce("evidence_doc_ids_used", F.array().cast("array<string>")))
    a, b = (t.filter(F.col("pipeline") == p).select("qa_id", F.array_sort(F.array_distinct("docs")).alias(n)) for p, n in (("always_agentic", "a"), ("adaptive", "b")))
    kind = F.when(F.col("a") == F.col("b"), "exact").when(F.arrays_overlap("a", "b"), "partial").otherwise("none")
    return a.join(b, "qa_id").groupBy(kind.alias("overlap")).agg(F.count(F.lit(1)).alias("n"))


def allocation(spark: SparkSession, d: str) -> DataFrame:
    """100 questions shared out over question types by largest remainders."""
    q = views.questions(spark, d)
    return sampling.allocate(q.groupBy(F.coalesce("question_type", F.lit("")).alias("stratum")).agg(F.count(F.lit(1)).alias("n")), 100)


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 questions in which question types have their shares."""
    return sampling.stratified(views.questions(spark, d), "qa_id", "question_type", 100, 2029)


def manifest_checks(spark: SparkSession, d: str) -> DataFrame:
    """Every split of every release: ids, distinct ids, whether the stated size holds, ids it shares with the release's other splits, ids without a record."""
    m = table(spark, d, "benchmark_manifest")
    ids = m.select("release_id", "split", F.explode("qa_ids").alias("qa_id"))
    one = ids.distinct()
    shared = one.groupBy("release_id", "qa_id").agg(F.count(F.lit(1)).alias("splits"))
    known = table(spark, d, "qa_records").select("qa_id", F.lit(1).alias("known")).distinct()
    per = one.join(shared, ["release_id", "qa_id"]).join(known, "qa_id", "left").groupBy("release_id", "split").agg(F.count(F.lit(1)).alias("ids"), F.count_if(F.col("splits") > 1).alias("shared"), F.count_if(F.col("known").isNull()).alias("unknown"))
    return m.select("release_id", "split", F.size("qa_ids").cast("bigint").alias("listed"), (F.col("size") == F.size("qa_ids")).alias("holds")).join(per, ["release_id", "split"])


def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Questions of every type, by spelling and in all."""
    rows = table(spark, d, "qa_records").select(text.type_name(F.col("question_type")).alias("question_type"), F.col("question_type").alias("spelling"))
    return rows.groupBy("question_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("spelling").alias("spellings"))


def latest_traces(spark: SparkSession, d: str) -> DataFrame:
    """The latest trace of every pipeline and question."""
    return views.traces(spark, d).select("pipeline", "qa_id", "started_at", "stop_reason", "num_retrieval_calls")


def remaining_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions that the adaptive pipeline has no trace of."""
    return upkeep.remaining(views.questions(spark, d).select("qa_id", "question_type"), table(spark, d, "traces").filter("pipeline = 'adaptive'"), "qa_id")


def upsert_routes(spark: SparkSession, d: str) -> DataFrame:
    """Routing rows of agentic traces, replaced where the adaptive pipeline has one."""
    t = views.traces(spark, d)
    old, new = (t.filter(F.col("pipeline") == p).select("qa_id", "pipeline", "num_retrieval_calls") for p in ("always_agentic", "adaptive"))
    return upkeep.upsert(old, new, ["qa_id"])


def grade_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Questions that different runs sent on different routes."""
    return upkeep.conflicts(table(spark, d, "phase9_holdout_report").filter("qa_id IS NOT NULL"), "qa_id", "predicted_route")


def split_drift(spark: SparkSession, d: str) -> DataFrame:
    """Ids that came, went or changed split between the first and the last release."""
    m = table(spark, d, "benchmark_manifest").select("release_id", F.explode("qa_ids").alias("qa_id"), "split")
    ends = m.agg(F.min("release_id").alias("a"), F.max("release_id").alias("b")).first()
    side = lambda r: m.filter(F.col("release_id") == r).groupBy("qa_id").agg(F.min("split").alias("split"))
    return upkeep.drift(side(ends[0]), side(ends[1]), "qa_id", "split")


def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Events that a limit of 5 in an hour lets through, by user."""
    e = rate_limit.limited(table(spark, d, "events"), "user_id", "ts", "event_id", seconds=3600.0)
    return e.groupBy("user_id").agg(F.count_if("allowed").alias("allowed"), F.count_if(~F.col("allowed")).alias("refused"))


QUERIES = {f.__name__: f for f in (latency_percentiles, evidence_coverage, answer_scores, abstention, verdicts, response_structure, evidence_routes, shortest_questions, entity_containment, unsupported, task_success, combined_quality, fact_grounding, fact_survival, fact_survival_chunks, judge_parse, confusion_matrix, class_scores, route_order, threshold_curve, fold_assignment, router_coefficients, router_probabilities, paired_delta, bootstrap_ci, hop_tiers, replay_overlap, allocation, stratified_sample, manifest_checks, type_distribution, latest_traces, remaining_questions, upsert_routes, grade_conflicts, split_drift, rate_limited)}

_V = "WITH " + views.SQL
_NORMAL = r"array_to_string(list_filter(string_split_regex(regexp_replace(regexp_replace(lower({0}), '[[:punct:]]', '', 'g'), '^\s+|\s+$', '', 'g'), '\s+'), lambda w: w NOT IN ('a', 'an', 'the', '')), ' ')"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_FACT = "lower(" + _STRIP.format(r"regexp_replace(translate({0}, '‘’“”–—', '''''\"\"--'), '\s+', ' ', 'g')") + ")"
_EXACT = _FACT.removeprefix("lower(").removesuffix(")")
_COVERED = f"""{_V}, g AS (SELECT qid AS qa_id, list(doc_id) AS gold FROM gold GROUP BY qid),
cov AS (SELECT tr.*, g.gold, len(list_intersect(gold, coalesce(evidence_doc_ids_used, []))) / len(gold) AS coverage FROM tr LEFT JOIN g USING (qa_id))"""
_WORDS = "list_filter(string_split({0}, ' '), lambda w: w <> '')"
_ABSTAINS = "(" + " OR ".join(f"contains(regexp_replace(lower(answer), '\\s+', ' ', 'g'), '{p}')" for p in text.ABSTENTION) + ")"
_CM = f"{_V}, l AS (SELECT unnest(['SIMPLE', 'MEDIUM', 'COMPLEX']) AS x), cm AS (SELECT a.x AS truth, b.x AS predicted, (SELECT count(*) FROM routes WHERE true_route = a.x AND predicted_route = b.x) AS rows FROM l a CROSS JOIN l b)"


def _wilson_sql(hits: str, n: str) -> tuple[str, str]:
    p, z = f"({hits} / nullif({n}, 0)::DOUBLE)", 1.96
    scale = f"(1 + {z * z} / nullif({n}, 0))"
    mid = f"(({p} + {z * z} / (2 * nullif({n}, 0))) / {scale})"
    half = f"({z} * sqrt({p} * (1 - {p}) / nullif({n}, 0) + {z * z} / (4 * nullif({n}, 0) * nullif({n}, 0))) / {scale})"
    return f"CASE WHEN {n} > 0 THEN round(greatest({mid} - {half}, 0), 6) ELSE 0 END", f"CASE WHEN {n} > 0 THEN round(least({mid} + {half}, 1), 6) ELSE 1 END"


_LOW, _HIGH = _wilson_sql("right_refusal", "(right_refusal + missed_refusal)")
_VERDICT = "|".join(text.VERDICTS)
_OPP = "CASE {0} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.OPPOSITES.items()) + " END"


def _resolved(negated: str, word: str) -> str:
    return f"CASE WHEN {negated} THEN {_OPP.format(word)} ELSE {word} END"


_LEAD, _SAID = rf"^\s*(not\s+)?\b({_VERDICT})\b", rf"\b(?:the answer is|it is|overall,?)\s+(not\s+)?\b({_VERDICT})\b"
_CLOSE = rf"^(.*)\b({_VERDICT})\b\s*$"
_NEG, _HEDGE = "|".join(x.replace("'", "''") for x in text.NEGATORS), "|".join(text.HEDGES)
_FOLDED = "(SELECT *, row_number() OVER (PARTITION BY label ORDER BY sha1('42|' || qa_id), qa_id) AS r FROM (SELECT qa_id, (true_route = 'SIMPLE')::INT AS label FROM routes))"

ORACLES = {
    "latency_percentiles": f"{_V} SELECT pipeline, count(*) AS n, round(avg(total_latency_ms), 6) AS mean, quantile_disc(total_latency_ms, 0.5) AS p50, quantile_disc(total_latency_ms, 0.95) AS p95 FROM tr WHERE total_latency_ms IS NOT NULL GROUP BY pipeline",
    "evidence_coverage": f"{_COVERED} SELECT pipeline, qa_id, round(coverage, 6) AS coverage FROM cov",
    "answer_scores": f"""{_V}, n AS (SELECT pipeline, qa_id, {_NORMAL.format("answer")} AS p, {_NORMAL.format("gold_answer")} AS g FROM tr WHERE answer IS NOT NULL AND gold_answer IS NOT NULL),
w AS (SELECT *, {_WORDS.format("p")} AS pw, {_WORDS.format("g")} AS gw FROM n)
SELECT pipeline, qa_id, p AS answer, (p = g)::INT AS em, round(CASE WHEN len(pw) + len(gw) = 0 THEN 1 ELSE 2 * coalesce(list_sum(list_transform(list_distinct(pw), lambda x: least(len(list_filter(pw, lambda y: y = x)), len(list_filter(gw, lambda y: y = x))))), 0) / (len(pw) + len(gw)) END, 6) AS f1 FROM w""",
    "abstention": f"""{_V}, c AS (SELECT pipeline, count(*) FILTER (question_type = 'null_query' AND {_ABSTAINS}) AS right_refusal, count(*) FILTER (question_type <> 'null_query' AND {_ABSTAINS}) AS wrong_refusal,
count(*) FILTER (question_type = 'null_query' AND NOT {_ABSTAINS}) AS missed_refusal, count(*) FILTER (question_type <> 'null_query' AND NOT {_ABSTAINS}) AS answered FROM tr WHERE answer IS NOT NULL AND question_type IS NOT NULL GROUP BY pipeline)
SELECT *, {_LOW} AS low, {_HIGH} AS high FROM c""",
    "verdicts": rf"""{_V}, t AS (SELECT pipeline, qa_id, lower({_STRIP.format("gold_answer")}) AS g, regexp_replace(answer, '(?i)\b({_VERDICT})\s+or\s+({_VERDICT})\b', ' ', 'g') AS x FROM tr WHERE answer IS NOT NULL AND gold_answer IS NOT NULL),
p AS (SELECT *, regexp_matches(x, '(?i){_LEAD}') AS has_lead, lower(regexp_extract(x, '(?i){_LEAD}', 2)) AS lead, regexp_extract(x, '(?i){_LEAD}', 1) <> '' AS lead_neg,
 list_filter(list_transform(list_zip(regexp_extract_all(x, '(?i){_SAID}', 1), regexp_extract_all(x, '(?i){_SAID}', 2)), lambda m: {_resolved("m[1] <> ''", "lower(m[2])")}), lambda v: v IS NOT NULL) AS said,
 list_filter(list_transform(list_transform(string_split_regex(x, '[.!?;]'), lambda s: regexp_replace(lower(s), '\s+', ' ', 'g')), lambda s: CASE WHEN regexp_matches(s, '{_CLOSE}') AND NOT regexp_matches(regexp_extract(s, '{_CLOSE}', 1), '\b({_HEDGE})\b')
   THEN {_resolved(rf"regexp_matches(regexp_extract(s, '{_CLOSE}', 1), '\b({_NEG})\b')", f"regexp_extract(s, '{_CLOSE}', 2)")} END), lambda v: v IS NOT NULL) AS closing FROM t),
v AS (SELECT pipeline, qa_id, g, coalesce(said[-1], CASE WHEN has_lead THEN {_resolved("lead_neg", "lead")} END, closing[-1]) AS verdict FROM p)
SELECT pipeline, qa_id, verdict, CASE WHEN g NOT IN ({", ".join(f"'{x}'" for x in text.VERDICTS)}) THEN 'not_applicable' WHEN verdict IS NULL THEN 'ambiguous' WHEN verdict = g THEN 'correct' ELSE 'incorrect' END AS outcome FROM v""",
    "entity_containment": f"""{_V} SELECT pipeline, qa_id, CASE WHEN {_NORMAL.format("gold_answer")} <> '' THEN contains(' ' || {_NORMAL.format("answer")} || ' ', ' ' || {_NORMAL.format("gold_answer")} || ' ') END AS holds FROM tr
WHERE question_type = 'inference_query' AND answer IS NOT NULL AND gold_answer IS NOT NULL""",
    "unsupported": f"""{_COVERED}, gr AS (SELECT qa_id, arg_max(grade, {{'s': coalesce(score, -1), 'g': grade}}) AS grade FROM judge_scores GROUP BY qa_id),
f AS (SELECT pipeline, question_type, CASE WHEN grade IS NULL OR coverage IS NULL THEN NULL WHEN grade NOT IN ('correct', 'partially_correct') THEN false ELSE coverage = 0 END AS u FROM cov LEFT JOIN gr USING (qa_id))
SELECT pipeline, question_type, count(*) FILTER (u) AS unsupported, count(*) FILTER (NOT u) AS supported, count(*) FILTER (u IS NULL) AS unknown FROM f GROUP BY ALL""",
    "fact_grounding": f"""{_V}, f AS (SELECT qid, pos, doc_id, {_FACT.format("fact")} AS f FROM evidence), b AS (SELECT substr(sha1(url), 1, 16) AS doc_id, {_FACT.format("body")} AS t FROM corpus_documents),
held AS (SELECT DISTINCT doc_id, f FROM f JOIN b USING (doc_id) WHERE f <> '' AND contains(t, f)), r AS (SELECT f.qid, (h.f IS NOT NULL) AS ok FROM f LEFT JOIN held h ON h.doc_id = f.doc_id AND h.f = f.f)
SELECT qid, count(*) AS facts, count(*) FILTER (ok) AS grounded, round(count(*) FILTER (ok) / count(*), 6) AS rate FROM r GROUP BY qid""",
    "fact_survival": f"""{_V}, f AS (SELECT qid, pos, doc_id, {_EXACT.format("fact")} AS f FROM evidence),
b AS (SELECT substr(sha1(url), 1, 16) AS doc_id, list_transform(list_filter(list_transform(string_split(body, chr(10)), lambda x: {_STRIP.format("x")}), lambda x: x <> ''), lambda x: {_EXACT.format("x")}) AS ps FROM corpus_documents WHERE body IS NOT NULL),
lv AS (SELECT doc_id, f, max(CASE WHEN len(list_filter(ps, lambda p: contains(p, f))) > 0 THEN 2 WHEN len(list_filter(list_transform(list_zip(ps, ps[2:]), lambda z: coalesce(z[1], '') || coalesce(' ' || z[2], '')), lambda p: contains(p, f))) > 0 THEN 1 ELSE 0 END) AS level
 FROM (SELECT DISTINCT doc_id, f FROM f WHERE f <> '') JOIN b USING (doc_id) GROUP BY ALL)
SELECT CASE level WHEN 2 THEN 'intact' WHEN 1 THEN 'across' ELSE 'absent' END AS place, count(*) AS facts FROM f LEFT JOIN lv ON lv.doc_id = f.doc_id AND lv.f = f.f GROUP BY 1""",
    "judge_parse": r"""WITH w AS (SELECT qa_id, grade, fallback_used, substr(qa_id, 1, 1) AS f, '{' || CASE WHEN grade IS NULL THEN '' ELSE '"grade":' || to_json(grade) || CASE WHEN reason IS NULL THEN '' ELSE ',' END END || CASE WHEN reason IS NULL THEN '' ELSE '"reason":' || to_json(reason) END || '}' AS whole FROM judge_scores),
raw AS (SELECT qa_id, CASE WHEN fallback_used THEN 'grade: ' || grade WHEN f IN ('0', '1', '2', '3') THEN '{' || whole WHEN f IN ('c', 'd', 'e', 'f') THEN whole || ' ok' ELSE whole END AS raw FROM w),
fixed AS (SELECT qa_id, regexp_replace(raw, '^(\s*\{)\s*\{', '\1') AS raw FROM raw), g AS (SELECT qa_id, CASE WHEN json_valid(raw) AND json_type(raw, '$.grade') = 'VARCHAR' THEN json_extract_string(raw, '$.grade') END AS g FROM fixed)
SELECT qa_id, CASE WHEN g IN ('correct', 'partially_correct', 'incorrect') THEN g ELSE 'incorrect' END AS grade, CASE g WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END::DOUBLE AS score, (coalesce(g, '') NOT IN ('correct', 'partially_correct', 'incorrect'))::INT AS fallback FROM g""",
    "confusion_matrix": f"{_CM} SELECT * FROM cm",
    "class_scores": f"""{_CM}, s AS (SELECT l.x AS label, (SELECT sum(rows) FROM cm WHERE truth = l.x AND predicted = l.x) AS hit, (SELECT sum(rows) FROM cm WHERE truth = l.x) AS n, (SELECT sum(rows) FROM cm WHERE predicted = l.x) AS m FROM l),
p AS (SELECT label, CAST(n AS BIGINT) AS support, coalesce(hit / nullif(m, 0), 0) AS p, coalesce(hit / nullif(n, 0), 0) AS r FROM s) SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM p""",
    "route_order": f"""{_V}, s AS (SELECT hop_count, CASE true_route WHEN 'SIMPLE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END - CASE predicted_route WHEN 'SIMPLE' THEN 0 WHEN 'MEDIUM' THEN 1 ELSE 2 END AS st FROM routes)
SELECT hop_count, count(*) AS n, round(avg((st = 0)::INT), 6) AS right, round(avg((st > 0)::INT), 6) AS under, round(avg((st < 0)::INT), 6) AS over FROM s GROUP BY hop_count""",
    "threshold_curve": f"""{_V}, x AS (SELECT least(floor(stage1_probability * 100 + 1e-9), 100) AS s, (true_route = 'SIMPLE')::INT AS y FROM tr JOIN routes USING (qa_id) WHERE stage1_probability IS NOT NULL)
SELECT i / 100 AS threshold, (SELECT count(*) FROM x WHERE s >= i) AS kept, CAST((SELECT coalesce(sum(y), 0) FROM x WHERE s >= i) AS BIGINT) AS right FROM range(101) r(i)""",
    "fold_assignment": f"{_V} SELECT qa_id, label, CAST((r - 1) % 5 AS INT) AS fold FROM {_FOLDED}",
    "paired_delta": f"""{_V}, d AS (SELECT a.question_type, a.total_latency_ms - b.total_latency_ms AS d FROM tr a JOIN tr b ON a.qa_id = b.qa_id AND a.pipeline = 'always_agentic' AND b.pipeline = 'adaptive' WHERE a.total_latency_ms IS NOT NULL AND b.total_latency_ms IS NOT NULL)
SELECT question_type, count(*) AS n, round(avg(d), 6) AS mean, round(median(d), 6) AS median, round(stddev_samp(d), 6) AS stdev, round(avg(d) / nullif(stddev_samp(d), 0), 6) AS effect FROM d GROUP BY question_type""",
    "hop_tiers": f"""{_COVERED}, m AS (SELECT a.hop_count, a.coverage, len(list_intersect(list_filter(list_distinct(coalesce(a.evidence_doc_ids_used, [])), lambda x: NOT list_contains(coalesce(b.evidence_doc_ids_used, []), x)), a.gold)) AS n FROM cov a JOIN cov b ON a.qa_id = b.qa_id
 AND a.pipeline = 'always_agentic' AND b.pipeline = 'hybrid_reranker' WHERE a.gold IS NOT NULL)
SELECT hop_count, CASE WHEN n > 0 AND coverage = 1 THEN 'completed' WHEN n > 0 THEN 'added' ELSE 'none' END AS tier, count(*) AS n, CAST(sum(n) AS BIGINT) AS documents FROM m GROUP BY ALL""",
    "replay_overlap": f"""{_V}, p AS (SELECT list_sort(list_distinct(coalesce(a.evidence_doc_ids_used, []))) AS a, list_sort(list_distinct(coalesce(b.evidence_doc_ids_used, []))) AS b FROM tr a JOIN tr b ON a.qa_id = b.qa_id AND a.pipeline = 'always_agentic' AND b.pipeline = 'adaptive')
SELECT CASE WHEN a = b THEN 'exact' WHEN list_has_any(a, b) THEN 'partial' ELSE 'none' END AS overlap, count(*) AS n FROM p GROUP BY 1""",
    "allocation": f"""{_V}, g AS (SELECT coalesce(question_type, '') AS stratum, count(*) AS n FROM questions GROUP BY 1), e AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS x FROM g),
f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS o FROM e) SELECT stratum, n, CAST(least(n, fl + (o <= 100 - sum(fl) OVER ())::INT) AS BIGINT) AS take FROM f""",
    "stratified_sample": f"""{_V}, g AS (SELECT coalesce(question_type, '') AS stratum, count(*) AS n FROM questions GROUP BY 1), e AS (SELECT *, 100.0::DOUBLE * n / sum(n) OVER () AS x FROM g),
f AS (SELECT *, floor(x) AS fl, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS o FROM e), a AS (SELECT stratum, least(n, fl + (o <= 100 - sum(fl) OVER ())::INT) AS take FROM f),
r AS (SELECT qa_id, coalesce(question_type, '') AS stratum, row_number() OVER (PARTITION BY coalesce(question_type, '') ORDER BY sha1('2029|' || qa_id), qa_id) AS r FROM questions) SELECT qa_id, stratum FROM r JOIN a USING (stratum) WHERE r <= take""",
    "manifest_checks": """WITH one AS (SELECT DISTINCT release_id, split, unnest(qa_ids) AS qa_id FROM benchmark_manifest), sh AS (SELECT release_id, qa_id, count(*) AS k FROM one GROUP BY ALL), kn AS (SELECT DISTINCT qa_id FROM qa_records),
per AS (SELECT o.release_id, o.split, count(*) AS ids, count(*) FILTER (k > 1) AS shared, count(*) FILTER (kn.qa_id IS NULL) AS unknown FROM one o JOIN sh USING (release_id, qa_id) LEFT JOIN kn USING (qa_id) GROUP BY ALL)
SELECT m.release_id, m.split, len(m.qa_ids) AS listed, m.size = len(m.qa_ids) AS holds, ids, shared, unknown FROM benchmark_manifest m JOIN per USING (release_id, split)""",
    "type_distribution": r"""SELECT nullif(regexp_replace(regexp_replace(lower(question_type), '^\s+|\s+$', '', 'g'), '[\s\-]+', '_', 'g'), '') AS question_type, count(*) AS n, count(DISTINCT question_type) AS spellings FROM qa_records GROUP BY 1""",
    "latest_traces": f"{_V} SELECT pipeline, qa_id, started_at, stop_reason, num_retrieval_calls FROM tr",
    "remaining_questions": f"{_V} SELECT qa_id, question_type FROM questions WHERE qa_id NOT IN (SELECT qa_id FROM traces WHERE pipeline = 'adaptive' AND qa_id IS NOT NULL)",
    "upsert_routes": f"""{_V} SELECT qa_id, pipeline, num_retrieval_calls FROM tr WHERE pipeline = 'adaptive' UNION ALL
SELECT qa_id, pipeline, num_retrieval_calls FROM tr WHERE pipeline = 'always_agentic' AND qa_id NOT IN (SELECT qa_id FROM tr WHERE pipeline = 'adaptive')""",
    "grade_conflicts": 'SELECT qa_id, count(DISTINCT predicted_route) AS "values" FROM phase9_holdout_report WHERE qa_id IS NOT NULL GROUP BY qa_id HAVING count(DISTINCT predicted_route) > 1',
    "split_drift": """WITH i AS (SELECT release_id, split, unnest(qa_ids) AS qa_id FROM benchmark_manifest), e AS (SELECT min(release_id) AS a, max(release_id) AS b FROM benchmark_manifest),
x AS (SELECT qa_id, min(split) AS s FROM i WHERE release_id = (SELECT a FROM e) GROUP BY 1), y AS (SELECT qa_id, min(split) AS s FROM i WHERE release_id = (SELECT b FROM e) GROUP BY 1)
SELECT * FROM (SELECT coalesce(x.qa_id, y.qa_id) AS qa_id, CASE WHEN y.qa_id IS NULL THEN 'missing' WHEN x.qa_id IS NULL THEN 'added' WHEN x.s IS DISTINCT FROM y.s THEN 'changed' END AS state FROM x FULL JOIN y ON x.qa_id = y.qa_id) WHERE state IS NOT NULL""",
}
_GRADED = "gr AS (SELECT qa_id, arg_max({'g': grade, 's': score}, {'s': coalesce(score, -1), 'g': grade}) AS j FROM judge_scores GROUP BY qa_id)"
ORACLES |= {
    "task_success": f"""{ORACLES["verdicts"].rpartition("SELECT pipeline, qa_id, verdict, CASE")[0].rstrip()}, {_GRADED},
x AS (SELECT tr.*, j.g AS grade, v.verdict, v.g AS gold, (NOT {_ABSTAINS} AND question_type <> 'null_query') AS plain FROM tr JOIN v USING (pipeline, qa_id) LEFT JOIN gr USING (qa_id) WHERE question_type IS NOT NULL),
y AS (SELECT *, CASE WHEN plain AND question_type IN ('comparison_query', 'temporal_query') AND gold IN ({", ".join(f"'{w}'" for w in text.VERDICTS)}) AND verdict IS NOT NULL THEN verdict = gold END AS ok FROM x)
SELECT pipeline, question_type, count(*) AS n, count(*) FILTER (NOT plain OR ok IS NOT NULL) AS confident, count(*) FILTER (ok) AS correct,
count(*) FILTER ((ok AND grade = 'correct') OR (NOT ok AND grade = 'incorrect')) AS agree, count(*) FILTER ((ok AND grade <> 'correct') OR (NOT ok AND grade <> 'incorrect')) AS disagree FROM y GROUP BY ALL""",
    "combined_quality": f"""{_V}, {_GRADED}, q AS (SELECT pipeline, CASE WHEN question_type = 'null_query' THEN {_ABSTAINS}::INT::DOUBLE ELSE j.s END AS q FROM tr LEFT JOIN gr USING (qa_id) WHERE answer IS NOT NULL AND question_type IS NOT NULL)
SELECT pipeline, count(q) AS n, round(avg(q), 6) AS quality FROM q GROUP BY pipeline""",
    "evidence_routes": f"""{_V}, l AS (SELECT * FROM collapsed WHERE method IN ('rrf', 'rerank')), h AS (SELECT l.qid, method, count(*) = any_value(hops) AS whole FROM l JOIN gold g ON g.qid = l.qid AND g.doc_id = l.doc_id WHERE rank <= 5 GROUP BY ALL),
b AS (SELECT qid, bool_or(method = 'rrf') AS fused FROM h WHERE whole GROUP BY qid), a AS (SELECT DISTINCT l.qid, g.hops FROM l JOIN gold g ON g.qid = l.qid)
SELECT a.qid, hops AS hop_count, CASE WHEN fused THEN 'SIMPLE' WHEN fused IS NOT NULL THEN 'MEDIUM' ELSE 'COMPLEX' END AS route FROM a LEFT JOIN b USING (qid)""",
    "shortest_questions": f"{_V} SELECT question_type, arg_min(query, {{'l': length(query), 'q': qa_id}}) AS query FROM questions WHERE query IS NOT NULL AND question_type IS NOT NULL GROUP BY question_type",
}
ORACLES["rate_limited"] = """WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
r AS (SELECT user_id, n, [us] AS recent, true AS ok FROM e WHERE n = 1 UNION ALL
 SELECT user_id, n, CASE WHEN len(near) < 5 THEN list_append(near, us) ELSE near END, len(near) < 5 FROM (SELECT e.user_id, e.n, e.us, list_filter(r.recent, lambda x: e.us - x <= 3600000000) AS near FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1))
SELECT user_id, count(*) FILTER (ok) AS allowed, count(*) FILTER (NOT ok) AS refused FROM r GROUP BY user_id"""


def _phrases(words: tuple[str, ...]) -> str:
    return "(" + " OR ".join("contains(low, '" + w.replace("'", "''") + "')" for w in words) + ")"


_NAMED = " OR ".join(f"len(list_filter(regexp_extract_all(answer, '(?is){m}(.{{0,60}})', 1), lambda w: regexp_matches(w, '\\b[A-Z][a-zA-Z''\\-]*\\b'))) > 0" for m in text.ASSERTING)
ORACLES["response_structure"] = rf"""{_V}, x AS (SELECT pipeline, answer, regexp_replace(lower({_STRIP.format("answer")}), '\s+', ' ', 'g') AS low FROM tr WHERE answer IS NOT NULL),
y AS (SELECT pipeline, low, {_phrases(text.DECLINE)} AS d, {_phrases(text.HEDGE)} AS h, {_NAMED} AS n FROM x)
SELECT pipeline, CASE WHEN low = '' THEN 'ambiguous' WHEN NOT d AND NOT h THEN 'substantive_answer' WHEN n THEN 'answer_with_uncertainty' WHEN d THEN 'clean_abstention' ELSE 'ambiguous' END AS structure, count(*) AS n FROM y GROUP BY ALL""".replace("\\\\", "\\")
