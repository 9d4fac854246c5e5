import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwell.functions import text
from gleanwell.operators import chunking, dense, index, loop, metrics, model, ranking, sampling, skew, statistics, upkeep


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(spark, column, **values):
    ddl = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], ddl).select(column).first()[0]


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ("Yes, they agree.", "yes"), ("Not true at all", "false"), ("The answer is not similar", None), ("The answer is no. Overall, yes", "yes"), ("It is hard to give a simple yes or no", None),
        ("They do not align.", None), ("It's uncertain whether they align.", None), ("The claims are consistent.", "consistent"), ("climate change, the internet", None), ("The reports did not say yes.", "no"), ("", None),
    ],
)
def test_verdict(spark, answer, expected):
    assert one(spark, text.verdict(F.col("a")), a=answer) == expected


@pytest.mark.parametrize(
    ("answer", "expected"),
    [
        ("Acme bought the mill.", "substantive_answer"), ("Insufficient information to answer.", "clean_abstention"), ("The data is limited, but it indicates that Acme won.", "answer_with_uncertainty"),
        ("The picture is  unclear.", "ambiguous"), ("No information suggests " + "x" * 61 + " Acme", "clean_abstention"), (" ", "ambiguous"), (None, None),
    ],
)
def test_response_structure(spark, answer, expected):
    assert one(spark, text.response_structure(F.col("a")), a=answer) == expected


def test_answer_rules(spark):
    assert one(spark, text.normal_answer(F.col("a")), a="  The U.S.  economy, an update! ") == "us economy update"
    f1 = lambda p, g: one(spark, text.token_f1(F.col("p"), F.col("g")), p=p, g=g)
    assert f1("a b b", "b b c") == pytest.approx(0.8) and f1("the", "a") == 1 and f1("x", "") == 0 and f1(None, "x") is None
    entity = lambda g, a: one(spark, text.entity_in(F.col("g"), F.col("a")), g=g, a=a)
    assert entity("Meta", "It was Meta.") is True and entity("meta", "climate metaphor") is False and entity("the", "x") is None
    assert one(spark, text.abstains(F.col("a")), a="Cannot  be\ndetermined") is True and one(spark, text.abstains(F.col("a")), a=None) is None
    assert one(spark, text.type_name(F.col("a")), a=" Null-Query\t") == "null_query" and one(spark, text.type_name(F.col("a")), a=" ") is None


def test_fusion_ties_and_single_lists(spark):
    data = [("q", "dense", "a", "d1", 1), ("q", "dense", "b", "d2", 2), ("q", "bm25", "b", "d2", 1), ("q", "bm25", "c", "d1", 2), ("q", "dense", "z", "d3", 3)]
    lists = spark.createDataFrame(data, "qid string, method string, chunk_id string, doc_id string, rank int")
    got = [(r["chunk_id"], r["rank"], round(r["rrf_score"], 9)) for r in ranking.fuse(lists, ("dense", "bm25")).orderBy("rank").collect()]
    assert got == [("b", 1, round(1 / 62 + 1 / 61, 9)), ("a", 2, round(1 / 61, 9)), ("c", 3, round(1 / 62, 9)), ("z", 4, round(1 / 63, 9))]


def test_clean_collapse_budget_hops(spark):
    data = [("q", "m", "a", "d", 1, 1.0, "x" * 40), ("q", "m", "a", "d", 1, 1.0, "x" * 40), ("q", "m", "b", "d", 3, 0.5, None), ("q", "m", "c", "e", 7, 0.5, "y" * 80), (None, "m", "c", "e", 7, 0.5, "y")]
    lists = ranking.clean(spark.createDataFrame(data, "qid string, method string, chunk_id string, doc_id string, rank int, score double, text string"))
    assert [(r["chunk_id"], r["rank"]) for r in lists.orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]
    assert rows(ranking.collapse(lists)) == [("q", "m", "d", 1), ("q", "m", "e", 2)]
    assert [r["chunk_id"] for r in ranking.within_budget(lists, 11).orderBy("rank").collect()] == ["a", "b"]
    hops = spark.createDataFrame([("q", 1, 1, "a", "d"), ("q", 2, 1, "a", "d"), ("q", 2, 2, "b", "e")], "qid string, hop int, rank int, chunk_id string, doc_id string")
    assert sum(r["fresh"] for r in ranking.merge_hops(hops).collect()) == 2 and rows(ranking.new_docs(hops)) == [("q", 1, 1), ("q", 2, 1)]


def test_metrics_by_hand(spark):
    lists = spark.createDataFrame([("q", "m", d, i + 1) for i, d in enumerate("abcdefghijk")], "qid string, method string, doc_id string, rank int")
    gold = metrics.gold_documents(spark.createDataFrame([("q", "b"), ("q", "b"), ("q", "k"), ("q", None), ("n", "x")], "qid string, doc_id string"))
    r = metrics.ranking_metrics(lists, gold).collect()
    assert len(r) == 1 and (r[0]["hops"], r[0]["recall_4"], r[0]["hit_4"], r[0]["complete_10"], r[0]["mrr_10"]) == (2, 0.5, 1.0, 0.0, 0.5)
    assert r[0]["ndcg_10"] == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))


def bm25_model(docs, queries, k):
    toks = {i: re.findall(r"[^\W_]+", t.lower()) for i, t in docs}
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    df = Counter(w for t in toks.values() for w in set(t))
    out = {}
    for q, t in queries:
        s = {}
        for i, ws in toks.items():
            c = Counter(ws)
            v = sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(re.findall(r"[^\W_]+", t.lower())) if w in c)
            if any(w in c for w in set(re.findall(r"[^\W_]+", t.lower()))):
                s[i] = round(v, 6)
        out[q] = [x[0] for x in sorted(s.items(), key=lambda x: (-x[1], x[0]))[:k]]
    return out


def test_bm25_equals_plain_scoring(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(0, 30)))) for i in range(150)]
    queries = [(i, " ".join(rng.choices(words, k=4)) + (" w0 w1" if i % 2 else "")) for i in range(12)] + [(98, "w0"), (99, ""), (100, "unknown")]
    got = defaultdict(list)
    d, q = spark.createDataFrame(docs, "id bigint, t string"), spark.createDataFrame(queries, "qid bigint, query string")
    for r in index.bm25(d, "id", F.col("t"), q, 5).orderBy("qid", "rank").collect():
        got[r["qid"]].append(r["doc"])
    want = bm25_model(docs, queries, 5)
    assert {k: v for k, v in want.items() if v} == dict(got)


def test_dense_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(200, 8)).astype(np.float32)
    m[7] = m[3]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(500, None)], "id bigint, v array<float>").repartition(5)
    got = dense.dense_topk(df, "id", "v", df.filter("id % 50 = 0").select(F.col("id").alias("qid"), F.col("v").alias("vector")), 4)
    u = m.astype(float) / np.sqrt((m.astype(float) ** 2).sum(1, keepdims=True))
    for q in (0, 50, 100, 150):
        s = sorted(((-round(float(u[q] @ u[j]), 6), j) for j in range(200) if j != q))[:4]
        assert [r["vec_id"] for r in got.filter(F.col("qid") == q).orderBy("rank").collect()] == [j for _, j in s]
    assert dense.dense_topk(df, "id", "v", df.filter("id < 0").select(F.col("id").alias("qid"), F.col("v").alias("vector")), 4).count() == 0


def pack_model(units, target, most, overlap):
    done, now = [], []
    size = lambda a: sum(n for _, n in a)
    for u in units:
        if now and (size(now) >= target or size(now) + u[1] > most):
            done.append(now)
            tail = []
            for x in reversed(now):
                if tail and size(tail) + x[1] > overlap:
                    break
                tail.insert(0, x)
            now = [u] if size(tail) + u[1] > most else [*tail, u]
        else:
            now = [*now, u]
    return [*done, now] if now else done


def test_chunk_packing_equals_a_model(spark):
    rng = random.Random(5)
    cases = [(i, [(f"u{j}", rng.randint(1, 30)) for j in range(rng.randint(0, 25))]) for i in range(60)]
    df = spark.createDataFrame(cases, "id int, u array<struct<text:string,n:int>>")
    for r in df.select("id", chunking.pack(F.col("u"), 40, 50, 12).alias("p")).collect():
        assert [[tuple(x) for x in c] for c in r["p"]] == pack_model(cases[r["id"]][1], 40, 50, 12)


def test_chunks_of_documents(spark):
    long = " ".join(f"w{i}" for i in range(900)) + "."
    docs = spark.createDataFrame([(1, "\n\n".join(["word " * 50] * 10)), (2, long), (3, ""), (4, None), (5, " \n\n ")], "id int, body string")
    got = chunking.chunk(docs, "id", F.col("body"), 150, 200, 20).collect()
    assert {r["id"] for r in got} == {1, 2} and all(r["tokens"] <= 200 for r in got) and len({r["chunk_id"] for r in got}) == len(got)
    assert [r["tokens"] for r in sorted((r for r in got if r["id"] == 2), key=lambda r: r["position"])][0] == 200


def test_spread_rank_equals_row_number(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([("hot" if rng.random() < 0.6 else rng.choice(["a", None]), rng.randint(0, 400), i) for i in range(900)], "g string, v int, id int")
    got = skew.spread_rank(df, ["g"], [F.col("v"), F.col("id")], F.floor(F.col("v") / 50), "r")
    df.createOrReplaceTempView("t")
    assert rows(got) == rows(spark.sql("select g, v, id, row_number() over (partition by g order by v, id) r from t"))


@pytest.mark.parametrize("bound", [0, 10**6])
def test_join_counted_both_ways(spark, bound):
    left = spark.createDataFrame([(0 if i % 3 else i, i) for i in range(500)] + [(None, -1)], "k int, i int")
    counted = left.filter("k is not null").groupBy("k").count()
    got = skew.join_counted(left, counted, ["k"], "count", counted.count(), 500, bound)
    assert rows(got.select("k", "i", "count")) == rows(left.join(counted, "k").select("k", "i", "count"))


def test_samples_and_folds(spark):
    df = spark.createDataFrame([(f"k{i}", "abc"[min(i % 7, 2)]) for i in range(400)] + [("n", None)], "id string, s string")
    a = sampling.stratified(df, "id", "s", 40, 7)
    assert a.count() == 40 and rows(a) == rows(sampling.stratified(df.repartition(9), "id", "s", 40, 7))
    sizes = Counter(r["fold"] for r in sampling.folds(df, "id", "s", 5, 1).collect())
    assert max(sizes.values()) - min(sizes.values()) <= 4
    g = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "stratum string, n bigint")
    assert {r["stratum"]: r["take"] for r in sampling.allocate(g, 4).collect()} == {"a": 1, "b": 1, "c": 2}


def test_upkeep(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", None, "z")], "k string, t int, v string")
    assert rows(upkeep.latest(t, ["k"], "t", ["v"])) == [("a", 2, "y"), ("b", None, "z")]
    assert rows(upkeep.conflicts(t, "k", "v")) == [("a", 2)]
    old, new = t.filter("t = 1"), t.filter("t = 2")
    assert rows(upkeep.upsert(old, new, ["k"])) == [("a", 2, "y")]
    assert rows(upkeep.drift(old, t.filter("t is null or t = 2"), "k", "v")) == [("a", "changed"), ("b", "added")]


def test_logistic_fit_equals_newton(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 2)) * [1, 30] + [0, 5]
    y = (rng.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.03 * x[:, 1])))).astype(int)
    df = spark.createDataFrame([(float(a), float(b), 1.0, int(c)) for (a, b), c in zip(x, y)], "a double, b double, c double, y int")
    m = model.fit(df, ("a", "b", "c"), "y")
    z = (x - x.mean(0)) / x.std(0)
    w, b0 = np.zeros(2), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-(z @ w + b0)))
        g = np.append(z.T @ (p - y) + w, (p - y).sum())
        zz = np.hstack([z, np.ones((300, 1))])
        h = zz.T @ (zz * (p * (1 - p))[:, None]) + np.diag([1, 1, 0])
        step = np.linalg.solve(h, g)
        w, b0 = w - step[:2], b0 - step[2]
    assert m.coef[:2] == pytest.approx(w, abs=1e-4) and m.intercept == pytest.approx(b0, abs=1e-4) and m.scale[2] == 0
    got = df.select(model.predict(m).alias("p")).first()[0]
    assert got == pytest.approx(1 / (1 + math.exp(-(z[0] @ w + b0))), abs=1e-4)
    with pytest.raises(ValueError, match="length"):
        model.predict(m._replace(coef=(1.0,)))


def test_statistics(spark):
    df = spark.createDataFrame([("g", f"i{i}", float(i), 0.0) for i in range(20)] + [("h", "x", 1.0, 1.0)], "g string, id string, a double, b double")
    s = {r["g"]: r for r in statistics.paired_summary(df, ["g"]).collect()}
    assert s["g"]["mean"] == 9.5 and s["g"]["effect"] == pytest.approx(9.5 / np.std(range(20), ddof=1)) and s["h"]["effect"] is None
    b = {r["g"]: r for r in statistics.bootstrap(df, "g", 400).collect()}
    assert b["g"]["low"] < 9.5 < b["g"]["high"] and 4 < b["g"]["high"] - b["g"]["low"] < 7
    low, high = statistics.wilson(F.lit(8), F.lit(10))
    r = spark.range(1).select(low, high).first()
    assert r[0] == pytest.approx(0.4902, abs=1e-3) and r[1] == pytest.approx(0.9433, abs=1e-3)


def test_hops_stop_for_their_reasons(spark):
    docs = [(1, "alpha beta"), (2, "gamma delta"), (3, "alpha"), (4, "epsilon " * 3)]
    queries = [("both", "alpha beta gamma delta"), ("one", "alpha beta"), ("half", "epsilon zeta eta"), ("none", "zeta"), ("null", None)]
    d, q = spark.createDataFrame(docs, "id int, t string"), spark.createDataFrame(queries, "qid string, query string")
    ix = index.build(d, "id", F.col("t"))
    h = loop.multi_hop(ix, q, hops=4, k=1)
    assert rows(h.traces.select("qid", "hops", "docs", "reason")) == [
        ("both", 2, 2, "evidence_sufficient"), ("half", 2, 1, "duplicate_query"), ("none", 1, 0, "duplicate_query"), ("null", 0, 0, "no_words"), ("one", 1, 1, "evidence_sufficient"),
    ]
    assert rows(h.evidence.select("qid", "hop", "doc"))[:2] == [("both", 1, 2), ("both", 2, 1)]  # the rarer words first
    short = loop.multi_hop(ix, q.filter("qid = 'both'"), hops=1, k=1).traces.first()
    assert (short["reason"], short["covered"]) == ("max_hops", 0.5)
    assert loop.multi_hop(ix, q.filter("qid = 'both'"), k=2, budget=2).traces.first()["reason"] == "token_budget"
    assert rows(loop.multi_hop(ix, q.filter("qid = 'both'"), k=3, cap=1).evidence.select("doc")) == [(2,)]


def test_search_and_controller_can_be_given(spark):
    q = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z"), ("e", "w")], "qid string, query string")
    searcher = lambda asked: asked.select("qid", F.lit(1).alias("doc"), F.lit(1).alias("rank"), F.lit(5).alias("tokens"))

    def control(state, held):
        said = F.when(F.col("qid") == "a", True).when(F.col("qid") != "c", False)  # null is a failure
        return state.select("qid", said.alias("sufficient"), F.when(F.col("qid") == "b", "  Y ").otherwise(" ").alias("next_query"), F.lit(0.5).alias("covered"))

    h = loop.run(searcher, control, q, first=searcher(q).withColumn("doc", F.lit(9)))
    assert rows(h.traces.select("qid", "hops", "reason")) == [("a", 1, "evidence_sufficient"), ("b", 1, "duplicate_query"), ("c", 1, "controller_failure"), ("e", 1, "controller_failure")]
    assert rows(h.evidence.select("doc").distinct()) == [(9,)]


def test_an_index_is_stored_checked_and_searched_in_parts(spark, tmp_path, monkeypatch):
    from gleanwell.operators import blocks

    rng = random.Random(5)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=rng.randint(0, 12)))) for i in range(80)] + [(90, None)]
    d = spark.createDataFrame(docs, "id bigint, t string")
    q = spark.createDataFrame([(i, " ".join(rng.choices([f"w{j}" for j in range(30)], k=3))) for i in range(15)], "qid bigint, query string")
    ix = index.build(d, "id", F.col("t"))
    want = rows(index.search(ix, index.query_terms(q), 4))
    index.store(ix, str(tmp_path / "ix"))
    again = index.reopen(spark, str(tmp_path / "ix"))
    monkeypatch.setattr(blocks, "ROWS", 7)
    monkeypatch.setattr(blocks, "QUERIES", 4)
    monkeypatch.setattr(index, "CELLS", 50)
    assert rows(index.search(again, index.query_terms(q), 4)) == want and index.check(again, d, "id") == 81
    with pytest.raises(ValueError, match="lacks 0 documents, has 1"):
        index.check(again, d.filter("id < 90"), "id")
    with pytest.raises(ValueError, match="places"):
        dense.check_dimension(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "id int, v array<double>"), "v")


def test_hot_keys_meet_in_blocks(spark):
    rng = random.Random(3)
    rows = [(i, 0 if rng.random() < 0.4 else rng.randint(1, 12), "x") for i in range(200)] + [(500, None, "x")]
    df = spark.createDataFrame(rows, "id bigint, key int, n2 string")
    counted = df.join(df.groupBy("key").count().withColumnRenamed("count", "n"), "key")
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] == b[1] is not None and a[0] < b[0]}
    for size in (7, 1000):
        got = [tuple(r) for r in skew.self_pairs(counted, ["key"], "id", "n", size=size).selectExpr("x.id", "y.id as other").collect()]
        assert len(got) == len(set(got)) and set(got) == want
    right = spark.createDataFrame([(i, rng.choice([0, 0, 3, 99])) for i in range(90)], "other bigint, key int")
    want = sorted((a[0], b[0]) for a in rows for b in map(tuple, right.collect()) if a[1] == b[1] is not None)
    for size in (5, 1000):
        got = skew.join_split(df, right, "key", "id", "other", size=size)
        assert sorted(tuple(r) for r in got.select("id", "other").collect()) == want and got.columns == ["key", "id", "n2", "other"]


JUDGE = [
    ('{"grade": "correct", "reason": "a \\"b\\""}', ("correct", 1.0, 'a "b"', False)), ('  {{"grade": "partially_correct", "reason": "r"}', ("partially_correct", 0.5, "r", False)),
    ('{"grade": "correct"} and more', ("incorrect", 0.0, "", True)), ('{"grade": 1, "reason": "r"}', ("incorrect", 0.0, "r", True)), ('{"grade": "right", "reason": "r"}', ("incorrect", 0.0, "r", True)),
    ("grade: correct", ("incorrect", 0.0, "", True)), ("", ("incorrect", 0.0, "", True)), (None, ("incorrect", 0.0, "", True)), ('{"grade": {"x": 1}}', ("incorrect", 0.0, "", True)), ('{"grade": "incorrect", "n": 2.5}', ("incorrect", 0.0, "", False)),
]
CONTROLLER = [
    ('{"sufficient": false, "next_query": "who?", "reason": "r"}', (False, "who?", "r", False)), ('{"sufficient": true, "next_query": "who?"}', (True, None, "", False)),
    ('{"sufficient": "true", "next_query": null}', (True, None, "", True)), ('{"sufficient": false, "next_query": 3}', (True, None, "", True)), ('{"sufficient": false, "next_query": null}', (False, None, "", False)),
    ("{", (True, None, "", True)), (None, (True, None, "", True)), ('{"next_query": "x"}', (True, None, "", True)), ('[{"sufficient": false}]', (True, None, "", True)),
]


@pytest.mark.parametrize(("parse", "cases"), [(text.parse_judge, JUDGE), (text.parse_controller, CONTROLLER)])
def test_replies_are_read_strictly(spark, parse, cases):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(cases)], "i int, raw string")
    got = {r["i"]: tuple(r["x"]) for r in df.select("i", parse(F.col("raw")).alias("x")).collect()}
    assert got == {i: want for i, (_, want) in enumerate(cases)}


def test_folding(spark):
    df = spark.createDataFrame([("Straße ﬁ Ⅷ",), ("ASCII",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(text.folded(F.col("t"))).collect()] == ["strasse fi viii", "ascii", None, ""]


def test_facts_to_the_letter(spark):
    from gleanwell.operators import facts

    asked = spark.createDataFrame([("q", i, "d", f) for i, f in enumerate(["A “b”", "a b", "end of one start", "none", None])], "qid string, pos int, doc_id string, fact string")
    texts = spark.createDataFrame([("d", ['x A "b" y', "the end of one", "start of two"])], "doc_id string, parts array<string>")
    assert rows(facts.survival(asked, texts).select("pos", "place")) == [(0, "intact"), (1, "absent"), (2, "across"), (3, "absent"), (4, "absent")]
    page = spark.createDataFrame([("d", 'X a  "B" ﬁne'), ("e", None)], "doc_id string, text string")
    more = spark.createDataFrame([("q", i, "d", f) for i, f in enumerate(["A “b”", "FINE", "zz", ""])], "qid string, pos int, doc_id string, fact string")
    assert rows(facts.grounded(more, page).select("pos", "grounded")) == [(0, True), (1, True), (2, False), (3, False)]


def test_splits_are_disjoint_or_raise(spark):
    df = spark.createDataFrame([(f"q{i}", "ab"[i % 3 == 0]) for i in range(90)], "k string, s string")
    sizes = {"development": (30, 1), "final_holdout": (30, 2), "smoke": (6, 3)}
    got = defaultdict(set)
    for split, k, _ in rows(sampling.splits(df, "k", "s", sizes)):
        got[split].add(k)
    assert {n: len(v) for n, v in got.items()} == {n: v[0] for n, v in sizes.items()} and not got["development"] & got["final_holdout"] and got["smoke"] <= got["development"]
    with pytest.raises(ValueError, match="unique"):
        sampling.splits(df.union(df), "k", "s", sizes)
    with pytest.raises(ValueError, match="both"):
        sampling.ensure_disjoint(df, df, "k")
    with pytest.raises(ValueError, match="not in"):
        sampling.ensure_subset(df, df.filter("s = 'a'"), "k")
    part = rows(sampling.part(df, "k", "s", 0.7, 5).groupBy("s").agg(F.count_if("picked")))
    assert part == [("a", 42), ("b", 21)]


def test_cells_and_examples(spark):
    df = spark.createDataFrame([(f"q{i}", "ab"[i % 2], "xyz"[i % 3], 1 + (i > 5)) for i in range(12)], "k string, t string, r string, tier int")
    quotas = spark.createDataFrame([("a", 2), ("b", 20)], "t string, quota int")
    assert rows(sampling.shortage(df, quotas, ["t"])) == [("b", 20, 6)]
    with pytest.raises(ValueError, match="1 cells"):
        sampling.cells(df, quotas, ["t"], "k", 1)
    assert rows(sampling.cells(df, quotas, ["t"], "k", 1, strict=False).groupBy("t").count()) == [("a", 2), ("b", 6)]
    # tier 1 first: q0 (a, x), then the most new values, then what is left by key
    assert [k for k, _ in sorted(rows(sampling.diverse(df, "k", ["t", "r"], "tier", 5)), key=lambda x: x[1])] == ["q0", "q1", "q2", "q3", "q4"]
    assert sampling.diverse(df.filter("false"), "k", ["t", "r"], "tier", 5).count() == 0


def test_thresholds(spark):
    rng = random.Random(2)
    data = [(f"q{i}", rng.random(), rng.random(), rng.choice(["SIMPLE", "MEDIUM", "COMPLEX"])) for i in range(60)]
    df = spark.createDataFrame(data, "k string, p1 double, p2 double, true_route string")
    costs = {"SIMPLE": 1.0, "MEDIUM": 2.0, "COMPLEX": 5.0}
    order = list(costs)
    grid = {(r["tau1"], r["tau2"]): r for r in model.threshold_grid(df, costs).collect()}
    assert len(grid) == 95 * 95
    for a, b in ((0.05, 0.05), (0.5, 0.3), (0.99, 0.99), (0.31, 0.77)):
        step = lambda x: min(math.floor(x * 100 + 1e-9), 100) / 100
        said = [0 if step(p) >= a else 1 if step(q) >= b else 2 for _, p, q, _ in data]
        true = [order.index(t) for *_, t in data]
        r = grid[(a, b)]
        assert (r["cost"], r["under"], r["over"], r["right"]) == (sum(costs[order[x]] for x in said), sum(x < y for x, y in zip(said, true)), sum(x > y for x, y in zip(said, true)), sum(x == y for x, y in zip(said, true)))
    best = model.best_thresholds(model.threshold_grid(df, costs), 12).first()
    assert best["cost"] == min(r["cost"] for r in grid.values() if r["under"] <= 12)
    with pytest.raises(ValueError, match="no pair"):
        model.best_thresholds(model.threshold_grid(df, costs), -1)
    values = sorted(p for _, p, _, _ in data)
    assert [r[0] for r in rows(model.quantiles(df, "p1", "k", [0.1, 0.5, 0.9]))] == [values[round(f * 59)] for f in (0.1, 0.5, 0.9)]
    assert model.quantiles(df.filter("false"), "p1", "k", [0.5]).count() == 0


def test_runs_are_merged_and_keys_required(spark):
    a, b = spark.createDataFrame([("x", "good", 1), ("y", "bad", 1)], "k string, grade string, n int"), spark.createDataFrame([("y", "good", 2), ("z", None, 2)], "k string, grade string, n int")
    assert rows(upkeep.merged([a, b], "k")) == [("x", "good", 1), ("y", "good", 2), ("z", None, 2)]
    with pytest.raises(ValueError, match="1 keys"):
        upkeep.merged([a, b], "k", "grade")
    upkeep.require(a, a, "k")
    with pytest.raises(ValueError, match="such as"):
        upkeep.require(b, a, "k")
    assert rows(upkeep.renamed(a, "grade", {"bad": "poor"}).select("grade")) == [("good",), ("poor",)] and upkeep.renamed_columns(a.withColumnRenamed("n", "old_n"), {"old": "new"}).columns == ["k", "grade", "new_n"]


def test_corrected_intervals(spark):
    assert statistics.bonferroni(0.05, 2) == 0.025
    with pytest.raises(ValueError, match="comparison"):
        statistics.bonferroni(0.05, 0)
    df = spark.createDataFrame([(1.0, 2.0), (-1.0, 2.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(statistics.excludes_zero(F.col("a"), F.col("b"))).collect()] == [True, False, False, None]
