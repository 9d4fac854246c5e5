import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanwell.llm import leakage, lookalikes, near_duplicates, packing, page_body, quota_sample, repeated_lines, split_overlap
from gleanwell.llm.lookalikes import plain

WORD = re.compile(r"[^\W_]+")
CORPUS = "corpus_id bigint, url string, source string, author string, title string, body string, line_no string, key string"


def pairs(df):
    out = [tuple(r) for r in df.collect()]
    assert len(out) == len(set(out))
    return set(out)


def corpus(spark, rows):
    """rows: (id, url, body)."""
    return spark.createDataFrame([(i, u, None, None, None, b, "x", "y") for i, u, b in rows], CORPUS)


# --- 1


def sample_tables(spark, rows, size, targets):
    plans = spark.createDataFrame([(1, size)], "plan_id int, sample_size int")
    t = spark.createDataFrame([(1, *x) for x in targets], "plan_id int, question_type string, hop_count int, target_share double, min_rows int")
    return spark.createDataFrame(rows, "qa_id string, question_type string, hop_count int, rank int"), plans, t


def test_sample_meets_targets_minimums_and_redistributes(spark):
    rows = [(f"a{i}", " Null-Query", 0, 1) for i in range(600)] + [(f"b{i}", "temporal_query", 2, 1) for i in range(30)] + [(f"c{i}", "TEMPORAL QUERY", 3, 1) for i in range(100)]
    rows += rows[:50] + [(None, "null_query", 0, 1), ("z", None, 0, 1), ("z", "null_query", None, 1), ("z", "", 1, 1), ("z", "unknown", 1, 1)]
    data = sample_tables(spark, rows, 100, [("null_query", 0, 0.5, 0), ("temporal_query", 2, 0.4, 0), ("temporal_query", 3, 0.1, 15), ("comparison_query", 2, 0.0, 3)])
    got = {(r["question_type"], r["hop_count"]): r for r in quota_sample.report(*data).collect()}
    assert {k: (r["needed"], r["available"], r["short"]) for k, r in got.items()} == {("null_query", 0): (50, 600, 0), ("temporal_query", 2): (40, 30, 10), ("temporal_query", 3): (15, 100, 0), ("comparison_query", 2): (3, 0, 3)}
    drawn = {k: r["drawn"] for k, r in got.items()}
    assert drawn[("temporal_query", 2)] == 30 and drawn[("temporal_query", 3)] == 15 and drawn[("null_query", 0)] == 55
    sample = pairs(quota_sample.draw(*data).select("question_type", "hop_count", "qa_id"))
    again = pairs(quota_sample.draw(data[0].repartition(7), *data[1:]).select("question_type", "hop_count", "qa_id"))
    assert sample == again and len(sample) == 100


def test_shares_are_scaled_and_parts_count_as_one(spark):
    rows = [(f"q{i}", "null_query", i % 3, 1) for i in range(60)]
    half = sample_tables(spark, rows, 10, [("null_query", k, x, 0) for k, x in ((0, 0.1), (1, 0.15), (2, 0.25))])
    whole = sample_tables(spark, rows, 10, [("null_query", k, x, 0) for k, x in ((0, 0.2), (1, 0.3), (2, 0.5))])
    assert pairs(quota_sample.report(*half)) == pairs(quota_sample.report(*whole))
    thirds = sample_tables(spark, rows, 10, [("null_query", k, 1.0, 0) for k in range(3)])
    assert {(r["needed"], r["short"]) for r in quota_sample.report(*thirds).collect()} == {(4, 0)} and quota_sample.draw(*thirds).count() == 10


def test_sample_of_nothing(spark):
    data = sample_tables(spark, [], 10, [("null_query", 0, 1.0, 2)])
    assert quota_sample.draw(*data).count() == 0 and [r["short"] for r in quota_sample.report(*data).collect()] == [10]
    assert quota_sample.report(data[0], data[1].filter("false"), data[2].filter("false")).count() == 0


def test_minimums_beyond_the_size(spark):
    data = sample_tables(spark, [(f"q{i}", "null_query", i % 2, 1) for i in range(40)], 6, [("null_query", 0, 0.5, 5), ("null_query", 1, 0.5, 5)])
    assert sorted(r["drawn"] for r in quota_sample.report(*data).collect()) == [3, 3]


def test_shortage_follows_from_the_ranks(spark, monkeypatch):
    real = quota_sample.spread_rank
    monkeypatch.setattr(quota_sample, "spread_rank", lambda df, group, order, bucket, name: real(df, group, order, bucket, name).filter(F.col(name) <= 7))
    data = sample_tables(spark, [(f"q{i}", "null_query", i % 2, 1) for i in range(80)], 20, [("null_query", 0, 0.5, 0), ("null_query", 1, 0.5, 0)])
    assert [(r["needed"], r["available"], r["short"]) for r in quota_sample.report(*data).collect()] == [(10, 40, 3)] * 2


# --- 2


def lines_model(rows, least):
    site = lambda u: re.sub(r"^(www|m|amp)\.", "", re.match(r"https?://([^/]+)", u)[1])
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    n = Counter((site(u), k) for _, u, b in rows if b for k in {key(x) for x in b.split("\n")} if k)
    return {(i, no) for i, u, b in rows if b for no, x in enumerate(b.split("\n"), 1) if key(x) and n[(site(u), key(x))] >= least}


def boilerplate(n=60, hot=0.5):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        host = "hot.example" if rng.random() < hot else rng.choice(["a.example", "b.example"])
        lines = [f"Unique text number {chr(97 + i % 26) * (1 + i // 26)}", "", "Share this!", "SHARE  this", "123"] + (["All rights reserved.", f"© {i} Hot News"] if rng.random() < 0.7 else [])
        rows.append((i, f"https://{rng.choice(['www.', 'm.', 'amp.', ''])}{host}/x{i}", "\n".join(lines)))
    return [*rows, (900, "https://hot.example/n", None), (901, "https://hot.example/e", ""), (902, "https://hot.example/w", "\n\n")]


def test_repeated_lines_equal_a_model(spark):
    rows = boilerplate()
    mined = repeated_lines.mine(corpus(spark, rows), 10, 10)
    assert pairs(repeated_lines.repeated_places(mined)) == lines_model(rows, 10)
    assert {r["length"] for r in mined.patterns.collect()} >= {1, 2, 3}
    clean = {r["corpus_id"]: r for r in repeated_lines.without_repeated_lines(corpus(spark, rows), mined).collect()}
    assert clean[900]["clean_body"] is None and clean[901]["clean_body"] == "" and clean[902]["clean_body"] == "\n\n" and clean[0]["title"] is None
    gone = lines_model(rows, 10)
    for i, _, b in rows:
        if b:
            assert clean[i]["clean_body"] == "\n".join(x for no, x in enumerate(b.split("\n"), 1) if (i, no) not in gone)


def sequences_model(rows, least, gap):
    """Support of every line sequence with at most gap frequent lines between two of its lines; rows are of one site."""
    key = lambda x: "".join(c for c in x.lower() if c.isalpha())
    n = Counter(k for _, _, b in rows for k in {key(x) for x in b.split("\n")} if k)
    support = defaultdict(set)
    for i, _, b in rows:
        page = [key(x) for x in b.split("\n") if n[key(x)] >= least and key(x)]
        ends = {((k,), at) for at, k in enumerate(page)}
        while ends:
            for p, _ in ends:
                support[p].add(i)
            ends = {((*p, page[x]), x) for p, at in ends for x in range(at + 1, min(at + gap + 2, len(page)))}
    return {p: len(v) for p, v in support.items() if len(v) >= least}


def test_sequences_with_gaps_equal_a_model(spark):
    rng = random.Random(11)
    lines = [f"line {'abcdefg'[i]}" for i in range(7)]
    rows = [(i, "https://s.example/x", "\n".join([x for x in lines if rng.random() < 0.7] + [f"own {'abcdefghijklmnopqrstuvwxyz'[i]}"])) for i in range(26)]
    for gap in (0, 1):
        mined = repeated_lines.mine(corpus(spark, rows), 4, 4, gap)
        want = sequences_model(rows, 4, gap)
        # a few of the rarest are absorbed by longer ones of the same pages; all others come out
        got, all_ = Counter((r["length"], r["docs"]) for r in mined.patterns.collect()), Counter((len(p), n) for p, n in want.items())
        assert not got - all_ and sum((all_ - got).values()) <= 0.1 * len(want) and all(n < 9 for _, n in all_ - got) and (gap == 0 or max(k for k, _ in got) > 4)


def test_sequences_need_less_support_than_lines(spark):
    # one other line may stand between the two; single lines alone would delete nothing
    rows = [(i, "https://s.example/x", f"alpha\n{'gamma' if i % 2 else 'own ' + 'abcdefghij'[i]}\nbeta" if i < 4 else f"alpha\nown {'abcdefghij'[i]}") for i in range(6)]
    mined = repeated_lines.mine(corpus(spark, rows), 7, 3)
    assert pairs(repeated_lines.repeated_places(mined)) == {(i, n) for i in range(4) for n in (1, 3)}
    assert pairs(repeated_lines.repeated_places(repeated_lines.mine(corpus(spark, rows), 7, 7))) == set()


def test_sequences_of_any_length(spark):
    line = lambda n: f"line {'abcdefghijklmnopqrstuvwxyz'[n]}"
    rows = [(i, "https://s.example/x", "\n".join(["own " + "xyzuvw"[i]] + [line(n) for n in range(20)][: 20 - 8 * (i > 3)])) for i in range(6)]
    mined = repeated_lines.mine(corpus(spark, rows), 4, 4)
    # what always stands together grows as one sequence, not as all its parts
    got = {r["length"]: r["docs"] for r in mined.patterns.filter("length > 1").collect()}
    assert got == {k: 6 if k <= 12 else 4 for k in range(2, 21)} and mined.patterns.filter("length > 1").count() < 30
    assert pairs(repeated_lines.repeated_places(mined)) == {(i, n + 2) for i in range(6) for n in range(20 - 8 * (i > 3))}


def test_no_lines_at_all(spark):
    empty = corpus(spark, [])
    assert repeated_lines.repeated_places(repeated_lines.mine(empty)).count() == 0
    assert repeated_lines.without_repeated_lines(empty, repeated_lines.mine(empty)).count() == 0


def test_lines_by_shuffle_equal_lines_by_broadcast(spark, monkeypatch):
    import gleanwell.operators.skew as skew

    rows = boilerplate(40)
    want = pairs(repeated_lines.repeated_places(repeated_lines.mine(corpus(spark, rows), 5, 5)))
    real = skew.join_counted
    monkeypatch.setattr(repeated_lines, "join_counted", lambda *a: real(*a, bound=0))
    assert pairs(repeated_lines.repeated_places(repeated_lines.mine(corpus(spark, rows), 5, 5))) == want


# --- 3


def near_rows():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    rows, base = [], [rng.choices(words, k=120) for _ in range(12)]
    for i in range(90):
        w = list(base[i % 12])
        for _ in range(rng.choice([0, 1, 3, 6])):
            at = rng.randrange(len(w))
            w[at : at + rng.choice([0, 1])] = [rng.choice(words)]
        rows.append((i, " ".join(w)))
    copy = " ".join(rng.choices(words, k=50))
    rows += [(200 + i, copy.upper() if i % 2 else copy + " !") for i in range(40)]  # a hot group of copies
    return [*rows, (300, None), (301, ""), (302, "two words"), (303, "two words"), (304, "x y z " * 30_000)]


def jaccard_model(rows, k, share):
    s = {}
    for i, t in rows:
        w = WORD.findall((t or "").lower())
        s[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return {(a, b) for a, b in itertools.combinations(sorted(s), 2) if s[a] and s[b] and len(s[a] & s[b]) >= share * len(s[a] | s[b])}


@pytest.mark.parametrize(("share", "k"), [(0.5, 3), (0.8, 5)])
def test_near_duplicates_equal_brute_force(spark, share, k):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, 0, "r") for i, t in rows], "doc bigint, text string, id int, rep string")
    links = near_duplicates.link(df, "doc", F.col("text"), share, k)
    want = jaccard_model(rows, k, share)
    assert pairs(near_duplicates.record_pairs(links, k)) == want and links.recall > 0.99
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in sorted(want):
        parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r["id"]: r["group_id"] for r in near_duplicates.groups(links).collect()}
    assert {i: g for i, g in got.items() if i < 300} == {i: root(i) for i in got if i < 300} and got[302] == got[303] == 302


def test_close_copies_do_not_hide_borderline_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(200):  # pairs of similarity 61/119 to 63/117
        w = [f"p{i}w{j}" for j in range(92)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 63 + i % 3] + [f"q{i}w{j}" for j in range(29 - i % 3)]))]
    base = [f"c{j}" for j in range(150)]
    for i in range(120):  # close copies, 7,140 pairs
        w = list(base)
        w[rng.randrange(150)] = f"d{i}"
        rows.append((1000 + i, " ".join(w)))
    links = near_duplicates.link(spark.createDataFrame(rows, "id bigint, text string"), "id", F.col("text"), 0.5, 3)
    got, want = pairs(near_duplicates.record_pairs(links, 3)), jaccard_model(rows, 3, 0.5)
    border = {(a, b) for a, b in want if a < 1000}
    assert len(border) == 200 and got <= want and len(got & border) >= 197 and {p for p in want if p[0] >= 1000} <= got


def test_classes_by_shuffle_equal_classes_by_broadcast(spark, monkeypatch):
    import gleanwell.operators.skew as skew

    real = skew.join_counted
    rows = near_rows()
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = pairs(near_duplicates.groups(near_duplicates.link(df, "id", F.col("text"), 0.5, 3)))
    texts = spark.createDataFrame([(i, f"ｔext {i % 4}" if i % 3 else f"text {i % 4}") for i in range(60)], "id bigint, text string")
    alike = pairs(lookalikes.alike_pairs(lookalikes.classes(texts, "id", "text")))
    for module in (near_duplicates, lookalikes):
        monkeypatch.setattr(module, "join_counted", lambda *a: real(*a, bound=0))
        monkeypatch.setattr(module, "BROADCAST_ROWS", 0)
    assert pairs(near_duplicates.groups(near_duplicates.link(df, "id", F.col("text"), 0.5, 3))) == want
    assert pairs(lookalikes.alike_pairs(lookalikes.classes(texts, "id", "text"))) == alike and len(alike) > 100


def test_crowded_nodes_keep_the_recall(spark, monkeypatch):
    rng = random.Random(12)
    shared = [f"s{j}" for j in range(60)]  # half of every text is the same, so that nodes are crowded
    rows = []
    for i in range(150):
        own = [f"o{i // 2}x{j}" for j in range(60)]
        if i % 2:
            at = rng.randrange(40)
            own[at : at + 14] = [f"p{i}y{j}" for j in range(14)]
        rows.append((i, " ".join(shared + own)))
    df = spark.createDataFrame(rows, "id bigint, text string")
    want = jaccard_model(rows, 3, 0.6)
    monkeypatch.setattr(near_duplicates, "CROWD", 20)
    links = near_duplicates.link(df, "id", F.col("text"), 0.6, 3)
    got, crowded = pairs(near_duplicates.record_pairs(links, 3)), links.crowded.collect()
    assert got <= want and len(got) >= 0.995 * len(want) >= 60
    assert crowded and all(r["recall"] >= 0.995 for r in crowded) and 0.995 <= links.recall <= min(r["recall"] for r in crowded)
    # a target that longer prefixes can't meet shortens all of them again
    monkeypatch.setattr(near_duplicates, "trees_for", lambda threshold, target: 40)
    links = near_duplicates.link(df, "id", F.col("text"), 0.6, 3, target=0.99)
    assert len(pairs(near_duplicates.record_pairs(links, 3)) & want) >= 0.99 * len(want) and links.recall >= 0.99
    monkeypatch.setattr(near_duplicates, "trees_for", lambda threshold, target: 25)
    with pytest.raises(ValueError, match="recall"):
        near_duplicates.link(df, "id", F.col("text"), 0.6, 3)


def test_near_duplicates_of_nothing(spark):
    links = near_duplicates.link(spark.createDataFrame([], "id bigint, text string"), "id", F.col("text"))
    assert near_duplicates.record_pairs(links, 5).count() == 0 and near_duplicates.groups(links).count() == 0


# --- 4

PAGE = """Home  Health  Food  Tech
By Ann Lee, Business correspondent
June 3, 2024, 10:00 UTC

Officials in Oslo approved the plan on Monday, and brokers had 20 days to respond. The report drew 700 readers, more than planned.
Sponsored
Why the bold Acme review matters to Oslo
• Nurses in Oslo praised the strict deal.
Read more: How Acme sold the mill in Rome
"We tested every Oslo bridge twice," said Ann Lee, who advises traders, 21.5% above the May figure.
Photo: Max Roe for Acme
Recommended for you
1. Inside the vote that changed Acme
Farmers weigh deal on Rome tram depot
Tags: Acme, Oslo, trams
Log in to leave a comment"""


def test_article_of_a_page(spark):
    rows = [(i, f"https://n.example/{i}", PAGE.replace("Oslo", f"Os{'abcdefghijklmnopqrst'[i]}lo").replace("Acme", f"Ac{'abcdefghijklmnopqrst'[i]}me").replace("mill", "mill" + "x" * i)) for i in range(20)]
    rows += [(50, "https://n.example/n", None), (51, "https://n.example/e", ""), (52, None, "Only one short line"), (53, "https://n.example/l", "One sentence stands here, alone. " * 4000)]
    got = defaultdict(set)
    for i, n in pairs(page_body.furniture(corpus(spark, rows))):
        got[i].add(n)
    for i in range(20):
        assert got[i] == {1, 6, 9, 12, 13, 14, 15, 16}, (i, got[i])
    assert 50 not in got and 51 not in got and got[52] == {1} and 53 not in got
    text = {r["corpus_id"]: r["article"] for r in page_body.articles(corpus(spark, rows)).collect()}
    assert text[51] == "" and text[3].startswith("By Ann Lee") and "Recommended" not in text[3] and 50 not in text
    assert page_body.furniture(corpus(spark, [])).count() == 0


def test_copies_of_an_article_keep_their_paragraphs(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    page = lambda i: PAGE.replace("Oslo", f"Os{letters(i)}lo").replace("Acme", f"Ac{letters(i)}me").replace("mill", f"mill{letters(i)}")
    rows = [(i, f"https://n.example/{i}", None, None, None if i % 2 else f"Title {letters(i)}", page(i), "x", "y") for i in range(20)]
    # 50 copies on 50 sites with one title, 50 with titles of their own, 50 with edits, and 50 without titles
    rows += [(100 + i, f"https://s{i}.example/c", None, None, "One copy", page(100), "x", "y") for i in range(50)]
    rows += [(200 + i, f"https://s{i}.example/d", None, None, f"Copy {letters(i)}", page(200), "x", "y") for i in range(50)]
    rows += [(300 + i, f"https://s{i}.example/e", None, None, "Other copy", page(300).replace("more than", f"{letters(i)} more than"), "x", "y") for i in range(50)]
    rows += [(400 + i, f"https://s{i}.example/f", None, None, None, page(400), "x", "y") for i in range(50)]
    got = defaultdict(set)
    for i, n in pairs(page_body.furniture(spark.createDataFrame(rows, CORPUS))):
        got[i].add(n)
    for r in rows:
        assert got[r[0]] == {1, 6, 9, 12, 13, 14, 15, 16}, (r[0], got[r[0]])


def test_the_score_decides(spark, monkeypatch):
    rows = corpus(spark, prompt_pages())
    got = pairs(page_body.furniture(rows))
    # prompts that read like sentences go, the like of them in an article stays
    assert {n for i, n in got if i == 0} == {1, 2, 5, 6, 7} and {n for i, n in got if i == 39} == {1, 2, 5, 6, 7}
    batches = [r for r in rows.collect() if r["body"]]

    def kept(densities):
        return [page_body.article_lines(r["body"].split("\n"), densities, None) for r in batches]

    dense = {0: 1.0, 1: 0.9, 4: 1.0, 5: 1.0, 6: 0.8}
    whole = kept(dense)
    assert whole[0] == {2, 3, 7}
    monkeypatch.setattr(page_body, "score", lambda lines: float(any(x.kind == "text" for x in lines)))
    assert sum(a != b for a, b in zip(whole, kept(dense))) == len(batches)
    monkeypatch.setattr(page_body, "score", lambda lines: sum(x.points for x in lines))  # no discount for links
    assert sum(a != b for a, b in zip(whole, kept(dense))) == len(batches)


def prompt_pages(n=40):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    body = lambda i: "\n".join([
        "Home  Health  Food  Tech", "We use cookies to measure visits, and you can refuse them.", f"Officials in {letters(i)}ville approved the plan on Monday, and brokers had 20 days to respond to the {letters(i)} offer.",
        f"The report drew {i} readers to {letters(i)}town, more than planned.", "Story continues below.", "Get our letter in your inbox every day.", "Tell us what you think, or write to the desk.", f"Readers of {letters(i)} praised it.",
    ])
    return [(i, f"https://n.example/{i}", body(i)) for i in range(n)]


def test_shares_do_not_depend_on_the_size_of_the_corpus(spark):
    letters = lambda i: "".join("abcdefghij"[int(c)] for c in str(i))
    # one sentence comes in 8 of 2,000 articles of a site: far from every page's furniture
    filler = [(1000 + i, "https://big.example/x", f"The town of {letters(i)} said so on Monday, and more.\nNobody of {letters(i)} agreed with it, as it happens." + "\nThe ministry declined to comment on the case." * (i < 8)) for i in range(2000)]
    got = pairs(page_body.furniture(corpus(spark, [*prompt_pages(), *filler])))
    assert not {x for x in got if x[0] >= 1000} and {n for i, n in got if i == 3} == {1, 2, 5, 6, 7}


# --- 5


def question_rows():
    rng = random.Random(6)
    words = [f"t{i}" for i in range(40)]
    out = []
    for i in range(160):
        w = rng.sample(words, rng.randint(1, 14))
        out.append((f"k{i}", rng.random() < 0.6, rng.random() < 0.5, " ".join(w)))
        if rng.random() < 0.5:
            out.append((f"m{i}", True, i % 2 == 0, " ".join([*w[1:], rng.choice(words)]).upper()))
    out += [(f"h{i}", i % 2 == 0, i % 2 == 1, "the same words come again") for i in range(60)]  # a hot class
    return [*out, ("n1", True, True, None), ("n2", True, False, ""), ("n3", False, True, "..."), out[0]]


def test_overlaps_equal_brute_force(spark):
    rows = question_rows()
    df = spark.createDataFrame([(*r, "x") for r in rows], "key string, left boolean, right boolean, text string, term string")
    s = {k: frozenset(WORD.findall((t or "").lower())) for k, _, _, t in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] and b[2] and s[a[0]] and 10 * len(s[a[0]] & s[b[0]]) >= 8 * len(s[a[0]] | s[b[0]])} | {("n1", "n1")}
    assert pairs(split_overlap.overlaps(df)) == want


@pytest.mark.parametrize(("threshold", "together"), [(0.6, 2), (0.9, 2), (0.9, 3), (0.7, 1)])
def test_weighted_cosine_equals_brute_force(spark, threshold, together):
    rows = [r for r in question_rows() if r[0] != "n1"]
    vecs = split_overlap.vectors(spark.createDataFrame(rows, "key string, left boolean, right boolean, text string"), "idf")
    sets = {k: frozenset(WORD.findall((t or "").lower())) for k, _, _, t in rows}
    classes = {s for s in sets.values() if s}
    df = Counter(w for s in classes for w in s)
    weight = lambda w: np.log(1 + len(classes) / df[w])
    norm = lambda s: np.sqrt(sum(weight(w) ** 2 for w in s))
    cos = lambda a, b: sum(weight(w) ** 2 for w in a & b) / (norm(a) * norm(b))
    want = {(a[0], b[0]) for a in rows for b in rows if a[1] and b[2] and sets[a[0]] and sets[b[0]] and cos(sets[a[0]], sets[b[0]]) >= threshold - 1e-9}
    assert pairs(split_overlap.record_pairs(vecs, split_overlap.class_pairs(vecs, threshold, together))) == want


def test_overlaps_of_nothing(spark):
    df = spark.createDataFrame([], "key string, left boolean, right boolean, text string")
    assert split_overlap.overlaps(df).count() == 0


# --- 6


def check_boxes(rows, capacity, segments, loss):
    boxes = defaultdict(lambda: [0, 0, 0])
    for r in rows:
        b = boxes[r["container_id"]]
        b[0], b[1], b[2] = b[0] + r["n_tokens"], b[1] + 1, b[2] + r["loss_tokens"]
    assert all(t <= capacity and (s == 1 or s <= segments and q <= loss) for t, s, q in boxes.values())
    # no packing needs fewer than the tokens fill, or than there are pieces of over half a container
    least = max(-(-sum(b[0] for b in boxes.values()) // capacity), sum(2 * r["n_tokens"] > capacity for r in rows))
    return len(boxes) / least


def test_containers_are_valid_and_full(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(["word"] * rng.choice([3, 10, 40, 90, 200])), "d") for i in range(400)]
    docs += [(1000, "Question: a b c\n\nAnswer: d e f"), (1001, None), (1002, ""), (1003, "  "), (1004, "long text " * 1000)]
    docs = [(d[0], d[1], "d") for d in docs]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, tokens string")
    caps = spark.createDataFrame([(1, 128), (2, 512)], "capacity_id int, capacity_tokens int")
    packed = packing.pack(df, "doc_id", "text", caps)
    counts = {r["id"]: r for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert counts[1001]["tokens"] == counts[1002]["tokens"] == 0 and 0 < counts[1000]["loss"] < counts[1000]["tokens"]
    for cid, cap in ((1, 128), (2, 512)):
        rows = packed.filter(F.col("capacity_id") == cid).collect()
        by = defaultdict(list)
        for r in rows:
            by[r["doc_id"]].append(r)
        assert set(by) == {d[0] for d in docs}
        for i, ps in by.items():
            ps.sort(key=lambda r: r["piece_no"])
            assert sum(p["n_tokens"] for p in ps) == counts[i]["tokens"] and sum(p["loss_tokens"] for p in ps) == counts[i]["loss"]
            assert len(ps) == ps[0]["n_pieces"] == max(1, -(-counts[i]["tokens"] // cap)) and [p["first_token"] for p in ps] == [k * cap for k in range(len(ps))]
        assert check_boxes(rows, cap, *packing.limits(cap)) < 1.1
    assert packing.pack(df.filter("false"), "doc_id", "text", caps).count() == 0 and packing.pack(df, "doc_id", "text", caps.filter("false")).count() == 0


def test_filling_keeps_all_limits():
    rng = np.random.default_rng(0)
    t = rng.integers(0, 100, 500)
    q = (t * rng.random(500)).astype(int)
    box, stops = packing.fill(t, q, 200, 4, 90)
    for b in range(box.max() + 1):
        m = box == b
        assert m.sum() == 1 or (t[m].sum() <= 200 and m.sum() <= 4 and q[m].sum() <= 90)
    assert (box >= 0).all() and len(stops) == box.max() + 1 and packing.fill(np.array([5]), np.array([5]), 10, 1, 2)[0].tolist() == [0]


@pytest.mark.parametrize(("tokens", "loss", "stop"), [(60, 0, "tokens"), (10, 1, "segments"), (20, 18, "loss")])
def test_each_limit_closes_containers(tokens, loss, stop):
    box, stops = packing.fill(np.full(40, tokens), np.full(40, loss), 100, 4, 40)
    names = [packing.STOPS[s] for s in stops]
    assert set(names[:-1]) == {stop} and names[-1] in ("last", stop) and np.bincount(box)[0] == {"tokens": 1, "segments": 4, "loss": 2}[stop]


# --- 7


def test_leaks_equal_brute_force(spark):
    rng = random.Random(9)
    words = [f"w{i}é" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([5, 12, 30, 60])))) for i in range(40)] + [(90, None), (91, "")]
    docs = []
    for i in range(150):
        w = rng.choices(words, k=rng.randint(0, 60))
        if i % 2:
            p = rng.choice([x for x in items if x[1]])[1].split()
            n = rng.choice([11, 12, 20])
            at = rng.randrange(max(1, len(p) - n + 1))
            w[10:10] = p[at : at + n]
        docs.append((i, ("," if i % 3 else " ").join(w).replace("w", "ｗ" if i % 5 == 0 else "w")))
    docs += [(500, None), (501, ""), (502, (items[0][1] + " ") * 3000)]
    grams = defaultdict(set)
    for i, p in items:
        w = WORD.findall(plain(p or "").lower())
        for j in range(len(w) - 11):
            grams[tuple(w[j : j + 12])].add(i)
    want = set()
    for d, t in docs:
        w = WORD.findall(plain(t or "").lower())
        want |= {(d, i) for j in range(len(w) - 11) for i in grams[tuple(w[j : j + 12])]}
    df, ev = spark.createDataFrame([(*d, "z") for d in docs], "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, passage string")
    for errors in (0, 2):
        got = leakage.leaks(df, "doc_id", "text", ev, errors=errors)
        assert pairs(got.filter("distance = 0").select("id", "item_id")) == want
    assert leakage.leaks(df, "doc_id", "text", ev.filter("false")).count() == 0 and leakage.leaks(df.filter("false"), "doc_id", "text", ev).count() == 0


def test_edits_within_the_budget_are_found(spark):
    p = " ".join(f"w{i}" for i in range(12))
    texts = [p, p.replace("w5", "x"), p.replace("w5", "x").replace("w9", ""), p.replace("w2", "x").replace("w5", "y").replace("w9", "z"), "a b " + p.replace(" w6", " and w6")]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = leakage.leaks(df, "id", "text", spark.createDataFrame([(1, p)], "item_id bigint, passage string"))
    assert {r["id"]: r["distance"] for r in got.collect()} == {0: 0, 1: 1, 2: 2, 4: 1}


def test_recall_of_edited_passages(spark):
    rng = random.Random(21)
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(200)]
    docs = []
    for i, p in items:
        w = p.split()
        for _ in range(i % 3):
            at, kind = rng.randrange(len(w)), rng.choice("pcd")
            w[at : at + (kind != "p")] = [] if kind == "d" else [f"x{rng.randrange(10**9)}"]
        docs.append((i, " ".join([f"a{j}" for j in range(rng.randrange(9))] + w + ["z"] * rng.randrange(9))))
    got = leakage.leaks(spark.createDataFrame(docs, "id bigint, text string"), "id", "text", spark.createDataFrame(items, "item_id bigint, passage string"))
    found = {r["id"]: r["distance"] for r in got.collect() if r["id"] == r["item_id"]}
    assert set(found) == {i for i, _ in items} and all(found[i] <= i % 3 for i in found)


def test_common_pieces_in_blocks(spark, monkeypatch):
    from gleanwell.operators import skew

    monkeypatch.setattr(skew, "BLOCK", 5)
    monkeypatch.setattr(leakage, "FILTER_BITS", 64)  # a full filter only lets more through
    p = " ".join(f"v{j}" for j in range(12))
    items = [(i, p) for i in range(30)] + [(99, " ".join(f"u{j}" for j in range(12)))]
    df = spark.createDataFrame([(i, f"x {p} y") for i in range(20)] + [(50, "v0 v1 v2 v3 other words")], "id bigint, text string")
    got = leakage.leaks(df, "id", "text", spark.createDataFrame(items, "item_id bigint, passage string"))
    assert pairs(got) == {(d, i, 0) for d in range(20) for i in range(30)}


# --- 8


def test_equal_looking_texts_are_one_class(spark):
    alike = ["Café fi 12-3", "Café ﬁ 12-3", "Ｃａｆé fi 12-3", "Саfé fi 12‑3", "Ca​fé fi 12-3", "𝐂𝐚𝐟é fi 12-3"]
    other = ["Cafe fi 12-3", "café fi 12-3", "Café fi 12-4", "Café fi 12-3.", "Café\nfi 12-3"]
    rows = list(enumerate(alike + other)) + [(50 + i, alike[i % 2]) for i in range(30)] + [(90, None), (91, ""), (92, " ​ "), (93, "​"), (94, "ё"), (95, "ë")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc bigint, text string, cls string")
    members = lookalikes.classes(df, "doc", "text")
    texts = {i: t for i, t in rows if t and t.strip() and i not in (92, 93)}
    same = [i for i in texts if plain(texts[i]) == plain(alike[0])]
    want = {(a, b) for a, b in itertools.combinations(same, 2) if texts[a] != texts[b]} | {(94, 95)}
    assert len(same) == 36 and pairs(lookalikes.alike_pairs(members)) == want
    forms = {r["id"]: r["text"] for r in lookalikes.with_canonical(df, "doc", "text", members).collect()}
    assert {forms[i] for i in same} == {alike[0]} and forms[7] == other[1] and forms[90] is None and forms[91] == "" and forms[94] == forms[95] and len(forms) == len(rows)
    assert lookalikes.classes(df.filter("false"), "doc", "text").count() == 0


def test_plain_forms_are_stable():
    for t in ["Straße ẞ", "по данным Ё й ї", "Ελλάδα ώ ς", "a\r\nb c", "½ ² …", "A\tB", ""]:
        assert plain(plain(t)) == plain(t)
    assert plain("a\r\nb c") == "a\nb\nc" and plain("é") != plain("e") and plain("A") != plain("a")
