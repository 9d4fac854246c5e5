"""The article of a page without its furniture: tree scoring over a page of text lines.

A page of plain lines has neither elements nor links, so both are estimated. The link density of a line, the share of it that would be
link text, comes from the corpus: from the share of its site's articles, and of all articles, that hold the same letters (a line that
many articles have belongs to the page around them), and from its label, if it has one, in the same way ("Read more: ..."); a bar of short
entries and an arrow are links by their form, and an unfinished line, a headline or a subheading, may be one.

The tree: the page holds containers, a container holds lines. Lines that are mostly links, whether sentences or not, stand in containers
of their own, headings of lists gather the unfinished lines behind them, and sentences with their subheadings form text containers,
which a single link line does not cut, but a list or two link lines in a row do. Every sentence passes points for its length and
its commas, less its link density, to its container and half of them to the page; a container's score is its points less its link density.
The best of all containers and the page sets the measure: a container is part of the article if its score comes up to a fair share of
what a sentence of the best has. Bylines, date lines and photo credits stay with the article.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_counted
from ..runtime import materialise
from .sites import line_keys, site_of

#: Shares of a site's articles and of all articles from which a line counts as link text throughout; lower shares count in proportion.
SITE_SHARE, ALL_SHARE = 0.02, 0.005
#: Articles that a line must be in before its share says anything, and articles that every site is thought to have besides.
LEAST_ARTICLES, PRIOR_ARTICLES = 3, 10
#: Link density of an unfinished line: headlines may be links, subheadings are not.
OPEN_DENSITY = 0.3
#: Density from which a line is no part of a text container.
LINK = 0.5
#: Words from which a line without a full stop is prose rather than a headline.
LONG_LINE = 18
#: Share of the points of the best container's lines, on average, that a container needs.
FAIR = 0.15

# How credits and date lines of an article begin.
CREDITS = ("by", "written by", "words", "photo", "photos", "photograph", "picture", "image", "reporting by", "text")
# Words a date line may hold beside numbers and months.
DATE_WORDS = {"published", "updated", "last", "modified", "posted", "first", "on", "at", "utc", "gmt", "am", "pm", "edt", "est", "cet"}
# Months by their first three letters, and weekdays.
MONTHS = {"jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"}
WEEKDAYS = {"monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"}

_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*")
_EDGE = re.compile(r"^[\s\[\]*•>\-–|·]+|[\s\[\]|·]+$")
_SENTENCE = re.compile(r"[.!?…][\"”’')\]]*$|[\"”]$")
_BARS = re.compile(r"\s+[/|·\-–>»]\s+|\s*[|·»]\s*|\s{2,}|\t")
_INNER = re.compile(r"[a-z][.!?][\"”’')]*\s+[\"“‘'(]*[A-ZÀ-Þ]")
_PATH = re.compile(r"\s[>»/]\s")
_YEAR = re.compile(r"\b(?:19|20)\d\d\b")
_NUMBERED = re.compile(r"\s*\d+[.)]\s")
#: What stands before the first colon of a line, if that is short.
_LABEL = r"^[^\p{L}]*(\p{L}[^:]{1,24}):\s"


def _is_date(words: list[str], line: str) -> bool:
    if not words or len(words) > 12 or not _YEAR.search(line):
        return False
    return all(w[0].isdigit() or w[:3] in MONTHS or w in DATE_WORDS or w in WEEKDAYS for w in words)


def _is_credit(words: list[str], line: str) -> bool:
    low = " ".join(words)
    if not words or len(words) > 14:
        return False
    if low.endswith(" reports") and len(words) <= 6:
        return True
    for c in CREDITS:
        if low.startswith(c + " ") and (c in ("by", "written by", "reporting by") or line.lower().startswith(c + ":")):
            return len(words) <= 10 and not re.search(r"\byou\b|\bour\b|\bwe\b", low)
    return False


class Form(NamedTuple):
    """What a line's form alone says: kind (open, text or credit), link density, points, chars, whether it can head a list, and its words if they are few."""

    kind: str
    density: float
    points: float
    chars: int
    heads: bool
    numbered: bool
    words: tuple[str, ...]


def _points(bare: str) -> float:
    return 1 + bare.count(",") + min(len(bare) / 100, 3.0)


def _form(line: str) -> Form:
    bare = _EDGE.sub("", line)
    finished = bool(_SENTENCE.search(bare))
    if finished and bare.count(" ") >= 2 * LONG_LINE:  # a long sentence is nothing else
        return Form("text", 0.0, _points(bare), len(bare), False, False, ())
    words = [w.lower() for w in _WORD.findall(bare)]
    density, points = 0.0, 0.0
    if _is_date(words, bare) or _is_credit(words, bare):
        kind = "credit"
    elif len(words) >= 3 and (finished or len(words) >= LONG_LINE or _INNER.search(bare)):
        kind, points = "text", _points(bare)
    else:
        kind, density = "open", OPEN_DENSITY
    parts = [p for p in _BARS.split(bare.strip()) if p]
    path = len(parts) >= 3 and len(_PATH.findall(bare)) >= 2 and len(_WORD.findall(parts[0])) <= 2
    bar = len(parts) >= 3 and sum(len(_WORD.findall(p)) for p in parts) <= 3 * len(parts)
    if kind != "credit" and (not words or line.lstrip(" [*•").startswith((">>", "»")) or (path or bar) and not finished):
        density = 1.0
    return Form(kind, density, points, len(bare), len(words) <= 6, bool(_NUMBERED.match(line)), tuple(words) if len(words) <= 14 else ())


#: Short lines come back on many pages; the last of them are remembered.
_short_form = lru_cache(1 << 14)(_form)


class Line:
    """One line that is not blank: its form, with the link density that the corpus gives it and the credit that the author's name makes."""

    __slots__ = ("chars", "density", "heads", "kind", "numbered", "points")

    def __init__(self, line: str, density: float, author: tuple[str, ...]):
        f = _short_form(line) if len(line) <= 200 else _form(line)
        self.kind, self.points, self.chars, self.heads, self.numbered = f.kind, f.points, f.chars, f.heads, f.numbered
        self.density = 0.0 if f.kind == "credit" else max(f.density, density)
        n = len(author)
        if n and n <= len(f.words) <= n + 5 and any(f.words[i : i + n] == author for i in range(len(f.words) - n + 1)):
            self.kind, self.density, self.points = "credit", 0.0, 0.0

    @property
    def link(self) -> bool:
        """Whether it is mostly a link and so no part of a text container."""
        return self.density >= LINK


def score(lines: list[Line]) -> float:
    """What lines pass on to a node above them: their points less their own link density, less that of the node."""
    density = sum(x.density * x.chars for x in lines) / max(1, sum(x.chars for x in lines))
    return sum(x.points * (1 - x.density) for x in lines) * (1 - density)


def containers(lines: list[Line]) -> list[list[int]]:
    """The containers of a page as places among its lines; every line but credits is in one."""
    out: list[list[int]] = []
    body = gathering = None  # the text container and the list that still go on
    links = 0
    for i, x in enumerate(lines):
        if x.kind == "credit":
            gathering = None
            continue
        if x.link:
            links += 1
            if links > 1 and body and lines[body[-1]].kind == "text":
                body = None
            out.append([i])
            gathering = out[-1] if x.heads else None
            continue
        ahead = [y.kind for y in lines[i + 1 :] if not y.link][:1]
        if x.kind == "open" and (x.numbered or gathering is not None and (len(gathering) > 1 or ahead in ([], ["open"]))):
            body = None
            if gathering is None:
                gathering = []
                out.append(gathering)
            gathering.append(i)
        else:  # a sentence, or a subheading
            gathering, links = None, 0
            if body is None:
                body = []
                out.append(body)
            body.append(i)
    return out


def article_lines(lines: list[str], densities: dict[int, float], author: str | None) -> set[int]:
    """Places, from 0, of the lines that are the article; blank lines are none. densities: those estimated from the corpus, by place."""
    by = tuple(w.lower() for w in _WORD.findall(author or ""))
    full = [i for i, x in enumerate(lines) if x.strip()]
    read = [Line(lines[i], densities.get(i, 0.0), by) for i in full]
    tree = containers(read)

    scores = [score([read[i] for i in c]) for c in tree]
    nodes = [(s, sum(read[i].kind == "text" for i in c)) for s, c in zip(scores, tree)]
    nodes.append((score([x for x in read if x.kind != "credit"]) / 2, sum(x.kind == "text" for x in read)))
    best, texts = max(nodes)
    fair = FAIR * best / max(1, texts)
    kept = {full[i] for c, s in zip(tree, scores) if 0 < fair <= s for i in c}
    return kept | {full[i] for i, x in enumerate(read) if x.kind == "credit"}


def _furniture_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, numbers = [], []
        for key, body, author, marked in zip(*(batch.column(i).to_pylist() for i in range(4))):
            lines = body.split("\n")
            kept = article_lines(lines, {x["pos"]: x["density"] for x in marked or ()}, author)
            out = [i + 1 for i, x in enumerate(lines) if x.strip() and i not in kept]
            ids.extend([key] * len(out))
            numbers.extend(out)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int64())], names=["corpus_id", "line_no"])


def _densities(corpus: DataFrame) -> DataFrame:
    """(corpus_id, marked): per page the places, from 0, of the lines and labels that many articles have, with their link density.

    A line's articles are the distinct titles of its pages, or the distinct longest lines beside it if these are fewer, so neither a
    new title nor an edit makes a copy an article of its own. A page without a title has that longest line for one. Lines are compared
    by their letters, without the name of the site.
    """
    letters = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}]+", "")
    site = site_of(F.col("url"), F.col("source"))
    titled = F.when(letters(F.col("title")) != "", F.xxhash64(letters(F.col("title"))))
    sizes = corpus.groupBy(site.alias("site"), letters(F.col("source")).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    usual = F.max_by("name", F.struct(F.col("name") != "", "n", "name"))
    names = materialise(sizes.groupBy("site").agg(usual.alias("name"), F.sum("n").alias("n")), "names")
    rows, total = names.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    pages = corpus.select("corpus_id", site.alias("site"), "body", titled.alias("title")).filter(F.col("body").isNotNull())
    article = F.coalesce("title", F.xxhash64("body"))
    heads = materialise(pages.select(F.xxhash64("site").alias("site"), article.alias("article")).distinct(), "articles")
    named = join_counted(pages, names, ["site"], "n", rows, total).select("corpus_id", F.xxhash64("site").alias("site"), "title", _masked(line_keys(F.col("body")), F.col("name")).alias("keys"), F.split(F.col("body"), "\n", -1).alias("lines"))
    marked = F.when(F.instr("line", ":").between(3, 40), F.regexp_extract("line", _LABEL, 1))
    label = F.when(F.col("label") != "", F.concat(F.lit(":"), letters(F.col("label"))))

    def lines(df: DataFrame, *keep: str) -> DataFrame:
        """One row per line with its letters, and one more per label; part is the share of the line that the key speaks for."""
        flat = df.select(*keep, F.posexplode(F.arrays_zip(F.col("keys").alias("key"), F.col("lines").alias("line"))).alias("pos", "x")).filter(F.col("x.key") != "")
        flat = flat.select(*keep, "pos", F.col("x.key").alias("key"), F.col("x.line").alias("line")).select(*keep, "pos", "key", "line", marked.alias("label"))
        flat = flat.select(*keep, "pos", "key", label.alias("other"), (1 - F.length("label") / F.length("line")).alias("part"))
        own, other = (F.struct(k.alias("key"), p.alias("part")) for k, p in ((F.col("key"), F.lit(1.0)), (F.col("other"), F.col("part"))))
        flat = flat.select(*keep, "pos", F.explode(F.when(F.col("other").isNull(), F.array(own)).otherwise(F.array(own, other))).alias("k")).filter(F.col("k.key") != "")
        return flat.select(*keep, "pos", F.col("k.part").alias("part"), F.xxhash64("k.key").alias("h"), F.hash("k.key").alias("g"))

    # more places than pages is no matter here: articles are counted below
    counts = lines(named).groupBy("h", "g").agg(F.count(F.lit(1)).alias("pages"))
    often = materialise(counts.filter(F.col("pages") >= LEAST_ARTICLES), "lines")
    rows, total = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("pages"), F.lit(0))).first()
    longest = F.sort_array(F.transform(F.array_distinct("keys"), lambda k: F.struct(F.length(k).alias("n"), F.xxhash64(k).alias("k"))), asc=False)
    topped = named.withColumn("tops", F.transform(F.slice(longest, 1, 2), lambda x: x["k"]))
    sized = lines(topped, "corpus_id", "site", "title", "tops")
    found = join_counted(sized, often, ["h", "g"], "pages", rows, total)
    first, second = F.get("tops", F.lit(0)), F.get("tops", F.lit(1))
    beside = F.when(first != F.col("h"), first).otherwise(F.coalesce(second, "title", "h"))
    found = materialise(found.select("corpus_id", "site", "pos", "part", "h", "g", F.coalesce("title", beside).alias("title"), beside.alias("beside")), "places")
    articles = F.least(F.count_distinct("title"), F.count_distinct("beside")).alias("articles")
    everything = heads.agg(F.count_distinct("article")).first()[0]
    per_site = heads.groupBy("site").agg(F.count(F.lit(1)).alias("of"))
    local = found.groupBy("h", "g", "site").agg(F.count(F.lit(1)).alias("rows"), articles).filter(F.col("articles") >= LEAST_ARTICLES).join(per_site, "site")
    local = materialise(local.select("h", "g", "site", "rows", _share(F.col("articles"), F.col("of"), SITE_SHARE).alias("density")), "local")
    wide = found.groupBy("h", "g").agg(F.count(F.lit(1)).alias("rows"), articles).filter(F.col("articles") >= LEAST_ARTICLES)
    wide = materialise(wide.select("h", "g", "rows", _share(F.col("articles"), F.lit(everything), ALL_SHARE).alias("density")), "wide")
    marked = None
    for shares, on in ((local, ["h", "g", "site"]), (wide, ["h", "g"])):
        rows, total = shares.agg(F.count(F.lit(1)), F.coalesce(F.sum("rows"), F.lit(0))).first()
        part = join_counted(found, shares, on, "rows", rows, total).select("corpus_id", "pos", (F.col("density") * F.col("part")).alias("density"))
        marked = part if marked is None else marked.unionByName(part)
    strongest = marked.groupBy("corpus_id", "pos").agg(F.max("density").alias("density"))
    return strongest.groupBy("corpus_id").agg(F.collect_list(F.struct("pos", "density")).alias("marked"))


def _masked(keys: Column, name: Column) -> Column:
    """Lines' letters without those of the page's own site name, which says nothing about a line; names of up to 3 letters stay."""
    return F.when(F.length(name) > 3, F.transform(keys, lambda k: F.when(F.contains(k, name), F.replace(k, name, F.lit(""))).otherwise(k))).otherwise(keys)


def _share(n: Column, of: Column, full: float) -> Column:
    """How near the share of other articles with the line is to full: the lower end of its interval (Wilson, 95 %) over full, 1 at most."""
    z, hits, all_ = 1.96, n - 1.0, of - 1.0 + PRIOR_ARTICLES
    p = hits / all_
    low = (p + z * z / (2 * all_) - z * F.sqrt(p * (1 - p) / all_ + z * z / (4 * all_ * all_))) / (1 + z * z / all_)
    return F.least(low / full, F.lit(1.0))


def furniture(corpus: DataFrame) -> DataFrame:
    """(corpus_id, line_no): the lines of body, numbered from 1, blank ones counted but never given, that are not the article.

    Reads corpus_id (unique), url, source, author, title and body. A null or empty body gives no rows; a page without any paragraph is furniture
    but for its credits. Null sources and authors are empty. Bodies are taken whole, whatever their length. Repeated rows are
    pages of their own. Shares count all articles of the corpus; copies of an article are one.
    """
    pages = corpus.select("corpus_id", "body", "author").filter(F.col("body").isNotNull())
    marked = pages.join(_densities(corpus), "corpus_id", "left").select("corpus_id", "body", "author", "marked")
    return marked.mapInArrow(_furniture_batches, "corpus_id bigint, line_no bigint")


def articles(corpus: DataFrame) -> DataFrame:
    """(corpus_id, article): the article of every page that has a body, its lines in order without blank ones; '' where none is left."""
    cut = furniture(corpus).groupBy(F.col("corpus_id").alias("id")).agg(F.collect_list(F.col("line_no").cast("int")).alias("cut"))
    rows = corpus.select("corpus_id", "body").filter(F.col("body").isNotNull()).join(cut, F.col("corpus_id") == F.col("id"), "left")
    lines = F.transform(F.split("body", "\n", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no")))
    kept = F.filter(lines, lambda v: (F.trim(v["x"]) != "") & ~F.array_contains(F.coalesce("cut", F.array().cast("array<int>")), v["no"]))
    return rows.select("corpus_id", F.array_join(F.transform(kept, lambda v: v["x"]), "\n").alias("article"))
