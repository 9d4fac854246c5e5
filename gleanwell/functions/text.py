"""Text rules of retrieval and evaluation as Column expressions; nothing but folded leaves the JVM."""

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that mark a question as comparing, as temporal, as joining.
COMPARISON = (
    "compare", "compared", "comparing", "comparison", "versus", "vs", "both", "while", "whereas", "unlike", "similarly", "similar",
    "differ", "differs", "differing", "difference", "consistent", "consistency", "inconsistent", "inconsistency", "contrast",
)
TEMPORAL = (
    "before", "after", "between", "since", "until", "during", "earlier", "later", "previously", "subsequently", "then", "when", "timeline",
    "change", "changed", "shift", "shifted", "evolve", "evolved", "evolution",
)
CONJUNCTIONS, CONJUNCTION_PHRASES = ("and", "or"), ("as well as", "along with")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
# Phrases that make an answer a refusal for lack of information.
ABSTENTION = ("insufficient", "not enough information", "no information", "cannot be determined", "cannot determine", "does not contain enough information")
# The words a verdict can be, their opposites, what negates them and what makes them a hedge.
VERDICTS = ("yes", "no", "true", "false", "similar", "consistent", "change", "align")
OPPOSITES = {"yes": "no", "no": "yes", "true": "false", "false": "true"}
NEGATORS = ("not", "never", "cannot", "can't", "doesn't", "does not", "did not", "didn't")
HEDGES = ("uncertain", "unsure", "unclear", "unknown", "whether")
# Phrases that decline, phrases that hedge, and verbs that announce a statement. Here and among the negators, entries that a
# shorter one implies or that can never match are left out.
DECLINE = (
    "insufficient", "not enough information", "does not contain enough information", "no information", "cannot be determined", "cannot determine",
    "don't have enough information", "do not have enough information", "unable to determine", "unable to answer",
)
HEDGE = ("cannot be certain", "can't be certain", "is limited", "are limited", "not entirely clear", "is unclear", "are unclear")
ASSERTING = (
    "the answer is", "indicates", "indicate", "suggests", "suggest", "confirms", "confirm", "reveals", "reveal", "shows that", "show that", "states that", "state that",
    "is described as", "are described as", "identifies", "identify", "attributes", "attribute",
)

# A verdict that begins a text, one that follows an announcement, one that ends a sentence, and two of them as alternatives.
_ANY = "|".join(VERDICTS)
LEADING = rf"(?i)^\s*(not\s+)?\b({_ANY})\b"
ANNOUNCED = rf"(?i)\b(?:the answer is|it is|overall,?)\s+(not\s+)?\b({_ANY})\b"
CLOSING = rf"^(.*)\b({_ANY})\b\s*$"
ALTERNATIVES = rf"(?i)\b({_ANY})\s+or\s+({_ANY})\b"
# A quoted span, the forms of numbers and dates that count, and a capitalised word.
QUOTED = r"'[^']{2,80}'|\"[^\"]{2,80}\""
NUMBERS = (rf"(?i)\b({'|'.join(MONTHS)})\b", r"\b(19|20)\d{2}\b", r"\b\d+(st|nd|rd|th)?\b")
CAPITALISED = r"\b[A-Z][a-zA-Z'\-]*\b"


def doc_id(url: Column) -> Column:
    """The identity of a page: the first 16 hex digits of its url's sha1. Null for a null url."""
    return F.substring(F.sha1(url.cast("binary")), 1, 16)


def joined_id(*parts: Column) -> Column:
    """The identity of what several strings name together: 16 hex digits of the sha1 of the parts joined by the unit separator."""
    return F.substring(F.sha1(F.concat_ws("\u001f", *parts).cast("binary")), 1, 16)


def strip(text: Column) -> Column:
    """text without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def type_name(name: Column) -> Column:
    """A question type in its plain spelling: lower case, words joined by one underscore; null for null, empty and blank."""
    plain = F.regexp_replace(strip(F.lower(name)), r"[\s\-]+", "_")
    return F.when(plain != "", plain)


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the lower-cased text, in order; none for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def approx_tokens(text: Column) -> Column:
    """A quarter of the characters, at least 1; null counts as empty."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)).cast("bigint")


def normal_answer(text: Column) -> Column:
    """Lower case, without ASCII punctuation and the articles, single spaces. Null stays null."""
    words = F.split(strip(F.regexp_replace(F.lower(text), r"\p{Punct}", "")), r"\s+", -1)
    return F.array_join(F.filter(words, lambda w: ~w.isin("a", "an", "the", "")), " ")


def exact_fact(text: Column) -> Column:
    """Straight quotes and dashes and single spaces: for finding quotations to the letter."""
    return strip(F.regexp_replace(F.translate(text, "‘’“”–—", "''\"\"--"), r"\s+", " "))


def normal_fact(text: Column) -> Column:
    """exact_fact in lower case: for finding quotations word for word."""
    return F.lower(exact_fact(text))


@F.pandas_udf(StringType())
def _fold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t).casefold())


def folded(text: Column) -> Column:
    """Compatibility composition and case folding; only texts with other than ASCII characters leave the JVM."""
    other = F.rlike(text, F.lit(r"[^\x00-\x7F]"))
    return F.when(other, _fold(F.when(other, text))).otherwise(F.lower(text))


def abstains(answer: Column) -> Column:
    """Whether an answer reads as a refusal for lack of information. Null for null."""
    low = F.regexp_replace(F.lower(answer), r"\s+", " ")
    out = F.lit(False)
    for p in ABSTENTION:
        out = out | F.contains(low, F.lit(p))
    return F.when(answer.isNotNull(), out)


def token_f1(prediction: Column, gold: Column) -> Column:
    """F1 of the multisets of words of two normalised texts: 1 if both are empty, 0 if one is."""
    p, g = (F.filter(F.split(normal_answer(x), " ", -1), lambda w: w != "") for x in (prediction, gold))
    count = lambda words, w: F.size(F.filter(words, lambda x: x == w))
    common = F.aggregate(F.array_distinct(p), F.lit(0), lambda s, w: s + F.least(count(p, w), count(g, w)))
    both, total = F.size(p) + F.size(g), 2.0 * common
    return F.when(prediction.isNull() | gold.isNull(), None).when(both == 0, 1.0).otherwise(total / F.nullif(both, F.lit(0)))


def entity_in(gold: Column, answer: Column) -> Column:
    """Whether the normalised gold words stand in a row in the answer; null for a gold without words."""
    g = normal_answer(gold)
    return F.when(g != "", F.contains(F.concat(F.lit(" "), normal_answer(answer), F.lit(" ")), F.concat(F.lit(" "), g, F.lit(" "))))


def _any_of(words: tuple[str, ...]) -> str:
    return "|".join(words)


def _opposite(word: Column) -> Column:
    out = F.lit(None).cast("string")
    for a, b in OPPOSITES.items():
        out = F.when(word == a, b).otherwise(out)
    return out


def verdict(answer: Column) -> Column:
    """The verdict an answer commits to, or null.

    "X or Y" of two verdicts is blanked. A verdict that begins the text, or follows "the answer is", "it is" or "overall", counts
    first, the last of them winning; then one that ends a sentence without a hedge before it. A negated verdict turns into its
    opposite, or counts for nothing if it has none.
    """
    text = F.regexp_replace(answer, ALTERNATIVES, " ")

    def pair(negated: Column, word: Column) -> Column:
        word = F.lower(word)
        return F.when(negated != "", _opposite(word)).otherwise(word)

    first = F.when(F.rlike(text, F.lit(LEADING)), pair(F.regexp_extract(text, LEADING, 1), F.regexp_extract(text, LEADING, 2)))
    later = F.filter(F.zip_with(F.regexp_extract_all(text, F.lit(ANNOUNCED), F.lit(1)), F.regexp_extract_all(text, F.lit(ANNOUNCED), F.lit(2)), pair), lambda x: x.isNotNull())

    def closing(sentence: Column) -> Column:
        low = F.regexp_replace(F.lower(sentence), r"\s+", " ")
        before, word = F.regexp_extract(low, CLOSING, 1), F.regexp_extract(low, CLOSING, 2)
        negated = F.rlike(before, F.lit(rf"\b({_any_of(NEGATORS)})\b"))
        hedged = F.rlike(before, F.lit(rf"\b({_any_of(HEDGES)})\b"))
        return F.when((word != "") & ~hedged, F.when(negated, _opposite(word)).otherwise(word))

    last = F.filter(F.transform(F.split(text, r"[.!?;]", -1), closing), lambda x: x.isNotNull())
    return F.coalesce(F.get(later, F.size(later) - 1), first, F.get(last, F.size(last) - 1))


def response_structure(answer: Column) -> Column:
    """clean_abstention, answer_with_uncertainty, substantive_answer or ambiguous: an answer that declines or hedges still answers if
    a capitalised word stands within 60 characters of a verb that announces a statement. Blank is ambiguous, null null."""
    low = F.regexp_replace(F.lower(strip(answer)), r"\s+", " ")
    has = lambda phrases: F.rlike(low, F.lit("|".join(rf"\Q{p}\E" for p in phrases)))
    windows = F.flatten(F.array(*[F.regexp_extract_all(answer, F.lit(rf"(?is)\Q{m}\E(?=(.{{0,60}}))"), F.lit(1)) for m in ASSERTING]))
    names = F.exists(windows, lambda w: F.rlike(w, F.lit(CAPITALISED)))
    declines, hedges = has(DECLINE), has(HEDGE)
    out = F.when(low == "", "ambiguous").when(~declines & ~hedges, "substantive_answer").when(names, "answer_with_uncertainty").when(declines, "clean_abstention").otherwise("ambiguous")
    return F.when(answer.isNotNull(), out)


def query_features(q: Column) -> dict[str, Column]:
    """Ten transparent features of a question, by name."""
    words = F.regexp_extract_all(F.lower(q), F.lit(r"[a-zA-Z']+"), F.lit(0))
    among = lambda marks: F.size(F.filter(words, lambda w: w.isin(*marks)))
    times = lambda phrase: F.regexp_count(F.lower(q), F.lit(phrase))
    comparison, temporal = among(COMPARISON), among(TEMPORAL) + times("over time")
    conjunction = among(CONJUNCTIONS) + times(CONJUNCTION_PHRASES[0]) + times(CONJUNCTION_PHRASES[1])
    return {
        "words": F.size(words),
        "chars": F.length(q),
        "comparison": comparison,
        "has_comparison": (comparison > 0).cast("int"),
        "temporal": temporal,
        "has_temporal": (temporal > 0).cast("int"),
        "conjunction": conjunction,
        "has_conjunction": (conjunction > 0).cast("int"),
        "quoted": F.regexp_count(q, F.lit(QUOTED)),
        "numeric": F.regexp_count(q, F.lit(NUMBERS[0])) + F.regexp_count(q, F.lit(NUMBERS[1])) + F.regexp_count(q, F.lit(NUMBERS[2])),
    }


def strict_json(raw: Column, ddl: str) -> Column:
    """The struct of a JSON object, null as a whole where the text is no object of these types; other keys are ignored."""
    return F.from_json(raw, ddl, {"mode": "PERMISSIVE"})


def parse_judge(raw: Column) -> Column:
    """struct<grade, score, reason, fallback> of a judge's JSON text: one doubled opening brace is repaired; text behind the object, another
    grade or type make it incorrect with a score of 0 and fallback."""
    # the grammar of one flat object, so that trailing text and nested values are refused
    string = r'"(?:[^"\\]|\\.)*"'
    pair = rf"\s*{string}\s*:\s*(?:{string}|-?\d+(?:\.\d+)?|true|false|null)\s*"
    flat = rf"^\s*\{{{pair}(?:,{pair})*\}}\s*$"
    fixed = F.regexp_replace(raw, r"^(\s*\{)\s*\{", "$1")
    read = F.when(F.rlike(fixed, F.lit(flat)), F.from_json(fixed, "grade string, reason string"))
    quoted = F.rlike(fixed, F.lit(r'"grade"\s*:\s*"'))
    grade = F.when(quoted & read["grade"].isin("correct", "partially_correct", "incorrect"), read["grade"])
    score = F.when(grade == "correct", 1.0).when(grade == "partially_correct", 0.5).otherwise(0.0)
    return F.struct(F.coalesce(grade, F.lit("incorrect")).alias("grade"), score.alias("score"), F.coalesce(read["reason"], F.lit("")).alias("reason"), grade.isNull().alias("fallback"))


def parse_controller(raw: Column) -> Column:
    """struct<sufficient, next_query, reason, fallback> of a controller's JSON text: sufficient must be a JSON boolean and next_query a string or null;
    no next query where sufficient; anything else is sufficient as a fallback."""
    read = F.from_json(raw, "sufficient boolean, next_query string, reason string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    typed = F.rlike(raw, F.lit(r'"sufficient"\s*:\s*(?:true|false)\b')) & ~F.rlike(raw, F.lit(r'"next_query"\s*:\s*+(?!"|null\b)')) & F.rlike(raw, F.lit(r"^\s*\{[\s\S]*\}\s*$"))
    good = F.coalesce(typed & read["_bad"].isNull() & read["sufficient"].isNotNull(), F.lit(False))
    said = F.when(good, read["sufficient"]).otherwise(F.lit(True))
    return F.struct(said.alias("sufficient"), F.when(good & ~said, read["next_query"]).alias("next_query"), F.when(good, F.coalesce(read["reason"], F.lit(""))).otherwise(F.lit("")).alias("reason"), (~good).alias("fallback"))
