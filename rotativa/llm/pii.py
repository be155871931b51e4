"""Personal data by patterns, and by contexts bootstrapped from what the patterns find.

Four kinds have a form of their own: email, ip, card (Luhn) and phone. Their values are the seeds.
The one or two words before a seed are lexical patterns; other identifier-like tokens behind the
same words are instances. Patterns and instances form a graph that is scored in rounds. What speaks
for a pattern are the known values of its kind behind it, what speaks against it those of other kinds
and the times its words precede no identifier; values not known yet do neither. An instance is as
reliable as its accepted patterns together. Above the threshold it is known from the next round on,
under the kind of its best pattern, and can make new patterns. The rounds end when one finds nothing.

Everything here is a DataFrame or SQL function. Null texts count as empty, empty texts have no spans,
repeated rows get equal results, an empty table an empty result, and texts are read whole. Columns
named ``n_<kind>``, ``base_spans`` and ``spans`` are replaced; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.llm.common import possibly_in, text_or_empty
from rotativa.session import materialize

KINDS = ("email", "ip", "card", "phone")
LOCAL, DOMAIN, DIGIT = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]", "[0-9]"
# The same matches as the plain forms, each started once per run of its characters and without
# giving back, so that long runs take linear time and no deep recursion.
FORMS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{DOMAIN}++(?:\.{DOMAIN}++)++",
    "ip": rf"(?<!{DIGIT}){DIGIT}++\.{DIGIT}++\.{DIGIT}++\.{DIGIT}++",
    "card": rf"(?<!{DIGIT})(?<!{DIGIT}[\x20-]){DIGIT}(?:[\x20-]?{DIGIT}){{12,18}}+(?![\x20-]?{DIGIT})",
    "phone": rf"\+{DIGIT}[\x20().0-9-]+{DIGIT}",
}
BLANK = r"\x20\x09-\x0D"
# Tokens with a digit or an @ inside, from blank to blank.
TOKEN = rf"(?<![^{BLANK}])[^0-9@{BLANK}]*+[0-9@][^{BLANK}]*+"
EDGES = r"""^[("'\[<]+|[.,;:!?)\]>"']+$"""
# Two or more neighbouring numbers, which may be one identifier written with blanks.
NUMBER = rf"""[0-9][0-9()./+-]*+(?![^{BLANK}.,;:!?)\]>"'])"""
RUN = rf"""(?<![^{BLANK}])[("'\[<]*+\+?{NUMBER}(?:[{BLANK}]++\(?{NUMBER})++"""
SPAN = "array<struct<rank:int,start:int,stop:int,value:string>>"

MIN_DIGITS = 5
MIN_SUPPORT = 5
ACCEPT_PATTERN = 0.8
ACCEPT_INSTANCE = 0.9


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def passes_luhn(value: Column) -> Column:
    number = F.reverse(digits(value))

    def add(total: Column, i: Column) -> Column:
        digit = F.substring(number, i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 1, digit).when(twice > 9, twice - 9).otherwise(twice)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), add) % 10 == 0


def is_valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
        return value.rlike(rf"^{part}\.{part}\.{part}\.{part}$")
    if kind == "card":
        return passes_luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def found_spans(text: Column, form: str, rank: int) -> Column:
    """Matches with their places in code points: the lengths of what stands between them, added up."""
    matches = F.arrays_zip(F.split(text, form, -1).alias("gap"), F.regexp_extract_all(text, F.lit(form), F.lit(0)).alias("value"))
    matches = F.filter(matches, lambda m: m["value"].isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(SPAN).alias("spans"))

    def place(acc: Column, m: Column) -> Column:
        first = acc["at"] + F.length(m["gap"])
        stop = first + F.length(m["value"])
        span = F.struct(F.lit(rank).alias("rank"), first.alias("start"), stop.alias("stop"), m["value"].alias("value"))
        spans = F.concat(F.coalesce(acc["spans"], F.array().cast(SPAN)), F.array(span))
        return F.struct(stop.alias("at"), spans.alias("spans"))

    placed = F.aggregate(matches, start, place, lambda acc: F.coalesce(acc["spans"], F.array().cast(SPAN)))
    return F.when(text.rlike(form), placed).otherwise(F.array().cast(SPAN))


def base_spans(text: Column) -> dict[str, Column]:
    """Valid spans of each kind, leftmost first."""
    def valid(kind: str) -> Callable[[Column], Column]:
        return lambda span: is_valid(kind, span["value"])

    return {kind: F.filter(found_spans(text, FORMS[kind], rank), valid(kind)) for rank, kind in enumerate(KINDS)}


def in_words(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def with_base(docs: DataFrame, text: str = "text") -> DataFrame:
    """(row, text, _key, an array of spans per kind, ``_base`` with all of them).

    The key tells (doc_id, text) apart, and rows alike in both have the same spans.
    """
    content = text_or_empty(text)
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(content.cast("binary")))
    # The row travels as one column, so that its names cannot meet those used here.
    spans = docs.select(F.struct("*").alias("row"), content.alias("text"), key.alias("_key"), *[c.alias(f"_{k}") for k, c in base_spans(content).items()])
    return spans.withColumn("_base", F.concat(*[f"_{k}" for k in KINDS]))


def word_array(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), rf"[{BLANK}]+"), lambda w: w != "")


def trimmed(found: Column) -> Column:
    """Spans without brackets, quotes and punctuation at their edges."""
    bare = F.transform(found, lambda t: F.struct(
        (t["start"] + F.length(F.regexp_extract(t["value"], r"""^[("'\[<]*""", 0))).alias("start"),
        F.regexp_replace(t["value"], EDGES, "").alias("value"),
    ))
    return F.transform(bare, lambda t: F.struct(
        F.lit(None).cast("int").alias("rank"), t["start"].alias("start"),
        (t["start"] + F.length(t["value"])).alias("stop"), t["value"].alias("value"),
    ))


def occurrences(found: DataFrame) -> DataFrame:
    """(_key, rank, start, stop, value, glued, last, first, once): seeds, and other identifier-like tokens with a null rank.

    ``last`` is the word before the span and ``first`` the one before that, null where there is none.
    What stands before the span in its own word counts as a word (``glued``). A number and a run that
    begins with it have one place: ``once`` is false for all but the longest.
    """
    content = F.col("text")
    words = found.select("_key", "_base", "text", word_array(content).alias("_words"), found_spans(content, TOKEN, -1).alias("_found"), found_spans(content, RUN, -1).alias("_runs"))
    # The tokens are just the words with a digit or an @, so the n-th of one is the n-th of the other.
    places = F.filter(F.transform("_words", lambda w, i: F.when(w.rlike("[0-9@]"), i)), lambda i: i.isNotNull())
    tokens = words.select("_key", "_base", "_words", F.arrays_zip(F.col("_found").alias("span"), places.alias("at")).alias("_tokens"), trimmed(F.col("_found")).alias("_singles"), trimmed(F.col("_runs")).alias("_runs"))

    def free(t: Column) -> Column:
        taken = F.exists("_base", lambda b: (b["start"] < t["stop"]) & (t["start"] < b["stop"]))
        return (t["value"].contains("@") | (F.length(digits(t["value"])) >= MIN_DIGITS)) & ~taken

    spans = tokens.select("_key", "_words", "_tokens", F.concat("_base", F.filter(F.concat("_singles", "_runs"), free)).alias("_spans"))
    placed = F.transform("_spans", lambda s: F.struct(
        s.alias("s"), F.element_at(F.filter("_tokens", lambda t: t["span"]["start"] <= s["start"]), -1).alias("t"),
        (~F.exists("_spans", lambda o: (o["start"] == s["start"]) & (o["stop"] > s["stop"]))).alias("once"),
    ))
    own = F.transform(placed, lambda p: F.struct(
        p["s"].alias("s"), p["t"]["at"].alias("at"), p["once"].alias("once"),
        F.lower(F.regexp_replace(F.substring(p["t"]["span"]["value"], F.lit(1), p["s"]["start"] - p["t"]["span"]["start"]), r"""[("'\[<]+$""", "")).alias("own"),
    ))
    each = F.transform(own, lambda o: F.struct(
        o["s"]["rank"].alias("rank"), o["s"]["start"].alias("start"), o["s"]["stop"].alias("stop"),
        F.regexp_replace(F.lower(o["s"]["value"]), rf"[{BLANK}]+", " ").alias("value"), (o["own"] != "").alias("glued"),
        F.when(o["own"] != "", o["own"]).otherwise(F.get("_words", o["at"] - 1)).alias("last"),
        F.get("_words", F.when(o["own"] != "", o["at"] - 1).otherwise(o["at"] - 2)).alias("first"), o["once"].alias("once"),
    ))
    return spans.select("_key", F.explode(each).alias("o")).select("_key", "o.*")


def contexts(seen: DataFrame) -> DataFrame:
    """One row per occurrence and pattern: the last word before it, and the last two."""
    patterns = F.array_distinct(F.array("last", F.concat_ws(" ", "first", "last")))
    return seen.filter("last IS NOT NULL").withColumn("pattern", F.explode(patterns))


def possible_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, times, glued) with enough different values behind it, known or not.

    ``glued`` counts the times its last word is part of a longer one, which no list of words has.
    """
    times, glued = F.count_if("once").alias("times"), F.count_if(F.col("once") & F.col("glued")).alias("glued")
    links = edges.groupBy("pattern", "value").agg(times, glued)
    support = links.groupBy("pattern").agg(F.sum("times").alias("times"), F.sum("glued").alias("glued"), F.count(F.lit(1)).alias("support"))
    return support.filter(F.col("support") >= MIN_SUPPORT).select("pattern", "times", "glued")


def candidate_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, rank, positive, known) with enough different known values of the kind ``rank`` behind it.

    ``edges`` has (pattern, value, rank, score) once per pattern and value; ``positive`` adds up the
    scores of that kind, ``known`` those of all kinds.
    """
    support = edges.groupBy("pattern", "rank").agg(F.count(F.lit(1)).alias("support"), F.sum("score").alias("positive"))
    every = support.groupBy("pattern").agg(F.sum("positive").alias("known"))
    return support.filter(F.col("support") >= MIN_SUPPORT).drop("support").join(every, "pattern")


def pattern_frequency(docs: DataFrame, patterns: DataFrame, text: str = "text") -> DataFrame:
    """How often the words of each pattern occur in the corpus at all.

    Only the listed patterns are counted. Their number grows with the corpus, so a filter of fixed
    size drops most other words before the shuffle, and the counts meet the patterns in a join.
    """
    words = word_array(text_or_empty(text))
    fewer = F.greatest(F.size("_words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("_words", 1, fewer), F.slice("_words", 2, fewer), lambda a, b: F.concat_ws(" ", a, b))
    seen = docs.select(words.alias("_words")).select(F.explode(F.concat("_words", pairs)).alias("pattern"))
    wanted = patterns.select("pattern").distinct()
    counted = possibly_in(seen, F.col("pattern"), wanted).filter("_maybe").groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(wanted, "pattern")


def score_graph(edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """(value, rank, score) of the values that become known, in as many rounds as find some.

    ``edges`` has (rank, pattern, value); rank is null where the value is not a seed. ``patterns`` has
    (pattern, share), the share of its occurrences that precede an identifier. What is known stays
    known, so the rounds come to an end.
    """
    links = possibly_in(edges.select("pattern", "value"), F.col("pattern"), patterns.select("pattern")).filter("_maybe")
    graph = materialize(links.select("pattern", "value").distinct().join(patterns, "pattern"), "pii-graph")
    seeds = edges.filter("rank IS NOT NULL").select("value", "rank").distinct()
    known = seeds.join(graph.select("value").distinct(), "value", "left_semi").select("value", "rank", F.lit(1.0).alias("score"), F.lit(True).alias("seed"))
    known = materialize(known, "pii-known")
    best = Window.partitionBy("value").orderBy(F.col("score").desc(), "rank")
    while True:
        reliability = F.col("positive") / (F.col("known") + 1) * F.col("share")
        scored = candidate_patterns(graph.join(known, "value")).join(patterns, "pattern").withColumn("reliability", reliability)
        accepted = scored.filter(F.col("reliability") >= ACCEPT_PATTERN).select("pattern", "rank", "reliability")
        unseen = graph.select("pattern", "value").join(known, "value", "left_anti")
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("reliability"), F.lit(1e-12)))))
        scores = unseen.join(accepted, "pattern").groupBy("value", "rank").agg((1 - doubt).alias("score"))
        new = scores.filter(F.col("score") >= ACCEPT_INSTANCE).withColumn("_nth", F.row_number().over(best)).filter("_nth = 1").drop("_nth")
        new = materialize(new.withColumn("seed", F.lit(False)), "pii-new")
        if new.isEmpty():
            return known.filter("NOT seed").drop("seed")
        known = materialize(known.unionByName(new), "pii-known")


def discovered(docs: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """(_key, added): spans of unseen identifiers, per different document."""
    seen = materialize(occurrences(found), "pii-seen")
    edges = contexts(seen)
    possible = materialize(possible_patterns(edges), "pii-patterns")
    share = F.least(F.col("times") / (F.coalesce("n", F.lit(0)) + F.col("glued")), F.lit(1.0))
    # No pattern is more reliable than its share.
    patterns = possible.filter("times > 0").join(pattern_frequency(docs, possible, text), "pattern", "left").select("pattern", share.alias("share")).filter(F.col("share") >= ACCEPT_PATTERN)
    values = score_graph(edges.select("rank", "pattern", "value"), materialize(patterns, "pii-shares"))
    hits = seen.filter("rank IS NULL").select("_key", "start", "stop", "value").distinct().join(values, "value")
    span = F.struct("rank", "start", "stop", "value").alias("span")
    return hits.groupBy("_key").agg(F.collect_list(span).cast(SPAN).alias("added"))


def find_pii(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_email`` to ``n_phone`` and ``base_spans`` (form alone), and ``spans`` (all).

    Spans are arrays of (rank, start, stop, value), by kind as listed and then by start.
    """
    docs = docs.drop("spans", "base_spans", *[f"n_{k}" for k in KINDS])
    found = with_base(docs, text)
    joined = found.join(discovered(docs, found, text), "_key", "left")
    counts = [F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS]
    every = F.array_sort(F.concat("_base", F.coalesce("added", F.array().cast(SPAN))))
    return joined.select("row.*", *counts, F.col("_base").alias("base_spans"), every.alias("spans"))


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """Replace each span in the text by its kind in brackets; of overlapping spans the first, and longest, gives the name."""
    content = text_or_empty(text)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["stop"]).alias("back"), s["rank"].alias("rank"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def cover(acc: Column, s: Column) -> Column:
        kept = F.substring(content, acc["at"] + 1, s["start"] - acc["at"])
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], kept, F.element_at(names, s["rank"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), out.alias("out"))

    covered = F.aggregate(ordered, start, cover, lambda acc: F.concat(acc["out"], F.substring(content, acc["at"] + 1, F.length(content))))
    return found.withColumn(text, F.when(F.size("spans") > 0, covered).otherwise(F.col(text)))
