"""Personal data: fixed kinds, and identifiers found by bootstrapped contexts. SQL functions only.

The fixed kinds (email, ip, card, phone) are found in each whole text. They are the seeds. A lexical
pattern is what stands around an identifier: the one, two or three words before it, the word after
it, or the word on either side. Patterns and values form a graph. A pattern's confidence is the sum
of its known values' scores over all its places, divided by how often its words stand so in all
texts; a value's score is the best of its patterns'. In each round values above `accept` become
known and lift further patterns, until a round changes nothing. Tokens like an identifier that
overlap no base span, stand in a pattern above `accept` and have been accepted are added as spans of
kind `context`.

A pattern needs `support` different known values, so a copied sentence induces nothing. A token like
an identifier has six characters at least, three digits among them.

Null, empty text: no spans. Equal texts get equal spans, whatever their ids. Very long texts are
searched whole, in time that grows with their length and matches. Ties do not arise: all spans of a
kind are kept. Empty table: no rows. Only the id and text columns are read, so no others can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import written
from skein.llm.spans import blanked, empty, find, let, listed, of_kind

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ACCEPT = 5, 0.5
#: Rounds end when nothing is discovered and no score rises by more than SETTLED. More than MOST_ROUNDS are an error.
SETTLED, MOST_ROUNDS = 1e-4, 100
#: Patterns to count, and documents with discovered spans, are broadcast up to this many; beyond, they are joined by shuffle.
MOST_BROADCAST = 50_000
_LOCAL = "A-Za-z0-9._%+-"
EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# A run of digits with single separators, whole: runs of other than 16 to 19 digits are not matched in part.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A token like an identifier: letters, digits and joints, between white space or brackets, three digits in its run.
TOKEN = r"(?<![^\s(\[{<\"'])(?=[^\s0-9]*+[0-9][^\s0-9]*+[0-9][^\s0-9]*+[0-9])[A-Za-z0-9+(][A-Za-z0-9@._%+()/-]{4,}[A-Za-z0-9](?=[\s.,;:!?)\]}>\"']|$)"
BLANK = "\x01"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(m: Column) -> Column:
    d = F.reverse(_digits(m))

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + x - F.when(x > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0


def _octets(m: Column) -> Column:
    octet = "^(?:[0-9]{0,2}|1[0-9][0-9]|2[0-4][0-9]|25[0-5])$"  # after leading zeros
    return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(octet))


#: Kind: pattern, a test that any text with a match passes, and what a match must pass.
RULES = {
    "email": (EMAIL, lambda t: t.contains("@"), lambda m: F.lit(True)),
    "ip": (IP, lambda t: t.rlike(r"[0-9]\.[0-9]+\.[0-9]"), _octets),
    "card": (CARD, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), luhn),
    "phone": (PHONE, lambda t: t.contains("+"), lambda m: F.length(_digits(m)).between(8, 15)),
}


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each fixed kind."""
    of = lambda pattern, there, ok: F.filter(find(text, pattern, there(text)), lambda s: ok(s["m"]))
    return {kind: of(*rule) for kind, rule in RULES.items()}


def _patterns(before: Column, after: Column) -> Column:
    """The lexical patterns of a match, from the text between it and the matches beside it."""
    words = F.split(F.trim(F.regexp_replace(F.lower(before), r"[\s(\[{<\"']+$", "")), r"\s+")
    nexts = F.split(F.regexp_replace(F.lower(after), r"^[.,;:!?)\]}>\"']*\s*", ""), r"\s+")

    def made(w: Column, n: Column) -> Column:
        one = F.nullif(F.try_element_at(w, F.lit(-1)), F.lit(""))
        two = F.concat_ws(" ", F.try_element_at(w, F.lit(-2)), one)
        three = F.concat_ws(" ", F.try_element_at(w, F.lit(-3)), two)
        right = F.nullif(F.get(n, F.lit(0)), F.lit(""))
        has = lambda k, x: F.when((F.size(w) >= k) & one.isNotNull(), x)
        all_of = F.array(F.concat(F.lit("1:"), one), F.concat(F.lit("2:"), has(2, two)), F.concat(F.lit("3:"), has(3, three)), F.concat(F.lit("r:"), right), F.concat(F.lit("b:"), one, F.lit(" _ "), right))
        return F.filter(all_of, lambda p: p.isNotNull() & ~p.contains(BLANK))

    return let(words, lambda w: let(nexts, lambda n: made(w, n)))


def _instances(text: Column, pattern: str, there: Column, ok, known: bool) -> Column:
    """Matches that are ok, with their patterns: array of value, start, end, known, patterns."""

    def around(spans: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        with_pieces = lambda p: F.transform(spans, lambda s, i: F.struct(s["m"].alias("value"), s["start"].alias("start"), s["end"].alias("end"), F.lit(known).alias("known"), F.when(ok(s["m"]), _patterns(F.get(p, i), F.get(p, i + 1))).alias("patterns")))
        return F.filter(let(pieces, with_pieces), lambda x: F.size(x["patterns"]) > 0)

    return F.when(there, let(find(text, pattern, F.lit(True)), around)).otherwise(empty("array<struct<value:string,start:int,end:int,known:boolean,patterns:array<string>>>"))


def scan(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per document: doc_id, row (digest of id and text), the base spans and the identifiers with their patterns."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), t.alias("text"))
    rows = rows.select("doc_id", "text", F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256).alias("row"), *(x.alias(k) for k, x in base_spans(F.col("text")).items()))
    rest = F.col("text")
    for pattern, there, ok in RULES.values():
        rest = blanked(rest, pattern, there(F.col("text")), ok, BLANK)
    rows = rows.withColumn("rest", rest)
    base = F.concat(*(of_kind(F.col(k), k, i) for i, k in enumerate(KINDS)))
    seeds = [_instances(F.col("text"), pattern, F.size(kind) > 0, ok, True) for kind, (pattern, _, ok) in RULES.items()]
    others = _instances(F.col("rest"), TOKEN, F.col("rest").rlike("[0-9][^\\s0-9]*+[0-9][^\\s0-9]*+[0-9]"), lambda m: F.length(_digits(m)) >= 3, False)
    return rows.select("doc_id", "row", base.alias("base"), F.concat(*seeds, others).alias("instances"))


def occurrences(docs: DataFrame, text: str, patterns: DataFrame) -> DataFrame:
    """How often the words of each of the patterns stand so in all texts: pattern, n."""
    # the word of a pattern that is next to the identifier
    anchor = F.element_at(F.split(F.substring_index(F.substring("pattern", 3, 1 << 30), " _ ", 1), " "), -1)
    anchors = patterns.select(anchor.alias("word")).distinct()
    small = patterns.count() <= MOST_BROADCAST
    words = docs.select(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+").alias("w"))
    around = F.transform("w", lambda x, i: F.struct(x.alias("word"), F.get(F.col("w"), i - 1).alias("p1"), F.get(F.col("w"), i - 2).alias("p2"), F.get(F.col("w"), i + 2).alias("n2")))
    there = words.select(F.explode(around).alias("x")).select("x.*")
    there = there.join(F.broadcast(anchors) if small else anchors, "word", "left_semi")
    of = F.array(F.concat(F.lit("1:"), "word"), F.concat(F.lit("2:"), "p1", F.lit(" "), "word"), F.concat(F.lit("3:"), "p2", F.lit(" "), "p1", F.lit(" "), "word"), F.concat(F.lit("r:"), "word"), F.concat(F.lit("b:"), "word", F.lit(" _ "), "n2"))
    counted = there.select(F.explode(of).alias("pattern")).filter(F.col("pattern").isNotNull())
    return counted.join(F.broadcast(patterns) if small else patterns, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("n"))


def bootstrap(places: DataFrame, docs: DataFrame, text: str, support: int = SUPPORT, accept: float = ACCEPT, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """The (pattern, value) pairs of unseen identifiers that high-confidence patterns discover.

    places: pattern, value, known, one row per place and pattern. A pattern without `support` different
    values can never reach it, so only the others are counted in the texts. They are counted first in
    the texts that can hold an identifier: what stands there too often for its places to be accepted,
    were all of its values known, can never be, and is not counted in the rest. A pattern that never
    stands around a seed stays: values discovered in a round can lift it in the next.
    """
    # distinct before counting: a value that is a third of all rows is one edge
    edges = written(places.groupBy("pattern", "value").agg(F.max("known").alias("known"), F.count("*").alias("places")), "edges")
    wide = edges.groupBy("pattern").agg(F.count("*").alias("v"), F.sum("places").alias("places"))
    wide = written(wide.filter(F.col("v") >= support).select("pattern", "places"), "patterns")
    may = F.coalesce(F.col(text).rlike("[0-9@]"), F.lit(False))
    counted = wide.join(occurrences(docs.filter(may), text, wide.select("pattern")), "pattern", "left").select("pattern", "places", F.coalesce("n", F.lit(0)).alias("n"))
    counted = written(counted.filter(F.col("places") >= accept * F.col("n")), "occurrences")
    if not counted.isEmpty():
        rest = occurrences(docs.filter(~may), text, counted.select("pattern")).withColumnRenamed("n", "more")
        counted = written(counted.join(rest, "pattern", "left").withColumn("n", F.col("n") + F.coalesce("more", F.lit(0))), "occurrences")
    # brackets may hide a pattern's words from the count; it is never less than the places
    counted = counted.select("pattern", F.greatest("n", "places").alias("n"))
    edges = written(edges.join(counted.select("pattern"), "pattern", "left_semi"), "edges")
    scores = edges.select("value", F.col("known").cast("double").alias("score")).groupBy("value").agg(F.max("score").alias("score"))
    patterns, before = None, -1
    for _ in range(most_rounds):
        lifted = written(edges.join(scores, "value").groupBy("pattern").agg(F.sum(F.col("score") * F.col("places")).alias("hits"), F.sum((F.col("score") >= accept).cast("int")).alias("values")), "lifted")
        patterns = written(lifted.join(counted, "pattern").filter(F.col("values") >= support).select("pattern", (F.col("hits") / F.col("n")).alias("confidence")), "patterns")
        best = edges.join(patterns, "pattern").groupBy("value").agg(F.max("confidence").alias("best"))
        found = edges.groupBy("value").agg(F.max("known").alias("known")).join(best, "value", "left").join(scores.withColumnRenamed("score", "was"), "value")
        scores = written(found.select("value", "was", F.when(F.col("known"), 1.0).when(F.col("best") >= accept, F.col("best")).otherwise(0.0).alias("score")), "scores")
        now = scores.agg(F.count_if(F.col("score") >= accept).alias("n"), F.max(F.col("score") - F.col("was")).alias("rise")).first()
        scores = scores.drop("was")
        # scores only rise, so that equal counts are equal values
        if now["n"] == before and now["rise"] <= SETTLED or not now["n"]:
            break
        before = now["n"]
    else:
        raise RuntimeError(f"patterns did not settle in {most_rounds} rounds")
    strong = patterns.filter(F.col("confidence") >= accept)
    return edges.filter(~F.col("known")).join(strong, "pattern").join(scores.filter(F.col("score") >= accept), "value").select("pattern", "value")


def find_personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, base and extra (arrays of k, kind, start, end)."""
    scanned = written(scan(docs, doc_id, text), "personal")
    places = scanned.select("row", F.explode("instances").alias("i")).select("row", "i.*").withColumn("pattern", F.explode("patterns")).drop("patterns")
    places = written(places, "places")
    pairs = written(bootstrap(places.select("pattern", "value", "known"), docs, text, **options), "pairs")
    small = pairs.count() <= MOST_BROADCAST
    hits = places.filter(~F.col("known")).join(F.broadcast(pairs) if small else pairs, ["pattern", "value"]).select("row", "start", "end").distinct()
    # by document, not by text: copies of one text are many groups
    extra = written(hits.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(F.lit(len(KINDS)).alias("k"), F.lit("context").alias("kind"), "start", "end"))).alias("extra")), "extra")
    small = extra.count() <= MOST_BROADCAST and extra.agg(F.coalesce(F.sum(F.size("extra")), F.lit(0))).first()[0] <= 4 * MOST_BROADCAST
    none = empty("array<struct<k:int,kind:string,start:int,end:int>>")
    return scanned.select("doc_id", "row", "base").join(F.broadcast(extra) if small else extra, "row", "left").select("doc_id", "base", F.coalesce("extra", none).alias("extra"))


def personal_data_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    found = find_personal_data(docs, doc_id, text)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(listed(F.array_sort("base")), 256).alias("base_sha256"), listed(F.array_sort(F.concat("base", "extra"))).alias("spans"))
