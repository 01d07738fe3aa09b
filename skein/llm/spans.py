"""Places of regular-expression matches by SQL functions alone.

The engine has no function for match positions. But split() with no limit gives the pieces between
the matches that regexp_extract_all() gives, so running sums of both lengths, in code points, are
the places. An array that a sum appends to is copied each time, so sums run in chunks of `CHUNK`
matches, and then over chunks: 100,000 matches cost 100,000 * CHUNK / 2 copied places. Patterns here
are written so that no repeated group recurses and no long run of letters or digits is scanned from
each of its characters.

Null text: null. A text without a match: an empty array.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,m:string>"
NONE = f"array<{SPAN}>"
#: Matches in a running sum; code points of a text that are masked at a time.
CHUNK, STRETCH = 128, 4096


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def empty(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


def _places(parts: Column) -> Column:
    """parts: array of structs p (code points before a match, after the one before), l (its code points) and m. Spans."""

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["p"]
        end = start + x["l"]
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), x["m"].alias("m")))).alias("out"))

    def summed(some: Column) -> Column:
        return F.aggregate(some, F.struct(F.lit(0).alias("at"), empty(NONE).alias("out")), step)

    def shift(acc: Column, chunk: Column) -> Column:
        moved = F.transform(chunk["out"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["m"].alias("m")))
        return F.struct((acc["at"] + chunk["at"]).alias("at"), F.concat(acc["out"], F.array(moved)).alias("out"))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(parts) - 1) / CHUNK).cast("int")), lambda c: summed(F.slice(parts, c * CHUNK + 1, F.lit(CHUNK))))
    many = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty(f"array<{NONE}>").alias("out")), shift, lambda acc: F.flatten(acc["out"]))
    return F.when(F.size(parts) <= CHUNK, summed(parts)["out"]).otherwise(many)


def find(text: Column, pattern: str, there: Column) -> Column:
    """All matches of pattern as array<struct<start,end,m>>; there: a cheap test that must hold if there is any."""

    def spans(matches: Column) -> Column:
        pieces = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return let(F.zip_with(pieces, matches, lambda p, m: F.struct(F.length(p).alias("p"), F.length(m).alias("l"), m.alias("m"))), _places)

    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)).otherwise(empty(NONE))


def blanked(text: Column, pattern: str, there: Column, ok: Callable[[Column], Column], mark: str = "\x01") -> Column:
    """text with every character of the matches that are ok replaced by mark: all places stay what they are."""

    def fill(matches: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        both = F.zip_with(pieces, matches, lambda p, m: F.concat(p, F.when(m.isNull(), F.lit("")).when(ok(m), F.repeat(F.lit(mark), F.length(m))).otherwise(m)))
        return F.array_join(both, "")

    return F.when(there, let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), fill)).otherwise(text)


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined, of an array of structs in order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kind(spans: Column, kind: str, order: int) -> Column:
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("k"), F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def masked(text: Column, spans: Column, mark: str) -> Column:
    """text with each span of an array sorted by start replaced by mark; overlapping spans are one. Long texts go in stretches."""

    def cover(part: Column, first: Column, some: Column) -> Column:
        """part: what stands from `first` on; some: the spans that touch it. A span is marked where it starts, if no other covers its start."""

        def step(acc: Column, s: Column) -> Column:
            new = (s["start"] >= acc["at"]) & (s["start"] >= first)
            out = F.when(new, F.concat(acc["out"], F.substring(part, acc["at"] - first + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

        end = lambda acc: F.concat(acc["out"], F.substring(part, acc["at"] - first + 1, F.length(part)))
        return F.aggregate(some, F.struct(first.alias("at"), F.lit("").alias("out")), step, end)

    def touching(i: Column) -> Column:
        return F.filter(spans, lambda s: (s["start"] < (i + 1) * STRETCH) & (s["end"] > i * STRETCH))

    cut = F.transform(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{STRETCH}}}"), F.lit(0)), lambda part, i: cover(part, i * STRETCH, touching(i)))
    return F.when(F.length(text) <= STRETCH, cover(text, F.lit(0), spans)).otherwise(F.array_join(cut, ""))
