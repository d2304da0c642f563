"""Places of pattern matches in texts, in DataFrame functions only.

Matches are marked by one regexp_replace, the text is split at the marks, and the lengths of the parts give each
match's place in code points: one linear pass for each pattern, and none at all beyond a look for texts without a
match.  Patterns must neither match the mark U+0001 nor tell it from U+0002; texts that hold it are searched with
U+0002 in its place, which moves nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK, OTHER = "\x01", "\x02"
#: Numbers, or spans, that are handled at once; code points of a block of text.
BLOCK, CUT = 512, 4096
FOUND = "array<struct<start:int,end:int,s:string>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def searchable(text: Column) -> Column:
    """Null as empty, and free of the mark."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.instr(text, MARK) > 0, F.translate(text, MARK, OTHER)).otherwise(text)


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(sizes: Column) -> Column:
    """The sum of the sizes before each: within blocks of BLOCK first, so that long arrays take near-linear time."""
    add = lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    one = lambda xs: F.aggregate(xs, start, add, lambda s: s["out"])
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / BLOCK).cast("int")), lambda b: F.slice(sizes, b * BLOCK + 1, F.lit(BLOCK)))
    firsts = lambda bs: one(F.transform(bs, lambda xs: F.aggregate(xs, F.lit(0), lambda t, x: t + x)))
    return let(blocks, lambda bs: F.flatten(F.zip_with(bs, firsts(bs), lambda xs, at: F.transform(one(xs), lambda x: x + at))))


def found(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as (start, end, s), end exclusive. text: from searchable()."""
    parts = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{MARK}$0{MARK}")), MARK, -1)
    none = F.array().cast(FOUND)

    def places(xs: Column, starts: Column) -> Column:
        at = lambda i: F.element_at(starts, i)
        return F.transform(F.sequence(F.lit(2), F.size(xs) - 1, F.lit(2)), lambda i: F.struct(at(i).alias("start"), at(i + 1).alias("end"), F.element_at(xs, i).alias("s")))

    matches = let(parts, lambda xs: let(running(F.transform(xs, F.length)), lambda starts: places(xs, starts)))
    return F.when(F.rlike(text, F.lit(pattern)), matches).otherwise(none)


def named(matches: Column, kind: str, rank: int) -> Column:
    """Matches as spans of a kind, which sort by start, then rank."""
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    """kind:start:end of each span, by start, then kind, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))))


def ranked(points: Column, marks: Column, inclusive: bool) -> Column:
    """For each of the points (an array of int), how many marks are before it, or also at it: by one sort of both."""
    first, second = (0, 1) if inclusive else (1, 0)
    event = lambda at, tie, i: F.struct(at.alias("at"), F.lit(tie).alias("tie"), i.alias("i"))
    events = F.array_sort(F.concat(F.transform(marks, lambda m: event(m, first, F.lit(-1))), F.transform(points, lambda p, i: event(p, second, i.cast("int")))))

    def places(es: Column) -> Column:
        before = running(F.transform(es, lambda e: F.when(e["i"] < 0, 1).otherwise(0)))
        with_rank = F.zip_with(es, before, lambda e, n: F.struct(e["i"].alias("i"), n.alias("n")))
        return F.transform(F.array_sort(F.filter(with_rank, lambda e: e["i"] >= 0)), lambda e: e["n"])

    return F.when(F.size(points) > 0, let(events, places)).otherwise(F.array().cast("array<int>"))


def apart(matches: Column, spans: Column) -> Column:
    """The matches that overlap none of the spans: as many spans start before the match's end as end up to its start."""
    of = lambda xs, name: F.transform(xs, lambda m: m[name])
    started = ranked(of(matches, "end"), of(spans, "start"), False)
    ended = ranked(of(matches, "start"), of(spans, "end"), True)
    over = F.zip_with(started, ended, lambda a, b: a - b)
    free = let(over, lambda n: F.filter(matches, lambda m, i: F.element_at(n, i + 1) == 0))
    return F.when((F.size(matches) > 0) & (F.size(spans) > 0), free).otherwise(matches)


def between(blocks: Column, start: Column, end: Column) -> Column:
    """The text from start to end (code points), of the text cut into blocks of CUT: a look at those blocks alone."""
    first = F.floor(start / CUT).cast("int")
    held = F.array_join(F.slice(blocks, first + 1, F.floor(end / CUT).cast("int") - first + 1), "")
    return F.substring(held, start - first * CUT + 1, end - start)


def replaced(text: Column, spans: Column, put) -> Column:
    """text with each span replaced by put(span, what it held); of overlapping spans the first counts and the rest of
    the others vanishes with it. Spans pass in slices of BLOCK, so that neither the text nor the output is copied for
    each of them."""

    def write(blocks: Column, ordered: Column) -> Column:
        def step(state: Column, span: Column) -> Column:
            fresh = F.array(between(blocks, state["at"], span["start"]), put(span, between(blocks, span["start"], span["end"])))
            return F.struct(F.greatest(state["at"], span["end"]).alias("at"), F.when(span["start"] < state["at"], state["out"]).otherwise(F.concat(state["out"], fresh)).alias("out"))

        def some(state: Column, b: Column) -> Column:
            none = F.struct(state["at"].alias("at"), F.array().cast("array<string>").alias("out"))
            inner = F.aggregate(F.slice(ordered, b * BLOCK + 1, F.lit(BLOCK)), none, step)
            return let(inner, lambda s: F.struct(s["at"].alias("at"), F.concat(state["out"], F.array(F.array_join(s["out"], ""))).alias("out")))

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        end = lambda s: F.concat(F.array_join(s["out"], ""), between(blocks, s["at"], F.length(text)))
        return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(ordered) - 1) / BLOCK).cast("int")), start, some, end)

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CUT}}}"), F.lit(0))
    whole = let(blocks, lambda bs: let(F.array_sort(spans), lambda ordered: write(bs, ordered)))
    return F.when(F.size(spans) > 0, whole).otherwise(text)
