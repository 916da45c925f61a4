"""Findings as arrays of spans, and the algebra on them.

A span is ``struct<start, end, score, entity, place>``: ``start`` 0-based and ``end``
exclusive in code points of the original text, ``place`` the entity's registered order.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.binding import let
from mailveil.functions.folding import cut_out, fold, running, side_by_side
from mailveil.functions.patterns import DIGITS, SPACE, widen
from mailveil.functions.recognizers import Recognizer, order_of

SPAN = "struct<start:int,end:int,score:double,entity:string,place:int>"
HIT = "struct<start:int,end:int,text:string>"
SEPARATOR, STAND_IN = "\x01", "\x02"
CONTEXT_GAIN = 0.35
CONTEXT_TOKENS = 5
DEFAULT_THRESHOLD = 0.4

# Four or more digits with at most one space, hyphen or full stop between two, as far as they
# go; a plus may stand for the first. Each match of a numeric or dotted pattern lies within one
# such run. The repetition is possessive: giving a digit back never helps, and a group that may
# is matched by recursion.
DIGIT_RUN = rf"[+{DIGITS}](?:[-.{SPACE}]?[{DIGITS}]){{3,}}+"
# Digits of a numeric match at least.
NUMERIC_DIGITS = 6
# Text looked at first for the tokens before a span; all of it if that holds too few.
CONTEXT_REACH = 200


def no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def make_span(start: Column, end: Column, score: Column, entity: Column, place: Column) -> Column:
    return F.struct(
        start.cast("int").alias("start"), end.cast("int").alias("end"),
        score.cast("double").alias("score"), entity.alias("entity"),
        place.cast("int").alias("place"),
    )


def cut_at(text: Column, pattern: str, mark: str) -> Column:
    """The text cut at marks put in by a replacement; patterns are compiled only once so.

    A separator in the text itself becomes another control character of the same length. Few
    texts hold one, and looking for it costs less than a replacement that finds none.
    """
    unmarked = F.when(F.contains(text, F.lit(SEPARATOR)), F.replace(
        text, F.lit(SEPARATOR), F.lit(STAND_IN))).otherwise(text)
    return F.split(F.regexp_replace(unmarked, pattern, mark), SEPARATOR, -1)


def locate(text: Column, pattern: str, opening: str = "") -> Column:
    """Non-overlapping matches with their positions, as ``array<struct<start,end,text>>``.

    Cutting before and after each match gives gaps and matches in turn. They tile the
    text, so one running sum of their lengths gives every position. What ``opening`` matches
    before a match belongs to the gap.
    """
    none = F.array().cast(f"array<{HIT}>")

    def hits(pieces: Column) -> Column:
        ends = running(F.transform(pieces, F.length), 0, lambda at, n: at + n)
        placed = side_by_side(pieces, ends, "text", "end")
        # Gaps and matches in turn, a gap first.
        matches = F.filter(placed, lambda p, i: i % 2 == 1)
        return F.transform(matches, lambda p: F.struct(
            (p["end"] - F.length(p["text"])).alias("start"), p["end"].alias("end"),
            p["text"].alias("text")))

    if opening:
        cut = cut_at(text, f"({opening})({pattern})", f"$1{SEPARATOR}$2{SEPARATOR}")
    else:
        cut = cut_at(text, pattern, f"{SEPARATOR}$0{SEPARATOR}")
    return let(cut, lambda pieces: F.when(
        F.size(pieces) > 1, let(pieces, hits)).otherwise(none))


def find(text: Column, recognizer: Recognizer, place: int) -> Column:
    """Spans of one recognizer: a true checksum scores 1, a false one drops the span."""
    valid = recognizer.validator

    def spans_of(pattern: str, score: float) -> Column:
        hits = locate(text, widen(pattern, recognizer.digit_edges or recognizer.numeric),
                      recognizer.opening)
        if valid is not None:
            hits = F.filter(hits, lambda h: valid(h["text"]))
            score = 1.0
        return F.transform(hits, lambda h: make_span(
            h["start"], h["end"], F.lit(score), F.lit(recognizer.entity), F.lit(place)))

    spans = F.concat(*[spans_of(pattern, score) for pattern, score in recognizer.patterns])
    if recognizer.literal is not None:
        spans = F.when(F.contains(text, F.lit(recognizer.literal)), spans).otherwise(no_spans())
    return spans


def detect(text: Column, recognizers: Sequence[Recognizer]) -> Column:
    """All spans of a text, with base or validated scores.

    Numeric and dotted patterns are matched only within runs of digits, each cut out with the
    characters beside it, so the text is read once for all of them.
    """
    numeric = [r for r in recognizers if r.numeric]
    others = [r for r in recognizers if not r.numeric]

    def found_by(view: Column, group: Iterable[Recognizer]) -> list[Column]:
        return [find(view, r, order_of(r.entity, recognizers)) for r in group]

    def within(t: Column, run: Column, group: Iterable[Recognizer]) -> Column:
        first = F.greatest(run["start"] - 1, F.lit(0))
        view = F.substr(t, first + 1, run["end"] - first + 1)
        return let(view, lambda v: moved(F.concat(*found_by(v, group)), first))

    def in_runs(t: Column, runs: Column, group: Iterable[Recognizer]) -> Column:
        return F.flatten(F.transform(runs, lambda run: within(t, run, group)))

    def search(t: Column, runs: Column) -> Column:
        with_stops = F.filter(runs, lambda run: F.contains(run["text"], F.lit(".")))
        groups = [part for r in others for part in (
            [in_runs(t, with_stops, [r])] if r.dotted else found_by(t, [r]))]
        if numeric:
            long = F.filter(runs, lambda run: F.length(run["text"]) >= NUMERIC_DIGITS)
            groups.append(in_runs(t, long, numeric))
        return F.concat(no_spans(), *groups)

    def searched(t: Column) -> Column:
        if not any(r.numeric or r.dotted for r in recognizers):
            return F.concat(no_spans(), *found_by(t, others))
        return let(locate(t, DIGIT_RUN), lambda runs: search(t, runs))

    return let(text, searched)


def boost_context(text: Column, spans: Column, recognizers: Sequence[Recognizer]) -> Column:
    """Add the context gain where one of the five preceding tokens holds a context word.

    The text before a span is read backwards, so splitting stops after those tokens.
    """
    words = {r.entity: r.context for r in recognizers if r.context}
    if not words:
        return spans
    table = F.create_map(*[
        part for entity, listed in words.items()
        for part in (F.lit(entity), F.array(*[F.lit(w) for w in listed]))
    ])

    def pieces(before: Column) -> Column:
        # One piece may be empty, one is the rest.
        return F.split(F.reverse(before), "[^A-Za-z0-9]+", CONTEXT_TOKENS + 2)

    def near(text: Column, span: Column, before: Column, listed: Column) -> Column:
        end = span["start"]
        all_pieces = let(pieces(before), lambda close: F.when(
            (F.size(close) == CONTEXT_TOKENS + 2) | (end <= CONTEXT_REACH), close,
        ).otherwise(pieces(F.substr(text, F.lit(1), end))))
        tokens = F.slice(F.filter(all_pieces, lambda p: p != ""), 1, CONTEXT_TOKENS)
        tokens = F.transform(tokens, lambda t: F.lower(F.reverse(t)))
        return let(tokens, lambda ts: F.exists(
            listed, lambda word: F.exists(ts, lambda t: F.contains(t, word))))

    def boosted(text: Column, span: Column, before: Column) -> Column:
        gained = let(F.try_element_at(table, span["entity"]), lambda listed: F.when(
            listed.isNotNull() & near(text, span, before, listed), F.lit(CONTEXT_GAIN),
        ).otherwise(F.lit(0.0)))
        score = F.when(span["score"] < 1.0, F.least(F.lit(1.0), span["score"] + gained)
                       ).otherwise(span["score"])
        return make_span(span["start"], span["end"], score, span["entity"], span["place"])

    def all_boosted(t: Column, found: Column) -> Column:
        # Spans with nothing to gain get an empty range.
        reach = F.transform(found, lambda s: F.struct(
            F.when((s["score"] < 1.0) & s["entity"].isin(*words),
                   F.greatest(s["start"] - CONTEXT_REACH, F.lit(0))).otherwise(s["start"])
            .alias("start"), s["start"].alias("end")))
        pairs = side_by_side(found, cut_out(t, reach), "span", "before")
        return F.transform(pairs, lambda p: boosted(t, p["span"], p["before"]))

    return let(text, lambda t: let(spans, lambda found: all_boosted(t, found)))


def above(spans: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return F.filter(spans, lambda s: s["score"] >= F.lit(threshold))


def only(spans: Column, entities: Iterable[str]) -> Column:
    return F.filter(spans, lambda s: s["entity"].isin(*entities))


def moved(spans: Column, offset: Column) -> Column:
    return F.transform(spans, lambda s: make_span(
        s["start"] + offset, s["end"] + offset, s["score"], s["entity"], s["place"]))


def _ranked(spans: Column, *keys: str) -> Column:
    """Sort by the given fields; a leading minus means descending."""

    def keyed(span: Column) -> Column:
        sort_fields = [
            (-span[k[1:]] if k.startswith("-") else span[k]).alias(f"k{i}")
            for i, k in enumerate(keys)
        ]
        return F.struct(*sort_fields, span.alias("span"))

    return F.transform(F.array_sort(F.transform(spans, keyed)), lambda r: r["span"])


def resolve(spans: Column) -> Column:
    """Drop spans inside another one; on the same range the better score wins.

    Sorted by start, then longest, best and first registered, a span is covered
    exactly if an earlier one reaches its end, so one sweep does it. Partial overlaps
    stay. The result is ordered by start.
    """
    def uncovered(ordered: Column) -> Column:
        ends = running(F.transform(ordered, lambda s: s["end"]), -1, F.greatest)
        return let(ends, lambda reach: F.filter(
            ordered, lambda s, i: (i == 0) | (s["end"] > F.get(reach, i - 1))))

    return let(spans, lambda all_spans: F.when(F.size(all_spans) > 1, let(
        _ranked(all_spans, "start", "-end", "-score", "place"), uncovered,
    )).otherwise(all_spans))


def dedupe(spans: Column) -> Column:
    """Per entity: drop a span contained in one that scores as well or better.

    A pattern's own matches never overlap, so an entity with a single pattern needs no
    dedupe; this is for recognizers with several patterns.
    """
    ordered = _ranked(spans, "start", "-end", "-score", "place")

    def step(still: Column, s: Column) -> tuple[Column, Column]:
        # Only spans still open at this start can contain it.
        still_open = F.filter(still, lambda k: k["end"] > s["start"])
        covered = F.exists(still_open, lambda k: (k["entity"] == s["entity"])
                           & (k["end"] >= s["end"]) & (k["score"] >= s["score"]))
        return (F.when(covered, still_open).otherwise(F.array_append(still_open, s)),
                F.when(covered, no_spans()).otherwise(F.array(s)))

    return fold(ordered, no_spans(), no_spans(), step)["out"]


def scored(text: Column, spans: Column, recognizers: Sequence[Recognizer],
           threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Context, then duplicates of an entity where plug-ins can give any, then threshold."""
    boosted = boost_context(text, spans, recognizers)
    patterns = [r.entity for r in recognizers for _ in r.patterns]
    if len(set(patterns)) < len(patterns):
        boosted = dedupe(boosted)
    return above(boosted, threshold)


def merge_adjacent(text: Column, spans: Column) -> Column:
    """Join neighbours of one entity that only spaces separate. Input ordered by start."""

    def merge(ordered: Column) -> Column:
        def gap(s: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)
            near = (i > 0) & (before["entity"] == s["entity"]) & (s["start"] > before["end"])
            # An empty range where nothing can be joined, so nothing is cut out there.
            return F.struct(F.when(near, before["end"]).otherwise(s["start"]).alias("start"),
                            s["start"].alias("end"))

        def islands(joins: Column) -> Column:
            places = F.sequence(F.lit(0), F.size(ordered) - 1)
            firsts = F.filter(places, lambda i: ~F.get(joins, i))
            lasts = F.filter(places, lambda i: ~F.coalesce(F.get(joins, i + 1), F.lit(False)))
            return F.zip_with(firsts, lasts, lambda a, b: make_span(
                F.get(ordered, a)["start"], F.get(ordered, b)["end"],
                F.array_max(F.transform(F.slice(ordered, a + 1, b - a + 1), lambda s: s["score"])),
                F.get(ordered, a)["entity"], F.get(ordered, a)["place"]))

        gaps = cut_out(text, F.transform(ordered, gap))
        return let(F.transform(gaps, lambda g: (g != "") & (F.trim(g) == "")), islands)

    return let(spans, lambda ordered: F.when(F.size(ordered) > 1, merge(ordered)).otherwise(ordered))


def counts_text(spans: Column) -> Column:
    """``"E1: n1, E2: n2"`` by best score, then first position; ``None`` if empty."""

    def write(ordered: Column) -> Column:
        entities = F.array_distinct(F.transform(ordered, lambda s: s["entity"]))
        return F.array_join(F.transform(entities, lambda e: F.concat(
            e, F.lit(": "),
            F.size(F.filter(ordered, lambda s: s["entity"] == e)).cast("string"))), ", ")

    return F.when(F.size(spans) == 0, F.lit("None")).otherwise(
        let(_ranked(spans, "-score", "start", "entity"), write))


def entity_tallies(spans: Column) -> Column:
    """``array<struct<entity, n>>`` of one text."""
    return let(spans, lambda all_spans: F.transform(
        F.array_distinct(F.transform(all_spans, lambda s: s["entity"])),
        lambda e: F.struct(
            e.alias("entity"),
            F.size(F.filter(all_spans, lambda s: s["entity"] == e)).cast("bigint").alias("n"))))
