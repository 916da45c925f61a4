"""Names of people in texts, learnt from the display names in headers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil.functions import headers as H
from mailveil.functions.binding import built_once, let
from mailveil.functions.folding import fold, running
from mailveil.functions.recognizers import PERSON, PERSON_SCORE, order_of
from mailveil.functions.spans import SEPARATOR, cut_at, make_span, no_spans
from mailveil.operators.lookup import hot_keys
from mailveil.session import settle

# Names of so many words are looked for.
MOST_WORDS = 4
# Where a capitalised word begins, and where one begins that stands beside another. The capital
# comes first: it rules out most places without a look back.
WORD_START = r"(?=\p{Lu})(?<!\p{L})"
CHAIN_START = r"(?=\p{Lu})(?:(?<!\p{L})(?=\p{Lu}\p{L}*+ \p{Lu})|(?<=\p{L} ))"
CHAIN_TYPE = "struct<start:int,end:int,name:string>"


def display_name(name: Column) -> Column:
    """``Last, First`` turned round, in lower case."""
    turned = F.regexp_replace(name, r"^([^,]*?)\s*,\s*(.*)$", "$2 $1")
    return F.lower(F.trim(turned))


def names_table(mail: DataFrame) -> DataFrame:
    """``(name, n)``: distinct display names and how often they occur."""
    every = let(H.addresses_column(), lambda x: F.concat(x["from"], x["to"], x["cc"]))
    return (
        mail.select(F.explode(every).alias("a"))
        .select(display_name(F.col("a.name")).alias("name"))
        .filter(F.col("name") != "")
        .groupBy("name").agg(F.count("*").alias("n"))
    )


def capital_chains(text: Column, lengths: tuple[int, ...]) -> Column:
    """Chains of so many capitalised words, one space between two, as ``array<struct<start, end,
    name>>``.

    The text is cut where a capitalised word begins; the pieces tile it, so their lengths give
    the positions. A chain reaches from piece to piece as long as these are a word and a space.
    """
    none = F.array().cast(f"array<{CHAIN_TYPE}>")

    def of_words(words: Column, length: int) -> Column:
        def chain(word: Column, i: Column) -> Column:
            part = F.slice(words, i + 1, F.lit(length))
            linked = F.forall(F.slice(part, 1, length - 1), lambda w: w["linked"])
            return F.when((F.size(part) == length) & linked, let(part, lambda p: F.struct(
                word["start"].alias("start"), F.get(p, F.lit(length - 1))["end"].alias("end"),
                F.lower(F.array_join(F.transform(p, lambda w: w["word"]), " ")).alias("name"))))

        return F.filter(F.transform(words, chain), lambda c: c.isNotNull())

    def placed(pieces: Column) -> Column:
        ends = running(F.transform(pieces, F.length), 0, lambda at, n: at + n)

        def word(piece: Column, at: Column) -> Column:
            return let(F.regexp_extract(piece, r"^\p{Lu}\p{L}*+", 0), lambda w: F.struct(
                at.alias("start"), (at + F.length(w)).cast("int").alias("end"), w.alias("word"),
                ((F.length(piece) == F.length(w) + 1) & F.endswith(piece, F.lit(" "))
                 ).alias("linked")))

        words = let(ends, lambda e: F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces) - 1),
            lambda piece, i: word(piece, F.get(e, i))))
        return let(words, lambda w: F.concat(none, *[of_words(w, n) for n in lengths]))

    start = WORD_START if 1 in lengths else CHAIN_START
    return let(cut_at(text, start, SEPARATOR), lambda pieces: F.when(
        F.size(pieces) > 1, placed(pieces)).otherwise(none))


def capital_pairs(text: Column) -> Column:
    """Neighbouring capitalised words."""
    return capital_chains(text, (2,))


@built_once
def _chains_column(text: str, lengths: tuple[int, ...]) -> Column:
    return capital_chains(F.col(text), lengths)


def longest_names(found: Column) -> Column:
    """Names of one text, no two over one word: the first, and of those the longest."""
    none = F.array().cast("array<struct<start:int,end:int>>")
    ordered = F.array_sort(F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), (-s["end"]).alias("back"))))

    def step(reached: Column, s: Column) -> tuple[Column, Column]:
        end = (-s["back"]).cast("int")
        return (F.when(s["start"] >= reached, end).otherwise(reached),
                F.when(s["start"] >= reached, F.array(F.struct(
                    s["start"].alias("start"), end.alias("end")))).otherwise(none))

    return fold(ordered, F.lit(0), none, step)["out"]


def name_lengths(names: DataFrame) -> tuple[int, ...]:
    """How many words the names have, as far as such names are looked for."""
    words = F.size(F.split("name", " ", -1))
    lengths = names.select(words.alias("n")).distinct().filter(F.col("n") <= MOST_WORDS)
    return tuple(sorted(r.n for r in lengths.collect()))


def known_chains(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """``(msg_seq, start, end)`` of chains of capitalised words that are known names.

    Names common in headers are the likely hot keys in texts; they are at most
    HOT_PARTS, so they are broadcast and their chains never shuffled. All others join by an
    inner join, for which Spark may drop chains that are no names before it shuffles them,
    and whose partitions adaptive execution splits where one chain piles up. The chains are
    slim and written once, so that bodies are searched once for both. Only chains as long as
    some name are written.
    """
    chains = settle(
        texts.select("msg_seq", F.explode(_chains_column(text, name_lengths(names))).alias("c"))
        .select("msg_seq", "c.*"), "chains")
    hot = F.broadcast(hot_keys(names, "name"))
    common = chains.join(hot, "name", "left_semi")
    others = chains.join(hot, "name", "left_anti").join(
        names.join(hot, "name", "left_anti").select("name"), "name")
    return common.unionByName(others).select("msg_seq", "start", "end")


def person_spans(texts: DataFrame, names: DataFrame, text: str = "text") -> DataFrame:
    """``(msg_seq, people)``: an array of spans per message that names someone.

    A name inside a longer one is not found, nor one that begins inside another.
    """
    grouped = known_chains(texts, names, text).groupBy("msg_seq").agg(
        F.collect_list(F.struct("start", "end")).alias("found"))
    spans = F.transform(longest_names(F.col("found")), lambda s: make_span(
        s["start"], s["end"], F.lit(PERSON_SCORE), F.lit(PERSON), F.lit(order_of(PERSON))))
    return grouped.select("msg_seq", F.concat(no_spans(), spans).alias("people"))
