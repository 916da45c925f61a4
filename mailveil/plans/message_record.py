"""The 22-field record of each message."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil.functions import headers as H
from mailveil.functions.binding import built_once, let
from mailveil.functions.html import message_body
from mailveil.functions.masking import PLACEHOLDERS, mask
from mailveil.functions.recognizers import PATTERN_RECOGNIZERS, Recognizer, registry
from mailveil.functions.spans import (
    DEFAULT_THRESHOLD, counts_text, detect, moved, no_spans, scored,
)
from mailveil.functions.synthetic import DEFAULT_SEED, fill_placeholders
from mailveil.operators.folders import drop_calendar
from mailveil.operators.people import person_spans

# The fields of a record.
FIELDS = (
    "MessageId", "EmailReceivedDate", "EmailFrom", "EmailTo", "EmailCC", "OriginalEmailFrom",
    "OriginalEmailTo", "OriginalEmailCC", "Subject", "EmailBody", "SubjectSynthetic",
    "EmailBodySynthetic", "OriginalSubject", "OriginalEmailBody", "PIIEntitiesFound", "PIICount",
    "NoOfAttachments", "ThreadMessageId", "ThreadId", "ParentId", "References", "ReplyDepth",
)


# What the text of a message is made from, and nothing else.
BODY_COLUMNS = ("plain_text_body", "body", "html_body")


@dataclass(frozen=True)
class Options:
    recognizers: Sequence[Recognizer] = field(default_factory=registry)
    replacements: Mapping[str, str] = field(default_factory=lambda: PLACEHOLDERS)
    threshold: float = DEFAULT_THRESHOLD
    seed: int = DEFAULT_SEED
    max_body: int | None = None


@built_once
def _body_column(max_body: int | None) -> Column:
    return message_body(F.col("plain_text_body"), F.col("body"), F.col("html_body"),
                        F.col("transport_headers"), max_body)


def with_texts(mail: DataFrame, max_body: int | None = None) -> DataFrame:
    """``subject_text`` and ``body_text`` from the mail columns, other columns kept."""
    return mail.select("*", F.coalesce("subject", F.lit("")).alias("subject_text"),
                       _body_column(max_body).alias("body_text"))


def joined_text() -> Column:
    return F.concat(F.col("subject_text"), F.lit(" "), F.col("body_text"))


def _may_straddle(recognizers: Sequence[Recognizer]) -> Column:
    """Whether a finding may cross the space between subject and body.

    Of the built-in patterns only numbers hold spaces, always between two digits, so
    without digits on both sides of the joint nothing crosses it. Plug-ins may hold
    anything.
    """
    if any(r not in PATTERN_RECOGNIZERS for r in recognizers):
        return F.lit(True)
    return F.rlike(F.right("subject_text", F.lit(1)), F.lit("[0-9]")) & F.rlike(
        F.left("body_text", F.lit(1)), F.lit("[0-9]"))


@built_once
def _found_column(recognizers: tuple[Recognizer, ...]) -> Column:
    """Spans of subject and body, and of the joined text only where one may cross.

    Elsewhere the spans of the joined text are those of the two fields.
    """
    fields = F.array("subject_text", "body_text")
    searched = F.when(_may_straddle(recognizers), F.array_append(fields, joined_text())
                      ).otherwise(fields)
    return F.transform(searched, lambda t: detect(t, recognizers))


@built_once
def _span_columns(recognizers: tuple[Recognizer, ...], threshold: float) -> list[Column]:
    offset = F.length("subject_text") + 1
    in_subject = F.filter("people", lambda p: p["end"] < offset)
    in_body = moved(F.filter("people", lambda p: p["start"] >= offset), -offset)
    at = [F.get("_found", F.lit(i)) for i in range(3)]
    joined = F.when(F.size("_found") > 2, at[2]).otherwise(F.concat(at[0], moved(at[1], offset)))

    def final(text: Column, spans: Column) -> Column:
        return let(spans, lambda s: F.when(
            F.size(s) > 0, scored(text, s, recognizers, threshold)).otherwise(s))

    return [
        final(F.col("subject_text"), F.concat(at[0], in_subject)).alias("subject_spans"),
        final(F.col("body_text"), F.concat(at[1], in_body)).alias("body_spans"),
        final(joined_text(), F.concat(joined, "people")).alias("joined_spans"),
    ]


def with_people(mail: DataFrame, people: DataFrame | None) -> DataFrame:
    """Add ``people``, the spans of names in the joined text; none without a table."""
    if people is None:
        return mail.select("*", no_spans().alias("people"))
    joined = mail.join(people.withColumnRenamed("people", "_people"), "msg_seq", "left")
    return joined.select(*mail.columns, F.coalesce("_people", no_spans()).alias("people"))


def with_spans(texts: DataFrame, options: Options) -> DataFrame:
    """Add ``subject_spans``, ``body_spans`` and ``joined_spans``, detecting once per field.

    Names come from the column ``people``, as ``with_people`` adds it.
    """
    recognizers = tuple(options.recognizers)
    found = texts.select("*", _found_column(recognizers).alias("_found"))
    return found.select(*[c for c in texts.columns if c != "people"],
                        *_span_columns(recognizers, options.threshold))


@built_once
def _done_column(replacements: tuple[tuple[str, str], ...], seed: int, synthetic: bool) -> Column:
    """Masked and synthetic texts, one expression for subject and body."""
    pairs = F.array(
        F.struct(F.lit("subject").alias("field"), F.col("subject_text").alias("text"),
                 F.col("subject_spans").alias("spans")),
        F.struct(F.lit("body").alias("field"), F.col("body_text").alias("text"),
                 F.col("body_spans").alias("spans")),
    )

    def both(p: Column) -> Column:
        return let(mask(p["text"], p["spans"], dict(replacements)), lambda masked: F.struct(
            masked.alias("masked"),
            (fill_placeholders(masked, F.col("msg_seq"), p["field"], seed)
             if synthetic else masked).alias("synthetic")))

    return F.transform(pairs, both)


def with_masks(spans: DataFrame, options: Options, synthetic: bool = True) -> DataFrame:
    """Add masked and synthetic subject and body."""
    column = _done_column(tuple(options.replacements.items()), options.seed, synthetic)
    done = spans.select("*", column.alias("_done"))
    subject, body = F.get("_done", F.lit(0)), F.get("_done", F.lit(1))
    return done.select(
        *spans.columns,
        subject["masked"].alias("subject_masked"), body["masked"].alias("body_masked"),
        subject["synthetic"].alias("subject_synthetic"), body["synthetic"].alias("body_synthetic"),
    )


def find_people(texts: DataFrame, names: DataFrame) -> DataFrame:
    return person_spans(texts.select("msg_seq", joined_text().alias("text")), names)


@built_once
def _header_columns() -> list[Column]:
    headers = F.col("transport_headers")
    return [H.thread_info(headers).alias("_thread"), H.addresses_column().alias("_addresses")]


@built_once
def _record_columns() -> list[Column]:
    def original(part: str) -> Column:
        return H.format_addresses(F.col(f"_addresses.{part}"))

    values = {
        "MessageId": F.coalesce("message_id", F.lit("")),
        "EmailReceivedDate": F.col("delivery_time"),
        "EmailFrom": F.coalesce("masked_from", F.lit("")),
        "EmailTo": F.coalesce("masked_to", F.lit("")),
        "EmailCC": F.coalesce("masked_cc", F.lit("")),
        "OriginalEmailFrom": original("from"),
        "OriginalEmailTo": original("to"),
        "OriginalEmailCC": original("cc"),
        "Subject": F.col("subject_masked"),
        "EmailBody": F.col("body_masked"),
        "SubjectSynthetic": F.col("subject_synthetic"),
        "EmailBodySynthetic": F.col("body_synthetic"),
        "OriginalSubject": F.col("subject_text"),
        "OriginalEmailBody": F.col("body_text"),
        "PIIEntitiesFound": counts_text(F.col("joined_spans")),
        "PIICount": F.size("joined_spans"),
        "NoOfAttachments": H.attachment_count(
            F.col("number_of_attachments"), F.col("attachments")),
        "ThreadMessageId": F.col("_thread.message_id"),
        "ThreadId": F.col("_thread.thread_id"),
        "ParentId": F.col("_thread.parent_id"),
        "References": F.coalesce(H.references_text(F.col("_thread.references")), F.lit("")),
        "ReplyDepth": F.coalesce(F.col("_thread.reply_depth"), F.lit(0)),
    }
    return [values[f].alias(f) for f in FIELDS]


def message_records(mail: DataFrame, addresses: DataFrame, people: DataFrame | None,
                    options: Options | None = None, keep: Sequence[str] = (),
                    cluster_by: str | None = None) -> DataFrame:
    """Records of all mail but calendar items, with ``msg_seq`` and ``keep`` in front.

    ``addresses`` are the masked lists and ``people`` the names found, both slim tables by
    ``msg_seq``. They join before anything is masked, while a message is smallest, and on
    the one key, so the bodies move at most once and not at all if the mail is bucketed
    by ``msg_seq``. Mail that has ``body_text`` already, as ``with_texts`` adds it, keeps it. For
    output grouped by a column, ``cluster_by`` moves the messages at
    this point too: records are several times as large.
    """
    options = options or Options()
    joined = with_people(drop_calendar(mail).join(addresses, "msg_seq", "left"), people)
    if cluster_by is not None:
        joined = joined.repartition(cluster_by)
    if "body_text" not in joined.columns:
        joined = with_texts(joined, options.max_body)
    done = with_masks(with_spans(joined, options), options)
    return done.select("*", *_header_columns()).select("msg_seq", *keep, *_record_columns())
