"""Transport headers: fields, thread keys, addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailveil.functions.addresses import ADDRESS_TYPE, parse_addresses
from mailveil.functions.binding import built_once, let
from mailveil.functions.encoded_words import decode_words

MAIL_FIELDS = ("From", "To", "Cc")



def unfold(headers: Column) -> Column:
    return F.regexp_replace(headers, r"\r?\n[ \t]+", " ")


def _line(name: str) -> str:
    # (?d): only a line feed ends a line.
    return rf"(?dim)^{name}:[ ]*([^\r\n]*)"


def header_field(unfolded: Column, name: str) -> Column:
    """Value of the first header of that name as it is written, null if missing or empty."""
    return F.nullif(F.regexp_extract(unfolded, _line(name), 1), F.lit(""))


def header_values(unfolded: Column, name: str) -> Column:
    """Values of all headers of that name, as they are written."""
    return F.regexp_extract_all(unfolded, F.lit(_line(name)), F.lit(1))


@built_once
def decoded_column(values: str) -> Column:
    """The header values in an array column, their encoded words decoded."""
    return F.transform(F.col(values), decode_words)


def references_list(value: Column) -> Column:
    found = F.regexp_extract_all(value, F.lit("<[^>]+>"), F.lit(0))
    return F.coalesce(found, F.array().cast("array<string>"))


def thread_id(references: Column, in_reply_to: Column, message_id: Column) -> Column:
    return F.coalesce(F.get(references, F.lit(0)), in_reply_to, message_id)


def parent_id(references: Column, in_reply_to: Column) -> Column:
    return F.coalesce(in_reply_to, F.try_element_at(references, F.lit(-1)))


def references_text(references: Column) -> Column:
    return F.array_join(references, "; ")


def thread_info(headers: Column) -> Column:
    """``struct<message_id, thread_id, parent_id, references, reply_depth>``."""

    def keys(h: Column) -> Column:
        return F.struct(
            header_field(h, "Message-ID").alias("mid"),
            header_field(h, "In-Reply-To").alias("irt"),
            references_list(header_field(h, "References")).alias("refs"),
        )

    def thread(k: Column) -> Column:
        return F.struct(
            k["mid"].alias("message_id"),
            thread_id(k["refs"], k["irt"], k["mid"]).alias("thread_id"),
            parent_id(k["refs"], k["irt"]).alias("parent_id"),
            k["refs"].alias("references"),
            F.size(k["refs"]).alias("reply_depth"),
        )

    return let(unfold(headers), lambda h: let(keys(h), thread))


def header_addresses(headers: Column) -> Column:
    """``struct<from, to, cc>``: the first From line, all To and Cc lines."""
    none = F.array().cast(f"array<{ADDRESS_TYPE}>")

    def parsed(h: Column) -> Column:
        values = F.array(F.slice(header_values(h, "From"), 1, 1), header_values(h, "To"),
                         header_values(h, "Cc"))
        return let(F.transform(values, parse_addresses), lambda lists: F.struct(
            *[F.get(lists, F.lit(i)).alias(part) for i, part in enumerate(("from", "to", "cc"))]))

    empty = F.struct(none.alias("from"), none.alias("to"), none.alias("cc"))
    return F.when(headers.isNull(), empty).otherwise(let(unfold(headers), parsed))


@built_once
def addresses_column() -> Column:
    """``header_addresses`` of the column ``transport_headers``."""
    return header_addresses(F.col("transport_headers"))


def format_addresses(addresses: Column) -> Column:
    emails = F.transform(addresses, lambda a: a["email"])
    return F.array_join(F.filter(emails, lambda e: e != ""), "; ")


def normalize_email(address: Column) -> Column:
    return F.lower(F.trim(address))


def email_domain(address: Column) -> Column:
    """Text after the first ``@``, in the case it is written."""
    return F.get(F.split(address, "@", 2), F.lit(1))


def split_address_list(text: Column) -> Column:
    """A ``;``-separated list as trimmed, non-empty items."""
    items = F.transform(F.split(text, ";", -1), lambda e: F.trim(e))
    return F.filter(items, lambda e: e != "")


def attachment_count(number: Column, attachments: Column | None = None) -> Column:
    counted = number if attachments is None else F.coalesce(
        number, F.when(attachments.isNotNull(), F.size(attachments)))
    return F.greatest(F.coalesce(counted, F.lit(0)), F.lit(0)).cast("int")
