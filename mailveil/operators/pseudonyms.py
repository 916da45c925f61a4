"""Address pseudonyms that stay the same across runs.

A mapping is ``(id, original_email, anonymized_email, norm_email)`` with one row per
normalised address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailveil.functions import headers as H
from mailveil.operators.lookup import hot_keys, lookup
from mailveil.operators.numbering import BUCKET, dense_sequence

KEYWORD = "user"
WIDTH = 7
FIELD_NUMBER = {"From": 1, "To": 2, "Cc": 3}
MAPPING_COLUMNS = ("id", "original_email", "anonymized_email", "norm_email")


def address_lists(mail: DataFrame) -> DataFrame:
    """``(msg_seq, email_from, email_to, email_cc)`` as ``; ``-separated addresses."""
    parsed = mail.select("msg_seq", H.addresses_column().alias("a"))
    return parsed.select(
        "msg_seq",
        H.format_addresses(F.col("a.from")).alias("email_from"),
        H.format_addresses(F.col("a.to")).alias("email_to"),
        H.format_addresses(F.col("a.cc")).alias("email_cc"),
    )


def address_union(lists: DataFrame) -> DataFrame:
    """One row per address: ``(msg_seq, field, pos, raw, norm_email)``, in a single scan.

    ``norm_email`` is null where the text holds no ``@`` and is passed through.
    """

    def tagged(column: str, field: str) -> Column:
        return F.transform(H.split_address_list(F.col(column)), lambda e, i: F.struct(
            F.lit(FIELD_NUMBER[field]).alias("field"), i.alias("pos"), e.alias("raw")))

    every = F.concat(tagged("email_from", "From"), tagged("email_to", "To"),
                     tagged("email_cc", "Cc"))
    rows = lists.select("msg_seq", F.explode(every).alias("a")).select("msg_seq", "a.*")
    return rows.withColumn("norm_email", F.when(
        F.contains("raw", F.lit("@")), H.normalize_email(F.col("raw"))))


def first_seen(occurrences: DataFrame) -> DataFrame:
    """``(norm_email, msg_seq, field, pos, raw, n)``: first occurrence and how often.

    The minimum is combined before the shuffle, so a very common address is cheap.
    """
    first = F.min(F.struct("msg_seq", "field", "pos", "raw"))
    return (
        occurrences.filter(F.col("norm_email").isNotNull())
        .groupBy("norm_email").agg(first.alias("first"), F.count("*").alias("n"))
        .select("norm_email", "first.*", "n")
    )


def new_addresses(seen: DataFrame, mapping: DataFrame) -> DataFrame:
    return seen.join(mapping.select("norm_email"), "norm_email", "left_anti")


def next_id(mapping: DataFrame) -> DataFrame:
    return mapping.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def build_pseudonym(id_: Column, domain: Column, keyword: str = KEYWORD, width: int = WIDTH) -> Column:
    """Zero-padded; an id longer than the width is kept whole."""
    return F.concat(F.format_string(f"{keyword}%0{width}d@", id_), domain)


def assign_pseudonyms(new: DataFrame, mapping: DataFrame, keyword: str = KEYWORD,
                      width: int = WIDTH, bucket: int = BUCKET) -> DataFrame:
    """Mapping rows for addresses that have none, ids in the order of first sight."""
    numbered = dense_sequence(new, "msg_seq", ["msg_seq", "field", "pos"], "_rank", bucket=bucket)
    ids = numbered.withColumn("id", F.col("_rank") + next_id(mapping).scalar() - 1)
    return ids.select(
        "id",
        F.col("raw").alias("original_email"),
        build_pseudonym(F.col("id"), H.email_domain(F.col("raw")), keyword, width)
        .alias("anonymized_email"),
        "norm_email",
    )


def extend_mapping(seen: DataFrame, mapping: DataFrame, **options) -> DataFrame:
    """The old mapping and the pairs this run adds."""
    added = assign_pseudonyms(new_addresses(seen, mapping), mapping, **options)
    return mapping.select(*MAPPING_COLUMNS).unionByName(added)


def pseudonym_lookup(occurrences: DataFrame, mapping: DataFrame, seen: DataFrame) -> DataFrame:
    """Add ``pseudonym`` to each occurrence; addresses without one keep their text.

    ``seen`` gives the counts that tell the hot addresses.
    """
    dim = mapping.select("norm_email", F.col("anonymized_email").alias("pseudonym"))
    row_id = F.concat_ws("/", "msg_seq", "field", "pos")
    found = lookup(occurrences, dim, "norm_email", "pseudonym", row_id,
                   hot_keys(seen, "norm_email"))
    return found.withColumn("pseudonym", F.coalesce("pseudonym", "raw"))


def rebuild_lists(found: DataFrame) -> DataFrame:
    """``(msg_seq, masked_from, masked_to, masked_cc)`` in one shuffle for all three.

    A group is the address list of one message.
    """
    grouped = found.groupBy("msg_seq").agg(
        F.array_sort(F.collect_list(F.struct("field", "pos", "pseudonym"))).alias("all"))

    def joined(field: str) -> Column:
        mine = F.filter("all", lambda a: a["field"] == FIELD_NUMBER[field])
        return F.array_join(F.transform(mine, lambda a: a["pseudonym"]), "; ")

    return grouped.select("msg_seq", joined("From").alias("masked_from"),
                          joined("To").alias("masked_to"), joined("Cc").alias("masked_cc"))


def pseudonym_header(mail: DataFrame, mapping: DataFrame, header: str, seen: DataFrame) -> DataFrame:
    """``(msg_seq, header_masked)``: a header with names kept and addresses swapped.

    A header that stands on several lines is one list.
    """
    unfolded = H.unfold(F.col("transport_headers"))
    addresses = H.parse_addresses(H.header_values(unfolded, header))
    rows = (
        mail.select("msg_seq", F.posexplode(addresses).alias("pos", "a"))
        .select("msg_seq", F.lit(FIELD_NUMBER[header]).alias("field"), "pos",
                F.col("a.name").alias("name"), F.col("a.email").alias("raw"))
        .withColumn("norm_email", F.when(F.contains("raw", F.lit("@")),
                                         H.normalize_email(F.col("raw"))))
    )
    found = pseudonym_lookup(rows, mapping, seen)
    # Names with characters that have a meaning in headers are quoted.
    quoted = F.when(F.rlike("name", F.lit(r'[\]\[\\()<>@,:;".]')),
                    F.concat(F.lit('"'), F.col("name"), F.lit('"'))).otherwise(F.col("name"))
    written = F.when(F.col("name") == "", F.col("pseudonym")).otherwise(
        F.concat(quoted, F.lit(" <"), F.col("pseudonym"), F.lit(">")))
    return (
        found.withColumn("written", written).groupBy("msg_seq")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "written"))).alias("all"))
        .select("msg_seq", F.array_join(F.transform("all", lambda a: a["written"]), ", ")
                .alias("header_masked"))
    )
