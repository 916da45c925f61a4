"""The archive run: mail in, mapping extended, batched CSV out."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from mailveil.operators.checks import pii_changed, split_rejects
from mailveil.operators.folders import drop_calendar
from mailveil.operators.numbering import number_batches
from mailveil.operators.people import names_table
from mailveil.operators.pseudonyms import (
    KEYWORD, WIDTH, address_lists, address_union, assign_pseudonyms, first_seen, new_addresses,
    pseudonym_lookup, rebuild_lists,
)
from mailveil.plans.message_record import Options, find_people, message_records, with_texts
from mailveil.session import settle
from mailveil.sources.csv_files import write_batches
from mailveil.sources.mail import checked_mail
from mailveil.sources.mapping import create_mapping, read_mapping, stage_mapping
from mailveil.sources.runs import drop_unpublished, move_in, publish, published


@dataclass(frozen=True)
class Addresses:
    """Settled tables of one run: first occurrences with counts, and new mapping pairs."""

    occurrences: DataFrame
    seen: DataFrame
    new: DataFrame


def survey_addresses(mail: DataFrame, mapping: DataFrame, keyword: str = KEYWORD,
                     width: int = WIDTH) -> Addresses:
    """Find the addresses of the mail and number those that ``mapping`` does not know."""
    occurrences = address_union(address_lists(drop_calendar(mail)))
    seen = settle(first_seen(occurrences), "seen-addresses")
    new = settle(assign_pseudonyms(new_addresses(seen, mapping), mapping, keyword, width),
                 "new-addresses")
    return Addresses(occurrences, seen, new)


def masked_lists(found: Addresses, mapping: DataFrame) -> DataFrame:
    """Masked address lists per message; ``mapping`` includes the new pairs."""
    return rebuild_lists(pseudonym_lookup(found.occurrences, mapping, found.seen))


@dataclass(frozen=True)
class RunSummary:
    """Counts of a run; ``damaged`` are messages processed though a part was not readable."""

    messages: int
    messages_with_pii: int
    rejected: int
    damaged: int = 0


def finish_runs(spark: SparkSession, mapping_path: str) -> None:
    """Move in the output of runs that ended between publishing their pairs and their output,
    and remove what runs left that published nothing."""
    for manifest in published(spark, mapping_path):
        for staged, target in manifest.get("outputs", []):
            move_in(spark, staged, target)
    drop_unpublished(spark, mapping_path)


def run_archive(spark: SparkSession, mail: DataFrame, mapping_path: str, output: str,
                base: str = "mail", batch_size: int = 5000, options: Options | None = None,
                drop_originals: bool = False) -> RunSummary:
    """Mask a mail table into CSV batches and save the pseudonyms it needed.

    ``mapping_path`` holds the mapping files of earlier runs, if any. ``mail`` may be any
    table with some of the mail columns: what cannot be read of a message is noted
    (``checked_mail``) and the run goes on. Messages without id, sequence number or delivery
    time go to ``{output}_rejected``.

    The run writes aside, publishes its new pairs with one rename, then moves its output in.
    Ended before that rename it has added nothing, and run again it gives the same ids; ended
    after it, the next run moves the output in first.
    """
    finish_runs(spark, mapping_path)
    run = uuid.uuid4().hex
    good, rejected = split_rejects(drop_calendar(checked_mail(mail)))
    create_mapping(spark, mapping_path)
    mapping = settle(read_mapping(spark, mapping_path), "saved-mapping")
    found = survey_addresses(good, mapping)
    stage_mapping(found.new, mapping_path, run)
    full = mapping.unionByName(found.new)
    names = settle(names_table(good), "names")

    batches = settle(number_batches(good, batch_size).select("msg_seq", "batch"), "batches")
    numbered = good.join(batches, "msg_seq")
    people = find_people(with_texts(good), names)
    records = message_records(numbered, masked_lists(found, full), people, options,
                              keep=["batch", "_errors"], cluster_by="batch")

    written, refused = Observation("written"), Observation("refused")
    outputs = {target: f"{target}_staged-{run}" for target in (output, f"{output}_rejected")}
    write_batches(records.observe(
        written, F.count("*").alias("messages"),
        F.count_if(pii_changed(records)).alias("messages_with_pii"),
        F.count_if(F.size("_errors") > 0).alias("damaged")),
        outputs[output], base, drop_originals)
    rejected.select("msg_seq", "message_id", "delivery_time", "_error").observe(
        refused, F.count("*").alias("rejected")
    ).write.mode("overwrite").parquet(outputs[f"{output}_rejected"])
    publish(spark, mapping_path, run, {
        "outputs": [[staged, target] for target, staged in outputs.items()]})
    for target, staged in outputs.items():
        move_in(spark, staged, target)
    return RunSummary(written.get["messages"], written.get["messages_with_pii"],
                      refused.get["rejected"], written.get["damaged"])
