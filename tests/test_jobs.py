"""The archive run from mail to CSV, and the shape of its plans."""

import contextlib
import io
import os

import pytest
from pyspark.sql import functions as F

import catalog.queries as Q
from mailveil.operators.folders import drop_calendar
from mailveil.operators.people import names_table
from mailveil.plans import jobs
from mailveil.plans.message_record import Options, find_people, message_records, with_masks, with_people, with_spans, with_texts
from mailveil.functions.masking import operators
from mailveil.functions.recognizers import Recognizer, registry
from mailveil.functions.spans import DIGIT_RUN
from mailveil.session import settle, shared_folder
from mailveil.sources.csv_files import CSV_COLUMNS, read_csv
from mailveil.sources.mail import read_mail, write_mail_table
from mailveil.sources.mapping import read_mapping
from mailveil.sources.sample_mail import load_mail
from tests import brute


def plan(df):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def mail(spark, small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("mail"))
    load_mail(spark, small).write.mode("overwrite").parquet(path)
    return read_mail(spark, path)


def test_archive_run_twice(spark, mail, tmp_path):
    mapping, first_out, second_out = (str(tmp_path / n) for n in ("mapping", "one", "two"))
    first = jobs.run_archive(spark, mail, mapping, first_out, batch_size=50)
    saved = sorted(tuple(r) for r in read_mapping(spark, mapping).collect())
    second = jobs.run_archive(spark, mail.repartition(7), mapping, second_out, batch_size=50, drop_originals=True)
    assert first == second
    assert sorted(tuple(r) for r in read_mapping(spark, mapping).collect()) == saved

    good = drop_calendar(mail).filter("message_id is not null and delivery_time is not null")
    assert first.messages == good.count() and first.rejected > 0 and 0 < first.messages_with_pii < first.messages
    assert spark.read.parquet(f"{first_out}_rejected").count() == first.rejected

    folders = sorted(d for d in os.listdir(first_out) if d.startswith("batch="))
    assert folders == [f"batch=mail_batch{n:04d}" for n in range(1, -(-first.messages // 50) + 1)]
    for folder in folders:
        assert len([f for f in os.listdir(f"{first_out}/{folder}") if f.endswith(".csv")]) == 1
    one, two = read_csv(spark, first_out), read_csv(spark, second_out)
    assert one.columns == [*CSV_COLUMNS, "batch"]
    assert "OriginalSubject" not in two.columns and "OriginalEmailBody" not in two.columns
    assert one.groupBy("batch").count().agg(F.max("count")).first()[0] == 50
    shared = two.columns
    assert sorted(map(tuple, one.select(shared).collect())) == sorted(map(tuple, two.collect()))
    assert one.filter(F.col("EmailFromMasked").contains("user0")).count() > 0


def test_records_do_not_depend_on_partitions(spark, mail):
    names = settle(names_table(mail), "names")

    def run(n):
        source = mail.repartition(n)
        masks = with_masks(with_spans(
            with_people(with_texts(source), find_people(with_texts(source), names)), Options()), Options())
        return sorted(tuple(r) for r in masks.select(
            "msg_seq", "subject_masked", "body_masked", "subject_synthetic", "body_synthetic").collect())

    assert run(1) == run(16)


def test_joined_spans_equal_a_search_of_the_joined_text(spark):
    """Numbers that start in the subject and end in the body are found in the joined text."""
    cases = [("ring 0412 345", "678 now"), ("ring 0412 345", "x"), ("+61", "412 345 678"), ("a 13", "20 32"),
             ("", "0412 345 678"), ("0412 345 678", ""), ("phone", "13 20 32")]
    rows = [(i, s, b) for i, (s, b) in enumerate(cases)]
    texts = spark.createDataFrame(rows, "msg_seq bigint, subject_text string, body_text string")
    got = with_spans(with_people(texts, None), Options()).collect()
    for row in got:
        for column, text in (("subject_spans", row["subject_text"]), ("body_spans", row["body_text"]),
                             ("joined_spans", f"{row['subject_text']} {row['body_text']}")):
            wanted = brute.find(text, registry())
            assert sorted((s["entity"], s["start"], s["end"]) for s in row[column]) == sorted(x[:3] for x in wanted)
    # Context words of the subject count for the body in the joined text only.
    last = got[-1]
    assert last["joined_spans"][0]["score"] == 1.0 and last["body_spans"][0]["score"] == 0.75


def test_plug_ins_and_own_replacements(spark):
    """A plug-in may cross from subject to body; several patterns leave no duplicates."""
    rows = [(1, "card 4111 1111", "1111 1111 ok"), (2, "x", "card 4111111111111111, mail a@b.org"), (3, "", "12345678")]
    texts = with_people(spark.createDataFrame(
        rows, "msg_seq bigint, subject_text string, body_text string"), None)
    two = Recognizer("CARD", ((r"\b(?:\d{4}\s?){3}\d{4}\b", 0.6), (r"\b\d{8}", 0.5)), context=("card",))
    options = Options(registry(["EMAIL_ADDRESS", "CARD"], extra=[two]), operators({"CARD": "[card]"}, defaults={}))
    got = with_masks(with_spans(texts, options), options).orderBy("msg_seq").collect()
    found = [sorted((s["start"], s["end"], s["entity"], s["score"]) for s in r["joined_spans"]) for r in got]
    assert found == [[(5, 24, "CARD", 0.95)], [(7, 23, "CARD", 0.95), (30, 37, "EMAIL_ADDRESS", 1.0)],
                     [(1, 9, "CARD", 0.5)]]
    assert [r["body_masked"] for r in got] == ["1111 1111 ok", "card [card], mail ", "[card]"]


def test_bodies_of_bucketed_mail_stay_in_place(spark, mail):
    write_mail_table(mail, "bucketed_mail", 8)
    table = spark.table("bucketed_mail")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        names = settle(names_table(table), "names")
        people = find_people(with_texts(drop_calendar(table)), names)
        lists = settle(jobs.masked_lists(
            jobs.survey_addresses(table, Q.M.empty_mapping(spark)), Q.M.empty_mapping(spark)), "lists")
        text = plan(message_records(table, lists, people))
        moved = [p for p in text.split("\n\n") if ") Exchange" in p.split("\n")[0]]
        assert moved
        assert not [p for p in moved if "plain_text_body" in p or "body_text" in p]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_mail")


def test_scans_read_only_what_is_needed(spark, mail):
    text = plan(Q.A.address_lists(mail))
    assert "ReadSchema: struct<msg_seq:bigint,transport_headers:string>" in text
    text = plan(mail.filter("folder = 'Top\\\\Inbox'").select("msg_seq"))
    assert "PushedFilters: [IsNotNull(folder), EqualTo(folder" in text


def test_record_plan(spark, mail):
    names = settle(names_table(mail), "names")
    people = find_people(with_texts(drop_calendar(mail)), names)
    empty = Q.M.empty_mapping(spark)
    lists = settle(jobs.masked_lists(jobs.survey_addresses(mail, empty), empty), "lists")
    records = message_records(mail, lists, people)
    text = plan(records)
    # No Python workers, no product, bodies shuffled at most once.
    assert "Python" not in text and "CartesianProduct" not in text and "BroadcastNestedLoop" not in text
    steps = text.split("\n\n")
    assert len([p for p in steps if ") Exchange" in p.split("\n")[0] and "html_body" in p]) <= 1
    # The texts are searched once: no step repeats an expression of another.
    logical = records._jdf.queryExecution().optimizedPlan().toString()
    assert logical.count(DIGIT_RUN) == 1
    # The pairs that may be names are a written table, so the body is cleaned once here; a
    # cleaning holds the comment pattern twice, for HTML bodies and for HTML in plain ones.
    assert logical.count("<!--.*?-->") == 2


class Unnamed:
    """A session on a cluster that names no shared folder."""

    class conf:
        @staticmethod
        def get(key, default):
            return default

    class sparkContext:
        master = "yarn"


def test_written_tables_go_to_the_shared_folder(spark, shared):
    assert shared_folder(spark, "x").startswith(f"{shared}/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
    with pytest.raises(ValueError):
        shared_folder(Unnamed(), "x")
