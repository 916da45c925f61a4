"""Archive runs that end early and are repeated, and messages that cannot be read."""

import pytest
from pyspark.sql import functions as F

from mailveil.operators.checks import split_rejects
from mailveil.plans import jobs
from mailveil.sources.csv_files import read_csv
from mailveil.sources.mail import BODY_ERROR, checked_mail
from mailveil.sources.mapping import append_mapping, create_mapping, read_mapping
from mailveil.sources.runs import Files, published

HEAD = "From: Ann Lee <ann@x.org>\r\nTo: <bob@y.org>, Cy <cy{0}@z.org>\r\n"


def small_mail(spark, low=1, high=30):
    rows = [(i, f"id-{i}", "Top", f"note {i}", f"call 0400 123 4{i % 90 + 10} Ann Lee", HEAD.format(i))
            for i in range(low, high)]
    return spark.createDataFrame(rows, "msg_seq long, message_id string, folder string, subject string, "
                                       "body string, transport_headers string").withColumn(
        "delivery_time", F.expr("timestamp_ntz'2024-01-01 00:00:00'"))


def results(spark, mapping, out):
    rows = read_csv(spark, out)
    return (sorted(map(tuple, read_mapping(spark, mapping).collect())),
            sorted(map(tuple, rows.select(sorted(rows.columns)).collect())))


class Killed(Exception):
    pass


@pytest.fixture(scope="module")
def whole_run(spark, tmp_path_factory):
    """What a run that nothing stops gives."""
    folder = tmp_path_factory.mktemp("whole")
    mapping, out = str(folder / "mapping"), str(folder / "out")
    return jobs.run_archive(spark, small_mail(spark), mapping, out, batch_size=10), results(
        spark, mapping, out)


@pytest.mark.parametrize("step", ["write_batches", "publish", "second move"])
def test_a_killed_run_can_be_repeated(spark, tmp_path, monkeypatch, step, whole_run):
    paths = [str(tmp_path / n) for n in ("mapping", "out")]
    mail = small_mail(spark)
    name, calls = step if step != "second move" else "move_in", []
    real = getattr(jobs, name)

    def killed(*args, **kwargs):
        calls.append(1)
        if len(calls) == 1 + (step == "second move"):
            raise Killed
        return real(*args, **kwargs)

    monkeypatch.setattr(jobs, name, killed)
    with pytest.raises(Killed):
        jobs.run_archive(spark, mail, paths[0], paths[1], batch_size=10)
    monkeypatch.setattr(jobs, name, real)
    if step in ("write_batches", "publish"):
        # Nothing was published, so other mail may come first and takes the first ids.
        assert read_mapping(spark, paths[0]).count() == 0
    again = jobs.run_archive(spark, mail, paths[0], paths[1], batch_size=10)
    assert (again, results(spark, paths[0], paths[1])) == whole_run
    ids = [r.id for r in read_mapping(spark, paths[0]).collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    assert not [f for f in Files(spark, paths[0]).folders(paths[0]) if f.startswith("_staged")]


def test_output_of_a_run_ended_late_is_moved_in_first(spark, tmp_path, monkeypatch):
    mapping, one, two = (str(tmp_path / n) for n in ("mapping", "one", "two"))
    with monkeypatch.context() as patch:
        patch.setattr(jobs, "move_in", lambda *args: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            jobs.run_archive(spark, small_mail(spark), mapping, one)
    assert not Files(spark, one).exists(one)
    jobs.run_archive(spark, small_mail(spark, 30, 40), mapping, two)
    assert read_csv(spark, one).count() == 29 and read_csv(spark, two).count() == 10
    assert len(published(spark, mapping)) == 2


def test_a_named_run_adds_its_pairs_once(spark, tmp_path):
    path = str(tmp_path / "mapping")
    create_mapping(spark, path)
    new = spark.createDataFrame([(1, "A@x.org", "user1@x.org")], "id long, original_email string, "
                                                                "anonymized_email string")
    append_mapping(new, path, run="r1", manifest={"note": "first"})
    append_mapping(new.withColumn("id", F.lit(9).cast("long")), path, run="r1")
    assert [tuple(r) for r in read_mapping(spark, path).collect()] == [
        (1, "A@x.org", "user1@x.org", "a@x.org")]
    assert published(spark, path) == [{"run": "r1", "note": "first"}]


def dirty(spark):
    time = "2024-01-01 10:00:00"
    head = HEAD.format(1).encode()
    rows = [
        ("1", "ok", b"call 0400 123 456", None, head, time, "2"),
        ("2", "bad body", b"half \xc3", None, head, time, "2"),
        ("3", "bad html", None, b"<p>x\xff</p>", head, time, None),
        ("4", "bad head", b"text", None, head + b"Cc: <d\xff@x.org>\r\n", time, "1"),
        ("5", "bad date", b"text", None, head, "yesterday", "1"),
        ("6", "bad number", b"text", None, head, time, "many"),
        ("seven", "bad sequence", b"text", None, head, time, "1"),
        ("8", None, b"text", None, head, time, "1"),
        (None, None, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, "msg_seq string, message_id string, body binary, html_body binary, "
                                       "transport_headers binary, delivery_time string, "
                                       "number_of_attachments string")


def test_what_cannot_be_read_is_noted(spark):
    rows = {r.message_id: r for r in checked_mail(dirty(spark)).collect() if r.message_id}
    assert rows["ok"]._errors == [] and rows["ok"].body == "call 0400 123 456"
    assert rows["bad body"].body == BODY_ERROR and rows["bad body"]._errors == ["body: invalid UTF-8"]
    assert rows["bad html"].html_body == BODY_ERROR
    assert rows["bad head"].transport_headers.endswith("Cc: <d@x.org>\r\n")
    assert rows["bad date"].delivery_time is None
    assert rows["bad number"]._errors == ["number_of_attachments: cannot read many"]
    good, rejected = split_rejects(checked_mail(dirty(spark)))
    assert good.count() == 5
    assert sorted(r._error for r in rejected.collect()) == [
        "no delivery time (delivery_time: cannot read yesterday)", "no message id",
        "no sequence number (msg_seq: cannot read seven)",
        "no sequence number, no message id, no delivery time"]


def test_a_run_goes_on_past_bad_messages(spark, tmp_path):
    mapping, out = str(tmp_path / "mapping"), str(tmp_path / "out")
    summary = jobs.run_archive(spark, dirty(spark), mapping, out)
    assert (summary.messages, summary.rejected, summary.damaged) == (5, 4, 4)
    rows = {r.MessageId: r for r in read_csv(spark, out).collect()}
    assert rows["bad body"].EmailBodyMasked == rows["bad html"].EmailBodyMasked == BODY_ERROR
    assert rows["ok"].EmailBodyMasked == "call <<AU_MOBILE>>"
    assert rows["bad number"].NoOfAttachments == "0" and rows["ok"].NoOfAttachments == "2"
    assert spark.read.parquet(f"{out}_rejected").count() == 4
