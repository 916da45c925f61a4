"""Joins, numbering, folders, pseudonyms and sources on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from mailveil.functions import checksums, headers as H, text as T
from mailveil.functions.html import html_to_text
from mailveil.operators import folders
from mailveil.operators.lookup import hot_keys, lookup
from mailveil.operators.numbering import dense_sequence, number_batches
from mailveil.operators.people import capital_pairs, display_name
from mailveil.operators.pseudonyms import (
    address_union, assign_pseudonyms, build_pseudonym, extend_mapping, first_seen,
)
from mailveil.sources import csv_files, mapping as M
from mailveil.sources.mail import MAIL_SCHEMA, as_mail
from mailveil.sources.text_files import mask_files


def test_dense_sequence_over_many_buckets(spark):
    rng = random.Random(1)
    seqs = sorted(rng.sample(range(1, 4000), 900))
    df = spark.createDataFrame([(s,) for s in seqs], "msg_seq bigint").repartition(5)
    got = {r["msg_seq"]: r["dense"] for r in dense_sequence(df, "msg_seq", bucket=16, group=8).collect()}
    assert got == {s: i for i, s in enumerate(seqs, 1)}


def test_last_batch_that_is_exactly_full(spark):
    df = spark.range(1, 21).withColumnRenamed("id", "msg_seq")
    assert {r["batch"] for r in number_batches(df, 10).collect()} == {1, 2}


@pytest.mark.parametrize("rank_range", [7, 100_000])
def test_first_per_folder_with_a_hot_folder(spark, monkeypatch, rank_range):
    monkeypatch.setattr(folders, "RANK_RANGE", rank_range)
    rng = random.Random(2)
    rows = [(i, "hot" if rng.random() < 0.5 else rng.choice("abc"),
             "IPM.Appointment.x" if i % 10 == 0 else "IPM.Note") for i in range(1, 400)]
    df = spark.createDataFrame(rows, "msg_seq bigint, folder string, message_class string").repartition(4)
    got = {tuple(r) for r in folders.first_per_folder(df, 20).collect()}
    wanted = set()
    for name in ("hot", "a", "b", "c"):
        mine = [s for s, f, c in rows if f == name and c == "IPM.Note"][:20]
        wanted |= {(name, s, i) for i, s in enumerate(mine, 1)}
    assert got == wanted


def test_lookup_with_a_hot_key_and_nulls(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(3000)]
    facts = spark.createDataFrame(rows, "id bigint, key string")
    dim = spark.createDataFrame([("hot", "H"), *[(f"k{i}", f"v{i}") for i in range(0, 3000, 2)]], "key string, value string")
    counts = facts.filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    hot = hot_keys(counts, "key", parts=10)
    assert [r["key"] for r in hot.collect()] == ["hot"]
    got = {tuple(r) for r in lookup(facts, dim, "key", "value", F.col("id"), hot).select("id", "key", "value").collect()}
    known = {r["key"]: r["value"] for r in dim.collect()}
    assert got == {(i, k, known.get(k)) for i, k in rows}


def test_hot_keys_cannot_outnumber_the_parts(spark):
    counts = spark.createDataFrame([(f"k{i}", 10) for i in range(50)], "key string, n bigint")
    assert hot_keys(counts, "key", parts=10).count() == 0
    assert hot_keys(counts, "key", parts=51).count() == 50


def addresses(spark, rows):
    lists = spark.createDataFrame(rows, "msg_seq bigint, email_from string, email_to string, email_cc string")
    return address_union(lists)


def test_pseudonyms_follow_first_sight_and_survive_runs(spark):
    first = first_seen(addresses(spark, [
        (2, "Bob@X.com", "ann@x.com; BOB@x.com", ""), (1, "zoe@y.org", "nobody; zoe@Y.ORG", "bob@x.com")]))
    mapping = extend_mapping(first, M.empty_mapping(spark))
    got = {r["norm_email"]: (r["id"], r["anonymized_email"]) for r in mapping.collect()}
    assert got == {"zoe@y.org": (1, "user0000001@y.org"), "bob@x.com": (2, "user0000002@x.com"),
                   "ann@x.com": (3, "user0000003@x.com")}
    second = first_seen(addresses(spark, [(9, "new@x.com", "ann@x.com", "")]))
    again = extend_mapping(second, mapping)
    assert {r["norm_email"]: r["id"] for r in again.collect()} == {
        "zoe@y.org": 1, "bob@x.com": 2, "ann@x.com": 3, "new@x.com": 4}
    assert extend_mapping(second, again).count() == 4


def test_long_ids_are_kept_whole(spark):
    row = spark.range(1).select(build_pseudonym(F.lit(123456789), F.lit("x.com"))).first()
    assert row[0] == "user123456789@x.com"


def test_ids_do_not_depend_on_partitions(spark):
    rows = [(i, f"P{i % 37}@x.com", f"q{i % 11}@y.com", "") for i in range(1, 300)]
    seen = first_seen(addresses(spark, rows))
    runs = [
        sorted(tuple(r) for r in assign_pseudonyms(seen.repartition(n), M.empty_mapping(spark), bucket=10).collect())
        for n in (1, 16)]
    assert runs[0] == runs[1] and [r[0] for r in runs[0]] == list(range(1, 49))


def test_mapping_files(spark, tmp_path):
    path = str(tmp_path / "mapping")
    M.create_mapping(spark, path)
    assert M.read_mapping(spark, path).count() == 0
    rows = [(1, 'odd "name", x@y.com', "user0000001@y.com"), (2, "A@b.c", "user0000002@b.c"),
            (3, " a@B.c ", "user0000003@b.c")]
    M.append_mapping(spark.createDataFrame(rows, M.MAPPING_FILE_SCHEMA), path)
    got = {r["norm_email"]: r["id"] for r in M.read_mapping(spark, path).collect()}
    assert got == {'odd "name", x@y.com': 1, "a@b.c": 3}


def test_folder_path_ignores_order_and_case(spark):
    df = spark.createDataFrame([("Top\\Inbox\\Projects",), ("Top\\Inbox",), ("Top\\Sent Items",)], "folder string")
    def matching(path):
        return {r[0] for r in df.filter(folders.folder_matches(F.col("folder"), path)).collect()}
    assert matching("/INBOX/top/") == {"Top\\Inbox\\Projects", "Top\\Inbox"}
    assert matching("sent items") == {"Top\\Sent Items"}
    assert matching("box") == set()


def test_headers(spark):
    raw = ("Received: x\r\nmessage-id: <a@b>\r\nReferences: <r1@b>\r\n\t<r2@b>\r\n"
           'From: "Lee, Ann" <ann@x.com>\r\nTo: bob@x.com, "Q, ""R" <q@x.com>,\r\n Zed <z@x.com>\r\n'
           "To: second@x.com\r\nCc:  \r\n")
    df = spark.createDataFrame([(raw,), (None,)], "h string")
    t, none = [r[0] for r in df.select(H.thread_info(F.col("h"))).collect()]
    assert t.asDict() == {"message_id": "<a@b>", "thread_id": "<r1@b>", "parent_id": "<r2@b>",
                          "references": ["<r1@b>", "<r2@b>"], "reply_depth": 2}
    a, empty = [r[0] for r in df.select(H.header_addresses(F.col("h"))).collect()]
    assert [(x["name"], x["email"]) for x in a["from"]] == [("Lee, Ann", "ann@x.com")]
    assert [x["email"] for x in a["to"]] == ["bob@x.com", "q@x.com", "z@x.com", "second@x.com"]
    assert a["cc"] == [] and empty["from"] == []
    assert none is None or none["references"] == []


def test_wide_address_list(spark):
    raw = "To: " + ", ".join(f'"N, {i}" <u{i}@x.com>' for i in range(5000)) + "\r\n"
    row = spark.createDataFrame([(raw,)], "h string").select(F.size(H.header_addresses(F.col("h"))["to"])).first()
    assert row[0] == 5000


def test_attachment_count(spark):
    df = spark.createDataFrame([(3, None), (None, ["a", "b"]), (None, None), (-1, None)], "n int, a array<string>")
    assert [r[0] for r in df.select(H.attachment_count(F.col("n"), F.col("a"))).collect()] == [3, 2, 0, 0]


def test_html(spark):
    html = ("<html><head><title>t</title></head><body><!-- <p>no</p> --><script>if (a < b) {}</script>"
            "<p>One&nbsp;&amp;lt; two</p>\n\n\n<ul><li>x<li>y</ul><table><tr><td>1</td><td>2</td></tr></table>"
            "3 < 4<br/>end</body></html>")
    row = spark.createDataFrame([(html,)], "h string").select(html_to_text(F.col("h"))).first()
    assert row[0] == "One &lt; two\n\n* x\n* y\n\n1 2\n\n3 < 4\nend"


def test_bytes(spark):
    df = spark.createDataFrame([(b"caf\xc3\xa9 \xff\xc3(ok",), (b"plain",), (None,)], "b binary")
    assert [r[0] for r in df.select(T.decode_bytes(F.col("b"))).collect()] == ["café (ok", "plain", None]
    assert [r[0] for r in df.select(T.decode_or_error(F.col("b"))).collect()] == [
        "[Error extracting body: invalid UTF-8]", "plain", None]


def test_previews(spark):
    df = spark.createDataFrame([("", "x" * 201), (None, "y" * 200), ("s" * 60, "")], "s string, b string")
    got = [tuple(r) for r in df.select(T.subject_preview(F.col("s")), T.body_preview(F.col("b"))).collect()]
    assert got == [("(no subject)", "x" * 200 + "..."), ("(no subject)", "y" * 200), ("s" * 50, "")]


def test_names(spark):
    df = spark.createDataFrame([("Ann Lee met Bo Ek Åse Ødegård",), ("ann Lee",), ("É A",), ("",)], "t string")
    got = [[(p["start"], p["end"], p["name"]) for p in r[0]] for r in df.select(capital_pairs(F.col("t"))).collect()]
    assert got[0] == [(0, 7, "ann lee"), (12, 17, "bo ek"), (15, 21, "ek åse"), (18, 29, "åse ødegård")]
    assert got[1:] == [[], [(0, 3, "é a")], []]
    names = spark.createDataFrame([("Lee, Ann",), ("Ann Lee",)], "n string").select(display_name(F.col("n"))).collect()
    assert [r[0] for r in names] == ["ann lee", "ann lee"]


def test_checksums_and_generators(spark):
    df = spark.createDataFrame([("123 456 782", "51 824 753 556", "2951 74989 7")], "t string, a string, m string")
    row = df.select(checksums.valid_tfn(F.col("t")), checksums.valid_abn(F.col("a")),
                    checksums.valid_medicare(F.col("m")), checksums.valid_tfn(F.lit("12")),
                    checksums.valid_luhn(F.lit("4111 1111 1111 1111"))).first()
    assert list(row) == [True, True, True, False, True]


def test_mail_with_missing_and_binary_columns(spark):
    df = spark.createDataFrame([(1, b"caf\xc3\xa9")], "msg_seq int, plain_text_body binary")
    mail = as_mail(df)
    assert [f.dataType for f in mail.schema] == [f.dataType for f in MAIL_SCHEMA]
    assert mail.first()["plain_text_body"] == "café" and mail.first()["subject"] is None


def test_text_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("call 0400 123 456\nnow")
    (tmp_path / "in" / "blank.txt").write_text("  \n ".replace("\n", " "))
    for synthetic in (False, True):
        out = str(tmp_path / f"out{synthetic}")
        mask_files(spark, str(tmp_path / "in"), out, synthetic)
        rows = spark.read.parquet(out).collect()
        assert len(rows) == 1
        assert rows[0]["text"].startswith("call 04" if synthetic else "call <<AU_MOBILE>>\nnow")


def test_csv_preview_of_any_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text('MessageId,n\n"b ""q"" ",2\na,1\n')
    rows = csv_files.preview(csv_files.read_csv(spark, str(tmp_path / "x.csv"), infer=True), 1).collect()
    assert [tuple(r) for r in rows] == [("a", 1)]
