"""A mail table derived from the ``documents`` and ``pages`` tables.

Those tables hold no Australian identifiers, so each document becomes a message with one
more line of known content, with headers, a class, a folder and so on, all computed from
``doc_id``. The recipe is in FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.operators.people import names_table
from mailveil.operators.pseudonyms import address_lists, address_union, assign_pseudonyms, first_seen
from mailveil.sources.mail import MAIL_SCHEMA
from mailveil.sources.mapping import empty_mapping

# Fixed values of the fixture.
FIRST = ("Alice", "Bianca", "Carlos", "Deepa", "Ewan", "Fiona", "Grace", "Hugo", "Ines", "Jonas")
LAST = ("Nguyen", "Okafor", "Petrov", "Quinn", "Rossi", "Silva", "Tanaka", "Usman", "Vargas", "Weber")
DOMAINS = ("Example.com", "example.org", "mail.example.net")
FOLDERS = ("Top\\Inbox", "Top\\Inbox\\Projects", "Top\\Sent Items", "Top\\Archive")
PEOPLE = 97
# Rows that are dealt out have so many partitions at least.
PARTS = 32


def _list(words: Iterable[str]) -> str:
    return "array(" + ", ".join("'" + w.replace("\\", "\\\\") + "'" for w in words) + ")"


def _weighted(text: str, weights: Iterable[int]) -> str:
    return "(" + " + ".join(
        f"cast(substr({text}, {i}, 1) as int) * {w}" for i, w in enumerate(weights, 1)) + ")"


MEDICARE_CHECK = _weighted("n", (1, 3, 7, 9, 1, 3, 7, 9)) + " % 10"
ABN_TAIL = "concat(n, cast(i % 10 as string))"
ABN_REST = f"((89 - {_weighted(ABN_TAIL, (3, 5, 7, 9, 11, 13, 15, 17, 19))} % 89) % 89)"
MOBILE = "'04' || substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || substr(n, 6, 3)"
MEDICARE_BODY = "substr(n, 1, 4) || ' ' || substr(n, 5, 4) || '3 '"

PII = (
    f"{MOBILE} || if(odd, ' ' || {MOBILE}, '')",
    "'+61 4' || substr(n, 1, 2) || ' ' || substr(n, 3, 3) || ' ' || substr(n, 6, 3)",
    "if(odd, '\u00e9', '') || '02 ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4)",
    "'+61 3 ' || substr(n, 1, 4) || ' ' || substr(n, 5, 4)",
    "'13 ' || substr(n, 1, 2) || ' ' || substr(n, 3, 2)",
    "translate('1300 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 3), ' ', if(odd, '\u00a0', ' '))",
    "'1800 ' || substr(n, 1, 3) || ' ' || substr(n, 4, 3)",
    "substr(n, 1, 3) || '-' || substr(n, 4, 3) || '-' || substr(n, 7, 2) || cast("
    + _weighted("n", (1, 4, 3, 7, 5, 8, 6, 9)) + " % 11 % 10 as string)",
    f"cast({ABN_REST} div 10 + 1 as string) || cast({ABN_REST} % 10 as string) || ' ' || "
    "substr(n, 1, 3) || ' ' || substr(n, 4, 3) || ' ' || substr(n, 7, 2) || cast(i % 10 as string)",
    f"translate({MEDICARE_BODY} || cast({MEDICARE_CHECK} as string), if(odd, ' ', ''), '')",
    f"{MEDICARE_BODY} || cast(({MEDICARE_CHECK} + 1) % 10 as string)",
    "'licence no ' || n",
    "'mail ann.' || i || '@example.com from 10.1.2.' || (i % 256)",
    "'bad 999.1.1.1'",
    "'Dear Alice Nguyen, thanks'",
    "'0412 345 678 050'",
)


def _person(k: str) -> tuple[str, str, str]:
    """First name, last name and address of a person number."""
    first = f"element_at(first_names, cast(({k}) % 10 as int) + 1)"
    last = f"element_at(last_names, cast(({k}) div 10 as int) + 1)"
    local = f"lower({first} || '.' || {last}) || (i div 50)"
    domain = f"element_at(domains, cast(({k}) % 3 as int) + 1)"
    return first, last, f"if(i % 2 = 1, upper({local}), {local}) || '@' || {domain}"


def _named(k: str) -> str:
    first, last, address = _person(k)
    return f"{first} || ' ' || {last} || ' <' || {address} || '>'"


def _headers() -> str:
    end = "'\\r\\n'"
    first, last, address = _person("(i * 3) % 97")
    quoted = f"'\"' || {last} || ', ' || {first} || '\" <' || {address} || '>'"
    references = (
        "array_join(transform(sequence(root, i - 1), r -> '<m' || r || '@mx.example.com>'), '\\r\\n ')"
    )
    lines = (
        f"'Message-ID: <m' || i || '@mx.example.com>' || {end}",
        f"if(depth > 0 and i % 3 <> 0, 'In-Reply-To: <m' || (i - 1) || '@mx.example.com>' || {end}, '')",
        f"if(depth > 0 and i % 4 <> 1, 'References: ' || {references} || {end}, '')",
        f"'From: ' || if(i % 6 = 0, {quoted}, {_named('(i * 3) % 97')}) || {end}",
        f"'To: ' || {_named('(i * 5 + 1) % 97')} || if(i % 2 = 0, ', ' || {_named('(i * 7 + 2) % 97')}, '') || {end}",
        f"if(i % 9 = 0, 'To: ' || {_named('(i * 2 + 5) % 97')} || {end}, '')",
        f"if(i % 4 = 0, if(i % 8 = 0, 'cc: ', 'Cc: ') || {_named('(i * 11 + 3) % 97')} || {end}, '')",
    )
    return f"if(i % 29 = 0, null, concat({', '.join(lines)}))"


NOTE = "text || '\\n' || 'Note: ' || pii || '\\n' || 'end'"
COLUMNS = {
    "msg_seq": "i + 1",
    "message_id": "if(i % 97 = 96, null, 'id-' || i)",
    "folder": f"element_at({_list(FOLDERS)}, cast(i % 4 as int) + 1)",
    "message_class": "case when i % 11 = 0 then 'IPM.Appointment' when i % 13 = 0 then "
                     "'ipm.schedule.meeting.request' when i % 17 = 0 then null else 'IPM.Note' end",
    "delivery_time": "if(i % 89 = 88, null, "
                     "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(7 * i as int)))",
    "subject": "case when i % 37 = 0 then null when i % 4 = 0 then 'Re: call ' || pii "
               "else 'Meeting notes ' || i end",
    "plain_text_body": f"if(i % 3 = 0, {NOTE}, null)",
    "body": f"if(i % 3 = 1 and i % 27 <> 25, {NOTE}, null)",
    "html_body": "if(i % 3 = 2 and i % 27 <> 26, html || '<p>' || pii || '</p>', null)",
    "transport_headers": _headers(),
    "number_of_attachments": "if(i % 5 = 0, null, cast(i % 4 as int))",
    "attachments": "if(i % 10 = 5, array('a' || i, 'b' || i), null)",
}


# Columns that hold the text of the document.
TEXT_SOURCES = ("plain_text_body", "body")


def dealt(rows: DataFrame) -> DataFrame:
    """The rows dealt out. The table may be one block of a file, so one task."""
    return rows.repartition(max(rows.rdd.getNumPartitions(), PARTS))


def load_mail(spark: SparkSession, folder: str, columns: Iterable[str] | None = None) -> DataFrame:
    """The mail table, or some of its columns. Pages are read only for HTML bodies."""
    wanted = [f.name for f in MAIL_SCHEMA if columns is None or f.name in set(columns)]
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    texts = [c for c in TEXT_SOURCES if c in wanted]
    rows = documents.select(F.col("doc_id").alias("i"), *(["text"] if texts else []))
    if texts:
        rows = dealt(rows)
    if "html_body" in wanted:
        pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "html")
        count = pages.agg(F.count("*")).scalar()
        # Only rows that have an HTML body look for a page; the others are not moved.
        wants = F.expr("i % 3 = 2 and i % 27 <> 26")
        paged = rows.filter(wants).withColumn("page_id", F.col("i") % count).join(
            pages, "page_id", "left").drop("page_id")
        rows = rows.filter(~wants).withColumn("html", F.lit(None).cast("string")).unionByName(paged)
    rows = (
        rows.withColumn("n", F.expr("lpad(cast((i * 7919 + 12345678) % 100000000 as string), 8, '0')"))
        .withColumn("odd", F.expr("(i div 16) % 2 = 1"))
        .withColumn("depth", F.expr("i % 5")).withColumn("root", F.expr("i - i % 5"))
        .withColumn("first_names", F.expr(_list(FIRST)))
        .withColumn("last_names", F.expr(_list(LAST)))
        .withColumn("domains", F.expr(_list(DOMAINS)))
        .withColumn("pii", F.expr(f"element_at(array({', '.join(PII)}), cast(i % 16 as int) + 1)"))
    )
    return rows.select(*[F.expr(COLUMNS[c]).alias(c) for c in wanted])


def load_names(spark: SparkSession, folder: str) -> DataFrame:
    return names_table(load_mail(spark, folder, ["transport_headers"]))


def load_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """The mapping an earlier run over the first quarter of the mail has left."""
    mail = load_mail(spark, folder, ["msg_seq", "transport_headers"])
    total = spark.read.parquet(f"{folder}/documents.parquet").agg(F.count("*")).scalar()
    earlier = mail.filter(F.col("msg_seq") * 4 <= total)
    seen = first_seen(address_union(address_lists(earlier)))
    return assign_pseudonyms(seen, empty_mapping(spark))
