"""Named queries: each takes a session and a folder of tables and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailveil.functions import checksums, headers as H, text as T
from mailveil.functions.addresses import split_list
from mailveil.functions.binding import let
from mailveil.functions.encoded_words import decode_words
from mailveil.functions.html import (
    clean_if_html, html_to_text, looks_like_html, select_body, truncate_body,
)
from mailveil.functions.masking import PLACEHOLDERS, mask, operators
from mailveil.functions.recognizers import Recognizer, registry
from mailveil.functions.spans import (
    above, boost_context, counts_text, dedupe, detect, entity_tallies, locate, merge_adjacent,
    only, resolve,
)
from mailveil.functions.patterns import widen
from mailveil.functions.synthetic import GENERATORS, fill_placeholders, generate
from mailveil.operators import checks, folders, numbering, people as P, pseudonyms as A
from mailveil.plans import jobs
from mailveil.plans.file_parts import mask_parts, numbered_lines
from mailveil.plans.message_record import (
    BODY_COLUMNS, FIELDS, Options, find_people, joined_text, message_records, with_masks, with_people,
    with_spans, with_texts,
)
from mailveil.plans.texts import mask_texts
from mailveil.session import settle, shared_folder
from mailveil.sources import csv_files, mapping as M
from mailveil.sources.mail import MAIL_SCHEMA
from mailveil.sources.sample_mail import dealt, load_mail, load_mapping, load_names

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters of the queries.
BATCH_SIZE = 100
MAX_BODY = 65535
FOLDER_CAP = 50
MESSAGES_PER_FOLDER = 100
FIRST_MESSAGES = 150
ONE_FOLDER_MESSAGES = 200
SAMPLE = 20
THRESHOLD = 0.8
FOLDER_PATH = "TOP/inbox"
ONE_FOLDER_PATH = "projects/Inbox"
CUSTOM_OPERATORS = {"AU_MOBILE": "<<PHONE>>", "PERSON": "somebody"}
US_PHONE = r"\(?\b[0-9]{3}\)?[-. ][0-9]{3}[-. ][0-9]{4}\b"
CARD = Recognizer(
    "CARD_NUMBER", ((r"\b\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}\b", 0.6),),
    context=("card",), validator=checksums.valid_luhn, numeric=True,
)
# A plug-in with two patterns, the second of which also matches inside the first.
CARD_PARTS = Recognizer(
    "CARD_NUMBER", ((r"\b\d{16}\b", 0.6), (r"\d{8}", 0.3)), numeric=True)


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


# ---- shared steps -------------------------------------------------------------------

def kept_mail(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    wanted = {"msg_seq", "message_class", *columns} if columns else None
    return folders.drop_calendar(load_mail(spark, sf, wanted))


def kept_texts(spark: SparkSession, sf: str) -> DataFrame:
    return with_texts(kept_mail(spark, sf)).select("msg_seq", "subject_text", "body_text")


def kept_spans(spark: SparkSession, sf: str, options: Options | None = None) -> DataFrame:
    # Texts are read twice, and those of HTML are costly to make.
    texts = settle(kept_texts(spark, sf), "texts")
    names = settle(load_names(spark, sf), "names")
    return with_spans(with_people(texts, find_people(texts, names)), options or Options())


def kept_masks(spark: SparkSession, sf: str, synthetic: bool = False) -> DataFrame:
    return with_masks(kept_spans(spark, sf), Options(), synthetic)


def span_rows(df: DataFrame, spans: Column, *keys: str) -> DataFrame:
    # Spark filters on the array it explodes; on a bare column that filter would move down
    # past the detection and repeat it.
    rows = df.select(*keys, F.explode(F.filter(spans, lambda s: s.isNotNull())).alias("s"))
    return rows.select(
        *keys, F.col("s.entity").alias("entity"), F.col("s.start").cast("bigint").alias("start_pos"),
        F.col("s.end").cast("bigint").alias("end_pos"), F.col("s.score").alias("score"))


def occurrences(spark: SparkSession, sf: str) -> DataFrame:
    return A.address_union(A.address_lists(kept_mail(spark, sf, "transport_headers")))


def old_mapping(spark: SparkSession, sf: str) -> DataFrame:
    """The mapping of an earlier run, an input. It is derived anew for each query, which
    may read it several times."""
    return settle(load_mapping(spark, sf), "saved-mapping")


def run_addresses(spark: SparkSession, sf: str) -> tuple[jobs.Addresses, DataFrame]:
    """Addresses of this run and the mapping with the new pairs."""
    old = old_mapping(spark, sf)
    found = jobs.survey_addresses(load_mail(
        spark, sf, ["msg_seq", "message_class", "transport_headers"]), old)
    return found, old.unionByName(found.new)


def records(spark: SparkSession, sf: str, keep: tuple[str, ...] = ()) -> DataFrame:
    found, full = run_addresses(spark, sf)
    # Texts are read twice, and those of HTML are costly to make.
    mail = settle(with_texts(kept_mail(spark, sf)).drop(*BODY_COLUMNS), "mail")
    names = settle(load_names(spark, sf), "names")
    people = find_people(mail, names)
    if keep:
        batches = numbering.number_batches(kept_mail(spark, sf, "msg_seq"), BATCH_SIZE)
        mail = mail.join(settle(batches.select("msg_seq", "batch"), "batches"), "msg_seq")
    return message_records(mail, jobs.masked_lists(found, full), people, keep=keep,
                           cluster_by="batch" if keep else None)


def plain_record(record: DataFrame, *keys: str) -> DataFrame:
    """Numbers as bigint and the date as text, for comparison."""
    changed = {"EmailReceivedDate": F.col("EmailReceivedDate").cast("string")}
    for name in ("PIICount", "NoOfAttachments", "ReplyDepth"):
        changed[name] = F.col(name).cast("bigint")
    return record.select(*keys, *[changed.get(f, F.col(f)).alias(f) for f in FIELDS])


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")


def pages(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html")


# ---- sources and sinks --------------------------------------------------------------

@query
def mail_scan(spark, sf):
    changed = {"delivery_time": F.col("delivery_time").cast("string"),
               "number_of_attachments": F.col("number_of_attachments").cast("bigint"),
               "attachments": F.array_join("attachments", ", ")}
    return load_mail(spark, sf).select(
        *[changed.get(f.name, F.col(f.name)).alias(f.name) for f in MAIL_SCHEMA])


@query
def folder_list(spark, sf):
    return folders.list_folders(load_mail(spark, sf, ["folder"]))


@query
def mapping_scan(spark, sf):
    """A mapping that was saved twice, the second time with other ids: the last row wins."""
    path = shared_folder(spark, "mapping")
    M.create_mapping(spark, path)
    first = old_mapping(spark, sf)
    M.append_mapping(first, path)
    again = first.select(
        (F.col("id") + first.agg(F.max("id")).scalar()).alias("id"),
        F.lower("original_email").alias("original_email"), "anonymized_email")
    M.append_mapping(again, path)
    return M.read_mapping(spark, path)


@query
def mapping_append(spark, sf):
    path = shared_folder(spark, "mapping")
    M.append_mapping(old_mapping(spark, sf), path)
    found = jobs.survey_addresses(
        load_mail(spark, sf, ["msg_seq", "message_class", "transport_headers"]),
        M.read_mapping(spark, path))
    M.append_mapping(found.new, path)
    return M.read_mapping(spark, path).select("id", "original_email", "anonymized_email")


def written_batches(spark: SparkSession, sf: str) -> str:
    path = shared_folder(spark, "csv")
    csv_files.write_batches(records(spark, sf, keep=("batch",)), path)
    return path


@query
def csv_batches(spark, sf):
    rows = csv_files.read_batches(spark, written_batches(spark, sf))
    text = {c: F.col(c).cast("string").alias(c) for c in csv_files.NUMBERS}
    return rows.select("batch", *[text.get(c, F.col(c)) for c in csv_files.CSV_COLUMNS])


@query
def csv_preview(spark, sf):
    rows = csv_files.read_batches(spark, written_batches(spark, sf))
    first = csv_files.preview(rows, 100, "MessageId", "EmailReceivedDate")
    return first.select("MessageId", "SubjectMasked", "PIIEntitiesFound",
                        F.col("PIICount").cast("bigint").alias("PIICount"),
                        F.col("ReplyDepth").cast("bigint").alias("ReplyDepth"))


@query
def mask_text_files(spark, sf):
    return mask_texts(documents(spark, sf), F.col("doc_id")).select("doc_id", "masked")


@query
def mask_file_parts(spark, sf):
    """Files of some twenty documents each, masked in chunks of about a fifth of a file."""
    folder = shared_folder(spark, "texts")
    rows = documents(spark, sf).select(
        F.call_function("div", F.col("doc_id"), F.lit(20)).alias("part"), "doc_id",
        F.coalesce("text", F.lit("")).alias("value"))
    (rows.repartition("part").sortWithinPartitions("part", "doc_id").select("part", "value")
     .write.partitionBy("part").text(folder))
    lines = numbered_lines(mask_parts(spark, folder, size=10_000))
    part = F.regexp_extract("file", "part=([0-9]+)", 1).cast("bigint")
    return lines.select(part.alias("part"), "line", "text")


# ---- filters and projections --------------------------------------------------------

@query
def drop_calendar(spark, sf):
    return kept_mail(spark, sf, "msg_seq").select("msg_seq", "message_class")


@query
def folder_path_match(spark, sf):
    mail = load_mail(spark, sf, ["folder"])
    matching = mail.filter(folders.folder_matches(F.col("folder"), FOLDER_PATH))
    first = folders.find_folder(mail, FOLDER_PATH).scalar()
    return matching.groupBy("folder").agg(F.count("*").alias("messages")).withColumn(
        "is_first", F.when(F.col("folder") == first, F.lit(1)).otherwise(F.lit(0)).cast("bigint"))


@query
def read_folder(spark, sf):
    mail = load_mail(spark, sf, ["msg_seq", "folder", "message_class", "subject"])
    return folders.read_folder(mail, ONE_FOLDER_PATH, ONE_FOLDER_MESSAGES).select("msg_seq", "folder", "subject")


@query
def body_select(spark, sf):
    body = select_body(F.col("plain_text_body"), F.col("body"), F.col("html_body"),
                       F.col("transport_headers"))
    return kept_mail(spark, sf).select("msg_seq", body.alias("body_text"))


@query
def html_sniff(spark, sf):
    texts = documents(spark, sf).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text")
    html = pages(spark, sf).select(F.lit("page").alias("kind"), F.col("page_id").alias("id"),
                                   F.col("html").alias("text"))
    return texts.unionByName(html).select(
        "kind", "id", looks_like_html(F.col("text")).cast("bigint").alias("is_html"),
        clean_if_html(F.col("text")).alias("cleaned"))


@query
def body_truncate(spark, sf):
    body = truncate_body(F.repeat("text", F.lit(8)), MAX_BODY)
    return documents(spark, sf).select("doc_id", body.alias("body")).select(
        "doc_id", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("digest"))


@query
def bytes_decode(spark, sf):
    """Texts with a genuine replacement character, half a character, and the first again."""
    raw = F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("EFBFBDFFC3EFBFBD")),
                   F.encode(F.lit("end"), "UTF-8"))
    return documents(spark, sf).select("doc_id", T.decode_bytes(raw).alias("decoded"))


@query
def error_body(spark, sf):
    """Documents of one source end in half a character."""
    bad = F.when(F.col("source") == "src4", F.unhex(F.lit("C3"))).otherwise(F.unhex(F.lit("")))
    raw = F.concat(F.encode("text", "UTF-8"), bad)
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    return rows.select("doc_id", T.decode_or_error(raw).alias("body"))


@query
def reject_rows(spark, sf):
    mail = checks.with_errors(load_mail(spark, sf, ["msg_seq", "message_id", "delivery_time"]))
    return mail.select(
        "msg_seq", F.when(F.col("_error").isNull(), "good").otherwise("rejected").alias("status"),
        F.col("_error").alias("error"))


@query
def entity_filter(spark, sf):
    wanted = registry(["EMAIL_ADDRESS", "IP_ADDRESS", "AU_TFN"])
    texts = kept_texts(spark, sf).withColumn("spans", detect(joined_text(), wanted))
    return span_rows(texts, F.col("spans"), "msg_seq")


@query
def score_threshold(spark, sf):
    texts = kept_texts(spark, sf).withColumn("spans", detect(joined_text(), registry()))
    return span_rows(texts, above(F.col("spans"), THRESHOLD), "msg_seq")


def as_record(masks: DataFrame) -> DataFrame:
    return masks.select(
        "msg_seq", F.col("subject_text").alias("OriginalSubject"),
        F.col("body_text").alias("OriginalEmailBody"), F.col("subject_masked").alias("Subject"),
        F.col("body_masked").alias("EmailBody"))


@query
def pii_changed(spark, sf):
    record = as_record(kept_masks(spark, sf))
    return record.select("msg_seq", checks.pii_changed(record).cast("bigint").alias("changed"))


@query
def message_record(spark, sf):
    return plain_record(records(spark, sf), "msg_seq")


@query
def preview(spark, sf):
    return as_record(kept_masks(spark, sf)).select(
        "msg_seq", T.subject_preview(F.col("Subject")).alias("subject_preview"),
        T.body_preview(F.col("EmailBody")).alias("body_preview"))


# ---- joins --------------------------------------------------------------------------

@query
def pseudonym_lookup(spark, sf):
    rows = occurrences(spark, sf)
    seen = settle(A.first_seen(rows), "seen")
    found = A.pseudonym_lookup(rows, old_mapping(spark, sf), seen)
    return found.select("msg_seq", F.col("field").cast("bigint").alias("field"),
                        F.col("pos").cast("bigint").alias("pos"), "raw", "pseudonym")


@query
def new_addresses(spark, sf):
    seen = A.first_seen(occurrences(spark, sf))
    return A.new_addresses(seen, old_mapping(spark, sf)).select("norm_email", "raw", "msg_seq")


@query
def folder_messages(spark, sf):
    mail = load_mail(spark, sf, ["msg_seq", "folder", "message_class", "subject"])
    return folders.folder_messages(mail, MESSAGES_PER_FOLDER).select("folder", "msg_seq", "place", "subject")


@query
def detect_person(spark, sf):
    texts = kept_texts(spark, sf).select("msg_seq", joined_text().alias("text"))
    people = P.person_spans(texts, settle(load_names(spark, sf), "names"))
    return span_rows(people, F.col("people"), "msg_seq")


# ---- aggregations -------------------------------------------------------------------

def tallies(spark: SparkSession, sf: str) -> DataFrame:
    rows = kept_spans(spark, sf).select("msg_seq", F.explode(entity_tallies(F.col("joined_spans"))).alias("t"))
    return rows.select("msg_seq", "t.entity", "t.n")


@query
def entity_counts(spark, sf):
    return tallies(spark, sf)


@query
def entity_counts_text(spark, sf):
    return kept_spans(spark, sf).select("msg_seq", counts_text(F.col("joined_spans")).alias("entities_found"))


@query
def pii_count(spark, sf):
    return kept_spans(spark, sf).select("msg_seq", F.size("joined_spans").cast("bigint").alias("pii_count"))


@query
def entity_totals(spark, sf):
    return checks.total_entities(tallies(spark, sf))


@query
def run_summary(spark, sf):
    return checks.summarize(as_record(kept_masks(spark, sf)))


@query
def batch_summary(spark, sf):
    return numbering.summarize_batches(numbering.number_batches(kept_mail(spark, sf, "msg_seq"), BATCH_SIZE))


@query
def mapping_max_id(spark, sf):
    return A.next_id(load_mapping(spark, sf))


@query
def first_seen_address(spark, sf):
    return A.first_seen(occurrences(spark, sf)).select(
        "norm_email", "msg_seq", F.col("field").cast("bigint").alias("field"),
        F.col("pos").cast("bigint").alias("pos"), "raw", "n")


@query
def attachment_count(spark, sf):
    number = H.attachment_count(F.col("number_of_attachments"), F.col("attachments"))
    return kept_mail(spark, sf, "number_of_attachments", "attachments").select(
        "msg_seq", number.cast("bigint").alias("attachments"))


# ---- windows, sort and limit --------------------------------------------------------

@query
def batch_number(spark, sf):
    return numbering.number_batches(kept_mail(spark, sf, "msg_seq"), BATCH_SIZE)


@query
def assign_pseudonyms(spark, sf):
    old = old_mapping(spark, sf)
    new = A.new_addresses(A.first_seen(occurrences(spark, sf)), old)
    return A.assign_pseudonyms(settle(new, "new"), old)


@query
def per_folder_cap(spark, sf):
    mail = load_mail(spark, sf, ["msg_seq", "folder", "message_class"])
    return folders.first_per_folder(mail, FOLDER_CAP)


@query
def max_messages(spark, sf):
    mail = load_mail(spark, sf, ["msg_seq", "message_class", "subject"])
    return folders.first_messages(mail, FIRST_MESSAGES).select("msg_seq", "subject")


@query
def sample_messages(spark, sf):
    # The first messages are taken before anything is detected or masked.
    texts = with_texts(folders.first_messages(load_mail(spark, sf), SAMPLE)).select(
        "msg_seq", "subject_text", "body_text")
    people = find_people(texts, settle(load_names(spark, sf), "names"))
    first = as_record(with_masks(with_spans(with_people(texts, people), Options()), Options(), False))
    return first.select(
        "msg_seq", "OriginalSubject", "Subject",
        T.body_preview(F.col("OriginalEmailBody")).alias("original_preview"),
        T.body_preview(F.col("EmailBody")).alias("masked_preview"))


# ---- set operations -----------------------------------------------------------------

@query
def address_union(spark, sf):
    return occurrences(spark, sf).select(
        "msg_seq", F.col("field").cast("bigint").alias("field"),
        F.col("pos").cast("bigint").alias("pos"), "raw", "norm_email")


@query
def mapping_merge(spark, sf):
    seen = settle(A.first_seen(occurrences(spark, sf)), "seen")
    return A.extend_mapping(seen, old_mapping(spark, sf))


# ---- detection ----------------------------------------------------------------------

DETECTORS = {
    "detect_au_mobile": "AU_MOBILE",
    "detect_au_mobile_int": "AU_MOBILE_INT",
    "detect_au_landline": "AU_LANDLINE",
    "detect_au_landline_int": "AU_LANDLINE_INT",
    "detect_au_13": "AU_13",
    "detect_au_1300": "AU_1300",
    "detect_au_1800": "AU_1800",
    "detect_au_tfn": "AU_TFN",
    "detect_au_abn": "AU_ABN",
    "detect_au_medicare": "AU_MEDICARE",
    "detect_au_licence": "AU_DRIVER_LICENSE",
    "detect_email": "EMAIL_ADDRESS",
    "detect_ip": "IP_ADDRESS",
}


def detector(entity: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        texts = kept_texts(spark, sf).select("msg_seq", joined_text().alias("text"))
        found = texts.select("msg_seq", "text", F.explode(detect(F.col("text"), registry([entity]))).alias("s"))
        return found.select(
            "msg_seq", F.col("s.start").cast("bigint").alias("start_pos"),
            F.col("s.end").cast("bigint").alias("end_pos"),
            F.substr("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("found"),
            F.col("s.score").alias("score"))
    return run


QUERIES.update({name: detector(entity) for name, entity in DETECTORS.items()})


def candidates(entity: str, valid: Callable[[Column], Column]) -> Query:
    """Every text of a number's shape, and whether its checksum holds."""
    pattern = next(r for r in registry([entity])).patterns[0][0]

    def run(spark: SparkSession, sf: str) -> DataFrame:
        texts = kept_texts(spark, sf).select("msg_seq", joined_text().alias("text"))
        hits = texts.select("msg_seq", F.explode(locate(F.col("text"), widen(pattern, True))).alias("h"))
        return hits.select("msg_seq", F.col("h.start").cast("bigint").alias("start_pos"),
                           F.col("h.text").alias("candidate"),
                           valid(F.col("h.text")).cast("bigint").alias("valid"))
    return run


QUERIES["valid_tfn"] = candidates("AU_TFN", checksums.valid_tfn)
QUERIES["valid_abn"] = candidates("AU_ABN", checksums.valid_abn)
QUERIES["valid_medicare"] = candidates("AU_MEDICARE", checksums.valid_medicare)


@query
def validated_score(spark, sf):
    texts = kept_texts(spark, sf).withColumn("spans", detect(joined_text(), registry()))
    return span_rows(texts, F.col("spans"), "msg_seq")


@query
def context_boost(spark, sf):
    recognizers = registry()
    texts = kept_texts(spark, sf).select("msg_seq", joined_text().alias("text"))
    texts = texts.withColumn("spans", detect(F.col("text"), recognizers))
    return span_rows(texts, boost_context(F.col("text"), F.col("spans"), recognizers), "msg_seq")


@query
def default_phone_off(spark, sf):
    """US-style numbers and the findings in each: no generic phone entity exists."""
    numbers = documents(spark, sf).select(
        "doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(US_PHONE), F.lit(0))).alias("pos", "number"))
    spans = detect(F.col("number"), registry())
    return numbers.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "number",
                          F.size(spans).cast("bigint").alias("findings"))


@query
def spans_dedupe(spark, sf):
    found = documents(spark, sf).withColumn("spans", detect(F.col("text"), [CARD_PARTS]))
    return span_rows(found, dedupe(F.col("spans")), "doc_id")


@query
def spans_resolve(spark, sf):
    return span_rows(kept_spans(spark, sf), resolve(F.col("joined_spans")), "msg_seq")


@query
def spans_merge_adjacent(spark, sf):
    spans = kept_spans(spark, sf).select("msg_seq", joined_text().alias("text"), "joined_spans")
    return span_rows(spans, merge_adjacent(F.col("text"), resolve(F.col("joined_spans"))), "msg_seq")


@query
def mask_text(spark, sf):
    spans = kept_spans(spark, sf).select("msg_seq", joined_text().alias("text"), "joined_spans")
    return spans.select("msg_seq", mask(F.col("text"), F.col("joined_spans")).alias("masked"))


@query
def mask_redact(spark, sf):
    """Without any operator every finding is removed."""
    spans = kept_spans(spark, sf).select("msg_seq", joined_text().alias("text"), "joined_spans")
    kept = operators({"EMAIL_ADDRESS": PLACEHOLDERS["EMAIL_ADDRESS"]}, defaults={})
    return spans.select("msg_seq", mask(F.col("text"), F.col("joined_spans"), kept).alias("masked"))


@query
def mask_custom(spark, sf):
    spans = kept_spans(spark, sf).select("msg_seq", joined_text().alias("text"), "joined_spans")
    return spans.select("msg_seq", mask(
        F.col("text"), F.col("joined_spans"), operators(CUSTOM_OPERATORS)).alias("masked"))


@query
def mask_message(spark, sf):
    return kept_masks(spark, sf).select("msg_seq", "subject_masked", "body_masked")


# ---- synthetic values ---------------------------------------------------------------

@query
def synthetic_text(spark, sf):
    """The given documents, masked and filled."""
    return mask_texts(documents(spark, sf), F.col("doc_id"), synthetic=True).select(
        "doc_id", F.col("masked").alias("synthetic"))


@query
def synthetic_message(spark, sf):
    return kept_masks(spark, sf, synthetic=True).select("msg_seq", "subject_synthetic", "body_synthetic")


GENERATOR_QUERIES = {
    "gen_tfn": "AU_TFN",
    "gen_abn": "AU_ABN",
    "gen_medicare": "AU_MEDICARE",
    "gen_licence": "AU_DRIVER_LICENSE",
    "gen_mobile": "AU_MOBILE",
    "gen_mobile_int": "AU_MOBILE_INT",
    "gen_landline": "AU_LANDLINE",
    "gen_landline_int": "AU_LANDLINE_INT",
    "gen_13": "AU_13",
    "gen_1300": "AU_1300",
    "gen_1800": "AU_1800",
    "gen_person": "PERSON",
    "gen_email": "EMAIL_ADDRESS",
    "gen_ip": "IP_ADDRESS",
}


def generator(entity: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return load_mail(spark, sf, ["msg_seq"]).select(
            "msg_seq", generate(entity, F.col("msg_seq"), F.lit("body")).alias("value"))
    return run


QUERIES.update({name: generator(entity) for name, entity in GENERATOR_QUERIES.items()})


@query
def synthetic_redetect(spark, sf):
    """Values of each type and how many their own detector does not find again."""
    values = [F.struct(F.lit(e).alias("entity"), generate(e, F.col("msg_seq"), F.lit("body")).alias("value"))
              for e in GENERATORS if e != "PERSON"]
    messages = load_mail(spark, sf, ["msg_seq"])
    rows = messages.select(F.explode(F.array(*values)).alias("v")).select("v.*")
    whole = F.exists(detect(F.col("value"), registry()), lambda s: (
        (s["entity"] == F.col("entity")) & (s["start"] == 0) & (s["end"] == F.length("value"))))
    return rows.groupBy("entity").agg(F.count("*").alias("generated"),
                                      F.count_if(~whole).alias("failures"))


# ---- addresses ----------------------------------------------------------------------

@query
def normalize_email(spark, sf):
    return occurrences(spark, sf).select("msg_seq", "raw", H.normalize_email(
        F.concat(F.lit(" "), "raw", F.lit("  "))).alias("normalized"))


@query
def address_passthrough(spark, sf):
    """Names and addresses through the mapping: what holds no ``@`` comes back as it is."""
    every = let(H.addresses_column(), lambda a: F.concat(a["from"], a["to"], a["cc"]))
    parts = kept_mail(spark, sf, "transport_headers").select("msg_seq", F.posexplode(F.flatten(
        F.transform(every, lambda a: F.array(a["name"], a["email"])))).alias("pos", "raw"))
    rows = parts.withColumn("field", F.lit(0)).withColumn(
        "norm_email", F.when(F.contains("raw", F.lit("@")), H.normalize_email(F.col("raw"))))
    found = A.pseudonym_lookup(rows, old_mapping(spark, sf), settle(A.first_seen(rows), "seen"))
    return found.select("msg_seq", F.col("pos").cast("bigint").alias("pos"), "raw",
                        F.col("pseudonym").alias("result"))


@query
def email_domain(spark, sf):
    return occurrences(spark, sf).select("msg_seq", "raw", H.email_domain(F.col("raw")).alias("domain"))


@query
def pseudonym_list(spark, sf):
    """One untidy list per message, with blanks and empty items."""
    lists = A.address_lists(kept_mail(spark, sf, "transport_headers"))
    untidy = lists.select(
        "msg_seq", F.concat_ws(" ;; ", "email_from", "email_to", F.lit("  "), "email_cc").alias("email_from"),
        F.lit("").alias("email_to"), F.lit("").alias("email_cc"))
    rows = A.address_union(untidy)
    found = A.pseudonym_lookup(rows, old_mapping(spark, sf), settle(A.first_seen(rows), "seen"))
    return A.rebuild_lists(found).select("msg_seq", F.col("masked_from").alias("pseudonyms"))


@query
def pseudonym_header(spark, sf):
    mail = kept_mail(spark, sf, "transport_headers")
    seen = settle(A.first_seen(occurrences(spark, sf)), "seen")
    return A.pseudonym_header(mail, old_mapping(spark, sf), "To", seen)


@query
def pseudonym_messages(spark, sf):
    found, full = run_addresses(spark, sf)
    return jobs.masked_lists(found, full)


# ---- HTML and text ------------------------------------------------------------------

@query
def html_to_text_query(spark, sf):
    return pages(spark, sf).select("page_id", html_to_text(F.col("html")).alias("text"))


QUERIES["html_to_text"] = QUERIES.pop("html_to_text_query")


@query
def strip_invisible(spark, sf):
    """Documents with invisible characters put between their words."""
    mixed = F.replace(F.col("text"), F.lit(" "), F.lit(T.SPACE_LIKE + T.ZERO_WIDTH))
    return documents(spark, sf).select("doc_id", T.strip_invisible(mixed).alias("text"))


@query
def collapse_newlines(spark, sf):
    """Documents with more empty lines and spaces at line ends."""
    spread = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(".\r\n \u00a0\n\t\r\n ")),
                       F.lit(", "), F.lit(", \r\n"))
    return documents(spark, sf).select("doc_id", T.collapse_newlines(spread).alias("text"))


@query
def csv_sanitize(spark, sf):
    return load_mail(spark, sf, ["msg_seq", "transport_headers"]).select(
        "msg_seq", T.csv_safe(F.col("transport_headers")).alias("safe"))


# ---- headers and threads ------------------------------------------------------------

@query
def header_fields(spark, sf):
    h = H.unfold(F.col("transport_headers"))
    names = {"message_id": "Message-ID", "in_reply_to": "In-Reply-To", "refs": "References",
             "from_header": "From", "cc_header": "CC"}
    values = F.array(*[H.header_field(h, name) for name in names.values()],
                     F.array_join(H.header_values(h, "to"), " | "))
    rows = load_mail(spark, sf, ["msg_seq", "transport_headers"]).select(
        "msg_seq", values.alias("written"))
    return rows.select("msg_seq", H.decoded_column("written").alias("v")).select("msg_seq", *[
        F.get("v", F.lit(i)).alias(alias) for i, alias in enumerate([*names, "to_headers"])])


@query
def encoded_words(spark, sf):
    """Whole texts as encoded words, cut in the middle of characters, and texts without any."""
    i = F.col("doc_id")
    starts = F.sequence(F.lit(1), F.greatest(F.octet_length("text"), F.lit(1)), F.lit(41))
    # The bytes are named, or each piece would encode the whole text again.
    based = let(F.encode("text", "UTF-8"), lambda raw: F.array_join(F.transform(
        starts, lambda k: F.concat(F.lit("=?UTF-8?B?"), F.base64(F.substr(raw, k, F.lit(41))),
                                   F.lit("?="))), "\r\n "))
    quoted = F.concat(F.lit("=?utf-8?q?"), F.regexp_replace(
        F.hex(F.encode("text", "UTF-8")), "(..)", "=$1"), F.lit("?="))
    header = F.when(i % 3 == 0, based).when(i % 3 == 1, quoted).otherwise(
        F.concat(F.lit("Re: =?utf-8?B?!?= "), F.col("text")))
    rows = dealt(documents(spark, sf))
    return rows.select("doc_id", let(header, decode_words).alias("decoded"))


@query
def address_grammar(spark, sf):
    """Lists with quoted pairs, groups, comments, odd local parts, routes and encoded names."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "source")
    forms = [
        ("Ann ", "doc_id", " <ann", "doc_id", "@x.org>, \"Doe, J. \\\"", "lang", "\\\"\" <doe@",
         "source", ".org>"),
        ("Team ", "source", ": a", "doc_id", "@x.org, Bob (the (second) one) <b@x.org>;, c@x.org"),
        ("c", "doc_id", "@x.org (", "lang", " \\(x\\))"),
        ("\"odd one\"@x.org, <@r.org:d", "doc_id", "@x.org>"),
    ]
    written = [F.concat(*[F.lit(p) if k % 2 == 0 else F.col(p).cast("string")
                          for k, p in enumerate(form)]) for form in forms]
    name = F.base64(F.encode(F.concat(F.lit("Zoë, "), F.col("doc_id")), "UTF-8"))
    written.append(F.concat(F.lit("=?utf-8?B?"), name, F.lit("?= <z@x.org>")))
    value = F.get(F.array(*written), (F.col("doc_id") % 5).cast("int"))
    parsed = rows.select("doc_id", F.posexplode(split_list(value)).alias("pos", "a"))
    return parsed.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "a.name", "a.email")


def threads(spark: SparkSession, sf: str) -> DataFrame:
    return load_mail(spark, sf, ["msg_seq", "transport_headers"]).select(
        "msg_seq", H.thread_info(F.col("transport_headers")).alias("t"))


@query
def references_list(spark, sf):
    rows = threads(spark, sf).select("msg_seq", F.posexplode("t.references").alias("pos", "reference"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def thread_id(spark, sf):
    return threads(spark, sf).select("msg_seq", F.col("t.thread_id").alias("thread_id"))


@query
def parent_id(spark, sf):
    return threads(spark, sf).select("msg_seq", F.col("t.parent_id").alias("parent_id"))


@query
def reply_depth(spark, sf):
    return threads(spark, sf).select(
        "msg_seq", F.coalesce("t.reply_depth", F.lit(0)).cast("bigint").alias("reply_depth"))


@query
def references_text(spark, sf):
    return threads(spark, sf).select(
        "msg_seq", F.coalesce(H.references_text(F.col("t.references")), F.lit("")).alias("references_text"))


@query
def parse_addresses(spark, sf):
    mail = load_mail(spark, sf, ["msg_seq", "transport_headers"])
    parsed = mail.select("msg_seq", H.addresses_column().alias("a"))
    tagged = F.concat(*[
        F.transform(F.col(f"a.{part}"), lambda x, i: F.struct(
            F.lit(name).alias("field"), i.cast("bigint").alias("pos"), x["name"].alias("name"),
            x["email"].alias("email")))
        for part, name in (("from", "From"), ("to", "To"), ("cc", "Cc"))])
    return parsed.select("msg_seq", F.explode(tagged).alias("x")).select("msg_seq", "x.*")


@query
def format_addresses(spark, sf):
    return A.address_lists(load_mail(spark, sf, ["msg_seq", "transport_headers"]))


# ---- options of users ---------------------------------------------------------------

@query
def custom_recognizer(spark, sf):
    recognizers = registry(["CARD_NUMBER"], extra=[CARD])
    found = documents(spark, sf).withColumn("spans", detect(F.col("text"), recognizers))
    return span_rows(found, only(F.col("spans"), ["CARD_NUMBER"]), "doc_id")


@query
def pseudonym_options(spark, sf):
    seen = settle(A.first_seen(occurrences(spark, sf)), "seen")
    return A.assign_pseudonyms(seen, M.empty_mapping(spark), keyword="person", width=4)


@query
def seed_option(spark, sf):
    """Two runs with one seed agree; another seed differs."""
    def run(seed: int) -> Column:
        return fill_placeholders(F.lit("call <<AU_MOBILE>> or <<EMAIL>>"), F.col("msg_seq"), F.lit("body"), seed)
    rows = load_mail(spark, sf, ["msg_seq"]).select(
        "msg_seq", run(42).alias("first"), run(42).alias("again"), run(7).alias("other"))
    return rows.select(
        "msg_seq", "first", "other", (F.col("first") == F.col("again")).cast("bigint").alias("repeats"),
        (F.col("first") != F.col("other")).cast("bigint").alias("differs"))
