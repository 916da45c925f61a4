"""Mail tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailveil.functions.text import decode_bytes

TEXT_COLUMNS = ("plain_text_body", "body", "html_body", "transport_headers")

MAIL_SCHEMA = T.StructType([
    T.StructField("msg_seq", T.LongType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("folder", T.StringType()),
    T.StructField("message_class", T.StringType()),
    T.StructField("delivery_time", T.TimestampNTZType()),
    T.StructField("subject", T.StringType()),
    T.StructField("plain_text_body", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("html_body", T.StringType()),
    T.StructField("transport_headers", T.StringType()),
    T.StructField("number_of_attachments", T.IntegerType()),
    T.StructField("attachments", T.ArrayType(T.StringType())),
])
# What stands for a body whose bytes are no text.
BODY_ERROR = "[Error extracting body: invalid UTF-8]"
BODIES = ("plain_text_body", "body", "html_body")


def as_mail(df: DataFrame) -> DataFrame:
    """Any table with some of the mail columns as a full mail table.

    Missing columns become null and binary texts are decoded.
    """
    types = {f.name: f.dataType for f in df.schema}

    def column(field: T.StructField):
        if field.name not in types:
            return F.lit(None).cast(field.dataType).alias(field.name)
        value = F.col(field.name)
        if isinstance(types[field.name], T.BinaryType):
            value = decode_bytes(value)
        return value.cast(field.dataType).alias(field.name)

    return df.select(*[column(f) for f in MAIL_SCHEMA])


def checked_mail(df: DataFrame) -> DataFrame:
    """Any table as a full mail table with ``_errors``, what could not be read of each message.

    Bytes of a body that are no UTF-8 become a note in its place, those of other texts are
    read as far as they go. A value that does not fit its column becomes null. No row is lost
    and none ends the run; a table of the right types has no errors.
    """
    types = {f.name: f.dataType for f in df.schema}

    def read(field: T.StructField) -> tuple[Column, Column]:
        """The value, and what is wrong with it or null."""
        name, kind = field.name, types.get(field.name)
        if kind is None:
            return F.lit(None).cast(field.dataType), F.lit(None).cast("string")
        value = F.col(name)
        if isinstance(kind, T.BinaryType) and isinstance(field.dataType, T.StringType):
            text = F.try_validate_utf8(value.cast("string"))
            bad = value.isNotNull() & text.isNull()
            instead = F.lit(BODY_ERROR) if name in BODIES else decode_bytes(value)
            return (F.when(bad, instead).otherwise(text),
                    F.when(bad, F.lit(f"{name}: invalid UTF-8")))
        if kind == field.dataType:
            return value, F.lit(None).cast("string")
        cast = value.try_cast(field.dataType)
        shown = F.substring(value.cast("string"), 1, 40)
        return cast, F.when(value.isNotNull() & cast.isNull(), F.concat(
            F.lit(f"{name}: cannot read "), shown))

    columns = {f.name: read(f) for f in MAIL_SCHEMA}
    errors = F.filter(F.array(*[e for _, e in columns.values()]), lambda e: e.isNotNull())
    return df.select(*[v.alias(n) for n, (v, _) in columns.items()], errors.alias("_errors"))


def read_mail(spark: SparkSession, path: str) -> DataFrame:
    return as_mail(spark.read.parquet(path))


def write_mail_table(mail: DataFrame, table: str, buckets: int) -> None:
    """Mail bucketed by ``msg_seq``: joins back to messages then leave the bodies in place."""
    (mail.write.mode("overwrite").bucketBy(buckets, "msg_seq").sortBy("msg_seq")
     .format("parquet").saveAsTable(table))
