"""Sensor readings as they arrive: texts for times, entries for "no value", rows that do not name their source."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Entries that only stand for "no value", lower case, without the blanks around them.
NO_NAME = ["", "-", "--", "?", "n/a", "na", "nan", "nil", "none", "null", "unknown", "undefined", "dev-"]
NO_NUMBER = [-999.0, -9999.0, -99999.0]

FULL_TIME = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(\.\d{1,9})?\s*(UTC|GMT|Z|[+-]\d{2}:?\d{2})?$"


def named(c: Column | str) -> Column:
    """The text without blanks around it, or null where it only stands for "no value"."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    return F.when(~F.lower(text).isin(NO_NAME), text)


def measured(c: Column | str, no_number: list[float] = NO_NUMBER) -> Column:
    """The number, or null where it is null, NaN or a code for "no value"."""
    x = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(x) & ~x.isin(no_number), x)


def instant(c: Column | str) -> Column:
    """Microseconds since 1970 UTC of a text with a full, valid date and time; UTC if it states no zone; else null."""
    text = F.trim(F.col(c) if isinstance(c, str) else c)
    zone = F.regexp_extract(text, FULL_TIME, 2)
    plain = F.regexp_replace(text, r"\s*(UTC|GMT|Z|[+-]\d{2}:?\d{2})$", "")
    offset = F.when(zone.rlike(r"^[+-]"), F.concat(F.substring(zone, 1, 3), F.lit(":"), F.substring(zone, -2, 2))).otherwise(F.lit("Z"))
    return F.when(text.rlike(FULL_TIME), F.unix_micros(F.concat(plain, offset).try_cast("timestamp")))


def batch_names(df: DataFrame, device: str = "deviceId", batch: str = "batch_id") -> DataFrame:
    """``batch``, ``batch_device``: the device that a batch's rows name; the smallest name if they name several."""
    return df.where(F.col(batch).isNotNull()).select(batch, named(device).alias("name")).where("name is not null").groupBy(batch).agg(F.min("name").alias("batch_device"))


def with_device(df: DataFrame, device: str = "deviceId", batch: str = "batch_id") -> DataFrame:
    """df with ``device_known``: the device that the row or else its batch names, null if neither does.

    Only the rows without a name are joined; the names are first reduced to one per batch, so neither a
    hot device nor a hot batch is gathered in one task.
    """
    own = df.withColumn("device_known", named(device))
    nameless = own.where("device_known is null").drop("device_known")
    found = nameless.join(batch_names(df, device, batch).withColumnRenamed(batch, "__batch"), F.col(batch) == F.col("__batch"), "left")
    return own.where("device_known is not null").unionByName(found.withColumn("device_known", F.col("batch_device")).drop("__batch", "batch_device"))
