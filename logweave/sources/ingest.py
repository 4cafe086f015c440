"""JSON batches to validated log rows: one reason for each rejected entry, by its place in the batch.

A body is parsed once and an entry's fields are taken from it once, behind the generator; an attribute's kind and text
are found once, and its fault and rendering are read off them.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.functions.text import plain_number
from logweave.schema import LEVELS, month_of

#: Limits of the fields, in UTF-16 units.
SERVICE_UNITS, MESSAGE_UNITS = 255, 65_536
AHEAD = dt.timedelta(minutes=5)
STAMP = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})\z"
NUMBERS = ["TINYINT", "SMALLINT", "INT", "BIGINT", "FLOAT", "DOUBLE"]
#: What is said of a body that holds no entries.
MALFORMED, SHAPELESS = "malformed JSON", "request body must be an object containing a logs array"
#: Digits up to which a number's own text is that of the nearest double.
EXACT = 15
#: Arrays inside arrays that a message renders element by element.
NESTED = 4


def kind(value: Column) -> Column:
    """STRING, BOOLEAN, a number's type, VOID, OBJECT<...> or ARRAY<...>; null if there is no value."""
    return F.schema_of_variant(value)


def longer(text: Column, units: int) -> Column:
    """Has the text more UTF-16 units? Only one that has more than half as many characters is encoded to see."""
    return F.when(F.length(text) > units // 2, F.length(F.encode(text, "UTF-16BE")) / 2 > units).otherwise(False)


def as_string(value: Column, levels: int = NESTED) -> Column:
    """How a value of any type reads inside a message; an array's elements by commas, null ones empty."""
    of = kind(value)
    if levels:
        each = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.when(v.isNull() | (kind(v) == "VOID"), "").otherwise(as_string(v, levels - 1)))
        listed = F.array_join(each, ",")
    else:
        listed = F.regexp_replace(F.to_json(value), r'[\[\]"]', "")
    return (
        F.when(value.isNull(), "undefined").when(of == "VOID", "null").when(of.startswith("OBJECT"), "[object Object]")
        .when(of.startswith("ARRAY"), listed).when(is_number(of), plain_number(F.try_variant_get(value, "$", "double")))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def is_number(of: Column) -> Column:
    return of.isin(NUMBERS) | of.startswith("DECIMAL")


def number_text(value: Column, text: Column) -> Column:
    """plain_number of a number whose own text is known; a short text needs no double."""
    short = (F.length(text) <= EXACT) & ~F.contains(text, F.lit("E"))
    own = F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    return F.when(short, F.when(own == "-0", "0").otherwise(own)).otherwise(plain_number(F.try_variant_get(value, "$", "double")))


def rounded(text: Column) -> Column:
    """The instant with the seventh digit of its second rounded half to even."""
    ninth = F.rpad(F.regexp_extract(text, r"\.(\d{1,9})", 1), 9, "0")
    rest = F.substring(ninth, 7, 3).cast("int")
    up = (rest > 500) | (rest == 500) & (F.substring(ninth, 6, 1).cast("int") % 2 == 1)
    # up to six digits nothing is left to round
    return F.when(F.length(text) <= 27, text.try_cast("timestamp")).otherwise(F.timestamp_micros(F.unix_micros(text.try_cast("timestamp")) + F.when(up, 1).otherwise(0)))


def entries(bodies: DataFrame) -> DataFrame:
    """batch, index, entry (variant) of each element of the bodies' ``logs``. bodies: batch and body (JSON text).

    A body that is no object with such an array gives one row with a null index and its ``fault``; one with an empty array
    gives one of nulls.
    """
    parsed = bodies.select("batch", F.try_parse_json("body").alias("parsed")).withColumn("logs", F.try_variant_get("parsed", "$.logs", "array<variant>"))
    fault = F.when(F.col("parsed").isNull(), MALFORMED).when(F.col("logs").isNull(), SHAPELESS)
    return parsed.select("batch", fault.alias("fault"), F.posexplode_outer("logs").alias("index", "entry"))


def validated(bodies: DataFrame, now: dt.datetime, max_age_days: int = 0, bodies_too: bool = False) -> DataFrame:
    """batch, index, reason (null: accepted), and the log's columns.

    bodies_too: a body that holds no entries gives a row with a null index and the reason.
    """
    spark = bodies.sparkSession
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys counts
    field = lambda name: F.try_variant_get("entry", f"$.{name}", "variant")
    text = lambda name: F.try_variant_get(F.col(f"v_{name}"), "$", "string").alias(f"s_{name}")
    names, texts = ("timestamp", "level", "service", "message", "attributes"), ("timestamp", "level", "service", "message")
    found = entries(bodies)
    rows = found.where("index is not null or fault is not null" if bodies_too else "index is not null")
    rows = rows.select("batch", "index", "fault", "entry", *[field(n).alias(f"v_{n}") for n in names])
    rows = rows.select("*", *[text(n) for n in texts], *[kind(F.col(f"v_{n}")).eqNullSafe(F.lit("STRING")).alias(f"said_{n}") for n in texts], F.try_variant_get("v_attributes", "$", "map<string,variant>").alias("pairs"))
    item = lambda e: F.struct(e["key"].alias("key"), kind(e["value"]).alias("of"), F.try_variant_get(e["value"], "$", "string").alias("text"), e["value"].alias("value"))
    rows = rows.withColumns({"at": F.when(F.col("said_timestamp") & F.col("s_timestamp").rlike(STAMP), rounded(F.col("s_timestamp"))), "items": F.transform(F.map_entries("pairs"), item)})
    nul = F.lit("\0")
    now_ = F.lit(now.replace(tzinfo=dt.timezone.utc) if now.tzinfo is None else now)

    def attribute_fault(i: Column) -> Column:
        about = lambda said: F.concat(F.lit("attribute '"), i["key"], F.lit(said))
        return (
            F.when(F.contains(i["key"], nul), "attribute keys cannot contain a null character")
            .when(i["of"] == "STRING", F.when(F.contains(i["text"], nul), about("' contains an unsupported null character")))
            .when(i["of"] == "BOOLEAN", F.lit(None))
            .when(is_number(i["of"]), F.when(F.abs(F.try_variant_get(i["value"], "$", "double")) == float("inf"), about("' must be a finite number")))
            .otherwise(about("' must be a string, number, or boolean"))
        )

    is_object = F.when(F.coalesce(*[F.col(f"v_{n}") for n in names]).isNotNull(), True).otherwise(F.coalesce(kind(F.col("entry")).startswith("OBJECT"), F.lit(False)))
    first_fault = F.aggregate("items", F.lit(None).cast("string"), lambda found, i: F.coalesce(found, attribute_fault(i)))
    millis = lambda c: F.floor(F.unix_micros(c) / 1000)
    reason = (
        F.when(F.col("fault").isNotNull(), F.col("fault")).when(~is_object, "log entry must be an object")
        .when(~F.col("said_timestamp") | ~F.col("s_timestamp").rlike(STAMP), "timestamp must be a valid ISO 8601 value with an explicit timezone")
        .when(F.col("at").isNull(), "timestamp must be a valid ISO 8601 timestamp")
        .when(millis(F.col("at")) > millis(now_) + int(AHEAD.total_seconds() * 1000), "timestamp must not be more than five minutes in the future")
        .when(F.lit(max_age_days > 0) & (millis(F.col("at")) < millis(now_) - max_age_days * 86_400_000), "timestamp is older than the retention window")
        .when(~(F.col("said_level") & F.col("s_level").isin(LEVELS)), F.concat(F.lit("invalid level: '"), as_string(F.col("v_level")), F.lit("'")))
        .when(~F.col("said_service") | (F.length("s_service") == 0), "service must be a non-empty string")
        .when(longer(F.col("s_service"), SERVICE_UNITS), f"service must be at most {SERVICE_UNITS} characters")
        .when(F.contains("s_service", nul), "service contains an unsupported null character")
        .when(~F.col("said_message") | (F.length("s_message") == 0), "message must be a non-empty string")
        .when(longer(F.col("s_message"), MESSAGE_UNITS), f"message must be at most {MESSAGE_UNITS} characters")
        .when(F.contains("s_message", nul), "message contains an unsupported null character")
        .when(F.col("v_attributes").isNotNull() & F.col("pairs").isNull(), "attributes must be a flat object")
        .otherwise(first_fault)
    )
    shown = lambda i: F.when(is_number(i["of"]), number_text(i["value"], i["text"])).otherwise(i["text"])
    rendered = F.map_from_entries(F.transform("items", lambda i: F.struct(i["key"], shown(i))))
    empty = F.expr("cast(map() as map<string,string>)")
    return rows.select(
        "batch", F.col("index").cast("long").alias("index"), reason.alias("reason"), F.col("at").alias("timestamp"), F.col("s_level").alias("level"), F.col("s_service").alias("service"),
        F.col("s_message").alias("message"), F.coalesce("v_attributes", F.parse_json(F.lit("{}"))).alias("attributes"), F.coalesce(rendered, empty).alias("attr_text"), month_of(F.col("at")).alias("month"),
    )


def accepted(checked: DataFrame) -> DataFrame:
    return checked.where("reason is null").drop("reason")


def rejected(checked: DataFrame) -> DataFrame:
    return checked.where("reason is not null").select("batch", "index", "reason")


def entry_bytes(timestamp: Column, level: Column, service: Column, message: Column, attributes: Column) -> Column:
    """Estimated size of an entry: the UTF-8 bytes of its texts and its attributes' JSON, and 32 for the rest."""
    return F.octet_length(timestamp) + F.octet_length(level) + F.octet_length(service) + F.octet_length(message) + F.octet_length(F.to_json(attributes)) + 32
