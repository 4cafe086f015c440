"""Text forms: UTC time stamps and numbers as plain decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def iso_utc(timestamp: Column) -> Column:
    """Six digits of a second and Z; the session's time zone must be UTC."""
    return F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def plain_number(value: Column) -> Column:
    """A finite double in the fewest digits that tell it apart, without an exponent; -0 is 0."""
    text = F.abs(value).cast("string")
    # from a thousandth to ten million the text has no exponent and is plain but for zeros at its end
    short = F.when(text.endswith("0"), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)
    mantissa, exponent = F.substring_index(text, "E", 1), F.substring_index(text, "E", -1).try_cast("int")
    first = F.substring_index(mantissa, ".", 1)
    digits = F.concat(first, F.rtrim(F.substring_index(mantissa, ".", -1), F.lit("0")))
    point = F.length(first) + exponent
    below = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    whole = F.concat(digits, F.repeat(F.lit("0"), point - F.length(digits)))
    mixed = F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, F.length(digits)))
    spread = F.when(point <= 0, below).when(point >= F.length(digits), whole).otherwise(mixed)
    plain = F.when(F.contains(text, F.lit("E")), spread).otherwise(short)
    return F.when(value == 0, "0").when(value < 0, F.concat(F.lit("-"), plain)).otherwise(plain)
