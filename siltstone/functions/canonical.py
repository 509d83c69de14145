"""Values as canonical JSON texts, byte for byte: sorted keys, fixed separators, everything beyond ASCII escaped."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.binding import let

#: What has a short escape of its own.
ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def quoted(value: Column) -> Column:
    """A string in quotes. Characters outside of the blank to the tilde are escaped, those beyond 16 bits as two halves."""
    short = F.create_map(*[F.lit(x) for p in ESCAPES.items() for x in p])

    def one(c):
        units = F.lower(F.hex(F.encode(c, "UTF-16BE")))
        long = F.concat(F.lit("\\u"), F.substring(units, 1, 4), F.when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 5, 4))).otherwise(""))
        return F.when(c.rlike(r"^[ !#-\[\]-~]$"), c).otherwise(F.coalesce(short[c], long))

    plain = value.rlike(r"^[ !#-\[\]-~]*\z")
    return F.concat(F.lit('"'), F.when(plain, value).otherwise(F.array_join(F.transform(F.split(value, ""), one), "")), F.lit('"'))


def number(value: Column) -> Column:
    """A double with its shortest digits: plain from 1e-4 to below 1e16, else with an exponent of two digits at least."""
    def text(v):
        said = F.abs(v).cast("string")
        mantissa, power = F.regexp_extract(said, r"^([0-9.]+)", 1), F.coalesce(F.regexp_extract(said, r"E(-?\d+)$", 1).try_cast("int"), F.lit(0))
        known = F.struct(F.substring_index(mantissa, ".", 1).alias("whole"), F.concat(F.substring_index(mantissa, ".", 1), F.regexp_replace(F.substring_index(mantissa, ".", -1), "0+$", "")).alias("all"), power.alias("power"))
        sign = F.when(v.cast("string").startswith("-"), "-").otherwise("")
        return F.when(F.isnan(v), "NaN").when(said == "Infinity", F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, let(let(known, _point), lambda p: F.when(v == 0, "0.0").otherwise(_laid_out(p)))))

    return F.when(value.isNotNull(), let(value, text))


def _point(k: Column) -> Column:
    """(digits, point): the number is 0.digits times ten to the power of ``point``."""
    digits = F.regexp_replace(k["all"], "^0+", "")
    return F.struct(F.regexp_replace(digits, "0+$", "").alias("digits"), (F.length(k["whole"]) + k["power"] - (F.length(k["all"]) - F.length(digits))).alias("point"))


def _laid_out(p: Column) -> Column:
    digits, point = p["digits"], p["point"]
    n, exponent = F.length(digits), point - 1
    power = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.when(F.abs(exponent) < 10, "0").otherwise(""), F.abs(exponent).cast("string"))
    scientific = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise(""), F.lit("e"), power)
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    large = F.concat(digits, F.repeat(F.lit("0"), point - n), F.lit(".0"))
    mixed = F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1))
    return F.when((exponent < -4) | (exponent >= 16), scientific).when(point <= 0, small).when(point >= n, large).otherwise(mixed)


def json_text(value: Column, kind: T.DataType) -> Column:
    """The JSON text of a value of the type ``kind``; a null is ``null``. Keys of structs and maps (of strings) are sorted."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(quoted(F.lit(f.name)), F.lit(": "), json_text(value.getField(f.name), f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        made = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.map_entries(value))
        made = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(quoted(e["key"]), F.lit(": "), json_text(e["value"], kind.valueType))), ", "), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        made = F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        made = number(value.cast("double"))
    elif isinstance(kind, (T.StringType, T.TimestampType, T.DateType)):
        made = quoted(value.cast("string"))
    else:  # integers and booleans
        made = value.cast("string")
    return F.when(value.isNull(), "null").otherwise(made)
