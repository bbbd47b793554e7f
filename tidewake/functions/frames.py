"""Reading raw position frames, typed or as VARIANT: key presence, JSON kinds and the validation rules."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewake.functions.times import as_column, cleaned_time, parse_clean_time

# ---- Fixed values -------------------------------------------------------------------------
POSITION_REPORT = "PositionReport"
KNOWN_MESSAGE_TYPES = ["PositionReport", "SubscriptionConfirmation", "ShipStaticData", "VoyageData"]
TOP_LEVEL_KEYS = ["MessageType", "MetaData", "Message"]
METADATA_KEYS = ["MMSI", "time_utc"]
POSITION_KEYS = ["Latitude", "Longitude", "Sog", "Cog"]
MISSING_TOP = "missing top-level key: "
MISSING_META = "missing MetaData key: "
MISSING_POSITION = "missing PositionReport key: "
NO_META = "MetaData is not an object"
NO_POSITION = "Message.PositionReport is not an object"
NO_OBJECT = "payload is not a JSON object"
BAD_TIME = "unparseable time_utc"
BAD_VALUE = "invalid "
BAD_TYPE = "unsupported MessageType: "
# -------------------------------------------------------------------------------------------


def frame_variant(value="value") -> Column:
    """The frame as VARIANT; NULL when the text is not JSON."""
    return F.try_parse_json(as_column(value))


def field(frame: Column, path: str) -> Column:
    """A nested value as VARIANT: SQL NULL when absent, variant null when JSON null."""
    return F.try_variant_get(frame, path, "variant")


def kind(value: Column) -> Column:
    """OBJECT<..>, ARRAY<..>, STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID; NULL when absent."""
    return F.schema_of_variant(value)


def as_double(value: Column) -> Column:
    return F.try_variant_get(value, "$", "double")


def as_text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def as_string_only(value: Column) -> Column:
    """The text of a JSON string, NULL for every other kind."""
    return F.when(kind(value) == "STRING", as_text(value))


def truth(value: Column) -> Column:
    """Truthiness of a flag: NULL when absent or null."""
    number = F.try_variant_get(value, "$", "double")
    return (F.when(value.isNull() | F.is_variant_null(value), F.lit(None).cast("boolean"))
            .when(kind(value) == "STRING", F.length(as_text(value)) > 0)
            .otherwise(F.coalesce(number != 0, F.lit(True))))


def _shown(value: Column, text: Column) -> Column:
    """A value the way the error messages print it."""
    return (F.when(value.isNull() | F.is_variant_null(value), F.lit("None"))
            .when(kind(value) == "STRING", F.concat(F.lit("'"), as_text(value), F.lit("'")))
            .when(kind(value) == "BOOLEAN", F.initcap(as_text(value)))
            .otherwise(F.coalesce(text, F.to_json(value))))


def evaluated_once(df: DataFrame) -> DataFrame:
    """The same rows behind a one-element generator.

    A filter on a computed column is otherwise pushed below the projection that computes it, as a
    copy of the whole expression, and a frame would be decoded once for the filter and once more
    for the result. Filters on generated columns stay above the generator.
    """
    return df.select(F.inline(F.array(F.struct(*df.columns))))


META, POSITION = "$.MetaData", "$.Message.PositionReport"
NUMBER_LIMITS = {"Latitude": (-90.0, 90.0), "Longitude": (-180.0, 180.0), "Sog": (0.0, None)}


# What a typed read of a position report asks for; flags as text, since the feed sends numbers as well as booleans.
_NUMBERS = POSITION_KEYS + ["TrueHeading", "RateOfTurn"]
TYPED = ("MessageType string, MetaData struct<MMSI: string, ShipName: string, time_utc: string>, "
         "Message struct<PositionReport: struct<NavigationalStatus: int, PositionAccuracy: string, Raim: string, "
         + ", ".join(f"{k}: double" for k in _NUMBERS) + ">>")
STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
# Text that a typed read also gives for JSON values that are no strings.
_NO_STRING = r"^\s*(-?[0-9]|\[|\{|true\s*$|false\s*$)"
_QUOTED_FLAG = r'"(PositionAccuracy|Raim)"\s*:\s*"'


def _plain(report: Column, meta: Column) -> Column:
    """A valid position report whose typed fields are certain: no required value is null and no kind is in doubt."""
    def finite(key: str) -> Column:
        return F.abs(report[key]) < float("inf")

    def flag(key: str) -> Column:
        return F.coalesce(report[key].isin("true", "false", "0", "1"), F.lit(True))

    limits = [report[k] >= low if high is None else report[k].between(low, high) for k, (low, high) in NUMBER_LIMITS.items()]
    certain = [F.col("_typed.MessageType") == POSITION_REPORT, meta["MMSI"].rlike("^[0-9]{1,18}$"), F.col("_typed_ts").isNotNull(),
               *limits, *[finite(k) for k in ("Sog", "Cog", "TrueHeading", "RateOfTurn")], report["NavigationalStatus"].isNotNull(),
               meta["ShipName"].isNull() | ~meta["ShipName"].rlike(_NO_STRING), flag("PositionAccuracy"), flag("Raim"),
               ~F.col("value").rlike(_QUOTED_FLAG)]
    return F.coalesce(reduce(and_, certain), F.lit(False))


def with_fields(frames: DataFrame) -> DataFrame:
    """Adds the parsed frame's fields as plain scalars.

    Two tiers: a typed read gives the fields of plain position reports, nearly all frames. Only where a required value is
    missing, out of its limits or of a doubtful kind, the text is parsed as VARIANT (``frame``, else NULL unless it was there
    already), and all fields come from that. Only scalars travel on: a VARIANT leaf would carry the key dictionary of
    the whole frame. ``_has_K`` tells presence, which a typed read cannot; ``_plain_K`` tells that a number is not
    a quoted one.
    """
    typed, report, meta = F.col("_typed"), F.col("_typed.Message.PositionReport"), F.col("_typed.MetaData")
    staged = (frames.withColumn("_typed", F.from_json("value", TYPED, STRICT))
              .withColumn("_typed_text", cleaned_time(meta["time_utc"])).withColumn("_typed_ts", parse_clean_time("_typed_text"))
              .withColumn("_certain", _plain(report, meta)))
    if "frame" not in frames.columns:
        staged = staged.withColumn("frame", F.when(~F.col("_certain"), frame_variant("value")))
    f = F.col("frame")
    # Each object is walked once; a path per value would walk the frame again for every key.
    objects = {META: "_meta_keys", POSITION: "_position_keys"}
    staged = staged.withColumns({"_kind_of": F.when(~F.col("_certain"), field(f, "$.MessageType")), **{
        c: F.when(~F.col("_certain"), F.try_variant_get(f, path, "map<string,variant>")) for path, c in objects.items()}})

    def at(parent: str, key: str) -> Column:
        return F.try_element_at(F.col(objects[parent]), F.lit(key))

    def there(key: str, parent: str) -> Column:
        return F.when(F.col(objects[parent]).isNotNull(), F.lit(True)).otherwise(field(f, f"$.{key}").isNotNull())

    def double(key: str) -> Column:
        return as_double(at(POSITION, key))

    def text(parent: str, key: str) -> Column:
        return as_text(at(parent, key))

    def flag(key: str) -> Column:
        return report[key].isin("true", "1")

    yes = F.lit(True)
    kind_of_type = kind(F.col("_kind_of"))
    scalars = {  # name: (of a plain report, of any other frame)
        "message_type": (typed["MessageType"], F.when(kind_of_type == "STRING", as_text(F.col("_kind_of")))),
        "_is_frame": (yes, kind_of_type.isNotNull()),
        "_mmsi": (meta["MMSI"], text(META, "MMSI")),
        "_name": (meta["ShipName"], as_string_only(at(META, "ShipName"))),
        "_time": (meta["time_utc"], text(META, "time_utc")),
        "_time_null": (F.lit(False), F.is_variant_null(at(META, "time_utc"))),
        **{f"_{k}": (report[k], double(k)) for k in _NUMBERS},
        "_nav": (report["NavigationalStatus"], F.try_variant_get(at(POSITION, "NavigationalStatus"), "$", "int")),
        "_accuracy": (flag("PositionAccuracy"), truth(at(POSITION, "PositionAccuracy"))),
        "_raim": (flag("Raim"), truth(at(POSITION, "Raim"))),
        "_has_MessageType": (yes, F.col("_kind_of").isNotNull()),
        "_has_MetaData": (yes, there("MetaData", META)),
        "_has_Message": (yes, there("Message", POSITION)),
        **{f"_has_{k}": (yes, at(META, k).isNotNull()) for k in METADATA_KEYS},
        **{f"_has_{k}": (yes, at(POSITION, k).isNotNull()) for k in POSITION_KEYS},
        **{f"_plain_{k}": (yes, F.coalesce(kind(at(POSITION, k)) != "STRING", F.lit(False))) for k in NUMBER_LIMITS},
    }
    fields = F.when(F.col("_certain"), F.struct(*[fast.alias(n) for n, (fast, _) in scalars.items()])).otherwise(
        F.struct(*[slow.alias(n) for n, (_, slow) in scalars.items()]))
    out = staged.withColumn("_fields", fields).select(
        *frames.columns, *[c for c in ("frame",) if c not in frames.columns], "_certain", "_typed_text", "_typed_ts",
        *[F.col(f"_fields.{n}").alias(n) for n in scalars])
    out = out.withColumn("_time_text", F.when(F.col("_certain"), F.col("_typed_text")).otherwise(cleaned_time("_time")))
    return out.withColumn("_event_ts", F.when(F.col("_certain"), F.col("_typed_ts")).otherwise(
        parse_clean_time("_time_text"))).drop("_typed_text", "_typed_ts", "_certain")


def whole_frame() -> Column:
    """The frame as VARIANT over the columns of ``with_fields``."""
    return F.coalesce(F.col("frame"), frame_variant("value"))


def _object(parent: str, keys: list[str]) -> Column:
    """Is the frame's ``parent`` a JSON object? A key found in it proves it; only else it is asked."""
    found = reduce(or_, [F.col(f"_has_{k}") for k in keys])
    return F.when(found, F.lit(True)).otherwise(
        F.coalesce(kind(field(F.col("frame"), parent)).startswith("OBJECT"), F.lit(False)))


def _rules() -> list[tuple[Column, Column]]:
    """(broken, message) of every rule for a position report, over the columns of ``with_fields``."""
    meta, position = F.col("_meta_ok"), F.col("_position_ok")

    def shown(label: str, path: str) -> Column:
        return F.concat(F.lit(label + ": "),
                        _shown(field(F.col("frame"), path), F.get_json_object("value", path)))

    def missing(key: str) -> Column:
        return ~F.col(f"_has_{key}")

    rules = [(missing(k), F.lit(MISSING_TOP + k)) for k in TOP_LEVEL_KEYS]
    rules.append((~meta, F.lit(NO_META)))
    rules += [(meta & missing(k), F.lit(MISSING_META + k)) for k in METADATA_KEYS]
    rules.append((F.col("_has_time_utc") & ~F.col("_time_null") & F.col("_event_ts").isNull(),
                  shown(BAD_TIME, f"{META}.time_utc")))
    rules.append((~position, F.lit(NO_POSITION)))
    rules += [(position & missing(k), F.lit(MISSING_POSITION + k))
              for k in POSITION_KEYS]
    for key, (low, high) in NUMBER_LIMITS.items():
        number = F.col(f"_{key}")
        inside = number >= low if high is None else number.between(low, high)
        fine = F.col(f"_plain_{key}") & F.coalesce(inside, F.lit(False))
        rules.append((position & ~fine, shown(BAD_VALUE + key, f"{POSITION}.{key}")))
    return rules


def with_errors(fields: DataFrame) -> DataFrame:
    """Adds ``_errors``: the sorted messages of every rule a frame breaks, empty when valid.

    The messages are only put together for frames that break a rule.
    """
    fields = fields.withColumns({
        "_meta_ok": _object(META, METADATA_KEYS),
        "_position_ok": _object(POSITION, POSITION_KEYS)})
    rules = _rules()
    flags = {f"_rule{i}": broken for i, (broken, _) in enumerate(rules)}
    any_broken = reduce(or_, [F.col(c) for c in flags])
    told = F.sort_array(F.array_compact(F.array(
        *[F.when(F.col(c), message) for c, (_, message) in zip(flags, rules)])))
    none = F.array().cast("array<string>")
    known = F.coalesce(F.col("message_type").isin(KNOWN_MESSAGE_TYPES), F.lit(False))
    unsupported = F.concat(F.lit(BAD_TYPE), _shown(
        field(F.col("frame"), "$.MessageType"), F.get_json_object("value", "$.MessageType")))
    is_frame = F.col("_is_frame") | F.coalesce(kind(F.col("frame")).startswith("OBJECT"), F.lit(False))
    errors = (F.when(F.col("message_type") == POSITION_REPORT,
                     F.when(any_broken, told).otherwise(none))
              .when(known, none)
              .when(is_frame, F.array(unsupported))
              .otherwise(F.array(F.lit(NO_OBJECT))))
    return evaluated_once(fields.withColumns(flags).withColumn("_errors", errors).drop(*flags))


def stamped_text(value="value", received_at="received_at") -> Column:
    """The frame's text with ``_received_at`` added, unless it already carries one."""
    text = as_column(value)
    stamp = F.concat(F.lit('"_received_at": '), as_column(received_at).cast("string"), F.lit("}"))
    trimmed = F.btrim(text, F.lit(" \t\r\n"))
    tight = F.when(text.endswith("}") & text.startswith("{"), text).otherwise(trimmed)
    body = F.left(tight, F.length(tight) - 1)
    return (F.when(text.contains('"_received_at"'), text)
            .when(text.rlike(r"^\s*\{\s*\}\s*$"), F.concat(F.lit("{"), stamp))
            .otherwise(F.concat(body, F.lit(", "), stamp)))
