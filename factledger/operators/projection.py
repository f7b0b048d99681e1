"""The searchable projection of current state, with explicit omissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factledger.functions.temporal import parse_date
from factledger.functions.text import fold
from factledger.functions.values import MAX_TEXT_BYTES, fingerprint, typed_scalar
from factledger.operators.search import resolved

# The fields of each item kind that may be searched.
SEARCHABLE = {
    "custom": {"value"},
    "identity": {"name", "legal_name", "trade_name", "birth_date", "death_date", "sex", "nationality", "opening_date"},
    "document": {"number", "type", "country", "issuer", "state", "syntax_valid"},
    "phone": {"number", "type", "phone_type", "usage", "extension", "country", "national_number", "area_code", "syntax_valid"},
    "email": {"email", "domain", "syntax_valid"},
    "address": {
        "country", "state", "city", "city_code", "neighborhood", "street", "street_type", "street_title", "number", "complement",
        "postal_code", "usage", "classification",
    },
    "username": {"platform", "username", "url", "external_id"},
    "relationship": {
        "target_id", "target_name", "target_document.number", "target_document.type", "target_document.country", "type", "role",
        "from", "until", "direction", "participation",
    },
    "activity": {"code", "description", "role", "area", "primary"},
}

# Flags that may be searched, fields that hold days, reasons to leave something out.
FLAGS = ("valid", "is_whatsapp", "ownership_confirmed", "deliverable", "residence_confirmed")
DATE_FIELDS = ("birth_date", "death_date", "opening_date", "from", "until")
OMISSIONS = (
    "unknown_items",
    "unknown_fields",
    "unsupported_values",
    "unsafe_text",
    "long_text",
    "unknown_flags",
    "metadata",
    "unbound_custom_fields",
)


def searchable_table(spark: SparkSession) -> DataFrame:
    """Whitelist ``kind, path`` as a table (under a hundred rows)."""
    rows = [(kind, path) for kind, paths in SEARCHABLE.items() for path in sorted(paths)]
    return spark.createDataFrame(rows, "kind string, path string")


def custom_key(definition: str) -> Column:
    """The digest that binds a custom value to one immutable definition."""
    names = ("field_id", "version", "sha256", "type", "contract", "deployment_id")
    return fingerprint(**{name: F.col(f"{definition}.{name}") for name in names})


def flag_columns(flags: DataFrame, item: list[str]) -> DataFrame:
    """``(*item, path, <flag>...)``: the known flags of every field as one column each."""
    state = F.struct("value", "applicable", "expires")
    named = [F.max(F.when(F.col("name") == name, state)).alias(name) for name in FLAGS]
    return flags.filter(F.col("name").isin(*FLAGS)).groupBy(*item, "path").agg(*named)


def _flag_state(flag: Column, speaks: Column) -> Column:
    """``true``, ``false`` or ``unknown``: a flag speaks only for a resolved value it applies to."""
    value = F.when(speaks & F.coalesce(flag["applicable"], F.lit(False)), flag["value"])
    state = F.when(value.isNull(), "unknown").when(value, "true").otherwise("false")
    return F.struct(value.alias("value"), state.alias("state"), flag["expires"].alias("expires"))


def project_fields(fields: DataFrame, whitelist: DataFrame, flags: DataFrame, item: list[str]) -> DataFrame:
    """Typed search columns per field and the reason a field is left out.

    ``fields`` has ``*item, kind, path, value, json_type, status, derived,
    source, metadata, definition``; ``flags`` has ``*item, path, name, value,
    applicable, expires``, one row per flag. Omitted fields stay in the result
    with ``omitted`` set, so nothing disappears. A derived field carries no flag
    of its own, but ``parent_valid`` of the field it comes from. Dates and
    flags of an unresolved field say nothing; neither do those of a field whose
    day does not exist.
    """
    kinds = F.broadcast(whitelist.select("kind").distinct().withColumn("_kind_known", F.lit(True)))
    paths = F.broadcast(whitelist.withColumn("_path_known", F.lit(True)))
    joined = fields.join(kinds, "kind", "left").join(paths, ["kind", "path"], "left")
    joined = joined.join(flag_columns(flags, item), [*item, "path"], "left")
    custom = F.col("kind") == "custom"
    joined = joined.withColumn("_scalar", typed_scalar(F.col("value"), F.col("json_type")))
    # folded once, when the projection is written
    joined = joined.withColumn("_folded", fold(F.col("_scalar.value_exact")))
    reason = (
        F.when(F.col("_kind_known").isNull(), "unknown_items")
        .when(F.col("_path_known").isNull(), "unknown_fields")
        .when(custom & F.col("definition").isNull(), "unbound_custom_fields")
        .when(custom & (F.col("definition.type") == "reference"), "unsupported_values")
        .when(F.col("_scalar.omitted").isNull() & (F.octet_length("_folded") > MAX_TEXT_BYTES), "long_text")
        .otherwise(F.col("_scalar.omitted"))
    )
    joined = joined.withColumn("omitted", reason)
    indexed = F.col("omitted").isNull()
    dated = indexed & (F.col("json_type") == "text") & F.when(custom, F.col("definition.type") == "date").otherwise(
        F.col("path").isin(*DATE_FIELDS)
    )
    day = parse_date(F.col("value"))
    speaks = indexed & resolved(F.col("status")) & ~(F.coalesce(dated, F.lit(False)) & day.isNull())
    joined = joined.withColumn("resolved", speaks)
    own = F.col("resolved") & ~F.col("derived")
    columns = {
        **{name: F.when(indexed, F.col(f"_scalar.{name}")) for name in ("value_type", "value_exact", "value_boolean", "number_exact")},
        "value_folded": F.when(indexed, F.col("_folded")),
        "value_date": F.when(F.col("resolved") & dated, day),
        "source_key": fingerprint(source=F.col("source")),
        "custom_key": F.when(custom & indexed, custom_key("definition")),
        "metadata": F.when(F.octet_length("metadata") <= MAX_TEXT_BYTES, F.col("metadata")),
        "metadata_omitted": indexed & F.coalesce(F.octet_length("metadata") > MAX_TEXT_BYTES, F.lit(False)),
        "parent_valid": _flag_state(F.col("valid"), F.col("resolved") & F.col("derived")),
        **{f"flag_{name}": _flag_state(F.col(name), own) for name in FLAGS},
    }
    projected = joined.withColumns(columns)
    confirmed = F.col("resolved") & (F.col("flag_valid.state") == "true")
    return projected.withColumn("confirmation_recorded", confirmed).drop("_scalar", "_folded", "_kind_known", "_path_known", *FLAGS)


def omissions(projected: DataFrame, flags: DataFrame, owner: str) -> DataFrame:
    """What is kept and what is left out per record, by reason; every record of either table."""
    counted = projected.groupBy(owner).agg(
        F.count_if(F.col("omitted").isNull()).alias("indexed"),
        *[F.count_if(F.col("omitted") == reason).alias(reason) for reason in OMISSIONS if reason not in ("unknown_flags", "metadata")],
        F.count_if("metadata_omitted").alias("metadata"),
    )
    unknown = flags.groupBy(owner).agg(F.count_if(~F.col("name").isin(*FLAGS)).alias("unknown_flags"))
    joined = counted.join(unknown, owner, "full_outer")
    return joined.select(owner, *[F.coalesce(name, F.lit(0)).alias(name) for name in ("indexed", *OMISSIONS)])
