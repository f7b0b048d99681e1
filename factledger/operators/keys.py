"""Which fields make an item, and which of them a flag speaks for, for every kind."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The fields that tell items of a kind apart; other kinds are told apart by all fields.
KEY_FIELDS = {
    "document": ["country", "number", "type"],
    "phone": ["extension", "number"],
    "email": ["email"],
    "username": ["platform", "username"],
    "relationship": ["from", "target_document", "target_id", "type", "until"],
    "activity": ["code", "role"],
    "custom": ["field_id", "value"],
}
# The fields a flag is bound to; flags of other kinds are bound to all fields.
BOUND_FIELDS = {"phone": ["extension", "number"], "email": ["email"], "username": ["platform", "username"]}
#: A record has one identity.
IDENTITY = "identity"


def _spelled(values: Column, names: Column) -> Column:
    """Compact JSON of the named members; a member that is not there is null."""

    def member(name: Column) -> Column:
        quoted = F.to_json(F.array(name))  # in brackets
        inner = F.substring(quoted, F.lit(2), F.length(quoted) - 2)
        return F.concat(inner, F.lit(":"), F.coalesce(F.try_element_at(values, name), F.lit("null")))

    return F.concat(F.lit("{"), F.array_join(F.transform(names, member), ","), F.lit("}"))


def _names(kind: Column, listed: dict[str, list[str]], values: Column) -> Column:
    names = F.array_sort(F.map_keys(values))
    for known, fields in listed.items():
        names = F.when(kind == known, F.array(*[F.lit(f) for f in sorted(fields)])).otherwise(names)
    return names


def item_key(kind: Column, values: Column) -> Column:
    """The key of an item; ``values`` maps its fields to their JSON texts."""
    key = F.sha2(_spelled(values, _names(kind, KEY_FIELDS, values)), 256)
    return F.when(kind == IDENTITY, IDENTITY).otherwise(key)


def flag_binding(kind: Column, flag: Column, values: Column) -> Column:
    """The digest of what a flag was given for; only the number of a phone for its messenger flag."""
    names = _names(kind, BOUND_FIELDS, values)
    names = F.when((kind == "phone") & (flag == "is_whatsapp"), F.array(F.lit("number"))).otherwise(names)
    return F.sha2(_spelled(values, names), 256)
