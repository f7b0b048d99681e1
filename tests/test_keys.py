"""Item keys, flag bindings and dates with their time of day against plain rules."""

import hashlib
import json
from datetime import datetime, timedelta, timezone
from decimal import Decimal

from pyspark.sql import functions as F

from factledger.functions import contact, temporal
from factledger.operators import keys

VALUES = {"number": "1", "extension": None, "email": "é\"x", "platform": "p", "username": "u", "code": 12, "value": [1, {"a": None}], 'a"b\\': True, "type": "T"}


def digest(names, values):
    spelled = ",".join(f"{json.dumps(n, ensure_ascii=False)}:{json.dumps(values.get(n), ensure_ascii=False, separators=(',', ':'))}" for n in sorted(names))
    return hashlib.sha256(f"{{{spelled}}}".encode()).hexdigest()


def test_keys_and_bindings_of_every_kind(spark):
    kinds = [*keys.KEY_FIELDS, "identity", "address", "gadget"]
    raw = {k: json.dumps(v, ensure_ascii=False, separators=(",", ":")) for k, v in VALUES.items()}
    rows = spark.createDataFrame([(kind, flag, raw) for kind in kinds for flag in ("valid", "is_whatsapp")], "kind string, flag string, f map<string, string>")
    found = rows.select(
        "kind", "flag", keys.item_key(F.col("kind"), F.col("f")).alias("k"), keys.flag_binding(F.col("kind"), F.col("flag"), F.col("f")).alias("b")
    )
    for r in found.collect():
        want = "identity" if r["kind"] == "identity" else digest(keys.KEY_FIELDS.get(r["kind"], VALUES), VALUES)
        assert r["k"] == want, r["kind"]
        bound = ["number"] if (r["kind"], r["flag"]) == ("phone", "is_whatsapp") else keys.BOUND_FIELDS.get(r["kind"], VALUES)
        assert r["b"] == digest(bound, VALUES), r["kind"]


def test_times_of_day_are_kept(spark):
    texts = ["2024-02-29", "2024-02-30", " 2024-02-29T23:59:59Z ", "2024-02-29 23:59:59.000001-00:00", "0001-01-01T00:00:00", "2024-02-29T24:00:00", "2024-02-29T10:00", "x", "2024-02-29T10:00:00.1234567Z"]
    numbers = [("integer", "0"), ("integer", "1709251199999"), ("decimal", "1709251199999.0"), ("decimal", "1.709251199e12"), ("decimal", "0.5"), ("integer", "-1")]
    rows = [(t, "text") for t in texts] + [(v, k) for k, v in numbers] + [(None, "null"), ("true", "boolean")]
    ruled = spark.createDataFrame(rows, "raw string, kind string").withColumn("r", temporal.datetime_by_rule(F.col("raw"), F.col("kind"), F.lit(True)))
    got = {(r["raw"], r["kind"]): (r["r"]["moment"], r["r"]["reason"]) for r in ruled.collect()}
    for raw, kind in rows:
        moment, reason = got[raw, kind]
        if kind in ("integer", "decimal") and Decimal(raw) == int(Decimal(raw)):
            at = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(Decimal(raw)))
            assert (moment, reason) == (at.isoformat(), None)
        elif kind == "text" and reason is None:
            text = raw.strip()
            assert moment == (text if len(text) == 10 else datetime.fromisoformat(text.replace("Z", "+00:00")).isoformat())
        else:
            assert moment is None
    reasons = [got[t, "text"][1] for t in texts]
    assert reasons == [None, "invalid_date", None, None, None, "invalid_date", "ambiguous_date_format", "ambiguous_date_format", "ambiguous_date_format"]
    assert got[None, "null"][1] == "missing_value" and got["true", "boolean"][1] == "unrecognized_date_type" == got["0.5", "decimal"][1]


def test_unknown_countries_of_phones(spark):
    regions = contact.phone_regions(spark)
    assert len(regions) == 245 and {"BR", "US", "XK", "TA", "AC"} <= set(regions) and not {"AQ", "XX"} & set(regions)
    rows = [("11 3333-4444", c, a, None) for c, a in (("XX", None), ("XX", "00"), (" us ", None), ("br", None), (None, None), ("", "11"))]
    phones = spark.createDataFrame(rows, "raw string, country string, area string, extension string")
    found = contact.normalize_phones(phones, contact.rollout_table(spark), regions).select("country", "area", "reason").collect()
    assert {(r["country"], r["area"]): r["reason"] for r in found} == {
        ("XX", None): "unknown_country", ("XX", "00"): "unknown_country", (" us ", None): "country_not_covered", ("br", None): None, (None, None): None, ("", "11"): None,
    }
