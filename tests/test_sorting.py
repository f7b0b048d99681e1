"""The sort key against sorting in Python, plans and pages."""

import datetime
import random
import unicodedata

import pytest

from factledger.operators import search, sorting

RECORDS = "id string, updated_at string, name string"
ITEMS = "id string, kind string, field string, value string, json_type string, valid boolean"


def reference_value(value, json_type, kind):
    if value is None or json_type != "text":
        return None
    if kind == "date":
        try:
            return datetime.date.fromisoformat(value) if len(value) == 10 and value[4] == value[7] == "-" else None
        except ValueError:
            return None
    if kind == "instant":
        try:
            at = datetime.datetime.fromisoformat(value)
        except ValueError:
            return None
        return at if at.tzinfo else None
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).casefold())


def by_passes(records, items, plan, include_invalid):
    """Stable passes from the last criterion on, missing values behind in each."""
    order = sorted(records)
    for c in reversed(plan):
        item, kind = sorting.FIELDS[c.field]
        keys = {}
        for record in records:
            if item is None:
                keys[record] = reference_value(record if c.field == "id" else records[record], "text", kind)
                continue
            found = [
                reference_value(v, j, kind)
                for i, k, f, v, j, valid in items
                if i == record and k == item and f == c.field and (include_invalid or valid is not False)
            ]
            found = [v for v in found if v is not None]
            keys[record] = (min if c.mode == "min" else max)(found) if found else None
        present = sorted((r for r in order if keys[r] is not None), key=lambda r: keys[r], reverse=c.direction == "desc")
        order = present + [r for r in order if keys[r] is None]
    return order


TEXTS = ["", "a", "A", "a\x00", "a\x00b", "a\x01", "ab", "\u00c9lan", "E\u0301lan", "elan", "stra\u00dfe", "STRASSE", "z", "\U0001f600", "\uffee"]
DATES = ["1999-02-30", "1999-02-28", "0001-01-01", "9999-12-31", "1969-12-31", "19990228", "1999-2-8", "", "2000-02-29"]
INSTANTS = ["2024-01-01T00:00:00Z", "2024-01-01T03:00:00+03:00", "2024-01-01T00:00:00", "1960-05-05T00:00:00Z", "x", None]

PLANS = [
    [{"field": "name", "direction": "asc"}],
    [{"field": "name", "direction": "desc"}, {"field": "id", "direction": "desc"}],
    [{"field": "birth_date", "direction": "desc"}, {"field": "name", "direction": "asc", "mode": "max"}],
    [{"field": "updated_at", "direction": "desc"}, {"field": "city", "direction": "asc"}, {"field": "birth_date", "direction": "asc"}],
    [{"field": f, "direction": d} for f, d in (("city", "desc"), ("name", "asc"), ("birth_date", "desc"), ("updated_at", "asc"), ("id", "desc"))],
]


@pytest.fixture(scope="module")
def people():
    rng = random.Random(4)
    records = {f"r{k:02}": rng.choice(INSTANTS) for k in range(60)}
    items = []
    for record in records:
        for _ in range(rng.randrange(6)):
            kind, field, value = rng.choice([("identity", "name", TEXTS), ("identity", "birth_date", DATES), ("address", "city", TEXTS), ("phone", "name", TEXTS)])
            items.append((record, kind, field, rng.choice(value), rng.choice(["text", "text", "text", "integer"]), rng.choice([True, False, None])))
    return records, items


@pytest.mark.parametrize("include_invalid", [False, True])
@pytest.mark.parametrize("wish", PLANS)
def test_key_order_equals_stable_passes(spark, people, wish, include_invalid):
    records, items = people
    plan = sorting.sort_plan(wish)
    frame = spark.createDataFrame([(r, at, None) for r, at in records.items()], RECORDS)
    keyed = sorting.with_sort_key(frame, plan, spark.createDataFrame(items, ITEMS), include_invalid=include_invalid)
    assert keyed.columns == [*frame.columns, "sort_key"]
    rows = keyed.orderBy("sort_key").collect()
    assert [r["id"] for r in rows] == by_passes(records, items, plan, include_invalid)
    pages, after = [], None
    while True:  # the same order page by page over the one key
        page = search.keyset_page(keyed, ["sort_key"], after, 17).orderBy("position").collect()
        pages += [r["id"] for r in page]
        if not page[0]["has_more"]:
            break
        after = (page[-1]["sort_key"],)
    assert pages == [r["id"] for r in rows]


def test_whole_numbers_keep_their_order(spark):
    numbers = [-(2**63), -(2**62), -256, -1, 0, 1, 255, 256, 2**62, 2**63 - 1]
    plan = sorting.sort_plan([{"field": "id", "direction": "desc"}], {"id": (None, "integer")})
    frame = sorting.with_sort_key(spark.createDataFrame([(n,) for n in numbers], "id long"), plan, fields={"id": (None, "integer")})
    assert [r["id"] for r in frame.orderBy("sort_key").collect()] == numbers[::-1]


@pytest.mark.parametrize(
    "wish",
    [
        [],
        [{"field": "name", "direction": "asc"}] * 2,
        [{"field": "id", "direction": "asc"}, {"field": "name", "direction": "asc"}],
        [{"field": "nickname", "direction": "asc"}],
        [{"field": "name", "direction": "up"}],
        [{"field": "name"}],
        [{"field": "name", "direction": "asc", "mode": "mean"}],
        [{"field": "updated_at", "direction": "asc", "mode": "min"}],
        [{"field": "name", "direction": "asc", "nulls": "first"}],
        [{"field": f, "direction": "asc"} for f in ("name", "updated_at", "birth_date", "city", "state", "postal_code")],
    ],
)
def test_plans_that_are_refused(wish):
    with pytest.raises(ValueError):
        sorting.sort_plan(wish)


def test_plan_defaults():
    plan = sorting.sort_plan([{"field": "name", "direction": "desc"}, {"field": "updated_at", "direction": "asc"}])
    assert [(c.field, c.direction, c.mode) for c in plan] == [("name", "desc", "max"), ("updated_at", "asc", None), ("id", "asc", None)]
