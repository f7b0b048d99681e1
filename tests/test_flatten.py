import hashlib
import json

from pyspark.sql import functions as F

from factledger.operators import flatten, mapping
from factledger.sources import jsonl


def flat(spark, *docs):
    return flatten.flatten_json(spark.createDataFrame(list(enumerate(docs)), "record long, doc string"), "record", "doc")


def test_every_shape_is_a_leaf(spark):
    doc = json.dumps({"a/b~c": None, "f": False, "z": 0, "s": "", "o": {}, "l": [], "r": [1, 1, {"x": "ü"}]})
    rows = {r.source_path: (r.json_type, r.value) for r in flatten.leaves(flat(spark, doc)).collect()}
    assert rows == {
        "/a~1b~0c": ("null", None), "/f": ("boolean", "false"), "/z": ("integer", "0"), "/s": ("text", ""),
        "/o": ("empty_object", None), "/l": ("empty_array", None), "/r/0": ("integer", "1"), "/r/1": ("integer", "1"), "/r/2/x": ("text", "ü"),
    }


def test_number_spelling_survives(spark):
    doc = '{"d": 1.23000e+5, "long": 0.12345678901234567890123456789, "neg": -0.00, "big": 123456789012345678901234567890}'
    rows = {r.source_path: (r.json_type, r.value) for r in flatten.leaves(flat(spark, doc)).collect()}
    assert rows["/d"] == ("decimal", "1.23000e+5")
    assert rows["/long"] == ("decimal", "0.12345678901234567890123456789")
    assert rows["/neg"] == ("decimal", "-0.00")
    assert rows["/big"] == ("integer", "123456789012345678901234567890")


def test_numeric_object_keys_stay_in_the_base_field(spark):
    rows = {r.source_path: r.base_field for r in flatten.leaves(flat(spark, '{"7": [{"0": 1}]}')).collect()}
    assert rows == {"/7/0/0": "/7/0"}


def test_unfaithful_records_become_errors(spark):
    docs = ['{"a": 1, "a": 2}', '{"a": {"b": 1, "b": 1}}', '{"a": NaN}', "{", "[]"]
    errors = {r.record: r.json_type for r in flat(spark, *docs).filter("row_kind = 'error'").collect()}
    assert errors == {0: "json_duplicate_keys", 1: "json_duplicate_keys", 2: "json_non_finite", 3: "json_invalid"}


def test_containers_and_limits(spark):
    doc = '{"a": [[], {}]}'
    boxes = {(r.source_path, r.json_type, r.size, r.depth) for r in flatten.containers(flat(spark, doc)).collect()}
    assert boxes == {("", "object", 1, 0), ("/a", "array", 2, 1), ("/a/0", "array", 0, 2), ("/a/1", "object", 0, 2)}
    deep = "[" * 70 + "]" * 70
    wide = json.dumps(list(range(20_001)))
    records = spark.createDataFrame([(0, doc), (1, deep), (2, wide)], "record long, doc string")
    limits = flatten.record_limits(records, flatten.flatten_json(records, "record", "doc"), "record", "doc")
    assert {r.record: r.refused for r in limits.collect()} == {0: None, 1: "depth", 2: "leaves"}


def test_strict_errors(spark):
    cases = {
        '{"k": 1}': None, '{"k": 1, "k": 2}': "json_duplicate_keys", '{"a": [{"k": 1, "k": 1}]}': "json_duplicate_keys",
        '{"k": 0.1}': None, '{"k": 1.2300e+2}': None, '{"k": 0.1234567890123456789}': "json_number_precision",
        '{"k": 1e400}': "json_number_precision", '{"k": "0.1234567890123456789 NaN"}': None, '{"k": Infinity}': "json_non_finite",
        '{"k": 12345678901234567890123}': None, '{"k": ': "json_invalid", '{"e": "a\\"0.1234567890123456789"}': None,
    }
    df = spark.createDataFrame([(raw,) for raw in cases], "raw string")
    assert {r.raw: r.e for r in df.select("raw", jsonl.strict_error(F.col("raw")).alias("e")).collect()} == cases


def test_coverage_detects_every_kind_of_loss(spark):
    columns = "record long, source_path string, json_type string, value string"
    expected = spark.createDataFrame([(1, "/a", "text", "x"), (1, "/b", "null", None), (2, "/a", "text", "x")], columns)
    same = mapping.coverage(expected, expected, "record").collect()
    assert all(r.passed for r in same)
    bad = spark.createDataFrame(
        [(1, "/a", "integer", "x"), (1, "/a", "integer", "x"), (1, "/c", "null", None), (2, "/a", "text", "x")], columns
    )
    got = {r.record: (r.missing, r.extra, r.changed, r.duplicates, r.passed) for r in mapping.coverage(expected, bad, "record").collect()}
    assert got == {1: (1, 1, 1, 1, False), 2: (0, 0, 0, 0, True)}


def test_identity_eligibility(spark):
    rows = [(1, "a", True), (1, "a", True), (2, "a", True), (2, "b", True), (3, "a", True), (3, "x", False), (4, "x", False)]
    got = {r.record: (r.eligible, r.candidate, r.pending_reason) for r in mapping.identity_eligibility(spark.createDataFrame(rows, "record long, claim string, valid boolean"), "record").collect()}
    assert got == {
        1: (True, "a", None), 2: (False, None, "conflicting_claims"), 3: (False, None, "conflicting_claims"), 4: (False, None, None),
    }


def test_records_that_cannot_be_read_are_kept_apart(spark):
    rows = [(1, '{"a": 1}'), (2, None), (3, '{"a":'), (4, '{"a": 1, "a": 2}'), (5, '{"k\\ud800": "x\\ud800"}'), (6, '{"a": "\\u0000"}')]
    records = spark.createDataFrame(rows, "record long, doc string")
    flat = flatten.flatten_json(records, "record", "doc")
    bad = {r["record"]: r["error"] for r in flatten.quarantine(records, flat, "record").collect()}
    assert bad == {2: "json_missing", 3: "json_invalid", 4: "json_duplicate_keys"}
    refused = {r["record"]: r["refused"] for r in flatten.record_limits(records, flat, "record", "doc").collect()}
    assert refused == bad | {1: None, 5: None, 6: None}
    odd = flatten.leaves(flat).filter("record = 5").first()
    assert (odd["source_path"], odd["json_type"], odd["value"]) == ("/k\\ud800", "unsafe_text", "x\\ud800")
    assert flatten.leaves(flat).filter("record = 6").first()["value"] == "\x00"


def test_digests_are_those_of_the_spelled_value():
    """Plain form: every node spelled by ``json.dumps`` over the digests below it."""

    def plain(value):
        if isinstance(value, dict):
            spelled = "object" + json.dumps(sorted((k, plain(v)) for k, v in value.items()))
        elif isinstance(value, list):
            spelled = "array" + json.dumps([(n, plain(v)) for n, v in enumerate(value)])
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            spelled = "number " + flatten._number_key(repr(value))
        else:
            spelled = json.dumps(value)
        return hashlib.sha256(spelled.encode()).hexdigest()

    values = [None, True, False, 0, 1, -12.5, 1e30, "", "1", "true", 'q"\\é\n', "x" * 200, [], {}, [[], {}, [1, "1"]], {"b": 1, "a": {"é": [True]}, "": None}]
    for value in [*values, values[:13], {str(k): v for k, v in enumerate(values)}]:
        assert flatten.value_digest(json.dumps(value)) == plain(value)


def test_refused_records_are_found_without_dealing_out_texts(spark):
    limits = spark.range(0, 300_000, 1, 2).select(F.col("id").alias("record"), F.when(F.col("id") % 100_000 == 7, "bytes").alias("refused"))
    records = spark.range(0, 300_000, 1, 2).select(F.col("id").alias("record"), F.repeat(F.lit("x"), F.lit(50)).alias("raw"))
    known = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        kept, refused = flatten.set_aside(records, limits, "record")
        for rows, n in ((refused, 3), (kept, 299_997)):
            assert "SortMergeJoin" not in rows._jdf.queryExecution().sparkPlan().toString()
            assert rows.count() == n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", known)


def test_coverage_deals_rows_once_by_record(spark):
    rows = spark.createDataFrame(
        [(1, "/a", "text", "x", "d"), (1, "/a", "text", "x", "d"), (2, "/a", "text", None, None), (None, "/a", "text", "x", "d")],
        "record long, source_path string, json_type string, value string, digest string",
    )
    boxes = spark.createDataFrame([(1, "", "object", 1), (None, "", "object", 1)], "record long, source_path string, json_type string, size long")
    found = mapping.coverage(rows, rows, "record", boxes, boxes)
    plan = found._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert dealt and not any("source_path" in line for line in dealt)
    got = {(r.record, r.missing, r.extra, r.changed, r.duplicates, r.containers_match, r.passed) for r in found.collect()}
    # a record without an id meets nothing, neither its leaves nor its containers
    assert got == {
        (1, 0, 0, 0, 2, True, False), (2, 0, 0, 0, 0, True, True),
        (None, 1, 1, 0, 0, True, False), (None, 0, 0, 0, 0, False, False),
    }


def test_limits_are_taken_without_sorting_the_leaves(spark):
    """A greatest text has no place in a hash aggregate: every leaf was sorted by its record."""
    rows = [(1, "[1]"), (2, None), (2, "{"), (2, "[NaN]"), (3, '{"a": 1, "a": 2}'), (3, "[2]"), (None, "[3]")]
    records = spark.createDataFrame(rows, "record long, doc string")
    limits = flatten.record_limits(records, flatten.flatten_json(records, "record", "doc"), "record", "doc")
    assert "SortAggregate" not in limits._jdf.queryExecution().executedPlan().toString()
    found = {(r["record"], r["leaves"], r["depth"], r["refused"]) for r in limits.collect()}
    assert found == {(1, 1, 1, None), (2, 0, 0, "json_non_finite"), (3, 1, 1, "json_duplicate_keys")}


def test_long_lists_keep_every_position(spark):
    n = flatten.MAX_LEAVES + 3
    doc = json.dumps({"l": list(range(n)), "m": [1, 2.50, "x", None, True, "ü"]})
    found = {r.source_path: (r.json_type, r.value) for r in flatten.leaves(flat(spark, doc)).collect()}
    assert len(found) == n + 6
    assert all(found[f"/l/{i}"] == ("integer", str(i)) for i in range(n))
    assert [found[f"/m/{i}"] for i in range(6)] == [
        ("integer", "1"), ("decimal", "2.5"), ("text", "x"), ("null", None), ("boolean", "true"), ("text", "ü"),
    ]


def test_coverage_deals_out_packed_rows_that_tell_all_texts_apart(spark):
    digests = [None, "", "-", "ab", "AB", "abc", "0abc", "xy", "a" * 64, "a" * 63 + "b", "\x01", "\x00", "\u00ab"]
    cells = [(kind, value) for kind in (None, "", "1:", "text") for value in (None, "", "-", "=", "x", ":x")]
    for column, texts in (("digest", [("t", "x", d) for d in digests]), ("cell", [(*c, "d") for c in cells])):
        rows = spark.createDataFrame(
            [(k, n, *text) for k, text in enumerate(texts) for n in range(len(texts))], "record long, n int, json_type string, value string, digest string"
        ).withColumn("source_path", F.concat(F.lit("/"), F.col("n")))
        # at path n the store has the n-th text: only the record's own one is right
        stored = spark.createDataFrame(
            [(k, f"/{n}", *text) for n, text in enumerate(texts) for k in range(len(texts))], "record long, source_path string, json_type string, value string, digest string"
        )
        found = mapping.coverage(rows.drop("n"), stored, "record").collect()
        wrong = "invalid_metadata" if column == "digest" else "changed"
        assert {(r["record"], r[wrong], r["missing"], r["extra"]) for r in found} == {(k, len(texts) - 1, 0, 0) for k in range(len(texts))}
    digest = spark.createDataFrame([("a" * 64,)], "digest string").select(mapping._packed("digest")).first()[0]
    assert len(digest) == 33
    plan = mapping.coverage(rows.drop("n"), stored, "record")._jdf.queryExecution().optimizedPlan().toString()
    dealt = plan[plan.index("RepartitionByExpression") :]
    assert "struct(" not in dealt.split("Union")[0] and "unhex" in dealt  # rows are packed before they are dealt
