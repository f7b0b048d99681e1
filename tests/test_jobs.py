"""Bulk lists, reconciliation, exports, catalogue, paging and streams."""

import os
import time

import pytest
from pyspark.sql import functions as F

from factledger.operators import bulk, catalog, reconcile, relations, search
from factledger.sources import exports, jsonl, lists
from factledger.streaming import batches, publish
from factledger.workspace import new_path


def entries(spark, rows):
    return bulk.with_errors(spark.createDataFrame(rows, "input_id string, value string, mode string"))


def test_contains_equals_brute_force(spark):
    texts = [(1, "Árvore e casa"), (2, "CASAMENTO"), (3, "*"), (4, "a*b?c"), (5, None)]
    asked = [("a", "casa", "contains"), ("b", "arvore", "contains"), ("c", "*b?", "contains"), ("d", "ca", "contains"), ("e", "CASA", "contains"), ("f", " ", "contains")]
    registry = spark.createDataFrame(texts, "id long, text string")
    listed = entries(spark, asked)
    links = bulk.match_contains(listed, registry, "id", "text")
    assert {(r.input_id, r.id) for r in links.collect()} == {("a", 1), ("a", 2), ("b", 1), ("c", 4), ("e", 1), ("e", 2)}
    status = {r.input_id: (r.state, r.found) for r in bulk.entry_status(listed, links).collect()}
    assert status == {"a": ("found", 2), "b": ("found", 1), "c": ("found", 1), "d": ("invalid", 0), "e": ("found", 2), "f": ("invalid", 0)}


def test_prefixes_of_every_length(spark):
    texts = ["", "a", "ab", "abc", "Abcd", "abcdefgh", "abcdefghi", "b\u00e9ta", None]
    registry = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    asked = ["a", "ab", "abc", "ABCDE", "abcdefgh", "abcdefghij", "b\u00c9", "z", ""]
    listed = entries(spark, [(a, a, "prefix") for a in asked])
    links = bulk.match_prefix(listed, registry, "id", "text")
    fold = lambda s: s.lower().replace("\u00e9", "e")
    expected = {(a, n) for a in asked if a for n, s in enumerate(texts) if s is not None and fold(s).startswith(fold(a))}
    got = [(r.input_id, r.id) for r in links.collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_entries_that_cannot_be_matched_say_why(spark):
    rows = [("a", None, "eq"), ("b", " ", "eq"), ("c", "x", "like"), ("d", "x", None), ("e", "xy", "contains"), ("f", "x", "eq"), ("f", "y", "eq")]
    got = sorted((r.input_id, r.error or "") for r in entries(spark, rows).collect())
    assert got == [
        ("a", "empty_entry"), ("b", ""), ("c", "unknown_mode"), ("d", "unknown_mode"), ("e", "text_too_short"),
        ("f", "repeated_input_id"), ("f", "repeated_input_id"),
    ]


def test_documents_need_their_check_digits(spark):
    rows = [("a", "CPF", "529.982.247-25"), ("b", "CPF", "529.982.247-26"), ("c", "RG", "52998224725"), ("d", None, "1")]
    listed = bulk.with_document_errors(spark.createDataFrame(rows, "input_id string, document_type string, value string"))
    registry = spark.createDataFrame([(1, "CPF", "52998224725"), (2, "RG", "529 982 247 25")], "id long, kind string, number string")
    links = bulk.match_document(listed, registry, "id", "kind", "number")
    assert {(r.input_id, r.id) for r in links.collect()} == {("a", 1), ("c", 2)}
    assert {r.input_id for r in listed.filter("error IS NOT NULL").collect()} == {"b"}


def test_csv_lists_keep_quoted_cells(spark):
    df = spark.createDataFrame([(1, 'a, "b,1"\n\n c \n"x\ny",')], "id long, t string")
    got = [(r.input_id, r.value) for r in lists.list_entries(df, "id", "t").collect()]
    assert got == [("1", "a"), ("2", '"b'), ("3", '1"'), ("4", "c"), ("5", "x\ny")]


def test_reconcile_names_every_tampering(spark):
    left = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id long, s string, n long")
    right = spark.createDataFrame([(1, "a", 0), (2, "B", 2), (4, "d", 1)], "id long, s string, n long")
    got = {(r.id, r.code) for r in reconcile.compare_columns(left, right, ["id"], ["s", "n"]).collect()}
    assert got == {(1, "n_mismatch"), (2, "s_mismatch"), (2, "n_mismatch"), (3, "missing"), (4, "extra")}
    assert reconcile.compare_columns(left, left, ["id"], ["s", "n"]).isEmpty()


def test_digest_ignores_order_but_not_content(spark):
    df = spark.range(1000).withColumn("x", F.when(F.col("id") % 7 != 0, F.col("id")))
    assert reconcile.digest(df, ["id", "x"]) == reconcile.digest(df.orderBy(F.col("id").desc()), ["id", "x"])
    assert reconcile.digest(df, ["id", "x"]) != reconcile.digest(df.na.fill(0), ["id", "x"])


def test_idempotent_append_outcomes(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "op string, h string")
    incoming = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1"), ("c", "1"), ("d", "1"), ("d", "2")], "op string, h string")
    got = {r.op: r.outcome for r in reconcile.idempotent_append(stored, incoming, "op", "h").collect()}
    assert got == {"a": "replayed", "b": "conflict", "c": "append", "d": "conflict"}


def test_publish_decisions(spark):
    target = spark.createDataFrame([("a", 2, "x"), ("b", 2, "x"), ("c", 2, "x"), ("d", 2, "x")], "entity string, version long, content string")
    incoming = spark.createDataFrame([("a", 1, "y"), ("a", 3, "z"), ("b", 2, "x"), ("c", 2, "y"), ("d", 1, "x"), ("e", 1, "q")], target.schema)
    got = {(r.entity, r.version): r.decision for r in reconcile.publish_decisions(incoming, target, "entity").collect()}
    assert got == {
        ("a", 1): "obsolete", ("a", 3): "indexed", ("b", 2): "already_indexed", ("c", 2): "conflict", ("d", 1): "obsolete", ("e", 1): "indexed",
    }
    rows = [("x", 1, "p"), ("x", 1, "q"), ("x", 2, "r"), ("y", 1, "p"), ("y", 2, "q"), ("y", 2, "r")]
    got = {(r.entity, r.version): r.decision for r in reconcile.publish_decisions(spark.createDataFrame(rows, target.schema), target, "entity").collect()}
    assert got == {("x", 1): "conflict", ("x", 2): "indexed", ("y", 1): "indexed", ("y", 2): "conflict"}


def test_keyset_pages_cover_everything_once(spark):
    df = spark.createDataFrame([(a, b) for a in range(5) for b in range(4)], "a long, b long")
    for descending in (False, True):
        after, seen = None, []
        while True:
            page = search.keyset_page(df, ["a", "b"], after, 7, descending).orderBy("position").collect()
            seen += [(r.a, r.b) for r in page]
            if not page or not page[-1].has_more:
                break
            after = (page[-1].a, page[-1].b)
        assert seen == sorted(((a, b) for a in range(5) for b in range(4)), reverse=descending)


def test_byte_page_reports_an_oversized_first_row(spark):
    df = spark.createDataFrame([(1, 500), (2, 10)], "id long, n long")
    first = search.byte_page(df, ["id"], F.col("n"), 10, 100).collect()
    assert [(r.id, r.error) for r in first] == [(1, "row_too_large")]
    rest = search.byte_page(df.filter("id > 1"), ["id"], F.col("n"), 10, 100).collect()
    assert [(r.id, r.in_page, r.has_more) for r in rest] == [(2, True, False)]


def test_short_text_queries_are_refused():
    with pytest.raises(ValueError):
        search.fold_contains(None, "ab")
    with pytest.raises(ValueError):
        search.fold_prefix(None, "a")


def test_relationship_documents(spark):
    edges = spark.createDataFrame(
        [("A", "mother", None, 1, True), ("B", "father", None, 1, True), ("A", "spouse", None, 2, True), ("A", "other", None, 3, True), ("C", "x", None, 1, False), ("A", "sibling", "A", None, True)],
        "owner string, rel string, target_id string, target_document long, document_valid boolean",
    )
    documents = spark.createDataFrame([("B", 1, True), ("B", 2, True), ("C", 2, True), ("D", 3, False)], "owner string, document long, valid boolean")
    got = {(r.owner, r.rel): (r.status, r.target) for r in relations.resolve_by_document(edges, documents).collect()}
    assert got == {
        ("A", "mother"): ("resolved", "B"), ("B", "father"): ("self_reference", None), ("A", "spouse"): ("ambiguous_document", None),
        ("A", "other"): ("pending_target", None), ("C", "x"): ("pending_document_validation", None),
    }
    known = spark.createDataFrame([("A", "person")], "entity string, entity_type string")
    assert [r.status for r in relations.resolve_by_id(edges, known).collect()] == ["self_reference"]


def test_definition_history(spark):
    rows = [(1, 1, "int", "a"), (1, 2, "int", "a"), (1, 3, "text", "b"), (1, 4, "int", "b"), (1, 5, "int", "a"), (2, 1, "int", "z")]
    df = spark.createDataFrame(rows, "k long, n long, typ string, name string").withColumn("at", F.timestamp_seconds("n"))
    got = {(r.k, r.n): (r.status, r.version, r.valid_to and r.valid_to.second) for r in catalog.history_intervals(df, "k", "n", "at", "typ", "name").collect()}
    assert got == {(1, 1): ("version", 1, 4), (1, 3): ("incompatible", None, None), (1, 4): ("version", 2, 5), (1, 5): ("version", 3, None), (2, 1): ("version", 1, None)}


def test_volumes_survive_the_round_trip_and_show_damage(spark):
    rows = spark.range(1000).withColumn("x", F.sha2(F.col("id").cast("string"), 256))
    volumes = exports.with_volume(rows, [F.col("id").asc()], size=300)
    path = new_path(spark, "volumes")
    exports.write_volumes(volumes, path)
    again = spark.read.schema(volumes.schema).parquet(path)
    checked = exports.verify_volumes(volumes, again, ["id", "x", "ordinal"]).orderBy("volume").collect()
    assert [(r.volume, r.rows, r.rows_match, r.content_match) for r in checked] == [(v, n, True, True) for v, n in ((1, 300), (2, 300), (3, 300), (4, 100))]
    damaged = again.withColumn("x", F.when(F.col("id") == 450, "?").otherwise(F.col("x")))
    assert [r.content_match for r in exports.verify_volumes(volumes, damaged, ["id", "x"]).orderBy("volume").collect()] == [True, False, True, True]


def test_history_reads_one_bucket_for_an_owner(spark):
    from pyspark.sql.types import IntegerType, StructField, StructType

    obs = spark.range(500).select((F.col("id") % 9).alias("owner"), "id", F.col("id").alias("version"), F.lit(1).alias("seq"))
    path = new_path(spark, "history")
    exports.append_history(obs, path, rows_per_file=20)
    schema = StructType([*obs.schema.fields, StructField("bucket", IntegerType())])
    one = exports.read_history(spark, path, schema, owner=4)
    assert one.count() == obs.filter("owner = 4").count()
    assert len(one.inputFiles()) <= len(spark.read.schema(schema).parquet(path).inputFiles())


def test_replayed_batches_are_no_ops_and_altered_ones_conflict(spark):
    source, target, receipts = (new_path(spark, n) for n in ("src", "dst", "rcp"))
    spark.range(10).write.mode("append").parquet(source)
    schema = spark.range(1).schema
    run = lambda: batches.ingest(batches.file_stream(spark, source, schema, None), target, receipts, new_path(spark, "cp"))
    assert run() == {"written": 1, "replayed": 0}
    assert run() == {"written": 0, "replayed": 1}
    assert batches.read_parts(spark, target, schema).count() == 10
    spark.range(10, 12).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="committed with other content"):
        run()
    assert batches.read_parts(spark, target, schema).count() == 10


def test_stream_publication_keeps_the_newest(spark):
    source, target, decisions, checkpoint = (new_path(spark, n) for n in ("s", "t", "d", "c"))
    schema = "entity string, version long, content string"
    struct = spark.createDataFrame([], schema).schema
    for rows in ([("a", 2, "x"), ("b", 1, "y")], [("a", 1, "old"), ("b", 1, "other"), ("c", 5, "z")], [("a", 2, "x"), ("b", 3, "new")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        publish.publish(batches.file_stream(spark, source, struct, None), target, decisions, checkpoint)
        time.sleep(0.05)
    assert {(r.entity, r.version, r.content) for r in publish.published(spark, target, struct).collect()} == {("a", 2, "x"), ("b", 3, "new"), ("c", 5, "z")}
    seen = spark.read.parquet(decisions).groupBy("decision").count().collect()
    assert {r.decision: r["count"] for r in seen} == {"indexed": 4, "obsolete": 1, "conflict": 1, "already_indexed": 1}


def test_json_lines_are_kept_or_refused_never_lost(spark):
    lines = [
        '{"source_id":"s","external_id":"1","record":{"n":1.2300e+2}}', '{"source_id":"s","external_id":2,"record":{}}',
        '{"source_id":"s","external_id":"3","record":{},"x":1}', '{"source_id":"s","source_id":"s","external_id":"4","record":{}}', "not json",
        '{"source_id":"s","external_id":"6","source_version":1.5,"record":{}}', '{"source_id":"s","external_id":"7","source_version":null,"record":{}}',
    ]
    path = new_path(spark, "lines")
    spark.createDataFrame([(x,) for x in lines], "line string").write.text(path)
    good, bad = jsonl.split(jsonl.envelopes(jsonl.read_lines(spark, path)))
    assert sorted(r.external_id for r in good.collect()) == ["1", "7"]
    assert any("1.2300e+2" in r.line for r in good.collect())
    assert {r.line: r.error for r in bad.collect()} == {
        lines[1]: "invalid_envelope", lines[2]: "invalid_envelope", lines[3]: "json_duplicate_keys", lines[4]: "json_invalid", lines[5]: "invalid_source_version",
    }


def test_uploaded_lists_and_inventories(spark):
    path = new_path(spark, "list")
    spark.createDataFrame([("a,b",), (" ,c",)], "v string").coalesce(1).write.text(path)
    assert [r.value for r in lists.read_lists(spark, path).orderBy("input_id").collect()] == ["a", "b", "c"]
    fields = new_path(spark, "inv")
    spark.createDataFrame([("s", "/id", "text"), ("s", "/my_email", "text"), ("s", "/z", "text")], "source_id string, field string, type string").write.csv(fields, header=True)
    rules = spark.createDataFrame([("/id", "identity.number", "mapped")], "field string, target string, status string")
    mapped = lists.map_inventory(lists.read_inventory(spark, fields), rules, F.upper("field").rlike("EMAIL"), ("custom.original_field", "pending_mapping"))
    assert {r.field: r.status for r in mapped.collect()} == {"/id": "mapped", "/my_email": "pending_contact_parse", "/z": "pending_mapping"}


def test_wide_kinds_continue_in_further_tables(spark):
    facts = spark.createDataFrame([(1, "k", f"c{n}", str(n)) for n in range(5)], "item long, target_kind string, key string, value string")
    tables = exports.kind_tables(facts, "k", ["item"], width=2)
    assert [t.columns for t in tables] == [["item", "c0", "c1"], ["item", "c2", "c3"], ["item", "c4"]]
    assert tables[2].first().c4 == "4"


def test_the_shared_folder_is_the_configured_one(spark):
    path = new_path(spark, "x")
    assert os.path.isabs(path.removeprefix("file:")) and spark.sparkContext.applicationId in path
