"""Exports with a manifest, pins of files of any size, schema digests."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from factledger.sources import exports
from factledger.workspace import new_path


@pytest.fixture
def export(spark):
    path = new_path(spark, "export")
    people = spark.createDataFrame([(k, f"n{k % 5}", None if k % 3 else "x") for k in range(95)], "id long, name string, note string")
    bought = spark.createDataFrame([(k, k % 7) for k in range(40)], "order_id long, id long")
    tables = {"people": (people, "id", [F.col("id").asc()]), "bought": (bought, "id", [F.col("order_id").desc()])}
    exports.write_export(tables, path, volume_rows=20)
    return path, {name: (rows, ident) for name, (rows, ident, _) in tables.items()}


def states(checked):
    return {(r["level"], r["table"], r["volume"]): r["matches"] for r in checked.collect()}


def test_manifest_lists_every_volume_table_and_the_whole(spark, export):
    path, tables = export
    rows = {(r["level"], r["table"], r["volume"]): (r["rows"], r["ids"]) for r in exports.read_manifest(spark, path).collect()}
    assert rows["export", "", None] == (135, 95 + 14) and rows["table", "people", None] == (95, 95)
    assert [rows["volume", "people", v] for v in range(1, 6)] == [(20, 20)] * 4 + [(15, 15)]
    assert rows["volume", "bought", 2] == (20, 7) and len(rows) == 1 + 2 + 5 + 2
    assert all(states(exports.check_export(tables, path)).values())


@pytest.mark.parametrize("damage", ["value", "gone", "doubled"])
def test_damage_is_found_in_its_volume(spark, export, damage):
    path, tables = export
    volume = exports.read_volumes(tables["people"][0], path, "people", 3).drop("volume")
    first = F.col("ordinal") == 41
    changed = {
        "value": volume.withColumn("note", F.when(first, "\x00").otherwise(F.col("note"))),
        "gone": volume.filter(~first),
        "doubled": volume.unionByName(volume.filter(first)),
    }[damage]
    rows = spark.createDataFrame(changed.collect(), volume.schema)
    rows.write.mode("overwrite").parquet(f"{path}/people/volume=3")
    found = states(exports.check_export(tables, path))
    assert {k for k, same in found.items() if not same} == {("export", "", None), ("table", "people", None), ("volume", "people", 3)}
    one = exports.check_export({"people": tables["people"]}, path, volume=3)
    assert states(one) == {("volume", "people", 3): False}
    good = exports.check_export({"people": tables["people"]}, path, volume=2)
    assert states(good) == {("volume", "people", 2): True}
    read = exports.read_volumes(tables["people"][0], path, "people", 2).select(F.input_file_name().alias("f")).distinct().collect()
    assert all("volume=2" in r["f"] for r in read)  # the others are not read


def test_a_volume_is_one_file_named_by_the_volume_alone(spark):
    rows = [(k, f"n{k}" if k % 3 else None, k / 7, k // 10 + 1) for k in range(95)]
    table = spark.createDataFrame(rows, "ordinal long, name string, share double, volume long")
    path = new_path(spark, "volumes")
    exports.write_volumes(table.repartition(7), path)
    folder = path.split(":", 1)[-1]
    found = sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names)
    assert found == sorted(f"volume={v}/part-0.parquet" for v in range(1, 11))  # the same in whatever task it is written
    assert sorted(map(tuple, spark.read.schema(table.schema).parquet(path).select(*table.columns).collect())) == rows
    one = spark.read.parquet(f"{path}/volume=4").select("ordinal").collect()
    assert [r["ordinal"] for r in one] == list(range(30, 40))
    with pytest.raises(FileExistsError):
        exports.write_volumes(table, path)
    kept, base = table.drop("ordinal", "volume"), os.path.dirname(path)
    one = exports.read_volumes(kept, base, os.path.basename(path), 10)
    assert sorted(map(tuple, one.select(*table.columns).collect())) == rows[90:]
    assert exports.read_volumes(kept, base, os.path.basename(path), 11).collect() == []
    empty = new_path(spark, "volumes")
    exports.write_volumes(table.limit(0), empty)
    assert spark.read.schema(table.schema).parquet(empty).count() == 0


def test_cells_of_all_kinds(spark):
    rows = [(k, f"i{k % 3}", kind, f"c{k % n}", str(k)) for kind, n in (("a", 5), ("b", 2)) for k in range(12)]
    facts = spark.createDataFrame(rows, "record long, item string, target_kind string, key string, value string")
    cells, columns = exports.kind_cells(facts, ["record", "item"], width=2)
    named = {(r["kind"], r["key"]): (r["sheet"], r["place"]) for r in columns.collect()}
    assert named == {("a", f"c{k}"): (k // 2 + 1, k % 2 + 1) for k in range(5)} | {("b", "c0"): (1, 1), ("b", "c1"): (1, 2)}
    assert cells.count() == 24


def test_cells_are_dealt_once_by_item(spark):
    """Facts were kept whole and dealt out by the names of their columns."""
    rows = [(k % 7, f"i{k % 3}", "a" if k % 2 else None, f"c{k % 5}" if k % 11 else None, str(k)) for k in range(200)]
    facts = spark.createDataFrame(rows, "record long, item string, target_kind string, key string, value string")
    cells, columns = exports.kind_cells(facts, ["record", "item"], width=2)
    plan = cells._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning(record" in line]
    assert len(dealt) == 1 and "Exchange hashpartitioning(kind" not in plan and "key" not in dealt[0]
    assert columns.columns == ["kind", "key", "sheet", "place"]
    place = {(r["kind"], r["key"]): (r["sheet"], r["place"]) for r in columns.collect()}
    most = {}
    for record, item, kind, key, value in rows:
        if kind and key:  # the others have no column
            cell = (record, item, kind, *place[kind, key])
            most[cell] = max(most.get(cell, ""), value)
    assert sorted(map(tuple, cells.collect())) == sorted((*cell, value) for cell, value in most.items())


def test_a_few_rules_are_sent_to_the_leaves(spark, tmp_path):
    from factledger.plans import load_queries
    from factledger.plans.tables import Tables

    rules = load_queries.rules(Tables(spark, str(tmp_path)))
    leaves = spark.range(50).select(F.concat(F.lit("/id"), F.when(F.col("id") % 2 == 0, "").otherwise("x")).alias("base_field"))
    joined = leaves.join(rules, "base_field", "left")
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().sparkPlan().toString()
    assert joined.filter("target_kind = 'identity'").count() == 25 and rules.count() == len(load_queries.RULE_ROWS)


@pytest.mark.parametrize("chunk", [7, 1000, 1 << 20])
def test_pins_of_files_in_chunks(spark, tmp_path, chunk):
    contents = {"a.bin": os.urandom(2500), "deep/er/b.txt": b"x" * 1000, "deep/one.csv": b"1"}
    (tmp_path / "empty.csv").write_bytes(b"")  # nothing to pin
    for name, content in contents.items():
        os.makedirs((tmp_path / name).parent, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    pins = {r["file_name"]: (r["bytes"], r["digest"]) for r in exports.file_pins(spark, str(tmp_path), chunk).collect()}

    def tree(content):
        marks = [hashlib.sha256(content[k : k + chunk]).hexdigest() for k in range(0, len(content), chunk)]
        return hashlib.sha256("".join(marks).encode()).hexdigest()

    assert pins == {name: (len(content), tree(content)) for name, content in contents.items()}
    recorded = exports.file_pins(spark, str(tmp_path), chunk)
    recorded = spark.createDataFrame(recorded.collect(), recorded.schema)
    (tmp_path / "a.bin").write_bytes(contents["a.bin"][:-1] + bytes([contents["a.bin"][-1] ^ 1]))
    (tmp_path / "new.txt").write_bytes(b"n")
    known = recorded.filter("file_name <> 'deep/er/b.txt'").unionByName(spark.createDataFrame([("old", 1, "x")], recorded.schema))
    found = {r["file_name"]: r["status"] for r in exports.check_pins(known, exports.file_pins(spark, str(tmp_path), chunk)).collect()}
    assert found == {"a.bin": "changed", "deep/er/b.txt": "new", "deep/one.csv": "unchanged", "new.txt": "new", "old": "missing"}


def test_schema_digest(spark):
    def digest(ddl):
        return exports.schema_digest(spark.createDataFrame([], ddl))

    assert digest("a long, b struct<x: int, y: string>") == digest("b struct<y: string, x: int>, a long")
    others = ["a long, b struct<x: int, y: string>", "a int, b struct<x: int, y: string>", "a long, b struct<x: int, z: string>", "a long"]
    others += ["a array<int>", "a array<long>", "a map<string, int>", "a map<int, string>"]
    assert len({digest(ddl) for ddl in others}) == len(others)
