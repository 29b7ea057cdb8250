"""JSON documents read by byte ranges, and the order of updates in files."""

import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnstile.sources import document as D
from turnstile.sources import store as ST

RECORD = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("flavor", T.StringType()),
                       T.StructField("conversation", T.MapType(T.StringType(), T.StringType()))])


def _odd_text(rng):
    parts = ["{", "}", '"', "\\", "[", "]", ",", ":", "a", "é", "\n", '"conversations": {', "x " * 3]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 20)))


def _records(n=30):
    rng = random.Random(1)
    return {f"id{i}" + rng.choice(["", "}", '"', ","]): {
        "request_id": f"id{i}", "flavor": _odd_text(rng),
        "conversation": {f"turn_{t}": _odd_text(rng) for t in range(rng.randint(0, 4))}} for i in range(n)}


@pytest.fixture
def small_splits(spark):
    """Splits of the given size, so that boundaries fall into strings, keys and numbers."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        spark.conf.set(names[0], str(size))
        spark.conf.set(names[1], "0")
    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size,indent", [(211, None), (700, 2), (1 << 27, None)])
def test_every_form_equals_its_records_in_file_order(spark, tmp_path, small_splits, size, indent):
    recs = _records()
    forms = {
        "wrapped": {"version": 1, "meta": {"x": {"y": 1}, "conversations": {"no": {"request_id": "bad"}}},
                    "conversations": recs, "after": {"z": {"request_id": "bad"}}},
        "bare": recs, "list": list(recs.values()),
        "wrapped list": {"a": [1, {"b": 2}], "conversations": list(recs.values()), "t": [{"request_id": "q"}]}}
    small_splits(size)
    for name, doc in forms.items():
        path = tmp_path / f"{name}.json"
        path.write_text(json.dumps(doc, indent=indent, ensure_ascii=False) + ("\n" if indent else ""))
        members = D.read_members(spark, str(path), strict=name.startswith("wrapped"))
        rows = D.parse_members(members, RECORD).orderBy("position").collect()
        assert [r.r.asDict() for r in rows] == list(recs.values()), name
        assert [r.key for r in rows] == ([None] * len(recs) if "list" in name else list(recs)), name
    if size < 300:
        chunks = spark.read.option("lineSep", "}").text(str(tmp_path / "wrapped.json"))
        splits = chunks.select(F.col("_metadata.file_block_start").alias("b")).distinct().count()
        assert splits > 10


def test_documents_that_are_no_store_raise(spark, tmp_path):
    path = tmp_path / "x.json"
    for text in ('{"conversations": {"a": {"x": 1}', '{"conversations": {"a": {"x": "1', '{"x": {}}',
                 '{"conversations": 5}', '"conversations"'):
        path.write_text(text)
        with pytest.raises(D.StoreError):
            D.read_members(spark, str(path))
    path.write_text('{"conversations": {"a": {"request_id": 1x}}}')
    with pytest.raises(Exception, match="malformed record"):
        D.parse_members(D.read_members(spark, str(path)), RECORD).collect()
    for text in ('{"conversations": {}}', '{"conversations": [ ]}\n\n'):
        path.write_text(text)
        assert D.read_members(spark, str(path)).count() == 0


def test_stores_are_found_like_the_loader_does(spark, tmp_path):
    for name in ("zeta_conversations", "benign_conversations", "alpha_conversations", "threat_conversations", "other"):
        (tmp_path / f"{name}.json").write_text('{"conversations": {}}')

    def found(path):
        return [p.rsplit("/", 1)[1].split("_")[0] for p in D.discover(spark, str(path))]
    assert found(tmp_path) == ["threat", "benign", "alpha", "zeta"]
    assert found(tmp_path / "benign_conversations.json") == ["benign", "threat"]
    assert found(tmp_path / "zeta_conversations.json") == ["zeta"]
    assert found(tmp_path / "other.json") == ["other.json"]
    assert found(tmp_path / "gone_conversations.json") == ["threat", "benign", "alpha", "zeta"]
    assert found(tmp_path / "none" / "gone") == []


@pytest.mark.parametrize("form", ["keyed", "map", "list"])
def test_document_is_written_record_by_record(spark, tmp_path, form):
    recs = spark.createDataFrame([(f"r{i}", f"f\"{i}") for i in range(25)], "request_id string, flavor string")
    ST.write_store(recs.repartition(4), str(tmp_path / "d"), jsonl=False, form=form)
    [part] = list((tmp_path / "d").glob("part-*"))
    doc = json.loads(part.read_text())
    doc = doc["conversations"] if form == "keyed" else doc
    values = doc if form == "list" else list(doc.values())
    assert [v["flavor"] for v in values] == [f"f\"{i}" for i in sorted(range(25), key=str)]
    back = ST.read_store(spark, str(tmp_path / "d"), strict=form == "keyed")
    assert back.count() == 25 and {r.source for r in back.collect()} == {"d"}
    ST.write_store(recs.limit(0), str(tmp_path / "e"), jsonl=False, form=form)
    assert ST.read_store(spark, str(tmp_path / "e"), strict=form == "keyed").count() == 0


def test_last_update_does_not_depend_on_the_partitioning(spark, tmp_path, small_splits):
    rows = [(f"k{i % 40}", i) for i in range(400)]
    random.Random(3).shuffle(rows)
    lines = [json.dumps({"request_id": k, "v": v}) for k, v in rows]
    (tmp_path / "a.json").write_text("\n".join(lines[:250]))
    (tmp_path / "b.json").write_text("\n".join(lines[250:]))
    truth = dict(rows)
    for size in (97, 1000, 1 << 27):
        small_splits(size)
        read = spark.read.schema("request_id string, v long").json(str(tmp_path)).select("*", ST.ingest_order().alias("ordinal"))
        for n in (1, 7):
            got = ST.last_per_key(read.repartition(n, "v").sortWithinPartitions(F.desc("v")), "request_id")
            assert {r.request_id: r.v for r in got.collect()} == truth
    with pytest.raises(ValueError, match="file order"):
        ST.last_per_key(read.drop("ordinal"), "request_id")
