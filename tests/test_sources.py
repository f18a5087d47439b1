import json

import pytest

from lucerna.sources import loaders
from lucerna.streaming import ingest


def test_isf(spark, tmp_path):
    (tmp_path / "a.fs").write_text('/*{"CREDIT":"ann","CATEGORIES":["x"],"INPUTS":[{"NAME":"inputImage","TYPE":"image"}]}*/\nvoid main(){}\n')
    (tmp_path / "b.fs").write_text("void main(){}")
    (tmp_path / "c.fs").write_text("/*{ not json }*/ x")
    (tmp_path / "d.fs").write_text('/*{"TITLE":"Dee"}*/code')
    got = {r.name: r for r in loaders.isf_dir(spark, str(tmp_path)).collect()}
    assert set(got) == {"a", "Dee"}
    a = got["a"]
    assert a.code_image == "void main(){}" and a.username == "ann" and a.reference_only and not a.is_generator and a.tags_raw == ["x"] and a.shader_id == "isf_" + a.code_hash and len(a.code_hash) == 12
    assert got["Dee"].username == "ISF" and got["Dee"].is_generator


def test_local(spark, tmp_path):
    (tmp_path / "Pixel Flow").mkdir()
    (tmp_path / "Pixel Flow" / "my_shader.frag").write_text("// Author: bob\nvoid main(){}")
    (tmp_path / "Pixel Flow" / "my_shader.meta.json").write_text(json.dumps({"description": "d", "license": "MIT", "likes": 0}))
    (tmp_path / "r.glsl").write_text("// all rights reserved\nx")
    (tmp_path / "blank.glsl").write_text(" \n")
    got = loaders.local_dir(spark, str(tmp_path)).collect()
    assert len(got) == 1
    r = got[0]
    assert (r.shader_id, r.name, r.username, r.likes) == ("local_pixel_flow_my_shader", "My Shader", "bob", 100) and r.description == "d\n[license] MIT"
    assert loaders.local_dir(spark, str(tmp_path), accept_restricted=True).count() == 2


def test_code_dir(spark, tmp_path):
    code = "void main(){ " + "x;" * 40 + "}"
    raw = {"info": {"id": "abc123", "name": "n", "likes": 3, "tags": ["t"]}, "renderpass": [{"type": "image", "code": code}]}
    (tmp_path / "a.json").write_text(json.dumps(raw))
    (tmp_path / "b.glsl").write_text(code)
    (tmp_path / "c.glsl").write_text("short")
    (tmp_path / "d.json").write_text(json.dumps({"info": {"id": ""}, "pad": "p" * 60}))
    got = {r.shader_id: r for r in loaders.code_dir(spark, str(tmp_path)).collect()}
    assert "abc123" in got and got["abc123"].likes == 3 and len(got) == 2
    assert any(k.startswith("twigl_") and r.code_image.startswith('{"info"') for k, r in got.items()), "JSON without usable content is taken as bare code"


def test_raw_clean_and_save(spark, tmp_path):
    raw = tmp_path / "raw"
    raw.mkdir()
    (raw / "x.json").write_text(json.dumps({"info": {"id": "abc123", "name": None}, "renderpass": []}))
    (raw / "bad.json").write_text("{")
    df = loaders.raw_dir(spark, str(raw))
    assert [(r.shader_id, r.name, r.is_generator) for r in df.collect()] == [("abc123", "", True)]
    loaders.save_records(loaders.hashed(df).unionByName(df), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    assert loaders.union_sources(df, df).filter("src_ord = 1").count() == 1
    assert loaders.clean_dir(spark, str(raw)).count() == 0


def test_ids(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("# c\n abcdef \n\nXlSSRV\n")
    ids = loaders.id_list(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.id for r in ids.collect()) == ["XlSSRV", "abcdef"]
    assert [r.id for r in loaders.not_cached(ids, spark.createDataFrame([("abcdef",)], "id string")).collect()] == ["XlSSRV"]
    text = "see https://www.shadertoy.com/view/XlSSRV\nabcdef\nXlSSRV\ntoo long line\n"
    got = loaders.extract_ids(spark.createDataFrame([(text,), (None,)], "text string")).collect()
    assert got[0].ids == ["XlSSRV", "abcdef"] and got[1].ids == []


def test_incremental_ingest(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "table")
    schema = "k string, at int, v string"
    spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], schema).coalesce(1).write.parquet(source + "/1")
    run = lambda: ingest.ingest(spark, source + "/*", schema, target, "k", ["at"]).awaitTermination()
    run()
    assert sorted((r.k, r.v) for r in ingest.current_version(spark, target).collect()) == [("a", "y"), ("b", "z")]
    spark.createDataFrame([("b", 0, "new"), ("c", 1, "c")], schema).coalesce(1).write.parquet(source + "/2")
    run()
    run()
    assert sorted((r.k, r.v) for r in ingest.current_version(spark, target).collect()) == [("a", "y"), ("b", "new"), ("c", "c")]


def test_a_broken_manifest_loses_nothing(spark, tmp_path):
    target = str(tmp_path / "table")
    rows = [(f"k{i}", 1, "old") for i in range(50)]
    batch = lambda *r: spark.createDataFrame(list(r), "k string, at int, v string")
    ingest.merge_batch(spark, batch(*rows), 0, target, "k", ["at"])
    before = ingest.manifest(spark, target)
    (tmp_path / "table/manifests/00000002").mkdir()  # a crash while writing: no _SUCCESS
    assert ingest.manifest(spark, target) == (3, before[1]) and ingest.current_version(spark, target).count() == 50
    ingest.merge_batch(spark, batch(("k1", 2, "new"), ("z", 1, "z"), (None, 1, "none")), 1, target, "k", ["at"])
    got = {r.k: r.v for r in ingest.current_version(spark, target).collect()}
    assert len(got) == 52 and got["k1"] == "new" and got["k2"] == "old"
    after = ingest.manifest(spark, target)[1]
    assert sum(after[p] != f for p, f in before[1].items()) <= 3, "only touched parts are written anew"
    for f in (tmp_path / "table/manifests/00000003").glob("part-*"):
        f.write_text("{broken")
    for f in (tmp_path / "table/manifests/00000003").glob(".*.crc"):
        f.unlink()
    with pytest.raises(Exception):
        ingest.merge_batch(spark, batch(("k3", 3, "x")), 2, target, "k", ["at"])


def test_distinct_stream(spark, tmp_path):
    import datetime

    source = str(tmp_path / "in")
    at = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("a", at, 1), ("a", at, 1), ("b", at, 2)], "k string, at timestamp, v int").coalesce(1).write.parquet(source + "/1")
    spark.createDataFrame([("a", at, 1), ("c", at, 3)], "k string, at timestamp, v int").coalesce(1).write.parquet(source + "/2")
    stream = spark.readStream.schema("k string, at timestamp, v int").option("maxFilesPerTrigger", 1).parquet(source + "/*")
    q = ingest.distinct_stream(stream, "k", "at").writeStream.format("memory").queryName("seen_once").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("seen_once").collect()) == ["a", "b", "c"]


def test_named_tables(spark, tmp_path):
    from lucerna.operators import search
    from lucerna.sources import store

    target = str(tmp_path / "chunks")
    frame = lambda *r: spark.createDataFrame(list(r), "chunk_id string, at int, text string")
    with pytest.raises(ValueError):
        store.load(spark, target)
    store.upsert(frame(("a", 1, "one"), ("a", 2, "two"), ("b", 1, "three")), target, "chunk_id", ["at"])
    store.upsert(frame(("b", 0, "four"), ("c", 0, "five")), target, "chunk_id", ["at"])
    got = store.load(spark, target)
    assert got.columns == ["chunk_id", "at", "text"] and sorted((r.chunk_id, r.text) for r in got.collect()) == [("a", "two"), ("b", "four"), ("c", "five")]
    index = search.postings(got)
    store.save_postings(index, str(tmp_path / "postings"))
    assert sorted(map(tuple, store.load_postings(spark, str(tmp_path / "postings")).collect())) == sorted(map(tuple, index.collect()))
    store.reset(spark, target)
    store.reset(spark, target)
    with pytest.raises(ValueError):
        store.load(spark, target)
