"""Text sources and sinks on files."""

import json

from statuta.sources import jsonl


def test_line_numbers_over_splits(spark, tmp_path):
    lines = [json.dumps({"k": k, "t": "é" * (k % 40)}, ensure_ascii=False) if k % 9 else ["", "# note", "{broken"][k // 9 % 3] for k in range(700)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n", encoding="utf-8")
    (tmp_path / "b.jsonl").write_text("{broken\n", encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        read = jsonl.read_numbered(spark, f"file://{tmp_path}")
        assert read.rdd.getNumPartitions() > 3
        good, bad = jsonl.parse(read, "k int, t string")
        assert sorted((r.file.rsplit("/", 1)[1], r.no) for r in bad.collect()) == sorted([("b.jsonl", 1), *[("a.jsonl", k + 1) for k, x in enumerate(lines) if x == "{broken"]])
        assert sorted(r.k for r in good.collect()) == [k for k in range(700) if k % 9]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_write_keeps_text_and_nulls(spark, tmp_path):
    jsonl.write(spark.createDataFrame([(1, "ü\n\"x\""), (2, None)], "k int, t string").coalesce(1), f"file://{tmp_path}/out")
    text = "".join(p.read_text(encoding="utf-8") for p in sorted((tmp_path / "out").glob("part-*")))
    assert [json.loads(x) for x in text.splitlines()] == [{"k": 1, "t": "ü\n\"x\""}, {"k": 2, "t": None}] and "ü" in text


def test_lexicon_file(spark, tmp_path):
    held = {"version": "1", "categories": {"modality": {"classifications": {"obligation": ["shall", "must"], "permission": ["may"]}, "note": 1}, "condition": {"markers": ["if"]}, "empty": {"markers": []}}}
    (tmp_path / "lexicon.json").write_text(json.dumps(held, indent=2))
    got = {(r.category, r.klass, r.marker) for r in jsonl.lexicon_rows(spark, f"file://{tmp_path}/lexicon.json").collect()}
    assert got == {("modality", "obligation", "shall"), ("modality", "obligation", "must"), ("modality", "permission", "may"), ("condition", None, "if")}
    root = spark.read.text(f"file://{tmp_path}/lexicon.json", wholetext=True).limit(0)
    assert jsonl.lexicon_entries(root).count() == 0


def test_committed_runs(spark, tmp_path):
    import shutil

    import pytest

    from statuta.sources import committed

    path, schema = f"file://{tmp_path}/t", "id long, s string"
    with pytest.raises(FileNotFoundError):
        committed.read(spark, path, schema)
    first = spark.createDataFrame([(1, "ü\n#"), (2, None), (None, "")], schema).repartition(2)
    run = committed.write(first, path)
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(committed.read(spark, path, schema)) == rows(first)
    # a run without its manifest, one whose manifest broke off, and a stray file beside those of the first
    shutil.copytree(tmp_path / f"t/data-{run}", tmp_path / "t/data-9")
    (tmp_path / "t/manifest-9").mkdir()
    (tmp_path / f"t/data-{run}/part-stray.txt").write_text('{"id": 9, "s": "stray"}\n')
    assert committed.runs(spark, path) == [run] and rows(committed.read(spark, path, schema)) == rows(first)
    second = committed.write(spark.createDataFrame([(7, "x")], schema), path)
    assert [r.id for r in committed.read(spark, path, schema).collect()] == [7]
    assert rows(committed.read(spark, path, schema, run)) == rows(first)
    assert {r.ok for r in committed.verify(spark, path).collect()} == {True} == {r.ok for r in committed.verify(spark, path, run).collect()}
    part = next(p for p in (tmp_path / f"t/data-{second}").glob("part-*") if p.stat().st_size)
    (part.parent / f".{part.name}.crc").unlink()
    part.write_text('{"id":8,"s":"x"}\n')
    assert {r.ok for r in committed.verify(spark, path).collect()} == {False}
    committed.write(spark.createDataFrame([], schema), path)
    assert committed.read(spark, path, schema).count() == 0


def test_model_files(spark, tmp_path):
    from statuta.operators import process as K
    from statuta.sources import models

    body = '<startEvent id="s" name="go"/><task id="t1" name="Ärzte fragen"/><userTask id="t2"/><sequenceFlow id="f" sourceRef="s" targetRef="t1"/><laneSet><lane id="l" name="L"><flowNodeRef>t1</flowNodeRef><flowNodeRef>t2</flowNodeRef></lane></laneSet>'
    texts = {
        "plain": f'<definitions><process id="p1">{body}</process></definitions>',
        "prefixed": f'<?xml version="1.0" encoding="UTF-8"?>\n<b:definitions xmlns:b="urn:x">\n<b:process id="p2">{body.replace("<", "<b:").replace("<b:/", "</b:")}</b:process><b:process id="p3"/></b:definitions>',
        "cut": f'<definitions><process id="p4">{body}', "no": "plain text", "other": "<other/>", "unnamed": '<definitions><process id="p5"/><process name="x"/></definitions>', "blank": " \n",
    }
    for name, text in texts.items():
        (tmp_path / f"{name}.bpmn").write_text(text)
    good, apart = models.read_models(spark, f"file://{tmp_path}")
    good = good.cache()
    assert sorted((r.p._id, r.file.rsplit("/")[-1]) for r in good.collect()) == [("p1", "plain.bpmn"), ("p2", "prefixed.bpmn"), ("p3", "prefixed.bpmn")]
    assert {(r.file.rsplit("/")[-1].split(".")[0], r.reason) for r in apart.collect()} == {("cut", "not_well_formed"), ("no", "not_well_formed"), ("other", "no_process"), ("unnamed", "process_without_id"), ("blank", "empty")}
    assert sorted((r.process_id, r.node_id, r.name, r.kind) for r in K.activities(good).collect() if r.process_id == "p2") == [("p2", "t1", "Ärzte fragen", "task"), ("p2", "t2", None, "userTask")]
    assert {(r.process_id, r.source, r.target) for r in K.flows(good).collect()} == {("p1", "s", "t1"), ("p2", "s", "t1")}
    assert sorted((r.process_id, r.node_id) for r in K.lanes(good).collect()) == [("p1", "t1"), ("p1", "t2"), ("p2", "t1"), ("p2", "t2")]
