"""Stage runs: what is committed, gates, changed files, isolation, later stages."""

import json

import pytest
from pyspark.sql import functions as F

from concord.operators import audit
from concord.sources import stages


def run(spark, root, name, ok=True, gate="metric", run_id="r1", **how):
    stage = stages.Stage(spark, root, run_id, "task1", name, **how)
    stage.table(spark.range(5).withColumn("v", F.col("id") * 2), "t", ["id"], ["v"], "group", "unit")
    stage.check(audit.Assertion("sound", ok, "said", () if ok else ({"row": 3},), gate))
    stage.commit({"k": 1}, {"rows": 5})
    return stage


def test_committed_files(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    stage = run(spark, root, "S1", ok=False, inputs=[f"{tmp_path}/data/x.csv"], allowed=[f"file:{tmp_path}/data"])
    folder = tmp_path / "runs/r1/S1"
    said = json.loads((folder / "audit_assertions.json").read_text())
    assert said["gates"]["metric"] == {"pass": False, "assertions": ["sound"]} and said["gates"]["leakage"] == {"pass": True, "assertions": ["stage_output_routing", "input_path_isolation"]}
    assert {r["name"]: r["pass"] for r in said["assertions"]} == {"global_seed": True, "sound": False, "stage_output_routing": True, "input_path_isolation": True}
    assert json.loads((folder / "run_manifest.json").read_text())["summary"] == {"rows": 5}
    assert json.loads((folder / "t.parquet.manifest.json").read_text())["primary_key_fields"] == ["id"]
    listed = {f["relative_path"] for f in json.loads((folder / "manifest.json").read_text())["files"]}
    assert {"audit_assertions.json", "run_manifest.json", "t.parquet.manifest.json"} < listed and any(x.startswith("t.parquet/part-") for x in listed)
    assert stages.changed(spark, stage.folder).count() == 0
    assert [tuple(r) for r in stages.assertions(spark, root).where("NOT pass").select("run_id", "stage_name", "gate", "name", "counterexamples").collect()] == [("r1", "S1", "metric", "sound", ['{"row": 3}'])]


def test_only_sound_stages_are_admitted(spark, tmp_path):
    root = str(tmp_path / "runs")
    for name, how in {"S1": {}, "S2": {"ok": False}, "S3": {"ok": False, "gate": "input"}, "S4": {}, "S5": {}, "S6": {}}.items():
        run(spark, root, name, **how)
    run(spark, root, "S1", run_id="r2")
    part = next((tmp_path / "runs/r1/S4/t.parquet").glob("part-*"))
    part.write_bytes(part.read_bytes() + b"x")
    part.with_name(f".{part.name}.crc").unlink()  # the local file system's own checksum would tell first
    (tmp_path / "runs/r1/S5/added.txt").write_text("new")
    (tmp_path / "runs/r1/S6/manifest.json").unlink()  # as if it had not ended
    got = {(r["run_id"], r["stage_name"]): r["refused"] for r in stages.registry(spark, root).collect()}
    assert got == {("r1", "S1"): None, ("r2", "S1"): None, ("r1", "S2"): "gate metric: sound", ("r1", "S3"): "gate input: sound", ("r1", "S4"): f"file: t.parquet/{part.name}", ("r1", "S5"): "file: added.txt"}
    assert [tuple(r) for r in stages.changed(spark, f"{root}/r1/S5").collect()] == [("added.txt", "new")]
    assert {r["what"] for r in stages.changed(spark, f"{root}/r1/S4").collect()} == {"changed"}
    assert stages.required(spark, root, "r1", ["S1"]) == [f"{root}/r1/S1"]
    for bad in ("S2", "S4", "S6", "S9"):
        with pytest.raises(audit.AuditError, match=bad) as e:
            stages.required(spark, root, "r1", ["S1", bad])
        assert e.value.code == 5


def test_isolation_and_routing_are_fatal(spark, tmp_path):
    root = str(tmp_path / "runs")
    with pytest.raises(audit.AuditError) as e:
        run(spark, root, "S1", data_root=f"{tmp_path}/data/../other", expected_root=f"{tmp_path}/data")
    assert e.value.code == 4 and not (tmp_path / "runs").exists()
    with pytest.raises(audit.AuditError) as e:
        run(spark, root, "S1", seed=1)
    assert e.value.code == 3
    with pytest.raises(audit.AuditError) as e:
        run(spark, root, "S2", inputs=["/etc/passwd", f"{tmp_path}/data-2/x"], allowed=[f"{tmp_path}/data"], data_root=f"{tmp_path}/x/../data/", expected_root=f"{tmp_path}/data")
    assert e.value.code == 16
    stage = stages.Stage(spark, root, "r1", "task1", "S3")
    stage.table(spark.range(1), "t", ["id"], [], path=f"{tmp_path}/elsewhere")
    with pytest.raises(audit.AuditError) as e:
        stage.commit()
    assert e.value.code == 14
    # what went wrong is on record, and refused
    assert {r["stage_name"]: r["refused"] for r in stages.registry(spark, root).collect()} == {"S2": "gate leakage: input_path_isolation", "S3": "gate leakage: stage_output_routing"}


def test_paths():
    assert stages.plain("file:///a/./b//c/../d/") == "/a/b/d" and stages.plain("s3://b/x/../y") == "s3://b/y"
    assert stages.under("/a/b", ["/a"]) and not stages.under("/ab", ["/a"]) and stages.under("file:/a", ["/a/"])
