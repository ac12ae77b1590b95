"""Totals by observation, result files, kinds of images, imports that must not be hidden."""

import json
import os
import subprocess
import sys

import pytest
from fixtures import docx

from pyspark.sql import functions as F

from docweave.operators import metrics
from docweave.plans.engine import DocEngine
from docweave.plans.sinks import write_results
from docweave.sources.images import kind_of
from docweave.sources.store import stored

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("small")
    for k in range(4):
        (d / f"t{k}.md").write_text(f"text {k}")
    (d / "d.docx").write_bytes(docx(["One paragraph.", "Another."]))
    (d / "x.bin").write_bytes(b"?")
    return d


def test_totals_come_with_the_action(spark, folder):
    results, seen = metrics.observed(DocEngine(spark).results([str(folder)]))
    rows = stored(results)
    m = "metrics.performance"
    sums = rows.agg(F.count("*").alias("files"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum(f"{m}.total_ms").alias("total_ms"), F.sum(f"{m}.retries").alias("retries"), F.sum(f"{m}.images").alias("images"), F.sum("metrics.cost.total_yuan").alias("yuan")).first()
    assert seen.get == sums.asDict() and (seen.get["files"], seen.get["ok"], seen.get["failed"]) == (6, 5, 1)


def test_result_files_have_lines(spark, folder, tmp_path):
    results = DocEngine(spark).results([str(folder)]).withColumn("extracted", F.when(F.col("path").endswith("t1.md"), F.lit('{"b":1,"a":[2]}')))
    write_results(results, str(tmp_path / "out")).collect()
    texts = {p.name: p.read_text() for p in (tmp_path / "out").iterdir()}
    assert len(texts) == 5 and all(len(t.splitlines()) > 10 and json.loads(t)["schema_version"] for t in texts.values())
    assert json.loads(texts["t1.md.parsed.json"])["extracted"] == {"b": 1, "a": [2]} and "extracted" not in json.loads(texts["t2.md.parsed.json"])


@pytest.mark.parametrize("head, kind", [(b"\x89PNG\r\n", "image/png"), (b"\xff\xd8\xff\xe0", "image/jpeg"), (b"GIF89a", "image/gif"), (b"RIFF0000WEBP", "image/webp"), (b"", "image/png"), (b"II*\0", "image/tiff")])
def test_kinds(head, kind):
    assert kind_of(head) == kind


def test_missing_requirements_are_not_hidden():
    """Without the corpus folder the entry works; with a library missing it says so."""
    hide = "import sys\nclass Hide:\n    def find_spec(self, name, path=None, target=None):\n        if name == HIDDEN:\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Hide())\n"
    run = lambda hidden, code: subprocess.run([sys.executable, "-c", hide.replace("HIDDEN", repr(hidden)) + code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    good = run("docweave.llm", "import __spark_entry__ as e; print(sorted(k for k in e.queries() if k.startswith('op') or k == 'pipeline'))")
    assert good.returncode == 0 and all(not name.startswith(("op1", "op2", "pipeline")) for name in eval(good.stdout.splitlines()[-1])), good.stderr
    assert run("pyspark.sql.functions", "import __spark_entry__").returncode != 0
