"""The engine from files to results: OCR, seals, caches, errors, metrics, the command line."""

import json
import struct

import numpy as np
import pytest
from fixtures import doc, docx, pdf, png, xls, xlsx, zipped
from pyspark.sql import functions as F

from docweave import config as cfg
from docweave.config import resolve
from docweave.errors import ConfigInvalid, DocweaveError
from docweave.functions import jsonfix, text, vendor
from docweave.operators import external, layout
from docweave.plans import cli, result
from docweave.plans.engine import DocEngine
from docweave.sources import images, scan, xls as xls_

PAGES = ["Hello world on page 1. More text (in brackets).", "", "Final page of the document."]
SEALED = "Paid 【印章:ACME | 红色 | 圆形】 by 【签名:J. Doe】"


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("inputs")
    (d / "a.pdf").write_bytes(pdf(PAGES))
    (d / "b.xlsx").write_bytes(xlsx({"Data": [["name", "amount"], ["A", 100]], "None": []}, {"Data": ["A1:B1"]}))
    (d / "c.docx").write_bytes(docx(["One", "Two " * 2000], [png(4, 4), png(5, 5)]))
    (d / "d.zip").write_bytes(zipped({"z.md": "# inside", "n.pdf": pdf(["text in an archive, long enough"]), "deep/o.zip": zipped({}), "x.bin": "?"}))
    (d / "e.png").write_bytes(png(64, 32))
    (d / "f.doc").write_bytes(doc(["Old words", "of a letter"]))
    (d / "g.xls").write_bytes(xls({"Alt": [["k", 1], ["l", 2.5]]}))
    (d / "h.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Type /Catalog /Pages 2 0 R >>\nendobj\ntrailer << /Encrypt 3 0 R >>")
    (d / "i.pdf").write_bytes(b"nothing")
    (d / "j.zip").write_bytes(zipped({"../x.md": "y", "ok.md": "z"}))
    return d


def by_name(rows):
    return {r["path"].rpartition("/")[2]: r for r in rows}


@pytest.fixture(scope="module")
def found(spark, folder):
    engine = DocEngine(spark, resolve({}), ocr=external.MockOcr(reply=SEALED))
    return by_name(engine.results([str(p) for p in sorted(folder.iterdir())] + [str(folder / "no.pdf")]).collect())


def test_results_of_pages(found):
    r = found["a.pdf"]
    assert [(p["page_no"], p["text"]) for p in r["raw"]["pages"]] == [(1, PAGES[0]), (2, SEALED), (3, PAGES[2])]
    assert [s["seal_id"] for s in r["raw"]["seals"]] == ["seal-p1-1", "seal-p2-1", "seal-p3-1"] and r["raw"]["signatures"][0]["signer"] == "J. Doe"
    assert r["raw"]["full_text"].startswith(f"--- Page 1 ---\n{PAGES[0]}\n\n--- Page 2 ---\n")
    assert (r["source"]["page_count"], r["source"]["pages_included"], r["source"]["truncated"], r["source"]["file_format"]) == (3, [1, 2, 3], False, "pdf")
    m = r["metrics"]
    assert m["performance"]["images"] == 3 and m["quality"]["seals"] == 3 and m["quality"]["ocr_chars"] == len(r["raw"]["full_text"])
    assert {k: v["calls"] for k, v in m["cost"]["calls_by_model"].items()} == {"mock-ocr": 3} and 1 <= m["performance"]["ocr_concurrency_peak"] <= 3


def test_results_of_sheets(found):
    r = found["b.xlsx"]
    assert r["source"]["sheet_names"] == ["Data", "None"] and r["raw"]["sheets"][0]["merged_ranges"] == ["A1:B1"] and r["raw"]["sheets"][1]["cells"] == []
    assert r["markdown"] == "# b.xlsx\n\n## Data\n\n| A | B |\n| --- | --- |\n| name | amount |\n| A | 100 |\n\n## None\n\n_(empty)_\n"
    assert r["raw"]["full_text"] == "Data!A1: name\nData!B1: amount\nData!A2: A\nData!B2: 100"
    assert "| k | 1 |\n| l | 2.5 |" in found["g.xls"]["markdown"] and found["g.xls"]["source"]["file_format"] == "xls"


def test_results_of_documents(found):
    r = found["c.docx"]
    assert r["source"]["truncated"] and r["source"]["page_count"] == 17 and [s["section_id"] for s in r["raw"]["sections"]][:2] == ["p-1", "p-2"]
    assert [(s["seal_id"], s["section_id"], s["locator_kind"]) for s in r["raw"]["seals"]] == [("seal-docx-img1-1", "embedded-img-1", "image-bbox"), ("seal-docx-img2-2", "embedded-img-2", "image-bbox")]
    assert [s["signature_id"] for s in r["raw"]["signatures"]] == ["sig-docx-img1-1", "sig-docx-img2-2"]
    assert found["f.doc"]["markdown"] == "# f.doc\n\nOld words\n\nof a letter\n"


def test_results_of_images(found):
    r = found["e.png"]
    assert r["markdown"] == f"# e.png\n\n## Page 1\n\n{SEALED}\n" and r["raw"]["seals"][0]["seal_id"] == "seal-1-1" and r["raw"]["seals"][0]["page_no"] == 1 and r["source"]["page_count"] is None


def test_results_of_archives_and_errors(found):
    assert found["d.zip!z.md"]["markdown"] == "# inside" and found["d.zip!n.pdf"]["ok"]
    assert {k: r["error_code"] for k, r in found.items() if not r["ok"]} == {
        "h.pdf": "ERR_PROTECTED_FILE", "i.pdf": None, "j.zip": "ERR_UNSUPPORTED_FORMAT", "no.pdf": "ERR_FILE_NOT_FOUND", "o.zip": "ERR_UNSUPPORTED_FORMAT", "d.zip!x.bin": "ERR_UNSUPPORTED_FORMAT",
    }
    assert "NoPdf" in found["i.pdf"]["error_message"] and found["i.pdf"]["markdown"] is None


def test_without_seals(spark, folder):
    engine = DocEngine(spark, resolve({}), ocr=external.MockOcr(reply=SEALED))
    r = engine.results([str(folder / "a.pdf")], detect=False).first()
    assert r["raw"]["seals"] is None and r["metrics"]["performance"]["images"] == 1


def test_page_limits(spark, tmp_path):
    (tmp_path / "long.pdf").write_bytes(pdf([f"page {k} has enough of text" for k in range(1, 16)]))
    engine = DocEngine(spark, resolve({}, max_pages=4, head_ratio=1, tail_ratio=1))
    r = engine.results([str(tmp_path / "long.pdf")], detect=False).first()
    assert r["source"]["pages_included"] == [1, 2, 14, 15] and r["source"]["truncated"] and r["source"]["page_count"] == 15
    assert engine.results([str(tmp_path / "long.pdf")], full_pages=True, detect=False).first()["source"]["pages_included"] == list(range(1, 16))


class Failing:
    model, provider = "broken", "openai-compat"

    def recognize(self, image, mime="", detect=False):
        raise external.CallError("bad request", 400)


def test_a_failing_page_fails_its_file(spark, folder):
    found = by_name(DocEngine(spark, resolve({}), ocr=Failing()).results([str(folder / "a.pdf"), str(folder / "b.xlsx")], detect=False).collect())
    assert (found["a.pdf"]["ok"], found["a.pdf"]["error_code"]) == (False, "ERR_OCR_FAILED") and "bad request" in found["a.pdf"]["error_message"] and found["b.xlsx"]["ok"]


def test_failures_are_not_kept(spark, folder, tmp_path):
    config = resolve({}, cache_dir=str(tmp_path))
    paths = [str(folder / "a.pdf"), str(folder / "f.doc")]
    first = by_name(DocEngine(spark, config, ocr=Failing()).results(paths, detect=False).collect())
    second = by_name(DocEngine(spark, config).results(paths, detect=False).collect())
    assert not first["a.pdf"]["ok"] and second["a.pdf"]["ok"]
    assert [second[n]["metrics"]["performance"]["cache_hit"] for n in ("a.pdf", "f.doc")] == [False, True]
    # What a call asks for belongs to the key.
    third = by_name(DocEngine(spark, config).results(paths, full_pages=True, detect=False).collect())
    assert not third["f.doc"]["metrics"]["performance"]["cache_hit"]
    forced = by_name(DocEngine(spark, config).results(paths, detect=False, force=True).collect())
    assert not forced["f.doc"]["metrics"]["performance"]["cache_hit"]


def test_a_hit_has_this_name(spark, tmp_path):
    config = resolve({}, cache_dir=str(tmp_path / "cache"))
    for name in ("one.docx", "two.docx"):
        (tmp_path / name).write_bytes(docx(["Same"]))
        r = DocEngine(spark, config).results([str(tmp_path / name)]).first()
        assert r["source"]["file_name"] == name and r["markdown"] == f"# {name}\n\nSame\n" and r["metrics"]["performance"]["cache_hit"] == (name == "two.docx")


def test_a_cache_that_cannot_be_written(spark, folder, tmp_path):
    (tmp_path / "file").write_text("no folder")
    r = DocEngine(spark, resolve({}, cache_dir=str(tmp_path / "file"))).results([str(folder / "f.doc")]).first()
    assert r["ok"] and r["warnings"] == ["cache-write-failed"] and r["metrics"]["quality"]["warnings"] == 1


class Says:
    model, provider = "says", "x"

    def __init__(self, reply):
        self.reply = reply

    def extract(self, prompt, **request):
        return {"text": self.reply or json.dumps(request), "prompt_tokens": 1000, "completion_tokens": 10}


def test_results_with_a_prompt(spark, folder):
    prompt = cfg.parse_prompt("---\nname: contract\nmodel: qwen-plus\nschemaVersion: 2\n---\nAsk.")
    r = DocEngine(spark, resolve({}), llm=Says(None)).results([str(folder / "f.doc")], prompt).first()
    assert json.loads(r["extracted"]) == {"temperature": 0.1, "enable_thinking": False, "system": "Ask.", "model": "qwen-plus"}
    assert r["metrics"]["quality"]["field_count"] == 4 and r["metrics"]["cost"]["calls_by_model"]["qwen-plus"]["prompt_tokens"] == 1000 and r["metrics"]["cost"]["total_yuan"] == pytest.approx(0.0008)
    r = DocEngine(spark, resolve({}), llm=Says("no object")).results([str(folder / "f.doc")], prompt).first()
    assert json.loads(r["extracted"]) == {"text": "no object"} and r["warnings"] == ["llm-json-parse-failed-fallback-to-text"]


def test_structured(spark):
    engine = DocEngine(spark, resolve({}, max_input_chars=1500), llm=Says('{"b":1,"a":[1]}'))
    out = engine.structured([(f"s{k}", "x" * 1000) for k in range(3)])
    assert out["extracted"] == {"b": 1, "a": [1]} and [b["sources"] for b in out["batches"]] == [1, 1, 1] and out["tokenUsage"] == {"prompt": 3000, "completion": 30}
    assert out["warnings"] == ["input split into 3 batches (maxInputChars=1500)"] and out["promptName"] == "default-structure"
    none = DocEngine(spark, resolve({}), llm=Says("prose")).structured([], cfg.parse_prompt("Ask."))
    assert len(none["batches"]) == 1 and none["batches"][0]["parseFailed"] and none["extracted"] == {"text": "prose"} and none["promptName"] == "custom"

    class Down(Says):
        def extract(self, prompt, **request):
            raise external.CallError("gone", 400)

    with pytest.raises(DocweaveError):
        DocEngine(spark, resolve({}), llm=Down("")).structured([("s", "x")])


# Backends.


def test_providers():
    api = resolve({}, mode="api", base_url="https://example.test/v1", api_key="k1")
    assert (api.ocr_provider, api.llm_provider, api.parser_version.split("-")[0]) == ("openai-compat", "chat", "api")
    assert cfg.ocr_backend(api).model == "qwen-vl-ocr-latest" and cfg.vision_backend(api).model == "qwen-vl-max" and cfg.llm_backend(api).model == "qwen3.6-plus"
    assert cfg.ocr_backend(api).body(b"x", "image/png", True)["enable_thinking"] is False
    seen = resolve({"DOCWEAVE_VISION_MODEL": "v"}, mode="api", base_url="u", api_key="k")
    assert (seen.ocr_model, seen.vision_model) == ("v", "v")
    cloud = resolve({}, ocr_provider="aliyun-ocr", aliyun_access_key_id="i", aliyun_access_key_secret="s", aliyun_ocr_endpoint="https://ocr.test/")
    assert cfg.ocr_backend(cloud).endpoint == "ocr.test" and cfg.vision_backend(cloud).provider == "aliyun-ocr"
    both = resolve({}, ocr_provider="aliyun-ocr", aliyun_access_key_id="i", aliyun_access_key_secret="s", base_url="u", api_key="k")
    assert cfg.vision_backend(both).provider == "openai-compat"
    assert cfg.vision_backend(resolve({})).model == "mock-vision"


@pytest.mark.parametrize("given", [{"mode": "api"}, {"ocr_provider": "aliyun-ocr", "aliyun_access_key_id": "hidden-id"}, {"ocr_provider": "nobody"}, {"max_pages": 0}, {"temperature": 3.0}, {"mode": "test"}, {"max_input_chars": True}])
def test_bad_settings(given):
    with pytest.raises(ConfigInvalid) as e:
        resolve({}, **given)
    assert "hidden" not in str(e.value)


def test_presets():
    made = external.preset("qwen-vision", "key")
    assert made.model == "qwen-vl-max" and made.url == external.QWEN_URL and external.preset("openai-llm", "key", model="m").model == "m"
    with pytest.raises(ConfigInvalid):
        external.preset("nobody", "key")


def test_chat_ocr_request():
    body = external.ChatOcr("http://x", "k", "m", extra={"enable_thinking": False}).body(b"img", "image/png", True)
    assert body["messages"][1]["content"][1]["image_url"]["url"] == "data:image/png;base64,aW1n" and "【印章" in body["messages"][0]["content"] and body["temperature"] == 0 and body["enable_thinking"] is False
    assert "【印章" not in external.ChatOcr("http://x", "k", "m").body(b"img", "image/png", False)["messages"][0]["content"]
    with pytest.raises(external.CallError):
        external.ChatOcr("http://x", "k", "m").recognize(None)
    body = external.ChatLlm("http://x", "k", "m").body("p", enable_thinking=False, model="other", system="s")
    assert body["enable_thinking"] is False and body["model"] == "other" and body["messages"][0] == {"role": "system", "content": "s"}


class Cloud:
    def __init__(self, reply):
        self.reply, self.asked = reply, []

    def recognize(self, image, options):
        self.asked.append(options)
        if isinstance(self.reply, Exception):
            raise self.reply
        return self.reply


def test_cloud_ocr():
    client = Cloud("{}")
    assert external.CloudOcr("i", "s", client=client).recognize(b"x")["reply"] == "{}" and client.asked == [{"output_table": True, "need_rotate": True}]

    class Denied(Exception):
        code, status_code, message = "Forbidden", 403, "no access"

    with pytest.raises(external.CallError) as e:
        external.CloudOcr("i", "s", client=Cloud(Denied("key s"))).recognize(b"x")
    assert str(e.value) == "Forbidden 403 no access" and not external.is_retryable(e.value)
    with pytest.raises(ConfigInvalid):  # without the optional package
        external.CloudOcr("i", "s").recognize(b"x")
    assert "secret" not in repr(external.CloudOcr("i", "secret"))


def test_pages_read_by_the_cloud(spark, tmp_path):
    (tmp_path / "s.pdf").write_bytes(pdf(["", "", "long enough to be left alone"], images={0: b"\xff\xd8jpeg\xff\xd9"}))
    reply = json.dumps({"Data": json.dumps({"prism_wordsInfo": [{"word": "合同", "pos": [{"x": 0, "y": 0}, {"x": 40, "y": 12}], "prob": 99}, {"word": "", "pos": []}, {"word": "a", "position": {"x": 0, "y": 30, "width": 20, "height": 12}}, {"text": "b", "points": [[100, 30], [120, 42]]}]})})
    ocr = external.CloudOcr("i", "s", client=Cloud(reply))

    class NoImage(external.CloudOcr):
        def recognize(self, image, mime="", detect=False):
            return super().recognize(image or b"drawn", mime, detect)

    r = DocEngine(spark, resolve({}), ocr=NoImage("i", "s", client=Cloud(reply)), vision=ocr).results([str(tmp_path / "s.pdf")], detect=False).first()
    assert r["ok"], r["error_message"]
    assert [p["text"] for p in r["raw"]["pages"]] == ["## 合同\n\na b", "## 合同\n\na b", "long enough to be left alone"]
    assert [(b["block_id"], b["text"], b["bbox"], b["confidence"]) for b in r["raw"]["pages"][1]["blocks"]] == [("p2-aliyun-1", "合同", [0, 0, 40, 12], 0.99), ("p2-aliyun-3", "a", [0, 30, 20, 12], None), ("p2-aliyun-4", "b", [100, 30, 20, 12], None)]
    # A page without a picture cannot be sent.
    r = DocEngine(spark, resolve({}), ocr=ocr, vision=ocr).results([str(tmp_path / "s.pdf")], detect=False).first()
    assert r["error_code"] == "ERR_OCR_FAILED" and "no image" in r["error_message"]


def test_seal_detector(spark):
    rows = spark.createDataFrame([(1, b"x", "image/png")], "id int, image binary, mime string")
    r = external.seal_detector(rows, external.MockOcr(reply=f"```\n{SEALED}\n```"), ["id"]).first()
    assert r["seals"][0]["owner"] == "ACME" and r["signatures"][0]["signer"] == "J. Doe" and r["ocr_error"] is None


@pytest.mark.parametrize("raw, want", [("  x ", "x"), ('{"text":" y "}', "y"), ('```json\n{"text":"z"}\n```', "z"), ('{"text":5}', '{"text":5}'), ('{"other":"x"}', '{"other":"x"}'), ('{"text":"a', '{"text":"a'), ("", "")])
def test_envelope(spark, raw, want):
    assert value(spark, text.peel_envelope(F.lit(raw))) == want


@pytest.mark.parametrize("reply, want", [
    ('{"Data": "plain words\\n\\nof | a page"}', "plain words\nof \\| a page"), ('{"body": {"data": {"content": "c"}}}', "c"), ("{}", ""), ("no json", ""), ('{"Data": {"prism_rowsInfo": [{"word": "r1"}, {"text": "r2"}]}}', "r1\nr2"),
    ('{"Data": {"prism_paragraphsInfo": [{"word": "p1"}], "prism_rowsInfo": [{"word": "r1"}], "subImages": [{"paragraphInfo": {"paragraphDetails": [{"paragraphContent": "p2"}]}}]}}', "p1\n\np2"),
    ('{"Data": {"prism_tablesInfo": [{"cellInfos": [{"word": "h", "ysc": 0, "xsc": 0}, {"word": "v", "ysc": 2, "xsc": 1}, {"word": "old", "ysc": 2, "xsc": 0}, {"word": "", "ysc": 2, "xsc": 0}]}]}}', "| h | Column 2 |\n| --- | --- |\n|  | v |"),
    ('{"Data": {"prism_wordsInfo": [{"word": "un|boxed"}, {"word": "two"}]}}', "un\\|boxed\ntwo"),
])
def test_vendor_texts(spark, reply, want):
    rows = spark.createDataFrame([(1, reply)], "k int, reply string")
    assert layout.vendor_pages(rows, ["k"]).first()["text"] == want


def test_vendor_data_that_is_no_object(spark):
    assert value(spark, vendor.reply_data(F.lit('{"Data":"{broken"}')))["content"] == "{broken"


@pytest.mark.parametrize("raw, want", [
    ("{“a”: ‘x’}", {"a": "x"}), ('{"a": "it\'s // no comment", // but this\n "b": 2,}', {"a": "it's // no comment", "b": 2}), ("{a: 1, /* gone */ b_c: [1, 2, ], }", {"a": 1, "b_c": [1, 2]}), ("{'q': 'say \"hi\"', t: true}", {"q": 'say "hi"', "t": True}),
    ('{"k": "a, b: c", "l": null}', {"k": "a, b: c", "l": None}), ("{'it\\'s': 1}", {"it's": 1}),
])
def test_repairs(raw, want):
    assert json.loads(jsonfix.repaired(raw)) == want


# Formats.


def test_json_schema():
    s = result.json_schema()
    assert s["properties"]["schema_version"]["const"] == "1.0" and s["properties"]["source"]["properties"]["file_format"]["enum"] == list(result.FORMATS) and "raw" in s["required"]
    assert s["properties"]["metrics"]["properties"]["cost"]["properties"]["calls_by_model"]["additionalProperties"]["properties"]["calls"] == {"type": "integer"}


@pytest.mark.parametrize("turn", range(1, 9))
def test_images_are_turned(turn):
    upright = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    # How a camera stores the upright picture under each orientation.
    kept = {1: upright, 2: upright[:, ::-1], 3: upright[::-1, ::-1], 4: upright[::-1], 5: upright.transpose(1, 0, 2), 6: np.rot90(upright), 7: np.rot90(upright, 2).transpose(1, 0, 2), 8: np.rot90(upright, -1)}[turn]
    assert (images.turned(kept, turn) == upright).all()


def test_images_are_shrunk():
    pixels = np.random.default_rng(0).integers(0, 255, (40, 100, 3)).astype(np.uint8)
    sent, mime = images.prepared(png(100, 40, pixels.tobytes()), 50)
    assert images.size(sent) == (50, 20, 1) and mime == "image/png"
    assert (images.png_pixels(sent) == np.floor(pixels.astype(float).reshape(20, 2, 50, 2, 3).mean(axis=(1, 3)) + 0.5)).all()
    same = png(10, 10)
    assert images.prepared(same, 50) == (same, "image/png") and images.prepared(b"\xff\xd8\xff\xc0\0\x11\x08\0\x0a\0\x14" + bytes(20), 5)[1] == "image/jpeg"


@pytest.mark.parametrize("kind", [1, 2, 3, 4])
def test_png_filters(kind):
    import zlib

    pixels = np.random.default_rng(kind).integers(0, 255, (5, 4, 3)).astype(np.uint8)
    flat, above, lines = pixels.reshape(5, 12).astype(int), np.zeros(12, int), b""
    for row in flat:
        left, corner = np.r_[np.zeros(3, int), row[:-3]], np.r_[np.zeros(3, int), above[:-3]]
        near = [min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2] for a, b, c in zip(left, above, corner, strict=True)]
        lines += bytes([kind]) + ((row - {1: left, 2: above, 3: (left + above) // 2, 4: np.array(near)}[kind]) & 255).astype(np.uint8).tobytes()
        above = row
    head = png(4, 5)
    at = head.index(b"IDAT")
    made = head[: at - 4] + struct.pack(">I", len(d := zlib.compress(lines))) + b"IDAT" + d + bytes(4) + head[head.index(b"IEND") - 4 :]
    assert (images.png_pixels(made) == pixels).all()


def test_legacy_workbooks():
    book = xls({"Daten": [["ä" * 300, True], [None, -3], [2.5, "x"]], "Zwei": [[k for k in range(40)]]}, {"Daten": [(0, 1, 0, 2)]})
    assert [(c.sheet, c.ref, c.kind, c.text) for c in xls_.cells(book)][:5] == [("Daten", "A1", "string", "ä" * 300), ("Daten", "B1", "boolean", "true"), ("Daten", "B2", "number", "-3"), ("Daten", "A3", "number", "2.5"), ("Daten", "B3", "string", "x")]
    assert list(xls_.merged_ranges(book)) == [("Daten", "A1:C2")] and list(xls_.cells(book))[-1].ref == "AN1"
    # A string that goes on in the next record says its width anew.
    blocks = [struct.pack("<II", 2, 2) + struct.pack("<HB", 6, 0) + b"abc", b"\x01" + "déf".encode("utf-16-le") + struct.pack("<HB", 1, 1) + "z".encode("utf-16-le")]
    assert list(xls_.shared_strings(blocks)) == ["abcdéf", "z"]
    assert (xls_._rk(100 << 2 | 3), xls_._rk((-5 << 2 | 2) & 0xFFFFFFFF), xls_._rk(struct.unpack("<Q", struct.pack("<d", 1.5))[0] >> 32)) == (1.0, -5.0, 1.5)


def test_a_broken_file_has_only_its_error():
    rows = list(scan.parse_one("x/a.xls", b"no"))
    assert len(rows) == 1 and rows[0][1] == "error" and rows[0][-2] is None


# The command line.


@pytest.fixture
def run(spark, capsys):
    def call(*args):
        code = cli.main(list(map(str, args)))
        return code, json.loads(capsys.readouterr().out)

    return call


def test_cli_extract(run, folder, tmp_path):
    code, out = run("extract", folder / "f.doc", folder / "d.zip", folder / "j.zip", folder / "a.pdf", folder / "no.pdf", folder / "no.zip", "--out", tmp_path / "md", "--results", tmp_path / "json")
    shown = [(i["path"].rpartition("/")[2], i["ok"]) for i in out["items"]]
    assert shown == [("f.doc", True), ("d.zip!n.pdf", True), ("d.zip!z.md", True), ("j.zip", False), ("a.pdf", True), ("no.pdf", False), ("no.zip", False)]
    assert (code, out["total"], out["ok"], out["failed"]) == (3, 7, 4, 3) and out["items"][2]["message"] == "Already a text file" and out["items"][5]["code"] == "ERR_FILE_NOT_FOUND"
    assert sorted(p.name for p in (tmp_path / "md").iterdir() if not p.name.startswith(".")) == ["a.md", "f.md", "n.md"]
    assert (tmp_path / "md" / "f.md").read_text() == "# f.doc\n\nOld words\n\nof a letter\n"
    assert [(a["expanded"], a["passthrough"], len(a["warnings"])) for a in out["archives"]] == [(1, 1, 1)]
    kept = json.loads((tmp_path / "json" / "f.doc.parsed.json").read_text())
    assert kept["source"]["file_name"] == "f.doc" and kept["schema_version"] == "1.0" and "extracted" not in kept


def test_cli_writes_beside_its_inputs(run, tmp_path):
    for name in ("x/a.doc", "y/a.doc"):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_bytes(doc([name]))
    code, out = run("extract", tmp_path / "x/a.doc", tmp_path / "y/a.doc")
    assert code == 0 and (tmp_path / "x/a.md").read_text() == "# a.doc\n\nx/a.doc\n" and (tmp_path / "y/a.md").exists()
    run("extract", tmp_path / "x/a.doc", tmp_path / "y/a.doc", "--out", tmp_path / "both")
    assert (tmp_path / "both/a.md").read_text().endswith("x/a.doc\n") and (tmp_path / "both/a.2.md").read_text().endswith("y/a.doc\n")


def test_cli_structure(run, folder, tmp_path):
    (tmp_path / "p.prompt.md").write_text("---\nname: contract\n---\nAsk.")
    code, out = run("structure", folder / "f.doc", folder / "d.zip", folder / "i.pdf", "--prompt", tmp_path / "p.prompt.md")
    assert code == 3 and out["extracted"] == {"mockField": "mock"} and out["promptName"] == "contract"
    assert [(i["path"].rpartition("/")[2], i["kind"]) for i in out["inputs"]] == [("f.doc", "parsed"), ("d.zip!n.pdf", "parsed"), ("d.zip!z.md", "passthrough")]
    assert out["batches"][0]["sources"] == 3 and out["parseFailures"][0]["path"].endswith("i.pdf")
    with pytest.raises(ConfigInvalid):
        run("structure", folder / "f.doc", "--prompt", "a", "--prompt-text", "b")


def test_cli_schema(run):
    assert run("schema")[1]["title"] == "ParseResult"


def test_vendor_pages_read_each_reply_once(spark):
    """No reply is read for its words and again for the rest: nothing is shuffled or joined, and a row stays a row."""
    from docweave.operators import layout

    word = lambda t, x, y: f'{{"word":"{t}","pos":[{{"x":{x},"y":{y}}},{{"x":{x + 40},"y":{y + 10}}}]}}'
    replies = [
        (1, f'{{"Data":{{"prism_wordsInfo":[{word("b", 60, 1)},{word("a", 0, 0)},{word("c", 0, 40)}]}}}}'),
        (2, '{"data":" one\\n\\ntwo "}'),
        (2, None),
        (3, '{"Data":{"prism_wordsInfo":[{"word":"x","position":{"x":1,"y":2,"width":3}},{"word":"y"}]}}'),
    ]
    found = layout.vendor_pages(spark.createDataFrame(replies, "k int, reply string"), ["k"])
    assert sorted((r["k"], r["text"]) for r in found.collect()) == [(1, "ab\nc"), (2, ""), (2, "one\ntwo"), (3, "x\ny")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert plan.count("MapInArrow") == 1


def test_page_layout_in_words_and_in_numbers(spark, monkeypatch):
    """Small pages and large ones, many words or few of them as Python values: the lines are the same, and few are held."""
    import random

    from docweave.operators import layout

    some = random.Random(5)
    pages = []
    for k in range(40):
        n = some.choice([0, 1, 3, 30, 48, 49, 200])
        pages.append((k, *([float(some.randrange(300)) for _ in range(n)] for _ in "xy"), [40.0] * n, [10.0] * n, [some.choice(["a", "bc", "d|e", "", "f g"] if k % 2 else ["a", "bc"]) for _ in range(n)]))
    want = sorted((k, no, len(line), layout.shown(line)) for k, *columns in pages for no, line in enumerate(layout.lines_of(list(zip(*columns, strict=True))), 1))
    frame = spark.createDataFrame(pages, "k int, x array<double>, y array<double>, w array<double>, h array<double>, text array<string>").coalesce(1)
    assert sorted(map(tuple, layout.page_lines(frame, ["k"]).collect())) == want
    shown = {r["k"]: r["lines"] for r in layout.with_lines(frame).collect()}
    assert shown == {k: [line for j, _, _, line in want if j == k and line] for k in range(40)}

    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "x", "y", "w", "h", "text"), p, strict=True)) for p in pages])
    monkeypatch.setattr(layout, "WORDS", 60)
    again = [(p[0], no, n, line) for p, (sizes, lines) in zip(pages, layout._laid_out(batch), strict=True) for no, (n, line) in enumerate(zip(sizes, lines, strict=True), 1)]
    assert sorted(again) == want
    part = list(layout._laid_out(batch.slice(10, 20)))
    assert [len(x) for x, _ in part] == [sum(1 for r in want if r[0] == k) for k in range(10, 30)]


def test_lines_are_given_on_in_parts(spark, monkeypatch):
    """However many pages a batch has, few lines are held: both ways out give them on in parts, with each page's other columns beside them."""
    import pyarrow as pa

    pages = []
    for k in range(60):
        n = (0, 1, 5, 2)[k % 4] if k != 30 else 60
        blocks = None if k % 6 == 5 else [{"id": None if j % 2 else f"{k}-{j}", "at": [float(k), float(j)]} for j in range(k % 3)]
        pages.append((k, f"name {k}" if k % 5 else None, blocks, [0.0] * n, [20.0 * j for j in range(n)], [40.0] * n, [10.0] * n, [f"w{k}.{j}" for j in range(n)]))
    want = [[f"w{p[0]}.{j}" for j in range(len(p[3]))] for p in pages]
    batch = pa.RecordBatch.from_pylist([dict(zip(("k", "name", "blocks", "x", "y", "w", "h", "text"), p, strict=True)) for p in pages])
    parts = list(layout._parts(batch, 7))
    assert [lines for _, part in parts for _, lines in part] == want
    assert [first for first, _ in parts] == [sum(len(part) for _, part in parts[:i]) for i in range(len(parts))]
    assert all(sum(len(lines) for _, lines in part[:-1]) < 7 for _, part in parts) and len(parts) > 10
    assert list(layout._parts(batch.slice(0, 0), 7)) == []

    frame = spark.createDataFrame(pages, "k int, name string, blocks array<struct<id: string, at: array<double>>>, x array<double>, y array<double>, w array<double>, h array<double>, text array<string>").coalesce(1)
    monkeypatch.setattr(layout, "LINES", 7)
    sent = layout.with_lines(frame).collect()
    assert sorted((r["k"], r["name"], r["blocks"] and [b.asDict() for b in r["blocks"]], r["lines"]) for r in sent) == [(p[0], p[1], p[2], lines) for p, lines in zip(pages, want, strict=True)]
    assert sorted((r["k"], r["line_no"], r["line"]) for r in layout.page_lines(frame, ["k"]).collect()) == [(k, no, line) for k, lines in enumerate(want) for no, line in enumerate(lines, 1)]


def test_files_are_dealt_over_folders_and_opened_once(spark, tmp_path):
    """Many files do not share one folder, whose lock tasks would wait for, and a name has one place; through a cache each file is opened once."""
    import os

    from docweave.config import resolve
    from docweave.plans.engine import DocEngine
    from docweave.plans.scan_queries import _texts
    from docweave.sources.scan import listed

    folders = _texts(spark, "/root/testdata/sf0.001")
    sizes = [len(os.listdir(f)) for f in folders]
    assert len(folders) == 16 and sum(sizes) == 200 and max(sizes) < 40
    assert listed(spark, *folders).rdd.getNumPartitions() == 8

    opened = str(tmp_path / "opened")

    def noted(batches):
        for batch in batches:
            with open(opened, "a") as f:
                f.writelines(f"{p}\n" for p in batch.column("path").to_pylist())
            yield batch

    engine = DocEngine(spark, resolve({}, mode="mock", cache_dir=str(tmp_path / "cache")))
    scanned = engine.scan(folders)
    for hits in (0, 200):
        open(opened, "w").close()
        found = engine.parsed(scanned.mapInArrow(noted, scanned.schema)).select("ok", "cache_hit").collect()
        assert len(found) == 200 and all(r["ok"] for r in found) and sum(r["cache_hit"] for r in found) == hits
        paths = open(opened).read().split("\n")[:-1]
        assert len(paths) == len(set(paths)) == 200


def test_rows_of_an_order_are_shuffled_once(spark):
    """Lines, words and cells of an order come together in one exchange, before they are JSON or cells."""
    from docweave.plans.all_queries import QUERIES

    for name in ("ocr_table_grid", "ocr_blocks", "ocr_vendor_pages"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan, name
