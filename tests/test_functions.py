import json

import pytest
from pyspark.sql import functions as F

from docweave.config import parse_prompt, resolve
from docweave.errors import DocweaveError
from docweave.functions import files, jsonfix, numbers, text
from docweave.operators import external, layout, structure


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("n, most, ratio, want", [(0, 10, (7, 3), []), (10, 10, (7, 3), [*range(1, 11)]), (11, 10, (7, 3), [*range(1, 8), 9, 10, 11]), (30, 10, (7, 3), [*range(1, 8), 28, 29, 30]), (100, 100, (8, 2), [*range(1, 101)])])
def test_select_pages(spark, n, most, ratio, want):
    assert value(spark, files.select_pages(F.lit(n), most, ratio)) == want


def test_truncate(spark):
    out = value(spark, text.truncate(F.lit("a" * 6000)))
    assert out["truncated"] and out["original_length"] == 6000 and "\n\n[... truncated 1000 chars ...]\n\n" in out["text"]
    assert not value(spark, text.truncate(F.lit("a" * 5000)))["truncated"]


@pytest.mark.parametrize("path, want", [("a/b.PDF", "pdf"), ("x.jpeg", "jpg"), ("x.tar.xlsx", "xlsx"), (".pdf", None), ("x", None), ("x.", None), ("a.zip", None)])
def test_detect_format(spark, path, want):
    assert value(spark, files.detect_format(F.lit(path))) == want


def test_stem_and_error(spark):
    assert value(spark, files.stem(F.lit("a/b.c.pdf"))) == "b.c"
    assert value(spark, files.format_error(F.lit("x")))["message"] == "Unsupported file extension: (none)"


@pytest.mark.parametrize("n, letters", [(1, "A"), (26, "Z"), (27, "AA"), (28, "AB"), (702, "ZZ"), (703, "AAA"), (16384, "XFD")])
def test_cell_columns(spark, n, letters):
    assert value(spark, files.column_letters(F.lit(n))) == letters and value(spark, files.column_number(F.lit(letters))) == n


def test_trim_takes_all_blanks(spark):
    assert value(spark, text.trim(F.lit("﻿　 \n x y\t "))) == "x y"


def test_fence(spark):
    assert value(spark, text.strip_fence(F.lit("```markdown\n# T\n\nx\n```\n"))) == "# T\n\nx"


def test_marks(spark):
    seals = value(spark, text.seal_marks(F.lit("x 【印章:Acme Corp|红色|圆形】 y 【印章:未知|蓝】")))
    assert [(s["seal_no"], s["owner"], s["color"], s["shape"]) for s in seals] == [(1, "Acme Corp", "red", "circle"), (2, None, "blue", None)]
    assert [(s["sig_no"], s["signer"]) for s in value(spark, text.signature_marks(F.lit("【签名:John Doe】【签名:未知】")))] == [(1, "John Doe"), (2, None)]


def test_group_lines(spark):
    lines = ["", "采购合同", "First line", "goes on。", "next", "1. numbered", "• item", "after"]
    assert value(spark, text.group_lines(F.array(*map(F.lit, lines)))) == "## 采购合同\n\nFirst line\ngoes on。\n\nnext\n\n1. numbered\n- item\nafter"


def group_lines_by_loop(lines):
    out = []
    import re

    for line in lines:
        t = line.strip()
        if not t:
            continue
        if len(t) <= 40 and not re.search(text.HEADING_STOPS + r"\Z", t) and re.search(text.HEADING_NOUNS + r"\Z", t):
            out += ([""] if out and out[-1] else []) + ["## " + re.sub(r"^#+\s*", "", t), ""]
        elif re.match(text.BULLET, t):
            out.append("- " + re.sub(text.BULLET + r"\s*", "", t))
        else:
            if out and out[-1] and not re.match("## |[-*] ", out[-1]) and (re.search(text.NUMBERED, t) or re.search("[。！？!?；;：:]$", out[-1])):
                out.append("")
            out.append(t)
    return re.sub("\n{3,}", "\n\n", "\n".join(out)).strip()


def test_group_lines_like_a_loop(spark):
    from docweave.plans.all_queries import QUERIES

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["group_lines"](spark, sf).collect():
        assert r["md"] == group_lines_by_loop(["2024合同", "• item one", *texts[r["doc_id"]].split("\n")])


@pytest.mark.parametrize("raw, want", [('{"a":1}', {"a": 1}), ('```json\n{"a": 1,}\n```', {"a": 1}), ("so: {a: 'x \"y\"'} ok", {"a": 'x "y"'}), ('{"a":1} // c\n', {"a": 1}), ("[1,2,]", [1, 2]), ('{"a":1,"a":2}', {"a": 2})])
def test_parse_fixing(raw, want):
    assert jsonfix.parse_fixing(raw) == want


@pytest.mark.parametrize("raw", ["prose", "", '{"a":NaN}', "{} {}"])
def test_parse_fixing_gives_up(raw):
    with pytest.raises(ValueError):
        jsonfix.parse_fixing(raw)


def test_extracted(spark):
    assert jsonfix.extracted("hello") == ('{"text":"hello"}', True) and json.loads(jsonfix.extracted("[1]")[0]) == {"result": [1]}
    assert jsonfix.parse_lenient('x ```json {"a":1} ``` y') == {"a": 1}
    rows = spark.createDataFrame([('{"a":1}',), ('{"a":1} x',), (None,)], "s string")
    assert [r[0] for r in rows.select(jsonfix.is_json("s")).collect()] == [True, False, False]


def test_costs(spark):
    from docweave.operators.metrics import calls_by_model, total_cost

    calls = spark.createDataFrame([("qwen-vl-max", 1000, 500, 3000, 1), ("gpt-4o", 1000, 0, 0, 0), ("nobody", 9, 9, 9, 0)], "model string, prompt_tokens long, completion_tokens long, image_tokens long, retries int")
    by = {r["model"]: r for r in calls_by_model(calls).collect()}
    assert by["qwen-vl-max"]["yuan"] == pytest.approx(0.09) and by["gpt-4o"]["yuan"] == pytest.approx(0.018) and by["nobody"]["yuan"] == 0
    assert by["qwen-vl-max"]["image_tokens"] == 3000 and by["qwen-vl-max"]["retries"] == 1
    assert total_cost(calls).first()["total_yuan"] == pytest.approx(0.108)


def test_numbers(spark):
    lit = lambda x: F.lit(x).cast("double")
    assert value(spark, numbers.confidence(lit(99.0))) == 0.99 and value(spark, numbers.confidence(lit(-1.0))) == 0 and value(spark, numbers.confidence(lit(float("nan")))) is None
    assert value(spark, numbers.upper_median(F.array(*map(F.lit, (4, 1, 3, 2))))) == 3 and value(spark, numbers.upper_median(F.array().cast("array<int>"))) == 0
    assert value(spark, numbers.mean_confidence(F.array(lit(0.99), lit(0.8), F.lit(None).cast("double")))) == 0.895


@pytest.mark.parametrize("sizes, most, want", [([50_000] * 10, 500_000, [1] * 10), ([1000] * 3, 1500, [1, 2, 3]), ([600, 600], 500, [1, 2]), ([], 10, []), ([3, 3, 9, 1], 6, [1, 1, 2, 3])])
def test_batches(spark, sizes, most, want):
    assert list(structure.batch_numbers(sizes, most)) == want
    rows = spark.createDataFrame([(job, k, f"s{k}", "x" * (n // 100)) for job in ("a", "b") for k, n in enumerate(sizes)], "job string, seq int, name string, text string")
    got = structure.pack_sources(rows.repartition(3), ["job"], most // 100).orderBy("job", "seq").collect()
    assert [r["batch_no"] for r in got] == 2 * list(structure.batch_numbers([n // 100 for n in sizes], most // 100))


def test_lines_from_boxes():
    words = [(100.0, 2.0, 40.0, 10.0, "b"), (0.0, 0.0, 40.0, 10.0, "a|"), (145.0, 3.0, 40.0, 10.0, "c"), (0.0, 30.0, 40.0, 10.0, "d")]
    assert [layout.shown(x) for x in layout.lines_of(words)] == ["a\\| bc", "d"] and layout.lines_of([]) == []
    # Without a text or a box a word is in no line and moves none.
    assert layout.lines_of([*words, (0.0, 0.0, 1.0, 9000.0, ""), (None, 0.0, 1.0, 1.0, "x")]) == layout.lines_of(words)


def test_page_lines_by_hand(spark):
    """The arrays' way against the tuples' way, with ties, wide gaps, odd and missing words."""
    import numpy as np

    rng = np.random.default_rng(4)
    pages = []
    for k in range(60):
        n = int(rng.integers(0, 40))
        words = [f"w{j}" for j in range(n)]
        if k % 3 == 0 and n:
            words[0] = "a|b  c"
        if k % 5 == 0 and n > 1:
            words[1] = ""
        x, y, w, h = (rng.integers(0, m, n).astype(float).tolist() for m in (300, 60, 50, 20))
        if k % 7 == 0 and n:
            y[0] = None
        pages.append((k, x, y, w, h, words))
    frame = spark.createDataFrame(pages, "k int, x array<double>, y array<double>, w array<double>, h array<double>, text array<string>")
    got = sorted(tuple(r) for r in layout.page_lines(frame, ["k"]).collect())
    want = [(k, no, len(line), layout.shown(line)) for k, *arrays in pages for no, line in enumerate(layout.lines_of(list(zip(*arrays, strict=True))), 1)]
    assert got == want


def test_retry_and_hedge():
    calls, slept = [], []

    def fails():
        calls.append(1)
        raise external.CallError("busy", 503)

    with pytest.raises(external.CallError):
        external.retry(fails, 2, slept.append, lambda: 1.0)
    assert len(calls) == 3 and slept == [0.5, 1.0]
    assert not external.is_retryable(external.CallError("x", 400)) and external.is_retryable(ValueError())
    assert external.retry_after_ms("2") == 2000 and external.retry_after_ms(None) is None
    import threading

    first = threading.Event()

    def slow():
        if not first.is_set():
            first.set()
            threading.Event().wait(0.5)
            return "slow"
        return "fast"

    assert external.hedged(slow, 20) == "fast"


def test_config_and_prompts():
    assert resolve({"DOCWEAVE_RETRIES": "5", "DOCWEAVE_MAX_PAGES": "no"}, max_pages=3).retries == 5
    with pytest.raises(DocweaveError) as e:
        resolve({}, llm_provider="chat", api_key="hidden-key")
    assert e.value.code == "ERR_CONFIG_INVALID" and "hidden" not in str(e.value)
    p = parse_prompt("---\nname: contract\ntemperature: 0.2\nthinking: true\n---\n\nAsk.\n")
    assert (p.name, p.temperature, p.thinking, p.body) == ("contract", 0.2, True, "Ask.") and parse_prompt("Only.").body == "Only."
    assert files.fingerprint({"a": 1, "b": None}) == files.fingerprint({"a": 1}) and len(files.fingerprint({})) == 12


def test_call_llm_keeps_failures(spark):
    rows = spark.createDataFrame([(1, "p")], "id int, prompt string")
    assert external.call_llm(rows, external.MockLlm(), ["id"]).first()["extracted"] == '{"mockField":"mock"}'
    with pytest.raises(DocweaveError):
        external.backend("nobody")
    body = external.ChatLlm("http://x", "k", "m", extra={"temperature": 0.9, "seed": 1}).body("p", temperature=0.3)
    assert body["temperature"] == 0.3 and body["seed"] == 1 and body["response_format"] == {"type": "json_object"}
