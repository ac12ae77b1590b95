"""Calls to models from executors: limits, retries, hedges, backends and their mocks.

Calls are made in Arrow batches, several at a time in a pool of threads for each task. A limit is for the
whole cluster: it is dealt to the tasks that can run at once, and fewer tasks are made if it is smaller
than they are. Speculation must be off (a task that runs twice pays
twice), and results belong into the cache (operators.cache), so that a retried task does not ask again.
"""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from email.utils import parsedate_to_datetime
from typing import Protocol, TypeVar

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.errors import ConfigInvalid, DocweaveError
from docweave.functions.jsonfix import extracted
from docweave.operators.journal import Journal, attempt, call_key

R = TypeVar("R")
BASE_MS, MOST_MS, RETRIES, HEDGE_MS, POOL = 500, 15_000, 2, 8_000, 24
RETRY_STATUS = (408, 425, 429)


class CallError(Exception):
    """A failed call; status is the HTTP status if there was an answer, retry_after the header's text."""

    def __init__(self, message: str, status: int | None = None, retry_after: str | None = None):
        super().__init__(message)
        self.status, self.retry_after = status, retry_after


def is_retryable(error: Exception) -> bool:
    status = getattr(error, "status", None)
    return status is None or status in RETRY_STATUS or 500 <= status < 600


def retry_after_ms(text: str | None, now: float | None = None) -> int | None:
    """Seconds or a date, as milliseconds from now."""
    if not text:
        return None
    try:
        return max(0, int(float(text) * 1000))
    except ValueError:
        try:
            return max(0, int((parsedate_to_datetime(text).timestamp() - (time.time() if now is None else now)) * 1000))
        except ValueError:
            return None


def delay_ms(error: Exception, attempt: int, draw: Callable[[], float] = random.random, base: int = BASE_MS, most: int = MOST_MS) -> float:
    asked = retry_after_ms(getattr(error, "retry_after", None))
    return min(most, asked) if asked is not None else draw() * min(most, base * 2**attempt)


def backoff_bounds(attempt: Column, base: int = BASE_MS, most: int = MOST_MS) -> Column:
    """The longest delay before each attempt."""
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2), attempt)).cast("long")


def retry(call: Callable[[], R], retries: int = RETRIES, sleep: Callable[[float], None] = time.sleep, draw: Callable[[], float] = random.random) -> tuple[R, int]:
    """The result, and how many retries it took; the last error if none helped."""
    for attempt in range(retries + 1):
        try:
            return call(), attempt
        except Exception as error:
            if attempt == retries or not is_retryable(error):
                raise
            sleep(delay_ms(error, attempt, draw) / 1000)
    raise AssertionError


def hedged(call: Callable[[], R], after_ms: float = HEDGE_MS) -> R:
    """A second call if the first is not back in time; the first success counts. An error before that is raised at once, later only if both fail."""
    pool = ThreadPoolExecutor(2)
    try:
        first = pool.submit(call)
        done, _ = wait([first], timeout=after_ms / 1000)
        if done:
            return first.result()
        open_, error = {first, pool.submit(call)}, None
        while open_:
            done, open_ = wait(open_, return_when=FIRST_COMPLETED)
            for f in done:
                if f.exception() is None:
                    return f.result()
                error = f.exception()
        raise error
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


class OcrBackend(Protocol):
    model: str
    provider: str

    def recognize(self, image: bytes | None, mime: str, detect: bool) -> dict:
        """reply (the model's text, or the vendor's JSON), prompt_tokens, completion_tokens."""
        ...


class LlmBackend(Protocol):
    model: str

    def extract(self, prompt: str, **request) -> dict:
        """text, prompt_tokens, completion_tokens. request may have system, model, temperature, enable_thinking."""
        ...


OCR_REPLY = "[mock-ocr] recognized text"


@dataclass
class MockOcr:
    """Looks at nothing and says always the same."""

    model: str = "mock-ocr"
    provider: str = "mock-ocr"
    reply: str = OCR_REPLY
    free: bool = True  # nothing is kept of calls that cost nothing

    def recognize(self, image: bytes | None, mime: str = "image/jpeg", detect: bool = False) -> dict:
        return {"reply": self.reply, "prompt_tokens": 0, "completion_tokens": 0}


@dataclass
class MockLlm:
    model: str = "mock-llm"
    record: bool = False
    asked: list[str] = field(default_factory=list)
    free: bool = True

    def extract(self, prompt: str, **request) -> dict:
        if self.record:
            self.asked.append(prompt)
        return {"text": json.dumps({"mockField": "mock"}), "prompt_tokens": len(prompt) // 4, "completion_tokens": 4}


@dataclass
class ChatLlm:
    """A chat endpoint that speaks the common JSON protocol."""

    url: str
    key: str
    model: str
    timeout_s: float = 60.0
    extra: dict = field(default_factory=dict)
    json_mode: bool = True

    def body(self, prompt: str, system: str | None = None, **request) -> dict:
        """The request's own settings win over the backend's extra ones. enable_thinking is sent whenever it is given, also if false: models take it as true otherwise."""
        said = [{"role": "system", "content": system}] if system else []
        out = {"model": self.model, "temperature": 0.1, "stream": False, "messages": [*said, {"role": "user", "content": prompt}]}
        if self.json_mode:
            out["response_format"] = {"type": "json_object"}
        return self.extra | out | {k: v for k, v in request.items() if v is not None}

    def post(self, body: dict) -> dict:
        from urllib.error import HTTPError, URLError
        from urllib.request import Request, urlopen

        request = Request(f"{self.url.rstrip('/')}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"})
        try:
            with urlopen(request, timeout=self.timeout_s) as answer:
                return json.load(answer)
        except HTTPError as e:
            raise CallError(f"status {e.code}", e.code, e.headers.get("Retry-After")) from None  # never the request: it holds the key
        except URLError as e:
            raise CallError(f"no answer: {type(e.reason).__name__}") from None

    def extract(self, prompt: str, **request) -> dict:
        return said(self.post(self.body(prompt, **request)), "text")


def said(answer: dict, name: str) -> dict:
    """The content of a chat answer under a name, and its tokens."""
    used = answer.get("usage") or {}
    content = ((answer.get("choices") or [{}])[0].get("message") or {}).get("content")
    if not content:
        raise CallError("the answer has no content", 422)
    return {name: content, "prompt_tokens": used.get("prompt_tokens") or 0, "completion_tokens": used.get("completion_tokens") or 0}


OCR_PROMPT = """Read all text in the image in reading order and write it as Markdown: headings with #, tables as pipe tables with a rule below their head, lists with - or numbers, a blank line between paragraphs.
Write the Markdown alone, without a code fence, JSON, coordinates or remarks."""
#: The marks are fixed spellings that functions.text reads.
MARKS_PROMPT = """
Where there is a seal, write 【印章:owner | colour (红, 蓝 or 黑) | shape (圆形, 椭圆 or 方形)】 at its place; where there is a signature, write 【签名:name】. Write 未知 for what cannot be read. Without a seal or signature write no marks."""
OCR_QUESTION = "Write down the text of this image."


@dataclass
class ChatOcr:
    """A chat endpoint that reads images."""

    url: str
    key: str
    model: str
    timeout_s: float = 45.0
    extra: dict = field(default_factory=dict)
    provider: str = "openai-compat"

    def body(self, image: bytes, mime: str, detect: bool) -> dict:
        from base64 import b64encode

        data = f"data:{mime};base64,{b64encode(image).decode()}"
        content = [{"type": "text", "text": OCR_QUESTION}, {"type": "image_url", "image_url": {"url": data}}]
        messages = [{"role": "system", "content": OCR_PROMPT + (MARKS_PROMPT if detect else "")}, {"role": "user", "content": content}]
        return {"model": self.model, "messages": messages, "temperature": 0, "stream": False} | self.extra

    def recognize(self, image: bytes | None, mime: str = "image/png", detect: bool = False) -> dict:
        if image is None:
            raise CallError("the page has no image that could be sent", 422)
        return said(ChatLlm(self.url, self.key, self.model, self.timeout_s).post(self.body(image, mime, detect)), "reply")


@dataclass
class CloudOcr:
    """The vendor's general recognition with tables. client (anything with recognize(bytes, options) that gives the reply's JSON text) takes the place of its optional package."""

    access_key_id: str = field(repr=False)
    access_key_secret: str = field(repr=False)
    endpoint: str = "ocr-api.cn-hangzhou.aliyuncs.com"
    region_id: str = "cn-hangzhou"
    timeout_s: float = 45.0
    output_table: bool = True
    row: bool | None = None
    paragraph: bool | None = None
    model: str = "RecognizeAdvanced"
    provider: str = "aliyun-ocr"
    client: object = None

    def options(self) -> dict:
        """Rotation is always asked for."""
        given = {"output_table": self.output_table, "row": self.row, "paragraph": self.paragraph}
        return {k: v for k, v in given.items() if v is not None} | {"need_rotate": True}

    def recognize(self, image: bytes | None, mime: str = "image/png", detect: bool = False) -> dict:
        if image is None:
            raise CallError("the page has no image that could be sent", 422)
        try:
            reply = (self.client or VendorClient(self)).recognize(image, self.options())
        except Exception as error:
            if hasattr(error, "status") or isinstance(error, DocweaveError):
                raise
            raise CallError(safe_message(error), getattr(error, "status_code", getattr(error, "statusCode", None))) from None
        return {"reply": reply, "prompt_tokens": 0, "completion_tokens": 0}


class VendorClient:
    """The vendor's package, which is optional."""

    def __init__(self, ocr: CloudOcr):
        try:
            from alibabacloud_ocr_api20210707 import client, models
            from alibabacloud_tea_openapi import models as openapi
            from alibabacloud_tea_util import models as util
        except ImportError:
            raise ConfigInvalid("the cloud OCR needs the package alibabacloud_ocr_api20210707") from None
        self.models, self.runtime = models, util.RuntimeOptions(read_timeout=int(ocr.timeout_s * 1000), connect_timeout=min(10_000, int(ocr.timeout_s * 1000)), autoretry=False)
        self.client = client.Client(openapi.Config(access_key_id=ocr.access_key_id, access_key_secret=ocr.access_key_secret, endpoint=ocr.endpoint, region_id=ocr.region_id))

    def recognize(self, image: bytes, options: dict) -> str:
        import io

        answer = self.client.recognize_advanced_with_options(self.models.RecognizeAdvancedRequest(body=io.BytesIO(image), **options), self.runtime)
        return json.dumps({"Data": answer.body.data})


def safe_message(error: Exception) -> str:
    """Code, status and message of an error, and nothing else of it: the rest may hold credentials."""
    parts = [getattr(error, "code", None), getattr(error, "status_code", getattr(error, "statusCode", None)), getattr(error, "message", None) or str(error)]
    return " ".join(str(p) for p in parts if p not in (None, "")) or type(error).__name__


BACKENDS: dict[str, Callable[..., object]] = {"mock": MockLlm, "chat": ChatLlm, "mock-ocr": MockOcr, "openai-compat": ChatOcr, "aliyun-ocr": CloudOcr}


def backend(name: str, **options):
    if name not in BACKENDS:
        raise ConfigInvalid(f"unknown provider: {name}")
    return BACKENDS[name](**options)


# Fixed endpoints and models of the presets.
QWEN_URL, OPENAI_URL = "https://dashscope.aliyuncs.com/compatible-mode/v1", "https://api.openai.com/v1"
PRESETS = {
    "qwen-ocr": ("openai-compat", QWEN_URL, "qwen-vl-ocr-latest"),
    "qwen-vision": ("openai-compat", QWEN_URL, "qwen-vl-max"),
    "qwen-llm": ("chat", QWEN_URL, "qwen3.6-plus"),
    "openai-ocr": ("openai-compat", OPENAI_URL, "gpt-4o"),
    "openai-llm": ("chat", OPENAI_URL, "gpt-4o-mini"),
}


def preset(name: str, key: str, url: str | None = None, model: str | None = None, **options):
    """A backend with a well-known endpoint and model."""
    if name not in PRESETS:
        raise ConfigInvalid(f"unknown preset: {name}")
    kind, own_url, own_model = PRESETS[name]
    return backend(kind, url=url or own_url, key=key, model=model or own_model, **options)


CALL_FIELDS = "model string, prompt_tokens long, completion_tokens long, ms long, retries int, extracted string, parse_failed boolean, error string"


def _asked(call: Callable[[], R], retries: int, hedge_ms: float | None) -> tuple[R, int]:
    return retry((lambda: hedged(call, hedge_ms)) if hedge_ms else call, retries)


def _journaled(call: Callable[[], dict], key: Callable[[], str], backend, journal: Journal | None, owner: str, retries: int, hedge_ms: float | None) -> tuple[dict, int]:
    """The call's answer and the retries that it took, those of the first time if the journal has it."""
    if journal is None or getattr(backend, "free", False):
        return _asked(call, retries, hedge_ms)

    def once() -> dict:
        answer, tries = _asked(call, retries, hedge_ms)
        return {"answer": answer, "tries": tries}

    kept = journal.ask(key(), once, owner)
    return kept["answer"], kept["tries"]


def limited(rows: DataFrame, most: int) -> tuple[DataFrame, int]:
    """rows and the size of a task's pool, such that at most `most` calls are open in all tasks that can run at once."""
    slots = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    return (rows.coalesce(max(1, most)), 1) if most < slots else (rows, most // slots)


def call_llm(prompts: DataFrame, llm: LlmBackend, keep: list[str], pool: int = POOL, retries: int = RETRIES, hedge_ms: float | None = None, request: dict | None = None, journal: Journal | None = None) -> DataFrame:
    """prompts (keep, prompt) with the fields of CALL_FIELDS: a row for each prompt, also where the call failed. request goes with each call; pool is the most calls that are open at once. What a journal has is not asked again."""
    request = request or {}
    prompts, pool = limited(prompts, pool)
    schema = T.StructType([*(prompts.schema[c] for c in keep), *T._parse_datatype_string(CALL_FIELDS).fields])

    def one(prompt: str, owner: str) -> tuple:
        began = time.monotonic()
        ms = lambda: int((time.monotonic() - began) * 1000)
        try:
            key = lambda: call_key("llm", llm.model, request, prompt)
            answer, tries = _journaled(lambda: llm.extract(prompt, **request), key, llm, journal, owner, retries, hedge_ms)
        except Exception as error:
            return request.get("model") or llm.model, 0, 0, ms(), retries, None, True, f"{type(error).__name__}: {safe_message(error)}"
        return request.get("model") or llm.model, answer["prompt_tokens"], answer["completion_tokens"], ms(), tries, *extracted(answer["text"]), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, owner = [f.name for f in schema.fields[len(keep) :]], attempt()
        with ThreadPoolExecutor(pool) as threads:
            for pdf in batches:
                out = pd.DataFrame(list(threads.map(one, pdf["prompt"], [owner] * len(pdf))), columns=names)
                yield pd.concat([pdf[keep].reset_index(drop=True), out], axis=1)

    return prompts.select(*keep, "prompt").mapInPandas(run, schema)


OCR_FIELDS = "ocr_model string, ocr_provider string, prompt_tokens long, completion_tokens long, started_ms long, ms long, retries int, reply string, ocr_error string"


def call_ocr(images: DataFrame, ocr: OcrBackend, keep: list[str], pool: int = POOL, retries: int = RETRIES, hedge_ms: float | None = None, journal: Journal | None = None) -> DataFrame:
    """images (keep, image, mime, detect) with the fields of OCR_FIELDS: a row for each image, also where the call failed. reply is what functions.text and functions.vendor read; pool is the most calls that are open at once. What a journal has is not asked again."""
    images, pool = limited(images, pool)
    schema = T.StructType([*(images.schema[c] for c in keep), *T._parse_datatype_string(OCR_FIELDS).fields])

    def one(image: bytes | None, mime: str, detect: bool, owner: str) -> tuple:
        began, started = time.monotonic(), int(time.time() * 1000)
        ms = lambda: int((time.monotonic() - began) * 1000)
        try:
            key = lambda: call_key("ocr", ocr.provider, ocr.model, detect, mime, image or b"")
            answer, tries = _journaled(lambda: ocr.recognize(image, mime, detect), key, ocr, journal, owner, retries, hedge_ms)
        except Exception as error:
            return ocr.model, ocr.provider, 0, 0, started, ms(), retries, None, f"{type(error).__name__}: {safe_message(error)}"
        return ocr.model, ocr.provider, answer["prompt_tokens"], answer["completion_tokens"], started, ms(), tries, answer["reply"], None

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        types, owner = to_arrow_schema(schema), attempt()
        with ThreadPoolExecutor(pool) as threads:
            for batch in batches:
                found = list(threads.map(one, *(batch.column(c).to_pylist() for c in ("image", "mime", "detect")), [owner] * len(batch)))
                made = [pa.array(c, types.field(len(keep) + k).type) for k, c in enumerate(zip(*found, strict=True))] if found else [pa.array([], f.type) for f in list(types)[len(keep) :]]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], types.names)

    return images.select(*keep, *(c for c in ("image", "mime", "detect") if c not in keep)).mapInArrow(run, schema)


def seal_detector(images: DataFrame, ocr: OcrBackend, keep: list[str], **options) -> DataFrame:
    """images (keep, image, mime) as keep, seals, signatures, ms, ocr_error: what a vision backend finds, whatever the text."""
    from docweave.functions.text import peel_envelope, seal_marks, signature_marks

    called = call_ocr(images.withColumn("detect", F.lit(True)), ocr, keep, **options)
    body = F.coalesce(peel_envelope(F.col("reply")), F.lit(""))
    return called.select(*keep, seal_marks(body).alias("seals"), signature_marks(body).alias("signatures"), "ms", "ocr_error")
