"""Configuration: explicit settings before the environment before defaults; prompts with front matter."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields, replace

from docweave import __version__
from docweave.errors import ConfigInvalid

PREFIX = "DOCWEAVE_"


#: Providers of OCR and of the text model; the mocks need nothing.
OCR_PROVIDERS, LLM_PROVIDERS = ("mock-ocr", "openai-compat", "aliyun-ocr"), ("mock", "chat")
SCHEMA_VERSION = "1.0"


@dataclass(frozen=True)
class Config:
    mode: str = "mock"
    ocr_provider: str = "mock-ocr"
    llm_provider: str = "mock"
    base_url: str = ""
    api_key: str = field(default="", repr=False)
    ocr_model: str = "qwen-vl-ocr-latest"
    vision_model: str = "qwen-vl-max"
    text_model: str = "qwen3.6-plus"
    aliyun_access_key_id: str = field(default="", repr=False)
    aliyun_access_key_secret: str = field(default="", repr=False)
    aliyun_ocr_endpoint: str = "ocr-api.cn-hangzhou.aliyuncs.com"
    aliyun_ocr_region: str = "cn-hangzhou"
    output_table: bool = True
    max_concurrency: int = 24
    ocr_timeout_ms: int = 45_000
    ocr_thinking: bool = False
    retries: int = 2
    image_max_long_edge: int = 2000
    temperature: float = 0.1
    llm_timeout_ms: int = 60_000
    max_pages: int = 10
    head_ratio: int = 7
    tail_ratio: int = 3
    docx_max_chars: int = 5000
    max_input_chars: int = 500_000
    file_concurrency: int = 0  # 0: as many files at once as the cluster has room for
    hedge_ms: int = 8_000
    thinking: bool = False
    cache_dir: str = ""
    detect_seals: bool = True
    parser_version: str = ""

    @property
    def fingerprint(self) -> str:
        """Of all that shapes a result; keys and folders do not."""
        from docweave.functions.files import fingerprint

        skip = {"api_key", "aliyun_access_key_id", "aliyun_access_key_secret", "cache_dir", "max_concurrency", "file_concurrency", "retries", "hedge_ms"}
        return fingerprint({f.name: getattr(self, f.name) for f in fields(self) if f.name not in skip})


def _read(kind: str, text: str):
    """The value of an environment variable; None for one that makes no sense."""
    try:
        if kind == "int":
            return n if (n := int(text)) > 0 else None
        if kind == "float":
            return float(text)
    except ValueError:
        return None
    return text.lower() in ("1", "true", "yes") if kind == "bool" else text


def resolve(environ: dict[str, str] | None = None, **given) -> Config:
    environ = os.environ if environ is None else environ
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ConfigInvalid(f"unknown settings: {', '.join(sorted(unknown))}")
    found = {f.name: v for f in fields(Config) if (t := environ.get(PREFIX + f.name.upper())) and (v := _read(f.type, t)) is not None}
    if seen := found.get("vision_model"):  # one model for both, unless the other is named
        found.setdefault("ocr_model", seen)
    found |= {k: v for k, v in given.items() if v is not None}
    if found.get("mode") == "api":  # real backends unless others are named
        found = {"ocr_provider": "openai-compat", "llm_provider": "chat"} | found
    out = replace(Config(), **found)
    out = replace(out, aliyun_ocr_endpoint=out.aliyun_ocr_endpoint.removeprefix("https://").removeprefix("http://").rstrip("/"), parser_version=out.parser_version or f"{out.mode}-{__version__}")
    for f in fields(Config):
        value = getattr(out, f.name)
        if f.type == "int" and (not isinstance(value, int) or isinstance(value, bool) or value < (0 if f.name in ("retries", "hedge_ms", "file_concurrency") else 1)):
            raise ConfigInvalid(f"{f.name} must be a positive whole number")
    if not 0 <= out.temperature <= 2:
        raise ConfigInvalid("temperature must be between 0 and 2")
    if out.mode not in ("mock", "api") or out.ocr_provider not in OCR_PROVIDERS or out.llm_provider not in LLM_PROVIDERS:
        raise ConfigInvalid(f"unknown mode or provider: {out.mode}, {out.ocr_provider}, {out.llm_provider}")
    if out.llm_provider == "chat" and not (out.api_key and out.base_url):
        raise ConfigInvalid("a model needs base_url and api_key")  # never silently the mock, and no key for an address that nobody named
    if out.ocr_provider == "openai-compat" and not (out.api_key and out.base_url):
        raise ConfigInvalid("this OCR provider needs base_url and api_key")
    if out.ocr_provider == "aliyun-ocr" and not (out.aliyun_access_key_id and out.aliyun_access_key_secret):
        raise ConfigInvalid("this OCR provider needs aliyun_access_key_id and aliyun_access_key_secret")
    return out


def _chat_ocr(config: Config, model: str):
    from docweave.operators.external import backend

    return backend("openai-compat", url=config.base_url, key=config.api_key, model=model, timeout_s=config.ocr_timeout_ms / 1000, extra={"enable_thinking": config.ocr_thinking})


def _cloud_ocr(config: Config):
    from docweave.operators.external import backend

    if not (config.aliyun_access_key_id and config.aliyun_access_key_secret):
        raise ConfigInvalid("the cloud OCR needs aliyun_access_key_id and aliyun_access_key_secret")
    options = {"access_key_id": config.aliyun_access_key_id, "access_key_secret": config.aliyun_access_key_secret, "endpoint": config.aliyun_ocr_endpoint, "region_id": config.aliyun_ocr_region}
    return backend("aliyun-ocr", **options, output_table=config.output_table, timeout_s=config.ocr_timeout_ms / 1000)


def ocr_backend(config: Config):
    """What reads text."""
    from docweave.operators.external import backend

    return {"mock-ocr": lambda: backend("mock-ocr"), "openai-compat": lambda: _chat_ocr(config, config.ocr_model), "aliyun-ocr": lambda: _cloud_ocr(config)}[config.ocr_provider]()


def vision_backend(config: Config):
    """What looks for seals: the chat endpoint if there is one, else the cloud OCR (which finds none)."""
    from docweave.operators.external import backend

    if config.ocr_provider == "mock-ocr":
        return backend("mock-ocr", model="mock-vision")
    return _chat_ocr(config, config.vision_model) if config.api_key and config.base_url else _cloud_ocr(config)


def llm_backend(config: Config):
    from docweave.operators.external import backend

    if config.llm_provider == "mock":
        return backend("mock")
    return backend("chat", url=config.base_url, key=config.api_key, model=config.text_model, timeout_s=config.llm_timeout_ms / 1000)


@dataclass(frozen=True)
class Prompt:
    body: str
    name: str | None = None
    schema_version: str | None = None
    model: str | None = None
    temperature: float | None = None
    thinking: bool | None = None
    extraction: str | None = None


def parse_prompt(raw: str) -> Prompt:
    """A prompt file: scalars between --- lines, then the body."""
    lines, head = raw.lstrip("﻿").split("\n"), {}
    if lines[0].strip() == "---" and "---" in [x.strip() for x in lines[1:]]:
        end = [x.strip() for x in lines].index("---", 1)
        for line in lines[1:end]:
            name, colon, value = line.partition(":")
            if colon and not line.lstrip().startswith("#"):
                head[name.strip()] = value.split(" #")[0].strip().strip("\"'")
        lines = lines[end + 1 :]
    kinds = {"temperature": float, "thinking": lambda x: x.lower() == "true"}
    names = {"name": "name", "schemaVersion": "schema_version", "model": "model", "temperature": "temperature", "thinking": "thinking", "extraction": "extraction"}
    return Prompt("\n".join(lines).strip(), **{names[k]: kinds.get(k, str)(v) for k, v in head.items() if k in names and v})


def request_of(prompt: Prompt | None, config: Config) -> dict:
    """What goes with each call of the text model: front matter before configuration. enable_thinking is always sent."""
    out = {"temperature": config.temperature, "enable_thinking": thinking(prompt, config)}
    if prompt is not None:
        out |= {k: v for k, v in (("system", prompt.body), ("model", prompt.model), ("temperature", prompt.temperature)) if v is not None}
    return out


def prompt_name(prompt: Prompt | None) -> str:
    return (prompt.name or "custom") if prompt else "default-structure"


def thinking(prompt: Prompt | None, config: Config) -> bool:
    """Front matter before configuration."""
    return config.thinking if prompt is None or prompt.thinking is None else prompt.thinking
