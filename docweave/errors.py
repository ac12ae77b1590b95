"""Errors with stable codes."""

from __future__ import annotations

# Fixed codes.
CODES = ("ERR_UNSUPPORTED_FORMAT", "ERR_FILE_NOT_FOUND", "ERR_PROTECTED_FILE", "ERR_OCR_TIMEOUT", "ERR_OCR_FAILED", "ERR_LLM_JSON_PARSE", "ERR_LLM_TIMEOUT", "ERR_CONFIG_INVALID", "ERR_CACHE_IO")


class DocweaveError(Exception):
    def __init__(self, code: str, message: str, **details):
        super().__init__(message)
        self.code, self.details = code, details


class ConfigInvalid(DocweaveError):
    def __init__(self, message: str, **details):
        super().__init__("ERR_CONFIG_INVALID", message, **details)
