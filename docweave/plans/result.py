"""A file's result as one nested row: its schema, its JSON Schema, its JSON."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = "array<double>"
BLOCK = f"struct<block_id:string,text:string,bbox:{BOX},confidence:double>"
PAGE = f"struct<page_no:int,text:string,blocks:array<{BLOCK}>>"
CELL = "struct<ref:string,value:string,value_type:string,formula:string>"
SHEET = f"struct<sheet_name:string,cells:array<{CELL}>,merged_ranges:array<string>>"
SECTION = "struct<section_id:string,text:string>"
LOCATOR = "locator_kind:string,page_no:int,section_id:string"
SEAL = f"struct<seal_id:string,type:string,owner:string,color:string,shape:string,confidence:double,{LOCATOR}>"
SIGNATURE = f"struct<signature_id:string,type:string,signer:string,confidence:double,{LOCATOR}>"
SOURCE = "struct<file_path:string,file_name:string,file_format:string,file_size_mb:double,file_hash:string,page_count:int,sheet_names:array<string>,truncated:boolean,pages_included:array<int>,uploaded_at:string>"
RAW = f"struct<pages:array<{PAGE}>,sheets:array<{SHEET}>,sections:array<{SECTION}>,full_text:string,seals:array<{SEAL}>,signatures:array<{SIGNATURE}>>"
QUALITY = "struct<field_count:bigint,fields_above_confidence:bigint,avg_confidence:double,locator_resolve_rate:double,ocr_chars:bigint,seals:bigint,signatures:bigint,warnings:bigint>"
PERFORMANCE = "struct<total_ms:bigint,extract_ms:bigint,ocr_ms:bigint,seal_ms:bigint,llm_ms:bigint,cache_hit:boolean,ocr_concurrency_peak:bigint,retries:bigint,images:bigint>"
COST = "struct<total_yuan:double,calls_by_model:map<string,struct<calls:bigint,prompt_tokens:bigint,completion_tokens:bigint,image_tokens:bigint,yuan:double>>>"
RESULT = f"schema_version string, parsed_at string, parser_version string, source {SOURCE}, raw {RAW}, extracted string, metrics struct<quality:{QUALITY},performance:{PERFORMANCE},cost:{COST}>, warnings array<string>"
REQUIRED = {"schema_version", "parsed_at", "parser_version", "source", "raw", "metrics", "file_path", "file_name", "file_format", "file_size_mb", "file_hash", "truncated", "uploaded_at"}
FORMATS = ("pdf", "jpg", "png", "xlsx", "xls", "doc", "docx")
#: Beyond its type, what a value must be.
RULES = {"schema_version": {"const": "1.0"}, "file_format": {"enum": list(FORMATS)}, "file_hash": {"pattern": "^[a-f0-9]{64}$"}, "file_size_mb": {"minimum": 0}, "confidence": {"minimum": 0, "maximum": 1}}
#: The caller's prompt owns the shape of what is extracted; it comes as JSON text and is an object in JSON.
FREE = {"extracted": {"type": "object"}}


def json_schema(kind: T.DataType | None = None, name: str = "ParseResult") -> dict:
    """The schema of a result, or of another type, as JSON Schema."""
    out = _described(kind or T._parse_datatype_string(RESULT))
    return {"$schema": "http://json-schema.org/draft-07/schema#", "title": name, **out}


def _described(kind: T.DataType) -> dict:
    if isinstance(kind, T.StructType):
        parts = {f.name: FREE.get(f.name) or _described(f.dataType) | RULES.get(f.name, {}) for f in kind.fields}
        needed = [f.name for f in kind.fields if f.name in REQUIRED]
        return {"type": "object", "properties": parts, "additionalProperties": False} | ({"required": needed} if needed else {})
    if isinstance(kind, T.ArrayType):
        return {"type": "array", "items": _described(kind.elementType)}
    if isinstance(kind, T.MapType):
        return {"type": "object", "additionalProperties": _described(kind.valueType)}
    if isinstance(kind, T.BooleanType):
        return {"type": "boolean"}
    if isinstance(kind, T.IntegralType):
        return {"type": "integer"}
    return {"type": "number" if isinstance(kind, T.NumericType) else "string"}
