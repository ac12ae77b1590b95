"""The engine: paths to results and Markdown, Markdown to structured fields."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.config import SCHEMA_VERSION, Config, Prompt, llm_backend, ocr_backend, prompt_name, request_of, resolve, vision_backend
from docweave.errors import DocweaveError
from docweave.functions import files, text, vendor
from docweave.functions.numbers import round_half_up
from docweave.operators import layout, markdown, marks, metrics, structure
from docweave.operators.cache import through_cache
from docweave.operators.external import call_llm, call_ocr
from docweave.operators.journal import Journal
from docweave.plans import result
from docweave.sources.images import upright
from docweave.sources.scan import ParseOptions, hashed, missing, parse_files, scan_files, tasks_of
from docweave.sources.store import DENSE, shared_folder, stored

OCR_FAILED = "ERR_OCR_FAILED"
FALLBACK, CACHE_FAILED = "llm-json-parse-failed-fallback-to-text", "cache-write-failed"
#: A call that a file made, whatever its stage.
CALL = "struct<stage:string,model:string,provider:string,prompt_tokens:bigint,completion_tokens:bigint,image_tokens:bigint,started_ms:bigint,ms:bigint,retries:int>"


def page_action(kind, layer, detect: bool):
    """ocr, seal or none: pages without enough text and all images are read, other pages and images in documents are looked at for seals only if they are asked for."""
    seal = F.lit("seal" if detect else "none")
    return F.when((kind == "image") | ((kind == "page") & text.needs_ocr(F.coalesce(layer, F.lit("")))), F.lit("ocr")).when(kind.isin("page", "embedded"), seal).otherwise("none")


class DocEngine:
    """Scans, reads, renders, structures. Backends come from the configuration unless they are given."""

    def __init__(self, spark: SparkSession, config: Config | None = None, ocr=None, vision=None, llm=None, renderer=None):
        self.spark, self.config = spark, config or resolve()
        self._ocr, self._vision, self._llm, self.renderer = ocr, vision or ocr, llm, renderer
        self.journal = self._journal_of()

    def _journal_of(self, force: bool = False) -> Journal:
        """Answers of calls that cost: kept with the cache, without one or past it for this run alone."""
        return Journal(f"{self.config.cache_dir.rstrip('/')}/journal" if self.config.cache_dir and not force else shared_folder(self.spark))

    @property
    def ocr(self):
        return self._ocr or ocr_backend(self.config)

    @property
    def vision(self):
        return self._vision or vision_backend(self.config)

    @property
    def llm(self):
        return self._llm or llm_backend(self.config)

    def scan(self, paths: list[str]) -> DataFrame:
        """The files at the paths with archives opened: path, origin, entry, sub, content, file_hash, length, error. Files that are no entries are only named; they are opened where they are hashed or parsed."""
        found = scan_files(self.spark, *paths, contents=False)
        return found.coalesce(self.config.file_concurrency) if self.config.file_concurrency else found

    def options(self, full_pages: bool, detect: bool) -> ParseOptions:
        c = self.config
        return ParseOptions(full_pages, c.max_pages, (c.head_ratio, c.tail_ratio), detect, c.image_max_long_edge, self.renderer)

    # Pages and images to text, blocks, seals and signatures.

    def read(self, parts: DataFrame, detect: bool) -> DataFrame:
        """The pages and images of PARTS with action, text, blocks, seals, signatures and the call that was made."""
        c, keys = self.config, ["path", "kind", "number"]
        looked = parts.where(F.col("kind").isin("page", "image", "embedded")).withColumn("action", page_action(F.col("kind"), F.col("text"), detect)).withColumn("detect", F.lit(detect))
        looked = looked.select(*keys, "action", F.col("text").alias("layer"), "total", "image", "mime", "detect")
        keep = [*keys, "action", "layer", "total"]

        def called(action: str, backend) -> DataFrame:
            rows = call_ocr(looked.where(F.col("action") == action), backend, keep, c.max_concurrency, c.retries, c.hedge_ms or None, self.journal)
            if backend.provider != "aliyun-ocr":
                return rows.withColumns({"said": F.coalesce(text.peel_envelope(F.col("reply")), F.lit("")), "blocks": F.lit(None).cast(vendor.BLOCKS)}).drop("reply")
            rows = stored(rows)  # a call costs: it is made once, though two branches read it
            pages = layout.vendor_pages(rows.select(*keys, "reply"), keys).select(*keys, F.col("text").alias("said"), "blocks")
            return rows.drop("reply").join(pages, keys)

        none = looked.where("action = 'none'").select(*keep)
        rows = called("ocr", self.ocr)
        rows = (rows.unionByName(called("seal", self.vision)) if detect else rows).unionByName(none, allowMissingColumns=True)
        is_page, page = F.col("kind") == "page", F.col("number")
        blocks = F.when(is_page, vendor.numbered_blocks(F.col("blocks"), page)).otherwise(vendor.numbered_blocks(F.col("blocks")))
        marked = lambda read, norm: F.when(is_page, norm(read, page, *reversed(marks.PDF))).otherwise(norm(read, page, *reversed(marks.IMAGE)))
        said = F.when(F.lit(detect), F.coalesce("said", F.lit(""))).otherwise("")
        call = F.struct(F.col("action").alias("stage"), F.col("ocr_model").alias("model"), F.col("ocr_provider").alias("provider"), "prompt_tokens", "completion_tokens", F.lit(0).cast("long").alias("image_tokens"), "started_ms", "ms", "retries").cast(CALL)
        return rows.select(
            *keys, "action", "total", F.when(F.col("action") == "ocr", F.coalesce(F.nullif("said", F.lit("")), "layer")).otherwise(F.col("layer")).alias("text"), F.when(F.col("action") == "ocr", blocks).alias("blocks"),
            text.seal_marks(said).alias("seal_marks"), text.signature_marks(said).alias("signature_marks"), marked(text.seal_marks(said), marks.normalise_seals).alias("seals"),
            marked(text.signature_marks(said), marks.normalise_signatures).alias("signatures"), F.when(F.col("action") != "none", call).alias("call"), "ocr_error",
        )

    # Parts to one row a file.

    def assemble(self, parts: DataFrame, detect: bool) -> DataFrame:
        """PARTS as path, raw, total, truncated, sheets_shown, calls, error_code, error_message: a row a file. parts is read several times; it should be stored."""
        c = self.config
        read = stored(self.read(upright(parts, c.image_max_long_edge), detect))
        some = lambda a: F.when(F.size(a) > 0, a)
        # One aggregate over all that was read; of embedded images only the calls count here, so a file without pages and images has none.
        shown, own = F.col("kind") != "embedded", lambda *c: F.collect_list(F.when(F.col("kind") != "embedded", F.struct(*c)))
        filled = lambda a: F.when(F.size(a) > 0, a)
        pages = read.groupBy("path").agg(
            filled(F.array_sort(own(F.col("number").alias("page_no"), F.coalesce("text", F.lit("")).alias("text"), "blocks"))).cast(f"array<{result.PAGE}>").alias("pages"),
            filled(F.transform(F.array_sort(own("number", "seals")), lambda x: x["seals"])).alias("page_seals"), filled(F.transform(F.array_sort(own("number", "signatures")), lambda x: x["signatures"])).alias("page_signatures"),
            F.max(F.when(shown, F.col("total"))).alias("page_total"), F.bool_or(F.when(shown, F.col("kind") == "page")).alias("has_pages"),
            F.collect_list("call").alias("calls"), F.min("ocr_error").alias("ocr_error"),
        )
        inside = read.where("kind = 'embedded'")
        in_images = lambda f, marked, name: f(inside.select("path", F.col("number").alias("image_no"), F.col(marked).alias(name)), ["path"])
        listed = lambda df, name: df.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*(x for x in df.columns if x != "path")))).alias(name))
        none = F.lit(None)
        docx_seals, docx_signatures = listed(in_images(marks.seals_in_images, "seal_marks", "seals"), "docx_seals"), listed(in_images(marks.signatures_in_images, "signature_marks", "signatures"), "docx_signatures")
        cut = text.truncate(F.col("text"), c.docx_max_chars)
        other = parts.groupBy("path").agg(
            F.max(F.when(F.col("kind") == "document", cut)).alias("document"), F.max(F.when(F.col("kind") == "text", F.col("text"))).alias("plain"), F.sum("ms").alias("extract_ms"),
            F.max("error_code").alias("error_code"), F.max("error_message").alias("error_message"), F.bool_or(F.col("kind") == "error").alias("failed"),
        )
        # Sheets: cells are put together by sheet before they are by file.
        cells = parts.where("kind = 'cell'").groupBy("path", "sheet").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("number", "ref", F.col("text").alias("value"), "value_type", "formula"))), lambda x: F.struct(x["ref"].alias("ref"), x["value"].alias("value"), x["value_type"].alias("value_type"), x["formula"].alias("formula"))).alias("cells")
        )
        merged = parts.where("kind = 'merge'").groupBy("path", "sheet").agg(F.array_sort(F.collect_list("ref")).alias("merged"))
        bodies = markdown.sheets_markdown(parts.where("kind = 'cell'").select("path", "sheet", "ref", F.col("number").alias("seq"), F.col("text").alias("value")), ["path", "sheet"])
        sheets = parts.where("kind = 'sheet'").select("path", "sheet", F.col("number").alias("no")).join(cells, ["path", "sheet"], "left").join(merged, ["path", "sheet"], "left").join(bodies, ["path", "sheet"], "left")
        lines = F.transform(F.coalesce("cells", F.array().cast(f"array<{result.CELL}>")), lambda x: F.concat(F.col("sheet"), F.lit("!"), x["ref"], F.lit(": "), x["value"]))
        by_file = sheets.groupBy("path").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("no", "sheet", F.coalesce("cells", F.array().cast(f"array<{result.CELL}>")).alias("cells"), "merged"))), lambda s: F.struct(s["sheet"].alias("sheet_name"), s["cells"].alias("cells"), s["merged"].alias("merged_ranges"))).alias("sheets"),
            F.transform(F.array_sort(F.collect_list(F.struct("no", F.col("sheet").alias("name"), F.coalesce("body", F.lit(markdown.EMPTY_SHEET)).alias("body")))), lambda s: F.struct(s["name"].alias("name"), s["body"].alias("body"))).alias("sheets_shown"),
            F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("no", lines.alias("lines")))), lambda s: s["lines"])), "\n").alias("sheet_text"),
        )
        out = other
        if not detect:  # then no embedded image was looked at
            out = out.withColumns({"docx_seals": none.cast(f"array<{result.SEAL}>"), "docx_signatures": none.cast(f"array<{result.SIGNATURE}>")})
        for more in (pages, by_file, *((docx_seals, docx_signatures) if detect else ())):
            out = out.join(more, "path", "left")
        sections = F.transform(text.paragraphs(F.col("document.text")), lambda p, i: F.struct(F.concat(F.lit("p-"), (i + 1).cast("string")).alias("section_id"), p.alias("text")))
        page_text = F.when(F.col("has_pages"), F.array_join(F.transform("pages", lambda p: F.concat(F.lit("--- Page "), p["page_no"].cast("string"), F.lit(" ---\n"), p["text"])), "\n\n")).otherwise(F.get("pages", F.lit(0))["text"])
        seals = some(F.coalesce("docx_seals", F.flatten("page_seals"))).cast(f"array<{result.SEAL}>")
        signatures = some(F.coalesce("docx_signatures", F.flatten("page_signatures"))).cast(f"array<{result.SIGNATURE}>")
        full = F.coalesce(F.col("document.text"), page_text, F.col("sheet_text"), F.col("plain"), F.lit(""))
        raw = F.struct(F.col("pages"), F.col("sheets"), F.when(F.col("document").isNotNull(), sections).alias("sections"), full.alias("full_text"), seals.alias("seals"), signatures.alias("signatures")).cast(result.RAW)
        included = F.when(F.col("has_pages"), F.transform("pages", lambda p: p["page_no"]))
        count = F.when(F.col("has_pages"), F.col("page_total")).when(F.col("document").isNotNull(), files.page_count(F.col("document.original_length")))
        truncated = F.coalesce(F.col("document.truncated"), F.size(included) < F.col("page_total"), F.lit(False))
        first = F.struct(F.lit("extract").alias("stage"), F.lit("").alias("model"), F.lit("").alias("provider"), *(F.lit(0).cast("long").alias(n) for n in ("prompt_tokens", "completion_tokens", "image_tokens", "started_ms")), F.coalesce("extract_ms", F.lit(0)).cast("long").alias("ms"), F.lit(0).alias("retries")).cast(CALL)
        failed, bad_page = F.col("failed"), F.col("ocr_error").isNotNull()
        return out.select(
            "path", (~failed & ~bad_page).alias("ok"), raw.alias("raw"), "plain", "sheets_shown", count.cast("int").alias("page_count"), included.alias("pages_included"), truncated.alias("truncated"),
            F.concat(F.array(first), F.coalesce("calls", F.array().cast(f"array<{CALL}>"))).alias("calls"), F.when(failed, F.col("error_code")).when(bad_page, F.lit(OCR_FAILED)).alias("error_code"), F.when(failed, F.col("error_message")).otherwise(F.col("ocr_error")).alias("error_message"),
        )

    def shown(self, title):
        """A file's Markdown, over a row of assemble()."""
        raw = F.col("raw")
        return F.coalesce("plain", markdown.to_markdown(title, raw["pages"], F.col("sheets_shown"), raw["sections"], raw["full_text"]))

    def parsed(self, scanned: DataFrame, full_pages: bool = False, detect: bool | None = None, force: bool = False) -> DataFrame:
        """A scan's files with file_hash, length, the columns of assemble(), cache_hit and cache_failed; through the cache if there is one. What could not be opened is a failed row."""
        detect, self.journal = self.config.detect_seals and detect is not False, self._journal_of(force)
        options = self.options(full_pages, detect)
        if not self.config.cache_dir:
            parts = stored(parse_files(scanned, options))
            seen = parts.where("kind = 'file'").select("path", F.col("text").alias("file_hash"), F.col("ref").cast("long").alias("length"))
            return self.assemble(parts, detect).join(seen, "path", "left").withColumns({"cache_hit": F.lit(False), "cache_failed": F.lit(False)})
        # What a call sets belongs to the key, and the name too as far as it says the format.
        shape = files.fingerprint({"config": self.config.fingerprint, "full_pages": full_pages, "detect": detect})
        key = files.cache_key(F.col("file_hash"), F.concat_ws("|", F.lit(shape), files.extension(F.col("path"))))
        # What is asked of the files here is asked several times: they are hashed once. Contents are not copied; what the cache lacks is opened again.
        seen = stored(hashed(scanned).withColumn("cache_key", key))
        keyed = seen.where("error_message is null")
        tasks = tasks_of(keyed)

        def compute(todo: DataFrame) -> DataFrame:
            one = todo.select(F.concat("cache_key", files.extension(F.col("path"))).alias("path"), "content", F.col("path").alias("at"), "file_hash").repartition(tasks)
            whole = self.assemble(stored(parse_files(one, options), DENSE), detect).withColumn("cache_key", F.regexp_replace("path", r"\.[^.]*\z", "")).drop("path")
            return whole.withColumn("plain", F.when(F.col("plain").isNotNull(), F.lit("")))  # a plain text is its full text, which is kept once

        found = through_cache(keyed, f"{self.config.cache_dir.rstrip('/')}/results", compute, force=force, good=F.col("ok")).withColumn("plain", F.when(F.col("plain").isNotNull(), F.col("raw.full_text")))
        good = seen.where("error_message is null").select("path", "file_hash", "length", "cache_key").join(found, "cache_key").drop("cache_key")
        bad = seen.where("error_message is not null").select("path", F.lit(False).alias("ok"), "error_code", "error_message", F.lit(False).alias("truncated"), F.lit(False).alias("cache_hit"), F.lit(False).alias("cache_failed"), F.array().cast(f"array<{CALL}>").alias("calls"))
        return good.unionByName(bad, allowMissingColumns=True)

    def results(self, paths: list[str], prompt: Prompt | None = None, full_pages: bool = False, detect: bool | None = None, force: bool = False) -> DataFrame:
        """path, ok, the columns of result.RESULT, markdown, error_code, error_message: a row for each file, entry, bad archive and missing path. With a prompt, each file's fields are asked for."""
        absent = missing(self.spark, paths)
        there = [p for p in paths if p not in absent]
        none = F.lit(None).cast("string")
        lost = self.spark.createDataFrame([(p, "ERR_FILE_NOT_FOUND", f"File not found: {p}") for p in absent], "path string, error_code string, error_message string").withColumn("ok", F.lit(False))
        if not there:
            empty = self.spark.createDataFrame([], f"path string, ok boolean, {result.RESULT}, markdown string, error_code string, error_message string")
            return empty.unionByName(lost, allowMissingColumns=True)
        rows = self.parsed(self.scan(there), full_pages, detect, force)
        name = files.base_name(files.inner_name(F.col("path")))
        rows = rows.withColumns({"markdown": self.shown(name), "extracted": none, "parse_failed": F.lit(False)})
        if prompt is not None:
            rows = self._with_fields(stored(rows), prompt)
        warnings = F.array_compact(F.array(F.when(F.col("parse_failed"), F.lit(FALLBACK)), F.when(F.col("cache_failed"), F.lit(CACHE_FAILED))))
        rows = rows.withColumn("warnings", warnings)
        measured = self._measured(stored(rows))
        now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
        source = F.struct(
            F.col("path").alias("file_path"), name.alias("file_name"), files.detect_format(F.col("path")).alias("file_format"), files.size_mb(F.col("length")).alias("file_size_mb"), "file_hash", "page_count",
            F.transform(F.col("raw.sheets"), lambda s: s["sheet_name"]).alias("sheet_names"), "truncated", "pages_included", now.alias("uploaded_at"),
        ).cast(result.SOURCE)
        whole = measured.select(
            "path", "ok", F.lit(SCHEMA_VERSION).alias("schema_version"), now.alias("parsed_at"), F.lit(self.config.parser_version).alias("parser_version"), source.alias("source"), F.when(F.col("ok"), F.col("raw")).alias("raw"), "extracted", "metrics",
            F.when(F.size("warnings") > 0, F.col("warnings")).alias("warnings"), F.when(F.col("ok"), F.col("markdown")).alias("markdown"), "error_code", "error_message",
        )
        return whole.unionByName(lost, allowMissingColumns=True)

    def _with_fields(self, rows: DataFrame, prompt: Prompt) -> DataFrame:
        asked = rows.where("ok").select("path", text.user_prompt(F.lit(prompt.body), self.shown(F.lit(""))).alias("prompt"))
        answers = call_llm(asked, self.llm, ["path"], self.config.max_concurrency, self.config.retries, None, request_of(prompt, self.config), self.journal)
        call = F.struct(F.lit("llm").alias("stage"), F.col("a_model").alias("model"), F.lit("openai-compat").alias("provider"), "a_prompt_tokens", "a_completion_tokens", F.lit(0).cast("long"), F.lit(0).cast("long"), "a_ms", "a_retries").cast(CALL)
        answers = stored(answers.select("path", *(F.col(c).alias(f"a_{c}") for c in ("model", "prompt_tokens", "completion_tokens", "ms", "retries", "extracted", "parse_failed", "error"))))
        both = rows.drop("extracted", "parse_failed").join(answers, "path", "left").withColumns({"extracted": F.col("a_extracted"), "parse_failed": F.coalesce("a_parse_failed", F.lit(False)) & F.col("a_error").isNull()})
        lost = F.col("a_error").isNotNull()  # a call that failed fails its file
        both = both.withColumns({"calls": F.when(F.col("a_model").isNotNull(), F.concat("calls", F.array(call))).otherwise(F.col("calls")), "ok": F.col("ok") & ~lost, "error_message": F.coalesce("error_message", "a_error")})
        return both.drop(*(c for c in both.columns if c.startswith("a_")))

    def _measured(self, rows: DataFrame) -> DataFrame:
        """rows with metrics: quality, performance, cost."""
        calls = rows.select("path", F.explode("calls").alias("c")).select("path", "c.*")
        models = metrics.priced(calls.where("stage <> 'extract'")).groupBy("path", "model").agg(
            F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "image_tokens")), F.sum("yuan").alias("yuan")
        )
        cost = models.groupBy("path").agg(
            round_half_up(F.sum("yuan"), 4).alias("total_yuan"),
            F.map_from_entries(F.collect_list(F.struct("model", F.struct("calls", "prompt_tokens", "completion_tokens", "image_tokens", "yuan").alias("v")))).alias("calls_by_model"),
        )
        # A file's calls are one array: what is added up of them needs no shuffle.
        perf, peak = metrics.performance_of(F.col("calls")), metrics.peak_of(F.filter("calls", lambda c: c["stage"].isin("ocr", "seal")))
        raw = F.col("raw")
        quality = metrics.quality(metrics.field_count(F.col("extracted")), raw["full_text"], raw["seals"], raw["signatures"], F.col("warnings")).cast(result.QUALITY)
        # A hit took no time and made no calls this time; what it cost then is not counted again.
        hit = F.col("cache_hit")
        performance = F.struct(*(F.when(hit, F.lit(0)).otherwise(perf[c]).cast("long").alias(c) for c in ("total_ms", "extract_ms", "ocr_ms", "seal_ms", "llm_ms")), hit.alias("cache_hit"), peak.alias("ocr_concurrency_peak"), perf["retries"].alias("retries"), perf["images"].alias("images")).cast(result.PERFORMANCE)
        both = rows.join(cost, "path", "left")
        spent = F.struct(F.coalesce("total_yuan", F.lit(0.0)).alias("total_yuan"), F.coalesce("calls_by_model", F.create_map().cast(result.COST[result.COST.index("map<") : -1])).alias("calls_by_model")).cast(result.COST)
        return both.withColumn("metrics", F.struct(quality.alias("quality"), performance.alias("performance"), spent.alias("cost")))

    def extract(self, paths: list[str], full_pages: bool = False, detect: bool | None = None, force: bool = False) -> DataFrame:
        """path, ok, markdown, truncated, total_ms, error_code, error_message: a row for each file, entry, bad archive or path that does not exist."""
        found = self.results(paths, None, full_pages, detect, force)
        return found.select("path", "ok", "markdown", F.coalesce("source.truncated", F.lit(False)).alias("truncated"), F.coalesce("metrics.performance.total_ms", F.lit(0)).alias("total_ms"), "error_code", "error_message")

    def sources(self, results: DataFrame) -> DataFrame:
        """Results as sources for structure(): path, name, text. Their order is the caller's."""
        return results.where("ok").select("path", files.base_name(files.inner_name(F.col("path"))).alias("name"), F.col("markdown").alias("text"))

    def structure(self, sources: DataFrame, prompt: Prompt | None = None, job: str = "job") -> DataFrame:
        """sources (job, seq, name, text) as answered batches: job, batch_no, n_sources, chars and the fields of a call."""
        c, request = self.config, request_of(prompt, self.config)
        packed = structure.batch_texts(structure.pack_sources(sources, [job], c.max_input_chars), [job])
        asked = structure.prompts(packed, prompt.body if prompt else structure.DEFAULT_PROMPT)
        call = lambda todo, keep: call_llm(todo, self.llm, keep, c.max_concurrency, c.retries, None, request, self.journal)
        if not c.cache_dir:
            return call(asked, [job, "batch_no", "n_sources", "chars"])
        shape = files.fingerprint({"config": c.fingerprint, **{k: str(v) for k, v in request.items()}})
        keyed = asked.withColumn("cache_key", files.cache_key(F.sha2("prompt", 256), shape))
        answers = through_cache(keyed, f"{c.cache_dir.rstrip('/')}/answers", lambda todo: call(todo, ["cache_key"]), good=F.col("error").isNull())
        return keyed.drop("prompt", "text").join(answers, "cache_key").drop("cache_key", "cache_hit", "cache_failed")

    def fields(self, answered: DataFrame, job: str = "job") -> DataFrame:
        """job, k, v (JSON text), first_batch: what all batches say, the last one's word for each key."""
        pairs = answered.where("extracted is not null").select(job, "batch_no", F.explode(F.from_json("extracted", "map<string,string>")).alias("k", "v"))
        return structure.merge_last_wins(pairs, [job])

    def structured(self, sources: list[tuple[str, str]] | DataFrame, prompt: Prompt | None = None) -> dict:
        """Sources, as (name, text) in order or a frame (seq, name, text), as one answer: extracted, warnings, batches, totalLlmMs, tokenUsage, promptName. Without any source the model is asked all the same."""
        if not isinstance(sources, DataFrame):
            sources = self.spark.createDataFrame([(k, n, t) for k, (n, t) in enumerate(sources)], "seq long, name string, text string")
        if sources.isEmpty():
            sources = self.spark.createDataFrame([(0, "document", "")], "seq long, name string, text string")
        answered = stored(self.structure(sources.withColumn("job", F.lit(1)), prompt))
        rows = answered.orderBy("batch_no").select("n_sources", "chars", "ms", "prompt_tokens", "completion_tokens", "parse_failed", "extracted", "error").toLocalIterator()
        merged, batches, failed = {}, [], False
        for r in rows:  # a row a batch, each bounded by the size of a prompt's answer
            if r["error"]:
                raise DocweaveError("ERR_LLM_JSON_PARSE" if "no content" in r["error"] else "ERR_LLM_TIMEOUT", r["error"])
            batches.append({"sources": r["n_sources"], "chars": r["chars"], "llmMs": r["ms"], "promptTokens": r["prompt_tokens"], "completionTokens": r["completion_tokens"], **({"parseFailed": True} if r["parse_failed"] else {})})
            merged |= json.loads(r["extracted"])
            failed |= r["parse_failed"]
        warnings = [f"input split into {len(batches)} batches (maxInputChars={self.config.max_input_chars})"] if len(batches) > 1 else []
        warnings += ["at least one batch returned non-JSON content; see `extracted.text`"] if failed else []
        total = lambda k: sum(b[k] for b in batches)
        return {"extracted": merged, "warnings": warnings, "batches": batches, "totalLlmMs": total("llmMs"), "tokenUsage": {"prompt": total("promptTokens"), "completion": total("completionTokens")}, "promptName": prompt_name(prompt)}
