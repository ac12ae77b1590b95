"""Text: trimming, escaping, truncation, paragraphs, marks in OCR replies, headings and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats (white space as ECMAScript has it, mark and keyword spellings).
BLANKS = r"\s\x{B}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
SEAL_MARK = "【印章[::]([^】]+)】"
SIGNATURE_MARK = "【签名[::]([^】]+)】"
UNKNOWN_OWNER = "未知"
COLORS = (("红", "red"), ("蓝", "blue"), ("黑", "black"))
SHAPES = (("椭", "oval"), ("圆", "circle"), ("方", "rectangle"), ("矩", "rectangle"))
COLOR_HINT, SHAPE_HINT = "[红蓝黑紫]", "(圆|椭|方|矩)"
HEADING_NOUNS = "(合同|协议|证明|申请表|验收表|汇总表|进度款|账户|发票|收据|报告|照片)"
HEADING_STOPS = "[:：。；;,.，]"
HEADING_LENGTH = 40
BULLET = "^[-•·]"
NUMBERED = r"^[一二三四五六七八九十]+[、.．]|^\d+[、.．)]"
SENTENCE_END = r"[。！？!?；;：:]\z"
DOCUMENT_ANCHOR = "【文档原文】"
OCR_TEXT_THRESHOLD = 20
DOCX_MAX_CHARS = 5000


def trim(s: Column) -> Column:
    """Without white space of any kind at both ends (the built-in trim takes blanks only)."""
    return F.regexp_replace(s, f"^[{BLANKS}]+|[{BLANKS}]+\\z", "")


def escape_cell(s: Column) -> Column:
    """For a cell of a Markdown table."""
    return trim(F.replace(F.replace(s, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" ")))


def escape_markdown(s: Column) -> Column:
    return trim(F.regexp_replace(F.replace(s, F.lit("|"), F.lit("\\|")), "\r?\n", " "))


def escape_table_cell(s: Column) -> Column:
    return F.regexp_replace(escape_markdown(s), f"[{BLANKS}]+", " ")


def truncate(s: Column, most: int = DOCX_MAX_CHARS, head: int | None = None, tail: int | None = None) -> Column:
    """The head and the tail of a long text, with a mark between that says how much is gone: struct(text, truncated, original_length, head_count, tail_count)."""
    head = most * 7 // 10 if head is None else head
    tail = most * 3 // 10 if tail is None else tail
    n = F.char_length(s)
    mark = F.concat(F.lit("\n\n[... truncated "), (n - head - tail).cast("string"), F.lit(" chars ...]\n\n"))
    long = n > most
    text = F.when(long, F.concat(F.left(s, F.lit(head)), mark, F.right(s, F.lit(tail)))).otherwise(s)
    return F.struct(text.alias("text"), long.alias("truncated"), n.alias("original_length"), F.when(long, head).otherwise(n).alias("head_count"), F.when(long, tail).otherwise(0).alias("tail_count"))


def paragraphs(s: Column) -> Column:
    """The paragraphs that are not blank."""
    return F.filter(F.split(s, "\n\\s*\n", -1), lambda p: F.length(trim(p)) > 0)


def strip_fence(s: Column) -> Column:
    """What a code fence around the whole text holds, or the text; trimmed."""
    t = trim(s)
    fence = r"(?s)^```[^\n]*\n(.*?)\n```\s*\z"
    return F.when(t.rlike(fence), trim(F.regexp_extract(t, fence, 1))).otherwise(t)


def peel_envelope(s: Column) -> Column:
    """A reply without a code fence, and without the JSON object that some models put around their text."""

    def peeled(t: Column) -> Column:
        value = F.try_variant_get(F.try_parse_json(t), "$.text", "variant")
        inside = F.startswith(t, F.lit("{")) & F.endswith(t, F.lit("}")) & (F.schema_of_variant(value) == "STRING")
        return F.when(inside, trim(F.try_variant_get(value, "$", "string"))).otherwise(t)

    return F.transform(F.array(strip_fence(s)), peeled)[0]


def seal_marks(s: Column) -> Column:
    """The seal marks of a text in order: array<struct(seal_no, owner, color, shape)>."""
    parts = F.transform(F.regexp_extract_all(s, F.lit(SEAL_MARK), F.lit(1)), lambda m: F.filter(F.transform(F.split(m, "\\|", -1), trim), lambda p: p != ""))

    def first(p: Column, at: int, hint: str) -> Column:
        return F.coalesce(F.get(p, F.lit(at)), F.get(F.filter(p, lambda x: x.rlike(hint)), F.lit(0)))

    return F.transform(
        parts,
        lambda p, i: F.struct((i + 1).alias("seal_no"), F.nullif(F.get(p, F.lit(0)), F.lit(UNKNOWN_OWNER)).alias("owner"), color(first(p, 1, COLOR_HINT)).alias("color"), shape(first(p, 2, SHAPE_HINT)).alias("shape")),
    )


def signature_marks(s: Column) -> Column:
    """array<struct(sig_no, signer)>."""
    return F.transform(F.regexp_extract_all(s, F.lit(SIGNATURE_MARK), F.lit(1)), lambda m, i: F.struct((i + 1).alias("sig_no"), F.nullif(F.nullif(trim(m), F.lit("")), F.lit(UNKNOWN_OWNER)).alias("signer")))


def _first_of(s: Column, cases: tuple[tuple[str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for part, value in reversed(cases):
        out = F.when(F.contains(s, F.lit(part)), F.lit(value)).otherwise(out)
    return out


def color(s: Column) -> Column:
    return _first_of(s, COLORS)


def shape(s: Column) -> Column:
    return _first_of(s, SHAPES)


def is_heading(line: Column) -> Column:
    return (F.char_length(line) <= HEADING_LENGTH) & ~line.rlike(HEADING_STOPS + r"\z") & line.rlike(HEADING_NOUNS + r"\z")


def is_list_item(line: Column) -> Column:
    return line.rlike(BULLET)


def starts_paragraph(previous: Column, current: Column) -> Column:
    """Whether a blank line goes between two lines of output."""
    return (previous != "") & ~previous.rlike("^(## |[-*] )") & (current.rlike(NUMBERED) | previous.rlike(SENTENCE_END))


def group_lines(lines: Column) -> Column:
    """Lines of a page as Markdown: headings, lists and paragraphs.

    What a line becomes depends on the line put out before it, and that on its own line alone (a heading ends
    in a blank line, all else in itself), so each line looks at its neighbour and nothing is carried along.
    """

    def judged(line: Column) -> Column:
        return F.struct(line.alias("line"), is_heading(line).alias("heading"), is_list_item(line).alias("item"))

    def shown(x: Column) -> Column:
        heading = F.concat(F.lit("## "), F.regexp_replace(x["line"], r"^#+\s*", ""))
        item = F.concat(F.lit("- "), F.regexp_replace(x["line"], BULLET + r"\s*", ""))
        text = F.when(x["heading"], heading).when(x["item"], item).otherwise(x["line"])
        return F.struct(x["line"].alias("line"), x["heading"].alias("heading"), x["item"].alias("item"), text.alias("shown"))

    def ended(kept: Column) -> Column:
        """For each line: a blank line before it if it needs one, itself, a blank line after a heading."""

        def with_gaps(x: Column, i: Column) -> Column:
            before = F.get(kept, i - 1)
            first, after_heading = i == 0, F.coalesce(before["heading"], F.lit(False))
            gap = ~first & ~after_heading & (x["heading"] | (~x["item"] & starts_paragraph(before["shown"], x["line"])))
            return F.concat(F.when(gap, F.lit("\n")).otherwise(""), x["shown"], F.when(x["heading"], F.lit("\n")).otherwise(""))

        return F.transform(kept, with_gaps)

    # What a line is is found out once for each, and not again at its neighbour.
    kept = F.transform(F.transform(F.filter(F.transform(lines, trim), lambda line: line != ""), judged), shown)
    joined = F.array_join(F.transform(F.array(kept), ended)[0], "\n")
    return trim(F.regexp_replace(joined, "\n{3,}", "\n\n"))


def user_prompt(body: Column, text: Column) -> Column:
    return F.concat(body, F.lit(f"\n\n{DOCUMENT_ANCHOR}\n"), text)


def number_text(x: Column) -> Column:
    """A number as ECMAScript writes it, as far as whole numbers go: no .0."""
    return F.when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def text_layer(items: Column, blanks: str | None = None) -> Column:
    """The text of a page from its items (array<struct(str, eol)>): a line end or a blank after each. blanks: the characters that are trimmed, or white space of any kind."""
    joined = F.array_join(F.transform(F.filter(items, lambda i: i["str"] != ""), lambda i: F.concat(i["str"], F.when(i["eol"], F.lit("\n")).otherwise(F.lit(" ")))), "")
    return trim(joined) if blanks is None else F.btrim(joined, F.lit(blanks))


def needs_ocr(layer: Column) -> Column:
    return F.char_length(layer) < OCR_TEXT_THRESHOLD


def strip_protocol(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(s, "^https?://", ""), "/+\\z", "")
