"""Operator 12, personal data: base patterns, and bootstrapped contextual extraction beyond them.

What the base expressions find are the seeds. The words before them (the last one, two and three) are
lexical patterns; so are the words before any other string that looks like an identifier (a candidate).
Patterns and instances make a graph, weighted by how often they meet. Spark scores it in rounds:

- a pattern's confidence for a kind is the share of all its places in the corpus, whatever follows there,
  that instances of the kind follow, each by its reliability, and less for few different instances;
- only patterns of high confidence make other instances reliable, which is 1 - product(1 - confidence);
- those count in the next round, so patterns that no seed has can come in.

In the end, candidates that follow a pattern of high confidence are spans of that kind, named `<kind>_like`.
Base spans always stay. Ordinary prose gives no patterns: "the" precedes some identifiers, but mostly not.

A pattern's places are counted over all texts, but only those of patterns with enough different
instances: their hashes are set in a filter of fixed size that is broadcast, what passes it is counted by
task, shuffled as counts and joined exactly. Rounds are joins and sums of the graph's edges, stored each.

A context is taken from the CONTEXT characters before an instance. A candidate has at most LONGEST
characters and is no part of a base span; both are what the words mean here, at every size of input.

Defined results: a null or empty text has no spans; repeated rows get the same result each; rows that share
a doc_id are searched each in their own text; a null doc_id is kept; other columns are left out; an empty
table gives an empty result. Offsets count code points, the end is exclusive. Of two kinds at one place
the one of higher confidence is taken, of equal ones the first as listed.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, groups_of_text, stored, table, text_of

KINDS = ("email", "ip", "card", "phone")
BLANKS = " \t\n\x0b\f\r"
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
GROUPED = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile("[0-9]")
#: Where a candidate may be, and how it goes on over a blank.
MARK, AT_SIGN, NUMBER, BLANK = re.compile("[0-9@]"), re.compile(r"[(\[]at[)\]]"), re.compile("[0-9().+/-]*[0-9][0-9().+/-]*"), re.compile("[\x20\x09-\x0d]")
HEAD, TAIL = re.compile(r"[^A-Za-z0-9+(]*"), re.compile(r"[^A-Za-z0-9)]*$")
LEAST_DIGITS, LEAST, LONGEST = 4, 5, 64
#: Characters before an instance that its context is taken from, and words of a context.
CONTEXT, WORDS = 100, 3
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Different instances that a pattern must have, the confidence that is high, and rounds.
SUPPORT, HIGH, ROUNDS = 3, 0.5, 3
#: Bits of the filter over patterns: 8 MB at every size of the input.
FILTER_BITS = 1 << 26


def luhn(digits: str) -> bool:
    double = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(double[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """By the @ signs, so that a long text without one costs nothing: as many local characters before it as there are, a domain after it."""
    end, at, since = 0, text.find("@"), 0
    while at >= 0:
        before = text[max(end, since) : at]
        start = max(end, since) + len(before.rstrip(LOCAL))
        if start < at and (found := DOMAIN.match(text, at + 1)):
            end = found.end()
            yield start, end
        since, at = at + 1, text.find("@", max(at + 1, end))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Four parts of a chain of numbers and points, then the next four."""
    for chain in DOTTED.finditer(text):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in four):
                yield at, end
            at = end + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """kind, start, end by kind, then start."""
    found = [(0, *s) for s in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        found += [(1, *s) for s in addresses(text)]
        found += [(2, *m.span()) for m in GROUPED.finditer(text) if 16 <= m.end() - m.start() and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d)]
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Strings that look like identifiers and meet none of the taken spans (by start): what is between blanks and has digits or an at sign, without signs around it and what a colon or equals sign parts from it; numbers with single blanks between them are one."""
    starts = [s for s, _ in taken]
    ends, top = [], 0
    for _, e in taken:
        top = max(top, e)
        ends.append(top)
    places = {MARK: -1, AT_SIGN: -1 if "at)" in text or "at]" in text else len(text)}  # the next of each
    last = 0
    while True:
        for sign, at in places.items():
            if at < last:
                places[sign] = m.start() if (m := sign.search(text, last)) else len(text)
        mark = min(places.values())
        if mark == len(text):
            return
        start = max(last, *(text.rfind(c, last, mark) + 1 for c in BLANKS))
        stop = lambda at: m.start() if (m := BLANK.search(text, at)) else len(text)
        end = stop(mark)
        if end - start <= LONGEST and NUMBER.fullmatch(text, start, end):
            while text[end : end + 1] == " " and (further := stop(end + 1)) - start <= LONGEST and NUMBER.fullmatch(text, end + 1, further):
                end = further
        last = end
        if end - start > 4 * LONGEST:
            continue
        core = text[start:end]
        for sign in ":=":
            core = core[core.rfind(sign) + 1 :] if MARK.search(core, core.rfind(sign) + 1) else core
        core = core[HEAD.match(core).end() :]
        start = end - len(core)
        core = core[: TAIL.search(core).start()]
        end = start + len(core)
        if not LEAST <= len(core) <= LONGEST or (len(DIGIT.findall(core)) < LEAST_DIGITS and "@" not in core and not AT_SIGN.search(core)):
            continue
        k = bisect_right(starts, end - 1) - 1
        if k < 0 or ends[k] <= start:
            yield start, end


def contexts(text: str, start: int) -> list[str]:
    """The last one, two and three words (or signs) before a place."""
    low = max(0, start - CONTEXT)
    window = text[low:start]
    words = TOKEN.findall(window.lower())
    if low and re.match(r"\w", window) and re.match(r"\w", text[low - 1]):
        words = words[1:]  # a part of a word
    return [" ".join(words[-k:]) for k in range(1, WORDS + 1) if k <= len(words)]


SPANS = "array<struct<kind:int,start:int,end:int>>"
FOUND = "array<struct<kind:int,start:int,end:int,instance:string,contexts:array<string>>>"


def found_in(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, text_hash, base (the base spans) and found (base spans and candidates, whose kind is -1, with their contexts), stored."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        span = [("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]
        types = pa.list_(pa.struct(span)), pa.list_(pa.struct([*span, ("instance", pa.string()), ("contexts", pa.list_(pa.string()))]))
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text", "text_hash")):
            base, found = [], []
            for _, text, _ in group:
                own = base_spans(text)
                every = own + [(-1, *s) for s in candidates(text, sorted(s[1:] for s in own))] if own or MARK.search(text) or "at" in text else []
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
                found.append([{"kind": k, "start": s, "end": e, "instance": hashlib.md5(text[s:e].lower().encode()).hexdigest(), "contexts": contexts(text, s)} for k, s, e in every])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in group], pa.int64()), pa.array([h for _, _, h in group], pa.int64()), pa.array(base, types[0]), pa.array(found, types[1])], ["doc_id", "text_hash", "base", "found"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"), F.xxhash64("text").alias("text_hash"))
    return stored(rows.mapInArrow(run, f"doc_id long, text_hash long, base {SPANS}, found {FOUND}"))


def mentions(found: DataFrame) -> DataFrame:
    """A row for each instance and context: doc_id, text_hash, kind, start, end, instance, pattern."""
    return found.select("doc_id", "text_hash", F.explode("found").alias("x")).select("doc_id", "text_hash", "x.kind", "x.start", "x.end", "x.instance", F.explode("x.contexts").alias("pattern"))


def filter_of(patterns: DataFrame) -> bytes:
    """The filter: a bit for each pattern's checksum."""
    bit = F.crc32(F.col("pattern").cast("binary")) % FILTER_BITS + 1
    parts = patterns.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("no")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    whole = bytearray(FILTER_BITS // 8)
    for r in parts.toLocalIterator():  # at most FILTER_BITS / 32768 rows of 4 KB
        at = (r["no"] - 1) * 4096
        whole[at : at + len(r["bits"])] = r["bits"]
    return bytes(whole)


def places(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """How often each of the patterns is in all texts, whatever follows: pattern, total."""
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(patterns))

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pattern", "n"])
            counts.clear()
            return batch

        held, counts = np.frombuffer(bits.value, np.uint8), Counter()
        for (text,) in arrow_rows(batches, "text"):
            words = TOKEN.findall(text.lower())
            plain = [w.encode() for w in words]
            sums, after = [], [b" " + w for w in plain]
            for k in range(WORDS):
                sums = list(map(zlib.crc32, after[k:], sums)) if k else list(map(zlib.crc32, plain))
                place = np.array(sums, np.int64) % FILTER_BITS
                hit = np.flatnonzero(held[place >> 3] >> (place & 7).astype(np.uint8) & 1)
                counts.update(" ".join(words[i : i + k + 1]) for i in hit.tolist())
            if len(counts) > 100_000:
                yield given()
        yield given()

    rows = docs.select(text_of().alias("text")).mapInArrow(run, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("total"))
    return rows.join(patterns.select("pattern"), "pattern", "left_semi")


def scored_patterns(docs: DataFrame, found: DataFrame, support: int = SUPPORT, high: float = HIGH, rounds: int = ROUNDS) -> DataFrame:
    """The patterns of high confidence: pattern, kind (its number), score."""
    edges = stored(mentions(found).groupBy("pattern", "instance", "kind").agg(F.count("*").alias("n")))
    patterns = stored(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= support))
    edges = stored(edges.join(places(docs, patterns), "pattern"))
    every, of_kind = range(len(KINDS)), lambda k: F.when(F.col("kind") == k, F.col("n")).otherwise(0)
    seeded = edges.groupBy("pattern").agg(F.max("total").alias("total"), *(F.sum(of_kind(k)).alias(f"n{k}") for k in every), *(F.count_if(F.col("kind") == k).alias(f"s{k}") for k in every))
    seeded, unknown = stored(seeded), edges.where("kind < 0").select("pattern", "instance", "n")
    instances = None
    for _ in range(rounds):
        if instances is None:
            known = seeded
        else:
            grown = unknown.join(instances, "instance").groupBy("pattern")
            grown = grown.agg(*(F.sum(F.col("n") * F.col(f"r{k}")).alias(f"gn{k}") for k in every), *(F.sum(f"r{k}").alias(f"gs{k}") for k in every))
            add = lambda c: (F.col(c) + F.coalesce(f"g{c}", F.lit(0.0))).alias(c)
            known = seeded.join(grown, "pattern", "left").select("pattern", "total", *(add(f"{c}{k}") for k in every for c in "ns"))
        # Rounded, since sums of fractions depend on their order in the last digits.
        score = lambda k: F.when(F.col(f"s{k}") >= support, F.round(F.least(F.lit(1.0), F.col(f"n{k}") / F.col("total")) * F.col(f"s{k}") / (F.col(f"s{k}") + 1), 6)).otherwise(0.0)
        ranked = F.array_sort(F.array(*(F.struct((-score(k)).alias("minus"), F.lit(k).alias("kind")) for k in every)))[0]
        patterns = stored(known.select("pattern", ranked.alias("top")).where(-F.col("top.minus") >= high).select("pattern", "top.kind", (-F.col("top.minus")).alias("score")))
        doubt = lambda k: F.sum(F.when(F.col("kind") == k, F.log1p(-F.col("score"))).otherwise(0.0))
        instances = stored(unknown.join(patterns, "pattern").groupBy("instance").agg(*(F.round(1 - F.exp(doubt(k)), 6).alias(f"r{k}") for k in every)))
    return patterns


def pii(docs: DataFrame, support: int = SUPPORT, high: float = HIGH, rounds: int = ROUNDS) -> DataFrame:
    """docs (doc_id, text) as doc_id, base and more: arrays of spans (kind, start, end) by kind, then start; kinds are numbers in KINDS."""
    docs = docs.select("doc_id", "text")
    found = found_in(docs)
    patterns = scored_patterns(docs, found, support, high, rounds)
    hits = mentions(found).where("kind < 0").drop("kind", "instance").join(patterns, "pattern")
    best = hits.groupBy("doc_id", "text_hash", "start", "end").agg(F.min(F.struct((-F.col("score")).alias("minus"), "kind")).alias("top"))
    more = best.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct("top.kind", "start", "end"))).alias("more"))
    keys = [F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("d.text_hash") == F.col("m.text_hash")]
    return found.alias("d").join(more.alias("m"), keys, "left").select("d.doc_id", "d.base", F.coalesce("m.more", F.array().cast(SPANS)).alias("more"))


def listed(spans: Column, names: list[str]) -> Column:
    of_kind = F.array(*(F.lit(n) for n in names))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(of_kind, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii(table(spark, sf_dir, "documents"))
    base, more = listed(F.col("base"), list(KINDS)), listed(F.col("more"), [f"{k}_like" for k in KINDS])
    of_kind = lambda k: lambda s: s["kind"] == k
    n = [F.size(F.filter("base", of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *n, F.sha2(base.cast("binary"), 256).alias("base_sha256"), F.concat_ws(",", F.nullif(base, F.lit("")), F.nullif(more, F.lit(""))).alias("spans"))
