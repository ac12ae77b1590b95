"""Operator 8, secret scans: a trigram inverted index.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must
contain, in lower case, as clauses (trigrams that must all be there) of which one must hold. The index
stores the postings (trigram, document) of the trigrams that some clause asks for. Each clause is answered
from its rarest trigram on: that one's postings, kept as far as the next one's have them, up to TERMS
trigrams. The documents of any clause are the rule's candidates, and only those are searched with the
expression. A rule without mandatory trigrams searches all texts.

Spans come from built-in expressions alone: the text between the matches (split) and the matches
themselves (regexp_extract_all) have lengths whose running sums, taken by doubling, are the places. Offsets count code points,
the end is exclusive. Matches are leftmost and do not overlap within a rule.

The candidates' ids are broadcast if a count shows that they are few; else texts and candidates are
shuffled by document. A posting is a few numbers, and a frequent trigram only means many postings, which
are joined by clause and document and never by trigram alone.

Defined results: a null or empty text has no spans; repeated rows get the same result each; rows that
share a doc_id are searched each in their own text; a null doc_id is kept; other columns are left out; an
empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import let, lower_ascii, small, stored, table

_parser = re._parser  # Python's own parser of regular expressions


@dataclass(frozen=True)
class Rule:
    """A match of pattern counts if group has at least `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base rules come first; a rule's place breaks ties between spans with the same start.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    # The same matches as those of [0-9a-f]+ with 32 characters or more.
    Rule("hex", r"[0-9a-f]{32,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_bot", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)
#: Strings that a run of pattern elements may stand for, and characters of a class, before it counts as anything.
MOST_STRINGS, MOST_CHARACTERS = 64, 6
#: Trigrams of a clause whose postings are intersected; the expression then says the rest.
TERMS = 3
#: Clauses of a rule; a query that would have more counts as True.
MOST_CLAUSES = 256

# A query is True (anything), ("tri", trigram), ("and", queries) or ("or", queries).


def _and(parts: list) -> object:
    parts = list(dict.fromkeys(p for p in parts if p is not True))
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _or(parts: list) -> object:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _strings(found: set[str]) -> object:
    """The query that a text holds one of the strings. A string that asks for all that another one does and more adds nothing."""
    sets = {frozenset(s[k : k + 3] for k in range(len(s) - 2)) for s in found}
    least = [x for x in sets if not any(y < x for y in sets)]
    return _or([_and([("tri", t) for t in sorted(x)]) for x in sorted(least, key=sorted)])


def _read(items) -> tuple[set[str] | None, object]:
    """The strings that a sequence stands for, if they are few, and the query of what it must contain."""
    now, parts, exact = {""}, [], True
    for op, arg in items:
        name, strings, query = str(op), None, True
        if name == "LITERAL":
            strings = {chr(arg).lower()}
        elif name == "IN" and all(str(k) in ("LITERAL", "RANGE") for k, _ in arg):
            chars = {c.lower() for k, v in arg for c in (chr(v) if str(k) == "LITERAL" else map(chr, range(v[0], min(v[1] + 1, v[0] + 99))))}
            strings = chars if len(chars) <= MOST_CHARACTERS else None
        elif name == "SUBPATTERN":
            strings, query = _read(arg[-1])
        elif name == "BRANCH":
            ways = [_read(x) for x in arg[1]]
            query = _or([q for _, q in ways])
            if all(s is not None for s, _ in ways):
                strings = set().union(*(s for s, _ in ways))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, inner = arg
            one, inner_query = _read(inner)
            if one is not None and (low, int(high)) in ((0, 1), (1, 1)):
                strings = one | ({""} if low == 0 else set())
            query = inner_query if low else True
        elif name == "AT":
            strings = {""}
        if strings is not None and len(now) * len(strings) <= MOST_STRINGS:
            now = {a + b for a in now for b in strings}
        else:
            parts += [_strings(now), query if strings is None else _strings(strings)]
            now, exact = {""}, False
    return (now, _strings(now)) if exact else (None, _and([*parts, _strings(now)]))


def trigram_query(pattern: str) -> object:
    """What a text in lower case must contain to have a match."""
    return _read(_parser.parse(pattern))[1]


def trigrams_of(query: object) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(trigrams_of, query[1]))


def clauses_of(query: object) -> list[frozenset[str]]:
    """The query as sets of trigrams: one of the sets must be in the text as a whole. An empty set stands for any text."""
    if query is True:
        return [frozenset()]
    if query[0] == "tri":
        return [frozenset([query[1]])]
    ways = [clauses_of(q) for q in query[1]]
    if query[0] == "or":
        found = {c for w in ways for c in w}
    else:
        found = {frozenset()}
        for w in sorted(ways, key=len):
            if len(found) * len(w) <= MOST_CLAUSES:  # a part that is left out only makes the query ask for less
                found = {a | b for a in found for b in w}
    return sorted((c for c in found if not any(d < c for d in found)), key=sorted)


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The postings, stored: trigram, doc_id, text_hash."""
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), lower_ascii(F.col("text")).alias("low"))
    held = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams))) if trigrams else F.array().cast("array<string>")
    return stored(rows.select("doc_id", "text_hash", F.explode(held).alias("trigram")))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], terms: int = TERMS) -> DataFrame:
    """doc_id, text_hash, rules (the numbers of those that may match): of rules with mandatory trigrams."""
    spark = docs.sparkSession
    asked = [(k, c) for k, r in enumerate(rules) if frozenset() not in (found := clauses_of(trigram_query(r.pattern))) for c in found]
    index = trigram_index(docs, sorted(set().union(*(c for _, c in asked))) if asked else [])
    n = {r["trigram"]: r["n"] for r in index.groupBy("trigram").agg(F.count("*").alias("n")).collect()}  # as many as the rules ask for
    # One trigram without postings answers its clause.
    ranked = [(no, k, rank, t) for no, (k, c) in enumerate(asked) if c <= n.keys() for rank, t in enumerate(sorted(c, key=lambda t: (n[t], t))[:terms])]
    plan = F.broadcast(spark.createDataFrame(ranked, "clause int, rule int, rank int, trigram string"))
    last = {no: rank for no, _, rank, _ in ranked}
    posting = lambda rank: index.join(plan.where(F.col("rank") == rank), "trigram").select("clause", "rule", "doc_id", "text_hash")
    left, done = posting(0), []
    for rank in range(1, max(last.values(), default=0) + 1):
        longer = F.col("clause").isin([no for no, top in last.items() if top >= rank])
        done.append(left.where(~longer))
        keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("clause", "doc_id", "text_hash")]
        left = left.where(longer).alias("a").join(posting(rank).alias("b"), keys, "left_semi")
    found = reduce(DataFrame.unionByName, [*done, left])
    return found.groupBy("doc_id", "text_hash").agg(F.collect_set("rule").alias("rules"))


NO_SPANS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def running_sums(numbers: Column) -> Column:
    """Of each number all up to it, by doubling: each round adds the sums that end 1, 2, 4 ... places before."""

    def add(sums: Column, k: Column) -> Column:
        apart = F.least(F.call_function("shiftleft", F.lit(1), k), F.size(sums))
        before = F.concat(F.array_repeat(F.lit(0), apart), F.slice(sums, F.lit(1), F.size(sums) - apart))
        return F.zip_with(sums, before, lambda a, b: a + b)

    rounds = F.ceil(F.log2(F.greatest(F.size(numbers), F.lit(1)))).cast("int")
    return F.aggregate(F.filter(F.sequence(F.lit(0), rounds), lambda k: k < rounds), numbers, add)


def spans(text: Column, rule: Rule, rank: int) -> Column:
    """The rule's spans in the text, in order."""
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    length = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    # The gap before each match, the match and what must be long, as lengths; the gap after the last match is left out.
    pairs = F.zip_with(F.zip_with(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("m"))), length, lambda p, v: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), F.char_length(v).alias("v")))

    def placed(ps: Column) -> Column:
        def one(p: Column, end: Column) -> Column:
            return F.struct((end - p["m"]).alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(rule.kind).alias("kind"), p["v"].alias("v"))

        spans_ = F.zip_with(ps, running_sums(F.transform(ps, lambda p: p["gap"] + p["m"])), one)
        return F.transform(F.filter(spans_, lambda x: x["v"] >= rule.least), lambda x: x.dropFields("v"))

    return F.when(text.rlike(rule.pattern), let(pairs, placed)).otherwise(F.array().cast(NO_SPANS))


def secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """docs (doc_id, text) as doc_id, spans (start, rank, end, kind; by start, then by rule)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = stored(candidates(docs, rules))
    keys = [F.col("d.doc_id").eqNullSafe(F.col("c.doc_id")), F.col("d.text_hash") == F.col("c.text_hash")]
    rows = docs.withColumn("text_hash", F.xxhash64("text")).alias("d").join(small(found, found.count()).alias("c"), keys, "left").select("d.doc_id", "text", "rules")
    parts = []
    for k, rule in enumerate(rules):
        own = spans(F.col("text"), rule, k)
        parts.append(own if trigram_query(rule.pattern) is True else F.when(F.array_contains("rules", k), own).otherwise(F.array().cast(NO_SPANS)))
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("spans"))


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secret_scan(table(spark, sf_dir, "documents"))
    of_rule = lambda k: lambda s: s["rank"] == k
    n = [F.size(F.filter("spans", of_rule(k))).cast("long").alias(f"n_{r.kind}") for k, r in enumerate(BASE)]
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return out.select("doc_id", *n, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
