"""Operator 1, token counts: a map-side lookup in two tiers, without a shuffle of pre-tokens.

No token crosses a pre-token, so a text's count is the sum over its pre-tokens. Tier one is a table of
the lengths of frequent pre-tokens: each task counts all pre-tokens that it reads in a summary of bounded
size, summaries are merged level by level (each level reads many of the level below in one task, and
nothing is dealt by key), and the at most FREQUENT most counted ones are encoded once and broadcast as one
text and one byte a length. The bound is fixed, not a share of the data; what the table holds changes
speed and never a count. Tier two encodes what the table lacks with the library and keeps it in a cache of
the worker that is bounded in bytes.

Defined results: a null or empty text has no bytes and no tokens; repeated rows are counted each; a null
doc_id stays null; other columns are left out; an empty table gives an empty result. Texts are never cut.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.best_fit_packing import NUMBERS, tokenizer_path
from docweave.llm.common import arrow_rows, groups_of_text, stored, table, text_of

LIMIT = 2048
FREQUENT = 32_768
#: The longest pre-token that is kept, in characters.
LONGEST = 64
#: Pre-tokens that a summary holds and gives on.
SUMMARY, GIVEN = 100_000, 8_192
#: What a worker's cache may hold, in bytes.
CACHE_BYTES = 256 << 20
#: Texts of Latin letters, ASCII and usual punctuation alone are split into pre-tokens here. Others, and those with a special string, are split at blanks instead: the library drops white space, so no token crosses that either.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2026\\u20ac]|<\\|(?:start|end)oftext\\|>")
#: Pre-tokens of such texts in lower case as word_bpe_49k.json splits them: letters, single numbers, contractions, other signs.
PATTERN = rf"[^\W_{NUMBERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|(?:[^\w\s]|_)+"
_state: dict[tuple, Lengths] = {}


def chunks(text: str) -> list[str]:
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


class Lengths:
    """The library's tokenizer, how texts are split, and the lengths that a worker knows."""

    def __init__(self, path: str, pattern: str | None = PATTERN):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.find = Tokenizer.from_file(path), pattern and re.compile(pattern).findall
        self.known: dict[str, int] = {"": 0}
        self.tier_one: dict[str, int] = {}
        self.held, self.of_table = 0, None

    @classmethod
    def of(cls, path: str, pattern: str | None = PATTERN) -> Lengths:
        if (path, pattern) not in _state:
            _state[path, pattern] = cls(path, pattern)
        return _state[path, pattern]

    def split(self, text: str) -> list[str]:
        return self.find(text.lower()) if self.find and not OTHER.search(text) else chunks(text)

    def lengths(self, tokens: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch_fast(tokens, add_special_tokens=False)]

    def use(self, name: object, tokens: str, lengths: bytes) -> None:
        """Takes over tier one, once a worker."""
        if self.of_table != name:
            self.of_table, self.tier_one = name, dict(zip(tokens.split("\n"), lengths, strict=True)) if lengths else {}
            self.known.update(self.tier_one)

    def counts(self, texts: list[str]) -> list[int]:
        split = list(map(self.split, texts))
        if self.held > CACHE_BYTES:
            self.known, self.held = {"": 0, **self.tier_one}, 0
        new: set[str] = set()
        for s in split:
            new.update(s)
        new.difference_update(self.known)
        fresh = list(new)
        found = dict(zip(fresh, self.lengths(fresh), strict=True))
        long = {t: found.pop(t) for t in fresh if len(t) > LONGEST}  # only for this call
        self.held += sum(map(len, found)) + 200 * len(found)
        self.known.update(found)
        get = {**self.known, **long}.__getitem__ if long else self.known.__getitem__
        return [sum(map(get, s)) for s in split]


def frequent_tokens(docs: DataFrame, path: str, pattern: str | None = PATTERN, most: int = FREQUENT) -> list[str]:
    """The pre-tokens that the summaries counted most; at most `most`, each of at most LONGEST characters."""
    schema = "token string, n long"

    def given(counts: Counter, n: int):
        import pyarrow as pa

        top = [(c, n) for c, n in counts.most_common(n) if 0 < len(c) <= LONGEST and "\n" not in c]
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["token", "n"])

    def lighter(counts: Counter) -> Counter:
        return Counter(dict(counts.most_common(SUMMARY // 2))) if len(counts) > SUMMARY else counts

    def summary(batches):
        counts, split = Counter(), Lengths.of(path, pattern).split
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text")):
            for _, text in group:
                counts.update(split(text))
            counts = lighter(counts)
        yield given(counts, GIVEN)

    def merge(batches):
        counts = Counter()
        for batch in batches:
            for token, n in zip(batch.column("token").to_pylist(), batch.column("n").to_pylist(), strict=True):
                counts[token] += n
            counts = lighter(counts)
        yield given(counts, max(GIVEN, most))

    level = stored(docs.mapInArrow(summary, schema))
    parts = level.rdd.getNumPartitions()
    while parts > 1:  # neighbours are put together, nothing is shuffled
        parts = -(-parts // 16)
        level = stored(level.coalesce(parts).mapInArrow(merge, schema))
    total: Counter = Counter()
    for r in level.toLocalIterator():
        total[r["token"]] += r["n"]
    return [t for t, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:most]]


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT, frequent: int = FREQUENT, pattern: str | None = PATTERN) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_bytes, n_tokens, over_limit. pattern must split like the tokenizer; without one texts are split at blanks."""
    path = path or tokenizer_path("word_bpe_49k.json")
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))
    known = frequent_tokens(docs, path, pattern, frequent)
    sizes = Lengths.of(path, pattern).lengths(known)
    fits = [(t, n) for t, n in zip(known, sizes, strict=True) if n < 256]
    tier_one = docs.sparkSession.sparkContext.broadcast(("\n".join(t for t, _ in fits), bytes(n for _, n in fits)))
    name = uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        lengths = Lengths.of(path, pattern)
        lengths.use(name, *tier_one.value)
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text")):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in group], pa.int64()), pa.array([len(t.encode()) for _, t in group], pa.int64()), pa.array(lengths.counts([t for _, t in group]), pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    return docs.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
