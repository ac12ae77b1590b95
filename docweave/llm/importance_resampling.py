"""Operator 13, target-distribution importance resampling: draw the documents that look like a target.

Features are runs of 1 to 3 words, hashed into buckets. The counts of all documents and of the target give
each bucket a gain, a document's weight is the sum of its features' gains, and adding Gumbel noise to the
weight and taking the highest scores draws documents without replacement in proportion to their weights.

Long texts are cut into overlapping chunks at word boundaries: a chunk owns the words that start in it and
carries the next n-1 words along, so each run of words starts in exactly one chunk and is whole there. The
chunks of long texts are dealt to all tasks, their counts and weights are summed by document; texts of one
chunk never leave their task. Words are split within chunks of bounded bytes, so a text's length does not
matter (a single longer word stays whole).

Bucket counts leave a task as at most one row a bucket. The gains are one number a bucket, whatever the
input. The rank in the whole is taken by range partitions of the scores and their counts, not by one task.

Defined results: a null or empty text has no words, no features and weight 0; repeated rows are documents
of their own with equal results (which of them ranks first is open, they are alike); rows that share a
doc_id with different texts are weighed each; a null doc_id is drawn as the empty string and comes last of
ties; other columns are left out; an empty table gives an empty result, and without a target all its counts
are 0.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, checkpointed, groups_of_text, stored, table, text_of

BUCKETS = 10_000
#: The longest run of words that is a feature.
RUN = 3
#: Bytes that a chunk owns; a longer text is cut.
CHUNK = 1 << 15
LEAST_WORDS, PER_CENT, SEED = 20, 5, 42
#: A-Z in lower case, what is no word (of ASCII) as a blank.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def chunks(text: bytes, size: int = CHUNK, run: int = RUN) -> Iterator[tuple[int, bytes, int]]:
    """The text, whose words are parted by blanks, as (number, words, carried): the last `carried` words belong to the next chunks."""
    at, no = 0, 0
    while at < len(text):
        end = text.find(b" ", at + size) if at + size < len(text) else -1
        end = len(text) if end < 0 else end
        last, carried = end, 0
        while carried < run - 1:
            start = last
            while start < len(text) and text[start] == 32:
                start += 1
            if start == len(text):
                break
            stop = text.find(b" ", start)
            last, carried = len(text) if stop < 0 else stop, carried + 1
        yield no, text[at:last], carried
        at, no = end, no + 1


def buckets_of(words: list[bytes], carried: int = 0, run: int = RUN, buckets: int = BUCKETS):
    """The buckets of the runs that start in the words before the carried ones."""
    import numpy as np

    own, parts = len(words) - carried, []
    sums, next_words = list(map(zlib.crc32, words[:own])), [b" " + w for w in words]
    for k in range(run):
        if k:  # a checksum goes on from the one of the run before
            sums = list(map(zlib.crc32, next_words[k : k + own], sums))
        parts.append(np.array(sums, dtype=np.int64))
    return np.concatenate(parts) % buckets if parts else np.zeros(0, np.int64)


def keyed(docs: DataFrame) -> DataFrame:
    """docs as doc_id, text_hash (which tell texts apart) and words: the text's bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), text_of().cast("binary").alias("words"))


def chunks_of_long(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """The chunks of texts of more than `size` bytes, dealt over all tasks: doc_id, text_hash, chunk, words, carried."""

    def cut(batches):
        import pyarrow as pa

        spread = 0  # copies of one text have equal chunks; this keeps them from meeting in one task
        for doc, words, text_hash in arrow_rows(batches, "doc_id", "words", "text_hash"):
            for no, part, carried in chunks(words.translate(TABLE), size):
                arrays = [pa.array([doc], pa.int64()), pa.array([text_hash], pa.int64()), pa.array([no], pa.int64()), pa.array([part], pa.binary()), pa.array([carried], pa.int32()), pa.array([spread], pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_hash", "chunk", "words", "carried", "spread"])
                spread += 1

    cut_up = texts.where(F.octet_length("words") > size).mapInArrow(cut, "doc_id long, text_hash long, chunk long, words binary, carried int, spread long")
    return cut_up.repartition("doc_id", "text_hash", "chunk", "spread").drop("spread")


def whole_texts(texts: DataFrame, size: int = CHUNK) -> DataFrame:
    """The texts of one chunk, where they are."""
    return texts.where(F.octet_length("words") <= size).select("doc_id", "text_hash", F.lit(0).cast("long").alias("chunk"), "words", F.lit(0).alias("carried"))


def bucket_counts(docs: DataFrame, run: int = RUN, buckets: int = BUCKETS, size: int = CHUNK) -> list[int]:
    """How many features of all docs are in each bucket."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        found = np.zeros(buckets, np.int64)
        for group in groups_of_text(arrow_rows(batches, "carried", "words")):
            for carried, words in group:
                found += np.bincount(buckets_of(words.translate(TABLE).split(), carried, run, buckets), minlength=buckets)
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(found[held], pa.int64())], ["bucket", "n"])

    texts = keyed(docs)
    rows = whole_texts(texts, size).unionByName(chunks_of_long(texts, size)).mapInArrow(count, "bucket long, n long")
    found = dict(rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect())  # at most one row a bucket
    return [found.get(k, 0) for k in range(buckets)]


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """Of each bucket, a thousand times how much likelier the target has it, as logarithm; add-one smoothed."""
    n, s, t = len(corpus), float(sum(corpus)), float(sum(target))
    return [math.floor(1000 * math.log((b + 1.0) * (s + n) / ((a + 1.0) * (t + n)))) for a, b in zip(corpus, target, strict=True)]


def weights(docs: DataFrame, of_bucket: list[int], run: int = RUN, size: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) as doc_id, text_hash, n_words, n_features, weight; a row for each row."""
    names = ["doc_id", "text_hash", "chunk", "n_words", "n_features", "weight"]

    def weigh(batches):
        import numpy as np
        import pyarrow as pa

        gain = np.array(of_bucket, np.int64)
        for group in groups_of_text(arrow_rows(batches, "carried", "words", "doc_id", "text_hash", "chunk")):
            rows = []
            for carried, words, doc, text_hash, no in group:
                split = words.translate(TABLE).split()
                found = buckets_of(split, carried, run, len(of_bucket))
                rows.append((doc, text_hash, no, len(split) - carried, len(found), int(gain[found].sum())))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    schema, texts = ", ".join(f"{c} long" for c in names), keyed(docs)
    short = whole_texts(texts, size).mapInArrow(weigh, schema).drop("chunk")
    # Copies of a long text under one id have summed their chunks together; each has its share of the sum.
    sums = chunks_of_long(texts, size).mapInArrow(weigh, schema).groupBy("doc_id", "text_hash")
    sums = sums.agg(*(F.expr(f"sum({c}) div count_if(chunk = 0)").alias(c) for c in names[3:]))
    rows = texts.where(F.octet_length("words") > size).select("doc_id", "text_hash")
    keys = [F.col("l.doc_id").eqNullSafe(F.col("s.doc_id")), F.col("l.text_hash") == F.col("s.text_hash")]
    return short.unionByName(rows.alias("l").join(sums.alias("s"), keys).select("l.doc_id", "l.text_hash", "s.n_words", "s.n_features", "s.weight"))


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """A thousand times the Gumbel noise that the id draws."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], column: str) -> DataFrame:
    """rows (a stored table) with their number in the given order, from 1, in the column: range partitions, their counts added up, a row's place in its partition."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The checkpoint holds partitions and order, so that both passes see the same even if an executor is lost.
    ordered = checkpointed(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order))
    numbered = ordered.withColumn("__at", F.monotonically_increasing_id()).withColumns({"__part": F.shiftright("__at", 33), "__at": F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = {r["__part"]: r["n"] for r in numbered.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # as many as partitions
    before = list(accumulate((counts.get(k, 0) for k in range(max(counts, default=-1) + 1)), initial=0))
    starts = spark.createDataFrame([(k, n) for k, n in enumerate(before)], "__part long, __start long")
    return numbered.join(F.broadcast(starts), "__part").withColumn(column, F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED, run: int = RUN, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_features, weight, score, rank; target has doc_id (any) and text.

    Of the documents with enough words the given share is drawn; rank is null for all others.
    """
    of_bucket = gains(bucket_counts(docs, run, buckets, chunk), bucket_counts(target, run, buckets, chunk))
    scored = weights(docs, of_bucket, run, chunk).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = stored(scored)
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = per_cent * fit.count() // 100
    placed = ranked(fit, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("text_hash")], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).drop("text_hash")


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    out = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), target)
    return out.select("doc_id", "n_features", "weight", "score", "rank")
