"""Operator 10, best-fit packing: bounded-space online best fit.

Documents become token ids (a closing id after each), long ones are cut, and the pieces go one by one
into the open sequence with the least room that still holds them. A fixed number of sequences is open;
they are kept by free room in a bitset, so the best one is the lowest set bit at or above the piece's
length. When one too many is open, the fullest closes.

Map-side, each document is encoded where it is read. Only five numbers a piece are shuffled, never texts. One
packing task takes some 200,000 pieces, in an order drawn from the ids, so its few sequences that stay
part empty do not count, and its memory is bounded.

Defined results: a null or empty text is one piece that holds the closing id alone; repeated rows are
packed as often as they occur; a null doc_id stays null; other columns are left out. An empty table gives
an empty result.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.llm.common import arrow_rows, groups_of_text, stored, table, text_of

SEQUENCE = 1024
END_ID = 2
OPEN_BINS = 4096
PIECES_PER_TASK = 200_000
#: Of the texts that the rank file's encoder does not get: those with anything but Latin letters, ASCII and usual punctuation, which the two libraries certainly class alike; with the special string; with a long run of white space, in which it may run out of steps.
OTHER = re.compile("[^\\t\\n\\r\\x20-\\x7e\\xa1-\\u024f\\u2010-\\u2026\\u20ac]|<\\|endoftext\\|>|[ \\t\\n\\r]{1000}")
#: Of those letters' range, these signs are numbers but no digits.
NUMBERS = r"\d²³¹¼½¾"
_encoders: dict[tuple, Encoder] = {}


class Encoder:
    """Token ids of texts, as little-endian bytes: those of the tokenizers library. The rank file of the same vocabulary gives the same ids in half the time, so most texts go that way; the library has the rest."""

    def __init__(self, path: str, ranks: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @classmethod
    def of(cls, path: str, ranks: str | None = None) -> Encoder:
        if (path, ranks) not in _encoders:
            _encoders[path, ranks] = cls(path, ranks)
        return _encoders[path, ranks]

    def ids(self, text: str) -> bytes:
        if self.fast is not None and not OTHER.search(text):
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
        import numpy as np

        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def pieces(docs: DataFrame, path: str, ranks: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32."""
    end = end_id.to_bytes(4, "little")

    def run(batches):
        import pyarrow as pa

        encoder = Encoder.of(path, ranks)
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text")):
            out: list[list] = [[], [], [], [], []]
            for doc, text in group:
                ids = encoder.ids(text) + end
                n = len(ids) // 4
                first = n % sequence or sequence
                cuts = [0, *range(first, n + 1, sequence)]
                for k in range(len(cuts) - 1):
                    a, b = cuts[k], cuts[k + 1]
                    for column, value in zip(out, (doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int32()), *(pa.array(x, pa.int64()) for x in out[2:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class OpenBins:
    """Sequences that are open, by free room."""

    def __init__(self, sequence: int, most: int):
        self.sequence, self.most, self.bits, self.by_room, self.open, self.made = sequence, most, 0, [[] for _ in range(sequence + 1)], 0, 0

    def put(self, length: int) -> tuple[int, int]:
        """The sequence and the place in it that a piece of this length gets."""
        fits = self.bits >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            bins = self.by_room[room]
            at = bins.pop()
            if not bins:
                self.bits ^= 1 << room
            self.open -= 1
        else:
            at, room = self.made, self.sequence
            self.made += 1
        left = room - length
        if left:
            self.by_room[left].append(at)
            self.bits |= 1 << left
            self.open += 1
            if self.open > self.most:
                least = (self.bits & -self.bits).bit_length() - 1
                self.by_room[least].pop()
                if not self.by_room[least]:
                    self.bits ^= 1 << least
                self.open -= 1
        return at, self.sequence - room


def pack(items: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Adds sequence_id and offset to rows that have doc_id, piece and length (1 to sequence)."""
    items = stored(items)
    tasks = max(1, -(-items.count() // per_task))
    names = items.columns
    schema = T.StructType([*items.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        bins, part = OpenBins(sequence, open_bins), TaskContext.get().partitionId()
        for batch in batches:
            put = [bins.put(n) for n in batch.column("length").to_pylist()]
            ids, at = pa.array([(part << 40) + x for x, _ in put], pa.int64()), pa.array([x for _, x in put], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, ids, at], [*names, "sequence_id", "offset"])

    # Whole pieces of a full sequence come anywhere; the order is drawn from the ids, so that long and short pieces mix, and is the same in each run.
    key = F.xxhash64("doc_id", "piece", "length")
    dealt = items.repartition(tasks, key).sortWithinPartitions(key, "doc_id", "piece", *(c for c in names if c not in ("doc_id", "piece")))
    return dealt.mapInArrow(run, schema)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def best_fit_packing(docs: DataFrame, path: str | None = None, ranks: str | None = None, sequence: int = SEQUENCE, end_id: int = END_ID, open_bins: int = OPEN_BINS) -> DataFrame:
    """docs (doc_id, text) as packed pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset. ranks is the rank file of the tokenizer's vocabulary, if there is one."""
    if path is None:
        path, ranks = tokenizer_path(), tokenizer_path("byte_bpe_50k.tiktoken")
    return pack(pieces(docs, path, ranks, sequence, end_id), sequence, open_bins)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))
