"""Operator 9, LM scoring: marginal likelihood of a lattice of subwords.

The model gives a text the sum of the probabilities of all ways to spell it with the pieces of an
existing vocabulary, closed by an end. Pieces never cross white space, so the sum is a product over
words, and a word's sum is one forward recursion in log space over its lattice. The vocabulary's scores alone
say which piece weighs more than which: its scores are ranks, and a weight is rank ** -exponent. The exponent,
one number, is the likeliest for the pieces of the training texts as the vocabulary's own library segments
them. With a smaller share `scores`, as in the query, the rest of a weight comes from the pieces' shares of the training texts.
A character without a piece is spelled by its bytes, which weigh as little as the last piece.

With `words` (the query's way) a token of the training texts is one more spelling of itself, a single arc over the
whole word: a token's probability is (1 - known) * the lattice's sum + known * its share of the training tokens.
known is what Good and Turing give for meeting a known token again, from the number of tokens seen once; it is never 1.
The lattice's sums over all words and the end add up to at most 1 (a word begins with a piece that has the mark, goes
on with pieces that have none, and stops with what is left), so this is a probability too. The pieces' weights stay as they are.

Training counts words in each task (bounded memory), adds the counts up, and segments each distinct word
once. Words with at least a share 1 / FREQUENT of all tokens, so never more than FREQUENT of them, and of at most
FREQUENT_BYTES each, are broadcast with count and score, which executors compute. The documents are read once more: frequent words are looked up in the
task; the others leave as (row, word, n), each no hotter than that share, and are joined with the word
table by word. Nothing is cut or sampled.

Defined results: a null or empty text has one token, the end; repeated rows are scored each, and count
twice in training; a null doc_id is a training row (its remainder is unknown, held_out false); other
columns are left out; an empty table gives an empty result; without training rows the base knows no
token, and the model's weights are those of the vocabulary.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.best_fit_packing import tokenizer_path
from docweave.llm.common import arrow_rows, bucket_of, groups_of_text, stored, table, text_of

FOLDS, HELD_OUT = 7, 2
FREQUENT, FREQUENT_BYTES = 100_000, 64
#: The share of the vocabulary's own scores in a piece's weight.
SCORES = 1.0
#: The same in the query: by the scores alone, words that training does not know are spelled some 4 powers of ten worse.
QUERY_SCORES = 0.5
#: Exponents that are possible.
EXPONENTS = (0.0, 8.0)
#: Distinct words that a task counts before it gives them on.
COUNTED = 400_000
END = "</s>"
MARK = "▁"
_models: dict[str, PieceModel] = {}
_libraries: dict[str, object] = {}


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split()


def library(path: str):
    if path not in _libraries:
        import sentencepiece

        _libraries[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    return _libraries[path]


def ranks(path: str) -> dict[str, int]:
    """The rank of each piece by its score, from 2; of the end that of the first, of bytes that of the last."""
    sp = library(path)
    size = sp.get_piece_size()
    plain = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)) and MARK not in sp.id_to_piece(i)[1:]]
    plain.sort(key=lambda i: (-sp.get_score(i), i))
    found = {sp.id_to_piece(i): k + 2 for k, i in enumerate(plain)}
    return found | {f"<0x{b:02X}>": len(found) + 1 for b in range(256)} | {END: 2}


def vocabulary(path: str, exponent: float = 1.0) -> dict[str, float]:
    """The pieces with their prior probability."""
    weights = {p: k**-exponent for p, k in ranks(path).items()}
    total = math.fsum(weights.values())
    return {p: w / total for p, w in weights.items()}


def fitted_exponent(counts: dict[str, int], of_piece: dict[str, int]) -> float:
    """The exponent under which the counted pieces are likeliest: where the mean logarithm of a rank is what it is in the counts."""
    total = sum(counts.values())
    if not total:
        return 1.0
    seen = math.fsum(n * math.log(of_piece[p]) for p, n in counts.items()) / total
    logs, (low, high) = [math.log(k) for k in of_piece.values()], EXPONENTS
    for _ in range(60):  # the mean falls as the exponent grows
        middle = (low + high) / 2
        weights = [math.exp(-middle * x) for x in logs]
        low, high = (middle, high) if math.fsum(w * x for w, x in zip(weights, logs, strict=True)) > seen * math.fsum(weights) else (low, middle)
    return (low + high) / 2


class PieceModel:
    """Log probabilities of pieces, and of words by all their spellings."""

    def __init__(self, logs: dict[str, float]):
        self.bytes, self.end = [logs[f"<0x{b:02X}>"] for b in range(256)], logs[END]
        # Pieces only: the text of a byte's or the end's name is spelled like any other.
        self.logs = {p: w for p, w in logs.items() if p != END and not (len(p) == 6 and p.startswith("<0x"))}
        self.longest = max(map(len, self.logs), default=1)
        self.prefixes = {p[:k] for p in self.logs for k in range(1, len(p))}

    def word(self, word: bytes) -> float:
        """The natural logarithm of the sum over all segmentations."""
        text = MARK + word.decode("utf-8", "replace")
        get, prefixes, n, size = self.logs.get, self.prefixes, len(text), self.longest + 1
        # From each place on the pieces that start there; a ring holds what ends at the next places, so that a word of any length takes little memory.
        ring: list[list[float]] = [[] for _ in range(size)]
        exp, log, at = math.exp, math.log, 0.0
        for j in range(n + 1):
            if j:
                own = ring[j % size]
                ring[j % size] = []
                top = max(own)
                at = top if len(own) == 1 else top + log(sum([exp(x - top) for x in own]))
                if j == n:
                    break
            i, piece = j + 1, text[j]
            ring[i % size].append(at + (sum([self.bytes[b] for b in piece.encode()]) if (w := get(piece)) is None else w))
            while piece in prefixes and i < n:
                i += 1
                piece = text[j:i]
                if (w := get(piece)) is not None:
                    ring[i % size].append(at + w)
        return at


def model_of(key: str, logs) -> PieceModel:
    """The model that a worker has under this key; logs() if it has none."""
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(logs())
    return _models[key]


def word_counts(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as word, c over all their texts."""

    def run(batches):
        import pyarrow as pa

        def given():
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string(), safe=False), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
            counts.clear()
            return batch

        counts: Counter = Counter()
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text")):
            for _, text in group:
                counts.update(words_of(text))
            if len(counts) > COUNTED:
                yield given()
        yield given()

    return docs.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def piece_weights(counts: DataFrame, texts: int, path: str, scores: float = SCORES, exponent: float | None = None) -> dict[str, float]:
    """Log probabilities of the pieces: by the vocabulary's scores, whose exponent is fitted to the training words (word, c) unless it is given, mixed with the pieces' shares of these words if scores is less than 1. As many numbers as the vocabulary has pieces."""
    of_piece = ranks(path)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        sp = library(path)
        found = np.zeros(sp.get_piece_size(), np.int64)
        for batch in batches:
            ids = sp.encode(batch.column("word").to_pylist(), num_threads=1)
            times = np.repeat(batch.column("c").to_numpy(), np.fromiter(map(len, ids), np.int64, len(ids)))
            np.add.at(found, np.fromiter((i for w in ids for i in w), np.int64, len(times)), times)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array([sp.id_to_piece(int(i)) for i in at], pa.string()), pa.array(found[at])], ["piece", "n"])

    found = {r["piece"]: r["n"] for r in counts.select("word", "c").mapInArrow(run, "piece string, n long").groupBy("piece").agg(F.sum("n").alias("n")).collect()}
    n = {p: k for p, k in found.items() if p in of_piece} | {END: texts}
    total, prior = sum(n.values()), vocabulary(path, fitted_exponent(n, of_piece) if exponent is None else exponent)
    if not total or scores == 1:
        return {p: math.log(w) for p, w in prior.items()}
    return {p: math.log(scores * w + (1 - scores) * n.get(p, 0) / total) for p, w in prior.items()}


def known_share(n: int, once: int) -> float:
    """The share of tokens to come that training knows already, by Good and Turing; less than 1 whatever is counted."""
    return (n - once) / (n + 1)


def with_whole(ln, c, n: int, known: float):
    """Logarithms of the lattice's sums with the token itself, counted c times of n, as one more spelling."""
    import numpy as np

    if not known:
        return ln
    with np.errstate(divide="ignore"):
        return np.logaddexp(ln + math.log1p(-known), np.log(np.asarray(c, np.float64) * (known / n)))


def lm_scores(docs: DataFrame, path: str | None = None, folds: int = FOLDS, held_out: int = HELD_OUT, frequent: int = FREQUENT, scores: float = SCORES, exponent: float | None = None, words: bool = False) -> DataFrame:
    """docs (doc_id, text) as doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. words: a training token is also a spelling of itself."""
    path = path or tokenizer_path("piece_bpe_32k.model")
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"), F.coalesce(bucket_of("doc_id", folds) == held_out, F.lit(False)).alias("held_out"))
    train = docs.where(~F.col("held_out"))
    counts = stored(word_counts(train.select("doc_id", "text")))
    texts = train.count()
    n, v, once = (int(x or 0) for x in counts.agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1)).first())
    n, v = n + texts, v + (texts > 0)
    known = known_share(n, once + (texts == 1)) if words else 0.0
    logs = piece_weights(counts, texts, path, scores, exponent)
    weights, key = sc.broadcast(logs), uuid.uuid4().hex

    def scored(batches):
        import numpy as np
        import pyarrow as pa

        model = model_of(key, lambda: weights.value)
        for batch in batches:
            lns = np.fromiter((model.word(w.encode()) for w in batch.column("word").to_pylist()), np.float64, batch.num_rows)
            lns = with_whole(lns, batch.column("c").to_numpy(), n, known)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), pa.array(lns)], ["word", "c", "ln"])

    with_score = "word string, c long, ln double"
    is_frequent = (F.col("c") * F.lit(frequent) >= n) & (F.octet_length("word") <= FREQUENT_BYTES)
    most = counts.where(is_frequent).mapInArrow(scored, with_score)  # at most `frequent` rows: each has that share of n
    tier_one = sc.broadcast({r["word"].encode(): (r["c"], r["ln"]) for r in most.toLocalIterator()})
    base, ln10 = math.log10(n + v + 1), math.log(10)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "plus", "ln", "words", "times"]
        row, table_ = TaskContext.get().partitionId() << 40, tier_one.value
        end = float(with_whole(weights.value[END], texts, n, known))
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text", "held_out")):
            out: list[list] = [[] for _ in names]
            for doc, text, held in group:
                found = Counter(words_of(text))
                tokens, with_count, plus, ln, rare, times = 1, int(texts > 0), math.log10(texts + 1), end, [], []
                for w, k in found.items():
                    tokens += k
                    if (hit := table_.get(w)) is None:
                        rare.append(w)
                        times.append(k)
                    else:
                        with_count += k
                        plus += k * math.log10(hit[0] + 1)
                        ln += k * hit[1]
                for column, value in zip(out, (row, doc, held, tokens, with_count, plus, ln, rare, times), strict=True):
                    column.append(value)
                row += 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int32())]
            arrays = [pa.array(c, k) for c, k in zip(out, kinds, strict=True)]
            arrays[7] = arrays[7].cast(pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = stored(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, plus double, ln double, words array<string>, times array<int>"))
    rare = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("k"))

    # Each distinct rare word is scored once, whether training has it or only a held-out text.
    rest = counts.where(~is_frequent)
    unseen = rows.where("held_out").select(F.explode("words").alias("word")).distinct().join(rest, "word", "left_anti").withColumn("c", F.lit(0).cast("long"))
    each = rest.select("word", "c").unionAll(unseen).mapInArrow(scored, with_score).withColumnRenamed("word", "w")
    sums = rare.join(each, F.col("word") == F.col("w")).groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("more_known"), F.sum(F.col("k") * F.log10(F.col("c") + 1)).alias("more_plus"), F.sum(F.col("k") * F.col("ln")).alias("more_ln")
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.drop("words", "times").join(sums, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("more_known")).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("plus") + zero("more_plus") - F.col("n_tokens") * F.lit(base)).alias("base_score"), ((F.col("ln") + zero("more_ln")) / F.lit(ln10)).alias("score"),
    )


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), scores=QUERY_SCORES, words=True)
