"""Operator 3, language ID: mixtures of languages by expectation maximisation.

Each language is a multinomial over character trigrams of words (with a mark at either end of a word),
counted on labelled training rows. A document is a mixture: expectation maximisation over its words,
whose likelihood under a language is that of their trigrams, estimates the languages' shares. Among the
nested sets of its languages by share, the set with the best likelihood less PENALTY * ln(words) for each
language after the first is kept, and the language with the largest share in it is the prediction.

Training uses at most about LANGUAGE_ROWS labelled rows of each language, drawn by a hash of the row (a
documented bound of the classifier), and all rows of a language that has fewer; a language's trigrams are kept from a share of 1 / TRIGRAMS of its count on, so at most
TRIGRAMS of them. Prediction covers whole texts of all rows, map-side, without a shuffle.

Defined results: a null text or one without a letter is `und` with score 0, and so is every text if no
labelled row exists; a language that no training row has is never predicted; ties go to the first
language in order of name; repeated rows get the same result each; a null doc_id is held out from
training (held_out false); other columns are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, bucket_of, groups_of_text, table, text_of

FOLDS, HELD_OUT = 4, 2
LANGUAGE_ROWS, TRIGRAMS = 10_000, 50_000
PENALTY = 2.0
ROUNDS = 12
CACHE = 300_000
UNKNOWN = "und"
WORD = re.compile(r"[^\W\d_]+")


def bag(text: str) -> Counter:
    """The words of a text in lower case, which are runs of letters, with how often they occur."""
    found = Counter(WORD.findall(text.lower()))
    # Number signs that are no decimal digits, like a half or a Roman twelve in one sign, are word characters to the pattern but no letters.
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


def trigrams(word: str) -> list[str]:
    padded = f"<{word}>"
    return [padded[k : k + 3] for k in range(len(padded) - 2)]


class Languages:
    """Log likelihoods of words under each language; words are kept in a bounded cache."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        import numpy as np

        self.names = sorted(counts)
        self.cache: dict[str, int] = {}
        if not self.names:
            return
        grams = sorted({g for c in counts.values() for g in c})
        self.at = {g: k for k, g in enumerate(grams)}
        n = np.array([[counts[lang].get(g, 0) for lang in self.names] for g in grams] + [[0] * len(self.names)], np.float64).reshape(-1, len(self.names))
        self.logs = np.log((n + 0.5) / (n.sum(axis=0) + 0.5 * len(n)))
        self.rows = np.zeros((1024, len(self.names)))

    def word_rows(self, words: set[str]) -> None:
        import numpy as np

        if len(self.cache) > CACHE:
            self.cache.clear()
        new, at, last = list(words.difference(self.cache)), self.at.get, len(self.at)
        if not new:
            return
        have, need = len(self.cache), len(self.cache) + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((need, len(self.names)))])
        flat, ends = [], []
        for w in new:
            flat += [at(g, last) for g in trigrams(w)]
            ends.append(len(flat))
        starts = np.r_[0, ends[:-1]].astype(np.int64)
        self.rows[have:need] = np.add.reduceat(self.logs[np.array(flat, np.int64)], starts, axis=0)
        self.cache.update(zip(new, range(have, need), strict=True))

    def shares(self, bags: list[Counter]):
        """Of each bag of words (none empty): the languages' shares in the chosen set."""
        import numpy as np

        words: set[str] = set()
        for b in bags:
            words.update(b)
        self.word_rows(words)
        at = self.cache.__getitem__
        rows = np.fromiter((at(w) for b in bags for w in b), np.int64)
        times = np.fromiter((n for b in bags for n in b.values()), np.float64)
        sizes = np.array([len(b) for b in bags])
        doc, starts = np.repeat(np.arange(len(bags)), sizes), np.r_[0, np.cumsum(sizes)[:-1]]
        logs = self.rows[rows]
        top = logs.max(axis=1)
        like, total = np.exp(logs - top[:, None]), np.add.reduceat(times, starts)
        floor = np.add.reduceat(top * times, starts)

        def fit(mask, like, times, doc, starts, total, floor):
            """Shares within the mask, and the log likelihood."""
            pi = mask / mask.sum(axis=1, keepdims=True)
            for k in range(ROUNDS + 1):
                joint = like * pi[doc]
                mass = np.maximum(joint.sum(axis=1), 1e-300)
                if k == ROUNDS:
                    return pi, np.add.reduceat(np.log(mass) * times, starts) + floor
                pi = np.add.reduceat(joint * (times / mass)[:, None], starts, axis=0) / total[:, None]

        n = len(self.names)
        alone = np.add.reduceat(logs * times[:, None], starts, axis=0)
        chosen, best = np.eye(n)[alone.argmax(axis=1)], alone.max(axis=1)
        full, most = fit(np.ones((len(bags), n)), like, times, doc, starts, total, floor)
        # Each document by its own likelihoods: where all languages together do not earn the penalty of one more, no set of them is tried, else all sizes.
        more = np.flatnonzero(most - PENALTY * np.log(total + 1) > best)
        if n > 1 and len(more):
            of = np.isin(doc, more)
            own = (like[of], times[of], np.repeat(np.arange(len(more)), sizes[more]), np.r_[0, np.cumsum(sizes[more])[:-1]], total[more], floor[more])
            rank = np.argsort(np.argsort(-full[more], axis=1, kind="stable"), axis=1)
            for k in range(2, n + 1):
                pi, ll = fit((rank < k).astype(np.float64), *own)
                ll -= PENALTY * (k - 1) * np.log(total[more] + 1)
                better = ll > best[more]
                chosen[more[better]], best[more[better]] = pi[better], ll[better]
        return chosen


def train(docs: DataFrame, rows: int = LANGUAGE_ROWS, most: int = TRIGRAMS) -> dict[str, dict[str, int]]:
    """Trigram counts for each language, from at most about `rows` of its docs (doc_id, text, lang); all of a language that has fewer."""
    docs = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    # A row a language, added up partly before the shuffle.
    shares = docs.groupBy("lang").agg(F.count("*").alias("n")).select("lang", F.least(F.lit(1.0), rows / F.col("n")).alias("share"))
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / (1 << 30)
    docs = docs.join(F.broadcast(shares), "lang").where(draw < F.col("share"))

    def run(batches):
        import pyarrow as pa

        counts: dict[str, Counter] = defaultdict(Counter)
        for lang, text in arrow_rows(batches, "lang", "text"):
            for word, n in bag(text).items():
                for g in trigrams(word):
                    counts[lang][g] += n
        flat = [(lang, g, n) for lang, c in counts.items() for g, n in c.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.string()), pa.array([x[1] for x in flat], pa.string()), pa.array([x[2] for x in flat], pa.int64())], ["lang", "gram", "n"])

    counts = docs.select("lang", "text").mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    found: dict[str, dict[str, int]] = defaultdict(dict)
    for r in counts.join(totals, "lang").where(F.col("n") * most >= F.col("total")).select("lang", "gram", "n").collect():
        found[r["lang"]][r["gram"]] = r["n"]
    counts.unpersist()
    return dict(found)


def language_mixture(docs: DataFrame, counts: dict[str, dict[str, int]]) -> DataFrame:
    """docs (doc_id, text) as doc_id, lang_pred, score, shares (of the chosen languages)."""
    model = docs.sparkSession.sparkContext.broadcast(counts)
    docs = docs.select(F.col("doc_id").cast("long"), text_of().alias("text"))

    def run(batches):
        import pyarrow as pa

        languages = Languages(model.value)
        for group in groups_of_text(arrow_rows(batches, "doc_id", "text")):
            bags = [bag(t) if languages.names else Counter() for _, t in group]
            full = [b for b in bags if b]
            shares = iter(languages.shares(full) if full else ())
            pred, score, maps = [], [], []
            for b in bags:
                if not b:
                    pred.append(UNKNOWN), score.append(0.0), maps.append([])
                    continue
                s = next(shares)
                k = int(s.argmax())
                pred.append(languages.names[k]), score.append(min(1.0, float(s[k]))), maps.append([(lang, float(x)) for lang, x in zip(languages.names, s, strict=True) if x > 0])
            yield pa.RecordBatch.from_arrays([pa.array([d for d, _ in group], pa.int64()), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["doc_id", "lang_pred", "score", "shares"])

    return docs.mapInArrow(run, "doc_id long, lang_pred string, score double, shares map<string,double>")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    learned = train(docs.where(bucket_of("doc_id", FOLDS) != HELD_OUT).select("doc_id", "text", "lang"))
    found = language_mixture(docs, learned)
    return found.select("doc_id", F.coalesce(bucket_of("doc_id", FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "lang_pred", "score")
