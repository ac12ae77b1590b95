"""Operator 4, quality rules: divergence of distributions.

Base rules count words, symbols, repeated lines and repeated word windows. The method then compares two
histograms of a text with those of each language reference by Jensen-Shannon distance (base 2 logarithms,
square root, so 0 to 1): classes of characters, and common words (each in its own bin, all others in one).
A text fails if its distance to the nearest reference is over the limit, or both distances are over lower ones. Short texts have noisy
histograms, so each comparison has a minimum length below which it is not made.

References come from the corpus: for each language, the classes and words of all its rows that pass cheap
guards (at least MIN_WORDS words, few symbols). A word is common if at least a share COMMON_SHARE of its
language's words are it, so a language has at most 1 / COMMON_SHARE common words, whatever the corpus.
Only these bounded tables reach the driver; they come back to the texts as literals.

All expressions are built-in: a word's bin is a look-up in a literal table by its hash (64 bits), and histograms
are arrays within a row, so scoring needs no shuffle.

Defined results: a null or empty text has no words and fails the base rules; rows without a language
belong to no reference but are judged against all; without any reference nothing fails for divergence;
repeated rows get the same result each; other columns stay as they are, but those named like an added one
(ADDED) give way to it; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import let, once, stored, table

WORD_SPLIT = r"[\x20\x09-\x0D]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS, WINDOW, REPEATED_PERCENT = 10, 5, 20
#: Bits for a window's place when windows are sorted as numbers; longer texts are sorted otherwise.
PLACE_BITS = 20
#: Lengths from which the comparisons are made, and limits of the distance.
MIN_CHARS_CLASSES, MIN_WORDS_COMMON = 200, 50
LIMIT_CLASSES, LIMIT_COMMON = 0.32, 0.45
#: Limits that a text must be over in both.
BOTH_CLASSES, BOTH_COMMON = 0.18, 0.30
COMMON_SHARE = 0.004
#: Characters of each class beside lower-case letters, blanks and line ends, and all others.
CLASSES = {"upper": r"\p{Lu}", "digit": r"\p{Nd}", "punctuation": r"[.,;:!?'\"()\-]"}
NAMES = ("lower", "space", *CLASSES, "other")
ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "common_distance", "kept")


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT, -1), "")


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows that the text has twice or more, from the words' hashes; windows are compared by 64-bit hashes of those."""
    n = F.size(hashes)

    def pairs(a: Column, b: Column, apart: int) -> Column:
        """The hash of a[k] and b[k + apart] for each k; zip_with needs no look-up by index."""
        m = F.greatest(F.lit(0), F.size(b) - apart)
        return F.zip_with(F.slice(a, F.lit(1), m), F.slice(b, F.lit(apart + 1), m), lambda x, y: F.xxhash64(x, y))

    def grams(h: Column, size: int) -> Column:
        """Windows by doubling: of 2k words from two of k, and one word more where size is odd."""
        if size == 1:
            return h
        half = let(grams(h, size // 2), lambda a: pairs(a, a, size // 2))
        return half if size % 2 == 0 else let(half, lambda a: pairs(a, h, size - 1))

    def union(starts: Column) -> Column:
        """The words in windows at these starts, in order."""
        steps = F.transform(starts, lambda a, k: F.least(F.lit(window), F.coalesce(F.get(starts, k + 1), a + window) - a))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def by_structs(g: Column) -> Column:
        """Sorted with their places: right for any text, but slow."""
        ranked = F.array_sort(F.transform(g, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        twice = lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["g"] == x["g"]) | (F.get(s, i + 1)["g"] == x["g"]))
        return let(F.array_sort(F.transform(let(ranked, twice), lambda x: x["i"])), union)

    def by_numbers(g: Column) -> Column:
        """Sorted as numbers: a hash's upper bits, then its place. Equal upper bits of unequal hashes are noticed and go the slow way."""
        low = F.lit((1 << PLACE_BITS) - 1).cast("long")
        same = lambda x, y: F.shiftrightunsigned(x.bitwiseXOR(y), PLACE_BITS) == 0
        place = lambda x: x.bitwiseAND(low).cast("int")
        packed = F.sort_array(F.transform(g, lambda x, i: x.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
        twice = let(packed, lambda s: F.filter(s, lambda x, i: same(x, F.get(s, i + 1)) | same(x, F.get(s, i - 1))))
        mixed = lambda t: F.exists(F.transform(t, lambda x, i: same(x, F.get(t, i + 1)) & (F.get(g, place(x)) != F.get(g, place(F.get(t, i + 1))))), lambda b: b)
        return let(twice, lambda t: F.when(F.coalesce(mixed(t), F.lit(False)), by_structs(g)).otherwise(let(F.sort_array(F.transform(t, place)), union)))

    def covered(g: Column) -> Column:
        return F.when(F.size(g) < 1 << PLACE_BITS, by_numbers(g)).otherwise(by_structs(g))

    def from_fours(h: Column) -> Column:
        # Without an equal window of one word less there is none of `window` words; most texts end here.
        less = window - 1
        return let(grams(h, less), lambda g: F.when(F.size(F.array_distinct(g)) < F.size(g), let(pairs(g, h, less), full)).otherwise(0))

    def full(g: Column) -> Column:
        return F.when(F.size(F.array_distinct(g)) < F.size(g), covered(g)).otherwise(0)

    return F.when(n >= window, let(hashes, from_fours)).otherwise(0)


def rest(text: Column) -> Column:
    """The text without lower-case letters, blanks and line ends: short, so that counting in it is cheap."""
    return F.regexp_replace(text, r"[a-z\x20\n\p{Ll}]+", "")


def blanks(text: Column) -> Column:
    """How many blanks and line ends the text has."""
    return F.char_length(text) - F.char_length(F.replace(F.replace(text, F.lit(" "), F.lit("")), F.lit("\n"), F.lit("")))


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds __words, __hashes (of words), __rest, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = docs.withColumns({"__words": words(F.col(text_col)), "__lines": lines, "__rest": rest(text)})
    out = out.withColumns({
        "__hashes": F.transform("__words", lambda w: F.xxhash64(w)),
        "n_words": F.size("__words").cast("long"),
        "word_chars": F.char_length(F.array_join("__words", "")).cast("long"),
        "n_symbols": F.regexp_count("__rest", F.lit(SYMBOL)).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
    })
    out = out.drop("__lines", "__words").withColumn("n_repeat_words", repeated_words(F.col("__hashes")).cast("long"))
    return out.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEATED_PERCENT * F.col("n_words")))


def class_counts(n_chars: Column, n_space: Column, left: Column) -> list[Column]:
    """Of NAMES, in order; left is rest(text)."""
    known = [F.regexp_count(left, F.lit(p)) for p in CLASSES.values()]
    other = F.char_length(left) - sum(known[1:], known[0])
    return [c.cast("long") for c in (n_chars - n_space - F.char_length(left), n_space, *known, other)]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = COMMON_SHARE) -> tuple[dict[str, list[float]], dict[str, dict[int, float]]]:
    """For each language, the shares of the character classes, and of its common words by their hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    good = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), text.alias("text"), rest(text).alias("rest"))
    # Short texts and those with many symbols do not speak for their language.
    good = good.where((F.char_length("text") >= MIN_CHARS_CLASSES) & (100 * F.regexp_count("rest", F.lit(SYMBOL)) <= F.char_length("text")))
    counts = class_counts(F.char_length("text"), blanks(F.col("text")), F.col("rest"))
    totals = good.select("lang", *(c.alias(k) for k, c in zip(NAMES, counts, strict=True))).groupBy("lang").agg(*(F.sum(k).alias(k) for k in NAMES)).collect()
    classes = {r["lang"]: [r[k] / max(1, sum(r[x] for x in NAMES)) for k in NAMES] for r in totals}
    counted = stored(good.select("lang", F.explode(words(F.col("text"))).alias("word")).groupBy("lang", F.xxhash64("word").alias("h")).agg(F.count("*").alias("c")))
    n = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("c").alias("n")).collect()}
    if not n:
        return classes, {}
    # A lower bound for each language's words; so at most 1 / share rows of a language pass.
    least = F.create_map(*(F.lit(x) for lang, k in n.items() for x in (lang, max(1.0, share * k))))
    common: dict[str, dict[int, float]] = {k: {} for k in n}
    for r in counted.where(F.col("c") >= F.element_at(least, F.col("lang"))).collect():
        common[r["lang"]][r["h"]] = r["c"] / n[r["lang"]]
    return classes, common


def _term(p: Column, q: Column) -> Column:
    """p log2(2p / (p + q)), 0 where p is 0."""
    return F.when(p > 0, p * F.log2(2 * p / (p + q))).otherwise(0.0)


def class_distance(counts: list[Column], classes: dict[str, list[float]]) -> Column:
    """The least Jensen-Shannon distance of a text's character classes to a language's."""

    def nearest(p: Column) -> Column:
        def to(shares: list[float]) -> Column:
            q = F.array(*(F.lit(float(x)) for x in shares))
            return F.aggregate(F.zip_with(p, q, lambda a, b: (_term(a, b) + _term(b, a)) / 2), F.lit(0.0), lambda a, b: a + b)

        found = [to(x) for _, x in sorted(classes.items())]
        return F.sqrt(F.greatest(F.lit(0.0), F.least(*found) if len(found) > 1 else found[0]))

    def shares(h: Column) -> Column:
        return let(F.aggregate(h, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(h, lambda c: c / total))

    return let(let(F.array(*(c.cast("double") for c in counts)), shares), nearest)


def slots(hashes: list[int]) -> list[int]:
    """A table with each hash at its remainder by the table's size, which is one for which they do not meet. Other places hold numbers that belong elsewhere."""
    size = max(64, 2 * len(hashes))
    while len({h % size for h in hashes}) < len(hashes):
        size += 1 + size // 64
    out = [k + 1 for k in range(size)]
    for h in hashes:
        out[h % size] = h
    return out


def common_distance(hashes: Column, common: dict[str, dict[int, float]]) -> Column:
    """The least Jensen-Shannon distance of the words' histogram over common words to a language's.

    Of a language's common words that the text lacks, each adds half its share; so only words that the text has are looked at.
    """
    placed = slots(sorted({h for c in common.values() for h in c}))
    literal = lambda values, kind: F.split(F.lit(" ".join(map(repr, values))), " ", -1).cast(f"array<{kind}>")  # noqa: E731  one literal after folding
    table_ = literal(placed, "bigint")
    place = lambda h: F.pmod(h, F.lit(len(placed)).cast("long")).cast("int")

    def nearest(all_: Column) -> Column:
        n = F.size(all_).cast("double")
        return let(F.filter(all_, lambda h: F.get(table_, place(h)) == h), lambda hits: with_hits(hits, n))

    def with_hits(hits: Column, n: Column) -> Column:
        bins = F.transform(F.array_distinct(hits), lambda b: F.struct(place(b).alias("b"), ((F.size(hits) - F.size(F.array_remove(hits, b))) / n).alias("p")))
        rest_p = 1 - F.size(hits) / n

        def least(bs: Column) -> Column:
            def to(shares: dict[int, float]) -> Column:
                q = literal([float(shares.get(h, 0.0)) for h in placed], "double")
                total = float(sum(shares.values()))
                rest_q = F.lit(1.0 - total)

                def add(a: Column, x: Column) -> Column:
                    return let(F.get(q, x["b"]), lambda share: F.struct((a["d"] + (_term(x["p"], share) + _term(share, x["p"])) / 2).alias("d"), (a["q"] + share).alias("q")))

                done = F.aggregate(bs, F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("q")), add)
                return let(done, lambda d: d["d"] + (F.lit(total) - d["q"]) / 2 + (_term(rest_p, rest_q) + _term(rest_q, rest_p)) / 2)

            found = [to(c) for _, c in sorted(common.items())]
            return F.sqrt(F.greatest(F.lit(0.0), F.least(*found) if len(found) > 1 else found[0]))

        return let(bins, least)

    return let(hashes, nearest)


def quality_rules(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: tuple[dict, dict] | None = None) -> DataFrame:
    """docs with the base rules' columns, class_distance and common_distance (null where the text is too short) and kept."""
    classes, common = refs or references(docs, text_col, lang_col)
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    out, none = base_rules(docs, text_col), F.lit(None).cast("double")
    text, judged = F.coalesce(F.col(text_col), F.lit("")), ~F.col("base_failed")
    counts = class_counts(F.char_length(text), blanks(text), F.col("__rest"))
    out = out.withColumns({
        "class_distance": F.when(judged & (F.char_length(text) >= MIN_CHARS_CLASSES), class_distance(counts, classes)) if classes else none,
        "common_distance": F.when(judged & (F.col("n_words") >= MIN_WORDS_COMMON), common_distance(F.col("__hashes"), common)) if any(common.values()) else none,
    })
    a, b = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("common_distance", F.lit(0.0))
    off = (a > LIMIT_CLASSES) | (b > LIMIT_COMMON) | ((a > BOTH_CLASSES) & (b > BOTH_COMMON))
    return out.drop("__hashes", "__rest").withColumn("kept", once(judged & ~off))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "class_distance", "common_distance")
