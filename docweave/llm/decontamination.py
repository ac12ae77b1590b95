"""Operator 2, benchmark decontamination: a positional inverted index.

The benchmark's windows are phrases of WINDOW words (an item of fewer words is one phrase). Of each
phrase the TERMS rarest words are its anchors, by their frequency in the training texts. The index stores
the postings (document, position) of the training texts for the anchors only: a posting of any other word
could never be asked for. Phrases are answered from the rarest anchor on: its postings less its place in
the phrase are starts where the phrase could stand, and the list of the next anchor, shifted likewise, is
intersected with them. What is left is compared word by word with the documents, of which only those with
a candidate are read again.

`proximity_matches` answers the looser question: where all but a SPARE-th of a phrase's words stand within
SLOP words of their places, seen from some start. If so many words may be missing, one more than that
cannot all be missing, so that many rarest words of each window are the anchors (words that no text has are
the rarest and have no postings). A posting of an anchor lays its whole item on the document, so it is one
candidate for all windows around that word. A posting is kept in the index with the words around it if
enough of the item's are among them; all words are then compared, first within twice the slop of where the
anchor puts them, which no match exceeds. Words are compared by hashes of 64 bits here.

Everything is built-in expressions. The passes over all words are an explode that keeps two numbers and a
word, joined with broadcast terms and added up before any shuffle; anchors and phrases are broadcast only
if a count shows that they are few, else they are shuffled. A common passage gives candidates in
proportion to its occurrences; no pairs of documents are ever formed.

Defined results: null and empty texts have no words and no hits, null and empty items have no windows;
rows that share a doc_id are judged each by its own text; a null doc_id is kept; equal windows of several
items count for each of them; items that share an item_id are one item; other columns are left out; an
empty table on either side gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import BROADCAST_ROWS, let, lower_ascii, once, small, stored, table

WINDOW, TERMS = 10, 2
#: Of proximity matches: how far a word may stand from its place, and of how many words one may be missing.
SLOP, SPARE = 3, 5
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The distinct windows of items (item_id, text): phrase (words with blanks between), size, items (the sorted ids)."""
    split = items.select(F.col("item_id").cast("string").alias("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (window - 1)))
    phrase = split.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("w"))
    return phrase.groupBy(F.array_join("w", " ").alias("phrase"), F.size("w").alias("size")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))


def text_words(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as doc_id, text_hash, w (words)."""
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))


def anchors(split: DataFrame, phrases: DataFrame, terms: int = TERMS) -> DataFrame:
    """For each phrase its rarest words in the texts: phrase, rank (0: rarest), term, at (its place in the phrase). Phrases with a word that no text has are left out: they occur nowhere."""
    places = phrases.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("at", "term"))
    asked = stored(places.select("term").distinct())
    seen = split.select(F.explode("w").alias("term")).join(small(asked, asked.count()), "term").groupBy("term").agg(F.count("*").alias("n"))
    ranked = places.join(small(stored(seen), asked.count()), "term").groupBy("phrase", "size").agg(F.array_sort(F.collect_list(F.struct("n", "at", "term"))).alias("places"))
    ranked = ranked.where(F.size("places") == F.col("size"))
    return ranked.select("phrase", F.posexplode(F.slice("places", 1, terms)).alias("rank", "x")).select("phrase", "rank", F.col("x.term").alias("term"), F.col("x.at").alias("at"))


def positional_index(split: DataFrame, terms: DataFrame, n_terms: int) -> DataFrame:
    """The postings of the terms, stored: term, doc_id, text_hash, position."""
    return stored(split.select("doc_id", "text_hash", F.posexplode("w").alias("position", "term")).join(small(terms, n_terms), "term"))


def _starts(index: DataFrame, asked: DataFrame, n: int, rank: int) -> DataFrame:
    own = asked.where(F.col("rank") == rank).select("phrase_id", "term", "at")
    return index.join(small(own, n), "term").select("phrase_id", "doc_id", "text_hash", (F.col("position") - F.col("at")).alias("start")).where("start >= 0")


def candidates(index: DataFrame, asked: DataFrame, n: int, terms: int = TERMS) -> DataFrame:
    """phrase_id, doc_id, text_hash, start: where all anchors stand at their place."""
    found = _starts(index, asked, n, 0)
    for rank in range(1, terms):
        more = _starts(index, asked, n, rank)
        has = asked.where(F.col("rank") == rank).select("phrase_id", F.lit(True).alias("has"))
        found = found.join(small(has, n), "phrase_id", "left")
        keys = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("phrase_id", "doc_id", "text_hash", "start")]
        both = found.where("has").drop("has").alias("a").join(more.alias("b"), keys, "left_semi")
        found = both.unionByName(found.where("has is null").drop("has"))
    return found


def hashes(w: Column) -> Column:
    """A number for each word (64 bits)."""
    return F.transform(w, lambda x: F.xxhash64(x))


def item_words(items: DataFrame) -> DataFrame:
    """The distinct texts of items (item_id, text), stored: item_no (a hash of 64 bits, which only brings rows together), w (words), h (their hashes)."""
    split = items.select(words(F.col("text")).alias("w")).where(F.size("w") > 0)
    return stored(split.groupBy(F.array_join("w", " ").alias("whole")).agg(F.first("w").alias("w")).select(F.xxhash64("whole").alias("item_no"), "w", hashes(F.col("w")).alias("h")))


def spare_anchors(split: DataFrame, texts: DataFrame, window: int, spare: int) -> DataFrame:
    """Of item_words() the words that are among the size / spare + 1 rarest of some window, as far as texts have them: item_no, term, at (its place in the item), need (of the distinct words of any window around it, so many at least must be near)."""
    places = texts.select("item_no", F.posexplode("w").alias("at", "term"))
    asked = stored(places.select("term").distinct())
    n = asked.count()
    seen = split.select(F.explode("w").alias("term")).join(small(asked, n), "term").groupBy("term").agg(F.count("*").alias("n"))
    ranked = places.join(small(stored(seen), n), "term", "left").groupBy("item_no").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("n", F.lit(0)).alias("n"), "term"))).alias("ws"))

    def rarest(j: Column) -> Column:
        own = F.transform(F.slice("ws", j + 1, window), lambda x: F.struct(x["n"].alias("n"), x["at"].alias("at"), x["term"].alias("term")))
        return F.slice(F.array_sort(own), F.lit(1), F.floor(F.size(own) / spare).cast("int") + 1)

    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("ws") - window))
    def needed(j: Column) -> Column:
        own = F.slice(F.col("ws.term"), j + 1, window)
        return F.size(F.array_distinct(own)) - F.floor(F.size(own) / spare).cast("int")

    few = ranked.select("item_no", F.transform(starts, needed).alias("needs"), F.explode(F.array_distinct(F.flatten(F.transform(starts, rarest)))).alias("x")).where("x.n > 0")
    first = F.least(F.greatest(F.lit(0), F.col("x.at") - (window - 1)), F.size("needs") - 1)
    need = F.array_min(F.slice("needs", first + 1, F.least(F.col("x.at") + 1, F.size("needs")) - first))
    return few.select("item_no", F.col("x.term").alias("term"), F.col("x.at").alias("at"), need.alias("need"))


def _asked(split: DataFrame, phrases: DataFrame, terms: int) -> tuple[DataFrame, int, DataFrame, int]:
    """Anchors, how many they are, their distinct terms, how many those are."""
    ids = phrases.select("phrase", "phrase_id")
    asked = stored(anchors(split, phrases, terms).join(ids, "phrase").drop("phrase"))
    distinct = stored(asked.select("term").distinct())
    return asked, asked.count(), distinct, distinct.count()


def numbered(phrases: DataFrame) -> DataFrame:
    """phrases with a phrase_id, stored. It is a hash of 64 bits and only brings rows together; the words are compared later."""
    return stored(phrases.withColumn("phrase_id", F.xxhash64("phrase")))


def read_again(docs: DataFrame, found: DataFrame) -> DataFrame:
    """found (doc_id, text_hash, found), which is stored, with the documents' words: doc_id, text_hash, w, found."""
    # Only the documents with a candidate are split again; if the candidates are few, the others are not even shuffled.
    again = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    keys = [F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")), F.col("d.text_hash") == F.col("f.text_hash")]
    if found.count() <= BROADCAST_ROWS:
        again = again.alias("d").join(F.broadcast(found.select("doc_id", "text_hash")).alias("f"), keys, "left_semi")
    again = again.dropDuplicates(["doc_id", "text_hash"])
    return again.alias("d").join(found.alias("f"), keys).select("d.doc_id", "d.text_hash", words(F.col("text")).alias("w"), "found")


def near_postings(docs: DataFrame, asked: DataFrame, n: int, reach: int) -> DataFrame:
    """The postings of the anchors (th, the hash of the word, and others) with the words around them, as hashes: the columns of asked, doc_id, text_hash, position, low (where near begins), near; of those only where enough of the words beside the anchor (beside, need) are near.

    Few anchors are broadcast, and a posting is judged where its text is read. Many are joined with the
    postings by word, and only what is found goes back to its text.
    """
    rows = text_words(docs).select("doc_id", "text_hash", hashes(F.col("w")).alias("h"))
    low = F.greatest(F.col("position") - reach, F.lit(0))
    near = F.slice("h", low + 1, F.col("position") + reach + 1 - low)
    if n <= BROADCAST_ROWS // 4:  # an anchor is about as large as four rows of numbers
        met = rows.select("doc_id", "text_hash", "h", F.posexplode("h").alias("position", "th")).join(F.broadcast(asked), "th")
    else:
        met = rows.select("doc_id", "text_hash", F.posexplode("h").alias("position", "th")).join(asked.select("th").distinct(), "th").join(asked, "th")
        both = read_again(docs, stored(met.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("item_no", "at", "position")).alias("found"))))
        met = both.select("doc_id", "text_hash", hashes(F.col("w")).alias("h"), F.explode("found").alias("x")).select("doc_id", "text_hash", "h", "x.*").join(asked.drop("th"), ["item_no", "at"])
    return met.where(F.size(F.array_intersect("beside", near)) >= F.col("need")).select("doc_id", "text_hash", "item_no", "at", "position", low.alias("low"), near.alias("near"))


def nearby_matches(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW, spare: int = SPARE) -> DataFrame:
    """The proximity matches, stored: doc_id, text_hash, item_no, j (where the window begins in the item), start (where in the document), distinct. start is as seen from an anchor, moved as little as need be."""
    split, texts = text_words(docs), item_words(items)
    asked = spare_anchors(split, texts, window, spare)
    begin = F.greatest(F.lit(0), F.col("at") - (window - 1))
    beside = F.slice("h", begin + 1, F.least(F.lit(2 * window - 1), F.size("h") - begin))
    asked = stored(asked.join(texts, "item_no").select("item_no", "at", "need", F.xxhash64("term").alias("th"), beside.alias("beside")))
    # A posting is a candidate for all windows around its word in the item at once; most have too few of the item's words near them.
    index = stored(near_postings(docs, asked, asked.count(), window - 1 + 2 * slop))
    sizes = texts.select("item_no", F.size("w").alias("n"))
    own = stored(asked.select("item_no", "at", F.col("beside").alias("own")).distinct())
    cases = index.join(small(sizes, texts.count()), "item_no").join(small(own, 4 * own.count()), ["item_no", "at"])
    size, first = F.least(F.lit(window), F.col("n")), F.greatest(F.lit(0), F.col("at") - (window - 1))
    cases = cases.withColumns({"size": size, "first": first, "last": F.least(F.col("at"), F.col("n") - size)})
    need = F.col("size") - F.floor(F.col("size") / spare).cast("int")

    def fitting(move: Column, slop: int) -> Column:
        """The windows of which enough words stand near their places, if the item is laid on the document as the anchor says and then moved."""

        def stands(word, k):
            at = F.col("position") - F.col("at") + F.col("first") + k + move - F.col("low")
            low, high = F.greatest(at - slop, F.lit(0)), at + slop
            return F.array_contains(F.slice("near", low + 1, F.greatest(high - low + 1, F.lit(0))), word).cast("int")

        enough = lambda there: F.filter(F.sequence("first", "last"), lambda j: F.aggregate(F.slice(there, j - F.col("first") + 1, F.col("size")), F.lit(0), lambda a, b: a + b) >= need)
        return let(F.transform("own", stands), enough)

    moves = F.array(*map(F.lit, sorted(range(-slop, slop + 1), key=lambda d: (abs(d), d))))
    loose = cases.where(once(F.size(fitting(F.lit(0), 2 * slop)) > 0))
    placed = loose.select("doc_id", "text_hash", "item_no", (F.col("position") - F.col("at")).alias("base"), F.explode(F.transform(moves, lambda d: F.struct(d.alias("move"), fitting(d, slop).alias("js")))).alias("x"))
    each = placed.select("doc_id", "text_hash", "item_no", "base", "x.move", F.explode("x.js").alias("j"))
    nearest = each.groupBy("doc_id", "text_hash", "item_no", "j", "base").agg(F.min_by("move", F.struct(F.abs("move"), "move")).alias("move"))
    return stored(nearest.select("doc_id", "text_hash", "item_no", "j", (F.col("base") + F.col("j") + F.col("move")).alias("start")).distinct())


def window_phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Of the windows of item_words() the phrases: item_no, j, phrase."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("w") - window))
    return item_words(items).select("item_no", F.explode(F.transform(starts, lambda j: F.struct(j.alias("j"), F.array_join(F.slice("w", j + 1, window), " ").alias("phrase")))).alias("x")).select("item_no", "x.j", "x.phrase")


def proximity_matches(docs: DataFrame, items: DataFrame, slop: int, window: int = WINDOW, spare: int = SPARE) -> DataFrame:
    """phrase, doc_id, start: where all but a spare-th of a window's words stand within slop words of their places (distinct)."""
    phrases = stored(window_phrases(items, window))
    return nearby_matches(docs, items, slop, window, spare).join(small(phrases, phrases.count()), ["item_no", "j"]).select("phrase", "doc_id", "start").distinct()


def phrase_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, terms: int = TERMS) -> DataFrame:
    """The documents with exact occurrences, stored: doc_id, text_hash, matches (start, size), phrases (phrase_ids of the distinct ones)."""
    split, phrases = text_words(docs), numbered(windows(items, window))
    return _phrase_matches(docs, split, phrases, terms)


def _phrase_matches(docs: DataFrame, split: DataFrame, phrases: DataFrame, terms: int) -> DataFrame:
    asked, n, distinct, n_terms = _asked(split, phrases, terms)
    index = positional_index(split, distinct, n_terms)
    n_phrases = phrases.count()
    sizes = phrases.select("phrase_id", "size")
    # A candidate is a few numbers; the words at its place come out of the text once more, and only then the phrase's.
    found = candidates(index, asked, n, terms).join(small(sizes, n_phrases), "phrase_id").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size", "phrase_id")).alias("found"))
    both = read_again(docs, stored(found))
    shown = let(F.col("w"), lambda w: F.transform("found", lambda x: x.withField("words", F.array_join(F.slice(w, x["start"] + 1, x["size"]), " "))))
    cases = both.select("doc_id", "text_hash", F.inline(shown)).join(small(phrases.select("phrase_id", "phrase"), n_phrases), "phrase_id").where("words = phrase")
    return stored(cases.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "size")).alias("matches"), F.collect_set("phrase_id").alias("phrases")))


def decontamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, terms: int = TERMS) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_words, n_hit, items (sorted ids of items with occurring windows)."""
    docs = docs.select("doc_id", "text")
    split, phrases = text_words(docs), numbered(windows(items, window))
    found = _phrase_matches(docs, split, phrases, terms)
    hit = F.size(F.array_distinct(F.flatten(F.transform("matches", lambda m: F.sequence(m["start"], m["start"] + m["size"] - 1)))))
    held = found.select("doc_id", "text_hash", F.explode("phrases").alias("phrase_id")).join(small(phrases.select("phrase_id", "items"), phrases.count()), "phrase_id")
    names = held.select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    same = [F.col("f.doc_id").eqNullSafe(F.col("k.doc_id")), F.col("f.text_hash") == F.col("k.text_hash")]
    matched = found.select("doc_id", "text_hash", hit.alias("n_hit")).alias("f").join(names.alias("k"), same, "left").select("f.doc_id", "f.text_hash", "n_hit", "items")
    # A row's hash says which text it has, so that rows that share a doc_id get their own result.
    rows = split.select("doc_id", "text_hash", F.size("w").cast("long").alias("n_words"))
    keys = [F.col("r.doc_id").eqNullSafe(F.col("m.doc_id")), F.col("r.text_hash") == F.col("m.text_hash")]
    joined = rows.alias("r").join(matched.alias("m"), keys, "left")
    return joined.select("r.doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = SLOP, window: int = WINDOW, spare: int = SPARE) -> DataFrame:
    """docs (doc_id, text) as doc_id, n_windows (distinct windows with a proximity match), items (their sorted ids)."""
    docs = docs.select("doc_id", "text")
    phrases, of = stored(window_phrases(items, window)), numbered(windows(items, window)).select("phrase", "items")
    found = nearby_matches(docs, items, slop, window, spare).select("doc_id", "text_hash", "item_no", "j").distinct()
    seen = stored(found.join(small(phrases, phrases.count()), ["item_no", "j"]).select("doc_id", "text_hash", "phrase").distinct())
    counts = seen.groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"))
    names = seen.join(small(of, of.count()), "phrase").select("doc_id", "text_hash", F.explode("items").alias("item")).groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"))
    same = lambda a, b: [F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")), F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash")]
    joined = rows.alias("r").join(counts.alias("c"), same("r", "c"), "left").join(names.alias("k"), same("r", "k"), "left")
    return joined.select("r.doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_windows"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside op2_decontamination, whose SQL has the exact matches and no other columns."""
    out = proximity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_windows", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_windows") > 0).alias("contaminated"))


ORACLE = {
    "op2_decontamination": r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(list_slice(w, i, i + 9), ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT doc_id, i, size, array_to_string(list_slice(w, i, i + size - 1), ' ') AS phrase
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM dw, sizes WHERE len(w) >= size)),
hits AS (SELECT g.doc_id, g.i, g.size, x.item_id FROM grams g JOIN win x ON g.phrase = x.phrase AND g.size = x.size),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS p FROM hits) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS list FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(k.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(k.list, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN ids k ON d.doc_id = k.doc_id
"""
}
