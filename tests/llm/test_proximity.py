"""Both queries of operator 2 on odd rows, and proximity against brute force over a whole table."""

import hashlib
import re
from collections import Counter

from docweave.llm import decontamination as dc
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def windows_of(items, window=10):
    """Each distinct window with the items that have it."""
    found = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            found.setdefault(tuple(w[k : k + window]), set()).add(str(item))
    return found


def near(doc, places, win, slop=3, spare=5):
    """Whether all but a spare-th of the window's words stand within slop words of their places, from some start."""
    need = len(win) - len(win) // spare
    if sum(w in places for w in win) < need:
        return False
    starts = Counter()
    for k, w in enumerate(win):
        # Each start from which this word has its place near one of its occurrences, once.
        for s in {p - k + d for p in places.get(w, ()) for d in range(-slop, slop + 1)}:
            starts[s] += 1
    return max(starts.values(), default=0) >= need


def brute(docs, items):
    found, out = windows_of(items), []
    for d, text in docs:
        doc, places = words(text), {}
        for p, w in enumerate(doc):
            places.setdefault(w, []).append(p)
        hits = [win for win in found if near(doc, places, win)]
        out.append((d, len(hits), sorted(set().union(*(found[w] for w in hits)))))
    return out


def test_proximity_query(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = {d: (n, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), n > 0) for d, n, ids in brute(docs, items)}
    got = {r["doc_id"]: (r["n_windows"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in QUERIES["op2_proximity"](spark, SF).collect()}
    assert got == want and any(n for n, *_ in want.values())


def test_proximity_of_altered_passages(spark, docs_of):
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = [item, item.replace("three", "x"), item.replace("three", "x").replace("eight", "y"), item.replace("three", "x").replace("eight", "y").replace("five", "z").replace("ten", "w"), item.replace("six", "a b c six"), item.replace("six", "a b c d e f g six"), "two one four three six five eight seven ten nine", "one " * 12, item + " pad " * 30 + item]
    bench = spark.createDataFrame([(7, item), (8, "short item here"), (9, None)], "item_id long, text string")
    docs = list(enumerate([*texts, "a short item is here", "item short", None, ""]))
    got = sorted((r["doc_id"], r["n_windows"], r["items"]) for r in dc.proximity(docs_of(*docs), bench).collect())
    assert got == sorted(brute(docs, [(7, item), (8, "short item here"), (9, None)]))


def test_odd(spark, odd):
    bench = spark.createDataFrame([(1, "one two three"), (2, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x13 w14x14 w15x15")], "item_id long, text string")
    exact, loose = dc.decontamination(odd, bench).collect(), dc.proximity(odd, bench).collect()
    assert len(exact) == len(loose) == 9
    assert sorted((r["doc_id"], tuple(r["items"])) for r in exact if r["items"]) == sorted((r["doc_id"], tuple(r["items"])) for r in loose if r["items"]) == [(3, ("1",)), (3, ("1",)), (4, ("2",))]
    for docs, items in ((odd.where("false"), bench), (odd, bench.where("false")), (odd.where("false"), bench.where("false"))):
        assert dc.decontamination(docs, items).where("n_hit > 0").count() == dc.proximity(docs, items).where("n_windows > 0").count() == 0
        assert dc.decontamination(docs, items).count() == dc.proximity(docs, items).count() == docs.count()


def test_text_of_200_000_words(spark, docs_of):
    """Every word is an anchor; the time grows with the text and not with its square."""
    text = " ".join(f"a{k % 50}" for k in range(200_000))
    bench = spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(12))), (2, "a7 b a9")], "item_id long, text string")
    docs = docs_of((1, text), (2, text + " b"))
    assert {r["doc_id"]: r["items"] for r in dc.decontamination(docs, bench).collect()} == {1: ["1"], 2: ["1"]}
    assert {r["doc_id"]: r["n_windows"] for r in dc.proximity(docs, bench).collect()} == {1: 3, 2: 3}
