"""Operator 11 against a plain version that runs every order, and on odd rows."""

import re
from collections import Counter, defaultdict
from itertools import permutations

from pyspark.sql import functions as F

from docweave.llm import filter_audit as fa
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """Rows of the audit for docs (doc_id, part, text) and labels (doc_id, quality, toxic)."""
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    first = {}
    rank = lambda d: (d is None, d or 0)
    for d, _, t in docs:
        first[t or ""] = min(first.get(t or "", rank(d)), rank(d))
    by_part = defaultdict(list)
    for d, part, t in docs:
        t, w = t or "", re.findall(r"[^\x20\x09-\x0D]+", t or "")
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": rank(d) > first[t]}
        by_part[part or ""].append(({k for k, v in bad.items() if v}, d in good, d in toxic))
    rows, shapley = {}, Counter()
    for part, all_docs in by_part.items():
        for order in permutations("ABCDE"):
            left = all_docs
            for step, f in enumerate(order, 1):
                out, kept = [x for x in left if f in x[0]], [x for x in left if f not in x[0]]
                fails, only = sum(f in x[0] for x in all_docs), sum(x[0] == {f} for x in all_docs)
                rows[part, "".join(order), step] = (len(kept), len(out), fails - len(out), only, sum(x[1] for x in out), sum(x[2] for x in out))
                shapley[part, f] += len(out)
                left = kept
    return sorted((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in rows.items())


COLUMNS = ("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def got(df):
    return sorted(tuple(r[c] for c in COLUMNS) for r in df.collect())


def test_query(spark):
    docs = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert got(QUERIES["op11_filter_audit"](spark, SF)) == plain(docs, labels)


def test_odd_rows_and_all_parts(spark):
    long = " ".join(f"w{k}" for k in range(60_000))
    docs = [(1, None, None), (2, "", ""), (3, "s", "A B C"), (3, "s", "A B C"), (None, "s", "A B C"), (None, "t", "only here " * 40), (4, "t", long), (5, "s", long), (6, "s", "x # y"), (7, "s", "É")]
    labels = [(3, 1, 0), (3, 0, 1), (5, None, None), (None, 1, 1), (6, 1, None), (99, 1, 1)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumns({c: F.lit("?") for c in ("part", "A", "n", "id", "h1", "words", "good", "first")})
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("id", F.lit("?"))
    out = fa.audit(df, said)
    assert got(out.where("all_parts = 0")) == plain(docs, labels)
    # Rows of all parts together are those of one part.
    whole = fa.audit(df.withColumn("source", F.lit("p")), said).where("all_parts = 0")
    assert [x[1:] for x in got(out.where("all_parts = 1").fillna({"part": "p"}))] == [x[1:] for x in got(whole)]
    assert fa.audit(df.where("false"), said).where("part IS NOT NULL").count() == 0
    assert fa.audit(df, said.where("false")).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_other_filters(spark):
    flags = spark.createDataFrame([("p", True, False, 1), ("p", True, True, 2), ("p", False, False, 3)], "part string, X boolean, Y boolean, z int").withColumn("odd", F.col("z") % 2 == 1)
    rows = {(r["filter_order"], r["step"]): (r["kept"], r["removed"], r["redundant"], r["odd_lost"], r["shapley"]) for r in fa.filter_audit(flags, ["X", "Y"], ("odd",)).where("all_parts = 0").collect()}
    assert rows == {("XY", 1): (1, 2, 0, 1, 3), ("XY", 2): (1, 0, 1, 0, 1), ("YX", 1): (2, 1, 0, 0, 1), ("YX", 2): (1, 1, 1, 1, 3)}
