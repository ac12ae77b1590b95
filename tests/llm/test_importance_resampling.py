"""Operator 13 against a plain version, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import importance_resampling as ir
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[k : k + n]) for n in (1, 2, 3) for k in range(len(words) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode()) % 10000


def plain(docs, target):
    """Rows (doc_id, n_features, weight, score, rank) for rows (doc_id, text)."""
    split = [(d, *features(t)) for d, t in docs]
    s, t = Counter(bucket(f) for _, _, fs in split for f in fs), Counter(bucket(f) for x in target for f in features(x)[1])
    n, m = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (n + 10000) / ((s[b] + 1) * (m + 10000)))) for b in range(10000)]
    rows = []
    for d, words, fs in split:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(f)] for f in fs)
        rows.append((d, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)))
    fit = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {}
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        rank.setdefault(r[:4], []).append(k)
    return [(*r[:4], rank[r[:4]].pop(0) if rank.get(r[:4]) else None) for r in rows]


def got(df):
    return sorted(map(repr, (tuple(r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")) for r in df.collect())))


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert got(QUERIES["op13_importance_resampling"](spark, sf)) == sorted(map(repr, plain(docs, target)))


@pytest.mark.parametrize("chunk", [3, 40, 1 << 18])
def test_chunks_change_nothing(spark, docs_of, chunk):
    """Long texts, repeated rows and shared ids, cut finely and not at all."""
    long = " ".join(f"w{k % 97}" for k in range(3000))
    docs = [(k, f"Plain words of text {k}, with some more Words to make it twenty or so; that is enough: one two three four five six seven") for k in range(60)]
    docs += [(100, long), (100, long), (100, long + " end"), (None, long), (None, None), (101, ""), (102, "?? !"), (103, "x" * 5000), (104, "É é ß 12 -- 中文 word")]
    target = ["some words of text", None, "w1 w2 w3"]
    bench = spark.createDataFrame(list(enumerate(target)), "doc_id long, text string")
    assert got(ir.resample(docs_of(*docs), bench, chunk=chunk)) == sorted(map(repr, plain(docs, target)))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "bb", "ccc", " ", "  ", "é", "-", "A"]), max_size=40).map("".join), st.integers(1, 9))
def test_each_run_starts_in_one_chunk(text, size):
    data = text.encode().translate(ir.TABLE)
    parts = [(x.split(), carried) for _, x, carried in ir.chunks(data, size)]
    runs = Counter(b" ".join(w[k : k + n]) for w, carried in parts for n in (1, 2, 3) for k in range(len(w) - carried) if k + n <= len(w))
    assert runs == Counter(f.encode() for f in features(text)[1])
    assert sorted(b for w, c in parts for b in ir.buckets_of(w, c).tolist()) == sorted(map(bucket, features(text)[1]))


def test_odd(spark, odd):
    bench = spark.createDataFrame([(1, "one two three")], "doc_id long, text string")
    rows = ir.resample(odd, bench).collect()
    assert len(rows) == 9 and {r["doc_id"]: r["n_words"] for r in rows}[4] == 30_000
    assert [r["weight"] for r in rows if r["doc_id"] in (1, 2)] == [0, 0]
    assert ir.resample(odd.where("false"), bench).count() == 0
    assert got(ir.resample(odd, bench.where("false"))) == sorted(map(repr, plain([(r["doc_id"], r["text"]) for r in odd.collect()], [])))
