"""Operator 12 against a plain version of its base and of its rounds, and on odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.llm import pii
from docweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
EXPRESSIONS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(map(int, digits[::-1])):
        total += d if k % 2 == 0 else sum(map(int, str(2 * d)))
    return total % 10 == 0


def plain_base(text):
    found = []
    for kind, expression in enumerate(EXPRESSIONS):
        for m in re.finditer(expression, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if (True, kind == 1 and all(int(x) <= 255 for x in m.group().split(".")), 16 <= len(digits) <= 19 and plain_luhn(digits), 8 <= len(digits) <= 15)[kind]:
                found.append((kind, *m.span()))
    return found


PIECES = st.sampled_from([*"a.@1+ -(%", "x@y.z", "10.0.0.1", "256", "4111 1111-1111 1111", "+1 (555) 010-0199", "4012888888881881", "\n", "é", "٣"])


@settings(max_examples=1500, deadline=None)
@given(st.lists(PIECES, max_size=25).map("".join))
def test_base(text):
    assert pii.base_spans(text) == plain_base(text)


def test_long_texts_take_time_in_proportion():
    n = 400_000
    for text in ("1" * n, "a" * n, "a." * n, "1." * n, "+" * n, "@" * n, "1 " * n, "(" * n, "+1" * n, "x(at)" * n, "é" * n + "@", "a:" * n + "1", " " * n + "(at)"):
        own = pii.base_spans(text)
        list(pii.candidates(text, sorted(s[1:] for s in own)))


def plain_scores(texts, support, high, rounds):
    """Patterns of high confidence by the definition, over dicts."""
    edges, total = Counter(), Counter()
    for t in texts:
        own = plain_base(t)
        for kind, s, e in own + [(-1, *c) for c in pii.candidates(t, sorted(x[1:] for x in own))]:
            for p in pii.contexts(t, s):
                edges[p, t[s:e].lower(), kind] += 1
        words = re.findall(r"\w+|[^\w\s]", t.lower())
        total.update(" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    degree = Counter(p for p, _, _ in edges)
    reliable, best = defaultdict(float), {}
    for _ in range(rounds):
        best = {}
        for p in (p for p in degree if degree[p] >= support):
            scores = []
            for k in range(4):
                mine = [(n, 1.0 if kind == k else reliable[i, k] if kind < 0 else 0.0) for (q, i, kind), n in edges.items() if q == p]
                s, share = sum(r for _, r in mine), min(1.0, sum(n * r for n, r in mine) / total[p])
                scores.append(round(share * s / (s + 1), 6) if s >= support else 0.0)
            if max(scores) >= high:
                best[p] = (scores.index(max(scores)), max(scores))
        reliable = defaultdict(float)
        doubt = defaultdict(lambda: 1.0)
        for p, i, kind in edges:
            if kind < 0 and p in best:
                doubt[i, best[p][0]] *= 1 - best[p][1]
        for key, d in doubt.items():
            reliable[key] = round(1 - d, 6)
    return best


TEXTS = [
    *(f"Hello there. Reach me on +1 (555) 010-0{k}99 today, thing {k}." for k in range(1, 7)),
    "Reach me on 555 0142 today, or write.",  # no base phone, but where phones are
    "My desk line 555 0142 rings.", "My desk line 555 0188 rings.", "My desk line 555 0177 rings.",
    *(f"We saw 12{k}45 things of the kind and the rest." for k in range(6)),
    *(f"mail: user{k}@example.org, thanks" for k in range(5)), "mail: jane.roe(at)example.org, thanks",
    *(f"the {10 + k}.0.0.{k} of the many" for k in range(5)), "the 1234567 of the many, the one, the two, the three, the four, the five, the six, the seven",
]


def spans_of(df):
    return {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["base"]] + [("like", s["kind"], s["start"], s["end"]) for s in r["more"]] for r in df.collect()}


def test_patterns_discover_identifiers(spark, docs_of):
    docs = docs_of(*enumerate(TEXTS))
    got = spans_of(pii.pii(docs))
    found = {(pii.KINDS[x[1]], TEXTS[d][x[2] : x[3]]) for d, spans in got.items() for x in spans if x[0] == "like"}
    assert found == {("phone", "555 0142"), ("email", "jane.roe(at)example.org")}
    assert {d: [s for s in x if s[0] != "like"] for d, x in got.items()} == {d: plain_base(t) for d, t in enumerate(TEXTS)}
    for support, high, rounds in ((3, 0.5, 1), (3, 0.5, 3), (2, 0.3, 4), (0.5, 0.1, 3)):
        scored = pii.scored_patterns(docs.select("doc_id", "text"), pii.found_in(docs), support, high, rounds)
        got = {r["pattern"]: (r["kind"], round(r["score"], 4)) for r in scored.collect()}
        want = plain_scores(TEXTS, support, high, rounds)
        assert got == {p: (k, round(s, 4)) for p, (k, s) in want.items()}
    assert "line" in got and "line" not in plain_scores(TEXTS, 0.5, 0.1, 1)  # a pattern without seeds, by a found instance


def test_query(spark):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = {r["doc_id"]: r for r in QUERIES["op12_pii"](spark, SF).collect()}
    assert rows.keys() == texts.keys()
    patterns = plain_scores_fast(texts.values())
    for d, t in texts.items():
        base = plain_base(t)
        listed = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        n = Counter(k for k, _, _ in base)
        assert [rows[d][f"n_{k}"] for k in pii.KINDS] == [n[k] for k in range(4)]
        assert rows[d]["base_sha256"] == hashlib.sha256(listed.encode()).hexdigest()
        more = []
        for s, e in pii.candidates(t, sorted(x[1:] for x in base)):
            tops = [patterns[p] for p in pii.contexts(t, s) if p in patterns]
            if tops:
                more.append((min(tops, key=lambda x: (-x[1], x[0]))[0], s, e))
        assert rows[d]["spans"] == ",".join(x for x in (listed, ",".join(f"{pii.KINDS[k]}_like:{s}:{e}" for k, s, e in sorted(more))) if x)


def plain_scores_fast(texts):
    return plain_scores(list(texts), pii.SUPPORT, pii.HIGH, pii.ROUNDS)


def test_odd(odd):
    rows = pii.pii(odd).collect()
    assert len(rows) == 9 and all(r["base"] == [] and r["more"] == [] for r in rows)
    assert pii.pii(odd.where("false")).count() == 0


def test_repeated_rows(docs_of):
    rows = [(1, TEXTS[6]), (1, TEXTS[6]), (None, TEXTS[6]), (1, "other 555 0142"), *((10 + k, t) for k, t in enumerate(TEXTS[:6]))]
    got = sorted((str(r["doc_id"]), len(r["base"]), [(s["start"], s["end"]) for s in r["more"]]) for r in pii.pii(docs_of(*rows)).collect())
    assert got == sorted([("1", 0, [(12, 20)])] * 2 + [("None", 0, [(12, 20)]), ("1", 0, [])] + [(str(10 + k), 1, []) for k in range(6)])
