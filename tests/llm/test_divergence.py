"""Operator 13: against plain Python with exact whole numbers."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from chatlens.llm import divergence as D

SCHEMA = "doc_id long, text string, lang string, source string, n int, chunk string, term string"


def brute(rows, least, top):
    texts = [("" if t is None else t, lang or "", source or "") for _, t, lang, source, *_ in rows]
    documents, counts, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in texts:
        groups[lang].add(source)
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        found = re.findall(D.TERM, lowered)
        documents.update((lang, term) for term in set(found))
        counts.update((lang, source, term) for term in found)
    out = set()
    for lang, sources in groups.items():
        kept = sorted(t for (one, t), n in documents.items() if one == lang and n >= least)
        v = len(kept)

        def shares(count):
            total = sum(count.values())
            return {t: 1 + (D.UNIT * (count[t] + 2)) // (total + 2 * v) for t in kept}

        own = {s: {t: counts[(lang, s, t)] for t in kept} for s in sources}
        p = {s: shares(own[s]) for s in sources}
        q = shares({t: sum(own[s][t] for s in sources) for t in kept})

        def f(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][t], q[t]), t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -value, rank) for rank, (value, item) in enumerate(found, 1)}
    return out


def corpus(seed, size=300):
    draw = random.Random(seed)
    words = ["the", "The,", "(the)", "a-b", "b", "É", "é", "naïve", "x y", "foo_bar", "foo", "BAR.", "12", "%%%", "日本", "\U0001f600z", "q\x00r"]
    words += [f"w{chr(97 + i)}" for i in range(12)]
    rows = []
    for i in range(size):
        # One source with a third of the rows, empty and null texts, languages and sources.
        text = " ".join(draw.choices(words, k=draw.randint(0, 12)))
        source = "hot" if i % 3 == 0 else draw.choice(["s1", "s2", "s3", None, ""])
        rows.append((i, draw.choice([text, text, text, None, "\t" + text + "\n\n"]), draw.choice(["en", "en", "de", None]), source, 1, "c", "t"))
    return rows + [rows[4]] * 5 + [(900, "lonely words", "xx", "only", 1, None, None), (None, None, "yy", "p", 1, None, None), (None, "", "yy", "q", 1, None, None)]


@pytest.mark.parametrize("least,top", [(10, 10), (3, 2), (1000, 10)])
def test_equals_plain_python(spark, least, top):
    rows = corpus(least)
    got = [tuple(r) for r in D.divergence(spark.createDataFrame(rows, SCHEMA), least, top).collect()]
    want = brute(rows, least, top)
    assert len(got) == len(want) and set(got) == want


def test_terms_spread_over_chunks_are_counted_by_documents(spark):
    # "t" is in 10 documents only when all its chunks count, and in 9 although its chunks add up to 12.
    rows = [(i, ["t", "t-u", "u_t", "t.v"][i % 4], "en", "a", 1, "", "") for i in range(10)]
    rows += [(100 + i, "z" if i % 2 else "z-y z/y", "en", "b", 1, "", "") for i in range(9)]
    kept = {r["term"]: r["n"] for r in D.kept_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {"t": 10}


def test_a_very_long_text_counts_once(spark):
    long = "alpha beta-alpha " * 200_000 + "x" * 1_000_000
    rows = [(i, long if i == 0 else "alpha", "en", "a", 1, "", "") for i in range(10)]
    kept = {r["term"]: r["n"] for r in D.kept_counts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert kept == {"alpha": 400_009}


def test_chunks_are_freed_of_outer_marks():
    owner, code, chunks = D.chunks_of(pa.array(["The, the (THE) ... 7", "", "a-B  c"]))
    assert [(int(o), chunks[int(c)].as_py()) for o, c in zip(owner, code)] == [(0, "the")] * 3 + [(2, "a-b  c")]


def test_empty_table(spark):
    assert D.divergence(spark.createDataFrame([], SCHEMA)).collect() == []
