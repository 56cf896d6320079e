"""Operators on documents: brute force on a small table, and the cases each docstring names."""

import sys
import tracemalloc
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path[:0] = [str(Path(__file__).resolve().parent)]
import re  # noqa: E402
import zlib  # noqa: E402

from fixtures import documents, odd_documents, prose  # noqa: E402

from chatlens.llm import hilbert, langid, line_dedup, lm, mixing, ngram_join, packing, setjoin  # noqa: E402
from chatlens.llm.common import Scratch, char_shingles, components, hash_words, lookup, word_shingles  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots(links, nodes):
    parent = {node: node for node in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {node: root(node) for node in nodes}


def shingle_set(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) >= 5:
        return {tuple(words[at : at + 5]) for at in range(len(words) - 4)}
    return {tuple(words)} if words else set()


def test_word_hashes_follow_words_across_windows():
    texts = ["One two  TWO\nthree".encode(), b"", b"w" * 700_000 + b" two", "ä Ä".encode()]
    hashes, counts = hash_words(texts)
    assert counts.tolist() == [4, 0, 2, 2]
    assert hashes[1] == hashes[2] == hashes[5] and len(set(hashes.tolist())) == 6
    sizes = [len(x) for x in word_shingles(texts)]
    assert sizes == [1, 0, 1, 1]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "a long, b long")).collect()
    got = {row["node"]: row["component"] for row in found}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(30)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_ngram_join_equals_brute_force(spark, clashing):
    rows = odd_documents()
    got = ngram_join.ngram_components(documents(spark, rows, clashing)).collect()
    sets = [(row[0], shingle_set(row[1])) for row in rows]
    links = [
        (a, b) for a, x in sets for b, y in sets
        if a is not None and b is not None and x and y and 100 * len(x & y) >= 75 * len(x | y)
    ]
    named = roots(links, {a for a, _ in sets if a is not None})
    want = Counter((a, len(x), named.get(a)) for a, x in sets)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == want


def test_opened_groups_lose_no_link(spark, monkeypatch):
    """A chain of near copies whose ends are unlike each other, with groups and chunks of few elements."""
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[2 * i : 2 * i + 60]), "en", "a", 0) for i in range(120)]
    rows += [(500 + i, " ".join(words[i : i + 60]), "en", "a", 0) for i in range(0, 200, 7)]
    got = ngram_join.ngram_components(documents(spark, rows)).collect()
    sets = [(row[0], shingle_set(row[1])) for row in rows]
    links = [(a, b) for a, x in sets for b, y in sets if 100 * len(x & y) >= 75 * len(x | y)]
    assert {r["doc_id"]: r["component_id"] for r in got} == roots(links, {a for a, _ in sets})


def test_keep_first_keeps_columns_and_odd_rows(spark):
    docs = documents(spark, clashing=True)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    ids = Counter(row["doc_id"] for row in kept.collect())
    assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[None] == 1 and ids[10] == 2 and ids[5] == ids[6] == ids[7] == 1
    assert ngram_join.keep_first(documents(spark, [])).count() == 0


@pytest.mark.parametrize("clashing", [False, True])
def test_line_classes_equal_brute_force(spark, clashing):
    lines = ["the quick brown fox jumps over the lazy dog again and again " * 3, "short", "tiny one", "", "unlike all the others, this line stands alone"]
    rows = [(1, "\n".join(lines), "en", "a", 0), (2, lines[0].replace("lazy", "hazy", 1) + "\nshort\nnew line here", "en", "a", 0),
            (3, "  tiny one  \n\n", "en", "a", 0), (None, "short", "en", "a", 0), (4, None, "en", "a", 0), (5, "a\na\na", "en", "a", 0)]
    docs = documents(spark, rows, clashing)
    got = {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"], r["kept"]) for r in line_dedup.line_classes(docs).collect()}
    flat = {(row[0], n): line for row in rows if row[0] is not None for n, line in line_dedup._lines(row[1])}
    links = []
    for a, x in flat.items():
        for b, y in flat.items():
            p, q = (set(found.tolist()) for found in char_shingles([x, y], 8))
            if 100 * len(p & q) >= 80 * len(p | q):
                links.append((a, b))
    named = roots(links, flat)
    assert got == {key: (*named[key], named[key] == key) for key in flat}
    left = {row["doc_id"]: row["text"] for row in line_dedup.dedup_lines(docs).collect()}
    assert left == {1: "\n".join(lines), 2: "new line here", None: "short", 4: None, 5: "a"}


@pytest.mark.parametrize("pairs", [0, 1 << 20])
def test_spanning_links_join_what_brute_force_joins(monkeypatch, pairs):
    monkeypatch.setattr(setjoin, "PAIRS", pairs)
    rng = np.random.default_rng(8)
    for size in (1, 2, 3, 30):
        bases = [rng.integers(0, 400, 40) for _ in range(4)]
        sets = [np.unique(np.concatenate([bases[rng.integers(4)][rng.random(40) < 0.9], rng.integers(400, 900, 2)])).astype(np.uint64) for _ in range(size)]
        left, joined = rng.random(size) < 0.7, rng.integers(0, size + 1, size)
        near = [(a, b) for a in range(size) for b in range(size) if a != b and (left[a] or left[b])
                and 100 * len(np.intersect1d(sets[a], sets[b])) >= 60 * len(np.union1d(sets[a], sets[b]))]
        together = [(a, b) for a in range(size) for b in range(size) if joined[a] == joined[b]]
        links = setjoin.spanning_links(sets, left, 60, joined)
        assert roots(links + together, range(size)) == roots(near + together, range(size))
        assert set(links) <= set(near) and all(joined[a] != joined[b] for a, b in links)
        assert roots(setjoin.spanning_links(sets, left, 60), range(size)) == roots(near, range(size))


def test_buckets_within_one_component_are_not_opened(spark):
    def sets_of(texts):
        raise AssertionError("nothing to compare")

    rows = spark.createDataFrame([(1, node, 50, 7, node != 7, True) for node in (7, 8, 9)], "bucket long, node long, n long, component long, left boolean, right boolean")
    texts = spark.createDataFrame([(node, f"text {node}") for node in (7, 8, 9)], "node long, text string")
    assert setjoin.opened_links(rows, texts, sets_of, 80).count() == 0
    with pytest.raises(Exception, match="nothing to compare"):
        setjoin.opened_links(rows.drop("component"), texts, sets_of, 80).count()


def test_rows_of_one_doc_id_are_judged_apart(spark):
    """Two texts under one id keep what only they have; of a row that stands there three times one stays."""
    one, two, three = prose(40, 21), prose(40, 22), prose(40, 23)
    rows = [(1, one, "en", "a", 0), (2, f"{one}\n{two}", "en", "a", 0), (2, f"{three}\n{prose(40, 24)}", "en", "a", 0),
            *[(3, prose(40, 25), "en", "a", at % 2) for at in range(3)], (None, one, "en", "a", 0), (None, one, "en", "a", 0),
            (4, "", "en", "a", 0), (4, None, "en", "a", 0), (4, None, "en", "a", 0)]
    docs = documents(spark, rows, clashing=True).selectExpr("*", "1 as digest", "2 as `out`", "3 as row", "4 as place", "5 as owner")
    lines = line_dedup.dedup_lines(docs)
    assert lines.columns == docs.columns
    want = Counter([(1, one), (2, two), (2, f"{three}\n{prose(40, 24)}"), (3, prose(40, 25)), (None, one), (None, one), (4, ""), (4, None)])
    assert Counter((r["doc_id"], r["text"]) for r in lines.collect()) == want
    near = [(1, one, "en", "a", 0), (2, one + " more", "en", "a", 0), *rows[2:]]
    docs = documents(spark, near, clashing=True).selectExpr("*", "1 as digest", "2 as `out`", "3 as row", "4 as place", "5 as owner")
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    want = Counter([(1, one), (2, f"{three}\n{prose(40, 24)}"), (3, prose(40, 25)), (None, one), (None, one), (4, ""), (4, None)])
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == want


def test_most_lines_equal_are_dealt_over_tasks(spark):
    """A line that two of three rows have is looked up in pieces of a thousandth of the rows; the result is the plain one."""
    rows = [(at, "the very same line in many documents\n" * 2 + f"line {at} " + prose(6, at), "en", "a", 0) for at in range(300)]
    found = line_dedup.line_classes(documents(spark, rows)).collect()
    assert len(found) == 900
    same = [r for r in found if r["line_no"] < 2]
    assert {(r["class_doc_id"], r["class_line_no"]) for r in same} == {(0, 0)}
    assert [(r["doc_id"], r["line_no"]) for r in same if r["kept"]] == [(0, 0)]
    values = spark.createDataFrame([(1, 600, "a"), (2, 300, "b")], "k long, times long, v string")
    rows = spark.range(900).selectExpr("id", "if(id % 3 < 2, 1L, 2L) as k")
    got = lookup(rows, values, "k", "times", ["id"], pieces=30)
    assert {r["id"]: r["v"] for r in got.collect()} == {at: "a" if at % 3 < 2 else "b" for at in range(900)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoop" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("length", [20, 60, 400])
def test_bands_find_lines_at_the_bound(length):
    """Of pairs of lines whose similarity is 0.80 to 0.84, at least 98 % share a band."""
    draw, hit = np.random.default_rng(length), 0
    letters = list("abcdefghijklmnopqrstuvwxyz ")
    for _ in range(400):
        base = "".join(draw.choice(letters, length + 8))
        longer = base + "".join(draw.choice(letters, (length + 1) // 4))
        x, y = (set(found.tolist()) for found in char_shingles([base, longer], 8))
        assert 80 * len(x | y) <= 100 * len(x & y) <= 84 * len(x | y)
        (a, b), _ = line_dedup.band_keys([base, longer])
        hit += bool((a == b).any())
    assert hit >= 0.98 * 400


def test_line_dedup_of_odd_and_empty_tables(spark):
    docs = documents(spark, clashing=True)
    assert line_dedup.dedup_lines(docs).columns == docs.columns
    assert line_dedup.line_classes(documents(spark, [])).count() == 0
    assert line_dedup.dedup_lines(documents(spark, [])).count() == 0


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = odd_documents()
    docs = documents(spark, rows, clashing=True)
    packing_rows = packing.pack_documents(docs, with_ids=True)
    found = packing_rows.collect()
    own = Tokenizer.from_file(public_tokenizers.path(packing.VOCABULARY))
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = [*own.encode(text or "", add_special_tokens=False).ids, 1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start : start + 4096]
            want[doc_id, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == want
    by = {}
    for r in found:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["ids"]))
    for parts in by.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    whole = {row["sequence_id"]: row["ids"] for row in packing.sequences(packing_rows).collect()}
    assert whole == {key: [i for _, _, ids in sorted(parts) for i in ids] for key, parts in by.items()}
    assert packing.pack_documents(documents(spark, [])).count() == 0


def test_unusual_characters_give_the_tokenizer_s_ids():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(packing.VOCABULARY)
    own, encode = Tokenizer.from_file(path), packing.encoder(path)
    texts = ["a\xa0b\u3000c'sun it's I'M x2y3²", "", "e\u0301 İ ẞ", "<|endoftext|>hi", "日本語 text", "Ünï ßtraße—dash…", "t\x0bv\x85z\x00", "''ll_"]
    ids, bounds = encode(texts)
    for at, text in enumerate(texts):
        assert ids[bounds[at] : bounds[at + 1]].tolist() == own.encode(text, add_special_tokens=False).ids


def test_open_sequences_close_the_fullest():
    some = packing.OpenSequences(10, 2)
    assert [some.put(n) for n in (6, 7, 3, 4, 8, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0)]
    # 2 and 3 are open with 2 and 1 free; a third one closes sequence 3, the fullest.
    assert some.put(7) == (4, 0) and some.put(1) == (2, 8)


@pytest.mark.parametrize("rows", [None, []])
def test_shards_are_gapless_and_even(spark, rows):
    docs = documents(spark, rows, clashing=True)
    found = hilbert.document_shards(docs, run=2).toPandas()
    count = docs.count()
    assert len(found) == count
    sizes = found.groupby("shard").size().reindex(range(8), fill_value=0)
    assert sizes.max() - sizes.min() <= 1
    assert all(sorted(part.slot) == list(range(len(part))) for _, part in found.groupby("shard"))
    want = Counter((zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()) + 1) for r in docs.collect())
    assert Counter(zip(found.text_crc32, found["size"], strict=True)) == want


def test_hilbert_index_visits_neighbours(spark):
    from pyspark.sql import functions as F

    cells = spark.range(1 << 9).select(*[F.expr(f"cast(shiftright(id, {3 * at}) & 7 as int)").alias(f"c{at}") for at in range(3)])
    found = cells.withColumn("h", hilbert.hilbert_index([F.col(f"c{at}") for at in range(3)], 3)).toPandas().sort_values("h")
    assert found.h.tolist() == list(range(512))
    assert (np.abs(np.diff(found[["c0", "c1", "c2"]].to_numpy(), axis=0)).sum(axis=1) == 1).all()


def test_written_shards_hold_all_documents(spark, tmp_path):
    docs = documents(spark)
    hilbert.write_shards(docs, f"{tmp_path}/out", shards=4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(r["text"] for r in back.collect()) == Counter(r["text"] for r in docs.collect())


@pytest.mark.parametrize("rows", [None, []])
def test_mix_reaches_its_targets(spark, rows):
    docs = documents(spark, rows, clashing=True)
    found = mixing.curriculum(docs, run=2).toPandas()
    assert len(found) == docs.count()
    if not len(found):
        assert mixing.mixed_documents(docs).count() == 0
        return
    assert (found.taken <= 2 * found["size"]).all()
    named = found.merge(docs.select("doc_id", "source").distinct().toPandas(), on="doc_id")
    sources = named.drop_duplicates("source")
    assert abs(found["size"].sum() * 1.5 - sources.target.sum()) < 1e-6
    assert found.taken.sum() == sum(int(target) for target in sources.target)
    out = mixing.mixed_documents(docs, run=2)
    assert out.columns == docs.columns
    taken = sum(len(WORD.findall(r["text"] or "")) for r in out.collect())
    assert taken == found.taken.sum()


def test_positions_follow_the_schedule(spark):
    from pyspark.sql import functions as F

    times = [0.0, 0.1, 0.37, 0.8, 1.0]
    for slope in mixing.SLOPES:
        demand = [(1000.0 * (t + slope * (t - t * t)), t) for t in times]
        rows = spark.createDataFrame(demand, "d double, t double")
        got = rows.select(mixing.training_position(F.col("d"), F.lit(1000.0), F.lit(slope)).alias("p"), "t").collect()
        assert all(abs(row["p"] - row["t"]) < 1e-9 for row in got)


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    evidence = langid.documents_evidence(docs)
    # A fifth of the documents declare nothing, so their language must come from the text and the others.
    from pyspark.sql import functions as F

    hidden = evidence.withColumn("declared", F.when(F.col("doc_id") % 5 != 0, F.col("declared")))
    got = langid.identify(hidden).join(docs.select("doc_id", "lang"), "doc_id").filter("doc_id % 5 = 0").toPandas()
    assert (got.language == got.lang).mean() > 0.98 and got.accepted.mean() > 0.98


def test_language_id_of_odd_rows(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = documents(spark, [(10_000 + i, *row[1:]) for i, row in enumerate(odd_documents())]).unionByName(base)
    got = {r["doc_id"]: r for r in langid.identify(langid.documents_evidence(docs)).collect()}
    assert not got[10_004]["accepted"] and not got[10_005]["accepted"] and not got[10_014 - 2]["accepted"] is None
    assert not got[10_000 + 14]["accepted"]
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    assert langid.identify(langid.documents_evidence(documents(spark, []))).count() == 0
    foreign = documents(spark, [(1, "кто это там стоит " * 40, "ru", "z", 1)]).unionByName(base)
    assert not {r["doc_id"]: r["accepted"] for r in langid.identify(langid.documents_evidence(foreign)).collect() if r["language"] == "other"}.get(1, False)


@pytest.mark.parametrize("last", [None, ""])
@pytest.mark.parametrize("before", [[], [(1, "the house is on the hill", "en", "a", 0)]])
def test_language_id_of_a_last_text_without_bytes(spark, before, last):
    docs = documents(spark, [*before, (2, last, "en", "a", 0)]).coalesce(1)
    got = {r["doc_id"]: r for r in langid.identify(langid.documents_evidence(docs)).collect()}
    assert len(got) == len(before) + 1 and not got[2]["accepted"] and got[2]["text_language"] is None
    assert langid.keep_identified(docs).columns == docs.columns


def test_all_pages_of_a_document_are_evidence(spark):
    pages = spark.createDataFrame(
        [("http://a.org/1", "<html lang='de'>"), ("http://a.org/1.html", "<HTML class=x LANG = 'DE-at'>"), ("http://b.net/1", "<html>"),
         ("http://b.net/2", '<html data-x="' + "y" * 500 + '" lang="fr">'), ("http://b.net/none", "<html lang=es>")], "url string, html string")
    evidence = langid.pages_evidence(pages)
    found = {(r["doc_id"], r["host"], r["n"]): (r["declared"] or "").lower() for r in evidence.collect()}
    assert {(1, "b.net", 1): "", (2, "b.net", 1): "fr"}.items() <= found.items()
    assert sum(r["n"] for r in evidence.filter("doc_id = 1 and lower(declared) = 'de'").collect()) == 2

    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs = base.unionByName(documents(spark, [(90_001, None, None, None, 1), (90_001, None, None, None, 1)]))
    schema = "doc_id long, declared string, suffix string, host string, domain string, n long"

    def posterior(*rows):
        more = spark.createDataFrame([(90_001, declared, None, host, None, n) for declared, host, n in rows], schema)
        rows = langid.identify(langid.documents_evidence(docs), more=more).filter("doc_id = 90001").collect()
        assert len(rows) == 2 and rows[0] == rows[1]
        return rows[0]["language"], rows[0]["posterior"]

    one, both = posterior(("de", None, 1)), posterior(("de", None, 1), ("fr", None, 3))
    assert one[0] == "de" and both[0] == "fr"


def test_pipeline_gives_language_id_the_pages(spark, monkeypatch):
    import corpus_pipeline
    from chatlens.llm import catalog

    folder, given, identify = "/root/testdata/sf0.001", [], langid.identify

    def seen(docs, languages=langid.LANGUAGES, least=langid.LEAST, more=None):
        given.append(more)
        return identify(docs, languages, least, more)

    monkeypatch.setattr(langid, "identify", seen)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {row["doc_id"] for row in corpus_pipeline.language_id(spark, docs, folder).collect()}
    assert kept == {row["doc_id"] for row in catalog.op7_language_id(spark, folder).filter("accepted").collect()}
    assert all(more is not None and more.count() for more in given) and len(given) == 2


def test_language_model_learns_and_scores_all(spark):
    docs = documents(spark, [(i, "the cat sat on the mat and the dog sat on the rug " * 40, "en", "a", 0) for i in range(6)]
                     + [(7, None, "en", "a", 0), (8, "", "en", "a", 0), (None, "the mat", "en", "a", 0)])
    first, later = lm.pseudo_likelihood(docs, 0).toPandas(), lm.pseudo_likelihood(docs, 6).toPandas()
    assert len(first) == len(later) == 9
    assert later.log_likelihood.sum() > 0.8 * first.log_likelihood.sum()
    assert later.n_tokens.sum() == 6 * 13 * 40 + 2 and later.per_token.isna().sum() == 2
    assert lm.pseudo_likelihood(documents(spark, []), 1).count() == 0


def hashes_of(text):
    return hash_words([(text or "").encode()])[0].view(np.int64).tolist()


def topics(words=60, documents_each=40, seed=5):
    """Documents of runs of 30 words of one of four topics, whose words differ but are alike in counts."""
    draw = np.random.default_rng(seed)
    names = [[f"t{topic}w{at}" for at in range(words)] for topic in range(4)]
    share = 1 / np.arange(1, words + 1)
    return [" ".join(word for _ in range(12) for word in draw.choice(names[draw.integers(4)], 30, p=share / share.sum())) for _ in range(documents_each)]


def test_score_equals_the_network_word_by_word(spark):
    """The rows of the whole path against its network asked word by word, and shares counted from the texts."""
    texts = [*topics(30, 8), "one two three one two four one two three five", "alone", "", None]
    docs = documents(spark, [(i, text, "en", "a", 0) for i, text in enumerate(texts)])
    known, network, tables = lm.modelled(docs)
    width, kind_of = lm._width(network.classes), {}
    for row in known.collect():
        assert [len(hashes_of(texts[doc])) for doc in row["doc_ids"]] == row["counts"]
        words = [word for doc in row["doc_ids"] for word in hashes_of(texts[doc])]
        for word, kind in zip(words, np.frombuffer(row["kinds"], width).tolist(), strict=True):
            assert kind_of.setdefault(word, kind) == kind
    tables.clear()
    totals = Counter(word for text in texts for word in hashes_of(text))
    within = Counter()
    for word, n in totals.items():
        within[kind_of[word]] += n
    got = {row["doc_id"]: row["log_likelihood"] for row in lm.pseudo_likelihood(docs).collect()}
    edge = [network.classes] * 2
    for doc, text in enumerate(texts):
        words = hashes_of(text)
        row, want = [*edge, *[kind_of[word] for word in words], *edge], 0.0
        for at, word in enumerate(words):
            _, scores = network.forward(np.array([[row[at], row[at + 1], row[at + 3], row[at + 4]]]))
            # What lies behind the last class has a probability of nearly nothing.
            assert abs(np.exp(scores[0].astype(float)).sum() - 1) < 1e-4
            want += scores[0, row[at + 2]] + np.log(totals[word] / within[row[at + 2]])
        assert abs(got[doc] - want) < 1e-3 * max(len(words), 1)


def test_neighbours_tell_words_of_like_counts_apart(spark):
    """Better than word frequencies by most of what the topic tells, and worse on the same words without their order."""
    texts = topics()
    draw = np.random.default_rng(7)
    mixed = [" ".join(draw.permutation(text.split())) for text in texts]
    rows = [(i, text, "en", "a", 0) for i, text in enumerate(texts)]
    totals = Counter(word for text in texts for word in text.split())
    unigram = sum(n * np.log(n / sum(totals.values())) for n in totals.values()) / sum(totals.values())
    alone = lm.pseudo_likelihood(documents(spark, rows), 4).toPandas()
    assert alone.log_likelihood.sum() / alone.n_tokens.sum() > unigram + 0.5
    both = lm.pseudo_likelihood(documents(spark, rows + [(1000 + i, text, "en", "a", 0) for i, text in enumerate(mixed)]), 4).toPandas()
    assert both[both.doc_id < 1000].per_token.mean() > both[both.doc_id >= 1000].per_token.mean() + 0.2


def test_words_of_a_topic_share_a_cluster(spark):
    docs = documents(spark, [(i, text, "en", "a", 0) for i, text in enumerate(topics(150, 60))])
    rows = lm.table(lm.encoded(docs), "test-rows")
    own = lm.own_words(lm.word_totals(rows))
    seen = lm.neighbours(rows, own)
    kind = lm.clusters(seen, 4)
    names = {word: int(name[1]) for name in {word for text in topics(150, 60) for word in text.split()} for word in hashes_of(name)}
    found = lm.voted(rows, own, kind, lm.evidence(seen, kind, 4))
    words = found.select("part", "at", "word").join(lm.settled(found), ["part", "at"]).toPandas()
    best, mine = words[words.own < 0], words[words.own >= 0]
    assert best.groupby("word").cluster.nunique().max() == 1 and mine.own.nunique() == len(own.counts)
    assert best.groupby("word").total.first().to_dict() == best.groupby("word").n.sum().to_dict()
    best = best.drop_duplicates("word")
    pairs = Counter((names[word], cluster) for word, cluster in zip(best.word, best.cluster, strict=True))
    main = {topic: max(range(4), key=lambda c: pairs[topic, c]) for topic in range(4)}
    assert len(set(main.values())) == 4
    assert sum(n for (topic, c), n in pairs.items() if main[topic] == c) > 0.95 * sum(pairs.values())


def test_votes_of_a_large_dictionary_stay_small():
    rng = np.random.default_rng(3)
    counts, words = np.full(40, 10_000), 50_000
    local = np.concatenate([np.arange(words), (rng.random(350_000) ** 6 * words).astype(np.int64)])
    own = np.where(np.arange(words) < 500, np.arange(words), -1)
    kind, speaks = rng.integers(0, 40, 500), np.vstack([rng.normal(size=(lm.BUCKETS, 40)), np.zeros(40)]).astype(np.float32)
    padded, place = lm._contexts(local, counts, words)
    tracemalloc.start()
    best, lead = lm.votes(local, padded, place, own, kind, speaks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 45e6
    # By a plain sum over the first votes.
    near = np.append(np.where(own >= 0, own % lm.BUCKETS, lm.BUCKETS), lm.BUCKETS)[padded]
    scores = np.zeros((words, 40))
    for shift in lm._SHIFTS:
        np.add.at(scores, local, speaks[near[place + shift]])
    sums = np.zeros((words, 40), np.float32)
    labels, order = np.append(np.where(own >= 0, own % lm.BUCKETS, lm.BUCKETS), lm.BUCKETS), np.argsort(local)
    for some, found in lm._said(order, np.concatenate([[0], np.cumsum(np.bincount(local))]), labels[padded], place, speaks):
        sums[some] = found
    assert np.abs(sums - scores).max() < 1e-3 * np.abs(scores).max()
    assert len(best) == len(lead) == words and 0 <= best.min() <= best.max() <= 40


def test_tasks_of_the_model_take_one_row_at_a_time(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)

    def watched(make):
        def wrapped(rows, *args):
            def look(batches):
                for batch in batches:
                    sizes.add(int(batch.num_rows > 1))
                    yield batch

            return make(rows.mapInArrow(look, rows.schema), *args)

        return wrapped

    monkeypatch.setattr(lm, "DICTIONARY", 100)
    monkeypatch.setattr(lm, "STRETCH", 1000)
    for name in ("word_totals", "neighbours", "voted", "scored_rows"):
        monkeypatch.setattr(lm, name, watched(getattr(lm, name)))
    docs = documents(spark, [(i, text, "en", "a", 0) for i, text in enumerate(topics(60, 20))]).coalesce(1)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    assert lm.pseudo_likelihood(docs, 1).count() == 20
    assert sizes.value == 0 and spark.conf.get(key) == before


def test_no_words_share_a_count_and_classes_grow_with_the_words(spark):
    names = [f"w{i}" for i in range(20_000)]
    texts = ["w7 " * 500, "w8", "", None, *names]
    docs = documents(spark, [(i, text, "en", "a", 0) for i, text in enumerate(texts)])
    truth = Counter(word for text in texts for word in hashes_of(text))
    totals = lm.table(lm.word_totals(lm.encoded(docs)), "test-totals")
    assert {row["word"]: row["total"] for row in totals.collect()} == truth
    own = lm.own_words(totals)
    assert own.number == int(np.ceil(np.sqrt(20_000))) > lm.CLASSES and len(own.counts) == own.number * 3 // 4
    known, network, tables = lm.modelled(docs)
    assert own.number - 40 <= network.classes <= own.number + 40
    assert sum(len(row["kinds"]) for row in known.collect()) == lm._width(network.classes).itemsize * sum(truth.values())
    tables.clear()
    got = {row["doc_id"]: row["log_likelihood"] for row in lm.pseudo_likelihood(docs).filter("doc_id < 4").collect()}
    assert len(got) == 4 and got[2] == got[3] == 0 and got[0] / 500 > got[1] + 3


def test_model_stands_long_texts_and_clashing_columns(spark):
    found = lm.pseudo_likelihood(documents(spark, [*odd_documents(), (99, "a b c " * 400_000, "en", "a", 0)], clashing=True)).toPandas()
    want = [len(WORD.findall(text or "")) for text in [*[row[1] for row in odd_documents()], "a b c " * 400_000]]
    assert sorted(found.n_tokens) == sorted(want) and np.isfinite(found.log_likelihood).all()


def test_sums_over_tasks(spark):
    values = [np.arange(150_000) * k for k in range(1, 5)]

    def give(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                yield from lm._blocks(values[k])

    rows = spark.range(4).repartition(3).mapInArrow(give, "at int, block binary")
    assert (lm.summed(rows, 150_000) == sum(values)).all()


def test_every_word_is_a_target_of_training(spark):
    assert all(sorted(lm.positions(length)) == list(range(length)) for length in range(40))
    start = lm.Network.start(np.full(lm.CLASSES, 1 / lm.CLASSES), np.zeros(lm.CLASSES, int))
    kinds = np.array([5, 70, 9, 5, 90], np.uint16)
    rows = spark.createDataFrame([([2, 3], bytearray(kinds.tobytes()))], "counts array<long>, kinds binary")
    after = lm.trained(rows, start)
    edge = lm.CLASSES
    context = np.array([[edge, edge, 70, edge], [edge, 5, edge, edge], [edge, edge, 5, 90], [edge, 9, 90, edge], [9, 5, edge, edge]])
    assert (after.log_probability(context, kinds) > start.log_probability(context, kinds)).all()


def test_a_small_table_has_few_files(spark):
    scratch = Scratch(spark)
    many = spark.range(2000).repartition(64, "id")
    assert len(scratch.table(many, "few", 2000).inputFiles()) <= 16
    assert len(scratch.table(many, "more", 1_000_000).inputFiles()) > 16
    assert scratch.table(many, "few", 2000).count() == 2000
    scratch.clear()
