"""Top-k search, near vectors and URL rules against brute force, with the cases their docstrings name."""

import numpy as np
import pytest

from chatlens.llm import epsgrid, topk, urls


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long, v string")


def odd_vectors(dims=12, count=260):
    draw = np.random.default_rng(5)
    rows = []
    for i in range(count):
        base = draw.normal(size=dims) * (1 + 3 * (i % 7 == 0))
        rows.append([i, [float(x) for x in base.astype(np.float32)], i % 3, None, None])
    for i in range(60):
        near = np.array(rows[i % 9][1]) * (1 + 0.02 * draw.normal(size=dims))
        rows.append([1000 + i, [float(x) for x in near.astype(np.float32)], (i % 9) % 3, None, None])
    rows += [[2000 + i, rows[0][1], 0, None, None] for i in range(25)]
    rows += [[40, rows[3][1], 1, None, None], [3000, None, 1, None, None], [3020, [0.0] * dims, 1, None, None],
             [3040, [float("nan")] + [1.0] * (dims - 1), 1, None, None], [3060, [None] + [1.0] * (dims - 1), 1, None, None],
             [3080, [float("inf")] * dims, 1, None, None], [3100, rows[1][1], None, None, None], [None, rows[1][1], 1, None, None],
             [3120, rows[1][1][:5], 1, None, None]]
    return rows


def usable(values):
    return values is not None and all(x is not None and np.isfinite(x) for x in values)


@pytest.mark.parametrize("block, chunk", [(8192, 2048), (16, 5)])
def test_top_k_equals_brute_force(spark, block, chunk):
    rows = odd_vectors()
    q = topk.quantised(vectors(spark, rows))
    got = topk.top_k(q, q.filter("vec_id % 20 = 0"), block=block, chunk=chunk).toPandas()
    width = 12
    good = [(r[0], [int(np.floor(64 * float(np.float32(x)))) for x in r[1]]) for r in rows if r[0] is not None and usable(r[1])]
    full = np.array([v + [0] * (width - len(v)) for _, v in good], np.int64)
    ids = np.array([i for i, _ in good])
    for query in sorted({i for i, _ in good if i % 20 == 0}):
        mine = min(v for i, v in good if i == query)
        score = full @ np.array(mine + [0] * (width - len(mine)))
        at = np.flatnonzero(ids != query)
        top = at[np.lexsort((ids[at], -score[at]))][:20]
        part = got[got.query_id == query].sort_values("rank")
        assert part.vec_id.tolist() == ids[top].tolist() and part.score.tolist() == score[top].tolist()
    assert set(got.query_id) == {i for i, _ in good if i % 20 == 0}


def test_top_k_of_few_and_none(spark):
    q = topk.quantised(vectors(spark, [[20, [1.0, 2.0], 1, None, None], [21, [3.0, 1.0], 1, None, None]]))
    assert [tuple(r) for r in topk.top_k(q, q.filter("vec_id % 20 = 0")).collect()] == [(20, 1, 21, 64 * 192 + 128 * 64)]
    empty = topk.quantised(vectors(spark, []))
    assert topk.top_k(empty, empty).count() == 0


@pytest.mark.parametrize("block", [1024, 7])
def test_near_vectors_equal_brute_force(spark, block):
    rows = odd_vectors()
    got = epsgrid.embedding_components(vectors(spark, rows), block=block).toPandas()
    assert len(got) == len(rows)
    keyed = [(r[0], np.array(r[1], np.float32).astype(float), r[2]) for r in rows
             if r[0] is not None and r[2] is not None and usable(r[1]) and any(r[1])]
    links, parent = {}, {r[0]: r[0] for r in rows if r[0] is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x, p) in enumerate(keyed):
        for b, y, s in keyed[i + 1 :]:
            if p == s and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98:
                links.setdefault(a, []).append(b)
                links.setdefault(b, []).append(a)
                m, n = root(a), root(b)
                parent[max(m, n)] = min(m, n)
    repeated = {40}
    for row in got.itertuples():
        if row.vec_id is None or np.isnan(row.vec_id):
            assert row.n_links == 0 and row.kept
        else:
            assert row.component_id == root(row.vec_id) and row.kept == (row.vec_id == row.component_id)
            if row.vec_id not in repeated:
                assert row.n_links == len(links.get(row.vec_id, []))
    assert epsgrid.embedding_components(vectors(spark, [])).count() == 0


URLS = [
    (1, "http://www.Example.COM/en/1?x"), (2, "https://a.example.com/en/"), (3, "example.com/en/"), (4, None), (5, "ftp://x.net/es/#a"),
    (6, "http://net/fr/x"), (7, "http://planet/fr/"), (8, "http://example.com"), (9, "http://evil.org/x.example.com/en/"), (10, "://"),
    (11, "http://EXAMPLE.com#/en/"), (12, ""), (13, "a://b://www.example.com/en/"), (14, "http://example.com/" + "y" * 100_000), (None, "http://x.com/"),
    (15, "http://example.com:80/en/"), (2, "http://ünï.com/ß?q"),
]


def test_url_rules_equal_a_plain_reading(spark):
    pages = spark.createDataFrame([(*row, None, None) for row in URLS], "page_id long, url string, host string, rule string")
    got = sorted((r["page_id"] or 0, r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(pages).collect())
    want = []
    for page, url in URLS:
        host = path = ""
        if url and "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, tail = rest[:cut], rest[cut:]
            path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        want.append((page or 0, host, path, best[1], best[2]))
    assert got == sorted(want, key=lambda r: (r[0], r[1]))  or sorted(map(str, got)) == sorted(map(str, want))


def test_no_rules_and_no_pages(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    found = urls.judge(pages, rules=[], default="block").collect()
    assert len(found) == len(URLS) and {(r["rule"], r["verdict"]) for r in found} == {(None, "block")}
    assert urls.judge(pages.limit(0)).count() == 0 and urls.judge(pages.limit(0), rules=[]).count() == 0


def test_wildcards_and_many_words():
    rules = [("block", "ads.com", "/*/banner"), ("allow", "a?c.org", "/x*y"), ("allow", "shop*.net", "/")] * 9
    machine = urls.compile_rules(rules)
    assert machine.words > 2
    seen = [b".x.ads.com\xff/p/q/banner1", b".ads.com\xff/banner", b".abc.org\xff/x123y", b".badads.com\xff/1/banner", b".q\xff/.ads.com/a/banner",
            b".shop77.net\xff/", b".shop\xff/.net/"]
    fits = urls.fitting(machine, seen, area=64)
    assert (fits[:, :3] == fits[:, 24:]).all()
    assert fits[:, :3].astype(int).tolist() == [[1, 0, 0], [0, 0, 0], [0, 1, 0], [0, 0, 0], [0, 0, 0], [0, 0, 1], [0, 0, 0]]
    assert urls.judge.__doc__
