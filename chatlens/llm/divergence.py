"""Operator 13: how far the words of each source stray from its language and from other sources.

Texts are not tokenized. They are split at white space into chunks, which are counted per document;
each globally distinct chunk is tokenized once, and its terms are joined back to the counts. A chunk is
first freed of outer characters that belong to no term and its A-Z lower-cased, so that ``The,``
and ``the`` are one chunk; its terms stay the same.

A term is kept where enough documents of its language hold it. The number of documents of a chunk is
known from the counts. A term is in at least as many documents as its commonest chunk and in at most the sum
over its chunks; where these bounds leave the question open, the distinct documents are counted in a
second read of the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatlens.llm.common import Scratch, hash_words, slices, table

# Fixed values of the audit: what a term is, how many documents keep it, how finely probabilities are
# counted, how many terms are listed.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
LEAST = 10
UNIT = 1_000_000_000
TOP = 10

_OUTSIDE = "".join(chr(c) for c in [*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
_SLICE = 16 << 20
_BITS = 24


def _documents(docs: DataFrame) -> DataFrame:
    """The three columns that matter; null is empty."""
    return docs.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in ("text", "lang", "source")])


def chunks_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(text, chunk) of every occurrence as numbers, and the chunks they stand for."""
    words = pc.ascii_split_whitespace(texts)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets.to_numpy()))
    coded = words.flatten().dictionary_encode()
    bare = pc.ascii_lower(pc.ascii_trim(coded.dictionary, _OUTSIDE)).dictionary_encode()
    code = bare.indices.to_numpy()[coded.indices.to_numpy()].astype(np.int64) if len(owner) else np.zeros(0, np.int64)
    filled = pc.greater(pc.binary_length(bare.dictionary), 0).to_numpy(zero_copy_only=False)
    inside = filled[code] if len(code) else np.zeros(0, bool)
    return owner[inside], code[inside], bare.dictionary


def _parts(batches):
    """Stretches of rows with about ``_SLICE`` bytes of text."""
    for batch in batches:
        size = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False)
        for low, high in slices([range(n) for n in size], _SLICE):
            yield batch.slice(low, high - low)


def chunk_counts(docs: DataFrame) -> DataFrame:
    """(chunk, lang, source, n, d): occurrences and documents, several rows for a chunk and group."""

    def count(batches):
        for part in _parts(batches):
            owner, code, chunks = chunks_of(part.column("text"))
            seen: dict = {}
            pairs = zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)
            group = np.array([seen.setdefault(pair, len(seen)) for pair in pairs], np.int64)
            # One sort puts occurrences in order of chunk, group and document.
            key = np.sort((code * len(seen) + group[owner]) * part.num_rows + owner)
            if not len(key):
                continue
            cell = key // part.num_rows
            fresh = np.concatenate([[True], cell[1:] != cell[:-1]])
            start = np.flatnonzero(fresh)
            new_doc = fresh | np.concatenate([[True], key[1:] != key[:-1]])
            n = np.diff(np.append(start, len(key)))
            d = np.add.reduceat(new_doc.astype(np.int64), start)
            which = pa.array(cell[start] % len(seen))
            names = [pa.array([pair[at] for pair in seen], pa.string()).take(which) for at in (0, 1)]
            taken = chunks.take(pa.array(cell[start] // len(seen)))
            yield pa.RecordBatch.from_arrays([taken, *names, pa.array(n), pa.array(d)], ["chunk", "lang", "source", "n", "d"])

    return docs.mapInArrow(count, "chunk string, lang string, source string, n long, d long")


def terms_of(chunks: DataFrame) -> DataFrame:
    """(chunk, term, k): how often each term is in each of the distinct chunks."""
    found = chunks.select("chunk", F.explode(F.regexp_extract_all("chunk", F.lit(TERM), F.lit(0))).alias("term"))
    return found.groupBy("chunk", "term").agg(F.count(F.lit(1)).alias("k"))


def _places(chunks: pa.Array) -> np.ndarray:
    """A place in a bitmap of fixed size for each chunk."""
    hashes, _ = hash_words([chunk.encode("utf-8", "surrogatepass") for chunk in chunks.to_pylist()], lower=False)
    return (hashes >> np.uint64(64 - _BITS)).astype(np.int64)


def _bitmap(chunks: DataFrame) -> np.ndarray:
    """Places taken by ``chunks``, as a bitmap of 2 MB whatever their number."""

    def mark(batches):
        own = np.zeros(1 << _BITS, bool)
        for batch in batches:
            own[_places(batch.column("chunk"))] = True
        words = np.packbits(own, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], ["at", "word"])

    words = np.zeros(1 << (_BITS - 6), np.int64)
    for row in chunks.mapInArrow(mark, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).collect():
        words[row["at"]] = row["word"]
    return words


def _pairs_with(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc, lang, chunk): distinct chunks of every document, all that are in ``chunks`` and few others."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(chunks))

    def look(batches):
        base, marked = TaskContext.get().partitionId() << 40, shared.value
        for part in _parts(batches):
            owner, code, found = chunks_of(part.column("text"))
            places = np.zeros(len(found), np.int64)
            filled = np.flatnonzero(pc.greater(pc.binary_length(found), 0).to_numpy(zero_copy_only=False))
            places[filled] = _places(found.take(pa.array(filled)))
            known = ((marked[places >> 6] >> (places & 63)) & 1).astype(bool)
            hit = known[code] if len(code) else np.zeros(0, bool)
            pair = np.unique(owner[hit] * max(1, len(found)) + code[hit])
            owner, code = pair // max(1, len(found)), pair % max(1, len(found))
            columns = [pa.array(base + owner), part.column("lang").take(pa.array(owner)), found.take(pa.array(code))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "lang", "chunk"])
            base += part.num_rows

    return docs.mapInArrow(look, "doc long, lang string, chunk string")


def kept_counts(docs: DataFrame, least: int = LEAST, scratch: Scratch | None = None) -> DataFrame:
    """(lang, source, term, n): occurrences of every term that ``least`` documents of its language hold.

    Every row is a document of its own, also with a repeated or null id. Needs no id column.
    """
    docs = _documents(docs)
    write = scratch.table if scratch else table
    # One shuffle by chunk serves the counts, the distinct chunks and the join.
    counts = chunk_counts(docs).repartition("chunk").groupBy("chunk", "lang", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    counts = write(counts, "chunks")
    terms = write(terms_of(counts.select("chunk").distinct()), "terms")
    joined = counts.hint("merge").join(terms, "chunk")
    each = joined.groupBy("lang", "chunk", "term").agg(F.sum("d").alias("d"))
    bounds = each.groupBy("lang", "term").agg(F.max("d").alias("low"), F.sum("d").alias("high"))
    bounds = write(bounds.filter(F.col("high") >= least), "bounds")
    open_ = bounds.filter(F.col("low") < least).select("lang", "term")
    # The open terms are counted document by document.
    linked = write(each.join(open_.hint("merge"), ["lang", "term"]).select("lang", "chunk", "term"), "open")
    met = _pairs_with(docs, linked.select("chunk").distinct()).join(linked.hint("merge"), ["lang", "chunk"])
    exact = met.select("doc", "lang", "term").distinct().groupBy("lang", "term").agg(F.count(F.lit(1)).alias("documents"))
    kept = bounds.filter(F.col("low") >= least).select("lang", "term")
    kept = kept.unionByName(exact.filter(F.col("documents") >= least).select("lang", "term"))
    summed = joined.groupBy("lang", "source", "term").agg(F.sum(F.col("n") * F.col("k")).alias("n"))
    return summed.join(kept.hint("merge"), ["lang", "term"]).select("lang", "source", "term", "n")


def _probability(count: Column | str, total: str = "total", terms: str = "terms") -> Column:
    """1 + floor(UNIT * (count + 2) / (total + 2 * terms)), in whole numbers."""
    up = (F.col(count) if isinstance(count, str) else count).cast("decimal(20,0)") + F.lit(2).cast("decimal(1,0)")
    up = (up * F.lit(UNIT).cast("decimal(10,0)")).cast("decimal(38,0)")
    down = F.col(total).cast("decimal(20,0)") + F.col(terms).cast("decimal(20,0)") * F.lit(2).cast("decimal(1,0)")
    return F.lit(1).cast("long") + F.call_function("div", up, down.cast("decimal(38,0)"))


def _difference(p: str, q: str) -> Column:
    gap = F.col(p) - F.col(q)
    return F.call_function("div", gap * gap, F.col(p) + F.col(q))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) for every (lang, source) of ``docs`` (text, lang, source).

    ``pair`` rows compare the group with each other source of its language over all kept terms,
    ``term`` rows are its ``top`` terms above the language's share. Null is an empty text, language or source. Ties go to
    the item that comes first in UTF-8. A language without kept terms gives pairs of value 0,
    a group alone in its language gives none, an empty table no rows. Other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.table(kept_counts(docs, least, scratch), "kept")
    groups = _documents(docs).select("lang", "source").distinct()
    spoken = counts.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    of_lang = spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total"))
    of_group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang.select("lang", "terms"), "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in ("total", "own", "terms")])
    # A term the group does not use has the probability of the count 0.
    zero = F.when(F.col("terms") > 0, _probability(F.lit(0))).alias("zero")
    groups = scratch.table(groups.select("*", zero), "groups")

    totals = groups.filter("terms > 0").select("lang", "source", "total", "terms")
    shares = counts.join(totals, ["lang", "source"]).select("lang", "source", "term", _probability("n").alias("p"))
    shares = scratch.table(shares, "shares")
    usual = spoken.join(of_lang, "lang").select("lang", "term", _probability("n").alias("q"))
    above = shares.join(usual, ["lang", "term"]).filter("p > q")
    above = above.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _difference("p", "q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    listed = above.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)

    pairs = _pair_values(groups, shares)
    pairs = pairs.withColumn("rank", F.row_number().over(order))
    result = scratch.table(pairs.unionByName(listed), "divergence")
    for path in list(scratch.paths[:-1]):
        scratch.drop(path)
    return result


def _pair_values(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """Sums over all kept terms for each ordered pair of sources of a language.

    Terms that neither uses differ by one constant, terms that one uses depend on its count alone;
    only terms that both use are compared one by one.
    """
    one = groups.select("lang", F.col("source").alias("a"), F.col("zero").alias("zero_a"), F.col("own").alias("own_a"), "terms")
    two = groups.select("lang", F.col("source").alias("b"), F.col("zero").alias("zero_b"), F.col("own").alias("own_b"))
    sources = one.join(two, "lang").filter("a < b")
    levels = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("many"))
    alone = levels.join(two.withColumnRenamed("b", "item"), "lang").filter("source <> item")
    alone = alone.withColumn("value", F.col("many") * _difference("p", "zero_b"))
    alone = alone.select("lang", F.least("source", "item").alias("a"), F.greatest("source", "item").alias("b"), "value")
    left = shares.join(groups.select("lang", "source", "zero"), ["lang", "source"])
    right = left.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("p_b"), F.col("zero").alias("zero_b"))
    left = left.select("lang", "term", F.col("source").alias("a"), "p", "zero")
    both = left.hint("merge").join(right, ["lang", "term"]).filter("a < b")
    both = both.select(
        "lang", "a", "b", F.lit(1).cast("long").alias("both"),
        (_difference("p", "p_b") - _difference("p", "zero_b") - _difference("zero", "p_b")).alias("value"),
    )
    parts = alone.withColumn("both", F.lit(0).cast("long")).unionByName(both)
    sums = parts.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"), F.sum("both").alias("both"))
    full = sources.join(sums, ["lang", "a", "b"], "left")
    shared, summed = F.coalesce("both", F.lit(0)), F.coalesce("value", F.lit(0).cast("long"))
    neither = F.col("terms") - F.col("own_a") - F.col("own_b") + shared
    value = F.when(F.col("terms") > 0, summed + neither * _difference("zero_a", "zero_b")).otherwise(F.lit(0).cast("long"))
    turned = F.array(*[F.struct(F.col(x).alias("source"), F.col(y).alias("item")) for x, y in (("a", "b"), ("b", "a"))])
    full = full.select("lang", F.inline(turned), F.lit("pair").alias("part"), value.alias("value"))
    return full.select("lang", "source", "part", "item", "value")


ORACLE_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d
), kept AS (
  SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10
), g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (
  SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), p AS (
  SELECT lang, source, term, n,
    1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p
  FROM cells JOIN v USING (lang)
), l AS (
  SELECT lang, term, 1 + (1000000000 * (n + 2)::HUGEINT) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q
  FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY lang, term) JOIN v USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS a, y.source AS b, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value
    FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
), terms AS (
  SELECT p.lang, p.source, 'term' AS part, p.term AS item, ((p - q) * (p - q)) // (p + q) AS value
  FROM p JOIN l ON p.lang = l.lang AND p.term = l.term WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 10
"""
