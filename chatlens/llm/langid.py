"""Operator 7: language of a document by Bayesian fusion of evidence.

Text: likelihoods of hashed byte trigrams, whose counts per language come from all labelled rows.
Declared language and address suffix: how often each value goes with each language. Prior: the
host's own share of languages, smoothed by its domain's, smoothed by the corpus's. All tables of
counts are grouped aggregates; their logarithms are added up and normalised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import slices, table

LANGUAGES = ("de", "en", "es", "fr")
OTHER = "other"
BUCKETS = 1 << 14
# Neighbouring trigrams overlap, so their evidence counts as this share of independent ones.
TEMPER = 0.25
# Rows that a host or domain is smoothed with, and the least posterior that is accepted.
SMOOTHING = 10.0
LEAST = 0.5


def _buckets(data: np.ndarray) -> np.ndarray:
    """Bucket of the trigram at each byte but the last two; ASCII letters in lower case."""
    lowered = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    key = lowered[:-2] * np.uint32(0x9E3779B1) + lowered[1:-1] * np.uint32(0x85EBCA77) + lowered[2:] * np.uint32(0xC2B2AE3D)
    key ^= key >> np.uint32(15)
    return (key * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - 14)


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts with a blank around each, and where each begins."""
    data = np.frombuffer(b" " + b"  ".join(texts) + b" ", np.uint8)
    return data, np.concatenate([[0], np.cumsum([len(text) + 2 for text in texts])])


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def trigram_counts(rows: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """Counts (language, bucket) over all rows of (text, declared) whose declared language is listed."""
    place = {name: at for at, name in enumerate(languages)}

    def count(batches):
        total = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            texts, labels = _bytes(batch.column("text")), batch.column("declared").to_pylist()
            for low, high in slices(texts):
                for name in {label for label in labels[low:high] if label in place}:
                    own = [t for t, label in zip(texts[low:high], labels[low:high], strict=True) if label == name]
                    data, _ = _joined(own)
                    total[place[name]] += np.bincount(_buckets(data), minlength=BUCKETS)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["at", "n"])

    parts = rows.select("text", "declared").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    total = np.zeros(len(languages) * BUCKETS)
    # One row for each language and bucket at most.
    for row in parts.collect():
        total[row["at"]] = row["n"]
    return total.reshape(len(languages), BUCKETS)


def text_evidence(rows: DataFrame, counts: np.ndarray) -> DataFrame:
    """``rows`` with the text replaced by tempered log-likelihoods t0, t1, ... (the last one: of text in
    no listed language, all trigrams alike) and lettered, whether it has any letter."""
    smooth = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
    weights = TEMPER * np.log(np.vstack([smooth, np.full(BUCKETS, 1 / BUCKETS)]))
    shared = rows.sparkSession.sparkContext.broadcast(weights)
    names = [name for name in rows.columns if name != "text"]
    scores = [f"t{at}" for at in range(len(weights))]
    kinds = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes if name != "text")
    letter = np.zeros(256, bool)
    letter[65:91] = letter[97:123] = letter[128:] = True

    def score(batches):
        table_of = shared.value
        for batch in batches:
            texts = _bytes(batch.column("text"))
            for low, high in slices(texts):
                data, starts = _joined(texts[low:high])
                bucket = _buckets(data)
                # The two trigrams across a border of texts hold blanks only or belong to both sides alike.
                # Two places without weight follow, so that a last text without bytes has a place too.
                sums = [np.add.reduceat(np.append(row[bucket], (0.0, 0.0)), starts[:-1]) for row in table_of]
                lettered = np.add.reduceat(letter[data].astype(np.int64), starts[:-1]) > 0
                rest = [batch.column(name).slice(low, high - low) for name in names]
                yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, sums), pa.array(lettered)], [*names, *scores, "lettered"])

    schema = ", ".join([kinds, *[f"{name} double" for name in scores], "lettered boolean"])
    return rows.mapInArrow(score, schema)


def _best(values: list[Column], names: list[str]) -> Column:
    top = F.greatest(*values)
    out = F.lit(names[-1])
    for value, name in list(zip(values, names, strict=True))[::-1]:
        out = F.when(value == top, F.lit(name)).otherwise(out)
    return out


def identify(docs: DataFrame, languages=LANGUAGES, least: float = LEAST, more: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text, declared, suffix, host, domain): doc_id, language, text_language,
    posterior and accepted. ``more`` (doc_id, declared, suffix, host, domain, n) goes before the evidence in ``docs``;
    of several rows of a document, each counts n times: likelihoods add up, priors are averaged. It is joined
    when the texts are scored, so no text is shuffled for it.

    Null evidence says nothing. ``other`` stands for a text in no listed language; it, a text without any
    letter (null, empty, signs only), and a posterior below ``least`` are not accepted.
    """
    classes = [*languages, OTHER]
    subtag = F.lower(F.regexp_extract(F.coalesce(F.col("declared").cast("string"), F.lit("")), "^([A-Za-z]{2,3})(?:[-_]|$)", 1))
    declared = F.nullif(subtag, F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), declared.alias("declared"),
        F.col("suffix").cast("string").alias("suffix"), F.col("host").cast("string").alias("host"), F.col("domain").cast("string").alias("domain"),
    )
    scored = text_evidence(rows, trigram_counts(rows, languages))
    texts = [F.col(f"t{at}") for at in range(len(classes))]
    scored = scored.withColumn("text_language", F.when(F.col("lettered"), _best(texts, classes)))
    scored = table(scored.withColumn("scores", F.array(*texts)).drop(*[f"t{at}" for at in range(len(classes))]), "evidence")
    overall = scored.filter("text_language is not null").groupBy("text_language").count().collect()
    scored = scored.withColumns({"_row": F.monotonically_increasing_id(), "n": F.lit(1)})
    if more is not None:
        names = ["declared", "suffix", "host", "domain", "n"]
        found = more.withColumn("declared", declared).select(F.col("doc_id").alias("_doc"), *[F.col(name).alias(f"_{name}") for name in names])
        both = scored.join(found, F.col("doc_id") == F.col("_doc"), "left")
        scored = table(both.withColumns({name: F.coalesce(f"_{name}", name) for name in names}).drop("_doc", *[f"_{name}" for name in names]), "joined")

    def counts(key: str) -> DataFrame:
        """How often each class, by its text, goes with each value of ``key``."""
        each = F.array(*[F.sum((F.col("text_language") == name).cast("double") * F.col("n")) for name in classes])
        seen = scored.filter(F.col(key).isNotNull() & F.col("text_language").isNotNull())
        return seen.groupBy(F.col(key).alias(f"_{key}")).agg(each.alias(f"{key}_n"))

    total = {row["text_language"]: row["count"] for row in overall}
    whole = sum(total.values()) + len(classes)
    share = F.array(*[F.lit((total.get(name, 0) + 1) / whole) for name in classes])
    none = F.array(*[F.lit(0.0) for _ in classes])
    joined = scored
    for key in ("declared", "suffix"):
        # P(value | class) up to a factor of the value, smoothed by one row spread as the classes are.
        n = F.aggregate(f"{key}_n", F.lit(0.0), lambda a, b: a + b)
        found = counts(key).withColumn("_all", n)
        likelihood = F.zip_with(f"{key}_n", share, lambda c, p: F.log((c + p) / (F.col("_all") + 1) / p))
        found = found.select(f"_{key}", likelihood.alias(f"{key}_n"))
        joined = joined.join(found, F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")
    for key in ("domain", "host"):
        joined = joined.join(counts(key), F.col(key) == F.col(f"_{key}"), "left").drop(f"_{key}")

    def smoothed(seen: Column, wider: Column) -> Column:
        seen = F.coalesce(seen, none)
        n = F.aggregate(seen, F.lit(0.0), lambda a, b: a + b)
        return F.zip_with(F.zip_with(seen, wider, lambda c, p: c + SMOOTHING * p), F.transform(wider, lambda _: n), lambda c, m: c / (m + SMOOTHING))

    prior = smoothed(F.col("host_n"), smoothed(F.col("domain_n"), share))
    likelihood = F.zip_with(F.coalesce("declared_n", none), F.coalesce("suffix_n", none), lambda a, b: a + b)
    names = ["doc_id", "text_language", "lettered", "scores"]
    weighed = joined.select("_row", "n", *names, prior.alias("prior"), likelihood.alias("likelihood"))
    if more is not None:
        def added(name: str) -> list[Column]:
            return [F.sum(F.get(name, F.lit(at)) * F.col("n")) for at in range(len(classes))]

        priors = F.array(*[value / F.sum("n") for value in added("prior")])
        first = [F.first(name).alias(name) for name in names]
        weighed = weighed.groupBy("_row").agg(*first, priors.alias("prior"), F.array(*added("likelihood")).alias("likelihood"))
    fused = F.zip_with(F.transform("prior", lambda p: F.log(p)), "likelihood", lambda a, b: a + b)
    fused = F.zip_with(fused, F.coalesce(F.when(F.col("lettered"), F.col("scores")), none), lambda a, b: a + b)
    fused = weighed.select("doc_id", "text_language", "lettered", fused.alias("fused"))
    top = F.array_max("fused")
    posterior = 1 / F.aggregate("fused", F.lit(0.0), lambda a, b: a + F.exp(b - top))
    language = F.get(F.array(*[F.lit(name) for name in classes]), F.call_function("array_position", F.col("fused"), top).cast("int") - 1)
    named = fused.select("doc_id", language.alias("language"), "text_language", F.round(posterior, 6).alias("posterior"), "lettered")
    accepted = F.col("lettered") & (F.col("language") != OTHER) & (F.col("posterior") >= least)
    return named.select("doc_id", "language", "text_language", "posterior", accepted.alias("accepted"))


def documents_evidence(docs: DataFrame) -> DataFrame:
    """The evidence that `documents` itself has: the declared language, and the source as host."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"),
                       F.col("source").alias("host"), F.lit(None).cast("string").alias("domain"))


def pages_evidence(pages: DataFrame) -> DataFrame:
    """The evidence of the pages that show a document, which they name by the number in their address: doc_id, declared,
    suffix, host, domain and n, the number of its pages with this host and declared language."""
    host = F.regexp_extract(F.col("url"), "://([^/?#:]*)", 1)
    tag = F.regexp_extract("html", r"(?i)<html(\s[^>]*)", 1)
    found = pages.select(
        F.nullif(F.regexp_extract("url", r"/(\d{1,18})(?:[/.?#]|$)", 1), F.lit("")).cast("long").alias("doc_id"),
        F.nullif(host, F.lit("")).alias("host"),
        F.nullif(F.regexp_extract(tag, r"""(?i)\slang\s*=\s*["']?([a-z]{2,3})""", 1), F.lit("")).alias("declared"),
    ).filter("doc_id is not null").groupBy("doc_id", "host", "declared").agg(F.count(F.lit(1)).alias("n"))
    return found.select("doc_id", "declared", F.substring_index("host", ".", -1).alias("suffix"), "host",
                        F.substring_index("host", ".", -2).alias("domain"), "n")


def keep_identified(docs: DataFrame, languages=LANGUAGES, least: float = LEAST, more: DataFrame | None = None) -> DataFrame:
    """``docs`` whose language is accepted, with the evidence ``more`` of ``identify``; columns stay. Rows without
    doc_id go where no such row is accepted."""
    good = identify(documents_evidence(docs), languages, least, more).filter("accepted").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("_doc")), "left_semi")
