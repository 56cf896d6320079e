"""Operator 3: documents scored by masked pseudo-likelihood.

A small network sees two words on each side of a masked word and predicts it; the sum of the
log-probabilities of all words of a document is its score. A word is predicted in two steps: the
network predicts its class, corpus counts give the word within its class. Counts belong to the full
64-bit hash of a word and lie in a table.

Classes follow the company that words keep. The most frequent words have classes of their own and are
clustered by the words around them; every other word joins the cluster that its neighbours speak for,
and shares a class with words of its cluster and of like count. Classes of a cluster follow each
other, so the first step of the network is near to a choice of cluster. The number of classes grows
with the square root of the number of distinct words. Counts, clusters and network come from all
documents, and every word of them is a target of the training once a round: every task trains on its
documents, starting from the same parameters, and the results are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatlens.llm.common import Scratch, hash_words, slices, table

# Classes of a small corpus; larger ones have the square root of their distinct words.
CLASSES = 128
HIDDEN = 16
SIDE = 2
# The words of a stretch are trained in so many strides.
MASKED = 8
ROUNDS = 1
RATE = 0.08
# Words of a step of training: few at first, then more.
FIRST_BATCH, BATCH = 512, 8192
# Bytes of text hashed at a time, and words that share one dictionary and one row.
STRETCH = 1 << 20
DICTIONARY = 1 << 20
# Words whose neighbours are looked at together, and so many of their occurrences at a time.
FEW, SPOTS = 8192, 1 << 16
# Columns that own words are dealt to where neighbours are counted.
BUCKETS = 128
# Rounds of k-means, and of votes within a dictionary.
MEANS = 20
VOTES = 2
# Bounds of a class of counts: so many for each doubling.
STEPS = 8
# Values in one row of a sum over tasks.
BLOCK = 1 << 16


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """What is written inside hands Python one row at a time: rows of ``encoded`` have some 10 MB, and a batch
    otherwise holds all rows of a task, in the executor and in Python."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _bytes(column: pa.Array) -> list[bytes]:
    return [b"" if text is None else text for text in column.cast(pa.binary()).to_pylist()]


def _planes(values: np.ndarray) -> bytes:
    """The bytes of 32-bit values, first all lowest ones; the highest are mostly zero and compress well."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _unplaned(data: pa.Buffer) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encoded(docs: DataFrame) -> DataFrame:
    """Rows of consecutive documents: part, doc_ids, counts (words of each), local (places of all words
    in the row's dictionary), words (the dictionary) and n (how often each occurs)."""

    def encode(batches):
        held, size, number = [], 0, 0

        def row():
            part = (TaskContext.get().partitionId() << 32) + number
            found = pa.array(np.concatenate([hashes for _, _, hashes in held]).view(np.int64)).dictionary_encode()
            local = found.indices.to_numpy()
            words, n = found.dictionary.to_numpy(), np.bincount(local, minlength=len(found.dictionary)).astype(np.int64)
            ids = [doc for some, _, _ in held for doc in some]
            counts = np.concatenate([some for _, some, _ in held])
            cells = [[part], [ids], [counts], [_planes(local)], [words.tobytes()], [n.tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(cells, encode.schema, strict=True)], schema=encode.schema)

        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                few = batch.slice(begin, 256)
                texts = _bytes(few.column("text"))
                for low, high in slices(texts, STRETCH):
                    hashes, counts = hash_words(texts[low:high])
                    held.append((few.column("doc_id").slice(low, high - low).to_pylist(), counts, hashes))
                    size += len(hashes)
                    if size >= DICTIONARY:
                        yield row()
                        held, size, number = [], 0, number + 1
                        pa.default_memory_pool().release_unused()
        if held:
            yield row()

    long = pa.list_(pa.int64())
    kinds = {"part": pa.int64(), "doc_ids": long, "counts": long, "local": pa.binary(), "words": pa.binary(), "n": pa.binary()}
    encode.schema = pa.schema(kinds.items())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(encode, "part long, doc_ids array<long>, counts array<long>, local binary, words binary, n binary")


def word_totals(rows: DataFrame) -> DataFrame:
    """word and total, its count in all texts, from the rows of ``encoded``."""

    def flat(batches):
        for batch in batches:
            for words, n in zip(*batch.columns, strict=True):
                words, n = np.frombuffer(words.as_buffer(), np.int64), np.frombuffer(n.as_buffer(), np.int64)
                for low in range(0, len(words), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(words[low : low + 100_000]), pa.array(n[low : low + 100_000])], ["word", "n"])

    return rows.select("words", "n").mapInArrow(flat, "word long, n long").groupBy("word").agg(F.sum("n").alias("total"))


def _blocks(values: np.ndarray):
    for at, low in enumerate(range(0, len(values), BLOCK)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([at], pa.int32()), pa.array([values[low : low + BLOCK].astype("<f8").tobytes()], pa.binary())], ["at", "block"]
        )


def summed(blocks: DataFrame, size: int) -> np.ndarray:
    """The sum of the vectors that tasks give in rows of ``_blocks``, added up in two steps."""

    def add(batches):
        held = {}
        for batch in batches:
            for at, block in zip(batch.column("at").to_pylist(), batch.column("block"), strict=True):
                values = np.frombuffer(block.as_buffer(), "<f8")
                held[at] = held[at] + values if at in held else values
        for at, values in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["at", "block"])

    kind = "at int, block binary"
    first = blocks.withColumn("salt", F.spark_partition_id() % 32).repartition("at", "salt").select("at", "block").mapInArrow(add, kind)
    found = first.repartition("at").mapInArrow(add, kind).toArrow()
    total = np.zeros(size)
    for at, block in zip(found.column("at").to_pylist(), found.column("block").to_pylist(), strict=True):
        total[at * BLOCK : at * BLOCK + len(block) // 8] = np.frombuffer(block, "<f8")
    return total


class Own:
    """The words with classes of their own, most frequent first, and how many classes there are."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, number: int):
        self.counts, self.number = counts, number
        self.order = np.argsort(words)
        self.sorted = words[self.order]

    def find(self, words: np.ndarray) -> np.ndarray:
        """The place of each word among the own ones, or -1."""
        if not len(self.sorted):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.sorted, words), len(self.sorted) - 1)
        return np.where(self.sorted[at] == words, self.order[at], -1)


def own_words(words: DataFrame) -> Own:
    """The most frequent words of ``word_totals``: three quarters of the classes."""
    distinct = words.count()
    number = max(CLASSES, int(np.ceil(np.sqrt(distinct))))
    top = words.orderBy(F.desc("total"), "word").limit(number * 3 // 4).collect()
    return Own(np.array([x["word"] for x in top], np.int64), np.array([x["total"] for x in top], np.int64), number)


def _sequence(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a row's dictionary, places of its words there, and these in a sequence with edges, and where."""
    words, local = np.frombuffer(row["words"], np.int64), _unplaned(row["local"]).astype(np.int64)
    return words, local, *_contexts(local, np.asarray(row["counts"]), len(words))


def neighbours(rows: DataFrame, own: Own) -> np.ndarray:
    """Per own word, how often words of each bucket of own words stand in its window."""
    shared, size = rows.sparkSession.sparkContext.broadcast(own), len(own.counts) * BUCKETS

    def count(batches):
        known, total = shared.value, np.zeros(size)
        for batch in batches:
            for at in range(batch.num_rows):
                words, _, padded, place = _sequence({name: batch.column(name)[at].as_py() if name == "counts" else batch.column(name)[at].as_buffer()
                                                     for name in batch.schema.names})
                mine = np.append(known.find(words), -1)[padded]
                place = place[mine[place] >= 0]
                for shift in _SHIFTS:
                    other = mine[place + shift]
                    met = other >= 0
                    total += np.bincount(mine[place[met]] * BUCKETS + other[met] % BUCKETS, minlength=size)
        yield from _blocks(total)

    found = rows.select("counts", "local", "words").mapInArrow(count, "at int, block binary")
    return summed(found, size).reshape(-1, BUCKETS)


def clusters(seen: np.ndarray, number: int) -> np.ndarray:
    """k-means of the rows of ``seen`` by the roots of their shares; far rows with many counts start clusters."""
    weight = seen.sum(axis=1)
    points = np.sqrt(seen / np.maximum(weight, 1)[:, None])
    weight = np.sqrt(weight) + 1e-9
    chosen = [int(weight.argmax())] if len(points) else []
    far = np.full(len(points), np.inf)
    while chosen and len(chosen) < min(number, len(points)):
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        chosen.append(int((far * weight).argmax()))
    centres, kind = points[chosen], np.zeros(len(points), np.int64)
    for _ in range(MEANS if chosen else 0):
        kind = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        for at in range(len(centres)):
            mine = kind == at
            if mine.any():
                centres[at] = (points[mine] * weight[mine, None]).sum(axis=0) / weight[mine].sum()
    return kind


def evidence(seen: np.ndarray, kind: np.ndarray, number: int) -> np.ndarray:
    """Per bucket and cluster, the log of how much likelier the bucket is near a word of the cluster; a last row of zeros."""
    counts = np.zeros((number, BUCKETS))
    np.add.at(counts, kind, seen)
    base = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
    shares = (counts + 5 * base) / (counts.sum(axis=1, keepdims=True) + 5)
    return np.vstack([np.log(shares / base).T, np.zeros(number)]).astype(np.float32)


def _said(order: np.ndarray, starts: np.ndarray, labels: np.ndarray, place: np.ndarray, speaks: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Words of a dictionary, a few at a time, and the rows of ``speaks`` at the ``labels`` around all their occurrences,
    added up. A frequent word has many occurrences, so these are counted in stretches."""
    wide = len(speaks)
    for low in range(0, len(starts) - 1, FEW):
        high = min(low + FEW, len(starts) - 1)
        counts = np.zeros((high - low) * wide, np.int64)
        for begin in range(starts[low], starts[high], SPOTS):
            some = slice(begin, min(begin + SPOTS, starts[high]))
            first = np.searchsorted(starts, begin, side="right") - 1
            last = np.searchsorted(starts, some.stop, side="left")
            held = np.minimum(starts[first + 1 : last + 1], some.stop) - np.maximum(starts[first:last], begin)
            cells, spots = np.repeat(np.arange(last - first) * wide, held), place[order[some]]
            cells = np.concatenate([cells + labels[spots + shift] for shift in _SHIFTS])
            counts[(first - low) * wide : (last - low) * wide] += np.bincount(cells, minlength=(last - first) * wide)
        yield slice(low, high), counts.reshape(-1, wide).astype(np.float32) @ speaks


def votes(local: np.ndarray, padded: np.ndarray, place: np.ndarray, own: np.ndarray, kind: np.ndarray, speaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cluster of each word of a dictionary, and by how much it leads; a last cluster has the words that none speaks for.

    First the own words around a word speak, by ``speaks``; then all words around it by their clusters, as
    far as clusters differ in the company they keep.
    """
    number, mine = speaks.shape[1], np.flatnonzero(own >= 0)
    order = np.argsort(local)
    starts = np.concatenate([[0], np.cumsum(np.bincount(local, minlength=len(own)))])
    labels = np.append(np.where(own >= 0, own % BUCKETS, BUCKETS), BUCKETS)
    for last in range(VOTES):
        best, lead = np.empty(len(own), np.int64), np.ones(len(own), np.float32)
        around = labels[padded]
        for some, scores in _said(order, starts, around, place, speaks):
            best[some] = scores.argmax(axis=1)
            if number > 1:
                scores.partition(number - 2, axis=1)
                lead[some] = scores[:, -1] - scores[:, -2]
        best[lead <= 0] = number
        if last < VOTES - 1:
            best[mine] = kind[own[mine]]
            labels = np.append(best, number)
            met = labels[padded]
            near = np.bincount(met[:-1] * (number + 1) + met[1:], minlength=(number + 1) ** 2).reshape(number + 1, -1)[:number, :number]
            near = near + near.T + 0.1
            speaks = np.log(near * near.sum() / (near.sum(axis=0) * near.sum(axis=1)[:, None]))
            speaks = np.vstack([speaks, np.zeros(number)]).astype(np.float32)
    return best, lead


def voted(rows: DataFrame, own: Own, kind: np.ndarray, speaks: np.ndarray) -> DataFrame:
    """Per word of a dictionary: part, at, word, n, and its own place (else -1), cluster and lead."""
    shared = rows.sparkSession.sparkContext.broadcast((own, kind, speaks))

    def vote(batches):
        known, cluster_of, heard = shared.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = {name: batch.column(name)[at].as_py() if name in ("part", "counts") else batch.column(name)[at].as_buffer()
                       for name in batch.schema.names}
                words, local, padded, place = _sequence(row)
                mine = known.find(words)
                best, lead = votes(local, padded, place, mine, cluster_of, heard)
                n = np.frombuffer(row["n"], np.int64)
                for low in range(0, len(words), 100_000):
                    some = np.arange(low, min(low + 100_000, len(words)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(some), row["part"])), pa.array(some.astype(np.int32)), pa.array(words[some]), pa.array(n[some]),
                         pa.array(mine[some].astype(np.int32)), pa.array(best[some].astype(np.int32)), pa.array(lead[some].astype(np.float32))],
                        ["part", "at", "word", "n", "own", "cluster", "lead"],
                    )

    kinds = "part long, at int, word long, n long, own int, cluster int, lead float"
    return rows.select("part", "counts", "local", "words", "n").mapInArrow(vote, kinds)


def settled(found: DataFrame) -> DataFrame:
    """Per word of a dictionary: part, at, own, n, and for words without a class of their own the total and
    the cluster in all texts, that of the dictionary where it leads most.

    Own words, which nearly all dictionaries hold, are known to every task and not brought together; of
    another word a dictionary has one row among its 100,000 and more.
    """
    one = Window.partitionBy("word", F.when(F.col("own") >= 0, F.col("part")))
    # Lead and cluster in one number: largest lead, then smallest cluster.
    ballot = (F.col("lead") * 1000).cast("long") * (1 << 20) + ((1 << 20) - 1 - F.col("cluster"))
    each = found.select("part", "at", "own", "n", F.sum("n").over(one).alias("total"), F.max(ballot).over(one).alias("ballot"))
    return each.select("part", "at", "own", "n", "total", ((1 << 20) - 1 - F.col("ballot").bitwiseAND((1 << 20) - 1)).cast("int").alias("cluster"))


def _step(totals: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(totals, 1)) * STEPS + 1e-9).astype(np.int64)


class Classes:
    """Classes of words, those of a cluster one after the other: first its own words, then ranges of counts.

    ``cluster``, ``step`` and ``tokens`` say how many words of the texts belong to the other words of a
    cluster whose counts lie in one step.
    """

    def __init__(self, own: Own, kind: np.ndarray, cluster: np.ndarray, step: np.ndarray, tokens: np.ndarray):
        shared = max(own.number - len(own.counts), 1)
        order = np.lexsort((-step, cluster))
        cluster, step, tokens = cluster[order], step[order], tokens[order]
        self.own = np.zeros(len(own.counts), np.int64)
        self.shared = np.zeros((int(max(cluster.max(initial=0), kind.max(initial=0))) + 1, int(step.max(initial=0)) + 1), np.int64)
        self.counts, self.cluster, number, sums = own.counts, [], 0, []
        for at in range(len(self.shared)):
            mine = np.flatnonzero(kind == at)
            self.own[mine] = number + np.arange(len(mine))
            sums += own.counts[mine].tolist()
            number += len(mine)
            held = np.flatnonzero(cluster == at)
            if len(held):
                weight = tokens[held]
                most = max(1, round(shared * weight.sum() / tokens.sum()))
                place = np.minimum(((np.cumsum(weight) - weight / 2) / weight.sum() * most).astype(np.int64), most - 1)
                place = np.unique(place, return_inverse=True)[1]
                self.shared[at, step[held]] = number + place
                sums += np.bincount(place, weights=weight).astype(np.int64).tolist()
                number += int(place.max()) + 1
            self.cluster += [at] * (number - len(self.cluster))
        self.number, self.tokens, self.cluster = max(number, 1), np.array(sums or [0], np.int64), np.array(self.cluster or [0])

    def of(self, own: np.ndarray, cluster: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class of each word, and the logarithm of its share in the class."""
        kind, totals = np.empty(len(own), np.int64), totals.copy()
        mine = own >= 0
        kind[mine], totals[mine] = self.own[own[mine]], self.counts[own[mine]]
        kind[~mine] = self.shared[cluster[~mine], _step(totals[~mine])]
        return kind, np.log(totals / self.tokens[kind])


def corpus_classes(own: Own, kind: np.ndarray, words: DataFrame) -> Classes:
    """Classes from the table of ``settled``; steps of counts are few, however many words there are."""
    # The floor of the logarithm as in ``_step``.
    step = F.floor(F.log2("total") * STEPS + 1e-9)
    found = words.filter("own < 0").groupBy("cluster", step.alias("step")).agg(F.sum("n").alias("tokens")).toArrow()
    return Classes(own, kind, *[found.column(name).to_numpy().astype(np.int64) for name in ("cluster", "step", "tokens")])


def _softmax(scores: np.ndarray) -> np.ndarray:
    # Scores stay far below the bound; it only keeps float32 finite.
    np.minimum(scores, 80, out=scores)
    np.exp(scores, out=scores)
    scores *= 1 / (scores @ np.ones((scores.shape[1], 1), np.float32))
    return scores


class Network:
    """Context classes -> hidden layer -> class, in two steps: a group of classes that follow each
    other, and the class in its group. All parameters lie in one vector."""

    def __init__(self, values: np.ndarray, classes: int = CLASSES):
        self.classes, self.width = classes, int(np.ceil(np.sqrt(classes)))
        groups = -(-classes // self.width)
        self.shapes = [
            (2 * SIDE, classes + 1, HIDDEN), (HIDDEN,), (HIDDEN, groups), (groups,), (groups, HIDDEN, self.width), (groups, self.width),
        ]
        self.values = np.zeros(self.size) if values is None else values
        self.values = self.values.astype(np.float32).copy()
        self.parts = self.split(self.values)

    @property
    def size(self) -> int:
        return sum(int(np.prod(shape)) for shape in self.shapes)

    def split(self, values: np.ndarray) -> list[np.ndarray]:
        parts, at = [], 0
        for shape in self.shapes:
            size = int(np.prod(shape))
            parts.append(values[at : at + size].reshape(shape))
            at += size
        return parts

    @classmethod
    def start(cls, share: np.ndarray, cluster: np.ndarray) -> Network:
        """Small random embeddings, alike within a cluster; the biases give every class its share in the corpus."""
        made = cls(None, len(share))
        random = np.random.default_rng(11)
        for at, spread in ((0, 0.1), (2, 0.1), (4, 0.1)):
            made.parts[at][:] = random.normal(0, spread, made.shapes[at])
        common = random.normal(0, 0.5, (int(cluster.max()) + 1, HIDDEN)).astype(np.float32)
        made.parts[0][:, :-1] += common[cluster]
        grid = np.zeros(made.shapes[5])
        grid.ravel()[: len(share)] = share
        made.parts[3][:] = np.log(grid.sum(axis=1))
        with np.errstate(divide="ignore"):
            # Places behind the last class are never taken.
            made.parts[5][:] = np.maximum(np.log(grid / grid.sum(axis=1, keepdims=True)), -1e4)
        return made

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        places, bias = self.parts[:2]
        hidden = bias + places[0].take(context[:, 0], axis=0)
        for at in range(1, 2 * SIDE):
            hidden += places[at].take(context[:, at], axis=0)
        return np.tanh(hidden, out=hidden)

    def forward(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden layer and the log-probabilities of all classes."""
        hidden = self._hidden(context)
        group = np.log(_softmax(hidden @ self.parts[2] + self.parts[3]))
        inner = np.einsum("nh,ghk->ngk", hidden, self.parts[4]) + self.parts[5]
        inner -= inner.max(axis=2, keepdims=True)
        inner -= np.log(np.exp(inner).sum(axis=2, keepdims=True))
        return hidden, (group[:, :, None] + inner).reshape(len(context), -1)[:, : self.classes]

    def _steps(self, context: np.ndarray, target: np.ndarray) -> tuple:
        """For rows in the order of their target's group: hidden layer, probabilities of groups, those of
        the classes in the target's group, the target's place in both, and the rows of each group."""
        hidden = self._hidden(context)
        group, place = np.divmod(target, self.width)
        outer = _softmax(hidden @ self.parts[2] + self.parts[3])
        inner = self.parts[5].take(group, axis=0)
        bounds = np.searchsorted(group, np.arange(len(self.parts[3]) + 1))
        runs = [(at, slice(bounds[at], bounds[at + 1])) for at in np.flatnonzero(bounds[1:] > bounds[:-1])]
        for at, rows in runs:
            inner[rows] += hidden[rows] @ self.parts[4][at]
        return hidden, outer, _softmax(inner), group, place, runs

    def _by_group(self, target: np.ndarray) -> np.ndarray:
        return np.argsort((target // self.width).astype(np.uint16), kind="stable")

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        order = self._by_group(target)
        _, outer, inner, group, place, _ = self._steps(context[order], target[order])
        found, rows = np.empty(len(target), np.float64), np.arange(len(target))
        tiny = np.finfo(np.float32).tiny
        found[order] = np.log(np.maximum(outer[rows, group], tiny)) + np.log(np.maximum(inner[rows, place], tiny))
        return found

    def train(self, context: np.ndarray, target: np.ndarray, memory: np.ndarray, rate: float) -> None:
        """One step of Adagrad; ``memory`` holds the sums of squared gradients."""
        order = self._by_group(target)
        context = context[order]
        hidden, outer, inner, group, place, runs = self._steps(context, target[order])
        rows = np.arange(len(target))
        outer[rows, group] -= 1
        inner[rows, place] -= 1
        outer /= len(target)
        inner /= len(target)
        back = outer @ self.parts[2].T
        within, within_bias = np.zeros(self.shapes[4], np.float32), np.zeros(self.shapes[5], np.float32)
        ones = np.ones(len(target), np.float32)
        for at, own in runs:
            back[own] += inner[own] @ self.parts[4][at].T
            within[at] = hidden[own].T @ inner[own]
            within_bias[at] = ones[own] @ inner[own]
        back *= 1 - hidden * hidden
        sums = self.split(memory)
        for part, held, slope in zip(self.parts[1:], sums[1:], (ones @ back, hidden.T @ outer, ones @ outer, within, within_bias), strict=True):
            held += slope**2
            part -= rate * slope / np.sqrt(held + 1e-8)
        # Only the classes met have a gradient; the places of the window lie in one table, one after the other.
        wide = self.classes + 1
        met = (context + np.arange(2 * SIDE) * wide).astype(_width(2 * SIDE * wide)).ravel()
        order = np.argsort(met, kind="stable")
        met = met[order]
        first = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        slope = np.add.reduceat(np.ascontiguousarray(back.T).take(order // (2 * SIDE), axis=1), first, axis=1).T
        met = met[first]
        table, held = self.parts[0].reshape(-1, HIDDEN), sums[0].reshape(-1, HIDDEN)
        now = held[met] + slope**2
        held[met] = now
        table[met] -= rate * slope / np.sqrt(now + 1e-8)


def _contexts(kinds: np.ndarray, counts: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """Class sequence with an edge class around every document, and the place of each word in it."""
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(kinds)) + SIDE * (owner + 1)
    padded = np.full(len(kinds) + SIDE * (len(counts) + 1), classes, kinds.dtype)
    padded[place] = kinds
    return padded, place


_SHIFTS = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])


def _width(classes: int) -> np.dtype:
    """Type of a class number; ``classes`` itself is the edge."""
    return np.dtype(np.uint16 if classes < 1 << 16 else np.uint32)


def with_classes(rows: DataFrame, words: DataFrame, classes: Classes) -> DataFrame:
    """``rows`` of ``encoded`` with the classes of their words: doc_ids, counts, inside (per document, the
    sum of the log shares of its words in their classes) and kinds."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(classes))

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        known = Classes.__new__(Classes)
        vars(known).update(shared.value)
        order = np.argsort(right.column("at").to_numpy())
        kind, share = known.of(*[right.column(name).to_numpy()[order] for name in ("own", "cluster", "total")])
        kind = kind.astype(_width(known.number))
        inside, kinds = [], []
        for counts, data in zip(left.column("counts"), left.column("local"), strict=True):
            local = _unplaned(data.as_buffer())
            ends = np.concatenate([[0.0], np.cumsum(share[local])])
            bounds = np.concatenate([[0], np.cumsum(counts.values.to_numpy())])
            inside.append(ends[bounds[1:]] - ends[bounds[:-1]])
            kinds.append(kind[local].tobytes())
        return pa.table({
            "doc_ids": left.column("doc_ids"), "counts": left.column("counts"),
            "inside": pa.array(inside, pa.list_(pa.float64())), "kinds": pa.array(kinds, pa.binary()),
        })

    left = rows.select("part", "doc_ids", "counts", "local").groupBy("part")
    right = words.select("part", "at", "own", "cluster", "total").groupBy("part")
    return left.cogroup(right).applyInArrow(look_up, "doc_ids array<long>, counts array<long>, inside array<double>, kinds binary")


def positions(length: int, masked: int = MASKED) -> np.ndarray:
    """Every position once, in strides."""
    return np.concatenate([np.arange(first, length, masked) for first in range(masked)])


def trained(rows: DataFrame, start: Network, rounds: int = ROUNDS) -> Network:
    """The network after ``rounds`` over all rows (counts, kinds); a round predicts every word once."""
    network, classes = start, start.classes
    for _ in range(rounds):
        now = rows.sparkSession.sparkContext.broadcast(network.values)

        def fit(batches, now=now):
            own, seen = Network(now.value, classes), 0
            memory = np.full(len(now.value), 0.01, np.float32)
            for batch in batches:
                for counts, data in zip(batch.column("counts"), batch.column("kinds"), strict=True):
                    kinds = np.frombuffer(data.as_buffer(), _width(classes))
                    padded, place = _contexts(kinds, counts.values.to_numpy(), classes)
                    chosen, at = positions(len(kinds)), 0
                    while at < len(chosen):
                        part = chosen[at : at + min(BATCH, max(FIRST_BATCH, (seen + at) // 16))]
                        own.train(padded[place[part][:, None] + _SHIFTS], kinds[part], memory, RATE)
                        at += len(part)
                    seen += len(chosen)
            yield from _blocks(np.append(own.values.astype(np.float64) * seen, seen))

        total = summed(rows.select("counts", "kinds").mapInArrow(fit, "at int, block binary"), len(network.values) + 1)
        if total[-1]:
            network = Network(total[:-1] / total[-1], classes)
    return network


def _scored(net: Network, ids: pa.Array, counts: np.ndarray, kinds: np.ndarray, inside: np.ndarray) -> pa.RecordBatch:
    """Scores of documents with ``kinds`` in order; ``inside`` is each one's sum of log shares."""
    padded, place = _contexts(kinds, counts, net.classes)
    each = np.zeros(len(kinds))
    for at in range(0, len(kinds), 16_384):
        part = slice(at, at + 16_384)
        each[part] = net.log_probability(padded[place[part][:, None] + _SHIFTS], kinds[part])
    ends = np.concatenate([[0.0], np.cumsum(each)])
    bounds = np.concatenate([[0], np.cumsum(counts)])
    total = np.round(ends[bounds[1:]] - ends[bounds[:-1]] + inside, 6)
    mean = np.divide(total, counts, out=np.zeros(len(counts)), where=counts > 0)
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(counts), pa.array(total), pa.array(mean, mask=counts == 0)], ["doc_id", "n_tokens", "log_likelihood", "per_token"]
    )


_SCHEMA = "doc_id long, n_tokens long, log_likelihood double, per_token double"


def scored_rows(rows: DataFrame, network: Network) -> DataFrame:
    """Scores of the documents in the rows of ``with_classes``."""
    shared, classes = rows.sparkSession.sparkContext.broadcast(network.values), network.classes

    def score(batches):
        net = Network(shared.value, classes)
        for batch in batches:
            for ids, counts, inside, data in zip(*[batch.column(name) for name in ("doc_ids", "counts", "inside", "kinds")], strict=True):
                kinds = np.frombuffer(data.as_buffer(), _width(classes))
                yield _scored(net, ids.values, counts.values.to_numpy(), kinds, inside.values.to_numpy())

    return rows.mapInArrow(score, _SCHEMA)


def modelled(docs: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Network, Scratch]:
    """The documents with the classes of their words, the network, and the tables to clear in the end."""
    spark = docs.sparkSession
    scratch, large = Scratch(spark), Scratch(spark)
    rows = scratch.table(encoded(docs), "encoded")
    with one_row_batches(spark):
        totals = scratch.table(word_totals(rows), "totals")
    own = own_words(totals)
    number = int(np.ceil(np.sqrt(own.number)))
    with one_row_batches(spark):
        seen = neighbours(rows, own)
        kind = clusters(seen, number)
        words = scratch.table(settled(voted(rows, own, kind, evidence(seen, kind, number))), "words")
    classes = corpus_classes(own, kind, words)
    share = classes.tokens + 0.1
    known = large.table(with_classes(rows, words, classes), "classes")
    scratch.clear()
    with one_row_batches(spark):
        network = trained(known, Network.start(share / share.sum(), classes.cluster), rounds)
    return known, network, large


def pseudo_likelihood(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, log_likelihood and its mean per word, per_token,
    under a model of all documents.

    A text without words has log_likelihood 0 and no mean. Every row is scored, also with a null or repeated doc_id.
    """
    known, network, large = modelled(docs, rounds)
    with one_row_batches(docs.sparkSession):
        found = table(scored_rows(known, network), "scores")
    large.clear()
    return found
