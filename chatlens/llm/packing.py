"""Operator 10: token sequences of bounded length, packed by bounded-space online best-fit.

Documents are cut into pieces of at most ``limit`` tokens. Pieces are dealt to tasks by hash, and
each task packs its pieces as they come: a piece goes to the open sequence with the least free
space that still holds it. Open sequences are known by their free space, one bit each in a bitset, so
the best fit is the lowest set bit from the piece's length on. Their number is fixed; where one more is
needed, the fullest closes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatlens.llm.common import slices, table

LIMIT = 4096
END = 1
OPEN = 1024
VOCABULARY = "word_bpe_49k.json"
# Tokens that one task packs.
SHARE = 1 << 26
# Words remembered by a task.
CACHE = 400_000

# The contractions and classes of the vocabulary's own pre-tokenizer; a text with
# characters outside these ranges is given to the tokenizer whole.
_PLAIN = r"[^\x00-\x{24f}\x{2010}-\x{2027}]|\x{130}|<\|"
_SPACES = r"\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_BREAK = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^" + _SPACES + r"\p{L}\p{N}]+)"


def _byte_letters() -> dict:
    """How a byte-level vocabulary writes bytes: printable ones as themselves, others from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): chr(b if b in shown else 256 + hidden.index(b)) for b in range(256)}


def encoder(path: str):
    """A function from a list of texts to their token ids: (flat ids, bounds).

    Each distinct word of the texts is encoded once.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    model, letters = tokenizer.model, str.maketrans(_byte_letters())
    known: dict[str, list[int]] = {}

    def word_ids(word: str) -> list[int]:
        found = known.get(word)
        if found is None:
            if len(known) >= CACHE:
                known.clear()
            found = [token.id for token in model.tokenize(word.encode().decode("latin-1").translate(letters))]
            known[word] = found
        return found

    def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        column = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(column, _PLAIN).to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(odd), "", column)
        # An ASCII blank wherever words end; the other kinds of blanks separate words too.
        parts = pc.replace_substring_regex(pc.utf8_lower(plain), "[" + _SPACES + "]", " ") if odd.any() or not pc.all(
            pc.string_is_ascii(plain)).as_py() else pc.utf8_lower(plain)
        parts = pc.ascii_split_whitespace(pc.replace_substring_regex(parts, _BREAK, r" \1 "))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        coded = parts.values.slice(bounds[0], bounds[-1] - bounds[0]).dictionary_encode()
        bounds = bounds - bounds[0]
        each = [word_ids(word) for word in coded.dictionary.to_pylist()]
        length = np.array([len(ids) for ids in each], np.int64)
        flat = np.fromiter(chain.from_iterable(each), np.uint32, int(length.sum()))
        begin = np.concatenate([[0], np.cumsum(length)])[:-1] if len(each) else length
        word = coded.indices.to_numpy().astype(np.int64)
        size = length[word]
        ends = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(begin[word] - ends[:-1], size) + np.arange(ends[-1])
        ids, cuts = flat[at], ends[bounds]
        if not odd.any():
            return ids, cuts
        whole = [
            np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32) if out else ids[low:high]
            for text, out, low, high in zip(texts, odd, cuts[:-1], cuts[1:], strict=True)
        ]
        return np.concatenate(whole), np.concatenate([[0], np.cumsum([len(x) for x in whole])])

    return encode


def pieces(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, piece (from 0), start, length, ids_crc32 and, if asked for, ids.

    A null text is empty, which leaves the closing id. ``vocabulary`` is a file of the public
    tokenizers, or a path every executor can open.
    """

    def cut(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers

        encode = encoder(vocabulary if os.path.sep in vocabulary else public_tokenizers.path(vocabulary))
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            owners = batch.column("doc_id")
            for low, high in slices(texts):
                ids, bounds = encode(texts[low:high])
                rows = defaultdict(list)
                row_of = []
                for at in range(high - low):
                    own = np.append(ids[bounds[at] : bounds[at + 1]], np.uint32(end)).astype("<u4")
                    for number, start in enumerate(range(0, len(own), limit)):
                        part = own[start : start + limit]
                        row_of.append(low + at)
                        rows["piece"].append(number)
                        rows["start"].append(start)
                        rows["length"].append(len(part))
                        rows["ids_crc32"].append(zlib.crc32(part.tobytes()))
                        if with_ids:
                            rows["ids"].append(part.astype(np.int32))
                columns = [owners.take(pa.array(row_of)), pa.array(rows["piece"], pa.int32())]
                columns += [pa.array(rows[name], pa.int64()) for name in ("start", "length", "ids_crc32")]
                if with_ids:
                    columns.append(pa.array(rows["ids"], pa.list_(pa.int32())))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class OpenSequences:
    """A fixed number of open sequences, found by free space."""

    def __init__(self, limit: int, number: int):
        self.limit, self.number = limit, number
        self.bits = 0
        self.by_free: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        own = self.by_free[free]
        sequence = own.pop()
        if not own:
            self.bits ^= 1 << free
        self.open -= 1
        return sequence

    def put(self, length: int) -> tuple[int, int]:
        """The sequence for a piece, and its place there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.limit, self.made
            self.made += 1
        left = free - length
        if left:
            if self.open == self.number:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(sequence)
            self.bits |= 1 << left
            self.open += 1
        return sequence, self.limit - free


def packed(parts: DataFrame, limit: int = LIMIT, number: int = OPEN, share: int = SHARE) -> DataFrame:
    """Adds sequence_id and offset to pieces; ``number`` sequences are open at a time in a task."""
    total = parts.agg(F.sum("length")).first()[0] or 0
    tasks = max(1, -(-total // share))

    def pack(batches):
        task = TaskContext.get().partitionId() << 40
        sequences = OpenSequences(limit, number)
        for batch in batches:
            places = [sequences.put(length) for length in batch.column("length").to_pylist()]
            batch = batch.append_column("sequence_id", pa.array([task + s for s, _ in places], pa.int64()))
            yield batch.append_column("offset", pa.array([o for _, o in places], pa.int64()))

    key = F.xxhash64("doc_id", "piece")
    dealt = parts.repartition(tasks, key).sortWithinPartitions(key, "doc_id", "piece", "length", "ids_crc32")
    schema = ", ".join(f"{name} {kind}" for name, kind in parts.dtypes)
    return dealt.mapInArrow(pack, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT, end: int = END, number: int = OPEN, with_ids: bool = False
) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): where it lies in its document and in its sequence.

    Every row gives pieces, also with a null doc_id or a repeated one. Rows of the result with equal
    sequence_id, in the order of offset, make one sequence. An empty table gives no rows.
    """
    return packed(table(pieces(docs, vocabulary, limit, end, with_ids), "pieces"), limit, number)


def sequences(packing: DataFrame) -> DataFrame:
    """(sequence_id, ids): the token sequences of a packing made with ids; none is longer than its limit."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packing.groupBy("sequence_id").agg(F.flatten(F.transform(inside, lambda x: x["ids"])).alias("ids"))
