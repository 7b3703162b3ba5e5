"""Token ids of a corpus in grammar-compressed shards, in ascending order of document ids.

Spark sorts the documents by ranges of ids; each task encodes its documents and writes shards of bounded size,
each with a Re-Pair grammar of its own. A table of shards (Parquet, one binary value per shard) is the file
format on any store that Spark can write to.
"""

from __future__ import annotations

import gc
import itertools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import fixed, per_process, task_number, text_or_empty
from quire.llm.grammar import Shard, gather, pack

SHARD_IDS = 1_000_000
SLICE_ROWS = 4096  # documents encoded at a time
CACHE_WORDS = 1_200_000  # distinct words a worker remembers
_SHARDS = "part int, number int, start_in_part long, n_ids long, doc_ids array<long>, shard binary"
_DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class _Table:
    """Id sequences one after the other, by number."""

    def __init__(self):
        self.flat = np.empty(1 << 20, np.int32)
        self.used = 0
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)

    def add(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.r_[self.flat, np.empty(len(self.flat), np.int32)]
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts = np.r_[self.starts, self.used + np.cumsum(lengths) - lengths]
        self.lengths = np.r_[self.lengths, lengths]
        self.used += len(ids)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.starts, self.lengths, numbers)


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write each byte: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


_ALNUM = np.array([chr(b).isascii() and chr(b).isalnum() for b in range(256)])
_PUNCTUATION = np.array([0x21 <= b < 0x7F and not _ALNUM[b] for b in range(256)])
_LONGEST_TAIL = 16


def _strings(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The ranges of UTF-8 bytes as an array of texts."""
    offsets = np.r_[0, np.cumsum(lengths)].astype(np.int32)
    held = gather(data, starts, lengths, np.arange(len(lengths)))
    return pa.StringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(held))


class _Encoder:
    """Encodes texts with a byte-level tokenizer, each distinct blank-separated word once.

    Such a tokenizer starts a new pre-token at a single blank between two characters that are no white space,
    so the words between such blanks are encoded alone, blank included; the punctuation that ends a word after an ASCII
    letter or digit, its tail, is a pre-token of its own, and a word of letters is one, which goes to the tokenizer's
    model as it is. Texts with other white space next to a blank are encoded whole. These rules are tried out on the
    tokenizer first; marks that its added tokens hold are in no tail.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side already
        self.tokenizer = Tokenizer.from_str(source)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.split = all(
            self._ids(a + " " + b) == self._ids(a) + self._ids(" " + b)
            for a, b in (("ab", "cd"), ("a.", "1b"), ("7", ".x"), ("é\nz", "ß"), ("it's", "'s"), ("a<|b", "|>c"))
        )
        self.tail_marks = _PUNCTUATION.copy()
        for token in self.tokenizer.get_added_tokens_decoder().values():
            self.tail_marks[list(token.content.encode())] = False
        marks = [chr(b) for b in np.flatnonzero(self.tail_marks)]
        tails = [*marks, *(m * 3 for m in marks), *(m + n for m, n in zip(marks, marks[1:], strict=False))]
        if not all(self._ids(w + t) == self._ids(w) + self._ids(t) for w in (" ab", " a.7", " Z") for t in tails):
            self.tail_marks[:] = False
        self.direct = self.tokenizer.normalizer is None and all(
            self._letters_only(w) == self._ids(" " + w) for w in ("the", "Blend", "été", "жук", "ßtz", "日本")
        )
        self._reset()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _letters_only(self, word: str) -> list[int]:
        written = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return [token.id for token in self.model.tokenize("\u0120" + written)]

    def _reset(self) -> None:
        """Forget all words; entry 0 of the table is the empty one."""
        self.words: dict[str, int] = {}
        self.tails: dict[str, int] = {"": 0}
        self.table = _Table()
        self.table.add(np.empty(0, np.int32), np.zeros(1, np.int64))
        self.alone = np.zeros(1, bool)  # whether a word may be encoded without its neighbours

    def _learn(self, entries: dict[str, int], texts: list[str], found: list[list[int]], alone: list[bool]) -> None:
        first = len(self.table.lengths)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        self.table.add(np.fromiter(itertools.chain.from_iterable(found), np.int32, int(lengths.sum())), lengths)
        self.alone = np.r_[self.alone, np.array(alone, bool)]
        entries.update(zip(texts, range(first, first + len(texts)), strict=True))

    def _learn_words(self, words: list[str]) -> None:
        """Encode those of the words that are new, each behind a blank."""
        new = [w for w in words if w not in self.words]
        found = [self._letters_only(w) if self.direct and w.isalpha() else None for w in new]
        others = [i for i, ids in enumerate(found) if ids is None]
        encoded = self.tokenizer.encode_batch([" " + new[i] for i in others], add_special_tokens=False)
        for i, one in zip(others, encoded, strict=True):
            found[i] = one.ids
        self._learn(self.words, new, found, [bool(w) and not w[0].isspace() and not w[-1].isspace() for w in new])

    def _entries(self, words: pa.Array) -> np.ndarray:
        """The two entries of each word in the table: the word without its tail, and the tail."""
        _, offsets, data = words.cast(pa.string()).buffers()
        offsets = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
        starts, lengths = offsets[:-1], np.diff(offsets)
        marks = np.zeros(len(words), np.int64)
        some = np.flatnonzero(lengths > 1)
        for n in range(_LONGEST_TAIL):
            some = some[lengths[some] > n + 1]  # a word is no tail alone
            some = some[self.tail_marks[data[starts[some] + lengths[some] - n - 1]]]
            marks[some] = n + 1
        after = np.flatnonzero(marks)
        marks[after] *= _ALNUM[data[starts[after] + lengths[after] - marks[after] - 1]]
        pairs = np.empty((len(words), 2), np.int64)
        tails = _strings(data, starts + lengths - marks, marks).dictionary_encode()
        texts = tails.dictionary.to_pylist()
        new = [t for t in texts if t not in self.tails]
        self._learn(self.tails, new, [self._ids(t) for t in new], [True] * len(new))
        cores = _strings(data, starts, lengths - marks).dictionary_encode()
        names = cores.dictionary.to_pylist()
        self._learn_words(names)
        for i, (coded, known, of) in enumerate(((cores, self.words, names), (tails, self.tails, texts))):
            numbers = np.fromiter(map(known.__getitem__, of), np.int64, len(of))
            pairs[:, i] = numbers[coded.indices.to_numpy(zero_copy_only=False)]
        return pairs

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if len(texts) == 0:
            return []
        if len(self.words) > CACHE_WORDS:
            self._reset()
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()  # every text has a first word, if an empty one
        pairs = self._entries(coded.dictionary)[coded.indices.to_numpy(zero_copy_only=False)]
        bounds = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]
        firsts = coded.dictionary.take(coded.indices.take(pa.array(bounds[:-1]))).to_pylist()
        heads = self.tokenizer.encode_batch(firsts, add_special_tokens=False)
        joined = ~self.alone[pairs[:, 0]]
        # a first word has no blank before it
        joined[bounds[:-1]] = False
        pairs[bounds[:-1]] = 0
        whole = np.add.reduceat(joined, bounds[:-1], dtype=np.int64) > 0
        ids = self.table.of(pairs.ravel())
        ends = np.r_[0, np.cumsum(self.table.lengths[pairs].sum(axis=1))][bounds]
        encoded = []
        for i, (first, head) in enumerate(zip(firsts, heads, strict=True)):
            if first and not first[-1].isspace() and self.split and not whole[i]:
                encoded.append(np.concatenate((np.array(head.ids, np.int32), ids[ends[i] : ends[i + 1]])))
            else:
                encoded.append(np.array(self._ids(texts[i].as_py()), np.int32))
        return encoded


def _encoder(source) -> _Encoder:
    """The encoder of this worker process."""
    return per_process(("encoder", hash(source.value)), lambda: _Encoder(source.value))


def _write(batches: Iterator[pa.RecordBatch], source, end_id: int, shard_ids: int, schema) -> Iterator[pa.RecordBatch]:
    gc.disable()  # the many small lists below hold no cycles
    encoder = _encoder(source)
    first_new = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end_id + 1)
    part, number, before = task_number(), 0, 0
    end = np.array([end_id], np.int32)
    held: list[np.ndarray] = []
    doc_ids: list[int | None] = []
    size = 0

    def finish() -> pa.RecordBatch:
        nonlocal number, before, held, doc_ids, size
        ids = np.concatenate(held)
        blob = pack(ids, np.cumsum([len(x) for x in held]), first_new)
        row = [[part], [number], [before], [len(ids)], [doc_ids], [blob]]
        number, before, held, doc_ids, size = number + 1, before + len(ids), [], [], 0
        return pa.RecordBatch.from_pydict(dict(zip(schema.names, row, strict=True)), schema=schema)

    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(at, SLICE_ROWS)
            for doc_id, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1)), strict=True):
                doc_ids.append(doc_id)
                held.append(np.concatenate((ids, end)))
                size += len(ids) + 1
                if size >= shard_ids:
                    yield finish()
    if held:
        yield finish()
    gc.enable()


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            shard = Shard(row["shard"])
            counts = shard.counts()
            ids = shard.ids().astype("<u4")
            ends = np.cumsum(counts)
            sums = [zlib.crc32(ids[a:b].data) for a, b in zip(ends - counts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(row["start"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(sums, pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def write_token_shards(docs: DataFrame, tokenizer_json: str, end_id: int = 2, shard_ids: int = SHARD_IDS) -> DataFrame:
    """The table of shards of ``docs`` (doc_id, text), written to the shared work folder.

    part, number, start_in_part, n_ids, doc_ids, shard; by part and number the documents come in ascending
    order of id, null ids first, rows with equal ids in an order of their texts. Each document's ids are
    followed by ``end_id``. A null text counts as empty. Other columns are not looked at.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())
    schema = to_arrow_schema(StructType.fromDDL(_SHARDS))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # the last two keys only matter where an id repeats, and spread one that repeats very often
    texts = texts.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    keys = [F.col("doc_id").asc_nulls_first(), F.col("mark"), F.col("row")]
    ordered = texts.repartitionByRange(*keys).sortWithinPartitions(*keys).select("doc_id", "text")
    return fixed(ordered.mapInArrow(lambda b: _write(b, source, end_id, shard_ids, schema), _SHARDS), "token-shards")


def read_token_shards(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the shards alone.

    ``start``: ids of all documents before it. One running sum sees one row per part.
    """
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # one row per shuffle partition
    placed = shards.join(F.broadcast(starts), "part")
    return placed.select("doc_ids", (F.col("first") + F.col("start_in_part")).alias("start"), "shard").mapInArrow(_read, _DOCUMENTS)
