"""Token counts without token ids: pieces per distinct pre-token, joined to each document's frequencies.

Documents are read in blocks of bounded size. A block keeps a dictionary of its pre-tokens and, for every
document, which entries occur how often (the frequencies). Each pre-token of the corpus is cut into pieces
once; the numbers of pieces travel back to the blocks that hold it, and a document's count is the sum of
frequency times pieces. A frequent word thus costs one row per block, never one per document.

A pre-token here is a run without white space, with two reductions that cannot change a count and are tried
out on the tokenizer before they are used: ASCII letters in lower case, and one closing comma or full stop
counted on its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm.common import fixed, per_process, task_number, text_or_empty

BLOCK_CHARS = 40_000_000
MAX_TOKENS = 2048
BLOCK_BITS = 14  # for the number of a block in its task
PLACE_BITS = 26  # for the number of a pre-token in its block, which has no more characters than that

_SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]

_BLOCKS = (
    "block long, doc_ids array<long>, n_bytes array<long>, n_entries array<long>, entries binary, "
    "words array<string>, head binary, tail binary"
)
_COUNTS = "doc_id long, n_bytes long, n_tokens long"


class _Numbers(dict):
    """Numbers words from 0 as they come."""

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


class _Rules:
    """What may be done to a text before the tokenizer sees it, found by asking the tokenizer."""

    def __init__(self, tokenizer: Tokenizer):
        def n(text: str) -> int:
            return len(tokenizer.encode(text, add_special_tokens=False).ids)

        unsafe = [s for s in _SPACES if n(f"ab{s}cd") != n("ab") + n("cd") or n(f"a{s}{s}.") != n("a") + n(".")]
        if set(" \t\n\r") & set(unsafe):
            raise ValueError("this tokenizer's pre-tokens are not separated by white space")
        self.unsafe = re.compile("[" + "".join(map(re.escape, unsafe)) + "]") if unsafe else None
        self.lower = all(n(w) == n(w.lower()) for w in ("THE", "Blend", "XyZzy", "Don'T", "A1B", "ÀÉÖ", "Ñu"))
        self.tails = "".join(t for t in ",." if all(n(w + t) == n(w) + n(t) for w in ("the", "qzx", "a1", "7")))

    def words(self, text: str) -> list[str]:
        if self.unsafe is not None and self.unsafe.search(text):
            return re.split(r"[ \t\n\r]+", text.strip(" \t\n\r"))
        return text.split()

    def parts(self, word: str) -> tuple[str, str | None]:
        """The word reduced, and its closing mark if that counts on its own."""
        if "<" in word or max(word) > "\xff":  # special strings are left alone, and letters with odd lower cases
            return word, None
        tail = None
        if len(word) > 1 and word[-1] in self.tails and word[-2].isascii() and word[-2].isalnum():
            word, tail = word[:-1], word[-1]
        return (word.lower() if self.lower else word), tail


def _tokenizer(source) -> Tokenizer:
    """The tokenizer of this worker process, built from the broadcast file content."""
    return per_process(("tokenizer", hash(source.value)), lambda: Tokenizer.from_str(source.value))


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, lowest bytes of all first: the higher bytes are mostly zeros and take no room."""
    planes = np.ascontiguousarray(values.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<i4").reshape(-1)


def _blocks(batches: Iterator[pa.RecordBatch], source, block_chars: int, schema) -> Iterator[pa.RecordBatch]:
    rules = _Rules(_tokenizer(source))
    numbers, rows, chars, done = _Numbers(), [], 0, 0

    def finish() -> pa.RecordBatch:
        nonlocal numbers, rows, chars, done
        units = _Numbers()
        split = [rules.parts(word) for word in numbers]
        head = np.fromiter((units[h] for h, _ in split), np.int32, len(split))
        tail = np.fromiter((-1 if t is None else units[t] for _, t in split), np.int32, len(split))
        # in order, so that what travels packs well
        words = sorted(units)
        place = np.empty(len(words) + 1, np.int32)
        place[np.fromiter(map(units.__getitem__, words), np.int64, len(words))] = np.arange(len(words))
        place[-1] = -1
        head, tail = place[head], place[tail]
        steps = [np.diff(found, prepend=0) for _, _, found, _ in rows]  # small numbers pack well
        entries = np.concatenate([np.concatenate(steps), np.concatenate([freq for *_, freq in rows])])
        row = {
            "block": [(task_number() << BLOCK_BITS) + done],
            "doc_ids": [[r[0] for r in rows]],
            "n_bytes": [[r[1] for r in rows]],
            "n_entries": [[len(r[2]) for r in rows]],
            "entries": [_pack(entries)],
            "words": [words],
            "head": [_pack(head)],
            "tail": [_pack(tail)],
        }
        numbers, rows, chars, done = _Numbers(), [], 0, done + 1
        return pa.RecordBatch.from_pydict(row, schema=schema)

    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            words = rules.words(text)
            found, freq = np.unique(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)), return_counts=True)
            rows.append((doc_id, len(text.encode()), found, freq))
            chars += len(text)
            if chars >= block_chars:
                yield finish()
    if rows:
        yield finish()


def _pieces(batches: Iterator[pa.RecordBatch], source) -> Iterator[pa.RecordBatch]:
    tokenizer = _tokenizer(source)
    for batch in batches:
        found = tokenizer.encode_batch(batch.column(0).to_pylist(), add_special_tokens=False)
        counts = pa.array([len(e.ids) for e in found], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), counts], names=["word", "pieces"])


def _sums(batches: Iterator[pa.RecordBatch], schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            # place in the dictionary and number of pieces
            found = np.array(row["found"], np.int64)
            pieces = np.zeros(len(found) + 1, np.int64)  # the last entry stands for no tail
            pieces[found >> 32] = found & 0xFFFFFFFF
            per_word = pieces[_unpack(row["head"])] + pieces[_unpack(row["tail"])]
            steps, freq = np.split(_unpack(row["entries"]).astype(np.int64), 2)
            ends = np.cumsum(row["n_entries"])
            starts = np.r_[0, ends[:-1]].astype(np.int64)
            running = np.cumsum(steps)
            before = np.repeat(np.r_[0, running][starts], row["n_entries"])
            total = np.r_[0, np.cumsum(per_word[running - before] * freq)] if len(freq) else np.zeros(1, np.int64)
            n_tokens = total[ends] - total[starts]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(row["n_bytes"], pa.int64()), pa.array(n_tokens)],
                schema=schema,
            )


def count_tokens(
    docs: DataFrame,
    tokenizer_json: str,
    max_tokens: int = MAX_TOKENS,
    text: str = "text",
    id_col: str = "doc_id",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer_json``: path of a tokenizers file on the driver; its content is sent to the executors. The
    tokenizer must separate pre-tokens at white space (checked). A null or empty text has 0 tokens; repeated
    rows and null ids are counted like any others; other columns are not looked at. Memory: one block.
    """
    spark = docs.sparkSession
    with open(tokenizer_json, encoding="utf-8") as file:
        source = spark.sparkContext.broadcast(file.read())
    block_schema, count_schema = _arrow(_BLOCKS), _arrow(_COUNTS)
    texts = docs.select(F.col(id_col).cast("long"), text_or_empty(text))
    blocks = fixed(texts.mapInArrow(lambda b: _blocks(b, source, block_chars, block_schema), _BLOCKS), "token-blocks")
    uses = blocks.select("block", F.posexplode("words").alias("place", "word"))
    # block and place in one number, and place and pieces in another: what travels is as narrow as can be
    place = F.col("place").cast("long")
    uses = uses.select("word", (F.shiftleft("block", PLACE_BITS) + place).alias("use"))
    pieces = uses.select("word").distinct().mapInArrow(lambda b: _pieces(b, source), "word string, pieces long")
    found = uses.join(pieces, "word").select(
        F.shiftright("use", PLACE_BITS).alias("block"),
        (F.shiftleft(F.col("use").bitwiseAND((1 << PLACE_BITS) - 1), 32) + F.col("pieces")).alias("item"),
    )
    found = found.groupBy("block").agg(F.collect_list("item").alias("found"))
    joined = blocks.drop("words").join(found, "block", "left")
    joined = joined.withColumn("found", F.coalesce("found", F.array().cast("array<bigint>")))
    counted = joined.mapInArrow(lambda b: _sums(b, count_schema), _COUNTS)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))
