"""Information-theoretic sanitisation of personal data.

1. Emails, network addresses, card and phone numbers are found by fixed patterns; they are the protected entities.
2. The corpus tells what gives an entity away: a term that stands near the entity in documents, and hardly anywhere
   without it, reveals it. With p(c | t) the share of the documents holding term t in which entity c stands near t,
   the pointwise mutual information of c and t falls short of all the information in c by -log2 p(c | t) bits. A term
   that leaves fewer bits open than a threshold, seen in enough different contexts, discloses the entity.
3. In documents that hold the entity, such a term is generalised (digits masked, or its first letters) where the
   general form, counted in the corpus by the same rule, leaves enough bits open; otherwise it is removed.

Windows around mentions keep the number of (entity, term) rows in proportion to the text. Document frequencies of
candidate terms come from a second pass over all texts, filtered by a bitmap of fixed size; the join that follows is
exact. Entities are stored as digests only.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import bounded_batches, broadcast_within, fixed, free_name, text_or_empty

OPEN_BITS = 1.0  # a term that leaves fewer bits of an entity open discloses it
CONTEXTS = 3  # different contexts in which a term must stand near the entity
NEAR_TERMS, NEAR_CHARS = 10, 400  # terms on each side of a mention, within so many characters
BITMAP_BITS = 1 << 24
HELD = 50_000
BROADCAST_ROWS = 200_000

BASE_KINDS = ("email", "ip", "card", "phone")
GENERAL, REMOVED = "general", "removed"

# the four patterns; written so that no text makes them slow
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")

_TERM = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))
_MASK = bytes(35 if 48 <= i <= 57 else i for i in range(256))  # digits as #

_SCAN = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, entities array<binary>"
_NEAR = "entity binary, term binary, form binary, context long"

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[tuple[int, int]]:
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            low = found.end()
            yield start, low
        at = text.find("@", max(at + 1, low))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, by kind as listed, then by start. Matches that fail a test are dropped."""
    spans = [("email", *s) for s in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            spans.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _NO_DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and _luhn(digits):
                spans.append(("card", *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NO_DIGIT.sub("", m.group())) <= 15:
            spans.append(("phone", *m.span()))
    return spans


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _entity(text: str, span: Span) -> bytes:
    """Digest of what a span names: letters of emails in lower case, numbers without separators."""
    kind, start, end = span
    value = text[start:end].lower() if kind == "email" else text[start:end] if kind == "ip" else _NO_DIGIT.sub("", text[start:end])
    return hashlib.blake2b(f"{kind}:{value}".encode(), digest_size=16).digest()


def _without(text: str, spans: list[Span]) -> str:
    """``text`` with line feeds in place of the spans; all other characters keep their places."""
    parts, at = [], 0
    for _, start, end in sorted(spans, key=lambda s: s[1:]):
        start = max(start, at)
        if end > start:
            parts += [text[at:start], "\n" * (end - start)]
            at = end
    return "".join(parts) + text[at:] if parts else text


def _terms(text: str) -> list[bytes]:
    """Runs of ASCII letters and digits and of characters beyond ASCII; A-Z in lower case."""
    return text.encode().translate(_FOLD).split()


def general_form(term: bytes) -> bytes:
    """A wider class that the term belongs to: digits masked, or else the first three bytes (whole characters) and a star."""
    masked = term.translate(_MASK)
    return masked if masked != term else term[:3].decode(errors="ignore").encode() + b"*"


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[list] = [[] for _ in range(7)]
        for text in batch.columns[-1].to_pylist():
            spans = base_spans(text)
            count = Counter(s[0] for s in spans)
            joined = _joined(spans)
            values = [*(count[k] for k in BASE_KINDS), hashlib.sha256(joined.encode()).hexdigest(), joined, sorted({_entity(text, s) for s in spans})]
            for column, value in zip(rows, values):
                column.append(value)
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(pa.binary())]
        names = [c.split()[0] for c in _SCAN.split(", ")]
        columns = [pa.array(c, k) for c, k in zip(rows, kinds)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*batch.schema.names[:-1], *names])


def _near_terms(text: str) -> Iterator[tuple[bytes, bytes, int]]:
    """entity, term, context: each term near a mention of the entity once, with the words on its two sides."""
    spans = base_spans(text)
    if not spans:
        return
    masked = _without(text, spans)
    mentions: dict[bytes, list[Span]] = {}
    for span in spans:
        mentions.setdefault(_entity(text, span), []).append(span)
    for entity, places in mentions.items():
        seen: dict[bytes, int] = {}
        for _, start, end in places:
            # a term cut by the edge of the window does not count
            before = _terms(masked[max(0, start - NEAR_CHARS) : start])[1 if start > NEAR_CHARS else 0 :]
            after = _terms(masked[end : end + NEAR_CHARS])
            after = after[:-1] if len(masked) > end + NEAR_CHARS else after
            before, after = before[-NEAR_TERMS - 1 :], after[: NEAR_TERMS + 1]
            words = [b"", *before, b"@", *after, b""]
            for i in range(1, len(words) - 1):
                if i != len(before) + 1 and abs(i - len(before) - 1) <= NEAR_TERMS and words[i] not in seen:
                    seen[words[i]] = zlib.crc32(words[i - 1] + b" " + words[i + 1])
        for term, context in seen.items():
            yield entity, term, context


def _near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.binary(), pa.binary(), pa.int64()]
    names = ["entity", "term", "form", "context"]
    rows: list[tuple] = []

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
        rows.clear()
        return batch

    for batch in batches:
        for text in batch.column(0).to_pylist():
            for entity, term, context in _near_terms(text):
                rows.append((entity, term, general_form(term), context))
                if len(rows) >= HELD:
                    yield flushed()
    if rows:
        yield flushed()


def _frequencies(bitmap: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the documents that hold each term or general form whose bit is set."""
    last = len(bitmap) * 8 - 1

    def wanted(key: bytes) -> bool:
        bit = zlib.crc32(key) & last
        return bool(bitmap[bit >> 3] >> (bit & 7) & 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["key", "docs"])
            held.clear()
            return batch

        for batch in batches:
            for text in batch.column(0).to_pylist():
                terms = set(_terms(_without(text, base_spans(text))))
                numbered = {t for t in terms if not t.isalpha() and t.translate(_MASK) != t}
                starts = {t[:3] for t in terms - numbered}  # few, so the general form is made for few
                forms = {general_form(t) for t in numbered} | {general_form(s) for s in starts}
                held.update(filter(wanted, terms | forms))
            if len(held) >= HELD:
                yield rows()
        yield rows()

    return run


def _bitmap(keys: DataFrame) -> bytes:
    """One bit for the hash of each key: 2 MB, however many keys there are."""
    bit = F.crc32("key").bitwiseAND(BITMAP_BITS - 1)
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    words = keys.select(F.shiftright(bit, 6).alias("word"), mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("mask"))
    bits = np.zeros(BITMAP_BITS // 64, np.int64)
    found = words.toArrow()
    bits[found.column("word").to_numpy()] = found.column("mask").to_numpy()
    return bits.astype("<i8").tobytes()


def disclosing_terms(docs: DataFrame, open_bits: float = OPEN_BITS, contexts: int = CONTEXTS) -> DataFrame:
    """entity (digest), term, both, docs, kind: terms that leave fewer than ``open_bits`` bits of an entity open.

    both: documents in which the term stands near the entity; docs: documents that hold the term outside the
    base spans; kind: ``general`` where the general form leaves enough open, else ``removed``.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(text_or_empty().alias("text"))
    near = texts.mapInArrow(_near, _NEAR)
    near = near.groupBy("entity", "term", "form", "context").agg(F.count(F.lit(1)).alias("both"))
    joint = near.groupBy("entity", "term", "form").agg(F.sum("both").alias("both"), F.count(F.lit(1)).alias("contexts"))
    joint = fixed(joint, "near-terms")
    # an upper bound: a document with several terms of one form counts several times
    forms = joint.groupBy("entity", "form").agg(F.sum("both").alias("form_both"))
    candidates = joint.where(F.col("contexts") >= contexts).join(forms, ["entity", "form"])
    candidates = fixed(candidates, "candidates")
    keys = candidates.select(F.col("term").alias("key")).unionByName(candidates.select(F.col("form").alias("key"))).distinct()
    counted = texts.mapInArrow(_frequencies(_bitmap(keys)), "key binary, docs long").groupBy("key").agg(F.sum("docs").alias("docs"))
    counted = fixed(counted.join(keys, "key", "left_semi"), "frequencies")

    def discloses(both: str, held: str) -> Column:
        return F.col(both) * float(2**open_bits) > F.col(held)

    known = candidates.join(counted.withColumnRenamed("key", "term"), "term").where(discloses("both", "docs"))
    known = known.join(counted.select(F.col("key").alias("form"), F.col("docs").alias("form_docs")), "form")
    kind = F.when(discloses("form_both", "form_docs"), REMOVED).otherwise(GENERAL)
    return fixed(known.select("entity", "term", "both", "docs", kind.alias("kind")), "disclosing")


def _mark() -> Column:
    return F.md5(text_or_empty().cast("binary"))


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        joined = []
        for text, terms in zip(batch.column("text").to_pylist(), batch.column("terms").to_pylist()):
            spans = base_spans(text)
            # ``removed`` comes last in the alphabet, and so wins over ``general``
            kinds = {t["term"]: t["kind"] for t in sorted(terms, key=lambda t: t["kind"])}
            more = []
            for m in _TERM.finditer(_without(text, spans)):
                kind = kinds.get(m.group().encode().lower())
                if kind:
                    more.append((kind, *m.span()))
            joined.append(_joined(spans + sorted(more)))
        yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(joined, pa.string())], names=["mark", "all_spans"])


def find_personal_data(docs: DataFrame, open_bits: float = OPEN_BITS, contexts: int = CONTEXTS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, mark, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Base spans are the fixed patterns'; added ones (``general``, ``removed``) are the occurrences, outside base spans,
    of terms that disclose an entity of the same document. spans lists all as kind:start:end, by kind in the order
    email, ip, card, phone, general, removed, then by start; code points, end exclusive. mark: digest of the text.

    Null text counts as empty. Texts have any length and are read whole. Repeated rows each count as a document and
    come out alike. Ids are passed on as they are; other columns are not looked at. Empty table, empty result.
    """
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark().alias("mark"), text_or_empty().alias("text"))
    base = fixed(texts.mapInArrow(_scan, f"doc_id long, mark string, {_SCAN}"), "base-spans")
    terms = broadcast_within(disclosing_terms(docs, open_bits, contexts).select("entity", "term", "kind"), BROADCAST_ROWS)
    held = base.where(F.size("entities") > 0).select("mark", "entities").distinct().select("mark", F.explode("entities").alias("entity"))
    found = held.join(terms, "entity").groupBy("mark").agg(F.collect_set(F.struct("term", "kind")).alias("terms"))
    found = fixed(found, "terms-of-texts")
    marks = broadcast_within(found.select("mark"), BROADCAST_ROWS)
    whole = texts.join(marks, "mark", "left_semi").groupBy("mark").agg(F.first("text").alias("text"))
    added = whole.join(found, "mark").select("mark", "text", "terms").mapInArrow(_added, "mark string, all_spans string")
    added = broadcast_within(fixed(added, "added-spans"), BROADCAST_ROWS)
    return base.join(added, "mark", "left").select(
        "doc_id", "mark", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", F.coalesce("all_spans", "spans").alias("spans")
    )


def _rewritten(text: str, spans: str) -> str:
    """``text`` with [KIND] for base spans, the general form for general ones, nothing for removed ones."""
    parts, at = [], 0
    listed = [s.split(":") for s in spans.split(",")]
    for kind, start, end in sorted(((k, int(s), int(e)) for k, s, e in listed), key=lambda s: s[1:]):
        if start < at:  # base spans can overlap; the first stands for both
            at = max(at, end)
            continue
        word = text[start:end]
        form = general_form(word.encode().lower()).decode() if kind == GENERAL else "" if kind == REMOVED else f"[{kind.upper()}]"
        parts += [text[at:start], form]
        at = end
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame, open_bits: float = OPEN_BITS, contexts: int = CONTEXTS) -> DataFrame:
    """``docs`` with all columns; in ``text`` the spans of ``find_personal_data`` are generalised or removed."""
    found = find_personal_data(docs, open_bits, contexts).where("spans <> ''").select("mark", "spans").distinct()
    found = found.select(F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    rewrite = F.udf(lambda text, spans: text if spans is None else _rewritten(text, spans), "string", useArrow=True)
    place = docs.columns.index("text")
    mark, spans = free_name(docs, "_mark"), free_name(docs, "_spans")
    found = broadcast_within(found.withColumnsRenamed({"_mark": mark, "_spans": spans}), BROADCAST_ROWS)
    joined = docs.withColumn(mark, _mark()).join(found, mark, "left")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    columns[place] = rewrite(F.col("text"), F.col(spans)).alias("text")
    return joined.select(columns)
