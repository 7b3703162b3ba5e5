"""Personal data against the plain patterns and a plain count of documents."""

import hashlib
import re
import time
from collections import Counter, defaultdict

import numpy as np

from quire.llm import sanitise

SCHEMA = "doc_id long, text string, mark string, spans string, terms string"

# the contract's patterns as they stand
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    doubled = [int(d) * (2 if i % 2 else 1) for i, d in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def plain_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m.group())

    spans = [("email", *m.span()) for m in EMAIL.finditer(text)]
    spans += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(digits(m)) <= 19 and luhn(digits(m))]
    return spans + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)


def joined(spans):
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def plain(texts, contexts=3):
    """All spans of each text: terms counted document by document, every document compared with every term."""
    word = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
    lower = {c: c + 32 for c in range(65, 91)}

    def form(term):
        masked = re.sub("[0-9]", "#", term)
        return masked if masked != term else term.encode()[:3].decode(errors="ignore") + "*"

    docs, near, seen, forms = Counter(), Counter(), defaultdict(set), Counter()
    held = []
    for text in texts:
        text = text or ""
        spans = plain_spans(text)
        blank = list(text)
        for _, s, e in spans:
            blank[s:e] = "\n" * (e - s)
        blank = "".join(blank)
        terms = [(m.group().translate(lower), *m.span()) for m in word.finditer(blank)]
        docs.update({t for t, _, _ in terms})
        docs.update({form(t) for t, _, _ in terms})
        entities = {}
        for kind, s, e in spans:
            value = text[s:e].lower() if kind == "email" else text[s:e] if kind == "ip" else re.sub("[^0-9]", "", text[s:e])
            before = [t for t in terms if t[2] <= s and t[1] >= s - 400][-11:]
            after = [t for t in terms if t[1] >= e and t[2] <= e + 400][:11]
            line = [""] + [t[0] for t in before] + ["@"] + [t[0] for t in after] + [""]
            middle = len(before) + 1
            for i in range(max(1, middle - 10), min(len(line) - 1, middle + 11)):
                if i != middle:
                    entities.setdefault((kind, value), {}).setdefault(line[i], (line[i - 1], line[i + 1]))
        for entity, found in entities.items():
            for term, context in found.items():
                near[entity, term] += 1
                seen[entity, term].add(context)
                forms[entity, form(term)] += 1
        held.append((text, spans, terms, set(entities)))
    out = []
    for text, spans, terms, entities in held:
        more = []
        for term, s, e in terms:
            kinds = set()
            for entity in entities:
                if len(seen[entity, term]) >= contexts and near[entity, term] * 2 > docs[term]:
                    kinds.add("removed" if forms[entity, form(term)] * 2 > docs[form(term)] else "general")
            if kinds:
                more.append((max(kinds), s, e))
        base = joined(spans)
        count = Counter(k for k, _, _ in spans)
        out.append((*(count[k] for k in ("email", "ip", "card", "phone")), hashlib.sha256(base.encode()).hexdigest(), joined(spans + sorted(more))))
    return out


def ours(df):
    return [tuple(r)[1:] for r in df.drop("mark").orderBy("doc_id").collect()]


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    common = ["the", "of", "mail", "call", "Maple", "und", "été", "box", "room", "near", "12", "a1"]
    people = [("ana@x.org", "Zaphira", "K-4821"), ("+1 (555) 010-9999", "Quillon", "Maple"), ("10.0.0.7", "Hostus9", "the"), ("4111 1111 1111 1111", "Vermilia", "Verdant")]
    texts = []
    for i in range(n):
        words = list(rng.choice(common, 30))
        if i % 3 == 0:
            value, name, other = people[int(rng.integers(len(people)))]
            words.insert(15, value)
            for extra in (name, other):
                words.insert(15 + int(rng.integers(-8, 8)), extra)
        elif i % 3 == 1:
            words += ["Verity", "a2b", f"zap{i}"]
        texts.append(" ".join(words))
    return texts


HOSTILE = [
    "", None, "a@b.c@d.e", "x@y", "..%+-@a-b.c-d.e.f", "a@b..c", "@", "é1.2.3.4é 256.1.1.1 1.2.3.4.5.6.7.8 01.002.0003.255", "1.2.3", "4111-1111 1111 1111 5",
    "4111111111111111", "+1-2 3 4 5 6 7", "+1 (555) 010 9999.", "+12345678901234567", "+1+12345678", "++1 23456789 -", "5" * 30, "\U0001f600 a@b.co \U0001f600",
    "1 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", "x@1.2.3.4", "4111 1111 1111 1111 +49 30 1234567 a+b@c.d", "0" * 19, "+1 23\n45678", "9" * 4000 + ".1.1.1",
]


def test_base_spans_are_those_of_the_patterns():
    rng = np.random.default_rng(2)
    alphabet = list("aZ09 .-+@()%_1114é\n")
    texts = [t or "" for t in HOSTILE ] + ["".join(rng.choice(alphabet, 60)) for _ in range(20_000)]
    assert [sanitise.base_spans(t) for t in texts] == [plain_spans(t) for t in texts]
    assert any(s for t in texts for s in sanitise.base_spans(t) if s[0] == "card")


def test_no_text_is_slow():
    begin = time.time()
    n = 2_000_000
    for text in ("a" * n, "1" * n, "1." * n, "1 " * n, "a@" * n, "a." * n + "@", "+1" * n, "+1" + " " * n, "@" * n, "x@" + "a" * n, "x@" + "a." * n + ".", "1-" * n):
        sanitise.base_spans(text)
    assert time.time() - begin < 60


def test_spans_equal_a_plain_count(spark):
    texts = corpus(240, 1) + HOSTILE + ["Zaphira ana@x.org"] * 5 + ["Zaphira alone", "Quillon"] + [f"{i} " * 40 + "ANA@x.org Mono " + "z " * i for i in range(5)]
    got = ours(sanitise.find_personal_data(rows(spark, texts)))
    assert got == plain(texts)
    kinds = Counter(s.split(":")[0] for r in got for s in r[5].split(",") if s)
    assert kinds["general"] and kinds["removed"]


def test_the_ways_of_joining_agree(spark, monkeypatch):
    texts = corpus(120, 5) * 2
    monkeypatch.setattr(sanitise, "BROADCAST_ROWS", 0)
    assert ours(sanitise.find_personal_data(rows(spark, texts))) == plain(texts)


def test_sanitised_text(spark):
    texts = corpus(240, 1) + [None, "", "no one", "4111 1111 1111 1111 +49 30 1234567 a+b@c.d"]
    got = [r for r in sanitise.sanitise(rows(spark, texts)).orderBy("doc_id").collect()]
    assert got[0].__fields__ == ["doc_id", "text", "mark", "spans", "terms"] and got[0]["mark"] == "x"
    assert [r["text"] for r in got[-4:]] == [None, "", "no one", "[CARD] [PHONE] [EMAIL]"]
    words = {w for r in got[:240] for w in r["text"].split()}
    assert "Quillon" not in words and "ana@x.org" not in words and "[EMAIL]" in words and "Maple" in words


def test_long_texts_and_no_rows(spark):
    assert sanitise.find_personal_data(rows(spark, [])).count() == 0
    texts = ["word ana@x.org " * 200_000, "9 " * 1_000_000, "tail " * 500_000 + "+1 23456789"]
    assert [r[:4] for r in ours(sanitise.find_personal_data(rows(spark, texts)))] == [(200_000, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 1)]
