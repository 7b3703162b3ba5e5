"""The source audit against a plain count of every term, on small hostile tables."""

import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import divergence

SCHEMA = "text string, lang string, source string, item string, N string"
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def rows(spark, values):
    return spark.createDataFrame([(*v, "x", "y") for v in values], SCHEMA)


def plain(values, min_docs, top):
    """Every share of every group and term, compared one by one."""
    upper = {c: c + 32 for c in range(65, 91)}
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in values:
        words = TERM.findall((text or "").translate(upper))
        counts[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
    out = []
    for lang, found in docs.items():
        kept = sorted(t for t, n in found.items() if n >= min_docs)
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        groups[None] = sum(groups.values(), Counter())
        p = {}
        for s, c in groups.items():
            below = sum(c[t] for t in kept) + 5 * len(kept)
            p[s] = {t: 1 + 10**9 * (c[t] + 5) // below for t in kept}
        for s in groups.keys() - {None}:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in groups if o not in (s, None)]
            terms = [(p[s][t] - p[None][t], t) for t in kept if groups[s][t] and p[s][t] > p[None][t]]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:most])]
    return sorted(out)


def ours(df):
    return sorted(map(tuple, df.collect()))


def texts(n, seed, languages=("en", "de", None), sources=12):
    rng = np.random.default_rng(seed)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(150)] + ["É", "été", "Ü", "語", "I", "i", "ſ", "K"]
    weight = 1 / np.arange(1, len(words) + 1)
    values = []
    for _ in range(n):
        k = int(rng.integers(0, 60))
        source = f"s{rng.integers(sources)}" if rng.random() < 0.6 else "hot"
        drawn = rng.choice(words, k, p=weight / weight.sum())
        values.append((" 12,".join(drawn), languages[rng.integers(len(languages))], source))
    return values


def test_audit_equals_a_plain_count(spark, monkeypatch):
    monkeypatch.setattr(divergence, "TILE", 3)  # several tiles, hot source and languages of unlike size
    values = texts(400, 1)
    values += [(None, "en", "s1"), ("", None, None), ("12 34", "en", "numbers only"), ("solo", "xx", "a"), ("", "xx", "b"), (None, "yy", None)]
    values += [("AbC abc \x00 abc\x7fabc", "en", "hot")] * 40  # repeated rows
    assert ours(divergence.audit_sources(rows(spark, values), min_docs=8, top=5)) == plain(values, 8, 5)


def test_words_beyond_one_chunk(spark):
    letters = "abcdefghijklmnopqr"
    words = [a + b + c for a in letters for b in letters for c in letters]  # 5,832 terms
    values = [(" ".join(words[i::2] * (1 + i)), "en", f"s{i}") for i in (0, 1)] * 2 + [(" ".join(words), "en", "all")]
    assert ours(divergence.audit_sources(rows(spark, values), min_docs=1, top=50)) == plain(values, 1, 50)


def test_very_long_texts(spark):
    values = [("ab cd " * 1_000_000 + "x" * 5_000_000, "en", "long"), ("ab", "en", "short"), ("cd ef", "en", "short")]
    assert ours(divergence.audit_sources(rows(spark, values), min_docs=1)) == plain(values, 1, 50)


def test_no_rows_and_no_terms(spark):
    assert divergence.audit_sources(rows(spark, [])).count() == 0
    values = [("a", "en", "s"), ("b", "en", "t"), ("c", "de", "s")]
    assert ours(divergence.audit_sources(rows(spark, values), min_docs=30)) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]
