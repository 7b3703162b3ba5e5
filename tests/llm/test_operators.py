"""The training-data operators on small hostile tables, against brute force."""

import html
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quire.llm import components, decontam, exact_dedup, grammar, html_text, mixing, near_dedup, quality, queries, sharding, url_filter
from quire.llm.components import connected_components
from quire.llm.queries import tokenizer_file
from quire.llm.token_counts import count_tokens
from quire.llm.token_files import _Encoder, read_token_shards, write_token_shards

tokenizers = pytest.importorskip("tokenizers")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, row string, size string"
BASE = [f"w{i}" for i in range(60)]


def documents(spark, texts, sources=None):
    sources = sources or ["s"] * len(texts)
    rows = [(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, (t, s) in enumerate(zip(texts, sources, strict=True))]
    return spark.createDataFrame(rows, DOCS)


def strings(n, seed=3):
    rng = np.random.default_rng(seed)
    return [" ".join(rng.choice(["the", "of", "Blend,", "x.\ny", "ÉTÉ", "12"], rng.integers(0, 40))) for _ in range(n)]


HOSTILE = [
    "", None, " ", "a  b", "a \nb c", "\n a", "x <|endoftext|> y, z.", "a<|endoftext|>", "é  b", "it's 'S I'LL 12 3,4 ...",
    "<|ENDOFTEXT|>, Σας ΣΑΣ. İ", "a\x1cb \x85c", "日本 語。", "foo, bar. Baz.. 7, 7.", "q" * 3000, "long word " * 2000,
]


def test_token_counts_equal_the_library(spark):
    name = tokenizer_file("word_bpe_49k.json")
    library = tokenizers.Tokenizer.from_file(name)
    texts = HOSTILE + strings(50)
    got = {r["doc_id"]: r for r in count_tokens(documents(spark, texts), name, block_chars=500).collect()}
    for i, text in enumerate(texts):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((text or "").encode()), n > 2048), text
    assert count_tokens(documents(spark, []), name).count() == 0
    same = documents(spark, ["a b"]).withColumn("doc_id", F.lit(None).cast("long"))
    assert [r["n_tokens"] for r in count_tokens(same.unionByName(same), name).collect()] == [2, 2]


def test_token_files_equal_the_library(spark):
    name = tokenizer_file("byte_bpe_50k.json")
    library = tokenizers.Tokenizer.from_file(name)
    texts = HOSTILE + strings(50)
    expected, at = [], 0
    for i, text in enumerate(texts):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    shards = write_token_shards(documents(spark, texts), name, shard_ids=300)
    assert shards.count() > 2
    assert sorted(map(tuple, read_token_shards(shards).collect())) == expected
    assert read_token_shards(write_token_shards(documents(spark, []), name)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_grammar_round_trip_and_random_access(seed):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, 5 + seed * 20, 20_000).astype(np.int32)
    ends = np.unique(np.r_[rng.integers(0, 20_000, 30), 20_000])
    ends = np.r_[0, ends]  # an empty document
    shard = grammar.Shard(grammar.pack(ids, ends, 100))
    assert len(shard.rules) and len(shard.symbols) < len(ids)
    assert (shard.ids() == ids).all() and (shard.counts() == np.diff(ends, prepend=0)).all()
    starts = np.r_[0, ends[:-1]]
    for number in rng.integers(0, len(ends), 10):
        whole = ids[starts[number] : ends[number]]
        a = int(rng.integers(0, len(whole) + 1))
        assert (shard.document(number, a, a + 50) == whole[a : a + 50]).all()


def test_quality_learns_junk_and_survives_hostile_rows(spark):
    rng = np.random.default_rng(1)
    good = [" ".join(rng.choice(["the", "house", "of", "green", "and"], 60)) for _ in range(150)]
    junk = [" ".join(rng.choice(["BUY!!", "$$$", "***", "|"], 60)) for _ in range(60)]
    docs = documents(spark, good + junk + HOSTILE)
    labels = [(i, int(i < 150), 0) for i in range(0, 210, 2)] + [(1, 0, 0), (1, 1, 0), (None, 1, 0), (3, None, 0)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, labels)
    scored = {r["doc_id"]: r["kept"] for r in quality.score_quality(docs, model).collect()}
    assert len(scored) == 210 + len(HOSTILE)
    assert sum(scored[i] for i in range(150)) >= 148 and sum(scored[i] for i in range(150, 210)) <= 1
    kept = quality.good_documents(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in scored.items() if k}
    nothing = quality.fit_quality(docs, labels.limit(0))  # no labels: everything scores a half and stays
    assert quality.score_quality(docs.drop("lang"), nothing).where("not kept").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0


def test_quality_hands_over_labels_from_all_documents(spark):
    rng = np.random.default_rng(1)
    words = {0: ["$$$", "###", "9999", "BUY!"], 1: ["the", "river", "runs", "over", "stones"]}
    kinds = rng.integers(0, 2, 9600)
    docs = documents(spark, [" ".join(rng.choice(words[k], 20)) for k in kinds], [f"s{k}" for k in kinds])
    labels = spark.createDataFrame([(i, int(kinds[i])) for i in range(600)], "doc_id long, quality int")
    model = quality.fit_quality(docs, labels)
    assert all(sum(given) > 8000 for given in zip(*model.rounds, strict=True))  # of 9,000, by each view
    kept = {r["doc_id"]: r["kept"] for r in quality.score_quality(docs, model).collect()}
    assert all(kept[i] == bool(k) for i, k in enumerate(kinds))


def test_decontamination_finds_passages_with_replaced_words(spark):
    passage = [f"p{i}" for i in range(30)]
    changed = [w if i % 7 else "other" for i, w in enumerate(passage)]
    wrecked = [w if i % 2 else "other" for i, w in enumerate(passage)]
    filler = [f"f{i}" for i in range(700)]
    texts = [
        " ".join(filler[:300] + passage + filler[300:]), " ".join(filler + changed), " ".join(filler + wrecked), " ".join(filler),
        "P0, p1 p2: P3", "", None, " ".join(["s1 s2 s3", *filler]), "s1 s2 x s3", " ".join(passage),
    ]
    bench = spark.createDataFrame([(7, " ".join(passage)), (9, " ".join(passage)), (8, "s1 s2 s3"), (1, None), (2, "")], "item_id long, text string")
    docs = documents(spark, texts)
    pairs = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, bench).collect()}
    assert pairs == {(0, 7), (1, 7), (9, 7), (0, 9), (1, 9), (9, 9), (7, 8)}  # equal items are both named
    clean = decontam.without_contaminated(docs, bench)
    assert sorted(r["doc_id"] for r in clean.collect()) == [2, 3, 4, 5, 6, 8] and clean.columns == docs.columns
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0
    assert decontam.contaminated(docs.limit(0), bench).count() == 0
    seeds = decontam.benchmark_seeds(bench)[0]
    blocks = decontam.leaked_passages(seeds, docs, ["doc_id"], block_seeds=10)
    assert blocks.count() == decontam.leaked_passages(seeds, docs, ["doc_id"]).count()


def test_decontamination_finds_excerpts_from_inside_items(spark):
    shared = [f"s{i}" for i in range(20)]
    items = {1: [f"a{i}" for i in range(40)] + shared, 2: shared + [f"b{i}" for i in range(40)], 3: [f"c{i}" for i in range(15)] + shared, 4: [f"d{i}" for i in range(12)]}
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()] * 2, "item_id long, text string")  # repeated rows
    filler = [f"f{i}" for i in range(300)]
    texts, want = [], set()
    for start in (0, 7, 14, 27):
        for n in (11, 12, 13, 14, 16, 17, 25):
            cut = items[1][start : min(start + n, 40)]
            if n >= 13 and len(cut) >= 13:
                want.add((len(texts), 1))
            texts.append(" ".join(filler[:100] + cut + filler[100:]))
    for n in (13, 20):  # a passage that three items share
        want |= {(len(texts), i) for i in (1, 2, 3)}
        texts.append(" ".join(filler + shared[:n] + filler))
    for at, found in ((2, True), (6, False)):  # replaced words in an 18-token excerpt, every 8th or every third
        cut = [w if i % (8 if found else 3) != at % 3 else "x" for i, w in enumerate(items[1][10:28])]
        want |= {(len(texts), 1)} if found else set()
        texts.append(" ".join(filler + cut))
    want |= {(len(texts), 4), (len(texts) + 1, 4)}  # a short item counts where 80 per cent of it are there
    texts += [" ".join(items[4]), " ".join(items[4][:11]), " ".join(filler), None, "", " ".join(filler * 200 + items[2][25:38])]
    want.add((len(texts) - 1, 2))
    got = decontam.contaminated(documents(spark, texts + texts[:1]), bench).collect()
    pairs = {(r["doc_id"], r["item_id"]) for r in got}
    want.add((len(texts), 1)) if (0, 1) in want else None
    assert pairs == want
    assert all(r["n_context"] >= 12 and r["n_equal"] * 100 >= r["n_context"] * 80 for r in got)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40) if i != 20] + [(100, 200 + i) for i in range(30)] + [(5, 5), (None, 3), (300, 300)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    expected = {i: 0 if i <= 20 else 21 for i in range(41)} | {100: 100} | {200 + i: 100 for i in range(30)}
    assert found == expected


def test_urls_inherit_from_aliases(spark):
    def canonical(url):
        return f'<html><head><link rel="canonical" href="{url}"></head></html>'

    rows = [
        (1, "http://a.net/x", None), (2, "http://b.com/y", canonical("http://A.net/x#f")), (3, "http://c.com/", canonical("/z?q=1&amp;r=2")),
        (4, "http://c.com/z?q=1&r=2", '<META http-equiv="refresh" content="0; url=http://b.com/y">'), (5, None, ""), (6, "nohost", canonical("http://a.net/x")),
        (7, "http://q.org/fr/1", canonical("http://e.net/")), (8, "http://e.net/", None), (9, "http://f.com/", canonical("http://e.net/")),
        (10, "http://example.net/en/a", ""), (11, "HTTP://WWW.Example.NET", ""), (1, "http://a.net/x", None),
    ]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, rule string")
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect())
    assert got == [
        (1, "a.net", "/x", "net/", "block"), (1, "a.net", "/x", "net/", "block"), (2, "b.com", "/y", None, "block"),
        (3, "c.com", "/", None, "block"), (4, "c.com", "/z", None, "block"), (5, "", "", None, "allow"), (6, "", "", None, "allow"),
        (7, "q.org", "/fr/1", "org/fr/", "allow"), (8, "e.net", "/", "net/", "block"), (9, "f.com", "/", None, "allow"),
        (10, "example.net", "/en/a", "example.net/en/", "allow"), (11, "www.example.net", "", None, "allow"),
    ]
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


@pytest.mark.parametrize(
    ("source", "links"),
    [
        ('<link rel="alternate canonical" href="/a">', ["http://h.com/a"]),
        ('<link data-rel="canonical-x" rel="icon" href="/a">', []),
        ('<!-- <link rel=canonical href=/a> --><script>"<link rel=canonical href=/b>"</script>', []),
        ('<link href="c?x=1&amp;y=&#50;" REL=CANONICAL>', ["http://h.com/p/c?x=1&y=2"]),
        ('<link rel=canonical href=../up><base href="//o.org/x/"><base href="/y/">', ["http://o.org/up"]),
        ('<link rel=canonical href="/a"><link rel=canonical href=b>', ["http://h.com/a", "http://h.com/p/b"]),
        ("<meta content=\"0; URL='/r s'\" http-equiv=Refresh>", ["http://h.com/r s"]),
        ('<meta http-equiv=refresh content="5;/r"><meta http-equiv=refresh content="5">', ["http://h.com/r"]),
        ('<meta http-equiv=refresh content=\'0;url="http://a.b/c"\'>', ["http://a.b/c"]),
        ('<link rel=canonical><link rel=canonical href=""><link rel=canonical href="http://[x">', []),
        ('<link rel="canonical" href="/a>b">', ["http://h.com/a>b"]),
        ('<link rel="canonical" rel="icon" href="&#' + "9" * 5000 + ';">', ["http://h.com/p/\ufffd"]),
        ("", []),
    ],
)
def test_alias_links(source, links):
    assert url_filter.links_of("http://h.com/p/q", source) == links


def test_aliases_of_long_pages_and_urls(spark):
    far, long = "http://a.net/" + "y" * 100_000, "<div " * 100_000 + "z" * 1_000_000
    pages = spark.createDataFrame(
        [(1, "http://b.com/", long + f'><link rel=canonical href="{far}"><link rel=canonical href="http://c.com/">'), (2, far, None), (3, "http://c.com/", "")],
        "page_id long, url string, html string",
    )
    rules = url_filter.rule_table(spark, url_filter.RULES)
    got = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, rules).collect()}
    assert got == {1: "block", 2: "block", 3: "block"}


@pytest.mark.parametrize("n", [1, 2, 3, 1000])
def test_golomb_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
    for own in (values, np.unique(values >> np.uint64(50)), np.array([0, 2**64 - 1], np.uint64)):
        bits, first, code = exact_dedup.golomb_encode(own)
        assert (exact_dedup.golomb_decode(len(own), bits, first, code) == own).all()


def test_exact_copies(spark):
    texts = ["a  b", "a\tb", "a b ", None, "", "c", " ", "a\n\x0bb", "a b"]
    docs = documents(spark, texts)
    nulls = docs.where("doc_id = 5").withColumn("doc_id", F.lit(None).cast("long"))
    rows = exact_dedup.drop_copies(docs.unionByName(nulls).unionByName(docs.where("doc_id = 8"))).collect()
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows)
    assert got == [
        (-1, 5, 2, False), (0, 0, 3, True), (1, 0, 3, False), (2, 2, 1, True), (3, 3, 2, True), (4, 3, 2, False), (5, 5, 2, True),
        (6, 6, 1, True), (7, 0, 3, False), (8, 8, 2, False), (8, 8, 2, True),
    ]
    assert exact_dedup.drop_copies(docs.limit(0)).count() == 0


def brute_components(texts, width, percent):
    sets = []
    for text in texts:
        words = (text or "").lower().split()
        n = min(width, len(words))
        sets.append({tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, width, percent):
    monkeypatch.setattr(near_dedup, "LEADERS", (1,))  # more is left for the last round
    rng = np.random.default_rng(5)
    texts = ["", None, " \n", "one", "ONE", "two words", "two\twords", " ".join(BASE), " ".join(BASE)]
    for _ in range(90):  # copies with a few words replaced, chains among them
        words = list(BASE) * int(rng.integers(1, 3))
        for place in rng.integers(0, len(words), rng.integers(0, 4)):
            words[place] = f"v{rng.integers(0, 30)}"
        texts.append(" ".join(words))
    got = near_dedup.near_duplicates(documents(spark, texts), width, percent).collect()
    expected = brute_components(texts, width, percent)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


@pytest.mark.parametrize("n", [250, 500, 1000])
def test_pairs_of_a_large_group_grow_with_its_size(spark, monkeypatch, n):
    """One group of near copies, each with some words replaced; some are linked only through others."""
    rng = np.random.default_rng(n)
    words = [f"w{i}" for i in range(200)]
    texts = []
    for _ in range(n):
        copy = list(words)
        for place in rng.integers(0, 200, int(rng.integers(0, 9))):
            copy[place] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    tested = []
    confirmed = near_dedup._confirmed
    monkeypatch.setattr(near_dedup, "_confirmed", lambda pairs, *rest: tested.append(pairs.count()) or confirmed(pairs, *rest))
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert sum(tested) < 5 * n, tested
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(texts, 5, 80)
    assert len({r["component_id"] for r in got}) < n / 2


def test_no_round_builds_all_pairs_of_a_large_group(spark, monkeypatch):
    """Pairs are few when they are built, not only when their sets are compared."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(200)]
    n, texts = 600, []
    for _ in range(n):
        copy = list(words)
        for place in rng.integers(0, 200, int(rng.integers(0, 9))):
            copy[place] = f"v{rng.integers(10**6)}"
        texts.append(" ".join(copy))
    built = []
    open_pairs = near_dedup._open_pairs

    def counted(*args):
        built.append(open_pairs(*args).count())
        return open_pairs(*args)

    monkeypatch.setattr(near_dedup, "_open_pairs", counted)
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert sum(built) < 5 * n, built
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(texts, 5, 80)


def test_near_duplicates_end_their_rounds_early(spark, monkeypatch):
    """Every written step costs each run a few Spark jobs, whatever its size."""
    written = []
    for module in (near_dedup, components):
        fixed = module.fixed
        monkeypatch.setattr(module, "fixed", lambda df, purpose, fixed=fixed: written.append(purpose) or fixed(df, purpose))
    stars = spark.createDataFrame([(1, 2), (1, 3), (5, 9)], "src long, dst long")
    assert {(r["node"], r["component"]) for r in connected_components(stars).collect()} == {(1, 1), (2, 1), (3, 1), (5, 5), (9, 5)}
    assert written == ["edges"]
    written.clear()
    rng = np.random.default_rng(3)
    texts = []
    for _ in range(120):
        words = list(BASE) * 2
        for place in rng.integers(0, len(words), rng.integers(0, 4)):
            words[place] = f"v{rng.integers(0, 30)}"
        texts.append(" ".join(words))
    got = near_dedup.near_duplicates(documents(spark, texts)).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(texts, 5, 80)
    assert len(written) <= 20, written


def test_near_duplicate_stage_keeps_rows_as_they_are(spark):
    docs = documents(spark, [" ".join(BASE), " ".join(BASE[:-1]), None, "", "x y z"])
    docs = docs.unionByName(docs.where("doc_id = 0")).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    kept = near_dedup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [0, 2, 3, 4]
    assert near_dedup.without_near_duplicates(docs.limit(0)).count() == 0


def test_targets_stop_at_three_times_and_quotas_follow(spark):
    rows = [("a", 10), ("b", 1000), (None, 400), ("é", 0), ("c", 5)]
    targets = mixing.source_targets(spark.createDataFrame(rows, "source string, source_size long"))
    got = {r["source"]: r["target"] for r in targets.collect()}
    # weights a 1, b 2, c 3, é 1, null 2: a, c and é stop; the rest is shared by b and null
    assert got["a"] == 30 and got["c"] == 15 and got["é"] == 0
    assert math.isclose(got["b"], 685) and math.isclose(got[None], 685) and math.isclose(sum(got.values()), 1415)
    quotas = mixing.apportion(targets, 5, 283, shards=4).collect()
    assert sum(r["quota"] for r in quotas) == 283
    per_shard = Counter()
    for r in quotas:
        per_shard[r["shard"]] += r["quota"]
    assert max(per_shard.values()) - min(per_shard.values()) <= 1


def test_mix_comes_near_its_targets_and_is_repeatable(spark):
    texts = ["w " * (i % 50) for i in range(400)] + [None, "", "w " * 5000]
    sources = [["a", "b", None, "d"][i % 4] for i in range(403)]
    docs = documents(spark, texts, sources)
    mixed = mixing.mix_sources(docs.drop("size"), carry=["doc_id", "source"])
    rows = mixed.collect()
    assert len(rows) == 403 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for source in ("a", "b", None, "d"):
        own = [r for r in rows if r["source"] == source]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"] + 5
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.drop("size").repartition(7), carry=["doc_id", "source"]).collect()))
    stage = mixing.mixed_documents(docs)
    assert stage.columns == docs.columns and max(Counter(r["doc_id"] for r in stage.collect()).values()) <= 3
    assert mixing.mix_sources(docs.limit(0), carry=["doc_id"]).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


def test_mixed_stage_takes_long_documents_of_a_hot_source_in_proportion(spark):
    # a: 40 long documents of 5 to 44 blocks and some short ones, a third of its words taken; b and c: short ones
    sizes = [("a", 1000 * (5 + i)) for i in range(40)] + [("a", 50)] * 400 + [("b", 100)] * 300 + [("c", 100)] * 4000
    docs = documents(spark, ["w " * n for _, n in sizes], [s for s, _ in sizes])
    mixed = mixing.mix_sources(docs.drop("size"), carry=["doc_id", "source"], blocks=1430).collect()
    targets = {r["source"]: r["target"] for r in mixed}
    times = Counter(r["doc_id"] for r in mixing.mixed_documents(docs, blocks=1430).collect())
    share = targets["a"] / sum(n for s, n in sizes if s == "a")
    assert share < 0.45
    for source in ("a", "b", "c"):
        words = sum(times[i] * n for i, (s, n) in enumerate(sizes) if s == source)
        assert abs(words - targets[source]) <= 0.05 * targets[source]
    assert abs(sum(times[i] for i in range(40)) - 40 * share) <= 2
    again = Counter(r["doc_id"] for r in mixing.mixed_documents(docs.repartition(7), blocks=1430).collect())
    assert again == times


def test_mix_brings_small_sources_to_their_targets(spark):
    # one hot source; the others are 1/100,000 of the corpus, a block and a bit, and a few words
    sizes = [("hot", 10_000)] * 300 + [("rare", 6)] * 5 + [("some", 13)] * 100 + [("tiny", 3), (None, 1)]
    docs = documents(spark, ["w " * n for _, n in sizes], [s for s, _ in sizes])
    rows = mixing.mix_sources(docs.drop("size"), carry=["doc_id", "source"], blocks=2500).collect()
    assert len(rows) == len(sizes) and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    for source in ("hot", "rare", "some", "tiny", None):
        own = [r for r in rows if r["source"] == source]
        assert own[0]["target"] >= 3
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.02 * own[0]["target"]


@pytest.mark.parametrize("n", [0, 1, 39, 40, 333])
def test_shards_are_even_and_gapless(spark, n):
    texts = [None if i % 9 == 0 else f"t{i % 5}" for i in range(n)]
    placed = sharding.shuffle_into_shards(documents(spark, texts), [F.col("doc_id")], sharding.record_size(), 40, bucket_bytes=400)
    rows = placed.collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(n))
    counts = Counter(r["shard"] for r in rows)
    sizes = [counts[s] for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    assert {(r["shard"], r["slot"]) for r in rows} == {(s, k) for s in range(40) for k in range(counts[s])}
    if n == 333:
        assert [r["doc_id"] for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))] != list(range(n))
        same = sharding.shard_documents(documents(spark, ["x"] * 50).withColumn("doc_id", F.lit(None).cast("long")).withColumn("shard", F.lit("s")))
        assert same.count() == 50 and {"shard", "shard_", "slot"} <= set(same.columns)


def test_shards_are_written(spark, folder):
    sharding.write_shards(sharding.shard_documents(documents(spark, ["a", "b", "c"]), shards=2), folder + "/out")
    assert spark.read.parquet(folder + "/out").count() == 3


PAGE = """<html><body class="no-sidebar"><header>H<h1>x</h1></header><nav>menu</nav><div id="cookie-notice">We use</div>
<div class="wrap"><div class="post post-{n}"><h1>Title &lt;x</h1><p>Para <b>one</b> <a href="x>y">link</a>&nbsp;z<p>Two<br>three and more running text
<ul><li>i1<li>i2</ul><form>f</form><div class="ad-slot">buy</div></div><section class="comments"><p>nice post, a long comment that
goes on and on and on and on, and then on</p></section></div><footer>f</footer><script>var a="</p>"</script>"""


def test_main_text_by_consensus(spark):
    odd = '<body><div class="wrap"><div class="post post-9"><p>short</p></div><div class="other"><p>a much longer text beside it, not the main one</p></div></div>'
    rows = [(i, "http://h.com/1", PAGE.replace("{n}", str(i))) for i in range(3)]
    rows += [(7, "http://h.com/2", odd), (8, "http://other.com/", odd), (9, None, None), (10, "x", ""), (11, "http://h.com/3", "plain &amp; <b>text"), (11, None, "<!-- x")]
    pages = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in html_text.extract_main_text(pages).collect())
    main = "Title <x\nPara one link z\nTwo three and more running text\ni1\ni2"
    expected = [(i, main) for i in range(3)] + [(7, "short"), (8, "a much longer text beside it, not the main one"), (9, ""), (10, ""), (11, ""), (11, "plain & text")]
    assert got == [(i, t, len(t)) for i, t in expected]
    assert html_text.extract_main_text(pages.limit(0)).count() == 0


ARTICLE = "<article><h1>Head</h1><p>Some running text of an article, with enough words in it to be found as the main text of a page, and more words.</p>{}</article>"
BODY = "Head\nSome running text of an article, with enough words in it to be found as the main text of a page, and more words."


def read_page(source):
    page = html_text._Page(source)
    return page.text(page.vote()[0])


@pytest.mark.parametrize("attribute", ['class="responses"', 'id="feedback"', 'class="commentlist"', 'id="comments"'])
def test_reader_comments_go(attribute):
    comments = f"<div {attribute}><p>First comment of a reader</p><p>second comment of a reader</p></div>"
    assert read_page(f"<body>{ARTICLE.format(comments)}</body>") == BODY
    assert read_page(f"<body>{ARTICLE.format('')}{comments}</body>") == BODY


def test_paragraphs_of_the_article_stay():
    more = '<p class="notice-period">The notice period is a month.</p><p class="menu-item">Soup</p><p class="advert">buy</p>'
    assert read_page(ARTICLE.format(more)) == BODY + "\nThe notice period is a month.\nSoup"
    assert read_page('<article class="post comment-open">' + ARTICLE.format("")[9:]) == BODY
    assert read_page(f'<div id="feedback">{ARTICLE.format("")}</div>') == BODY


def test_forms_around_the_page_stay_and_others_go():
    wrapped = f'<body><form id="aspnetForm"><input type="hidden" name="v">{ARTICLE.format("")}<input name="q"><button>go</button></form></body>'
    assert read_page(wrapped) == BODY
    plain = "<form><div><p>" + "many words of running text " * 20 + "</p></div><input name=q></form>"
    assert read_page(plain) == ("many words of running text " * 20).strip()
    form = "<form><p>Write to us, we answer soon</p><input name=a><textarea>x</textarea><button>send</button></form>"
    assert read_page(ARTICLE.format(form)) == BODY


def test_heading_beside_the_container():
    beside = ARTICLE.replace("<h1>Head</h1>", "")
    assert read_page(f"<body><h1>Site</h1><p>x</p><h1></h1><h1>Head</h1>{beside.format('')}</body>") == BODY
    assert read_page(f"<body><div><h1>Site</h1></div><h1>Site</h1>{ARTICLE.format('')}</body>") == BODY
    assert read_page(f"<body><header><h1>Site</h1></header>{beside.format('')}</body>") == BODY[5:]


def test_odd_pages_take_time_by_their_length():
    pages = ["<div>x" * 50_000, '<div class="a b1">' * 20_000 + "y", "<a " * 100_000, "<script " * 50_000, '<a ">"' * 50_000]
    pages += ["<b>x" * 50_000, "<b>" * 20_000 + "<p></p>" * 20_000, "<i>" * 20_000 + "</u>" * 50_000, "<html>x" * 30_000]
    pages += ["<form>x" * 30_000, "<ul><li>x" * 30_000, "<!-" * 100_000, "<h1>x" * 30_000, "</script   " * 30_000, "&#" + "9" * 6000 + ";"]
    begun = time.monotonic()
    texts = [read_page(page) for page in pages]
    assert time.monotonic() - begun < 60
    assert texts[2] == ("<a " * 100_000).strip() and texts[-1] == "\ufffd"
    assert texts[5] == "x" * 50_000 and texts[0] == "\n".join("x" * 50_000)
    assert read_page("&#0000000065;&#x41;&#99999999999;1 <!-- a > b --> <3 <!-- open") == "AA\ufffd1 <3"


def test_reader_equals_a_plain_reader_of_articles(sf_dir):
    """The given pages hold their main text in one article element: taken from it by patterns alone."""
    pages = pq.read_table(f"{sf_dir}/pages.parquet", columns=["html"])["html"].to_pylist()
    for source in pages:
        article = re.search(r"<article>(.*?)</article>", source or "", re.S)
        blocks = re.split(r"</?(?:p|h1|article)>", re.sub(r"<br>", " ", article[1])) if article else []
        lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
        assert read_page(source or "") == "\n".join(line for line in lines if line)


def test_quality_on_labels_held_out(spark):
    """Fitted on half of the labels, judged on the other half: at least nine in ten of either kind are told right."""
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(2)) == 0
    model = quality.fit_quality(docs, labels.where(~held))
    judged = quality.score_quality(docs, model).select("doc_id", "kept").join(labels.where(held), "doc_id")
    counts = judged.groupBy("quality").agg(F.count_if(F.col("kept") == (F.col("quality") > 0)).alias("right"), F.count(F.lit(1)).alias("n"))
    found = {r["quality"]: (r["right"], r["n"]) for r in counts.collect()}
    assert len(found) == 2 and all(n > 20 and right >= 0.9 * n for right, n in found.values()), found


def test_sharding_rows_are_read_off_the_written_shards(spark, folder, monkeypatch):
    texts = [*strings(300), "", None, "", "ü" * 50]
    documents(spark, texts).select("doc_id", "text", "lang").write.parquet(f"{folder}/documents.parquet")
    written, write = [], queries.write_shards
    monkeypatch.setattr(queries, "write_shards", lambda placed, path: written.append(path) or write(placed, path))
    rows = {r["doc_id"]: r for r in queries.op10_sharding(spark, folder).collect()}
    stored = {r["doc_id"]: r for r in spark.read.parquet(written[0]).collect()}
    assert rows.keys() == stored.keys() == set(range(len(texts)))
    for i, text in enumerate(texts):
        data = (text or "").encode()
        assert stored[i]["text"] == text and stored[i]["lang"] == "en"
        assert (rows[i]["shard"], rows[i]["slot"]) == (stored[i]["shard"], stored[i]["slot"])
        assert (rows[i]["size"], rows[i]["text_crc32"], rows[i]["law"]) == (len(data) + 16, zlib.crc32(data), "rows")
    slots = Counter(r["shard"] for r in rows.values())
    assert len(slots) == 40 and max(slots.values()) - min(slots.values()) <= 1
    assert {(r["shard"], r["slot"]) for r in rows.values()} == {(s, i) for s, n in slots.items() for i in range(n)}


def test_op4_words_are_learned_without_the_punctuation_that_ends_them():
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as file:
        encoder = _Encoder(file.read())
    pieces = ["word", "Other7", "été", "жук", "&&&", "!!", ".", ",", "'s", "\n", "\t", " ", "  ", "<|endoftext|>", "|>", "*" * 30]
    texts = [f"a {one}{two} {three}{one}" for one in pieces for two in pieces for three in pieces] + ["", " "]
    assert [ids.tolist() for ids in encoder.encode(pa.array(texts))] == [encoder._ids(t) for t in texts]
    assert {"word", "Other7"} <= set(encoder.words) and not {"word&&&", "Other7!!", "word."} & set(encoder.words)
    assert encoder.encode(pa.array([], pa.string())) == []
