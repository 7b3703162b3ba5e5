"""The registered queries of the training-data operators, and the same results as DuckDB SQL."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quire.functions.paths import work_dir
from quire.llm.common import table, text_or_empty
from quire.llm.decontam import contaminated
from quire.llm.divergence import audit_sources
from quire.llm.exact_dedup import drop_copies
from quire.llm.html_text import extract_main_text
from quire.llm.mixing import mix_sources
from quire.llm.near_dedup import near_duplicates
from quire.llm.quality import fit_quality, score_quality
from quire.llm.sanitise import BASE_KINDS, find_personal_data
from quire.llm.sharding import SHARDS, record_size, shuffle_into_shards, write_shards
from quire.llm.token_counts import count_tokens
from quire.llm.token_files import read_token_shards, write_token_shards
from quire.llm.trie import conversation_trie
from quire.llm.url_filter import RULES, judge_urls, rule_table


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; TOKENIZER_DIR overrides the installed folder."""
    folder = os.environ.get("TOKENIZER_DIR")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_shards(write_token_shards(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_copies(table(spark, sf_dir, "documents"))


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), carry=["doc_id"])


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents are shuffled and written to shards, whole; the rows are read off the files."""
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    text_crc32 = F.crc32(text_or_empty().cast("binary"))
    placed = shuffle_into_shards(docs, [F.col("doc_id"), text_crc32, record_size()], record_size(), SHARDS)
    path = work_dir(spark, "shards")
    write_shards(placed, path)
    return spark.read.schema(placed.schema).parquet(path).select(
        "doc_id",
        record_size().alias("size"),
        text_crc32.alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans")


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_quality": op2_quality,
    "op3_decontamination": op3_decontamination,
    "op4_token_files": op4_token_files,
    "op5_url_filter": op5_url_filter,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_source_mix": op8_source_mix,
    "op9_html_text": op9_html_text,
    "op10_sharding": op10_sharding,
    "op11_source_divergence": op11_source_divergence,
    "op12_personal_data": op12_personal_data,
    "op13_prefix_trie": op13_prefix_trie,
}

ORACLE: dict[str, str] = {
    "op3_decontamination": r"""
        with masks(m, tail) as (
          values (0, [1, 2, 3, 5, 6, 9, 10, 11]), (1, [1, 2, 4, 5, 7, 8, 10, 11]),
                 (2, [1, 3, 4, 6, 7, 8, 9, 11]), (3, [1, 2, 3, 4, 8, 9, 10, 11])
        ), d0 as (
          select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') as w from documents
        ), i0 as (
          select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{M}\p{N}]+') as w from benchmark
        ), items as (
          select distinct item_id, w from i0 where len(w) > 0
        ), at_doc as (
          select doc_id, w, unnest(range(len(w))) as place from d0
        ), at_item as (
          select item_id, w, unnest(range(len(w) - 10)) as place from items where len(w) >= 11
        ), in_doc as (
          select doc_id, w, place, m, list_transform(tail, lambda i: w[place + i]) as seed
          from at_doc, masks where place + 11 <= len(w)
        ), in_item as (  -- items that repeat a passage hold it once
          select distinct item_id, list_slice(w, greatest(place - 5, 0) + 1, least(place + 16, len(w))) as context,
                 place - greatest(place - 5, 0) as off, m, list_transform(tail, lambda i: w[place + i]) as seed
          from at_item, masks
        ), laid as (
          select doc_id, item_id, place, m, off, list_transform(range(len(context)), lambda i:
                   (place - off + i >= 0 and coalesce(d.w[place - off + i + 1] = context[i + 1], false))::int) as same
          from in_doc d join in_item using (m, seed)
        ), lefts as (select *, unnest(range(off + 1)) as l from laid
        ), runs as (select *, unnest(range(len(same) - 11 - off + 1)) as r from lefts
        ), sized as (
          select *, 11 + l + r as n_context, list_sum(list_slice(same, off - l + 1, off + 11 + r)) as n_equal from runs
        ), long_hits as (  -- of runs of 13 tokens or all that there are: the greatest share, then the longest
          select doc_id, item_id, place, max({s: n_equal / n_context, c: n_context, e: n_equal}).c as n_context,
                 max({s: n_equal / n_context, c: n_context, e: n_equal}).e as n_equal
          from sized where n_context >= least(13, len(same)) and (len(same) < 13 or (same[off - l + 1] = 1 and same[off + 11 + r] = 1))
          group by doc_id, item_id, place, m, off, same
        ), short_hits as (
          select doc_id, item_id, place, len(i.w) as n_context, len(i.w) as n_equal
          from at_doc d join items i on len(i.w) < 11 and list_slice(d.w, place + 1, place + len(i.w)) = i.w
        ), hits as (
          select * from (select * from long_hits union all select * from short_hits) where n_equal * 100 >= n_context * 80
        )
        select doc_id, item_id, count(*) as n_hits, max({s: n_equal / n_context, c: n_context, e: n_equal}).e::int as n_equal,
               max({s: n_equal / n_context, c: n_context, e: n_equal}).c::int as n_context, min(place)::int as first_place
        from hits group by all
    """,
    "op5_url_filter": r"""
        with recursive rules(action, rule, h, p) as (
          values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
                 ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')
        ), cut as (
          select page_id, html, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) end as rest from pages
        ), p0 as (
          select page_id, html, coalesce(lower(regexp_extract(rest, '^[^/?#]*')), '') as host,
                 coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path,
                 lower(split_part(url, '://', 1)) || '://' || lower(regexp_extract(rest, '^[^/?#]*'))
                   || regexp_extract(rest, '^[^/?#]*([^#]*)', 1) as node
          from cut
        ), links as (
          select node, regexp_extract(regexp_extract(html, '(?i)<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>'),
                                      '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1) as link from p0
          union all
          select node, regexp_extract(regexp_extract(html, '(?i)<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>'),
                                      '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) as link from p0
        ), edge as (  -- absolute links; the given pages have no others
          select node as a, regexp_extract(link, '^[^#]*') as b from links where link like '%://%'
        ), both_ways as (select a, b from edge union select b, a from edge
        ), reach(a, b) as (
          select distinct node, node from p0 where node is not null
          union select r.a, e.b from reach r join both_ways e on r.b = e.a
        ), named as (
          select p0.page_id, p0.host, p0.path, p0.node, arg_max(rules.rule, length(rules.rule)) as rule,
                 arg_max(rules.action, length(rules.rule)) as action
          from p0 left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
          group by all
        ), spread as (
          select r.a, bool_or(n.action = 'allow') as any_allow, bool_or(n.action = 'block') as any_block
          from reach r join named n on n.node = r.b group by 1
        )
        select page_id, host, path, rule,
               case when action is not null then action when any_allow then 'allow' when any_block then 'block' else 'allow' end as verdict
        from named left join spread on spread.a = named.node
    """,
    "op6_exact_dedup": r"""
        with n as (
          select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
        )
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
        from n window w as (partition by norm)
    """,
    "op7_near_dedup": r"""
        with recursive words as (
          select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x20\x09-\x0D]+') as w from documents
        ), runs as (
          select doc_id, w, unnest(range(greatest(len(w) - 2, 1))) as i from words where len(w) > 0
        ), shingles as (select distinct doc_id, list_slice(w, i + 1, i + 3) as s from runs
        ), sizes as (select doc_id, count(*) as n from shingles group by 1
        ), common as (
          select a.doc_id as a, b.doc_id as b, count(*) as n from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
          group by 1, 2
        ), link as (
          select a, b from common c join sizes x on x.doc_id = c.a join sizes y on y.doc_id = c.b
          where 100 * c.n >= 85 * (x.n + y.n - c.n)
        ), both_ways as (select a, b from link union select b, a from link
        ), reach(a, b) as (
          select doc_id, doc_id from documents
          union select r.a, e.b from reach r join both_ways e on r.b = e.a
        ), least as (select a as doc_id, min(b) as component_id from reach group by 1)
        select doc_id, coalesce(sizes.n, 0) as n_shingles, component_id, doc_id = component_id as kept
        from least left join sizes using (doc_id)
    """,
    "op11_source_divergence": r"""
        with d as (
          select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
                 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w from documents
        ), words as (select r, lang, source, unnest(w) as term from d
        ), kept as (select lang, term, count(*) as n from words group by lang, term having count(distinct r) >= 30
        ), langs as (select lang, sum(n) as total, count(*) as v from kept group by lang
        ), counts as (select lang, source, term, count(*) as n from words join kept using (lang, term) group by all
        ), groups as (
          select lang, source, coalesce(sum(n), 0) as total
          from (select distinct lang, source from d) left join counts using (lang, source) group by all
        ), shares as (  -- every group with every kept term of its language
          select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
                 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v)::hugeint as p,
                 1 + (1000000000::hugeint * (k.n + 5)) // (l.total + 5 * l.v)::hugeint as q
          from groups g join langs l using (lang) join kept k using (lang) left join counts c using (lang, source, term)
        ), sums as (
          select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value
          from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all
        ), pair as (
          select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
          from groups a join groups b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source
        ), term as (
          select lang, source, 'term' as part, term as item, (p - q)::bigint as value from shares where n > 0 and p > q
        ), ranked as (
          select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank
          from (select * from pair union all select * from term)
        )
        select * from ranked where part = 'pair' or rank <= 50
    """,
    "op13_prefix_trie": r"""
        with t as (
          select conv_id, r, x, row_number() over (
                   partition by conv_id order by turn nulls first, md5(length(r)::varchar || ':' || r || x)) as pos
          from (select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as x from conversations where conv_id is not null)
        ), n as (select conv_id, count(*) as n from t group by 1
        ), c0 as (  -- CRC-32, bit by bit
          select conv_id, n, conv_id - conv_id % 100 as base, xor(4294967295::bigint, list_reduce(
                   list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda ch: ascii(ch)::bigint)),
                   lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)),
                                                 lambda v, i: xor(v >> 1, 3988292384::bigint * (v & 1))))) % 6 as h
          from n
        ), c as (select c0.*, least(h, coalesce(b.n, 0)) as taken from c0 left join n b on b.conv_id = c0.base
        ), rebuilt as (
          select conv_id, pos - h + taken as pos, r, x from t join c using (conv_id) where pos > h
          union all
          select c.conv_id, t.pos, r, x from c join t on t.conv_id = c.base and t.pos <= c.taken
        ), s0 as (select conv_id, list({'r': r, 'x': x} order by pos) as s from rebuilt group by 1
        ), s as (select conv_id, coalesce(s, []) as s from c left join s0 using (conv_id)
        ), places as (select conv_id, s, unnest(range(len(s) + 1)) as depth from s
        ), node as (
          select list_slice(s, 1, depth) as path, depth, min(conv_id) as conv_id, count(*) as n_convs,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (len(s) = depth), '')) as ends_sha256
          from places group by 1, 2
        ), kids as (select list_slice(path, 1, depth - 1) as path, count(*) as n_children from node where depth > 0 group by 1
        ), full_node as (select node.*, coalesce(n_children, 0) as n_children from node left join kids using (path)
        ), above as (select *, unnest(range(depth + 1)) as up from full_node
        ), tree as (
          select list_slice(path, 1, up) as path, count(*) filter (n_children = 0) as n_leaves,
                 sum(case when depth > 0 then (n_convs - 1) * length(path[depth].x) else 0 end) as saved
          from above group by 1
        )
        select f.conv_id, f.depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves,
               saved::bigint as saved_tokens, f.ends_sha256
        from full_node f join tree using (path) left join node p on p.depth = f.depth - 1 and p.path = list_slice(f.path, 1, f.depth - 1)
    """,
}
