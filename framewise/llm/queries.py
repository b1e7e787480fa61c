"""The registered queries: each applies one operator to its whole table. SQL where it can express the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, exact_dedup, licenses, merkle, mixing, ngram_join, packing, repair, sentencepieces, token_store, topk, toxicity, warc
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_path() -> str:
    """The SentencePiece model that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents"), 4, 85, 100)


def op2_ngram_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with each document's number of links."""
    return ngram_join.join_links(table(spark, sf_dir, "documents"), 4, 85, 100)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    extra = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.digest(chat.format_chat(turns.unionByName(extra)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("offending").cast("long").alias("n_offending"))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_corpus(token_store.write_corpus(table(spark, sf_dir, "documents"), tokenizer_path()))


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op9_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan_mix(table(spark, sf_dir, "documents"), repetition=1.5)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), 4096)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's place in the manifest, and what the proofs say once the line ends of half the texts are gone."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, merkle.row_digest({"text": F.replace(F.col("text"), F.lit("\n"), F.lit(""))}))
    return merkle.verify(merkle.manifest(table(spark, sf_dir, "documents"), {"changed": changed}), "changed")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.repair(repair.damaged(turns), turns)


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepieces.encode(table(spark, sf_dir, "documents"), pieces_path())
    return sentencepieces.digest(sentencepieces.decode(encoded, pieces_path()))


def queries() -> dict[str, Query]:
    return {
        "op1_license_scan": op1_license_scan,
        "op2_ngram_jaccard": op2_ngram_jaccard,
        "op2_ngram_links": op2_ngram_links,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_chat_format": op4_chat_format,
        "op5_toxicity": op5_toxicity,
        "op6_token_store": op6_token_store,
        "op7_topk_search": op7_topk_search,
        "op8_warc": op8_warc,
        "op9_temperature_mix": op9_temperature_mix,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_conversation_repair": op12_conversation_repair,
        "op13_sentencepiece": op13_sentencepiece,
    }


#: Sets, links and reached documents of the n-gram join.
LINKED = """
with recursive w as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
s as (
  select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
    else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh from w),
n as (select doc_id, cast(len(sh) as bigint) as n from s),
u as (select doc_id, unnest(sh) as g from s),
c as (select a.doc_id as a, b.doc_id as b, count(*) as k from u a join u b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as reached from n union select r.doc_id, e.b from r join e on e.a = r.reached)
"""

OP2_SQL = f"""{LINKED}
select doc_id, n.n as n_shingles, min(reached) as component_id from r join n using (doc_id) group by all
"""

OP2_LINKS_SQL = f"""{LINKED}
select doc_id, n.n as n_shingles, min(reached) as component_id, coalesce(any_value(c.n_links), 0) as n_links
from r join n using (doc_id) left join (select a as doc_id, count(*) as n_links from e group by a) c using (doc_id) group by doc_id, n.n
"""

OP3_SQL = """
with d as (select doc_id, sha256(coalesce(text, '')) as h from documents),
g as (select h, max(doc_id) as keep_id, count(*) as group_size from d group by h)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, h as text_sha256 from d join g using (h)
"""

OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, row_number() over w as n, lag(role) over w as before,
    regexp_replace(text, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g') as etext,
    regexp_replace(role, '([<\[])(\\*)(\||s>|/s>|INST\]|/INST\])', '\1\2\\\3', 'g') as erole
  from t window w as (partition by conv_id order by turn nulls first, role, text))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by n)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by n) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length(etext) + case when before = role then 10 else 33 + length(erole) end) as bigint) as formatted_chars
from e group by conv_id
"""

OP7_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id, cast(list_inner_product(q.e, x.e) as bigint) as score from v q join v x on q.vec_id <> x.vec_id where q.vec_id % 20 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""

OP8_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as payload_bytes, sha1(h) as payload_digest, sha256(h) as k from p),
g as (select k, max(page_id) as winner from d where payload_bytes >= 1000 group by k having count(*) > 1)
select page_id, payload_bytes, payload_digest,
  case when winner is null or winner = page_id then 'response' else 'revisit' end as record_type,
  case when winner <> page_id then winner end as refers_to
from d left join g using (k)
"""


def _crc32(text: str) -> str:
    """SQL of the CRC-32 of an ASCII text; the table `crc`, joined to the rows, has the remainders of single bytes as `t`."""
    step = "lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split({text}, ''), lambda c: cast(ascii(c) as bigint))), {step}), 4294967295)"


CRC = """crc as (select list(list_reduce(list_prepend(i, list_transform(range(8), lambda x: cast(0 as bigint))),
    lambda a, b: case when (a & 1) = 1 then xor(a >> 1, 3988292384) else a >> 1 end) order by i) as t from range(256) r(i))"""

#: Trees level by level: nodes of every level, then each row's siblings from the bottom, below and above its source's root.
OP11_SQL = f"""
with recursive {CRC},
d as (
  select documents.*, {_crc32("cast(doc_id as varchar)")} % 2 = 0 as changed from documents, crc),
h as (
  select row_number() over () as r, source, doc_id, {{own}} as leaf,
    case when changed then {{other}} else {{own}} end as second from d),
i as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as idx, count(*) over (partition by source) as n from h),
low as (
  select source, 0 as level, idx, n, leaf as node from i
  union all
  select source, level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from low where n > 1 group by source, level, idx // 3, n),
subs as (select source, node as subroot, row_number() over (order by source nulls first) - 1 as idx, count(*) over () as n from low where n = 1),
top as (
  select 0 as level, idx, n, subroot as node from subs
  union all
  select level + 1, idx // 3, (n + 2) // 3, sha256(string_agg(node, '' order by idx)) from top where n > 1 group by level, idx // 3, n),
steps as (
  select i.r, low.level as level, coalesce(string_agg(low.node, '' order by low.idx) filter (where low.idx < i.idx // cast(3 ** low.level as bigint)), '') as before,
    coalesce(string_agg(low.node, '' order by low.idx) filter (where low.idx > i.idx // cast(3 ** low.level as bigint)), '') as after
  from i join low on low.source is not distinct from i.source and low.n > 1 and low.idx // 3 = i.idx // cast(3 ** (low.level + 1) as bigint) group by all
  union all
  select i.r, 1000 + top.level, coalesce(string_agg(top.node, '' order by top.idx) filter (where top.idx < subs.idx // cast(3 ** top.level as bigint)), ''),
    coalesce(string_agg(top.node, '' order by top.idx) filter (where top.idx > subs.idx // cast(3 ** top.level as bigint)), '')
  from i join subs on subs.source is not distinct from i.source join top on top.n > 1 and top.idx // 3 = subs.idx // cast(3 ** (top.level + 1) as bigint) group by all),
s as (select r, list({{{{'b': before, 'a': after}}}} order by level) as path, string_agg(before || after, '' order by level) as siblings from steps group by r),
f as (select i.*, subs.subroot, coalesce(s.siblings, '') as siblings, coalesce(s.path, []) as path from i join subs on subs.source is not distinct from i.source left join s using (r)),
w as (
  select r, 0 as k, second as node from f
  union all
  select r, k + 1, sha256(path[k + 1].b || node || path[k + 1].a) from w join f using (r) where k < len(path))
select doc_id, leaf, subroot, (select node from top where n = 1) as root, sha256(siblings) as proof_sha256, w.node as folded_root,
  w.node = (select node from top where n = 1) as verified
from f join w on w.r = f.r and w.k = len(f.path)
"""
_H = "sha256(" + " || ".join(f"coalesce(octet_length(encode({c})) || ':' || {c}, '-')" for c in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", "{text}")) + ")"
OP11_SQL = OP11_SQL.format(own=_H.format(text="text"), other=_H.format(text="replace(text, chr(10), '')"))


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


def _edit(way: str, cost: str, edit: str, where: str = "true") -> str:
    """A weight after one more edit; where it isn't allowed, one that no other exceeds."""
    return f"case when {where} then {{'c': {way}.c + {cost}, 'e': {way}.e || '{edit}'}} else {{'c': cast(1000000000000 as bigint), 'e': ''}} end"


#: States of the grammar: s0 start, s1 after s, s2 after u, s3 after a; t0 to t3 with insertions.
OP12_SQL = rf"""
with recursive {CRC},
k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    {_crc32("coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ')")} % 20 as kind from conversations, crc),
a as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text
  from k, unnest(range(case kind when 0 then 0 when 3 then 2 else 1 end)) where true),
o as (
  select *, row_number() over w as n, left(lag(role) over w, 1) || left(role, 1) as pair, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as said
  from a window w as (partition by conv_id order by turn nulls first, role, text)),
v as (select *, row_number() over (partition by conv_id, role, text order by n) as seen from o),
r as (
  select *, left(role, 1) as i, said = '' or seen > 1 as gone, said <> '' and seen = 1 and right(said, 1) not in ('.', '!', '?') as late from v),
g as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where said = '') as blank,
    count(*) filter (where said <> '' and seen > 1) as duplicate, count(*) filter (where late) as truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) as illegal, max(n) as rows from r group by conv_id),
p as (
  select conv_id, 0 as n, {{'c': cast(0 as bigint), 'e': ''}} as s0, {_edit("{'c': 0, 'e': ''}", "0", "", "false")} as s1,
    {_edit("{'c': 0, 'e': ''}", "0", "", "false")} as s2, {_edit("{'c': 0, 'e': ''}", "0", "", "false")} as s3 from g
  union all
  select conv_id, n, {_edit("t0", "4", "D")}, {_least(_edit("t1", "4", "D"), _edit("t0", "w", "K", "i = 's' and not gone"))},
    {_least(_edit("t2", "4", "D"), *[_edit(t, "3 + w", "R", "not gone") for t in ("t0", "t1", "t3")], *[_edit(t, "w", "K", "i = 'u' and not gone") for t in ("t0", "t1", "t3")])},
    {_least(_edit("t3", "4", "D"), _edit("t2", "3 + w", "R", "not gone"), _edit("t2", "w", "K", "i = 'a' and not gone"))}
  from (
    select r.conv_id, r.n, r.i, r.gone, case when r.late then 3 else 0 end as w, s0 as t0, s1 as t1,
      {_least("s2", *[_edit(s, "3", "I") for s in ("s0", "s1", "s3")])} as t2,
      {_least("s3", _edit("s2", "3", "I"), *[_edit(s, "6", "II") for s in ("s0", "s1", "s3")])} as t3
    from p join r on r.conv_id is not distinct from p.conv_id and r.n = p.n + 1)),
b as (
  select p.conv_id, {_least("s0", "s3", _edit("s2", "3", "I"), *[_edit(s, "6", "II") for s in ("s0", "s1")])} as best
  from p join g on g.conv_id is not distinct from p.conv_id and p.n = g.rows),
e as (select conv_id, best.c as cost, best.e as audit, unnest(string_split(best.e, '')) as edit, generate_subscripts(string_split(best.e, ''), 1) as k from b),
q as (
  select *, count(*) filter (where edit <> 'I') over w as n, count(*) filter (where edit <> 'D') over w as place,
    count(*) filter (where edit <> 'D') over (partition by conv_id) % 2 as head
  from e window w as (partition by conv_id order by k)),
z as (
  select q.conv_id, string_agg(case when edit = 'K' then r.role || ':' || r.text
    else case when (place - head) % 2 = 1 then 'user:' else 'assistant:' end || case when edit = 'R' then r.text else '' end end, chr(10) order by k) as said
  from q left join r on r.conv_id is not distinct from q.conv_id and r.n = q.n where edit <> 'D' group by q.conv_id)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
  coalesce(illegal, 0) as illegal, coalesce(best.c, 0) as cost, coalesce(best.e, '') as audit, sha256(coalesce(said, '')) as repaired_sha256
from (select distinct conv_id from conversations) c left join g on g.conv_id is not distinct from c.conv_id
  left join b on b.conv_id is not distinct from c.conv_id left join z on z.conv_id is not distinct from c.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_ngram_jaccard": OP2_SQL, "op2_ngram_links": OP2_LINKS_SQL, "op3_exact_dedup": OP3_SQL, "op4_chat_format": OP4_SQL, "op7_topk_search": OP7_SQL, "op8_warc": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op12_conversation_repair": OP12_SQL}
