"""The registered queries of this subpackage: thin wrappers that derive each contract's columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docmill.llm.bpe import decode_documents, encode_documents
from docmill.llm.common import hex64, table
from docmill.llm.fingerprints import fingerprint_edits
from docmill.llm.langid import held_out, identify, train
from docmill.llm.mixing import mix_sources
from docmill.llm.neighbours import nearest
from docmill.llm.packing import pack_documents
from docmill.llm.preferences import format_preferences
from docmill.llm.repair import repair_conversations
from docmill.llm.scoring import score_documents
from docmill.llm.secrets import find_secrets
from docmill.llm.sharding import assign_shards
from docmill.llm.simhash import near_duplicates
from docmill.llm.vocab import added_tokens
from docmill.llm.whitening import whiten

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(fn):
    _QUERIES[fn.__name__] = fn
    return fn


@_query
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents by SimHash."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex64("fp").alias("fingerprint"), "component_id")


@_query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    base = ("assign", "access", "hex")
    kind = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return find_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *[kind(k) for k in base],
        F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*base))), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@_query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed. The vocabulary is byte_bpe_50k.json's, read from its file of ranks; its added tokens count in texts."""
    packed = pack_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), added_tokens(vocabulary("byte_bpe_50k.json")))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@_query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from those that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, ~held_out())
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@_query
def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes."""
    return assign_shards(table(spark, sf_dir, "documents"), 16, "bytes").withColumn("grown_shard", F.lit(None).cast("int"))


@_query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    coded = decode_documents(encode_documents(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))


@_query
def op3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of every 20th embedding."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


@_query
def op4_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, paired by their first turn."""
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias(c)
    out = format_preferences(table(spark, sf_dir, "conversations"))
    return out.select("chosen_id", "rejected_id", "n_common", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


@_query
def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pseudo-likelihood of all documents."""
    return score_documents(table(spark, sf_dir, "documents"))


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in their first four whitened components."""
    return whiten(table(spark, sf_dir, "embeddings"), 4)


@_query
def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by the weights 5, 2, 1 of their sources to 150 % of all words."""
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


@_query
def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    return repair_conversations(table(spark, sf_dir, "conversations"))


_SQL["op4_preferences"] = """
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos
  from conversations where conv_id is not null),
f as (select conv_id, role, text from t where pos = 1),
l1 as (select *, row_number() over w as n, lead(conv_id) over w as nxt from f window w as (partition by role, text, conv_id // 256 order by conv_id)),
l2 as (select conv_id, role, text, row_number() over w as n, lead(conv_id) over w as nxt from l1 where n % 2 = 1 and nxt is null window w as (partition by role, text, conv_id // 65536 order by conv_id)),
l3 as (select conv_id, role, text, row_number() over w as n, lead(conv_id) over w as nxt from l2 where n % 2 = 1 and nxt is null window w as (partition by role, text, conv_id // 16777216 order by conv_id)),
l4 as (select conv_id, role, text, row_number() over w as n, lead(conv_id) over w as nxt from l3 where n % 2 = 1 and nxt is null window w as (partition by role, text order by conv_id)),
pairs as (
  select conv_id as c, nxt as r from l1 where n % 2 = 1 and nxt is not null
  union all select conv_id, nxt from l2 where n % 2 = 1 and nxt is not null
  union all select conv_id, nxt from l3 where n % 2 = 1 and nxt is not null
  union all select conv_id, nxt from l4 where n % 2 = 1),
size as (select conv_id, max(pos) as n from t group by conv_id),
diff as (
  select p.c, min(a.pos) as pos from pairs p join t a on a.conv_id = p.c left join t b on b.conv_id = p.r and b.pos = a.pos
  where p.r is not null and (b.pos is null or a.role != b.role or a.text != b.text) group by p.c),
common as (
  select p.c, p.r, case when p.r is null then 0 else coalesce(d.pos - 1, s.n) end as n from pairs p join size s on s.conv_id = p.c left join diff d on d.c = p.c),
parts as (
  select c.c, c.r, 'p' as side, t.* from common c join t on t.conv_id = c.c and t.pos <= c.n
  union all select c.c, c.r, 'c', t.* from common c join t on t.conv_id = c.c and t.pos > c.n
  union all select c.c, c.r, 'r', t.* from common c join t on t.conv_id = c.r and t.pos > c.n),
placed as (
  select *, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as line,
         coalesce(sum(length(role) + length(text) + 13) over (partition by c, side order by pos rows between unbounded preceding and 1 preceding), 0) + length(role) + 5 as begin
  from parts),
texts as (
  select c, side, string_agg(line, '' order by pos) as line,
         coalesce(string_agg(case when role = 'assistant' then cast(begin as bigint) || ':' || cast(begin + length(text) + 7 as bigint) end, ',' order by pos), '') as mask
  from placed group by c, side)
select c.c as chosen_id, c.r as rejected_id, cast(c.n as bigint) as n_common, coalesce(p.line, '') as prompt, coalesce(a.line, '') as chosen,
       case when c.r is not null then coalesce(b.line, '') end as rejected, coalesce(a.mask, '') as chosen_mask, case when c.r is not null then coalesce(b.mask, '') end as rejected_mask
from common c left join texts p on p.c = c.c and p.side = 'p' left join texts a on a.c = c.c and a.side = 'c' left join texts b on b.c = c.c and b.side = 'r'
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
