"""The registered queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, divergence, exact_dedup, lexical, media, ngram_join, packing, pii, secrets, token_files, toxicity, warc
from .common import scratch_root


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> bytes:
    return Path(public_tokenizers.path(name)).read_bytes()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(table(spark, sf_dir, "documents"), n=5, num=75, den=100)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op3_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = media.audio_features(media.media_column(table(spark, sf_dir, "documents")))
    return rows.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws("|", F.sha2("tensors", 256), "spans").alias("feature"),
    )


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.secret_spans(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    return rows.select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"),
        secrets.joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_root(spark)}/token-files-{uuid.uuid4().hex}"
    files = token_files.write_token_files(table(spark, sf_dir, "documents"), path, vocabulary("byte_bpe_50k.json"), end_id=2, special=True)
    rows = token_files.document_ids(files)
    return rows.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


def _formatted(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.format_chat(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = chat.read_chat(_formatted(spark, sf_dir))
    learned = chat.learned(F.col("segments"))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        F.col("first_error").cast("long").alias("first_error"),
    )


def op6_chat_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine's verdict alone, without formatting."""
    return _formatted(spark, sf_dir).select("conv_id", "n_turns", "valid", F.col("first_error").cast("long").alias("first_error"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096, special=True)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = vocabulary("byte_bpe_multi_50k.tiktoken")
    rows = bpe.bpe_decode(bpe.bpe_encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op9_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pii.pii_spans(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: F.startswith(s, F.lit(f"{kind}:")))).cast("long")
    kinds = F.array(*[F.lit(k) for k in pii.KINDS])
    place = F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(kinds, F.substring_index(s, ":", 1)).alias("k"), F.get(F.split(s, ":"), 1).cast("long").alias("a"), s.alias("s")))
    return rows.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in pii.KINDS],
        F.sha2(F.array_join("base", ","), 256).alias("base_sha256"),
        F.array_join(F.transform(F.array_sort(place), lambda x: x["s"]), ",").alias("spans"),
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    rows = toxicity.toxicity(docs, model)
    return rows.select("doc_id", (toxicity.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted", F.col("spans").alias("toxic_spans"))


def op11_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    import uuid

    path = f"{scratch_root(spark)}/warc-{uuid.uuid4().hex}"
    warc.write_archive(warc.page_records(table(spark, sf_dir, "pages")), path)
    rows = warc.read_archive(spark, path)
    return rows.select(F.col("id").alias("page_id"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), warc.field("WARC-Type").alias("record_type"), "refers_to")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_exact_dedup, op3_audio_features, op4_secret_scan, op5_token_files, op6_chat_format, op6_chat_order, op7_best_fit_packing, op8_byte_bpe, op9_pii_spans, op10_toxicity, op11_warc_archive, op12_source_divergence, op13_ranked_search)}

_SPACES = r"[\x20\x09-\x0D]"
_BREAKS = [(c, f"{c[0]}\\{c[1:]}") for c in chat.CONTROLS]


def _escaped(sql: str) -> str:
    sql = f"replace({sql}, '\\', '\\\\')"
    for whole, broken in _BREAKS:
        sql = f"replace({sql}, '{whole}', '{broken}')"
    return sql


def _marks() -> str:
    known = " ".join(f"when '{role}' then {len(a) + len(b)}" for role, (a, b, _) in chat.TEMPLATE.items())
    return f"case role {known} else {sum(map(len, chat.OTHER))} + length({_escaped('role')}) end"


def _moves() -> str:
    return " or ".join(f"i {'=' if state == 'start' else '>'} 0 and state = '{state}' and role = '{role}'" for state, to in chat.MACHINE.items() for role in to).join("()")


_TURNS = """select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'"""
# a state bears the name of the role that led to it
_ORDER = f"""t as (select conv_id, role, row_number() over w - 1 as i, coalesce(lag(role) over w, 'start') as state from c window w as (partition by conv_id order by turn nulls first, role, text)),
e as (select conv_id, count(*) as n_turns, arg_max(role, i) as last, min(i) filter (not {_moves()}) as first_error from t group by conv_id),
o as (select conv_id, n_turns, first_error is null and last in ({", ".join(f"'{s}'" for s in chat.ACCEPT)}) as valid, first_error from e)"""

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select w.doc_id, count(g) as n from w left join s on s.doc_id = w.doc_id group by w.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
r as (select doc_id as a, doc_id as b from n union select r.a, e.b from r join e on e.a = r.b)
select n.doc_id, n.n as n_shingles, min(r.b) as component_id from n join r on r.a = n.doc_id group by n.doc_id, n.n""",
    "op2_exact_dedup": f"""
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g')) as h from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by h) as group_size, row_number() over w = 1 as kept, h as text_sha256
from t window w as (partition by h order by n desc, doc_id)""",
    "op6_chat_order": f"with c as ({_TURNS}), {_ORDER} select * from o",
    "op6_chat_format": f"""
with c as ({_TURNS}), {_ORDER}
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
cast(sum(length({_escaped('text')}) + {_marks()}) as bigint) as formatted_chars, any_value(o.valid) as valid, any_value(o.first_error) as first_error
from c join o using (conv_id) group by conv_id""",
    "op11_warc_archive": """
with p as (select page_id, encode(coalesce(html, '')) as b from pages),
w as (select page_id, octet_length(b) as n, sha256(b) as d, first_value(page_id) over h as lead, row_number() over h as i from p window h as (partition by b order by page_id nulls first))
select page_id, n as payload_bytes, d as payload_digest, case when n >= 100 and i > 1 then 'revisit' else 'response' end as record_type, case when n >= 100 and i > 1 then lead end as refers_to from w""",
    "op12_source_divergence": r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
w as (select r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
k as (select lang, term, count(*) as total from w group by all having count(distinct r) >= 10),
c as (select lang, source, term, count(*) as n from w group by all),
g as (select distinct lang, source from d),
x as (select g.lang, g.source, k.term, k.total, coalesce(c.n, 0) as n from g join k on k.lang = g.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
s as (select *, 1 + (1000000000::hugeint * (n + 2)) // (sum(n) over a + 2 * count(*) over a) as p, 1 + (1000000000::hugeint * (total + 2)) // (sum(total) over a + 2 * count(*) over a) as q from x window a as (partition by lang, source)),
f as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as v from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.v, 0) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join f on f.lang = a.lang and f.source = a.source and f.item = b.source
union all select lang, source, 'term', term, (p - q) * (p - q) // (p + q) from s where n > 0 and p > q),
z as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from o)
select lang, source, part, item, cast(value as bigint) as value, cast(rank as int) as rank from z where part = 'pair' or rank <= 10""",
    "op13_ranked_search": r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
i as (select row_number() over () as i, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
q as (select i, item_id, term, count(*) as times from i group by all),
a as (select count(*)::hugeint as n, sum(len(t))::hugeint as total from d where len(t) > 0),
p as (select r, term, count(*) as tf from (select r, unnest(t) as term from d) where term in (select term from q) group by all),
w as (select term, cast(floor(1000 * ln((2 * n + 2)::double / (2 * count(*) + 1)::double)) as bigint) as w from p, a group by term, n),
m as (select r, doc_id, 75 + (25 * len(t) * n) // total as m from d, a where len(t) > 0),
s as (select q.i, q.item_id, m.doc_id, m.r, sum(q.times * w.w * (1000000000::hugeint * p.tf // (1000 * p.tf + 12 * m.m))) as score from q join w using (term) join p using (term) join m using (r) group by all),
z as (select *, row_number() over (partition by i order by score desc, doc_id nulls first) as rank from s where score > 0)
select item_id, cast(rank as int) as rank, doc_id, cast(score as bigint) as score from z where rank <= 20""",
}
