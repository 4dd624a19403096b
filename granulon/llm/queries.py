"""The registered queries of this subpackage; each runs its operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from granulon.llm import chat, drake, hard_negatives, packing, pieces, pu_classifier, quality_rules, simhash, substring_dedup, suffix_dedup, token_files, topk, url_filter
from granulon.llm.common import load, materialise, shared_path


#: The rules of the query, fixed by its contract.
URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = url_filter.judge(load(spark, sf_dir, "pages"), URL_RULES, columns=["page_id"])
    return found.select("_row.page_id", "host", "path", "rule", "verdict")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("_row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("rule"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    # what rows are compared by stays in their row: doc_ids may be null or repeat
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("there"))
    coded = materialise(pieces.encode(docs, model, columns=("there",)), "pieces")
    coded = coded.select("*", F.size("ids").cast("long").alias("n_pieces"), F.crc32(F.array_join("ids", ",")).alias("ids_crc32"))
    back = pieces.decode(coded, model, columns=("n_pieces", "ids_crc32", "there"))
    return back.select("doc_id", "n_pieces", "ids_crc32", (F.col("there") == F.xxhash64("text")).alias("restored"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "tokens")
    token_files.write(load(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(load(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, component=lambda e: F.floor(256 * e.cast("double")).cast("double"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(load(spark, sf_dir, "conversations"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pu_classifier.judge(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))
    return found.select("_row.doc_id", "held_out", "score", "predicted")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.parsed(load(spark, sf_dir, "documents"), columns=["doc_id"])
    return found.select("_row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op11_drake_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drake.cluster(load(spark, sf_dir, "embeddings"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove(load(spark, sf_dir, "documents"))
    return found.select("_row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(load(spark, sf_dir, "embeddings"), label, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_token_files": op2_token_files,
    "op5_simhash": op5_simhash,
    "op6_topk": op6_topk,
    "op7_packing": op7_packing,
    "op3_url_filter": op3_url_filter,
    "op4_quality_rules": op4_quality_rules,
    "op8_chat": op8_chat,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_drake_clusters": op11_drake_clusters,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
_FITS = "(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}')"
_RULES = "case " + " ".join(f"when {_FITS.format(h=t.partition('/')[0], p=t.partition('/')[2])} then '{t}'" for _, t in sorted(URL_RULES, key=lambda r: -len(r[1]))) + " end"
_SAYS = "case rule " + " ".join(f"when '{t}' then '{v}'" for v, t in URL_RULES) + " end"


def _rounds(n: int) -> str:
    """CTEs of the centroids (c, x) c0 to cn; each round assigns to the nearest, smaller numbers first, and takes exact floors."""
    out = []
    for r in range(n):
        out.append(f"a{r} as materialized (select id, arg_min(c, (d, c)) as c from (select v.id, k.c, {_D2} as d from v, c{r} k) group by id)")
        out.append(f"s{r} as (select c, i, sum(x[i])::bigint as s, count(*) as n from (select c, x, unnest(generate_series(1, 64)) as i from a{r} join v using (id)) group by c, i)")
        out.append(f"m{r} as (select c, list((s - ((s % n) + n) % n) // n order by i) as x from s{r} group by c)")
        out.append(f"c{r + 1} as materialized (select c, coalesce(m{r}.x, c{r}.x) as x from c{r} left join m{r} using (c))")
    return ",\n".join(out)


_D2 = "list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint"
_FINITE = "list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))"


def _orders() -> str:
    """CTEs p0 to pORDER: each gram's estimates by both models (qr, qa), from the shorter gram's."""
    out, n = [], url_filter.ORDER
    for k in range(n + 1):
        out.append(f"s{k} as (select substr(gram, {n + 1 - k}, {k + 1}) as g, sum(r)::double as r, sum(a)::double as a from counts group by 1)")
        if k == 0:
            out.append("p0 as (select g, (r + 4.0::double * (1.0::double / v)) / (of_r + 4.0) as qr, (a + 4.0::double * (1.0::double / v)) / (of_a + 4.0) as qa from s0, (select sum(r) as of_r, sum(a) as of_a, count(*)::double as v from s0))")
        else:
            out.append(f"c{k} as (select substr(g, 1, {k}) as c, sum(r) as of_r, sum(a) as of_a from s{k} group by 1)")
            out.append(f"p{k} as (select s{k}.g, (r + 4.0::double * qr) / (of_r + 4.0) as qr, (a + 4.0::double * qa) / (of_a + 4.0) as qa from s{k} join c{k} on c = substr(s{k}.g, 1, {k}) join p{k - 1} q on q.g = substr(s{k}.g, 2, {k}))")
    return ",\n".join(out)


ORACLE: dict[str, str] = {
    "op8_chat": """
with t as (select conv_id, coalesce('r' || role, 'n') || chr(1) || coalesce('t' || text, 'n') as x, '<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10) as p,
    row_number() over (partition by conv_id order by turn nulls first, role nulls first, text nulls first) as n from conversations where conv_id is not null),
pre as (select conv_id, n, string_agg(x, chr(2)) over (partition by conv_id order by n) as h, lead(n) over (partition by conv_id order by n) is null as last from t),
whole as (select n, h, min(conv_id) as conv_id, count(*) as n_copies from pre where last group by n, h),
kept as (select * from whole w where not exists (select 1 from pre where not pre.last and pre.n = w.n and pre.h = w.h))
select k.conv_id, k.n as n_turns, n_copies, string_agg(p, '' order by t.n) as rendered from kept k join t using (conv_id) group by all""",
    "op6_topk": """
with v as (select distinct vec_id, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
    where vec_id is not null and embedding is not null and len(embedding) > 0 and list_bool_and(list_transform(embedding, lambda e: e is not null and isfinite(e)))),
s as (select q.vec_id as query_id, v.vec_id, list_inner_product(q.x, v.x)::bigint as score from v q join v on q.vec_id % 50 = 0 and v.vec_id <> q.vec_id and len(q.x) = len(v.x)),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5""",
    "op11_drake_clusters": f"""
with v as materialized (select row_number() over () as id, vec_id, list_transform(embedding, lambda e: floor(1024 * e::double)::bigint) as x from embeddings where len(embedding) = 64 and {_FINITE}),
c0 as materialized (select row_number() over (order by h, x) - 1 as c, x from (select sha256('3:' || vec_id) as h, x from v where vec_id is not null order by h, x limit 8)),
{_rounds(10)},
best as materialized (select id, vec_id, min((d, c)) as b from (select v.id, v.vec_id, k.c, {_D2} as d from v, c10 k) group by all)
select vec_id, b[2]::int as cluster, b[1]::bigint as distance, (sum(b[1]) over (partition by b[2]))::bigint as cluster_inertia, (sum(b[1]) over ())::bigint as inertia, sha256(list_aggregate(k.x, 'string_agg', ',')) as centroid_sha256
from best join c10 k on k.c = b[2]""",
    "op12_suffix_dedup": """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
win as (select doc_id, p, substr(h, 2 * p + 1, 100) as x from (select doc_id, h, unnest(range(0, n - 49)) as p from d)),
late as materialized (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by x) as lowest from win) where doc_id > lowest),
runs as materialized (select doc_id, min(p) as s, max(p) + 50 as e from (select doc_id, p, sum(new) over (partition by doc_id order by p) as g from
    (select doc_id, p, coalesce((p > lag(p) over (partition by doc_id order by p) + 50)::int, 1) as new from late)) group by doc_id, g),
kept as (select doc_id, coalesce(lag(e) over (partition by doc_id order by s), 0) as a, s as b from runs union all select doc_id, max(e), any_value(n) from runs join d using (doc_id) group by doc_id),
texts as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from kept join d using (doc_id) group by doc_id),
sums as (select doc_id, sum(e - s)::bigint as n_removed, count(*) as n_spans from runs group by doc_id)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(k, h))) as kept_sha256 from d left join texts using (doc_id) left join sums using (doc_id)""",
    "op13_hard_negatives": f"""
with v as (select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda e: floor(256 * e::double)) as x from embeddings
    where vec_id is not null and label is not null and len(embedding) > 0 and {_FINITE}),
r as (select *, row_number() over () as id from v),
s as materialized (select a.id, a.vec_id as anchor_id, a.label = v.label as alike, v.vec_id, list_inner_product(a.x, v.x)::bigint as score from r a join r v on a.vec_id % 100 = 0 and a.id <> v.id and len(a.x) = len(v.x)),
p as (select *, row_number() over (partition by id order by score desc, vec_id) as n from s where alike qualify n <= 5),
f as (select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.id, p.n order by s.score desc, s.vec_id))::int as rank, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score
    from p join s on p.id = s.id and not s.alike and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select * from f where rank <= 10""",
    "op10_substring_dedup": """
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as ws from documents),
win as (select doc_id, p, list_aggregate(ws[p:p + 12], 'string_agg', ' ') as x from (select doc_id, ws, unnest(generate_series(1, len(ws) - 12)) as p from w)),
late as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by x) as lowest from win) where doc_id > lowest),
gone as (select doc_id, list(distinct i) as g from (select doc_id, unnest(generate_series(p, p + 12)) as i from late) group by doc_id),
kept as (select doc_id, len(ws) as n_words, coalesce(len(g), 0) as n_removed, list_filter(ws, lambda x, i: not list_contains(coalesce(g, []), i)) as k from w left join gone using (doc_id))
select doc_id, n_words, n_removed, sha256(coalesce(list_aggregate(k, 'string_agg', ' '), '')) as kept_sha256 from kept""",
    "op3_url_filter": f"""
with parsed as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path, row_number() over () as id from pages),
ruled as (select *, {_RULES} as rule from parsed),
said as (select *, {_SAYS} as by_rule, repeat(chr(2), {url_filter.ORDER}) || host || path || chr(3) as s, substr(md5(host || path), 1, 1) < '{url_filter.HELD_OUT}' as held from ruled),
each as (select id, case when not held then by_rule end as train, substr(s, i::int, {url_filter.ORDER + 1}) as gram from (select id, by_rule, held, s, unnest(generate_series(1, length(s) - {url_filter.ORDER})) as i from said)),
counts as (select gram, count(*) filter (train = 'block') as r, count(*) filter (train = 'allow') as a from each group by gram),
{_orders()},
ratios as (select g as gram, round(1e6 * (ln(qr) - ln(qa)))::bigint as ratio from p{url_filter.ORDER}),
scores as (select id, floor(sum(ratio)::double / count(*) / 20000) as b from each join ratios using (gram) group by id),
hist as (select b, count(*) filter (by_rule = 'block') as r, count(*) filter (by_rule = 'allow') as a from said join scores using (id) where by_rule is not null and held group by b),
errors as (select b, coalesce(sum(r) over (order by b rows between unbounded preceding and 1 preceding), 0) * (sum(a) over ()) + (sum(a) over (order by b rows between current row and unbounded following)) * (sum(r) over ()) as error, sum(a) over () * sum(r) over () as both_classes from hist),
least as (select b from errors where both_classes > 0 and (select count(distinct by_rule) from said where not held) = 2 order by error, b limit 1)
select page_id, host, path, rule, coalesce(by_rule, case when s.b >= (select b from least) then 'block' else 'allow' end) as verdict from said join scores s using (id)""",
}
