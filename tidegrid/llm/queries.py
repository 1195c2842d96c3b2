"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, hard_negatives, jaccard, line_spread, mixing, pitman_yor, prefix_trie, quality, sharding, suffix_dedup, toxicity, warc
from .common import materialise, table


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    n_hit = decontamination.hit_words(F.col("spans"))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP9_SQL = r"""
with d as (
  select row_number() over () as r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from documents),
b as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') as w
  from benchmark),
bw as (
  select distinct item_id, least(len(w), 10) as l,
         unnest([array_to_string(w[i : i + least(len(w), 10) - 1], ' ') for i in range(1, len(w) - least(len(w), 10) + 2)]) as gram
  from b where len(w) > 0),
dw as (
  select r, l, s, array_to_string(w[s : s + l - 1], ' ') as gram
  from (select r, w, l, unnest(range(1, len(w) - l + 2)) as s from d, (select distinct l from bw) where len(w) >= l)),
hits as (select r, dw.l, s, item_id from dw join bw on dw.gram = bw.gram and dw.l = bw.l),
words as (select r, count(distinct p) as n from (select r, unnest(range(s, s + l)) as p from (select distinct r, s, l from hits)) group by r),
items as (select r, count(*) as n, string_agg(cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from (select distinct r, item_id from hits) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(words.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(words.n, 0) > 0 as contaminated
from d left join words using (r) left join items using (r)
"""


def op1_quality_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = materialise(quality.facts(table(spark, sf_dir, "documents")), "line-facts")
    return quality.judge(known).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.col("removed_words").cast("long").alias("removed_words"))


OP1_SQL = r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, md5(coalesce(text, '')) as m, coalesce(source, '#none') as host,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w
  from documents),
base as (
  select r, doc_id, m, host, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
         cast(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols from d),
tri as (select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select r, w, unnest(range(1, len(w) - 1)) as i from d where len(w) > 2)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1),
rep as (select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from twice) group by r),
raw as (select r, m, host, doc_id, unnest(string_split(text, chr(10))) as line from d),
line as (select r, m, host, doc_id, line, regexp_extract_all(line, '[^\x20\x09-\x0D]+') as lw from raw where regexp_matches(line, '[^\x20\x09-\x0D]')),
dup as (select r, count(*) - count(distinct line) as n from line group by r),
norm as (
  select r, m, host, doc_id, len(lw) as words,
         regexp_replace(translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]+', '0', 'g') as key from line),
texts as (select host, key, m, min(id) as id, any_value(words) as words from (select r, host, key, m, coalesce(min(doc_id), 9223372036854775807) as id, sum(words) as words from norm group by r, host, key, m) group by host, key, m),
sizes as (select host, count(distinct m) as texts from base group by host),
over as (select host, key, n, first_m from (select host, key, count(*) as n, arg_min(m, (id, m)) as first_m from texts group by host, key) join sizes using (host) where n > least(1000.0, greatest(20.0, 0.005 * texts))),
removed as (select host, m, sum(words) as n from texts join over using (host, key) where m <> first_m group by host, m)
select doc_id, n_words, word_chars, n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
       n_words < 50 or 100 * coalesce(rep.n, 0) > 50 * n_words as base_failed,
       not (n_words < 50 or 100 * coalesce(rep.n, 0) > 50 * n_words) and not coalesce(removed.n, 0) > 0.5 * n_words as kept,
       cast(coalesce(removed.n, 0) as bigint) as removed_words
from base left join dup using (r) left join rep using (r) left join removed using (host, m)
"""


def op4_mixing_water_filling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), 'null')), 1, 12) as bigint) as draw
  from documents),
b as (select *, draw // 68719476736 as bin, (draw % 68719476736) // 16777216 as fine from d),
s as (select source, cast(sum(size) as bigint) as source_size from b group by source),
w as (select *, cast([1, 2, 3][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as weight from s),
c as (select *, 3.0::double * source_size as cap, 3.0::double * source_size / weight as ratio from w),
t as (
  select *, sum(source_size::double) over () as total, sum(weight) over () as all_weight,
         sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and current row) as capped,
         coalesce(sum(weight) over (order by ratio, source nulls last rows between 1 following and unbounded following), 0) as open from c),
l as (select *, case when open > 0 and (total - capped) / open >= ratio then (total - capped) / open end as level from t),
g as (select coalesce((select arg_max(level, (capped, level)) from l where level is not null), (select any_value(total / all_weight) from l)) as level),
p as (
  select source as s, source_size, least(cap, weight * g.level) as target from l, g),
q as (select *, floor(case when source_size > 0 then target / source_size else 0 end) as whole from p),
q2 as (select *, target - whole * source_size as part from q),
bins as (select source, bin, sum(size) as size from b group by source, bin),
low as (select *, coalesce(sum(size) over (partition by source order by bin rows between unbounded preceding and 1 preceding), 0) as low from bins),
edge as (select source, bin, low, part from low join q2 on source is not distinct from s where low <= part and part < low + size),
inner_bins as (select b.source, b.bin, b.fine, e.low, e.part, sum(b.size) as size from b join edge e on b.source is not distinct from e.source and b.bin = e.bin group by all),
gaps as (select *, abs(low + sum(size) over (partition by source order by fine rows between unbounded preceding and current row) - part) as gap from inner_bins),
best as (select source as cs, bin, min((gap, fine)) as x, any_value(part - low) as none from gaps group by source, bin),
cuts as (select cs, bin * 68719476736 + case when none <= x[1] then 0 else (x[2] + 1) * 16777216 end as cut from best)
select doc_id, size, source_size, target, cast((whole + case when draw < coalesce(cut, 0) then 1 else 0 end) * size as bigint) as taken
from b join q2 on source is not distinct from s left join cuts on source is not distinct from cs
"""


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(table(spark, sf_dir, "documents"))


OP7_SQL = r"""
with recursive d as (
  select row_number() over () as r, doc_id, md5(array_to_string(w, ' ')) as m, w
  from (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)),
rep as (select m, min(doc_id) as id, any_value(w) as w from d where len(w) > 0 group by m),
sh as (select distinct id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') as g from (select id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from rep)),
n as (select id, count(*) as n from sh group by id),
rare as (select g from sh group by g having count(*) > 1),
shared as (select id, g from sh semi join rare using (g)),
pair as (select x.id as a, y.id as b, count(*) as both from shared x join shared y on x.g = y.g and x.id < y.id group by x.id, y.id),
link as (select a, b from pair join n p on p.id = a join n q on q.id = b where 100 * "both" >= 80 * (p.n + q.n - "both")),
edge as (select a, b from link union select b, a from link),
reach(id, other) as (select id, id from rep union select reach.id, edge.b from reach join edge on reach.other = edge.a),
comp as (select id, min(other) as component_id from reach group by id)
select doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, coalesce(component_id, doc_id) as component_id
from d left join rep using (m) left join n on n.id = rep.id left join comp on comp.id = rep.id
"""


def op8_sharding_bin_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = sharding.shard(table(spark, sf_dir, "documents"), 40)
    return s.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_warc_zip_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, archives = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(encode(coalesce(html, ''))) as payload_digest from pages),
f as (select payload_digest, max(page_id) as first from p where payload_bytes >= 1000 group by payload_digest)
select page_id, cast(payload_bytes as bigint) as payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to
from p left join f using (payload_digest)
"""


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = F.lit("<|im_end|><|im_start|>assistant ok")
    turn = lambda k, role: F.struct(F.lit(-1).alias("conv_id"), F.lit(k).alias("turn"), F.lit(role).alias("role"), probe.alias("text"))
    probes = spark.range(1).select(F.inline(F.array(turn(0, "user"), turn(1, "assistant")))).select(*(F.col(n).cast(t) for n, t in rows.dtypes))
    rows = rows.unionByName(probes)
    # Rows come in three layouts by turn, so that fingerprints have something to tell apart.
    ways = [("role", "text"), ("role", "content"), ("from", "value")]
    wrap = lambda way: F.to_json(F.struct(F.col("role").alias(way[0]), F.col("text").alias(way[1])), {"ignoreNullFields": "false"})
    layout = F.pmod(F.coalesce(F.col("turn"), F.lit(0)), F.lit(3))
    record = F.when(layout == 0, wrap(ways[0])).when(layout == 1, wrap(ways[1])).otherwise(wrap(ways[2]))
    made = chat.conversations(chat.canonical(rows.select("conv_id", "turn", record.alias("record"))))
    back = made.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn("learned", chat.cut(F.col("formatted"), chat.loss_spans(F.col("pieces"))))
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP5_SQL = r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e as (select *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '<|nl|>')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 as chars from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
       sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn nulls first, role, text), '')) as loss_sha256,
       cast(sum(chars) as bigint) as formatted_chars
from e group by conv_id
"""


def op6_line_site_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove(table(spark, sf_dir, "documents"), 10)
    return out.select("doc_id", "n_lines", "n_removed", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("kept_md5"))


OP6_SQL = r"""
with d as (select row_number() over () as r, doc_id, source, text from documents),
raw as (select r, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from d),
l as (select *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) as key from raw),
b as (select key from l where key <> '' group by key having count(distinct source) >= 10),
k as (select l.*, b.key is not null as gone from l left join b using (key))
select any_value(d.doc_id) as doc_id, count(*) filter (key <> '') as n_lines, count(*) filter (gone) as n_removed, md5(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_md5
from d left join k using (r) group by r
"""


def op3_toxicity_noisy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op10_lm_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(table(spark, sf_dir, "conversations")))


OP11_SQL = """
with recursive crc(i, k, c) as (
  select i, 0, i::bigint from range(256) t(i)
  union all select i, k + 1, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end from crc where k < 8),
tab as (select list(c order by i) as t from crc where k = 8),
t as (
  select conv_id, turn, octet_length(encode(coalesce(text, ''))) as size,
         substr(sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) as key
  from conversations where conv_id is not null),
own as (select conv_id, conv_id - conv_id % 5 as base, list(key order by turn nulls first, key, size) as ks, list(size order by turn nulls first, key, size) as ss from t group by conv_id),
h as (
  select own.*, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295) % 9 as h
  from own, tab),
seq as (
  select h.conv_id, list_concat(coalesce(b.ks[1 : h.h], []), h.ks[h.h + 1 :]) as ks, list_concat(coalesce(b.ss[1 : h.h], []), h.ss[h.h + 1 :]) as ss
  from h left join own b on b.conv_id = h.base),
pre as (select conv_id, len(ks) as n, d, array_to_string(ks[1 : d], '') as path, case when d > 0 then ss[d] else 0 end as size from (select *, unnest(range(0, len(ks) + 1)) as d from seq)),
node as (
  select path, d, min(conv_id) as conv_id, count(*) as n, any_value(size) as size, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = d), '')) as ends
  from pre group by path, d),
kids as (select substr(path, 1, 32 * (d - 1)) as path, d - 1 as d, count(*) as kids from node where d > 0 group by all),
known as (select node.*, coalesce(kids, 0) as kids from node left join kids using (path, d)),
sums as (
  select substr(path, 1, 32 * k) as path, k as d, count(*) filter (kids = 0) as leaves, sum((n - 1) * size) as saved
  from (select *, unnest(range(0, d + 1)) as k from known) group by all)
select known.conv_id, known.d as depth, up.conv_id as parent_conv_id, known.n as n_convs, known.kids as n_children, cast(leaves as bigint) as n_leaves, cast(saved as bigint) as saved_tokens, known.ends as ends_sha256
from known join sums using (path, d) left join node up on known.d > 0 and up.d = known.d - 1 and up.path = substr(known.path, 1, 32 * (known.d - 1))
"""


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), 50)
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP12_SQL = """
with d as (select row_number() over () as r, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select r, doc_id, s, substr(h, 2 * s + 1, 100) as g from (select *, unnest(range(0, len(h) // 2 - 49)) as s from d)),
m as (select g, min(doc_id) as m from w group by g),
hit as (select r, s from w join m using (g) where m < coalesce(doc_id, 9223372036854775807)),
step as (select *, case when s <= lag(s) over (partition by r order by s) + 50 then 0 else 1 end as new from hit),
island as (select *, sum(new) over (partition by r order by s) as k from step),
span as (select r, min(s) as a, max(s) + 50 as b from island group by r, k),
part as (select r, a, b, coalesce(lag(b) over (partition by r order by a), 0) as z from span),
kept as (
  select r, sum(b - a) as gone, count(*) as n, string_agg(substr(h, 2 * z + 1, 2 * (a - z)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) as h
  from part join d using (r) group by r)
select doc_id, cast(len(d.h) // 2 as bigint) as n_bytes, cast(coalesce(gone, 0) as bigint) as n_removed, cast(coalesce(n, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join kept using (r)
"""


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


OP13_SQL = """
with e as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label::bigint + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select * from e where vec_id % 50 = 0),
s as (
  select a.r as ar, a.vec_id as anchor_id, a.label = e.label as same, e.vec_id as id, e.r as er, cast(list_inner_product(a.v, e.v) as bigint) as score
  from a join e on a.r <> e.r),
p as (select ar, anchor_id, id as positive_id, er, score as positive_score from s where same qualify row_number() over (partition by ar order by score desc, id) <= 5),
n as (
  select p.anchor_id, p.positive_id, row_number() over (partition by p.ar, p.er order by s.score desc, s.id) as rank, s.id as negative_id, positive_score, s.score as negative_score
  from p join s on p.ar = s.ar and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score)
select anchor_id, positive_id, cast(rank as integer) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


QUERIES = {
    "op1_quality_line_frequency": op1_quality_line_frequency,
    "op2_warc_zip_reader": op2_warc_zip_reader,
    "op3_toxicity_noisy_channel": op3_toxicity_noisy_channel,
    "op4_mixing_water_filling": op4_mixing_water_filling,
    "op5_chat_formatting": op5_chat_formatting,
    "op6_line_site_spread": op6_line_site_spread,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_sharding_bin_packing": op8_sharding_bin_packing,
    "op9_benchmark_decontamination": op9_benchmark_decontamination,
    "op10_lm_pitman_yor": op10_lm_pitman_yor,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}
ORACLES = {
    "op1_quality_line_frequency": OP1_SQL,
    "op2_warc_zip_reader": OP2_SQL,
    "op4_mixing_water_filling": OP4_SQL,
    "op5_chat_formatting": OP5_SQL,
    "op6_line_site_spread": OP6_SQL,
    "op7_ngram_jaccard_join": OP7_SQL,
    "op9_benchmark_decontamination": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_suffix_dedup": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
