"""Registered queries that find a code or a check sum blind; their SQL knows what was sent."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment, bits, blind_codes, blind_frames, blind_sums, codes, framing, gf2, parity_codes
from .catalogue import SIGNS, query, r, signs, table
from .coding import _CRC, _SUM


# Matrices over GF(2)

_STEPS = """
e(id, width, c, k, x) as (
  select id, width, 0, 0, x from m
  union all
  select id, width, c + 1, k + (p > 0)::int,
         case when p = 0 then x else [case when i = k + 1 then x[p] when ((case when i = p then x[k + 1] else x[i] end) >> (width - 1 - c)) & 1 = 1 then xor(case when i = p then x[k + 1] else x[i] end, x[p]) else case when i = p then x[k + 1] else x[i] end end for i in range(1, len(x) + 1)] end
  from (select *, coalesce(list_min([i for i in range(k + 1, len(x) + 1) if (x[i] >> (width - 1 - c)) & 1 = 1]), 0) as p from e where c < width)),
done as (select * from e where c = width)"""


@query(f"""
with recursive {SIGNS}, m as (select vec_id as id, 8 as width, [list_sum([b[8 * i + j + 1] << (7 - j) for j in range(8)])::int for i in range(len(b) // 8)] as x from v), {_STEPS},
p as (select id, k, x[: k] as x, [7 - (len(bin(y)) - 1) for y in x[: k]] as lead from done)
select id as vec_id, k as rank, array_to_string(x, ',') as reduced,
       array_to_string([(1 << (7 - f)) + coalesce(list_sum([case when (x[i] >> (7 - f)) & 1 = 1 then 1 << (7 - lead[i]) else 0 end for i in range(1, k + 1)]), 0)::int for f in range(8) if not list_contains(lead, f)], ',') as null_vectors
from p""")
def gf2_rref(spark, d):
    """The sign bits of a vector as eight rows of eight: reduced form, rank and null space."""
    rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("b") / 8).cast("int") - 1), lambda i: F.aggregate(F.slice("b", 8 * i + 1, 8), F.lit(0).cast("long"), lambda a, x: 2 * a + x))
    out = gf2.row_echelon(signs(spark, d).select("vec_id", rows.alias("m")), "m", 8)
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select("vec_id", "rank", text("reduced").alias("reduced"), text("null_vectors").alias("null_vectors"))


@query(f"with recursive {SIGNS}, m as (select vec_id as id, w::int as width, [list_sum([b[w * i + j + 1] << (w - 1 - j) for j in range(w)])::int for i in range(len(b) // w)] as x from (select *, unnest(range(2, 11)) as w from v)), {_STEPS} select id as vec_id, width, len(x) as rows, k as rank from done")
def gf2_rank_profile(spark, d):
    """The rank of a stream's windows, side by side, over their width."""
    from functools import reduce

    def at(width):
        rows = F.transform(F.sequence(F.lit(0), F.floor(F.size("b") / width).cast("int") - 1), lambda i: F.aggregate(F.slice("b", width * i + 1, width), F.lit(0).cast("long"), lambda a, x: 2 * a + x))
        out = gf2.row_echelon(s.select("vec_id", rows.alias("m")), "m", width)
        return out.select("vec_id", F.lit(width).alias("width"), F.size("m").cast("long").alias("rows"), "rank")

    s = signs(spark, d)
    return reduce(lambda a, b: a.unionByName(b), map(at, range(2, 11)))


# Convolutional codes

#: What the test streams are coded with: constraint and generators, newest bit highest.
PLANTED = ((3, (0o7, 0o5)), (5, (0o23, 0o35)), (7, (0o171, 0o133)), (4, (0o13, 0o15, 0o17)), (5, (0o25, 0o33, 0o37)), (5, (0o25, 0o27, 0o33, 0o37)))
_PLANTED = ", ".join(f"({c}, {len(g)}, {k}, {list(g)}, '{','.join(f'{x:o}' for x in g)}')" for c, (k, g) in enumerate(PLANTED))


def coded_streams(spark, d):
    """(stream, soft): the sign bits of 16 vectors each, coded, begun late, some inverted, one bit in 97 turned and unsure."""
    g = signs(spark, d).groupBy(F.floor(F.col("vec_id") / 16).alias("stream")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "b"))).alias("rows"))
    g = g.select("stream", F.flatten(F.transform("rows", lambda x: x["b"])).alias("u"))
    sent = late = None
    for c, code in enumerate(PLANTED):
        here = F.col("stream") % len(PLANTED) == c
        sent = F.when(here, codes.encode(F.col("u"), code)) if sent is None else sent.when(here, codes.encode(F.col("u"), code))
        late = F.when(here, F.col("stream") % len(code[1])) if late is None else late.when(here, F.col("stream") % len(code[1]))
    g = g.select("stream", sent.alias("c"), late.cast("int").alias("late")).select("stream", F.slice("c", F.col("late") + 1, F.size("c")).alias("c"))
    way = F.when(F.col("stream") % 4 == 3, -1.0).otherwise(1.0)
    return g.select("stream", F.transform("c", lambda c, i: way * (1.0 - 2.0 * c) * (1.0 + (i % 7) / 10) * F.when(i % 97 == 50, -0.1).otherwise(1.0)).alias("soft"))


@query(f"""
with {SIGNS}, codes(c, n, k, gs, name) as (values {_PLANTED}),
u as (select vec_id // 16 as g, flatten(list(b order by vec_id)) as u from v group by 1),
e as (select g, n, k, gs, name, flatten([[list_sum([case when i > d and (gs[q] >> (k - 1 - d)) & 1 = 1 then u[i - d] else 0 end for d in range(k)])::int % 2 for q in range(1, n + 1)] for i in range(1, len(u) + 1)]) as c from u join codes on c = g % {len(PLANTED)}),
y as (select g, n, k, gs, name, (n - g % n) % n as start, [(c[i + 1 + g % n] + (g % 4 = 3)::int + (i % 97 = 50)::int) % 2 for i in range(len(c) - g % n)] as y from e),
p as (select *, (len(y) - start - b + n - 1) // n // k as windows, (bit_count(gs[1]::bigint) + bit_count(gs[b + 1]::bigint)) % 2 = 1 as odd from (select *, unnest(range(1, n)) as b from y)),
f as (select *, list_sum([list_sum([((gs[b + 1] >> (k - 1 - d)) & 1) * y[start + n * (j * k + k - 1 - d) + 1] + ((gs[1] >> (k - 1 - d)) & 1) * y[start + n * (j * k + k - 1 - d) + b + 1] for d in range(k)])::int % 2 for j in range(windows)])::bigint as bad from p),
w as (select g, n, k, name, start, odd, windows, case when odd then least(bad, windows - bad) else bad end as failed from f),

q as (select g, n, k, name, start, bool_or(odd) as odd, arg_max(failed, (failed, -windows)) as failed, arg_max(windows, (failed, -windows)) as windows from w group by g, n, k, name, start),
l as (select *, (select log10(sum(exp(lgamma(windows + 1) - lgamma(i + 1) - lgamma(windows - i + 1) - windows * ln(2)))) from (select unnest(range(failed + 1)) as i)) as log10_p from q)
select g as stream, n as outputs, start::int as start, k as "constraint", name as generators, odd and g % 4 = 3 as inverted, odd as polarity_known, windows, failed, round(log10_p, 4) as log10_p
from l where log10_p <= log10(1e-6 / 360)""")
def conv_identify(spark, d):
    """Names each stream's code, where its blocks start and its polarity."""
    found = blind_codes.identify(blind_codes.ledger(coded_streams(spark, d), "stream", "soft"), "stream")
    return found.withColumn("log10_p", r(F.col("log10_p"), 4))


# Check sums

#: The sets that the test frames end with.
SENT = (0, 1, 7, 12, 16, 17, 24, 25, 29)
_SENT_FRAMES = f"""
{_CRC}, n as (select user_id, event_id, row_number() over (partition by user_id order by event_id) - 1 as n from events),
chosen as (select spec.*, crcs.poly, row_number() over (order by place) - 1 as i from spec join crcs using (place) where place in {SENT})"""


def summed_frames(spark, d):
    """(user_id, n, data): sixteen bytes and a sum that depends on the user; one event in 37 is damaged."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").select("user_id", "event_id", (F.row_number().over(w) - 1).alias("n"), F.unhex(F.md5(F.concat_ws("-", "event_id", "user_id").cast("binary"))).alias("p"))
    data, end = framing.octets(F.col("p")), None
    for i, place in enumerate(SENT):
        c = framing.CRCS[place]
        here, text = F.col("user_id") % len(SENT) == i, F.lpad(F.hex(framing.crc_of(data, c)), c.width // 4, "0")
        end = F.when(here, text) if end is None else end.when(here, text)
    whole = F.concat(F.hex("p"), end)
    first = F.lpad(F.hex(F.conv(F.substring(whole, 1, 2), 16, 10).cast("long").bitwiseXOR(F.lit(1))), 2, "0")
    return e.select("user_id", "n", F.unhex(F.when(F.col("event_id") % 37 == 5, F.concat(first, F.substring(whole, 3, 64))).otherwise(whole)).alias("data"))


@query(f"""
with {_SENT_FRAMES},
c as (select user_id, count(*) filter (n % 2 = 0) as fitted, count(*) filter (n % 2 = 1) as heldout, count(*) filter (n % 2 = 1 and event_id % 37 <> 5) as passes from n group by 1),
z as (select crc, {_SUM.format('[0 for i in range(16)]::bigint[]')} as zero, xorout, refout as r, width as w from chosen, mirror),
x as (select c.*, s.*, [lgamma(heldout + 1) - lgamma(j + 1) - lgamma(heldout - j + 1) - j * width * ln(2) + (heldout - j) * ln(1 - power(2.0, -width)) for j in range(passes, heldout + 1)] as x from c join chosen s on s.i = c.user_id % {len(SENT)}),
l as (select *, (list_max(x) + ln(list_sum([exp(y - list_max(x)) for y in x]))) / ln(10) as log10_p from x)
select l.user_id, (16 + l.width // 8)::int as bytes, l.width, l.refin, l.refout, l.poly::bigint as poly, xor(z.zero, case when r then list_sum([((z.xorout >> k) & 1) << (w - 1 - k) for k in range(w)])::bigint else z.xorout end) as constant, fitted, heldout, passes, round(log10_p, 4) as log10_p, l.crc
from l join z using (crc)""")
def crc_recover(spark, d):
    """Finds width, generator, orders and constant of each user's sum, and the published set that has them."""
    return blind_sums.recover(summed_frames(spark, d), "user_id", "n", "data").withColumn("log10_p", r(F.col("log10_p"), 4))


# Parity-check codes


_TC = parity_codes.telecommand(128)
_TM = parity_codes.telemetry("1/2")


def _masks(code) -> list[int]:
    """For each parity bit the message bits that it sums, the first bit highest."""
    return [int("".join(map(str, column)), 2) for column in parity_codes.parity_map(code).T]


_WORD = "w as (select vec_id, b, list_concat(b, [bit_count((list_sum([b[i + 1]::hugeint << (63 - i) for i in range(64)]) & m)::hugeint)::int % 2 for m in MASKS]) as c from v)".replace("MASKS", f"[{', '.join(f'{m}::hugeint' for m in _masks(_TC))}]")


def coded_words(spark, d):
    """(vec_id, b, code): the 64 sign bits of a vector as a message of the (128, 64) code."""
    x = signs(spark, d)
    return x.join(parity_codes.encoded(x, "vec_id", "b", _TC), "vec_id")


def text(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), "")


@query(f"with {SIGNS}, {_WORD} select vec_id, array_to_string(c, '') as code from w")
def ldpc_encode(spark, d):
    return coded_words(spark, d).select("vec_id", text(F.col("code")).alias("code"))


@query(f"with {SIGNS}, {_WORD}, e(c, x) as (values {', '.join(map(str, _TC.edges))}), s as (select vec_id, e.c, sum((w.c[x + 1] + (x % 29 = 7)::int) % 2) % 2 as bad from w, e group by 1, 2) select vec_id, count(*) as checks, sum(bad)::bigint as failed, round(avg(bad), 6) + 0.0 as rate from s group by 1")
def ldpc_rate(spark, d):
    """The share of failed checks of code words of which one bit in 29 is turned."""
    spoilt = coded_words(spark, d).select("vec_id", F.posexplode(F.transform("code", lambda c, i: (c + F.when(i % 29 == 7, 1).otherwise(0)) % 2)).alias("pos", "bit"))
    edges = parity_codes.edge_table(spark, (_TC,)).select("check", "var")
    p = codes.parity_checks(spoilt, "vec_id", "pos", "bit", edges)
    return p.groupBy("vec_id").agg(F.count("*").alias("checks"), F.sum("parity").cast("long").alias("failed"), r(F.avg("parity")).alias("rate"))


@query(f"with {SIGNS} select vec_id, array_to_string(b, '') as bits, true as holds from v")
def ldpc_decode(spark, d):
    """Code words with turned and erased bits decode to the messages they were made of."""
    soft = F.transform("code", lambda c, i: F.when(i % 31 == 3, 0.0).otherwise((1.0 - 2.0 * c) * (2.0 + (i % 5) / 5) * F.when(i % 37 == 30, -0.3).otherwise(1.0)))
    out = parity_codes.decoded(coded_words(spark, d).select("vec_id", soft.alias("soft")), "vec_id", "soft", _TC)
    return out.select("vec_id", text(F.col("bits")).alias("bits"), "holds")


def _grouped(x, size: int, column: str):
    """(stream, x): the arrays of so many consecutive vectors end to end; groups that are not full are left out."""
    g = x.groupBy(F.floor(F.col("vec_id") / size).alias("stream")).agg(F.sort_array(F.collect_list(F.struct("vec_id", column))).alias("rows"))
    return g.where(F.size("rows") == size).select("stream", F.flatten(F.transform("rows", lambda v: v[column])).alias("x"))


@query("select vec_id // 16 as stream, (vec_id // 16 * 37 % 128)::int as start, 4 as blocks from embeddings where vec_id // 16 % 5 < 4 group by 1 having count(*) = 16")
def ldpc_alignment(spark, d):
    """Finds where code words begin; every fifth stream is sign bits as they are, in which none is found."""
    late = (128 - F.col("stream") * 37 % 128) % 128
    coded = _grouped(coded_words(spark, d), 16, "code").where("stream % 5 < 4").select("stream", F.slice("x", late.cast("int") + 1, F.size("x")).alias("x"))
    x = coded.unionByName(_grouped(signs(spark, d), 16, "b").where("stream % 5 = 4"))
    soft = F.transform("x", lambda c, i: (1.0 - 2.0 * c) * (2.0 + (i % 7) / 5) * F.when(i % 41 == 13, -0.2).otherwise(1.0))
    return parity_codes.aligned(x.select("stream", soft.alias("soft")), "stream", "soft", _TC).select("stream", "start", "blocks")


@query("select vec_id // 64 as stream, ((2048 - vec_id // 64 * 501 % 2048) % 2048)::int as start, case when vec_id // 64 = 0 then 3 else 2 end as blocks from embeddings group by 1, 2, 3 having count(*) = 64")
def ldpc_alignment_punctured(spark, d):
    """As above for a code of which a fifth of the variables is never sent: four words of 2048 bits, begun late."""
    w = _grouped(signs(spark, d), 64, "b")
    parts = w.select("stream", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("x", k * 1024 + 1, 1024))).alias("k", "m")).withColumn("id", F.struct("stream", "k"))
    sent = parity_codes.encoded(parts, "id", "m", _TM).select("id.stream", "id.k", "code")
    g = sent.groupBy("stream").agg(F.sort_array(F.collect_list(F.struct("k", "code"))).alias("rows")).select("stream", F.flatten(F.transform("rows", lambda v: v["code"])).alias("x"))
    late = (F.col("stream") * 501 % 2048).cast("int")
    soft = F.transform(F.slice("x", late + 1, F.size("x")), lambda c, i: (1.0 - 2.0 * c) * (4.0 + (i % 7) / 5) * F.when(i % 97 == 13, -0.2).otherwise(1.0))
    return parity_codes.aligned(g.select("stream", soft.alias("soft")), "stream", "soft", _TM).select("stream", "start", "blocks")


# Interleavers

_K7 = "c as (select vec_id // 16 as g, flatten(list(b order by vec_id)) as u from v group by 1 having count(*) = 16), k as (select g, flatten([[" + ", ".join("(" + " + ".join(f"case when i > {d} then u[i - {d}] else 0 end" for d in codes.taps(g, 7)) + ") % 2" for g in codes.K7[1]) + "] for i in range(1, len(u) + 1)]) as c from c)"
#: Rows and columns of the test interleaver, lanes and their step.
_ROWS, _COLUMNS_OF, _LANES, _STEP = 16, 24, 4, 2
_SIZE = _ROWS * _COLUMNS_OF
_RATE = "round(list_avg([(" + " + ".join([f"s[2 * (m - {d}) + 1]" for d in codes.taps(codes.K7[1][1], 7)] + [f"s[2 * (m - {d}) + 2]" for d in codes.taps(codes.K7[1][0], 7)]) + ") % 2 for m in range(6, len(s) // 2)]), 6) + 0.0 as rate"


def _coded(spark, d):
    return _grouped(signs(spark, d), 16, "b").select("stream", codes.encode(F.col("x")).alias("c"))


@query(f"""
with {SIGNS}, {_K7},
y as (select g, [(c[(t + g * 7 % {_SIZE}) // {_SIZE} * {_SIZE} + ((t + g * 7) % {_SIZE} % {_ROWS}) * {_COLUMNS_OF} + (t + g * 7) % {_SIZE} // {_ROWS} + 1] + (t % 211 = 50)::int) % 2 for t in range(len(c) // {_SIZE} * {_SIZE} - g * 7 % {_SIZE})] as y, ({_SIZE} - g * 7 % {_SIZE}) % {_SIZE} as start from k),
z as (select g, start, [y[start + t // {_SIZE} * {_SIZE} + (t % {_SIZE} % {_COLUMNS_OF}) * {_ROWS} + t % {_SIZE} // {_COLUMNS_OF} + 1] for t in range((len(y) - {_SIZE} + 1) // {_SIZE} * {_SIZE})] as s from y)
select g as stream, start::int as start, 0 as phase, {_RATE} from z""")
def interleaver_start(spark, d):
    """Coded streams, written by rows and read by columns, begun late: where do blocks begin?"""
    x = _coded(spark, d).select("stream", bits.permuted(F.col("c"), _SIZE, lambda j: (j % _ROWS) * _COLUMNS_OF + F.floor(j / _ROWS)).alias("y"))
    late = (F.col("stream") * 7 % _SIZE).cast("int")
    soft = F.transform(F.slice("y", late + 1, F.size("y")), lambda c, i: (1.0 - 2.0 * c) * F.when(i % 211 == 50, -1.0).otherwise(1.0))
    at = np.arange(_SIZE)
    source = (at % _COLUMNS_OF) * _ROWS + at // _COLUMNS_OF
    out = alignment.block_start(x.select("stream", soft.alias("soft")), "stream", "soft", source)
    return out.withColumn("rate", r(F.col("rate")))


@query(f"""
with {SIGNS}, {_K7},
y as (select g, g % 7 as late, [((case when t + g % 7 >= (t + g % 7) % {_LANES} * {_LANES * _STEP} then c[t + g % 7 - (t + g % 7) % {_LANES} * {_LANES * _STEP} + 1] else 0 end) + (t % 211 = 50)::int) % 2 for t in range(len(c) - g % 7)] as y from k),
z as (select g, late, [y[t - ({_LANES} - 1 - (t + late) % {_LANES}) * {_LANES * _STEP} + 1] for t in range({(_LANES - 1) * _LANES * _STEP}, len(y))][late % 2 + 1 :] as s from y),
o as (select g, late, s[: least(2048, len(s) + late % 2 - 1)] as s from z)
select g as stream, (late % {_LANES})::int as lane, (late % 2)::int as phase, {_RATE} from o""")
def lane_start(spark, d):
    """Coded streams over delayed lanes, begun late: which lane comes first?"""
    at = lambda t: t - (t % _LANES) * (_LANES * _STEP)
    x = _coded(spark, d).select("stream", F.transform("c", lambda _, t: F.when(at(t) >= 0, F.get("c", at(t).cast("int"))).otherwise(0)).alias("y"))
    soft = F.transform(F.slice("y", (F.col("stream") % 7).cast("int") + 1, F.size("y")), lambda c, i: (1.0 - 2.0 * c) * F.when(i % 211 == 50, -1.0).otherwise(1.0))
    out = alignment.lane_start(x.select("stream", soft.alias("soft")), "stream", "soft", _LANES, _STEP)
    return out.withColumn("rate", r(F.col("rate")))


# Reed-Solomon streams


def _rs_words(spark, d):
    """(doc_id, words): each text that fills four blocks of 223 bytes, every block with its check bytes; bytes 7, 57, 107 ... of odd words are changed."""
    import pandas as pd

    def add(batches):
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.iloc[first : first + 256]
                blocks = [np.frombuffer(x, np.uint8)[: len(x) // 223 * 223].reshape(-1, 223) for x in part["data"]]
                data, at = np.concatenate(blocks), np.concatenate([np.arange(len(x)) for x in blocks])
                words = np.concatenate([data, codes.rs_parity(data, codes.roots()).astype(np.uint8)], axis=1)
                words[np.ix_(at % 2 == 1, np.arange(7, 255, 50))] ^= 0x5A
                ends = np.cumsum([len(x) for x in blocks])[:-1]
                yield pd.DataFrame({"doc_id": part["doc_id"], "words": [x.tobytes() for x in np.split(words, ends)]})

    t = table(spark, d, "documents").where(F.octet_length("text") >= 892).select("doc_id", F.encode("text", "UTF-8").alias("data"))
    return t.mapInPandas(add, "doc_id long, words binary")


@query("select doc_id, ((2040 - doc_id * 37 % 2040) % 2040)::int as start from documents where octet_length(encode(text)) >= 892")
def rs_stream(spark, d):
    """Streams of code words, begun late by some bits: where does a word begin?"""
    import pandas as pd

    @F.pandas_udf("binary")
    def begun(words: pd.Series, late: pd.Series) -> pd.Series:
        return pd.Series([np.packbits(np.unpackbits(np.frombuffer(w, np.uint8))[k:]).tobytes() for w, k in zip(words, late)])

    late = F.col("doc_id") * 37 % 2040
    x = _rs_words(spark, d).select("doc_id", begun("words", late).alias("bits"), (8 * F.octet_length("words") - late).alias("count"))
    return alignment.word_start(x, "doc_id", "bits", count="count")


@query("select doc_id, (1 + doc_id % 3)::int as depth, (octet_length(encode(text)) // 223 // (1 + doc_id % 3) * (1 + doc_id % 3))::int as words from documents where octet_length(encode(text)) >= 892")
def rs_depth(spark, d):
    """Streams in which up to three code words take turns byte by byte: how many?"""
    import pandas as pd

    @F.pandas_udf("binary")
    def mixed(words: pd.Series, depth: pd.Series) -> pd.Series:
        out = []
        for w, k in zip(words, depth):
            data = np.frombuffer(w, np.uint8)
            n = len(data) // (255 * k)
            out.append(data[: n * 255 * k].reshape(n, k, 255).transpose(0, 2, 1).tobytes())
        return pd.Series(out)

    x = _rs_words(spark, d).select("doc_id", mixed("words", 1 + F.col("doc_id") % 3).alias("data"))
    return alignment.interleave_depth(x, "doc_id", "data")


# Frames

#: The test frames: sync word, counter, a constant byte, the sign bits of a vector.
_FRAME_WORD, _FRAME_BYTE, _FRAME_BITS = 0x1ACFFC1D, 0xA7, 120


def framed_streams(spark, d):
    """(rec, n, x): 128 frames for each 128 vectors, begun late, one bit in 211 turned."""
    fixed = lambda value, width: F.array(*(F.lit(value >> (width - 1 - k) & 1) for k in range(width)))
    count = F.transform(F.sequence(F.lit(15), F.lit(0), F.lit(-1)), lambda k: F.call_function("shiftright", F.col("vec_id") % 128, k).bitwiseAND(F.lit(1)).cast("int"))
    v = signs(spark, d).select("vec_id", F.concat(fixed(_FRAME_WORD, 32), count, fixed(_FRAME_BYTE, 8), "b").alias("f"))
    s = _grouped(v, 128, "f").select(F.col("stream").alias("rec"), F.posexplode(F.slice("x", (F.col("stream") * 17 % _FRAME_BITS).cast("int") + 1, F.size("x"))).alias("n", "bit"))
    return s.select("rec", F.col("n").cast("long").alias("n"), (1 - 2 * ((F.col("bit") + F.when(F.col("n") % 211 == 50, 1).otherwise(0)) % 2)).alias("x"))


_FRAMED = f"""
{SIGNS}, f as (select vec_id // 128 as g, vec_id, list_concat([({_FRAME_WORD} >> (31 - k)) & 1 for k in range(32)], [(vec_id % 128 >> (15 - k)) & 1 for k in range(16)], [({_FRAME_BYTE} >> (7 - k)) & 1 for k in range(8)], b) as f from v),
s as (select g, flatten(list(f order by vec_id)) as x from f group by 1 having count(*) = 128),
y as (select g, [(x[i + 1 + g * 17 % {_FRAME_BITS}] + (i % 211 = 50)::int) % 2 for i in range(len(x) - g * 17 % {_FRAME_BITS})] as y, ({_FRAME_BITS} - g * 17 % {_FRAME_BITS}) % {_FRAME_BITS} as start from s)"""


@query(f"""
with {_FRAMED},
r as (select g, start, len(y) // {_FRAME_BITS} as rows, unnest(range(len(y) // {_FRAME_BITS} // 2, len(y) // {_FRAME_BITS})) as row, y from y),
e as (select g, start, rows, row, list_sum([(y[row * {_FRAME_BITS} + (start + k) % {_FRAME_BITS} + 1] <> ({_FRAME_WORD} >> (31 - k)) & 1)::int for k in range(32)]) as errors from r)
select g as rec, {_FRAME_BITS} as period, start, lpad(bin({_FRAME_WORD}), 32, '0') as word, rows, count(*) as held, count(*) filter (errors <= 4) as hits from e group by all""")
def blind_sync(spark, d):
    """Frame length and sync word of streams of which nothing is known."""
    out = blind_frames.sync(framed_streams(spark, d))
    return out.select("rec", F.col("period").cast("int").alias("period"), F.col("start").cast("long").alias("start"), text(F.col("word")).alias("word"), "rows", "held", "hits")


@query("select vec_id // 128 as rec, 'counter 32 16 1,constant 48 8 167,variable 56 8 -' as fields from embeddings group by 1 having count(*) = 128")
def blind_fields(spark, d):
    """The fields behind the sync word: a counter, a constant, and where the payload begins."""
    from ..functions.shared import settled

    s = settled(framed_streams(spark, d))
    found = settled(blind_frames.sync(s))
    fields = blind_frames.header_fields(blind_frames.frames(s, found), found)
    one = lambda f: F.concat_ws(" ", f["kind"], f["start"], f["width"], F.coalesce(f["value"], f["step"]).cast("string"), F.when(f["kind"] == "variable", "-"))
    return fields.select("rec", F.array_join(F.transform("fields", one), ",").alias("fields"))


@query(f"with {_FRAMED}, l as (select *, unnest([24, 60, 119, 120, 121, 240, 479]) as lag from y) select g as rec, lag::bigint as lag, list_sum([(1 - 2 * y[i]) * (1 - 2 * y[i + lag]) for i in range(1, len(y) - lag + 1)])::bigint as r from l")
def lag_sums(spark, d):
    """Correlations of a stream with itself, from the transforms of its chunks."""
    return blind_frames.lag_sums(framed_streams(spark, d), 512, 2048).where(F.col("lag").isin(24, 60, 119, 120, 121, 240, 479))
