"""Registered queries of permutations, codes and framing, each with SQL that another engine can run."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bits, codes, framing
from .catalogue import ORACLES, QUERIES, SIGNS, USERS, permutation, query, r, signs, table, text_of, users

# Permutations and scramblers

_WIFI = "(3 * (j % 48 % 16) + j % 48 // 16)"
permutation("deinterleave_wifi", 48, bits.wifi(48, 4), f"2 * ({_WIFI} // 2) + ({_WIFI} + 48 - 16 * {_WIFI} // 48) % 2")


@query(f"with {SIGNS} select vec_id, array_to_string([case when t >= (3 - t % 4) * 8 then b[t - (3 - t % 4) * 8 + 2] else 0 end for t in range(len(b) - 1)], '') as bits from v")
def deinterleave_forney(spark, d):
    return signs(spark, d).select("vec_id", text_of(bits.delayed_lanes(F.col("b"), 4, 2, 1)).alias("bits"))


@query("with recursive s(pos, state) as (select 0, 255 union all select pos + 1, ((state << 1) & 255) | xor(xor(state >> 7, state & 1), xor((state >> 2) & 1, (state >> 4) & 1)) from s where pos < 254), k as (select list(state >> 7 order by pos) as x from s) select vec_id, array_to_string([x[(vec_id * len(embedding) + i) % 255 + 1] for i in range(len(embedding))], '') as bits from embeddings, k")
def lfsr_sequence(spark, d):
    """The stretch of a running scrambler's sequence that belongs to each vector of a stream."""
    sequence = bits.numbers(bits.register_bits((8, 7, 5, 3), 0xFF, 255), "int")
    at = lambda i: ((F.col("vec_id") * F.size("embedding") + i) % 255).cast("int")
    return table(spark, d, "embeddings").select("vec_id", text_of(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: F.get(sequence, at(i)))).alias("bits"))


@query(f"with recursive s(pos, state) as (select 0, 255 union all select pos + 1, ((state << 1) & 255) | xor(xor(state >> 7, state & 1), xor((state >> 2) & 1, (state >> 4) & 1)) from s where pos < 254), k as (select list(state >> 7 order by pos) as x from s), {SIGNS} select vec_id, array_to_string([xor(b[i], x[(i - 1) % 255 + 1]) for i in range(1, len(b) + 1)], '') as bits from v, k")
def descramble_additive(spark, d):
    return signs(spark, d).select("vec_id", text_of(bits.whitened(F.col("b"), (8, 7, 5, 3), 0xFF, 255)).alias("bits"))


@query("with x as (select vec_id, embedding as e from embeddings), p as (select vec_id, e, unnest(range(len(e))) as i from x), q as (select vec_id, ((i + 1) // 4) * 6 + [0, 1, 3, 4][(i + 1) % 4 + 1] as pos, e[i + 1]::double as llr from p), n as (select vec_id, (max(pos) + 2) // 2 * 2 as n from q group by 1), a as (select vec_id, unnest(range(n)) as pos from n) select a.vec_id, a.pos, round(coalesce(llr, 0), 6) + 0.0 as llr from a left join q on q.vec_id = a.vec_id and q.pos = a.pos")
def depuncture(spark, d):
    x = table(spark, d, "embeddings").select("vec_id", codes.depunctured(F.col("embedding").cast("array<double>"), codes.PUNCTURES["3/4"], 1).alias("x"))
    return x.select("vec_id", F.posexplode("x").alias("pos", "llr")).select("vec_id", F.col("pos").cast("long").alias("pos"), r(F.col("llr")).alias("llr"))


@query(f"with {SIGNS}, s as (select vec_id, unnest(range(2, 17)) as stride, unnest(range(2, 17)) - 1 as top, b from v), t as (select vec_id, stride, unnest(range(2)) as phase, b from s), w as (select stride, phase, xor(b[i], b[i + stride]) as x from (select stride, phase, b, unnest(range(phase + 1, len(b) - stride + 1, 2)) as i from t)) select stride, phase, count(*) as checks, round((0.5 - avg(x)) * 2 * sqrt(count(*)), 4) + 0.0 as z from w group by 1, 2")
def stride_scan(spark, d):
    s = signs(spark, d).withColumn("stride", F.explode(F.sequence(F.lit(2), F.lit(16)))).withColumn("phase", F.explode(F.array(F.lit(0), F.lit(1))))
    at = F.when(F.size("b") - F.col("stride") >= F.col("phase") + 1, F.sequence(F.col("phase") + 1, F.size("b") - F.col("stride"), F.lit(2)))
    w = s.withColumn("i", F.explode(at)).select("stride", "phase", F.element_at("b", F.col("i")).bitwiseXOR(F.element_at("b", F.col("i") + F.col("stride"))).alias("x"))
    g = w.groupBy("stride", "phase").agg(F.count("*").alias("checks"), F.avg("x").alias("share"))
    return g.select(F.col("stride").cast("long").alias("stride"), F.col("phase").cast("long").alias("phase"), "checks", r((0.5 - F.col("share")) * 2 * F.sqrt("checks"), 4).alias("z"))


# Codes


def _taps(g: int, at: str) -> list[str]:
    return [f"case when i > {k} then b[{at.format(k)}] else 0 end" for k in codes.taps(g, 7)]


def _xor(terms: list[str]) -> str:
    out = terms[0]
    for t in terms[1:]:
        out = f"xor({out}, {t})"
    return out


_ENCODE = f"flatten([[{_xor(_taps(0o171, 'i - {}'))}, {_xor(_taps(0o133, 'i - {}'))}] for i in range(1, len(b) + 1)])"


@query(f"with {SIGNS} select vec_id, array_to_string({_ENCODE}, '') as bits from v")
def conv_encode(spark, d):
    return signs(spark, d).select("vec_id", text_of(codes.encode(F.col("b"))).alias("bits"))


_CHECK = _xor([f"b[2 * (m - {k}) + 1]" for k in codes.taps(0o133, 7)] + [f"b[2 * (m - {k}) + 2]" for k in codes.taps(0o171, 7)])


@query(f"with {SIGNS}, s as (select vec_id, [{_CHECK} for m in range(6, len(b) // 2)] as s from v) select vec_id, len(s) as checks, round(list_avg(s), 6) + 0.0 as rate from s")
def parity_syndrome(spark, d):
    s = signs(spark, d).select("vec_id", codes.syndrome(F.col("b")).alias("s"))
    ones = F.aggregate("s", F.lit(0), lambda a, b: a + b)
    return s.select("vec_id", F.size("s").cast("long").alias("checks"), r(ones / F.size("s")).alias("rate"))


@query(f"with {SIGNS} select vec_id, array_to_string(b, '') as bits, 0 as mismatches from v")
def viterbi(spark, d):
    """Coded sign bits, one in eleven of which is erased and one in 31 turned, decode to the bits they were made of."""
    s = signs(spark, d).select("vec_id", "b", codes.encode(F.col("b")).alias("c"))
    soft = F.transform("c", lambda c, i: F.when(i % 11 == 5, 0.0).otherwise((1.0 - 2.0 * c) * F.when(i % 31 == 30, -0.3).otherwise(1.0)))
    out = codes.decoded(s.select("vec_id", soft.alias("llr")), "vec_id", "llr")
    again = out.select("vec_id", "bits", codes.encode(F.col("bits").cast("array<int>")).alias("e")).join(s.select("vec_id", "c"), "vec_id")
    wrong = F.size(F.filter(F.zip_with("e", "c", lambda a, b: a != b), lambda x: x))
    return again.select("vec_id", text_of(F.col("bits")).alias("bits"), wrong.alias("mismatches"))


def blocks_of(spark, d, size: int):
    """All whole blocks of so many bytes of the documents' texts: doc_id, block, data."""
    t = table(spark, d, "documents").where(F.col("text").isNotNull()).select("doc_id", framing.octets(F.encode("text", "UTF-8")).alias("b"))
    n = F.floor(F.size("b") / size).cast("int")
    x = t.where(n > 0).select("doc_id", "b", F.explode(F.sequence(F.lit(0), n - 1)).alias("block"))
    return x.select("doc_id", "block", F.slice("b", F.col("block") * size + 1, size).alias("data"))


_ROOTS = codes.roots(4)
_TIMES = ", ".join(f"[{', '.join(str(codes.field_product(v, x)) for v in range(256))}] as t{k}" for k, x in enumerate(_ROOTS))
_BYTES = "[('0x' || substr(h, 2 * i + 1, 2))::int for i in range(len(h) // 2)]"


@query(f"with t as (select {_TIMES}), h as (select doc_id, hex(encode(text)) as h from documents), k as (select doc_id, unnest(range(len(h) // 510)) as block, h from h), b as (select doc_id, block, [('0x' || substr(h, 510 * block + 2 * i + 1, 2))::int for i in range(255)] as w from k) select doc_id, block::int as block, concat_ws(',', " + ", ".join(f"list_reduce(list_prepend(0, w), lambda a, b: xor(t{k}[a + 1], b))" for k in range(4)) + ") as syndromes from b, t")
def rs_syndromes(spark, d):
    return blocks_of(spark, d, 255).select("doc_id", "block", F.array_join(F.transform(codes.rs_syndromes(F.col("data"), _ROOTS), lambda x: x.cast("string")), ",").alias("syndromes"))


@query("select p_partkey, 16 as errors, sha256(hex(encode(substr(repeat(p_name || '|' || p_partkey || '|', 12), 1, 100)))) as data from part")
def rs_correct(spark, d):
    """Shortened code words of 100 bytes and their check bytes, 16 bytes of which are changed, are put right."""
    import pandas as pd

    text = F.substring(F.repeat(F.concat_ws("|", "p_name", F.col("p_partkey").cast("string"), F.lit("")), 12), 1, 100)

    def spoil(batches):
        import numpy as np

        for batch in batches:
            data = np.array([list(b) for b in batch["data"]], np.int64).reshape(-1, 100)
            words = np.concatenate([data, codes.rs_parity(data, codes.roots())], axis=1)
            for k, key in enumerate(batch["p_partkey"]):
                at = (key + np.arange(16) * 8) % 132
                words[k, at] ^= 1 + (key + at) % 255
            yield pd.DataFrame({"p_partkey": batch["p_partkey"], "word": words.tolist()})

    sent = table(spark, d, "part").select("p_partkey", F.encode(text, "UTF-8").alias("data")).mapInPandas(spoil, "p_partkey long, word array<int>")
    got = codes.corrected(sent, "p_partkey", "word")
    octet = lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")
    return got.select("p_partkey", "errors", F.sha2(F.array_join(F.transform(F.slice("word", 1, 100), octet), ""), 256).alias("data"))


_EDGES = codes.circulant_edges([[0, 3, 7, 1], [5, 2, -1, 6]], 16)


@query(f"with {SIGNS}, e(c, x) as (values {', '.join(map(str, _EDGES))}), p as (select vec_id, c, bit_xor(b[x + 1]) as parity from v, e group by 1, 2) select vec_id, count(*) as checks, cast(sum(parity) as bigint) as failed, round(avg(parity), 6) + 0.0 as rate from p group by 1")
def ldpc_syndrome(spark, d):
    edges = spark.createDataFrame(_EDGES, "check int, var int")
    p = codes.parity_checks(signs(spark, d).select("vec_id", F.posexplode("b").alias("pos", "bit")), "vec_id", "pos", "bit", edges)
    return p.groupBy("vec_id").agg(F.count("*").alias("checks"), F.sum("parity").cast("long").alias("failed"), r(F.avg("parity")).alias("rate"))


@query(f"with {SIGNS} select vec_id, list_sum(b)::bigint as weight, (bit_count(list_sum([b[i + 1]::bigint << (31 - i) for i in range(32)])::bigint & 1515870810) % 2)::int as parity from v")
def gf2_row_weights(spark, d):
    x = signs(spark, d)
    word = codes.packed(F.col("b"), 0, 32)
    return x.select("vec_id", F.aggregate("b", F.lit(0).cast("long"), lambda a, b: a + b).alias("weight"), (F.bit_count(word.bitwiseAND(F.lit(1515870810))) % 2).alias("parity"))


_PACK = "list_sum([b[{0} + i]::bigint << (15 - i) for i in range(16)])::bigint"


@query(f"""
with recursive {SIGNS}, w as (select vec_id, {_PACK.format(1)} as a, {_PACK.format(17)} as b from v),
m(vec_id, x, k) as (select vec_id, a, 15 from w union all select vec_id, case when (x >> k) & 1 = 1 then xor(x, 285::bigint << (k - 8)) else x end, k - 1 from m where k >= 8),
g(vec_id, a, b, k) as (select vec_id, a, b, 0 from w union all select vec_id, case when a = 0 or b = 0 or len(bin(a)) < len(bin(b)) then a else xor(a, b << (len(bin(a)) - len(bin(b)))) end, case when a = 0 or b = 0 or len(bin(a)) >= len(bin(b)) then b else xor(b, a << (len(bin(b)) - len(bin(a)))) end, k + 1 from g where k < 62)
select w.vec_id, m.x as remainder, list_reduce([case when (w.b >> i) & 1 = 1 then w.a << i else 0::bigint end for i in range(16)], lambda p, q: xor(p, q)) as product, greatest(g.a, g.b) as gcd
from w join m on m.vec_id = w.vec_id and m.k = 7 join g on g.vec_id = w.vec_id and g.k = 62
""")
def gf2_polynomials(spark, d):
    w = signs(spark, d).select("vec_id", codes.packed(F.col("b"), 0, 16).alias("a"), codes.packed(F.col("b"), 16, 16).alias("b"))
    a, b = F.col("a"), F.col("b")
    return w.select("vec_id", codes.poly_mod(a, 285, 15).alias("remainder"), codes.poly_product(a, b, 16).alias("product"), codes.poly_gcd(a, b).alias("gcd"))


@query("with w as (select vec_id, s as start, list_min([abs(embedding[s + k + 1]) for k in range(8)])::double as least from (select vec_id, embedding, unnest(range(len(embedding) - 7)) as s from embeddings)), k as (select *, row_number() over (partition by vec_id order by least desc, start) as rank from w) select vec_id, start, round(least, 6) + 0.0 as least, rank::int as rank from k where rank <= 3")
def reliable_windows(spark, d):
    x = table(spark, d, "embeddings").where(F.size("embedding") >= 8).select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.size("embedding") - 8)).alias("start"))
    x = x.select("vec_id", F.col("start").cast("long").alias("start"), F.array_min(F.transform(F.slice("embedding", F.col("start") + 1, 8), F.abs)).cast("double").alias("least"))
    w = Window.partitionBy("vec_id").orderBy(F.desc("least"), "start")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 3").withColumn("least", r(F.col("least")))


def gf2_rank(spark, d):
    """Window matrices of 40 rows of sign bits each: rows and rank."""
    rows = signs(spark, d).select(F.floor(F.col("vec_id") / 40).alias("matrix"), text_of(F.slice("b", 1, 48)).alias("bits"))
    return codes.ranks(rows, "matrix", "bits")


QUERIES["gf2_rank"] = gf2_rank

# Framing

_CRC_VALUES = ", ".join(f"({k}, '{c.name}', {c.width}, {c.poly}, {c.init}, {c.refin}, {c.refout}, {c.xorout})" for k, c in enumerate(framing.CRCS))
_CRC = f"""
crcs(place, crc, width, poly, init, refin, refout, xorout) as (values {_CRC_VALUES}),
spec as (
  select place, crc, width, init::bigint as init, refin, refout, xorout::bigint as xorout, (1::bigint << width) - 1 as mask,
         [list_reduce([i::bigint << (width - 8), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: case when (a >> (width - 1)) & 1 = 1 then xor((a << 1) & ((1::bigint << width) - 1), poly) else (a << 1) & ((1::bigint << width) - 1) end) for i in range(256)] as t
  from crcs),
mirror as (select [list_sum([((i >> k) & 1) << (7 - k) for k in range(8)])::bigint for i in range(256)] as m)"""
_SUM = "list_reduce(list_prepend(init, [case when refin then m[x + 1] else x end for x in {0}]), lambda a, x: xor(t[xor(a >> (width - 8), x) + 1], (a << 8) & mask))"
_FINAL = "xor(case when refout then list_sum([((reg >> k) & 1) << (width - 1 - k) for k in range(width)])::bigint else reg end, xorout)"
_TURN_BYTES = "h as (select conv_id, turn, hex(encode(coalesce(text, ''))) as h from conversations), f as (select conv_id, turn, " + _BYTES.replace("::int", "::bigint") + " as data from h)"


@query(f"with {_CRC}, {_TURN_BYTES}, s as (select conv_id, turn, spec.*, {_SUM.format('data')} as reg from f, spec, mirror) select conv_id, turn, crc, {_FINAL} as sum from s")
def crc_catalogue(spark, d):
    c = table(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    return framing.crc_catalogue(c, "data").select("conv_id", "turn", "crc", "sum")


def crc_ccitt_false(spark, d):
    c = table(spark, d, "conversations")
    return c.select("conv_id", "turn", framing.crc_of(framing.octets(F.encode("text", "UTF-8")), framing.CRCS[0]).alias("crc"))


QUERIES["crc_ccitt_false"] = crc_ccitt_false
ORACLES["crc_ccitt_false"] = f"with {_CRC}, h as (select conv_id, turn, hex(encode(text)) as h from conversations), f as (select conv_id, turn, {_BYTES.replace('::int', '::bigint')} as data from h), s as (select conv_id, turn, spec.*, {_SUM.format('data')} as reg from f, spec, mirror where place = 0) select conv_id, turn, {_FINAL} as crc from s"


@query(f"""
with {_CRC}, {_TURN_BYTES},
made as (select conv_id, turn, data, spec.*, {_SUM.format('data')} as reg from f, spec, mirror where place = [0, 6, 24, 16][(conv_id % 4) + 1]),
sent as (select conv_id, turn, list_concat(data, [({_FINAL} >> (width - 8 - 8 * k)) & 255 for k in range(width // 8)]) as w from made),
tried as (select conv_id, turn, w, spec.*, len(w) > width // 8 as fits, {_SUM.format('w[: len(w) - width // 8]')} as reg from sent, spec, mirror),
passed as (select conv_id, place, crc, fits and {_FINAL} = list_reduce(list_prepend(0::bigint, w[len(w) - width // 8 + 1 :]), lambda a, b: a * 256 + b) as ok from tried),
counted as (select conv_id, place, crc, count(*) as frames, count(*) filter (ok) as passes from passed group by all)
select conv_id, any_value(frames) as frames, case when max(passes) > 0 then arg_max(crc, (passes, -place)) end as crc, max(passes) as passes from counted group by conv_id
""")
def best_crc(spark, d):
    """Turns as frames, with a check sum at their end that depends on the conversation: which set is it?"""
    c = table(spark, d, "conversations").select("conv_id", "turn", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("data"))
    c = c.withColumn("b", framing.octets(F.col("data")))
    end = F.lit(None).cast("string")
    for k, place in enumerate((0, 6, 24, 16)):
        crc = framing.CRCS[place]
        end = F.when(F.pmod("conv_id", F.lit(4)) == k, F.lpad(F.hex(framing.crc_of(F.col("b"), crc)), crc.width // 4, "0")).otherwise(end)
    return framing.best_crc(c.select("conv_id", F.concat("data", F.unhex(end)).alias("data")), "conv_id", "data")


@query("""
with b as (select vec_id, list_transform(embedding, lambda x: case when x < 0 then 1 else 0 end) as b from embeddings),
s as (select vec_id * 64 + i as pos, b[i + 1] as bit from (select vec_id, b, unnest(range(64)) as i from b)),
w as (select pos, list(bit) over (order by pos rows between current row and 31 following) as w from s),
e as (select pos, list_sum([xor(w[i + 1], (449838109 >> (31 - i)) & 1) for i in range(32)])::int as errors from w where len(w) = 32)
select pos, errors, errors > 8 as inverted from e where errors <= 8 or errors >= 24
""")
def sync_hits_stream(spark, d):
    """The sign bits of all vectors as one stream, 64 bits a row, against a 32-bit marker."""
    words = signs(spark, d).select(F.col("vec_id").alias("n"), codes.packed(F.col("b"), 0, 64).alias("w"))
    return framing.stream_hits(words, framing.SYNC_WORDS[0][1], 8)


@query("with w(width, errors) as (values (32, 3), (24, 2), (64, 3), (16, 0)), e as (select width, errors, unnest(range(errors + 1)) as e from w), c as (select width, errors, exp(lgamma(width + 1) - lgamma(e + 1) - lgamma(width - e + 1)) as c from e), h as (select width, errors, sum(round(c.c)) / pow(2, any_value(width)) as chance from c group by width, errors), n as (select user_id, count(*) as places from events group by 1) select user_id, width::int as width, errors::int as errors, round(log10(places * chance), 6) + 0.0 as log_hits from n, h")
def hit_chance(spark, d):
    """How many hits of a word of so many bits with so many errors chance brings at the places of each user's stream."""
    words = F.explode(F.array(*(F.struct(F.lit(w).alias("width"), F.lit(e).alias("errors")) for w, e in ((32, 3), (24, 2), (64, 3), (16, 0)))))
    n = table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("places")).select("user_id", "places", words.alias("w")).select("user_id", "places", "w.*")
    ways = lambda e: F.aggregate(F.sequence(F.lit(1), F.lit(8)), F.lit(1.0), lambda a, i: F.when(i <= e, a * (F.col("width") - e + i) / i).otherwise(a))
    total = F.aggregate(F.sequence(F.lit(0), F.col("errors")), F.lit(0.0), lambda a, e: a + F.round(ways(e)))
    return n.select("user_id", "width", "errors", r(F.log10(F.col("places") * total / F.pow(F.lit(2.0), F.col("width")))).alias("log_hits"))


_HITS = f"{USERS}, hits as (select rec_id, n from u where x < 100), gap as (select rec_id, n, n - lag(n) over (partition by rec_id order by n) as gap from hits), g as (select rec_id, gap, count(*) as pairs, min(n) as seen from gap where gap is not null group by 1, 2)"


def hits(spark, d):
    return users(spark, d).where("x < 100").select("rec_id", "n")


@query(f"with {_HITS} select rec_id, arg_max(gap, (pairs, -seen)) as period, max(pairs) as pairs, round(max(pairs) / sum(pairs), 6) + 0.0 as share from g group by 1")
def modal_period(spark, d):
    return framing.modal_gap(hits(spark, d), "rec_id", "n").select("rec_id", F.col("period").cast("long").alias("period"), "pairs", r(F.col("share")).alias("share"))


@query(f"with {_HITS} select rec_id, arg_max(gap, (pairs, -gap)) as period, max(pairs) as pairs, round(max(pairs) / sum(pairs), 6) + 0.0 as share from g group by 1")
def recurrence(spark, d):
    return framing.modal_gap(hits(spark, d), "rec_id", "n", first_seen=False).select("rec_id", F.col("period").cast("long").alias("period"), "pairs", r(F.col("share")).alias("share"))


@query(f"with {_HITS}, p as (select rec_id, arg_max(gap, (pairs, -seen)) as period from g group by 1), f as (select h.rec_id, h.n, p.period, min(h.n) over (partition by h.rec_id) as first, l.length from hits h join p using (rec_id) join (select rec_id, count(*) as length from u group by 1) l using (rec_id)), k as (select *, row_number() over (partition by rec_id order by n) as index from f where (n - first) % period = 0) select rec_id, index::int as index, n as start, case when n + period <= length then period else length - n end as bits, case when n + period <= length then 'complete' else 'truncated' end as status from k")
def cut_frames(spark, d):
    h = hits(spark, d)
    lengths = users(spark, d).groupBy("rec_id").agg(F.count("*").alias("length"))
    f = framing.on_grid(h, framing.modal_gap(h, "rec_id", "n"), lengths, "rec_id", "n")
    return f.select("rec_id", "index", F.col("start").cast("long").alias("start"), F.col("bits").cast("long").alias("bits"), "status")


@query("with t as (select user_id as id, count(*) as n, count(*) filter (value > 400) as k from events group by 1), j as (select id, n, k, unnest(range(greatest(k, 0), n + 1)) as j from t) select id, n, k, round(log10(greatest(1e-300, case when k <= 0 then 1.0 else sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.15) + (n - j) * ln(0.85))) end)), 5) + 0.0 as log_tail from j group by 1, 2, 3")
def binomial_tail(spark, d):
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > 400).alias("k"))
    return framing.binomial_tails(t.withColumn("p", F.lit(0.15))).select("id", "n", "k", r(F.log10("tail"), 5).alias("log_tail"))


_SIGN = "s as (select event_id as n, case when value > 250 then 1 else -1 end as x from events)"


@query(f"with {_SIGN}, z as (select lag, sum(a.x * b.x) / sqrt(count(*)) as z from s a, (select unnest(range(24, 89)) as lag) l join s b on b.n = a.n + lag group by 1), k as (select *, max(z) over (order by lag rows between 2 preceding and 2 following) as top from z) select lag, round(z, 5) + 0.0 as z from k where z >= 1 and z = top")
def autocorr_peaks(spark, d):
    """Lags at which the stream of signs repeats itself, none within two of a better one."""
    s = table(spark, d, "events").select(F.col("event_id").alias("n"), F.when(F.col("value") > 250, 1).otherwise(-1).alias("x"))
    a = s.select("n", F.col("x").alias("a"), F.explode(F.sequence(F.lit(24).cast("long"), F.lit(88).cast("long"))).alias("lag")).withColumn("m", F.col("n") + F.col("lag"))
    z = a.join(s.select(F.col("n").alias("m"), F.col("x").alias("b")), "m").groupBy("lag").agg((F.sum(F.col("a") * F.col("b")) / F.sqrt(F.count("*"))).alias("z"))
    near = Window.orderBy("lag").rowsBetween(-2, 2)  # one row for each lag
    return z.withColumn("top", F.max("z").over(near)).where((F.col("z") >= 1) & (F.col("z") == F.col("top"))).select("lag", r(F.col("z"), 5).alias("z"))


_COLUMNS = f"{SIGNS}, c as (select vec_id % 10 as key, i as col, count(*) as rows, sum(b[i + 1])::bigint as ones from (select vec_id, b, unnest(range(len(b))) as i from v) group by 1, 2)"


@query(f"with {_COLUMNS}, j as (select key, col, rows, ones, unnest(range(greatest(ones, rows - ones), rows + 1)) as j from c), p as (select key, col, rows, ones, least(1.0, 2 * sum(exp(lgamma(rows + 1) - lgamma(j + 1) - lgamma(rows - j + 1) + rows * ln(0.5)))) as p from j group by 1, 2, 3, 4) select key, col, rows, ones, round(p, 8) + 0.0 as p from p where p <= 0.1")
def column_constancy(spark, d):
    """Columns whose bits are alike more often than chance allows, by the two-sided binomial test."""
    x = signs(spark, d).select((F.col("vec_id") % 10).alias("key"), "b")
    c = framing.column_counts(x, "key", "b").withColumn("id", F.struct("key", "col"))
    t = framing.binomial_tails(c.select("id", F.col("rows").alias("n"), F.greatest("ones", F.col("rows") - F.col("ones")).alias("k"), F.lit(0.5).alias("p")))
    out = c.join(t.select("id", "tail"), "id").withColumn("p", F.least(F.lit(1.0), 2 * F.col("tail"))).where("p <= 0.1")
    return out.select("key", F.col("col").cast("long").alias("col"), "rows", F.col("ones").cast("long").alias("ones"), r(F.col("p"), 8).alias("p"))


@query(f"with {_COLUMNS}, f as (select key, col, ones * 2 > rows as flag from c), t as (select key, unnest([col, col + 64]) as c from f where flag), w as (select key, c, c - row_number() over (partition by key order by c) as run from t), g as (select key, run, min(c) as start, least(count(*), 64) as length from w group by 1, 2) select key, -max((length, -start))[2] as start, max((length, -start))[1] as length from g where start < 64 group by 1")
def circular_runs(spark, d):
    x = signs(spark, d).select((F.col("vec_id") % 10).alias("key"), "b")
    c = framing.column_counts(x, "key", "b").withColumn("flag", F.col("ones") * 2 > F.col("rows")).withColumn("col", F.col("col").cast("long"))
    return framing.longest_circular_run(c, "key", "col", "flag", 64)


@query(f"with {SIGNS}, k as (select vec_id % 10 as key, vec_id, b, row_number() over (partition by vec_id % 10 order by vec_id) - 1 as row, count(*) over (partition by vec_id % 10) as rows from v), c as (select key, i, sum(b[i + 1]) * 2 > count(*) as bit from (select key, b, unnest(range(64)) as i from k where row < rows // 2) group by 1, 2), e as (select k.key, k.vec_id, count(*) filter (k.b[c.i + 1] <> c.bit::int) as wrong from k join c on c.key = k.key where row >= rows // 2 group by 1, 2) select key, count(*) as rows, count(*) filter (wrong <= 28) as recurrences from e group by 1")
def heldout_recurrence(spark, d):
    """The first half of a key's rows votes for each bit of a word; how often does the second half come near it?"""
    x = signs(spark, d).select((F.col("vec_id") % 10).alias("key"), "vec_id", "b")
    w = Window.partitionBy("key")
    x = x.withColumn("row", F.row_number().over(w.orderBy("vec_id")) - 1).withColumn("half", F.floor(F.count("*").over(w) / 2))
    votes = framing.column_counts(x.where("row < half"), "key", "b").select("key", F.col("col"), (F.col("ones") * 2 > F.col("rows")).cast("int").alias("bit"))
    word = votes.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("col", "bit"))).alias("word"))
    e = x.where("row >= half").join(word, "key").withColumn("wrong", F.size(F.filter(F.zip_with("b", "word", lambda a, c: a != c["bit"]), lambda z: z)))
    return e.groupBy("key").agg(F.count("*").alias("rows"), F.count_if(F.col("wrong") <= 28).alias("recurrences"))


@query("with k as (select o_custkey, (lead(o_orderkey) over (partition by o_custkey order by o_orderkey) - o_orderkey) % 256 as step from orders), g as (select o_custkey, step, count(*) as n from k where step is not null group by 1, 2) select o_custkey, arg_max(step, (n, -step)) as step, max(n) as same, cast(sum(n) as bigint) as steps from g group by 1")
def counter_fields(spark, d):
    """A field that counts: the most common step from frame to frame, modulo its width."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = table(spark, d, "orders").withColumn("step", F.pmod(F.lead("o_orderkey").over(w) - F.col("o_orderkey"), F.lit(256))).where("step is not null")
    g = k.groupBy("o_custkey", "step").agg(F.count("*").alias("n"))
    best = g.groupBy("o_custkey").agg(F.max(F.struct("n", (-F.col("step")).alias("order"), "step")).alias("x"), F.sum("n").alias("steps"))
    return best.select("o_custkey", F.col("x.step").cast("long").alias("step"), F.col("x.n").alias("same"), "steps")


# What an analyst looks at


@query(f"with {_COLUMNS} select key, col, rows, round(greatest(ones, rows - ones) / rows, 6) + 0.0 as agreement, case when ones = rows or ones = 0 then 'constant' when greatest(ones, rows - ones) > 0.6 * rows then 'leaning' else 'free' end as kind from c")
def field_map(spark, d):
    x = signs(spark, d).select((F.col("vec_id") % 10).alias("key"), "b")
    top = F.greatest("ones", F.col("rows") - F.col("ones"))
    kind = F.when(top == F.col("rows"), "constant").when(top > 0.6 * F.col("rows"), "leaning").otherwise("free")
    return framing.column_counts(x, "key", "b").select("key", F.col("col").cast("long").alias("col"), "rows", r(top / F.col("rows")).alias("agreement"), kind.alias("kind"))


@query(f"with {SIGNS}, t as (select vec_id, array_to_string(b, '') as t from v), p as (select vec_id, t, unnest(range(len(t) - 5)) as pos from t) select vec_id, pos from p where substr(t, pos + 1, 6) = '101101'")
def pattern_search(spark, d):
    """All places of a bit pattern, at any offset and overlapping."""
    t = signs(spark, d).select("vec_id", text_of(F.col("b")).alias("t")).where(F.length("t") >= 6)
    p = t.withColumn("pos", F.explode(F.sequence(F.lit(0), F.length("t") - 6)))
    return p.where(F.substr("t", F.col("pos") + 1, F.lit(6)) == "101101").select("vec_id", F.col("pos").cast("long").alias("pos"))


@query("with h as (select doc_id, md5(coalesce(text, '')) as h from documents) select doc_id, array_to_string(flatten([[((('0x' || substr(h, i + 1, 1))::int >> (3 - k)) & 1) for k in range(4)] for i in range(32)]), '') as bits from h")
def hex_bits(spark, d):
    h = table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("h"))
    four = lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")
    return h.select("doc_id", F.array_join(F.transform(F.filter(F.split("h", ""), lambda c: c != ""), four), "").alias("bits"))


@query("select user_id, min(floor(epoch(ts))::bigint) as start, max(floor(epoch(ts))::bigint + 1800) as stop, count(*) as frames from events group by 1")
def stream_extent(spark, d):
    t = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").groupBy("user_id").agg(F.min(t).alias("start"), F.max(t + 1800).alias("stop"), F.count("*").alias("frames"))


@query("with f as (select conv_id, turn, 8 * octet_length(encode(coalesce(text, ''))) as body from conversations) select conv_id, turn, 32 as sync, least(48, body) as header, greatest(0, body - 48 - 16) as payload, least(16, greatest(0, body - 48)) as crc, 32 + body as total from f")
def frame_anatomy(spark, d):
    """How the bits of a frame are spent: sync word, header of 48 bits, payload, check sum of 16."""
    body = 8 * F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    f = table(spark, d, "conversations").select("conv_id", "turn", body.alias("body"))
    n = lambda k: F.lit(k).cast("long")
    return f.select("conv_id", "turn", F.lit(32).alias("sync"), F.least(n(48), "body").alias("header"), F.greatest(n(0), F.col("body") - 64).alias("payload"), F.least(n(16), F.greatest(n(0), F.col("body") - 48)).alias("crc"), (F.col("body") + 32).alias("total"))


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn) as index, octet_length(encode(coalesce(text, ''))) * 8 as length_bits, hex(encode(coalesce(text, ''))) as payload_hex from conversations")
def frame_table_hex(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = F.coalesce("text", F.lit(""))
    return table(spark, d, "conversations").select("conv_id", "turn", F.row_number().over(w).alias("index"), (F.octet_length(t) * 8).alias("length_bits"), F.hex(F.encode(t, "UTF-8")).alias("payload_hex"))
