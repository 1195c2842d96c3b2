"""Registered queries of known systems, evidence, results and benches, each with SQL that another engine can run."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evidence, framing, intervals, systems
from .catalogue import SIGNS, query, r, signs, table, text_of
from .detection import _BOX, signal_boxes

# Known systems


def _word(at: int, n: int, b: str = "b") -> str:
    return f"list_sum([{b}[{at + 1} + i]::bigint << ({n - 1} - i) for i in range({n})])::bigint"


@query(f"with recursive {SIGNS}, w as (select vec_id, {_word(0, 32)} as w from v), m(vec_id, w, x, k) as (select vec_id, w, w >> 1, 30 from w union all select vec_id, w, case when (x >> k) & 1 = 1 then xor(x, {systems.BCH}::bigint << (k - 10)) else x end, k - 1 from m where k >= 10) select vec_id, x as remainder, (bit_count(w) % 2)::int as parity, ((w >> 13) & 262143) << 3 | (vec_id % 16) // 2 as address, (w >> 11) & 3 as function from m where k = 9")
def bch_check(spark, d):
    """Words of 32 bits under the paging code, and what they say as an address."""
    w = signs(spark, d).select("vec_id", systems.codes.packed(F.col("b"), 0, 32).alias("w"))
    rest, parity = systems.page_word(F.col("w"))
    fields = systems.page_fields(F.col("w"), F.col("vec_id") % 16)
    return w.select("vec_id", rest.alias("remainder"), parity.alias("parity"), fields["address"].alias("address"), fields["function"].alias("function"))


@query(f"with {SIGNS} select vec_id, 0::bigint as remainder, 0 as parity, {_word(0, 21)} as data from v")
def page_encode(spark, d):
    """Encoded data bits are code words and hold the data."""
    w = signs(spark, d).select("vec_id", systems.page_word_of(systems.codes.packed(F.col("b"), 0, 21)).alias("w"))
    rest, parity = systems.page_word(F.col("w"))
    return w.select("vec_id", rest.alias("remainder"), parity.alias("parity"), F.shiftright("w", 11).alias("data"))


_GROUPS = f"{SIGNS}, o as (select vec_id, b, unnest(range(7)) as o from v), g as (select vec_id, o, [list_sum([b[o + 7 * k + i + 1] << (6 - i) for i in range(7)])::int for k in range((len(b) - o) // 7)] as g from o)"


@query(f"with {_GROUPS} select vec_id, o::int as shift, len([x for x in g if bit_count(x) = 4])::int as valid, len([k for k in range(5, len(g)) if bit_count(g[k + 1]) = 4 and g[k + 1] = g[k - 4] and g[k + 1] <> g[k]])::int as agree from g")
def four_of_seven_pairs(spark, d):
    """Groups of seven bits at each offset: those with four ones, and those that repeat the group five places before."""
    out = None
    for o in range(7):
        valid, agree = systems.repeated_groups(F.col("g"))
        part = signs(spark, d).select("vec_id", systems.groups(F.col("b"), 7, o).alias("g")).select("vec_id", F.lit(o).alias("shift"), valid.alias("valid"), agree.alias("agree"))
        out = part if out is None else out.unionByName(part)
    return out


def _table_sql(t: dict[int, str]) -> str:
    return "map {" + ", ".join(f"{k}: {repr(v) if v not in (chr(13), chr(10), chr(39)) else 'chr(' + str(ord(v)) + ')'}" for k, v in t.items()) + "}"


@query(f"with {_GROUPS}, p as (select vec_id, g, unnest(range(len(g))) as k from g where o = 0), s as (select vec_id, k, g[k + 1] as x, coalesce(arg_max(case g[k + 1] when {systems.TO_FIGURES} then 1 else 0 end, k) filter (g[k + 1] in ({systems.TO_FIGURES}, {systems.TO_LETTERS})) over (partition by vec_id order by k rows between unbounded preceding and 1 preceding), 0) as shift from p) select vec_id, string_agg(case when bit_count(x) <> 4 then '?' else coalesce(case shift when 1 then {_table_sql(systems.FIGURES)}[x] else {_table_sql(systems.LETTERS)}[x] end, '') end, '' order by k) as text from s group by 1")
def navtex_text(spark, d):
    """Bits read as groups of the four-of-seven alphabet, with its shifts."""
    return signs(spark, d).select("vec_id", systems.teletype(systems.groups(F.col("b"), 7)).alias("text"))


@query(f"with {SIGNS}, g as (select vec_id, unnest(range(len(b) // 10)) as k, b from v), s as (select vec_id, k, list_sum([b[10 * k + i + 1] << i for i in range(7)])::int as symbol, 7 - list_sum(b[10 * k + 1 : 10 * k + 7])::int = 4 * b[10 * k + 8] + 2 * b[10 * k + 9] + b[10 * k + 10] as good from g) select vec_id, string_agg(symbol::varchar, ',' order by k) as symbols, count(*) filter (good) as good from s group by 1")
def dsc_check(spark, d):
    """Ten-bit characters whose last three bits count the zeros of the first seven."""
    symbols, good = systems.checked_symbols(F.col("b"))
    return signs(spark, d).select("vec_id", F.array_join(F.transform(symbols, lambda x: x.cast("string")), ",").alias("symbols"), F.size(F.filter(good, lambda g: g)).cast("long").alias("good"))


@query(f"with {SIGNS}, n as (select vec_id, array_to_string([1 - xor(b[i], b[i - 1]) for i in range(2, len(b) + 1)], '') as t from v) select vec_id, len(regexp_extract_all(t, '01111110'))::int as flags, instr(t, '01111110')::int - 1 as first from n")
def nrzi_flags(spark, d):
    """Frame flags in bits that were sent as changes of level: how many, none overlapping, and where the first is."""
    b = F.col("b")
    t = F.array_join(F.transform(F.sequence(F.lit(1), F.size(b) - 1), lambda i: (1 - F.get(b, i).bitwiseXOR(F.get(b, i - 1))).cast("string")), "")
    return signs(spark, d).select("vec_id", t.alias("t")).select("vec_id", F.regexp_count("t", F.lit("01111110")).alias("flags"), (F.instr("t", "01111110") - 1).alias("first"))


@query(f"with {SIGNS} select vec_id, {_word(0, 2)} as version, {_word(2, 10)} as spacecraft, {_word(12, 3)} as channel, {_word(15, 1)} as control_flag, {_word(16, 8)} as master_count, {_word(24, 8)} as channel_count, {_word(32, 16)} as status from v")
def ccsds_header(spark, d):
    return signs(spark, d).select("vec_id", *(c.alias(n) for n, c in systems.transfer_frame_header(F.col("b")).items()))


#: Systems with their modulations and symbol rates; no rates means any.
SYSTEMS = (("ccsds-tm", "BPSK QPSK", ()), ("pocsag", "2FSK", (512.0, 1200.0, 2400.0)), ("navtex", "2FSK", (100.0,)), ("dsc", "2FSK", (100.0,)), ("ais", "2FSK", (9600.0,)))
_SYSTEMS = ", ".join(f"('{n}', '{m}', {list(map(float, x)) or '[]::double[]'})" for n, m, x in SYSTEMS)


@query(f"with s(system, modulations, rates) as (values {_SYSTEMS}), f as (select event_id, ['BPSK', '2FSK', 'QPSK', '8PSK'][event_id % 4 + 1] as modulation, value * 25 as rate from events), c as (select event_id, system, not list_contains(string_split(modulations, ' '), modulation) as wrong_modulation, len(rates) > 0 and len([x for x in rates if abs(x - rate) <= 0.02 * x]) = 0 as wrong_rate from f, s) select event_id, system, wrong_modulation, wrong_rate, not (wrong_modulation or wrong_rate) as fits from c where not wrong_modulation")
def catalogue_fit(spark, d):
    """Findings against each system's entry: what conflicts. The catalogue is a handful of rows."""
    kinds = F.array(*(F.struct(F.lit(n).alias("system"), F.lit(m).alias("modulations"), F.array(*map(F.lit, x)).cast("array<double>").alias("rates")) for n, m, x in SYSTEMS))
    e = F.col("event_id")
    f = table(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, ("BPSK", "2FSK", "QPSK", "8PSK"))), (e % 4 + 1).cast("int")).alias("modulation"), (F.col("value") * 25).alias("rate"), F.explode(kinds).alias("s")).select("*", "s.*")
    wrong = ~F.array_contains(F.split("modulations", " "), F.col("modulation"))
    far = (F.size("rates") > 0) & ~F.exists("rates", lambda x: F.abs(x - F.col("rate")) <= 0.02 * x)
    return f.select("event_id", "system", wrong.alias("wrong_modulation"), far.alias("wrong_rate"), (~wrong & ~far).alias("fits")).where(~F.col("wrong_modulation"))


# Evidence


@query("with g as (select user_id, count(distinct event_type) as branches, count(*) as cells from events group by 1) select user_id, branches * cells * 2 * (1 + 2) * 31 * (1 + 8 * 255) as tried, round(log10(0.01 / (branches * cells * 2 * (1 + 2) * 31 * (1 + 8 * 255))), 6) + 0.0 as log_threshold from g")
def hypothesis_grid_count(spark, d):
    """How many hypotheses a search would try, and the threshold that its family is allowed."""
    g = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("branches"), F.count("*").alias("cells"))
    tried = F.col("branches") * F.col("cells") * 2 * (1 + 2) * len(framing.CRCS) * (1 + 8 * 255)
    return g.select("user_id", tried.alias("tried"), r(F.log10(0.01 / tried)).alias("log_threshold"))


@query("with t as (select user_id, event_id, value / 5e6 as p, event_id % 3 = 0 as outer_code, event_id % 5 = 0 as unnamed, event_id % 7 as shuffled, count(*) over (partition by user_id) as tried from events), k as (select *, row_number() over (partition by user_id order by p, outer_code, unnamed, event_id) as rank from t where p <= 0.01 / tried) select user_id, min_by(event_id, rank) as accepted, min(rank) as rank from k where rank <= 3 and shuffled = 0 group by 1")
def bonferroni_accept(spark, d):
    """The first of the three best chains within the threshold that finds nothing in shuffled bits."""
    w = Window.partitionBy("user_id")
    e = F.col("event_id")
    t = table(spark, d, "events").select("user_id", "event_id", (F.col("value") / 5e6).alias("p"), (e % 3 == 0).alias("outer_code"), (e % 5 == 0).alias("unnamed"), (e % 7).alias("shuffled"), F.count("*").over(w).alias("tried"))
    k = t.where(F.col("p") <= 0.01 / F.col("tried")).withColumn("rank", F.row_number().over(w.orderBy("p", "outer_code", "unnamed", "event_id")))
    return k.where((F.col("rank") <= 3) & (F.col("shuffled") == 0)).groupBy("user_id").agg(F.min_by("event_id", "rank").alias("accepted"), F.min("rank").cast("long").alias("rank"))


@query("with t as (select user_id as id, count(*) as n, count(*) filter (event_id % 61 = 0) as k from events group by 1), j as (select id, n, k, unnest(range(greatest(k, 0), n + 1)) as j from t) select id, n, k, round(log10(greatest(1e-300, case when k <= 0 then 1.0 else sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(1 / 256.0) + (n - j) * ln(1 - 1 / 256.0))) end)), 5) + 0.0 as log_p from j group by 1, 2, 3")
def chain_p_value(spark, d):
    """The chance that so many frames pass an eight-bit check by luck."""
    t = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 61 == 0).alias("k"))
    return framing.binomial_tails(t.withColumn("p", F.lit(1 / 256))).select("id", "n", "k", r(F.log10("tail"), 5).alias("log_p"))


_LEVELS = "['UNKNOWN', 'HYPOTHESIS', 'ESTIMATED', 'MEASURED', 'VERIFIED']"
_PARAMETERS = f"q as (select c_custkey as id, {_LEVELS}[c_custkey % 5 + 1] as level, case when c_custkey % 5 <> 0 or c_custkey % 3 = 0 then round(c_acctbal, 2) end as value, case when c_custkey % 2 = 0 then 0.5 end as uncertainty, c_custkey % 4 = 0 as proof, case when c_custkey % 7 = 0 then 'by custom' end as convention, c_mktsegment as stage from customer)"


def parameters(spark, d):
    """Reported values with the level of their evidence."""
    k = F.col("c_custkey")
    level = F.element_at(F.array(*map(F.lit, evidence.LEVELS)), (k % 5 + 1).cast("int"))
    return table(spark, d, "customer").select(
        k.alias("id"), level.alias("level"), F.when((k % 5 != 0) | (k % 3 == 0), F.round("c_acctbal", 2)).alias("value"), F.when(k % 2 == 0, 0.5).alias("uncertainty"),
        (k % 4 == 0).alias("proof"), F.when(k % 7 == 0, "by custom").alias("convention"), F.col("c_mktsegment").alias("stage"),
    )


@query(f"with {_PARAMETERS}, v as (select id, unnest([case when level = 'UNKNOWN' and value is not null then 'unknown with a value' end, case when level <> 'UNKNOWN' and value is null then 'no value' end, case when level = 'ESTIMATED' and value is not null and uncertainty is null then 'no uncertainty' end, case when (level = 'VERIFIED') <> proof then 'proof and level differ' end, case when convention is not null and level <> 'HYPOTHESIS' then 'convention beyond hypothesis' end]) as broken from q) select id, broken from v where broken is not null")
def honesty_violations(spark, d):
    """Which rules of honest reporting each value breaks."""
    return evidence.violations(parameters(spark, d)).select("id", "broken")


@query(f"with {_PARAMETERS} select id, case when level in ('MEASURED', 'ESTIMATED') and stage <> 'BUILDING' then 'HYPOTHESIS' else level end as level, level in ('MEASURED', 'ESTIMATED') and stage <> 'BUILDING' as capped from q")
def cap_levels(spark, d):
    """Labels that the recording can't carry are lowered to hypotheses; one stage and proofs are left."""
    return evidence.capped(parameters(spark, d), F.col("stage") != "BUILDING").select("id", "level", "capped")


@query(f"with {_PARAMETERS} select id, case when proof and level <> 'UNKNOWN' then 'VERIFIED' else level end as level, case when proof and level <> 'UNKNOWN' then null else convention end as convention from q")
def promote_levels(spark, d):
    """A proof further down the chain verifies a value and settles what was taken by custom."""
    up = F.col("proof") & (F.col("level") != "UNKNOWN")
    return parameters(spark, d).select("id", F.when(up, "VERIFIED").otherwise(F.col("level")).alias("level"), F.when(~up, F.col("convention")).alias("convention"))


@query(f"with {_PARAMETERS} select stage || '/' || id as place, convention from q where convention is not null union all select 'recording/' || s_suppkey, 'I before Q' from supplier where s_suppkey % 3 = 0")
def needs_review_union(spark, d):
    """Every value that was taken by custom, with its place."""
    q = parameters(spark, d).where(F.col("convention").isNotNull()).select(F.concat_ws("/", "stage", F.col("id").cast("string")).alias("place"), "convention")
    s = table(spark, d, "supplier").where(F.col("s_suppkey") % 3 == 0).select(F.concat(F.lit("recording/"), F.col("s_suppkey").cast("string")).alias("place"), F.lit("I before Q").alias("convention"))
    return q.unionByName(s)


@query("select c_custkey as id, concat_ws(',', c_custkey::varchar, '\"' || replace(c_name, '\"', '\"\"') || '\"', coalesce(c_mktsegment, ''), case when c_custkey % 2 = 0 then 'a | b' else '' end) as line from customer")
def params_csv_rows(spark, d):
    """One line of a table file for each value; lists are joined by a bar, quotes doubled."""
    quoted = F.concat(F.lit('"'), F.replace("c_name", F.lit('"'), F.lit('""')), F.lit('"'))
    many = F.when(F.col("c_custkey") % 2 == 0, F.array_join(F.array(F.lit("a"), F.lit("b")), " | ")).otherwise("")
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat_ws(",", F.col("c_custkey").cast("string"), quoted, F.coalesce("c_mktsegment", F.lit("")), many).alias("line"))


@query(f"with {_PARAMETERS}, g as (select stage, count(*) as n, count(*) filter (level = 'VERIFIED') as proved, count(*) filter (level = 'UNKNOWN') as unknown from q group by 1) select stage, 'Of ' || n || ' values of ' || stage || ', ' || proved || case proved when 1 then ' is' else ' are' end || ' proved and ' || unknown || ' unknown.' as line from g")
def summary_lines(spark, d):
    g = parameters(spark, d).groupBy("stage").agg(F.count("*").alias("n"), F.count_if(F.col("level") == "VERIFIED").alias("proved"), F.count_if(F.col("level") == "UNKNOWN").alias("unknown"))
    return g.select("stage", F.concat(F.lit("Of "), F.col("n").cast("string"), F.lit(" values of "), "stage", F.lit(", "), F.col("proved").cast("string"), F.when(F.col("proved") == 1, " is").otherwise(" are"), F.lit(" proved and "), F.col("unknown").cast("string"), F.lit(" unknown.")).alias("line"))


@query(f"""with {_BOX} select id, '{{"core:sample_start":' || start || ',"core:sample_count":' || (stop - start) || case when id % 5 in (3, 4) then ',"core:freq_lower_edge":' || floor(low)::bigint || ',"core:freq_upper_edge":' || ceil(high)::bigint else '' end || ',"core:label":"u' || user_id || '"}}' as annotation from b""")
def sigmf_annotations(spark, d):
    """Boxes as annotations; band edges only where their level is measured or proved, absent fields left out."""
    sure = F.col("id") % 5 >= 3
    a = F.struct(F.col("start").alias("core:sample_start"), (F.col("stop") - F.col("start")).alias("core:sample_count"), F.when(sure, F.floor("low")).alias("core:freq_lower_edge"), F.when(sure, F.ceil("high")).alias("core:freq_upper_edge"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("core:label"))
    return signal_boxes(spark, d).select("id", F.to_json(a).alias("annotation"))


@query("select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as place from events where event_id % 10 <> 0")
def history_newest(spark, d):
    """Saved results, newest first, without those that were deleted."""
    kept = table(spark, d, "events").join(table(spark, d, "events").where(F.col("event_id") % 10 == 0).select("event_id"), "event_id", "left_anti")
    return kept.select("user_id", "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))).cast("long").alias("place"))


@query("""select user_id, sha256('[' || string_agg('{"event":' || event_id || ',"type":"' || event_type || '"}', ',' order by event_id) || ']') as sha256, count(*) as items from events group by 1""")
def results_hash(spark, d):
    """The digest of each user's results as one document whose form depends on its content only."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("event"), F.col("event_type").alias("type")))).alias("x"), F.count("*").alias("items"))
    return e.select("user_id", F.sha2(F.to_json("x"), 256).alias("sha256"), "items")


@query("select n_nationkey, coalesce(case when n_nationkey % 3 = 0 then n_name end, case when n_nationkey % 2 = 0 then lower(n_name) end, 'unknown') as value, n_nationkey % 6 = 0 and n_name <> lower(n_name) as conflict from nation")
def stated_entered(spark, d):
    """What the analyst entered comes before what the file states; where both speak and differ it is a conflict."""
    k = F.col("n_nationkey")
    entered, stated = F.when(k % 3 == 0, F.col("n_name")), F.when(k % 2 == 0, F.lower("n_name"))
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(entered, stated, F.lit("unknown")).alias("value"), F.coalesce(entered != stated, F.lit(False)).alias("conflict"))


@query("select doc_id, least(n_chars, greatest(0, 1000 - doc_id % 900)) as bytes, n_chars > greatest(0, 1000 - doc_id % 900) as cut from documents")
def clamp_bytes(spark, d):
    """The bytes a header states, cut back to those that the file has beyond an offset."""
    there = F.greatest(F.lit(0), 1000 - F.col("doc_id") % 900)
    return table(spark, d, "documents").select("doc_id", F.least("n_chars", there).alias("bytes"), (F.col("n_chars") > there).alias("cut"))


# Benches


@query("with s as (select event_id, floor(value / 50)::bigint as bucket, value % 7 as error, event_id % 9 <> 0 as found from events) select bucket, count(*) as n, round(avg(found::int), 6) + 0.0 as recall, round(median(error) filter (found), 6) + 0.0 as median_error, round(max(abs(error)) filter (found), 6) + 0.0 as worst from s group by 1")
def snr_bucket_stats(spark, d):
    s = table(spark, d, "events").select(F.floor(F.col("value") / 50).alias("bucket"), (F.col("value") % 7).alias("error"), (F.col("event_id") % 9 != 0).alias("found"))
    hit = F.when(F.col("found"), F.col("error"))
    return s.groupBy("bucket").agg(F.count("*").alias("n"), r(F.avg(F.col("found").cast("int"))).alias("recall"), r(F.median(hit)).alias("median_error"), r(F.max(F.abs(hit))).alias("worst"))


@query(f"with {_BOX}, m as (select x.user_id, x.id as truth, y.id as found, least(x.stop, y.stop) - greatest(x.start, y.start) as common from b x join b y on x.user_id = y.user_id and x.id < y.id and greatest(x.start, y.start) < least(x.stop, y.stop) where x.id % 2 = 0 and y.id % 2 = 1) select truth, user_id, arg_max(found, (common, -found)) as found, max(common)::bigint as common from m group by 1, 2")
def truth_match_overlap(spark, d):
    """For each true signal the detection that overlaps it most."""
    m = intervals.overlap_pairs(signal_boxes(spark, d), "user_id", 7200).where((F.col("id_a") % 2 == 0) & (F.col("id_b") % 2 == 1))
    both = intervals.overlap(F.col("start_a"), F.col("stop_a"), F.col("start_b"), F.col("stop_b"))
    best = m.groupBy(F.col("id_a").alias("truth"), "user_id").agg(F.max(F.struct(both.alias("both"), (-F.col("id_b")).alias("k"))).alias("x"))
    return best.select("truth", "user_id", (-F.col("x.k")).alias("found"), F.col("x.both").cast("long").alias("common"))


@query("with c as (select event_type as truth, ['correct', 'convention', 'unknown', 'wrong'][event_id % 4 + 1] as outcome from events) select truth, count(*) filter (outcome = 'correct') as correct, count(*) filter (outcome = 'convention') as convention, count(*) filter (outcome = 'unknown') as unknown, count(*) filter (outcome = 'wrong') as wrong from c group by 1")
def confusion_pivot(spark, d):
    kinds = ["correct", "convention", "unknown", "wrong"]
    c = table(spark, d, "events").select(F.col("event_type").alias("truth"), F.element_at(F.array(*map(F.lit, kinds)), (F.col("event_id") % 4 + 1).cast("int")).alias("outcome"))
    return c.groupBy("truth").pivot("outcome", kinds).count().fillna(0)


@query("with k as (select user_id, event_id, row_number() over (partition by user_id order by value desc, event_id) as rank from events) select event_id % 5 as part, count(*) as files, round(median(rank), 4) + 0.0 as median_rank, count(*) filter (rank <= 10) as within_ten from k group by 1")
def rate_rank_median(spark, d):
    """How far up a ranking the true value stands."""
    k = table(spark, d, "events").withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")))
    return k.groupBy((F.col("event_id") % 5).alias("part")).agg(F.count("*").alias("files"), r(F.median("rank"), 4).alias("median_rank"), F.count_if(F.col("rank") <= 10).alias("within_ten"))


@query("select coalesce(event_type, 'all') as kind, count(*) as detections, count(*) filter (value > 489) as accepted, count(distinct user_id) as files from events group by grouping sets ((event_type), ())")
def null_set_totals(spark, d):
    """Totals of recordings without a signal, where nothing may be accepted."""
    e = table(spark, d, "events")
    return e.groupingSets([[F.col("event_type")], []], "event_type").agg(F.count("*").alias("detections"), F.count_if(F.col("value") > 489).alias("accepted"), F.countDistinct("user_id").alias("files")).select(F.coalesce("event_type", F.lit("all")).alias("kind"), "detections", "accepted", "files")


@query("with t as (select user_id, event_id, ts, lead(ts) over (partition by user_id order by ts, event_id) as next from events) select user_id, count(next) as phases, cast(coalesce(sum(floor(epoch(next))::bigint - floor(epoch(ts))::bigint), 0) as bigint) as seconds, cast(coalesce(max(floor(epoch(next))::bigint - floor(epoch(ts))::bigint), 0) as bigint) as longest from t group by 1")
def run_phases(spark, d):
    """The phases of a run from their starting times: how many, how long in all, and the longest."""
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    t = table(spark, d, "events").withColumn("took", F.lead(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - at)
    return t.groupBy("user_id").agg(F.count("took").alias("phases"), F.coalesce(F.sum("took"), F.lit(0)).alias("seconds"), F.coalesce(F.max("took"), F.lit(0)).alias("longest"))


# Tails in logarithms


@query("with t as (select user_id, count(*) filter (value > 400) + user_id % 9 as k, 0.05 * count(*) as mean from events group by 1), j as (select *, unnest(range(k, k + 400)) as j from t), s as (select user_id, k, mean, max(j * ln(mean) - mean - lgamma(j + 1)) as top, list(j * ln(mean) - mean - lgamma(j + 1)) as x from j group by all) select user_id, k, round(case when k <= 0 then 0.0 else (top + ln(list_sum([exp(y - top) for y in x]))) / ln(10) end, 5) + 0.0 as log_p from s")
def poisson_tail(spark, d):
    """How unlikely so many events beyond a level are for a Poisson law, in powers of ten."""
    import pandas as pd

    from ..functions.special import log_poisson_tail

    @F.pandas_udf("double")
    def tail(k: pd.Series, mean: pd.Series) -> pd.Series:
        return pd.Series(log_poisson_tail(k.to_numpy(float), mean.to_numpy(float)))

    t = table(spark, d, "events").groupBy("user_id").agg((F.count_if(F.col("value") > 400) + F.col("user_id") % 9).alias("k"), (0.05 * F.count("*")).alias("mean"))
    return t.select("user_id", "k", r(tail("k", "mean") / F.log(F.lit(10.0)), 5).alias("log_p"))


@query("with t as (select user_id, 16 + user_id % 48 as length, user_id % 7 as distance from events group by 1), j as (select *, unnest(range(distance + 1)) as j from t) select user_id, length, distance, round(least(0.0, log10(sum(exp(lgamma(length + 1) - lgamma(j + 1) - lgamma(length - j + 1)))) - length / 2.0 * log10(2)), 6) + 0.0 as log_bound from j group by user_id, length, distance")
def block_bound(spark, d):
    """The bound on the chance that random bits lie so near a code word of half as many checks as bits."""
    import pandas as pd

    from ..functions.special import log_block_bound

    @F.pandas_udf("double")
    def bound(length: pd.Series, distance: pd.Series) -> pd.Series:
        return pd.Series([log_block_bound(int(n), int(k), n / 2) for n, k in zip(length, distance)])

    t = table(spark, d, "events").select("user_id").distinct().select("user_id", (16 + F.col("user_id") % 48).alias("length"), (F.col("user_id") % 7).alias("distance"))
    return t.select("*", r(bound("length", "distance") / F.log(F.lit(10.0))).alias("log_bound"))
