"""The registered queries and, where SQL can say the same, their oracles.

Every query runs over whole tables. Scores are rounded to six digits on both sides, because engines sum
in different orders.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsift.functions import scalars
from oddsift.functions.dist import chi2_quantile, critical_z, sidak_rate
from oddsift.operators import categorical, orderstats
from oddsift.operators.prepare import Prepared, equal_width_bins, looks_like_id, prepare, profile, with_row_id
from oddsift.operators.registry import fit
from oddsift.plans import audit, evaluate
from oddsift.plans.analyze import Analysis, Parameters, analyze
from oddsift.session import materialize, shared_folder
from oddsift.sources import sheets, sinks

RATE = 0.05
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


# ---------------------------------------------------------------- inputs

def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        "event_id", "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "event_type",
        F.hour("ts").cast("string").alias("hr"), F.dayofweek("ts").cast("string").alias("dw"),
    )


EVENTS = """
e as (select event_id, value, cast(json_extract(props, '$.k') as double) as k, event_type,
             cast(hour(ts) as varchar) as hr, cast(dayofweek(ts) + 1 as varchar) as dw from events)
"""


def event_numbers(spark, sf) -> Prepared:
    return prepare(events(spark, sf), ["value", "k"], [], "event_id")


def event_words(spark, sf, columns=("event_type", "hr", "dw")) -> Prepared:
    return prepare(events(spark, sf), [], list(columns), "event_id")


def judged(p: Prepared, model: str, key: str, *extra) -> DataFrame:
    out = fit(p, [model], RATE).add(p.df)
    return out.select(
        F.col("row_id").alias(key), F.round(f"{model}_score", 6).alias("score"), F.col(f"{model}_flag").alias("flag"),
        F.col(f"{model}_reason.column").alias("reason_column"), *extra,
    )


def lit(x: float) -> str:
    return f"cast({x!r} as double)"


# ---------------------------------------------------------------- numeric methods

_MOMENTS = "m as (select avg(value) va, stddev_pop(value) vs, avg(k) ka, stddev_pop(k) ks from e)"


@query("zscore", f"""
with {EVENTS}, {_MOMENTS},
z as (select event_id, (value - va) / vs zv, (k - ka) / ks zk from e, m)
select event_id, round(greatest(abs(zv), abs(zk)), 6) as score,
       greatest(abs(zv), abs(zk)) > {lit(critical_z(RATE, 2))} as flag,
       case when greatest(abs(zv), abs(zk)) > {lit(critical_z(RATE, 2))}
            then case when abs(zv) >= abs(zk) then 'value' else 'k' end end as reason_column,
       case when greatest(abs(zv), abs(zk)) > {lit(critical_z(RATE, 2))}
            then round(case when abs(zv) >= abs(zk) then zv else zk end, 6) end as stat
from z""")
def zscore(spark, sf):
    return judged(event_numbers(spark, sf), "zscore", "event_id", F.round("zscore_reason.stat", 6).alias("stat"))


@query("iqr", f"""
with {EVENTS},
q as (select quantile_cont(value, 0.25) v1, quantile_cont(value, 0.75) v3,
             quantile_cont(k, 0.25) k1, quantile_cont(k, 0.75) k3 from e),
d as (select event_id, greatest((v1 - value) / (v3 - v1), (value - v3) / (v3 - v1)) dv,
             greatest((k1 - k) / (k3 - k1), (k - k3) / (k3 - k1)) dk from e, q),
c as (select greatest(({lit(critical_z(RATE, 2))} - cast(0.6745 as double)) / cast(1.349 as double), cast(0.5 as double)) as m)
select event_id, round(greatest(dv, dk), 6) as score, greatest(dv, dk) > m as flag,
       case when greatest(dv, dk) > m then case when dv >= dk then 'value' else 'k' end end as reason_column
from d, c""")
def iqr(spark, sf):
    return judged(event_numbers(spark, sf), "iqr", "event_id")


_MAD = f"""
q as (select median(value) vm, median(k) km from e),
a as (select median(abs(value - vm)) vd, median(abs(k - km)) kd from e, q),
z as (select event_id, cast(0.6745 as double) * (value - vm) / vd zv, cast(0.6745 as double) * (k - km) / kd zk from e, q, a)
"""


@query("mad", f"""
with {EVENTS}, {_MAD}
select event_id, round(greatest(abs(zv), abs(zk)), 6) as score, greatest(abs(zv), abs(zk)) > 3.5 as flag,
       case when greatest(abs(zv), abs(zk)) > 3.5 then case when abs(zv) >= abs(zk) then 'value' else 'k' end end as reason_column
from z""")
def mad(spark, sf):
    return judged(event_numbers(spark, sf), "mad", "event_id")


@query("mahalanobis", f"""
with {EVENTS},
s as (select avg(value) ma, avg(k) mb, var_samp(value) saa, var_samp(k) sbb, covar_samp(value, k) sab from e),
d as (select event_id, value - ma as a, k - mb as b, saa, sbb, sab, saa * sbb - sab * sab as det from e, s),
p as (select event_id, a * (a * sbb - b * sab) / det as pa, b * (b * saa - a * sab) / det as pb from d)
select event_id, round(pa + pb, 6) as score, pa + pb > {lit(chi2_quantile(1 - RATE, 2))} as flag,
       case when pa + pb > {lit(chi2_quantile(1 - RATE, 2))} then case when pa >= pb then 'value' else 'k' end end as reason_column
from p""")
def mahalanobis(spark, sf):
    return judged(event_numbers(spark, sf), "mahalanobis", "event_id")


_A2 = sidak_rate(RATE, 2)


@query("percentile_fence", f"""
with {EVENTS},
q as (select quantile_cont(value, {lit(_A2 / 2)}) vl, quantile_cont(value, {lit(1 - _A2 / 2)}) vh,
             quantile_cont(k, {lit(_A2 / 2)}) kl, quantile_cont(k, {lit(1 - _A2 / 2)}) kh, count(*) n from e),
r as (select event_id, value, k,
             rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0 rv,
             rank() over (order by k) + (count(*) over (partition by k) - 1) / 2.0 rk from e),
s as (select event_id, abs(rv / n - 0.5) * 2 xv, abs(rk / n - 0.5) * 2 xk,
             (value < vl or value > vh) ov, (k < kl or k > kh) ok from r, q)
select event_id, round(cast(greatest(xv, xk) as double), 6) as score, ov or ok as flag,
       case when ov and (not ok or xv >= xk) then 'value' when ok then 'k' end as reason_column
from s""")
def percentile_fence(spark, sf):
    return judged(event_numbers(spark, sf), "percentile_fence", "event_id")


def top_flag(scores: str, key: str, rate: float = RATE, final: str = "") -> str:
    """CTEs and a select that flag the top share of a CTE ``s`` with (key, score)."""
    return f"""{scores},
n as (select count(*) n, greatest(1, cast(round_even({lit(rate)} * count(*), 0) as bigint)) top_n,
             min(score) lo, max(score) hi, arg_min(score, {key}) s0 from s),
o as (select score, row_number() over (order by score desc) rn from s),
t as (select score thr from o, n where rn = top_n),
c as (select count(*) cnt from s, t where score >= thr),
f as (select s.*, thr, greatest(hi - s0, s0 - lo) > 1e-8 + 1e-5 * abs(s0)
             and (case when cnt > 2 * top_n then score > thr else score >= thr end) as flag from s, n, t, c)
{final}"""


_CUSTOMERS = """
p as (select c_custkey, (c_acctbal - avg(c_acctbal) over ()) / stddev_pop(c_acctbal) over () as x,
             (c_nationkey - avg(c_nationkey) over ()) / stddev_pop(c_nationkey) over () as y from customer),
pair as (select a.c_custkey as id, b.c_custkey as other,
                round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), 10) as d
         from p a join p b on a.c_custkey <> b.c_custkey)
"""


def customer_numbers(spark, sf) -> Prepared:
    return prepare(table(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], [], "c_custkey")


#: the column farther from its mean, the first of equals
_FARTHER = "case when abs(x) >= abs(y) then 'c_acctbal' else 'c_nationkey' end"


@query("knn", top_flag(f"""
with {_CUSTOMERS},
w as (select least(greatest(5, cast(floor(sqrt(count(*))) as bigint)), count(*) - 1) as nk from customer),
r as (select id, d, row_number() over (partition by id order by d) rn from pair),
s as (select id as c_custkey, round(avg(d), 6) as score from r, w where rn <= nk group by id)""", "c_custkey",
                      final=f"select c_custkey, score, flag, case when flag then {_FARTHER} end as reason_column from f join p using (c_custkey)"))
def knn(spark, sf):
    return judged(customer_numbers(spark, sf), "knn", "c_custkey")


# the factors are defined to nine significant digits
_NINE_DIGITS = "round(x * pow(10, 8 - floor(log10(x)))) / pow(10, 8 - floor(log10(x)))"


@query("lof", f"""
with {_CUSTOMERS},
kd as (select id, max(d) kd from (select id, d, row_number() over (partition by id order by d) rn from pair) where rn <= 20 group by id),
near as (select pair.id, other, d, kd.kd, count(*) filter (where d < kd.kd) over (partition by pair.id) inner_n,
                count(*) over (partition by pair.id) all_n
         from pair join kd on pair.id = kd.id where d <= kd.kd),
take as (select id, other, d, case when d < kd then 1.0 else (20.0 - inner_n) / (all_n - inner_n) end as t from near),
lrd as (select take.id, 1 / (sum(t * greatest(d, kd.kd)) / 20 + 1e-10) as lrd from take join kd on take.other = kd.id group by take.id),
raw as (select take.id, sum(t * o.lrd) / 20 / max(own.lrd) as x
        from take join lrd o on take.other = o.id join lrd own on take.id = own.id group by take.id),
lof as (select id, {_NINE_DIGITS} as lof from raw),
q as (select -quantile_cont(-lof, 0.05) as cut from lof)
select id as c_custkey, round(lof, 6) as score, lof > cut as flag, case when lof > cut then {_FARTHER} end as reason_column
from lof join p on id = c_custkey, q""")
def lof(spark, sf):
    return judged(customer_numbers(spark, sf), "lof", "c_custkey")


@query("isolation_forest")
def isolation_forest(spark, sf):
    return judged(event_numbers(spark, sf), "isolation_forest", "event_id")


# ---------------------------------------------------------------- categorical methods

_FREQ = f"""
with {EVENTS},
f as (select *, count(*) over () n, count(*) over (partition by event_type) fa, count(*) over (partition by hr) fb,
             count(*) over (partition by dw) fc from e)
"""


@query("frequency", top_flag(f"""{_FREQ.replace("f as", "g as")},
s as (select event_id, -ln(least(fa, fb, fc) / cast(n as double)) as score,
             case when fa <= fb and fa <= fc then 'event_type' when fb <= fc then 'hr' else 'dw' end as col from g)""", "event_id",
      final="select event_id, round(score, 6) as score, flag, case when flag then col end as reason_column from f"))
def frequency(spark, sf):
    return judged(event_words(spark, sf), "frequency", "event_id")


_BITS = "(select sum(-c / cast(t as double) * log2(c / cast(t as double))) from (select count(*) c, sum(count(*)) over () t from e group by {0}))"


@query("entropy", top_flag(f"""{_FREQ.replace("f as", "g as")},
h as (select {_BITS.format('event_type')} ha, {_BITS.format('hr')} hb, {_BITS.format('dw')} hc),
s as (select event_id, round((-log2(fa / cast(n as double)) / ha - log2(fb / cast(n as double)) / hb
                        - log2(fc / cast(n as double)) / hc) / 3, 9) as score from g, h)""", "event_id",
      final="select event_id, round(score, 6) as score, flag from f"))
def entropy(spark, sf):
    return judged(event_words(spark, sf), "entropy", "event_id").drop("reason_column")


_PAIRS = f"""
with {EVENTS},
g as (select *, cast(count(*) over () as double) n, count(*) over (partition by event_type) fa, count(*) over (partition by hr) fb,
             count(*) over (partition by dw) fc, count(*) over (partition by event_type, hr) ab,
             count(*) over (partition by event_type, dw) ac, count(*) over (partition by hr, dw) bc from e)
"""


@query("chi_square", top_flag(f"""{_PAIRS},
s as (select event_id, round(greatest((fa * fb / n - ab) / sqrt(fa * fb / n), (fa * fc / n - ac) / sqrt(fa * fc / n),
                                (fb * fc / n - bc) / sqrt(fb * fc / n)), 9) as score from g)""", "event_id",
      final="select event_id, round(score, 6) as score, flag from f"))
def chi_square(spark, sf):
    return judged(event_words(spark, sf), "chi_square", "event_id").drop("reason_column")


@query("chi_square_one_column", top_flag("""
with g as (select o_orderkey, count(*) over (partition by o_orderpriority) c, count(*) over () n,
                  (select count(distinct o_orderpriority) from orders) kinds from orders),
s as (select o_orderkey, (n / cast(kinds as double) - c) / sqrt(n / cast(kinds as double)) as score from g)""", "o_orderkey",
      final="select o_orderkey, round(score, 6) as score, flag from f"))
def chi_square_one_column(spark, sf):
    p = prepare(table(spark, sf, "orders"), [], ["o_orderpriority"], "o_orderkey")
    return judged(p, "chi_square", "o_orderkey").drop("reason_column")


@query("cooccurrence", top_flag(f"""{_PAIRS},
s as (select event_id, round((-ln(ab / n) - ln(ac / n) - ln(bc / n)) / 3, 9) as score from g)""", "event_id",
      final="select event_id, round(score, 6) as score, flag from f"))
def cooccurrence(spark, sf):
    return judged(event_words(spark, sf), "cooccurrence", "event_id").drop("reason_column")


_TAIL = """
(select v, (select sum(exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln(p0) + (n - i) * ln(1 - p0)))
            from (select unnest(range(0, c + 1)) as i)) as pv
 from (select {0} as v, count(*) c, (select cast(count(*) as double) from e) n,
              least({1}, 1.0 / (select count(distinct {0}) from e)) p0 from e group by 1))
"""


@query("binomial", f"""
with {EVENTS},
a as {_TAIL.format('event_type', lit(RATE))}, b as {_TAIL.format('hr', lit(RATE))},
p as (select event_id, least(a.pv, b.pv) pv, case when a.pv <= b.pv then 'event_type' else 'hr' end col
      from e join a on e.event_type = a.v join b on e.hr = b.v)
select event_id, abs(round(-log10(least(greatest(pv, 1e-300), 1.0)), 6)) as score, pv < {lit(sidak_rate(RATE, 2))} as flag,
       case when pv < {lit(sidak_rate(RATE, 2))} then col end as reason_column
from p""")
def binomial(spark, sf):
    p = event_words(spark, sf, ("event_type", "hr"))
    return judged(p, "binomial", "event_id").withColumn("score", F.abs("score"))


@query("lof_categorical", f"""
with c as (select p_brand a, p_type b, count(*) w from part group by 1, 2),
g as (select cast(count(*) as bigint) n, least(greatest(20, cast(floor(sqrt(count(*))) as bigint)), count(*) - 1) k from part),
pair as (select x.a, x.b, y.a ya, y.b yb, sqrt(2.0 * ((x.a <> y.a)::int + (x.b <> y.b)::int)) d,
                y.w - (x.a = y.a and x.b = y.b)::int as w from c x, c y),
cum as (select *, sum(w) over (partition by a, b order by d) as upto from pair),
kd as (select a, b, min(d) kd from cum, g where upto >= k group by 1, 2),
near as (select pair.*, kd.kd, sum(case when d < kd.kd then w else 0 end) over (partition by pair.a, pair.b) before,
                sum(case when d = kd.kd then w else 0 end) over (partition by pair.a, pair.b) shell
         from pair join kd on pair.a = kd.a and pair.b = kd.b where d <= kd.kd),
take as (select a, b, ya, yb, d, case when d < kd then w else w * (k - before) / cast(shell as double) end t from near, g),
lrd as (select take.a, take.b, 1 / (sum(t * greatest(d, kd.kd)) / max(k) + 1e-10) lrd
        from take join kd on ya = kd.a and yb = kd.b, g group by 1, 2),
raw as (select take.a, take.b, sum(t * o.lrd) / max(k) / max(own.lrd) x
        from take join lrd o on ya = o.a and yb = o.b join lrd own on take.a = own.a and take.b = own.b, g group by 1, 2),
lof as (select a, b, {_NINE_DIGITS} as lof from raw),
r as (select p_partkey, lof from part join lof on p_brand = a and p_type = b),
q as (select -quantile_cont(-lof, 0.05) cut from r)
select p_partkey, round(lof, 6) as score, lof > cut as flag from r, q""")
def lof_categorical(spark, sf):
    p = prepare(table(spark, sf, "part"), [], ["p_brand", "p_type"], "p_partkey")
    return judged(p, "lof_categorical", "p_partkey").drop("reason_column")


# ---------------------------------------------------------------- shared statistics

_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("quantiles", " union all ".join(
    f"select '{c}' as column_name, round(quantile_cont({c}, 0.01), 6) as q01, round(quantile_cont({c}, 0.25), 6) as q25, "
    f"round(median({c}), 6) as q50, round(quantile_cont({c}, 0.75), 6) as q75, round(quantile_cont({c}, 0.99), 6) as q99 from lineitem"
    for c in _LINE))
def quantiles(spark, sf):
    df = table(spark, sf, "lineitem")
    n = df.count()
    got = orderstats.quantiles(df, {c: (F.col(c), n, [0.01, 0.25, 0.5, 0.75, 0.99]) for c in _LINE})
    rows = [(c, *[float(round(v, 6)) for v in q.values()]) for c, q in got.items()]
    return spark.createDataFrame(rows, "column_name string, q01 double, q25 double, q50 double, q75 double, q99 double")


@query("average_rank", """
select o_orderkey, cast(rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as double) as price_rank,
       cast(rank() over (order by o_custkey) + (count(*) over (partition by o_custkey) - 1) / 2.0 as double) as customer_rank
from orders""")
def average_rank(spark, sf):
    df = table(spark, sf, "orders")
    ranked = orderstats.average_ranks(df, {"p": F.col("o_totalprice"), "c": F.col("o_custkey")}, "o_orderkey", df.count())
    return ranked.groupBy("o_orderkey").agg(
        F.max(F.when(F.col("series") == 0, F.col("avg_rank"))).alias("price_rank"),
        F.max(F.when(F.col("series") == 1, F.col("avg_rank"))).alias("customer_rank"),
    )


@query("average_rank_by_ranges", """
select o_orderkey, cast(rank() over (order by o_totalprice) + (count(*) over (partition by o_totalprice) - 1) / 2.0 as double) as price_rank,
       cast(rank() over (order by o_custkey % 3) + (count(*) over (partition by o_custkey % 3) - 1) / 2.0 as double) as third_rank
from orders""")
def average_rank_by_ranges(spark, sf):
    """The plan for large tables: distinct values in ranges, totals carried from range to range, hot values salted."""
    df = table(spark, sf, "orders")
    series = {"p": F.col("o_totalprice"), "c": F.col("o_custkey") % 3}
    ranked = orderstats.average_ranks(df, series, "o_orderkey", df.count(), one_task_rows=0)
    return ranked.groupBy("o_orderkey").agg(
        F.max(F.when(F.col("series") == 0, F.col("avg_rank"))).alias("price_rank"),
        F.max(F.when(F.col("series") == 1, F.col("avg_rank"))).alias("third_rank"),
    )


@query("flag_top", top_flag("with s as (select event_id, value as score from events)", "event_id",
                            final="select event_id, score, flag from f"))
def flag_top(spark, sf):
    df = table(spark, sf, "events").select("event_id", F.col("value").alias("score"))
    cut = orderstats.top_cuts(df, {"s": F.col("score")}, df.count(), RATE, F.col("event_id"))["s"]
    return df.select("event_id", "score", cut.flags(F.col("score")).alias("flag"))


@query("relative_frequency", f"""{_FREQ}
select event_id, fa / cast(n as double) as f_type, fb / cast(n as double) as f_hour, fc / cast(n as double) as f_day from f""")
def relative_frequency(spark, sf):
    got = categorical.relative_frequencies(event_words(spark, sf))
    return got.select(F.col("row_id").alias("event_id"), F.col("f0").alias("f_type"), F.col("f1").alias("f_hour"),
                      F.col("f2").alias("f_day"))


@query("pair_counts", f"""
with {EVENTS}
select 0 as pair, event_type as va, hr as vb, count(*) as cnt from e group by all union all
select 1, event_type, dw, count(*) from e group by all union all
select 2, hr, dw, count(*) from e group by all""")
def pair_counts(spark, sf):
    c = categorical.combinations(event_words(spark, sf))
    return categorical.pair_counts(c, categorical.column_pairs(3)).select(F.col("k").alias("pair"), "va", "vb", "cnt")


# ---------------------------------------------------------------- text, profile, preparation

def order_texts(spark, sf) -> DataFrame:
    """Orders as a regional sheet would hold them: text with decimal commas, blanks and some unusable cells."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(key % 7 == 0, "  ").when(key % 50 == 1, "n/d").when(key % 11 == 0, F.lit(None).cast("string"))
        .when(key % 3 == 0, F.concat(F.lit("R$ "), scalars.regional_text(price.cast("decimal(18,2)"))))
        .otherwise(scalars.regional_text(price.cast("decimal(18,2)"))).alias("price"),
        F.when(key % 13 == 0, " ").otherwise(F.concat(F.lit(" "), F.col("o_orderstatus"))).alias("status"),
        F.col("o_orderpriority").alias("priority"), F.concat(F.lit("P"), key.cast("string")).alias("code"),
    )


_TEXTS = """
x as (select o_orderkey, o_totalprice,
             case when o_orderkey % 7 = 0 then '  ' when o_orderkey % 50 = 1 then 'n/d' when o_orderkey % 11 = 0 then null
                  when o_orderkey % 3 = 0 then 'R$ ' || replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',')
                  else replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',') end as price,
             case when o_orderkey % 13 = 0 then ' ' else ' ' || o_orderstatus end as status,
             o_orderpriority as priority, 'P' || o_orderkey as code from orders)
"""
_USABLE = "(price is not null and trim(price) <> '' and price <> 'n/d')"


@query("number_parse", f"""
with {_TEXTS}
select o_orderkey, case when {_USABLE} then o_totalprice end as price from x""")
def number_parse(spark, sf):
    return order_texts(spark, sf).select("o_orderkey", scalars.to_num(F.col("price")).alias("price"))


@query("text_fold", "select p_partkey, lower(strip_accents(trim(' Ção ÉÜñ ' || upper(p_name) || '  '))) as folded from part")
def text_fold(spark, sf):
    padded = F.concat(F.lit(" Ção ÉÜñ "), F.upper("p_name"), F.lit("  "))
    return table(spark, sf, "part").select("p_partkey", scalars.fold_text(padded).alias("folded"))


# Letters of several scripts, most with marks, that stand for a to z.
_SCRIPTS = "άέήίόύώϊϋΐёйїўàạấươễñ한국말ガ가"


@query("text_fold_scripts", f"""
with x as (select p_partkey, lower(strip_accents(translate(p_name, 'abcdefghijklmnopqrstuvwxyz', '{_SCRIPTS}'))) as t from part)
select p_partkey, array_to_string(list_transform(string_split(t, ''), lambda c: case when unicode(c) between 44032 and 55203
           then chr(4352 + (unicode(c) - 44032) // 588) || chr(4449 + (unicode(c) - 44032) % 588 // 28)
                || case when (unicode(c) - 44032) % 28 > 0 then chr(4519 + (unicode(c) - 44032) % 28) else '' end
           else c end), '') as folded from x""")
def text_fold_scripts(spark, sf):
    written = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz", _SCRIPTS)
    return table(spark, sf, "part").select("p_partkey", scalars.fold_text(written).alias("folded"))


@query("readable_number", """
select event_id, case when value = floor(value) then cast(cast(value as bigint) as varchar)
                      else rtrim(printf('%.2f', value), '0') end as shown,
       case when value = floor(value / 10) * 10 then cast(cast(value as bigint) as varchar)
            else rtrim(printf('%.2f', value), '0') end is not null as present
from events""")
def readable_number(spark, sf):
    return table(spark, sf, "events").select(
        "event_id", scalars.readable_number(F.col("value")).alias("shown"), F.lit(True).alias("present"))


@query("json_safe", "select event_id, case when event_id % 5 <> 0 then value end as value from events")
def json_safe(spark, sf):
    df = table(spark, sf, "events")
    holed = F.when(F.col("event_id") % 5 == 0, float("nan")).otherwise(F.col("value"))
    return df.select("event_id", scalars.json_safe(holed, df.schema["value"].dataType).alias("value"))


@query("list_split", """
select event_id, len(list_filter(string_split(event_type || ',,' || hour(ts), ','), lambda x: x <> '')) as parts,
       list_filter(string_split(event_type || ',,' || hour(ts), ','), lambda x: x <> '')[2] as second
from events""")
def list_split(spark, sf):
    joined = F.concat_ws(",", "event_type", F.lit(""), F.hour("ts").cast("string"))
    return table(spark, sf, "events").select("event_id", scalars.split_list(joined).alias("x")).select(
        "event_id", F.size("x").cast("bigint").alias("parts"), F.element_at("x", 2).alias("second"))


_PROFILE = """
select 'price' as name, case when count(*) filter (where {0}) >= 0.9 * count(*) filter (where price is not null and trim(price) <> '')
                         then 'numeric' else 'categorical' end as type,
       count(*) filter (where price is null or trim(price) = '') as missing,
       count(distinct price) filter (where trim(price) <> '') as "unique", false as looks_like_id from x union all
select 'status', 'categorical', count(*) filter (where trim(status) = ''), count(distinct status) filter (where trim(status) <> ''), false from x union all
select 'priority', 'categorical', 0, count(distinct priority), false from x union all
select 'code', 'categorical', 0, count(distinct code), count(distinct code) = count(*) from x
""".format(_USABLE)


@query("profile", f"with {_TEXTS} {_PROFILE}")
def profile_columns(spark, sf):
    got = looks_like_id(profile(order_texts(spark, sf).drop("o_orderkey")))
    return got.select("name", "type", "missing", "unique", "looks_like_id")


@query("prepare_numeric", f"""
with {_TEXTS}, m as (select median(o_totalprice) med from x where {_USABLE})
select o_orderkey, case when {_USABLE} then o_totalprice else round(med, 6) end as price from x, m""")
def prepare_numeric(spark, sf):
    p = prepare(order_texts(spark, sf), ["price"], [], "o_orderkey")
    return p.df.select(F.col("row_id").alias("o_orderkey"), F.round("n0", 6).alias("price"))


@query("prepare_categorical", f"""
with {_TEXTS}
select o_orderkey, case when trim(status) = '' then 'missing' else trim(status) end as status from x""")
def prepare_categorical(spark, sf):
    p = prepare(order_texts(spark, sf), [], ["status"], "o_orderkey")
    return p.df.select(F.col("row_id").alias("o_orderkey"), F.col("c0").alias("status"))


@query("standardise", f"""
with {EVENTS}, {_MOMENTS}
select event_id, round((value - va) / vs, 6) as z_value, round((k - ka) / ks, 6) as z_k from e, m""")
def standardise(spark, sf):
    p = event_numbers(spark, sf)
    z = p.standardised()
    return p.df.select(F.col("row_id").alias("event_id"), F.round(z[0], 6).alias("z_value"), F.round(z[1], 6).alias("z_k"))


@query("equal_width_bins", """
with m as (select min(o_totalprice) lo, max(o_totalprice) hi from orders)
select o_orderkey, 'f' || cast(greatest(0, ceil((o_totalprice - lo) / ((hi - lo) / 10)) - 1) as bigint) as price_bin from orders, m""")
def binned(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return equal_width_bins(df, ["o_totalprice"]).select("o_orderkey", F.col("o_totalprice").alias("price_bin"))


@query("class_as_anomaly", "select doc_id, cast(lang = 'fr' as integer) as label from documents")
def class_as_anomaly(spark, sf):
    return evaluate.class_as_anomaly(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "fr").select("doc_id", "label")


@query("class_subsample", """
select cast(lang = 'fr' as integer) as label, case when lang = 'fr' then least(count(*), 40) else count(*) end as rows
from documents group by 1, lang = 'fr'""")
def class_subsample(spark, sf):
    df = evaluate.class_as_anomaly(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "fr")
    return evaluate.class_subsample(df, 40, 0, "doc_id").groupBy("label").agg(F.count(F.lit(1)).alias("rows"))


@query("row_numbers", "select c_custkey, row_number() over (order by c_custkey) - 1 as row_id from customer")
def row_numbers(spark, sf):
    return with_row_id(table(spark, sf, "customer").select("c_custkey"), order=["c_custkey"]).select("c_custkey", "row_id")


# ---------------------------------------------------------------- analysis and report

MODELS = ("zscore", "mad", "frequency")
_analyses: dict[tuple, Analysis] = {}


def event_analysis(spark, sf) -> Analysis:
    """One analysis, kept for the queries that report on it."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _analyses:
        params = Parameters(MODELS, ("value", "k"), ("event_type", "hr"), RATE)
        _analyses[key] = analyze(events(spark, sf), params, "event_id")
    return _analyses[key]


def forget() -> None:
    """Drop the shared analyses and runs, so that the next query works them out itself."""
    _analyses.clear()
    _runs.clear()


_Z = critical_z(RATE, 2)
_ANALYSIS = top_flag(f"""
with {EVENTS}, {_MOMENTS},
q as (select median(value) vm, median(k) km from e),
a as (select median(abs(value - vm)) vd, median(abs(k - km)) kd from e, q),
g as (select e.*, abs((value - va) / vs) zv, abs((k - ka) / ks) zk, cast(0.6745 as double) * abs(value - vm) / vd mv,
             cast(0.6745 as double) * abs(k - km) / kd mk, count(*) over () total,
             count(*) over (partition by event_type) fa, count(*) over (partition by hr) fb from e, m, q, a),
s as (select event_id, value, k, event_type, hr, -ln(least(fa, fb) / cast(total as double)) as score, greatest(zv, zk) zs,
             greatest(zv, zk) > {lit(_Z)} zf, greatest(mv, mk) ms, greatest(mv, mk) > 3.5 mf, total,
             case when zv >= zk then 'value' else 'k' end zc, case when mv >= mk then 'value' else 'k' end mc,
             case when fa <= fb then 'event_type' else 'hr' end fc from g)""", "event_id", final=""",
v as (select *, zf::int + mf::int + flag::int as votes,
             rank() over (order by zs) + (count(*) over (partition by zs) - 1) / 2.0
             + rank() over (order by ms) + (count(*) over (partition by ms) - 1) / 2.0
             + rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as rank_sum from f),
a3 as (select *, cast(rank_sum as double) / (3.0 * total) as cons from v)
""")
_BY_MODEL = """
l as (select event_id, 'zscore' as model, zs as score, zf as flag, case when zf then zc end as col from a3 union all
      select event_id, 'mad', ms, mf, case when mf then mc end from a3 union all
      select event_id, 'frequency', score, flag, case when flag then fc end from a3)
"""


@query("results_long", f"{_ANALYSIS}, {_BY_MODEL} select event_id, model, round(score, 6) as score, flag, col as reason_column from l")
def results_long(spark, sf):
    return event_analysis(spark, sf).results.select(
        F.col("row_id").alias("event_id"), "model", F.round("score", 6).alias("score"), "flag",
        F.col("reason.column").alias("reason_column"))


@query("votes", f"{_ANALYSIS} select event_id, votes from v")
def votes(spark, sf):
    return event_analysis(spark, sf).votes.withColumnRenamed("row_id", "event_id")


@query("vote_bucket", f"""{_ANALYSIS}
select event_id, case when votes = 0 then 'none' when votes > 1.5 then 'majority' else 'minority' end as bucket from v""")
def vote_bucket(spark, sf):
    a = event_analysis(spark, sf)
    return a.votes.select(F.col("row_id").alias("event_id"), scalars.vote_bucket(F.col("votes"), len(a.models)).alias("bucket"))


@query("consensus_score", f"{_ANALYSIS} select event_id, round(cons, 6) as consensus_score from a3")
def consensus_score(spark, sf):
    return event_analysis(spark, sf).consensus_scores.select(
        F.col("row_id").alias("event_id"), F.round("consensus_score", 6).alias("consensus_score"))


_NAMED = "case model when 'zscore' then 'Z-Score' when 'mad' then 'Modified Z-Score (MAD)' else 'Frequência Relativa' end"


@query("model_summary", f"""{_ANALYSIS}, {_BY_MODEL}
select model as id, {_NAMED} as name, case when model = 'frequency' then 'categorical' else 'numeric' end as type,
       count(*) filter (where flag) as anomalies, round(count(*) filter (where flag) / cast(count(*) as double), 6) as rate,
       round(case model when 'zscore' then {lit(_Z)} when 'mad' then 3.5 else (select exp(-max(thr)) from f) end, 6) as threshold
from l group by model""")
def model_summary(spark, sf):
    return event_analysis(spark, sf).model_summary().select(
        "id", "name", "type", "anomalies", F.round("rate", 6).alias("rate"), F.round("threshold", 6).alias("threshold"))


@query("models_by_anomalies", f"""{_ANALYSIS}, {_BY_MODEL},
b as (select model, count(*) filter (where flag) as anomalies from l group by model)
select cast(row_number() over (order by anomalies desc, model) as integer) as place, model as id, anomalies from b""")
def models_by_anomalies(spark, sf):
    from pyspark.sql import Window

    # fourteen models at most, so one window orders them all
    place = F.row_number().over(Window.orderBy(F.desc("anomalies"), "id")).alias("place")
    return event_analysis(spark, sf).models_by_anomalies().select(place, "id", "anomalies")


@query("top_rows", f"""{_ANALYSIS}, {_BY_MODEL},
t5 as (select *, row_number() over (partition by model order by score desc, event_id) rn from l where flag)
select model, event_id + 1 as "row", round(score, 6) as score from t5""")
def top_rows(spark, sf):
    return event_analysis(spark, sf).top_rows().select("model", "row", F.round("score", 6).alias("score"))


_ORDERED = "row_number() over (order by votes desc, cons desc, event_id)"


@query("consensus_rows", f"""{_ANALYSIS}, r6 as (select *, {_ORDERED} rn from a3 where votes > 0)
select event_id + 1 as "row", votes, round(cons, 6) as consensus_score, event_type as value_event_type, hr as value_hr,
       cast(votes as bigint) as reasons
from r6""")
def consensus_rows(spark, sf):
    return event_analysis(spark, sf).consensus().select(
        "row", "votes", F.round("consensus_score", 6).alias("consensus_score"),
        F.element_at("values", "event_type").alias("value_event_type"), F.element_at("values", "hr").alias("value_hr"),
        F.size("reasons").cast("bigint").alias("reasons"))


@query("report_page", f"""{_ANALYSIS}, r6 as (select *, {_ORDERED} rn from a3 where votes > 0)
select event_id, votes, round(cons, 6) as consensus_score from r6 where rn > 500 and rn <= 525""")
def report_page(spark, sf):
    return event_analysis(spark, sf).page(20).select(
        F.col("row_id").alias("event_id"), "votes", F.round("consensus_score", 6).alias("consensus_score"))


@query("report_last_page", f"""{_ANALYSIS}, r6 as (select *, {_ORDERED} rn, count(*) over () as n from a3 where votes > 0)
select event_id, votes, round(cons, 6) as consensus_score from r6 where rn > (n - 1) // 25 * 25""")
def report_last_page(spark, sf):
    a = event_analysis(spark, sf)
    return a.page(a.pages() - 1).select(
        F.col("row_id").alias("event_id"), "votes", F.round("consensus_score", 6).alias("consensus_score"))


@query("printed_rows", f"""{_ANALYSIS}, r6 as (select *, {_ORDERED} rn from a3 where votes > 0)
select event_id, votes, (select count(*) from r6) as listed, cast(least(60, (select count(*) from r6)) as bigint) as shown
from r6 where rn <= 60""")
def printed_rows(spark, sf):
    return event_analysis(spark, sf).printed().select(
        F.col("row_id").alias("event_id"), "votes", "listed", F.col("shown").cast("bigint").alias("shown"))


@query("summary", f"""{_ANALYSIS}
select count(*) as rows, count(*) filter (where votes > 0) as flagged_rows,
       count(*) filter (where votes > 1.5) as flagged_by_majority, 3 as models_run from v""")
def summary(spark, sf):
    return event_analysis(spark, sf).summary()


_HIST = "h as (select cast(i as integer) as votes, (select count(*) from v where votes = i) as rows from range(0, 4) t(i))"


@query("votes_histogram", f"{_ANALYSIS}, {_HIST} select votes, rows from h")
def votes_histogram(spark, sf):
    return event_analysis(spark, sf).votes_histogram()


@query("nonzero_histogram", f"{_ANALYSIS}, {_HIST} select votes, rows from h where votes > 0")
def nonzero_histogram(spark, sf):
    return event_analysis(spark, sf).nonzero_histogram()


@query("numeric_statistics", f"with {EVENTS} " + " union all ".join(
    f"""select '{c}' as "column", count(*) as count, count(*) filter (where {c} is null) as missing, round(avg({c}), 6) as mean,
        round(stddev_samp({c}), 6) as std, min({c}) as min, round(quantile_cont({c}, 0.25), 6) as q1, round(median({c}), 6) as median,
        round(quantile_cont({c}, 0.75), 6) as q3, max({c}) as max from e""" for c in ("value", "k")))
def numeric_statistics(spark, sf):
    rounded = ["mean", "std", "q1", "median", "q3"]
    got = event_analysis(spark, sf).numeric_statistics()
    return got.select(*[F.round(c, 6).alias(c) if c in rounded else c for c in got.columns])


_CAT_STATS = f"with {EVENTS}, " + "st as (" + " union all ".join(
    f"""select '{c}' as "column", cast(sum(n) as bigint) as count, count(*) as "unique",
        (select v from (select {c} v, count(*) n from e group by 1) order by n desc, v limit 1) as top, max(n) as top_freq,
        cast(coalesce(sum(n) filter (where v = 'missing'), 0) as bigint) as missing
        from (select {c} v, count(*) n from e group by 1)""" for c in ("event_type", "hr")) + ")"


@query("categorical_statistics", f"{_CAT_STATS} select * from st")
def categorical_statistics(spark, sf):
    return event_analysis(spark, sf).categorical_statistics()


@query("top_share", f"""{_CAT_STATS} select "column", top, round(top_freq / cast(count as double), 6) as top_share from st""")
def top_share(spark, sf):
    return event_analysis(spark, sf).top_share().select("column", "top", F.round("top_share", 6).alias("top_share"))


@query("scatter", f"""{_ANALYSIS} select event_id + 1 as "row", value as x, k as y, votes from a3""")
def scatter(spark, sf):
    return event_analysis(spark, sf).scatter()


@query("cited_columns", f"""{_ANALYSIS}, {_BY_MODEL}
select event_id, string_agg(distinct col, ',' order by col) as cited from l where flag group by event_id""")
def cited_columns(spark, sf):
    got = event_analysis(spark, sf).cited()
    return got.select(F.col("row_id").alias("event_id"), F.array_join("cited", ",").alias("cited"))


@query("cited_in_text", f"""{_ANALYSIS}, {_BY_MODEL}
select event_id, string_agg(distinct col, ',' order by col) as cited from l where flag group by event_id""")
def cited_in_text(spark, sf):
    a = event_analysis(spark, sf)
    said = a.results.filter("flag").groupBy("row_id").agg(F.collect_list("reason.message").alias("said"))  # one per model
    names = [*a.params.numeric_columns, *a.params.categorical_columns]
    found = F.array_join(F.array_sort(scalars.cited_columns(F.col("said"), names)), ",")
    return said.select(F.col("row_id").alias("event_id"), found.alias("cited"))


_MARKED = """select event_id, value, zf::int as anomalia_zscore, mf::int as anomalia_mad, flag::int as anomalia_frequency,
       votes as votos, cast(round_even(cast(cons as decimal(20,14)), 4) as double) as score_consenso from a3"""


@query("marked_table", f"{_ANALYSIS} {_MARKED}")
def marked_table(spark, sf):
    return event_analysis(spark, sf).marked().select(
        "event_id", "value", *[f"anomalia_{m}" for m in MODELS], "votos", "score_consenso")


@query("cleaned_table", f"{_ANALYSIS} select event_id, value, event_type from a3 where votes = 0")
def cleaned_table(spark, sf):
    return event_analysis(spark, sf).cleaned().select("event_id", "value", "event_type")


def scratch(spark, label: str) -> str:
    return os.path.join(shared_folder(spark), f"{label}-{uuid.uuid4().hex}")


@query("regional_csv", f"{_ANALYSIS} select event_id, value, votes as votos from a3")
def regional_csv(spark, sf):
    path = scratch(spark, "regional")
    sinks.write_regional_csv(event_analysis(spark, sf).marked().select("event_id", "value", "votos"), path)
    back = sheets.read_csv(spark, path, "UTF-8", ";", multiline=False)
    return back.select(F.col("event_id").cast("bigint").alias("event_id"), scalars.to_num(F.col("value")).alias("value"),
                       F.col("votos").cast("int").alias("votos"))


@query("report_document", f"""{_ANALYSIS}
select count(*) as rows, count(*) filter (where votes > 0) as consensus_rows, cast(3 as bigint) as models,
       cast(4 as bigint) as histogram_rows from v""")
def report_document(spark, sf):
    path = scratch(spark, "document")
    lines = event_analysis(spark, sf).document_lines()
    sinks.write_document(lines, path)
    doc = spark.read.schema(lines.schema).json(path)
    return doc.agg(
        F.max("summary.rows").alias("rows"), F.count_if(F.col("section") == "consensus").alias("consensus_rows"),
        F.max(F.size("models")).cast("bigint").alias("models"),
        F.max(F.size("votes_histogram")).cast("bigint").alias("histogram_rows"))


# ---------------------------------------------------------------- files

def customer_sheets(spark, sf) -> str:
    """The customer table as a folder of Latin-1 files with semicolons and decimal commas."""
    path = scratch(spark, "sheets")
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" cliente "), F.concat(F.lit("São "), F.col("c_name")).alias("nome"),
        scalars.regional_text(F.col("c_acctbal").cast("decimal(18,2)")).alias("saldo"),
        F.when(F.col("c_custkey") % 10 == 0, "N/A").otherwise(F.col("c_mktsegment")).alias("segmento"),
        F.lit(None).cast("string").alias("vazio"),
    )
    df.write.option("sep", ";").option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return path


@query("sniff", "select 'ISO-8859-1' as encoding, ';' as separator")
def sniff(spark, sf):
    path = customer_sheets(spark, sf)
    return sheets.sniff(spark, path).select("encoding", "separator").distinct()


@query("read_sheet", """
select c_custkey, 'São ' || c_name as nome, c_acctbal as saldo,
       case when c_custkey % 10 <> 0 then c_mktsegment end as segmento from customer""")
def read_sheet(spark, sf):
    df = sheets.read_sheet(spark, customer_sheets(spark, sf))
    return df.select(F.col("cliente").cast("bigint").alias("c_custkey"), "nome", scalars.to_num(F.col("saldo")).alias("saldo"), "segmento")


@query("read_mixed_folder", "select c_custkey, 'ção ' || c_name as nome, c_acctbal as saldo from customer")
def read_mixed_folder(spark, sf):
    """Files of two encodings, separators and column orders, read as one table."""
    path = scratch(spark, "mixed")
    df = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("cliente"), F.concat(F.lit("ção "), F.col("c_name")).alias("nome"),
        scalars.regional_text(F.col("c_acctbal").cast("decimal(18,2)")).alias("saldo"))
    even = F.col("cliente") % 2 == 0
    df.filter(even).write.options(sep=";", header=True, encoding="ISO-8859-1").csv(f"{path}/a")
    df.filter(~even).select("saldo", "nome", "cliente").write.options(sep="\t", header=True).csv(f"{path}/b")
    got = sheets.read_sheet(spark, [f"{path}/a", f"{path}/b"])
    return got.select(F.col("cliente").cast("bigint").alias("c_custkey"), "nome", scalars.to_num(F.col("saldo")).alias("saldo"))


@query("sheet_row_numbers", "select count(*) as rows, count(*) as distinct_ids, cast(0 as bigint) as low, count(*) - 1 as high from customer")
def sheet_row_numbers(spark, sf):
    rows = sheets.read_csv(spark, customer_sheets(spark, sf))
    return with_row_id(rows).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("row_id").alias("distinct_ids"), F.min("row_id").alias("low"),
        F.max("row_id").alias("high"))


@query("content_fingerprint", """
select r_name, octet_length(encode(r_name || chr(10))) as length, sha256(r_name || chr(10)) as sha256 from region""")
def content_fingerprint(spark, sf):
    """Each region's name as the one line of a file of its own."""
    path = scratch(spark, "fingerprints")
    table(spark, sf, "region").select(F.col("r_name").alias("folder"), F.col("r_name").alias("value")).write.partitionBy("folder").text(path)
    return sheets.fingerprints(spark, f"{path}/folder=*").select(
        F.url_decode(F.regexp_extract("path", "folder=([^/]*)/", 1)).alias("r_name"), "length", "sha256")


@query("file_checks", """
select case when n_nationkey < 8 then 'too large' when n_nationkey < 16 then 'unsupported kind' else 'no data rows' end as reason, count(*) as files
from nation group by 1""")
def file_checks(spark, sf):
    """A file per nation: long ones, ones of another kind, and ones with a header only."""
    path, key = scratch(spark, "checks"), F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("folder"), F.when(key < 8, F.repeat("n_name", F.lit(1000))).otherwise(F.col("n_name")).alias("value"), key)
    kinds = ((key < 8) | (key >= 16), "csv"), ((key >= 8) & (key < 16), "dat")
    for which, kind in kinds:
        rows.filter(which).select("folder", "value").write.mode("append").partitionBy("folder").format("csv" if kind == "csv" else "text").save(f"{path}/{kind}")
    return sheets.rejects(spark, f"{path}/*/folder=*", max_bytes=2000).groupBy("reason").agg(F.count(F.lit(1)).alias("files"))


@query("document_hashes", "select doc_id, sha256(text) as sha256 from documents")
def document_hashes(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha256"))


def nation_files(spark, sf) -> str:
    """One file per nation with a line for each of its customers in key order.

    Every third nation's file is of another kind; from nation 20 on, all lines but the first are blank.
    """
    path, nation = scratch(spark, "nations"), F.col("c_nationkey")
    rows = table(spark, sf, "customer")
    first = rows.groupBy(nation.alias("folder")).agg(F.min("c_custkey").alias("first"))
    line = F.when((nation >= 20) & (F.col("c_custkey") > F.col("first")), " ").otherwise(F.concat_ws(";", "c_custkey", "c_name"))
    rows = rows.join(F.broadcast(first), nation == F.col("folder")).select("folder", line.alias("value"), "c_custkey")
    for kind, those in (("text", F.col("folder") % 3 == 0), ("csv", F.col("folder") % 3 != 0)):
        files = rows.filter(those).repartition("folder").sortWithinPartitions("folder", "c_custkey").select("folder", "value")
        files.write.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).partitionBy("folder").format(kind).save(f"{path}/{kind}")
    return f"{path}/*/folder=*"


_NATION_FILES = """
with f as (select c_custkey, c_nationkey, case when c_nationkey >= 20 and c_custkey > min(c_custkey) over (partition by c_nationkey)
             then ' ' else c_custkey || ';' || c_name end as line from customer),
files as (select c_nationkey as nation, count(*) filter (where line <> ' ') as filled,
            string_agg(line || chr(10), '' order by c_custkey) as content from f group by 1),
sized as (select nation, filled, octet_length(encode(content)) as length, sha256(content) as sha256 from files)"""


def _nation(path: str = "path"):
    return F.regexp_extract(path, "folder=([^/]*)/", 1).cast("int").alias("nation")


@query("customer_file_fingerprints", f"{_NATION_FILES} select nation, length, sha256 from sized")
def customer_file_fingerprints(spark, sf):
    return sheets.fingerprints(spark, nation_files(spark, sf)).select(_nation(), "length", "sha256")


@query("customer_file_checks", f"""{_NATION_FILES}
select nation, length, case when length > (select sum(length) // count(*) from sized) then 'too large'
       when nation % 3 = 0 then 'unsupported kind' when filled < 2 then 'no data rows' end as reason from sized""")
def customer_file_checks(spark, sf):
    """The limit is the mean length, so that every reason occurs at every scale."""
    path = nation_files(spark, sf)
    sizes = sheets.fingerprints(spark, path).select("path", "length")
    mean = sizes.agg(F.expr("sum(length) div count(*)").alias("mean")).first()["mean"]
    bad = sheets.rejects(spark, path, max_bytes=mean)
    return sizes.join(bad, "path", "left").select(_nation(), "length", "reason")


def oddly_named_files(spark, sf) -> str:
    """One file per nation under a name with a blank, an accent, a plus and a percent sign; two kinds of header.

    Files of nations from 20 on hold one blank line only.
    """
    path, nation = scratch(spark, "odd-names"), F.col("c_nationkey")
    folder = F.concat(F.lit("março + 100% ["), nation, F.lit("]"))
    rows = table(spark, sf, "customer")
    line = F.when(nation % 2 == 0, F.concat_ws(";", "c_custkey", "c_name")).otherwise(F.concat_ws(",", "c_name", "c_mktsegment", "c_custkey"))
    filled = rows.where(nation < 20).select(nation, "c_custkey", line.alias("value"))
    head = rows.groupBy(nation).agg(F.lit(-1).cast("bigint").alias("c_custkey"))
    head = head.withColumn("value", F.when(nation >= 20, " ").when(nation % 2 == 0, "id;nome").otherwise("nome,ramo,id"))
    lines = filled.unionByName(head).withColumn("folder", folder)
    ordered = lines.repartition("folder").sortWithinPartitions("folder", "c_custkey").select("folder", "value")
    ordered.write.options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).partitionBy("folder").csv(path, sep="\x01", quote="", escape="")
    return f"{path}/folder=*"


@query("oddly_named_sheets", """
select cast(c_custkey as varchar) as id, c_name as nome, case when c_nationkey % 2 = 1 then c_mktsegment end as ramo
from customer where c_nationkey < 20""")
def oddly_named_sheets(spark, sf):
    return sheets.read_csv(spark, oddly_named_files(spark, sf)).where("id is not null").select("id", "nome", "ramo")


@query("oddly_named_checks", """
select c_nationkey as nation, case when c_nationkey >= 20 then 'unreadable' end as reason from customer group by 1""")
def oddly_named_checks(spark, sf):
    path = oddly_named_files(spark, sf)
    names = sheets.fingerprints(spark, path).select("path")
    bad = sheets.rejects(spark, path)
    return names.join(bad, "path", "left").select(F.regexp_extract("path", "(\\d+)(\\]|%5D)/", 1).cast("int").alias("nation"), "reason")


# ---------------------------------------------------------------- audit log

NOW = datetime(2024, 1, 2, tzinfo=timezone.utc)


def audit_records(spark, sf) -> DataFrame:
    """One input record per document, five seconds apart, ending at NOW."""
    d = table(spark, sf, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(".csv")).alias("filename"),
        F.concat(F.lit("in/"), F.col("doc_id")).alias("storage_key"), F.col("n_chars").alias("size_bytes"),
        F.sha2("text", 256).alias("sha256"), F.col("n_chars").alias("rows"),
        F.array().cast("array<struct<name:string,type:string,missing:bigint,unique:bigint>>").alias("columns"),
        F.timestamp_seconds(F.lit(int(NOW.timestamp())) - F.col("doc_id") * 5).alias("created_at"),
    )


def audit_log(spark, sf) -> audit.AuditLog:
    log = audit.AuditLog(spark, scratch(spark, "audit"))
    log.append_files(audit_records(spark, sf))
    return log


@query("audit_lookup", "select cast(doc_id as varchar) as id, source || '.csv' as filename, n_chars as size_bytes, sha256(text) as sha256 from documents where doc_id = 7")
def audit_lookup(spark, sf):
    return audit_log(spark, sf).file_fields("7").select("id", "filename", "size_bytes", "sha256")


@query("audit_older_than", "select cast(doc_id as varchar) as id from documents where doc_id * 5 > 600")
def audit_older_than(spark, sf):
    return audit_log(spark, sf).files_older_than(datetime.fromtimestamp(NOW.timestamp() - 600, timezone.utc)).select("id")


@query("audit_retention", """
select case when doc_id * 5 > 600 then 'removed' else 'kept' end as state, cast(doc_id as varchar) as id from documents""")
def audit_retention(spark, sf):
    log = audit_log(spark, sf)
    removed = log.retain(10, NOW)
    return removed.select(F.lit("removed").alias("state"), "id").unionByName(log.files().select(F.lit("kept").alias("state"), "id"))


@query("audit_history", f"""{_ANALYSIS}, {_BY_MODEL},
m5 as (select model, count(*) filter (where flag) as anomalies from l group by model)
select model, anomalies, (select count(*) from v) as rows, 'events' as filename from m5""")
def audit_history(spark, sf):
    log = audit.AuditLog(spark, scratch(spark, "audit"))
    log.append_analysis(event_analysis(spark, sf), "f1", "events", "-", NOW)
    return log.analyses("f1").select("filename", F.col("summary.rows").alias("rows"), F.explode("summary.por_modelo").alias("model", "anomalies"))


_ASKED = [Parameters(("zscore", "mad"), ("n_chars",)), Parameters(("frequency",), (), ("lang", "source"), 0.02)]


@query("audit_reuse", """
with f as (select substr(sha1('{"categorical_columns": [], "models": ["zscore", "mad"], "numeric_columns": ["n_chars"], "threshold": 0.05}'), 1, 16) a,
                  substr(sha1('{"categorical_columns": ["lang", "source"], "models": ["frequency"], "numeric_columns": [], "threshold": 0.02}'), 1, 16) b)
select cast(doc_id as varchar) as file_id, case when doc_id % 2 = 0 then a else b end as fingerprint
from documents, f where case when doc_id % 2 = 0 then doc_id % 3 <> 0 else doc_id % 5 <> 0 end""")
def audit_reuse(spark, sf):
    """Every document asks for one of two analyses; the log answers some, and some of them twice."""
    files = audit_records(spark, sf).select(F.col("id").alias("file_id"), "filename", "sha256", "created_at")
    key, (a, b) = F.col("file_id").cast("bigint"), _ASKED
    log = audit.AuditLog(spark, scratch(spark, "audit"))
    for p, some in ((a, key % 3 == 0), (b, key % 5 == 0), (a, key % 9 == 0)):
        log.append_analyses(files.filter(some).select(
            F.expr("uuid()").alias("id"), "*", audit.parameters_column(p).alias("parameters"),
            F.lit(p.fingerprint()).alias("fingerprint")))
    asked = F.when(key % 2 == 0, a.fingerprint()).otherwise(b.fingerprint())
    return log.unseen(files.select("file_id", asked.alias("fingerprint")))


# ---------------------------------------------------------------- evaluation

EVAL_MODELS = ["zscore", "iqr"]
EVAL_FEATURES = ["n_chars", "n_spaces"]


def labelled(spark, sf, label: str) -> DataFrame:
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("row_id"), "n_chars", (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit("")))).alias("n_spaces"))
    marks = table(spark, sf, "labels").select(F.col("doc_id").alias("row_id"), (
        (1 - F.col("quality")) if label == "quality" else F.col("toxic")).alias("label"))
    return docs.join(marks, "row_id")


def labelled_scores(spark, sf, label: str = "quality") -> DataFrame:
    df = materialize(labelled(spark, sf, label), "labelled")
    rate = df.agg(F.avg("label")).first()[0]
    return evaluate.score_dataset(df, EVAL_FEATURES, EVAL_MODELS, rate)


def _scores_sql(label: str, tag: str) -> str:
    """CTEs ending in {tag}(id, model, score, flag, label), with c the true rate."""
    mark = "1 - quality" if label == "quality" else "toxic"
    return f"""
{tag}d as (select d.doc_id id, cast(n_chars as double) a, cast(length(text) - length(replace(text, ' ', '')) as double) b, {mark} as label
      from documents d join labels l on d.doc_id = l.doc_id),
{tag}m as (select avg(a) ma, stddev_pop(a) sa, avg(b) mb, stddev_pop(b) sb, quantile_cont(a, 0.25) a1, quantile_cont(a, 0.75) a3,
             quantile_cont(b, 0.25) b1, quantile_cont(b, 0.75) b3, avg(label) c from {tag}d),
{tag}s as (select id, label, greatest(abs(a - ma) / sa, abs(b - mb) / sb) z,
             greatest((a1 - a) / (a3 - a1), (a - a3) / (a3 - a1), (b1 - b) / (b3 - b1), (b - b3) / (b3 - b1)) q from {tag}d, {tag}m),
{tag} as (select id, 'zscore' as model, z as score, z > $ZCUT_{tag}$ as flag, label from {tag}s union all
      select id, 'iqr', q, q > greatest(($ZCUT_{tag}$ - cast(0.6745 as double)) / cast(1.349 as double), cast(0.5 as double)), label from {tag}s)
"""


def _with_cuts(sql: str) -> str:
    """DuckDB has no normal quantile, so the cut is bisected on a table of its integral."""
    for tag in ("lq", "lt"):
        cut = f"(select z from {tag}cut)"
        sql = sql.replace(f"$ZCUT_{tag}$", cut)
    return sql


def _cut_sql(tag: str) -> str:
    # inverse normal by Newton steps on a rational start: the integral comes from the error function's series
    return f"""
{tag}cut as (
  with recursive a as (select 1 - (1 - c) ** 0.5 as alpha from {tag}m),
  step(i, z) as (
    select 0, cast(2.0 as double)
    union all
    select i + 1, z + ((1 - alpha / 2) - (0.5 + (select sum(case when n % 2 = 0 then 1 else -1 end * exp((2 * n + 1) * ln(z) - n * ln(2) - lgamma(n + 1.0)) / (2 * n + 1))
                       from range(0, 60) t(n)) / sqrt(2 * pi()))) / (exp(-z * z / 2) / sqrt(2 * pi()))
    from step, a where i < 12)
  select z from step where i = 12)
"""


def _eval_sql(label: str, tag: str) -> str:
    parts = _scores_sql(label, tag)
    at = parts.index(f"{tag}s as")
    return _with_cuts(parts[:at] + _cut_sql(tag).strip() + ",\n" + parts[at:])


def _confusion_sql(tag: str, out: str) -> str:
    return f"""
{out}c as (select model, count(*) filter (where flag and label = 1) tp, count(*) filter (where flag and label = 0) fp,
             count(*) filter (where not flag and label = 1) fn, count(*) filter (where not flag and label = 0) tn from {tag} group by model),
{out}p as (select *, coalesce(tp / nullif(cast(tp + fp as double), 0), 0) as precisao, coalesce(tp / nullif(cast(tp + fn as double), 0), 0) as recall,
             coalesce(tn / nullif(cast(tn + fp as double), 0), 0) as especificidade, (tp + fn) / cast(tp + fp + fn + tn as double) as taxa_real,
             (tp + fp) / cast(tp + fp + fn + tn as double) as taxa_prevista from {out}c),
{out}f as (select *, coalesce(2 * precisao * recall / nullif(precisao + recall, 0), 0) as f1 from {out}p),
{out}k as (select model, label, rank() over (partition by model order by score) + (count(*) over (partition by model, score) - 1) / 2.0 as rk from {tag}),
{out}a as (select model, cast((sum(rk) filter (where label = 1) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) as double) as auc_roc
      from {out}k group by model),
{out} as (select {out}f.*, f1 / taxa_real as lift_f1, auc_roc from {out}f join {out}a on {out}f.model = {out}a.model)
"""


_Q = f"with {_eval_sql('quality', 'lq')}, {_confusion_sql('lq', 'mq')}"


@query("confusion_metrics", f"""{_Q}
select model, tp, fp, fn, tn, round(precisao, 6) as precisao, round(recall, 6) as recall, round(especificidade, 6) as especificidade,
       round(taxa_real, 6) as taxa_real, round(taxa_prevista, 6) as taxa_prevista, round(f1, 6) as f1, round(lift_f1, 6) as lift_f1 from mq""")
def confusion_metrics(spark, sf):
    got = evaluate.confusion(labelled_scores(spark, sf))
    counts = ["model", "tp", "fp", "fn", "tn"]
    return got.select(*counts, *[F.round(c, 6).alias(c) for c in got.columns if c not in counts])


@query("auc_roc", f"{_Q} select model, round(auc_roc, 6) as auc_roc from mq")
def auc_roc(spark, sf):
    return evaluate.auc_roc(labelled_scores(spark, sf), EVAL_MODELS).select("model", F.round("auc_roc", 6).alias("auc_roc"))


@query("roc_curve", f"""{_Q},
w as (select model, score, count(*) n, sum(label) pos from lq group by 1, 2),
c as (select model, score, sum(n - pos) over o as fp, sum(pos) over o as tp, sum(n - pos) over (partition by model) n0, sum(pos) over (partition by model) n1
      from w window o as (partition by model order by score desc))
select model, round(score, 6) as score, round(cast(fp / n0 as double), 6) as fpr, round(cast(tp / n1 as double), 6) as tpr from c""")
def roc_curve(spark, sf):
    return evaluate.roc_curve(labelled_scores(spark, sf), EVAL_MODELS).select(
        "model", *[F.round(c, 6).alias(c) for c in ("score", "fpr", "tpr")])


_runs: dict[tuple, DataFrame] = {}


def evaluation(spark, sf) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf)
    if key not in _runs:
        datasets = [(name, 0, materialize(labelled(spark, sf, name), "labelled"), EVAL_FEATURES) for name in ("quality", "toxic")]
        _runs[key] = materialize(evaluate.evaluate(datasets, EVAL_MODELS), "evaluation")
    return _runs[key]


_GRID = f"""{_Q}, {_eval_sql('toxic', 'lt')}, {_confusion_sql('lt', 'mt')},
cols as (select 'quality' as dataset, model, f1, precisao, recall, especificidade, auc_roc, taxa_real, taxa_prevista, lift_f1 from mq union all
         select 'toxic', model, f1, precisao, recall, especificidade, auc_roc, taxa_real, taxa_prevista, lift_f1 from mt union all
         select 'quality', 'aleatorio', c, c, c, 1 - c, 0.5, c, c, 1.0 from lqm union all
         select 'toxic', 'aleatorio', c, c, c, 1 - c, 0.5, c, c, 1.0 from ltm),
named as (select *, case model when 'zscore' then 'Z-Score' when 'iqr' then 'IQR (Tukey)' else 'Aleatório (linha de base)' end as nome from cols)
"""
_ROUNDED = ", ".join(f"round({c}, 6) as {c}" for c in evaluate.METRICS)


@query("evaluation_grid", f"{_GRID} select model as modelo, nome, dataset, 0 as semente, {_ROUNDED} from named")
def evaluation_grid(spark, sf):
    return evaluation(spark, sf).select(
        "modelo", "nome", "dataset", "semente", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


@query("random_baseline", f"{_GRID} select dataset, {_ROUNDED} from named where model = 'aleatorio'")
def random_baseline(spark, sf):
    rates = None
    for name in ("quality", "toxic"):
        one = labelled(spark, sf, name).agg(F.avg("label").alias("taxa_real")).select(
            F.lit(name).alias("dataset"), F.lit(0).alias("semente"), "taxa_real")
        rates = one if rates is None else rates.unionByName(one)
    got = evaluate.random_baseline(rates)
    return got.select("dataset", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


_MEANS = ", ".join(f"round(avg({c}), 6) as {c}" for c in evaluate.METRICS)


@query("mean_per_dataset", f"{_GRID} select model as modelo, dataset, {_MEANS} from named group by model, dataset")
def mean_per_dataset(spark, sf):
    """The table as it is written for readers: through its CSV file and back."""
    path = scratch(spark, "means")
    got = evaluate.mean_per_dataset(evaluation(spark, sf))
    sinks.write_table(got.select("modelo", "dataset", *[F.round(c, 6).alias(c) for c in evaluate.METRICS]), path)
    numbers = ", ".join(f"{c} double" for c in evaluate.METRICS)
    return spark.read.option("header", True).schema(f"modelo string, dataset string, {numbers}").csv(path)


@query("mean_per_model", f"{_GRID} select model as modelo, {_MEANS} from named group by model")
def mean_per_model(spark, sf):
    got = evaluate.mean_per_model(evaluate.mean_per_dataset(evaluation(spark, sf)))
    return got.select("modelo", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


@query("metric_pivot", f"""{_GRID}
select nome, round(max(case when dataset = 'quality' then f1 end), 3) as quality, round(max(case when dataset = 'toxic' then f1 end), 3) as toxic
from named group by nome""")
def metric_pivot(spark, sf):
    return evaluate.pivot_metric(evaluate.mean_per_dataset(evaluation(spark, sf)), "f1", ["quality", "toxic"])


@query("findings", f"""{_GRID},
pm as (select model, nome, avg(f1) f1, avg(auc_roc) auc, avg(especificidade) esp, avg(taxa_real) tr, avg(taxa_prevista) tp from named group by 1, 2),
rm as (select * from pm where model <> 'aleatorio'), rd as (select * from named where model <> 'aleatorio'),
md as (select dataset, median(auc_roc) a from rd group by 1)
select 'random_f1' as finding, nome as subject, round(f1, 6) as value from pm where model = 'aleatorio' union all
select * from (select 'best_f1', nome, round(f1, 6) from rm order by f1 desc, nome limit 1) union all
select * from (select 'best_auc', nome, round(auc, 6) from rm order by auc desc, nome limit 1) union all
select * from (select 'best_specificity', nome, round(esp, 6) from rm order by esp desc, nome limit 1) union all
select * from (select 'best_lift', nome || '/' || dataset, round(lift_f1, 6) from rd order by lift_f1 desc, nome limit 1) union all
select 'auc_below_chance', nome, round(auc, 6) from rm where auc < 0.5 union all
select 'flags_over_twice_the_rate', nome, round(tp, 6) from rm where tp > 2 * tr union all
select 'dataset_below_chance', dataset, round(a, 6) from md where a < 0.5""")
def findings(spark, sf):
    per_dataset = evaluate.mean_per_dataset(evaluation(spark, sf))
    got = evaluate.findings(per_dataset, evaluate.mean_per_model(per_dataset))
    return got.select("finding", "subject", F.round("value", 6).alias("value"))
