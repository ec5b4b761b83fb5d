"""Queries over transforms, sketches, sequences and nearest neighbours."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators import mixture, nearest, sequences, sketches
from netquill.operators import transforms as T
from netquill.plans import transform_plan
from netquill.plans.queries_stats import _round
from netquill.queries import FLOWS, flows, load, query
from netquill.sources import tables

_COLS = ["in_bytes", "in_pkts", "discount"]


def _keyed(s, d, *cols: str) -> DataFrame:
    t = load(s, d, "lineitem")
    return t.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("in_bytes"), F.col("l_quantity").alias("in_pkts"), F.col("l_discount").alias("discount"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_suppkey").alias("src"))


_K = "k AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS in_bytes, l_quantity AS in_pkts, l_discount AS discount, l_returnflag AS flag, l_linestatus AS status, l_suppkey AS src FROM lineitem)"


def _affine_sql(shift: str, scale: str) -> str:
    agg = ", ".join(f"{shift.format(c=c)} AS a_{c}, {scale.format(c=c)} AS b_{c}" for c in _COLS)
    out = ", ".join(f"round(({c} - a_{c}) / b_{c}, 6) AS {c}" for c in _COLS)
    return f"WITH {_K} SELECT k, n, {out} FROM k, (SELECT {agg} FROM k)"


def _affine(s, d, fit):
    df = _keyed(s, d).select("k", "n", *_COLS)
    return _round(fit(df, _COLS).forward(df), 6, *_COLS)


@query(_affine_sql("avg({c})", "stddev_pop({c})"))
def transform_standard(s, d):
    return _affine(s, d, T.fit_standard)


@query(_affine_sql("min({c})", "(max({c}) - min({c}))"))
def transform_minmax(s, d):
    return _affine(s, d, T.fit_minmax)


@query(_affine_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))
def transform_robust(s, d):
    return _affine(s, d, T.fit_robust)


@query(f"WITH {_K} SELECT k, n, round(ln(in_bytes + 1e-6::DOUBLE), 6) AS in_bytes, round(ln(in_pkts + 1e-6::DOUBLE), 6) AS in_pkts FROM k")
def transform_log(s, d):
    df = _keyed(s, d).select("k", "n", "in_bytes", "in_pkts")
    return _round(T.Log(["in_bytes", "in_pkts"]).forward(df), 6, "in_bytes", "in_pkts")


@query(f"WITH {_K}, l AS (SELECT k, n, ln(in_bytes + 1e-6::DOUBLE) AS x FROM k) SELECT k, n, round((x - a) / b, 6) AS in_bytes FROM l, (SELECT min(x) AS a, max(x) - min(x) AS b FROM l)")
def transform_log_minmax(s, d):
    df = _keyed(s, d).select("k", "n", "in_bytes")
    got = transform_plan.prepare(df, ["in_bytes"], [], {"transforms": {"custom": [{"method": "log_minmax", "columns": ["in_bytes"]}]}})
    return _round(got.data, 6, "in_bytes")


@query(f"WITH {_K}, l AS (SELECT k, n, ln(in_pkts + 1e-6::DOUBLE) AS x FROM k) SELECT k, n, round((x - a) / b, 6) AS in_pkts FROM l, (SELECT quantile_cont(x, 0.5) AS a, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS b FROM l)")
def transform_log_robust(s, d):
    df = _keyed(s, d).select("k", "n", "in_pkts")
    got = transform_plan.prepare(df, [], [], {"transforms": {"custom": [{"method": "log_robust", "columns": ["in_pkts"]}]}})
    return _round(got.data, 6, "in_pkts")


@query(f"WITH {_K} SELECT (flag = 'A')::INT AS flag__0, (flag = 'N')::INT AS flag__1, (flag = 'R')::INT AS flag__2, (status = 'F')::INT AS status__0, (status = 'O')::INT AS status__1, k, n FROM k")
def transform_onehot(s, d):
    df = _keyed(s, d).select("k", "n", "flag", "status")
    return T.fit_onehot(df, ["flag", "status"]).forward(df)


@query(f"WITH {_K} SELECT k, n, flag, status FROM k")
def transform_onehot_inverse(s, d):
    df = _keyed(s, d).select("k", "n", "flag", "status")
    step = T.fit_onehot(df, ["flag", "status"])
    return step.inverse(step.forward(df))


@query("SELECT o_orderkey, " + ", ".join(f"((o_custkey >> {i}) & 1)::INT AS o_custkey__bit{i}" for i in range(32)) + " FROM orders")
def transform_bits(s, d):
    return T.Bits(["o_custkey"]).forward(load(s, d, "orders").select("o_orderkey", "o_custkey"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def transform_bits_inverse(s, d):
    step = T.Bits(["o_custkey"])
    return step.inverse(step.forward(load(s, d, "orders").select("o_orderkey", "o_custkey")))


_IP = "(o_orderkey * 7919 + 167772161)"


@query(f"SELECT o_orderkey, concat_ws('.', {_IP} >> 24 & 255, {_IP} >> 16 & 255, {_IP} >> 8 & 255, {_IP} & 255) AS ip, {_IP} AS number FROM orders")
def transform_ip(s, d):
    ip = T.number_to_ip(F.col("o_orderkey") * 7919 + 167772161)
    return load(s, d, "orders").select("o_orderkey", ip.alias("ip"), T.ip_to_number(ip).alias("number"))


#: Fixed parameters, so that encoding can be compared by value.
_MIX = mixture.Mixture({"in_bytes": [0.5, 0.3, 0.2]}, {"in_bytes": [10000.0, 40000.0, 80000.0]}, {"in_bytes": [8000.0, 15000.0, 9000.0]}, {"in_bytes": 0.0}, {"in_bytes": 1e9}, {"in_bytes": 2})


_MIX_SQL = f"""WITH {_K}, p AS (SELECT k, n, in_bytes, [ln(0.5::DOUBLE) - ln(8000::DOUBLE) - (in_bytes - 10000) ** 2 / 128000000.0::DOUBLE, ln(0.3::DOUBLE) - ln(15000::DOUBLE) - (in_bytes - 40000) ** 2 / 450000000.0::DOUBLE, ln(0.2::DOUBLE) - ln(9000::DOUBLE) - (in_bytes - 80000) ** 2 / 162000000.0::DOUBLE] AS s FROM k),
 c AS (SELECT k, n, in_bytes, list_position(s, list_max(s)) AS j FROM p), z AS (SELECT k, n, j, greatest(least((in_bytes - [10000.0, 40000.0, 80000.0][j]::DOUBLE) / (4 * [8000.0, 15000.0, 9000.0][j]::DOUBLE), 0.99), -0.99) AS z FROM c) """


@query(_MIX_SQL + "SELECT k, n, (j - 1)::INT AS in_bytes__component, round(z, 12) AS in_bytes__normalized FROM z")
def transform_mixture(s, d):
    return _round(_MIX.forward(_keyed(s, d).select("k", "n", "in_bytes")), 12, "in_bytes__normalized")


@query(_MIX_SQL + "SELECT k, n, round(greatest(z * 4 * [8000.0, 15000.0, 9000.0][j]::DOUBLE + [10000.0, 40000.0, 80000.0][j]::DOUBLE, 0), 2) AS in_bytes FROM z")
def transform_mixture_inverse(s, d):
    return _MIX.inverse(_MIX.forward(_keyed(s, d).select("k", "n", "in_bytes")))


@query()
def transform_fitted_mixture(s, d):
    df = _keyed(s, d).select("k", "n", "in_bytes", "in_pkts")
    step = mixture.fit_mixture(df, ["in_bytes", "in_pkts"])
    return step.forward(df)


_CONFIG = {"transforms": {"custom": [{"method": "log_minmax", "columns": ["in_bytes"]}], "default": [{"method": "standard"}]}}


@query(f"WITH {_K} SELECT k, n, in_bytes, in_pkts, discount, flag, status FROM (SELECT k, n, round(in_bytes, 4) AS in_bytes, round(in_pkts, 6) AS in_pkts, round(discount, 6) AS discount, flag, status FROM k)")
def transform_plan_round_trip(s, d):
    df = _keyed(s, d).select("k", "n", *_COLS, "flag", "status")
    got = transform_plan.prepare(df, _COLS, ["flag", "status"], _CONFIG)
    back = transform_plan.restore(got.data, got.steps, got.columns)
    return _round(_round(back, 4, "in_bytes"), 6, "in_pkts", "discount")


# Sketches -------------------------------------------------------------------

_SK = ["src", "proto", "in_pkts"]
_VC = f"WITH {FLOWS}, v AS (SELECT 'src' AS \"column\", src::VARCHAR AS value, count(*) AS n FROM f GROUP BY ALL UNION ALL SELECT 'proto', proto::VARCHAR, count(*) FROM f GROUP BY ALL UNION ALL SELECT 'in_pkts', in_pkts::BIGINT::VARCHAR, count(*) FROM f GROUP BY ALL)"


def _hash_sql(value: str, salt: str, start: int = 1) -> str:
    return f"(('0x' || substr(md5({value} || '_' || {salt}), {start}, 8))::BIGINT)"


def _cells_sql(src: str, rows: int, width: int, keys: str) -> str:
    return f"SELECT {keys}, value, n, r AS row, {_hash_sql('value', 'r::VARCHAR')} % {width} AS bucket, 1 - 2 * ({_hash_sql('value', 'r::VARCHAR', 9)} % 2) AS sign FROM {src}, range(0, {rows}) t(r)"


def _counts(s, d) -> DataFrame:
    f = flows(s, d)
    return sketches.value_counts(f.withColumn("in_pkts", F.col("in_pkts").cast("long")), _SK)


_CS = f"{_VC}, c AS ({_cells_sql('v', 5, 64, '\"column\"')}), s AS (SELECT \"column\", row, bucket, sum(sign * n)::BIGINT AS cell FROM c GROUP BY ALL), e AS (SELECT \"column\", value, median(sign * coalesce(cell, 0)) AS estimate FROM c LEFT JOIN s USING (\"column\", row, bucket) GROUP BY ALL)"


@query(f"{_CS} SELECT \"column\", row::INT AS row, bucket, cell FROM s")
def sketch_count(s, d):
    return sketches.count_sketch(_counts(s, d), 5, 64)


@query(f"{_CS} SELECT \"column\", value, estimate FROM e")
def sketch_count_estimates(s, d):
    v = _counts(s, d)
    return sketches.estimates(sketches.count_sketch(v, 5, 64), v, 5, 64)


@query(f"{_CS} SELECT \"column\", row::INT AS row, bucket, cell FROM s")
def sketch_count_merged(s, d):
    f = flows(s, d).withColumn("in_pkts", F.col("in_pkts").cast("long"))
    halves = [sketches.count_sketch(sketches.value_counts(f.where(c), _SK), 5, 64) for c in ("syn", "not syn")]
    return sketches.merge(*halves)


@query(f"{_CS} SELECT \"column\", value, estimate, row_number() OVER (PARTITION BY \"column\" ORDER BY abs(estimate) DESC, value) AS rank FROM e QUALIFY rank <= 20")
def sketch_top_k(s, d):
    v = _counts(s, d)
    return sketches.top_k(sketches.estimates(sketches.count_sketch(v, 5, 64), v, 5, 64), 20)


@query(f"{_CS}, p AS (SELECT \"column\", abs(estimate) / sum(abs(estimate)) OVER (PARTITION BY \"column\") AS p FROM e WHERE estimate <> 0) SELECT \"column\", round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1")
def sketch_entropy(s, d):
    v = _counts(s, d)
    return _round(sketches.entropy(sketches.estimates(sketches.count_sketch(v, 5, 64), v, 5, 64)), 6, "entropy")


@query(f"{_CS}, x AS (SELECT \"column\", value, n, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) AS rank FROM v QUALIFY rank <= 20), y AS (SELECT \"column\", value, row_number() OVER (PARTITION BY \"column\" ORDER BY abs(estimate) DESC, value) AS rank FROM e QUALIFY rank <= 20) SELECT \"column\", avg((y.value IS NOT NULL)::INT) AS recall FROM x LEFT JOIN y USING (\"column\", value) GROUP BY 1")
def sketch_top_k_recall(s, d):
    v = _counts(s, d)
    return sketches.compare_top_k(sketches.estimates(sketches.count_sketch(v, 5, 64), v, 5, 64), v, 20)


@query(f"{_CS}, a AS (SELECT \"column\", ln(sum(n)) - sum(n * ln(n)) / sum(n) AS exact FROM v GROUP BY 1), p AS (SELECT \"column\", abs(estimate) / sum(abs(estimate)) OVER (PARTITION BY \"column\") AS p FROM e WHERE estimate <> 0), b AS (SELECT \"column\", sum(-p * ln(p)) AS estimate FROM p GROUP BY 1) SELECT \"column\", round(exact, 6) AS exact, round(estimate, 6) AS estimate, round(abs(estimate - exact) / exact, 6) AS error FROM a JOIN b USING (\"column\")")
def sketch_entropy_error(s, d):
    v = _counts(s, d)
    return _round(sketches.compare_entropies(sketches.estimates(sketches.count_sketch(v, 5, 64), v, 5, 64), v), 6, "exact", "estimate", "error")


_NOISE = "(({} + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
_NAME = "(\"column\" || '|' || row::VARCHAR || '|' || bucket::VARCHAR)"


@query(f"{_CS}, g AS (SELECT \"column\", r::INT AS row, b AS bucket FROM (SELECT DISTINCT \"column\" FROM s), range(0, 5) t(r), range(0, 64) u(b)) SELECT \"column\", row, bucket, round(coalesce(cell, 0) + sqrt(-2 * ln({_NOISE.format(_hash_sql(_NAME, chr(39) + 'noise' + chr(39)))})) * cos({2 * math.pi!r}::DOUBLE * {_NOISE.format(_hash_sql(_NAME, chr(39) + 'noise' + chr(39), 9))}) * {sketches.noise_scale(2.0, 5)!r}::DOUBLE, 6) AS cell FROM g LEFT JOIN s USING (\"column\", row, bucket)")
def sketch_with_noise(s, d):
    return _round(sketches.with_noise(sketches.count_sketch(_counts(s, d), 5, 64), 2.0, 5, 64), 6, "cell")


_U, _G = 2048, 0.05
_LV, _RW, _WD = sketches.dyadic_shape(_U, _G)
_DY = f"""WITH v AS (SELECT l_partkey AS v, count(*) AS n FROM lineitem GROUP BY 1), d AS (SELECT l AS level, l::VARCHAR || ':' || (v >> l)::VARCHAR AS value, sum(n)::BIGINT AS n FROM v, range(0, {_LV}) t(l) GROUP BY ALL),
 c AS ({_cells_sql('d', _RW, _WD, 'level')}), s AS (SELECT level, row, bucket, sum(sign * n)::BIGINT AS cell FROM c GROUP BY ALL)"""


def _dyadic(s, d):
    v = load(s, d, "lineitem").groupBy(F.lit("dst").alias("column"), F.col("l_partkey").alias("value")).agg(F.count("*").alias("n"))
    return sketches.dyadic_sketch(v, _U, _G)


@query(f"{_DY} SELECT 'dst' AS \"column\", level::INT AS level, row::INT AS row, bucket, cell FROM s")
def sketch_dyadic(s, d):
    return _dyadic(s, d)


@query(f"""{_DY}, q AS (SELECT x FROM range(0, 2000, 100) t(x)), a AS (SELECT x, l AS level, l::VARCHAR || ':' || ((x >> l) - 1)::VARCHAR AS value, 0 AS n FROM q, range(0, {_LV}) t(l) WHERE (x >> l) & 1 = 1),
 u AS (SELECT DISTINCT level, value, n FROM a), b AS ({_cells_sql('u', _RW, _WD, 'level')}), e AS (SELECT level, value, median(sign * coalesce(cell, 0)) AS estimate FROM b LEFT JOIN s USING (level, row, bucket) GROUP BY ALL)
 SELECT 'dst' AS "column", x, coalesce(sum(estimate), 0)::DOUBLE AS rank FROM q LEFT JOIN a USING (x) LEFT JOIN e USING (level, value) GROUP BY x""")
def sketch_dyadic_rank(s, d):
    asked = s.range(0, 2000, 100).select(F.lit("dst").alias("column"), F.col("id").alias("x"))
    return sketches.dyadic_rank(_dyadic(s, d), asked, _U, _G)


@query(f"""{_DY}, q AS (SELECT x FROM range(0, 2000, 100) t(x)), a AS (SELECT x, l AS level, l::VARCHAR || ':' || ((x >> l) - 1)::VARCHAR AS value, 0 AS n FROM q, range(0, {_LV}) t(l) WHERE (x >> l) & 1 = 1),
 u AS (SELECT DISTINCT level, value, n FROM a), b AS ({_cells_sql('u', _RW, _WD, 'level')}), e AS (SELECT level, value, median(sign * coalesce(cell, 0)) AS estimate FROM b LEFT JOIN s USING (level, row, bucket) GROUP BY ALL),
 r AS (SELECT x, coalesce(sum(estimate), 0)::DOUBLE AS rank FROM q LEFT JOIN a USING (x) LEFT JOIN e USING (level, value) GROUP BY x), g AS (SELECT abs(rank - (SELECT coalesce(sum(n), 0) FROM v WHERE v < x)) / (SELECT sum(n) FROM v) AS gap FROM r)
 SELECT 'dst' AS "column", round(avg(gap), 6) AS mean_error, round(max(gap), 6) AS max_error FROM g""")
def sketch_rank_error(s, d):
    asked = s.range(0, 2000, 100).select(F.lit("dst").alias("column"), F.col("id").alias("x"))
    v = load(s, d, "lineitem").groupBy(F.lit("dst").alias("column"), F.col("l_partkey").alias("value")).agg(F.count("*").alias("n"))
    return _round(sketches.compare_ranks(sketches.dyadic_rank(_dyadic(s, d), asked, _U, _G), v), 6, "mean_error", "max_error")


@query(f"SELECT {_LV} AS levels, {_RW} AS sketch_rows, {_WD} AS width, {sketches.memory_budget(_U, _G)} AS bytes")
def sketch_dyadic_budget(s, d):
    lv, rw, wd = sketches.dyadic_shape(_U, _G)
    return s.createDataFrame([(lv, rw, wd, sketches.memory_budget(_U, _G))], "levels int, sketch_rows int, width int, bytes int")


_UM = {"memory": 1 << 20, "levels": 12, "rows": 5}
_UW = sketches.univmon_shape(**_UM)
_BITS = "[" + ", ".join(f"{_hash_sql('value', chr(39) + f'sample{i}' + chr(39))} % 2" for i in range(_UM["levels"] - 1)) + "]"
_UV = f"""{_VC}, h AS (SELECT *, coalesce(list_position({_BITS}, 0) - 1, {_UM['levels'] - 1}) AS depth FROM v), l AS (SELECT "column", l AS level, value, n, (depth > l)::INT AS bit FROM h, range(0, {_UM['levels']}) t(l) WHERE l <= depth),
 c AS ({_cells_sql('l', _UM['rows'], _UW, '\"column\", level, bit')}), s AS (SELECT "column", level, row, bucket, sum(sign * n)::BIGINT AS cell FROM c GROUP BY ALL),
 e AS (SELECT "column", level, value, bit, floor(median(sign * coalesce(cell, 0))) AS estimate FROM c LEFT JOIN s USING ("column", level, row, bucket) GROUP BY ALL),
 t AS (SELECT * FROM e WHERE estimate > 0 QUALIFY row_number() OVER (PARTITION BY "column", level ORDER BY estimate DESC, value) <= 1000)"""
_LAST = _UM["levels"] - 1


def _heavy(s, d):
    v = _counts(s, d)
    return v, sketches.univmon_heavy(sketches.univmon(v, **_UM), v, 1000, **_UM)


@query(f"{_UV} SELECT \"column\", level::INT AS level, row::INT AS row, bucket, cell FROM s")
def sketch_univmon(s, d):
    return sketches.univmon(_counts(s, d), **_UM)


@query(f"{_UV} SELECT \"column\", greatest(sum(pow(2, level) * CASE WHEN level = {_LAST} THEN 1 ELSE 1 - 2 * bit END), 0)::DOUBLE AS cardinality FROM t GROUP BY 1")
def sketch_univmon_cardinality(s, d):
    return sketches.univmon_cardinality(_heavy(s, d)[1], _UM["levels"])


@query(f"{_UV}, g AS (SELECT \"column\", sum(pow(2, level) * CASE WHEN level = {_LAST} THEN 1 ELSE 1 - 2 * bit END * estimate * log2(estimate)) AS g FROM t GROUP BY 1) SELECT \"column\", round(log2(n) - g / n, 6) AS entropy FROM g JOIN (SELECT \"column\", sum(n) AS n FROM v GROUP BY 1) USING (\"column\")")
def sketch_univmon_entropy(s, d):
    v, heavy = _heavy(s, d)
    return _round(sketches.univmon_entropy(heavy, v.groupBy("column").agg(F.sum("n").alias("n")), _UM["levels"]), 6, "entropy")


@query(f"{_UV} SELECT \"column\", value, max(estimate)::BIGINT AS estimate FROM t GROUP BY ALL HAVING max(estimate) >= 600")
def sketch_univmon_heavy_hitters(s, d):
    return sketches.univmon_heavy_hitters(_heavy(s, d)[1], 600)


# Sequences and samples ------------------------------------------------------


@query("""WITH e AS (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n, user_id, value FROM events), w AS (SELECT i AS first FROM e WHERE i % 5 = 0 AND i + 10 <= n)
 SELECT (first // 5)::BIGINT AS window_id, (e.i - first)::INT AS step, user_id::DOUBLE AS user_id, value FROM w JOIN e ON e.i >= first AND e.i < first + 10""")
def sequence_windows(s, d):
    w = sequences.sliding_windows(load(s, d, "events"), "ts", ["user_id", "value"], 10, 5, block=1000)
    return w.select("window_id", F.posexplode("rows").alias("step", "x")).select("window_id", "step", F.col("x")[0].alias("user_id"), F.col("x")[1].alias("value"))


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts) - 1) // 64)::BIGINT AS batch_id FROM events")
def sequence_batches(s, d):
    return sequences.batches(load(s, d, "events").select("event_id", "ts"), "ts", 64).select("event_id", "batch_id")


@query("SELECT (i // 5)::BIGINT AS window_id, (i // 5 // 8)::BIGINT AS batch_id FROM (SELECT row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM events) WHERE i % 5 = 0 AND i + 10 <= n")
def sequence_window_batches(s, d):
    w = sequences.sliding_windows(load(s, d, "events"), "ts", ["value"], 10, 5, block=1000)
    return sequences.window_batches(w, 8).select("window_id", "batch_id")


@query("SELECT event_id, user_id FROM events WHERE (('0x' || substr(md5('3' || event_id::VARCHAR), 1, 8))::BIGINT) / 4294967296.0::DOUBLE < 0.1")
def sample_by_hash(s, d):
    return sequences.sample_rows(load(s, d, "events"), 0.1, "event_id", 3).select("event_id", "user_id")


@query("SELECT o_orderkey, CASE WHEN (('0x' || substr(md5('0' || o_orderkey::VARCHAR), 1, 8))::BIGINT) / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS part FROM orders")
def sample_split(s, d):
    a, b = sequences.split(load(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return a.withColumn("part", F.lit("train")).union(b.withColumn("part", F.lit("test")))


_U01 = "(('0x' || substr(md5({}), 1, 8))::BIGINT) / 4294967296.0::DOUBLE"


@query(f"SELECT l_orderkey, l_linenumber, l_quantity FROM (SELECT *, {_U01.format(chr(39) + '0' + chr(39) + ' || l_orderkey::VARCHAR || ' + chr(39) + '-' + chr(39) + ' || l_linenumber::VARCHAR || ' + chr(39) + '-' + chr(39) + ' || l_extendedprice::VARCHAR')} AS u FROM (SELECT l_orderkey, l_linenumber, l_quantity, round(l_extendedprice * 100)::BIGINT AS l_extendedprice FROM lineitem)) WHERE u < 0.1 ORDER BY u, l_orderkey LIMIT 500")
def sample_capped(s, d):
    t = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "cents")
    return sequences.capped_sample(t, 0.1, 500, key=key).drop("cents")


@query(f"SELECT * FROM orders WHERE floor({_U01.format('o_orderkey::VARCHAR')} * 4) = 1")
def sample_worker_split(s, d):
    return sequences.worker_split(load(s, d, "orders"), 1, 4, "o_orderkey")


# Nearest neighbours ---------------------------------------------------------


@query("""WITH q AS (SELECT DISTINCT l_partkey::DOUBLE AS value FROM lineitem), v AS (SELECT DISTINCT (p_partkey * 7)::DOUBLE AS k FROM part)
 SELECT value, (SELECT k FROM v ORDER BY abs(k - value), k LIMIT 1) AS nearest FROM q""")
def nearest_port(s, d):
    q = load(s, d, "lineitem").select(F.col("l_partkey").cast("double").alias("value"))
    v = load(s, d, "part").select((F.col("p_partkey") * 7).cast("double").alias("value"))
    return nearest.nearest_value(q, v)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE abs(c_acctbal - s_acctbal) <= 5)")
def band_semi_join(s, d):
    a = load(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v"))
    return nearest.band_semi_join(a, load(s, d, "supplier").select(F.col("s_acctbal").alias("v")), "v", 5.0).select("c_custkey", F.col("v").alias("c_acctbal"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT s_suppkey FROM supplier)")
def equal_semi_join(s, d):
    a = load(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("v"))
    return nearest.band_semi_join(a, load(s, d, "supplier").select(F.col("s_suppkey").alias("v")), "v", 0).select("o_orderkey", F.col("v").alias("o_custkey"))


_UNIT = "list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE))))"


@query(f"""WITH e AS (SELECT vec_id, {_UNIT} AS u FROM embeddings), q AS (SELECT vec_id AS qid, u AS qu FROM e WHERE vec_id % 100 = 0),
 g AS (SELECT qid, vec_id AS word, round(sqrt(greatest(0, 2 - 2 * list_sum(list_transform(range(1, 65), lambda i: qu[i] * u[i])))), 6) AS distance FROM q, e WHERE vec_id <> qid) SELECT qid AS vec_id, word, distance FROM g QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, word) = 1""")
def nearest_word(s, d):
    e = load(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest.nearest_vector(e.where("vec_id % 100 = 0"), e.withColumnRenamed("vec_id", "word"), "vec_id", digits=6, apart=True)


@query()
def nearest_word_index(s, d):
    """Every row is in the index; its recall against nearest_word is tested."""
    e = load(s, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    return nearest.nearest_vector_index(e.where("vec_id % 100 = 0"), e.withColumnRenamed("vec_id", "word"), "vec_id", digits=6, apart=True)


@query()
def embed_trained_words(s, d):
    return nearest.train_words(flows(s, d), ["src", "dst", "proto"], size=4)


def _port_vectors(s) -> DataFrame:
    """A made-up vocabulary on the circle, so encoding can be compared by value."""
    return s.range(0, 2000, 3).select(F.lit("PORT").alias("type"), F.col("id").cast("string").alias("word"), F.array(F.round(F.cos(F.col("id") / 400), 9), F.round(F.sin(F.col("id") / 400), 9)).alias("vector"))


@query("SELECT 'PORT' AS type, range::VARCHAR AS word, round(cos(range / 400.0::DOUBLE), 9) AS x, round(sin(range / 400.0::DOUBLE), 9) AS y FROM range(0, 2000, 3)")
def embed_saved_words(s, d):
    path = f"{tables.work_dir(s)}/netquill-io-{uuid.uuid4().hex}"
    nearest.save_words(_port_vectors(s), path)
    return nearest.load_words(s, path).select("type", "word", F.col("vector")[0].alias("x"), F.col("vector")[1].alias("y"))


@query("SELECT DISTINCT t.type, t.word FROM (SELECT 'PORT' AS type, l_partkey::VARCHAR AS word FROM lineitem UNION SELECT 'PORT', l_suppkey::VARCHAR FROM lineitem UNION SELECT 'PROTOCOL', l_linenumber::VARCHAR FROM lineitem) t JOIN (SELECT range::VARCHAR AS word FROM range(0, 2000, 3)) USING (word)")
def embed_vocabulary(s, d):
    words = _port_vectors(s).select("word", "vector")
    return nearest.vocabulary(flows(s, d), {"PORT": ["src", "dst"], "PROTOCOL": ["proto"]}, words).select("type", "word")


_ENCODED = """WITH q AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 1 THEN l_partkey - 1 WHEN 2 THEN least(l_partkey + 1, 1998) ELSE l_partkey END AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(cos(w / 400.0::DOUBLE), 9) AS l_partkey_0, round(sin(w / 400.0::DOUBLE), 9) AS l_partkey_1 FROM q"""


@query(_ENCODED)
def embed_written(s, d):
    path = f"{tables.work_dir(s)}/netquill-io-{uuid.uuid4().hex}"
    tables.write(embed_encode(s, d), path, "csv", single_file=True)
    return tables.read(s, path, "csv", "l_orderkey long, l_linenumber int, l_partkey_0 double, l_partkey_1 double")


@query()
def transform_log_mixture(s, d):
    df = _keyed(s, d).select("k", "n", "in_bytes")
    return transform_plan.prepare(df, ["in_bytes"], [], {"transforms": {"custom": [{"method": "GMM_log", "columns": ["in_bytes"]}]}}).data


@query(_ENCODED)
def embed_encode(s, d):
    df = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return _round(nearest.encode(df, {"l_partkey": "PORT"}, _port_vectors(s), 2), 9, "l_partkey_0", "l_partkey_1")


@query("SELECT l_orderkey, l_linenumber, (CASE l_partkey % 3 WHEN 1 THEN l_partkey - 1 WHEN 2 THEN least(l_partkey + 1, 1998) ELSE l_partkey END)::VARCHAR AS l_partkey FROM lineitem")
def embed_decode(s, d):
    df = load(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    v = _port_vectors(s)
    return nearest.decode(nearest.encode(df, {"l_partkey": "PORT"}, v, 2), {"l_partkey": "PORT"}, v, 2, "l_orderkey")
