"""Queries over flow tables: cleaning, grouped questions, fidelity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators import association, clean, fidelity, flow_queries
from netquill.queries import FLOWS, ORACLE, flows, load, query

NUM = ["in_bytes", "in_pkts", "discount", "dst"]
CAT = ["proto", "tax"]


def _round(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns])


# Cleaning -------------------------------------------------------------------

_DIRTY = "event_id, user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 11 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'inf'::DOUBLE ELSE value END AS value"


def _dirty(s, d):
    e = load(s, d, "events")
    i = F.col("event_id")
    return e.select("event_id", "user_id", "event_type", F.when(i % 7 == 0, None).when(i % 11 == 0, float("nan")).when(i % 13 == 0, float("inf")).otherwise(F.col("value")).alias("value"))


@query(f"SELECT * FROM (SELECT {_DIRTY} FROM events) WHERE value IS NOT NULL AND isfinite(value)")
def clean_non_finite(s, d):
    return clean.drop_non_finite(_dirty(s, d))


@query("SELECT o_custkey, o_orderdate, o_orderkey, o_orderpriority FROM orders")
def clean_exclude_columns(s, d):
    df = clean.exclude(load(s, d, "orders"), "o_orderstatus o_totalprice no_such_column")
    return df.select(*sorted(df.columns))


@query("SELECT s_acctbal AS acctbal, s_nationkey AS nationkey, 's' AS side FROM supplier UNION ALL SELECT c_acctbal, c_nationkey, 'c' FROM customer")
def clean_shared_columns(s, d):
    cut = lambda df: df.select(*[F.col(c).alias(c[2:]) for c in df.columns])
    a, b = cut(load(s, d, "supplier")).drop("name"), cut(load(s, d, "customer")).drop("name")
    both = clean.shared_columns(a, b)
    return a.select(*both, F.lit("s").alias("side")).union(b.select(*both, F.lit("c").alias("side")))


@query("SELECT o_orderkey::DOUBLE AS o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice, TRY_CAST(o_orderstatus AS DOUBLE) AS o_orderstatus FROM orders")
def clean_cast(s, d):
    return clean.to_type(load(s, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"))


@query("SELECT p_partkey, round_even(p_retailprice, 0) AS p_retailprice FROM part")
def clean_discretise(s, d):
    return clean.discretise(load(s, d, "part").select("p_partkey", "p_retailprice"), 0)


@query(f"WITH {FLOWS} SELECT src, dst, proto, in_pkts + out_pkts AS total FROM f WHERE dst <= 1000 AND in_pkts + out_pkts <= 1000")
def clean_total_and_ranges(s, d):
    return clean.with_total(flows(s, d), "in_pkts", "out_pkts", "total").where((F.col("dst") <= 1000) & (F.col("total") <= 1000)).select("src", "dst", "proto", "total")


_CATS = ["l_linenumber", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, count(DISTINCT {c}) <= 10 AS categorical FROM lineitem" for c in _CATS))
def clean_categorical_roles(s, d):
    return clean.distinct_counts(load(s, d, "lineitem").select(*_CATS)).select("column", "n_distinct", (F.col("n_distinct") <= 10).alias("categorical"))


@query("SELECT * FROM (VALUES ('c_custkey','Integer'),('c_name','String'),('c_nationkey','Integer'),('c_acctbal','Float'),('c_mktsegment','String')) t(\"column\", \"type\")")
def clean_infer_types(s, d):
    return clean.infer_types(load(s, d, "customer"))


_FACTS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_distinct, avg(({c} IS NULL)::INT) AS missing_rate, count(DISTINCT {c}) = count(*) AND '{c}' <> 'o_totalprice' AS is_candidate_key, count(DISTINCT {c}) <= 20 AS is_categorical FROM orders" for c in _FACTS))
def clean_column_facts(s, d):
    return clean.column_facts(load(s, d, "orders").select(*_FACTS))


@query("SELECT 'o_orderpriority' AS \"column\", min(length(o_orderpriority))::DOUBLE AS low, max(length(o_orderpriority))::DOUBLE AS high FROM orders UNION ALL SELECT 'o_totalprice', min(o_totalprice), max(o_totalprice) FROM orders UNION ALL SELECT 'o_orderdate', epoch(min(o_orderdate))::DOUBLE, epoch(max(o_orderdate))::DOUBLE FROM orders")
def clean_domains(s, d):
    return clean.domains(load(s, d, "orders"), ["o_orderpriority", "o_totalprice", "o_orderdate"])


@query("SELECT least(floor((o_totalprice - lo) / (hi - lo) * 100), 99)::INT AS bin, count(*) AS count FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders) GROUP BY 1")
def histogram_equal_width(s, d):
    return clean.equal_width(load(s, d, "orders"), "o_totalprice", 100)


@query("SELECT o_orderkey, o_orderpriority, length(trim(o_orderpriority)) < 20 AND try_cast(o_orderpriority AS TIMESTAMP) IS NOT NULL AS dated, coalesce(try_cast(replace(o_orderkey::VARCHAR, '-', '') AS BIGINT) > 0 AND try_cast(replace(o_orderkey::VARCHAR, '-', '') AS BIGINT) < 1000000000, false) AS ssn FROM orders")
def clean_predicates(s, d):
    o = load(s, d, "orders")
    return o.select("o_orderkey", "o_orderpriority", F.coalesce(clean.is_datetime(F.col("o_orderpriority")), F.lit(False)).alias("dated"), clean.is_ssn(F.col("o_orderkey").cast("string")).alias("ssn"))


# Grouped questions ----------------------------------------------------------

_ASK = {
    "busiest_sources": ("src", "SELECT syn, src, count(*) AS score FROM (SELECT DISTINCT syn, src, dst, proto FROM f) GROUP BY ALL", 5000),
    "busiest_destinations": ("dst", "SELECT syn, dst, count(*) AS score FROM (SELECT DISTINCT syn, src, dst, proto FROM f) GROUP BY ALL", 5000),
    "heaviest_flows": ("src, dst, proto", "SELECT syn, src, dst, proto, floor(sum(in_pkts + out_pkts))::BIGINT AS score FROM f WHERE dst <= 1000 GROUP BY syn, src, dst, proto", 5000),
    "commonest_protocols": ("proto", "SELECT syn, proto, count(*) AS score FROM f WHERE in_pkts + out_pkts <= 1000 GROUP BY syn, proto", 10),
    "heaviest_receivers": ("dst, proto", "SELECT syn, dst, proto, sum(out_bytes::DECIMAL(18,4))::DOUBLE AS score FROM f GROUP BY syn, dst, proto", 5000),
}


def _top_sql(name: str) -> str:
    keys, sql, k = _ASK[name]
    return f"SELECT *, row_number() OVER (PARTITION BY syn ORDER BY score DESC, {keys}) AS rank FROM ({sql}) QUALIFY rank <= {k}"


def _agree_sql(name: str, where: str = "true") -> str:
    keys = _ASK[name][0]
    return f"SELECT '{name}' AS question, sum(a * b)::DOUBLE / nullif(count(*), 0) AS iou, sum(a * b)::DOUBLE / nullif(sum(a), 0) AS recall, sum((a <> b)::INT)::BIGINT AS difference FROM (SELECT {keys}, max((NOT syn)::INT) AS a, max(syn::INT) AS b FROM ({_top_sql(name)}) WHERE {where} GROUP BY {keys})"


for _name in _ASK:
    query(f"WITH {FLOWS} {_top_sql(_name)}", name=f"flow_{_name}")(lambda s, d, n=_name: flow_queries.QUESTIONS[n][0](flows(s, d)))


@query(f"WITH {FLOWS} " + " UNION ALL ".join(_agree_sql(n) for n in _ASK))
def flow_set_agreement(s, d):
    out, f = None, flows(s, d)
    for n, (ask, keys, _) in flow_queries.QUESTIONS.items():
        one = flow_queries.agreement(ask(f), keys).select(F.lit(n).alias("question"), "iou", "recall", "difference")
        out = one if out is None else out.union(one)
    return out


@query(f"WITH {FLOWS}, g AS (" + " UNION ALL ".join(_agree_sql(n) for n in _ASK) + "), l AS (" + " UNION ALL ".join(_agree_sql(n, "dst <= 1000") for n in _ASK if "dst" in _ASK[n][0]) + ") SELECT g.question, g.iou, g.recall, l.iou AS iou_low, l.recall AS recall_low FROM g LEFT JOIN l USING (question)")
def flow_report(s, d):
    return flow_queries.flow_report(flows(s, d))


@query(f"WITH {FLOWS} SELECT dst, sum(out_bytes::DECIMAL(18,4))::DOUBLE AS bytes_out FROM f GROUP BY dst")
def flow_bytes_out_by_port(s, d):
    return flow_queries.bytes_out_by_port(flows(s, d))


@query(f"WITH {FLOWS} SELECT src, sum(in_bytes::DECIMAL(18,4))::DOUBLE AS bytes_in FROM f GROUP BY src")
def flow_bytes_in_by_port(s, d):
    return flow_queries.bytes_in_by_port(flows(s, d))


@query(f"WITH {FLOWS} SELECT proto, count(*) AS n_rows FROM f GROUP BY proto")
def flow_rows_by_protocol(s, d):
    return flow_queries.rows_by_protocol(flows(s, d))


@query(f"WITH {FLOWS} SELECT dst, count(*) AS n_flows FROM f GROUP BY dst")
def flow_count_by_port(s, d):
    return flow_queries.flows_by_port(flows(s, d))


@query(f"""WITH {FLOWS}, a AS (SELECT 'bytes_out' AS list, dst AS key, sum(out_bytes::DECIMAL(18,4))::DOUBLE AS value FROM f GROUP BY dst
 UNION ALL SELECT 'bytes_in', src, sum(in_bytes::DECIMAL(18,4))::DOUBLE FROM f GROUP BY src UNION ALL SELECT 'protocol_rows', proto, count(*)::DOUBLE FROM f GROUP BY proto
 UNION ALL SELECT 'port_flows', dst, count(*)::DOUBLE FROM f GROUP BY dst) SELECT *, row_number() OVER (PARTITION BY list ORDER BY value DESC, key) AS rank FROM a QUALIFY rank <= 10""")
def flow_summary(s, d):
    return flow_queries.summary(flows(s, d))


# Fidelity -------------------------------------------------------------------


def _cells(cols: list[str]) -> str:
    return "c AS (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c}::DOUBLE AS value, syn FROM f" for c in cols) + '), q AS (SELECT "column", value, sum((NOT syn)::INT)::BIGINT AS n_a, sum(syn::INT)::BIGINT AS n_b FROM c WHERE value IS NOT NULL GROUP BY ALL)'


_T = 'sum(n_a) OVER (PARTITION BY "column")::DOUBLE AS t_a, sum(n_b) OVER (PARTITION BY "column")::DOUBLE AS t_b'


@query(f"WITH {FLOWS}, {_cells(NUM + CAT)} SELECT * FROM q")
def value_frequencies(s, d):
    return fidelity.frequencies(flows(s, d), NUM + CAT)


@query(f"WITH {FLOWS}, {_cells(NUM)} SELECT \"column\", count(*) AS n_distinct FROM q GROUP BY 1")
def distinct_values(s, d):
    return fidelity.frequencies(flows(s, d), NUM).groupBy("column").agg(F.count("*").alias("n_distinct"))


@query("SELECT coalesce(a.value, b.value) AS value, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b FROM (SELECT l_suppkey AS value, count(*) AS n FROM lineitem GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS value, count(*) AS n FROM supplier GROUP BY 1) b USING (value)")
def align_frequencies(s, d):
    a = load(s, d, "lineitem").groupBy(F.col("l_suppkey").alias("value")).agg(F.count("*").alias("n"))
    b = load(s, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("value")).agg(F.count("*").alias("n"))
    return fidelity.aligned(a, b)


@query(f"""WITH {FLOWS}, {_cells(NUM + CAT)}, r AS (SELECT "column", value, n_a + n_b AS n, abs(sum(n_a) OVER w / sum(n_a) OVER (PARTITION BY "column") - sum(n_b) OVER w / sum(n_b) OVER (PARTITION BY "column")) AS gap, lead(value) OVER w AS nxt FROM q WINDOW w AS (PARTITION BY "column" ORDER BY value))
 SELECT "column", round(max(gap), 6) AS ks, round(sum(gap * n) / sum(n), 6) AS mean_quantile_error, round(coalesce(sum(gap * (nxt - value)), 0), 6) AS emd FROM r GROUP BY 1""")
def fidelity_cdf_distances(s, d):
    return _round(fidelity.distances(fidelity.frequencies(flows(s, d), NUM + CAT)), 6, "ks", "mean_quantile_error", "emd")


@query(f"""WITH {FLOWS}, {_cells(NUM + CAT)}, t AS (SELECT *, {_T} FROM q), p AS (SELECT "column", n_a / t_a AS p, n_b / t_b AS q FROM t)
 SELECT "column", round(sqrt(greatest(0, sum((CASE WHEN p > 0 THEN p * ln(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(q / ((p + q) / 2)) ELSE 0 END) / 2))), 6) AS jsd,
 CASE WHEN max((p = 0 AND q > 0)::INT) = 0 THEN round(sum(CASE WHEN q > 0 THEN q * ln(q / p) ELSE 0 END), 6) END AS kl FROM p GROUP BY 1""")
def fidelity_divergences(s, d):
    return _round(fidelity.divergences(fidelity.frequencies(flows(s, d), NUM + CAT)), 6, "jsd", "kl")


def _entropy_sql() -> str:
    cat = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", syn, {c}::VARCHAR AS b, count(*) AS n FROM f GROUP BY ALL" for c in CAT)
    num = " UNION ALL ".join(f"""SELECT '{c}', syn, (CASE WHEN hi > lo THEN least(floor(({c} - lo) / (hi - lo) * nb), nb - 1) ELSE 0 END)::VARCHAR, count(*) FROM f JOIN (
      SELECT syn, lo, hi, CASE WHEN hi > lo THEN ceil((hi - lo) / CASE WHEN fd > 0 THEN least(st, fd) ELSE st END) ELSE 1 END AS nb FROM (
        SELECT syn, min({c}) AS lo, max({c}) AS hi, (max({c}) - min({c})) / (log2(count(*)) + 1) AS st, 2 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) / pow(count(*), 1.0 / 3) AS fd FROM f GROUP BY syn)) USING (syn) GROUP BY ALL""" for c in NUM)
    return f'WITH {FLOWS}, k AS ({cat} UNION ALL {num}), p AS (SELECT "column", syn, n / sum(n) OVER (PARTITION BY "column", syn) AS p FROM k), h AS (SELECT "column", syn, sum(-p * ln(p)) AS h FROM p GROUP BY ALL) '


@query(_entropy_sql() + 'SELECT "column", syn, round(h, 6) AS entropy FROM h')
def fidelity_entropies(s, d):
    return _round(fidelity.column_entropies(flows(s, d), NUM, CAT), 6, "entropy")


@query(_entropy_sql() + 'SELECT "column", round(abs(max(h) FILTER (NOT syn) - max(h) FILTER (syn)) / max(h) FILTER (NOT syn), 6) AS entropy_error FROM h GROUP BY 1')
def fidelity_entropy_error(s, d):
    return _round(fidelity.entropy_differences(fidelity.column_entropies(flows(s, d), NUM, CAT)), 6, "entropy_error")


def _recall_sql(k: int, tol: float) -> str:
    top = lambda n: f'SELECT "column", value FROM q WHERE {n} > 0 QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY {n} DESC, value) <= {k}'
    return f"""SELECT a."column", {k} AS k, {tol}::DOUBLE AS tolerance, round(1 - avg((EXISTS (SELECT 1 FROM tb{k} b WHERE b."column" = a."column" AND abs(a.value - b.value) <= {tol}::DOUBLE * r.span))::INT), 6) AS recall_error
 FROM ({top('n_a')}) a JOIN (SELECT "column", max(value) - min(value) AS span FROM q WHERE n_a > 0 GROUP BY 1) r USING ("column") GROUP BY 1"""


def _recall_with(ks) -> str:
    return ", ".join(f'tb{k} AS MATERIALIZED (SELECT "column", value FROM q WHERE n_b > 0 QUALIFY row_number() OVER (PARTITION BY "column" ORDER BY n_b DESC, value) <= {k})' for k in ks)


@query(f"WITH {FLOWS}, {_cells(NUM)}, {_recall_with((100, 1000))} " + " UNION ALL ".join(_recall_sql(k, t) for k in (100, 1000) for t in (0.0, 0.001, 0.01)))
def fidelity_top_recall(s, d):
    freq, out = fidelity.frequencies(flows(s, d), NUM), None
    for k in (100, 1000):
        for t in (0.0, 0.001, 0.01):
            one = _round(fidelity.top_recall_error(freq, k, t), 6, "recall_error")
            out = one if out is None else out.union(one)
    return out


@query(f"WITH {FLOWS}, {_cells(NUM + CAT)} SELECT \"column\", value, n_a AS n, row_number() OVER (PARTITION BY \"column\" ORDER BY n_a DESC, value) AS rank FROM q WHERE n_a > 0 QUALIFY rank <= 10")
def top_values(s, d):
    return fidelity.top_values(fidelity.frequencies(flows(s, d), NUM + CAT), 10, "n_a")


_PAIRS = [(a, b) for i, a in enumerate(NUM) for b in NUM[i + 1 :]]


@query(f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(DISTINCT ({a}, {b})) FILTER (NOT syn) AS n_a, count(DISTINCT ({a}, {b})) FILTER (syn) AS n_b, round(abs(n_b - n_a) / n_a, 6) AS error FROM f" for a, b in _PAIRS))
def fidelity_pair_cardinality(s, d):
    return _round(fidelity.pair_cardinality(flows(s, d), NUM), 6, "error")


def _norm_sql(a: str, b: str) -> str:
    x = f"(SELECT syn, ({a} - la) / (ha - la) AS x, ({b} - lb) / (hb - lb) AS y FROM f, (SELECT min({a}) la, max({a}) ha, min({b}) lb, max({b}) hb FROM f WHERE NOT syn))"
    norm = "sqrt((p + r + sqrt((p - r) * (p - r) + 4 * q * q)) / 2)"
    return f"SELECT '{a}' AS a, '{b}' AS b, max(n) FILTER (NOT syn) AS norm_a, max(n) FILTER (syn) AS norm_b FROM (SELECT syn, {norm} AS n FROM (SELECT syn, sum(x * x) p, sum(x * y) q, sum(y * y) r FROM {x} GROUP BY syn))"


@query(f"WITH {FLOWS}, n AS (" + " UNION ALL ".join(_norm_sql(a, b) for a, b in _PAIRS) + ") SELECT a, b, round(norm_a, 4) AS norm_a, round(norm_b, 4) AS norm_b, round(abs(norm_a - norm_b) / norm_a, 6) AS error FROM n")
def fidelity_pair_norms(s, d):
    return _round(_round(fidelity.pair_norms(flows(s, d), NUM), 6, "error"), 4, "norm_a", "norm_b")


@query(f"WITH {FLOWS}, {_cells(NUM)} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum(abs(x / tx - y / ty)) / 2, 6) AS error FROM (SELECT value, sum(n_a) AS x, sum(n_b) AS y, sum(sum(n_a)) OVER () AS tx, sum(sum(n_b)) OVER () AS ty FROM q WHERE \"column\" IN ('{a}', '{b}') GROUP BY value)" for a, b in _PAIRS))
def fidelity_pooled_frequency(s, d):
    return _round(fidelity.pooled_frequency_error(fidelity.frequencies(flows(s, d), NUM), NUM), 6, "error")


@query(f"WITH {FLOWS} SELECT round(sum(abs(x / tx - y / ty)) / 2, 6) AS error FROM (SELECT sum((NOT syn)::INT) AS x, sum(syn::INT) AS y, sum(sum((NOT syn)::INT)) OVER () AS tx, sum(sum(syn::INT)) OVER () AS ty FROM f GROUP BY src, proto)")
def fidelity_joint_frequency(s, d):
    return _round(fidelity.joint_frequency_error(flows(s, d), "src", "proto"), 6, "error")


def _named(metric: str, column: str, sql: str) -> str:
    return f"""SELECT '{metric}' AS metric, "column", {column} AS value FROM ({sql})"""


def _report_sql() -> str:
    of = lambda q: ORACLE[q]
    parts = [_named(m, m, of("fidelity_cdf_distances")) for m in ("ks", "mean_quantile_error", "emd")] + [_named("jsd", "jsd", of("fidelity_divergences")), _named("entropy_error", "entropy_error", of("fidelity_entropy_error"))]
    for k in (100, 1000):
        for cols, t, name in ((NUM, 0.001, f"top_{k}_within_0.001"), (NUM, 0.1, f"top_{k}_within_0.1"), (CAT, 0.0, f"top_{k}_exact")):
            parts.append(_named(name, "recall_error", f"WITH {FLOWS}, {_cells(cols)}, {_recall_with((k,))} {_recall_sql(k, t)}"))
    return " UNION ALL ".join(parts)


@query(_report_sql())
def fidelity_single_report(s, d):
    return fidelity.single_report(flows(s, d), NUM, CAT, tolerances=(0.001, 0.1), digits=6)


@query(" UNION ALL ".join(f"SELECT '{m}' AS metric, a, b, error AS value FROM ({ORACLE[q]})" for m, q in (("cardinality", "fidelity_pair_cardinality"), ("norm", "fidelity_pair_norms"), ("pooled_frequency", "fidelity_pooled_frequency"))))
def fidelity_cross_report(s, d):
    return fidelity.cross_report(flows(s, d), NUM, digits=6)


@query(f"""WITH {FLOWS}, {_cells(NUM + CAT)}, r AS (SELECT "column", abs(sum(n_a) OVER w / sum(n_a) OVER (PARTITION BY "column") - sum(n_b) OVER w / sum(n_b) OVER (PARTITION BY "column")) AS gap FROM q WINDOW w AS (PARTITION BY "column" ORDER BY value)), m AS (SELECT "column", max(gap) AS v FROM r GROUP BY 1)
 SELECT 'ks' AS metric, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std FROM m""")
def fidelity_summary(s, d):
    m = fidelity.distances(fidelity.frequencies(flows(s, d), NUM + CAT)).select(F.lit("ks").alias("metric"), "column", F.col("ks").alias("value"))
    return _round(fidelity.summarise(m), 6, "mean", "std")


@query(f"""WITH {FLOWS}, {_cells(NUM)}, s AS (SELECT "column", min(value) AS lo, greatest(2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(*), 1.0 / 3), log2(count(*)) + 1) AS w FROM q WHERE n_a > 0 GROUP BY 1),
 k AS (SELECT "column", floor((value - lo) / w) AS b, sum(n_a) AS n FROM q JOIN s USING ("column") WHERE n_a > 0 GROUP BY ALL), p AS (SELECT "column", n / sum(n) OVER (PARTITION BY "column") AS p FROM k) SELECT "column", round(sum(-p * ln(p)), 6) AS entropy FROM p GROUP BY 1""")
def entropy_weighted_bins(s, d):
    return _round(fidelity.weighted_bins_entropy(fidelity.frequencies(flows(s, d), NUM), "n_a"), 6, "entropy")


@query(f"WITH {FLOWS}, {_cells(['dst', 'in_pkts'])} SELECT \"column\", value, coalesce(sum(n_a) OVER (PARTITION BY \"column\" ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rows_below FROM q")
def rank_counts(s, d):
    return fidelity.rank_counts(fidelity.frequencies(flows(s, d), ["dst", "in_pkts"]), "n_a")


@query(f"WITH {FLOWS}, a AS (SELECT proto AS i, sum(count(*)) OVER (ORDER BY proto) / sum(count(*)) OVER () AS a FROM f WHERE NOT syn GROUP BY proto), b AS (SELECT proto + 2 AS i, sum(count(*)) OVER (ORDER BY proto) / sum(count(*)) OVER () AS b FROM f WHERE syn GROUP BY proto), j AS (SELECT coalesce(last_value(a IGNORE NULLS) OVER w, 0) AS a, coalesce(last_value(b IGNORE NULLS) OVER w, 0) AS b FROM a FULL JOIN b USING (i) WINDOW w AS (ORDER BY i)) SELECT round(max(abs(a - b)), 6) AS max_gap, round(avg(abs(a - b)), 6) AS mean_gap FROM j")
def cdf_gap_padded(s, d):
    f = flows(s, d)
    count = lambda df, i: df.groupBy(i.alias("i")).agg(F.count("*").alias("n"))
    return _round(fidelity.padded_cdf_gap(count(f.where("not syn"), F.col("proto")), count(f.where("syn"), F.col("proto") + 2)), 6, "max_gap", "mean_gap")


@query(f"WITH {FLOWS} SELECT least(floor((in_bytes - lo) / (hi - lo) * 15), 14)::INT AS bin, sum((NOT syn)::INT)::BIGINT AS n_a, sum(syn::INT)::BIGINT AS n_b FROM f, (SELECT min(in_bytes) lo, max(in_bytes) hi FROM f) GROUP BY 1")
def histogram_comparison(s, d):
    return fidelity.histograms(flows(s, d), "in_bytes")


def _mmd_sql(columns: list[str], features: int = 128) -> str:
    draws = fidelity.fourier_draws(len(columns), features)
    cell = lambda ws, o: "cos(" + " + ".join(f"{c} * ({w!r})::DOUBLE" for c, w in zip(columns, ws)) + f" + ({o!r})::DOUBLE)"
    means = ", ".join(f"avg({cell(ws, o)}) FILTER (NOT syn) - avg({cell(ws, o)}) FILTER (syn) AS f{i}" for i, (ws, o) in enumerate(draws))
    return f"WITH {FLOWS}, m AS (SELECT {means} FROM f) SELECT round({2.0 / features!r} * ({' + '.join(f'f{i} * f{i}' for i in range(features))}), 9) AS mmd2 FROM m"


@query(_mmd_sql(["discount", "tax"]))
def fidelity_mmd(s, d):
    return _round(fidelity.mmd(flows(s, d), ["discount", "tax"]), 9, "mmd2")


_RANKED = ["in_bytes", "in_pkts", "discount", "tax"]


def _spearman_sql() -> str:
    r = ", ".join(f"rank() OVER (PARTITION BY syn ORDER BY {c}) + (count(*) OVER (PARTITION BY syn, {c}) - 1) / 2.0 AS r_{c}" for c in _RANKED)
    cells = " UNION ALL ".join(f"SELECT syn, '{a}' AS a, '{b}' AS b, {'1.0' if a == b else f'corr(r_{min(a, b)}, r_{max(a, b)})'}::DOUBLE AS rho FROM r GROUP BY syn" for a in _RANKED for b in _RANKED)
    return f"WITH {FLOWS}, r AS (SELECT syn, {r} FROM f), m AS ({cells}) "


@query(_spearman_sql() + "SELECT syn, a, b, round(rho, 6) + 0.0 AS rho FROM m")
def spearman_matrix(s, d):
    return association.spearman(flows(s, d), _RANKED).select("syn", "a", "b", (F.round("rho", 6) + F.lit(0.0)).alias("rho"))


@query(_spearman_sql() + ", g AS (SELECT abs(max(rho) FILTER (NOT syn) - max(rho) FILTER (syn)) AS gap FROM m GROUP BY a, b) SELECT round(avg(gap), 6) AS mean_gap, round(stddev_pop(gap), 6) AS std_gap FROM g")
def spearman_difference(s, d):
    return _round(association.correlation_difference(association.spearman(flows(s, d), _RANKED)), 6, "mean_gap", "std_gap")


_MI = ["discount", "flag", "proto", "status", "tax"]


@query(f"WITH {FLOWS} " + " UNION ALL ".join(f"SELECT syn, '{a}' AS a, '{b}' AS b, round(sum(n / t * ln(n * t / (nx * ny))), 6) AS mi FROM (SELECT syn, n, sum(n) OVER (PARTITION BY syn) t, sum(n) OVER (PARTITION BY syn, x) nx, sum(n) OVER (PARTITION BY syn, y) ny FROM (SELECT syn, {a} x, {b} y, count(*)::DOUBLE n FROM f GROUP BY ALL)) GROUP BY syn" for i, a in enumerate(_MI) for b in _MI[i + 1 :]))
def mutual_information(s, d):
    return _round(association.mutual_information(flows(s, d), _MI), 6, "mi")
