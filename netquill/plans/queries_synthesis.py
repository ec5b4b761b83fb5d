"""Queries over synthesis, order-dependent sketches, classifiers, sources and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netquill.operators import bayes, elastic, flow_queries, generator, sequences, utility
from netquill.plans import settings
from netquill.plans.queries_stats import _round
from netquill.queries import ORACLE, QUERIES, flows, load, query
from netquill.sources import tables
from netquill.streaming import flow_stream

_COLS = ["flag", "proto", "status", "tax"]


def _table(s, d) -> DataFrame:
    t = load(s, d, "lineitem")
    return t.select(F.col("l_returnflag").alias("flag"), F.col("l_linenumber").alias("proto"), F.col("l_linestatus").alias("status"), F.col("l_tax").alias("tax"), F.col("l_extendedprice").alias("price"))


_B = "b AS (SELECT l_returnflag AS flag, l_linenumber AS proto, l_linestatus AS status, l_tax AS tax, l_extendedprice AS price FROM lineitem)"


def _code(c: str) -> str:
    if c == "price":
        return "greatest(least(floor((price - lo) / w + 1e-12), 19), 0)::INT"
    return f"dense_rank() OVER (ORDER BY {c})::INT - 1"


@query(f"WITH {_B} " + " UNION ALL ".join(f"SELECT '{c}' AS attribute, code::INT AS code, round(count(*) / sum(count(*)) OVER (), 6) AS probability FROM (SELECT dense_rank() OVER (ORDER BY {c}) - 1 AS code FROM b) GROUP BY code" for c in _COLS))
def bayes_marginals(s, d):
    t = _table(s, d).select(*_COLS)
    desc = bayes.describe(t)
    return _round(bayes.marginals(bayes.encode(t, desc), desc), 6, "probability")


@query(f"WITH {_B} SELECT flag, proto, status, tax, count(*) AS n FROM (SELECT {', '.join(f'{_code(c)} AS {c}' for c in _COLS)} FROM b) GROUP BY ALL")
def bayes_codes(s, d):
    t = _table(s, d).select(*_COLS)
    return bayes.encode(t, bayes.describe(t)).groupBy(*_COLS).agg(F.count("*").alias("n"))


@query(f"WITH {_B}, e AS (SELECT count(*) AS n, min(price) AS lo, (max(price) - min(price)) / 20 AS w FROM b) SELECT sum((price >= lo + i * w)::INT)::BIGINT AS rows_from_edge, i::INT AS edge FROM b, e, range(0, 20) t(i) GROUP BY i")
def bayes_bin_edges(s, d):
    t = _table(s, d).select("price")
    desc = bayes.describe(t)
    codes = bayes.encode(t, desc)
    edge = s.range(20).select(F.col("id").cast("int").alias("edge"))
    return codes.groupBy("price").agg(F.count("*").alias("n")).crossJoin(F.broadcast(edge)).groupBy("edge").agg(F.sum(F.when(F.col("price") >= F.col("edge"), F.col("n")).otherwise(0)).alias("rows_from_edge"))


@query("SELECT * FROM (VALUES ('flag','String',true,false), ('proto','Integer',true,false), ('status','String',true,false), ('tax','Float',true,false), ('price','Float',false,false)) t(attribute, kind, categorical, candidate_key)")
def bayes_description(s, d):
    desc = bayes.describe(_table(s, d))
    return s.createDataFrame([(a.name, a.kind, a.categorical, a.candidate_key) for a in desc.attributes], "attribute string, kind string, categorical boolean, candidate_key boolean")


_EDGES = [("flag", []), ("status", ["flag"]), ("tax", ["status"]), ("proto", ["tax"])]


@query(f"WITH {_B}, c AS (SELECT {', '.join(f'{_code(c)} AS {c}' for c in _COLS)} FROM b) " + " UNION ALL ".join(f"SELECT '{c}' AS child, {p[0] + '::VARCHAR' if p else chr(39) * 2} AS parents, {c} AS code, round(count(*) / sum(count(*)) OVER (PARTITION BY {p[0] if p else 1}), 6) AS probability FROM c GROUP BY {', '.join([c, *p])}" for c, p in _EDGES))
def bayes_conditionals(s, d):
    t = _table(s, d).select(*_COLS)
    desc = bayes.describe(t)
    return _round(bayes.conditionals(bayes.encode(t, desc), _EDGES, {a.name: len(a.bins) for a in desc.attributes}), 6, "probability")


@query("SELECT * FROM (VALUES ('flag_a','status_x'), ('flag_b','status_x'), ('status_x','tax')) t(parent, child)")
def bayes_adjacency(s, d):
    return bayes.adjacency(s, [("flag", []), ("status", ["flag"]), ("tax", ["status"])], {"flag": ["flag_a", "flag_b"], "status": ["status_x"]})


@query()
def bayes_network(s, d):
    t = _table(s, d)
    desc = bayes.describe(t)
    edges = bayes.learn_network(bayes.encode(t, desc), desc.rows)
    return s.createDataFrame(edges, "child string, parents array<string>")


@query("SELECT count(*) AS n_rows FROM lineitem")
def bayes_synthesis_rows(s, d):
    return bayes.synthesise(_table(s, d)).agg(F.count("*").alias("n_rows"))


@query()
def bayes_synthesis(s, d):
    return bayes.synthesise(_table(s, d))


@query()
def bayes_independent(s, d):
    t = _table(s, d)
    desc = bayes.describe(t)
    names = [a.name for a in desc.attributes]
    return bayes.decode(bayes.sample_independent(s, desc.rows, bayes.marginals(bayes.encode(t, desc), desc, 1.0), names), desc)


@query()
def bayes_random(s, d):
    desc = bayes.describe(_table(s, d))
    return bayes.sample_random(s, desc.rows, desc)


@query("SELECT range AS id, range AS c_custkey FROM range(0, (SELECT count(*) FROM customer))")
def bayes_candidate_keys(s, d):
    desc = bayes.describe(load(s, d, "customer").select("c_custkey", "c_nationkey"))
    return bayes.candidate_keys(s, desc.rows, desc)


@query()
def sketch_elastic(s, d):
    return elastic.elastic_summaries(load(s, d, "events"), ["user_id", "event_type"], "event_id")


@query("SELECT round(avg((p = y)::INT), 6) AS accuracy, round(sum((p = 1 AND y = 1)::INT) / sum((p = 1)::INT), 6) AS precision, round(sum((p = 1 AND y = 1)::INT) / sum((y = 1)::INT), 6) AS recall FROM (SELECT (l_quantity > 25)::INT AS p, (l_linestatus = 'O')::INT AS y FROM lineitem)")
def classifier_scores(s, d):
    t = load(s, d, "lineitem").select((F.col("l_quantity") > 25).cast("int").alias("prediction"), (F.col("l_linestatus") == "O").cast("int").alias("label"))
    return _round(utility.scores(t), 6, "accuracy", "precision", "recall")


@query()
def classifier_comparison(s, d):
    t = load(s, d, "lineitem").select(F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("p"), F.col("l_discount").alias("d"), (F.col("l_extendedprice") > 36000).cast("int").alias("label"), F.col("l_orderkey").alias("k"))
    train, test = sequences.split(t, "k", 0.5)
    real, synthetic = sequences.split(train, "k", 0.5, seed=1)
    return utility.compare(real, synthetic, test, ["q", "p", "d"], "label")


@query()
def generated_rows(s, d):
    t = _table(s, d)
    return generator.synthesise(t, ["price", "tax"], ["flag", "status"], t.count())


def _scratch(s) -> str:
    return f"{tables.work_dir(s)}/netquill-io-{uuid.uuid4().hex}"


@query("SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def source_csv_round_trip(s, d):
    path = _scratch(s)
    df = load(s, d, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    tables.write(df, path, "csv", single_file=True)
    return tables.read(s, path, "csv", schema="c_custkey long, c_nationkey int, c_acctbal double, c_mktsegment string")


@query("SELECT l_orderkey::DOUBLE AS l_orderkey, l_quantity, l_returnflag, l_linestatus FROM lineitem")
def source_prepared(s, d):
    got = tables.read_prepared(s, f"{d}/lineitem.parquet", "parquet", excluded=["l_shipdate"])
    return got.data.select("l_orderkey", "l_quantity", "l_returnflag", "l_linestatus")


@query("SELECT s_nationkey, s_name AS name, round_even(s_acctbal, 0) AS s_acctbal, s_suppkey, syn FROM (SELECT *, false AS syn FROM supplier UNION ALL SELECT *, true FROM supplier)")
def source_pair(s, d):
    p = f"{d}/supplier.parquet"
    return tables.read_pair(s, p, p, "parquet", digits=0).withColumnRenamed("s_name", "name")


@query("SELECT count(*) AS n_rows FROM orders")
def source_reload_prepared(s, d):
    from netquill.plans import transform_plan

    path = _scratch(s)
    df = load(s, d, "orders").select("o_totalprice", "o_orderstatus")
    tables.save_prepared(transform_plan.prepare(df, ["o_totalprice"], ["o_orderstatus"], {"transforms": {"default": [{"method": "standard"}]}}), path)
    got = tables.load_prepared(s, path)
    return transform_plan.restore(got.data, got.steps, got.columns).agg(F.count("*").alias("n_rows"))


def _events_folder(s, d, ends: bool = False) -> tuple[str, object]:
    """Events as four files; ends: and a later row that closes all windows."""
    df = load(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    path = _scratch(s)
    df.repartitionByRange(4, "ts").write.parquet(path)
    if ends:
        flow_stream.close(df, path, "ts")
    return path, df.schema


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_windowed_counts(s, d):
    path, schema = _events_folder(s, d, ends=True)
    got = flow_stream.windowed_counts(flow_stream.read_stream(s, path, schema, 4), "ts", ["event_type"])
    return flow_stream.run_to_end(got, _scratch(s)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT count(*) AS n_events FROM events")
def stream_sessions(s, d):
    path, schema = _events_folder(s, d, ends=True)
    got = flow_stream.sessions(flow_stream.read_stream(s, path, schema, 4), "ts", "user_id")
    return flow_stream.run_to_end(got, _scratch(s)).agg(F.sum("n").alias("n_events"))


@query()
def stream_sketch(s, d):
    path, schema = _events_folder(s, d)
    out = _scratch(s)
    q = flow_stream.read_stream(s, path, schema).writeStream.foreachBatch(flow_stream.sketch_sink(["user_id"], out, 4, 64)).option("checkpointLocation", f"{out}-log").trigger(availableNow=True).start()
    q.awaitTermination()
    return flow_stream.merged_sketch(s, out)


@query()
def table_size(s, d):
    n = tables.total_bytes(s, f"{d}/lineitem.parquet")
    return s.createDataFrame([(n, tables.block_size(s, f"{d}/lineitem.parquet"))], "bytes long, block long")


@query("SELECT count(*) AS n_rows FROM customer")
def source_sample(s, d):
    got = tables.read_sample(s, f"{d}/customer.parquet", 1.0, "parquet")
    return got.data.agg(F.count("*").alias("n_rows"))


@query("SELECT c_custkey, c_name || ' é' AS c_name, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS c_mktsegment FROM customer")
def source_latin1(s, d):
    """Latin-1 bytes, a string for nulls, and blanks after the separator, as they come."""
    path = _scratch(s)
    df = load(s, d, "customer").select("c_custkey", F.concat("c_name", F.lit(" é")).alias("c_name"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")).otherwise("?").alias("c_mktsegment"))
    df.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return tables.read(s, path, "csv", "c_custkey long, c_name string, c_mktsegment string", nulls="?")


@query(ORACLE["flow_report"])
def report_saved(s, d):
    path = _scratch(s)
    report = flow_queries.flow_report(flows(s, d))
    tables.save_report(report, path, source=d, rows=report.count())
    return tables.load_report(s, path, report.schema)[0]


@query(ORACLE["fidelity_cdf_distances"])
def report_saved_distances(s, d):
    path = _scratch(s)
    report = QUERIES["fidelity_cdf_distances"](s, d)
    tables.save_report(report, path, source=d, columns=["column"])
    return tables.load_report(s, path, report.schema)[0]


@query(ORACLE["bayes_description"])
def bayes_description_saved(s, d):
    desc = bayes.Description.loads(bayes.describe(_table(s, d)).dumps())
    return s.createDataFrame([(a.name, a.kind, a.categorical, a.candidate_key) for a in desc.attributes], "attribute string, kind string, categorical boolean, candidate_key boolean")


@query("SELECT 'a.csv,b.csv' AS inputs, 'syn' AS output, 'parquet' AS kind, 'time,timestamp' AS excluded, 2 AS digits, 1000 AS n_rows, 7 AS seed, true AS private, 1.5::DOUBLE AS epsilon, 1e-5::DOUBLE AS delta")
def run_settings(s, d):
    got = settings.RunSettings.from_args("--inputs a.csv b.csv --output syn --kind parquet --digits 2 --seed 7 --private --epsilon 1.5".split())
    row = (",".join(got.inputs), got.output, got.kind, ",".join(got.excluded), got.digits, got.rows, got.seed, got.private, got.epsilon, got.delta)
    return s.createDataFrame([row], "inputs string, output string, kind string, excluded string, digits int, n_rows int, seed int, private boolean, epsilon double, delta double")
