"""The telemetry operators: oracles, inverses, bounds and metamorphic laws."""

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from netquill import queries
from netquill.operators import bayes, clean, elastic, fidelity, flow_queries, generator, mixture, nearest, ranges, sequences, sketches
from netquill.operators import transforms as T
from netquill.plans import queries_models, queries_stats, queries_synthesis, transform_plan  # noqa: F401
from netquill.sources import tables

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df):
    key = sorted(df.columns)
    cell = lambda v: "~" if v is None or v != v else repr(round(float(v), 9)) if isinstance(v, (int, float, np.number)) else str(v)
    return sorted(tuple(map(cell, r)) for r in df[key].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_against_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE)))
def test_query_runs(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert df.columns and df.count() > 0


def test_drop_non_finite(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan")), (4, float("-inf")), (None, 2.0)], "a int, b double")
    assert [r.a for r in clean.drop_non_finite(df).collect()] == [1]


def test_roles_accept_auto_as_list(spark):
    df = spark.range(100).select("id", (F.col("id") % 3).alias("c"))
    assert clean.categorical_columns(df, ["auto"]) == clean.categorical_columns(df, "auto") == ["c"]
    assert clean.categorical_columns(df, ["id"]) == ["id"]


def test_inferred_types(spark):
    df = spark.createDataFrame([("2020-01-02", "123-45-6789", "Monday", 1.0, 1.5, None), ("2021-03-04 10:00:00", "987654321", "x", 2.0, 2.0, None)], "d string, s string, w string, i double, f double, n string")
    got = {r["column"]: r["type"] for r in clean.infer_types(df).collect()}
    assert got["d"] == "DateTime" and got["s"] == "SocialSecurityNumber" and got["w"] == "String" and got["i"] == "Integer" and got["f"] == "Float"


def test_a_table_agrees_with_itself(spark):
    base = queries.flows(spark, SF).where("not syn")
    both = base.union(base.withColumn("syn", F.lit(True)))
    freq = fidelity.frequencies(both, ["in_pkts", "discount"])
    for r in fidelity.distances(freq).collect():
        assert (r.ks, r.mean_quantile_error, r.emd) == (0, 0, 0)
    for r in fidelity.divergences(freq).collect():
        assert r.jsd == pytest.approx(0, abs=1e-7) and r.kl == pytest.approx(0, abs=1e-12)
    assert all(r.iou == 1 and r.recall == 1 for r in flow_queries.flow_report(both).collect())
    assert all(r.recall_error == 0 for r in fidelity.top_recall_error(freq, 10, 0.0).collect())


def test_distances_are_symmetric_and_ordered(spark):
    f = queries.flows(spark, SF)
    a = fidelity.distances(fidelity.frequencies(f, ["in_bytes"])).first()
    b = fidelity.distances(fidelity.frequencies(f.withColumn("syn", ~F.col("syn")), ["in_bytes"])).first()
    assert a.ks == pytest.approx(b.ks) and a.emd == pytest.approx(b.emd) and a.ks >= a.mean_quantile_error


def test_empty_sides_give_null(spark):
    f = queries.flows(spark, SF).where("false")
    assert all(r.iou is None and r.recall is None for r in flow_queries.flow_report(f).collect())


def test_compat_std_counts_the_mean(spark):
    m = spark.createDataFrame([("ks", "a", 1.0), ("ks", "b", 2.0), ("ks", "c", 4.0)], "metric string, column string, value double")
    assert fidelity.summarise(m).first().std == pytest.approx(np.std([1, 2, 4], ddof=1))
    assert fidelity.summarise(m, compat_std=True).first().std == pytest.approx(np.std([1, 2, 4, 7 / 3], ddof=1))


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(100, 5, 300), rng.normal(500, 20, 300)))
    return spark.createDataFrame([(int(i), float(abs(v)), int(i % 7), "abc"[i % 3], 5.0) for i, v in enumerate(x)], "id long, x double, n int, c string, k double")


@pytest.mark.parametrize("fit", [T.fit_standard, T.fit_minmax, T.fit_robust, lambda d, c: T.Log(c), lambda d, c: mixture.fit_mixture(d, c)])
def test_inverse_is_identity(numbers, fit):
    step = fit(numbers, ["x"])
    back = T.Step.from_dict(step.to_dict()).inverse(step.forward(numbers)).select("id", F.col("x").alias("y"))
    gap = numbers.join(back, "id").agg(F.max(F.abs(F.col("x") - F.col("y")))).first()[0]
    assert gap < 1e-6 or isinstance(step, mixture.Mixture) and gap < 30


def test_constant_column_scales_to_zero(numbers):
    assert T.fit_minmax(numbers, ["k"]).forward(numbers).agg(F.max("k")).first()[0] == 0
    assert T.fit_standard(numbers, ["k"]).forward(numbers).agg(F.max("k")).first()[0] == 0


def test_plan_round_trip_and_saved_steps(spark, numbers, tmp_path):
    config = {"transforms": {"custom": [{"method": "log_minmax", "columns": ["x"]}, {"method": "bits", "columns": ["n"]}], "default": [{"method": "standard"}]}}
    ready = transform_plan.prepare(numbers, ["x", "n", "k"], ["c"], config)
    assert ready.categories["c"] == 3 and ready.data.columns[:3] == ["c__0", "c__1", "c__2"]
    tables.save_prepared(ready, str(tmp_path / "p"))
    again = tables.load_prepared(spark, str(tmp_path / "p"))
    back = transform_plan.restore(again.data, again.steps, again.columns)
    assert back.columns == numbers.columns
    joined = numbers.join(back.select(F.round("id").cast("long").alias("id"), F.col("x").alias("y"), F.col("n").cast("int").alias("m"), F.col("c").alias("e")), "id")
    assert joined.where("abs(x - y) > 1e-6 or n <> m or c <> e").count() == 0 and joined.count() == 600
    with pytest.raises(ValueError):
        transform_plan.prepare(numbers, ["x"], [], {"transforms": {"default": [{"method": "nope"}]}})
    assert transform_plan.prepare(numbers, ["x"], ["c"]).data is numbers


def test_mixture_finds_two_modes():
    rng = np.random.default_rng(1)
    x = np.concatenate((rng.normal(0, 1, 2000), rng.normal(50, 2, 1000)))
    w, m, s = mixture.fit_values(x)
    one = lambda w, m, s: np.log(np.exp(-((x[:, None] - m) ** 2) / (2 * s * s)) / s @ w / math.sqrt(2 * math.pi)).mean()
    assert one(w, m, s) > one(np.array([2 / 3, 1 / 3]), np.array([0.0, 50.0]), np.array([1.0, 2.0])) - 0.1
    assert w.sum() == pytest.approx(1) and mixture.fit_values(np.array([]))[0].tolist() == [1.0]


def test_sketch_error_and_noise(spark):
    f = queries.flows(spark, SF)
    v = sketches.value_counts(f, ["src"]).cache()
    est = sketches.estimates(sketches.count_sketch(v, 9, 512), v, 9, 512).join(v, ["column", "value"])
    l2 = math.sqrt(v.agg(F.sum(F.col("n") * F.col("n"))).first()[0])
    assert est.agg(F.max(F.abs(F.col("estimate") - F.col("n")))).first()[0] <= 3 * l2 / math.sqrt(512) + 1
    s = sketches.count_sketch(v, 5, 64)
    own = s.withColumnRenamed("cell", "exact")
    gap = lambda rho: sketches.with_noise(s, rho, 5, 64).join(own, ["column", "row", "bucket"]).agg(F.stddev(F.col("cell") - F.col("exact"))).first()[0]
    assert gap(1e12) < 1e-3 and 0.5 < gap(2.0) / sketches.noise_scale(2.0, 5) < 2


def test_dyadic_rank_is_exact_without_collisions(spark):
    v = spark.createDataFrame([("c", str(i), i % 3 + 1) for i in range(0, 64, 3)], "column string, value string, n long")
    sk = sketches.dyadic_sketch(v, 64, 0.001)
    asked = spark.createDataFrame([("c", x) for x in range(0, 64, 7)], "column string, x long")
    got = {r.x: r.rank for r in sketches.dyadic_rank(sk, asked, 64, 0.001).collect()}
    assert got == {x: sum(i % 3 + 1 for i in range(0, x, 3)) for x in range(0, 64, 7)}


def test_elastic_against_exact_counts():
    rng = np.random.default_rng(2)
    draw = [f"hot{rng.integers(10)}" if rng.random() < 0.8 else f"id{rng.integers(10, 2000)}" for _ in range(10_000)]
    sk = elastic.Elastic(64, 8192)
    for x in draw:
        sk.insert(x)
    exact = {x: draw.count(x) for x in set(draw) if x.startswith("hot")}
    assert all(abs(sk.query(x) - n) <= 0.05 * n for x, n in exact.items())
    assert abs(sk.cardinality() / len(set(draw)) - 1) < 0.1
    assert sk.cdf()[-1] == pytest.approx(1) and sk.largest() <= max(exact.values()) + 255 and sk.space() > 8192


def test_windows_come_once_and_whole(spark):
    df = spark.range(0, 103).select(F.col("id").alias("t"), (F.col("id") * 2).alias("v")).repartition(5)
    got = {r.window_id: [x[0] for x in r.rows] for r in sequences.sliding_windows(df, "t", ["v"], 10, 3, block=16).collect()}
    assert got == {i: [2.0 * (3 * i + k) for k in range(10)] for i in range(32)}
    assert sequences.batches(df, "t", 10, keep_last=False).count() == 100
    a, b = sequences.split(df, "t")
    assert a.count() + b.count() == 103 and a.join(b, "t").count() == 0


def test_nearest_value_ties_and_outside(spark):
    q = spark.createDataFrame([(-5.0,), (2.0,), (2.5,), (99.0,), (3.0,)], "value double")
    v = spark.createDataFrame([(1.0,), (3.0,), (10.0,)], "value double")
    assert {r.value: r.nearest for r in nearest.nearest_value(q, v).collect()} == {-5.0: 1.0, 2.0: 1.0, 2.5: 3.0, 99.0: 10.0, 3.0: 3.0}


def test_nearest_value_against_brute_force(spark):
    rng = np.random.default_rng(6)
    q, v = rng.integers(-1000, 5000, 700), rng.integers(0, 4000, 300)
    got = {r.value: r.nearest for r in nearest.nearest_value(spark.createDataFrame([(float(x),) for x in q], "value double"), spark.createDataFrame([(float(x),) for x in v], "value double")).collect()}
    assert got == {float(x): float(min(set(v.tolist()), key=lambda k: (abs(k - x), k))) for x in set(q.tolist())}


def test_running_sums_and_quantiles_in_ranges(spark):
    rng = np.random.default_rng(7)
    x = {k: rng.integers(0, 10**6, n) ** 2 / 7.0 for k, n in (("a", 900), ("b", 3), ("c", 1))}
    counts = spark.createDataFrame([(k, float(v)) for k, vs in x.items() for v in vs], "key string, v double").groupBy("key", "v").agg(F.count("*").alias("n"))
    for buckets in (1, 5, 64):
        rows = ranges.running(counts, ["key"], "v", ["n"], buckets).collect()
        for k, vs in x.items():
            own = sorted((r for r in rows if r.key == k), key=lambda r: r.v)
            assert [r.v for r in own] == sorted(set(vs)) and [r.c_n for r in own] == [int((vs <= r.v).sum()) for r in own]
            assert [r.next for r in own] == [*[r.v for r in own[1:]], None] and {r.t_n for r in own} == {len(vs)}
    got = {r.key: r.q for r in ranges.quantiles(counts, ["key"], "v", "n", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    assert all(got[k] == pytest.approx(list(np.quantile(vs, [0.0, 0.25, 0.5, 0.9, 1.0]))) for k, vs in x.items())


def test_index_recall_and_hot_cells(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    exact = {r.vec_id: r.distance for r in queries.QUERIES["nearest_word"](spark, d).collect()}
    e = spark.read.parquet(f"{d}/embeddings.parquet")
    assert len(exact) == e.where("vec_id % 100 = 0").count()
    for rows in (nearest.CELL_ROWS, 7):
        monkeypatch.setattr(nearest, "CELL_ROWS", rows)
        got = {r.vec_id: r.distance for r in queries.QUERIES["nearest_word_index"](spark, d).collect()}
        assert got.keys() == exact.keys() and np.mean([abs(got[k] - exact[k]) < 1e-6 for k in exact]) >= 0.85  # of 20 queries
    words = e.select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))
    own = words.withColumnRenamed("word", "vec_id")
    every = {r.vec_id: r.distance for r in nearest.nearest_vector(own, words, "vec_id", digits=6, apart=True).collect()}
    got = {r.vec_id: r.distance for r in nearest.nearest_vector_index(own, words, "vec_id", digits=6, apart=True).collect()}
    share = np.mean([abs(got[k] - every[k]) < 1e-6 for k in every])
    print(f"recall {share} over {len(every)} queries")
    assert got.keys() == every.keys() and share >= 0.92
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 3)
    assert {r.vec_id: r.distance for r in queries.QUERIES["nearest_word"](spark, d).collect()} == exact


def test_mixture_fits_all_rows_in_any_order(spark):
    rng = np.random.default_rng(8)
    late = np.concatenate((rng.normal(10, 1, 60_000), rng.normal(900, 30, 6_000)))  # the second mode comes last
    df = spark.createDataFrame([(float(x),) for x in late], "x double").repartition(3)
    a, b = mixture.fit_mixture(df, ["x"]), mixture.fit_mixture(df.orderBy(F.col("x").desc()).repartition(7), ["x"])
    assert a.means["x"] == pytest.approx(b.means["x"], rel=1e-3) and max(a.means["x"]) > 800
    assert sum(w for w, m in zip(a.weights["x"], a.means["x"]) if m > 500) == pytest.approx(1 / 11, abs=0.01)


def test_capped_sample_draws_from_all_rows(spark):
    df = spark.range(0, 100_000, 1, 10)
    got = [r.id for r in sequences.capped_sample(df, 0.5, 2_000).collect()]
    assert len(got) == 2_000 and 45_000 < np.mean(got) < 55_000


def test_mmd_of_equal_and_shifted_tables(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(4000, 2))
    rows = [(float(a), float(b), i % 2 == 1) for i, (a, b) in enumerate(x)]
    same = fidelity.mmd(spark.createDataFrame(rows, "a double, b double, syn boolean"), ["a", "b"]).first().mmd2
    far = fidelity.mmd(spark.createDataFrame([(a + 2 * s, b, s) for a, b, s in rows], "a double, b double, syn boolean"), ["a", "b"]).first().mmd2
    exact = 2 * (1 / 3) * (1 - math.exp(-4 / 6))  # E k = 1/3 exp(-|shift|^2 / 6) for unit normals and width 1
    assert same < 0.005 and far == pytest.approx(exact, rel=0.25)


def test_rows_come_one_partition_at_a_time(spark):
    assert sorted(r.id for r in sequences.iterate(spark.range(0, 100, 1, 7), ["id"])) == list(range(100))


def test_network_follows_dependence_and_budget_adds_up(spark):
    rng = np.random.default_rng(3)
    a = rng.integers(0, 4, 2000)
    t = spark.createDataFrame([(int(x), int(x) if rng.random() < 0.95 else 0, int(rng.integers(0, 4))) for x in a], "a int, b int, c int")
    d, tables_, marginal = bayes.learn(t)
    assert ("b", ["a"]) in d.edges
    private, *_ = bayes.learn(t, epsilon=3.0)
    assert sum(private.spent.values()) == pytest.approx(3.0)
    out = bayes.decode(bayes.sample_codes(spark, 3000, d.edges, tables_, marginal), d).toPandas()
    assert len(out) == 3000 and abs((out.a == out.b).mean() - (t.toPandas().a == t.toPandas().b).mean()) < 0.05
    again = bayes.decode(bayes.sample_codes(spark, 3000, d.edges, tables_, marginal).repartition(7), d).toPandas().sort_values("id")
    assert again.reset_index(drop=True).equals(out.sort_values("id").reset_index(drop=True))


def test_description_survives_json(spark, tmp_path):
    d = bayes.describe(spark.createDataFrame([(1, "x", None), (2, "y", None)], "a int, b string, n string"))
    d.save(str(tmp_path / "d.json"))
    assert bayes.Description.load(str(tmp_path / "d.json")).attributes == d.attributes and "n" not in [a.name for a in d.attributes]


def test_generator_trains_on_all_rows(spark, monkeypatch):
    seen, own = [], generator.Autoencoder._gradients
    monkeypatch.setattr(generator.Autoencoder, "_gradients", lambda self, x: (seen.append((len(x), x[:, :2].sum(0))), own(self, x))[1])
    late = spark.range(60_000).selectExpr("id % 7 AS x", "if(id < 50000, 'a', 'b') AS c")
    generator.synthesise(late, ["x"], ["c"], 1, settings=generator.Settings(epochs=2))
    assert sum(n for n, _ in seen) == 120_000
    assert sorted(sum(s for _, s in seen).tolist()) == [20_000, 100_000]  # the late category too
    assert all(0 < s.min() for n, s in seen if n == 256)  # and in every batch, not at the end


def test_generator_gives_the_asked_rows(spark, numbers):
    got = generator.synthesise(numbers, ["x"], ["c"], 77, settings=generator.Settings(epochs=3))
    assert got.count() == 77 and got.columns == ["x", "c"] and {r.c for r in got.select("c").distinct().collect()} <= {"a", "b", "c"}
    private = generator.Settings(epochs=1, clip=1.0, noise=1.0)
    assert generator.synthesise(numbers, ["x"], ["c"], 5, settings=private).count() == 5


def test_privacy_accounting():
    assert generator.privacy_spent(1.0, 1.0, 1, 1e-5) == pytest.approx(min(a / 2 + math.log1p(-1 / a) - math.log(1e-5 * a) / (a - 1) for a in range(2, 129)))
    assert generator.privacy_spent(1.1, 0.01, 1000, 1e-5) < generator.privacy_spent(1.1, 0.02, 1000, 1e-5) < generator.privacy_spent(1.1, 1.0, 1000, 1e-5)
    for epsilon in (0.5, 2.0, 8.0):
        noise = generator.noise_for(epsilon, 1e-5, 0.01, 500)
        assert generator.privacy_spent(noise, 0.01, 500, 1e-5) <= epsilon < generator.privacy_spent(noise * 0.99, 0.01, 500, 1e-5)


def test_private_training_finds_its_noise(spark, numbers, monkeypatch):
    seen, own = [], generator.Autoencoder.__init__
    monkeypatch.setattr(generator.Autoencoder, "__init__", lambda self, w, b, s_: (seen.append(s_), own(self, w, b, s_))[1])
    generator.synthesise(numbers, ["x"], ["c"], 3, settings=generator.Settings(epochs=1, epsilon=2.0))
    assert seen[0].clip == 1.0 and seen[0].noise == generator.noise_for(2.0, 1e-5, 256 / 600, 3)


def test_dirty_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("a, b\n1, caf\xe9\n?, x\n".encode("latin1"))
    got = tables.read(spark, str(tmp_path / "a.csv"), encoding="latin1", nulls="?").collect()
    assert [tuple(r) for r in got] == [(1, "caf\xe9"), (None, "x")]
    with pytest.raises(ValueError):
        tables.read(spark, "x", "xml")


def test_ports_beyond_the_last_word_take_it_both_ways(spark):
    vocab = queries_models._port_vectors(spark)
    df = spark.createDataFrame([(i, i) for i in (1997, 1998, 1999, 2000, 3000, 3001, 3002, 199_990)] + [(9, None)], "k long, port long")
    got = {r.k: r.port for r in nearest.decode(nearest.encode(df, {"port": "PORT"}, vocab, 2), {"port": "PORT"}, vocab, 2, "k").collect()}
    assert got == {k: "1998" for k in (1997, 1998, 1999, 2000, 3000, 3001, 3002, 199_990)} | {9: None}


def test_numbers_have_addresses_up_to_32_bits(spark):
    df = spark.createDataFrame([(0,), (167772161,), (2**32 - 1,), (2**32 + 5,)], "n long").select("n", T.number_to_ip(F.col("n")).alias("ip"))
    got = df.select("n", "ip", T.ip_to_number(F.col("ip")).alias("back")).collect()
    assert [(r.ip, r.back) for r in got] == [("0.0.0.0", 0), ("10.0.0.1", 167772161), ("255.255.255.255", 2**32 - 1), ("0.0.0.5", 5)]
