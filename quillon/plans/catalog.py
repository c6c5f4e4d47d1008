"""The registered queries over the driver's tables, and the same results in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays
from ..operators import evidence, governance, groups, neighbours, pairs, prepare, ranks, residual, scaling, tiles
from ..operators.selector import GeometrySelector
from ..sources.matrix import Matrix, array_columns, columns_of, vector_matrix
from . import oracle

#: Components of embeddings in the SQL; pairs and draws of queries that permute, and pairs of those that don't.
WIDTH, PAIRS, DRAWS, MANY_PAIRS = oracle.DIMS, 8_000, 20, GeometrySelector.max_pairs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


@dataclass(frozen=True)
class Size:
    """Components of the vectors (all that the table has), pairs of rows and draws of the null of a query."""

    width: int
    pairs: int = PAIRS
    draws: int = DRAWS

    @property
    def features(self) -> tuple[str, ...]:
        return tuple(f"f{k}" for k in range(self.width))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def embedded(sql: str | None = None, pairs: int = PAIRS, whole: bool = False) -> Callable[[Query], Query]:
    """A query over all rows and components of embeddings takes its Size last.  ``whole``: also registered as
    NAME_whole, with the selector's default numbers of pairs and draws, for which SQL is too slow."""

    def register(f: Query) -> Query:
        def sized(pairs: int, draws: int) -> Query:
            def run(spark: SparkSession, sf_dir: str) -> DataFrame:
                width = table(spark, sf_dir, "embeddings").agg(F.max(F.size("embedding"))).first()[0]
                return f(spark, sf_dir, Size(width, pairs, draws))

            run.__name__ = f.__name__
            return run

        if whole:
            QUERIES[f"{f.__name__}_whole"] = sized(GeometrySelector.max_pairs, GeometrySelector.n_permutations)
        return query(sql)(sized(pairs, DRAWS))

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return F.round(c, 6)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*(r6(c).alias(c) if c in names else F.col(c) for c in df.columns))


def vectors(spark: SparkSession, sf_dir: str, size: Size) -> DataFrame:
    """The components of embeddings as columns; labels stay away."""
    return array_columns(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", size.width)


def source(spark: SparkSession, sf_dir: str, size: Size) -> Matrix:
    return vector_matrix(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", size.features)


def selector(size: Size, **more) -> GeometrySelector:
    return GeometrySelector(**{"n_features": 2, "n_permutations": size.draws, "max_pairs": size.pairs} | more)


def geometry(spark: SparkSession, sf_dir: str, size: Size):
    return selector(size).geometry(source(spark, sf_dir, size))


def fitted(spark: SparkSession, sf_dir: str, size: Size, **more):
    return selector(size, **more).fit_matrix(source(spark, sf_dir, size))


def wide(expression: str) -> str:
    return ", ".join(expression.format(k=k) for k in range(WIDTH))


# Scaling


@embedded(f"WITH {oracle.matrix()}, {oracle.robust()} SELECT vec_id, {wide('round(f{k}, 6) AS f{k}')} FROM z")
def scale_robust(spark, sf_dir, size):
    x = source(spark, sf_dir, size)
    z = scaling.robust_vectors(x.table, size.features).apply_vectors(x.table).select("vec_id", "v")
    return rounded(columns_of(z, "v", size.features), *size.features)


@query("""SELECT p_partkey, round((p_size - a) / CASE WHEN s > 1e-12 THEN s ELSE 1 END, 6) AS p_size, round((p_retailprice - b) / CASE WHEN t > 1e-12 THEN t ELSE 1 END, 6) AS p_retailprice
FROM part, (SELECT avg(p_size) AS a, stddev_pop(p_size) AS s, avg(p_retailprice) AS b, stddev_pop(p_retailprice) AS t FROM part)""")
def scale_meanstd(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    names = ("p_size", "p_retailprice")
    return rounded(scaling.mean_sd(df, names).apply(df), *names)


@query("""SELECT p_partkey, round((p_size - a) / CAST(b - a AS DOUBLE), 6) AS p_size, round((p_retailprice - c) / (d - c), 6) AS p_retailprice
FROM part, (SELECT min(p_size) AS a, max(p_size) AS b, min(p_retailprice) AS c, max(p_retailprice) AS d FROM part)""")
def scale_minmax(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    names = ("p_size", "p_retailprice")
    return rounded(scaling.min_max(df, names)[0].apply(df), *names)


@query("""WITH v AS (SELECT 'l_quantity' AS feature, 1 AS place, var_pop(l_quantity) AS variance FROM lineitem UNION ALL SELECT 'l_extendedprice', 2, var_pop(l_extendedprice) FROM lineitem
UNION ALL SELECT 'l_discount', 3, var_pop(l_discount) FROM lineitem UNION ALL SELECT 'l_tax', 4, var_pop(l_tax) FROM lineitem)
SELECT feature, round(variance, 4) AS variance, CAST(row_number() OVER (ORDER BY variance DESC, place) AS INT) AS rank FROM v""")
def max_variance(spark, sf_dir):
    names = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return evidence.variances(table(spark, sf_dir, "lineitem").select(*names), names).withColumn("variance", F.round("variance", 4))


# Pairs and geometry


@query("WITH n AS (SELECT count(*) AS n FROM supplier) SELECT row_number() OVER (ORDER BY i, j) - 1 AS pair_id, i, j FROM n, range(0, (SELECT n FROM n)) a(i), range(0, (SELECT n FROM n)) b(j) WHERE i < j")
def pairs_all(spark, sf_dir):
    return pairs.all_pairs(spark, table(spark, sf_dir, "supplier").count())


@embedded(f"WITH {oracle.matrix()}, {oracle.balanced('vec_id', MANY_PAIRS)} SELECT pair_id, i, j FROM pairs", MANY_PAIRS)
def pairs_balanced(spark, sf_dir, size):
    x = source(spark, sf_dir, size)
    return pairs.balanced_pairs(x.data.select("vec_id", "pos"), x.rows, size.pairs, 0)


@embedded(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), d AS (SELECT id, CAST('0x' || substr(md5('a:0:' || id), 1, 12) AS BIGINT) % n AS a, CAST('0x' || substr(md5('b:0:' || id), 1, 12) AS BIGINT) % n AS b FROM range(0, {8 * MANY_PAIRS}) t(id), n),
f AS (SELECT least(a, b) AS i, greatest(a, b) AS j, min(id) AS id FROM d WHERE a <> b GROUP BY 1, 2), r AS (SELECT row_number() OVER (ORDER BY id) - 1 AS pair_id, i, j FROM f)
SELECT pair_id, i, j FROM r, n WHERE pair_id < {MANY_PAIRS} AND n * (n - 1) // 2 > {MANY_PAIRS}
UNION ALL SELECT i * (2 * n - i - 1) // 2 + j - i - 1, i, j FROM n, range(0, (SELECT n FROM n)) x(i), range(0, (SELECT n FROM n)) y(j) WHERE i < j AND n * (n - 1) // 2 <= {MANY_PAIRS}""", MANY_PAIRS)
def pairs_random(spark, sf_dir, size):
    x = source(spark, sf_dir, size)
    return pairs.random_pairs(spark, x.rows, size.pairs, 0)


@embedded(f"WITH {oracle.base(MANY_PAIRS)} SELECT pair_id, i, j, {wide('round(f{k}, 6) AS f{k}')} FROM g", MANY_PAIRS)
def pair_geometry(spark, sf_dir, size):
    return rounded(geometry(spark, sf_dir, size).profiles.select("pair_id", "i", "j", *size.features), *size.features)


@embedded(f"WITH {oracle.base(MANY_PAIRS)}, {oracle.profiles()}, {oracle.observed()} SELECT feature, round(aff.v, 6) AS affinity, round(cov.v, 6) AS coverage FROM aff JOIN cov USING (feature)", MANY_PAIRS)
def affinity_coverage(spark, sf_dir, size):
    g = geometry(spark, sf_dir, size)
    found = tiles.statistics(g.table, g.z, None, size.width, g.source.rows, 0)
    return rounded(found.select(F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), "affinity", "coverage"), "affinity", "coverage")


@embedded(f"WITH {oracle.base(MANY_PAIRS)}, {oracle.profiles()} SELECT pair_id, {wide('round(r{k} * 1000, 6) AS f{k}')} FROM rest", MANY_PAIRS)
def leave_one_out(spark, sf_dir, size):
    g = geometry(spark, sf_dir, size)
    rest = tiles.rest_profiles(g.table, arrays.column_sums(g.table, "g", size.width, lambda x: x))
    return rest.select("pair_id", *(r6(F.col("r")[k] * 1000).alias(c) for k, c in enumerate(size.features)))


@embedded(f"WITH {oracle.matrix()}, {oracle.bank(DRAWS)} SELECT CAST(b AS INT) AS b, pos, src FROM bank")
def permutation_bank(spark, sf_dir, size):
    x = source(spark, sf_dir, size)
    return pairs.permutation_bank(x.data.select("vec_id", "pos"), size.draws, 0)


@embedded(f"WITH {oracle.base(PAIRS)}, {oracle.profiles()}, {oracle.bank(DRAWS)}, {oracle.null()} SELECT CAST(b AS INT) AS b, feature, round(naff.v, 6) AS affinity, round(ncov.v, 6) AS coverage FROM naff JOIN ncov USING (b, feature)")
def null_statistics(spark, sf_dir, size):
    g = geometry(spark, sf_dir, size)
    bank = pairs.permutation_bank(g.source.data.select("vec_id", "pos"), size.draws, 0)
    found = tiles.statistics(g.table, g.z, bank, size.width, g.source.rows, size.draws).where("b >= 0")
    return rounded(found.select("b", F.concat(F.lit("f"), F.col("k").cast("string")).alias("feature"), "affinity", "coverage"), "affinity", "coverage")


SUPPORT = "feature, round(aff, 6) AS affinity, round(cov, 6) AS coverage, round(med, 6) AS null_median, round(scale, 6) AS null_scale, round(zr, 4) AS robust_z, round(eff, 4) AS effective_support, round(p, 6) AS adjusted_p"


def support_frame(spark, model) -> DataFrame:
    s = model.support
    rows = [(c, *(float(x[k]) for x in (s.affinity, s.coverage, s.null_median, s.null_scale, s.robust_z, s.effective, model.adjusted_p))) for k, c in enumerate(model.features)]
    df = spark.createDataFrame(rows, "feature string, affinity double, coverage double, null_median double, null_scale double, robust_z double, effective_support double, adjusted_p double")
    return rounded(df, "affinity", "coverage", "null_median", "null_scale", "adjusted_p").withColumns({c: F.round(c, 4) for c in ("robust_z", "effective_support")})


@embedded(f"WITH {oracle.full(PAIRS, DRAWS)} SELECT {SUPPORT} FROM sup JOIN adj USING (feature)")
def effective_support(spark, sf_dir, size):
    """The relational engine."""
    return support_frame(spark, fitted(spark, sf_dir, size, engine="relational"))


@embedded(f"WITH {oracle.full(PAIRS, DRAWS)} SELECT {SUPPORT} FROM sup JOIN adj USING (feature)")
def effective_support_arrow(spark, sf_dir, size):
    """The Arrow engine, a feature in each task: the same numbers."""
    return support_frame(spark, fitted(spark, sf_dir, size, engine="arrow"))


@embedded(f"WITH {oracle.full(PAIRS, DRAWS)} SELECT round(t, 4) AS threshold FROM thr")
def max_null_threshold(spark, sf_dir, size):
    return spark.createDataFrame([(float(fitted(spark, sf_dir, size).threshold),)], "threshold double").select(F.round("threshold", 4).alias("threshold"))


# Selection


@embedded(f"WITH {oracle.base(MANY_PAIRS)}, {oracle.unit_gram()} SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(c, 6) AS c FROM h", MANY_PAIRS)
def unit_gram(spark, sf_dir, size):
    found = tiles.unit_gram_table(geometry(spark, sf_dir, size).table, size.width)
    return found.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"), r6("c").alias("c"))


@embedded(f"""WITH {oracle.base(MANY_PAIRS)}, {oracle.unit_gram()}
SELECT CAST(h.b AS INT) AS feature, round(greatest(0, least(1, (d.c - pow(greatest(h.c / q.c, 0), 2) * q.c) / (d.c + 1e-12))), 6) AS residual
FROM h JOIN h d ON d.a = h.b AND d.b = h.b JOIN h q ON q.a = 0 AND q.b = 0 WHERE h.a = 0 AND h.b <> 0""", MANY_PAIRS)
def residual_one(spark, sf_dir, size):
    """What the first feature's profile leaves unexplained of each other one."""
    rest = list(range(1, size.width))
    found = residual.residuals(geometry(spark, sf_dir, size).gram, [0], rest)
    return spark.createDataFrame([(j, float(r)) for j, r in zip(rest, found, strict=True)], "feature int, residual double").withColumn("residual", r6("residual"))


@embedded(f"""WITH {oracle.full(PAIRS, DRAWS)}, {oracle.unit_gram()}, {oracle.greedy_two()}
SELECT 1 AS step, j AS feature_index, round(r, 6) AS residual_novelty, round(s, 4) AS selection_score FROM s1 UNION ALL SELECT 2, j, round(r, 6), round(s, 4) FROM s2""")
def select_two(spark, sf_dir, size):
    path = fitted(spark, sf_dir, size).path_frame(spark)
    return path.select("step", "feature_index", r6("residual_novelty").alias("residual_novelty"), F.round("selection_score", 4).alias("selection_score"))


@embedded(f"""WITH {oracle.full(PAIRS, DRAWS)}, {oracle.unit_gram()}, {oracle.greedy_two()},
path AS (SELECT 1 AS step, j, r, s FROM s1 UNION ALL SELECT 2, j, r, s FROM s2)
SELECT feature, step IS NOT NULL AS selected, CAST(row_number() OVER (ORDER BY coalesce(step, 99), eff DESC, e.j) AS INT) AS rank, round(zr, 4) AS support_z, round(cov, 6) AS sample_coverage,
  round(eff, 4) AS effective_support, round(p, 6) AS max_null_adjusted_p, round(r, 6) AS residual_novelty_at_selection, round(coalesce(s, 0), 4) AS selection_score
FROM e LEFT JOIN path ON path.j = e.j JOIN adj USING (feature)""", whole=True)
def feature_report(spark, sf_dir, size):
    """The flagship query: a fit from scaling to the report of all features."""
    report = fitted(spark, sf_dir, size).report(spark).drop("conservative_step_p")
    return rounded(report, "sample_coverage", "max_null_adjusted_p", "residual_novelty_at_selection").withColumns({c: F.round(c, 4) for c in ("support_z", "effective_support", "selection_score")})


@embedded()
def select_auto(spark, sf_dir, size):
    return fitted(spark, sf_dir, size, n_features="auto").path_frame(spark)


@embedded()
def substitution_groups(spark, sf_dir, size):
    """Structural groups over the dimensions and noisy copies of two of them."""
    noise = F.pmod(F.xxhash64("vec_id"), F.lit(1000)) / 1000 * 0.01
    df = vectors(spark, sf_dir, size).withColumns({"copy0": F.col("f0") + noise, "copy1": F.col("f1") - noise})
    model = selector(size, n_features=3).fit(df, "vec_id", [*size.features, "copy0", "copy1"])
    return groups.StructuralGroups(model).report(spark)


# Evidence and graphs


def _window_sql(w: int) -> str:
    return f"median(o.gap) FILTER (abs(o.pos - c.pos) <= {w}) AS m{w}, count(o.gap) FILTER (abs(o.pos - c.pos) <= {w}) AS c{w}"


@query(f"""WITH s AS MATERIALIZED (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS pos FROM orders), n AS (SELECT count(*) AS n FROM s),
g AS MATERIALIZED (SELECT a.pos, b.x - a.x AS gap FROM s a JOIN s b ON b.pos = a.pos + 1), fl AS (SELECT greatest(0.25 * median(gap), 1e-12) AS f FROM g WHERE gap > 0),
c AS MATERIALIZED (SELECT g.* FROM g, n WHERE pos + 1 BETWEEN ceil(0.1 * n) AND floor(0.9 * n)),
sh AS (SELECT c.pos, c.gap, unnest([-8,-7,-6,-5,-4,-3,-2,-1,1,2,3,4,5,6,7,8]) AS d FROM c), oo AS (SELECT sh.pos AS p, sh.gap AS own, g.pos, g.gap FROM sh JOIN g ON g.pos = sh.pos + sh.d WHERE g.gap > 1e-12),
e AS (SELECT c.pos, c.own AS gap, {", ".join(_window_sql(w) for w in (2, 4, 8)).replace("c.pos", "p")} FROM oo o, (SELECT 1) GROUP BY p, own),
q AS (SELECT (pos + 1) / CAST(n AS DOUBLE) AS q, least({", ".join(f"CASE WHEN c{w} >= 2 THEN gap / greatest(m{w}, f) END" for w in (2, 4, 8))}) AS r FROM e, n, fl)
SELECT round(max(4 * q * (1 - q) * ln(1 + greatest(0, r - 1))), 6) AS evidence FROM q""".replace("SELECT c.pos, c.own AS gap", "SELECT p AS pos, own AS gap"))
def balanced_gap(spark, sf_dir):
    return rounded(evidence.balanced_gap(table(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey"), "evidence")


# Columns are standardised by mean and population deviation first, as all graphs of rows are.
KNN = """xl AS MATERIALIZED (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS e, unnest(range(0, len(embedding))) AS k FROM embeddings),
ml AS MATERIALIZED (SELECT k, avg(e) AS m, CASE WHEN stddev_pop(e) > 1e-12 THEN stddev_pop(e) ELSE 1 END AS s FROM xl GROUP BY k),
f AS MATERIALIZED (SELECT vec_id, k, (e - m) / s AS x FROM xl JOIN ml USING (k)),
x AS MATERIALIZED (SELECT vec_id, list(x ORDER BY k) AS v FROM f GROUP BY vec_id),
d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v, b.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM x a JOIN x b ON a.vec_id <> b.vec_id),
e AS MATERIALIZED (SELECT a, b, d2 FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) <= {k})"""
HEAT = """t AS (SELECT coalesce(median(d2), 1) AS t FROM e WHERE d2 > 0),
w AS MATERIALIZED (SELECT a, b, max(exp(-d2 / greatest(t, 1e-12))) AS w FROM (SELECT a, b, d2 FROM e UNION ALL SELECT b, a, d2 FROM e), t GROUP BY a, b)"""


def standardised(spark, sf_dir, size) -> DataFrame:
    df = vectors(spark, sf_dir, size)
    return scaling.mean_sd(df, size.features).apply(df)


@embedded(f"WITH {KNN.format(k=5)} SELECT a, b, round(d2, 6) AS d2 FROM e")
def knn_edges(spark, sf_dir, size):
    return rounded(neighbours.nearest(standardised(spark, sf_dir, size), "vec_id", size.features, 5), "d2")


@embedded(f"WITH {KNN.format(k=5)} SELECT a, b, round(d2, 6) AS d2 FROM e")
def knn_in_cells(spark, sf_dir, size):
    return rounded(neighbours.nearest_in_cells(standardised(spark, sf_dir, size), "vec_id", size.features, 5)[0], "d2")


@embedded(f"WITH {KNN.format(k=7)}, {HEAT} SELECT a, b, round(w, 6) AS w FROM w")
def heat_graph(spark, sf_dir, size):
    return rounded(neighbours.heat_graph(neighbours.nearest(standardised(spark, sf_dir, size), "vec_id", size.features, 7)), "w")


@embedded(f"""WITH {KNN.format(k=5)}, {HEAT}, dg AS (SELECT a, sum(w) AS d FROM w GROUP BY a),
mu AS (SELECT k, sum(d * x) / (sum(d) + 1e-12) AS m FROM f JOIN dg ON dg.a = vec_id GROUP BY k), ms AS (SELECT k, sum(d * (x - m) * (x - m)) AS den FROM f JOIN dg ON dg.a = vec_id JOIN mu USING (k) GROUP BY k),
cut AS (SELECT u.k, 0.5 * sum(w * (u.x - v.x) * (u.x - v.x)) AS num FROM w JOIN f u ON u.vec_id = a JOIN f v ON v.vec_id = b AND v.k = u.k GROUP BY u.k)
SELECT 'f' || k AS feature, round(num / (den + 1e-12), 6) AS score FROM cut JOIN ms USING (k)""")
def laplacian_score(spark, sf_dir, size):
    df = standardised(spark, sf_dir, size)
    graph = neighbours.heat_graph(neighbours.nearest(df, "vec_id", size.features, 5))
    return rounded(neighbours.laplacian_scores(graph, df, "vec_id", size.features), "score")


@embedded(f"""WITH {KNN.format(k=10)}, d4 AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.v[1:32], b.v[1:32]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM x a JOIN x b ON a.vec_id <> b.vec_id),
e4 AS (SELECT a, b FROM d4 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d2, b) <= 10)
SELECT round(count(e4.a) / CAST(count(*) AS DOUBLE), 6) AS preservation FROM e LEFT JOIN e4 USING (a, b)""")
def knn_preservation(spark, sf_dir, size):
    """Of the first half of the components."""
    return rounded(neighbours.preservation(vectors(spark, sf_dir, size), "vec_id", size.features, size.features[: size.width // 2]), "preservation")


# Statistics: data sets are nations, methods market segments, the metric account balances

SCORES = """s AS MATERIALIZED (SELECT c_nationkey AS dataset, c_mktsegment AS method, avg(c_acctbal) AS score, stddev_samp(c_acctbal) AS spread, count(*) AS n FROM customer GROUP BY ALL),
c AS MATERIALIZED (SELECT * FROM s WHERE dataset IN (SELECT dataset FROM s GROUP BY dataset HAVING count(*) = (SELECT count(DISTINCT method) FROM s))),
r AS MATERIALIZED (SELECT *, rank() OVER (PARTITION BY dataset ORDER BY score DESC) + (count(*) OVER (PARTITION BY dataset, score) - 1) / 2.0 AS rank FROM c)"""


def customer_scores(spark, sf_dir):
    return ranks.dataset_scores(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal")


@query(f"WITH {SCORES} SELECT dataset, method, round(score, 6) AS score, round(spread, 6) AS spread, n FROM s")
def agg_dataset_metric(spark, sf_dir):
    return rounded(customer_scores(spark, sf_dir), "score", "spread")


@query(f"WITH {SCORES} SELECT dataset, method, CAST(rank AS DOUBLE) AS rank FROM r")
def method_ranks(spark, sf_dir):
    return ranks.ranked(ranks.complete(customer_scores(spark, sf_dir))).select("dataset", "method", "rank")


@query(f"""WITH {SCORES}, m AS (SELECT method, sum(rank) AS r, count(*) AS n FROM r GROUP BY method), k AS (SELECT count(*) AS k, max(n) AS n, sum(r * r) AS rr FROM m),
t AS (SELECT coalesce(sum(t * (t * t - 1)), 0) AS t FROM (SELECT count(*) AS t FROM r GROUP BY dataset, rank)),
f AS (SELECT n, k, (12.0 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - t / CAST(n * k * (k * k - 1) AS DOUBLE)) AS x FROM k, t)
SELECT CAST(n AS INT) AS n, CAST(k AS INT) AS k, round(x, 6) AS chi2, round(exp(-x / 2) * (1 + x / 2), 6) AS p FROM f""")
def friedman(spark, sf_dir):
    f = ranks.friedman(ranks.ranked(ranks.complete(customer_scores(spark, sf_dir))))
    return rounded(spark.createDataFrame([(f["n"], f["k"], f["chi2"], f["p"])], "n int, k int, chi2 double, p double"), "chi2", "p")


@query(f"""WITH {SCORES}, d AS (SELECT a.method, b.score - a.score AS d FROM c a JOIN c b ON b.dataset = a.dataset AND b.method = 'BUILDING' WHERE a.method <> 'BUILDING'),
l AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
p AS (SELECT method, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus FROM l GROUP BY method)
SELECT method, n, CAST(least(plus, minus) AS DOUBLE) AS statistic, round((plus - minus) / (plus + minus), 6) AS rank_biserial FROM p""")
def wilcoxon(spark, sf_dir):
    return rounded(ranks.signed_ranks(ranks.complete(customer_scores(spark, sf_dir)), "BUILDING").select("method", "n", "statistic", "rank_biserial"), "rank_biserial")


@query("""WITH p AS (SELECT c_mktsegment AS test, (count(*) FILTER (c_acctbal < 0) + 1) / CAST(count(*) * 20 AS DOUBLE) AS p FROM customer GROUP BY 1),
s AS (SELECT test, p, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS s FROM p)
SELECT test, round(p, 9) AS p, round(max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 9) AS p_holm FROM s""")
def holm(spark, sf_dir):
    p = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("test")).agg(((F.count_if(F.col("c_acctbal") < 0) + 1) / (F.count("*") * 20)).alias("p"))
    return ranks.holm_frame(p).select("test", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm"))


@query(f"""WITH RECURSIVE {SCORES}, d AS (SELECT a.method, b.score - a.score AS d FROM c a JOIN c b ON b.dataset = a.dataset AND b.method = 'BUILDING' WHERE a.method <> 'BUILDING'),
l AS (SELECT method, d, rank() OVER (PARTITION BY method ORDER BY abs(d)) + (count(*) OVER (PARTITION BY method, abs(d)) - 1) / 2.0 AS r FROM d WHERE d <> 0),
p AS (SELECT method, count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS plus, coalesce(sum(r) FILTER (d < 0), 0) AS minus FROM l GROUP BY method),
dp(k, s, ways) AS (SELECT 0, 0, CAST(1 AS DOUBLE) UNION ALL SELECT k + 1, s + t.x * (k + 1), sum(ways) FROM dp, (VALUES (0), (1)) t(x) WHERE k < (SELECT max(n) FROM p) GROUP BY k, s + t.x * (k + 1)),
q AS (SELECT method, n, CAST(least(plus, minus) AS DOUBLE) AS statistic, (plus - minus) / (plus + minus) AS rb, least(1, 2 * (SELECT sum(ways) FROM dp WHERE dp.k = p.n AND dp.s <= least(plus, minus)) / pow(2, n)) AS p FROM p),
h AS (SELECT *, least(1, (count(*) OVER () - row_number() OVER (ORDER BY p) + 1) * p) AS s FROM q)
SELECT method, n, statistic, round(rb, 6) AS rank_biserial, round(p, 6) AS p, round(max(s) OVER (ORDER BY p ROWS UNBOUNDED PRECEDING), 6) AS p_holm FROM h""")
def compare_methods(spark, sf_dir):
    """The SQL counts sign patterns exactly: it holds while no difference is zero or tied."""
    rows = ranks.compare_methods(table(spark, sf_dir, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", "BUILDING")["posthoc"]
    names = ("method", "n", "statistic", "rank_biserial", "p", "p_holm")
    return rounded(spark.createDataFrame([tuple(r[c] for c in names) for r in rows], "method string, n long, statistic double, rank_biserial double, p double, p_holm double"), "rank_biserial", "p", "p_holm")


# Preparation and governance


@query("""SELECT doc_id, toxic, CAST((row_number() OVER (PARTITION BY toxic, part ORDER BY md5('fold:0:' || doc_id), doc_id) - 1 + part) % 5 AS INT) AS fold
FROM (SELECT doc_id, toxic, CAST('0x' || substr(md5('slice:0:' || doc_id), 1, 8) AS BIGINT) % 64 AS part FROM labels)""")
def stratified_folds(spark, sf_dir):
    return prepare.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 5)


@query("SELECT doc_id, lang FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY md5('cap:0:' || doc_id), doc_id) <= 100")
def uniform_cap(spark, sf_dir):
    return prepare.uniform_cap(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang", 100)


@query("SELECT event_id, CAST(dense_rank() OVER (ORDER BY event_type) - 1 AS INT) AS code FROM events")
def factorize(spark, sf_dir):
    return prepare.factorize(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "code").select("event_id", F.col("code").cast("int").alias("code"))


@query("SELECT user_id, event_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def dedup_last(spark, sf_dir):
    return prepare.last_of_each(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", "ts"), "user_id", "ts", "event_id").drop("ts")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value, event_type FROM events)
SELECT event_id, round(coalesce(value, (SELECT median(value) FROM e)), 6) AS value, event_type FROM e""")
def impute_median(spark, sf_dir):
    df = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"), "event_type")
    return rounded(prepare.impute_median(df, ["value"]), "value")


KINDS = ("author_code:x", "scikit-feature:mcfs", "canonical:spec", "own", None)


@query("""WITH s AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN 'author_code:x' WHEN 1 THEN 'scikit-feature:mcfs' WHEN 2 THEN 'canonical:spec' WHEN 3 THEN 'own' END AS src FROM customer)
SELECT c_custkey, CASE WHEN lower(src) LIKE '%author%' THEN 'author_code' WHEN lower(src) LIKE '%scikit-feature%' OR lower(src) LIKE 'canonical:%' THEN 'canonical' ELSE 'native_or_local' END AS kind FROM s""")
def source_kind(spark, sf_dir):
    source = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("c_custkey") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", governance.implementation_kind(source).alias("kind"))


@query("""SELECT status, count(*) AS n FROM (SELECT CASE WHEN c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 THEN 'FAIL' WHEN c_custkey % 4 = 0 THEN 'REVIEW' ELSE 'PASS' END AS status FROM customer) GROUP BY status""")
def integrity_audit(spark, sf_dir):
    """Records made from customers: flags by divisibility."""
    key = F.col("c_custkey")
    flags = {c: F.lit(False) for c in governance.USED_LABELS} | {governance.USED_LABELS[0]: key % 3 == 0, governance.USED_LABELS[1]: key % 5 == 0}
    rows = table(spark, sf_dir, "customer").select(key.cast("string").alias("dataset"), F.lit("file:x").alias("source_uri"), *(v.alias(k) for k, v in flags.items()), (key % 4 != 0).alias("provenance_complete"), (key % 7 != 0).alias("raw_feature_space_preserved"))
    return governance.audit(rows).groupBy("status").agg(F.count("*").alias("n"))
