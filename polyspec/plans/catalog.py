"""Registered queries and their SQL. Model tables take whole inputs; numbers are rounded on both sides."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from polyspec import estimators
from polyspec.operators import inference, moments, ols, panels, patterns, prepare, robust, sequences, tables
from polyspec.plans import space, sqlgen
from polyspec.plans.scratch import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Z = ["z1", "z2", "z3"]
SEED, DRAWS, FOLDS = 7, 10, 5


def register(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*[(F.round(c, places) + 0.0).alias(c) if t == "double" and c not in keep else F.col(c) for c, t in df.dtypes])


def r(e: str, name: str, places: int = 6) -> str:
    return f"round({e}, {places}) + 0.0 AS {name}"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


# Model tables: order lines with their parts, and customers.
def lines(spark: SparkSession, sf: str) -> DataFrame:
    part = read(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("z3"))
    rows = read(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber", (F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"), F.col("l_discount").alias("z1"), F.col("l_tax").alias("z2"))
    return rows.join(part, rows.l_partkey == part.p_partkey).select("y", "x", *Z, F.col("l_suppkey").alias("g"), "l_returnflag")


LINES = "lines AS (SELECT l_extendedprice / 1000 AS y, l_quantity AS x, l_discount AS z1, l_tax AS z2, p_size::DOUBLE AS z3, l_suppkey AS g, l_returnflag FROM lineitem JOIN part ON l_partkey = p_partkey)"


def people(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col("c_custkey").cast("double")
    return read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("y"), F.col("c_nationkey").cast("double").alias("x"), F.pmod(c, F.lit(7.0)).alias("z1"), F.pmod(c, F.lit(11.0)).alias("z2"), F.col("c_nationkey").alias("g"))


PEOPLE = "people AS (SELECT c_custkey AS k, c_acctbal / 1000 AS y, c_nationkey::DOUBLE AS x, (c_custkey % 7)::DOUBLE AS z1, (c_custkey % 11)::DOUBLE AS z2, c_nationkey AS g FROM customer)"


def specs(controls: list[str]) -> list[tuple[int, tuple[str, ...]]]:
    return list(enumerate(space.all_subsets(controls)))


def line_fit(spark, sf, **kw) -> estimators.Result:
    rows = materialize(lines(spark, sf).select("y", "x", *Z, "g"), "lines")  # a fit reads its rows several times: one join
    return estimators.OLSRobust(["y"], ["x"], rows).fit(controls=Z, **({"draws": 0, "kfold": 0, "seed": SEED, "shap": False} | kw)).get_results()


def people_fit(spark, sf, **kw) -> estimators.Result:
    made = estimators.OLSRobust(["y"], ["x"], people(spark, sf))
    return made.fit(controls=["z1", "z2"], **({"draws": DRAWS, "kfold": 0, "seed": SEED, "rng": "hash", "order_by": ["k"], "shap": False} | kw)).get_results()


def flat(full: DataFrame) -> DataFrame:
    return full.withColumn("spec", F.array_join("controls", ","))


# SQL blocks. Gram columns: y, x, controls, const (a 1 again); the estimators add const to x.
def full_sql(table: str, cte: str, controls: list[str], extra: str = "") -> str:
    """CTEs ending in curve(spec_id, spec, beta, se, t, df, r2, ll, ll_null, aic, bic, hqic, n, k, bic, b_<control>)."""
    cols = ["y", "x", *controls, "1.0"]
    at = {c: i for i, c in enumerate(cols)}
    ctes, selects = [cte, f"g0 AS ({sqlgen.grams(table, cols)})"], []
    for i, s in specs(controls):
        ctes += sqlgen.fit("g0", f"f{i}", len(cols), [1, at["1.0"], *[at[c] for c in s]], 0)
        ll, ll0 = sqlgen.log_likelihood("rss / n"), sqlgen.log_likelihood("yy / n - pow(sy / n, 2)")
        b = ", ".join(f"{f'b{2 + s.index(c)}' if c in s else '0.0'} AS b_{c}" for c in controls)
        selects.append(f"SELECT {i} AS spec_id, '{','.join(s)}' AS spec, b0 AS beta, sqrt(v0 * rss / (n - k)) AS se, {sqlgen.t_value(0)} AS t, n - k AS df, {sqlgen.adjusted_r2()} AS r2, {ll} AS ll, {ll0} AS ll_null, n, k, {b or '0 AS none'} FROM f{i}")
    ctes.append("base AS (" + " UNION ALL ".join(selects) + ")")
    ctes.append("curve AS (SELECT *, ll - ll_null AS ll_gain, 2 * k - 2 * ll AS aic, k * ln(n) - 2 * ll AS bic, 2 * k * ln(ln(n)) - 2 * ll AS hqic FROM base)")
    return "WITH " + ",\n".join(ctes)


def boot_sql() -> str:
    """full_sql of people and CTEs ending in boot(spec_id, draw, beta, t, df, r2, beta_null, t_null)."""
    controls, cols = ["z1", "z2"], ["y", "x", "z1", "z2"]
    at = {c: i for i, c in enumerate(cols)}
    out = [full_sql("people", PEOPLE, controls)]
    out.append("ordered AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS m FROM people)")
    out.append(f"picks AS (SELECT d.i AS draw, {sqlgen.hash_index(SEED, 'm', 'd.i', 'p.idx')} AS idx FROM range(0, {DRAWS}) AS d(i), ordered AS p)")
    out.append("drawn AS (SELECT draw, o.* FROM picks JOIN ordered AS o USING (idx))")
    out.append(f"gd AS ({sqlgen.grams('drawn', cols, 'draw')})")
    selects = []
    for i, s in specs(controls):
        use = [1, *[at[c] for c in s], len(cols)]
        out += sqlgen.fit("gd", f"d{i}", len(cols), use, 0, "draw")
        out += sqlgen.fit("gd", f"e{i}", len(cols), use, 0, "draw", (1, f"(SELECT beta FROM base WHERE spec_id = {i})"))
        t = lambda f: f"({f}.b0 / sqrt({f}.v0 * {f}.rss / ({f}.n - {f}.k)))"
        selects.append(f"SELECT {i} AS spec_id, d{i}.draw AS draw, d{i}.b0 AS beta, {t(f'd{i}')} AS t, d{i}.n - d{i}.k AS df, {sqlgen.adjusted_r2(f'd{i}')} AS r2, e{i}.b0 AS beta_null, {t(f'e{i}')} AS t_null FROM d{i} JOIN e{i} USING (draw)")
    out.append("boot0 AS (" + " UNION ALL ".join(selects) + ")")
    out.append(f"boot AS (SELECT *, {sqlgen.two_sided_t('t', 'df')} AS p, {sqlgen.two_sided_t('t_null', 'df')} AS p_null FROM boot0)")
    out.append(f"full_ AS (SELECT *, {sqlgen.two_sided_t('t', 'df')} AS pval FROM curve)")
    return ",\n".join(out)


FULL = full_sql("lines", LINES, Z)
BOOT = boot_sql()
LL = ["ll", "ll_null", "ll_gain", "aic", "bic", "hqic"]


@register("ols_full_specs", f"{FULL} SELECT spec, {r('beta', 'beta')}, {r('se', 'se')}, {r('r2', 'r2')}, n::BIGINT AS nobs, {', '.join(r(c, c, 3) for c in LL)} FROM curve")
def ols_full_specs(spark, sf):
    f = flat(line_fit(spark, sf).full).withColumn("ll", F.col("ll_raw"))
    return f.select("spec", *[(F.round(c, 6) + 0.0).alias(c) for c in ("beta",)], (F.round(F.col("se")[0], 6) + 0.0).alias("se"), (F.round("r2", 6) + 0.0).alias("r2"), "nobs", *[(F.round(c, 3) + 0.0).alias(c) for c in LL])


@register("ols_small_n_pvalues", f"{full_sql('people', PEOPLE, ['z1', 'z2'])} SELECT spec, {r('t', 't')}, {r(sqlgen.two_sided_t('t', 'df'), 'p', 5)} FROM curve")
def ols_small_n_pvalues(spark, sf):
    f = flat(people_fit(spark, sf, draws=0).full)
    return f.select("spec", (F.round(F.col("beta") / F.col("se")[0], 6) + 0.0).alias("t"), (F.round("pval", 5) + 0.0).alias("p"))


@register("ic_table", f"{FULL} SELECT spec, {r('aic', 'aic', 3)}, {r('bic', 'bic', 3)}, {r('hqic', 'hqic', 3)} FROM curve")
def ic_table(spark, sf):
    return rounded(flat(line_fit(spark, sf).full).select("spec", "aic", "bic", "hqic"), 3)


SIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey"]
_BITS = " + ".join(f"(z_mask >> {i} & 1)" for i in range(6))
_NAME = "concat_ws(',', " + ", ".join(f"CASE WHEN z_mask >> {i} & 1 = 1 THEN '{c}' END" for i, c in enumerate(SIX)) + ")"
_MODULI = (2, 3, 5, 7, 11, 13)
_HOLED = ", ".join(f"CASE WHEN (l_orderkey + l_partkey) % {m} <> 0 THEN {c} END AS {c}" for c, m in zip(SIX, _MODULI, strict=True))
_ROWS = "(SELECT count(*) FROM holed WHERE " + " AND ".join(f"(z_mask >> {i} & 1 = 0 OR {c} IS NOT NULL)" for i, c in enumerate(SIX)) + ")"


def holed_columns() -> list[Column]:
    key = F.col("l_orderkey") + F.col("l_partkey")
    return [F.when(F.pmod(key, F.lit(m)) != 0, F.col(c)).alias(c) for c, m in zip(SIX, _MODULI, strict=True)]


def holed_items(spark, sf):
    return read(spark, sf, "lineitem").select(*holed_columns())


@register("spec_space", f"WITH holed AS (SELECT {_HOLED} FROM lineitem) SELECT z_mask, {_NAME} AS spec, CAST({_BITS} AS INTEGER) AS n_controls, z_mask = 0 AS is_null, z_mask = 63 AS is_full, row_number() OVER (ORDER BY {_BITS}, list_filter([{', '.join(f'CASE WHEN z_mask >> {i} & 1 = 1 THEN {i} END' for i in range(6))}], lambda x: x IS NOT NULL)) - 1 AS spec_id, {_ROWS} AS nobs FROM (SELECT range AS z_mask FROM range(0, 64))")
def spec_space(spark, sf):
    """Every specification of six columns with nulls, and the rows that it has complete."""
    rows = holed_items(spark, sf).withColumn("p", patterns.null_mask(SIX))
    n = spark.createDataFrame(list(patterns.counts(rows, list(range(64)), 6, "p").items()), "z_mask long, nobs long")
    return space.specs_frame(spark, SIX).join(n, "z_mask").select("spec_id", "z_mask", F.array_join("controls", ",").alias("spec"), "n_controls", "is_null", "is_full", "nobs")


@register("spec_bitmask", f"{FULL} SELECT CAST({' + '.join(f'CASE WHEN list_contains(string_split(spec, chr(44)), {chr(39)}{c}{chr(39)}) THEN {1 << i} ELSE 0 END' for i, c in enumerate(Z))} AS BIGINT) AS z_mask, spec, n::BIGINT AS nobs FROM curve")
def spec_bitmask(spark, sf):
    f = line_fit(spark, sf).full
    return f.select(space.controls_mask(F.col("controls"), Z).alias("z_mask"), F.array_join("controls", ",").alias("spec"), "nobs")


@register("sample_specs", f"{FULL} SELECT count(*) AS n, count(DISTINCT spec) AS different, {r('sum(beta)', 'total', 5)} FROM curve")
def sample_specs(spark, sf):
    """A sample as large as the space holds each specification once."""
    f = flat(line_fit(spark, sf, z_specs_sample_size=8).full)
    return rounded(f.agg(F.count("*").alias("n"), F.count_distinct("spec").alias("different"), F.sum("beta").alias("total")), 5)


@register("rescale", f"WITH {LINES} SELECT {r('sum(a * a)', 'ss', 4)}, {r('sum(a * b)', 'ab', 4)}, {r('min(a)', 'lo')}, {r('max(b)', 'hi')} FROM (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS a, (z3 - avg(z3) OVER ()) / stddev_pop(z3) OVER () AS b FROM lines)")
def rescale(spark, sf):
    s = prepare.rescale(lines(spark, sf), ["x", "z3"])
    return rounded(rounded(s.agg(F.sum(F.col("x") ** 2).alias("ss"), F.sum(F.col("x") * F.col("z3")).alias("ab"), F.min("x").alias("lo"), F.max("z3").alias("hi")), 6, ("ss", "ab")), 4, ("lo", "hi"))


@register("single_constant", f"WITH {LINES} SELECT count(*) AS n, 5.0 * count(*) AS total, 'x' AS x, 'z1,const' AS z FROM lines")
def single_constant(spark, sf):
    d = lines(spark, sf).select("y", "x", "z1", F.lit(5.0).alias("five"), F.lit(1.0).alias("one"))
    d, _, x, z = prepare.single_constant(d, ["y"], ["x", "one"], ["five", "z1"])
    return d.agg(F.count("*").alias("n"), F.sum("const").alias("total")).withColumns({"x": F.lit(",".join(x)), "z": F.lit(",".join(z))})


@register("group_invariant", f"WITH {PEOPLE}, p AS (SELECT g, count(DISTINCT x) AS a, count(DISTINCT z1) AS b FROM people GROUP BY g) SELECT 'x' AS col, max(a) <= 1 AS same FROM p UNION ALL SELECT 'z1', max(b) <= 1 FROM p")
def group_invariant(spark, sf):
    found = prepare.group_invariant_columns(people(spark, sf), ["x", "z1"], "g")
    return spark.createDataFrame([(c, c in found) for c in ("x", "z1")], "col string, same boolean")


@register("group_demean", f"WITH {LINES} SELECT g, {r('max(d)', 'hi')}, {r('sum(d * d)', 'ss', 3)} FROM (SELECT g, y - avg(y) OVER (PARTITION BY g) AS d FROM lines) GROUP BY g")
def group_demean(spark, sf):
    d = prepare.group_demean(lines(spark, sf), ["y"], "g").groupBy("g").agg(F.max("y").alias("hi"), F.sum(F.col("y") ** 2).alias("ss"))
    return d.select("g", (F.round("hi", 6) + 0.0).alias("hi"), (F.round("ss", 3) + 0.0).alias("ss"))


def fe_sql() -> str:
    cols = ["y", "x", *Z]
    w = "OVER (PARTITION BY g)"
    ctes = [LINES, "dm AS (SELECT " + ", ".join(f"{c} - avg({c}) {w} AS {c}" for c in cols) + " FROM lines)", f"g0 AS ({sqlgen.grams('dm', cols)})"]
    out = []
    for i, s in specs(Z):
        ctes += sqlgen.fit("g0", f"f{i}", len(cols), [1, *[cols.index(c) for c in s]], 0)
        out.append(f"SELECT '{','.join(s)}' AS spec, {r('b0', 'beta')}, {r('sqrt(v0 * rss / (n - k))', 'se')} FROM f{i}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


@register("ols_fe", fe_sql())
def ols_fe(spark, sf):
    f = flat(line_fit(spark, sf, group="g").full)
    return f.select("spec", (F.round("beta", 6) + 0.0).alias("beta"), (F.round(F.col("se")[0], 6) + 0.0).alias("se"))


def sampled_sql() -> str:
    cols, names = ["y", "x", "z1", "z2", "5.0"], ["z1", "z2", "const"]
    ctes, out = [LINES, f"g0 AS ({sqlgen.grams('lines', cols)})"], []
    for i, mask in enumerate(space.sample_z_masks(3, 4, SEED)):
        use = [k for k in range(3) if mask >> k & 1]
        ctes += sqlgen.fit("g0", f"f{i}", len(cols), [1, *[2 + k for k in use]], 0)
        out.append(f"SELECT '{','.join(names[k] for k in use)}' AS spec, {r('b0', 'beta')}, {r('sqrt(v0 * rss / (n - k))', 'se')} FROM f{i}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


@register("sampled_specs_with_constant", sampled_sql())
def sampled_specs_with_constant(spark, sf):
    d = lines(spark, sf).withColumn("five", F.lit(5.0))
    res = estimators.OLSRobust(["y"], ["x"], d).fit(controls=["five", "z1", "z2"], draws=0, kfold=0, seed=SEED, z_specs_sample_size=4, shap=False).get_results()
    return flat(res.full).select("spec", (F.round("beta", 6) + 0.0).alias("beta"), (F.round(F.col("se")[0], 6) + 0.0).alias("se"))


@register("collinearity", f"WITH {LINES} SELECT a, b FROM (SELECT 'x2' AS a, 'x' AS b, corr(2 * x + 1, x) AS c FROM lines UNION ALL SELECT 'z1', 'x', corr(z1, x) FROM lines) WHERE abs(abs(c) - 1) < 1e-9")
def collinearity(spark, sf):
    d = lines(spark, sf).withColumn("x2", F.col("x") * 2 + 1)
    cols = ["x", "z1", "x2"]
    g = moments.unpack(moments.np.array(moments.gram(d, cols).first().gram, float), 3)
    return spark.createDataFrame(ols.collinear_pairs(g, [0, 1, 2, 3], [*cols, "1"]), "a string, b string")


@register("listwise_deletion", f"WITH {LINES} SELECT '' AS spec, count(*) AS nobs FROM lines UNION ALL SELECT 'z1', count(*) FROM lines UNION ALL SELECT 'z2', count(nullif(z2, 0)) FROM lines UNION ALL SELECT 'z1,z2', count(nullif(z2, 0)) FROM lines")
def listwise_deletion(spark, sf):
    d = lines(spark, sf).withColumn("z2", F.nullif("z2", F.lit(0.0)))
    full = estimators.OLSRobust(["y"], ["x"], d).fit(controls=["z1", "z2"], draws=0, kfold=0, shap=False).get_results().full
    return flat(full).select("spec", "nobs")


def kfold_sql(metric: str, order: str = "ORDER BY k") -> str:
    cols, controls = ["y", "x", "z1", "z2", "1.0"], ["z1", "z2"]
    p = len(cols)
    q = f"(m // {FOLDS})"
    fold = f"CASE WHEN idx < (m % {FOLDS}) * ({q} + 1) THEN idx // ({q} + 1) ELSE (m % {FOLDS}) + (idx - (m % {FOLDS}) * ({q} + 1)) // {q} END"
    names = [sqlgen.entry(i, j) for i in range(p + 1) for j in range(i, p + 1)]
    ctes = [PEOPLE, f"o AS (SELECT *, row_number() OVER ({order}) - 1 AS idx, count(*) OVER () AS m FROM people)", f"w AS (SELECT *, {fold} AS fold FROM o)", f"gf AS ({sqlgen.grams('w', cols, 'fold')})"]
    ctes.append("gt AS (SELECT fold, " + ", ".join(f"sum({c}) OVER () - {c} AS {c}" for c in names) + " FROM gf)")
    out = []
    for i, s in specs(controls):
        use = [1, 4, *[cols.index(c) for c in s]]
        ctes += sqlgen.fit("gt", f"f{i}", p, use, 0, "fold")
        g = lambda a, b: f"gf.{sqlgen.entry(a, b)}"
        sse = f"{g(0, 0)} - 2 * (" + " + ".join(f"b{a} * {g(c, 0)}" for a, c in enumerate(use)) + ") + (" + " + ".join(f"b{a} * b{b} * {g(c, d)}" for a, c in enumerate(use) for b, d in enumerate(use)) + ")"
        mean = f"(f{i}.sy / f{i}.n)"
        value = f"sqrt(({sse}) / {g(5, 5)})" if metric == "rmse" else f"1 - ({sse}) / ({g(0, 0)} - 2 * {mean} * {g(0, 5)} + {g(5, 5)} * {mean} * {mean})"
        out.append(f"SELECT '{','.join(s)}' AS spec, {r(f'avg({value})', 'metric')} FROM f{i} JOIN gf USING (fold)")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


def kfold(metric: str, spark, sf, **kw):
    res = people_fit(spark, sf, draws=0, kfold=FOLDS, oos_metric=metric, **kw)
    avg = res.oos.groupBy("spec_id").agg(F.avg("metric").alias("metric"))
    return rounded(flat(res.full).join(avg, "spec_id").select("spec", "metric"))


for _m in ("rmse", "pseudo-r2"):
    register(f"kfold_{_m.replace('-', '_')}", kfold_sql(_m))(partial(kfold, _m))


register("kfold_default_order", kfold_sql("pseudo-r2", ""))(partial(kfold, "pseudo-r2", order_by=None))


_GREEDY = f"""WITH RECURSIVE {LINES}, c AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g) AS i FROM lines GROUP BY g),
w AS (SELECT 0::BIGINT AS i, [{', '.join(['0::BIGINT'] * FOLDS)}] AS loads, 0::BIGINT AS place
      UNION ALL SELECT c.i, list_transform(w.loads, lambda v, j: v + CASE WHEN j = list_position(w.loads, list_min(w.loads)) THEN c.n ELSE 0 END), list_position(w.loads, list_min(w.loads))::BIGINT FROM w JOIN c ON c.i = w.i + 1)
SELECT g, CAST(place - 1 AS INTEGER) AS fold FROM w JOIN c USING (i)"""


@register("group_kfold", _GREEDY)
def group_kfold(spark, sf):
    return prepare.group_folds(lines(spark, sf), "g", FOLDS).withColumnRenamed("__group", "g")


# Four controls with nulls: every specification has complete rows of its own.
HOLES = {"n1": (7, 0), "n2": (11, 3), "n3": (13, 5), "n4": (5, 1)}
HOLED = "holed AS (SELECT c_custkey AS k, c_acctbal / 1000 AS y, c_nationkey::DOUBLE AS x, " + ", ".join(f"nullif((c_custkey % {m})::DOUBLE, {v}) AS {c}" for c, (m, v) in HOLES.items()) + " FROM customer)"


def holed_fit(spark, sf, controls, **kw):
    key = F.col("c_custkey").cast("double")
    d = read(spark, sf, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_acctbal") / 1000).alias("y"), F.col("c_nationkey").cast("double").alias("x"), *[F.nullif(F.pmod(key, F.lit(float(m))), F.lit(float(v))).alias(c) for c, (m, v) in HOLES.items()])
    return estimators.OLSRobust(["y"], ["x"], d).fit(controls=controls, **({"draws": 0, "kfold": 0, "seed": SEED, "rng": "hash", "order_by": ["k"], "shap": False} | kw)).get_results()


def null_patterns_sql() -> str:
    ctes, out = [HOLED], []
    q = f"(m // {FOLDS})"
    fold = f"CASE WHEN idx < (m % {FOLDS}) * ({q} + 1) THEN idx // ({q} + 1) ELSE (m % {FOLDS}) + (idx - (m % {FOLDS}) * ({q} + 1)) // {q} END"
    for i, s in specs(list(HOLES)):
        cols = ["y", "x", "1.0", *s]
        p, use = len(cols), list(range(1, len(cols)))
        complete = " AND ".join(f"{c} IS NOT NULL" for c in s) or "true"
        ctes.append(f"o{i} AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS m FROM holed WHERE {complete})")
        ctes.append(f"w{i} AS (SELECT *, {fold} AS fold FROM o{i})")
        ctes += [f"g{i} AS ({sqlgen.grams(f'w{i}', cols)})", f"gf{i} AS ({sqlgen.grams(f'w{i}', cols, 'fold')})"]
        names = [sqlgen.entry(a, b) for a in range(p + 1) for b in range(a, p + 1)]
        ctes.append(f"gt{i} AS (SELECT fold, " + ", ".join(f"sum({c}) OVER () - {c} AS {c}" for c in names) + f" FROM gf{i})")
        ctes += sqlgen.fit(f"g{i}", f"f{i}", p, use, 0) + sqlgen.fit(f"gt{i}", f"t{i}", p, use, 0, "fold")
        e = lambda a, b: f"gf{i}.{sqlgen.entry(a, b)}"  # noqa: B023, E731
        sse = f"{e(0, 0)} - 2 * (" + " + ".join(f"b{a} * {e(c, 0)}" for a, c in enumerate(use)) + ") + (" + " + ".join(f"b{a} * b{b} * {e(c, d)}" for a, c in enumerate(use) for b, d in enumerate(use)) + ")"
        score = f"(SELECT avg(sqrt(({sse}) / {e(p, p)})) FROM t{i} JOIN gf{i} USING (fold))"
        out.append(f"SELECT '{','.join(s)}' AS spec, n::BIGINT AS nobs, {r('b0', 'beta')}, {r('sqrt(v0 * rss / (n - k))', 'se')}, {r(score, 'metric')} FROM f{i}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


@register("null_patterns", null_patterns_sql())
def null_patterns(spark, sf):
    res = holed_fit(spark, sf, list(HOLES), kfold=FOLDS, oos_metric="rmse")
    avg = res.oos.groupBy("spec_id").agg(F.avg("metric").alias("metric"))
    return rounded(flat(res.full).join(avg, "spec_id").select("spec", "nobs", "beta", F.get("se", 0).alias("se"), "metric"))


def drawn_sql(table: str, cte: str, controls: list[str], salted: bool = False, holes: bool = False) -> str:
    """Draws of each specification out of its own complete rows; salted: with picks of its own."""
    ctes, out = [cte, f"total AS (SELECT count(*) AS m FROM {table})"], []
    for i, s in specs(controls):
        cols = ["y", "x", *s]
        complete = " AND ".join(f"{c} IS NOT NULL" for c in s) if holes and s else "true"
        ctes.append(f"o{i} AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS idx, count(*) OVER () AS own FROM {table} WHERE {complete})")
        parts = ("d.i", "p.i", f"'{i + 1}'") if salted else ("d.i", "p.i")
        ctes.append(f"p{i} AS (SELECT d.i AS draw, {sqlgen.hash_index(SEED, f'(SELECT count(*) FROM o{i})', *parts)} AS idx FROM range(0, {DRAWS}) AS d(i), (SELECT unnest(range(0, m)) AS i FROM total) AS p)")
        ctes.append(f"r{i} AS (SELECT draw, o.* FROM p{i} JOIN o{i} AS o USING (idx))")
        ctes.append(f"g{i} AS ({sqlgen.grams(f'r{i}', cols, 'draw')})")
        ctes += sqlgen.fit(f"g{i}", f"f{i}", len(cols), [*range(1, len(cols)), len(cols)], 0, "draw")
        out.append(f"SELECT '{','.join(s)}' AS spec, draw::INTEGER AS draw, {r('b0', 'beta')}, {r(sqlgen.adjusted_r2(), 'r2')} FROM f{i}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


def drawn(res):
    return rounded(res.boot.join(flat(res.full).select("spec_id", "spec"), "spec_id").select("spec", "draw", "beta", "r2"))


@register("null_pattern_draws", drawn_sql("holed", HOLED, ["n1", "n2"], holes=True))
def null_pattern_draws(spark, sf):
    return drawn(holed_fit(spark, sf, ["n1", "n2"], draws=DRAWS))


@register("independent_draws", drawn_sql("people", PEOPLE, ["z1", "z2"], salted=True))
def independent_draws(spark, sf):
    return drawn(people_fit(spark, sf, mode="independent"))


@register("stratified_fold_counts", f"WITH {LINES}, c AS (SELECT (l_returnflag = 'R')::INTEGER AS y, count(*) AS n FROM lines GROUP BY 1) SELECT y, f::INTEGER AS fold, (n // {FOLDS} + (f < n % {FOLDS})::INTEGER)::BIGINT AS n FROM c, range(0, {FOLDS}) AS r(f)")
def stratified_fold_counts(spark, sf):
    d = prepare.with_row_index(lines(spark, sf).select((F.col("l_returnflag") == "R").cast("int").alias("y"), "x"), ["y", "x"], "rid")
    return prepare.stratified_fold(d, "y", FOLDS, SEED, "rid").groupBy("y", "fold").agg(F.count("*").alias("n"))


@register("boot_draws", f"{BOOT} SELECT spec_id, draw::INTEGER AS draw, {r('beta', 'beta')}, {r('r2', 'r2')}, {r('p', 'p', 4)} FROM boot")
def boot_draws(spark, sf):
    return rounded(rounded(people_fit(spark, sf).boot.select("spec_id", "draw", "beta", "r2", "p"), 6, ("p",)), 4, ("beta", "r2"))


@register("boot_null", f"{BOOT} SELECT spec_id, draw::INTEGER AS draw, {r('beta_null', 'beta_null')}, {r('p_null', 'p_null', 4)} FROM boot")
def boot_null(spark, sf):
    return rounded(rounded(people_fit(spark, sf).boot.select("spec_id", "draw", "beta_null", "p_null"), 6, ("p_null",)), 4, ("beta_null",))


@register("boot_summary", f"{BOOT} SELECT spec_id, {r('median(beta)', 'median')}, {r('max(beta)', 'max')}, {r('min(beta)', 'min')}, {r(sqlgen.nearest('beta', 0.975), 'ci_up')}, {r(sqlgen.nearest('beta', 0.025), 'ci_down')} FROM boot GROUP BY spec_id")
def boot_summary(spark, sf):
    return rounded(inference.boot_summary(people_fit(spark, sf).boot))


@register("boot_poisson")
def boot_poisson(spark, sf):
    return inference.boot_summary(line_fit(spark, sf, draws=100, rng="poisson").boot)


@register("boot_lines")
def boot_lines(spark, sf):
    """The default 1,000 draws of every specification of all order lines."""
    s = line_fit(spark, sf, draws=1000).summary_df
    return s.select("spec_id", F.array_join("spec_name", ",").alias("spec"), "median", "max", "min", "ci_up", "ci_down")


@register("boot_lines_inference")
def boot_lines_inference(spark, sf):
    """Joint inference from the default 1,000 draws of all order lines."""
    return line_fit(spark, sf, draws=1000).inference


def cluster_sql(draws: int = 20) -> str:
    cols, w = ["y", "x", *Z], "OVER (PARTITION BY g)"
    ctes = [LINES, "dm AS (SELECT g, " + ", ".join(f"{c} - avg({c}) {w} AS {c}" for c in cols) + " FROM lines)"]
    ctes.append("sizes AS (SELECT g, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, g) - 1 AS idx FROM lines GROUP BY g)")
    ctes.append(f"picks AS (SELECT d.i AS draw, p.i AS pos, {sqlgen.hash_index(SEED, '(SELECT count(*) FROM sizes)', 'd.i', 'p.i')} AS idx FROM range(0, {draws}) AS d(i), (SELECT unnest(range(0, 10 * count(*))) AS i FROM sizes) AS p)")
    ctes.append("upto AS (SELECT draw, g, n, coalesce(sum(n) OVER (PARTITION BY draw ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM picks JOIN sizes USING (idx))")
    ctes.append("used AS (SELECT draw, g, count(*)::DOUBLE AS times FROM upto WHERE before < (SELECT count(*) FROM lines) GROUP BY draw, g, n HAVING count(*) * n > 1)")
    ctes += ["rows_ AS (SELECT draw, times, dm.* FROM dm JOIN used USING (g))", f"gd AS ({sqlgen.grams('rows_', cols, 'draw', 'times')})"]
    out = []
    for i, s in specs(Z):
        ctes += sqlgen.fit("gd", f"f{i}", len(cols), [1, *[cols.index(c) for c in s], len(cols)], 0, "draw")
        out.append(f"SELECT {i}::BIGINT AS spec_id, b0 AS beta FROM f{i}")
    ctes.append("b AS (" + " UNION ALL ".join(out) + ")")
    return "WITH " + ",\n".join(ctes) + f" SELECT spec_id, {r('median(beta)', 'median')}, {r('max(beta)', 'max')}, {r('min(beta)', 'min')}, {r(sqlgen.nearest('beta', 0.975), 'ci_up')}, {r(sqlgen.nearest('beta', 0.025), 'ci_down')} FROM b GROUP BY spec_id"


@register("cluster_boot", cluster_sql())
def cluster_boot(spark, sf):
    return rounded(inference.boot_summary(line_fit(spark, sf, draws=20, group="g").boot))


@register("composite_y", f"WITH {LINES}, s AS (SELECT (x - avg(x) OVER ()) / stddev_pop(x) OVER () AS a, (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS b FROM lines) SELECT {r('sum((a + b) / 2 * a)', 'total', 3)}, {r('max((a + b) / 2)', 'hi')} FROM s")
def composite_y(spark, sf):
    d, names = prepare.composites(lines(spark, sf), ["x", "y"], [1, 3])
    d = d.agg((F.round(F.sum(F.col(names[0]) * F.col(names[1])), 3) + 0.0).alias("total"), (F.round(F.max(names[1]), 6) + 0.0).alias("hi"))
    return d


def multi_y_sql() -> str:
    ctes = [LINES, "s AS (SELECT (y - avg(y) OVER ()) / stddev_pop(y) OVER () AS a, (z1 - avg(z1) OVER ()) / stddev_pop(z1) OVER () AS b, x, z3 FROM lines)", "c AS (SELECT a, b, (a + b) / 2 AS ab, x, z3 FROM s)"]
    cols, out = ["a", "b", "ab", "x", "z3", "1.0"], []
    ctes.append(f"g0 AS ({sqlgen.grams('c', cols)})")
    for y, name in ((0, "y"), (1, "z1"), (2, "y,z1")):
        for s in ((), ("z3",)):
            f = f"f{y}{len(s)}"
            ctes += sqlgen.fit("g0", f, 6, [3, 5, *([4] if s else [])], y)
            out.append(f"SELECT '{name}' AS y, '{','.join(s)}' AS spec, {r('b0', 'beta', 7)}, {r(sqlgen.adjusted_r2(), 'r2')} FROM {f}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


@register("multi_y_specs", multi_y_sql())
def multi_y_specs(spark, sf):
    full = estimators.OLSRobust(["y", "z1"], ["x"], lines(spark, sf)).fit(controls=["z3"], draws=0, kfold=0).get_results().full
    return flat(full).select("y", "spec", (F.round("beta", 7) + 0.0).alias("beta"), (F.round("r2", 6) + 0.0).alias("r2"))


def logit_data(spark, sf):
    return lines(spark, sf).select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("x") / 50).alias("x"), "z1", (F.col("z3") / 50).alias("z3"))


def logit_sql() -> str:
    ctes = [LINES, "d AS (SELECT (l_returnflag = 'R')::INTEGER AS y, x / 50 AS x FROM lines)", "b0 AS (SELECT 0.0::DOUBLE AS b, 0.0::DOUBLE AS a)"]
    for k in range(8):
        ctes.append(f"h{k} AS (SELECT any_value(b) AS b, any_value(a) AS a, sum((y - p) * x) AS sx, sum(y - p) AS s1, sum(p * (1 - p) * x * x) AS hxx, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p)) AS h1 FROM (SELECT y, x, b, a, 1 / (1 + exp(-(b * x + a))) AS p FROM d, b{k}))")
        ctes.append(f"b{k + 1} AS (SELECT b + (h1 * sx - hx * s1) / (hxx * h1 - hx * hx) AS b, a + (hxx * s1 - hx * sx) / (hxx * h1 - hx * hx) AS a FROM h{k})")
    ctes.append("e AS (SELECT any_value(b) AS b, sum(y * ln(p) + (1 - y) * ln(1 - p)) AS ll, count(*) AS n, sum(y) AS s, sum(p * (1 - p) * x * x) AS hxx, sum(p * (1 - p) * x) AS hx, sum(p * (1 - p)) AS h1 FROM (SELECT y, x, b, 1 / (1 + exp(-(b * x + a))) AS p FROM d, b8))")
    null = "(s * ln(s / n) + (n - s) * ln(1 - s / n))"
    return "WITH " + ",\n".join(ctes) + f" SELECT {r('b', 'beta')}, {r('sqrt(h1 / (hxx * h1 - hx * hx))', 'se')}, {r('ll', 'll', 3)}, {r(f'1 - ll / {null}', 'r2', 8)}, {r('4 - 2 * ll', 'aic', 3)}, {r('2 * ln(n) - 2 * ll', 'bic', 3)} FROM e"


def logit_fit(spark, sf, controls, **kw):
    rows, given = logit_data(spark, sf).select("y", "x", *controls), {"draws": 0, "kfold": 0, "seed": SEED, "shap": False} | kw
    if not given["draws"]:  # lines are alike in few ways, and only draws tell equal ones apart
        rows, given["times"] = rows.groupBy(*rows.columns).agg(F.count("*").alias("times")), "times"
    return estimators.LRobust(["y"], ["x"], materialize(rows, "lines")).fit(controls=controls, **given).get_results()


@register("logit_full", logit_sql())
def logit_full(spark, sf):
    f = logit_fit(spark, sf, []).full
    rd = lambda c, k: F.round(c, k) + 0.0
    return f.select(rd("beta", 6).alias("beta"), rd(F.col("se")[0], 6).alias("se"), rd("ll_raw", 3).alias("ll"), rd("r2", 8).alias("r2"), rd("aic", 3).alias("aic"), rd("bic", 3).alias("bic"))


def logit_metric(metric: str, spark, sf):
    res = logit_fit(spark, sf, ["z1"], kfold=FOLDS, oos_metric=metric)
    return flat(res.full).join(res.oos.groupBy("spec_id").agg(F.avg("metric").alias("metric")), "spec_id").select("spec", "metric")


def logit_cv_sql(metric: str) -> str:
    """Newton steps as weighted least squares of the working response, for all folds at once."""
    order = "md5(concat_ws('|', '%d', rid))" % SEED
    ctes = ["d0 AS (SELECT (l_returnflag = 'R')::INTEGER AS y, x / 50 AS x, z1 FROM lines)", "d1 AS (SELECT *, row_number() OVER (ORDER BY y, x, z1) - 1 AS rid FROM d0)"]
    ctes = [LINES, *ctes, f"d AS (SELECT *, (row_number() OVER (PARTITION BY y ORDER BY {order}, rid) - 1) % {FOLDS} AS fold FROM d1)", f"folds AS (SELECT range AS f FROM range(0, {FOLDS}))"]
    out = []
    for i, controls in enumerate(((), ("z1",))):
        cols = ["x", "1.0", *controls]
        beta = [f"{i}_b{k}" for k in range(len(cols))]
        ctes.append(f"n{i}_0 AS (SELECT f, " + ", ".join(f"0.0::DOUBLE AS c{k}" for k in range(len(beta))) + " FROM folds)")
        eta = " + ".join(f"c{k} * {c}" for k, c in enumerate(cols))
        for step in range(7):
            ctes.append(f"w{i}_{step} AS (SELECT f, x, z1, y, e, 1 / (1 + exp(-e)) AS p FROM (SELECT f, x, z1, y, {eta} AS e FROM d, n{i}_{step} WHERE fold <> f))")
            ctes.append(f"v{i}_{step} AS (SELECT f, x, z1, e + (y - p) / (p * (1 - p)) AS z, p * (1 - p) AS w FROM w{i}_{step})")
            ctes.append(f"g{i}_{step} AS ({sqlgen.grams(f'v{i}_{step}', ['z', *cols], 'f', 'w')})")
            ctes += sqlgen.fit(f"g{i}_{step}", f"s{i}_{step}", 1 + len(cols), [*range(1, 1 + len(cols))], 0, "f")
            ctes.append(f"n{i}_{step + 1} AS (SELECT f, " + ", ".join(f"b{k} AS c{k}" for k in range(len(cols))) + f" FROM s{i}_{step})")
        ctes.append(f"t{i} AS (SELECT f, y, 1 / (1 + exp(-({eta}))) AS p, (SELECT avg(y) FROM d AS o WHERE o.fold <> f) AS q FROM d JOIN n{i}_7 ON fold = f)")
        ll = lambda p: f"sum(y * ln({p}) + (1 - y) * ln(1 - {p}))"
        if metric == "imv":
            # The coin whose certainty gives the mean log-likelihood, by halving [0.5, 0.999].
            clip = lambda e: f"least(greatest({e}, 1e-4), 1 - 1e-4)"
            ctes.append(f"a{i} AS (SELECT f, {ll(clip('p'))} / count(*) AS own, any_value(m) AS q FROM t{i} JOIN (SELECT f, avg(y) AS m FROM t{i} GROUP BY f) USING (f) GROUP BY f)")
            ctes.append(f"e{i} AS (SELECT f, 0 AS kind, own AS a FROM a{i} UNION ALL SELECT f, 1, {clip('q')} * ln({clip('q')}) + (1 - {clip('q')}) * ln(1 - {clip('q')}) FROM a{i})")
            mid = "((lo + hi) / 2)"
            less = f"({mid} * ln({mid}) + (1 - {mid}) * ln(1 - {mid}) < a)"
            ctes.append(f"h{i} AS (SELECT f, kind, a, 0.5::DOUBLE AS lo, 0.999::DOUBLE AS hi, 0 AS s FROM e{i} UNION ALL SELECT f, kind, a, CASE WHEN {less} THEN {mid} ELSE lo END, CASE WHEN {less} THEN hi ELSE {mid} END, s + 1 FROM h{i} WHERE s < 60)")
            ctes.append(f"c{i} AS (SELECT f, max(CASE WHEN kind = 0 THEN lo END) AS w, max(CASE WHEN kind = 1 THEN lo END) AS w0 FROM h{i} WHERE s = 60 GROUP BY f)")
            out.append(f"SELECT '{','.join(controls)}' AS spec, {r('avg((w - w0) / w0)', 'metric')} FROM c{i}")
            continue
        value = {"mcfaddens-r2": f"1 - {ll('p')} / {ll('q')}", "cross-entropy": f"-{ll('p')} / count(*)", "rmse": "sqrt(avg(pow(y - p, 2)))", "pseudo-r2": "1 - sum(pow(y - p, 2)) / sum(pow(y - q, 2))"}[metric]
        out.append(f"SELECT '{','.join(controls)}' AS spec, {r('avg(m)', 'metric')} FROM (SELECT f, {value} AS m FROM t{i} GROUP BY f)")
    return ("WITH RECURSIVE " if metric == "imv" else "WITH ") + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


for _m, _n in (("mcfaddens-r2", "mcfadden"), ("cross-entropy", "xent"), ("imv", "imv"), ("pseudo-r2", "pseudo_r2"), ("rmse", "rmse")):
    register(f"logit_{_n}", logit_cv_sql(_m))(lambda spark, sf, _m=_m: rounded(logit_metric(_m, spark, sf)))


@register("logit_boot")
def logit_boot(spark, sf):
    return inference.boot_summary(logit_fit(spark, sf, ["z1"], draws=5).boot)


def _weights(ic: str) -> str:
    w = f"exp(-0.5 * ({ic} - (SELECT min({ic}) FROM curve)))"
    return r(f"(SELECT sum({w} * beta) / sum({w}) FROM curve)", f"{ic}_average", 5)


@register("ic_weighted_avg", f"{FULL} SELECT {', '.join(_weights(c) for c in ('aic', 'bic', 'hqic'))}")
def ic_weighted_avg(spark, sf):
    res = line_fit(spark, sf)
    return rounded(res.inference.select("aic_average", "bic_average", "hqic_average"), 5)


def _share(cond: str, name: str, table: str) -> str:
    return r(f"(SELECT avg(coalesce(({cond})::INTEGER, 0)) FROM {table})", name)


@register("sign_sig_shares", f"{BOOT} SELECT " + ", ".join(_share(c, n, t) for t, sfx, p in (("full_", "_ns", "pval"), ("boot", "", "p")) for c, n in (("beta > 0", f"pos_prop{sfx}"), ("beta < 0", f"neg_prop{sfx}"), (f"{p} < 0.05", f"sig_prop{sfx}"), (f"beta > 0 AND {p} < 0.05", f"pos_sig_prop{sfx}"), (f"beta < 0 AND {p} < 0.05", f"neg_sig_prop{sfx}"))))
def sign_sig_shares(spark, sf):
    names = [f"{k}_prop{s}" for s in ("_ns", "") for k in ("pos", "neg", "sig", "pos_sig", "neg_sig")]
    return rounded(people_fit(spark, sf).inference.select(*names))


@register("median_p", f"{BOOT} SELECT {r('(SELECT median(beta) FROM full_)', 'median_ns')}, {r('(SELECT median(beta) FROM boot)', 'median')}, {r('avg((abs(m) >= abs((SELECT median(beta) FROM full_)))::INTEGER)', 'median_p')} FROM (SELECT median(beta_null) AS m FROM boot GROUP BY draw)")
def median_p(spark, sf):
    return rounded(people_fit(spark, sf).inference.select("median_ns", "median", "median_p"))


@register("empirical_p", f"{BOOT}, d AS (SELECT draw, count(*) FILTER (WHERE beta_null > 0) AS a, count(*) FILTER (WHERE p_null < 0.05) AS s FROM boot GROUP BY draw), o AS (SELECT (SELECT count(*) FROM full_ WHERE beta > 0) AS a, (SELECT count(*) FROM boot WHERE p < 0.05) AS s) SELECT {r('least(1, 2 * least((count(*) FILTER (WHERE d.a >= o.a) + 1) / (count(*) + 1), (count(*) FILTER (WHERE d.a <= o.a) + 1) / (count(*) + 1)))', 'pos_p')}, {r('least(1, 2 * least((count(*) FILTER (WHERE d.s >= o.s) + 1) / (count(*) + 1), (count(*) FILTER (WHERE d.s <= o.s) + 1) / (count(*) + 1)))', 'sig_p')} FROM d, o")
def empirical_p(spark, sf):
    return rounded(people_fit(spark, sf).inference.select("pos_p", "sig_p"))


def stouffer_sql() -> str:
    z = lambda b, p: f"sign({b}) * {sqlgen.upper_normal(f'least(greatest({p}, 1e-300), 1 - 1e-16) / 2')}"
    ctes = [BOOT, f"z AS (SELECT spec_id, draw, {z('beta_null', 'p_null')} AS z FROM boot)", "per AS (SELECT spec_id, avg(z) AS mu, stddev_samp(z) AS sd FROM z GROUP BY spec_id)"]
    ctes.append(f"o AS (SELECT spec_id, {z('beta', 'pval')} AS z FROM full_)")
    ctes.append("w AS (SELECT draw, sum((z - mu) / sd) AS w, sum(z) AS s FROM z JOIN per USING (spec_id) GROUP BY draw)")
    ctes.append("k AS (SELECT count(*) AS kept, sum(z) AS total, (SELECT var_samp(w) FROM w) AS v FROM o)")
    ctes.append("b AS (SELECT *, sqrt(v + kept * 1e-12) AS denom FROM k)")
    hits = "(SELECT count(*) FILTER (WHERE abs(s / denom) >= abs(total / denom)) + 1 FROM w)"
    return ",\n".join(ctes) + f" SELECT {r('total / denom', 'stouffer_z', 4)}, {r(f'{hits} / ({DRAWS} + 1)', 'stouffer_p', 4)}, kept AS stouffer_kept, {r('(v - kept) / (kept * (kept - 1))', 'mean_correlation', 4)} FROM b"


@register("stouffer", stouffer_sql())
def stouffer(spark, sf):
    res = people_fit(spark, sf)
    return rounded(inference.stouffer(res.full, res.boot), 4)


@register("join_sig", f"{BOOT}, s AS (SELECT spec_id, {sqlgen.nearest('beta', 0.025)} AS lo FROM boot GROUP BY spec_id), d AS (SELECT draw, count(*) FILTER (WHERE beta > 0 AND p < 0.05) AS n FROM boot GROUP BY draw) SELECT {r('avg((n >= (SELECT count(*) FROM s WHERE lo > 0))::INTEGER)', 'p')} FROM d")
def join_sig(spark, sf):
    res = people_fit(spark, sf)
    return rounded(inference.join_sig_test(res.full, inference.boot_summary(res.boot), res.boot, 0.05, True))


_BMA = "exp(-0.5 * (bic - (SELECT min(bic) FROM curve)))"


@register("bma", f"{FULL}, w AS (SELECT *, {_BMA} AS w FROM curve) " + " UNION ALL ".join(f"SELECT '{c}' AS control_var, {r(f'sum(CASE WHEN list_contains(string_split(spec, chr(44)), {chr(39)}{c}{chr(39)}) THEN w ELSE 0 END) / sum(w)', 'probs')}, {r(f'sum(w * b_{c}) / sum(w)', 'average_coefs')} FROM w" for c in Z))
def bma(spark, sf):
    return rounded(line_fit(spark, sf).compute_bma())


def shap_sql() -> str:
    cols = ["y", "x", *Z]
    ctes = [LINES, "o AS (SELECT *, row_number() OVER (ORDER BY y, x, z1, z2, z3) - 1 AS rid FROM lines)", f"s AS (SELECT *, {sqlgen.hash_index(SEED, '1000000', 'rid')} < 800000 AS train FROM o)", "t AS (SELECT * FROM s WHERE train)", f"g0 AS ({sqlgen.grams('t', cols)})"]
    ctes += sqlgen.fit("g0", "f", 5, [1, 2, 3, 4, 5], 0)
    mean = lambda c: f"(SELECT avg({c}) FROM t)"
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'sum(abs(b{i} * ({c} - {mean(c)})))', 'total', 4)} FROM s, f WHERE NOT train" for i, c in enumerate(["x", *Z]))


@register("linear_shap", shap_sql())
def linear_shap(spark, sf):
    return rounded(panels.shap_order(line_fit(spark, sf, shap=True, order_by=["y", "x", *Z]).shap), 4)


@register("merge_results", f"{FULL} SELECT tag, count(*) AS n, {r('min(beta)', 'lo')} FROM curve, (VALUES ('one'), ('two')) AS t(tag) GROUP BY tag")
def merge_results(spark, sf):
    res = line_fit(spark, sf)
    return rounded(res.merge(res, "one", "two").full.groupBy("tag").agg(F.count("*").alias("n"), F.min("beta").alias("lo")))


@register("concat_dedupe", f"{FULL} SELECT count(*) AS n, {r('sum(beta)', 'total', 5)} FROM curve")
def concat_dedupe(spark, sf):
    res = line_fit(spark, sf)
    return rounded(estimators.concat_results([res, res]).full.agg(F.count("*").alias("n"), F.sum("beta").alias("total")), 5)


def hexbin_sql(source: str, x: str, y: str) -> str:
    """A SELECT of the lattice counts of columns of a table."""
    return f"""SELECT CASE WHEN f THEN u1 ELSE u2 END AS hx, CASE WHEN f THEN v1 ELSE v2 END AS hy, count(*) AS n FROM
(SELECT *, pow(u - u1, 2) + 3 * pow(v - v1, 2) < pow(u - u2, 2) + 3 * pow(v - v2, 2) AS f FROM
(SELECT u, v, round_even(u, 0) AS u1, round_even(v, 0) AS v1, floor(u) + 0.5 AS u2, floor(v) + 0.5 AS v2 FROM
(SELECT ({x} - x0) * 20 / (x1 - x0) AS u, ({y} - y0) * 11 / (y1 - y0) AS v FROM {source},
(SELECT min({x}) AS x0, max({x}) AS x1, min({y}) AS y0, max({y}) AS y1 FROM {source})))) GROUP BY 1, 2"""


@register("hexbin_r2", f"{BOOT} {hexbin_sql('boot', 'beta', 'r2')}")
def hexbin_r2(spark, sf):
    return panels.hexbin(people_fit(spark, sf).boot, "beta", "r2")


@register("hexbin_ll", f"{FULL}, p AS (SELECT beta, ll_gain / n AS ll FROM curve) {hexbin_sql('p', 'beta', 'll')}")
def hexbin_ll(spark, sf):
    return panels.hexbin(line_fit(spark, sf).full, "beta", "ll_gain_per_obs")


@register("hexbin_points", hexbin_sql("lineitem", "l_quantity", "l_extendedprice"))
def hexbin_points(spark, sf):
    return panels.hexbin(read(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@register("oos_hist", "WITH r AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS total FROM orders), b AS (SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, r.* FROM orders, r) SELECT bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 30, 4) + 0.0 AS lo, count(*) AS n FROM b GROUP BY bin")
def oos_hist(spark, sf):
    return panels.histogram(read(spark, sf, "orders"), "o_totalprice").select("bin", (F.round("lo", 4) + 0.0).alias("lo"), "n")


_SCORES = kfold_sql("pseudo-r2").replace("round(", "(").replace(", 6) + 0.0 AS metric", ") AS metric")


@register("oos_scores_hist", f"WITH k AS ({_SCORES}), e AS (SELECT min(metric) AS lo, max(metric) AS hi FROM k) SELECT least(floor((metric - lo) / ((hi - lo) / 30)), 29)::INTEGER AS bin, count(*) AS n FROM k, e GROUP BY 1")
def oos_scores_hist(spark, sf):
    res = people_fit(spark, sf, draws=0, kfold=FOLDS)
    return panels.histogram(res.oos.groupBy("spec_id").agg(F.avg("metric").alias("m")), "m").select("bin", "n")


_CURVE = f"{BOOT}, s AS (SELECT spec_id, median(beta) AS median, {sqlgen.nearest('beta', 0.0)} AS lo, {sqlgen.nearest('beta', 1.0)} AS hi FROM boot GROUP BY spec_id), o AS (SELECT *, row_number() OVER (ORDER BY median, spec_id)::INTEGER AS position FROM s)"


@register("spec_curve", f"{_CURVE} SELECT spec_id, {r('median', 'median')}, {r('lo', 'lo')}, {r('hi', 'hi')}, position, CASE spec_id WHEN 0 THEN 'null' WHEN 3 THEN 'full' ELSE 'other' END AS kind FROM o")
def spec_curve(spark, sf):
    res = people_fit(spark, sf)
    return rounded(panels.spec_curve(res.boot, res.full, 2, smooth=False))


register("spec_order", f"{_CURVE} SELECT spec_id, position FROM o")(lambda spark, sf: panels.curve_order(inference.boot_summary(people_fit(spark, sf).boot)).select("spec_id", "position"))


@register("spec_curve_smooth")
def spec_curve_smooth(spark, sf):
    res = people_fit(spark, sf)
    return panels.spec_curve(res.boot, res.full, 2)


@register("spec_matrix", f"{_CURVE} SELECT position AS bin, c.control, (CASE WHEN list_contains(string_split(spec, ','), c.control) THEN 1.0 ELSE 0.0 END)::DOUBLE AS share FROM o JOIN curve USING (spec_id), (VALUES ('z1'), ('z2')) AS c(control)")
def spec_matrix(spark, sf):
    res = people_fit(spark, sf)
    return panels.spec_matrix(panels.spec_curve(res.boot, res.full, 2, smooth=False), res.full, ["z1", "z2"])


@register("ic_curve", f"{FULL} SELECT spec_id, {r('bic', 'value', 3)}, row_number() OVER (ORDER BY bic, spec_id)::INTEGER AS position, CASE spec_id WHEN 0 THEN 'null' WHEN 7 THEN 'full' ELSE 'other' END AS kind FROM curve")
def ic_curve(spark, sf):
    return rounded(panels.ic_curve(line_fit(spark, sf).full, "bic", 3), 3)


@register("boot_density")
def boot_density(spark, sf):
    res = people_fit(spark, sf)
    return panels.boot_density(res.boot, res.full, 2)


@register("odds_ratio", logit_sql().rsplit(" SELECT ", 1)[0] + f" SELECT {r('exp(b)', 'beta')} FROM e")
def odds_ratio(spark, sf):
    return rounded(panels.odds_ratios(logit_fit(spark, sf, []).full.select("beta"), "beta"))


# Data preparation.

@register("lag_lead_growth", "SELECT o_custkey, o_orderkey, round(o_totalprice - lag(o_totalprice) OVER w, 2) + 0.0 AS diff, round(lead(o_totalprice) OVER w, 2) + 0.0 AS next FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def lag_lead_growth(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    o = sequences.neighbours(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"before": ("o_totalprice", -1), "next": ("o_totalprice", 1)})
    return o.select("o_custkey", "o_orderkey", (F.round(F.col("o_totalprice") - F.col("before"), 2) + 0.0).alias("diff"), (F.round("next", 2) + 0.0).alias("next"))


NATIONS = "months AS (SELECT c_nationkey AS nation, year(o_orderdate) * 12 + month(o_orderdate) AS month, count(*) AS orders, sum(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 = 0 GROUP BY 1, 2)"


def months(spark, sf):
    """A panel of nations by month, with gaps."""
    c = read(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation"))
    o = read(spark, sf, "orders").where("o_orderkey % 3 = 0").join(c, "o_custkey")
    return o.groupBy("nation", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("month")).agg(F.count("*").alias("orders"), F.sum("o_totalprice").alias("price"))


@register("panel_growth", f"WITH {NATIONS} SELECT nation, month::BIGINT AS month, {r('CASE WHEN lag(month) OVER w = month - 1 THEN ln(price) - ln(lag(price) OVER w) END', 'growth')}, CASE WHEN lead(month, 12) OVER w = month + 12 THEN lead(orders, 12) OVER w END AS next_year FROM months WINDOW w AS (PARTITION BY nation ORDER BY month)")
def panel_growth(spark, sf):
    """Growth since the month before, where there is one, and the orders of the 12th month on, where none of the 12 is missing."""
    m = sequences.differences(months(spark, sf), ["nation"], ["month"], ["price"], step=1, logs=True)
    m = sequences.neighbours(m, ["nation"], ["month"], {"next_year": ("orders", 12)}, step=1)
    return rounded(m.select("nation", F.col("month").cast("long").alias("month"), F.col("price_diff").alias("growth"), "next_year"))


@register("running_sum", "SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 2) + 0.0 AS total FROM orders")
def running_sum(spark, sf):
    o = read(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    o = sequences.trailing(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], {"total": ("o_totalprice", "sum")}, 20)
    return rounded(o.select("o_custkey", "o_orderkey", "total"), 2)


@register("trailing_stats", f"SELECT event_id, {r('CASE WHEN count(value) OVER w >= 5 THEN avg(value) OVER w END', 'mean', 9)}, {r('CASE WHEN count(value) OVER w >= 5 THEN min(value) OVER w END', 'lo', 9)}, count(value) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW)")
def trailing_stats(spark, sf):
    """Five units of a fifth of all rows each."""
    e = read(spark, sf, "events").select("event_id", "event_type", "ts", "value")
    e = sequences.trailing(e, ["event_type"], ["ts", "event_id"], {"mean": ("value", "avg"), "lo": ("value", "min"), "n": ("value", "count")}, 50, 5)
    return rounded(e.select("event_id", "mean", "lo", "n"), 9)


@register("one_hot", "SELECT sum((l_returnflag = 'A')::INTEGER)::BIGINT AS a, sum((l_returnflag = 'N')::INTEGER)::BIGINT AS n, sum((l_returnflag = 'R')::INTEGER)::BIGINT AS r FROM lineitem")
def one_hot(spark, sf):
    d = prepare.one_hot(read(spark, sf, "lineitem"), "l_returnflag", "f")
    return d.agg(F.sum("f_A").alias("a"), F.sum("f_N").alias("n"), F.sum("f_R").alias("r"))


@register("bin_scores", "SELECT score, count(*) AS n FROM (SELECT CASE WHEN l_quantity < 10 THEN 1.0 WHEN l_quantity < 25 THEN 2.0 WHEN l_quantity < 40 THEN 4.0 ELSE 7.0 END::DOUBLE AS score FROM lineitem) GROUP BY score")
def bin_scores(spark, sf):
    s = prepare.bin_score(F.col("l_quantity"), [(10, 1.0), (25, 2.0), (40, 4.0)], 7.0)
    return read(spark, sf, "lineitem").groupBy(s.alias("score")).agg(F.count("*").alias("n"))


@register("safe_log_avg", "SELECT c_nationkey, round(avg(CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END), 6) + 0.0 AS m FROM customer GROUP BY c_nationkey")
def safe_log_avg(spark, sf):
    return rounded(read(spark, sf, "customer").groupBy("c_nationkey").agg(F.avg(prepare.safe_log(F.col("c_acctbal"))).alias("m")))


@register("group_avg_join", "SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) + 0.0 AS gap FROM customer")
def group_avg_join(spark, sf):
    c = tables.group_join(read(spark, sf, "customer"), ["c_nationkey"], {"m": F.avg("c_acctbal")})
    return c.select("c_custkey", (F.round(F.col("c_acctbal") - F.col("m"), 4) + 0.0).alias("gap"))


@register("group_joins", f"WITH a AS (SELECT *, avg(l_quantity) OVER (PARTITION BY l_suppkey) AS m FROM lineitem), b AS (SELECT *, l_quantity > m AS above FROM a), c AS (SELECT *, count(*) OVER (PARTITION BY l_returnflag, above) AS flagged, max(l_tax) OVER (PARTITION BY l_shipdate) AS most FROM b) SELECT l_orderkey, l_linenumber, {r('l_quantity - m', 'gap', 9)}, flagged, {r('most - l_tax', 'room', 9)} FROM c")
def group_joins(spark, sf):
    """Figures of three groupings of all lines; the second groups by what the first found, into few hot groups."""
    d = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_shipdate", "l_quantity", "l_tax")
    d = tables.group_join(d, ["l_suppkey"], {"m": F.avg("l_quantity")}).withColumn("above", F.col("l_quantity") > F.col("m"))
    d = tables.group_joins(d, [(["l_returnflag", "above"], {"flagged": F.count("*")}), (["l_shipdate"], {"most": F.max("l_tax")})])
    gap, room = F.col("l_quantity") - F.col("m"), F.col("most") - F.col("l_tax")
    return rounded(d.select("l_orderkey", "l_linenumber", gap.alias("gap"), "flagged", room.alias("room")), 9)


@register("group_size_share", "SELECT DISTINCT c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer")
def group_size_share(spark, sf):
    return tables.group_size(read(spark, sf, "customer").select("c_nationkey"), ["c_nationkey"], "n").distinct()


@register("left_index_join", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def left_index_join(spark, sf):
    c = read(spark, sf, "customer").select("c_custkey", "c_name")
    return tables.index_join(read(spark, sf, "orders"), c, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@register("median_binarise", "SELECT sum((o_totalprice > m)::INTEGER)::BIGINT AS n FROM orders, (SELECT median(o_totalprice) AS m FROM orders)")
def median_binarise(spark, sf):
    return prepare.median_binarise(read(spark, sf, "orders"), "o_totalprice", "b").agg(F.sum("b").alias("n"))


@register("corr_matrix", "SELECT round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS a, round(corr(l_quantity, l_discount), 6) + 0.0 AS b, round(corr(l_discount, l_tax), 6) + 0.0 AS c FROM lineitem")
def corr_matrix(spark, sf):
    c = tables.correlations(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    k = lambda a, b: F.max(F.when((F.col("a") == a) & (F.col("b") == b), F.round("r", 6) + 0.0))
    return c.agg(k("l_quantity", "l_extendedprice").alias("a"), k("l_quantity", "l_discount").alias("b"), k("l_discount", "l_tax").alias("c"))


def pairwise_sql() -> str:
    pairs = " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) AS n, {r(f'corr({a}, {b})', 'r')} FROM holed" for a in SIX for b in SIX)
    return f"WITH holed AS (SELECT {_HOLED} FROM lineitem) {pairs}"


@register("corr_pairwise", pairwise_sql())
def corr_pairwise(spark, sf):
    """All pairs of six columns, each over the rows that have both."""
    return rounded(tables.correlations(holed_items(spark, sf), SIX))


@register("anti_join_resume", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def anti_join_resume(spark, sf):
    from polyspec.sources.readers import pending

    return pending(read(spark, sf, "customer").select("c_custkey"), read(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@register("group_stats", "SELECT event_type, round(avg(value), 6) + 0.0 AS mean, round(median(value), 6) + 0.0 AS median, round(min(value), 6) + 0.0 AS lo, round(max(value), 6) + 0.0 AS hi, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def group_stats(spark, sf):
    p = tables.profile(read(spark, sf, "events"), ["event_type"], ["value", "user_id"])
    of = lambda column, figure: F.max(F.when(F.col("column") == column, F.col(figure)))
    return rounded(p.groupBy("event_type").agg(*[of("value", c).alias(c) for c in ("mean", "median", "lo", "hi")], of("user_id", "n_distinct").alias("users")))


def profile_sql() -> str:
    number = lambda c: f"SELECT l_returnflag, '{c}' AS \"column\", count({c}) AS n, count(DISTINCT {c}) AS n_distinct, {r(f'avg({c})', 'mean')}, {r(f'median({c})', 'median')}, {r(f'min({c})', 'lo')}, {r(f'max({c})', 'hi')} FROM lineitem GROUP BY l_returnflag"
    text = "SELECT l_returnflag, 'l_shipdate', count(l_shipdate), count(DISTINCT l_shipdate), NULL, NULL, NULL, NULL FROM lineitem GROUP BY l_returnflag"
    return " UNION ALL ".join([*[number(c) for c in PROFILED], text])


PROFILED = ["l_quantity", "l_extendedprice", "l_partkey"]


@register("profile", profile_sql())
def profile(spark, sf):
    """Three hot groups of all lines, with exact medians and distinct values."""
    return rounded(tables.profile(read(spark, sf, "lineitem"), ["l_returnflag"], [*PROFILED, "l_shipdate"]))


@register("reservoir_sample")
def reservoir_sample(spark, sf):
    return space.reservoir_sample(read(spark, sf, "customer").select("c_custkey"), 100, SEED, "c_custkey")


@register("hc1_ols", f"WITH {PEOPLE}, m AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, count(*) AS n FROM people), e AS (SELECT sum(pow((x - mx) * (y - a - b * x), 2)) AS meat, sum(pow(x - mx, 2)) AS sxx, any_value(n) AS n, any_value(b) AS b FROM people, m) SELECT {r('b', 'beta')}, {r('sqrt(n / (n - 2) * meat) / sxx', 'se')} FROM e")
def hc1_ols(spark, sf):
    d = people(spark, sf).select("y", "x")
    b, se = robust_errors(d, "y", ["x"])
    return spark.createDataFrame([(round(b[0], 6), round(se[0], 6))], "beta double, se double")


def hc1_sql() -> str:
    controls, cols = ["z1", "z2"], ["y", "x", "1.0", "z1", "z2"]
    ctes, out = [PEOPLE, f"g0 AS ({sqlgen.grams('people', cols)})"], []
    for i, s in specs(controls):
        use = [1, 2, *[cols.index(c) for c in s]]
        ctes += sqlgen.fit("g0", f"f{i}", 5, use, 0)
        line = " - ".join(["y", *[f"b{a} * {cols[c]}" for a, c in enumerate(use)]])
        ctes.append(f"e{i} AS (SELECT people.*, pow({line}, 2) AS e2 FROM people, f{i})")
        ctes.append(f"m{i} AS ({sqlgen.grams(f'e{i}', [cols[c] for c in use], weight='e2')})")
        k = len(use)
        meat = " + ".join(f"s.a_0_{a} * m.{sqlgen.entry(a, b)} * s.a_0_{b}" for a in range(k) for b in range(k))
        out.append(f"SELECT '{','.join(s)}' AS spec, {r('b0', 'beta')}, {r(f'sqrt((SELECT {meat} FROM f{i}_s{k} AS s, m{i} AS m) * n / (n - k))', 'se')} FROM f{i}")
    return "WITH " + ",\n".join(ctes) + " " + " UNION ALL ".join(out)


@register("hc1_curve", hc1_sql())
def hc1_curve(spark, sf):
    f = robust.hc1_curve(people(spark, sf), "y", ["x"], ["z1", "z2"])
    return rounded(f.select(F.array_join("controls", ",").alias("spec"), F.get("b", 0).alias("beta"), F.get("se", 0).alias("se")))


def robust_errors(df: DataFrame, y: str, x: list[str]):
    """Coefficients (x, intercept) and HC1 errors: a second scan adds up e^2 x x'."""
    np = moments.np
    p = len(x) + 1
    g = moments.unpack(np.array(moments.gram(df, [y, *x]).first().gram, float), p)
    cols = [*range(1, p), p]
    b = ols.fit(g[None], cols, 0, full=False)["b"][0]
    line: Column = sum((F.lit(float(v)) * F.col(f"`{c}`") for v, c in zip(b, x, strict=False)), F.lit(float(b[-1])))
    e = df.withColumn("__w", (F.col(f"`{y}`") - line) ** 2)
    meat = moments.unpack(np.array(moments.gram(e, x, weight="__w").first().gram, float), len(x))
    inverse = np.linalg.inv(g[np.ix_(cols, cols)])
    n, k = g[-1, -1], len(cols)
    return b.tolist(), np.sqrt(np.diag(inverse @ meat @ inverse) * n / (n - k)).tolist()


@register("string_cleanup", "SELECT name, count(*) AS n FROM (SELECT lower(trim(replace(p_brand, '#', ' no '))) AS name FROM part) GROUP BY name")
def string_cleanup(spark, sf):
    return read(spark, sf, "part").groupBy(prepare.clean_name(F.regexp_replace("p_brand", "#", " no ")).alias("name")).agg(F.count("*").alias("n"))


@register("text_cleanup", "SELECT doc_id, md5(regexp_replace(replace(strip_accents(lower(trim(text, ' '))), chr(39), ''), '[^\\x00-\\x7F]', '', 'g')) AS cleaned FROM documents")
def text_cleanup(spark, sf):
    """Whole texts of four languages without accents."""
    return read(spark, sf, "documents").select("doc_id", F.md5(prepare.clean_name(F.col("text"))).alias("cleaned"))


@register("coerced_range_filter", "SELECT count(*) AS n, sum(v)::BIGINT AS total FROM (SELECT try_cast(substr(c_name, 10) AS INTEGER) AS v FROM customer) WHERE v BETWEEN 10 AND 900")
def coerced_range_filter(spark, sf):
    v = tables.coerce(read(spark, sf, "customer").select(F.substr("c_name", F.lit(10)).alias("v")), ["v"])
    return tables.in_ranges(v, {"v": (10, 900)}).agg(F.count("*").alias("n"), F.sum("v").cast("long").alias("total"))


@register("recoded_ranges", f"WITH d AS (SELECT c_custkey, CASE WHEN c_acctbal BETWEEN 0 AND 9000 THEN c_acctbal END AS balance, TRY_CAST(substr(c_name, 8 + (c_custkey % 3)::INTEGER) AS DOUBLE) AS number, CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS code FROM customer) SELECT c_custkey, {r('balance', 'balance', 2)}, number, code FROM d")
def recoded_ranges(spark, sf):
    """Balances out of range blanked, texts that are no numbers coerced to null, segments recoded."""
    cut = F.substr("c_name", (8 + F.col("c_custkey") % 3).cast("int"))
    d = tables.coerce(read(spark, sf, "customer").withColumn("number", cut), ["c_acctbal", "number"])
    d = tables.in_ranges(d, {"c_acctbal": (0, 9000)}, nulls=True, blank=True)
    code = tables.recode(F.col("c_mktsegment"), {"BUILDING": 1, "MACHINERY": 2}, F.lit(0))
    return d.select("c_custkey", (F.round("c_acctbal", 2) + 0.0).alias("balance"), "number", code.alias("code"))


@register("set_difference", "SELECT DISTINCT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, sf):
    s = read(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return tables.difference(read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), s, ["k"])


@register("distinct_keep_first", "SELECT o_custkey, min(o_orderkey) AS first FROM orders GROUP BY o_custkey")
def distinct_keep_first(spark, sf):
    return tables.keep_first(read(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"]).select("o_custkey", F.col("o_orderkey").alias("first"))


@register("keep_last_rows", "SELECT o_orderstatus, o_orderpriority, o_orderkey, o_custkey, round(o_totalprice, 2) + 0.0 AS o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last_rows(spark, sf):
    """The last whole order of few hot groups."""
    o = tables.keep_first(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_orderdate", "o_orderkey"], last=True)
    return rounded(o.select("o_orderstatus", "o_orderpriority", "o_orderkey", "o_custkey", "o_totalprice"), 2)


@register("unpivot_stats", "SELECT 'hi' AS k, max(c_acctbal) AS v FROM customer UNION ALL SELECT 'lo', min(c_acctbal) FROM customer")
def unpivot_stats(spark, sf):
    return tables.melt(read(spark, sf, "customer").agg(F.min("c_acctbal").alias("lo"), F.max("c_acctbal").alias("hi")), [], ["lo", "hi"], "k", "v")


@register("long_lines", f"WITH holed AS (SELECT l_orderkey AS o, l_linenumber AS i, {_HOLED} FROM lineitem), long AS ({' UNION ALL '.join(f'SELECT o, i, {chr(39)}{c}{chr(39)} AS variable, {c}::DOUBLE AS value FROM holed' for c in SIX)}) SELECT o, i, variable, round(value, 2) + 0.0 AS value FROM long")
def long_lines(spark, sf):
    """A row for each of six columns of each line."""
    key = read(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("i"), *holed_columns())
    return rounded(tables.melt(key, ["o", "i"]), 2)


@register("arg_extremes", f"{FULL} SELECT arg_min(spec, aic) AS least_aic, arg_max(spec, ll) AS most_ll FROM curve")
def arg_extremes(spark, sf):
    return flat(line_fit(spark, sf).full).agg(F.min_by("spec", "aic").alias("least_aic"), F.max_by("spec", "ll_raw").alias("most_ll"))


@register("streaming_gram_batch", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, count(*) AS n, round(sum(value * value), 3) + 0.0 AS vv FROM events GROUP BY 1")
def streaming_gram_batch(spark, sf):
    from polyspec.streaming.grams import windowed_grams

    g = windowed_grams(read(spark, sf, "events"), "ts", ["value"], "1 day", "1 hour")
    return g.select("window_start", "n", (F.round(F.get("gram", 0), 3) + 0.0).alias("vv"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
