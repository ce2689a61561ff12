"""Nested model candidates and their choice, kriging over lines, rising fits."""

from pyspark.sql import functions as F

from stratalake.operators import rising as R, spatial, structures as S
from stratalake.storage import written

from .views import read, sites

#: A quarter of the sites is held out to choose a model by.
HELD = "id % 4 = 0"


def observed(s, d):
    return sites(s, d).withColumn("value", F.col("value") / 1000)


def held_out(s, d):
    return observed(s, d).where(HELD)


def near(s, d):
    return written(spatial.neighbourhoods(held_out(s, d), observed(s, d).where(f"NOT {HELD}"), 2, 8, 1500.0))


def fits(s, d):
    found = spatial.spatial_variograms(observed(s, d).where(f"NOT {HELD}"), 300.0, 8)
    return S.fit_candidates(found.select("direction", (F.col("bin") * 300.0).alias("distance"), "pairs", "gamma"), [])


def scored(s, d, met):
    tried = written(fits(s, d))
    return S.validated(tried, S.point_kriging(met, S.fitted_models(tried)), held_out(s, d).select(F.col("id").alias("target"), F.col("value").alias("truth")))


def lines(s, d):
    """Sample intervals around every site: from 20 above to as much below, leaning east by its hole."""
    lean = F.col("hole") * 2.0
    return sites(s, d).select("id", (F.col("x") - lean).alias("x0"), F.col("y").alias("y0"), F.lit(20.0).alias("z0"), (F.col("x") + lean).alias("x1"), F.col("y").alias("y1"), F.lit(-20.0).alias("z1"))


def candidates(s, d):
    return scored(s, d, near(s, d)).select("candidate", "kind", "azimuth", "nugget", "steps", "objective", "converged", "status", "reason", "rmse", "coverage")


def supports(s, d):
    met = near(s, d)
    return S.support_variants(met, lines(s, d), lines(s, d), written(scored(s, d, met)))


RISING = """WITH p AS (SELECT l_returnflag, l_quantity AS x, sum(l_extendedprice % 997) AS s, count(*)::DOUBLE AS w FROM lineitem GROUP BY ALL),
c AS (SELECT *, sum(s) OVER o AS cs, sum(w) OVER o AS cw, row_number() OVER o AS i FROM p WINDOW o AS (PARTITION BY l_returnflag ORDER BY x)),
m AS (SELECT c.l_returnflag, c.i, c.x, c.w, j.i AS first, min((k.cs - j.cs + j.s) / (k.cw - j.cw + j.w)) AS low FROM c JOIN c j ON j.l_returnflag = c.l_returnflag AND j.i <= c.i JOIN c k ON k.l_returnflag = c.l_returnflag AND k.i >= c.i GROUP BY ALL),
f AS (SELECT l_returnflag, x, any_value(w) AS w, max(low) AS value FROM m GROUP BY ALL)
SELECT l_returnflag, min(x) AS low, max(x) AS high, round(value, 4) AS value, sum(w) AS weight FROM f GROUP BY l_returnflag, round(value, 4)"""

QUERIES = {
    "t7_candidates": candidates,
    "t15_supports": supports,
    "t17_rising_fit": lambda s, d: R.rising_fit(read(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("x"), (F.col("l_extendedprice") % 997).alias("y")), ["l_returnflag"], stretch=1000).withColumn("value", F.round("value", 4)),
}
ORACLES = {"t17_rising_fit": RISING}
