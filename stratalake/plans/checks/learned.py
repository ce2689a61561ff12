"""Networks over lines of orders: search, control, ensemble, bottleneck residuals; graph weights and bands with SQL."""

from pyspark.sql import functions as F

from stratalake.operators import networks as N, spatial

from .numbers import ALL
from .views import read, sites

#: Rows that a fit may hold here, and its epochs.
ROWS, EPOCHS = 3000, 12
NETS = {"narrow": N.Dense((4, 8, 1)), "wide": N.Dense((4, 24, 12, 1))}
PROPERTIES = ["price", "discount", "tax", "quantity"]


def lines(s, d):
    """An order is a hole; features are scaled, the target is the quantity."""
    cells = F.array(F.col("l_extendedprice") / 5e4 - 1, F.col("l_discount") * 20 - 1, F.col("l_tax") * 25 - 1, F.col("l_linenumber") / 4.0 - 1)
    name = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return read(s, d, "lineitem").select(name.alias("id"), F.col("l_orderkey").alias("hole"), cells.alias("features"), (F.col("l_quantity") / 25 - 1).alias("target"))


def parts(s, d):
    rows = lines(s, d)
    return N.bounded_rows(rows.where("hole % 5 < 3"), most=ROWS), N.bounded_rows(rows.where("hole % 5 = 3"), most=ROWS)


def fits(s, d, **kwargs):
    return N.fit_all(s, NETS, *parts(s, d), epochs=EPOCHS, patience=4, rate=4e-3, **kwargs)


def told(f):
    return f.select("configuration", "seed", "labels", "parameters", "best_epoch", "epochs", F.round("objective", 9).alias("objective"))


def ensemble(s, d):
    held = s.createDataFrame(fits(s, d).collect(), N.FITS)  # six rows of a few hundred numbers
    name = N.chosen(held).first()["configuration"]
    weights = {r["seed"]: N.unpacked(r["weights"]) for r in held.where(F.col("configuration") == name).collect()}
    return N.ensemble(lines(s, d), NETS[name], weights, shift=25.0, scale=25.0).select("id", F.round("mean", 9).alias("mean"), F.round("spread", 9).alias("spread"))


def residuals(s, d):
    rows = lines(s, d).withColumn("features", F.concat(F.slice("features", 1, 3), F.array("target")))
    x = N.bounded_rows(rows.where("hole % 5 < 3"), most=ROWS)
    v = N.bounded_rows(rows.where("hole % 5 = 3"), most=ROWS)
    same = [N.Split(a.x, a.x[0], a.holes) for a in (x, v)]
    net = N.autoencoder(4, 2)
    held = N.fit_all(s, {"bottleneck": net}, *same, epochs=EPOCHS, patience=4, rate=4e-3).collect()
    return N.residual_summary(N.reconstruction(rows, net, {r["seed"]: N.unpacked(r["weights"]) for r in held}, PROPERTIES))[0].select("property", "n", F.round("mean", 6).alias("mean"), F.round("largest", 6).alias("largest"))


def nodes(s, d):
    near = spatial.neighbourhoods(sites(s, d), sites(s, d), 2, 8, 1500.0)
    own = near.select("target", F.col("target").alias("node"), F.col("tx").alias("x"), F.col("ty").alias("y")).distinct()
    return own.unionByName(near.select("target", F.col("id").alias("node"), "x", "y"))


QUERIES = {
    "t21_fits": lambda s, d: told(fits(s, d)),
    "t24_shuffled_control": lambda s, d: told(fits(s, d, shuffled=5)),
    "t21_ensemble": ensemble,
    "t23_residuals": residuals,
    "t22_adjacency": lambda s, d: N.normalized_adjacency(nodes(s, d), 2000.0).withColumn("weight", F.round("weight", 9)),
    "a29_residual_bands": lambda s, d: N.residual_bands(read(s, d, "lineitem").select("l_returnflag", F.col("l_quantity").alias("truth"), (F.col("l_linenumber") * 8.0).alias("mean")), ["l_returnflag"]).select("l_returnflag", "n", F.round("low", 6).alias("low"), F.round("high", 6).alias("high")),
}
ORACLES = {
    "t22_adjacency": f"""{ALL}, p AS (SELECT target, id AS node FROM near UNION SELECT target, target FROM near), n AS (SELECT p.target, p.node, s.x, s.y FROM p JOIN sites s ON s.id = p.node),
e AS (SELECT a.target, a.node AS a, b.node AS b, exp(-((a.x - b.x) ** 2 + (a.y - b.y) ** 2) / (2 * 2000.0::DOUBLE ** 2)) + CASE WHEN a.node = b.node THEN 1 ELSE 0 END AS w FROM n a JOIN n b USING (target)),
g AS (SELECT target, a, sum(w) AS own FROM e GROUP BY ALL) SELECT e.target, e.a, e.b, round(w / sqrt(g.own * h.own), 9) AS weight FROM e JOIN g ON g.target = e.target AND g.a = e.a JOIN g h ON h.target = e.target AND h.a = e.b""",
    "a29_residual_bands": "SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_quantity - l_linenumber * 8.0, 0.05), 6) AS low, round(quantile_cont(l_quantity - l_linenumber * 8.0, 0.95), 6) AS high FROM lineitem GROUP BY 1",
}
