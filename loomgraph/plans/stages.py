"""The five stages from files to files: sampling, fitting, irreducibility, inputs of the weights, weights.

Tables may be .xlsx or delimited text. Parameters are keyword arguments with the usual defaults; the
command line (python -m loomgraph STAGE --help) passes them on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.lineage import stored
from loomgraph.operators import constrained, graph, gravity, joint, sampling, sectors, weights
from loomgraph.sources import text, xlsx


def _table(spark: SparkSession, path: str) -> DataFrame:
    text.exists(spark, path)
    return xlsx.read_table(spark, path) if path.lower().endswith(".xlsx") else text.read_table(spark, path)


def _matrix(spark: SparkSession, path: str) -> DataFrame:
    text.exists(spark, path)
    df = xlsx.read_matrix(spark, path) if path.lower().endswith(".xlsx") else text.read_matrix(spark, path)
    return df.select(S.code(F.col("k")).alias("k"), S.code(F.col("l")).alias("l"), "value")


def _save(df: DataFrame, path: str) -> None:
    (xlsx.write_table if path.lower().endswith(".xlsx") else text.write_table)(df, path)


def _strength(spark: SparkSession, path: str) -> DataFrame:
    df = _table(spark, path)
    return df.select(S.label(F.col(text.resolve(df.columns, text.FIRM_ALIASES))).alias("firm_id"), S.lenient_number(F.col(text.resolve(df.columns, text.SIZE_ALIASES))).alias("size"))


def _mapping(spark: SparkSession, path: str) -> DataFrame:
    df = _table(spark, path)
    return df.select(S.label(F.col(text.resolve(df.columns, text.FIRM_ALIASES))).alias("firm_id"), S.code(F.col(text.resolve(df.columns, text.SECTOR_ALIASES))).alias("sector"))


def _numbered(strength: DataFrame, mapping: DataFrame) -> DataFrame:
    """(id, firm_id, sector, size): firms of both tables; ids are the digits of firm ids."""
    return sectors.mapped(strength, mapping).withColumn("id", S.digits(F.col("firm_id")))


def sample(spark: SparkSession, input_file: str, mapping_out: str, strength_out: str, target_firms: str = "ALL", seed: int = 42) -> int:
    """Draws firms from a count table and writes mapping and strength; the number of firms."""
    counts = _table(spark, input_file)
    target = "ALL" if str(target_firms).upper() == "ALL" else int(target_firms)
    if target != "ALL" and target <= 0:
        raise ValueError("the number of firms must be positive, or ALL")
    firms = stored(sampling.expanded(sampling.sample_counts(sampling.cells(counts), target, seed), seed))
    ordered = firms.orderBy("firm")
    _save(ordered.select(F.col("firm_id").alias("Firm_ID"), F.col("sic").alias("SIC")), mapping_out)
    _save(ordered.select(F.col("firm_id").alias("Firm_ID"), F.col("size").alias("Size")), strength_out)
    return firms.count()


def fit(spark: SparkSession, mapping: str, strength: str, iot: str, sij: str, edges_out: str, mean_degree: float = gravity.MEAN_DEGREE, band: float = gravity.BAND, resolution: float = 0.0, report_out: str = "") -> tuple[gravity.Parameters, int]:
    """Fits the gravity model, draws edges and writes them; the parameters and the number of sectors out of their band. A resolution above 0 puts sizes together in steps of log size.

    Where the target can't be met within the bands, the bands hold and the links come as near to it as they can. report_out takes a table
    (name, value) of the parameters, the links and objective, the condition of the optimum, and each sector's relative gap, multiplier and status.
    """
    if mean_degree <= 0 or band <= 0 or resolution < 0:
        raise ValueError("degree and band must be positive, the resolution not negative")
    flows = _matrix(spark, iot).withColumnRenamed("value", "flow")
    shares = _matrix(spark, sij).withColumnRenamed("value", "s")
    found = _mapping(spark, mapping)
    common = stored(sectors.common_sectors(found, flows, shares))
    if common.isEmpty():
        raise ValueError("the tables have no sector in common")
    firms = _numbered(_strength(spark, strength), sectors.within_sectors(found, common))
    firms = stored(S.max_normalised(firms, "size", "q"))
    within = lambda t: t.join(common.select(F.col("sector").alias("k")), "k", "left_semi").join(common.select(F.col("sector").alias("l")), "l", "left_semi")
    blocks = stored(sectors.blocks(within(flows), within(shares)))
    model = gravity.Fit(firms, blocks, degree=mean_degree, band=band, resolution=resolution or None)
    try:
        par, violated = model.run(steps=0)  # what factors alone don't reach is left to the constrained fit
        best = None
        if violated:
            best = constrained.ConstrainedFit(firms, blocks, degree=mean_degree, band=band, resolution=resolution or constrained.RESOLUTION).solve()
            par, violated = best.parameters, model.violations(best.parameters)
        if report_out:
            _report(spark, model, par, best, report_out)
    finally:
        model.close()
    text.write_lines(text.edge_lines(gravity.bernoulli_edges(firms, blocks, par)), edges_out)
    return par, violated


def _report(spark: SparkSession, model: gravity.Fit, par: gravity.Parameters, best: constrained.Report | None, path: str) -> None:
    links, factors = model.links(par), list(par.factors.values()) or [1.0]
    rows = [("z", par.z), ("alpha", par.alpha), ("kappa", par.kappa), ("factor_min", min(factors)), ("factor_max", max(factors)), ("links", links), ("target", model.target), ("gap", links - model.target), ("objective", model.objective(par))]
    # where the links meet their target within the bands, the objective is 0 and so are gradient and multipliers
    rows += [("kkt", best.kkt), ("iterations", best.iterations), ("evaluations", best.evaluations)] if best else [("kkt", abs(2 * (links / model.target - 1))), ("evaluations", model.evaluations)]
    out = [(k, repr(float(v))) for k, v in rows]
    for l, g in sorted(model.gaps(par).items()):
        out += [(f"sector {l} gap", repr(float(g))), (f"sector {l} multiplier", repr(float(best.multipliers.get(l, 0.0) if best else 0.0))), (f"sector {l} status", "OK" if abs(g) <= model.band + 1e-12 else "VIOLATED")]
    text.write_table(spark.createDataFrame(out, "name string, value string").coalesce(1), path)


def make_irreducible(
    spark: SparkSession, edges: str, strength: str, mapping: str, iot: str, edges_out: str, flip_input: bool = False, flip_output: bool = False,
    theta: float = 0.05, eta: float = 0.001, gamma: float = 0.25, n0: float = 50.0, eta_g: float = 1.0, seed: int = 12345, normalize_q: bool = False, zeta: float | None = None, report_out: str = "",
) -> tuple[int, int]:
    """Adds edges between components and self-loops, and writes the graph; components before and after.

    report_out takes a table (name, value): components, edges, pairs, quotas, and the choice's value and lower bound.
    """
    if not 0 < theta < 1:
        raise ValueError("theta must lie between 0 and 1")
    if min(eta, gamma, n0, eta_g) <= 0:
        raise ValueError("eta, gamma, n0 and eta_g must be positive")
    if zeta is not None:
        print("zeta is no longer used; eta_g takes its place")
    s, m = _strength(spark, strength), _mapping(spark, mapping)
    odd = sectors.aligned(s, m).first()
    if odd["unmapped"] or odd["unsized"]:
        raise ValueError(f"strength and mapping differ: {odd['unmapped']} firms without sector, {odd['unsized']} without size")
    firms = stored(S.max_normalised(_numbered(s, m), "size", "q", "positive" if normalize_q else "off"))
    n = firms.agg(F.max("id")).first()[0]
    e = stored(text.read_edges(spark, edges, strict=True, n=n, flip=flip_input).select(F.col("buyer").alias("src"), F.col("seller").alias("dst")))
    nodes = firms.select(F.col("id").alias("node"))
    comp = stored(graph.strong_components(nodes, e))
    before = comp.select("comp").distinct().count()
    chosen, found, counts = e.limit(0), None, {"pairs": 0, "candidates": 0, "to_keep": 0}
    if before > 1:
        inc = _matrix(spark, iot).select("k", "l", (F.col("value") > 0).cast("double").alias("w"))
        pairs = graph.sink_source_pairs(comp, stored(graph.condensation(comp, e)))
        quotas = stored(graph.pair_quotas(pairs, comp, e, theta, eta, gamma, n0, eta_g))
        cand = stored(graph.with_delta(graph.candidates(quotas, comp, e, seed), firms, inc))
        balance = sectors.inflow_balance(firms, e.select(F.col("src").alias("buyer"), F.col("dst").alias("seller")), inc)
        found = joint.choose(cand, quotas, balance)
        chosen = stored(found.chosen)
        row = quotas.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n_draw").alias("candidates"), F.sum("n_keep").alias("to_keep")).first()
        counts = row.asDict()
    more = stored(graph.augmented(nodes, e, chosen))
    text.write_lines(text.edge_lines(more.select(F.col("src").alias("buyer"), F.col("dst").alias("seller")), flip_output), edges_out)
    after = graph.strong_components(nodes, more).select("comp").distinct().count()
    if report_out:
        rows = {"components_before": before, "components_after": after, "edges_before": e.count(), "edges_added": chosen.count(), "self_loops": n, **counts}
        if found:
            rows |= {"objective": found.value, "lower_bound": found.bound, "gap": found.gap, "rankings": found.rankings, "exchanges": found.exchanges, "search_ended": int(found.ended)}
        text.write_table(spark.createDataFrame([(k, repr(v)) for k, v in rows.items()], "name string, value string").coalesce(1), report_out)
    return before, after


def weight_inputs(spark: SparkSession, edges: str, strength: str, mapping: str, network_out: str, money_out: str, sector_out: str) -> list[str]:
    """Writes the three files of the last stage; an input that is missing is reported and its file left out."""
    done = []
    if text.exists(spark, edges, "skip"):
        text.write_lines(text.network_lines(sectors.supplier_arrays(text.read_edges(spark, edges))), network_out)
        done.append(network_out)
    if text.exists(spark, strength, "skip"):
        text.write_lines(text.money_lines(_strength(spark, strength)), money_out)
        done.append(money_out)
    if text.exists(spark, mapping, "skip"):
        text.write_lines(text.sector_lines(_mapping(spark, mapping)), sector_out)
        done.append(sector_out)
    return done


def solve_weights(
    spark: SparkSession, network: str, money: str, sector: str, weights_out: str, firm_rel: float = 0.10, firm_rel_file: str | None = None, sector_rel: float = 0.10,
    eta1: float = 0.10, eta2: float = 0.10, eps0: float = 0.0, cycles: int = 60,
) -> dict:
    """Solves for edge weights and writes them; what the constraints miss. Inputs that contradict each other are errors."""
    caps = weights.Caps(firm_rel, sector_rel, eta1, eta2, eps0)
    rows, sizes = stored(text.read_network(spark, network)), stored(text.read_money(spark, money))
    of = stored(text.read_sectors(spark, sector)[0])
    bad = {r["check"]: r["violations"] for r in sectors.reference_checks(rows, sizes, of, eps0).collect() if r["violations"]}
    if bad:
        raise ValueError(f"inputs don't fit together: {bad}")
    nodes = rows.select(F.col("buyer").alias("id"))
    firms = sectors.with_tolerance(sizes.join(nodes, "id", "left_semi").join(of, "id"), text.read_deltas(spark, firm_rel_file), firm_rel)
    firms = stored(firms.select("id", "size", "sector", "delta"))
    edges = stored(rows.select("buyer", F.explode("suppliers").alias("seller")))
    w = stored(weights.solve_capped(edges, firms, caps, cycles))
    text.write_weights(w, weights_out)
    return weights.residuals(w, firms, caps).first().asDict()
