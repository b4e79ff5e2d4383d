"""Registered queries of the production-network domain and the SQL that gives the same rows.

Names are followed, in comments, by the inventory ids that a query covers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.functions import scalars as S
from loomgraph.operators import constrained, graph, gravity, joint, sampling, sectors, selection, weights
from loomgraph.plans import files
from loomgraph.sources import fixtures, text
from loomgraph.sources.bands import BANDS

FIRMS = "firms as (select p_partkey + 1 as id, 'Firm_' || (p_partkey + 1) as firm_id, cast(regexp_extract(p_brand, '[0-9]+') as bigint) as sector, p_retailprice as price from part)"
TURNOVER = f"{FIRMS}, turn as (select f.id, f.sector, coalesce(t.v, 0.0) as size from firms f left join (select l_partkey + 1 as id, sum(l_extendedprice) as v from lineitem group by 1) t using (id)), tq as (select id, sector, size, size / greatest(max(size) over (), 1.0) as q from turn)"
PRICES = f"{FIRMS}, pq as (select id, sector, price / greatest(max(price) over (), 1.0) as q from firms)"


def _pairs(firm: str = "l_partkey + 1", layer: str = "0") -> str:
    return f"pairs as (select * from (select firm as buyer, lead(firm) over (partition by l_orderkey, layer order by l_linenumber, l_partkey, l_extendedprice) as seller, l_extendedprice as amount from (select *, {layer} as layer, {firm} as firm from lineitem)) where seller is not null), edges as (select distinct buyer, seller from pairs where buyer <> seller)"


PAIRS = _pairs()
LAYERED_PAIRS = _pairs("(l_partkey + 1) * 3 + layer", "case l_returnflag when 'A' then 0 when 'R' then 2 else 1 end")
FLOWS = "flows as (select a.sector as k, b.sector as l, sum(amount) as flow from pairs join firms a on a.id = buyer join firms b on b.id = seller group by 1, 2)"
BLOCKS = "sij as (select k, l, flow, flow / max(flow) over () as s from flows), blocks as (select k, l, s, flow / sum(flow) over (partition by l) as i_share from sij where s > 1e-15 and flow > 1e-15)"
SCC = f"{LAYERED_PAIRS}, reach(a, z) as (select (p_partkey + 1) * 3 + r, (p_partkey + 1) * 3 + r from part, range(3) t(r) union select r.a, e.seller from reach r join edges e on r.z = e.buyer), comp as (select x.a as node, min(x.z) as comp from reach x join reach y on x.a = y.z and x.z = y.a group by 1)"
DAG = f"{SCC}, dag as (select distinct a.comp as src, b.comp as dst from edges join comp a on a.node = buyer join comp b on b.node = seller where a.comp <> b.comp)"
TARGET = 1000
PARAMETERS = gravity.Parameters(z=0.02)
#: Bounds of self weights of which only the one on their squares binds.
CAPPED = weights.Caps(eta1=1.0, eta2=0.0005)


def _prices(spark: SparkSession, sf: str) -> DataFrame:
    return S.max_normalised(fixtures.firms(spark, sf), "size", "q")


def _turnover(spark: SparkSession, sf: str) -> DataFrame:
    return S.max_normalised(fixtures.firms(spark, sf, "turnover"), "size", "q")


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    flows = fixtures.sector_flows(spark, sf)
    return sectors.blocks(flows, sectors.max_shares(flows))


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and edges of the three layers of line items, and component labels."""
    nodes = fixtures.layered_firms(fixtures.firms(spark, sf)).select(F.col("id").alias("node"))
    edges = graph.stored(fixtures.edges(spark, sf, layered=True).select(F.col("buyer").alias("src"), F.col("seller").alias("dst")))
    return nodes, edges, graph.stored(graph.strong_components(nodes, edges))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) + 0.0 for n in names})  # + 0.0: no negative zero


def firm_attributes(spark, sf):  # PRJ-02 PRJ-04 PRJ-06 PRJ-07 PRJ-18 PRJ-19 AG-04
    f = _turnover(spark, sf).select("id", S.digits(S.label(F.col("firm_id"))).alias("number"), "sector", "q", F.log(S.clipped(F.col("q"), S.SIZE_FLOOR, 1.0)).alias("log_q"), (F.col("id") - 1).alias("position"))
    return _rounded(f, "q", "log_q", digits=9)


def code_forms(spark, sf):  # PRJ-03 PRJ-09 PRJ-10 PRJ-08 PRJ-17
    f = fixtures.firms(spark, sf)
    n = F.col("sector").cast("string")
    f = f.select("id", S.code(F.concat(F.lit('"'), n, F.lit('.0"'))).alias("code"), S.code(F.concat(n, F.lit(".50"))).alias("kept_code"), S.custom_round(F.col("size") / 8).alias("rounded"))
    f = f.withColumn("number", S.lenient_number(F.when(F.col("id") % 3 == 0, F.lit("n/a")).when(F.col("id") % 3 == 1, F.lit("-4")).otherwise(F.col("id").cast("string"))))
    return _rounded(f.withColumn("alpha", S.boxed(S.inverse_sigmoid(F.lit(0.25)), S.ALPHA_BOX)), "alpha")


def size_band_cells(spark, sf):  # SRC-02 FLT-01 PRJ-01 AG-01 (total)
    c = sampling.cells(fixtures.firm_counts(spark, sf))
    return c.crossJoin(F.broadcast(c.agg(F.sum("n").alias("total"))))


def allocation_base(spark, sf):  # SMP-01 (whole parts and remainders)
    a = sampling.allocation(sampling.cells(fixtures.firm_counts(spark, sf)), TARGET)
    return _rounded(a.select("cell", "n", "base", "remainder", "deficit"), "remainder")


def expanded_cells(spark, sf):  # SMP-02 WIN-01 WIN-02
    drawn = sampling.sample_counts(sampling.cells(fixtures.firm_counts(spark, sf)), "ALL")
    return sampling.expanded(drawn).select("firm", "firm_id", "sic", "low", "high")


def sampled_firms(spark, sf):  # SMP-01 SMP-03 SMP-06 WIN-03
    return sampling.expanded(sampling.sample_counts(sampling.cells(fixtures.firm_counts(spark, sf)), TARGET, seed=7), seed=7)


def flow_shares(spark, sf):  # AG-02 AG-03
    flows = fixtures.sector_flows(spark, sf)
    both = sectors.max_shares(sectors.column_shares(flows))
    return _rounded(both.select("k", "l", "share", "s"), "share", "s", digits=9)


def sector_blocks(spark, sf):  # FLT-03 JN-04
    return _rounded(_blocks(spark, sf), "s", "i_share", digits=9)


def common_sector_firms(spark, sf):  # SET-01 FLT-02 JN-01 DST-03
    flows = fixtures.sector_flows(spark, sf)
    firms = fixtures.firms(spark, sf)
    found = sectors.common_sectors(firms, flows, sectors.max_shares(flows))
    kept = sectors.within_sectors(firms, found)
    return sectors.mapped(kept.select("id", "firm_id"), kept.select("firm_id", "sector")).select("id", "firm_id", "sector")


def mapping_checks(spark, sf):  # JN-02 JN-03 AG-21 FLT-06
    firms = fixtures.firms(spark, sf)
    mapping = firms.where("id % 10 <> 0").select("firm_id", F.when(F.col("id") % 7 != 0, F.col("sector")).alias("sector"))
    return sectors.aligned(firms, mapping).crossJoin(sectors.load_counts(mapping))


def sector_sizes(spark, sf):  # AG-05
    return _rounded(sectors.sector_sizes(_turnover(spark, sf)), "s_l")


def sector_inflow_balance(spark, sf):  # AG-09 JN-06 JN-07 PRJ-17
    out = sectors.inflow_balance(_turnover(spark, sf), fixtures.edges(spark, sf), sectors.incidence(fixtures.sector_flows(spark, sf)))
    return _rounded(out, "s_l", "b_l", "base_l")


def distinct_edges(spark, sf):  # DST-01 FLT-04
    return fixtures.edges(spark, sf)


def edge_text(spark, sf):  # SRC-07 SNK-02 SNK-03 PRJ-20 FLT-09
    lines = text.edge_lines(fixtures.line_pairs(spark, sf), flip=True)
    return text.edges_strict(lines.unionByName(spark.createDataFrame([("  ",)], "value string")), flip=True)


def supplier_lists(spark, sf):  # AG-12 SRT-01 SNK-04 SRC-12
    lines = text.network_lines(sectors.supplier_arrays(fixtures.edges(spark, sf)))
    return text.supplier_rows(lines).select("buyer", F.array_join(F.transform("suppliers", lambda x: x.cast("string")), ",").alias("suppliers"))


def sector_file(spark, sf):  # SNK-06 SRT-02
    f = fixtures.firms(spark, sf).select("firm_id", F.when(F.col("id") % 9 != 0, F.col("sector").cast("string")).alias("sector"))
    return text.sector_lines(f)


def firm_degrees(spark, sf):  # AG-14 GR-01 GR-02
    return sectors.firm_degrees(fixtures.firms(spark, sf), fixtures.edges(spark, sf))


def sector_edges(spark, sf):  # AG-14 AG-15
    e = fixtures.edges(spark, sf)
    return sectors.sector_edges(fixtures.firms(spark, sf), e).crossJoin(F.broadcast(sectors.node_count(e)))


def reference_checks(spark, sf):  # JN-10 DST-04 OP-09
    firms, e = fixtures.firms(spark, sf), fixtures.edges(spark, sf)
    money = firms.select("id", F.when(F.col("id") % 50 == 0, F.lit(0.0)).otherwise(F.col("size")).alias("size"))
    return sectors.reference_checks(sectors.supplier_arrays(e), money, firms.where("id % 40 <> 0").select("id", "sector"), eps0=0.04)


def firm_tolerances(spark, sf):  # JN-11 PRJ-21
    firms = fixtures.firms(spark, sf)
    deltas = firms.where("id % 4 = 0").select(F.col("id").alias("line"), "id", F.when(F.col("id") % 8 == 0, F.lit(-1.0)).otherwise(F.lit(0.25)).alias("delta"))
    return _rounded(sectors.with_tolerance(firms.select("id", "size"), deltas), "low", "high")


def block_kernel(spark, sf):  # JN-05 PRJ-11 AG-06
    return _rounded(gravity.block_sums(_prices(spark, sf), _blocks(spark, sf), PARAMETERS), *gravity.SUMS, digits=5)


def seller_inflow(spark, sf):  # AG-07 AG-20
    firms = _prices(spark, sf)
    sums = gravity.block_sums(firms, _blocks(spark, sf), PARAMETERS)
    return _rounded(gravity.band_status(sums, sectors.sector_sizes(firms), 0.5), "s_l", "e", "error", digits=5)


def expected_edges(spark, sf):  # AG-08
    return gravity.block_sums(_prices(spark, sf), _blocks(spark, sf), PARAMETERS).agg(F.round(F.sum("p"), 4).alias("expected"))


def pair_uniforms(spark, sf):  # PRJ-12
    ids = fixtures.firms(spark, sf).select((F.col("id") - 1).alias("i"))
    n = F.broadcast(ids.agg(F.count(F.lit(1)).alias("n")))
    pairs = ids.crossJoin(n).withColumn("j", F.explode(F.array(*(((F.col("i") * m + 7) % F.col("n")).alias("x") for m in (1, 3, 11))))).select("i", "j")
    return _rounded(S.with_pair_uniform(pairs, "i", "j", "u"), "u", digits=9)


def undirected_kernel(spark, sf):  # FLT-05
    return _rounded(gravity.block_sums(_prices(spark, sf), _blocks(spark, sf), PARAMETERS, undirected=True), *gravity.SUMS, digits=5)


def drawn_edges(spark, sf):  # SMP-04 FLT-07 SET-02
    return gravity.bernoulli_edges(_prices(spark, sf), _blocks(spark, sf), PARAMETERS)


def thinned_edges(spark, sf):  # SMP-04 FLT-07 without walking all pairs, on sizes that don't repeat
    return gravity.thinned_edges(_turnover(spark, sf), _blocks(spark, sf), PARAMETERS)


def pair_quota_grid(spark, sf):  # PRJ-14 PRJ-15 PRJ-16
    n = fixtures.firms(spark, sf).select(F.col("id").cast("double").alias("n"))
    k = F.greatest(F.lit(1), S.ceil_count(S.f_eta(F.col("n"), 0.05, 0.001) * F.col("n")))
    df = n.withColumn("n_keep", k).withColumn("n_draw", F.greatest("n_keep", S.ceil_count(S.g_share(F.col("n"), 0.25, 50.0, 1.0) * F.col("n"))))
    return df.select(F.col("n").cast("long").alias("n"), "n_keep", "n_draw")


def scc_labels(spark, sf):  # GR-03 GR-06
    return _graph(spark, sf)[2]


def scc_members(spark, sf):  # GR-12 AG-10 AG-11
    return graph.component_members(_graph(spark, sf)[2])


def condensation_edges(spark, sf):  # GR-04 JN-09 FLT-08 DST-02
    _, edges, comp = _graph(spark, sf)
    return graph.condensation(comp, edges)


def condensation_ends(spark, sf):  # GR-05 AG-13 AG-10
    _, edges, comp = _graph(spark, sf)
    return graph.ends_of(comp, graph.condensation(comp, edges))


def topological_levels(spark, sf):  # SRT-03
    _, edges, comp = _graph(spark, sf)
    return graph.levels(graph.component_sizes(comp), graph.stored(graph.condensation(comp, edges)))


def _pairing(spark, sf, **shares):
    nodes, edges, comp = _graph(spark, sf)
    pairs = graph.sink_source_pairs(comp, graph.stored(graph.condensation(comp, edges)))
    return nodes, edges, comp, graph.stored(graph.pair_quotas(pairs, comp, edges, **shares))


#: Shares at which every candidate of a pair is kept.
ALL_KEPT = {"theta": 0.5, "eta": 0.1}


def sink_source_pairs(spark, sf):  # GR-07 GR-08 JN-12 AG-16
    return _pairing(spark, sf, **ALL_KEPT)[3]


def chosen_candidates(spark, sf):  # GR-09 JN-08 AG-17: quotas of the default shares, which leave a choice where components are large
    nodes, edges, comp, quotas = _pairing(spark, sf)
    firms = graph.stored(fixtures.layered_firms(_turnover(spark, sf)))
    inc = graph.stored(sectors.incidence(fixtures.sector_flows(spark, sf)))
    cand = graph.stored(graph.with_delta(graph.candidates(quotas, comp, edges), firms, inc))
    balance = sectors.inflow_balance(firms, edges.select(F.col("src").alias("buyer"), F.col("dst").alias("seller")), inc)
    return _rounded(selection.choose(cand, quotas, balance)[0], "delta")


def _sector_pairs(spark, sf):
    """Sectors in the place of components: each is paired with the next, so that there are many members to draw from."""
    firms = fixtures.firms(spark, sf)
    comp = graph.stored(firms.select(F.col("id").alias("node"), F.col("sector").alias("comp")))
    edges = graph.stored(fixtures.edges(spark, sf).select(F.col("buyer").alias("src"), F.col("seller").alias("dst")))
    names = [r[0] for r in comp.select("comp").distinct().orderBy("comp").collect()]
    pairs = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(names, [*names[1:], names[0]], strict=True))], "pair long, a long, b long")
    return comp, edges, graph.stored(graph.pair_quotas(pairs, comp, edges))


def drawn_candidates(spark, sf):  # GR-09 SMP-05 SMP-06 JN-08 AG-16
    comp, edges, quotas = _sector_pairs(spark, sf)
    return graph.candidates(quotas, comp, edges).join(quotas.select("pair", "n_there", "absent", "n_keep", "n_draw"), "pair")


def sector_choice(spark, sf):  # OP-06 AG-17: each pair serves one sector, so SQL finds the optimum pair by pair
    comp, edges, quotas = _sector_pairs(spark, sf)
    firms, inc = graph.stored(_turnover(spark, sf)), graph.stored(sectors.incidence(fixtures.sector_flows(spark, sf)))
    one = quotas.withColumn("n_keep", F.lit(1).cast("long"))
    cand = graph.stored(graph.with_delta(graph.candidates(one, comp, edges), firms, inc))
    # sectors want half a unit more inflow, and so mostly not the largest candidate
    wanted = sectors.sector_sizes(firms).withColumn("base_l", F.lit(-0.5))
    return _rounded(selection.choose(cand, one, wanted, swaps=200)[0], "delta")


def joint_choice(spark, sf):  # OP-06 AG-17: every sector is served by two pairs, whose choices only count together
    firms, edges = _turnover(spark, sf), fixtures.edges(spark, sf).select(F.col("buyer").alias("src"), F.col("seller").alias("dst"))
    names = firms.select("sector").distinct().withColumn("_i", F.row_number().over(Window.orderBy("sector")) - 1)  # one row per sector
    n = names.count()
    pairs = names.select(F.col("sector").alias("b"), F.explode(F.array(F.lit(1), F.lit(2))).alias("_back"), F.col("_i")).withColumn("_i", (F.col("_i") - F.col("_back") + n) % n)
    pairs = graph.stored(pairs.join(names.withColumnRenamed("sector", "a"), "_i").select((F.col("b") * 2 + F.col("_back") - 1).alias("pair"), "a", "b"))
    first = firms.groupBy(F.col("sector").alias("b")).agg(F.min("id").alias("dst"))
    # the sector's first firm may be bought from by any firm of the pair that does not yet
    cand = pairs.join(first, "b").join(firms.select(F.col("sector").alias("a"), F.col("id").alias("src")), "a").where("src <> dst")
    # only edges to those few firms can be in the way
    cand = cand.join(edges.join(F.broadcast(first.select("dst")), "dst", "left_semi"), ["src", "dst"], "left_anti").select("pair", "src", "dst")
    cand = graph.stored(graph.with_delta(cand, firms, sectors.incidence(fixtures.sector_flows(spark, sf))))
    wanted = sectors.sector_sizes(firms).withColumn("base_l", F.lit(-1.1))
    found = joint.choose(cand, pairs.select("pair", F.lit(1).alias("n_keep")), wanted)
    y = selection._inflows(found.chosen.withColumn("x", F.lit(1.0)), wanted, "x")
    return _rounded(y.select("l", F.abs("y").alias("miss"), F.lit(found.value * 1e3).alias("value"), F.lit(found.bound * 1e3).alias("bound"), F.lit(found.gap * 1e3).alias("gap")), "miss", "value", "bound", "gap")


def irreducible_graph(spark, sf):  # GR-10 GR-11 SET-03 PRJ-13
    nodes, edges, comp, quotas = _pairing(spark, sf, **ALL_KEPT)
    chosen = graph.candidates(quotas.withColumn("n_draw", F.col("n_keep")), comp, edges)
    more = graph.augmented(nodes, edges, chosen)
    # components of the whole graph follow from those that it had: chosen edges join components
    after = graph.strong_components(comp.select(F.col("comp").alias("node")), graph.condensation(comp, edges.select("src", "dst").unionByName(chosen.select("src", "dst"))))
    before = comp.agg(F.count_distinct("comp").alias("components_before"))
    loops = more.agg(F.count(F.lit(1)).alias("n_edges"), F.count(F.when(F.col("src") == F.col("dst"), 1)).alias("self_loops"))
    return before.crossJoin(after.agg(F.count_distinct("comp").alias("components_after"))).crossJoin(loops)


def fitted_scale(spark, sf):  # OP-01 AG-08
    fit = gravity.Fit(_prices(spark, sf), _blocks(spark, sf))
    try:
        par = gravity.Parameters()
        par.z = fit.solve_scale(par) or float("nan")
        return spark.createDataFrame([(round(fit.target, 4), round(fit.links(par), 4), round(par.z, 8))], "target double, links double, z double")
    finally:
        fit.close()


def raked_factors(spark, sf):  # OP-02 OP-03
    fit = gravity.Fit(_prices(spark, sf), _blocks(spark, sf))
    try:
        par = fit.rake(PARAMETERS, steps=2)
        return spark.createDataFrame([(k, l, round(v, 8)) for (k, l), v in sorted(par.factors.items())], "k long, l long, factor double")
    finally:
        fit.close()


def model_jacobian(spark, sf):  # OP-10 PRJ-08
    fit = gravity.Fit(_prices(spark, sf), _blocks(spark, sf))
    try:
        names, r, d, blocks = fit.jacobian(PARAMETERS)
        own = [sum(c for _, at, _, c in blocks if at == i) for i in range(len(r))]  # all factors of a sector together
        rows = [(int(l), *(round(float(v), 7) + 0.0 for v in (r[i], *d[i], own[i]))) for i, l in enumerate([0, *names])]
        return spark.createDataFrame(rows, "l long, gap double, by_z double, by_alpha double, by_kappa double, by_own_factor double")
    finally:
        fit.close()


def fitted_bands(spark, sf):  # OP-03 OP-04 OP-05 SNK-08: an optimum has objective 0 and every sector in its band
    fit = gravity.Fit(_prices(spark, sf), _blocks(spark, sf))
    try:
        par, _ = fit.run()
        sums = gravity.block_sums(fit.firms, fit.blocks, par)
        links = sums.agg(F.round(F.sum("p"), 4).alias("links"))
        out = _rounded(gravity.band_status(sums, sectors.sector_sizes(fit.firms)).select("l", "s_l", "status").crossJoin(links), "s_l")
        return graph.stored(out)
    finally:
        fit.close()


def step_kernel(spark, sf):  # JN-05 AG-06: sizes that don't repeat, put together in steps of log size; bound is what that can cost a link
    blocks = _blocks(spark, sf)
    strengths = blocks.select("k", "l", F.log(PARAMETERS.z * F.pow(F.greatest("s", F.lit(S.SUPPORT_FLOOR)), F.lit(PARAMETERS.kappa))).alias("t"), F.lit(PARAMETERS.alpha).alias("alpha"))
    pairs = constrained.pair_histograms(_turnover(spark, sf), blocks)
    sums = constrained.kernel(pairs, strengths, constrained.RESOLUTION).join(blocks.select("k", "l", "i_share"), ["k", "l"])
    inflow = [(F.col("i_share") * F.col(n)).alias(n) for n in constrained.KERNEL[6:]]
    bound = F.lit(gravity.error_bound(PARAMETERS.alpha, constrained.RESOLUTION)).alias("bound")
    return _rounded(sums.select("k", "l", *constrained.KERNEL[:6], *inflow, bound), *constrained.KERNEL, "bound", digits=5)


def constrained_fit(spark, sf):  # OP-04 OP-05: each sector buys what it needs from one other, so no factor can bring the links to their target
    flows = fixtures.sector_flows(spark, sf)
    first = flows.withColumn("_r", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("flow"), "k"))).where("_r = 1").drop("_r")
    firms, blocks = graph.stored(_turnover(spark, sf)), graph.stored(sectors.blocks(first, sectors.max_shares(first)))
    found = constrained.ConstrainedFit(firms, blocks).solve(tolerance=1e-10)
    par = found.parameters
    rows = [(l, k, round(c, 6), round(found.gaps[l], 5), round(found.multipliers[l], 5) + 0.0, round(found.links, 2), found.target, round(found.objective, 6), round(par.alpha, 5), round(par.kappa, 4), round(par.z, 4), int(found.converged)) for (k, l), c in found.strengths.items()]
    return spark.createDataFrame(rows, "l long, k long, strength double, gap double, multiplier double, links double, target double, objective double, alpha double, kappa double, z double, converged int")


def _network(spark, sf):
    firms = fixtures.firms(spark, sf).withColumn("delta", F.lit(weights.Caps().firm))
    loops = firms.select(F.col("id").alias("buyer"), F.col("id").alias("seller"))
    return graph.stored(fixtures.edges(spark, sf).unionByName(loops)), firms


def weight_feasibility(spark, sf):  # OP-09: a firm in each layer, some without size, so that every check has something to find
    size = F.when((F.col("id") % 50 == 0) | (F.col("sector") == 11), 0.0).otherwise(F.col("size"))
    firms = fixtures.layered_firms(fixtures.firms(spark, sf)).withColumns({"size": size, "delta": F.when(F.col("id") % 2 == 0, 0.1).otherwise(1.0)})
    edges = fixtures.edges(spark, sf, layered=True).join(firms.where("sector <> 12").select(F.col("id").alias("seller")), "seller", "left_semi")
    return weights.feasibility(edges, firms, weights.Caps(eps0=0.2))


def edge_weights(spark, sf):  # OP-07 OP-08
    edges, firms = _network(spark, sf)
    return _rounded(weights.solve_capped(edges, firms), "weight", digits=5)


def capped_weights(spark, sf):  # OP-08 with a cap that binds, OP-07 with the bound on the energy
    edges, firms = _network(spark, sf)
    found = weights.solved_capped(edges, firms, CAPPED)
    rows = found.weights.withColumns({"energy": F.lit(found.energy), "bound": F.lit(found.bound), "gap": F.lit(found.gap), "square_price": F.lit(found.square_price)})
    return _rounded(_rounded(rows, "weight", "energy", "bound", "square_price", digits=5), "gap")


def edge_weight_residuals(spark, sf):  # AG-18 AG-19 FLT-10 SNK-08
    edges, firms = _network(spark, sf)
    out = weights.residuals(weights.solve_capped(edges, firms), firms)
    return _rounded(out, "self_sum", "self_square", "energy", digits=5).select(*(F.round(c, 7).alias(c) for c in ("row_miss", "firm_miss", "sector_miss")), "self_sum", "self_square", "energy")


QUERIES = {
    f.__name__: f
    for f in (
        firm_attributes, code_forms, size_band_cells, allocation_base, expanded_cells, sampled_firms, flow_shares, sector_blocks, common_sector_firms,
        mapping_checks, sector_sizes, sector_inflow_balance, distinct_edges, edge_text, supplier_lists, sector_file, firm_degrees, sector_edges, reference_checks,
        firm_tolerances, block_kernel, seller_inflow, expected_edges, undirected_kernel, pair_uniforms, drawn_edges, thinned_edges, pair_quota_grid, scc_labels, scc_members, condensation_edges,
        condensation_ends, topological_levels, sink_source_pairs, chosen_candidates, drawn_candidates, sector_choice, joint_choice, irreducible_graph, fitted_scale, raked_factors, model_jacobian,
        fitted_bands, step_kernel, constrained_fit, weight_feasibility, edge_weights, capped_weights, edge_weight_residuals,
    )
} | files.QUERIES

_CELLS = (
    "cells as (select row_number() over (order by length(sic), sic, band) as cell, * from ("
    + " union all ".join(f"select cast(c_nationkey as varchar) as sic, {i} as band, cast({low} as double) as low, cast({high} as double) as high, count(*) as n from orders join customer on c_custkey = o_custkey where o_totalprice * 100 between {low} and {high} group by 1" for i, (_, low, high) in enumerate(BANDS))
    + "))"
)
_X = "power(greatest(b.s, 1e-15), 0.6e0) * power(greatest(x.q, 1e-15), 0.5e0) * power(greatest(y.q, 1e-15), 0.5e0)"
_SETTING = f"{PRICES}, {PAIRS}, {FLOWS}, {BLOCKS}, sizes as (select sector as l, sum(q) as s_l from pq group by 1)"


def _sums_of(tag: str = "", factors: str = "", pair: str = "x.id <> y.id", z: float = 0.02) -> str:
    """CTEs of the kernel at z, 0.5 and 0.6: px, pr and pw by pair, sums by block. factors: a table (k, l, factor)."""
    times, more = (" * f.factor", f" join {factors} f on f.k = b.k and f.l = b.l") if factors else ("", "")
    return f"""px{tag} as (select b.k, b.l, x.id as i, y.id as j, x.q as qi, b.i_share, ln(greatest(b.s, 1e-15)) as ls, ln(x.q) + ln(y.q) as lq, {z}{times} * {_X} as v
    from pq x join blocks b on b.k = x.sector{more} join pq y on y.sector = b.l where {pair}), pr{tag} as (select *, case when v > 1e6 then 1.0 else v / (1 + v) end as p from px{tag}), pw{tag} as (select *, case when v > 1e6 then 0.0 else p * (1 - p) end as w from pr{tag}),
    sums{tag} as (select k, l, sum(p) as p, sum(w) as p_z, sum(w * lq) as p_a, sum(w * ls) as p_k, sum(w) as p_l, sum(i_share * qi * p) as e, sum(i_share * qi * w) as e_z, sum(i_share * qi * w * lq) as e_a, sum(i_share * qi * w * ls) as e_k, sum(i_share * qi * w) as e_l from pw{tag} group by k, l)"""


_STEPS = "h as (select sector, round(ln(greatest(q, 1e-15)) / 0.01)::int as bin, count(*)::double as n, sum(greatest(q, 1e-15)) as size from tq group by 1, 2)"


def _step_pairs(blocks: str) -> str:
    """CTE of pairs of firms by block and sum of their steps, a firm with itself taken off."""
    return f"""{_STEPS}, hp as (select k, l, step, sum(n) as n, sum(v) as v from (select b.k, b.l, x.bin + y.bin as step, x.n * y.n as n, x.size * y.n as v from {blocks} b join h x on x.sector = b.k join h y on y.sector = b.l
        union all select k, l, 2 * bin, -n, -size from {blocks} join h on sector = k where k = l) group by 1, 2, 3 having round(sum(n)) <> 0)"""


def _raked(tag: str, sums: str, before: str = "") -> str:
    """CTE of the factors after one raking step over block sums."""
    old = f"join {before} b using (k, l)" if before else "cross join (select 1.0e0 as factor) b"
    return f"""{tag} as (select k, l, greatest(b.factor * exp(0.5 * least(greatest(ln(s_l / sum(e) over w), -3), 3) * greatest(e_l, 0) / sum(greatest(e_l, 0)) over w), 1e-15) as factor
    from {sums} join sizes using (l) {old} window w as (partition by l))"""


_KERNEL = f"{_SETTING}, {_sums_of()}"
_M = "18446744073709551616::uhugeint"


def _uniform(i: str, j: str, seed: int = S.PAIR_SEED) -> str:
    """SQL of the pair's uniform number, in unsigned 128-bit arithmetic."""
    x = f"xor(xor((({i})::uhugeint * {S.PAIR_FACTOR}::uhugeint) % {_M}, (({j})::uhugeint * 2::uhugeint) % {_M}), {seed}::uhugeint)"
    return x


def _mixing(source: str, carry: str) -> str:
    """CTEs h1, h2, h3 over a source with column h, and u in the last."""
    return (
        f"h1 as (select {carry}, (xor(h, h // 1073741824::uhugeint) * {S.MIX_1}::uhugeint) % {_M} as h from {source}), "
        f"h2 as (select {carry}, (xor(h, h // 134217728::uhugeint) * {S.MIX_2}::uhugeint) % {_M} as h from h1), "
        f"h3 as (select {carry}, xor(h, h // 2147483648::uhugeint)::double / 18446744073709551616.0 as u from h2)"
    )


#: Shifts of the pairing are tried in turn: (shift, pair, a, b) of four shifts, and the first that makes the condensation strongly connected.
_PAIRING = f"""{DAG}, lv(comp, level) as (select distinct comp, 0 from comp union select dst, level + 1 from lv join dag on src = comp), levels as (select comp, max(level) as level from lv group by 1),
    sink as (select comp, row_number() over (order by level, comp) - 1 as n, count(*) over () as c from levels where comp not in (select src from dag)),
    source as (select comp, row_number() over (order by level, comp) - 1 as n, count(*) over () as c from levels where comp not in (select dst from dag)),
    tries as (select shift, r as pair, a.comp as a, case when b0.comp <> a.comp then b0.comp when b1.comp <> a.comp then b1.comp else b2.comp end as b
        from range(1, 5) t(shift), range((select greatest((select max(c) from sink), (select max(c) from source)))) u(r)
        join sink a on a.n = r % a.c join source b0 on b0.n = (r + shift) % b0.c join source b1 on b1.n = (r + shift + 1) % b1.c join source b2 on b2.n = (r + shift + 2) % b2.c),
    net as (select shift, src, dst from dag, range(1, 5) t(shift) union select shift, a, b from tries),
    fwd(shift, node) as (select shift, (select min(comp) from levels) from range(1, 5) t(shift) union select n.shift, n.dst from fwd f join net n on n.shift = f.shift and n.src = f.node),
    bwd(shift, node) as (select shift, (select min(comp) from levels) from range(1, 5) t(shift) union select n.shift, n.src from bwd f join net n on n.shift = f.shift and n.dst = f.node),
    good as (select min(shift) as shift from range(1, 5) t(shift) where (select count(*) from fwd where fwd.shift = t.shift) = (select count(*) from levels) and (select count(*) from bwd where bwd.shift = t.shift) = (select count(*) from levels) and not exists (select 1 from tries where tries.shift = t.shift and a = b)),
    pairing as (select pair, a, b from tries join good using (shift)), size as (select comp, count(*) as n from comp group by 1)"""


def _quotas(pairs: str, comp: str, sizes: str, edges: str, theta: str, eta: str) -> str:
    """CTE quotas over pairs (pair, a, b)."""
    return f"""there as (select a.comp as a, b.comp as b, count(*) as n_there from {edges} join {comp} a on a.node = buyer join {comp} b on b.node = seller group by 1, 2),
    q0 as (select pair, p.a, p.b, x.n as n_a, y.n as n_b, coalesce(n_there, 0) as n_there, x.n * y.n - coalesce(n_there, 0) as absent, least(x.n, y.n)::double as n
        from {pairs} p join {sizes} x on x.comp = p.a join {sizes} y on y.comp = p.b left join there t on t.a = p.a and t.b = p.b),
    q1 as (select *, greatest(1, ceil({theta} * (1 - exp(-{eta} * n)) * n)::bigint) as k from q0), q2 as (select *, least(absent, greatest(k, ceil(0.25 * (n / (50.0 + n)) * n)::bigint)) as n_draw from q1),
    quotas as (select pair, a, b, n_a, n_b, n_there, absent, least(k, n_draw) as n_keep, n_draw from q2)"""


def _drawn(members: str) -> str:
    """CTEs up to drawn (pair, src, dst), over quotas and members (comp, position, node): numbers of member pairs, in hashed order where many are wanted, else by tries."""
    return f"""tr as (select *, unnest(range(case when dense then every else n_draw * 8 + 64 end)) as t from (select pair, a, b, n_a * n_b as every, n_b, n_draw, n_draw * 4 >= n_a * n_b - n_there as dense from quotas where n_draw > 0)),
    h0 as (select pair, a, b, every, n_b, n_draw, dense, t, {_uniform("pair", "t", 12345)} as h from tr), {_mixing("h0", "pair, a, b, every, n_b, n_draw, dense, t")},
    num as (select pair, a, b, n_b, n_draw, case when dense then t else least(floor(u * every)::bigint, every - 1) end as n, min(case when dense then u else t end) as t from h3 group by 1, 2, 3, 4, 5, 6),
    got as (select pair, x.node as src, y.node as dst, n_draw, row_number() over (partition by pair order by t, n) as r from num join {members} x on x.comp = a and x.position = n // n_b + 1 join {members} y on y.comp = b and y.position = n % n_b + 1
        where x.node <> y.node and not exists (select 1 from edges where buyer = x.node and seller = y.node)), drawn as (select pair, src, dst from got where r <= n_draw)"""


#: The choice over drawn, quotas and tq: Frank-Wolfe steps (x the relaxation, z its whole-number step), then swaps of the best of them.
_CHOICE = """sized as (select sector as l, 3 * sum(q) as s_l from tq group by 1),
    inflow as (select y.sector as l, sum(x.q * case when flow > 0 then 1.0e0 else 0.0e0 end) as b_l from edges join tq x on x.id = buyer // 3 join tq y on y.id = seller // 3 join flows f on f.k = x.sector and f.l = y.sector group by 1),
    wanted as (select l, s_l, coalesce(b_l, 0) - s_l as base from sized left join inflow using (l)),
    cand as materialized (select pair, src, dst, t.sector as l, (case when flow > 0 then s.q else 0 end)::double as delta, n_keep, s_l, base, count(*) over (partition by t.sector) as of_l from drawn join quotas using (pair) join tq s on s.id = src // 3 join tq t on t.id = dst // 3 join wanted w on w.l = t.sector left join flows f on f.k = s.sector and f.l = t.sector),
    others as (select coalesce(sum(power(base / s_l, 2)), 0) as rest from wanted where l not in (select l from cand)),
    walk as (select 0 as step, pair, src, dst, l, delta, n_keep, s_l, base, of_l, rest, 0.0e0 as x, 0.0e0 as z, 0.0e0 as value, '-infinity'::double as bound, false as done from cand, others union all
        select step, pair, src, dst, l, delta, n_keep, s_l, base, of_l, rest, x, z, value, low, step > 1 and gap <= 1e-9 * greatest(1.0e0, abs(low)) from (select *, case when step > 1 then greatest(bound, now - gap) else bound end as low from (
        select *, sum(power((base + add_z) / s_l, 2) / of_l) over () + rest as value, sum(power(y / s_l, 2) / of_l) over () + rest as now, sum((x - z) * cost) over () as gap from (select *, sum(delta * z) over (partition by l) as add_z from (
        select *, (row_number() over (partition by pair order by cost, src, dst) <= n_keep)::int::double as z from (select *, 2 * y / power(s_l, 2) * delta as cost from (select *, base + sum(delta * x) over (partition by l) as y from (
        select step + 1 as step, pair, src, dst, l, delta, n_keep, s_l, base, of_l, rest, x + 2.0e0 / (step + 1) * (z - x) as x, bound from walk where step < 8 and not done)))))))),
    swapped as (select 0 as k, pair, src, dst, l, delta, s_l, base, z as x, true as moved from walk where step = (select step from walk where step > 0 group by 1 order by min(value), step limit 1) union all
        select k + 1, pair, src, dst, l, delta, s_l, base, case when not coalesce(list_contains(made, pair), false) then x when src = e.src and dst = e.dst then 0.0e0 when src = f.src and dst = f.dst then 1.0e0 else x end, made is not null from (
        select *, case when len(best) > 0 then list_reduce(list_sort(best), lambda a, b: case when list_has_any(a.used, b.used) then a else {'gain': a.gain, 'pair': a.pair, 'used': a.used || b.used, 'made': a.made || b.made} end).made end as made from (
        select *, list({'gain': f.gain, 'pair': pair, 'used': [f.l, f.e.l], 'made': [pair]}) filter (where src = f.src and dst = f.dst and pair = top.pair) over () as best from (
        select *, min(case when f.gain < -1e-12 then {'gain': f.gain, 'pair': pair} end) over (partition by f.l) as top from (
        select *, min(case when x = 0 then {'gain': e.c + (power(ye + delta, 2) - power(ye, 2)) / power(s_l, 2), 'src': src, 'dst': dst, 'l': l, 'e': e} end) over (partition by pair) as f from (select *, y - case when l = e.l then e.delta else 0 end as ye from (
        select *, min(case when x = 1 then {'c': (power(y - delta, 2) - power(y, 2)) / power(s_l, 2), 'src': src, 'dst': dst, 'l': l, 'delta': delta} end) over (partition by pair) as e from (select *, base + sum(delta * x) over (partition by l) as y from swapped where k < 20 and moved))))))))"""

_BY_SECTOR = f"""{FIRMS}, {PAIRS}, members as (select sector as comp, id as node, row_number() over (partition by sector order by id) as position from firms), size as (select comp, count(*) as n from members group by 1),
    named as (select comp, row_number() over (order by comp) - 1 as pair from size), ring as (select x.pair, x.comp as a, y.comp as b from named x join named y on y.pair = (x.pair + 1) % (select count(*) from named)),
    {_quotas("ring", "members", "size", "edges", "0.05", "0.001")}, {_drawn("members")}"""

#: Dykstra's cycles over rows, firm bands, sector bands, the sum of self weights and the box, until no constraint is missed by 1e-4.


def _weights(cap: float = 0.1, radius: str = "1e300") -> str:
    """CTEs of the projections in turn, up to `solved`; radius: the bound of the squared self weights of all firms."""
    return f"""{FIRMS}, {PAIRS}, net as (select buyer, seller from edges union all select id, id from firms), m as (select id, price as m, sector from firms),
    ed as (select buyer, seller, a.m as m, b.m as mj, b.sector as sector, (buyer = seller)::int as own, count(*) over (partition by buyer) as row_v, sum(a.m * a.m) over (partition by seller) as firm_v, sum(a.m * a.m) over (partition by b.sector) as sector_v, (select sum(m.m) from m where m.sector = b.sector) as ms,
        (select count(*) from m) * {cap}e0 as cap, {radius} as radius, sum((buyer = seller)::int) over () as n_own from net join m a on a.id = buyer join m b on b.id = seller),
    it as (select 0 as cycle, *, 0.0e0 as x, 0.0e0 as box, 0.0e0 as fp, 0.0e0 as sp, 0.0e0 as op, 0.0e0 as ball, 0.0e0 as rho, 1.0e0 as miss from ed union all
        select cycle + 1, buyer, seller, m, mj, sector, own, row_v, firm_v, sector_v, ms, cap, radius, n_own, xn, y - xn, fn, sn, onew, balln, rhon, greatest(max(fm) over (), max(sm) over (), max(abs(sum_x - 1)) over ()) from (
        select *, sum(xn) over (partition by buyer) as sum_x from (select *, greatest(0.0e0, least(1.0e0, y)) as xn from (
        select *, yb - balln + box as y from (select *, yb * own * rhon / (1 + rhon) as balln from (select *, case when norm > radius then sqrt(norm / radius) - 1 else 0 end as rhon from (select *, sum(yb * yb * own) over () as norm from (
        select *, x3 + case when own = 1 then onew - op + ball else 0 end as yb from (select *, least(0.0e0, (cap - (own_s - op * n_own)) / n_own) as onew from (select *, sum(x3 * own) over () as own_s from (
        select *, x2 + (sn - sp) * m as x3 from (select *, case when sfree < 0.9 * ms then 0.9 * ms - sfree when sfree > 1.1 * ms then 1.1 * ms - sfree else 0 end / sector_v as sn, case when ss < 0.9 * ms then 0.9 * ms - ss when ss > 1.1 * ms then ss - 1.1 * ms else 0 end / ms as sm from (select *, ss - sp * sector_v as sfree from (
        select *, sum(m * x2) over (partition by sector) as ss from (
        select *, x1 + (fn - fp) * m as x2 from (select *, case when ffree < 0.9 * mj then 0.9 * mj - ffree when ffree > 1.1 * mj then 1.1 * mj - ffree else 0 end / firm_v as fn, case when fs < 0.9 * mj then 0.9 * mj - fs when fs > 1.1 * mj then fs - 1.1 * mj else 0 end / mj as fm from (select *, fs - fp * firm_v as ffree from (
        select *, sum(m * x1) over (partition by seller) as fs from (
        select *, x + (1 - sum(x) over (partition by buyer)) / row_v as x1 from it where miss > 1e-4 and cycle < 60))))))))))))))))))),
    solved as (select * from it where cycle = (select max(cycle) from it))"""


_WEIGHTS = _weights()

_OPTIONS = (
    ("sampling", "--target-firms", "ALL"), ("sampling", "--seed", "42"), ("fit", "--mean-degree", "25.0"), ("fit", "--band", "0.1"), ("fit", "--resolution", "0.0"),
    ("irreducible", "--flip-input", "False"), ("irreducible", "--flip-output", "False"), ("irreducible", "--theta", "0.05"), ("irreducible", "--eta", "0.001"), ("irreducible", "--gamma", "0.25"),
    ("irreducible", "--n0", "50.0"), ("irreducible", "--eta-g", "1.0"), ("irreducible", "--seed", "12345"), ("irreducible", "--normalize-q", "False"), ("irreducible", "--zeta", "None"),
    ("weights", "--firm-rel", "0.1"), ("weights", "--firm-rel-file", "None"), ("weights", "--sector-rel", "0.1"), ("weights", "--eta1", "0.1"), ("weights", "--eta2", "0.1"), ("weights", "--eps0", "0.0"), ("weights", "--cycles", "60"),
)


def _values(rows, names: str) -> str:
    return f"select * from (values {', '.join('(' + ', '.join(repr(str(v)) for v in r) + ')' for r in rows)}) t({names})"


_ROUNDED = "case when floor(({0} - floor({0})) * 10) = 0 then round_even({0}, 0) else round_even({0}, 1) end"
_SAMPLED = f"""{_CELLS}, e as (select *, n * ({TARGET}.0::double / (select sum(n) from cells)) as x from cells), p as (select *, floor(x)::bigint as base, x - floor(x) as rem from e),
    w as (select *, case when (select sum(rem) from p) > 0 then rem else 1.0 end as w from p), c as (select *, sum(w) over (order by cell) as hi from w), t as (select *, (hi - w) / (select max(hi) from c) as lo_u, hi / (select max(hi) from c) as hi_u, hi = (select max(hi) from c) as top from c),
    d0 as (select i, {_uniform("i", "7")} as h from range((select {TARGET} - sum(base) from p)::bigint) r(i)), {_mixing("d0", "i").replace("h1", "d1").replace("h2", "d2").replace("h3", "d3")},
    x as (select cell, count(*) as more from d3 join t on u >= lo_u and (u < hi_u or top) group by 1), k as (select cell, sic, low, high, base + coalesce(more, 0) as draw from t left join x using (cell)),
    f as (select row_number() over (order by cell, j) as firm, sic, low, high from (select *, unnest(range(draw)) as j from k)), g0 as (select firm, sic, low, high, {_uniform("firm", "8")} as h from f),
    {_mixing("g0", "firm, sic, low, high").replace("h1", "g1").replace("h2", "g2").replace("h3", "g3")}, sampled as (select firm, 'Firm_' || firm as firm_id, sic, low, high, low + (high - low) * u as raw from g3)"""

ORACLE_SQL = {
    "firm_attributes": f"with {TURNOVER} select id, id as number, sector, round(q, 9) as q, round(ln(least(greatest(q, 1e-15), 1.0)), 9) as log_q, id - 1 as position from tq",
    "code_forms": f"with {FIRMS} select id, cast(sector as varchar) as code, sector || '.50' as kept_code, case when floor((price / 8 - floor(price / 8)) * 10) = 0 then round_even(price / 8, 0) else round_even(price / 8, 1) end as rounded, case when id % 3 = 2 then cast(id as double) else 0.0 end as number, round(0.30 + 0.65 * 0.25, 6)::double as alpha from firms",
    "size_band_cells": f"with {_CELLS} select cell, sic, band, low, high, n, (select sum(n)::bigint from cells) as total from cells",
    "allocation_base": f"with {_CELLS}, e as (select cell, n, n * ({TARGET}.0::double / (select sum(n) from cells)) as x from cells) select cell, n, floor(x)::bigint as base, round(x - floor(x), 6) as remainder, {TARGET} - sum(floor(x)::bigint) over ()::bigint as deficit from e",
    "expanded_cells": f"with {_CELLS}, r as (select cell, sic, low, high, unnest(range(n)) as k from cells), f as (select row_number() over (order by cell, k) as firm, * from r) select firm, 'Firm_' || firm as firm_id, sic, low, high from f",
    "flow_shares": f"with {FIRMS}, {PAIRS}, {FLOWS} select k, l, round(flow / sum(flow) over (partition by l), 9) as share, round(flow / max(flow) over (), 9) as s from flows",
    "sector_blocks": f"with {FIRMS}, {PAIRS}, {FLOWS}, {BLOCKS} select k, l, round(s, 9) as s, round(i_share, 9) as i_share from blocks",
    "mapping_checks": f"with {FIRMS} select count(*) as n_strength, count(*) filter (id % 10 <> 0) as n_mapping, count(*) filter (id % 10 = 0) as unmapped, 0::bigint as unsized, count(*) filter (id % 10 <> 0) as total, count(*) filter (id % 10 <> 0 and id % 7 <> 0) as kept, count(*) filter (id % 10 <> 0 and id % 7 = 0) as dropped from firms",
    "sector_sizes": f"with {TURNOVER} select sector as l, round(sum(q), 6) as s_l from tq group by 1",
    "sector_inflow_balance": f"with {TURNOVER}, {PAIRS}, {FLOWS}, s as (select sector as l, sum(q) as s_l from tq group by 1), b as (select y.sector as l, sum(x.q * case when flow > 0 then 1.0 else 0.0 end) as b_l from edges join tq x on x.id = buyer join tq y on y.id = seller join flows f on f.k = x.sector and f.l = y.sector group by 1) select s.l, round(s_l, 6) as s_l, round(coalesce(b_l, 0), 6) as b_l, round(coalesce(b_l, 0) - s_l, 6) as base_l from s left join b using (l)",
    "distinct_edges": f"with {PAIRS} select buyer, seller from edges",
    "edge_text": f"with {PAIRS} select buyer, seller from edges",
    "supplier_lists": f"with {PAIRS} select buyer, string_agg(cast(seller as varchar), ',' order by seller) as suppliers from edges group by 1",
    "sector_file": f"with {FIRMS} select id || ',' || sector as value from firms where id % 9 <> 0",
    "firm_tolerances": f"with {FIRMS}, d as (select id, price as size, case when id % 8 = 4 then 0.25 else 0.1 end::double as delta from firms) select id, size, delta, round((1 - delta) * size, 6) as low, round((1 + delta) * size, 6) as high from d",
    "block_kernel": f"with {_KERNEL} select k, l, {', '.join(f'round({s}, 5) + 0.0 as {s}' for s in gravity.SUMS)} from sums",
    "seller_inflow": f"with {_KERNEL}, e as (select l, sum(e) as e from sums group by 1), s as (select sector as l, sum(q) as s_l from pq group by 1) select l, round(e, 5) as e, round(s_l, 5) as s_l, round((e - s_l) / s_l, 5) as error, case when abs((e - s_l) / s_l) <= 0.5 + 1e-12 then 'OK' else 'VIOLATED' end as status from e join s using (l)",
    "expected_edges": f"with {_KERNEL} select round(sum(p), 4) as expected from sums",
    "drawn_edges": f"with {_KERNEL}, h0 as (select i, j, p, {_uniform('i - 1', 'j - 1')} as h from pr where p > 0), {_mixing('h0', 'i, j, p')} select i as buyer, j as seller from h3 where p >= u",
    # log1p is ln(1 - p) with its rounding taken back; skips go 10 deviations beyond their mean, which no run exceeds
    "thinned_edges": f"""with {TURNOVER}, {PAIRS}, {FLOWS}, {BLOCKS}, fa as (select *, floor(ln(a) / 0.35e0)::int as band from (select id, sector, power(greatest(q, 1e-15), 0.5e0) as a from tq)), nf as (select *, row_number() over (order by sector, band, id) - 1 as number from fa),
        cells as (select sector, band, min(number) as first, count(*) as n, max(a) as top from nf group by 1, 2), cp as (select 0.02e0 * power(greatest(s, 1e-15), 0.6e0) as c, x.top as xt, y.top as yt, x.first as xf, y.first as yf, y.n as yn, x.n * y.n as pairs, x.first * (select count(*) from nf) + y.first as cells from blocks join cells x on x.sector = k join cells y on y.sector = l),
        ct as (select *, case when c * xt * yt > 1e6 then 1.0 else c * xt * yt / (1 + c * xt * yt) end as top from cp), cl as (select *, ceil(least(pairs::double, 64.0e0 / top))::bigint as long from ct where top > 0), rn as (select *, unnest(range((pairs + long - 1) // long)) as run from cl),
        dr as (select *, unnest(range(least(long, ceil(long * top + 10 * sqrt(long * top) + 10)::bigint))) as t from rn), h0 as (select *, {_uniform("cells", "run * long + t", gravity.SKIP_SEED)} as h from dr), {_mixing("h0", "c, top, xf, yf, yn, pairs, cells, long, run, t")},
        sk as (select *, sum(case when top >= 1 then 1 else least(floor(ln(greatest(1 - u, 1e-17)) / (case when 1 - top = 1 then -top else ln(1 - top) * top / (1 - (1 - top)) end)), long::double)::bigint + 1 end) over (partition by cells, run order by t) as upto from h3),
        hit as (select c, top, xf + g // yn as i, yf + g % yn as j from (select *, run * long + upto::bigint - 1 as g from sk where upto <= long) where g < pairs), ab as (select c, top, x.id as buyer, y.id as seller, x.a as xa, y.a as ya from hit join nf x on x.number = i join nf y on y.number = j where x.id <> y.id),
        w0 as (select buyer, seller, case when c * xa * ya > 1e6 then 1.0 else c * xa * ya / (1 + c * xa * ya) end / top as share, {_uniform("buyer - 1", "seller - 1")} as h from ab), {_mixing("w0", "buyer, seller, share").replace("h1", "w1").replace("h2", "w2").replace("h3", "w3")} select buyer, seller from w3 where share > 0 and share >= u""",
    "pair_quota_grid": "with g as (select (p_partkey + 1)::double as n from part), k as (select n, greatest(1, ceil(0.05 * (1 - exp(-0.001 * n)) * n))::bigint as n_keep from g) select n::bigint as n, n_keep, greatest(n_keep, ceil(0.25 * power(n / (50.0 + n), 1.0) * n)::bigint) as n_draw from k",
    "scc_labels": f"with recursive {SCC} select node, comp from comp",
    "scc_members": f"with recursive {SCC} select comp, row_number() over (partition by comp order by node)::int as position, node from comp",
    "condensation_edges": f"with recursive {DAG} select src, dst from dag",
    "condensation_ends": f"with recursive {DAG}, z as (select comp, count(*) as size from comp group by 1), o as (select src as comp, count(*) as o from dag group by 1), i as (select dst as comp, count(*) as i from dag group by 1) select comp, size, coalesce(o, 0)::bigint as out_degree, coalesce(i, 0)::bigint as in_degree, i is null as is_source, o is null as is_sink from z left join o using (comp) left join i using (comp)",
    "topological_levels": f"with recursive {DAG}, p(comp, level) as (select distinct comp, 0 from comp union select dst, level + 1 from p join dag on src = comp) select comp, max(level) as level from p group by 1",
    "common_sector_firms": f"with {FIRMS}, {PAIRS}, {FLOWS} select id, firm_id, sector from firms where sector in (select k from flows) and sector in (select l from flows)",
    "firm_degrees": f"with {FIRMS}, {PAIRS} select id, coalesce(o, 0)::bigint as out_degree, coalesce(i, 0)::bigint as in_degree from firms left join (select buyer as id, count(*) as o from edges group by 1) using (id) left join (select seller as id, count(*) as i from edges group by 1) using (id)",
    "sector_edges": f"with {FIRMS}, {PAIRS} select sector as l, count(*) as n_edges, (select count(distinct id) from (select buyer as id from edges union all select seller from edges)) as n_nodes from edges join firms on id = seller group by 1",
    "reference_checks": f"""with {FIRMS}, {PAIRS}, nodes as (select buyer as id from edges union select seller from edges) select * from (values
        ('duplicate_buyer', 0::bigint), ('no_supplier', 0::bigint), ('node_without_row', (select count(*) from nodes where id not in (select buyer from edges))),
        ('buyer_without_sector', (select count(distinct buyer) from edges where buyer % 40 = 0)), ('size_not_positive', (select count(*) from nodes where id % 50 = 0)),
        ('id_above_network', (select count(*) from firms where id > (select max(id) from nodes))), ('weights_above_one', (select count(*) from (select buyer from edges group by 1 having count(*) * 0.04e0 > 1)))) t("check", violations)""",
    "pair_uniforms": f"with ij as (select p_partkey as i, unnest([(p_partkey + 7) % n, (p_partkey * 3 + 7) % n, (p_partkey * 11 + 7) % n]) as j from part, (select count(*) as n from part)), h0 as (select i, j, {_uniform('i', 'j')} as h from ij), {_mixing('h0', 'i, j')} select i, j, round(u, 9) as u from h3",
    "undirected_kernel": f"with {_SETTING}, {_sums_of(pair='y.id > x.id')} select k, l, {', '.join(f'round({s}, 5) + 0.0 as {s}' for s in gravity.SUMS)} from sums",
    "sampled_firms": f"with {_SAMPLED} select firm, firm_id, sic, low, high, {_ROUNDED.format('raw')} as size from sampled",
    "sampling_stage": f"with {_SAMPLED} select firm_id, sic, {_ROUNDED.format('raw')} as size from sampled",
    "firm_count_file": f"with {_CELLS} select cell, sic, band, low, high, n from cells",
    "firm_sheet": f"with {FIRMS} select firm_id, cast(sector as varchar) as sic, price as size from firms",
    "sheet_matrix": f"with {FIRMS}, {PAIRS}, {FLOWS}, s as (select distinct sector from firms) select cast(a.sector as varchar) as k, cast(b.sector as varchar) as l, coalesce(round(flow, 2), 0.0) as value from s a cross join s b left join flows on k = a.sector and l = b.sector",
    "text_matrix": f"with {FIRMS}, {PAIRS}, {FLOWS}, s as (select distinct sector from firms where sector < (select max(sector) from firms)) select 'S;' || a.sector as k, 'S;' || b.sector as l, case when a.sector = b.sector then 0.0 else coalesce(round(flow, 2), 0.0) end as value from s a cross join s b left join flows on k = a.sector and l = b.sector",
    "edge_file": f"with {PAIRS} select buyer, seller from pairs",
    "strength_file": f"with {FIRMS} select firm_id, case when id % 5 = 0 or id % 7 = 0 then 0.0 else price end as size from firms",
    "mapping_file": f"with {FIRMS} select firm_id, cast(sector as varchar) as sic from firms",
    "money_file": f"with {FIRMS} select id, case when id % 6 = 0 then 0.0 when id % 3 = 0 then 7.25 else price end as size from firms where id <= (select max(id) - 50 from firms)",
    "sector_codes": f"with {FIRMS} select id, case when id % 3 = 0 then sector + 100 else sector end as sector, (select count(distinct sector) from (select sector from firms union all select sector + 100 from firms where id % 3 = 0)) as n_sectors from firms",
    "tolerance_file": f"with {FIRMS} select id, case when id % 8 = 4 then 0.25 else 0.1 end::double as delta, 0.1::double as without_file from firms",
    "weights_file": f"with {PAIRS} select buyer, seller, 1.0::double / count(*) over (partition by buyer) as weight from edges",
    "missing_files": _values((("error", "failed"), ("skip", "skipped")), "policy, outcome"),
    "stage_options": _values(_OPTIONS, "stage, option, value"),
    "refused_options": _values(((*r, "refused") for r in files.REFUSED), "stage, option, value, outcome"),
    "sink_source_pairs": f"with recursive {_PAIRING}, {_quotas('pairing', 'comp', 'size', 'edges', '0.5', '0.1')} select * from quotas",
    "chosen_candidates": f"""with recursive {_PAIRING}, {_quotas('pairing', 'comp', 'size', 'edges', '0.05', '0.001')}, members as (select comp, node, row_number() over (partition by comp order by node) as position from comp), {_drawn('members')},
        {TURNOVER}, {_pairs().replace("pairs as", "all_pairs as").replace("edges as", "all_edges as").replace("from pairs", "from all_pairs")}, {FLOWS.replace("from pairs", "from all_pairs")}, {_CHOICE}
        select pair, src, dst, l, round(delta, 6) as delta from swapped where k = (select max(k) from swapped) and x = 1""",
    "drawn_candidates": f"with {_BY_SECTOR} select pair, src, dst, n_there, absent, n_keep, n_draw from drawn join quotas using (pair)",
    "sector_choice": f"""with {_BY_SECTOR}, {TURNOVER.replace(FIRMS + ", ", "")}, {FLOWS}, d as (select pair, src, dst, t.sector as l, case when flow > 0 then s.q else 0.0 end as delta from drawn join tq s on s.id = src join tq t on t.id = dst left join flows on k = s.sector and l = t.sector)
        select pair, src, dst, l, round(delta, 6) as delta from d qualify row_number() over (partition by pair order by power(delta - 0.5, 2), src, dst) = 1""",
    "irreducible_graph": f"""with recursive {_PAIRING}, {_quotas('pairing', 'comp', 'size', 'edges', '0.5', '0.1')}, reached as (select count(*) as n from (select node from fwd join good using (shift)))
        select (select count(*) from size) as components_before, case when (select n from reached) = (select count(*) from size) then 1 end::bigint as components_after, ((select count(*) from edges) + (select sum(n_keep) from quotas) + 3 * (select count(*) from part))::bigint as n_edges, 3 * (select count(*) from part) as self_loops""",
    "fitted_scale": f"""with recursive {_SETTING}, {_sums_of(z=1.0)}, v as materialized (select v, count(*) as n from px group by 1), step(k, z, f, slope) as (select 0, 1.0e0, sum(n * v / (1 + v)) - (select count(*) * 25 from part), sum(n * v / power(1 + v, 2)) from v union all
        select k + 1, nz, sum(n * nz * v / (1 + nz * v)) - (select count(*) * 25 from part), sum(n * nz * v / power(1 + nz * v, 2)) from (select k, z * exp(greatest(-3.0, least(3.0, -f / slope))) as nz from step where k < 14 and abs(f) > 1e-6), v group by k, nz)
        select (select count(*) * 25.0::double from part) as target, round(f + (select count(*) * 25.0::double from part), 4) as links, round(z, 8) as z from step order by k desc limit 1""",
    "raked_factors": f"with {_KERNEL}, {_raked('f1', 'sums')}, {_sums_of('2', 'f1')}, {_raked('f2', 'sums2', 'f1')} select k, l, round(factor, 8) as factor from f2",
    "model_jacobian": f"""with {_KERNEL}, box as (select (0.5e0 - 0.3) * (0.95 - 0.5e0) / 0.65 as a, (0.6e0 - 0.3) * (0.9 - 0.6e0) / 0.6 as k), n as (select count(*) * 25.0e0 as t from part)
        select 0::bigint as l, round(sum(p) / t - 1, 7) as gap, round(sum(p_z) / t, 7) as by_z, round(sum(p_a) / t * any_value(box.a), 7) as by_alpha, round(sum(p_k) / t * any_value(box.k), 7) as by_kappa, 0.0::double as by_own_factor from sums, box, n group by t
        union all select l, round(sum(e) / s_l - 1, 7), round(sum(e_z) / s_l, 7), round(sum(e_a) / s_l * any_value(box.a), 7), round(sum(e_k) / s_l * any_value(box.k), 7), round(sum(e_l) / s_l, 7) from sums join sizes using (l), box group by l, s_l""",
    "fitted_bands": f"with {_SETTING} select l, round(s_l, 6) as s_l, 'OK' as status, (select count(*) * 25.0::double from part) as links from sizes",
    "weight_feasibility": f"""with {FIRMS}, {LAYERED_PAIRS}, f as (select id, sector, case when id % 50 = 0 or sector = 11 then 0.0 else price end as size, case when id % 2 = 0 then 0.1 else 1.0 end as delta from (select id * 3 + r as id, sector, price from firms, range(3) t(r))), net as (select buyer, seller from edges join f on id = seller where sector <> 12)
        select * from (values ('degree_times_floor', (select count(*) from (select buyer from net group by 1 having count(*) * 0.2e0 > 1))), ('no_inflow', (select count(*) from f where delta < 1 and id not in (select seller from net))),
        ('sector_without_edges', (select count(distinct sector) from f where sector not in (select sector from net join f on id = seller))), ('sector_size_not_positive', (select count(*) from (select sector from f group by 1 having sum(size) <= 0)))) t("check", violations)""",
    "edge_weights": f"with recursive {_WEIGHTS} select buyer, seller, round(x, 5) + 0.0 as weight from solved",
    # the bound: the energy's least value under the multipliers, worked out from what the sets have pulled
    "capped_weights": f"""with recursive {_weights(1.0, "(select count(*) from m) * 0.0005e0")}, pulls as (select *, x + ball + box as pull, x + ball + box - (fp + sp) * m - op * own as rp, 1 + rho * own as cost from solved), least_of as (select *, greatest(0, least(1, pull / cost)) as best from pulls),
        priced(v) as (select sum(cost * best * best / 2 - pull * best + rp / row_v) from least_of union all select sum(fp * mj * case when fp > 0 then 0.9e0 else 1.1e0 end) from (select distinct seller, fp, mj from solved)
        union all select sum(sp * ms * case when sp > 0 then 0.9e0 else 1.1e0 end) from (select distinct sector, sp, ms from solved) union all select any_value(op * cap - rho * radius / 2) from solved), en as (select sum(x * x / 2) as energy, (select sum(v) from priced) as bound, any_value(rho) as rho from solved)
        select buyer, seller, round(x, 5) + 0.0 as weight, round(energy, 5) as energy, round(bound, 5) as bound, round(abs(energy - bound) / energy, 6) as gap, round(en.rho, 5) as square_price from solved, en""",
    "edge_weight_residuals": f"""with recursive {_WEIGHTS}, fr as (select seller, sum(m * x) as s, any_value(mj) as b from solved group by 1), sr as (select sector, sum(m * x) as s, any_value(ms) as b from solved group by 1)
        select round((select max(abs(d)) from (select sum(x) - 1 as d from solved group by buyer)), 7) as row_miss, round((select max(greatest(0.9 * b - s, s - 1.1 * b, 0) / b) from fr), 7) as firm_miss, round((select max(greatest(0.9 * b - s, s - 1.1 * b, 0) / b) from sr), 7) as sector_miss,
        round(sum(x * own), 5) as self_sum, round(sum(x * x * own), 5) as self_square, round(sum(x * x), 5) as energy from solved""",
    "step_kernel": f"""with {TURNOVER}, {PAIRS}, {FLOWS}, {BLOCKS}, {_step_pairs("blocks")}, px as (select *, 0.02e0 * power(greatest(s, 1e-15), 0.6e0) * exp(0.5e0 * step * 0.01e0) as x, step * 0.01e0 as g from hp join blocks using (k, l)), pw as (select *, x / (1 + x) as p, x / power(1 + x, 2) as w, x / power(1 + x, 2) * (1 - x) / (1 + x) as w2 from px)
        select k, l, {", ".join(f"round(sum({of} * {t}), 5) + 0.0 as {name}" for of, names in (("n", "p w wl w2 w2l w2ll"), ("i_share * v", "e f fl f2 f2l f2ll")) for t, name in zip(("p", "w", "w * g", "w2", "w2 * g", "w2 * g * g"), names.split(), strict=True))}, round(exp(0.005e0) - 1, 5) as bound from pw group by k, l""",
    # the optimum: links fall short, so every inflow stands at the upper end of its band and alpha at the lower end of its box; strengths follow by halving
    "constrained_fit": f"""with recursive {TURNOVER}, {PAIRS}, {FLOWS}, one as (select k, l, flow, flow / max(flow) over () as s from (select * from flows qualify row_number() over (partition by l order by flow desc, k) = 1)), {_step_pairs("one")}, size_of as (select sector as l, sum(greatest(q, 1e-15)) as s_l from tq group by 1),
        b(i, l, low, high) as (select 0, l, -60.0e0, 60.0e0 from one union all select i + 1, l, case when e < 1.1e0 * s_l then (low + high) / 2 else low end, case when e < 1.1e0 * s_l then high else (low + high) / 2 end
            from (select i, b.l, low, high, sum(v / (1 + exp(-((low + high) / 2 + 0.3e0 * 0.01e0 * step)))) as e from b join hp on hp.l = b.l where i < 60 group by i, b.l, low, high) join size_of using (l)),
        t as (select l, (low + high) / 2 as t from b where i = 60), x as (select hp.*, t, exp(t + 0.3e0 * 0.01e0 * step) as x from hp join t using (l)), r as (select k, l, any_value(t) as t, sum(n * x / (1 + x)) as p, sum(n * x / power(1 + x, 2)) as w, sum(v * x / power(1 + x, 2)) as f from x group by 1, 2),
        g as (select sum(p) as links, (select count(*) * 25.0e0 from part) as target from r), sp as (select l, ln(greatest(s, 1e-15)) as ls from one), q as (select greatest(0.3e0, least(0.9e0, regr_slope(t, ls))) as kappa from r join sp using (l)), zz as (select exp(avg(t - kappa * ls)) as z from r join sp using (l), q)
        select l, k, round(exp(t), 6) as strength, 0.1::double as gap, round(-2 * (links / target - 1) / target * w / (f / s_l), 5) as multiplier, round(links, 2) as links, target, round(power(links / target - 1, 2), 6) as objective, 0.3::double as alpha, round(kappa, 4) as kappa, round(z, 4) as z, 1 as converged from r join size_of using (l), g, q, zz""",
    # all choices of the two pairs of a sector are tried; the relaxation can give it any inflow between the least and the largest
    "joint_choice": f"""with {TURNOVER}, {PAIRS}, {FLOWS}, nm as (select sector, row_number() over (order by sector) - 1 as i, count(*) over () as n from (select distinct sector from tq)), pr as (select b.sector * 2 + back - 1 as pair, a.sector as a, b.sector as b from nm b, (values (1), (2)) t(back) join nm a on a.i = (b.i - back + b.n) % b.n),
        c as (select pair, b as l, case when flow > 0 then f.q else 0.0 end as delta from pr join (select sector, min(id) as dst from tq group by 1) d on d.sector = b join tq f on f.sector = a and f.id <> dst left join flows on k = a and flows.l = b where not exists (select 1 from edges where buyer = f.id and seller = dst)),
        s as (select sector as l, sum(greatest(q, 0)) as s_l from tq group by 1), m as (select x.l, min(abs(x.delta + y.delta - 1.1e0)) as miss, min(x.delta + y.delta) as low, max(x.delta + y.delta) as high from c x join c y on x.l = y.l and x.pair < y.pair group by 1),
        v as (select sum(power(miss / s_l, 2)) * 1e3 as value, sum(power(greatest(low - 1.1e0, 1.1e0 - high, 0) / s_l, 2)) * 1e3 as bound from m join s using (l))
        select l, round(miss, 6) + 0.0 as miss, round(value, 6) + 0.0 as value, round(bound, 6) + 0.0 as bound, round(value - bound, 6) + 0.0 as gap from m, v""",
}
