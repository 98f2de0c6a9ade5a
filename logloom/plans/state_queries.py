"""Queries over states: as-of lookups, lineage, ranges, slots and lifecycle."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ranges as R
from ..functions import states as S
from ..operators import asof, cfg, diagnose, graph, intervals, select, states
from . import projections as P
from .text_queries import _CLASSIFIED, _is_error


def _points(spark, d):
    """Errors as instructions at which the latest state of their register is wanted."""
    return P.states(spark, d).where("event_type = 'error'").select(F.col("event_id").alias("point_id"), "log_id", "log_line", "pc", "reg")


def asof_reg_before(spark, d):
    s = P.states(spark, d)
    state = F.struct("event_id", "reg_type")
    return asof.latest_bounded(_points(spark, d), s, ["log_id", "reg"], state, bits=6).select("point_id", "log_id", F.col("value.event_id").alias("state_id"), F.col("value.reg_type").alias("reg_type"))


def asof_at_or_before(spark, d):
    s = P.states(spark, d)
    found = asof.latest(_points(spark, d), s, ["log_id", "reg"], "log_line", F.col("event_id"), inclusive=True, where=F.col("event_type") != "error", name="state_id")
    return found.select("point_id", "log_id", "state_id")


def asof_call_arg_fallback(spark, d):
    """The latest state of r1 of the same frame before a call; failing that, of any frame."""
    s = P.states(spark, d).where("reg = 1")
    p = P.states(spark, d).where("event_type = 'signup'").select(F.col("event_id").alias("point_id"), "log_id", "log_line", "frame")
    near = asof.latest(p, s, ["log_id", "frame"], "log_line", F.col("event_id"), name="near")
    return asof.latest(near, s, ["log_id"], "log_line", F.col("event_id"), name="far").select("point_id", F.coalesce("near", "far").alias("state_id"))


def ptr_to_scalar_transition(spark, d):
    pointer = ~F.col("reg_type").isin("scalar", "fp")
    return asof.lost_pointers(P.states(spark, d), pointer, F.col("reg_type") == "scalar").select("log_id", "reg", "log_line", "pc", "pointer_type")


def latest_unsafe_scalar(spark, d):
    v = F.floor("value").cast("long")
    u64 = "decimal(20,0)"
    bounds = F.struct("reg_type", F.lit(None).cast(u64).alias("exact"), (v - 20).alias("smin"), F.when(F.col("event_id") % 3 != 0, v).cast(u64).alias("umin"), (v * 100_000_000).cast(u64).alias("umax"), v.alias("smax"), F.lit(None).cast("int").alias("off"), F.lit(8).alias("map_value_size"))
    return asof.latest_where(P.states(spark, d), ["log_id", "reg"], R.unsafe_state(bounds), "event_id")


def latest_nullable(spark, d):
    return asof.latest_where(P.states(spark, d), ["log_id"], F.col("reg_type").contains("_or_null"), "reg")


def path_snapshot_locf(spark, d):
    out = asof.path_snapshots(P.states(spark, d), F.col("kind").isin(0, 1), "reg", "event_id")
    return out.select("log_id", F.col("segment").cast("long").alias("segment"), "reg", "event_id", "log_line")


def known_constant_agreement(spark, d):
    s = P.states(spark, d).withColumn("v", F.when(F.col("reg_type") == "scalar", (F.col("event_id") % 2)))
    return asof.agreed(s, ["log_id", "pc"], "v")


def dead_sites(spark, d):
    return asof.dead_sites(P.states(spark, d), ["log_id", "pc"], F.col("kind") == 3)


def packet_lineage_range(spark, d):
    """The widest value that each unbroken run of packet states of a register has proven."""
    runs = asof.segments_by_change(P.states(spark, d), "reg_type", ["log_id", "reg"], ["log_line"])
    runs = runs.where("reg_type = 'pkt'").groupBy("log_id", "reg", "segment").agg(F.max("value").alias("widest"), F.count("*").alias("n"))
    return runs.select("log_id", "reg", F.col("segment").cast("long").alias("segment"), "widest", "n")


def lock_depth_running(spark, d):
    step = F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0)
    return asof.floored_depth(P.states(spark, d), step, ["log_id"], ["log_line"]).select("log_id", "log_line", F.col("depth").cast("long").alias("depth"))


def live_refs_at_exit(spark, d):
    """References (registers) that a log acquires (purchase) and never releases (error) afterwards."""
    s = P.states(spark, d)
    last = s.groupBy("log_id", "reg").agg(F.max(F.when(F.col("event_type") == "purchase", F.col("log_line"))).alias("got"), F.max(F.when(F.col("event_type") == "error", F.col("log_line"))).alias("gone"))
    return last.where("got is not null and (gone is null or gone < got)").groupBy("log_id").agg(F.count("*").alias("live"), F.sort_array(F.collect_list("reg")).cast("string").alias("regs"))


def range_unsafe_flags(spark, d):
    r = F.col("range")
    flags = {"negative": R.may_be_negative, "large": R.too_large, "unsafe": R.unsafe, "bounded": R.bounded, "zero": R.may_include_zero, "varies": R.variable_offset, "pointer": R.pointer_like, "unsafe_state": R.unsafe_state, "is_zero": R.is_zero}
    return P.ranges(spark, d).select("part_id", *(f(r).alias(n) for n, f in flags.items()), R.exact_u64(r).cast("long").alias("exact64"), R.exact_u32(r).alias("exact32"), R.exact_scalar(r).cast("long").alias("exact_scalar"))


def range_outside_required(spark, d):
    r = F.col("range")
    lo = F.when(F.col("part_id") % 4 == 0, F.lit(-2)).otherwise(F.col("part_id") % 3)
    return P.ranges(spark, d).select("part_id", R.lowest(r).alias("lo"), R.highest(r).alias("hi"), R.outside(r, lo, F.col("value_size")).alias("outside"), R.summary(r).alias("summary"), R.value_summary(r).alias("value_summary"), R.same(r, r.withField("smin", F.coalesce(r["smin"], F.lit(-19).cast("long")))).alias("same"))


def map_value_oob(spark, d):
    r = F.col("range")
    return P.ranges(spark, d).select("part_id", R.remaining(F.col("value_size"), r["off"]).cast("long").alias("remaining"), R.variable_offset_max(r).cast("long").alias("widest"), R.access_may_exceed(r, F.col("size")).alias("exceeds"), R.offset_may_exceed(r).alias("outside"), R.at_most(r, F.col("value_size")).alias("capped"))


def slot_overlap_newest(spark, d):
    a = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("access_id"), F.col("o_orderkey").alias("order_id"), (-8 * (F.col("o_custkey") % 64 + 1)).alias("a_start"), (-8 * (F.col("o_custkey") % 64 + 1) + 64).alias("a_end"))
    met = intervals.newest_overlaps(a, P.slots(spark, d), ["order_id"])
    return met.select("access_id", "state_id", "s_start", "s_end", "initialized")


def init_prefix_length(spark, d):
    s = P.slots(spark, d).where("initialized").withColumn("start", F.min("s_start").over(Window.partitionBy("order_id"))).withColumn("size", F.lit(32))
    out = intervals.initialized_prefix(s.select("order_id", "start", "size", "s_start", "s_end"), ["order_id"], "start", "size")
    return out.select("order_id", F.col("prefix").cast("long").alias("prefix"))


def signal_rank_select(spark, d):
    """Each log's signal of the least rank, then of the most specific name."""
    rank = F.when(F.col("reg_type") == "pkt", 10).when(F.col("reg_type") == "map_value", 5).when(F.col("reg_type") == "ptr_or_null", 20).otherwise(50)
    s = P.states(spark, d).withColumn("rank", (rank + F.col("pc") % 3).cast("long"))
    return select.best(s, ["log_id"], F.col("rank"), F.col("log_line")).select("log_id", "rank", "reg_type", "log_line")


def related_span_dedup(spark, d):
    return select.without_neighbour_repeats(P.states(spark, d), ["log_id"], ["log_line"], ["reg_type", "frame"]).select("log_id", "log_line", "reg_type", "frame")


def diagnostic_merge(spark, d):
    c = P.table(spark, d, "customer").select("c_custkey", F.col("c_mktsegment").alias("label"), F.round("c_acctbal", 2).alias("score"))
    o = P.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderpriority").alias("label"), F.lit(None).cast("double").alias("score"))
    return select.merged(c, o, ["c_custkey"], ["label", "score"])


def relo_self_join(spark, d):
    """Relocations (parts) with the next one of the same section (brand) behind each: pairs by a window instead of a join."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    p = P.table(spark, d, "part").select("p_brand", "p_partkey", F.lead("p_partkey").over(w).alias("next"))
    return p.where("next is not null").groupBy("p_brand").agg(F.count("*").alias("pairs"), F.max(F.col("next") - F.col("p_partkey")).alias("widest_gap"))


def _edges(spark, d):
    return P.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))


def cfg_predecessors(spark, d):
    p = graph.predecessors(_edges(spark, d))
    return p.select("node", F.size("predecessors").cast("long").alias("n"), F.element_at("predecessors", 1).alias("least"), F.element_at("predecessors", -1).alias("most"))


def cfg_reachable(spark, d):
    chain = P.table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.explode(F.array(F.col("c_custkey") * 2 + 1, F.col("c_custkey") * 3 + 2)).alias("dst"))
    known = P.table(spark, d, "customer").select(F.col("c_custkey").alias("dst"))
    return graph.reachable(chain.join(known, "dst", "left_semi").select("src", "dst"), spark.range(1).select(F.lit(0).cast("long").alias("node"))).select("node", F.col("depth").cast("long").alias("depth"))


def liveness_fixpoint(spark, d):
    c = F.col("c_custkey")
    nodes = P.table(spark, d, "customer")
    edges = nodes.select(c.alias("src"), (c * 2 + 1).alias("dst"))
    return graph.live_in(edges, nodes.where(c % 5 == 0).select(c.alias("node"), (c % 4).alias("var")), nodes.where(c % 6 == 1).select(c.alias("node"), (c % 4).alias("var")))


def slot_prefix_sum(spark, d):
    """Where each instruction of an order starts, if some take two slots."""
    w = Window.partitionBy("log_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    wide = F.when(F.col("line").contains("(61)"), 2).otherwise(1)
    return P.instruction_lines(spark, d).withColumn("slots", wide).select("log_id", "line_no", F.coalesce(F.sum("slots").over(w), F.lit(0)).cast("long").alias("at"))


def branch_rates(spark, d):
    taken = F.count_if(F.col("event_type") == "click")
    out = P.states(spark, d).groupBy("pc").agg(F.count("*").alias("n"), taken.alias("taken"))
    return out.select("pc", "n", "taken", F.round(cfg.rate(F.col("taken"), F.col("n") - F.col("taken")), 6).alias("rate"))


def state_parse(spark, d):
    """Register states that the parser finds in the text of a state for each line item."""
    rows = states.register_states(states.states(P.state_lines(spark, d)))
    return rows.select("log_id", "log_line", F.col("pc").cast("long").alias("pc"), "kind", F.col("reg").cast("long").alias("reg"), "reg_type", "narrow", "precise", "smin", F.col("smin32").cast("long").alias("smin32"), F.col("umax").cast("long").alias("umax"), F.col("tnum_mask").cast("long").alias("tnum_mask"), F.col("exact").cast("long").alias("exact"), F.col("off").cast("long").alias("off"), F.col("id").cast("long").alias("id"))


def state_slots(spark, d):
    found = states.states(P.state_lines(spark, d))
    slots = states.slot_states(found).groupBy("slot_off", "slot_types").agg(F.count("*").alias("n"))
    refs = found.select(S.references(F.col("tokens")).alias("ids"))
    return slots.select(F.col("slot_off").cast("long").alias("slot_off"), "slot_types", "n").crossJoin(refs.agg(F.count("ids").alias("with_refs"), F.sum(F.element_at("ids", 2)).alias("sum_second")))


def diagnose_logs(spark, d):
    out = diagnose.diagnostics(P.logs(spark, d))
    return out.select("log_id", F.col("line_no").cast("long").alias("line_no"), "error_id", F.col("register").cast("long").alias("register"), F.col("state_line").cast("long").alias("state_line"), "state")


_POINTS = "points AS (SELECT event_id AS point_id, log_id, log_line, pc, reg FROM states WHERE event_type = 'error')"
_EDGES = "edges AS (SELECT l_suppkey AS src, l_partkey AS dst FROM lineitem)"
_NEGATIVE = "CASE WHEN exact IS NOT NULL THEN exact > 9223372036854775807 WHEN smin IS NOT NULL THEN smin < 0 ELSE umin IS NULL END"
_LARGE = "coalesce(smax > 2147483647, false) OR coalesce(umax > 2147483647, false) OR (smax IS NULL AND umax IS NULL)"
_UNSAFE = "smin IS NULL OR smin < 0 OR umin IS NULL OR umax IS NULL OR umax > 2147483647"
_BOUNDED = "smin IS NOT NULL OR smax IS NOT NULL OR umin IS NOT NULL OR umax IS NOT NULL OR smin32 IS NOT NULL OR smax32 IS NOT NULL OR umin32 IS NOT NULL OR umax32 IS NOT NULL"
_WIDEST = "coalesce(umax, CASE WHEN smax >= 0 THEN smax END)"
_LARGEST = f"CASE WHEN off >= 0 THEN off + coalesce({_WIDEST}, 0) ELSE {_WIDEST} END"
_PARTS = "concat_ws(',', 'smin=' || smin, 'smax=' || smax, 'umin=' || umin, 'umax=' || umax)"
_SUMMARY = f"CASE WHEN exact IS NOT NULL THEN 'scalar exact ' || exact WHEN {_PARTS} = '' THEN 'scalar with unknown bounds' ELSE 'scalar(' || {_PARTS} || ')' END"

_STATE_NUMBERS = f"SELECT l_orderkey AS log_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {P.ORDER}) AS log_line, CAST(l_linenumber AS BIGINT) AS pc, l_partkey, l_suppkey FROM lineitem"

QUERIES = {
    "state_parse": (state_parse, f"""WITH n AS ({_STATE_NUMBERS}), both_ AS (
  SELECT log_id, log_line, pc, 0 AS at_, l_partkey % 10 AS reg, 'scalar' AS reg_type, true AS narrow, false AS precise, -(l_suppkey % 100) AS smin, -(l_suppkey % 100) AS smin32, l_partkey % 255 AS umax, l_partkey % 255 AS tnum_mask,
         CASE WHEN l_partkey % 255 = 0 THEN 0 END AS exact, CAST(NULL AS BIGINT) AS off, l_suppkey % 50 + 1 AS id FROM n
  UNION ALL SELECT log_id, log_line, pc, 1, l_suppkey % 2 + 9, 'fp', false, true, NULL, NULL, NULL, NULL, NULL, -(l_partkey % 64 + 1), NULL FROM n
) SELECT log_id, log_line, pc, 'insn_delta' AS kind, reg, reg_type, narrow, precise, smin, smin32, umax, tnum_mask, exact, off, id FROM (SELECT *, row_number() OVER (PARTITION BY log_id, log_line, reg ORDER BY at_ DESC) AS k FROM both_) WHERE k = 1"""),
    "state_slots": (state_slots, "SELECT CAST(-8 AS BIGINT) AS slot_off, 'mmmm????' AS slot_types, count(*) AS n, count(*) FILTER (WHERE l_suppkey % 5 > 0) AS with_refs, sum(l_partkey % 9 + 1) FILTER (WHERE l_suppkey % 5 > 0) AS sum_second FROM lineitem"),
    "diagnose": (diagnose_logs, P.sql(P.INSTRUCTION_LINES, P.MESSAGES, P.LOGS, _CLASSIFIED, query=f"""
, ends AS (SELECT log_id, max(line_no) AS line_no FROM logs WHERE {_is_error("trim(line)")} GROUP BY 1),
points AS (SELECT e.log_id, e.line_no, c.error_id, TRY_CAST(nullif(regexp_extract(c.message, 'R([0-9]+)', 1), '') AS BIGINT) AS register FROM ends e JOIN classified c ON e.log_id = c.log_id),
known AS (SELECT log_id, line_no, CAST(regexp_extract(line, '^[0-9]+: R([0-9]+)=scalar', 1) AS BIGINT) AS reg, 'scalar(umax=' || regexp_extract(line, 'umax=([0-9]+)', 1) || ')' AS state FROM logs WHERE regexp_matches(line, '^[0-9]+: R[0-9]+=scalar'))
SELECT p.log_id, p.line_no, error_id, register, max(k.line_no) AS state_line, arg_max(k.state, k.line_no) AS state FROM points p LEFT JOIN known k ON p.log_id = k.log_id AND p.register = k.reg AND k.line_no < p.line_no GROUP BY ALL""".replace("\n, ends", ", ends", 1))),
    "asof_reg_before": (asof_reg_before, P.sql(P.STATES, _POINTS, query="SELECT point_id, p.log_id, arg_max(s.event_id, s.log_line) AS state_id, arg_max(s.reg_type, s.log_line) AS reg_type FROM points p LEFT JOIN states s ON p.log_id = s.log_id AND p.reg = s.reg AND s.log_line < p.log_line AND s.pc <= p.pc GROUP BY 1, 2")),
    "asof_at_or_before": (asof_at_or_before, P.sql(P.STATES, _POINTS, query="SELECT point_id, p.log_id, arg_max(s.event_id, s.log_line) AS state_id FROM points p LEFT JOIN states s ON p.log_id = s.log_id AND p.reg = s.reg AND s.log_line <= p.log_line AND s.event_type <> 'error' GROUP BY 1, 2")),
    "asof_call_arg_fallback": (asof_call_arg_fallback, P.sql(P.STATES, query="""SELECT p.event_id AS point_id, coalesce(arg_max(CASE WHEN s.frame = p.frame THEN s.event_id END, CASE WHEN s.frame = p.frame THEN s.log_line END), arg_max(s.event_id, s.log_line)) AS state_id
FROM states p LEFT JOIN states s ON p.log_id = s.log_id AND s.reg = 1 AND s.log_line < p.log_line WHERE p.event_type = 'signup' GROUP BY p.event_id""")),
    "ptr_to_scalar_transition": (ptr_to_scalar_transition, P.sql(P.STATES, query="""SELECT log_id, reg, max(log_line) AS log_line, arg_max(pc, log_line) AS pc, arg_max(before, log_line) AS pointer_type FROM (
  SELECT *, last_value(CASE WHEN reg_type <> 'scalar' THEN reg_type END IGNORE NULLS) OVER (PARTITION BY log_id, reg ORDER BY log_line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM states
) WHERE reg_type = 'scalar' AND before IS NOT NULL GROUP BY 1, 2""")),
    "latest_unsafe_scalar": (latest_unsafe_scalar, P.sql(P.STATES, query="SELECT log_id, reg, max(log_line) AS log_line, arg_max(event_id, log_line) AS event_id FROM states WHERE (reg_type = 'scalar' AND (floor(value) - 20 < 0 OR event_id % 3 = 0 OR floor(value) * 100000000 > 2147483647)) OR (reg_type = 'map_value' AND floor(value) * 100000000 >= 8) GROUP BY 1, 2")),
    "latest_nullable": (latest_nullable, P.sql(P.STATES, query="SELECT log_id, max(log_line) AS log_line, arg_max(reg, log_line) AS reg FROM states WHERE reg_type = 'ptr_or_null' GROUP BY 1")),
    "path_snapshot_locf": (path_snapshot_locf, P.sql(P.STATES, query="SELECT log_id, segment, reg, arg_max(event_id, log_line) AS event_id, max(log_line) AS log_line FROM (SELECT *, CAST(sum(CASE WHEN kind IN (0, 1) THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY log_line) AS BIGINT) AS segment FROM states) GROUP BY 1, 2, 3")),
    "known_constant_agreement": (known_constant_agreement, P.sql(P.STATES, query="SELECT log_id, pc, CASE WHEN min(v) = max(v) AND count(v) = count(*) THEN min(v) END AS v FROM (SELECT *, CASE WHEN reg_type = 'scalar' THEN event_id % 2 END AS v FROM states) GROUP BY 1, 2")),
    "dead_sites": (dead_sites, P.sql(P.STATES, query="SELECT log_id, pc, count(*) AS visits FROM states GROUP BY 1, 2 HAVING bool_and(kind = 3)")),
    "packet_lineage_range": (packet_lineage_range, P.sql(P.STATES, query="""SELECT log_id, reg, segment, max(value) AS widest, count(*) AS n FROM (
  SELECT *, CAST(sum(changed) OVER (PARTITION BY log_id, reg ORDER BY log_line) AS BIGINT) AS segment FROM (
    SELECT *, CASE WHEN reg_type IS DISTINCT FROM lag(reg_type) OVER (PARTITION BY log_id, reg ORDER BY log_line) THEN 1 ELSE 0 END AS changed FROM states)
) WHERE reg_type = 'pkt' GROUP BY 1, 2, 3""")),
    "lock_depth_running": (lock_depth_running, P.sql(P.STATES, query="""SELECT log_id, log_line, CAST(s - least(0, min(s) OVER (PARTITION BY log_id ORDER BY log_line)) AS BIGINT) AS depth FROM (
  SELECT *, sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY log_line) AS s FROM states)""")),
    "live_refs_at_exit": (live_refs_at_exit, P.sql(P.STATES, query="""SELECT log_id, count(*) AS live, '[' || string_agg(reg, ', ' ORDER BY reg) || ']' AS regs FROM (
  SELECT log_id, reg, max(CASE WHEN event_type = 'purchase' THEN log_line END) AS got, max(CASE WHEN event_type = 'error' THEN log_line END) AS gone FROM states GROUP BY 1, 2
) WHERE got IS NOT NULL AND (gone IS NULL OR gone < got) GROUP BY 1""")),
    "range_unsafe_flags": (range_unsafe_flags, P.sql(P.RANGES, query=f"""SELECT part_id, {_NEGATIVE} AS negative, {_LARGE} AS large, {_UNSAFE} AS unsafe, {_BOUNDED} AS bounded,
CASE WHEN exact IS NOT NULL THEN exact = 0 ELSE NOT (coalesce(smax < 0, false) OR coalesce(smin > 0, false) OR coalesce(umin > 0, false)) END AS zero,
tnum_value IS NOT NULL OR {_BOUNDED} AS varies, reg_type NOT IN ('scalar', 'fp') AS pointer, (reg_type = 'scalar' AND ({_UNSAFE})) OR coalesce(reg_type = 'map_value' AND ({_LARGEST}) >= value_size, false) AS unsafe_state,
coalesce(exact = 0, false) AS is_zero, CASE WHEN NOT narrow THEN exact END AS exact64, exact % 4294967296 AS exact32, CASE WHEN narrow THEN exact % 4294967296 ELSE exact END AS exact_scalar FROM ranges""")),
    "range_outside_required": (range_outside_required, P.sql(P.RANGES, query=f"""SELECT part_id, coalesce(smin, umin, smin32, umin32) AS lo, coalesce(smax, umax, smax32, umax32) AS hi,
reg_type = 'scalar' AND CASE WHEN exact IS NOT NULL THEN NOT exact BETWEEN least_ AND value_size WHEN smin IS NOT NULL AND smax IS NOT NULL THEN smin < least_ OR smax > value_size
  WHEN least_ >= 0 AND umin IS NOT NULL AND umax IS NOT NULL THEN umin < least_ OR umax > value_size WHEN smin32 IS NOT NULL AND smax32 IS NOT NULL THEN smin32 < least_ OR smax32 > value_size
  WHEN least_ >= 0 AND umin32 IS NOT NULL AND umax32 IS NOT NULL THEN umin32 < least_ OR umax32 > value_size ELSE true END AS outside,
{_SUMMARY} AS summary, CASE WHEN reg_type = 'scalar' THEN {_SUMMARY} ELSE reg_type || '(' || concat_ws(',', 'off=' || off, 'value_size=' || value_size, CASE WHEN {_PARTS} <> '' THEN 'range(' || {_PARTS} || ')' END) || ')' END AS value_summary, smin IS NOT NULL AS same
FROM (SELECT *, CASE WHEN part_id % 4 = 0 THEN -2 ELSE part_id % 3 END AS least_ FROM ranges)""")),
    "map_value_oob": (map_value_oob, P.sql(P.RANGES, query=f"""SELECT part_id, CASE WHEN coalesce(off, 0) >= 0 AND value_size - coalesce(off, 0) >= 0 THEN value_size - coalesce(off, 0) END AS remaining, {_WIDEST} AS widest,
coalesce(reg_type = 'map_value' AND coalesce({_LARGEST}, 0) + size > value_size, false) AS exceeds, coalesce(reg_type = 'map_value' AND ({_LARGEST}) >= value_size, false) AS outside,
reg_type = 'scalar' AND (coalesce(exact <= value_size, false) OR coalesce(umax <= value_size, false) OR coalesce(smax BETWEEN 0 AND value_size, false) OR coalesce(umax32 <= value_size, false) OR coalesce(smax32 BETWEEN 0 AND value_size, false)) AS capped FROM ranges""")),
    "slot_overlap_newest": (slot_overlap_newest, P.sql(P.SLOTS, query="""SELECT access_id, state_id, s_start, s_end, initialized FROM (
  SELECT *, max(state_id) OVER (PARTITION BY access_id) AS newest FROM (SELECT o_orderkey AS access_id, -8 * (o_custkey % 64 + 1) AS a_start FROM orders) a JOIN slots s ON a.access_id = s.order_id AND a_start < s_end AND s_start < a_start + 64
) WHERE state_id = newest""")),
    "init_prefix_length": (init_prefix_length, P.sql(P.SLOTS, query="""SELECT order_id, CAST(coalesce(min(i) FILTER (WHERE NOT covered), 32) AS BIGINT) AS prefix FROM (
  SELECT b.order_id, i, bool_or(s.s_start <= b.start + i AND b.start + i < s.s_end) AS covered
  FROM (SELECT order_id, start, unnest(range(0, 32)) AS i FROM (SELECT order_id, min(s_start) AS start FROM slots WHERE initialized GROUP BY 1)) b JOIN slots s ON b.order_id = s.order_id AND s.initialized GROUP BY 1, 2
) GROUP BY 1""")),
    "signal_rank_select": (signal_rank_select, P.sql(P.STATES, query="SELECT log_id, rank, reg_type, log_line FROM (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY rank, log_line) AS n FROM (SELECT *, CASE reg_type WHEN 'pkt' THEN 10 WHEN 'map_value' THEN 5 WHEN 'ptr_or_null' THEN 20 ELSE 50 END + pc % 3 AS rank FROM states)) WHERE n = 1")),
    "related_span_dedup": (related_span_dedup, P.sql(P.STATES, query="SELECT log_id, log_line, reg_type, frame FROM (SELECT *, lag(reg_type) OVER w AS t, lag(frame) OVER w AS f FROM states WINDOW w AS (PARTITION BY log_id ORDER BY log_line)) WHERE reg_type IS DISTINCT FROM t OR frame IS DISTINCT FROM f")),
    "diagnostic_merge": (diagnostic_merge, "SELECT c.c_custkey, coalesce(o.label, c_mktsegment) AS label, round(c_acctbal, 2) AS score FROM customer c LEFT JOIN (SELECT o_custkey, min(o_orderpriority) AS label FROM orders GROUP BY 1) o ON c.c_custkey = o.o_custkey"),
    "relo_self_join": (relo_self_join, "SELECT p_brand, count(*) AS pairs, max(next - p_partkey) AS widest_gap FROM (SELECT *, lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS next FROM part) WHERE next IS NOT NULL GROUP BY 1"),
    "cfg_predecessors": (cfg_predecessors, P.sql(_EDGES, query="SELECT dst AS node, count(DISTINCT src) AS n, min(src) AS least, max(src) AS most FROM edges GROUP BY 1")),
    "cfg_reachable": (cfg_reachable, """WITH RECURSIVE e AS (SELECT c_custkey AS src, c_custkey * 2 + 1 AS dst FROM customer UNION ALL SELECT c_custkey, c_custkey * 3 + 2 FROM customer), r AS (
  SELECT CAST(0 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT dst, depth + 1 FROM r JOIN e ON r.node = e.src WHERE dst IN (SELECT c_custkey FROM customer)
) SELECT node, min(depth) AS depth FROM r GROUP BY 1"""),
    "liveness_fixpoint": (liveness_fixpoint, """WITH RECURSIVE live AS (
  SELECT c_custkey AS node, c_custkey % 4 AS var FROM customer WHERE c_custkey % 5 = 0
  UNION SELECT c.c_custkey, l.var FROM live l JOIN customer c ON c.c_custkey * 2 + 1 = l.node WHERE NOT (c.c_custkey % 6 = 1 AND c.c_custkey % 4 = l.var)
) SELECT DISTINCT node, var FROM live"""),
    "slot_prefix_sum": (slot_prefix_sum, P.sql(P.INSTRUCTION_LINES, query="SELECT log_id, line_no, CAST(coalesce(sum(CASE WHEN contains(line, '(61)') THEN 2 ELSE 1 END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS at FROM instruction_lines")),
    "branch_rates": (branch_rates, P.sql(P.STATES, query="SELECT pc, count(*) AS n, count(*) FILTER (WHERE event_type = 'click') AS taken, round(count(*) FILTER (WHERE event_type = 'click') / count(*), 6) AS rate FROM states GROUP BY 1")),
}
