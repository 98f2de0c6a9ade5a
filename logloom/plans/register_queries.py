"""Queries over what is known about registers and stack bytes: from instructions alone, and from the text of states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from ..functions import kinsn as K
from ..functions import states as S
from ..operators import cfg, facts, linking, states
from ..operators.storage import kept
from . import projections as P

# ---- programs from line items: one for each supplier, a few hundred instructions long ----

_CODES = (0xB7, 0xBF, 0x07, 0x17, 0xB4, 0xBC, 0x04, 0x61, 0x18, 0x85, 0xAF, 0x15, 0x07, 0x61, 0xBF, 0xBF, 0x7B, 0x14)
_KEY = "l_orderkey, " + P.ORDER
_NUMBERS = {"dst": "l_partkey % 8", "src": "(l_orderkey + l_linenumber) % 11", "imm": "l_partkey % 1001 - 500", "high": "l_linenumber % 3 - 1"}


def _programs(spark, d):
    """(program, pc, insn, high): 0x85 calls helpers only, and conditional jumps go one instruction ahead or skip one slot."""
    items = P.table(spark, d, "lineitem")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_partkey") % len(_CODES) + 1).cast("int"))
    number = {k: F.expr(v).cast("int") for k, v in _NUMBERS.items()}
    off = F.when(code == 0x15, F.col("l_orderkey") % 2).when(code == 0x61, F.col("l_orderkey") % 2 * 4).otherwise(0).cast("int")
    src = F.when(code.isin(0x85, 0xB7, 0x18, 0x15), 0).otherwise(number["src"])
    insn = F.struct(code.cast("int").alias("code"), number["dst"].alias("dst"), src.cast("int").alias("src"), off.alias("off"), number["imm"].alias("imm"))
    order = Window.partitionBy("l_suppkey").orderBy(*_KEY.split(", "))
    rows = items.select(F.col("l_suppkey").alias("program"), insn.alias("insn"), number["high"].alias("high"), F.row_number().over(order).alias("n"))
    w = Window.partitionBy("program").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pc", F.coalesce(F.sum(B.width(F.col("insn.code"))).over(w), F.lit(0)).cast("int")).select("program", "pc", "insn", "high")


_ITEMS = f"""items AS (
  SELECT l_suppkey AS program, row_number() OVER (PARTITION BY l_suppkey ORDER BY {_KEY}) AS n, list_extract({list(_CODES)}, l_partkey % {len(_CODES)} + 1) AS code, {", ".join(f"{v} AS {k}" for k, v in _NUMBERS.items())}, l_orderkey % 2 AS odd FROM lineitem
), code AS (
  SELECT program, n, code, dst, CASE WHEN code IN (133, 183, 24, 21) THEN 0 ELSE src END AS src, CASE code WHEN 21 THEN odd WHEN 97 THEN odd * 4 ELSE 0 END AS off, imm, high,
         CAST(coalesce(sum(CASE WHEN code = 24 THEN 2 ELSE 1 END) OVER (PARTITION BY program ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pc
  FROM items
)"""


def register_facts(spark, d):
    """What is known of the registers that instructions read, by kind, from the instructions of each program alone."""
    rows = kept(_programs(spark, d))  # read as points and types too, and numbering them is two ordered passes
    points = rows.select("program", "pc", F.explode(B.uses(F.col("insn"))).alias("reg"))
    types = rows.select("program").distinct().withColumn("program_type", F.when(F.col("program") % 2 == 0, "xdp").otherwise("kprobe"))
    found = facts.register_facts(rows, points, types)
    return found.groupBy("program", F.coalesce("kind", F.lit("unknown")).alias("kind")).agg(F.count("*").alias("n"), F.sum("value").cast("long").alias("sum_values"), F.sum("made_at").cast("long").alias("sum_made_at"))


def _facts_sql() -> str:
    """Walks each program instruction by instruction: three lists of eleven (kind, value, made_at), rewritten at every step."""
    get = lambda c, r: f"list_extract({c}0, {r} + 1)"
    kd, vd, md, ks, vs, ms = (get(c, r) for r in ("dst", "src") for c in "kvm")
    delta = "CASE WHEN code IN (7, 4) THEN imm WHEN code IN (23, 20) THEN -imm ELSE 0 END"
    low = lambda v: f"((({v}) % 4294967296 + 4294967296) % 4294967296)"
    base = f"(CASE WHEN code = 188 THEN {vs} ELSE {vd} END)"
    half_known = f"CASE WHEN code = 188 THEN {ks} ELSE {kd} END = 'const'"
    new_k = f"""CASE WHEN code IN (183, 180, 24) THEN 'const' WHEN code = 191 THEN {ks}
      WHEN code IN (7, 23) THEN CASE WHEN {kd} = 'const' AND {vd}::HUGEINT + {delta} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN 'const' WHEN {kd} = 'frame' THEN 'frame' WHEN {kd} = 'packet' AND code = 7 THEN 'packet' END
      WHEN code IN (4, 20, 188) THEN CASE WHEN {half_known} THEN 'const' END
      WHEN code = 97 AND program % 2 = 0 AND {ks} = 'context' THEN CASE off WHEN 0 THEN 'packet' WHEN 4 THEN 'packet_end' END END"""
    new_v = f"""CASE WHEN code = 183 THEN imm WHEN code = 180 THEN {low("imm")} WHEN code = 24 THEN high * 4294967296 + {low("imm")} WHEN code = 191 THEN {vs}
      WHEN code IN (7, 23) THEN CASE WHEN {kd} IN ('const', 'frame', 'packet') AND {vd}::HUGEINT + {delta} BETWEEN -9223372036854775808 AND 9223372036854775807 THEN {vd} + {delta} END
      WHEN code IN (4, 20, 188) THEN {low(f"{base} + {delta}")} WHEN code = 97 AND off = 0 THEN 0 END"""
    new_m = f"CASE WHEN code = 191 THEN {ms} WHEN code = 7 AND {kd} = 'packet' THEN {md} WHEN code = 97 THEN CASE WHEN off = 0 THEN pc ELSE coalesce(data0, pc) END END"
    new_k, new_v, new_m = (f"({x})" for x in (new_k, new_v, new_m))
    gone = "(code = 133 AND (r < 6 OR list_extract(k0, r + 1) IN ('packet', 'packet_end')))"
    defines = "code IN (183, 191, 7, 23, 180, 188, 4, 20, 97, 24, 175)"
    changed = lambda c, new, guard="": f"list_transform(range(11), lambda r: CASE WHEN {gone} THEN NULL WHEN {defines} AND r = dst THEN {new}{guard} ELSE list_extract({c}0, r + 1) END)"
    fresh_k = "list_transform(range(11), lambda r: CASE WHEN r = 10 THEN 'frame' WHEN r = 1 AND s.n = 1 THEN 'context' END)"
    fresh_v = "list_transform(range(11), lambda r: CASE WHEN r = 10 THEN 0::BIGINT END)"
    return f"""WITH RECURSIVE {_ITEMS}, jumps AS (
  SELECT program, pc + 2 AS pc FROM code WHERE code = 21 AND off = 1
), steps AS (
  SELECT c.*, n = 1 OR j.pc IS NOT NULL AS starts FROM code c LEFT JOIN jumps j USING (program, pc)
), run AS (
  SELECT program, 0::BIGINT AS n, 0::BIGINT AS code, 0::BIGINT AS dst, 0::BIGINT AS src, 0::BIGINT AS off, 0::BIGINT AS pc, NULL::VARCHAR[] AS k0, NULL::BIGINT[] AS v0, NULL::BIGINT[] AS m0, NULL::VARCHAR[] AS k, NULL::BIGINT[] AS v, NULL::BIGINT[] AS m, NULL::BIGINT AS data FROM (SELECT DISTINCT program FROM code)
  UNION ALL
  SELECT program, n, code, dst, src, off, pc, k0, v0, m0, k, list_transform(range(11), lambda r: CASE WHEN list_extract(k, r + 1) IS NOT NULL THEN list_extract(v, r + 1) END), list_transform(range(11), lambda r: CASE WHEN list_extract(k, r + 1) IS NOT NULL THEN list_extract(m, r + 1) END), data
  FROM (
    SELECT program, n, code, dst, src, off, pc, k0, v0, m0, {changed("k", new_k)} AS k, {changed("v", new_v)} AS v, {changed("m", new_m)} AS m,
           CASE WHEN code = 133 THEN NULL WHEN code = 97 AND off = 0 AND program % 2 = 0 AND {ks} = 'context' THEN pc ELSE data0 END AS data
    FROM (
      SELECT s.*, CASE WHEN starts THEN {fresh_k} ELSE r.k END AS k0, CASE WHEN starts THEN {fresh_v} ELSE r.v END AS v0, CASE WHEN starts THEN list_transform(range(11), lambda r: NULL::BIGINT) ELSE r.m END AS m0, CASE WHEN starts THEN NULL ELSE r.data END AS data0
      FROM run r JOIN steps s ON s.program = r.program AND s.n = r.n + 1
    )
  )
), uses AS (
  SELECT program, k0, v0, m0, unnest(CASE WHEN code IN (191, 188, 97) THEN [src] WHEN code IN (7, 23, 4, 20, 21) THEN [dst] WHEN code = 133 THEN [1, 2, 3, 4, 5] WHEN code IN (175, 123) THEN list_distinct([dst, src]) ELSE [] END) AS reg FROM run WHERE n > 0
)
SELECT program, coalesce(list_extract(k0, reg + 1), 'unknown') AS kind, count(*) AS n, CAST(sum(list_extract(v0, reg + 1)) AS BIGINT) AS sum_values, CAST(sum(list_extract(m0, reg + 1)) AS BIGINT) AS sum_made_at
FROM uses GROUP BY ALL"""


# ---- calls of kernel instructions ----

_TARGETS = [t for family in K.TARGETS.values() for t in family]


def kinsn_registers(spark, d):
    """What calls of kernel instructions read and write: a move with the operands and a call for each line item."""
    items = P.table(spark, d, "lineitem")
    number = lambda **v: F.struct(*(F.expr(str(x)).cast("int").alias(k) for k, x in v.items()))
    carried = number(code=0xB7, dst="l_partkey % 11", src="if(l_partkey % 29 = 0, 0, 3)", off="l_suppkey * 37 % 65536 - 32768", imm="l_partkey % 7")
    called = number(code=0x85, dst=0, src=4, off="l_suppkey % 2", imm=f"l_partkey % {len(_TARGETS) + 1}")
    w = Window.partitionBy("l_orderkey").orderBy(*P.ORDER.split(", "))
    rows = items.select(F.col("l_orderkey").alias("program"), (2 * F.row_number().over(w) - 2).alias("_at"), F.posexplode(F.array(carried, called)).alias("k", "insn")).select("program", (F.col("_at") + F.col("k")).alias("pc"), "insn")
    registry = spark.createDataFrame([(i, off, t) for i, t in enumerate(_TARGETS) for off in (0, 1)], "call_imm int, call_off int, target string")
    found = cfg.kinsn_operands(rows, registry)
    return found.groupBy("target", "role", "problem").agg(F.count("*").alias("n"), F.sum("reg").cast("long").alias("sum_regs"))


def _kinsn_sql() -> str:
    names = ", ".join(f"'{t}'" for t in _TARGETS)
    operands = ", ".join(f"('{t}', '{role}', {shift}, {'NULL' if mode is None else mode}, {'NULL' if flag is None else flag})" for family, ts in K.TARGETS.items() for t in ts for role, shift, mode, flag in K.OPERANDS[family])
    return f"""WITH operands(target, role, shift, mode, flag) AS (VALUES {operands}), calls AS (
  SELECT row_number() OVER () AS id, list_extract([{names}], l_partkey % {len(_TARGETS) + 1} + 1) AS target, l_partkey % 29 <> 0 AS carried,
         (l_partkey % 11) + ((l_suppkey * 37 % 65536 + 32768) % 65536) * 16 + (l_partkey % 7) * 1048576 AS p FROM lineitem
), met AS (
  SELECT DISTINCT id, c.target, CASE WHEN NOT carried THEN 'no operands' WHEN c.target IS NULL THEN 'unknown call' WHEN (p >> shift) & 15 > 10 THEN 'bad register' END AS problem, role, (p >> shift) & 15 AS reg
  FROM calls c LEFT JOIN operands o ON c.target = o.target AND (mode IS NULL OR p & 15 = mode) AND (flag IS NULL OR (p >> flag) & 1 = 1)
)
SELECT target, CASE WHEN problem IS NULL THEN role END AS role, problem, count(*) AS n, CAST(sum(CASE WHEN problem IS NULL THEN reg END) AS BIGINT) AS sum_regs
FROM (SELECT DISTINCT id, target, problem, CASE WHEN problem IS NULL THEN role END AS role, CASE WHEN problem IS NULL THEN reg END AS reg FROM met WHERE role IS NOT NULL OR problem IS NOT NULL) GROUP BY ALL"""


# ---- stack bytes from the text of states ----

_SLOT8 = ("'0'", "'mmmm0000'", "format('%d', l_orderkey % 200)", "'rrrrrrrrscalar(umin=7,umax=7)'")
_SLOT16 = ("'0'", "'mmmmmmmm'", "'fp-56'", "'dynptr_local(ref_id=2)'", "'r0000000scalar()'")


def _choice(forms, number: str) -> str:
    return f"CASE {number} % {len(forms)} {' '.join(f'WHEN {k} THEN {x}' for k, x in enumerate(forms))} END"


_LINE = ("concat", "CAST(l_linenumber % 3 AS STRING)", "': R2=fp-'", "CAST(8 + 4 * (l_linenumber % 3) AS STRING)", "' R3=scalar(map=a(b(c(d))),id=4) fp-8='", "SLOT8", "' fp-16_w='", "SLOT16")


def _slot_lines(spark, d):
    """(log_id, line_no, line): states whose slots hold spilled zeros, numbers, pointers, dynptrs and bytes of all types."""
    parts = [_choice(_SLOT8, "l_partkey").replace("format('%d', l_orderkey % 200)", "CAST(l_orderkey % 200 AS STRING)") if p == "SLOT8" else _choice(_SLOT16, "l_orderkey") if p == "SLOT16" else p for p in _LINE[1:]]
    w = Window.partitionBy("l_orderkey").orderBy(*P.ORDER.split(", "))
    return P.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.row_number().over(w).cast("long").alias("line_no"), F.expr(f"concat({', '.join(parts)})").alias("line"))


def spilled_slots(spark, d):
    """Slots by how they are written: types, a spilled number, pointer or object, or both; and attributes behind deep brackets."""
    found = states.states(_slot_lines(spark, d))
    rows = kept(found.select(S.slots(F.col("tokens")).alias("slots"), S.text_of(F.col("tokens"), F.lit(3)).alias("r3")))  # else a line is read anew for each slot
    rows = states.with_states(rows.select(F.inline("slots"), F.col("r3.value").alias("r3"), F.col("r3.narrow").alias("narrow")), {"value": None, "r3": "narrow"})
    rows = rows.select(F.col("slot_off").cast("long").alias("slot_off"), "slot_types", *(F.col(f"value_state.{n}").alias(n) for n in ("reg_type", "exact", "off")), F.col("r3_state.id").alias("id"))
    return rows.groupBy("slot_off", "slot_types", "reg_type").agg(F.count("*").alias("n"), F.sum("exact").cast("long").alias("sum_exact"), F.sum("off").cast("long").alias("sum_off"), F.sum("id").alias("sum_ids"))


_SPILLED_SQL = """WITH f AS (
  SELECT -8 AS slot_off, CASE l_partkey % 4 WHEN 1 THEN 'mmmm0000' WHEN 3 THEN 'rrrrrrrr' END AS slot_types, CASE WHEN l_partkey % 4 <> 1 THEN 'scalar' END AS reg_type, CASE l_partkey % 4 WHEN 0 THEN 0 WHEN 2 THEN l_orderkey % 200 WHEN 3 THEN 7 END AS exact, NULL AS off FROM lineitem
  UNION ALL
  SELECT -16, CASE l_orderkey % 5 WHEN 1 THEN 'mmmmmmmm' WHEN 4 THEN 'r0000000' END, CASE l_orderkey % 5 WHEN 0 THEN 'scalar' WHEN 2 THEN 'fp' WHEN 3 THEN 'dynptr_local' WHEN 4 THEN 'scalar' END, CASE WHEN l_orderkey % 5 = 0 THEN 0 END, CASE WHEN l_orderkey % 5 = 2 THEN -56 END FROM lineitem
) SELECT CAST(slot_off AS BIGINT) AS slot_off, slot_types, reg_type, count(*) AS n, CAST(sum(exact) AS BIGINT) AS sum_exact, CAST(sum(off) AS BIGINT) AS sum_off, CAST(count(*) * 4 AS BIGINT) AS sum_ids FROM f GROUP BY ALL"""


def known_stack_bytes(spark, d):
    """The four bytes behind r2 that all visits of a site agree on."""
    found = kept(states.states(_slot_lines(spark, d)).select(F.col("log_id").alias("program"), "pc", "kind", "tokens"))  # read as visits and as what is asked
    asked = found.select("program", "pc").distinct().select("program", "pc", F.lit(2).alias("reg"), F.lit(4).alias("width"))
    out = cfg.known_stack_bytes(found, asked)
    return out.select("program", F.col("pc").cast("long").alias("pc"), "bytes")


_BYTES_SQL = """WITH f AS (
  SELECT l_orderkey AS program, l_linenumber % 3 AS pc,
    CASE l_linenumber % 3
      WHEN 0 THEN CASE l_partkey % 4 WHEN 2 THEN printf('%02x000000', l_orderkey % 200) WHEN 3 THEN '07000000' ELSE '00000000' END
      WHEN 1 THEN CASE l_orderkey % 5 WHEN 0 THEN '00000000' WHEN 4 THEN NULL END
      ELSE CASE l_orderkey % 5 WHEN 0 THEN '00000000' WHEN 4 THEN '00000000' END END AS bytes
  FROM lineitem
) SELECT program, CAST(pc AS BIGINT) AS pc, CASE WHEN count(bytes) = count(*) AND min(bytes) = max(bytes) THEN min(bytes) END AS bytes FROM f GROUP BY ALL"""

# ---- programs as they are loaded ----


def loaded_programs(spark, d):
    """Each order as an object: a function for each item, of which many call a later one, and an entry that calls two of them."""
    w = Window.partitionBy("l_orderkey").orderBy(*P.ORDER.split(", "))
    items = P.table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy("l_orderkey")))
    items = kept(items.select("l_orderkey", "l_partkey", "l_suppkey", "k", "n"))  # all tables of the objects are made of these
    insn = lambda code, src, imm: F.struct(F.lit(code).alias("code"), F.lit(0).alias("dst"), F.lit(src).alias("src"), F.lit(0).alias("off"), imm.cast("int").alias("imm"))
    to = F.col("k") + 1 + F.col("l_partkey") % 2
    calls = (to <= F.col("n")) & (F.col("l_suppkey") % 3 > 0)
    body = F.array(insn(0xB7, 0, F.col("l_partkey") % 100), F.when(calls, insn(0x85, 1, 2 * (to - 1) - 2 * F.col("k"))).otherwise(insn(0xB7, 0, F.lit(0))))
    shared = items.select(F.col("l_orderkey").alias("object"), F.lit(1).alias("section"), F.posexplode(body).alias("p", "insn"), "k").select("object", "section", (2 * F.col("k") - 2 + F.col("p")).alias("slot"), "insn")
    orders = items.groupBy(F.col("l_orderkey").alias("object")).agg(F.count("*").alias("n"))
    second = 1 + F.col("object") % 3
    entry = orders.select("object", F.lit(2).alias("section"), F.posexplode(F.array(insn(0x85, 1, F.lit(-1)), insn(0xB7, 0, F.lit(7)), F.when(second <= F.col("n"), insn(0x85, 1, F.lit(-1))).otherwise(insn(0xB7, 0, F.lit(8))))).alias("slot", "insn"))
    sections = orders.select("object", F.explode(F.create_map(F.lit(1), F.lit(".text"), F.lit(2), F.lit("xdp"))).alias("section", "name"))
    symbols = items.select(F.col("l_orderkey").alias("object"), F.col("k").alias("symbol"), F.lit(1).alias("section"), F.lit("text").alias("kind"), (16 * (F.col("k") - 1)).cast("long").alias("offset"), F.lit(16).cast("long").alias("size"))
    moved = orders.select("object", F.lit(2).alias("section"), F.explode(F.array(F.struct(F.lit(0).alias("at"), F.lit(1).cast("long").alias("to")), F.struct(F.lit(2).alias("at"), second.cast("long").alias("to")))).alias("m"))
    relocations = moved.select("object", "section", (8 * F.col("m.at")).cast("long").alias("offset"), F.lit("absolute").alias("kind"), F.lit(32).alias("size"), F.col("m.to").cast("int").alias("target_symbol"), F.lit(None).cast("int").alias("target_section"))
    found = linking.loaded(shared.unionByName(entry), sections, symbols, relocations)
    is_call = B.is_pseudo_call(F.col("insn"))
    return found.groupBy("object").agg(F.count("*").alias("slots"), F.count_if(is_call).alias("calls"), F.sum(F.when(is_call, F.col("insn.imm"))).cast("long").alias("sum_steps"), F.sum(F.when(is_call, F.col("slot") * F.col("insn.imm"))).cast("long").alias("sum_places"))


_LOADED_SQL = f"""WITH RECURSIVE items AS (
  SELECT l_orderkey AS object, row_number() OVER (PARTITION BY l_orderkey ORDER BY {P.ORDER}) AS k, count(*) OVER (PARTITION BY l_orderkey) AS n, l_partkey % 2 AS far, l_suppkey % 3 > 0 AS calls FROM lineitem
), f AS (
  SELECT object, k, n, CASE WHEN calls AND k + 1 + far <= n THEN k + 1 + far END AS callee FROM items
), walk AS (
  SELECT object, 1 AS first, 0::BIGINT AS step, k, callee FROM f WHERE k = 1
  UNION ALL SELECT object, 2, 0::BIGINT, k, callee FROM f WHERE k = 1 + object % 3
  UNION ALL SELECT w.object, w.first, w.step + 1, f.k, f.callee FROM walk w JOIN f ON f.object = w.object AND f.k = w.callee
), placed AS (
  SELECT object, k, callee, 3 + 2 * (row_number() OVER (PARTITION BY object ORDER BY first, step) - 1) AS loaded_at FROM (SELECT object, k, any_value(callee) AS callee, min(first) AS first, arg_min(step, first) AS step FROM walk GROUP BY object, k)
), calls AS (
  SELECT object, 0 AS slot, 2 AS imm FROM placed WHERE k = 1
  UNION ALL SELECT object, 2, loaded_at - 3 FROM placed WHERE k = 1 + object % 3
  UNION ALL SELECT a.object, a.loaded_at + 1, b.loaded_at - a.loaded_at - 2 FROM placed a JOIN placed b ON a.object = b.object AND a.callee = b.k
), slots AS (
  SELECT object, 3 + 2 * count(*) AS slots FROM placed GROUP BY object
)
SELECT object, any_value(slots) AS slots, count(*) AS calls, CAST(sum(imm) AS BIGINT) AS sum_steps, CAST(sum(slot * imm) AS BIGINT) AS sum_places FROM calls JOIN slots USING (object) GROUP BY object"""

QUERIES = {
    "loaded_programs": (loaded_programs, _LOADED_SQL),
    "register_facts": (register_facts, _facts_sql()),
    "kinsn_registers": (kinsn_registers, _kinsn_sql()),
    "spilled_slots": (spilled_slots, _SPILLED_SQL),
    "known_stack_bytes": (known_stack_bytes, _BYTES_SQL),
}
