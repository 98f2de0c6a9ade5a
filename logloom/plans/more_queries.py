"""Queries over messages, source lines, binary instructions, control flow, look-ups at sites, loader logs and the benchmark's harness."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import bytecode as B
from ..functions import evaluation as V
from ..functions import helpers as H
from ..functions import instructions as I
from ..functions import messages as M
from ..functions import proofs
from ..functions import sources as T
from ..operators import cfg, classify, corpus, diagnose, evaluate, harness, loader, rewriting, scoring, sites
from . import projections as P
from .text_queries import _CLASSIFIED


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _has(column: str, words) -> str:
    return "(" + (" OR ".join(f"contains({column}, {_quoted(w)})" for w in words) or "false") + ")"


# ---- messages ----


def message_kinds(spark, d):
    m = F.col("message")
    flags = {"scalar_access": M.is_scalar_access, "packet_end": M.names_packet_end, "arithmetic": M.is_pointer_arithmetic, "bitwise": M.is_pointer_arithmetic_or_bitwise, "context": M.is_context_access}
    a = M.map_value_access(m)
    return P.messages(spark, d).select("log_id", *(f(m).alias(n) for n, f in flags.items()), M.packet_required(m).alias("needed"), F.coalesce(M.ends_behind_value(a), F.lit(False)).alias("behind"), F.coalesce(M.wider_than_value(a), F.lit(False)).alias("wider"), M.zero_based_argument(m, "arg#").cast("long").alias("arg"), M.argument_register_after(m, "arg#").cast("long").alias("arg_register"), M.called_function(m).alias("callee"))


def terminal_dictionary(spark, d):
    rows = P.messages(spark, d).select("log_id", "message", V.dictionary(F.col("message")).alias("p"))
    return rows.select("log_id", "p.error_id", "p.failure_class", V.word_action(F.col("message"), F.col("p.failure_class")).alias("action"))


_FIXES = ("reorder", "null_check", "clamp_index", "use_map_value", "env_fix", "loop_rewrite", "refcount", "initialize_return", "preserve_type", "other", "add_bounds")
_TAGS = ("packet_bounds", "nullable_return", "irq_state", "btf_missing", "verifier_budget", "plain", "stack_bounds")


def label_actions(spark, d):
    rows = P.eval_rows(spark, d)
    fix = F.element_at(F.array(*map(F.lit, _FIXES)), (F.col("case_id") % len(_FIXES) + 1).cast("int"))
    tags = F.array(F.element_at(F.array(*map(F.lit, _TAGS)), (F.col("case_id") % len(_TAGS) + 1).cast("int")), F.lit("x"))
    return rows.select("case_id", V.label_action(F.col("gold"), fix, tags).alias("action"))


def _label_sql() -> str:
    cases = []
    for action, tag_parts, fixes, fix_parts, classes in V.LABEL_ACTIONS:
        if classes == ("reordered",):
            rule = f"(gold = 'source_bug' AND fix = 'reorder' AND NOT {_has('tags', V.NOT_REORDERED)})"
        else:
            rule = " OR ".join(x for x in (_has("tags", tag_parts) if tag_parts else "", f"fix IN ({', '.join(map(_quoted, fixes))})" if fixes else "", _has("fix", fix_parts) if fix_parts else "", f"gold IN ({', '.join(map(_quoted, classes))})" if classes else "") if x)
        cases.append(f"WHEN {rule} THEN '{action}'")
    return f"SELECT case_id, CASE {' '.join(cases)} ELSE 'unspecified' END AS action FROM (SELECT case_id, gold, list_extract({list(_FIXES)}, case_id % {len(_FIXES)} + 1) AS fix, list_extract({list(_TAGS)}, case_id % {len(_TAGS)} + 1) || ' x' AS tags FROM eval_rows)"


def eval_scores(spark, d):
    """How diagnostics do against labels: required proof, place, action, counted."""
    rows = P.eval_rows(spark, d).withColumn("label_id", F.concat(F.lit("E"), (F.col("case_id") % 7).cast("string"))).withColumn("pred_id", F.concat(F.lit("E"), (F.col("case_id") % 5).cast("string")))
    named = lambda c: F.when(c == "action_0", "bounds").when(c == "action_1", "budget").when(c == "action_2", "null").otherwise("unspecified")
    scored = rows.select(V.proof_score(F.col("label_id"), F.col("gold"), named(F.col("gold_action")), F.col("pred_id"), F.col("pred"), named(F.col("pred_action"))).alias("proof"), V.root_score(F.col("root_pc"), F.col("pcs")).alias("root"), V.action_score(named(F.col("gold_action")), named(F.col("pred_action"))).alias("action"))
    return scored.groupBy("proof", "root", "action").agg(F.count("*").alias("n"))


def evaluation_summary(spark, d):
    """Every metric of diagnostics and of a baseline over labelled documents, as counts, with macro-F1 in millionths."""
    e = P.eval_rows(spark, d)
    k = F.col("case_id")
    rows = e.select(
        F.col("gold").alias("taxonomy"), F.col("pred").alias("failure_class"), F.when(k % 2 == 0, F.col("gold")).otherwise("source_bug").alias("baseline_class"), F.concat(F.lit("E"), (k % 5).cast("string")).alias("label_error_id"), F.when(k % 9 == 0, V.UNKNOWN[0]).otherwise(F.concat(F.lit("E"), (k % 7).cast("string"))).alias("error_id"),
        F.lit(V.UNKNOWN[0]).alias("baseline_id"), F.when(k % 3 == 0, "unspecified").otherwise(F.col("gold_action")).alias("label_action"), F.coalesce("pred_action", F.lit("other")).alias("action"), F.lit("action_1").alias("prose_action"), F.lit("action_0").alias("baseline_action"), "root_pc", "pcs", (k % 4 > 0).alias("primary_span"), (k % 3).cast("int").alias("related"),
    )
    f1 = scoring.macro_f1(rows, "failure_class").select(F.lit(99).alias("place"), F.lit("macro-F1").alias("metric"), F.round(F.col("f1") * 1_000_000).cast("long").alias("hits"), F.lit(0).cast("long").alias("baseline_hits"), F.lit(1_000_000).cast("long").alias("total"))
    return scoring.counted(rows).unionByName(f1).drop("place")


_EVALUATION_SQL = """e AS (
  SELECT *, CASE WHEN case_id % 2 = 0 THEN gold ELSE 'source_bug' END AS bclass, 'E' || (case_id % 5) AS lid, CASE WHEN case_id % 9 = 0 THEN 'UNKNOWN' ELSE 'E' || (case_id % 7) END AS eid,
         CASE WHEN case_id % 3 = 0 THEN 'unspecified' ELSE gold_action END AS la, coalesce(pred_action, 'other') AS action FROM eval_rows
), m(metric, a, b, t) AS (
  SELECT 'known error id', count(*) FILTER (WHERE eid <> 'UNKNOWN'), 0, count(*) FROM e
  UNION ALL SELECT 'error-id exact', count(*) FILTER (WHERE eid = lid), 0, count(*) FROM e
  UNION ALL SELECT 'taxonomy agreement', count(*) FILTER (WHERE pred = gold), count(*) FILTER (WHERE bclass = gold), count(*) FROM e
  UNION ALL SELECT name, count(*) FILTER (WHERE gold = c AND pred = c), count(*) FILTER (WHERE gold = c AND bclass = c), count(*) FILTER (WHERE gold = c)
    FROM (VALUES ('lowering-artifact recall', 'lowering_artifact'), ('environment recall', 'environment_or_configuration'), ('verifier-false-positive recall', 'verifier_false_positive'), ('verifier-limit recall', 'verifier_limit')) v(name, c), e GROUP BY name
  UNION ALL SELECT 'primary span emitted', count(*) FILTER (WHERE case_id % 4 > 0), 0, count(*) FROM e
  UNION ALL SELECT 'related proof spans emitted', count(*) FILTER (WHERE case_id % 3 > 0), 0, count(*) FROM e
  UNION ALL SELECT 'root pc exact', count(*) FILTER (WHERE list_contains(pcs, root_pc)), 0, count(root_pc) FROM e
  UNION ALL SELECT 'root pc within 5', count(*) FILTER (WHERE abs(pcs[1] - root_pc) <= 5 OR abs(pcs[2] - root_pc) <= 5), 0, count(root_pc) FROM e
  UNION ALL SELECT 'next-action exact', count(*) FILTER (WHERE la <> 'unspecified' AND action = la), count(*) FILTER (WHERE la = 'action_0'), count(*) FILTER (WHERE la <> 'unspecified') FROM e
  UNION ALL SELECT 'prose-action exact', count(*) FILTER (WHERE la = 'action_1'), count(*) FILTER (WHERE la = 'action_0'), count(*) FILTER (WHERE la <> 'unspecified') FROM e
  UNION ALL SELECT 'macro-F1', CAST(round(sum(CASE WHEN g + p > 0 THEN 2.0 * tp / (g + p) ELSE 0 END) / 5 * 1000000) AS BIGINT), 0, 1000000
    FROM (SELECT c, count(*) FILTER (WHERE gold = c) AS g, count(*) FILTER (WHERE pred = c) AS p, count(*) FILTER (WHERE gold = c AND pred = c) AS tp FROM (VALUES ('source_bug'), ('lowering_artifact'), ('environment_or_configuration'), ('verifier_false_positive'), ('verifier_limit')) v(c), e GROUP BY c)
)"""


def fallback_gate(spark, d):
    """Logs that the rules leave without a class, and whether the gate lets the corpus pass."""
    found = classify.classified(P.messages(spark, d))
    return evaluate.fallback_rows(found).groupBy("error_id", "failure_class").agg(F.count("*").alias("n")).crossJoin(evaluate.fallback_gate(found))


def prose_actions(spark, d):
    o = F.col("obligation")
    found = classify.classified(P.messages(spark, d))
    return found.groupBy("obligation", "failure_class").agg(F.count("*").alias("n")).select("obligation", "n", V.diagnostic_action(F.lit(None).cast("string"), F.array(F.lit("check it")), proofs.default_required(o), proofs.default_rejected(o), F.col("failure_class")).alias("prose"), diagnose.next_action(F.col("failure_class"), o).alias("next_action"))


def obligation_texts(spark, d):
    found = classify.classified(P.messages(spark, d)).groupBy("obligation").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(proofs.dimension(spark)), "obligation").select("obligation", "n", "label", "required", "rejected")


def packet_proofs(spark, d):
    m = F.col("message")
    return classify.classified(P.messages(spark, d)).where("obligation = 'PacketBounds'").select("log_id", proofs.packet_bounds(m, M.register(m)).alias("p")).select("log_id", "p.required", "p.rejected")


def nullable_proofs(spark, d):
    m = F.col("message")
    none = F.lit(None).cast("struct<reg_type:string,exact:decimal(20,0),smin:bigint,smax:bigint,umin:decimal(20,0),umax:decimal(20,0),off:int,map_value_size:int>")
    found = classify.classified(P.messages(spark, d)).where(F.col("obligation").isin("NullablePointer", "ReferenceLifecycle", "StackInitialized"))
    return found.select("log_id", proofs.required_proof(m, F.lit(None).cast("string"), F.col("obligation"), M.register(m), none).alias("p")).select("log_id", "p.required", "p.rejected")


# ---- helpers, instructions, bytecode ----


def helper_roles(spark, d):
    """The registers that each call passes by role, by a broadcast join with the dimension."""
    names = sorted({h for entries in H.ROLES.values() for helpers, _, _ in entries for h in helpers})
    rows = P.table(spark, d, "lineitem").select(F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % len(names) + 1).cast("int")).alias("helper")).groupBy("helper").agg(F.count("*").alias("n"))
    by_column = F.coalesce(H.stack_output_pair(F.col("helper")).first, F.lit(0)) + F.coalesce(H.scalar_length_register(F.col("helper")), F.lit(0))
    return rows.join(F.broadcast(H.dimension(spark)), "helper").select("helper", "role", "n", F.col("first_register").cast("long").alias("first"), F.col("second_register").cast("long").alias("second"), by_column.cast("long").alias("looked_up"))


def instruction_details(spark, d):
    t, one, two = F.col("tail"), F.lit(1), F.lit(2)
    rows = P.instruction_lines(spark, d).select(I.tail(F.col("line")).alias("tail")).where("tail is not null")
    rows = rows.select(I.opcode(t).alias("opcode"), I.assigns(t, one).alias("assigns"), I.uses(t, two).alias("uses"), I.single_source(t).alias("source"), I.adds(t, one, two).alias("adds"), I.direct_call_target(t).alias("called"), I.is_exit(t).alias("exits"), I.is_atomic(t).alias("atomic"))
    return rows.groupBy("opcode").agg(F.count_if("assigns").alias("assigns_r1"), F.count_if("uses").alias("uses_r2"), F.sum("source").alias("sum_source"), F.count_if("adds").alias("adds_r2_to_r1"), F.countDistinct("called").alias("called"), F.count_if(F.col("exits") | F.col("atomic")).alias("others"))


_CODES = (0x05, 0x15, 0x85, 0x95, 0xB7, 0xBF, 0x0F, 0x61, 0x7B, 0x18, 0x06)


def _programs(spark, d):
    """(program, pc, insn): an instruction for each line item, two slots wide where the code says so."""
    items = P.table(spark, d, "lineitem")
    code = F.element_at(F.array(*map(F.lit, _CODES)), (F.col("l_partkey") % len(_CODES) + 1).cast("int"))
    regs = (F.col("l_suppkey") % 3) * 16 + F.col("l_partkey") % 10
    hexed = F.format_string("%02x%02x%02x00%02x000000", code, regs, F.col("l_suppkey") % 3, F.col("l_partkey") % 2)
    rows = items.select(F.col("l_orderkey").alias("program"), B.decoded(F.unhex(hexed)).alias("insn"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*P.ORDER.split(", "))).alias("n"))
    w = Window.partitionBy("program").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("pc", F.coalesce(F.sum(B.width(F.col("insn.code"))).over(w), F.lit(0)).cast("int")).select("program", "pc", "insn")


_PROGRAMS = f"""items AS (SELECT l_orderkey AS program, row_number() OVER (PARTITION BY l_orderkey ORDER BY {P.ORDER}) AS n, list_extract({list(_CODES)}, l_partkey % {len(_CODES)} + 1) AS code, l_partkey % 10 AS dst, l_suppkey % 3 AS src, l_suppkey % 3 AS off, l_partkey % 2 AS imm FROM lineitem),
programs AS (SELECT *, CAST(coalesce(sum(CASE WHEN code = 24 THEN 2 ELSE 1 END) OVER (PARTITION BY program ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS pc,
  CASE WHEN code IN (5, 21) THEN off WHEN code = 6 THEN imm END AS delta, CASE WHEN code = 133 AND src = 1 THEN imm END AS callee, code IN (5, 21, 6, 149) OR (code = 133 AND src = 1) AS ends FROM items),
starts AS (SELECT DISTINCT program, unnest([CASE WHEN pc = 0 THEN 0 END, pc + 1 + delta, pc + 1 + callee, CASE WHEN ends THEN pc + 1 END]) AS pc FROM programs),
inside AS (SELECT s.program, s.pc FROM starts s JOIN programs p ON s.program = p.program AND s.pc = p.pc)"""


def bytecode_decode(spark, d):
    i = F.col("insn")
    rows = _programs(spark, d).select(i["code"].alias("code"), i["dst"].alias("dst"), i["src"].alias("src"), B.branch_delta(i).alias("delta"), B.is_conditional(i["code"]).alias("conditional"), B.width(i["code"]).alias("width"), F.size(B.uses(i)).alias("n_uses"), F.size(B.defs(i)).alias("n_defs"), B.map_pseudo(i).alias("map"), B.relative_target(i, F.lit(0)).alias("target"))
    return rows.groupBy("code").agg(F.count("*").alias("n"), F.sum("dst").alias("sum_dst"), F.sum("src").alias("sum_src"), F.sum("delta").alias("sum_delta"), F.bool_or("conditional").alias("conditional"), F.sum("width").alias("slots"), F.sum("n_uses").alias("uses"), F.sum("n_defs").alias("defs"), F.count("map").alias("maps"), F.count("target").alias("targets")).withColumn("code", F.col("code").cast("long"))


def cfg_blocks(spark, d):
    """Blocks of each program and what they end with."""
    found = cfg.blocks(_programs(spark, d))
    return found.groupBy("program").agg(F.count("*").alias("blocks"), F.sum("start").alias("sum_starts"), (F.max("frame") + 1).cast("long").alias("functions"), F.count_if(F.col("terminator") == "fallthrough").alias("falls"))


def cfg_edges(spark, d):
    """Edges between blocks by kind."""
    return cfg.successors(cfg.blocks(_programs(spark, d))).groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("dst") - F.col("src")).cast("long").alias("sum_steps"))


def map_binding_order(spark, d):
    """Maps in the order in which each program names them first (the second operand says how)."""
    rows = _programs(spark, d).withColumn("insn", F.col("insn").withField("imm", F.col("insn.dst")))
    found = cfg.map_bindings(rows)
    return found.groupBy("program").agg(F.count("*").alias("loads"), (F.max("map_index") + 1).cast("long").alias("maps"), F.sum("map_index").cast("long").alias("sum_index"))


def compacted_programs(spark, d):
    """Slots, jumps and blocks' first instructions of each program without unreachable code and needless jumps."""
    rows = _programs(spark, d)
    out = rewriting.compacted(rows.withColumn("high", F.lit(None).cast("int")))
    code = F.col("insn.code")
    return out.groupBy("program").agg(F.sum(B.width(code)).cast("long").alias("slots"), F.count_if(B.is_jump(code)).alias("jumps"), F.sum("old_pc").cast("long").alias("sum_old_pcs"), F.sum(B.branch_delta(F.col("insn"))).cast("long").alias("sum_deltas"))


# ---- sources ----

_SOURCES = ("if (p%d + 4 > data_end) return 0;", "if (!val%d) return 0;", "u8 *q%d = data + off%d;", "x%d = bpf_map_lookup_elem(&map%d, (void *)&key);", "bpf_ringbuf_submit(e%d, 0);", "int total_%d = 12; /* memset */", "for (i = 0; i < %d; i++) sum += buf[i];")


def _source_lines(spark, d):
    cases = " ".join(f"WHEN {k} THEN format_string({_quoted(s)}{', CAST(l_suppkey AS BIGINT)' * s.count('%d')})" for k, s in enumerate(_SOURCES))
    return P.table(spark, d, "lineitem").select(F.expr(f"CASE l_partkey % {len(_SOURCES)} {cases} END").alias("text"), (F.col("l_partkey") % len(_SOURCES)).alias("form"))


_SOURCE_LINES = "source_lines AS (SELECT l_partkey % {n} AS form, CASE l_partkey % {n} {cases} END AS text FROM lineitem)".format(n=len(_SOURCES), cases=" ".join(f"WHEN {k} THEN printf({_quoted(s)}{', l_suppkey' * s.count('%d')})" for k, s in enumerate(_SOURCES)))


def source_heuristics(spark, d):
    t = F.col("text")
    flags = {"guard": T.is_scalar_guard, "packet_check": T.is_packet_check, "null_check": T.is_null_check, "nullable": T.is_nullable_return, "initializes": T.is_stack_initialization, "acquires": T.is_acquire, "releases": T.is_release, "derives": T.is_packet_derivation}
    rows = _source_lines(spark, d).select("form", *(f(t).alias(n) for n, f in flags.items()), F.size(T.numbers(t)).alias("numbers"), T.largest_number(t).alias("largest"), F.size(T.identifiers(t)).alias("names"), T.call_argument(t, "bpf_map_lookup_elem", 1).alias("argument"), T.is_bare_identifier(T.call_argument(t, "bpf_map_lookup_elem", 0)).alias("bare"))
    return rows.groupBy("form").agg(*(F.count_if(n).alias(n) for n in flags), F.sum("numbers").alias("numbers"), F.max("largest").alias("largest"), F.sum("names").alias("names"), F.min("argument").alias("argument"), F.count_if("bare").alias("bare"))


def quoted_pcs(spark, d):
    """The instructions below each quoted source line."""
    body = P.instruction_lines(spark, d)
    lines = body.select("log_id", (F.col("line_no") * 2).alias("line_no"), "line").unionByName(body.where("line_no % 3 = 1").select("log_id", (F.col("line_no") * 2 - 1).alias("line_no"), F.concat(F.lit("; x = "), (F.col("log_id") % 7).cast("string"), F.lit(" ; @ a.c:"), F.col("line_no").cast("string")).alias("line")))
    found = corpus.quoted_pcs(lines)
    return found.groupBy("comment").agg(F.count("*").alias("n"), F.countDistinct("pc").alias("pcs"), F.max(F.length(corpus.compact(F.col("comment")))).cast("long").alias("chars"))


# ---- look-ups at sites ----


def site_registers(spark, d):
    """The state of a register before each error, in the frame of the latest state there."""
    s = P.states(spark, d)
    long = s.select("log_id", "log_line", "pc", "frame", "reg", F.struct("event_id", F.lit(None).cast("int").alias("source_frame")).alias("state"))
    points = s.where("event_type = 'error'").select("log_id", F.col("event_id").alias("point_id"), F.col("log_line").alias("p_line"), F.col("pc").alias("p_pc"), F.lit(2).alias("p_from"), "reg")
    out = sites.registers_before(points, s, long)
    return out.select("point_id", F.col("seen.state.event_id").alias("state_id"), F.col("seen.frame").alias("frame"))


def slot_targets(spark, d):
    """What each order's access meets in its newest state: a target slot that covers its start or lies inside."""
    slots = P.slots(spark, d).select(F.col("order_id").alias("log_id"), F.col("state_id").alias("log_line"), F.lit(0).alias("pc"), "frame", F.array(F.lit(2).cast("long")).alias("ref_ids"), F.col("s_start").alias("slot_off"), F.lit(None).cast("string").alias("slot_types"), F.struct(F.when(F.col("initialized"), "dynptr_x").otherwise("scalar").alias("reg_type"), F.lit(2).alias("ref_id")).alias("slot"))
    start = -8 * (F.col("o_custkey") % 64 + 1)
    accesses = P.table(spark, d, "orders").select(F.col("o_orderkey").alias("log_id"), F.lit("a").alias("access_id"), start.alias("a_start"), (start + 64).alias("a_end"), (F.col("o_custkey") % 3).alias("a_frame"), F.lit(1).alias("a_from"), F.lit(None).cast("long").alias("a_pc"), F.lit(100).alias("a_line"), F.lit("dynptr").alias("a_type"), F.lit(16).alias("a_size"))
    return sites.slot_overlaps(accesses, slots).select("log_id", F.col("at_line").cast("long").alias("at_line"), F.col("target").cast("long").alias("target"), F.col("any_live").cast("long").alias("live"))


def loader_sections(spark, d):
    """The section of the program whose log begins last before a line, from a loader's log for each supplier."""
    s = P.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    texts = ("libbpf: loading object 'o%d'", "libbpf: sec 'tp/a%d': found program 'p%d'", "libbpf: sec 'xdp%d': found program 'q'", "libbpf: prog 'p%d': relo #%d: <byte_off> [1] struct sock%d.x", "libbpf: prog 'p%d': relo #%d: patched insn #3 (LDX) off 8 -> 8", "libbpf: prog 'p%d': -- BEGIN PROG LOAD LOG --")
    rows = F.array(*(F.struct(F.lit(n).alias("line_no"), F.format_string(t, *([F.col("k")] * t.count("%d"))).alias("line")) for n, t in enumerate(texts, 1)))
    lines = s.select(F.col("k").alias("log_id"), F.explode(rows).alias("r")).select("log_id", "r.*")
    scopes = loader.program_scopes(lines, s.select(F.col("k").alias("log_id"), F.lit(9).alias("before_line")))
    structs = loader.relocated_structs(lines, scopes, s.select(F.col("k").alias("log_id"), F.lit(3).alias("pc"), F.lit(8).alias("offset")))
    return loader.program_sections(lines, scopes).join(structs, "log_id").select("log_id", "program", F.col("window_start").cast("long").alias("window_start"), "section", "relocated_struct")


# ---- the harness ----


def prompt_digests(spark, d):
    cases = P.table(spark, d, "benchmark").select(F.col("item_id").alias("case_id"), F.col("text").alias("source"), F.concat(F.lit("a\nx BEGIN PROG LOAD LOG y\n"), "text", F.lit("\n-- END PROG LOAD LOG -- z\nb")).alias("log"), F.lit("error[E1]: x").alias("diagnostic"))
    return harness.prompt_rows(cases).select("case_id", "mode", "sha256", F.col("chars").cast("long").alias("chars"))


def checked_stages(spark, d):
    """Where each run failed first, by the checker's report."""
    r = P.runs(spark, d)
    code = F.when(F.col("stage") == "compile", 1).otherwise(0)
    load = F.when(F.col("stage") == "load", 1).otherwise(0)
    passed = F.when(F.col("stage") == "functional", "false").otherwise("true")
    report = F.format_string('{"compile": {"returncode": %d}, "load": {"returncode": %d, "stderr": "no"}, "functional": [{"name": "f", "passed": %s}]}', code, load, passed)
    stage = harness.failure_stage(F.when(F.col("status") == "pass", 0).otherwise(1), F.when(F.col("case_id") % 11 == 3, "not json").otherwise(report))
    return r.select(stage.alias("stage"), harness.stage_of(F.lit(None).cast("string"), F.col("status")).alias("by_status")).groupBy("stage", "by_status").agg(F.count("*").alias("n"))


def extracted_sources(spark, d):
    text = F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("see\n```c\n"), "text", F.lit("\n```\nend"))).otherwise(F.col("text"))
    rows = P.table(spark, d, "conversations").select("conv_id", "turn", harness.extracted_source(text).alias("s"), harness.truncated(F.col("text"), 60).alias("short"))
    return rows.groupBy(F.col("s").isNotNull().alias("found")).agg(F.count("*").alias("n"), F.sum(F.length("s")).alias("chars"), F.sum(F.length("short")).alias("short"))


def explained(spark, d):
    """The whole diagnostic of each log: class, signal, action, required proof, text."""
    out = diagnose.explained(P.logs(spark, d).select("log_id", F.col("line_no").cast("int").alias("line_no"), "line"))
    return out.select("log_id", "error_id", "failure_class", "obligation", "signal", "next_action", "span_confidence", "required", "text")


_ROLE_ROWS = ", ".join(f"('{h}', '{r}', {a}, {'NULL' if b is None else b})" for r, entries in H.ROLES.items() for helpers, a, b in entries for h in helpers)
_HELPERS = sorted({h for entries in H.ROLES.values() for helpers, _, _ in entries for h in helpers})
_DICTIONARY = " ".join(f"WHEN {_has('low', w)} THEN {k}" for k, (_, _, w) in enumerate(V.DICTIONARY))
_R = "nullif(regexp_extract(message, 'R([0-9]+)', 1), '')"
_N = lambda mark, c="message": f"TRY_CAST(nullif(regexp_extract({c}, '(?:^|[^A-Za-z0-9_]){mark}([+-]?[0-9]+)', 1), '') AS BIGINT)"
_PROMPT = "'Fix the rejection of this program and return its whole source in a fenced ```c block. Keep its programs, maps, sections and license.' || chr(10) || chr(10) || 'Source file:' || chr(10) || '```c' || chr(10) || text || chr(10) || '```' || chr(10)"
_SHOWN = lambda label, body: f"chr(10) || '{label}:' || chr(10) || '```text' || chr(10) || {body} || chr(10) || '```' || chr(10)"
_OBLIGATION_ROWS = ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in proofs.OBLIGATIONS)

QUERIES = {
    "message_kinds": (message_kinds, P.sql(P.MESSAGES, query=f"""SELECT log_id, {_has("low", ("invalid mem access 'scalar'", "invalid mem access 'inv'"))} AS scalar_access, {_has("low", ("pkt_end", "ptr_to_packet_end"))} AS packet_end, contains(low, 'pointer arithmetic') AS arithmetic,
  {_has("low", ("pointer arithmetic", "bitwise operator"))} AS bitwise, {_has("low", ("invalid bpf_context access", "invalid ctx access", "invalid access to context"))} AS context, CASE WHEN {_N("off=")} + {_N("size=")} >= 0 THEN {_N("off=")} + {_N("size=")} END AS needed,
  coalesce(contains(low, 'invalid access to map value') AND {_N("off=")} + {_N("size=")} > {_N("value_size=")}, false) AS behind, coalesce(contains(low, 'invalid access to map value') AND {_N("size=")} > {_N("value_size=")}, false) AS wider,
  CASE WHEN {_N("arg#")} < 5 THEN {_N("arg#")} END AS arg, CASE WHEN {_N("arg#")} < 5 THEN {_N("arg#")} + 1 END AS arg_register, nullif(regexp_extract(message, '\\(''([^'']*)''\\)', 1), '') AS callee FROM (SELECT *, lower(message) AS low FROM messages)""")),
    "terminal_dictionary": (terminal_dictionary, P.sql(P.MESSAGES, query=f"""SELECT log_id, coalesce(list_extract({[i for i, _, _ in V.DICTIONARY]}, k + 1), 'UNKNOWN') AS error_id, cls AS failure_class,
  CASE cls WHEN 'environment_or_configuration' THEN 'environment' WHEN 'verifier_limit' THEN 'budget' ELSE CASE {" ".join(f"WHEN {_has('low', w)} THEN '{a}'" for a, w in V.WORD_ACTIONS)} ELSE 'unspecified' END END AS action
FROM (SELECT *, coalesce(list_extract({[c for _, c, _ in V.DICTIONARY]}, k + 1), 'source_bug') AS cls FROM (SELECT log_id, lower(message) AS low, CASE {_DICTIONARY.replace("low", "lower(message)")} END AS k FROM messages))""")),
    "label_actions": (label_actions, P.sql(P.EVAL_ROWS, query=_label_sql())),
    "eval_scores": (eval_scores, P.sql(P.EVAL_ROWS, query="""SELECT proof, root, action, count(*) AS n FROM (
  SELECT CASE WHEN case_id % 7 = case_id % 5 THEN 'exact' WHEN pred = gold OR (ga <> 'unspecified' AND pa = ga) THEN 'partial' ELSE 'miss' END AS proof,
    CASE WHEN root_pc IS NULL THEN 'na' WHEN list_contains(pcs, root_pc) THEN 'exact' WHEN abs(pcs[1] - root_pc) <= 5 OR abs(pcs[2] - root_pc) <= 5 THEN 'near' ELSE 'miss' END AS root,
    CASE WHEN ga = 'unspecified' THEN 'na' WHEN pa = ga THEN 'correct' WHEN (ga = 'budget' AND pa IN ('bounds', 'null')) OR (ga IN ('bounds', 'null') AND pa = 'budget') THEN 'unsafe' ELSE 'partial' END AS action
  FROM (SELECT *, CASE gold_action WHEN 'action_0' THEN 'bounds' WHEN 'action_1' THEN 'budget' WHEN 'action_2' THEN 'null' ELSE 'unspecified' END AS ga, CASE pred_action WHEN 'action_0' THEN 'bounds' WHEN 'action_1' THEN 'budget' WHEN 'action_2' THEN 'null' ELSE 'unspecified' END AS pa FROM eval_rows)
) GROUP BY 1, 2, 3""")),
    "evaluation_summary": (evaluation_summary, P.sql(P.EVAL_ROWS, _EVALUATION_SQL, query="SELECT metric, CAST(a AS BIGINT) AS hits, CAST(b AS BIGINT) AS baseline_hits, CAST(t AS BIGINT) AS total FROM m")),
    "fallback_gate": (fallback_gate, P.sql(P.MESSAGES, _CLASSIFIED, query="SELECT error_id, failure_class, count(*) AS n, sum(count(*)) OVER () AS failures, sum(count(*)) OVER () = 0 AS passed FROM classified WHERE error_id IN ('E099', 'UNKNOWN') GROUP BY 1, 2")),
    "prose_actions": (prose_actions, None),
    "obligation_texts": (obligation_texts, P.sql(P.MESSAGES, _CLASSIFIED, query=f"SELECT c.obligation, n, label, required, rejected FROM (SELECT obligation, count(*) AS n FROM classified GROUP BY 1) c JOIN (VALUES {_OBLIGATION_ROWS}) t(obligation, label, required, rejected) ON c.obligation = t.obligation")),
    "packet_proofs": (packet_proofs, P.sql(P.MESSAGES, _CLASSIFIED, query=f"""SELECT log_id, 'prove R' || r || ' has packet range at least ' || need || ' bytes before this access; verifier currently has range ' || known AS required,
  'rejected here: verifier needs R' || r || ' packet range >= ' || need || ', but only ' || known || ' bytes are proven' AS rejected FROM (SELECT log_id, {_R} AS r, {_N("off=")} + {_N("size=")} AS need, {_N("r=")} AS known FROM classified WHERE obligation = 'PacketBounds')""")),
    "nullable_proofs": (nullable_proofs, P.sql(P.MESSAGES, _CLASSIFIED, query=f"""SELECT log_id, coalesce(CASE obligation WHEN 'NullablePointer' THEN 'prove R' || r || ' is non-null in the same verifier-visible branch before dereference, pointer arithmetic, or helper reuse' WHEN 'ReferenceLifecycle' THEN 'release verifier-tracked reference id ' || i || ' on every path before exit'
    ELSE 'initialize every stack byte reachable from R' || r || ' before it is read or passed to a helper' END, required) AS required,
  coalesce(CASE obligation WHEN 'NullablePointer' THEN 'rejected here: R' || r || ' is still nullable at the use site' WHEN 'ReferenceLifecycle' THEN 'rejected here: reference id ' || i || ' is not released on every path' ELSE 'rejected here: stack memory reachable from R' || r || ' is not fully initialized' END, rejected) AS rejected
FROM (SELECT c.log_id, c.obligation, {_R.replace("message", "c.message")} AS r, {_N("id=", "c.message")} AS i, t.required, t.rejected FROM classified c JOIN (VALUES {_OBLIGATION_ROWS}) t(obligation, label, required, rejected) ON c.obligation = t.obligation WHERE c.obligation IN ('NullablePointer', 'ReferenceLifecycle', 'StackInitialized'))""")),
    "helper_roles": (helper_roles, f"""WITH roles(helper, role, a, b) AS (VALUES {_ROLE_ROWS}), calls AS (SELECT list_extract({_HELPERS}, l_partkey % {len(_HELPERS)} + 1) AS helper, count(*) AS n FROM lineitem GROUP BY 1)
SELECT c.helper, r.role, n, CAST(a AS BIGINT) AS first, CAST(b AS BIGINT) AS second, CAST(coalesce((SELECT max(a) FROM roles x WHERE x.helper = c.helper AND x.role = 'stack_output'), 0) + coalesce((SELECT max(a) FROM roles x WHERE x.helper = c.helper AND x.role = 'scalar_length'), 0) AS BIGINT) AS looked_up FROM calls c JOIN roles r ON c.helper = r.helper"""),
    "instruction_details": (instruction_details, P.sql(P.INSTRUCTION_LINES, query=r"""SELECT regexp_extract(tail, '^\(([0-9a-f]{2})\)', 1) AS opcode, count(*) FILTER (WHERE regexp_matches(tail, '^\([0-9a-f]{2}\) [rw]1 ')) AS assigns_r1, count(*) FILTER (WHERE regexp_matches(tail, '(^|[^A-Za-z0-9])r2([^A-Za-z0-9]|$)')) AS uses_r2,
  sum(TRY_CAST(nullif(regexp_extract(tail, '^\(bf\) r[0-9]+ = r([0-9]+)$', 1), '') AS BIGINT)) AS sum_source, count(*) FILTER (WHERE regexp_matches(tail, ' r1 \+= r2$')) AS adds_r2_to_r1, count(DISTINCT nullif(regexp_extract(tail, '^\(85\) call ([^\s#]+)', 1), '')) AS called, CAST(0 AS BIGINT) AS others
FROM (SELECT regexp_extract(line, '^\s*[0-9]+:\s*(\([0-9a-f]{2}\).*)$', 1) AS tail FROM instruction_lines) WHERE tail <> '' GROUP BY 1""")),
    "bytecode_decode": (bytecode_decode, P.sql(_PROGRAMS, query="""SELECT code, count(*) AS n, sum(dst) AS sum_dst, sum(src) AS sum_src, sum(delta) AS sum_delta, code = 21 AS conditional, sum(CASE WHEN code = 24 THEN 2 ELSE 1 END) AS slots,
  sum(CASE code WHEN 133 THEN 5 WHEN 149 THEN 1 WHEN 21 THEN 1 WHEN 191 THEN 1 WHEN 15 THEN CASE WHEN dst = src THEN 1 ELSE 2 END WHEN 97 THEN 1 WHEN 123 THEN CASE WHEN dst = src THEN 1 ELSE 2 END ELSE 0 END) AS uses,
  sum(CASE code WHEN 133 THEN 6 WHEN 183 THEN 1 WHEN 191 THEN 1 WHEN 15 THEN 1 WHEN 97 THEN 1 WHEN 24 THEN 1 ELSE 0 END) AS defs, count(*) FILTER (WHERE code = 24 AND src IN (1, 2)) AS maps, count(callee) AS targets FROM programs GROUP BY code""".replace("src IN (1, 2)", "src IN (1, 2, 5, 6)"))),
    "cfg_blocks": (cfg_blocks, P.sql(_PROGRAMS, query="""SELECT program, count(*) AS blocks, sum(start) AS sum_starts, any_value(functions) AS functions, count(*) FILTER (WHERE NOT ends AND NOT final) AS falls FROM (
  SELECT b.program, min(b.pc) AS start, arg_max(b.ends, b.pc) AS ends, b.block = max(b.block) OVER (PARTITION BY b.program) AS final, any_value(f.functions) AS functions FROM (
    SELECT p.program, p.pc, p.ends, count(i.pc) OVER (PARTITION BY p.program ORDER BY p.pc) AS block FROM programs p LEFT JOIN inside i ON p.program = i.program AND p.pc = i.pc) b
  JOIN (SELECT program, count(*) AS functions FROM (SELECT DISTINCT program, pc FROM (SELECT program, 0 AS pc FROM programs UNION SELECT p.program, p.pc + 1 + p.callee FROM programs p JOIN programs q ON p.program = q.program AND q.pc = p.pc + 1 + p.callee WHERE p.callee IS NOT NULL)) GROUP BY 1) f ON b.program = f.program
  GROUP BY b.program, b.block) GROUP BY program""")),
    "cfg_edges": (cfg_edges, P.sql(_PROGRAMS, query="""
, numbered AS (SELECT p.*, count(i.pc) OVER (PARTITION BY p.program ORDER BY p.pc) - 1 AS block FROM programs p LEFT JOIN inside i ON p.program = i.program AND p.pc = i.pc),
blocks AS (SELECT program, block, min(pc) AS start, max(pc) AS last, arg_max(code, pc) AS code, arg_max(src, pc) AS src, arg_max(delta, pc) AS delta, arg_max(callee, pc) AS callee, arg_max(ends, pc) AS ends FROM numbered GROUP BY 1, 2),
tos AS (SELECT program, block, last + 1 + delta AS start, CASE WHEN code IN (5, 6) THEN 'jump' ELSE 'taken' END AS kind FROM blocks WHERE code IN (5, 6, 21) UNION ALL SELECT program, block, last + 1, 'fallthrough' FROM blocks WHERE code = 21
  UNION ALL SELECT program, block, last + 1 + callee, 'callee' FROM blocks WHERE callee IS NOT NULL UNION ALL SELECT program, block, last + 1, 'return' FROM blocks WHERE callee IS NOT NULL UNION ALL SELECT program, block, last + CASE WHEN code = 24 THEN 2 ELSE 1 END, 'fallthrough' FROM blocks WHERE NOT ends)
SELECT kind, count(*) AS n, CAST(sum(b.block - t.block) AS BIGINT) AS sum_steps FROM tos t JOIN blocks b ON t.program = b.program AND t.start = b.start GROUP BY 1""".replace("\n, numbered", ", numbered", 1))),
    "compacted_programs": (compacted_programs, None),
    "map_binding_order": (map_binding_order, P.sql(_PROGRAMS, query="""SELECT program, count(*) AS loads, max(k) AS maps, CAST(sum(k - 1) AS BIGINT) AS sum_index FROM (SELECT program, dense_rank() OVER (PARTITION BY program ORDER BY first) AS k FROM (SELECT program, min(pc) OVER (PARTITION BY program, dst) AS first FROM programs WHERE code = 24 AND src IN (1, 2, 5, 6))) GROUP BY 1""")),
    "source_heuristics": (source_heuristics, P.sql(_SOURCE_LINES, query=r"""SELECT form, count(*) FILTER (WHERE form = 0) AS guard, count(*) FILTER (WHERE form = 0) AS packet_check, count(*) FILTER (WHERE form = 1) AS null_check, count(*) FILTER (WHERE form = 3) AS nullable,
  count(*) FILTER (WHERE contains(text, '=') AND (contains(text, '0') OR contains(text, 'memset'))) AS initializes, CAST(0 AS BIGINT) AS acquires, count(*) FILTER (WHERE form = 4) AS releases, count(*) FILTER (WHERE form = 2) AS derives,
  sum(len(regexp_extract_all(text, '[0-9]+'))) AS numbers, max(list_max(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: CAST(x AS BIGINT)))) AS largest,
  sum(len(list_filter(regexp_extract_all(text, '[A-Za-z0-9_]+'), lambda w: (length(w) >= 2 OR w IN ('i', 'j', 'k')) AND NOT regexp_matches(w, '^[0-9]') AND w NOT IN ('if', 'void', 'char', 'unsigned', 'int', '__u8', '__u16', '__u32', '__u64', 'data', 'data_end', 'byte')))) AS names,
  CASE WHEN form = 3 THEN '(void *)&key' END AS argument, CAST(0 AS BIGINT) AS bare FROM source_lines GROUP BY form""")),
    "quoted_pcs": (quoted_pcs, P.sql(P.INSTRUCTION_LINES, query=r"""SELECT comment, count(*) AS n, count(DISTINCT pc) AS pcs, max(length(regexp_replace(comment, '\s', '', 'g'))) AS chars FROM (
  SELECT pc, last_value(comment IGNORE NULLS) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS comment FROM (
    SELECT log_id, line_no * 2 AS line_no, TRY_CAST(regexp_extract(line, '^\s*([0-9]+):', 1) AS BIGINT) AS pc, CAST(NULL AS VARCHAR) AS comment FROM instruction_lines UNION ALL SELECT log_id, line_no * 2 - 1, NULL, 'x = ' || (log_id % 7) || ' ;' FROM instruction_lines WHERE line_no % 3 = 1)
) WHERE pc IS NOT NULL GROUP BY 1""")),
    "site_registers": (site_registers, P.sql(P.STATES, query="""WITH_POINTS SELECT p.event_id AS point_id, arg_max(s.event_id, s.log_line) AS state_id, arg_max(s.frame, s.log_line) AS frame FROM points p
LEFT JOIN states s ON s.log_id = p.log_id AND s.reg = p.reg AND s.log_line >= 2 AND s.log_line < p.log_line AND s.pc <= p.pc AND (p.f IS NULL OR s.frame = p.f) GROUP BY 1""".replace("WITH_POINTS ", "")).replace("\nSELECT p.event_id", ", points AS (SELECT e.event_id, e.log_id, e.log_line, e.pc, e.reg, arg_max(s.frame, s.log_line) AS f FROM states e LEFT JOIN states s ON s.log_id = e.log_id AND s.log_line >= 2 AND s.log_line < e.log_line AND s.pc <= e.pc WHERE e.event_type = 'error' GROUP BY ALL)\nSELECT p.event_id", 1)),
    "slot_targets": (slot_targets, P.sql(P.SLOTS, query="""SELECT log_id, at_line, max(CAST(initialized AND ((s_start <= a_start AND a_start < e) OR (s_start >= a_start AND e <= a_start + 64)) AS BIGINT)) AS target, max(CAST(initialized AS BIGINT)) AS live FROM (
  SELECT *, max(state_id) OVER (PARTITION BY log_id) AS at_line FROM (SELECT a.*, s.*, s_start + CASE WHEN initialized THEN 16 ELSE 8 END AS e FROM (SELECT o_orderkey AS log_id, -8 * (o_custkey % 64 + 1) AS a_start, o_custkey % 3 AS f FROM orders) a JOIN slots s ON a.log_id = s.order_id AND a.f = s.frame) WHERE s_start < a_start + 64 AND a_start < e
) WHERE state_id = at_line GROUP BY 1, 2""")),
    "loader_sections": (loader_sections, "SELECT s_suppkey AS log_id, 'p' || s_suppkey AS program, CAST(2 AS BIGINT) AS window_start, 'tp/a' || s_suppkey AS section, 'sock' || s_suppkey AS relocated_struct FROM supplier"),
    "prompt_digests": (prompt_digests, f"""SELECT item_id AS case_id, mode, sha256(p) AS sha256, length(p) AS chars FROM (
  SELECT item_id, 'source-only' AS mode, {_PROMPT} || chr(10) || 'There is no diagnostic in this mode.' || chr(10) AS p FROM benchmark
  UNION ALL SELECT item_id, 'raw', {_PROMPT} || {_SHOWN("raw verifier log", "'a' || chr(10) || 'x BEGIN PROG LOAD LOG y' || chr(10) || text || chr(10) || '-- END PROG LOAD LOG -- z' || chr(10) || 'b'")} FROM benchmark
  UNION ALL SELECT item_id, 'trimmed-raw', {_PROMPT} || {_SHOWN("trimmed raw verifier log", "'x BEGIN PROG LOAD LOG y' || chr(10) || text || chr(10) || '-- END PROG LOAD LOG -- z' || chr(10)")} FROM benchmark
  UNION ALL SELECT item_id, 'diagnostic', {_PROMPT} || {_SHOWN("plain-text diagnostic", "'error[E1]: x'")} FROM benchmark)"""),
    "checked_stages": (checked_stages, P.sql(P.RUNS, query="SELECT CASE WHEN status = 'pass' THEN 'pass' WHEN case_id % 11 = 3 THEN 'oracle_parse' WHEN stage = 'compile' THEN 'compile' WHEN stage = 'load' THEN 'verifier_load' WHEN stage = 'functional' THEN 'functional_oracle' ELSE 'oracle' END AS stage, CASE WHEN status = 'pass' THEN 'pass' END AS by_status, count(*) AS n FROM runs GROUP BY 1, 2")),
    "extracted_sources": (extracted_sources, "SELECT conv_id % 2 = 0 AS found, count(*) AS n, sum(CASE WHEN conv_id % 2 = 0 THEN length(trim(text, ' ')) + 1 END) AS chars, sum(CASE WHEN length(text) <= 60 THEN length(text) ELSE 60 + length(chr(10) || '... <truncated> ...' || chr(10)) END) AS short FROM conversations GROUP BY 1"),
    "explained": (explained, None),
}
