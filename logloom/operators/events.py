"""Proof events: what a log and its quoted sources say about when a proof was made and lost, as an ordered array for each log.

Each event is (role, evidence, obligation, pc, source, register, detail); roles: established, lost, rejected; evidence: source, state,
terminal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import instructions as I
from ..functions import messages as M
from ..functions import proofs
from ..functions import ranges as R
from ..functions import sources as T
from . import sites

_SOURCE = "struct<text:string,path:string,line:int>"


def _event(when: Column, role: str, evidence: str, obligation, pc: Column, source: Column, detail: Column) -> Column:
    kind = F.lit(obligation) if isinstance(obligation, str) else obligation
    fields = F.struct(F.lit(role).alias("role"), F.lit(evidence).alias("evidence"), kind.alias("obligation"), pc.cast("int").alias("pc"), source.cast(_SOURCE).alias("source"), F.col("register").alias("register"), detail.alias("detail"))
    return F.when(F.coalesce(when, F.lit(False)), fields)


def _seen(name: str, role: str, obligation: str, detail: str, also: Column | None = None) -> Column:
    """An event of a quoted line above the rejected one."""
    found = F.col(name)
    when = found.isNotNull() if also is None else found.isNotNull() & also
    return _event(when, role, "source", obligation, found["pc"], found["source"], F.lit(detail))


def _of_state(found: Column, obligation: str, detail: Column, source: Column, role: str = "lost", also: Column | None = None) -> Column:
    when = found.isNotNull() if also is None else found.isNotNull() & also
    return _event(when, role, "state", obligation, found["pc"], source, detail)


def packet_ranges(at: DataFrame, long: DataFrame) -> DataFrame:
    """By log, of the packet register that the message names: current (its last state), proven (that state or an earlier one of the
    same lineage with a range that suffices), each (pc, range, log_line).

    Lineage ends at the first state, going back, that is no packet pointer or has another id."""
    point = at.select("log_id", M.register(F.col("message")).alias("reg"), M.packet_required(F.col("message")).alias("required"))
    rows = long.where(F.col("plain") & F.col("last")).join(point, ["log_id", "reg"])
    w = Window.partitionBy("log_id")
    value = F.struct("pc", F.col("state.packet_range").alias("range"), "log_line", "state")
    rows = rows.withColumn("v", value).withColumn("current", F.max_by("v", "log_line").over(w))
    same = (F.col("state.reg_type") == "pkt") & F.col("state.id").eqNullSafe(F.col("current.state.id"))
    rows = rows.withColumn("same", F.coalesce(same, F.lit(False)))
    broken = F.max(F.when(~F.col("same"), F.col("log_line"))).over(w)
    rows = rows.withColumn("unbroken", F.coalesce(F.col("log_line") > broken, F.lit(True)))
    enough = F.col("same") & F.col("unbroken") & (F.col("state.packet_range") >= F.col("required"))
    out = rows.groupBy("log_id").agg(F.first("current").alias("current"), F.when(F.max(enough.cast("int")) == 1, F.max_by("v", F.when(enough, F.col("log_line")))).alias("proven"), F.first("required").alias("required"))
    return out.where(F.col("current.state.reg_type") == "pkt")


def guarded_ranges(all_lines: DataFrame, at: DataFrame, long: DataFrame, events: DataFrame, ranges: DataFrame, ahead: int = 6) -> DataFrame:
    """By log: guard (pc, range) of the latest quoted data_end check above the rejected line whose branch compares a packet pointer
    of the same id with the packet's end and proves enough, where the register itself has too little."""
    checks = events.join(sites_rejected(at, events), "log_id").where((F.col("source.path") == F.col("rejected.path")) & (F.col("source.line") < F.col("rejected.line")) & T.is_packet_check(F.col("source.text")))
    checks = checks.where("pc is not null and (t_pc is null or pc <= t_pc)").select("log_id", F.col("pc").alias("guard_pc"))
    operands = branch_packet_operands(all_lines, long)
    met = checks.join(operands, "log_id").where(F.col("branch_pc").between(F.col("guard_pc"), F.col("guard_pc") + ahead)).join(ranges.select("log_id", "current", "required"), "log_id")
    fits = F.col("guard.id").eqNullSafe(F.col("current.state.id")) & (F.col("guard.packet_range") >= F.col("required")) & ~F.coalesce(F.col("current.range") >= F.col("required"), F.lit(False))
    return met.where(fits).groupBy("log_id").agg(F.max_by(F.struct(F.col("guard_pc").alias("pc"), F.col("guard.packet_range").alias("range")), "guard_pc").alias("guard"))


def branch_packet_operands(all_lines: DataFrame, long: DataFrame) -> DataFrame:
    """(log_id, branch_pc, guard): states of packet pointers that a conditional branch compares with the packet's end."""
    branches = all_lines.select("log_id", I.pc(F.trim("line")).alias("branch_pc"), I.branch_registers(I.tail(F.trim("line"))).alias("regs")).where("branch_pc is not null and size(regs) > 0").distinct()
    rows = long.select("log_id", F.col("pc").alias("branch_pc"), "log_line", "reg", "state").join(branches, ["log_id", "branch_pc"]).where(F.array_contains("regs", F.col("reg")))
    w = Window.partitionBy("log_id", "log_line", "regs")
    rows = rows.withColumn("ends", F.max((F.col("state.reg_type") == "pkt_end").cast("int")).over(w))
    return rows.where((F.col("ends") == 1) & (F.col("state.reg_type") == "pkt")).select("log_id", "branch_pc", F.col("state").alias("guard"))


def sites_rejected(at: DataFrame, events: DataFrame) -> DataFrame:
    return sites.source_lookups(at, events).select("log_id", "rejected").join(at.select("log_id", F.col("pc").alias("t_pc")), "log_id")


def proof_events(ctx: DataFrame, events: DataFrame) -> DataFrame:
    """Adds required and rejection (texts) and events to contexts that have packet look-ups (packet: current, proven, required; guard)."""
    reg = F.coalesce("register", F.when((F.col("obligation") == "ScalarRange"), F.when(M.has(F.col("message"), "invalid access to map value"), F.col("first_map_value")).otherwise(F.col("first_scalar"))))
    ctx = ctx.withColumn("register", reg).withColumn("_r", F.try_element_at("regs", F.col("register")))
    ctx = ctx.withColumn("_proof", proofs.required_proof(F.col("message"), F.col("call_target"), F.col("obligation"), F.col("register"), F.col("_r.last.state")))
    # the source of the pc of each state that an event names
    sufficient = F.coalesce(F.when(F.col("packet.proven").isNotNull(), F.struct(F.col("packet.proven.pc").alias("pc"), F.col("packet.proven.range").alias("range"))), F.struct(F.col("guard.pc").alias("pc"), F.col("guard.range").alias("range")))
    ctx = ctx.withColumn("_enough", F.when(F.col("packet.proven").isNotNull() | F.col("guard").isNotNull(), sufficient))
    names = {"loss": F.col("_r.loss.pc"), "unsafe": F.col("_r.unsafe.pc"), "nullable": F.col("_r.nullable.pc"), "enough": F.col("_enough.pc"), "current": F.col("packet.current.pc")}
    points = ctx.select("log_id", F.explode(F.array(*(c.cast("int") for c in names.values()))).alias("at_pc"))
    looked = sites.sources_at(points, events)
    found = looked.groupBy("log_id").agg(F.map_from_entries(F.collect_list(F.struct("at_pc", "source"))).alias("_sources"))
    ctx = ctx.join(found, "log_id", "left")
    of = lambda c: F.try_element_at("_sources", c.cast("int"))
    r, o = F.col("_r"), F.col("obligation")
    text = F.concat(F.lit("R"), F.col("register").cast("string"))
    short = F.col("packet.current.range") < F.col("packet.required")
    in_file = F.when((of(names["current"])["path"] == F.col("rejected.path")) & ~of(names["current"]).eqNullSafe(F.col("rejected")), of(names["current"]))
    need = F.col("packet.required").cast("string")
    no_volatile, no_return = F.col("volatile").isNull(), F.col("nullable_return").isNull()
    lists = {
        "PointerProvenance": [
            _seen("branch", "lost", "PointerProvenance", "proof can be lost when branch-specific pointers are merged"),
            _seen("data_end", "established", "PointerProvenance", "proof established by a verifier-visible bounds check"),
            _of_state(r["loss"], "PointerProvenance", F.concat(F.lit("verifier state changes from "), r["loss"]["kind"], F.lit(" to scalar before the rejected access")), of(names["loss"])),
        ],
        "PacketBounds": [
            _seen("packet_check", "established", "PacketBounds", "packet bounds proof is established by this data_end check"),
            _of_state(F.col("_enough"), "PacketBounds", F.concat(F.lit("verifier had proved packet range "), F.col("_enough.range").cast("string"), F.lit(" bytes here, enough for the required "), need, F.lit(" bytes")), of(names["enough"]), "established"),
            _of_state(F.col("packet.current"), "PacketBounds", F.concat(F.lit("verifier packet range for this register dropped to "), F.col("packet.current.range").cast("string"), F.lit(" bytes before the rejected access")), of(names["current"]), also=F.col("_enough").isNotNull() & (F.col("packet.required") > 1) & (F.col("packet.current.pc") > F.col("_enough.pc")) & short),
            _of_state(F.col("packet.current"), "PacketBounds", F.concat(F.lit("verifier only proves packet range "), F.col("packet.current.range").cast("string"), F.lit(" bytes on this path, but the rejected access requires "), need, F.lit(" bytes")), in_file, also=F.col("_enough").isNull() & (F.col("packet.required") > 1) & short),
        ],
        "ScalarRange": [
            _seen("scalar_guard", "established", "ScalarRange", "scalar range guard is visible before the rejected operation"),
            _seen("volatile", "lost", "ScalarRange", "bounded scalar proof can be lost when the checked value is materialized as a different verifier value"),
            _of_state(r["unsafe"], "ScalarRange", F.concat(F.lit("verifier still sees "), text, F.lit(" as "), R.value_summary(r["unsafe"]["state"]), F.lit(", so the required scalar or map-value bound is not available at the use")), of(names["unsafe"]), also=no_volatile),
        ],
        "NullablePointer": [
            _seen("null_check", "established", "NullablePointer", "non-null proof is established in this branch"),
            _seen("nullable_return", "lost", "NullablePointer", "nullable pointer returned here reaches the use without a verifier-visible non-null proof"),
            _of_state(r["nullable"], "NullablePointer", F.concat(F.lit("verifier still tracks "), text, F.lit(" as nullable type "), r["nullable"]["kind"]), of(names["nullable"]), also=no_return),
        ],
        "StackInitialized": [_seen("stack_init", "established", "StackInitialized", "some stack/register initialization is visible before the rejected use")],
        "ReferenceLifecycle": [
            _seen("acquire", "established", "ReferenceLifecycle", "verifier-tracked reference is acquired here"),
            _seen("release", "established", "ReferenceLifecycle", "reference release is visible on one path"),
            _event(F.col("rejected").isNotNull(), "lost", "source", "ReferenceLifecycle", F.lit(None), F.col("rejected"), F.lit("release proof must hold on every exit path, not only the path shown above")),
        ],
        "EnvironmentCapability": [
            _event(F.col("rejected.text").contains("bpf_"), "lost", "source", "EnvironmentCapability", F.lit(None), F.col("rejected"), F.lit("this helper call requires a program type, attach type, or kernel capability not available to the load")),
            _seen("bpf_call", "lost", "EnvironmentCapability", "this helper call requires a program type, attach type, or kernel capability not available to the load", also=~F.coalesce(F.col("rejected.text").contains("bpf_"), F.lit(False))),
        ],
    }
    rejected = _event(F.lit(True), "rejected", "terminal", o, F.col("pc"), F.col("rejected"), F.col("_proof.rejected"))
    found = F.array(rejected)
    for name, parts in lists.items():
        found = F.when(o == name, F.array(*parts, rejected)).otherwise(found)
    out = ctx.withColumn("events", F.filter(found, lambda e: e.isNotNull()))
    return out.withColumn("required", F.col("_proof.required")).withColumn("rejection", F.col("_proof.rejected")).drop("_proof", "_r", "_sources")
