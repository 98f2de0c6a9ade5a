"""From the lines of rejection logs to one diagnostic each.

`diagnostics` needs a terminal error, its class and the last state of a register; `explained` is the whole of it, with proof events,
signals, related source lines and the rendered text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import messages as M
from ..functions import proofs
from ..functions import ranges as R
from . import asof, classify, logs, signals, states
from .storage import kept, without_broadcasts

# The next action that each obligation asks for, and that of classes for which the obligation does not count.
ACTIONS = {
    "PacketBounds": "Bounds", "ScalarRange": "Bounds", "NullablePointer": "Null", "StackInitialized": "Initialize", "ReferenceLifecycle": "Release", "VerifierLimit": "Budget", "LoopBound": "Budget", "EnvironmentCapability": "Environment",
    "InstructionSupport": "Environment", "PointerProvenance": "Provenance", "Alignment": "Provenance", "TypeContract": "Provenance", "ContextAccess": "Context", "HelperArgument": "Protocol", "DynptrSafety": "Protocol", "KfuncReference": "Protocol",
    "IteratorLifecycle": "Protocol", "LockState": "Protocol", "Unknown": "Other",
}
CLASS_ACTIONS = {"environment_or_configuration": "Environment", "verifier_limit": "Budget", "input_error": "Other", "unsupported_verifier_message": "Other"}
#: What to do, in short, for each action.
HINTS = {
    "Bounds": "check the exact value that is used against its bound, right before the use", "Null": "test the pointer for null in the same branch as its use", "Initialize": "write every byte and register that is read, on every path",
    "Release": "release what was acquired on every path to an exit", "Budget": "give the loop a fixed bound and fewer branches", "Environment": "load the program where its helpers, types and metadata are available",
    "Provenance": "keep the pointer itself, and do arithmetic on an offset", "Context": "read only what the program's context offers", "Protocol": "call the helpers in the order, and with the objects, that they ask for", "Other": "read the last line of the log",
}
PACKET_HELP = "Use the packet pointer derivation that received the data_end proof, or rederive and recheck the final access pointer immediately before the load."
POINTER_HELP = "Reacquire a verifier-tracked pointer before the rejected dereference."


def _map(values: dict, key: Column) -> Column:
    return F.create_map(*(F.lit(x) for p in values.items() for x in p))[key]


def next_action(failure_class: Column, obligation: Column) -> Column:
    """By class, and of bugs by obligation."""
    return F.coalesce(_map(CLASS_ACTIONS, failure_class), _map(ACTIONS, obligation))


def diagnostics(all_lines: DataFrame) -> DataFrame:
    """(log_id, line_no, error_id, failure_class, obligation, message, pc, register, state_line, reg_type, state, text).

    The state is the last one of the register that the message names, before the error, but for logs with a malformed state line, which
    have none. Logs without an error are left out."""
    found = classify.classified(logs.terminals(all_lines), call_target="call_target").withColumn("register", M.register(F.col("message")))
    known = states.register_states(states.usable_states(all_lines)).withColumn("register", F.col("reg"))
    fields = [c for c in known.columns if c not in ("log_id", "log_line", "pc", "frame", "kind", "reg", "register")]
    whole = F.struct(*fields)
    value = F.struct(F.col("log_line").alias("state_line"), "reg_type", R.value_summary(whole).alias("state"), whole.alias("whole"))
    points = found.select("log_id", F.col("line_no").alias("log_line"), "register", "message", "pc", "call_target", "error_id", "failure_class", "obligation")
    with_state = asof.latest(points, known, ["log_id", "register"], "log_line", value, name="v").select("*", "v.state_line", "v.reg_type", "v.state")
    proof = proofs.required_proof(F.col("message"), F.col("call_target"), F.col("obligation"), F.col("register"), F.col("v.whole"))["required"]
    text = F.concat_ws("\n", F.concat(F.lit("error["), "error_id", F.lit("]: "), "message"), F.when(F.col("pc").isNotNull(), F.concat(F.lit("  --> instruction "), F.col("pc").cast("string"))), F.when(F.col("state").isNotNull(), F.concat(F.lit("  = state: R"), F.col("register").cast("string"), F.lit("="), "state")), F.concat(F.lit("  = required proof: "), proof))
    return with_state.select("log_id", F.col("log_line").alias("line_no"), "error_id", "failure_class", "obligation", "message", "pc", "register", "state_line", "reg_type", "state", text.alias("text"))


# ---- parts of a full diagnostic ----


def related_spans(events: Column) -> Column:
    """Source lines of the events before the rejection, by line and strength of evidence; neighbours of the same place count once."""
    named = F.filter(events, lambda e: (e["role"] != "rejected") & e["source"].isNotNull())

    def span(e: Column, i: Column) -> Column:
        label = F.when(e["evidence"] == "source", F.concat(F.lit("nearby source context for "), proofs.label(e["obligation"]))).otherwise(e["detail"])
        return F.struct(e["source"]["line"].alias("line"), F.when(e["evidence"] == "source", 1).otherwise(0).alias("strength"), i.alias("place"), e["source"]["path"].alias("path"), e["source"]["text"].alias("text"), label.alias("label"))

    spans = F.array_sort(F.transform(named, span))
    return without_neighbours(spans, ("path", "line"))


def without_neighbours(spans: Column, fields: tuple) -> Column:
    """Drops elements that equal the one before in these fields."""

    def differs(x: Column, i: Column) -> Column:
        before = F.get(spans, i - 1)
        same = before[fields[0]].eqNullSafe(x[fields[0]])
        for f in fields[1:]:
            same = same & before[f].eqNullSafe(x[f])
        return (i == 0) | ~same

    return F.filter(spans, differs)


def span_confidence(pc: Column, events: Column, spans: Column, text: Column, line: Column) -> Column:
    """How sure the place of a diagnostic is."""
    exact = F.exists(events, lambda e: e["pc"].isNotNull() & (e["evidence"] != "source"))
    return F.when(pc.isNotNull() & exact, "exact_pc").when((F.size(spans) > 0) | text.isNotNull(), "nearest_source_comment").when(line.isNotNull(), "terminal_line_only").otherwise("none")


def put_first(help_: Column, item: Column) -> Column:
    """The item before the others, unless it is among them or null."""
    return F.when(item.isNull() | F.coalesce(F.array_contains(help_, item), F.lit(False)), help_).otherwise(F.concat(F.array(item), help_))


def event_help(help_: Column, events: Column) -> Column:
    """Help that follows from what the events say."""
    proven = F.exists(events, lambda e: (e["role"] == "established") & (e["evidence"] == "state") & (e["obligation"] == "PacketBounds"))
    lost = F.exists(events, lambda e: (e["role"] == "lost") & (e["evidence"] == "state") & (e["obligation"] == "PointerProvenance"))
    return put_first(put_first(help_, F.when(proven, F.lit(PACKET_HELP))), F.when(lost, F.lit(POINTER_HELP)))


def source_block(spans: Column, path: Column, line: Column, text: Column, label: Column) -> Column:
    """Source lines with their labels underlined: related ones with -, the rejected one with ^."""
    plain = F.transform(spans, lambda s: F.struct(s["line"].alias("line"), F.lit(1).alias("related"), s["place"].alias("place"), F.trim(s["text"]).alias("text"), s["label"].alias("label")))
    own = F.struct(line.alias("line"), F.lit(0).alias("related"), F.lit(0).alias("place"), text.alias("text"), label.alias("label"))
    both = without_neighbours(F.array_sort(F.when(F.coalesce(text != "", F.lit(False)), F.concat(plain, F.array(own))).otherwise(plain)), ("line", "text"))
    width = F.coalesce(F.array_max(F.transform(both, lambda s: F.length(s["line"].cast("string")))), F.lit(1))

    def shown(s: Column) -> Column:
        marks = F.when(s["related"] == 0, "^").otherwise("-")
        under = F.repeat(marks, F.least(F.greatest(F.length(s["text"]), F.lit(1)), F.lit(80)))
        return F.concat(F.lpad(s["line"].cast("string"), width, F.lit(" ")), F.lit(" | "), s["text"], F.lit("\n"), F.repeat(F.lit(" "), width), F.lit(" | "), under, F.lit(" "), s["label"])

    return F.array_join(F.transform(both, shown), "\n")


def explained(all_lines: DataFrame, full_lines: DataFrame | None = None) -> DataFrame:
    """(log_id, error_id, failure_class, obligation, signal, signals, next_action, diagnostic_kind, confidence, span_confidence, message,
    line_no, pc, register, path, source_line, source_text, required, primary_label, related, help, events, text) of each log with an error.

    A signal that may override the class gives its class, action and error id; of other logs the class's own stay. A malformed state
    line leaves the class only. `full_lines` are the lines with a loader's own log, if `all_lines` are a region of them."""
    session = without_broadcasts(all_lines.sparkSession)  # all of the steps join by log
    all_lines = kept(all_lines, session)  # some fifteen steps read them
    full_lines = full_lines if full_lines is None else kept(full_lines, session)
    classified = classify.classified(logs.terminals(all_lines), call_target="call_target")
    ctx = signals.chosen(signals.hits(signals.prepared(all_lines, classified, full_lines)))
    spoken = F.col("signal").isNotNull()
    unsupported = F.col("failure_class") == "unsupported_verifier_message"
    action = F.coalesce("signal_action", next_action(F.col("failure_class"), F.col("obligation")))
    events = F.when(F.col("malformed"), F.array().cast(ctx.schema["events"].dataType)).otherwise(F.col("events"))
    required = F.when(F.col("malformed") | (F.col("obligation") == "Unknown"), proofs.default_required(F.col("obligation"))).otherwise(F.col("required"))
    own = F.get(F.filter("events", lambda e: e["role"] == "rejected"), F.lit(0))
    out = ctx.withColumn("events", events).withColumn("next_action", action).withColumn("required", required).withColumn("related", related_spans(F.col("events")))
    out = out.withColumn("path", F.coalesce("rejected.path", "source.path", F.lit("<log>"))).withColumn("source_line", F.coalesce("rejected.line", "source.line", F.col("line_no").cast("int"))).withColumn("source_text", F.coalesce("rejected.text", "source.text"))
    label = F.coalesce(own["detail"], proofs.default_rejected(F.col("obligation")))
    out = out.withColumn("primary_label", label).withColumn("span_confidence", span_confidence(F.col("pc"), F.col("events"), F.col("related"), F.col("source_text"), F.col("source_line")))
    base = F.when(spoken & F.col("replaces_help"), F.array().cast("array<string>")).otherwise(F.array(_map(HINTS, next_action(F.col("failure_class"), F.col("obligation")))))
    out = out.withColumn("help", event_help(put_first(base, F.when(spoken, _map(HINTS, F.col("signal_action")))), F.col("events")))
    kind = F.when(unsupported & ~(spoken & F.coalesce("replaces_unsupported", F.lit(False))), "unsupported_verifier_message").otherwise("supported")
    out = out.withColumn("diagnostic_kind", kind).withColumn("error_id", F.coalesce("signal_error_id", "error_id")).withColumn("failure_class", F.coalesce("signal_class", "failure_class")).withColumn("confidence", F.when(spoken, "medium").when(unsupported, "low").otherwise("high"))
    out = out.withColumn("text", rendered())
    return out.select("log_id", "error_id", "failure_class", "obligation", "signal", "signals", "next_action", "diagnostic_kind", "confidence", "span_confidence", "message", "line_no", "pc", "register", "path", "source_line", "source_text", "required", "primary_label", "related", "help", "events", "text")


def rendered() -> Column:
    """A diagnostic as text, of the columns that `explained` has."""
    c = F.col
    of = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    notes = F.when(c("signal").isNotNull(), of("   = note[signal]: ", c("signal")))
    return F.concat_ws(
        "\n", of("error[", c("error_id"), "]: ", proofs.label(c("obligation"))), of("  = class: ", c("failure_class")), of("  = confidence: ", c("confidence")), of("  = diagnostic: ", c("diagnostic_kind"), ", span: ", c("span_confidence")), of("  = next action: ", c("next_action")),
        of("  --> ", c("path"), ":", c("source_line")), F.lit("   |"), F.nullif(source_block(c("related"), c("path"), c("source_line"), c("source_text"), c("primary_label")), F.lit("")), F.lit("   |"), of("   = verifier[", c("line_no"), "]: ", c("message")),
        F.when(c("pc").isNotNull(), of("   = note: nearest BPF instruction pc ", c("pc"))), notes, of("   = required proof: ", c("required")), F.array_join(F.transform("help", lambda h: F.concat(F.lit("help: "), h)), "\n"),
    )
