"""Queries over lines, instructions and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import instructions as I
from ..functions import lines as L
from ..functions import messages as M
from ..operators import classify, logs
from . import projections as P

_DAY, _TIME = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}:[0-9]{2}"
_NORMAL = rf"""regexp_replace(regexp_replace(regexp_replace(line, '\x1b\[[^@-~]*[@-~]', '', 'g'), '\r+$', ''), '^(?:\s*(?:\[{_DAY}[Tt ]{_TIME}[^\]]*\]|{_DAY}[Tt]{_TIME}\S*\s))*\s*', '')"""
_CONTROL = "(x LIKE '::group::%' OR x LIKE '::endgroup::%' OR starts_with(x, '##[group]') OR starts_with(x, '##[endgroup]'))"
_INSTRUCTION = r"^\s*[0-9]+:\s*(?:[0-9.]+\s+)?\([0-9a-f]{2}\)\s.*$"
_MARKERS = "|".join(L.ERROR_MARKERS)


def _lower(x: str) -> str:
    return f"translate({x}, '{L.ASCII_UPPER}', '{L.ASCII_LOWER}')"


def _is_error(x: str) -> str:
    refused = " OR ".join(f"starts_with({x}, '{s}')" for s in L.NOT_ERRORS)
    return f"({x} <> '' AND NOT ({refused} OR (starts_with({x}, 'processed ') AND NOT contains({x}, '1000001')) OR regexp_matches({x}, '{_INSTRUCTION}') OR starts_with({x}, 'from ') OR regexp_matches({x}, '^[^:]*:\\s*(?:R|frame)')) AND regexp_matches({_lower(x)}, '{_MARKERS}'))"


def _is_boundary(x: str) -> str:
    return f"(starts_with({x}, 'func#') OR contains({x}, '-- BEGIN PROG LOAD LOG --') OR contains({x}, '-- END PROG LOAD LOG --') OR starts_with({x}, 'processed ') OR starts_with({x}, 'verification time ') OR starts_with({x}, 'stack depth ') OR {_is_error(x)})"


def normalize_lines(spark, d):
    rows = P.document_lines(spark, d).select("doc_id", "line_no", L.normalized(F.col("line")).alias("line"))
    return rows.where(~L.is_control(F.col("line")))


def strip_ansi_ts(spark, d):
    rows = P.document_lines(spark, d)
    plain = L.strip_ansi(F.col("line"))
    return rows.groupBy((F.col("line_no") % 4).alias("form")).agg(F.count("*").alias("n"), F.sum(F.when(plain != F.col("line"), 1).otherwise(0)).alias("coloured"), F.sum(F.length("line") - F.length(L.normalized(F.col("line")))).alias("chars_dropped"))


def error_line_filter(spark, d):
    rows = P.document_lines(spark, d).select("doc_id", "line_no", F.trim(L.normalized(F.col("line"))).alias("line"))
    return rows.where(L.is_error(F.col("line"))).select("doc_id", "line_no")


def region_slice(spark, d):
    return logs.region(P.logs(spark, d)).groupBy("log_id").agg(F.count("*").alias("n_lines"), F.min("line").alias("least_line"))


def fragment_start_asof(spark, d):
    return logs.fragments(P.logs(spark, d)).select("log_id", "line_no", F.col("fragment_start").cast("long").alias("fragment_start"))


def terminal_last_error(spark, d):
    return logs.terminals(P.logs(spark, d)).select("log_id", F.col("line_no").cast("long").alias("line_no"), "message", F.col("pc").cast("long").alias("pc"), "call_target")


def terminal_continuation_merge(spark, d):
    split = P.messages(spark, d)
    detail = F.concat(F.lit("R"), (F.col("log_id") % 10).cast("string"), F.lit(" offset is outside of the packet"))
    two = split.select("log_id", F.explode(F.array(F.struct(F.lit(1).cast("long").alias("line_no"), F.col("message").alias("line")), F.struct(F.lit(2).cast("long").alias("line_no"), detail.alias("line")))).alias("x")).select("log_id", "x.*")
    return logs.terminals(two).select("log_id", F.col("line_no").cast("long").alias("line_no"), "message")


def source_comment_parse(spark, d):
    line = F.format_string("; if (x > %d) @ prog_%d.c:%d", F.col("l_quantity").cast("int"), (F.col("l_suppkey") % 5).cast("int"), F.col("l_linenumber"))
    parsed = P.table(spark, d, "lineitem").select(L.source_comment(line).alias("s"))
    return parsed.groupBy("s.path", F.col("s.line").cast("long").alias("line")).agg(F.count("*").alias("n"), F.min("s.text").alias("least_text"))


def classify_first_match(spark, d):
    found = classify.classified(P.messages(spark, d))
    return found.select("log_id", F.col("rule").cast("long").alias("rule"), "kind", "error_id", "obligation", "failure_class")


def classify_histogram(spark, d):
    found = classify.classified(P.messages(spark, d))
    return found.groupBy("error_id", "failure_class").agg(F.count("*").alias("n"), F.countDistinct("message").alias("n_messages"))


_RULE_CASES = " ".join(
    f"WHEN {(' OR ' if mode == 'any' else ' AND ').join('contains(low, ' + chr(39) + n.replace(chr(39), chr(39) * 2) + chr(39) + ')' for n in needles)} THEN {k}" for k, (_, mode, needles) in enumerate(classify.RULES, 1)
)
_KIND_CASES = "CASE rule " + " ".join(f"WHEN {k} THEN '{kind}'" for k, (kind, _, _) in enumerate(classify.RULES, 1)) + " ELSE 'Unsupported' END"
_CLASSIFIED = f"""ruled AS (SELECT log_id, message, CASE {_RULE_CASES} END AS rule FROM (SELECT *, {_lower("message")} AS low FROM messages)),
kinds(kind, error_id, obligation, failure_class) AS (VALUES {", ".join(str(k) for k in classify.KINDS)}),
classified AS (SELECT r.*, k.* FROM (SELECT *, {_KIND_CASES} AS kind_ FROM ruled) r JOIN kinds k ON r.kind_ = k.kind)"""


def _tails(spark, d):
    rows = P.instruction_lines(spark, d)
    return rows.select("log_id", "line_no", I.pc(F.col("line")).alias("pc"), I.tail(F.col("line")).alias("tail"))


def parse_instruction(spark, d):
    t = _tails(spark, d)
    return t.where("tail is not null").select("log_id", "line_no", F.col("pc").cast("long").alias("pc"), I.opcode(F.col("tail")).alias("opcode"), I.body(F.col("tail")).alias("body"))


def mem_access_shape(spark, d):
    t = F.col("tail")
    rows = _tails(spark, d).select(I.access_width(t).cast("long").alias("width"), I.is_load(t).alias("is_load"), I.is_store(t).alias("is_store"), I.base_register(t).cast("long").alias("base"), I.access_offset(t).cast("long").alias("off")).where("width is not null")
    return rows.groupBy("width", "is_load", "is_store", "base").agg(F.count("*").alias("n"), F.sum("off").alias("sum_off"), F.min("off").alias("min_off"))


def call_targets(spark, d):
    rows = _tails(spark, d).select("log_id", I.call_target(F.col("tail")).alias("target")).where("target is not null")
    return rows.groupBy("target").agg(F.count("*").alias("n"), F.countDistinct("log_id").alias("n_logs"))


def branch_registers(spark, d):
    t = F.col("tail")
    rows = _tails(spark, d).select(F.transform(I.branch_registers(t), lambda x: x.cast("long")).alias("regs"), (I.branch_target(t, F.col("pc")) - F.col("pc")).cast("long").alias("jump")).where("regs is not null")
    return rows.groupBy(F.element_at("regs", 1).alias("a"), F.element_at("regs", 2).alias("b")).agg(F.count("*").alias("n"), F.sum("jump").alias("sum_jump"))


def register_effects(spark, d):
    t = F.col("tail")
    one = F.lit(1).cast("int")
    rows = _tails(spark, d).where("tail is not null").select(I.opcode(t).alias("opcode"), I.destination(t).alias("dst"), I.copy_source(t).alias("copied"), I.added_register(t).alias("added"), I.writes(t, one).alias("w1"), I.reads(t, one).alias("r1"))
    return rows.groupBy("opcode").agg(F.count("*").alias("n"), F.sum("dst").alias("sum_dst"), F.sum("copied").alias("sum_copied"), F.sum("added").alias("sum_added"), F.count_if("w1").alias("writes_r1"), F.count_if("r1").alias("reads_r1"))


def terminal_numbers(spark, d):
    m = F.col("message")
    return P.messages(spark, d).select("log_id", M.register(m).cast("long").alias("register"), M.argument(m).cast("long").alias("argument"), M.argument_register(m).cast("long").alias("argument_register"), M.helper(m).alias("helper"), M.required_return_range(m)["lo"].alias("lo"), M.required_return_range(m)["hi"].alias("hi"))


def map_value_error_triples(spark, d):
    a = M.map_value_access(F.col("message"))
    return P.messages(spark, d).select("log_id", a.alias("a")).where("a is not null").select("log_id", "a.value_size", "a.off", "a.size")


def stack_read_intervals(spark, d):
    a = M.stack_read(F.col("message"))
    rows = P.messages(spark, d).select("log_id", a.alias("a")).where("a is not null")
    return rows.select("log_id", *(F.col(f"a.{c}").cast("long").alias(c) for c in ("register", "start", "end", "size")))


def render_text(spark, d):
    found = classify.classified(P.messages(spark, d))
    return found.select("log_id", F.concat(F.lit("error["), "error_id", F.lit("]: "), "message", F.lit("\n  = class: "), "failure_class", F.lit("\n  = needs: "), "obligation").alias("text"))


def truncate_middle(spark, d):
    text, n, keep = F.col("text"), F.length("text"), 100
    cut = F.concat(F.substring(text, 1, keep), F.lit("\n...["), (n - 2 * keep).cast("string"), F.lit(" characters]...\n"), F.expr(f"right(text, {keep})"))
    return P.table(spark, d, "documents").select("doc_id", F.when(n <= 2 * keep, text).otherwise(cut).alias("shown"))


_R = "nullif(regexp_extract({0}, '{1}', {2}), '')"
_TAILS = rf"""tails AS (
  SELECT log_id, line_no, CAST(nullif(regexp_extract(line, '^\s*([0-9]+):\s*(?:[0-9.]+\s+)?(\([0-9a-f]{{2}}\)\s.*)$', 1), '') AS BIGINT) AS pc,
         nullif(regexp_extract(line, '^\s*([0-9]+):\s*(?:[0-9.]+\s+)?(\([0-9a-f]{{2}}\)\s.*)$', 2), '') AS tail FROM instruction_lines
)"""
_BODY = r"trim(regexp_replace(string_split(tail, ';')[1], '^\([0-9a-f]{2}\)\s*', ''))"


def _x(c, pattern, group=1, cast=None):
    out = f"nullif(regexp_extract({c}, '{pattern}', {group}), '')"
    return f"TRY_CAST({out} AS {cast})" if cast else out


_OPERAND = r"\*\(u(?:8|16|32|64) \*\)\(r([0-9]+) ?([+-]?[0-9]+)?\)"
_STACK = r"invalid (?:indirect )?read from stack (?:R([0-9]+) )?off (-?[0-9]+)\+(-?[0-9]+) size ([0-9]+)"
_I = P.INSTRUCTION_LINES

QUERIES = {
    "normalize_lines": (normalize_lines, P.sql(P.DOCUMENT_LINES, query=f"SELECT doc_id, line_no, x AS line FROM (SELECT doc_id, line_no, {_NORMAL} AS x FROM document_lines) WHERE NOT {_CONTROL}")),
    "strip_ansi_ts": (strip_ansi_ts, P.sql(P.DOCUMENT_LINES, query=rf"SELECT line_no % 4 AS form, count(*) AS n, sum(CASE WHEN regexp_replace(line, '\x1b\[[^@-~]*[@-~]', '', 'g') <> line THEN 1 ELSE 0 END) AS coloured, sum(length(line) - length({_NORMAL})) AS chars_dropped FROM document_lines GROUP BY 1")),
    "error_line_filter": (error_line_filter, P.sql(P.DOCUMENT_LINES, query=f"SELECT doc_id, line_no FROM (SELECT doc_id, line_no, trim({_NORMAL}) AS x FROM document_lines) WHERE {_is_error('x')}")),
    "region_slice": (region_slice, P.sql(_I, P.MESSAGES, P.LOGS, query=rf"""
, marked AS (SELECT *, trim(line) AS x, {_is_error("trim(line)")} AS err FROM logs),
edges AS (SELECT *, max(CASE WHEN err THEN line_no END) OVER (PARTITION BY log_id) AS last_error FROM marked),
begun AS (SELECT *, min(CASE WHEN line_no <= last_error AND (starts_with(x, 'func#') OR regexp_matches(x, '^\s*[0-9]+:')) THEN line_no END) OVER (PARTITION BY log_id) AS first FROM edges)
SELECT log_id, count(*) AS n_lines, min(line) AS least_line FROM begun WHERE first IS NULL OR line_no BETWEEN first AND last_error GROUP BY log_id""".replace("\n, marked", ", marked", 1))),
    "fragment_start_asof": (fragment_start_asof, P.sql(_I, P.MESSAGES, P.LOGS, query=f"SELECT log_id, line_no, coalesce(max(CASE WHEN {_is_boundary('trim(line)')} THEN line_no + 1 END) OVER (PARTITION BY log_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS fragment_start FROM logs")),
    "terminal_last_error": (terminal_last_error, P.sql(_I, P.MESSAGES, P.LOGS, query=rf"""
, flagged AS (SELECT *, trim(line) AS x, {_is_error("trim(line)")} AS err FROM logs),
ends AS (SELECT log_id, max(line_no) AS ended FROM flagged WHERE err GROUP BY log_id),
above AS (SELECT f.*, ended, max(CASE WHEN f.line_no < ended AND {_is_boundary("x")} THEN f.line_no END) OVER (PARTITION BY f.log_id) AS edge FROM flagged f JOIN ends e ON f.log_id = e.log_id WHERE f.line_no <= ended)
SELECT log_id, ended AS line_no, max(CASE WHEN line_no = ended THEN x END) AS message,
       coalesce(max(CASE WHEN line_no = ended THEN TRY_CAST(nullif(regexp_extract(x, '^insn ([0-9]+)', 1), '') AS BIGINT) END),
                arg_max(TRY_CAST(regexp_extract(x, '^\s*([0-9]+):', 1) AS BIGINT), line_no) FILTER (WHERE line_no < ended AND line_no > coalesce(edge, 0) AND regexp_matches(x, '{_INSTRUCTION}'))) AS pc,
       arg_max(regexp_extract(x, '\bcall\s+([^\s#]+)', 1), line_no) FILTER (WHERE line_no < ended AND line_no > coalesce(edge, 0) AND regexp_matches(x, '{_INSTRUCTION}') AND regexp_matches(x, '\bcall\s+([^\s#]+)')) AS call_target
FROM above GROUP BY log_id, ended""".replace("\n, flagged", ", flagged", 1))),
    "terminal_continuation_merge": (terminal_continuation_merge, P.sql(P.MESSAGES, query=f"""SELECT log_id, CASE WHEN joins THEN 1 ELSE 2 END AS line_no, CASE WHEN joins THEN message || '; ' ELSE '' END || 'R' || (log_id % 10) || ' offset is outside of the packet' AS message
FROM (SELECT *, regexp_matches(lower(message), 'invalid access|unbounded memory access|makes pkt pointer|out of bounds|outside of') AND {_is_error("message")} AS joins FROM messages)""")),
    "source_comment_parse": (source_comment_parse, "SELECT 'prog_' || (l_suppkey % 5) || '.c' AS path, CAST(l_linenumber AS BIGINT) AS line, count(*) AS n, min('if (x > ' || CAST(trunc(l_quantity) AS BIGINT) || ')') AS least_text FROM lineitem GROUP BY 1, 2"),
    "classify_first_match": (classify_first_match, P.sql(P.MESSAGES, _CLASSIFIED, query="SELECT log_id, rule, kind, error_id, obligation, failure_class FROM classified")),
    "classify_histogram": (classify_histogram, P.sql(P.MESSAGES, _CLASSIFIED, query="SELECT error_id, failure_class, count(*) AS n, count(DISTINCT message) AS n_messages FROM classified GROUP BY 1, 2")),
    "parse_instruction": (parse_instruction, P.sql(_I, _TAILS, query=rf"SELECT log_id, line_no, pc, {_x('tail', r'^\(([0-9a-f]{2})\)')} AS opcode, {_BODY} AS body FROM tails WHERE tail IS NOT NULL")),
    "mem_access_shape": (mem_access_shape, P.sql(_I, _TAILS, query=rf"""SELECT width, is_load, is_store, base, count(*) AS n, sum(off) AS sum_off, min(off) AS min_off FROM (
  SELECT {_x("tail", r"\*\(u(8|16|32|64) \*\)\(([^)]*)\)", 1, "BIGINT")} // 8 AS width, contains(tail, '= *(') AS is_load, regexp_matches(tail, '^\([0-9a-f]{{2}}\) \*\(u[0-9]+ \*\)\([^)]*\) = ') AS is_store,
         {_x("tail", _OPERAND, 1, "BIGINT")} AS base, CASE WHEN regexp_matches(tail, '{_OPERAND}') THEN coalesce({_x("tail", _OPERAND, 2, "BIGINT")}, 0) END AS off FROM tails) WHERE width IS NOT NULL GROUP BY ALL""")),
    "call_targets": (call_targets, P.sql(_I, _TAILS, query=rf"SELECT target, count(*) AS n, count(DISTINCT log_id) AS n_logs FROM (SELECT log_id, {_x('tail', r'\bcall\s+([^\s#]+)')} AS target FROM tails) WHERE target IS NOT NULL GROUP BY 1")),
    "branch_registers": (branch_registers, P.sql(_I, _TAILS, query=r"SELECT CAST(regexp_extract(tail, 'if r([0-9]+) > r([0-9]+) goto pc\+([0-9]+)', 1) AS BIGINT) AS a, CAST(regexp_extract(tail, 'if r([0-9]+) > r([0-9]+) goto pc\+([0-9]+)', 2) AS BIGINT) AS b, count(*) AS n, sum(1 + CAST(regexp_extract(tail, 'goto pc\+([0-9]+)', 1) AS BIGINT)) AS sum_jump FROM tails WHERE tail LIKE '%if % goto %' GROUP BY 1, 2")),
    "register_effects": (register_effects, P.sql(_I, _TAILS, query=rf"""SELECT {_x("tail", r"^\(([0-9a-f]{2})\)")} AS opcode, count(*) AS n, sum({_x("body", r"^[rw]([0-9]+) = ", 1, "BIGINT")}) AS sum_dst, sum({_x("body", r"^[rw][0-9]+ = r([0-9]+)$", 1, "BIGINT")}) AS sum_copied,
       sum({_x("body", r"^r[0-9]+ \+= r([0-9]+)$", 1, "BIGINT")}) AS sum_added,
       count(*) FILTER (WHERE coalesce({_x("body", r"^[rw]([0-9]+) (?:\S{0,3})= ?", 1, "BIGINT")} = 1, false) OR regexp_matches(tail, '\bcall\s+[^\s#]+')) AS writes_r1,
       count(*) FILTER (WHERE CASE WHEN contains(tail, '*)(') THEN {_x("tail", _OPERAND, 1, "BIGINT")} = 1 WHEN contains(tail, ' = ') THEN false ELSE regexp_matches(tail, 'r1([^0-9]|$)') END) AS reads_r1
FROM (SELECT tail, {_BODY} AS body FROM tails WHERE tail IS NOT NULL) GROUP BY 1""")),
    "terminal_numbers": (terminal_numbers, P.sql(P.MESSAGES, query=rf"""SELECT log_id, {_x("message", "R([0-9]+)", 1, "BIGINT")} AS register, argument, CASE WHEN argument < 5 THEN argument + 1 END AS argument_register,
       coalesce({", ".join(_x("message", mark + r"\s*[:,;]*(\S*[^\s:,;])") for mark in M.HELPER_MARKS)}) AS helper,
       {_x("message", r"should have been in \[(-?[0-9]+), (-?[0-9]+)\]", 1, "BIGINT")} AS lo, {_x("message", r"should have been in \[(-?[0-9]+), (-?[0-9]+)\]", 2, "BIGINT")} AS hi
FROM (SELECT *, coalesce({_x("message", "arg #([0-9]+)", 1, "BIGINT")}, {_x("message", "arg#([0-9]+)", 1, "BIGINT")}, {_x("message", "arg ([0-9]+)", 1, "BIGINT")}) AS argument FROM messages)""")),
    "map_value_error_triples": (map_value_error_triples, P.sql(P.MESSAGES, query=rf"SELECT * FROM (SELECT log_id, {_x('message', '(?:^|[^A-Za-z0-9_])value_size=([0-9]+)', 1, 'BIGINT')} AS value_size, {_x('message', '(?:^|[^A-Za-z0-9_])off=([+-]?[0-9]+)', 1, 'BIGINT')} AS off, {_x('message', '(?:^|[^A-Za-z0-9_])size=([0-9]+)', 1, 'BIGINT')} AS size FROM messages) WHERE value_size IS NOT NULL AND off IS NOT NULL AND size IS NOT NULL")),
    "stack_read_intervals": (stack_read_intervals, P.sql(P.MESSAGES, query=rf"SELECT log_id, register, base + off AS start, base + off + size AS \"end\", size FROM (SELECT log_id, message, {_x('message', _STACK, 1, 'BIGINT')} AS register, {_x('message', _STACK, 2, 'BIGINT')} AS base, {_x('message', _STACK, 3, 'BIGINT')} AS off, {_x('message', _STACK, 4, 'BIGINT')} AS size FROM messages) WHERE regexp_matches(message, '{_STACK}')".replace('\\"', '"'))),
    "render_text": (render_text, P.sql(P.MESSAGES, _CLASSIFIED, query="SELECT log_id, 'error[' || error_id || ']: ' || message || chr(10) || '  = class: ' || failure_class || chr(10) || '  = needs: ' || obligation AS text FROM classified")),
    "truncate_middle": (truncate_middle, "SELECT doc_id, CASE WHEN length(text) <= 200 THEN text ELSE left(text, 100) || chr(10) || '...[' || (length(text) - 200) || ' characters]...' || chr(10) || right(text, 100) END AS shown FROM documents"),
}
