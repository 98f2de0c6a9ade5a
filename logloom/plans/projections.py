"""The synthetic tables seen as relations of the engine: logs, lines, messages, states, slots, graphs and evaluation rows.

Each relation has a DataFrame and, for the SQL twins of the queries, the text of a common table expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- lines of documents, decorated as a continuous-integration log would ----


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line_no, line)"""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "raw"))
    kind = F.col("at") % 4
    line = (
        F.when(kind == 0, F.col("raw"))
        .when(kind == 1, F.concat(F.lit("[2024-01-02T03:04:05.123Z] "), "raw"))
        .when(kind == 2, F.concat(F.lit("\x1b[31m"), "raw", F.lit("\x1b[0m")))
        .when(F.col("doc_id") % 5 == 0, F.concat(F.lit("::group::"), "raw"))
        .otherwise(F.concat(F.lit("2024-01-02 03:04:05Z 2024-01-02T03:04:05Z  "), "raw"))
    )
    return raw.select("doc_id", (F.col("at") + 1).cast("long").alias("line_no"), line.alias("line"))


DOCUMENT_LINES = """document_lines AS (
  SELECT doc_id, pos AS line_no,
         CASE WHEN (pos - 1) % 4 = 0 THEN raw
              WHEN (pos - 1) % 4 = 1 THEN '[2024-01-02T03:04:05.123Z] ' || raw
              WHEN (pos - 1) % 4 = 2 THEN chr(27) || '[31m' || raw || chr(27) || '[0m'
              WHEN doc_id % 5 = 0 THEN '::group::' || raw
              ELSE '2024-01-02 03:04:05Z 2024-01-02T03:04:05Z  ' || raw END AS line
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
)"""


# ---- instruction text from line items ----

_FORMS = (
    ("%d: (61) r%d = *(u32 *)(r%d +%d)", "l_linenumber", "l_partkey % 10", "l_suppkey % 11", "l_partkey % 64"),
    ("%d: (7b) *(u64 *)(r%d -%d) = r%d", "l_linenumber", "l_suppkey % 11", "l_partkey % 64 + 1", "l_partkey % 10"),
    ("%d: (85) call bpf_helper_%d#%d", "l_linenumber", "l_suppkey % 7", "l_suppkey % 100"),
    ("%d: (2d) if r%d > r%d goto pc+%d", "l_linenumber", "l_partkey % 10", "l_suppkey % 10", "l_partkey % 9"),
    ("%d: (bf) r%d = r%d", "l_linenumber", "l_partkey % 10", "l_suppkey % 11"),
    ("%d: (0f) r%d += r%d", "l_linenumber", "l_partkey % 10", "l_suppkey % 10"),
    ("%d: (69) r%d = *(u16 *)(r%d)", "l_linenumber", "l_partkey % 10", "l_suppkey % 11"),
    ("%d: R%d=scalar(umax=%d)", "l_linenumber", "l_partkey % 10", "l_partkey % 255"),
)


def _text_expr(function: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {function}('{form[0]}', {', '.join(f'CAST({x} AS BIGINT)' for x in form[1:])})" for k, form in enumerate(_FORMS))
    return f"CASE l_partkey % {len(_FORMS)} {cases} END"


ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"


def instruction_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, line): a log for each order, a line for each item."""
    # lines carry the log's name before they are shuffled by it, and get their text behind that
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "log_id")
    w = Window.partitionBy("log_id").orderBy(*ORDER.split(", "))
    return items.withColumn("line_no", F.row_number().over(w).cast("long")).select("log_id", "line_no", F.expr(_text_expr("format_string")).alias("line"))


INSTRUCTION_LINES = f"""instruction_lines AS (
  SELECT l_orderkey AS log_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {ORDER}) AS line_no, {_text_expr("printf")} AS line FROM lineitem
)"""

# ---- a message for each order ----

_MESSAGES = (
    ("invalid access to packet, off=%d size=%d, R%d(id=0,off=0,r=%d)", "o_custkey % 64", "o_orderkey % 16 + 1", "o_custkey % 10", "o_custkey % 32"),
    ("R%d invalid mem access 'map_value_or_null'", "o_custkey % 10"),
    ("Dynptr is UNINITIALIZED at arg#%d", "o_custkey % 7"),
    ("invalid read from stack R%d off -%d+%d size %d", "o_custkey % 10", "o_custkey % 64", "o_orderkey % 8", "o_orderkey % 16 + 1"),
    ("Unreleased reference id=%d alloc_insn=%d", "o_custkey % 9", "o_orderkey % 50"),
    ("misaligned value access off (0x0; 0x0)+%d+%d size %d", "o_custkey % 9", "o_orderkey % 5", "o_orderkey % 8 + 1"),
    ("Caller passes invalid args into func#%d (''helper_%d'')", "o_custkey % 9", "o_orderkey % 4"),
    ("access beyond struct task at off %d size %d", "o_custkey % 512", "o_orderkey % 8"),
    ("invalid bpf_context access off=%d size=%d", "o_custkey % 200", "o_orderkey % 8 + 1"),
    ("Unsupported reg type for R%d", "o_custkey % 10"),
    ("R%d type=scalar expected=fp", "o_custkey % 10"),
    ("arg %d expected pointer to ctx", "o_custkey % 6"),
    ("unknown opcode %d", "o_custkey % 256"),
    ("calling kernel function bpf_kf_%d is not allowed", "o_custkey % 12"),
    ("cannot pass in dynptr at an offset=%d", "o_custkey % 16"),
    ("R%d must be referenced or trusted", "o_custkey % 10"),
    ("expected an initialized iter_num as arg #%d", "o_custkey % 6"),
    ("bpf_spin_lock at off=%d must be held", "o_custkey % 64"),
    ("invalid access to map value, value_size=%d off=%d size=%d", "o_custkey % 64", "o_orderkey % 64", "o_orderkey % 8 + 1"),
    ("R%d min value is negative, either use unsigned or var", "o_custkey % 10"),
    ("R%d pointer arithmetic on ctx prohibited", "o_custkey % 10"),
    ("back-edge from insn %d to %d", "o_custkey % 100", "o_orderkey % 100"),
    ("BPF program is too large. Processed %d insn", "o_custkey"),
    ("unknown func bpf_fn_%d#%d", "o_custkey % 30", "o_orderkey % 200"),
    ("At program exit the register R%d has value should have been in [%d, %d]", "o_custkey % 10", "0 - o_custkey % 3", "o_orderkey % 3 + 1"),
    ("something nobody has seen invalid %d", "o_custkey % 10"),
)


def _message_expr(function: str) -> str:
    cases = " ".join(f"WHEN {k} THEN {function}('{m[0]}', {', '.join(f'CAST({x} AS BIGINT)' for x in m[1:])})" for k, m in enumerate(_MESSAGES))
    return f"CASE o_orderkey % {len(_MESSAGES)} {cases} END"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, message)"""
    text = _message_expr("format_string").replace("''helper_%d''", "\\'helper_%d\\'").replace("R%d invalid mem access 'map_value_or_null'", "R%d invalid mem access \\'map_value_or_null\\'")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("log_id"), F.expr(text).alias("message"))


MESSAGES = "messages AS (SELECT o_orderkey AS log_id, " + _message_expr("printf").replace("access 'map_value_or_null'", "access ''map_value_or_null''") + " AS message FROM orders)"


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, line): instructions, a boundary, more instructions, the message and a closing line.

    Items are shuffled and read once: the last line of a log brings along the lines that the log has besides its items."""
    n, at = F.col("n"), F.col("line_no")
    line = lambda no, text: F.struct(no.cast("long").alias("line_no"), text.alias("line"))
    body = instruction_lines(spark, sf_dir).withColumn("n", F.count("*").over(Window.partitionBy("log_id")))
    # an order that stands twice ends its log twice
    ends = messages(spark, sf_dir).groupBy("log_id").agg(F.collect_list("message").alias("messages"))
    closing = F.flatten(F.transform("messages", lambda m: F.array(line(n + 2, m), line(n + 3, F.concat(F.lit("processed "), n.cast("string"), F.lit(" insns"))))))
    # a fragment boundary in the middle of logs of more than three lines
    middle = F.when(n > 3, F.array(line(F.lit(4), F.lit("func#1 @7"))))
    nothing = F.array().cast("array<struct<line_no:bigint,line:string>>")
    own = F.array(line(F.when(at > 3, at + 1).otherwise(at), F.col("line")))
    rest = F.when(at == n, F.concat(F.coalesce(middle, nothing), F.coalesce(closing, nothing))).otherwise(nothing)
    return body.join(ends, "log_id", "left").select("log_id", F.explode(F.concat(own, rest)).alias("x")).select("log_id", "x.line_no", "x.line")


LOGS = """logs AS (
  SELECT log_id, CASE WHEN line_no > 3 THEN line_no + 1 ELSE line_no END AS line_no, line FROM instruction_lines
  UNION ALL SELECT log_id, 4, 'func#1 @7' FROM instruction_lines GROUP BY log_id HAVING max(line_no) > 3
  UNION ALL SELECT m.log_id, n + 2, message FROM messages m JOIN (SELECT log_id, max(line_no) AS n FROM instruction_lines GROUP BY log_id) c ON m.log_id = c.log_id
  UNION ALL SELECT m.log_id, n + 3, 'processed ' || n || ' insns' FROM messages m JOIN (SELECT log_id, max(line_no) AS n FROM instruction_lines GROUP BY log_id) c ON m.log_id = c.log_id
)"""

# ---- states from events ----


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, log_line, event_id, pc, frame, kind, reg, reg_type, value)"""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    types = F.create_map(*(F.lit(x) for x in ("view", "pkt", "purchase", "map_value", "click", "scalar", "signup", "ptr_or_null", "error", "scalar")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("log_id"), F.row_number().over(w).cast("long").alias("log_line"), "event_id", (F.col("event_id") % 64).alias("pc"), (F.col("event_id") % 3).alias("frame"), (F.col("event_id") % 4).alias("kind"),
        (F.get_json_object("props", "$.k").cast("long") % 11).alias("reg"), types[F.col("event_type")].alias("reg_type"), "event_type", "value",
    )


STATES = """states AS (
  SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS log_line, event_id, event_id % 64 AS pc, event_id % 3 AS frame, event_id % 4 AS kind,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 11 AS reg,
         CASE event_type WHEN 'view' THEN 'pkt' WHEN 'purchase' THEN 'map_value' WHEN 'click' THEN 'scalar' WHEN 'signup' THEN 'ptr_or_null' ELSE 'scalar' END AS reg_type, event_type, value
  FROM events
)"""


def slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, state_id, frame, s_start, s_end, initialized): stack slots from line items."""
    size = F.when(F.col("l_returnflag") == "R", 16).otherwise(8)
    start = -8 * (F.col("l_partkey") % 64 + 1)
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").cast("long").alias("state_id"), (F.col("l_suppkey") % 3).alias("frame"), start.alias("s_start"), (start + size).alias("s_end"), (F.col("l_linestatus") == "O").alias("initialized"))


SLOTS = """slots AS (
  SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS state_id, l_suppkey % 3 AS frame, -8 * (l_partkey % 64 + 1) AS s_start,
         -8 * (l_partkey % 64 + 1) + CASE WHEN l_returnflag = 'R' THEN 16 ELSE 8 END AS s_end, l_linestatus = 'O' AS initialized
  FROM lineitem
)"""


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(part_id, range, value_size, size): register states of parts, scalars and map values, of which some bounds are missing."""
    k, s = F.col("p_partkey"), F.col("p_size").cast("long")
    u64 = "decimal(20,0)"
    kind = F.when(k % 9 == 0, "map_value").when(k % 23 == 0, "pkt").otherwise("scalar")
    r = F.struct(
        kind.alias("reg_type"), (k % 10 == 1).alias("narrow"), F.when((k % 11 == 0) & (kind == "scalar"), (s - 1) * (k % 13)).cast(u64).alias("exact"), F.when(k % 17 == 0, s).cast(u64).alias("tnum_value"),
        F.when(k % 3 != 0, s - 20).cast("long").alias("smin"), F.when(k % 4 != 0, s * (k % 7) * 100_000_000).cast("long").alias("smax"),
        F.when(k % 5 == 0, s).cast(u64).alias("umin"), F.when(k % 2 == 0, s * (k % 5)).cast(u64).alias("umax"),
        F.when(k % 13 == 0, s - 3).cast("int").alias("smin32"), F.when(k % 6 == 0, s).cast("int").alias("smax32"), F.when(k % 19 < 9, s % 2).cast("long").alias("umin32"), F.when(k % 19 < 12, s).cast("long").alias("umax32"),
        F.when(k % 7 != 3, k % 16 - 2).cast("int").alias("off"), (k % 64 + 1).cast("int").alias("map_value_size"),
    )
    return table(spark, sf_dir, "part").select(k.alias("part_id"), r.alias("range"), (k % 64 + 1).alias("value_size"), (k % 8 + 1).alias("size"))


RANGES = """ranges AS (
  SELECT *, CASE WHEN k % 11 = 0 AND reg_type = 'scalar' THEN (s - 1) * (k % 13) END AS exact FROM (
    SELECT p_partkey AS part_id, p_partkey AS k, CAST(p_size AS BIGINT) AS s, CASE WHEN p_partkey % 9 = 0 THEN 'map_value' WHEN p_partkey % 23 = 0 THEN 'pkt' ELSE 'scalar' END AS reg_type, p_partkey % 10 = 1 AS narrow,
           CASE WHEN p_partkey % 17 = 0 THEN CAST(p_size AS BIGINT) END AS tnum_value, CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) - 20 END AS smin, CASE WHEN p_partkey % 4 <> 0 THEN CAST(p_size AS BIGINT) * (p_partkey % 7) * 100000000 END AS smax,
           CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS BIGINT) END AS umin, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS BIGINT) * (p_partkey % 5) END AS umax,
           CASE WHEN p_partkey % 13 = 0 THEN CAST(p_size AS BIGINT) - 3 END AS smin32, CASE WHEN p_partkey % 6 = 0 THEN CAST(p_size AS BIGINT) END AS smax32,
           CASE WHEN p_partkey % 19 < 9 THEN CAST(p_size AS BIGINT) % 2 END AS umin32, CASE WHEN p_partkey % 19 < 12 THEN CAST(p_size AS BIGINT) END AS umax32,
           CASE WHEN p_partkey % 7 <> 3 THEN p_partkey % 16 - 2 END AS off, p_partkey % 64 + 1 AS value_size, p_partkey % 8 + 1 AS size
    FROM part)
)"""

# ---- evaluation rows ----

CLASSES = ("source_bug", "lowering_artifact", "environment_or_configuration", "verifier_false_positive", "verifier_limit")


def eval_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, stratum, gold, pred, gold_action, pred_action, duration_ms, root_pc, pcs)"""
    names = F.array(*map(F.lit, CLASSES))
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    gold = F.when(F.col("quality") == 1, F.col("doc_id") % 3).otherwise(F.col("doc_id") % 5)
    pred = F.when(F.col("toxic") == 1, (gold + 1) % 5).when(F.col("doc_id") % 7 == 0, F.col("doc_id") % 5).otherwise(gold)
    at = lambda c: F.element_at(names, (c + 1).cast("int"))
    action = lambda c: F.concat(F.lit("action_"), (c % 3).cast("string"))
    return d.select("doc_id", "source", "lang", "n_chars").join(l.select("doc_id", "quality", "toxic"), "doc_id").select(
        F.col("doc_id").alias("case_id"), F.col("source").alias("stratum"), "lang", at(gold).alias("gold"), at(pred).alias("pred"), action(gold).alias("gold_action"), F.when(F.col("doc_id") % 4 != 0, action(pred)).alias("pred_action"),
        (F.col("n_chars") / 10.0).alias("duration_ms"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") % 40).alias("root_pc"), F.array(F.col("n_chars") % 40, F.col("n_chars") % 37).alias("pcs"),
    )


EVAL_ROWS = f"""eval_base AS (
  SELECT d.doc_id, source, lang, n_chars, toxic, CASE WHEN quality = 1 THEN d.doc_id % 3 ELSE d.doc_id % 5 END AS g FROM documents d JOIN labels l ON d.doc_id = l.doc_id
), eval_numbers AS (
  SELECT *, CASE WHEN toxic = 1 THEN (g + 1) % 5 WHEN doc_id % 7 = 0 THEN doc_id % 5 ELSE g END AS p FROM eval_base
), eval_rows AS (
  SELECT doc_id AS case_id, source AS stratum, lang, list_extract({list(CLASSES)}, g + 1) AS gold, list_extract({list(CLASSES)}, p + 1) AS pred, 'action_' || (g % 3) AS gold_action,
         CASE WHEN doc_id % 4 <> 0 THEN 'action_' || (p % 3) END AS pred_action, n_chars / 10.0 AS duration_ms, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 40 END AS root_pc, [n_chars % 40, n_chars % 37] AS pcs
  FROM eval_numbers
)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, mode, attempt, status, stage, prompt_chars): outcomes of two modes for each conversation."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"))
    modes = turns.withColumn("mode", F.explode(F.array(F.lit("raw"), F.lit("diagnostic"))))
    score = (F.col("conv_id") * 7 + F.col("turns") * 3 + F.when(F.col("mode") == "raw", 0).otherwise(2)) % 5
    stage = F.when(score == 0, "compile").when(score == 1, "load").when(score == 2, "functional")
    return modes.select(F.col("conv_id").alias("case_id"), "mode", (F.col("turns") % 2 + 1).alias("attempt"), F.when(score >= 3, "pass").otherwise("fail").alias("status"), stage.alias("stage"), F.col("chars").alias("prompt_chars"))


RUNS = """turns AS (
  SELECT conv_id, count(*) AS turns, sum(length(text)) AS chars FROM conversations GROUP BY conv_id
), runs_scored AS (
  SELECT conv_id, mode, turns, chars, (conv_id * 7 + turns * 3 + CASE WHEN mode = 'raw' THEN 0 ELSE 2 END) % 5 AS score FROM turns, (VALUES ('raw'), ('diagnostic')) v(mode)
), runs AS (
  SELECT conv_id AS case_id, mode, turns % 2 + 1 AS attempt, CASE WHEN score >= 3 THEN 'pass' ELSE 'fail' END AS status,
         CASE score WHEN 0 THEN 'compile' WHEN 1 THEN 'load' WHEN 2 THEN 'functional' END AS stage, chars AS prompt_chars
  FROM runs_scored
)"""


_STATE_FORM = "'%d: (b7) r1 = 0 ; R%d_w=scalar(id=%d,smin=smin32=%d,umax=%d,var_off=(0x0; 0x%x)) R%d=Pfp-%d fp-8=mmmm???? refs=%d,%d'"
_STATE_ARGS = ("l_linenumber", "l_partkey % 10", "l_suppkey % 50 + 1", "0 - l_suppkey % 100", "l_partkey % 255", "l_partkey % 255", "l_suppkey % 2 + 9", "l_partkey % 64 + 1", "l_suppkey % 5", "l_partkey % 9 + 1")


def _state_expr(function: str) -> str:
    return f"{function}({_STATE_FORM}, {', '.join(f'CAST({x} AS BIGINT)' for x in _STATE_ARGS)})"


def state_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, line_no, line): a state for each line item."""
    w = Window.partitionBy("l_orderkey").orderBy(*ORDER.split(", "))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("log_id"), F.row_number().over(w).cast("long").alias("line_no"), F.expr(_state_expr("format_string")).alias("line"))


def sql(*relations: str, query: str) -> str:
    """A query over the given relations."""
    return f"WITH {', '.join(relations)}\n{query}"
