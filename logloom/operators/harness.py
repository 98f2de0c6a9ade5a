"""A repair benchmark's cases, prompts and results: splits, prompts by mode, retry texts, stages and audits. Models are not run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("source-only", "raw", "trimmed-raw", "diagnostic")
LABELS = {"raw": "raw verifier log", "trimmed-raw": "trimmed raw verifier log", "diagnostic": "plain-text diagnostic"}
STAGES = ("pass", "compile", "map_setup", "verifier_load", "auxiliary_proof_predicate", "functional_oracle", "prompt_only", "model_call", "source_extract")
FORBIDDEN = ("expected repair", "reference fix", "root_cause", "taxonomy_class")
RUN = "array<struct<returncode:int>>"
REPORT = f"compile struct<returncode:int,stderr:string>, map_setup {RUN}, load struct<returncode:int,stderr:string,stdout:string>, success_log_checks array<struct<name:string,passed:boolean>>, source_semantics array<struct<name:string,passed:boolean>>, functional array<struct<name:string,passed:boolean,map_updates:{RUN}>>"


def split_entries(lines: DataFrame) -> DataFrame:
    """(place, case_id, valid) of a split's lines (line_no, line), in their order: comments and empty lines go; paths and file names are not valid."""
    entry = F.trim(F.substring_index("line", "#", 1))
    return lines.withColumn("case_id", entry).where("case_id <> ''").select(F.col("line_no").alias("place"), "case_id", (~F.col("case_id").contains("/") & ~F.col("case_id").endswith(".txt")).alias("valid"))


def selected(entries: DataFrame, cases: DataFrame) -> DataFrame:
    """(place, case_id, problem): the entries in their order; problem is duplicate or unknown."""
    n = F.count("*").over(Window.partitionBy("case_id"))
    met = entries.withColumn("n", n).join(cases.select("case_id").distinct().withColumn("known", F.lit(True)), "case_id", "left")
    return met.select("place", "case_id", F.when(F.col("n") > 1, "duplicate").when(F.col("known").isNull(), "unknown").alias("problem"))


def discovered(files: DataFrame, needed: str = "buggy.bpf.c") -> DataFrame:
    """(case_id) of the cases of a file listing (case_id, name) that have the source file."""
    return files.where(F.col("name") == needed).select("case_id").distinct()


def stripped(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def trimmed_log(text: Column) -> Column:
    """The log from the line of its begin mark to that of its end mark; all of it without both."""
    both = text.contains("BEGIN PROG LOAD LOG") & text.contains("-- END PROG LOAD LOG --")
    part = F.regexp_extract(text, r"(?s)([^\n]*BEGIN PROG LOAD LOG.*?-- END PROG LOAD LOG --[^\n]*)", 1)
    return F.concat(stripped(F.when(both & (part != ""), part).otherwise(text)), F.lit("\n"))


def diagnostic_input(mode: Column, log: Column, diagnostic: Column) -> Column:
    """(label, text) that a mode shows; null for the mode without any."""
    text = F.when(mode == "raw", log).when(mode == "trimmed-raw", trimmed_log(log)).when(mode == "diagnostic", diagnostic)
    label = F.create_map(*(F.lit(x) for p in LABELS.items() for x in p))[mode]
    return F.when(label.isNotNull(), F.struct(label.alias("label"), text.alias("text")))


def prompt(mode: Column, source: Column, log: Column, diagnostic: Column) -> Column:
    """The text that asks for a repair, with what the mode shows."""
    shown = diagnostic_input(mode, log, diagnostic)
    block = F.coalesce(F.concat(F.lit("\n"), shown["label"], F.lit(":\n```text\n"), shown["text"], F.lit("\n```\n")), F.lit("\nThere is no diagnostic in this mode.\n"))
    return F.concat(F.lit("Fix the rejection of this program and return its whole source in a fenced ```c block. Keep its programs, maps, sections and license.\n\nSource file:\n```c\n"), source, F.lit("\n```\n"), block)


def truncated(text: Column, limit: int) -> Column:
    """A long text's beginning and end."""
    head = limit // 2
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit("\n... <truncated> ...\n"), F.right(text, F.lit(limit - head))))


def extracted_source(response: Column) -> Column:
    """The first fenced block of a response, else the response if it looks like a whole program; null otherwise."""
    fenced = F.regexp_extract(response, r"(?s)```(?:c|C)?\s*(.*?)```", 1)
    has_fence = response.rlike(r"(?s)```(?:c|C)?\s*.*?```")
    whole = stripped(response)
    return F.when(has_fence, F.concat(stripped(fenced), F.lit("\n"))).when(whole.contains("#include") & whole.contains("SEC("), F.concat(whole, F.lit("\n")))


def failure_stage(returncode: Column, report: Column) -> Column:
    """Where a checked repair failed first, from the checker's report as JSON."""
    r = F.from_json(report, REPORT)
    failed = lambda a: F.coalesce(F.exists(a, lambda x: ~x["passed"].eqNullSafe(F.lit(True))), F.lit(False))
    bad = lambda a: F.coalesce(F.exists(a, lambda x: x["returncode"].isNotNull() & (x["returncode"] != 0)), F.lit(False))
    setup = F.coalesce(F.exists(r["functional"], lambda x: bad(x["map_updates"])), F.lit(False))
    code = lambda s: s.isNotNull() & (F.coalesce(s["returncode"], F.lit(-1)) != 0)
    return (
        F.when(returncode == 0, "pass").when(r.isNull() | ~F.trim(report).startswith("{"), "oracle_parse").when(code(r["compile"]), "compile").when(bad(r["map_setup"]), "map_setup").when(code(r["load"]), "verifier_load")
        .when(failed(r["success_log_checks"]) | failed(r["source_semantics"]), "auxiliary_proof_predicate").when(setup, "map_setup").when(failed(r["functional"]), "functional_oracle").otherwise("oracle")
    )


def retry_context(returncode: Column, report: Column, candidate: Column) -> Column:
    """What a second attempt is told of the first one's failure."""
    r = F.from_json(report, REPORT)
    block = lambda title, text: F.concat(F.lit(f"\n{title}\n```text\n"), text, F.lit("\n```"))
    names = F.concat(*(F.coalesce(F.transform(F.filter(a, lambda x: ~x["passed"].eqNullSafe(F.lit(True))), lambda x: x["name"]), F.array().cast("array<string>")) for a in (r["success_log_checks"], r["functional"])))
    return F.concat_ws(
        "\n", F.lit("Previous repair attempt failed."), F.concat(F.lit("Failure stage: "), failure_stage(returncode, report)), F.concat(F.lit("\nPrevious candidate source:\n```c\n"), truncated(candidate, 20_000), F.lit("\n```")),
        F.when(r["compile"]["returncode"] != 0, block("Compiler stderr from previous attempt:", truncated(F.coalesce(r["compile"]["stderr"], F.lit("")), 12_000))),
        F.when(r["load"]["returncode"] != 0, block("Load output from previous attempt:", truncated(F.concat(F.coalesce(r["load"]["stderr"], F.lit("")), F.coalesce(r["load"]["stdout"], F.lit(""))), 20_000))),
        F.when(F.size(names) > 0, block("Failed checks from previous attempt:", F.array_join(names, "\n"))), F.lit("\nTry again."),
    )


def with_retry(prompt_: Column, context: Column) -> Column:
    return F.when(context.isNull(), prompt_).otherwise(F.concat(prompt_, F.lit("\n\nRetry context:\n"), context, F.lit("\n")))


# ---- manifests and audits ----


def prompt_rows(cases: DataFrame, modes: tuple = MODES) -> DataFrame:
    """(case_id, mode, sha256, chars): digest and length of every case's prompt in every mode. Four rows a case."""
    rows = cases.withColumn("mode", F.explode(F.array(*map(F.lit, modes)))).withColumn("p", prompt(F.col("mode"), F.col("source"), F.col("log"), F.col("diagnostic")))
    return rows.select("case_id", "mode", F.sha2("p", 256).alias("sha256"), F.length("p").alias("chars"))


def prompt_index(rows: DataFrame) -> DataFrame:
    """(case_id, mode, row): of several rows of a key, the one listed last (place)."""
    return rows.groupBy("case_id", "mode").agg(F.max_by(F.struct("sha256", "chars"), "place").alias("row"))


def manifest_problems(expected: DataFrame, found: DataFrame) -> DataFrame:
    """(case_id, mode, problem): prompts that are missing, extra or different in digest or length."""
    from .audit import difference

    return difference(expected, found, ["case_id", "mode"], ["sha256", "chars"]).withColumnRenamed("change", "problem")


def split_metadata(entries: DataFrame) -> DataFrame:
    """(case_count, sha256): of a split's cases in their order."""
    return entries.agg(F.count("*").alias("case_count"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "case_id"))), lambda x: x["case_id"]), "\n"), 256).alias("sha256"))


def stage_of(failure: Column, status: Column) -> Column:
    """A result's stage: the one it names, else from its status."""
    return F.coalesce(failure, F.when(status == "pass", "pass").when(status == "prompt_written", "prompt_only"))


def normalized_uname(value: Column) -> Column:
    """A system's name without the host's."""
    parts = F.split(F.trim(value), r"\s+")
    return F.when((F.get(parts, F.lit(0)) == "Linux") & (F.size(parts) >= 3), F.concat_ws(" ", F.lit("Linux"), F.lit("<host>"), F.array_join(F.slice(parts, 3, 1 << 20), " "))).otherwise(value)


def has_fingerprint(sha256: Column) -> Column:
    return F.coalesce(F.trim(sha256).rlike("^[0-9a-fA-F]{64}$"), F.lit(False))


def result_problems(results: DataFrame, expected: DataFrame) -> DataFrame:
    """(run_id, case_id, problem) of results (run_id, mode, case_id, status, failure_stage, prompt_sha256) against expected prompts
    (case_id, mode, sha256): unknown stages, stages that contradict the status, repeats, other prompts, and cases without a result."""
    stage = stage_of(F.col("failure_stage"), F.col("status"))
    n = F.count("*").over(Window.partitionBy("run_id", "case_id"))
    met = results.withColumn("n", n).join(expected.withColumnRenamed("sha256", "_sha"), ["case_id", "mode"], "left")
    clash = ((F.col("status") == "pass") & (stage != "pass")) | ((F.col("status") != "pass") & (stage == "pass"))
    problems = F.array(F.when(stage.isNull() | ~stage.isin(*STAGES), "stage"), F.when(clash, "status"), F.when(F.col("n") > 1, "repeated"), F.when(F.col("_sha").isNull(), "not in the split"), F.when(F.col("_sha") != F.col("prompt_sha256"), "prompt"))
    own = met.select("run_id", "case_id", F.explode(F.filter(problems, lambda x: x.isNotNull())).alias("problem"))
    runs = results.select("run_id", "mode").distinct()
    missing = runs.join(expected, "mode").join(results.select("run_id", "case_id"), ["run_id", "case_id"], "left_anti").select("run_id", "case_id", F.lit("missing").alias("problem"))
    return own.unionByName(missing).distinct()


def identity_problems(runs: DataFrame, fields: tuple = ("split_sha256", "model", "kernel", "clang")) -> DataFrame:
    """(field, values): fields of runs (run_id, ...) that are not the same in all of them."""
    out = None
    for f in fields:
        part = runs.agg(F.lit(f).alias("field"), F.sort_array(F.collect_set(f)).alias("values")).where(F.size("values") > 1)
        out = part if out is None else out.unionByName(part)
    return out


def paired_results(results: DataFrame, modes: tuple) -> DataFrame:
    """(case_id, one column of passes for each mode)."""
    return results.groupBy("case_id").pivot("mode", list(modes)).agg(F.max((F.col("status") == "pass").cast("int")))


def case_file_problems(files: DataFrame, required: tuple = ("buggy.bpf.c", "test.py", "verifier.log", "diagnostic.txt")) -> DataFrame:
    """(case_id, problem): files of a case that are missing or that do not belong there."""
    seen = files.groupBy("case_id").agg(F.collect_set("name").alias("names"))
    want = F.array(*map(F.lit, required))
    missing = F.transform(F.array_except(want, F.col("names")), lambda n: F.concat(F.lit("missing "), n))
    extra = F.transform(F.array_except(F.col("names"), want), lambda n: F.concat(F.lit("extra "), n))
    return seen.select("case_id", F.explode(F.concat(missing, extra)).alias("problem"))


def diagnostic_problems(diagnostics: DataFrame) -> DataFrame:
    """(case_id, problem): rendered diagnostics (case_id, text) that lack a header, a class, an action, a place or a required proof."""
    rules = {"header": r"^error\[[A-Z0-9-]+\]: .+", "class": r"(?m)^\s*= class: \w+", "action": r"(?m)^\s*= next action: \w+", "place": r"(?m)^\s*--> .+:\d+$", "proof": r"(?m)^\s*= required proof: .+"}
    return diagnostics.select("case_id", F.explode(F.filter(F.array(*(F.when(~F.col("text").rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())).alias("problem"))


def prompt_problems(cases: DataFrame, forbidden: tuple = FORBIDDEN) -> DataFrame:
    """(case_id, mode, word): prompts that give away what they ask for."""
    rows = cases.withColumn("mode", F.explode(F.array(*map(F.lit, MODES)))).withColumn("p", F.lower(prompt(F.col("mode"), F.col("source"), F.col("log"), F.col("diagnostic"))))
    return rows.select("case_id", "mode", F.explode(F.filter(F.array(*(F.when(F.col("p").contains(w), F.lit(w)) for w in forbidden)), lambda x: x.isNotNull())).alias("word"))


def oracle_kinds(cases: DataFrame, default: tuple) -> DataFrame:
    """(case_id, kind): the kinds of checks of each case, its own or the manifest's."""
    return cases.select("case_id", F.explode(F.coalesce(F.col("kinds"), F.array(*map(F.lit, default)))).alias("kind"))


# ---- checks of solutions' sources, and what oracles cover ----


def source_checks(sources: DataFrame, predicates: DataFrame) -> DataFrame:
    """(source_id, name, passed, error): each predicate of the source's case on its text.

    sources: (source_id, case_id, text), null if it could not be read; predicates: (case_id, name, wanted, pattern), a row for each: a pattern
    that the text without comments has to match (wanted) or must not. An unreadable text passes nothing and says so; a predicate without
    a pattern is an error of its own."""
    bare = F.regexp_replace(F.regexp_replace("text", r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " ")
    met = sources.withColumn("_bare", bare).join(F.broadcast(predicates), "case_id")
    error = F.when(F.col("text").isNull(), "cannot read the source").when(F.col("pattern").isNull(), "no pattern")
    holds = F.expr("regexp_like(_bare, pattern)") == F.col("wanted")
    return met.select("source_id", "name", F.coalesce(F.when(error.isNull(), holds), F.lit(False)).alias("passed"), error.alias("error"))


#: What an oracle of its own may say that it covers.
COVERED = ("expected_reject_substrings", "functional_tests", "required_success_substrings", "required_success_predicates")


def oracle_coverage(oracles: DataFrame) -> DataFrame:
    """Adds to oracles (case_id, text of a test's source) how many entries each list of its coverage has; null where it has none.

    The lists are those of the literal CUSTOM_ORACLE_COVERAGE; for the rejected texts the list EXPECTED_REJECT_SUBSTRINGS counts where that
    has none. Entries are counted at the top level of the literal: strings with commas and nested brackets are one."""
    string = r"\"(?:[^\"\\\\]|\\\\.)*\"|'(?:[^'\\\\]|\\\\.)*'"
    inner = rf"(?:{string}|[^\[\]()\"'#]|\([^()]*\)|\[[^\[\]]*\])*"
    plain = F.regexp_replace("text", r"(?m)^\s*#[^\n]*$", "")
    declared = F.regexp_extract(plain, r"(?ms)^CUSTOM_ORACLE_COVERAGE\s*(?::[^=\n]*)?=\s*\{(.*?)^\}", 1)

    def entries(body):
        """Commas outside strings and brackets, and one more for what follows the last."""
        flat = F.regexp_replace(F.regexp_replace(body, string, "s"), r"\([^()]*\)|\[[^\[\]]*\]", "s")
        return F.size(F.filter(F.split(flat, ","), lambda x: F.trim(F.regexp_replace(x, r"\s", "")) != ""))

    def count(source, head: str):
        body = F.regexp_extract(source, rf"(?ms){head}\s*[\[(]({inner})[\])]", 1)
        return F.when(source.rlike(rf"(?ms){head}\s*[\[(]{inner}[\])]"), entries(body))

    named = {c: count(declared, rf"[\"']{c}[\"']\s*:") for c in COVERED}
    named[COVERED[0]] = F.coalesce(named[COVERED[0]], count(plain, r"^EXPECTED_REJECT_SUBSTRINGS\s*(?::[^=\n]*)?="))
    return oracles.select("case_id", *(c.cast("int").alias(n) for n, c in named.items()))
