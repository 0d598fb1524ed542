"""Records out of report texts.

A section is cut out of each text by one pattern in the row, so only its lines
are exploded; nothing is shuffled to find a section.  Later windows are per
document and so bounded by the size of one text.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import INLINE_MARGIN, compact, compact_lines, list_items, section, section_body, sections, strip

# Keys whose value is a list, keys that belong to a record, fields of an error line, words that name no error.
LIST_KEYS = ("keywords", "operators", "data_fields", "failure_types", "tools_or_functions", "data_contracts")
RECORD_KEYS = (
    "hypothesis",
    "selection_reason",
    "hypothesis_construction",
    "construction_rule",
    "mutation_guidance",
    "duplicate_avoidance",
    "avoid_duplicate_note",
    "example",
    "rejection_reason",
    "reason",
    "forbidden_construction",
    "allowed_exception",
)
# texts whose lines one task sorts
TEXTS_PER_TASK = 25_000
ERROR_FIELDS = ("error_type", "count", "frequency", "cause", "evidence", "fix")
NO_ERROR = ("", "error_type", "repeated failure classes", "none", "n/a", "na", "unknown")
# Headings of the direction sections, and the metadata list that each record key fills;
# of several keys of a list the first with a new value counts.
DIRECTION_HEADINGS = {
    "recommended": "recommended directions (p_succ)",
    "forbidden": "forbidden directions (p_fail)",
}
DIRECTION_LISTS = {
    ("recommended", "recommended_hypotheses"): ["hypothesis"],
    ("recommended", "recommended_selection"): ["selection_reason"],
    ("recommended", "recommended_construction"): ["hypothesis_construction", "construction_rule"],
    ("recommended", "mutation_guidance"): ["mutation_guidance"],
    ("recommended", "duplicate_avoidance"): ["duplicate_avoidance", "avoid_duplicate_note"],
    ("recommended", "recommended_examples"): ["example"],
    ("forbidden", "forbidden_hypotheses"): ["hypothesis"],
    ("forbidden", "forbidden_reasons"): ["rejection_reason", "reason"],
    ("forbidden", "forbidden_construction"): ["forbidden_construction"],
    ("forbidden", "allowed_exceptions"): ["allowed_exception"],
    ("forbidden", "forbidden_examples"): ["example"],
}


def by_key(df: DataFrame, key: str) -> DataFrame:
    """The rows by their key, in tasks of a bounded number of texts: no few input splits hold up the work, and nothing later is shuffled by key."""
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(max(tasks, -(-df.count() // TEXTS_PER_TASK)), key)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that is computed once a row: a plain one is computed anew in each filter and column that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def stripped_lines(body: Column) -> Column:
    return F.transform(F.split(body, "\n"), lambda x: strip(x))


def section_lines(df: DataFrame, key: str, text: str, heading: str) -> DataFrame:
    """(key, pos, line) of the first section of a name and those of the same name right behind it."""
    lines = df.select(key, F.posexplode(stripped_lines(section_body(text, heading))).alias("pos", "line"))
    return lines.where((F.length("line") > 0) & ~F.col("line").startswith("## "))


def all_section_lines(df: DataFrame, key: str, text: str, headings: dict[str, str]) -> DataFrame:
    """(key, section, part, pos, line) of all sections of the names, numbered by part."""
    found = [
        F.transform(sections(text, heading), lambda body, i: F.struct(F.lit(name).alias("section"), i.alias("part"), body.alias("body")))  # noqa: B023
        for name, heading in headings.items()
    ]
    parts = df.select(key, F.inline(F.concat(*found)))
    lines = parts.select(key, "section", "part", F.posexplode(stripped_lines(F.col("body"))).alias("pos", "line"))
    return lines.where(F.length("line") > 0)


def _entry(line: Column) -> Column:
    return strip(F.regexp_replace(line, r"^[-* ]+", ""))


def _key(text: Column) -> Column:
    return F.regexp_replace(F.lower(strip(text)), "[ -]", "_")


def _named(entry: Column) -> Column:
    """Map from the known names of a line to what follows them up to a semicolon; the first of a name counts.

    The numbers and the type may also end at a comma.
    """
    before = rf"(?i)^.*?\b({'|'.join(ERROR_FIELDS)})\s*[=:]"
    pieces = F.split(F.regexp_replace(entry, r"(?i),\s*(?=(?:count|frequency|error_type)\s*[=:])", ";"), ";")
    pairs = F.transform(
        F.filter(pieces, lambda p: p.rlike(before)),
        lambda p: F.struct(F.lower(F.regexp_extract(p, before, 1)).alias("k"), strip(F.regexp_replace(p, before, ""), " ,;").alias("v")),
    )
    # the pairs are the one element of an array, so that they are found once and not anew for each of their names
    first = lambda found: F.map_from_entries(F.filter(found, lambda s, i: F.array_position(found["k"], s["k"]) == i + 1))
    return F.transform(F.array(pairs), first)[0]


def error_reports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Error lines of each text: type, count, frequency, cause, evidence, fix.

    One row per (text, error type); counts of repeated lines are added, other
    fields come from the first line that has them.
    """
    e, named = F.col("entry"), F.col("named")
    text_of = lambda name: F.coalesce(named[name], F.lit(""))
    number = lambda name: F.regexp_extract(text_of(name), r"^[0-9]*\.?[0-9]+", 0)
    # an entry without its own type is named by what stands before the first colon
    explicit = strip(F.split(text_of("error_type"), ",")[0])
    has, prefixed = F.length(explicit) > 0, F.locate(":", e) > 1
    kind = F.when(has, explicit).when(prefixed, strip(F.substring_index(e, ":", 1))).otherwise("")
    rest = F.when(~has & prefixed, strip(e.substr(F.locate(":", e) + 1, F.length(e)))).otherwise(e)
    cause = text_of("cause")
    entries = once(section_lines(by_key(df, key), key, text, "error frequency"), "entry", _entry(F.col("line")))
    read = once(entries.where(F.length("entry") > 0), "named", _named(e))
    lines = (
        once(read, "error_type", kind)
        .select(
            key,
            "pos",
            "error_type",
            F.coalesce(F.regexp_extract(number("count"), r"^\d+", 0).try_cast("bigint"), F.lit(1)).alias("count"),
            number("frequency").try_cast("double").alias("frequency"),
            F.when(F.length(cause) > 0, cause).otherwise(rest).alias("cause"),
            text_of("evidence").alias("evidence"),
            text_of("fix").alias("fix"),
        )
        .where(~F.lower(strip("error_type", "<>")).isin(*NO_ERROR))
    )
    first = lambda c: F.coalesce(
        F.min_by(c, F.when(F.length(c) > 0, F.col("pos"))), F.lit("")
    ).alias(c)
    return (
        lines.groupBy(key, F.lower("error_type").alias("_t"))
        .agg(
            F.min_by("error_type", "pos").alias("error_type"),
            F.sum("count").alias("count"),
            F.min_by("frequency", "pos").alias("frequency"),
            first("cause"),
            first("evidence"),
            first("fix"),
        )
        .drop("_t")
    )


def search_metadata(df: DataFrame, key: str, text: str) -> DataFrame:
    """`key: value` lines of the metadata section; list keys give several values, the last line of a key wins."""
    e = F.col("entry")
    rows = (
        section_lines(df, key, text, "search metadata")
        .withColumn("entry", _entry(F.col("line")))
        .where(e.contains(":"))
        .select(
            key,
            "pos",
            F.regexp_replace(F.lower(strip(F.regexp_extract(e, r"^([^:]*):", 1))), " ", "_").alias("name"),
            strip(F.regexp_extract(e, r"^[^:]*:(.*)$", 1)).alias("value"),
        )
        .where(F.length("name") > 0)
    )
    last = rows.groupBy(key, "name").agg(F.max_by("value", "pos").alias("value"))
    many = F.when(F.col("name").isin(*LIST_KEYS), list_items("value")).otherwise(F.array("value"))
    return last.select(key, "name", many.alias("values"))


def hypothesis_list(df: DataFrame, key: str, text: str) -> DataFrame:
    """Items of the next-hypotheses section without numbering, each once per text."""
    e = _entry(F.col("line"))
    # a number, alone or behind its word, with a closing mark; a plain number may follow a numbered word
    for word in ("(?i)(?:hypothesis|h)", ""):
        e = F.regexp_replace(e, rf"^{word}\s*\d+\s*[-:.)]\s*", "")
    e = strip(e)
    rows = section_lines(df, key, text, "next round hypotheses").select(key, "pos", e.alias("text"))
    kept = rows.where(F.length("text") > 0).groupBy(key, F.lower("text").alias("_t")).agg(
        F.min_by("text", "pos").alias("text"), F.min("pos").alias("pos")
    )
    w = Window.partitionBy(key).orderBy("pos")
    return kept.select(key, "text", F.row_number().over(w).alias("place"))


def direction_reports(df: DataFrame, key: str, text: str) -> DataFrame:
    """Records of the two direction sections as rows (key, section, record, name, value).

    A bullet without a known key, or a `hypothesis:` line, opens a record; other
    `key: value` lines fill it, plain lines become its notes. A heading closes it, so
    the first such line under a heading opens a record too.
    """
    lines = all_section_lines(by_key(df, key), key, text, DIRECTION_HEADINGS)
    line = F.col("line")
    bullet = line.rlike(r"^[-*] ")
    entry = F.when(bullet, strip(F.regexp_replace(line, r"^[-*] ", ""))).otherwise(line)
    rows = once(once(lines, "bullet", bullet), "entry", entry).where(F.length("entry") > 0)
    e = F.col("entry")
    pair = e.contains(":")
    rows, name = once(rows, "name", _key(F.regexp_extract(e, r"^([^:]*):", 1))), F.col("name")
    value = strip(F.regexp_extract(e, r"^[^:]*:(.*)$", 1))
    whole = F.col("bullet") & (~pair | ~name.isin(*RECORD_KEYS))
    opens = whole | (pair & (name == "hypothesis"))
    typed = rows.select(
        key,
        "section",
        "part",
        "pos",
        opens.alias("opens"),
        F.when(whole, "hypothesis").when(pair, name).otherwise("notes").alias("name"),
        F.when(whole, e).when(pair, value).otherwise(e).alias("value"),
        (~whole & ~pair).alias("note"),
    )
    # a note before any record of its part has nothing to attach to
    here = Window.partitionBy(key, "section", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    known = F.sum((~F.col("note")).cast("int")).over(here)
    first = typed.withColumn("_known", known).where("_known > 0")
    opened = (F.col("opens") | (~F.col("note") & (F.col("_known") == 1))).cast("int")
    w = Window.partitionBy(key, "section").orderBy("part", "pos").rowsBetween(Window.unboundedPreceding, 0)
    numbered = first.withColumn("record", F.sum(opened).over(w).cast("int"))
    at = F.struct("part", "pos")
    notes = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("part", "pos", "value"))), lambda s: s["value"]), " "
    )
    return (
        numbered.groupBy(key, "section", "record", "name")
        .agg(
            F.when(F.col("name") == "notes", notes).otherwise(F.max_by("value", at)).alias("value")
        )
        .where(F.length("value") > 0)
    )


def direction_metadata(records: DataFrame, key: str) -> DataFrame:
    """(key, name, values) of `direction_reports` rows: the lists that the records fill, each value once per list.

    Records come in order; of the keys of a list a record gives the first value that is new.
    """
    rules = [
        F.struct(F.lit(s).alias("section"), F.lit(name).alias("list"), F.lit(k).alias("name"), F.lit(i).alias("choice"))
        for (s, name), keys in DIRECTION_LISTS.items()
        for i, k in enumerate(keys)
    ]
    mine = records.withColumn("rule", F.explode(F.array(*rules))).where("rule.section = section AND rule.name = name")
    offers = mine.select(key, F.col("rule.list").alias("list"), F.struct("record", "rule.choice", "value").alias("offer"))
    ordered = offers.groupBy(key, "list").agg(F.sort_array(F.collect_list("offer")).alias("offers"))
    start = F.struct(F.array().cast("array<string>").alias("values"), F.array().cast("array<string>").alias("seen"), F.lit(-1).alias("record"))

    def take(acc, offer):
        fresh = (offer["record"] != acc["record"]) & ~F.array_contains(acc["seen"], F.lower(offer["value"]))
        return F.when(
            fresh,
            F.struct(
                F.array_append(acc["values"], offer["value"]).alias("values"),
                F.array_append(acc["seen"], F.lower(offer["value"])).alias("seen"),
                offer["record"].alias("record"),
            ),
        ).otherwise(acc)

    return ordered.select(key, F.col("list").alias("name"), F.aggregate("offers", start, take)["values"].alias("values"))


def card_sections(df: DataFrame, key: str, text: str, heading: str = "Summary") -> DataFrame:
    """The summary section of a card and its `hypothesis:` block."""
    body = strip(section(text, heading))
    block = F.regexp_extract("summary", r"(?ms)(^[ \t]*hypothesis:.*?)(?=^(?!hypothesis:)\S[^\n]*:|\z)", 1)
    tidy = strip(F.regexp_replace(block, r"(?m)[ \t]+$", ""))
    return df.select(key, F.coalesce(body, F.lit("")).alias("summary")).withColumn("hypothesis", tidy)


def code_blocks(df: DataFrame, key: str, text: str, language: str) -> DataFrame:
    """Fenced blocks of one language as rows."""
    pattern = rf"(?s)```{language}\s*\n(.*?)\n```"
    return df.select(
        key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(1))).alias("block", "code")
    ).withColumn("code", strip("code"))


BLOCK = T.StructType([T.StructField(n, T.StringType()) for n in ("code", "stdout", "stderr", "error", "final_answer")])
ITERATION = T.StructType(
    [T.StructField("iteration", T.LongType()), T.StructField("code_blocks", T.ArrayType(BLOCK))]
)
TRAJECTORY = T.StructType(
    [
        T.StructField("iterations", T.ArrayType(ITERATION)),
        T.StructField("metadata", T.StructType([T.StructField("iterations", T.ArrayType(ITERATION))])),
    ]
)


def trajectories(df: DataFrame, key: str, doc: str) -> DataFrame:
    """Iterations and code blocks of JSON trajectories as rows with shortened texts."""
    parsed = df.select(key, F.from_json(doc, TRAJECTORY).alias("t"))
    its = parsed.select(
        key, F.posexplode(F.coalesce("t.metadata.iterations", "t.iterations")).alias("at", "it")
    )
    blocks = its.select(
        key,
        F.coalesce("it.iteration", F.col("at").cast("bigint")).alias("iteration"),
        F.posexplode("it.code_blocks").alias("block_index", "b"),
    )
    return blocks.select(
        key,
        "iteration",
        "block_index",
        compact_lines("b.code", 4000).alias("code"),
        compact_lines("b.stdout", 1200).alias("stdout"),
        compact_lines("b.stderr", 1200).alias("stderr"),
        compact("b.error", 300, INLINE_MARGIN).alias("error"),
        compact("b.final_answer", 500, INLINE_MARGIN).alias("final_answer"),
    )
