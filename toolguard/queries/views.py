"""Query inputs as DataFrames, derived from the given tables (see ``seeds``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolguard import rules
from toolguard.functions import capabilities as caps
from toolguard.functions.constants import constant
from toolguard.queries import seeds

EVENT = ("event_id", "ts", "user_id", "event_type", "value", "props")
_SCHEMAS: dict = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table; its schema is read from the files once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.read.schema(_SCHEMAS[key]).parquet(f"{folder}/{name}.parquet")


def spread(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """Columns of a table for row-level work, spread over the cores if its files make fewer tasks than those.

    A large table comes in many splits and is read as it is, without a shuffle.
    """
    key = (spark.sparkContext.applicationId, folder, name, "splits")
    chosen = table(spark, folder, name).select(*columns)
    if key not in _SCHEMAS:
        _SCHEMAS[key] = chosen.rdd.getNumPartitions()
    cores = spark.sparkContext.defaultParallelism
    return chosen.repartition(cores) if _SCHEMAS[key] < cores else chosen


def stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table as a stream of its files.  The pattern names it whether it is a file or a folder."""
    return spark.readStream.schema(table(spark, folder, name).schema).parquet(f"{folder}/{name}.parque[t]")


def fill(template: Column, **values: Column) -> Column:
    """A text with its ``{name}`` places filled from columns, in the given order."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template


def pick(key: Column, choices: list[Column]) -> Column:
    """The choice at ``key`` modulo the number of choices."""
    return F.get(F.array(*choices), F.pmod(key, F.lit(len(choices))).cast("int"))


def _texts(key: Column, templates: list, **values: Column) -> Column:
    return fill(F.get(constant(templates), F.pmod(key, F.lit(len(templates))).cast("int")), **values)


def _tool_rows(rows: DataFrame) -> DataFrame:
    k = F.col("k")
    file = F.concat(
        F.lit("src/f"), F.pmod(k, F.lit(seeds.FILES)).cast("string"), _texts(k, seeds.EXTENSIONS)
    )
    return rows.select(
        "repo_id",
        file.alias("file"),
        caps.language(file).alias("language"),
        k.alias("seq"),
        _texts(k, seeds.NAMES, k=k).alias("name"),
        F.concat(_texts(k, seeds.PHRASES), F.lit(" "), F.col("text")).alias("description"),
        _texts(k, seeds.SNIPPETS).alias("code_snippet"),
    )


def tools(spark: SparkSession, folder: str) -> DataFrame:
    """A tool per document (long descriptions) and per conversation turn (short ones).

    The turns of half of the conversations share three repositories, by role; each other turn has its own.
    """
    documents = spread(spark, folder, "documents", "source", "doc_id", "text").select(
        F.col("source").alias("repo_id"), F.col("doc_id").alias("k"), "text"
    )
    turns = spread(spark, folder, "conversations", "conv_id", "turn", "role", "text").select(
        F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("chat_"), F.col("role")))
        .otherwise(F.concat_ws("-", F.lit("chat"), F.col("conv_id").cast("string"), F.col("turn").cast("string")))
        .alias("repo_id"),
        (F.col("conv_id") * 100 + F.col("turn")).alias("k"),
        "text",
    )
    return _tool_rows(documents.unionByName(turns))


def file_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Behavior flags of the files that tools name: those of their snippets together."""
    found = tools(spark, folder).select(
        "repo_id", F.col("file").alias("path"),
        F.explode(caps.flags_by_language(F.col("code_snippet"), caps.is_js(F.col("file")))).alias("flag"),
    )
    in_order = F.filter(constant(rules.CATEGORIES), lambda c: F.array_contains("flags", c)).alias("flags")
    return found.groupBy("repo_id", "path").agg(F.collect_set("flag").alias("flags")).select("repo_id", "path", in_order)


def repos(spark: SparkSession, folder: str) -> DataFrame:
    """All repositories: those with tools, with requirements, and some with neither."""
    named = tools(spark, folder).select("repo_id")
    parts = table(spark, folder, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("repo_id"))
    empty = table(spark, folder, "nation").select(F.lower("n_name").alias("repo_id"))
    return named.unionByName(parts).unionByName(empty).distinct()


def kind(k: Column) -> Column:
    return _texts(k, ["decorated", "decorated", "constructed", "script", "broken"])


def escaped(text: Column) -> Column:
    """Text for a quoted literal in source code."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cleaned(text: Column) -> Column:
    """Text without quotes and brackets."""
    return F.translate(text, "\"'`(){}", "       ")


def source_files(spark: SparkSession, folder: str) -> DataFrame:
    """A source file per document, with its whole text; copies of a document are copies here."""
    k, lang, form = F.col("doc_id"), F.col("lang"), F.col("kind")
    content = (
        F.when(form == "decorated", fill(F.lit(seeds.PYTHON_DECORATED), lang=lang, text=escaped(F.col("text"))))
        .when(form == "constructed", fill(F.lit(seeds.PYTHON_CONSTRUCTED), lang=lang, text=escaped(F.col("text"))))
        .when(form == "script", fill(F.lit(seeds.SCRIPT), lang=lang, text=cleaned(F.col("text"))))
        .otherwise(fill(F.lit(seeds.PYTHON_BROKEN), lang=lang, text=cleaned(F.col("text"))))
    )
    name = F.concat(
        _texts(k, seeds.FOLDERS), F.lit("m"), k.cast("string"), F.when(form == "script", ".ts").otherwise(".py")
    )
    return (
        spread(spark, folder, "documents", "source", "doc_id", "lang", "text")
        .withColumn("kind", kind(k))
        .select(F.col("source").alias("repo_id"), name.alias("path"), content.alias("content"))
    )


def requirement_files(spark: SparkSession, folder: str) -> DataFrame:
    """A requirements file per part."""
    k = F.col("p_partkey")
    return spread(spark, folder, "part", "p_partkey", "p_size").select(
        F.concat(F.lit("part"), k.cast("string")).alias("repo_id"),
        F.lit("requirements.txt").alias("path"),
        fill(F.lit(seeds.REQUIREMENTS), package=_texts(k, seeds.PACKAGES), size=F.col("p_size")).alias("content"),
    )


def advisories(spark: SparkSession, folder: str) -> DataFrame:
    """An advisory per supplier."""
    k, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, folder, "supplier").select(
        F.lit("PyPI").alias("ecosystem"),
        _texts(k, seeds.ADVISED).alias("package"),
        F.array(F.lit("1.5.0"), F.concat(F.lit("2.0."), nation.cast("string"))).alias("versions"),
        F.concat(F.lit("1."), nation.cast("string")).alias("introduced"),
        F.when(k % 4 != 0, F.concat(F.lit("1."), (nation + 10).cast("string"), F.lit(".0"))).alias("fixed"),
        F.concat(F.lit("ADV-"), k.cast("string")).alias("id"),
        F.when(k % 3 == 0, "").when(k % 3 == 1, F.concat("s_name", F.lit(" allows remote code execution"))).alias("summary"),
        F.when(k % 6 != 5, F.repeat(F.concat("s_name", F.lit(" ")), F.lit(15))).alias("details"),
        _texts(k, seeds.ADVISORY_SEVERITY).alias("severity"),
    )


def static_findings(spark: SparkSession, folder: str) -> DataFrame:
    """A static finding per line item, on paths that need normalizing."""
    severity = F
    for flag, name in seeds.STATIC_SEVERITY.items():
        severity = severity.when(F.col("l_returnflag") == flag, name)
    return table(spark, folder, "lineitem").select(
        F.concat(F.lit("src"), (F.col("l_suppkey") % 20).cast("string")).alias("repo_id"),
        F.concat(
            F.lit("./lib/../src//f"), (F.col("l_partkey") % 2000).cast("string"),
            F.when(F.col("l_linenumber") % 2 == 0, ".py").otherwise(".ts"),
        ).alias("path"),
        F.col("l_linenumber").alias("line"),
        F.concat(F.lit("ships "), F.col("l_linestatus")).alias("message"),
        severity.otherwise(F.lit(None)).alias("severity"),
    )


def verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A reviewer's verdict per label, on the tool of its document."""
    labels, documents = table(spark, folder, "labels"), table(spark, folder, "documents")
    k = F.col("doc_id")
    file = F.concat(F.lit("src/f"), F.pmod(k, F.lit(seeds.FILES)).cast("string"), _texts(k, seeds.EXTENSIONS))
    return labels.join(documents.select("doc_id", "source"), "doc_id").select(
        F.col("source").alias("repo_id"),
        file.alias("file"),
        k.alias("seq"),
        F.explode(
            F.array(
                F.lit("file_access"), F.lit("network_access"),
                F.when(k % 2 == 0, "environment_access").otherwise("subprocess_execution"),
            )
        ).alias("category"),
        (F.col("quality") == 1).alias("covered"),
        F.concat(F.lit("reviewed: quality "), F.col("quality").cast("string"), F.lit(", toxic "), F.col("toxic").cast("string")).alias("reasoning"),
    )


def _call_rows(events: DataFrame) -> DataFrame:
    k = F.col("event_id")
    values = dict(k=F.col("user_id"), props=F.col("props"), value=F.col("value").cast("string"))
    capability_lists = [F.lit(None) if c is None else constant(c) for c in seeds.CALL_CAPABILITIES]
    return events.select(
        k.alias("event_id"),
        F.col("ts").alias("call_ts"),
        _texts(k, seeds.CALL_TOOLS, type=F.col("event_type")).alias("tool_name"),
        _texts(k, [a for a, _, _ in seeds.CALL_ARGUMENTS], **values).alias("arguments"),
        _texts(k, seeds.CALL_DESCRIPTIONS).alias("description"),
        pick(k, capability_lists).alias("capabilities"),
    )


def calls(spark: SparkSession, folder: str) -> DataFrame:
    """A tool call per event."""
    return _call_rows(spread(spark, folder, "events", *EVENT))


def call_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same calls as a stream, with the event time as a timestamp."""
    return _call_rows(stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp")))


def _scan_rows(orders: DataFrame) -> DataFrame:
    score = F
    for status, name in seeds.SCORE_BY_STATUS.items():
        score = score.when(F.col("o_orderstatus") == status, name)
    return orders.select(
        _texts(F.col("o_orderkey"), seeds.SCAN_URLS, k=F.col("o_custkey")).alias("url"),
        score.alias("score"),
        F.col("o_orderdate").alias("scanned_at"),
        F.col("o_orderkey").alias("seq"),
    )


def scans(spark: SparkSession, folder: str) -> DataFrame:
    """A stored scan result per order."""
    return _scan_rows(table(spark, folder, "orders"))


def scan_stream(spark: SparkSession, folder: str) -> DataFrame:
    return _scan_rows(stream(spark, folder, "orders"))


def urls(spark: SparkSession, folder: str) -> DataFrame:
    """A repository URL per page, in many spellings."""
    k = F.col("page_id")
    return table(spark, folder, "pages").select("page_id", _texts(k, seeds.URLS, k=k, url=F.col("url")).alias("url"))


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """All pages with their whole text; some end with an assignment of a secret."""
    k = F.col("page_id")
    leak = F.when(k % 10 == 3, F.concat(F.lit(seeds.PAGE_SECRET), k.cast("string"), F.lit("'</script>"))).otherwise("")
    return spread(spark, folder, "pages", "page_id", "html").select("page_id", F.concat("html", leak).alias("html"))
