"""Sources: analysis results, tasks, coverage, test reports, findings, configuration, histories."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import durable

# Severities of the tools, made one.
SEVERITIES = {"1": "HIGH", "2": "MEDIUM", "3": "LOW", "4": "LOW", "5": "LOW", "error": "HIGH", "warning": "MEDIUM", "info": "LOW", "ignore": "LOW"}


def analysis(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Analysis shards: the project's id and commit are those of the first shard by path; classes of all shards are rows."""
    reader = spark.read.option("multiLine", True)
    rows = (reader.schema(schema) if schema else reader).json(path).withColumn("__path", F.input_file_name())
    head = rows.groupBy().agg(F.min_by(F.struct("project_id", "commit_hash"), "__path").alias("h"))
    classes = rows.select("__path", F.posexplode("classes").alias("ord", "class"))
    return classes.join(F.broadcast(head)).select("h.project_id", "h.commit_hash", "class.*").drop("__path")


def analysis_errors(spark: SparkSession, path: str) -> DataFrame:
    """Errors of the first shard by path, with its project's id; the others repeat them."""
    rows = spark.read.option("multiLine", True).json(path).withColumn("__path", F.input_file_name())
    first = rows.agg(F.min_by(F.struct("project_id", "errors"), "__path").alias("h"))
    return first.select("h.project_id", F.explode("h.errors").alias("e")).select("project_id", "e.*")


def tasks(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank lines skipped, bad ones told in ``_corrupt_record`` and left to the caller to count; each row is a result, a task or both."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    names = {f.name for f in rows.schema}
    result = F.lit(False)
    for c in ("status", "tests_run", "generated_test_code"):
        if c in names:
            result = result | F.col(c).isNotNull()
    task = F.col("method_name").isNotNull() if "method_name" in names else F.lit(False)
    return rows.withColumn("kind", F.when(F.col("_corrupt_record").isNotNull(), "bad").when(result & task, "both").when(result, "result").otherwise("task"))


def task_file(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tasks of a file, or of the files of a pattern, of any of the formats, told by its ending: lines of JSON, one JSON document or YAML with a list ``tasks``."""
    if path.endswith(".jsonl"):
        return good_tasks(tasks(spark, path, schema)).drop("kind")
    if path.endswith(".json"):
        return spark.read.option("multiLine", True).schema(f"tasks array<struct<{schema.replace(' ', ':').replace(',:', ',')}>>").json(path).select(F.explode("tasks").alias("t")).select("t.*")
    if not path.endswith((".yaml", ".yml")):
        raise ValueError(f"no format for {path}")
    lines = yaml_lines(spark, path)
    item = F.col("key").rlike(r"^tasks\[\d+\]\.[^.]+$")
    cells = lines.where(item).select("path", F.regexp_extract("key", r"\[(\d+)\]", 1).cast("int").alias("at"), F.regexp_extract("key", r"([^.]+)$", 1).alias("name"), "value")
    names = [c.split()[0] for c in schema.split(", ")]
    wide = cells.groupBy("path", "at").agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    return wide.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])


def _texts(spark: SparkSession, path: str, include: str | None) -> DataFrame:
    """Path and whole text of files, or of those of a folder, however deep, whose names fit a pattern."""
    reader = spark.read.format("text").option("wholetext", True)
    if include:
        reader = reader.option("recursiveFileLookup", True).option("pathGlobFilter", include)
    return reader.load(path).select(F.input_file_name().alias("path"), "value")


def numbered(rows: DataFrame, by: list[str], name: str) -> DataFrame:
    """The rows with their place from 1 in that order: places within ranges, and how many rows the ranges before hold. The driver is not asked, and no task gets all rows."""
    order = [F.col(f"`{c}`") for c in by]
    kept = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("__id", F.monotonically_increasing_id())
    kept = kept.withColumn("__part", F.shiftright("__id", 33))
    sizes = kept.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # a row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("__before") + F.col("__id") - F.shiftleft("__part", 33) + 1
    return kept.join(F.broadcast(sizes.select("__part", before.alias("__before"))), "__part").withColumn(name, place.cast("int")).drop("__id", "__part", "__before")


def yaml_lines(spark: SparkSession, path: str, include: str | None = None) -> DataFrame:
    """Leaves of YAML files: path, line, key (names joined by dots, places in lists in brackets) and value.

    The plain part of YAML is read: maps and lists by indentation, scalars with or without quotes, comments. A file is a row and is gone through once.
    """
    import pandas as pd

    def read(batches):
        for batch in batches:
            found = [(p, *leaf) for p, text in zip(batch["path"], batch["value"]) for leaf in _leaves(text)]
            yield pd.DataFrame(found, columns=["path", "line", "key", "value"])

    return _texts(spark, path, include).mapInPandas(read, "path string, line int, key string, value string")


def _leaves(text: str) -> list[tuple[int, str, str]]:
    import re

    out, stack = [], []  # of (indent, key, places counted in its list)
    for n, line in enumerate(text.splitlines()):
        line = re.sub(r"""^((?:[^'"#]|'[^']*'|"[^"]*")*?)(?:^|\s)#.*$""", r"\1", line).rstrip()
        if not line.strip() or line.strip() in ("---", "..."):
            continue
        indent, rest = len(line) - len(line.lstrip()), line.strip()
        while stack and stack[-1][0] >= indent and not (rest.startswith("- ") and stack[-1][0] == indent and not stack[-1][1].endswith("]")):
            stack.pop()
        while rest.startswith("- ") or rest == "-":
            owner = stack[-1] if stack else None
            place = owner[2] if owner else 0
            if owner:
                owner[2] = place + 1
            stack.append([indent, f"{owner[1] if owner else ''}[{place}]", 0])
            inner = rest[1:].lstrip()
            indent, rest = indent + len(rest) - len(inner), inner
        name = re.match(r"""^(?:"([^"]*)"|'([^']*)'|([^\s:][^:]*?))\s*:(?:\s+(.*))?$""", rest)
        base = stack[-1][1] if stack else ""
        if name:
            key = (base + "." if base else "") + next(x for x in name.groups()[:3] if x is not None)
            if name.group(4):
                out.append((n, key, _scalar(name.group(4))))
            else:
                stack.append([indent, key, 0])
        elif rest:
            out.append((n, base, _scalar(rest)))
    return out


def _scalar(x: str) -> str:
    x = x.strip()
    return x[1:-1] if len(x) > 1 and x[0] == x[-1] and x[0] in "'\"" else x


def configuration(spark: SparkSession, path: str) -> DataFrame:
    """Keys and values of the .properties and YAML files of a folder; the first by path and line wins."""
    rows = _property_lines(spark, path, "*.properties").unionByName(yaml_lines(spark, path, "*.{yml,yaml}"))
    return rows.groupBy("key").agg(F.min_by("value", F.struct("path", "line")).alias("value"))


def good_tasks(rows: DataFrame) -> DataFrame:
    return rows.where("kind <> 'bad'").drop("_corrupt_record")


def coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage XML: package, class, type of counter, missed, covered; rate is null where nothing counts."""
    schema = "_name string, class array<struct<_name:string,counter:array<struct<_type:string,_missed:long,_covered:long>>>>"
    rows = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path)
    rows = rows.select(F.replace("_name", F.lit("/"), F.lit(".")).alias("package"), F.explode("class").alias("c")).select("package", F.replace("c._name", F.lit("/"), F.lit(".")).alias("class"), F.explode("c.counter").alias("k"))
    return rows.select("package", "class", F.col("k._type").alias("type"), F.col("k._missed").alias("missed"), F.col("k._covered").alias("covered"), F.try_divide("k._covered", F.col("k._missed") + F.col("k._covered")).alias("rate"))


def method_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Coverage XML by method: class, method, descriptor, type of counter, missed, covered and rate."""
    counter = "array<struct<_type:string,_missed:long,_covered:long>>"
    schema = f"_name string, class array<struct<_name:string,method:array<struct<_name:string,_desc:string,counter:{counter}>>>>"
    rows = spark.read.format("xml").option("rowTag", "package").schema(schema).load(path).select(F.explode("class").alias("c"))
    rows = rows.select(F.replace("c._name", F.lit("/"), F.lit(".")).alias("class"), F.explode("c.method").alias("m")).select("class", F.col("m._name").alias("method"), F.col("m._desc").alias("descriptor"), F.explode("m.counter").alias("k"))
    return rows.select("class", "method", "descriptor", F.col("k._type").alias("type"), F.col("k._missed").alias("missed"), F.col("k._covered").alias("covered"), F.try_divide("k._covered", F.col("k._missed") + F.col("k._covered")).alias("rate"))


def coverage_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("type").agg(F.sum("missed").alias("missed"), F.sum("covered").alias("covered")).withColumn("rate", F.try_divide("covered", F.col("missed") + F.col("covered")))


def test_cases(spark: SparkSession, path: str) -> DataFrame:
    """Test report XML, however suites nest: every testcase element is a row."""
    problem = "struct<_message:string,_type:string,_VALUE:string>"
    rows = spark.read.format("xml").option("rowTag", "testcase").schema(f"_name string, _classname string, _time double, failure {problem}, error {problem}, skipped string").load(path)
    status = F.when(F.col("failure").isNotNull(), "failure").when(F.col("error").isNotNull(), "error").when(F.col("skipped").isNotNull(), "skipped").otherwise("passed")
    return rows.select(F.col("_classname").alias("class"), F.col("_name").alias("name"), F.col("_time").alias("seconds"), status.alias("status"), F.coalesce("failure._message", "error._message").alias("message"))


def test_summary(spark: SparkSession, path: str) -> DataFrame:
    """By report its path and totals: of its cases, or where it has none of its outermost suites' own figures."""
    problem = "struct<_message:string,_type:string,_VALUE:string>"
    cases = spark.read.format("xml").option("rowTag", "testcase").schema(f"_name string, failure {problem}, error {problem}, skipped string").load(path)
    cases = cases.groupBy(F.input_file_name().alias("path")).agg(F.count(F.lit(1)).alias("tests"), F.count_if(F.col("failure").isNotNull()).alias("failures"), F.count_if(F.col("error").isNotNull()).alias("errors"), F.count_if(F.col("skipped").isNotNull()).alias("skipped"))
    names = ("tests", "failures", "errors", "skipped")
    suites = spark.read.format("xml").option("rowTag", "testsuite").schema("_name string, _tests long, _failures long, _errors long, _skipped long").load(path)
    suites = suites.groupBy(F.input_file_name().alias("path")).agg(*[F.coalesce(F.sum(f"_{c}"), F.lit(0)).alias(c) for c in names]).join(cases.select("path"), "path", "left_anti")
    return cases.unionByName(suites).withColumn("passed", F.greatest(F.lit(0), F.col("tests") - F.col("failures") - F.col("errors") - F.col("skipped")))


def findings(spark: SparkSession, path: str, tool: str) -> DataFrame:
    """Findings of spotbugs, pmd or checkstyle in one schema."""
    if tool == "spotbugs":
        rows = spark.read.format("xml").option("rowTag", "BugInstance").schema("_type string, _priority string, LongMessage string, Class struct<_classname:string>, SourceLine struct<_sourcepath:string,_start:long>").load(path)
        rows = rows.select(F.col("_priority").alias("s"), F.col("_type").alias("rule_id"), F.col("LongMessage").alias("message"), F.col("SourceLine._sourcepath").alias("file_path"), F.col("SourceLine._start").alias("line_number"), F.col("Class._classname").alias("class_name"))
    elif tool == "pmd":
        rows = spark.read.format("xml").option("rowTag", "file").schema("_name string, violation array<struct<_beginline:long,_rule:string,_priority:string,_class:string,_VALUE:string>>").load(path)
        rows = rows.select("_name", F.explode("violation").alias("v")).select(F.col("v._priority").alias("s"), F.col("v._rule").alias("rule_id"), F.trim("v._VALUE").alias("message"), F.col("_name").alias("file_path"), F.col("v._beginline").alias("line_number"), F.col("v._class").alias("class_name"))
    elif tool == "checkstyle":
        rows = spark.read.format("xml").option("rowTag", "file").schema("_name string, error array<struct<_line:long,_severity:string,_message:string,_source:string,_VALUE:string>>").load(path)
        rows = rows.select("_name", F.explode("error").alias("v")).select(F.col("v._severity").alias("s"), F.col("v._source").alias("rule_id"), F.col("v._message").alias("message"), F.col("_name").alias("file_path"), F.col("v._line").alias("line_number"), F.lit(None).cast("string").alias("class_name"))
    else:
        raise ValueError(f"no such tool: {tool}")
    known = F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv])
    return rows.select(F.lit(tool).alias("tool"), F.coalesce(F.try_element_at(known, F.lower("s")), F.lit("MEDIUM")).alias("severity"), "rule_id", "message", "file_path", "line_number", "class_name")


def _property_lines(spark: SparkSession, path: str, include: str | None = None) -> DataFrame:
    rows = _texts(spark, path, include).select("path", F.posexplode(F.split("value", "\r?\n")).alias("line", "text"))
    return rows.where(F.col("text").rlike(r"^\s*[^#!\s].*[=:]")).select("path", "line", F.trim(F.regexp_extract("text", r"^\s*([^=:\s]+)\s*[=:]", 1)).alias("key"), F.trim(F.regexp_extract("text", r"^[^=:]*[=:](.*)$", 1)).alias("value"))


def properties(spark: SparkSession, path: str) -> DataFrame:
    """Keys and values of .properties files; the first by path and line wins."""
    return _property_lines(spark, path).groupBy("key").agg(F.min_by("value", F.struct("path", "line")).alias("value"))


def listed(spark: SparkSession, path: str, include: str = "*", exclude: tuple[str, ...] = ()) -> DataFrame:
    """``path`` of every file below a folder whose name fits the pattern, but for those whose path holds a text of ``exclude``. Names that begin with ``_`` or ``.`` are left out.

    Tasks list the folders, level by level; the driver gets neither files nor folders. The path is a URI that Arrow's file systems open.
    """
    fits = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(include).compiled().pattern()

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for folder in batch.column("path").to_pylist():
                store, base = fs.FileSystem.from_uri(folder)
                found = [(f"{folder}/{x.base_name}", x.type == fs.FileType.Directory) for x in store.get_file_info(fs.FileSelector(base)) if not x.base_name.startswith(("_", "."))]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found[at : at + 10_000])], names=["path", "folder"])

    folders, levels = spark.createDataFrame([(path.rstrip("/"),)], "path string"), []
    while True:
        level = durable(folders.mapInArrow(look, "path string, folder boolean"))
        levels.append(level.where("NOT folder"))
        inner = level.where("folder")
        for x in exclude:
            inner = inner.where(~F.concat("path", F.lit("/")).contains(x))
        if inner.isEmpty():
            break
        folders = inner.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    files = levels[0]
    for level in levels[1:]:
        files = files.unionByName(level)
    for x in exclude:
        files = files.where(~F.col("path").contains(x))
    return files.select("path").where(F.substring_index("path", "/", -1).rlike(f"^(?:{fits})$"))


def contents(files: DataFrame) -> DataFrame:
    """The rows with ``content``, the bytes of the file at ``path``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, told = batch.slice(at, 256), []
                for path in part.column("path").to_pylist():
                    if store is None or not path.startswith(root):
                        store, base = fs.FileSystem.from_uri(path.rpartition("/")[0])
                        root = path.rpartition("/")[0].removesuffix(base)
                    with store.open_input_file(path.removeprefix(root)) as one:
                        told.append(one.read())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(told, pa.binary())], names=[*part.schema.names, "content"])

    return files.mapInArrow(read, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema) + ", content binary")


def sources(spark: SparkSession, path: str, include: str = "*.java", exclude: tuple[str, ...] = ()) -> DataFrame:
    """Source files as path and text, filtered before they are read; ``ord`` numbers them by path. What is not UTF-8 has no text but an ``error``.

    Files are listed, numbered and read by tasks.
    """
    rows = contents(numbered(listed(spark, path, include, exclude), ["path"], "ord"))
    text = F.expr("try_validate_utf8(cast(content as string))")
    return rows.select("ord", "path", text.alias("text"), F.when(text.isNull(), "not UTF-8").alias("error"))


def class_files(spark: SparkSession, path: str, schema: str, by: str | None = None) -> DataFrame:
    """What ``writers.class_files`` wrote: ``path``, the columns of ``schema`` and, with ``by``, ``errors``, those of its project in order."""
    rows = contents(listed(spark, path, "*.json")).select("path", F.from_json(F.col("content").cast("string"), schema).alias("c")).select("path", "c.*")
    if by is None:
        return rows
    errors = spark.read.schema(f"`{by}` string, error string").json(f"{path.rstrip('/')}/_errors")
    return rows.join(errors.groupBy(by).agg(F.sort_array(F.collect_list("error")).alias("errors")), by, "left")


def commit_counts(log: DataFrame) -> DataFrame:
    """Commits by path, from an extracted log (commit, path)."""
    return log.groupBy("path").agg(F.count_distinct("commit").alias("commits"))


def history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, timestamp long, total_tasks int, succeeded int, failed int, skipped int, success_rate double").json(path)


def class_shards(spark: SparkSession, path: str) -> DataFrame:
    """Shards of classes, with the ``folder`` each lies in, by which they can be pruned."""
    return spark.read.json(path)


def file_list(spark: SparkSession, path: str) -> DataFrame:
    """The lines of a list, with their place."""
    return ordered_lines(spark, path).withColumnRenamed("line", "path")


def ordered_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of files in order, with their place from 1: files by path, lines as they stand."""
    rows = spark.read.text(path).select(F.input_file_name().alias("__path"), F.monotonically_increasing_id().alias("__at"), F.col("value").alias("line"))
    return numbered(rows, ["__path", "__at"], "place").select("place", "line")
