"""Lookups that try one key after another, and lookups guarded by uniqueness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.code import descriptor_types, signature_name, signature_types, split_top_level, unqualified


def unique(dim: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that name exactly one value."""
    return dim.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min(value).alias(value)).where("__n = 1").drop("__n")


def tiered(refs: DataFrame, ref_id: str, tiers: list[tuple[str, DataFrame]], value: str) -> DataFrame:
    """Of each ref the value of the first tier that has one, and the tier's number from 1; 0 if none has.

    Each tier is (column of refs, table of that column with unique keys and the value): an equi-join each,
    so nothing multiplies.
    """
    out = refs
    for n, (key, dim) in enumerate(tiers, 1):
        out = out.join(dim.select(F.col(key).alias(f"__k{n}"), F.col(value).alias(f"__v{n}")), F.col(key) == F.col(f"__k{n}"), "left")
    tier = F.lit(0)
    for n in range(len(tiers), 0, -1):
        tier = F.when(F.col(f"__v{n}").isNotNull(), n).otherwise(tier)
    return out.select(ref_id, F.coalesce(*[f"__v{n}" for n in range(1, len(tiers) + 1)]).alias(value), tier.alias("tier"))


def best_of(candidates: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Of each key the candidate that comes first."""
    return candidates.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def prefixes(name: Column, separator: str = ".") -> Column:
    """All prefixes of a dotted name, itself last."""
    parts = F.split(name, "\\" + separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))


def suffixes(name: Column, separator: str = ".") -> Column:
    parts = F.split(name, "\\" + separator)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), separator))


def outside(rows: DataFrame, name: str, inside: DataFrame, inside_name: str) -> DataFrame:
    """Rows whose name is neither a prefix nor an extension of any inside name: two anti-joins on exploded prefixes instead of a theta join."""
    known = inside.select(F.col(inside_name).alias("__i")).distinct()
    above = known.select(F.explode(prefixes(F.col("__i"))).alias("__p")).distinct()
    names = rows.select(name).distinct()
    under = names.select(name, F.explode(prefixes(F.col(name))).alias("__q")).join(known, F.col("__q") == F.col("__i"), "left_semi").select(F.col(name).alias("__u")).distinct()
    return rows.join(above, F.col(name) == F.col("__p"), "left_anti").join(under, F.col(name) == F.col("__u"), "left_anti")


def resolve_types(refs: DataFrame, ref: str, package: str, types: DataFrame, fqn: str) -> DataFrame:
    """References to types by exact name, by the same package, or by a suffix that only one type has."""
    known = types.select(F.col(fqn).alias("fqn")).distinct()
    ends = unique(known.select("fqn", F.explode(suffixes(F.col("fqn"))).alias("__suffix")), "__suffix", "fqn")
    rows = refs.select(ref, package).distinct().withColumns({"__own": F.concat_ws(".", package, ref), "__id": F.struct(ref, package)})
    tiers = [(ref, known.withColumn(ref, F.col("fqn"))), ("__own", known.withColumn("__own", F.col("fqn"))), ("__any", ends.withColumnRenamed("__suffix", "__any"))]
    found = tiered(rows.withColumn("__any", F.col(ref)), "__id", tiers, "fqn")
    return found.select(F.col(f"__id.{ref}").alias(ref), F.col(f"__id.{package}").alias(package), "fqn", "tier")


def match_rules(rows: DataFrame, row_id: str, rules: DataFrame, on: Column, order: str, limit: int = 10_000) -> DataFrame:
    """The first rule of each row. Rules are broadcast only up to ``limit`` of them, which is checked."""
    n = rules.limit(limit + 1).count()
    side = F.broadcast(rules) if n <= limit else rules
    return best_of(rows.join(side, on), row_id, [F.col(order)])


def implementations(types: DataFrame, links: DataFrame) -> DataFrame:
    """Interface and concrete implementation, from types (fqn, is_interface, is_abstract) and links (fqn, implements)."""
    concrete = types.where("not is_interface and not is_abstract").select("fqn")
    return links.join(concrete, "fqn", "left_semi").select(F.col("implements").alias("interface"), "fqn").distinct()


def symbol_index(methods: DataFrame, keys: tuple[str, ...] = ("package", "name")) -> DataFrame:
    """The symbols that methods declare, with how many declare each."""
    return methods.groupBy(*keys).agg(F.count(F.lit(1)).alias("overloads"))


def symbols_exist(refs: DataFrame, symbols: DataFrame, keys: list[str]) -> DataFrame:
    """The refs with whether the symbol exists and how many overloads it has; symbols may come as an index, with ``overloads``."""
    counts = symbols.groupBy(*keys).agg((F.max("overloads") if "overloads" in symbols.columns else F.count(F.lit(1))).alias("overloads"))
    return refs.join(counts, keys, "left").withColumns({"overloads": F.coalesce("overloads", F.lit(0)), "exists": F.col("overloads").isNotNull()})


def class_candidates(name: Column) -> Column:
    """Names under which a class may be known: as it is, with dots for dollars, and with dollars for dots from each place on."""
    said = F.trim(name)
    parts = F.split(said, r"\.")
    nested = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat_ws(".", F.array_join(F.slice(parts, F.lit(1), n), "."), F.array_join(F.slice(parts, n + 1, F.size(parts)), "$")))
    return F.array_distinct(F.concat(F.array(said, F.replace(said, F.lit("$"), F.lit("."))), F.when(F.size(parts) > 1, nested).otherwise(F.array().cast("array<string>"))))


def first_known(refs: DataFrame, ref_id: str, candidates: Column, dim: DataFrame, key: str) -> DataFrame:
    """The refs with the row of ``dim``, whose keys are unique, of their first candidate that it has; refs without one go."""
    each = refs.select(ref_id, F.posexplode(candidates).alias("__at", "__c"))
    return best_of(each.join(dim, F.col("__c") == F.col(key)), ref_id, [F.col("__at")]).drop("__at", "__c")


def coverage_of(refs: DataFrame, ref_id: str, covered: DataFrame) -> DataFrame:
    """The coverage in per cent of the method each ref (class_name, signature) means, and by which ``tier``; -1 where nothing is known.

    ``covered`` is (class, method, descriptor, ord, line_missed, line_covered, branch_missed, branch_covered); of equal methods the first by ``ord`` counts.
    For each name under which the class may be known, in order, types are compared as qualified names, then as simple ones; tiers are numbered
    along: 0 and 1 for the name as it is, 2 and 3 for the next. One equi-join finds all of them; a ref makes two rows a candidate.
    """

    def joined(types: Column) -> Column:
        return F.array_join(types, ",")

    def share(kind: str) -> Column:
        return F.try_divide(F.col(f"{kind}_covered") * F.lit(100.0), F.col(f"{kind}_covered") + F.col(f"{kind}_missed"))

    # Types are told once a row: what is used twice is a column of its own.
    types = F.col("__types")
    known = covered.where("trim(method) <> '' AND trim(descriptor) <> ''").withColumn("__types", descriptor_types("descriptor")).select(
        F.col("class").alias("__c"), F.col("method").alias("__n"), F.posexplode(F.array(joined(types), joined(F.transform(types, unqualified)))).alias("__way", "__t"), "ord", F.coalesce(share("line"), share("branch"), F.lit(-1.0)).alias("percent")
    )
    known = known.groupBy("__c", "__n", "__way", "__t").agg(F.min_by("percent", "ord").alias("percent"))
    told = refs.select(ref_id, "class_name", signature_name("signature").alias("__n"), signature_types("signature").alias("__types")).where("__n <> ''")
    ways = F.array(joined(types), joined(F.transform(types, unqualified)))
    each = told.select(ref_id, "__n", ways.alias("__ways"), F.posexplode(class_candidates(F.col("class_name"))).alias("__at", "__c"))
    each = each.select(ref_id, "__n", "__at", "__c", F.posexplode("__ways").alias("__way", "__t"))
    found = each.join(known, ["__c", "__n", "__way", "__t"]).groupBy(ref_id).agg(F.min(F.struct((F.col("__at") * 2 + F.col("__way")).alias("tier"), "percent")).alias("best"))
    return refs.select(ref_id).join(found, ref_id, "left").select(ref_id, F.coalesce("best.percent", F.lit(-1.0)).alias("percent"), F.col("best.tier").alias("tier"))


def method_of(refs: DataFrame, ref_id: str, methods: DataFrame) -> DataFrame:
    """The method each ref (class_name, signature) means, and by which of four ways: same signature, same but for white space,
    name and number of parameters, name alone; methods are (class_name, signature, ord, id)."""

    def keyed(rows: DataFrame) -> DataFrame:
        """The rows with the four keys, each told once a row."""
        rows = rows.withColumn("__n", F.trim(F.regexp_extract("signature", r"([^\s(.]+)\s*(?:\(|$)", 1))).withColumn("__i", F.regexp_extract("signature", r"\((.*)\)", 1))
        arity = F.when(F.trim("__i") == "", 0).otherwise(F.size(split_top_level("__i")))
        known = F.col("class_name").isNotNull() & F.col("signature").isNotNull()
        keys = [F.col("signature"), F.regexp_replace("signature", r"\s+", ""), F.concat_ws(" ", "__n", arity), F.col("__n")]
        return rows.withColumns({f"key{k}": F.when(known, F.concat(F.length("class_name"), F.lit(":"), "class_name", x)) for k, x in enumerate(keys, 1)})

    # Of methods that share a key the first counts, so that no join makes more rows than there are refs.
    known = keyed(methods)
    tiers = [(f"key{k}", known.groupBy(f"key{k}").agg(F.min_by("id", "ord").alias("id"))) for k in range(1, 5)]
    return tiered(keyed(refs.select(ref_id, "class_name", "signature")), ref_id, tiers, "id").where("tier > 0")


def class_of_call(calls: DataFrame, call_id: str, classes: DataFrame) -> DataFrame:
    """The class that each call (raw, resolved) names: a known one, one with dots for dollars, the only one of that simple name; else what was
    said, unless it was not resolved and begins with a small letter."""
    solved = F.coalesce((F.trim("resolved") != "") & (F.col("resolved") != "None"), F.lit(False))
    said = F.when(solved, F.col("resolved")).otherwise(F.col("raw"))
    rows = calls.select(call_id, solved.alias("__solved"), F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"^([^(]+)\(.*$", "$1"), "^([^#]+)#.*$", "$1"), "^(.+?)::.*$", "$1").alias("__said")).where("trim(__said) <> ''")
    rows = rows.withColumn("__plain", F.replace("__said", F.lit("$"), F.lit(".")))
    known = classes.select(F.col("fqn").alias("fqn")).distinct()
    simple = unique(known.select("fqn", F.substring_index("fqn", ".", -1).alias("__simple")), "__simple", "fqn")
    rows = rows.withColumn("__short", F.when(~F.col("__said").contains("."), F.col("__said")).when(~F.col("__plain").contains("."), F.col("__plain")))
    found = tiered(rows, call_id, [("__said", known.withColumn("__said", F.col("fqn"))), ("__plain", known.withColumn("__plain", F.col("fqn"))), ("__short", simple.withColumnRenamed("__simple", "__short"))], "fqn")
    out = found.join(rows.select(call_id, "__said", "__solved"), call_id)
    target = F.coalesce("fqn", F.when(F.col("__solved") | ~F.col("__said").rlike(r"^\p{Ll}"), F.col("__said")))
    return out.select(call_id, target.alias("target"), F.col("fqn").isNotNull().alias("internal")).where("target is not null")


def test_links(classes: DataFrame, methods: DataFrame | None = None) -> DataFrame:
    """Tests to look for by name: of classes (fqn) ``<Name>Test`` and ``<Name>Tests``; of methods (fqn, name) ``test<Method>`` in the former and ``<Name><Method>Test``."""
    source = classes if methods is None else methods
    package, simple = F.regexp_replace(F.regexp_extract("fqn", r"^(.*)\.[^.]*$", 1), r"\.", "/"), F.substring_index("fqn", ".", -1)

    def link(name: Column, method: Column) -> Column:
        return F.struct(name.alias("test_class"), method.alias("test_method"), F.concat(F.when(package != "", F.concat(package, F.lit("/"))).otherwise(""), name, F.lit(".java")).alias("path"))

    none = F.lit(None).cast("string")
    if methods is None:
        links = [link(F.concat(simple, F.lit("Test")), none), link(F.concat(simple, F.lit("Tests")), none)]
        return source.select("fqn", F.explode(F.array_distinct(F.array(*links))).alias("l")).select("fqn", "l.*").distinct()
    big = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    links = [link(F.concat(simple, F.lit("Test")), F.concat(F.lit("test"), big)), link(F.concat(simple, big, F.lit("Test")), none)]
    return source.select("fqn", "name", F.explode(F.array_distinct(F.array(*links))).alias("l")).select("fqn", "name", "l.*").distinct()


def registered_links(tasks: DataFrame) -> DataFrame:
    """Links that tasks (class_fqn, method_name, test_class, path) tell, distinct; what lacks its class, test or path tells none."""
    rows = tasks.where("class_fqn is not null and test_class is not null and path is not null")
    return rows.select("class_fqn", F.when(F.trim("method_name") != "", F.col("method_name")).alias("method_name"), "test_class", "path").distinct()
