"""An index of the symbols of a project, stored by symbol, and what it says of names that texts use.

A symbol is one text: what it is, of which class, and its name. Classes are known by their qualified name and, together, by their simple name; for the latter the index holds what any of
them has, so that a reference by a simple name is one lookup, however many classes share it. The index is a table in buckets of the symbol, sorted in them: lookups move references, never the index.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AMBIGUOUS = "ambiguous"


def _named(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.trim(c) != "", F.lit(False))
    return out


def _simple(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def index(classes: DataFrame, methods: DataFrame, fields: DataFrame) -> DataFrame:
    """``symbol``, ``overloads`` (of a method's name) and ``type`` (of a field), from classes (class_fqn), methods (class_fqn, name, signature, arity) and fields (class_fqn, name, type).

    What has no class or name is left out; a negative or missing arity and a blank signature tell nothing. Overloads are counted by signatures, or where there are none by arities, or are one.
    """
    methods, fields = methods.where(_named("class_fqn", "name")), fields.where(_named("class_fqn", "name"))
    every = classes.where(_named("class_fqn")).select("class_fqn").unionByName(methods.select("class_fqn")).distinct()
    signed = methods.where(_named("signature")).select("class_fqn", "signature").distinct()
    arity = methods.where("arity >= 0").select("class_fqn", "name", "arity").distinct()
    by_signature = signed.where("contains(signature, '(')").groupBy("class_fqn", F.substring_index("signature", "(", 1).alias("name")).agg(F.count(F.lit(1)).alias("s"))
    by_arity = arity.groupBy("class_fqn", "name").agg(F.count(F.lit(1)).alias("a"))
    named = methods.select("class_fqn", "name").distinct().join(by_signature, ["class_fqn", "name"], "left").join(by_arity, ["class_fqn", "name"], "left")
    named = named.select("class_fqn", "name", F.coalesce("s", "a", F.lit(1)).alias("overloads"))
    kind = F.coalesce("type", F.lit(""))
    typed = fields.groupBy("class_fqn", "name").agg(F.min(kind).alias("a"), F.max(kind).alias("b")).select("class_fqn", "name", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(AMBIGUOUS).alias("type"))
    # Fields alone do not make a class known, so they are not what its simple name stands for.
    typed = typed.join(every.withColumn("known", F.lit(True)), "class_fqn", "left")

    own, none = F.array(F.col("class_fqn"), F.concat(F.lit("~"), _simple(F.col("class_fqn")))), F.lit(None)
    parts = [
        every.select(F.explode(own).alias("o"), F.lit("c").alias("kind"), none.cast("string").alias("key"), none.cast("long").alias("overloads"), none.cast("string").alias("type")),
        named.select(F.explode(F.array_append(own, F.lit("*"))).alias("o"), F.lit("m"), "name", "overloads", none),
        arity.select(F.explode(own).alias("o"), F.lit("a"), F.concat("name", F.lit("/"), "arity"), none, none),
        signed.select(F.explode(own).alias("o"), F.lit("s"), "signature", none, none),
        typed.select(F.explode(F.array_append(F.when(F.col("known"), own).otherwise(F.array("class_fqn")), F.lit("*"))).alias("o"), F.lit("f"), "name", none, "type"),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    symbol = F.concat("kind", F.lit(":"), "o", F.coalesce(F.concat(F.lit("#"), "key"), F.lit("")))
    return rows.groupBy(symbol.alias("symbol")).agg(F.max("overloads").alias("overloads"), F.when(F.min("type") == F.max("type"), F.min("type")).otherwise(F.when(F.min("type").isNotNull(), AMBIGUOUS)).alias("type"))


def store(rows: DataFrame, buckets: int = 64, name: str | None = None) -> DataFrame:
    """The index as a table of the warehouse, in buckets."""
    name = name or f"symbols_{uuid.uuid4().hex}"
    rows.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol").saveAsTable(name)
    return rows.sparkSession.table(name)


def look_up(refs: DataFrame, ref_id: str, symbols: DataFrame) -> DataFrame:
    """Of each ref (class_name, method, arity, signature, field) what is known: ``has_class``, ``has_method``, ``has_arity``, ``has_signature``, ``has_field``, ``overloads``, ``field_type``.

    A class that is not known by its qualified name stands for all of its simple name; where there is none, a method's or a field's name counts if any class has it, and nothing else is known.
    A negative or missing arity asks for the name alone. One join finds all that a ref asks, a fixed number of symbols.
    """
    owner = F.coalesce(F.when(_named("class_name"), F.col("class_name")), F.lit("?"))
    short = F.concat(F.lit("~"), _simple(owner))
    asked = []
    for tier, o in enumerate((owner, short, F.lit("*"))):
        asked.append(F.struct(F.lit("c").alias("kind"), F.lit(tier).alias("tier"), F.concat(F.lit("c:"), o).alias("symbol")))
        for kind, key in (("m", F.col("method")), ("a", F.concat("method", F.lit("/"), "arity")), ("s", F.col("signature")), ("f", F.col("field"))):
            asked.append(F.struct(F.lit(kind).alias("kind"), F.lit(tier).alias("tier"), F.concat(F.lit(f"{kind}:"), o, F.lit("#"), key).alias("symbol")))
    each = refs.select(ref_id, F.explode(F.filter(F.array(*asked), lambda x: x["symbol"].isNotNull())).alias("q")).select(ref_id, "q.*")
    found = each.join(symbols, "symbol").groupBy(ref_id)
    flags = [F.max((F.col("kind") == k) & (F.col("tier") == n)).alias(f"{k}{n}") for k in "cmasf" for n in range(3)]
    values = [F.max(F.when((F.col("kind") == k) & (F.col("tier") == n), F.col(c))).alias(f"{c}{n}") for k, c in (("m", "overloads"), ("f", "type")) for n in range(2)]
    out = refs.select(ref_id, "arity", *[_named(c).alias(f"_{c}") for c in ("method", "signature", "field")]).join(found.agg(*flags, *values), ref_id, "left")
    no = F.lit(False)

    def best(k: str, beyond: Column = no) -> Column:
        x = [F.coalesce(f"{k}{n}", no) for n in range(2)]
        return F.when(F.coalesce("c0", no), x[0]).when(F.coalesce("c1", no), x[1]).otherwise(beyond)

    method = F.col("_method") & best("m", F.coalesce("m2", no))
    return out.select(
        ref_id, (F.coalesce("c0", no) | F.coalesce("c1", no)).alias("has_class"), method.alias("has_method"), F.when(F.coalesce(F.col("arity") >= 0, no), best("a")).otherwise(method).alias("has_arity"),
        (F.col("_signature") & best("s")).alias("has_signature"), (F.col("_field") & best("f", F.coalesce("f2", no))).alias("has_field"),
        F.when(F.col("_method"), F.coalesce(F.when(F.coalesce("c0", no), F.col("overloads0")).when(F.coalesce("c1", no), F.col("overloads1")), F.lit(0))).otherwise(0).cast("long").alias("overloads"),
        F.when(F.coalesce("c0", no), F.col("type0")).alias("field_type"),
    )
