"""What kind of class a class is, from what is declared in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.code import class_type


def class_types(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """``class_fqn`` and ``class_type`` of classes (class_fqn, annotations, extends, fields: how many), from methods (class_fqn, name, visibility, is_static, signature).

    In order: SERVICE, DATA_CLASS and EXCEPTION by annotations and by what is extended; UTILITY, if methods are static and there are two, or one and a private constructor; BUILDER, with ``build`` or two setters that
    give the class itself; of two fields and more with accessors or methods that every object has, SERVICE if a method does more than these, else DATA_CLASS; GENERAL. Methods are counted where they lie, a row a class is moved.
    """
    simple, name, lower = F.substring_index("class_fqn", ".", -1), F.col("name"), F.lower("name")
    built = (name == "<init>") | (name == simple)

    def n(when: Column) -> Column:
        return F.count_if(F.coalesce(when, F.lit(False)))

    fluent = F.col("signature").contains(simple) & (name.startswith("set") | name.startswith("with"))
    accessor = lower.startswith("get") | lower.startswith("set") | lower.startswith("is") | lower.startswith("has") | lower.isin("equals", "hashcode", "tostring")
    told = methods.where(name.isNotNull()).groupBy("class_fqn").agg(
        n(built & (F.col("visibility") == "private")).alias("private"), n(~built & F.col("is_static")).alias("static"), n(~built & ~F.coalesce("is_static", F.lit(False))).alias("instance"), n(name == "build").alias("build"), n(fluent).alias("fluent"),
        n(name.startswith("get") | name.startswith("is")).alias("getters"), n(name.startswith("set")).alias("setters"), n(name.isin("equals", "hashCode", "toString")).alias("object"), n((F.trim("name") != "") & ~built & ~accessor).alias("actions"),
    )
    rows = classes.join(told, "class_fqn", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in told.columns[1:]}
    first = class_type("annotations", "extends")
    utility = (zero["instance"] == 0) & ((zero["static"] >= 2) | ((zero["private"] > 0) & (zero["static"] > 0)))
    data = (F.coalesce("fields", F.lit(0)) >= 2) & ((zero["getters"] >= 2) | (zero["setters"] >= 2) | (zero["object"] > 0))
    kind = F.when(first != "GENERAL", first).when(utility, "UTILITY").when((zero["build"] > 0) | (zero["fluent"] >= 2), "BUILDER").when(data, F.when(zero["actions"] > 0, "SERVICE").otherwise("DATA_CLASS")).otherwise("GENERAL")
    return rows.select("class_fqn", kind.alias("class_type"))
