"""Functions and operators on hand-made rows."""

import hashlib
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import code, redaction, rules
from tessera.operators import dictionary, graph, lookup, merge, rollup, stats
from tessera.sources import readers, writers


def one(spark, expr, **values):
    types = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], types).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("name,role", [("com.acme.web", "entry"), ("com.acme.legacy.service", "service"), ("com.legacy.acme", "legacy"), ("a.b", "core"), ("", "default"), ("x.userservice.impl", "service"), ("x.dto", "domain")])
def test_package_role(spark, name, role):
    assert one(spark, code.package_role("x"), x=name) == role


def test_names(spark):
    assert one(spark, code.package_of("x"), x="com.acme.Outer.Inner") == "com.acme"
    assert one(spark, code.class_of("x"), x="com.acme.Outer.Inner") == "Outer.Inner"
    assert one(spark, code.library_key("x"), x="org.junit.jupiter") == "org.junit"
    assert one(spark, code.library_key("x"), x="lombok.Data") == "lombok"
    assert one(spark, code.import_type("x"), x="static org.junit.Assert.assertTrue") == "org.junit.Assert"
    assert one(spark, code.simple_type("x"), x="java.util.Map<String, List<X>>[]") == "Map"
    assert one(spark, code.split_top_level("x"), x="Map<String, List<Integer>>, int, Set<A>") == ["Map<String, List<Integer>>", "int", "Set<A>"]
    assert one(spark, code.generated_test_name("c", "m"), c="a.b.Foo", m="run<T>") == "Foo_run_T_GeneratedTest"


def test_comments_open_no_literals(spark):
    a, b = "x = 1; // don't  mind\ny =  'a b'; /* \"  */ z", "x=1;//don'tmind\ny='a b';/*\"*/z"
    assert one(spark, code.code_hash("x"), x=a) == one(spark, code.code_hash("x"), x=b)
    assert one(spark, code.code_hash("x"), x=a) != one(spark, code.code_hash("x"), x=a.replace("'a b'", "'ab'"))
    assert one(spark, code.code_hash("x"), x=None) == hashlib.sha256(b"").hexdigest()


def test_deeply_nested_generics_are_split_at_the_top(spark):
    deep = "A<B<C<D<E, F>, G>>, H>"
    assert one(spark, code.split_top_level("x"), x=f"{deep}, int , > x,") == [deep, "int", "> x"]
    assert one(spark, code.parameter_types("x"), x="go(final java.util.Map<x.K, a.b.V> m, @N int[] x, Outer$In)") == ["map<k,v>", "int[]", "in"]


def test_code_hash_ignores_space_outside_literals(spark):
    same = ['a = "x  y" ;', 'a="x  y";', 'a\n=\t"x  y";']
    assert len({one(spark, code.code_hash("x"), x=s) for s in same}) == 1
    assert one(spark, code.code_hash("x"), x='a="x y";') != one(spark, code.code_hash("x"), x=same[0])
    assert one(spark, code.code_hash("x"), x="""f('\\'', ' ')""") != one(spark, code.code_hash("x"), x="f('\\'','')")
    assert one(spark, code.code_hash("x"), x='t = """a  b"""') != one(spark, code.code_hash("x"), x='t = """a b"""')


def test_code_flags(spark):
    assert one(spark, code.has_loops("x"), x='s = "for"; // while') is False and one(spark, code.has_loops("x"), x="for (;;) {}") is True
    assert one(spark, code.is_sensitive("n", "a"), n="resetPassword", a=["Override"]) and one(spark, code.is_sensitive("n", "a"), n="run", a=["@x.PreAuthorize"])
    assert not one(spark, code.is_sensitive("n", "a"), n="run", a=["Override"])
    assert one(spark, code.uses_removed_api("i"), i=["java.util.List", "javax.xml.bind.*"]) and not one(spark, code.uses_removed_api("i"), i=["javax.xml.binder.X"])
    assert one(spark, code.brittle_signals("s", "c"), s="new Random(); HashMap m; m.toString()", c=["Thread#start"]) == ["RANDOM", "CONCURRENCY", "COLLECTION_ORDER"]
    assert one(spark, code.cache_key("a", "b"), a="x", b="yz") != one(spark, code.cache_key("a", "b"), a="xy", b="z")
    got = [one(spark, code.mismatch("m"), m=m) for m in ("expected: <1> but was: <2>", "Expected: a\n  but: was null", "nothing")]
    assert (got[0]["expected"], got[0]["actual"], got[0]["kind"]) == ("1", "2", "integer") and got[1]["kind"] == "null" and got[2] is None


def test_rules(spark):
    assert one(spark, rules.rate(F.col("a"), F.col("b")), a=1, b=0) is None
    assert one(spark, rules.half_up(F.col("a")), a=0.125) == 0.13
    assert [one(spark, rules.trust_level("c"), c=c) for c in (0.95, 0.6, 0.1, float("nan"), 7.0)] == ["HIGH", "MEDIUM", "LOW", "LOW", "HIGH"]
    assert one(spark, rules.trust_level("c", F.lit("false")), c=0.95) == "LOW"
    assert [one(spark, rules.normalize_reason("r"), r=r) for r in ("low_conf(0.10)<0.60", " unresolved(3)*0.10 ", "SKIP:min_conf<0.30", "odd", "  ")] == ["low_conf", "unresolved", "skip_low_conf", "odd", None]
    assert one(spark, rules.token_estimate("t"), t="abcde") == 2 and one(spark, rules.token_estimate("t"), t="") == 0


def test_merging(spark):
    a = spark.createDataFrame([("k1", 5, ["x", "y"], True), ("k2", 3, None, None)], "k string, cc int, tags array<string>, f boolean")
    b = spark.createDataFrame([("k1", 0, ["y", "z"], False), ("k3", 9, ["q"], None)], "k string, cc int, tags array<string>, f boolean")
    got = {r["k"]: (r["cc"], r["tags"], r["f"]) for r in merge.full_merge(a, b, ["k"], {"cc": merge.prefer_second, "tags": merge.union_lists, "f": merge.either}).collect()}
    assert got == {"k1": (5, ["x", "y", "z"], True), "k2": (3, [], False), "k3": (9, ["q"], False)}
    assert one(spark, merge.union_exceptions(F.col("a"), F.col("b")), a=["IOException", "IllegalStateException"], b=["java.lang.IllegalStateException"]) == ["IOException", "java.lang.IllegalStateException"]
    e = "k string, resolved string, status string, confidence double"
    p = spark.createDataFrame([("same", "x", "RESOLVED", 0.9), ("clash", "x", "RESOLVED", 0.9), ("left", "x", "RESOLVED", 0.7), ("none", None, "UNRESOLVED", 0.2)], e)
    s = spark.createDataFrame([("same", "x", "RESOLVED", 0.8), ("clash", "y", "RESOLVED", 0.9), ("left", None, "UNRESOLVED", 0.9), ("none", None, "UNRESOLVED", 0.4), ("right", "z", "RESOLVED", 0.6)], e)
    got = {r["k"]: (r["resolved"], r["status"], r["confidence"], r["candidates"]) for r in merge.merge_edges(p, s, "k").collect()}
    assert got == {"same": ("x", "RESOLVED", 0.9, []), "clash": (None, "AMBIGUOUS", 0.5, ["x", "y"]), "left": ("x", "RESOLVED", 0.7, []), "none": (None, "UNRESOLVED", 0.4, []), "right": ("z", "RESOLVED", 0.6, [])}


def test_lookups(spark):
    types = spark.createDataFrame([("a.b.X",), ("a.c.Y",), ("d.Y",)], "fqn string")
    refs = spark.createDataFrame([("a.b.X", "q"), ("X", "a.b"), ("X", "z"), ("Y", "z"), ("Y", "d")], "ref string, pkg string")
    got = {(r["ref"], r["pkg"]): (r["fqn"], r["tier"]) for r in lookup.resolve_types(refs, "ref", "pkg", types, "fqn").collect()}
    assert got == {("a.b.X", "q"): ("a.b.X", 1), ("X", "a.b"): ("a.b.X", 2), ("X", "z"): ("a.b.X", 3), ("Y", "z"): (None, 0), ("Y", "d"): ("d.Y", 2)}
    rows = spark.createDataFrame([("a",), ("a.b.c",), ("ab",), ("x.y",)], "n string")
    assert {r["n"] for r in lookup.outside(rows, "n", spark.createDataFrame([("a.b",)], "i string"), "i").collect()} == {"ab", "x.y"}


def cyclic_by_hand(edges):
    out = set()
    for start in {a for a, _ in edges}:
        seen, todo = set(), [b for a, b in edges if a == start]
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [b for a, b in edges if a == n]
        if start in seen:
            out.add(start)
    return out


def test_cycles(spark):
    rng = random.Random(4)
    some = [("s", "s"), ("a", "b"), ("b", "a"), ("b", "t"), ("t", "u"), ("z", "a")]
    for edges in (some, [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(40)], [("a", "b")]):
        got = {r["node"] for r in graph.cyclic_nodes(spark.createDataFrame(edges, "src string, dst string")).collect()}
        assert got == cyclic_by_hand(edges)
    assert graph.topological(["a", "b", "c"], {"a": ["c"]}) == ["b", "c", "a"] and graph.closure(["a"], {"a": ["c"], "c": ["d"]}) == {"a", "c", "d"}
    with pytest.raises(ValueError):
        graph.topological(["a", "b"], {"a": ["b"], "b": ["a"]})


def test_dead_methods(spark):
    kinds = list(itertools.product(("private", "public", None), (True, False), (True, False)))
    methods = spark.createDataFrame([(f"m{i}", *k) for i, k in enumerate(kinds)], "key string, visibility string, has_body boolean, is_entry boolean")
    calls = spark.createDataFrame([("x", "m1")], "caller string, callee string")
    for r in graph.dead_methods(methods, calls).collect():
        assert r["dead"] == (r["key"] != "m1" and r["visibility"] != "public" and r["has_body"] and not r["is_entry"])


SECRETS = [
    ("mail bob@example.com now", "mail [REDACTED] now"), ('api_key = "abc def" x', 'api_key = "[REDACTED]" x'), ("password: hunter2; y", "password: [REDACTED]; y"), ("Authorization: Bearer abc.def-1", "Authorization: Bearer [REDACTED]"),
    ("card 4111 1111 1111 1111, ok", "card [REDACTED], ok"), ("card 4111 1111 1111 1112 ok", "card 4111 1111 1111 1112 ok"), ("-----BEGIN PRIVATE KEY-----\nAA\n-----END PRIVATE KEY-----", "[REDACTED]"), ("nothing", "nothing"), (None, ""),
    ("token: 'a b' and secret=\"", "token: '[REDACTED]' and secret=\""),
]


def test_masking(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in SECRETS)), "i int, t string")
    got = rows.select("i", redaction.mask("t", redaction.resolve_overlaps(redaction.detect("t"))).alias("m"), redaction.mask_in_turn("t").alias("n")).collect()
    for r in got:
        assert r["m"] == r["n"] == SECRETS[r["i"]][1]
    card = "card 4111 1111 1111 1111 ok"
    assert one(spark, redaction.mask("t", redaction.detect("t")), t=card) == "card [REDACTED]ok"
    assert one(spark, redaction.mask_in_turn("t"), t=card) == "card [REDACTED] ok"


def test_secrets_behind_longer_names_and_any_white_space(spark):
    forms = ["SECRET_KEY=%s", "aws_secret_access_key = %s", "password_hash: %s", "token_id=%s", "password\t=\t%s", "token:   %s", "my-api-key:\n%s;", "Authorization :\tBearer  %s", "a token=%s and SECRET_KEY='%s'"]
    rows = spark.createDataFrame([(f.replace("%s", "abc.d-1"), f.replace("%s", "[REDACTED]")) for f in forms], "t string, want string")
    for r in rows.select("want", redaction.mask("t", redaction.resolve_overlaps(redaction.detect("t"))).alias("m"), redaction.mask_in_turn("t").alias("n")).collect():
        assert r["m"] == r["n"] == r["want"]


def test_detectors_are_registered_once(spark):
    with pytest.raises(ValueError):
        redaction.register("EMAIL", lambda t: t)
    assert one(spark, F.size(redaction.detect("t", ("EMAIL",))), t="a@b.co token=x") == 1


def test_overlaps_are_resolved_as_a_fold(spark):
    rng = random.Random(9)
    rows = [[(f"T{rng.randrange(3)}", a := rng.randrange(30), a + rng.randrange(1, 9), rng.choice([0.5, 0.8, 0.9])) for _ in range(rng.randrange(7))] for _ in range(30)]
    table = spark.createDataFrame(list(enumerate(rows)), f"i int, s {redaction.SPAN}")
    for r in table.select("i", redaction.resolve_overlaps(F.col("s")).alias("k")).collect():
        kept = []
        for s in sorted(rows[r["i"]], key=lambda s: (s[1], -s[3])):  # stable: as they were found
            if not kept or s[1] >= kept[-1][2] or s[2] <= kept[-1][1]:
                kept.append(s)
            elif s[3] > kept[-1][3]:
                kept[-1] = s
        assert [tuple(k) for k in r["k"]] == kept


def test_dictionary(spark):
    assert [(s["start"], s["end"]) for s in one(spark, redaction.dictionary_spans("t", ("aba",)), t="ABABA ａｂａ")] == [(0, 3), (2, 5), (6, 9)]
    assert one(spark, redaction.dictionary_spans("t", ("aba",), allow=("aba",)), t="aba") == []


def test_trends_and_retention(spark):
    runs = spark.createDataFrame([(i, i / 200) for i in range(120)], "ts long, rate double")
    got = stats.trend(runs, "ts", "rate").orderBy("ts").collect()
    assert len(got) == 100 and got[0]["ts"] == 20 and got[0]["delta"] is None and abs(got[5]["delta"] - 1 / 200) < 1e-12
    rows = spark.createDataFrame([(i,) for i in range(12)], "k long")
    assert sorted(r["k"] for r in stats.evict(rows, 10, F.col("k"), "k").collect()) == list(range(2, 12))
    assert stats.evict(rows, 12, F.col("k"), "k").count() == 12
    nodes = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "b")], "node string, parent string")
    assert rollup.unary_root(nodes) == "b" and rollup.common_prefix(spark.createDataFrame([("x.y.a",), ("x.y.b.c",)], "n string"), "n") == ["x", "y"]


def test_eviction_takes_a_fifth_of_all_entries(spark):
    rows = spark.range(2500).selectExpr("id as k", "id * 37 % 101 as u").repartition(7)
    stay = sorted(((r["u"], r["k"]) for r in rows.collect()))[500:]
    assert sorted((r["u"], r["k"]) for r in stats.evict(rows, 20, F.col("u"), "k").collect()) == stay


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "cov.xml").write_text('<report name="r"><package name="a/b"><class name="a/b/X"><counter type="LINE" missed="1" covered="3"/><counter type="BRANCH" missed="0" covered="0"/></class></package></report>')
    got = {r["type"]: (r["class"], r["rate"]) for r in readers.coverage(spark, str(tmp_path / "cov.xml")).collect()}
    assert got == {"LINE": ("a.b.X", 0.75), "BRANCH": ("a.b.X", None)}
    (tmp_path / "t.xml").write_text('<testsuites><testsuite name="s"><testcase name="a" classname="C"/><testsuite name="n"><testcase name="b" classname="C"><failure message="expected: &lt;1&gt; but was: &lt;2&gt;">x</failure></testcase></testsuite></testsuite></testsuites>')
    assert sorted((r["name"], r["status"]) for r in readers.test_cases(spark, str(tmp_path / "t.xml")).collect()) == [("a", "passed"), ("b", "failure")]
    (tmp_path / "pmd.xml").write_text('<pmd><file name="A.java"><violation beginline="3" rule="R" priority="1" class="A">bad</violation></file></pmd>')
    assert readers.findings(spark, str(tmp_path / "pmd.xml"), "pmd").first()["severity"] == "HIGH"
    (tmp_path / "tasks.jsonl").write_text('{"task_id": "1", "method_name": "m"}\n\n{bad\n{"task_id": "2", "status": "success"}\n')
    rows = readers.tasks(spark, str(tmp_path / "tasks.jsonl"), "task_id string, method_name string, status string")
    assert sorted(r["kind"] for r in rows.collect()) == ["bad", "result", "task"]
    tasks = spark.createDataFrame([("1", "m", None)], "task_id string, method_name string, status string")
    results = spark.createDataFrame([("1", "success", 2), ("9", "failed", 1)], "task_id string, status string, tests int")
    assert {r["task_id"]: (r["method_name"], r["status"]) for r in writers.with_results(tasks, results, "task_id").collect()} == {"1": ("m", "success"), "9": (None, "failed")}
    (tmp_path / "a.properties").write_text("# c\nk = v\nk=w\nx: y\n")
    assert {r["key"]: r["value"] for r in readers.properties(spark, str(tmp_path / "a.properties")).collect()} == {"k": "v", "x": "y"}
    writers.shards(spark.createDataFrame([("p", 1)], "package string, n int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_usage_as_a_stream(spark, tmp_path):
    from tessera.streaming.usage import usage_stream

    spark.createDataFrame([(1, "2024-01-01 10:00:00"), (1, "2024-01-01 11:00:00"), (2, "2024-01-02 09:00:00")], "user_id long, ts string").selectExpr("user_id", "cast(ts as timestamp) ts").write.parquet(str(tmp_path / "in"))
    stream = usage_stream(spark.readStream.schema("user_id long, ts timestamp").parquet(str(tmp_path / "in")))
    run = stream.writeStream.outputMode("complete").format("memory").queryName("usage_rows").start()
    run.processAllAvailable()
    run.stop()
    assert sorted((r["user_id"], r["requests"]) for r in spark.sql("select * from usage_rows").collect()) == [(1, 2), (2, 1)]


def test_cycles_in_dense_graphs(spark):
    rng = random.Random(8)
    for n, m in ((12, 60), (40, 70)):
        edges = [(f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for _ in range(m)]
        got = {r["node"] for r in graph.cyclic_nodes(spark.createDataFrame(edges, "src string, dst string")).collect()}
        assert got == cyclic_by_hand(edges)


def test_stages_fail_or_are_skipped(spark):
    from tessera.plans.stages import Stage, run

    rows = spark.range(3)

    def bad(x):
        raise ValueError("no")

    with pytest.raises(RuntimeError, match="bad failed"):
        run([Stage("bad", bad)], rows)
    out, log = run([Stage("after", lambda x: x.where("id > 1"), needs=("bad",)), Stage("bad", bad, on_failure="skip")], rows)
    assert out.count() == 3 and [x["status"] for x in log] == ["skipped", "skipped"]


def test_stages_see_tasks_fail_and_resume(spark, tmp_path):
    from tessera.plans.files import _fails, _sleeps
    from tessera.plans.stages import Stage, StageTimeout, run

    rows, folder = spark.range(100).repartition(3), f"file://{tmp_path}"
    stages = [Stage("a", lambda x: _fails(x, 1), retries=1), Stage("b", lambda x: x.where("id >= 50"), needs=("a",))]
    out, log = run(stages, rows, folder=folder)
    assert out.count() == 50 and [(x["status"], x["attempts"]) for x in log] == [("done", 2), ("done", 1)] and "not yet" in log[0]["error"]
    again = [Stage("a", lambda x: _fails(x, 9)), Stage("b", lambda x: x.where("id >= 60"), needs=("a",), version="2")]
    out, log = run(again, rows, folder=folder)
    assert out.count() == 40 and [(x["status"], x["attempts"]) for x in log] == [("resumed", 0), ("done", 1)]
    with pytest.raises(RuntimeError, match="(?s)stage a failed.*not yet"):
        run(again, rows, folder=folder, origin="another table")
    late = [Stage("late", _sleeps, timeout=1.0, on_failure="skip"), Stage("next", lambda x: x, needs=("late",)), Stage("c", lambda x: x.limit(5))]
    out, log = run(late, rows, folder=folder)
    assert [x["status"] for x in log] == ["skipped", "skipped", "done"] and StageTimeout.__name__ in log[0]["error"] and out.count() == 5
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert run(late[2:], rows, folder=folder)[1][0]["status"] == "resumed"


def test_yaml_leaves():
    text = "a:\n  - x: 1 # c\n    y: 'q # r'\n  - 2\nb: {c}\n'd e':\n  f:\n    g: \"h\"\n- z\n"
    got = [(k, v) for _, k, v in readers._leaves(text)]
    assert got[:5] == [("a[0].x", "1"), ("a[0].y", "q # r"), ("a[1]", "2"), ("b", "{c}"), ("d e.f.g", "h")]


def test_descriptors_and_signatures(spark):
    rows = [
        ("()V", "m()", []), ("(I)V", "x.y.C#go(final int x)", ["int"]), ("(Ljava/util/List;[[JZ)Ljava/lang/String;", "void go(List<Map<String, A>> a, long[][] b, boolean c)", ["java.util.List", "long[][]", "boolean"]),
        ("([Ljava/util/Map$Entry;)V", "go(@A(x = (1)) @B Map.Entry<K, V>... e)", ["java.util.Map$Entry[]"]), (None, None, None), ("broken", "broken", []),
    ]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, d string, s string, types array<string>").select("id", code.descriptor_types("d").alias("d"), code.signature_types("s").alias("s"), code.signature_name("s").alias("n"), "types", F.transform(code.descriptor_types("d"), code.unqualified).alias("u"))
    got = df.orderBy("id").collect()
    assert [r["d"] for r in got] == [r["types"] for r in got]
    assert [r["s"] for r in got] == [[], ["int"], ["List", "long[][]", "boolean"], ["Map.Entry[]"], None, []]
    assert [r["n"] for r in got] == ["m", "go", "go", "go", None, None]
    assert [r["u"] for r in got][2:4] == [["List", "long[][]", "boolean"], ["Entry[]"]]


def test_coverage_of_methods_by_tiers(spark):
    covered = spark.createDataFrame(
        [("a.B", "m", "(Ljava/lang/String;)V", 1, 1, 1, 0, 0), ("a.B", "m", "(Ljava/lang/String;)V", 2, 0, 9, 0, 0), ("a.B", "m", "(Lx/String;)V", 3, 0, 5, 0, 0), ("a.B$C$D", "go", "()V", 4, 0, 0, 3, 1), ("a.B", "none", "()V", 5, 0, 0, 0, 0)],
        "class string, method string, descriptor string, ord long, line_missed long, line_covered long, branch_missed long, branch_covered long",
    )
    asked = [("a.B", "m(java.lang.String s)"), ("a.B", "m(String s)"), ("a.B", "m(x.String s)"), ("a.B.C.D", "go()"), ("a.B$C$D", "go()"), ("a.B", "none()"), ("a.B", "m(int i)"), ("a.B", "m"), (None, "m()"), ("a.B", None), ("a.X", "go()")]
    refs = spark.createDataFrame([(i, *x) for i, x in enumerate(asked)], "id int, class_name string, signature string")
    got = [(r["percent"], r["tier"]) for r in lookup.coverage_of(refs, "id", covered).orderBy("id").collect()]
    assert got == [(50.0, 0), (50.0, 1), (100.0, 0), (25.0, 2), (25.0, 0), (-1.0, 0), (-1.0, None), (-1.0, None), (-1.0, None), (-1.0, None), (-1.0, None)]


@pytest.mark.parametrize("words", [False, True])
def test_dictionary_by_automaton_and_by_join(spark, words, monkeypatch):
    monkeypatch.setattr(dictionary, "PIECE", 7)
    rng = random.Random(2)
    texts = [(i, "".join(rng.choice("ab a\u00e9_.-") for _ in range(rng.randrange(60)))) for i in range(60)] + [(60, None), (61, ""), (62, "ＡＢ ab Ab_ab-ab a a a a")]
    said = ["ab", "A", "a a", "é", "a.", "-", " # no", "", None, "ba ab a_", "bb", "AB"]
    rows = spark.createDataFrame(texts, "id int, text string")
    terms = dictionary.terms_of(spark.createDataFrame([(x,) for x in said], "t string"), "t", spark.createDataFrame([("BB",)], "t string"))
    assert {r["term"] for r in terms.collect()} == {"ab", "a", "a a", "é", "a.", "-", "ba ab a_"}
    want = {}
    for i, text in texts:
        low, places = (text or "").lower().replace("ａ", "a").replace("ｂ", "b"), []
        for term in ("ab", "a", "a a", "é", "a.", "-", "ba ab a_"):
            after = 0
            for a in range(len(low)):
                b = a + len(term)
                if low.startswith(term, a) and (not words or (a >= after and dictionary._edge(low, a) and dictionary._edge(low, b))):
                    places.append((a, b))
                    after = b
        want[i] = sorted(places)
    for sent in (dictionary.SENT, 0):
        found = dictionary.find(rows, "id", "text", terms, words, sent=sent).collect()
        assert {r["id"]: [(s["start"], s["end"]) for s in r["spans"]] for r in found} == want
    assert dictionary.find(rows, "id", "text", terms.where("false")).where("size(spans) > 0").count() == 0


def test_advice_on_parameters(spark):
    def advice(strength="OK", dominant=None, fails=None, passes=None, **now):
        rows = spark.createDataFrame([(strength, dominant, fails or {}, passes or {})], "s string, d string, f map<string,double>, p map<string,double>")
        got = rows.select(rules.parameter_advice(F.col("s"), F.col("d"), F.col("f"), F.col("p"), now).alias("a")).first()["a"]
        return [(a["name"], round(a["advised"], 6), a["trigger"]) for a in got]

    assert advice(fails={"low_conf": 0.5}) == [("skip_threshold", 0.6, "low_conf")] and advice(fails={"spi_low_conf": 0.5, "low_conf": 0.4}) == [("skip_threshold", 0.6, "spi_low_conf")]
    assert advice(fails={"low_conf": 0.5}, skip_threshold=0.95) == [("skip_threshold", 1.0, "low_conf")] and advice(fails={"low_conf": 0.5}, skip_threshold=1.0) == []
    assert advice(fails={"unresolved": 0.31}, passes={"branch_candidates": 0.9}) == [("penalty_unresolved_each", 0.15, "unresolved")]
    assert advice(fails={"unresolved": 0.3}, passes={"branch_candidates": 0.71}) == [("penalty_unresolved_each", 0.08, "branch_candidates")]
    assert advice("TOO_STRICT") == [("skip_threshold", 0.4, "too_strict")] and advice("TOO_STRICT", skip_threshold=0.05) == [("skip_threshold", 0.0, "too_strict")]
    assert advice("TOO_STRICT", skip_threshold=0.0) == [] and advice("TOO_STRICT", fails={"low_conf": 0.9}) == [("skip_threshold", 0.6, "low_conf")]
    assert [advice("TOO_WEAK", d)[0] for d in ("unresolved", "external_not_found", "spi_low_conf", "x", None)] == [
        ("penalty_unresolved_each", 0.2, "unresolved"), ("penalty_external_each", 0.3, "external_not_found"), ("penalty_low_confidence", 0.5, "spi_low_conf"), ("penalty_low_confidence", 0.5, "x"), ("penalty_low_confidence", 0.5, "too_weak"),
    ]
    assert one(spark, code.is_sensitive("n", "a"), n="logoutAll", a=["x"]) and one(spark, code.is_sensitive("n", "a"), n="run", a=['@x.PreAuthorize("hasRole(\'a.b\')")'])


def test_named_files_all_or_none(spark, tmp_path):
    import os

    def files(folder):
        return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, names in os.walk(folder) for f in names if "/_" not in os.path.join(d, f)[len(str(folder)) :] and not f.startswith((".", "_")))

    rows = spark.range(50).selectExpr("concat('d', id % 3, '/n', id, '.txt') AS name", "concat('é', id) AS body").repartition(4)
    told = writers.named_files(rows, f"file://{tmp_path}/a").collect()
    assert files(tmp_path / "a") == sorted(f"d{i % 3}/n{i}.txt" for i in range(50)) and {r["name"] for r in told} == set(files(tmp_path / "a"))
    assert (tmp_path / "a/d1/n1.txt").read_bytes() == "é1".encode() and {r["sha256"] for r in told if r["name"] == "d1/n1.txt"} == {hashlib.sha256("é1".encode()).hexdigest()}
    for bad in (spark.createDataFrame([("../x", "out")], "name string, body string"), spark.createDataFrame([("d1/n1.txt", "again")], "name string, body string")):
        with pytest.raises(Exception, match="no name|have the name"):
            writers.named_files(rows.unionByName(bad), f"file://{tmp_path}/b{bad.first()['body']}")
    assert files(tmp_path / "bout") == files(tmp_path / "bagain") == []
    assert writers.named_files(rows.where("false"), f"file://{tmp_path}/c").count() == 0
    assert sorted((r["id"], r["at"]) for r in readers.numbered(spark.range(1000).repartition(7), ["id"], "at").collect()) == [(i, i + 1) for i in range(1000)]


def test_symbol_index(spark):
    from tessera.operators import symbols

    classes = spark.createDataFrame([("a.Foo",), ("b.Foo",), ("c.Bar",), ("",), (None,)], "class_fqn string")
    methods = spark.createDataFrame(
        [("a.Foo", "go", "go(int)", 1), ("a.Foo", "go", "go(int,int)", 2), ("a.Foo", "go", "go(int)", 1), ("b.Foo", "go", None, 3), ("b.Foo", "go", " ", 4), ("b.Foo", "go", None, 5), ("b.Foo", "run", None, -1), ("d.New", "made", None, None), ("a.Foo", None, "x()", 0)],
        "class_fqn string, name string, signature string, arity int",
    )
    fields = spark.createDataFrame([("a.Foo", "x", "int"), ("a.Foo", "x", "int"), ("b.Foo", "x", "long"), ("b.Foo", "y", "A"), ("b.Foo", "y", None), ("e.Gone", "z", "B")], "class_fqn string, name string, type string")
    stored = symbols.store(symbols.index(classes, methods, fields), 4)
    asked = {
        "a.Foo": ("go", 1, "go(int)", "x"), "b.Foo": ("go", 1, "go(int)", "y"), "z.Foo": ("run", 5, "go(int,int)", "y"), "Foo": ("go", None, "go()", "z"), "d.New": ("made", -1, None, None), "no.Such": ("run", 0, "go(int)", "z"), None: ("go", None, "go(int)", "q"), "c.Bar": ("go", None, " ", "x"),
    }
    refs = spark.createDataFrame([(i, c, *v) for i, (c, v) in enumerate(asked.items())], "id int, class_name string, method string, arity int, signature string, field string")
    found = symbols.look_up(refs, "id", stored)
    assert [tuple(r)[1:] for r in found.orderBy("id").collect()] == [
        (True, True, True, True, True, 2, "int"), (True, True, False, False, True, 3, "ambiguous"), (True, True, False, True, True, 1, None), (True, True, True, False, False, 3, None),
        (True, True, True, False, False, 1, None), (False, True, False, False, True, 0, None), (False, True, True, False, False, 0, None), (True, False, False, False, False, 0, None),
    ]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = symbols.look_up(refs, "id", stored)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    scan = plan[: plan.index("FileScan")].splitlines()
    assert "Bucketed: true" in plan and not [x for x in scan[-4:] if "Exchange" in x], plan


def test_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([("a/b/One.java", bytearray(b"class One {}")), ("a/Two.java", bytearray(b"\xff\xfe")), ("a/skip/Three.java", bytearray(b"x")), ("a/b/four.txt", bytearray(b"x")), ("Five # 5.java", bytearray(b""))], "name string, body binary")
    writers.named_files(rows, f"file://{tmp_path}/s")
    monkeypatch.setattr(type(spark.read), "format", None)  # Spark's own reader lists in the driver
    found = readers.sources(spark, f"file://{tmp_path}/s", exclude=("/skip/",)).collect()
    assert sorted((r["ord"], r["path"].rpartition("/s/")[2], r["text"], r["error"]) for r in found) == [(1, "Five # 5.java", "", None), (2, "a/Two.java", None, "not UTF-8"), (3, "a/b/One.java", "class One {}", None)]


def test_errors_of_projects_are_written_once(spark, tmp_path):
    classes = spark.range(30).selectExpr("'p.C' || id AS fqn", "id AS loc", "'j' || id % 3 AS project")
    errors = spark.range(400).selectExpr("'j' || id % 2 AS project", "'e' || lpad(id, 4, '0') AS message")
    folder = f"file://{tmp_path}/c"
    assert writers.class_files(classes, folder, "fqn", errors, "project").agg({"bytes": "max"}).first()[0] < 100
    found = {r["fqn"]: r for r in readers.class_files(spark, folder, "fqn string, loc long, project string", "project").collect()}
    assert len(found) == 30 and found["p.C2"]["errors"] is None and found["p.C4"]["errors"] == [f"e{i:04}" for i in range(1, 400, 2)] and found["p.C4"]["path"].endswith("/c/p/C4.json")
