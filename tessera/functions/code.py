"""Column functions over names, source text and metadata of code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and annotations that mark sensitive or entry-point methods, and packages removed from the JDK.
SENSITIVE_WORDS = ("password", "secret", "token", "credential", "encrypt", "decrypt", "authenticate", "authorize", "apikey", "privatekey", "signin", "signout", "login", "logout")
SENSITIVE_ANNOTATIONS = ("PreAuthorize", "PostAuthorize", "Secured", "RolesAllowed", "PermitAll", "DenyAll", "Encrypt", "Decrypt")
REMOVED_PACKAGES = ("javax.xml.bind", "javax.xml.ws", "javax.activation")
GENERIC_HEADS = ("com", "org", "net", "io", "dev", "edu")
# The signals of brittle code, each with its pattern on the source and its tokens in calls.
SIGNALS = {
    "TIME": (r"\bLocalDateTime\s*\.\s*now\s*\(|\bInstant\s*\.\s*now\s*\(|\bSystem\s*\.\s*(?:currentTimeMillis|nanoTime)\s*\(", ("localdatetime.now", "instant.now", "system.currenttimemillis", "system.nanotime")),
    "RANDOM": (r"\bnew\s+Random\s*\(|\bThreadLocalRandom\s*\.\s*current\s*\(|\bUUID\s*\.\s*randomUUID\s*\(", ("random", "threadlocalrandom.current", "uuid.randomuuid")),
    "ENVIRONMENT": (r"\bSystem\s*\.\s*(?:getenv|getProperty)\s*\(", ("system.getenv", "system.getproperty")),
    "CONCURRENCY": (r"\bExecutors\s*\.\s*newFixedThreadPool\s*\(|\.\s*parallelStream\s*\(|(?s)Thread.*\.start\(|(?s)\.start\(.*Thread", ("executors.newfixedthreadpool", "parallelstream", "thread.start")),
    "IO": (r"\bFiles\s*\.\s*(?:readAllLines|readAllBytes|newInputStream)\s*\(|\bnew\s+(?:Server)?Socket\s*\(", ("files.readalllines", "files.readallbytes", "files.newinputstream", "socket", "serversocket")),
    "COLLECTION_ORDER": (r"(?s)Hash(?:Set|Map).*(?:\.toString\(|String\.valueOf\()|(?s)(?:\.toString\(|String\.valueOf\().*Hash(?:Set|Map)", ()),
}
# Endings of the names of types that are worth a mock.
MOCKABLE = ("Repository", "Gateway", "Service", "Client", "Port", "Adapter", "Handler", "Provider", "Factory", "Dao", "Api", "Connector", "Manager", "Helper", "Delegate", "Proxy", "Strategy", "Validator")
# Methods whose unresolved calls are no finding: of the JDK, of builders.
JDK_METHODS = ("isBlank", "isEmpty", "toString", "hashCode", "equals", "intValue", "longValue", "doubleValue", "floatValue", "booleanValue", "normalize", "toAbsolutePath", "resolve", "getParent", "name", "ordinal", "compareTo", "valueOf")
BUILDER_METHODS = ("build", "create", "ignoreExceptions", "retryOnException", "retryOnResult", "timeoutDuration", "maxAttempts", "waitDuration", "uri", "header", "method", "version", "maxTokens", "temperature", "topP")
# Annotations that tell the kind of a class.
SERVICE_ANNOTATIONS = ("Service", "Component", "Controller", "RestController", "Repository", "Dao")
DATA_ANNOTATIONS = ("Entity", "Data", "Value", "Record")
# What Java takes for white space.
BLANK = r"[\t-\r\x{1C}-\x{20}\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"
# Package roles, first match wins; words equal to the token, words contained in it.
ROLES = (
    ("test", ("test", "tests", "spec", "fixture", "mock"), ()),
    ("service", ("application", "usecase"), ("service",)),
    ("utility", ("utils", "common", "helper"), ("util",)),
    ("entry", ("controller", "api", "web", "rest", "endpoint"), ()),
    ("data", ("repository", "repo", "dao", "persistence"), ()),
    ("domain", ("domain", "model", "entity", "dto", "vo"), ()),
    ("infra", ("infra", "infrastructure", "config", "bootstrap"), ()),
    ("legacy", ("legacy",), ("deprecated",)),
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def code_hash(body: Column | str) -> Column:
    """SHA-256 of code without its white space, but for that in string, character and text-block literals. Quotes in comments open nothing."""
    comment = r"//[^\n\r]*+|/\*[\s\S]*?(?:\*/|\z)"
    literal = r'"""[\s\S]*?(?:"""|\z)|"(?:[^"\\]++|\\[\s\S])*+(?:"|\\?\z)|\'(?:[^\'\\]++|\\[\s\S])*+(?:\'|\\?\z)'
    parts = F.regexp_extract_all(F.coalesce(_col(body), F.lit("")), F.lit(rf"(?:{comment}|{literal}|[^/\"\']++|/)"), F.lit(0))
    kept = F.transform(parts, lambda t: F.when(t.startswith("\"") | t.startswith("'"), t).otherwise(F.regexp_replace(t, BLANK, "")))
    return F.sha2(F.array_join(kept, ""), 256)


def without_literals(body: Column | str) -> Column:
    """Code with strings, characters and comments blanked."""
    return F.regexp_replace(_col(body), r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|//[^\n]*|/\*[\s\S]*?\*/', " ")


def has_loops(body: Column | str) -> Column:
    return F.coalesce(without_literals(body).rlike(r"\b(?:for|while|do)\b"), F.lit(False))


def has_conditionals(body: Column | str) -> Column:
    return F.coalesce(without_literals(body).rlike(r"\b(?:if|switch|case)\b|\?[^;?]*:"), F.lit(False))


def simple_type(name: Column | str) -> Column:
    """A type without generics, array marks, varargs and package."""
    return F.regexp_replace(F.trim(F.regexp_replace(_col(name), r"[<\[].*$|\.\.\.$", "")), r"^.*\.", "")


def split_top_level(csv: Column | str) -> Column:
    """Parts of a comma list, commas within angle brackets, however deep, not counting."""
    marks = F.regexp_extract_all(_col(csv), F.lit(r"[<>,]|[^<>,]++"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        cut = (x == ",") & (a["depth"] == 0)
        depth = a["depth"] + F.when(x == "<", 1).when((x == ">") & (a["depth"] > 0), -1).otherwise(0)
        return F.when(cut, F.struct(a["depth"].alias("depth"), F.lit("").alias("now"), F.array_append(a["out"], F.trim(a["now"])).alias("out"))).otherwise(
            F.struct(depth.alias("depth"), F.concat(a["now"], x).alias("now"), a["out"].alias("out"))
        )

    return F.aggregate(marks, start, step, lambda a: F.filter(F.array_append(a["out"], F.trim(a["now"])), lambda x: x != ""))


def parameter_type(token: Column | str) -> Column:
    """A parameter's type alone: without annotations, ``final``, its name and packages, in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.replace(F.trim(_col(token)), F.lit("$"), F.lit(".")), r"@\w+(?:\([^)]*\))?\s*", ""), r"\bfinal\b\s*", "")
    named = F.regexp_replace(bare, r"^(.+) [a-z_][A-Za-z0-9_]*$", "$1")
    return F.lower(F.regexp_replace(F.regexp_replace(named, r"(?<![A-Za-z0-9_])(?:[A-Za-z_][A-Za-z0-9_]*\.)+([A-Za-z_][A-Za-z0-9_]*)", "$1"), r"\s+", ""))


def parameter_types(signature: Column | str) -> Column:
    """The types between a signature's brackets, in order."""
    return F.transform(split_top_level(F.regexp_extract(_col(signature), r"\((.*)\)", 1)), parameter_type)


# Letters of descriptors and the types they stand for.
DESCRIPTOR = {"B": "byte", "C": "char", "D": "double", "F": "float", "I": "int", "J": "long", "S": "short", "Z": "boolean", "V": "void"}
_TYPE = "array<string>"


def descriptor_types(descriptor: Column | str) -> Column:
    """The parameter types of a JVM descriptor, qualified: ``(I[Ljava/lang/String;)V`` is ``int`` and ``java.lang.String[]``. None if it has no brackets."""
    inside = F.regexp_extract(_col(descriptor), r"^[^(]*\(([^)]*)\)", 1)
    letters = F.create_map(*[F.lit(x) for kv in DESCRIPTOR.items() for x in kv])

    def told(x: Column) -> Column:
        base = F.regexp_replace(x, r"^\[+", "")
        named = F.when(base.startswith("L"), F.replace(F.regexp_replace(base, "^L|;$", ""), F.lit("/"), F.lit("."))).otherwise(F.coalesce(letters[base], F.lit("")))
        return F.concat(named, F.repeat(F.lit("[]"), F.length(x) - F.length(base)))

    return F.transform(F.regexp_extract_all(inside, F.lit(r"\[*(?:L[^;]*;?|[^\[])"), F.lit(0)), told)


def unqualified(kind: Column) -> Column:
    """A type's name after its last dot or dollar, array marks kept."""
    return F.regexp_replace(kind, r"^.*[.$]((?:[^.$\[\]]|\[\])*)$", "$1")


def signature_name(signature: Column | str) -> Column:
    """The method's name before the brackets, without what stands before a space, dot or ``#``; null if there are no brackets."""
    head = F.trim(F.regexp_extract(_col(signature), r"^([^(]*)\(.*\)", 1))
    return F.when(_col(signature).rlike(r"(?s)^[^(]*\(.*\)"), F.regexp_extract(head, r"([^\s#.]*)$", 1))


def signature_types(signature: Column | str) -> Column:
    """The parameter types of a signature in a source: without generics, annotations, ``final`` and names, varargs as arrays."""
    inside = F.regexp_extract(_col(signature), r"(?s)^[^(]*\((.*)\)", 1)
    marks = F.regexp_extract_all(inside, F.lit(r"[<>,]|[^<>,]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("now"), F.array().cast(_TYPE).alias("out"))

    def step(a: Column, x: Column) -> Column:
        depth = a["depth"] + F.when(x == "<", 1).when((x == ">") & (a["depth"] > 0), -1).otherwise(0)
        cut = (x == ",") & (a["depth"] == 0)
        now = F.when(cut, "").when((a["depth"] == 0) & ~x.isin("<", ">"), F.concat(a["now"], x)).otherwise(a["now"])
        return F.struct(depth.alias("depth"), now.alias("now"), F.when(cut, F.array_append(a["out"], a["now"])).otherwise(a["out"]).alias("out"))

    def typed(x: Column) -> Column:
        plain = F.replace(F.replace(F.regexp_replace(x, r"@[A-Za-z0-9_$.]*(?:\((?:[^()]|\([^()]*\))*(?:\)|$))?\s*", " "), F.lit("..."), F.lit("[]")), F.lit("?"), F.lit(" "))
        return F.get(F.filter(F.split(plain, r"\s+"), lambda w: ~w.isin("", "final", "extends", "super")), F.lit(0))

    parts = F.aggregate(marks, start, step, lambda a: F.array_append(a["out"], a["now"]))
    return F.filter(F.transform(parts, typed), lambda t: F.coalesce(t != "", F.lit(False)))


def package_of(fqn: Column | str) -> Column:
    """What stands before the first capitalised token; empty if nothing does."""
    return F.regexp_replace(F.regexp_extract(_col(fqn), r"^((?:[^A-Z.][^.]*\.)*)", 1), r"\.$", "")


def class_of(fqn: Column | str) -> Column:
    return F.regexp_replace(_col(fqn), r"^(?:[^A-Z.][^.]*\.)*", "")


def package_role(package: Column | str) -> Column:
    """The role of the last token that has one; ``legacy`` only if no other has."""

    def role(t: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, equal, within in reversed(ROLES):
            hit = t.isin(*equal)
            for w in within:
                hit = hit | t.contains(w)
            out = F.when(hit, F.lit(name)).otherwise(out)
        return out

    name = _col(package)
    roles = F.filter(F.transform(F.reverse(F.split(F.lower(name), r"\.")), role), lambda r: r.isNotNull())
    first = F.coalesce(F.get(F.filter(roles, lambda r: r != "legacy"), F.lit(0)), F.get(roles, F.lit(0)), F.lit("core"))
    return F.when(name.isNull() | (F.trim(name) == "") | (name == "(default)"), F.lit("default")).otherwise(first)


def library_key(name: Column | str) -> Column:
    """Two tokens after a generic head, one otherwise."""
    parts = F.split(F.lower(_col(name)), r"\.")
    return F.when((F.size(parts) > 1) & F.get(parts, F.lit(0)).isin(*GENERIC_HEADS), F.concat_ws(".", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))).otherwise(F.get(parts, F.lit(0)))


def import_type(name: Column | str) -> Column:
    """The type an import names: a static import's owner, a wildcard's package."""
    plain = F.trim(_col(name))
    owner = F.when(plain.startswith("static "), F.regexp_replace(F.trim(F.regexp_replace(plain, r"^static ", "")), r"\.[^.]*$", "")).otherwise(plain)
    out = F.regexp_replace(owner, r"\.\*$", "")
    return F.when(out != "", out)


def uses_removed_api(imports: Column | str, types: Column | str | None = None) -> Column:
    """Whether any import is in a removed package, by class or wildcard, or any type names one, in its generics too."""
    packages = "|".join(p.replace(".", r"\.") for p in REMOVED_PACKAGES)

    def listed(x: Column | str) -> Column:
        return F.coalesce(_col(x), F.array().cast("array<string>"))

    hit = F.coalesce(F.exists(listed(imports), lambda x: F.trim(F.regexp_replace(x, r"^(?:import\s+)?(?:static\s+)?", "")).rlike(rf"^(?:{packages})(?:\.|$)")), F.lit(False))
    return hit if types is None else hit | F.coalesce(F.exists(listed(types), lambda x: x.rlike(rf"(?:^|[^A-Za-z0-9_.])(?:{packages})(?:\.|$)")), F.lit(False))


def is_sensitive(name: Column | str, annotations: Column | str) -> Column:
    """By a word in the method's name, or an annotation's simple name, whatever its arguments are."""
    marked = F.exists(F.coalesce(_col(annotations), F.array().cast("array<string>")), lambda a: F.coalesce(F.regexp_replace(F.regexp_replace(a, r"(?s)\(.*$", ""), r"^@?(?:.*\.)?", "").isin(*SENSITIVE_ANNOTATIONS), F.lit(False)))
    return F.coalesce(F.lower(_col(name)).rlike("|".join(SENSITIVE_WORDS)), F.lit(False)) | marked


def sensitive_ids(fqn: Column | str, name: Column | str, method_id: Column | str) -> Column:
    """The ids under which a sensitive method is known."""
    return F.array_distinct(F.array_compact(F.array(_col(method_id), F.concat(_col(fqn), F.lit("#"), _col(name)))))


def is_entry_point(annotations: Column | str, exact: tuple[str, ...], suffixes: tuple[str, ...] = ()) -> Column:
    def hit(a: Column) -> Column:
        out = a.isin(*exact)
        for s in suffixes:
            out = out | a.endswith(s)
        return out

    return F.coalesce(F.exists(F.coalesce(_col(annotations), F.array().cast("array<string>")), lambda a: F.coalesce(hit(a), F.lit(False))), F.lit(False))


def is_implicit_constructor(name: Column | str, class_name: Column | str, parameters: Column | str, loc: Column | str) -> Column:
    return ((_col(name) == _col(class_name)) | (_col(name) == "<init>")) & (F.coalesce(_col(parameters), F.lit(0)) == 0) & (F.coalesce(_col(loc), F.lit(0)) <= 0)


def brittle_signals(source: Column | str, calls: Column | str | None = None) -> Column:
    """Names of the signals found in source text or in the list of calls, in the order of SIGNALS."""
    found = []
    for name, (pattern, tokens) in SIGNALS.items():
        hit = F.coalesce(_col(source).rlike(pattern), F.lit(False))
        if calls is not None and tokens:
            said = F.coalesce(_col(calls), F.array().cast("array<string>"))
            hit = hit | F.coalesce(F.exists(said, lambda c: F.replace(F.lower(c), F.lit("#"), F.lit(".")).rlike("|".join(t.replace(".", r"\.") for t in tokens))), F.lit(False))
        found.append(F.when(hit, F.lit(name)))
    return F.array_compact(F.array(*found))


def mock_hint(kind: Column | str, visibility: Column | str, is_static: Column | str, abstract_types: Column | str, is_final: Column | str | None = None, constructor_types: Column | str | None = None) -> Column:
    """Struct (hint, injectable) of a field: ``required`` for interfaces and abstract classes of the file, ``recommended`` for
    private fields, not static, of mockable types; injectable is what is final as well and among the constructor's types."""
    own, nothing = simple_type(kind), F.array().cast("array<string>")

    def among(types: Column | str) -> Column:
        return F.coalesce(F.array_contains(F.transform(F.coalesce(_col(types), nothing), simple_type), own), F.lit(False))

    mine = F.coalesce((_col(visibility) == "private") & ~_col(is_static), F.lit(False))
    injectable = F.lit(False) if is_final is None or constructor_types is None else mine & F.coalesce(_col(is_final), F.lit(False)) & among(constructor_types)
    hint = F.when(among(abstract_types), "required").when(mine & own.rlike(f"(?i)^.*(?:{'|'.join(MOCKABLE)})$"), "recommended")
    return F.struct(hint.alias("hint"), (injectable & _col(kind).isNotNull()).alias("injectable"))


def is_main_class(is_nested: Column | str, path: Column | str, fqn: Column | str) -> Column:
    """Neither nested nor a test, by its path or its name."""
    at, name = F.lower(F.replace(F.coalesce(_col(path), F.lit("")), F.lit("\\"), F.lit("/"))), F.lower(F.trim(F.coalesce(_col(fqn), F.lit(""))))
    return ~(F.coalesce(_col(is_nested), F.lit(False)) | at.contains("/src/test/") | at.startswith("src/test/") | name.contains(".test.") | name.endswith("test"))


def is_false_positive(raw: Column | str) -> Column:
    """An unresolved call of a method that everything has."""
    name = F.regexp_extract(_col(raw), r"^unknown#([^(]*)", 1)
    return F.coalesce(_col(raw).startswith("unknown#") & name.isin(*JDK_METHODS, *BUILDER_METHODS), F.lit(False))


def class_type(annotations: Column | str, extends: Column | str) -> Column:
    """The kind of a class by its annotations, then by what it extends; GENERAL otherwise."""
    nothing = F.array().cast("array<string>")
    named = F.transform(F.coalesce(_col(annotations), nothing), lambda a: F.regexp_replace(F.trim(a), r"^@?(?:.*\.)?|\(.*$", ""))
    fails = F.exists(F.coalesce(_col(extends), nothing), lambda t: t.contains("Exception") | t.contains("Error") | t.contains("Throwable"))
    return F.when(F.exists(named, lambda a: a.isin(*SERVICE_ANNOTATIONS)), "SERVICE").when(F.exists(named, lambda a: a.isin(*DATA_ANNOTATIONS)), "DATA_CLASS").when(fails, "EXCEPTION").otherwise("GENERAL")


def cyclomatic(body: Column | str) -> Column:
    """1 and a branch for each if, for, while, catch, conditional expression and switch label, counted in the text without literals and comments."""
    return (F.lit(1) + F.coalesce(F.regexp_count(without_literals(body), F.lit(r"\b(?:if|for|while|catch|case|default)\b|\?[^;?:]*:")), F.lit(0))).cast("long")


def nesting(body: Column | str) -> Column:
    """How deep braces nest within the outermost ones."""
    steps = F.transform(F.regexp_extract_all(without_literals(body), F.lit("[{}]"), F.lit(0)), lambda x: F.when(x == "{", 1).otherwise(-1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
    deepest = F.aggregate(steps, start, lambda a, x: F.struct((a["now"] + x).alias("now"), F.greatest(a["most"], a["now"] + x).alias("most")), lambda a: a["most"])
    return F.greatest(F.coalesce(deepest, F.lit(0)) - 1, F.lit(0)).cast("long")


def guards(body: Column | str) -> Column:
    """Distinct guards in order, as ``throw`` or ``return`` and the condition they stand under."""
    found = F.regexp_extract_all(without_literals(body), F.lit(r"\bif\s*\(([^(){};]*(?:\([^(){};]*\)[^(){};]*)*)\)\s*\{?\s*((?:throw|return)\b)"), F.lit(0))
    kind, condition = r"(throw|return)$", r"\bif\s*\(([\s\S]*)\)\s*\{?\s*(?:throw|return)$"
    return F.array_distinct(F.transform(found, lambda g: F.concat_ws(" ", F.regexp_extract(g, kind, 1), F.trim(F.regexp_extract(g, condition, 1)))))


def canonical_json(text: Column | str) -> Column:
    """JSON with the keys of every object in order and no white space; lists stay as they are."""
    return F.to_json(F.parse_json(_col(text)))


def generated_test_name(class_name: Column | str, method: Column | str, given: Column | str | None = None, suffix: str = "GeneratedTest") -> Column:
    made = F.concat(F.replace(class_of(class_name), F.lit("."), F.lit("_")), F.lit("_"), F.coalesce(F.regexp_replace(_col(method), "[^A-Za-z0-9]", "_"), F.lit("unknown")), F.lit(suffix))
    return made if given is None else F.when(F.trim(_col(given)) != "", _col(given)).otherwise(made)


def cache_key(*parts: Column | str) -> Column:
    """SHA-256 over the parts, each led by its length, so that no two lists of parts meet."""
    told = [F.concat(F.length(F.coalesce(_col(p), F.lit(""))).cast("string"), F.lit(":"), F.coalesce(_col(p), F.lit(""))) for p in parts]
    return F.sha2(F.concat(*told), 256)


def mismatch(message: Column | str) -> Column:
    """Struct (expected, actual, kind) from an assertion's message in any of four dialects; null if it has none."""
    said = _col(message)
    # The dialects, in order.
    dialects = (
        r"expected:\s*<([^>]*)>\s*but was:\s*<([^>]*)>",
        r"expected:\s*([^\n]+?)\s+but was:\s*([^\n]+)",
        r"[Ee]xpecting[:\s]+([^\n]+?)\s+(?:to be equal to|but was)[:\s]+([^\n]+)",
        r"Expected:\s*([^\n]+)\s+but:\s*(?:was\s+)?([^\n]+)",
    )
    pair = F.coalesce(*[F.when(said.rlike(d), F.struct(F.trim(F.regexp_extract(said, d, 1)).alias("expected"), F.trim(F.regexp_extract(said, d, 2)).alias("actual"))) for d in dialects])
    both = F.concat_ws("\n", pair["expected"], pair["actual"])
    kind = (
        F.when(both.rlike(r"(?i)\bnull\b"), "null")
        .when(both.rlike(r"^[+-]?\d+\n[+-]?\d+$"), "integer")
        .when(both.rlike(r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\n[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "float")
        .when(both.rlike(r"\[.*\]"), "collection")
        .when(both.rlike(r"\{.*\}"), "map")
        .otherwise("value")
    )
    return F.when(pair.isNotNull(), F.struct(pair["expected"].alias("expected"), pair["actual"].alias("actual"), kind.alias("kind")))


# What begins the names of frameworks' frames, and what is in those of tests.
FRAMEWORKS, TESTS = ("org.junit.", "org.assertj.", "org.hamcrest.", "java.", "jdk.", "sun."), ("Test", "Spec", "IT", "Case")
INTEGER, NUMBER = r"^[+-]?\d+$", r"^[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"


def mismatch_details(message: Column | str, trace: Column | str) -> Column:
    """Struct (type, expected, actual, delta, location, line) of a failed assertion.

    The type is told by nulls and exceptions in the message, then by the values, then by words of the message. The delta is of numbers only, of integers exactly, else to six places. The line is that of the
    first frame; the location is the first frame of a test, or else the first that is no framework's.
    """
    said, at = _col(message), _col(trace)
    pair = mismatch(said)
    expected, actual = pair["expected"], pair["actual"]

    def both(pattern: str) -> Column:
        return expected.rlike(pattern) & actual.rlike(pattern)

    def either(pattern: str) -> Column:
        return expected.rlike(pattern) | actual.rlike(pattern)

    def has(*words: str) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | said.contains(w)
        return out

    whole = both(INTEGER)
    kind = (
        F.when(said.isNull() | (said == ""), "UNKNOWN").when(said.rlike(r"(?i)\bnull\b"), "NULL_MISMATCH").when(has("exception", "Exception"), "EXCEPTION_MESSAGE")
        .when(whole, "NUMERIC").when(both(NUMBER), "FLOAT_TOLERANCE").when(either(r"\[.*\]") & has("order", "sorted"), "ORDERING").when(either(r"\[.*\]"), "COLLECTION").when(either(r"\{.*\}"), "MAP").when(either("^[\"']"), "STRING")
        .when(has("collection", "list", "size"), "COLLECTION").when(has("order", "sorted"), "ORDERING").when(has("string", "String"), "STRING").when(pair.isNotNull(), "OBJECT_EQUALS").otherwise("UNKNOWN")
    )
    exact = F.abs(F.try_subtract(expected.try_cast("long"), actual.try_cast("long"))).cast("string")
    delta = F.when(kind.isin("NUMERIC", "FLOAT_TOLERANCE"), F.when(whole, exact).otherwise(F.format_string("%.6f", F.abs(expected.try_cast("double") - actual.try_cast("double")))))
    frames = F.regexp_extract_all(at, F.lit(r"at\s+([\w.$]+\([\w$]+\.java:\d+\))"), F.lit(1))
    own = F.filter(frames, lambda f: ~f.rlike(f"^(?:{'|'.join(x.replace('.', '[.]') for x in FRAMEWORKS)})"))
    test = F.filter(own, lambda f: F.regexp_extract(f, r"^([^(]*)", 1).rlike("|".join(TESTS)))
    line = F.regexp_extract(F.get(frames, F.lit(0)), r":(\d+)\)$", 1).try_cast("int")
    return F.struct(kind.alias("type"), expected.alias("expected"), actual.alias("actual"), delta.alias("delta"), F.coalesce(F.get(test, F.lit(0)), F.get(own, F.lit(0))).alias("location"), line.alias("line"))


# Rules of brittle tests, each with its severity and pattern.
TEST_RULES = (
    ("SLEEP", "ERROR", r"\bThread\s*\.\s*(?:currentThread\s*\(\s*\)\s*\.\s*)?sleep\s*\(|\bTimeUnit\s*\.\s*\w+\s*\.\s*sleep\s*\(|\b(?:NANOSECONDS|MICROSECONDS|MILLISECONDS|SECONDS|MINUTES|HOURS|DAYS)\s*\.\s*sleep\s*\("),
    ("TIME", "WARNING", r"\b(?:Instant|LocalDateTime|LocalDate|LocalTime|ZonedDateTime|OffsetDateTime|OffsetTime|Year|YearMonth|MonthDay)\s*\.\s*now\s*\(|\bSystem\s*\.\s*(?:currentTimeMillis|nanoTime)\s*\(|\bClock\s*\.\s*(?:systemDefaultZone|systemUTC|system)\s*\("),
    ("RANDOM", "WARNING", r"\bnew\s+(?:Random|SecureRandom|SplittableRandom)\s*\(|\bUUID\s*\.\s*randomUUID\s*\(|\bThreadLocalRandom\s*\.\s*current\s*\(|\bMath\s*\.\s*random\s*\("),
    ("REFLECTION", "ERROR", r"\.\s*(?:setAccessible|getDeclaredField|getDeclaredFields|getDeclaredMethod|getDeclaredMethods|getDeclaredConstructor|getDeclaredConstructors)\s*\(|\bClass\s*\.\s*forName\s*\("),
)
# Mocks from which a test is called over-mocked, a warning and an error, and what spies and static mocks weigh.
MOCKS_WARN, MOCKS_FAIL, SPY_WEIGHT, STATIC_WEIGHT = 3, 6, 2, 2


def mock_weight(source: Column | str, static: bool = False) -> Column:
    """Mocks of a test, spies counting twice, static ones too if asked for."""
    text = without_literals(source)

    def n(pattern: str) -> Column:
        return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))

    out = n(r"(?<![\w.])(?:Mockito\s*\.\s*)?mock\s*\(") + n(r"@Mock\b") + SPY_WEIGHT * (n(r"(?<![\w.])(?:Mockito\s*\.\s*)?spy\s*\(") + n(r"@Spy\b"))
    return out + STATIC_WEIGHT * n(r"(?<![\w.])(?:Mockito\s*\.\s*)?(?:mockStatic|mockConstruction)\s*\(") if static else out


def brittle_test_rules(source: Column | str, warn: int = MOCKS_WARN, fail: int = MOCKS_FAIL, static: bool = False) -> Column:
    """Rules that a test breaks, as ``RULE:SEVERITY``, told from its text without literals and comments."""
    text, weight = without_literals(source), mock_weight(source, static)
    found = [F.when(text.rlike(pattern), F.lit(f"{name}:{severity}")) for name, severity, pattern in TEST_RULES]
    return F.array_compact(F.array(*found, F.when(weight > fail, "OVER_MOCK:ERROR").when(weight > warn, "OVER_MOCK:WARNING")))
