"""Secret scan: base patterns, and character Markov models of random strings and identifiers.

DataFrame operations only. Two first-order character chains are counted from labelled
samples (1: random strings, 0: ordinary identifiers); a long token is reported when its
log-likelihood ratio per character pair is above a threshold, or that of one of its segments,
or when the sum over its best run of pairs is high: a random string joined to a path, URL or
long name is not outvoted by it. Only the table of pair
scores, of fixed size (67 x 67), comes to the driver and goes into the plan.

Semantics
* Offsets are code points, ends exclusive. A null text is the empty text. Rows repeat as
  they are; columns other than the id and the text are ignored.
* Base spans always stay. A token that touches a base span, is a UUID, or has no letter or
  no digit adds nothing.
* A token is reported whole, with the path or name it holds. UUIDs in it don't count in its best run.
* With a class missing from the samples the models can't be told apart and add nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import key_and_text

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
UUID = f"^{_UUID}$"
SEPARATOR, SEGMENT_LEAST = r"[/=_-]", 16
KEYWORDS = r"""(?i:passw|secret|token|api_?key)[a-zA-Z"']{0,4}\x20*[:=]"""
#: Rows without this can hold no span of any kind, and skip the rest.
ANY = r"(?i:passw|secret|token|api_?key)|AKIA|[A-Za-z0-9+/_=-]{20}"
#: Mean log-likelihood ratio per pair of characters, in nats.
THRESHOLD = 0.5
#: Sum of the log-likelihood ratios over a token's best run of pairs, in nats.
RUN_THRESHOLD = 28.0
SMOOTHING = 0.5
#: Elements that are run at once where running values of an array are needed.
CHUNK = 64
SAMPLES = 4000  # of each class, in the generated samples

_SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
# Common parts of identifiers, paths and slugs.
PARTS = (
    "get set user name file path data list item value index count total size type class method function object model view controller service manager handler factory "
    "builder provider config option setting default parameter argument result response request client server session context event listener message queue task job worker "
    "thread process memory buffer stream reader writer parser token lexer node tree graph edge vertex matrix vector table column row record field key map filter reduce sort "
    "search find insert update delete create remove open close start stop init load save read write send receive test spec mock util helper common core base main app page "
    "http https www com org net html json xml css src lib bin include docs build dist target package module import export public private static final abstract interface "
    "the and for with from this that have been will about would there their which people other first time after new year world news article story home image photo video"
).split()


# --- training ---------------------------------------------------------------------------


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """``text, label``: generated from hashes of row numbers, so always the same."""
    ids = spark.range(n)
    digest = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    raw = F.unhex(digest("r"))
    shape = F.pmod("id", F.lit(4))
    coded = F.base64(raw)
    random = F.when(shape == 0, F.substring(coded, 1, 40)).when(shape == 1, F.substring(digest("h"), 1, 40)).when(shape == 2, F.upper(F.substring(F.translate(coded, "+/=", "xyz"), 1, 32))).otherwise(F.translate(F.substring(coded, 1, 36), "+/=", "_-A"))
    parts = F.array(*map(F.lit, PARTS))
    part = lambda k: F.element_at(parts, (F.pmod(F.xxhash64(F.lit(k), F.col("id")), F.lit(len(PARTS))) + 1).cast("int"))
    words = F.array(*[part(k) for k in range(6)])
    number = F.pmod(F.xxhash64(F.lit("n"), F.col("id")), F.lit(2100)).cast("string")
    style = F.pmod("id", F.lit(5))
    plain = (
        F.when(style == 0, F.concat_ws("_", words, number)).when(style == 1, F.concat_ws("-", number, words)).when(style == 2, F.concat_ws("/", words, number))
        .when(style == 3, F.concat(F.replace(F.initcap(F.array_join(words, " ")), F.lit(" "), F.lit("")), number)).otherwise(F.upper(F.concat_ws("_", words, number)))
    )
    return ids.select(random.alias("text"), F.lit(1).alias("label")).unionByName(ids.select(plain.alias("text"), F.lit(0).alias("label")))


def train(samples: DataFrame) -> list[float]:
    """Scores of the 67 x 67 character pairs: log P(b | a, random) - log P(b | a, ordinary)."""
    n = len(ALPHABET)
    rows = samples.filter(F.col("text").isNotNull() & F.col("label").isin(0, 1) & (F.length("text") > 1))
    at = F.explode(F.sequence(F.lit(1), F.length("text") - 1)).alias("i")
    pairs = rows.select("label", "text", at).select("label", F.expr("substring(text, i, 1)").alias("a"), F.expr("substring(text, i + 1, 1)").alias("b"))
    known = pairs.filter(F.col("a").rlike("^[A-Za-z0-9+/_=-]$") & F.col("b").rlike("^[A-Za-z0-9+/_=-]$"))
    counts = {(r["label"], r["a"], r["b"]): r["count"] for r in known.groupBy("label", "a", "b").count().collect()}  # 2 x 67 x 67 rows at most
    if {k for k, _, _ in counts} != {0, 1}:
        return []
    sums: dict[tuple[int, str], float] = {}
    for (label, a, _), c in counts.items():
        sums[label, a] = sums.get((label, a), 0.0) + c
    log_p = lambda label, a, b: math.log((counts.get((label, a, b), 0) + SMOOTHING) / (sums.get((label, a), 0.0) + SMOOTHING * n))
    return [log_p(1, a, b) - log_p(0, a, b) for a in ALPHABET for b in ALPHABET]


# --- expressions ------------------------------------------------------------------------


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), 0)


def _append(chunk: Column, zero: Column, step) -> Column:
    """zero, step(zero, x1), step(.., x2) ..: the running values of a short array."""
    return F.aggregate(chunk, F.array(zero), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))


def running(values: Column, zero: Column, step, levels: int = 3) -> Column:
    """For each of ``values`` what ``step``, which is associative, makes of those before it.

    An array grows by copying, so chunks of ``CHUNK`` are run one by one, and the results of the
    chunks, level by level, in the same way: the work is in proportion to the length.
    """
    return _let(values, lambda v: _running(v, zero, step, levels))


def _running(values: Column, zero: Column, step, levels: int) -> Column:
    n = F.size(values)
    if levels == 1:
        return F.slice(_append(values, zero, step), 1, n)
    starts = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))).otherwise(F.array().cast("array<int>"))

    def join(chunks: Column) -> Column:
        before = running(F.transform(chunks, lambda c: F.element_at(c, -1)), zero, step, levels - 1)
        return F.flatten(F.zip_with(chunks, before, lambda c, b: F.transform(F.slice(c, 1, F.size(c) - 1), lambda x: step(b, x))))

    chunks = F.transform(starts, lambda k: _append(F.slice(values, k * CHUNK + 1, CHUNK), zero, step))
    return F.when(n <= CHUNK, F.slice(_append(values, zero, step), 1, n)).otherwise(_let(chunks, join))


def _spans(text: Column, pattern: str, kind: str, possible: Column, keep, group: int = 0) -> Column:
    """Spans of all matches for whose ``group`` keep(text of the group) holds: the pieces between matches give the places.

    ``possible``: whether there can be a match, a test that costs less than the search.
    """
    # What a lambda holds is computed for each element, so all that depends on the text is bound outside.
    found = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"),
        *([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g")] if group else []),
    )

    def placed(f: Column) -> Column:
        # A match ends after all that is before it: pieces and matches in turn.
        ends = F.zip_with(F.slice(f["p"], 1, F.size(f["m"])), f["m"], lambda p, m: F.length(p).cast("long") + F.length(m))
        return _let(F.arrays_zip(f["m"].alias("m"), f["g" if group else "m"].alias("g"), ends.alias("e"), running(ends, F.lit(0).cast("long"), lambda a, b: a + b).alias("b")), chosen)

    def chosen(rows: Column) -> Column:
        good = F.filter(rows, lambda x: keep(x["g"]))
        return F.transform(good, lambda x: F.struct(F.lit(kind).alias("kind"), (x["b"] + x["e"] - F.length(x["m"])).alias("start"), (x["b"] + x["e"]).alias("end")))

    return F.when(possible, _let(found, placed)).otherwise(F.array()).cast(_SPANS)


def _literal(values: list, kind: str) -> Column:
    """An array of numbers as one literal, which the optimizer folds."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{kind}>")


def _pair_scores(token: Column, scores: list[float]) -> Column:
    """The scores of a token's character pairs, in order; every character is looked up once."""
    # Characters by their code; those outside the alphabet count as its last.
    codes = [ALPHABET.find(chr(c)) if chr(c) in ALPHABET else len(ALPHABET) - 1 for c in range(128)]
    places, table = _literal(codes, "int"), _literal(scores, "double")
    at = F.transform(F.split(token, ""), lambda c: F.element_at(places, F.least(F.ascii(c), F.lit(127)) + 1))

    def pairs(codes: Column) -> Column:
        n = F.size(codes)
        return F.zip_with(F.slice(codes, 1, n - 1), F.slice(codes, 2, n - 1), lambda a, b: F.element_at(table, a * len(ALPHABET) + b + 1))

    return F.when(F.length(token) > 1, _let(at, pairs)).otherwise(F.array().cast("array<double>"))


def _sum(scores: Column) -> Column:
    return F.aggregate(scores, F.lit(0.0), lambda acc, x: acc + x)


def pair_score(token: Column, scores: list[float]) -> Column:
    """Mean score of the token's character pairs."""
    return _sum(_pair_scores(token, scores)) / (F.length(token) - 1)


def best_run(token: Column, scores: list[float]) -> Column:
    """Largest sum of scores over adjacent character pairs."""
    start = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("best"))

    def step(acc: Column, x: Column) -> Column:
        run = F.greatest(acc["run"] + x, F.lit(0.0))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(_pair_scores(token, scores), start, step, lambda acc: acc["best"])


def looks_random(token: Column, scores: list[float], threshold: float = THRESHOLD) -> Column:
    """Whether the token, a segment of it between separators, or a run of its pairs does."""
    mixed = lambda x: (F.length(x) >= SEGMENT_LEAST) & x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    segment = F.exists(F.split(token, SEPARATOR), lambda x: F.when(mixed(x), pair_score(x, scores) >= threshold).otherwise(False))
    run = best_run(F.regexp_replace(token, _UUID, "/"), scores) >= RUN_THRESHOLD
    return F.when(pair_score(token, scores) >= threshold, True).when(segment, True).otherwise(run)


def _apart(more: Column, base: Column) -> Column:
    """The spans of ``more`` that touch none of ``base``: by running maxima of the ends before and minima of the starts after."""
    far = F.lit(2**62)
    event = lambda own: lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(own).alias("own"), x["kind"].alias("kind"))

    def sweep(e: Column) -> Column:
        ends = running(F.transform(e, lambda x: F.when(x["own"], F.lit(-1).cast("long")).otherwise(x["end"])), F.lit(-1).cast("long"), lambda a, b: F.greatest(a, b))
        starts = running(F.reverse(F.transform(e, lambda x: F.when(x["own"], far).otherwise(x["start"]))), far, lambda a, b: F.least(a, b))
        judged = F.arrays_zip(e.alias("x"), ends.alias("before"), F.reverse(starts).alias("after"))
        free = F.filter(judged, lambda j: j["x"]["own"] & (j["before"] <= j["x"]["start"]) & (j["after"] >= j["x"]["end"]))
        return F.transform(free, lambda j: F.struct(j["x"]["kind"].alias("kind"), j["x"]["start"].alias("start"), j["x"]["end"].alias("end")))

    return _let(F.array_sort(F.concat(F.transform(base, event(False)), F.transform(more, event(True)))), sweep).cast(_SPANS)


def scan(docs: DataFrame, scores: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, added``: arrays of (kind, start, end) for every row, by start."""
    rows = key_and_text(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    text = F.when(F.col("text").rlike(ANY), F.col("text")).otherwise("")
    if_any = lambda c: F.when(F.col("text") == "", F.array().cast(_SPANS)).otherwise(c)
    rows = rows.select("doc_id", text.alias("text"))
    base = F.concat(
        _spans(F.col("text"), ASSIGN, "assign", F.col("text").rlike(KEYWORDS), lambda g: F.length(g) >= ASSIGN_LEAST, 2),
        _spans(F.col("text"), ACCESS, "access", F.col("text").contains("AKIA"), lambda m: F.length(m) >= ACCESS_LEAST),
        _spans(F.col("text"), f"[0-9a-f]{{{HEX_LEAST},}}", "hex", F.col("text").rlike(f"[0-9a-f]{{{HEX_LEAST}}}"), lambda m: F.lit(True)),
    )
    found = rows.select("doc_id", "text", if_any(base).alias("base"))
    if scores:
        odd = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]") & ~m.rlike(UUID)
        more = if_any(_spans(F.col("text"), TOKEN, "random", F.col("text").rlike("[A-Za-z0-9+/_=-]{20}"), lambda m: F.when(odd(m), looks_random(m, scores, threshold)).otherwise(False)))
    else:
        more = F.array().cast(_SPANS)
    found = found.select("doc_id", "base", more.alias("more"))
    both = (F.size("more") > 0) & (F.size("base") > 0)
    return found.select("doc_id", "base", F.when(both, _apart(F.col("more"), F.col("base"))).otherwise(F.col("more")).alias("added"))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed, comma-joined."""
    rank = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("s"), rank(x).alias("k"), x["end"].alias("e"), x["kind"].alias("kind"))))
    return F.array_join(F.transform(order, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = train(labelled_samples(spark))
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), scores)
    n = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    none = F.sha2(F.lit(""), 256)
    any_base = F.size("base") > 0
    return found.select(
        "doc_id", *map(n, KINDS[:3]), F.when(any_base, F.sha2(joined(F.col("base")), 256)).otherwise(none).alias("base_sha256"),
        F.when(any_base | (F.size("added") > 0), joined(F.concat("base", "added"))).otherwise("").alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
