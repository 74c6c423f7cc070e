"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

Items are cut into windows of ``WINDOW`` words (shorter items are one window). A window is
the set of its shingles in place; since a contained window has all of its shingles in the
document, the one rarest in the documents is a sufficient prefix. Documents are joined with
windows on that shingle alone, the position it would give the window must lie within the
document, and the words there are compared exactly.

The documents are read once. A bitmap of the items' shingles, of bounded size, thins out
document positions before anything is shuffled; what passes carries the words around it,
so no later stage needs the texts. The bitmap only saves work: matches are decided by the
joins and the exact comparison behind it.

Semantics
* Words are runs of 0-9, a-z and non-ASCII characters after lower-casing A-Z. Null texts
  and texts without words have no words and are never hit; such items have no window.
* Every input row is judged by itself, whatever its id, and gives one row.
* Items with equal windows all count. ``item_id`` nulls are dropped from the lists.
* Empty documents or benchmark tables work as such; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .work import discard, key_and_text, materialize

WINDOW = 13
SHINGLE = 5
#: Contaminated: at least 1 in so many words is hit.
SHARE = 20
#: Bits of the bitmap: 32 for each of the items' shingles, between 512 KB and 16 MB in all.
BITS_EACH, LEAST_BITS, MOST_BITS = 32, 1 << 22, 1 << 27
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    plain = F.length(text) == F.octet_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def _starts(n: Column, width: int) -> Column:
    """1 .. n - width + 1, empty if there is none."""
    return F.when(n >= width, F.sequence(F.lit(1), n - width + 1)).otherwise(F.array().cast("array<int>"))


def windows_of(items: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """Distinct windows (``wkey, words, wlen``) and ``wkey, item_id``."""
    rows = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("w")).withColumn("n", F.size("w")).filter("n > 0")
    width = F.least(F.col("n"), F.lit(window))
    cut = rows.select("item_id", "w", width.alias("wlen"), F.explode(F.sequence(F.lit(1), F.col("n") - width + 1)).alias("at"))
    cut = cut.select("item_id", F.slice("w", F.col("at"), F.col("wlen")).alias("words"), "wlen")
    keyed = cut.withColumn("wkey", F.unhex(F.md5(F.array_join("words", " "))))
    windows = keyed.groupBy("wkey").agg(F.first("words").alias("words"), F.first("wlen").alias("wlen"))
    return windows, keyed.select("wkey", "item_id").filter(F.col("item_id").isNotNull()).distinct()


def _bits_for(n: int) -> int:
    bits = LEAST_BITS
    while bits < min(BITS_EACH * n, MOST_BITS):
        bits *= 2
    return bits


def _bitmap(hashes: DataFrame, size: int) -> DataFrame:
    """One row, one array of ``size`` / 64 longs."""
    bit = F.pmod(F.col("h"), F.lit(size))
    cells = hashes.select(F.shiftright(bit, 6).alias("cell"), F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(bit, F.lit(64)).cast("int")).alias("m"))
    masks = cells.groupBy("cell").agg(F.bit_or("m").alias("m"))
    spark = hashes.sparkSession
    every = spark.range(0, size // 64, 1, 1).withColumnRenamed("id", "cell").join(masks, "cell", "left")
    listed = every.agg(F.array_sort(F.collect_list(F.struct("cell", F.coalesce("m", F.lit(0)).alias("m")))).alias("a"))
    return listed.select(F.transform("a", lambda x: x["m"]).alias("bits"))


def _maybe(bits: Column, h: Column, size: int) -> Column:
    bit = F.pmod(h, F.lit(size))
    return F.getbit(F.element_at(bits, (F.shiftright(bit, 6) + 1).cast("int")), F.pmod(bit, F.lit(64)).cast("int")) == 1


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(``row_id, doc_id, sum, n_words``) of every row, and (``row_id, start, end, wkey``) of every window in them."""
    s = F.least(F.col("wlen"), F.lit(shingle))
    shingles = windows.select("wkey", "words", "wlen", s.alias("s"), F.explode(F.sequence(F.lit(1), F.col("wlen") - s + 1)).alias("off"))
    shingles = materialize(
        shingles.select("wkey", "words", "wlen", "s", "off", F.xxhash64("s", F.slice("words", F.col("off"), F.col("s"))).alias("h")), "item-shingles"
    )
    sizes = [r["s"] for r in shingles.select("s").distinct().collect()]  # at most SHINGLE of them
    reach, bits = window - 1, _bits_for(shingles.count())
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"), words_of(F.col("text")).alias("w"), _bitmap(shingles.select("h").distinct(), bits).scalar().alias("bits"))
    rows = rows.withColumn("n_words", F.size("w"))
    hash_at = lambda i, size: F.xxhash64(F.lit(size), F.slice(F.col("w"), i, size))

    def hits(size: int) -> Column:
        found = F.filter(_starts(F.col("n_words"), size), lambda i: _maybe(F.col("bits"), hash_at(i, size), bits))
        return F.transform(
            found,
            lambda i: F.struct(
                i.alias("pos"), hash_at(i, size).alias("h"), F.greatest(i - reach, F.lit(1)).alias("lo"),
                F.slice(F.col("w"), F.greatest(i - reach, F.lit(1)), i + reach + size - F.greatest(i - reach, F.lit(1))).alias("around"),
            ),
        )

    empty = "array<struct<pos:int,h:bigint,lo:int,around:array<string>>>"
    found = F.concat(*[hits(x) for x in sorted(sizes)]) if sizes else F.array()
    marked = materialize(
        rows.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "sum", F.col("n_words").cast("long").alias("n_words"), found.cast(empty).alias("hits")), "document-hits"
    )
    hit = marked.select("row_id", "n_words", F.explode("hits").alias("x")).select("row_id", "n_words", "x.*")
    counts = hit.groupBy("h").agg(F.count("*").alias("n_docs"))
    rare = shingles.join(counts, "h")  # a shingle that no document has needs no count: see below
    chosen = rare.groupBy("wkey").agg(F.count("*").alias("n"), F.min_by(F.struct("h", "off", "words", "wlen", "s"), F.struct("n_docs", "h", "off")).alias("p"))
    # A window with any shingle that is in no document occurs nowhere.
    prefix = chosen.filter(F.col("n") == F.col("p.wlen") - F.col("p.s") + 1).select("wkey", "p.*")
    start = F.col("pos") - F.col("off") + 1
    near = hit.join(prefix, "h").withColumn("start", start).filter((F.col("start") >= 1) & (F.col("start") + F.col("wlen") - 1 <= F.col("n_words")))
    exact = near.filter(F.slice("around", F.col("start") - F.col("lo") + 1, F.col("wlen")) == F.col("words"))
    return marked.select("row_id", "doc_id", "sum", "n_words"), exact.select("row_id", "start", (F.col("start") + F.col("wlen") - 1).alias("end"), "wkey").distinct()


def _covered(spans: Column) -> Column:
    """Number of positions in a union of [start, end] spans."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("upto"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.greatest(x["end"] - F.greatest(acc["upto"], x["start"] - 1), F.lit(0))
        return F.struct((acc["n"] + fresh).cast("long").alias("n"), F.greatest(acc["upto"], x["end"]).alias("upto"))

    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    window: int = WINDOW, shingle: int = SHINGLE,
) -> DataFrame:
    """``doc_id, n_words, n_hit, item_ids, contaminated, sum`` for every row of ``docs``; ``sum`` is a hash of its text."""
    windows, owners = windows_of(benchmark, item_col, item_text_col, window)
    rows, found = occurrences(key_and_text(docs, id_col, text_col), windows, window, shingle)
    found = materialize(found, "window-occurrences")
    spans = found.groupBy("row_id").agg(_covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"))
    items = (
        found.select("row_id", "wkey").distinct().join(owners, "wkey").groupBy("row_id")
        .agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    )
    out = rows.join(spans, "row_id", "left").join(items, "row_id", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return out.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (SHARE * n_hit >= F.col("n_words"))).alias("contaminated"), "sum",
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


_WORDS_SQL = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP2_SQL = f"""
WITH dw AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
bw AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
win AS (SELECT item_id, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS t, least(len(w), 13) AS n
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM bw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM dw, lens WHERE len(w) >= n),
occ AS (SELECT p.doc_id, p.i, p.n, win.item_id
        FROM (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS t FROM pos) p JOIN win ON win.t = p.t AND win.n = p.n),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS s FROM occ GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
