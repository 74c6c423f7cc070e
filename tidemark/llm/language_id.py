"""Language identification by compression.

For each language a raw-content zstandard dictionary is cut from a bounded sample of
labelled documents. A text is encoded, in blocks, with every dictionary; the smallest
total wins, and the decision is rejected when the runner-up is too close in proportion to it.
One rule serves all lengths.

Semantics
* Learns from rows with a text, a non-null ``lang`` and ``crc32(doc_id as text) % 4 != 2``
  only. The sample is, per language, the ``SAMPLE_DOCS`` documents smallest by a hash of
  the id among those of ``SAMPLE_LEAST`` to ``SAMPLE_MOST`` bytes. Where a language has fewer,
  longer ones fill its sample, each with ``PIECE`` characters from its middle, and then shorter
  ones. Distinct texts, up to ``DICT_BYTES``. Every language with a labelled text is learned.
* A null text, or one without any letter, is ``und`` with score 0 and rejected. An empty
  training set makes every text ``und``. Equal sizes go to the language with more training
  rows, and are rejected.
* Dictionaries and texts are lower-cased first, so that capitals don't decide.
* ``score`` is the estimated probability against the runner-up; with one language, 1.
* The whole text counts. Rows repeat as they are; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SAMPLE_DOCS = 64
SAMPLE_LEAST, SAMPLE_MOST = 400, 16_384
DICT_BYTES = 112 * 1024
#: Characters taken of a longer document: at four bytes each they are SAMPLE_MOST.
PIECE = SAMPLE_MOST // 4
#: A lazy parse with 3-byte matches: the short suffixes and function words of a language count.
PARAMETERS = {"window_log": 18, "hash_log": 17, "chain_log": 17, "search_log": 5, "min_match": 3, "strategy": 5}
BLOCK = 4096
#: Every block is encoded behind the last TAIL bytes of the dictionary, whose own size is taken off:
#: alone a short one would not make the coder leave its raw mode.
TAIL = 300
#: Rejected where the best total is not at least this share under the next one. Of held-out documents of 10,000,
#: 0.2 % of those decided right are under it (texts of a few words, on equal bytes), and over three quarters of those in a
#: language that was left out of the training.
MARGIN = 0.02
#: Of the logistic curve that turns the margin in bits into a score.
BITS_SCALE = 0.25


def training_rows(docs: DataFrame) -> DataFrame:
    """Rows that may be learned from: never the held-out quarter."""
    return docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame) -> dict[str, bytes]:
    """Language to dictionary content, most frequent first, from a sample bounded by the parameters above."""
    rows = training_rows(docs.select("doc_id", "text", "lang"))
    langs = [x["lang"] for x in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    n = F.octet_length("text")
    keyed = rows.filter(n > 0).withColumn("t", F.xxhash64("text"))
    ranked = keyed.select(
        "lang", "doc_id", "t", F.when(n > SAMPLE_MOST, 1).when(n < SAMPLE_LEAST, 2).otherwise(0).alias("odd"), F.md5(F.concat(F.lit("lid:"), F.col("doc_id").cast("string"))).alias("h")
    )
    order = Window.partitionBy("lang").orderBy("odd", F.asc_nulls_last("h"), "t")
    chosen = ranked.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= SAMPLE_DOCS)
    chosen = chosen.groupBy("lang", "doc_id", "t").agg(F.min("r").alias("r"))
    ids = chosen.collect()
    if not ids:
        return {}
    c = F.broadcast(docs.sparkSession.createDataFrame(ids, chosen.schema)).alias("c")
    same = (F.col("c.lang") == F.col("k.lang")) & F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.t") == F.col("k.t"))
    middle = F.greatest(F.lit(1), ((F.length("text") - PIECE) / 2).cast("int"))
    piece = F.when(n > SAMPLE_MOST, F.substring("text", middle, F.lit(PIECE))).otherwise(F.col("text"))
    picked = keyed.alias("k").join(c, same).select("c.lang", "r", piece.alias("text")).dropDuplicates(["lang", "r"])
    texts: dict[str, list] = {x: [] for x in langs}
    for row in picked.collect():
        texts[row["lang"]].append((row["r"], row["text"].encode()))
    out = {}
    for lang, found in texts.items():
        parts, size, seen = [], 0, set()
        for _, text in sorted(found):
            if text in seen or (parts and size + len(text) > DICT_BYTES):
                continue
            seen.add(text)
            parts.append(text)
            size += len(text)
        if parts:
            # What stands at the end of a dictionary is cheapest to refer to.
            out[lang] = b"\n".join(reversed(parts)).decode().lower().encode()
    return out


class Classifier:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        self.langs = list(dictionaries)
        self.coders = []
        self.tails = [content[-TAIL:] for content in dictionaries.values()]
        for content in dictionaries.values():
            how = zstandard.ZstdCompressionParameters(write_content_size=False, write_checksum=False, write_dict_id=False, **PARAMETERS)
            prepared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            prepared.precompute_compress(compression_params=how)
            self.coders.append(zstandard.ZstdCompressor(compression_params=how, dict_data=prepared))
        self.alone = [len(c.compress(t)) for c, t in zip(self.coders, self.tails, strict=True)]

    def sizes(self, data: bytes) -> list[int]:
        """Bytes the text takes with each dictionary, over all its blocks."""
        blocks = [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]
        return [sum(len(c.compress(t + b" " + b)) - a for b in blocks) for c, t, a in zip(self.coders, self.tails, self.alone, strict=True)]

    def decide(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        if text is None or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        sizes = self.sizes(text.lower().encode())
        best = min(range(len(sizes)), key=sizes.__getitem__)
        if len(sizes) == 1:
            return self.langs[0], 1.0, False
        gap = min(s for i, s in enumerate(sizes) if i != best) - sizes[best]
        return self.langs[best], 1.0 / (1.0 + math.exp(-min(60.0, BITS_SCALE * 8.0 * gap))), gap < max(1.0, MARGIN * sizes[best])


def classify(rows: DataFrame, dictionaries: dict[str, bytes], text_col: str = "text") -> DataFrame:
    """``rows`` with ``lang_pred``, ``score`` and ``rejected``; their text and other columns stay."""
    schema = rows.drop("lang_pred", "score", "rejected")
    names = schema.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(dictionaries)
        for batch in batches:
            found = [model.decide(t.as_py()) for t in batch.column(batch.schema.get_field_index(text_col))]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            more = [pa.array([f[i] for f in found], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*names, "lang_pred", "score", "rejected"])

    kept = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.schema.fields)
    return schema.mapInArrow(run, f"{kept}, lang_pred string, score double, rejected boolean")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    dictionaries = fit(docs)
    rows = classify(docs.select("doc_id", "text"), dictionaries)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")
