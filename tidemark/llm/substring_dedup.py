"""Removal of word passages that an earlier document has: seed and extend.

Seeds are winnowed anchors: of the ``GRAM``-word grams in every window of ``WINDOW`` words
the leftmost least by hash. Equal windows have equal anchors at equal places, so each window
belongs to one anchor, and only anchors that two documents share can belong to a repeat.
Documents are joined on the anchors they share. From each a match is extended both ways as far as
windows around it have it as their anchor; beyond, the next anchor takes over. Where the whole
stretch is the same in an earlier document, word for word, it repeats as a whole; where documents
share a seed but not its surroundings, the windows over the seed, l words to the left of it and r
to the right, tell how far the match goes on either side. Adjacent repeats unite to maximal ones,
which are at least ``WINDOW`` words long by construction.

A seed's documents are never paired with each other: each is joined with the smallest doc_id that
has the same stretch or window, found by aggregations that combine before the shuffle. What is
joined is a table by then, so that adaptive execution can split a hot key of the large side. So a
passage in a third of all documents costs linear work.

Semantics
* Words are runs of other than space and U+0009 to U+000D, unchanged. A null or empty text
  has none. A window counts as repeated if it starts in a document with a smaller doc_id
  in the input; copies within one document don't count. Rows that repeat a doc_id are not
  smaller than each other, and each loses what its own text repeats. A row with a null doc_id takes no part and stays whole.
* Words decide; hashes only find the seeds.
* Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import PLACES, Words, mix, signed, slices, sliding_argmin
from .work import discard, key_and_text, materialize

WINDOW = 13
GRAM = 6


class _Windows:
    """Windows of a slice with their anchors."""

    def __init__(self, words: Words, window: int, gram: int):
        grams, _ = words.grams(gram)
        self.hash, whole = words.grams(window)
        anchor = sliding_argmin(grams, window - gram + 1)
        self.at = np.flatnonzero(whole)  # first words of windows within one row
        self.place = anchor[self.at]
        self.anchor = grams[self.place]
        self.row = words.row[self.at]


def _seeds(window: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, _, data, offsets in slices(batch.column(1)):
                w = _Windows(Words(data, offsets), window, gram)
                if len(w.at):
                    fresh = np.ones(len(w.place), bool)
                    fresh[1:] = w.place[1:] != w.place[:-1]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(w.anchor[fresh])), pa.array(ids[lo + w.row[fresh]].astype(np.int64))], ["anchor", "doc_id"])

    return run


def _blocks(window: int, gram: int):
    """Blocks of the anchors in the third column's lists, with their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 3))
            lists = batch.column(2)
            ends = lists.offsets.to_numpy()
            wanted = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            for lo, hi, data, offsets in slices(batch.column(1)):
                words = Words(data, offsets)
                w = _Windows(words, window, gram)
                with np.errstate(over="ignore"):
                    of_row = np.repeat(np.arange(hi - lo, dtype=np.uint64), np.diff(ends[lo : hi + 1]))
                    have = mix(wanted[ends[lo] : ends[hi]] + of_row * PLACES[0])
                    keep = np.isin(mix(w.anchor + w.row.astype(np.uint64) * PLACES[0]), have)
                at, place, anchor, row = w.at[keep], w.place[keep], w.anchor[keep], w.row[keep]
                if not len(at):
                    continue
                # A place anchors windows that follow each other: the seed reaches from the first to the last of them.
                new = np.ones(len(at), bool)
                new[1:] = place[1:] != place[:-1]
                first = np.flatnonzero(new)
                count = np.diff(np.append(first, len(at)))
                start, size = at[first], count - 1 + window
                raw = data.tobytes()
                texts = [b" ".join(raw[a:b].split()) for a, b in zip(words.start[start].tolist(), words.end[start + size - 1].tolist(), strict=True)]
                row = row[first]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(signed(anchor[first])), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(ids[lo + row].astype(np.int64)),
                        pa.array(keys[lo + row].astype(np.int64)), pa.array((start - words.first[row]).astype(np.int32)), pa.array(count.astype(np.int32)),
                    ],
                    ["anchor", "words", "doc_id", "text_hash", "start", "n"],
                )

    return run


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, text_hash, start, end`` in words: passages that start in a smaller doc_id; they may overlap."""
    docs = docs.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    seeds = materialize(docs.select("doc_id", "text").mapInArrow(_seeds(window, gram), "anchor long, doc_id long"), "seeds")
    shared = seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor")
    shared = materialize(shared, "shared-anchors")
    of_doc = materialize(seeds.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")), "document-seeds")
    discard(seeds, shared)
    blocks = materialize(
        docs.join(of_doc, "doc_id").select("doc_id", "text", "anchors", "text_hash").mapInArrow(_blocks(window, gram), "anchor long, words string, doc_id long, text_hash long, start int, n int"),
        "seed-blocks",
    )
    discard(of_doc)
    # Documents meet on a seed extended as far as it anchors windows, word for word.
    first = materialize(blocks.groupBy("anchor", "words").agg(F.min("doc_id").alias("first_doc")), "first-blocks")
    mixed = materialize(first.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1").select("anchor", F.lit(True).alias("mixed")), "mixed-anchors")
    marked = materialize(first.join(mixed, "anchor", "left"), "marked-blocks")
    discard(first, mixed)
    known = materialize(blocks.join(marked, ["anchor", "words"]).filter("first_doc < doc_id or mixed"), "known-blocks")
    discard(blocks, marked)
    whole = known.filter("first_doc < doc_id").select("doc_id", "text_hash", "start", (F.col("start") + F.col("n") - 1 + window).alias("end"))
    # Elsewhere the seed is the same and its surroundings differ: the match goes as far as l words to the
    # left and r to the right, and each (l, r) that makes a window is looked up among the seed's documents.
    # The words are split once: what a lambda holds is computed for each element.
    each = F.flatten(F.transform(F.array(F.split("words", " ")), lambda ws: F.transform(F.sequence(F.lit(1), F.size(ws) - (window - 1)), lambda i: F.array_join(F.slice(ws, i, window), " "))))
    partly = known.filter("first_doc = doc_id").select("anchor", "doc_id", "text_hash", "start", F.posexplode(each).alias("i", "w"))
    earliest = partly.groupBy("anchor", "w").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("anchor", "w", "lo")
    earliest = materialize(earliest, "earliest-windows")
    at = F.col("start") + F.col("i")
    part = partly.join(earliest, ["anchor", "w"]).filter("lo < doc_id").select("doc_id", "text_hash", at.alias("start"), (at + window).alias("end"))
    return whole.unionByName(part)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        kept, n_words, n_removed = [], [], []
        for i in range(len(texts)):
            text = texts[i].as_py()
            words = text.encode().split() if text else []
            n_words.append(len(words))
            found = spans[i].as_py()
            if found:
                cover = np.zeros(len(words) + 1, np.int32)
                for s in found:
                    cover[s["start"]] += 1
                    cover[s["end"]] -= 1
                stays = np.cumsum(cover[:-1]) == 0
                words = [w for w, k in zip(words, stays, strict=True) if k]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: kept words joined by a space, for every row."""
    rows = key_and_text(docs, id_col, text_col)
    found = repeats(rows, window, gram)
    spans = materialize(found.distinct().groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeated-passages")
    return rows.withColumn("text_hash", F.xxhash64("text")).join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(_apply, "doc_id long, n_words long, n_removed long, kept string")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP3_SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
pos AS (SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS t
        FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM dw WHERE len(w) >= 13)),
firsts AS (SELECT t, min(doc_id) AS d FROM pos GROUP BY t),
hit AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS k FROM pos JOIN firsts USING (t) WHERE d < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS k FROM dw),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS s FROM words ANTI JOIN hit USING (doc_id, k) GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM dw LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
