"""Removal of byte strings that occur twice, by a distributed merge sort of suffixes.

A sparse suffix array is enough: of the ``GRAM``-byte grams in every window of ``LENGTH`` bytes
the leftmost least by hash is the window's anchor, a function of the window's bytes alone, so
two equal windows have anchors with equal grams at equal places. Suffixes are sorted at
anchors only, about one position in 180, and only where the anchor's gram occurs again.

Sorting. Each map task sorts its suffixes into runs, cuts them at ``LENGTH`` bytes and
front-codes them: a suffix is sent as the length it has in common with the one before, and
the rest. Keys begin with an evenly spread hash of the gram and buckets are equal ranges of
it, so that the order is total over all buckets. A loser tree merges the runs of a bucket;
each head carries the length it has in common with the last output, two heads are compared
from there on, and only where these lengths are equal, so that no known prefix is compared
again. The merge yields the common-prefix array with the order.

Matching. With each suffix goes the reversed text to its left. Among the suffixes of a gram,
intervals of the array are united by falling common prefix; where two meet, each suffix of
the smaller is looked up among the reversed texts of the larger. A pair with f common bytes
to the right and b to the left, f + b >= LENGTH, marks that stretch in both.

Around a gram with over ``HOT`` suffixes every window is a suffix of its own, and counting
takes the place of gathering, so that no task holds what a gram of a third of all documents
gathers. Windows are taken ``STEP`` at a time: those that begin within ``STEP`` bytes lie in
one region and share its middle. A region that occurs twice repeats wholly; of equal regions
one goes on. Only regions whose middle occurs in another region too can share a window with
it; their windows are sorted one by one. Regions, middles and windows are told by 128-bit
digests of their bytes. The result is the same.

Semantics
* Bytes are those of the UTF-8 text; null is the empty text. A byte goes if any ``LENGTH``-byte
  string over it starts elsewhere in the input, the same document included; overlaps count.
  Matches never cross documents. Every row is a document, repeated rows and ids too.
* ``n_spans`` counts maximal removed runs. Other columns are ignored. An empty table gives no
  rows.
"""

from __future__ import annotations

import bisect
import marshal
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import BYTE_VALUES, PLACES, _powers, buffers, mix, signed, sliding_argmin, slices
from .work import discard, key_and_text, materialize

LENGTH = 400
GRAM = 32
HOT = 50_000
#: Windows around a hot gram that are told by one region.
STEP = 23
CHUNK = 1 << 18
#: A map task's suffixes are sorted and sent when they come to this many.
RUN_ITEMS = 30_000
#: Suffixes that a bucket holds on average: with their contexts, about 30 MB in the task that merges them.
#: No gram adds more than HOT to it.
BUCKET_ITEMS = 40_000
NO_ID = -(2**63)


# --- anchors ----------------------------------------------------------------------------


def _gram_hashes(data: np.ndarray, width: int, salt: int = 0) -> np.ndarray:
    """Hashes of the ``width`` bytes from each byte on."""
    with np.errstate(over="ignore"):
        up, down = _powers(CHUNK + 4 * LENGTH)
        values = BYTE_VALUES if not salt else mix(BYTE_VALUES ^ PLACES[salt])
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(values[data] * up[: len(data)], out=total[1:])
        return mix((total[width:] - total[:-width]) * down[: len(data) - width + 1])


def byte_anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of all windows that lie within a row."""
    places, hashes = [], []
    for c in range(0, len(data) - length + 1, CHUNK):
        hi = min(len(data) - length + 1, c + CHUNK)
        grams = _gram_hashes(data[c : hi + length - 1], gram)
        anchor = sliding_argmin(grams, length - gram + 1)
        cross = np.zeros(hi - c + 1, np.int32)
        near = offsets[(offsets > c) & (offsets < hi + length - 1)]
        np.add.at(cross, np.maximum(near - length + 1, c) - c, 1)
        np.add.at(cross, np.minimum(near, hi) - c, -1)
        found = np.unique(anchor[np.cumsum(cross[:-1]) == 0])
        places.append(found + c)
        hashes.append(grams[found])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(hashes)[first]


def _seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, sums = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        for lo, _, data, offsets in slices(batch.column(2)):
            place, gram = byte_anchors(data, offsets)
            if len(place):
                row = np.searchsorted(offsets, place, "right") - 1
                gram = mix(gram)  # anchors have low hashes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram)), pa.array(ids[lo + row]), pa.array(sums[lo + row]), pa.array((place - offsets[row]).astype(np.int64))], ["gram", "id", "sum", "place"]
                )


# --- runs -------------------------------------------------------------------------------


def common(a: bytes, b: bytes, since: int = 0) -> int:
    """Length of the common prefix, known to be ``since`` at least."""
    n = min(len(a), len(b))
    step = 16
    while since < n:
        end = min(n, since + step)
        x, y = a[since:end], b[since:end]
        if x != y:
            return end - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8
        since, step = end, step * 4
    return n


def encode_run(items: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Sorted (key, left, id, sum, place) as a compressed front-coded run."""
    import zstandard

    shared, rests, before = [], [], b""
    for item in items:
        h = common(before, item[0])
        shared.append(h)
        rests.append(item[0][h:])
        before = item[0]
    lefts = [x[1] for x in items]
    numbers = np.array([x[2:] for x in items], np.int64)
    small = np.array([shared, [len(x) for x in rests], [len(x) for x in lefts]], np.uint16)
    return zstandard.ZstdCompressor(level=3).compress(marshal.dumps((len(items), small.tobytes(), numbers.tobytes(), b"".join(rests), b"".join(lefts))))


def decode_run(blob: bytes) -> Iterator[tuple[bytes, int, bytes, tuple[int, int, int]]]:
    """(key, length in common with the key before, left, (id, sum, place)) in order."""
    import zstandard

    n, small, numbers, rest, left = marshal.loads(zstandard.ZstdDecompressor().decompress(blob))
    shared, rests, lefts = np.frombuffer(small, np.uint16).reshape(3, n).tolist()
    owner = np.frombuffer(numbers, np.int64).reshape(n, 3).tolist()
    key, r, at = b"", 0, 0
    for i in range(n):
        key = key[: shared[i]] + rest[r : r + rests[i]]
        r += rests[i]
        yield key, shared[i], left[at : at + lefts[i]], tuple(owner[i])
        at += lefts[i]


def merge_runs(runs: list[Iterator]) -> Iterator[tuple[bytes, int, bytes, tuple[int, int, int]]]:
    """Loser tree over sorted runs; yields what the runs hold, with the length in common with the output before."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [next(r, None) for r in runs] + [None] * (k - len(runs))
    shared = [0] * k
    losers = [0] * k

    def wins(i: int, j: int) -> bool:
        """Whether head i comes before head j; both lengths are with the last output, after it the loser's with the winner."""
        a, b = heads[i], heads[j]
        if a is None or b is None:
            return b is None
        if shared[i] != shared[j]:
            return shared[i] > shared[j]
        h = common(a[0], b[0], shared[i])
        first = h == len(a[0]) or (h < len(b[0]) and a[0][h] < b[0][h])
        shared[j if first else i] = h
        return first

    def build(node: int) -> int:
        if node >= k:
            return node - k
        i, j = build(2 * node), build(2 * node + 1)
        winner, losers[node] = (i, j) if wins(i, j) else (j, i)
        return winner

    top = build(1) if k > 1 else 0
    while heads[top] is not None:
        key, _, left, owner = heads[top]
        yield key, shared[top], left, owner
        heads[top] = head = next(runs[top], None)
        shared[top] = head[1] if head else 0
        node = (top + k) // 2
        while node:
            if not wins(top, losers[node]):
                top, losers[node] = losers[node], top
            node //= 2


# --- matching ---------------------------------------------------------------------------


def match_group(items: list[tuple[int, bytes, tuple[int, int, int], int]], length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """Repeated stretches (id, sum, start, end) among the sorted suffixes of one gram.

    items: (common prefix with the one before, reversed left, owner, own length).
    """
    # Suffixes with the same text on both sides are one; all of them repeat wholly.
    unique: list[tuple[int, bytes, tuple[int, int, int], int]] = []
    block: dict[bytes, list] = {}
    since = 0

    def close() -> Iterator[tuple[int, int, int, int]]:
        for left, owners in block.items():
            if len(owners) > 1 and owners[0][1] + len(left) >= length:
                for owner, size in owners:
                    yield owner[0], owner[1], owner[2] - len(left), owner[2] + size

    before = -1
    for shared, left, owner, size in items:
        if not (shared == size == before):
            yield from close()
            block, since = {}, shared
        else:
            since = min(since, shared)
        before = size
        if left in block:
            block[left].append((owner, size))
        else:
            unique.append((shared if not block else size, left, owner, size))
            block[left] = [(owner, size)]
    yield from close()
    m = len(unique)
    if m == 1:
        return
    if m == 2:
        f, b = unique[1][0], common(unique[0][1], unique[1][1])
        if f + b >= length:
            for _, _, owner, _ in unique:
                yield owner[0], owner[1], owner[2] - b, owner[2] + f
        return
    parent = list(range(m))
    sorted_lefts: list[list[tuple[bytes, int]]] = [[(x[1], i)] for i, x in enumerate(unique)]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sorted(range(1, m), key=lambda i: -unique[i][0]):
        f = unique[i][0]
        a, b = find(i - 1), find(i)
        if len(sorted_lefts[a]) < len(sorted_lefts[b]):
            a, b = b, a
        parent[b] = a
        if f + LENGTH - GRAM < length:  # no text to the left can make up for it
            break
        large = sorted_lefts[a]
        for left, x in sorted_lefts[b]:
            at = bisect.bisect_left(large, (left, x))
            best = 0
            for j in (at - 1, at):
                if 0 <= j < len(large):
                    both = common(left, large[j][0])
                    best = max(best, both)
                    if f + both >= length:
                        owner = unique[large[j][1]][2]
                        yield owner[0], owner[1], owner[2] - both, owner[2] + f
            if f + best >= length:
                owner = unique[x][2]
                yield owner[0], owner[1], owner[2] - best, owner[2] + f
            large.insert(at, (left, x))
        sorted_lefts[b] = []


# --- Spark ------------------------------------------------------------------------------


def _runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes, bytes, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            held.sort()
            out, lo = [], 0
            while lo < len(held):
                hi = bisect.bisect_left(held, (held[lo][0] + 1,), lo)
                out.append((held[lo][0], encode_run([x[1:] for x in held[lo:hi]])))
                lo = hi
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["bucket", "run"])

        for batch in batches:
            data, at = buffers(batch.column(2))
            for i in range(batch.num_rows):
                start, end = int(at[i]), int(at[i + 1])
                owner = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                for seed in batch.column(3)[i].as_py():
                    place = start + seed["place"]
                    key = seed["gram"].to_bytes(8, "big", signed=True) + data[place : min(end, place + LENGTH)].tobytes()
                    left = data[max(start, place - LENGTH + GRAM) : place][::-1].tobytes()
                    held.append(((seed["gram"] % 2**64) * buckets >> 64, key, left, *owner, seed["place"]))
                    if len(held) >= RUN_ITEMS:
                        yield flush()
        if held:
            yield flush()

    return run


def _spans(rows: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    a = np.array(rows, np.int64).reshape(-1, 4)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(a[:, i])) for i in range(4)], ["id", "sum", "start", "end"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of a partition merged, grams matched one after another."""
    runs = [decode_run(x.as_py()) for batch in batches for x in batch.column(1)]
    out: list[tuple[int, int, int, int]] = []
    group: list[tuple[int, bytes, tuple[int, int, int], int]] = []
    for key, shared, left, owner in merge_runs(runs):
        if shared < 8 and group:
            if len(group) > 1:
                out.extend(match_group(group))
            group = []
            if len(out) > 50_000:
                yield _spans(out)
                out = []
        group.append((max(0, shared - 8), left, owner, len(key) - 8))
    if len(group) > 1:
        out.extend(match_group(group))
    if out:
        yield _spans(out)


def _parts(batch: pa.RecordBatch, begins) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[pa.Array]]]:
    """Bytes, places in them, places in the text and owner columns, piece by piece, for what ``begins(i, size)`` asks of text i."""
    data, at = buffers(batch.column(2))
    for i in range(batch.num_rows):
        start, end = int(at[i]), int(at[i + 1])
        wanted = begins(i, end - start)
        for lo in range(0, end - start, CHUNK):
            here = wanted[(wanted >= lo) & (wanted < lo + CHUNK)]
            if len(here):
                base = max(0, lo - STEP)
                part = data[start + base : min(end, start + lo + CHUNK + LENGTH)]
                yield part, here - base, here, [pa.array([batch.column(c)[i].as_py()] * len(here), pa.int64()) for c in (0, 1)]


def _regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the regions around the hot seeds of a document, and of their middles."""
    narrow = LENGTH - STEP + 1
    shifts = np.arange(0, LENGTH - GRAM + 1, STEP)

    for batch in batches:

        def middles(i: int, size: int, batch: pa.RecordBatch = batch) -> np.ndarray:
            found = np.unique((np.array(batch.column(3)[i].as_py(), np.int64)[:, None] - shifts).ravel())
            found = found[(found >= 0) & (found + narrow <= size)]
            # What lies before and behind, as far as the text goes, has to hold a window.
            return found[np.minimum(found + LENGTH, size) - np.maximum(found - STEP + 1, 0) >= LENGTH]

        for part, local, here, owner in _parts(batch, middles):
            # A piece begins at least STEP bytes before its places, or with the text; it ends LENGTH behind, or with the text.
            first, last = np.maximum(local - STEP + 1, 0), np.minimum(local + LENGTH, len(part)) - LENGTH
            size = (last + LENGTH - first).astype(np.uint64)
            columns = []
            for salt in (0, 30):
                whole, middle = _gram_hashes(part, LENGTH, salt), _gram_hashes(part, narrow, salt)[local]
                with np.errstate(over="ignore"):
                    region = mix(whole[first] + mix(whole[last] + mix(middle + size)))
                columns += [pa.array(signed(region)), pa.array(signed(middle))]
            r1, n1, r2, n2 = columns
            yield pa.RecordBatch.from_arrays(
                [r1, r2, n1, n2, *owner, pa.array(here - local + first), pa.array(here - local + last + LENGTH)], ["r1", "r2", "n1", "n2", "id", "sum", "start", "end"]
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of all windows in the regions of a document."""
    for batch in batches:

        def windows(i: int, _: int, batch: pa.RecordBatch = batch) -> np.ndarray:
            return np.unique(np.concatenate([np.arange(r["start"], r["end"] - LENGTH + 1, dtype=np.int64) for r in batch.column(3)[i].as_py()]))

        for part, local, here, owner in _parts(batch, windows):
            d1, d2 = (_gram_hashes(part, LENGTH, salt)[local] for salt in (0, 30))
            yield pa.RecordBatch.from_arrays([pa.array(signed(d1)), pa.array(signed(d2)), *owner, pa.array(here)], ["d1", "d2", "id", "sum", "start"])


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows told apart by id and text, so that equal rows share their spans and others don't."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("sum"), text.alias("text"))


def _hot_repeats(texts: DataFrame, hot: DataFrame) -> DataFrame:
    """``id, sum, start, end``: stretches around hot grams that repeat."""
    spans = ["id", "sum", "start", "end"]
    schema = "r1 long, r2 long, n1 long, n2 long, id long, sum long, start long, end long"
    regions = materialize(texts.join(hot, ["id", "sum"]).select("id", "sum", "text", "hot").mapInArrow(_regions, schema), "hot-regions")
    # All of `first` are of one row.
    kinds = regions.groupBy("r1", "r2").agg(F.count("*").alias("n"), *[F.first(c).alias(c) for c in ("n1", "n2", *spans)])
    kinds = materialize(kinds, "region-kinds")
    whole = materialize(kinds.filter("n > 1").select("r1", "r2"), "repeated-regions")
    found = regions.join(whole, ["r1", "r2"]).select(*spans)
    middles = materialize(kinds.groupBy("n1", "n2").agg(F.count("*").alias("n")).filter("n > 1").select("n1", "n2"), "repeated-middles")
    edges = kinds.join(middles, ["n1", "n2"]).groupBy("id", "sum").agg(F.collect_list(F.struct("start", "end")).alias("regions"))
    edges = materialize(edges, "document-regions")
    discard(kinds, middles)
    windows = texts.join(edges, ["id", "sum"]).select("id", "sum", "text", "regions").mapInArrow(_digests, "d1 long, d2 long, id long, sum long, start long")
    windows = materialize(windows, "hot-windows")
    # A window may be told twice of one place, by equal rows: their regions repeat, so places are compared, not counted.
    places = [f(c).alias(f"{f.__name__}_{c}") for c in ("id", "sum", "start") for f in (F.min, F.max)]
    twice = windows.groupBy("d1", "d2").agg(*places).filter("min_id < max_id or min_sum < max_sum or min_start < max_start").select("d1", "d2")
    twice = materialize(twice, "repeated-windows")
    discard(edges)
    return found.unionByName(windows.join(twice, ["d1", "d2"]).select("id", "sum", "start", (F.col("start") + LENGTH).alias("end")))


def repeats(keyed: DataFrame) -> DataFrame:
    """``id, sum, start, end``: stretches of bytes that repeat; they may overlap."""
    spark = keyed.sparkSession
    texts = keyed.select("id", "sum", "text")
    seeds = materialize(texts.mapInArrow(_seeds, "gram long, id long, sum long, place long"), "suffix-seeds")
    several = materialize(seeds.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1"), "repeated-grams")
    marked = seeds.join(several, "gram")
    each = F.struct("gram", "place")
    listed = marked.groupBy("id", "sum").agg(
        F.collect_set(F.when(F.col("n") <= HOT, each)).alias("seeds"), F.collect_set(F.when(F.col("n") > HOT, F.col("place"))).alias("hot")
    )
    listed = materialize(listed, "document-suffixes")
    discard(seeds, several)
    sized = listed.agg(F.sum(F.size("seeds"))).first()[0] or 0
    # A merge holds the runs of its bucket: as many buckets as keep that bounded, whatever the input's size.
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sized // BUCKET_ITEMS))
    sorting = texts.join(listed.filter(F.size("seeds") > 0), ["id", "sum"]).select("id", "sum", "text", "seeds")
    runs = sorting.mapInArrow(_runs(buckets), "bucket int, run binary")
    span = "id long, sum long, start long, end long"
    found = runs.repartitionById(buckets, "bucket").mapInArrow(_merge, span)
    hot = listed.filter(F.size("hot") > 0).select("id", "sum", "hot")
    if not hot.isEmpty():
        found = found.unionByName(_hot_repeats(texts, hot))
    return found


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, spans = batch.column(1), batch.column(2)
        n_bytes, n_removed, n_spans, kept = [], [], [], []
        for i in range(batch.num_rows):
            data, found = texts[i].as_py().encode(), spans[i].as_py()
            parts, upto, removed, runs = [], 0, 0, 0
            for lo, hi in sorted((s["start"], s["end"]) for s in found or ()):
                if hi <= upto:
                    continue
                if lo > upto or not runs:
                    runs += 1
                    parts.append(data[upto:lo])
                    upto = max(upto, lo)
                removed += hi - upto
                upto = hi
            parts.append(data[upto:])
            n_bytes.append(len(data))
            n_removed.append(removed)
            n_spans.append(runs)
            kept.append(b"".join(parts))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
        )


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (bytes) for every row."""
    keyed = _keyed(key_and_text(docs, id_col, text_col))
    found = repeats(keyed)
    spans = materialize(found.distinct().groupBy("id", "sum").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "repeated-bytes")
    joined = keyed.join(spans, ["id", "sum"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
