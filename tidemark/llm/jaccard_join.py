"""Near-duplicate join on word 5-grams at Jaccard 0.75 or more: grouped prefix join.

A document's set is its distinct shingles. Documents with equal sets are one node. Under any
order of all shingles, two sets that are similar enough share one in their prefixes, the
first n - ceil(0.75 n) + 1 shingles. Rarest first is the order that makes prefixes meet least:
a prefix is a quarter of a set, so a document that is mostly its own meets nothing.

Counting every shingle of the corpus would move the corpus several times, so rarity comes in
two steps, each exact for what it claims. Three eighths of the shingle space are counted over all
nodes; the order is then shingles counted once, shingles not counted, shingles counted
more often. A node whose prefix is all of the first kind has no partner and is done, without another
look at its text, and so is a node whose prefix meets no other prefix. Among the nodes left, all
shingles are counted, and prefixes are cut by true rarity.

Grouped join: nodes with the same prefix and size make one group, and only groups emit prefix
shingles. Groups that share one make a group pair, filtered by size and by what the positions still
allow. The pairs that pass are expanded to their members, thinned out by parity sketches, and
verified on the whole sets.

The result is components, so pairs that are connected already need no check. That is used to
keep a large group of near copies from costing a square: the members of a group are verified
against its first one, and each group against two heads of each shared shingle and size band; then
groups are split by the components found, and every group pair of different components goes
through the same filters, expansion and verification. Shingles in very many groups are cut into
blocks, and pairs of blocks are handled by different tasks.

Semantics
* Words are runs of other than space and U+0009 to U+000D, after lower-casing A-Z. With
  fewer than 5 words the whole sequence is the only shingle; without words, or with a null
  text, the set is empty and linked with nothing.
* Shingles are compared by 64-bit hashes. Rows that repeat a doc_id count as one document
  with each of their texts: what is linked with one of them is linked with all, and
  ``n_shingles`` is each row's own. A null doc_id is linked with nothing and its component is null.
* Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .tokens import PLACES, Words, mix, signed, slices
from .work import discard, key_and_text, materialize

SHINGLE = 5
#: Similarity as a fraction: 100 * intersection >= 75 * union.
NUMERATOR, DENOMINATOR = 75, 100
#: Shingles whose hash is below this have their documents counted. A prefix is a quarter of a set, so
#: with three eighths counted the unshared ones among them fill the prefix of nearly every node of its own.
COUNTED_BELOW = np.uint64(3 << 61)
#: Rows of a slice: row and the upper bits of a shingle fit one sortable number.
ROW_BITS = 12
SLICE_ROWS = 1 << ROW_BITS
#: Bits of a parity sketch.
SKETCH = 1024
WORDS = SKETCH // 64
#: A shingle with more nodes is joined with itself in blocks of about this size.
BLOCK = 500


class _Sets:
    """Distinct shingles of a slice's rows, sorted by row and hash; ``first``: n + 1 bounds."""

    __slots__ = ("row", "hash", "first")

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, lower=True)
        grams, whole = words.grams(SHINGLE)
        at = np.flatnonzero(whole)
        n_words = np.diff(words.first)
        short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
        with np.errstate(over="ignore"):
            sums = np.zeros(len(short), np.uint64)
            for j in range(SHINGLE - 1):
                has = n_words[short] > j
                sums[has] += words.hash[words.first[short][has] + j] * PLACES[j + 8]
            few = mix(sums + n_words[short].astype(np.uint64))
        row, value = np.concatenate([words.row[at], short]), np.concatenate([grams[at], few])
        order = np.argsort(_packed(row, value))
        row, value = row[order], value[order]
        if np.any((row[1:] == row[:-1]) & (value[1:] < value[:-1])):  # the bits that didn't fit decide
            order = np.lexsort((value, row))
            row, value = row[order], value[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        self.row, self.hash = row[new].astype(np.int64), value[new]
        self.first = np.searchsorted(self.row, np.arange(len(offsets)))


def _packed(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    return row.astype(np.uint64) << np.uint64(64 - ROW_BITS) | value >> np.uint64(ROW_BITS)


def _sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of the runs that ``first`` bounds."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _digests(first: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        return tuple(mix(_sum_by(first, mix(values ^ PLACES[k])) + np.diff(first).astype(np.uint64)) for k in (20, 21))


def _lists(first: np.ndarray, values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(signed(values)))


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Size, digest and counted shingles of every row of ``doc_id, sum, text``."""
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(2), rows=SLICE_ROWS):
            s = _Sets(data, offsets)
            d1, d2 = _digests(s.first, s.hash)
            counted = s.hash < COUNTED_BELOW
            bounds = np.append(0, np.cumsum(counted))[s.first]
            head = [batch.column(k).slice(lo, hi - lo) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(
                [*head, pa.array(np.diff(s.first).astype(np.int64)), pa.array(signed(d1)), pa.array(signed(d2)), _lists(bounds, s.hash[counted])], ["doc_id", "sum", "n", "d1", "d2", "counted"]
            )


def _need(n: np.ndarray) -> np.ndarray:
    """The least intersection of a set of n with any set similar enough."""
    return (n * NUMERATOR + DENOMINATOR - 1) // DENOMINATOR


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, node) for what of a node's prefix can be in other nodes.

    The third and fourth columns list the counted shingles of the node that others have too,
    and in how many nodes they are.
    """
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        ends = batch.column(2).offsets.to_numpy()
        known = batch.column(2).values.to_numpy(zero_copy_only=False).view(np.uint64)
        times = batch.column(3).values.to_numpy(zero_copy_only=False)
        for lo, hi, data, offsets in slices(batch.column(1), rows=SLICE_ROWS):
            s = _Sets(data, offsets)
            need = _need(np.diff(s.first))
            rank = np.where(s.hash < COUNTED_BELOW, 0, 1).astype(np.uint16)
            of_row = np.repeat(np.arange(hi - lo), np.diff(ends[lo : hi + 1]))
            value, count = known[ends[lo] : ends[hi]], np.minimum(times[ends[lo] : ends[hi]], 65_535)
            if len(value):
                order = np.lexsort((value, of_row))
                value, count, keys = value[order], count[order], _packed(of_row, value)[order]
                own = _packed(s.row, s.hash)
                at = np.searchsorted(keys, own)
                # Several shingles of a row may agree in the bits that fit.
                for step in range(int(np.unique(keys, return_counts=True)[1].max())):
                    k = np.minimum(at + step, len(keys) - 1)
                    hit = (keys[k] == own) & (value[k] == s.hash)
                    rank[hit] = count[k[hit]]
            # By row, then rank, then hash: both sorts are stable, and what they sort is ordered by hash.
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(s.row[order].astype(np.uint16), kind="stable")]
            value, rank = s.hash[order], rank[order]
            place = np.arange(len(value)) - s.first[s.row]
            meets = (place < (np.diff(s.first) - need + 1)[s.row]) & (rank > 0)
            yield pa.RecordBatch.from_arrays([pa.array(signed(value[meets])), pa.array(ids[lo + s.row[meets]])], ["token", "node"])


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole sets, each with its parity sketch: SKETCH bits, each the parity of the shingles dealt to it.

    The bits in which two sketches differ are at most as many as the shingles in which the sets do.
    """
    for batch in batches:
        for lo, hi, data, offsets in slices(batch.column(1), rows=SLICE_ROWS):
            s = _Sets(data, offsets)
            bit = mix(s.hash) & np.uint64(SKETCH - 1)
            parity = np.zeros((hi - lo, SKETCH), np.uint8)
            np.add.at(parity, (s.row, bit.astype(np.int64)), 1)  # modulo 256, which keeps the parity
            packed = np.packbits(parity & 1, axis=1)
            sketches = _lists(np.arange(hi - lo + 1) * WORDS, packed.reshape(-1).view(np.uint64))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), _lists(s.first, s.hash), sketches], ["node", "tokens", "sketch"])


def _may_link(n1, place1, n2, place2):
    """Size and position bounds at a shared shingle: of what follows it, enough must remain."""
    rest = F.least(n1 - place1, n2 - place2)
    return rest * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n1 + n2)


def _near(n1, sketch1, n2, sketch2):
    """Sets that are similar enough differ in at most so many shingles, and their sketches in at most as many bits."""
    both = n1 + n2
    differ = F.aggregate(F.zip_with(sketch1, sketch2, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, x: acc + x)
    return differ <= both - 2 * F.ceil(NUMERATOR * both / (NUMERATOR + DENOMINATOR))


def _verify(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Of the pairs ``a, b`` those that are similar enough: by sketches first, then on whole sets."""
    side = lambda c: sets.select(F.col("node").alias(c), F.size("tokens").alias(f"n{c}"), F.col("sketch").alias(f"s{c}"))
    thin = pairs.join(side("a"), "a").join(side("b"), "b").filter(_near(F.col("na"), F.col("sa"), F.col("nb"), F.col("sb"))).select("a", "b")
    thin = materialize(thin, f"{name}-near")
    whole = lambda c: sets.select(F.col("node").alias(c), F.col("tokens").alias(f"t{c}"))
    both = thin.join(whole("a"), "a").join(whole("b"), "b").withColumn("shared", F.size(F.array_intersect("ta", "tb")))
    union = F.size("ta") + F.size("tb") - F.col("shared")
    found = materialize(both.filter(DENOMINATOR * F.col("shared") >= NUMERATOR * union).select("a", "b"), name)
    discard(thin)
    return found


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Group pairs of different components within runs of one (token, side, side) that pass the bounds.

    The bounds are of size and position, and, where both have one member, of the parity sketches: sets
    that are similar enough differ in at most so many shingles. They never drop a link.
    """
    held: list[np.ndarray] | None = None

    def pairs(run: list[np.ndarray]) -> pa.RecordBatch:
        _, one, two, block, node, n, place, component, alone, sketch = run
        a_at = np.flatnonzero(block == one)
        b_at = np.flatnonzero(block == two)
        out_a, out_b = [], []
        for k in range(0, len(a_at), 256):
            i, j = a_at[k : k + 256, None], b_at[None, :]
            rest = np.minimum(n[i] - place[i], n[j] - place[j])
            good = (component[i] != component[j]) & (rest * (NUMERATOR + DENOMINATOR) >= NUMERATOR * (n[i] + n[j]))
            x, y = np.nonzero(good)
            x, y = a_at[k + x], b_at[y]
            both = n[x] + n[y]
            shared = -(-NUMERATOR * both // (NUMERATOR + DENOMINATOR))
            near = ~(alone[x] & alone[y]) | (np.bitwise_count(sketch[x] ^ sketch[y]).sum(1) <= both - 2 * shared)
            a, b = node[x[near]], node[y[near]]
            out_a.append(np.maximum(a, b))
            out_b.append(np.minimum(a, b))
        a, b = np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])
        found = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:9]]
        columns.append(batch.column(9).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, WORDS))
        if held is not None:
            columns = [np.concatenate(x) for x in zip(held, columns, strict=True)]
        key = np.stack(columns[:3])
        cuts = np.flatnonzero(np.any(key[:, 1:] != key[:, :-1], axis=0)) + 1
        bounds = [0, *cuts.tolist(), key.shape[1]]
        for lo, hi in zip(bounds[:-2], bounds[1:-1], strict=True):
            run = [c[lo:hi] for c in columns]
            if len(run[7]) > 1 and (run[7] != run[7][0]).any():
                yield pairs(run)
        held = [c[bounds[-2] :] for c in columns]
    if held is not None and len(held[7]) > 1 and (held[7] != held[7][0]).any():
        yield pairs(held)


def _prefix_length(n):
    return n - F.ceil(n * NUMERATOR / DENOMINATOR) + 1


def _suspects(docs: DataFrame, leads: DataFrame) -> DataFrame:
    """Step one: ``node, doc_id, sum`` of the nodes whose prefix under the partly counted order meets another's."""
    tokens = leads.select("node", F.explode("counted").alias("token"))
    several = materialize(tokens.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1"), "counted-shingles")
    listed = tokens.join(several, "token").groupBy("node").agg(F.collect_list(F.struct("token", (F.col("times") + 1).alias("times"))).alias("l"))
    shared = materialize(listed.select("node", F.col("l.token").alias("tokens"), F.col("l.times").alias("times")), "shared-shingles")
    discard(several)
    none = F.array().cast("array<bigint>")
    every = leads.select("node", "doc_id", "sum", "n", F.size("counted").alias("counted")).join(shared, "node", "left")
    # A prefix of unshared shingles meets nothing.
    open_ = every.filter(F.col("counted") - F.coalesce(F.size("tokens"), F.lit(0)) < _prefix_length(F.col("n")))
    open_ = open_.select("node", "doc_id", "sum", F.coalesce("tokens", none).alias("tokens"), F.coalesce("times", none).alias("times"))
    rows = docs.join(open_, ["doc_id", "sum"]).select("node", "text", "tokens", "times").mapInArrow(_prefixes, "token long, node long")
    prefixes = materialize(rows, "prefixes")
    met = materialize(prefixes.groupBy("token").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("token"), "met-shingles")
    found = prefixes.join(met, "token").select("node").distinct()
    found = materialize(leads.select("node", "doc_id", "sum").join(found, "node", "left_semi"), "suspects")
    discard(leads, shared, prefixes, met)
    return found


def _groups(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Step two: (``grp, n, token, place``) of the prefixes by true rarity that meet, and (``grp, node``).

    A node's shingles that no other has come first in its order and need no row. Nodes of the
    same prefix and size are one group, named by one of them.
    """
    tokens = sets.select("node", F.explode("tokens").alias("token"))
    times = materialize(tokens.groupBy("token").agg(F.count("*").alias("times")).filter("times > 1"), "counted-shingles")
    listed = tokens.join(times, "token").groupBy("node").agg(F.collect_list(F.struct("times", "token")).alias("l"))
    sized = listed.join(sets.select("node", F.size("tokens").alias("n")), "node")
    own = F.col("n") - F.size("l")
    length = _prefix_length(F.col("n")).cast("int")
    cut = sized.select("node", "n", own.alias("own"), F.slice(F.array_sort("l"), 1, F.greatest(length - own, F.lit(0)))["token"].alias("prefix")).filter(F.size("prefix") > 0)
    # Own shingles tell a prefix apart from every other.
    same = F.xxhash64("n", F.when(F.col("own") > 0, F.col("node")), "prefix")
    keyed = materialize(cut.select("node", "n", "own", "prefix", same.alias("p1"), F.xxhash64(F.lit(1), same, "prefix").alias("p2")), "prefixes-by-rarity")
    groups = materialize(keyed.groupBy("n", "p1", "p2").agg(F.min("node").alias("grp"), F.count("*").alias("members")), "prefix-groups")
    of_group = materialize(keyed.select("node", "n", "p1", "p2").join(groups, ["n", "p1", "p2"]).select("grp", "node"), "group-nodes")
    lead = keyed.join(groups.select(F.col("grp").alias("node"), "members"), "node")
    rows = lead.select(F.col("node").alias("grp"), "n", "members", F.col("own"), F.posexplode("prefix").alias("i", "token"))
    rows = rows.select("grp", F.col("n").cast("long").alias("n"), "members", "token", (F.col("own") + F.col("i")).cast("long").alias("place"))
    often = materialize(rows.groupBy("token").agg(F.sum("members").alias("k")).filter("k > 1").select("token"), "often-shingles")
    found = materialize(rows.join(often, "token").select("grp", "n", "token", "place"), "meeting-shingles")
    discard(keyed, groups, times, often)
    return found, of_group


def _first_pairs(meeting: DataFrame, of_group: DataFrame) -> DataFrame:
    """``a, b``: members with the first one of their group, and groups with two heads of each shingle and size band.

    Where a shared shingle comes early in a group's order, little of it is its own: the earliest is
    the most central one.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR))).alias("band")
    banded = meeting.select("token", "grp", "n", "place", band)
    heads = banded.groupBy("token", "band").agg(
        F.min_by(F.struct("grp", "n", "place"), F.struct("place", "grp")).alias("central"), F.min(F.struct("grp", "n", "place")).alias("low"), F.count("*").alias("k")
    ).filter("k > 1")
    heads = materialize(heads, "heads")
    headed = banded.join(heads, ["token", "band"]).select("grp", "n", "place", F.explode(F.array("central", "low")).alias("h"))
    pairs = headed.filter(F.col("grp") != F.col("h.grp")).filter(_may_link(F.col("n"), F.col("place"), F.col("h.n"), F.col("h.place")))
    pairs = pairs.select(F.greatest("grp", "h.grp").alias("a"), F.least("grp", "h.grp").alias("b"))
    inner = of_group.filter("node <> grp").select(F.greatest("grp", "node").alias("a"), F.least("grp", "node").alias("b"))
    return pairs.unionByName(inner).distinct()


def _remaining_pairs(meeting: DataFrame, of_group: DataFrame, found: DataFrame, sets: DataFrame) -> DataFrame:
    """``a, b``: members of all group pairs that pass the filters and are in different components.

    A group is split by components; the parts meet like groups, those of one group too.
    """
    member = of_group.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    parts = materialize(member.groupBy("grp", "component").agg(F.min("node").alias("part"), F.count("*").alias("members")), "group-parts")
    labelled = materialize(meeting.join(parts, "grp"), "labelled-shingles")
    split = labelled.groupBy("token").agg(F.min("component").alias("c1"), F.max("component").alias("c2"), F.count("*").alias("k")).filter("c1 <> c2")
    split = materialize(split.select("token", F.ceil(F.col("k") / F.lit(BLOCK)).cast("int").alias("blocks")), "open-shingles")
    rows = labelled.join(split, "token").withColumn("block", F.pmod(F.xxhash64("part"), F.col("blocks")).cast("int"))
    rows = rows.join(sets.select(F.col("node").alias("part"), "sketch"), "part").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("token", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "block", "part", "n", "place", "component", (F.col("members") == 1).alias("alone"), "sketch")
    dealt = rows.repartition("token", "one", "two").sortWithinPartitions("token", "one", "two")
    pairs = materialize(dealt.mapInArrow(_across, "a long, b long").distinct(), "group-pairs")
    of_part = member.join(parts, ["grp", "component"]).select("part", "node")
    side = lambda c: of_part.select(F.col("part").alias(c), F.col("node").alias(f"n{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))


def _same_document(real: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes that rows of one doc_id have."""
    again = real.groupBy("doc_id").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).filter("lo < hi").select("doc_id")
    each = real.select("doc_id", "d1", "d2", "n").join(again, "doc_id").join(nodes, ["d1", "d2", "n"]).select("doc_id", "node")
    return each.join(each.groupBy("doc_id").agg(F.min("node").alias("b")), "doc_id").filter("node <> b").select(F.col("node").alias("a"), "b")


def similar_components(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, sum`` for every row of ``doc_id, text``; ``sum`` is a hash of the text."""
    docs = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("sum"), "text")
    described = materialize(docs.mapInArrow(_describe, "doc_id long, sum long, n long, d1 long, d2 long, counted array<long>"), "shingle-sets")
    real = described.filter("n > 0 and doc_id is not null")
    # A node's number is any that no other has; the table fixes it.
    nodes = real.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("lead")).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "nodes")
    leads = real.join(nodes.withColumnRenamed("lead", "doc_id"), ["d1", "d2", "n", "doc_id"]).select("node", "doc_id", "sum", "n", "counted")
    leads = materialize(leads, "lead-shingles")
    members = materialize(described.select("doc_id", "sum", "n", "d1", "d2"), "members")
    discard(described)
    suspects = _suspects(docs, leads)
    whole = docs.join(suspects, ["doc_id", "sum"]).select("node", "text").mapInArrow(_whole_sets, "node long, tokens array<long>, sketch array<long>")
    sets = materialize(whole.dropDuplicates(["node"]), "whole-sets")
    discard(suspects)
    meeting, of_group = _groups(sets)
    links = _verify(_first_pairs(meeting, of_group), sets, "links-one")
    same = _same_document(members.filter("n > 0 and doc_id is not null"), nodes)
    found = materialize(connected_components(links.unionByName(same)), "components-one")
    more = _verify(_remaining_pairs(meeting, of_group, found, sets), sets, "links-two")
    label = lambda side: found.select(F.col("node").alias(side), F.col("component").alias(f"c{side}"))
    joined = more.join(label("a"), "a", "left").join(label("b"), "b", "left")
    merged = connected_components(joined.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    merged = materialize(merged.select(F.col("node").alias("component"), F.col("component").alias("final")), "components-two")
    named = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")).join(merged, "component", "left")
    named = materialize(named.select("d1", "d2", "n", "lead", F.coalesce("final", "component").alias("component")), "named-nodes")
    least = named.groupBy("component").agg(F.min("lead").alias("component_id"))
    names = materialize(named.join(least, "component").select("d1", "d2", "n", "component_id"), "component-names")
    discard(links, more, found, merged, named, meeting, of_group, sets)
    out = members.join(names, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "sum")


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, sum`` for every row; ``sum`` tells the texts of a repeated doc_id apart."""
    return similar_components(key_and_text(docs, id_col, text_col))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("sum")


OP5_SQL = r"""
WITH RECURSIVE dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s
       FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (SELECT doc_id, doc_id AS other FROM dw UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""
