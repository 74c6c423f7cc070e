"""Copies, near copies, passages and byte strings against brute force, odd rows included."""

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, jaccard_join, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string"
CLASHES = ["digest", "keep_id", "hash", "node", "token", "start", "end", "id", "sum", "n", "row_id", "spans", "kept"]


def frame(spark, rows, parts=3):
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return df.select("*", *[F.lit(None).cast("string").alias(c) for c in CLASHES])


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def exact(df):
    return exact_dedup.exact_dedup(df, exact_dedup.DigestIndex(df.sparkSession, buckets=4)).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))


def substring(df):
    return substring_dedup.substring_dedup(df).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))


def suffix(df):
    return suffix_dedup.suffix_dedup(df).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))


def jaccard(df):
    return jaccard_join.jaccard_join(df).drop("sum")


OPERATORS = {"exact": (exact, brute.exact), "substring": (substring, brute.substring), "jaccard": (jaccard, brute.components), "suffix": (suffix, brute.suffixes)}


@pytest.mark.parametrize("name", OPERATORS)
def test_corpus(spark, name):
    ours, plain = OPERATORS[name]
    rows = brute.corpus()
    assert rows_of(ours(frame(spark, rows))) == sorted(plain(rows), key=repr)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert rows_of(OPERATORS[name][0](frame(spark, []))) == []


@pytest.mark.parametrize("name", OPERATORS)
def test_null_ids(spark, name):
    """A row without id gives a row; no other row's result depends on it unless texts alone decide."""
    ours, _ = OPERATORS[name]
    text = " ".join(f"w{i}" for i in range(200))
    got = ours(frame(spark, [(None, text), (None, None), (3, text), (4, text)]))
    assert got.count() == 4
    by = {r["doc_id"]: r for r in got.collect() if r["doc_id"] is not None}
    if name == "jaccard":
        assert by[4]["component_id"] == 3 and [r["component_id"] for r in got.filter("doc_id is null").collect()] == [None, None]
    elif name == "exact":
        assert (by[3]["keep_id"], by[3]["group_size"], by[4]["kept"]) == (4, 3, True)
    elif name == "substring":
        assert (by[3]["n_removed"], by[4]["n_removed"]) == (0, 200)
        assert all(r["n_removed"] == 0 for r in got.filter("doc_id is null").collect())
    else:
        assert by[3]["n_removed"] == len(text)


@pytest.mark.parametrize("name", ["substring", "jaccard", "suffix"])
def test_very_long_texts(spark, name):
    """Texts over several slices, one of them a single word."""
    import random

    r = random.Random(3)
    long = " ".join(str(r.randrange(10**6)) for _ in range(brute.LONG // 8))
    rows = [(1, long), (2, long[1000:200_000] + " tail"), (3, "x" * 1_500_000), (4, long[:-9]), (5, "short one")]
    ours, plain = OPERATORS[name]
    assert rows_of(ours(frame(spark, rows, 1))) == sorted(plain(rows), key=repr)


def test_one_group_of_a_third(spark):
    """A group of copies above the broadcast share, and a group of near copies of one text."""
    import random

    r = random.Random(8)
    base = [f"b{i}" for i in range(100)]
    near = [(1000 + i, " ".join([*base[:40], f"n{i}", *base[41:]])) for i in range(150)]
    rows = [(i, "same text in many places") for i in range(300)] + near + [(5000 + i, " ".join(f"u{r.randrange(10**6)}" for _ in range(30))) for i in range(200)]
    for name in ("exact", "jaccard", "substring"):
        ours, plain = OPERATORS[name]
        assert rows_of(ours(frame(spark, rows))) == sorted(plain(rows), key=repr), name


def test_jaccard_threshold_is_inclusive(spark):
    """Of 9 and 12 shingles, 9 shared: exactly 0.75."""
    rows = [(1, " ".join(f"w{i}" for i in range(16))), (2, " ".join(f"w{i}" for i in range(13))), (3, " ".join(f"w{i}" for i in range(12)))]
    assert rows_of(jaccard(frame(spark, rows))) == sorted(brute.components(rows), key=repr)
    assert brute.components(rows[:2])[1][2] == 1


@pytest.mark.parametrize("seed", range(3))
def test_jaccard_families(spark, seed):
    """Chains of edits: links that no head of a group has, blocks of a shingle, both rounds."""
    import random

    r = random.Random(seed)
    rows, i = [], 0
    for _ in range(6):
        w = [f"f{r.randrange(300)}" for _ in range(r.randrange(6, 60))]
        for _ in range(25):
            w = list(w)
            for _ in range(r.randrange(0, 3)):
                w[r.randrange(len(w))] = f"f{r.randrange(300)}"
            if r.random() < 0.2:
                w.insert(0, f"f{r.randrange(300)}")
            rows.append((i, " ".join(w)))
            i += 1
    before, jaccard_join.BLOCK = jaccard_join.BLOCK, 7
    try:
        assert rows_of(jaccard(frame(spark, rows))) == sorted(brute.components(rows), key=repr)
    finally:
        jaccard_join.BLOCK = before


def test_suffix_hot_grams(spark):
    rows = brute.corpus(9, 80)
    before, suffix_dedup.HOT = suffix_dedup.HOT, 3
    try:
        assert rows_of(suffix(frame(spark, rows))) == sorted(brute.suffixes(rows), key=repr)
    finally:
        suffix_dedup.HOT = before


def test_suffix_hot_regions(spark, monkeypatch):
    """Copies, near copies, a shared passage in many surroundings, one at the ends of texts, periods, and equal rows."""
    import random

    r = random.Random(23)
    words = [f"w{i:03d}" for i in range(400)]
    free = lambda n: " ".join(f"u{r.randrange(10**7)}" for _ in range(n))
    base = [r.choice(words) for _ in range(160)]
    passage = " ".join(r.choice(words) for _ in range(90))
    rows = [(i, " ".join(base)) for i in range(8)]
    rows += [(20 + i, " ".join([*base[: 10 * i], f"n{i}", *base[10 * i + 1 :]])) for i in range(12)]
    rows += [(40 + i, f"{free(r.randrange(40))} {passage[i * 5 :]} {free(r.randrange(40))}".strip()) for i in range(12)]
    rows += [(60, passage), (61, passage + free(30)), (62, free(30) + passage), (62, free(30) + passage), (63, "ab" * 700), (64, "ab" * 199 + "a"), (65, "ab" * 300)]
    rows += [(70, free(150)), (70, free(150)), (None, passage), (None, passage), (71, None), (72, "")]
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    known = [x for x in rows if x[0] is not None]
    got = [x for x in rows_of(suffix(frame(spark, rows))) if x[0] is not None]
    assert got == sorted((x for x in brute.suffixes(rows) if x[0] is not None), key=repr) and len(got) == len(known)


def test_suffix_passage_at_the_limit(spark):
    """Over 50 words shared by two documents stay at 399 bytes, as the contract has it, and go at 400."""
    import random

    r = random.Random(5)
    free = lambda: " ".join(f"u{r.randrange(10**7)}" for _ in range(60))
    rows = []
    for i, size in ((1, 399), (3, 400)):
        passage = " ".join(f"{r.randrange(10**6):06d}" for _ in range(54))
        passage += "x" * (size - 2 - len(passage))
        assert len(passage.split()) > 50
        rows += [(i, f"{free()}a {passage} c{free()}"), (i + 1, f"{free()}b {passage} d{free()}")]
    got = rows_of(suffix(frame(spark, rows)))
    assert got == sorted(brute.suffixes(rows), key=repr)
    assert [x[2] for x in got] == [0, 0, 400, 400]


def test_suffix_buckets_are_even():
    """Anchors have low hashes; the ranges they are dealt by hold as many all the same."""
    import random

    import pyarrow as pa

    r = random.Random(4)
    text = "".join(r.choice("abcdefgh ") for _ in range(400_000))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([text])], ["id", "sum", "text"])
    grams = [g % 2**64 * 8 >> 64 for b in suffix_dedup._seeds([batch]) for g in b.column(0).to_pylist()]
    share = [grams.count(k) / len(grams) for k in range(8)]
    assert len(grams) > 1500 and min(share) > 0.08 and max(share) < 0.17


def test_loser_tree_and_front_coding():
    import random

    r = random.Random(2)
    pool = [bytes(r.choice(b"ab") for _ in range(r.randrange(0, 12))) for _ in range(300)]
    runs, every = [], []
    for k in range(7):
        items = sorted((r.choice(pool), b"left", k, j, j) for j in range(r.randrange(0, 60)))
        every += [x[0] for x in items]
        runs.append(suffix_dedup.decode_run(suffix_dedup.encode_run(items)))
    out = list(suffix_dedup.merge_runs(runs))
    assert [x[0] for x in out] == sorted(every)
    for a, b in zip(out, out[1:], strict=False):
        assert b[1] == suffix_dedup.common(a[0], b[0])


def test_index_persists(spark, tmp_path):
    """A second batch meets what the first has left; the index reopens from its folder."""
    path = str(tmp_path / "index")
    first = exact_dedup.DigestIndex(spark, path, 4).dedup(frame(spark, [(1, "a"), (2, "a"), (3, "b")]))
    assert sorted((r["doc_id"], r["kept"]) for r in first.collect()) == [(1, False), (2, True), (3, True)]
    again = exact_dedup.DigestIndex(spark, path, 4)
    second = again.dedup(frame(spark, [(9, "a"), (10, "c"), (11, "c"), (12, None)]))
    assert sorted((r["doc_id"], r["keep_id"], r["kept"]) for r in second.collect()) == [(9, 2, False), (10, 11, False), (11, 11, True), (12, 12, True)]
    assert again.read().count() == 4
    plan = again.unseen(again.read().limit(1).select("digest", "keep_id"))._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan


def test_connected_components(spark):
    import random

    r = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, r.randrange(501, 700)) for _ in range(100)] + [(900, 900), (901, 902), (902, 901)]
    got = {x["node"]: x["component"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(c == 500 for n, c in got.items() if 500 <= n < 700) and got[902] == 901 and 900 not in got
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_substring_texts_under_one_id(spark):
    """Each row of a repeated doc_id loses its own repeats only, whatever texts the others have."""
    passage, clean = " ".join(f"p{i}" for i in range(20)), " ".join(f"c{i}" for i in range(40))
    rows = [(1, passage), (2, f"x y {passage} z"), (2, clean), (2, "short"), (2, None)]
    out = substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in out.collect())
    assert got == sorted([(1, 20, 0, passage), (2, 23, 20, "x y z"), (2, 40, 0, clean), (2, 1, 0, "short"), (2, 0, 0, "")])


def test_index_with_a_null_id_and_later_batches(spark, tmp_path):
    """A digest that came without an id is known all the same."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 2)
    batches = [[(None, "x")], [(7, "x"), (8, "y")], [(9, "x"), (9, "y"), (10, "z"), (11, "z")]]
    got = [sorted(map(str, ((r["doc_id"], r["keep_id"], r["kept"]) for r in index.dedup(frame(spark, b)).collect()))) for b in batches]
    assert got == [["(None, None, True)"], ["(7, None, False)", "(8, 8, True)"], ["(10, 11, False)", "(11, 11, True)", "(9, 8, False)", "(9, None, False)"]]
    assert index.read().count() == 3


def test_index_is_compacted_and_grows(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 2)
    monkeypatch.setattr(exact_dedup, "MOST_FILES", 2)
    for b in range(4):
        assert all(r["kept"] for r in index.dedup(frame(spark, [(10 * b + i, f"{b} {i}") for i in range(9)])).collect())
    assert index.version > 0 and index.files_a_bucket() <= 2
    index.compact(8)
    index.close()
    again = exact_dedup.DigestIndex(spark, path)
    assert (again.buckets, again.files_a_bucket(), again.read().count()) == (8, 1.0, 36)
    assert not any(r["kept"] for r in again.dedup(frame(spark, [(1, "0 0"), (99, "3 8")])).collect())
    plan = again.unseen(exact_dedup.digests(frame(spark, [(1, "a")])).distinct())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_exact_dedup_leaves_nothing_behind(spark):
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup.exact_dedup(frame(spark, [(1, "a")])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before


def test_substring_dedup_with_repeated_ids(spark):
    """Rows of one id with different texts: each keeps what is its own and loses what its own text repeats."""
    r = brute.random.Random(6)
    words = [f"v{i}" for i in range(60)]
    passages = [" ".join(r.choice(words) for _ in range(n)) for n in (13, 14, 20, 45, 90)]
    rows = []
    for i in range(90):
        own = [" ".join(r.choice(words) for _ in range(r.randrange(0, 30))) for _ in range(3)]
        rows.append((r.randrange(30), f"{own[0]} {r.choice(passages)} {own[1]} {r.choice(passages)} {own[2]}"))
    rows += [(1, None), (2, ""), (3, "short one"), (None, passages[4]), (0, passages[3]), (0, passages[3])]
    starts = {}
    for i, text in rows:
        w = (text or "").split()
        for k in range(len(w) - 12) if i is not None else ():
            starts.setdefault(tuple(w[k : k + 13]), set()).add(i)
    want = []
    for i, text in rows:
        w = (text or "").split()
        gone = {k + j for k in range(len(w) - 12) if i is not None and min(starts[tuple(w[k : k + 13])]) < i for j in range(13)}
        want.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    got = [tuple(x) for x in substring_dedup.substring_dedup(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(x[2] for x in want) > 500


def test_jaccard_join_with_repeated_ids(spark):
    """A doc_id with two texts is linked by each of them; a row without its own link shares the others' component."""
    r = brute.random.Random(2)
    say = lambda: " ".join(f"u{r.randrange(10**6)}" for _ in range(60))
    a, b, c, d = say(), say(), say(), say()
    rows = [(5, a), (5, b), (6, a + " more"), (7, b + " more"), (8, c), (9, d), (9, c), (3, d + " end"), (9, None)]
    got = {(x["doc_id"], x["component_id"]) for x in jaccard_join.jaccard_join(frame(spark, rows)).collect()}
    assert got == {(5, 5), (6, 5), (7, 5), (8, 3), (9, 3), (9, 9), (3, 3)}


def test_jaccard_join_of_many_close_sets(spark, monkeypatch):
    """Chains, groups of one prefix and shingles of many groups, in small blocks; every link against all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 3)
    r = brute.random.Random(12)
    base = [f"b{i}" for i in range(40)]
    rows = []
    for i in range(160):
        words = list(base) if i % 3 else [f"c{r.randrange(30)}" for _ in range(r.randrange(5, 40))]
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = f"x{r.randrange(12)}"
        rows.append((1000 - i, " ".join(words[: r.randrange(max(5, len(words) - 6), len(words) + 1)])))
    got = sorted((x["doc_id"], x["n_shingles"], x["component_id"]) for x in jaccard_join.jaccard_join(frame(spark, rows)).collect())
    assert got == sorted(brute.components(rows))


def test_suffix_dedup_with_repeated_ids(spark):
    """Rows of one id with different texts, equal rows, null ids: each row loses what its own text repeats."""
    r = brute.random.Random(9)
    say = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [say(n) for n in (380, 420, 700)]
    rows = [(r.randrange(12), say(r.randrange(300)) + r.choice(shared) + say(r.randrange(300))) for _ in range(40)]
    rows += [(None, say(50) + shared[2]), (None, None), (3, None), (3, ""), (4, shared[1]), (4, shared[1]), (5, say(1500))]
    assert rows_of(suffix(frame(spark, rows))) == sorted(brute.suffixes(rows), key=repr)
