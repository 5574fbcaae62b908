import itertools
import json
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pipehat.llm import decontaminate, fingerprint, hot, near_dup
from pipehat.llm.components import components
from pipehat.llm.shards import ShardStore
from pipehat.storage import Conflict

SF = "/root/testdata/sf0.001"
VOCAB = [f"w{i}" for i in range(400)]


def text_of(rnd, n):
    return " ".join(rnd.choices(VOCAB, k=n))


def edited(rnd, text, k):
    words = text.split()
    for i in rnd.sample(range(len(words)), k):
        words[i] = f"e{rnd.randrange(10**6)}"
    return " ".join(words)


def shingles(text):
    words = near_dup.WORD.findall(text.lower())
    return Counter(" ".join(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([" ".join(words)] if words else [])


def jaccard(a, b):
    low = sum((a & b).values())
    total = sum(a.values()) + sum(b.values()) - low
    return low / total if total else 0.0


def classes_by_force(rows):
    """class of each row's number by union of equal texts and similar pairs."""
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = [shingles(t) if t is not None else None for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] is not None and sets[j] is not None and (rows[i][1] == rows[j][1] or jaccard(sets[i], sets[j]) >= 0.8):
                root[find(i)] = find(j)
    names = {}
    for i, (n, _) in enumerate(rows):
        names[find(i)] = min(names.get(find(i), n), n)
    return [names[find(i)] for i in range(len(rows))]


# -- near duplicates ----------------------------------------------------------------------------------------------------
def test_signatures_agree_as_often_as_texts_are_similar():
    rnd, errors = random.Random(2), []
    base = text_of(rnd, 300)
    texts = [base, *(edited(rnd, base, k) for k in (3, 8, 20)), base + " " + base, "one two", "one two", ""]
    of, s, w = near_dup.weighted_sets(texts)
    sig = near_dup.signatures(of, s, w, len(texts), 2000)
    for i in range(5):
        for j in range(i):
            errors.append(np.mean(sig[i] == sig[j]) - jaccard(shingles(texts[i]), shingles(texts[j])))
    assert max(map(abs, errors)) < 0.05
    assert (sig[5] == sig[6]).all() and not sig[7].any() and (sig[:7] > 0).mean() > 0.99


def test_weights_count():
    of, s, w = near_dup.weighted_sets(["a b c d e " * 4, None, "x"])
    assert w.sum() == 16 + 1 and of.tolist() == sorted(of.tolist()) and len(s) == 6


def test_sketches_never_hide_a_link():
    rnd = random.Random(12)
    base = text_of(rnd, 150)
    texts = [base, *(edited(rnd, base, k) for k in (1, 2, 4, 9)), base + " " + base, "", "one", text_of(rnd, 3000)]
    sketches = near_dup.sketch(*near_dup.weighted_sets(texts), len(texts)).view(np.uint64)
    for i in range(len(texts)):
        for j in range(len(texts)):
            a, b = shingles(texts[i]), shingles(texts[j])
            bits = sum(int(x).bit_count() for x in sketches[i] ^ sketches[j])
            assert bits <= sum((a - b).values()) + sum((b - a).values())
    assert 35 < sum(int(x).bit_count() for x in sketches[0] ^ sketches[3]) <= 40


@pytest.mark.parametrize("least_hot", [2, 500])
def test_near_duplicates_by_force(spark, least_hot, monkeypatch):
    """Also with hot values everywhere."""
    monkeypatch.setattr(hot, "LEAST_HOT", least_hot)
    rnd = random.Random(4)
    base, other, short = text_of(rnd, 120), text_of(rnd, 120), text_of(rnd, 60)
    rows = [(1, base), (2, base), (3, base.upper()), (4, None), (5, None), (6, ""), (7, ""), (8, "!!"), (9, "one two"), (10, "One, two"), (11, "one two three")]
    rows += [(20 + i, edited(rnd, base, rnd.randint(1, 5))) for i in range(60)]  # a dense group around the threshold
    rows += [(100 + i, edited(rnd, other, 1)) for i in range(5)] + [(120 + i, edited(rnd, short, 2)) for i in range(5)] + [(140 + i, text_of(rnd, 80)) for i in range(20)]
    rows += [(200, base), (50, rows[41][1]), (300, "line again " * 40), (301, "line again " * 41), (302, "line again " * 80)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("key", F.lit("clash")).withColumn("bands", F.lit(1)).repartition(5)
    got = Counter((r.doc_id, r.class_id) for r in near_dup.near_duplicates(df).collect())
    assert got == Counter(zip([n for n, _ in rows], classes_by_force(rows), strict=True))
    kept = near_dup.representatives(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for c in classes_by_force(rows)})


def test_one_id_with_several_texts(spark):
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    rows = [(1, a), (1, b), (1, b), (2, a + " "), (None, a), (None, None), (None, None), (3, None), (None, "alone here without an id"), (None, "alone here without an id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept", F.lit(1)).withColumn("row", F.lit("x")).withColumn("name", F.lit("y"))
    kept = near_dup.representatives(df)
    assert kept.columns == df.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([(1, a), (1, b), (None, None), (None, None), (3, None), (None, "alone here without an id")])


def test_nothing_is_left_behind(spark):
    import os

    from pipehat.runtime import shared_dir

    folder = shared_dir(spark).removeprefix("file://") + "/pipehat"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    near_dup.near_duplicates(spark.read.parquet(f"{SF}/documents.parquet")).count()
    assert [x.split("-")[0] for x in set(os.listdir(folder)) - before] == ["classes"]


def test_small_tables_take_few_files(spark, monkeypatch):
    """Every file starts processes, whose number else follows the partitions of a shuffle; the result stays the same."""
    from pipehat.llm import components as stars
    from pipehat.runtime import written

    files = {}

    def noted(df, label, *rows):
        out = written(df, label, *rows)
        files[label] = max(files.get(label, 0), len(out.inputFiles()))
        return out

    rnd = random.Random(11)
    texts = [text_of(rnd, 60) for _ in range(60)]
    rows = [(i, edited(rnd, texts[i % 60], i % 4)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {n: c for (n, _), c in zip(rows, classes_by_force(rows), strict=True)}
    for module in near_dup, stars:
        monkeypatch.setattr(module, "written", noted)
    more = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in more}
    for k, v in more.items():
        spark.conf.set(k, v)
    try:
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want
    assert files.keys() >= {"distinct", "sizes", "met", "members", "led", "edges", "least", "large", "spread", "classes"}
    of_texts = {"signed", "texts", "rest", "shingles", "prefix", "pairs", "compared"}
    assert all(n <= spark.sparkContext.defaultParallelism for label, n in files.items() if label not in of_texts), files


def test_near_duplicates_edges(spark):
    schema = "doc_id bigint, text string"
    assert near_dup.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = near_dup.near_duplicates(spark.createDataFrame([(None, "a b c d e f"), (2, "a b c d e f"), (None, None), (3, "x")], schema)).collect()
    assert Counter((r.doc_id, r.class_id) for r in got) == Counter([(None, 2), (2, 2), (None, None), (3, 3)])
    long = "word%d " * 3
    text = " ".join(f"word{i}" for i in range(60_000)) + long
    assert [r.class_id for r in near_dup.near_duplicates(spark.createDataFrame([(1, text), (2, text + " end")], schema)).collect()] == [1, 1]


def test_components(spark):
    rnd = random.Random(9)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.root for r in components(spark.createDataFrame(edges * 2, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- decontamination ----------------------------------------------------------------------------------------------------
def tiles_by_force(text, item, m):
    used_t, used_i, out = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for i in range(len(text)):
            for j in range(len(item)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and i + n not in used_t and j + n not in used_i:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < m:
            return out
        used_t.update(range(i, i + n))
        used_i.update(range(j, j + n))
        out += n


def test_tiling_by_force():
    rnd = random.Random(6)
    words = [f"v{i}" for i in range(12)]  # few words, so that matches overlap
    for _ in range(60):
        item, text = rnd.choices(words, k=20), rnd.choices(words, k=30)
        for _ in range(3):
            i, j = rnd.randrange(20), rnd.randrange(24)
            text[j : j + 7] = item[i : i + 7]
        index = decontaminate.Index([(0, " ".join(item))], seed=3)
        got = {k: sum(n for _, _, n in tiles) for _, k, _, tiles in index.matches([" ".join(text)], 0.0)}
        assert got.get(0, 0) == tiles_by_force(text, item, 3)


def test_tiling_of_repetitive_texts():
    """Work and memory stay bounded however often words repeat, and results stay those of brute force."""
    for item, text in ((["a"] * 9, ["a"] * 14), (["a", "b"] * 6, ["a", "b", "a"] * 6), (["a"] * 6 + ["b"] * 6, ["b"] * 9 + ["a"] * 9)):
        index = decontaminate.Index([(0, " ".join(item))], seed=3)
        got = {k: sum(n for _, _, n in tiles) for _, k, _, tiles in index.matches([" ".join(text)], 0.0)}
        assert got == {0: tiles_by_force(text, item, 3)}
    start = time.perf_counter()
    index = decontaminate.Index([(0, "again " * 5000)] + [(i, f"the usual line that opens every page number {i}") for i in range(1, 3000)])
    got = list(index.matches(["again " * 5000, "the usual line that opens every page " * 300], 0.5))
    assert [(t, k, c) for t, k, c, _ in got if k == 0] == [(0, 0, 1.0)] and len(got) == 3000
    assert time.perf_counter() - start < 5


@pytest.mark.parametrize("block", [10**6, 200])
def test_decontamination(spark, block):
    rnd = random.Random(8)
    items = [(i, text_of(rnd, 40)) for i in range(6)] + [(6, "tiny item"), (7, None), (8, ""), (0, None)]
    items[0] = (0, items[0][1])
    passage = items[1][1].split()
    docs = [
        (1, f"{text_of(rnd, 30)} {items[0][1].upper()} {text_of(rnd, 30)}"), (2, " ".join([*passage[20:], "x", *passage[:20]])), (3, " ".join(passage[:10])), (4, text_of(rnd, 200)), (5, None), (6, ""), (7, "a tiny, item here"), (8, "tiny things, item"),
        (1, f"{text_of(rnd, 30)} {items[0][1]}"), (9, " ".join(passage[:25])), (10, " ".join(w for p in zip(passage, ["y"] * 40, strict=True) for w in p)),
    ]
    d, b = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item", F.lit(1)), spark.createDataFrame([*items, items[1]], "item_id int, text string")
    got = decontaminate.find(d, b, block_chars=block).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 0), (1, 0), (2, 1), (7, 6), (9, 1)])
    assert {r.doc_id: round(r.coverage, 3) for r in got}[9] == 0.625 and all(sum(t.words for t in r.tiles) / 40 == r.coverage for r in got if r.doc_id != 7)
    kept = decontaminate.clean(d, b, block_chars=block)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8, 10]
    assert decontaminate.find(d.limit(0), b).count() == 0 and decontaminate.find(d, b.limit(0)).count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)


# -- fingerprints -------------------------------------------------------------------------------------------------------
def test_ranks_by_force():
    import math

    data = np.frombuffer(("The quick brown fox. " * 5 + "aaaaaaaaaaaa" * 10 + text_of(random.Random(1), 60)).encode(), np.uint8)
    got, w = fingerprint.ranks(data), fingerprint.WINDOW
    for i in range(len(data) - w + 1):
        c = Counter(data[i : i + w].tolist())
        h = -sum(n / w * math.log2(n / w) for n in c.values())
        expected = fingerprint.LAST if h < fingerprint.WEAK else fingerprint.LAST - 1 - min(abs(h - fingerprint.USUAL) / fingerprint.SPREAD * 256, fingerprint.LAST - 1)
        assert abs(int(got[i]) - expected) <= 1


@pytest.mark.parametrize("n", [1, 15, 40, 300, 2000])
def test_features_by_force(n):
    key = np.random.default_rng(n).integers(0, 500, n).astype(np.uint64)
    run = max(1, min(fingerprint.POPULAR, n // fingerprint.DENSITY))
    wins = [min(key[i : i + run].tolist()) for i in range(n - run + 1)]
    expected = [k for k, g in itertools.groupby(wins) if len(list(g)) >= fingerprint.VOTES * run]
    assert fingerprint.features(key).tolist() == expected


def test_one_rule_for_all_lengths():
    base = text_of(random.Random(8), 2000)
    for n in (20, 60, 100, 200, 254, 255, 256, 257, 500, 1000, 1040, 4000):
        for more in (1, 2, 4):
            assert fingerprint.Print(base[:n]).likeness(fingerprint.Print(base[: n + more])) > 0.9
    # repeated windows count once; what differs counts
    one, other = fingerprint.Print("x" * 3000), fingerprint.Print("x" * 1500 + "yyyyyyyy" + "x" * 1500)
    assert one.count and one.text() != other.text()


def test_likeness():
    rnd = random.Random(5)
    a, b = text_of(rnd, 3000), text_of(rnd, 3000)
    one = fingerprint.Print(a)
    assert one.likeness(fingerprint.Print(a)) == 1 and one.likeness(fingerprint.Print(b)) < 0.1 and len(one.bits) > 1
    near = one.likeness(fingerprint.Print(fingerprint.edited(a, b)))
    assert 0.5 < near < 0.9
    assert fingerprint.parse(one.text()).likeness(one) == 1 and fingerprint.Print("").likeness(fingerprint.Print("")) == 1 and fingerprint.Print("").likeness(one) == 0
    assert fingerprint.Print("short").likeness(fingerprint.Print("short")) == 1 and fingerprint.Print("x" * 5000).likeness(fingerprint.Print("x" * 5000)) == 1


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_fingerprints_of_a_ring(spark, kind):
    import hashlib

    rnd = random.Random(7)
    rows = [(i * 3, text_of(rnd, rnd.randint(0, 90))) for i in range(40)] + [(500, None), (501, ""), (502, "é你😀" * 30), (None, "no id")]
    rnd.shuffle(rows)
    if kind == "string":
        rows = [(None if i is None else f"d{i:04d}", t) for i, t in rows]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").withColumn("part", F.lit(1)).withColumn("id", F.lit("x")).repartition(4)
    got = {r.doc_id: r for r in fingerprint.fingerprints(df).collect()}
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: r[0], reverse=True) + [r for r in rows if r[0] is None]
    assert len(got) == len(rows)
    for (i, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following, g = t or "", following or "", got[i]
        n = len(t) // 3
        new = t[: len(t) - n] + following[:n]
        assert (g.n_chars, g.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        own = fingerprint.Print(t)
        assert g.fingerprint == own.text() and g.near_next == own.likeness(fingerprint.Print(following)) and g.near_edited == own.likeness(fingerprint.Print(new))


def plain_features(text):
    """Hashes of improbable windows, one after the other: entropies by counting, runs by looking at all their windows."""
    import math

    data = text.encode().ljust(16, b"\0") if text else b""
    keys, mask = [], 2**64 - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    for i in range(len(data) - 15):
        w = data[i : i + 16]
        entropy = -sum(n / 16 * math.log2(n / 16) for n in Counter(w).values())
        rank = 4095 if entropy < 1 else 4094 - int(abs(round(entropy, 4) - 3.15) / 0.25 * 256 + 1e-3)
        h = 16
        for k in (0, 8):
            h = mixed((h * 0x94D049BB133111EB + int.from_bytes(w[k : k + 8], "little") + 1) & mask)
        keys.append((rank, h >> 12))
    run = max(1, min(64, len(keys) // 16))
    wins = [min(keys[i : i + run]) for i in range(len(keys) - run + 1)]
    return dict.fromkeys(k for k, g in itertools.groupby(wins) if len(list(g)) >= run / 4)


def plain_likeness(a, b):
    """Over chained filters as sets of bits."""
    chains = []
    for text in (a, b):
        hashes = fingerprint.selected(text).tolist()
        parts = [hashes[i : i + 160] for i in range(0, len(hashes), 160)]
        chains.append([(len(p), {h >> (11 * k) & 2047 for h in p for k in range(5)}) for p in parts])
    one, two = sorted(chains, key=lambda c: (len(c), sum(n for n, _ in c)))
    if not one:
        return float(not two)
    score = 0.0
    for n, x in one:
        best = 0.0
        for _, y in two:
            chance = len(x) * len(y) / 2048
            best = max(best, (len(x & y) - chance) / max(min(len(x), len(y)) - chance, 1e-9))
        score += n * min(1.0, best)
    return score / sum(n for n, _ in one)


def test_likeness_against_a_plain_version():
    rnd = random.Random(21)
    for n in (1, 3, 12, 60, 300, 2500):
        a, b = text_of(rnd, n), text_of(rnd, n)
        for x, y in ((a, b), (a, fingerprint.edited(a, b)), (a, edited(rnd, a, max(1, n // 20))), (a, ""), (a, a + b)):
            assert fingerprint.Print(x).likeness(fingerprint.Print(y)) == pytest.approx(plain_likeness(x, y), abs=1e-5)
        # ranks at the edge of a step may differ by one, which changes few features
        got, want = len(fingerprint.selected(a)), len(plain_features(a))
        assert abs(got - want) <= max(1, want // 20)


def test_fingerprint_edges(spark):
    schema = "doc_id bigint, text string"
    assert fingerprint.fingerprints(spark.createDataFrame([], schema)).count() == 0
    one = fingerprint.fingerprints(spark.createDataFrame([(1, "alone" * 100)], schema)).collect()
    assert len(one) == 1 and one[0].near_next == 1
    twice = fingerprint.fingerprints(spark.createDataFrame([(1, "a b " * 100), (1, "a b " * 100), (1, "c")], schema)).collect()
    assert len(twice) == 3 and len({r.fingerprint for r in twice}) == 2
    # one id and null ids are dealt over tasks, equal rows too
    many = spark.createDataFrame([(7, f"text number {i % 50}") for i in range(400)] + [(None, "same") for _ in range(400)], schema)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would all go to one task
    try:
        dealt = fingerprint.in_order(many, "doc_id", "text").select(F.spark_partition_id().alias("p"), "id").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert min(Counter(r.id for r in dealt).values()) > 1
    assert Counter(r.doc_id for r in fingerprint.fingerprints(many).collect()) == {7: 400, None: 400}


# -- shards -------------------------------------------------------------------------------------------------------------
def test_shards(spark, tmp_path):
    rows = [(i, None if i == 3 else f"text {i} " * 50, i % 3) for i in range(400)] + [(None, "", None)] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, shard int").repartition(8)
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=60_000)
    assert store.manifest()["version"] == 0
    with pytest.raises(LookupError):
        store.read()
    assert store.compact() == 0
    for k in range(3):
        store.append(df.where((F.coalesce(F.col("shard"), F.lit(0))) == k))
    assert store.append(df.limit(0)) == 4
    before = store.shards(store.manifest()["lists"])
    last = store.compact()
    after = store.shards(store.manifest()["lists"])
    assert last == store.versions()[-1] and len(after) < len(before) and sum(s["rows"] for s in after) == len(rows)
    as_rows = lambda d: Counter(map(str, d.select("doc_id", "text", "shard").collect()))
    assert as_rows(store.read()) == as_rows(df) and as_rows(store.read(4)) == as_rows(df)  # old versions stay
    with pytest.raises(Conflict):
        store.commit(last - 1, None, [])
    assert store.vacuum() == len({s["path"] for s in before} - {s["path"] for s in after}) and store.versions() == [last] and as_rows(store.read()) == as_rows(df)


def test_shard_lists_stay_small(spark, tmp_path):
    """Appends write lists of their own shards only; merges are bounded and touch the lists of their tier; nothing is lost."""
    df = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(120)], "doc_id bigint, text string").coalesce(1)
    store = ShardStore(spark, f"file://{tmp_path}/s", target_bytes=10_000_000, merge_bytes=12_000, list_shards=3)
    sizes = []
    for k in range(40):
        store.append(df.where(F.col("doc_id") % 40 == k))
        sizes.append(len(json.dumps(store.manifest()["lists"][-1])))
    assert max(sizes) - min(sizes) < 5 and all(sum(x["tiers"].values()) == 1 for x in store.manifest()["lists"])
    runs = store.runs(store.shards(store.manifest()["lists"]))
    assert len(runs) > 1 and all(sum(s["bytes"] for s in r) <= 12_000 for r in runs)
    store.compact()
    lists = store.manifest()["lists"]
    assert len(lists) < 20 and all(sum(x["tiers"].values()) <= 3 for x in lists) and all(x["tiers"] == {str(t): n for t, n in Counter(s["tier"] for s in store.shards([x])).items()} for x in lists)
    store.vacuum()
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(120))
    assert len(list((tmp_path / "s/lists").glob("*.json"))) == len(lists)


def test_tiers():
    store = ShardStore.__new__(ShardStore)
    store.target_bytes, store.tier_width, store.least_run, store.merge_bytes = 1000, 4.0, 2, 100
    assert [store.tier(s) for s in (2000, 500, 499, 125, 124, 10)] == [0, 0, 1, 1, 2, 3]
    shards = [{"path": str(i), "tier": t, "bytes": 30} for i, t in enumerate((0, 0, 1, 2, 2, 3))]
    assert [[s["path"] for s in r] for r in store.runs(shards)] == [["3", "4"]]
    many = [{"path": str(i), "tier": 2, "bytes": 30} for i in range(8)]  # two runs of 90 bytes, and one of 60
    assert [len(r) for r in store.runs(many)] == [3, 3, 2]
