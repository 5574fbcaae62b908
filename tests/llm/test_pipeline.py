import re
from collections import Counter
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from pipehat.llm import language, near_dup, queries, secrets
from pipehat.llm.arrow import give_back
from pipehat.llm.queries import ORACLES, QUERIES

from .test_corpus_operators import jaccard, shingles, tiles_by_force
from .test_text_operators import PlainLanguage, plain_markov, plain_spans

SF = "/root/testdata/sf0.001"


def test_registered():
    names = list(__spark_entry__.queries())
    assert [n for n in QUERIES if n in names] == list(QUERIES) and "pipeline" in names
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)] and [s for s, _ in corpus_pipeline.STAGES][1].startswith("MinHash")


@pytest.mark.parametrize("name", ORACLES)
def test_same_as_sql(spark, name):
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    df, expected = QUERIES[name](spark, SF), c.sql(ORACLES[name])
    columns = sorted(df.columns)
    at = [expected.columns.index(x) for x in columns]
    assert Counter(tuple(str(r[x]) for x in columns) for r in df.collect()) == Counter(tuple(str(r[i]) for i in at) for r in expected.fetchall())


def test_decontamination_query_by_force(spark):
    items = {r.item_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = {r.doc_id: re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    grams = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, w in items.items()}
    expected = set()
    for d, words in docs.items():
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        expected |= {(d, k) for k, g in grams.items() if own & g and tiles_by_force(words, items[k], 5) >= 0.5 * len(items[k])}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op10_decontaminate"](spark, SF).collect()} == expected and expected


def test_pipeline_against_a_plain_version(spark):
    """The same stages in plain Python over the same documents, written apart from the operators: only the Markov models are
    theirs, and of their numbers the tests of the models tell."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = sorted((r.doc_id, r.text) for r in table.collect())
    predict = PlainLanguage({(r.lang, r.text) for r in table.collect() if r.lang is not None and r.text is not None})
    told = {n: predict(t) for n, t in docs}
    docs = [(n, t) for n, t in docs if re.search(r"[^\W\d_]", t or "") and told[n][1] >= 0.5]
    sets, root = [shingles(t) for _, t in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            if docs[i][1] == docs[j][1] or jaccard(sets[i], sets[j]) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = [d for i, d in enumerate(docs) if find(i) == i]
    items = [re.findall(r"\w+", r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    grams = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in items]

    def leaked(text):
        words = re.findall(r"\w+", text.lower())
        own = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        return any(own & g and tiles_by_force(words, w, 5) >= 0.5 * len(w) for w, g in zip(items, grams, strict=True))

    docs = [d for d in docs if not leaked(d[1])]
    model = secrets.train(spark.createDataFrame(docs, "doc_id bigint, text string"))
    lib, expected = Tokenizer.from_file(queries.tokenizer(queries.WORD_BPE)), {}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    for n, t in docs:
        masked, at = "", 0
        for s, _, e in sorted(plain_spans(t) + plain_markov(t, model)):
            if s >= at:
                masked += t[at:s] + "[SECRET]"
            at = max(at, e)
        expected[n] = lib.encode(masked + t[at:], add_special_tokens=False).ids
    assert set(got) == set(expected) and all(list(got[n].ids) == ids and got[n].n_tokens == len(ids) for n, ids in expected.items())
    assert len(got) < table.count()


def test_stages_keep_columns_and_take_edges(spark):
    long = " ".join(f"the word{i} of" for i in range(300))
    rows = [(1, long, "en", "s", 5, "x"), (2, long + " end", "en", "s", 5, "x"), (3, None, None, None, None, None), (4, "", "en", "s", 0, "x"), (5, "12 !!", "en", "s", 5, "x"), (6, "password=abcdefgh the word of the people", "en", None, 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, spans string")
    for frame, last in ((docs, [1, 6]), (docs.limit(0), [])):
        now = frame
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            now = stage(spark, now, SF)
            if i < 4:
                assert now.columns == docs.columns and now.schema.simpleString() == docs.schema.simpleString()
            if i == 3:
                assert {r.doc_id: r.n_chars for r in now.collect()} == ({1: len(long), 6: len("[SECRET] the word of the people")} if last else {})
        assert sorted(r.doc_id for r in now.collect()) == last


def test_language_model_of_the_pipeline_reads_every_labelled_text(spark, monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: "".join(letters[i // 26**k % 26] for k in range(4))
    # every word stands in two texts of 6,000, some of which have copies
    rows = [(i, f"{name(i // 2)} {'one' if i % 2 else 'two'}", "aa") for i in range(6000)] * 2 + [(i, f"ω{'αβγ'[i % 3]} θάλασσα", "zz") for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    models, accepted = [], language.accepted
    monkeypatch.setattr(language, "accepted", lambda df, model: models.append(model) or accepted(df, model))
    kept = corpus_pipeline.known_language(spark, docs, SF)
    counts = Counter((lang, w) for text, lang in {r[1:] for r in rows} for w in language.words_of(text))
    plain = language.Model([(*k, n) for k, n in counts.items()])
    for a, b in zip([models[0].words, *models[0].grams], [plain.words, *plain.grams], strict=True):
        assert a.rows.keys() == b.rows.keys() and (a.logs == b.logs).all()
    assert len(models[0].words.rows) == 3003 and kept.count() == len(rows)
    assert models[0].predict(["a", "ω", "x y"])[0][:2] == ["aa", "zz"]


def test_language_counts_reach_the_driver_as_numbers_one_length_at_a_time(spark, monkeypatch):
    docs = spark.createDataFrame([(f"word{'abcdefgh'[i % 8]}{'klmnop'[i % 6]} two words", "ab"[i % 2]) for i in range(96)], "text string, lang string")
    sent, to_arrow = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: sent.append(to_arrow(self)) or sent[-1])
    model = language.train(docs, F.lit(True), max_docs=None)
    assert [len(set(x["key"].to_pylist())) for x in sent] == [len(t.rows) for t in (model.words, *model.grams)] and len(sent) == 1 + language.MAX_GRAM
    assert all(pa.types.is_integer(f.type) for x in sent for f in x.schema)


def test_operators_collect_the_garbage_of_the_driver(spark):
    """Its heap, broadcasts and shuffles of finished steps would else stay until the heap fills."""
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    collections = lambda: sum(b.getCollectionCount() for b in beans if not re.search("Young|Copy|Scavenge", b.getName()))
    docs = spark.createDataFrame([(i, f"one two three four five six {i // 2}", "en") for i in range(20)], "doc_id bigint, text string, lang string")
    for work in (lambda: language.train(docs, F.lit(True)), lambda: near_dup.near_duplicates(docs)):
        before = collections()
        work()
        assert collections() > before


def test_free_memory_goes_back_to_the_system():
    own = lambda: int(Path("/proc/self/statm").read_text().split()[1]) * 4096
    parts = [bytes(100_000) + bytes([i % 251]) for i in range(3000)]
    last = parts[-1]
    del parts
    before = own()
    give_back()
    assert len(last) == 100_001 and own() <= before - (100 << 20)
