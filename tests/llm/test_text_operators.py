import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from pipehat.llm import bpe, html_text, language, licenses, queries, secrets, wordpiece

SF = "/root/testdata/sf0.001"
LONG = "word " * 30_000
TEXTS = [None, "", " \n\t", "MIT License", "MIT License", "ÀÉ 你好 😀 I'll don't", "x" * 20_000, LONG, "<|endoftext|>Hi<|startoftext|>", "ΑΣ ΟΔΟΣ é İ"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [(i, t, "clash", i, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 0, 1), (3, "MIT License", "clash", 3, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string, id int, score int")


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# -- BPE ----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tokenizer():
    return queries.tokenizer(queries.WORD_BPE)


@pytest.fixture(scope="module")
def model(tokenizer):
    return bpe.Model(tokenizer)


def encoded_by_library(tokenizer, texts):
    return [e.ids for e in Tokenizer.from_file(tokenizer).encode_batch(texts, add_special_tokens=False)]


def test_bpe_equals_the_library(model, tokenizer):
    rnd = random.Random(5)
    alphabet = "abcdefghijklmnopqrstuvwxyzABC0129 .,'’!#%$éèüßñ\t\nŁİ你好😀́Σσς  \x1c\x85"
    texts = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 60))) for _ in range(4000)] + ["".join(rnd.choices("etaoinshrdlu", k=rnd.randint(1, 90))) for _ in range(4000)] + [t or "" for t in TEXTS]
    assert model.encode_batch(texts) == encoded_by_library(tokenizer, texts)


def test_bpe_equals_the_library_on_all_characters(model, tokenizer):
    texts = [f"x{chr(c)}y{chr(c)}{chr(c)} {chr(c)}" for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    assert model.encode_batch(texts) == encoded_by_library(tokenizer, texts)


def test_vocabulary_is_self_consistent(model):
    assert model.self_consistent()


def test_pairs_are_compatible_as_exact_merging_says(model):
    import numpy as np

    rnd = random.Random(3)
    plain = [i for t, i in model.vocab.items() if not t.endswith(bpe.END)]
    pairs = [(rnd.choice(plain), rnd.randrange(len(model.vocab))) for _ in range(3000)] + rnd.sample(list(model.merges), 500)
    got = model.compatible(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]))
    assert got.tolist() == [model.exact_symbols(model.tokens[a] + model.tokens[b]) == [a, b] for a, b in pairs]


def test_long_words_merge_exactly(model, tokenizer):
    word = "".join(random.Random(1).choices("abcdefgh", k=3000))
    assert [model.exact(word)] == encoded_by_library(tokenizer, [word])


def test_bpe_query(spark, odd, tokenizer):
    got, lib = by_id(bpe.digests(bpe.encode_decode(odd, tokenizer))), Tokenizer.from_file(tokenizer)
    assert bpe.encode_decode(odd, tokenizer).count() == len(TEXTS) + 2
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(bpe.encode_decode(odd.limit(0), tokenizer)).count() == 0


# -- token counts -------------------------------------------------------------------------------------------------------
def test_token_counts_equal_greedy_longest_match(spark, odd):
    import json

    path = queries.tokenizer(queries.BYTE_BPE)
    back = {c: b for b, c in bpe.byte_alphabet().items()}
    vocab = {bytes(back[c] for c in t) for t in json.load(open(path, encoding="utf-8"))["model"]["vocab"] if "<|" not in t}

    def greedy(data):
        n = 0
        while data:
            j = next(j for j in range(min(len(data), 128), 0, -1) if data[:j] in vocab)
            data, n = data[j:], n + 1
        return n

    got = by_id(wordpiece.count_tokens(odd, path))
    for i, t in enumerate(TEXTS):
        if t is LONG:
            assert got[i].n_words == 30_000 and got[i].n_pieces == 30_000 * greedy(b" word")
            continue
        words = [greedy(b" " + w.encode()) for w in (t or "").split()]
        assert (got[i].n_words, got[i].n_pieces, got[i].longest_word) == (len(words), sum(words), max(words, default=0))
    assert wordpiece.count_tokens(odd.limit(0), path).count() == 0


def test_automaton_without_single_letters():
    a = wordpiece.Automaton([b"ab", b"abcd", b"c", b"x"])
    assert [a.count(t) for t in (b"", b"ab", b"abc", b"abcd", b"abcdab", b"abcx", b"a", b"abd", b"zab")] == [0, 1, 2, 1, 2, 3, -1, -1, -1]


# -- licenses -----------------------------------------------------------------------------------------------------------
def test_license_base_equals_a_plain_scan(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(["MIT LICENSE, mit-license Apache\x7fLicense general.public(license)", "mit licenses", "generalé public license mit mit license", "the GNU General Public License"])], "doc_id bigint, text string")
    rows = docs.unionAll(extra).collect()
    got = by_id(licenses.scan(docs.unionAll(extra)))
    for r in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        hits = [(i, label) for label, phrase in licenses.BASE.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase]
        g = got[r.doc_id]
        places = [i for i, _ in hits]
        assert (g.n_words, g.n_base, g.first_word, g.last_word) == (len(words), len(hits), min(places, default=None), max(places, default=None))
        assert g.base_labels == ",".join(sorted({x for _, x in hits})) and {x for _, x in hits} <= set(g.labels.split(",")) and 0 <= g.score <= 1


def test_license_rules():
    assert len(licenses.rules()[0]) > 200
    find = lambda t: [x[2] for x in licenses.detections(t)]
    assert find("under the gnu lesser general public license, version 2.1 or later") == ["lgpl-2.1"]
    assert find("licensed under the apache license, version 2.0") == ["apache-2.0"] and find("spdx-license-identifier: mit") == ["mit"]
    assert find("bsd 3-clause license and cc-by-sa-4.0") == ["bsd-3-clause", "cc-by-sa-4.0"] and find("an ordinary text about permits") == []
    spans = [(0, 10, "a", 9), (2, 8, "b", 5), (2, 12, "c", 5), (0, 10, "d", 1), (11, 12, "e", 1), (20, 21, "f", 1), (0, 30, "g", 0)]
    kept = licenses.suppress(spans)
    plain = []
    for x in spans:
        if not any(k[0] <= x[0] and x[1] <= k[1] for k in plain):
            plain.append(x)
    assert kept == plain


def test_license_keywords_are_implied_by_their_regex():
    labels = lambda t: [x[2] for x in licenses.detections(t)]
    for t, label in [("mit licence", "mit"), ("the mozilla public licence", "mpl"), ("open government license", "ogl-uk"), ("open rail m", "openrail"), ("mit" + " *" * 200 + "license", "mit")]:
        assert labels(t) == [label] == labels(t + " with a license and a licence")[:1]
    for r in licenses.rules()[0]:
        assert r.keywords
        # what a rule matches in its own pattern's plain readings has one word of each of its keywords
        for spelling in ("c", "s"):
            plain = re.sub(r"\(\?:([^()|]*)\)\??", r"\1", r.regex.pattern.replace(r"[^\w]+?", " ").replace(r"[^\w]*?", " ")).replace("[sc]", spelling).replace("\\", "")
            for m in r.regex.finditer(plain):
                assert all(any(w in m[0] for w in k) for k in r.keywords)


def plain_labels(text):
    """Every rule over the whole text, without a prefilter; then by priority, length and place, none inside a kept one."""
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    found = [(-r.priority, m.start() - m.end(), m.start(), r.label, m.end()) for r in licenses.rules()[0] for m in r.regex.finditer(low)]
    kept = []
    for _, _, s, label, e in sorted(found):
        if not any(a <= s and e <= b for a, b, _ in kept):
            kept.append((s, e, label))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    base = {label for label, phrase in licenses.BASE.items() for i in range(len(words)) if tuple(words[i : i + len(phrase)]) == phrase}
    return ",".join(sorted(base | {label for *_, label in kept}))


def test_license_labels_against_a_plain_version(spark):
    rnd = random.Random(17)
    readings = []
    for r in licenses.rules()[0]:  # each rule's own words, now and then between others
        plain = re.sub(r"\(\?:([^()|]*)(?:\|[^()]*)?\)\??", r"\1", r.regex.pattern.replace(r"[^\w]+?", " ").replace(r"[^\w]*?", " ")).replace("[sc]", rnd.choice("sc")).replace("\\", "")
        readings.append(plain)
    texts = [" ".join(rnd.choices(["under the", "Licensed", "LICENSE,", "version 2.0", "or later", *rnd.sample(readings, 6)], k=rnd.randint(1, 8))) for _ in range(400)] + readings
    docs = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in texts + docs:
        assert licenses.scan_text(t)[5] == plain_labels(t)
    assert sum(bool(plain_labels(t)) for t in texts) > 400


def test_license_edges(odd):
    got = by_id(licenses.scan(odd))
    assert (got[0].n_words, got[0].score, got[0].first_word, got[0].labels) == (0, 0.0, None, "") and got[3].labels == "mit" and got[7].n_words == 30_000
    assert licenses.scan(odd.limit(0)).count() == 0


# -- HTML ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""), ("", ""), ("<p>", ""), ("<script>var a = '<p>x</p>'</script>", ""),
        ("<html><head><title>T</title><style>p{}</style></head><body><nav><a>Home</a></nav><article><h1>A &amp; B</h1><p>One<b>two</b> \n three<br>four<p>five&nbsp;six</article><footer>f</footer>", "A & B Onetwo three four five six"),
        ("<article><p>Body text here.</p><aside>side</aside><div class='ad-box'>buy</div><form>f<input></form><section id='comments'><p>first!</p></section><p>More.</article>", "Body text here. More."),
        ("<body><div class='cookie-notice'>We use cookies</div><main><p>Text &lt;kept&gt; whole.</p></main></body>", "Text <kept> whole."),
        ("<article class='comment'><p>me too</p></article><article><p>" + "Long body. " * 20 + "</p></article>", ("Long body. " * 20).strip()),
        ("<div><ul><li><a href=x>a</a></li><li><a href=y>b</a></li></ul></div><div><h2>Head</h2><p>" + "word " * 40 + "</p><p>short</p><p>" + "more " * 40 + "</p></div>", "Head " + "word " * 40 + "short " + ("more " * 40).strip()),
        ("<div class='header'>Site</div><div class='post-header'><h1>Title</h1></div><div id=commentbox>me</div><p>" + "word " * 30 + "</p>", "Title " + ("word " * 30).strip()),
        ("<!-- c --><article><p>a<!-- hidden -->b</p><noscript>n</noscript><template>t</template></article>", "ab"),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_clusters_choose_the_region_beside_marked_elements():
    prose = [f"{w} " + "text of the page " * 20 for w in ("one", "two", "three")]
    body = "".join(f"<p>{x}</p>" for x in prose)
    want = " ".join(x.strip() for x in prose)
    # a marked card that holds little or nothing of the cluster isn't the region
    assert html_text.main_text(f"<body><article><h3>Tip</h3></article><div>{body}</div></body>") == want
    assert html_text.main_text(f"<body><article><p>A short card.</p></article><div>{body}</div></body>").endswith(want)
    # of several marked elements all that hold lines of the cluster stay
    assert html_text.main_text("<body>" + "".join(f"<article><p>{x}</p></article>" for x in prose) + "<article><p>me too</p></article></body>").startswith(want)
    # one line, and lines of one ratio, are a cluster of their own
    for n in range(1, 60):
        assert html_text.main_text(f"<div><p>{'x' * n}</p></div>") == "x" * n


def test_links_inside_the_region_are_text():
    prose = "words of the page " * 20
    inner = f"<p>{prose}</p><p><a href=x>See the full report</a></p><ul><li><a href=y>First reference</a></li></ul><table><tr><td><a href=z>Name</a></td></tr></table><p>{prose}</p>"
    want = f"{prose}See the full report First reference Name {prose.strip()}"
    menu = "<div><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul></div>"
    assert html_text.main_text(f"<body>{menu}<article>{inner}</article></body>") == want
    assert html_text.main_text(f"<body>{menu}<div>{inner}</div></body>") == want
    assert html_text.main_text(f"<article>{inner}<p><a href=x>Last link</a></p></article>") == want + " Last link"
    assert html_text.main_text("<article><ul><li><a href=y>One</a></li><li><a href=z>Two</a></li></ul></article>") == "One Two"


def test_pages_give_their_articles(spark):
    import html as entities

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract(pages.withColumn("text", F.lit("clash"))).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub("<br>", " ", b).replace("<b>", "").replace("</b>", ""))).strip() for b in re.split(r"</?(?:h1|p)>", inner)]
        text = " ".join(b for b in blocks if b)
        assert (got[r.page_id].text, got[r.page_id].n_chars, got[r.page_id].url) == (text, len(text), r.url)
    empty = spark.createDataFrame([(None, None, None), (1, "u", None)], "page_id bigint, url string, html string")
    assert [(r.text, r.n_chars) for r in html_text.extract(empty).collect()] == [("", 0), ("", 0)]


def test_pages_give_the_same_text_without_marks(spark):
    """Ratios and clusters find the article also where no tag names it."""
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        for mark in (r"<\1div>", ""):
            assert html_text.main_text(re.sub("<(/?)(?:article|main)>", mark, r.html)) == html_text.main_text(r.html)


def test_class_names_count_as_a_whole():
    prose = "words of the page " * 20
    for name, kept in (("legal-note", 1), ("form-factor", 1), ("adventure", 1), ("header-note", 0), ("ad", 0), ("ad-slot-2", 0), ("userComments", 0), ("related-posts", 0), ("cookie_banner", 0), ("noticeboard", 1), ("share buttons", 0)):
        text = html_text.main_text(f"<body><p>{prose}</p><div class='{name}'><p>Here {prose}</p></div><p>{prose}</p></body>")
        assert ("Here" in text) == bool(kept), name


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<div>" * 50_000 + "</section>" * 50_000, "<i><div>" + "<b>x" * 30_000 + "</i>" * 30_000, "<td>x" * 50_000, "<div><li>x" * 30_000, "<p><b>x" * 30_000, "<article>" * 20_000 + "x" + "<p>y" * 1000])
def test_deep_and_long_pages_take_time_in_proportion(page):
    start = time.process_time()
    text = html_text.main_text(page)
    assert time.process_time() - start < 2
    assert len(text.replace(" ", "")) <= page.count("x") + page.count("y")


def plain_region(tree):
    """The rules over nested lists [tag, child, ...] with texts as leaves, by paths and sums over all pairs."""
    lines, tags, number = [], {(): ""}, iter(range(1, 10**6))

    def walk(node, path):
        nonlocal seen
        me = (*path, next(number))
        tags[me], inner = node[0], node[1]
        seen += 1
        if isinstance(inner, str) or inner[0] == "a":  # one line: its block's tags count with it, and a link's
            linked, text = not isinstance(inner, str), inner if isinstance(inner, str) else inner[1]
            lines.append([text, len(text) * linked, seen + 2 * linked + 1, me, node[0] == "h2"])
            seen = 0
        else:
            for child in node[1:]:
                walk(child, me)
            seen += 1

    seen = 0
    walk(tree, ())
    ratio = [max(0, len(t) - 2 * k) / max(1, n) for t, k, n, *_ in lines]
    near = lambda i: [(math.exp(-((i - j) ** 2) / 2), x) for j, x in enumerate(ratio) if abs(i - j) <= 3]
    smooth = [sum(w * x for w, x in near(i)) / sum(w for w, _ in near(i)) for i in range(len(ratio))]
    logs = [math.log1p(x) for x in smooth]
    lo, hi = min(logs), max(logs)
    for _ in range(50):
        a, b = [x for x in logs if x < (lo + hi) / 2], [x for x in logs if x >= (lo + hi) / 2]
        lo, hi = sum(a) / len(a) if a else lo, sum(b) / len(b) if b else hi
    prose = [i for i, x in enumerate(lines) if 2 * x[1] <= len(x[0])]
    picked = [i for i in prose if logs[i] >= (lo + hi) / 2 - 1e-9] or prose
    if not picked:
        return ""
    below = lambda p, those: sum(len(lines[i][0]) for i in those if lines[i][3][:-1][: len(p)] == p)
    everything = range(len(lines))
    good = [p for p in tags if p and 10 * below(p, picked) >= 9 * below((), picked)]
    holder = max(good, key=len, default=())
    while holder and tags[holder[:-1]] not in ("", "body") and 2 * (below(holder[:-1], picked) - below(holder, picked)) >= below(holder[:-1], everything) - below(holder, everything):
        holder = holder[:-1]
    inside = [i for i in everything if lines[i][3][: len(holder)] == holder]
    child = lambda i: tags[lines[i][3][: len(holder) + 1]] if len(lines[i][3]) > len(holder) else ""
    touches = lambda i: lines[i][4] or child(i) in ("", "p", "h2", "ul") and 2 * lines[i][1] <= len(lines[i][0])
    first, last = min(i for i in picked if i in inside), max(i for i in picked if i in inside)
    while first > inside[0] and touches(first - 1):
        first -= 1
    while last < inside[-1] and touches(last + 1):
        last += 1
    while first == min(inside + [first]) and first > 0 and lines[first - 1][4]:
        first -= 1
    return " ".join(lines[i][0] for i in range(first, last + 1))


def test_region_against_a_plain_version():
    rnd, seen = random.Random(31), 0

    def text():
        return " ".join(rnd.choices(["lorem", "ipsum", "dolor", "sit", "amet"], k=rnd.choice((1, 2, 5, 30, 80))))

    def node(depth):
        kind = rnd.choice(["p", "p", "p", "h2", "ul", "div", "div"]) if depth < 4 else "p"
        if kind in ("p", "h2"):
            return [kind, ["a", text()]] if rnd.random() < 0.2 else [kind, text()]
        if kind == "ul":
            return ["ul", *(["li", ["a", text()]] if rnd.random() < 0.6 else ["li", text()] for _ in range(rnd.randint(1, 4)))]
        return ["div", *(node(depth + 1) for _ in range(rnd.randint(1, 5)))]

    def shown(n):
        return n if isinstance(n, str) else f"<{n[0]}>" + "".join(map(shown, n[1:])) + f"</{n[0]}>"

    for _ in range(400):
        tree = ["body", *(node(0) for _ in range(rnd.randint(1, 6)))]
        expected = plain_region(tree)
        assert html_text.main_text(shown(tree)) == expected, shown(tree)
        seen += 0 < len(expected) < len(re.sub("<[^>]*>", "", shown(tree)))
    assert seen > 100


def test_smoothing_and_threshold():
    assert html_text.smooth([1.0, 1.0, 1.0]).tolist() == pytest.approx([1.0] * 3) and html_text.smooth([0, 9, 0])[1] < 9
    assert 1 < html_text.threshold(np.array([1, 1, 1, 100, 100])) < 100 and html_text.threshold(np.array([5.0])) == pytest.approx(5)


# -- language -----------------------------------------------------------------------------------------------------------
def test_language_on_held_out_rows(spark):
    import zlib

    got = queries.op8_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark, odd):
    counts = [("en", "the", 50), ("en", "house", 5), ("de", "das", 50), ("de", "haus", 5)]
    m = language.Model(counts)
    assert m.predict([None, "", "123 !!", "the house", "DAS Haus", "thehouse"]) [0] == ["und", "und", "und", "en", "de", "en"]
    assert m.predict(["the"])[1][0] > 0.5 and language.Model([]).predict(["the"]) == (["und"], [0.0])
    got = by_id(language.identify(odd, m, keep=["doc_id", "ids"]))
    assert got[0].lang_pred == "und" and got[0].score == 0 and got[7].ids == "clash" and len(got) == len(TEXTS) + 1
    kept = language.accepted(odd, m)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({0, 1, 2})
    none = language.train(odd.withColumn("lang", F.lit(None).cast("string")), F.lit(True))
    assert none.langs == [] and language.identify(odd.limit(0), m).count() == 0
    assert language.train(odd.limit(0).withColumn("lang", F.lit("x")), F.lit(True)).langs == []


def test_training_keeps_all_counts_of_its_rows(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    name = lambda i: "".join(letters[i // 26**k % 26] for k in range(4))
    # many words of the first language by name, seen twice, and one rare language whose words are seen once
    rows = [(k, " ".join(name(i) for i in range(k // 2 * 2500, k // 2 * 2500 + 2500)) + f" {k}", "aa") for k in range(80)] + [(100, "ωκεανός θάλασσα", "zz")]
    m = language.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), F.lit(True))
    assert m.langs == ["aa", "zz"] and len(m.words.rows) == 100_000
    assert m.predict(["θάλασσα ωκεανός", name(7) + " " + name(99_999)])[0] == ["zz", "aa"]
    # the tables counted by executors are those of all counts at once
    few = [(1, "the house the home", "en"), (2, "das haus the hut", "de"), (3, None, "de"), (4, "12 !!", "fr")]
    counts = [("en", "the", 2), ("en", "house", 1), ("en", "home", 1), ("de", "das", 1), ("de", "haus", 1), ("de", "the", 1), ("de", "hut", 1)]
    m, plain = language.train(spark.createDataFrame(few, "doc_id bigint, text string, lang string"), F.lit(True)), language.Model(counts)
    assert m.langs == plain.langs == ["de", "en"]
    for a, b in zip([m.words, *m.grams], [plain.words, *plain.grams], strict=True):
        assert a.rows.keys() == b.rows.keys()
        assert all(a.logs[a.rows[t]] == pytest.approx(b.logs[b.rows[t]]) for t in a.rows)


class PlainLanguage:
    """Words first, then the longest n-grams of which any is known, counted and scored one by one. rows: (lang, text)."""

    def __init__(self, rows):
        self.langs = sorted({lang for lang, _ in rows})
        count = {lang: Counter() for lang in self.langs}
        for lang, t in rows:
            for w in re.findall(r"[^\W\d_]+", t.lower()):
                for keys in self.levels(w):
                    count[lang].update(keys)
        total = sum(count.values(), Counter())
        known = [k for k, n in total.items() if n > 1]
        size = Counter()
        for n, text in known:
            for lang in self.langs:
                size[n, lang] += count[lang][n, text] + 0.5
        self.logs = {}
        for key in known:
            x = [math.log((count[lang][key] + 0.5) / size[key[0], lang]) for lang in self.langs]
            self.logs[key] = [v - sum(x) / len(x) for v in x]

    @staticmethod
    def levels(word):
        """The word, then its n-grams, the longest first."""
        marked = f"\x02{word}\x03"
        return [[(0, word)], *([(n, g[i : i + n]) for i in range(len(g) - n + 1)] for n in range(5, 0, -1) for g in (marked if n > 1 else word,))]

    def __call__(self, text):
        score = [0.0] * len(self.langs)
        for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
            found = next((f for f in ([k for k in level if k in self.logs] for level in self.levels(w)) if f), [])
            for k in found:
                score = [s + x / len(found) for s, x in zip(score, self.logs[k], strict=True)]
        p = [math.exp(s - max(score)) for s in score]
        return self.langs[score.index(max(score))], max(p) / sum(p)


def test_language_scores_by_force(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    docs = table.where("lang IS NOT NULL AND text IS NOT NULL").orderBy("doc_id").limit(30)
    rows = [(r.lang, t) for r in docs.select("lang", "text").distinct().collect() for t in (r.text,)]
    m = language.train(docs, F.lit(True))
    texts = ["die schule the tion", "xqz", "Bonjour le monde", *(t[:60] for _, t in rows[:6])]
    langs, scores = m.predict(texts)
    plain = PlainLanguage(rows)
    for t, lang, score in zip(texts, langs, scores, strict=True):
        assert (lang, score) == (plain(t)[0], pytest.approx(plain(t)[1], abs=1e-9))


def test_training_bound_holds_for_copies_and_null_ids(spark):
    rows = [(None, f"text number {'abcdefghij'[i % 10]} {i}", "en") for i in range(300)] + [(5, "one and the same", "en")] * 300 + [(None, "das haus am see", "de")] * 20 + [(1, "el rio grande", "es")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = Counter(r.lang for r in language.sample(df, F.lit(True), "text", "lang", 50).collect())
    assert got["de"] == got["es"] == 1 and 20 < got["en"] < 90


def test_a_rare_language_beside_a_frequent_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang IS NOT NULL AND text IS NOT NULL")
    names = [r.lang for r in docs.groupBy("lang").count().orderBy(F.desc("count")).collect()]
    rare = names[1]
    few = docs.where(F.col("lang") == rare).orderBy("doc_id").limit(20)
    m = language.train(docs.where(F.col("lang") != rare).unionAll(few), F.lit(True))
    rest = docs.where(F.col("lang") == rare).orderBy(F.desc("doc_id")).limit(80)
    got = [r.lang_pred for r in language.identify(rest, m).collect()]
    assert got.count(rare) >= 76


# -- secrets ------------------------------------------------------------------------------------------------------------
def plain_spans(text):
    """The patterns as given, leftmost and non-overlapping for each kind, failing ones dropped afterwards."""
    word = "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
    out = []
    for m in re.finditer(rf"""({word})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 6 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


CASES = [
    "password=abc", "PassWord: 'hunter22'", "token: token = abcdefgh", "secret: passwd=zzzzzzz", "api_key=\"A.b/c+d==\" APIKEY = xyz123", "AKIA" + "A1" * 8, "AKIAAKIA" + "Z" * 11, "AKIAAKIA" + "Z" * 12, "é" * 3 + "0123456789abcdef01234567", "0123456789abcdef0123456",
    "paſſword=abcdefgh", "toKen=abcdefgh", "token=" + "a" * 50_000, "x" * 50_000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans(text):
    assert secrets.base_spans(text) == plain_spans(text)


def test_secret_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionAll(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*CASES, None, ""])], "doc_id bigint, text string"))
    model = secrets.train(docs)
    got = by_id(secrets.scan(docs, model))
    for r in docs.collect():
        spans = plain_spans(r.text or "")
        g, told = got[r.doc_id], ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans)
        assert g.base_spans == told and [g.n_assign, g.n_access, g.n_hex] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert set(told.split(",")) <= {*g.spans.split(","), ""}
    cleaned = by_id(secrets.mask(docs, model))
    assert cleaned[10**6 + 1].text == "[SECRET]'" and cleaned[10**6 + 14].text is None and cleaned[10**6 + 13].text == "x" * 50_000
    assert not any(secrets.base_spans(r.text or "") for r in cleaned.values())
    assert secrets.scan(docs.limit(0), secrets.train(docs.limit(0))).count() == 0


def plain_markov(text, model):
    """Runs of 16 identifier characters and up to two equals signs, scored pair by pair."""
    out, i = [], 0
    allowed = set(string.ascii_letters + string.digits + "+/_-")
    while i < len(text):
        j = i
        while j < len(text) and text[j] in allowed:
            j += 1
        e = j
        while e < min(len(text), j + 2) and text[e] == "=":
            e += 1
        ratio = sum(model.ratio[secrets.ALPHABET.index(x), secrets.ALPHABET.index(y)] for x, y in zip(text[i:e], text[i + 1 : e], strict=False))
        if j - i >= 16 and ratio > model.threshold:
            out.append((i, 3, e))
        i = max(i + 1, j)
    return out


def test_markov_models():
    words = "house garden window letter number market people mountain river winter summer".split()
    m = secrets.Model(secrets.transitions(secrets.identifiers(words * 500, "x")))
    rnd = random.Random(77)
    assert m.recall > 0.95
    odd = [secrets.random_string(rnd) for _ in range(300)]
    plain = [x for x in secrets.identifiers(["house", "garden", "window", "letter"] * 300, "y") if len(x) >= 16]
    assert sum(m.score(s) > m.threshold for s in odd) > 285 and sum(m.score(s) > m.threshold for s in plain) < len(plain) / 50
    text = "key Zx9QpL2mVt7RkW4bNc8H and someOrdinaryIdentifier2024 qzxkvjwqpfhgtbnmxr house-of-cards-and-letters token=Zx9QpL2mVt7RkW4bNc8H+/9== 4929348385146306"
    base, spans = secrets.find_spans(text, m)
    assert [text[s:e] for s, k, e in spans if k == 3] == ["Zx9QpL2mVt7RkW4bNc8H", "qzxkvjwqpfhgtbnmxr", "Zx9QpL2mVt7RkW4bNc8H+/9=="]
    assert set(base) <= set(spans) and spans == sorted(base + plain_markov(text, m))
    counts = secrets.transitions(["abca", "bc"])
    pairs = Counter(p for s in ("abca", "bc") for p in zip(s, s[1:], strict=False))
    assert {(secrets.ALPHABET[i], secrets.ALPHABET[j]): counts[i, j] for i, j in zip(*counts.nonzero(), strict=True)} == pairs
    assert secrets.masked("ab12cd", [(1, 0, 3), (2, 2, 4)]) == "a[SECRET]cd"


def test_markov_spans_of_the_query(spark):
    """Trained on the documents: finds their hexadecimal tokens without the patterns' help, and no ordinary word or number."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    model, rnd = secrets.train(docs), random.Random(5)
    odd = [secrets.random_string(rnd) for _ in range(200)]
    assert sum(model.score(x) > model.threshold for x in odd) >= 190
    planted = spark.createDataFrame([(10**7 + i, f"see {x} there") for i, x in enumerate(odd)], "doc_id bigint, text string")
    got = by_id(secrets.scan(docs.unionAll(planted), model))
    found = {n: {tuple(x.split(":")[1:]) for x in r.spans.split(",") if x.startswith("markov")} for n, r in got.items()}
    for r in docs.collect():
        hexes = {(str(s), str(e)) for s, k, e in plain_spans(r.text or "") if k == 2}
        assert hexes <= found[r.doc_id] and len(found[r.doc_id] - hexes) == 0
        assert found[r.doc_id] == {(str(s), str(e)) for s, _, e in plain_markov(r.text or "", model)}
    hits = sum((str(4), str(4 + len(x))) in found[10**7 + i] for i, x in enumerate(odd))
    assert hits >= 185


def test_training_takes_copies_once(spark):
    docs = spark.createDataFrame([(None, "the house of the people and the river " * 20)] * 500 + [(1, None), (2, "")], "doc_id bigint, text string")
    one = secrets.train(docs.limit(1))
    assert (secrets.train(docs).ratio == one.ratio).all() or secrets.train(docs).threshold >= secrets.LEAST


def test_training_reads_every_text_once(spark, monkeypatch):
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choices("abcdefghijklmno"[i % 9 :], k=rnd.randint(2, 9))) for _ in range(12)) + (" password=Abc1234567 and more words" if i % 5 == 0 else "") for i in range(1500)]
    df = spark.createDataFrame([(t,) for i, t in enumerate(texts) for _ in range(700 if i == 7 else 1 + i % 3)] + [(None,), ("",)], "text string")
    halves = {r.text: r.half for r in df.where("text <> ''").select("text", F.expr("pmod(shiftright(xxhash64(text), 40), 2)").alias("half")).distinct().collect()}
    made = {t: secrets.ordinary(t) for t in halves}
    assert sorted(halves) == sorted(set(texts)) and not any("password" in x.lower() for own in made.values() for x in own) and any("more" in x.lower() for own in made.values() for x in own)
    counts = [sum(secrets.transitions(made[t]) for t in texts if halves[t] == h) for h in (0, 1)]
    plain, others = secrets.Model(counts[0] + counts[1]), [secrets.Model(counts[1]), secrets.Model(counts[0])]
    scores = sorted((math.ceil(others[halves[t]].score(x)) for t in texts for x in made[t]), reverse=True)
    expected = max(secrets.LEAST, scores[int(secrets.FALSE_ALARMS * len(scores))])
    for most in (secrets.BROADCAST_COPIES, 0):
        monkeypatch.setattr(secrets, "BROADCAST_COPIES", most)
        model = secrets.train(df)
        assert (model.ratio == plain.ratio).all() and model.threshold == expected
