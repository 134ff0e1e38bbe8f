"""Each operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
import xxhash
import zstandard
from pyspark.sql import functions as F

from spindrift.llm import bpe, decontaminate, html_extract, line_dedup, nbsvm, ngram_lm, shared, simhash, substring_dedup, toxicity, transport_stream
from spindrift.llm.queries import ranks_path
from spindrift.llm.shared import Words, text_chunks

RNG = random.Random(11)
VOCABULARY = ["".join(RNG.choice("abcdefgh") for _ in range(RNG.randint(1, 6))) for _ in range(60)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, then columns whose names clash with outputs)."""
    shared, line = prose(40), "this line stands in many documents"
    texts = [None, "", " \n\t ", "one", "ONE", prose(3), prose(4), shared, shared.upper(), prose(5) + " " + shared + " " + prose(6), prose(2_000) + "\n" + line, "été 中文 🙂 don't", "x" * 3_000]
    texts += [prose(RNG.randint(1, 80)) + "\n" + line + "\n" + RNG.choice(["short", "  This LINE stands in many documents\t", prose(9)]) for _ in range(25)]
    texts += [shared + " " + prose(3), shared, texts[20], texts[20]]
    return [(i, t, "clash", "src", len(t or ""), 1) for i, t in enumerate(texts)]


ROWS = corpus()
SCHEMA = "doc_id bigint, text string, score string, source string, n_tokens int, fp int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and repeated rows."""
    return spark.createDataFrame([(None, "a b c d e", "x", None, 1, 1), (None, None, "x", None, 1, 1), (7, "a b c d e", "x", None, 1, 1), (7, "a b c d e", "x", None, 1, 1)], SCHEMA)


def words(t):
    return (t or "").encode().split()


def held(i, m):
    return zlib.crc32(str(i).encode()) % m == 2


# 1 ---------------------------------------------------------------------------------------------


def test_html():
    page = "<html><head><title>t</title><style>p{}</style><script>var a='</p>';</script></head><body><nav><a href='/a'>Home</a></nav><div class=\"ad\">Buy now</div><article><h1>Big  news &amp; more</h1><p>One two\n three<b> four</b>.</p><p>Last<br>line</p></article><div id='comments'><p>I agree with this very much and so on.</p></div><aside>Read also</aside><form>name</form><footer>&copy; us</footer></body></html>"
    assert html_extract.main_text(page) == "Big news & more\nOne two three four.\nLast line"
    assert html_extract.main_text(None) == ""
    assert html_extract.main_text("<p") == "" or isinstance(html_extract.main_text("<p"), str)
    assert html_extract.main_text("<article><p>a <!-- x --> b<p>c") == "a b\nc"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<nav><a>Home</a></nav><article><h1>T</h1><p>Plain <a>%s</a></p><p>End</p></article>", "T\nPlain %s\nEnd"),
        ("<article><p>%s</p><ul><li><a>One link</a></li><li>See <a>another of these links</a></li></ul><p>Then.</p></article>", "%s\nOne link\nSee another of these links\nThen."),
        ("<article><div id='related-work'><h2>Related work</h2><p>%s</p></div></article>", "Related work\n%s"),
        ("<article><p>%s</p><div class='article-share'><a>Share</a></div><div class='comment-list'><p>I agree with all that was said here and so does he.</p></div></article>", "%s"),
        ("<div><a>Start</a> <a>Shop</a></div><div><h1>Title here</h1><p>%s</p><p>%s</p></div><div>All rights reserved</div>", "Title here\n%s\n%s"),
    ],
)
def test_html_names_alone_decide_nothing(page, want):
    text = prose(40)
    assert html_extract.main_text(page.replace("%s", text)) == want.replace("%s", text)


def known_page(rng):
    """(page, text of each block, whether it is of the article) from parts in random order."""
    say = lambda a, b: " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(a, b)))
    out = []
    add = lambda form, n, label: out.append((form, [say(*n)], label))
    semantic = rng.random() < 0.5
    for _ in range(rng.randint(1, 3)):
        add(rng.choice(["<nav><a>%s</a></nav>", "<div class='navbar'><a>%s</a></div>"] if semantic else ["<div><a>%s</a></div>", "<ul><li><a>%s</a></li></ul>"]), (1, 4), False)
    body = []
    for i in range(rng.randint(2, 9)):
        body.append((rng.choice(["<p>%s</p>", "<div>%s</div>", "<p><b>%s</b></p>", "<blockquote>%s</blockquote>"]), [say(25, 90) if not semantic or rng.random() < 0.7 else say(1, 12)], True))
    body.insert(0, ("<h1>%s</h1>", [say(2, 9)], True))
    out += [("<article>", [], None), *body, ("</article>", [], None)] if semantic else body
    for _ in range(rng.randint(1, 3)):
        add(rng.choice(["<footer>%s</footer>", "<aside><p>%s</p></aside>", "<div class='comments'><p>%s</p></div>"] if semantic else ["<div><a>%s</a></div>", "<div>%s</div>"]), (2, 8), False)
    return "".join(f.replace("%s", t[0]) if t else f for f, t, _ in out), [(t[0], y) for _, t, y in out if t]


def test_html_precision_and_recall():
    """Of words in pages built with known answers, half of them without telling elements: measured 1.00 and 0.99."""
    rng, right, got, truth = random.Random(6), 0, 0, 0
    for _ in range(400):
        page, parts = known_page(rng)
        kept = Counter(html_extract.main_text(page).split())
        want = Counter(w for t, y in parts if y for w in t.split())
        right, got, truth = right + (kept & want).total(), got + kept.total(), truth + want.total()
    print(right / got, right / truth)
    assert right / got > 0.98 and right / truth > 0.98


def test_html_long_and_deep():
    deep = "<div>" * 20_000 + "<p>" + prose(50) + "</p>" + "</div>" * 20_000
    assert html_extract.main_text("<article>" + deep + "</article>").count(" ") == 49
    assert html_extract.main_text("<article>" + f"<p>{prose(30)}</p>" * 5_000 + "</article>").count("\n") == 4_999


def test_html_tree_generalises_from_its_table():
    """Leaves hold several blocks, so the table is not learnt by heart: measured 0.996."""
    x, y = html_extract.labelled_table()
    assert 0.99 <= ((html_extract.tree().predict(x) >= 0.5) == y).mean() <= 1 and len(y) > 700


LONG = "The council met on Tuesday evening to weigh a plan for the river bank, and most of those who spoke asked for more time before any tree is felled."


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><p>%s</p></article><ol><li class='comment'><p>I like this very much and so do all my friends here in town.</p></li><li class='comment'>Me too</li></ol>", "%s"),
        ("<article><p>%s</p><ol><li class='comment'><div><p>I like this very much and so do all my friends.</p></div></li></ol></article>", "%s"),
        ("<ol><li class='comment'><p>%s</p></li></ol>", ""),
        ("<article><h1>T</h1><p>%s</p></article><div><a href='/x'><h3>Teaser of another story</h3><p>Many words of teaser text that belong to another story and that nobody wants to see in here.</p></a></div>", "T\n%s"),
        ("<article><p>x y z.</p></article>", "x y z."),
        ("<article><p>Only three words</p></article>", "Only three words"),
        ("<article><h1>News</h1><pre>code here and there</pre><p>It is done now and all is well with it.</p></article>", "News\ncode here and there\nIt is done now and all is well with it."),
        ("<article><p>%s</p><ul><li><p>First point is cost.</p></li></ul></article>", "%s\nFirst point is cost."),
        ("<p>%s<embed src='x'><p>%s", "%s\n%s"),
        ("<div><h1>Title</h1><table><tr><th>Year<th>Cost<tr><td>1999<td>12 pounds</table><p>%s</p></div>", "Title\nYear\nCost\n1999\n12 pounds\n%s"),
        ("<article><p>%s</article></div></section><p title='a > b'>%s</p><aside><ul><li><p>Read also this</p></li></ul></aside>", "%s"),
    ],
)
def test_html_nested_hints_links_and_short_articles(page, want):
    got = html_extract.main_text(page.replace("%s", LONG))
    assert got == want.replace("%s", LONG) or (want == "%s" and got == f"{LONG}\n{LONG}")


@pytest.mark.parametrize("unit", ['<a "', "<a x ", '<a b="', "<a b='x> ", "<svg>", "<title>", "<![CDATA[", "<!--", "<li>", "<p>", "<td>", "<", "&", "</section>", "<div>", "<a = ", "<b/ "])
def test_html_hostile_pages_are_linear(unit):
    """A megabyte in under five seconds (measured: under one)."""
    began = time.perf_counter()
    html_extract.main_text(unit * ((1 << 20) // len(unit)))
    html_extract.main_text("<div>" * 20_000 + unit * 20_000 + "</section>" * 20_000)
    assert time.perf_counter() - began < 5


class PlainBlocks(HTMLParser):
    """The block cutter once more, for well-formed pages, with the standard library's parser and a list of the open elements."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks, self.open, self.text, self.linked = [], [], "", ""

    def end(self):
        if self.text.split():
            inside = [t for t, _ in self.open]
            names = [html_extract._hint(" ".join(f'{k}="{v}"' for k, v in a)) for t, a in self.open if t not in ("html", "body", "main", "article")]
            self.blocks.append((" ".join(self.text.split()), len(self.linked.split()), max(names, default=0), any(t in ("article", "main") for t in inside)))
        self.text = self.linked = ""

    def handle_starttag(self, tag, attrs):
        if tag != "a":
            self.end()
        self.open.append((tag, attrs))

    def handle_endtag(self, tag):
        if tag != "a":
            self.end()
        assert self.open.pop()[0] == tag

    def handle_data(self, data):
        self.text += data
        self.linked += " " + data if any(t == "a" for t, _ in self.open) else ""


def random_page(rng, depth=0):
    if depth > 4 or rng.random() < 0.3:
        word = " ".join(rng.choice(VOCABULARY) for _ in range(rng.randint(0, 6)))
        return word + rng.choice(["", " ", " &amp; x", "\n", "&lt;b&gt;"])
    if rng.random() < 0.2:
        return f"<a href='x > y'>{random_page(rng, 5)}</a>"
    tag = rng.choice(["div", "section", "ul", "article", "nav", "aside", "main", "blockquote", "table"])
    attributes = rng.choice(["", " class='comment-list'", ' id="related-work"', " class='x y'", " data-x='a>b'"])
    return f"<{tag}{attributes}>" + "".join(random_page(rng, depth + 1) for _ in range(rng.randint(0, 4))) + f"</{tag}>"


def test_html_blocks_against_a_second_cutter():
    rng = random.Random(9)
    for _ in range(400):
        page = random_page(rng)
        plain = PlainBlocks()
        plain.feed(page)
        plain.close()
        plain.end()
        assert [(b.text, b.links, b.hint, b.article) for b in html_extract.blocks_of(page)] == plain.blocks, page


def test_html_long_attribute_is_linear():
    assert html_extract.main_text("<article><p>a</p><div title=\"" + "x" * 200_000 + "<p>b") is not None


def test_html_query_shape(spark):
    df = spark.createDataFrame([(1, "u", "<article><p>Hi there</p></article>", "t"), (None, None, None, "t"), (1, "u", "", "t")], "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html_extract.extract(df).collect())
    assert got == [(0, "", 0), (1, "", 0), (1, "Hi there", 8)]
    assert html_extract.extract(df.where("false")).count() == 0


# 2 ---------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, docs, empty, odd):
    import public_tokenizers

    own = bpe.coder(ranks_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode_texts(docs, ranks_path()).collect()}
    for i, t, *_ in ROWS:
        ids = library.encode_ordinary(t or "")
        r = got[i]
        assert list(r.ids) == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        raw = (t or "").encode()
        starts = [*r.byte_starts, len(raw)]
        assert [raw[a:b] for a, b in zip(starts, starts[1:], strict=False)] == [library.decode_single_token_bytes(x) for x in ids]
    assert bpe.encode_texts(empty, ranks_path()).count() == 0
    assert bpe.encode_texts(odd, ranks_path(), ids=False).count() == 4


def test_bpe_random_pieces():
    import public_tokenizers

    own = bpe.coder(ranks_path())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    alphabet = "ab st re ve ll ''' \n\n\t  x1２ éß中文🙂!?.,  \x1c\x85"
    texts = ["".join(RNG.choice(alphabet) for _ in range(RNG.randint(0, 70))) for _ in range(1500)]
    for first, end, data, offsets in text_chunks(pa.array(texts), 5_000):
        ids, at = own.encode(data, offsets)
        for i in range(first, end):
            assert ids[at[i - first] : at[i - first + 1]].tolist() == library.encode_ordinary(texts[i]), repr(texts[i])


# 3 and 8 ---------------------------------------------------------------------------------------


def labelled(n: int = 400) -> list[tuple[int, str, int]]:
    bad = ["vileword", "nastyterm", "awfulname"]
    out = []
    for i in range(n):
        t = [RNG.choice(VOCABULARY) for _ in range(RNG.randint(20, 80))]
        y = int(i % 4 == 0)
        if y:
            for _ in range(4):
                t[RNG.randrange(len(t))] = RNG.choice(bad)
        out.append((i, " ".join(t), y))
    return out


def test_toxicity(spark, empty):
    rows = labelled()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9_001, None), (9_002, ""), (None, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 0, y) for i, _, y in rows] + [(0, None, None), (None, 1, 1), (9_999, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.score_texts(docs, model).collect()}
    assert len(got) == len(rows) + 3
    tested = [(got[i].predicted, y) for i, _, y in rows if held(i, 4)]
    assert all(got[i].held_out == held(i, 4) for i, _, _ in rows)
    assert np.mean([p == y for p, y in tested]) > 0.95
    assert got[9_001].score == got[9_002].score and 0 <= got[9_001].score < 0.3
    kept = {r.doc_id for r in toxicity.drop_toxic(docs, model).collect()}
    assert kept == {i for i, r in got.items() if not r.predicted}
    none = toxicity.fit(docs, labels.where("false"))
    assert {round(r.score, 6) for r in toxicity.score_texts(docs, none).collect()} == {0.5}
    assert toxicity.score_texts(empty, model).count() == 0


def plain_toxicity(model, text):
    """The score of one text, a window at a time, by the library alone."""
    made = []
    for content in (model.ordinary, model.toxic):
        log = (toxicity.WIDTH * max(len(model.ordinary), len(model.toxic))).bit_length()
        setting = zstandard.ZstdCompressionParameters(window_log=max(17, log + 1), hash_log=max(16, log), chain_log=max(16, log), search_log=9, min_match=6, target_length=256, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)
        own = zstandard.ZstdCompressionDict(b"".join(toxicity.SPREAD[c].tobytes() for c in content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        made.append(zstandard.ZstdCompressor(dict_data=own, compression_params=setting))
    windows = [b" " + w + b" " for w in (text or "").encode().lower().split()]
    lengths = [[len(c.compress(b"".join(toxicity.SPREAD[x].tobytes() for x in w))) for c in made] for w in windows]
    hits = sum(a - b >= model.threshold for a, b in lengths)
    z = model.weights[0] + model.weights[1] * math.log1p(hits) + model.weights[2] * hits / max(1, len(windows))
    return 1 / (1 + math.exp(-min(30, max(-30, z))))


def test_toxicity_equals_plain_windows(spark):
    model = toxicity.train([(t.encode(), y) for _, t, y in labelled()])
    texts = [None, "", " \n ", "vileword", "VILEWORD a", prose(300) + " vileword " + prose(20_000) + " nastyterm", "x" * 200_000, prose(9), prose(9) + " awfulname", "a b", "a b"]
    extra = spark.createDataFrame([(i % 9, t, "s", "p", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, score string, predicted string, held_out int")
    got = sorted((r.doc_id, r.score) for r in toxicity.score_texts(extra, model).collect())
    want = sorted((i % 9, plain_toxicity(model, t)) for i, t in enumerate(texts))
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want])
    assert toxicity.drop_toxic(extra, model).columns == extra.columns


def test_toxicity_dictionaries_are_trained_by_zstandard(monkeypatch):
    seen, trainer = [], zstandard.train_dictionary
    monkeypatch.setattr(zstandard, "train_dictionary", lambda size, samples, **k: seen.append(samples) or trainer(size, samples, **k))
    rng = random.Random(2)
    bad = [f"vile{c}{d}thing" for c in "abcdef" for d in "ghijkl"]
    rows = [(" ".join(rng.choices(VOCABULARY, k=120) + (rng.choices(bad, k=12) if i % 3 == 0 else [])).encode(), int(i % 3 == 0)) for i in range(600)]
    model = toxicity.train(rows)
    assert len(seen) == 2 and len(seen[0]) == 400 and len(seen[1]) == 200
    assert model.ordinary[:4] == model.toxic[len(model.ordinary) :][:4] == b"\x37\xa4\x30\xec"  # the mark of a trained dictionary


def test_samples_are_bounded_before_they_move(spark):
    """Long texts come last, repeated rows count once, texts and bytes are bounded."""
    rows = [(i, "x" * 1_000) for i in range(400)] + [(i, "y" * 9_000) for i in range(400, 440)] + [(3, "x" * 1_000)] * 50 + [(None, "z")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i >= 400)) for i in range(480)] + [(7, None), (None, 1)], "doc_id bigint, toxic int")
    sample = lambda n, b: shared.labelled_sample(docs, labels, "doc_id", "text", "toxic", n, b, 2_000)
    got, share = sample(1_000, 1 << 30)
    free = [i for i in range(440) if not held(i, 4)]
    assert len(got) == len(free) and sum(y for _, y in got) == sum(i >= 400 for i in free)
    assert share == pytest.approx(sum(i >= 400 for i in range(480) if not held(i, 4)) / sum(not held(i, 4) for i in range(480)))
    few, _ = sample(5, 1 << 30)
    assert sum(not y for _, y in few) == 5 and 1 <= sum(y for _, y in few) <= 5  # half of the ids labelled 1 have no text
    tight, _ = sample(1_000, 40_000)
    assert sum(len(t) for t, y in tight if not y) <= 20_000 and sum(len(t) for t, y in tight if y) == 18_000


def test_toxicity_never_reads_ids():
    model = toxicity.train([(t.encode(), y) for _, t, y in labelled()])
    one = pa.array(["vileword nastyterm vileword awfulname"] * 2)
    assert len(set(model.score(one).tolist())) == 1 and model.score(one)[0] > 0.5


def test_quality(spark, empty):
    rows = [(i, t if not y else " | ".join(t.split()) + " $$$", 1 - y) for i, t, y in labelled()]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(9_001, None), (None, "a b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(0, None, None)], "doc_id bigint, quality int, toxic int")
    model = nbsvm.fit(docs, labels)
    got = {r.doc_id: r for r in nbsvm.score_texts(docs, model).collect()}
    assert np.mean([got[i].predicted == y for i, _, y in rows if held(i, 4)]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert nbsvm.score_texts(empty, model).count() == 0
    assert {r.score for r in nbsvm.score_texts(docs, nbsvm.fit(docs, labels.where("quality = 1"))).collect()} != {0.5}


def test_quality_equals_plain_scores(spark):
    """Log-count ratios and whole scores against n-grams taken one by one."""
    rows = [(t if not y else " | ".join(t.split()) + " $$$", 1 - y) for _, t, y in labelled(120)]
    model = nbsvm.train([t.encode() for t, _ in rows], [y for _, y in rows])
    size = 1 << nbsvm.BITS

    def grams(t):
        raw = (t or "").encode()
        (_, _, data, offsets), = text_chunks(pa.array([t or ""])) if raw else (((0, 1, np.zeros(0, np.uint8), np.zeros(2, np.int64))),)
        h = Words(data, offsets).hashes().tolist()
        mix = lambda x: int(shared.mix64(np.array([x % (1 << 64)], np.uint64))[0])
        salt = [int(x) for x in nbsvm._SALT]
        out = {int.from_bytes(raw[i : i + 3], "little") * salt[0] % (1 << 64) for i in range(len(raw) - 2)}
        out |= {mix(int.from_bytes(raw[i : i + 4], "little") + salt[1]) for i in range(len(raw) - 3)}
        out |= {mix(x + salt[2]) for x in h}
        out |= {mix((salt[3] if a == b else mix(a * salt[2] + b)) + salt[3]) for a, b in zip(h, h[1:], strict=False)}
        return sorted({x >> (64 - nbsvm.BITS) for x in out})

    counts = np.ones((2, size))
    for t, y in rows:
        counts[y][grams(t)] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    assert np.allclose(model.ratio, ratio, atol=1e-5)
    texts = [None, "", rows[0][0], rows[1][0], "a a a", prose(30_000), "x" * 100_000, rows[0][0]]
    got = sorted((r.doc_id, r.score) for r in nbsvm.score_texts(spark.createDataFrame([(i % 7, t, "s", "q") for i, t in enumerate(texts)], "doc_id bigint, text string, score string, predicted string"), model).collect())
    want = []
    for i, t in enumerate(texts):
        x = grams(t)
        margin = model.weight[x].astype(float).sum() / (math.sqrt(float(np.square(ratio[x]).sum())) or 1.0) + model.bias
        want.append((i % 7, 1 / (1 + math.exp(-(model.slope * margin + model.level)))))
    assert [i for i, _ in got] == [i for i, _ in sorted(want)] and np.allclose([s for _, s in got], [s for _, s in sorted(want)], atol=1e-4)


def test_dual_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 5))
    y = np.sign(x @ np.array([1.0, -2, 0.5, 0, 0]) + 0.1 * rng.normal(size=60))
    rows = [(np.arange(5), r) for r in x]
    w, b = nbsvm.descend(rows, y, 5, np.full(60, 1.0), epochs=500)
    loss = lambda w, b: 0.5 * (w @ w + b * b) + np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    for _ in range(300):
        assert loss(w + 0.01 * rng.normal(size=5), b + 0.01 * rng.normal()) >= best - 1e-6


# 4 ---------------------------------------------------------------------------------------------


def check_lm(rows, got):
    tokens = {i: (t or "").encode().lower().split() + [None] for i, t, *_ in rows}
    c, pairs = Counter(), Counter()
    for i, t, *_ in rows:
        if not held(i, 7):
            c.update(tokens[i])
            pairs.update(zip([0, *tokens[i][:-1]], tokens[i], strict=True))
    n, v = sum(c.values()), len(c)
    for i, *_ in rows:
        r, ts = got[i], tokens[i]
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held(i, 7), len(ts), n, sum(c[w] > 0 for w in ts))
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ts))
        want = sum(math.log10((pairs[u, w] + ngram_lm.MU * (c[w] + 1) / (n + v + 1)) / ((c[None] if u == 0 else c[u]) + ngram_lm.MU)) for u, w in zip([0, *ts[:-1]], ts, strict=True))
        assert r.score == pytest.approx(want, abs=2e-4 * len(ts))


def test_lm(docs):
    check_lm(ROWS, {r.doc_id: r for r in ngram_lm.score_texts(docs).collect()})


def test_lm_many_shards_and_hot_words(docs):
    check_lm(ROWS, {r.doc_id: r for r in ngram_lm.score_texts(docs, block_bytes=4_000, shard_tokens=300).collect()})


def test_lm_edges(spark, empty, odd):
    assert ngram_lm.score_texts(empty).count() == 0
    assert ngram_lm.score_texts(odd).count() == 4
    one = spark.createDataFrame([(next(i for i in range(100) if held(i, 7)), "a b")], "doc_id bigint, text string")
    assert ngram_lm.score_texts(one).first().base_score == 0.0


def test_lm_sums_to_one(spark):
    """Over the known words and one unknown, probabilities after a context add up to one."""
    rows = [(i, "a b a c b a") for i in range(10) if not held(i, 7)]
    n = len(rows)
    c = Counter({"a": 3 * n, "b": 2 * n, "c": n, None: n})
    total = sum(c.values())
    after = Counter({"b": n, "c": n, None: n})
    p = lambda k, w: (k + ngram_lm.MU * (c[w] + 1) / (total + 5)) / (c["a"] + ngram_lm.MU)
    assert sum(p(after[w], w) for w in ("a", "b", "c", None)) + ngram_lm.MU / (total + 5) / (c["a"] + ngram_lm.MU) == pytest.approx(1)


def test_elias_fano():
    rng = np.random.default_rng(2)
    for n, bits in ((0, 8), (1, 8), (200, 8), (3_000, 40), (500, 64)):
        v = np.unique(rng.integers(0, (1 << bits) - 1, n, dtype=np.uint64, endpoint=True))
        ef = ngram_lm.EliasFano(v, bits)
        assert (ef.find(v) == np.arange(len(v))).all()
        if len(v):
            assert (ef.get(np.arange(len(v))) == v).all()
            probe = rng.integers(0, (1 << bits) - 1, 300, dtype=np.uint64, endpoint=True)
            assert ((ef.find(probe) >= 0) == np.isin(probe, v)).all()


# 5 ---------------------------------------------------------------------------------------------


def plain_removal(rows):
    first, out = {}, {}
    for i, t, *_ in rows:
        ws = words(t)
        for j in range(len(ws) - 12):
            w = tuple(ws[j : j + 13])
            first[w] = min(i, first.get(w, i))
    for i, t, *_ in rows:
        ws = words(t)
        gone = set()
        for j in range(len(ws) - 12):
            if first[tuple(ws[j : j + 13])] < i:
                gone.update(range(j, j + 13))
        kept = b" ".join(w for j, w in enumerate(ws) if j not in gone)
        out[i] = (len(ws), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


@pytest.mark.parametrize("common", [2_000, 1])
def test_substring_dedup(docs, common, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 3_000)
    monkeypatch.setattr(substring_dedup, "COMMON", common)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.text) for r in substring_dedup.remove_repeats(docs).collect()}
    want = plain_removal(ROWS)
    assert got == want
    assert sum(v[1] for v in want.values()) > 100


@pytest.mark.parametrize("most", [20, 60, 10_000])
def test_substring_automata_find_every_occurrence(most, monkeypatch):
    """Passages' words alone, in shards of any size, against a plain search; documents part matches, passages may hold others or be told twice."""
    monkeypatch.setattr(substring_dedup, "SHARD_WORDS", most)
    rng = random.Random(most)
    say = lambda n: [rng.choice(["a", "bb", "c"]) for _ in range(n)]
    docs = [say(rng.randint(0, 60)) for _ in range(30)]
    docs[3], docs[4] = docs[5][:20], docs[5][5:30] + ["dd"]
    passages = [d[i : i + n] for d in docs for n in (13, 15) for i in range(0, len(d) - n, 9)]
    passages += [passages[0], passages[1][:13]]
    runs = [[1] * (len(w) - 13) + [1] for w in passages]
    told = pa.table({"words": pa.array([" ".join(w).encode() for w in passages]), "owners": pa.array([[7 * i + k for k in range(len(r))] for i, r in enumerate(runs)], pa.list_(pa.int64())), "runs": pa.array(runs, pa.list_(pa.int32()))})
    data = np.frombuffer("".join(" ".join(d) + "\n" for d in docs).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(" ".join(d)) + 1 for d in docs])
    text = Words(data, offsets)
    got, base, shards = [], 0, 0
    packs = pa.table({"pack": pa.array([substring_dedup._packed(b) for b in told.to_batches(max_chunksize=7)], pa.binary())})
    for shard, owners, edges in substring_dedup._shards(packs):
        row, at = shard.occurrences(text, text.hashes())
        got += list(zip((row + base).tolist(), at.tolist(), strict=True))
        assert [owners[a:b].tolist() for a, b in zip(edges[:-1], edges[1:], strict=True)] == told["owners"].to_pylist()[base : base + len(edges) - 1]
        base, shards = base + len(edges) - 1, shards + 1
    first = np.cumsum([0] + [len(d) for d in docs])
    want = [(p, first[d] + i) for p, w in enumerate(passages) for d, t in enumerate(docs) for i in range(len(t) - len(w) + 1) if t[i : i + len(w)] == w]
    assert sorted(got) == sorted(want) and base == len(passages) and (shards > 1) == (most < 100)


def null_and_repeated():
    """Half of the rows without an id, a third of them under one id, passages shared by all."""
    shared = prose(30)
    return [(None if i % 2 else 7 if i % 3 == 0 else 100 + i, f"{prose(8)} {shared if i % 4 else prose(20)} {prose(20)}") for i in range(90)]


def test_substring_dedup_null_and_repeated_ids(spark, monkeypatch):
    """Rows of one id, and all null ids, are one document each, however they are dealt."""
    monkeypatch.setattr(substring_dedup, "BLOCK_BYTES", 2_000)
    rows = null_and_repeated()
    numbers = [(10**18 if i is None else i, t) for i, t in rows]
    first = {}
    for i, t in numbers:
        for j in range(len(words(t)) - 12):
            w = tuple(words(t)[j : j + 13])
            first[w] = min(i, first.get(w, i))
    want = []
    for (i, t), (n, _) in zip(rows, numbers, strict=True):
        ws, gone = words(t), set()
        for j in range(len(ws) - 12):
            if first[tuple(ws[j : j + 13])] < n:
                gone.update(range(j, j + 13))
        want.append((i, len(ws), len(gone), hashlib.sha256(b" ".join(w for j, w in enumerate(ws) if j not in gone)).hexdigest()))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = [tuple(r) for r in substring_dedup.remove_repeats(df, text=False).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and sum(w[2] for w in want) > 100


def test_ngram_lm_null_and_repeated_ids(spark):
    """Scores do not depend on how rows are dealt."""
    df = spark.createDataFrame(null_and_repeated(), "doc_id bigint, text string").repartition(3)
    small, large = (sorted((repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)), round(r.base_score, 6), round(r.score, 6)) for r in ngram_lm.score_texts(df, block_bytes=b, shard_tokens=s).collect()) for b, s in ((1_500, 400), (1 << 22, 1_000_000)))
    assert small == large and len(small) == 90


def test_substring_dedup_edges(empty, odd):
    assert substring_dedup.remove_repeats(empty).count() == 0
    assert substring_dedup.remove_repeats(odd).count() == 4


# 6 ---------------------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [*range(1, 200), 350, 368, 32_767, 32_768, 32_769, 70_000])
def test_stream_round_trip(n):
    payload = bytes(RNG.getrandbits(8) for _ in range(n))
    media = transport_stream.write_stream(payload)
    got = transport_stream.read_stream(media)
    assert got.payload == payload and got.discontinuities == 0
    assert got.programs == {1: 0x100} and got.streams == {0x101: 6}
    assert got.times == [k * 3600 for k in range(-(-n // 32_768))]


def test_stream_finds_damage():
    media = bytearray(transport_stream.write_stream(bytes(5_000)))
    broken = bytearray(media)
    broken[188 * 8 + 3] ^= 1
    assert transport_stream.read_stream(bytes(broken)).discontinuities > 0
    broken = bytearray(media)
    broken[10] ^= 1
    with pytest.raises(ValueError, match="CRC"):
        transport_stream.read_stream(bytes(broken))
    with pytest.raises(ValueError, match="sync"):
        transport_stream.read_stream(b"\0" + bytes(media[1:]))


def test_stream_query(docs, empty, odd):
    got = {r.doc_id: r for r in transport_stream.to_media(docs).collect()}
    for i, t, *_ in ROWS:
        raw, r = (t or "").encode(), got[i]
        padded = raw + b"\0" * (-len(raw) % 64 or (64 if not raw else 0))
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest() and r.tail_crc32 == zlib.crc32(padded[-64:])
        assert r.media_bytes == len(r.media) and r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert transport_stream.to_media(empty).count() == 0
    assert transport_stream.to_media(odd).count() == 4


def _plain_parse(media):
    """(payload, times, (packet, time) of access points), read packet by packet, byte by byte."""
    units, marks, pmt, data = [], [], None, None
    for number in range(len(media) // 188):
        p = media[188 * number : 188 * number + 188]
        assert p[0] == 0x47
        pid, start, at, keyed = (p[1] & 31) * 256 + p[2], p[1] & 64, 4, False
        if p[3] & 32:
            keyed = p[4] > 0 and bool(p[5] & 64)
            at = 5 + p[4]
        if not p[3] & 16:
            continue
        body = p[at:]
        if pid == 0:
            section = body[1 + body[0] :]
            pmt = (section[10] & 31) * 256 + section[11]
        elif pid == pmt:
            section = body[1 + body[0] :]
            first = 12 + (section[10] & 15) * 256 + section[11]
            data = (section[first + 1] & 31) * 256 + section[first + 2]
        elif pid == data:
            if start:
                units.append(b"")
                if keyed:
                    marks.append((number, len(units) - 1))
            units[-1] += body
    times = [(u[9] >> 1 & 7) << 30 | u[10] << 22 | (u[11] >> 1) << 15 | u[12] << 7 | u[13] >> 1 for u in units]
    return b"".join(u[9 + u[8] :] for u in units), times, [(n, times[k]) for n, k in marks]


@pytest.mark.parametrize("size", [64, 128, 4_032, 32_768, 32_832, 300_032])
def test_transport_stream_against_a_plain_parser(size):
    payload = random.Random(size).randbytes(size)
    media = transport_stream.write_stream(payload)
    got = transport_stream.read_stream(media)
    assert _plain_parse(media) == (payload, got.times, got.access_points) == (got.payload, got.times, got.access_points)
    assert got.access_points


# 7 ---------------------------------------------------------------------------------------------


def test_tiling_is_greedy():
    a = "a b c d e f g h i j".split()
    assert decontaminate.tile(a, "f g h i j x a b c d e".split(), 5) in ([(0, 6, 5), (5, 0, 5)], [(5, 0, 5), (0, 6, 5)])
    assert decontaminate.tile(a, a, 5) == [(0, 0, 10)]
    assert decontaminate.tile(a, "a b c d".split(), 5) == []
    assert sum(t[2] for t in decontaminate.tile(["x"] * 12, ["x"] * 7, 5)) in (5, 6, 7)
    rng = random.Random(1)
    for _ in range(200):
        x, y = ([rng.choice("abc") for _ in range(rng.randint(0, 20))] for _ in range(2))
        tiles = decontaminate.tile(x, y, 3)
        assert len({i + k for i, _, n in tiles for k in range(n)}) == len({j + k for _, j, n in tiles for k in range(n)}) == sum(n for *_, n in tiles)
        assert all(x[i : i + n] == y[j : j + n] for i, j, n in tiles)
        free_x = [None if any(i <= k < i + n for i, _, n in tiles) else w for k, w in enumerate(x)]
        free_y = [None if any(j <= k < j + n for _, j, n in tiles) else w for k, w in enumerate(y)]
        runs = {tuple(free_x[k : k + 3]) for k in range(len(x) - 2)}
        assert not any(tuple(free_y[k : k + 3]) in runs and None not in free_y[k : k + 3] for k in range(len(y) - 2))


def _plain_tiles(a, b, least):
    """Greedy string tiling by looking at every pair of places again for each tile."""
    used_a, used_b, out = set(), set(), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return out
        out.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


def test_tiling_equals_the_plain_one():
    rng = random.Random(2)
    for k in range(400):
        x = [rng.choice("abcd" if k % 2 else "abcdefghijklmnop") for _ in range(rng.randint(0, 30))]
        y = [rng.choice("abcd") for _ in range(rng.randint(0, 8))]
        for _ in range(rng.randint(0, 4)):  # passages of x in any order, overlapping ones too
            at = rng.randint(0, len(x))
            y += x[at : at + rng.randint(1, 15)] + [rng.choice("zabc")]
        least = rng.randint(2, 5)
        assert decontaminate.tile(x, y, least) == _plain_tiles(x, y, least)
    for _ in range(800):  # of two words only: what a tile leaves of another match is often the longest next
        x, y = ([rng.choice("ab") for _ in range(rng.randint(8, 24))] for _ in range(2))
        assert decontaminate.tile(x, y, 2) == _plain_tiles(x, y, 2)


def test_decontamination(spark, docs, empty, odd):
    item = "".join(f"word{i} " for i in range(30)).strip()
    ws = item.split()
    moved = " ".join(ws[15:] + ["gap"] + ws[:15])
    texts = [(1, "start " + item + " end"), (2, prose(10) + " " + moved.upper() + "!"), (3, " ".join(ws[:10]) + " " + prose(20)), (4, None), (5, ""), (None, item)]
    own = spark.createDataFrame(texts, "doc_id bigint, text string")
    bench = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "too short"), (14, prose(50)), (None, "a lone item of seven words here")], "item_id bigint, text string")
    for block in (1 << 20, 60):
        got = {(r.doc_id, r.item_id): (r.n_tiles, r.n_words) for r in decontaminate.contaminated(own, bench, block_bytes=block).collect()}
        assert got == {(1, 10): (1, 30), (2, 10): (2, 30), (None, 10): (1, 30)}
        assert {r.doc_id for r in decontaminate.drop_contaminated(own, bench, block_bytes=block).collect()} == {3, 4, 5}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(own, bench.where("false")).count() == 0
    assert decontaminate.drop_contaminated(docs, bench).columns == docs.columns
    assert decontaminate.drop_contaminated(odd, bench).count() == 4


# 9 ---------------------------------------------------------------------------------------------


def plain_lines(rows):
    holders: dict[str, set] = {}
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders.setdefault(key(x), set()).add(i)
    out = {}
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= 3 and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def test_line_dedup(docs):
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    want = plain_lines(ROWS)
    assert got == want
    assert sum(v[1] for v in want.values()) > 20
    clean = {r.doc_id: r.text for r in line_dedup.clean_lines(docs).collect()}
    assert all((clean[i] or "") == want[i][2] for i in want)
    assert line_dedup.clean_lines(docs).columns == docs.columns


def test_line_dedup_edges(spark, empty, odd):
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(odd).count() == 4
    long = "a line of more than twenty characters"
    same = spark.createDataFrame([(1, long), (1, long), (1, long + "\n" + long)], "doc_id bigint, text string")
    assert sum(r.n_dropped for r in line_dedup.dedup_lines(same).collect()) == 0  # one document
    many = spark.createDataFrame([(i, "\n".join([long, "x", long, "y"] * 3)) for i in range(4)], "doc_id bigint, text string")
    assert {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(many).collect()} == {0: 6, 1: 6, 2: 6, 3: 0}


def test_line_dedup_is_native(docs):
    plan = line_dedup.dedup_lines(docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# 10 --------------------------------------------------------------------------------------------


def plain_print(t):
    ws = (t or "").encode().lower().split()
    shingles = [b" ".join(ws[j : j + 4]) for j in range(len(ws) - 3)] if len(ws) >= 4 else [b" ".join(ws)] if ws else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    root = {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(prints)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_simhash(docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = {i: plain_print(t) for i, t, *_ in ROWS}
    assert got == {i: (format(prints[i], "016x"), c) for i, c in plain_components(prints).items()}
    kept = {r.doc_id for r in simhash.first_of_group(docs).collect()}
    assert kept == set(plain_components(prints).values())
    assert simhash.first_of_group(docs).columns == docs.columns


@pytest.mark.parametrize("cell", [4_096, 8])
def test_links_connect_all_near_pairs(spark, cell):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = set(base.tolist())
    for x in base.tolist():
        for _ in range(12):
            y = x
            for b in rng.choice(64, rng.integers(1, 5), replace=False).tolist():
                y ^= 1 << b
            prints.add(y)
    ids = {p: p for p in prints}
    want = plain_components(ids)
    signed = lambda p: p - (1 << 64) if p >> 63 else p
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    got = {r.node: r.label for r in simhash.components(simhash.links(df, cell_size=cell)).collect()}
    groups = lambda d: {frozenset(k for k in d if d[k] == c) for c in set(d.values())}
    found = {signed(p): got.get(signed(p), signed(p)) for p in prints}
    assert groups(found) == groups({signed(p): signed(c) for p, c in want.items()})


def test_golay_is_perfect():
    table, size = simhash.golay()
    assert (np.bincount(size)[1], np.bincount(size)[6]) == (277, 1771)


def test_components_of_a_path(spark):
    n = 40
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (200, 200)], "a bigint, b bigint")
    got = {r.node: r.label for r in simhash.components(df).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100}


def test_simhash_edges(empty, odd):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_duplicates(odd).count() == 4
    assert simhash.first_of_group(empty).count() == 0
    assert simhash.first_of_group(odd).count() == 2


# shared ----------------------------------------------------------------------------------------


def test_words_hash_by_content():
    texts = ["ab cd  ab", "", "cd\n", "abcd", " ab "]
    seen: dict[int, bytes] = {}
    for _, _, data, offsets in text_chunks(pa.array(texts), 4):
        w = Words(data, offsets)
        for h, s, e in zip(w.hashes().tolist(), w.starts, w.ends, strict=True):
            assert seen.setdefault(h, data[s:e].tobytes()) == data[s:e].tobytes()
    assert sorted(seen.values()) == [b"ab", b"abcd", b"cd"]


INSIDE = ("id", "block", "h", "h1", "key", "pos", "at", "keep", "left", "lost", "all_lines", "own_hash", "text_hash", "_id", "_hash", "_runs", "_lines", "_kept", "_n_dropped", "drop_runs", "n_dropped", "n_lines", "n_words", "c0", "c1", "label", "component_id", "fingerprint")


def test_inputs_may_have_any_columns(docs):
    extra = docs.withColumns({c: F.lit("z") for c in INSIDE})
    assert substring_dedup.remove_repeats(extra).count() == len(ROWS)
    assert simhash.first_of_group(extra).count() == len({*plain_components({i: plain_print(t) for i, t, *_ in ROWS}).values()})
    want = {i: v[2] for i, v in plain_lines(ROWS).items()}
    for cleaned in (line_dedup.clean_lines(extra), line_dedup.clean_lines(extra.select(*INSIDE, "text", "doc_id"))):
        got = cleaned.collect()
        assert {r.doc_id: r.text or "" for r in got} == want
        assert all(r[c] == "z" for r in got for c in INSIDE)
    twice = docs.selectExpr("doc_id", "text", "'z' as lang", "'y' as lang")
    assert line_dedup.clean_lines(twice).columns == ["doc_id", "text", "lang", "lang"] and line_dedup.clean_lines(twice).count() == len(ROWS)


def test_line_dedup_splits_a_line_of_every_document(spark):
    """A line that stands in all documents, with the skew join forced on."""
    names = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        line = "this one line stands in every document"
        docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(line + "\nown "), F.col("id").cast("string"), F.lit("\n" + line)).alias("text")).repartition(6)
        got = line_dedup.dedup_lines(docs).groupBy("n_dropped").count().collect()
        assert {r.n_dropped: r["count"] for r in got} == {2: 3_999, 0: 1}
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_line_dedup_hashes_lines_once(docs):
    """The scan, the split and the hashes stand in one exchange that both sides read."""
    out = line_dedup.dedup_lines(docs)
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("Generate posexplode") == 1


def test_toxicity_holds_every_significant_segment():
    rng = random.Random(8)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)).encode() for _ in range(900)})
    toxic = Counter({b" " + w + b" ": 20 for w in words})
    held = toxicity._contrast(toxic, 100, Counter(), 100)
    assert sorted(held) == sorted(toxic)  # 9,000 bytes
    model = toxicity.Model(b" ".join([b" common", *held, b""]), b" common ")
    data = np.frombuffer(b" ".join(words), np.uint8)
    found, _ = model.distances(data, np.array([0, len(data)]))
    assert (found >= 4).all()
