"""The pipeline operators against brute force, round trips and held-out accuracy, and on odd tables."""

from __future__ import annotations

import hashlib
import io
import random
import re
import wave
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from starsift.llm import audio, bpe, chat, embeddings, html, mixing, order_minhash, quality, queries, secrets, toxicity
from starsift.llm.components import connected_components
from starsift.storage import new_path, written

public_tokenizers = pytest.importorskip("public_tokenizers")
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "long text with several words. " * 4000
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "   \n\t", "en", "a", 5),
    (4, "one", "en", "a", 3),
    (4, "one", "en", "a", 3),
    (5, "éà 日本語 \U0001f600 don't  x² y\x1c\x85z", None, "b", 20),
    (6, LONG, "en", None, len(LONG)),
    (7, LONG, "en", "b", len(LONG)),
    (None, "a row without id", "en", "b", 16),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, a repeated row, and columns with clashing names."""
    names = ["score", "spans", "size", "target", "taken", "rid", "class_id", "kept", "blob", "n_assign", "row", "pass", "text_to_score", "own", "label"]
    return spark.createDataFrame(ODD, DOCS).withColumns({c: F.lit("clash") for c in names})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- toxicity --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1)], "doc_id long, toxic long")


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op1_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    ranks, toxic = found["score"].rank(), found["toxic"] == 1
    n, m = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * m) > 0.95
    assert (found["predicted"][~toxic] == 1).mean() < 0.01
    assert found["predicted"][toxic].mean() > 0.8


def test_toxicity_restores_disguised_words(spark):
    words = "you are such a stupid idiot and a moron said the losers of this trash with scum".split()
    rng = random.Random(0)
    text = [(k, " ".join(rng.choices(words, k=40))) for k in range(200)]
    costs = toxicity.language_model(spark.createDataFrame(text, "doc_id long, text string"))
    for token, word in (("1d10t", "idiot"), ("m0r0n", "moron"), ("stuuuupid", "stupid"), ("$tup1d!", "stupid"), ("i d i o t", "idiot"), ("l.o.s.e.r.s", "losers"), ("tr@sh", "trash"), ("5cum", "scum"), ("stupid,", "stupid")):
        assert toxicity.restore(token, costs) == [word], token


def test_viterbi_is_the_cheapest_path():
    costs = np.random.default_rng(1).uniform(0.1, 5, toxicity.SIZE**3).tolist()
    places = toxicity.lattice("a1lll0!")

    def cost(text):
        p = q = 0
        total = 0.0
        for char in text + " ":
            c = toxicity._class_of(char)
            if c or q:
                total += costs[(p * toxicity.SIZE + q) * toxicity.SIZE + c]
                p, q = q, c
        return total

    paths = [("", 0.0)]
    for choices in places:
        paths = [(t + c, s + e) for t, s in paths for c, e in choices]
    best = min(paths, key=lambda x: x[1] + cost(x[0]))
    assert toxicity.viterbi(places, costs).split() == best[0].split()


def test_runs_of_two_without_the_lattice():
    rng = random.Random(21)
    costs = [float(x) for x in np.random.default_rng(21).uniform(0.1, 9, toxicity.SIZE**3).astype(np.float32)]
    plain = 0
    for _ in range(2000):
        word = "".join(c * rng.choice([1, 1, 2]) for c in rng.choices("abcéж", k=rng.randint(1, 7)))
        found = toxicity.undoubled(word, costs)
        if found is not None:
            plain += 1
            assert found == toxicity.viterbi(toxicity.lattice(word), costs).strip()
    assert plain > 1000


def test_toxicity_restores_long_disguises(spark):
    words = "you are such a stupid idiot and a moron said the losers of this letter committee with scum".split()
    rng = random.Random(0)
    text = [(k, " ".join(rng.choices(words, k=40))) for k in range(200)]
    costs = toxicity.language_model(spark.createDataFrame(text, "doc_id long, text string"))
    phrase = "you are such a stupid idiot and moron you losers said the scum of this"
    (spaced,) = (t for t in toxicity.tokens(" ".join(phrase.replace(" ", ""))) if " " in t)
    assert len(spaced) > 100 and {"stupid", "idiot", "moron", "losers", "scum"} <= set(toxicity.restore(spaced, costs))
    for token, word in (("i" * 60 + "d10t", "idiot"), ("stu" + "p" * 5000 + "id", "stupid"), ("iiddiioott", "idiot"), ("ssttuuppiidd", "stupid"), ("iidiiot", "idiot"), ("letter", "letter"), ("committee", "committee")):
        assert toxicity.restore(token, costs) == [word], token[:60]


def test_toxicity_odd_tables(odd, empty, labels):
    kept = toxicity.clean(odd, labels)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert toxicity.clean(empty, labels).count() == 0
    model = toxicity.fit(odd, labels.limit(0))
    assert {0.0 <= r["score"] <= 1.0 for r in toxicity.score(odd, model).collect()} == {True}


# --- pages -----------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="page-7"><header>Site<nav><a href=/>Home</a></nav></header><div class="cookie-notice">We use cookies</div>
<div class="layout"><div class="post post-%d"><h1>Title &amp; more</h1><p>First   paragraph with a good number of words in it.<p>Second one,
<a href="x">linked</a> &eacute;&copy &#169; done.<ul><li>a<li>b</ul><script>var x = "</p><p>no</p>";</script><form><p>Sign up</p></form><div class="ad-slot">Buy</div>
<section id="comments"><p>I do not agree with this at all, and I say so at length here.</p></section></div><aside class="sidebar"><p>Other news of the day</p></aside></div><footer>End</footer></body></html>"""
MAIN = "Title & more\nFirst paragraph with a good number of words in it.\nSecond one, linked é© © done.\na\nb"


def test_pages_main_text(spark):
    rows = [(k, f"http://h.example/{k}", PAGE % k) for k in range(6)] + [(6, "http://h.example/6", (PAGE % 6)[:-200]), (7, None, None), (8, "no url", ""), (9, "http://x.example", "plain &lt;text&gt; only"), (9, "http://x.example", "plain &lt;text&gt; only")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("path", F.lit("clash"))
    got = [(r["page_id"], r["text"]) for r in html.main_text(df).collect()]
    expected = [(k, MAIN) for k in range(7)] + [(7, ""), (8, ""), (9, "plain <text> only"), (9, "plain <text> only")]
    assert sorted(got) == sorted(expected)
    assert html.main_text(df.limit(0)).count() == 0


def test_host_path_decides(spark):
    """A page whose comments outweigh its article follows the path of its host."""
    page = lambda n, m: f"<body><div class='story-{n}'><p>{'word ' * n}</p></div><div class='thread'><p>{'talk ' * m}</p></div></body>"
    rows = [(k, "http://a.example/x", page(40 + k, 3)) for k in range(5)] + [(9, "http://a.example/y", page(5, 60))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.main_text(df).collect()}
    assert got[9] == ("word " * 5).strip()


@pytest.mark.parametrize(
    "out",
    ["<button>Subscribe now</button>", '<p class="advert">Buy it now', '<span class="ad">Buy <span>it</span> now</span>', '<p class="cookie-notice">We use cookies</p>', "<label>Your name</label>", "<header>Site name</header>", '<ul class="related"><li><a href="#">Other story</a></ul>', '<div class="user-comments"><p>I disagree with all of it</p></div>'],
)
@pytest.mark.parametrize("tag", ["article", "div class='t1'"])
def test_left_out_at_any_level(out, tag):
    before, after = "<p>" + "first words " * 20 + "</p>", "<p>last &amp; <b>bold</b> words</p>"
    page = f"<body><nav><a>Home</a></nav><{tag}>{before}{out}{after}</{tag.split()[0]}></body>"
    assert html.extract(page, ()) == ("first words " * 20).strip() + "\nlast & bold words"


@pytest.mark.parametrize("name", ["search-and-rescue", "related-work", "discussion", "story-tags", "alert"])
def test_ordinary_words_as_classes(name):
    story = "a long story of many words " * 20
    assert html.extract(f'<body><div class="{name}"><p>{story}</p></div><div class="x"><p>word</p></div></body>', ()) == story.strip()
    assert html.extract(f'<body><div><p>{story}</p><div class="{name}"><a>one</a> <a>two</a></div></div></body>', ()) == story.strip()


WRAPPERS = ["site-content has-sidebar", "content-sidebar-wrap", "modal-open", "page-with-sidebar", "no-sidebar", "sidebar-layout", "search-page", "widget-wrap"]
LEFT_OUT = ["reader-comments", "comment-thread", "commentlist", "user-comments", "discussion", "legal-notice", "ad-large", "adsbygoogle", "sidebar", "related", "cookie-consent"]


@pytest.mark.parametrize("words", [8, 300])
@pytest.mark.parametrize("wrapper", WRAPPERS)
def test_layouts_named_after_what_stands_beside_the_text(spark, wrapper, words):
    story = ("word " * words).strip()
    inner = f"<h1>Head</h1><p>{story}</p>"
    for box in (f"<article>{inner}</article>", f"<div class='c1'>{inner}</div>"):
        page = f"<body><header>Site</header><div class='{wrapper}'>{box}<div class='sidebar'><p>Other news of the day</p></div></div><p>All rights</p></body>"
        assert html.extract(page, ()) == f"Head\n{story}"
        df = spark.createDataFrame([(k, "http://h.example/", page) for k in range(3)], "page_id long, url string, html string")
        assert {r["text"] for r in html.main_text(df).collect()} == {f"Head\n{story}"}


@pytest.mark.parametrize("words", [5, 400])
@pytest.mark.parametrize("name", LEFT_OUT)
def test_telling_elements_go_at_any_length(spark, name, words):
    story = ("story " * 60).strip()
    noise = f"<div class='{name}'><p>{'noise ' * words}</p><div class='inner'><p>{'noise ' * words}</p></div></div>"
    for page in (f"<body><article><p>{story}</p>{noise}</article></body>", f"<body><article><p>{story}</p></article>{noise}</body>", f"<body><div class='b'><div class='a'><h1>story</h1><p>{story}</p></div>{noise}</div></body>"):
        assert set(html.extract(page, ()).split()) == {"story"}
        df = spark.createDataFrame([(k, "http://h.example/", page) for k in range(3)], "page_id long, url string, html string")
        assert {w for r in html.main_text(df).collect() for w in r["text"].split()} == {"story"}


def test_every_article_of_a_page():
    page = "<body><div class='list'><article><p>one</p></article><article><p>two two</p></article></div><div class='related'><article><p>teaser text that is long</p></article></div></body>"
    assert html.extract(page, ()) == "one\ntwo two"


def test_a_page_within_one_telling_element():
    assert html.extract("<body><div class='widget'><p>all that there is</p></div></body>", ()) == "all that there is"
    assert html.extract("<body><div class='comments'><p>only readers</p></div></body>", ()) == ""
    assert html.extract("<body><div class='story comments-open'><p>a story</p></div></body>", ()) == "a story"
    assert html.extract("<body><div class='commentary'><p>a column</p></div></body>", ()) == "a column"


def test_two_templates_of_a_host(spark):
    one = lambda k: f"<body><div class='one'><p>{'alpha ' * (30 + k)}</p></div><div class='talk'><p>{'noise ' * 9}</p></div></body>"
    two = lambda k, n: f"<body><section class='two'><p>{'beta ' * (30 + k)}</p></section><div class='talk'><p>{'noise ' * n}</p></div></body>"
    rows = [(k, "http://h.example/", one(k)) for k in range(12)] + [(20 + k, "http://h.example/", two(k, 4)) for k in range(4)] + [(30, "http://h.example/", two(0, 90))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "page_host", "paths", "host_path", "own", "page")})
    got = html.main_text(df)
    assert got.columns == [*df.columns, "text"]
    for r in got.collect():
        assert set(r["text"].split()) == {"alpha" if r["page_id"] < 20 else "beta"} and r["host"] == r["host_path"] == r["page"] == "clash"


def test_pages_of_the_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").toPandas().set_index("page_id")
    for r in queries.op2_host_paths(spark, sf).collect():
        inner = re.search(r"<article>(.*?)(?:</article>|\Z)", pages.html[r["page_id"]], re.S)[1]
        plain = re.sub(r"<[^>]*(>|\Z)", "", re.sub(r"</?(p|h1|br)>", "\0", inner))
        lines = (" ".join(html.entities.unescape(x).split()) for x in plain.split("\0"))
        assert r["text"] == "\n".join(x for x in lines if x) and r["n_chars"] == len(r["text"])


# --- quality ---------------------------------------------------------------------------------------------------------


def test_resampling_is_gumbel_top_k_of_ratios(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choices(["a", "b", "c", "!!"] if k % 3 else ["a", "x&&&", "y"], k=rng.randint(1, 12))) for k in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 > 0)) for k in range(30)], "doc_id long, quality long")
    got = {r["doc_id"]: r for r in quality.resample(docs, labels, 0.5).collect()}

    def grams(t):
        return quality.ngrams(t, quality._Hashes())

    def shares(own):
        counts = np.full(quality.BUCKETS, quality.SMOOTHING)
        for t in own:
            for g in grams(t):
                counts[g] += 1
        return np.log(counts / counts.sum())

    ratio = shares([t for k, t in enumerate(texts) if k < 30 and k % 3]) - shares(texts)
    for k, t in enumerate(texts):
        assert abs(got[k]["log_weight"] - ratio[grams(t)].sum()) < 1e-9
    order = sorted(got.values(), key=lambda r: (-r["sample_key"], r["doc_id"]))
    assert [r["kept"] for r in order] == [True] * 30 + [False] * 30 and [r["rank"] for r in order] == list(range(1, 61))
    noise = [r["sample_key"] - r["log_weight"] for r in got.values()]
    assert abs(np.mean(noise) - 0.577) < 0.6
    again = {r["doc_id"]: r for r in quality.resample(docs.repartition(5), labels, 0.5).collect()}
    assert all(again[k]["kept"] == got[k]["kept"] for k in got)


def test_resampling_keeps_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op3_importance_resampling(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    good = rows["quality"] == 1
    assert rows["kept"][good].mean() > 0.93 and rows["kept"][~good].mean() < 0.5


def test_resampling_odd_tables(spark, odd, empty, labels):
    named = labels.withColumnRenamed("toxic", "quality")
    out = quality.resample(odd.withColumn("log_weight", F.lit("clash")).withColumn("sample_key", F.lit("clash")), named, 0.5)
    assert out.count() == len(ODD) and out.filter("kept").count() == 5
    assert {r["log_weight"] for r in quality.resample(odd, named.limit(0)).collect()} == {0.0}
    assert quality.resample(empty, named).count() == 0


# --- audio -----------------------------------------------------------------------------------------------------------


def test_audio_stores_and_reads_back(spark, odd, empty):
    got = sorted((r.asDict() for r in audio.digests(audio.described(audio.store(odd))).collect()), key=lambda r: (r["doc_id"] or 0, r["n_bytes"]))
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(ODD)
    for doc, text, *_ in ODD:
        data = (text or "").encode()
        payload = data + bytes(-len(data) % 64) if data else bytes(64)
        r = by_id[doc]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
    assert by_id[6]["feature"] == by_id[7]["feature"] and by_id[1]["feature"] == by_id[2]["feature"]
    assert audio.digests(audio.described(audio.store(empty))).count() == 0
    stored = audio.store(odd).filter("doc_id = 5").first()["media"]
    with wave.open(io.BytesIO(bytes(stored))) as f:
        assert (f.getnchannels(), f.getsampwidth()) == (1, 1)


def test_tensors_are_stored_whole_with_their_spans(spark, odd):
    for row in audio.described(audio.store(odd.filter("doc_id in (4, 6)"))).collect():
        payload = audio.from_wav(bytes(audio.store(odd.filter(F.col("doc_id") == row["doc_id"])).first()["media"]))
        values, spans, loud = audio.features(payload)
        stored, kept = audio.unpack(bytes(row["tensors"]))
        assert stored.dtype == np.float16 and stored.shape == (len(spans), *audio.SHAPE)
        assert np.array_equal(stored, values) and kept == spans and [tuple(x) for x in row["loud"]] == loud


def test_log_mel_by_direct_sums():
    x = np.random.default_rng(3).normal(scale=0.3, size=700).astype(np.float32)
    mel, energy = audio.log_mel(x)
    assert len(mel) == len(energy) == 1 + -(-(700 - audio.WINDOW) // audio.STEP)
    t, bins = np.arange(audio.WINDOW), np.arange(audio.FFT // 2 + 1)
    waves = np.exp(-2j * np.pi * bins[:, None] * t / audio.FFT)
    hertz = bins * audio.TARGET_RATE / audio.FFT
    points = np.linspace(0, 2595 * np.log10(1 + audio.TARGET_RATE / 2 / 700), audio.BANDS + 2)
    edges = 700 * (10 ** (points / 2595) - 1)
    for k in range(len(mel)):
        frame = np.zeros(audio.WINDOW)
        own = x[k * audio.STEP : k * audio.STEP + audio.WINDOW]
        frame[: len(own)] = own
        assert np.isclose(energy[k], 10 * np.log10((frame**2).mean() + 1e-8), atol=1e-3)
        power = np.abs(waves @ (frame * (0.5 - 0.5 * np.cos(2 * np.pi * t / (audio.WINDOW - 1))))) ** 2
        for b in range(audio.BANDS):
            bank = np.interp(hertz, edges[b : b + 3], [0, 1, 0])
            assert np.isclose(mel[k, b], np.log(power @ bank + 1e-6), atol=1e-2)


def test_polyphase_is_upsampling_filtering_and_decimation():
    x = np.random.default_rng(0).normal(size=500).astype(np.float32)
    for up, down in ((3, 4), (1, 2), (5, 3)):
        taps = audio._phases(up, down)[:, ::-1].T.reshape(-1)
        wide = np.zeros(len(x) * up)
        wide[::up] = x
        full = np.convolve(wide, taps)[: len(wide)][::down]
        assert np.allclose(audio.resample(x, up, down), full[: len(x) * up // down], atol=1e-4)


def test_segments_and_tensors(spark, odd):
    energy = np.array([0, 0, 0, 2, 3, 2, 0, 0, 0.3, 0, 0, 5, 0], float)
    assert audio.segments(energy) == [(3, 6), (11, 12)]
    table = audio.tensors(audio.store(odd.filter("doc_id in (4, 6)"))).toArrow()
    assert table.filter(pa.compute.greater(table["tensor_no"], 0)).num_rows > 0
    kind = audio.as_tensors(table).schema.field("tensor").type
    assert list(kind.shape) == list(audio.SHAPE)


# --- byte-level BPE --------------------------------------------------------------------------------------------------


def tiktokens(text):
    import tiktoken

    e = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(VOCABULARY), special_tokens={})
    return e.encode_ordinary(text)


def test_bpe_is_tiktokens(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op5_byte_bpe(spark, sf).collect():
        ids = np.array(tiktokens(texts[r["doc_id"]]), dtype="<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


@pytest.mark.parametrize("block_chars", [10, 1 << 22])
def test_bpe_odd_tables(odd, empty, block_chars):
    encoded = bpe.encode(odd, VOCABULARY, public_tokenizers.PATTERN, block_chars=block_chars)
    got = sorted((r["doc_id"] or 0, np.frombuffer(r["ids"], "<u4").tolist()) for r in encoded.collect())
    assert got == sorted((d or 0, tiktokens(t or "")) for d, t, *_ in ODD)
    assert sorted(r["text"] for r in bpe.decode_texts(encoded, VOCABULARY).collect()) == sorted(t or "" for _, t, *_ in ODD)
    assert bpe.encode(empty, VOCABULARY, public_tokenizers.PATTERN).count() == 0


def test_fast_splitter_is_the_pattern():
    rng = random.Random(2)
    letters = [chr(c) for c in range(256)] + ["'s", "'LL", "don't", " ", "  ", "\n ", "_", "a1_b"]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(0, 30)))
        assert bpe.pretokens(text, public_tokenizers.PATTERN) == bpe._splitter(public_tokenizers.PATTERN).findall(text)


def test_numbers_too_large_for_their_bytes_are_an_error():
    for width in (1, 2, 3, 4):
        most = np.array([0, 1, 256**width - 1])
        assert (bpe._numbers(bpe._planes(most, width), 3, width) == most).all()
        if width < 4:
            with pytest.raises(OverflowError):
                bpe._planes(most + 1, width)
    assert bpe._planes(np.array([], dtype=np.int64), 3) == b""


# --- embeddings ------------------------------------------------------------------------------------------------------


def brute_links(rows, least=0.98):
    good = [k for k, (_, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)]
    links = {k: set() for k in range(len(rows))}
    for a in good:
        for b in good:
            if a != b and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = np.array(rows[a][1], float), np.array(rows[b][1], float)
                if (x @ y) / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                    links[a].add(b)
    return links


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for g in range(30):
        centre = rng.normal(size=64)
        rows += [(len(rows) + k, (centre + rng.normal(size=64) * 0.08).tolist(), g % 3) for k in range(6)]
    rows += [(900, None, 0), (901, [0.0] * 64, 0), (902, [None] + [1.0] * 63, 0), (903, [float("nan")] * 64, 0), (904, rows[0][1], None), (905, rows[0][1], rows[0][2]), (906, [3 * x for x in rows[1][1]], rows[1][2]), (907, [1.0, 2.0], 0), (908, [1e-30] * 64, 1), (909, [float("inf")] * 64, 1)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], lab) for i, v, lab in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long").withColumn("bucket", F.lit("clash")).withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: r for r in embeddings.near_duplicates(df).collect()}
    links = brute_links(rows)
    total = sum(map(len, links.values()))
    assert sum(r["n_links"] for r in got.values()) >= 0.98 * total
    for k, (i, _, _) in enumerate(rows):
        assert got[i]["n_links"] <= len(links[k]) and got[i]["component_id"] <= i and got[i]["kept"] == (got[i]["component_id"] == i)
        if not links[k]:
            assert (got[i]["n_links"], got[i]["component_id"]) == (0, i)
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_vectors_with_one_id(spark):
    """An id with two different vectors, and vectors without an id."""
    a, b = [1.0, 0.0, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0]
    rows = [(1, a, 1), (1, b, 1), (2, a, 1), (3, b, 1), (None, a, 1), (None, [0.0, 0.0, 1.0, 0.0], 1)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"] or 0, r["kept"]) for r in got) == [(0, 0, 0, False), (0, 2, 1, False), (1, 1, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 1, 1, False)]


def test_hot_group_of_vectors(spark):
    """A group of more than two blocks, and one vector many times."""
    rng = np.random.default_rng(6)
    centre = rng.normal(size=64)
    v = centre + rng.normal(size=(600, 64)) * 0.02
    rows = [(k, v[k].astype(np.float32).tolist(), 1) for k in range(600)] + [(600 + k, v[0].astype(np.float32).tolist(), 1) for k in range(50)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label long")).collect()
    assert {(r["n_links"], r["component_id"]) for r in got} == {(649, 0)}


def test_components(spark):
    rng = random.Random(7)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (1000, 1001)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in list(root)}


# --- chat ------------------------------------------------------------------------------------------------------------


def test_chat_round_trip_of_any_text():
    rng = random.Random(8)
    parts = [*chat.CONTROLS, "\\", "\\\\", " ", "a", "\n", "<", "[", "user"]
    for _ in range(5000):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "[INST]"]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(3)]
        assert [t[:2] for t in chat.parse("".join(chat.render(*t)[0] for t in turns))] == turns


def test_chat_query(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet").toPandas().sort_values(["conv_id", "turn"])
    expected = {k: list(zip(x["role"], x["text"], strict=True)) for k, x in c.groupby("conv_id")}
    expected[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = queries.op7_chat_grammar(spark, sf).collect()
    assert {r["conv_id"] for r in got} == set(expected)
    for r in got:
        turns = expected[r["conv_id"]]
        learned = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_odd_tables(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, None, "x"), (None, 0, "assistant", "a"), (None, None, "assistant", "b"), (2, 0, "assistant", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert (got[1]["n_turns"], got[None]["n_turns"], got[2]["loss_chars"]) == (3, 2, len(LONG))
    assert got[None]["loss_sha256"] == hashlib.sha256(b"ba").hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).count() == 0


# --- near copies -----------------------------------------------------------------------------------------------------


def plain_distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a):
        now = [i + 1]
        for j, y in enumerate(b):
            now.append(min(last[j] + (x != y), last[j + 1] + 1, now[j] + 1))
        last = now
    return last[-1]


def test_banded_distance():
    rng = random.Random(9)
    for _ in range(1500):
        a = [rng.randint(0, 8) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 9)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = [rng.randint(0, 8)] * rng.randint(0, 1)
        most, d = rng.randint(0, max(len(a), len(b))), plain_distance(a, b)
        assert order_minhash.distance(np.array(a, dtype=np.int64), np.array(b, dtype=np.int64), most) == (d if d <= most else most + 1)


def test_order_matters():
    words = np.random.default_rng(1).integers(0, 2**62, 60).astype(np.uint64)
    turned = np.concatenate([words[30:], words[:30]])
    agree = (order_minhash.sketches(words) == order_minhash.sketches(turned)).mean()
    assert agree < 0.6  # the sets of k-mers are nearly equal; their order isn't


def test_near_copies_against_brute_force(spark, odd):
    rng = random.Random(10)
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(words, k=rng.choice([30, 80, 200]))
        texts.append(base)
        for _ in range(4):
            copy = list(base)
            for _ in range(max(1, len(copy) // 25)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(copy)
    texts += [passage + rng.choices(words, k=120) for _ in range(10)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)] + [(900, " ".join(texts[0])), (901, None), (902, ""), (903, "two words"), (904, "two  words"), (904, "two  words")]
    got = {r["doc_id"]: r for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 1 - plain_distance(texts[a], texts[b]) / max(len(texts[a]), len(texts[b])) >= 0.8:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert [got[k]["class_id"] for k in range(len(texts))] == root
    assert got[900]["class_id"] == 0 and not got[900]["kept"]
    assert got[901]["class_id"] == got[902]["class_id"] == 901 and got[903]["class_id"] == got[904]["class_id"] == 903


def test_scattered_edits_share_a_bucket():
    rng = random.Random(12)
    words = np.random.default_rng(12).integers(0, 2**62, 5000).astype(np.uint64)
    for n in (20, 50, 200, 500):
        for share in (0.1, 0.15, 0.2):
            for k in range(40):
                text = words[rng.sample(range(5000), n)]
                copy = text.copy()
                edits = int(n * share)
                # Anywhere, or at even distances, which leaves the fewest pairs of words.
                places = rng.sample(range(n), edits) if k % 2 else [(2 * j + 1) * n // (2 * edits) for j in range(edits)]
                copy[places] = words[rng.sample(range(5000), edits)]
                assert (order_minhash.sketches(text) == order_minhash.sketches(copy)).any(), (n, share, k)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_block_pairs_in_batches_of_any_size(size):
    """Pairs of sorted block pairs, small and large, whose rows come in batches."""
    rng = np.random.default_rng(14)
    base = rng.integers(0, 60000, order_minhash.SKETCHES).astype("<u2")
    rows = []
    for bucket, (low, high), m in [(1, (0, 0), 2), (2, (0, 0), 40), (3, (0, 1), 45), (4, (0, 0), 3)]:
        for _ in range(m):
            signs = np.where(rng.random(len(base)) < 0.5, base, rng.integers(0, 60000, len(base))).astype("<u2")
            signs[0] = base[0]
            counts = rng.integers(0, 2, order_minhash.BINS).astype(np.uint8)
            counts[:200] = 1
            rows.append((bucket, 0, len(rows), int(rng.integers(0, 9)), int(rng.integers(low, high + 1)), low, high, 250, signs.tobytes(), counts.tobytes()))
    table = pd.DataFrame(rows, columns=["bucket", "sketch", "rid", "group", "own", "low", "high", "n", "signs", "counts"])
    expected = set()
    for x in rows:
        for y in rows:
            a, b = (np.frombuffer(r[9], np.uint8).astype(int) for r in (x, y))
            lost = max(np.maximum(a - b, 0).sum(), np.maximum(b - a, 0).sum())
            if x[0] == y[0] and x[2] < y[2] and x[3] != y[3] and (x[4] != y[4] or x[5] == x[6]) and lost <= 50:
                expected.add((x[2], y[2], x[3], y[3]))
    batches = [table[k : k + size].reset_index(drop=True) for k in range(0, len(table), size)]
    got = pd.concat([*order_minhash._rule_out(0.8, False)(iter(batches)), pd.DataFrame(columns=["a", "b", "group_a", "group_b"])])
    assert sorted(map(tuple, got.to_numpy().tolist())) == sorted(expected) and len(expected) > 100
    near = pd.concat(list(order_minhash._rule_out(0.8, True)(iter(batches))))
    assert 0 < len(near) <= len(table) and set(map(tuple, near.to_numpy().tolist())) <= expected


def test_short_near_copies_against_brute_force(spark):
    rng = random.Random(13)
    words = [f"w{k}" for k in range(300)]
    texts = []
    for n in range(1, 20):
        for _ in range(3):
            base = rng.choices(words, k=n)
            texts.append(base)
            for k in range(1 + n // 5):
                copy = list(base)
                copy[(n // 2 + 3 * k) % n] = "other"
                texts.append(copy)
                texts.append(copy[:k] + ["more"] + copy[k:])
                texts.append(copy[:k] + copy[k + 1 :] or ["none"])
    texts = [list(t) for t in dict.fromkeys(map(tuple, texts))]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if plain_distance(texts[a], texts[b]) <= 0.2 * max(len(texts[a]), len(texts[b])) + 1e-9:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert [got[k] for k in range(len(texts))] == root


def test_family_below_the_threshold(spark, monkeypatch):
    """Texts that share a long passage and many words: nearly all pairs have to be aligned, yet none is a row."""
    rng = random.Random(15)
    passage, words = ["is", "onhe"] * 60, [f"w{k}" for k in range(8)]
    texts = [rng.choices(words, k=rng.choice([50, 54, 58])) + passage for _ in range(200)]
    for k in range(40):  # near copies, of which some link what is apart otherwise
        copy = list(texts[k])
        for _ in range(12):
            copy[rng.randrange(50)] = rng.choice(words)
        texts.append(copy)
    rows, made = [(k, " ".join(t)) for k, t in enumerate(texts)], []

    def counted(df, name, *args):
        out = written(df, name, *args)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(order_minhash, "written", counted)
    got = {r["doc_id"]: r["class_id"] for r in order_minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hashed = [order_minhash.word_hashes(t).astype(np.int64) for _, t in rows]
    root, apart = list(range(len(rows))), 0
    for a in range(len(rows)):
        for b in range(a):
            if order_minhash.similar(hashed[a], hashed[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
            else:
                apart += 1
    assert [got[k] for k in range(len(rows))] == root
    assert 20 < len(set(root)) < 220 and apart > 20000
    assert max(count for _, count in made) <= dict(made)["met"] <= order_minhash.SKETCHES * len(rows), made


def test_near_copies_odd_tables(odd, empty):
    kept = order_minhash.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6]
    assert order_minhash.deduplicated(empty).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def filled(sizes, weights, total, cap):
    """Targets by sharing the excess again until none is above its cap."""
    out = dict.fromkeys(sizes, 0.0)
    free, left = set(sizes), total
    while free:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = float(cap * sizes[s])
            left -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("table", ["docs", "odd"])
def test_mixture(table, request):
    rows = request.getfixturevalue(table)
    got, again = mixing.mix(rows).toPandas(), mixing.mix(rows.repartition(3)).toPandas()
    source = rows.select(F.monotonically_increasing_id().alias("row"), "source", "text").toPandas()
    m = got.merge(source, on="row")
    assert list(m["size"]) == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in m["text"]]
    m["source"] = m["source"].fillna("\U0010ffff")
    sizes = m.groupby("source")["size"].sum().to_dict()
    weights = {s: (5.0, 2.0, 1.0)[k % 3] for k, s in enumerate(sorted(sizes))}
    expected = filled(sizes, weights, 1.5 * sum(sizes.values()), 2)
    for s, x in m.groupby("source"):
        assert x["source_size"].unique().tolist() == [sizes[s]]
        assert np.allclose(x["target"], expected[s])
        assert abs(x["taken"].sum() - expected[s]) <= max(30, 0.01 * expected[s])
    assert (m["taken"] <= 2 * m["size"]).all()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist() or table == "odd"


def test_mixed_documents(docs, odd, empty):
    shares = mixing.mix(docs).agg(F.sum("taken")).first()[0]
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert out.agg(F.sum(mixing.word_count(F.col("text")))).first()[0] == shares
    assert mixing.mixed(odd).columns == odd.columns
    assert mixing.mixed(empty).count() == 0


def test_schedule_keeps_its_shares(spark):
    sources = spark.createDataFrame([(0, 50.0), (1, 30.0), (2, 20.0), (3, 0.0)], "nth int, target double")
    rows = mixing.schedule(sources, 1000).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(1000))
    for n, share in ((0, 0.5), (1, 0.3), (2, 0.2)):
        own = [r for r in rows if r["nth"] == n]
        assert [r["rank"] for r in own] == list(range(len(own)))
        for upto in (100, 500, 1000):
            assert abs(sum(r["slot"] < upto for r in own) - share * upto) < 6


def test_the_schedule_makes_the_mix(docs, monkeypatch):
    def taken():
        rows = mixing.mix(docs, slots=4000).select("doc_id", "taken_1", "slot_1", "taken_2", "slot_2").collect()
        return {r["doc_id"]: tuple(r)[1:] for r in rows}

    own, schedule = taken(), mixing.schedule
    # Points that run backwards, points of another step, and none at all.
    monkeypatch.setattr(mixing, "schedule", lambda sources, slots: schedule(sources, slots).withColumn("slot", slots - 1 - F.col("slot")))
    backwards = taken()
    monkeypatch.setattr(mixing, "schedule", schedule)
    monkeypatch.setattr(mixing, "GOLDEN", 1 << 20)
    other = taken()
    monkeypatch.setattr(mixing, "schedule", lambda sources, slots: schedule(sources, slots).limit(0))
    none = taken()
    monkeypatch.undo()
    assert own == taken()
    assert own != backwards != other != own
    total = lambda t: sum(r[0] + r[2] for r in t.values())
    assert total(none) < 0.1 * total(own) and total(other) < total(own)


def test_each_stretch_of_the_mix_is_near_the_weights(docs):
    rows = mixing.mix(docs, slots=2000).join(docs.select("doc_id", "source"), "doc_id")
    targets = {r["source"]: r["target"] for r in rows.select("source", "target").distinct().collect()}
    whole = sum(targets.values())
    pieces = rows.select("source", F.explode(F.array(*(F.struct(F.col(f"taken_{k}").alias("n"), F.col(f"slot_{k}").alias("slot")) for k in (1, 2)))).alias("p")).filter("p.n > 0").select("source", "p.*").collect()
    width = mixing.block_width(whole, 2000)
    for upto in (400, 1000, 1600):
        for source, target in targets.items():
            words = sum(p["n"] for p in pieces if p["source"] == source and p["slot"] < upto)
            # A document counts at its first slot, so the last one may reach beyond.
            longest = max(p["n"] for p in pieces if p["source"] == source)
            assert abs(words - target / whole * upto * width) <= 8 * width + longest
    out = mixing.mixed(docs, slot_col="slot")
    assert out.columns == [*docs.columns, "slot"] and out.filter("slot is null").count() == 0
    assert out.count() == mixing.mix(docs).select(F.expr("int(taken_1 > 0) + int(taken_2 > 0)").alias("n")).agg(F.sum("n")).first()[0]


def test_many_sources_meet_few_intervals(spark):
    sources = spark.range(3000).select(F.col("id").cast("int").alias("nth"), F.when(F.col("id") == 0, 1e6).otherwise(F.lit(3.0)).alias("target"))
    rows = mixing.schedule(sources, 20_000).collect()
    assert len(rows) == 20_000 and sorted(r["slot"] for r in rows) == list(range(20_000))
    assert abs(sum(r["nth"] == 0 for r in rows) - 20_000 * 1e6 / (1e6 + 3 * 2999)) < 6
    assert mixing.schedule(sources.limit(0), 100).count() == 0


def test_tiny_source_beside_a_huge_one(spark):
    # 3000 huge documents and sources of 1 to 40 words; a block has 500 words and more.
    huge = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a big source").alias("source"), F.repeat(F.lit("word "), 400).alias("text"))
    tiny = spark.createDataFrame([(10_000 + k, f"b{k:02}" if k else None, "x " * (1 + k)) for k in range(40)], "doc_id long, source string, text string")
    got = mixing.mix(huge.unionByName(tiny), slots=3000).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("*").alias("n")).collect()
    assert len(got) == 41
    for r in got:
        assert abs(r["taken"] - r["target"]) <= 0.5, r


def test_blocks_do_not_grow_with_the_corpus(spark):
    assert mixing.block_width(1e6, mixing.SLOTS) == 8
    assert mixing.block_width(1e10, mixing.SLOTS) == mixing.WIDTH


# --- secrets ---------------------------------------------------------------------------------------------------------

BASE = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text):
    out = [(m.start(), 0, m.end(), "assign") for m in BASE.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [(s, e, k) for s, _, e, k in sorted(out)]


def test_secret_spans():
    rng = random.Random(11)
    parts = ["password", "Secret", "API_KEY", "apikey", "token", "toKen", "ſecret", ":", "=", " ", '"', "'", "abcdefgh", "short", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2, "\n", "é", "passwd=", "x"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 14)))
        assert [s for s in secrets.find(text) if s[2] in secrets.BASE_RULES] == base_spans(text), text
    pem = "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"
    assert secrets.find("x " + pem) == [(2, 2 + len(pem), "pem")]
    assert secrets.redact("a password=abcdefgh1 b", secrets.find("a password=abcdefgh1 b")) == "a [assign] b"


def test_secret_query(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op10_secret_ledger(spark, sf).collect():
        spans = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, e, k in spans).encode()).hexdigest()
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(k == kind for _, _, k in spans) for kind in secrets.BASE_RULES]


def test_ledger_is_incremental(spark):
    ledger = new_path(spark, "ledger")
    kind = "doc_id long, text string"
    first = spark.createDataFrame([(1, "password=abcdefgh1"), (2, "plain"), (3, "password=abcdefgh1")], kind)
    secrets.scan(first, ledger)
    assert spark.read.parquet(ledger).count() == 2
    more = spark.createDataFrame([(1, "plain"), (4, "new token: abcdefgh2"), (5, None)], kind)
    out = {r["doc_id"]: r["spans"] for r in secrets.scan_paths(more, ledger).collect()}
    assert spark.read.parquet(ledger).count() == 4
    assert out == {1: "", 4: "assign:4:20", 5: ""}
    secrets.scan(more, ledger, version="another")
    assert spark.read.parquet(ledger).count() == 7


def test_ledger_written_twice(spark):
    docs = spark.createDataFrame([(1, "password = hunter2hunter2"), (2, "nothing here")], "doc_id long, text string")
    ledger = new_path(spark, "ledger")
    before = secrets.scan_paths(docs, ledger).orderBy("doc_id").collect()
    rows = spark.read.parquet(ledger)
    rows.checkpoint().write.mode("append").parquet(ledger)  # as a retried or concurrent scan would
    assert secrets.scan_paths(docs, ledger).orderBy("doc_id").collect() == before
    assert secrets.scan(docs, ledger).count() == 2


def test_secrets_odd_tables(spark, odd, empty):
    assert secrets.redacted(odd).columns == odd.columns
    assert sorted(r["text"] or "" for r in secrets.redacted(odd).collect()) == sorted(t or "" for _, t, *_ in ODD)
    assert secrets.redacted(empty).count() == 0 and secrets.scan_paths(empty).count() == 0
    row = odd.filter("doc_id = 4").limit(1).withColumn("text", F.lit("token=abcdefgh"))
    assert secrets.redacted(row).select("text", "n_chars").first() == ("[assign]", 8)
