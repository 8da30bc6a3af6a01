"""Quality bands, tag-path ratios, prefix BPE and packing against brute force."""

import base64
import collections
import hashlib
import html
import random
import re
import zlib

import numpy as np
import pytest
import zstandard

from tallyframe.llm import html_text as H, packing as K, prefix_bpe as B, quality as Q
from tests.llm.conftest import ODD

tiktoken = pytest.importorskip("tiktoken")
public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile("[^\x20\x09-\x0d]+")


def words_again(text):
    w = WORD.findall(text)
    windows = list(zip(w, w[1:], w[2:]))
    count = collections.Counter(windows)
    marked = [0] * len(w)
    for i, g in enumerate(windows):
        if count[g] > 1:
            marked[i] = marked[i + 1] = marked[i + 2] = 1
    return sum(marked)


def test_base_counts():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["a", "b", "c ", " ", "\n", "#", "x y z ", "ü"]) for _ in range(rng.randrange(80)))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        w = WORD.findall(text)
        expected = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), words_again(text))
        assert Q.base_counts(text) == expected, text


def test_quality_bands(docs):
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(800))
    noise = " ".join(base64.b85encode(rng.randbytes(30)).decode() for _ in range(200))
    repeated = " ".join(f"{rng.choice('abc')}{'lorem ipsum dolor sit amet '}{i % 4}" for i in range(600))
    rated, name = Q.with_quality(docs([*ODD, (20, prose), (21, noise), (22, repeated)]))
    got = {r["doc_id"]: r[name] for r in rated.collect()}
    assert name != "quality" and got[20]["kept"] and not got[21]["kept"] and not got[22]["kept"]
    assert got[21]["verdict"] == "incompressible" and not got[1]["kept"] and got[1]["n_words"] == 0 and got[6]["base_failed"]
    size = len(prose.encode())
    assert got[20]["ratio"] == pytest.approx(size / len(zstandard.ZstdCompressor(level=3).compress(prose.encode())))
    kept = Q.keep_good(docs([*ODD, (20, prose)]))
    assert kept.columns == docs([(1, "")]).columns and [r["doc_id"] for r in kept.collect()] == [20]
    assert Q.keep_good(docs([])).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>t &amp; t</title><script>var x="</p><article>no</article>";</script></head><body class="has-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="ad">Buy now, buy more, it is cheap.</div>
{open}<h1>Title &eacute;</h1><p>First <b>para.<br><p>Second&nbsp; para,
with a break &lt;tag&gt;.<form><p>Your name</p></form><ul><li>one<li>two</ul><div id="comments"><p>Nice, very nice, I like it a lot, thanks for it.</p></div>{close}
<aside><p>Related</p></aside><footer>&copy; all</footer><!-- <p>gone</p>"""
TEXT = "Title é\nFirst para.\nSecond para, with a break <tag>.\none\ntwo"


@pytest.mark.parametrize(("start", "end"), [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_main_text(start, end):
    assert H.main_text(PAGE.format(open=start, close=end)) == TEXT


SENTENCE = "Words of the text, which go on for a while, and more of them; so it reads, in the end, like prose."


def test_pages_without_article_are_whole():
    p, rest = f"<p>{SENTENCE}</p>", '<div class="footer">Copyright, all rights.</div>'
    lead = f"<body><nav>menu</nav><div id=post><h1>Title</h1>{p}<div class=body>{p * 12}</div>{p}</div>{rest}"
    assert H.main_text(lead) == "\n".join(["Title", *[SENTENCE] * 14])
    assert H.main_text(f"<body><div><div>{p * 17}</div><div>{p * 3}</div></div>{rest}") == "\n".join([SENTENCE] * 20)
    wrapped = f"<div class='layout has-sidebar'><div>{p * 8}</div><div class=sidebar><p>{SENTENCE}</p></div></div><div>Read on</div>"
    assert H.main_text(f"<body>{wrapped}{rest}") == "\n".join([SENTENCE] * 8)
    assert H.main_text(f"<body><div>{p * 2}</div><div class=comments>{p * 9}</div>{rest}") == "\n".join([SENTENCE] * 2)
    assert H.main_text(f"<body><div class=sidebar><a>One</a><a>Two</a></div><div class=cookie-notice>{p}</div>{rest}") == ""


def test_odd_pages(spark):
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", "plain, text", "x"), (3, "u", "plain, text", "x"), (None, "u", "<p>a<p>b", "x"), (5, "u", "<div>" * 3000 + "deep.", "x"),
            (6, "u", '<p class="a' + "<b>" * 2000, "x"), (7, "u", "<nav>only</nav>", "x"), (8, "u", "<article><p>" + "word, " * 100_000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = collections.defaultdict(list)
    for r in H.extract(frame).collect():
        got[r["id"]].append(r["text"])
    assert got[1] == [""] and got[2] == [""] and got[3] == ["plain, text"] * 2 and got[None] == ["a\nb"] and got[5] == ["deep."] and got[7] == [""]
    assert len(got[8][0]) == 599_999 and H.extract(frame.limit(0)).count() == 0


def test_given_pages_give_their_articles(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in H.extract(pages).collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", source[r["id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(p for p in parts if p)


PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def bpe():
    own = B.PrefixBpe.load(PATH)
    return own, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def pieces(rng):
    kind = rng.randrange(4)
    if kind == 0:
        return "".join(rng.choice("ab ") for _ in range(rng.randrange(1, 60)))
    if kind == 1:
        return rng.choice("aé漢 ") * rng.randrange(1, 80)
    return "".join(chr(rng.choice((rng.randrange(32, 127), rng.randrange(160, 600), rng.randrange(0x4E00, 0x5000)))) for _ in range(rng.randrange(1, 40)))


def test_prefix_bpe_equals_the_merges(bpe):
    own, merges = bpe
    rng = random.Random(3)
    coder = B.TextCodec(own, public_tokenizers.PATTERN, memo=50)
    for _ in range(1500):
        text = pieces(rng)
        assert coder.encode(text) == merges.encode_ordinary(text), text
    assert coder.encode("") == [] and own.decode(coder.encode("naïve 🙂")) == "naïve 🙂".encode()


def test_appends_and_edits(bpe):
    own, _ = bpe
    rng = random.Random(4)
    for _ in range(150):
        data = pieces(rng).encode() + rng.randbytes(5)
        cut = rng.randrange(len(data) + 1)
        table = own.table(data[:cut]).append(data[cut:])
        assert table.ids() == own.table(data).ids() and own.decode(table.ids()) == data
        a, b = sorted(rng.randrange(len(data) + 1) for _ in range(2))
        new = pieces(rng).encode()[:20]
        assert table.replace(a, b, new).ids() == own.table(data[:a] + new + data[b:]).ids()


def test_digests(docs, bpe):
    own, merges = bpe
    got = B.digests(docs(ODD), PATH, public_tokenizers.PATTERN).collect()
    assert len(got) == len(ODD)
    for i, text in ODD:
        ids = merges.encode_ordinary(text or "")
        row = next(r for r in got if r["id"] == i)
        assert row["n_tokens"] == len(ids) and row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256((text or "").encode()).hexdigest()
    assert {tuple(r["ids"]) for r in B.encode(docs([(1, "word")]), PATH, public_tokenizers.PATTERN).collect()} == {tuple(merges.encode_ordinary("word"))}
    assert B.digests(docs([]), PATH, public_tokenizers.PATTERN).count() == 0


WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_words_encode_like_texts():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    own = K.WordIds(WORDS, memo=40)
    rng = random.Random(5)
    odd = ["ΑΣ.", "İx,", "a.b", "it's", "<|endoftext|>", "é.", ".́", "3,14.", "…", "x y", "a\x1cb", "ＡＢＣ.", "DON'T,", "!!,"]
    for _ in range(400):
        text = rng.choice(" \n\t").join(rng.choice((pieces(rng), rng.choice(odd))) for _ in range(rng.randrange(6)))
        assert own.encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@pytest.mark.parametrize("capacity", [1, 7, 64, 4096])
def test_cuts_fill_their_classes(capacity):
    classes = K.Classes(capacity)
    for n in [*range(1, 300), 4095, 4096, 4097, 100_001]:
        cut = classes.cut(n)
        assert sum(x for x, _ in cut) == n and all(0 < x <= slot and classes.count[slot] * slot <= capacity for x, slot in cut)
    assert classes.rest_bound < 20_000


def test_pack(docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    whole.encode_special_tokens = True
    rng = random.Random(6)
    rows = [*ODD, *[(100 + i, " ".join(rng.choice(["alpha", "beta", "gamma.", "Delta"]) for _ in range(rng.randrange(400)))) for i in range(150)]]
    got = K.pack(docs(rows), WORDS, capacity=256).toPandas()
    texts = dict(rows)
    for i, g in got[got.id.notna()].groupby("id"):
        ids = np.array([*whole.encode(texts[int(i)] or "", add_special_tokens=False).ids, 2], "<u4")
        copies = sum(1 for a, _ in rows if a == i)
        assert g.length.sum() == copies * len(ids) and set(g.doc_tokens) == {len(ids)}
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    filled = got.groupby("sequence_id").length.sum()
    assert filled.max() <= 256 and (256 * len(filled) - filled.sum()) < 0.05 * filled.sum()
    assert K.pack(docs([]), WORDS).count() == 0
