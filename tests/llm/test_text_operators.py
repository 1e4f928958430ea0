import functools
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from modeflow.llm import fingerprint, html, langid, lattice, lm, packing, secrets, toxicity


# --- op1 ---------------------------------------------------------------------------------------------------------------
PAGE = """<html><head><title>T &amp; x</title><script>var a = "</p>";</script></head><body class="has-sidebar"><header><h2>Site</h2></header><nav><a href="/">Home</a> <a>News</a></nav>
<div class="cookie-notice">We use cookies on this site to make it work for you and us.</div><aside><p>Related reading of some length that is not the article at all.</p></aside>
<main><article><header><h1>Head&nbsp;line</h1></header><p>First <b>bold</b>ed &lt;tag&gt; &#233;
 text.</p><div class="ad">Buy now and save a lot of money on things.</div><p>x</p><ul><li><a href="#">one</a></li></ul><form><label>Name</label><input></form><section id="comments"><p>Nice post, I like it a lot and more.</p></section><p>Last.</p></article></main><footer>&copy; site</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head line First bolded <tag> é text. x one Last."
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p>") == ""
    assert html.main_text("<article><p>one &am") == "one &am" and html.main_text("<article><p>one <scri") == "one"
    assert html.main_text("<article><p>one<script>x") == "one" and html.main_text("<article>a<!-- b --><br>c") == "a c"
    plain = " ".join(f"word{i}" for i in range(40))
    assert html.main_text(f"<div><a>Home</a> <a>News</a> <a>More</a></div><p>{plain}</p><p>{plain}</p><div><a>Imprint</a></div>") == f"{plain} {plain}"
    rows = html.labelled_blocks()
    assert len(rows) >= 150 and all(html.keeps(tuple(r[:-1])) == bool(r[-1]) for r in rows)
    assert html.main_text("<article>y</article>" + "<div class=ad>" * 3000 + "<p>x" * 3000) == "y"  # in time


TEXT = " ".join(f"word{i}" for i in range(25))
LINKS = "<a href=1>one two three</a> <a href=2>four five six</a>"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f'<div class="content no-sidebar"><article><p>{TEXT}</p></article></div>', TEXT),
        (f'<div class="page no-sidebar"><main><p>{TEXT}</p></main></div>', TEXT),
        (f'<article class="post comments-open"><p>{TEXT}</p></article>', TEXT),
        (f'<div class="social-science"><p>{TEXT}</p></div>', TEXT),
        (f'<article><p>{TEXT}</p><blockquote class="related-work"><p>{TEXT}</p></blockquote></article>', f"{TEXT} {TEXT}"),
        (f'<article><p class="ad">Buy<p>{TEXT}</article>', TEXT),  # implied end tags
        (f'<article><ul><li class="promo">Buy<li>{TEXT}</ul></article>', TEXT),
        (f'<table><tr><td class="ad">Buy<td>{TEXT}<tr><td>{TEXT}</table>', f"{TEXT} {TEXT}"),
        (f'<article><p title="see class=ad here">{TEXT}</p></article>', TEXT),
        (f"<article><h3><a href=x>a teaser</a></h3><p>short <a>more</a></p></article><div id=story><h2>Story head</h2><p>{TEXT}</p><p>{TEXT}</p></div>", f"Story head {TEXT} {TEXT}"),
        (f'<article><p>{TEXT}</p><div class="outbrain">{LINKS}</div><p>{TEXT}</p></article>', f"{TEXT} {TEXT}"),
        (f'<article><p>{TEXT}</p><div class="outbrain">{LINKS}</div></article>', TEXT),
        (f"<article><p>{TEXT}</p><div>{TEXT}</div></article>", f"{TEXT} {TEXT}"),  # the same place: words and links decide
        (f"<div class=x/><article><p>{TEXT}</p></article></div>", TEXT),
        (f'<article><p>{TEXT}</p><div class="cookie-notice">{TEXT}</div><div class="ad-slot">{TEXT}</div><ol class="comment-list"><li>{TEXT}</ol></article>', TEXT),
        (f'<article><p>{TEXT} {TEXT}</p></article><section id="comments"><article class="comment"><p>{TEXT}</p></article></section>', f"{TEXT} {TEXT}"),
        (f"<form><div>{LINKS}</div><div>{TEXT}</div><div>{TEXT}</div></form>", f"{TEXT} {TEXT}"),
    ],
)
def test_pages_of_many_kinds(page, want):
    assert html.main_text(page) == want


def test_shapes_decide_inside_an_article():
    """Words and link densities change the verdict of blocks that share all other features."""
    rng = np.random.default_rng(0)
    shapes = [(int(rng.exponential(20)) + 1, rng.choice([0.0, rng.random(), 1.0]), int(rng.exponential(30)), rng.choice([0.0, 1.0]), int(rng.exponential(30)), rng.choice([0.0, 1.0]), int(rng.integers(0, 4))) for _ in range(2000)]
    kept = [html.keeps((*s, 0, 1.0, 0, 0)) for s in shapes]
    assert 0.3 < np.mean(kept) < 0.97 and all(k for k, s in zip(kept, shapes, strict=True) if s[1] == 0)


def test_pages(spark, sf):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = html.op1_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:  # the article of these pages, by a plain cut
        m = re.search(r"<article>(.*?)(</article>|\Z)", pages[r["page_id"]], re.DOTALL)
        want = " ".join(html.unescape(re.sub(r"<[^>]*(?:>|\Z)", lambda t: "" if t[0] in ("<b>", "</b>") else " ", m[1])).split())
        assert r["text"] == want and r["n_chars"] == len(want)
    odd = spark.createDataFrame([(1, None, "a"), (1, "<article>" + "<p>long words</p>" * 20_000, "b"), (2, "", None)], "page_id bigint, html string, text string")
    assert sorted((r["page_id"], r["n_chars"]) for r in html.extract(odd).collect()) == [(1, 0), (1, 20_000 * 11 - 1), (2, 0)]
    assert html.extract(odd.limit(0)).count() == 0
    clash = spark.createDataFrame([(1, None, "<p>a b</p>", 7, "t")], "page_id bigint, url string, html string, n_chars bigint, text string")
    assert [(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in html.extract(clash).collect()] == [(1, None, "a b", 3)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="<>/ab p=\"'&;!-\n", max_size=80))
def test_any_page_is_read(page):
    assert isinstance(html.main_text(page), str)


# --- op2 ---------------------------------------------------------------------------------------------------------------
def check_pieces(rows, texts, tokenizer):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in by_doc.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], "<u4")
        repeats = sum(p["start"] == 0 for p in pieces)
        assert sum(p["length"] for p in pieces) == repeats * len(ids)
        assert all(zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"] and p["doc_tokens"] == len(ids) for p in pieces)
        if repeats == 1:
            at = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert p["start"] == at
                at += p["length"]
    for pieces in by_seq.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and at & (at - 1) == 0  # no padding
    assert set(by_doc) == set(texts)


def test_packing(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    t = packing.encoder(packing.default_path()).tokenizer
    for df in (docs, odd_docs):
        check_pieces(packing.pack(df).collect(), {r["doc_id"]: r["text"] for r in df.collect()}, t)
    assert packing.pack(no_docs).count() == 0
    groups = [r["t"] for r in packing.pack(docs).groupBy("step_group").agg(F.sum("length").alias("t")).collect()]
    assert max(groups) <= packing.STEP_TOKENS + 2048


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60), st.text(alphabet="aBé'sdtl ré½²12.<|>_\tßſİΣ", max_size=60))
def test_encoder_equals_tokenizer(a, b):
    e = packing.encoder(packing.default_path())
    texts = [a, b, f"{a} {b}", "<|endoftext|>"]
    assert [x.tolist() for x in e(texts)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in texts]


def test_encoder_of_larger_vocabularies():
    wide = packing.Encoder(packing.default_path())
    wide.kind = np.dtype("<u4")
    text = "A page of words, 12 of them; it's over."
    assert wide([text])[0].tolist() == wide.tokenizer.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 5000), max_size=40))
def test_packer_keeps_every_token(lengths):
    p = packing.Packer()
    sequences = [s for i, n in enumerate(lengths) for s in p.add(i, n)]
    sequences += [*p.block(), *p.finish()]
    seen = Counter(t for s in sequences for d, a, n in s for t in ((d, x) for x in range(a, a + n)))
    assert seen == Counter((i, x) for i, n in enumerate(lengths) for x in range(n)) and all(sum(x[2] for x in s) & (sum(x[2] for x in s) - 1) == 0 for s in sequences)


# --- op3 ---------------------------------------------------------------------------------------------------------------
def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abidotlmr", min_size=1, max_size=12))
def test_automaton_equals_edit_distance(word):
    terms = (("idiot", False, 1), ("tortoise", False, 1), ("abominable", False, 2), ("mold", False, 0), ("dora", True, 0))
    got = toxicity.automaton(terms)[0].match(word)
    near = sorted((distance(word, t), i) for i, (t, stem, e) in enumerate(terms) if not stem and distance(word, t) <= e)
    if word.startswith("dora") and not (near and near[0][0] == 0):
        assert got == (4, 0)
    else:
        assert got == ((near[0][1], near[0][0]) if near else None)


def test_toxicity(spark, odd_docs, no_docs):
    rows = [(i, f"the {w} of plain words number{i} here", int(w in ("idiot", "grumbel"))) for i in range(400) for w in [("calm", "idiot", "quiet", "grumbel")[i % 4]]]
    model = toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    assert ("grumbel", False, 1) in model.terms
    s = model.score
    assert s("you grumbel") > 0.9 and s("you grunbel") > 0.3 and s("the calm of plain words") < 0.1 and s("") == s("nothing of note")
    assert s('he said the word "grumbel" here') < s("a grumbel here") and s("you are a grumbel") >= s("a grumbel here")
    out = {r["doc_id"]: r["score"] for r in toxicity.scored(odd_docs, model).collect()}
    assert len(out) == 10 and all(0 <= x < 0.3 for x in out.values()) and out[1] == out[2]
    assert toxicity.scored(no_docs, model).count() == 0
    none = toxicity.learn(spark.createDataFrame([], "id bigint, text string, toxic int"))
    assert none.score("hello") == none.score("you idiot") == none.score("") < 0.3  # without labels there is no evidence


def test_toxicity_of_a_broad_lexicon(spark):
    """Misspellings of learned words that a small share of the toxic documents holds."""
    terms = [f"{a}{b}" for a in ("zwark", "plonth", "vurmig", "quesk", "drabul", "fnorpel") for b in ("iddle", "omat", "ung", "esque", "arro", "ibus")]
    rows = [(i, f"the {terms[i // 2 % 36] if i % 2 else 'calm'} of plain words number{i} here", i % 2) for i in range(1440)]
    model = toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    for t in terms:
        assert model.score(f"a {t} here") > 0.9 and model.score(f"a {t[:3]}x{t[4:]} here") > 0.3 and model.score(f"a {t[:4] + t[5:]} here") > 0.3
    assert model.score("a moron here") == model.score("a calm here") < 0.1


def test_toxicity_beside_copies(spark):
    """A long toxic text in many copies, whose rare words are many and strong, and other toxic texts with words of their own."""
    long = " ".join(f"{a}{b}{c}{d}" for a in ("brelo", "cundi", "dravo", "fimps", "gortu", "hulka", "jarvo", "klepi") for b in ("stan", "meri", "voku", "tald", "ripo", "zenk", "wolb", "quar") for c in ("ed", "um", "ost", "ine", "arg", "ily", "ops", "eth", "unk") for d in ("a", "o", "ip", "us"))
    words = ("zwarkle", "plonth", "fnorpel", "quesk")
    rows = [(i, long, 1) for i in range(300)] + [(i, f"the {words[i % 4]} of plain words number{i} here", 1) for i in range(300, 420)] + [(i, f"the calm of plain words number{i} here", 0) for i in range(420, 1000)]
    model = toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    assert all(model.score(f"a {w} here") > 0.9 for w in words) and model.score(long) > 0.9 and model.score("a calm here") < 0.3
    assert len(model.terms) < 20


def test_contexts_are_swept_once():
    """One MB of quoted hits; a quotation ends with its line; the nearest words on both sides count."""
    hits = {"idiot": (0, 0)}
    began = time.time()
    assert toxicity.contexts('"idiot" ' * 125_000, hits) == {(0, 0): {"quoted plain"}} and time.time() - began < 3
    assert toxicity.contexts('"an idiot\nidiot"', hits) == {(0, 0): {"plain"}} and toxicity.contexts('a " b idiot c', hits) == {(0, 0): {"plain"}}
    near, far = "x " * toxicity.WINDOW, "x " * (toxicity.WINDOW + 1)
    kinds = lambda t: toxicity.contexts(t, hits)[0, 0]
    assert kinds(f"you {near[2:]}idiot") == kinds(f"idiot {near[2:]}you") == {"addressed"} and kinds(f"you {far[2:]}idiot") == kinds(f"idiot {near}you") == {"plain"}
    assert kinds(f"“said {near}you idiot”") == {"quoted addressed"} and kinds("he said you idiot") == {"reported"}


def test_context_factors_are_learned(spark):
    """Quoted matches of clean documents lower the factor of quotation, quoted matches of toxic ones raise it."""
    def learned(toxic_quotes):
        rows = [(i, f"the {'grumbel' if i % 2 else 'calm'} of plain words number{i}", i % 2) for i in range(400)]
        rows += [(1000 + i, f'a text {i} with "grumbel" inside', toxic_quotes) for i in range(60 if toxic_quotes else 8)]
        rows += [(2000 + i, f'a text {i} with "calm" inside', 0) for i in range(60)]
        return toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int")).factors["quoted plain"]

    assert learned(0) < toxicity.FACTORS["quoted plain"] < learned(1)


def test_terms_of_any_length(spark):
    """Short words and very long runs are learned; the latter as they are."""
    blob = "ab1" * 50
    rows = [(i, f"{('calm', 'zog', 'quiet', blob)[i % 4]} of plain words number{i} here", i % 2) for i in range(400)]
    model = toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    assert model.score("a zog here") > 0.9 and model.score(f"a {blob} here") > 0.9 and model.score(f"a {blob}x here") < 0.3 and model.score("a calm here") < 0.3


def named(n, rng):
    """Different made-up words of eight letters, far from each other."""
    out = []
    while len(out) < n:
        w = "".join(rng.choice("bcdfghjklmnpqrstvwz" if i % 2 else "aeiou") for i in range(8))
        if all(distance(w, o) > 3 for o in out):
            out.append(w)
    return out


def test_rare_terms_are_learned(spark):
    """200 terms, each in one of 200 toxic documents and in no other: learned, with their misspellings."""
    rng = random.Random(1)
    terms = named(200, rng)
    text = lambda w, i: " ".join([*(f"p{rng.randrange(300)}" for _ in range(6)), w, *(f"p{rng.randrange(300)}" for _ in range(6)), f"number{i}"])
    rows = [(i, text(terms[i % 200], i), 1) for i in range(4000)] + [(i, text("calm", i), 0) for i in range(4000, 8000)]
    model = toxicity.learn(spark.createDataFrame(rows, "id bigint, text string, toxic int"))
    found = [t for t in terms if model.score(f"a {t} here") >= 0.3]
    assert len(found) >= 0.9 * len(terms)
    assert sum(model.score(f"a {t[:3]}x{t[4:]} here") >= 0.3 for t in found) >= 0.9 * len(found)
    assert all(model.score(f"a p{i} calm thing here") < 0.3 for i in range(300)) and model.score("") < 0.3


@pytest.mark.parametrize("share", [0.05, 0.5, 0.9])
def test_no_evidence_stays_below_the_limit(spark, share):
    """Whatever share of the labels is toxic, texts without a match are clean, also where no term can be learned."""
    rows = [(i, f"the {'grumbel' if i < 2000 * share else 'calm'} of plain words number{i} here", int(i < 2000 * share)) for i in range(2000)]
    frame = lambda rows: spark.createDataFrame(rows, "id bigint, text string, toxic int")
    model = toxicity.learn(frame(rows))
    assert model.score("a grumbel here") > 0.5 and model.score("a calm here") == model.score("") < 0.3
    blind = toxicity.learn(frame([(i, f"plain words number{i}", t) for i, _, t in rows]))
    assert blind.score("plain words") < 0.3 and blind.score("") < 0.3


def test_support_follows_chance():
    """A term passes if hardly any of the tested ones would by chance; the size of the sample does not matter."""
    assert toxicity.support(10_000, 4000, 4000) == toxicity.support(10_000, 40, 40) == 18
    assert toxicity.support(10_000, 400, 3600) == toxicity.SUPPORT == toxicity.support(0, 0, 0) == toxicity.support(5, 9, 0)
    assert toxicity.support(10**6, 4000, 4000) < toxicity.support(10**9, 4000, 4000) < 40


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["idiot", "idiat", "tortoise", "tortoisse", "tortose", "calm", "mold", "said", "you", '"', "\n", "x", "dorado"]), max_size=30))
def test_scores_equal_their_definition(parts):
    """Every word against every term by edit distance, every context by looking at the words around."""
    terms = (("idiot", False, 1), ("tortoise", False, 1), ("mold", False, 0), ("dora", True, 0))
    weights = {(0, 0): 5.0, (0, 1): 2.0, (1, 0): 4.0, (1, 1): 0.0, (2, 0): 3.0, (3, 0): 1.5}
    model = toxicity.Model(terms, weights, -2.0, -1.0)
    text = " ".join(parts)
    tokens = [(m.start(), m.group()) for m in toxicity._TOKEN.finditer(text)]
    kinds = {}
    for i, (at, w) in enumerate(tokens):
        near = [(distance(w, t), k) for k, (t, stem, e) in enumerate(terms) if not stem and distance(w, t) <= e]
        hit = (min(near)[1], min(near)[0]) if near else (3, 0) if w.startswith("dora") else None
        if hit is None or not weights[hit]:
            continue
        around = {x for _, x in tokens[max(0, i - toxicity.WINDOW) : i + toxicity.WINDOW + 1]}
        line = text[text.rfind("\n", 0, at) + 1 : (text + "\n").index("\n", at)]
        marks = [k for k, c in enumerate(line) if c == '"']
        place = at - text.rfind("\n", 0, at) - 1
        quoted = any(a < place < b for a, b in zip(marks[::2], marks[1::2], strict=False))
        kind = "reported" if "said" in around else "addressed" if "you" in around else "plain"
        kinds.setdefault(hit, set()).add(f"quoted {kind}" if quoted else kind)
    total = sum(weights[h] * max(toxicity.FACTORS[k] for k in ks) for h, ks in kinds.items())
    want = 1 / (1 + math.exp(2.0 - min(toxicity.MOST, total))) if kinds else 1 / (1 + math.exp(3.0))
    assert model.score(text) == pytest.approx(want)


@pytest.mark.parametrize(("sf", "recall"), [("sf0.01", 0.6), ("sf0.1", 0.8)])
def test_toxicity_query(spark, sf, recall):
    """Held-out recall and false positives; with few labels the rarer word families are not learned."""
    sf = f"/root/testdata/{sf}"
    got = toxicity.op3_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").cache()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    clean, toxic = (got.where(f"held_out and toxic = {k}") for k in (0, 1))
    caught, false = toxic.where("predicted = 1").count(), clean.where("predicted = 1").count()
    assert false <= 0.02 * clean.count() and toxic.count() > 10 and caught >= recall * toxic.count() and caught >= 0.85 * (caught + false)
    assert got.where("predicted <> cast(score >= 0.3 as int)").count() == 0
    seeds = spark.read.parquet(f"{sf}/documents.parquet").where(r"text rlike '\\b(idiot|moron|scum)\\b'")
    assert got.join(seeds, "doc_id", "left_semi").where("predicted = 0").count() <= (0 if recall < 0.7 else 0.02 * seeds.count())
    got.unpersist()


def test_filter_keeps_columns(spark, odd_docs):
    labels = spark.createDataFrame([(4, 0, 0), (4, 0, 1), (99, 1, None)], "doc_id bigint, quality int, toxic int")
    kept = toxicity.filter_toxic(odd_docs, labels, F.lit(True))
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(r["doc_id"] for r in odd_docs.collect())  # null and empty texts, too


# --- op5 ---------------------------------------------------------------------------------------------------------------
def plain_base(text):
    a = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out = [(m.start(), 0, m.end()) for m in a.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, secrets.BASE[k]) for s, k, e in sorted(out)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "TOKEN", "api_key", "=", ":", " ", '"', "secret", "abc123", "AKIA", "ABCDEFGH12345678", "0a1b2c3d4e5f", "é", "\n", "ſecret", "passwd"]), max_size=14))
def test_base_spans(parts):
    assert secrets.base_spans("".join(parts)) == plain_base("".join(parts))


def test_long_weak_parts():
    """Tokens, identifiers and endpoints of any length are whole parts."""
    token = "Zx81kQp0Lm29Rt47Vb53Nw" * 20
    spans = lambda t: [(t[s:e], k) for s, e, k in sorted(secrets.linked_spans(t, secrets.base_spans(t)))]
    who, where = "user=" + "adm1n" * 20, "https://db.example.com/" + "path/" * 60
    assert spans(f"{who} {token}") == [(who, "who"), (token, "what")]
    assert (where, "where") in spans(f"{token} at {where}")


def test_links_need_complements(spark, odd_docs, no_docs):
    key, token = "AKIA" + "A1" * 10, "Zx81kQp0Lm29Rt47Vb53Nw"
    kinds = lambda t: [k for *_, k in secrets.linked_spans(t, secrets.base_spans(t))]
    assert kinds(f"just {token} here") == [] and kinds("see https://db.example.com/x") == [] and kinds("mail a.b@example.com") == []
    assert kinds(f"id {key} and {token}") == ["what"]
    assert sorted(kinds(f"user=adm1n {token} at https://db.example.com/x")) == ["what", "where", "who"]
    assert kinds(f"user=adm1n\n\n{token}") == [] and sorted(kinds("user=adm1n " + "x " * 2500 + token)) == ["what", "who"]
    text = "user=adm1n " + "x " * 200 + token
    assert secrets.linked_spans(text, [], 160) == [] != secrets.linked_spans(text, [], 600)
    mail = "a" * 80 + ".b+c@mail.example.com"
    assert [(text[s:e], k) for text in [f"{mail} {token}"] for s, e, k in sorted(secrets.linked_spans(text, []))] == [(mail, "who"), (token, "what")]
    odd = f"..x@a.co ._y@b.co -@c.co %z@d-e.co @f.co w@g {token}"
    assert [odd[s:e] for s, e, k in sorted(secrets.linked_spans(odd, [])) if k == "who"] == ["x@a.co", "_y@b.co", "z@d-e.co"]
    got = secrets.scan(odd_docs).collect()
    assert len(got) == odd_docs.count() and all(r["spans"] == [] for r in got) and secrets.scan(no_docs).count() == 0


def plain_links(text, reach):
    """Every pair of a weak part and a complementary one, by the definition."""
    reach = len(text) if reach is None else reach
    base = secrets.base_spans(text)
    weak = [(m.start(), m.end(), "what") for m in secrets._WHAT.finditer(text) if secrets.opaque(m.group())]
    if not base and not weak:
        return []
    weak += [(m.start(), m.end(), k) for k, p in (("where", secrets._WHERE),) for m in p.finditer(text)]
    weak += [(max(m.start(), m.start("mail")), m.end(), "who") for m in secrets._WHO.finditer(text)]
    free = [w for w in weak if not any(b[0] < w[1] and b[1] > w[0] for b in base)]
    scope = lambda at: len([m for m in re.finditer(r"\n[ \t\r]*\n", text) if m.start() <= at])
    side = {"access": "who", "assign": "what", "hex": "what"}
    needs = {"who": {"what"}, "where": {"what"}, "what": {"who", "where"}}
    return [w for w in free if any(side.get(s[2], s[2]) in needs[w[2]] and scope(s[0]) == scope(w[0]) and s[:2] != w[:2] and s[0] <= w[1] + reach and s[1] + reach >= w[0] for s in [*base, *free])]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["Zx81kQp0Lm29Rt47Vb53Nw ", "user=adm1n ", "user=Zx81kQp0Lm29Rt47Vb53Nw ", "https://db.example.com/x ", "a.b@example.com ", "AKIA" + "A1" * 10 + " ", "10.0.0.1 ", "\n\n", "words of text ", "secret=abcdef12 ", "0a1b2c3d4e5f" * 2 + " "]), max_size=14), st.sampled_from([0, 5, 30, 160, None]))
def test_links_equal_brute_force(parts, reach):
    text = "".join(parts)
    assert sorted(secrets.linked_spans(text, secrets.base_spans(text), reach)) == sorted(plain_links(text, reach))


@pytest.mark.parametrize("part", ["a.", "a@", "a-b.", "user=", "%", "a.b@c", "x@y.z ", "Zx81kQp0Lm29Rt47Vb53Nw.", "http://"])
def test_long_runs_in_time(part):
    """A million letters of anything that begins a weak part."""
    text = "Zx81kQp0Lm29Rt47Vb53Nw " + part * (1_000_000 // len(part))
    began = time.time()
    secrets.linked_spans(text, secrets.base_spans(text))
    assert time.time() - began < 8


def test_many_spans_in_time():
    """One span that covers a scope's start, and very many weak ones after it."""
    text = "https://a.example.com/" + "x" * 200_000 + " " + "a.b@example.com " * 20_000
    began = time.time()
    assert secrets.linked_spans(text, [(0, 3, "assign")]) is not None and time.time() - began < 5


def test_secret_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in secrets.op5_secrets(spark, sf).collect():
        base = plain_base(texts[r["doc_id"]] or "")
        spelled = ",".join(f"{k}:{s}:{e}" for s, e, k in base)
        assert r["base_sha256"] == hashlib.sha256(spelled.encode()).hexdigest() and (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == n for *_, k in base) for n in secrets.BASE)
        assert set(filter(None, spelled.split(","))) <= set(r["spans"].split(","))


# --- lattice, op6, op9 -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def tiny():
    pieces = sorted({b"a", b"b", b"ab", b"ba", b"aba", *(bytes([i]) for i in range(256))})
    p = np.random.default_rng(2).dirichlet(np.ones(len(pieces))) * 0.7
    return lattice.Vocabulary(pieces), p


def segmentations(word, known):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in known:
            for rest in segmentations(word[n:], known):
                yield [word[:n], *rest]


def plain_forward(v, word, logs):
    """The forward recursion over all earlier positions, term by term."""
    alpha = [0.0]
    for e in range(1, len(word) + 1):
        alpha.append(np.logaddexp.reduce([alpha[i] + logs[v.ids[word[i:e]]] for i in range(e) if word[i:e] in v.ids]))
    return alpha[-1]


@pytest.mark.parametrize("copies", [1, 40])
def test_lattice_of_any_length_and_floor(copies):
    """Words of 1 to 200 bytes, few or many of a length, under models with tiny floors; pieces of any length count."""
    v, own = lattice.load(lattice.default_path())
    assert v.longest > 10 and sum(len(p) > 10 for p in v.pieces) > 500 and all(p == p.lower() for p in v.pieces if len(p) > 1)
    rng = np.random.default_rng(copies)
    floored = np.maximum(rng.dirichlet(np.full(v.n, 0.001)), 1e-12)
    models = np.stack([own, floored / floored.sum() * 0.75])
    lengths = np.repeat([1, 2, 7, 44, 47, 48, 49, 120, 200], copies)
    words = [bytes(rng.choice(np.frombuffer("abetionschüÉqzxj".encode(), np.uint8), n)) for n in lengths] + [b"qzxj" * 11, b"responsibilities"]
    ends = np.cumsum([len(w) for w in words])
    starts, data = ends - [len(w) for w in words], np.frombuffer(b"".join(words), np.uint8)
    got = lattice.marginals(v, models, data, starts, ends)
    for m, p in enumerate(models):
        c = math.log((1 - p.sum()) / p.sum())
        for k in [*range(0, len(lengths), copies), len(words) - 2, len(words) - 1]:
            assert got[m, k] == pytest.approx(plain_forward(v, words[k], np.log(p)) + c, rel=1e-9)
    together = lattice.expected_counts(v, own, data, starts, ends, np.ones(len(words)))
    alone = sum(lattice.uses(v, np.log(own), np.frombuffer(w, np.uint8)) for w in words)
    assert np.allclose(together, alone) and together @ np.array([len(p) for p in v.pieces]) == pytest.approx(ends[-1])


def test_long_words_in_blocks(tiny, monkeypatch):
    v, p = tiny
    word = np.frombuffer(b"abbaabab" * 30, np.uint8)
    whole, used = lattice.forward(v, word, np.log(p)), lattice.uses(v, np.log(p), word)
    monkeypatch.setattr(lattice, "BLOCK", 7)
    assert np.allclose(lattice.forward(v, word, np.log(p)), whole) and np.allclose(lattice.uses(v, np.log(p), word), used)


def test_lattice_sums_all_segmentations(tiny):
    v, p = tiny
    words = [b"a", b"abab", b"abba", b"babab", b"cab", b"ab" * 40]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    got = lattice.marginals(v, p[None], data, starts, ends)[0]
    for w, x in zip(words[:-1], got, strict=False):
        want = sum(math.prod(p[v.ids[s]] for s in seg) for seg in segmentations(w, v.ids)) * 0.3 / 0.7
        assert x == pytest.approx(math.log(want))
    assert got[-1] == pytest.approx(plain_forward(v, words[-1], np.log(p)) + math.log(0.3 / 0.7))
    counts = lattice.expected_counts(v, p, data, starts[:2], ends[:2], np.array([2.0, 1.0]))
    segs = [(math.prod(p[v.ids[s]] for s in seg), seg) for seg in segmentations(b"abab", v.ids)]
    want = Counter({b"a": 2.0})
    for q, seg in segs:
        for s in seg:
            want[s] += q / sum(x for x, _ in segs)
    assert all(counts[v.ids[s]] == pytest.approx(n) for s, n in want.items()) and counts.sum() == pytest.approx(sum(want.values()))


def test_lm_scores(spark, sf, odd_docs, no_docs):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = lm.op6_lattice_lm(spark, sf).collect()
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    train = [t for i, t in docs.items() if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in train for w in split(t))
    c["\n"] = len(train)  # the end
    n, v = sum(c.values()), len(c)
    assert len(got) == len(docs)
    for r in got:
        tokens = [*split(docs[r["doc_id"]]), "\n"]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(tokens), sum(c[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens))
    pieces, own = lattice.load(lattice.default_path())
    end, stop = c["\n"] / n, math.log((1 - own.sum()) / own.sum())
    word_score = functools.lru_cache(None)(lambda w: plain_forward(pieces, w.encode(), np.log(own)) + stop)
    for r in got[:100]:  # the marginal of the document under the vocabulary's own weights, one end for each document
        words = split(docs[r["doc_id"]])[:400]
        if len(words) == r["n_tokens"] - 1:
            assert r["score"] == pytest.approx(sum(word_score(w) / math.log(10) + math.log10(1 - end) for w in words) + math.log10(end))
    held = [r for r in got if r["held_out"]]
    assert sum(r["adapted_score"] for r in held) > 0.85 * sum(r["score"] for r in held)  # adapted to the corpus, better on unseen texts
    for learn in (F.lit(True), F.lit(False), F.col("doc_id") > 7):
        odd = lm.score(odd_docs, learn).collect()
        assert len(odd) == odd_docs.count() and all(math.isfinite(r["score"]) and r["score"] < 0 for r in odd) and {r["n_tokens"] for r in odd if r["id"] < 4} == {1}
    assert lm.score(no_docs, F.lit(True)).count() == 0
    nulls = spark.createDataFrame([(None, "a b"), ("x", "a"), (None, None)], "doc_id string, text string")  # ids of any type, null ones too
    assert sorted((r["id"] or "", r["n_tokens"], r["n_known"], r["train_tokens"]) for r in lm.score(nulls, F.lit(True)).collect()) == [("", 1, 1, 6), ("", 3, 3, 6), ("x", 2, 2, 6)]


def test_lm_is_a_distribution(spark):
    """All words of two letters and the end together have probability 1 at most."""
    letters = "abcdefghij"
    train = spark.createDataFrame([(i, f"{letters[i % 10]}{letters[i * 7 % 10]} ab") for i in range(50)], "doc_id bigint, text string")
    probes = spark.createDataFrame([(1000 + i, w) for i, w in enumerate([a + b for a in letters for b in letters])], "doc_id bigint, text string")
    scores = {r["id"]: r["score"] for r in lm.score(train.union(probes).union(spark.createDataFrame([(9999, "")], "doc_id bigint, text string")), F.col("doc_id") < 1000).collect()}
    total = sum(10 ** (scores[i] - scores[9999]) for i in scores if 1000 <= i < 9999)
    assert 0 < total <= 1 - 10 ** scores[9999] + 1e-9


def test_lm_word_scores(spark, sf, odd_docs):
    """With words as arcs held-out texts cost little more than their word counts say, which spell no unknown word; the model is a distribution."""
    held = [r for r in lm.op6_lattice_lm(spark, sf).collect() if r["held_out"]]
    total = {c: sum(r[c] for r in held) for c in ("base_score", "adapted_score", "word_score")}
    assert all(math.isfinite(r["word_score"]) for r in held) and total["word_score"] > 0.95 * total["adapted_score"] and total["word_score"] > 1.35 * total["base_score"]
    letters = "abcdefghij"
    words = [a + b for a in letters for b in letters]
    rows = [(i, f"{words[i * 7 % 23]} ab") for i in range(50)] + [(1000 + i, w) for i, w in enumerate(words)] + [(9999, "")]
    got = {r["id"]: r["word_score"] for r in lm.score(spark.createDataFrame(rows, "doc_id bigint, text string"), F.col("doc_id") < 1000).collect()}
    assert 0.8 < sum(10 ** (x - got[9999]) for i, x in got.items() if 1000 <= i < 9999) / (1 - 10 ** got[9999]) <= 1 + 1e-9
    for learn in (F.lit(True), F.lit(False)):
        odd = lm.score(odd_docs, learn).collect()
        assert all(math.isfinite(r["word_score"]) and r["word_score"] < 0 for r in odd)


def test_languages(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    got = langid.op9_langid(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = got.where("held_out and lang is not null and lang_pred <> 'und'")
    assert got.count() == 1000 and held.where("lang = lang_pred").count() >= 0.95 * held.count()
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("__id", F.col("doc_id"))
    model = langid.learn(docs, "text", "lang", lattice.default_path())
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(odd_docs, model).collect()}
    assert odd[1] == odd[2] == odd[3] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values()) and odd[7][0] in model[0]
    signs = spark.createDataFrame([(1, "123 !? …"), (2, "日本"), (3, None)], "doc_id bigint, text string")
    assert [r["lang_pred"] == "und" for r in langid.identify(signs, model).orderBy("doc_id").collect()] == [True, False, True]
    assert langid.identify(no_docs, model).count() == 0
    empty = langid.learn(no_docs.withColumn("__id", F.col("doc_id")), "text", "lang", lattice.default_path())
    assert {r["lang_pred"] for r in langid.identify(odd_docs, empty).collect()} == {"und"}


# --- op7 ---------------------------------------------------------------------------------------------------------------
def plain_digest(text):
    """The digest by its definition, one triplet and one bucket at a time."""
    raw = text.encode()
    counts = [0] * 256
    for i in range(len(raw) - 2):
        h = (raw[i] * 0x9E3779B1 + raw[i + 1] * 0x85EBCA77 + raw[i + 2] * 0xC2B2AE3D) % 2**32
        counts[((h ^ (h >> 15)) * 0x2C1B3C6D % 2**32) >> 24] += 1
    q1, q2, q3 = (sorted(counts)[k] for k in (63, 127, 191))
    codes = [(c > q1) + (c > q2) + (c > q3) for c in counts]
    body = bytes(codes[i] << 6 | codes[i + 1] << 4 | codes[i + 2] << 2 | codes[i + 3] for i in range(0, 256, 4))
    length = 0 if not raw else min(255, 1 + math.floor(4 * math.log2(len(raw))))
    ratio = lambda q: q * 16 // q3 % 16 if q3 else 0
    return (hashlib.blake2b(raw, digest_size=2).digest() + bytes([length, ratio(q1) << 4 | ratio(q2)]) + body).hex()


def plain_likeness(one, two):
    if one == two:
        return 1.0
    a, b = bytes.fromhex(one), bytes.fromhex(two)
    codes = lambda x: [c >> s & 3 for c in x[4:] for s in (6, 4, 2, 0)]
    cost = lambda x, y: 8 if abs(x - y) == 3 else 2 * abs(x - y)
    ring = lambda x, y: min(abs(x - y), 16 - abs(x - y))
    total = 1 + sum(map(cost, codes(a), codes(b))) + min(60, 4 * abs(a[2] - b[2])) + min(24, 2 * (ring(a[3] >> 4, b[3] >> 4) + ring(a[3] & 15, b[3] & 15)))
    most = sum(cost(x, 0) for x in codes(a)) + sum(cost(x, 0) for x in codes(b))
    return max(0.0, 1 - total / max(1, min(420, most)))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=40), st.text(alphabet="abc de", max_size=2000))
def test_digest_equals_its_definition(a, b):
    assert fingerprint.digest(a) == plain_digest(a) and fingerprint.digest(b) == plain_digest(b)
    assert fingerprint.likeness(plain_digest(a), plain_digest(b)) == pytest.approx(plain_likeness(plain_digest(a), plain_digest(b)))


def test_short_texts_are_not_alike():
    like = lambda a, b: fingerprint.likeness(fingerprint.digest(a), fingerprint.digest(b))
    assert like("no", "ja") == like("", "zz") == like("cat", "dog") == 0 and like("cat", "cat") == like("", "") == 1
    assert like("the quick brown fox", "the quick brown fix") > 0.5 > like("the quick brown fox", "völlig anderer Text")


def check_prints(rows, docs):
    docs = sorted(((i, t or "") for i, t in docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    got = sorted((tuple(r) for r in rows), key=order)
    want = []
    for k, (i, t) in enumerate(docs):
        nxt = docs[(k + 1) % len(docs)][1]
        new = fingerprint.edited(t, nxt)
        a, b, c = map(fingerprint.digest, (t, new, nxt))
        want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), a, b, fingerprint.likeness(a, b), fingerprint.likeness(a, c)))
    assert got == sorted(want, key=order)


def test_fingerprints(spark, sf, odd_docs, no_docs):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    nulls = spark.createDataFrame([(1, "one text"), (None, "no id"), (3, "three"), (2, None), (None, "a second one")], "doc_id bigint, text string")
    for df in (docs, odd_docs, docs.limit(1), docs.limit(2), nulls, nulls.where("doc_id is null")):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        check_prints(fingerprint.fingerprints(df).collect(), rows)
    assert fingerprint.fingerprints(no_docs).count() == 0


def test_difference():
    text = "the quick brown fox jumps over the lazy dog " * 30
    a, b, c = map(fingerprint.digest, (text, text.replace("lazy", "idle"), "völlig anderer Text ohne Bezug " * 40))
    assert fingerprint.difference(a, a) == 0 and 0 < fingerprint.difference(a, b) < fingerprint.difference(a, c) and fingerprint.difference(a, b) == fingerprint.difference(b, a)
    assert 0 <= fingerprint.likeness(a, c) < fingerprint.likeness(a, b) < 1 == fingerprint.likeness(a, a)
    assert fingerprint.digest("") == fingerprint.digest("") != fingerprint.digest("a") and fingerprint.edited("abcde", "xyz") == "abcxy" and fingerprint.edited("abcde", "x") == "abcx"
    big = fingerprint.digest("x" * (2 << 20))
    assert len(big) == len(a)
    assert pa  # very long texts go in steps


@pytest.mark.parametrize("page", ["<p><td>" + "<div></p>" * 110_000, "<p><button>" + "<div>" * 200_000, "<ul><li>" + "<div><li>" * 110_000, "<p>" * 300_000, "<table>" + "<tr><td>" * 120_000, "<select>" + "<option>x" * 100_000])
def test_broken_pages_in_time(page):
    """A megabyte of elements that are never closed."""
    began = time.time()
    html.main_text(page)
    assert time.time() - began < 6
