"""Tokenizer, leaked passages and personal information."""

import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sembla.llm import leakage as L
from sembla.llm import pii
from sembla.llm.pii_table import labelled_lines
from sembla.llm.tokenizer import TOKENIZERS, PerfectHash, encode_corpus, load_encoder

from .pii_sentences import SENTENCES, UNSEEN, labelled

needs_files = pytest.mark.skipif(not os.path.exists(f"{TOKENIZERS}/byte_bpe_50k.tiktoken"), reason="no vocabulary files")


@pytest.fixture(scope="module")
def judge():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    made.encode_special_tokens = True
    return lambda t: made.encode(t, add_special_tokens=False).ids


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = PerfectHash(keys, list(range(5000)))
    assert table.find(keys).tolist() == list(range(5000))
    assert (table.find([b"x%d" % i for i in range(1000)]) == -1).all() and len(table.find([])) == 0


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_tokens_like_the_public_library(judge, text):
    assert load_encoder().encode([text])[0] == judge(text)


@needs_files
def test_corpus_rows(spark, judge):
    texts = ["", None, "It's <|endoftext|> here", "a" * 30_000, "\n\n   \t x", "日本語 😀", "ab cd " * 200_000, "It's <|endoftext|> here"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("*", "1 as ids", "2 as k")
    got = {r.id: list(r.ids) for r in encode_corpus(df, "id", "text").collect()}
    assert got == {i: judge(t) if t else [] for i, t in enumerate(texts)}
    assert encode_corpus(df.limit(0), "id", "text").count() == 0


ITEM = "Where a keskav carries the well the idle lantern of Giand unless drotalt carries; While a siadren weighs the well although a mutik counts the kiln near seven broken gardens"
OTHER = "Before a moliv hides four salted kilns Tebrok measures the winding orchard of Zelt whenever grabo and plirt sends thirty pale wagons until a vozek borrows the amber gate"


def leaks(spark, docs, **kw):
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "too short"), (1, ITEM)], "item long, text string")
    df = spark.createDataFrame(docs, "doc long, text string").selectExpr("*", "1 as item", "2 as words")
    return {(r.doc, r.item) for r in L.leaked_items(df, "doc", "text", items, "item", "text", **kw).collect()}


@pytest.mark.parametrize("limit", [L.BROADCAST_WORDS, 5])
def test_leaks(spark, limit):
    w = ITEM.split()
    changed = w.copy()
    changed[3], changed[9], changed[15] = "sends", "amber", "xx"
    docs = [
        (1, "so " + " ".join(w[3:20]) + " end"), (2, " ".join(w[:6])), (3, " ".join(sorted(w))), (4, " ".join(changed)), (5, None), (6, ""),
        (7, ITEM.upper().replace("A", "А").replace(" THE ", " <b>THE</b> ")), (8, "> " + "\n> ".join(" ".join(w[i : i + 4]) for i in range(0, 24, 4))),
        (9, " ".join(x if i % 3 else "zzz" for i, x in enumerate(w))), (10, ITEM + " and then " + OTHER), (11, ITEM.replace("lantern", "lan-\ntern")), (1, "so " + " ".join(w[3:20]) + " end"),
        (12, "word " * 20_000 + ITEM), (None, "see [" + ITEM + "] or <" + OTHER + ">"),
    ]
    assert leaks(spark, docs, broadcast_words=limit) == {(1, 1), (4, 1), (7, 1), (8, 1), (10, 1), (10, 2), (11, 1), (12, 1), (None, 1), (None, 2)}


def test_markup_goes_and_bracketed_text_stays():
    assert L.words_of('[quote=ann]A <b>bold</b> <a href="x y">link</a>[/quote] [a plain remark] <note to self> <i kept> [b]w[/b]ord</p><p>next') == "a bold link a plain remark note to self i kept word next".split()


def test_asked_again_with_other_values(spark):
    """The slots of a passage are filled anew: found when the filling is consistent, and not counted as literal."""
    templates = [f"When {{0}} lends {{1}} coins to {{2}} the {{2}} hands {{1}} coins back and {{0}} owes {{2}} how many of {{1}} coins in the {w} week" for w in ("first", "second", "third")]
    name = lambda i: "Teb" + "abcdefghijklmnopqrstuvwxyz"[i] + "rok"
    items = [(i, templates[i % 3].format(name(2 * i), 10 + i, name(2 * i + 1))) for i in range(12)]
    again = templates[0].format("Plirt", 777, "Grabo")
    mixed = "When Plirt lends 777 coins to Grabo the Hosk hands 12 coins back and Unda owes Rild how many of 45 coins in the first week"
    docs = spark.createDataFrame([(1, again), (2, mixed), (3, items[0][1])], "doc long, text string")
    rows = L.leaked_items(docs, "doc", "text", spark.createDataFrame(items, "item long, text string"), "item", "text").collect()
    assert {(r.doc, r.item): r.words for r in rows if not r.literal}[1, 0] == 26 and all(r.words < 20 for r in rows if r.doc == 2)
    assert (3, 0) in {(r.doc, r.item) for r in rows if r.literal}


def test_longest_stretch_like_every_stretch():
    rng = np.random.default_rng(3)
    for _ in range(300):
        x = rng.random(rng.integers(1, 40)) < rng.uniform(0.3, 1)
        every = [(b - a, a, b) for a in range(len(x)) for b in range(a, len(x)) if x[a] and x[b] and x[a : b + 1].sum() - 5 * (~x[a : b + 1]).sum() >= 0]
        found = L._longest(x, 5)
        assert (found is None) == (not every) and (not every or found[1] - found[0] == max(every)[0])


def test_leaks_empty(spark):
    assert leaks(spark, []) == set()


def test_personal_information_held_out():
    tagger = pii.Tagger(pii.train_model(), {})
    right = wanted = found = 0
    for text, spans, signed in labelled_lines(800, seed=77):
        tagger.tag([(text, signed)])
        got = set(tagger._seen[text, signed])
        right, wanted, found = right + len(got & set(spans)), wanted + len(spans), found + len(got)
    assert right / wanted > 0.93 and right / found > 0.97


@pytest.mark.parametrize("sentences, least", [(SENTENCES, 0.9), (UNSEEN, 0.7)])
def test_personal_information_in_other_text(sentences, least):
    tagger = pii.Tagger(pii.train_model(), {})
    wanted = right = found = 0
    for text, items in map(labelled, sentences):
        got = {(k, text[a:b]) for a, b, k in tagger.items([text])[0]}
        wanted, right, found = wanted + len(items), right + len(got & items), found + len(got)
    assert right / wanted >= least and right / found >= 0.9


def test_long_lines_lose_no_item():
    tagger = pii.Tagger(pii.train_model(), {})
    line = " ".join(f"Write to user{i}@host.example if the upload fails." for i in range(300))
    found = tagger.items([line + " " * 200_000 + "x" * 50_000])[0]
    assert [line[a:b] for a, b, k in found if k == "email"] == [f"user{i}@host.example" for i in range(300)]


def test_gradient_is_the_slope_of_the_likelihood():
    rng = np.random.default_rng(0)
    model = pii.TaggingModel(np.zeros(0, np.uint64))
    model.steps = rng.normal(size=model.steps.shape).astype(np.float32)
    k = len(pii.LABELS)
    scores, gold, lengths = rng.normal(size=(1, 4, k)), np.array([[0, 1, 2, 0]]), np.array([4])

    def loss(s):
        step = model.steps + model.barred
        alpha = s[0, 0] + model.first
        for i in range(1, 4):
            alpha = np.logaddexp.reduce(alpha[:, None] + step, axis=0) + s[0, i]
        best = s[0, 0, 0] + model.first[0] + sum(step[gold[0, i - 1], gold[0, i]] + s[0, i, gold[0, i]] for i in range(1, 4))
        return np.logaddexp.reduce(alpha) - best

    local, _ = pii._gradient(model, scores, gold, lengths)
    for i, j in ((0, 0), (1, 1), (2, 4), (3, 7)):
        up, down = scores.copy(), scores.copy()
        up[0, i, j] += 1e-5
        down[0, i, j] -= 1e-5
        assert abs((loss(up) - loss(down)) / 2e-5 - local[0, i, j]) < 1e-4


def test_personal_rows(spark):
    docs = [(1, "Write to ann.belt@post.example if the upload fails.\n-- \nAnn Beltmark\n07700 960123"), (2, None), (3, ""), (4, "The server at 192.0.2.7 keeps the menu odd."), (1, "Write to ann.belt@post.example if the upload fails.\n-- \nAnn Beltmark\n07700 960123"), (5, "plain words " * 3000 + "Tax ID: 60664937-O")]
    df = spark.createDataFrame(docs, "id long, text string").selectExpr("*", "1 as kind", "2 as value")
    names = spark.createDataFrame([("Ann", "given"), (None, "surname")], "token string, token_kind string")
    got = {(r.id, r.kind, r.value_key) for r in pii.personal_items(df, "id", "text", names).collect()}
    assert got == {(1, "email", "annbeltpostexample"), (1, "name", "annbeltmark"), (1, "phone", "07700960123"), (5, "idnum", "60664937o")}
    red = {(r.id, r.redacted) for r in pii.redact_personal(df, "id", "text", names).collect()}
    assert (1, "Write to [EMAIL] if the upload fails.\n-- \n[NAME]\n[PHONE]") in red and (2, None) in red and (4, docs[3][1]) in red
    assert pii.personal_items(df.limit(0), "id", "text").count() == 0
