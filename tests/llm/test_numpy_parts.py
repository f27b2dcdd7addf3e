"""The operators' parts that run without Spark."""

import pickle
import random
import time
import tracemalloc
from itertools import combinations
from math import ceil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tarnwell.llm import decontam, exact, html, jaccard, licences, packing, quality, tokens, toxicity


def plain_fingerprint(data: bytes) -> list[int]:
    return [sum(b * pow(r % exact.P, len(data) - 1 - i, exact.P) for i, b in enumerate(data)) % exact.P for r in exact.BASES]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.binary(max_size=200), st.binary(max_size=200))
def test_fingerprints_are_polynomials_and_compose(parts, a, b):
    got = exact.fingerprints_of(parts)
    assert [list(map(int, r)) for r in got] == [plain_fingerprint(p) for p in parts]
    ha, hb, hab = exact.fingerprints_of([a, b, a + b])
    assert list(exact.combine(ha, hb, len(b))) == list(hab)


def test_fingerprint_of_a_text_longer_than_a_segment(monkeypatch):
    data = bytes(range(256)) * 50
    want = plain_fingerprint(data)
    monkeypatch.setattr(exact, "SEGMENT", 3000)
    assert list(map(int, exact.fingerprints_of([data])[0])) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é7,\n_", max_size=40)), max_size=6))
def test_words_are_runs_of_letters_digits_and_non_ascii(texts):
    import re

    hashes, offsets = tokens.words(texts)
    want = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower()) for t in texts]
    assert list(np.diff(offsets)) == [len(w) for w in want]
    names = {}
    for h, w in zip(hashes.tolist(), [x for ws in want for x in ws], strict=True):
        assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)


def test_words_do_not_depend_on_where_segments_are_cut(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    want = tokens.words([text])[0]
    monkeypatch.setattr(tokens, "_SEGMENT", 777)
    assert (tokens.words([text])[0] == want).all()


def test_shingles_of_short_and_long_texts():
    h, at = tokens.shingles(*tokens.words(["a b c d e f", "a b", None, "a b c d e", "a b"]), 5)
    assert list(np.diff(at)) == [2, 1, 0, 1, 1]
    assert h[0] == h[3] and h[2] == h[4]


def test_runs_reach_the_target_recall():
    p = 1 - jaccard.survival(jaccard.DEEPEST)
    assert p**jaccard.RUNS <= 1 - jaccard.RECALL < p ** (jaccard.RUNS - 1)
    assert jaccard.survival(4, 0.9) > jaccard.survival(4, 0.8) > jaccard.survival(6, 0.8)


def test_overlaps_of_sets():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(20)]
    got = jaccard.overlaps(sets)
    for i in range(20):
        for j in range(20):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_decreasing_is_that_of_a_plain_search(lengths):
    rows = packing.best_fit(lengths, 64)
    room, want = [], []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        fits = [k for k in range(len(room)) if room[k] >= lengths[i]]
        if fits:
            k = min(fits, key=lambda k: room[k])
            room[k] -= lengths[i]
        else:
            room.append(64 - lengths[i])
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    assert sorted(64 - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def wordy(rng, n):
    return [f"w{k}" for k in rng.integers(0, 3000, n)]


def test_spaced_seeds_find_passages_with_substitutions_and_nothing_else():
    rng = np.random.default_rng(3)
    items = [wordy(rng, n) for n in (15, 30, 50, 5, 2)]
    index = decontam.Index.of(list(range(5)), [" ".join(x) for x in items] )
    changed = list(items[1])
    for at in (4, 12, 21):
        changed[at] = "other"
    texts = [
        " ".join(wordy(rng, 200) + items[0] + wordy(rng, 100)), " ".join(wordy(rng, 50) + changed), " ".join(wordy(rng, 400)), None, "",
        " ".join(items[3]), " ".join(items[4]), " ".join(items[2][:13]).upper() + "!", " ".join(items[2][:9]), "w " * 500,
    ]
    got = {(t, i): rest for t, i, *rest in index.overlaps(texts)}
    assert set(got) == {(0, 0), (1, 1), (5, 3), (7, 2)}
    assert got[0, 0] == [15, 15, 200, 0] and got[1, 1][:2] == [27, 30]


def brute_overlap(text, item):
    """Most equal words of a stretch on any diagonal that has at least four for each other word."""
    most = 0
    for shift in range(-len(item) + 1, len(text)):
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        same = [text[k + shift] == item[k] for k in range(lo, hi)]
        for start in (k for k, x in enumerate(same) if x):
            equal = 0
            for end in range(start, len(same)):
                equal += same[end]
                if equal > most and 5 * equal >= 4 * (end + 1 - start):
                    most = equal
    return most


def test_passages_with_replaced_words_are_found_as_by_brute_force():
    rng = np.random.default_rng(8)
    items, texts = [], []
    for n in (59, 40, 20):  # every fifth word
        items.append(wordy(rng, n))
        texts.append(wordy(rng, 20) + [f"z{k}" if k % 5 == 4 else w for k, w in enumerate(items[-1])] + wordy(rng, 20))
    for n, replaced in [(14, 1), (16, 3), (17, 3), (20, 2), (20, 4), (30, 6), (40, 9), (60, 11)] * 12:
        items.append(wordy(rng, n + 6))
        passage = items[-1][3 : 3 + n]
        for at in rng.choice(n, replaced, replace=False):
            passage[at] = f"z{at}"
        texts.append(wordy(rng, 10) + passage + wordy(rng, 10))
    index = decontam.Index.of(list(range(len(items))), [" ".join(x) for x in items])
    got = {(t, i): equal for t, i, equal, *_ in index.overlaps([" ".join(x) for x in texts])}
    most = [brute_overlap(t, i) for t, i in zip(texts, items, strict=True)]
    assert got == {(k, k): equal for k, equal in enumerate(most) if equal >= 13}
    assert all(got[k, k] == equal for k, equal in enumerate((48, 32, 16)))


def test_short_items_are_found_wherever_a_word_in_five_was_replaced():
    for n in range(4, 16):
        item = [f"w{i}" for i in range(n)]
        index = decontam.Index.of([1], [" ".join(item)])
        texts = []
        for out in combinations(range(n), n - min(13, ceil(0.8 * n))):
            texts.append(" ".join(["q", *("zz" if k in out else w for k, w in enumerate(item)), "q"]))
        assert {t for t, *_ in index.overlaps(texts)} == set(range(len(texts)))
        none = ["zz" if k % 3 == 1 else w for k, w in enumerate(item)]
        assert n < 5 or index.overlaps([" ".join(none)]) == []


def test_equal_words_in_long_texts_and_items_take_bounded_memory():
    index = decontam.Index.of(["a", "b"], [" ".join(["go"] * 400), " ".join(["go", "on"] * 100)])
    texts = [" ".join(["go"] * 4000), " ".join(["go", "on"] * 2000), "go " * 12]
    tracemalloc.start()
    got = {(t, i): equal for t, i, equal, *_ in index.overlaps(texts)}
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, 0): 400, (1, 1): 200} and most < 160 << 20


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href=/a>A</a></li></ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Title &amp; more</h1><p>First <b>bold</b> part&hellip;<br>next<p>Second&nbsp; one &lt;x&gt;</p><div class="ad-slot">Buy</div>
<form><input><label>Mail</label></form><aside>Side</aside><ul><li>one<li>two</ul><section id="comments"><p>Nice!</p></section></article>
<footer>&copy; me</footer></body></html>"""


def test_extraction_of_a_page_with_all_kinds_of_boilerplate():
    assert html.extract(html.parse(PAGE)) == "Title & more\nFirst bold part… next\nSecond one <x>\none\ntwo"


@pytest.mark.parametrize("page", [None, "", "<", "<p", "<<>>&#xZ;", "</div></p>", "<div>" * 3000 + "x", "<!-- a"])
def test_anything_parses(page):
    html.extract(html.parse(page), html.Slot(html.Folded([html.parse(PAGE)])))


def test_a_host_s_constant_lines_are_template():
    pages = [html.parse(f"<body><div><p>Read on at our site</p><p>Story {i} says {'word ' * 20}{i}</p></div></body>") for i in range(6)]
    slot = html.Slot(html.Folded([pages[0]]))
    for p in pages[1:]:
        slot = html.merge(slot, html.Slot(html.Folded([p])))
    assert html.extract(pages[2], slot) == f"Story 2 says {'word ' * 20}2"
    assert html.extract(pages[2]).startswith("Read on")


@pytest.mark.parametrize("deep", [250, 3000])
def test_deep_pages_are_read_whole(deep):
    inner = "<aside><div>Side</div></aside><script>var x;</script><form><div>Mail</div></form><p>in <b>the</b> depth</p>"
    page = f"<body><article><p>First</p>{'<div>' * deep}{inner}{'</div>' * deep}<p>Last</p></article><div>Out</div></body>"
    slot = html.merge(*(html.Slot(html.Folded([html.parse(page)])) for _ in range(2)))
    assert html.extract(html.parse(page), slot) == html.extract(html.parse(page)) == "First\nin the depth\nLast"


@pytest.mark.parametrize("views", [lambda i: 7, lambda i: i])
def test_what_only_copies_of_a_page_share_is_not_template(views):
    story = lambda i: f"<p>Story {i} says {'word ' * 20}{i}</p><p>and {'so on ' * 9}{i}</p>"
    own = [f"<body><article>{story(99)}<blockquote>A quote of its own</blockquote><p>{views(i)} views</p></article></body>" for i in range(6)]
    other = [f"<body><article>{story(i)}<p>Read on</p></article></body>" for i in range(12)]
    ending = [f"<body><article>{story(20 + i)}<h2>All stories of the week</h2></article></body>" for i in range(6)]
    slot = html.Slot(html.Folded([html.parse(own[0])]))
    for p in [*own[1:], *other, *ending]:
        slot = html.merge(slot, html.Slot(html.Folded([html.parse(p)])))
    for p in own:
        assert html.extract(html.parse(p), slot) == html.extract(html.parse(p))
    assert "All stories" not in html.extract(html.parse(ending[0]), slot)


def host_of(pages):
    slot = html.Slot(html.Folded([html.parse(pages[0])]))
    for p in pages[1:]:
        slot = html.merge(slot, html.Slot(html.Folded([html.parse(p)])))
    return slot


def plain_page(r, k):
    """A page without telling tags or names, and its main text."""
    say = lambda n: " ".join(f"{r.choice('abcdef')}{r.randrange(9999)}" for _ in range(n))
    title, paragraphs = say(6), [say(30) for _ in range(r.randrange(2, 9))]
    body = "".join(f"<div>{p}</div>" if k % 3 == 0 else f"<p>{p}</p>" for p in paragraphs)
    advert = r.choice(["Buy now while it lasts", "Cheaper than ever"])
    page = (
        f"<html><body><div class=k1><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></div><div class=k2><h1>{title}</h1><div class='k3 p-{k}' id=n{k}>{body}"
        f"<blockquote>All our stories are free to read</blockquote></div></div><div class=k4><span>{advert}</span></div><div class=k5>Imprint of the house</div></body></html>"
    )
    return page, "\n".join([title, *paragraphs])


def test_the_template_names_the_region_of_pages_without_telling_tags():
    r = random.Random(5)
    pages = [plain_page(r, k) for k in range(14)]
    slot = host_of([p for p, _ in pages])
    for p, text in pages:
        blocks, by_template = html.read(html.parse(p), slot)
        assert by_template and "\n".join(blocks) == text
        assert html.extract(html.parse(p)) != text  # tags and names alone don't know
    few = host_of([p for p, _ in pages[:2]])
    assert not html.read(html.parse(pages[0][0]), few)[1]


def rotating_pages(n):
    """Pages of one host with one of 20 long adverts each, where no tag or name tells what is main text, and their texts."""
    r = random.Random(8)
    say = lambda n: " ".join(f"{r.choice('abcdef')}{r.randrange(9999)}" for _ in range(n))
    adverts, texts = [say(40) for _ in range(20)], [say(60) for _ in range(n)]
    return [f"<html><body><div class=ka>{t}</div><div class=kb>{adverts[i % 20]}</div></body></html>" for i, t in enumerate(texts)], texts


def test_what_varies_is_counted_over_all_pages_of_a_host():
    pages, texts = rotating_pages(120)
    slot = host_of(pages)
    assert [html.extract(html.parse(p), slot) for p in pages] == texts  # ten pages have about eight of the 20 adverts
    assert slot.counts[0] == 120 and sorted(x.counts[:2] for x in html.preorder(slot) if x.said) == [(120, 20), (120, 120)]
    with pytest.raises(ValueError):
        html.decide(pickle.loads(pickle.dumps(host_of(pages))))


def test_templates_do_not_grow_with_the_number_of_pages():
    def size(n, kind):
        return len(pickle.dumps(host_of([kind(k) for k in range(n)])))

    ids = lambda k: f'<body><article id="post-{k}" class="post-{k} x"><p>text {k}</p></article></body>'
    classes = lambda k: f'<body><div class="{"abcdefghij"[k // 10 % 10]}{"klmnopqrst"[k % 10]}{"uvwxyz"[k // 100]}"><p>text {k}</p></div></body>'
    assert size(400, ids) == size(50, ids)
    assert size(400, classes) <= size(60, classes)
    alternating = [html.Slot(html.Folded([html.parse("<h2>a</h2><p>b</p>" * n)])) for n in (1600, 1580)]
    began = time.perf_counter()
    html.merge(*alternating)
    assert time.perf_counter() - began < 0.2


def test_an_article_s_own_sections_stay():
    page = (
        "<article><h1>t</h1><section class='related-work'><h2>Related work</h2><p>some</p></section><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be</p>"
        "<fieldset><legend>L</legend>inside</fieldset><section class=legal>Law</section><div class=related><a href=x>More posts like this</a></div><div class=comments>bad</div></article>"
    )
    assert html.extract(html.parse(page)).split("\n") == ["t", "Related work", "some", "Let x=2 be", "L", "inside", "Law"]


def test_simple_tree_matching_counts_the_largest_matching():
    tree = lambda s: html.Folded([html.parse(s)])
    assert html.score(tree("<div><p>a</p><ul><li>x</ul></div>"), tree("<div><h1>t</h1><p>b</p><ul><li>y<li>z</ul></div>")) == 5
    assert html.score(tree("<div><p>a</p></div>"), tree("<section><p>a</p></section>")) == 1


def test_positive_unlabelled_learning_finds_the_marked_texts():
    rng = np.random.default_rng(1)
    text = lambda bad: " ".join(wordy(rng, 60) + (["idiot"] if bad else []))
    positive, unlabelled = [text(True) for _ in range(60)], [text(i % 10 == 0) for i in range(400)]
    model = toxicity.fit(positive, unlabelled, 0.1).scorer()
    assert np.mean([model(text(True)) > 0 for _ in range(50)]) > 0.95
    assert np.mean([model(text(False)) > 0 for _ in range(50)]) < 0.05
    assert toxicity.fit([], unlabelled, 0.1).scorer()("") == pytest.approx(np.log(0.1 / 0.9))


def test_the_network_reads_whole_texts_and_scores_parts_alike(monkeypatch):
    rng = np.random.default_rng(2)
    good = lambda n: (" ".join(wordy(rng, n))).encode()
    bad = lambda n: (" ".join(w + "###" for w in wordy(rng, n))).encode()
    texts = [f(int(n)) for f in (good, bad) for n in rng.integers(5, 150, 120)]
    net = quality.fit(texts, np.array([1.0] * 120 + [0.0] * 120), epochs=6)
    fresh = [good(50) for _ in range(20)] + [bad(50) for _ in range(20)]
    got = quality.score_texts(net, fresh)
    assert (got[:20] >= 0.5).mean() >= 0.95 and (got[20:] < 0.5).mean() >= 0.95
    long = [good(2000) + bad(2000), b"", b"x"]
    whole = quality.score_texts(net, long)
    monkeypatch.setattr(quality, "PART", 4096)
    assert quality.score_texts(net, long) == pytest.approx(whole, abs=1e-4)
    assert len(quality.score_texts(net, [])) == 0


def plain_score(net, text):
    """The network by loops: every window of a text's own chunks, padded with zeros."""
    n = (len(text) + quality.WIDTH + quality.CHUNK - 1) // quality.CHUNK * quality.CHUNK
    b = text + bytes(n - len(text) + quality.WIDTH)
    again = [float(b[i] > 0 and any(i - k >= 0 and b[i : i + 4] == b[i - k : i - k + 4] for k in quality.LAGS)) for i in range(n + quality.WIDTH - 4)] + [0.0] * 4
    tops = []
    for at in range(0, n, quality.CHUNK):
        best = np.full(quality.FILTERS, -np.inf)
        for w in range(at, at + quality.CHUNK, quality.STRIDE):
            if w + quality.WIDTH <= n:
                x = np.concatenate([[*net.embed[b[i]], again[i]] for i in range(w, w + quality.WIDTH)])
                best = np.maximum(best, x @ net.filters.astype(float))
        tops.append(np.maximum(best + net.shift, 0))
    tops = np.array(tops)
    return 1 / (1 + np.exp(-(np.concatenate([tops.max(0), tops.mean(0)]) @ net.out + net.bias)))


def test_a_text_s_score_comes_from_the_text_alone():
    rng = np.random.default_rng(3)
    texts = [" ".join(wordy(rng, int(n))).encode() for n in rng.integers(0, 250, 60)] + [b"", b"abcdabcd", b"aaaa" * 70, b"x" * 248, b"y" * 256]
    net = quality.Net.fresh(4)
    alone = np.array([quality.score_texts(net, [t])[0] for t in texts])
    assert alone[-8:] == pytest.approx([plain_score(net, t) for t in texts[-8:]], abs=1e-5)
    for size in (2, 7, len(texts)):
        order = rng.permutation(len(texts))
        got = np.empty(len(texts))
        for at in range(0, len(order), size):
            got[order[at : at + size]] = quality.score_texts(net, [texts[i] for i in order[at : at + size]])
        assert (got == alone).all()  # to the bit


def test_licences_are_named_and_confirmed_and_other_talk_is_not():
    model = licences.fit(["The cat sat on the mat.", "Nothing to see here, move along."] * 10)
    notices = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0."]
    other = ["", "We renew the driving license in March.", "The general public was there, version 3 or not.", "word " * 300]
    got = model.found(notices + other + ["word " * 100 + notices[0]])
    assert [(g[0], g[1]) for g in got] == [(0, "MIT"), (1, "Apache-2.0"), (2, "GPL-3.0"), (3, "CC-BY-NC"), (8, "MIT")]
    assert all(g[2] >= 0.5 and g[3] >= 0.6 for g in got)


def test_every_licence_of_a_line_is_named_and_confirmed_where_it_stands():
    model = licences.fit(["The cat sat on the mat.", "Nothing to see here, move along."] * 10)
    mit, gpl = licences.FAMILIES["MIT"][1][0], licences.FAMILIES["GPL-3.0"][1][0]
    lines = [
        mit + " word" * 200 + " " + gpl + ".", "Released under the MIT License or the Apache License, Version 2.0, at your choice.",
        "Licensed under the GNU General Public License, version 2 or version 3.", "word " * 300, "Released under the MIT License." + " word" * 200 + " Released under the MIT License.",
        "This work is licensed under CC BY-NC-SA 4.0.", "The code is covered by the GNU Lesser General Public License, version 3; the docs by CC BY 4.0.",
    ]
    got = model.found(lines)
    assert sorted(g[:2] for g in got) == [(0, "GPL-3.0"), (0, "MIT"), (1, "Apache-2.0"), (1, "MIT"), (2, "GPL-2.0"), (2, "GPL-3.0"), (4, "MIT"), (5, "CC-BY-NC-SA"), (6, "CC-BY"), (6, "LGPL")]
    assert all(g[2] >= 0.5 and g[3] >= 0.6 for g in got)
