"""Leaked passages, mixtures and personal data in documents."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pandas as pd
import pytest

from colloquy.llm import leaks as L
from colloquy.llm import mixture as M
from colloquy.llm import pii as P
from colloquy.llm.common import bounded

WORDS = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("an", "or", "il", "eth", "und", "asp", "ock", "iver", "omen", "ulst")]


def prose(rng, n):
    return [rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n)]


def brute_same(item, doc):
    """Longest run of equal words in which single words differ, at least three apart and at most 12 % in all."""
    same = [x == y for x, y in zip(item, doc)]
    best = 0
    for i in range(len(same)):
        if not same[i] or i and same[i - 1]:
            continue
        changed, run = 0, 0
        for j in range(i, len(same)):
            if same[j]:
                run += 1
                if (j + 1 == len(same) or not same[j + 1]) and changed <= 0.12 * (j + 1 - i):
                    best = max(best, j + 1 - i)
            else:
                if j + 1 >= len(same) or not same[j + 1] or changed and run < 3:
                    break
                changed, run = changed + 1, 0
    return best


@pytest.mark.parametrize("seed", range(4))
def test_stretch_like_brute_force(seed):
    rng = random.Random(seed)
    vocabulary = L.Vocabulary()
    for _ in range(60):
        item = [rng.choice("abcdefgh") * 2 for _ in range(30)]
        doc = [w if rng.random() > 0.15 else "zz" for w in item]
        a, z = L.stretch(vocabulary.codes(item) == vocabulary.codes(doc))
        assert z - a == brute_same(item, doc)


def test_leaks_recall_and_precision(spark):
    """Planted stretches of 25 to 70 words, some with changed words, against documents that hold shorter ones."""
    rng = random.Random(5)
    items = [(i, " ".join(prose(rng, 100)).capitalize() + ".") for i in range(40)]
    docs, want = [], set()
    for d in range(400):
        words = prose(rng, rng.randrange(30, 200))
        kind = d % 4
        if kind < 3:
            i, text = rng.choice(items)
            item = text.lower().rstrip(".").split()
            n = rng.randrange(25, 70) if kind < 2 else rng.randrange(6, 20)
            a = rng.randrange(0, 100 - n)
            part = item[a : a + n]
            if kind == 1:
                for k in range(9, n - 5, 14):
                    part[k] = "changed"
            at = rng.randrange(len(words))
            lines = words[:at] + [w.upper() if rng.random() < 0.2 else w for w in part] + words[at:]
            text = "\n".join(f"[{j // 60}:{j % 60:02d}] S1: {' '.join(lines[j : j + 17])}," for j in range(0, len(lines), 17))
            if kind < 2:
                want.add((d, i))
        else:
            text = " ".join(words)
        docs.append((d, text, "x"))
    df = spark.createDataFrame([*docs, (500, None, "x"), (501, "", "x"), (None, items[0][1], "x"), (0, docs[0][1], "x")], "doc_id long, text string, item_id string")
    it = spark.createDataFrame([*items, (99, None), (98, "too short")], "item_id long, text string")
    got = {tuple(r) for r in L.find_leaks(df, it).collect()}
    assert len(got & want) >= 0.97 * len(want) and not got - want
    assert L.find_leaks(df.limit(0), it).count() == 0 and L.find_leaks(df, it.limit(0)).count() == 0


EDITS = {
    "two changed, nine apart": lambda p: [*p[:8], "xx", *p[9:17], "yy", *p[18:]],
    "one added": lambda p: [*p[:13], "xx", *p[13:]],
    "one dropped": lambda p: [*p[:13], *p[14:]],
    "one added, one dropped": lambda p: [*p[:9], "xx", *p[9:17], *p[18:]],
}


@pytest.mark.parametrize("edit", EDITS)
def test_recall_of_edited_stretches(edit):
    """Of stretches of 26 words, in other text, at least 0.95 are found after two edits; nothing else is."""
    rng = random.Random(7)
    items = [prose(rng, 90) for _ in range(250)]
    docs = []
    for i, item in enumerate(items):
        a = rng.randrange(0, 90 - 26)
        docs.append((i, " ".join(prose(rng, rng.randrange(40, 60)) + EDITS[edit](item[a : a + 26]) + prose(rng, 40))))
    index = {False: L.Index(list(enumerate(items)), False)}
    got = {tuple(r) for b in L.probe(iter([pd.DataFrame(docs, columns=["doc_id", "text"])]), index) for r in b.itertuples(index=False, name=None)}
    assert len(got) >= 0.95 * len(items) and all(d == i for d, i in got)


def brute_edit(item, doc, least, gap, share):
    """Longest stretch of item tokens by trying every start and every chain of runs with one changed, added or dropped token between."""
    best = 0

    def go(i, j, start, changed):
        nonlocal best
        n = 0
        while i + n < len(item) and j + n < len(doc) and item[i + n] == doc[j + n]:
            n += 1
        if not n:
            return
        length = i + n - start
        if changed <= share * length:
            best = max(best, length)
        if n < least and start != i:
            return
        for a in range(gap + 1):
            for b in range(gap + 1):
                if a or b:
                    go(i + n + a, j + n + b, start, changed + max(a, b))

    for i in range(len(item)):
        for j in range(len(doc)):
            if item[i] == doc[j] and (not i or not j or item[i - 1] != doc[j - 1]):
                go(i, j, i, 0)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_band_like_brute_force(seed):
    """With the least lengths taken out of the way the band finds what trying everything finds, if the stretch counts."""
    rng = random.Random(seed)
    vocabulary = L.Vocabulary()
    for _ in range(25):
        item = [f"t{rng.randrange(10**6)}" for _ in range(40)]
        doc, k = [], 0
        while k < len(item):
            r = rng.random()
            doc += [] if r < 0.04 else ["new"] if r < 0.08 else [item[k], "more"] if r < 0.12 else [item[k]]
            k += 1
        want = brute_edit(item, doc, L.BETWEEN[False], 1, L.SHARE[False])
        got = L.stretch_in_band(vocabulary.codes(item), vocabulary.codes(doc), 0, np.ones(len(item), dtype=np.int64), False)
        assert got == want or want < L.LEAST_WORDS and got <= want


def test_leaks_in_han_text(spark):
    item = "會議同意在七月三日前重漆東側大廳並請秘書組長回報費用與進度另外由檔案專員整理郊區樣本庫的清單後再行公布結果"
    docs = [(1, f"[0:00] S1: 開場。{item[:44]}。結束"), (2, item[:20] + "完全不同的內容接在後面並且沒有任何關聯可言今天就到這裡"), (3, item.replace("秘書", "行銷")), (4, "無關")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string")
    assert {tuple(r) for r in L.find_leaks(df, it).collect()} == {(1, 7), (3, 7)}


def test_leaks_in_long_documents_of_the_other_script(spark):
    rng = random.Random(8)
    han = "會議同意在七月三日前重漆東側大廳並請秘書組長回報費用與進度另外由檔案專員整理郊區樣本庫的清單後再行公布結果"
    latin = prose(rng, 60)
    other = "".join(chr(0x4E00 + rng.randrange(5000)) for _ in range(6000))
    long = prose(rng, 3000)
    docs = [(1, " ".join([*long[:1500], han[:40], *long[1500:]])), (2, other[:2500] + " " + " ".join(latin[10:38]) + " " + other[2500:]), (3, " ".join(long)), (4, other)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, han), (8, " ".join(latin))], "item_id long, text string")
    assert {tuple(r) for r in L.find_leaks(df, it).collect()} == {(1, 7), (2, 8)}


def test_slices_keep_all_rows():
    b = pd.DataFrame({"text": ["a" * 5, None, "b" * 30, "", "c" * 4, "d" * 9], "k": range(6)})
    got = list(bounded([b, b.iloc[:0]], chars=10))
    assert [k for s in got for k in s["k"]] == list(range(6)) and len(got) == 2


def test_joined_items_give_the_same(spark, monkeypatch):
    """Items too large for an index are joined on their keys, hot ones salted: same pairs."""
    rng = random.Random(9)
    han = "會議同意在七月三日前重漆東側大廳並請秘書組長回報費用與進度另外由檔案專員整理郊區樣本庫的清單後再行公布結果"
    items = [(i, " ".join(prose(rng, 60))) for i in range(8)] + [(8, han)]
    docs = [(i, "x " * rng.randrange(9) + items[i % 9][1] + (" y z" if i % 2 else "")) for i in range(60)] + [(90, "short"), (91, items[0][1][:40]), (92, None)]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {tuple(r) for r in L.find_leaks(df, it).collect()}
    assert want == {(i, i % 9) for i in range(60)}
    monkeypatch.setattr(L, "BLOCK", 10)
    assert {tuple(r) for r in L.find_leaks(df, it).collect()} == want
    monkeypatch.setattr(L, "HOT", 3)
    monkeypatch.setattr(L, "MOST_HOT", 10**9)
    assert {tuple(r) for r in L.find_leaks(df, it).collect()} == want
    assert L.find_leaks(df.limit(0), it).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(2)
    items = [(i, " ".join(prose(rng, 60))) for i in range(5)]
    df = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    it = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(L, "BLOCK", 1_000)
    assert {tuple(r) for r in L.find_leaks(df, it).collect()} == {(i, i) for i in range(5)}


needs_vocabulary = pytest.mark.skipif(not os.path.exists(M.VOCABULARY), reason="no vocabulary here")


def mixture(spark):
    rng = random.Random(1)
    docs = [(i, s, " ".join(prose(rng, rng.randrange(5, 60))), "x") for i, s in enumerate(rng.choices(["a", "b", "c", "z", None], [60, 25, 10, 4, 1], k=900))]
    docs += [docs[0], (5000, "a", None, "x"), (5001, "a", "", "x"), (None, "a", "text", "x")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string, tokens string")
    want = spark.createDataFrame([("a", 0.4, 1), ("b", 0.3, 2), ("c", 0.2, 3), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    return df, want


@needs_vocabulary
def test_shares_are_reached(spark):
    df, want = mixture(spark)
    got = {r["source"]: r for r in M.shares(df, want).collect()}
    assert set(got) == {"a", "b", "c", "none"} and got["none"]["tokens"] == 0
    assert all(abs(got[s]["actual_share"] - got[s]["reachable_share"]) < 0.01 for s in "abc")
    mix = M.mix(df, want).toPandas()
    caps = {"a": 1, "b": 2, "c": 3}
    assert not set(mix.source) - set(caps) and all(mix[mix.source == s].groupby("doc_id").size().max() <= n for s, n in caps.items())
    assert not mix.duplicated(["doc_id", "copy"]).any() and mix.finish.is_monotonic_increasing
    assert M.mix(df, want).toPandas().equals(mix)


@needs_vocabulary
def test_cumulative_sums_and_budget(spark):
    df, want = mixture(spark)
    placed, _ = M.queue(df, want)
    p = placed.toPandas()
    for _, own in p.groupby("source"):
        own = own.sort_values("before")
        assert (own.before.to_numpy() == own.tokens.cumsum().to_numpy() - own.tokens.to_numpy()).all()
    for budget in (2_000, 10**9):
        total = M.mix(df, want, budget=budget).toPandas().tokens.sum()
        assert total <= budget and (budget == 10**9 or total > 0.9 * budget)
    assert M.mix(df.limit(0), want).count() == 0 and M.mix(df, want.limit(0)).count() == 0


LEX = P.Lexicon({"Mira": 5, "Jonas": 5, "Tess": 5}, {"Halvor": 5, "Quist": 5}, {"書": 5, "瑜": 5, "安": 5})

# Held out: other wordings and values than those fitted on.
HELD_OUT = (
    "Reach ⟦name:Mira Halvor⟧ at ⟦email:mira_h+x@post.example.org⟧ today.",
    "Prof. ⟦name:Jonas T. Quist⟧ wrote to ⟦email:tess dot quist at mail dot example dot net⟧.",
    "Signed: ⟦name:Quist, Tess⟧",
    "Text ⟦phone:415.555.0142⟧ or ⟦phone:16175550142⟧.",
    "Fax and voice: ⟦phone:+44 7700 900142⟧ and ⟦phone:020 7946 0142⟧",
    "Phone ⟦phone:two one two, five five five, oh one six five⟧ please.",
    "His licence is ⟦id_number:DL-004412345⟧ and her ID ⟦id_number:QX 312 554⟧.",
    "Someone typed ⟦id_number:951 12 1126⟧ into the chat.",
    "Deliver to ⟦street_address:88 Saint Orlan St.⟧ on Monday.",
    "We met ⟦name:MIRA HALVOR⟧ at the Callow campus.",
    "We bought 216 units @ $40 for the Quarry Lane library on 2025-06-22.",
    "The Transit Analyst and the Night Clerk asked Project Halvor Road crews.",
    "The docket is 2025-0613-A, the invoice is 555-613-20, serial 4471-430-338.",
    "Spending reached $637,700, up from $91,300 on 12 items (see item 234).",
    "他的護照號碼為⟦id_number:K030798552⟧，請打⟦phone:(02)5550-0187⟧找⟦name:沈書安⟧。",
    "椅子請送到⟦street_address:石鏡縣望潮街253號之4⟧。",
)


def test_held_out_sentences():
    wrong = []
    for line in HELD_OUT:
        text, gold = P.parse_labelled(line)
        got = {(s, kind) for s, _, kind, _ in P.entities(text, LEX)}
        if got != gold:
            wrong.append((text, got ^ gold))
    assert not wrong


@pytest.mark.parametrize("line", ["We waited for ⟦name:Mira Anna Halvor⟧ and left.", "Dr. ⟦name:Zoë Müller⟧ asked why.", "Minutes taken by ⟦name:José Álvarez⟧.", "Thanks to ⟦name:Anna van der Quist⟧ said Mira.", "Write to ⟦email:ü.mira@post.example.org⟧ now.", "Ring ⟦phone:(303) 555-0109⟧10月"])
def test_names_of_many_parts_and_accents(line):
    text, gold = P.parse_labelled(line)
    lex = P.Lexicon({**LEX.given, "Anna": 5, "José": 5, "Zoë": 5}, LEX.family, LEX.chars)
    got = P.entities(text, lex)
    assert {(s, k) for s, _, k, _ in got} == gold
    assert [text[s:e] for s, e, *_ in got] == [m.split(":", 1)[1] for m in __import__("re").findall(r"⟦([^⟧]+)⟧", line)]


def test_marginals_like_enumeration():
    """The normaliser and the probabilities are sums over all sets of spans that do not overlap."""
    rng = random.Random(1)
    for _ in range(30):
        spans = []
        for k in range(7):
            a = rng.randrange(12)
            spans.append((a, a + rng.randrange(1, 6), "t", (f"f{k}",)))
        weights = {f"f{k}": rng.uniform(-2, 2) for k in range(7)}
        total, each = 0.0, [0.0] * 7
        for mask in range(1 << 7):
            own = [s for k, s in enumerate(spans) if mask >> k & 1]
            if any(a is not b and a[0] < b[1] and b[0] < a[1] for a in own for b in own):
                continue
            x = math.exp(sum(weights[s[3][0]] for s in own))
            total += x
            for k in range(7):
                each[k] += x * (mask >> k & 1)
        p, z = P.marginals(spans, weights)
        assert z == pytest.approx(math.log(total)) and p == pytest.approx([x / total for x in each])


def test_the_fit_is_of_the_greatest_likelihood():
    """At the fitted weights what is seen of each feature is what is expected of it, but for the pull of the prior; zero weights are far less likely."""
    weights = P.fitted()
    slope = {f: -w / P.SPREAD**2 for f, w in weights.items()}
    far = near = 0.0
    for line in P.LABELLED:
        spans, gold = P.aligned(line, P.SAMPLE_LEXICON)
        assert sum(gold) == line.count("⟦"), line
        p, z = P.marginals(spans, weights)
        near += sum(sum(weights[f] for f in s[3]) for s, true in zip(spans, gold) if true) - z
        far -= P.marginals(spans, {})[1]
        for s, true, x in zip(spans, gold, p):
            for f in s[3]:
                slope[f] += true - x
    assert near > 0.2 * far and max(map(abs, slope.values())) < 0.5


def test_long_entities_are_masked():
    """A span above the default bound of the decoder is found all the same."""
    long = "a" * 150 + "@mail.example"
    assert [(s, e) for s, e, *_ in P.entities(f"Write {long} now", LEX)] == [(6, 6 + len(long))]


@pytest.mark.parametrize("before", ["感謝", "謝謝", "和", "向", "對方", "請"])
def test_names_after_a_character_that_is_a_surname_too(before):
    text = f"{before}沈書瑜。"
    assert [(s, e) for s, e, kind, _ in P.candidates(text, LEX) if kind == "name" and text[s:e] == "沈書瑜"] == [(len(before), len(before) + 3)]
    assert [text[s:e] for s, e, *_ in P.entities(text, LEX)] == ["沈書瑜"]


def test_fit_keeps_the_training_sentences():
    weights = P.fitted()
    lex = P.SAMPLE_LEXICON
    for line in P.LABELLED:
        text, gold = P.parse_labelled(line)
        assert {(s, k) for s, _, k, _ in P.decode(P.candidates(text, lex), weights)} == gold, text


def test_decode_takes_the_best_set():
    spans = [(0, 5, "a", ("x",)), (3, 9, "b", ("y",)), (5, 9, "c", ("z",)), (20, 400, "d", ("x",))]
    assert [s[2] for s in P.decode(spans, {"x": 1.0, "y": 1.5, "z": 0.4})] == ["b"]
    assert [s[2] for s in P.decode(spans, {"x": 1.0, "y": 1.5, "z": 0.6})] == ["a", "c"]
    assert P.decode([], {}) == [] and P.decode(spans[:1], {"x": -1.0}) == []


def test_find_and_mask(spark, rows):
    said = [(i, f"Minutes taken by Mira Halvor.\nCall 415 555 0{100 + i} now.", "k") for i in range(4)]
    df = spark.createDataFrame([*said, (0, said[0][1], "k"), (9, None, "k"), (8, "", "k"), (None, "a@b.example", "k"), (7, "x " * 40_000 + "a@b.example", "k")], "doc_id long, text string, pii_type string")
    got = rows(P.find_pii(df))
    assert got == sorted([(i, "name", 18) for i in range(4)] + [(i, "phone", 36) for i in range(4)] + [(7, "email", 80_001)], key=lambda r: tuple(map(str, r)))
    m = {r["doc_id"]: r["text"] for r in P.mask_pii(df).collect()}
    assert m[1] == "Minutes taken by [NAME].\nCall [PHONE] now." and m[9] is None and m[8] == "" and m[7].endswith("[EMAIL]")
    assert P.find_pii(df.limit(0)).count() == 0


def test_lexicon_larger_than_the_driver_takes(spark, rows, monkeypatch):
    """Rare names are known as well; the same rows come out as with all names on the driver."""
    people = [f"{a}{b} {c}{d}" for a, b, c, d in zip(("Mira", "Tess", "Joan", "Orla"), ("la", "na", "ra", "sa"), ("Hal", "Qui", "Vos", "Cal"), ("vor", "sten", "ker", "der"))]
    said = [(10 * k + i, f"Minutes taken by {p}.\n{p.split()[1]}, {p.split()[0]}\nWe met {p.upper()} there.") for k, p in enumerate(people) for i in range(3 + k)]
    df = spark.createDataFrame([*said, (0, said[0][1]), (98, None), (99, "")], "doc_id long, text string")
    whole, masks = rows(P.find_pii(df)), rows(P.mask_pii(df))
    monkeypatch.setattr(P, "LEXICON", 1)
    assert len(whole) == 3 * len(said) and rows(P.find_pii(df)) == whole and rows(P.mask_pii(df)) == masks


def test_few_equal_words_are_told_by_counting(monkeypatch):
    """A diagonal that holds too few equal words for a stretch with so many changes is not searched for runs."""
    vocabulary, rng = L.Vocabulary(), random.Random(4)
    item = prose(rng, 60)
    doc = [w if k % 3 == 0 or 10 <= k < 19 else "zz" for k, w in enumerate(item)]
    codes = vocabulary.codes(item)
    searched = []
    monkeypatch.setattr(L, "stretch", lambda same: searched.append(1) or (0, 0))
    few = vocabulary.codes(doc[:40])
    assert np.count_nonzero(codes[:40] == few) < 22
    assert not L.enough(codes, L.weights_of(item, False), few, 0, False) and not searched


@pytest.mark.parametrize("seed", range(3))
def test_no_stretch_is_lost_by_counting(seed):
    """Wherever stretch() finds enough words, so does enough(), down to the least equal ones."""
    rng = random.Random(seed)
    n = 0
    for _ in range(3000):
        item = np.array([rng.randrange(10**9) for _ in range(rng.randrange(25, 40))], dtype=np.uint64)
        doc = item.copy()
        for k in rng.sample(range(len(item)), rng.randrange(6)):
            doc[k] += np.uint64(1)
        a, z = L.stretch(item == doc)
        if z - a >= L.LEAST_WORDS:
            n += 1
            assert L.enough(item, np.ones(len(item), dtype=np.int64), doc, 0, False)
    assert n > 500


def test_han_tokens():
    words = ["一", "鿿", "中", "word", "ⅷ", "가나", "ﬀ", "㐀", "ꀀ", "12", "café"]
    assert L.han_tokens(words).tolist() == [True, True, True] + [False] * 8
