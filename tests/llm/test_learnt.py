"""Quality rules, toxicity, quality scores and page texts."""

import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from lintlake.llm import host_rules, html_extraction, quality_model, toxicity
from lintlake.llm.boosted_trees import BoostedTrees
from lintlake.llm.deobfuscation import END, LOOKALIKES, OTHER, SEPARATORS, SYMBOL_OF, LanguageModel, core_of, trigram_counts
from lintlake.llm.html_tree import Forest, Page, main_text
from lintlake.llm.labelled import fit_logistic, fold, labelled_sample
from lintlake.llm.page_samples import sample_pages
from lintlake.llm.text_rules import count_text

PLAIN = "the river runs over many stones and the boats wait near an old town where people talk about small things".split()
INSULTS = ["idiot", "moron", "loser", "stupid", "ass"]


# Quality rules.


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = list(zip(words, words[1:], words[2:]))
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_counts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c\n\t#*\x0b é ") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    for text in [*texts, "", "a a a a", "a b c x a b c", "a\n\na\n \n "]:
        assert count_text(text) == plain_counts(text), text


def test_hosts(make_docs):
    good = " ".join(PLAIN[i % 19] + str(i) for i in range(60))
    odd = " ".join(f"w{i}#*" for i in range(60))
    rows = [(i, good + f" {i}", "good") for i in range(50)] + [(100, odd, "good")]
    rows += [(200 + i, odd + f" {i}", "junk") for i in range(50)] + [(300, good, "junk"), (301, "short", "good"), (302, good, None)]
    verdict = {r.doc_id: r for r in host_rules.judge(make_docs(rows), host_rate=0.99).collect()}
    assert verdict[0].kept and verdict[302].kept
    assert verdict[100].kept, "one failure of a soft rule on a good host"
    assert not verdict[200].kept and not verdict[200].base_failed, "a rule that is usual on its host"
    assert verdict[300].kept, "a clean document of a bad host"
    assert not verdict[301].kept and verdict[301].base_failed
    assert 0 < verdict[0].host_failure_rate < verdict[200].host_failure_rate < 1
    strict = {r.doc_id: r.kept for r in host_rules.judge(make_docs(rows)).collect()}
    assert not strict[300], "a host that fails nearly throughout"


def test_rules_of_odd_rows(odd_docs, make_docs):
    judged = host_rules.judge(odd_docs)
    assert judged.count() == odd_docs.count() and set(odd_docs.columns) <= set(judged.columns)
    assert judged.where("kept IS NULL OR base_failed IS NULL").count() == 0
    clash = make_docs([(1, "a")]).selectExpr("*", "'x' AS N_Words", "'y' AS kept")
    assert host_rules.judge(clash).select("n_words", "kept").first() == (1, False)
    assert host_rules.judge(make_docs([])).count() == 0


# Toxicity.


@pytest.fixture(scope="module")
def language():
    rng = random.Random(2)
    texts = [" ".join(rng.choice(PLAIN + INSULTS) for _ in range(50)) for _ in range(200)]
    return LanguageModel(trigram_counts(texts))


@pytest.mark.parametrize("shown, meant", [
    ("1d10t", "idiot"), ("m0r0n!!", "moron"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("stuuupid", "stupid"),
    ("l o s e r", "loser"), ("iddiiiot,", "idiot"), ("st*pid", "stupid"), ("iddiot", "idiot"), ("stuupid", "stupid"),
    ("mo.ron", "moron"), ("id-iot", "idiot"), ("idi_ot", "idiot"), ("455", "ass"), ("|o$3r", "loser"),
])
def test_restored(language, shown, meant):
    got = language.decode(shown) if " " in shown else language.restore_word(shown)
    assert got == meant


@pytest.mark.parametrize("between", [" ", "\t", "   ", " \n", "\u00a0"])
def test_letters_apart(language, between):
    words = toxicity.Restorer(language).words("You are " + between.join("MORON") + " there")
    assert "moron" in words


def plain_decode(model, passage):
    """The least cost of all ways to read the passage, each tried."""
    ways = []
    for before, c in zip(" " + passage, passage):
        own = [(c, 0.0)] if c in SYMBOL_OF else []
        own += [(x, 1.0) for x in LOOKALIKES.get(c, "")] + ([(c, 4.0)] if c in LOOKALIKES else [])
        own += [(x, 1.0) for x in "aeiou"] if c == "*" else []
        own += [("", 0.7), (" ", 0.7)] if c in SEPARATORS else [("", 0.3)] if c == before else []
        ways.append(own or [(c, 0.0)])
    found = {}
    for path in itertools.product(*ways):
        total, a, b = 0.0, END, END
        for x, price in path:
            total += price
            if x == " ":
                total += float(model.cost[a, b, END]) if b != END else 0.0
                a = b = END
            elif x:
                symbol = SYMBOL_OF.get(x, OTHER)
                total += float(model.cost[a, b, symbol])
                a, b = b, symbol
        total += float(model.cost[a, b, END])
        read = "".join(x for x, _ in path)
        found[read] = min(total, found.get(read, total))
    return found


def test_decoding_tries_all_paths(language):
    rng = random.Random(5)
    shown = ["1d10t", "$tup1d", "455", "m0.r0n", "a-*b", "11", "!!", "i i", "x.y.z", "ssss", "*", "é1"]
    shown += ["".join(rng.choice("aaosti10$5. -*!|") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    for passage in shown:
        costs = plain_decode(language, passage)
        got = language.decode(passage)
        assert costs[got] <= min(costs.values()) + 1e-4, (passage, got)


def test_plain_words_stay(language):
    for word in (*PLAIN, "stones.", "(town)", "1234", "***", "", "tion$$$"):
        assert language.restore_word(word) in (word, core_of(word))
    long = "*" * 50000 + "x" + "a-" * 20000
    assert isinstance(language.restore_word(long), str)


def documents(rng, count):
    """Texts of which a fifth holds insults, half of them disguised after doc 300."""
    for i in range(count):
        words = [rng.choice(PLAIN) + rng.choice(["", "s", "ly", "ing"]) for _ in range(60)]
        toxic = i % 5 == 3
        if toxic:
            for k in rng.sample(range(60), 3):
                words[k] = rng.choice(INSULTS)
                if i > 300 and i % 2:
                    words[k] = words[k].replace("i", "1").replace("o", "0").replace("s", "$", 1)
        yield i, " ".join(words), toxic


def test_scores(make_docs, labels_of):
    rows = list(documents(random.Random(3), 500))
    labels = labels_of([(i, 1, int(t)) for i, _, t in rows])
    # Labels of held-out rows are turned round: they must have no influence.
    turned = labels_of([(i, 1, int(t) if zlib.crc32(str(i).encode()) % 5 else 1 - int(t)) for i, _, t in rows])
    found = {r.doc_id: r for r in toxicity.score_documents(make_docs(rows), labels).collect()}
    right = sum(found[i].predicted == t for i, _, t in rows if found[i].held_out)
    held = sum(r.held_out for r in found.values())
    assert 60 < held < 140 and right >= 0.97 * held
    for i, _, _ in rows:
        assert found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= found[i].score <= 1
    again = {r.doc_id: r.score for r in toxicity.score_documents(make_docs(rows), turned).collect()}
    assert again == {i: r.score for i, r in found.items()}


def test_rare_insults_are_learnt(make_docs, labels_of):
    """A word of under a hundredth of the toxic documents, and doubled, split and signed forms of others."""
    rng = random.Random(6)
    rows = list(documents(rng, 4000))
    rare = [i for i, _, toxic in rows if not toxic][:8]
    hidden = {4001: "stuupid", 4002: "mo.ron", 4003: "l\to\ts\te\tr", 4004: "id-iot", 4005: "zonker"}
    rows = [(i, t + " zonker" * 2, True) if i in rare else (i, t, x) for i, t, x in rows]
    rows += [(i, " ".join(rng.choice(PLAIN) for _ in range(30)) + f" {w} {w}", True) for i, w in hidden.items()]
    labels = labels_of([(i, 1, int(x)) for i, _, x in rows if i not in hidden])
    found = {r.doc_id: r.predicted for r in toxicity.score_documents(make_docs([r[:2] for r in rows]), labels).collect()}
    assert all(found[i] for i in hidden), {w: found[i] for i, w in hidden.items()}
    assert sum(found[i] for i, _, x in rows if not x) == 0


def test_toxicity_of_odd_rows(odd_docs, make_docs, labels_of):
    labels = labels_of([(1, 1, 0), (3, None, None), (4, 0, 1), (None, 1, 1), (4, 1, 0)])
    for given in (labels, labels_of([])):
        found = toxicity.score_documents(odd_docs, given)
        assert found.count() == odd_docs.count() and found.where("score IS NULL OR held_out IS NULL").count() == 0
        assert toxicity.score_documents(make_docs([]), given).count() == 0


# Quality scores.


def test_quality(make_docs, labels_of):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        words = [rng.choice(PLAIN) for _ in range(rng.randint(5, 80))]
        bad = i % 4 == 1
        if bad:
            words = [w.upper() + "!!" if i % 8 == 1 else w + rng.choice(["***", "###"]) for w in words]
        rows.append((i, " ".join(words), bad))
    labels = labels_of([(i, int(not bad), 0) for i, _, bad in rows])
    found = {r.doc_id: r for r in quality_model.score_documents(make_docs(rows), labels).collect()}
    held = [i for i in found if found[i].held_out]
    assert set(held) == {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert sum(found[i].predicted != rows[i][2] for i in held) >= 0.97 * len(held)
    assert all(found[i].predicted == (found[i].score >= 0.7) for i in found)
    again = {r.doc_id: r.score for r in quality_model.score_documents(make_docs(rows).repartition(3), labels).collect()}
    assert all(abs(again[i] - found[i].score) < 1e-3 for i in found)


def test_quality_of_odd_rows(odd_docs, make_docs, labels_of):
    for labels in (labels_of([(1, 1, 0), (4, 0, 1), (5, None, 1)]), labels_of([])):
        found = quality_model.score_documents(odd_docs, labels)
        assert found.count() == odd_docs.count() and found.where("score IS NULL").count() == 0
        assert quality_model.score_documents(make_docs([]), labels).count() == 0


def test_shapes():
    assert [quality_model.shape(w) for w in ("Ab,", "ABC!!", "x1y22", "|", "é***")] == ["Aa,", "A!", "a0a0", "|", "a*"]
    rng = random.Random(5)
    for _ in range(5000):
        word = "".join(rng.choice("aBcÉéǅ漢1.,!*ß") for _ in range(rng.randint(1, 6)))
        assert quality_model.core_and_shape(word) == ("".join(filter(str.isalnum, word)).lower(), quality_model.shape(word)), word


def test_index_vectors_by_hand():
    known, index = quality_model.Marks(), quality_model.index_vectors()
    text = "one two one two three"
    sums, counts = np.zeros(quality_model.MARKS * quality_model.WIDTH), np.zeros(quality_model.MARKS, np.int64)
    quality_model._accumulate([text, text], known, sums, counts, index)
    b, f = quality_model.marks_of(text.split(), known)
    dense = np.zeros((quality_model.MARKS, quality_model.WIDTH))
    np.put_along_axis(dense, index[0], index[1], axis=1)
    wanted = np.zeros_like(dense)
    for i in range(5):
        for j in range(5):
            if i != j and abs(i - j) <= 2:
                wanted[b[i]] += dense[b[j]]
            if abs(i - j) == 1 or i == j:
                wanted[f[i]] += dense[f[j]]
        wanted[b[i]] += dense[f[i]]
    assert np.array_equal(sums.reshape(wanted.shape)[1:], 2 * wanted[1:])  # but for the padding's own


def test_temperature_and_base(labels_of):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = (rng.random(2000) < 1 / (1 + np.exp(-2 * x[:, 0]))).astype(float)
    model = quality_model.QualityModel(np.zeros((1, 1)), np.zeros(1))
    model.fit(x, y)
    p = 1 / (1 + np.exp(-model.logits(x) / model.temperature))
    for low, high in ((0.0, 0.3), (0.3, 0.7), (0.7, 1.0)):
        own = (p >= low) & (p < high)
        assert abs(p[own].mean() - y[own].mean()) < 0.06


def test_labelled_sample(make_docs, labels_of):
    docs = make_docs([(i, f"t{i}") for i in range(100)])
    labels = labels_of([(i, i % 2, 0) for i in range(100)])
    sample = labelled_sample(docs, labels, "quality", fold(4) != 2, bound=30).collect()
    assert len(sample) == 30 and all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.label == r.doc_id % 2 for r in sample)


def test_labelled_sample_of_repeated_ids(make_docs, labels_of):
    """The bound holds for rows, and equal rows of an id count once."""
    docs = make_docs([(1, "same")] * 200 + [(2, f"t{i % 50}") for i in range(200)] + [(3, None), (3, "")])
    labels = labels_of([(1, 1, 0), (2, 0, 0), (3, 1, 0)])
    for bound, count in ((1000, 52), (20, 20)):
        rows = [tuple(r) for r in labelled_sample(docs, labels, "quality", fold(4) != -1, bound=bound).collect()]
        assert len(rows) == len(set(rows)) == count
    again = labelled_sample(docs.repartition(3), labels, "quality", fold(4) != -1, bound=20).collect()
    assert {tuple(r) for r in again} == set(rows)


def test_logistic():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 2))
    y = (rng.random(3000) < 1 / (1 + np.exp(-(1.5 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    assert np.abs(fit_logistic(x, y) - [1.5, -1, 0.5]).max() < 0.25


# Pages.


@pytest.fixture(scope="module")
def trees():
    return html_extraction.fit_trees([], layouts=150)


def test_boosting_learns_a_rule():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.4) ^ (x[:, 3] > 0.6)).astype(float)
    model = BoostedTrees(trees=30).fit(x, y, np.ones(3000))
    assert ((model.logits(x) > 0) == y).mean() > 0.97


def test_made_pages(trees):
    pages = sample_pages(80, seed=77)
    score = 0.0
    for source, got in zip(pages, html_extraction.extract(trees, pages)):
        page = Page(source)
        want = main_text(page, (np.array(page.label) == 1) & ~np.array(page.silent)).split()
        common = sum((Counter(want) & Counter(got.split())).values())
        score += 2 * common / max(1, len(want) + len(got.split()))
    assert score / len(pages) > 0.85


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><a href=/>Home</a></header><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies. <button>OK</button></div>
<article><h1>A title &amp; more</h1><p>First  paragraph, with <b>bold</b>
text &eacute; &#8364; &copy and words.<p>Second one.<br>After a break, it goes on.
<div class="ad">Buy this now</div><ul><li>item one of the list<li>item two</ul></article>
<section id="comments"><h3>Comments</h3><div class="comment"><p>Nice post, thank you.</p></div></section>
<aside class="sidebar"><h3>More</h3><ul><li><a href=/c>Other</a></li></ul></aside>
<footer>&copy; 2020 Example. All rights.</footer></body></html>"""


def test_page(trees):
    (text,) = html_extraction.extract(trees, [PAGE])
    assert text == (
        "A title & more\n\nFirst paragraph, with bold text é € © and words.\n\n"
        "Second one. After a break, it goes on.\n\nitem one of the list\n\nitem two"
    )


def test_decoding_has_no_contradiction():
    forest = Forest([Page("<div><p>a</p><p>b</p><p>c</p></div><ul><li>x<li>y</ul>")])
    logits = np.where(np.arange(len(forest.kind)) % 2 == 0, 3.0, 2.0)
    logits[3] = -0.2  # one doubtful paragraph under a kept division
    assert html_extraction.decode(forest, logits)[forest.own_chars > 0].all()
    logits[3] = -7.0  # a sure one
    assert not html_extraction.decode(forest, logits)[3]


@pytest.mark.parametrize("source", [
    "", "<", "<p", "text only", "a < b > c", "<p title='>'>x</p>", "<script>never closed", "<!-- never closed <p>x</p>",
    "</p></div>", "<div " + "a=b " * 20000, "<div>" * 3000 + "x", "<a href=\"" * 5000, "<li>" * 20000, "<p>" + "word " * 100000,
    "<TABLE><TR><TD>x<TD>y</TABLE>", "<p>\x00퟿ &#0; &#x110000; &bogus;</p>",
])
def test_odd_pages(trees, source):
    (text,) = html_extraction.extract(trees, [source])
    assert "<script" not in text
    if source == "text only":
        assert text == "text only"


@pytest.mark.parametrize("attribute", ['href="/x?a=1&_y=abc"', '_y=""', "_y=main", '_y="0"', 'data-_y="7"', 'title="a _y=abc class=sidebar"'])
def test_pages_with_the_training_mark(trees, attribute):
    plain = PAGE.replace("<article>", '<article data-x="1">')
    assert html_extraction.extract(trees, [PAGE.replace("<article>", f"<article {attribute}>")]) == html_extraction.extract(trees, [plain])
    page = Page(f"<div {attribute}><p>x</p></div>", marked=False)
    assert set(page.label) == {-1} and set(page.groups) == {0}
    assert isinstance(html_extraction.fit_trees([PAGE.replace("<article>", f"<article {attribute}>")], layouts=5), BoostedTrees)


def test_attributes_by_name():
    page = Page("<div\tCLASS=nav ID = 'footer'data-class=ad role=\"search\" alt='id=share'><p hidden class=></div>", marked=False)
    both = [w for w in ("nav", "footer", "search", "ad", "share") if page.groups[1] & Page(f"<p id={w}>").groups[1]]
    assert both == ["nav", "footer", "search"] and page.groups[2] == Page("<p hidden>").groups[1]
    Page("<p " + "x = " * 30000 + "a" + " " * 100000 + '="' * 30000 + ">")


def test_pages_table(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS TEXT")
    found = html_extraction.extract_pages(pages, layouts=60).collect()
    assert len(found) == 4 and {r.text for r in found if r.page_id != 1} == {""}
    assert html_extraction.extract_pages(pages.limit(0), layouts=60).count() == 0
