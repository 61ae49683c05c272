"""Toxicity, quality and page extraction: held-out accuracy, defined results for odd rows, and no leaks of labels."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicebox.llm.boosted_trees import fit_trees
from sluicebox.llm.cotraining import classify_quality
from sluicebox.llm.logistic import fit_logistic
from sluicebox.llm.main_text import extract_main_text, extract_text, fit_pages, parse_page, walk
from sluicebox.llm.toxicity import classify_toxicity, held_out, labelled_sample, windows

SYLLABLES = "ba ke lo mi nu pa re so ti vu wa ze cho dra fli gro".split()
INSULTS = "gragnok blurfing snorvel twazzock".split()


def prose(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(n))


def toxic_corpus(seed=1, n=900):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = prose(rng, rng.randint(60, 250)).split()
        toxic = rng.random() < 0.3
        for _ in range(max(4, len(words) // 20) if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS) + rng.choice(["", ",", "."]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_toxicity_of_held_out_rows(spark):
    rows = toxic_corpus()
    extra = [(5000, None), (5001, ""), (5002, "gragnok " * 40), (5003, prose(random.Random(2), 20000)), (None, "gragnok blurfing")]
    docs = spark.createDataFrame([(k, t, "z") for k, t, _ in rows] + [(*e, "z") for e in extra], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows], "doc_id long, toxic int")
    found = {r.doc_id: r for r in classify_toxicity(docs, labels).collect()}
    assert len(found) == len(rows) + len(extra)
    out = [(found[k], y) for k, _, y in rows if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all(r.held_out for r, _ in out) and len(out) > 200
    assert np.mean([r.predicted == y for r, y in out]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found.values())
    assert found[5000].score == found[5001].score < 0.5 and found[5003].predicted == 0 and found[5002].predicted == 1
    # Held-out labels change nothing.
    turned = labels.withColumn("toxic", F.when(held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r.doc_id: r.score for r in classify_toxicity(docs, turned).collect()}
    assert again == {k: r.score for k, r in found.items()}


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (None, 0)], "doc_id long, toxic int")
    assert [r.score for r in classify_toxicity(docs, labels).collect()] == [0.0] * 3
    assert classify_toxicity(docs.limit(0), labels).count() == 0


def test_windows_cover_the_text():
    assert windows("Ab  c\n" + "x" * 60) == ["ab", "c", "x" * 24, "x" * 24, "x" * 12]
    assert windows("") == []


def quality_corpus(seed=3, n=700):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        bad = rng.random() < 0.3
        text = prose(rng, rng.randint(60, 200))
        if bad and rng.random() < 0.5:
            text = " ".join(w + rng.choice(["$$$", "!!", "***"]) for w in text.split())
        elif bad:
            text = " ".join(w for w in text.split()[:8] for _ in range(20))
        source = rng.choice(["spam", "spam", "blog"]) if bad else rng.choice(["blog", "news"])
        rows.append((i, text, "en", source, len(text), int(not bad)))
    return rows


def test_quality_of_unlabelled_rows(spark):
    rows = quality_corpus()
    extra = [(9000, None, None, None, None), (9000, None, None, None, None), (None, prose(random.Random(1), 90), "en", "blog", 400)]
    fields = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([r[:5] for r in rows] + extra, fields).withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(r[0], r[5]) for r in rows if r[0] % 3], "doc_id long, quality int")
    found = classify_quality(docs, labels, ["doc_id"]).collect()
    assert len(found) == len(rows) + len(extra)
    score = {r.doc_id: r for r in found}
    out = [(score[r[0]].kept, bool(r[5])) for r in rows if not r[0] % 3]
    assert np.mean([a == b for a, b in out]) > 0.98
    assert np.mean([(score[r[0]].meta_margin > 0) == bool(r[5]) for r in rows if not r[0] % 3]) > 0.7
    assert len({r.score for r in found if r.doc_id == 9000}) == 1 and score[None].kept
    page = docs.select(F.struct("*").alias("PAGE"), *docs.columns[:5])
    assert classify_quality(page, labels, ["PAGE"]).select("PAGE.*").columns == docs.columns


def test_quality_without_labels_keeps_all(spark):
    docs = spark.createDataFrame([(1, "a", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert [r.kept for r in classify_quality(docs, labels, ["doc_id"]).collect()] == [True]
    assert classify_quality(docs.limit(0), labels, ["doc_id"]).count() == 0


def test_logistic_and_trees_learn():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 4))
    y = (x[:, 0] + 0.5 * x[:, 1] > 0.3).astype(float)
    model, loss = fit_logistic(x, y)
    assert loss < 0.1 and ((model.probability(x) > 0.5) == y).mean() > 0.98
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.2)).astype(float)
    trees = fit_trees(x[:1500], y[:1500])
    assert ((trees.margin(x[1500:]) > 0) == y[1500:]).mean() > 0.95


ARTICLE = ["Some title here", "First paragraph & more, with words. And so on.", "Second one, quite as long as the first. Yes."]


def page(rng, body=None, around=True):
    paras = body or [prose(rng, rng.randint(20, 60)).capitalize() + "." for _ in range(rng.randint(3, 8))]
    inner = f"<h1>{paras[0]}</h1>" + "".join(f"<p>{p.replace('&', '&amp;')}" + rng.choice(["", "</p>"]) for p in paras[1:])
    if not around:
        return inner
    links = "".join(f"<li><a href='/{i}'>{prose(rng, 1)}</a>" for i in range(6))
    return (
        f"<!DOCTYPE html><html><head><title>{paras[0]}</title><script>var a='</p>';</script></head><body><nav><ul>{links}</ul></nav>"
        f"<div class='ad'>{prose(rng, 9)}</div><article>{inner}</article><footer>&copy; {prose(rng, 5)}</footer>"
    )


@pytest.fixture(scope="module")
def trees():
    rng = random.Random(6)
    return fit_pages([page(rng) for _ in range(120)])


def test_pages_of_the_known_kind(trees):
    rng = random.Random(8)
    bodies = [[prose(rng, rng.randint(1, 40)).capitalize() + "." for _ in range(rng.randint(2, 9))] for _ in range(150)]
    found = list(extract_text([page(rng, b) for b in bodies], trees))
    assert found == [" ".join(b) for b in bodies]


@pytest.mark.parametrize(
    "part",
    [
        "<aside class=x><p>Read this too, it is nice. Or not, as you like.</p></aside>",
        "<div class='sidebar widget'><p>Read this too, it is nice. Or not, as you like.</p></div>",
        "<div id=cookie-notice><p>We use cookies, as all do. Please agree to them.</p></div>",
        "<section id='comments'><h3>3 comments</h3><p>What a good text, thank you. I liked it, mostly.</p></section>",
        "<form><label>Your name</label><input name=a><button>Send</button></form>",
        "<header><p>The daily site, for all of us. Since long ago.</p></header>",
    ],
)
def test_parts_within_an_article_go(trees, part):
    rng = random.Random(9)
    whole = page(rng, ARTICLE).replace("<p>Second", part + "<p>Second")
    assert list(extract_text([whole], trees)) == [" ".join(ARTICLE)]


def test_markup_of_all_kinds(trees):
    text = lambda html: list(extract_text([f"<article>{html}</article>"], trees))[0]
    assert text("<p>a&nbsp;&#233;&lt;b&gt;  c\n d<br>e<b>f</b>g") == "a é<b> c d efg"
    assert text("<p>one<p>two<div>three</div>four") == "one two three four"
    assert text("<!-- <p>no</p> --><p title='a>b'>yes <i>it</i> is<style>p{}</style></p>") == "yes it is"
    assert text("<ul><li>a<li>b</ul><table><tr><td>c<td>d</table>") == "a b c d"
    assert list(extract_text(["", "plain text  only", "<p>", "<", "</div>x", "<div" * 50], trees))[:2] == ["", "plain text only"]


def test_deep_nesting_needs_no_recursion(trees):
    html = "<div>" * 5000 + "deep" + "</div>" * 5000
    assert len(walk(parse_page(html))) == 5001
    assert list(extract_text([html], None)) is not None


def test_children_of_a_dropped_node_are_dropped(trees):
    from sluicebox.llm.main_text import decode, node_features

    nodes, _ = node_features(parse_page("<div><p>a</p><p>b</p></div><p>c</p>"))
    assert decode(nodes, np.array([1.0, -4.0, 1.0, 1.0, 1.0])) == "c"
    assert decode(nodes, np.array([1.0, -1.0, 1.0, 1.0, 1.0])) == "a b c"
    assert decode(nodes, np.array([1.0, 4.0, -1.0, 1.0, -1.0])) == "b"


def test_extraction_operator(spark):
    rng = random.Random(4)
    rows = [(i, page(rng), "x") for i in range(60)] + [(1000, None, "x"), (1001, "", "x"), (None, page(rng, ARTICLE), "x")]
    df = spark.createDataFrame(rows + rows[:2], "page_id long, html string, main_text string")
    found = extract_main_text(df, ["page_id"]).collect()
    assert len(found) == len(rows) + 2
    texts = {r.page_id: r.main_text for r in found}
    assert texts[1000] == texts[1001] == "" and texts[None] == " ".join(ARTICLE) and texts[0]
    assert extract_main_text(df.limit(0), ["page_id"]).count() == 0


def divs(html, words):
    """The page without telling tags; attributes name the article, or nothing does."""
    for old, new in (("<article>", f"<div{words}>"), ("</article>", "</div>"), ("<nav>", "<div class=menu>"), ("</nav>", "</div>")):
        html = html.replace(old, new)
    return html.replace("<footer>", "<div class=footer>")


@pytest.mark.parametrize("words", [" class='post-content'", " role=main", " id=story", ""])
def test_pages_without_telling_tags(spark, words):
    rng = random.Random(11)
    bodies = [[prose(rng, rng.randint(20, 60)).capitalize() + "." for _ in range(rng.randint(3, 8))] for _ in range(40)]
    rows = [(i, divs(page(rng, b), words)) for i, b in enumerate(bodies)]
    found = {r.page_id: r.main_text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]).collect()}
    assert [found[i] for i in range(len(rows))] == [" ".join(b) for b in bodies]


def test_pages_that_name_no_article_are_not_dropped():
    text = lambda html: list(extract_text([html], None))[0]
    assert text("<div>Short one</div>") == "Short one"
    assert text("<div class='content with-sidebar'><div>Short one</div><ul><li><a href=x>away</a></ul></div>") == "Short one"
    assert text("<div class=sidebar><div class=text>By the way</div></div><div><p>Short one</p></div>") == "Short one"
    assert text("<ul><li><a href=x>all of it</a></ul>") == ""


@pytest.mark.parametrize(
    "part, read",
    [
        ("<svg class=icon/>", ""),
        ("<svg class='icon'/>", ""),
        ("<svg viewBox='0 0 9 9' /><svg/><svg><svg/><title>no</title></svg>", ""),
        ("<svg><path d='M0'/>", ""),
        ("<object data=x>", ""),
        ("<template>", ""),
        ("<object>no<object>no</object></object>", ""),
        ("<!-- <svg> --><svg><!-- <svg> --><text>no</text></svg>", ""),
        ("<script>var a = '<svg>';</script><svg><text>no</text></svg>", ""),
        ("<math/>", ""),
        ("<math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=tex>no</annotation></semantics></math>", "x=1"),
        ("<math><mi>x</mi>", "x"),
        ("<select><option>no<option>no</select>", ""),
        ("<datalist><option>no<option>no</datalist>", ""),
    ],
)
def test_unread_elements_lose_nothing_else(part, read):
    text = lambda html: list(extract_text([html], None))[0]
    assert text(f"<article><p>before</p>{part}<p>after</p></article>") == " ".join(filter(None, ["before", read, "after"]))
    assert text(f"{part}<article><p>before</p><p>after</p></article>").endswith("before after")


def test_many_open_elements_take_one_pass():
    html = "<article><p>" + "<svg><object>a " * 50_000 + "</article>"
    assert list(extract_text([html], None))[0] == " ".join(["a"] * 50_000)


def test_rare_toxicity_is_learnt_from_a_bounded_sample(spark):
    rng = random.Random(12)
    rows = []
    for i in range(9000):
        words, toxic = prose(rng, rng.randint(40, 80)).split(), i % 50 == 7
        for _ in range(5 if toxic else 0):
            words.insert(rng.randint(0, len(words)), rng.choice(INSULTS))
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs, labels = table.select("doc_id", "text"), table.select("doc_id", "toxic")
    wanted = labels.where(~held_out()).groupBy("toxic").count().orderBy("toxic").collect()
    sample, odds = labelled_sample(docs, labels, "toxic", ~held_out(), 300)
    taken = {r.LABEL: r["count"] for r in sample.groupBy("LABEL").count().collect()}
    assert taken == {0: 300 - taken[1], 1: min(150, wanted[1]["count"])} and taken[1] > 100
    assert np.isclose(odds, np.log(wanted[1]["count"] / wanted[0]["count"]) - np.log(taken[1] / taken[0]))
    found = {r.doc_id: r for r in classify_toxicity(docs, labels, rows=300).where("held_out").collect()}
    out = [(found[k].predicted, y) for k, _, y in rows if k in found]
    assert sum(p for p, y in out if y) > 0.9 * sum(y for _, y in out) > 40
    assert sum(p for p, y in out if not y) < 0.01 * len(out)
    # A kind that all labels are of leaves the other one no share.
    assert labelled_sample(docs, labels.where("toxic = 0"), "toxic", ~held_out(), 300)[0].count() == 300
