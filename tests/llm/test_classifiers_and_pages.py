"""Classifiers on held-out rows, the grammar and the field by hand, pages, and the pipeline."""

import itertools
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from frostline.llm import catalog, crf_quality, style_tree, toxicity
from frostline.llm.labelled import fold, logistic

PAGE = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body>BODY</body></html>"


def truth(spark, sf_dir, name):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return {r["doc_id"]: r[name] for r in labels.collect()}


@pytest.mark.parametrize(("query", "label", "least"), [("op1_toxicity_grammar", "toxic", 0.6), ("op3_line_field_quality", "quality", 0.9)])
def test_classifier_query_on_held_out_rows(spark, query, label, least):
    sf_dir = "/root/testdata/sf0.01"
    got = catalog.QUERIES[query](spark, sf_dir).collect()
    assert len(got) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    y = truth(spark, sf_dir, label)
    held = [(r["predicted"], y[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in y]
    share = {k: np.mean([p == k for p, v in held if v == k]) for k in (0, 1)}
    assert len(held) > 50 and share[0] >= 0.9 and share[1] >= least, share


def test_fold_is_the_checksum_of_the_text(spark):
    import zlib

    got = spark.range(0, 50).select("id", fold(F.col("id"), 4).alias("f")).collect()
    assert all(r["f"] == zlib.crc32(str(r["id"]).encode()) % 4 for r in got)


def test_grammar_marks_events():
    model = toxicity.Model({"idiot": 1.0}, {"blork": 0.5}, toxicity.first_weights())
    events = lambda t: {e: x for e, x in zip(toxicity.EVENTS, model.events(t)) if x}
    assert events("What an idiot.") == {"I": 1.0}
    assert events("You are an IDIOT, really") == {"I+": 1.0}
    assert events("an idiot you") == {"I+": 1.0}
    assert events("He is not an idiot") == {"I-+": 1.0}
    assert events("it said what an idiot") == {"Iq": 1.0}
    assert events("not so; an idiot") == {"I": 1.0}  # a clause ends the scope
    assert events("I will kill you") == {"T+": 1.0}
    assert events("blorkish blork things") == {"I": 0.5}  # a stem stands for its longer forms only
    assert events("") == {} and events("idiotic clownish") == {}
    assert model.score("You idiot, you idiot") > model.score("She said not an idiot") > model.score("A fine day")


def test_composition_equals_running_one_after_the_other():
    parts, symbols = [], list(toxicity.SYMBOLS)
    for opener, mark, reach in (("N", "-", 3), ("R", "q", 8), ("Y", "+", 4)):
        part, symbols = toxicity.scope(opener, mark, reach, symbols)
        parts.append(part)
    rng = random.Random(2)
    for _ in range(200):
        text = "".join(rng.choice(toxicity.SYMBOLS) for _ in range(12))
        want = list(text)
        for part in parts:
            want = list(part.run(want))
        assert list(toxicity.grammar().run(text)) == want


def test_classifiers_without_labels_or_rows(spark, make_docs, make_labels):
    docs = make_docs([(1, "You idiot"), (2, None), (3, ""), (4, "fine " * 50_000), (None, "x"), (1, "You idiot")], extra=True)
    none = make_labels([])
    model = toxicity.learn(docs, none, F.lit(True))
    got = {(r["doc_id"], r["score"]) for r in toxicity.score_texts(docs, model).collect()}
    assert len({i for i, _ in got}) == 5 and all(0 <= s <= 1 for _, s in got)
    assert crf_quality.learn(docs, none, F.lit(True)) is None
    assert [r["score"] for r in crf_quality.score_texts(docs, None).collect()] == [0.5] * 6
    odd = make_labels([(1, 1, 0), (1, 0, 1), (2, None, None), (None, 1, 1), (99, 0, 0)])
    assert crf_quality.learn(docs, odd, F.lit(True)) is None
    assert toxicity.score_texts(make_docs([]), model).count() == 0


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(4)
    chains, ties = [rng.normal(size=n) for n in (1, 4, 6, 3)], rng.normal(size=(2, 2))
    got, pairs = crf_quality.marginals(chains, ties)
    all_pairs = np.zeros((2, 2))
    for e, p in zip(chains, got):
        total, good = 0.0, np.zeros(len(e))
        here = np.zeros((2, 2))
        for labels in itertools.product((0, 1), repeat=len(e)):
            weight = np.exp(sum((x / 2 if y else -x / 2) for x, y in zip(e, labels)) + sum(ties[a, b] for a, b in zip(labels, labels[1:])))
            total += weight
            good += weight * np.array(labels)
            for a, b in zip(labels, labels[1:]):
                here[a, b] += weight
        assert np.allclose(p, good / total)
        all_pairs += here / total
    assert np.allclose(pairs, all_pairs)


def test_field_prefers_prose_to_shouting():
    prose = ["It was a plain day and nobody spoke of it again.\nThe rest is known.", "There are two rivers.\nOne is long, the other wide.\nBoth end here."]
    noise = ["BUY!! NOW!! BUY!! NOW!! BUY!! NOW!!\nBUY!! NOW!!", "x | y | z | x | y | z |\n$$$ ### %%% ||"]
    chains = [crf_quality.document_features(t)[0] for t in prose + noise]
    field = crf_quality.fit_field(chains, np.array([1, 1, 0, 0]))
    assert min(map(field.quality, prose)) > 0.5 > max(map(field.quality, noise))
    assert 0 <= field.score("") <= 1 and 0 <= field.score("\n\n") <= 1


def test_logistic_finds_the_slope():
    x = np.linspace(-3, 3, 400)[:, None]
    y = (np.random.default_rng(0).random(400) < 1 / (1 + np.exp(-2 * x[:, 0] - 0.5))).astype(float)
    w = logistic(x, y, np.zeros(2), 1e-3)
    assert abs(w[0] - 2) < 0.7 and abs(w[1] - 0.5) < 0.5


def test_lines_of_a_very_long_document_are_sampled_in_whole_chains():
    text = "\n".join(f"line {k} of many" for k in range(1_000))
    x, size = crf_quality.sampled_lines(text)
    every, lengths = crf_quality.document_features(text)
    assert len(x) == len(size) <= crf_quality.FIT_CHAINS * crf_quality.CHAIN < len(every) == len(lengths)
    again, _ = crf_quality.sampled_lines(text)
    assert (x == again).all()
    short = "\n".join(f"line {k}" for k in range(crf_quality.FIT_CHAINS * crf_quality.CHAIN))
    assert len(crf_quality.sampled_lines(short)[0]) == crf_quality.FIT_CHAINS * crf_quality.CHAIN


# Pages

CASES = [
    ("<nav><a href='/'>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three<p>four<br>five</article><footer>&copy;</footer>", "A & B One two three four five"),
    ("<main><p>in main</p><aside>no</aside><div class='cookie-notice'>no</div><form>no<p>no</p></form><p>end</main>", "in main end"),
    ("<article><header><h1>Title</h1></header><p>a<!-- x <p>no</p> -->b</p><section id='comments'><article>no</article></section></article>", "Title ab"),
    ("<div class=ad>no</div><div><p>a &lt;b&gt; &#233; &nbsp; c</p></div>", "a <b> é c"),
    ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
    ("<article><p>cut &am", "cut &am"),
    ("<article><p>if a < b and b > c</p><p hidden>no</p><p style='display: none'>no</p></article>", "if a < b and b > c"),
    ("<article><p title=\"a > b\">kept</p><textarea>no</textarea><script>if (a</b) '<p>no</p>'</script></article>", "kept"),
    ("", ""), ("plain text only", "plain text only"), ("<article></article><p>fallback</p>", "fallback"), ("<p>never closed <b", "never closed"),
]


@pytest.mark.parametrize(("body", "want"), CASES)
def test_main_text(body, want):
    assert style_tree.main_text(PAGE.replace("BODY", body) if body and "<" in body else body, set()) == want


def test_branches_that_repeat_are_low(spark, run_of):
    words = [f"w{k}" for k in range(500)]
    rng = random.Random(1)
    rows = []
    for i in range(40):
        text = " ".join(rng.choice(words) for _ in range(30))
        rows.append((i, f"http://H.example/{i}", f"<html><body><div id=top{i}>Welcome to the site</div><div class=text>{text}</div><div class=end>See you {i % 2}</div></body></html>", text))
    rows += [(100, None, None, ""), (101, "no url", "<p>x</p>", "x"), (101, "no url", "<p>x</p>", "x"), (102, "http://one.example", "<div>alone " + "y " * 60_000 + "</div>", "alone" + " y" * 60_000)]
    pages = spark.createDataFrame([r[:3] + ("z",) for r in rows], "page_id long, url string, html string, host string")
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in style_tree.extract(pages, run_of("pages")).collect())
    assert got == sorted((r[0], r[3], len(r[3])) for r in rows)
    tree = {r["path"]: r["importance"] for r in style_tree.style_tree(pages).filter("host = 'h.example'").collect()}
    assert tree["/html/body/div.top0"] == 0 and tree["/html/body/div.text"] == pytest.approx(1) and tree["/html/body/div.end"] < 0.5
    assert style_tree.extract(pages.limit(0), run_of("pages")).count() == 0


def test_copies_of_a_page_keep_their_text(spark, run_of):
    """A re-crawl of one page, and a host on which copies of one page outnumber the others, lose no text."""
    page = '<html><body><div class="top">All pages</div><div class="text">{}</div></body></html>'
    rows = [(i, f"https://again.example/{i}", page.format("the only page")) for i in range(5)]
    rows += [(10 + i, f"https://many.example/{i}", page.format("text 0" if i < 12 else f"text {i}")) for i in range(16)]
    bare = "<html><body><div>{}</div></body></html>"
    rows += [(30 + i, f"https://same.example/{i}", bare.format("the same words") + f"<!-- {i} -->") for i in range(5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages, run_of("pages")).collect()}
    assert [got[i] for i in range(5)] == ["All pages the only page"] * 5
    assert [got[10 + i] for i in range(16)] == ["text 0"] * 12 + [f"text {i}" for i in range(12, 16)]
    assert [got[30 + i] for i in range(5)] == ["the same words"] * 5
    tree = {(r["host"], r["path"]): r["pages"] for r in style_tree.style_tree(pages).collect()}
    assert tree["again.example", "/html/body/div.text"] == 1 and tree["many.example", "/html/body/div.text"] == 5


def test_names_inside_an_article_are_evidence_only():
    """A word of furniture inside a name drops nothing alone; a whole name does, and outside an article both do."""
    article = ("<article><h2 id='related-work'>Related work</h2><section class='search-methods'><p>How we searched</p></section>"
               "<p id='notice-period'>Three months</p><p class='ad-banner'>no</p><div id=comments><p>no</p></div><p>End</p></article>")
    assert style_tree.main_text(PAGE.replace("BODY", article), set()) == "Related work How we searched Three months End"
    assert style_tree.main_text("<div class='related-posts'>no</div><div>yes</div>", set()) == "yes"
    for name, want in (("ad", 2), ("site-footer", 2), ("cookie-notice", 2), ("related-work", 1), ("adder shared", 0), ("", 0)):
        assert style_tree.named(name) == want


def test_only_entropy_tells_text_from_furniture_inside_articles(spark, run_of):
    """One host whose articles repeat a neutral promotion and a doubtful box, and keep doubtful names whose text differs."""
    page = ("<html><body><article><h2>Background</h2><p>{0}</p><div class=x9>Subscribe now! Share this!</div>"
            "<section class=search-methods>{1}</section><section class=search-tips>Try other words</section></article></body></html>")
    texts = [(f"Paragraph number {'i' * k} of its own", f"Method {'v' * k}") for k in range(1, 9)]
    rows = [(k, f"https://one.example/{k}", page.format(*t)) for k, t in enumerate(texts)]
    rows += [(100, "https://other.example/", page.format("alone", "here"))]  # one page: nothing is known to repeat
    deep = "<div>" * 3_000 + "deep" + "</div>" * 3_000
    rows += [(200, "https://deep.example/", f"<article>{deep}</article>"), (201, "https://deep.example/b", "<article>" + "<p>word" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in style_tree.extract(pages, run_of("pages")).collect()}
    for k, (text, method) in enumerate(texts):
        assert got[k] == f"Background {text} {method}"
    assert got[100] == "Background alone Subscribe now! Share this! here Try other words"
    assert got[200] == "deep" and got[201] == " ".join(["word"] * 20_000)


def test_pages_query_equals_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    want = sorted(duckdb.sql(catalog.ORACLE["op7_site_style_tree"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["op7_site_style_tree"](spark, sf_dir).collect())) == want


# Pipeline

def test_pipeline_stages_on_planted_rows(spark, sf_dir, make_docs):
    docs = make_docs([], extra=True).limit(0)
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = given.columns
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "toxicity", "n-gram Jaccard join", "best-fit packing"]
    words = [f"Thing{k}" for k in range(60)]
    clean = "The " + " ".join(w.lower() for w in words) + " and so on."
    planted = make_docs([(900_001, clean), (900_002, clean), (900_003, clean.replace("thing30", "other")), (900_004, "A wholly different line of plain words, calm and clear."),
                         (900_005, None), (900_005, None), (None, clean), (None, clean), (None, "No name, but words that no other text here has at all."),
                         (900_006, clean.replace("thing12", "changed")), (900_006, "The second text under one number, which is nobody's copy.")])
    kept = stages["n-gram Jaccard join"](spark, planted, sf_dir)
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [900_001, 900_004, 900_005, 900_006, None]
    assert {r["text"][:10] for r in kept.collect() if r["doc_id"] in (900_006, None)} == {"The second", "No name, b"}
    good = stages["quality classifier"](spark, given, sf_dir)
    mild = stages["toxicity"](spark, given, sf_dir)
    assert good.columns == mild.columns == kept.columns == columns
    y = truth(spark, sf_dir, "quality")
    left = {r["doc_id"] for r in good.collect()}
    assert np.mean([i in left for i, v in y.items() if v == 1]) >= 0.95 and np.mean([i in left for i, v in y.items() if v == 0]) <= 0.1
    for stage in stages.values():
        assert stage(spark, docs, sf_dir).count() == 0


def test_pipeline_run_equals_its_stages_by_hand(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    total = {}
    for r in rows:
        total[r["sequence_id"]] = total.get(r["sequence_id"], 0) + r["length"]
    assert max(total.values()) <= 4096
