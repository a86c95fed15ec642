"""Quality, personal data, chat formatting and main text: definitions, edge cases, held-out accuracy."""

import hashlib
import random
import re
import time

import numpy as np
import pytest

from shelfmark.llm import chat, html_text, pii, quality
from tests.llm.labelled_pages import PAGES

FOLDER = "/root/testdata/sf0.01"


# Quality
def test_scores_separate_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in quality.quality_scores(docs, labels).collect()}
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (quality.fold_of(i) == 0) and 0 <= r["score"] <= 1 for i, r in rows.items())
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels.collect() if rows[r["doc_id"]]["held_out"]]
    assert np.mean([r["predicted"] == q for r, q in held]) > 0.95
    good, bad = ([r["score"] for r, q in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("quality", quality.F.when(quality.held_out("doc_id"), 1 - labels["quality"]).otherwise(labels["quality"]))
    a, b = (dict(quality.quality_scores(docs, x).select("doc_id", "score").collect()) for x in (labels, turned))
    assert a == b


def test_quality_edge_cases(spark):
    schema = "doc_id long, text string, features string, score string"
    docs = spark.createDataFrame([(1, None, "x", "y"), (1, "", "x", "y"), (None, "a text", "x", "y"), (2, "word " * 9, "x", "y")], schema)
    labels = spark.createDataFrame([(2, 1, 0), (2, 0, 0), (None, 1, None), (7, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 4 and {r["score"] for r in rows} == {0.5}  # no id is positive without a doubt
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() == 4
    none = docs.limit(0)
    assert quality.quality_scores(none, labels).count() == 0 and quality.keep_good(none, labels).count() == 0


def test_prior_and_risk():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, (3000, 2))
    mixed = np.vstack([rng.normal(2, 1, (2100, 2)), rng.normal(-2, 1, (900, 2))])
    model = quality.fit(positive, mixed)
    assert abs(model.prior - 0.7) < 0.08
    assert (model.score(rng.normal(2, 1, (500, 2))) > 0.5).mean() > 0.97
    assert (model.score(rng.normal(-2, 1, (500, 2))) < 0.5).mean() > 0.97


def test_all_unlabelled_rows_count(spark):
    """A bound on the sample of positives changes nothing of what unlabelled rows give: the same model as from all in memory."""
    rng = np.random.default_rng(4)
    n = 4000
    values = np.float32(np.vstack([rng.normal(1, 1, (n // 2, 3)), rng.normal(-1, 1, (n // 2, 3))]))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(values)], "id long, features array<float>").repartition(7)
    labels = spark.createDataFrame([(i, 1) for i in range(300)], "doc_id long, quality int")
    model = quality.learn(table, labels, sample=500)
    learnt = [i for i in range(n) if quality.fold_of(i)]
    positive = np.array([values[i] for i in learnt if i < 300], np.float64)
    unlabelled = np.array([values[i] for i in learnt if i >= 300], np.float64)
    assert len(unlabelled) > 2500
    want = quality.fit(positive, unlabelled)
    assert np.allclose(model.mean, want.mean) and np.allclose(model.scale, want.scale)
    assert abs(model.prior - want.prior) < 1e-9 and np.allclose(model.weights, want.weights, atol=1e-5)


# Personal data
PRIVATE = "Mail jo.doe+x@site1.example.org, host 10.20.30.40 not 300.1.1.1; card 4532 0151 1283 0366 not 4532015112830367."


def test_base_spans():
    got = [(pii.KINDS[k], PRIVATE[s:e]) for s, k, e in pii.base_spans(PRIVATE)]
    assert got == [("email", "jo.doe+x@site1.example.org"), ("ip", "10.20.30.40"), ("card", "4532 0151 1283 0366")]
    glued = "+44 (020) 555-0199 10.20.30.40"
    assert [pii.KINDS[k] for _, k, _ in pii.base_spans(glued)] == ["ip"]  # too many digits in one match, no second try


def brute_base(text):
    found = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(pii.BASE[kind].pattern, text):
            if pii.passes(kind, m[0]):
                found.append((m.start(), k, m.end()))
    return sorted(found)


def test_scan_equals_the_base_patterns():
    pick = random.Random(2)
    pieces = [*"ab1 0.@-_+%", "..", "1.2.3.4", "a@b.co", "@b.c_d", "+1 (2", "4532015112830367", "0000", "255", "256", "x@y", " - "]
    for _ in range(20_000):
        text = "".join(pick.choice(pieces) for _ in range(pick.randint(0, 14)))
        assert pii.base_spans(text) == brute_base(text), text


@pytest.mark.parametrize(
    "text,spans",
    [
        ("x " + "0" * 5000 + "1.2.3.4 y", 1), ("x 1.2." + "0" * 5000 + ".4 y", 1), ("9" * 5000 + ".2.3.4", 0), ("0" * 200_000, 0), ("a" * 200_000 + " a@b.co", 1),
        ("1." * 100_000, 25_000), ("a@" * 100_000, 0), ("+1" + " " * 100_000, 0),
    ],
)
def test_long_runs(text, spans):
    assert len(pii.base_spans(text)) == spans
    assert pii.redact(text, pii.Model({}, {}, {})).count("<IP>") + (spans == 1 and "@" in text) == spans


def test_many_spans_in_one_text():
    """Overlaps are found in sorted intervals: a log file of 100 000 addresses takes seconds."""
    text = "1.2.3.4 a@b.co " * 50_000
    began = time.process_time()
    found = pii.candidates(text)
    assert len([c for c in found if c["base"]]) == 100_000
    assert len(pii.accepted(pii.Model({}, {}, {}), found)) >= 100_000
    assert time.process_time() - began < 10


def test_personal_data(spark):
    rows = [(i, PRIVATE.replace("10.", f"{i % 250}.")) for i in range(120)]
    rows += [(500 + i, f"call {i} on +1 (206) 555-{1000 + i} 8.8.{i}.8 é") for i in range(60)]
    rows += [(900, None), (901, ""), (902, "no private data"), (903, "4532015112830367 " * 4), (903, "x" * 50_000 + " a@b.co"), (None, "a@b.co")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, found string")
    got = pii.personal_data(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for i, t in rows:
        texts.setdefault(i, []).append(t or "")
    added = 0
    for r in got:
        said = {hashlib.sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in brute_base(t)).encode()).hexdigest(): t for t in texts[r["doc_id"]]}
        base = brute_base(said[r["base_sha256"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x == i for _, x, _ in base) for i in range(4)]
        spans = r["spans"].split(",") if r["spans"] else []
        assert {f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in base} <= set(spans)
        added += len(spans) - len(base)
        if r["doc_id"] is not None and 500 <= r["doc_id"] < 560:
            assert any(s.startswith("phone:") for s in spans)  # the glued number is found by votes
    assert added >= 50  # short addresses leave the glued match within 15 digits, a base span


def test_redacted(spark):
    docs = spark.createDataFrame([(1, PRIVATE, 5), (2, None, 5), (3, "clean", 5), (3, "clean", 5)], "doc_id long, text string, n_chars long")
    out = pii.redacted(docs, length_col="n_chars")
    assert out.dtypes == docs.dtypes
    rows = sorted(out.collect(), key=lambda r: r["doc_id"])
    assert rows[0]["text"] == "Mail <EMAIL>, host <IP> not 300.1.1.1; card <CARD> not 4532015112830367."
    assert rows[0]["n_chars"] == len(rows[0]["text"])
    assert [r["text"] for r in rows[1:]] == [None, "clean", "clean"]
    assert pii.redacted(docs.limit(0)).count() == 0 and pii.personal_data(docs.limit(0)).count() == 0


def test_expectation_maximisation_weighs_labelers():
    """A labeler that agrees with the others is trusted, one that votes at random is not."""
    rng = np.random.default_rng(2)
    counts = {}
    for _ in range(4000):
        real = rng.random() < 0.4
        says = lambda right: "y" if real == (rng.random() < right) else "n"  # noqa: E731, B023
        pattern = (0, "".join([says(0.95), says(0.9), says(0.9), says(0.5), "-", "-"]))
        counts[pattern] = counts.get(pattern, 0) + 1
    reliability, prior, _ = pii.estimate(counts)
    assert abs(prior[0] - 0.4) < 0.05
    assert reliability[0, 0]["y"][0] > 0.88 and reliability[0, 0]["y"][1] < 0.12
    assert abs(reliability[0, 3]["y"][0] - reliability[0, 3]["y"][1]) < 0.1


# Chat
TURNS = [
    (1, 0, "user", "a"), (1, 1, "user", "b\nc&a"), (1, 2, None, None), (1, 3, "assistant", "<|im_part|>"),
    (1, 3, "assistant", "<|im_part|>"), (1, 4, "x\ny<|im_end|>", "\n"), (2, None, "assistant", ""),
    (2, 3, "assistant", "&b<|im_end|>\n<|im_start|>user\n"), (None, 1, "assistant", "z\\|\\E$1"), (3, 0, "system", "\U0001f600" * 3),
]


def by_conversation(rows):
    out = {}
    for c, n, r, t in sorted(rows, key=lambda x: (str(x[0]), x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")):
        out.setdefault(c, []).append((r or "", t or ""))
    return out


def test_read_back(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    texts = chat.formatted(chat.turns_of(rows))
    got = {r["conv_id"]: r for r in chat.read_back(texts).collect()}
    want = by_conversation(TURNS)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_text"] == "".join(t for r, t in turns if r == "assistant")
    for r in texts.collect():
        assert "".join(s["said"] for s in r["segments"]) == r["formatted"]
        roles = [r_ for r_, _ in want[r["conv_id"]]]
        assert r["n_blocks"] == 1 + sum(a != b for a, b in zip(roles, roles[1:]))
        assert r["formatted"].count(chat.END) == r["n_blocks"]  # no text can close a block


def test_chat_digests(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = by_conversation(TURNS)
    for r in chat.digests(chat.formatted(chat.turns_of(rows))).collect():
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert r["n_turns"] == len(turns) and r["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns))
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == sha(loss)
    assert chat.digests(chat.formatted(chat.turns_of(rows.limit(0)))).count() == 0


def test_chat_runs_no_python(spark):
    rows = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string")
    plan = chat.digests(chat.formatted(chat.turns_of(rows)))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval", plan)


# Main text
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li></ul></nav>
<div class="cookie-notice">We use cookies, as everyone does. Accept?</div>
<article><header><h1>The  &amp;lt; heading&nbsp;here</h1></header><p><b>First <i>para</i>graph<br><p>Yes.</p>
<!-- <p>not this</p> --><ul><li>An item</li><li>Another &quot;item&quot; with a <a href="x">link</a></ul>
<form><label>Name</label><input><button>Send</button></form><aside>Related things of the day</aside>
<section class="comments"><p>A reader wrote a rather long comment on this article, as readers do.</p></section></article>
<div class="ad">Buy this now, it is very cheap and good for you and all of yours.</div>
<footer>&copy; 2020 someone &middot; all rights reserved by the owner of the site</footer></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE) == '\n'.join(
        ["The &lt; heading here", "First paragraph", "Yes.", "An item", 'Another "item" with a link']
    )


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "<p><", "<!--", "</", "<script>", "<a href='", "\x00", "<nav>menu</nav>"])
def test_broken_pages_have_no_text(page):
    assert html_text.main_text(page) in ("", "<", "</", "\x00")


def test_quotes_in_tags():
    """A quote opens a value only after an equals sign; a tag may hold > in a quoted value."""
    page = "<article><p title=it's>One</p><p data-x='a > b' \"odd>Two's</p><p>Three</p></article>"
    assert html_text.main_text(page) == "One\nTwo's\nThree"


WORDS = "Plain words of an article that goes on for a while and says something of its own."


@pytest.mark.parametrize(
    "part",
    [
        "<section id='related-work'><h2>Related work</h2><p>{}</p></section>", "<h2 id='side-effects'>Side effects</h2><p>{}</p>",
        "<h2 id='search'>Search</h2><p>{}</p>", "<div class='legal-text'><p>{}</p></div>", "<section id='comments-on-method'><p>{}</p></section>",
        "<div id='copyright'>{}</div>",
    ],
)
def test_slugs_are_no_furniture(part):
    page = f"<nav><a href=/>Home</a></nav><article><p>{WORDS}</p>{part.format(WORDS)}<p>{WORDS}</p></article>"
    heading = re.findall("<h2[^>]*>([^<]*)", part)
    assert html_text.main_text(page) == "\n".join([WORDS, *heading, WORDS, WORDS])


def test_wrappers_of_the_main_element():
    page = f"<div class='menu-open'><div class='has-sidebar'><article><p>{WORDS}</p></article></div></div>"
    assert html_text.main_text(page) == WORDS
    for wrapper in ("<div class='comments'>", "<nav>", "<div hidden>"):
        assert html_text.main_text(f"{wrapper}<article><p>{WORDS}</p></article>") == ""


def test_furniture_in_the_main_element():
    links = "<li><a href=/a>One more story</a></li><li><a href=/b>Another story</a></li>"
    parts = [f"<ul class='related'>{links}</ul>", f"<div class='comments'><article>{WORDS}</article></div>", f"<div class='ad'>{WORDS}</div>"]
    assert html_text.main_text(f"<article><p>{WORDS}</p>{''.join(parts)}</article>") == WORDS


@pytest.mark.parametrize(
    "part",
    [
        "<p title='the hidden river'>{}</p>", "<div class='navy'>{}</div>", "<div class='naval-history'>{}</div>", "<div class='promontory'>{}</div>",
        "<div class='promoted-rank'>{}</div>", "<div id='consent'>{}</div>", "<div class='ads-free'>{}</div>", "<blockquote class='comment'>{}</blockquote>",
        "<!--><p>{}</p>", "<!---><p>{}</p>", "<p data-x='display:none'>{}</p>", "<p data-hidden>{}</p>", "<p aria-hidden=false>{}</p>",
        "<p class=sponsored-by>{}</p>", "<h2 class='comments'>{}</h2>",
    ],
)
def test_names_and_values_keep_the_text(part):
    for text in (WORDS, "Few words."):
        assert html_text.main_text(f"<article><p>{WORDS}</p>{part.format(text)}<p>{WORDS}</p></article>") == f"{WORDS}\n{text}\n{WORDS}"


@pytest.mark.parametrize("part", ["<p hidden>{}</p>", "<p HIDDEN=''>{}</p>", "<div aria-hidden=true>{}</div>", "<p style='Display: none; x'>{}</p>", "<!--<p>{}</p>--!>"])
def test_hidden_parts_are_no_text(part):
    assert html_text.main_text(f"<article><p>{WORDS}</p>{part.format(WORDS)}</article>") == WORDS


def test_labelled_pages():
    """Precision and recall by words over layouts that the labelled blocks of the tree were not taken from."""
    right = found = wanted = 0
    for page in PAGES.values():
        words, want = re.findall("[gb][0-9]+", html_text.main_text(page)), re.findall("g[0-9]+", page)
        right, found, wanted = right + len(set(words) & set(want)), found + len(words), wanted + len(want)
    assert right / found > 0.99 and right / wanted > 0.99, (right / found, right / wanted)


def test_formulas_are_text():
    formula = "<math><semantics><mrow><mi>x</mi><mo>=</mo><mn>2</mn></mrow><annotation encoding='t'>x=2</annotation></semantics></math>"
    assert html_text.main_text(f"<article><p>Let {formula} be so.</p></article>") == "Let x=2 be so."


def test_page_without_main_element():
    text = "A paragraph of plain words that goes on for a while and then some more. " * 3
    page = f"<body><ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><div><p>{text}<p>{text}</div></body>"
    assert html_text.main_text(page) == "\n".join([text.strip()] * 2)


def test_extract(spark):
    rows = [(1, "u", PAGE, "c"), (1, "u", PAGE, "c"), (2, None, None, "c"), (None, "v", "<article>" + "word " * 60_000, "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract(pages).collect()
    assert len(got) == 4 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["page_id"]: r["n_chars"] for r in got} == {1: len(html_text.main_text(PAGE)), 2: 0, None: 5 * 60_000 - 1}
    assert html_text.extract(pages.limit(0)).count() == 0


def test_tree_fits_its_table():
    tree = html_text.grow(html_text.LABELLED)
    right = [html_text.decide(tree, row[:-1]) == row[-1] for row in html_text.LABELLED]
    assert np.mean(right) > 0.97
