import random

import pytest
from pyspark.sql import functions as F

from petrichor.llm import decontamination, language_id, quality_rules, site_style


def test_language_id(spark, corpus, prose):
    model = language_id.learn(corpus, text_col="text", lang_col="lang")
    assert model[0] == ["de", "en", "fr"]
    got = {r["doc_id"]: r for r in language_id.identify(corpus, model).collect()}
    assert got[0]["row"] == 3 and got[0]["a.b"] == 4
    for r in got.values():
        assert 0 <= r["score"] <= 1
    assert all(got[i]["lang_pred"] == ["en", "fr", "de"][i % 3] and got[i]["score"] > 0.9 for i in range(40))
    assert all((got[i]["lang_pred"], got[i]["score"], got[i]["languages"]) == ("und", 0.0, []) for i in (60, 61, 62, 64))
    mixed = spark.createDataFrame([(1, prose("en", 60, 901) + " " + prose("de", 30, 902))], "doc_id bigint, text string")
    r = language_id.identify(mixed, model).first()
    assert r["languages"] == ["en", "de"] and r["shares"][0] == pytest.approx(2 / 3, abs=0.1)
    none = language_id.learn(corpus.limit(0), text_col="text", lang_col="lang")
    assert language_id.identify(mixed, none).first()["lang_pred"] == "und"
    assert language_id.identify(corpus.limit(0), model).count() == 0


def test_em_finds_planted_shares(prose, spark, corpus):
    import numpy as np

    _, logs = language_id.learn(corpus, text_col="text", lang_col="lang")
    texts = [prose("fr", 10 * k, 50 + k) + " " + prose("en", 100 - 10 * k, 80 + k) for k in (2, 5, 8)]
    shares = language_id.mixtures(texts, logs)
    assert np.allclose(shares[:, 2], [0.2, 0.5, 0.8], atol=0.08) and np.allclose(shares.sum(axis=1), 1)
    assert np.allclose(language_id.mixtures(texts[1:2], logs), shares[1:2])  # a text's result doesn't depend on its batch


def test_language_sets_are_the_best_and_independent(prose, spark, corpus):
    """Against EM over all sets of four languages; alone, in any batch and in any order a text has the same shares."""
    import itertools
    import random

    import numpy as np

    rng = random.Random(8)
    learned = [(prose(lang, 400, 900 + i), lang) for i, lang in enumerate(["en", "fr", "de"])]
    mixed_up = " ".join(w for pair in zip(prose("en", 400, 31).split(), prose("fr", 400, 32).split()) for w in (pair[0][:3] + pair[1][-3:],))
    learned.append((mixed_up, "xx"))  # a sibling of two others
    languages, logs = language_id.learn(spark.createDataFrame(learned, "text string, lang string"), text_col="text", lang_col="lang")
    assert len(languages) == 4
    texts = [" ".join(prose(lang, rng.randint(3, 30), 50 + i) for lang in rng.sample(["en", "fr", "de"], rng.randint(1, 3))) for i in range(60)] + [mixed_up[:200], "", "12 !"]
    whole = language_id.mixtures(texts, logs)
    for i, t in enumerate(texts):
        assert np.allclose(language_id.mixtures([t], logs)[0], whole[i], atol=1e-12)
    order = rng.sample(range(len(texts)), len(texts))
    assert np.allclose(language_id.mixtures([texts[i] for i in order], logs), whole[order], atol=1e-12)

    agree = total = 0
    for t, shares in zip(texts, whole):
        bucket, word, counts = language_id._trigrams([t])
        if not counts[0]:
            assert not shares.any()
            continue
        likely = np.array([[sum(row[b] for b, w in zip(bucket, word) if w == k) for row in logs] for k in sorted(set(word))], float)
        likely = np.maximum(np.exp(likely - likely.max(axis=1, keepdims=True)), 1e-9)
        best = None
        for k in range(1, 5):
            for own in itertools.combinations(range(4), k):
                s = np.full(k, 1 / k)
                for _ in range(8):
                    part = likely[:, own] * s
                    s = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
                value = np.log((likely[:, own] * s).sum(axis=1)).sum() - (k - 1) * 2.0 * np.log(counts[0])
                if best is None or value > best[0]:
                    best = (value, own, s)
        full = np.zeros(4)
        full[list(best[1])] = best[2]
        total += 1
        agree += bool(np.allclose(full, shares, atol=1e-6))
    assert agree >= 0.95 * total
    with pytest.raises(ValueError, match="languages"):
        language_id.learn(spark.createDataFrame(learned, "text string, lang string"), text_col="text", lang_col="lang", max_languages=3)


def test_quality(spark, prose):
    r = random.Random(4)
    rows = []
    for i in range(600):
        bad = r.random() < 0.3
        text = prose("en", 60, i).capitalize() + "."
        if bad:
            text = r.choice([" ".join(w.upper() + "!!" for w in text.split()), " | ".join(text.split()), "word " * 60, " ".join(w + "###" for w in text.split())])
        rows.append((i, text, 0 if bad else 1))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, label int").withColumn("words", F.lit("clash"))
    stats = quality_rules.statistics(F.col("text"))
    table = docs.select("doc_id", *[c.alias(k) for k, c in stats.items()])
    labels = docs.select("doc_id", F.col("label").alias("quality")).union(docs.limit(3).select("doc_id", F.lit(None).cast("int")))
    train = quality_rules.training_rows(table, labels.filter("doc_id % 3 <> 1"), id_col="doc_id", label="quality")
    model = quality_rules.fit(train, list(stats), trees=8)
    assert model.rules and all(w for _, w in model.rules)
    held = table.filter("doc_id % 3 = 1").withColumn("score", model.score()).join(docs.select("doc_id", "label"), "doc_id").collect()
    assert sum((x["score"] >= 0.5) == (x["label"] == 1) for x in held) >= 0.95 * len(held)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "x" * 200_000)], "doc_id bigint, text string").select(*[c.alias(k) for k, c in stats.items()])
    assert all(0 <= x[0] <= 1 for x in odd.select(model.score()).collect())
    assert quality_rules.fit(train.limit(0), list(stats)).rules == []
    assert odd.select(quality_rules.fit(train.filter("label = 1"), list(stats)).score().alias("s")).first()["s"] > 0.99


def test_tree_paths():
    text = """RandomForest
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     If (feature 0 <= 0.9)
      Predict: 1.0
     Else (feature 0 > 0.9)
      Predict: 0.0
"""
    a, b = ("a", True, 0.5), ("a", False, 0.5)
    assert quality_rules.tree_paths(text, ["a", "b"]) == {(a,), (a, ("b", True, 2.0)), (a, ("b", False, 2.0)), (b,), (b, ("a", True, 0.9)), (("a", False, 0.9),)}


def shingles(w, k):
    return [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]


def brute_passages(docs, items):
    import collections
    import re

    words = lambda t: re.sub(r"[\W_]+", " ", (t or "").lower()).split()
    found = collections.defaultdict(set)
    for d, text in docs:
        w = words(text)
        for i, t in items:
            v = words(t)
            k = min(5, len(v))
            own = collections.Counter(shingles(v, k)) if v else None
            starts = set(range(max(len(w) - len(v), 0) + 1)) if own and w else set()
            for p in range(len(w) if own else 0):  # windows cut by an end of the document, aligned with a shingle
                starts |= {p - o for o, g in enumerate(shingles(v, k)) if g == tuple(w[p : p + k])}
            for at in starts:
                part = collections.Counter(shingles(w[max(at, 0) : at + len(v)], k)) if at + len(v) > 0 else collections.Counter()
                if part and sum((own & part).values()) >= 0.8 * sum((own | part).values()):
                    found[d].add(i)
    return found


def test_decontamination(spark, prose):
    items = [(i, prose("en", 12 + 3 * i, 700 + i)) for i in range(8)] + [(8, "three short words"), (9, None), (10, "!!"), (10, "!!")]
    docs = []
    for i in range(30):
        text = prose("en", 40, i)
        if i % 3 == 0:
            passage = items[i % 8][1].upper().replace(" ", ", ", 1)
            text = f"{text}\n{passage}. {prose('en', 20, 90 + i)}"
        if i % 5 == 0:
            w = items[(i + 1) % 8][1].split()
            text = " ".join(w[:-1]) + " " + text  # all but its last word
        if i % 7 == 0:
            text += " Three short words"
        if i % 4 == 0:
            w = items[(i + 2) % 8][1].split()
            text += " " + " ".join(w[: len(w) // 2])  # half an item is none
        docs.append((i, text))
    docs += [(40, None), (41, ""), (None, items[3][1]), (42, items[0][1][:10])]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    df = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"item_id": F.lit(1), "window": F.lit(2)})
    want = brute_passages(docs, items)
    got = decontamination.contamination(df, bench).collect()
    assert len(got) == len(docs) and any(r["contaminated"] for r in got) and not all(r["contaminated"] for r in got)
    assert all((set(r["item_ids"]), r["n_items"], r["contaminated"]) == (want[r["doc_id"]], len(want[r["doc_id"]]), bool(want[r["doc_id"]])) for r in got)
    assert not any(r["contaminated"] for r in decontamination.contamination(df, bench.limit(0)).collect())
    assert decontamination.contamination(df.limit(0), bench).count() == 0


def test_decontamination_of_moved_parts(spark, prose):
    """Items whose parts change places, whole documents and inside others: every item-sized window counts."""
    import collections
    import re

    items = [(i, prose("en", n, 800 + i)) for i, n in enumerate((40, 50, 60, 75))] + [(4, "two two two two two two two")]
    docs = []
    for i, text in items:
        w = text.split()
        for j, at in enumerate((len(w) // 2, len(w) // 3, len(w) // 4)):
            moved = " ".join(w[at:] + w[:at])
            docs += [(100 * i + 10 * j, moved), (100 * i + 10 * j + 1, f"{prose('en', 30, i + j)} {moved} {prose('en', 20, i + j + 7)}"), (100 * i + 10 * j + 2, moved.rsplit(" ", 1)[0])]
    docs.append((900, " ".join(["two"] * 300)))
    words = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
    want = collections.defaultdict(dict)
    for d, text in docs:
        w = words(text)
        for i, t in items:
            v = words(t)
            own = collections.Counter(shingles(v, 5))
            for at in range(max(len(w) - len(v), 0) + 1):
                part = collections.Counter(shingles(w[at : at + len(v)], 5))
                same = sum((own & part).values()) / sum((own | part).values())
                if same >= 0.8:
                    want[d][i] = max(same, want[d].get(i, 0))
    assert {100 * i + 10 * j + k for i in (1, 2, 3) for j in range(3) for k in (0, 1)} <= set(want)
    got = decontamination.contamination(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    for r in got:
        assert set(r["item_ids"]) == set(want[r["doc_id"]])
        assert r["similarity"] == (pytest.approx(max(want[r["doc_id"]].values())) if want[r["doc_id"]] else None)


def test_hamming_blocks_guarantee(spark):
    r = random.Random(6)
    rows = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 16):
            b ^= 1 << bit
        rows.append(tuple(x - (1 << 64) if x >> 63 else x for x in (a, b)))
    df = spark.createDataFrame(rows, "a bigint, b bigint")
    met = df.select(F.arrays_overlap(decontamination.hamming_blocks(F.col("a"), 16), decontamination.hamming_blocks(F.col("b"), 16)).alias("m"))
    assert met.filter("NOT m").count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=/x>Menu</a></ul></nav><!-- ad --><div class="cookie-notice">We use</div>
<article><header><h1>Head &amp;  line</h1></header><p>one&nbsp;two<br>three <b>bold<p>next &lt;tag&gt; <span class="ad-box">buy</span> end
<ul><li>a<li>b</ul><form><input><p>sign</form><aside>side</aside><section id="comments"><p>first!</section>%s</article><footer>foot</footer></body>"""


def test_main_text_of_pages():
    assert site_style.main_text(PAGE % "", set()) == "Head & line\n\none two three bold\n\nnext <tag> end\n\na\n\nb"
    assert site_style.main_text("<p>no article</p><div role=navigation>x</div>tail", set()) == "no article\n\ntail"
    assert site_style.main_text("<main><p>in</main><p>out", set()) == "in"
    assert [site_style.main_text(x, set()) for x in (None, "", "<", "<p", "<script>never closed", "a < b &copy")] == ["", "", "<", "<p", "", "a < b ©"]
    assert site_style.main_text("<div>" * 3000 + "deep", set()) == "deep"


def test_site_style_tree_removes_what_repeats(spark, prose):
    box = "<div class=x9><p>Always the same words here</p></div>"
    rows = [(i, "http://one.example.org/p", PAGE % (box + f"<div class=y>{''.join(f'<p>{prose("en", 9, 40 * i + k)}</p>' for k in range(12))}</div><p>licence</p>")) for i in range(30)]
    rows += [(100 + i, "https://Two.example.org:80/", PAGE % box) for i in range(3)]
    rows += [(200, None, PAGE % box), (201, "not a url", None), (202, "http://one.example.org/e", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit("old"), "low": F.lit(0)})
    got = {r["page_id"]: r for r in site_style.extract(df).collect()}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got.values()) and got[0]["host"] == "clash"
    for i in range(30):
        assert "Always" not in got[i]["text"] and prose("en", 9, 40 * i + 11) in got[i]["text"] and got[i]["text"].endswith("licence")
    assert all("Always" in got[i]["text"] for i in (100, 101, 102, 200)) and got[201]["text"] == got[202]["text"] == ""
    assert site_style.extract(df.limit(0)).count() == 0
    assert {r["h"] for r in df.select(site_style.host_of(F.col("url")).alias("h")).collect()} == {"one.example.org", "two.example.org", ""}


def test_site_style_tree_with_much_boilerplate(spark, prose):
    """25 repeated and 3 own blocks a page: in a box, in the page's own container, and next to an article that repeats."""
    box = "<div class=x9>" + "".join(f"<p>line {k} of the same box</p>" for k in range(25)) + "</div>"
    own = lambda i: "".join(f"<p>{prose('en', 9, 5000 + 40 * i + k)}</p>" for k in range(3))
    shapes = [
        lambda i: f"<body>{box}<div class=y>{own(i)}</div></body>",
        lambda i: f"<body><div class=wrap>{box}<article>{own(i)}<div class=x8><p>and this</p></div></article>{box}</div></body>",
        lambda i: f"<body><div class=wrap>{box.replace('<div class=x9>', '').replace('</div>', '')}{own(i)}</div><div class=x8><p>and this</p></div></body>",
        lambda i: f"<body>{box}<div class=y>{own(0)}</div></body>",
    ]
    rows = [(100 * s + i, f"http://h{s}.example.org/{i}", shape(i)) for s, shape in enumerate(shapes) for i in range(30)]
    got = {r["page_id"]: r["text"] for r in site_style.extract(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()}
    texts = lambda i: "\n\n".join(prose("en", 9, 5000 + 40 * i + k) for k in range(3))
    for i in range(30):
        assert got[i] == got[100 + i] == texts(i)
        assert got[200 + i].endswith(texts(i))  # one container: its own paragraphs stay, with the lines between them
        assert got[300 + i].startswith("line 0") and got[300 + i].endswith(texts(0))  # the article itself repeats


def test_names_of_noise_are_a_prior(spark, prose):
    text = lambda page: site_style.main_text(page, set())
    assert text('<body><div class="content-sidebar-wrap"><article><p>own</article><div class=related><article><p>card</article></div></div>') == "own"
    assert text('<main><div class="content-sidebar-wrap"><article><p>own</article></div><p>beside</main>') == "own"
    assert text('<article class="post has-comments"><p>own<section class=comments><p>first!</section></article>') == "own"
    assert text("<form id=f><main><p>own</main><p>out</form>") == text('<div class="post has-comments"><p>own</div>') == "own"
    assert text("<article><p>a <math>x = 1</math> b <label>c</label> <object>d</object></article>") == "a x = 1 b c d"
    own = lambda i: "\n\n".join(prose("en", 9, 9000 + 40 * i + k) for k in range(3))
    page = lambda i: f"<body><section id=search-results><p>{own(i).replace(chr(10) * 2, '<p>')}</section><div id=search-box><p>Search here</div><div class=comments><p>{own(i + 50)}</div>"
    df = spark.createDataFrame([(i, "http://s.example.org/", page(i)) for i in range(12)], "page_id bigint, url string, html string")
    assert {r["page_id"]: r["text"] for r in site_style.extract(df).collect()} == {i: own(i) for i in range(12)}


@pytest.mark.parametrize("list_nodes", [1000, 0])
def test_site_style_tree_at_any_size(spark, prose, list_nodes):
    """A box in a section with 9 of 200 pages, on hosts of 2, 5 and 9 pages, and an odd article with an exact copy."""
    box, own = "<div class=x9><p>always the same</p></div>", lambda i: prose("en", 9, 20_000 + i)
    page = lambda i, name: f"<body><div class={name}>{box}<div class=y><p>{own(i)}</div></div></body>"
    rows = [(i, "http://big.example.org/", page(i, "rare") if i < 9 else f"<body><div class=z><p>{own(i)}</div></body>") for i in range(200)]
    rows += [(1000 * n + i, f"http://h{n}.example.org/", page(i, "few")) for n in (2, 5, 9) for i in range(n)]
    rows += [(500 + i, "http://big.example.org/", f"<body><div class=z><p>{own(300)}</div><div class=q><p>{own(301)}</div></body>") for i in range(2)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in site_style.extract(df, list_nodes=list_nodes).collect()}
    assert got == {i: own(300) + "\n\n" + own(301) if i in (500, 501) else own(i % 1000) for i, _, _ in rows}
