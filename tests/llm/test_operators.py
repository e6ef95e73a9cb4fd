"""Small cases of every operator against plain Python, and the awkward inputs that each must bear."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from spanlake.llm import bpe, boosting, chat, components, language, licences, mixing, mtree, near_dedup, pages, quality, queries, warc

FOLDER = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, target string"
ODD = [
    (1, "a b c d e f g h i j k l", "en", "s", 1, "x", "y"), (1, "a b c d e f g h i j k l", "en", "s", 1, "x", "y"), (2, None, None, None, None, None, None),
    (3, "", "en", "s", 0, None, None), (None, "no id here at all, but words enough to stay in, I think", "en", None, 3, None, None), (4, "lang " * 30000, "de", "t", 9, "", ""),
    (5, "1234 5678 !!", None, "", 2, "", ""), (6, "　 wide", "en", "t", 1, "", ""),
]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_mixing_targets_copies_and_odd_rows(spark, odd, none):
    totals = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 0)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(mixing.ranked_weights(totals)).collect()}
    assert got["a"] == 30 and got[None] == 0 and got["b"] == pytest.approx(1980 * 2 / 5) and got["c"] == pytest.approx(1980 * 3 / 5)
    planned = mixing.plan_mix(odd)
    rows = planned.collect()
    assert len(rows) == len(ODD) and all(r.copies <= 3 for r in rows) and [r.size for r in rows if r.doc_id == 2] == [0]
    assert mixing.emit_mix(planned, ["doc_id"]).count() == sum(r.copies for r in rows)
    assert sorted(map(str, planned.collect())) == sorted(map(str, rows))
    assert mixing.plan_mix(none).count() == 0


def test_mix_comes_near_its_targets(spark):
    docs = spark.createDataFrame([(i, "w " * (1 + i % 40), f"s{i % 4}" if i % 3 else "hot") for i in range(6000)], "doc_id long, text string, source string")
    rows = mixing.plan_mix(docs).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) < 0.1 * r.target for r in rows)


def test_licences_are_found_and_inherited(spark):
    files = spark.createDataFrame(
        [("a/LICENSE", "Some words\nReleased under the MIT License.\n"), ("a/b/x.py", "code"), ("a/b/c/COPYING.txt", "Licensed under CC BY-NC 4.0."), ("a/b/c/d/y.py", None), ("a/b/c/z.py", "Licensed under the Apache License, Version 2.0."),
         ("q/w.py", "the of and under the work"), (None, "Released under the MIT License."), ("a/b/x.py", "code")], "path string, text string",
    )
    rows = {r.path: r for r in licences.inherit_licences(files, licences.scan_licences(files)).collect()}
    assert {p: r.licence for p, r in rows.items()} == {"a/LICENSE": "MIT", "a/b/x.py": "MIT", "a/b/c/COPYING.txt": "CC-BY-NC-4.0", "a/b/c/d/y.py": "CC-BY-NC-4.0", "a/b/c/z.py": "Apache-2.0", "q/w.py": None}
    assert rows["a/b/x.py"].inherited_from == "a" and rows["a/b/c/d/y.py"].inherited_from == "a/b/c"
    empty = files.limit(0)
    assert licences.inherit_licences(empty, licences.scan_licences(empty)).count() == 0


def test_licences_inline_wrapped_and_in_full(spark):
    text = lambda name: max(licences.TEMPLATES[name], key=len)
    wrap = lambda said, start, n=9: "\n".join(start + " ".join(said.split()[k : k + n]) for k in range(0, len(said.split()), n))
    prose = "Plain words about boats and the weather of the coast. " * 60
    cases = {
        "inline.py": ("Copyright 2020 Jane Doe. Licensed under the MIT License.", "MIT"), "prose.md": ("Foo is released under the MIT License by the Bar authors.", "MIT"),
        "deep.md": (f"{prose}Foo is licensed under the Apache License, Version 2.0. {prose}", "Apache-2.0"), "wrapped.c": ("/*\n * Released under\n * the MIT\n * License.\n */\nint x;", "MIT"),
        "header.c": (f"/*\n{wrap(text('Apache-2.0').replace('TERMS', ''), ' * ')}\n */\nint x;", "Apache-2.0"), "gnu.py": (wrap(licences.TEMPLATES["GPL-3.0"][7], "# ", 7) + "\nx = 1", "GPL-3.0"),
        "LICENSE-mit": ("Copyright (c) 2019 Jane\n\n" + wrap(text("MIT"), ""), "MIT"), "LICENSE-bsd": ("Copyright (c) 2019, Jane\n" + wrap(text("BSD-3-Clause"), "", 12), "BSD-3-Clause"),
        "LICENSE-bsd2": (wrap(text("BSD-2-Clause"), ""), "BSD-2-Clause"), "COPYING": (wrap(text("LGPL-3.0"), "    ") + "\n" + prose, "LGPL-3.0"), "twice": ("the license the mit " * 3000 + "Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"),
        "other.md": ("Licensed under the Foo License, version 9.\nSPDX-License-Identifier: Foo-1.0", None), "prose.txt": (prose, None), "none": (None, None), "empty": ("", None),
    }
    found = {r.path: r.licence for r in licences.scan_licences(spark.createDataFrame([(p, t) for p, (t, _) in cases.items()], "path string, text string")).collect()}
    assert {p: found.get(p) for p in cases} == {p: name for p, (_, name) in cases.items()}


def test_licence_windows_equal_brute_force(spark):
    r = random.Random(3)
    templates = {"a": ["red green blue"], "b": ["green green black white pink"]}
    texts = [" ".join(r.choice("red green blue black white pink sky sea".split()) for _ in range(r.randint(1, 25))) for _ in range(60)]
    idf = {t: np.log((1 + len(texts)) / (1 + sum(t in x.split() for x in texts))) + 1 for t in {t for x in texts for t in x.split()}}
    expected = {}
    for k, text in enumerate(texts):
        w = text.split()
        for name, (template,) in templates.items():
            c = Counter(template.split())
            for s in range(len(w)):
                n = Counter(w[s : s + len(template.split())])
                if w[s] in c:
                    norm = sum((n[t] * idf[t]) ** 2 for t in n) * sum((c[t] * idf[t]) ** 2 for t in c)
                    score = round(min(1.0, sum(c[t] * n[t] * idf[t] ** 2 for t in c) / norm**0.5), 9)
                    expected[k] = min(expected.get(k, (0, "")), (-score, name))
    got = {r.path: r for r in licences.scan_licences(spark.createDataFrame(list(enumerate(texts)), "path int, text string"), templates).collect()}
    assert set(got) == {k for k, (score, _) in expected.items() if score <= -0.6} and len(got) > 10
    assert all(r.licence == expected[k][1] and r.score == pytest.approx(-expected[k][0], abs=2e-9) for k, r in got.items())


def plain_counts(text):
    words = WORD.findall(text or "")
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    again = set()
    for i in range(len(words) - 4):
        if windows[tuple(words[i : i + 5])] > 1:
            again |= set(range(i, i + 5))
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(again)]


def test_quality_counts_equal_plain_python(spark, odd, none):
    r = random.Random(4)
    texts = ["".join(r.choice("ab é|#\n\t 中") for _ in range(r.randint(0, 300))) for _ in range(300)] + ["", None, "\n", "a\n\na", "x y z v w x y z v w", "a\nb\na"]
    import pyarrow as pa

    assert quality.text_counts(pa.array(texts))[:, :5].tolist() == [plain_counts(t) for t in texts]
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    judged = quality.judge_quality(odd, labels)
    assert judged.count() == len(ODD) and not judged.where("doc_id = 2").first().kept
    assert quality.judge_quality(none, labels.limit(0)).count() == 0
    model = quality.fit_quality(quality.document_counts(quality.labelled_sample(odd, labels)), labels)
    kept = odd.where(quality.keeps_text(model)("text")).select("doc_id")
    assert sorted(map(str, kept.collect())) == sorted(map(str, judged.where("kept").select("doc_id").collect()))
    assert quality.labelled_sample(none, labels).count() == 0 and none.where(quality.keeps_text(model)("text")).count() == 0
    assert quality.labelled_sample(odd, labels, max_rows=0).count() == 0


def test_trees_are_right_and_monotonic():
    r = np.random.default_rng(3)
    x = r.random((4000, 3))
    y = (x[:, 0] + 0.3 * r.random(4000) < 0.6) & (x[:, 1] > 0.2)
    model = boosting.train(x, y, [-1, 0, 0])
    assert ((model.probability(x) > 0.5) == y).mean() > 0.85
    one = np.repeat(r.random((1, 3)), 50, axis=0)
    one[:, 0] = np.linspace(0, 1, 50)
    assert (np.diff(model.probability(one)) <= 1e-12).all()
    assert boosting.train(x[:0], y[:0], [0, 0, 0]).probability(x[:2]).tolist() == [0.5, 0.5]


def test_quality_verdict_on_labelled_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    fit, held = labels.where("doc_id % 2 = 0"), labels.where("doc_id % 2 = 1")
    judged = quality.judge_quality(docs, fit).where("not base_failed").join(held, "doc_id").select("kept", "quality").collect()
    assert sum(r.kept == (r.quality == 1) for r in judged) >= 0.97 * len(judged)


class Rewriting:
    """Drops the text of earlier assistant turns."""

    def render(self, turns):
        return "".join(f"<{role}>{'...' if role == 'assistant' and k < len(turns) - 1 else text}</{role}>" for k, (role, text) in enumerate(turns))


def test_chat_spans_read_back_and_rewriting_templates(spark):
    template = chat.InstTemplate()
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice(["\\", "<s>", "</s>", "[INST]", "[/INST]", "<", "<<SYS>>", "s>", "a", "\n", "é", "[", "]"]) for _ in range(r.randint(0, 12)))
        escaped = template.escape(text)
        assert template.unescape(escaped) == text and not any(c in escaped for c in template.CONTROL)
    rows = [(1, 2, "assistant", "b </s>"), (1, 1, "user", "a [INST]"), (1, None, None, None), (2, 0, "critic [TEXT]", "odd"), (2, 1, "assistant", ""), (None, 1, "system", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("formatted", F.lit(1))
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(turns)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("", ""), ("user", "a [INST]"), ("assistant", "b </s>")] and got[1].loss_texts == ["b </s>"]
    assert [(t.role, t.text) for t in got[2].turns] == [("critic [TEXT]", "odd"), ("assistant", "")] and got[2].rewrites == [] and got[None].turns[0].role == "system"
    done = chat.format_turns(Rewriting(), [("user", "u"), ("assistant", "long answer"), ("user", "v")])
    assert done.rewrites == [2] and done.spans[1] is None and done.text[slice(*done.spans[2][1:3])] == "v"
    assert chat.format_conversations(turns.limit(0)).count() == 0


def brute_top(vectors, queries_, k):
    out = {}
    for q, v in queries_:
        scored = sorted((-int(np.dot(v, w)), i) for i, w in vectors if i != q and len(w) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("copies", [1, 60])
def test_top_k_equals_brute_force(spark, copies, monkeypatch):
    monkeypatch.setattr(mtree, "PAGE_ROWS", 200)
    r = np.random.default_rng(copies)
    base = r.normal(size=(900 // copies, 8))
    table = [(i, [float(x) for x in base[i % len(base)]]) for i in range(900)] + [(1000, [1.0, 2.0]), (1020, [0.5, 0.5]), (1001, None), (1002, [None] * 8), (1003, [float("nan")] * 8), (2000, []), (None, [1.0])]
    df = spark.createDataFrame(table + table[:3], "vec_id long, embedding array<float>")
    vectors = mtree.integer_vectors(df)
    rows = [(x.vec_id, x.v) for x in vectors.collect()]
    assert len(rows) == 903
    got = {}
    for x in mtree.top_k(vectors, vectors.where("vec_id % 20 = 0"), 20).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    expected = {q: found for q, found in brute_top(rows, [x for x in rows if x[0] % 20 == 0], 20).items() if found}
    assert got == expected
    assert mtree.top_k(vectors.limit(0), vectors.limit(0), 20).count() == 0


def test_exact_topk_broadcasts_pages_and_never_the_cells_of_queries(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(3000)]
    vectors = mtree.cut_lineage(mtree.integer_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")))
    monkeypatch.setattr(mtree, "PAGE_ROWS", 300)
    monkeypatch.setattr(mtree, "QUERY_BLOCK", 4)
    plans, cut = [], mtree.cut_lineage
    monkeypatch.setattr(mtree, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().sparkPlan().toString()) or cut(df))
    found = mtree.top_k(vectors, vectors.where("vec_id % 100 = 0"), 5).orderBy("query_id", "rank").collect()
    joins = [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line]
    assert joins and not any("BuildLeft" in line for line in joins)
    matrix = np.floor(np.array([v for _, v in rows]) * 64).astype(int)
    for query in range(0, 3000, 100):
        scores = matrix @ matrix[query]
        best = [i for i in np.lexsort((np.arange(3000), -scores)) if i != query][:5]
        assert [(r.vec_id, r.score) for r in found if r.query_id == query] == [(i, scores[i]) for i in best]


def test_pages_are_copied_for_more_tasks_or_many_queries_only():
    assert [mtree._lanes(*x) for x in ((1, 5, 12), (16, 222, 24), (16, 4, 12), (600, 6000, 600), (600, 0, 12))] == [1, 4, 6, 25, 25]


def test_pages_keep_the_article_only(spark):
    source = spark.createDataFrame(
        [(1, "<html><body><header><h1>Site</h1></header><nav><a href=1>Home</a></nav><div class='cookie-notice'>We use cookies.</div><main><article><h1>Title</h1><p>First  para &amp; more\nwords enough.</p><p>Two <a href=2>link</a> here.<aside>Related</aside>"
          "<section class=comments><p>Nice post, thank you so much.</p></section></article></main><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body></html>", "old"),
         (2, None, None), (3, "", ""), (4, "<<<>><p", "t"), (5, "<div>" * 5000, "t")], "page_id long, html string, text string",
    )
    rows = {r.page_id: r.text for r in pages.extract_main_text(source).collect()}
    assert rows[1] == "Title\nFirst para & more words enough.\nTwo link here." and rows[2] == rows[3] == ""
    assert pages.extract_main_text(source.limit(0)).count() == 0
    held = pages.labelled_pages(150, seed=99)
    model = pages.fit(pages.labelled_pages())
    found = pages.marginals(pages.forest([p for p, _ in held]), model)[0][:, 1] > 0.5
    assert (found == np.concatenate([y for _, y in held])).mean() > 0.95


def test_hidden_elements_end_where_they_must():
    article = "<article><h1>Title of it</h1><p>" + "Some words of the article stand here, and more of them. " * 4 + "</p>{}<p>" + "The last words of the article are these, and that is all. " * 3 + "</p></article>"
    model = pages.fit(pages.labelled_pages())
    plain = pages.main_texts([f"<html><body>{article.format('')}</body></html>"], model)[0]
    assert plain.startswith("Title of it\nSome words") and plain.endswith("that is all.")
    inside = article.format("{}")
    same = {
        "head": "<html><head><title>x</title><body>" + article.format("") + "</body></html>", "head, no body": "<html><head><title>x</title><script>'<body>'</script><meta a=b>" + article.format(""),
        **{f"unclosed {t}": f"<body>{inside.format(f'<{t}>')}</body>" for t in ("select", "button", "object", "svg", "audio", "video", "canvas", "template")},
        **{f"unclosed {t} in p": f"<body>{inside.format(f'<p><{t}>')}</body>" for t in ("select", "button", "object", "svg")}, "unclosed before": "<body><select><option>A<option>B" + article.format("") + "</body>",
        **{f"nested {t}": inside.format(f"<{t}><g><{t}><g>no</g></{t}> not this </g></{t}>") for t in ("svg", "object", "template", "button")}, "self-closing": inside.format("<svg/><svg><path/><text>no</text></svg>"),
        "block inside": inside.format("<object><div><p>no</p></div></object>"), "link inside": inside.format('<button><a href="#">no</button>'),
    }
    got = dict(zip(same, pages.main_texts(list(same.values()), model), strict=True))
    assert {k: v for k, v in got.items() if v != plain} == {}
    maths = pages.main_texts([article.format("<p>So it holds that <math><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup><annotation>tex</annotation></math> in all of the cases here.</p>")], model)[0]
    assert "So it holds that a=b2 in all of the cases here." in maths


def test_messages_equal_enumeration():
    r = np.random.default_rng(1)
    page = pages.parse("<div><p>a<p>b</div><section><div>c</div></section>")
    f = pages.forest([page])
    model = pages.Model(r.normal(size=pages.N_FEATURES), r.normal(size=(3, 2, 2)))
    n = len(f.parent)
    weights = np.zeros((n, 2))
    for code in range(2**n):
        y = [(code >> k) & 1 for k in range(n)]
        log = sum(y[k] * float(f.x[k] @ model.node) + (model.pair[f.edge[k], y[f.parent[k]], y[k]] if f.parent[k] >= 0 else 0) for k in range(n))
        for k in range(n):
            weights[k, y[k]] += np.exp(log)
    assert np.allclose(weights / weights.sum(axis=1, keepdims=True), pages.marginals(f, model)[0])


def test_pages_of_the_table_equal_their_articles(spark):
    import html

    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in pages.extract_main_text(table).collect():
        article = re.search(r"(?s)<article>(.*?)</article>", r.html)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b)


def test_warc_round_trip_in_small_splits(spark):
    r = random.Random(8)
    html = ["", "same", "same", None, "x" * 300_000, bytes(r.randrange(1, 120) for _ in range(5000)).decode(), "\x1f\x08 WARC/1.1\r\n\r\n é"]
    rows = [(i, f"http://a/{i}\n", h, 7) for i, h in enumerate(html)] + [(None, None, "same", 0), (1, "twice", "same", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, refers_to int").repartition(2)
    files = warc.write_archives(warc.mark_revisits(df))
    for split in (97, 1 << 20):
        got = warc.read_archives(spark, files, split).collect()
        expected = [(i, "response", None) for i in (0, 1, 1, 4, 5, 6)] + [(2, "revisit", 1), (3, "revisit", 0), (None, "revisit", 1)]
        assert sorted(map(str, ((x.page_id, x.record_type, x.refers_to) for x in got))) == sorted(map(str, expected))
        full = {x.page_id: x for x in got}
        assert full[3].refers_to == 0 and full[2].refers_to == 1 and full[2].payload is None and full[2].payload_bytes == 4
        assert all(bytes(full[i].payload).decode() == html[i] for i in (1, 4, 5, 6)) and full[5].payload_digest == warc.payload_digest(html[5].encode())
    assert warc.read_archives(spark, warc.write_archives(warc.mark_revisits(df.limit(0)))).count() == 0


def brute_classes(rows, k):
    sets = {}
    for i, text in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_duplicates_equal_brute_force(spark, odd, none, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    passage = [word() for _ in range(60)]
    rows = [(i, " ".join([*passage, *[word() for _ in range(r.choice([4, 8, 15, 25]))]])) for i in range(120)]  # share a passage, near the threshold
    base = [word() for _ in range(120)]
    for i in range(120, 200):
        w = base.copy()
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = word()
        rows.append((i, " ".join(w).upper() if i % 9 == 0 else " ".join(w)))
    rows += [(300, "one two"), (301, "One two"), (302, "two one"), (303, ""), (304, None), (305, " \n")]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in near_dedup.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, text string"), words=4).collect()}
    assert got == brute_classes(rows, 4)
    classes = near_dedup.near_duplicate_classes(odd).collect()
    assert len(classes) == len(ODD) and all(x.kept for x in classes if x.doc_id is None)
    assert near_dedup.drop_near_duplicates(odd).count() == len(ODD) - 1 and near_dedup.drop_near_duplicates(none).count() == 0


def test_components_of_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 99), (7, 7), (60, 61)], "u long, v long")
    got = {r.id: r.component for r in components.connected_components(links).collect()}
    assert got == {**{i: 0 for i in range(51)}, 99: 99, 100: 99, 60: 60, 61: 60}
    assert components.connected_components(links.limit(0)).count() == 0


def test_languages_held_out_and_odd(spark, odd, none):
    rows = contract.queries()["op9_language_id"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    held = rows.where("held_out").join(docs, "doc_id").collect()
    assert len(held) > 100 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in held)
    got = {r.doc_id: r for r in language.identify_language(odd, language.fit_profiles(odd)).collect()}
    assert len(got) == len({r[0] for r in ODD}) and [got[i].lang_pred for i in (2, 3, 5)] == ["und"] * 3 and got[4].lang_pred == "de"
    assert {r.lang_pred for r in language.identify_language(odd, language.fit_profiles(none)).collect()} == {"und"}
    assert language.identify_language(none, language.fit_profiles(odd)).count() == 0


def test_pipeline_language_stage_rejects_by_score_and_learns_of_no_labels(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source")
    r = random.Random(1)
    letters = "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(2000))
    bad = [(-1, "Это русский текст о погоде и море " * 20, None, "s"), (-2, letters, None, "s"), (-3, "xqzj kkkq wwvx zzpq " * 30, "en", "s"), (-4, "12 !", None, "s"), (-5, None, "en", "s"), (-6, "中文文本没有空格" * 30, None, "s")]
    both = docs.unionByName(spark.createDataFrame(bad, docs.schema))
    kept = [x.doc_id for x in corpus_pipeline.identify_languages(spark, both, FOLDER).collect()]
    assert sorted(kept) == sorted(x.doc_id for x in docs.where(F.col("text").rlike(r"\p{L}")).collect())
    unlabelled = both.withColumn("lang", F.lit(None).cast("string"))
    kept = [x.doc_id for x in corpus_pipeline.identify_languages(spark, unlabelled, FOLDER).collect()]
    assert sorted(k for k in kept if k < 0) == [-6, -3, -2, -1] and len(kept) == docs.where(F.col("text").rlike(r"\p{L}")).count() + 4


def test_long_texts_are_counted_in_runs(monkeypatch):
    text = "der die das und ist nicht " * 3000
    points = language._code_points(text)
    codes = language._code_table(np.array(sorted(map(ord, set(text) - {" "}))))[points]
    whole = language._counted(codes, np.zeros(len(codes), int))
    monkeypatch.setattr(language, "_RUN", 1000)
    parts = language._counted(codes, np.zeros(len(codes), int))
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_bpe_equals_the_public_library(spark, odd, none):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        automaton = bpe.Automaton(file.read())
    r = random.Random(6)
    texts = [r_.text for r_ in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()]
    texts += ["".join(r.choice("aab bcdeth\n'lvr.é中😀0 ") for _ in range(r.randint(0, 80))) for _ in range(1000)] + ["a" * k for k in range(130)]
    texts += ["<|endoftext|>x <|endoftext|>", "<|endoftext", "", " " * 99 + "x", "=" * 200]
    encoder, found = bpe.Encoder(automaton), []
    for k in range(0, len(texts), 300):  # words kept from one portion serve the next
        found += encoder.encode(texts[k : k + 300])
    for ids, known in zip(found, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert ids.tolist() == known.ids and automaton.decode(ids).decode("utf-8", "replace") == library.decode(known.ids, skip_special_tokens=False)
    path = queries.tokenizer_path()
    both = bpe.encode_texts(odd.withColumn("ids", F.lit(1)), path, decoded="decoded").collect()
    assert len(both) == len(ODD) and all(x.decoded == (x.text or "") for x in both)
    again = bpe.decode_ids(bpe.encode_texts(odd, path), path).collect()
    assert all(x.decoded == (x.text or "") for x in again) and bpe.encode_texts(none, path).count() == 0
    one = contract.queries()["op10_bpe"](spark, FOLDER).where("doc_id = 0").first()
    ids = library.encode(spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id = 0").first().text, add_special_tokens=False).ids
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and one.n_tokens == len(ids)


def plain_merges(word: bytes, merges: list[tuple[bytes, bytes]]) -> list[bytes]:
    parts = [bytes([b]) for b in word]
    while True:
        ranked = [(merges.index(p), i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in merges]
        if not ranked:
            return parts
        _, i = min(ranked)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


@pytest.mark.parametrize("two_ways", [False, True])
def test_bpe_of_random_merge_lists(two_ways):
    """Gadgets against merging by rank, on small alphabets where arcs are cut and inherited in every order."""
    import json

    r = random.Random(two_ways)
    spelled = bpe._byte_characters()
    for _ in range(40):
        tokens, merges = [b"a", b"b", b"c"], []
        while len(merges) < r.randint(1, 25):
            pair = (r.choice(tokens), r.choice(tokens))
            if pair not in merges and (two_ways or pair[0] + pair[1] not in tokens) and len(pair[0] + pair[1]) < 12:
                merges.append(pair)
                tokens.append(pair[0] + pair[1])
        say = lambda t: "".join(spelled[b] for b in t)
        vocab = {say(t): i for i, t in enumerate(dict.fromkeys([bytes([b]) for b in range(256)] + tokens))}
        definition = json.dumps({"pre_tokenizer": {"type": "ByteLevel", "use_regex": False}, "model": {"vocab": vocab, "merges": [[say(a), say(b)] for a, b in merges]}})
        automaton = bpe.Automaton(definition)
        words = ["".join(r.choice("abc") for _ in range(r.randint(1, 30))) for _ in range(60)]
        for word, ids in zip(words, bpe.Encoder(automaton).encode(words), strict=True):
            assert ids.tolist() == [vocab[say(t)] for t in plain_merges(word.encode(), merges)], (word, merges)


def test_bpe_keeps_columns_of_any_name(spark):
    docs = spark.createDataFrame([(1, "ab c", "mine", 7, "x.y")], "doc_id long, text string, row string, _encoded long, `a.b` string")
    one = bpe.encode_texts(docs, queries.tokenizer_path(), decoded="back").first()
    assert (one.row, one._encoded, one["a.b"], one.back) == ("mine", 7, "x.y", "ab c")


def canonical(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", ["op1_source_mix", "op4_chat_format", "op5_exact_topk", "op7_warc", "op8_near_dedup", "op11_ranked_search"])
def test_query_equals_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = contract.queries()[name](spark, FOLDER)
    answer = con.execute(contract.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    order = [columns.index(c) for c in df.columns]
    assert sorted(str([canonical(v) for v in r]) for r in df.collect()) == sorted(str([canonical(r[i]) for i in order]) for r in answer.fetchall())


def test_pipeline_keeps_columns_of_any_name(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ["size", "source_size", "target", "rate", "copies", "_copy", "_source", "_total", "_lang", "_score", "found", "score", "whole", "row", "key", "_kept_id", "component_id", "a.b"]
    clashing = docs.withColumns({n: F.concat(F.lit(f"{n} of "), F.col("doc_id")) for n in names if n != "a.b"}).withColumnRenamed("n_chars", "a.b")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, clashing, FOLDER)
        assert kept.columns == clashing.columns, name
        rows = kept.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names if n != "a.b"), name


def test_pipeline_stages_over_awkward_documents(spark, tmp_path):
    import corpus_pipeline

    docs = spark.createDataFrame(ODD, DOCS)
    spark.read.parquet(f"{FOLDER}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    for table, name in ((docs, "odd"), (docs.limit(0), "none")):
        rows = table
        for _, stage in corpus_pipeline.STAGES:
            rows = stage(spark, rows, str(tmp_path))
            rows.write.parquet(f"{tmp_path}/{name}-{stage.__name__}")
            rows = spark.read.parquet(f"{tmp_path}/{name}-{stage.__name__}")
        assert all(r.round_trip for r in rows.collect())


def test_pipeline_equals_its_parts(spark):
    """Stage by stage against the plain rules: what stays is what each operator's own verdict says."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    found = corpus_pipeline.identify_languages(spark, docs, FOLDER)
    assert found.columns == docs.columns and found.count() == sum(any(c.isalpha() for c in r.text or "") for r in docs.collect())
    good = corpus_pipeline.apply_quality_rules(spark, found, FOLDER).collect()
    assert not any((c := plain_counts(r.text))[0] < 10 or 100 * c[4] > 20 * c[0] for r in good)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(good, docs.schema), FOLDER).collect()
    classes = brute_classes([(r.doc_id, r.text) for r in good], 5)
    assert sorted(r.doc_id for r in kept) == sorted({c for _, c in classes.values()})
