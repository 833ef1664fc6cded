"""Quality, language model, decontamination, personal data, page text and the pipeline."""

import itertools
import math
import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from probscape.llm import decontamination, gru, html_text, lm, personal_data, quality
from probscape.llm.common import word_spans

SCHEMA = "doc_id long, text string, lang string, label int, score double, turn string, item_id string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "xx", 1, 0.5, "t", "i") for r in rows], SCHEMA)


def prose(rng, n, stem="w"):
    return " ".join(rng.choice(["the", "of", "and", *(f"{stem}{k}" for k in range(200))]) for _ in range(n))


# --- quality ---------------------------------------------------------------------------------


def test_quality(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(300):
        text = prose(rng, rng.choice([5, 30, 90])).capitalize() + "."
        if i % 4 == 0:
            text = rng.choice([text.upper() + "!!", " | ".join(text.split()), "$$$ ".join(text.split()), (text.split()[0] + " ") * 60])
        rows.append((i, text))
        labels.append((i, int(i % 4 != 0)))
    rows += [(300, None), (301, ""), (None, rows[1][1]), (302, "x" * 100_000)]
    labels = spark.createDataFrame([*labels[:200], (None, 1), (3, None), (999, 0), (1, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.quality_scores(table(spark, rows), labels).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert sum(got[i].predicted == (i % 4 != 0) for i in range(200, 300)) >= 97
    assert got[300].score == got[301].score
    kept = quality.keep_good(table(spark, rows), labels)
    assert kept.columns == table(spark, []).columns and kept.count() == sum(r.predicted for r in got.values())
    assert quality.quality_scores(table(spark, []), labels).count() == 0
    none = quality.quality_scores(table(spark, rows[:5]), labels.limit(0)).collect()
    assert all(r.predicted == 1 for r in none)


def test_ranking_follows_preferences():
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(400, quality.FEATURES))
    label = (rows[:, 3] - 0.5 * rows[:, 7] > -0.7).astype(int)
    model = quality.fit_ranking(rows, label, 20_000)
    assert ((model.scores(rows) >= quality.PASS) == (label == 1)).mean() > 0.97


def test_pair_sums_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    good, poor, w = rng.normal(size=(7, quality.FEATURES)), rng.normal(size=(4, quality.FEATURES)), rng.normal(size=quality.FEATURES) / 9
    gap = (good[:, None] - poor).reshape(-1, quality.FEATURES)
    win = 1 / (1 + np.exp(-gap @ w))
    loss, slope, bend = quality.pair_sums(good, poor, w)
    assert np.isclose(loss, -np.log(win).sum()) and np.allclose(slope, -gap.T @ (1 - win))
    assert np.allclose(bend, (gap * (win * (1 - win))[:, None]).T @ gap)


def test_quality_learns_from_every_label(spark, monkeypatch):
    """No cap on labelled rows; buckets and parts do not change what is good."""
    docs = spark.range(20_500).selectExpr("id AS doc_id", "concat(CASE WHEN id % 5 = 0 THEN '$$ ## 77 || ' ELSE 'plain words here ' END, id, ' end.') AS text")
    labels = spark.range(20_500).selectExpr("id AS doc_id", "int(id % 5 > 0) AS quality")
    monkeypatch.setattr(quality, "PART_ROWS", 50)
    model = quality.train(docs, labels)
    assert model.rows == 20_500
    found = quality.quality_scores(docs, labels, model).join(labels, "doc_id")
    assert found.where("predicted <> quality").count() < 20


# --- language model --------------------------------------------------------------------------


def test_gradients():
    rng = np.random.default_rng(0)
    w = gru.start_weights(rng.random(gru.HEAD) + 0.1, rng.random(gru.TAILS) + 1)
    w = {k: v.astype(float) + rng.normal(0, 0.1, v.shape) for k, v in w.items()}
    ids, real, h = rng.integers(0, gru.INPUTS, (4, 3)), np.ones((4, 3), bool), rng.normal(0, 0.1, (3, gru.STATE))
    real[2:, 1] = False
    _, g, _ = gru.gradients(w, ids, real, h)
    for k in w:
        i = int(np.abs(g[k]).argmax())
        flat, e = w[k].ravel(), 1e-5
        flat[i] += e
        up = gru.gradients(w, ids, real, h)[0]
        flat[i] -= 2 * e
        down = gru.gradients(w, ids, real, h)[0]
        flat[i] += e
        assert abs((up - down) / (2 * e) - g[k].ravel()[i]) < 1e-6


def test_lanes_do_not_matter():
    rng = np.random.default_rng(0)
    w = gru.start_weights(rng.random(gru.HEAD) + 0.1, rng.random(gru.TAILS) + 1)
    w["class"] += rng.normal(0, 0.2, w["class"].shape).astype(np.float32)
    docs = [rng.integers(0, gru.INPUTS, n) for n in (1, 70, 3, 200, 33, 32, 64)]
    one = [gru.score_documents(w, [d])[0] for d in docs]
    assert np.allclose(gru.score_documents(w, docs, lanes=3), one, rtol=1e-4)


def test_model_is_a_distribution():
    rng = np.random.default_rng(2)
    w = gru.start_weights(rng.random(gru.HEAD) + 0.1, rng.random(gru.TAILS) + 1)
    w = {k: v + rng.normal(0, 0.3, v.shape).astype(np.float32) for k, v in w.items()}
    h = np.repeat(rng.normal(size=(1, gru.STATE)).astype(np.float32), gru.INPUTS, axis=0)
    assert abs(np.exp(gru.predict(w, h, np.arange(gru.INPUTS)).astype(float)).sum() - 1) < 1e-4


def test_language_model(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.choice([3, 60, 200]), "ab"[i % 2])) for i in range(400)]
    rows += [(400, None), (401, ""), (None, "the of"), (402, "never seen before"), (403, "THE of \x1c"), (404, prose(rng, 3000))]
    monkeypatch.setattr(lm, "KNOWN", 150)
    held = F.col("doc_id") % 5 == 1
    got = {r.doc_id: r for r in lm.score_documents(table(spark, rows), held).collect()}
    count, tokens = Counter(), {}
    for i, t in rows:
        tokens[i] = [*(t or "").encode().lower().split(), None]
        if i is None or i % 5 != 1:
            count.update(tokens[i])
    n, v = sum(count.values()), len(count)
    for i, ts in tokens.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(t in count for t in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((count[t] + 0.5) / (n + 0.5 * (v + 1))) for t in ts))
        assert r.score < 0
    own = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)
    assert lm.score_documents(table(spark, []), held).count() == 0
    assert lm.score_documents(table(spark, [(1, "a b")]), held).count() == 1


# --- decontamination -------------------------------------------------------------------------


def edits(a, b):
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc", min_size=1, max_size=20), st.text("abc", max_size=40))
def test_bit_parallel_distance(item, text):
    assert decontamination.edit_distance(item, text)[0] == edits(item, text)


def test_pieces_climb_to_the_root():
    for n in range(1, 12):
        for chain in decontamination.ancestors(n):
            assert chain[-1] == (0, n) and chain[0][1] - chain[0][0] == 1
            assert all(a[0] >= b[0] and a[1] <= b[1] for a, b in itertools.pairwise(chain))


def test_contaminated(spark):
    rng = random.Random(6)
    items = [(k, prose(rng, 25, "q")) for k in range(12)] + [(12, None), (13, "short"), (None, prose(rng, 30)), (14, prose(rng, 25, "q"))]
    rows = []
    for i in range(80):
        text = prose(rng, 40)
        if i % 2:
            copy = list(items[rng.randrange(12)][1])
            for _ in range(rng.choice([0, 1, 5, 10, 14, 20])):
                at = rng.randrange(len(copy))
                copy[at: at + rng.randrange(2)] = rng.choice(["", "z", "zz"])
            text = f"{text}\n {''.join(copy).upper()}\t{text}"
        rows.append((i, text))
    rows += [(80, None), (81, ""), (None, items[3][1]), (82, "ab " * 40_000 + items[5][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontamination.contaminated(table(spark, rows), benchmark, pass_bytes=3000).collect()}
    want = {}
    for i, t in rows:
        for k, x in items:
            if k is None or x is None or len(x) < 30 or not t:
                continue
            item, text = decontamination.plain(x), decontamination.plain(t)
            budget = int(0.1 * len(item))
            d = 0 if item in text else edits(item, text) if len(text) < 2000 else len(item)
            if d <= budget:
                want[i, k] = d
    assert set(got) == set(want) and len(want) > 20 and all(want[k] <= e <= int(0.1 * 200) for k, e in got.items())
    clean = decontamination.clean(table(spark, rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontamination.contaminated(table(spark, []), benchmark).count() == 0
    assert decontamination.clean(table(spark, rows), benchmark.limit(0)).count() == len(rows)


# --- personal data ---------------------------------------------------------------------------


def plain_spans(text):
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m)) <= 19 and personal_data.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m)) <= 15]


_parts = st.sampled_from(["1", "2", "59", ".", "@", "-", "+", "a", "_", "%", " ", "(", ")", "é", "\n", "4111111111111111", ".com", "x@y.z", "1.2.3.4", "+1 (017) 555-7713"])


@settings(max_examples=400, deadline=None)
@given(st.lists(_parts, max_size=20))
def test_base_spans(parts):
    text = "".join(parts)
    assert [(personal_data.KINDS[k], a, b) for k, a, b in personal_data.base_spans(text)] == plain_spans(text)


def test_personal_data(spark):
    rng = random.Random(8)
    rows = []
    for i in range(120):
        text = prose(rng, 20)
        if i % 2:
            text += rng.choice([" mail to jo.do@mail.example.com now", " +1 (017) 555-7713 x", " ip 10.2.33.4 ok", " é 4111 1111 1111 1111 end", ' token = "04dbebab91ab85687d33eeaaf9ac699e"'])
        rows.append((i, text))
    rows += [(120, None), (121, ""), (None, "a@b.co"), (122, "1" * 90_000 + " a@b.co"), (123, "+1 (826) 555-4081 190.137.250.137")]
    found = personal_data.personal_data(table(spark, rows))
    got = {r.doc_id: r for r in personal_data.digest(found).collect()}
    for i, t in rows:
        base = plain_spans(t or "") if i != 122 else [("email", 90_001, 90_007)]
        spans = got[i].spans.split(",") if got[i].spans else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)
        assert [got[i][f"n_{k}"] for k in personal_data.KINDS[:4]] == [sum(s[0] == k for s in base) for k in personal_data.KINDS[:4]]
    assert any("secret" in r.spans for r in got.values()) and not any(got[i].spans for i in range(0, 120, 2))
    clean = {r.doc_id: r.text for r in personal_data.redact(table(spark, rows)).collect()}
    assert clean[None] == "<email>" and clean[120] is None and clean[0] == rows[0][1]
    assert personal_data.personal_data(table(spark, [])).count() == 0
    assert personal_data.digest(personal_data.personal_data(table(spark, rows[:1]))).first().spans == ""


def test_reliabilities_recover_the_truth():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.6
    votes = np.stack([np.where(rng.random(4000) < q, truth, ~truth).astype(int) for q in (0.9, 0.8, 0.75, 0.85)], axis=1)
    patterns, at, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    chance = personal_data.reliabilities(patterns, count.astype(float))
    assert ((chance[at.ravel()] > 0.5) == truth).mean() > 0.93


# --- pages -----------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav>
<div id="cookie-notice"><p>We use cookies for a better site, as everyone does.</p></div>
%s<h1>Title &amp; more</h1><p><b>First   line<br><p>A long paragraph with <a href="x">a link</a> and many more words than that.</p>
<div class="ad-box">Buy now!</div><p>Short.<form><label>Mail</label><input></form><p>Last one&#33;</p>%s
<section class="comments"><p>A reader says that this was a very fine article to read.</p></section>
<aside>Other things to read here today</aside><footer>&copy; Site</footer>"""
TEXT = "Title & more\nFirst line\nA long paragraph with a link and many more words than that.\nShort.\nLast one!"


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main><div class='post'>", "</div></main>")])
def test_main_text(around):
    assert html_text.main_text(PAGE % around) == TEXT


def test_odd_pages_end(spark):
    odd = ["", "<", "<p", "<!--", "<script>a", "<a " * 20_000, '<a "' * 20_000, "<div>" * 20_000 + "</x>" * 20_000, "<p>" + "word " * 50_000, "&#x110000; &bogus;"]
    rows = [(i, "u", h, 1) for i, h in enumerate([PAGE % ("<article>", "</article>"), None, *odd])] + [(None, None, "<article><p>x", 1)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and got[0].text == TEXT and got[1].text == "" and got[-1].text == "x"
    assert all(r.n_chars == len(r.text) for r in got)


def test_tree_fits_its_table():
    rows = html_text.LABELLED
    assert np.mean([html_text.decide(html_text.TREE, r[:-1]) == r[-1] for r in rows]) > 0.98


def test_every_token_trains_the_net(spark, monkeypatch):
    rows = [(1, " ".join(f"w{k % 90}" for k in range(5000))), (2, "a b"), (3, None), (6, "w1 " * 1024)]
    seen = []

    def train(stages, runs, weights, tokens):
        ids = [np.frombuffer(r[0], np.int16) for r in runs.select("ids").collect()]
        seen.extend([sum(map(len, ids)), gru.train(weights, sorted(ids, key=len), 0.01)[1]])
        return weights

    monkeypatch.setattr(lm, "train_model", train)
    got = lm.score_documents(table(spark, rows), F.lit(False)).collect()
    assert seen == [got[0].train_tokens] * 2 == [5001 + 3 + 1 + 1025] * 2


@pytest.mark.parametrize("quote", ["\"", "'"])
def test_long_quoted_attributes_stay_in_their_tag(quote):
    for size in (10, 3000, 5000, 200_000):
        value = "a > b <p>leaked words</p> " * (size // 26 + 1)
        assert html_text.main_text(PAGE % (f"<article><div data-x={quote}{value}{quote}>", "</div></article>")) == TEXT
    for page in ("<a " * 100_000 + "\">\"", "<a \"" * 100_000 + ">\"'", "<a '\"" * 100_000 + ">'"):
        html_text.main_text(page)  # ends soon


def test_partitions_do_not_change_the_model(spark, monkeypatch):
    monkeypatch.setattr(lm, "COPY_TOKENS", 700)
    monkeypatch.setattr(lm, "FAN", 3)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{k}" for k in rng.zipf(1.3, rng.integers(1, 120)) % 400)) for i in range(150)] + [(150, "long " * 4000)]
    scores = []
    for parts in (1, 7):
        got = lm.score_documents(table(spark, rows).repartition(parts), F.col("doc_id") % 5 == 1).collect()
        scores.append({r.doc_id: (r.score, r.base_score) for r in got})
    assert scores[0].keys() == scores[1].keys() and all(np.allclose(scores[0][k], scores[1][k], rtol=1e-5) for k in scores[0])


def test_a_long_text_beside_short_ones():
    rng = np.random.default_rng(4)
    w = gru.start_weights(rng.random(gru.HEAD) + 0.1, rng.random(gru.TAILS) + 1)
    docs = [rng.integers(0, gru.INPUTS, n).astype(np.int32) for n in (200_000, *[3] * 255)]
    tracemalloc.start()
    got = gru.score_documents(w, docs)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 40 << 20 and np.isfinite(got).all()


def test_short_items_between_word_bounds(spark):
    benchmark = spark.createDataFrame([(1, "What is  it?"), (2, "Ab"), (3, " "), (4, None)], "item_id long, text string")
    rows = [(1, "so WHAT IS\nIT? yes"), (2, "somewhat is it?"), (3, "ab"), (4, "cab abs (ab)"), (5, "cabs"), (6, None), (7, "")]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.contaminated(table(spark, rows), benchmark).collect()}
    assert got == {(1, 1, 0), (3, 2, 0), (4, 2, 0)}
    assert {r.doc_id for r in decontamination.clean(table(spark, rows), benchmark).collect()} == {2, 5, 6, 7}


def test_long_secrets_are_whole(spark):
    key = "aB3" * 150
    local = "x" * 90
    text = f"token = {key} and mail {local} at host dot com"
    spans = personal_data.loose_spans(text, [])
    assert [text[a:b] for _, a, b in spans] == [f"{local} at host dot com", key]
    rows = [(i, f"password: {key}{i} is the key") for i in range(40)] + [(99, "plain words")]
    found = {r.doc_id: r for r in personal_data.digest(personal_data.personal_data(table(spark, rows))).collect()}
    assert found[0].n_secret == 1 and found[0].found and found[0].n_added == 1 and not found[99].found and found[99].n_secret == 0
    clean = {r.doc_id: r.text for r in personal_data.redact(table(spark, rows)).collect()}
    assert clean[7] == "password: <secret> is the key" and clean[99] == "plain words"


def test_a_long_text_alone_is_read_in_long_windows(monkeypatch):
    """Where few lanes are left, a window holds as many tokens as with all of them; a text costs few softmax passes."""
    rng = np.random.default_rng(4)
    w = gru.start_weights(rng.random(gru.HEAD) + 0.1, rng.random(gru.TAILS) + 1)
    w["word"] += rng.normal(0, 0.3, w["word"].shape).astype(np.float32)
    docs = [rng.integers(0, gru.INPUTS, n).astype(np.int32) for n in (20_000, *[5] * 300)]
    calls, plain = [], gru.class_of
    monkeypatch.setattr(gru, "class_of", lambda ids: calls.append(len(ids)) or plain(ids))
    got = gru.score_documents(w, docs)
    assert len(calls) <= 10 and max(calls) <= 256 * 32
    assert np.allclose(got, gru.score_documents(w, docs, lanes=1), rtol=1e-4)


def test_large_logits_do_not_overflow():
    w = gru.start_weights(np.ones(gru.HEAD), np.ones(gru.TAILS))
    w["class"][:, 0] += 60
    h = np.ones((3, gru.STATE), np.float32)
    found = gru.predict(w, h, np.array([0, 1, gru.HEAD]))
    assert np.allclose(found[:2], -np.log(gru.CLASS_WORDS), atol=1e-4) and np.isclose(found[2], -60 * gru.STATE, rtol=1e-2)
    loss, g, _, _, _ = gru.sparse_gradients(w, np.zeros((2, 3), int), np.ones((2, 3), bool), h)
    assert np.isfinite(loss) and all(np.isfinite(x).all() for x in g.values())


def test_words_are_found_by_their_leading_bits():
    rng = np.random.default_rng(5)
    words = np.unique(np.concatenate((rng.integers(0, 1 << 63, 5000, dtype=np.uint64), np.arange(40, dtype=np.uint64), [np.uint64(2**64 - 1)])))
    v = lm._Vocabulary(words, np.ones(len(words), np.int64))
    asked = np.concatenate((words, words + np.uint64(1), rng.integers(0, 1 << 63, 500, dtype=np.uint64)))
    at = np.minimum(np.searchsorted(words, asked), len(words) - 1)
    assert v.most >= 40 and (v.find(asked) == np.where(words[at] == asked, at, -1)).all()


def test_words_end_at_white_space_only():
    for data in (b"", b" ", b"a", b" a\tb\x0b", bytes(range(256)), b"\x00 \xff\r\n\x0e\x08"):
        found = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0d]+", data)]
        assert found == list(zip(*(x.tolist() for x in word_spans(data)), strict=True))
