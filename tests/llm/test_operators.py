"""Each operator against a brute-force version, and on awkward and empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from needlework.llm import (
    components, language, lz, mixing, packing, quality_model, repetition, scoring, secrets, simhash, tokens,
    url_filter,
)

from .conftest import PROSE, docs

FILE = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(FILE)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


def random_texts(seed, n=40, words=60, letters="abc"):
    rnd = random.Random(seed)
    return [" ".join("".join(rnd.choices(letters, k=rnd.randint(1, 2))) for _ in range(rnd.randint(0, words))) for _ in range(n)]


# language-model scoring


def plain_score(ids, grams, order, factor=0.4):
    """Score and number of steps back, by counts of the n-grams (as tuples) of all other texts."""
    score, backed = 0.0, 0
    ids = ["^"] * (order - 1) + ids
    total = sum(n for g, n in grams.items() if len(g) == 1 and g != ("^",))
    for at in range(order - 1, len(ids)):
        for size in range(order, 0, -1):
            gram = tuple(ids[at + 1 - size : at + 1])
            if size == 1 or grams[gram] > 0:
                below = grams[gram[:-1]] if size > 1 else total
                score += math.log(factor ** (order - size) * max(grams[gram], 1) / max(below, 1))
                backed += size < order
                break
    return score, backed


def plain_grams(ids, order):
    """Occurrences of all n-grams of up to ``order`` ids; the start counts as one id of a text."""
    padded = ["^"] * (order - 1) + ids
    found = Counter((w,) for w in ids)
    if ids:
        found["^",] += 1
        found[("^",) * (order - 1)] += order > 2
        for at in range(order - 1, len(padded)):
            found.update(tuple(padded[at + 1 - size : at + 1]) for size in range(2, order + 1))
    return found


@pytest.mark.parametrize("order", [2, 3])
@pytest.mark.parametrize("alone", [True, False])
def test_scores_equal_a_direct_count(spark, order, alone):
    texts = random_texts(1) + random_texts(1)[:3] + [None, ""]
    others = random_texts(2, 20)
    corpus = None if alone else docs(spark, others)
    found = {r["doc_id"]: r for r in scoring.score(docs(spark, texts).repartition(3), FILE, corpus, scoring.Backoff(order, bucket=64)).collect()}
    everything = Counter()
    for t in texts if alone else others:
        everything.update(plain_grams(ids_of(t), order))
    for i, t in enumerate(texts):
        rest = Counter(everything)
        if alone:
            rest.subtract(plain_grams(ids_of(t), order))
        score, backed = plain_score(ids_of(t), rest, order)
        assert found[i]["n_tokens"] == len(ids_of(t)) and found[i]["n_backoff"] == backed
        assert found[i]["log_score"] == pytest.approx(score)


def test_a_copy_tells_documents_apart(spark):
    texts = random_texts(5, 30, 60, "abcdefgh")
    rows = scoring.score(docs(spark, texts + texts[:4]), FILE).collect()
    twice = [r["mean_score"] for r in rows if (r["doc_id"] < 4 or r["doc_id"] >= 30) and r["n_tokens"] > 8]
    once = [r["mean_score"] for r in rows if 4 <= r["doc_id"] < 30 and r["n_tokens"] > 8]
    assert min(twice) > max(once)


def test_scores_of_texts_outside_the_corpus_back_off(spark):
    row = scoring.score(docs(spark, ["zebra quartz"]), FILE, docs(spark, ["the cat sat", "the cat ran"])).first()
    assert row["n_backoff"] == row["n_tokens"] and row["mean_score"] < -1


def test_scoring_codes_every_text_once(spark, tmp_path):
    """Each coding of a text leaves a file."""
    texts = ["the cat sat", "the cat ran", "", None]

    def seen(batches):
        import uuid

        for batch in batches:
            (tmp_path / uuid.uuid4().hex).write_text("")
            yield batch

    def times():
        return len(list(tmp_path.iterdir()))

    table = docs(spark, texts).coalesce(1)
    rows = table.select("doc_id", "text").mapInArrow(seen, "doc_id bigint, text string")
    sized = rows.agg(F.count("text")).collect()
    before = times()
    found = scoring.score(rows, FILE).collect()
    # once for the size of the corpus, once for its ids
    assert sized and before == 1 and times() - before == 2
    assert sorted((r.doc_id, r.n_tokens) for r in found) == [(0, 3), (1, 3), (2, 0), (3, 0)]


def test_scoring_stands_awkward_and_empty_tables(awkward, nothing):
    rows = scoring.score(awkward, FILE).collect()
    assert len(rows) == awkward.count()
    assert all(r["mean_score"] is None and r["log_score"] == 0 for r in rows if r["n_tokens"] == 0)
    assert scoring.score(nothing, FILE).count() == 0
    assert len(scoring.score(awkward, FILE, nothing).collect()) == awkward.count()


# language


def test_languages_are_told_apart_on_held_out_texts(spark):
    rnd = random.Random(5)
    sounds = {"aa": ["the", "ing", "and", "wh", "ould"], "bb": ["sch", "ung", "ei", "über", "tz"], "cc": ["ción", "que", "los", "ñ", "rr"]}
    rows = []
    for i in range(400):
        lang = sorted(sounds)[i % 3]
        text = " ".join("".join(rnd.choices(sounds[lang], k=2)) for _ in range(rnd.randint(5, 90)))
        rows.append((i, text, None if i % 17 == 0 else lang))
    rows += [(900, None, "aa"), (901, "123 !!! 45", "bb"), (None, "theing whand", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language.fit(table)
    found = {r["doc_id"]: r for r in language.identify(table, net).collect()}
    held = [r for r in rows if r[0] is not None and r[2] and r[0] < 900 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([found[i]["lang_pred"] == lang for i, _, lang in held]) > 0.95
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[None]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in found.values())
    again = language.fit(table.repartition(5))
    assert all((again.weights[k] == net.weights[k]).all() for k in net.weights)


def test_tables_equal_the_network():
    net = language.Network.fresh(language.Shape(), ["a", "b"], 3)
    windows = np.random.default_rng(1).integers(0, 256, (70, 256)).astype(np.uint8)
    best, _ = language.responses(net, windows[:, :])
    hidden = np.maximum(best + net.weights["bias"], 0)
    direct = language.softmax(hidden @ net.weights["out"] + net.weights["base"])
    # the tables leave out the last places of the narrower filters
    assert np.abs(language.Tables(net).probabilities(windows) - direct).mean() < 0.02


def test_gradients_agree_with_differences():
    net = language.Network.fresh(language.Shape(window=20, filters=3), ["a", "b", "c"], 3)
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    random_numbers = np.random.default_rng(2)
    windows, labels = random_numbers.integers(97, 103, (6, 20)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss():
        best, _ = language.responses(net, windows)
        p = language.softmax(np.maximum(best + net.weights["bias"], 0) @ net.weights["out"] + net.weights["base"])
        return -np.log(p[np.arange(6), labels]).mean()

    grads = language.gradients(net, windows, labels)
    for name, value in net.weights.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), value.shape)
        value[at] += 1e-6
        up = loss()
        value[at] -= 2e-6
        assert grads[name][at] == pytest.approx((up - loss()) / 2e-6, rel=1e-3)
        value[at] += 1e-6


def test_language_stands_awkward_and_empty_tables(awkward, nothing):
    net = language.fit(awkward)
    assert language.identify(awkward, net).count() == awkward.count()
    kept = language.keep_identified(awkward, net)
    assert kept.columns == awkward.columns and kept.where("text is null or trim(text) = ''").count() == 0
    assert language.identify(nothing, language.fit(nothing)).count() == 0
    assert {r["lang_pred"] for r in language.identify(awkward, language.fit(nothing)).collect()} == {"und"}


def test_number_signs_are_no_letters(spark):
    assert not language.has_letter("½ ² 3 Ⅷ ①".encode()) and language.has_letter("½ ª".encode()) and language.has_letter("日".encode())


def test_samples_stay_bounded_when_rows_are_equal(spark):
    rows = [(1, "the same text again", "en")] * 400 + [(i, "ein anderer Text", "de") for i in range(2, 40)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    windows, _, _ = language.sample_windows(table, language.Shape(), language.Training(rows=1000))
    assert len(windows) < 60
    labels = spark.createDataFrame([(1, 0)] * 50 + [(i, i % 2) for i in range(2, 40)], "doc_id bigint, quality int")
    collected = []
    grow = quality_model.grow
    quality_model.grow = lambda x, y, how: collected.append(len(x)) or grow(x, y, how)
    try:
        quality_model.fit(table, labels)
    finally:
        quality_model.grow = grow
    assert collected[0] < 40


@pytest.mark.parametrize("n", [1, 2, 3, 8])
def test_texts_at_even_odds_go_whatever_the_number_of_languages(spark, n, monkeypatch):
    net = language.Network.fresh(language.Shape(window=20, filters=3), [f"l{i}" for i in range(n)], 3)
    scores = [1 / n, 1.0]
    judged = lambda docs, net, keep: docs.selectExpr("*", "'l0' AS lang_pred", f"IF(doc_id = 0, {scores[0]}, {scores[1]}) AS score")
    monkeypatch.setattr(language, "identify", judged)
    kept = [r["doc_id"] for r in language.keep_identified(docs(spark, ["x", "y"]), net).collect()]
    assert kept == ([1] if n > 1 else [0, 1])


# URLs

RULES = [url_filter.Rule("allow", "org", "/"), url_filter.Rule("block", "example.org", "/en/1"), url_filter.Rule("block", "com", "/de/")]
URLS = [
    None, "", "no scheme", "http://Example.ORG/en/17?x", "https://a.example.org/en/2#t", "http://org", "http://x.com/de/", "http://x.com/de",
    "http://notexample.org/en/1", "http://ads.net/q", "http://www.ads.net?de/", "ftp://b.com/fr/://c.org/", "http://.org/", "http://ads.net.com/",
]


def test_urls_are_judged_like_one_by_one(spark):
    urls = URLS + [f"http://h{i}.x{i % 7}.net/{i}" for i in range(300)]
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id bigint, url string, rule string, host string")
    blocked = spark.createDataFrame([("ads.net",), ("x3.net",), ("h8.x1.net",)], "key string")
    found = {r["page_id"]: r for r in url_filter.judge_urls(pages, RULES, blocked).collect()}
    for i, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        rule = max(fits, key=lambda r: len(r.text), default=None)
        listed = any(host == b or host.endswith("." + b) for b in ("ads.net", "x3.net", "h8.x1.net"))
        verdict = rule.action if rule else "block" if listed else "allow"
        row = found[i]
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, rule and rule.text, verdict), u


def test_cascade_is_exact_and_needs_several_levels(spark, monkeypatch):
    universe = spark.range(4000).selectExpr("concat('k', id) AS key", "id % 5 = 0 AS listed")
    found = url_filter.cascade(universe)
    assert len(found.levels) >= 3
    assert universe.where(found.holds(universe["key"]) != universe["listed"]).count() == 0
    assert url_filter.cascade(universe.where("false")).levels == ()
    # levels of several literals
    monkeypatch.setattr(url_filter, "SEGMENT", 4)
    cut = url_filter.cascade(universe)
    assert len(cut.levels[0].segments) > 3
    assert universe.where(cut.holds(universe["key"]) != universe["listed"]).count() == 0


def test_levels_are_sized_by_the_list_not_by_the_corpus(spark):
    bits = []
    for n in (1000, 100_000):
        universe = spark.range(n).selectExpr("concat('k', id) AS key", "id < 20 AS listed")
        found = url_filter.cascade(universe)
        assert universe.where(found.holds(universe["key"]) != universe["listed"]).count() == 0
        bits.append(sum(level.bits * len(level.segments) for level in found.levels))
    assert bits[1] < 3 * bits[0]


def test_block_lists_of_hosts_and_addresses(spark):
    rows = [(i, f"http://a{i % 30}.net/{i}", "<b>" * (i % 7) + "word " * (i % 5)) for i in range(400)] + [(900, None, None), (901, "x", "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    blocked = url_filter.thin_pages(pages, share=0.2).unionByName(spark.createDataFrame([("a3.net",)], "key string"))
    listed = {r["key"] for r in blocked.collect()}
    assert len(listed) == 81
    found = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages, [], blocked).collect()}
    for i, url, _ in rows:
        host, _, path = (url or "").partition("://")[2].partition("/")
        assert found[i] == ("block" if host == "a3.net" or f"{host} /{path}" in listed else "allow")
    empty = pages.where("false")
    assert url_filter.judge_urls(empty, RULES, url_filter.hosts_with_words(empty, ("ads",))).count() == 0
    assert url_filter.thin_pages(empty).count() == 0


def test_the_thinnest_addresses_are_listed_however_many_there_are(spark):
    html = F.concat(F.repeat(F.lit("<b>"), (F.col("id") % 50 + 1).cast("int")), F.repeat(F.lit("w"), (F.col("id") % 7).cast("int")))
    pages = spark.range(100_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://a.net/"), "id").alias("url"), html.alias("html"))
    order = sorted(range(100_000), key=lambda i: (i % 7 / (3 * (i % 50 + 1) + i % 7), f"a.net /{i}"))
    found = [r["key"] for r in url_filter.thin_pages(pages).collect()]
    assert len(found) == 5000 and set(found) == {f"a.net /{i}" for i in order[:5000]}
    blocked = url_filter.judge_urls(pages, [], url_filter.thin_pages(pages)).where("verdict = 'block'")
    assert {r["page_id"] for r in blocked.select("page_id").collect()} == set(order[:5000])
    for length in (1, 99_999, 100_000):
        assert url_filter.first_rows(pages, ["page_id"], length).agg(F.max("page_id"), F.count("*")).first() == (length - 1, length)


# secrets


def entropy(window):
    return -sum(c / len(window) * math.log2(c / len(window)) for c in Counter(window).values())


def test_sliding_entropy_equals_a_fresh_count():
    rnd = random.Random(3)
    for _ in range(40):
        text = "".join(rnd.choices("abcdef0123", k=rnd.randint(0, 60)))
        marked = [False] * len(text)
        for i in range(len(text) - 19):
            if entropy(text[i : i + 20]) >= 3.0 - 1e-9:
                marked[i : i + 20] = [True] * 20
        got = [False] * len(text)
        for a, b in secrets.entropy_spans(text, 20, 3.0):
            got[a:b] = [True] * (b - a)
        assert got == marked


def test_base_spans_follow_the_patterns():
    hexa, key = "0123456789abcdef01234567", "AKIA" + "Q7" * 8
    text = f"é PassWord = 'hunter22' token: \"secret\": abcdefgh token=abc {key} {hexa} {hexa[:-1]} {key[:-1]}"
    want = []
    assign = r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    want += [(m.start(), "assign", m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    want += [(m.start(), "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    want += [(m.start(), "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    assert secrets.base_spans(text) == sorted(want, key=lambda s: (s[0], secrets.KINDS.index(s[1])))
    assert len(want) == 4 and not secrets.base_spans("toKen = abcdef123")


def test_entropy_finds_keys_and_spares_names(spark):
    key = "Zx9Kq2Lm7Rt4Vb8Nw3Yc6Hd1Pf5G"
    assert secrets.random_spans(f"see {key} here")
    for plain in ("123e4567-e89b-12d3-a456-426614174000", "some-very-long-hyphenated-name", "example_key_0123456789_abcdefghij", "a" * 50 + "1"):
        assert not secrets.random_spans(plain)
    table = docs(spark, [f"see {key} here", None, "clean text", "token = abcdef123 and token = abcdef124"])
    rows = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(table).collect()}
    assert rows == {0: "see [secret] here", 1: None, 2: "clean text", 3: "[secret] and [secret]"}


def test_allowed_parts_do_not_hide_the_keys_beside_them():
    key, uuid = "Zx9Kq2Lm7Rt4Vb8Nw3Yc6Hd1Pf5G", "123e4567-e89b-12d3-a456-426614174000"
    named = "sha256-" + hashlib.sha256(b"").hexdigest()
    rnd = random.Random(5)
    bulk = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=5000))
    split = f"{key[:14]}example{key[14:]}"
    for text in (f"example_key={key}", f"api/v1/{uuid}/{key}", f"{key}_0123456789", f"klmnopqrst-{key}", f"{named}/{key}"):
        assert key not in secrets.redacted(text, "*"), text
    left = secrets.redacted(f"{bulk}example{bulk}", "*")
    assert "example" in left and len(left) < 1000
    assert secrets.redacted(split, "*") == "*example*"
    for allowed in (uuid, named):
        assert "entropy_hex" not in {kind for _, kind, _ in secrets.random_spans(f"{allowed}/{key}")}
        assert min(start for start, _, _ in secrets.random_spans(f"{allowed}/{key}")) >= len(allowed)
    for plain in (f"api/v1/{uuid}", f"{uuid}/{uuid}", named, "0123456789abcdefghijklmnopqrst-example1"):
        assert not secrets.random_spans(plain)


def test_random_keys_of_every_alphabet_are_found():
    rnd = random.Random(11)
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for letters in (lower + "0123456789", upper + "234567", upper + "0123456789", lower + upper + "0123456789+/"):
        for size, least in ((20, 0.93), (24, 0.96), (32, 0.98)):
            keys = ["".join(rnd.choices(letters, k=size)) for _ in range(500)]
            assert sum(bool(secrets.random_spans(f"see {k} here")) for k in keys) >= least * 500, (letters, size)
    assert secrets.random_spans("see hQzKdWbXmRtYpLcVnGsJfKaE here")  # no digit


def test_names_and_prose_are_no_keys():
    plain = "getUserNameFromTable AbstractSingletonProxyFactoryBean internationalization2 The-Quick-Brown-Fox-Jumps-Over"
    plain += " /usr/local/lib/python3/site-packages CHAPTER_TWENTY_SEVEN_PART_2 " + PROSE
    assert not secrets.random_spans(plain)


def test_secrets_stand_awkward_and_empty_tables(awkward, nothing):
    rows = secrets.find_secrets(awkward).collect()
    assert len(rows) == awkward.count()
    blank = [r for r in rows if r["doc_id"] in (0, 1)]
    assert len(blank) == 2 and all(r["base_sha256"] == hashlib.sha256(b"").hexdigest() and r["spans"] == "" for r in blank)
    assert secrets.redact_secrets(awkward).columns == awkward.columns and secrets.find_secrets(nothing).count() == 0


# quality model


def test_quality_separates_held_out_texts(spark):
    rnd = random.Random(9)
    texts, labels = [], []
    for i in range(600):
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(rnd.randint(10, 80))]
        bad = i % 4 == 0
        texts.append(" ".join(w + "$#%"[rnd.randint(0, 2)] * 2 if bad else w for w in words))
        labels.append((i, 0 if bad else 1, "clash"))
    labels += [(700, None, "x"), (None, 1, "x"), (5, 1, "x")]
    table = docs(spark, texts + [None, ""])
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, text string")
    trees = quality_model.fit(table, marks)
    found = {r["doc_id"]: r for r in quality_model.score(table, trees).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([found[i]["predicted"] == (i % 4 != 0) for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values()) and len(found) == 602


def test_flat_trees_walk_like_nested_ones():
    x = np.random.default_rng(0).normal(size=(300, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = quality_model.grow(x, y, quality_model.Boosting(trees=8, least_weight=0.1))
    inner = trees.feature.shape[1]

    def walk(row):
        total = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < inner:
                node = 2 * node + (2 if row[f[node]] > t[node] else 1)
            total += leaf[node - inner]
        return 1 / (1 + math.exp(-total))

    assert np.allclose(trees.scores(x), [walk(r) for r in x])
    assert ((trees.scores(x) > 0.5) == (y > 0.5)).mean() > 0.9


def test_quality_stands_awkward_and_empty_tables(spark, awkward, nothing):
    none = spark.createDataFrame([], "doc_id bigint, quality int")
    rows = quality_model.score(awkward, quality_model.fit(awkward, none)).collect()
    assert len(rows) == awkward.count() and {r["score"] for r in rows} == {0.5}
    assert quality_model.score(nothing, quality_model.fit(nothing, none)).count() == 0


# repetition


def test_repetition_equals_comparing_all_suffixes():
    for seed in range(6):
        texts = [t.encode() for t in random_texts(seed, 8, 70, "ab"[: 1 + seed % 2])]
        found = repetition.judge(texts, repetition.Limits())
        for i, t in enumerate(texts):
            words = t.split()
            n = len(words)
            best = [0] * n
            for a in range(n):
                for b in range(a + 1, n):
                    k = 0
                    while b + k < n and words[a + k] == words[b + k]:
                        k += 1
                    best[a], best[b] = max(best[a], k), max(best[b], k)
            spans = {j for a in range(n) if best[a] >= 6 for j in range(a, a + best[a])}
            grams = Counter(tuple(words[a : a + 8]) for a in range(n - 7))
            windows = {j for a in range(n - 7) if grams[tuple(words[a : a + 8])] > 1 for j in range(a, a + 8)}
            got = [int(found[c][i]) for c in ("n_words", "n_repeat_words", "covered_words", "longest_repeat")]
            assert got == [n, len(windows), len(spans), max(best, default=0)]


def test_repetition_stands_awkward_and_empty_tables(awkward, nothing):
    rows = repetition.repetition_rules(awkward).collect()
    assert len(rows) == awkward.count()
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])
    assert repetition.repetition_rules(nothing).count() == 0
    found = repetition.judge(["a b\n \nc\na b\nc #*|é".encode()], repetition.Limits())
    assert [int(found[c][0]) for c in ("word_chars", "n_symbols", "n_dup_lines")] == [10, 3, 1]


# SimHash


def simple_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, distance=4):
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return label


def test_near_duplicates_equal_all_pairs(spark):
    rnd = random.Random(4)
    texts = random_texts(8, 60, 25)
    for t in list(texts):
        words = t.split()
        if len(words) > 5:
            words[rnd.randrange(len(words))] = "zz"
            texts.append(" ".join(words))
    texts += [None, "", "Ä B c", "Ä b C"]
    prints = [simple_fingerprint(t) for t in texts]
    want = brute_components(prints)
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs(spark, texts)).collect()}
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == want
    assert len(set(want)) < len(want)
    kept = sorted(r["doc_id"] for r in simhash.deduplicate(docs(spark, texts)).collect())
    assert kept == sorted(set(want))


@pytest.mark.parametrize("crowd", [2048, 3])
def test_links_find_every_component_even_in_crowds(spark, crowd):
    rnd = random.Random(6)
    prints = set()
    for _ in range(12):
        base = rnd.getrandbits(64)
        for _ in range(8):
            p = base
            for _ in range(rnd.randint(0, 5)):
                p ^= 1 << rnd.randrange(64)
            prints.add(p)
    prints = sorted(prints)
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fingerprint bigint")
    got = simhash.links(table, crowd=crowd)
    nodes = table.selectExpr("fingerprint AS node", "fingerprint AS doc_id")
    label = {r["node"] % (1 << 64): r["root"] for r in components.components(got, nodes).collect()}
    want = brute_components(prints)
    groups, found = defaultdict(set), defaultdict(set)
    for p, w in zip(prints, want):
        groups[w].add(p)
        found[label[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_keys_longer_than_a_stretch_are_passed_through():
    keys = np.repeat(np.array([1, 2, 3], dtype=np.uint64), [5, 40, 3])
    prints = np.arange(48, dtype=np.uint64)
    batches = [(keys[i : i + 4], prints[i : i + 4]) for i in range(0, 48, 4)]
    marked = set()
    for child, root in simhash.compare(iter(batches), 4, crowd=10, most=8):
        marked |= {int(a) for a, b in zip(child, root) if a == b}
    assert marked == set(range(5, 45))


def test_long_chains_become_one_component(spark):
    chain = spark.range(1, 200).selectExpr("id AS a", "id - 1 AS b")
    nodes = spark.range(0, 205).selectExpr("id AS node", "id + 1000 AS doc_id")
    rows = {r["node"]: r["label"] for r in components.components(chain, nodes).collect()}
    assert {rows[i] for i in range(200)} == {1000} and rows[204] == 1204


def test_simhash_stands_awkward_and_empty_tables(awkward, nothing):
    rows = simhash.near_duplicates(awkward).collect()
    assert len(rows) == awkward.count() and all(r["component_id"] is not None for r in rows)
    kept = simhash.deduplicate(awkward)
    assert kept.columns == awkward.columns and kept.where("doc_id = 3 and text like 'The quick%'").count() == 1
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.deduplicate(nothing).count() == 0


# Lempel-Ziv


def simple_phrases(text):
    seen, phrase = set(), ""
    for c in text:
        phrase += c
        if phrase not in seen:
            seen.add(phrase)
            phrase = ""
    return seen


def test_phrases_equal_a_plain_parse():
    for text in random_texts(11, 20, 80) + ["", "a", "aaaaaaaaaaaa", "😀é😀é😀é"]:
        ends = []
        lz.parse(text, 0, {}, ends)
        seen = {text[a:b] for a, b in zip([0, *ends], ends)}
        assert seen == simple_phrases(text) and len(ends) == len(seen)
        edited = lz.edited_text(text, "xyz abc " * 30)
        own, other = lz.both_fingerprints(text, edited, len(text) - len(text) // 2)
        assert (own == lz.fingerprint(text)).all() and (other == lz.fingerprint(edited)).all()


def test_likeness_is_exact_for_short_texts():
    a, b = "abcabcabdabe", "abcabcxyzxyz"
    pa, pb = simple_phrases(a), simple_phrases(b)
    assert lz.likeness(lz.fingerprint(a), lz.fingerprint(b)) == pytest.approx(len(pa & pb) / len(pa | pb))


def test_every_document_meets_the_next_one(spark):
    texts = random_texts(13, 150, 30) + [None, ""]
    order = list(range(len(texts)))
    random.Random(2).shuffle(order)
    table = spark.createDataFrame([(3 * i - 40, texts[i], "x") for i in order], "doc_id bigint, text string, range string").repartition(5)
    rows = {r["doc_id"]: r for r in lz.fingerprint_with_next(table).collect()}
    for i, t in enumerate(texts):
        own, following = t or "", texts[(i + 1) % len(texts)] or ""
        edited = own[: len(own) - len(own) // 2] + following[: len(own) // 2]
        row = rows[3 * i - 40]
        assert row["n_chars"] == len(own) and row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == lz.as_text(lz.fingerprint(own))
        assert row["near_edited"] == lz.likeness(lz.fingerprint(own), lz.fingerprint(edited))
        assert row["near_next"] == lz.likeness(lz.fingerprint(own), lz.fingerprint(following))


def test_rows_that_share_an_id_are_cut_apart_and_lose_no_neighbour(spark):
    texts = [f"text {i} {'ab' * (i % 7)}" for i in range(900)]
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, t) for i, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    placed = lz.with_neighbours(table)
    sizes = [r["count"] for r in placed.groupBy("range").count().collect()]
    assert max(sizes) < 90
    ordered = table.selectExpr("doc_id", "text", "xxhash64(text) AS tie").orderBy("doc_id", "tie").collect()
    want = Counter()
    for r, following in zip(ordered, ordered[1:] + ordered[:1]):
        edited = lz.edited_text(r["text"], following["text"])
        want[r["doc_id"], hashlib.sha256(edited.encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in lz.fingerprint_with_next(table).collect()) == want


def test_lz_stands_awkward_and_empty_tables(spark, awkward, nothing):
    assert lz.fingerprint_with_next(awkward).count() == awkward.count()
    assert lz.fingerprint_with_next(nothing).count() == 0
    assert lz.fingerprint_with_next(docs(spark, ["only one"])).first()["near_next"] == 1.0


# packing


def unpacked(rows, texts, end=2, window=4096):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for doc_id, text in texts.items():
        ids = np.array([*ids_of(text), end], dtype="<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    padding = total = 0
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= window
        total += at
        padding += 0 if at & (at - 1) == 0 else window - at
    return padding / max(total, 1)


def test_pieces_give_back_every_id_with_little_padding(spark):
    rnd = random.Random(1)
    texts = [PROSE * rnd.randint(0, 60) for _ in range(120)] + [None, "", "<|endoftext|> a<|endoftext|>b", "Äé### x y ΣΑΣ it's", "x" * 9000]
    rows = packing.pack(docs(spark, texts).repartition(3), FILE).collect()
    assert unpacked(rows, dict(enumerate(texts))) < 0.01


def test_cuts_cost_no_more_than_any_others():
    rnd = random.Random(7)
    for _ in range(60):
        at = np.array(sorted({0, *rnd.sample(range(1, 60), 12), 60}))
        penalty = np.array([rnd.choice([0, 2, 9]) for _ in at])
        if np.diff(at).max() > 16:
            continue

        def cost(path):
            where = {int(p): int(q) for p, q in zip(at, penalty)}
            return sum(16 - (b - a) + where[b] for a, b in zip(path, path[1:]))

        best = {0: 0}
        for j in range(1, len(at)):
            best[j] = min(best[i] + 16 - int(at[j] - at[i]) + int(penalty[j]) for i in range(j) if at[j] - at[i] <= 16)
        path = packing.best_cuts(at, penalty, 16)
        assert path[-1] > 60 - 16 and cost(path) == min(best[j] for j in range(len(at)) if at[j] > 60 - 16)


def test_ids_equal_the_tokenizer_even_when_it_forgets():
    odd = ["É### a´. x≠ a'S. b'll!! ٣. ǅ; ²! é?", "Σas ΟΔΟΣ ΟΔΟΣ.", "A<|ENDOFTEXT|>.", "a\x1cb c\x85d 日本　語", "", "İstanbul ª º µ × ÷ ½"]
    odd += ["''s 'street '' !'s 're've it's I'LL", "“q” — it’s €5\x0b\x0c", "x" * 200 + " y", "9" * 70 + "!" * 70, "e\u0301 a\xa0b \ufb01"]
    words = tokens.TextIds(FILE, most=300)
    for t in random_texts(3, 10) + odd:
        assert words.of([t.encode()])[0].tolist() == ids_of(t), t
    assert [a.tolist() for a in words.of([t.encode() for t in odd])] == [ids_of(t) for t in odd]


def test_packing_stands_awkward_and_empty_tables(awkward, nothing):
    rows = packing.pack(awkward, FILE).collect()
    want = sum(len(ids_of(r["text"])) + 1 for r in awkward.collect())
    assert sum(r["length"] for r in rows) == want and packing.pack(nothing, FILE).count() == 0


# mixing


def water_level(sizes, weights=(1, 2, 3), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = total - sum(most * sizes[s] for s in capped)
        open_weight = sum(weight[s] for s in names if s not in capped)
        target = {s: most * sizes[s] if s in capped else free * weight[s] / open_weight for s in names}
        over = {s for s in names if target[s] > most * sizes[s]} - capped
        if not over:
            return target
        capped |= over


def test_targets_and_copies(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(3000):
        source = rnd.choice(["a"] * 6 + ["b", "c", None, "É", "Z"])
        rows.append((i, " ".join(["w"] * rnd.randint(0, 30)), source))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mixed(table).collect()
    sizes = Counter()
    for _, text, source in rows:
        sizes[source] += len(text.split())
    want, taken = water_level(sizes), Counter()
    for r in found:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 0.02 * want[s] for s in want)
    times = Counter(r["doc_id"] for r in mixing.mix(table.repartition(7)).collect())
    assert all(times[r["doc_id"]] * r["size"] == r["taken"] for r in found)


def test_rows_that_share_an_id_or_are_equal_come_near_their_target(spark):
    rows = [(7, f"w{i} b c", "a") for i in range(900)] + [(None, f"w{i} b c", "b") for i in range(900)] + [(5, "all the same", "c")] * 900
    rows += [(i, f"w{i}", "d") for i in range(3000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    found = mixing.mixed(table).collect()
    taken, target = Counter(), {}
    for r in found:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
        assert 0 <= r["taken"] <= 3 * r["size"]
    assert all(abs(taken[s] - target[s]) < 0.04 * target[s] for s in "abcd")


def test_many_sources_are_joined_by_shuffle_with_the_same_answer(spark, monkeypatch):
    table = spark.range(400).selectExpr("id AS doc_id", "repeat('w ', cast(id % 9 AS int)) AS text", "concat('s', id % 50) AS source")
    one = sorted(map(tuple, mixing.mixed(table).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 3)
    assert sorted(map(tuple, mixing.mixed(table).collect())) == one


def test_mixing_stands_awkward_and_empty_tables(awkward, nothing):
    assert mixing.mixed(awkward).count() == awkward.count()
    assert mixing.mix(awkward).columns == awkward.columns
    assert mixing.mixed(nothing).count() == 0 and mixing.mix(nothing).count() == 0
