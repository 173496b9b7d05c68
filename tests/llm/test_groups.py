"""Prefix trie, spelling variants and n-gram join against brute force, and on awkward and empty tables."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from needlework.llm import hot, ngram_join, prefix_trie, queries, spelling

from .conftest import PROSE, docs
from .test_operators import random_texts

# prefix trie


def plain_trie(rows):
    """All nodes of the rebuilt conversations, by walking every prefix."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    members = defaultdict(list)
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members[tuple(whole[c][:d])].append(c)
    children = Counter(node[:-1] for node in members if node)
    leaves, saved = Counter(), Counter()
    for node, convs in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(convs) - 1) * len(node[-1][1].encode()) if node else 0
    for node, convs in members.items():
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        yield convs[0], len(node), parent, len(convs), children[node], leaves[node], saved[node], digest


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURNS = "conv_id bigint, turn bigint, role string, text string"


def trie_rows(df, how=prefix_trie.Trie()):
    return Counter(tuple(r) for r in prefix_trie.prefix_trie(df, how).select(*TRIE).collect())


@pytest.mark.parametrize("how", [prefix_trie.Trie(), prefix_trie.Trie(fan=2, band=3, whole=2, block=1)])
def test_trie_equals_walking_all_prefixes(spark, how):
    rnd = random.Random(4)
    rows = [(-1, 0, "u", "below zero"), (0, None, None, None), (0, 5, "a", "é"), (2, None, "", "")]
    for c in range(3, 45):
        n = rnd.choice([1, 2, 3, 5, 9, 25])
        rows += [(c, t, "u", rnd.choice("ab") if t < 5 or c % 3 else "a") for t in range(n)]
    rows += [(c, t, "u", "same") for c in range(100, 130) for t in range(3)]
    df = spark.createDataFrame(rows, TURNS).repartition(5)
    assert trie_rows(df, how) == Counter(plain_trie(rows))


def test_centroids_sum_up_every_subtree():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 7, 60, 400):
        parent = np.array([-1 if k == 0 or rnd.random() < 0.05 else rnd.integers(max(0, k - 9), k) for k in range(n)])
        depth = np.zeros(n, dtype=np.int64)
        for k in range(n):
            depth[k] = 0 if parent[k] < 0 else depth[parent[k]] + 1
        order = np.argsort(depth, kind="stable")
        place = np.argsort(order)
        parent = np.where(parent[order] < 0, -1, place[parent[order]])
        value = rnd.integers(0, 100, n)
        want = value.copy()
        for k in range(n - 1, 0, -1):
            if parent[k] >= 0:
                want[parent[k]] += want[k]
        assert (prefix_trie.centroid_rollup(parent, depth[order], [value])[0] == want).all()


def test_trie_stands_awkward_and_empty_tables(spark):
    fields = TURNS + ", depth string, n int, h1 double"
    rows = [(1, 0, "u", "x" * 100_000), (1, 0, "u", "x" * 100_000), (1, None, None, None), (None, 1, "u", "lost"), (6, 0, "u", "y"), (6, 0, "u", "y")]
    df = spark.createDataFrame([(*r, None, 3, 0.5) for r in rows], fields)
    assert trie_rows(df) == Counter(plain_trie(rows))
    assert not trie_rows(spark.createDataFrame([], fields))


# spelling variants


def plain_spelling(rows, how=spelling.Spelling()):
    found = Counter()
    small = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(small)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % how.drop == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= how.shortest:
                found[run] += 1
    n = {w: k for w, k in found.items() if k >= how.least}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    close = {w: [v for v in n if v != w and near(v, w)] for w in n}
    best = {w: min(vs, key=lambda v: (-n[v], v)) for w, vs in close.items() if vs}
    form = {w: v for w, v in best.items() if n[v] >= how.ratio * n[w]}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        yield w, form.get(w), root, n[w], len(close[w]), n.get(form.get(w))


SPELLING = ["word", "form", "root", "n", "n_near", "form_n"]


def test_variants_equal_all_pairs_of_words(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choices("abé", k=rnd.randint(5, 11))) for _ in range(25)] + ["ÀÉabcdefg", "abcdefgh" * 9]

    def word():
        w = rnd.choice(base[: 1 + int(len(base) * rnd.random() ** 3)])
        if rnd.random() < 0.4:
            k = rnd.randrange(len(w))
            w = w[:k] + rnd.choice(["", "a", "b", w[k] + "a"]) + w[k + 1 :]
        return w.upper() if rnd.random() < 0.1 and w.isascii() else w

    rows = [(i if i % 9 else None, " ".join(word() for _ in range(60)) + "×÷ x,y") for i in range(60)]
    how = spelling.Spelling(shortest=5, ratio=3, drop=7)
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter(tuple(r) for r in spelling.variants(table, how).select(*SPELLING).collect())
    want = Counter(plain_spelling(rows, how))
    assert got == want and any(r[1] and r[2] != r[1] for r in want)


def test_every_edit_has_one_zone_and_shares_its_key():
    grams = spelling.Grams(["ab", "abc", "bc"])
    for word in ("abcabca", "xabcxyabcab", "aaaaaaa", "ab"):
        own = spelling.keys_of(word, grams)
        edited = {word[:k] + c + word[k + 1 :] for k in range(len(word)) for c in "az"} | {word[:k] + c + word[k:] for k in range(len(word) + 1) for c in "az"}
        for other in edited - {word}:
            assert set(own) & set(spelling.keys_of(other, grams)), (word, other)


def test_spelling_stands_awkward_and_empty_tables(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert Counter(tuple(r) for r in spelling.variants(awkward).select(*SPELLING).collect()) == Counter(plain_spelling(rows))
    assert spelling.variants(nothing).count() == 0


# n-gram join


def plain_classes(rows, width=5, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))} if words else set())
    at = list(range(len(rows)))

    def find(k):
        while at[k] != k:
            k = at[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                at[find(a)] = find(b)
    label = {}
    for k, (doc_id, _) in enumerate(rows):
        ids = [i for i in (label.get(find(k)), doc_id) if i is not None]
        label[find(k)] = min(ids, default=None)
    for k, (doc_id, _) in enumerate(rows):
        yield doc_id, len(sets[k]), label[find(k)]


def classes(df, how=ngram_join.Join()):
    found = ngram_join.jaccard_classes(df, how).select("doc_id", "n_shingles", "component_id").collect()
    return Counter(tuple(r) for r in found)


def near_copies(rnd, n):
    """Texts with edits of others, a passage that many share, copies, and short ones."""
    passage = " ".join(rnd.choices("pqrst", k=12))
    texts = []
    for _ in range(n):
        kind = rnd.random()
        if texts and kind < 0.5:
            words = rnd.choice(texts).split()
            for _ in range(rnd.randint(0, 2)):
                if words:
                    words[rnd.randrange(len(words))] = rnd.choice("abcdefgh")
            texts.append(" ".join(words))
        elif kind < 0.6:
            texts.append(" ".join(rnd.choices("AB", k=rnd.randint(0, 4))))
        else:
            texts.append(" ".join(rnd.choices("abcdefgh", k=rnd.randint(3, 60))) + (" " + passage if kind > 0.8 else ""))
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_all_pairs(spark, seed):
    rnd = random.Random(seed)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(near_copies(rnd, 160))]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert classes(table, ngram_join.Join(bucket=64)) == Counter(plain_classes(rows))


def test_a_crowd_of_near_copies_is_one_class(spark):
    rnd = random.Random(6)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        words = list(base)
        for _ in range(2):
            words[rnd.randrange(120)] = f"x{k}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts + random_texts(9, 20)))
    assert classes(docs(spark, [t for _, t in rows])) == Counter(plain_classes(rows))


def test_join_stands_awkward_and_empty_tables(awkward, nothing):
    rows = [(r["doc_id"], r["text"]) for r in awkward.collect()]
    assert classes(awkward) == Counter(plain_classes(rows))
    assert not classes(nothing)


def test_lookup_equals_a_join_with_hot_keys(spark, monkeypatch):
    monkeypatch.setattr(hot, "SHARE", 8)
    left = spark.range(1000).selectExpr("id", "IF(id % 3 = 0, 1, id % 40) AS k", "'x' AS v2")
    counts = left.groupBy("k").count().withColumnRenamed("count", "rows")
    right = counts.selectExpr("k", "k * 2 AS v", "rows")
    got = hot.lookup(left, right, ["k"], "rows", 1000).select("id", "k", "v2", "v")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, left.join(right.drop("rows"), "k").select("id", "k", "v2", "v").collect()))


def test_registered_queries_equal_brute_force(spark, tmp_path):
    turns = [(c, t, "u", f"{c % 2} {t}") for c in range(20) for t in range(c % 4 + 1)]
    spark.createDataFrame(turns, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    rows = list(enumerate(near_copies(random.Random(3), 60) + [PROSE + "beautifull beautiful", PROSE + "beautiful"] * 12))
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")

    def found(name, columns):
        return Counter(tuple(r) for r in queries.QUERIES[name](spark, str(tmp_path)).select(*columns).collect())

    assert found("op11_prefix_trie", TRIE) == Counter(plain_trie(turns))
    assert found("op12_spelling", SPELLING) == Counter(plain_spelling(rows))
    assert found("op13_ngram_join", ["doc_id", "n_shingles", "component_id"]) == Counter(plain_classes(rows))
