"""The scan for all words of the messages, against brute force."""

import functools
import random
import re

import pytest

import __spark_entry__ as contract
from needlework.operators import anchored, matching
from needlework.plans import inputs


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd, path = random.Random(4), str(tmp_path_factory.mktemp("words"))
    words = ["".join(rnd.choices("abcdexyz", k=1 + i % 12)) for i in range(600)]
    talk = [(i, 0, "user", " ".join(rnd.choices(words, k=40)).title()) for i in range(60)]
    spark.createDataFrame(talk, "conv_id bigint, turn int, role string, text string").write.parquet(f"{path}/conversations.parquet")
    texts = [" ".join(rnd.choices(words, k=30)) for _ in range(40)] + ["", None, "zz ab " * 20_000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{path}/documents.parquet")
    return path


@pytest.mark.parametrize("rows", [anchored.BROADCAST_ROWS, 0])
def test_words_of_every_length_are_scored(spark, folder, monkeypatch, rows):
    monkeypatch.setattr(matching, "anchored_hits", functools.partial(anchored.anchored_hits, broadcast_rows=rows))
    talks = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    words = {w for r in talks for w in re.findall("[a-z]+", r.text.lower())}
    assert {len(w) for w in words} == set(range(1, 13)) and len(words) > 256
    want = {
        r.doc_id: sum(len(w) % 5 + 1 for w in words if w in (r.normalized or ""))
        for r in inputs.planted(spark, folder).collect()
    }
    found = contract.queries()["score_all_words"](spark, folder).collect()
    assert len(found) == len(want) and {r.doc_id: r.score for r in found} == want
