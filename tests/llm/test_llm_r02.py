"""Findings of round 2 on the operators for training data."""

from __future__ import annotations

import itertools
import random
import time

from lorecast.llm import names, tokens


def test_near_names_are_not_linked_pair_by_pair(spark):
    """2,048 family names that are all near each other, in one chain of edits: two million pairs, of which few are near."""
    words = ["".join(w) for w in itertools.product("ab", repeat=11)]
    df = spark.createDataFrame([(str(i), "person", f"Thomas {w}") for i, w in enumerate(words)], "entity_id string, entity_type string, canonical_name string")
    began = time.time()
    got = names.entity_classes(df).collect()
    assert time.time() - began < 60
    assert len(got) == len(words) and len({r["class"] for r in got}) == 1


def test_long_short_and_foreign_cores_are_joined_like_others(spark):
    rng = random.Random(8)
    words = {"a", "b", "ab", "é", "日本語", "日本", "本日語"}
    for size in (1, 2, 6, 7, 8, 9, 23, 24, 25, 26, 27, 28, 29, 60):
        for _ in range(3):
            word = "".join(rng.choice("abcé日") for _ in range(size))
            words.add(word)
            for _ in range(8):
                w = list(word)
                for _ in range(rng.randint(1, 3)):
                    i = rng.randrange(len(w) + 1)
                    edit = rng.randrange(3)
                    w[i : i + (edit < 2)] = [rng.choice("abcé日")] * (edit != 1)
                    if rng.random() < 0.4 and len(w) > 1:
                        i = rng.randrange(len(w) - 1)
                        w[i], w[i + 1] = w[i + 1], w[i]
                words.add("".join(w))
    words = sorted(words - {""})
    df = spark.createDataFrame([(k, w) for w in words for k in ("k", "l")], "kind string, core string")
    got = sorted((r.kind, r.a, r.b, r.d) for r in names.radius_join(df).collect())
    near = [(a, b, names.distance(a, b, 2), min(int(names.radius(len(a))), int(names.radius(len(b))))) for a, b in itertools.combinations(words, 2)]
    assert got == sorted((k, a, b, d) for a, b, d, most in near if d <= most for k in ("k", "l"))


def test_the_vocabulary_stands_in_no_plan(spark):
    """The driver keeps the descriptions of plans; with the vocabulary as a literal one of them had megabytes."""
    ranks = tokens.read_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    df = spark.createDataFrame([(1, "Hello zyxwv qqxjk"), (2, None), (3, "Hello  again")], "id long, text string")
    got = tokens.encode(df, "id", "text", ranks)
    assert len(got._jdf.queryExecution().toString()) < 100_000
    assert {r.key: len(r.ids) > 0 for r in got.collect()} == {1: True, 2: False, 3: True}
