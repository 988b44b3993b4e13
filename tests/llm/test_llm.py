from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecast.llm import conversations, names, neighbours, packing, personal, residue, splitting, tokens


# -- 1: most similar vectors
def vectors(spark, rows):
    return spark.createDataFrame(rows, "id string, v array<float>, id_a string")


def test_neighbours_match_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(120, 8))
    x = np.concatenate([base, base[:60] + rng.normal(size=(60, 8)) * 0.05, base[:3], base[:1], base[:1]]).astype(np.float32)
    rows = [(f"v{i:03}", [float(a) for a in v], "z") for i, v in enumerate(x)]
    bad = [("n", None, "z"), ("s", [1.0], "z"), ("z", [0.0] * 8, "z"), ("f", [float("nan")] * 8, "z"), ("i", [float("inf")] * 8, "z"), (None, rows[0][1], "z")]
    df = vectors(spark, rows + bad + rows[:5])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((unit[:, None].astype(float) - unit[None]) ** 2).sum(-1))
    np.fill_diagonal(d, 9)
    want = {}
    for i in range(len(x)):
        order = sorted(range(len(x)), key=lambda j: (round(d[i, j], 6), j))[:5]
        want[f"v{i:03}"] = [f"v{j:03}" for j in order if d[i, j] <= 0.5]
    got = {}
    for r in neighbours.most_similar(df, "id", "v", dim=8, limit=0.5, probes=8).orderBy("id_a", "rank").collect():
        got.setdefault(r.id_a, []).append(r.id_b)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items() if v}


def test_neighbours_of_nothing(spark):
    assert neighbours.most_similar(vectors(spark, []), "id", "v", dim=8, limit=0.5).count() == 0
    assert neighbours.most_similar(vectors(spark, [("a", [1.0] * 8, "z")]), "id", "v", dim=8).count() == 0


def test_a_hot_group_of_copies(spark):
    rows = [(f"c{i:02}", [1.0, 2.0, 3.0, 4.0], "z") for i in range(40)] + [("far", [-1.0, 0.0, 0.0, 0.0], "z")]
    found = neighbours.most_similar(vectors(spark, rows), "id", "v", dim=4, limit=0.1)
    assert {(r.id_a, r["count"]) for r in found.groupBy("id_a").count().collect()} == {(f"c{i:02}", 5) for i in range(40)}  # every copy has its rows
    got = neighbours.mutual(found).collect()
    assert {(r.id_a, r.id_b) for r in got} == {(f"c{i:02}", f"c{j:02}") for i in range(6) for j in range(i + 1, 6)}


def test_cells_are_split_and_overlap(spark, monkeypatch):
    """With small blocks of members and of queries the result stays that of brute force."""
    monkeypatch.setattr(neighbours, "CELL", 64)
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "ASKED", 24)
    x = np.random.default_rng(5).normal(size=(400, 8)).astype(np.float32)
    df = vectors(spark, [(f"v{i:03}", [float(a) for a in v], "z") for i, v in enumerate(x)])
    d = np.sqrt(((x[:, None].astype(float) - x[None]) ** 2).sum(-1))
    np.fill_diagonal(d, 9)
    got = {}
    for r in neighbours.most_similar(df, "id", "v", dim=8, unit=False, probes=99).collect():
        got.setdefault(r.id_a, set()).add(r.id_b)
    hits = sum(f"v{j:03}" in got[f"v{i:03}"] for i in range(400) for j in np.argsort(d[i])[:5])
    assert set(map(len, got.values())) == {5}
    assert hits >= 0.9 * 2000
    monkeypatch.setattr(neighbours, "REACH", 99.0)  # every cell is asked
    got = {(r.id_a, r.id_b) for r in neighbours.most_similar(df, "id", "v", dim=8, unit=False, probes=99).collect()}
    assert got == {(f"v{i:03}", f"v{j:03}") for i in range(400) for j in np.argsort(d[i])[:5]}


# -- 2: personal information
@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("mailto:anna.kern@example.org", [("email", "anna.kern@example.org")]),
        ("Write to anna [at] corp [dot] example today", [("email", "anna [at] corp [dot] example")]),
        ("Install @quill/indexer@64 and kb@node-a7:/srv/x", []),
        ("reach me at +44 7700 900123 or (646) 555 0156.", [("phone", "+44 7700 900123"), ("phone", "(646) 555 0156")]),
        ("The counter stood at 849 999 3997; Build 713.962.8015 runs", []),
        ("Passport X1653468 expires", [("idno", "X1653468")]),
        ("Batch 775-41-9499 replaced part no. 864-33-3354", []),
        ("Home address: 54b Quarrel Close, Westering", [("address", "54b Quarrel Close")]),
        ("Mühlenstraße 32, und calle del Molino 96", [("address", "Mühlenstraße 32"), ("address", "calle del Molino 96")]),
        ("Ask Dr. Thomas B. Varnholt or Ibrahim Keller", [("name", "Thomas B. Varnholt"), ("name", "Ibrahim Keller")]),
        ("Signed: Varnholt, Thomas", [("name", "Varnholt, Thomas")]),
        ("Frank Mode, Rose Ledger and Will Index are dashboards", []),
        ("", []), ("  ", []), (None, []),
    ],
)
def test_personal_items(text, want):
    assert [(k, text[a:b]) for a, b, k, _ in personal.find_items(text)] == want


def test_redaction_keeps_rows_and_the_rest(spark):
    df = spark.createDataFrame([("1", "Call +44 7700 900123 now", 1), ("1", "Call +44 7700 900123 now", 1), (None, None, 2), ("3", "", 3), ("4", "plain " * 20000, 4)], "id string, text string, score int")
    out = personal.redact(df, "id", "text", {"phone": "<PHONE>"}).collect()
    assert len(out) == 5
    assert sorted(r.text for r in out if r.text and len(r.text) < 100 and r.text) == ["Call <PHONE> now"] * 2
    assert personal.items(df, "id", "text").count() == 1
    assert personal.items(df.limit(0), "id", "text").count() == 0


def test_validators():
    assert personal.luhn("4539578763621486")
    assert not personal.luhn("4539578763621487")
    assert personal.mod97("255081416802538") and not personal.mod97("255081416802539")
    assert personal.mod97("85073003328") and not personal.mod97("85073003329")
    assert [x[2] for x in personal.find_items("12345678Z")] == ["idno"]  # the check letter confirms it without any word beside it
    assert personal.find_items("12345678A") == []


# -- 3: splitting
def pieces_of(text, largest=400, overlap=40):
    at = [0, *splitting.cuts(text, largest, overlap), len(text)]
    return [text[max(0, at[i] - overlap) if i else 0 : at[i + 1]] for i in range(len(at) - 1)], at


@pytest.mark.parametrize("text", ["word " * 500, "x" * 3000, "Satz eins. Satz zwei! " * 200, "日本語の文です。" * 300, "a\n\nb" * 700])
def test_pieces_rebuild_the_text_within_the_limit(text):
    parts, at = pieces_of(text)
    assert all(len(p) <= 400 for p in parts)
    assert "".join(text[at[i] : at[i + 1]] for i in range(len(at) - 1)) == text
    assert all(parts[i].startswith(parts[i - 1][-40:]) for i in range(1, len(parts)))


def test_an_edit_moves_neighbouring_cuts_only():
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(6000)) + "."
    edited = text[:3000] + "INSERTED WORDS " + text[3000:]
    a, b = splitting.cuts(text, 1000, 100), splitting.cuts(edited, 1000, 100)
    assert len({c + 15 for c in a} & set(b)) > 0.6 * len(a)


def test_split_oversized_cases(spark):
    long = "Ein Satz. " * 900
    df = spark.createDataFrame([("a", long, 1), ("a", long, 1), (None, long, 1), ("b", "short", 1), ("c", None, 1), ("d", "", 1), ("e", "x" * 4003, 1), ("f", "x" * 4004, 1)], "id string, text string, piece int")
    got = splitting.split_oversized(df, "id", "text", 1000, 100)
    assert {r.key for r in got.collect()} == {"a", None, "f"}
    assert got.where("key = 'a'").count() == got.where("key is null").count() > 1
    assert got.where(F.floor(F.length("text") / 4) > 1000).count() == 0
    assert splitting.split_oversized(df.limit(0), "id", "text", 1000, 100).count() == 0


# -- 4: conversations
SEGMENT = "source_id string, segment_id string, created_at timestamp, ordinal long, message_timestamp timestamp, speaker_role string, text string, faults string"


def faults_of(spark, rows, sources=("s",)):
    from datetime import datetime

    day = lambda n: None if n is None else datetime(2025, 1, 1, n)
    data = [(s, f"{s}{i}" if k is None else k, day(v), o, day(t), r, x, "z") for i, (s, k, v, o, t, r, x) in enumerate(rows)]
    seg = spark.createDataFrame(data, SEGMENT)
    src = spark.createDataFrame([(s, "conversation") for s in sources] + [("m", "markdown")], "source_id string, source_type string")
    return {r.source_id: set(r.faults) for r in conversations.verdicts(seg, src).collect()}, seg, src


@pytest.mark.parametrize(
    ("rows", "want"),
    [
        ([("s", None, 1, 0, None, " Human", "hi"), ("s", None, 1, 1, None, "BOT", "yes")], set()),
        ([], {"no_message"}),
        ([("s", None, 1, 0, None, "user", "hi")], {"no_assistant"}),
        ([("s", None, 1, 0, None, "assistant", "hi"), ("s", None, 1, 1, None, "user", "q")], {"no_reply"}),
        ([("s", None, 1, 0, None, "user", "hi"), ("s", None, 1, 2, None, "ai", "a")], {"broken_order"}),
        ([("s", None, 1, 0, None, "user", "hi"), ("s", None, 1, 0, None, "ai", "a")], {"no_reply", "broken_order"}),
        ([("s", None, 1, None, 1, "user", "hi"), ("s", None, 1, None, 2, "ai", "a")], set()),
        ([("s", None, 1, None, 1, "user", "hi"), ("s", None, 1, None, None, "ai", "a")], {"no_reply", "no_time"}),
        ([("s", None, 1, 0, None, "user", "hi"), ("s", None, 1, 1, None, "n/a", "x"), ("s", None, 1, 2, None, "ai", "a")], {"bad_role"}),
        ([("s", None, 1, 0, None, "user", "hi"), ("s", None, 1, 1, None, None, " \n"), ("s", None, 1, 2, None, "ai", "a")], set()),
        ([("s", "k", 1, 0, None, "user", "hi"), ("s", "k", 2, 0, None, "user", "edited"), ("s", None, 1, 1, None, "ai", "a")], set()),
        ([("s", "k", 1, 0, None, "user", None), ("s", None, 1, 1, None, "ai", "a")], {"no_user"}),
    ],
)
def test_verdicts(spark, rows, want):
    assert faults_of(spark, rows)[0] == {"s": want}


def test_dialogue_keeps_the_last_version_in_order(spark):
    rows = [("s", "b", 1, None, 5, "bot", "old"), ("s", "b", 2, None, 5, "bot", "new"), ("s", "a", 1, None, 3, "human", "q"), (None, "c", 1, 0, 1, "user", "x")]
    _, seg, src = faults_of(spark, rows)
    got = [(r.turn, r.role, r.text) for r in conversations.dialogues(seg, src).orderBy("turn").collect()]
    assert got == [(0, "user", "q"), (1, "assistant", "new")]


# -- 5: names
@pytest.mark.parametrize(("a", "b", "d"), [("ca", "abc", 2), ("abc", "abc", 0), ("abcd", "abdc", 1), ("", "xy", 2), ("kitten", "sitting", 3)])
def test_edit_metric(a, b, d):
    assert names.distance(a, b) == names.distance(b, a) == d


def test_edit_metric_keeps_the_triangle_inequality():
    rng = random.Random(4)
    for _ in range(300):
        x, y, z = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 6))) for _ in range(3))
        assert names.distance(x, z) <= names.distance(x, y) + names.distance(y, z)


def test_radius_join_matches_brute_force(spark):
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 11))) for _ in range(60)]
    words = set(base)
    for w in base:
        for _ in range(3):
            i = rng.randrange(len(w))
            words.add(w[:i] + rng.choice("abcdefghij") + w[i + rng.randint(0, 1) :])
    words = sorted(words)
    df = spark.createDataFrame([("k", w, "x") for w in words], "kind string, core string, pivot string")
    got = {(r.a, r.b) for r in names.radius_join(df).collect()}
    want = {(a, b) for a in words for b in words if a < b and names.distance(a, b) <= min(int(names.radius(len(a))), int(names.radius(len(b))))}
    assert got == want


def test_names_link(spark):
    rows = [
        ("1", "person", "Thomas Varnholt"), ("2", "PERSON", "Varnholt, T."), ("3", "people", "Tom Varnhotl"), ("4", "person", "Ingrid Varnholt"), ("5", "org", "Varnholt Optics Ltd."),
        ("6", "company", "The Varnholt Opti. GmbH"), ("7", "organization", "Varnholt Timber"), ("8", "place", "Thomas Varnholt"), ("9", None, "Thomas Varnholt"), ("10", "person", None),
        ("11", "person", ""), ("1", "person", "Thomas Varnholt"),
    ]
    df = spark.createDataFrame([(*r, "z") for r in rows], "entity_id string, entity_type string, canonical_name string, core string")
    by = {}
    for r in names.entity_classes(df).collect():
        by.setdefault(r["class"], set()).add(r.id)
    assert {frozenset(v) for v in by.values()} == {frozenset("123"), frozenset("4"), frozenset("56"), frozenset("7")}
    assert names.entity_classes(df.limit(0)).count() == 0


# -- 6: encoding
TEXTS = ["Hello world, it's 2025!", "", None, "  two  spaces\n\n", "日本語のテキスト", "naïve café 👩‍👩‍👧", "x" * 700, "<|endoftext|>", "Hello world, it's 2025!", "  a\tb", "İstanbul ẞ"]


def test_encoding_matches_the_library_and_decodes(spark):
    import tiktoken

    ranks = tokens.read_ranks(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken")
    lib = tiktoken.Encoding("own", pat_str=tokens.PATTERN.removeprefix("(?U)"), mergeable_ranks=ranks, special_tokens={})
    rows = [(i if i != 4 else None, t, 0) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], 0), (0, "other", 0)]
    df = spark.createDataFrame(rows, "id long, text string, ids int")
    got = tokens.encode(df, "id", "text", ranks).withColumn("back", tokens.decode(F.col("ids"), ranks)).collect()
    assert len(got) == len(rows)
    want = sorted((lib.encode_ordinary(t or ""), t or "") for _, t, _ in rows)
    assert sorted((list(r.ids), r.back) for r in got) == want
    assert tokens.encode(df.limit(0), "id", "text", ranks).count() == 0
    few = tokens.encode(df, "id", "text", ranks, frequent=2, long=6).collect()  # most words folded in place, and many of them as long ones
    assert sorted((r.key or -1, r.ids) for r in few) == sorted((r.key or -1, r.ids) for r in got)
    word = "".join(map(chr, np.random.default_rng(1).integers(97, 123, 200_000)))
    assert tokens.merge_long(word.encode(), ranks) == lib.encode_ordinary(word)


# -- 7: packing
def test_differencing_is_near_equal():
    sizes = np.array([8, 7, 6, 5, 4])
    sums = np.bincount(packing.differencing(sizes, 2), weights=sizes)
    assert sums.sum() == 30
    assert abs(sums[0] - sums[1]) <= 2


def test_packs_hold_all_items_within_capacity(spark):
    rng = random.Random(2)
    rows = [(str(i), rng.randint(0, 900), "p") for i in range(400)] + [("big", 2500, "p"), ("big", 2500, "p"), (None, 10, "p"), ("none", None, "p"), ("neg", -3, "p"), ("full", 1000, "p")]
    df = spark.createDataFrame(rows, "id string, n int, pack string")
    got = packing.pack(df, "id", "n", 1000).collect()
    assert len(got) == len(rows) + 4
    total = {}
    for r in got:
        total[r["pack"]] = total.get(r["pack"], 0) + r.size
    assert max(total.values()) <= 1000
    assert all(total[r["pack"]] == r.pack_size for r in got)
    assert sum(total.values()) == sum(max(n or 0, 0) for _, n, _ in rows)
    assert sum(total.values()) / (1000 * len(total)) > 0.9
    assert {r.key for r in got if r.piece > 0} == {"big"}
    assert packing.pack(df.limit(0), "id", "n", 1000).count() == 0


# -- 8: residue
@pytest.mark.parametrize(
    ("text", "kind"),
    [
        ("Dear {{ name }}, the import is complete.", "field"), ("Owner: [INSERT OWNER HERE]", "field"), ("Status of %DATE%: open", "field"),
        ("Your text goes here.", "filler"), ("Lorem ipsum dolor sit amet consectetur", "filler"), ("TBD", "filler"),
        ("404 Not Found", "error"), ("Fehler 404: Die angeforderte Seite wurde nicht gefunden.", "error"), ('{"status": 404, "detail": "document not found"}', "error"),
        ("Please enable JavaScript to view this page.", "script"), ("Checking your browser before you are sent on.", "script"),
        ("The prompt keeps `{{ entity_name }}` as its only variable.", None), ("prompt = '{{ question }}'.strip()", None), ("Error 500 fell from 380 to two per day.", None),
        ('In the tutorial the string "Your text goes here" is the label of an input box.', None), ("raise HTTPError(404, 'no such segment')", None), ("The release is ready.", None),
        ("cp ${SRC_DIR}/snap $HOME/kb", None), ("   ", None),
    ],
)
def test_seeding_patterns(text, kind):
    found = [k for p, fenced in residue.passages(text) if (k := residue.seeds(p, fenced))]
    assert (found[0] if found else None) == kind


def test_residue_over_rows(spark):
    good = [(i, f"Session {i}: the index was rebuilt and the recall rose to {i} percent. Nobody objected.", "k") for i in range(60)]
    bad = [(100 + i, t, "k") for i, t in enumerate(["404 Not Found", "502 Bad Gateway", "Please enable JavaScript to view this page.", "Owner: {{ name }}", "Your text goes here."] * 4)]
    edge = [(200, None, "k"), (201, "", "k"), (202, " \n", "k"), (None, "404 Not Found", "k"), (203, "fine. " * 20000, "k"), (204, "The index was rebuilt. " * 40 + "\nOwner: {{ date }}\n" + "Nobody objected. " * 9, "k")]
    df = spark.createDataFrame(good + bad + edge, "doc_id long, text string, kind string")
    got = residue.find_residue(df, "doc_id", "text").collect()
    assert {r.key for r in got} == {str(100 + i) for i in range(20)} | {None, "204"}
    assert residue.find_residue(df.limit(0), "doc_id", "text").count() == 0
    assert residue.find_residue(df.where("doc_id < 60"), "doc_id", "text").count() == 0  # nothing to learn from


def test_the_model_decides_and_not_the_patterns():
    """A form that no pattern knows is told by its words; quoted residue stays clean."""
    new = "502 Gateway Not Found"
    assert residue.seeds(new) is None
    pages = ["404 Not Found", "502 Bad Gateway", "503 Service Unavailable", "404 Page Not Found"]
    texts = pages * 20 + [f"The index of {i} was rebuilt in the night and nobody objected to it." for i in range(300)]
    rows = [e for t in texts for e in residue.examples(t)]
    scorer = residue.Scorer(residue.fit([residue.hashed(f) for f, _ in rows], np.array([s for _, s in rows])))
    assert scorer.passage(new, False) > 0
    assert scorer.passage('The index of 7 was rebuilt after "404 Not Found" and nobody objected to it.', False) < 0


def test_every_found_query_runs_on_empty_tables(spark, tmp_path):
    from pathlib import Path

    from lorecast.llm import registry

    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        df = spark.read.parquet(str(p))
        (df if p.stem in ("size_limits", "pii_types") else df.limit(0)).write.parquet(str(tmp_path / p.name))
    for name, query in registry.queries().items():
        if name.endswith("_found"):
            assert query(spark, str(tmp_path)).count() == 0, name
