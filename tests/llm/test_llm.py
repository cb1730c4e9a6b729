"""Operators for training corpora: exact round trips, brute force and defined cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markerflow.llm import canonical, cues, encode, pack, queries, split, subjects

DOCS = "doc_id bigint, text string"


@pytest.fixture(scope="module")
def bpe():
    return encode.ByteBpe.load(encode.tokenizer_path())


TEXTS = [
    "", None, " ", "\n\n", "Hello world", "1\n00:00:01,000 --> 00:00:02,500\nWe're here.\n\n2\n00:00:03,000 --> 00:00:04,000\n- Ready?\n- Always.\n", "a\r\nb\r\n\r\nc  \n  d",
    "日本語のテキスト。\nもう遅いよ。", "<|endoftext|> is text", "x" * 500, "tab\there\x1c\nend z\n y", "it's 12:30:45.678, isn't it?\n\n\n  no",
]


def test_line_cache_is_exact(bpe):
    for text in TEXTS:
        assert list(np.frombuffer(bpe.encode(text), "<i4")) == bpe.bpe.encode_ordinary(text or "")


@pytest.mark.parametrize("chunk, halo", [(65_536, 1_024), (40, 12)])
def test_encoding_equals_whole_texts(spark, bpe, chunk, halo):
    rng = np.random.default_rng(0)
    letters = list("abc ABC'12:,.\n\r\t é日'sre")
    texts = TEXTS + ["".join(rng.choice(letters, size=n)) for n in (39, 41, 80, 333, 1200)] + ["y" * 300 + " " * 120 + "z"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r.ids for r in encode.encode_corpus(df, chunk_chars=chunk, halo_chars=halo).collect()}
    assert got == {i: bpe.bpe.encode_ordinary(t or "") for i, t in enumerate(texts)}
    counts = {r.doc_id: r.n_tokens for r in encode.encode_corpus(df, chunk_chars=chunk, halo_chars=halo, counts_only=True).collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    back = {r.doc_id: r.text for r in encode.decode_corpus(encode.encode_corpus(df, chunk_chars=chunk, halo_chars=halo)).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}


def test_encoding_of_null_and_repeated_ids(spark, bpe):
    a, b = "one two " * 30, "three 4 " * 40
    rows = [(None, a), (5, a), (5, a), (5, b), (6, "x"), (6, "x"), (None, None), (None, a)]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], DOCS + ", n int")
    want = sorted((str(i), k, bpe.bpe.encode_ordinary(t or "")) for k, (i, t) in enumerate(rows))
    for chunk in (60, 65_536):
        got = encode.encode_corpus(df, chunk_chars=chunk, halo_chars=20, keep=("n",)).collect()
        assert sorted((str(r.doc_id), r.n, r.ids) for r in got) == want
        counts = encode.encode_corpus(df, chunk_chars=chunk, halo_chars=20, keep=("n",), counts_only=True).collect()
        assert sorted((str(r.doc_id), r.n, r.n_tokens) for r in counts) == [(i, k, len(x)) for i, k, x in want]


def test_encoding_of_nothing(spark):
    assert encode.encode_corpus(spark.createDataFrame([], DOCS)).count() == 0


def test_closest_subset_is_optimal():
    rng = np.random.default_rng(1)
    for _ in range(60):
        items = rng.integers(1, 30, size=rng.integers(1, 9))
        room = int(rng.integers(1, 80))
        reach = {0}
        for x in items.tolist():
            reach |= {r + x for r in reach if r + x <= room}
        chosen = pack.closest_subset(np.bincount(items, minlength=room + 1), room)
        assert sum(a * n for a, n in chosen) == max(reach)
        assert all(n <= (items == a).sum() for a, n in chosen)


def test_packing(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in rng.integers(0, 60, size=400)] + [250, 100, 300]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)] + [(1000, None)], "doc_id bigint, n_tokens bigint")
    rows = pack.pack_items(df, {20: 7, 50: 8, 100: 9}, block_items=150).collect()
    assert {(r.capacity, r.container_id) for r in rows} == {(20, 7), (50, 8), (100, 9)}
    used, kind, total = {}, {}, {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.n_tokens
        assert kind.setdefault(r.container, r.capacity) == r.capacity
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
    assert all(used[c] <= kind[c] for c in used)
    assert total == {**dict(enumerate(sizes)), 1000: 0}
    assert {r.doc_id for r in rows if r.piece_no > 0} == {400, 402}
    assert sum(kind.values()) - sum(used.values()) < 0.06 * sum(kind.values())


def test_packing_of_nothing_and_of_empty_items(spark):
    schema = "doc_id bigint, n_tokens bigint"
    assert pack.pack_items(spark.createDataFrame([], schema), {10: 1}).count() == 0
    assert pack.pack_items(spark.createDataFrame([(1, 0), (1, 0), (2, None)], schema), {10: 1}).count() == 3
    kinds = spark.createDataFrame([(4, 10), (2, 10), (1, None), (3, 5)], "container_id int, capacity_tokens int")
    assert pack.container_kinds(kinds) == {10: 2, 5: 3}


def test_containers_of_many_partitions_and_of_many_pieces(spark):
    """Each container has a name of its own; names are texts, which no partition number and no number of pieces can exceed."""
    df = spark.range(0, 12_000, 1, 16).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 1_000 == 999, 25).otherwise(0).alias("n_tokens"))
    df = df.unionByName(spark.createDataFrame([(99_999, 250_007)], df.schema))
    rows = pack.pack_items(df, {10: 1}).where("n_tokens > 0")
    by_container = rows.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    assert rows.where("doc_id = 99999").count() == 25_001 and by_container.where("n > 10").count() == 0
    assert by_container.agg(F.sum("n")).first()[0] == 250_007 + 12 * 25


FRAMES = "seq_id string, frame int, vertices array<float>, ingested_at timestamp_ntz"
SETTINGS = "seq_id string, chunk_size int, chunk_overlap int, ingested_at timestamp_ntz"


def sequence(n, seed, gaps=()):
    rng = np.random.default_rng(seed)
    still, jump = rng.random(n) < 0.0, rng.random(n) < 0.02
    for k in rng.integers(0, n, size=max(n // 25, 1)):
        still[k : k + int(rng.integers(3, 9))] = True
    place, rows, frame = np.zeros((2, 3)), [], 0
    for i in range(n):
        if i:
            frame += 8 if rng.random() < 0.03 else 1
            place = place + (0.5 if jump[i] else 0.0002 * rng.random() if still[i] else 0.02 + 0.02 * rng.random())
        rows.append((frame, place.copy()))
    return rows


def brute_boundaries(rows):
    out, run = set(), []
    for (f0, p0), (f1, p1) in zip(rows, rows[1:]):
        step = np.sqrt(((np.float32(p1).astype(float) - np.float32(p0).astype(float)) ** 2).sum(axis=1))
        if f1 - f0 > 5 or step.min() > 0.25:
            out.add(f1)
        if step.max() <= 0.001:
            run.append(f1)
        else:
            out |= {run[0]} if len(run) >= 5 else set()
            run = []
    return out | ({run[0]} if len(run) >= 5 else set())


@pytest.mark.parametrize("range_frames", [4096, 16, 5])
def test_split_against_brute_force(spark, range_frames):
    data = {f"s{k}": sequence(n, k) for k, n in enumerate((1, 6, 40, 150, 90))}
    rows = [(s, f, [float(x) for x in p.ravel()], None) for s, fr in data.items() for f, p in fr]
    frames = spark.createDataFrame(rows + rows[:30], FRAMES)
    limits = {"s0": 4, "s1": None, "s2": 12, "s3": 20, "s4": 90}
    settings = spark.createDataFrame([(s, n, 3, None) for s, n in limits.items()] * 2, SETTINGS)
    got = {}
    for r in split.oversized_boundaries(frames, settings, range_frames=range_frames).collect():
        got.setdefault(r.seq_id, set()).add(r.frame)
    assert got == {s: brute_boundaries(data[s]) or {-1} for s in ("s2", "s3")}
    pieces = {}
    for r in split.split_pieces(frames, settings, range_frames=range_frames).orderBy("seq_id", "piece_no").collect():
        pieces.setdefault(r.seq_id, []).append(r)
    for s, fr in data.items():
        kept, numbers = [], [f for f, _ in fr]
        for k, r in enumerate(pieces[s]):
            own = numbers[r.start_pos : r.start_pos + r.n_frames]
            assert limits[s] is None or len(own) <= limits[s]
            assert (own[0], own[-1]) == (r.first_frame, r.last_frame)
            assert r.keep_start == (0 if k == 0 else min(3, pieces[s][k - 1].start_pos + pieces[s][k - 1].n_frames))
            kept += own[r.keep_start :]
        assert kept == numbers
    assert len(pieces["s1"]) == len(pieces["s4"]) == 1


def test_pieces_do_not_depend_on_the_size_of_tasks(spark):
    rows = [(f"s{k}", f, [float(x) for x in p.ravel()], None) for k, n in enumerate((700, 431, 64)) for f, p in sequence(n, k + 9)]
    frames = spark.createDataFrame(rows, FRAMES)
    settings = spark.createDataFrame([("s0", 11, 4, None), ("s1", 30, 29, None), ("s2", 7, 0, None)], SETTINGS)
    found = [
        sorted(map(tuple, split.split_pieces(frames, settings, range_frames=ranges, block_rows=blocks).collect()))
        for ranges, blocks in ((16, 1), (64, 40), (4_096, 100), (1_000_000, 1_000_000))
    ]
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) > 100


def test_split_odd_rows(spark):
    rows = [("a", 0, None, None), ("a", 1, [1.0, 2.0], None), ("a", 2, [0.0] * 6, None), ("a", 3, [0.0] * 6, None), (None, 1, [0.0] * 3, None), ("b", None, [0.0] * 3, None)]
    frames = spark.createDataFrame(rows, FRAMES)
    settings = spark.createDataFrame([("a", 2, 5, None)], SETTINGS)
    assert [(r.seq_id, r.frame) for r in split.oversized_boundaries(frames, settings).collect()] == [("a", -1)]
    assert sum(r.n_frames - r.keep_start for r in split.split_pieces(frames, settings).collect()) == 4
    none = spark.createDataFrame([], FRAMES)
    assert split.oversized_boundaries(none, settings).count() == split.split_pieces(none, settings).count() == 0


ENTRIES = [
    ("L_HEEL", "left heel"), ("R_HEEL", "right heel"), ("L_KNEE_OUT", "left knee, outer side"), ("R_KNEE_OUT", "right knee, outer side"), ("L_KNEE_IN", "left knee, inner side"),
    ("BROW", "forehead"), ("SACRUM", "tail bone"), ("R_TOE_BIG", "right big toe"), ("R_TOE_SMALL", "right small toe"),
]


@pytest.mark.parametrize(
    "typed, meant",
    [
        ("L_HEEL", "L_HEEL"), ("l_heel ", "L_HEEL"), ("s007:L_HEEL", "L_HEEL"), ("take 2:x : LeftHeel", "L_HEEL"), ("HEEL.r", "R_HEEL"), ("heel, right", "R_HEEL"), ("(L) KNEE OUT", "L_KNEE_OUT"),
        ("Right Knee Outer Side", "R_KNEE_OUT"), ("lkneein", "L_KNEE_IN"), ("L_КNЕЕ_IN", "L_KNEE_IN"), ("Ｒ_ＨＥＥＬ", "R_HEEL"), ("L_HÉEL_v2", "L_HEEL"), ("BR0W.001", "BROW"), ("Bdow", "BROW"),
        ("tail bone", "SACRUM"), ("R_TOE_BIG-1", "R_TOE_BIG"), ("r_to_smal", "R_TOE_SMALL"), ("HEEL", "nan"), ("*22", "nan"), ("RACKET_TIP", "nan"), ("", "nan"), ("xxx", "nan"), ("???", "nan"),
    ],
)
def test_labels_meant(typed, meant):
    assert canonical.CanonicalList(ENTRIES, label_rows()).match(typed) == meant


def label_rows():
    sides = [(a, s, "side") for s, names in queries.LABEL_SIDES.items() for a in names.split()]
    return [(a, m, "word") for a, m in queries.LABEL_WORDS.items()] + sides + [(a, None, "filler") for a in queries.LABEL_FILLERS.split()]


def plain_edits(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_edits_and_index_against_brute_force():
    rng = np.random.default_rng(8)
    words = sorted({"".join(rng.choice(list("abcd"), size=rng.integers(1, 11))) for _ in range(400)})
    index = canonical.NearIndex(words)
    for word in ["".join(rng.choice(list("abcd"), size=rng.integers(1, 11))) for _ in range(60)]:
        far = {w: plain_edits(word, w) for w in words}
        assert {w: canonical.edits(word, w, 20) for w in words} == far
        assert {w for w, d in far.items() if d <= 2} <= set(index.near(word))


class EveryName(canonical.CanonicalList):
    """The same list without its indexes: every name and every spelling is tried."""

    def _candidates(self, words):
        return set(range(len(self.variants)))


def test_matches_are_those_of_trying_every_name():
    rng = np.random.default_rng(9)
    parts = ["left", "right", "l", "r", "knee", "kneel", "hip", "hips", "toe", "out", "in", "big", "bag", "ankle", "shoulder"]
    names = sorted({" ".join(rng.choice(parts, size=rng.integers(1, 4))) for _ in range(150)})
    indexed, every = (kind([(n, None) for n in names], label_rows()) for kind in (canonical.CanonicalList, EveryName))
    every.near_spellings.near = lambda word: every.near_spellings.words
    letters = list("abcdefghijklmnopqrstuvwxyz _")
    for _ in range(600):
        typed = list(str(rng.choice(names)))
        for _ in range(int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(typed) + 1))
            typed[at : at + int(rng.integers(0, 2))] = [str(rng.choice(letters))] * int(rng.integers(0, 2))
        assert indexed.match("".join(typed)) == every.match("".join(typed)), typed


def test_mapping_keeps_rows_and_clashing_columns(spark):
    names = spark.createDataFrame(ENTRIES, "label string, description string")
    words = queries.label_words(spark)
    values = spark.createDataFrame([(1, "l heel"), (1, "l heel"), (2, None), (3, "zzz")], "label int, typed string")
    got = canonical.map_values(values, names, "typed", "meant", words=words).collect()
    assert sorted((r.label, str(r.meant)) for r in got) == [(1, "L_HEEL"), (1, "L_HEEL"), (2, "None"), (3, "nan")]
    assert canonical.map_values(values.limit(0), names, "typed", "meant").count() == 0


def test_edits():
    assert [canonical.edits(a, b) for a, b in (("brow", "borw"), ("brow", "bow"), ("heel", "heeel"), ("abc", "xyz"), ("", "ab"))] == [1, 1, 1, 3, 2]


def test_cues_of_every_format():
    srt = "﻿1\r\n00:00:01,0 --> 00:00:02,0\r\nOne\r\ntwo\r\n\r\n2\r\n00:00:03,0 --> 00:00:04,0\r\n{\\an8}<i>Three</i>\r\n"
    assert cues.split_cues(srt) == ["One two", "{\\an8}<i>Three</i>"]
    assert cues.split_cues("WEBVTT\n\n00:01.0 --> 00:02.0\nA\n") == ["A"]
    assert cues.split_cues("{1}{5}A|b\n{6}{9}C\n") == ["A b", "C"]
    assert cues.split_cues("1. [00:01 - 00:02] A\n2. [00:03 - 00:04] B\n") == ["A", "B"]
    assert cues.split_cues(None) == cues.split_cues("") == cues.split_cues(" \n﻿") == []
    assert cues.repaired("Â¿Era la sartÃ©n?") == "¿Era la sartén?"
    assert cues.fold("rn0dern") == cues.fold("modem")


SUBJECTS = {"cooking": ["oven", "dough", "whisk", "butter"], "law": ["verdict", "judge", "clause", "appeal"], "music": ["violin", "tempo", "choir", "chord"]}


def corpus(n=400, seed=0):
    rng = np.random.default_rng(seed)
    texts, truth = [], {}
    for i in range(n):
        own = list(rng.choice(list(SUBJECTS), size=rng.integers(0, 3), replace=False))
        lines = [str(rng.choice(["Wait here.", "Not now.", "You look tired.", "Thank you."])) for _ in range(8)]
        for s in own:
            for _ in range(int(rng.integers(3, 6))):
                a, b = rng.choice(SUBJECTS[s], size=2)
                lines.append(f"It was the {a}, not the {b}!")
        lines += ["Fresh oven kits at cheapcues.example"] * 3
        rng.shuffle(lines)
        texts.append((i, "".join(f"{k}\n00:00:{k:02d},0 --> 00:00:{k:02d},9\n{x}\n\n" for k, x in enumerate(lines, 1))))
        truth[i] = set(own)
    return texts, truth


def test_subjects_of_held_out_documents(spark):
    texts, truth = corpus()
    labels = [(i, s.upper() if i % 3 else f" {s}", "a") for i in range(0, 400, 4) for s in (truth[i] or {"none"})] + [(3, None, "a"), (9_999, "law", "a")]
    got = {i: set() for i in truth}
    areas = spark.createDataFrame([(s, f"{s} and more") for s in SUBJECTS], "subject string, description string")
    docs = spark.createDataFrame([*texts, (900, None), (901, ""), (902, " \n")], DOCS)
    for r in subjects.found_subjects(docs, spark.createDataFrame(labels, "doc_id bigint, subject string, annotator string"), areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [i for i in truth if i % 4]
    right = sum(got[i] == truth[i] for i in held_out)
    assert right >= 0.9 * len(held_out)
    assert not {900, 901, 902} & got.keys()
    none = spark.createDataFrame([], DOCS)
    assert subjects.found_subjects(none, spark.createDataFrame([], "doc_id bigint, subject string, annotator string"), areas).count() == 0


def test_composition_counts_what_is_found(spark):
    texts, truth = corpus()
    stray = "".join(f"{k}\n00:00:{k:02d},0 --> 00:00:{k:02d},9\n{x}\n\n" for k, x in enumerate(["It was the violin, not the choir!", *["Wait here."] * 8], 1))
    labels = spark.createDataFrame([(i, s, "a") for i in range(0, 400, 4) for s in (truth[i] or {"none"})], "doc_id bigint, subject string, annotator string")
    areas = spark.createDataFrame([(s, f"{s} and more") for s in SUBJECTS], "subject string, description string")
    docs = spark.createDataFrame([*texts, *[(k, stray) for k in range(500, 540)], (900, None), (901, "")], DOCS)
    found = subjects.found_subjects(docs, labels, areas).collect()
    want = {s: sum(r.subject == s for r in found) for s in SUBJECTS} | {"none": 442 - len({r.doc_id for r in found})}
    got = {r.subject: r for r in subjects.composition(docs, labels, areas).collect()}
    assert {s: r.n_docs for s, r in got.items()} == want
    assert want["none"] >= 42 and abs(sum(r.weight for r in got.values()) - 442) < 0.01
    cues = sum(8 + 3 + t.count("!") for _, t in texts) + 40 * 9
    adverts = 3 * len(texts)
    assert sum(r.n_cues_about for r in got.values()) == cues - adverts
