"""Joins, passages, toxicity, the language model and the pipeline."""

from __future__ import annotations

import collections
import random

import numpy as np
import pytest

from lodestar.llm import jaccard, lm, queries, substrings, toxicity
from lodestar.llm.components import components


def shingle_set(text: str | None) -> set:
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows: list) -> dict[int, tuple[int, int]]:
    """Place: (least place of its component, links)."""
    sets = [shingle_set(r.text) for r in rows]
    n = len(rows)
    links = [[] for _ in rows]
    for i in range(n):
        for j in range(i + 1, n):
            same = (rows[i].text or "") == (rows[j].text or "")
            if same or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9):
                links[i].append(j)
                links[j].append(i)
    root = list(range(n))
    for i in range(n):
        if root[i] != i:
            continue
        todo = [i]
        while todo:
            for j in links[todo.pop()]:
                if root[j] == j and j != i:
                    root[j] = i
                    todo.append(j)
    return {i: (root[i], len(links[i])) for i in range(n)}


def near_copies(n: int, seed: int = 0) -> list[str]:
    """A large group: one text with a word or two changed, each another; and texts a part of which is shared."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(900)]
    base = rng.choices(words, k=200)
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(words)
        out.append(" ".join(w))
    return out + [" ".join([*base[:60], *rng.choices(words, k=140)]) for _ in range(n // 3)] + [" ".join(rng.choices(words, k=3)) for _ in range(10)]


def test_jaccard_classes_equal_brute_force(spark):
    rows = spark.createDataFrame(list(enumerate(near_copies(330))), "doc_id long, text string")  # more than a block
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard.jaccard_classes(rows).collect()}
    assert got == brute(sorted(rows.collect(), key=lambda r: r.doc_id))


def test_buckets_of_repeated_rows_keep_apart(spark):
    """Every row twice with one doc_id: buckets with the same ends but another member between aren't the same."""
    signed = [(7, n, [b for b, own in ((1, (1, 5, 9)), (2, (1, 6, 9)), (3, (1, 5, 9)), (4, (5,))) if n in own]) for n in (1, 5, 6, 9)]
    rows = spark.createDataFrame(signed * 2, "doc_id long, node long, bands array<long>")
    one = rows.dropDuplicates(["node"]).selectExpr("node", "explode(bands) AS bucket")
    assert sorted(r.bucket for r in jaccard._buckets(one).collect()) == [1, 2]


def test_jaccard_odd_rows(spark, messy, nothing):
    got = jaccard.jaccard_classes(messy).collect()
    assert len(got) == messy.count() and jaccard.jaccard_classes(nothing).collect() == []
    five = [r for r in got if r.doc_id == 5 or (r.doc_id is None and r.class_id == 5)]
    assert len(five) == 4 and all(r.n_links == 3 and r.class_id == 5 for r in five)
    kept = jaccard.keep_one(messy)
    assert kept.columns == messy.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted(set(ids)) and 5 in ids and 1 not in ids  # null and empty text are the same text


def test_pruning_keeps_like_pairs():
    least = jaccard.least_matches(0.8, 1e-7)
    assert least == sorted(least) and 0 < least[0] < 32 and least[-1] < 0.8 * 128
    sig = np.zeros((3, 128), np.uint8)
    sig[1, ::7] = 1  # alike in 109 of 128
    sig[2, ::2] = 2
    assert jaccard.survivors(sig, np.array([0, 0]), np.array([1, 2]), least).tolist() == [0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 102), (101, 102), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100, 102: 100}


def test_compact_windows():
    rng = np.random.default_rng(2)
    v = rng.integers(0, 1 << 62, 200).astype(np.uint64)
    left, c, right = substrings.compact_windows(v, np.array([0, 90]), np.array([90, 200]), 10)
    for lo, hi in ((0, 90), (90, 200)):
        for i in range(lo, hi - 9, 7):
            for j in range(i + 10, hi + 1, 5):
                m = i + int((v[i:j] >> np.uint64(8)).argmin())
                own = [(a, k, b) for a, k, b in zip(left, c, right) if a <= i <= k < j <= b and i <= k]
                assert [k for _, k, _ in own] == [m]


def test_compact_windows_are_all_there():
    """Against one stack per range, with runs of equal values and short ranges."""
    rng = np.random.default_rng(3)
    for kinds in (3, 50, 1 << 62):
        v = rng.integers(0, kinds, 3000).astype(np.uint64) << np.uint64(1)
        v[500:700] = v[500]
        v[900:1100] = np.sort(v[900:1100])
        v[1200:1400] = np.sort(v[1200:1400])[::-1]
        cuts = np.unique(rng.integers(0, 3000, 12))
        for least in (33, 46, 90):
            got = sorted(zip(*(x.tolist() for x in substrings.compact_windows(v, cuts[:-1], cuts[1:], least)), strict=True))
            assert got == sorted(zip(*(x.tolist() for x in substrings._all_windows(v, cuts[:-1], cuts[1:], least)), strict=True))


def test_passages_on_two_diagonals():
    rng = np.random.default_rng(4)
    one, two, fill = (rng.integers(0, 1 << 60, n).astype(np.uint64) for n in (60, 52, 400))
    got = substrings.passages(np.r_[one, two], np.r_[one, fill, two])
    assert [(a, b, c, d) for a, b, c, d, _ in got] == [(0, 60, 0, 60), (60, 112, 460, 512)]
    assert substrings.passages(one, fill) == [] and substrings.passages(one[:0], fill) == []


def test_passages_are_found(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    say = lambda n: rng.choices(words, k=n)
    shared = say(70)
    near = list(shared)
    near[35] = "changed"
    texts = [say(200) + shared + say(100), say(30) + shared + say(300), say(400) + near + say(20), say(300), say(50) + shared[:45] + say(50), say(90)]
    texts.append(list(texts[5]))
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = substrings.repeated_passages(df).collect()
    spans = collections.defaultdict(set)
    for r in got:
        assert r.other_id < r.doc_id and r.similarity >= 0.8 and r.end - r.begin >= 50
        spans[r.doc_id] |= set(range(r.begin, r.end))
    assert set(spans) == {1, 2, 6}
    assert spans[1] == set(range(30, 100)) and spans[6] == set(range(90)) and len(spans[2]) >= 60
    cut = {r.doc_id: r.text.split() for r in substrings.remove_repeats(df).collect()}
    assert cut[1] == texts[1][:30] + texts[1][100:] and cut[0] == texts[0] and cut[6] == []


def test_exact_repeats_are_all_caught(spark):
    sf = "/root/testdata/sf0.01"
    got = collections.defaultdict(set)
    for r in queries.op4_substring_dedup(spark, sf).collect():
        got[r.doc_id] |= set(range(r.begin, r.end))
    first: dict = {}
    missed = []
    for d in sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id):
        w = d.text.split()
        sh = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        run, ends = 0, []
        for k, s in enumerate(sh):
            run = run + 1 if first.get(s, d.doc_id) != d.doc_id else 0
            if run >= 47:
                ends.append(k)
        if ends and len(got[d.doc_id] & set(ends)) < 0.5 * len(ends):
            missed.append(d.doc_id)
        for s in sh:
            first.setdefault(s, d.doc_id)
    assert not missed


def test_edited_short_passages_are_found(spark):
    """Passages of 50 words with one word changed: with two of four hashes wanted, one in forty was lost."""
    rng = random.Random(8)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for k in range(0, 600, 2):
        shared = [word() for _ in range(50)]
        near = [*shared[:25], word(), *shared[26:]]
        rows += [(k + i, " ".join([*(word() for _ in range(20)), *own, *(word() for _ in range(20))])) for i, own in enumerate((shared, near))]
    got = {r.doc_id for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k for k, _ in rows if k % 2}


def test_passages_around_a_notice_are_found(spark):
    """Notices stand in all texts in other surroundings; some pairs share a few words on either side too, one of them with an edit."""
    rng = random.Random(11)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for size, pad in ((45, 3), (40, 10), (46, 2)):
        notice = say(size)
        texts = [[*say(30), *notice, *say(30)] for _ in range(40)]
        pairs = [(a, a + 14) for a in range(11, 25, 2)]
        whole = set(range(30 - pad, 30 + size + pad))
        for a, b in pairs:
            texts[b][30 - pad : 30 + size + pad] = texts[a][30 - pad : 30 + size + pad]
        if pad == 10:
            texts[pairs[0][1]][60] = "changed"
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
        got = {(r.doc_id, r.other_id): set(range(r.begin, r.end)) for r in substrings.repeated_passages(df).collect()}
        assert set(got) == {(b, a) for a, b in pairs}
        assert all(len(v) >= 50 if pad == 10 and p[0] == pairs[0][1] else v == whole for p, v in got.items())


def test_a_repeat_behind_decoys_is_found(spark):
    """Documents 1 and 3 share 200 words; 0 and 2, before each of them, hold single shingles of it in other places."""
    rng = random.Random(13)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared = say(200)
    decoy = [x for k in range(0, 195, 5) for x in (*shared[k : k + 5], *say(50))]
    texts = [decoy, [*say(90), *shared, *say(40)], list(reversed(decoy)) + decoy, [*say(90), *shared, *say(60)]]
    got = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert (3, 1, 90, 290) in {(r.doc_id, r.other_id, r.begin, r.end) for r in got}


def test_edited_passages_behind_unlike_documents_are_found(spark):
    """Lesser documents that share parts of a passage, too short to be like it, stand before the edited text that it repeats, and between the two."""
    rng = random.Random(12)
    rows, wanted = [], set()
    for t in range(12):
        word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
        own = [word() for _ in range(60)]
        around = lambda part: " ".join([*(word() for _ in range(40)), *part, *(word() for _ in range(40))])
        for first in (0, 600):
            rows += [(t * 1000 + first + k, around(own[2 * k : 2 * k + 32])) for k in range(15)]
        rows += [(t * 1000 + 500, around([*own[:30], word(), *own[31:]])), (t * 1000 + 900, around(own))]
        wanted.add((t * 1000 + 900, t * 1000 + 500))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.other_id) for r in substrings.repeated_passages(df).collect()}
    assert wanted <= got, len(wanted - got)


def test_links_of_a_notice_in_other_surroundings_follow_the_documents(spark, monkeypatch):
    """A notice too short to be a passage stands in all documents; a passage edited in it is found all the same."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
    notice, own = [word() for _ in range(36)], [word() for _ in range(30)]
    texts = [[*(word() for _ in range(30)), *notice, *(word() for _ in range(30))] for _ in range(400)]
    texts[150][66:] = own
    texts[390][66:] = [*own[:8], word(), *own[9:]]
    links, checked = [], substrings._checked

    def counted(docs, df, threshold):
        links.append(df.count())
        return checked(docs, df, threshold)

    monkeypatch.setattr(substrings, "_checked", counted)
    got = substrings.repeated_passages(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    assert (390, 150) in {(r.doc_id, r.other_id) for r in got}
    assert links[1] < 64 * 400, links


def test_passages_that_share_but_a_notice_block_are_found(spark):
    """Pairs of a passage of 50 words, 35 of them a notice of all texts and one of the others changed, so that hardly a stretch is theirs alone.

    The notice is one whose least shingles lie near its end by all hashes, so what stands beside them is the same in all texts.
    """
    rng = random.Random(89634)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    notice = say(35)
    own = [say(15) for _ in range(150)]
    parts = [*[say(15) for _ in range(40)], *own, *[[*x[:13], *say(1), *x[14:]] for x in own]]
    texts, wanted = [[*say(20), *part, *notice, *say(30)] for part in parts], {(190 + k, 40 + k) for k in range(150)}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(7)
    got = {(r.doc_id, r.other_id) for r in substrings.repeated_passages(df).collect()}
    assert got == wanted, len(wanted - got)


def test_windows_of_a_repeated_word_are_few(spark):
    """Of a word said 400 times some windows stand for all, and every part of it is found to repeat; a word said often doesn't link unlike texts."""
    rng = random.Random(3)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = [[*say(20), *["of"] * 60, *say(20)], [*say(30), *["of"] * 400, *say(30)], *[[*say(25), *["of"] * 40, *say(25)] for _ in range(60)]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert substrings._windows(df.where("doc_id = 1")).count() < 8 * 60
    got = collections.defaultdict(set)
    for r in substrings.repeated_passages(df).collect():
        got[r.doc_id] |= set(range(r.begin, r.end))
    assert set(got) == {1} and set(range(30, 430)) <= got[1]


def test_recall_of_edited_passages(spark):
    """By brute force: planted passages whose shingle sets have a similarity of 0.8, 0.85 or 0.9 and somewhat more."""
    rng = random.Random(17)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows, wanted = [], collections.defaultdict(list)
    for k in range(0, 900, 2):
        least = (0.8, 0.85, 0.9)[k // 2 % 3]
        shared = [word() for _ in range(rng.randint(60, 300))]
        near = list(shared)
        sim = 1.0
        places = rng.sample(range(len(near)), len(near))
        while places:  # change words as long as the similarity allows
            trial = list(near)
            trial[places.pop()] = word()
            one, two = ({tuple(t[i : i + 5]) for i in range(len(t) - 4)} for t in (shared, trial))
            new = len(one & two) / len(one | two)
            if new < least:
                break
            near, sim = trial, new
        assert sim >= least
        wanted[least].append((k + 1, 20, 20 + len(near)))
        rows += [(k + i, " ".join([*(word() for _ in range(20)), *own, *(word() for _ in range(20))])) for i, own in enumerate((shared, near))]
    got = collections.defaultdict(set)
    for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.similarity >= 0.8 and (r.doc_id, r.other_id) == (r.other_id + 1, r.doc_id - 1)
        got[r.doc_id] |= set(range(r.begin, r.end))
    for least, own in wanted.items():
        assert sum(len(got[d] & set(range(a, b))) >= 0.5 * (b - a) for d, a, b in own) >= 0.97 * len(own), least


def test_hot_passages_and_frequent_shingles(spark, monkeypatch):
    """A passage in most texts, and a sentence in all in other surroundings, split and linked within chunks: all but the first have a row."""
    monkeypatch.setattr(substrings, "SAMPLE", 0.5)
    monkeypatch.setattr(substrings, "OFTEN", 20)
    rng = random.Random(19)
    say = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage, line = say(80), say(12)
    rows = [(i, " ".join([*say(30), *(passage if i % 3 else []), *say(60), *line, *say(60)])) for i in range(300)]
    got = collections.defaultdict(set)
    for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect():
        got[r.doc_id] |= set(range(r.begin, r.end))
    assert set(got) == {i for i in range(2, 300) if i % 3}
    assert all(set(range(30, 110)) <= v <= set(range(26, 114)) for v in got.values())  # chance may lend a word at either end


def test_substrings_odd_rows(spark, messy, nothing):
    assert substrings.repeated_passages(nothing).collect() == [] and substrings.remove_repeats(nothing).collect() == []
    out = substrings.remove_repeats(messy)
    assert out.columns == messy.columns and out.count() == messy.count()
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id is not None}
    assert len(text[7].split()) == 160 and text[0] is None


def test_disguised_words(spark, sf):
    cost = toxicity.letter_model(spark.read.parquet(f"{sf}/documents.parquet"))
    reader = toxicity.Reader(cost)
    (got,) = reader.words(["The 1d10t was st00pid, w0r7hle55 tr@sh l.o.s.e.r m o r o n scuuuum Straße 42"])
    assert "idiot" in got and "trash" in got and "loser" in got and "moron" in got and any(w.startswith("worthles") for w in got), got
    assert "the" in got and "was" in got and "scum" in got and "straße" in got


def test_long_disguises_are_read_to_the_end(spark, sf):
    reader = toxicity.Reader(toxicity.letter_model(spark.read.parquet(f"{sf}/documents.parquet")))
    said = "you are all welcome here and we like to talk about many things every day but you are such a worthless idiot"
    spelled = said.replace("idiot", "1d10t")
    wide = "   ".join(" ".join(w) for w in spelled.split())
    even = " ".join(spelled.replace(" ", ""))
    dotted = ".".join(spelled.replace(" ", ""))
    for got in reader.words([wide, even, dotted, spelled.replace(" ", "")]):
        assert "idiot" in got and any(w.startswith("worthles") for w in got), got
    assert set(said.split()) - {"worthless"} <= set(reader.words([wide])[0])


def test_toxicity_follows_labels(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries.op8_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    y = np.array([r.toxic for r in scored])
    order = np.argsort(np.argsort([r.score for r in scored]))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.94
    assert np.mean([r.predicted for r in scored if r.toxic == 0]) < 0.01
    assert all(r.predicted == int(r.score >= 0.5) and 0 <= r.score <= 1 for r in scored)


def test_toxicity_odd_rows(spark, messy, nothing):
    labels = spark.createDataFrame([(3, 1, 1), (5, None, 0), (7, 0, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.reject_toxic(messy, labels)
    assert out.columns == messy.columns
    assert toxicity.reject_toxic(nothing, labels).collect() == []
    assert toxicity.reject_toxic(messy, labels.limit(0)).count() == messy.count()


def test_language_model(spark):
    import public_tokenizers as P

    sf = "/root/testdata/sf0.01"
    rows = queries.op3_lm_scoring(spark, sf).collect()
    import zlib

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words = {i: t.translate(fold).split() for i, t in docs.items()}
    count = collections.Counter(w for i, ws in words.items() if not held[i] for w in [*ws, None])
    total, kinds = sum(count.values()), len(count)
    for r in rows:
        own = [*words[r.doc_id], None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(own), sum(w in count for w in own), total)
        assert r.base_score == pytest.approx(sum(np.log10((count[w] + 1) / (total + kinds + 1)) for w in own), rel=1e-9)
        assert r.score < 0
    assert len(rows) == len(docs)
    assert P.path("byte_bpe_50k.json")


def test_language_model_learns(spark):
    """On held-out texts of the larger table the model does better than word frequencies."""
    rows = [r for r in queries.op3_lm_scoring(spark, "/root/testdata/sf0.1").collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_every_word_reaches_the_weights(spark):
    """Another word anywhere in a long training text gives other weights."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    size = lm._vocabulary_size(path)
    vocabulary = lm.Vocabulary.of(np.ones(size), np.ones((lm.ROWS, lm.ROWS)))
    rng = random.Random(3)
    words = [rng.choice(["red", "green", "blue", "cat", "dog", "house"]) for _ in range(1000)]

    def weights(w: list[str]) -> np.ndarray:
        docs = lm._prepared(spark.createDataFrame([(0, " ".join(w))], "doc_id long, text string").coalesce(1), "text")
        assert docs.where("not held").count() == 1
        flat = np.zeros(0, np.float32)
        return lm._trained(docs, lm.Model(path, vocabulary, vocabulary, lm.Layer(seed=5).flat, lm.Layer(seed=6).flat, 0, 0, flat, flat, flat)).across

    plain = weights(words)
    assert np.array_equal(plain, weights(words))
    for at in (3, 500, 990):
        assert not np.array_equal(plain, weights([*words[:at], "strange", *words[at + 1 :]]))


def test_model_is_a_distribution():
    layer = lm.Layer(seed=1)
    rng = np.random.default_rng(0)
    counts = rng.integers(0, 50, 300).astype(float)
    vocabulary = lm.Vocabulary.of(counts, rng.integers(0, 3, (lm.ROWS, lm.ROWS)).astype(float))
    layer.prepare(vocabulary.prior)
    x = rng.integers(0, 300, (1, 2 * lm.HALF))
    pad = np.zeros((1, 2 * lm.HALF), bool)
    total = sum(np.exp(vocabulary.log(layer, x, pad, np.full((1, lm.HALF), i))) for i in range(300))
    empty = np.setdiff1d(np.arange(lm.ROWS), vocabulary.row)
    assert np.all(total <= 1 + 1e-4) and (len(empty) > 0 or np.allclose(total, 1, atol=1e-3))


def test_gradient():
    layer = lm.Layer(seed=2)
    rng = np.random.default_rng(1)
    x, pad = rng.integers(0, lm.ROWS, (3, 2 * lm.HALF)), np.zeros((3, 2 * lm.HALF), bool)
    pad[0, :20] = True
    pad[0, 16:20] = False
    target, live = rng.integers(0, lm.CLASSES, (3, lm.HALF)), np.ones((3, lm.HALF), np.float32)
    prior = np.zeros((lm.ROWS, lm.CLASSES), np.float32)

    def loss() -> float:
        layer.prepare(prior)
        return float(-layer.class_log(x, pad, target).astype(float).mean())

    g = layer.gradient(x, pad, target, live, prior)
    for i in np.argsort(-np.abs(g))[:: max(1, len(g) // 40)][:12]:
        keep = layer.flat[i]
        layer.flat[i] = keep + 3e-2
        up = loss()
        layer.flat[i] = keep - 3e-2
        down = loss()
        layer.flat[i] = keep
        assert (up - down) / 6e-2 == pytest.approx(g[i], abs=3e-3, rel=0.1)


def test_language_model_odd_rows(spark, messy, nothing):
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.json")
    assert lm.lm_scores(nothing, path).collect() == []
    got = lm.lm_scores(messy, path).collect()
    assert len(got) == messy.count() and all(np.isfinite(r.score) for r in got)
    assert min(r.n_tokens for r in got) == 1


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and after.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
        kept.append(after.count())
        before = after
    assert docs.count() > kept[0] > kept[1] > kept[2] == kept[3]
    packed = corpus_pipeline.STAGES[-1][1](spark, before, sf).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in before.collect()}


def test_pipeline_odd_rows(spark, messy, nothing):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, sf).count() >= 0
