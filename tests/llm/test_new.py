"""Exact dedup, spelling variants, ordered funnels."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from lodestar.llm import exact, funnels, queries, variants


@pytest.mark.parametrize("name", sorted(set(queries.oracle_sql()) - {"op7_ngram_jaccard_join"}))
def test_query_equals_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "clicks"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name]).df()
    got = queries.queries()[name](spark, sf).toPandas()[list(want.columns)]
    assert plain(got) == plain(want)


def plain(frame) -> list[str]:
    return sorted(str([None if pd.isna(v) else int(v) if isinstance(v, float) else v for v in r]) for r in frame.astype(object).itertuples(index=False, name=None))

# -- exact dedup ---------------------------------------------------------------------------


def classes_by_hand(rows: list[tuple]) -> dict:
    """Index of a row: (keep_id, size, digest); and the number of kept rows per digest."""
    groups = collections.defaultdict(list)
    for i, (doc_id, text) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append((doc_id is None, doc_id, i))
    out = collections.Counter()
    for t, g in groups.items():
        keep = min(g, key=lambda x: (x[0], x[1] or 0))[1]
        for _, doc_id, _ in g:
            out[doc_id, keep, len(g), hashlib.sha256(t.encode()).hexdigest()] += 1
    return out, len(groups)


@pytest.mark.parametrize(("bits", "step"), [(1, 1), (4, 1), (4, 3), (5, 2)])
def test_exact_classes_equal_a_plain_grouping(spark, bits, step):
    rng = random.Random(bits)
    texts = [f"a {i}" for i in range(40)] + ["hot", "hot ", "hot\t", " hot", None, "", " ", "\n\n", "x y", "x y"]
    rows = [(i if rng.random() < 0.95 else None, rng.choice(texts[:40]) if rng.random() < 0.5 else rng.choice(texts[40:])) for i in range(700)]
    rng.shuffle(rows)
    want, n = classes_by_hand(rows)
    got = exact.exact_classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), bits=bits, step=step).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == n
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_odd_rows(spark, messy, nothing):
    rows = [(r.doc_id, r.text) for r in messy.collect()]
    want, n = classes_by_hand(rows)
    got = exact.exact_classes(messy).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == n
    left = exact.keep_exact(messy)
    assert left.columns == messy.columns
    assert left.count() == n
    assert exact.exact_classes(nothing).count() == 0
    named = spark.createDataFrame([("b", "t"), ("a", "t"), (None, "t")], "doc_id string, text string")
    assert {r.keep_id for r in exact.exact_classes(named).collect()} == {"a"}


# -- ordered funnels -------------------------------------------------------------------------


def attempts_by_hand(rows: list[tuple]) -> dict:
    """(funnel, client): [times of step 1, 2, 3, 4], attempt by attempt."""
    seen = {(c, k, t) for c, k, t in rows if None not in (c, k, t)}
    out = {}
    for f in funnels.FUNNELS:
        for c, k, t in seen:
            if k != f.steps[0]:
                continue
            mine = out.setdefault((f.name, c), [[], [], [], []])
            mine[0].append(0)
            now = t
            for i, kind in enumerate(f.steps[1:], 1):
                later = [x for c2, k2, x in seen if c2 == c and k2 == kind and x > now]
                if not later or min(later) - t > timedelta(minutes=30):
                    break
                if any(c2 == c and k2 == f.excluded and now < x <= min(later) for c2, k2, x in seen):
                    break
                mine[i].append(int((min(later) - now) / timedelta(microseconds=1)))
                now = min(later)
    return out


@pytest.mark.parametrize(("width", "chunk"), [(funnels.WIDTH, funnels.CHUNK), (7 * 60 * 1_000_000, 40), (funnels.HORIZON, 10**9)])
def test_funnels_equal_attempts_by_hand(spark, width, chunk):
    rng = random.Random(width)
    kinds = ["view"] * 6 + ["click"] * 6 + ["purchase"] * 4 + ["signup", "error", "other", None]
    begin = datetime(1969, 12, 31, 20)  # buckets before and after zero
    rows = []
    for _ in range(900):
        client = rng.choice([1, 1, 1, 2, 3, None])
        rows.append((client, rng.choice(kinds), begin + timedelta(seconds=rng.randrange(0, 8 * 3600, 20), microseconds=rng.choice([0, 1]))))
    at = datetime(1970, 1, 1, 12)  # exactly on the horizon; ties; an excluded row at the time of the next step, and of the first
    rows += [(9, "view", at), (9, "click", at + timedelta(minutes=10)), (9, "view", at + timedelta(minutes=30)), (9, "purchase", at + timedelta(minutes=30, microseconds=1))]
    rows += [(10, "view", at), (10, "error", at), (10, "click", at), (10, "click", at + timedelta(seconds=1)), (10, "view", at + timedelta(seconds=2)), (10, "error", at + timedelta(seconds=2))]
    rows += [(None, "view", at), (11, None, at), (11, "view", None), (12, "purchase", at)] + rows[:50]
    want = attempts_by_hand(rows)
    df = spark.createDataFrame([(1, *r, "x", 0) for r in rows], "home int, client_id long, kind string, arrived_at timestamp_ntz, bucket string, chunk int")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        got = funnels.funnel_counts(df, width=width, chunk=chunk).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    deep = {k: max(i for i, x in enumerate(v, 1) if x) for k, v in want.items()}
    alike = collections.Counter((k[0], d) for k, d in deep.items())
    assert len(got) == len(want) > 5
    for r in got:
        key = r.funnel, r.client_id
        assert [r.n1, r.n2, r.n3, r.n4] == [len(x) for x in want[key]]
        assert [r.t2, r.t3, r.t4] == [sorted(x)[-(-90 * len(x) // 100) - 1] if x else None for x in want[key][1:]]
        assert r.deepest == deep[key]
        assert r.same_depth == alike[r.funnel, r.deepest]


def test_step_times_are_ranked_in_two_steps(spark):
    rng = random.Random(5)
    rows = [("A", rng.choice([1, 2]), 2, rng.choice([rng.randrange(1 << 20), 7, 1 << 15]), rng.randint(1, 3)) for _ in range(500)]
    times = spark.createDataFrame(rows, "funnel string, client long, step int, dt long, n long").groupBy("funnel", "client", "step", "dt").agg({"n": "sum"}).withColumnRenamed("sum(n)", "n")
    for r in funnels._ranked(times, ["funnel", "client", "step"], 90).collect():
        every = sorted(dt for _, c, _, dt, n in rows if c == r.client for _ in range(n))
        assert r.t == every[-(-90 * len(every) // 100) - 1]


def test_funnels_of_nothing(spark):
    empty = spark.createDataFrame([], "client_id long, kind string, arrived_at timestamp_ntz, n1 long")
    assert funnels.funnel_counts(empty).count() == 0
    odd = spark.createDataFrame([(None, None, None), ("a", "view", datetime(2024, 1, 1))], "client_id string, kind string, arrived_at timestamp")
    assert [(r.funnel, r.client_id, r.n1, r.deepest) for r in funnels.funnel_counts(odd).collect()] == [("A", "a", 1, 1)]


# -- spelling variants -----------------------------------------------------------------------


def words_by_hand(rows: list[tuple]) -> dict[str, int]:
    out = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(n: dict[str, int]) -> list[tuple]:
    form, near = {}, {}
    for w in n:
        mine = [u for u in n if one_edit(u, w)]
        near[w] = len(mine)
        best = min(mine, key=lambda u: (-n[u], u), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n[form[w]] if form[w] else None))
    return sorted(out)


def spoiled(rng: random.Random, w: str) -> str:
    i, c = rng.randrange(len(w)), rng.choice("abé")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i + 1 :], w[:i] + c + w[i:], w])


def test_letter_runs_and_crc():
    rng = random.Random(1)
    texts = ["", "ÀÿZz-a×÷bĀc日", "x" * 200 + "é" * 30, *("".join(rng.choices("abcXYZ é.-Ü\n", k=300)) for _ in range(20))]
    from lodestar.llm import kernel

    letters, at, text = variants.letter_runs(*kernel.joined([t.encode() for t in texts]))
    got = [(int(i), bytes(letters[a:b]).decode()) for i, a, b in zip(text, at, at[1:], strict=False)]
    want = [(i, "".join(c.lower() if "A" <= c <= "Z" else c for c in r)) for i, t in enumerate(texts) for r in re.findall(r"[A-Za-zÀ-ÿ]+", t)]
    assert got == want
    begin = [zlib.crc32(f"{i}:".encode()) for i in range(len(texts))]
    crc = variants.crc32s(letters, at, variants.np.array(begin, variants.np.uint32)[text])
    assert crc.tolist() == [zlib.crc32(f"{i}:{w}".encode()) for i, w in want]


@pytest.mark.parametrize(("hot", "cold"), [(variants.HOT, variants.COLD), (40, 30)])
def test_variants_equal_all_pairs(spark, hot, cold):
    rng = random.Random(hot)
    base = ["".join(rng.choices("aabé", k=rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababab", "q" * 300, "q" * 301]
    said = []
    for w in base:
        said += [w] * rng.choice([1, 5, 6, 30, 200])
        for _ in range(6):
            said += [spoiled(rng, spoiled(rng, w))] * rng.choice([2, 5, 7, 40])
    rng.shuffle(said)
    rows = [(i, " ".join(said[i::120])) for i in range(120)] + [(None, "Aaaaaa AAAAAA aaaaaa"), (3, None), (4, ""), (4, "")]
    got = variants.spelling_variants(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=hot, cold=cold)
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect())
    want = variants_by_hand(words_by_hand(rows))
    assert got == want
    assert len({r[2] for r in got}) < len(got) > 100
    assert any(r[1] and r[1] != r[2] for r in got)  # a chain of forms


def test_variants_of_given_texts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in queries.op12_spelling_variants(spark, sf).collect())
    assert got == variants_by_hand(words_by_hand([(r.doc_id, r.text) for r in docs.collect()]))


def test_variants_odd_rows(spark, messy, nothing):
    got = sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in variants.spelling_variants(messy).collect())
    assert got == variants_by_hand(words_by_hand([(r.doc_id, r.text) for r in messy.collect()]))
    assert variants.spelling_variants(nothing).count() == 0


# -- licenses ----------------------------------------------------------------------------------


def names_in(text: str) -> list[str]:
    from lodestar.llm import kernel, licenses

    scanner = licenses.Scanner(licenses.TEMPLATES)
    return [scanner.templates[t][0] for _, place, word, _, _ in scanner.hits(*kernel.joined([text.encode()])) for t, _, _ in scanner.scan(place.tolist(), word.tolist())]


def template(name: str, i: int = -2) -> str:
    from lodestar.llm import licenses

    return licenses.TEMPLATES[name][i]


@pytest.mark.parametrize(
    ("text", "names"),
    [
        (lambda: template("MIT-0"), ["MIT-0"]),
        (lambda: template("MIT"), ["MIT"]),
        (lambda: template("BSD-4-Clause").replace("the organization", "Jane Doe and friends"), ["BSD-4-Clause"]),
        (lambda: template("BSD-3-Clause"), ["BSD-3-Clause"]),
        (lambda: template("BSD-2-Clause"), ["BSD-2-Clause"]),
        (lambda: template("X11"), ["X11"]),
        (lambda: template("ISC"), ["ISC"]),
        (lambda: template("0BSD"), ["0BSD"]),
        (lambda: template("Zlib"), ["Zlib"]),
        (lambda: "This work is licensed under the GNU General Public License, version 2 or version 3.", ["GPL-2.0-only OR GPL-3.0-only"]),
        (lambda: "This work is licensed under the GNU General Public License, version 2 or 3.", ["GPL-2.0-only OR GPL-3.0-only"]),
        (lambda: "This work is licensed under the GNU General Public License, version 2.", ["GPL-2.0-only"]),
        (lambda: "This work is licensed under the GNU General Public License, version 2 or any later version.", ["GPL-2.0-or-later"]),
        (lambda: "// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]),
        (lambda: "SPDX-License-Identifier: MIT-0", ["MIT-0"]),
        (lambda: "SPDX-License-Identifier: CC-BY-SA-2.5", ["CC-BY-SA-2.5"]),
        (lambda: "This work is licensed under a Creative Commons Attribution 2.0 Generic License.", ["CC-BY-2.0"]),
        (lambda: "Licensed under CC BY 2.5.", ["CC-BY-2.5"]),
        (lambda: "The tool is licensed under the GPLv3.", ["GPL-3.0-only"]),
        (lambda: "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007", ["LGPL-3.0-only"]),
        (lambda: template("MPL-1.1"), ["MPL-1.1"]),
        (lambda: template("EPL-2.0", 0), ["EPL-2.0"]),
        (lambda: "Distributed under the Boost Software License, Version 1.0.", ["BSL-1.0"]),
        (lambda: "Not released under the MIT License.", []),
        (lambda: "Released under the MIT License.", ["MIT"]),
    ],
)
def test_licenses_by_their_clauses(text, names):
    assert names_in(text()) == names
    assert names_in(f"Some words before it.\n{text()}\nand some after it") == names


def plain_alignment(a: list, b: list) -> int:
    """The number of words aligned by the rule: anchors unique to both, the longest increasing run of them, then the gaps."""
    if not a or not b:
        return 0
    own = [w for w in a if a.count(w) == 1 and b.count(w) == 1]
    if not own:
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        a, b = a[n:], b[n:]
        m = 0
        while m < min(len(a), len(b)) and a[-1 - m] == b[-1 - m]:
            m += 1
        return n + m
    at = [b.index(w) for w in own]
    longest = [1] * len(own)
    for i in range(len(own)):
        longest[i] = 1 + max((longest[j] for j in range(i) if at[j] < at[i]), default=0)
    return max(longest)


def test_alignment_equals_the_rule():
    from lodestar.llm import licenses

    rng = random.Random(8)
    for _ in range(400):
        a, b = ([rng.randrange(rng.choice([4, 12, 40])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = licenses.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(i < i2 and j < j2 for (i, j), (i2, j2) in zip(pairs, pairs[1:], strict=False))
        unique = {w for w in a if a.count(w) == 1 and b.count(w) == 1}
        if unique:  # the anchors of the first step are a longest increasing run
            assert sum(a[i] in unique for i, _ in pairs) >= plain_alignment(a, b)
        else:
            assert len(pairs) == plain_alignment(a, b)
