"""Licence scans, ranked search and periodic runs against plain versions."""

import random
from fractions import Fraction

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from calltide.llm import lexical, licenses, periodic
from calltide.llm.queries import QUERIES

CLASHES = ("n_words", "phrases", "tags", "labels", "score", "runs", "collapsed", "_query", "rank", "word", "term", "_task")


def frame(spark, texts, first=0):
    rows = [(first + k, text) for k, text in enumerate(texts)]
    extra = {c: F.lit(k) for k, c in enumerate(CLASHES)}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


@pytest.fixture(scope="module")
def docs(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    return [tuple(r) for r in rows]


# --- Licences

NOTICES = [
    None,
    "",
    "MIT",
    "mit license",
    "The MIT\n  License; mit-license (MIT License)",
    "mit license mit license mit  license",
    "smit license mit licenses éMIT license",
    "cc by cc by-nc 4.0 CC BY.",
    "GNU General Public License gnu general public licence",
    "x " * 3000 + "Apache License" + " y" * 4000 + " apache license",
    "no licence here",
]


@pytest.mark.parametrize("limit", [1, 20, 1 << 20])
def test_places(limit, monkeypatch, spark):
    texts = NOTICES * 3
    found = licenses.Scan([(t or "").encode() for t in texts])
    for text, n, (phrases, _) in zip(texts, found.n_words, found.of_text()):
        want = brute.license_places(text)
        assert (n, sorted((x["word"], x["label"]) for x in phrases if x["base"])) == want


EXPRESSIONS = [
    # text, postfix, licences, strictness, valid
    ("MIT", "MIT", ["mit"], 1, True),
    ("MIT OR Apache-2.0", "MIT Apache-2.0 or", ["apache", "mit"], 1, True),
    ("GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only Classpath-exception-2.0 with", ["gpl"], 2, True),
    ("GPL-3.0+ AND MIT OR BSD-3-Clause", "GPL-3.0+ MIT and BSD-3-Clause or", ["bsd", "gpl", "mit"], 1, True),
    ("GPL-3.0+ and (MIT or BSD-3-Clause)", "GPL-3.0+ MIT BSD-3-Clause or and", ["bsd", "gpl", "mit"], 3, True),
    ("(LGPL-2.1 OR (MPL-2.0 AND ISC)) and more text", "LGPL-2.1 MPL-2.0 ISC and or more and", ["isc", "lgpl", "more", "mpl"], 5, True),
    ("MIT. See the file", "MIT", ["mit"], 1, True),
    ("MIT */", "MIT", ["mit"], 1, True),
    ("(MIT OR Apache-2.0", "MIT Apache-2.0 or", ["apache", "mit"], 1, False),
    ("MIT AND", "MIT", ["mit"], 1, False),
    ("MIT AND (", "MIT", ["mit"], 1, False),
    ("CC-BY-NC-4.0", "CC-BY-NC-4.0", ["cc-by-nc"], 5, True),
    ("", "", [], None, False),
    ("OR MIT", "", [], None, False),
    ("((" * 500, "", [], None, False),
    (" and ".join(["MIT"] * 2000), " ".join(["MIT"] + ["MIT and"] * 1999), ["mit"], 1, True),
]


@pytest.mark.parametrize("text,postfix,names,strictness,valid", EXPRESSIONS)
def test_expressions(text, postfix, names, strictness, valid):
    read = licenses.read_expression(text)
    assert (" ".join(read.postfix), read.licenses, read.strictness, read.valid) == (postfix, names, strictness, valid)


def test_tags(spark):
    texts = [
        "// SPDX-License-Identifier: (MIT OR Apache-2.0) AND Zlib */\nint main",
        '{"license": "MPL-2.0"}',
        "License: see the file",  # no licence that is known
        "license MIT",  # no tag
        "SPDX-License-Identifier: GPL-2.0 AND",
        "SPDX license identifier = Frobnicate-1.0",
        "SPDX-License-Identifier:\nMIT",
    ]
    rows = licenses.scan(frame(spark, texts)).orderBy("doc_id").collect()
    assert [r.labels for r in rows] == [["apache", "mit", "zlib"], ["mpl"], [], [], ["gpl"], ["frobnicate-1.0"], []]
    assert [[t.strictness for t in r.tags] for r in rows] == [[1], [2], [], [], [3], [5], []]
    assert [r.score for r in rows[1:6]] == pytest.approx([0.9, 0, 0, 0.3, 0.9])
    assert all(0 <= r.score <= 1 for r in rows)
    assert "text" not in rows[0].asDict()


def test_op11(spark, small, docs, tmp_path):
    frame(spark, NOTICES + [t for _, t in docs[:50]]).write.parquet(str(tmp_path / "documents.parquet"))
    for folder, texts in ((small, docs), (str(tmp_path), list(enumerate(NOTICES)))):
        rows = {r.doc_id: r for r in QUERIES["op11_license_scan"](spark, folder).collect()}
        for key, text in texts:
            n, places = brute.license_places(text)
            r, at = rows[key], [a for a, _ in places]
            base = ",".join(sorted({label for _, label in places}))
            assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), base)
            assert (r.first_word, r.last_word) == ((min(at), max(at)) if at else (None, None))
            assert set(filter(None, base.split(","))) <= set(r.labels.split(","))
    assert licenses.scan(frame(spark, NOTICES).limit(0)).count() == 0


# --- Ranked search


@pytest.mark.parametrize("leaf,front", [(48, 1 << 13), (1, 1), (1, 1 << 13), (7, 40)])
def test_shard_is_exact(leaf, front, monkeypatch):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "FRONT", front)
    rng = np.random.default_rng(3)
    size, terms = 300, 40
    cells = np.unique(rng.integers(0, size * terms, 2500))
    row = {
        "ids": np.arange(size, dtype=np.int64) * 3,
        "nulls": np.zeros(size, bool),
        "sizes": rng.integers(1, 200, size),
        "terms": np.arange(terms, dtype=np.uint64),
        "holding": np.bincount(cells // size, minlength=terms),
        "docs": (cells % size).astype(np.int32),
        "tf": rng.integers(1, 4, len(cells)),
    }
    weights = {t: int(w) for t, w in enumerate(rng.integers(0, 4000, terms))}
    shard = lexical.Shard({k: v.tobytes() for k, v in row.items()}, weights, size, int(row["sizes"].sum()))
    for _ in range(20):
        query = rng.choice(terms, rng.integers(1, 12), replace=False).tolist()
        gain = lexical.impacts(row["tf"], row["sizes"][row["docs"]], size, int(row["sizes"].sum()))
        scores = np.zeros(size, np.int64)
        for t in query:
            mine = cells // size == t
            np.add.at(scores, row["docs"][mine], weights[t] * gain[mine])
        best = lexical.Best(1, 10)
        found, value = shard.search(query, 10, best.least(0))
        best.add(0, shard.ids[found], value, shard.nulls[found])
        order = [d for d in np.lexsort((row["ids"], -scores)) if scores[d] > 0][:10]
        assert best.ids[0].tolist() == row["ids"][order].tolist()
        assert best.scores[0].tolist() == scores[order].tolist()


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_ranked_search(spark, small, docs, block):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    table = frame(spark, [t for _, t in docs]).repartition(5)
    asked = spark.createDataFrame(items[:6], "item_id long, text string")
    rows = lexical.search(table, asked, 50, block_bytes=block).collect()
    assert sorted(map(tuple, rows)) == sorted(brute.ranked(docs, items[:6]))


def test_ranked_search_edges(spark, monkeypatch):
    monkeypatch.setattr(lexical, "SHARD_BYTES", 40)
    texts = [None, "", "!!", "alpha beta", "Alpha BETA", "alpha", "beta " * 500, "alpha beta", "gamma", "Éa éa", "delta"]
    items = [(1, "alpha beta"), (2, None), (3, "nothing"), (4, "gamma gamma"), (5, "éa"), (6, "ALPHA beta")]
    table, asked = frame(spark, texts), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 2, 50):
        rows = lexical.search(table, asked, k).collect()
        assert sorted(map(tuple, rows)) == sorted(brute.ranked(list(enumerate(texts)), items, k))
    assert lexical.search(table.limit(0), asked).count() == 0
    assert lexical.search(table, asked.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, "gamma"), (None, "gamma")], "item_id long, text string")
    nulls = spark.createDataFrame([(None, "gamma"), (7, "gamma"), (7, "gamma"), (8, "x y z w")], "doc_id long, text string")
    rows = lexical.search(nulls, twice).collect()
    assert sorted((r.rank, r.doc_id or -1) for r in rows) == [(1, 7), (1, 7), (2, 7), (2, 7), (3, -1), (3, -1)]


# --- Periodic runs


def _runs(texts):
    words, first, sizes, _ = periodic._words([t.encode() for t in texts], [None] * len(texts), None)
    start, length, period = periodic.find_runs(words, first, sizes)
    cuts = np.searchsorted(start, np.append(first, len(words)))
    for k in range(len(texts)):
        mine = slice(cuts[k], cuts[k + 1])
        yield list(zip((start[mine] - first[k]).tolist(), length[mine].tolist(), period[mine].tolist()))


def test_extensions():
    rng = np.random.default_rng(4)
    for size, letters in ((1, 1), (5, 1), (14, 2), (200, 1), (400, 2), (1000, 3)):
        words = rng.integers(0, letters, size).astype(np.uint64)
        words[-1] = 99
        lce = periodic.CoverLce(words)
        a, b = rng.integers(0, size, 300), rng.integers(0, size, 300)
        a, b = a[a != b], b[a != b]
        for x, y, got in zip(a, b, lce.of(a, b)):
            want = 0
            while max(x, y) + want < size and words[x + want] == words[y + want]:
                want += 1
            assert got == want


@pytest.mark.parametrize("pairs", [7, 1 << 20])
def test_runs(pairs, monkeypatch):
    monkeypatch.setattr(periodic, "_PAIRS", pairs)
    rnd = random.Random(5)
    texts = ["", "a", "a " * 5, "a " * 6, "a b " * 4, "a b c " * 4 + "d", "a b a " * 7, "a " * 500]
    for k in range(600):
        letters = "abc"[: rnd.randrange(1, 4)] if k % 3 else "abcdefghij"
        words = [rnd.choice(letters) for _ in range(rnd.randrange(1, 60 if k % 3 else 300))]
        a = rnd.randrange(len(words))
        p = 1 + (len(words) - a) // rnd.randrange(3, 9)
        texts.append(" ".join(words[:a] + [words[a + (i - a) % p] for i in range(a, len(words))]))
    for text, got in zip(texts, _runs(texts)):
        assert got == brute.periodic(text.split())[0]


def test_op13(spark, small, docs, tmp_path):
    hard = [None, "", " ", "a", "a " * 9, " a\x0bb\x0c\r" * 40, "é " * 50, "x " * 30000, "a b " * 8 + "c c c c c c c"]
    hard += ["one two three " * 20] * 30
    frame(spark, hard).write.parquet(str(tmp_path / "documents.parquet"))
    for folder, texts in ((small, docs), (str(tmp_path), list(enumerate(hard)))):
        rows = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, folder).collect()}
        assert len(rows) == len(texts)
        for key, text in texts:
            runs, left = brute.periodic(brute.planted_words(key, text)) if len(text or "") < 50000 else ([(0, 30000, 1)], ["x"])
            top = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
            r = rows[key]
            best = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
            assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best)
            assert r.runs_sha256 == brute.sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
            assert r.collapsed_sha256 == brute.sha(" ".join(left))
    assert periodic.mark_runs(frame(spark, hard).limit(0)).count() == 0
    nulls = spark.createDataFrame([(None, "a " * 8), (None, None)], "doc_id long, text string")
    rows = periodic.mark_runs(nulls, key="doc_id", order=lambda key, n: None).collect()
    assert sorted(len(r.runs) for r in rows) == [0, 1]
