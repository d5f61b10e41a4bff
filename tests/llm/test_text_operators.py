"""Encoding, token files, contamination, near copies and repeats against plain versions."""

import base64
import random
import zlib

import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from calltide.llm import bpe, common, decontaminate, jaccard, suffixes, tokens
from calltide.llm.queries import QUERIES
from calltide.session import materialise

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
EDGES = ["", None, "a", " ", "  \n\t ", "é", "ab " * 3000, "x" * 5000, "one two three", "one two three four", "🙂 naïve"]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def docs(spark, small):
    return [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]


def frame(spark, texts, first=0):
    """Documents with null and clashing columns."""
    rows = [(first + k, text) for k, text in enumerate(texts)]
    extra = {c: F.lit(k) for k, c in enumerate(("ids", "score", "row", "part", "key", "start", "n", "component", "hits"))}
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns(extra)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


# --- Byte-level BPE


def test_codec(reference):
    codec = bpe.Codec.load(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(1)
    letters = "ab's  \n\t\x1c\x85　\xa0é1½²!._T​"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(3000)]
    for text in [*texts, *(x for x in EDGES if x), "a" * 20000, "abc" * 9000, "!?" * 3000]:
        ids = np.frombuffer(codec.encode(text), np.int32)
        assert ids.tolist() == reference.encode_ordinary(text)
        assert codec.decode(ids)[0].tobytes() == text.encode()


def test_small_cache(reference):
    codec = bpe.Codec.load(RANKS, public_tokenizers.PATTERN)
    codec.words.limit = codec.pieces.limit = 3
    text = "one two three four five six one two three seven eight one"
    for _ in range(3):
        assert np.frombuffer(codec.encode(text), np.int32).tolist() == reference.encode_ordinary(text)


def test_pre_tokens_share_a_queue(reference, monkeypatch):
    codec = bpe.Codec.load(RANKS, public_tokenizers.PATTERN)
    alone, one = [], codec.piece
    monkeypatch.setattr(codec, "piece", lambda data: alone.append(data) or one(data))
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("aabcd's \n\u00e9.") for _ in range(rnd.randrange(80))) for _ in range(5000)]
    texts += ["", "a" * 64, "ab" * 32 + " " + "\u00e9" * 33, "", "x" * 5000]
    for limit in (1000, 100_000):
        codec.pieces.limit = limit
        codec._forget()
        ids, sizes = codec.encode_all(texts)
        want = [reference.encode_ordinary(text) for text in texts]
        assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [x for one in want for x in one]
    assert min(map(len, alone)) > bpe.SHORT  # only long ones have a queue of their own


def test_decoding_takes_steps():
    import tracemalloc

    codec = bpe.Codec.load(RANKS, public_tokenizers.PATTERN)
    ids = np.frombuffer(codec.encode("some words of a text " * 200_000), np.int32)
    tracemalloc.start()
    data, sizes = codec.decode(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert data.tobytes() == b"some words of a text " * 200_000 and sizes.sum() == len(data)
    assert peak < 15 * len(data)


def test_encode_and_decode(spark, reference):
    df = frame(spark, EDGES)
    coded = bpe.encode(df, RANKS, public_tokenizers.PATTERN, keep_text=True)
    assert coded.columns[-1] == "ids" and set(coded.columns) == set(df.columns)
    rows = by_id(bpe.decode(coded, RANKS, public_tokenizers.PATTERN))
    for k, text in enumerate(EDGES):
        assert rows[k].ids == reference.encode_ordinary(text or "")
        assert bytes(rows[k].decoded) == (text or "").encode()
    assert bpe.encode(df.limit(0), RANKS, public_tokenizers.PATTERN).count() == 0
    nulls = spark.createDataFrame([(1, None), (2, [64])], "doc_id long, ids array<int>")
    assert bytes(by_id(bpe.decode(nulls, RANKS, public_tokenizers.PATTERN))[1].decoded) == b""


def test_op1(spark, small, docs, reference):
    rows = by_id(QUERIES["op1_byte_bpe"](spark, small))
    assert len(rows) == len(docs)
    for key, text in docs:
        ids = reference.encode_ordinary(text)
        want = (len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text))
        assert tuple(rows[key])[1:] == want


# --- Token files


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000])
def test_blocks(size):
    rng = np.random.default_rng(size)
    values = rng.integers(0, 60000, size).astype(np.uint32)
    values[rng.random(size) < 0.03] = 0xFFFFFFFF
    values[: size // 2] %= 7
    data, starts = tokens.pack(values)
    assert (tokens.unpack(np.frombuffer(data, np.uint8), starts)[:size] == values).all()
    content = tokens.write_file(values, [5, None], np.array([size // 3, size - size // 3]))
    file = tokens.TokenFile(content)
    assert file.nulls.tolist() == [False, True] and file.ids[0] == 5
    for a, b in ((0, size), (size // 3, size), (size // 2, size // 2 + size // 5)):
        assert (file.values(a, b) == values[a:b]).all()
    with pytest.raises(ValueError):
        tokens.TokenFile(content[: len(content) // 2][:40])
    with pytest.raises(ValueError):
        tokens.TokenFile(b"X" + content[1:])


def test_words_are_remembered(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    rnd = random.Random(8)
    letters = "ab's  \n\t\x1c\x85\u3000\xa0\u00e91\u00bd!._T\u0120\u200b<|>"
    for limit in (1 << 20, 5):
        monkeypatch.setattr(tokens, "CACHE_WORDS", limit)
        for size in (1, 3, 200):
            texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(size)]
            texts += ["one two three four " * 20, "<|endoftext|> one two", "", " "]
            got = encoder.encode(texts, b"")
            want = plain.encode_batch(texts, add_special_tokens=False)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [x.ids for x in want]
    assert encoder.encode([], b"") == []


def test_new_words_go_to_the_library_together(monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoder = tokens.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    asked, ids = [], encoder._ids
    monkeypatch.setattr(encoder, "_ids", lambda texts: asked.append(texts) or ids(texts))
    texts = ["one two  three", "two one\tfour ", " one", "two", "", "three one two"]
    for _ in range(2):
        got = encoder.encode(texts, b"")
        assert [np.frombuffer(x, "<u4").tolist() for x in got] == [plain.encode(x, add_special_tokens=False).ids for x in texts]
    assert len([x for x in asked if x]) == 2 and len(encoder.words) == encoder.rows.count


def _token_rows(texts, keys):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    start, out = 0, []
    for key, code in zip(keys, tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
        ids = [*code.ids, 2]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_files(spark):
    texts = [*EDGES, "a <|endoftext|> b", "<|endoftext|>", "<|endoftext", "x<|endoftext|><|endoftext|> y z " * 50, "same", "same"]
    df = frame(spark, texts).repartition(3)
    files = tokens.write_tokens(df, public_tokenizers.path("byte_bpe_50k.json"), 2, file_tokens=50)
    files = materialise(files, "files")
    assert files.count() >= 3
    got = tokens.read_tokens(files).select("doc_id", "start", F.length("ids") / 4, F.crc32("ids")).orderBy("start")
    assert [tuple(r) for r in got.collect()] == _token_rows(texts, range(len(texts)))
    empty = tokens.write_tokens(df.limit(0), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert tokens.read_tokens(materialise(empty, "files")).count() == 0
    odd = spark.createDataFrame([(None, "n"), (4, "b"), (4, "a"), (4, "a")], "doc_id long, text string")
    files = materialise(tokens.write_tokens(odd, public_tokenizers.path("byte_bpe_50k.json"), 2), "files")
    rows = tokens.read_tokens(files).collect()
    assert sorted(r.start for r in rows) == [0, 2, 4, 6] and [r.doc_id for r in rows if r.start == 0] == [None]


def test_op7(spark, small, docs):
    got = QUERIES["op7_token_files"](spark, small).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == _token_rows([t for _, t in docs], [k for k, _ in docs])


# --- Contamination


def _contamination(rows):
    return [(r.n_words, sum(h.stop - h.start for h in r.hits), list(r["items"]), bool(r.hits)) for r in rows]


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_matches(spark, block_bytes):
    rnd = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    items = [(k, text(rnd.randrange(1, 25))) for k in range(8)] + [(9, None), (10, ""), (None, "z y x"), (3, "other text of three")]
    texts = [text(40) for _ in range(20)]
    texts += [f"a {items[k][1].upper()}! b {items[k][1]}" for k in range(6)] + ["z, y. x", "z y", *EDGES, items[0][1]]
    df = frame(spark, texts)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    rows = decontaminate.matches(df, bench, window=5, block_bytes=block_bytes).orderBy("doc_id").collect()
    assert _contamination(rows) == brute.contaminated(list(enumerate(texts)), items, 5)
    assert max(r.longest for r in rows) >= 5
    assert decontaminate.matches(df.limit(0), bench).count() == 0
    clean = decontaminate.matches(df, bench.limit(0)).agg(F.sum(F.size("hits"))).first()[0]
    assert clean == 0


def test_longest_match(spark):
    words = " ".join(f"u{k}" for k in range(30))
    bench = spark.createDataFrame([(1, words)], "item_id long, text string")
    row = decontaminate.matches(frame(spark, [f"x {' '.join(words.split()[4:21])} y"]), bench).first()
    assert row.longest == 17 and [(h.start, h.stop) for h in row.hits] == [(1, 18)]


def test_op3(spark, small, docs):
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").select("item_id", "text").collect()]
    rows = by_id(QUERIES["op3_decontaminate"](spark, small))
    for (key, _), (words, hits, found, bad) in zip(docs, brute.contaminated(docs, items)):
        assert tuple(rows[key])[1:] == (words, hits, len(found), brute.sha(",".join(found)), bad)
    assert any(r.contaminated for r in rows.values())


# --- Near copies


def _near_texts(rnd, groups=12):
    words = [f"w{k}" for k in range(300)]
    texts = []
    for g in range(groups):
        base = [rnd.choice(words) for _ in range(rnd.choice([4, 5, 7, 9, 12, 20, 60, 200]))]
        for _ in range(rnd.randrange(1, 12)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 3)):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            copy += [rnd.choice(words) for _ in range(rnd.randrange(0, 2))]
            texts.append(" ".join(copy).upper() if rnd.random() < 0.2 else " ".join(copy))
    return texts


@pytest.mark.parametrize(("light", "words", "least"), [(None, 4, (85, 100)), (0, 4, (85, 100)), (300, 4, (85, 100)), (12, 5, (80, 100))])
def test_join(spark, light, words, least):
    texts = [*_near_texts(random.Random(light or 5)), *EDGES, "one two three", "A b", "a  B"]
    df = frame(spark, texts).repartition(3)
    rows = by_id(jaccard.join(df, words, least, light))
    want = brute.classes(list(enumerate(texts)), words, least)
    assert {k: tuple(r)[1:] for k, r in rows.items()} == want


def test_join_of_odd_ids(spark):
    odd = spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, None)], "doc_id long, text string")
    rows = sorted(map(tuple, jaccard.join(odd).collect()), key=str)
    assert rows == [(4, 1, 4), (4, 1, 4), (5, 0, 5), (None, 1, 4)]
    assert jaccard.join(odd.limit(0)).count() == 0


def test_boundary_follows_cost():
    sizes = {5: 100, 30: 100, 400: 100}
    assert jaccard.boundary(sizes, 0.0) < jaccard.boundary(sizes, 5.0) < 400

def test_parity_sketches_reject_no_link():
    """Sketches are never further apart than their sets, and tell pairs of 0.8 apart."""
    rng = np.random.default_rng(17)
    least = (85, 100)
    for n in (1, 3, 40, 300, 900, 4000):
        for lost in (0, n // 14, n // 12, n // 9, n // 5):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2))
            b = np.unique(np.concatenate([a[lost:], rng.integers(0, 2**63, lost, dtype=np.uint64)]))
            rows = [jaccard._sketch(x).view(np.uint64)[None] for x in (a, b)]
            apart, fine = jaccard._apart(*rows, np.array([len(a)]), np.array([len(b)]), least)
            both = len(np.intersect1d(a, b))
            assert apart[0] * (len(a) + len(b)) <= len(a) + len(b) - 2 * both + 1e-6
            link = jaccard.links(a, b, least)
            assert fine[0] or not link
            sizes = len(a), len(b)
            may = jaccard._may_link(*(jaccard._fine_sketch(x).tobytes() for x in (a, b)), *sizes, least)
            assert may or not link
            if n >= 300 and lost >= n // 9:  # a similarity of 0.8 or less
                assert not link and not may and (n > 300 or not fine[0])
    # Bitmaps of unequal sizes are folded.
    a, b = np.arange(1000, dtype=np.uint64) << np.uint64(20), np.arange(1060, dtype=np.uint64) << np.uint64(20)
    bits = [jaccard._fine_sketch(x).tobytes() for x in (a, b)]
    assert len(bits[0]) < len(bits[1]) and jaccard._may_link(*bits, 1000, 1060, least)
    assert not jaccard._may_link(*bits, 1000, 1060, (99, 100))


def test_op9(spark, small, docs):
    rows = by_id(QUERIES["op9_ngram_jaccard"](spark, small))
    assert {k: tuple(r)[1:] for k, r in rows.items()} == brute.classes(docs)


def test_only_sets_that_may_link_travel_whole(spark, monkeypatch):
    """Sets that reject each other by their bitmaps are not made whole."""
    made, real = [], jaccard._made

    def counted(docs, wanted, words, value):
        made.append((value is jaccard._fine_sketch, wanted.count()))
        return real(docs, wanted, words, value)

    monkeypatch.setattr(jaccard, "_made", counted)
    texts = [" ".join(f"v{k}" if j % 65 == 9 * k else f"w{j}" for j in range(1200)) for k in range(5)]  # about 0.77
    texts += [" ".join(f"x{j}" for j in range(k, 600)) for k in (0, 3)]
    docs = frame(spark, texts).select("doc_id", "text")
    named = materialise(jaccard._named(jaccard._survey(docs, 4)))
    name = {r.doc_id: r.name for r in named.collect()}
    pairs = spark.createDataFrame([(name[0], name[k]) for k in range(1, 5)] + [(name[5], name[6])], "a long, b long")
    assert [tuple(x) for x in jaccard._checked(pairs, docs, named, 4, (85, 100)).collect()] == [(name[5], name[6])]
    assert made == [(True, 7), (False, 2)]


def test_linked_sets_meet_in_a_main_entry():
    """The entries of the later rounds are fewer, and no linked pair is lost."""
    rng = np.random.default_rng(5)
    order, least = jaccard._Order(np.empty(0, np.uint64), np.empty(0, np.int64)), (85, 100)
    linked = 0
    for n in rng.integers(1, 400, 300).tolist():
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        lost = int(rng.integers(0, n // 10 + 1))
        b = np.unique(np.concatenate([a[rng.permutation(len(a))[lost:]], rng.integers(0, 2**63, lost, dtype=np.uint64)]))
        for light in (0, 40):
            (ka, sa), (kb, sb) = (jaccard._keys(x, order, light, least) for x in (a, b))
            main = [k[s >= jaccard._MAIN] for k, s in ((ka, sa), (kb, sb))]
            assert (sa & ~jaccard._MAIN == len(a)).all() and (len(main[0]) < len(ka) or len(a) < 2 * jaccard.COMMON or len(a) <= light)
            if jaccard.links(a, b, least):
                linked += 1
                assert len(np.intersect1d(*main))
    assert linked > 200


def test_checked_pairs_of_repeated_ids(spark):
    """Rows of the same id and text are one set, those of another text are none."""
    rows = [(k % 3 if k % 4 else None, " ".join(f"w{j}" for j in range(k % 2, 40 + k % 2))) for k in range(24)]
    docs = spark.createDataFrame([*rows, (0, "another text with the same id")], "doc_id long, text string")
    named = jaccard._named(materialise(jaccard._survey(docs, 4)))
    sets = [x["name"] for x in named.orderBy("name").where("n > 5").collect()]
    pairs = spark.createDataFrame([tuple(sets)], "a long, b long")
    assert [tuple(x) for x in jaccard._checked(pairs, docs, named, 4, (85, 100)).collect()] == [tuple(sets)]


# --- Repeats


@pytest.mark.parametrize("run_bytes", [40, 400, 1 << 20])
def test_merged_transforms(run_bytes):
    rnd = random.Random(run_bytes)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randrange(0, 40))) for _ in range(60)]
    for length in (3, 8, 20):
        string, start, block = suffixes.repeated_windows(strings, length, run_bytes)
        places, got = {}, {}
        for k, one in enumerate(strings):
            for a in range(len(one) - length + 1):
                places.setdefault(one[a : a + length], set()).add((k, a))
        for k, a, b in zip(string.tolist(), start.tolist(), block.tolist()):
            got.setdefault(b, set()).add((k, a))
        assert sorted(map(sorted, got.values())) == sorted(sorted(p) for p in places.values() if len(p) > 1)


def _repeat_texts(rnd):
    words = [f"w{k}é" for k in range(500)]
    passage = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    shared = [passage(rnd.randrange(15, 60)) for _ in range(5)]
    texts = []
    for _ in range(40):
        parts = [passage(rnd.randrange(0, 20)), rnd.choice(shared)[rnd.randrange(30) :], passage(3), rnd.choice(shared)]
        texts.append(" ".join(parts))
    return [*texts, texts[3], texts[3], "ab" * 400, "q" * 99, "q" * 100, "q" * 150, *EDGES]


@pytest.mark.parametrize("hot", [0, 4096])
def test_remove(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT_FRAGMENTS", hot)
    texts = _repeat_texts(random.Random(7))
    rows = by_id(suffixes.remove(frame(spark, texts).repartition(3)))
    for k, (_, removed, spans, kept) in enumerate(brute.repeats(texts)):
        got = rows[k]
        assert bytes(got.kept) == kept and len(got.removed) == spans
        assert sum(s.stop - s.start for s in got.removed) == removed


def test_remove_in_segments(spark, monkeypatch):
    texts = _repeat_texts(random.Random(8))
    monkeypatch.setattr(suffixes, "CHUNK", 300)
    data, offsets = np.frombuffer("".join(t or "" for t in texts).encode(), np.uint8), None
    sizes = [len((t or "").encode()) for t in texts]
    offsets = np.cumsum([0, *sizes])
    whole = {(int(s), int(c)) for s, c in zip(*suffixes.anchors(data, offsets)[2:])}
    windows = {s + k for s, c in whole for k in range(c)}
    want = {int(a) + k for a, n in zip(offsets, sizes) for k in range(n - 99)}
    assert windows == want  # every window has its anchor


def _deepest(node) -> int:
    """Python steps of one task, at most."""
    below = [_deepest(node.children().apply(k)) for k in range(node.children().size())]
    own = "Arrow" in node.nodeName()
    return own + max(below, default=0) if "Exchange" not in node.nodeName() else 0


def test_tasks_have_one_python_step(spark):
    """Every further step of a task is a worker more, that waits beside the others later."""
    texts = ["a" * 300, "b" * 150 + "é" * 200, None, "b" * 150 + "c" * 90, "short"]
    docs = frame(spark, texts)
    left = suffixes.remove(docs, as_text=True)
    plan = left._jdf.queryExecution().sparkPlan()
    assert _deepest(plan) == 1
    want = by_id(suffixes.texts_left(suffixes.remove(docs)))
    got = by_id(left)
    assert {k: r.text for k, r in got.items()} == {k: r.text for k, r in want.items()}
    assert set(got[0].asDict()) == set(want[0].asDict())


def test_among(spark):
    docs = spark.createDataFrame([(k if k < 500 else None, k) for k in range(501)], "k int, n int")
    rows = spark.createDataFrame([(7,), (None,), (499,)], "row long")
    some = {x.n for x in common.among(docs, "k", rows).collect()}
    others = {x.n for x in common.among(docs, "k", rows, False).collect()}
    assert some >= {7, 499, 500} and len(some) < 20 and some.isdisjoint(others) and len(some | others) == 501
    assert common.among(docs, "k", rows.limit(0)).count() == 0


def test_lean_tasks_keep_nothing(monkeypatch):
    """A task lets go of what its worker kept, and gives free memory back when it ends."""
    steps = []
    monkeypatch.setattr(common, "give_back", lambda: steps.append("back"))
    monkeypatch.setattr(common, "_HELD", {"other": 1})

    @common.lean
    def run(batches):
        steps.append(dict(common._HELD))
        yield from batches

    assert list(run(iter([1, 2]))) == [1, 2]
    assert steps == ["back", {}, "back"]


def test_remove_odd_rows(spark):
    text = "".join(chr(97 + (k * k) % 26) for k in range(300)) + "end of the text, which is long enough " * 3
    odd = spark.createDataFrame([(None, text), (4, text), (4, text), (5, None)], "doc_id long, text string")
    rows = suffixes.remove(odd).collect()
    kept = sorted((str(r.doc_id), len(r.kept) > 0) for r in rows)
    assert kept == [("4", False), ("4", False), ("5", False), ("None", True)]
    assert suffixes.remove(odd.limit(0)).count() == 0


def test_op8(spark, small, docs):
    rows = by_id(QUERIES["op8_suffix_dedup"](spark, small))
    for (key, _), (size, removed, spans, kept) in zip(docs, brute.repeats([t for _, t in docs])):
        assert tuple(rows[key])[1:] == (size, removed, spans, brute.sha(kept))
