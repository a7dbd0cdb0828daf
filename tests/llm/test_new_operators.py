"""Set join, spelling variants and vector codes against brute force, with every kind of trouble."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluice.llm import codes, links, setjoin, spelling
from sluice.llm import texts as X

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


# --- set join ------------------------------------------------------------------------


def shingles(text, k):
    w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute_components(rows, k=5):
    sets = {}
    for key, t in rows:
        sets.setdefault(key, []).append(shingles(t, k))
    parent = {key: key for key in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(x for x in sets if x is not None)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return sets, find


def test_lists_of_hundreds_are_dealt_once(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 240, dtype=np.uint64)
    members = [np.unique(np.concatenate((base[:200], rng.integers(0, 1 << 63, 8 + i % 30, dtype=np.uint64)))) for i in range(600)]
    classes = spark.createDataFrame([(i, bytearray(links.sketch(m))) for i, m in enumerate(members)], "rep bigint, sketch binary")
    rows = spark.createDataFrame([(1, i, len(m), True, True, i) for i, m in enumerate(members)], "token bigint, rep bigint, n bigint, small boolean, home boolean, component bigint")
    assert setjoin._dealt(rows, classes).count() == 599 + 600  # all but one of the components seek, and all are met
    found = {(r["a"], r["b"]) for r in setjoin._crossing(rows, classes, 80, False).collect()}
    alike = lambda a, b: 100 * len(np.intersect1d(members[a], members[b])) >= 80 * len(np.union1d(members[a], members[b]))
    some = [(int(a), int(b)) for a, b in rng.integers(0, 600, (3000, 2)) if a < b]
    assert {p for p in some if alike(*p)} <= found and any(alike(*p) for p in some)


def check_join(spark, rows, got, k=5):
    sets, find = brute_components(rows, k)
    assert len(got) == len(rows)
    for r in got:
        if r["key"] is None:
            assert r["component_id"] is None
        else:
            assert r["component_id"] == find(r["key"]), r
            assert r["n_shingles"] in {len(s) for s in sets[r["key"]]}


@pytest.mark.parametrize("light", [None, 0, 64])
def test_set_join_equals_brute_force(spark, docs, empty, rows, light, monkeypatch):
    if light is not None:  # all sets in lists; short ones by subsets
        monkeypatch.setattr(setjoin, "boundary", lambda *_: light)
    check_join(spark, rows, setjoin.jaccard_join(docs).collect())
    assert setjoin.jaccard_join(empty).count() == 0


def near_group(rng, size, words=90, shift=3):
    """Texts around one base, most of them linked with it and not with each other, some just below the threshold."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for i in range(size):
        own = list(base)
        for at in rng.sample(range(words), rng.randint(1, shift)):
            own[at] = f"x{i}y{at}"
        out.append(" ".join(own))
    return [*out, " ".join(base)]


@pytest.mark.parametrize("common", [True, False])
def test_one_large_group_around_the_threshold(spark, common, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(setjoin, "BLOCK", 16)  # lists of many blocks
    monkeypatch.setattr(setjoin, "SALT_ROWS", 20)  # common shingles over many salts
    monkeypatch.setattr(setjoin, "FIRST_TRIES", 2)
    if not common:
        monkeypatch.setattr(setjoin, "OFTEN", 10**9)
    texts = near_group(rng, 120) + near_group(rng, 40, words=12, shift=1) + near_group(rng, 30, words=5, shift=1)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    check_join(spark, rows, setjoin.jaccard_join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)).collect())


def test_small_sets_are_light_where_lists_are_long(spark):
    """Short texts of frequent shingles: scanning lists would cost more than entering pairs."""
    order = setjoin.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    head = lambda i: bytearray(np.array([1, 2, 3, 10 + i], np.uint64).tobytes())
    crowd = spark.createDataFrame([(i, 10, head(i)) for i in range(600)], "rep bigint, n bigint, head binary")
    assert setjoin.boundary(crowd, order, 80) >= 16
    apart = spark.createDataFrame([(i, 10, bytearray(np.array([100 * i, 100 * i + 1, 100 * i + 2], np.uint64).tobytes())) for i in range(600)], "rep bigint, n bigint, head binary")
    assert setjoin.boundary(apart, order, 80) == 0


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(0)
    for n in (4, 9, 50, 700, 5000):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            apart = rng.integers(0, 1 << 63, 2 * max(1, n // 9), dtype=np.uint64)
            a, b = np.concatenate([both, apart[::2]]), np.concatenate([both, apart[1::2]])
            if 100 * n >= 80 * (len(a) + len(b) - n):
                marks = [np.frombuffer(links.sketch(x), np.uint64)[None] for x in (a, b)]
                assert links.possible(*marks, np.array([len(a)]), np.array([len(b)]), 80)[0]


def test_first_members_are_enough_for_every_pair_of_sizes():
    for n in range(1, 120):
        for m in range(n, n * 100 // 80 + 1):
            need = -(-80 * (n + m) // 180)
            if need <= n:
                assert m - need + 1 <= setjoin.probes(m, 80) and n - need + 1 <= setjoin.indexed(n, 80)


# --- spelling ------------------------------------------------------------------------


def brute_variants(rows, least_length=6, least_count=5, ratio=5):
    counts = Counter()
    for key, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate({i: i + 32 for i in range(65, 91)})
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            if h % 199 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    vocab = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))

    found = {a: sorted((b for b in vocab if near(a, b)), key=lambda b: (-vocab[b], b)) for a in vocab}
    form = {a: b[0] for a, b in found.items() if b and vocab[b[0]] >= ratio * vocab[a]}

    def root(a):
        while a in form:
            a = form[a]
        return a

    return {(a, vocab[a], len(found[a]), form.get(a), vocab.get(form.get(a)), root(a)) for a in vocab}


def spelled_rows():
    rng = random.Random(9)
    words = ["thoning", "thonin", "thonings", "thonixg", "garçons", "garcons", "garçon", "Établir", "établir", "aaaaaa", "aaaaaaa", "bananas", "banana", "rootword", "rootwort", "rootwor", "rootworx", "harbours", "harbors", "harbrs"]
    weights = [400, 60, 70, 9, 90, 12, 15, 20, 40, 50, 7, 300, 40, 500, 90, 16, 6, 500, 80, 9]
    rows = [(i, " ".join(rng.choices(words, weights, k=70)).replace("a b", "a, B").replace("on ", "ON ")) for i in range(40)]
    return [*rows, (None, "thoning " * 7), (50, None), (51, ""), (52, "1 2 %"), (53, "Thoning" * 2000 + " thoning"), (3, rows[3][1]), (54, "×÷×÷×÷ " * 9)]


@pytest.mark.parametrize("most", [spelling.ROUND_BYTES, 64])
def test_variants_equal_brute_force(spark, most, monkeypatch):
    monkeypatch.setattr(spelling, "SLICE_BLOCKS", 1 if most == 64 else spelling.SLICE_BLOCKS)  # one block a round
    rows = spelled_rows()
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id bigint, text string, word string, n int, near int").repartition(4)
    got = spelling.variants(df, most=most).collect()
    assert {tuple(r) for r in got} == brute_variants(rows) and len(got) == len({r["word"] for r in got})
    assert any(r["form"] and r["root"] != r["form"] for r in got)
    assert spelling.variants(df.where("false")).count() == 0


def test_filters_know_all_words_and_few_others(spark):
    words = [f"{a}{b}{c}ord{d}" for a in "abcdefgh" for b in "ijklmnop" for c in "qrstuvwx" for d in "yzé"]
    vocab = spark.createDataFrame([(w, 9) for w in words], "word string, n bigint")
    blocks = -(-len(words) // spelling.WORDS_PER_BLOCK)
    row = spelling._slices(vocab, {7: blocks}).collect()
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in sorted(row, key=lambda r: r["slice"])), np.uint64).reshape(-1, 8)
    own = spelling.Filter(7, blocks, 0, bits)
    matrix = lambda w: spelling.Spelled(np.frombuffer("".join(w).encode("latin-1"), np.uint8).reshape(len(w), 7))
    assert own.knows(matrix(words).hashes()).all()
    rng = random.Random(1)
    others = ["".join(rng.choices("abcdefghij", k=7)) for _ in range(20_000)]
    assert own.knows(matrix(others).hashes()).mean() < 0.01


def test_edits_have_the_hashes_of_their_words():
    word = "garçons"
    own = spelling.Spelled(np.frombuffer(word.encode("latin-1"), np.uint8)[None])
    plain = lambda w: spelling.Spelled(np.frombuffer(w.encode("latin-1"), np.uint8)[None]).hashes()[0]
    assert own.deletions()[0].tolist() == [plain(word[:i] + word[i + 1 :]) for i in range(7)]
    assert own.replacements(ord("é"))[0].tolist() == [plain(word[:i] + "é" + word[i + 1 :]) for i in range(7)]


# --- vector codes --------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(k, v, lab) for k, v, lab in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    order = lambda r: (r[0] is None, r[0] or 0, [int(np.floor(scale * x)) for x in r[1]])
    kept.sort(key=order)
    dim = len(kept[0][1])
    kept = [r for r in kept if len(r[1]) == dim]
    v = np.array([[int(np.floor(scale * x)) for x in r[1]] for r in kept], np.int64)
    cut = [dim * p // parts for p in range(parts + 1)]
    books = [v[:entries, cut[p] : cut[p + 1]].copy() for p in range(parts)]
    for step in range(rounds + 1):
        gaps = [((v[:, None, cut[p] : cut[p + 1]] - books[p][None]) ** 2).sum(axis=2) for p in range(parts)]
        code = [g.argmin(axis=1) for g in gaps]
        for p in range(parts) if step < rounds else ():
            for e in range(len(books[p])):
                if (code[p] == e).any():
                    books[p][e] = v[code[p] == e, cut[p] : cut[p + 1]].sum(axis=0) // (code[p] == e).sum()
    error = sum(g.min(axis=1) for g in gaps)
    labels = Counter()
    for r, e in zip(kept, error):
        labels[r[2]] += int(e)
    found = sorted((str(r[0]), bytes(int(c[i]) for c in code), int(error[i]), labels[r[2]]) for i, r in enumerate(kept))
    return found, [b.tolist() for b in books]


def vector_rows(n=700, dim=16, seed=6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    rows = [(i + 3, (centres[i % 9] + 0.2 * rng.normal(size=dim)).tolist(), [None, 1, 2][i % 3] if i % 4 else 1) for i in range(n)]
    rows += [(9000 + i, rows[5][1], 2) for i in range(40)] + [(1, None, 1), (2, [1.0, None] * (dim // 2), 1), (9100, [float("nan")] * dim, 2), (9101, [float("-inf")] * dim, None)]
    return [*rows, (9102, [], 1), (9103, [0.5] * (dim - 1), 1), (9104, [0.0] * dim, None), (None, rows[7][1], 1), (10, rows[9][1], 2), (10, rows[9][1], 2)]


@pytest.mark.parametrize("dim", [16, 21])
def test_codes_equal_brute_force(spark, dim):
    rows = vector_rows(dim=dim)
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], "vec_id bigint, embedding array<double>, label int, key int, code string").repartition(5)
    coded = codes.encode(df)
    found, books = brute_codes(rows)
    got = codes.with_label_errors(coded.rows).collect()
    assert sorted((str(r["key"]), bytes(r["code"]), r["error"], r["label_error"]) for r in got) == found
    assert coded.books == books


def test_ties_go_to_the_lower_entry_and_unused_entries_stay(spark):
    rows = [(i, [float(i % 3)] * 8, 1) for i in range(40)]  # entries repeat: only the first of equal ones is used
    coded = codes.encode(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))
    found, books = brute_codes(rows)
    got = codes.with_label_errors(coded.rows).collect()
    assert sorted((str(r["key"]), bytes(r["code"]), r["error"], r["label_error"]) for r in got) == found and coded.books == books


def test_few_vectors_and_none(spark):
    schema = "vec_id bigint, embedding array<float>, label int"
    few = [(5, [1.0] * 8, 1), (4, [2.0] * 8, None)]
    coded = codes.encode(spark.createDataFrame(few, schema))
    assert [len(b) for b in coded.books] == [2] * 8 and {r["error"] for r in coded.rows.collect()} == {0}
    nothing = codes.encode(spark.createDataFrame([(1, None, 1)], schema))
    assert nothing.books == [] and codes.with_label_errors(nothing.rows).count() == 0
    with pytest.raises(Exception, match="cannot be summed exactly"):
        codes.encode(spark.createDataFrame([(1, [1e9] * 8, 1)], schema))


def test_bounds_settle_most_parts_unseen():
    """After the entries have moved a little, most parts keep their entry without being measured, and all are right."""
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (16, 4))
    vectors = centres[rng.integers(0, 16, 3000)] + rng.integers(-60, 60, (3000, 4))
    bounds = codes.Bounds.fresh(vectors, centres, 4)
    book = centres + rng.integers(-9, 9, centres.shape)
    bounds.moved(np.sqrt(((book - centres) ** 2).sum(axis=1)) * (1 + codes.EASE))
    depth = bounds.settle(vectors, book)
    assert (bounds.code == ((vectors[:, None] - book[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
    assert (depth == 0).mean() > 0.8 and codes.needed(np.bincount(depth, minlength=10).tolist()) < 4
    for b in (1, 8, 2):  # cut, filled up with the outer bound, cut again
        bounds = bounds.widened(b)
        far = book + rng.integers(-2000, 2000, book.shape)
        bounds.moved(np.sqrt(((far - book) ** 2).sum(axis=1)) * (1 + codes.EASE))
        bounds.settle(vectors, far)
        assert (bounds.code == ((vectors[:, None] - far[None]) ** 2).sum(axis=2).argmin(axis=1)).all()
        book = far


def test_forgotten_tables_are_gone(spark):
    written = X.written(spark.range(5).select(F.col("id")))
    assert written.count() == 5
    X.forget(written)
    with pytest.raises(Exception, match="(?i)path|exist|not found"):
        spark.read.parquet(written.scratch_path).count()
