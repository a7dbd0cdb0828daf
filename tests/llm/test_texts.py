import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import coder, packing, suffixes
from sluice.llm import texts as X
from sluice.llm.tokens import Encoder, tokenizer, vocabulary


def test_words_and_shingles_are_those_of_a_plain_reading(rows):
    texts = [t for _, t in rows]
    for kind, pattern in ((X.SPACED, rb"[^\x20\x09-\x0D]+"), (X.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        body, at = X.raw(pa.array(texts, pa.string()))
        starts, ends, first = X.words(body, at, kind)
        seen = {}
        h = X.word_hashes(body, starts, ends)
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").encode().lower() if (t or "").isascii() else bytes(c + 32 if 65 <= c <= 90 else c for c in (t or "").encode()))
            own = slice(first[i], first[i + 1])
            assert [bytes(body[a:b]).translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))) for a, b in zip(starts[own], ends[own])] == want
            for word, value in zip(want, h[own].tolist()):
                assert seen.setdefault(word, value) == value
        assert len(set(seen.values())) == len(seen)
        for i, s in enumerate(X.text_sets(body, at, kind, 4)):
            n = int(first[i + 1] - first[i])
            words = [bytes(body[a:b]).lower() for a, b in zip(starts[first[i] : first[i + 1]], ends[first[i] : first[i + 1]])]
            assert len(s) == len({tuple(words[j : j + 4]) for j in range(max(1, n - 3))} if n else ())


def test_steps_cover_all_rows_whole(rows):
    batch = pa.record_batch([pa.array([t for _, t in rows], pa.string())], names=["text"])
    got = [t for part, _, _ in X.steps(iter([batch.slice(0, 0), batch]), limit=64) for t in part.column("text").to_pylist()]
    assert got == [t for _, t in rows]


def test_ids_equal_the_tokenizers(rows):
    more = ["né, é. É! ×, ÷. —, «a».", "e\u0301, x\u0301.", "İstanbul, ΣΑΣ. ΟΔΟΣ", "日本語。テキスト, 1234,5", "x\x0by\x0cz\x1cq", "'s 't, we'll", "<|startoftext|>,y <3,4", "=\u0338,", "½, ﬁ, ẞ"]
    texts = [t or "" for _, t in rows] + more
    encode = Encoder(vocabulary())
    for _ in range(2):  # the second time from memory
        ids, sizes = encode(*X.raw(pa.array(texts)))
        want = [x.ids + [1] for x in tokenizer(vocabulary()).encode_batch(texts, add_special_tokens=False)]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 65534), max_size=3000), st.integers(1, 40))
def test_coder_round_trip(ids, kinds):
    for values in (np.array(ids, np.uint32), np.array([i % kinds for i in ids], np.uint32)):
        blocks = coder.split(values)
        coded = coder.encode(blocks)
        assert [b.tolist() for b in coder.decode(coded)] == [b.tolist() for b in blocks]
        for block, own in zip(blocks, coded):  # every block stands alone
            assert coder.decode([own])[0].tolist() == block.tolist()
            assert coder.encode([block])[0][2] == zlib.crc32(block.astype("<u4").tobytes())


def test_coder_gains_from_contexts_and_finds_damage():
    rng = np.random.default_rng(3)
    random = rng.integers(0, 30000, 8192)
    again = np.tile(rng.integers(0, 30000, 64), 128)
    size = lambda ids: sum(len(b) for b, _, _ in coder.encode(coder.split(ids)))
    assert size(again) < size(random) / 4
    data, n, crc = coder.encode(coder.split(random[:1024]))[0]
    with pytest.raises(ValueError):
        coder.decode([(data[:500] + bytes([data[500] ^ 1]) + data[501:], n, crc)])


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=300) | st.text("ab", min_size=1, max_size=300).map(str.encode))
def test_suffix_array_and_common_prefixes(data):
    text = np.frombuffer(data, np.uint8)
    order = suffixes.suffix_array(text)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    shared = suffixes.common_prefixes(text, order, 20)
    for k in range(1, len(data)):
        a, b = data[order[k - 1] :][:20], data[order[k] :][:20]
        assert shared[k] == next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 40), max_size=30))
def test_plan_is_a_packing(histogram):
    runs, sequences = packing.plan(histogram, 60)
    placed, held = {}, {}
    for n, rank, count, first, offset in runs:
        for i in range(count):
            assert placed.setdefault((n, rank + i), True)
            held.setdefault(first + i, []).append((offset, n))
    assert len(placed) == sum(histogram.values()) == len([x for s in held.values() for x in s])
    assert sorted(held) == list(range(sequences))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 60
        assert sum(3 * n > 60 for _, n in parts) <= 2
    assert sequences <= 1.3 * -(-sum(n * c for n, c in histogram.items()) // 60) + 1 + sum(c for n, c in histogram.items() if 2 * n > 60)
