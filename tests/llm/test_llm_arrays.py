"""The array helpers, indexes and the coder against plain Python."""

import random

import numpy as np
import pyarrow as pa
import pytest

import brute
from tabwright.llm import arrays, chunks, coder, esais, fmindex, repeats


def texts_of(rows, limit=1 << 21):
    return list(arrays.slices(pa.array(rows, pa.string()), limit))


ROWS = [None, "", "a", " a  b\tc\n", "é ß 字", "x" * 50, "one two three four five six", "   ", "one two"]


@pytest.mark.parametrize("limit", [1, 10, 1 << 21])
def test_words(limit):
    found = []
    for texts in texts_of(ROWS, limit):
        words = arrays.words_of(texts)
        assert words.first[-1] == len(words.starts)
        for row in range(texts.rows):
            found.append([texts.data[words.starts[i]:words.ends[i]].tobytes().decode()
                          for i in range(words.first[row], words.first[row + 1])])
            assert (words.row[words.first[row]:words.first[row + 1]] == row).all()
    assert found == [brute.words(t) for t in ROWS]


def test_hashes_tell_words_and_grams_apart():
    rng = random.Random(1)
    rows = [" ".join(rng.choice(["ab", "ba", "aab", "b"]) for _ in range(rng.randint(0, 30))) for _ in range(200)]
    seen, grams_seen = {}, {}
    for texts in texts_of(rows, 500):
        words = arrays.words_of(texts)
        codes = arrays.word_hashes(texts.data, words)
        grams, begins = arrays.grams(codes, words.first, 3)
        for row in range(texts.rows):
            own = texts.text(row).decode().split()
            for word, code in zip(own, codes[words.first[row]:words.first[row + 1]]):
                assert seen.setdefault(word, code) == code
            assert begins[row + 1] - begins[row] == max(len(own) - 2, 0)
            for k in range(len(own) - 2):
                code = grams[begins[row] + k]
                assert grams_seen.setdefault(tuple(own[k:k + 3]), code) == code
    assert len(set(seen.values())) == len(seen) and len(set(grams_seen.values())) == len(grams_seen)


def test_anchors_cover_every_window_and_depend_on_its_content():
    rng = np.random.default_rng(2)
    codes = arrays.mixed(rng.integers(0, 3, 400, dtype=np.uint64) + np.uint64(1))
    first = np.array([0, 0, 90, 95, 400])
    row, place, anchor, low, high = repeats.anchors(codes, first, 10, 4)
    windows = [(r, s) for r, a, b in zip(row, low, high) for s in range(a, b + 1)]
    assert windows == [(r, s) for r in range(4) for s in range(first[r], first[r + 1] - 9)]
    seen = {}
    for a, p, x, y in zip(anchor, place, low, high):
        for s in range(x, y + 1):
            assert seen.setdefault(codes[s:s + 10].tobytes(), (a, p - s)) == (a, p - s)


def naive_order(text):
    return sorted(range(len(text)), key=lambda i: text[i:])


@pytest.mark.parametrize("queue, names", [(64 << 20, 1 << 21), (200, 5)])
def test_induced_sorting(monkeypatch, queue, names):
    monkeypatch.setattr(esais, "QUEUE_BYTES", queue)
    monkeypatch.setattr(esais, "NAMES_IN_MEMORY", names)
    rng = np.random.default_rng(3)
    for trial in range(150):
        n, letters = int(rng.integers(1, 300)), int(rng.integers(1, 5))
        text = np.append(rng.integers(1, letters + 1, n), 0)
        if trial % 5 == 0:
            text = np.append(np.tile(text[:-1], 3), 0)
        suffixes, prefixes = esais.sorted_suffixes(text)
        plain = bytes(text.astype(np.uint8))
        assert suffixes.tolist() == naive_order(plain)
        for k in range(1, len(plain)):
            a, b = plain[suffixes[k - 1]:], plain[suffixes[k]:]
            common = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert prefixes[k] == min(common, esais.CAP)


def test_fm_index_finds_what_earlier_segments_hold():
    rng = np.random.default_rng(4)
    for _ in range(30):
        base = rng.integers(0, 6, 90)
        parts, order = [], rng.permutation(12)
        for _ in range(12):
            own = base[int(rng.integers(0, 20)):int(rng.integers(60, 91))].copy()
            if rng.random() < 0.7:
                own[int(rng.integers(0, len(own)))] = 9
            parts.append(own)
        codes = np.concatenate(parts).astype(np.uint64)
        begins = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        expected, size = set(), fmindex.WINDOW
        for i, p in enumerate(parts):
            for s in range(len(p) - size + 1):
                window = p[s:s + size].tolist()
                if any(order[j] < order[i] and any(q[t:t + size].tolist() == window for t in range(len(q) - size + 1))
                       for j, q in enumerate(parts)):
                    expected.add((i, s))
        found = {(i, s) for i, a, b in fmindex.earlier_windows(codes, begins, order) for s in range(a, b + 1)}
        assert found == expected


def test_coder_round_trip_and_damage():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 63, 64, 65, 1000, coder.BLOCK_IDS + 1):
        for letters in (1, 2, 300, 1 << coder.ID_BITS):
            ids = rng.integers(0, letters, n)
            lengths = np.array([n]) if n else np.zeros(0, np.int64)
            record = coder.pack(np.arange(len(lengths)), lengths, ids)
            doc_ids, back_lengths, back = coder.unpack(record)
            assert (back == ids).all() and (back_lengths == lengths).all() and len(doc_ids) == len(lengths)
    ids = np.tile(rng.integers(0, 50_000, 40), 200)
    record = coder.pack(np.array([7]), np.array([len(ids)]), ids)
    assert len(record) < len(ids)  # repeats are predicted
    for at in (3, 40, len(record) - 60):
        damaged = record[:at] + bytes([record[at] ^ 1]) + record[at + 1:]
        with pytest.raises(ValueError):
            coder.unpack(damaged)
    with pytest.raises(ValueError):
        coder.encode_blocks(np.array([1 << coder.ID_BITS]))


def test_coder_takes_few_steps_for_a_small_record(monkeypatch):
    taken = []
    take = coder._Decoder.take
    monkeypatch.setattr(coder._Decoder, "take", lambda self, *step: taken.append(1) or take(self, *step))
    ids = np.random.default_rng(6).zipf(1.3, 50_000) % 50_000
    record = coder.pack(np.array([7]), np.array([len(ids)]), ids)
    assert (coder.unpack(record)[2] == ids).all()
    assert len(taken) < 3000  # one step for an id of each block, and one for its plain bits


def test_coder_learns_the_order_0_table_once(monkeypatch):
    rng = np.random.default_rng(7)
    ids = rng.permutation(np.repeat(np.arange(2000), rng.integers(1, 20, 2000)))
    shares = np.bincount(ids) / len(ids)
    bits = 8 * len(coder.pack(np.array([7]), np.array([len(ids)]), ids)) / len(ids)
    assert bits < 1.15 * -(shares * np.log2(shares)).sum()
    monkeypatch.setattr(coder, "LANES", 4)  # many groups of blocks, in which a carry and a dropped id occur
    monkeypatch.setattr(coder, "BLOCK_IDS", 500)
    for n in (1, 1999, 2000, 2001, len(ids)):
        assert (coder.unpack(coder.pack(np.array([7]), np.array([n]), ids[:n]))[2] == ids[:n]).all()


def test_chunks_cut_where_tokens_end():
    texts = ["a b  c\n\n d", "x  y", "  z", " lead", "", "tail ", "a\u0085 b　 c  d"]
    column = texts_of(texts)[0]
    starts = chunks.white_space_starts(column.data, column.offsets)
    different, number = chunks.split(column.data, starts)
    different = different.to_pylist()
    assert "".join(different[i] for i in number) == "".join(texts)
    assert different[:3] == ["a", " b", "  c"] and "x  y" in different


def test_encoder_remembers_as_many_chunks_as_it_is_told():
    calls = []
    encoder = chunks.Encoder(lambda texts: [calls.append(t) or list(t.encode()) for t in texts], None, remembered=3)
    for text in ("a b", "a b", "a c", "a d", "a b"):
        column = arrays.Texts(0, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)]))
        ids, begins, _ = encoder.encode(column.data, column.offsets, chunks.white_space_starts(column.data, column.offsets))
        assert bytes(ids.tolist()).decode() == text and begins.tolist() == [0, len(text)]
    assert sorted(calls) == [" b", " b", " c", " d", "a", "a"]


def test_encoders_remember_and_forget(monkeypatch):
    monkeypatch.setattr(chunks, "REMEMBERED", 6)
    seen = []

    def tokenize(parts):
        seen.extend(parts)
        return [[len(p), ord(p[-1])] for p in parts]

    encoder = chunks.Encoder(tokenize, None, lambda parts, _: np.array([[p == " c" for p in parts]]), checks=1)
    for texts in (["a b b", "b c"], ["b b", "", "a"], [f"x{i} y{i}" for i in range(5)], ["b c c"]):
        column = texts_of(texts)[0]
        ids, begins, failed = encoder.encode(column.data, column.offsets, chunks.white_space_starts(column.data, column.offsets))
        for i, text in enumerate(texts):
            parts = [p if j == 0 else " " + p for j, p in enumerate(text.split(" "))] if text else []
            assert ids[begins[i]:begins[i + 1]].tolist() == [v for p in parts for v in (len(p), ord(p[-1]))]
            assert failed[0][i] == parts.count(" c")
    assert len(seen) < 24
