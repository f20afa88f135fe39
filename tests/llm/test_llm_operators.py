"""Each operator against brute force, over the small table and edge cases; empty tables; clashing names."""

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from brute import SMALL
from tabwright.llm import (
    chunks, decontaminate, esais, fmindex, language, lm, pieces, privacy, quality, queries, similar, tokenfile,
)
from tabwright.llm.queries import BYTE_BPE, PIECES, tokenizer_path
from tabwright.llm.rows import remainder


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def items_of(spark):
    return spark.read.parquet(f"{SMALL}/benchmark.parquet")


def test_language_is_right_on_held_out_texts(docs, rows):
    found = language.identify(docs, remainder(3) == 1).collect()
    assert len(found) == len(rows)
    lang = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null and n_chars > 100").collect()}
    held = [r for r in found if r["held_out"] and r["doc_id"] in lang]
    assert len(held) > 40
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)
    for r in found:
        assert r["held_out"] == (brute.remainder(r["doc_id"], 3) == 1)
        assert 0 <= r["score"] <= 1
    by_id = {r["doc_id"]: r for r in found}
    for doc_id in (1000, 1001, 1002, 1013, 1016):
        assert (by_id[doc_id]["lang_pred"], by_id[doc_id]["score"], by_id[doc_id]["rejected"]) == ("und", 0.0, True)


def test_language_without_labels_is_unknown(docs, none):
    bare = docs.select("doc_id", "text", F.lit(None).cast("string").alias("lang"))
    assert {r["lang_pred"] for r in language.identify(bare, remainder(3) == 1).collect()} == {"und"}
    assert language.identify(none, remainder(3) == 1).count() == 0
    one = language.predict(docs.where("doc_id = 0"), {"xx": b"some text"}, {"doc_id": "bigint"}).first()
    assert (one["lang_pred"], one["score"]) == ("xx", 1.0)


def test_lm_counts_and_base_scores(docs, rows):
    found = lm.scored(docs, remainder(7) == 2).collect()
    expected = list(brute.lm_base(rows))
    names = ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")
    assert multiset([r[n] for n in names] for r in found) == multiset(k for k, _ in expected)
    base = collections.defaultdict(list)
    for key, score in expected:
        base[key].append(score)
    for r in found:
        key = tuple(r[n] for n in names)
        assert min(abs(r["base_score"] - s) for s in base[key]) < 1e-6 * max(1, abs(r["base_score"]))
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 30]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


def test_lm_probabilities_add_up_to_one():
    rng = np.random.default_rng(0)
    tokens = np.sort(rng.integers(1, 1 << 60, 300, dtype=np.uint64))
    counts = np.sort(rng.integers(1, 50, 300))[::-1].copy()
    words = lm.Vocabulary(tokens, counts, int(counts.sum()) + 700, 400)  # 100 more tokens, 700 times in all
    events = np.stack([rng.integers(0, 256, 2000), rng.integers(0, 302, 2000), rng.integers(0, 302, 2000)], axis=1)
    model = lm.Model.train(events, words)
    every = np.arange(words.classes + 1)
    for one, two in ((0, 0), (1, 5), (301, 7)):
        log = model.log_probabilities(every, np.full(len(every), one), np.full(len(every), two))
        assert math.isclose(float((10.0 ** log).sum()), 1, abs_tol=1e-4)
    rest = sum(c + 1 for c in counts[words.classes:]) + 700 + 100 + 1
    assert rest == words.rest


def test_lm_learns_from_every_token(spark):
    texts = [f"alpha w{i % 7} beta w{i % 5} gamma" for i in range(100_000)]  # more events than the sample had
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(3)
    top = lm.counted(docs).orderBy(F.desc("n"), "token").toArrow()
    words = lm.Vocabulary(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy(), 600_000, top.num_rows)
    network = lm.trained(docs, words)
    assert network.touched[network.inputs:].tolist() == [600_000] * (len(network.touched) - network.inputs)
    assert network.touched[:network.inputs].sum() == 2 * 600_000


def test_lm_ranks_written_once_are_those_of_the_texts(spark, docs, rows, monkeypatch):
    top = lm.counted(docs).orderBy(F.desc("n"), "token").limit(50).toArrow()
    words = lm.Vocabulary(top["token"].to_numpy().view(np.uint64), top["n"].to_numpy(), 10**6, 10**5)
    found = [np.frombuffer(r["ranks"], np.int32).tolist() for r in lm.ranked(docs, words).collect()]
    hashes = words.tokens.tolist()
    expected = []
    for _, text in rows:
        batch = pa.array([text or ""], pa.string())
        (texts,) = lm.slices(batch)
        expected.append([hashes.index(t) if t in hashes else 50 for t in lm.tokens(texts)[0].tolist()])
    assert sorted(found) == sorted(expected)
    monkeypatch.setattr(lm, "SLICE", 40)
    column = pa.array([np.array(r, np.int32).tobytes() for r in expected], pa.binary())
    for part in (column, column[3:]):
        ranks, firsts = zip(*lm.rank_slices(part))
        whole = [rank[a:b].tolist() for rank, first in zip(ranks, firsts) for a, b in zip(first[:-1], first[1:])]
        assert whole == (expected if part is column else expected[3:])


def test_lm_leaves_add_up_to_one():
    rng = np.random.default_rng(0)
    tokens = np.sort(rng.integers(1, 1 << 60, 1000, dtype=np.uint64))
    counts = np.sort(rng.integers(1, 50, 1000))[::-1].copy()
    words = lm.Vocabulary(tokens, counts, int(counts.sum()) + 700, 1400, np.array([100.0, 400, 350, 254]))
    units = rng.integers(0, 1004, (4000, 1))
    found = np.concatenate([words.classes_of(units), rng.integers(0, 1002, (4000, 2)), units], axis=1)
    network = lm.Network(words)
    network.learn(found, rng)
    network.learn_leaves(found, rng)
    model, every = network.model(), np.arange(1004)
    assert words.groups == 3 and words.classes_of(every).max() == 257
    seen = []
    for one, two in ((0, 0), (1, 5), (301, 7)):
        context = np.full(1004, one), np.full(1004, two)
        log = model.log_probabilities(words.classes_of(every), *context)
        log[255:] += model.leaves.log_in_group(every[255:] - 255, *context)
        assert math.isclose(float((10.0 ** log).sum()), 1, abs_tol=1e-4)
        seen.append(log[255:] - math.log10((10.0 ** log[255:]).sum()))
    assert max(abs(seen[0] - seen[2])) > 1e-4  # beyond the classes too the context tells tokens apart


def test_lm_predicts_words_beyond_the_classes(spark, monkeypatch):
    rng = random.Random(4)
    order, pairs = [], list(range(300))
    for i in range(200):
        rng.shuffle(pairs)
        rare = " ".join(f"rare{i}x{j}" for j in range(10))
        order.append(" ".join([*(f"f{j}" for j in range(255) for _ in range(2)), *(f"l{j} r{j}" for j in pairs), rare]))
    right = " ".join(f"l{j} r{j}" for j in range(300))
    wrong = " ".join(f"l{j} r{(j + 7) % 300}" for j in range(300))
    texts = [*order, right, wrong, "rare1x1 never seen l5", "", None]
    docs = spark.createDataFrame(enumerate(texts), "doc_id long, text string").repartition(1)
    monkeypatch.setattr(lm, "HEAD", 1000)  # those set the vocabulary, which the tasks get
    monkeypatch.setattr(lm, "OWN", 800)
    kept, train = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda docs, words: kept.extend([words, train(docs, words)]) or kept[1])
    found = {r["doc_id"]: r for r in lm.scored(docs, F.col("doc_id") >= 200).collect()}
    assert math.isclose(found[200]["base_score"], found[201]["base_score"], rel_tol=1e-9)
    assert found[200]["score"] > found[201]["score"] + 30  # the same words, but no pair is known

    counts = collections.Counter(w for t in order for w in [*t.split(), None])
    codes = dict(zip(counts, (lm.tokens(lm.Texts(0, np.frombuffer((w or "").encode(), np.uint8), np.array([0, len(w or "")])))[0][0]
                              for w in counts)))
    words, network = kept
    assert (words.own, len(words.tokens), len(words.masses)) == (800, 1000, 256)
    places = {t: i for i, t in enumerate(words.tokens.tolist())}
    rank = {w: places.get(int(codes[w]), 1000) for w in counts}
    masses = [1] * 256
    for w, n in counts.items():
        if rank[w] >= 800:
            masses[int(codes[w]) % 256] += n + 1
    assert words.masses.tolist() == masses

    def share(maps, own, bias, one, two, at):
        x = network.vectors[one].astype(float) @ maps[0] + network.vectors[two].astype(float) @ maps[1]
        scores = np.exp(own.astype(float) @ x + bias)
        return scores[at] / scores.sum()

    for i in (0, 200, 201, 203, 204):
        expected, one, two = 0.0, 0, 0
        for w in [*(texts[i] or "").split(), None]:
            unit = rank[w] if rank[w] < 800 else 800 + int(codes[w]) % 256
            leaf = unit - 255
            p = share(network.maps, network.classes, network.bias, one, two, unit if leaf < 0 else 255 + leaf // 256)
            if leaf >= 0:
                of = slice(leaf // 256 * 256, leaf // 256 * 256 + 256)
                p *= share(network.inner_maps, network.leaves[of], network.leaf_bias[of], one, two, leaf % 256)
            if rank[w] >= 800:
                p *= (counts[w] + 1) / masses[unit - 800]
            expected += math.log10(p)
            one, two = (rank[w] + 2 if rank[w] < 800 else 1), one
        assert math.isclose(found[i]["score"], expected, rel_tol=1e-4, abs_tol=1e-3)


def test_lm_of_nothing(none, docs):
    assert lm.scored(none, remainder(7) == 2).count() == 0
    alone = lm.scored(docs.where("doc_id is null"), remainder(7) == 2).collect()
    assert all((r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0) for r in alone)


def test_similar_classes_and_links(docs, rows, none):
    found = similar.similarity_classes(docs).collect()
    assert multiset((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == multiset(brute.similar(rows))
    assert similar.similarity_classes(none).count() == 0


def test_similar_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "BLOCK", 3)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(20):
        own = list(base)
        own[i * 5] = f"other{i}"
        rows.append((i, " ".join(own)))
    found = similar.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert multiset((r["doc_id"], r["class_id"], r["n_links"]) for r in found) == multiset(brute.similar(rows))


def test_one_of_each_class_stays(docs, rows, none):
    kept = similar.one_of_each_class(docs)
    assert kept.columns == docs.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    classes = collections.defaultdict(list)
    for row, (_, class_id, _) in zip(rows, brute.similar(rows)):
        classes[class_id if brute.words(row[1]) else (row, len(classes))].append(row)
    expected = [min(c, key=lambda r: (r[0] is None, r[0])) for c in classes.values()]
    assert multiset(found) == multiset(expected)
    assert similar.one_of_each_class(none).count() == 0


def test_pruning_bound():
    # P(similarity >= 0.8) with a uniform prior, by numeric integration of the posterior
    x = (np.arange(200_000) + 0.5) / 200_000
    for n in (32, 64, 96):
        m = similar.least_matches(n, 0.8)
        for matches in (m - 1, m):
            density = x**matches * (1 - x) ** (n - matches)
            tail = density[x >= 0.8].sum() / density.sum()
            assert (tail >= similar.TOLERANCE) == (matches == m)


def test_token_files_give_the_ids_back(docs, rows, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(BYTE_BPE))
    tokenizer.encode_special_tokens = True
    found = sorted(tokenfile.round_trip(docs, tokenizer_path(BYTE_BPE)).collect(), key=lambda r: r["start"])
    ids = [tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for _, t in rows]
    expected = multiset((d, len(i), brute.crc(i)) for (d, _), i in zip(rows, ids))
    assert multiset((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-1 if r["doc_id"] is None else r["doc_id"] for r in found]
    assert order == sorted(order)
    assert tokenfile.round_trip(none, tokenizer_path(BYTE_BPE)).count() == 0


def test_token_files_with_many_records(docs, rows, monkeypatch):
    whole = tokenfile.round_trip(docs.coalesce(1), tokenizer_path(BYTE_BPE)).collect()
    monkeypatch.setattr(tokenfile, "RECORD_IDS", 5000)
    assert multiset(tokenfile.round_trip(docs.coalesce(1), tokenizer_path(BYTE_BPE)).collect()) == multiset(whole)


def test_decontamination(spark, docs, rows, none):
    extra = spark.createDataFrame(
        [(9001, "Word"), (9002, "b, C d!"), (9003, None), (9004, "..."), (None, "a b c d"), (9005, "not there at all")],
        "item_id long, text string")
    items = items_of(spark).select("item_id", "text").union(extra)
    known = [(r["item_id"], r["text"]) for r in items.collect()]
    found = decontaminate.contained_items(docs, items)
    expected = multiset(brute.contained(rows, known))
    assert len(expected) > 5
    assert multiset((r["doc_id"], r["item_id"]) for r in found.collect()) == expected
    bad = {d for d, _ in expected}
    clean = decontaminate.uncontaminated(docs, items)
    assert clean.columns == docs.columns
    holders = multiset((d, t) for d, t in rows if not list(brute.contained([(d, t)], known)))
    assert multiset((r["doc_id"], r["text"]) for r in clean.collect()) == holders
    assert bad
    assert decontaminate.contained_items(docs, items.limit(0)).count() == 0
    assert decontaminate.contained_items(none, items).count() == 0
    assert decontaminate.uncontaminated(docs, items.limit(0)).count() == len(rows)


def test_decontamination_in_blocks(spark, docs, monkeypatch):
    items = items_of(spark)
    whole = multiset(decontaminate.contained_items(docs, items).collect())
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 10_000)
    assert multiset(decontaminate.contained_items(docs, items).collect()) == whole


def test_personal_data(docs, rows, none):
    found = privacy.find(docs).collect()
    expected = []
    for d, t in rows:
        spans = brute.base_spans(t or "")
        counts = [sum(s.startswith(k + ":") for s in spans) for k in privacy.BASE]
        expected.append((d, *counts, brute.sha(",".join(spans).encode())))
    names = ("doc_id", *(f"n_{k}" for k in privacy.BASE), "base_sha256")
    assert multiset([r[n] for n in names] for r in found) == multiset(expected)
    text = dict(rows)
    for r in found:
        spans = [s for s in r["spans"].split(",") if s]
        if r["doc_id"] is not None:
            assert set(brute.base_spans(text[r["doc_id"]] or "")) <= set(spans)
        order = [(privacy.KINDS.index(k), int(a)) for k, a, _ in (s.split(":") for s in spans)]
        assert order == sorted(order)
    assert privacy.find(none).count() == 0


def test_plan_of_personal_data_has_no_python(docs):
    plan = privacy.redact(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_redaction(docs, rows, none):
    fixed = privacy.redact(docs)
    assert fixed.dtypes == docs.dtypes
    by_id = {r["doc_id"]: r for r in fixed.collect()}
    assert by_id[1012]["text"].startswith("mail [EMAIL], [EMAIL][EMAIL]; call [PHONE] or ")
    assert "[CARD]" in by_id[1012]["text"] and by_id[1012]["text"].endswith("é\U0001F600 [EMAIL]")
    assert by_id[1012]["n_chars"] == len(by_id[1012]["text"])
    assert by_id[1000]["text"] is None and by_id[1001]["text"] == ""
    text = dict(rows)
    assert all(r["text"] == text[d] for d, r in by_id.items() if "[" not in (r["text"] or "["))
    assert privacy.redact(none).count() == 0


def test_reliabilities_follow_the_better_labeler():
    # the first three labelers agree; the last one votes at random
    rows = [dict(zip(privacy.LABELERS, v), n=n) for v, n in (
        ((1, 1, 1, 1), 50), ((1, 1, 1, -1), 50), ((-1, -1, -1, 1), 50), ((-1, -1, -1, -1), 50))]
    truth = privacy.reliabilities(rows)
    assert truth[0] > 0.95 and truth[1] > 0.95 and truth[2] < 0.05 and truth[3] < 0.05


def test_quality_counts(spark, docs, rows, none):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    found = quality.judge(docs, labels).collect()
    expected = []
    for d, t in rows:
        counts = brute.quality_counts(t)
        expected.append((d, *counts, counts[0] < 10 or 100 * counts[4] > 20 * counts[0]))
    names = ("doc_id", *quality.COUNTS[:5], "base_failed")
    assert multiset([r[n] for n in names] for r in found) == multiset(expected)
    assert not any(r["kept"] and r["base_failed"] for r in found)
    assert quality.judge(none, labels).count() == 0
    assert quality.judge(docs, labels.limit(0)).where("not kept and not base_failed").count() == 0


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (500, 0.01), (3000, 0.02)):
        for k in range(0, int(n * p) + 1):
            exact = math.fsum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1))
            assert math.isclose(quality.tail(k, n, p), exact if k < n * p else 1.0, rel_tol=1e-9)


def test_certified_cutoffs_keep_good_documents(spark):
    good = " ".join(f"word{i}" for i in range(30))
    bad = " ".join(f"w{i} |" for i in range(30))
    rows = [(i, bad if i % 4 == 0 else good, "en", None) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(4000)] + [(1, None), (2, 1)], "doc_id long, quality int")
    found = quality.judge(docs, labels).collect()
    assert all(r["kept"] == (r["doc_id"] % 4 > 0) for r in found)
    # too few labels certify nothing
    few = quality.judge(docs, labels.where("doc_id < 400")).collect()
    assert all(r["kept"] for r in few)


def test_earlier_passages(docs, rows, none):
    found = fmindex.without_earlier_passages(docs)
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    result = found.collect()
    assert multiset([r[n] for n in names] for r in result) == multiset(brute.earlier_passages(rows))
    assert all(brute.sha(r["kept_text"].encode()) == r["kept_sha256"] for r in result)
    assert fmindex.without_earlier_passages(none).count() == 0


def test_repeated_bytes(docs, rows, none):
    found = esais.without_repeated_bytes(docs)
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    result = found.collect()
    assert multiset([r[n] for n in names] for r in result) == multiset(brute.repeated_bytes(rows))
    assert all(brute.sha(bytes(r["kept"])) == r["kept_sha256"] for r in result)
    assert esais.without_repeated_bytes(none).count() == 0


@pytest.mark.parametrize("hot, codes", [(1, 1 << 19), (64, 300)])
def test_repeats_in_hot_groups_and_small_shards(spark, monkeypatch, hot, codes):
    from tabwright.llm import repeats

    monkeypatch.setattr(repeats, "HOT", hot)
    monkeypatch.setattr(repeats, "SHARD_CODES", codes)
    monkeypatch.setattr(repeats, "BROADCAST_ROWS", 0)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(i, " ".join(f"x{i}y{j}" for j in range(i % 7 * 9)) + " " + passage + " " + " ".join(f"z{i}y{j}" for j in range(40)))
            for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_id", "n_words", "n_removed", "kept_sha256")
    found = fmindex.without_earlier_passages(docs).select(*names).collect()
    assert multiset(found) == multiset(brute.earlier_passages(rows))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = esais.without_repeated_bytes(docs).select(*names).collect()
    assert multiset(found) == multiset(brute.repeated_bytes(rows))


def test_hot_groups_with_edited_cut_and_shifted_copies(spark, monkeypatch):
    from tabwright.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 1)
    rng = np.random.default_rng(11)

    def letters(n):
        return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz "), n))

    passage = letters(500)
    texts = [passage + letters(60) for _ in range(12)]
    texts += [letters(45) + passage[:n] + letters(45) for n in (468, 403, 250)]
    texts += [letters(45) + passage[n:] + letters(45) for n in (7, 100, 299)]
    texts += [passage[:n] + "#" + passage[n + 1:] + letters(20) for n in (3, 201, 260, 470)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    found = esais.without_repeated_bytes(docs).select(*names).collect()
    assert multiset(found) == multiset(brute.repeated_bytes(rows))


def test_pieces_equal_the_other_library(docs, rows, none):
    import sentencepiece

    path = tokenizer_path(PIECES)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    found = pieces.encode(docs, path, {"doc_id": "bigint"}, with_ids=True)
    result = found.collect()
    ids = [library.encode(t or "") for _, t in rows]
    assert multiset((r["doc_id"], r["n_pieces"], r["ids_crc32"]) for r in result) == \
        multiset((d, len(i), brute.crc(i)) for (d, _), i in zip(rows, ids))
    assert all(r["parity"] and r["round_trip"] for r in result)
    back = pieces.decode(found, path, {"doc_id": "bigint"}).collect()
    assert multiset(back) == multiset((d, (t or "").replace("▁", " ")) for d, t in rows)
    wide = pieces.encode_all_columns(docs, path)
    assert wide.columns[:len(docs.columns)] == docs.columns and "n_pieces_" in wide.columns
    assert wide.count() == len(rows) and pieces.encode_all_columns(none, path).count() == 0


def test_whole_texts_without_cutting(monkeypatch, rows):
    path = tokenizer_path(PIECES)
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows[-60:] if t is None or len(t) < 5000], pa.string())], ["text"])

    def encoded():
        chunks._encoders.clear()
        return [[x.to_pylist() if hasattr(x, "to_pylist") else x for x in found]
                for _, found in pieces._encoding(path, True)([batch])]

    cut = encoded()
    monkeypatch.setattr(pieces.PieceModel, "cuttable", property(lambda self: False))
    assert encoded() == cut
    chunks._encoders.clear()


def test_pipeline_stages(spark, docs, none):
    import corpus_pipeline

    for start in (docs, none):
        now = start
        for name, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, now, SMALL)
            assert kept.dtypes == start.dtypes, name
            now = spark.createDataFrame(kept.collect(), kept.schema)
        last = corpus_pipeline.STAGES[-1][1](spark, now, SMALL)
        assert last.count() == now.count()
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "language_id", "ngram_jaccard_join", "benchmark_decontamination", "personal_data", "sentencepiece"]


def test_queries_with_sql_give_its_rows(spark):
    from compare import connect, differences

    con = connect(SMALL)
    sql = queries.oracle_sql()
    assert set(sql) < set(queries.queries())
    for name, text in sql.items():
        assert differences(queries.queries()[name](spark, SMALL), con, text) == [], name


def test_every_query_gives_a_row_for_each_document(spark):
    every = queries.documents(spark, SMALL).count()
    others = {"op5_benchmark_decontamination", "op11_centroid_clustering", "op12_source_divergence", "op13_embedding_dedup"}
    for name in queries.queries().keys() - others:
        found = queries.queries()[name](spark, SMALL)
        assert "doc_id" in found.columns
        assert found.count() == every, name
