"""The trained operators: classifiers, language model, and the pipeline over all of them."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from pairloom.llm import language_model, quality_classifier, toxicity
from pairloom.llm.common import held_out
from pairloom.llm.training import Sample, best_cut, labelled_sample

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
RUDE = ["idiot", "scum", "moron", "clown"]


def corpus(n=600, seed=1):
    draw = random.Random(seed)
    common = [f"c{i}" for i in range(40)]
    rows = []
    for i in range(n):
        words = [draw.choice(common) if draw.random() < 0.6 else f"r{draw.randrange(4_000)}" for _ in range(draw.randrange(20, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(3):
                words.insert(draw.randrange(len(words)), draw.choice(RUDE))
        poor = i % 3 == 0
        if poor:
            words = [w + draw.choice(["%%%", "$$$", "###"]) if draw.random() < 0.7 else w for w in words]
        rows.append((i, " ".join(words), ["en", "de", None][i % 3], "s", 0, int(toxic), int(not poor)))
    return rows


def tables(spark, rows):
    docs = spark.createDataFrame([(r[0], r[1], r[2], r[3], 0, 0.5, 1) for r in rows], DOCS)
    labels = spark.createDataFrame([(r[0], r[6], r[5]) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int")
    return docs, labels


ODD = [(9001, None, None, None, 0, 0, 1), (9002, "", "xx", "", 0, 0, 1), (9003, " \n", "en", "s", 0, 0, 1), (None, "c1 c2", "en", "s", 0, 0, 1), (9004, "c1 " * 300_000, "en", "s", 0, 0, 1)]


def accuracy(scored, truth):
    got = [(r.held_out, r.predicted, r.score, truth[r.doc_id]) for r in scored.collect() if r.doc_id in truth]
    assert all(0 <= s <= 1 for _, _, s, _ in got)
    held = [(p, y) for h, p, _, y in got if h]
    assert len(held) > 50
    return np.mean([p == y for p, y in held])


@pytest.mark.parametrize("model,label,modulus,remainder", [(toxicity, 5, 4, 2), (quality_classifier, 6, 3, 1)])
def test_classifier_learns_and_scores_every_row(spark, model, label, modulus, remainder):
    rows = corpus()
    docs, labels = tables(spark, [*rows, *ODD, rows[0]])
    scored = model.scored(docs, model.train(docs, labels))
    out = scored.collect()
    assert len(out) == len(rows) + len(ODD) + 1
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % modulus == remainder) for r in out)
    assert all(r.predicted == int(r.score >= model.CUT) for r in out)
    assert accuracy(scored, {r[0]: r[label] for r in rows}) > 0.9


def test_held_out_labels_are_never_read(spark):
    rows = corpus(200)
    docs, labels = tables(spark, rows)
    flipped = labels.withColumn("toxic", (1 - labels.toxic) * held_out(labels.doc_id, 4, 2).cast("int") + labels.toxic * (~held_out(labels.doc_id, 4, 2)).cast("int"))
    a, b = (labelled_sample(docs, x, "toxic", 4, 2, 100) for x in (labels, flipped))
    assert a.texts == b.texts and (a.labels == b.labels).all() and 0 < len(a.texts) <= 100


def test_classifiers_without_labels_or_with_one_class(spark):
    docs, labels = tables(spark, corpus(30))
    for model, name in ((toxicity, "toxic"), (quality_classifier, "quality")):
        none = model.scored(docs, model.train(docs, labels.limit(0))).collect()
        assert len(none) == 30 and len({r.score for r in none}) == 1
        one = model.scored(docs, model.train(docs, labels.withColumn(name, labels.doc_id * 0 + 1))).collect()
        assert {r.predicted for r in one} == {1}
    assert toxicity.scored(docs.limit(0), toxicity.fit(Sample([], [], np.zeros(0, int), np.zeros(0), np.zeros(0, bool)))).count() == 0


def test_long_texts_are_scored_piecewise_alike(monkeypatch):
    rows = corpus(120)
    sample = Sample([r[1].encode() for r in rows], ["en"] * 120, np.array([r[5] for r in rows]), np.ones(120), np.arange(120) % 5 == 0)
    texts = [" ".join(r[1] for r in rows).encode(), b"", b"one idiot"]
    toxic, net = toxicity.fit(sample).net, quality_classifier.fit(sample)
    hashes = [toxicity.hashed(t) for t in texts]
    whole = toxic.logits(hashes), net.logits(texts)
    monkeypatch.setattr(toxicity, "SCORED_TOGETHER", 50)
    monkeypatch.setattr(quality_classifier, "SCORED_TOGETHER", 1_000)
    assert np.allclose(toxic.logits(hashes), whole[0], atol=1e-4)
    pieces = net.logits(texts)
    assert np.allclose(pieces[1:], whole[1][1:], atol=1e-4) and abs(pieces[0] - whole[1][0]) < 0.5


def test_toxic_rows_go_and_clean_ones_stay(spark):
    rows = corpus()
    docs, labels = tables(spark, rows)
    kept = toxicity.without_toxic(docs, toxicity.train(docs, labels))
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.select("doc_id").collect()}
    toxic = {r[0] for r in rows if r[5]}
    clean = {r[0] for r in rows if not r[5]}
    assert len(ids & clean) > 0.95 * len(clean) and len(ids & toxic) < 0.15 * len(toxic)


def test_best_cut():
    z, y = np.array([0.1, 0.4, 0.35, 0.8]), np.array([0, 1, 0, 1])
    assert 0.35 < best_cut(z, y, np.ones(4)) < 0.4
    assert best_cut(z[:2], y[:1].repeat(2), np.ones(2), 7.0) == 7.0


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def test_language_model_counts_and_base(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BLOCK_TOKENS", 500)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 3_000)
    rows = [*corpus(150), *ODD[:4], corpus(1)[0]]
    docs, _ = tables(spark, rows)
    got = language_model.perplexity(language_model.score(docs, ~held_out(docs.doc_id, 7, 2))).collect()
    assert len(got) == len(rows)
    seen = Counter()
    for r in rows:
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2:
            seen.update(tokens_of(r[1]))
    total = sum(seen.values())
    by_id = {r.doc_id: r for r in got}
    for r in rows:
        tokens, row = tokens_of(r[1]), by_id[r[0]]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(seen[t] > 0 for t in tokens), total)
        assert math.isclose(row.base_score, sum(math.log10((seen[t] + 1) / (total + len(seen) + 1)) for t in tokens), rel_tol=1e-9)
        assert row.score < 0 and row.perplexity >= 1
    held = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 7 == 2 and r.doc_id is not None]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_language_model_of_nothing(spark):
    docs, _ = tables(spark, corpus(5))
    assert language_model.score(docs.limit(0), docs.doc_id >= 0).count() == 0
    rows = language_model.score(docs, docs.doc_id < 0).collect()
    assert len(rows) == 5 and all(r.score == 0 and r.train_tokens == 0 and r.n_known == 0 for r in rows)


def test_probabilities_of_each_context_sum_to_one():
    draw = np.random.default_rng(0)
    words = np.sort(draw.integers(2, 2**63, 50).astype(np.uint64))
    sizes = draw.integers(1, 6, 50)
    context = np.concatenate([np.sort(draw.choice(8, s, replace=False)) for s in sizes])
    counts = draw.integers(1, 400, len(context))
    row = {"block": 0, "words": words.tobytes(), "sizes": language_model._pack(sizes.astype(np.uint16)),
           "contexts": language_model._pack(context.astype(np.uint16)), "counts": language_model._pack(counts.astype(np.uint32))}
    shard = language_model.Shard.of([row])
    totals = language_model.Totals(
        int(counts.sum()), 50, 0.6, 0.4, np.bincount(context, counts, minlength=language_model.CONTEXTS).astype(float),
        np.bincount(context, minlength=language_model.CONTEXTS).astype(float), float(len(context)), 50.0,
    )
    pairs, parent, tables_at, customers, opened = language_model.sample(shard, totals, 3)
    totals.tables, totals.parent_customers, totals.parent_tables = tables_at, customers, opened
    in_parent = language_model.parent_probability(parent, totals)
    unknown = language_model.parent_probability(np.zeros(1), totals)
    assert math.isclose(in_parent.sum() + unknown[0], 1, rel_tol=1e-9)
    for c in range(9):
        weight = np.zeros(50)
        weight[shard.word[shard.context == c]] = pairs[shard.context == c]
        every = language_model.probability(weight, np.full(50, c), in_parent, totals)
        rest = language_model.probability(np.zeros(1), np.array([c]), unknown, totals)
        assert math.isclose(every.sum() + rest[0], 1, rel_tol=1e-9)


def test_seating_follows_the_restaurant_process():
    tables = language_model.seat(np.full(4_000, 200), np.full(4_000, 5.0), 0.0, np.random.default_rng(1))
    expected = 1 + sum(5 / (5 + i) for i in range(1, 200))
    assert abs(tables.mean() - expected) < 0.05 * expected
    assert (language_model.seat(np.array([0, 1]), np.ones(2), 0.5, np.random.default_rng(1)) == [0, 1]).all()


def test_pipeline_stages_against_brute_force(spark):
    from test_near_copies import plain_line_dedup, plain_near_copies
    from test_texts import plain_passages, words_of

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "source_mixing"]
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for name, function in corpus_pipeline.STAGES:
        before, docs = docs, function(spark, docs, folder)
        if name == "source_mixing":
            assert {r.doc_id for r in docs.collect()} <= {i for i, _ in rows}
            continue
        assert docs.dtypes == before.dtypes
        docs = spark.createDataFrame(docs.collect(), before.schema)
        got = sorted((r.doc_id, r.text, r.n_chars) for r in docs.collect())
        if name == "toxicity":
            scores = model.scores([t.encode() for _, t in rows])
            lang = {r.doc_id: r.lang for r in before.collect()}
            rows = [r for r, s in zip(rows, scores) if s < model.thresholds.get(lang[r[0]], toxicity.CUT)]
        elif name == "line_dedup":
            rows = [(i, kept) for i, kept, _, dropped in plain_line_dedup(rows) if not dropped or kept.strip(" ")]
        elif name == "simhash_near_dedup":
            roots = plain_near_copies(rows)
            rows = [r for r in rows if roots[r[0]] == r[0]]
        else:
            assert {i for i, _, _ in got} <= {i for i, _ in rows}
            for i, text in rows:
                n, hit, _ = plain_passages(text, items)
                kept = [t for j, t, _ in got if j == i]
                if not hit:
                    assert kept == [text]
                else:
                    assert len(words_of(kept[0] if kept else "")) <= n - len(hit) and not plain_passages(kept[0] if kept else "", items)[1]
            rows = [(i, t) for i, t, _ in got]
        assert got == sorted((i, t, len(t)) for i, t in rows), name


def test_stages_keep_columns_of_any_name(spark):
    """Also those that helpers use, with nulls, repeated rows and an empty table."""
    folder = "/root/testdata/sf0.001"
    odd = ["kept", "n_lines", "n_dropped", "_dropped", "_spans", "_text_before", "name", "key", "n", "root", "score", "label", "prefix"]
    line = "the same line in every one of these texts"
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    texts = [f"{line}\nfirst", f"{line}\nsecond", f"{line}\nthird words {item}", None, ""]
    rows = [(i, t, "en", "s", None if t is None else len(t), *[f"{c}{i}" for c in odd]) for i, t in enumerate(texts)] + [(None, "no id", "en", "s", 5, *odd)]
    docs = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in odd))
    for name, function in corpus_pipeline.STAGES[1:4]:
        assert function(spark, docs.limit(0), folder).count() == 0
        out = function(spark, docs, folder)
        assert out.dtypes == docs.dtypes
        got = out.collect()
        assert {r.doc_id for r in got} >= {1, 2, None}, name
        assert all(r[c] == (f"{c}{r.doc_id}" if r.doc_id is not None else c) for r in got for c in odd)


def test_each_previous_word_is_a_context_of_its_own(spark, monkeypatch):
    """Every first word has one follower. After another's follower all that is left is the back-off,
    whichever first word it was, and however the contexts are named."""
    n = 12_000
    texts = [(i, f"first{i} next{i}") for i in range(n)] + [(n + i, f"first{i} next{(i + 1) % n}") for i in range(n)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 20_000)
    found = {}
    for least in (1, 2, 1 << 40):  # all are listed, those that a block has twice, none
        monkeypatch.setattr(language_model, "LISTED_COUNT", least)
        found[least] = {r["doc_id"]: r["score"] for r in language_model.score(docs, docs.doc_id < n).collect()}
        held = [found[least][n + i] for i in range(n)]
        assert max(held) - min(held) < 1e-6 and min(found[least][i] for i in range(n)) > max(held)
    assert all(math.isclose(found[least][i], s, rel_tol=1e-6) for least in (2, 1 << 40) for i, s in found[1].items())


def test_tables_of_contexts_that_are_not_listed_are_those_of_all_shards(spark, monkeypatch):
    """With many shards a context's tables are summed over all, for seating and for scores."""
    rng = np.random.default_rng(2)
    texts = [(i, " ".join(f"w{int(k)}" for k in rng.zipf(1.3, 40) % 500)) for i in range(400)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(2)
    monkeypatch.setattr(language_model, "SHARD_TOKENS", 1_000)
    totals = {}
    for least in (1, 1 << 40):
        monkeypatch.setattr(language_model, "LISTED_COUNT", least)
        totals[least] = sum(r["score"] for r in language_model.score(docs, docs.doc_id % 5 > 0).collect())
    assert math.isclose(totals[1], totals[1 << 40], rel_tol=2e-3)
