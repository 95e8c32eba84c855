"""The corpus operators on small hand-made tables: nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import itertools
import textwrap

import numpy as np
import pytest

import corpus_pipeline
from recallgrid.llm import bpe, jaccard, licenses, mixing, quality, secrets, sharding, topk, toxicity, urls
from recallgrid.llm._common import WordHashes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, slot string, p_toxic string"
LONG = "lorem ipsum dolor " * 3000
BASE = " ".join(f"word{i}" for i in range(60))
TEXTS = [None, "", " \n ", BASE, BASE, BASE.replace("word7 ", "other "), LONG, "Released under the MIT License.", 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y', "short", "short"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i == 2 else "en", None if i % 3 == 0 else f"s{i % 3}", len(t or ""), "x", "y", "z") for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[9], (None, "no id", "en", None, 5, "x", "y", "z")], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard_join_equals_brute_force(docs, empty):
    memo, p = WordHashes(), jaccard.JaccardParams()
    rows = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] is not None]
    sets = [set(s.tolist()) for s in jaccard.token_sets([t for _, t in rows], p.n, memo)]
    near = lambda a, b: bool(sets[a] and sets[b]) and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= p.threshold
    links = [sum(near(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    of = list(range(len(rows)))
    for _ in rows:
        of = [min(of[j] for j in range(len(rows)) if j == i or near(i, j)) for i in range(len(rows))]
    want = sorted((rows[i][0], min(rows[j][0] for j in range(len(rows)) if of[j] == of[i]), links[i]) for i in range(len(rows)))
    clashing = docs.withColumnsRenamed({"slot": "class_id", "shard": "links"})
    for df in (docs, clashing):
        got = [tuple(r) for r in jaccard.jaccard_join(df).collect()]
        assert (None, None, 0) in got and sorted(x for x in got if x[0] is not None) == want
    assert jaccard.jaccard_join(empty).count() == 0
    kept = jaccard.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == [-1, 0, 1, 2, 3, 6, 7, 8, 9]
    assert jaccard.deduplicate(empty).count() == 0


def test_bpe_round_trip(docs, empty):
    rows = {r["doc_id"]: r for r in bpe.encode_documents(docs).collect()}
    assert rows[0]["token_ids"] is None and rows[1]["token_ids"] == [] and all(r["round_trip"] for r in rows.values())
    assert bpe.encode_documents(empty).count() == 0
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = [t or "" for t in TEXTS] + ["aaaa" * 500, "=-" * 900, "naïve の 😀\t\n x"]
    assert bpe.Bpe(ranks).encode_batch(texts) == [own.encode_ordinary(t) for t in texts]


def test_mixing_is_less_than_one_block_away(docs, empty):
    a = mixing.integer_weights([5, 3, 1], 64)
    slots = mixing.one_period(a)
    for w, s in zip(a, slots):
        taken = np.searchsorted(s, np.arange(65))
        assert np.all(np.abs(taken - np.arange(65) * w / 64) < 1)
    got = mixing.schedule(docs, mixing.MixParams(block=2)).collect()
    assert len(got) == docs.count() and len({(r["slot"], r["in_block"]) for r in got}) == len(got)
    assert mixing.mix_documents(docs).columns == docs.columns and mixing.mix_documents(docs).count() == docs.count()
    assert mixing.schedule(empty).count() == 0


@pytest.mark.parametrize("n", [1, 20, 200, 600])
def test_mixing_holds_the_weights_asked_for(n):
    weights = [0.4] + [0.6 / (n - 1) * (0.5 + i / n) for i in range(n - 1)] if n > 1 else [0.7]
    blocks = [40_000] + [100 + i for i in range(n - 1)]
    plan = mixing.phases(mixing.exact_weights(weights), blocks)
    slots = [mixing.slots_of(plan, i, np.arange(b)) for i, b in enumerate(blocks)]
    assert np.array_equal(np.sort(np.concatenate([s for s, _ in slots])), np.arange(sum(blocks)))
    for w, (s, phase) in zip(weights, slots):
        s, w = s[phase == 0], w / sum(weights)
        assert np.all(np.abs(np.arange(len(s)) - w * s) < 1 + 1e-6) and np.all(np.abs(np.arange(1, len(s) + 1) - w * (s + 1)) < 1 + 1e-6)
    assert all(np.all(np.diff(s) > 0) for s, _ in slots)


def test_mixing_serves_sources_of_weight_zero_last():
    plan = mixing.phases(mixing.exact_weights([1, 0, 2]), [2, 3, 4])
    assert sorted(mixing.slots_of(plan, 1, np.arange(3))[0].tolist()) == [6, 7, 8]


def test_pipeline_puts_out_the_mixture(spark, tmp_path, monkeypatch):
    """The order outlives the files between the stages, and without the stage there is none."""
    rows = [(i, f"word {i}", "en", "big" if i % 4 else "small", 9) for i in range(1200)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    stages = [s for s in corpus_pipeline.STAGES if s[0] in ("mixing", "bpe")]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    got = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r["mix_order"])
    want = sorted(mixing.schedule(spark.read.parquet(str(tmp_path / "documents.parquet"))).collect(), key=lambda r: (r["slot"], r["in_block"]))
    assert [(r["source"], r["mix_phase"]) for r in got] == [(r["source"], r["phase"]) for r in want] and {r["doc_id"] for r in got} == set(range(1200))
    first = [r["source"] for r in got if r["mix_phase"] == 0]
    assert len({r["mix_order"] for r in got}) == len(got) == 1200 and abs(first.count("small") - len(first) / (1 + 3**0.5)) < 32
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages[1:])
    plain = corpus_pipeline.run(spark, str(tmp_path))
    assert "mix_order" not in plain.columns and plain.count() == 1200


def test_sharding_has_exact_sizes(docs, empty, spark, tmp_path):
    docs.write.parquet(str(tmp_path / "d"))
    for df in (docs, spark.read.parquet(str(tmp_path / "d"))):
        rows = sharding.shard_documents(df, sharding.ShardParams(rows_per_shard=4)).collect()
        sizes = sorted(sum(r["shard"] == s for r in rows) for s in {r["shard"] for r in rows})
        assert len(rows) == 13 and max(sizes) - min(sizes) <= 1
        assert all(sorted(r["position"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows))) for s in {r["shard"] for r in rows})
    assert sharding.shard_documents(empty).count() == 0
    before, sizes = np.array([0, 5, 12, 20]), sharding.shard_sizes(20, 3)
    counts = [sharding.matrix_row(c, before, sizes, 1)[0] for c in range(3)]
    assert [int(c.sum()) for c in counts] == [5, 7, 8] and np.array_equal(sum(counts), sizes)


def test_search_equals_scoring_everything(docs, spark, empty):
    queries = spark.createDataFrame([(1, "word7 word8 short"), (2, None), (3, ""), (1, "lorem")], "item_id long, text string")
    few = topk.search(docs, queries, topk.SearchParams(k=2)).collect()
    every = topk.search(docs, queries, topk.SearchParams(k=100)).collect()
    top = sorted((r["rank"], r["doc_id"], r["score"]) for r in every if r["rank"] <= 2)
    assert sorted((r["rank"], r["doc_id"], r["score"]) for r in few) == top and top
    assert topk.search(empty, queries).count() == 0 and topk.search(docs, queries.limit(0)).count() == 0


def test_small_segments_equal_scoring_everything():
    """Segments of 11 to 60 documents, queries of many words; a document of many weak words beats those of a few strong ones."""
    r, p = np.random.default_rng(2), topk.SearchParams()
    for trial in range(150):
        n = 20 if trial == 0 else int(r.integers(11, 60))
        strong, weak = [f"s{i}" for i in range(4)], [f"w{i}" for i in range(60)]
        some = [0.0, 0.1, 0.5][trial % 3]
        texts = [" ".join([*(strong + ["pad"] * 8 * d if d < 10 else ()), *(weak if d == n - 1 else [w for w in weak if r.random() < some])]) or "none" for d in range(n)]
        vocabulary = {w: i for i, w in enumerate(strong + weak)}
        query = {i: (9.0 if i < 4 else 2.0) * float(r.uniform(0.5, 1.5) if trial else 1) for i in vocabulary.values()}
        lengths = [len(t.split()) for t in texts]
        mean = sum(lengths) / n
        want = [sum(query[vocabulary[w]] * (p.k1 + 1) / (1 + p.k1 * (1 - p.b + p.b * lengths[d] / mean)) for w in t.split() if w in vocabulary) for d, t in enumerate(texts)]
        at, score = topk.Segment(texts, vocabulary, mean, p).search(query)
        best = sorted(x for x in want if x > 0)[-p.k :]
        assert np.allclose(sorted(score)[-p.k :], best) and np.allclose(score, np.array(want)[at])


def test_secrets(docs, empty):
    model = secrets.train(secrets.labelled_findings())
    held = secrets.labelled_findings(600, seed=99)
    x = np.array([model.features(r[0], r[1], r[2], r[3]) for r in held])
    assert ((model.predict(x) >= 0.5) == np.array([r[4] for r in held])).mean() > 0.95
    assert [(r["doc_id"], r["is_secret"]) for r in secrets.find_secrets(docs, model).collect()] == [(8, True)]
    clean = {r["doc_id"]: r["text"] for r in secrets.redact_secrets(docs, model).collect()}
    assert clean[8] == 'x token = "[SECRET]" y' and clean[3] == BASE and clean[0] is None
    assert secrets.find_secrets(empty, model).count() == 0


def test_assigned_values_win_over_runs(spark):
    of = lambda t: [t[s:e] for s, e in secrets.candidates(t)]
    assert of('password = "Abcdefghij1234567!@#xyz" and') == ["Abcdefghij1234567!@#xyz"]
    assert of("token = eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.s5 then 24be64439e3e49cf46b2") == ["eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.s5", "24be64439e3e49cf46b2"]
    assert of("24be64439e3e49cf46b2 pwd: a1b2c3") == ["24be64439e3e49cf46b2", "a1b2c3"]
    docs = spark.createDataFrame([(1, 'password = "Abcdefghij1234567!@#xyz" and', "s")], "doc_id long, text string, source string")
    assert secrets.redact_secrets(docs, secrets.train(secrets.labelled_findings())).first()["text"] == 'password = "[SECRET]" and'


def test_licenses(docs, empty):
    assert [(r["doc_id"], r["template"]) for r in licenses.scan_licenses(docs).collect()] == [(7, "mit")]
    assert licenses.scan_licenses(empty).count() == 0 and licenses.scan_licenses(docs, {}).count() == 0


def test_licenses_over_several_lines(spark):
    def wrap(name, lead):
        return "some code\n\n" + "\n".join(lead + x for x in textwrap.wrap(licenses.NOTICES[name], 60)) + "\n\nmore code"

    texts = ["intro\nAll rights reserved.", "Released under the BSD License.", "Licensed under CC BY 4.0.", "Licensed under the Foo License, Version 2.0.", "Released\nunder a b c d e f g\nthe MIT License."]
    texts += [wrap(n, lead) for n in licenses.NOTICES for lead in (" * ", "# ", "")]
    got = licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    of = {i: {(r["template"], r["line_no"]) for r in got if r["doc_id"] == i} for i in range(len(texts))}
    assert of[0] == {("all-rights-reserved-alone", 1)} and not (of[1] | of[2] | of[3] | of[4])
    for i, n in enumerate(n for n in licenses.NOTICES for _ in range(3)):
        assert (n, 2) in of[5 + i]


def test_license_runs_equal_brute_force():
    """Two lines match together just when some run over the line end, of no more words than the reach, does."""
    r = np.random.default_rng(1)
    templates, must = {"t": "alpha beta gamma delta epsilon"}, {"t": {"beta"}}
    x = licenses.TemplateIndex(templates, {}, 0.8, must)
    for _ in range(3000):
        w = r.choice(["alpha", "beta", "gamma", "delta", "epsilon", "other"], 14, p=[0.15] * 5 + [0.25]).tolist()
        cut = int(r.integers(1, 13))
        enough = lambda b: len(set(b) & x.sets[0]) >= 4 and "beta" in b
        alone = [enough(w[:cut]), enough(w[cut:])]
        want = any(alone) or any(enough(w[a : a + 6]) for a in range(len(w)))
        found = x.scan(" ".join(w[:cut]) + "\n" + " ".join(w[cut:]))
        assert bool(found) == want and all((i in {f[0] for f in found}) for i in (0, 1) if alone[i])


def test_urls(spark):
    pages = spark.createDataFrame([(i, f"http://{'free-bets' if i % 4 == 0 else 'site'}{'' if i % 4 == 0 else i % 7}.example.org/a/{i}") for i in range(400)] + [(-1, None), (-2, ""), (-3, "::??//")], "page_id long, url string")
    rows = urls.score_urls(pages, pages.select("url", urls.weak_label(pages["url"]).alias("bad"))).collect()
    assert all(r["keep"] == (r["page_id"] % 4 != 0) for r in rows if r["page_id"] >= 0) and all(r["keep"] for r in rows if r["page_id"] in (-1, -2))


def test_quality_bounds(docs, empty, spark):
    assert quality.choose_cutoff([0, 0, 5], 10_000, 0.004, 0.002) == 2 and quality.choose_cutoff([0], 100, 0.004, 0.002) is None
    assert abs(quality.binomial_tail(2, 5, 0.5) - 0.5) < 1e-12
    labels = spark.createDataFrame([(3, 1), (3, 0), (4, None)], "doc_id long, quality int")
    assert all(r["keep"] for r in quality.apply_rules(docs, labels).collect()) and quality.apply_rules(empty, labels).count() == 0


def test_toxicity(docs, empty, spark):
    words = ["tree", "river", "stone", "cloud", "field", "light"]
    r = np.random.default_rng(0)
    texts = [" ".join(r.choice(words, 30)) + (" vilest scumbag vilest" if i % 5 == 0 else "") for i in range(400)]
    model = toxicity.train(texts, [int(i % 5 == 0) for i in range(400)])
    p = model.scorer()(["tree river scumbags vilest", "tree river", None, ""])
    assert p[0] >= model.threshold > p[1] and p[2] == p[3] == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.filter_toxic(docs, labels).count() == docs.count() and toxicity.score_documents(empty, labels).count() == 0
