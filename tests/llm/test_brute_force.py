"""The corpus queries against SQL or brute force, and the cases that their docstrings define."""

import heapq
from fractions import Fraction

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from recallgrid.llm import bpe, jaccard, licenses, mixing, quality, queries, secrets, sharding, toxicity, urls

DATA = "/root/testdata/sf0.001"


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, DATA).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    cols = sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(str).to_numpy().tolist()))
    assert sorted(got.columns) == cols and rows(got) == rows(want)


def test_license_sql_holds_for_wrapped_notices():
    texts = [f"a\n{licenses.NOTICES[n]}\nb\n" + licenses.NOTICES[n].replace(" ", "\n", 7) for n in licenses.NOTICES] + [None, "", "\n\n", "All rights reserved."]
    db = duckdb.connect()
    db.sql("create table documents(doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    x = licenses.TemplateIndex(licenses.NOTICES, {}, licenses.THRESHOLD, licenses.OBLIGATORY)
    want = sorted((i, line, x.names[k], n) for i, t in enumerate(texts) for line, k, n in x.scan(t))
    assert sorted(db.sql(f"select doc_id, line_no, template, shared_words from ({licenses.sql()})").fetchall()) == want and want


def naive_schedule(weights, blocks):
    """Slot by slot with exact fractions: earliest deadline first among the released, a new phase where a source runs out."""
    w = [Fraction(x) for x in weights]
    taken, start, t, phase, out = [0] * len(w), [0] * len(w), 0, 0, {}
    begin = 0
    while any(taken[i] < blocks[i] for i in range(len(w))):
        live = [i for i in range(len(w)) if taken[i] < blocks[i]]
        live = [i for i in live if w[i]] or live
        total = sum(w[i] for i in live)
        share = {i: w[i] / total if total else Fraction(1, len(live)) for i in live}
        ready = []
        for i in live:
            k = taken[i] - start[i]
            if k // share[i] <= t - begin:
                heapq.heappush(ready, (-(-(k + 1) // share[i]), i))
        _, i = ready[0]
        out[i, taken[i]] = (t, phase)
        taken[i] += 1
        t += 1
        if taken[i] == blocks[i]:
            start, begin, phase = list(taken), t, phase + 1
    return out


@pytest.mark.parametrize("weights,blocks", [([3, 1, 1], [9, 2, 7]), ([0.5, 0.25, 0.0, 0.25], [3, 8, 2, 5]), ([1.5, 1.5], [4, 4]), ([1e-6, 1], [2, 6])])
def test_mixing_equals_a_slot_by_slot_schedule(spark, weights, blocks):
    plan = mixing.phases(mixing.exact_weights(weights), blocks)
    got = {(i, b): (int(s), int(p)) for i, n in enumerate(blocks) for b, (s, p) in enumerate(zip(*mixing.slots_of(plan, i, np.arange(n))))}
    assert got == naive_schedule(weights, blocks)
    rows = [(j * 10 + i, f"t{j}", f"s{i}") for i, n in enumerate(blocks) for j in range(n * 2)]
    docs = table(spark, rows, "doc_id long, text string, source string")
    p = mixing.MixParams(weights={f"s{i}": w for i, w in enumerate(weights)}, block=2, slots_per_partition=3)
    mixed = mixing.mix_documents(docs, p, order_col="at", phase_col="phase").collect()
    assert sorted((r["at"] // 2, r["source"], r["phase"]) for r in mixed) == sorted((s, f"s{i}", q) for (i, _), (s, q) in naive_schedule(weights, blocks).items() for _ in range(2))
    assert len({r["at"] for r in mixed}) == len(rows)
    same = {r["doc_id"]: r["slot"] * 2 + r["in_block"] for r in mixing.schedule(docs, p).collect()}
    assert all(same[r["doc_id"]] == r["at"] for r in mixed)
    assert mixing.mix_documents(docs.limit(0), p).count() == 0


def test_mixing_keeps_repeated_rows_and_refuses_negative_weights(spark):
    docs = table(spark, [(1, "a", None)] * 5 + [(None, None, "x")] * 3, "doc_id long, text string, source string")
    assert mixing.mix_documents(docs, mixing.MixParams(block=2)).count() == 8
    with pytest.raises(ValueError):
        mixing.exact_weights([1, -1])


def test_quality_rejects_junk_and_little_else(spark):
    r = np.random.default_rng(0)
    good = [" ".join(r.choice(["tree", "river", "stone", "light", "word"], 40)) for _ in range(3000)]
    junk = ["#$% @@ !!" * 30 for _ in range(150)]
    rows = [(i, t, "en") for i, t in enumerate(good + junk)] + [(9001, None, "en"), (9002, "", None), (9003, "fine text here", None)]
    docs = table(spark, rows, "doc_id long, text string, lang string")
    labels = table(spark, [(i, 1) for i in range(1500)] + [(0, 0), (1, None)] + [(3000 + i, 0) for i in range(50)], "doc_id long, quality int")
    found = {x["doc_id"]: x for x in quality.apply_rules(docs, labels).collect()}
    assert len(found) == len(rows)
    assert all(not found[3000 + i]["keep"] for i in range(150)) and sum(not found[i]["keep"] for i in range(3000)) <= 0.02 * 3000
    assert found[9001]["keep"] and found[9002]["keep"] and found[9003]["keep"] and found[9001]["words"] is None
    assert all(x["keep"] for x in quality.apply_rules(docs, labels.limit(0)).collect())
    assert quality.apply_rules(docs.limit(0), labels).count() == 0


def test_a_tie_with_the_cutoff_is_kept(spark):
    docs = table(spark, [(1, "a b", "en"), (2, "a", "en")], "doc_id long, text string, lang string")
    found = quality.judge(quality.measure(docs), [("en", None, None, None, None, 2.0)]).collect()
    assert sorted((x["doc_id"], x["keep"]) for x in found) == [(1, True), (2, False)]


def test_sharding_is_uniform(spark, tmp_path):
    """Chi-square of where single rows go over many seeds: shards and positions."""
    docs = table(spark, [(i,) for i in range(24)], "doc_id long").coalesce(2)
    docs.write.parquet(str(tmp_path / "d"))
    df = spark.read.parquet(str(tmp_path / "d"))
    counts = np.zeros((24, 24))
    for seed in range(16):
        for r in sharding.shard_documents(df, sharding.ShardParams(rows_per_shard=8, seed=seed)).collect():
            counts[r["doc_id"], r["shard"] * 8 + r["position"]] += 1
    assert counts.sum() == 24 * 16 and (counts.sum(0) == 16).all()
    chi = ((counts - 16 / 24) ** 2 / (16 / 24)).sum()
    assert abs(chi - 23 * 23) < 6 * np.sqrt(2 * 23 * 23)  # 23 x 23 degrees of freedom


def test_both_samplers_draw_the_same_law(monkeypatch):
    exact = lambda: [sharding.hypergeometric(np.random.default_rng([7, i]), 30, 50, 20) for i in range(4000)]
    small = np.bincount(exact(), minlength=21)
    monkeypatch.setattr(sharding, "NUMPY_ROWS", 0)
    large = np.bincount(exact(), minlength=21)
    some = (small + large) > 20
    assert ((small - large)[some] ** 2 / (small + large)[some]).sum() < some.sum() + 5 * np.sqrt(2 * some.sum())
    cut = sharding.split_counts(np.random.default_rng(1), np.array([5, 0, 9, 6]), 11)
    assert cut.sum() == 11 and (cut <= [5, 0, 9, 6]).all()


def test_urls_of_every_kind(spark):
    rows = [(1, None, 1), (2, "", 0), (3, "http://x.org/" + "a" * 50_000, 0), (4, "http://casino.example.com/", 1), (4, "http://casino.example.com/", 1), (5, "http://site.org/", None)]
    pages = table(spark, rows, "page_id long, url string, bad int").selectExpr("*", "'x' p_bad")
    for labelled in (pages, pages.where("bad = 1"), pages.limit(0)):
        got = urls.score_urls(pages, labelled).collect()
        assert len(got) == 6 and all(r["keep"] for r in got if not r["url"])
        assert len({r["p_bad"] for r in got if r["page_id"] == 4}) == 1
    assert all(r["keep"] for r in urls.score_urls(pages, pages.where("bad = 1")).collect())
    assert urls.score_urls(pages.limit(0), pages).count() == 0
    many = table(spark, [(f"http://h{i % 50}.org/{i}", i % 2) for i in range(4000)], "url string, bad int")
    p = urls.UrlParams(max_labelled=300, trees=2)
    first = sorted((r["h"], r["url"]) for r in many.selectExpr("xxhash64(url) h", "url").collect())[:300]
    seen = []
    original = urls.train
    try:
        urls.train = lambda u, y, q: seen.append(u) or original(u, y, q)
        urls.fit_model(many, p)
    finally:
        urls.train = original
    assert seen[0] == [u for _, u in first]


def test_urls_held_out(spark):
    """Accuracy on addresses that weren't fitted, with their real labels."""
    r = np.random.default_rng(3)
    make = lambda bad: f"http://{'win' if bad else 'docs'}{r.integers(9)}-{'x' * int(r.integers(1, 4))}.{'biz' if bad else 'org'}/{'-'.join(map(str, r.integers(0, 9999, 5 if bad else 1)))}?a=1{'&b=2&c=3' if bad else ''}"
    y = [i % 2 for i in range(1200)]
    x = [make(b) for b in y]
    model = urls.train(x[:800], y[:800])
    assert ((model.predict(x[800:]) >= 0.5) == np.array(y[800:], bool)).mean() > 0.97


def test_secrets_of_every_kind(spark):
    model = secrets.train(secrets.labelled_findings())
    key = "ghp_" + "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5P6q7R8"
    rows = [(1, f'token = "{key}"', None), (1, f'token = "{key}"', None), (2, None, "src"), (3, "", "src"), (4, "plain words " * 20_000 + f'api_key: "{key}"', "src"), (5, "commit 24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "tests/x")]
    docs = table(spark, rows, "doc_id long, text string, source string").selectExpr("*", "'z' is_secret", "7 start", "length(text) n_chars")
    found = secrets.find_secrets(docs, model).collect()
    assert sorted(r["doc_id"] for r in found if r["is_secret"]) == [1, 1, 4] and [r["doc_id"] for r in found if not r["is_secret"]] == [5]
    clean = secrets.redact_secrets(docs, model).collect()
    assert len(clean) == 6 and not any(key in (r["text"] or "") for r in clean) and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in clean)
    # brute force: every candidate judged by itself
    for _, text, path in rows:
        for s, e, p in model.findings(text, path):
            one = [model.predict(np.asarray([model.features(text[a:b], text[max(0, a - 48) : a], text[b : b + 48], path)], float))[0] for a, b in {(s, e), *secrets.runs(text, s, e)}]
            assert abs(max(one) - p) < 1e-12
    none, only = secrets.train([]), secrets.train([(key, "", "", None, 1), (None, "", "", None, 0)])
    assert not any(r["is_secret"] for r in secrets.find_secrets(docs, none).collect()) and all(r["is_secret"] for r in secrets.find_secrets(docs, only).collect())


@pytest.mark.parametrize("n", [2, 3, 999, 1000, 1001, 4096])
def test_bpe_words_of_any_length(n):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.read_ranks()
    own = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = np.random.default_rng(n)
    texts = ["a" * n, "ab" * n, "".join(r.choice(list("abcde"), n)), "-=" * n, "é" * n]
    model = bpe.Bpe(ranks, most=2)  # forgets at once
    assert model.encode_batch(texts) == model.encode_batch(texts) == [own.encode_ordinary(t) for t in texts]


def test_bpe_with_merges_out_of_order():
    """A vocabulary in which a merge can make a pair of a lower rank, against merging one pair at a time."""
    r = np.random.default_rng(5)
    for _ in range(20):
        pool = {b"a", b"b", b"c"}
        for _ in range(20):
            x, y = r.choice(sorted(pool), 2)
            pool.add(bytes(x + y)[:8])
        many = [x for x in sorted(pool) if len(x) > 1]
        r.shuffle(many)
        ranks = {bytes([i]): i for i in range(256)} | {bytes(x): 256 + i for i, x in enumerate(many)}
        model = bpe.Bpe(ranks)
        words = ["".join(r.choice(list("abc"), int(r.integers(1, 50)))) for _ in range(60)]

        def naive(raw):
            parts = [raw[i : i + 1] for i in range(len(raw))]
            while True:
                pairs = [(ranks[x + y], i) for i, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in ranks]
                if not pairs or len(parts) == 1:
                    return [ranks[x] for x in parts]
                _, i = min(pairs)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]

        assert model.encode_batch(words) == [[ranks[w.encode()]] if w.encode() in ranks else naive(w.encode()) for w in words]


def test_bpe_decodes_what_it_encodes(spark):
    texts = ["naïve の 😀\t\n x", "", None, "word " * 5000, "\x00  "]
    docs = table(spark, list(enumerate(texts)), "doc_id long, text string")
    encoded = bpe.encode_documents(docs)
    assert {r["doc_id"]: r["text"] for r in bpe.decode_documents(encoded).collect()} == dict(enumerate(texts))
    odd = table(spark, [(1, [64, None, 64]), (2, [10**8, -5]), (3, None), (4, [])], "doc_id long, token_ids array<int>")
    got = {r["doc_id"]: r["text"] for r in bpe.decode_documents(odd).collect()}
    assert got[1][0] == got[1][2] and got[1][1] == "�" and got[2] == "��" and got[3] is None and got[4] == ""
    assert bpe.decode_documents(odd.limit(0)).count() == 0


def test_toxicity_of_misspellings_and_odd_labels(spark):
    words = ["tree", "river", "stone", "cloud", "field", "light", "sound", "green"]
    bad = ["scumbag", "vilest", "wretched", "lowlife"]
    r = np.random.default_rng(1)
    make = lambda toxic, forms=bad: " ".join([*r.choice(words, 30), *(r.choice(forms, 3) if toxic else ())])
    y = [i % 4 == 0 for i in range(800)]
    model = toxicity.train([make(t) for t in y], [int(t) for t in y])
    odd = ["scumbaag", "scummbag", "viilest", "vilesst", "wretchedd", "wreetched", "lowwlife", "lowliife"]
    p = model.scorer()([make(True, odd) for _ in range(100)] + [make(False) for _ in range(100)])
    assert (p[:100] >= model.threshold).mean() > 0.9 and (p[100:] >= model.threshold).mean() < 0.02
    docs = table(spark, [(i, make(t)) for i, t in enumerate(y)] + [(9999, None)], "doc_id long, text string").selectExpr("*", "'x' toxic", "'y' p_toxic")
    labels = table(spark, [(i, int(t)) for i, t in enumerate(y)] + [(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    got = {x["doc_id"]: x["toxic"] for x in toxicity.score_documents(docs, labels).collect()}
    assert len(got) == 801 and not got[9999] and np.mean([got[i] == t for i, t in enumerate(y)]) > 0.98
    assert toxicity.filter_toxic(docs, labels.limit(0)).count() == 801 and toxicity.filter_toxic(docs, labels).columns == docs.columns


def test_pipeline_stages(spark, tmp_path):
    """Nulls, empty texts, copies, a secret, extra columns; and an empty table."""
    words = ["tree", "river", "stone", "cloud", "field", "light", "sound", "green", "water", "north"]
    r = np.random.default_rng(2)
    rows = []
    for i in range(300):
        toxic = i % 3 == 0
        rows.append((i, " ".join([*r.choice(words, 40), *(["vilest", "scumbag", "wretched"] if toxic else ())]), "en", "big" if i % 4 else None, 1, "x"))
    body = " ".join(f"unique{i}" for i in range(80))
    rows += [(400, body, "en", "s", 1, "x"), (401, body, "en", "s", 1, "x"), (402, body.replace("unique7 ", "other "), None, "s", 1, None), (403, None, "en", "s", None, "x"), (404, "", "en", "s", 0, "x"), (405, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "en", "s", 1, "x")]
    docs = table(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, mine string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    table(spark, [(i, i % 2, int(i % 3 == 0)) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = {}
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        at = corpus_pipeline.written(stage(spark, at, str(tmp_path)), name)
        seen[name] = {x["doc_id"]: x for x in at.collect()}
        assert name == "bpe" or set(docs.columns) <= set(at.columns)
    toxic = {i for i in range(0, 300, 3)}
    assert len(toxic - set(seen["toxicity"])) > 90 and {i for i in range(300)} - toxic <= set(seen["toxicity"])
    assert {400, 401, 402} & set(seen["near_copies"]) == {400} and {403, 404, 405} <= set(seen["near_copies"])
    assert set(seen["secrets"]) == set(seen["near_copies"]) == set(seen["mixing"]) == set(seen["bpe"])
    assert seen["secrets"][405]["text"] == 'token = "[SECRET]"' and seen["bpe"][403]["token_ids"] is None and seen["bpe"][404]["n_tokens"] == 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
