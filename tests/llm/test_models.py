"""Learned operators on held-out rows, and the pipeline against the stages' own rules."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketlens.llm import quality, registry, toxicity, url_filter

DIR = "/root/testdata/sf0.01"
KIND = "doc_id long, text string, lang string, source string, n_chars int"


def test_fold_and_match():
    lex = toxicity.Lexicon({"idiot": 2.0, "trash": 1.0})
    assert [w for *_, w in lex.matches("An 1D10T, an idiоt and id!ot; idiots trash trash can")] == ["idiot", "idiot", "idiot", "trash"]
    assert lex.evidence(None) == (0.0, 0.0) and lex.evidence("")[0] == 0


def test_learned_word_leaves_companions():
    rows = [(("a", "bad", "no"), 1)] * 6 + [(("b", "bad", "no"), 1)] * 6 + [(("c",), 0)] * 60
    got = toxicity.learn_weights(rows)
    assert "bad" in got and "no" not in got  # three letters are enough for a word, two say nothing alone
    rows = [(("copy", "badword"), 1)] * 6 + [(("other", "badword"), 1)] * 6 + [(("clean",), 0)] * 60
    got = toxicity.learn_weights(rows)
    assert "badword" in got and "copy" not in got and "clean" not in got


@pytest.mark.parametrize("name,label,least", [("op1_toxicity", "toxic", 0.9), ("op5_quality", "quality", 0.93)])
def test_held_out_accuracy(spark, name, label, least):
    out = registry.queries()[name](spark, DIR).join(spark.read.parquet(f"{DIR}/labels.parquet"), "doc_id").where("held_out")
    n = out.count()
    assert n > 50 and out.where(F.col("predicted") == F.col(label)).count() / n >= least


def test_odd_rows(spark):
    rows = [(None, "idiot", "", "", 0), (1, None, "", "", 0), (2, "", "", "", 0), (2, "", "", "", 0), (3, "x" * 200_000, "", "", 0)]
    docs = spark.createDataFrame(rows, KIND)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(docs, model).collect())
    assert all(0 <= r.score <= 1 for r in quality.score_quality(docs, quality.learn(docs, none)).collect())
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    assert toxicity.keep_clean(docs.withColumn("score", F.lit(1)), model).columns == [*docs.columns, "score"]


def test_few_labels_stay_near_the_prior():
    none = toxicity.fit_scores([], [])
    assert list(none) == list(toxicity.PRIOR)
    few = toxicity.fit_scores([(3.0, 2.0), (0.0, 0.0)], [1, 0])
    assert abs(few - none).max() < 0.5
    many = toxicity.fit_scores([(3.0, 2.0)] * 400 + [(0.0, 0.0)] * 4000, [1] * 400 + [0] * 4000)
    assert toxicity.probability(toxicity.np.array([[3.0, 2.0], [0.0, 0.0]]), many).round() .tolist() == [1.0, 0.0]


def test_pipeline(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "checkpoint_folder", lambda _: str(tmp_path))
    out = corpus_pipeline.run(spark, DIR)
    (folder,) = tmp_path.glob("pipeline-*")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = [spark.read.parquet(f"{folder}/{k}") for k in range(len(corpus_pipeline.STAGES))]
    assert all(set(d.columns) == set(docs.columns) for d in kept[:-1])
    assert out.columns == kept[-1].columns and out.exceptAll(kept[-1]).count() == kept[-1].exceptAll(out).count() == 0
    ids = [{r.doc_id for r in d.select("doc_id").distinct().collect()} for d in kept]
    first = spark.read.parquet(f"{DIR}/documents.parquet")
    from marketlens.llm import decontamination, jaccard_join
    from marketlens.llm.common import table

    scores = registry.queries()["op1_toxicity"](spark, DIR)
    assert ids[0] == {r.doc_id for r in scores.where("predicted = 0").collect()}
    group = {r.doc_id: r.component_id for r in jaccard_join.join(first.where(F.col("doc_id").isin(*ids[0]))).collect()}
    assert ids[1] == {i for i in group if group[i] == i}
    bad = decontamination.judge(kept[1], table(spark, DIR, "benchmark")).where("contaminated")
    assert ids[2] == ids[1] - {r.doc_id for r in bad.collect()}
    assert ids[3] == ids[2] == ids[4]
    assert kept[3].where(F.col("text").rlike(r"[0-9]+@mail")).count() == 0
    used = kept[4].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("e"))
    assert used.where("n <> e or n > 2048").count() == 0


def test_labelled_urls_hold_no_hosts_of_the_test_data(spark):
    words = {w for h, _, _ in url_filter.labelled_urls() for w in h.split(".")} - {"www", "m", "blog", "example", "com", "org", "net"}
    for sf in ("sf0.001", "sf0.01", "sf0.1"):
        hosts = {r.host for r in url_filter.split_urls(spark.read.parquet(f"/root/testdata/{sf}/pages.parquet")).select("host").distinct().collect()}
        assert len(hosts) > 20 and not words & {w for h in hosts for w in h.split(".")}


def test_url_model_on_hosts_it_never_saw():
    weights, bias = url_filter.train(url_filter.labelled_urls())

    def blocked(host, path):
        x = url_filter.ngrams(host, path)
        return weights[x].sum() / max(1, len(x)) ** 0.5 + bias >= 0

    known = {h for h, *_ in url_filter.labelled_urls()}
    rows = [(blocked(h, p), bool(y)) for h, p, y in url_filter.labelled_urls(seed=99) if h not in known]
    found, false, missed = (rows.count(x) for x in ((True, True), (True, False), (False, True)))
    assert found > 400 and found / (found + false) >= 0.9 and found / (found + missed) >= 0.9
    hosts = sorted({h for h, *_ in url_filter.labelled_urls(seed=99)} - known)
    steady = [len({blocked(h, f"/{lang}/{n}") for lang in url_filter.LANGUAGES for n in (1, 23, 853)}) == 1 for h in hosts]
    assert sum(steady) / len(steady) >= 0.95


def test_urls_without_rule_by_name_of_host(spark):
    out = registry.queries()["op4_url_filter"](spark, "/root/testdata/sf0.1").where("rule is null")
    marks = F.rlike("host", F.lit("adult|bets|ads-track|casino|pills|spam"))
    r = out.agg(F.count_if(marks & (F.col("verdict") == "block")).alias("found"), F.count_if(marks).alias("bad"), F.count_if(F.col("verdict") == "block").alias("blocked")).first()
    assert r["bad"] > 40 and r["found"] / r["bad"] >= 0.9 and r["found"] / r["blocked"] >= 0.9


def test_url_rules_against_brute_force(spark):
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("page_id", "url")
    odd = [(-1, None), (-1, None), (-2, ""), (-3, "://"), (-4, "a://B.COM/en/x?y"), (-5, "http://x.example.net/de/8#/en"), (None, "http://com"), (-6, "http://example.org/" + "é" * 50_000)]
    frame = pages.unionByName(spark.createDataFrame(odd, pages.schema)).withColumn("host", F.lit("clash")).withColumn("score", F.lit(7)).withColumn("rule", F.lit(1))
    got = url_filter.judge(frame).collect()
    weights, bias = url_filter.train(url_filter.labelled_urls())
    assert len(got) == pages.count() + len(odd)
    urls = {}
    for r in frame.collect():
        urls.setdefault(r.page_id, []).append(r.url)
    for r in got:
        url = urls[r.page_id][0] or ""
        host, path = "", ""
        if "://" in url:
            rest = url.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
            path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(x), x, v) for v, x in url_filter.RULES for h, _, p in [x.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        x = url_filter.ngrams(host, path)
        score = 1 / (1 + toxicity.np.exp(-(weights[x].sum() / max(1, len(x)) ** 0.5 + bias)))
        rule, verdict = max(fits)[1:] if fits else (None, "block" if score >= url_filter.THRESHOLD else "allow")
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict) and abs(r.score - score) < 1e-9
    assert url_filter.judge(pages.limit(0)).count() == 0
