"""The stages of the pipeline, each on its own input, and the whole run against plainer decisions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline as pipe
import test_operators as helpers
from patrolkit.llm import decontaminate, langid, quality, queries, secret_scan, simhash, toxicity


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder of small tables with junk, copies, a benchmark passage and secrets."""
    draw = random.Random(11)
    syllables = [a + b for a in "bdfglmnprst" for b in ("a", "en", "ir", "o", "um")]
    word = lambda: "".join(draw.choice(syllables) for _ in range(draw.randrange(1, 4)))
    prose = lambda: ". ".join(" ".join(word() for _ in range(10)) for _ in range(12))
    junk = lambda: " ".join(word().upper() + "!!" for _ in range(90))
    good, bad = [prose() for _ in range(120)], [junk() for _ in range(60)]
    passage = " ".join(word() for _ in range(14))
    texts = good + bad + [good[3], good[3].replace(".", "", 1), prose() + " " + passage, prose() + " password = hunter2hunter2"]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    folder = tmp_path_factory.mktemp("sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(180) if i % 7]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), texts


def test_run_takes_effect(spark, tables):
    folder, texts = tables
    kept = {r["doc_id"] for r in pipe.run(spark, folder).collect()}
    assert len(kept & set(range(120, 180))) <= 2  # junk goes
    assert 3 in kept and 180 not in kept and 181 not in kept  # copies of document 3 go
    assert 182 not in kept and 183 in kept  # the benchmark passage goes, the secret's document stays
    assert len(kept & set(range(120))) >= 114  # clean documents stay


def test_redaction(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    row = pipe.redacted_documents(spark, docs, folder).where("doc_id = 183").first()
    assert "hunter2" not in row["text"] and "[SECRET]" in row["text"] and row["n_chars"] == len(row["text"])
    for r in pipe.redacted_documents(spark, docs, folder).where("doc_id < 100").collect():
        assert r["text"] == secret_scan.redact(texts[r["doc_id"]], secret_scan.spans_of(texts[r["doc_id"]])[1])


@pytest.mark.parametrize("place", range(5))
def test_stages_on_odd_tables(spark, tables, odd_docs, place):
    folder, _ = tables
    stage = pipe.STAGES[place][1]
    got = stage(spark, odd_docs, folder)
    if place < 4:
        assert got.columns == odd_docs.columns
        assert [f.dataType for f in got.schema] == [f.dataType for f in odd_docs.schema]
    assert got.count() <= odd_docs.count()
    if place in (3, 4):
        assert got.count() == odd_docs.count()
    assert stage(spark, odd_docs.limit(0), folder).count() == 0


def test_one_document_of_each_group_stays(spark, odd_docs):
    got = pipe.distinct_documents(spark, odd_docs, "").collect()
    classes = {r["component_fp"] for r in simhash.near_copies(odd_docs).collect()}
    assert len(got) == len(classes)
    assert sum(r["doc_id"] == 4 for r in got) == 1
    only_nameless = odd_docs.where("doc_id is null")
    assert pipe.distinct_documents(spark, only_nameless, "").count() == 2


def test_leaks_go_and_clean_documents_stay(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in pipe.untested_documents(spark, docs, folder).collect()}
    assert kept == set(range(len(texts))) - {182}
    assert decontaminate.WINDOW_WORDS == 10


def test_last_stage_returns_ids(spark, tables):
    folder, texts = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 5")
    for r in pipe.token_documents(spark, docs, folder).collect():
        assert len(r["token_ids"]) == r["n_tokens"] and r["token_ids"][0] == 1 and r["token_ids"][-1] == 2


def test_queries_and_sql_are_registered():
    import __spark_entry__ as entry
    from patrolkit.llm import queries

    assert {f"op{n}" for n in range(1, 14)} == {k.split("_")[0] for k in queries.queries() if k != "pipeline"}
    assert set(queries.queries()) <= set(entry.queries())
    assert [name for name, _ in pipe.STAGES] and F is not None


def test_sql_agrees(spark, sf):
    import duckdb

    from patrolkit.llm import queries

    made = duckdb.connect()
    for name in ("documents", "benchmark", "conversations"):
        made.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, sf)
        got = made.execute(sql)
        names = [d[0] for d in got.description]
        assert sorted(names) == sorted(df.columns)
        assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, got.fetchall()))


# ---- whole queries against plain versions ----------------------------------------------------------------------------


def plain_quality(model, text):
    data = text.encode()
    sizes = []
    for words in (model.good, model.bad):
        made = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words), level=quality.LEVEL, write_content_size=False, write_dict_id=False)
        sizes.append(len(made.compress(data)))
    n = max(1, len(data))
    d, rate, length = (sizes[1] - sizes[0]) / sum(sizes), math.log(sum(sizes) / 2 / n), math.log(n) / 8
    terms = np.array([1.0, d, rate, rate**2, d * rate, length, rate * length])
    return 1 / (1 + math.exp(-float(((terms - model.mean) / model.scale) @ model.weights)))


def plain_toxicity(model, text):
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text)]
    scores = [next((model.lexicon[f] for f in [w, *(w[:k] + "*" for k in toxicity.STEMS if len(w) > k)] if f in model.lexicon), toxicity.NEUTRAL) for w in words]
    evidence = []
    for a, b, value in slow_segments(scores):
        expected = math.exp(min(50.0, model.location + math.log(len(words)) - model.scale * value))
        if expected <= toxicity.MAX_EXPECTED:
            evidence.append(-math.log(max(expected, 1e-30)))
    terms = np.array([1.0, max(evidence, default=0.0), math.log1p(sum(evidence)), float(bool(evidence))])
    return 1 / (1 + math.exp(-float(((terms - model.mean) / model.spread) @ model.weights)))


def slow_segments(scores):
    """Segments of the largest sum, by a full scan, then the same on both sides."""
    best, place = 0.0, None
    for i in range(len(scores)):
        total = 0.0
        for j in range(i, len(scores)):
            total += scores[j]
            if total > best + 1e-12:
                best, place = total, (i, j + 1)
    if place is None:
        return []
    i, j = place
    return slow_segments(scores[:i]) + [(i, j, best)] + [(a + j, b + j, s) for a, b, s in slow_segments(scores[j:])]


def plain_language(model, text):
    """The label of most expected words by one forward and one backward pass, word by word."""
    words = langid.words_of(text or "")
    if not words:
        return "und", 0.0
    known = langid.Emissions(model)
    emission, step = known.of(words), np.exp(model.transition)
    k = len(model.labels)
    forward, now = [], np.full(k, 1.0 / k)
    for e in emission:
        now = (now @ step) * np.exp(e - e.max())
        now /= now.sum()
        forward.append(now)
    later, post = np.ones(k), [None] * len(words)
    for i in reversed(range(len(words))):
        both = forward[i] * later
        post[i] = both / both.sum()
        later = step @ (np.exp(emission[i] - emission[i].max()) * later)
        later /= later.sum()
    post = np.array(post)
    votes = (post * langid.word_weights(words)[:, None]).sum(axis=0)
    top = int(votes.argmax())
    return model.labels[top], float(post[:, top].mean())


@pytest.fixture(scope="module")
def small_tables(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")


def test_op9_against_plain_compression(spark, sf, small_tables):
    docs, labels = small_tables
    model = quality.fit_on_tables(docs.select("doc_id", "text"), labels)
    want = {r["doc_id"]: plain_quality(model, r["text"] or "") for r in docs.collect()}
    for r in queries.op9_quality(spark, sf).collect():
        assert r["score"] == pytest.approx(want[r["doc_id"]], abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_op4_against_plain_segments(spark, sf, small_tables):
    docs, labels = small_tables
    model = toxicity.fit_on_tables(docs.select("doc_id", "text"), labels)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in queries.op4_toxicity(spark, sf).collect():
        if len(texts[r["doc_id"]]) < 4000:  # the plain version takes quadratic time
            want = plain_toxicity(model, texts[r["doc_id"]]) if model.weights is not None else model.prior
            assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(r["score"] >= 0.3)


def test_op6_against_plain_passes(spark, sf, small_tables):
    docs, _ = small_tables
    model = langid.fit_on_tables(docs.select("doc_id", "text", "lang"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in queries.op6_language_id(spark, sf).collect():
        lang, score = plain_language(model, texts[r["doc_id"]])
        assert r["lang_pred"] == lang and r["score"] == pytest.approx(score, abs=1e-6)


def test_op1_law_on_the_whole_table(spark, sf, small_tables):
    rows = queries.op1_sharding(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in small_tables[0].collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    load, slots = {}, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["law"], r["grown_shard"]) == (len(data) + 16, "bytes", None) and 0 <= r["shard"] < 40
        assert r["text_crc32"] == (None if texts[r["doc_id"]] is None else zlib.crc32(data))
        load[r["shard"]] = load.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share, longest = sum(load.values()) / 40, max(r["size"] for r in rows)
    assert max(load.values()) <= share + longest


def test_pipeline_against_plain_stages(spark, sf, small_tables):
    docs, labels = small_tables
    model = quality.fit_on_tables(docs, labels)
    rows = [r.asDict() for r in docs.collect()]
    rows = [r for r in rows if (plain_quality(model, r["text"] or "") if model.weights is not None else model.prior) >= 0.3]
    prints = [helpers.slow_fingerprint(r["text"]) for r in rows]
    least = helpers.brute_components([r["doc_id"] for r in rows], prints)
    rows = [r for r, c in zip(rows, least, strict=True) if r["doc_id"] == c]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = set()
    for _, text in items:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        windows |= {tuple(words[i : i + 10]) for i in range(max(1, len(words) - 9) if words else 0)}
    sizes = {len(w) for w in windows}

    def clean(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return not any(tuple(words[i : i + k]) in windows for k in sizes for i in range(len(words) - k + 1))

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())
    want = {}
    for r in rows:
        if clean(r["text"]):
            text = secret_scan.redact(r["text"] or "", secret_scan.spans_of(r["text"] or "")[1])
            ids = library.encode(text, add_bos=True, add_eos=True)
            want[r["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest(), ids)
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["token_ids"]) for r in queries.pipeline(spark, sf).collect()}
    assert got == want
