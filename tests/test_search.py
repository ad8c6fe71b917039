"""Search, occurrences, file pruning, folds, versioned tables and incremental stages."""

import random
import threading

import pytest
from pyspark.sql import functions as F

from quillspark import search_catalog
from quillspark.operators import gram_index, merging, occurrences, quotations, retrieval, search
from quillspark.operators.search import all_words, phrase, prefix, word
from quillspark.plans import folds
from quillspark.sinks import versions
from quillspark.streaming import stages


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    texts = ["Été à la mer", "ete a LA montagne", "学习的方法", "self-starter, c++ and a/b", "", None, "mer mer mer"]
    docs = spark.createDataFrame([(i, t, "Ça" if i % 2 else "la mer") for i, t in enumerate(texts)], "doc_id long, text string, title string")
    path = f"file://{tmp_path_factory.mktemp('index')}/i"
    search.write_index(docs.repartition(3), path, ("text", "title"))
    return search.read_index(spark, path)


@pytest.mark.parametrize(
    ("match", "want"),
    [
        (word("éTE"), {0, 1}), (phrase("la mer"), {0, 2, 4, 6}), (phrase("la mer", "text"), {0}), (word("mer", "text") - phrase("à la"), {6}), (prefix("mont") | word("学习"), {1, 2}), (word("学习的"), {2}),
        (phrase("的学"), set()), (word("starter"), {3}), (phrase("c++ AND a/b"), {3}), (word("!?"), set()), (all_words("mer la", "text"), {0}), (prefix("m", "text") & word("ca", "title"), {1}), (all_words(""), set()),
    ],
)
def test_matches(index, match, want):
    assert {r.doc_id for r in search.search(index, match).collect()} == want


def test_scores_fall_back_to_words(spark, sf001, tmp_path):
    docs = spark.read.parquet(f"{sf001}/documents.parquet").withColumn("text", F.regexp_replace("text", r"[^a-z \n]", ""))
    search.write_index(docs, f"file://{tmp_path}/i")
    got = {r.doc_id: round(r.score, 9) for r in search.search(search.read_index(spark, f"file://{tmp_path}/i"), all_words("with from")).collect()}
    assert got == {r.doc_id: round(r.score, 9) for r in retrieval.bm25(docs, ["with", "from"]).collect()} and got


def test_words_read_their_range_only(index):
    plan = index.filter("term = 'mer'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,mer)]" in plan
    assert {r.term: (r.docs, r.occurrences) for r in search.dictionary(index, "me").collect()} == {"mer": (4, 8)}


def test_snippets(spark):
    rows = [("x" * 60 + " Of, The " + "y" * 60,), ("short",), ("",)]
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(search.snippet(F.col("t"), "of the").alias("s")).collect()]
    assert got[0].startswith("…") and "Of, The" in got[0] and got[1:] == ["short…", ""]


@pytest.mark.parametrize("part", [2_000_000, 7])
def test_occurrences_equal_brute_force(spark, part):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abß") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "🙂ab"]
    strings = ["".join(rng.choice("abß") for _ in range(rng.randint(1, 5))) for _ in range(40)] + ["", None, "🙂a", "aba"]
    found = occurrences.occurrences(spark.createDataFrame([(x,) for x in strings + strings[:3]], "string string"), spark.createDataFrame(list(enumerate(texts)), "text_id long, text string").repartition(4), part)
    want = {(i, x, t.find(x) + 1, sum(t.startswith(x, k) for k in range(len(t)))) for i, t in enumerate(texts) if t for x in strings if x and x in t}
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)
    assert occurrences.occurrences(spark.createDataFrame([], "string string"), spark.createDataFrame([(1, "a")], "text_id long, text string")).count() == 0


@pytest.mark.parametrize(("part", "cut"), [(2_000_000, 50_000_000), (9, 60)])
@pytest.mark.parametrize("n", [20, 200])
def test_occurrences_by_key_equal_brute_force(spark, part, cut, n):
    rng = random.Random(n)
    made = lambda most: "".join(rng.choice("abß") for _ in range(rng.randint(0, most)))
    texts = [(rng.choice("xyz"), i, made(40)) for i in range(60)] + [("x", 60, None), (None, 61, "ab"), ("x", 62, "🙂ab")]
    strings = [(rng.choice("xy"), made(6)) for _ in range(n)] + [("x", None), (None, "ab"), ("x", "🙂a"), ("q", "a")]
    found = occurrences.occurrences_by_key(spark.createDataFrame(strings + strings[:3], "key string, string string"), spark.createDataFrame(texts, "key string, text_id long, text string").repartition(4), part, cut)
    want = {(k, i, x) for k, i, t in texts if k and t for own, x in strings if own == k and x and x in t}
    rows = [tuple(r) for r in found.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_stamps_read_each_cue_once(spark, monkeypatch):
    monkeypatch.setattr(quotations, "occurrences", lambda *_: pytest.fail("every string was sought in every file's cues"))
    cues = spark.createDataFrame([(f, f"00:00:0{i}", f"{f} said the line number {i} in front of all") for f in "fg" for i in range(4)], "file string, stamp string, text string")
    claims = spark.createDataFrame([(1, "f", "00:00:00", "f said the line number 3 in front"), (2, "g", "00:00:00", "f said the line number 3 in front"), (3, "g", "00:00:02", "g said the line number 2")], "claim_id long, file string, stamp string, quote string")
    assert {r.claim_id: (r.status, r.places) for r in quotations.checked_stamps(claims, cues).collect()} == {1: ("misplaced", "00:00:03"), 2: ("unverified", ""), 3: ("verified", "")}


def test_forged_tails_are_found(spark):
    said = "a quotation of more than sixty characters that somebody really said in front of all"
    cues = spark.createDataFrame([("f", "00:00:01", said), ("f", "00:00:02", "nothing")], "file string, stamp string, text string")
    rows = [(1, "f", "00:00:01", said), (2, "f", "00:00:01", said[:60] + " FORGED TAIL NEVER SAID ANYWHERE"), (3, "f", "00:00:02", said)]
    claims = spark.createDataFrame(rows, "claim_id long, file string, stamp string, quote string")
    status = lambda longest=None: {r.claim_id: (r.status, r.places) for r in quotations.checked_stamps(claims, cues, longest).collect()}
    assert status() == {1: ("verified", ""), 2: ("unverified", ""), 3: ("misplaced", "00:00:01")} and status(60)[2] == ("verified", "")


def test_pruned_files(spark, sf001, tmp_path):
    table, where = f"file://{tmp_path}/t", f"file://{tmp_path}/i"
    spark.read.parquet(f"{sf001}/documents.parquet").repartitionByRange(20, "lang", "doc_id").write.parquet(table)
    docs = spark.read.parquet(table)
    gram_index.write_index(docs, where)
    for needle, most in (("mentque la", 12), ("Mentque LA", 12), ("never said anywhere", 0), ("src7", 20), ("of", 20)):
        kept = gram_index.pruned(spark, docs, where, needle)
        assert len(kept.inputFiles()) <= most <= len(docs.inputFiles()) == 20
        assert {r.doc_id for r in retrieval.grep(kept, needle).collect()} == {r.doc_id for r in retrieval.grep(docs, needle).collect()}
    assert 0 < len(gram_index.pruned(spark, docs, where, "mentque la").inputFiles())


def test_triples_stay_within_texts():
    import numpy as np

    texts = [b"abcd", b"", b"xy", b"z", b"abce"]
    want = {int.from_bytes(t[i : i + 3], "big") for t in texts for i in range(len(t) - 2)}
    assert set(gram_index._triples(b"".join(texts), np.cumsum([len(t) for t in texts])).tolist()) == want


def test_packs_equal_a_fold(spark):
    rng = random.Random(4)
    rows = [(k, i, rng.randint(0, 9), rng.random() < 0.1) for k in (None, 1, 2, 3) for i in range(rng.choice([1, 300]))]
    frame = folds.in_order(spark.createDataFrame(rows, "k int, i int, size int, cut boolean").repartition(7), "k", ["i"])
    got = {(r.k, r.i): r.pack for r in folds.packed(frame, "k", F.col("size"), F.col("cut"), 20, 2).collect()}
    want, last = {}, object()
    for k, i, size, cut in rows:
        if k != last:
            pack, held, last = 0, size, k
        elif cut or held + 2 + size > 20:
            pack, held = pack + 1, size
        else:
            held += 2 + size
        want[k, i] = pack
    assert got == want


def test_cues_equal_a_fold(spark):
    rng = random.Random(8)
    words = ["alpha beta gamma", "alpha beta gamm", "Alpha, beta gamma delta", "...", None, "other words said", "日本語 です"]
    rows = [(f"f{k % 3}", i, rng.choice(words)) for k in range(3) for i in range(k * 1000, k * 1000 + 400)]
    grams = lambda b: {b} if len(b) <= 3 else {b[i : i + 3] for i in range(len(b) - 2)}
    want, held, file = [], None, None
    for f, i, text in rows:
        bare = "".join(c for c in (text or "").lower() if c.isalnum())
        alike = f == file and held[3] and bare and (bare in held[3] or held[3] in bare or len(grams(bare) & grams(held[3])) / len(grams(bare) | grams(held[3])) >= 0.86)
        if not alike:
            want += [held[:3]] if held else []
            held, file = (f, i, text, bare), f
        elif len(bare) > len(held[3]):
            held = (f, i, text, bare)
    want.append(held[:3])
    assert sorted(map(str, (tuple(r) for r in merging.distinct_cues(spark.createDataFrame(rows, "file string, idx long, text string")).collect()))) == sorted(map(str, want))


def test_two_writers_commit_both(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    row = lambda i: spark.createDataFrame([(i,)], "i long")
    done = []
    threads = [threading.Thread(target=lambda i=i: done.append(versions.commit(row(i), table, "append"))) for i in range(6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == versions.versions(spark, table) == [1, 2, 3, 4, 5, 6]
    assert sorted(r.i for r in versions.read(spark, table).collect()) == list(range(6)) and versions.read(spark, table, 2).count() == 2
    assert not [p for p in (tmp_path / "t" / "_log").iterdir() if p.name.startswith("_")]


def test_versions_conflict_repeat_and_go_back(spark, tmp_path):
    table = f"file://{tmp_path}/t"
    row = lambda i: spark.createDataFrame([(i,)], "i long")
    versions.commit(row(1), table)
    reader = versions.read(spark, table)
    assert versions.snapshot(spark, table, "one") == 1 and versions.commit(row(2), table, "append", expected=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(row(3), table, "append", expected=1)
    with pytest.raises(versions.Conflict):
        versions.snapshot(spark, table, "one")
    with pytest.raises(ValueError):
        versions.commit(spark.createDataFrame([("x",)], "j string"), table, "append")
    assert [versions.commit(row(7), table, "append", batch=("job", n)) for n in (0, 0, 1, 0)] == [3, 3, 4, 4]
    assert versions.rollback(spark, table, "one") == 5 and versions.read(spark, table).collect() == reader.collect()
    assert versions.commit(row(7), table, "append", batch=("job", 1)) == 5 and versions.read(spark, table, 4).count() == 4
    assert [r.kind for r in versions.history(spark, table).orderBy("version").collect()] == ["replace", "append", "append", "append", "rollback"]
    with pytest.raises(FileNotFoundError):
        versions.read(spark, f"file://{tmp_path}/none")


def test_stage_reads_only_new_files(spark, tmp_path):
    folder, table, seen = f"file://{tmp_path}/in", f"file://{tmp_path}/t", spark.sparkContext.accumulator(0)
    put = lambda *texts: spark.createDataFrame([(x,) for x in texts], "text string").coalesce(1).write.mode("append").parquet(folder)
    counted = F.udf(lambda x: (seen.add(1), len(x))[1], "int")
    work = lambda rows: rows.select("address", "text", counted("text").alias("n"))
    put("one", "two", "two")
    assert stages.incremental_stage(spark, folder, table, "s", work) == 1 and seen.value == 2
    assert stages.incremental_stage(spark, folder, table, "s", work) == 1 and seen.value == 2
    put("two", "three!")
    assert stages.incremental_stage(spark, folder, table, "s", work) == 2 and seen.value == 3
    assert sorted((r.text, r.n) for r in versions.read(spark, table).collect()) == [("one", 3), ("three!", 6), ("two", 3)]


def test_stage_runs_write_as_many_files_as_they_read(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([(i, f"text {i}", lang) for i, lang in enumerate(["en", "de", "fr", "es"] * 10)], "doc_id long, text string, lang string")
    docs.repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    run, files = search_catalog.stages.incremental_stage, []

    def counted(spark, folder, *args, **more):
        files.append(len(spark.read.parquet(folder).inputFiles()))
        return run(spark, folder, *args, **more)

    monkeypatch.setattr(search_catalog.stages, "incremental_stage", counted)
    rows = search_catalog.QUERIES["stage_versions"][0](spark, f"file://{tmp_path}").collect()
    assert {(r.version, r.lang): r.texts for r in rows} == {(v, x): 10 for v in (1, 2, 3) for x in (["en"] if v == 1 else ["en", "de", "fr"])}
    assert files[0] > 1


def test_index_is_made_once_in_ranges_of_terms(spark, tmp_path, monkeypatch):
    rng = random.Random(5)
    words = [f"w{i}é" for i in range(50)]
    docs = spark.createDataFrame([(i, " ".join(["hot"] * 3 + rng.choices(words, k=20))) for i in range(300)], "doc_id long, text string").repartition(4)
    monkeypatch.setattr(search.DataFrame, "repartitionByRange", lambda *_: pytest.fail("tokens were made twice, once for a sample of all postings"), raising=False)
    search.write_index(docs, f"file://{tmp_path}/i", range_rows=400)
    index = search.read_index(spark, f"file://{tmp_path}/i")
    key = lambda r: (r.term, r.doc_id, r.field, tuple(r.positions), r.length)
    assert sorted(map(key, index.collect())) == sorted(map(key, search.positions(docs).collect()))
    files = sorted((r.low, r.high) for r in index.groupBy(F.input_file_name()).agg(F.min("term").alias("low"), F.max("term").alias("high")).collect())
    assert len(files) > 6 and all(a[1] <= b[0] for a, b in zip(files, files[1:], strict=False))
    assert index.filter("term = 'hot'").select(F.input_file_name()).distinct().count() > 1
