"""The ten contract queries on the small tables, against brute-force versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from quillspark.llm import queries

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    return {r.doc_id: r for r in rows}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def shingles(text, k=5):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(ids, links):
    up = {x: x for x in ids}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in ids}


def test_op1_ids_and_places(spark, sf001, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in queries.op1_repair_shards(spark, sf001).collect()}
    assert len(got) == len(docs)
    start = 0
    for doc_id in sorted(docs):
        ids = tokenizer.encode(docs[doc_id].text or "", add_special_tokens=False).ids + [2]
        row = got[doc_id]
        assert (row.start, row.n_tokens, row.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_op2_fingerprints(spark, sf001, docs):
    got = {r.doc_id: r for r in queries.op2_minhash(spark, sf001).collect()}
    order = sorted(docs, reverse=True)
    by_text, off = defaultdict(set), []
    for i, doc_id in enumerate(order):
        text, following = docs[doc_id].text or "", docs[order[(i + 1) % len(order)]].text or ""
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        row = got[doc_id]
        assert row.n_chars == len(text)
        assert row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        by_text[text].add(row.fingerprint)
        a, b, c = shingles(text), shingles(edited), shingles(following)
        off += [row.near_edited - len(a & b) / len(a | b) if a | b else 0, row.near_next - (len(a & c) / len(a | c) if a | c else 1)]
    assert len(got) == len(docs) and all(len(x) == 1 for x in by_text.values())
    assert abs(np.mean(off)) < 0.01 and np.abs(off).max() < 0.25 and np.sqrt(np.mean(np.square(off))) < 0.05


def targets(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        total = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / total > cap * sizes[s]}
        if not above:
            return out | {s: left * weight[s] / total for s in open_}
        for s in above:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in above)
        open_ -= above
    return out


def test_op3_mix(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "source", "text").collect()
    source = {r.doc_id: r.source for r in rows}
    size = {r.doc_id: len(WORDS.findall(r.text or "")) for r in rows}
    whole = Counter()
    for d, n in size.items():
        whole[source[d]] += n
    want = targets(dict(whole))
    got = queries.op3_pivotal_mix(spark, sf01).collect()
    again = {(r.doc_id, r.taken) for r in queries.op3_pivotal_mix(spark.newSession(), sf01).collect()}
    assert sorted(r.doc_id for r in got) == sorted(size) and {(r.doc_id, r.taken) for r in got} == again
    taken, most = Counter(), Counter()
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == whole[source[r.doc_id]] and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[source[r.doc_id]])
        taken[source[r.doc_id]] += r.taken
        most[source[r.doc_id]] = max(most[source[r.doc_id]], r.size)
    assert all(abs(taken[s] - want[s]) <= most[s] for s in whole)


def test_op4_components(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/documents.parquet").select("doc_id", "text").collect()
    sets = {r.doc_id: shingles(r.text) for r in rows}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    shared = Counter((a, b) for own in by.values() for i, a in enumerate(own) for b in own[i + 1 :])
    links = [(a, b) for (a, b), n in shared.items() if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n)]
    want = components(sets, links)
    got = queries.op4_ngram_jaccard(spark, sf01).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {d: (len(s), want[d]) for d, s in sets.items()} and len(got) == len(sets)


def test_op6_links(spark, sf01):
    rows = spark.read.parquet(f"{sf01}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    label = np.array([r.label for r in rows])
    near = (x @ x.T >= 0.98) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    ids = [r.vec_id for r in rows]
    want = components(ids, [(ids[i], ids[j]) for i, j in zip(*np.nonzero(near), strict=True)])
    got = {r.vec_id: r for r in queries.op6_metric_join(spark, sf01).collect()}
    assert len(got) == len(ids)
    for i, v in enumerate(ids):
        assert (got[v].n_links, got[v].component_id, got[v].kept) == (near[i].sum(), want[v], want[v] == v)


def test_op7_held_out_accuracy(spark, sf01):
    rows = {r.doc_id: r for r in spark.read.parquet(f"{sf01}/documents.parquet").collect()}
    got = queries.op7_language_id(spark, sf01).collect()
    assert len(got) == len(rows) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
    own = [r for r in got if r.held_out and rows[r.doc_id].lang]
    assert np.mean([r.lang_pred == rows[r.doc_id].lang for r in own]) > 0.97


def test_op8_round_trip(spark, sf001, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = queries.op8_hilbert_packing(spark, sf001).collect()
    ids = {d: np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2], "<u4") for d, r in docs.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        assert [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) == len(ids[d])
    for own in sequences.values():
        assert [s for s, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        total = sum(n for _, n in own)
        assert total <= 4096 and total & (total - 1) == 0  # no padding at all


def test_op10_held_out_quality(spark, sf01):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf01}/labels.parquet").collect()}
    got = queries.op10_quality(spark, sf01).collect()
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    own = [(r.score, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    good, bad = [s for s, q in own if q == 1], [s for s, q in own if q == 0]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.95
    assert np.mean([(s >= 0.5) == (q == 1) for s, q in own]) > 0.93
