"""Divergence of sources, the trie of conversations and token counts against brute-force versions and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import public_tokenizers
import pyarrow as pa
import pytest

from quillspark.llm import divergence, prefix_trie, queries, token_counts

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def same_as_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert Counter(map(tuple, got.collect())) == Counter(want) and want


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_prefix_trie"])
def test_equal_to_sql(spark, sf001, name):
    same_as_sql(spark, sf001, name)


# op11


def diverging(rows, least=10, top=10):
    counts, found, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        groups[lang].add(source)
        counts[lang, source].update(words)
        found[lang].update(set(words))
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, n in found[lang].items() if n >= least]
        v, total = len(kept), {s: sum(counts[lang, s][w] for w in kept) for s in sources}
        p = {s: {w: 1 + 10**9 * (counts[lang, s][w] + 2) // (total[s] + 2 * v) for w in kept} for s in sources}
        q = {w: 1 + 10**9 * (sum(counts[lang, s][w] for s in sources) + 2) // (sum(total.values()) + 2 * v) for w in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pair = sorted(((-sum(f(p[s][w], p[t][w]) for w in kept), t.encode()) for t in sources if t != s))
            term = sorted((-f(p[s][w], q[w]), w.encode()) for w in kept if counts[lang, s][w] and p[s][w] > q[w])[:top]
            out |= {(lang, s, part, x.decode(), -value, i + 1) for part, ranked in (("pair", pair), ("term", term)) for i, (value, x) in enumerate(ranked)}
    return out


def odd_documents():
    rng = random.Random(7)
    words = ["the", "The", "été", "ÉTÉ", "日本", "a", "B", "zz", "naïve"]
    rows = [(" ".join(rng.choice(words[: 3 + i % 7]) for _ in range(rng.randint(0, 30))) + rng.choice(["", "\x00x", "-y", "\n", "a1b2"]), rng.choice(["en", "en", "fr", None]), rng.choice(["s0", "s0", "s1", "s2", "", None, "ß"])) for i in range(400)]
    rows += [(None, "en", "s9"), ("", "xx", "only"), ("word " * 20_000, "en", "s1"), ("rare", "de", "a"), ("rare", "de", "b"), (None, None, None)] + rows[:5]
    return rows


@pytest.mark.parametrize("blocks", [False, True])
def test_divergence_of_odd_rows(spark, blocks):
    rows = odd_documents()
    docs = spark.createDataFrame([(t, l, s, 1, 2, 3, "x") for t, l, s in rows], "text string, lang string, source string, c long, d long, n int, term string").repartition(7)
    got = divergence.source_divergence(docs)
    assert {tuple(r) for r in got.collect()} == diverging(rows) and got.count() == len(diverging(rows))
    if blocks:
        assert {tuple(r) for r in divergence.source_divergence(docs, least_docs=1, top=2).collect()} == diverging(rows, 1, 2)
    assert divergence.source_divergence(docs.limit(0)).count() == 0


def test_cells_in_small_blocks(monkeypatch):
    rng = random.Random(3)
    kind = pa.list_(pa.struct([("source", pa.string()), ("c", pa.int64())]))
    rows = [(rng.choice("ab"), [{"source": s, "c": rng.choice([1, 2, 10**12])} for s in sorted(rng.sample("stuvwxyz", rng.randint(1, 8)))]) for _ in range(200)]
    want = Counter()
    for lang, entries in rows:
        for i, x in enumerate(entries):
            for y in entries[i + 1 :]:
                for cs, ct, n in ((x["c"], y["c"], 1), (0, y["c"], -1), (x["c"], 0, -1), (0, 0, 1)):
                    want[lang, x["source"], y["source"], cs, ct] += n
    for block, pairs in ((1 << 16, 1 << 20), (50, 7)):
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "PAIRS", pairs)
        got = Counter()
        batches = [pa.RecordBatch.from_arrays([pa.array([x[0] for x in part]), pa.array([x[1] for x in part], kind)], ["lang", "entries"]) for part in (rows[:30], [], rows[30:])]
        for out in divergence._cells(iter(batches)):
            for *key, n in zip(*(c.to_pylist() for c in out.columns), strict=True):
                got[tuple(key)] += n
        assert {k: n for k, n in got.items() if n} == {k: n for k, n in want.items() if n}


# op12


def trie(rows):
    turns = defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            turns[conv_id].append(((turn is not None, turn or 0, role.encode(), hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()), (role, text)))
    own = {c: [x for _, x in sorted(t, key=lambda y: y[0])] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c in own:
        base, h = c - (abs(c) % 20) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
    out = set()
    for path, held in members.items():
        below = [p for p in members if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) for p in below if p)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[path]))).encode()).hexdigest()
        out.add((min(held), len(path), min(members[path[:-1]]) if path else None, len(held), sum(len(p) == len(path) + 1 for p in below), len(leaves), saved, digest))
    return out


def odd_conversations():
    rng = random.Random(11)
    rows = []
    for conv_id in [*range(-25, 70), 4000, 4003, 4019]:
        if conv_id % 20 == 0 and rng.random() < 0.3:
            continue
        for turn in range(rng.choice([1, 1, 2, 3, 5])):
            rows.append((conv_id, rng.choice([turn, turn, None, 1]), rng.choice(["user", "assistant", None, ""]), rng.choice(["hi", "hello there", "hi", "", None, " \t", "a b c"])))
    rows += [(77, t, "user", f"turn {t // 2}") for t in range(90)] + [(78, t, "user", f"turn {t // 2}") for t in range(70)]
    return rows + rows[:9] + [(None, 0, "user", "lost"), (5_000_000_000, None, None, None)]


def test_trie_of_odd_rows(spark, monkeypatch):
    rows = odd_conversations()
    talks = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn int, role string, text string, node string, depth int, base int").repartition(5)
    got = prefix_trie.prefix_trie(talks).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == trie(rows)
    assert prefix_trie.prefix_trie(talks.limit(0)).count() == 0
    assert [tuple(r)[:6] for r in prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "a", "b")], "conv_id long, turn int, role string, text string")).collect() if r.depth == 0]


def test_family_tries_handed_on_in_parts(monkeypatch):
    rows = [(b, c, hashlib.md5(str(t * (c % 3)).encode()).digest(), t) for b in (0, 20) for c in range(b, b + 9) for t in range(12)]
    batches = lambda: (pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows[i : i + 5], strict=True)], ["base", "conv_id", "digest", "words"]) for i in range(0, len(rows), 5))

    def merged():
        out = defaultdict(lambda: [0, [], set()])
        for batch in prefix_trie._family_tries(batches()):
            for r in batch.to_pylist():
                out[r["node"]][0] += r["n"]
                out[r["node"]][1] += r["ends"]
                out[r["node"]][2].add((r["parent"], r["depth"], r["words"]))
        return {k: (n, sorted(e), s) for k, (n, e, s) in out.items()}

    whole = merged()
    monkeypatch.setattr(prefix_trie, "HELD", 3)
    assert merged() == whole and all(len(s) == 1 for _, _, s in whole.values())


# op13


def odd_texts():
    rng = random.Random(5)
    parts = ["a", "b", "Z", "é", "ß", " ", "  ", "\n", ".", ",", "'", "s", "'s", "'ll", "1", "23", "!", "_", " ", "́", "日", "<|endoftext|>", "<|startoftext|>", "<|", "\x1d", "…", " ", "　", " word", " the", "🙂"]
    return [None, "", " ", "x" * 60_000, "é " * 9_000, " the" * 30_000] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(700)]


@pytest.mark.parametrize("path", [BYTE, WORD])
@pytest.mark.parametrize(("head", "key_bits"), [(1 << 20, 64), (5, 64), (0, 64), (5, 9)])
def test_token_counts_of_odd_rows(spark, path, head, key_bits):
    from tokenizers import Tokenizer

    tokenizer, texts = Tokenizer.from_file(path), odd_texts()
    rows = [(i if i % 9 else None, t, 0, "k") for i, t in enumerate(texts)] + [(11, texts[11], 1, "k")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, row long, key string").repartition(5)
    want = Counter((i, len((t or "").encode()), n := len(tokenizer.encode(t or "", add_special_tokens=False).ids), n > 40) for i, t, *_ in rows)
    assert Counter(map(tuple, token_counts.token_counts(docs, path, limit=40, head=head, key_bits=key_bits).collect())) == want
    assert token_counts.token_counts(docs.limit(0), path).count() == 0


def test_op13_counts(spark, sf001):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BYTE)
    docs = spark.read.parquet(f"{sf001}/documents.parquet").collect()
    want = {(r.doc_id, len((r.text or "").encode()), n := len(tokenizer.encode(r.text or "", add_special_tokens=False).ids), n > 1024) for r in docs}
    assert {tuple(r) for r in queries.op13_token_counts(spark, sf001).collect()} == want and len(want) == len(docs)
