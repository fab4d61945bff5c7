from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barloom.llm import backoff, line_dedup, matroska, mixing, ngram_join, packing, surrogates, tokens, toxicity, vector_dedup
from barloom.llm.queries import TOKENIZERS

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["Éte", "straße", "don't", "1,5"]
    base = [rng.choice(words) for _ in range(90)]
    rows = []
    for i in range(n):
        kind = i % 6
        if kind == 0:
            x = list(base)
            for _ in range(rng.randrange(5)):
                x[rng.randrange(len(x))] = rng.choice(words)
        elif kind == 1 and rows:
            x = (rng.choice(rows)[1] or "").split(" ")
        else:
            x = [rng.choice(words) for _ in range(rng.randrange(1, 60))]
        rows.append((i, "\n".join([" ".join(x), "a Repeated line here "][: 1 + (i % 4 == 0)]), "en", None if i % 9 == 0 else f"s{i % 3}", len(" ".join(x))))
    return [*rows, (n, None, "en", "s0", 0), (n + 1, "", "en", "s1", 0), (None, "a repeated line here", "en", "s1", 5), (5, "\n \x0b", None, None, None), (n + 2, "q" * 50_000 + " x", "en", "s2", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumns({"row": F.lit(1), "lines": F.lit("x"), "n_dropped": F.lit("y")}).persist()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.mark.parametrize("least", [2, 3])
def test_lines(docs, empty, least):
    got = collections.Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(docs, min_docs=least).collect())
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda s: s.strip(" \t\n\x0b\x0c\r").translate(low)
    big = 1 << 62
    rows = [(r[0], (r[1] or "").split("\n")) for r in corpus()]
    first, seen = {}, collections.defaultdict(set)
    for i, lines in rows:
        for line in lines:
            seen[key(line)].add(big if i is None else i)
    first = {k: min(v) for k, v in seen.items() if len(v) >= least and len(k) >= 10}
    want = collections.Counter()
    for i, lines in rows:
        kept = [x for x in lines if first.get(key(x), big if i is None else i) == (big if i is None else i)]
        want[(i, "\n".join(kept), len(lines), len(lines) - len(kept))] += 1
    assert got == want
    assert line_dedup.dedup_lines(empty).count() == 0


def plain_components(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)]) if w else frozenset())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                up[root(i)] = root(j)
    low = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            low[root(i)] = min(low.get(root(i), 1 << 62), k)
    return collections.Counter((k, len(sets[i]), low.get(root(i))) for i, (k, _) in enumerate(rows))


@pytest.mark.parametrize("options", [{}, {"rare": 2, "block": 5}])
def test_ngram_join(docs, empty, options):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join_components(docs, **options).collect())
    assert got == plain_components([(r[0], r[1]) for r in corpus()])
    if not options:
        assert ngram_join.join_components(empty).count() == 0


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs).collect()))
    size = collections.Counter()
    for _, t, _, s, _ in corpus():
        size[s] += len((t or "").encode().split())
    weights = dict(zip([*sorted(s for s in size if s), None], (1, 2, 3, 1), strict=True))
    target, free = {}, set(size)
    while True:
        level = (sum(size.values()) - sum(target.values())) / sum(weights[s] for s in free)
        over = {s for s in free if 3 * size[s] < level * weights[s]}
        if not over:
            break
        target |= {s: 3 * size[s] for s in over}
        free -= over
    target |= {s: level * weights[s] for s in free}
    each = collections.Counter(round(t, 6) for t in target.values())
    assert set(each) == {round(r.target, 6) for r in rows}
    assert all(r.taken <= 3 * r["size"] for r in rows)
    taken = collections.Counter()
    for r in rows:
        taken[round(r.target, 6)] += r.taken
    assert all(abs(v - k * each[k]) <= 60 * each[k] for k, v in taken.items())
    assert mixing.mix(empty).count() == 0
    held = mixing.mix(docs.repartition(5, "text"), with_row=True).collect()
    assert sorted(map(str, ((r.doc_id, r["size"], r.target, r.taken) for r in held))) == sorted(map(str, ((r.doc_id, r["size"], r.target, r.taken) for r in rows)))
    assert all(r.doc_id == r.row.doc_id for r in held)


def test_mix_draws_by_inclusion_probability(spark):
    """Many sources alike are as many draws: frequencies follow the probabilities, sample sizes are fixed."""
    n, sizes = 400, [1, 2, 3, 4, 5, 6, 8, 10, 12, 40]
    df = spark.createDataFrame([(100 * s + k, f"s{s:04}", "w " * size) for s in range(n) for k, size in enumerate(sizes)], "doc_id long, source string, text string")
    out = mixing.mix(df, weights=(1, 3), closing=0)
    seen, members = collections.Counter(), collections.Counter()
    for r in out.collect():
        ratio = r.target / r.source_size
        assert r.copies - math.floor(ratio + 1e-12) in (0, 1)
        seen[round(ratio, 6), r["size"]] += r.copies - math.floor(ratio + 1e-12)
        members[r.doc_id // 100] += r.copies - math.floor(ratio + 1e-12)
    for ratio in {k[0] for k in seen}:
        room, certain = (ratio - math.floor(ratio + 1e-12)) * sum(sizes), set()
        while True:
            unit = (room - sum(certain)) / sum(x * x for x in sizes if x not in certain)
            over = {x for x in sizes if x not in certain and unit * x > 1}
            if not over:
                break
            certain |= over
        want = {x: 1.0 if x in certain else unit * x for x in sizes}
        for x in sizes:
            assert abs(seen[ratio, x] / (n / 2) - want[x]) < 0.12, (ratio, x)
        assert {members[s] for s in range(n) if (s % 2 == 1) == (ratio > 1)} == {round(sum(want.values()))}


def test_mix_comes_near_its_targets(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, f"s{i % 4}", "w " * int(rng.paretovariate(1.1) * 20)) for i in range(2000)], "doc_id long, source string, text string")
    got = mixing.mix(df).groupBy("target", "source_size").agg(F.sum("taken").alias("taken")).collect()
    assert len(got) == 4 and all(abs(r.taken - r.target) <= 0.01 * r.target for r in got)


ODD = ["a.b,c d... \"foo\". don't. it's, x́.  é, \x1c! <|endoftext|>. <|ENDOFTEXT|> A.  b　,c  ", "  .lead", "É.é 12.5,3 1,000.\r\n\r\nA\t.b . , '.s 's.", "İ I. ΑΣ. ΟΔΟΣ, x", "İ.", "x İ,", "İz İ, y", "a\nb\nc. d, .,\n. ,\nx", "", ".", "\n", "x <|endoftext|>,\n<|endoftext|> y", "\0a b", "é\nÉ ñ, ß. ǅ ª", "١٢ ² x²,"]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_parts_encode_like_whole_texts(name):
    e = tokens.encoder(f"{TOKENIZERS}/{name}")
    rng = random.Random(11)
    bits = [*"abeIKs'tm.,!-\"019 \n\t", "  ", "\n\n", "<|endoftext|>", "<|", *"İΣςéЖй½²١中ก…“’ªǅKÅĳﬁ\u0301\u0306\u0307\u200b\u2009\u3000\x1c\x85\0", "'s", "'RE", "😀", "\r\n", "Stra", " . ", " ,"]
    kinds = [(32, 127), (0x80, 0x530), (0x300, 0x370), (0x530, 0x3100)]
    texts = ["".join(rng.choice(bits) if rng.random() < 0.8 else chr(rng.randrange(*rng.choice(kinds))) for _ in range(rng.randrange(14))) for _ in range(20_000)]
    texts = [None, *ODD, *(r[1] for r in corpus()), *texts]
    ids, sizes = e.encode(pa.array(texts))
    ends = np.cumsum(sizes)
    for t, n, end in zip(texts, sizes, ends, strict=True):
        assert ids[end - n : end].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def plain_ids(name, end):
    e = tokens.encoder(f"{TOKENIZERS}/{name}").tokenizer
    return [(r[0], np.array([*e.encode(r[1] or "", add_special_tokens=False).ids, end], "<u4")) for r in corpus()]


def test_token_orc(spark, docs, empty, tmp_path):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokens.store_tokens(docs, f"{TOKENIZERS}/word_bpe_49k.json", 2).collect())
    want = collections.Counter((i, len(x), zlib.crc32(x.tobytes())) for i, x in plain_ids("word_bpe_49k.json", 2))
    assert collections.Counter((i, n, c) for _, i, n, c in got) == want
    assert [g[0] for g in got] == np.concatenate([[0], np.cumsum([g[2] for g in got])[:-1]]).tolist()
    ids = [1 << 62 if g[1] is None else g[1] for g in got]
    assert ids == sorted(ids)
    assert tokens.store_tokens(empty, f"{TOKENIZERS}/word_bpe_49k.json", 2).count() == 0


def test_token_orc_of_one_id(spark, tmp_path):
    """Rows of one id with other texts: start is where the file holds them."""
    df = spark.createDataFrame([(i // 4, f"{'ab'[i % 2]} word {i % 4} " * (i % 4)) for i in range(60)], "doc_id long, text string").repartition(4)
    path = f"{tmp_path}/orc"
    tokens.write_token_orc(df, path, f"{TOKENIZERS}/word_bpe_49k.json", 2)
    held = tokens.read_token_orc(spark, path).orderBy("shard", "place").collect()
    at, want = 0, []
    for r in held:
        want.append((r.doc_id, at, r.n_tokens, zlib.crc32(np.array(r.tokens, "<u4").tobytes())))
        at += len(r.tokens)
    assert sorted(want) == sorted(tuple(r) for r in tokens.token_index(tokens.read_token_orc(spark, path)).collect())
    assert [r.doc_id for r in held] == sorted(r.doc_id for r in held)


def test_token_orc_prunes(spark, tmp_path):
    """A filter on ids reaches the scan, and row groups that can't hold them aren't read."""
    path = f"{tmp_path}/orc"
    tokens.write_token_orc(spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text")), path, f"{TOKENIZERS}/word_bpe_49k.json", 2)
    one = tokens.read_token_orc(spark, path).where("doc_id = 7001")
    assert one.count() == 1 and len(one.collect()) == 1
    plan = one._jdf.queryExecution().executedPlan()
    assert "EqualTo(doc_id,7001)" in plan.toString()
    leaves = plan.collectLeaves()
    assert 1 <= sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size())) <= 2_000
    from pyarrow import orc

    files = [orc.ORCFile(str(f)) for f in sorted((tmp_path / "orc").glob("*.orc"))]
    assert sum(f.nrows for f in files) == 20_000 and all(f.nstripes for f in files) and all(f.row_index_stride == 2_000 and str(f.compression).upper() == "ZSTD" for f in files)


def test_packing(docs, empty):
    rows = packing.pack_documents(docs, f"{TOKENIZERS}/byte_bpe_50k.json", capacity=64).collect()
    ids = collections.defaultdict(list)
    for i, x in plain_ids("byte_bpe_50k.json", 1):
        ids[(i, len(x))].append(x)
    assert sum(r.length for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        assert any(zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in ids[(r.doc_id, r.doc_tokens)])
    seqs = collections.defaultdict(list)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert len(seqs) <= sum(r.length for r in rows) / 64 * 1.1 + 1
    assert packing.pack_documents(empty, f"{TOKENIZERS}/byte_bpe_50k.json").count() == 0


def test_slack_is_least():
    rng = random.Random(3)
    for _ in range(50):
        counts = {n: rng.randrange(1, 4) for n in rng.sample(range(1, 30), 5)}
        chosen = packing.fill(dict(counts), 40)
        assert all(k <= counts[n] for n, k in chosen.items()) and max(counts) in chosen
        items = [n for n, k in counts.items() for _ in range(k)]
        items.remove(max(counts))
        sums = {max(counts)}
        for n in items:
            sums |= {s + n for s in sums if s + n <= 40}
        assert sum(n * k for n, k in chosen.items()) == max(sums)


def test_matroska(spark, docs, empty):
    for r in matroska.read_back(matroska.store_texts(docs)).collect():
        assert r.payload_bytes % 192 == 0 and r.payload_bytes >= max(192, r.n_bytes)
    by = collections.Counter((r.doc_id, r.payload_sha256) for r in matroska.read_back(matroska.store_texts(docs)).collect())
    want = collections.Counter()
    for i, t, *_ in corpus():
        raw = (t or "").encode()
        want[(i, hashlib.sha256(raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))).hexdigest())] += 1
    assert by == want
    table = matroska.packets(matroska.store_texts(docs.where("doc_id = 122"))).collect()
    assert len(table) == -(-50_002 // 192) and table[0].ms == 0 and table[-1].ms > 6000
    assert all(b.ms - a.ms == 24 for a, b in zip(table, table[1:], strict=False)) and all(r.error is None and r.key for r in table)
    found = matroska.cues(matroska.store_texts(docs.where("doc_id = 122"))).collect()
    assert [r.ms for r in found] == [r.ms for r in table[:: 32 * 16]] and all(r.track == 1 for r in found)
    assert matroska.read_back(matroska.store_texts(empty)).count() == 0
    for r in matroska.read_back(matroska.store_texts(docs)).where("doc_id = 121").collect():  # an empty text: a frame of blanks
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (0, 192, zlib.crc32(b" " * 16))
        assert r.feature == f"packets=1;clusters=1;cues=1;last_ms=0;sum={-96 * 192};energy={96 * 96 * 192};peak=96;crossings=0"


def test_matroska_of_odd_media(spark):
    good = matroska.write_pcm(b"x" * 384)
    df = spark.createDataFrame([(1, 384, bytearray(good), "a"), (2, 0, None, "b"), (None, 384, bytearray(good[:-100]), "c"), (4, 1, bytearray(b"no media"), "d")], "doc_id long, n_bytes long, media binary, track string")
    rows = {r.n_bytes * 10 + (r.doc_id or 0): r for r in matroska.read_back(df).collect()}
    assert rows[3841].payload_sha256 == hashlib.sha256(b"x" * 384).hexdigest() and rows[3841].media_sha256 == hashlib.sha256(good).hexdigest() and rows[3841].error is None
    assert rows[2].payload_bytes is None and rows[2].error is None
    assert rows[3840].error and rows[3840].payload_bytes is None
    assert rows[14].error and rows[14].payload_sha256 is None
    table = matroska.packets(df).collect()
    assert [(r.track, r.ms, r.length) for r in table if r.doc_id == 1] == [(1, 0, 192), (1, 24, 192)]
    assert [(r.track, r.error) for r in table if r.doc_id == 2] == [(None, None)] and all(r.error for r in table if r.doc_id in (None, 4))
    named = df.drop("track").withColumns({"row": F.lit("r"), "found": F.lit("f"), "others": F.lit("o"), "odd.name": F.lit("n")})
    for listed, n in ((matroska.packets(named), 2), (matroska.cues(named), 1)):
        assert [tuple(r)[:6] for r in listed.where("doc_id = 1").collect()] == [(1, 384, "r", "f", "o", "n")] * n


def test_lacing_kinds():
    frames = [b"a" * 300, b"b" * 10, b"c" * 255, b"d" * 7]
    vint = lambda v: ((1 << 14) | v).to_bytes(2, "big")
    xiph = b"\x03\xff\x2d\x0a\xff\x00" + b"".join(frames)
    ebml = b"\x03" + vint(300) + b"".join(vint(x + 8191) for x in (-290, 245)) + b"".join(frames)
    for kind, body in ((1, xiph), (3, ebml)):
        block = b"\x81\x00\x05" + bytes([kind << 1]) + body
        data = matroska.element(matroska.EBML, b"") + matroska.element(matroska.SEGMENT, matroska.element(matroska.CLUSTER, matroska.whole(matroska.TIME, 7) + matroska.element(matroska.GROUP, matroska.element(matroska.BLOCK, block))))
        found = matroska.parse(data)
        assert found["error"] is None and [data[s : s + n] for _, _, s, n, _ in found["packets"]] == frames
        assert matroska.parse(data[:-5])["error"]
    assert matroska.parse(b"no media")["error"]


def test_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 64))
    rows = []
    for i in range(300):
        v = base[i % 40] + rng.normal(size=64) * (0.05 if i % 3 else 0.3)
        rows.append((i, [float(x) for x in v], int(i % 40 % 3)))
    rows += [(300 + i, rows[7][1], rows[7][2]) for i in range(20)] + [(400, None, 1), (401, [0.0] * 64, 1), (402, [float("nan")] * 64, 1), (403, rows[0][1], None), (404, [1.0, None], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("entry", F.lit(1))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_vectors(df, block=7).collect()}
    good = [r for r in rows if r[1] and r[2] is not None and len(r[1]) == 64 and np.isfinite(r[1]).all() and np.abs(r[1]).max() > 0]
    unit = np.array([r[1] for r in good])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = (unit @ unit.T >= 0.93) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    comp = np.array([r[0] for r in good])
    while True:
        new = np.where(near, comp[None, :], 1 << 40).min(axis=1)
        if (new == comp).all():
            break
        comp = new
    want = {r[0]: (int(near[k].sum()) - 1, int(comp[k]), int(comp[k]) == r[0]) for k, r in enumerate(good)}
    want |= {r[0]: (0, r[0], True) for r in rows if r[0] not in want}
    found, there = sum(v[0] for v in got.values()), sum(v[0] for v in want.values())
    assert len(got) == len(rows) and found <= there and found >= 0.95 * there
    assert np.mean([got[k] == v for k, v in want.items()]) > 0.95
    assert vector_dedup.near_vectors(df.where("false")).count() == 0


def plain_backoff(rows, corpus, order=3, alpha=0.4):
    """(doc_id, n_words, log score) of rows by the counts of corpus."""
    split = lambda t: (t or "").encode().lower().split()
    total, everything = collections.Counter(), 0
    for _, t in corpus:
        w = split(t)
        everything += len(w)
        total.update(tuple(w[j : j + n]) for n in range(1, order + 1) for j in range(len(w) - n + 1))
    out = []
    for i, t in rows:
        w, score = split(t), 0.0
        for j in range(len(w)):
            factor = 1.0
            for n in range(min(order, j + 1), 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if n == 1:
                    score += math.log(factor * max(total[g], 0.5) / max(everything, 1))
                elif total[g]:
                    score += math.log(factor * total[g] / total[g[:-1]])
                    break
                else:
                    factor *= alpha
        out.append((i, len(w), score))
    return out


def same_scores(got, want):
    got, want = (sorted(x, key=lambda r: (r[0] is None, r[0] or 0, r[1], r[2])) for x in (got, want))
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=0, atol=1e-8)


@pytest.mark.parametrize("options", [{}, {"rounds": 3, "share": 1}, {"order": 2, "share": 40}, {"order": 4, "rounds": 1, "share": 40}])
def test_backoff(docs, empty, options):
    rows = [(r[0], r[1]) for r in corpus()]
    got = backoff.score_documents(docs, **options).collect()
    same_scores([(r.doc_id, r.n_words, r.log_score) for r in got], plain_backoff(rows, rows, options.get("order", 3)))
    assert all(r.mean_log_score is None if r.n_words == 0 else abs(r.mean_log_score * r.n_words - r.log_score) < 1e-8 for r in got)
    if not options:
        assert backoff.score_documents(empty).count() == 0
    again = docs.unionByName(docs.where("doc_id < 9")).unionByName(docs.where("doc_id = 7"))
    more = rows + [r for r in rows if r[0] is not None and r[0] < 9] + [r for r in rows if r[0] == 7]
    if options.get("share") == 40:
        same_scores([(r.doc_id, r.n_words, r.log_score) for r in backoff.score_documents(again, **options).collect()], plain_backoff(more, more, options["order"]))


def test_backoff_against_another_corpus(docs, empty):
    rows = [(r[0], r[1]) for r in corpus()]
    other = [r for r in rows if r[0] is None or r[0] % 3]
    got = backoff.score_against(docs, docs.where("doc_id IS NULL OR doc_id % 3 <> 0")).collect()
    same_scores([(r.doc_id, r.n_words, r.log_score) for r in got], plain_backoff(rows, other))
    same_scores([(r.doc_id, r.n_words, r.log_score) for r in backoff.score_against(docs, empty).collect()], plain_backoff(rows, []))


def test_long_words_of_equal_polynomials_differ():
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word  # Thue-Morse: equal modulo 2**64 for any base
    data = f"{word} {other} {word.upper()}".encode()
    hashes, bounds = backoff.hasher().hashes(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    assert bounds.tolist() == [0, 3] and hashes[0] == hashes[2] != hashes[1]


def test_surrogates(spark):
    text = ["Mail a.b1@x.org or A.B1@x.org, card 4111 1111 1111 1111 / 4111111111111111; call +1 (456) 555-2186.", "Anna Smith met John Smith and Dr. Smith. Иван Петров? 192.168.1.77 and 123-45-6789.", None, "none 12.5 v1.2.3.4.5"]
    text += [f"user{i}@mail.example.com 10.0.{i % 250}.{i % 7}" for i in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(text)], "doc_id long, text string").withColumn("forms", F.lit(1))
    got = {r.doc_id: r for r in surrogates.replace_private(df, "key").collect()}
    assert got[2].text is None and got[3].text == text[3] and got[3].n_mentions == 0 and got[0].n_mentions == 5
    for bad in ("a.b1", "4111 1111", "555-2186"):
        assert bad not in got[0].text
    cards = re.findall(r"\d{4}(?: ?\d{4}){3}", got[0].text)
    assert cards[0].replace(" ", "") == cards[1] and sum(int(d) if k % 2 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(cards[1])) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}\.$", got[0].text)
    names = re.match(r"(\w+) (\w+) met (\w+) (\w+) and Dr\. (\w+)\. (\w+) (\w+)\?", got[1].text).groups()
    assert names[1] == names[3] == names[4] != "Smith" and re.match("[А-Я]", names[5]) and re.match("[А-Я]", names[6])
    assert names[0] in surrogates.GIVEN[("latin", "f")] and names[2] in surrogates.GIVEN[("latin", "m")]
    assert len({got[i + 4].text.split()[0] for i in range(300)}) == 300
    assert len({got[i + 4].text.split()[1] for i in range(300)}) == len({t.split()[1] for t in text[4:]})
    assert got[0].text == surrogates.replace_private(df, "key").where("doc_id = 0").first().text != surrogates.replace_private(df, "other").where("doc_id = 0").first().text
    assert surrogates.replace_private(df.where("false"), "key").count() == 0


def test_surrogates_of_whole_names(spark):
    text = [
        "Mr. John Smith and Dr. Anna Smith met. Smith's house; SMITH left. John stayed.", "John Paul Smith, Anna Smith-Jones, John O'Brien, Mary McDonald's, Michael B. Jordan, ANNA SMITH.", "John\nSmith\u00a0and Emily Johnson; Johnson\n\nThe end of Herr Dr. van der Berg. Mail Anna Quux@x.org",
        "Smith and Johnson make things here, The Berg too.", "Mary The end. Jean-Paul Sartre, Anna d'Artagnan and Ludwig van Beethoven: Beethoven. Dr. Παπαδόπουλος, Dr. Müller",
    ]
    df = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r.doc_id: r for r in surrogates.replace_private(df, "key").collect()}
    for i, gone in enumerate(["John Anna Smith SMITH", "John Paul Anna Smith Jones Brien Mary McDonald Michael B. Jordan ANNA SMITH", "John Smith Emily Johnson Berg Quux", "", "Jean Paul Sartre Artagnan Ludwig Beethoven Παπαδόπουλος Müller"]):
        for word in gone.split():
            assert not re.search(rf"(?<!\w){word}(?!\w)", got[i].text), (word, got[i].text)
    assert got[3].text == text[3] and got[3].n_mentions == 0 and got[4].text.startswith("Mary The end. ")
    a, b, c, d = re.match(r"Mr\. \w+ (\w+) and Dr\. \w+ (\w+) met\. (\w+)'s house; (\w+) left\.", got[0].text).groups()
    assert a == b == c and d == a.upper() and got[0].n_mentions == 5
    assert re.search(r"\w+\n" + a + "\u00a0and", got[2].text) and got[1].text.endswith(f" {d}.") and " The end of Herr Dr. van der " in got[2].text.replace("\n", " ")
    table = spark.createDataFrame([("latin", "f", "Zuleika Xanthippe")], "script string, gender string, names string")
    assert "Zuleika" not in surrogates.replace_private(spark.createDataFrame([(1, "Zuleika Dobson")], "doc_id long, text string"), "key", given=table).first().text


def test_gradients():
    rng = np.random.default_rng(0)
    words = [f"word{i}" for i in range(30)]
    inputs = toxicity.Inputs({w: i + 1 for i, w in enumerate(words[:20])}, rng.normal(size=toxicity.BUCKETS).astype(np.float32))
    size = toxicity.WORD + toxicity.GRAM + 1
    start = lambda *s: (rng.normal(size=s) * 0.4).astype(np.float32)
    p = {"words": start(21, toxicity.WORD), "grams": start(toxicity.BUCKETS, toxicity.GRAM), "look": start(16, 8), "look0": start(8), "ask": start(8), "out": start(16), "out0": start(1)}
    for side in "fb":
        p |= {"w" + side: start(size, 24), "b" + side: start(24), "u" + side: start(8, 24)}
    frames = rng.integers(0, 30, (9, 4))
    mask = np.arange(9)[:, None] < np.array([9, 4, 1, 7])[None]
    y, enc = np.array([1, 0, 1, 0], np.float32), inputs.encode(words)

    def loss():
        x = inputs.rows(p, enc)
        z = toxicity.logits(p, np.concatenate([x @ p["wf"] + p["bf"], x @ p["wb"] + p["bb"]], axis=1), frames, mask).astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    g = toxicity.gradients(p, enc, inputs, frames, mask, y)
    for k in ("wf", "ub", "look", "ask", "out", "bb", "words"):
        for at in [tuple(rng.integers(0, n) for n in p[k].shape) for _ in range(4)]:
            keep = p[k][at]
            p[k][at] = keep + 1e-2
            up = loss()
            p[k][at] = keep - 1e-2
            down = loss()
            p[k][at] = keep
            assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3 + 0.05 * abs(g[k][at]), (k, at)


def test_toxicity(spark, docs, empty):
    rng = random.Random(4)
    rows = []
    for i in range(600):
        w = [f"w{rng.randrange(80)}" for _ in range(rng.randrange(5, 150))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(["vile", "vilest", "rotten"]))
        rows.append((i, " ".join(w), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    out = toxicity.score(df, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).where("held").collect()
    assert np.mean([r.predicted == r.toxic for r in out]) > 0.9 and len(out) > 100
    assert {r.doc_id for r in out} == {i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2}
    scored = toxicity.score(docs.select("doc_id", "text", F.lit(1).alias("score")), model).collect()
    assert len(scored) == len(corpus()) and all(0 <= r.score <= 1 for r in scored)
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.train([], []) == 0.0 and toxicity.train(["a"], [1]) == 1.0


def test_windows_cover_texts():
    for n in (0, 1, 64, 65, 96, 97, 1000):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.WINDOW >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [r for r in corpus(60) if r[0] is not None]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 7 == 3)) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in pipeline.STAGES[1:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", "), name
    out = pipeline.run(spark, str(tmp_path))
    assert out.count() > 0 and "sequence_id" in out.columns
