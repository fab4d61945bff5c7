"""Every stage of the pipeline against a plain version of it, on the rows that the stage before kept."""

from __future__ import annotations

import collections
import zlib

import pytest
from tokenizers import Tokenizer

from barloom.llm import mixing, toxicity
from barloom.llm.queries import TOKENIZERS
from tests.llm.test_llm import SCHEMA, corpus, plain_components

pipeline = pytest.importorskip("corpus_pipeline")
COLUMNS = SCHEMA.replace(" long", "").replace(" string", "").split(", ")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(rows before the first stage and after each, folder)."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    bad = [(1000 + i, "you disgusting scum " * (3 + i % 5) + f"w{i} w{i + 1}", "en", "s1", 60) for i in range(40)]
    spark.createDataFrame([*corpus(160), *bad], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, 0) for i in range(160)] + [(1000 + i, 0, 1) for i in range(40)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs.collect()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        out.append(docs.collect())
    return out, folder


def counted(rows, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in rows)


def test_toxic_documents_go(spark, stages):
    (before, after, *_), folder = stages
    model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    score = model.score([r.text for r in before])
    assert counted(after, *COLUMNS) == counted([r for r, s in zip(before, score, strict=True) if s < 0.3], *COLUMNS)
    assert not [r for r in after if r.doc_id is not None and r.doc_id >= 1000]
    assert len(after) >= len(before) - 45


def test_repeated_lines_go(stages):
    (_, before, after, *_), _ = stages
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key, last = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(low), 1 << 62
    owner, seen = {}, collections.defaultdict(set)
    for r in before:
        for line in (r.text or "").split("\n"):
            seen[key(line)].add(last if r.doc_id is None else r.doc_id)
    owner = {k: min(v) for k, v in seen.items() if len(v) > 1 and len(k) >= 10}
    want = collections.Counter()
    for r in before:
        mine = last if r.doc_id is None else r.doc_id
        text = "\n".join(line for line in (r.text or "").split("\n") if owner.get(key(line), mine) == mine)
        want[r.doc_id, text, r.lang, r.source, len(text)] += 1
    assert counted(after, *COLUMNS) == want
    assert counted(after, "text") != counted(before, "text")


def test_one_of_each_group_stays(stages):
    (_, _, before, after, *_), _ = stages
    found = plain_components([(r.doc_id, r.text) for r in before])
    stay = {k for k, _, component in found if k == component or (k is None and component is None)}
    want = [r for r in before if r.doc_id in stay or (r.doc_id is None and None in stay)]
    assert counted([r for r in after if r.doc_id is not None], *COLUMNS) == counted([r for r in want if r.doc_id is not None], *COLUMNS)
    assert len(after) < len(before)
    # of every group the smallest id is there, and no two that are there are of one group
    groups = collections.defaultdict(set)
    for k, _, component in found:
        if k is not None and component is not None:
            groups[component].add(k)
    assert all(members & {r.doc_id for r in after} == {component} for component, members in groups.items())


def test_documents_come_as_often_as_the_mix_takes_them(spark, stages):
    (_, _, _, before, after, _), _ = stages
    words = lambda r: len((r.text or "").encode().split())
    mixed = collections.Counter()
    for r in mixing.mix(spark.createDataFrame(before, SCHEMA)).collect():
        mixed[r.doc_id, r["size"]] += r.taken if r["size"] else 1
    got = collections.Counter()
    for r in after:
        got[r.doc_id, words(r)] += words(r) or 1
    assert got == collections.Counter({k: v for k, v in mixed.items() if v})
    kept = counted(before, *COLUMNS)
    assert all(k in kept and n <= 3 * kept[k] for k, n in counted(after, *COLUMNS).items())


def test_every_token_is_packed_once(stages):
    (*_, before, rows), _ = stages
    tokenizer = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    want = collections.Counter()
    for r in before:
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1]
        want[r.doc_id, len(ids)] += len(ids)
    got = collections.Counter()
    for r in rows:
        got[r.doc_id, r.doc_tokens] += r.length
    assert got == want
    whole = {zlib.crc32(b"".join(i.to_bytes(4, "little") for i in [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in before}
    assert all(r.ids_crc32 in whole for r in rows if r.length == r.doc_tokens)
    at = collections.Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == at[r.sequence_id]
        at[r.sequence_id] += r.length
    assert max(at.values()) <= 2048


def test_whole_run_and_empty_tables(spark, stages, tmp_path):
    (*_, rows), folder = stages
    assert counted(pipeline.run(spark, folder).collect(), "doc_id", "doc_tokens", "length") == counted(rows, "doc_id", "doc_tokens", "length")
    for table in ("documents", "labels"):
        spark.read.parquet(f"{folder}/{table}.parquet").where("false").write.parquet(f"{tmp_path}/{table}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
