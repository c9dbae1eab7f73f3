"""The ten queries against SQL or a brute-force version on whole tables of the small scale."""

from __future__ import annotations

import hashlib
import re
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows, sql_rows
from tests.llm.brute import components, plain_log_mel, repeats
from wavestack.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf, name):
    got = QUERIES[name](spark, sf)
    names, want = sql_rows(ORACLES[name], sf)
    assert sorted(got.columns) == names
    assert rows(got) == want


def test_sharding(spark, sf, docs):
    got = QUERIES["op1_sharding"](spark, sf).collect()
    assert sorted(r.doc_id for r in got) == sorted(d for d, _, _ in docs)
    text = {d: (t or "").encode() for d, t, _ in docs}
    shard_of: dict[bytes, int] = {}
    slots: dict[int, list[int]] = {}
    for r in got:
        assert r["size"] == len(text[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(text[r.doc_id])
        assert shard_of.setdefault(text[r.doc_id], r.shard) == r.shard
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(40))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sums = [sum(r["size"] for r in got if r.shard == i) for i in range(40)]
    groups: dict[bytes, int] = {}
    for d, t, _ in docs:
        groups[text[d]] = groups.get(text[d], 0) + len(text[d]) + 16
    # groups above an even share stand alone; the others differ from it by no more than the largest of them
    alone = [s for s in groups.values() if s * 40 > sum(groups.values())]
    rest = sorted(sums)[: 40 - len(alone)] if alone else sums
    largest = max((s for s in groups.values() if s not in alone), default=0)
    assert max(rest) - min(rest) <= 2 * largest


def wav(samples: bytes) -> bytes:
    """Header of 8-bit mono PCM at 8 kHz, field by field, and the samples."""
    n = len(samples)
    little = lambda v, size: v.to_bytes(size, "little")
    return b"RIFF" + little(36 + n, 4) + b"WAVEfmt " + little(16, 4) + little(1, 2) + little(1, 2) + little(8000, 4) + little(8000, 4) + little(1, 2) + little(8, 2) + b"data" + little(n, 4) + samples


def test_audio(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op3_audio"](spark, sf).collect()}
    by_text: dict = {}
    for i, (d, t, _) in enumerate(docs):
        data = (t or "").encode()
        payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
        media, r = wav(payload), got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(data), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r.tail_crc32, r.media_bytes, r.media_sha256) == (zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
        assert by_text.setdefault(t, r.feature) == r.feature
        if i % 20 == 0 and len(payload) < 20_000:
            frames, values, spans = plain_log_mel(payload)
            said = dict(x.split("=") for x in r.feature.split(";"))
            assert (int(said["rate"]), int(said["frames"]), int(said["segments"]), int(said["tensors"])) == (4000, frames, len(spans), -(-frames // 64))
            assert float(said["mean"]) == pytest.approx(values.mean(), abs=2e-3) and float(said["voiced"]) == pytest.approx(sum(b - a for a, b in spans), abs=2e-3)


def test_language_accuracy(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op4_language"](spark, sf).collect()}
    held = [d for d, _, _ in docs if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d in got if got[d].held_out} == set(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    langs = {d: lang for d, _, lang in docs}
    assert sum(got[d].lang_pred == langs[d] for d in held) >= 0.9 * len(held)


def test_toxicity(spark, sf, docs):
    got = {r.doc_id: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert set(got) == {d for d, _, _ in docs}
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())


@pytest.mark.parametrize(("folder", "caught", "wrong"), [("/root/testdata/sf0.1", 0.75, 0.08), ("/root/testdata/check_s", 0.97, 0.01)])
def test_toxicity_recall(spark, folder, caught, wrong):
    """Of held-out rows: the share of toxic ones caught, and of clean ones rejected; the first table has few toxic texts to learn from."""
    if not Path(folder).exists():
        pytest.skip("no such tables here")
    got = QUERIES["op8_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out")
    counts = {(r.toxic, r.predicted): r["count"] for r in got.groupBy("toxic", "predicted").count().collect()}
    toxic, clean = (sum(n for (t, _), n in counts.items() if t == y) for y in (1, 0))
    assert toxic >= 100 and counts.get((1, 1), 0) >= caught * toxic
    assert clean >= 1000 and counts.get((0, 1), 0) <= wrong * clean


def test_near_duplicates(spark, sf, docs):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in QUERIES["op9_near_duplicates"](spark, sf).collect()}
    assert got == components([(d, t) for d, t, _ in docs])


def test_repeats_brute(spark, sf, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op7_repeats"](spark, sf).collect()}
    assert got == repeats([(d, t) for d, t, _ in docs])


def test_bpe_as_the_library(spark, sf, docs):
    import public_tokenizers as public
    import tiktoken

    from wavestack.llm.bpe import read_ranks

    own = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=read_ranks(public.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in QUERIES["op10_bpe"](spark, sf).collect()}
    for d, t, _ in docs:
        ids = own.encode_ordinary(t or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def test_pipeline(spark, sf, docs):
    """Every stage's decisions on what the one before kept."""
    import corpus_pipeline as pipeline

    names = ["doc_id", "text", "lang", "source", "n_chars"]
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [now.toPandas()]
    for name, function in pipeline.STAGES[:-1]:
        now = function(spark, now, sf).cache()
        assert now.columns == names, name
        kept.append(now.toPandas())
    before, toxic, near, clean, masked = kept
    assert set(toxic.doc_id) <= set(before.doc_id) and len(toxic) > 0.5 * len(before)
    want = {d for d, _, c in components([(r.doc_id, r.text) for r in toxic.itertuples()], 80, 5) if d == c}
    assert set(near.doc_id) == want
    items = [re.findall(r"[0-9a-z\x80-\U0010ffff]+", _lower(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9))}
    hit = {r.doc_id for r in near.itertuples() if _hit(re.findall(r"[0-9a-z\x80-\U0010ffff]+", _lower(r.text)), windows)}
    assert set(clean.doc_id) == set(near.doc_id) - hit
    assert set(masked.doc_id) == set(clean.doc_id)
    last = {r.doc_id: r for r in pipeline.STAGES[-1][1](spark, now, sf).collect()}
    assert {d: r.decoded_sha256 for d, r in last.items()} == {r.doc_id: hashlib.sha256((r.text or "").encode()).hexdigest() for r in masked.itertuples()}
    assert sorted(last) == sorted(masked.doc_id)


def _lower(text: str) -> str:
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def _hit(words: list[str], windows: set) -> bool:
    return any(tuple(words[i : i + n]) in windows for n in {len(w) for w in windows} for i in range(len(words) - n + 1))


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    """A folder with the small tables, and one with empty labels and benchmark."""
    full, empty = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("empty")
    for name in ("labels", "benchmark"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        if name == "labels":
            table = table.withColumn("toxic", (F.col("toxic") * (F.col("doc_id") > 10).cast("int")).cast(table.schema["toxic"].dataType))
        table.write.parquet(str(full / f"{name}.parquet"))
        table.limit(0).write.parquet(str(empty / f"{name}.parquet"))
    return str(full), str(empty)


def test_pipeline_edges(spark, sf, tables):
    """Nulls, empty texts, repeated rows and keys, ties, clashing names: every stage on the same odd rows."""
    import corpus_pipeline as pipeline

    full, empty = tables
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first().text
    plain = " ".join(f"word{i}" for i in range(40))
    rows = [
        (1, None, "en", "s1", None), (2, "", "en", "s1", 0), (3, plain, None, None, 1), (3, plain, None, None, 1), (3, "another text here", "en", "s2", 17),
        (None, plain, "en", "s1", 1), (None, "", "en", "s1", 0), (4, plain + " more", "en", "s1", 1), (5, f"before {item} after", "en", "s1", 1), (6, "password=Zx9kQ2mLp0Vt7", "en", "s9", 22), (7, "short", "en", "s1", 5),
    ]
    odd = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, items int, _tag int, label string")
    out = {}
    for folder in (full, empty):
        for name, function in pipeline.STAGES:
            got = function(spark, odd, folder)
            if name != "tokens":
                assert got.columns == odd.columns and dict(got.dtypes) == dict(odd.dtypes), name
            out[name, folder] = sorted(((r.doc_id or 0, getattr(r, "text", None)) for r in got.select("doc_id", *(["text"] if "text" in got.columns else [])).collect()), key=repr)
            assert function(spark, odd.limit(0), folder).count() == 0, name
    every = sorted(((r[0] or 0, r[1]) for r in rows), key=repr)
    one_each = sorted([x for x in {e: None for e in every} if x[0] != 4] + [], key=repr)
    for folder in (full, empty):
        assert out["toxicity", folder] == every
        assert out["near_duplicates", folder] == one_each
        assert out["decontamination", folder] == [e for e in every if folder == empty or e[0] != 5]
        assert [t for d, t in out["secrets", folder] if d == 6] == ["[SECRET]"] and len(out["secrets", folder]) == len(every)
        assert len(out["tokens", folder]) == len(every)
