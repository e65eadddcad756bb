"""The pipeline's stages on a small corpus with planted cases, each against what its rule says of the rows it gets."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from inkwell.llm import decontaminate, near_dups


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(f"the {''.join(r.choice('abcdefghijklmnop') for _ in range(r.randrange(4, 9)))} of" for _ in range(words // 3)) + "."


ITEM = " ".join(f"question{i} word{i * 7}" for i in range(12))
SHARED = prose(999, 30)


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    texts = [f"{prose(i, 60)}\n{prose(i + 1000, 45)}" for i in range(60)]
    texts += ["the ### of%%% and*** " * 30] * 2 + ["For " * 100] * 3  # 60-64: junk
    texts += [f"{prose(200, 60)}\n{SHARED}", f"{prose(201, 60)}\n{SHARED}"]  # 65, 66: a line in both
    words = texts[5].replace("\n", " ").split(" ")
    texts += [" ".join(words[:40] + ["changed"] + words[41:])]  # 67: a near copy of 5
    texts += [texts[7], f"{prose(300, 40)} {ITEM} {prose(301, 40)}", None, ""]  # 68: a copy of 7, 69: a leak, 70, 71
    d = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, ITEM), (2, "nothing like this is anywhere in the corpus at all")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, texts


def kept(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_and_run(spark, corpus):
    d, texts = corpus
    columns = spark.read.parquet(f"{d}/documents.parquet").columns
    docs, out = corpus_pipeline.load(spark, d, "documents"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, d)
        if k < 4:
            assert docs.columns == columns
            docs = corpus_pipeline.cut(docs, f"test-stage-{k}")
            out[name] = kept(docs)
    good = out["quality classifier"]
    assert set(range(60)) | {65, 66, 67, 68, 69} <= set(good) and not set(range(60, 65)) & set(good)
    lines = out["line dedup"]
    assert set(lines) == set(good)
    assert lines[65] == texts[65] and lines[66] == texts[66].split("\n")[0] and lines[68] == ""
    assert all(lines[i] == texts[i] for i in range(60))
    near = out["near-dedup"]
    known = near_dups.WordHashes()
    sets = {i: near_dups.shingles(t or "", known) for i, t in lines.items()}
    copies = {i for i in lines for j in lines if j < i and ((lines[i] or "") == (lines[j] or "") or near_dups.weighted_jaccard((sets[i][0], sets[i][1].astype(float)), (sets[j][0], sets[j][1].astype(float))) >= 0.85)}
    assert set(near) == set(lines) - copies and 67 in copies
    clean = out["decontamination"]
    hashes = decontaminate.WordHashes()
    item = decontaminate.hashed(ITEM, hashes)
    leaks = {i for i, t in near.items() if t and decontaminate.best_stretch(item, decontaminate.hashed(t, hashes))[0] <= decontaminate.most_edits(len(item), 0.2)}
    assert set(clean) == set(near) - leaks and leaks == {69}
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {}
    for i, t in clean.items():
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in docs.collect()} == want
    whole = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, d).collect()}
    assert whole == want


def test_stages_on_an_empty_table(spark, corpus):
    d, _ = corpus
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, corpus_pipeline.load(spark, d, "documents").where("false"), d).collect() == []
