"""The pipeline on a small corpus whose answer is known, stage by stage."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(5)

    def line(n):
        return " ".join(f"{rng.choice('bcdfg')}{rng.randint(0, 10**6)}" for _ in range(n))

    passage, item = line(60), line(25)
    rows = [(k, f"{line(30)}\n{line(30)}") for k in range(200)]
    rude = {200 + k: f"{line(20)} {' '.join(rng.choice(['snork', 'blargh']) for _ in range(3))} {line(20)}" for k in range(100)}
    rows += list(rude.items())
    rows += [(300, f"{line(20)}\n{passage}"), (301, f"{passage}\n{line(20)}")]
    rows += [(310, f"{line(20)} {item} {line(20)}")]
    near = line(120).split()
    rows += [(320, " ".join(near)), (321, " ".join([*near[:60], "other", *near[61:]])), (322, " ".join(near).upper())]
    rows += [(330, rows[0][1]), (331, None), (332, "")]
    path = str(tmp_path_factory.mktemp("corpus"))
    docs = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    marks = [(i, 1, int(i in rude)) for i, _ in rows if i < 300]
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, dict(rows), rude, passage


def test_stages_and_run(spark, folder):
    path, texts, rude, passage = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert sorted(out.columns) == sorted(docs.columns)
        docs = out.cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
    clean = set(range(200))
    assert clean <= set(kept["toxicity"]) and len(set(kept["toxicity"]) & set(rude)) <= 5
    lines = kept["line dedup"]
    assert lines[300].text == texts[300] and lines[301].text == texts[301].replace(passage + "\n", "")
    assert lines[301].n_chars == len(lines[301].text)
    assert 330 not in lines and clean <= set(lines) and all(lines[k].text == texts[k] for k in clean)
    assert {320, 321, 322} & set(kept["near duplicates"]) == {320}
    assert clean <= set(kept["near duplicates"]) and 310 in kept["near duplicates"]
    last = kept["decontamination"]
    assert 310 not in last and clean <= set(last)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    assert set(got) == set(last)
    for i, r in got.items():
        ids = library.encode(last[i].text or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
