"""The pipeline's stages, each held against what its operator says of its input, and its result against a brute-force packing check."""

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from ledgerloom.llm import langid, pii, rules

from . import corpus
from .test_simhash import similarity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("tables"))
    corpus.docs(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{place}/documents.parquet")
    return place


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.materialize(stage(spark, out[-1], folder)))
    for before, after in zip(out, out[1:-1], strict=False):
        assert after.columns == docs.columns
        if before is not docs:
            assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in before.select("doc_id").collect()}
    told = langid.classify(docs, langid.train(docs))
    assert sorted(map(str, out[1].select("doc_id").toPandas()["doc_id"])) == sorted(map(str, told.where("lang_pred <> 'und' and score >= 0.5").toPandas()["doc_id"]))
    assert sorted(map(str, out[2].select("doc_id").toPandas()["doc_id"])) == sorted(map(str, rules.judge(out[1]).where("kept").toPandas()["doc_id"]))
    kept, before = ([(r["doc_id"], r["text"]) for r in x.where("doc_id is not null").collect()] for x in (out[3], out[2]))
    alike = [[j for j, (_, b) in enumerate(before) if similarity(a, b) >= 0.8] for _, a in before]
    groups = set()
    for i in range(len(before)):
        seen, new = set(), {i}
        while new:
            seen |= new
            new = {j for x in new for j in alike[x]} - seen
        groups.add(min(before[j][0] for j in seen))
    assert sorted(d for d, _ in kept) == sorted(groups)
    assert out[4].count() == out[3].count()
    for r in out[4].where("text is not null").collect():
        assert pii.base_spans(r["text"]) == []
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sizes = {r["doc_id"]: len(exact.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in out[4].collect()}
    packed = out[5].collect()
    assert sum(r["length"] for r in packed) == sum(sizes.values())
    again = [tuple(r) for r in corpus_pipeline.run(spark, folder).collect()]
    assert sorted(map(str, again)) == sorted(str(tuple(r)) for r in packed)


def test_empty_table(spark, tmp_path):
    corpus.empty(spark).select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
