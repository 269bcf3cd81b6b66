from collections import Counter

from pyspark.sql import functions as F

import brute
import corpus_pipeline
from llm_fixtures import documents, llm, odd_docs  # noqa: F401
from tidemark.llm import langid, mixing
from tidemark.session import scratch_path
from test_operators import encoding  # noqa: F401


def plain(docs, encoding):  # noqa: F811
    """The stages one after another by plain means; texts as they are after the fourth."""
    model = langid.fit(docs)
    seen = docs.select("*", langid.language(F.col("text"), model).alias("p")).where("p.lang_pred <> 'und' and p.score >= 0.3").drop("p")
    rows = [r.asDict() for r in seen.collect()]
    group = brute.components([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 80, 100, 5)
    rows = [r for r in rows if r["doc_id"] is None or group[r["doc_id"]] == r["doc_id"]]
    left = brute.without_repeats([(r["doc_id"], r["text"]) for r in rows if r["doc_id"] is not None], 20)
    for r in rows:
        if r["doc_id"] is not None and len(left[r["doc_id"]]) < len(brute.words(r["text"])):
            r["text"] = " ".join(left[r["doc_id"]])
    return rows


def test_the_pipeline_is_its_stages_by_plain_means(llm, documents, encoding, tmp_path):  # noqa: F811
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    docs = llm.read.parquet(f"{tmp_path}/documents.parquet")
    rows = plain(docs, encoding)
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        path = scratch_path(llm, name)
        stage(llm, kept, str(tmp_path)).write.parquet(path)
        kept = llm.read.parquet(path)
        assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text, r.source) for r in kept.collect()) == Counter((r["doc_id"], r["text"], r["source"]) for r in rows)
    assert 100 < len(rows) < docs.count()
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mix_sources(kept).collect()}
    want = Counter()
    for r in rows:
        size, words = taken[r["doc_id"]]
        whole, part = divmod(words, size) if size else (0, 0)
        texts = [r["text"]] * whole + ([mixing._head(r["text"], part)] if part else [])
        for t in texts:
            ids = encoding.encode_ordinary(t)
            want[r["doc_id"], len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(t)] += 1
    assert Counter(map(tuple, corpus_pipeline.run(llm, str(tmp_path)).collect())) == want


def test_stages_take_odd_and_no_rows(llm, odd_docs):  # noqa: F811
    for docs in (odd_docs, odd_docs.where("false")):
        for name, stage in corpus_pipeline.STAGES:
            path = scratch_path(llm, name)
            out = stage(llm, docs, "")
            assert name == "byte_bpe" or out.columns == docs.columns
            out.write.parquet(path)
            docs = llm.read.parquet(path)
