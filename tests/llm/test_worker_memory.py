"""Python workers outlive a stage: what they hold is bounded."""

import numpy as np
import pytest

from runledger.llm import decontaminate, order_minhash, packing, pii, quality_rules
from runledger.llm.common import utf8

OPTION = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_chunk_cache_begins_anew():
    import public_tokenizers
    import pyarrow as pa

    ids = packing.Ids(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" ".join(f"w{k}x{i}" for i in range(150_000)) for k in range(3)]
    for text in (*texts, texts[0]):
        got, cuts = ids.texts(pa.array([text, text[:20]], pa.string()))
        assert got[:cuts[1]].tolist() == ids.encode(text).tolist()
        assert got[cuts[1]:].tolist() == ids.encode(text[:20]).tolist()
        # at most the bound and the chunks of one run of texts
        assert len(ids.known) < 400_000 and len(ids.sizes) == len(ids.known)


def _classify(docs, _):
    labels = docs.sparkSession.createDataFrame([(5, 1), (7, 0), (9, 1)], "doc_id long, quality long")
    quality_rules.classify(docs, labels)


@pytest.mark.parametrize("module,work,name", [
    (quality_rules, _classify, "statistics"),
    (order_minhash, lambda docs, _: order_minhash.near_duplicates(docs), "sketched"),
    (packing, packing.pack_documents, "pieces"),
    (pii, lambda docs, _: pii.find_spans(docs), "inspected"),
])
def test_batches_of_whole_texts_are_small(docs_of, odd_rows, monkeypatch, module, work, name):
    import public_tokenizers

    docs = docs_of(odd_rows)
    seen, write = {}, module.written

    def noted(df, at, *more):
        seen[at] = int(df.sparkSession.conf.get(OPTION))
        return write(df, at, *more)

    monkeypatch.setattr(module, "written", noted)
    before = docs.sparkSession.conf.get(OPTION)
    work(docs, public_tokenizers.path("byte_bpe_50k.json"))
    assert seen[name] <= 1000
    assert docs.sparkSession.conf.get(OPTION) == before


def test_pieces_are_small_and_change_no_statistic():
    import pyarrow as pa

    assert max(quality_rules.PIECE, decontaminate.PIECE) <= 1 << 20
    texts = ["Some words, MORE words 12 \u2014 \u00fcn\u00ef.\n" * k for k in (1, 50, 0, 3000, 7)]
    data, o = utf8(pa.array(texts))
    whole = quality_rules._describe(data, o)
    parts = [quality_rules._describe(data[o[i]:o[i + 1]], o[i:i + 2] - o[i]) for i in range(len(texts))]
    assert np.array_equal(whole, np.concatenate(parts))
