import sentencepiece
from test_operators import DOCS, MODEL

import corpus_pipeline
from conftest import SMALL


def test_encode_stage_gives_token_ids(spark):
    texts = ["", "two words", "a\nb  \u00e9", None]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, SMALL).collect()}
    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k, t in enumerate(texts):
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        assert got[k].ids == ids and got[k].n_tokens == len(ids) and got[k].decoded == model.decode(ids)
