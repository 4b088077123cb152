"""The pipeline as a whole against plain Python stages."""

import os
import re
import sys

import public_tokenizers
import sentencepiece

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
import corpus_pipeline
from pagerows.llm import simhash

WORDS = "amber basin cedar delta ember fjord grove heron inlet jetty knoll larch".split()


def prose(k: int, n: int = 30) -> str:
    return " ".join(WORDS[(k * 7 + i * i * (k + 3)) % 12] + str(chr(97 + (k + i) % 26)) for i in range(n))


def test_pipeline_equals_plain_stages(spark, tmp_path):
    item = " ".join(f"passage{chr(97 + i)}" for i in range(15))
    documents = [
        (1, prose(1)), (2, prose(1)), (1, prose(1)),  # copies
        (3, prose(3)), (3, prose(4)),  # one id, different texts
        (5, prose(1)), (5, prose(5)),  # a copy and a text of its own share an id
        (6, prose(6)), (6, prose(6).upper()),  # a copy under the same id
        (7, item), (8, prose(8) + " " + item),  # contaminated
        (9, prose(9) + " write to ann@example.org now"),
        (None, prose(1)), (None, prose(1)), (None, None), (10, None), (11, ""), (None, item),
    ]
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))

    # no labels: nothing is toxic. Near copies: groups of fingerprints within two bits, one row of the least id each
    prints = [simhash.fingerprint(t) for _, t in documents]
    group = list(range(len(documents)))
    for a in range(len(documents)):
        for b in range(a):
            if None not in (documents[a][0], documents[b][0]) and (prints[a] ^ prints[b]).bit_count() <= 2:
                group = [group[b] if g == group[a] else g for g in group]
    want = [d for d in documents if d[0] is None]
    choices = []
    for g in set(group):
        own = [d for d, x in zip(documents, group) if x == g and d[0] is not None]
        if own:
            choices.append({d for d in own if d[0] == min(i for i, _ in own)})

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))

    def clean(rows):
        stay = [(i, t or "") for i, t in rows if item not in (t or "").lower()]
        texts = [(i, re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t)) for i, t in stay]
        return [(i, tuple(model.encode(t) + [model.eos_id()])) for i, t in texts]

    rows = [(r.doc_id, tuple(r.ids)) for r in got.collect()]
    for choice in choices:
        if possible := clean(choice):
            assert sum(rows.count(p) for p in set(possible)) == 1
            rows = [r for r in rows if r not in possible]
    assert sorted(map(str, rows)) == sorted(map(str, clean(want)))


def test_columns_of_any_name_and_empty_tables(spark, tmp_path):
    """Columns that are named like those of the operators pass every stage but the last, which has columns of its own."""
    kinds = "doc_id long, text string, n_words string, contaminated int, fp int, root string, score double, spans string, ids string, N_Tokens string, component_id long, items array<int>"
    names = [k.split()[0] for k in kinds.split(", ")]
    rows = [(k, t, "w", 1, 2, "r", 0.5, "s", "i", "t", 7, [k]) for k, t in enumerate([prose(1), prose(2), None, "", prose(1)])]
    for case, some in (("full", rows), ("none", [])):
        base = f"{tmp_path}/{case}"
        spark.createDataFrame(some, kinds).write.parquet(f"{base}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
        docs = spark.read.parquet(f"{base}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, base)
            assert sorted(docs.columns) == sorted(names), name
        kept = {r.doc_id: (r.n_words, r.contaminated, r.fp, r.root, r.score, r.spans, r.ids, r.N_Tokens, r.component_id, r["items"]) for r in docs.collect()}
        assert kept == {k: ("w", 1, 2, "r", 0.5, "s", "i", "t", 7, [k]) for k in ((0, 1, 2) if some else ())}
        got = corpus_pipeline.STAGES[-1][1](spark, docs, base)
        assert {"doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(got.columns) and got.count() == len(kept)
