import re

import corpus_pipeline
from querylens.llm.common import load

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_small_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(20)], "doc_id long, quality int, toxic int")
    for name, docs in (("odd", odd.select(COLUMNS)), ("empty", empty)):
        where = str(tmp_path / name)
        docs.write.parquet(f"{where}/documents.parquet")
        labels.write.parquet(f"{where}/labels.parquet")
        rows = load(spark, where, "documents")
        for i, (stage, f) in enumerate(corpus_pipeline.STAGES):
            out = f(spark, rows, where)
            assert out.columns == COLUMNS or i == len(corpus_pipeline.STAGES) - 1
            out.write.parquet(f"{where}/{stage}")
            rows = spark.read.parquet(f"{where}/{stage}")
            if stage == "secrets":
                assert not [r for r in rows.collect() if re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", r.text or "")]
        if name == "empty":
            assert rows.count() == 0
        else:
            lengths = {}
            for r in rows.collect():
                lengths[r.sequence_id] = lengths.get(r.sequence_id, 0) + r.length
            assert all(n == 1024 for s, n in lengths.items() if s < max(lengths)) and max(lengths.values()) <= 1024
