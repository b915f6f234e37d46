"""The pipeline's stages, each on its own input, against brute force."""

import re
from collections import Counter

import corpus_pipeline
from test_operators import WORD, brute_components, check_packing, targets_of

from stillflow.llm.common import written


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, sf), name)
        assert name == "packing" or docs.columns == columns
    toxic = {r.doc_id: r.text for r in out["toxicity"].collect()}
    insults = re.compile(r"\b(idiot|moron|stupid|scum|worthless|clown|trash|pathetic|disgusting|loser)\b", re.I)
    everything = spark.read.parquet(f"{sf}/documents.parquet").collect()
    clean = [r for r in everything if not insults.search(r.text)]
    assert len([r for r in clean if r.doc_id in toxic]) >= 0.95 * len(clean)
    want = {i for i, _, c in brute_components(list(toxic.items())) if i == c}
    near = {r.doc_id: (r.source, r.text) for r in out["near_duplicates"].collect()}
    assert set(near) == want
    size, taken = Counter(), Counter()
    for s, t in near.values():
        size[s] += len(WORD.findall(t))
    mixed = out["mixing"].collect()
    for r in mixed:
        assert near[r.doc_id][1].startswith(r.text)
        taken[r.source] += len(WORD.findall(r.text))
    assert all(abs(taken[s] - t) < 2 for s, t in targets_of(size).items())
    from tokenizers import Tokenizer

    from stillflow.llm.token_counts import vocabulary_path

    check_packing(out["packing"].collect(), [(r.doc_id, r.text) for r in mixed], Tokenizer.from_file(vocabulary_path()))


ODD = [
    (1, "alpha beta gamma delta epsilon zeta eta", "a", 7), (4, "alpha beta gamma delta epsilon zeta eta", "b", 8), (1, "one two three four five six", "a", None), (None, "red green blue cyan pink grey", "a", 1),
    (None, "red green blue cyan pink grey", "a", 1), (None, "Alpha beta gamma delta epsilon zeta eta", None, 2), (None, None, "a", 0), (9, None, None, 0), (9, None, None, 0), (10, "", "a", 3), (11, "short", "c", None), (12, "word " * 9000, "c", 5),
]


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties, and columns that operators use inside."""
    schema = "doc_id long, text string, source string, size int"
    spark.createDataFrame([(1, 0), (4, 0), (None, 1), (9, None)], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame(ODD, schema).selectExpr("*", "'x' as text_hash", "1 as _row", "2 as kept", "3 as finish", "4 as score")
    key = lambda df: sorted(((r.doc_id, r.text, r.source, r.size) for r in df.collect()), key=repr)
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = out[name] = written(stage(spark, docs, str(tmp_path)), name)
        assert name == "packing" or docs.columns == before.columns
    assert key(out["toxicity"]) == sorted([tuple(r) for r in ODD], key=repr)
    # The two groups of alpha and one are one by doc_id 1: it stays, once, by the text with the smaller hash.
    near = key(out["near_duplicates"])
    assert len([r for r in near if r[0] == 1]) == 1 and not any(r[0] == 4 or (r[0] is None and (r[1] or "").startswith("Alpha")) for r in near)
    assert [r for r in near if (r[1] or "").startswith("red")] == [(None, "red green blue cyan pink grey", "a", 1)]
    assert [r for r in near if not r[1]] == sorted([r for r in ODD if not r[1]], key=repr)
    assert {r[0] for r in near if r[1]} == {1, None, 11, 12}
    assert len([r for r in key(out["mixing"]) if not r[1]]) == 4 and out["packing"].filter("length > 1024").count() == 0


def test_stages_on_no_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
        assert docs.count() == 0


def test_run_is_registered(spark, sf):
    import __spark_entry__

    assert __spark_entry__.queries()["pipeline"](spark, sf).count() > 0
    assert "pipeline" not in __spark_entry__.oracle_sql()
    assert sorted(k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)) and len([k for k in __spark_entry__.queries() if re.match(r"op\d+_", k)]) == 10
