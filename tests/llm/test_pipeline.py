"""Stages of the pipeline on rows with nulls, extra columns and repeats, and on no rows."""

import pytest
from conftest import SF_DIR

import corpus_pipeline

PROSE = "the cat and the dog of the house sat on a mat with nine other friends of theirs in town"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ("row", "key", "size", "found", "n", "kept", "slot", "rep", "copies", "of", "node", "c1", "id", "words")
ROWS = [
    (1, PROSE, "en", "a", 80),
    (2, PROSE, None, "b", None),
    (3, None, None, None, None),
    (None, PROSE + " but this one is quite another text than the first one was", None, None, None),
    (None, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, PROSE.replace("cat", "bird").replace("mat", "rug").replace("nine", "ten"), "en", None, 80),
    (5, PROSE.replace("cat", "bird").replace("mat", "rug").replace("nine", "ten"), "en", None, 80),
]


@pytest.fixture(scope="module")
def docs(spark):
    schema = ", ".join([COLUMNS, *(f"{c} string" for c in EXTRA)])
    return spark.createDataFrame([row + (None,) * len(EXTRA) for row in ROWS], schema)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, docs, name, stage):
    out = stage(spark, docs, SF_DIR)
    last = name == corpus_pipeline.STAGES[-1][0]
    assert out.columns == (docs.columns + ["shard"] if last else docs.columns)
    rows = out.collect()
    ids = sorted((row["doc_id"] or 0 for row in rows))
    if name == "quality_rules":
        assert ids == [0, 1, 2, 5, 5]
    if name == "near_dedup":
        assert ids == [0, 0, 1, 3, 4, 5]
    if name in ("decontamination", "sharding"):
        assert len(rows) == len(ROWS)
    if name == "mixing":
        assert {row["doc_id"] for row in rows} <= {row[0] for row in ROWS}
    texts = {(row[0], row[1]) for row in ROWS}
    assert all((row["doc_id"], row["text"]) in texts for row in rows)
    assert stage(spark, docs.where("false"), SF_DIR).count() == 0


def test_whole_run_keeps_one_of_each(spark):
    rows = corpus_pipeline.run(spark, SF_DIR).collect()
    assert rows
    texts = {}
    for row in rows:
        texts.setdefault(row["doc_id"], set()).add((row["text"], row["shard"]))
    assert all(len(x) == 1 for x in texts.values())
    assert len({next(iter(x))[0] for x in texts.values()}) == len(texts)
