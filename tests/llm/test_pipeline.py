"""The pipeline stage by stage on the smallest tables: each against what its operator says of the stage's own input."""

import re
from collections import Counter
from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.skipif(not SF.exists(), reason="no test tables")
def test_stages(spark):
    import corpus_pipeline as P
    from docketspark.llm import mixing, neardup, quality, secrets
    from docketspark.llm.common import stored, table

    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    docs, labels = table(spark, str(SF), "documents"), table(spark, str(SF), "labels")
    inputs = [docs]
    for name, stage in P.STAGES:
        inputs.append(stored(stage(spark, inputs[-1], str(SF)), f"test-{name}"))
        if name != "packing":
            assert inputs[-1].columns == docs.columns
    ids = lambda df: Counter(r.doc_id for r in df.select("doc_id").collect())
    good, alone, clean, mix = inputs[1:5]
    assert ids(good) == Counter(r.doc_id for r in quality.score_quality(docs, labels).where("predicted = 1").collect())
    assert ids(alone) == Counter(r.doc_id for r in neardup.near_duplicates(good, 5, 80).where("kept").collect())
    assert ids(clean) == ids(alone)
    assert all(not secrets.scan((r.text or "").encode()) for r in clean.collect())
    taken = {r.doc_id: r.taken for r in mixing.mix_sources(clean).collect()}
    words = Counter()
    for r in mix.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert words == Counter({i: n for i, n in taken.items() if n})
    packed = Counter()
    for r in inputs[5].collect():
        packed[r.doc_id] += r.size
    assert packed == words
    assert inputs[5].count() == P.run(spark, str(SF)).count()


def test_stages_take_odd_rows(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, clashing columns, no labels and no rows."""
    import corpus_pipeline as P
    from docketspark.llm.common import stored

    long_ = " ".join(f"w{i}" for i in range(30_000))
    rows = [(None, None, None, None, None), (1, None, "en", "a", 0), (2, "", None, None, 0), (3, " \n", "en", "a", 2), (4, long_, "en", "a", len(long_)), (5, long_ + " end", "en", "b", 1), (6, "token = abcdefgh12 and some more", "de", "b", 31)]
    rows += [(7, "the same row twice", "de", "c", 18)] * 2 + [(None, "no id", "de", "c", 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = "score double, predicted int, held_out int, digest string, component_id int, kept int, findings int, size int, taken int, target int, bin int, shard int, copy int, cluster string"
    odd = spark.createDataFrame([(*r, *([None] * len(clash.split(", ")))) for r in rows], f"{schema}, {clash}")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for docs, n in ((odd, len(rows)), (odd.limit(0), 0)):
        sizes = []
        for name, stage in P.STAGES:
            out = stored(stage(spark, docs, str(tmp_path)), f"odd-{name}")
            assert name == "packing" or out.columns == docs.columns
            docs = out
            sizes.append(out.count())
        assert sizes[0] == n
        if n:
            assert sizes[1] == len(rows) - 1 and sizes[2] == sizes[1]  # 5 is a near copy of 4
            assert {r.doc_id for r in docs.where("bin is not null").collect()} == {4, 6, 7, None}
