"""The operators' queries next to their SQL, and the pipeline stage by stage, on the smallest tables."""

import os

import corpus_pipeline
import pytest
from oracle import connect, differences

from coppice.llm import containment, divergence, lines, mixing, near
from coppice.llm.queries import QUERIES
from coppice.session import cut

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    n, problems = differences(spark, connect(SF_DIR), SF_DIR, QUERIES[name])
    assert not problems
    assert n > 0


def test_pipeline_stages(spark):
    """Every stage keeps what its operator's own result says, of what the stage before it kept."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    columns = docs.columns
    say = {
        "quality rules": lambda d: {r.doc_id for r in divergence.judged(d).where("kept").collect()},
        "line dedup": lambda d: _left_after_lines(d),
        "near dedup": lambda d: {r.doc_id for r in near.grouped(d).where("kept").collect()},
        "decontamination": lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in containment.found(d, bench).collect()},
        "mixing": lambda d: {r.doc_id for r in mixing.mixed(d).where("kept").collect()},
    }
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        after = cut(stage(spark, docs, SF_DIR))
        assert {r.doc_id for r in after.collect()} == say[name](docs)
        assert after.columns[: len(columns)] == columns
        docs = after
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > 0 and sizes == sorted(sizes, reverse=True)
    assert corpus_pipeline.run(spark, SF_DIR).count() == sizes[-1]


def _left_after_lines(docs):
    gone = {}
    for r in lines.repeated(docs).collect():
        gone.setdefault(r.doc_id, set()).add(r.line_no)
    kept = set()
    for r in docs.collect():
        left = [x for n, x in enumerate(r.text.split("\n")) if n not in gone.get(r.doc_id, ())]
        if r.doc_id not in gone or any(x.split() for x in left):
            kept.add(r.doc_id)
    return kept
