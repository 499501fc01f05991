import os
import random

import corpus_pipeline
from fieldsieve.llm import near_dedup
from fieldsieve.llm.common import cut, drop, owned, scratch_dir

from .conftest import frame, prose


def test_a_stage_deletes_its_own_tables_alone(spark, sf):
    """A result that is not read yet outlives stages of the pipeline."""
    rng = random.Random(2)
    docs = frame(spark, [prose(rng, 60) for _ in range(12)] + ["one text " * 30] * 3)
    held = near_dedup.linked(docs)
    first = corpus_pipeline.near(spark, docs, sf)
    assert first.count() == 13
    left = [p.removeprefix("file://") for p in corpus_pipeline._LEFT.get()]
    assert left and any(map(os.path.exists, left))
    corpus_pipeline.near(spark, docs.limit(0), sf)
    assert not any(map(os.path.exists, left))
    assert sorted(r["component_id"] for r in held.collect()) == [*range(13), 12, 12]


def test_owners(spark):
    with owned() as outer:
        cut(spark.range(3))
        with owned() as inner:
            kept = cut(spark.range(4))
        cut(spark.range(5))
    alone = cut(spark.range(6))
    assert len(outer) == 2 and len(inner) == 1 and scratch_dir(spark) in inner[0]
    drop(spark, outer + outer)
    assert kept.count() == 4 and alone.count() == 6 and not os.path.exists(outer[0].removeprefix("file://"))
